"""Quality rules as learned decision lists. DataFrame functions only.

Sequential covering on labelled statistics: a rule grows, one threshold
condition at a time, by the gain in information over the labelled documents it
still covers; conditions are pruned from its end by its precision on documents
held out; what it covers leaves, and the next rule grows. Each step is one
grouped count over binned features, so the driver sees at most features x bins
rows. The rules come out as one ordered CASE expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorline.llm.common import WORD_PATTERN, fresh_name, let, stage_table, text_or_empty, words_of

#: Words of a window whose second coming counts as repetition.
WINDOW = 8
SYMBOLS = "[#*$%&|<>]"

#: Labelled documents that rules are learned from, at most (a documented bound:
#: the ones with the smallest hash of doc_id are taken).
SAMPLE_ROWS = 20_000
BINS = 24
MAX_RULES = 6
MAX_CONDITIONS = 3
MIN_COVERED = 5
#: Share of the best gain that is good enough for a test that covers fewer documents.
SLACK = 0.9
#: Share of rejected documents among those a rule covers that held-out labels must show.
MIN_PRECISION = 0.9


def _repeat_words(words: Column) -> Column:
    """Words in windows of WINDOW words that come twice or more.

    Window hashes are built by doubling (1, 2, 4, 8 words); texts without a
    repeated hash are done then. For the others equal hashes meet by sorting,
    and the lengths of the union of their windows are summed: n log n.
    """

    def pair(h: Column, gap: int) -> Column:
        return let(h, lambda x: F.zip_with(F.slice(x, 1, F.greatest(F.size(x) - gap, F.lit(0))), F.slice(x, gap + 1, F.greatest(F.size(x) - gap, F.lit(0))), lambda a, b: F.xxhash64(a, b)))

    def covered(keys: Column) -> Column:
        ordered = F.array_sort(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i"))))
        again = let(
            ordered,
            lambda s: F.filter(
                F.zip_with(s, F.concat(F.slice(s, 2, F.size(s) - 1), F.slice(F.array(F.lit(None).cast("struct<k:bigint,i:int>")), 1, 1)), lambda a, b: F.struct(a.alias("a"), b.alias("b"))),
                lambda p: p["a"]["k"] == p["b"]["k"],
            ),
        )
        at = F.sort_array(F.array_distinct(F.concat(let(again, lambda g: F.concat(F.transform(g, lambda p: p["a"]["i"]), F.transform(g, lambda p: p["b"]["i"]))))))
        return let(at, lambda x: F.aggregate(F.zip_with(x, F.slice(x, 2, F.greatest(F.size(x), F.lit(1))), lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW)))), F.lit(0), lambda s, v: s + v))

    single = F.transform(words, lambda w: F.xxhash64(w))
    keys = pair(pair(pair(single, 1), 2), 4)
    return let(keys, lambda k: F.when(F.size(F.array_distinct(k)) == F.size(k), F.lit(0)).otherwise(covered(k)))


def base_features(df: DataFrame, text_col: str = "text", out: str = "q") -> DataFrame:
    """Add the struct ``out`` with the base features of the whole text.

    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words as long and the
    characters of the text; a null or empty text has 0 everywhere. The name
    must be free in ``df``.
    """
    text = text_or_empty(F.col(f"`{text_col}`"))
    lines = F.filter(F.split(text, "\n", -1), lambda s: s.rlike(WORD_PATTERN))
    as_long = lambda c: c.cast("long")
    counted = let(
        words_of(text),
        lambda w: F.struct(
            as_long(F.size(w)).alias("n_words"),
            as_long(F.when(F.size(w) < WINDOW + 1, F.lit(0)).otherwise(_repeat_words(w))).alias("n_repeat_words"),
            as_long(F.size(F.array_distinct(w))).alias("n_distinct"),
            as_long(F.length(F.array_join(w, ""))).alias("word_chars"),
        ),
    )
    return df.withColumn(out, counted).withColumn(
        out,
        F.struct(
            F.col(f"{out}.n_words").alias("n_words"),
            F.col(f"{out}.word_chars").alias("word_chars"),
            as_long(F.regexp_count(text, F.lit(SYMBOLS))).alias("n_symbols"),
            as_long(let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))).alias("n_dup_lines"),
            F.col(f"{out}.n_repeat_words").alias("n_repeat_words"),
            F.col(f"{out}.n_distinct").alias("n_distinct"),
            as_long(F.regexp_count(text, F.lit("[A-Z]"))).alias("n_capitals"),
            as_long(F.regexp_count(text, F.lit("[!?]"))).alias("n_marks"),
            as_long(F.regexp_count(text, F.lit("[0-9]"))).alias("n_digits"),
            as_long(F.size(lines)).alias("n_lines"),
        ),
    )


def measures(q: str = "q") -> dict[str, Column]:
    """Features that rules may test, all doubles and never null."""
    c = lambda n: F.col(f"{q}.{n}").cast("double")
    words, chars = F.greatest(c("n_words"), F.lit(1.0)), F.greatest(c("word_chars"), F.lit(1.0))
    return {
        "words": c("n_words"),
        "mean_word": c("word_chars") / words,
        "symbols_per_word": c("n_symbols") / words,
        "repeated_share": c("n_repeat_words") / words,
        "dup_line_share": c("n_dup_lines") / F.greatest(c("n_lines"), F.lit(1.0)),
        "distinct_share": c("n_distinct") / words,
        "capital_share": c("n_capitals") / chars,
        "marks_per_word": c("n_marks") / words,
        "digit_share": c("n_digits") / chars,
    }


def base_failed(q: str = "q") -> Column:
    return (F.col(f"{q}.n_words") < 20) | (100 * F.col(f"{q}.n_repeat_words") > 30 * F.col(f"{q}.n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self, measure: dict[str, Column]) -> Column:
        return measure[self.feature] > self.threshold if self.above else measure[self.feature] <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def _all(rule: Rule, measure: dict[str, Column]) -> Column:
    out = F.lit(True)
    for c in rule:
        out = out & c.column(measure)
    return out


def bounded_labels(labels: DataFrame, limit: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, bad of at most about ``limit`` labelled documents, fixed by a hash
    of doc_id. A document with labels that differ counts as bad if most say so;
    null ids and null labels are left out."""
    one = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.avg("quality") < 0.5).cast("int").alias("bad"))
    share = min(1.0, limit / max(1, one.count()))
    return one.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))


def learn(docs: DataFrame, labels: DataFrame) -> list[Rule]:
    """Rules that reject documents, in order; no labels or no bad ones: none.

    One row per labelled document is read; two thirds grow rules, a third
    prunes them and decides whether they stay.
    """
    sample = F.broadcast(bounded_labels(labels))  # at most SAMPLE_ROWS rows of 12 bytes
    id_text = docs.select("doc_id", "text").join(sample, "doc_id")
    measured = base_features(id_text).filter(~base_failed())
    names = list(measures())
    rows = measured.select("bad", (F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(3)) == 0).alias("held"), *[v.alias(k) for k, v in measures().items()])
    rows = stage_table(rows, "rule-rows")
    if not rows.filter("bad = 1").take(1):
        return []
    measure = {n: F.col(n) for n in names}
    cuts = rows.agg(*[F.percentile_approx(n, F.array(*[F.lit((k + 0.5) / BINS) for k in range(BINS)]), 1000).alias(n) for n in names])
    bad_cuts = rows.filter("bad = 1").agg(*[F.percentile_approx(n, F.array(*[F.lit((k + 0.5) / BINS) for k in range(BINS)]), 1000).alias(n) for n in names])
    first, second = cuts.first(), bad_cuts.first()
    edges = {n: sorted({0.0, *first[n], *second[n]}) for n in names}
    edges = {n: sorted({*e, *[(a + b) / 2 for a, b in zip(e, e[1:])]}) for n, e in edges.items()}
    bins = [sum([F.when(F.col(n) > e, 1).otherwise(0) for e in edges[n]], F.lit(0)).alias(n) for n in names]
    # one row per combination of bins: bins decide every test at an edge, so the rules need no more
    tallies = rows.groupBy("held", *bins).agg(F.sum("bad").alias("bad"), F.count("*").alias("n"))
    tallies = stage_table(tallies, "rule-tallies")
    by_bin = {n: F.col(n) for n in names}

    def test(c: Condition) -> Column:
        place = edges[c.feature].index(c.threshold)
        return by_bin[c.feature] > place if c.above else by_bin[c.feature] <= place

    def covers(rule: Rule) -> Column:
        out = F.lit(True)
        for c in rule:
            out = out & test(c)
        return out

    def histogram(where: Column) -> dict[str, list[tuple[int, int]]]:
        long = tallies.filter(where).select("bad", "n", F.explode(F.array(*[F.struct(F.lit(n).alias("f"), F.col(n).alias("b")) for n in names])).alias("x"))
        out = {n: [(0, 0)] * (len(edges[n]) + 1) for n in names}
        for r in long.groupBy("x.f", "x.b").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n")).collect():  # features x bins rows
            out[r.f][r.b] = (r.bad, r.n)
        return out

    def count(where: Column) -> tuple[int, int]:
        r = tallies.filter(where).agg(F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
        return r.bad, r.n

    rules: list[Rule] = []
    left = F.lit(True)
    for _ in range(MAX_RULES):
        rule: Rule = ()
        while len(rule) < MAX_CONDITIONS:
            seen = histogram(left & ~F.col("held") & covers(rule))
            bad, n = map(sum, zip(*seen[names[0]]))
            if bad < MIN_COVERED or rule and bad == n:
                break
            tests = []
            for f in names:
                b, m = 0, 0
                for place, edge in enumerate(edges[f]):
                    b, m = b + seen[f][place][0], m + seen[f][place][1]
                    for above, p, t in ((False, b, m), (True, bad - b, n - m)):
                        if p >= MIN_COVERED and t < n:
                            tests.append((p * (math.log2(p / t) - math.log2(bad / n)), t, Condition(f, above, edge)))
            top = max((gain for gain, _, _ in tests), default=0.0)
            if top <= 1e-9:
                break
            # of tests that gain about as much, the one that covers the fewest documents
            rule = (*rule, min((x for x in tests if x[0] >= SLACK * top), key=lambda x: (x[1], -x[0]))[2])
        if not rule:
            break
        kept, score = rule, -2.0
        for size in range(1, len(rule) + 1):
            bad, n = count(left & F.col("held") & covers(rule[:size]))
            if n and (2 * bad - n) / n > score:
                kept, score = rule[:size], (2 * bad - n) / n
        bad, n = count(left & covers(kept))
        if n < MIN_COVERED or bad < MIN_PRECISION * n or score < 2 * MIN_PRECISION - 1:
            break
        rules.append(kept)
        left = left & ~covers(kept)
    return rules


def verdict(rules: list[Rule], q: str = "q") -> tuple[Column, Column]:
    """Whether the decision list keeps a document, and the text of the rule that
    rejects it (null if none does)."""
    measure, keep, why = measures(q), None, None
    for rule in rules:
        name = F.lit(" and ".join(map(str, rule)))
        hit = _all(rule, measure)
        keep = F.when(hit, False) if keep is None else keep.when(hit, False)
        why = F.when(hit, name) if why is None else why.when(hit, name)
    if keep is None:
        return F.lit(True), F.lit(None).cast(T.StringType())
    return keep.otherwise(True), why


def judge(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """doc_id, n_words and the base features, base_failed, kept and rule of every
    row; null texts are empty and fail; repeated rows stay."""
    keep, why = verdict(rules)
    return base_features(docs.select("doc_id", "text")).select(
        "doc_id",
        *[f"q.{n}" for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        base_failed().alias("base_failed"),
        F.when(base_failed(), False).otherwise(keep).alias("kept"),
        F.when(~base_failed(), why).alias("rule"),
    )


def keep_good(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """The rows of ``docs`` that base rules and the decision list keep, columns unchanged."""
    held = fresh_name(docs, "q")
    keep, _ = verdict(rules, held)
    row = fresh_name(docs, "row")
    # The row number keeps the filter above the features: pushed below, it would
    # work them out again for each of its references.
    measured = base_features(docs, out=held).withColumn(row, F.monotonically_increasing_id())
    return measured.filter((F.col(row) >= 0) & ~base_failed(held) & keep).select(*[F.col(f"`{c}`") for c in docs.columns])
