"""Secret scans with multipart credential linking. DataFrame functions only.

Base findings need no company: assignments to secret names, access key ids and
long hexadecimal runs. Weak candidates - account names, bare or loosely named
secrets, endpoints - say little alone; an interval join within a scope of the
same text keeps those whose complementary parts stand near by.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorline.llm.common import fresh_name, let, stage_table, text_or_empty

#: Code points between the end of one part and the start of the other that belong together.
SCOPE = 300


def _either(word: str) -> str:
    return "".join(f"[{c.upper()}{c.lower()}]" if c.isalpha() else c for c in word)


def _names(*words: str) -> str:
    return "(" + "|".join(map(_either, words)) + ")"


_TO = r"[\"']?\x20*[:=]\x20*[\"']?"
_VALUE = r"[A-Za-z0-9+/_.=-]"
#: kind -> pattern, group and least number of characters. Base kinds first, in the order of the report.
BASE = {
    "assign": (_names("password", "passwd", "secret", "token", "api_?key") + _TO + f"({_VALUE}+)", 2, 8),
    "access": ("AKIA[A-Z0-9]{12,}", 0, 16),
    "hex": ("[0-9a-f]{32,}", 0, 32),
}
#: Weak kinds: part that they are, pattern, group and least number of characters.
WEAK = {
    "account": ("id", _names("user_?name", "user", "login", "client_?id", "access_?key_?id", "account") + _TO + r"([A-Za-z0-9._@-]+)", 2, 3),
    "key": ("secret", _names("secret_?access_?key", "private_?key", "access_?key", "pass", "pwd", "pass_?phrase", "credentials?", "auth") + _TO + f"({_VALUE}+)", 2, 8),
    # A whole run from its start, or in an address 20 characters without a dot and what follows them; no dot at the end.
    "bare": ("secret", r"(?:(?<![A-Za-z0-9+/_.-])[A-Za-z0-9+_-][A-Za-z0-9+/_.-]{18}|[A-Za-z0-9+/_-]{20})[A-Za-z0-9+/_.=-]*(?<!\.)", 0, 20),
    "endpoint": ("endpoint", r"\b(?:https?|ftp|s3|redis|amqp|mongodb|mysql|postgres|postgresql)://[A-Za-z0-9._~%@:/?&=+-]+", 0, 10),
}
_PART = {"assign": "secret", "hex": "secret", "access": "id", **{k: v[0] for k, v in WEAK.items()}}
KINDS = [*BASE, *WEAK]
_SPAN = "array<struct<start:int,kind:int,end:int>>"


def find_spans(text: Column, kind: str, pattern: str, group: int, least: int) -> Column:
    """Spans (start, kind, end) of the leftmost non-overlapping matches whose
    group has at least ``least`` code points; texts without a match cost one
    search. The gaps between the matches give the places."""
    lengths = F.zip_with(
        F.transform(F.split(text, pattern, -1), F.length),
        F.arrays_zip(
            F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.length).alias("whole"),
            F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.length).alias("part"),
        ),
        lambda gap, m: F.struct(gap.alias("gap"), m["whole"].alias("whole"), m["part"].alias("part")),
    )
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("found"))

    def step(acc, m):
        begin = acc["at"] + m["gap"]
        end = begin + F.coalesce(m["whole"], F.lit(0))
        span = F.struct(begin.alias("start"), F.lit(KINDS.index(kind)).alias("kind"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(m["part"] >= least, F.concat(acc["found"], F.array(span))).otherwise(acc["found"]).alias("found"))

    return F.when(text.rlike(pattern), F.aggregate(lengths, start, step)["found"]).otherwise(F.array().cast(_SPAN))


def base_spans(text: Column) -> Column:
    """Base findings of a text, by start and then kind."""
    return F.array_sort(F.concat(*[find_spans(text, k, *v) for k, v in BASE.items()]))


def weak_spans(text: Column) -> Column:
    """Weak candidates of a text, by start and then kind.

    A bare run needs digits and letters of either case. Within an account name
    or an address, where it would be its own company, it also needs 40 letters,
    digits, slashes or plus signs without a break.
    """
    found = {k: find_spans(text, k, *v[1:]) for k, v in WEAK.items()}
    other = F.concat(*[v for k, v in found.items() if k != "bare"])

    def mixed(s):
        run = F.substring(text, s["start"] + 1, s["end"] - s["start"])
        return run.rlike("[0-9]") & run.rlike("[a-z]") & run.rlike("[A-Z]")

    def long(s):
        return F.substring(text, s["start"] + 1, s["end"] - s["start"]).rlike("[A-Za-z0-9/+]{40}")

    def judged(spans):
        hosts = F.filter(spans, lambda x: F.get(parts, x["kind"]) != "secret")
        return let(hosts, lambda h: F.filter(bare, lambda s: long(s) | ~F.exists(h, lambda x: (x["start"] < s["end"]) & (s["start"] < x["end"]))))

    parts = F.array(*[F.lit(_PART[k]) for k in KINDS])
    bare = F.filter(found["bare"], mixed)
    return let(other, lambda o: F.array_sort(F.concat(o, judged(o))))


def spans_text(spans: Column) -> Column:
    """kind:start:end of the spans, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def link_parts(found: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Weak spans with complementary parts near by: ``content, linked``.

    ``found`` has content (digest of a text), base and weak spans. A weak secret
    needs an id or an endpoint within ``scope`` code points, an id needs a
    secret, an endpoint needs both. The distance runs from the end of one to the
    start of the other. The interval join meets in cells of ``scope`` code
    points: a finding stands in all cells that it touches, a candidate looks at
    all that its reach touches. In the first of these the furthest end decides,
    in the last the nearest start, so a cell is one row per part however many
    findings it holds.
    """
    texts = found.filter(F.size("weak") > 0).dropDuplicates(["content"])
    parts_of = F.array(*[F.lit(_PART[k]) for k in KINDS])
    parts = texts.select("content", F.explode(F.concat("base", "weak")).alias("s")).select("content", "s", F.get(parts_of, F.col("s.kind")).alias("part"))
    touched = lambda low, high: F.explode(F.sequence(F.floor(low / scope), F.floor(high / scope)))
    cells = parts.withColumn("cell", touched(F.col("s.start"), F.col("s.end"))).groupBy("content", "cell", "part").agg(F.min("s.start").alias("low"), F.max("s.end").alias("high"))
    weak = parts.filter(F.col("s.kind") >= len(BASE)).withColumn("cell", touched(F.col("s.start") - scope, F.col("s.end") + scope))
    near = (
        weak.alias("w")
        .join(cells.alias("c"), ["content", "cell"])
        .filter((F.col("w.part") != F.col("c.part")) & (F.col("c.high") >= F.col("s.start") - scope) & (F.col("c.low") <= F.col("s.end") + scope))
        .groupBy("content", "s", F.col("w.part").alias("own"))
        .agg(*[F.max(F.col("c.part") == p).alias(p) for p in ("id", "secret", "endpoint")])
    )
    needs = F.when(F.col("own") == "secret", F.col("id") | F.col("endpoint")).when(F.col("own") == "id", F.col("secret")).otherwise(F.col("id") & F.col("secret"))
    return near.filter(needs).groupBy("content").agg(F.array_sort(F.collect_list("s")).alias("linked"))


def _outside(weak: Column, base: Column) -> Column:
    return let(base, lambda b: F.filter(weak, lambda w: ~F.exists(b, lambda x: (x["start"] < w["end"]) & (w["start"] < x["end"]))))


def _spanned(df: DataFrame, text_col: str, scope: int) -> tuple[DataFrame, str, str]:
    """``df`` with two more columns of new names, which are given: base spans and all spans.

    The patterns run once; rows and findings are written, so only rows with weak
    candidates are shuffled, to meet the linked ones of their text.
    """
    text = text_or_empty(F.col(f"`{text_col}`"))
    base, weak, content, spans, key = (fresh_name(df, x) for x in ("base", "weak", "content", "all", "linked"))
    rows = [F.col(f"`{c}`") for c in df.columns]
    held = df.select(*rows, base_spans(text).alias(base), weak_spans(text).alias(weak), F.sha2(text, 256).alias(content))
    held = stage_table(held.withColumn(weak, _outside(F.col(weak), F.col(base))), "spans")
    some = held.filter(F.size(weak) > 0)
    linked = link_parts(some.select(F.col(content).alias("content"), F.col(base).alias("base"), F.col(weak).alias("weak")), scope).withColumnsRenamed({"content": content, "linked": key})
    alone = held.filter(F.size(weak) == 0).select(*rows, base, F.col(base).alias(spans))
    every = F.array_sort(F.concat(F.col(base), F.coalesce(F.col(key), F.array().cast(_SPAN))))
    return alone.unionByName(some.join(linked, content, "left").select(*rows, base, every.alias(spans))), base, spans


def scan(df: DataFrame, text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """Add ``base_spans`` and ``spans`` (base and linked ones), arrays of
    (start, kind, end) in code points, end exclusive, by start and then kind.

    A null text has no spans. Repeated rows stay. Linked spans are found once
    per distinct text and joined back by its digest to the rows that have weak
    candidates. Columns of these names are replaced.
    """
    found, base, spans = _spanned(df, text_col, scope)
    rest = [c for c in df.columns if c.lower() not in ("base_spans", "spans")]
    return found.select(*[F.col(f"`{c}`") for c in rest], F.col(base).alias("base_spans"), F.col(spans).alias("spans"))


def _count(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("long")


def report(documents: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    text = text_or_empty("text")
    found = stage_table(
        documents.select("doc_id", F.sha2(text, 256).alias("content"), base_spans(text).alias("base"), weak_spans(text).alias("weak")).withColumn("weak", _outside(F.col("weak"), F.col("base"))),
        "secret-spans",
    )
    linked = link_parts(found.select("content", "base", "weak"))
    plain = F.array().cast(_SPAN)
    alone = found.filter(F.size("weak") == 0).withColumn("linked", plain)
    joined = found.filter(F.size("weak") > 0).join(linked, "content", "left")
    whole = alone.unionByName(joined)
    return whole.select(
        "doc_id",
        *[_count("base", k).alias(f"n_{k}") for k in BASE],
        F.sha2(spans_text(F.col("base")), 256).alias("base_sha256"),
        spans_text(F.array_sort(F.concat("base", F.coalesce("linked", plain)))).alias("spans"),
    )


def redact(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with every found span of the text replaced by ``[kind]``; null stays null.

    Overlapping spans are replaced together under the first one's kind. All
    columns stay, whatever their names.
    """
    text = F.col(f"`{text_col}`")
    names = F.array(*map(F.lit, KINDS))
    found, _, name = _spanned(df, text_col, SCOPE)

    def step(acc, s):
        gap = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        fresh = F.struct(s["end"].alias("at"), F.concat(acc["out"], gap, F.lit("["), F.get(names, s["kind"]), F.lit("]")).alias("out"))
        return F.when(s["start"] >= acc["at"], fresh).otherwise(F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out")))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    clean = let(F.aggregate(F.col(name), start, step), lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, 2147483647)))
    return found.withColumn(text_col, F.when(F.size(name) == 0, text).otherwise(clean)).select(*[F.col(f"`{c}`") for c in df.columns])
