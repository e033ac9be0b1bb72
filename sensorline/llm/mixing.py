"""Mixing a corpus to target weights of domains. DataFrame functions only.

A labelled table teaches a classifier (naive Bayes over telling words and a
few shape bits) that gives every document posteriors over domains. Rates
r >= 0 of the documents are then fitted by projected gradient descent so that
the expected tokens of each domain, sum_i r_i * tokens_i * p_id, meet targets
in least squares. Every gradient step is one aggregation to a vector with an
entry per domain; the rates are a column expression of the vectors so far.
Tokens are words here, cut at white space and marks.
"""

from __future__ import annotations

import logging
import math
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorline.llm.common import let, stage_table, text_or_empty
from sensorline.llm.rules import SYMBOLS

#: Domains of the labelled table, in order: (name, condition on a label row).
DOMAINS = (("clean", "quality = 1 and toxic = 0"), ("toxic", "toxic = 1"), ("junk", "quality = 0 and toxic = 0"))
#: Wanted shares of the tokens.
TARGETS = {"clean": 0.97, "toxic": 0.02, "junk": 0.01}
#: Labelled documents the classifier is fitted on, at most (a documented bound, chosen by a hash of doc_id).
SAMPLE_ROWS = 12_000
#: Telling words of each domain.
WORDS = 64
#: A word must occur in so many sampled documents to count as telling.
LEAST_DOCS = 3
#: How far the evidence for a word (in nats) must exceed what the best of as many words without meaning reaches.
CLEARLY = 3.0
#: How many times as frequent as elsewhere a telling word must be.
LEAST_ODDS = 3.0
#: Documents that pull a domain's frequency of a word towards that of all documents.
SMOOTHING = 1.0
MAX_STEPS = 60
TOLERANCE = 1e-6
#: A step that comes nearer by less than this share is the last: the targets are out of reach.
PROGRESS = 1e-3
#: The same where the distance is plain.
PLAIN_PROGRESS = 1e-4
#: Share of the largest eigenvalue below which a direction of the domains counts as null.
NULL = 1e-9
#: Largest rate: no document stands in for more than this many of its kind.
MOST = 2.0

_CUT = r"""[\x20\x09-\x0D.,;:!?"'()\[\]]+"""


def plain_words(text: Column) -> Column:
    """Words of a text in lower case, cut at white space and marks."""
    return F.array_remove(F.split(F.lower(text), _CUT, -1), "")


def document_signs(text: Column, words: Column, lexicon: Column | None = None) -> Column:
    """Signs of a text with these plain words that the classifier knows: distinct
    words of the lexicon (all without one) and the names of bits that tell prose
    from junk by symbols, capitals and words that repeat."""
    chars = F.greatest(F.length(text), F.lit(1))
    symbols, capitals = F.regexp_count(text, F.lit(SYMBOLS)), F.regexp_count(text, F.lit("[A-Z]"))
    bits = lambda d: {"#symbols": symbols * 50 > chars, "#capitals": capitals * 3 > chars, "#few": F.size(d) * 24 < chars}
    return let(
        F.array_distinct(words),
        lambda d: F.concat(d if lexicon is None else F.array_intersect(d, lexicon), F.array_compact(F.array(*[F.when(b, F.lit(n)) for n, b in bits(d).items()]))),
    )


class Classifier:
    """Naive Bayes: log scores without any sign and, for each sign, what its
    presence adds for each domain. Only signs that mark some domain other than
    the largest are known, so texts of a rare language are not held against it."""

    def __init__(self, prior: list[float], weights: dict[str, list[float]]):
        self.prior, self.weights = prior, weights

    def posteriors(self, text: Column, words: Column) -> Column:
        """array<double> with a probability per domain, in the order of DOMAINS."""
        n = len(self.prior)
        names = sorted(self.weights)
        lexicon = F.array(*map(F.lit, names)).cast("array<string>")
        table = F.create_map(*[x for s in names for x in (F.lit(s), F.array(*map(F.lit, self.weights[s])))]) if names else None
        zero = F.array(*map(F.lit, self.prior)).cast("array<double>")
        if table is None:
            scores = zero
        else:
            signs = F.array_intersect(document_signs(text, words, lexicon), lexicon)
            scores = F.aggregate(signs, zero, lambda acc, s: let(F.element_at(table, s), lambda w: F.zip_with(acc, w, lambda a, b: a + b)))
        return let(scores, lambda v: let(F.transform(v, lambda a: F.exp(a - F.array_max(v))), lambda e: F.transform(e, lambda a: a / F.aggregate(e, F.lit(0.0), lambda s, b: s + b))))


def _labelled(labels: DataFrame, domains) -> DataFrame:
    domain = F.coalesce(*[F.when(F.expr(c), F.lit(k)) for k, (_, c) in enumerate(domains)])
    one = labels.select("doc_id", domain.alias("domain")).filter("doc_id is not null and domain is not null")
    return one.groupBy("doc_id").agg(F.max("domain").alias("domain"))


def fit_classifier(docs: DataFrame, labels: DataFrame, domains=DOMAINS, limit: int = SAMPLE_ROWS) -> Classifier:
    """Classifier of the domains, from at most about ``limit`` labelled documents.

    Documents with several labels take the last domain in order; null labels
    are left out. Without labels all domains are equally likely.
    """
    known = _labelled(labels, domains)
    share = min(1.0, limit / max(1, known.count()))
    sample = F.broadcast(known.filter(F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(1 << 20)) < int(share * (1 << 20))))  # at most limit rows of 12 bytes
    text = text_or_empty("text")
    signs = stage_table(docs.select("doc_id", "text").join(sample, "doc_id").select("domain", document_signs(text, plain_words(text)).alias("signs")), "signs")
    n = len(domains)
    totals = {r.domain: r.n for r in signs.groupBy("domain").agg(F.count("*").alias("n")).collect()}  # a row per domain
    size = [totals.get(k, 0) for k in range(n)]
    every = sum(size)
    prior = [math.log((s + 1) / (every + n)) for s in size]
    if not every:
        return Classifier(prior, {})
    counts = signs.select("domain", F.explode("signs").alias("sign")).groupBy("sign").agg(*[F.count_if(F.col("domain") == k).alias(f"c{k}") for k in range(n)])
    counts = counts.filter(sum((F.col(f"c{k}") for k in range(n)), F.lit(0)) >= LEAST_DOCS)
    counts = stage_table(counts, "sign-counts")
    chance = math.log(max(1, counts.count())) + CLEARLY
    telling = {}
    for k in (k for k in range(n) if size[k] != max(size)):
        mine, other = (F.col(f"c{k}") + 0.5) / (size[k] + 1), (sum((F.col(f"c{j}") for j in range(n) if j != k), F.lit(0)) + 0.5) / (every - size[k] + 1)
        score = F.col(f"c{k}") * F.log(mine / other)
        # how unlikely it is that the documents of a sign fall into this domain so often by chance
        here, there, share = F.col(f"c{k}"), sum((F.col(f"c{j}") for j in range(n) if j != k), F.lit(0)), size[k] / every
        part = lambda c, q: F.when(c > 0, c * F.log(c / ((here + there) * q))).otherwise(0.0)
        evidence = part(here, share) + part(there, 1 - share)
        for r in counts.filter((mine > LEAST_ODDS * other) & (evidence >= chance)).orderBy(score.desc(), "sign").limit(WORDS).collect():  # WORDS rows
            telling[r.sign] = [r[f"c{j}"] for j in range(n)]
    weights = {}
    for sign, c in sorted(telling.items()):
        common = sum(c) / every
        p = [(c[k] + SMOOTHING * common) / (size[k] + SMOOTHING) for k in range(n)]
        prior = [a + math.log(1 - x) for a, x in zip(prior, p)]
        weights[sign] = [math.log(x) - math.log(1 - x) for x in p]
    return Classifier(prior, weights)


def _solve(matrix: list[list[float]], right: list[float]) -> list[float]:
    """Shortest solution of a small symmetric positive system in least squares:
    directions that are null but for rounding are left out. The system is one of a
    few domains, never one of rows."""
    top = max(max(abs(x) for x in row) for row in matrix)
    if not top > 0:
        return [0.0] * len(right)
    values, vectors = np.linalg.eigh(np.array(matrix) / top)
    held = values > NULL * values[-1]
    part = vectors[:, held]
    return (part @ ((part.T @ np.array(right)) / values[held]) / top).tolist()


class Fit(NamedTuple):
    """Rates as a column over (tokens, p), the totals reached, the steps taken, and
    whether they ended at an optimum that only the bounds keep from the targets, if anything does."""

    rate: Column
    reached: list[float]
    steps: int
    converged: bool


def _rate(moves: list[list[float]], most: float) -> Column:
    """Rate of a row after these moves, each followed by the projection onto 0..most.
    The moves are one constant, so the expression does not grow with them."""
    if not moves:
        return F.lit(1.0)
    steps = F.expr("array(" + ", ".join("array(" + ", ".join(f"{float(x)!r}D" for x in m) + ")" for m in moves) + ")")
    dot = lambda m: sum((F.get("p", F.lit(k)) * F.get(m, F.lit(k)) for k in range(len(moves[0]))), F.lit(0.0))
    return F.aggregate(steps, F.lit(1.0), lambda r, m: F.least(F.lit(float(most)), F.greatest(F.lit(0.0), r - dot(m))))


def fit_rates(members: DataFrame, targets: list[float | None], max_steps: int = MAX_STEPS, most: float = MOST) -> Fit:
    """Rates of the rows of ``members`` (tokens, p: array of posteriors).

    Minimises the squared distance of the expected domain totals from the
    targets over rates between 0 and ``most``, starting from 1. With G = sum
    tokens * p * p^T the distance is measured by the inverse of G, in which no
    domain is drowned by a larger one; where G has none, since the posteriors
    span fewer directions than there are domains, it is the plain distance. In
    the scaled unknowns z_i = sqrt(tokens_i) * r_i a gradient step of length 1
    (plain: 1 / the largest eigenvalue of G) always descends; while it does, the
    next one is twice as long. Steps by the pseudo-inverse of G over the rows
    whose rate is between its bounds come first: they meet the targets, or come
    as near as the directions allow, unless more rates reach a bound.

    Steps end when the targets are met or no step comes nearer. A warning names
    totals that miss their targets. ``converged`` is False if steps ran out, or
    if a part of the targets lies where no rates lead, bounds or not. Rows with
    no tokens keep rate 1; domains whose target is None take no part.
    """
    bound = [k for k, b in enumerate(targets) if b is not None]
    n = len(bound)
    width = len(targets)
    targets = [targets[k] for k in bound]
    t = F.col("tokens").cast("double")
    moves: list[list[float]] = []
    scale = max(math.hypot(*targets), 1e-300)

    def measure(made: list[list[float]]) -> tuple[list[float], list[list[float]]]:
        """Totals at these moves, and G over the rows between the bounds."""
        now = members.select(t.alias("t"), *[F.get("p", F.lit(bound[k])).alias(f"p{k}") for k in range(n)], _rate(made, most).alias("r"))
        free = (F.col("r") > 0) & (F.col("r") < most)
        sums = [F.sum(F.col("r") * F.col("t") * F.col(f"p{k}")).alias(f"s{k}") for k in range(n)]
        grams = [F.sum(F.when(free, F.col("t") * F.col(f"p{i}") * F.col(f"p{j}"))).alias(f"g{i}_{j}") for i in range(n) for j in range(i, n)]
        row = now.agg(*sums, *grams).first()
        return [row[f"s{k}"] or 0.0 for k in range(n)], [[row[f"g{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(n)] for i in range(n)]

    if not n:
        return Fit(F.lit(1.0), [], 0, True)
    reached, whole = measure(moves)
    met = lambda totals: math.dist(totals, targets) <= TOLERANCE * scale
    values = np.linalg.eigvalsh(np.array(whole))
    regular, largest = values[0] > NULL * values[-1], float(values[-1])

    def weighed(miss: list[float]) -> list[float]:
        return _solve(whole, miss) if regular else [x / largest for x in miss]

    def distance(totals: list[float]) -> float:
        miss = [a - b for a, b in zip(totals, targets)]
        return math.sqrt(max(0.0, sum(x * y for x, y in zip(miss, weighed(miss)))))

    least = PROGRESS if regular else PLAIN_PROGRESS
    gram, step, long, by_gram, settled = whole, 0, 1.0, True, not largest > 0
    far = 0.0 if settled else distance(reached)
    while step < max_steps and not settled and not met(reached):
        miss = [a - b for a, b in zip(reached, targets)]
        move = _solve(gram, miss) if by_gram else [long * x for x in weighed(miss)]
        made = [*moves, [move[bound.index(k)] if k in bound else 0.0 for k in range(width)]]
        totals, next_gram = measure(made)
        step, nearer = step + 1, distance(totals)
        if nearer < far * (1 - least) or met(totals):
            moves, reached, gram, far = made, totals, next_gram, nearer
            long, by_gram = long if by_gram else 2 * long, True
        elif by_gram:
            by_gram = False
        elif long > 1:
            long = 1.0
        else:
            settled = True
    if not met(reached):
        why = "no step comes nearer" if settled else "steps ran out"
        logging.getLogger(__name__).warning("rates miss their targets after %d steps (%s): totals %s, targets %s", step, why, reached, targets)
    return Fit(F.when(t > 0, _rate(moves, most)).otherwise(F.lit(1.0)), reached, step, met(reached) or settled and bool(regular))


def token_targets(totals: list[float], shares: list[float]) -> list[float | None]:
    """Totals with the wanted shares that leave the domain of the largest share
    as large as it is. Domains that have no more than their share by then are
    reached: their target is None, so they keep what they have."""
    held = [k for k, a in enumerate(totals) if a > 0 and shares[k] > 0]
    if not held:
        return [None] * len(totals)
    main = max(held, key=lambda k: shares[k])
    whole = totals[main] / shares[main]
    return [a if k == main else s * whole if a > s * whole else None for k, (a, s) in enumerate(zip(totals, shares))]


def domain_members(docs: DataFrame, classifier: Classifier) -> DataFrame:
    """doc_id, tokens (words of the whole text) and posteriors p; null texts have no tokens."""
    return docs.select("doc_id", member(classifier).alias("m")).select("doc_id", "m.tokens", "m.p")


def member(classifier: Classifier) -> Column:
    """Struct of tokens and p; the words of the text are cut once for both."""
    text = text_or_empty("text")
    return let(plain_words(text), lambda w: F.struct(F.size(w).cast("long").alias("tokens"), classifier.posteriors(text, w).alias("p")))


def mix(docs: DataFrame, labels: DataFrame, shares: dict[str, float] = TARGETS, domains=DOMAINS) -> tuple[Column, Classifier, DataFrame]:
    """Fit everything: rates as a column over (tokens, p), the classifier, and the written members.

    The domain of the largest share keeps its tokens and sets the targets of
    the others. Where documents of several domains go, those left make up for
    their part of it by rates a little above 1.
    """
    classifier = fit_classifier(docs, labels, domains)
    members = stage_table(domain_members(docs, classifier), "mix-members")
    n = len(domains)
    row = members.agg(*[F.sum(F.col("tokens") * F.get("p", F.lit(k))).alias(f"s{k}") for k in range(n)]).first()
    wanted = token_targets([row[f"s{k}"] or 0.0 for k in range(n)], [shares[d] for d, _ in domains])
    return fit_rates(members, wanted).rate, classifier, members


def _copies(rate: Column, key: Column) -> Column:
    """Whole copies whose expectation is the rate; the fraction is drawn by a hash of ``key``."""
    draw = F.pmod(F.xxhash64(F.lit(11), key), F.lit(1 << 30)) / (1 << 30)
    return F.floor(rate + draw).cast("long")


def document_rates(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, n_tokens, domain posteriors, rate and copies of every row.

    Posteriors are written once, so each gradient step reads three numbers a
    document instead of its text. Null texts count no tokens and keep rate 1;
    repeated rows have equal rates, and rows of one doc_id equal draws.
    """
    rate, _, members = mix(docs, labels, **options)
    names = [d for d, _ in options.get("domains", DOMAINS)]
    return members.select(
        "doc_id",
        F.col("tokens").alias("n_tokens"),
        *[F.round(F.get("p", F.lit(k)), 9).alias(f"p_{d}") for k, d in enumerate(names)],
        F.round(rate, 9).alias("rate"),
        _copies(rate, F.col("doc_id")).alias("copies"),
    )


def resample(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """``docs`` drawn at the fitted rates, columns unchanged: a row of rate 0.3
    stays with probability 0.3, one of rate 2 comes twice. The draw depends on
    doc_id alone. One pass after the fit, no shuffle."""
    rate, classifier, _ = mix(docs, labels, **options)
    # The row number keeps the filter above this step: pushed below, it would work
    # out the posteriors again for each of its references.
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole")
    held = docs.select(whole, member(classifier).alias("m"), F.monotonically_increasing_id().alias("row"))
    flat = held.filter("row >= 0").select("whole", "row", F.col("m.tokens").alias("tokens"), F.col("m.p").alias("p"))
    drawn = flat.withColumn("copies", _copies(rate, F.col("whole.doc_id"))).filter("copies > 0 and row >= 0")
    return drawn.select(F.explode(F.array_repeat("whole", F.col("copies").cast("int"))).alias("whole")).select("whole.*")
