"""Language identification by Bayesian evidence fusion.

Text likelihoods come from byte trigrams counted over labelled documents. A
first pass gives every row its likelihoods; from them grouped aggregation
learns what the declared markup language, the address suffix and the host say
about the language: host priors are smoothed towards those of the domain above
them, and these towards the whole corpus. The second pass adds the logarithms.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorline.llm.common import let, stage_table
from sensorline.llm.html import main_text
from sensorline.llm.urls import host_of

#: Trigram table size, and characters of labelled text per language that fill it
#: (a documented bound: whole documents, chosen by a hash of doc_id).
BUCKETS = 1 << 16
SAMPLE_ROWS = 6_000
#: Neighbouring trigrams repeat each other's evidence: so many count as one.
TRIGRAMS_PER_FACT = 4.0
#: Rows that pull a host towards its domain, and a domain towards the corpus.
HOST_PULL, DOMAIN_PULL = 8.0, 32.0
#: Weight of a declared language or suffix that nothing was seen about.
PULL = 4.0
#: Rows of a grouped table (some hundred bytes each) that are broadcast at most.
BROADCAST_ROWS = 100_000
#: Posterior from which a language counts as identified.
CONFIDENT = 0.5
CHUNK_CHARS = 1_000_000


def _trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the byte trigrams of all texts (lower case), and their number for each text."""
    raw = [f" {t.lower()} ".encode() if t else b"" for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint32)
    size = np.array([len(r) for r in raw], np.int64)
    made = np.maximum(size - 2, 0)
    at = np.repeat(np.cumsum(size) - size - np.cumsum(made) + made, made) + np.arange(made.sum())
    key = (data[at] << 16 | data[at + 1] << 8 | data[at + 2]) * np.uint32(2654435761) if made.sum() else np.zeros(0, np.uint32)
    return key >> np.uint32(16), made


def train(documents: DataFrame, limit: int = SAMPLE_ROWS) -> tuple[list[str], np.ndarray]:
    """Languages and their log likelihoods of trigram buckets (languages x BUCKETS).

    From at most about ``limit`` labelled documents per language; rows without
    language or text are left out. The driver gets one row per language and
    bucket at most.
    """
    known = documents.filter("lang is not null and text is not null and doc_id is not null")
    sizes = {r.lang: r.n for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row per language
    langs = sorted(sizes)
    if not langs:
        return [], np.zeros((0, BUCKETS))
    share = F.coalesce(*[F.when(F.col("lang") == k, F.lit(min(1.0, limit / sizes[k]))) for k in langs])
    sample = known.filter(F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(1 << 20)) < share * (1 << 20)).select("lang", "text")

    def count(batches):
        total = np.zeros((len(langs), BUCKETS), np.int64)
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                total[langs.index(lang)] += np.bincount(_trigrams([text])[0], minlength=BUCKETS)
        k, b = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(total[k, b])], names=["k", "bucket", "n"])

    counts = np.zeros((len(langs), BUCKETS))
    rows = sample.mapInArrow(count, "k int, bucket int, n long").groupBy("k", "bucket").agg(F.sum("n").alias("n"))
    for r in rows.collect():  # languages x BUCKETS rows at most
        counts[r.k, r.bucket] = r.n
    floor = 0.5
    return langs, np.log((counts + floor) / (counts.sum(1, keepdims=True) + floor * BUCKETS))


def text_scores(rows: DataFrame, langs: list[str], model: np.ndarray, is_page: bool) -> DataFrame:
    """Replace ``body`` by ``scores array<double>``, a log likelihood per language;
    a page is reduced to its main text first. Null and empty texts score 0."""
    rest = [c for c in rows.columns if c != "body"]
    given = rows.select(*rest, "body")
    weights = rows.sparkSession.sparkContext.broadcast(np.ascontiguousarray(model.T, np.float32))  # BUCKETS x languages
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema.fields[:-1])

    def run(batches):
        table = weights.value
        for batch in batches:
            texts = [(main_text(t) if is_page else t) or "" for t in batch.column(len(rest)).to_pylist()]
            out = np.zeros((len(texts), len(langs)))
            start = total = 0
            for k, t in enumerate(texts):
                total += len(t)
                if total >= CHUNK_CHARS or k == len(texts) - 1:
                    keys, made = _trigrams(texts[start : k + 1])
                    some = np.flatnonzero(made)
                    if some.size:
                        ends = np.cumsum(made) - made
                        out[start + some] = np.add.reduceat(table[keys].astype(np.float64), ends[some], axis=0)
                    start, total = k + 1, 0
            made = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * len(langs)), pa.array(out.ravel() / TRIGRAMS_PER_FACT))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], made], names=[*rest, "scores"])

    return given.mapInArrow(run, f"{kinds}, scores array<double>")


def _normal(scores: Column, n: int) -> list[Column]:
    """Probabilities from log scores."""
    top = F.array_max(scores)
    e = [F.exp(F.get(scores, F.lit(k)) - top) for k in range(n)]
    return [x / sum(e[1:], e[0]) for x in e]


def evidence(pages: DataFrame) -> DataFrame:
    """id columns, host, domain, declared, suffix and body of pages."""
    host = host_of(F.col("url"))
    parts = F.split(host, r"\.")
    declared = F.lower(F.regexp_extract("html", r"(?i)<html[^>]*?\slang\s*=\s*[\"']?([a-zA-Z]{2,3})", 1))
    path = F.lower(F.regexp_extract("url", r"^[^:]*://[^/]*/([a-zA-Z]{2})(?:[/?#]|$)", 1))
    return pages.select(
        F.lit(None).cast("long").alias("doc_id"),
        F.col("page_id").cast("long").alias("page_id"),
        host.alias("host"),
        F.when(F.size(parts) > 1, F.concat_ws(".", F.element_at(parts, -2), F.element_at(parts, -1))).alias("domain"),
        F.when(declared != "", declared).alias("declared"),
        F.concat_ws("/", F.element_at(parts, -1), F.when(path != "", path)).alias("suffix"),
        F.col("html").alias("body"),
    )


def _joinable(side: DataFrame) -> DataFrame:
    """``side`` written and, up to BROADCAST_ROWS rows as counted, broadcast: rows of a
    hot host then stay where they are. A larger side is joined by shuffle, which
    can split the rows of a key because the side is a table."""
    held = stage_table(side, "evidence")
    return F.broadcast(held) if held.count() <= BROADCAST_ROWS else held


def fuse(scored: DataFrame, langs: list[str]) -> DataFrame:
    """Add ``lang``, ``posterior`` and ``kept`` to rows with host, domain, declared,
    suffix and scores. Evidence that a row lacks (null) adds nothing; equal
    posteriors go to the first language in order. What a host, domain, declared
    language or suffix says is learned from the other rows: a row's own text
    counts once, as its likelihood."""
    n = len(langs)
    own = F.array(*_normal(F.col("scores"), n))
    soft = scored.select("host", "domain", "declared", "suffix", *[F.get(own, F.lit(k)).alias(f"p{k}") for k in range(n)])
    sums = [F.sum(f"p{k}").alias(f"s{k}") for k in range(n)]
    row = soft.agg(*sums).first()
    total = [(row[f"s{k}"] or 0.0) + 1.0 for k in range(n)]
    corpus = [t / sum(total) for t in total]
    vector = F.array(*[F.col(f"s{k}") for k in range(n)])
    by_host = soft.filter("host is not null").groupBy("host").agg(F.max("domain").alias("domain"), *sums)
    by_domain = by_host.filter("domain is not null").groupBy(F.col("domain").alias("d")).agg(*[F.sum(f"s{k}").alias(f"s{k}") for k in range(n)]).select("d", vector.alias("in_domain"))
    hosts = by_host.select(F.col("host").alias("h"), "domain", vector.alias("at_host")).join(by_domain, F.col("domain") == F.col("d"), "left").select("h", "at_host", "in_domain")

    def told(kind: str) -> DataFrame:
        return soft.filter(F.col(kind).isNotNull()).groupBy(F.col(kind).alias(f"v_{kind}")).agg(*sums).select(f"v_{kind}", vector.alias(f"t_{kind}"))

    sides = {"host": ("h", hosts), "declared": ("v_declared", told("declared")), "suffix": ("v_suffix", told("suffix"))}
    out = scored.withColumn("own", own)
    for kind, (key, side) in sides.items():
        side = _joinable(side)
        out = out.join(side, out[kind] == side[key], "left")
    base = F.array(*map(F.lit, corpus))
    others = lambda c: F.coalesce(F.zip_with(c, F.col("own"), lambda a, b: F.greatest(a - b, F.lit(0.0))), F.array(*[F.lit(0.0)] * n))

    def smooth(counts: Column, towards: Column, pull: float) -> Column:
        """Shares of ``counts`` with ``pull`` rows of the shares ``towards``."""
        return let(counts, lambda c: let(F.aggregate(c, F.lit(pull), lambda s, v: s + v), lambda all_: F.zip_with(c, towards, lambda a, b: (a + pull * b) / all_)))

    out = out.withColumn("prior", smooth(others(F.col("at_host")), smooth(others(F.col("in_domain")), base, DOMAIN_PULL), HOST_PULL))
    for kind in ("declared", "suffix"):
        out = out.withColumn(f"x_{kind}", smooth(others(F.col(f"t_{kind}")), base, PULL))
    # P(value | language) is P(language | value) / P(language), up to a constant
    part = lambda k: [F.get("scores", F.lit(k)), F.log(F.get("prior", F.lit(k))), F.log(F.get("x_declared", F.lit(k)) / corpus[k]), F.log(F.get("x_suffix", F.lit(k)) / corpus[k])]
    joined = out.withColumn("fused", F.array(*[sum(parts[1:], parts[0]) for parts in map(part, range(n))]))
    probs = joined.withColumn("fused", F.array(*_normal(F.col("fused"), n)))
    best = F.array_max("fused")
    return probs.select(
        *[c for c in scored.columns if c != "scores"],
        F.get(F.array(*map(F.lit, langs)), F.array_position("fused", best).cast("int") - 1).alias("lang"),
        F.round(best, 9).alias("posterior"),
        (best >= CONFIDENT).alias("kept"),
    )


def identify(documents: DataFrame, pages: DataFrame) -> DataFrame:
    """Language of every document and every page: doc_id or page_id, host, lang,
    posterior, kept (identified with confidence).

    Documents have no markup and no address; their source stands for the host.
    Null texts are judged by the other evidence alone. The text pass is written
    once; the grouped aggregates and the fusion read its few numbers a row. A
    host with a third of all rows is aggregated before the shuffle; the tables
    of hosts, declared languages and suffixes are broadcast as long as counting
    shows them to be small. Only languages that some document names are given.
    """
    langs, model = train(documents)
    if not langs:
        none = [F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("posterior"), F.lit(True).alias("kept")]
        own = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(None).cast("long").alias("page_id"), F.col("source").alias("host"), *none)
        return own.unionByName(evidence(pages).select("doc_id", "page_id", "host", *none))
    nothing = F.lit(None).cast("string")
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(None).cast("long").alias("page_id"), F.col("source").cast("string").alias("host"), nothing.alias("domain"), nothing.alias("declared"), nothing.alias("suffix"), F.col("text").alias("body"))
    scored = stage_table(text_scores(texts, langs, model, False).unionByName(text_scores(evidence(pages), langs, model, True)), "language-scores")
    return fuse(scored, langs).select("doc_id", "page_id", "host", "lang", "posterior", "kept")
