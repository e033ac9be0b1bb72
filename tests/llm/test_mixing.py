import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorline.llm import mixing


def test_rates_meet_targets(spark):
    rows = [(k, 100 + k % 7, [0.9, 0.1] if k % 3 else [0.2, 0.8]) for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, tokens long, p array<double>")
    total = sum(t for _, t, _ in rows)
    for share in (0.8, 0.5):
        rate, reached, steps, _ = mixing.fit_rates(df, [share * total, (1 - share) * total])
        assert reached == pytest.approx([share * total, (1 - share) * total], rel=1e-5) and steps < 30
        assert df.select(F.min(rate)).first()[0] >= 0


def test_targets_out_of_reach_end_at_the_nearest_rates(spark):
    df = spark.createDataFrame([(k, 10, [0.6, 0.4] if k % 2 else [0.4, 0.6]) for k in range(40)], "doc_id long, tokens long, p array<double>")
    rate, reached, *_ = mixing.fit_rates(df, [400.0, 0.0])
    rates = {r.doc_id: r.r for r in df.select("doc_id", rate.alias("r")).collect()}
    assert all(v == 0 for k, v in rates.items() if k % 2 == 0) and all(v > 0 for k, v in rates.items() if k % 2)
    assert reached[0] > 1.4 * reached[1]


def test_totals_equal_brute_force_least_squares(spark):
    """One rate after the other set to its best value, in numpy, until nothing moves."""
    rng = np.random.default_rng(9)
    p = rng.dirichlet([4.0, 1.0, 0.5], 120)
    t = rng.integers(1, 200, 120).astype(float)
    df = spark.createDataFrame([(k, int(a), [float(x) for x in b]) for k, (a, b) in enumerate(zip(t, p))], "doc_id long, tokens long, p array<double>")
    totals, metric = t @ p, np.linalg.inv((p * t[:, None]).T @ p)
    for wanted in (totals * [1.0, 0.2, 0.3], totals * [0.6, 1.2, 0.1], totals * [1.9, 0.9, 1.0]):
        r = np.ones(120)
        for _ in range(500):
            for i in range(120):
                miss = (t * r) @ p - wanted
                r[i] = np.clip(r[i] - (p[i] @ metric @ miss) / (t[i] * (p[i] @ metric @ p[i])), 0, mixing.MOST)
        far = lambda x: math.sqrt((x - wanted) @ metric @ (x - wanted))
        fit = mixing.fit_rates(df, list(wanted))
        assert fit.converged and fit.steps < mixing.MAX_STEPS
        assert far(np.array(fit.reached)) <= 1.05 * far((t * r) @ p) + 1e-3 * far(0 * totals)
        got = np.array([x.r for x in df.select("doc_id", fit.rate.alias("r")).orderBy("doc_id").collect()])
        assert got.min() >= 0 and got.max() <= mixing.MOST and (t * got) @ p == pytest.approx(fit.reached)


def test_the_classifier_tells_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = mixing.fit_classifier(docs, labels.filter("doc_id % 3 <> 0"))
    held = docs.join(labels.filter("doc_id % 3 = 0").dropDuplicates(["doc_id"]), "doc_id")
    got = mixing.domain_members(held, model).join(labels.dropDuplicates(["doc_id"]), "doc_id").select("quality", "toxic", F.get("p", F.lit(0)).alias("clean"), F.get("p", F.lit(1)).alias("foul")).toPandas()
    clean, toxic = got[(got.quality == 1) & (got.toxic == 0)], got[got.toxic == 1]
    assert (clean.clean > 0.5).mean() > 0.97 and (toxic.foul > 0.5).mean() > 0.8


def test_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = mixing.document_rates(docs, labels).cache()
    assert got.count() == docs.count()
    total = got.agg(*[F.sum(F.col("n_tokens") * F.col(f"p_{d}") * F.col("rate")).alias(d) for d, _ in mixing.DOMAINS]).first()
    every = sum(total)
    assert [x / every for x in total] == pytest.approx([mixing.TARGETS[d] for d, _ in mixing.DOMAINS], abs=2e-3)
    judged = got.join(labels, "doc_id")
    clean, toxic = (judged.filter(c).agg(F.avg("rate")).first()[0] for c in ("quality = 1 and toxic = 0", "toxic = 1"))
    assert clean > 0.95 and toxic < 0.5
    drawn = mixing.resample(docs, labels)
    assert drawn.columns == docs.columns
    assert {r.doc_id for r in drawn.select("doc_id").collect()} == {r.doc_id for r in got.filter("copies > 0").select("doc_id").collect()}


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, "good words here", 1), (1, "good words here", 1), (2, None, 2), (None, "", 3)], "doc_id long, text string, TOKENS int")
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, None), (None, 0, 0), (3, None, None)], "doc_id long, quality int, toxic int")
    got = mixing.document_rates(docs, labels).collect()
    assert len(got) == 4 and all(r.rate >= 0 for r in got) and sorted(r.n_tokens for r in got) == [0, 0, 3, 3]
    assert mixing.resample(docs, labels).columns == docs.columns
    assert mixing.document_rates(docs.limit(0), labels.limit(0)).count() == 0


def test_scarce_domains_leave_clean_documents(spark):
    schema = "doc_id long, text string"
    for junk in (1, 0):
        texts = ["plain words of a clean page"] * 865 + ["nasty words of a foul page"] * 134 + ["### $$$ %%% @@@ junk"] * junk
        docs = spark.createDataFrame(list(enumerate(texts)), schema)
        labels = spark.createDataFrame([(k, int(k < 999), int(865 <= k < 999)) for k in range(len(texts))], "doc_id long, quality int, toxic int")
        got = {r.doc_id: r for r in mixing.document_rates(docs, labels).collect()}
        assert all(got[k].copies >= 1 for k in range(865)) and all(r.rate < 1.2 for r in got.values())
        assert sum(got[k].copies for k in range(865, 999)) < 40 and all(got[k].copies >= 1 for k in range(999, len(texts)))


def test_domains_below_their_share_are_reached():
    assert mixing.token_targets([865.0, 134.0, 1.0], [0.97, 0.02, 0.01]) == [865.0, pytest.approx(865 * 0.02 / 0.97), None]
    assert mixing.token_targets([0.0, 0.0, 0.0], [0.97, 0.02, 0.01]) == [None] * 3


@pytest.mark.parametrize("wanted", [[60_000.0, 1_200.0, 600.0], [9_000.0, 30_000.0, 100.0], [200_000.0, 1.0, 1.0]])
def test_posteriors_of_few_directions_end_at_plain_least_squares(spark, caplog, wanted):
    """Two distinct posteriors over three domains: no rates meet the targets, and the fit says so."""
    p = np.array([[0.801, 0.141, 0.058] if k % 10 else [0.1, 0.2, 0.7] for k in range(200)])
    t = np.array([100.0 + 40 * (k % 13) for k in range(200)])
    df = spark.createDataFrame([(k, int(a), [float(x) for x in b]) for k, (a, b) in enumerate(zip(t, p))], "doc_id long, tokens long, p array<double>")
    r, top = np.ones(200), np.linalg.eigvalsh((p * t[:, None]).T @ p)[-1]
    for _ in range(5000):
        r = np.clip(r - p @ ((t * r) @ p - wanted) / top, 0, mixing.MOST)
    best = np.linalg.norm((t * r) @ p - wanted)
    fit = mixing.fit_rates(df, wanted)
    assert not fit.converged and "miss their targets" in caplog.text
    assert math.dist(fit.reached, wanted) <= 1.002 * best < math.dist(t @ p, wanted)


def test_equal_weights_of_domains_and_long_texts(spark):
    """Ties between domains and texts of over a million characters are worked out like any other."""
    texts = ["word " * 300_000, "word " * 300_000, None, "", "other"]
    docs = spark.createDataFrame([(k % 4, x) for k, x in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(0, 1, 0), (1, 0, 0), (2, 1, 1), (3, 1, 0)], "doc_id long, quality int, toxic int")
    got = mixing.document_rates(docs, labels).collect()
    assert len(got) == 5 and sorted(r.n_tokens for r in got) == [0, 0, 1, 300_000, 300_000] and all(0 <= r.rate <= mixing.MOST for r in got)
