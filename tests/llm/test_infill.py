"""Fill-in-the-middle against plain string slices."""

import hashlib

import duckdb
import pyarrow as pa

from sensorline.llm import infill


def brute(doc_id, text):
    text = text or ""
    d = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(d[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    plain = n == 0 or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90
    form = "plain" if plain else "spm" if h[3] % 100 < 20 else "psm"
    out = {"plain": text, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, n, form, None if plain else a, None if plain else b - a, sha(out), sha(text)), out


NAMES = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
ODD = [None, "", "a", "é\U0001f642" * 30, "has <P> in it", "almost <P <S <M > P>", "< <P", "ab" * 150_000, "\x00 \n"]


def rows_of(spark):
    rows = [(k, t, "x") for k in range(12) for t in ODD] + [(3, "same text", "y")] * 3 + [(None, "no id", None), (None, None, None)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, FORM string")


def test_digests_equal_slices(spark):
    rows, df = rows_of(spark)
    got = infill.digests(df).select(*NAMES).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str(brute(d, t)[0]) for d, t, _ in rows)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert infill.digests(df.limit(0)).collect() == []


def test_outputs_and_their_restoration(spark):
    from pyspark.sql import functions as F

    rows, df = rows_of(spark)
    got = infill.outputs(df).withColumn("text", infill.restore(F.col("output"), F.col("form"))).collect()
    want = [(d, brute(d, t)[0][2], brute(d, t)[1], t or "") for d, t, _ in rows]
    assert sorted(str(tuple(r)) for r in got) == sorted(map(str, want))


def test_marks_across_pieces(monkeypatch):
    """Any size of pieces gives the same digests; stretches are told apart by the marks alone."""
    text = "one <S <<P two \U0001f642 > three " * 9
    for units, batch in ((1, 2), (2, 3), (5, 512), (4096, 1)):
        monkeypatch.setattr(infill, "UNITS", units)
        monkeypatch.setattr(infill, "BATCH", batch)
        for form, a, b in (("psm", 3, 90), ("spm", 0, len(text)), ("psm", len(text), len(text)), ("plain", 1, 2), ("spm", 5, 5)):
            given = pa.RecordBatch.from_pylist([{"row": 7, "text": text, "doc_id": "1", "n": len(text), "form": form, "a": a, "b": b}])

            def resorted(batches):
                rows = [r for x in batches for r in x.to_pylist()]
                return [pa.RecordBatch.from_pylist([r], schema=infill._PIECE) for r in sorted(rows, key=lambda r: (r["row"], r["place"]))]

            out = resorted(infill._cut(iter([given])))
            assert all(len(r.column("body")[0].as_py() or "") <= units + 3 for r in out)
            whole = "".join(r.column("body")[0].as_py() or "" for r in out)
            (made,) = list(infill._restored(iter(resorted(infill._digest(iter(out))))))
            assert made.to_pylist()[0]["restored_sha256"] == hashlib.sha256(text.encode()).hexdigest()
            assert made.to_pylist()[0]["output_sha256"] == hashlib.sha256(whole.encode()).hexdigest()
            p, m, s = text[:a], text[a:b], text[b:]
            assert whole == {"plain": text, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]


def test_query_equals_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    cur = con.execute(infill.ORACLE)
    names = [d[0] for d in cur.description]
    got = infill.digests(spark.read.parquet(f"{sf}/documents.parquet")).select(*names).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, cur.fetchall()))
