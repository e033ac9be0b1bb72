import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from sensorline.llm import rules
from sensorline.llm.common import stage_table, table

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = table(spark, SF, "documents"), []
    for name, stage in pipeline.STAGES:
        before, docs = docs, stage_table(stage(spark, docs, SF), name)
        out.append((name, before, docs))
    return {name: (a, b) for name, a, b in out}


def test_stages_keep_the_columns_of_documents(spark, stages):
    columns = table(spark, SF, "documents").columns
    assert [n for n, _ in pipeline.STAGES] == list(stages)
    assert all(b.columns == columns for n, (_, b) in stages.items() if n != "bpe_encoding")
    assert stages["bpe_encoding"][1].columns == ["doc_id", "lang", "source", "ids", "n_tokens"]


def test_decisions_take_effect(spark, stages):
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    a, b = stages["quality_rules"]
    judged = rules.judge(a, rules.learn(a, table(spark, SF, "labels")))
    assert ids(b) == ids(judged.filter("kept"))
    a, b = stages["minhash_near_dedup"]
    assert ids(b) < ids(a) and b.count() == b.select("text").distinct().count()
    a, b = stages["secret_scans"]
    assert ids(a) == ids(b) and b.filter("text rlike 'token = \"[0-9a-f]{40}'").count() == 0
    assert b.filter("text like '%[assign]%'").count() > 0
    a, b = stages["mixing_weights"]
    clean = table(spark, SF, "labels").filter("quality = 1 and toxic = 0").select("doc_id")
    assert ids(b) <= ids(a) and len(ids(b.join(clean, "doc_id"))) >= 0.97 * len(ids(a.join(clean, "doc_id")))
    a, b = stages["bpe_encoding"]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {r.doc_id: list(r.ids) for r in b.collect()}
    assert all(got[r.doc_id] == tokenizer.encode(r.text, add_special_tokens=False).ids for r in a.limit(100).collect())
