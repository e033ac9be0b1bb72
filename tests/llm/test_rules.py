import collections
import re

from sensorline.llm import rules


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen = collections.defaultdict(list)
    for i in range(len(words) - 7):
        seen[tuple(words[i : i + 8])].append(i)
    covered = {j for at in seen.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_base_features_equal_brute_force(spark, sf):
    odd = [None, "", " \n\t", "a b c d e f g h a b c d e f g h i", "x " * 40, "l\nl\n \nl", "one\x0btwo\x0cthree\r\nfour", "a b c d e f g h " * 2 + "z a b c d e f g h", "w " * 30000]
    docs = spark.createDataFrame([(-k - 1, t) for k, t in enumerate(odd)], "doc_id long, text string").union(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in rules.judge(docs, []).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(texts[r.doc_id]), r.doc_id
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) and r.kept == (not r.base_failed)


def test_learned_rules_hold_on_other_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    learned = rules.learn(docs.filter("doc_id % 2 = 0"), labels.filter("doc_id % 2 = 0"))
    assert learned
    tested = rules.judge(docs, learned).join(labels.filter("doc_id % 2 = 1"), "doc_id").collect()
    good, bad = [r for r in tested if r.quality == 1], [r for r in tested if r.quality == 0]
    assert sum(not r.kept and not r.base_failed for r in good) <= 0.01 * len(good)
    assert sum(not r.kept for r in bad) >= 0.8 * len(bad)


def test_without_labels_and_with_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "word " * 5, 1), (2, " ".join(f"w{k}" for k in range(30)), 2), (2, " ".join(f"w{k}" for k in range(30)), 2)], "doc_id long, text string, Q int")
    labels = spark.createDataFrame([(None, 1), (2, None)], "doc_id long, quality int")
    assert rules.learn(docs, labels) == []
    kept = rules.keep_good(docs, [])
    assert kept.columns == docs.columns and [r.doc_id for r in kept.collect()] == [2, 2]
    assert rules.judge(docs.limit(0), []).count() == 0
