import random

from pyspark.sql import functions as F

from quillforge.llm.quality import judge_quality, op9_empirical_bayes, remove_rejected, site_rates


def corpus(rng, n):
    docs, labels = [], []
    for i in range(n):
        good = rng.random() < 0.8
        words = [f"w{rng.randrange(400)}" if good else rng.choice(["buy|", "$$now", "x%%", "###"]) for _ in range(rng.randrange(6, 80))]
        docs.append((i, " ".join(words), rng.choice(["en", "de"]), f"s{i % 7}"))
        labels.append((i, int(good)))
    return docs, labels


SCHEMA = "doc_id long, text string, lang string, source string"


def test_held_out_accuracy_and_defined_results(spark, tmp_path):
    docs, labels = corpus(random.Random(1), 800)
    docs += [(800, None, None, None), (801, "", "en", "s1"), (5, docs[5][1], "en", "s1"), (None, "w1 w2 w3 w4 w5 w6 w7", "en", "new"), (802, "w1 w2 " * 9000, "en", "s1")]
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels + [(0, labels[0][1]), (None, 1), (7, None)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = op9_empirical_bayes(spark, str(tmp_path)).collect()
    truth = dict(labels)
    assert len(rows) == len(docs) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert len(held) > 50 and sum(r.predicted == truth[r.doc_id] for r in held) >= 0.98 * len(held)
    frame = spark.read.parquet(f"{tmp_path}/documents.parquet").withColumn("q_score", F.lit(1)).withColumn("_label", F.lit("x"))
    kept = remove_rejected(frame.drop("q_score"), spark.read.parquet(f"{tmp_path}/labels.parquet"))
    assert kept.columns == ["doc_id", "text", "lang", "source", "_label"]
    assert abs(kept.count() - sum(g for _, g in labels)) < 30


def test_sites_shrink_towards_their_parents(spark):
    rows = [("a", "x", 1)] * 40 + [("a", "y", 0)] * 40 + [("b", "x", 1)] * 40 + [("b", "z", 0)] + [("c", "x", 0)] * 40
    tables, top = site_rates(spark.createDataFrame(rows, "l0 string, l1 string, _label int"), ["l0", "l1"])
    host = {r.l0: r.rate for r in tables[0].collect()}
    path = {(r.l0, r.l1): r.rate for r in tables[1].collect()}
    assert host["c"] < host["a"] < host["b"] and 0.4 < top < 0.6
    assert path["a", "y"] < host["a"] < path["a", "x"]
    assert host["b"] > path["b", "z"] > path["a", "y"]  # one label moves less than forty


def test_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "some text", "en", "s")], SCHEMA)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert judge_quality(docs, none).first().q_score == 0.5
    assert judge_quality(docs.where("false"), none).count() == 0
    one = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert judge_quality(docs, one).first().q_kept
