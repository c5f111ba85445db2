import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from quillforge.llm import textkit as tk
from quillforge.llm.toxicity import COST, Model, fit, maximal_segments, op1_segments, score_toxicity


def brute_segments(scores):
    """The definition: take the best segment, then those left and right of it, and so on; the shortest of equal ones."""
    def go(a, b):
        best = max(((sum(scores[i:j]), -(j - i), -i) for i in range(a, b) for j in range(i + 1, b + 1)), default=None)
        if best is None or best[0] <= 1e-12:
            return []
        i, j = -best[2], -best[2] - best[1]
        return [*go(a, i), (i, j - 1, round(best[0], 6)), *go(j, b)]

    return go(0, len(scores))


def test_maximal_segments_are_those_of_the_definition():
    rng = random.Random(7)
    for _ in range(3000):
        scores = [rng.choice([-COST, -COST, -COST, rng.uniform(0.1, 5)]) for _ in range(rng.randrange(1, 16))]
        up = np.flatnonzero(np.array(scores) > 0)
        got = [(a, b, round(s, 6)) for a, b, s in maximal_segments(up, np.array(scores)[up])]
        assert got == brute_segments(scores), scores


def test_words_and_units():
    data = np.frombuffer("Éa bc9,D  x".encode(), np.uint8)
    words = tk.Words(data, np.array([0, 4, len(data)]), tk.ALNUM)
    assert [bytes(data[a:b]).decode() for a, b in zip(words.start, words.end, strict=True)] == ["Éa", "bc9", "D", "x"]
    assert words.counts.tolist() == [1, 3]
    assert np.all(Model(np.zeros(0, np.uint64), np.zeros(0)).word_scores(words) == -COST)


def corpus(rng, n):
    plain = [f"w{i}" for i in range(300)]
    docs, labels = [], []
    for i in range(n):
        text = [rng.choice(plain) for _ in range(rng.randrange(5, 120))]
        toxic = i % 4 == 0
        if toxic:
            at = rng.randrange(len(text))
            text[at:at] = [rng.choice(["vile", "rotten", "awfulnesses"]) for _ in range(4)]
        docs.append((i, " ".join(text)))
        labels.append((i, int(toxic)))
    return docs, labels


def test_held_out_accuracy_passages_and_defined_results(spark, tmp_path):
    docs, labels = corpus(random.Random(9), 600)
    docs += [(600, None), (601, ""), (3, docs[3][1]), (None, "vile rotten vile rotten"), (602, "vile " * 5000)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels + [(0, 1), (None, 1), (5, None)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = op1_segments(spark, str(tmp_path)).collect()
    assert len(rows) == len(docs)
    truth = dict(labels)
    for r in rows:
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
        assert r.held_out == (zlib.crc32(str(r.doc_id if r.doc_id is not None else "").encode()) % 5 == 0)
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    assert {r.predicted for r in rows if r.doc_id in (600, 601)} == {0}
    frame = spark.read.parquet(f"{tmp_path}/documents.parquet")
    model = fit(frame, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    found = score_toxicity(frame.where("doc_id % 4 = 0").withColumn("start", F.lit(1)), model).where("doc_id < 600").collect()
    inside = sum(any(w in r.text[s.start : s.end] for s in r.tox_segments for w in ("vile", "rotten", "awfulnesses")) for r in found)
    assert inside >= 0.95 * len(found)


def test_empty_tables_and_one_class(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    assert score_toxicity(docs, fit(docs, labels)).first().tox_score < 0.5
    assert score_toxicity(docs.where("false"), fit(docs, labels.where("false"))).count() == 0
