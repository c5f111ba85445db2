import math
import random

import numpy as np
from pyspark.sql import functions as F

from quillforge.llm.topk import pack_rows, quantise, top_k, weights_of, weights_packed


def brute(rows, k, every):
    use = {}
    for i, v in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        w = [math.floor(256 * float(x)) for x in v]
        use[i] = min(use.get(i, w), w)
    out = []
    for i, q in use.items():
        if i % every == 0:
            found = sorted((-sum(a * b for a, b in zip(q, w, strict=True)), j) for j, w in use.items() if j != i and len(w) == len(q))
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(found[:k])]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")


def test_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, [rng.choice([-1.0, -0.5, 0.0, 0.25, 0.5]) for _ in range(6)], "x") for i in range(400)]  # many ties
    rows += [(400, None, "x"), (401, [1.0, None], "x"), (402, [float("nan")] * 6, "x"), (403, [float("inf")] * 6, "x"), (None, [1.0] * 6, "x")]
    rows += [(10, rows[10][1], "x"), (404, [1.0], "x"), (405, [], "x"), (406, rows[0][1], "x")]
    got = top_k(frame(spark, rows), is_query=F.col("id") % 5 == 0, range_rows=64, group_rows=16)
    assert sorted(map(tuple, got.collect())) == brute([r[:2] for r in rows], 5, 5)


def test_few_candidates_and_none(spark):
    rows = [(0, [1.0, 2.0], "x"), (1, [1.0, 1.0], "x")]
    got = top_k(frame(spark, rows), is_query=F.col("id") % 50 == 0)
    assert [tuple(r) for r in got.collect()] == [(0, 1, 1, 256 * 256 * 3)]
    assert top_k(frame(spark, rows).where("false"), is_query=F.col("id") % 50 == 0).count() == 0
    big = [(i, [1e6 * (i + 1), 3.0], "x") for i in range(3)]  # beyond exact floating point
    got = top_k(frame(spark, big), is_query=F.col("id") == 0)
    assert sorted(map(tuple, got.collect())) == brute([r[:2] for r in big], 5, 50)


def test_small_weights_are_packed_in_a_byte(spark):
    rng = random.Random(5)
    rows = [(i, [rng.uniform(-0.4, 0.4) for _ in range(64)], "x") for i in range(500)]
    packed = pack_rows(quantise(frame(spark, rows), "vec_id", "embedding").coalesce(1), 4096).collect()
    assert sum(len(r.w) for r in packed) <= 500 * 64 + 8 * 64
    want = {i: [math.floor(256 * float(np.float32(x))) for x in v] for i, v, _ in rows}
    assert {i: v for r in packed for i, v in zip(np.frombuffer(r.ids, np.int64).tolist(), weights_of(r.w, r.n, r.dim).tolist(), strict=True)} == want


def test_weights_of_any_size():
    rng = np.random.default_rng(2)
    ends = np.array([[np.iinfo(np.int64).min, 3], [np.iinfo(np.int64).max, 3], [-1, 3]])
    for w in (ends, np.zeros((4, 0), np.int64), np.full((3, 2), -7), *(rng.integers(-(1 << b), 1 << b, (9, 5)) for b in (0, 7, 8, 15, 40, 62))):
        assert (weights_of(weights_packed(w), *w.shape) == w).all()
