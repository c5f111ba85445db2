"""Exact top-k inner products by block-at-a-time pruning.

Vectors of small integers are terms with signed weights.  Candidates stand in
ranges of rows, ranges in blocks; a block has a forward index (its weights,
row by row) and the largest and smallest weight of each term.  For each query,
blocks are taken in the order of their summed term maxima, an upper bound of
any score in them, and scored through the forward index until the bound falls
below the query's k-th score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillforge.llm.shared import small_batches

#: Candidates of a range (a row of packed data), candidates of a block, queries of a group.
RANGE, BLOCK, GROUP = 1 << 12, 256, 1 << 11
#: Candidates for each query, for the shape of the grid of tasks.
QUERY_SHARE = 50
#: Below any score, and its negative is a number too.
_NONE = np.iinfo(np.int64).min + 1


def quantise(embeddings: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id and floor(256 * x) of each component; a vector that is null or holds a null or non-finite component takes no part.
    Rows with the same id count once, with the smallest vector; rows with a null id take no part."""
    x = F.col(vector_col)
    usable = x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    ints = F.transform(x, lambda v: F.floor(v.cast("double") * 256))
    return embeddings.where(usable & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), ints.alias("v")).groupBy("id").agg(F.min("v").alias("v"))


def pack_rows(vectors: DataFrame, rows: int) -> DataFrame:
    """Rows of up to `rows` vectors each: n, dimension, ids as little-endian 64-bit integers and weights as of weights_packed()."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list] = {}
        for frame in frames:
            for i, v in zip(frame["id"], frame["v"], strict=True):
                ids, vs = held.setdefault(len(v), ([], []))
                ids.append(i), vs.append(v)
                if len(ids) == rows:
                    yield _packed(len(v), *held.pop(len(v)))
        for dim, (ids, vs) in held.items():
            yield _packed(dim, ids, vs)

    return vectors.mapInPandas(run, "dim int, n int, ids binary, w binary")


def _packed(dim: int, ids: list, vs: list) -> pd.DataFrame:
    w = np.array(vs, np.int64).reshape(len(ids), dim)
    return pd.DataFrame({"dim": [dim], "n": [len(ids)], "ids": [np.array(ids, np.int64).tobytes()], "w": [weights_packed(w)]})


def weights_packed(w: np.ndarray) -> bytes:
    """The least weight of each term, then what the weights are above it: their lowest bytes, their second lowest and so on, as far as any
    isn't 0.  Copies of these rows are most of what is shuffled, and small weights take one byte and not eight."""
    if not w.size:
        return b""
    low = w.min(axis=0)
    planes = (w - low).astype("<i8").view(np.uint8).reshape(-1, 8).T
    used = np.flatnonzero(planes.any(axis=1))
    return low.astype("<i8").tobytes() + planes[: used[-1] + 1 if len(used) else 0].tobytes()


def weights_of(raw: bytes, n: int, dim: int) -> np.ndarray:
    if not n * dim:
        return np.zeros((n, dim), np.int64)
    planes = np.frombuffer(raw, np.uint8, offset=8 * dim).reshape(-1, n * dim)
    above = np.zeros((n * dim, 8), np.uint8)
    above[:, : len(planes)] = planes.T
    return above.view("<i8").reshape(n, dim) + np.frombuffer(raw, "<i8", dim)


class Range:
    """Candidates in blocks, neighbours by their strongest terms, with each block's term maxima and minima."""

    def __init__(self, ids: np.ndarray, w: np.ndarray, block: int = BLOCK):
        order = np.lexsort([*(w[:, j] for j in range(w.shape[1] - 1, -1, -1)[-3:]), np.argmax(np.abs(w), axis=1) if w.shape[1] else ids]) if w.shape[1] else np.argsort(ids)
        self.ids, self.w = ids[order], w[order]
        self.first = np.arange(0, len(ids), block)
        self.last = np.minimum(self.first + block, len(ids))
        self.high = np.maximum.reduceat(self.w, self.first, axis=0) if w.shape[1] else np.zeros((len(self.first), 0), np.int64)
        self.low = np.minimum.reduceat(self.w, self.first, axis=0) if w.shape[1] else self.high


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer a @ b.T, through floating point where all sums fit it."""
    if not a.shape[1]:
        return np.zeros((len(a), len(b)), np.int64)
    largest = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64) if largest < 2**52 else a @ b.T


class Best:
    """The k best (score, id) of each query so far, higher scores first, ties to smaller ids."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.score = np.full((queries, k), _NONE)
        self.id = np.full((queries, k), np.iinfo(np.int64).max)

    def add(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray, own: np.ndarray) -> None:
        scores = np.where(ids[None, :] == own[:, None], _NONE, scores)
        ids = np.where(scores == _NONE, np.iinfo(np.int64).max, ids[None, :])
        s, i = np.concatenate([self.score[rows], scores], axis=1), np.concatenate([self.id[rows], ids], axis=1)
        if s.shape[1] > 4 * self.k:  # all that reach the k-th score, ties included, are among the ranked
            kth = np.partition(s, s.shape[1] - self.k, axis=1)[:, s.shape[1] - self.k]
            width = max(self.k, int((s >= kth[:, None]).sum(axis=1).max()))
            near = np.argpartition(-s, min(width, s.shape[1]) - 1, axis=1)[:, :width]
            s, i = np.take_along_axis(s, near, 1), np.take_along_axis(i, near, 1)
        order = np.lexsort((i, -s), axis=1)[:, : self.k]
        self.score[rows], self.id[rows] = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)


def search(r: Range, ids: np.ndarray, q: np.ndarray, k: int) -> Best:
    best = Best(len(ids), k)
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    bound = product(up, r.high) + product(down, r.low)
    order = np.argsort(-bound, axis=1, kind="stable")
    active = np.arange(len(ids))
    for step in range(len(r.first)):
        at = order[active, step]
        active = active[bound[active, at] >= best.score[active, k - 1]]
        if not len(active):
            break
        at = order[active, step]
        by = np.argsort(at, kind="stable")
        edges = np.flatnonzero(np.diff(at[by])) + 1
        for rows in np.split(active[by], edges):
            b = order[rows[0], step]
            span = slice(r.first[b], r.last[b])
            best.add(rows, product(q[rows], r.w[span]), r.ids[span], ids[rows])
    return best


def top_k(embeddings: DataFrame, *, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", is_query, range_rows: int = RANGE, group_rows: int = GROUP) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k candidates of highest integer inner product for each query.

    Candidates are all usable rows (see quantise()) of the query's length but its own; ties go to smaller ids; with fewer candidates
    all are given.  is_query is a column over `id`.  Query groups and candidate ranges are packed rows that meet one by one, so no
    task holds more than a group and a range, and each pair gives k rows for each query.
    """
    spark = embeddings.sparkSession
    small_batches(spark)
    vectors = quantise(embeddings, id_col, vector_col)
    tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    columns = min(tasks, max(1, round((tasks * QUERY_SHARE) ** 0.5)))  # of the grid of tasks: sends the fewest bytes for that many
    lines = -(-tasks // columns)
    ranges = pack_rows(vectors, range_rows).select("dim", F.col("n").alias("c_n"), F.col("ids").alias("c_ids"), F.col("w").alias("c_w"))
    ranges = ranges.select("*", F.pmod(F.xxhash64("c_ids"), F.lit(columns)).cast("int").alias("x"), F.explode(F.sequence(F.lit(0), F.lit(lines - 1))).alias("y"))
    groups = pack_rows(vectors.where(is_query), group_rows)
    groups = groups.select("*", F.explode(F.sequence(F.lit(0), F.lit(columns - 1))).alias("x"), F.pmod(F.xxhash64("ids"), F.lit(lines)).cast("int").alias("y"))

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = (None, None)
        for frame in frames:
            for row in frame.itertuples(index=False):
                if held[0] != row.c_ids:
                    held = (row.c_ids, Range(np.frombuffer(row.c_ids, np.int64), weights_of(row.c_w, row.c_n, row.dim)))
                ids = np.frombuffer(row.ids, np.int64)
                best = search(held[1], ids, weights_of(row.w, row.n, row.dim), k)
                real = best.id.ravel() != np.iinfo(np.int64).max
                yield pd.DataFrame({"query_id": np.repeat(ids, k)[real], "vec_id": best.id.ravel()[real], "score": best.score.ravel()[real]})

    pairs = ranges.join(groups, ["dim", "x", "y"])  # in this order a range meets its groups one after the other, and is indexed once
    found = pairs.mapInPandas(score, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_block_top_k(spark, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), is_query=F.col("id") % 50 == 0)


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(range(1, 1 + len(c.w)), lambda i: q.w[i] * c.w[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 5
"""
