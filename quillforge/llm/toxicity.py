"""Toxic passages by maximal scoring segments of token log-odds.

Training counts, for units (words and the byte 6-grams inside them), in how
many toxic and other documents they occur, and keeps those whose log-odds with
a Dirichlet prior stand out.  A word scores the log-odds of its strongest unit
less a constant, so ordinary text scores below zero; one linear scan finds all
maximal scoring segments of a text.  Under such scores the best segment of
unremarkable text follows an extreme-value law, which turns a segment's score
and the text's length into a significance; a logistic curve over those of a
text gives its score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillforge.llm import textkit as tk

GRAM = 6
#: Labelled rows that the model is fitted on, chosen by the hash of their id, and units that it keeps, by significance.
TRAIN_ROWS, UNITS = 40_000, 1 << 15
#: Weight of the prior, in units of the whole corpus' counts; least deviation of a unit; what each word costs; largest log-odds.
PRIOR, LEAST_Z, COST, MOST = 0.02, 3.0, 1.0, 6.0
#: Chance from which a segment is reported.
SIGNIFICANT = 0.05


@dataclass
class Model:
    units: np.ndarray  # sorted
    weight: np.ndarray
    scale: float = 1.0  # lambda and log K of the extreme-value law
    log_k: float = 0.0
    curve: tuple[float, ...] = (0.0,)

    def word_scores(self, words: tk.Words) -> np.ndarray:
        """Log-odds of each word's strongest unit, at least 0, less COST."""
        best = self._look(words.hash)
        at, owner = _gram_places(words)
        if len(at) and len(self.units):
            c = tk.prefix_hash(words.data, True)
            np.maximum.at(best, owner, self._look(tk.span_hash(c, at, at + GRAM)))
        return best - COST

    def _look(self, h: np.ndarray) -> np.ndarray:
        if not len(self.units):
            return np.zeros(len(h))
        at = np.minimum(np.searchsorted(self.units, h), len(self.units) - 1)
        return np.where(self.units[at] == h, self.weight[at], 0.0)

    def strength(self, score: np.ndarray | float, n: np.ndarray | float) -> np.ndarray | float:
        """lambda S - log(K n): its exponential is one over the expected number of such segments in n words of ordinary text."""
        return self.scale * score - self.log_k - np.log(np.maximum(n, 1))

    def features(self, segments: list[tuple[int, int, float]], n: int) -> tuple[float, float, float]:
        if not segments:
            return 0.0, 0.0, 1.0
        s = self.strength(np.array([x[2] for x in segments]), n)
        return float(np.clip(s.max() + 5, 0, 40)), float(np.log1p(np.maximum(s, 0).sum())), 0.0

    def probability(self, x: np.ndarray) -> np.ndarray:
        z = np.column_stack([x, np.ones(len(x))]) @ np.array(self.curve) if len(self.curve) > 1 else np.full(len(x), self.curve[0])
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _gram_places(words: tk.Words) -> tuple[np.ndarray, np.ndarray]:
    counts = np.maximum(words.end - words.start - GRAM, 0)  # a word of GRAM bytes is its own only gram
    counts = np.where(counts > 0, counts + 1, 0)
    return tk.within(words.start, counts), np.repeat(np.arange(len(counts)), counts)


def maximal_segments(place: np.ndarray, score: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first word, last word, sum) of a text, in linear time.

    place and score are the words that score above zero; each word between costs COST.
    """
    found: list[list[float]] = []  # first, last, sum before, sum after
    total, last = 0.0, None
    for p, s in zip(place.tolist(), score.tolist(), strict=True):
        if last is not None:
            total -= COST * (p - last - 1)
        item = [p, p, total, total + s]
        total, last = total + s, p
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= item[2]:
                j = _left(found, j)
            if j < 0 or found[j][3] >= item[3]:
                item.append(j)
                found.append(item)
                break
            item = [found[j][0], item[1], found[j][2], item[3]]
            del found[j:]
    return [(int(a), int(b), r - l) for a, b, l, r, _ in found]


def _left(found: list[list[float]], j: int) -> int:
    """The nearest segment before j whose left sum is smaller than j's: where its own search ended."""
    return int(found[j][4])


def _scan(model: Model, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, tk.Words, list[tuple[int, int, float]]]]:
    """(document, words, segments with words counted from the document's first)."""
    words = tk.Words(data, offsets, tk.ALNUM)
    score = model.word_scores(words)
    up = np.flatnonzero(score > 0)
    edges = np.searchsorted(up, words.first)
    for d in range(len(offsets) - 1):
        a, b = edges[d], edges[d + 1]
        yield d, words, maximal_segments(up[a:b] - words.first[d], score[up[a:b]]) if a < b else []


def sample_labels(labels: DataFrame, id_col: str, label_col: str, rows: int) -> DataFrame:
    """At most `rows` labelled ids, the same for the same table: bounded, so that it can be broadcast."""
    pairs = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).select(F.col(id_col).alias("_key"), F.col(label_col).cast("int").alias("_label"))
    return pairs.groupBy("_key").agg(F.max("_label").alias("_label")).orderBy(F.xxhash64("_key"), "_key").limit(rows)


def _count_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = tk.text_buffers(batch.column("text"))
        label = np.array(batch.column("_label").to_pylist(), np.int64)
        for i, j in tk.chunks(offsets):
            o = offsets[i : j + 1]
            words = tk.Words(data[o[0] : o[-1]], o - o[0], tk.ALNUM)
            at, owner = _gram_places(words)
            doc = words.doc()
            unit = np.concatenate([words.hash, tk.span_hash(tk.prefix_hash(words.data, True), at, at + GRAM)])
            doc = np.concatenate([doc, doc[owner]])
            order = np.lexsort((doc, unit))
            unit, doc = unit[order], doc[order]
            first = np.ones(len(unit), bool)
            first[1:] = (unit[1:] != unit[:-1]) | (doc[1:] != doc[:-1])
            unit, one = unit[first], label[i:j][doc[first]]
            names, at = np.unique(unit, return_inverse=True)
            bad = np.bincount(at, one, len(names)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(bad), pa.array(np.bincount(at, minlength=len(names)) - bad)], names=["unit", "bad", "good"])


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", train_rows: int = TRAIN_ROWS, units: int = UNITS) -> Model:
    """Fitted on at most train_rows of the labelled documents; the caller leaves out those that it holds back."""
    chosen = F.broadcast(sample_labels(labels, id_col, label_col, train_rows))
    rows = docs.select(F.col(id_col).alias("_key"), F.col(text_col).alias("text")).join(chosen, "_key").select("text", "_label")
    counts = rows.mapInArrow(_count_units, "unit long, bad long, good long").groupBy("unit").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    n = rows.groupBy("_label").count().collect()
    n_bad, n_good = (sum(r["count"] for r in n if bool(r["_label"]) == x) for x in (True, False))
    if not n_bad or not n_good:
        return Model(np.zeros(0, np.uint64), np.zeros(0), curve=(30.0 if n_bad else -30.0,))
    prior = PRIOR * (F.col("bad") + F.col("good")) + 0.01
    odds = lambda y, m: F.log((y + prior) / (F.lit(float(m)) * (1 + PRIOR) + 1 - y - prior))
    delta = odds(F.col("bad"), n_bad) - odds(F.col("good"), n_good)
    z = delta / F.sqrt(1 / (F.col("bad") + prior) + 1 / (F.col("good") + prior))
    smoothed = F.log((F.col("bad") + 0.5) / (n_bad + 1)) - F.log((F.col("good") + 0.5) / (n_good + 1))
    kept = counts.where("bad >= 3").select("unit", "bad", "good", F.least(delta, smoothed).alias("w"), z.alias("z")).where((F.col("z") > LEAST_Z) & (F.col("w") > COST)).orderBy(F.desc("z"), "unit").limit(units).collect()
    hashes = np.array([r.unit for r in kept], np.int64).view(np.uint64)
    order = np.argsort(hashes)
    model = Model(hashes[order], np.minimum(np.array([r.w for r in kept], float), MOST)[order])
    found = rows.mapInArrow(_measure(model), "label int, n long, scores array<double>").collect()  # at most train_rows short rows
    calibrate(model, [(r.label, r.n, r.scores) for r in found])
    return model


def _measure(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tk.text_buffers(batch.column("text"))
            n, scores = [], []
            for i, j in tk.chunks(offsets):
                o = offsets[i : j + 1]
                for d, words, segments in _scan(model, data[o[0] : o[-1]], o - o[0]):
                    n.append(int(words.counts[d]))
                    scores.append([s for _, _, s in segments])
            yield pa.RecordBatch.from_arrays([batch.column("_label").cast(pa.int32()), pa.array(n, pa.int64()), pa.array(scores, pa.list_(pa.float64()))], names=["label", "n", "scores"])

    return run


def calibrate(model: Model, found: list[tuple[int, int, list[float]]]) -> None:
    """lambda and K from the segments of documents that aren't toxic, then the curve from all."""
    clean = [(max(n, 1), s) for label, n, s in found if not label]
    total = sum(n for n, _ in clean)
    sums = np.array([x for _, s in clean for x in s])
    # the tail of segment scores falls off as exp(-lambda S): the mean excess over the least gives lambda, their number K
    base = float(np.median(sums)) if len(sums) else 0.0
    over = sums[sums >= base] if len(sums) else sums
    model.scale = float(np.clip((len(over) + 1) / (np.sum(over - base) + 1.0), 0.2, 3.0))
    model.log_k = float(np.log((len(over) + 0.5) / max(total, 1)) + model.scale * base)
    x = np.array([model.features([(0, 0, v) for v in s], n) for _, n, s in found]).reshape(len(found), 3)
    model.curve = logistic(x, np.array([bool(label) for label, _, _ in found], float))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 50) -> tuple[float, ...]:
    """Weights and, last, the constant of a logistic regression, by Newton's method."""
    a = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(a.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (p - y) + ridge * w
        h = (a * (p * (1 - p) + 1e-9)[:, None]).T @ a + ridge * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(w.tolist())


def score_toxicity(docs: DataFrame, model: Model, *, text_col: str = "text", prefix: str = "tox_") -> DataFrame:
    """docs and, named with `prefix`: score, from 0 to 1, and segments, the significant passages as (start, end, score, p) in
    characters, end exclusive, with p the chance of one so good in ordinary text of that length.

    A null or empty text has no words, and scores as the texts of the training rows without any segment do.  Rows stay as they are;
    columns that begin with `prefix` are replaced.
    """
    docs = docs.select(*[f"`{c}`" for c in docs.columns if not c.startswith(prefix)])
    names = [f"{prefix}score", f"{prefix}segments"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields), f"`{names[0]}` double", f"`{names[1]}` array<struct<start:int,end:int,score:double,p:double>>"])
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("p", pa.float64())]))
    held = docs.sparkSession.sparkContext.broadcast(model)  # at most UNITS units

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            data, offsets = tk.text_buffers(batch.column(text_col))
            for i, j in tk.chunks(offsets):
                o = offsets[i : j + 1]
                x, passages = [], []
                for d, words, segments in _scan(m, data[o[0] : o[-1]], o - o[0]):
                    x.append(m.features(segments, int(words.counts[d])))
                    passages.append(_passages(m, words, d, segments) if segments else [])
                part = batch.slice(i, j - i)
                p = m.probability(np.array(x).reshape(len(x), 3))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(p), pa.array(passages, kind)], names=[*part.schema.names, *names])

    return docs.mapInArrow(run, schema)


def _passages(m: Model, words: tk.Words, d: int, segments: list[tuple[int, int, float]]) -> list[dict]:
    n = int(words.counts[d])
    chance = -np.expm1(-np.exp(-np.clip(m.strength(np.array([s for _, _, s in segments]), n), -30, 500)))
    out, chars = [], None
    for (a, b, s), p in zip(segments, chance.tolist(), strict=True):
        if p <= SIGNIFICANT:
            if chars is None:
                begin = int(words.offsets[d])
                chars = np.concatenate([[0], np.cumsum((words.data[begin : words.offsets[d + 1]] & 0xC0) != 0x80)])
            first = words.first[d]
            out.append({"start": int(chars[words.start[first + a] - begin]), "end": int(chars[words.end[first + b] - begin]), "score": s, "p": p})
    return out


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def op1_segments(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out())
    scored = score_toxicity(docs, fit(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), F.col("tox_score").alias("score"), (F.col("tox_score") >= 0.5).cast("int").alias("predicted"), F.size("tox_segments").alias("n_segments"))
