"""Quality of documents by hierarchical empirical Bayes.

A logistic curve over the shape of a text gives its own evidence.  Labels are
counted for each site level, such as host, then path within the host; a level's
posterior rate is its counts drawn towards the rate of the level above, the
more the sparser they are, with a strength estimated from how much the rates at
that level differ.  The log-odds of text and site add up.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillforge.llm import textkit as tk
from quillforge.llm.shared import cut
from quillforge.llm.toxicity import held_out, logistic, sample_labels

#: Labelled rows that the curve over texts is fitted on, chosen by the hash of their id.
TRAIN_ROWS = 40_000
#: Site tables up to so many rows are broadcast; larger ones are joined by shuffling.
BROADCAST_SITES = 50_000
#: Bounds of the pseudo-counts that a level's differences may suggest.
STRENGTH = (2.0, 1000.0)
#: A document is kept from this posterior probability of good quality.
KEEP = 0.5

_SPACE, _LETTER_DIGIT = 1, 2
_CLASS = np.zeros(256, np.uint8)
_CLASS[[32, 9, 10, 11, 12, 13]] = _SPACE
_CLASS[tk.ALNUM] = _LETTER_DIGIT
_PLAIN = np.zeros(256, bool)
_PLAIN[list(b".,;:!?'\"()-")] = True


def text_features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row for each document: the log of its words; shares of symbols, digits and words with symbols; repetition of words, by the
    share of distinct ones (for long texts, over what their length lets expect) and of words equal to the one before; mean word length."""
    n = len(offsets) - 1
    words = tk.Words(data, offsets, tk.NONSPACE)
    count = words.counts
    doc = words.doc()
    symbol = (_CLASS[data] == 0) & ~_PLAIN[data]
    sums = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[offsets])
    used = np.maximum(sums(_CLASS[data] != _SPACE), 1)
    until = np.concatenate([[0], np.cumsum(symbol)])
    odd = (until[words.end] - until[words.start]) > 0
    per = lambda flags: np.bincount(doc, flags, n) / np.maximum(count, 1)
    again = np.zeros(len(doc), bool)
    if len(doc):
        again[1:] = (words.hash[1:] == words.hash[:-1]) & (doc[1:] == doc[:-1])
    order = np.lexsort((words.hash, doc))
    h, d = words.hash[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    distinct = np.bincount(d[new], minlength=n)
    run = np.diff(np.append(np.flatnonzero(new), len(h)))
    top = np.zeros(n)
    np.maximum.at(top, d[new], run)
    return np.column_stack([
        np.log1p(count), sums(symbol) / used, sums((data >= 48) & (data <= 57)) / used, per(odd), distinct / np.maximum(count, 1),
        np.minimum(distinct / np.sqrt(np.maximum(count, 1)), 8), per(again), top / np.maximum(count, 1), np.log1p(used / np.maximum(count, 1)), count == 0, np.minimum(count, 3) == 1,
    ]).astype(np.float64)


N_FEATURES = 11


@dataclass
class TextModel:
    mean: np.ndarray
    spread: np.ndarray
    weights: tuple[float, ...]

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.spread
        return np.clip(np.column_stack([z, np.ones(len(z))]) @ np.array(self.weights), -20, 20)


def fit_text(docs: DataFrame, labels: DataFrame, *, id_col: str, text_col: str, label_col: str, train_rows: int) -> TextModel:
    chosen = F.broadcast(sample_labels(labels, id_col, label_col, train_rows))
    rows = docs.select(F.col(id_col).alias("_key"), F.col(text_col).alias("text")).join(chosen, "_key").select("text", "_label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch_features(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("_label").cast(pa.int32()), pa.array(list(x), pa.list_(pa.float64()))], names=["label", "x"])

    found = rows.mapInArrow(run, "label int, x array<double>").collect()  # at most train_rows short rows
    y = np.array([r.label for r in found], float)
    x = np.array([r.x for r in found], float).reshape(len(found), N_FEATURES)
    if not len(y) or y.min() == y.max():
        return TextModel(np.zeros(N_FEATURES), np.ones(N_FEATURES), (*[0.0] * N_FEATURES, 0.0))
    order = np.lexsort([y, *x.T])
    x, y = x[order], y[order]
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-6
    return TextModel(mean, spread, logistic((x - mean) / spread, y, ridge=1.0))


def batch_features(column) -> np.ndarray:
    data, offsets = tk.text_buffers(column)
    out = [np.zeros((0, N_FEATURES))]
    for i, j in tk.chunks(offsets):
        o = offsets[i : j + 1]
        out.append(text_features(data[o[0] : o[-1]], o - o[0]))
    return np.concatenate(out)


def site_rates(labelled: DataFrame, levels: list[str]) -> tuple[list[DataFrame], float]:
    """labelled: the level columns and _label.  For each level, from the top, a table of its keys and rate; and the global rate.

    Beta posteriors: rate = (good + s * above) / (n + s), where s is the level's strength by the method of moments: the less the
    rates differ beyond chance, the larger.
    """
    total = labelled.agg(F.sum("_label").alias("good"), F.count("_label").alias("n")).first()
    top = ((total.good or 0) + 1) / (total.n + 2)
    above, tables = None, []
    for k in range(1, len(levels) + 1):
        keys = levels[:k]
        counts = labelled.groupBy(*keys).agg(F.sum("_label").alias("good"), F.count("_label").alias("n"))
        counts = counts.withColumn("up", F.lit(top)) if above is None else counts.join(above.withColumnRenamed("rate", "up"), keys[:-1])
        counts = cut(counts)
        r = counts.where("n > 1").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.count(F.lit(1)).alias("m"), F.sum((F.col("good") / F.col("n") - F.col("up")) ** 2 * F.col("n")).alias("ss")).first()
        strength = STRENGTH[1]
        if r.m and r.m > 1:
            chance = top * (1 - top)
            spare = r.n - r.nn / r.n
            between = (r.ss - r.m * chance) / max(spare, 1e-9)
            strength = float(np.clip(chance / between - 1 if between > 0 else STRENGTH[1], *STRENGTH))
        above = counts.select(*keys, ((F.col("good") + strength * F.col("up")) / (F.col("n") + strength)).alias("rate"))
        tables.append(above)
    return tables, top


def judge_quality(docs: DataFrame, labels: DataFrame, *, levels: list[Column] | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", train_rows: int = TRAIN_ROWS, keep: float = KEEP, prefix: str = "q_") -> DataFrame:
    """docs and, named with `prefix`: text_log_odds, site_rate, score (posterior probability of good quality), kept (score >= keep).

    levels: columns of docs from the widest site level down, by default source, then source and lang; null keys are a site of their
    own, and a site without labels has the rate of the level above it.  Labels with a null id or value take no part; of several for
    an id the highest counts.  Null and empty texts have no words.  Rows stay as they are; columns that begin with `prefix` are replaced.
    """
    docs = docs.select(*[f"`{c}`" for c in docs.columns if not c.startswith(prefix)])
    levels = levels if levels is not None else [F.col("source"), F.col("lang")]
    names = [f"{prefix}l{k}" for k in range(len(levels))]
    keyed = docs.withColumns({n: F.coalesce(c.cast("string"), F.lit("\0")) for n, c in zip(names, levels, strict=True)})
    model = fit_text(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col, train_rows=train_rows)
    marks = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).select(F.col(id_col).alias("_key"), F.col(label_col).cast("long").alias("_label")).groupBy("_key").agg(F.max("_label").alias("_label"))
    labelled = keyed.select(F.col(id_col).alias("_key"), *names).join(marks, "_key")
    tables, top = site_rates(labelled.select(*names, "_label"), names)
    scored = _with_text_evidence(keyed, model, text_col, f"{prefix}text_log_odds")
    rate = F.lit(top)
    for k, table in enumerate(tables):
        keys = names[: k + 1]
        table = table.withColumnRenamed("rate", f"{prefix}r{k}")
        scored = scored.join(F.broadcast(table) if table.count() <= BROADCAST_SITES else table, keys, "left")
        rate = F.coalesce(F.col(f"{prefix}r{k}"), rate)
    odds = lambda p: F.log(p / (1 - p))
    rate = F.least(F.greatest(rate, F.lit(1e-4)), F.lit(1 - 1e-4))
    score = 1 / (1 + F.exp(-(F.col(f"{prefix}text_log_odds") + odds(rate) - odds(F.lit(top)))))
    out = scored.withColumns({f"{prefix}site_rate": rate, f"{prefix}score": score})
    own = [f"`{c}`" for c in docs.columns]
    return out.select(*own, f"{prefix}text_log_odds", f"{prefix}site_rate", f"{prefix}score", (F.col(f"{prefix}score") >= keep).alias(f"{prefix}kept"))


def _with_text_evidence(docs: DataFrame, model: TextModel, text_col: str, name: str) -> DataFrame:
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields), f"`{name}` double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            odds = model.log_odds(batch_features(batch.column(text_col)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(odds)], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, schema)


def op9_empirical_bayes(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source", "lang")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out())
    judged = judge_quality(docs, labels)
    return judged.select("doc_id", held_out().alias("held_out"), F.col("q_score").alias("score"), F.col("q_kept").cast("int").alias("predicted"), F.col("q_text_log_odds").alias("text_log_odds"), F.col("q_site_rate").alias("site_rate"))


def remove_rejected(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents of good quality, with their own columns; learns from the labels of all rows that op9 doesn't hold back."""
    return judge_quality(docs, labels.where(~held_out())).where("q_kept").select(*[f"`{c}`" for c in docs.columns])
