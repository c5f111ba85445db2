"""Removal of repeated byte strings by merging Burrows-Wheeler transforms of shards.

A string of LENGTH bytes has one anchor, the leftmost of its GRAM-byte grams
with the least hash, so equal strings have equal anchors at equal offsets.  The
strings of a document fall into runs with one anchor each.  Equal runs settle
all their strings by a count.  Where runs of one anchor differ, their texts, as
symbols of 8 bytes in step with the anchor, are a collection in shards: each
shard is sorted once, and the transforms are merged by refining their
interleave symbol by symbol.  Where refinement first parts two neighbours is
their common prefix; intervals that stay together for as many whole symbols as
any string of LENGTH bytes holds are the repeated ones, and comparing the bytes
around those symbols decides which of their strings are equal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillforge.llm import textkit as tk
from quillforge.llm.shared import cut, small_batches

LENGTH, GRAM, SYMBOL = 200, 64, 8
#: Runs of a bucket whose counts one task adds up; bytes of text that one merge takes, whole anchors together; symbols of a shard.
BUCKET_RUNS, MERGE_BYTES, SHARD_SYMBOLS = 500_000, 8 << 20, 1 << 16
#: An anchor with more different runs than this goes string by string through grouped counts instead of through one task's merge.
MANY_RUNS = 100_000
#: Up to so many documents are picked by a broadcast of their keys; more by a shuffle.
BROADCAST_KEYS = 200_000


class Runs:
    """Runs of some documents: first string's place, number of strings, the anchor's place, its hash and the hash of the run."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM):
        strings = np.maximum(np.diff(offsets) - length + 1, 0)
        doc = np.flatnonzero(strings)
        if not len(doc):
            self.doc = self.start = self.n = self.anchor = np.zeros(0, np.int64)
            self.anchor_hash = self.hash = np.zeros(0, np.uint64)
            return
        c = tk.prefix_hash(data)
        at = np.arange(len(data) - gram + 1)
        g = tk.span_hash(c, at, at + gram)
        least = _sliding_least(g, length - gram + 1)
        place = tk.within(offsets[doc], strings[doc])
        anchor = least[place]
        owner = np.repeat(doc, strings[doc])
        new = np.ones(len(place), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])
        first = np.flatnonzero(new)
        self.start, self.anchor, self.doc = place[first], anchor[first], owner[first]
        self.n = np.diff(np.append(first, len(place)))
        self.anchor_hash = g[self.anchor]
        whole = tk.span_hash(c, self.start, self.start + self.n + length - 1)
        self.hash = tk.mix(whole + (self.anchor - self.start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _sliding_least(g: np.ndarray, w: int) -> np.ndarray:
    """For each i the place of the leftmost least of g[i : i + w], by prefix and suffix minima of blocks of w."""
    n = len(g)
    blocks = -(-n // w) + 1
    top = np.full(blocks * w, np.iinfo(np.uint64).max, np.uint64)
    top[:n] = g
    b = top.reshape(blocks, w)
    ahead = np.minimum.accumulate(b, axis=1)
    behind = np.minimum.accumulate(b[:, ::-1], axis=1)[:, ::-1]
    index = np.arange(blocks * w).reshape(blocks, w)
    fresh = np.ones(b.shape, bool)
    fresh[:, 1:] = b[:, 1:] < ahead[:, :-1]  # leftmost of equal ones
    ahead_at = np.maximum.accumulate(np.where(fresh, index, -1), axis=1)
    fresh = np.ones(b.shape, bool)
    fresh[:, :-1] = b[:, :-1] <= behind[:, 1:]
    behind_at = np.minimum.accumulate(np.where(fresh, index, blocks * w)[:, ::-1], axis=1)[:, ::-1]
    i = np.arange(max(n - w + 1, 0))
    j = i + w - 1
    s, p = behind.ravel()[i], ahead.ravel()[j]
    return np.where(s <= p, behind_at.ravel()[i], ahead_at.ravel()[j])


# ---- merging transforms


class Shard:
    """A sorted shard: its suffixes, terminators first, and the symbol before each."""

    def __init__(self, symbols: np.ndarray, first: np.ndarray):
        """symbols: ids from 1, a 0 ends each string; first: where the strings begin."""
        n = len(symbols)
        rank, h = symbols.astype(np.int64), 1
        string = np.cumsum(symbols == 0) - (symbols == 0)
        longest = int(np.diff(np.append(first, n)).max(initial=1))
        while h < longest:
            ahead = np.zeros(n, np.int64)
            ahead[:-h] = np.where(string[h:] == string[:-h], rank[h:], 0)
            _, rank = np.unique(rank * (int(rank.max()) + 1) + ahead, return_inverse=True)
            h *= 2
        order = np.argsort(rank, kind="stable")
        ends = symbols[order] == 0
        self.suffix = np.concatenate([order[ends], order[~ends]])
        before = np.zeros(n, symbols.dtype)
        before[1:] = symbols[:-1]
        before[first] = 0
        self.before = before[self.suffix]
        self.n_strings = len(first)


def stable_order(x: np.ndarray) -> np.ndarray:
    """A stable argsort of non-negative integers, 16 bits at a time."""
    order = np.argsort((x & 0xFFFF).astype(np.uint16), kind="stable")
    top, shift = int(x.max(initial=0)), 16
    while top >> shift:
        order = order[np.argsort(((x[order] >> shift) & 0xFFFF).astype(np.uint16), kind="stable")]
        shift += 16
    return order


def merge(shards: list[Shard], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shard, its suffix number, common prefix with the one before, up to `depth`) in the merged order of all suffixes.

    The interleave says of each place which shard its suffix is from; one refinement sorts it, stably, by the symbols before, which
    gives the order by one more symbol.  A place where neighbours part for the first time gets that depth as its common prefix.
    """
    source = np.repeat(np.arange(len(shards)), [len(s.before) for s in shards])
    before = np.concatenate([s.before for s in shards])
    n_ends = sum(s.n_strings for s in shards)
    ends = np.repeat(np.arange(len(shards)), [s.n_strings for s in shards])
    interleave = source
    block = np.zeros(len(source), np.int64)
    common = np.full(len(source), depth, np.int64)
    common[: n_ends + 1] = 0
    for k in range(1, depth + 1):
        own = np.empty(len(source), np.int64)
        own[stable_order(interleave)] = np.arange(len(source))
        symbol = before[own]
        inner = np.flatnonzero(symbol)
        order = inner[stable_order(symbol[inner])]
        interleave = np.concatenate([ends, interleave[order]])
        parts = np.ones(len(source), bool)
        s, b = symbol[order], block[order]
        parts[n_ends + 1 :] = (s[1:] != s[:-1]) | (b[1:] != b[:-1])
        common[parts & (common == depth)] = k - 1
        block = np.cumsum(parts)
    own = np.empty(len(source), np.int64)
    own[stable_order(interleave)] = np.arange(len(source))
    number = np.concatenate([np.arange(len(s.before)) for s in shards])
    return source[own], number[own], common


def repeated_strings(texts: list[bytes], leads: np.ndarray, counts: np.ndarray, length: int = LENGTH) -> list[np.ndarray]:
    """For each run which of its strings occur in another run too.  leads: bytes before the anchor; counts: strings of the run."""
    whole = length // SYMBOL - (length % SYMBOL < SYMBOL - 1)  # symbols in any string, however it lies
    flags = [np.zeros(int(n), bool) for n in counts]
    skip = leads % SYMBOL
    size = np.array([len(t) for t in texts])
    n_symbols = np.maximum((size - skip) // SYMBOL, 0)
    data = np.frombuffer(b"".join(texts), np.uint8)
    begin = np.concatenate([[0], np.cumsum(size)])[:-1]
    at = np.repeat(begin + skip, n_symbols) + SYMBOL * tk.within(np.zeros(len(texts), np.int64), n_symbols)
    raw = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, SYMBOL)[at]).view(np.uint64).ravel() if len(at) else np.zeros(0, np.uint64)
    ids = np.unique(raw, return_inverse=True)[1].astype(np.int64) + 1
    edge = np.concatenate([[0], np.cumsum(n_symbols)])
    shards, owners, i = [], [], 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(edge, edge[i] + SHARD_SYMBOLS, "right")) - 1)
        n = n_symbols[i:j]
        first = np.concatenate([[0], np.cumsum(n + 1)])
        symbols = np.zeros(first[-1], np.int64)
        symbols[tk.within(first[:-1], n)] = ids[edge[i] : edge[j]]
        shards.append(Shard(symbols, first[:-1]))
        owners.append((i, first))
        i = j
    shard, number, common = merge(shards, whole)
    inside = common >= whole
    member = inside.copy()
    member[:-1] |= inside[1:]
    if not member.any():
        return flags
    run, place = np.empty(int(member.sum()), np.int64), np.empty(int(member.sum()), np.int64)
    shard, number = shard[member], number[member]
    for k, (i, first) in enumerate(owners):
        mine = shard == k
        suffix = shards[k].suffix[number[mine]]
        string = np.searchsorted(first, suffix, "right") - 1
        run[mine], place[mine] = i + string, suffix - first[string]
    # strings whose first whole symbol this is: they begin up to 7 bytes before it
    low = skip[run] + SYMBOL * place
    start = (low[:, None] - np.arange(SYMBOL)).ravel()
    run = np.repeat(run, SYMBOL)
    good = (start >= 0) & (start < counts[run])
    run, start = run[good], start[good]
    c = tk.prefix_hash(data)
    h = tk.span_hash(c, begin[run] + start, begin[run] + start + length)
    _, back, n = np.unique(h, return_inverse=True, return_counts=True)
    twice = n[back] > 1
    for r, s in zip(run[twice].tolist(), start[twice].tolist(), strict=True):
        flags[r][s] = True
    return flags


# ---- over documents


def _chunked(batch: pa.RecordBatch, length: int, gram: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, Runs]]:
    data, offsets = tk.text_buffers(batch.column("text"))
    for i, j in tk.chunks(offsets):
        o = offsets[i : j + 1]
        d = data[o[0] : o[-1]]
        yield i, d, o - o[0], Runs(d, o - o[0], length, gram)


def _count_runs(buckets: int, length: int, gram: int):
    """(bucket, anchors, runs, counts), packed, of each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, _, r in _chunked(batch, length, gram):
                h, one, n = np.unique(r.hash, return_index=True, return_counts=True)
                a = r.anchor_hash[one]
                b = (a >> np.uint64(20)).astype(np.int64) % buckets
                by = np.argsort(b, kind="stable")
                edges = np.searchsorted(b[by], np.arange(buckets + 1))
                full = np.flatnonzero(np.diff(edges))
                part = lambda x: pa.array([x[by[edges[k] : edges[k + 1]]].tobytes() for k in full], pa.binary())  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays([pa.array(full, pa.int64()), part(a), part(h), part(n.astype(np.int32))], names=["bucket", "anchors", "runs", "counts"])

    return run


def _sum_runs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held, bucket = [], None
    for frame in frames:
        for row in frame.itertuples(index=False):
            if row.bucket != bucket and held:
                yield _settle(held)
                held = []
            bucket = row.bucket
            held.append((np.frombuffer(row.anchors, np.uint64), np.frombuffer(row.runs, np.uint64), np.frombuffer(row.counts, np.int32)))
    if held:
        yield _settle(held)


def _settle(held: list[tuple]) -> pd.DataFrame:
    """Runs that occur twice, and those whose anchor has other runs too."""
    a, h, n = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.lexsort((h, a))
    a, h, n = a[order], h[order], n[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (h[1:] != h[:-1])
    first = np.flatnonzero(new)
    n = np.add.reduceat(n.astype(np.int64), first) if len(first) else n
    a, h = a[first], h[first]
    _, back, kinds = np.unique(a, return_inverse=True, return_counts=True)
    kinds = kinds[back]
    some_single = np.bincount(back, n == 1) > 0  # else the counts settle all of the anchor's runs
    merge_it = (kinds > 1) & some_single[back]
    keep = (n > 1) | merge_it
    return pd.DataFrame({"run": h[keep].view(np.int64), "anchor": a[keep].view(np.int64), "twice": n[keep] > 1, "merged": merge_it[keep], "many": kinds[keep] > MANY_RUNS})


def _list_runs(length: int, gram: int):
    """(doc, run, start, n, lead) of each run; those that a document repeats itself are settled and have no run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("doc")
            for i, _, offsets, r in _chunked(batch, length, gram):
                tk.give_back()
                order = np.lexsort((r.hash, r.doc))
                h, d = r.hash[order], r.doc[order]
                same = (h[1:] == h[:-1]) & (d[1:] == d[:-1])
                again = np.zeros(len(h), bool)
                again[1:] |= same
                again[:-1] |= same
                own = np.zeros(len(h), bool)
                own[order] = again
                # neighbours among the settled runs are one row
                head = np.ones(len(h), bool)
                head[1:] = ~(own[1:] & own[:-1] & (r.doc[1:] == r.doc[:-1]))
                first = np.flatnonzero(head)
                n = np.add.reduceat(r.n, first) if len(first) else r.n
                r_doc, settled = r.doc[first], own[first]
                # and one of each stays as a run, for others to be merged with
                lone = np.zeros(len(h), bool)
                lone[order] = again & ~np.concatenate([[False], same])[: len(h)]
                lone = np.flatnonzero(lone)
                at = np.concatenate([first, lone])
                settled, n, r_doc = np.concatenate([settled, np.zeros(len(lone), bool)]), np.concatenate([n, r.n[lone]]), r.doc[at]
                yield pa.RecordBatch.from_arrays(
                    [keys.take(pa.array(r_doc + i)), pa.array(r.hash[at].view(np.int64), mask=settled), pa.array((r.start[at] - offsets[r_doc]).astype(np.int64)), pa.array(n.astype(np.int64)), pa.array((r.anchor[at] - r.start[at]).astype(np.int32))],
                    names=["doc", "run", "start", "n", "lead"],
                )

    return run


def _cut_texts(length: int):
    """The texts of the runs asked for; of equal documents in a batch only one's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tk.text_buffers(batch.column("text"))
            seen = set()
            out: list[tuple] = []
            for d, (doc, wanted) in enumerate(zip(batch.column("doc").to_pylist(), batch.column("wanted"), strict=True)):
                if doc in seen:
                    continue
                seen.add(doc)
                for w in wanted.as_py():
                    s = offsets[d] + w["start"]
                    out.append((w["anchor"], w["run"], w["lead"], w["n"], w["twice"], w["many"], data[s : s + w["n"] + length - 1].tobytes()))
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.bool_(), pa.binary()]
            columns = list(zip(*out, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["anchor", "run", "lead", "n", "twice", "many", "piece"])

    return run


def _merge_runs(length: int):
    """Rows stand together by anchor; whole anchors are merged, several at a time."""

    def flush(rows: list) -> pd.DataFrame:
        flags = repeated_strings([r.piece for r in rows], np.array([r.lead for r in rows]), np.array([r.n for r in rows]), length)
        out = [(r.run, int(s), int(e - s)) for r, f in zip(rows, flags, strict=True) if not r.twice and f.any() for s, e in _true_ranges(f)]
        return pd.DataFrame(out, columns=["run", "skip", "m"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, seen, size, anchor = [], set(), 0, None
        for frame in frames:
            for row in frame.itertuples(index=False):
                if row.anchor != anchor and size >= MERGE_BYTES:
                    yield flush(rows)
                    rows, size = [], 0
                if row.anchor != anchor:
                    anchor, seen = row.anchor, set()
                if row.run not in seen:
                    seen.add(row.run)
                    rows.append(row)
                    size += len(row.piece)
        if rows:
            yield flush(rows)
        tk.give_back()

    return run


def _true_ranges(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.diff(np.concatenate([[0], flags.view(np.int8), [0]]))
    return list(zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True))


def _strings(length: int):
    """(string, run, skip): every string of the runs of an anchor with very many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run_, n, piece in zip(*(batch.column(c).to_pylist() for c in ("run", "n", "piece")), strict=True):
                data = np.frombuffer(piece, np.uint8)
                at = np.arange(n)
                h = tk.span_hash(tk.prefix_hash(data), at, at + length)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.full(n, run_, np.int64)), pa.array(at)], names=["string", "run", "skip"])

    return run


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """docs: doc (a key of the text), text.  doc and spans, the byte ranges [start, end) that repeated strings cover, as they come."""
    spark = docs.sparkSession
    total = docs.select(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = int(min(1 << 16, max(1, -(-total // ((length - gram) // 2) // BUCKET_RUNS))))
    packed = docs.select("text").mapInArrow(_count_runs(buckets, length, gram), "bucket long, anchors binary, runs binary, counts binary")
    known = packed.repartition(max(buckets, spark.sparkContext.defaultParallelism), "bucket").sortWithinPartitions("bucket").mapInPandas(_sum_runs, "run long, anchor long, twice boolean, merged boolean, many boolean")
    known = cut(known)
    runs = docs.select("doc", "text").mapInArrow(_list_runs(length, gram), "doc long, run long, start long, n long, lead int")
    # one scan: runs that a document has settled itself pass the join, spread by a key of their own
    key = F.coalesce("run", F.xxhash64("doc", "start", F.lit("own")))
    sides = runs.withColumn("key", key).join(known.withColumnRenamed("run", "key"), "key", "left").drop("key")
    sides = cut(sides.where("run is null or anchor is not null"))
    own = sides.where("run is null").select("doc", "start", F.col("n").alias("m"))
    met = sides.where("run is not null")
    whole = met.where("twice").select("doc", "start", F.col("n").alias("m"))

    wanted = met.where("merged").groupBy("run").agg(F.min(F.struct("doc", "start", "n", "lead", "anchor", "twice", "many")).alias("x")).select("run", "x.*")
    wanted = cut(wanted.groupBy("doc").agg(F.collect_list(F.struct("anchor", "run", "lead", "n", "twice", "many", "start")).alias("wanted")))  # no more than a document's own runs
    texts = _pick(docs.select("doc", "text"), wanted.select("doc")).join(wanted, "doc")
    pieces = texts.mapInArrow(_cut_texts(length), "anchor long, run long, lead int, n long, twice boolean, many boolean, piece binary")
    merged = pieces.where("not many").repartition("anchor").sortWithinPartitions("anchor").mapInPandas(_merge_runs(length), "run long, skip long, m long")
    if not met.where("many and merged").isEmpty():
        strings = pieces.where("many").dropDuplicates(["run"]).select("run", "n", "piece").mapInArrow(_strings(length), "string long, run long, skip long")
        twice = strings.groupBy("string").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("string")
        merged = merged.union(strings.join(twice, "string").select("run", "skip", F.lit(1).cast("long")))
    partly = met.where("merged and not twice").select("run", "doc", "start").join(merged, "run").select("doc", (F.col("start") + F.col("skip")).alias("start"), "m")

    found = own.union(whole).union(partly).select("doc", F.struct("start", (F.col("start") + F.col("m") + length - 1).alias("end")).alias("s"))
    return found.groupBy("doc").agg(F.collect_set("s").alias("spans"))  # no more than a document's own strings


def _pick(docs: DataFrame, keys: DataFrame) -> DataFrame:
    keys = keys.distinct()
    return docs.join(F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys, "doc", "left_semi")


def remove_repeats(docs: DataFrame, *, text_col: str = "text", length: int = LENGTH, gram: int = GRAM, prefix: str = "rep_") -> DataFrame:
    """docs and, named with `prefix`: n_bytes, spans (the maximal runs of removed bytes, [start, end)), kept (the other bytes, in order).

    Removed is each byte covered by a string of `length` bytes of the text that also begins anywhere else, in the same text or
    another, overlaps included; strings never cross texts and are judged on the input.  A null text is empty; texts shorter than
    `length` are never touched; repeated rows are repeats of each other.  Rows stay as they are; columns that begin with `prefix`
    are replaced.  length must be at least gram + 7 and gram at least 1.
    """
    docs = docs.select(*[f"`{c}`" for c in docs.columns if not c.startswith(prefix)])
    own = docs.columns
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    keyed = docs.withColumn(f"{prefix}doc", F.xxhash64(text, F.octet_length(text)))
    spans = cut(repeated_spans(keyed.select(F.col(f"{prefix}doc").alias("doc"), text.alias("text")), length, gram))
    hit = spans.select(F.col("doc").alias(f"{prefix}doc"), F.col("spans").alias(f"{prefix}found"))
    few = spans.count() <= BROADCAST_KEYS
    keys = hit.select(f"{prefix}doc")
    keys = F.broadcast(keys) if few else keys
    clean = keyed.join(keys, f"{prefix}doc", "left_anti")
    kind = "array<struct<start:long,end:long>>"
    clean = clean.select(*[f"`{c}`" for c in own], F.octet_length(text).cast("long").alias(f"{prefix}n_bytes"), F.array().cast(kind).alias(f"{prefix}spans"), text.cast("binary").alias(f"{prefix}kept"))
    touched = (keyed.join(keys, f"{prefix}doc", "left_semi") if few else keyed).join(hit, f"{prefix}doc")
    names = [f"{prefix}n_bytes", f"{prefix}spans", f"{prefix}kept"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields), f"`{names[0]}` long", f"`{names[1]}` {kind}", f"`{names[2]}` binary"])
    arrow = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tk.text_buffers(batch.column(text_col))
            found = batch.column(f"{prefix}found")
            for i, j in tk.chunks(offsets):
                spans_out, kept = [], []
                for d in range(i, j):
                    text = data[offsets[d] : offsets[d + 1]]
                    flat = found[d].values
                    s, e = flat.field("start").to_numpy(), flat.field("end").to_numpy()
                    edge = np.bincount(s, minlength=len(text) + 1) - np.bincount(e, minlength=len(text) + 1)
                    covered = np.cumsum(edge[:-1]) > 0
                    spans_out.append([{"start": int(a), "end": int(b)} for a, b in _true_ranges(covered)])
                    kept.append(text[~covered].tobytes())
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in own), pa.array(np.diff(offsets)[i:j]), pa.array(spans_out, arrow), pa.array(kept, pa.binary())], names=[*own, *names])

    return clean.union(touched.select(*[f"`{c}`" for c in own], f"{prefix}found").mapInArrow(remove, schema))


def op6_interleave(spark, sf_dir: str) -> DataFrame:
    found = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    removed = F.aggregate("rep_spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", F.col("rep_n_bytes").alias("n_bytes"), removed.alias("n_removed"), F.size("rep_spans").cast("long").alias("n_spans"), F.sha2("rep_kept", 256).alias("kept_sha256"))
