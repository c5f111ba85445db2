"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The alphabet is words, the patterns are windows of consecutive test words.  A
SHIFT table keyed by the hash of a block of two words says how far the window
end can move when a block is seen; a block of no pattern rules out every
window that overlaps it, so only every (window - 1)-th block is looked up.
Suffix blocks with shift 0 select the bucket of test windows with that hash,
and comparing the words' bytes confirms each occurrence.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillforge.llm import textkit as tk

WINDOW = 10
#: Bytes of test texts that one broadcast may hold; a larger benchmark goes in several, one after the other over the same rows.
PART_BYTES = 32 << 20
_TABLE_BITS = 18


class WindowClass:
    """Test windows of one length m, with their SHIFT table and suffix buckets."""

    def __init__(self, m: int, windows: dict[bytes, set[int]], hashes: dict[bytes, np.ndarray]):
        self.m, self.block = m, min(2, m)
        self.stride = m - self.block + 1
        self.texts = list(windows)
        self.items = [np.array(sorted(windows[t]), np.int64) for t in self.texts]
        h = np.stack([hashes[t] for t in self.texts])
        self.shift = np.full(1 << _TABLE_BITS, self.stride, np.uint8)
        for offset in range(self.stride):
            at = self._slot(tk.grams_at(h.ravel(), np.arange(len(h)) * m + offset, self.block))
            np.minimum.at(self.shift, at, np.uint8(self.stride - 1 - offset))
        whole = tk.grams_at(h.ravel(), np.arange(len(h)) * m, m)
        order = np.argsort(whole, kind="stable")
        self.bucket_hash, self.bucket_text = whole[order], order

    @staticmethod
    def _slot(block: np.ndarray) -> np.ndarray:
        return (block >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)

    def candidates(self, words: tk.Words) -> np.ndarray:
        """First words of the places where a window may stand."""
        counts = words.counts
        probes = np.where(counts >= self.m, (counts - self.block) // self.stride + 1, 0)
        if not probes.any():
            return np.zeros(0, np.int64)
        doc = np.repeat(np.arange(len(counts)), probes)
        at = words.first[doc] + tk.within(np.zeros(len(counts), np.int64), probes) * self.stride
        shift = self.shift[self._slot(tk.grams_at(words.hash, at, self.block))].astype(np.int64)
        live = shift < self.stride
        at, shift, doc = at[live], shift[live], doc[live]
        # the end of a window over this block lies `shift` words beyond the block or further, up to the next probe
        start = tk.within(at + self.block - self.m + shift, self.stride - shift)
        doc = np.repeat(doc, self.stride - shift)
        good = (start >= words.first[doc]) & (start + self.m <= words.first[doc + 1])
        start = start[good]
        if len(start):  # suffix block of shift 0
            suffix = self._slot(tk.grams_at(words.hash, start + self.m - self.block, self.block))
            start = start[self.shift[suffix] == 0]
        return start

    def search(self, words: tk.Words, text: bytes) -> Iterator[tuple[int, int]]:
        """(first word, number of the test window) of each occurrence."""
        start = self.candidates(words)
        if not len(start):
            return
        h = tk.grams_at(words.hash, start, self.m)
        low = np.searchsorted(self.bucket_hash, h, "left")
        high = np.searchsorted(self.bucket_hash, h, "right")
        for i in np.flatnonzero(low < high):
            s = int(start[i])
            found = b" ".join(text[a:b] for a, b in zip(words.start[s : s + self.m], words.end[s : s + self.m], strict=True))
            for k in self.bucket_text[low[i] : high[i]]:
                if self.texts[k] == found:
                    yield s, int(k)


class Index:
    """Windows of test items: the items' ids as strings, and a class for each window length."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        self.ids = sorted({i for i, _ in items})
        number = {x: n for n, x in enumerate(self.ids)}
        by_length: dict[int, tuple[dict, dict]] = {}
        for item, text in items:
            data = np.frombuffer(text.encode(), np.uint8)
            words = tk.Words(data, np.array([0, len(data)]), tk.ALNUM)
            n = len(words.start)
            if not n:
                continue
            lowered = tk.lower_ascii(data).tobytes()
            parts = [lowered[a:b] for a, b in zip(words.start, words.end, strict=True)]
            m = min(window, n)
            texts, hashes = by_length.setdefault(m, ({}, {}))
            for s in range(n - m + 1):
                w = b" ".join(parts[s : s + m])
                texts.setdefault(w, set()).add(number[item])
                hashes[w] = words.hash[s : s + m]
        self.classes = [WindowClass(m, *x) for m, x in sorted(by_length.items())]

    def scan(self, data: np.ndarray, offsets: np.ndarray) -> tuple[tk.Words, np.ndarray, list[set[int]]]:
        """The words, for each whether it is hit, and the items found in each document."""
        words = tk.Words(data, offsets, tk.ALNUM)
        edge = np.zeros(len(words.start) + 1, np.int64)
        found: list[set[int]] = [set() for _ in range(len(offsets) - 1)]
        text = tk.lower_ascii(data).tobytes()
        for c in self.classes:
            for s, k in c.search(words, text):
                edge[s] += 1
                edge[s + c.m] -= 1
                found[int(np.searchsorted(words.first, s, "right")) - 1].update(c.items[k].tolist())
        return words, np.cumsum(edge[:-1]) > 0, found


_INDEXES: dict[int, tuple[list, Index]] = {}


def _index(broadcast, window: int) -> Index:
    """The index of a broadcast part, built once in each worker."""
    items = broadcast.value
    held = _INDEXES.get(id(items))
    if held is None or held[0] is not items:
        if len(_INDEXES) > 3:
            _INDEXES.clear()
        held = _INDEXES[id(items)] = (items, Index(items, window))
    return held[1]


def benchmark_parts(benchmark: DataFrame, id_col: str, text_col: str, part_bytes: int) -> Iterator[list[tuple[str, str]]]:
    """The test items in parts of about part_bytes each: the size is read first, then each part is fetched when it is asked for, so the
    driver holds one at a time."""
    items = benchmark.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t")).where("i is not null and t is not null").distinct()
    size = items.select(F.sum(F.octet_length("t") + 16)).first()[0] or 0
    n = max(1, -(-int(size) // part_bytes))
    for k in range(n):
        part = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k) if n > 1 else items
        yield [(r.i, r.t) for r in part.toLocalIterator()]


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, part_bytes: int = PART_BYTES, prefix: str = "wm_"
) -> DataFrame:
    """docs and, named with `prefix`: n_words, n_hit, items (ids of test items with an occurring window, sorted as strings), spans
    (character ranges [start, end) of the runs of hit words).

    Words: byte runs of [0-9a-z] and non-ASCII after lower-casing A-Z.  A window is `window` words in a row of an item, or all
    words of a shorter one.  Null or wordless texts have no words, and items with a null id or text take no part.  Rows are
    neither merged nor dropped; columns of docs stay, whatever their names, but for those that begin with `prefix`.
    """
    sc = docs.sparkSession.sparkContext
    docs = docs.select(*[f"`{c}`" for c in docs.columns if not c.startswith(prefix)])
    out = docs
    for items in benchmark_parts(benchmark, item_id, item_text, part_bytes):
        out = _scan_part(out, sc.broadcast(items), text_col, window, prefix)
    return out.drop(f"{prefix}hit")


def _scan_part(docs: DataFrame, items, text_col: str, window: int, prefix: str) -> DataFrame:
    names = [f"{prefix}{x}" for x in ("n_words", "n_hit", "items", "spans", "hit")]
    base = [c for c in docs.columns if c not in names]
    again = names[0] in docs.columns
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name in base] + [f"`{names[0]}` long", f"`{names[1]}` long", f"`{names[2]}` array<string>", f"`{names[3]}` array<struct<start:int,end:int>>", f"`{names[4]}` binary"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index(items, window)
        for batch in batches:
            data, offsets = tk.text_buffers(batch.column(text_col))
            for i, j in tk.chunks(offsets):
                part = batch.slice(i, j - i)
                o = offsets[i : j + 1]
                words, hit, found = index.scan(data[o[0] : o[-1]], o - o[0])
                before = part.column(names[4]).to_pylist() if again else None
                items_before = part.column(names[2]).to_pylist() if again else None
                n_words, n_hit, ids, spans, bits = words.counts, [], [], [], []
                for d in range(j - i):
                    flags = hit[words.first[d] : words.first[d + 1]]
                    names_here = {index.ids[k] for k in found[d]}
                    if again:
                        old = np.unpackbits(np.frombuffer(before[d], np.uint8), count=len(flags)).astype(bool)
                        flags, names_here = flags | old, names_here | set(items_before[d])
                    n_hit.append(int(flags.sum()))
                    ids.append(sorted(names_here))
                    bits.append(np.packbits(flags).tobytes())
                    spans.append(_spans(words, d, flags) if n_hit[-1] else [])
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c) for c in base], pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(ids, pa.list_(pa.string())),
                     pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array(bits, pa.binary())],
                    names=[*base, *names],
                )

    return docs.mapInArrow(scan, schema)


def _spans(words: tk.Words, d: int, flags: np.ndarray) -> list[dict]:
    a = int(words.offsets[d])
    bytes_here = words.data[a : words.offsets[d + 1]]
    chars = np.concatenate([[0], np.cumsum((bytes_here & 0xC0) != 0x80)])
    edge = np.diff(np.concatenate([[0], flags.view(np.int8), [0]]))
    first = words.first[d]
    return [{"start": int(chars[words.start[first + s] - a]), "end": int(chars[words.end[first + e - 1] - a])} for s, e in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True)]


def op8_wu_manber(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id", F.col("wm_n_words").alias("n_words"), F.col("wm_n_hit").alias("n_hit"), F.size("wm_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("wm_items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("wm_n_hit") > 0).alias("contaminated"),
    )


def remove_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents in which no test window occurs, with their own columns."""
    return decontaminate(docs, benchmark).where("wm_n_hit = 0").select(*[f"`{c}`" for c in docs.columns])


