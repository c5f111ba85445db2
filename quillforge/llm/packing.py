"""Bounded-space online best-fit packing of token sequences.

Each task tokenises its own documents and packs them as they come, so no token
is shuffled.  A packer keeps a fixed number of open bins; a bitset has a bit
for each amount of free space that some open bin has, so that the fullest bin
which still takes a piece is the lowest set bit at or above its length.  When
all bins are open and none takes the piece, the fullest one closes.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillforge.llm.shared import small_batches

MAX_TOKENS = 4096
END_ID = 1
#: Open bins of a task: memory and the search are bounded by it, whatever the number of documents.
OPEN_BINS = 1024
#: Cached words of a worker, in each of two generations.
CACHED_WORDS = 200_000


class BestFit:
    def __init__(self, capacity: int, open_bins: int):
        self.capacity, self.open_bins = capacity, open_bins
        self.free: dict[int, list[int]] = {}
        self.bits = self.n_open = self.n_bins = 0

    def _pop(self, free: int) -> int:
        stack = self.free[free]
        b = stack.pop()
        if not stack:
            self.bits ^= 1 << free
            del self.free[free]
        self.n_open -= 1
        return b

    def _push(self, free: int, b: int) -> None:
        if free:
            self.free.setdefault(free, []).append(b)
            self.bits |= 1 << free
            self.n_open += 1

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset in it) of a piece of 1 to `capacity` tokens."""
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            b = self._pop(free)
        else:
            if self.n_open == self.open_bins:
                self._pop((self.bits & -self.bits).bit_length() - 1)  # the fullest closes
            free, b = self.capacity, self.n_bins
            self.n_bins += 1
        self._push(free - length, b)
        return b, self.capacity - free


def _byte_alphabet() -> dict[int, str]:
    """The letters that byte-level vocabularies write for bytes: printable Latin-1 as it is, the others from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + n) for n, b in enumerate(rest)}


class WordTokenizer:
    """ids of a lower-casing BPE vocabulary whose tokens never cross white space, word by word through a cache.

    Texts with characters outside Latin-1, Latin Extended-A and common punctuation, or with what may be a special token, are left
    to the tokenizer itself; for all others the cached words give the same ids.
    """

    _SAFE = "\t\n\r -~ -ſ–—‘’“”…€"

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.unsafe = re.compile(f"[^{self._SAFE}]|<\\|")
        safe = [chr(c) for c in [*range(32, 127), *range(0xA0, 0x180), 0x2013, 0x2014, 0x2018, 0x2019, 0x201C, 0x201D, 0x2026, 0x20AC]]
        escaped = lambda kind: "".join(re.escape(c) for c in safe if unicodedata.category(c)[0] == kind)
        letters, numbers = escaped("L"), escaped("N")
        self.pieces = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^\\s{letters}{numbers}]+")
        self.alphabet = _byte_alphabet()
        self.words = _Cache(self._chunk)

    def _chunk(self, chunk: str) -> bytes:
        ids: list[int] = []
        for piece in self.pieces.findall(chunk):
            mapped = piece if piece.isascii() else "".join(self.alphabet[b] for b in piece.encode())
            ids += [t.id for t in self.model.tokenize(mapped)]
        return np.array(ids, "<u4").tobytes()

    def encode(self, text: str | None) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if not text:
            return b""
        if self.unsafe.search(text):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        return b"".join(map(self.words.__getitem__, text.lower().split()))


class _Cache(dict):
    """A dict that fills itself; when full, it becomes the older generation, from which words still in use return."""

    def __init__(self, make):
        super().__init__()
        self.make, self.older = make, {}

    def __missing__(self, key: str) -> bytes:
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= 64:
            if len(self) >= CACHED_WORDS:
                self.older = dict(self)
                self.clear()
            self[key] = value
        return value


_TOKENIZERS: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


def pack(docs: DataFrame, tokenizer_path: str, *, id_cols: tuple[str, ...] = ("doc_id",), text_col: str = "text", max_tokens: int = MAX_TOKENS, end_id: int = END_ID, open_bins: int = OPEN_BINS) -> DataFrame:
    """A row per piece: id_cols, piece (from 0), start (tokens of the document before it), length, ids (little-endian unsigned 32-bit),
    sequence_id and offset (its place in the sequence; the pieces of a sequence leave no gaps).

    A document is its tokens and then end_id, so a null or empty text is one token.  Documents of more than max_tokens are cut into
    pieces of max_tokens, the last of which may be shorter; no other is cut.  Repeated rows are packed each.  sequence_id has the
    task's partition in its upper bits, so it depends on how the rows are dealt, but a task that runs again gives the same rows.
    """
    small_batches(docs.sparkSession)
    fields = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    schema = ", ".join([*(f"`{c}` {fields[c]}" for c in id_cols), "piece int", "start long", "length long", "ids binary", "sequence_id long", "offset long"])
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, bins = tokenizer(tokenizer_path), BestFit(max_tokens, open_bins)
        base = TaskContext.get().partitionId() << 36
        for batch in batches:
            texts = batch.column(text_col)
            row, piece, start, length, ids, sequence, offset = [], [], [], [], [], [], []
            held = 0
            for d in range(batch.num_rows):
                tokens = words.encode(texts[d].as_py()) + end
                for k, s in enumerate(range(0, len(tokens), 4 * max_tokens)):
                    part = tokens[s : s + 4 * max_tokens]
                    b, at = bins.place(len(part) // 4)
                    row.append(d), piece.append(k), start.append(s // 4), length.append(len(part) // 4), ids.append(part)
                    sequence.append(base + b), offset.append(at)
                held += len(tokens)
                if held > 1 << 21 or d == batch.num_rows - 1:
                    keys = [batch.column(c).take(pa.array(row, pa.int32())) for c in id_cols]
                    yield pa.RecordBatch.from_arrays(
                        [*keys, pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary()), pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())],
                        names=[*id_cols, "piece", "start", "length", "ids", "sequence_id", "offset"],
                    )
                    row, piece, start, length, ids, sequence, offset = [], [], [], [], [], [], []
                    held = 0

    return docs.select(*[f"`{c}`" for c in dict.fromkeys([*id_cols, text_col])]).mapInArrow(run, schema)


def production_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op4_best_fit(spark, sf_dir: str) -> DataFrame:
    packed = pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), production_tokenizer())
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")
