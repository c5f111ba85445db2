import random
import zlib

import numpy as np
import pytest

from quillforge.llm.packing import BestFit, WordTokenizer, pack

P = pytest.importorskip("public_tokenizers")
PATH = P.path("word_bpe_49k.json")


def test_best_fit_rules():
    b = BestFit(10, 2)
    assert [b.place(n) for n in (6, 7, 3, 4, 9, 1)] == [(0, 0), (1, 0), (1, 7), (0, 6), (2, 0), (2, 9)]
    b = BestFit(10, 2)
    assert [b.place(n) for n in (6, 7, 5, 4)] == [(0, 0), (1, 0), (2, 0), (0, 6)]  # bin 1, the fullest, closed


@pytest.mark.parametrize("text", ["", " \n ", "Hello, World's they're x²½ 12,5%", "Größe ÉTÉ çà ñandú ſ İstanbul ΑΣ", "é ñ", "a<|endoftext|>b <|x", "日本 ​ x\u0085y\x1cz", "''s 't'll", "Ω" * 300, "x" * 5000])
def test_ids_equal_the_tokenizer(text):
    t = WordTokenizer(PATH)
    for s in (text, text * 3, f"the {text} end"):
        assert np.frombuffer(t.encode(s), "<u4").tolist() == t.whole.encode(s, add_special_tokens=False).ids


def test_corpus_ids(spark):
    import glob

    import pyarrow.parquet as pq

    t = WordTokenizer(PATH)
    for f in glob.glob("/root/testdata/sf0.001/documents.parquet"):
        for s in pq.read_table(f)["text"].to_pylist():
            assert np.frombuffer(t.encode(s), "<u4").tolist() == t.whole.encode(s, add_special_tokens=False).ids


def test_pieces_tile_documents_and_sequences(spark):
    rng = random.Random(5)
    docs = [(i, " ".join(rng.choice(["the", "idea", "Über", "x1", "…"]) for _ in range(rng.choice([0, 1, 5, 30, 90, 400]))), "own") for i in range(300)] + [(300, None, "own"), (7, "twice", "own"), (7, "twice", "own"), (None, "no id", "own")]
    frame = spark.createDataFrame(docs, "doc_id long, text string, piece string").repartition(3)
    rows = pack(frame, PATH, max_tokens=64, open_bins=16).collect()
    t = WordTokenizer(PATH)
    want = sorted((str(i), t.encode(s) + b"\1\0\0\0") for i, s, _ in docs)
    by_sequence = {}
    for r in rows:
        assert r.length == len(r.ids) // 4 <= 64 and r.start == 64 * r.piece
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    assert sum(len(x) for _, x in want) == sum(len(r.ids) for r in rows)
    single = {(str(r.doc_id), zlib.crc32(r.ids)) for r in rows if r.piece == 0}
    assert {(i, zlib.crc32(x[:256])) for i, x in want} == single
    total = sum(r.length for r in rows)
    assert len(by_sequence) <= 1.15 * total / 64 + 3
