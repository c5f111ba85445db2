import hashlib
import random
import re

from quillforge.llm.wu_manber import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, items, window=10):
    out = []
    for doc_id, text in docs:
        w = words(text)
        hit, ids = [False] * len(w), set()
        for i, t in items:
            x = words(t)
            if i is None or not x:
                continue
            m = min(window, len(x))
            for a in range(len(x) - m + 1):
                for s in range(len(w) - m + 1):
                    if w[s : s + m] == x[a : a + m]:
                        hit[s : s + m] = [True] * m
                        ids.add(str(i))
        out.append((doc_id, len(w), sum(hit), sorted(ids)))
    return out


def test_against_brute_force(spark):
    rng = random.Random(1)
    vocabulary = ["a", "b", "é", "Zz", "d9"]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(k, say(rng.choice([0, 1, 2, 3, 5, 9, 10, 11, 15]))) for k in range(12)] + [(None, "a b"), (99, None)]
    docs = [(k, say(rng.choice([0, 1, 2, 4, 9, 10, 12, 40, 300])), "own") for k in range(60)]
    docs += [(60, None, "own"), (61, items[11][1] + "!", "own"), (61, items[11][1] + "!", "own"), (None, say(30), None), (62, ("x" * 5 + ". ") * 3000 + items[10][1], "own")]
    for part_bytes in (1 << 20, 60):
        got = decontaminate(spark.createDataFrame(docs, "doc_id int, text string, n_words string"), spark.createDataFrame(items, "item_id int, text string"), part_bytes=part_bytes)
        assert "n_words" in got.columns
        got = [(r.doc_id, r.wm_n_words, r.wm_n_hit, list(r.wm_items)) for r in got.collect()]
        key = lambda r: (r[0] is None, r[0] or 0, str(r))
        assert sorted(got, key=key) == sorted(brute([d[:2] for d in docs], items), key=key)


def test_spans_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "Ä x one two, three ü")], "doc_id int, text string")
    items = spark.createDataFrame([(1, "One TWO three")], "item_id int, text string")
    row = decontaminate(docs, items).first()
    assert [(s.start, s.end) for s in row.wm_spans] == [(4, 18)]
    assert decontaminate(docs.where("false"), items).count() == 0
    assert decontaminate(docs, items.where("false")).first().wm_n_hit == 0


def test_query_digest(spark, tmp_path):
    from quillforge.llm.wu_manber import op8_wu_manber

    spark.createDataFrame([(1, "p q r")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(10, "q r"), (9, "p")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    row = op8_wu_manber(spark, str(tmp_path)).first()
    assert (row.n_words, row.n_hit, row.n_items, row.contaminated) == (3, 3, 2, True)
    assert row.items_sha256 == hashlib.sha256(b"10,9").hexdigest()
