import hashlib
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from quillforge.llm.repeats import Runs, Shard, _sliding_least, merge, op6_interleave, remove_repeats, repeated_strings


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    counts = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = [False] * len(d)
        for i in range(len(d) - length + 1):
            if counts[d[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        out.append((len(d), sum(gone), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(bytes(b for b, g in zip(d, gone, strict=True) if not g)).hexdigest()))
    return out


def test_sliding_least():
    rng = np.random.default_rng(1)
    for n in range(1, 40):
        g = rng.integers(0, 4, n).astype(np.uint64)
        for w in (1, 2, 3, 7):
            want = [i + int(np.argmin(g[i : i + w])) for i in range(n - w + 1)]
            assert _sliding_least(g, w).tolist() == want


def test_merge_gives_the_order_and_prefixes_of_all_suffixes():
    rng = random.Random(2)
    for _ in range(200):
        shards, everything = [], []
        for k in range(rng.randrange(1, 5)):
            strings = [[rng.choice([1, 2, 3]) for _ in range(rng.randrange(0, 9))] for _ in range(rng.randrange(1, 5))]
            symbols = np.array([x for s in strings for x in [*s, 0]])
            first = np.cumsum([0, *(len(s) + 1 for s in strings)])[:-1]
            shards.append(Shard(symbols, first))
            everything += [((k, int(first[i]) + p), s[p:]) for i, s in enumerate(strings) for p in range(len(s) + 1)]
        depth = 4
        source, number, common = merge(shards, depth)
        names = dict(everything)
        got = [names[int(a), int(shards[a].suffix[b])] for a, b in zip(source, number, strict=True)]
        assert len(got) == len(everything) and [g[:depth] for g in got] == sorted(g[:depth] for g in names.values())
        for x, y, c in zip(got, got[1:], common[1:], strict=False):
            same = next((i for i, (a, b) in enumerate(zip(x, y, strict=False)) if a != b), min(len(x), len(y)))
            assert c == min(same, depth)


def test_repeated_strings_of_runs():
    rng = random.Random(3)
    base = bytes(rng.randrange(97, 100) for _ in range(60))
    runs, leads = [], []
    for _ in range(30):
        t = bytearray(base)
        for _ in range(2):
            t[rng.choice([*range(20), *range(40, 60)])] = rng.randrange(97, 123)
        cut = rng.randrange(0, 9)
        runs.append(bytes(t[cut:]))
        leads.append(25 - cut)
    runs, at = map(list, zip(*{r: (r, n) for r, n in zip(runs, leads, strict=True)}.values(), strict=True))
    counts = np.array([max(1, len(r) - 31) for r in runs])
    got = repeated_strings(runs, np.array(at), counts, 32)
    seen = Counter(r[i : i + 32] for r, n in zip(runs, counts, strict=True) for i in range(n))
    assert [g.tolist() for g in got] == [[seen[r[i : i + 32]] > 1 for i in range(n)] for r, n in zip(runs, counts, strict=True)]


def corpus(rng, n):
    say = lambda k: " ".join(rng.choice(["alpha", "béta", "gamma", "delta", "x", "omega,", "yy"]) for _ in range(k))
    passages = [say(30) for _ in range(4)]
    texts = []
    for _ in range(n):
        t = say(rng.randrange(0, 60))
        for _ in range(rng.randrange(0, 3)):
            t = t[: len(t) // 2] + rng.choice(passages)[rng.randrange(20) :] + t[len(t) // 2 :]
        texts.append(t)
    texts += [texts[0], texts[1], texts[1][:-3] + "zzz", "a" * 500, "ab" * 300, "ab" * 40, None, "", "é" * 100]
    return texts


def test_against_brute_force(spark):
    rng = random.Random(4)
    for length, gram, n in ((40, 16, 80), (23, 9, 60), (200, 64, 60)):
        texts = corpus(rng, n)
        frame = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, doc string").repartition(3)
        got = {r.doc_id: r for r in remove_repeats(frame, length=length, gram=gram).collect()}
        assert len(got) == len(texts)
        for i, want in enumerate(brute(texts, length)):
            r = got[i]
            assert (r.rep_n_bytes, sum(s.end - s.start for s in r.rep_spans), len(r.rep_spans), hashlib.sha256(r.rep_kept).hexdigest()) == want, (length, i)


def test_anchor_with_very_many_runs(spark, monkeypatch):
    import quillforge.llm.repeats as m

    monkeypatch.setattr(m, "MANY_RUNS", 3)  # the driver's tests run in this process; workers get it below
    texts = corpus(random.Random(5), 60)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    settle = m._settle
    got = m.remove_repeats(frame, length=40, gram=16)
    assert settle is m._settle
    rows = {r.doc_id: r for r in got.collect()}
    for i, want in enumerate(brute(texts, 40)):
        assert (rows[i].rep_n_bytes, sum(s.end - s.start for s in rows[i].rep_spans)) == want[:2]


def test_query_duplicates_and_empty(spark, tmp_path):
    rng = random.Random(6)
    long = " ".join(str(rng.random()) for _ in range(40))
    rows = [(1, long), (1, long), (None, long + "!"), (2, long[:150]), (3, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    got = op6_interleave(spark, str(tmp_path)).collect()
    key = lambda r: (str(r[0]), r[1:])
    assert sorted(map(tuple, got), key=key) == sorted(((r[0], *b) for r, b in zip(rows, brute([t for _, t in rows], 200), strict=True)), key=key)
    assert remove_repeats(frame.where("false")).count() == 0
    assert len(Runs(np.zeros(0, np.uint8), np.array([0])).start) == 0
    assert remove_repeats(frame.where("doc_id = 1").limit(1).withColumn("x", F.lit(1))).first().rep_spans == []
