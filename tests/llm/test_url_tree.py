from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from quillforge.llm.url_tree import RULES, alike, judge_urls


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = lambda s, marks: s[: min([s.index(m) for m in marks if m in s], default=len(s))]
    raw = cut(rest, "/?#")
    return "".join(c.lower() if c.isascii() else c for c in raw), cut(rest[len(raw) :], "?#")


def ruled(host, path):
    fit = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit)[1:] if fit else (None, None)


URLS = [
    "http://a.example.net/en/1?x", "https://A.Example.NET/fr/1", "http://example.net", "http://net/", "http://xnet/q", "http://b.example.com/de/4#t",
    "http://b.example.com/en/4", "http://m.org/fr/", "http://m.org/fr", "no scheme", "", None, "://", "x://ÄÖ.Org/fr/ü?", "http://h?q=/a://b", "http://u@h:80/a/b/c/d/e/f//",
]


def test_hosts_paths_and_rules(spark):
    rows = [(i, u, "own") for i, u in enumerate(URLS)] + [(0, URLS[0], "own"), (None, URLS[1], None)]
    got = judge_urls(spark.createDataFrame(rows, "page_id int, url string, host string"), rules=RULES).collect()
    assert len(got) == len(rows)
    for r in got:
        host, path = split(r.url)
        rule, verdict = ruled(host, path)
        assert (r.u_host, r.u_path, r.u_rule) == (host, path, rule), r
        assert r.u_verdict == (verdict or r.u_verdict) and r.u_verdict in ("allow", "block")
    assert judge_urls(spark.createDataFrame(rows, "page_id int, url string, host string").where("false"), rules=RULES).count() == 0


def test_templates_generalise_merge_and_reject(spark):
    bad = [(f"http://s.com/deal/{i}/buy", True) for i in range(40)] + [(f"http://s.com/deal/{i}/buy", None) for i in range(40, 80)]
    good = [(f"http://s.com/{w}/{i}.html", False) for w in ("news", "sport") for i in range(30)] + [(f"http://s.com/user{i}x/page", None) for i in range(60)]
    names = [(f"http://s.com/{chr(97 + i % 26)}{chr(97 + i // 26)}/page", False) for i in range(60)]
    frame = spark.createDataFrame(bad + good + names, "url string, bad boolean")
    got = judge_urls(frame, rules=[], label=F.col("bad")).collect()
    assert {r.u_verdict for r in got if "/deal/" in r.url} == {"block"}
    assert {r.u_verdict for r in got if "/deal/" not in r.url} == {"allow"}
    assert {r.u_template for r in got if "/deal/" in r.url} == {"deal/{n}/buy/"}
    templates = Counter(r.u_template for r in got if r.url.endswith("/page"))
    assert templates == {"*/page//": 120}, templates


def test_siblings_merge_by_their_labels(spark):
    rows = [(f"http://m.com/{w}/{x}", bad) for w, bad in (("ads", True), ("deals", True), ("news", False), ("sport", False)) for x in ("x", "y") for _ in range(20)]
    rows += [("http://m.com/quiet/x", None)] * 20
    got = judge_urls(spark.createDataFrame(rows, "url string, bad boolean"), rules=[], label=F.col("bad")).collect()
    top = {r.u_path.split("/")[1]: r.u_template.split("/")[0] for r in got}
    assert top["ads"] == top["deals"] != top["news"] == top["sport"] and top["quiet"] == "quiet", top


def test_rates_follow_the_parents_and_silence_is_no_evidence(spark):
    rows = [(f"http://m.com/ads/{x}/1", True) for x in ("a", "b") for _ in range(20)] + [("http://m.com/ads/c/1", None)] * 20
    rows += [("http://m.com/news/a/1", False)] * 30 + [("http://bad.com/x/1", True)] * 30 + [("http://bad.com/other/1", None)] * 30
    got = {r.u_host + r.u_path: r for r in judge_urls(spark.createDataFrame(rows, "url string, bad boolean"), rules=[], label=F.col("bad")).collect()}
    assert got["m.com/ads/c/1"].u_verdict == "block" and got["m.com/ads/c/1"].u_rate > 0.9
    assert got["bad.com/other/1"].u_verdict == "allow" and got["bad.com/x/1"].u_verdict == "block"
    assert got["m.com/news/a/1"].u_verdict == "allow"


def test_groups_of_alike_counts():
    assert alike(np.array([20.0, 10, 30, 40]), np.array([20.0, 10, 0, 1])).tolist() == [1, 1, 0, 0]
    assert alike(np.array([50.0, 50, 50]), np.array([0.0, 25, 50])).tolist() == [0, 1, 2]
    assert alike(np.array([7.0]), np.array([3.0])).tolist() == [0]


def test_the_tree_is_as_deep_as_its_paths(spark):
    rows = [(f"http://m.com/a/b/c/{w}/{i}", w == "ads") for w in ("ads", "news") for i in range(20)] + [("http://m.com/a/b/c", None), ("http://m.com/a/b/c/", None), ("http://m.com/q/w/e/r/t/y", None)]
    got = {r.u_path: r for r in judge_urls(spark.createDataFrame(rows, "url string, bad boolean"), rules=[], label=F.col("bad")).collect()}
    assert (got["/a/b/c/ads/1"].u_verdict, got["/a/b/c/news/1"].u_verdict) == ("block", "allow")
    assert got["/a/b/c/ads/1"].u_template == "a/b/c/ads/{n}" and got["/q/w/e/r/t/y"].u_template == "*/w/e/r/t/y"
    assert got["/a/b/c"].u_template == got["/a/b/c/"].u_template == "a/b/c/"
