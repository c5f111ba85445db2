"""URL filter by a path-template tree for each host.

A path is a branch of typed segments.  At every depth, sibling branches whose
labels agree statistically are merged into one, and of those with too few labels
for that the ones that vary too much under one parent become a wildcard.  A
template is rejected if the labels that reach it, smoothed towards those of its
parents in the tree, host, domain and all pages, are mostly bad, and if there are
any below its first segment.  All counts are grouped aggregates over typed paths, so a host
with a third of all pages is a few rows after the first, partial, aggregation.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillforge.llm.shared import cut

#: Slashes that a template has at least; the tree is as deep as its paths.
SLASHES = 3
#: Distinct children from which a node's segments are taken to be variable.
VARIABLE = 24
#: Pseudo-counts by which a rate is drawn towards its parent's; the rate from which a template is rejected; deviation that parts siblings.
SMOOTHING, REJECT, DEVIATION = 5.0, 0.5, 1.96
#: Labels from which a segment is compared with its siblings; with fewer it is where they set it apart from its parent.
TELLING = 5

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (verdict, host, start of the path)
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    raw = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(raw) + 1), "^[^?#]*", 0)
    return F.coalesce(F.translate(raw, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def rule_for(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, as host and path in one string, and its verdict; nulls if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):  # later, longer ones take precedence
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def typed_segment(segment: Column) -> Column:
    """A segment with what varies by kind in place of itself: numbers, hexadecimal ids, dates, and names that mix letters with digits."""
    extension = F.regexp_extract(segment, r"(\.[A-Za-z]{1,5})$", 1)
    stem = F.substr(segment, F.lit(1), F.length(segment) - F.length(extension))
    kind = (
        F.when(stem.rlike(r"^[0-9]{4}-[0-9]{2}(-[0-9]{2})?$"), "{date}")
        .when(stem.rlike(r"^[0-9]+$"), "{n}")
        .when(stem.rlike(r"^[0-9a-fA-F-]{8,}$") & stem.rlike("[0-9]"), "{hex}")
        .when(stem.rlike(r"[0-9]") & (F.length(stem) >= 4), "{mixed}")
        .when(F.length(stem) > 32, "{long}")
        .otherwise(stem)
    )
    return F.when(F.length(segment) > 0, F.concat(kind, extension)).otherwise(F.lit(""))


def typed_path(path: Column) -> Column:
    """The typed segments, joined by "/", without empty ones at the end."""
    parts = F.split(F.regexp_replace(path, "^/", ""), "/")
    return F.regexp_replace(F.array_join(F.transform(parts, typed_segment), "/"), "/+$", "")


def _domain(host: Column) -> Column:
    return F.regexp_extract(host, r"([^.]+\.[^.]+|[^.]+)$", 1)


def alike(labelled: np.ndarray, bad: np.ndarray, deviation: float = DEVIATION) -> np.ndarray:
    """Numbers of the groups that rows with these counts form: neighbours by rate are merged, the most alike first, until all differ."""
    rates, group = np.unique(bad / labelled, return_inverse=True)
    lab, bads = np.bincount(group, labelled), np.bincount(group, bad)
    end = np.arange(len(rates))  # the groups are runs of rates; for each its last one
    while len(lab) > 1:
        rate = (bads[1:] + bads[:-1] + 1) / (lab[1:] + lab[:-1] + 2)
        z = (bads[1:] / lab[1:] - bads[:-1] / lab[:-1]) / np.sqrt(rate * (1 - rate) * (1 / lab[1:] + 1 / lab[:-1]))
        # each that is more alike than its neighbours are: merges that don't touch go at once
        low = (z <= deviation) & (z < np.append(np.inf, z[:-1])) & (z <= np.append(z[1:], np.inf))
        if not low.any():
            break
        first = ~np.append(False, low)
        starts = np.flatnonzero(first)
        lab, bads, end = np.add.reduceat(lab, starts), np.add.reduceat(bads, starts), end[np.append(starts[1:], len(end)) - 1]
    return np.searchsorted(end, group)


def _groups(frame: pd.DataFrame) -> pd.DataFrame:
    g = alike((frame["labelled"] * frame["m"]).to_numpy(float), (frame["bad"] * frame["m"]).to_numpy(float))
    return frame[["host", "node", "labelled", "bad"]].assign(g=g.astype(np.int32))


def _named(nodes: DataFrame, variable: int) -> DataFrame:
    """nodes (host, node, s, n, labelled, bad) with t, the branch below node that s goes to."""
    # a grouped sum and a join, which can be split, and not a window: a node may have very many children
    above = nodes.groupBy("host", "node").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("children"), F.sum("labelled").alias("lab"), F.sum("bad").alias("all_bad"))
    nodes = nodes.join(above, ["host", "node"])
    rate = (F.col("all_bad") + 1) / (F.col("lab") + 2)
    away = F.abs(F.col("bad") - F.col("labelled") * rate) / F.sqrt(F.greatest(F.col("labelled") * rate * (1 - rate), F.lit(1e-9)))
    telling = (F.col("s") != "") & (F.col("labelled") > 0) & ((F.col("labelled") >= TELLING) | (away > DEVIATION))
    nodes = cut(nodes.select("*", telling.alias("telling")))
    # siblings with equal counts are one row of the test
    equal = nodes.where("telling").groupBy("host", "node", "labelled", "bad").agg(F.count(F.lit(1)).alias("m"))
    kind = nodes.schema
    groups = equal.groupBy("host", "node").applyInPandas(_groups, f"host string, node string, labelled {kind['labelled'].dataType.simpleString()}, bad {kind['bad'].dataType.simpleString()}, g int")
    member = nodes.where("telling").join(groups, ["host", "node", "labelled", "bad"])
    names = member.groupBy("host", "node", "labelled", "bad", "g").agg(F.min("s").alias("least"), F.count(F.lit(1)).alias("m"))
    within = Window.partitionBy("host", "node", "g")
    names = names.select("host", "node", "labelled", "bad", F.lit(True).alias("telling"), F.min("least").over(within).alias("least"), F.sum("m").over(within).alias("m"))
    group = F.when(F.col("m") > 1, F.concat(F.lit("{"), "least", F.lit("|*}"))).otherwise(F.col("s"))
    few = F.when(F.col("s") == "", F.lit("")).when(F.col("children") > variable, F.lit("*")).when(F.col("n") * variable < F.col("total"), F.lit("*")).otherwise(F.col("s"))
    return nodes.join(names, ["host", "node", "labelled", "bad", "telling"], "left").select("host", "node", "s", "n", "labelled", "bad", "last", "paths", "total", F.when(F.col("telling"), group).otherwise(few).alias("t"))


def host_rates(paths: DataFrame, smoothing: float = SMOOTHING) -> DataFrame:
    """host, rate: the share of bad labels, smoothed downwards from all pages over the domain."""
    counts = [F.sum(c).alias(c) for c in ("n", "labelled", "bad")]
    hosts = paths.groupBy("host").agg(*counts).withColumn("domain", _domain(F.col("host")))
    domains = hosts.groupBy("domain").agg(*counts)
    everything = domains.agg(((F.coalesce(F.sum("bad"), F.lit(0)) + 1) / (F.coalesce(F.sum("labelled"), F.lit(0)) + 2)).alias("rate"))
    smooth = lambda up: (F.col("bad") + smoothing * up) / (F.col("labelled") + smoothing)
    prior = everything.select(F.col("rate").alias("up"))
    domains = domains.join(F.broadcast(prior)).select("domain", smooth(F.col("up")).alias("up"))  # one row beside each domain
    return hosts.join(domains, "domain").select("host", smooth(F.col("up")).alias("rate"))


def build_tree(paths: DataFrame, variable: int = VARIABLE, smoothing: float = SMOOTHING) -> DataFrame:
    """paths: host, path (typed), n, labelled, bad; one row for each.  Its host, path, template, the tree's branch for it, rate, the share
    of bad labels smoothed along that branch, and evidence, whether there are labels below the branch's first segment.

    A branch ends where it holds one path only, which is then kept as it is, or no path goes on.
    """
    paths = cut(paths)
    live = cut(paths.join(host_rates(paths, smoothing), "host").select(*paths.columns, F.lit("").alias("node"), "rate", F.lit(False).alias("evidence")))
    ended, k = None, 0
    while ended is None or not live.isEmpty():
        parts = F.split("path", "/")
        live = live.withColumn("s", F.coalesce(F.get(parts, F.lit(k)), F.lit("")))
        nodes = live.groupBy("host", "node", "s").agg(*(F.sum(c).alias(c) for c in ("n", "labelled", "bad")), F.max(F.size(parts)).alias("last"), F.count(F.lit(1)).alias("paths"))
        named = cut(_named(nodes, variable))
        branches = named.groupBy("host", "node", "t").agg(*(F.sum(c).alias(c) for c in ("labelled", "bad", "paths")), F.sum("n").alias("rows"), F.max("last").alias("last"), F.max("total").alias("total"))
        ends = branches.select("host", "node", "t", F.col("labelled").alias("below"), F.col("bad").alias("bad_below"), "rows", "total", ((F.col("paths") == 1) | (F.col("last") <= k + 1)).alias("ends"))
        live = live.join(named.select("host", "node", "s", "t"), ["host", "node", "s"]).join(ends, ["host", "node", "t"])
        # an only child has no labels but its parent's
        rate = F.when(F.col("rows") == F.col("total"), F.col("rate")).otherwise((F.col("bad_below") + smoothing * F.col("rate")) / (F.col("below") + smoothing))
        node = F.concat("node", *([F.lit("/")] if k else []), "t")
        live = cut(live.select(*paths.columns, node.alias("node"), rate.alias("rate"), (F.col("below") > 0 if k == 0 else F.col("evidence")).alias("evidence"), "ends"))
        rest = F.array_join(F.concat(F.array("node"), F.slice(F.split("path", "/"), k + 2, 1 << 30)), "/")
        short = F.regexp_replace(rest, "/+$", "")
        pad = F.repeat(F.lit("/"), F.greatest(F.lit(0), F.lit(SLASHES + 1) - F.size(F.split(short, "/"))))
        out = live.where("ends").select("host", "path", F.concat(short, pad).alias("template"), "rate", "evidence")
        ended = out if ended is None else ended.union(out)
        live = live.where("not ends").drop("ends")
        k += 1
    return ended


def judge_urls(pages: DataFrame, *, rules: list[tuple[str, str, str]], url_col: str = "url", label: Column | None = None, variable: int = VARIABLE, reject: float = REJECT, prefix: str = "u_") -> DataFrame:
    """pages and, named with `prefix`: host, path, rule, verdict, template, rate.

    A page that a rule fits has the rule's verdict and is a label for the tree, bad if blocked; `label`, a column that is true, false
    or null, gives labels in place of the rules.  Any other page has the verdict of its template: block from a smoothed rate of bad
    labels of `reject` if its branch has any labels, else allow.  A null url and one without "://" have an empty host and path.  Rows are neither merged nor
    dropped; columns that begin with `prefix` are replaced.
    """
    pages = pages.select(*[f"`{c}`" for c in pages.columns if not c.startswith(prefix)])
    own = [f"`{c}`" for c in pages.columns]
    host, path = host_and_path(F.col(f"`{url_col}`"))
    p = lambda x: F.col(f"{prefix}{x}")
    rows = pages.withColumns({f"{prefix}host": host, f"{prefix}path": path})
    rule, verdict = rule_for(p("host"), p("path"), rules)
    rows = rows.withColumns({f"{prefix}rule": rule, f"{prefix}ruled": verdict, f"{prefix}label": label if label is not None else verdict == "block"})
    keys = ["host", "typed"]
    rows = rows.withColumn(f"{prefix}typed", typed_path(p("path")))
    paths = rows.groupBy(*map(p, keys)).agg(F.count(F.lit(1)).alias("n"), F.count(p("label")).alias("labelled"), F.coalesce(F.sum(p("label").cast("long")), F.lit(0)).alias("bad"))
    tree = build_tree(paths.select(p("host").alias("host"), p("typed").alias("path"), "n", "labelled", "bad"), variable)
    rated = tree.select(*(F.col(c).alias(f"{prefix}{d}") for c, d in (("host", "host"), ("path", "typed"), ("template", "template"), ("rate", "rate"), ("evidence", "evidence"))))
    out = rows.join(rated, [f"{prefix}{k}" for k in keys])
    final = F.coalesce(p("ruled"), F.when(p("evidence") & (p("rate") >= reject), "block").otherwise("allow"))
    return out.select(*own, p("host"), p("path"), p("rule"), final.alias(f"{prefix}verdict"), p("template"), p("rate"))


def op2_path_templates(spark, sf_dir: str) -> DataFrame:
    judged = judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"), rules=RULES)
    return judged.select("page_id", *(F.col(f"u_{c}").alias(c) for c in ("host", "path", "rule", "verdict", "template")))


