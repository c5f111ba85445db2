"""Queries over pages, verdicts and costs, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillforge.operators import audit as a
from quillforge.operators import checks as k
from quillforge.operators import pages as p
from quillforge.plans import oracle as o
from quillforge.plans import tournament as t

#: Words to a line and lines to a page of the synthetic page texts; the candidate of every third document lacks the words from the first to the second of these.
WRAP, PER_PAGE, GAP_FROM, GAP_TO = 12, 6, 100, 400


def lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of each document as source and as candidate."""
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    cut = F.concat(F.slice("w", 1, GAP_FROM), F.slice("w", GAP_TO + 1, 1_000_000_000))
    rows = t.docs(spark, d).select("doc_id", words.alias("w"))
    candidate = F.when(F.pmod("doc_id", F.lit(3)) == 0, cut).otherwise(F.col("w"))
    sides = F.array(F.struct(F.lit("source").alias("side"), F.array_join("w", " ").alias("text")), F.struct(F.lit("candidate").alias("side"), F.array_join(candidate, " ").alias("text")))
    return p.page_lines(rows.select("doc_id", F.inline(sides)), WRAP, PER_PAGE)


def _anchors(spark: SparkSession, d: str) -> DataFrame:
    return p.anchors(p.tokens(p.pages(lines(spark, d).where("side = 'source'"))))


def _matches(spark: SparkSession, d: str) -> DataFrame:
    return p.page_matches(_anchors(spark, d), p.pages(lines(spark, d)))


def violations(spark: SparkSession, d: str) -> DataFrame:
    """Two windows' findings for each check that a candidate doesn't pass."""
    confidence = F.create_map(*[F.lit(x) for n, c in k.CHECKS.items() for x in (n, c[5])])
    found = t.check_entries(spark, d).where("status <> 'pass'").withColumn("confidence", confidence[F.col("check_name")])
    rows = found.select("*", F.explode(F.array(F.lit(1), F.lit(2))).alias("w"))
    text = F.concat(F.lit("Check "), F.col("check_name"))
    return rows.select(
        "doc_id", "adapter", (F.col("at") * 2 + F.col("w")).alias("ord"), F.col("violation").alias("type"), "severity", F.col("issues").alias("count"),
        F.array(F.col("w"), (F.col("w") + F.pmod("doc_id", F.lit(3))).cast("int")).alias("pages"), "confidence",
        F.when(F.col("w") == 1, text).otherwise(F.upper(F.replace(text, F.lit(" "), F.lit("  ")))).alias("evidence"), F.col("violation").alias("cause"),
    )


def usage(spark: SparkSession, d: str) -> DataFrame:
    models = F.array(*(F.struct(F.lit(x).alias("provider"), F.lit(m).alias("model")) for x, m in MODELS))
    rows = spark.read.parquet(f"{d}/conversations.parquet").select((F.col("conv_id") * 1000 + F.col("turn")).alias("call_id"), F.length("text").cast("long").alias("n"))
    rows = rows.withColumn("m", models[F.pmod("call_id", F.lit(len(MODELS))).cast("int")])
    return rows.select("call_id", "m.provider", "m.model", (F.col("n") * 37).alias("input_tokens"), (F.col("n") * 5 + 1).alias("output_tokens"))


MODELS = [("openai", "gpt-5.1-codex-mini-1"), ("openai", "gpt-5.1-codex"), ("claude", "claude-haiku-4-5-x"), ("claude", "unknown"), ("deepseek", "deepseek-chat"), ("local", "any")]
NAMES = ["qwen3.6-35b-a3b", "org/mixtral-8x7b-instruct", "llama-3.1-8b", "moe-a1.5b", "plain-13b-chat", "x/8x22b", "gpt-4o", "deepseek-r1:70b", "phi-3.5-mini", "v1.5b", "a3b-8x7b"]


def _evidence(spark: SparkSession, d: str) -> DataFrame:
    """At most eight chunks of each text at equal distances, trimmed."""
    from quillforge.functions.text import evenly_spaced, let

    chunks = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")
    rows = t.docs(spark, d).select("doc_id", chunks.alias("c"))
    picked = let(evenly_spaced(F.size("c"), 8), lambda at: F.transform(at, lambda i: F.struct(i.alias("at"), F.get("c", i).alias("chunk"))))
    trimmed = F.when(F.length("x.chunk") <= 240, F.col("x.chunk")).otherwise(F.concat(F.rtrim(F.left("x.chunk", F.lit(237))), F.lit("...")))
    return rows.select("doc_id", F.explode(picked).alias("x")).select("doc_id", F.col("x.at").cast("long").alias("chunk_index"), trimmed.alias("chunk"))


QUERIES = {
    "page_lines": lambda s, d: lines(s, d).groupBy("doc_id", "side", "page").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.length("line")).alias("chars")),
    "repeated_lines": lambda s, d: p.repeated_lines(lines(s, d)),
    "doc_frequency": lambda s, d: p.tokens(p.pages(lines(s, d).where("side = 'source'"))).groupBy("doc_id", "token").agg(F.count(F.lit(1)).alias("pages")),
    "anchors_top18": _anchors,
    "page_match": _matches,
    "page_clusters": lambda s, d: p.clusters(_matches(s, d)),
    "merge_violations": lambda s, d: a.merge_violations(violations(s, d)),
    "clip_pages": lambda s, d: violations(s, d).select("doc_id", "adapter", "ord", a.clip_pages(F.col("pages"), F.lit(2), F.lit(3)).alias("pages")),
    "penalties": lambda s, d: a.penalties(a.merge_violations(violations(s, d))),
    "audit_outcomes": lambda s, d: a.audits(t.ranked(s, d), a.penalties(a.merge_violations(violations(s, d)))),
    "remediation_hints": lambda s, d: a.hints(a.merge_violations(violations(s, d)), s).select("doc_id", "adapter", "type", "severity", "count", "fix_area"),
    "cost_estimate": lambda s, d: a.costs(usage(s, d), s).withColumn("usd", F.col("usd").cast("double")),
    "model_sizes": lambda s, d: s.createDataFrame([(n,) for n in NAMES], "model string").select("model", a.model_size(F.col("model")).alias("billions")),
    "evidence_samples": _evidence,
}

_EXPERTS = f"'{a.EDGE}([0-9]+)x([0-9.]+)b{a.AFTER}'"
_SECOND = "string_split(regexp_extract(lower(model), '([^/]*)$', 1), '-')[2]"
_NUM = lambda of, pattern, group=1: f"TRY_CAST(regexp_extract({of}, {pattern}, {group}) AS DOUBLE)"
_SIZE = f"""coalesce({_NUM(_SECOND, "'^([0-9]+)x([0-9.]+)b$'")} * {_NUM(_SECOND, "'^([0-9]+)x([0-9.]+)b$'", 2)}, {_NUM(_SECOND, "'^a?([0-9.]+)b$'")}, {_NUM('lower(model)', _EXPERTS)} * {_NUM('lower(model)', _EXPERTS, 2)},
  {_NUM('lower(model)', f"'{a.EDGE}a([0-9.]+)b{a.AFTER}'")}, {_NUM('lower(model)', f"'{a.EDGE}([0-9][0-9.]*)b{a.AFTER}'")})"""

_W = "list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')"
_PAGES = f"""
sw AS (SELECT doc_id, {_W} AS w FROM documents),
sides AS (
  SELECT doc_id, 'source' AS side, w FROM sw UNION ALL
  SELECT doc_id, 'candidate', CASE WHEN doc_id % 3 = 0 THEN list_concat(w[1:{GAP_FROM}], w[{GAP_TO + 1}:]) ELSE w END FROM sw
),
lines AS (
  SELECT doc_id, side, CAST(pos AS INTEGER) AS pos, array_to_string(w[pos * {WRAP} + 1 : pos * {WRAP} + {WRAP}], ' ') AS line, CAST(pos // {PER_PAGE} + 1 AS INTEGER) AS page
  FROM (SELECT *, unnest(range(0, (len(w) + {WRAP - 1}) // {WRAP})) AS pos FROM sides)
),
pages_ AS (SELECT doc_id, side, page, string_agg(line, ' ' ORDER BY pos) AS text FROM lines GROUP BY ALL),
tokens AS (
  SELECT doc_id, side, page, token FROM (SELECT doc_id, side, page, unnest(list_distinct(list_transform(regexp_extract_all(text, '{p.TOKEN}'), lambda x: lower(x)))) AS token FROM pages_)
  WHERE NOT list_contains({p.STOP_WORDS}, token)
),
anchors AS (
  SELECT * FROM (SELECT doc_id, page, token, pages, CAST(row_number() OVER (PARTITION BY doc_id, page ORDER BY pages, length(token) DESC, token) AS INTEGER) AS n
    FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, token) AS pages FROM tokens WHERE side = 'source')) WHERE n <= {p.ANCHORS}
)"""
_MATCH = f"""{_PAGES},
sizes AS (SELECT doc_id, count(*) FILTER (side = 'source') AS s, count(*) FILTER (side = 'candidate') AS c FROM pages_ GROUP BY 1),
wanted AS (SELECT doc_id, page, list(token) AS tokens FROM anchors GROUP BY ALL),
near AS (
  SELECT w.doc_id, w.page, x.page AS candidate_page, CAST(len(list_filter(tokens, lambda k: contains(lower(x.text), k))) AS INTEGER) AS matched, CAST(len(tokens) AS INTEGER) AS anchors
  FROM (SELECT *, greatest(1, round_even(page::DOUBLE / s * c, 0)) AS e, greatest({p.LEAST_RADIUS}, round_even(c::DOUBLE / s * {p.RADIUS_PAGES}, 0)) AS r FROM wanted JOIN sizes USING (doc_id) WHERE s > 0 AND c > 0) w
  JOIN pages_ x ON x.doc_id = w.doc_id AND x.side = 'candidate' AND x.page BETWEEN greatest(1, e - r) AND least(c, e + r)
),
matches AS (
  SELECT doc_id, page AS source_page, candidate_page, matched, anchors, matched::DOUBLE / anchors AS coverage
  FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY matched DESC, candidate_page) AS n FROM near) WHERE n = 1
)"""
_CONFIDENCE = "MAP {" + ", ".join(f"'{n}': {c[5]}::DOUBLE" for n, c in k.CHECKS.items()) + "}"
_VIOLATIONS = f"""{o.SCORED},
found AS (SELECT doc_id, adapter, unnest(range(1, len(checks) + 1)) AS i, unnest(checks) AS x FROM checked),
violations AS (
  SELECT doc_id, adapter, CAST((i - 1) * 2 + w AS INTEGER) AS ord, x.violation AS type, x.severity AS severity, x.issues AS count, [w::INTEGER, (w + doc_id % 3)::INTEGER] AS pages, confidence,
    CASE WHEN w = 1 THEN 'Check ' || x.name ELSE upper(replace('Check ' || x.name, ' ', '  ')) END AS evidence, x.violation AS cause
  FROM (SELECT *, {_CONFIDENCE}[x.name] AS confidence, unnest([1, 2]) AS w FROM found WHERE x.status <> 'pass')
),
merged AS (
  SELECT doc_id, adapter, type, severity, CAST(sum(greatest(count, 1)) AS BIGINT) AS count, list_sort(list_distinct(flatten(list(pages)))) AS pages, max(confidence) AS confidence, arg_min(evidence, ord) AS evidence, min(ord) AS ord
  FROM violations GROUP BY doc_id, adapter, type, severity, lower(trim(regexp_replace(cause, '\\s+', ' ', 'g'))), lower(trim(regexp_replace(evidence, '\\s+', ' ', 'g')))
),
penalties AS (
  SELECT doc_id, adapter, CAST(sum((CASE severity WHEN 'critical' THEN 25.0 WHEN 'major' THEN 12.0 WHEN 'minor' THEN 3.0 ELSE 0 END) * greatest(count, 1)) AS DOUBLE) AS penalty, bool_or(severity IN ('critical', 'major')) AS serious FROM merged GROUP BY ALL
)"""
_HINTS = "MAP {" + ", ".join(f"'{x}': '{y}'" for x, y in a.HINT_AREAS.items()) + "}"
_PRICES = ", ".join(f"({i}, '{x}', '{m}', {y}::DECIMAL(18,6), {z}::DECIMAL(18,6))" for i, (x, m, y, z) in enumerate(a.PRICES))
_MODELS = "[" + ", ".join(f"{{'provider': '{x}', 'model': '{m}'}}" for x, m in MODELS) + "]"

ORACLE_SQL = {
    "page_lines": f"WITH {_PAGES} SELECT doc_id, side, page, count(*) AS lines, CAST(sum(length(line)) AS BIGINT) AS chars FROM lines GROUP BY ALL",
    "repeated_lines": f"WITH {_PAGES} SELECT doc_id, side, line, count(DISTINCT page) AS pages FROM lines WHERE length(line) <= {p.SHORT_LINE} AND NOT starts_with(line, '#') GROUP BY ALL HAVING count(DISTINCT page) >= {p.REPEATED_PAGES}",
    "doc_frequency": f"WITH {_PAGES} SELECT doc_id, token, count(*) AS pages FROM tokens WHERE side = 'source' GROUP BY ALL",
    "anchors_top18": f"WITH {_PAGES} SELECT doc_id, page, token, pages, n FROM anchors",
    "page_match": f"WITH {_MATCH} SELECT * FROM matches",
    "page_clusters": f"WITH {_MATCH}, sus AS (SELECT *, coalesce(CAST(source_page - lag(source_page) OVER w > {p.CLUSTER_GAP} AS INTEGER), 1) AS fresh FROM matches WHERE coverage < {p.COVERAGE} WINDOW w AS (PARTITION BY doc_id ORDER BY source_page)), grp AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY doc_id ORDER BY source_page) AS BIGINT) AS cluster FROM sus) SELECT doc_id, cluster, min(source_page) AS first_page, max(source_page) AS last_page, count(*) AS pages, min(candidate_page) AS candidate_first, max(candidate_page) AS candidate_last FROM grp GROUP BY ALL",
    "merge_violations": f"WITH {_VIOLATIONS} SELECT * FROM merged",
    "clip_pages": f"WITH {_VIOLATIONS} SELECT doc_id, adapter, ord, CASE WHEN len(list_filter(pages, lambda x: x BETWEEN 2 AND 3)) > 0 THEN list_sort(list_distinct(list_filter(pages, lambda x: x BETWEEN 2 AND 3))) ELSE [2::INTEGER] END AS pages FROM violations",
    "penalties": f"WITH {_VIOLATIONS} SELECT * FROM penalties",
    "audit_outcomes": f"""WITH {_VIOLATIONS}, au AS (
        SELECT doc_id, adapter, rank, CASE WHEN coalesce(serious AND total_score + penalty > next_score, false) THEN 'rejected_major' WHEN coalesce(serious, false) THEN 'accepted_penalized_major' ELSE 'accepted' END AS audit
        FROM ranked LEFT JOIN penalties USING (doc_id, adapter) WHERE rank <= 3),
      fin AS (SELECT doc_id, arg_min(adapter, rank) FILTER (audit <> 'rejected_major') AS adapter, arg_min(audit, rank) FILTER (audit <> 'rejected_major') AS audit, min(rank) FILTER (audit <> 'rejected_major') AS pos, count(*) AS tried FROM au GROUP BY 1)
      SELECT doc_id, adapter, coalesce(audit, 'escalated') AS audit, CAST(coalesce(pos, tried) AS INTEGER) AS attempts FROM fin""",
    "remediation_hints": f"WITH {_VIOLATIONS} SELECT doc_id, adapter, type, severity, count, coalesce({_HINTS}[type], '{a.DEFAULT_HINT}') AS fix_area FROM merged",
    "cost_estimate": f"""WITH u AS (SELECT call_id, {_MODELS}[call_id % {len(MODELS)} + 1] AS m, length(text) AS n FROM (SELECT conv_id * 1000 + turn AS call_id, text FROM conversations)),
      pr(ord, provider, prefix, a, b) AS (VALUES {_PRICES}),
      f AS (SELECT call_id, u.m.model AS model, n * 37 AS i, n * 5 + 1 AS o, pr.* FROM u LEFT JOIN pr ON pr.provider = u.m.provider AND starts_with(u.m.model, pr.prefix))
      SELECT call_id, model, CAST(round(i::DECIMAL(18,0) * a + o::DECIMAL(18,0) * b, 0) AS DOUBLE) / 1000000 AS usd FROM f QUALIFY row_number() OVER (PARTITION BY call_id ORDER BY ord) = 1""",
    "model_sizes": f"SELECT model, {_SIZE} AS billions FROM (VALUES {', '.join(f"('{n}')" for n in NAMES)}) AS t(model)",
    "evidence_samples": """WITH c AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> '') AS c FROM documents),
      i AS (SELECT doc_id, c, unnest(CASE WHEN len(c) <= 8 THEN range(0, len(c)) ELSE list_distinct(list_transform(range(0, 8), lambda i: CAST(round_even(i * (len(c) - 1) / 7.0::DOUBLE, 0) AS BIGINT))) END) AS pos FROM c)
      SELECT doc_id, pos AS chunk_index, CASE WHEN length(c[pos + 1]) <= 240 THEN c[pos + 1] ELSE rtrim(left(c[pos + 1], 237)) || '...' END AS chunk FROM i""",
}
