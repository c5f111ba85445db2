"""Queries over PDF blocks, pages, judge answers and reports, and their SQL.  The inputs are synthetic and follow from the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillforge.operators import audit as a
from quillforge.operators import blocks as b
from quillforge.operators import pages as p
from quillforge.operators import reports as r
from quillforge.operators import responses as j
from quillforge.operators import traits as v
from quillforge.operators.traits import pdf_traits
from quillforge.plans import audits as u
from quillforge.plans import oracle as o
from quillforge.plans import tournament as t

FURNITURE = ["Running title", "12 JAN 2024", "**Source:** x", "17"]
SUFFIXES = [".PDF", ".docx", ".htm", ".txt", ".md", ".ODT", "", ".html", ".text"]
CHECKLIST = ["tables", "headings", "order"]
REQUESTED = ["gpt-4o", "no-such-model", "phi-3.5-mini", "another one"]


def text_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Four blocks to a page, of every kind in turn, from the lines of each document."""
    rows = F.filter(F.transform(F.split("text", "\n"), b.flat), lambda x: x != "")
    lines = t.docs(spark, d).select("doc_id", F.posexplode(rows).alias("ord", "l"))
    i, l = F.col("ord"), F.col("l")
    text, v = F.concat, F.pmod(F.col("doc_id") + i, F.lit(8))
    lit, n = F.lit, i.cast("string")
    body = (
        F.when(v == 0, text(lit("- "), F.left(l, lit(60)), lit("\n- next item "), n)).when(v == 1, text(F.left(l, lit(60)), lit(" | a | b"))).when(v == 2, text(lit("Section "), n, lit(" "), F.left(l, lit(30))))
        .when(v == 3, text(lit("Figure "), n, lit(". "), F.left(l, lit(40)))).when(v == 4, text(lit("1.\nfirst "), F.left(l, lit(20)), lit("\n2. \nsecond\n3) third"))).when(v == 5, "Running head").otherwise(l)
    )
    size = F.when(v == 2, 18 + F.pmod(i, lit(3)) * 0.5).when(v == 5, 16.2).otherwise(10.0)
    x0, y0 = F.when(i % 2 == 0, 50.0).otherwise(380.0), F.pmod(i, lit(4)) * 100.0
    return lines.select("doc_id", "ord", (F.floor(i / 4) + 1).cast("int").alias("page"), x0.alias("x0"), y0.alias("y0"), (x0 + 200).alias("x1"), (y0 + 60).alias("y1"), body.alias("text"), size.cast("double").alias("avg_font_size"), lit(600.0).alias("page_width"))


def image_blocks(spark: SparkSession, d: str) -> DataFrame:
    pages = text_blocks(spark, d).select("doc_id", "page").distinct().where(F.pmod(F.col("doc_id") + F.col("page"), F.lit(2)) == 0)
    y, wide = F.pmod("doc_id", F.lit(3)) * 100.0 + 20, 100.0 + F.pmod("page", F.lit(5)) * 37
    one = lambda k, x0, y0: F.struct((F.col("page") * 2 + k).cast("int").alias("ord"), F.lit(x0).alias("x0"), y0.alias("y0"), (F.lit(x0) + wide).alias("x1"), (y0 + 50).alias("y1"))
    both = F.when(F.col("page") % 3 == 0, F.array(one(0, 40.0, y), one(1, 360.0, y + 150))).otherwise(F.array(one(0, 40.0, y)))
    return pages.select("doc_id", "page", F.inline(both)).withColumns({"filename": F.concat(F.lit("images/i"), F.col("ord").cast("string"), F.lit(".png")), "page_width": F.lit(600.0)})


def _kinds(spark: SparkSession, d: str) -> DataFrame:
    return b.classified(text_blocks(spark, d))


def furnished(spark: SparkSession, d: str) -> DataFrame:
    """The page lines with what pages carry besides: a running title, a date, a source line, a number, and the page's count."""
    lines = u.lines(spark, d)
    extra = F.array(*map(F.lit, FURNITURE), F.concat(F.lit("Page "), F.col("page").cast("string"), F.lit(" of 9")))
    return lines.unionByName(lines.select("doc_id", "side", "page").distinct().select("doc_id", "side", "page", F.posexplode(extra).alias("k", "line")).select("doc_id", "side", (-1 - F.col("k")).alias("pos"), "line", "page"))


def sizes(spark: SparkSession, d: str) -> DataFrame:
    of = lambda side: F.coalesce(F.max(F.when(F.col("side") == side, F.col("page"))), F.lit(0))
    return u.lines(spark, d).groupBy("doc_id").agg(of("source").alias("s"), of("candidate").alias("c"))


def calls(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/conversations.parquet").select((F.col("conv_id") * 1000 + F.col("turn")).alias("call_id"), F.length("text").cast("long").alias("n"))


def _pick(values: list, by: Column) -> Column:
    return F.array(*map(F.lit, values))[F.pmod(by, F.lit(len(values))).cast("int")]


def attempts(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("n")
    level = _pick([1, 2, 4], n)
    return calls(spark, d).select("call_id", level.alias("concurrency"), (n % 7 != 0).alias("succeeded"), (n % 1000 / 100).alias("elapsed_s"), (n * 37).alias("input_tokens"), (n * 5 + 1).alias("output_tokens"), F.least(level, (n % 4 + 1).cast("int")).alias("active_calls"))


def probes(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("n")
    rows = calls(spark, d).withColumn("model", _pick(u.NAMES, F.col("call_id") + n))
    rep = F.row_number().over(Window.partitionBy("model").orderBy("call_id"))
    return rows.select("model", rep.alias("rep"), ((n % 5 != 0) | (F.length("model") > 11)).alias("passed"), (n % 900 / 100).alias("latency_s"), n.alias("tokens"))


def responses(spark: SparkSession, d: str) -> DataFrame:
    """Answers in and out of fences, with text around them, cut short, and without any object."""
    n = F.col("n").cast("string")
    body = F.concat(F.lit('{"preferred": "'), _pick(["inhouse", "other"], F.col("n")), F.lit('", "confidence": "high", "tables": "Yes", "headings": '), F.when(F.col("n") % 2 == 0, "true").otherwise("false"), F.lit(', "violations": [{"type": "reading_order", "count": '), n, F.lit(', "pages": [1, 2.0, "x"]}]}'))
    raw = F.when(F.col("n") % 5 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(F.col("n") % 5 == 1, F.concat(F.lit("Here it is: "), body, F.lit(" done."))).when(F.col("n") % 5 == 2, F.lit("no object")).when(F.col("n") % 5 == 3, F.left(body, F.length(body) - 2)).otherwise(body)
    return calls(spark, d).select("call_id", "n", raw.alias("raw"))


def _tasks(spark: SparkSession, d: str) -> DataFrame:
    found = a.merge_violations(u.violations(spark, d)).where("severity = 'major'")
    return found.select("doc_id", "adapter", "ord", F.concat(F.lit("Fix "), F.col("type")).alias("task"), F.when(F.pmod("doc_id", F.lit(2)) == 0, "source").otherwise(F.col("adapter")).alias("compare_against"))


def _examples(spark: SparkSession, d: str) -> DataFrame:
    return t.docs(spark, d).select("doc_id", r.bounded_examples(F.split("text", "\n")).alias("examples"))


def _current(spark: SparkSession, d: str) -> DataFrame:
    text, fixed = F.col("text"), F.concat("text", F.lit("."))
    recorded = F.when(F.pmod("doc_id", F.lit(3)) == 0, F.sha2(fixed, 256)).otherwise(F.sha2(text, 256))
    return t.docs(spark, d).select("doc_id", r.repair_is_current(text, fixed, F.sha2(text, 256), recorded, F.when(F.pmod("doc_id", F.lit(2)) == 0, "repair"), "repair").alias("current"))


_MATRIX = ["bucket", "adapter", "attempts", "total_pages", "wins"]

QUERIES = {
    "block_kinds": lambda s, d: _kinds(s, d).select("doc_id", "ord", "page", "kind", "caption"),
    "block_order": lambda s, d: _kinds(s, d).select("doc_id", "ord", F.round("page_mean", 6).alias("page_mean"), "column", "y_mid"),
    "running_headers": lambda s, d: b.running_headers(_kinds(s, d)),
    "heading_levels": lambda s, d: b.heading_levels(b.without_running(_kinds(s, d))),
    "caption_images": lambda s, d: b.caption_images(_kinds(s, d), image_blocks(s, d)),
    "block_markdown": lambda s, d: b.rendered(b.without_running(_kinds(s, d))).select("doc_id", "ord", "md"),
    "pdf_traits": lambda s, d: pdf_traits(_kinds(s, d), image_blocks(s, d)),
    "pdf_to_markdown": lambda s, d: b.assembled(text_blocks(s, d), image_blocks(s, d)),
    "source_formats": lambda s, d: s.read.parquet(f"{d}/pages.parquet").select("page_id", F.concat(F.lit("Dir.x/file"), _pick(SUFFIXES, F.col("page_id"))).alias("path")).select("page_id", r.source_format(F.col("path")).alias("format")),
    "normal_pages": lambda s, d: r.normal_lines(furnished(s, d)).groupBy("doc_id", "side", "page").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.length("line")).alias("chars")),
    "audit_windows": lambda s, d: r.audit_windows(sizes(s, d)),
    "issue_windows": lambda s, d: r.issue_windows(u._matches(s, d), sizes(s, d), p.COVERAGE, p.CLUSTER_GAP),
    "concurrency_summary": lambda s, d: r.concurrency_summary(attempts(s, d)),
    "model_summary": lambda s, d: r.model_summary(probes(s, d)),
    "best_models": lambda s, d: r.best_models(r.model_summary(probes(s, d)), 3).select("model", "attempts"),
    "missing_models": lambda s, d: r.missing_names(s.createDataFrame([(n,) for n in REQUESTED], "name string"), s.createDataFrame([(n,) for n in u.NAMES], "name string")),
    "retry_delays": lambda s, d: calls(s, d).select("call_id", j.retry_delay(F.when(F.col("n") % 3 == 0, F.concat(F.lit(" "), (F.col("n") % 50 - 5).cast("string"))).when(F.col("n") % 3 == 1, "soon"), F.col("n") % 4 + 1).alias("seconds")),
    "json_spans": lambda s, d: responses(s, d).select("call_id", j.json_span(j.unfenced(F.col("raw"))).alias("span")),
    "checklists": lambda s, d: responses(s, d).where("n % 5 in (0, 1, 4)").select("call_id", j.checklist(F.col("raw"), CHECKLIST).alias("x")).select("call_id", "x.*"),
    "verdicts": lambda s, d: j.verdicts(responses(s, d), ["inhouse"]),
    "probe_decisions": lambda s, d: calls(s, d).select("call_id", j.probe_passes(F.col("n") % 14, F.col("n") % 3, 13).alias("checklist"), j.freeform_passes(F.col("n") % 9, F.col("n") % 5).alias("freeform")),
    "remediation_plans": lambda s, d: r.remediation_plans(_tasks(s, d)),
    "bounded_examples": _examples,
    "repair_trust": _current,
    "matrix_markdown": lambda s, d: r.markdown_rows(t.matrix(s, d), _MATRIX).select(r.bucket_place(F.col("bucket")).cast("int").alias("place"), "line"),
    "result_documents": lambda s, d: r.result_documents(t.runs(s, d)),
}
#: Queries whose folds, formats or parsers SQL can't express.
WITHOUT_SQL = ("pdf_to_markdown", "issue_windows", "verdicts", "result_documents")

q = o.q
_FLAT = lambda x: f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"
_ROWS = "list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '')"
_BLOCKS = f"""
kept AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: {_FLAT('x')}), lambda x: x <> '') AS ls FROM documents),
flatrows AS (SELECT doc_id, unnest(range(0, len(ls))) AS i, unnest(ls) AS l FROM kept),
tb AS (
  SELECT doc_id, CAST(i AS INTEGER) AS ord, CAST(i // 4 + 1 AS INTEGER) AS page, CASE WHEN i % 2 = 0 THEN 50.0::DOUBLE ELSE 380.0 END AS x0, (i % 4) * 100.0::DOUBLE AS y0, 600.0::DOUBLE AS page_width,
    CASE v WHEN 0 THEN '- ' || left(l, 60) || chr(10) || '- next item ' || i WHEN 1 THEN left(l, 60) || ' | a | b' WHEN 2 THEN 'Section ' || i || ' ' || left(l, 30) WHEN 3 THEN 'Figure ' || i || '. ' || left(l, 40)
      WHEN 4 THEN '1.' || chr(10) || 'first ' || left(l, 20) || chr(10) || '2. ' || chr(10) || 'second' || chr(10) || '3) third' WHEN 5 THEN 'Running head' ELSE l END AS text,
    CASE v WHEN 2 THEN 18 + (i % 3) * 0.5::DOUBLE WHEN 5 THEN 16.2::DOUBLE ELSE 10.0::DOUBLE END AS size
  FROM (SELECT *, (doc_id + i) % 8 AS v FROM flatrows)
),
kinds AS (
  SELECT *, CASE WHEN len({_ROWS}) = 0 THEN 'paragraph' WHEN len(list_filter({_ROWS}, lambda x: NOT regexp_matches(x, {q(b.LIST_MARK)}))) = 0 THEN 'list' WHEN length(trim(text)) - length(replace(trim(text), '|', '')) >= 2 THEN 'table'
      WHEN size > page_mean * {b.HEADING_RATIO} AND length(trim(text)) < {b.HEADING_CHARS} THEN 'heading' WHEN len(list_filter({_ROWS}, lambda x: regexp_matches(x, {q(b.NUMBER_ONLY)}))) >= 2 THEN 'numbered_list' ELSE 'paragraph' END AS kind,
    regexp_matches(trim(text), {q(b.CAPTION)}) AS caption, CAST(x0 > page_width * {b.COLUMN_RATIO} AS INTEGER) AS col, y0 + 30 AS y_mid
  FROM (SELECT *, avg(size) OVER (PARTITION BY doc_id, page) AS page_mean FROM tb)
),
running AS (SELECT doc_id, lower({_FLAT('text')}) AS head, count(DISTINCT page) AS pages FROM kinds WHERE kind = 'heading' GROUP BY ALL HAVING count(DISTINCT page) >= {b.RUNNING_PAGES}),
clean AS (SELECT * FROM kinds k WHERE NOT (kind = 'heading' AND EXISTS (SELECT 1 FROM running r WHERE r.doc_id = k.doc_id AND r.head = lower({_FLAT('k.text')})))),
levels AS (SELECT doc_id, bucket, CAST(least(row_number() OVER (PARTITION BY doc_id ORDER BY bucket DESC), {b.MAX_LEVEL}) AS INTEGER) AS level FROM (SELECT DISTINCT doc_id, round_even(size * 2, 0) / 2 AS bucket FROM clean WHERE kind = 'heading')),
ib1 AS (SELECT DISTINCT doc_id, page FROM tb WHERE (doc_id + page) % 2 = 0),
ib AS (SELECT doc_id, page, page * 2 AS ord, 0 AS col, (doc_id % 3) * 100.0 + 45 AS mid FROM ib1 UNION ALL SELECT doc_id, page, page * 2 + 1, 1, (doc_id % 3) * 100.0 + 195 FROM ib1 WHERE page % 3 = 0)"""
_PIECE = f"CASE WHEN regexp_matches(x, {q(b.NUMBERED)}) THEN chr(10) || regexp_extract(x, {q(b.NUMBERED)}, 1) || '.' || CASE WHEN regexp_extract(x, {q(b.NUMBERED)}, 2) <> '' THEN ' ' || trim(regexp_extract(x, {q(b.NUMBERED)}, 2)) ELSE '' END ELSE ' ' || x END"
_JOINED = f"array_to_string(list_transform({_ROWS}, lambda x: {_PIECE}), '')"
_RENDERED = f"""CASE kind WHEN 'heading' THEN repeat('#', coalesce(level, 2)) || ' ' || {_FLAT('text')} || chr(10) WHEN 'numbered_list' THEN regexp_extract({_JOINED}, '(?s)\\n(.*)$', 1) || chr(10)
  WHEN 'list' THEN array_to_string(list_transform({_ROWS}, lambda x: '- ' || trim(regexp_replace(x, {q(b.LIST_MARK)}, ''))), chr(10)) || chr(10) WHEN 'table' THEN '```' || chr(10) || trim(text) || chr(10) || '```' || chr(10)
  ELSE CASE WHEN caption THEN '*' || {_FLAT('text')} || '*' || chr(10) ELSE {_FLAT('text')} || chr(10) END END"""
_CALLS = "SELECT conv_id * 1000 + turn AS call_id, length(text) AS n FROM conversations"
_BODY = """'{"preferred": "' || ['inhouse', 'other'][n % 2 + 1] || '", "confidence": "high", "tables": "Yes", "headings": ' || CASE WHEN n % 2 = 0 THEN 'true' ELSE 'false' END || ', "violations": [{"type": "reading_order", "count": ' || n || ', "pages": [1, 2.0, "x"]}]}'"""
_RAW = f"SELECT call_id, n, CASE n % 5 WHEN 0 THEN '```json' || chr(10) || body || chr(10) || '```' WHEN 1 THEN 'Here it is: ' || body || ' done.' WHEN 2 THEN 'no object' WHEN 3 THEN left(body, length(body) - 2) ELSE body END AS raw FROM (SELECT *, {_BODY} AS body FROM ({_CALLS}))"
_SPANS = f"SELECT call_id, n, CASE WHEN instr(t, '{{') = 0 THEN '' WHEN contains(t, '}}') AND length(t) - instr(reverse(t), '}}') + 1 > instr(t, '{{') THEN substr(t, instr(t, '{{'), length(t) - instr(reverse(t), '}}') + 2 - instr(t, '{{')) ELSE substr(t, instr(t, '{{')) END AS span FROM (SELECT *, {o._strip(f'''regexp_replace({o._strip('raw')}, '(?m)^```(?:json)?\\s*|\\s*```$', '', 'g')''')} AS t FROM ({_RAW}))"
_SIZES = "sizes AS (SELECT doc_id, coalesce(max(page) FILTER (side = 'source'), 0) AS s, coalesce(max(page) FILTER (side = 'candidate'), 0) AS c FROM lines GROUP BY 1)"
_MODEL = f"{[*u.NAMES]}[(call_id + n) % {len(u.NAMES)} + 1]"
_PROBES = f"SELECT model, n AS tokens, row_number() OVER (PARTITION BY model ORDER BY call_id) AS rep, n % 5 <> 0 OR length(model) > 11 AS passed, n % 900 / 100 AS latency FROM (SELECT *, {_MODEL} AS model FROM ({_CALLS}))"
_SUMMARY = f"SELECT model, count(*) AS attempts, count(*) FILTER (passed) AS pass_count, min_by(latency, rep) AS first_latency_s, coalesce(avg(latency) FILTER (rep > 1), avg(latency)) AS mean_answer_s, coalesce(max(latency) FILTER (rep > 1), max(latency)) AS max_answer_s, avg(latency) AS mean_latency_s, avg(tokens) AS mean_tokens FROM ({_PROBES}) GROUP BY 1"
_EXTRA = "[" + ", ".join(map(q, FURNITURE)) + ", 'Page ' || page || ' of 9']"

ORACLE_SQL = {
    "block_kinds": f"WITH {_BLOCKS} SELECT doc_id, ord, page, kind, caption FROM kinds",
    "block_order": f"WITH {_BLOCKS} SELECT doc_id, ord, round(page_mean, 6) AS page_mean, col AS column, y_mid FROM kinds",
    "running_headers": f"WITH {_BLOCKS} SELECT * FROM running",
    "heading_levels": f"WITH {_BLOCKS} SELECT * FROM levels",
    "caption_images": f"WITH {_BLOCKS} SELECT k.doc_id, k.page, k.ord, ib.ord AS image_ord, 'images/i' || ib.ord || '.png' AS filename FROM kinds k JOIN ib USING (doc_id, page) WHERE caption QUALIFY row_number() OVER (PARTITION BY k.doc_id, k.ord ORDER BY mid <= y_mid DESC, abs(mid - y_mid), ib.col, mid, ib.ord) = 1",
    "block_markdown": f"WITH {_BLOCKS} SELECT doc_id, ord, {_RENDERED} AS md FROM (SELECT c.*, level FROM (SELECT *, round_even(size * 2, 0) / 2 AS bucket FROM clean) c LEFT JOIN levels USING (doc_id, bucket))",
    "pdf_traits": f"""WITH {_BLOCKS}, pg AS (SELECT doc_id, page, CAST(sum(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> ''))) AS BIGINT) AS words, count(*) FILTER (kind = 'table') AS tables, bool_or(regexp_matches(text, {q(o._MATH)})) AS math,
        count(*) FILTER (length(trim(text)) > {v.COLUMN_CHARS} AND x0 < page_width * {v.LEFT_PART}) >= 2 AND count(*) FILTER (length(trim(text)) > {v.COLUMN_CHARS} AND x0 > page_width * {v.LEFT_PART} + page_width * {v.COLUMN_GAP}) >= 2 AS split FROM kinds GROUP BY ALL),
      pn AS (SELECT *, max(page) OVER (PARTITION BY doc_id) AS n FROM pg),
      lk AS (SELECT *, CASE WHEN n <= {v.TABLE_PAGES} OR list_contains(list_transform(range(0, {v.TABLE_PAGES}), lambda i: CAST(round_even(i * (n - 1) / {v.TABLE_PAGES - 1}.0::DOUBLE, 0) AS BIGINT)), page - 1) THEN tables ELSE 0 END AS looked FROM pn),
      ct AS (SELECT *, CASE WHEN coalesce(sum(looked) OVER (PARTITION BY doc_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < {v.TABLE_HEAVY} THEN looked ELSE 0 END AS counted FROM lk),
      dc AS (SELECT doc_id, max(n) AS page_count, CAST(sum(words) AS BIGINT) AS word_count, CAST(sum(counted) AS BIGINT) AS table_count, bool_or(math) AS has_math, count(*) FILTER (split) AS split FROM ct GROUP BY 1),
      im AS (SELECT doc_id, count(DISTINCT ord) AS image_count FROM ib GROUP BY 1)
      SELECT doc_id, page_count, image_count, table_count, word_count, word_count::DOUBLE / page_count < {v.SCANNED_WORDS} AND image_count > 0 AS is_scanned, image_count::DOUBLE / page_count >= {v.IMAGES_A_PAGE} AS is_image_heavy, table_count >= {v.TABLE_HEAVY} AS is_table_heavy,
        split::DOUBLE / page_count >= {v.COLUMN_SHARE} AS is_multi_column, image_count = 0 AS is_text_only, has_math FROM (SELECT dc.*, coalesce(im.image_count, 0) AS image_count FROM dc LEFT JOIN im USING (doc_id))""",
    "source_formats": f"SELECT page_id, CASE {' '.join(f'WHEN x IN {tuple([*e, *e][:max(2, len(e))])} THEN {q(n)}' for n, e in r.FORMATS.items())} END AS format FROM (SELECT page_id, lower({SUFFIXES}[page_id % {len(SUFFIXES)} + 1]) AS x FROM pages)",
    "normal_pages": f"""WITH {u._PAGES}, every AS (SELECT doc_id, side, page, line FROM lines UNION ALL SELECT doc_id, side, page, unnest({_EXTRA}) FROM (SELECT DISTINCT doc_id, side, page FROM lines)),
      kept AS (SELECT doc_id, side, page, {_FLAT('line')} AS line FROM every WHERE {_FLAT('line')} <> '' AND NOT regexp_matches({_FLAT('line')}, '{r.NUMBER_LINE}|{r.DATE_LINE}|{r.PAGE_LINE}|{r.SOURCE_LINE}')),
      heads AS (SELECT doc_id, side, line FROM kept WHERE length(line) <= 120 AND NOT starts_with(line, '#') GROUP BY ALL HAVING count(DISTINCT page) >= 3)
      SELECT doc_id, side, page, count(*) AS lines, CAST(sum(length(line)) AS BIGINT) AS chars FROM kept ANTI JOIN heads USING (doc_id, side, line) GROUP BY ALL""",
    "audit_windows": f"""WITH {u._PAGES}, {_SIZES}, w AS (SELECT doc_id, s, c, i, CAST((i - 1) * {r.WINDOW_PAGES} + 1 AS INTEGER) AS a FROM (SELECT *, unnest(range(1, (s + {r.WINDOW_PAGES - 1}) // {r.WINDOW_PAGES} + 1)) AS i FROM sizes WHERE s > 0 AND c > 0)),
      x AS (SELECT *, least(s, a + {r.WINDOW_PAGES - 1}) AS z, CAST(greatest(1, floor((a - 1)::DOUBLE / s * c) + 1 - {r.WINDOW_MARGIN}) AS INTEGER) AS f FROM w)
      SELECT doc_id, CAST(i AS INTEGER) AS window, a AS source_from, CAST(z AS INTEGER) AS source_to, f AS candidate_from, CAST(least(c, greatest(f, ceil(z::DOUBLE / s * c) + {r.WINDOW_MARGIN})) AS INTEGER) AS candidate_to FROM x""",
    "concurrency_summary": f"""SELECT concurrency, count(*) AS attempt_count, count(*) FILTER (ok) AS success_count, count(*) FILTER (NOT ok) AS error_count, CAST(sum(n * 42 + 1) AS BIGINT) AS total_tokens, CAST(sum(n * 37) AS BIGINT) AS total_input_tokens, CAST(sum(n * 5 + 1) AS BIGINT) AS total_output_tokens,
      avg(n * 42 + 1) AS mean_tokens, avg(e) FILTER (ok) AS mean_elapsed_s, min(e) FILTER (ok) AS min_elapsed_s, max(e) FILTER (ok) AS max_elapsed_s, CAST(max(least(concurrency, n % 4 + 1)) AS INTEGER) AS max_active_calls FROM (SELECT *, CAST([1, 2, 4][n % 3 + 1] AS INTEGER) AS concurrency, n % 7 <> 0 AS ok, n % 1000 / 100 AS e FROM ({_CALLS})) GROUP BY 1""",
    "model_summary": f"SELECT *, CASE WHEN attempts > 1 THEN greatest(0.0, first_latency_s - mean_answer_s) END AS load_overhead_s FROM ({_SUMMARY})",
    "best_models": f"SELECT model, attempts FROM ({_SUMMARY}) WHERE pass_count = attempts ORDER BY mean_latency_s, model LIMIT 3",
    "missing_models": f"SELECT unnest({REQUESTED}) AS name EXCEPT SELECT unnest({u.NAMES})",
    "retry_delays": f"SELECT call_id, CASE WHEN n % 3 = 0 THEN greatest(0.0, n % 50 - 5)::DOUBLE ELSE {j.RATE_LIMIT_BASE}::DOUBLE * power(2, n % 4) END AS seconds FROM ({_CALLS})",
    "json_spans": f"SELECT call_id, span FROM ({_SPANS})",
    "checklists": f"SELECT call_id, {', '.join(f'''coalesce(lower(json_extract_string(span, '$.{k}')) IN {j.TRUE_WORDS}, false) AS {q(k)[1:-1] if k != 'order' else '"order"'}''' for k in CHECKLIST)} FROM ({_SPANS}) WHERE n % 5 IN (0, 1, 4)",
    "probe_decisions": f"SELECT call_id, n % 14 >= 7 AND n % 3 = 0 AS checklist, n % 9 >= {j.LEAST_FOUND} AND n % 5 <= {j.MOST_FALSE} AS freeform FROM ({_CALLS})",
    "remediation_plans": f"""WITH {u._VIOLATIONS}, tasks AS (SELECT doc_id, adapter, ord, 'Fix ' || type AS task, CASE WHEN doc_id % 2 = 0 THEN 'source' ELSE adapter END AS other FROM merged WHERE severity = 'major')
      SELECT doc_id, CASE WHEN count(DISTINCT adapter) > 1 THEN 'multiple_candidates' ELSE min(adapter) END AS preferred, CASE WHEN count(DISTINCT other) > 1 THEN 'multiple_candidates' ELSE min(other) END AS compare_against, count(DISTINCT adapter) AS candidates, list(task ORDER BY adapter, ord, task) AS tasks FROM tasks GROUP BY 1""",
    "bounded_examples": f"SELECT doc_id, list_transform(string_split(text, chr(10))[1:{r.MAX_EXAMPLES}], lambda x: CASE WHEN length(x) <= {r.MAX_EXAMPLE_CHARS} THEN x ELSE rtrim(left(x, {r.MAX_EXAMPLE_CHARS - 3})) || '...' END) AS examples FROM documents",
    "repair_trust": "SELECT doc_id, doc_id % 3 = 0 AND doc_id % 2 = 0 AS current FROM documents",
    "matrix_markdown": f"WITH {o.OBSERVED} SELECT CAST(CASE bucket {' '.join(f'WHEN {q(n)} THEN {i}' for i, n in enumerate([*(n for _, n in r.BUCKETS), r.BEYOND], 1))} ELSE {len(r.BUCKETS) + 2} END AS INTEGER) AS place, '| ' || concat_ws(' | ', {', '.join(f'CAST({c} AS VARCHAR)' for c in _MATRIX)}) || ' |' AS line FROM matrix",
}
