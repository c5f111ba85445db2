"""Reports over runs: summaries by concurrency and model, the matrix as Markdown, result documents as JSON, and what is read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillforge.operators.ranking import BEYOND, BUCKETS

# ---- fixed values: extensions by format, in the order in which they are asked; sizes of examples
FORMATS = {"pdf": (".pdf",), "docx": (".doc", ".docx", ".odt", ".rtf"), "html": (".html", ".htm"), "txt": (".txt", ".text")}
MAX_EXAMPLES, MAX_EXAMPLE_CHARS = 5, 160
WINDOW_PAGES, WINDOW_MARGIN, ISSUE_SOURCE, ISSUE_CANDIDATE, MAX_ISSUES = 6, 2, 4, 8, 12
NUMBER_LINE, DATE_LINE, PAGE_LINE, SOURCE_LINE = r"^\d+$", r"^\d{1,2}\s+[A-Z]{3}\s+\d{4}$", r"(?i)^page\s+\d+\s+of\s+\d+$", r"(?i)^\*\*Source:\*\*"
# ----


def source_format(path: Column) -> Column:
    """The first format that has the path's lower-cased suffix, null if none has."""
    suffix = F.regexp_extract(F.lower(path), r"(\.[^./]+)$", 1)
    out = F.lit(None).cast("string")
    for name, suffixes in reversed(FORMATS.items()):
        out = F.when(suffix.isin(*suffixes), name).otherwise(out)
    return out


def concurrency_summary(attempts: DataFrame) -> DataFrame:
    """attempts: concurrency, succeeded, elapsed_s, input_tokens, output_tokens, active_calls.  One row per concurrency; times are of
    successes, and null without any."""
    tokens = F.col("input_tokens") + F.col("output_tokens")
    took = F.when(F.col("succeeded"), F.col("elapsed_s"))
    return attempts.groupBy("concurrency").agg(
        F.count(F.lit(1)).alias("attempt_count"), F.count_if("succeeded").alias("success_count"), F.count_if(~F.col("succeeded")).alias("error_count"),
        F.sum(tokens).alias("total_tokens"), F.sum("input_tokens").alias("total_input_tokens"), F.sum("output_tokens").alias("total_output_tokens"),
        F.avg(tokens).alias("mean_tokens"), F.avg(took).alias("mean_elapsed_s"), F.min(took).alias("min_elapsed_s"), F.max(took).alias("max_elapsed_s"),
        F.max("active_calls").alias("max_active_calls"),
    )


def model_summary(attempts: DataFrame) -> DataFrame:
    """attempts: model, rep (from 1), passed, latency_s, tokens.  The first answer stands for loading, the later ones for answering."""
    first = F.min_by("latency_s", "rep")
    later = F.coalesce(F.avg(F.when(F.col("rep") > 1, F.col("latency_s"))), F.avg("latency_s"))
    out = attempts.groupBy("model").agg(
        F.count(F.lit(1)).alias("attempts"), F.count_if("passed").alias("pass_count"), first.alias("first_latency_s"), later.alias("mean_answer_s"),
        F.coalesce(F.max(F.when(F.col("rep") > 1, F.col("latency_s"))), F.max("latency_s")).alias("max_answer_s"), F.avg("latency_s").alias("mean_latency_s"), F.avg("tokens").alias("mean_tokens"),
    )
    return out.withColumn("load_overhead_s", F.when(F.col("attempts") > 1, F.greatest(F.lit(0.0), F.col("first_latency_s") - F.col("mean_answer_s"))))


def best_models(summary: DataFrame, most: int) -> DataFrame:
    """The models that passed every attempt, the fastest first, at most `most`: that is what the report is for."""
    return summary.where("pass_count = attempts").orderBy("mean_latency_s", "model").limit(most)


def missing_names(requested: DataFrame, available: DataFrame) -> DataFrame:
    """Requested names (name) that aren't available."""
    return requested.select("name").distinct().join(available, "name", "left_anti")


def bounded_examples(examples: Column, most: int = MAX_EXAMPLES, chars: int = MAX_EXAMPLE_CHARS) -> Column:
    """The first examples, long ones cut to `chars` characters with three dots."""
    return F.transform(F.slice(examples, 1, most), lambda x: F.when(F.length(x) <= chars, x).otherwise(F.concat(F.rtrim(F.left(x, F.lit(chars - 3))), F.lit("..."))))


def repair_is_current(raw: Column, repaired: Column, input_sha: Column, output_sha: Column, creator: Column, name: str) -> Column:
    """Whether a recorded repair belongs to both texts as they are now."""
    return F.coalesce((F.sha2(raw, 256) == input_sha) & (F.sha2(repaired, 256) == output_sha) & (creator == name), F.lit(False))


def remediation_plans(tasks: DataFrame) -> DataFrame:
    """tasks: doc_id, adapter, ord, task, compare_against.  One plan per document over its audited candidates; labels of several
    candidates are multiple_candidates.  A document has few tasks, so they are one array."""
    label = lambda c: F.when(F.count_distinct(c) > 1, "multiple_candidates").otherwise(F.min(c))
    plan = F.transform(F.array_sort(F.collect_list(F.struct("adapter", "ord", "task"))), lambda x: x["task"])
    return tasks.groupBy("doc_id").agg(label("adapter").alias("preferred"), label("compare_against").alias("compare_against"), F.count_distinct("adapter").alias("candidates"), plan.alias("tasks"))


def bucket_place(bucket: Column) -> Column:
    """The place of a page bucket in their order; others come last."""
    names = [name for _, name in BUCKETS] + [BEYOND]
    at = F.array_position(F.array(*map(F.lit, names)), bucket)
    return F.when(at > 0, at).otherwise(len(names) + 1)


def markdown_rows(rows: DataFrame, columns: list[str]) -> DataFrame:
    """rows with line, their row of a Markdown table: bars escaped, line ends as spaces, nulls empty."""
    cell = lambda c: F.replace(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))
    return rows.withColumn("line", F.concat(F.lit("| "), F.concat_ws(" | ", *map(cell, columns)), F.lit(" |")))


def markdown_table(rows: DataFrame, columns: list[str], order: list[Column]) -> str:
    """A small summary (a row for each bucket and adapter) as one Markdown table."""
    head = [f"| {' | '.join(columns)} |", f"| {' | '.join('---' for _ in columns)} |"]
    return "\n".join([*head, *(r.line for r in markdown_rows(rows, columns).orderBy(*order).select("line").collect())])


def result_documents(runs: DataFrame) -> DataFrame:
    """runs: doc_id, adapter, status, timing_ms, first_failure, total_score, rank.  One JSON document for each source: the winner, the
    ranked and the disqualified candidates, and each adapter's status and time."""
    entry = F.struct("rank", "adapter", F.col("total_score").alias("score"))
    ranked = F.transform(F.array_sort(F.collect_list(F.when(F.col("rank").isNotNull(), entry))), lambda x: F.struct(x["adapter"].alias("adapter"), x["score"].alias("score")))
    out = F.transform(F.array_sort(F.collect_list(F.when(F.col("first_failure").isNotNull(), F.struct("adapter", "first_failure")))), lambda x: F.struct(x["adapter"].alias("adapter"), x["first_failure"].alias("reason")))
    states = F.array_sort(F.collect_list(F.struct("adapter", "status", "timing_ms")))
    found = runs.groupBy("doc_id").agg(F.min_by("adapter", "rank").alias("winner"), ranked.alias("ranked"), out.alias("disqualified"), states.alias("adapters"))
    return found.select("doc_id", F.to_json(F.struct("winner", "ranked", "disqualified", "adapters")).alias("report"))


REPORT = "winner string, ranked array<struct<adapter:string,score:double>>, disqualified array<struct<adapter:string,reason:string>>, adapters array<struct<adapter:string,status:string,timing_ms:long>>"


def write_reports(reports: DataFrame, folder: str) -> None:
    """doc_id and report as JSON lines; the job's commit makes them appear all at once."""
    reports.write.mode("overwrite").json(folder)


def read_reports(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each adapter of each document in a folder of reports: status, time, score, whether it won, and why it was ruled out."""
    docs = spark.read.schema("doc_id long, report string").option("recursiveFileLookup", True).json(folder).select("doc_id", F.from_json("report", REPORT).alias("r"))
    of = lambda items, field: F.get(F.transform(F.filter(items, lambda x: x["adapter"] == F.col("a.adapter")), lambda x: x[field]), F.lit(0))
    rows = docs.select("doc_id", "r", F.explode("r.adapters").alias("a"))
    return rows.select("doc_id", "a.adapter", "a.status", "a.timing_ms", of(F.col("r.ranked"), "score").alias("score"), F.coalesce(F.col("r.winner") == F.col("a.adapter"), F.lit(False)).alias("won"), of(F.col("r.disqualified"), "reason").alias("reason"))


# ---- pages


def normal_lines(rows: DataFrame, short: int = 120, pages: int = 3) -> DataFrame:
    """rows: doc_id, side, page, pos, line.  Without empty lines, numbers, dates, page counts, the source line, and short lines that
    stand on at least so many pages of a side."""
    line = F.trim(F.regexp_replace("line", r"\s+", " "))
    kept = rows.withColumn("line", line).where((F.col("line") != "") & ~F.col("line").rlike(NUMBER_LINE) & ~F.col("line").rlike(DATE_LINE) & ~F.col("line").rlike(PAGE_LINE) & ~F.col("line").rlike(SOURCE_LINE))
    heads = kept.where((F.length("line") <= short) & ~F.col("line").startswith("#")).groupBy("doc_id", "side", "line").agg(F.count_distinct("page").alias("n")).where(F.col("n") >= pages)
    return kept.join(heads.select("doc_id", "side", "line"), ["doc_id", "side", "line"], "left_anti")


def audit_windows(sizes: DataFrame, pages: int = WINDOW_PAGES, margin: int = WINDOW_MARGIN) -> DataFrame:
    """sizes: doc_id, s, c, the pages of source and candidate.  Windows of `pages` source pages and, in proportion, of the candidate's
    with a margin; none where either has no page."""
    rows = sizes.where("s > 0 and c > 0").select("doc_id", "s", "c", F.posexplode(F.sequence(F.lit(1), F.col("s"), F.lit(pages))).alias("i", "source_from"))
    rows = rows.withColumn("source_to", F.least(F.col("s"), F.col("source_from") + pages - 1))
    low = F.greatest(F.lit(1), F.floor((F.col("source_from") - 1) / F.col("s") * F.col("c")) + 1 - margin)
    rows = rows.withColumn("candidate_from", low)
    high = F.least(F.col("c"), F.greatest(F.col("candidate_from"), F.ceil(F.col("source_to") / F.col("s") * F.col("c")) + margin))
    return rows.select("doc_id", (F.col("i") + 1).alias("window"), "source_from", "source_to", F.col("candidate_from").cast("int").alias("candidate_from"), high.cast("int").alias("candidate_to"))


def issue_windows(matches: DataFrame, sizes: DataFrame, least: float, gap: int) -> DataFrame:
    """matches: doc_id, source_page, candidate_page, coverage; sizes: doc_id, s, c.  The first MAX_ISSUES windows of each document: runs
    of suspicious pages without a larger gap, cut where the next page would make the source's part longer than ISSUE_SOURCE or the
    candidate's wider than ISSUE_CANDIDATE, with a page more on each side."""
    by = Window.partitionBy("doc_id").orderBy("source_page")
    rows = matches.where(F.col("coverage") < least).withColumn("fresh", F.coalesce(F.col("source_page") - F.lag("source_page").over(by) > gap, F.lit(True)))
    pages = F.array_sort(F.collect_list(F.struct("source_page", "candidate_page", "fresh")))  # a document's own pages
    item = "struct<a:int,b:int,c:int,d:int,n:int>"
    start = F.array().cast(f"array<{item}>")

    def step(found: Column, x: Column) -> Column:
        last = F.element_at(found, F.greatest(F.size(found), F.lit(1)))
        low, high = F.least(last["c"], x["candidate_page"]), F.greatest(last["d"], x["candidate_page"])
        one = F.struct(x["source_page"].alias("a"), x["source_page"].alias("b"), x["candidate_page"].alias("c"), x["candidate_page"].alias("d"), F.lit(1).alias("n")).cast(item)
        more = F.struct(last["a"].alias("a"), x["source_page"].alias("b"), low.alias("c"), high.alias("d"), (last["n"] + 1).alias("n")).cast(item)
        fits = ~x["fresh"] & (x["source_page"] - last["a"] + 1 <= ISSUE_SOURCE) & (high - low + 1 <= ISSUE_CANDIDATE)
        return F.when((F.size(found) > 0) & fits, F.concat(F.slice(found, 1, F.greatest(F.size(found) - 1, F.lit(0))), F.array(more))).otherwise(F.concat(found, F.array(one)))

    found = rows.groupBy("doc_id").agg(pages.alias("p")).select("doc_id", F.posexplode(F.slice(F.aggregate("p", start, step), 1, MAX_ISSUES)).alias("i", "w")).join(sizes, "doc_id")
    return found.select(
        "doc_id", (F.col("i") + 1).alias("issue"), F.col("w.n").alias("pages"), F.greatest(F.lit(1), F.col("w.a") - 1).alias("source_from"), F.least(F.col("s"), F.col("w.b") + 1).cast("int").alias("source_to"),
        F.greatest(F.lit(1), F.col("w.c") - 1).alias("candidate_from"), F.least(F.col("c"), F.col("w.d") + 1).cast("int").alias("candidate_to"),
    )
