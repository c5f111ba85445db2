"""The tournament over a corpus, and its queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillforge.functions.batches import spread
from quillforge.operators import checks as k
from quillforge.operators import ranking as r
from quillforge.operators.repair import paragraph_signals, repair_candidates
from quillforge.operators.traits import html_traits, text_traits
from quillforge.sources.candidates import candidates, text_to_markdown
from quillforge.sources.html import convert_pages


def docs(spark: SparkSession, d: str) -> DataFrame:
    return spread(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text"))


def cands(spark: SparkSession, d: str) -> DataFrame:
    return candidates(docs(spark, d))


def judged(spark: SparkSession, d: str) -> DataFrame:
    return k.judged(cands(spark, d))


def gated(spark: SparkSession, d: str) -> DataFrame:
    return k.gates(judged(spark, d))


def checked(spark: SparkSession, d: str) -> DataFrame:
    return k.check_rows(gated(spark, d))


def scored(spark: SparkSession, d: str) -> DataFrame:
    return k.scorecards(checked(spark, d))


def ranked(spark: SparkSession, d: str) -> DataFrame:
    return r.ranked(scored(spark, d))


def winners(spark: SparkSession, d: str) -> DataFrame:
    return ranked(spark, d).where("rank = 1").select("doc_id", F.col("adapter").alias("winner"), F.col("total_score").alias("winning_score"))


def runs(spark: SparkSession, d: str) -> DataFrame:
    """One for each run: status, pages, a time that follows from the text, its gate, score and rank.  Texts are converted and judged
    once, and only narrow rows are shuffled."""
    timing = F.when(F.col("adapter") == "garbled", 0).otherwise(F.length("md").cast("long") * 7 % 100_000)
    return r.standing(scored(spark, d).select("doc_id", "adapter", "status", "pages", timing.alias("timing_ms"), "first_failure", "total_score", F.sha2("md", 256).alias("md_sha256"), "images"))


def observations(spark: SparkSession, d: str) -> DataFrame:
    score = F.when(F.col("rank").isNotNull(), F.col("total_score"))
    return runs(spark, d).select("doc_id", "adapter", "status", "pages", "timing_ms", score.alias("score"), F.coalesce(F.col("rank") == 1, F.lit(False)).alias("won"), "first_failure")


def matrix(spark: SparkSession, d: str) -> DataFrame:
    return r.matrix(observations(spark, d))


def _measure(column: str):
    return lambda spark, d: judged(spark, d).select("doc_id", "adapter", column)


def _txt_convert(spark: SparkSession, d: str) -> DataFrame:
    name = F.col("doc_id").cast("string")
    return docs(spark, d).select("doc_id", text_to_markdown(F.col("text"), F.concat(F.lit("Document "), name), F.concat(F.lit("doc-"), name, F.lit(".txt"))).alias("md"))


def _image_refs(spark: SparkSession, d: str) -> DataFrame:
    refs = cands(spark, d).select("doc_id", "adapter", "images", F.explode(k.image_refs(F.col("md"))).alias("r"))
    return refs.select("doc_id", "adapter", F.replace(k.bare_ref(F.col("r")), F.lit("\\"), F.lit("/")).alias("ref"), k.ref_key(F.col("r")).alias("ref_key"), k.ref_problem(F.col("r"), F.col("images")).alias("problem"))


def check_entries(spark: SparkSession, d: str) -> DataFrame:
    """A row per check of each candidate.  inline() and not explode(): fields taken from what explode() gives are pushed below it, each
    with the whole array again."""
    return checked(spark, d).select("doc_id", "adapter", F.inline(F.transform("checks", lambda x, i: F.struct(i.alias("at"), x["name"].alias("check_name"), *(x[f].alias(f) for f in ("status", "issues", "score", "violation", "severity"))))))


def _check_scores(spark: SparkSession, d: str) -> DataFrame:
    return check_entries(spark, d).drop("at")


def _promotion(spark: SparkSession, d: str) -> DataFrame:
    return runs(spark, d).where("rank = 1").select("doc_id", "adapter", "md_sha256", "images")


def _ok_runs(spark: SparkSession, d: str) -> DataFrame:
    c = cands(spark, d)
    return c.where("status = 'ok'").select("doc_id", "adapter", F.length("md").cast("long").alias("md_chars"))  # a semi join on the run's own key is a filter


QUERIES = {
    "txt_convert": _txt_convert,
    "candidates": lambda s, d: cands(s, d).groupBy("adapter", "status").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("md")).alias("chars")),
    "doc_traits_txt": lambda s, d: text_traits(docs(s, d)),
    "page_traits_html": lambda s, d: html_traits(s.read.parquet(f"{d}/pages.parquet")),
    "gate_not_empty": lambda s, d: judged(s, d).select("doc_id", "adapter", "chars", (F.col("chars") >= k.MIN_CHARS).alias("passed")),
    "gate_charset": lambda s, d: judged(s, d).select("doc_id", "adapter", "printable", (F.col("printable") >= k.MIN_PRINTABLE).alias("passed")),
    "gate_image_refs": lambda s, d: judged(s, d).select("doc_id", "adapter", "n_unresolved", (F.col("n_unresolved") == 0).alias("passed")),
    "gate_coverage": lambda s, d: judged(s, d).select("doc_id", "adapter", "coverage", (F.col("coverage") >= k.MIN_COVERAGE).alias("passed")),
    "gate_status": lambda s, d: cands(s, d).select("doc_id", "adapter", (F.col("status") == "ok").alias("passed")),
    "gate_first_failure": lambda s, d: gated(s, d).select("doc_id", "adapter", "first_failure"),
    "text_coverage": lambda s, d: checked(s, d).select("doc_id", "adapter", "coverage", "n_missing_words", F.col("checks")[10]["status"].alias("status")),
    "check_double_bullets": _measure("n_double_bullets"), "check_numbered_lists": _measure("n_list_gaps"), "check_fragmented_headings": _measure("n_fragmented"), "check_caption_near_image": _measure("n_captions"),
    "check_row_sliced": _measure("n_sliced"), "check_box_content": _measure("n_boxes"), "check_image_size": _measure("n_sizes"), "check_repeated_headings": _measure("n_repeated"), "check_images_resolvable": _measure("n_unresolved"),
    "image_refs": _image_refs,
    "image_count_match": lambda s, d: checked(s, d).select("doc_id", "adapter", "n_refs", F.col("checks")[9]["status"].alias("status")),
    "check_scores": _check_scores,
    "check_totals": lambda s, d: _check_scores(s, d).groupBy("check_name", "status").agg(F.count(F.lit(1)).alias("n"), F.sum("score").alias("score")),
    "scorecards": lambda s, d: scored(s, d).select("doc_id", "adapter", "total_score", "fail_count", "warn_count", "pass_count", F.col("check_scores")["images_locally_resolvable"].alias("image_score")),
    "ranking": lambda s, d: ranked(s, d).select("doc_id", "adapter", "total_score", "rank"),
    "winners": winners,
    "near_ties": lambda s, d: ranked(s, d).where("rank > 1").select("doc_id", "adapter", (F.col("total_score") - F.col("best")).alias("delta")).where(F.col("delta") <= r.NEAR_TIE),
    "next_ranked_score": lambda s, d: ranked(s, d).select("doc_id", "adapter", "total_score", "next_score"),
    "disqualified": lambda s, d: gated(s, d).where("first_failure is not null").groupBy("first_failure").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("docs")),
    "run_status_semi_join": _ok_runs,
    "promotion": _promotion,
    "observations": observations,
    "matrix_grouping_sets": lambda s, d: matrix(s, d).select("bucket", "adapter", "attempts", "total_pages", "raw_successes", "gate_passes", "wins", "total_ms", "median_ms", F.round("mean_score", 6).alias("mean_score"), F.round("pages_per_second", 6).alias("pages_per_second")),
    "html_to_markdown": lambda s, d: convert_pages(s.read.parquet(f"{d}/pages.parquet")),
    "paragraph_signals": lambda s, d: paragraph_signals(cands(s, d).where("status = 'ok'")),
    "paragraph_repair": lambda s, d: repair_candidates(cands(s, d).where("status = 'ok'")),
    "quality_tiers": lambda s, d: (lambda m: m.select("bucket", "adapter", r.quality_tier(m["mean_score"], m["gate_pass_rate"]).alias("quality_tier"), r.default_signal(m).alias("default_set_signal")))(matrix(s, d)),
}
