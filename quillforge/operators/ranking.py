"""Ranking of candidates, selection, and the benchmark matrix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NEAR_TIE = 10.0
# ---- fixed values: page buckets and the thresholds of tiers and signals
BUCKETS = [(0, "unknown pages"), (1, "1 page"), (10, "2-10 pages"), (50, "11-50 pages"), (100, "51-100 pages"), (1000, "101-1000 pages")]
BEYOND = "1000+ pages"
HIGH_RATE, MEDIUM_RATE, LOW_RATE = 0.95, 0.80, 0.50
HIGH_SCORE, MEDIUM_SCORE, LOW_SCORE = 10, 50, 100
SLOW_TOTAL_MS, SLOW_MEDIAN_MS, SLOW_PAGES = 120_000, 30_000, 1
# ----


def ranked(cards: DataFrame) -> DataFrame:
    """Candidates that pass all gates, by score and name: rank, the best score of the document and the next candidate's.

    One window: rank and lead over the order, the minimum over the same partitions, in one shuffle of narrow rows.
    """
    w = Window.partitionBy("doc_id").orderBy("total_score", "adapter")
    passed = cards.where("first_failure is null").select("doc_id", "adapter", "total_score")
    return passed.withColumns({"rank": F.row_number().over(w), "best": F.first("total_score").over(w), "next_score": F.lead("total_score").over(w)})


def standing(cards: DataFrame) -> DataFrame:
    """cards with the rank that ranked() gives, null for a candidate that a gate disqualifies; in one shuffle of what cards has."""
    w = Window.partitionBy("doc_id").orderBy(F.col("first_failure").isNotNull(), "total_score", "adapter")
    return cards.withColumn("rank", F.when(F.col("first_failure").isNull(), F.row_number().over(w)))


def page_bucket(pages: Column) -> Column:
    out = F.lit(BEYOND)
    for most, name in reversed(BUCKETS):
        out = F.when(pages <= most, name).otherwise(out)
    return out


def matrix(observations: DataFrame) -> DataFrame:
    """Attempts, pages, times, successes and scores for each bucket and adapter, and for each adapter over all buckets."""
    timed = F.when(F.col("timing_ms") > 0, F.col("timing_ms")).cast("double")
    rows = observations.withColumn("bucket", page_bucket(F.col("pages")))
    out = rows.groupingSets([["bucket", "adapter"], ["adapter"]], "bucket", "adapter").agg(
        F.count(F.lit(1)).alias("attempts"), F.sum(F.greatest("pages", F.lit(0))).alias("total_pages"), F.sum(timed).alias("total_ms"),
        F.count_if(F.col("status") == "ok").alias("raw_successes"), F.count("score").alias("gate_passes"), F.count_if("won").alias("wins"),
        F.median(timed).alias("median_ms"), F.avg("score").alias("mean_score"),
    )
    speed = F.when((F.col("total_ms") > 0) & (F.col("total_pages") > 0), F.col("total_pages") / (F.col("total_ms") / 1000))
    return out.withColumns({"bucket": F.coalesce("bucket", F.lit("all")), "gate_pass_rate": F.col("gate_passes") / F.col("attempts"), "pages_per_second": speed})


def quality_tier(score: Column, rate: Column) -> Column:
    best = F.when(rate >= HIGH_RATE, "high").when(rate >= MEDIUM_RATE, "medium").otherwise("low")
    middle = F.when(rate < MEDIUM_RATE, "low").otherwise("medium")
    return F.when(score.isNull() | (rate <= 0), "failed").when(rate < LOW_RATE, "poor").when(score <= HIGH_SCORE, best).when(score <= MEDIUM_SCORE, middle).when(score <= LOW_SCORE, "low").otherwise("poor")


def default_signal(m: DataFrame) -> Column:
    slow = F.coalesce(m["total_ms"] >= SLOW_TOTAL_MS, F.lit(False)) | F.coalesce(m["median_ms"] >= SLOW_MEDIAN_MS, F.lit(False)) | F.coalesce(m["pages_per_second"] <= SLOW_PAGES, F.lit(False))
    return F.when(m["raw_successes"] == 0, "not_available_or_unsupported").when(m["wins"] > 0, "keep_default_candidate").when(slow, "move_to_optional_candidate").otherwise("watch_no_wins")
