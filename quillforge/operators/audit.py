"""Verdicts on candidates: violations, penalties, remediation, costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# ---- fixed values: weights, hints by violation type, and prices in dollars for a million tokens (the first match of a provider wins)
PENALTY = {"critical": 25.0, "major": 12.0, "minor": 3.0}
HINT_AREAS = {
    "reading_order": "block ordering", "missing_content": "dropped blocks", "caption_detachment": "captions", "image_text_association": "image placement",
    "table_fragmentation": "tables", "heading_hierarchy": "headings", "duplicated_content": "repeated headers",
}
DEFAULT_HINT = "post-processing"
PRICES = [
    ("claude", "claude-haiku-4-5", "1.00", "5.00"), ("openai", "gpt-4o-mini", "0.15", "0.60"), ("openai", "gpt-5.4-mini", "0.75", "4.50"), ("openai", "o4-mini", "1.10", "4.40"),
    ("openai", "gpt-5.1-codex-mini", "0.25", "2.00"), ("openai", "gpt-5.1-codex", "1.25", "10.00"), ("deepseek", "deepseek-chat", "0.27", "1.10"),
]
# ----
TYPES = [*HINT_AREAS, "formatting_only_minor", "other"]


def normal(c: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))


def merge_violations(v: DataFrame) -> DataFrame:
    """v: doc_id, adapter, ord, type, severity, count, pages, confidence, evidence, cause.  One row for equal findings of several
    windows: counts add up, pages join, the first text stays, the highest confidence counts."""
    keys = [F.col("type"), F.col("severity"), normal(F.col("cause")).alias("cause_key"), normal(F.col("evidence")).alias("evidence_key")]
    merged = v.groupBy("doc_id", "adapter", *keys).agg(
        F.sum(F.greatest("count", F.lit(1))).alias("count"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("pages")))).alias("pages"),
        F.max("confidence").alias("confidence"), F.min_by("evidence", "ord").alias("evidence"), F.min("ord").alias("ord"),
    )
    return merged.drop("cause_key", "evidence_key")


def clip_pages(pages: Column, low: Column, high: Column) -> Column:
    """The pages inside a window, or its first page if none is."""
    inside = F.array_sort(F.array_distinct(F.filter(pages, lambda p: p.between(low, high))))
    return F.when(F.size(inside) > 0, inside).otherwise(F.array(low))


def penalties(v: DataFrame) -> DataFrame:
    weight = F.lit(0.0)
    for severity, points in PENALTY.items():
        weight = F.when(F.col("severity") == severity, points).otherwise(weight)
    return v.groupBy("doc_id", "adapter").agg(F.sum(weight * F.greatest("count", F.lit(1))).alias("penalty"), F.max(F.col("severity").isin("critical", "major")).alias("serious"))


def audits(ranked: DataFrame, penalties_: DataFrame, most: int = 3) -> DataFrame:
    """The outcome of auditing each document's candidates in rank order, at most `most`: the first that is accepted ends it.

    A candidate with a serious violation is rejected if its score plus penalty exceeds the next one's, else accepted as penalised;
    all others are accepted.  No loop is needed: a document's outcome is its first accepted rank.
    """
    rows = ranked.where(F.col("rank") <= most).join(penalties_, ["doc_id", "adapter"], "left")
    rescored = F.col("total_score") + F.coalesce("penalty", F.lit(0.0))
    rejected = F.coalesce(F.col("serious") & (rescored > F.col("next_score")), F.lit(False))
    rows = rows.withColumn("audit", F.when(rejected, "rejected_major").when(F.coalesce("serious", F.lit(False)), "accepted_penalized_major").otherwise("accepted"))
    first = F.min(F.struct("rank", "adapter", "audit"))
    done = rows.where("audit <> 'rejected_major'").groupBy("doc_id").agg(first.alias("x")).select("doc_id", F.col("x.adapter").alias("adapter"), F.col("x.audit").alias("audit"), F.col("x.rank").alias("attempts"))
    left = rows.groupBy("doc_id").agg(F.count(F.lit(1)).cast("int").alias("tried")).join(done, "doc_id", "left")
    return left.select("doc_id", "adapter", F.coalesce("audit", F.lit("escalated")).alias("audit"), F.coalesce("attempts", "tried").alias("attempts"))


def hints(v: DataFrame, spark: SparkSession) -> DataFrame:
    table = spark.createDataFrame(list(HINT_AREAS.items()), "type string, fix_area string")
    return v.join(F.broadcast(table), "type", "left").withColumn("fix_area", F.coalesce("fix_area", F.lit(DEFAULT_HINT)))  # seven rows


def costs(usage: DataFrame, spark: SparkSession) -> DataFrame:
    """usage: call_id, provider, model, input_tokens, output_tokens.  Price of the first table row with the provider whose name begins
    the model's; six decimals, halves up."""
    rows = [(i, p, m, a, b) for i, (p, m, a, b) in enumerate(PRICES)]
    table = spark.createDataFrame(rows, "ord int, provider string, prefix string, a string, b string")
    table = table.select("ord", "provider", "prefix", F.col("a").cast("decimal(18,6)").alias("input_price"), F.col("b").cast("decimal(18,6)").alias("output_price"))
    u, p = usage.alias("u"), F.broadcast(table).alias("p")  # seven rows
    found = u.join(p, (F.col("u.provider") == F.col("p.provider")) & F.col("u.model").startswith(F.col("p.prefix")), "left").drop(F.col("p.provider"))
    best = found.groupBy("call_id", "model", "input_tokens", "output_tokens").agg(F.min(F.struct("ord", "input_price", "output_price")).alias("p"))
    millionths = F.col("input_tokens").cast("decimal(18,0)") * F.col("p.input_price") + F.col("output_tokens").cast("decimal(18,0)") * F.col("p.output_price")
    return best.select("call_id", "model", (F.round(millionths, 0).cast("decimal(24,0)") / 1_000_000).cast("decimal(18,6)").alias("usd"))


def model_size(model: Column) -> Column:
    """Billions of parameters that a model's name tells, null if it tells none.

    In this order: the name's second part between hyphens, N experts of M billion anywhere, active parameters, a plain number.
    """
    text = F.lower(model)
    second = F.get(F.split(F.regexp_extract(text, "([^/]*)$", 1), "-"), F.lit(1))
    number = lambda pattern, group=1, of=text: F.regexp_extract(of, pattern, group).try_cast("double")
    experts = rf"{EDGE}([0-9]+)x([0-9.]+)b{AFTER}"
    return F.coalesce(
        number(r"^([0-9]+)x([0-9.]+)b$", 1, second) * number(r"^([0-9]+)x([0-9.]+)b$", 2, second), number(r"^a?([0-9.]+)b$", 1, second),
        number(experts) * number(experts, 2), number(rf"{EDGE}a([0-9.]+)b{AFTER}"), number(rf"{EDGE}([0-9][0-9.]*)b{AFTER}"),
    )


EDGE, AFTER = "(?:^|[^a-z0-9])", "(?:$|[^a-z0-9])"
