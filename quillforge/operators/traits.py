"""Traits of source documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillforge.functions.text import count_matches, evenly_spaced, lines, strip, words

# ---- fixed values
MATH = r"(?i)\\frac|\\sum|\\int|\\alpha|\\beta|\\theta|\$[^$]{1,60}\$|(?<!\w)(sin|cos|tan|log|lim)\s*[({]"
TABLE_HEAVY, IMAGE_HEAVY, TABLE_LINES = 2, 5, 3
SCANNED_WORDS, IMAGES_A_PAGE, TABLE_PAGES, LEFT_PART, COLUMN_GAP, COLUMN_CHARS, COLUMN_SHARE = 60, 1.0, 25, 0.45, 0.15, 20, 0.25
# ----


def text_traits(docs: DataFrame) -> DataFrame:
    text = F.col("text")
    barred = F.size(F.filter(lines(text), lambda x: F.length(x) - F.length(F.replace(x, F.lit("|"), F.lit(""))) >= 2))
    tables = F.when(barred >= TABLE_LINES, 1).otherwise(0)
    return docs.select("doc_id", F.size(words(text)).cast("long").alias("word_count"), tables.alias("table_count"), (tables >= TABLE_HEAVY).alias("is_table_heavy"), text.rlike(MATH).alias("has_math"))


def html_traits(pages: DataFrame) -> DataFrame:
    images, tables = count_matches(F.col("html"), r"(?i)<img\b"), count_matches(F.col("html"), r"(?i)<table\b")
    body = F.regexp_replace("html", "<[^>]+>", " ")
    out = pages.select("page_id", images.alias("image_count"), tables.alias("table_count"), body.alias("body"))
    return out.select(
        "page_id", "image_count", "table_count", F.size(words(F.col("body"))).cast("long").alias("word_count"), (F.col("image_count") >= IMAGE_HEAVY).alias("is_image_heavy"),
        (F.col("table_count") >= TABLE_HEAVY).alias("is_table_heavy"), (F.col("image_count") == 0).alias("is_text_only"), F.col("body").rlike(MATH).alias("has_math"),
    )


def pdf_traits(blocks: DataFrame, image_blocks: DataFrame) -> DataFrame:
    """Traits of PDF sources from their classified text blocks and their images; a document without text blocks has no row.

    Tables are looked for on TABLE_PAGES pages at equal distances, until TABLE_HEAVY are found.  A page has several columns if two
    blocks with enough text begin in its left part and two beyond the gap.
    """
    real = F.length(strip(F.col("text"))) > COLUMN_CHARS
    left, right = F.col("x0") < F.col("page_width") * LEFT_PART, F.col("x0") > F.col("page_width") * LEFT_PART + F.col("page_width") * COLUMN_GAP
    pages = blocks.groupBy("doc_id", "page").agg(
        F.sum(F.size(words(F.col("text")))).alias("words"), F.count_if(F.col("kind") == "table").alias("tables"), F.max(F.col("text").rlike(MATH)).alias("math"),
        ((F.count_if(real & left) >= 2) & (F.count_if(real & right) >= 2)).alias("split"),
    )
    pages = pages.withColumn("n", F.max("page").over(Window.partitionBy("doc_id")))
    looked = F.when(F.array_contains(evenly_spaced(F.col("n"), TABLE_PAGES), F.col("page") - 1), F.col("tables")).otherwise(0)
    before = F.coalesce(F.sum("looked").over(Window.partitionBy("doc_id").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    pages = pages.withColumn("looked", looked).withColumn("counted", F.when(before < TABLE_HEAVY, F.col("looked")).otherwise(0))
    docs = pages.groupBy("doc_id").agg(F.max("n").alias("page_count"), F.sum("words").alias("word_count"), F.sum("counted").alias("table_count"), F.max("math").alias("has_math"), F.count_if("split").alias("split"))
    images = image_blocks.groupBy("doc_id").agg(F.count_distinct("filename").alias("image_count"))
    out = docs.join(images, "doc_id", "left").withColumn("image_count", F.coalesce("image_count", F.lit(0).cast("long")))
    return out.select(
        "doc_id", "page_count", "image_count", "table_count", "word_count", ((F.col("word_count") / F.col("page_count") < SCANNED_WORDS) & (F.col("image_count") > 0)).alias("is_scanned"),
        (F.col("image_count") / F.col("page_count") >= IMAGES_A_PAGE).alias("is_image_heavy"), (F.col("table_count") >= TABLE_HEAVY).alias("is_table_heavy"),
        (F.col("split") / F.col("page_count") >= COLUMN_SHARE).alias("is_multi_column"), (F.col("image_count") == 0).alias("is_text_only"), "has_math",
    )
