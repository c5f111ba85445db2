"""Text and image blocks of PDF pages to Markdown.

No PDF library is at hand, so blocks come as tables: text_blocks (doc_id, ord,
page, x0, y0, x1, y1, text, avg_font_size, page_width) and image_blocks (doc_id,
ord, page, x0, y0, x1, y1, filename, page_width).  What a block is depends on
its page's mean size, what is done with it on its document; both are windows or
grouped sums over narrow rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillforge.functions.text import lines, strip

# ---- fixed values
LIST_MARK, NUMBER_ONLY, NUMBERED = r"^(?:[-•*+]\s+|\d+[.)]\s+)", r"^\d+[.)]$", r"^(\d+)[.)]\s*(.*)"
CAPTION = r"(?i)^(Figure|Fig\.|Table)\s+\d+(\.\d+)*\.(\s|$)"
HEADING_RATIO, HEADING_CHARS, COLUMN_RATIO, RUNNING_PAGES, NO_SIZE = 1.15, 120, 0.55, 3, 12.0
MAX_EM, MAX_LEVEL = 38.0, 3
IMAGE = '<img src="%s" alt="Figure (page %d)" style="width: %.1fem; max-width: 100%%; display: block; margin: 0.5em 0;" />\n'
BREAK = "\n---\n\n"
# ----


def flat(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def _rows(text: Column) -> Column:
    return F.filter(F.transform(lines(strip(text)), strip), lambda x: x != "")


def is_caption(text: Column) -> Column:
    return strip(text).rlike(CAPTION)


def classified(text_blocks: DataFrame, column_ratio: float = COLUMN_RATIO) -> DataFrame:
    """text_blocks with page_mean, the mean size of the page's blocks, column, y_mid, kind, and caption, whether it is one."""
    page = Window.partitionBy("doc_id", "page")
    text = strip(F.col("text"))
    out = text_blocks.withColumns({"page_mean": F.coalesce(F.avg("avg_font_size").over(page), F.lit(NO_SIZE)), "rows": _rows(F.col("text"))})
    kind = (
        F.when(F.size("rows") == 0, "paragraph")
        .when(F.forall("rows", lambda x: x.rlike(LIST_MARK)), "list")
        .when(F.length(text) - F.length(F.replace(text, F.lit("|"), F.lit(""))) >= 2, "table")
        .when((F.col("avg_font_size") > F.col("page_mean") * HEADING_RATIO) & (F.length(text) < HEADING_CHARS), "heading")
        .when(F.size(F.filter("rows", lambda x: x.rlike(NUMBER_ONLY))) >= 2, "numbered_list")
        .otherwise("paragraph")
    )
    return out.withColumns({"kind": kind, "column": _column(column_ratio), "y_mid": _middle(), "caption": is_caption(F.col("text"))}).drop("rows")


def _column(ratio: float) -> Column:
    return F.when(F.col("x0") > F.col("page_width") * ratio, 1).otherwise(0)


def _middle() -> Column:
    return (F.col("y0") + F.col("y1")) / 2


def running_headers(blocks: DataFrame, least: int = RUNNING_PAGES) -> DataFrame:
    """doc_id, head and pages: headings whose text, folded, stands on at least so many pages."""
    heads = blocks.where("kind = 'heading'").select("doc_id", F.lower(flat(F.col("text"))).alias("head"), "page")
    return heads.groupBy("doc_id", "head").agg(F.count_distinct("page").alias("pages")).where(F.col("pages") >= least)


def without_running(blocks: DataFrame, least: int = RUNNING_PAGES) -> DataFrame:
    gone = running_headers(blocks, least).select("doc_id", "head", F.lit("heading").alias("kind"))
    return blocks.withColumn("head", F.lower(flat(F.col("text")))).join(gone, ["doc_id", "head", "kind"], "left_anti").drop("head")


def heading_levels(blocks: DataFrame) -> DataFrame:
    """doc_id, bucket and level: sizes of headings to the half point, the largest first, levels up to MAX_LEVEL."""
    buckets = blocks.where("kind = 'heading'").select("doc_id", bucket().alias("bucket")).distinct()
    return buckets.withColumn("level", F.least(F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("bucket"))), F.lit(MAX_LEVEL)))


def bucket() -> Column:
    return F.bround(F.col("avg_font_size") * 2) / 2


def caption_images(blocks: DataFrame, image_blocks: DataFrame) -> DataFrame:
    """doc_id, page, ord and filename, image_ord: the image that each caption belongs to; captions on pages without one have none.

    It is the last image of the page at or above the caption, else the nearest.  An as-of join on the page as key, so only a page's
    own images meet its captions.
    """
    caps = blocks.where("caption").select("doc_id", "page", "ord", "y_mid")
    images = image_blocks.select("doc_id", "page", F.col("ord").alias("image_ord"), "filename", _column(COLUMN_RATIO).alias("image_column"), _middle().alias("image_mid"))
    pairs = caps.join(images, ["doc_id", "page"]).withColumn("above", F.col("image_mid") <= F.col("y_mid"))
    order = Window.partitionBy("doc_id", "ord").orderBy(F.desc("above"), F.abs(F.col("image_mid") - F.col("y_mid")), "image_column", "image_mid", "image_ord")
    return pairs.withColumn("r", F.row_number().over(order)).where("r = 1").select("doc_id", "page", "ord", "image_ord", "filename")


def _numbered(text: Column) -> Column:
    """Numbers with the lines up to the next one behind them; what stands before the first number is dropped."""
    piece = lambda x: F.when(x.rlike(NUMBERED), F.concat(F.lit("\n"), F.regexp_extract(x, NUMBERED, 1), F.lit("."), F.when(F.regexp_extract(x, NUMBERED, 2) != "", F.concat(F.lit(" "), strip(F.regexp_extract(x, NUMBERED, 2)))).otherwise(""))).otherwise(F.concat(F.lit(" "), x))
    joined = F.array_join(F.transform(_rows(text), piece), "")
    items = F.regexp_replace(F.concat(F.regexp_extract(joined, r"(?s)\n(.*)$", 1), F.lit("\n")), r"(?m)^(\d+\.)$", "$1 ")
    return F.when(F.contains(joined, F.lit("\n")), items).otherwise(F.concat(strip(text), F.lit("\n")))


def _listed(text: Column) -> Column:
    rows = _rows(text)
    parts = F.filter(F.transform(F.split(F.element_at(rows, 1), r"(?<!^)[•\-*](?=\s)"), strip), lambda x: x != "")
    rows = F.when((F.size(rows) == 1) & (F.size(parts) > 1), parts).otherwise(rows)
    return F.concat(F.array_join(F.transform(rows, lambda x: F.concat(F.lit("- "), strip(F.regexp_replace(x, LIST_MARK, "")))), "\n"), F.lit("\n"))


def rendered(blocks: DataFrame) -> DataFrame:
    """Blocks of one document's kinds with md, their Markdown."""
    levels = heading_levels(blocks)
    out = blocks.withColumn("bucket", bucket()).join(levels, ["doc_id", "bucket"], "left")
    one = flat(F.col("text"))
    md = (
        F.when(F.col("kind") == "heading", F.concat(F.repeat(F.lit("#"), F.coalesce("level", F.lit(2))), F.lit(" "), one, F.lit("\n")))
        .when(F.col("kind") == "numbered_list", _numbered(F.col("text")))
        .when(F.col("kind") == "list", _listed(F.col("text")))
        .when(F.col("kind") == "table", F.concat(F.lit("```\n"), strip(F.col("text")), F.lit("\n```\n")))
        .when(F.col("caption"), F.concat(F.lit("*"), one, F.lit("*\n")))
        .otherwise(F.concat(one, F.lit("\n")))
    )
    return out.withColumn("md", md)


def assembled(text_blocks: DataFrame, image_blocks: DataFrame) -> DataFrame:
    """doc_id, md: the blocks in reading order, captions behind their images, those without one at the end, rules between pages."""
    blocks = without_running(classified(text_blocks))
    texts = rendered(blocks).join(caption_images(blocks, image_blocks).select("doc_id", "ord", "image_ord"), ["doc_id", "ord"], "left")
    spread_ = F.when(F.col("page_width") > 0, F.least((F.col("x1") - F.col("x0")) / F.col("page_width") * MAX_EM, F.lit(MAX_EM))).otherwise(MAX_EM)
    images = image_blocks.select("doc_id", "page", _column(COLUMN_RATIO).alias("column"), _middle().alias("y_mid"), "ord", F.format_string(IMAGE, "filename", "page", F.round(spread_, 1)).alias("md"))
    place = images.select("doc_id", F.col("ord").alias("image_ord"), F.col("column").alias("ic"), F.col("y_mid").alias("im"))
    own = texts.join(place, ["doc_id", "image_ord"], "left")
    attached = F.col("caption") & F.col("image_ord").isNotNull()
    at = lambda last, column, mid, kind, order, sub: F.struct(last.alias("a"), F.col("page").alias("b"), column.alias("c"), mid.alias("d"), kind.alias("e"), order.alias("f"), sub.alias("g"))
    zero = F.lit(0.0)
    text_rows = own.select("doc_id", "page", "md", F.when(attached, at(F.lit(0), F.col("ic"), F.col("im"), F.lit(1), F.col("image_ord"), F.col("y_mid"))).otherwise(at(F.col("caption").cast("int"), F.col("column"), F.col("y_mid"), F.lit(0), F.col("ord"), zero - 1)).alias("at"))
    image_rows = images.select("doc_id", "page", "md", at(F.lit(0), F.col("column"), F.col("y_mid"), F.lit(1), F.col("ord"), zero - 1).alias("at"))
    by = Window.partitionBy("doc_id").orderBy("at")
    rows = text_rows.unionByName(image_rows).withColumn("piece", F.concat(F.when(F.lag("page").over(by) != F.col("page"), F.lit(BREAK)).otherwise(""), "md"))
    pieces = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "piece"))), lambda x: x["piece"]), "\n")  # no more than a document
    name = F.col("doc_id").cast("string")
    return rows.groupBy("doc_id").agg(pieces.alias("body")).select("doc_id", F.concat(F.lit("# Document "), name, F.lit("\n\n**Source:** doc-"), name, F.lit(".pdf\n\n\n"), "body").alias("md"))
