"""Page-by-page comparison of a source with a candidate.

Texts are cut into pages of lines; rare tokens of a source page are its
anchors, looked for in the candidate's pages around the place in proportion.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# ---- fixed values
LINES_PER_PAGE, ANCHORS, COVERAGE, SHORT_LINE, REPEATED_PAGES = 50, 18, 0.45, 120, 3
TOKEN = "[A-Za-z][A-Za-z0-9./-]{3,}"
STOP_WORDS = (
    "about after also been being between chapter could does each from have into just more must page should than that their them there these this "
    "those through under using when where which while with within would your"
).split()
RADIUS_PAGES, LEAST_RADIUS, CLUSTER_GAP = 4, 3, 2
# ----


def page_lines(texts: DataFrame, wrap: int, per_page: int = LINES_PER_PAGE) -> DataFrame:
    """texts: doc_id, side, text.  doc_id, side, page (from 1), pos and line: words wrapped at `wrap` to a line, per_page to a page."""
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    n = F.greatest(F.ceil(F.size("w") / wrap), F.lit(1)).cast("int")
    rows = texts.select("doc_id", "side", words.alias("w")).where(F.size("w") > 0)
    rows = rows.select("doc_id", "side", F.posexplode(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.array_join(F.slice(F.col("w"), i * wrap + 1, wrap), " "))).alias("pos", "line"))
    return rows.withColumn("page", (F.floor(F.col("pos") / per_page) + 1).cast("int"))


def repeated_lines(lines: DataFrame) -> DataFrame:
    """Short lines on several pages of a side, such as running heads."""
    short = lines.where((F.length("line") <= SHORT_LINE) & ~F.col("line").startswith("#"))
    return short.groupBy("doc_id", "side", "line").agg(F.count_distinct("page").alias("pages")).where(F.col("pages") >= REPEATED_PAGES)


def pages(lines: DataFrame) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("pos", "line")))  # a page's lines, at most per_page
    return lines.groupBy("doc_id", "side", "page").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), " ").alias("text"))


def tokens(pages_: DataFrame) -> DataFrame:
    """Distinct tokens of each page, lower-cased, without stop words."""
    found = F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0)), F.lower))
    return pages_.select("doc_id", "side", "page", F.explode(found).alias("token")).where(~F.col("token").isin(STOP_WORDS))


def anchors(source_tokens: DataFrame) -> DataFrame:
    """The ANCHORS rarest tokens of each page, longer ones first."""
    frequency = F.count(F.lit(1)).over(Window.partitionBy("doc_id", "token"))
    order = Window.partitionBy("doc_id", "page").orderBy("pages", F.desc(F.length("token")), "token")
    return source_tokens.withColumn("pages", frequency).withColumn("n", F.row_number().over(order)).where(F.col("n") <= ANCHORS).select("doc_id", "page", "token", "pages", "n")


def page_matches(anchors_: DataFrame, all_pages: DataFrame) -> DataFrame:
    """For each source page the candidate page with the largest share of its anchors, the first of equal ones.

    Joined on the document, with the pages' distance as a range condition beside that key.
    """
    sizes = all_pages.groupBy("doc_id").agg(F.count_if(F.col("side") == "source").alias("s"), F.count_if(F.col("side") == "candidate").alias("c")).where("s > 0 and c > 0")
    wanted = anchors_.groupBy("doc_id", "page").agg(F.collect_list("token").alias("tokens")).join(sizes, "doc_id")  # at most ANCHORS
    expected = F.greatest(F.lit(1), F.bround(F.col("page") / F.col("s") * F.col("c"))).cast("int")
    radius = F.greatest(F.lit(LEAST_RADIUS), F.bround(F.col("c") / F.col("s") * RADIUS_PAGES)).cast("int")
    wanted = wanted.withColumns({"low": F.greatest(F.lit(1), expected - radius), "high": F.least(F.col("c"), expected + radius)})
    theirs = all_pages.where("side = 'candidate'").select("doc_id", F.col("page").alias("candidate_page"), F.lower("text").alias("t"))
    near = wanted.join(theirs, "doc_id").where(F.col("candidate_page").between(F.col("low"), F.col("high")))
    hits = F.size(F.filter("tokens", lambda w: F.contains(F.col("t"), w)))
    order = Window.partitionBy("doc_id", "page").orderBy(F.desc("matched"), "candidate_page")
    best = near.select("doc_id", "page", "candidate_page", hits.alias("matched"), F.size("tokens").alias("anchors")).withColumn("r", F.row_number().over(order)).where("r = 1")
    return best.select("doc_id", F.col("page").alias("source_page"), "candidate_page", "matched", "anchors", (F.col("matched") / F.col("anchors")).alias("coverage"))


def clusters(matches: DataFrame, least: float = COVERAGE) -> DataFrame:
    """Suspicious pages in groups without a gap of more than CLUSTER_GAP."""
    by = Window.partitionBy("doc_id").orderBy("source_page")
    fresh = F.coalesce((F.col("source_page") - F.lag("source_page").over(by) > CLUSTER_GAP).cast("int"), F.lit(1))
    grouped = matches.where(F.col("coverage") < least).withColumn("fresh", fresh).withColumn("cluster", F.sum("fresh").over(by))
    return grouped.groupBy("doc_id", "cluster").agg(F.min("source_page").alias("first_page"), F.max("source_page").alias("last_page"), F.count(F.lit(1)).alias("pages"), F.min("candidate_page").alias("candidate_first"), F.max("candidate_page").alias("candidate_last"))
