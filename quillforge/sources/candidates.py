"""Documents and their candidate conversions, a row for each document and adapter.

The corpus has clean texts, so most candidates are synthetic: variants of the
text conversion with the damage that the gates and checks look for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillforge.functions.text import let, lines, strip, word_sample, words

# ---- fixed values: lines of a paragraph that keep their breaks
LIST_LINE = r"^\s*(?:[-*+•]|\d+\.)\s"
FIELD_LINE = r"^\w[\w\s]*:\s+\S"
# ----

#: What is appended to a damaged candidate, by doc_id modulo their number.
DAMAGE = [
    "\n- • doubled item\n* - other item\n",
    "\n1. one\n2. two\n4. four\n\n1. uno\n1. dos\n",
    "\n## Broken heading\ncontinues in lower case\n",
    "\n*Figure 3.1. A caption that no image is near*\n",
    "\n## Box 2. Empty box\n\n\n# Next\n",
    "\n## Running head\n\nx\n\n## Running head\n\ny\n\n## Running head\n",
    "\n<img src=\"images/none.png\" style=\"width:50em\">\n![a](./images/a.png \"t\")\n<img src='http://x/y.png'>\n![e](../../etc/p.png)\n",
]
GARBLED = "aeinot"
SLICE_WORDS, TRUNCATED_CHARS = 7, 80
IMAGES = ["images/a.png"]
#: Documents with ids divisible by this stand for PDF sources, for which alone images and words are held against the source.
PDF_EVERY = 2


def text_to_markdown(text: Column, title: Column, ref: Column) -> Column:
    """Paragraphs at blank lines; list and field lines keep their breaks, wrapped prose is joined."""
    paragraphs = F.filter(F.transform(F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n\n"), strip), lambda p: p != "")
    structured = lambda ls: F.exists(ls, lambda x: x.rlike(LIST_LINE) | x.rlike(FIELD_LINE))
    body = F.transform(paragraphs, lambda p: F.concat(let(lines(p), lambda ls: F.when(structured(ls), p).otherwise(F.array_join(ls, " "))), F.lit("\n")))
    head = F.concat(F.lit("# "), title, F.lit("\n\n**Source:** "), ref, F.lit("\n\n"))
    return F.concat(head, let(body, lambda b: F.when(F.size(b) > 0, F.concat(F.lit("\n"), F.array_join(b, "\n"))).otherwise("")))


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, adapter, status, md, images, and of the source its text, format, pages and, of a PDF, a sample of its words.

    The variants are an array in the row, so nothing is shuffled; what depends on the document alone is computed once for all.
    """
    title, ref = F.concat(F.lit("Document "), F.col("doc_id").cast("string")), F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".txt"))
    convert = lambda t: text_to_markdown(t, title, ref)
    text = F.col("text")
    damage = F.element_at(F.array(*map(F.lit, DAMAGE)), (F.pmod("doc_id", F.lit(len(DAMAGE))) + 1).cast("int"))
    variant = lambda name, md, status="ok": F.struct(F.lit(name).alias("adapter"), F.lit(status).alias("status"), md.alias("md"))

    def variants(base: Column) -> Column:
        clean, w = base["clean"], base["words"]
        sliced = F.array_join(F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.size(w) - 1) / SLICE_WORDS), F.lit(0)).cast("int")), lambda i: F.array_join(F.slice(w, i * SLICE_WORDS + 1, SLICE_WORDS), " ")), "\n\n")
        return F.array(
            variant("damaged", F.concat(clean, damage)),
            variant("failed", clean, "timeout"),
            variant("garbled", F.translate(clean, GARBLED, "\ufffd" * len(GARBLED))),
            variant("inhouse", clean),
            variant("linewise", convert(F.replace(text, F.lit("\n"), F.lit("\n\n")))),
            variant("rowsliced", convert(sliced)),
            variant("truncated", F.left(text, F.lit(TRUNCATED_CHARS))),
        )

    pdf = F.pmod("doc_id", F.lit(PDF_EVERY)) == 0
    pages = F.floor((F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1) / 2)
    base = F.struct(convert(text).alias("clean"), words(text).alias("words"))  # bound, so that it is computed once for all variants
    out = docs.select("doc_id", "text", F.when(pdf, word_sample(text)).alias("sample"), pages.alias("pages"), F.when(pdf, "pdf").otherwise("txt").alias("source_format"))
    return out.select("doc_id", F.col("text").alias("source_text"), "source_format", "pages", "sample", F.inline(let(base, variants))).withColumn("images", F.array(*map(F.lit, IMAGES)))
