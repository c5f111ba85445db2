"""Hard gates and structural checks of Markdown candidates.

Each is an expression over one row, so a corpus of candidates is judged in the
scan's own tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillforge.functions.text import SPACE, count_matches, fold, java, let, lines, strip
from quillforge.operators.repair import is_sliced

# ---- fixed values: thresholds, patterns, weights and metadata that results depend on
MIN_CHARS, MIN_PRINTABLE, PRINTABLE_FROM, MIN_COVERAGE = 100, 0.70, 200, 0.40
COVERAGE_PASS, COVERAGE_FAIL = 0.9, 0.75
MAX_DETAILS, MULTIPLIER_CAP, MULTIPLIERS = 5, 10, {"paragraph_not_row_sliced": 2}
SEVERITY = {"fail": 10.0, "warn": 2.0, "pass": 0.0}
HEADING = r"^(#{1,6})\s+(.+)"
DOUBLE_BULLET = r"(?m)^[-*]\s+[•\-*]\s+"
NUMBERED = r"^(\d+)\.\s+\S"
CAPTION = r"(?i)^\*(Figure|Fig\.)\s+\d+(\.\d+)*\.\s"
BOX = r"(?i)^#{1,6}\s+Box\s+\d+(\.\d+)*\."
IMG_TAG = r"(?i)<img\s[^>]*>"
IMG_WIDTH = r"(?i)width:\s*([\d.]+)em"
MAX_EM, CAPTION_REACH, BOX_REACH, FRAGMENT_CHARS, REPEATED = 38, 6, 5, 60, 3
#: check: weight, status when it finds issues, whether details are cut to MAX_DETAILS, violation type, severity, confidence
CHECKS = {
    "no_double_bullets": (1.0, "fail", True, "formatting_only_minor", "minor", 0.95),
    "numbered_list_sequential": (1.0, "fail", True, "reading_order", "major", 0.80),
    "heading_not_fragmented": (1.5, "warn", True, "heading_hierarchy", "minor", 0.70),
    "caption_near_image": (3.0, "fail", False, "caption_detachment", "major", 0.85),
    "box_title_precedes_content": (2.0, "fail", False, "heading_hierarchy", "major", 0.75),
    "image_size_plausible": (0.5, "warn", False, "formatting_only_minor", "minor", 0.65),
    "no_repeated_headings": (1.5, "warn", False, "duplicated_content", "minor", 0.80),
    "paragraph_not_row_sliced": (1.5, "warn", True, "reading_order", "minor", 0.80),
    "images_locally_resolvable": (5.0, "fail", True, "orphan_image", "major", 0.95),
    "image_count_match": (3.0, "", True, "missing_content", "major", 0.90),
    "text_coverage": (5.0, "", True, "missing_content", "major", 0.80),
}
# ----


def _places(items: Column, test) -> Column:
    """Indices of the items that pass the test."""
    return F.filter(F.transform(items, lambda x, i: F.when(test(x), i)), lambda i: i.isNotNull())


def _n(c: Column) -> Column:
    return F.size(c).cast("long")


def _blank(x: Column) -> Column:
    return x.rlike(rf"^{SPACE}*$")


def _heading(x: Column) -> Column:
    return x.startswith("#") & x.rlike(java(HEADING))


def double_bullets(md: Column) -> Column:
    return count_matches(md, java(DOUBLE_BULLET))


def list_gaps(ls: Column) -> Column:
    """Steps other than +1 between numbered lines with at most blank lines between; a blank and then 1 begins a new list."""
    numbered = F.transform(ls, lambda x, i: F.struct(i.alias("at"), F.regexp_extract(x, java(NUMBERED), 1).alias("n"), _blank(x).alias("blank")))
    gap = lambda r, p: (r["n"] != "") & (p["n"] != "") & ~((r["at"] - p["at"] > 1) & (r["n"].cast("long") == 1)) & (r["n"].cast("long") != p["n"].cast("long") + 1)
    pairs = lambda rows: F.arrays_zip(F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0))).alias("r"), F.slice(rows, 1, F.greatest(F.size(rows) - 1, F.lit(0))).alias("p"))
    found = _n(F.filter(let(F.filter(numbered, lambda r: ~r["blank"]), pairs), lambda z: gap(z["r"], z["p"])))
    return F.when(F.exists(ls, lambda x: x.rlike(NUMBERED)), found).otherwise(_n(F.slice(ls, 1, 0)))


def fragmented_headings(ls: Column) -> Column:
    def broken(x: Column, after: Column) -> Column:
        open_end = ~F.regexp_extract(x, java(HEADING), 2).rlike(r"[.?!:]$")
        return _heading(x) & open_end & strip(after).rlike(r"^\p{Ll}") & (F.length(strip(after)) < FRAGMENT_CHARS)

    return let(ls, lambda v: _n(F.filter(F.zip_with(v, F.slice(v, 2, F.size(v)), lambda x, y: F.coalesce(broken(x, y), F.lit(False))), lambda x: x)))


def lone_captions(ls: Column) -> Column:
    captions, images = _places(ls, lambda x: x.startswith("*") & x.rlike(java(CAPTION))), _places(ls, lambda x: x.rlike(java(IMG_TAG)))
    lone = lambda c: let(images, lambda v: _n(F.filter(c, lambda x: ~F.exists(v, lambda i: F.abs(i - x) <= CAPTION_REACH))))
    return let(captions, lambda c: F.when(F.size(c) > 0, lone(c)).otherwise(_n(c)))


def empty_boxes(ls: Column) -> Column:
    content = lambda b: F.exists(F.slice(ls, b + 2, BOX_REACH), lambda x: ~_blank(x) & ~strip(x).startswith("#"))
    return _n(F.filter(_places(ls, lambda x: x.startswith("#") & x.rlike(java(BOX))), lambda b: ~content(b)))  # ls is a column, so no work is repeated


def odd_image_sizes(md: Column) -> Column:
    value = lambda t: F.regexp_extract(t, java(IMG_WIDTH), 1).try_cast("double")
    return _n(F.filter(F.regexp_extract_all(md, F.lit(java(IMG_TAG)), F.lit(0)), lambda t: value(t).isNull() | (value(t) <= 0) | (value(t) > MAX_EM)))


def repeated_headings(md: Column) -> Column:
    """Heading texts that come REPEATED times and more, counted at the first of their places in order."""
    heads = F.transform(F.regexp_extract_all(md, F.lit(java("(?m)" + HEADING)), F.lit(2)), strip)
    opens = lambda v, i: (F.get(v, i + REPEATED - 1) == F.get(v, i)) & ((i == 0) | (F.get(v, i - 1) != F.get(v, i)))
    return let(F.array_sort(F.filter(heads, lambda x: x != "")), lambda v: _n(F.filter(F.transform(v, lambda x, i: F.coalesce(opens(v, i), F.lit(False))), lambda x: x)))


def image_refs(md: Column) -> Column:
    """Sources of image tags, then destinations of Markdown images."""
    source = lambda t: F.concat(F.regexp_extract(t, "(?i)src\\s*=\\s*\"([^\"]*)\"", 1), F.regexp_extract(t, "(?i)src\\s*=\\s*'([^']*)'", 1))
    tags = F.transform(F.regexp_extract_all(md, F.lit(IMG_TAG), F.lit(0)), lambda t: F.trim(source(t)))
    plain = lambda d: F.when(d.startswith("<"), F.regexp_extract(d, r"^<([^>]+)>", 1)).otherwise(F.regexp_replace(F.regexp_extract(d, r"^\S+", 0), "^['\"]+|['\"]+$", ""))
    marks = F.transform(F.regexp_extract_all(md, F.lit(r"!\[[^\]]*\]\(([^)]+)\)"), F.lit(1)), lambda d: plain(F.trim(d)))
    return F.filter(F.concat(tags, marks), lambda s: s != "")


def bare_ref(ref: Column) -> Column:
    """Without query and fragment."""
    return F.trim(F.regexp_replace(ref, r"(?s)[#?].*$", ""))


def ref_problem(ref: Column, images: Column) -> Column:
    """Why a reference can't be resolved inside the candidate's folder; null for good and external ones."""
    depth = lambda parts, k: F.aggregate(F.slice(parts, F.lit(1), k), F.lit(0), lambda a, s: a + F.when(s == "..", -1).otherwise(1))

    def local(parts: Column) -> Column:
        escapes = F.exists(F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1))), lambda k: depth(parts, k) < 0)
        return F.when(escapes, "escapes").when(~F.array_contains(images, F.array_join(parts, "/")), "missing")

    def problem(r: Column) -> Column:
        inside = let(F.filter(F.split(r, "/"), lambda s: (s != "") & (s != ".")), local)
        external = r.rlike("(?i)^(http://|https://|data:)")
        return F.when(r == "", "empty").when(external, F.lit(None).cast("string")).when(r.rlike("(?i)^file://"), "file_url").when(r.startswith("/") | r.rlike("^[A-Za-z]:/"), "absolute").otherwise(inside)

    return let(F.replace(bare_ref(ref), F.lit("\\"), F.lit("/")), problem)


def unresolved_images(md: Column, images: Column) -> Column:
    return _n(F.filter(image_refs(md), lambda r: ref_problem(r, images).isNotNull()))


def ref_key(ref: Column) -> Column:
    r = bare_ref(ref)
    return F.when(r.rlike("(?i)^(http://|https://|data:|file://)"), r).otherwise(F.regexp_extract(F.replace(r, F.lit("\\"), F.lit("/")), "([^/]*)/*$", 1))


def printable_share(md: Column) -> Column:
    good = F.length(F.regexp_replace(md, "[\\p{C}\\p{Z}\ufffd&&[^ \\n\\r\\t]]", ""))
    return good / F.greatest(F.length(md), F.lit(1))


def judged(cands: DataFrame) -> DataFrame:
    """cands and a column for each measure that gates and checks use; every one is null where the candidate has no text.

    Words and images are held against PDF sources only: for others the coverage is 1 and no word is missing.
    """
    md, sample, pdf = F.col("md"), F.col("sample"), F.col("source_format") == "pdf"
    found = let(fold(md), lambda f: F.size(F.filter(sample, lambda w: F.contains(f, w))))
    out = cands.withColumns({"ls": lines(md), "hits": F.when(pdf & (F.size(sample) > 0), found)})
    ls, hits = F.col("ls"), F.col("hits")
    none = F.when(md.isNotNull(), F.lit(0))
    out = out.withColumns({
        "chars": F.length(strip(md)).cast("long"), "printable": F.when(F.length(md) < PRINTABLE_FROM, F.lit(1.0)).otherwise(printable_share(md)),
        "coverage": F.coalesce(hits / F.size(sample), F.when(md.isNotNull(), F.lit(1.0))), "n_double_bullets": double_bullets(md), "n_list_gaps": list_gaps(ls), "n_fragmented": fragmented_headings(ls),
        "n_captions": lone_captions(ls), "n_boxes": empty_boxes(ls), "n_sizes": odd_image_sizes(md), "n_repeated": repeated_headings(md), "n_sliced": F.when(md.isNotNull(), is_sliced(md).cast("long")),
        "n_unresolved": unresolved_images(md, F.col("images")), "n_refs": _n(F.array_distinct(F.transform(image_refs(md), ref_key))), "n_missing_words": F.coalesce(F.size(sample) - hits, none).cast("long"),
    })
    return out.drop("ls", "sample", "hits")


def gates(j: DataFrame) -> DataFrame:
    """doc_id, adapter and first_failure: the first gate that the candidate fails, null if it passes all."""
    failure = (
        F.when(F.col("status") != "ok", "adapter_run_status")
        .when(F.col("chars").isNull(), "index_md_exists")
        .when(F.col("chars") < MIN_CHARS, "not_empty")
        .when(F.col("n_unresolved") > 0, "no_broken_image_refs")
        .when(F.col("printable") < MIN_PRINTABLE, "charset_plausible")
        .when(F.col("coverage") < MIN_COVERAGE, "text_coverage_minimum")
    )
    return j.withColumn("first_failure", failure)


_MEASURES = {
    "no_double_bullets": "n_double_bullets", "numbered_list_sequential": "n_list_gaps", "heading_not_fragmented": "n_fragmented", "caption_near_image": "n_captions",
    "box_title_precedes_content": "n_boxes", "image_size_plausible": "n_sizes", "no_repeated_headings": "n_repeated", "paragraph_not_row_sliced": "n_sliced", "images_locally_resolvable": "n_unresolved",
}


def check_rows(j: DataFrame, disabled: tuple[str, ...] = ()) -> DataFrame:
    """checks: an array of (name, status, issues, score, violation, severity) in the order of the run, without the disabled ones."""
    def entry(name: str, status: Column, issues: Column, kind: Column | None = None, grade: Column | None = None) -> Column:
        weight, _, cut, violation, severity, _ = CHECKS[name]
        details = F.least(issues, F.lit(MAX_DETAILS)) if cut else issues
        multiplier = F.lit(MULTIPLIERS[name]) if name in MULTIPLIERS else F.greatest(F.least(details, F.lit(MULTIPLIER_CAP)), F.lit(1))
        points = F.when(status == "fail", SEVERITY["fail"]).when(status == "warn", SEVERITY["warn"]).otherwise(0.0)
        found = status != "pass"
        return F.struct(
            F.lit(name).alias("name"), status.alias("status"), issues.alias("issues"), (F.lit(weight) * points * multiplier.cast("double")).alias("score"),
            F.when(found, F.lit(violation) if kind is None else kind).alias("violation"), F.when(found, F.lit(severity) if grade is None else grade).alias("severity"),
        )

    pdf = F.col("source_format") == "pdf"
    major_if_failed = lambda status: F.when(status == "fail", "major").otherwise("minor")
    rows = [entry(n, F.when(F.col(m) > 0, CHECKS[n][1]).otherwise("pass"), F.col(m)) for n, m in _MEASURES.items()]
    difference = F.when(pdf, F.col("n_refs") - F.size("images")).otherwise(0)
    status = F.when(difference == 0, "pass").when(F.abs(difference) == 1, "warn").otherwise("fail")
    rows.append(entry("image_count_match", status, F.when(difference != 0, 1).otherwise(0).cast("long"), F.when(difference < 0, "missing_content").otherwise("duplicated_content"), major_if_failed(status)))
    status = F.when(F.col("coverage") >= COVERAGE_PASS, "pass").when(F.col("coverage") < COVERAGE_FAIL, "fail").otherwise("warn")
    rows.append(entry("text_coverage", status, F.col("n_missing_words"), None, major_if_failed(status)))
    return j.withColumn("checks", F.array(*[r for r, name in zip(rows, [*_MEASURES, "image_count_match", "text_coverage"], strict=True) if name not in disabled]))


def scorecards(c: DataFrame) -> DataFrame:
    """total_score, the numbers of failed, warned and passed checks, and a map of what each check adds."""
    count = lambda s: F.size(F.filter("checks", lambda x: x["status"] == s)).cast("long")
    return c.withColumns({"total_score": F.aggregate("checks", F.lit(0.0), lambda a, x: a + x["score"]), "fail_count": count("fail"), "warn_count": count("warn"), "pass_count": count("pass"), "check_scores": F.map_from_entries(F.transform("checks", lambda x: F.struct(x["name"], x["score"])))})
