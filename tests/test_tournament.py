import os

import duckdb
import pytest
from pyspark.sql import functions as F

from quillforge.operators import checks as k
from quillforge.operators.audit import audits, clip_pages, model_size
from quillforge.operators.pages import clusters
from quillforge.plans import catalogue
from quillforge.sources.candidates import text_to_markdown

DATA = "/root/testdata/sf0.001"


def one(spark, expression, **columns):
    row = spark.createDataFrame([tuple(columns.values())], list(columns))
    return row.select(expression.alias("x")).first().x


@pytest.mark.parametrize(
    ("measure", "md", "want"),
    [
        (lambda md, ls: k.double_bullets(md), "- • a\n* - b\n- c", 2),
        (lambda md, ls: k.list_gaps(ls), "1. a\n2. b\n4. c\n\n1. d\n1. e\ntext\n7. f", 2),
        (lambda md, ls: k.list_gaps(ls), "1. a\n\n2. b\n\n1. new\n", 0),
        (lambda md, ls: k.list_gaps(ls), "1. a\n\t\n3. b", 1),
        (lambda md, ls: k.fragmented_headings(ls), "# Broken\n\there it goes", 1),
        (lambda md, ls: k.fragmented_headings(ls), "# Broken\nhere it goes\n# Whole.\nhere\n# Next\n- item\n", 1),
        (lambda md, ls: k.lone_captions(ls), "*Figure 1. A*\n\n\n\n\n\n<img src='a'>\n\n\n\n\n\n\n\n*Fig. 2.1. B*", 1),
        (lambda md, ls: k.empty_boxes(ls), "# Box 1. A\n\n\n\n\n\nlate\n## Box 2. B\ntext", 1),
        (lambda md, ls: k.odd_image_sizes(md), '<img style="width: 3em"><img style="width:39em"><img width="3"><img style="width:0em">', 3),
        (lambda md, ls: k.repeated_headings(md), "# a\n## a\n# a\n# b\n# b\n#\na\n## c\n# c\nx\n#\nc", 2),
    ],
)
def test_checks(spark, measure, md, want):
    assert one(spark, measure(F.col("md"), F.split("md", "\n")), md=md) == want


@pytest.mark.parametrize(
    ("ref", "want"),
    [("images/a.png", None), ("./images//a.png?x#y", None), ("images/b.png", "missing"), ("../a.png", "escapes"), ("x/../../a.png", "escapes"), ("/a.png", "absolute"), ("C:\\a.png", "absolute"), ("file:///a", "file_url"), ("HTTP://x/y", None), ("#a", "empty")],
)
def test_references(spark, ref, want):
    assert one(spark, k.ref_problem(F.col("r"), F.array(F.lit("images/a.png"))), r=ref) == want


def test_text_conversion(spark):
    text = "one\ntwo\r\n\r\n- a\n- b\n\n  Field: x\ny\n\n\n"
    got = one(spark, text_to_markdown(F.col("t"), F.lit("T"), F.lit("R")), t=text)
    assert got == "# T\n\n**Source:** R\n\n\none two\n\n- a\n- b\n\nField: x\ny\n"
    assert one(spark, text_to_markdown(F.col("t"), F.lit("T"), F.lit("R")), t=" ") == "# T\n\n**Source:** R\n\n"


def test_gates_take_the_first_failure(spark):
    rows = [("ok", 500, 0, 1.0, 1.0, None), ("timeout", 500, 0, 1.0, 1.0, "adapter_run_status"), ("ok", None, 0, 1.0, 1.0, "index_md_exists"), ("ok", 99, 3, 0.1, 0.1, "not_empty"), ("ok", 100, 1, 0.1, 1.0, "no_broken_image_refs"), ("ok", 100, 0, 0.69, 0.1, "charset_plausible"), ("ok", 100, 0, 0.7, 0.39, "text_coverage_minimum")]
    frame = spark.createDataFrame(rows, "status string, chars long, n_unresolved long, printable double, coverage double, want string")
    assert all(r.first_failure == r.want for r in k.gates(frame).collect())


def test_scores_and_sources(spark):
    base = {n: 0 for n in k._MEASURES.values()}
    rows = [("pdf", 1, 1.0, 0, 0), ("pdf", 3, 0.8, 3, 1), ("pdf", 0, 0.5, 6, 0), ("txt", 9, 0.1, 0, 0)]
    frame = spark.createDataFrame([(*r, ["images/a.png"], *base.values()) for r in rows], "source_format string, n_refs long, coverage double, n_missing_words long, sliced long, images array<string>, " + ", ".join(f"{m} long" for m in base.keys()))
    frame = frame.withColumn("n_sliced", F.col("sliced")).withColumn("coverage", F.when(F.col("source_format") == "pdf", F.col("coverage")).otherwise(1.0))
    got = k.scorecards(k.check_rows(frame)).orderBy("n_refs").collect()
    of = lambda r, n: next((c.status, c.score, c.violation, c.severity) for c in r.checks if c.name == n)
    by = {r.n_refs: r for r in got}
    assert of(by[1], "image_count_match") == ("pass", 0.0, None, None) and by[1].total_score == 0 and by[9].total_score == 0
    assert of(by[3], "image_count_match") == ("fail", 30.0, "duplicated_content", "major") and of(by[0], "image_count_match") == ("warn", 6.0, "missing_content", "minor")
    assert of(by[3], "text_coverage") == ("warn", 30.0, "missing_content", "minor") and of(by[0], "text_coverage") == ("fail", 250.0, "missing_content", "major")
    assert of(by[3], "paragraph_not_row_sliced") == ("warn", 6.0, "reading_order", "minor") and by[3].check_scores["text_coverage"] == 30.0
    assert [c.name for c in by[1].checks] == list(k.CHECKS) and len(k.check_rows(frame, ("text_coverage",)).first().checks) == 10


def test_audits_end_with_the_first_accepted(spark):
    ranked = spark.createDataFrame([(1, "a", 0.0, 1, 5.0), (1, "b", 5.0, 2, None), (2, "a", 0.0, 1, 20.0), (2, "b", 20.0, 2, None), *((3, x, float(i), i + 1, i + 1.0) for i, x in enumerate("abcd"))], "doc_id int, adapter string, total_score double, rank int, next_score double")
    found = spark.createDataFrame([(1, "a", 12.0, True), (2, "a", 12.0, True), *((3, x, 50.0, True) for x in "abc")], "doc_id int, adapter string, penalty double, serious boolean")
    got = {r.doc_id: (r.adapter, r.audit, r.attempts) for r in audits(ranked, found).collect()}
    assert got == {1: ("b", "accepted", 2), 2: ("a", "accepted_penalized_major", 1), 3: (None, "escalated", 3)}


def test_pages_and_sizes(spark):
    assert one(spark, clip_pages(F.col("p"), F.lit(2), F.lit(3)), p=[5, 3, 2, 3]) == [2, 3]
    assert one(spark, clip_pages(F.col("p"), F.lit(2), F.lit(3)), p=[9]) == [2]
    assert one(spark, model_size(F.col("m")), m="qwen3.6-35b-a3b") == 35.0
    matches = spark.createDataFrame([(1, n, n, 0.1) for n in (1, 3, 6, 7)] + [(1, 4, 4, 0.9)], "doc_id int, source_page int, candidate_page int, coverage double")
    assert sorted((r.first_page, r.last_page) for r in clusters(matches).collect()) == [(1, 3), (6, 7)]


def test_every_query_has_sql():
    assert set(catalogue.QUERIES) == set(catalogue.ORACLE_SQL) | set(catalogue.WITHOUT_SQL)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    got, want = catalogue.QUERIES[name](spark, DATA).toPandas(), con.execute(catalogue.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def plain(x):
    """Values as Python has them; floats to nine places, since sums differ in their order."""
    if isinstance(x, str) or x is None:
        return x
    if hasattr(x, "__len__"):
        return [plain(e) for e in x]
    x = x.item() if hasattr(x, "item") else x
    return None if x != x else round(x, 9) if isinstance(x, float) else x


def rows(df):
    return sorted(repr([plain(x) for x in r]) for r in df[sorted(df.columns)].astype(object).itertuples(index=False, name=None))
