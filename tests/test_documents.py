import json

import pytest
from pyspark.sql import functions as F

from quillforge.operators import blocks as b
from quillforge.operators import reports as r
from quillforge.operators.responses import decode, json_span, matched_issues, mend, unfenced, verdict_of, verdicts

TEXT = "doc_id long, ord int, page int, x0 double, y0 double, x1 double, y1 double, text string, avg_font_size double, page_width double"
IMAGE = "doc_id long, ord int, page int, x0 double, y0 double, x1 double, y1 double, filename string, page_width double"


def block(i, page, text, size=10.0, x0=50.0, y0=None):
    y0 = 100.0 * i if y0 is None else y0
    return (1, i, page, x0, y0, x0 + 100, y0 + 20, text, size, 600.0)


def test_kinds_of_blocks(spark):
    rows = ["- a\n* b", "a | b | c", "Title", "1.\nx\n2.\ny", "plain text", " ", "Figure 1.2. A caption", "Figure 1 none", "x" * 130]
    frame = spark.createDataFrame([block(i, 1, t, 30.0 if t in ("Title", "x" * 130) else 10.0) for i, t in enumerate(rows)], TEXT)
    got = sorted((x.ord, x.kind, x.caption) for x in b.classified(frame).collect())
    assert [k for _, k, _ in got] == ["list", "table", "heading", "numbered_list", "paragraph", "paragraph", "paragraph", "paragraph", "paragraph"]
    assert [i for i, _, c in got if c] == [6]
    assert b.classified(frame.where("false")).count() == 0


def test_captions_go_to_the_image_above_or_the_nearest(spark):
    texts = spark.createDataFrame([block(1, 1, "Figure 1. below", y0=300.0), block(2, 1, "Fig. 2. on top", y0=10.0), block(3, 2, "Table 3. alone", y0=10.0)], TEXT)
    images = spark.createDataFrame([(1, 1, 1, 0.0, 100.0, 300.0, 150.0, "a.png", 600.0), (1, 2, 1, 0.0, 200.0, 600.0, 250.0, "b.png", 600.0)], IMAGE)
    got = {x.ord: x.filename for x in b.caption_images(b.classified(texts), images).collect()}
    assert got == {1: "b.png", 2: "a.png"}


def test_assembled_markdown(spark):
    texts = [
        block(0, 1, "Chapter", 20.0, y0=0.0), block(1, 1, "Some\nprose here", y0=100.0), block(2, 1, "right column", x0=400.0, y0=0.0), block(3, 1, "Figure 1. Cap", y0=260.0),
        block(4, 2, "Part", 16.0, y0=0.0), block(5, 2, "- one\n- two", y0=50.0), block(6, 2, "0\n1.\nfirst\nmore\n2. second\n3)\n", y0=60.0), block(7, 2, "Table 9. Nowhere", y0=70.0), block(8, 2, "a | b | c", y0=80.0),
        *(block(10 + k, 3 + k, "Running Head" if k % 2 else "running  head", 30.0, y0=0.0) for k in range(3)), *(block(20 + k, 3 + k, "body", y0=50.0) for k in range(3)),
    ]
    images = [(1, 1, 1, 0.0, 200.0, 300.0, 250.0, "images/a.png", 600.0)]
    (row,) = b.assembled(spark.createDataFrame(texts, TEXT), spark.createDataFrame(images, IMAGE)).collect()
    want = [
        "# Document 1\n\n**Source:** doc-1.pdf\n\n", "# Chapter\n", "Some prose here\n", '<img src="images/a.png" alt="Figure (page 1)" style="width: 19.0em; max-width: 100%; display: block; margin: 0.5em 0;" />\n', "*Figure 1. Cap*\n", "right column\n",
        "\n---\n\n## Part\n", "- one\n- two\n", "1. first more\n2. second\n3. \n", "```\na | b | c\n```\n", "\n---\n\nbody\n", "\n---\n\nbody\n", "\n---\n\nbody\n", "\n---\n\n*Table 9. Nowhere*\n",
    ]
    assert row.md == "\n".join(want)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ('{"a": 1}', {"a": 1}), ('so {"a": [1, 2,],} ok', {"a": [1, 2]}), ('{"a": "line\nbreak\ttab"}', {"a": "line\nbreak\ttab"}), ('{"a": {"b": [1, 2', {"a": {"b": [1, 2]}}), ('{"a": "open', {"a": "open"}),
        ('{"a": 1]}', {"a": 1}), ('{"a": "quote \\" and \\\\"}', {"a": 'quote " and \\'}), ('{"a": "x}y]", "b": "{"}', {"a": "x}y]", "b": "{"}), ("no object", None), ("", None), ("[1]", None), ('{"a": "\x01"}', {"a": " "}),
    ],
)
def test_objects_out_of_text(text, want):
    assert decode(text)[0] == want and (want is not None or decode(text)[1])


def test_mended_json_stays_when_it_is_right():
    for x in ({"a": [1, {"b": "c ]}"}], "d": None}, {"text": 'with "quotes" \\ and é'}):
        assert json.loads(mend(json.dumps(x))) == x


def test_verdicts(spark):
    good = {"preferred": "a", "confidence": "sure", "overall_confidence": "x", "violations": [{"type": "t", "count": 0, "pages": [1, 2.0, "x"], "confidence": "high"}, "no", {}]}
    v = verdict_of(json.dumps(good), ["a"])
    assert (v["preferred"], v["confidence"], v["overall_confidence"], v["error"]) == ("a", "medium", None, "")
    assert [(x["type"], x["severity"], x["count"], x["pages"], x["confidence"]) for x in v["violations"]] == [("t", "major", 1, [1, 2], 0.0), ("unknown", "major", 1, [], 0.0)]
    assert verdict_of('{"preferred": "b"}', ["a"])["confidence"] == "error" and verdict_of("", ["a"])["error"]
    frame = spark.createDataFrame([(1, "```json\n{\"preferred\": \"a\"}\n```"), (2, None), (3, "noise {\"preferred\": \"a\", \"confidence\": \"low\"")], "call_id long, raw string")
    assert {x.call_id: x.confidence for x in verdicts(frame, ["a"]).collect()} == {1: "medium", 2: "error", 3: "low"}
    spans = frame.select("call_id", json_span(unfenced(F.col("raw"))).alias("s")).collect()
    assert {x.call_id: x.s for x in spans} == {1: '{"preferred": "a"}', 2: None, 3: '{"preferred": "a", "confidence": "low"'}


def test_greedy_matching_of_issues():
    gold = [[["table", "row"], ["missing"]], [["heading"]], [["table"]]]
    reports = ["A table is missing", "Missing ROW", "the table", "table again", "colour"]
    assert matched_issues(reports, gold) == {"matched": 2, "duplicates": 2, "false_positives": 1}


def test_issue_windows_are_cut_by_span(spark):
    matches = spark.createDataFrame([(1, n, c, 0.1) for n, c in ((1, 1), (2, 2), (3, 12), (5, 13), (6, 14), (20, 20))] + [(1, 4, 4, 0.9)], "doc_id long, source_page int, candidate_page int, coverage double")
    sizes = spark.createDataFrame([(1, 20, 25)], "doc_id long, s int, c int")
    got = [tuple(x)[1:] for x in r.issue_windows(matches, sizes, 0.45, 2).orderBy("issue").collect()]
    assert got == [(1, 2, 1, 3, 1, 3), (2, 3, 2, 7, 11, 15), (3, 1, 19, 20, 19, 21)]


def test_reports_are_read_back(spark, tmp_path):
    rows = [(1, "a", "ok", 10, None, 1.0, 1), (1, "b", "ok", 20, "not_empty", 5.0, None), (1, "c", "timeout", 0, "adapter_run_status", 0.0, None), (2, "a", "ok", 5, None, 3.0, 2), (2, "b", "ok", 6, None, 2.0, 1)]
    runs = spark.createDataFrame(rows, "doc_id long, adapter string, status string, timing_ms long, first_failure string, total_score double, rank int")
    r.write_reports(r.result_documents(runs), f"{tmp_path}/reports")
    got = {(x.doc_id, x.adapter): (x.status, x.timing_ms, x.score, x.won, x.reason) for x in r.read_reports(spark, f"{tmp_path}/reports").collect()}
    assert got == {(d, a): (s, t, score if rank else None, rank == 1, why) for d, a, s, t, why, score, rank in rows}


def test_markdown_table(spark):
    rows = spark.createDataFrame([("a|b", "x\ny", 1), (None, "z", 2)], "p string, q string, n int")
    assert r.markdown_table(rows, ["p", "q", "n"], [F.col("n")]) == "| p | q | n |\n| --- | --- | --- |\n| a\\|b | x y | 1 |\n|  | z | 2 |"
    kinds = spark.createDataFrame([("a/B.PDF",), ("x.tar.htm",), ("none",), ("dir.txt/file",)], "path string").select(r.source_format(F.col("path"))).collect()
    assert [k[0] for k in kinds] == ["pdf", "html", None, None]


def test_traits_of_pdf_sources(spark):
    from quillforge.operators.traits import pdf_traits

    long = "words enough to be a real block"
    texts = [block(i, 1, long, x0=x) for i, x in enumerate((50.0, 60.0, 400.0, 410.0))] + [block(10 + i, 2 + i, "a | b | c | \\frac") for i in range(3)]
    images = [(1, 1, 1, 0.0, 0.0, 10.0, 10.0, "a.png", 600.0), (1, 2, 2, 0.0, 0.0, 10.0, 10.0, "a.png", 600.0)]
    (row,) = pdf_traits(b.classified(spark.createDataFrame(texts, TEXT)), spark.createDataFrame(images, IMAGE)).collect()
    assert row.asDict() == {"doc_id": 1, "page_count": 4, "image_count": 1, "table_count": 2, "word_count": 49, "is_scanned": True, "is_image_heavy": False, "is_table_heavy": True, "is_multi_column": True, "is_text_only": False, "has_math": True}
