from quillforge.sources.html import convert_pages, to_markdown


def body(html, **more):
    return to_markdown(f"<html><head><title> A  title </title><style>x</style></head><body>{html}</body></html>", "n", "r", **more).removeprefix("# A  title\n\n**Source:** r\n\n\n")


def test_elements():
    assert body("<h1>One</h1><h5> Five\n words</h5>") == "# One\n\n### Five words\n"
    assert body("<p>too short</p><p>long enough text</p>plain text of some length") == "long enough text\n\nplain text of some length\n"
    assert body("<ol><li>a</li><li> </li><li>b</li></ol><ul><li>c<ul><li>d</li></ul></li></ul>") == "1. a\n\n3. b\n\n- cd\n"
    assert body("<div><section><span>inline but long</span></section></div><nav>left out of it all</nav>") == "inline but long\n"
    assert body("<table><tr><td>1</td></tr></table><br><figcaption>Fig</figcaption>") == "```\n1\n```\n\n\n\n*Fig*\n"
    assert body("<!-- a comment of some length -->x &amp; entities too") == "a comment of some length\n\nx & entities too\n"


def test_images_need_a_local_file():
    page = '<img src="a.png" width="160" alt="x"><img src="http://far/b.png">'
    assert 'src="images/a.png" alt="x" style="width: 10.0em;' in body(page, images=frozenset(["a.png"])) and "<img" not in body(page)


def test_broken_markup_and_depth(spark):
    assert "text that is never closed" in body("<p><b>text that is never closed")
    assert to_markdown("<b>" * 20_000 + "deep text in here", "n", "r").endswith("deep text in here\n")
    rows = spark.createDataFrame([(1, None, None), (2, "u", "<p>some more words</p>")], "page_id long, url string, html string")
    assert {r.page_id: r.md for r in convert_pages(rows).collect()} == {1: "# page-1\n\n**Source:** page-1\n\n", 2: "# page-2\n\n**Source:** u\n\n\nsome more words\n"}
