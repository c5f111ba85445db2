import hashlib

from pyspark.sql import functions as F

from quillforge.sources.images import MAX_BYTES, image_decision, stored_name, width_em

CASES = [
    ("", "empty", "empty"), (None, "empty", "empty"), ("a/b.png", None, None), ("../x.png", "outside_the_page", "outside_the_page"), ("a/../b.png?q", None, None), ("/etc/x.png", "outside_the_page", "outside_the_page"),
    ("file:///pages/one/a.png", None, None), ("file:///pages/one/../two/a.png", "outside_the_page", None), ("FILE:///etc/passwd", "outside_the_page", None), ("file:///pages/onexx/a.png", "outside_the_page", None),
    ("data:image/png;base64,AA==", None, None), ("data:text/html,x", "not_an_image", "not_an_image"), ("javascript:x", "unsupported_scheme", "unsupported_scheme"),
    ("http://example.org/a.png", "network_disabled", None), ("https://LOCALHOST./a", "network_disabled", "disallowed_host"), ("http://a.localhost:80/x", "network_disabled", "disallowed_host"),
    ("http://127.0.0.1/x", "network_disabled", "disallowed_host"), ("http://u:p@10.1.2.3:8080/x", "network_disabled", "disallowed_host"), ("http://169.254.169.254/meta", "network_disabled", "disallowed_host"),
    ("http://[::1]/x", "network_disabled", "disallowed_host"), ("http://[fe80::1]:80/x", "network_disabled", "disallowed_host"), ("http://224.0.0.1/x", "network_disabled", "disallowed_host"), ("http://8.8.8.8/x", "network_disabled", None),
]


def test_which_images_may_be_taken(spark):
    frame = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "i int, src string").withColumn("root", F.lit("/pages/one"))
    got = frame.select("i", image_decision(F.col("src"), F.col("root")).alias("a"), image_decision(F.col("src"), F.col("root"), network=True, outside=True).alias("b"), image_decision(F.col("src"), F.col("root"), network=True, private=True).alias("c")).collect()
    assert [(CASES[r.i][0], r.a, r.b) for r in sorted(got)] == CASES
    assert "disallowed_host" not in {r.c for r in got}


def test_names_and_widths(spark):
    rows = spark.createDataFrame([(b"abc", 320.0), (b"", 1.0), (b"x" * (MAX_BYTES + 1), None), (None, 5000.0)], "c binary, px double")
    got = rows.select(stored_name(F.col("c"), F.lit(".png")).alias("n"), width_em(F.col("px")).alias("w")).collect()
    assert [r.n for r in got] == [f"img_{hashlib.sha256(b'abc').hexdigest()[:16]}.png", None, None, None] and [r.w for r in got] == [20.0, 0.1, 38.0, 38.0]
