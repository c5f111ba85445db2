from quillforge.streaming.intake import DOCUMENTS, scorecards_of, take_in

TEXTS = ["A first line of the text.\nAnd a second one that goes on for a while, long enough for the gate.", "1. one\n2. two\n4. four\n" + "words " * 30, "", None]


def test_files_are_judged_once(spark, tmp_path):
    paths = [f"{tmp_path}/{x}" for x in ("in", "out", "state")]
    frames = [spark.createDataFrame([(10 * n + i, t) for i, t in enumerate(TEXTS)], DOCUMENTS) for n in range(2)]
    want = []
    for frame in frames:
        frame.coalesce(1).write.mode("append").parquet(paths[0])
        take_in(spark, *paths)
        want += scorecards_of(frame).collect()
        take_in(spark, *paths)  # nothing is new
        assert sorted(map(str, spark.read.parquet(paths[1]).collect())) == sorted(map(str, want))
    assert len(want) == 2 * 7 * len(TEXTS)
