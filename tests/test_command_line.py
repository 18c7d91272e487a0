"""The command line, on small files."""

import pytest

from brevis.__main__ import main


def judgement(i):
    return f"<root><Sammendrag>{'s' * 20} {i}</Sammendrag><Premiss>First line of it. And more.\n(1) Second line {i} of it.</Premiss></root>"


def test_prepare_and_run(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(10):
        (tmp_path / "in" / f"{i}.xml").write_text(judgement(i))
    (tmp_path / "in" / "short.xml").write_text("<root><Sammendrag>s</Sammendrag><Premiss>p</Premiss></root>")
    limits = ["--least-summary", "5", "--least-body", "10"]
    for shape, kind in (([], "array<string>"), (["--sentences"], "array<string>"), (["--segmentation"], "array<array<string>>")):
        main(["prepare", "--input", str(tmp_path / "in"), "--output", str(tmp_path / "out"), *limits, *shape], spark)
        got = spark.read.parquet(str(tmp_path / "out"))
        assert dict(got.dtypes)["text"] == kind
        assert {r["split"]: r["count"] for r in got.groupBy("split").count().collect()} == {"train": 7, "val": 1, "test": 2}
    with pytest.raises(SystemExit):
        main(["prepare", "--input", "x", "--output", "y", "--sentences", "--segmentation"], spark)
    rows = [(i, "test" if i < 3 else "train", ["A summary."], ["One sentence.", "Two sentences."]) for i in range(5)]
    spark.createDataFrame(rows, "doc_id long, split string, summary array<string>, sents array<string>").write.parquet(str(tmp_path / "docs"))
    for mode, n in (("train", 5), ("test", 3)):
        main(["run", "--input", str(tmp_path / "docs"), "--output", str(tmp_path / mode), "--method", "paragraph.level", "--mode", mode, "--prompt", "p: "], spark)
        assert spark.read.parquet(str(tmp_path / mode / "combined0")).count() == n
        assert all(r["source"].startswith("p: One") for r in spark.read.parquet(str(tmp_path / mode / "segments0")).collect())
        assert spark.read.parquet(str(tmp_path / mode / "scores")).count() == 1
