"""Segmentation: small cases, and properties over generated inputs."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from brevis.operators import segment


def packed(spark, docs, budget):
    df = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "i int, s array<string>")
    return [r["segments"] for r in segment.pack_sentences(df, "s", budget).orderBy("i").collect()]


def greedy(lengths, budget):
    groups, n = [], 0
    for k in lengths:
        if groups and not (n and n + k > budget):
            groups[-1].append(k)
            n += k
        else:
            groups.append([k])
            n = k
    return groups


def test_pack_sentences(spark):
    docs = [["a b c", "d e f", "g h i"], ["a b c d e f g", "h"], ["h", "a b c d e f g", "i"], [], ["a  b", "@@ c\nd\r"]]
    got = packed(spark, docs, 6)
    assert got[0] == ["a b c d e f", "g h i"]
    assert got[1] == ["a b c d e f g", "h"]
    assert got[2] == ["h", "a b c d e f g", "i"]
    assert got[3] == []
    assert got[4] == ["a  b c d"]


def test_pack_matches_plain_python(spark):
    import random

    random.seed(3)
    docs = [[" ".join("w" * random.randint(1, 9)) for _ in range(random.randint(0, 40))] for _ in range(60)]
    got = packed(spark, docs, 12)
    for d, segs in zip(docs, got):
        assert [len(s.split(" ")) for s in segs] == [sum(g) for g in greedy([len(s.split(" ")) for s in d], 12)]
        assert " ".join(segs) == " ".join(d)


def test_pack_chapters_closes_at_chapter_ends(spark):
    chapters = [[["a b", "c d"], ["e f g h i j"]], [["k"]], [[" ", ""]]]
    df = spark.createDataFrame([(chapters,)], "c array<array<array<string>>>")
    assert segment.pack_chapters(df, "c", 5).first()["segments"] == ["a b c d", "e f g h i j", "k"]


def test_split_cuts_at_the_first_minimum():
    assert segment.split_spans([1, 1, 1, 1], [0.5, 0.2, 0.2], 2) == [(0, 2), (2, 4)]
    assert segment.split_spans([9], [], 2) == [(0, 1)]
    assert segment.split_spans([], [], 2) == []


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 9), st.floats(0, 1)), max_size=60), st.integers(1, 30))
def test_leaves_are_a_partition(items, budget):
    lengths, sims = [n for n, _ in items], [f for _, f in items][:-1]
    spans = segment.split_spans(lengths, sims, budget)
    assert [i for lo, hi in spans for i in range(lo, hi)] == list(range(len(lengths)))
    assert all(hi - lo == 1 or sum(lengths[lo:hi]) <= budget for lo, hi in spans)


def test_deep_splits_don_t_recurse():
    n = 3000
    spans = segment.split_spans([10] * n, [i / n for i in range(n - 1)], 10, depth=10**9)
    assert len(spans) == n


def test_combine_keeps_documents_without_pieces(spark):
    docs = spark.createDataFrame([(1,), (2,)], "doc_id long")
    pieces = spark.createDataFrame([(1, 1, "b"), (1, 0, "a")], "doc_id long, seg_ord int, hypo string")
    got = {r["doc_id"]: r["hypo"] for r in segment.combine(pieces, docs, ["doc_id"], "seg_ord", "hypo").collect()}
    assert got == {1: "<s> a </s> b", 2: "<s> "}


def test_streams_run_the_same_operator(spark, tmp_path):
    from brevis.functions import text as T
    from brevis.streaming.segments import stream_segments, write_available

    docs = spark.createDataFrame([(i, f"One sentence {i}. Another one. A third here.") for i in range(20)], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "in"))
    write_available(stream_segments(spark, str(tmp_path / "in"), "doc_id long, text string", 5), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    batch = segment.explode_segments(segment.pack_sentences(docs.withColumn("sents", T.sentences(F.col("text"), 5)), "sents", 5), ["doc_id"])
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == sorted(map(tuple, batch.collect()))
