import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from brevis.operators import prune, rouge, similarity


def test_pair_scores(spark):
    df = spark.createDataFrame([("the cat sat", "the cat the mat"), ("", "a"), ("æ", "ø")], "h string, r string")
    got = rouge.pair_scores(df, "h", "r").collect()
    assert got[0]["rouge1_precision"] == pytest.approx(2 / 3)
    assert got[0]["rouge1_recall"] == pytest.approx(2 / 4)
    assert got[0]["rouge1_fmeasure"] == pytest.approx(4 / 7)
    assert got[0]["rouge2_fmeasure"] == pytest.approx(2 / 5)
    assert got[0]["rougeL_fmeasure"] == pytest.approx(4 / 7)
    assert all(got[i][c] == 0 for i in (1, 2) for c in got[0].asDict() if c.startswith("rouge"))
    mean = rouge.corpus_scores(rouge.pair_scores(df, "h", "r", ["1"])).first()
    assert mean["rouge1_fmeasure"] == pytest.approx(round(4 / 7 / 3, 4))


def test_bit_lcs_matches_the_table():
    random.seed(5)
    for _ in range(300):
        x, y = ([random.choice("abcd") for _ in range(random.randint(0, 30))] for _ in "xy")
        table = [[0] * (len(y) + 1)]
        for a in x:
            row = [0]
            for j, b in enumerate(y):
                row.append(table[-1][j] + 1 if a == b else max(table[-1][j + 1], row[j]))
            table.append(row)
        assert rouge.lcs_length(x, y) == table[-1][-1]
        want, i, j = set(), len(x), len(y)
        while i and j:
            if x[i - 1] == y[j - 1]:
                i, j = i - 1, j - 1
                want.add(j)
            elif table[i - 1][j] >= table[i][j - 1]:
                i -= 1
            else:
                j -= 1
        assert rouge.lcs_places(x, y) == want


def test_embedding_scores(spark):
    df = spark.createDataFrame([("a b b c", "b c d"), ("", "a"), (None, None)], "h string, r string")
    got = [tuple(r[0]) for r in df.select(rouge.embedding_scores(F.col("h"), F.col("r")).alias("s")).collect()]
    assert got[0] == pytest.approx((3 / 4, 2 / 3, 2 * 0.75 * (2 / 3) / (0.75 + 2 / 3))) and got[1:] == [(0, 0, 0)] * 2

    def halves(x, y):
        return np.full((len(x), len(y)), 0.5)

    assert tuple(df.select(rouge.embedding_scores(F.col("h"), F.col("r"), halves).alias("s")).first()[0]) == (0.5, 0.5, 0.5)


def test_union_lcs():
    p, r, f = rouge.rouge_lsum_scores(["a b c", "d e"], ["a c d", "e b"])
    assert (p, r) == (4 / 5, 4 / 5) or p == pytest.approx(r)
    assert rouge.rouge_lsum_scores(["a b"], ["a b"]) == (1.0, 1.0, 1.0)


def test_greedy_picks():
    picks = rouge.greedy_picks("a b c d", ["a b", "c", "x y z", "a b"])
    assert [p[0] for p in picks] == [0, 1]
    assert [p[1] for p in picks] == sorted({p[1] for p in picks})
    assert rouge.greedy_picks("abc", ["abc"])[0][:2] == (0, 1.0)
    assert rouge.greedy_picks("a", ["b", "c"]) == []
    assert rouge.greedy_picks("", ["b"]) == []


def test_greedy_match_in_source_order(spark):
    df = spark.createDataFrame([("c d a", ["a x", "c d"])], "s string, t array<string>")
    got = df.select(rouge.greedy_match("s", "t").alias("m")).first()["m"]
    assert [p["idx"] for p in got["picks"]] == [1, 0]
    assert got["target"] == "a x c d"


def test_idf(spark):
    df = spark.createDataFrame([("s", "a b a"), ("s", "a"), ("t", "a")], "split string, text string")
    got = {(r["split"], r["token"]): (r["df"], r["idf"]) for r in similarity.idf(df, F.split("text", " "), by="split").collect()}
    assert got == {("s", "a"): (2, 0.0), ("s", "b"): (1, round(math.log(3 / 2), 6)), ("t", "a"): (1, 0.0)}


def test_weighted_f():
    rng = np.random.default_rng(1)
    a, b = rng.standard_normal((4, 8)), rng.standard_normal((3, 8))
    u, v = np.full(4, 0.25), np.full(3, 1 / 3)
    assert similarity.weighted_f(a, b, u, v) == pytest.approx(similarity.weighted_f(b, a, v, u))
    assert similarity.weighted_f(a, a, u, u) == pytest.approx(1.0)
    assert math.isnan(similarity.weighted_f(np.zeros((2, 3)), np.zeros((2, 3)), np.ones(2), np.ones(2)))
    # plain restatement
    cos = [[float(x @ y / np.linalg.norm(x) / np.linalg.norm(y)) for y in b] for x in a]
    p, r = sum(0.25 * max(row) for row in cos), sum(max(row[j] for row in cos) / 3 for j in range(3))
    assert similarity.weighted_f(a, b, u, v) == pytest.approx(2 * p * r / (p + r))


def test_cells_labels_and_thresholds(spark):
    cells = spark.createDataFrame([(1, 0, 0, 0.5), (1, 1, 0, 0.5), (1, 0, 1, 0.9), (1, 1, 1, 0.1), (2, 0, 0, None), (3, 0, 0, 0.0)], "doc_id long, sum_ord int, txt_ord int, f double")
    whole = similarity.complete_documents(cells)
    assert {r["doc_id"] for r in whole.collect()} == {1, 3}
    labels = {(r["doc_id"], r["txt_ord"]): (r["label"], r["sum_ord"]) for r in similarity.best_labels(whole).collect()}
    assert labels == {(1, 0): (0.5, 0), (1, 1): (0.9, 0), (3, 0): (0.0, 0)}
    kth = similarity.kth_values(whole)
    assert {r["doc_id"]: (r["k"], r["kth"]) for r in kth.collect()} == {1: (2, 0.5), 3: (1, 0.0)}
    stats = similarity.threshold_stats(kth).first()
    assert (stats["n"], stats["mean"], stats["std"], stats["median"]) == (1, 0.5, 0.0, 0.5)
    shape = spark.createDataFrame([(1, 2, 2), (3, 2, 1)], "doc_id long, n_summary int, n_text int")
    assert {r["doc_id"] for r in similarity.shape_guard(whole, shape).collect()} == {1}


@pytest.fixture(scope="module")
def scored(spark):
    rows = [(1, 0, "s", 0.1), (1, 1, "t", 0.1), (1, 2, "s", 0.1), (2, 0, "a", 0.5), (2, 1, "b", 0.9), (2, 2, "a", 0.5), (2, 3, "c", 0.1)]
    return spark.createDataFrame(rows, "doc_id long, sent_ord int, sentence string, score double")


def kept(df):
    return sorted((r["doc_id"], r["sent_ord"]) for r in df.collect())


def test_prune_modes(scored):
    assert kept(prune.prune_global(scored, 0.5)) == [(2, 1)]
    assert kept(prune.prune_local(scored)) == [(1, 0), (1, 1), (1, 2), (2, 0), (2, 1), (2, 2)]
    assert kept(prune.prune_top(scored, 0.5)) == [(1, 0), (2, 0), (2, 1)]
    assert kept(prune.prune_top(scored, 0.01)) == [(1, 0), (2, 1)]


def test_assembled_and_shuffled(scored):
    got = {r["doc_id"]: (r["text"], r["scores"]) for r in prune.assembled(prune.prune_top(scored, 0.75)).collect()}
    assert got[2] == (["a", "b", "a"], [0.5, 0.9, 0.5])
    order = [(r["doc_id"], r["sent_ord"], r["new_ord"]) for r in prune.shuffled(scored).orderBy("doc_id", "new_ord").collect()]
    assert sorted(o[:2] for o in order) == kept(scored) and [o[2] for o in order] == [0, 1, 2, 0, 1, 2, 3]
    chapters = prune.as_chapters(prune.assembled(scored)).where("doc_id = 1").first()["text"]
    assert chapters == {"KAPITTEL_0": {"KAPITTEL_0-0": ["s", "t", "s"]}}


def test_grid_has_all_runs(scored):
    runs = prune.grid(scored)
    assert len(runs) == 28
    assert runs["thr_0.71_source_flat"].count() == 1
