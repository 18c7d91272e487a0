"""Pruning of scored sentences: (doc_id, sent_ord, sentence, score) in and out."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brevis.functions.text import seeded_order

#: Both sides of a comparison with a mean are rounded so: equal scores all stay.
PLACES = 6


def prune_global(scored: DataFrame, threshold: float) -> DataFrame:
    """Scores above the threshold; one equal to it goes."""
    return scored.where(F.col("score") > threshold)


def prune_local(scored: DataFrame) -> DataFrame:
    """Scores of at least their document's mean."""
    mean = F.avg("score").over(Window.partitionBy("doc_id"))
    return scored.withColumn("_mean", F.round(mean, PLACES)).where(F.round("score", PLACES) >= F.col("_mean")).drop("_mean")


def prune_top(scored: DataFrame, proportion: float) -> DataFrame:
    """The best max(1, int(n p)) sentences of each document, the first of equals."""
    by_doc = Window.partitionBy("doc_id")
    n = F.greatest(F.lit(1), F.floor(F.count("*").over(by_doc) * F.lit(proportion)))
    rank = F.row_number().over(by_doc.orderBy(F.desc("score"), "sent_ord"))
    return scored.withColumn("_n", n).withColumn("_rank", rank).where("_rank <= _n").drop("_n", "_rank")


def shuffled(scored: DataFrame, seed: int = 123) -> DataFrame:
    """With ``new_ord``, each document's sentences in a seeded order."""
    order = Window.partitionBy("doc_id").orderBy(seeded_order(seed, "doc_id", "sent_ord"))
    return scored.withColumn("new_ord", F.row_number().over(order) - 1)


def assembled(scored: DataFrame, order: str = "sent_ord") -> DataFrame:
    """doc_id, text, scores: a document's kept sentences in order; documents of
    which nothing is left don't appear."""
    rows = scored.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), "sentence", "score"))).alias("s"))
    return rows.select("doc_id", F.col("s.sentence").alias("text"), F.col("s.score").alias("scores"))


def as_chapters(pruned: DataFrame) -> DataFrame:
    """``text`` as one chapter with one sub-chapter."""
    return pruned.withColumn("text", F.create_map(F.lit("KAPITTEL_0"), F.create_map(F.lit("KAPITTEL_0-0"), F.col("text"))))


def grid(scored: DataFrame, proportions=(0.3, 0.5, 0.7), thresholds=(0.57, 0.64, 0.71), orders=("source", "shuffled"), reformats=(False, True)) -> dict[str, DataFrame]:
    """All runs of the parameter grid by name; lazy, over one scored table."""
    modes = {f"prop_{p}": prune_top(scored, p) for p in proportions} | {"local": prune_local(scored)} | {f"thr_{t}": prune_global(scored, t) for t in thresholds}
    out = {}
    for mode, kept in modes.items():
        for order in orders:
            doc = assembled(kept) if order == "source" else assembled(shuffled(kept), "new_ord")
            for chapters in reformats:
                out[f"{mode}_{order}_{'chapters' if chapters else 'flat'}"] = as_chapters(doc) if chapters else doc
    return out
