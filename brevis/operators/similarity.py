"""Inverse document frequency, IDF-weighted cosine similarity of sentences, and
the labels and thresholds that follow from similarity cells."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brevis.functions.types import DOUBLE


def document_frequency(df: DataFrame, tokens: Column, by: str | None = None) -> DataFrame:
    """(by,) token, df: documents that have the token.  One count a distinct token
    of a document; combined before the shuffle."""
    keep = [by] if by else []
    return df.select(*keep, F.explode(F.array_distinct(tokens)).alias("token")).groupBy(*keep, "token").agg(F.count("*").alias("df"))


def idf(df: DataFrame, tokens: Column, by: str | None = None, places: int = 6) -> DataFrame:
    """(by,) token, df, idf = ln((n + 1) / (df + 1)), n the documents of the same split."""
    counted = document_frequency(df, tokens, by)
    n = (df.groupBy(by) if by else df).agg(F.count("*").alias("n"))
    joined = counted.join(F.broadcast(n), by) if by else counted.crossJoin(F.broadcast(n))
    return joined.withColumn("idf", F.round(F.log((F.col("n") + 1) / (F.col("df") + 1)), places)).drop("n")


def idf_weights(occurrences: DataFrame, idfs: DataFrame, sentence: list[str], places: int = 6) -> DataFrame:
    """Each token occurrence's share of its sentence's IDF; an unknown token has 0."""
    known = occurrences.join(idfs.select("token", "idf"), "token", "left").withColumn("idf", F.coalesce("idf", F.lit(0.0)))
    total = F.sum("idf").over(Window.partitionBy(*sentence))
    return known.withColumn("weight", F.round(F.col("idf") / (total + 1e-9), places)).drop("idf")


def unit(x: np.ndarray) -> np.ndarray:
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def weighted_f(a: np.ndarray, b: np.ndarray, wa: np.ndarray, wb: np.ndarray, clamp_zero: bool = False) -> float:
    """P = sum of a's weights times each token's best cosine in b, R the other way
    round, F their harmonic mean; NaN where both are 0.  ``clamp_zero`` raises
    negative best cosines to 0, as zero padding does."""
    return best_f(unit(a) @ unit(b).T, wa, wb, clamp_zero)


def best_f(cos: np.ndarray, wa: np.ndarray, wb: np.ndarray, clamp_zero: bool = False) -> float:
    """``weighted_f`` from the cosines of a's tokens (rows) and b's."""
    best_a, best_b = cos.max(1), cos.max(0)
    if clamp_zero:
        best_a, best_b = np.maximum(best_a, 0), np.maximum(best_b, 0)
    p, r = float(wa @ best_a), float(wb @ best_b)
    return 2 * p * r / (p + r) if p + r else float("nan")


@F.pandas_udf(DOUBLE)
def weighted_cosine(a: pd.Series, b: pd.Series, wa: pd.Series, wb: pd.Series) -> pd.Series:
    """F of each pair of sentences: arrays of token vectors and of token weights."""
    out = []
    for x, y, u, v in zip(a, b, wa, wb):
        if x is None or y is None or not len(x) or not len(y):
            out.append(float("nan"))
        else:
            out.append(weighted_f(np.stack(x).astype(np.float64), np.stack(y).astype(np.float64), np.asarray(u, np.float64), np.asarray(v, np.float64)))
    return pd.Series(out)


def similarity_cells(tokens: DataFrame, places: int = 6) -> DataFrame:
    """doc_id, sum_ord, txt_ord, f of every summary and text sentence of a document.

    ``tokens``: doc_id, side (summary or text), sent_ord, tok_ord, weight, vec.  A
    sentence's tokens meet in one row, whose size is the sentence's."""
    sentence = tokens.groupBy("doc_id", "side", "sent_ord").agg(F.array_sort(F.collect_list(F.struct("tok_ord", "weight", "vec"))).alias("t"))

    def side(name: str, order: str, x: str) -> DataFrame:
        return sentence.where(F.col("side") == name).select("doc_id", F.col("sent_ord").alias(order), F.col("t.vec").alias(f"{x}v"), F.col("t.weight").alias(f"{x}w"))

    pairs = side("summary", "sum_ord", "a").join(side("text", "txt_ord", "b"), "doc_id")
    f = F.nanvl(weighted_cosine("av", "bv", "aw", "bw"), F.lit(None))
    return pairs.select("doc_id", "sum_ord", "txt_ord", F.round(f, places).alias("f"))


def complete_documents(cells: DataFrame, f: str = "f") -> DataFrame:
    """Cells of documents without an undefined cell."""
    bad = cells.where(F.col(f).isNull() | F.isnan(f)).select("doc_id").distinct()
    return cells.join(bad, "doc_id", "left_anti")


def shape_guard(cells: DataFrame, docs: DataFrame) -> DataFrame:
    """Cells of documents whose matrix has n_summary rows and n_text columns."""
    shape = cells.groupBy("doc_id").agg((F.max("sum_ord") + 1).alias("rows"), (F.max("txt_ord") + 1).alias("columns"))
    right = shape.join(docs, "doc_id").where("rows = n_summary and columns = n_text").select("doc_id")
    return cells.join(right, "doc_id", "left_semi")


def best_labels(cells: DataFrame) -> DataFrame:
    """doc_id, txt_ord, label (its best f), sum_ord (of the first best)."""
    best = F.max(F.struct("f", (-F.col("sum_ord")).alias("o")))
    return cells.groupBy("doc_id", "txt_ord").agg(best.alias("b")).select("doc_id", "txt_ord", F.col("b.f").alias("label"), (-F.col("b.o")).alias("sum_ord"))


def regression_rows(labels: DataFrame, pairs: DataFrame) -> DataFrame:
    """doc_id, txt_ord, text, summary, label: each text sentence with its best
    summary sentence, from ``best_labels`` and (doc_id, summary, sents)."""
    return labels.join(pairs, "doc_id").select("doc_id", "txt_ord", F.get("sents", F.col("txt_ord")).alias("text"), F.get("summary", F.col("sum_ord")).alias("summary"), "label").where("text is not null and summary is not null")


def kth_values(cells: DataFrame) -> DataFrame:
    """doc_id, k (its summary sentences), kth: the k-th largest f of the document."""
    k = cells.groupBy("doc_id").agg(F.countDistinct("sum_ord").alias("k"))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("f"), "sum_ord", "txt_ord"))
    return cells.withColumn("rank", rank).join(k, "doc_id").where("rank = k").select("doc_id", F.col("k").cast("long").alias("k"), F.col("f").alias("kth"))


def threshold_stats(kth: DataFrame) -> DataFrame:
    """Mean, population deviation and median over the documents' k-th values;
    documents whose value is 0 are passed over."""
    return kth.where("kth != 0").agg(F.count("*").alias("n"), F.round(F.avg("kth"), 5).alias("mean"), F.round(F.stddev_pop("kth"), 5).alias("std"), F.round(F.percentile("kth", 0.5), 5).alias("median"))
