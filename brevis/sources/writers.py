"""Sinks.  Tables are Parquet, partitioned by split where they have one; exports
for other tools are JSON or text."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_stage(df: DataFrame, path: str) -> None:
    """Replace a stage's table, so that running a stage twice doubles nothing."""
    w = df.write.mode("overwrite")
    (w.partitionBy("split") if "split" in df.columns else w).parquet(path)


def write_corpus_json(df: DataFrame, path: str) -> None:
    """JSON lines, a folder a split."""
    df.write.mode("overwrite").partitionBy("split").option("ignoreNullFields", "false").json(path)


def write_corpus_document(df: DataFrame, path: str, order: str = "doc_id") -> None:
    """One JSON document {"train": [row], "val": [row], "test": [row]}.

    Made for exchange: its rows meet in one task and are limited by its memory."""
    columns = [c for c in df.columns if c != "split"]
    rows = df.groupBy("split").agg(F.array_sort(F.collect_list(F.struct(order, F.struct(*columns).alias("row")))).alias("rows"))
    by_split = F.map_from_entries(F.collect_list(F.struct("split", F.transform("rows", lambda r: r["row"]))))
    out = rows.agg(by_split.alias("m")).select(F.struct(*[F.coalesce(F.col("m")[s], F.array().cast(rows.select(F.transform("rows", lambda r: r["row"]).alias("x")).schema["x"].dataType)).alias(s) for s in ("train", "val", "test")]).alias("d"))
    out.select(F.to_json("d")).write.mode("overwrite").text(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_lines(df: DataFrame, column: str, order: list[str], path: str) -> None:
    """A line a row in order; newlines inside become spaces, so rows stay rows."""
    line = F.trim(F.regexp_replace(column, r"[\r\n]+", " "))
    df.orderBy(*order).select(line.alias("value")).write.mode("overwrite").text(path)


def write_scored(df: DataFrame, path: str, kind: str, value: object, reformat: bool, shuffled: bool) -> str:
    """A pruned corpus under a name that tells its parameters."""
    target = f"{path}/all_splits_{kind}_{value}_reformat_{reformat}_order_{not shuffled}"
    write_corpus_json(df, target)
    return target


def fingerprint(df: DataFrame) -> str:
    """A hash of a table's rows, whatever their order: validates a cached stage."""
    h = F.xxhash64(*df.columns).cast("decimal(38,0)")
    row = df.agg(F.count("*"), F.sum(h), F.bit_xor(F.xxhash64(F.lit(1), *df.columns))).first()
    return ":".join(map(str, row))


def write_cached(df: DataFrame, inputs: DataFrame, path: str) -> DataFrame:
    """``df`` from the cache at ``path`` if its inputs are unchanged, else written there."""
    spark, mark = df.sparkSession, fingerprint(inputs)
    try:
        if read_text(spark, f"{path}/fingerprint") == mark:
            return spark.read.parquet(f"{path}/data")
    except FileNotFoundError:
        pass
    df.write.mode("overwrite").parquet(f"{path}/data")
    write_text(spark, f"{path}/fingerprint", mark)
    return spark.read.parquet(f"{path}/data")


def read_text(spark: SparkSession, path: str) -> str:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        raise FileNotFoundError(path)
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def write_figures(spark: SparkSession, path: str, figures: dict) -> None:
    write_text(spark, path, json.dumps(figures, indent=2, ensure_ascii=False))
