"""Command line: ``python -m brevis prepare`` and ``python -m brevis run``."""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brevis.functions import text as T
from brevis.operators import corpus
from brevis.plans import presets
from brevis.sources import readers, writers


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser("brevis")
    kinds = out.add_subparsers(dest="command", required=True)
    prepare = kinds.add_parser("prepare", help="shape and split judgements")
    prepare.add_argument("--input", required=True, help="folder of XML files")
    prepare.add_argument("--output", required=True)
    prepare.add_argument("--seed", type=int, default=123)
    prepare.add_argument("--least-summary", type=int, default=200)
    prepare.add_argument("--least-body", type=int, default=12_000)
    shape = prepare.add_mutually_exclusive_group()
    shape.add_argument("--segmentation", action="store_true", help="chapters of lines")
    shape.add_argument("--sentences", action="store_true", help="a list of sentences")
    shape.add_argument("--combined", action="store_true", help="one string (the default)")
    run = kinds.add_parser("run", help="run a preset on prepared documents")
    run.add_argument("--input", required=True, help="table of doc_id, split, summary array<string>, sents array<string>")
    run.add_argument("--output", required=True)
    run.add_argument("--method", choices=sorted(presets.PRESETS), default="summ.n")
    run.add_argument("--mode", choices=("train", "test"), default="train", help="test reads the test split only")
    run.add_argument("--finegrained", action="store_true", help="as test mode")
    run.add_argument("--stages", type=int, default=1)
    run.add_argument("--prompt", default="")
    run.add_argument("--cache", help="folder of segments to use again")
    return out


def prepared(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """filename, split, summary and text of the judgements that are long enough."""
    rows = corpus.qualify(readers.judgements(spark, args.input), "summary", "body", args.least_summary, args.least_body)
    body = F.col("body")
    text = corpus.chapters(body) if args.segmentation else corpus.line_sentences(body) if args.sentences else corpus.combined(body)
    return corpus.split(rows.select("filename", T.strip(F.col("summary")).alias("summary"), text.alias("text")), "filename", args.seed)


def main(arguments: Sequence[str] | None = None, spark: SparkSession | None = None) -> None:
    args = parser().parse_args(arguments)
    spark = spark or SparkSession.builder.appName("brevis").getOrCreate()
    if args.command == "prepare":
        writers.write_stage(prepared(spark, args), args.output)
        return
    docs = spark.read.parquet(args.input).where(F.col("split").isin(*presets.splits_of(args.mode, args.finegrained)))
    out = presets.run(docs.select("doc_id", "summary", "sents"), args.method, stages=args.stages, prompt=args.prompt, cache=args.cache)
    for name, table in out.items():
        writers.write_stage(table, f"{args.output}/{name}")


if __name__ == "__main__":
    main()
