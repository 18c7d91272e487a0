"""Sources.  Each gives a keyed DataFrame; nothing is aligned by position."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from brevis.functions.text import last_part, strip

JUDGEMENT = "Disclaimer string, Sammendrag string, Premiss string, Slutning string"
LINKS = "reference string, summary string"
REGRESSION = "summary string, text string, label double, ref string"
LINES = "array<struct<chap:int,sub:int,ord:int,text:string>>"
SPLITS = ("train", "val", "test")

LOADERS: dict[str, Callable[..., DataFrame]] = {}


def loader(name: str):
    """Register a reader under a name, for ``load``."""

    def register(f):
        LOADERS[name] = f
        return f

    return register


def load(spark: SparkSession, name: str, path: str, **options) -> DataFrame:
    return LOADERS[name](spark, path, **options)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


@loader("xml")
def judgements(spark: SparkSession, path: str) -> DataFrame:
    """filename, summary, body of every ``*.xml`` below ``path``, untrimmed."""
    raw = spark.read.format("xml").options(rowTag="root", ignoreSurroundingSpaces="false", pathGlobFilter="*.xml").schema(JUDGEMENT).load(path)
    return raw.select(F.col("_metadata.file_name").alias("filename"), F.col("Sammendrag").alias("summary"), F.col("Premiss").alias("body"))


@loader("links")
def links(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of references and summaries; absent ones are empty."""
    return spark.read.schema(LINKS).json(path).na.fill("")


@loader("regression")
def regression(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(REGRESSION).json(path)


@loader("corpus")
def corpus(spark: SparkSession, path: str) -> DataFrame:
    """A corpus document {"train": [row], "val": [...], "test": [...]} as a long
    table: split, doc_id, summary, kind, lines, scores.

    ``text`` may be a list or a tree of chapters, in one file; both become
    ``lines`` with places.  The key may be called ``filename`` or ``reference``."""
    whole = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("v"))
    out = None
    for split in SPLITS:
        rows = F.try_variant_get("v", f"$.{split}", "array<variant>")
        part = whole.select(F.lit(split).alias("split"), F.explode(rows).alias("r"))
        out = part if out is None else out.unionByName(part)
    kind = F.schema_of_variant(F.try_variant_get("r", "$.text", "variant"))
    key = F.coalesce(F.try_variant_get("r", "$.filename", "string"), F.try_variant_get("r", "$.reference", "string"), F.lit(""))
    listed = F.transform(F.try_variant_get("r", "$.text", "array<string>"), lambda s, i: F.struct(F.lit(0).alias("chap"), F.lit(0).alias("sub"), i.alias("ord"), s.alias("text")))
    # a map keeps a JSON object's order here; places are written down at once
    chapters = F.map_values(F.try_variant_get("r", "$.text", "map<string,map<string,array<string>>>"))
    told = F.flatten(F.flatten(F.transform(chapters, lambda c, i: F.transform(F.map_values(c), lambda s, j: F.transform(s, lambda x, k: F.struct(i.alias("chap"), j.alias("sub"), k.alias("ord"), x.alias("text")))))))
    return out.select(
        "split",
        key.alias("doc_id"),
        F.coalesce(F.try_variant_get("r", "$.summary", "string"), F.lit("")).alias("summary"),
        F.when(kind.startswith("OBJECT"), "chapters").otherwise("list").alias("kind"),
        F.coalesce(F.when(kind.startswith("OBJECT"), told).otherwise(listed), F.array().cast(LINES)).alias("lines"),
        F.try_variant_get("r", "$.scores", "array<double>").alias("scores"),
    )


@loader("pages")
def pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("page_id", "url", "html")


@loader("corpus_lines")
def corpus_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A corpus as ``write_corpus_json`` leaves it: JSON lines in a folder a split, which
    are read in parts however large, with ``split`` from the folder's name."""
    return spark.read.schema(schema).option("basePath", path).json([f"{path}/split={s}" for s in SPLITS if exists(spark, f"{path}/split={s}")] or [path])


@loader("lines")
def lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line_no (from 0) and the stripped ``text`` of every line of text files.

    Lines are numbered inside a file by where they stand; a file is one task's work
    here, so large tables keep keys in Parquet instead."""
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), strip(F.col("value")).alias("text"))
    place = F.row_number().over(Window.partitionBy("file").orderBy("block", "at")) - 1
    return raw.select("file", place.alias("line_no"), "text")


@loader("line_pairs")
def line_pairs(spark: SparkSession, path: str, name: str = "train", debug: int | None = None) -> DataFrame:
    """line_no, source, target of the files ``{name}.source`` and ``{name}.target``,
    as many as the shorter has; the first ``debug`` of them, if it is given."""
    source, target = (lines(spark, f"{path}/{name}.{x}").select("line_no", F.col("text").alias(x)) for x in ("source", "target"))
    found = source.join(target, "line_no")
    return found if debug is None else found.where(F.col("line_no") < debug)


@loader("stage")
def stage(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A stage's table; with a schema, an absent one reads as empty.  A file that can't
    be read is an error."""
    if schema is not None and not exists(spark, path):
        return spark.createDataFrame([], StructType.fromDDL(schema))
    return (spark.read.schema(schema) if schema else spark.read).parquet(path)


@loader("folder")
def folder(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """The rows of a folder of Parquet files, as far as they can be read, and the files
    (path, length) of which no row can: damaged or empty ones.

    Files are told by their listing and by the rows' origin; no column is read for it."""
    rows = spark.read.schema(schema).option("ignoreCorruptFiles", "true").option("recursiveFileLookup", "true").parquet(path)
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(path).select("path", "length")
    read = rows.select(F.col("_metadata.file_path").alias("path")).distinct()
    return rows, listed.join(read, "path", "left_anti")


def short_id(reference: str):
    """The last component of a reference."""
    return last_part(F.col(reference), "/")
