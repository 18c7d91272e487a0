"""Corpus operators: filters, splits, samples, text shapes, checks, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brevis.functions import text as T


# ------------------------------------------------------------------- filters
def qualify(df: DataFrame, summary: str, body: str, least_summary: int = 200, least_body: int = 12_000) -> DataFrame:
    """Rows whose untrimmed summary and body have so many code points."""
    return df.where((F.length(summary) >= least_summary) & (F.length(body) >= least_body))


def non_empty(df: DataFrame, *columns: str, strip: bool = True) -> DataFrame:
    """Rows whose columns are neither null nor (stripped, if asked) empty."""
    for c in columns:
        df = df.where((T.strip(F.col(c)) if strip else F.col(c)) != "")
    return df


def least_words(df: DataFrame, limits: dict[str, int]) -> DataFrame:
    """Rows with at least so many words in each column."""
    for c, n in limits.items():
        df = df.where(T.ws_length(F.col(c)) >= n)
    return df


# ------------------------------------------------------------ ranks and splits
#: Rows of a bucket that are ranked together, about.
BUCKET_ROWS = 65_536
#: Buckets of one step of a search for a rank.
STEP = 4096


def ranked(df: DataFrame, order: Column, name: str = "rank") -> tuple[DataFrame, int]:
    """A global rank from 0 by ``order``, a hexadecimal hash, and the number of rows.

    Rows are ranked inside buckets of the hash's first digits, as many as the number of
    rows asks for, and the buckets' counts summed up, so that no task sorts the whole
    table; the table of buckets has a row for some thousands of rows."""
    n, digits = df.count(), 0
    while n > BUCKET_ROWS * 16**digits:
        digits += 1
    keyed = df.withColumn("_order", order).withColumn("_bucket", F.substring("_order", 1, digits))
    counts = keyed.groupBy("_bucket").agg(F.count("*").alias("_n"))
    offsets = counts.select("_bucket", (F.sum("_n").over(Window.orderBy("_bucket")) - F.col("_n")).alias("_base"))
    inside = Window.partitionBy("_bucket").orderBy("_order")
    found = keyed.withColumn("_in", F.row_number().over(inside) - 1).join(offsets, "_bucket")
    return found.withColumn(name, F.col("_base") + F.col("_in")).drop("_order", "_bucket", "_in", "_base"), n


def split(df: DataFrame, key: str, seed: int = 123, train: float = 0.7, val: float = 0.1) -> DataFrame:
    """A seeded split: int(train n) rows train, int(val n) rows val, the rest test."""
    r, n = ranked(df, T.seeded_order(seed, key))
    n_train, n_val = int(train * n), int(val * n)
    name = F.when(F.col("rank") < n_train, "train").when(F.col("rank") < n_train + n_val, "val").otherwise("test")
    return r.withColumn("split", name).drop("rank")


def sample(df: DataFrame, key: str, fraction: float, seed: int = 123) -> DataFrame:
    """Exactly int(n fraction) rows without replacement."""
    r, n = ranked(df, T.seeded_order(seed, key))
    return r.where(F.col("rank") < int(n * fraction)).drop("rank")


def head(df: DataFrame, key: str, divisor: int) -> DataFrame:
    """The first n div ``divisor`` rows by ``key``, a whole number (null last): a
    debugging slice.

    The last key is searched for: each step counts the rows of ``STEP`` ranges of keys
    and goes on in the one where the slice ends.  All rows below that range are taken by
    comparison, and only the few rows in it are sorted."""
    x = F.col(key).cast("long")
    n, known, lo, hi = df.agg(F.count("*"), F.count(x), F.min(x), F.max(x)).first()
    left = n // divisor
    if left >= known:
        return df.where(x.isNotNull()).unionByName(df.where(x.isNull()).limit(left - known))
    while True:
        width = -(-(hi - lo + 1) // STEP)
        counts = df.where(x.between(lo, hi)).groupBy(F.floor((x - lo) / width).alias("b")).count().collect()  # STEP rows at most
        for b, rows in sorted(map(tuple, counts)):
            if left < rows:
                lo, hi = lo + b * width, min(hi, lo + (b + 1) * width - 1)
                break
            left -= rows
        if rows <= BUCKET_ROWS or width == 1:
            return df.where(x < lo).unionByName(df.where(x.between(lo, hi)).orderBy(x).limit(left))


# -------------------------------------------------------------------- shapes
def combined(body: Column) -> Column:
    """One string with single spaces, as an array of one."""
    return F.array(T.normalize_space(body))


def with_summary(summary: Column, text: Column) -> Column:
    """A document's summary and text (an array) as one string, for its vocabulary."""
    return F.array_join(F.concat(F.array(summary), text), " ")


def line_sentences(body: Column, least: int = 5, keep_from: int = 11, split_from: int = 200) -> Column:
    """Lines without numbering: long ones cut into sentences of ``least`` code
    points, middling ones whole, short ones dropped."""

    def shape(line: Column) -> Column:
        line = T.strip(T.strip_numbering(line))
        return F.when(F.length(line) >= split_from, T.sentences(line, least)).when(F.length(line) >= keep_from, F.array(line)).otherwise(F.array().cast("array<string>"))

    return F.flatten(F.transform(F.split(body, "\n"), shape))


def chapters(body: Column, chapter_break: str = r"\n\s*\n") -> Column:
    """Chapters of cleaned lines, array<array<string>>; empty lines stay."""

    def clean(line: Column) -> Column:
        return T.strip_numbering(F.replace(T.strip(line), F.lit("***"), F.lit("")))

    return F.transform(F.split(body, chapter_break), lambda c: F.transform(F.split(c, "\n"), clean))


def quick_fix(text: Column) -> Column:
    """An array of one string becomes its pieces between full stops, each with one."""
    return F.when(F.size(text) == 1, F.transform(F.split(F.element_at(text, 1), r"\.", -1), lambda x: F.concat(x, F.lit(".")))).otherwise(text)


def flatten_chapters(df: DataFrame, keep: list[str], chapter_column: str) -> DataFrame:
    """A row for each line: ``keep``, chap_ord, sent_ord, sentence."""
    return df.select(*keep, F.posexplode(chapter_column).alias("chap_ord", "lines")).select(*keep, "chap_ord", F.posexplode("lines").alias("sent_ord", "sentence"))


def text_kind(body: Column) -> Column:
    """``list``, ``chapters`` or ``other``, of a VARIANT or JSON text column."""
    of = F.schema_of_variant(F.try_parse_json(body))
    return F.when(of.startswith("ARRAY"), "list").when(of.startswith("OBJECT"), "chapters").otherwise("other")


def lead_pairs(df: DataFrame, body: str = "text", lead: int = 3, least: int = 10) -> DataFrame:
    """``summary`` and ``sents``: the first sentences, and the rest."""
    s = T.sentences(F.col(body), least)
    return df.withColumn("_s", s).withColumn("summary", F.slice("_s", 1, lead)).withColumn("sents", F.slice("_s", lead + 1, 1 << 30)).drop("_s")


# -------------------------------------------------------------- checks, figures
def aligned(a: DataFrame, b: DataFrame, by: str) -> DataFrame:
    """Rows of both tables in each group of ``by``, and whether they are as many."""
    x, y = a.groupBy(by).agg(F.count("*").alias("n_a")), b.groupBy(by).agg(F.count("*").alias("n_b"))
    return x.join(y, by, "full").select(by, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_a", "n_b")]).withColumn("aligned", F.col("n_a") == F.col("n_b"))


def length_stats(df: DataFrame, *columns: str) -> DataFrame:
    """For each column, mean and population deviation of lengths that are not null."""
    out = []
    for c in columns:
        n = F.length(c)
        out += [F.count(c).alias(f"{c}_n"), F.round(F.avg(n), 4).alias(f"{c}_mean"), F.round(F.stddev_pop(n), 4).alias(f"{c}_std")]
    return df.agg(*out)


def histogram(df: DataFrame, value: Column, bins: int) -> DataFrame:
    """Equal-width bins (1 to ``bins``) between least and most, the last one closed."""
    values = df.select(value.cast("double").alias("v")).where("v is not null")
    edges = values.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    place = F.when(F.col("hi") == F.col("lo"), 1).otherwise(F.least(F.floor((F.col("v") - F.col("lo")) * bins / (F.col("hi") - F.col("lo"))) + 1, F.lit(bins)))
    return values.crossJoin(F.broadcast(edges)).groupBy(place.cast("int").alias("bin")).agg(F.count("*").alias("n"))
