"""Segmentation: greedy packing, paragraph packing, minimum-similarity splits,
and putting pieces together again."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brevis.functions import text as T
from brevis.functions.types import SPANS
from brevis.operators.rouge import counts_f, tokens

#: Deepest level of the minimum-similarity split.
MAX_DEPTH = 900


def pack(items: Column, lengths: Column, budget: int) -> Column:
    """Greedy packing: array of arrays of consecutive items.  A group is closed
    when the next item would bring it over ``budget``; an item over the budget is
    a group of its own.

    The fold carries lengths and the places where groups begin, never texts."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("i"), F.array().cast("array<int>").alias("at"))

    def step(a: Column, n: Column) -> Column:
        close = (a["n"] > 0) & (a["n"] + n > budget)
        begins = close | (a["i"] == 0)
        return F.struct(F.when(close, n).otherwise(a["n"] + n).alias("n"), (a["i"] + 1).alias("i"), F.when(begins, F.array_append(a["at"], a["i"])).otherwise(a["at"]).alias("at"))

    def ends(a: Column) -> Column:
        return F.transform(a["at"], lambda b, j: F.struct(b.alias("lo"), F.coalesce(F.get(a["at"], j + 1), a["i"]).alias("hi")))

    spans = F.aggregate(lengths, start, step, ends)
    return T.let(items, lambda own: F.transform(spans, lambda s: F.slice(own, s["lo"] + 1, s["hi"] - s["lo"])))


def clean_sentence(s: Column) -> Column:
    return F.replace(F.replace(F.replace(s, F.lit("\n"), F.lit(" ")), F.lit("\r"), F.lit("")), F.lit("@@ "), F.lit(""))


def prompted(segments: Column, prompt: str) -> Column:
    """Segments that begin with ``prompt``."""
    return F.transform(segments, lambda s: F.concat(F.lit(prompt), s)) if prompt else segments


def pack_sentences(df: DataFrame, sentences: str, budget: int = 478, name: str = "segments", prompt: str = "", query: str | None = None) -> DataFrame:
    """Method 1: sentences, whose lengths count the pieces between single spaces,
    packed into ``name``, array<string>.  ``prompt`` begins each segment; the column
    ``query``, if given, is a segment of its own before the others."""
    cleaned = F.transform(sentences, clean_sentence)
    df = df.withColumn("_c", cleaned).withColumn("_l", F.transform("_c", T.space_length))
    packed = F.transform(pack(F.col("_c"), F.col("_l"), budget), lambda g: T.strip(F.array_join(g, " ")))
    if query is not None:
        packed = F.concat(F.array(T.strip(F.col(query))), packed)
    return df.withColumn(name, prompted(packed, prompt)).drop("_c", "_l")


def _counted(items: Column) -> Column:
    """array<struct<s,n>>: texts with their numbers of words, counted once."""
    return F.transform(items, lambda s: F.struct(s.alias("s"), T.ws_length(s).alias("n")))


def _pack_counted(items: Column, budget: int) -> Column:
    """Groups of counted texts as counted texts."""

    def joined(g: Column) -> Column:
        return F.struct(F.array_join(F.transform(g, lambda x: x["s"]), " ").alias("s"), F.aggregate(g, F.lit(0), lambda n, x: n + x["n"]).alias("n"))

    return T.let(items, lambda own: F.transform(pack(own, F.transform(own, lambda x: x["n"]), budget), joined))


def _texts(counted: Column) -> Column:
    return F.filter(F.transform(counted, lambda x: T.strip(x["s"])), lambda s: s != "")


def pack_paragraphs(df: DataFrame, paragraphs: str, budget: int = 492, name: str = "segments", prompt: str = "") -> DataFrame:
    """Method 2 over a list of paragraphs: packed by words; empty segments go;
    ``prompt`` begins each segment."""
    return df.withColumn(name, prompted(_texts(_pack_counted(_counted(F.col(paragraphs)), budget)), prompt))


def pack_chapters(df: DataFrame, chapters: str, budget: int = 492, name: str = "segments", prompt: str = "") -> DataFrame:
    """Method 2 over chapters of sub-chapters of lines, array<array<array<string>>>:
    lines into paragraphs of at most ``budget`` words, paragraphs into segments; a
    chapter's end closes its segment; ``prompt`` begins each segment."""

    def chapter(c: Column) -> Column:
        return _pack_counted(F.flatten(F.transform(c, lambda sub: _pack_counted(_counted(sub), budget))), budget)

    return df.withColumn(name, prompted(_texts(F.flatten(F.transform(chapters, chapter))), prompt))


def explode_segments(df: DataFrame, keep: list[str], segments: str = "segments") -> DataFrame:
    """A row for each segment; ``keep`` columns, the document's summary say, repeat.

    Exploded with the empty ones, which go afterwards: a plain explode is planned with a
    filter on the segments' number, for which they would be worked out once more."""
    return df.select(*keep, F.posexplode_outer(segments).alias("seg_ord", "source")).where("seg_ord is not null")


def split_spans(lengths: list[int], sims: list[float], budget: int, depth: int = MAX_DEPTH) -> list[tuple[int, int]]:
    """[lo, hi) of the leaves, left to right: a span over the budget is cut after
    the first least of its adjacent similarities."""
    if not lengths:
        return []
    total = [0]
    for n in lengths:
        total.append(total[-1] + n)
    out, todo = [], [(0, len(lengths), 0)]
    while todo:
        lo, hi, d = todo.pop()
        if hi - lo <= 1 or total[hi] - total[lo] <= budget or d > depth:
            out.append((lo, hi))
            continue
        inner = sims[lo : hi - 1]
        cut = lo + inner.index(min(inner)) + 1
        todo += [(cut, hi, d + 1), (lo, cut, d + 1)]
    return out


def split_min_similarity(df: DataFrame, sentences: str, budget: int = 492, name: str = "spans", similarity: Callable[[list[str]], list[float]] | None = None) -> DataFrame:
    """Methods 3 and 4: ``name``, array<struct<lo,hi>> over the sentences.

    ``similarity`` gives the similarity of each sentence and the next; by default
    ROUGE-1 F, rounded to 6 places so that ties fall the same way everywhere."""
    similar = similarity or adjacent_rouge1_f

    @F.pandas_udf(SPANS)
    def spans(column: pd.Series) -> pd.Series:
        out = []
        for items in column:
            items = [] if items is None else list(items)
            lengths = [len(s.split()) for s in items]
            sims = similar(items) if sum(lengths) > budget else []
            out.append([{"lo": lo, "hi": hi} for lo, hi in (split_spans(lengths, sims, budget) if sims else [(0, len(items))] if items else [])])
        return pd.Series(out)

    return df.withColumn(name, spans(F.col(sentences)))


def adjacent_rouge1_f(items: list[str]) -> list[float]:
    counts = [Counter(tokens(s)) for s in items]  # once a sentence, which is in two pairs
    return [round(counts_f(a, b), 6) for a, b in zip(counts, counts[1:])]


def span_texts(sentences: Column, spans: Column) -> Column:
    return F.transform(spans, lambda s: F.array_join(F.slice(sentences, s["lo"] + 1, s["hi"] - s["lo"]), " "))


def combine(df: DataFrame, docs: DataFrame, key: list[str], order: str, piece: str, name: str = "hypo", **figures: Column) -> DataFrame:
    """Pieces of each document of ``docs`` in order, joined by a separator; a
    document without pieces still has the opening mark.  ``figures``: aggregates of a
    document's rows by name, 0 where it has none."""
    grouped = df.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(order, piece))).alias("_p"), *[c.alias(n) for n, c in figures.items()])
    joined = F.array_join(F.transform(F.coalesce("_p", F.array().cast(grouped.schema["_p"].dataType)), lambda x: x[piece]), " </s> ")
    return docs.select(*key).join(grouped, key, "left").select(*key, F.concat(F.lit("<s> "), joined).alias(name), *[F.coalesce(n, F.lit(0)).alias(n) for n in figures])
