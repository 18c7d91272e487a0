"""Benchmark decontamination: size-partitioned MinHash containment search.

A test item is found in a document when at least ``THRESHOLD`` of the item's
distinct five-word shingles (A-Z lower-cased) stand in the document.

Items are partitioned by size, a partition for each doubling.  In a partition
whose largest item has q shingles, an item's sketch holds the q - ceil(0.75 q)
+ 1 shingles that come first under a random order (its bottom-k MinHash; all of
them if it has fewer).  A document that contains three quarters of an item
misses too few shingles to miss a whole sketch, so the search for sketch
members among a document's shingles loses nothing, however long the document.
A candidate's containment is then counted over all its shingles.

While the items' shingles number ``BROADCAST_SHINGLES`` at most, their sorted
hashes go to every executor and documents are searched in place, without a
shuffle: for sketch members first, and only in documents with a candidate for all; a larger benchmark joins sketches and shingles by hash instead.  Both
give the same pairs.

Defined results: a text without words has no shingles and matches nothing; an
item or text of 1 to 4 words has its whole sequence as its one shingle, and an
item that short is found in longer documents too, as a run of words.  Repeated
items are items of their own; a repeated document row repeats its pairs.  Empty
tables give an empty result; other columns are ignored.  Shingles are compared
by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, U, cut, distinct_sets, documents, mix, pieces, prefix_hash, shingles, span_hash, utf8, words

WORDS = 5
THRESHOLD = 75  # per cent
#: 32 MB of hashes and postings on each executor.
BROADCAST_SHINGLES = 2_000_000


def sketch_size(q: int) -> int:
    """Shingles of the partition of items of size q: 2**k to 2**(k+1) - 1."""
    largest = (1 << q.bit_length()) - 1
    return largest - -(-THRESHOLD * largest // 100) + 1


def document_shingles(data: np.ndarray, offsets: np.ndarray, short: frozenset[int]) -> tuple[np.ndarray, np.ndarray]:
    """Rows and hashes of all five-word shingles, and of runs of the ``short``
    word counts that some items have as their whole."""
    row, h, counts = shingles(data, offsets, WORDS)
    rows, found = [row], [h]
    if short:
        start, end, first = words(data, offsets)
        if len(start):
            one = span_hash(prefix_hash(LOWER[data]), start, end)
            of = np.repeat(np.arange(len(counts)), counts)
            for size in short:
                full = max(0, len(one) - size + 1)
                total = np.full(full, size, U)
                for j in range(size):
                    total += one[j : j + full] * U((2 * j + 3) * 0x2545F4914F6CDD1D & (1 << 64) - 1)
                keep = (of[:full] == of[size - 1 : size - 1 + full]) & (counts[of[:full]] != size)
                rows.append(of[:full][keep])
                found.append(mix(total[keep]))
    return np.concatenate(rows), np.concatenate(found)


def item_shingles(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item, key, h, q, words, sketch) for each distinct shingle of each item;
    ``key`` tells repeated items apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for a, b in pieces(offsets):
                row, h, counts = shingles(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], WORDS)
                h, q = distinct_sets(row, h, b - a)
                owner = np.repeat(np.arange(b - a), q)
                rank = np.empty(len(h), np.int64)
                order = np.lexsort((mix(h ^ U(0x5851F42D4C957F2D)), owner))
                rank[order] = np.arange(len(h)) - np.repeat(np.cumsum(q) - q, q)
                sketch = rank < np.array([sketch_size(int(x)) for x in q], np.int64)[owner] if len(h) else np.empty(0, bool)
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays(
                    [part.column("item").take(pa.array(owner)), part.column("key").take(pa.array(owner)), pa.array(h.view(np.int64)), pa.array(q[owner]), pa.array(counts[owner]), pa.array(sketch)],
                    names=["item", "key", "h", "q", "words", "sketch"],
                )

    kind = dict(items.dtypes)[id_col]
    named = items.select(F.col(id_col).alias("item"), F.monotonically_increasing_id().alias("key"), F.col(text_col).alias("text"))
    return cut(named.mapInArrow(run, f"item {kind}, key long, h long, q long, words long, sketch boolean"), "items")


def find_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", broadcast_shingles: int = BROADCAST_SHINGLES) -> DataFrame:
    """``id_col``, ``item_col``, n_item, n_shared, containment: every item found in every row of ``docs``."""
    spark = docs.sparkSession
    known = item_shingles(items, item_col, item_text_col)
    short = frozenset(r["words"] for r in known.where(f"words < {WORDS}").select("words").distinct().collect())
    doc_kind, item_kind = dict(docs.dtypes)[id_col], dict(items.dtypes)[item_col]
    texts = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    if known.count() <= broadcast_shingles:
        found = _search(texts, known.select("item", "key", "h", "q", "sketch").toArrow(), short, doc_kind, item_kind)
    else:
        found = _join(texts, known, short, doc_kind)
    share = F.col("n_shared") / F.col("n_item")
    return found.where(f"100 * n_shared >= {THRESHOLD} * n_item").select(F.col("doc").alias(id_col), F.col("item").alias(item_col), "n_item", "n_shared", F.round(share, 6).alias("containment"))


def _search(texts: DataFrame, known: pa.Table, short: frozenset[int], doc_kind: str, item_kind: str) -> DataFrame:
    h = known["h"].to_numpy().view(U)
    order = np.argsort(h, kind="stable")
    h, sketch = h[order], known["sketch"].to_numpy()[order]
    _, item_no, = np.unique(known["key"].to_numpy(), return_inverse=True)
    item_no = item_no[order]
    n_items = int(item_no.max()) + 1 if len(item_no) else 0
    size = np.zeros(n_items, np.int64)
    size[item_no] = known["q"].to_numpy()[order]
    name_at = np.zeros(n_items, np.int64)
    name_at[item_no] = order
    names = known["item"].combine_chunks().take(pa.array(name_at))
    sketched = np.flatnonzero(sketch)
    # a first look by the low 20 bits: nearly all shingles go no further
    maybe = np.zeros(1 << 20, bool)
    maybe[(h[sketched] & U((1 << 20) - 1)).astype(np.int64)] = True
    packed = texts.sparkSession.sparkContext.broadcast((h, item_no, h[sketched], item_no[sketched], size, maybe))
    kind = names.type

    def met(row: np.ndarray, value: np.ndarray, n_rows: int, known: np.ndarray, owner: np.ndarray, n_items: int) -> np.ndarray:
        """A number row * n_items + item for each distinct shingle that a row and an item share."""
        value, counts = distinct_sets(row, value, n_rows)
        lo, hi = np.searchsorted(known, value, "left"), np.searchsorted(known, value, "right")
        n = hi - lo
        posting = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return np.repeat(np.repeat(np.arange(n_rows), counts), n) * n_items + owner[posting]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, item_no, sketch, sketch_no, size, maybe = packed.value
        items = max(1, len(size))
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for a, b in pieces(offsets):
                row, value = document_shingles(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], short)
                near = maybe[(value & U((1 << 20) - 1)).astype(np.int64)]
                candidates = np.unique(met(row[near], value[near], b - a, sketch, sketch_no, items))
                if not len(candidates):
                    continue
                # all shingles of the rows that have a candidate
                has = np.zeros(b - a, bool)
                has[candidates // items] = True
                pair, shared = np.unique(met(row[has[row]], value[has[row]], b - a, h, item_no, items), return_counts=True)
                chosen = np.isin(pair, candidates)
                pair, shared = pair[chosen], shared[chosen]
                doc, item = pair // items, pair % items
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc").take(pa.array(doc)), names.take(pa.array(item)), pa.array(size[item], pa.int64()), pa.array(shared, pa.int64())],
                    names=["doc", "item", "n_item", "n_shared"],
                )

    names = names.cast(kind)
    return texts.mapInArrow(run, f"doc {doc_kind}, item {item_kind}, n_item long, n_shared long")


def _join(texts: DataFrame, known: DataFrame, short: frozenset[int], doc_kind: str) -> DataFrame:
    """The same by joins: sketches meet shingles, then candidates are counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for a, b in pieces(offsets):
                row, value = document_shingles(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], short)
                value, counts = distinct_sets(row, value, b - a)
                row = pa.array(np.repeat(np.arange(b - a), counts))
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([part.column("doc").take(row), part.column("key").take(row), pa.array(value.view(np.int64))], names=["doc", "doc_key", "h"])

    keyed = cut(texts.withColumn("key", F.monotonically_increasing_id()), "keyed")
    h = keyed.mapInArrow(run, f"doc {doc_kind}, doc_key long, h long")
    hits = cut(h.join(known.select("h").distinct(), "h", "left_semi"), "hits")
    candidates = hits.join(known.where("sketch").select("h", "key"), "h").select("doc_key", "key").distinct()
    shared = hits.join(known.select("h", "key", "item", "q"), "h").join(candidates, ["doc_key", "key"], "left_semi")
    return shared.groupBy("doc_key", "key").agg(F.first("doc").alias("doc"), F.first("item").alias("item"), F.first("q").alias("n_item"), F.count("*").alias("n_shared")).select("doc", "item", "n_item", "n_shared")


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` in which no item is found, with their columns.

    Null doc_ids are decided row by row like any others' text: a document goes
    if its own (doc_id, text hash) is found."""
    tagged = docs.withColumn("_key", F.struct(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("a"), F.coalesce(F.xxhash64("text"), F.lit(0)).alias("b")))
    found = find_items(tagged.select(F.to_json("_key").alias("k"), "text"), items, id_col="k").select(F.col("k").alias("_k")).distinct()
    return tagged.withColumn("_k", F.to_json("_key")).join(found, "_k", "left_anti").select(*docs.columns)


def op6_decontaminate(spark, sf_dir: str) -> DataFrame:
    return find_items(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_GRAMS = """
  select {id} as id, list_distinct(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                          when len(w) > 0 then [array_to_string(w, ' ')] else []::varchar[] end) as g
  from (select {id}, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from {table})
"""

#: Items of under five words, which the tables don't have, are left to the tests.
ORACLE = f"""
with d as ({_GRAMS.format(id='doc_id', table='documents')}),
b as ({_GRAMS.format(id='item_id', table='benchmark')}),
dg as (select id, unnest(g) as s from d),
bg as (select id, len(g) as q, unnest(g) as s from b),
shared as (select dg.id as doc_id, bg.id as item_id, any_value(q) as q, count(*) as n from dg join bg on dg.s = bg.s group by all)
select doc_id, item_id, cast(q as bigint) as n_item, cast(n as bigint) as n_shared, round(n / q, 6) as containment
from shared where 100 * n >= 75 * q
"""
