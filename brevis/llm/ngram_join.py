"""N-gram Jaccard join by PartEnum signatures.

A document's set is that of its distinct five-word shingles (A-Z lower-cased);
with fewer words the whole sequence is its one shingle; without words it is
empty and linked with nothing.  Two documents link when
100 * |intersection| >= 75 * |union|.

Such sets differ in at most (m + m') / 7 elements, where m and m' are their
sizes, and m' <= 4 m / 3.  So sizes are banded, a band for each power of
``RATIO``, and a set takes part in its own band and, if a partner could be
there, in the next.  In a band the shingle domain is cut into as many parts as
make differing sets agree on some part that is not empty: with d differences, at
most d parts differ.  A signature is (band, part, the set's content of the
part), PartEnum with one part to a subset.  Of a set's signatures in a random
but common order the first d + 1 suffice: a set that agrees with it in all but d
of its parts must share one of them.  The order is rare content first, by a table
of shingle counts of a fixed size, so that passages that many documents share
seldom sign.  A set with d or fewer parts that are not
empty, for which this proves nothing, also signs with its single shingles, the
finest partition, of which a quarter plus one suffice.

Sets are identified by a 64-bit hash, so exact copies are one node and sign once
a task.  A signature that several nodes have gets a hub, the greatest of them, and
(node, hub) is all that is kept of it: a node goes to a hub once however many
signatures lead it there.  Nodes meet in two rounds.  First each is paired with its
hubs, so that variants of one text meet through one of them; the pairs are verified
by exact intersection and the links' components found.  Then the nodes of the hubs
of one component are a group, and in groups that hold several components nodes of
different ones are compared, in blocks; blocks of the group's
largest component meet those of the others only.  In both rounds a parity sketch
decides first: each set keeps a bit a bucket, the parity of its elements there, over
two to four buckets an element, and two sets whose sketches differ in more bits
than their sets may differ in elements don't become a pair.  Whole sketches meet
inside the block, so only links and pairs just short of one leave it.  After that
every pair that shares a signature is verified, excluded or in one component, so the
components are exact.  Nothing is collected or cut off.

Texts are cut into shingles twice, once for sets' hashes, sketches and counts and
once for signatures, and those of pairs to be verified once more.

Defined results: repeated rows are copies; a null text has an empty set; a null
doc_id never is a component's id unless there is no other; an empty table gives
an empty result; other input columns are ignored.  Shingles and sets are compared
by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import FILTER_BITS, U, bitmap, cut, discard, distinct_sets, documents, first_seen, in_bitmap, lists, mix, pieces, row_key, rows_with_keys, shingles, utf8
from .blocks import across, groups, likely, parity_sketches, widths
from .components import components

WORDS = 5
PERCENT = 75
RATIO = 3
#: Parts to an element of the largest set of a band: a set's parts that are not empty
#: are just more than may differ, and a signature holds two elements or so.
FILL = 0.45
#: Shingles are counted by the low bits of their hash, in a table of 2 MB.
COUNTERS = 1 << 18


def sets_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct shingles of the rows, their counts, and the rows' set hashes."""
    row, h, _ = shingles(data, offsets, WORDS)
    h, count = distinct_sets(row, h, len(offsets) - 1)
    first = np.cumsum(count) - count
    node = np.zeros(len(count), U)
    some = np.flatnonzero(count)
    if len(some):
        node[some] = mix(np.add.reduceat(mix(h), first[some]) + count[some].astype(U))
    return h, count, node


def sketches(h: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The parity sketches of the rows' sets, one after the other, and their lengths in
    64-bit words: two to four buckets an element."""
    width = widths(count, 2)
    return parity_sketches(mix(h ^ U(0xC2B2AE3D27D4EB4F)), count, width), width


def near_sizes(m: np.ndarray, n: np.ndarray) -> np.ndarray:
    return 100 * np.minimum(m, n) >= PERCENT * np.maximum(m, n)


def may_link(apart: np.ndarray, m: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether sets of sizes m and n, whose sketches differ in ``apart`` bits, may link."""
    return (7 * apart <= m + n) & near_sizes(m, n)


def parts_of_band(band: np.ndarray) -> np.ndarray:
    return np.maximum(16, np.ceil(FILL * RATIO ** (band + 1.0)).astype(np.int64))


def signatures(h: np.ndarray, count: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and signature, for all rows' sorted sets one after the other; ``seen``
    counts shingles by their low bits."""
    n = len(count)
    first = np.cumsum(count) - count
    m = count.astype(np.int64)
    band = np.zeros(n, np.int64)
    for b in range(1, 32):
        band += m >= RATIO**b
    rows, found = [], []
    weak = np.zeros(n, bool)
    mixed = mix(h)
    common = seen[(h & U(COUNTERS - 1)).astype(np.int64)]
    for step in (0, 1):
        at = band + step
        largest = np.minimum(4 * m // 3, RATIO ** (at + 1) - 1)
        take = np.flatnonzero((m > 0) & ((step == 0) | (largest >= RATIO**at)))
        if not len(take):
            continue
        differ = (m + largest) // 7
        size = m[take]
        row = np.repeat(take, size)
        pos = np.repeat(first[take] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        # sorted sets have their parts in order: the part is the hash's upper fraction
        part = (h[pos] >> U(32)) * np.repeat(parts_of_band(at[take]).astype(U), size) >> U(32)
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (part[1:] != part[:-1])
        start = np.flatnonzero(new)
        content = np.add.reduceat(mixed[pos], start)
        owner = row[start]
        sign = mix(content ^ (part[start] * U(0x9E3779B97F4A7C15)) ^ mix(at[owner].astype(U) + U(1)))
        owner, sign = _first(owner, sign, np.maximum.reduceat(common[pos], start), differ + 1, n)
        rows.append(owner)
        found.append(sign)
        weak[take] |= np.bincount(row[start], minlength=n)[take] <= differ[take]
    take = np.flatnonzero(weak)
    if len(take):
        size = m[take]
        row = np.repeat(take, size)
        pos = np.repeat(first[take] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        owner, sign = _first(row, mix(h[pos] ^ U(0xD6E8FEB86659FD93)), common[pos], m - -(-3 * m // 4) + 1, n)
        rows.append(owner)
        found.append(sign)
    if not rows:
        return np.empty(0, np.int64), np.empty(0, U)
    return np.concatenate(rows), np.concatenate(found)


def _first(owner: np.ndarray, sign: np.ndarray, common: np.ndarray, most: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``most[row]`` signatures of each row, rare ones before common ones."""
    order = np.lexsort((sign, common, owner))
    owner, sign = owner[order], sign[order]
    count = np.bincount(owner, minlength=n)
    rank = np.arange(len(owner)) - (np.cumsum(count) - count)[owner]
    keep = rank < most[owner]
    return owner[keep], sign[keep]


def _node_table(texts: DataFrame) -> DataFrame:
    """(doc, key, n_shingles, node, sketch) for each row, the sketch for the first of
    a node in a task only; and rows (slot, n): the task's shingles by their low bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        total = np.zeros(COUNTERS, np.int64)
        kind = None
        for batch in batches:
            kind = batch.schema.field("doc").type
            data, offsets = utf8(batch.column("text"))
            for a, b in pieces(offsets):
                h, count, node = sets_of(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                total += np.bincount((h & U(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS)
                fresh = np.zeros(b - a, bool)
                fresh[first_seen(node, seen)] = True
                fresh &= count > 0
                words, width = sketches(h[np.repeat(fresh, count)], count[fresh])
                sizes = np.zeros(b - a, np.int64)
                sizes[fresh] = width
                none = pa.nulls(b - a, pa.int32()), pa.nulls(b - a, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc").slice(a, b - a), batch.column("key").slice(a, b - a), pa.array(count, pa.int64()), pa.array(node.view(np.int64)), lists(words.view(np.int64), sizes, pa.int64()), *none],
                    names=["doc", "key", "n_shingles", "node", "sketch", "slot", "n"],
                )
        some = np.flatnonzero(total)
        if len(some):
            none = [pa.nulls(len(some), t) for t in (kind, pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*none, pa.array(some, pa.int32()), pa.array(total[some])], names=["doc", "key", "n_shingles", "node", "sketch", "slot", "n"])

    return texts.mapInArrow(run, f"doc {dict(texts.dtypes)['doc']}, key long, n_shingles long, node long, sketch array<long>, slot int, n long")


def _shingle_counts(table: DataFrame) -> np.ndarray:
    """Over all sets, the number of shingles with each value of the low bits."""
    counted = table.where("slot is not null").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(COUNTERS, np.int64)
    out[counted["slot"].to_numpy()] = counted["n"].to_numpy()
    return out


def _signature_table(texts: DataFrame, counts) -> DataFrame:
    """(node, signs): a list of signatures for each set, once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for a, b in pieces(offsets):
                h, count, node = sets_of(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                fresh = np.zeros(b - a, bool)
                fresh[first_seen(node, seen)] = True
                fresh &= count > 0
                h, count, node = h[np.repeat(fresh, count)], count[fresh], node[fresh]
                owner, sign = signatures(h, count, counts.value)
                order = np.argsort(owner, kind="stable")
                yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), lists(sign[order].view(np.int64), np.bincount(owner, minlength=len(count)), pa.int64())], names=["node", "signs"])

    return texts.select("text").mapInArrow(run, "node long, signs array<long>")


def _hubs(signed: DataFrame) -> DataFrame:
    """(node, hub) of the signatures that several nodes have; the hub itself is a node
    of its own.

    They are found by an aggregation, which combines in the map task, and joined back,
    so that no task gathers a very common signature."""
    several = signed.select(F.explode("signs").alias("sign"), "node").groupBy("sign").agg(F.min("node").alias("x"), F.max("node").alias("hub")).where("x != hub").select("sign", "hub")
    several = cut(several, "several")
    hubs = cut(rows_with_keys(signed, several, "signs", "sign").select("node", "hub").distinct(), "hubs")
    discard(several)
    return hubs


def _set_table(texts: DataFrame, nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, items) of the wanted nodes, from one text of each.  A filter of a fixed
    size spares the other texts the cutting; the exact join decides."""
    keys = nodes.join(wanted, "node", "left_semi").groupBy("node").agg(F.min("key").alias("key")).select("key")
    sent = texts.sparkSession.sparkContext.broadcast(bitmap(keys, FILTER_BITS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            batch = batch.take(pa.array(np.flatnonzero(in_bitmap(sent.value, batch.column("key").to_numpy().view(U)))))
            data, offsets = utf8(batch.column("text"))
            for a, b in pieces(offsets):
                h, count, node = sets_of(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                keep = np.zeros(b - a, bool)
                keep[first_seen(node, seen)] = True
                keep &= count > 0
                yield pa.RecordBatch.from_arrays([pa.array(node[keep].view(np.int64)), lists(h[np.repeat(keep, count)].view(np.int64), count[keep], pa.int64())], names=["node", "items"])

    sets = cut(texts.select("text", "key").mapInArrow(run, "node long, items array<long>").join(wanted, "node", "left_semi").dropDuplicates(["node"]), "sets")
    sent.destroy()
    return sets


def _near(a: Column, b: Column) -> Column:
    """Whether sizes a and b allow a link."""
    return F.lit(100) * F.least(a, b) >= F.lit(PERCENT) * F.greatest(a, b)


def _linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that link, by exact intersection."""
    left, right = (sets.select(F.col("node").alias(x), F.col("items").alias(f"{x}_items")) for x in "ab")
    both = F.size(F.array_intersect("a_items", "b_items"))
    total = F.size("a_items") + F.size("b_items")
    return pairs.join(left, "a").join(right, "b").where(_near(F.size("a_items"), F.size("b_items"))).where(100 * both >= PERCENT * (total - both)).select("a", "b")


def _node_components(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc, key, n_shingles, node) for each row of texts (doc, key, text), and
    (node, component) of the nodes that link with others."""
    spark = texts.sparkSession
    table = cut(_node_table(texts), "nodes")
    nodes = table.where("slot is null")
    counts = spark.sparkContext.broadcast(_shingle_counts(table))
    signed = cut(_signature_table(texts, counts), "signed")
    counts.destroy()
    hubs = _hubs(signed)
    discard(signed)
    facts = nodes.where("size(sketch) > 0").select("node", F.col("n_shingles").alias("m"), F.col("sketch").alias("s"))
    facts = cut(facts.join(hubs.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"]), "facts")
    first = hubs.where("node != hub").select(F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b")).distinct()

    def verified(pairs: DataFrame) -> DataFrame:
        wanted = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
        sets = _set_table(texts, nodes.where("n_shingles > 0").select("node", "key"), wanted)
        links = cut(_linked(pairs, sets), "links")
        discard(sets)
        return links

    near = cut(likely(first, facts, may_link, _near), "likely")
    links = verified(near)
    known = components(links)

    # groups that still hold several components: across them
    placed = cut(groups(hubs, known), "placed")
    met = cut(across(placed, facts, near_sizes, may_link).join(near, ["a", "b"], "left_anti"), "across")
    discard(hubs, facts, placed, near)
    more = verified(met)
    found = components(links.unionByName(more))
    discard(links, more, met, known)
    return nodes.select("doc", "key", "n_shingles", "node"), found


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, n_shingles, component_id for every row of ``docs``."""
    texts = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"), row_key(id_col, text_col).alias("key"))
    nodes, found = _node_components(texts)
    # a component's id is the least doc of its nodes; a node's, the least of its copies
    least = nodes.where("n_shingles > 0").groupBy("node").agg(F.min("doc").alias("least"))
    named = least.join(found, "node", "left").select("node", "least", F.coalesce("component", "node").alias("component"))
    named = named.join(named.groupBy("component").agg(F.min("least").alias("component_id")), "component").select("node", "component_id")
    some, none = nodes.where("n_shingles > 0").join(named, "node"), nodes.where("n_shingles = 0").withColumn("component_id", F.col("doc"))
    return some.unionByName(none).select(F.col("doc").alias(id_col), "n_shingles", "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component: that with the least doc_id (null last),
    of several with that doc_id the first by a hash of the text.  Rows without words
    stay, all of them."""
    keyed = docs.withColumn("_key", row_key("doc_id", "text"))
    nodes, found = _node_components(keyed.select(F.col("doc_id").alias("doc"), F.col("_key").alias("key"), "text"))
    rank = F.struct(F.col("doc").isNull().alias("none"), F.col("doc").alias("doc"), F.col("key").alias("key"))
    firsts = nodes.where("n_shingles > 0").groupBy("node").agg(F.min(rank).alias("first"))
    firsts = firsts.join(found, "node", "left").groupBy(F.coalesce("component", "node").alias("component")).agg(F.min("first").alias("first"))
    copies = nodes.groupBy("key").agg(F.count("*").alias("_copies"))
    kept = firsts.select(F.col("first.key").alias("key"), F.lit(True).alias("_one")).unionByName(nodes.where("n_shingles = 0").select("key", F.lit(False).alias("_one")).distinct())
    kept = cut(kept.join(copies, "key").withColumnRenamed("key", "_key"), "kept")
    once = keyed.join(kept.where("_copies = 1 or not _one"), "_key", "left_semi")
    # equal rows of one key: few, and combined in the map task
    several = keyed.join(kept.where("_copies > 1 and _one"), "_key", "left_semi").dropDuplicates(["_key"])
    return once.unionByName(several).select(*docs.columns)


def op4_ngram_join(spark, sf_dir: str) -> DataFrame:
    return join(documents(spark, sf_dir))


ORACLE = """
with recursive w as (
  select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from documents),
g as (
  select doc_id, list_distinct(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: hash(array_to_string(w[i:i + 4], ' ')))
                               when len(w) > 0 then [hash(array_to_string(w, ' '))] else []::ubigint[] end) as g from w),
sizes as (select doc_id, len(g) as n from g),
postings as (select doc_id, unnest(g) as s from g),
shared as (select a.doc_id as a, b.doc_id as b, count(*) as k from postings a join postings b on a.s = b.s and a.doc_id < b.doc_id group by all),
links as (
  select a, b from shared join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * k >= 75 * (x.n + y.n - k)),
both_ways as (select a, b from links union all select b, a from links),
reach(doc_id, c) as (
  select doc_id, doc_id from sizes
  union
  select b, c from reach join both_ways on a = doc_id where c < b)
select doc_id, cast(n as bigint) as n_shingles, cast(min(c) as bigint) as component_id from sizes join reach using (doc_id) group by all
"""
