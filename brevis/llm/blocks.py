"""Candidate pairs of nodes by parity sketches, settled inside blocks.

A node's sketch keeps a bit a bucket, the parity of its elements there; two nodes'
sketches, folded to one width, differ in no more bits than their elements differ.  So
``may(bits apart, size, size)`` can rule a pair out before it becomes a row.  Widths
are powers of two that follow sizes, so that of two nodes whose sizes may go together
(``near_sizes``) one sketch is as wide as the other or twice as wide."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U

#: Nodes of a block, about.
BLOCK = 1024
#: Groups of so many nodes are compared many at a time.
FEW = 48

Sizes = Callable[[np.ndarray, np.ndarray], np.ndarray]
May = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]
Same = Callable[[np.ndarray, np.ndarray], np.ndarray]


def parity_sketches(elements: np.ndarray, count: np.ndarray, width: np.ndarray) -> np.ndarray:
    """The sketches of rows with ``count`` elements (hashes) each, one after the other,
    ``width`` 64-bit words wide."""
    bits = width * 64
    first = np.repeat(np.cumsum(bits) - bits, count)
    cell = first + (elements & np.repeat(bits - 1, count).astype(U)).astype(np.int64)
    odd = (np.bincount(cell, minlength=int(bits.sum())) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(U)


def widths(count: np.ndarray, buckets: int, least: int = 1) -> np.ndarray:
    """The least power of two of words, ``least`` or more, with so many buckets an element."""
    width = np.full(len(count), least, np.int64)
    while (narrow := buckets * count > 64 * width).any():
        width[narrow] *= 2
    return width


def folded(s: np.ndarray, width: int) -> np.ndarray:
    """Sketches (the last axis) of half as many buckets, until ``width`` words are left."""
    while s.shape[-1] > width:
        half = s.shape[-1] // 2
        s = s[..., :half] ^ s[..., half:]
    return s


def likely(pairs: DataFrame, facts: DataFrame, may: May, near: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """The pairs (a, b) that may link, by the sketches of facts (node, m, s)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = []
            for c in ("a_s", "b_s"):
                width = batch.column(c).value_lengths().to_numpy().astype(np.int64)
                sides.append((batch.column(c).flatten().to_numpy().view(U), np.cumsum(width) - width, width))
            (x, x_at, x_width), (y, y_at, y_width) = sides
            apart = np.zeros(batch.num_rows, np.int64)
            for own, other in set(zip(x_width.tolist(), y_width.tolist())):
                rows, least = np.flatnonzero((x_width == own) & (y_width == other)), min(own, other)
                for part in np.array_split(rows, -(-len(rows) * max(own, other) // (1 << 18))):
                    u, v = (folded(s[at[part][:, None] + np.arange(n)], least) for s, at, n in ((x, x_at, own), (y, y_at, other)))
                    apart[part] = np.bitwise_count(u ^ v).sum(1, dtype=np.int64)
            kept = pa.array(np.flatnonzero(may(apart, batch.column("a_m").to_numpy(), batch.column("b_m").to_numpy())))
            yield pa.RecordBatch.from_arrays([batch.column(c).take(kept) for c in "ab"], names=["a", "b"])

    a, b = (facts.select(F.col("node").alias(x), F.col("m").alias(f"{x}_m"), F.col("s").alias(f"{x}_s")) for x in "ab")
    joined = pairs.join(a, "a").join(b, "b")
    if near is not None:
        joined = joined.where(near(F.col("a_m"), F.col("b_m")))
    return joined.select("a", "b", "a_m", "b_m", "a_s", "b_s").mapInArrow(run, "a long, b long")


def groups(hubs: DataFrame, known: DataFrame) -> DataFrame:
    """(hub, node, c) from hubs (node, hub) and known (node, component): nodes with the
    components of their hubs and their own; what is in none is one of its own."""
    of_hub = known.select(F.col("node").alias("hub"), F.col("component").alias("h"))
    placed = hubs.join(known, "node", "left").join(of_hub, "hub", "left")
    return placed.select(F.coalesce("h", "hub").alias("hub"), "node", F.coalesce("component", "node").alias("c")).distinct()


def spanning(u: np.ndarray, v: np.ndarray, apart: np.ndarray, c: np.ndarray, same: Same) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs (u, v) of rows of components ``c``, links that join all that same()
    joins, without cycles.  Each component's nearest pairs come first, twice as many a
    round; pairs that links have joined meanwhile are not looked at."""
    names, label = np.unique(c, return_inverse=True)
    order = np.lexsort((v, u, apart))
    u, v, most, links = u[order], v[order], 1, []

    def nth(x: np.ndarray) -> np.ndarray:
        order = np.argsort(x, kind="stable")
        first = np.flatnonzero(np.append(True, x[order][1:] != x[order][:-1]))
        out = np.empty(len(x), np.int64)
        out[order] = np.arange(len(x)) - np.repeat(first, np.diff(np.append(first, len(x))))
        return out

    root = list(range(len(names)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    while True:
        open_ = label[u] != label[v]
        u, v = u[open_], v[open_]
        if not len(u):
            break
        near = (nth(label[u]) < most) | (nth(label[v]) < most)
        a, b = u[near], v[near]
        for i in np.flatnonzero(same(a, b)).tolist():
            x, y = find(int(label[a[i]])), find(int(label[b[i]]))
            if x != y:
                root[max(x, y)] = min(x, y)
                links.append((a[i], b[i]))
        label = np.array([find(x) for x in range(len(names))])[label]
        u, v, most = u[~near], v[~near], 2 * most
    found = np.array(links, np.int64).reshape(-1, 2)
    return found[:, 0], found[:, 1]


def across(placed: DataFrame, facts: DataFrame, near_sizes: Sizes, may: May, same: Callable[[pa.Array, pa.Array], np.ndarray] | None = None) -> DataFrame:
    """Pairs (a, b) that may link, of nodes of one group and of different components,
    from rows (hub, node, c) and facts (node, m, s).

    A larger group is dealt in blocks; blocks of its largest component meet those of the others
    only, so that many alike nodes and a few others are not quadratic work.  With
    ``same``, which tells of two arrays of lines which ones link, facts has a column
    ``line`` too and the pairs are settled inside their block: only links are given,
    fewer than a block has components."""
    more = [] if same is None else ["line"]

    def pairs(c, m, s, width, block, i, j) -> tuple[np.ndarray, ...]:
        """Rows of pairs and the bits they differ in.  ``s``: the words of all sketches,
        ``width`` of them a node, one after the other."""
        first, found = np.cumsum(width) - width, []

        def table(rows: np.ndarray, own: int) -> np.ndarray:
            return s[first[rows][:, None] + np.arange(own)]

        for own in np.unique(width[block == i]):
            left = np.flatnonzero((block == i) & (width == own))
            for other in (own // 2, own, 2 * own):
                right = np.flatnonzero((block == j) & (width == other))
                if not other or not len(right):
                    continue
                least = int(min(own, other))
                x, y = folded(table(left, int(own)), least), folded(table(right, int(other)), least)
                step = max(1, (1 << 20) // (len(right) * least))
                for at in range(0, len(left), step):
                    some = left[at : at + step]
                    apart = np.bitwise_count(x[at : at + step, None] ^ y[None]).sum(2, dtype=np.int64)
                    ok = may(apart, m[some, None], m[None, right]) & (c[some, None] != c[None, right])
                    u, v = np.nonzero(ok)
                    found.append((some[u], right[v], apart[u, v]))
        return tuple(map(np.concatenate, zip(*found))) if found else (np.empty(0, np.int64),) * 3

    def small(rows: dict[str, np.ndarray], at: np.ndarray, starts: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
        """The same for many groups of a few rows at once."""
        row = np.repeat(starts - (np.cumsum(size) - size), size) + np.arange(size.sum())
        after = np.repeat(starts + size, size) - row - 1  # rows of the group that follow
        u = np.repeat(row, after)
        v = u + 1 + np.arange(len(u)) - np.repeat(np.cumsum(after) - after, after)
        c, m, width = rows["c"], rows["m"], rows["width"]
        ok = (c[u] != c[v]) & near_sizes(m[u], m[v])
        blocks = (rows["i"][u] == rows["j"][u]) | (rows["block"][u] != rows["block"][v])
        u, v = u[ok & blocks], v[ok & blocks]
        u, v = np.where(width[u] <= width[v], u, v), np.where(width[u] <= width[v], v, u)
        keep, differ = np.zeros(len(u), bool), np.zeros(len(u), np.int64)
        for own in np.unique(width[u]):
            for other in (own, 2 * own):
                pick = np.flatnonzero((width[u] == own) & (width[v] == other))
                for p in np.split(pick, range(1 << 15, len(pick), 1 << 15)):
                    x, y = (rows["s"][at[r[p]][:, None] + np.arange(n)] for r, n in ((u, own), (v, other)))
                    apart = np.bitwise_count(x ^ folded(y, int(own))).sum(1, dtype=np.int64)
                    keep[p], differ[p] = may(apart, m[u[p]], m[v[p]]), apart
        return u[keep], v[keep], differ[keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, held = ["hub", "i", "j", "node", "c", "m", "block", "width"], None

        def settle(rows: dict[str, np.ndarray], starts: np.ndarray) -> pa.RecordBatch:
            at = np.concatenate([[0], np.cumsum(rows["width"])])
            size = np.diff(starts)
            few = size <= FEW
            lines = rows.get("line")
            found = []
            for x, y in [(None, None), *zip(starts[:-1][~few].tolist(), starts[1:][~few].tolist())]:
                if x is None:
                    u, v, apart = small(rows, at, starts[:-1][few], size[few])
                else:
                    u, v, apart = pairs(*(rows[k][x:y] for k in ("c", "m")), rows["s"][at[x] : at[y]], *(rows[k][x:y] for k in ("width", "block")), rows["i"][x], rows["j"][x])
                    u, v = u + x, v + x
                if same is not None and len(u):
                    u, v = spanning(u, v, apart, rows["c"], lambda a, b: same(lines.take(pa.array(a)), lines.take(pa.array(b))))
                u, v = rows["node"][u], rows["node"][v]
                found.append((np.minimum(u, v), np.maximum(u, v)))
            a, b = map(np.concatenate, zip(*found))
            both = np.unique(np.stack([a, b], 1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

        for batch in batches:
            rows = {k: batch.column(k).to_numpy(zero_copy_only=False) for k in names}
            rows["s"] = batch.column("s").flatten().to_numpy(zero_copy_only=False).view(U)
            rows |= {k: batch.column(k).cast(pa.large_binary()) for k in more}
            if held is not None:
                rows = {k: pa.concat_arrays([held[k], v]) if k in more else np.concatenate([held[k], v]) for k, v in rows.items()}
            n = len(rows["hub"])
            if not n:
                continue
            new = np.ones(n, bool)
            new[1:] = np.any([rows[k][1:] != rows[k][:-1] for k in ("hub", "i", "j")], axis=0)
            starts = np.flatnonzero(new)
            yield settle(rows, starts)  # all groups but the last, which may go on
            rows["s"] = rows["s"][int(rows["width"][: starts[-1]].sum()) :]
            held = {k: v if k == "s" else v[starts[-1] :] for k, v in rows.items()}
        if held is not None and len(held["hub"]):
            yield settle(held, np.array([0, len(held["hub"])]))

    sizes = placed.groupBy("hub", "c").agg(F.count("*").alias("n"))
    sizes = sizes.groupBy("hub").agg(F.max(F.struct("n", "c")).alias("top"), F.sum("n").alias("all")).where("top.n < all")
    minor, major = F.col("all") - F.col("top.n"), F.col("top.n")
    # a group that fits into a block, and whose largest component is no large part of it or
    # spares little, is one block: each of its nodes is sent once
    whole = (F.col("all") <= FEW) | (F.col("all") <= BLOCK) & (4 * major <= F.col("all"))
    counts = [F.when(whole, one).otherwise(F.ceil(n / BLOCK)).cast("int").alias(x) for x, n, one in (("minor", minor, 1), ("major", major, 0))]
    sizes = sizes.select("hub", F.col("top.c").alias("top"), *counts)
    # the blocks of the largest component come after those of the others
    is_top = (F.col("c") == F.col("top")) & (F.col("major") > 0)
    own = F.pmod(F.xxhash64("node"), F.when(is_top, F.col("major")).otherwise(F.col("minor"))).cast("int")
    rows = placed.join(sizes, "hub").withColumn("block", own + F.when(is_top, F.col("minor")).otherwise(0)).join(facts, "node")
    others = F.when(is_top, F.col("minor")).otherwise(F.col("minor") + F.col("major"))
    # a block meets others in pairs of blocks, (least, greatest)
    rows = rows.withColumn("o", F.explode(F.sequence(F.lit(0), others - 1)))
    rows = rows.select("hub", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"), "node", "c", "m", "block", F.size("s").alias("width"), "s", *more)
    return rows.repartition("hub", "i", "j").sortWithinPartitions("hub", "i", "j").mapInArrow(run, "a long, b long").distinct()
