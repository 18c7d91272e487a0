"""Sharding: size-tiered compaction under a versioned manifest.

A store is a folder with immutable Parquet shards and one manifest a version.
``append`` writes an arrival as small shards; ``compact`` merges runs of shards
of similar size, sorted by size and packed up to the target, until no tier (a
power of ``fanout``) holds ``fanout`` small shards; each change is committed as
the next manifest.  A manifest is written aside and renamed without overwriting,
so a version appears whole or not at all, and of two writers one wins; the other
takes the new version up, or drops its merge if an input of it is gone.  Readers
see one version.  Shards that no version names any more go with ``vacuum``.

A merge reads a group's shards in one task and writes one shard: nothing is
shuffled, a task's data is bounded by the target size, and keys have no say, so
no source or group of copies can be hot.  Shards are made by Spark's committer:
a lost executor costs the tasks it ran.  Only names and sizes of shards come to
the driver.

Defined results: all rows and columns of each arrival are kept, repeated rows and
nulls included; an arrival without rows adds a version without shards; a store
without shards reads as an empty table; a row larger than the target is in a
shard of its own size.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import documents, drop_path, hadoop_path, shared_dir

TARGET_BYTES = 64 << 20
FANOUT = 4
MIN_BYTES = 1 << 16  # the lowest tier ends here
#: A manifest of so many shards (about 10 MB of names) is sent to every task that reads.
BROADCAST_SHARDS = 100_000
#: Shares of the table that the query lets arrive one after the other, in eighths.
ARRIVALS = ((0, 1, 2, 3), (4, 5), (6, 7))


@dataclass(frozen=True)
class Shard:
    path: str  # below the store's folder
    rows: int
    size: int  # bytes


@dataclass(frozen=True)
class Manifest:
    version: int
    schema: str  # JSON
    shards: tuple[Shard, ...]


class Conflict(Exception):
    """Another writer committed the version first."""


class ShardStore:
    def __init__(self, spark: SparkSession, root: str, target_bytes: int = TARGET_BYTES, fanout: int = FANOUT):
        self.spark, self.root, self.target, self.fanout = spark, root.rstrip("/"), target_bytes, fanout

    # ------------------------------------------------------------ manifests
    def manifest(self, version: int | None = None) -> Manifest:
        """The newest manifest, or that of a version; version 0 is the empty store."""
        if version is None:
            fs, p = hadoop_path(self.spark, f"{self.root}/manifests")
            names = [x.getPath().getName() for x in fs.listStatus(p)] if fs.exists(p) else []
            version = max((int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json")), default=0)
        if not version:
            return Manifest(0, StructType().json(), ())
        fs, p = hadoop_path(self.spark, self._manifest_path(version))
        stream = fs.open(p)
        try:
            body = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        return Manifest(body["version"], body["schema"], tuple(Shard(**s) for s in body["shards"]))

    def _manifest_path(self, version: int) -> str:
        return f"{self.root}/manifests/v{version:012d}.json"

    def commit(self, manifest: Manifest) -> Manifest:
        """Publish ``manifest`` as its version; Conflict if that exists."""
        jvm = self.spark._jvm
        fs, aside = hadoop_path(self.spark, f"{self.root}/manifests/.{uuid.uuid4().hex}")
        out = fs.create(aside, False)
        try:
            out.write(bytearray(json.dumps(asdict(manifest)).encode()))
        finally:
            out.close()
        _, final = hadoop_path(self.spark, self._manifest_path(manifest.version))
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(fs.makeQualified(aside), fs.makeQualified(final), options)  # fails if ``final`` exists
        except Exception as e:
            fs.delete(aside, False)
            if fs.exists(final):
                raise Conflict(manifest.version) from e
            raise
        return manifest

    def _change(self, added: tuple[Shard, ...], removed: frozenset[str], schema: str) -> Manifest | None:
        """Commit a change on top of the newest version; None if an input is gone."""
        while True:
            now = self.manifest()
            if not removed <= {s.path for s in now.shards}:
                return None
            if now.version and now.schema != schema:
                raise ValueError("an arrival's columns differ from the store's")
            try:
                return self.commit(Manifest(now.version + 1, schema, tuple(s for s in now.shards if s.path not in removed) + added))
            except Conflict:
                continue

    # --------------------------------------------------------------- shards
    def _written(self, df: DataFrame) -> tuple[Shard, ...]:
        """Write ``df``, a shard a task, and list the shards that have rows."""
        folder = f"data/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{folder}")
        fs, p = hadoop_path(self.spark, f"{self.root}/{folder}")
        sizes = {x.getPath().getName(): x.getLen() for x in fs.listStatus(p) if x.getPath().getName().startswith("part-")}
        if not sizes:
            return ()
        counted = self.spark.read.schema(df.schema).parquet(f"{self.root}/{folder}").groupBy(F.col("_metadata.file_name").alias("name")).agg(F.count("*").alias("n")).collect()
        return tuple(Shard(f"{folder}/{r['name']}", r["n"], sizes[r["name"]]) for r in sorted(counted, key=lambda r: r["name"]))

    def _frame(self, shards: tuple[Shard, ...], schema: StructType) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{s.path}" for s in shards])

    def append(self, df: DataFrame) -> Manifest:
        return self._change(self._written(df), frozenset(), df.schema.json())

    def read(self, version: int | None = None) -> DataFrame:
        m = self.manifest(version)
        schema = StructType.fromJson(json.loads(m.schema))
        return self._frame(m.shards, schema) if m.shards else self.spark.createDataFrame([], schema)

    # ----------------------------------------------------------- compaction
    def tier(self, size: int) -> int:
        tier = 0
        while size > MIN_BYTES * self.fanout**tier:
            tier += 1
        return tier

    def plan(self, shards: tuple[Shard, ...]) -> list[tuple[Shard, ...]]:
        """Groups to merge: in each tier with enough small shards, in order of
        size, packed up to the target."""
        tiers: dict[int, list[Shard]] = {}
        for s in sorted(shards, key=lambda s: (s.size, s.path)):
            if 2 * s.size <= self.target:
                tiers.setdefault(self.tier(s.size), []).append(s)
        groups = []
        for run in tiers.values():
            if len(run) < self.fanout:
                continue
            group, size = [], 0
            for s in run:
                if group and size + s.size > self.target:
                    groups.append(tuple(group))
                    group, size = [], 0
                group.append(s)
                size += s.size
            groups.append(tuple(group))
        return [g for g in groups if len(g) > 1]

    def compact(self) -> Manifest:
        """Merge until the plan is empty; each wave of merges is one version."""
        wave = max(32, 2 * self.spark.sparkContext.defaultParallelism)
        while True:
            now = self.manifest()
            groups = self.plan(now.shards)
            if not groups:
                return now
            schema = StructType.fromJson(json.loads(now.schema))
            for at in range(0, len(groups), wave):
                part = groups[at : at + wave]
                merged = reduce(DataFrame.union, [self._frame(g, schema).coalesce(1) for g in part])
                self._change(self._written(merged), frozenset(s.path for g in part for s in g), now.schema)

    def vacuum(self) -> None:
        """Delete shards that the newest version doesn't name, and older manifests.
        For when no reader is on an older version and no writer is at work."""
        now = self.manifest()
        live = {s.path for s in now.shards}
        fs, p = hadoop_path(self.spark, f"{self.root}/data")
        for folder in fs.listStatus(p) if fs.exists(p) else []:
            name = folder.getPath().getName()
            inside = [x.getPath().getName() for x in fs.listStatus(folder.getPath())]
            if not any(f"data/{name}/{x}" in live for x in inside):
                fs.delete(folder.getPath(), True)
                continue
            for x in inside:
                if x.startswith("part-") and f"data/{name}/{x}" not in live:
                    drop_path(self.spark, f"{self.root}/data/{name}/{x}")
        for version in range(1, now.version):
            drop_path(self.spark, self._manifest_path(version))

    def placed(self) -> DataFrame:
        """The rows of the newest version with ``shard``, its ``shard_rows`` and
        ``shard_bytes``, and ``version``."""
        m = self.manifest()
        schema = StructType.fromJson(json.loads(m.schema))
        facts = self.spark.createDataFrame([(s.path.rsplit("/", 1)[1], f"{i:08d}", s.rows, s.size) for i, s in enumerate(m.shards)], "_name string, shard string, shard_rows long, shard_bytes long")
        rows = self._frame(m.shards, schema).withColumn("_name", F.col("_metadata.file_name")) if m.shards else self.spark.createDataFrame([], schema).withColumn("_name", F.lit(""))
        if len(m.shards) <= BROADCAST_SHARDS:
            facts = F.broadcast(facts)
        return rows.join(facts, "_name").drop("_name").withColumn("version", F.lit(m.version).cast("long"))


def sharded(docs: DataFrame, id_col: str = "doc_id", target_bytes: int = TARGET_BYTES) -> ShardStore:
    """A store to which ``docs`` came in several arrivals, compacted after each."""
    store = ShardStore(docs.sparkSession, f"{shared_dir(docs.sparkSession)}/shards", target_bytes)
    eighth = F.pmod(F.xxhash64(F.col(id_col)), F.lit(8))
    for share in ARRIVALS:
        store.append(docs.where(eighth.isin(*share)))
        store.compact()
        store.vacuum()
    return store


def shard_stage(docs: DataFrame) -> DataFrame:
    """doc_id, source, lang, shard, shard_rows, shard_bytes, version of each row of the compacted store."""
    placed = sharded(docs).placed()
    return placed.select("doc_id", "source", "lang", "text", "shard", "shard_rows", "shard_bytes", "version")


def op2_sharding(spark, sf_dir: str) -> DataFrame:
    """Every document with its shard, and the hash of its text as read back."""
    placed = sharded(documents(spark, sf_dir)).placed()
    return placed.select("doc_id", F.md5("text").alias("text_md5"), "shard", "shard_rows", "shard_bytes", "version")
