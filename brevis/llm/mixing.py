"""Mixing sources to target weights, with DataFrame operations only.

1. Targets.  A source's size is the words of its documents.  The sources, by
   code point with null last, weigh 3, 1, 2, 3, ...; they share 150 % of all
   words by weight, no source more than twice its size, the excess shared again
   by weight until none is above (water-filling: the sources in the order in
   which they would be capped, one running sum).
2. Blocks.  Each source's documents, shuffled by a hash, form one stream of
   words, repeated once more; equal blocks of ``block`` words cut it.
3. Schedule.  Slot i of the mix takes the golden-ratio point frac(i / phi); the
   cumulative target shares map it to a source, and the slot's rank among the
   source's slots is the block it takes.  Slots beyond a source's target are
   skipped, and the last few blocks that low discrepancy leaves owing follow.
4. Slots and block pieces of documents join on (source, block).  A document's
   place in the mix is the first slot that takes words of it, in its stream and
   again in the repetition; ``mixed_rows`` returns the rows dealt and sorted by
   these places, so that any stretch of its files holds the sources by weight.

A source's stream is summed in two levels, hash buckets and then documents
inside a bucket, and its slots in two levels too, so no task gathers a source.

Defined results: a null or blank text has size 0 and takes 0; null is a source;
repeated rows are rows of their own; an empty table gives an empty result;
other input columns are kept out.  Ties in the shuffle go by doc_id and size; rows
without a doc_id, or with one, are numbered together by size, so that many of them
are no more work than others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, documents, row_key

WEIGHTS = (3, 1, 2)
SHARE = 1.5
REPEATS = 2
#: One slot takes 1 to 4096 words: about 200,000 slots, more only beyond 800 M words.
SLOTS, MAX_BLOCK = 200_000, 4096
#: Documents are summed in buckets of about this many rows.
BUCKET_ROWS = 4096
RUN = 4096  # rows alike are told apart in runs of this many
PART = 16384  # slots are ranked in parts of this many
SEED = "mix:"
INVERSE_PHI = 0.6180339887498949


def word_count(text: Column | str) -> Column:
    """The number of [^\\x20\\x09-\\x0D]+ in a text; null has 0."""
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, share: float = SHARE, weights=WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """``src``, ``source_size``, ``target``, ``src_no`` of a table (src, source_size).

    One row a source: the single-partition windows here sort sources, never documents."""
    by_name, everything = Window.orderBy(F.col("src").asc_nulls_last()), Window.partitionBy()
    numbered = sizes.withColumn("src_no", F.row_number().over(by_name) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("src_no") % len(weights) + 1).cast("int"))
    by_cap = Window.orderBy((F.lit(float(repeats)) * F.col("source_size")) / F.col("weight"), "src_no")
    before, since = by_cap.rowsBetween(Window.unboundedPreceding, -1), by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (
        numbered.withColumn("weight", weight)
        .withColumn("cap", F.lit(float(repeats)) * F.col("source_size"))
        .withColumn("pool", F.lit(share) * F.sum("source_size").over(everything))
        # what a unit of weight gets if this source and the later ones are not capped
        .withColumn("unit", (F.col("pool") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(since))
        .withColumn("free", F.col("weight") * F.col("unit") < F.col("cap"))
    )
    unit = F.min(F.when(F.col("free"), F.struct((F.col("cap") / F.col("weight")).alias("at"), F.col("src_no"), F.col("unit")))).over(everything)["unit"]
    target = F.when(F.col("free"), F.col("weight") * F.col("level")).otherwise(F.col("cap"))
    return level.withColumn("level", unit).select("src", "source_size", target.alias("target"), "src_no")


def schedule(plan: DataFrame, slots: int) -> DataFrame:
    """The mix: ``src_no``, ``rank`` (the block of the source's stream), ``slot``.

    ``plan``: src_no, quota (blocks to take) and the share's ends ``lo`` and
    ``hi`` in [0, 1).  Points and shares meet in cells of [0, 1), so that the
    lookup is an equal join with few shares to a cell however many sources."""
    spark = plan.sparkSession
    cells = 1024
    while cells < 4 * plan.count():
        cells *= 2
    share = plan.select("src_no", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") * cells), F.least(F.floor(F.col("hi") * cells), F.lit(cells - 1)))).alias("cell"))
    point = (F.col("id") + 1) * F.lit(INVERSE_PHI)
    points = spark.range(slots).select(F.col("id").alias("slot"), (point - F.floor(point)).alias("u"), F.floor(F.col("id") / PART).alias("part"))
    placed = points.withColumn("cell", F.floor(F.col("u") * cells)).join(share, "cell").where("u >= lo and u < hi").select("src_no", "part", "slot")
    counted = placed.groupBy("src_no", "part").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("src_no").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counted.select("src_no", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    inside = Window.partitionBy("src_no", "part").orderBy("slot")
    ranked = placed.withColumn("in_part", F.row_number().over(inside) - 1).join(offsets, ["src_no", "part"]).select("src_no", "slot", (F.col("base") + F.col("in_part")).alias("rank"))
    taken = ranked.join(plan.select("src_no", "quota"), "src_no").where("rank < quota").select("src_no", "rank", "slot")
    # what is owed to a source when the points end: its last blocks, after all others
    got = counted.groupBy("src_no").agg(F.sum("n").alias("got"))
    owing = plan.join(got, "src_no", "left").withColumn("got", F.coalesce("got", F.lit(0))).where("got < quota")
    rest = owing.select("src_no", "got", F.explode(F.sequence("got", F.col("quota") - 1)).alias("rank")).select("src_no", "rank", (F.col("rank") - F.col("got") + slots).alias("slot"))
    return taken.unionByName(rest)


def mix(df: DataFrame, keep: list[str], id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """For each row of ``df``: ``keep`` columns, size, source_size, target, taken, and
    ``slots``: its first slot in its source's stream and in the repetition, null where
    none takes words of it."""
    # texts are read once: what follows needs their sizes only
    sized = cut(df.select(F.struct(*keep).alias("row"), F.col(id_col).cast("string").alias("key"), F.col(source_col).alias("src"), word_count(text_col).alias("size")), "sized")
    hashed = F.md5(F.concat(F.lit(SEED), F.coalesce("key", F.lit(""))))
    sizes = sized.groupBy("src").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    total = sizes.agg(F.sum("source_size").alias("words"), F.sum("rows").alias("rows")).first()
    words, rows = total["words"] or 0, total["rows"] or 0
    block = max(1, min(MAX_BLOCK, int(words * SHARE) // SLOTS))
    bits = 0
    while rows >> bits > BUCKET_ROWS and bits < 32:
        bits += 4

    targets = source_targets(sizes.select("src", "source_size"))
    by_number = Window.orderBy("src_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    everything = Window.partitionBy()
    upper = F.sum("target").over(by_number) / F.sum("target").over(everything)
    plan = cut(
        targets.withColumn("words", F.floor("target").cast("long"))
        .withColumn("quota", F.ceil(F.col("words") / block).cast("long"))
        .withColumn("hi", F.when(F.col("src_no") == F.max("src_no").over(everything), F.lit(1.0)).otherwise(upper))
        .withColumn("lo", F.coalesce(F.lag("hi").over(Window.orderBy("src_no")), F.lit(0.0))),
        "plan",
    )
    slots = schedule(plan.where("quota > 0"), plan.agg(F.sum("quota")).first()[0] or 0)

    # the stream of each source: totals of buckets first, then documents inside a bucket;
    # rows alike in all that orders them are one row with a number until they are placed
    alike = sized.groupBy("row", "key", "src", "size").agg(F.count("*").alias("n"))
    dealt = alike.withColumn("hash", hashed).withColumn("bucket", F.substring("hash", 1, bits // 4))
    buckets = dealt.groupBy("src", "bucket").agg(F.sum(F.col("size") * F.col("n")).alias("words"))
    earlier = Window.partitionBy("src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = buckets.select(F.col("src").alias("b_src"), F.col("bucket").alias("b_bucket"), F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("base"))
    inside = Window.partitionBy("src", "bucket").orderBy("hash", "key", "size", F.xxhash64("row")).rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        dealt.withColumn("within", F.coalesce(F.sum(F.col("size") * F.col("n")).over(inside), F.lit(0)))
        .join(bases, F.col("src").eqNullSafe(F.col("b_src")) & (F.col("bucket") == F.col("b_bucket")))
        .join(plan.select(F.col("src").alias("t_src"), "source_size", "target", "words", "src_no"), F.col("src").eqNullSafe(F.col("t_src")))
        .withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / RUN))))
        .withColumn("nth", F.explode(F.sequence(F.col("run") * RUN, F.least(F.col("n"), (F.col("run") + 1) * RUN) - 1)))
        .select("row", "size", "source_size", "target", "words", "src_no", "nth", (F.col("base") + F.col("within") + F.col("nth") * F.col("size")).alias("at"))
    )
    # block pieces of each document, in the stream and in its repetition, as far as the target goes
    def first(copy: int) -> Column:
        return F.col("at") + F.col("source_size") * copy

    pieces = F.filter(F.array(*[F.struct(F.lit(c).alias("copy"), first(c).alias("a"), F.least(first(c) + F.col("size"), F.col("words")).alias("z")) for c in range(REPEATS)]), lambda p: p["a"] < p["z"])
    parts = (
        placed.withColumn("piece", F.explode_outer(pieces))
        .withColumn("rank", F.explode_outer(F.when(F.col("piece").isNotNull(), F.sequence(F.floor(F.col("piece.a") / block), F.floor((F.col("piece.z") - 1) / block)))))
        .withColumn("overlap", F.least("piece.z", (F.col("rank") + 1) * block) - F.greatest("piece.a", F.col("rank") * block))
    )
    joined = parts.join(slots, ["src_no", "rank"], "left")
    slot = [F.min(F.when(F.col("piece.copy") == c, F.col("slot"))).alias(f"slot_{c}") for c in range(REPEATS)]
    return (
        joined.groupBy("src_no", "at", "nth", "size", "row", "source_size", "target")
        .agg(F.coalesce(F.sum(F.when(F.col("slot").isNotNull(), F.col("overlap"))), F.lit(0)).cast("long").alias("taken"), *slot)
        .select("row.*", "size", "source_size", "target", "taken", F.array(*[f"slot_{c}" for c in range(REPEATS)]).alias("slots"))
    )


def mixed_rows(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` in the order of the mix, each as often as the mix takes its
    words, rounded to whole documents (a half counts up); rows without words don't
    take part, and rows with one doc_id and text are taken equally often, as the most
    taken.

    The mix works on sizes; its decisions and slots then meet the rows, which go to
    their place by a range of slots."""
    keyed = docs.withColumn("_key", row_key("doc_id", "text"))
    taken = mix(keyed, ["_key"]).where("size > 0")
    times = F.floor((2 * F.col("taken") + F.col("size")) / (2 * F.col("size")))
    decided = taken.groupBy("_key").agg(F.max(times).alias("_times"), *[F.min(F.col("slots")[c]).alias(f"_slot_{c}") for c in range(REPEATS)]).where("_times > 0")
    # a document that is rounded up to a time more takes its last slot again
    place = F.coalesce(*[F.when(F.col("_time") >= c, F.col(f"_slot_{c}")) for c in reversed(range(REPEATS))], *[f"_slot_{c}" for c in range(REPEATS)])
    found = keyed.join(decided, "_key").withColumn("_time", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_times") - 1)))
    return found.withColumn("_place", place).repartitionByRange("_place", "_key").sortWithinPartitions("_place", "_key").select(*docs.columns)


def op9_source_mix(spark, sf_dir: str) -> DataFrame:
    mixed = mix(documents(spark, sf_dir), ["doc_id"])
    return mixed.select("doc_id", "size", "source_size", "target", "taken", F.array_min("slots").alias("first_slot"))


ORACLE = """
with sized as (
  select doc_id, source,
         cast(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) as bigint) as size
  from documents),
sizes as (select source, cast(sum(size) as bigint) as source_size from sized group by source),
numbered as (
  select *, row_number() over (order by encode(source) asc nulls last) - 1 as src_no from sizes),
weighed as (
  select *, [3.0::double, 1.0::double, 2.0::double][(src_no % 3 + 1)::int] as weight, 2.0::double * source_size as cap,
         1.5::double * sum(source_size) over () as pool from numbered),
leveled as (
  select *, (pool - coalesce(sum(cap) over (w rows between unbounded preceding and 1 preceding), 0))
            / sum(weight) over (w rows between current row and unbounded following) as unit
  from weighed window w as (order by cap / weight, src_no)),
freed as (select *, weight * unit < cap as free from leveled),
targets as (
  select source, source_size, src_no,
         case when free then weight * (select unit from freed where free order by cap / weight, src_no limit 1) else cap end as target
  from freed),
placed as (
  select row_number() over () as rid, doc_id, src_no, size, source_size, target, floor(target)::bigint as goal,
         coalesce(sum(size) over (partition by src_no order by md5('mix:' || coalesce(doc_id::varchar, '')), doc_id::varchar, size
                                  rows between unbounded preceding and 1 preceding), 0)::bigint as pos
  from sized join targets on sized.source is not distinct from targets.source),
blocks as (select greatest(1, least(4096, floor(sum(source_size) * 1.5)::bigint // 200000)) as block from sizes),
shares as (
  select src_no, ceil(floor(target)::bigint / block)::bigint as quota,
         case when src_no = max(src_no) over () then 1.0::double else sum(target) over (order by src_no) / sum(target) over () end as hi
  from targets, blocks),
ends as (select src_no, quota, hi, coalesce(lag(hi) over (order by src_no), 0.0) as lo from shares),
points as (
  select i as slot, (i + 1) * 0.6180339887498949::double - floor((i + 1) * 0.6180339887498949::double) as u
  from (select unnest(range((select sum(quota)::bigint from ends))) as i)),
ranked as (
  select src_no, quota, slot, row_number() over (partition by src_no order by slot) - 1 as rank
  from points join ends on u >= lo and u < hi and quota > 0),
owing as (
  select src_no, quota, (select count(*) from ranked r where r.src_no = e.src_no) as got from ends e),
slots as (
  select src_no, rank, slot from ranked where rank < quota
  union all
  select src_no, rank, rank - got + (select sum(quota)::bigint from ends) as slot
  from (select src_no, got, unnest(range(got, quota)) as rank from owing where got < quota)),
pieces as (
  select rid, src_no, pos + c * source_size as a, least(pos + c * source_size + size, goal) as z
  from placed, (select unnest([0, 1]) as c)),
taking as (
  select rid, min(slot)::bigint as first_slot
  from (select rid, src_no, unnest(range(a // block, (z - 1) // block + 1)) as rank from pieces, blocks where a < z)
  join slots using (src_no, rank) group by rid)
select doc_id, size, source_size, target,
       (greatest(0, least(pos + size, goal) - pos)
        + greatest(0, least(pos + source_size + size, goal) - (pos + source_size)))::bigint as taken, first_slot
from placed left join taking using (rid)
"""
