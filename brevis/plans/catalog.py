"""The library's queries by name, and their SQL twins.

Where an operator needs a summary, a document's first three sentences (of ten or
more code points) are its summary and the rest its text; hypotheses are
assistant turns, their references the turns before."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brevis.functions import text as T
from brevis.functions.types import DOUBLES
from brevis.operators import corpus, html, ml, prune, rouge, segment, similarity
from brevis.plans import presets

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

PACK, PARAGRAPH, SPLIT = 478, 200, 492


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, summary, sents."""
    return corpus.lead_pairs(docs(spark, sf_dir)).select("doc_id", "summary", "sents")


# --------------------------------------------------------------- SQL fragments
def sql_sentences(x: str, least: int) -> str:
    return f"list_filter(string_split(regexp_replace({x}, '([.!?])\\s+', '\\1' || chr(30), 'g'), chr(30)), lambda s: length(s) >= {least})"


def sql_words(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '\\s+'), lambda t: t <> '')"


def sql_rouge(x: str) -> str:
    return f"list_filter(string_split(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'), ' '), lambda t: t <> '')"


def sql_pack(lengths: str, budget: int) -> str:
    """Places (from 0) where groups of a greedy packing begin."""
    state = "{{'n': {n}, 'i': {i}, 'st': {at}}}"
    first = state.format(n="0::bigint", i="0::bigint", at="[]::bigint[]")
    item = state.format(n="l::bigint", i="0::bigint", at="[]::bigint[]")
    close = f"(a.n > 0 and a.n + b.n > {budget})"
    step = state.format(n=f"case when {close} then b.n else a.n + b.n end", i="a.i + 1", at=f"case when {close} or a.i = 0 then list_append(a.st, a.i) else a.st end")
    return f"list_reduce(list_prepend({first}, list_transform({lengths}, lambda l: {item})), lambda a, b: {step}).st"


def sql_groups(items: str, at: str) -> str:
    """Groups of items from the places where they begin."""
    return f"list_transform({at}, lambda b, j: {items}[b + 1:coalesce({at}[j + 1], len({items}))])"


SQL_PAIRS = f"""
  select doc_id, s[1:3] as summary, s[4:] as sents
  from (select doc_id, {sql_sentences('text', 10)} as s from documents)
"""
SQL_SCORED = f"""
  select doc_id, sent_ord, sentence, round(coalesce(2.0 * len(list_intersect(x, y)) / nullif(len(x) + len(y), 0), 0.0), 6) as score
  from (select doc_id, sent_ord, sentence, list_distinct({sql_rouge('sentence')}) as x, list_distinct({sql_rouge("array_to_string(summary, ' ')")}) as y
        from (select doc_id, summary, unnest(sents) as sentence, generate_subscripts(sents, 1) - 1 as sent_ord from ({SQL_PAIRS}))
        where length(sentence) >= 50)
"""


# ------------------------------------------------------- statistics and filters
@query("""
select count(text) as text_n, round(avg(length(text)), 4) as text_mean, round(stddev_pop(length(text)), 4) as text_std,
       count(source) as source_n, round(avg(length(source)), 4) as source_mean, round(stddev_pop(length(source)), 4) as source_std
from documents
""")
def doc_length_stats(spark, sf_dir):
    return corpus.length_stats(table(spark, sf_dir, "documents"), "text", "source")


@query("""
with v as (select length(text)::double as v from documents), e as (select min(v) as lo, max(v) as hi from v)
select (case when hi = lo then 1 else least(floor((v - lo) * 100 / (hi - lo)) + 1, 100) end)::int as bin, count(*) as n from v, e group by 1
""")
def doc_length_hist100(spark, sf_dir):
    return corpus.histogram(docs(spark, sf_dir), F.length("text"), 100)


@query(f"""
select doc_id, length(lead) as n_summary, length(text) as n_text
from (select doc_id, text, array_to_string({sql_sentences('text', 10)}[1:3], ' ') as lead from documents)
where length(lead) >= 200 and length(text) >= 3000
""")
def qualify_docs(spark, sf_dir):
    lead = F.array_join(F.slice(T.sentences(F.col("text"), 10), 1, 3), " ")
    return corpus.qualify(docs(spark, sf_dir).withColumn("lead", lead), "lead", "text", 200, 3000).select("doc_id", F.length("lead").alias("n_summary"), F.length("text").alias("n_text"))


@query(f"""
select doc_id, len(w) as n_words from (select doc_id, {sql_words('text')} as w, {sql_words(f"array_to_string({sql_sentences('text', 10)}[1:3], ' ')")} as l from documents)
where len(w) >= 150 and len(l) >= 10
""")
def min_word_docs(spark, sf_dir):
    lead = F.array_join(F.slice(T.sentences(F.col("text"), 10), 1, 3), " ")
    return corpus.least_words(docs(spark, sf_dir).withColumn("lead", lead), {"text": 150, "lead": 10}).select("doc_id", T.ws_length(F.col("text")).alias("n_words"))


@query(f"select doc_id, len(sents) as n_sents from ({SQL_PAIRS}) where trim(array_to_string(summary, ' ')) <> '' and len(sents) > 0")
def nonempty_docs(spark, sf_dir):
    p = pairs(spark, sf_dir).withColumn("lead", F.array_join("summary", " "))
    return corpus.non_empty(p, "lead").where("size(sents) > 0").select("doc_id", F.size("sents").alias("n_sents"))


@query(f"select doc_id, list_filter({sql_sentences('text', 1)}, lambda s: length(s) >= 50) as long_sents from documents")
def min_char_sentences(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.filter(T.sentences(F.col("text")), lambda s: F.length(s) >= 50).alias("long_sents"))


@query("""
with r as (select doc_id, row_number() over (order by md5('123:' || doc_id)) - 1 as r, count(*) over () as n from documents)
select doc_id, case when r < floor(0.7 * n) then 'train' when r < floor(0.7 * n) + floor(0.1 * n) then 'val' else 'test' end as split from r
""")
def split_70_10_20(spark, sf_dir):
    return corpus.split(docs(spark, sf_dir).select("doc_id"), "doc_id")


@query("""
with r as (select doc_id, row_number() over (order by md5('123:' || doc_id)) - 1 as r, count(*) over () as n from documents)
select doc_id from r where r < floor(n * 0.25)
""")
def sample_fraction(spark, sf_dir):
    return corpus.sample(docs(spark, sf_dir).select("doc_id"), "doc_id", 0.25)


@query("with r as (select doc_id, row_number() over (order by doc_id) - 1 as r, count(*) over () as n from documents) select doc_id from r where r < n // 50")
def debug_head(spark, sf_dir):
    return corpus.head(docs(spark, sf_dir).select("doc_id"), "doc_id", 50)


@query("""
with r as (select doc_id, lang, row_number() over (order by md5('123:' || doc_id)) - 1 as r, count(*) over () as n from documents),
s as (select lang, case when r < floor(0.7 * n) then 'train' when r < floor(0.7 * n) + floor(0.1 * n) then 'val' else 'test' end as split from r),
l as (select r.lang, split from labels join r using (doc_id) join (select doc_id, case when r < floor(0.7 * n) then 'train' when r < floor(0.7 * n) + floor(0.1 * n) then 'val' else 'test' end as split from r) using (doc_id))
select coalesce(a.split, b.split) as split, coalesce(n_a, 0) as n_a, coalesce(n_b, 0) as n_b, coalesce(n_a, 0) = coalesce(n_b, 0) as aligned
from (select split, count(*) as n_a from s group by split) a full join (select split, count(*) as n_b from l group by split) b on a.split = b.split
""")
def split_alignment(spark, sf_dir):
    placed = corpus.split(docs(spark, sf_dir).select("doc_id"), "doc_id")
    return corpus.aligned(placed, placed.join(table(spark, sf_dir, "labels"), "doc_id"), "split")


# ------------------------------------------------------------------ text shapes
@query(f"select doc_id, [array_to_string({sql_words('text')}, ' ')] as text from documents")
def shape_combined(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", corpus.combined(F.col("text")).alias("text"))


@query(f"""
select doc_id, flatten(list_transform(string_split(text, chr(10)), lambda x:
  case when length(trim(regexp_replace(x, '^\\(\\d+\\)\\s+', ''))) >= 200 then {sql_sentences("trim(regexp_replace(x, '^\\(\\d+\\)\\s+', ''))", 5)}
       when length(trim(regexp_replace(x, '^\\(\\d+\\)\\s+', ''))) >= 11 then [trim(regexp_replace(x, '^\\(\\d+\\)\\s+', ''))] else []::varchar[] end)) as sents
from documents
""")
def shape_sentences(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", corpus.line_sentences(F.col("text")).alias("sents"))


SQL_CHAPTERS = """
  select doc_id, list_transform(string_split_regex(text, '\\n\\s*\\n'), lambda c: list_transform(string_split(c, chr(10)), lambda x:
    regexp_replace(replace(trim(x), '***', ''), '^\\(\\d+\\)\\s+', ''))) as chapters from documents
"""


@query(SQL_CHAPTERS)
def shape_chapters(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", corpus.chapters(F.col("text")).alias("chapters"))


@query("select doc_id, list_transform(string_split(text, '.'), lambda x: x || '.') as text from documents")
def quick_fix(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", corpus.quick_fix(F.array("text")).alias("text"))


@query(f"""
select doc_id, chap_ord, generate_subscripts(lines, 1) - 1 as sent_ord, unnest(lines) as sentence
from (select doc_id, generate_subscripts(chapters, 1) - 1 as chap_ord, unnest(chapters) as lines from ({SQL_CHAPTERS.replace('\\n\\s*\\n', '\\n')}))
""")
def flatten_structured(spark, sf_dir):
    shaped = docs(spark, sf_dir).withColumn("chapters", corpus.chapters(F.col("text"), r"\n"))
    return corpus.flatten_chapters(shaped, ["doc_id"], "chapters")


@query("select doc_id, case when doc_id % 3 = 0 then 'list' when doc_id % 3 = 1 then 'chapters' else 'other' end as kind from documents")
def structure_check(spark, sf_dir):
    one = F.to_json(F.struct(F.col("text").alias("KAPITTEL_0")))
    body = F.when(F.col("doc_id") % 3 == 0, F.to_json(F.array("text"))).when(F.col("doc_id") % 3 == 1, one).otherwise(F.lit('"text"'))
    return docs(spark, sf_dir).select("doc_id", corpus.text_kind(body).alias("kind"))


@query(f"""
select doc_id, generate_subscripts(c, 1) - 1 as chunk_ord, unnest(list_transform(c, lambda x: len(x))) as n_words, unnest(list_transform(c, lambda x: len(list_distinct(x)))) as n_distinct
from (select doc_id, list_transform(range(0, (len(w) + 511) // 512), lambda i: w[i * 512 + 1:i * 512 + 512]) as c from (select doc_id, {sql_words('text')} as w from documents))
""")
def word_chunks(spark, sf_dir):
    chunks = docs(spark, sf_dir).select("doc_id", F.posexplode(T.word_chunks(F.col("text"))).alias("chunk_ord", "c"))
    return chunks.select("doc_id", "chunk_ord", F.size("c").alias("n_words"), F.size(F.array_distinct("c")).alias("n_distinct"))


# ---------------------------------------------------------------- segmentation
SQL_SENTS = f"select doc_id, {sql_sentences('text', 5)} as sents from documents"
SQL_PACKED = f"""
  select doc_id, {sql_groups('c', 'st')} as g
  from (select doc_id, c, {sql_pack("list_transform(c, lambda s: len(string_split(s, ' ')))", PACK)} as st
        from (select doc_id, list_transform(sents, lambda s: replace(replace(replace(s, chr(10), ' '), chr(13), ''), '@@ ', '')) as c from ({SQL_SENTS})))
"""


def _packed(spark, sf_dir):
    sents = docs(spark, sf_dir).withColumn("sents", T.sentences(F.col("text"), 5))
    return segment.pack_sentences(sents, "sents", PACK)


@query(f"select doc_id, generate_subscripts(g, 1) - 1 as seg_ord, unnest(list_transform(g, lambda x: trim(array_to_string(x, ' ')))) as source from ({SQL_PACKED})")
def pack_sentences(spark, sf_dir):
    return segment.explode_segments(_packed(spark, sf_dir), ["doc_id"])


@query(f"select doc_id, len(g)::bigint as n_segments from ({SQL_PACKED})")
def pack_sentences_counts(spark, sf_dir):
    return _packed(spark, sf_dir).select("doc_id", F.size("segments").cast("long").alias("n_segments"))


@query(f"""
with p as ({SQL_PAIRS}), q as (select doc_id, summary, sents as c, {sql_pack("list_transform(sents, lambda s: len(string_split(replace(s, chr(10), ' '), ' ')))", PACK)} as st from p)
select doc_id, generate_subscripts(st, 1) - 1 as seg_ord, unnest(list_transform(st, lambda x: array_to_string(summary, ' '))) as target_full from q
""")
def dup_target(spark, sf_dir):
    packed = segment.pack_sentences(pairs(spark, sf_dir), "sents", PACK)
    rows = segment.explode_segments(packed.withColumn("target_full", F.array_join("summary", " ")), ["doc_id", "target_full"])
    return rows.select("doc_id", "seg_ord", "target_full")


SQL_PARAGRAPHS = f"""
  select doc_id, list_filter(list_transform({sql_groups('p', 'st')}, lambda g: trim(array_to_string(g, ' '))), lambda s: s <> '') as segments
  from (select doc_id, p, {sql_pack(f"list_transform(p, lambda s: len({sql_words('s')}))", PARAGRAPH)} as st from (select doc_id, string_split(text, chr(10)) as p from documents))
"""


@query(f"select doc_id, generate_subscripts(segments, 1) - 1 as seg_ord, unnest(segments) as source from ({SQL_PARAGRAPHS})")
def pack_paragraphs(spark, sf_dir):
    lines = docs(spark, sf_dir).withColumn("lines", F.split("text", "\n"))
    return segment.explode_segments(segment.pack_paragraphs(lines, "lines", PARAGRAPH), ["doc_id"])


@query(f"""
with sub as (select doc_id, generate_subscripts(l, 1) - 1 as c, unnest(l) as s from (select doc_id, string_split(text, chr(10)) as l from documents)),
one as (select doc_id, c, s, {sql_sentences('s', 1)} as p from sub),
level1 as (select doc_id, c, list_transform({sql_groups('p', 'st')}, lambda g: array_to_string(g, ' ')) as p
           from (select doc_id, c, p, {sql_pack(f"list_transform(p, lambda s: len({sql_words('s')}))", 60)} as st from one)),
-- a chapter is four lines, each a sub-chapter
chapter as (select doc_id, c // 4 as ch, flatten(list(p order by c)) as p from level1 group by all),
level2 as (select doc_id, ch, list_transform({sql_groups('p', 'st')}, lambda g: trim(array_to_string(g, ' '))) as segs
           from (select doc_id, ch, p, {sql_pack(f"list_transform(p, lambda s: len({sql_words('s')}))", 60)} as st from chapter)),
whole as (select doc_id, list_filter(flatten(list(segs order by ch)), lambda s: s <> '') as segments from level2 group by doc_id)
select doc_id, generate_subscripts(segments, 1) - 1 as seg_ord, unnest(segments) as source from whole
""")
def pack_chapters(spark, sf_dir):
    subs = F.transform(F.split("text", "\n"), lambda line: T.sentences(line))
    starts = F.sequence(F.lit(0), F.floor((F.size("subs") - 1) / 4).cast("int"))
    shaped = docs(spark, sf_dir).withColumn("subs", subs).withColumn("chapters", F.transform(starts, lambda i: F.slice(F.col("subs"), i * 4 + 1, 4)))
    return segment.explode_segments(segment.pack_chapters(shaped, "chapters", 60), ["doc_id"])


def sql_sims(table: str) -> str:
    """Common tables that end in sims (doc_id, o, f): ROUGE-1 F of each sentence of
    ``table`` (doc_id, sents) and the next."""
    return f"""
  sent as (select doc_id, generate_subscripts(sents, 1) - 1 as o, unnest(sents) as s from ({table})),
  tok as (select doc_id, o, len(t) as n, unnest(t) as t from (select doc_id, o, {sql_rouge('s')} as t from sent)),
  cnt as (select doc_id, o, n, t, count(*) as k from tok group by all),
  hit as (select a.doc_id, a.o, any_value(a.n) as n, any_value(b.n) as m, sum(least(a.k, b.k)) as k from cnt a join cnt b on a.doc_id = b.doc_id and b.o = a.o + 1 and a.t = b.t group by all),
  sims as (select s.doc_id, s.o, round(coalesce(2.0 * k / (n + m), 0.0), 6) as f
           from (select doc_id, o, lead(o) over (partition by doc_id order by o) as nxt from sent) s left join hit using (doc_id, o) where nxt is not null)
"""


SQL_SIMS = sql_sims(SQL_SENTS)


@F.pandas_udf(DOUBLES)
def _adjacent(column: pd.Series) -> pd.Series:
    return pd.Series([segment.adjacent_rouge1_f(list(x)) if x is not None else [] for x in column])


@query(f"with {SQL_SIMS} select doc_id, o::int as sent_ord, f from sims")
def adjacent_rouge1(spark, sf_dir):
    sents = docs(spark, sf_dir).select("doc_id", T.sentences(F.col("text"), 5).alias("sents"))
    return sents.select("doc_id", F.posexplode(_adjacent("sents")).alias("sent_ord", "f"))


def sql_spans(table: str, budget: int) -> str:
    """Common tables that end in r(doc_id, lo, hi, d, leaf): the minimum-similarity
    split of the sentences of ``table`` (doc_id, sents)."""
    return f"""
{sql_sims(table)},
doc as (select doc_id, lens, list_prepend(0, list_transform(range(1, len(lens) + 1), lambda i: list_sum(lens[1:i])::bigint)) as cum
        from (select doc_id, list_transform(sents, lambda s: len({sql_words('s')})) as lens from ({table}))),
f as (select doc_id, list(f order by o) as f from sims group by doc_id),
r(doc_id, lo, hi, d, leaf) as (
  select doc_id, 0::bigint, len(lens)::bigint, 0, len(lens) <= 1 or cum[len(lens) + 1] <= {budget} from doc where len(lens) > 0
  union all
  select doc_id, lo, hi, d, hi - lo <= 1 or cum[hi + 1] - cum[lo + 1] <= {budget} or d > 900
  from (select doc_id, unnest([lo, c]) as lo, unnest([c, hi]) as hi, d + 1 as d, cum
        from (select r.doc_id, lo, hi, d, cum, lo + list_position(f[lo + 1:hi - 1], list_min(f[lo + 1:hi - 1])) as c
              from r join doc using (doc_id) join f using (doc_id) where not leaf)))
"""


@query(f"with recursive {sql_spans(SQL_SENTS, SPLIT)} select doc_id, lo::int as lo, hi::int as hi from r where leaf")
def split_min_similarity(spark, sf_dir):
    sents = docs(spark, sf_dir).select("doc_id", T.sentences(F.col("text"), 5).alias("sents"))
    spans = segment.split_min_similarity(sents, "sents", SPLIT)
    return spans.select("doc_id", F.explode("spans").alias("s")).select("doc_id", "s.lo", "s.hi")


@query("""
select conv_id, '<s> ' || coalesce(string_agg(text, ' </s> ' order by turn) filter (where role = 'assistant'), '') as hypo from conversations group by conv_id
""")
def combine_segments(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    return segment.combine(turns.where("role = 'assistant'"), turns.select("conv_id").distinct(), ["conv_id"], "turn", "text")


# ------------------------------------------------------------------------ ROUGE
def _turn_pairs(spark, sf_dir):
    by_turn = Window.partitionBy("conv_id").orderBy("turn")
    turns = table(spark, sf_dir, "conversations").withColumn("reference", F.lag("text").over(by_turn))
    return turns.where("role = 'assistant' and reference is not null").select("conv_id", "turn", F.col("text").alias("hypothesis"), "reference")


SQL_TURNS = """
  select conv_id, turn, text as hypothesis, reference from (select *, lag(text) over (partition by conv_id order by turn) as reference from conversations)
  where role = 'assistant' and reference is not null
"""


def sql_rouge_n(n: int) -> str:
    def grams(x: str) -> str:
        t = sql_rouge(x)
        return t if n == 1 else f"(select case when len(t) >= {n} then list_transform(range(1, len(t) - {n - 2}), lambda i: array_to_string(t[i:i + {n - 1}], ' ')) else []::varchar[] end from (select {t} as t))"

    return f"""
  p as ({SQL_TURNS}),
  g as (select conv_id, turn, {grams('hypothesis')} as h, {grams('reference')} as r from p),
  h as (select conv_id, turn, t, count(*) as k from (select conv_id, turn, unnest(h) as t from g) group by all),
  r as (select conv_id, turn, t, count(*) as k from (select conv_id, turn, unnest(r) as t from g) group by all),
  b as (select conv_id, turn, sum(least(h.k, r.k)) as k from h join r using (conv_id, turn, t) group by all),
  s as (select conv_id, turn, coalesce(k / nullif(len(h), 0), 0.0) as p, coalesce(k / nullif(len(r), 0), 0.0) as r, coalesce(2.0 * k / nullif(len(h) + len(r), 0), 0.0) as f
        from g left join b using (conv_id, turn))
"""


def _pair_query(kind: str):
    def run(spark, sf_dir):
        scored = rouge.pair_scores(_turn_pairs(spark, sf_dir), "hypothesis", "reference", [kind])
        return scored.select("conv_id", "turn", *[F.round(f"rouge{kind}_{c}", 6).alias(f"rouge{kind}_{c}") for c in ("precision", "recall", "fmeasure")])

    run.__name__ = f"rouge{kind}_pairs"
    return run


for _n in (1, 2):
    query(f"with {sql_rouge_n(_n)} select conv_id, turn, round(p, 6) as rouge{_n}_precision, round(r, 6) as rouge{_n}_recall, round(f, 6) as rouge{_n}_fmeasure from s")(_pair_query(str(_n)))

def sql_lcs(pairs: str) -> str:
    """Rows of the longest common subsequence's table, dp(k, i, row), for ``pairs``
    (k, x, y): row[j + 1] is its length for the first i of x and the first j of y."""
    return f"""
  c as ({pairs}),
  dp(k, i, row) as (
    select k, 0::bigint, list_transform(range(0, len(y) + 1), lambda j: 0::bigint) from c
    union all
    select k, i + 1, list_prepend(0::bigint, list_transform(range(1, len(best) + 1), lambda j: list_max(best[1:j])))
    from (select dp.k, i, list_transform(range(1, len(y) + 1), lambda j: greatest(row[j + 1], row[j] + (x[i + 1] = y[j])::bigint)) as best
          from dp join c using (k) where i < len(x)))
"""


SQL_LSUM_SIDES = f"""
  p as (select row_number() over () as pair, conv_id, turn, string_split(hypothesis, chr(10)) as h, string_split(reference, chr(10)) as r from ({SQL_TURNS})),
  h as (select pair, o, t from (select pair, unnest(range(1, len(h) + 1)) as o, unnest(list_transform(h, lambda s: {sql_rouge('s')})) as t from p) where len(t) > 0),
  r as (select pair, o, t from (select pair, unnest(range(1, len(r) + 1)) as o, unnest(list_transform(r, lambda s: {sql_rouge('s')})) as t from p) where len(t) > 0)
"""

query(f"""
with recursive p as ({SQL_TURNS}),
{sql_lcs(f"select row_number() over () as k, conv_id, turn, {sql_rouge('hypothesis')} as x, {sql_rouge('reference')} as y from p")},
s as (select conv_id, turn, nullif(len(x), 0) as n, nullif(len(y), 0) as m, row[len(y) + 1] as hits from c join dp on c.k = dp.k and i = len(x))
select conv_id, turn, coalesce(round(hits / n, 6), 0.0) as rougeL_precision, coalesce(round(hits / m, 6), 0.0) as rougeL_recall,
       coalesce(round(2.0 * hits / nullif(n + m, 0), 6), 0.0) as rougeL_fmeasure from s
""")(_pair_query("L"))
# every reference sentence's places that lie on its common subsequence with some
# hypothesis sentence, each token as often as the hypothesis has it
query(f"""
with recursive {SQL_LSUM_SIDES},
{sql_lcs("select row_number() over () as k, h.pair, r.o, h.t as x, r.t as y from h join r using (pair)")},
back(k, i, j, hit) as (
  select k, len(x)::bigint, len(y)::bigint, null::bigint from c
  union all
  select k, case when same or up then i - 1 else i end, case when same or not up then j - 1 else j end, case when same then j end
  from (select b.k, b.i, b.j, x[b.i] = y[b.j] as same, above.row[b.j + 1] = own.row[b.j + 1] as up
        from back b join c using (k) join dp own on own.k = b.k and own.i = b.i join dp above on above.k = b.k and above.i = b.i - 1
        where b.i > 0 and b.j > 0)),
places as (select distinct pair, o, hit, y[hit] as token from back join c using (k) where hit is not null),
used as (select pair, token, count(*) as u from places group by all),
has as (select pair, token, count(*) as u from (select pair, unnest(t) as token from h) group by all),
hits as (select pair, sum(least(used.u, has.u)) as hits from used join has using (pair, token) group by pair),
sizes as (select pair, coalesce((select sum(len(t)) from h where h.pair = p.pair), 0) as n, coalesce((select sum(len(t)) from r where r.pair = p.pair), 0) as m from p)
select conv_id, turn, coalesce(round(hits / nullif(n, 0), 6), 0.0) as rougeLsum_precision, coalesce(round(hits / nullif(m, 0), 6), 0.0) as rougeLsum_recall,
       coalesce(round(2.0 * hits / nullif(n + m, 0), 6), 0.0) as rougeLsum_fmeasure
from p join sizes using (pair) left join hits using (pair)
""")(_pair_query("Lsum"))


@query(f"""
with p as ({SQL_TURNS}),
t as (select row_number() over () as k, {sql_rouge('hypothesis')} as x, {sql_rouge('reference')} as y from p),
s as (select coalesce(len(list_filter(x, lambda w: list_contains(y, w))) / nullif(len(x), 0), 0.0) as p, coalesce(len(list_filter(y, lambda w: list_contains(x, w))) / nullif(len(y), 0), 0.0) as r from t)
select round(avg(p), 4) as mean_p, round(avg(r), 4) as mean_r, round(avg(coalesce(2.0 * p * r / nullif(p + r, 0), 0.0)), 4) as mean_f from s
""")
def corpus_embedding_scores(spark, sf_dir):
    """Mean of the embedding scores with the default similarity."""
    scored = _turn_pairs(spark, sf_dir).select(rouge.embedding_scores(F.col("hypothesis"), F.col("reference")).alias("s"))
    return scored.agg(*[F.round(F.avg(f"s.{c}"), 4).alias(f"mean_{c}") for c in "prf"])


@query(f"""
with {sql_rouge_n(1)} select round(avg(p), 4) as rouge1_precision, round(avg(r), 4) as rouge1_recall, round(avg(f), 4) as rouge1_fmeasure,
  round(100 * avg(f), 2) as rouge1_f_percent, round(100 * avg(r), 2) as rouge1_r_percent, round(100 * avg(p), 2) as rouge1_p_percent from s
""")
def corpus_rouge(spark, sf_dir):
    scored = rouge.pair_scores(_turn_pairs(spark, sf_dir), "hypothesis", "reference", ["1"])
    return scored.agg(*[F.round(F.avg(f"rouge1_{c}"), 4).alias(f"rouge1_{c}") for c in ("precision", "recall", "fmeasure")], *[F.round(100 * F.avg(f"rouge1_{c}"), 2).alias(f"rouge1_{c[0]}_percent") for c in ("fmeasure", "recall", "precision")])


@query(f"""
with recursive p as ({SQL_PAIRS}),
d as (select doc_id, list_distinct({sql_rouge("array_to_string(sents, ' ')")}) as own, list_transform(summary, lambda s: list_distinct({sql_rouge('s')})) as w from p where len(sents) > 0),
r(doc_id, have, left_, best, n, pick) as (
  select doc_id, []::varchar[], range(1, len(w) + 1), 0.0::double, 0, null::bigint from d where len(own) > 0
  union all
  select doc_id, list_distinct(list_concat(have, w[t.i])), list_filter(left_, lambda x: x <> t.i), t.f, n + 1, t.i
  from (select r.doc_id, have, left_, best, n, w,
          list_reduce(list_transform(left_, lambda i: {{'i': i, 'f': round(coalesce(2.0 * len(list_intersect(list_distinct(list_concat(have, w[i])), own))
                      / nullif(case when len(list_distinct(list_concat(have, w[i]))) = 0 then 0 else len(list_distinct(list_concat(have, w[i]))) + len(own) end, 0), 0.0), 6)}}), lambda a, b: case when b.f > a.f then b else a end) as t
        from r join d using (doc_id) where len(left_) > 0 and n < 100)
  where t.f > best)
select doc_id, n::int as pick_ord, (pick - 1)::int as idx, best as f from r where n > 0
""")
def greedy_target_match(spark, sf_dir):
    whole = pairs(spark, sf_dir).where("size(sents) > 0").withColumn("source", F.array_join("sents", " "))
    matched = whole.select("doc_id", rouge.greedy_match("source", "summary").alias("m"))
    return matched.select("doc_id", F.posexplode("m.picks").alias("o", "p")).select("doc_id", (F.col("o") + 1).alias("pick_ord"), "p.idx", "p.f")


@query(f"""
with p as ({SQL_TURNS}), g as (select conv_id, turn, list_distinct({sql_rouge('hypothesis')}) as x, list_distinct({sql_rouge('reference')}) as y from p),
s as (select conv_id, turn, coalesce(len(list_intersect(x, y)) / nullif(len(x), 0), 0.0) as p, coalesce(len(list_intersect(x, y)) / nullif(len(y), 0), 0.0) as r from g)
select conv_id, turn, round(2.0 * p * r / (p + r + 1e-8), 6) as f, round(p, 6) as p, round(r, 6) as r from s
""")
def set_rouge_pairs(spark, sf_dir):
    s = rouge.set_rouge(F.col("hypothesis"), F.col("reference"))
    scored = _turn_pairs(spark, sf_dir).select("conv_id", "turn", s.alias("s"))
    return scored.select("conv_id", "turn", *[F.round(f"s.{c}", 6).alias(c) for c in "fpr"])


@query("select conv_id, turn, 'oppsummer: ' || text as input_text from conversations where role = 'user'")
def prompted_inputs(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").where("role = 'user'")
    return turns.select("conv_id", "turn", F.concat(F.lit("oppsummer: "), "text").alias("input_text"))


@query("select conv_id, turn, text from conversations where text is not null and role in ('user', 'assistant') union all select conv_id, -1, string_agg(text, ' ' order by turn) from conversations group by conv_id")
def union_turns(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    whole = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t")).select("conv_id", F.lit(-1).cast("long").alias("turn"), F.array_join("t.text", " ").alias("text"))
    return turns.where("text is not null and role in ('user', 'assistant')").select("conv_id", "turn", "text").unionByName(whole)


# ------------------------------------------------------------------- similarity
SQL_IDF = f"""
  idf as (select t as token, count(*) as df, round(ln((any_value(n) + 1) / (count(*) + 1)), 6) as idf
          from (select doc_id, unnest(list_distinct({sql_rouge('text')})) as t from documents), (select count(*) as n from documents) group by t)
"""


@query(f"with {SQL_IDF} select token, df, idf from idf")
def token_idf(spark, sf_dir):
    return similarity.idf(docs(spark, sf_dir), T.rouge_tokens(F.col("text")))


@query(f"""
select lang, t as token, count(*) as df, round(ln((any_value(n) + 1) / (count(*) + 1)), 6) as idf
from (select doc_id, lang, unnest(list_distinct({sql_rouge('text')})) as t from documents) join (select lang, count(*) as n from documents group by lang) using (lang) group by lang, t
""")
def token_idf_by_split(spark, sf_dir):
    return similarity.idf(table(spark, sf_dir, "documents").select("lang", "text"), T.rouge_tokens(F.col("text")), by="lang")


@query(f"""
with {SQL_IDF},
occ as (select doc_id, sum_ord, generate_subscripts(t, 1) - 1 as tok_ord, unnest(t) as token
        from (select doc_id, generate_subscripts(summary, 1) - 1 as sum_ord, unnest(list_transform(summary, lambda s: {sql_rouge('s')})) as t from ({SQL_PAIRS})))
select doc_id, sum_ord, tok_ord, token, round(coalesce(idf, 0) / (sum(coalesce(idf, 0)) over (partition by doc_id, sum_ord) + 1e-9), 5) as weight
from occ left join idf using (token)
""")
def idf_weights(spark, sf_dir):
    summary = pairs(spark, sf_dir).select("doc_id", F.posexplode("summary").alias("sum_ord", "s"))
    occurrences = summary.select("doc_id", "sum_ord", F.posexplode(T.rouge_tokens(F.col("s"))).alias("tok_ord", "token"))
    idfs = similarity.idf(docs(spark, sf_dir), T.rouge_tokens(F.col("text")))
    return similarity.idf_weights(occurrences, idfs, ["doc_id", "sum_ord"], 5).select("doc_id", "sum_ord", "tok_ord", "token", "weight")


def _cells(spark, sf_dir):
    """Cells over ``embeddings``: ten vectors a sentence, ten sentences a document,
    its first three the summary; weights go by the vector's number."""
    v = table(spark, sf_dir, "embeddings")
    sent = F.floor((F.col("vec_id") % 100) / 10).cast("int")
    weight = (F.col("vec_id") % 7 + 1).cast("double")
    tokens = v.select(
        F.floor(F.col("vec_id") / 100).alias("doc_id"),
        F.when(sent < 3, "summary").otherwise("text").alias("side"),
        F.when(sent < 3, sent).otherwise(sent - 3).alias("sent_ord"),
        (F.col("vec_id") % 10).alias("tok_ord"),
        (weight / 40.0).alias("weight"),
        F.col("embedding").alias("vec"),
    )
    return similarity.similarity_cells(tokens, 5)


SQL_CELLS = """
  tok as (select vec_id // 100 as doc_id, (vec_id % 100) // 10 as sent, vec_id % 10 as tok, (vec_id % 7 + 1)::double / 40.0 as w, embedding::double[] as e from embeddings),
  unit as (select doc_id, sent, tok, w, list_transform(e, lambda x: x / nullif(sqrt(list_dot_product(e, e)), 0)) as e from tok),
  cos as (select a.doc_id, a.sent as i, b.sent - 3 as j, a.tok as x, b.tok as y, a.w as wa, b.w as wb, list_dot_product(a.e, b.e) as c from unit a join unit b on a.doc_id = b.doc_id and a.sent < 3 and b.sent >= 3),
  p as (select doc_id, i, j, sum(w * c) as p from (select doc_id, i, j, x, any_value(wa) as w, max(c) as c from cos group by doc_id, i, j, x) group by all),
  r as (select doc_id, i, j, sum(w * c) as r from (select doc_id, i, j, y, any_value(wb) as w, max(c) as c from cos group by doc_id, i, j, y) group by all),
  cells as (select doc_id, i as sum_ord, j as txt_ord, round(2 * p * r / nullif(p + r, 0), 5) as f from p join r using (doc_id, i, j))
"""


@query(f"with {SQL_CELLS} select doc_id, sum_ord::int as sum_ord, txt_ord::int as txt_ord, f from cells")
def weighted_cosine_cells(spark, sf_dir):
    return _cells(spark, sf_dir)


@query(f"with {SQL_CELLS} select doc_id, txt_ord::int as txt_ord, max(f) as label, any_value(sum_ord)::int as sum_ord from (select *, row_number() over (partition by doc_id, txt_ord order by f desc, sum_ord) as k from cells) where k = 1 group by all")
def best_summary_label(spark, sf_dir):
    return similarity.best_labels(similarity.complete_documents(_cells(spark, sf_dir)))


SQL_KTH = """
  kth as (select doc_id, k, f as kth from (select *, row_number() over (partition by doc_id order by f desc, sum_ord, txt_ord) as rank from cells)
          join (select doc_id, count(distinct sum_ord) as k from cells group by doc_id) using (doc_id) where rank = k)
"""


@query(f"with {SQL_CELLS}, {SQL_KTH} select * from kth")
def kth_threshold(spark, sf_dir):
    return similarity.kth_values(_cells(spark, sf_dir))


@query(f"with {SQL_CELLS}, {SQL_KTH} select count(*) as n, round(avg(kth), 5) as mean, round(stddev_pop(kth), 5) as std, round(quantile_cont(kth, 0.5), 5) as median from kth where kth <> 0")
def threshold_stats(spark, sf_dir):
    return similarity.threshold_stats(similarity.kth_values(_cells(spark, sf_dir)))


@query(f"with {SQL_CELLS} select doc_id, count(*) as n_cells from cells group by doc_id having max(sum_ord) = 2 and max(txt_ord) = 6")
def matrix_guard(spark, sf_dir):
    cells = _cells(spark, sf_dir)
    expected = cells.select("doc_id").distinct().withColumn("n_summary", F.lit(3)).withColumn("n_text", F.lit(7))
    return similarity.shape_guard(cells, expected).groupBy("doc_id").agg(F.count("*").alias("n_cells"))


@query(f"""
with {SQL_CELLS}, e as (select min(f) as lo, max(f) as hi from cells)
select (case when hi = lo then 1 else least(floor((f - lo) * 50 / (hi - lo)) + 1, 50) end)::int as bin, count(*) as n from cells, e group by 1
""")
def similarity_hist50(spark, sf_dir):
    return corpus.histogram(_cells(spark, sf_dir), F.col("f"), 50)


@query(f"""
with {SQL_CELLS}, pair as ({SQL_PAIRS}), best as (select doc_id, txt_ord, sum_ord, f from (select *, row_number() over (partition by doc_id, txt_ord order by f desc, sum_ord) as k from cells) where k = 1)
select * from (select doc_id, txt_ord::int as txt_ord, sents[txt_ord + 1] as text, summary[sum_ord + 1] as summary, f as label from best join pair using (doc_id)) where text is not null and summary is not null
""")
def regression_rows(spark, sf_dir):
    labels = similarity.best_labels(similarity.complete_documents(_cells(spark, sf_dir)))
    return similarity.regression_rows(labels, pairs(spark, sf_dir))


@query(f"select doc_id, array_to_string(list_concat([array_to_string(summary, ' ')], sents), ' ') as text from ({SQL_PAIRS})")
def combined_string(spark, sf_dir):
    return pairs(spark, sf_dir).select("doc_id", corpus.with_summary(F.array_join("summary", " "), F.col("sents")).alias("text"))


# ---------------------------------------------------------------------- pruning
def _scored(spark, sf_dir):
    return ml.scored_sentences(pairs(spark, sf_dir))


@query(SQL_SCORED)
def scored_sentences(spark, sf_dir):
    return _scored(spark, sf_dir)


@query(f"with s as ({SQL_SCORED}) select doc_id, sent_ord, score from s where score > 0.1")
def prune_global(spark, sf_dir):
    return prune.prune_global(_scored(spark, sf_dir), 0.1).select("doc_id", "sent_ord", "score")


@query(f"with s as ({SQL_SCORED}) select doc_id, sent_ord, score from (select *, round(avg(score) over (partition by doc_id), 6) as m from s) where score >= m")
def prune_local(spark, sf_dir):
    return prune.prune_local(_scored(spark, sf_dir)).select("doc_id", "sent_ord", "score")


SQL_TOP = f"""
  s as ({SQL_SCORED}),
  top as (select doc_id, sent_ord, sentence, score from (select *, row_number() over (partition by doc_id order by score desc, sent_ord) as k, count(*) over (partition by doc_id) as n from s)
          where k <= greatest(1, floor(n * 0.3)))
"""


@query(f"with {SQL_TOP} select doc_id, list(sentence order by sent_ord) as text, list(score order by sent_ord) as scores from top group by doc_id")
def prune_top_p(spark, sf_dir):
    return prune.assembled(prune.prune_top(_scored(spark, sf_dir), 0.3))


@query(f"with {SQL_TOP} select doc_id, sent_ord, row_number() over (partition by doc_id order by md5('123:' || doc_id || ':' || sent_ord)) - 1 as new_ord from top")
def prune_shuffled(spark, sf_dir):
    return prune.shuffled(prune.prune_top(_scored(spark, sf_dir), 0.3)).select("doc_id", "sent_ord", "new_ord")


@query(f"with {SQL_TOP} select doc_id, 'KAPITTEL_0' as chapter, 'KAPITTEL_0-0' as section, list(sentence order by sent_ord) as lines from top group by doc_id")
def reformat_chapters(spark, sf_dir):
    shaped = prune.as_chapters(prune.assembled(prune.prune_top(_scored(spark, sf_dir), 0.3)))
    return shaped.select("doc_id", F.explode("text").alias("chapter", "t")).select("doc_id", "chapter", F.explode("t").alias("section", "lines"))


# ------------------------------------------------------------------------ joins
@query("select doc_id, length(text) as n_chars from documents where doc_id in (select doc_id from labels)")
def semi_join_ids(spark, sf_dir):
    return docs(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id", "left_semi").select("doc_id", F.length("text").alias("n_chars"))


@query("select doc_id, quality::double as label, length(text) as input_chars from documents join labels using (doc_id)")
def label_join(spark, sf_dir):
    return docs(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id").select("doc_id", F.col("quality").cast("double").alias("label"), F.length("text").alias("input_chars"))


# ------------------------------------------------------------------------- HTML
@query("select page_id, generate_subscripts(p, 1) - 1 as ord, unnest(p) as text from (select page_id, regexp_extract_all(html, '(?s)<p[^>]*>(.*?)</p>', 1) as p from pages)")
def html_paragraphs(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", F.posexplode(html.regex_paragraphs(F.col("html"))).alias("ord", "text"))


@query("""
select page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '[ \\n\\t\\r\\f]+', ' ', 'g')) as text from pages
""")
def html_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", html.regex_text(F.col("html")).alias("text"))


# paragraphs end at the next one, at their own end tag or with the article
SQL_PAGE_PARAGRAPHS = """
  select page_id, generate_subscripts(p, 1) - 2 as ord, unnest(p) as piece from (select page_id, string_split_regex(html, '<p(?:\\s[^>]*)?>') as p from pages)
"""


@query(f"""
select page_id, 'paragraphs' as status, 0 as chap, 0 as sub, ord::int as ord, null::varchar as id,
  replace(replace(replace(regexp_replace(regexp_replace(piece, '(?s)</(p|article|body|main|div)>.*', ''), '(?s)<[^>]*>', '', 'g'), '&quot;', '"'), '&lt;', '<'), '&amp;', '&') as text
from ({SQL_PAGE_PARAGRAPHS}) where ord >= 0
""")
def html_parsed(spark, sf_dir):
    return html.page_lines(html.parse_pages(table(spark, sf_dir, "pages"), ["page_id"]), ["page_id"])


@query(f"""
with l as (select doc_id, unnest(range(1, len(l) + 1)) as c, unnest(l) as raw from (select doc_id, string_split(text, chr(10)) as l from documents)),
n as (select doc_id, c, array_to_string({sql_words('raw')}, ' ') as line from l),
made as (
  select doc_id, 0 as chap, 0 as sub, 0 as ord, 'KAPITTEL_0-0' as id, 'intro' as text from documents where text is not null
  union all select doc_id, c, 0, 0, 'KAPITTEL_' || (c - 1) || '-0', 'Part ' || (c - 1) from n
  union all select doc_id, c, 0, 1, 'KAPITTEL_' || (c - 1) || '-0', line from n where line <> ''
  union all select doc_id, c, 1, 0, 'KAPITTEL_' || (c - 1) || '-1', 'head' from n
  union all select doc_id, c, 1, 1, 'KAPITTEL_' || (c - 1) || '-1', trim(line || ' end') from n
  union all select doc_id, c, 1, 2, 'KAPITTEL_' || (c - 1) || '-1', 'a b' from n)
select doc_id, 'chapters' as status, chap::int as chap, sub::int as sub, ord::int as ord, id, text from made
""")
def html_chapters(spark, sf_dir):
    """Chapters and sub-chapters, from pages built of the documents' lines."""
    escaped = F.transform(F.split("text", "\n"), lambda s: F.replace(F.replace(s, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")))

    def chapter(s, i):
        n = i.cast("string")
        sub = F.concat(F.lit('<div data-level="2" data-id="KAPITTEL_'), n, F.lit('-1"><h3>head</h3><ul><li>'), s, F.lit("</li><li>end</li></ul><table><tr><td>a<b>b</b></td></tr></table><p> </p></div>"))
        return F.concat(F.lit('<div data-level="1" data-id="KAPITTEL_'), n, F.lit('"><h2>Part '), n, F.lit("</h2><p>"), s, F.lit("</p>"), sub, F.lit("</div>"))

    made = docs(spark, sf_dir).select("doc_id", F.concat(F.lit('<div id="documentBody"><p>intro</p>'), F.array_join(F.transform(escaped, chapter), ""), F.lit("</div>")).alias("html"))
    return html.page_lines(html.parse_pages(made, ["doc_id"]), ["doc_id"])


@query("select count(*) as n, count(*) filter (where len(regexp_extract_all(html, '<p[ >]')) > 0) as n_paragraph_pages from pages")
def html_status(spark, sf_dir):
    parsed = html.parse_pages(table(spark, sf_dir, "pages"), ["page_id"])
    return parsed.agg(F.count("*").alias("n"), F.count_if(F.col("status") == "paragraphs").alias("n_paragraph_pages"))


# ---------------------------------------------------------------- configuration
CONFIG_VALUES = (" 12 ", "0.5", "True", "no", "\" \"", "'x '", " y ", "TRUE", "-3", "1e-3")


@query("""
select source, trim(source, '"' || chr(39)) as as_text, 'str' as kind, null::bigint as as_int, null::double as as_float, null::boolean as as_bool from (select distinct source from documents)
union all
select * from (values
  (' 12 ', ' 12 ', 'int', 12::bigint, 12.0::double, null::boolean), ('0.5', '0.5', 'float', null, 0.5, null), ('True', 'True', 'bool', null, null, true),
  ('no', 'no', 'str', null, null, null), ('" "', ' ', 'str', null, null, null), (chr(39) || 'x ' || chr(39), 'x ', 'str', null, null, null), (' y ', ' y ', 'str', null, null, null),
  ('TRUE', 'TRUE', 'str', null, null, null), ('-3', '-3', 'int', -3, -3.0, null), ('1e-3', '1e-3', 'float', null, 0.001, null))
""")
def config_cast(spark, sf_dir):
    known = spark.createDataFrame([(v,) for v in CONFIG_VALUES], "source string")
    values = table(spark, sf_dir, "documents").select("source").distinct().unionByName(known)
    return values.select("source", *[c.alias(k) for k, c in T.basic_value(F.col("source")).items()])


@query("""
with r as (select doc_id, row_number() over (order by md5('123:' || doc_id)) - 1 as r, count(*) over () as n from documents)
select doc_id from r where r >= floor(0.7 * n) + floor(0.1 * n)
""")
def test_mode_rows(spark, sf_dir):
    """The rows that a run in test mode reads."""
    return corpus.split(docs(spark, sf_dir).select("doc_id"), "doc_id").where(F.col("split").isin(*presets.splits_of("test"))).select("doc_id")


@query(f"""
select doc_id, -1 as seg_ord, 'oppsummer: ' || array_to_string(summary, ' ') as source from ({SQL_PAIRS})
union all
select doc_id, generate_subscripts(g, 1) - 1, 'oppsummer: ' || unnest(list_transform(g, lambda x: trim(array_to_string(x, ' ')))) from ({SQL_PACKED.replace(SQL_SENTS, SQL_PAIRS)})
""")
def prompted_segments(spark, sf_dir):
    """Packed sentences after a segment with the query, all with the prompt."""
    asked = pairs(spark, sf_dir).withColumn("asked", F.array_join("summary", " "))
    packed = segment.pack_sentences(asked, "sents", PACK, prompt="oppsummer: ", query="asked")
    return segment.explode_segments(packed, ["doc_id"]).withColumn("seg_ord", F.col("seg_ord") - 1)


# -------------------------------------------------------------------- pipelines
def _preset_query(method: str, stages: int = 1):
    def run(spark, sf_dir):
        scored = presets.run(pairs(spark, sf_dir), method, stages=stages)["pairs"]
        return scored.select("doc_id", "n_segments", "n_picks", "hypo", *[F.round(f"rouge1_{c}", 6).alias(f"rouge1_{c}") for c in ("precision", "recall", "fmeasure")])

    run.__name__ = f"preset_{method.replace('.', '_')}" + ("" if stages == 1 else f"_{stages}")
    return run


def sql_preset(segments: str, before: str = "") -> str:
    """A preset's result from its segments (doc_id, seg_ord, source)."""
    return f"""
with recursive {before + ',' if before else ''}
p as ({SQL_PAIRS}),
seg as ({segments}),
m as (select doc_id, seg_ord, list_distinct({sql_rouge('source')}) as own, list_transform(summary, lambda s: list_distinct({sql_rouge('s')})) as w from seg join p using (doc_id)),
g(doc_id, seg_ord, have, left_, best, n) as (
  select doc_id, seg_ord, []::varchar[], range(1, len(w) + 1), 0.0::double, 0 from m where len(own) > 0
  union all
  select doc_id, seg_ord, list_distinct(list_concat(have, w[t.i])), list_filter(left_, lambda x: x <> t.i), t.f, n + 1
  from (select g.doc_id, g.seg_ord, have, left_, best, n, w,
          list_reduce(list_transform(left_, lambda i: {{'i': i, 'f': round(coalesce(2.0 * len(list_intersect(list_distinct(list_concat(have, w[i])), own))
                      / nullif(case when len(list_distinct(list_concat(have, w[i]))) = 0 then 0 else len(list_distinct(list_concat(have, w[i]))) + len(own) end, 0), 0.0), 6)}}), lambda a, b: case when b.f > a.f then b else a end) as t
        from g join m using (doc_id, seg_ord) where len(left_) > 0 and n < 100)
  where t.f > best),
picked as (select doc_id, count(*) as n_segments, sum(k) as n_picks
           from (select seg.doc_id, seg.seg_ord, coalesce(max(g.n), 0) as k from seg left join g on g.doc_id = seg.doc_id and g.seg_ord = seg.seg_ord group by all) group by doc_id),
hypos as (select doc_id, string_agg(array_to_string({sql_sentences('source', 1)}[1:3], ' '), ' </s> ' order by seg_ord) as h from seg group by doc_id),
pr as (select doc_id, coalesce(h, '') as h, {sql_rouge("replace(coalesce(h, ''), ' </s> ', chr(10))")} as x, {sql_rouge("array_to_string(summary, chr(10))")} as y from p left join hypos using (doc_id)),
cx as (select doc_id, t, count(*) as k from (select doc_id, unnest(x) as t from pr) group by all),
cy as (select doc_id, t, count(*) as k from (select doc_id, unnest(y) as t from pr) group by all),
b as (select doc_id, sum(least(cx.k, cy.k)) as k from cx join cy using (doc_id, t) group by doc_id)
select doc_id, coalesce(n_segments, 0)::bigint as n_segments, coalesce(n_picks, 0)::bigint as n_picks, '<s> ' || h as hypo,
  round(coalesce(k / nullif(len(x), 0), 0.0), 6) as rouge1_precision, round(coalesce(k / nullif(len(y), 0), 0.0), 6) as rouge1_recall,
  round(coalesce(2.0 * k / nullif(len(x) + len(y), 0), 0.0), 6) as rouge1_fmeasure
from pr left join b using (doc_id) left join picked using (doc_id)
"""


SQL_LEAVES = sql_spans(SQL_PAIRS, 492)
PRESET_SQL = {
    "summ.n": sql_preset(f"select doc_id, generate_subscripts(g, 1) - 1 as seg_ord, unnest(list_transform(g, lambda x: trim(array_to_string(x, ' ')))) as source from ({SQL_PACKED.replace(SQL_SENTS, SQL_PAIRS)})"),
    "paragraph.level": sql_preset(f"""select doc_id, generate_subscripts(s, 1) - 1 as seg_ord, unnest(s) as source
        from (select doc_id, list_filter(list_transform({sql_groups('p', 'st')}, lambda g: trim(array_to_string(g, ' '))), lambda s: s <> '') as s
              from (select doc_id, sents as p, {sql_pack(f"list_transform(sents, lambda s: len({sql_words('s')}))", 492)} as st from ({SQL_PAIRS})))"""),
    "paragraph.rouge": sql_preset("select doc_id, row_number() over (partition by doc_id order by lo) - 1 as seg_ord, array_to_string(sents[lo + 1:hi], ' ') as source from r join p using (doc_id) where leaf", SQL_LEAVES),
    "classic": sql_preset("select doc_id, 0 as seg_ord, array_to_string(sents, ' ') as source from p where trim(array_to_string(sents, ' '), ' ') <> ''"),
}
for _method in presets.PRESETS:
    query(PRESET_SQL.get(_method))(_preset_query(_method))
query()(_preset_query("summ.n", stages=2))


@query()
def regressor_pipeline(spark, sf_dir):
    """Score sentences, fit the default regressor on them, and score them with it."""
    rows = _scored(spark, sf_dir).select("doc_id", "sent_ord", F.col("sentence").alias("input_text"), F.col("score").alias("label"))
    model = ml.train_regressor(rows)
    return ml.regressor_scores(model, rows).select("doc_id", "sent_ord", "label", F.round("score", 4).alias("score"))
