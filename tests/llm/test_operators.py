"""Each operator against brute force, and on odd tables: nulls, empty and very
long texts, ties, repeated rows, empty tables, extra columns with clashing names."""

import collections
import hashlib
import itertools
import math
import random
import time
import tracemalloc
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from brevis.llm import blocks, common, components, decontaminate, html_extract, language_id, line_dedup, media, mixing, ngram_join, sharding, suffix_dedup, url_filter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node string, k int, sign int, size string, target string"
WORDS = [a + b + c for a in "bdfgklm" for b in "aeiou" for c in "nrst"]


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(n))


def odd_rows():
    base = prose(1, 120)
    near = base.replace(base.split()[60], "changed", 1)
    rows = [
        (1, base, "en", "a"),
        (2, base, "en", "b"),
        (3, near, None, "a"),
        (4, None, "en", None),
        (5, "", "en", "a"),
        (6, "   \n\t ", "en", "c"),
        (7, "One two", "en", "c"),
        (8, "one TWO", "en", "c"),
        (9, "123 456 -- !!", "en", "c"),
        (10, "\n".join(prose(2, 40) for _ in range(3)) + "\n" + prose(9, 30), "en", None),
        (11, prose(3, 9000), "en", "a"),
        (11, prose(3, 9000), "en", "a"),
        (None, base, "en", "d"),
        (None, None, None, None),
        (12, "æøå " * 80 + prose(4, 20), "de", "d"),
        (13, "x" * 5000, "de", "d"),
        (14, base + " " + prose(5, 15), "en", "b"),
    ]
    return [(i, t, l, s, 0, "n", 1, 2, "z", "t") for i, t, l, s in rows]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words_of(text):
    for c in "\t\n\x0b\x0c\r":
        text = text.replace(c, " ")
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return [w for w in low.split(" ") if w]


def grams(text, k=5):
    w = words_of(text or "")
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def linked(rows, same):
    """Components of row numbers, from a predicate on pairs."""
    at = list(range(len(rows)))

    def find(i):
        while at[i] != i:
            i = at[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if same(rows[i], rows[j]):
            at[find(j)] = find(i)
    return [find(i) for i in range(len(rows))]


def thue_morse(k):
    """Two strings that differ everywhere, but not to a polynomial hash modulo a power of two."""
    bits = [0]
    for _ in range(k):
        bits += [1 - b for b in bits]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_span_hash_is_a_polynomial_modulo_a_prime(monkeypatch):
    rng = np.random.default_rng(3)
    data = rng.integers(0, 256, 3000, dtype=np.uint8)
    start = rng.integers(0, 2500, 50)
    end = start + rng.integers(0, 500, 50)
    got = common.span_hash(common.prefix_hash(data), start, end)
    for a, b, h in zip(start, end, got):
        value = sum((int(x) + 1) * pow(common.BASE, i, common.PRIME) for i, x in enumerate(data[a:b])) % common.PRIME
        assert common.mix(np.array([value], np.uint64))[0] == h
    monkeypatch.setattr(common, "STRETCH", 100)
    assert (common.span_hash(common.prefix_hash(data), start, end) == got).all()
    a, b = rng.integers(0, common.PRIME, (2, 500)).astype(np.uint64)
    assert common.product(a, b).tolist() == [x * y % common.PRIME for x, y in zip(a.tolist(), b.tolist())]


def test_thue_morse_strings_are_told_apart(spark):
    x, y = thue_morse(11)
    df = spark.createDataFrame([(1, x), (2, y)], "doc_id long, text string")
    assert {r["component_id"] for r in ngram_join.join(df).collect()} == {1, 2}
    assert [r["n_removed"] for r in line_dedup.summarize(df).collect()] == [0, 0]
    item = spark.createDataFrame([(1, x)], "item_id long, text string")
    assert [r["doc_id"] for r in decontaminate.find_items(df, item).collect()] == [1]
    a, b = thue_morse(9)  # 512 bytes each, which share shorter strings only
    docs = [(1, prose(1, 80) + a[:256] + prose(2, 80)), (2, prose(3, 80) + b[:256] + prose(4, 80))]
    got = suffix_dedup.remove(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in got), key=str) == brute_removed(docs)


# ------------------------------------------------------------- 1 language ID
def test_suffix_automaton_knows_all_substrings():
    text = b"abracadabra banana"
    moves = dict(zip(*(x.tolist() for x in language_id.suffix_automaton(text))))
    for s in itertools.chain((text[i:j] for i in range(len(text)) for j in range(i + 1, len(text) + 1)), (b"abc", b"nn", b"abrab")):
        state = 0
        for c in s:
            state = moves.get(state * 256 + c) if state is not None else None
        assert (state is not None) == (s in text)


def naive_phrases(s, text):
    """Longest matches of a greedy parse, begun anew every STRETCH bytes."""
    n = 0
    for at in range(0, len(s), language_id.STRETCH):
        part, i = s[at : at + language_id.STRETCH], 0
        while i < len(part):
            k = 1
            while i + k < len(part) and part[i : i + k + 1] in text and part[i : i + k] in text:
                k += 1
            i, n = i + k, n + 1
    return n


def model_of(texts):
    return language_id.Model({k: (len(v), *language_id.suffix_automaton(v)) for k, v in texts.items()})


def test_phrases_are_longest_matches(monkeypatch):
    monkeypatch.setattr(language_id, "STRETCH", 64)
    texts = {"a": b" the cat sat on the mat ", "b": "  der mäusebär aß am meer ".encode()}
    model = model_of(texts)
    rng = random.Random(1)
    parts = ["".join(rng.choice("aehtcsmon xzäß") for _ in range(rng.choice([0, 1, 5, 40, 64, 65, 300]))).encode() for _ in range(200)]
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    got = model.phrases(np.frombuffer(b"".join(parts), np.uint8), offsets)
    for row, lang in zip(got, model.languages):
        assert row.tolist() == [naive_phrases(p, texts[lang]) for p in parts]


def test_judging_needs_little_memory():
    import pyarrow as pa

    model = model_of({k: prose(i, 400).encode() for i, k in enumerate(("en", "fr"))})
    texts = pa.array([prose(i, 2000) for i in range(60)] * 16)
    model.table()
    tracemalloc.start()
    whole = model.judge_all(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert texts.nbytes > 7 << 20 and peak < 8 << 20
    alone = model.judge_all(texts[:60])
    assert whole[0] == alone[0] * 16 and (whole[1] == np.tile(alone[1], 16)).all() and (whole[2] == np.tile(alone[2], 16)).all()


def test_words_are_runs_of_letters():
    import pyarrow as pa

    words, has = language_id.normalised(pa.array(["Ab-C  \u00b2 d", "\u00b2 \u00bd \u2167 7", None, "", "ÉTÉ\n\u4e2d"]))
    assert words.to_pylist() == [" ab c d ", "  ", "  ", "  ", " été \u4e2d "] and has.tolist() == [True, False, False, False, True]
    assert model_of({"a": b" ab "}).judge_all(pa.array(["\u00b2 \u00bd \u2167"]))[0] == ["und"]


def test_accepted_sends_texts_once(odd):
    plan = language_id.accepted(odd)._jdf.queryExecution().analyzed()
    while "MapInArrow" not in plan.nodeName():
        plan = plan.children().apply(0)
    assert plan.children().apply(0).output().size() == len(odd.columns)


def test_language_id_query_against_brute_force(spark, sf_dir):
    """Every whole document of the query, judged by naive longest matches."""
    import pyarrow as pa

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sample = language_id.training_texts(docs).toPandas()
    texts = {lang: language_id.training_bytes(rows) for lang, rows in sample.groupby("lang")}
    got = {r["doc_id"]: r for r in language_id.op1_language_id(spark, sf_dir).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for r in rows:
        words = language_id.normalised(pa.array([r["text"]]))[0][0].as_py().encode()
        if len(words) > 6000:
            continue  # the longest ones take the naive parse too long; test_phrases has stretches
        costs = sorted((naive_phrases(words, t) * math.log2(len(t)), lang) for lang, t in texts.items())
        assert got[r["doc_id"]]["lang_pred"] == costs[0][1]
        assert got[r["doc_id"]]["score"] == pytest.approx(1 - costs[0][0] / costs[1][0])


def test_language_id(spark, odd, empty, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.95 and got.score.between(0, 1).all()
    rows = language_id.identify(odd).collect()
    assert len(rows) == len(odd_rows())
    by_id = collections.defaultdict(set)
    for r in rows:
        by_id[r["doc_id"]].add(r["lang_pred"])
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"] or "").encode()) % 3 == 1)
    assert all(by_id[i] == {"und"} for i in (4, 5, 6, 9)) and "und" in by_id[None]
    assert "und" not in by_id[1] | by_id[7]
    assert language_id.identify(empty).count() == 0
    unlabelled = odd.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in language_id.identify(unlabelled).collect()} == {"und"}


def test_language_stage_keeps_clean_rows(odd):
    kept = language_id.accepted(odd)
    assert kept.columns == odd.columns
    assert {r["doc_id"] for r in kept.collect()}.isdisjoint({4, 5, 6, 9})
    assert {1, 2, 3, 10, 11} <= {r["doc_id"] for r in kept.collect()}


# ------------------------------------------------------------------ 2 shards
def test_store_versions_and_tiers(spark, tmp_path, odd):
    store = sharding.ShardStore(spark, str(tmp_path / "store"), target_bytes=40_000)
    assert store.manifest().version == 0 and store.read().count() == 0
    for i in range(6):
        store.append(odd.repartition(3))
    before = store.manifest()
    assert before.version == 6 and sum(s.rows for s in before.shards) == 6 * len(odd_rows())
    after = store.compact()
    assert after.version > 6 and len(after.shards) < len(before.shards) and not store.plan(after.shards)
    assert max(s.size for s in after.shards) <= 2 * max(40_000, max(s.size for s in before.shards))
    want = sorted(map(str, odd_rows() * 6))
    assert sorted(str(tuple(r)) for r in store.read().collect()) == want
    assert sorted(str(tuple(r)) for r in store.read(6).collect()) == want  # an old version stays whole
    store.vacuum()
    assert sorted(str(tuple(r)) for r in store.read().collect()) == want
    version = store.append(odd.where("false"))
    assert version.version == after.version + 1 and version.shards == after.shards


def test_commit_is_atomic(spark, tmp_path, odd):
    store = sharding.ShardStore(spark, str(tmp_path / "store"))
    m = store.append(odd)
    with pytest.raises(sharding.Conflict):
        store.commit(sharding.Manifest(m.version, m.schema, ()))
    assert store.manifest() == m
    assert store._change((), frozenset({"data/gone"}), m.schema) is None  # a merge whose input is gone
    with pytest.raises(ValueError):
        store.append(odd.drop("k"))


def test_sharding_query(spark, odd, empty, sf_dir):
    placed = sharding.op2_sharding(spark, sf_dir)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = sorted((r["doc_id"], hashlib.md5(r["text"].encode()).hexdigest()) for r in docs.collect())
    rows = placed.collect()
    assert sorted((r["doc_id"], r["text_md5"]) for r in rows) == want
    assert all(r["shard_rows"] == n for r in rows for n in [sum(x["shard"] == r["shard"] for x in rows)])
    assert sharding.sharded(odd).placed().count() == len(odd_rows())
    assert sharding.sharded(empty).placed().count() == 0


# -------------------------------------------------------------- 3 line dedup
def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_edit_distances(edits):
    rng, pairs = random.Random(edits), []
    for _ in range(600):
        a = [rng.choice(b"abc") for _ in range(rng.randint(edits + 1, 40))]
        b = a[:]
        for _ in range(rng.randint(0, edits + 2)):
            i, what = rng.randrange(len(b) + 1), rng.randrange(3)
            b[i : i + (what > 0)] = [rng.choice(b"abc")] if what < 2 else []
        if len(b) > edits:
            pairs.append((bytes(a), bytes(b)))
    data = b"".join(a + b for a, b in pairs) + b"\0"
    sizes = np.array([(len(a), len(b)) for a, b in pairs])
    at = np.cumsum(sizes.sum(1)) - sizes.sum(1)
    got = line_dedup.edit_distances(np.frombuffer(data, np.uint8), at, sizes[:, 0], at + sizes[:, 0], sizes[:, 1], edits)
    assert got.tolist() == [min(edits + 1, distance(a, b)) for a, b in pairs]


def test_edit_distances_of_equal_ends():
    rng, pairs = random.Random(5), [(b"", b""), (b"", b"ab"), (b"a", b""), (b"aa", b"a"), (b"aaaa", b"aa")]
    for _ in range(400):
        head, tail = (bytes(rng.choices(b"ab", k=rng.choice([0, 1, 30, 300]))) for _ in range(2))
        a, b = (bytes(rng.choices(b"ab", k=rng.choice([0, 1, 2, 5, 12]))) for _ in range(2))
        pairs.append((head + a + tail, head + b + tail))
    want = [distance(a, b) for a, b in pairs]
    data = np.frombuffer(b"".join(a + b for a, b in pairs) + b"\0", np.uint8)
    sizes = np.array([(len(a), len(b)) for a, b in pairs])
    at = np.cumsum(sizes.sum(1)) - sizes.sum(1)
    sides = at, sizes[:, 0], at + sizes[:, 0], sizes[:, 1]
    for edits in (1, 2, 4):
        assert line_dedup.edit_distances(data, *sides, edits).tolist() == [min(edits + 1, w) for w in want]
    most = np.array([rng.choice([1, 4, 6, 31, 40]) for _ in pairs])
    got = line_dedup.word_distances(data, *sides, most)
    assert [min(g, m + 1) for g, m in zip(got.tolist(), most.tolist())] == [min(w, m + 1) for w, m in zip(want, most.tolist())]


def test_same_lines_by_bytes_or_words():
    import re

    import pyarrow as pa

    rng, pairs = random.Random(6), []
    pieces = [*WORDS[:12], "\u4e2d", "\u4e2d\u6587", "\u00e9t\u00e9", "\t", " ", "a"]
    for _ in range(600):
        a = "".join(rng.choice(pieces) + rng.choice(["", " "]) for _ in range(rng.choice([6, 12, 25, 60, 400]))).encode()
        b = bytearray(a)
        for _ in range(rng.choice([1, 2, 2, 3, 9])):
            i = rng.randrange(len(b))
            b[i : i + rng.randrange(3)] = bytes(rng.choices(b" a\xe4\xc3", k=rng.randrange(3)))
        pairs.append((a, bytes(b)))

    def near(a, b):
        if line_dedup.long_distance(list(a), list(b)) <= line_dedup.EDITS:
            return True
        x, y = (re.findall(rb"[\xe0-\xff][^\s\xe0-\xff]*|[^\s\xe0-\xff]+", t) for t in (a, b))
        limit = min(len(x), len(y)) // line_dedup.SHARE
        return limit > 0 and line_dedup.long_distance(x, y) <= limit

    want = [near(a, b) for a, b in pairs]
    assert 150 < sum(want) < 450
    assert line_dedup.same_lines(*(pa.array(x, pa.binary()) for x in zip(*pairs))).tolist() == want


def test_verifying_long_lines_looks_at_what_differs():
    import pyarrow as pa

    lines = [prose(i, 6000) for i in range(60)]
    changed = [f"{x[:9000]} changed {x[9000:]}" for x in lines]
    began = time.process_time()
    assert line_dedup.same_lines(*(pa.array([t.encode() for t in x]) for x in (lines, changed))).all()
    assert time.process_time() - began < 2


def same_line(a, b):
    """The rule, on bytes and words."""
    if a == b or min(len(a), len(b)) < line_dedup.MIN_BYTES:
        return a == b
    if abs(len(a) - len(b)) <= line_dedup.EDITS and line_dedup.long_distance(list(a), list(b)) <= line_dedup.EDITS:
        return True
    x, y = a.split(), b.split()  # no code points of three bytes here
    return abs(len(x) - len(y)) <= min(len(x), len(y)) // line_dedup.SHARE and line_dedup.long_distance(x, y) <= min(len(x), len(y)) // line_dedup.SHARE


def brute_lines(rows):
    """(doc_id, text, removed places) of each row, by comparing all lines with all;
    rows of one doc_id that differ in text have no line of one class in common here."""
    lines = [(i is None, i or 0, n, j, x.encode()) for n, (i, t) in enumerate(rows) if t is not None for j, x in enumerate(t.split("\n"))]
    lines = [x for x in lines if x[4].strip(b" \t\n\x0b\x0c\r")]
    groups = collections.defaultdict(list)
    for x, c in zip(lines, linked(lines, lambda x, y: same_line(x[4], y[4]))):
        groups[c].append(x)
    gone = collections.defaultdict(list)
    for g in groups.values():
        for x in sorted(g)[1:]:
            gone[x[2]].append(x[3])
    return collections.Counter((i, len(t.split("\n")) if t is not None else 0, tuple(sorted(gone[n]))) for n, (i, t) in enumerate(rows))


def test_line_dedup_matches_brute_force(spark, odd, empty):
    rng, rows = random.Random(7), []
    lines = [prose(100 + i, rng.randint(3, 9)) for i in range(25)] + ["short", "", "  \t", "same " * 8]
    for i in range(60):
        own = []
        for _ in range(rng.randint(0, 6)):
            x = list(rng.choice(lines))
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                at = rng.randrange(len(x) + 1)
                x[at : at + rng.randint(0, 1)] = rng.choice(["", "q", "é"])
            own.append("".join(x))
        rows.append((i, "\n".join(own)))

    def got(df):
        return collections.Counter((r["doc_id"], r["n_lines"], tuple(r["removed"])) for r in line_dedup.summarize(df).collect())

    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(df) == brute_lines(rows)
    plain = [(r[0], r[1]) for r in odd_rows()]
    assert got(odd) == brute_lines(plain)
    assert line_dedup.summarize(empty).count() == 0


def test_line_dedup_of_repeated_rows(spark):
    long = "a line that is long enough to count"
    rows = [(1, long, "x"), (1, long, "y"), (None, long, "x"), (None, "zzz", "x"), (2, long + "\n\nzzz", "x"), (1, None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, k string")
    got = collections.Counter((r["doc_id"], r["n_lines"], r["n_removed"]) for r in line_dedup.summarize(df).collect())
    assert got == collections.Counter([(1, 1, 0), (1, 1, 1), (None, 1, 1), (None, 1, 1), (2, 3, 1), (1, 0, 0)])
    kept = line_dedup.dedup(df).collect()
    assert collections.Counter((r["doc_id"], r["text"]) for r in kept) == collections.Counter([(1, long), (1, ""), (None, ""), (None, ""), (2, "\nzzz"), (1, None)])
    assert sorted(r["k"] for r in kept) == ["x"] * 5 + ["y"]


@pytest.mark.parametrize("chinese", [False, True])
def test_line_dedup_threshold_grows_with_length(spark, odd, chinese):
    """Word edits up to a tenth of the shorter line's words, against all pairs."""
    rng, rows, lines = random.Random(11), [], []
    seeds = [[chr(rng.randrange(0x4E00, 0x9000)) for _ in range(n)] if chinese else prose(300 + n, n).split() for n in (9, 10, 11, 12, 15, 21, 22, 31, 39, 40, 44, 60, 83, 120, 360)]
    for s in seeds:
        for _ in range(9):
            x = list(s)
            for _ in range(rng.randint(0, len(s) // 10 + 1)):
                at = rng.randrange(len(x))
                x[at : at + rng.randint(0, 1)] = rng.choice([[], [rng.choice("甲乙丙丁") if chinese else rng.choice(["changed", "words", "zz", "overlong"])]])
            lines.append(x)
    rows = [(i, ("" if chinese else " ").join(x)) for i, x in enumerate(lines)]

    def same(x, y):
        a, b, small = rows[x][1].encode(), rows[y][1].encode(), min(len(lines[x]), len(lines[y]))
        if a == b or min(len(a), len(b)) < line_dedup.MIN_BYTES:
            return a == b
        if line_dedup.long_distance(list(a), list(b)) <= line_dedup.EDITS:
            return True
        return line_dedup.long_distance(lines[x], lines[y]) <= small // line_dedup.SHARE

    of = linked(list(range(len(rows))), same)
    want = sorted(i for i, c in enumerate(of) if of.index(c) != i)
    got = line_dedup.summarize(spark.createDataFrame(rows, "doc_id long, text string")).where("n_removed > 0").collect()
    assert sorted(r["doc_id"] for r in got) == want and len(want) > 50
    found = {r["doc_id"]: r for r in line_dedup.summarize(odd.where("doc_id is not null")).collect()}
    assert found[3]["removed"] == [0]  # one word of 120 replaced


def test_line_dedup_runs_and_long_distances():
    for band, (least, gram, window) in enumerate(line_dedup.BANDS[:20]):
        most = line_dedup.BANDS[band + 1][0]
        assert all(line_dedup.least_run(n) >= gram + window - 1 for n in range(least, min(most, least + 3000)))
        assert least * 11 <= most * 10  # a shorter partner is at most one band below
    rng = random.Random(5)
    for _ in range(200):
        a, b = ([rng.choice("abc") for _ in range(rng.randint(1, 30))] for _ in "ab")
        assert line_dedup.long_distance(a, b) == distance(a, b)


def test_all_lines_of_a_key_have_one_hub(spark, monkeypatch):
    """Rare and common keys, with common ones cut short in the map task, over small batches."""
    monkeypatch.setattr(line_dedup, "OFTEN", 3)
    rng, nodes = np.random.default_rng(29), {}
    rows = []
    for _ in range(6):  # pieces
        key = 16 * rng.choice(np.array([8, 9, 10, 11, 12, 13, *range(100, 400)], np.uint64), 300, p=np.array([0.1] * 5 + [0.02] + [0.48 / 300] * 300))
        node = rng.integers(0, 2**62, 300, dtype=np.uint64)
        indexed = (rng.random(300) < 0.4) & (key != 192)
        for k, n, i in zip(key.tolist(), node.tolist(), indexed.tolist()):
            nodes.setdefault(k, []).append((n, i))
        rows += [tuple(map(int, r)) for r in zip(*line_dedup._key_rows(key, node, indexed))]
    assert len([1 for v, _ in rows if v & line_dedup.KIND == line_dedup.MEMBER]) > 300
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        found = collections.defaultdict(set)
        for r in line_dedup._hubs(spark.createDataFrame(rows, "key long, node long")).collect():
            found[r["node"]].add(r["hub"])
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for own in nodes.values():
        if len(own) > 1 and any(i for _, i in own):
            common_hubs = set.intersection(*(found[n] for n, _ in own))
            assert common_hubs & {n for n, i in own if i}
    allowed = {n: set().union(*({x for x, i in own if i} for own in nodes.values() if any(n == x for x, _ in own))) for n in found}
    assert all(found[n] <= allowed[n] for n in found) and not any(found[n] for n, _ in nodes[192])


def test_rows_of_keys_are_packed_by_bucket(spark, monkeypatch):
    """Few rows are shuffled, over many buckets and gatherings; the hubs are those of single rows."""
    monkeypatch.setattr(line_dedup, "GATHER", 1500)
    monkeypatch.setattr(line_dedup, "PACK", 40)
    rng = random.Random(31)
    lines = [" ".join(rng.choices(WORDS, k=rng.choice((6, 12, 30, 60)))) for _ in range(300)]
    lines += [x.replace(x.split()[1], "changed", 1) for x in lines[:100]]
    data = np.frombuffer("\n".join(lines).encode(), np.uint8)
    prefix = common.prefix_hash(data)
    _, _, start, end = line_dedup.lines_of(data, np.array([0, len(data)]))
    node = line_dedup.line_nodes(data, prefix, start, end)[0]
    words, first, last = line_dedup.line_words(data, prefix, start, end)
    few = np.flatnonzero(last - first <= line_dedup.BYTE_WORDS)
    at, *of_bytes = line_dedup.keys(prefix, start[few], end[few])
    line, key, indexed = map(np.concatenate, zip((few[at], *of_bytes), line_dedup.word_keys(words, first, last)))
    key = key & ~common.U(line_dedup.KIND | line_dedup.WORD) | np.where(np.arange(len(key)) < len(at), common.U(0), common.U(line_dedup.WORD))
    want = collections.defaultdict(list)
    for k, n, i in zip(key.tolist(), node[line].view(np.int64).tolist(), indexed.tolist()):
        want[k].append((n, i))
    texts = spark.createDataFrame([("\n".join(lines[i : i + 50]),) for i in range(0, len(lines), 50)], "text string").coalesce(1)
    keyed = line_dedup._key_table(texts, 7).cache()
    assert {r["bucket"] for r in keyed.collect()} == set(range(7))
    assert sum(len(r["rows"]) for r in keyed.collect()) >= 16 * len(key) and 10 * keyed.count() < len(key)
    found = collections.defaultdict(set)
    for r in line_dedup._hubs(keyed, 3).collect():
        found[r["node"]].add(r["hub"])
    keyed.unpersist()
    for own in want.values():
        if len({n for n, _ in own}) > 1 and any(i for _, i in own):
            assert set.intersection(*(found[n] for n, _ in own)) & {n for n, i in own if i}
    allowed = collections.defaultdict(set)
    for own in want.values():
        for n, _ in own:
            allowed[n] |= {x for x, i in own if i}
    assert found and all(hubs <= allowed[n] for n, hubs in found.items())


def test_words_are_numbered_in_their_own_line():
    import pyarrow as pa

    letters = [c.encode() for c in "abcdefghijklmnopqrstuvwxyz"]
    lines = [b" ".join(letters)] * 300 + [b"a a b"]
    data, at = common.utf8(pa.array(lines, pa.binary()))
    words, first, last = line_dedup.line_words(data, common.prefix_hash(data), at[:-1], at[1:])
    got = line_dedup.nth_words(words, last - first)
    assert all(np.array_equal(got[26 * i : 26 * i + 26], got[:26]) for i in range(300))
    assert len(set(got[-3:].tolist())) == 3 and len(set(got[-3:].tolist()) & set(got[:26].tolist())) == 2


def test_links_across_classes_look_at_these_classes_only(spark, monkeypatch):
    known = spark.createDataFrame([(n, n // 10 * 10) for n in range(10, 60)], "node long, component long")
    more = spark.createDataFrame([(13, 27), (26, 41), (3, 4), (4, 55)], "a long, b long")
    sent, work = [], line_dedup.components
    monkeypatch.setattr(line_dedup, "components", lambda edges: sent.append(edges.collect()) or work(edges))
    got = {r["node"]: r["component"] for r in line_dedup._joined(known, more).collect()}
    want = {n: 10 if n // 10 in (1, 2, 4) else 30 if n // 10 == 3 else 3 for n in range(10, 60)} | {3: 3, 4: 3}
    assert got == want and sorted(tuple(r) for r in sent[0]) == [(3, 4), (4, 50), (10, 20), (20, 40)]


def test_lines_that_are_the_same_pass_the_sketches():
    """Lines within the allowed word or byte edits, of few and often repeated words."""
    rng = random.Random(17)

    def shape(line):
        data = np.frombuffer(line.encode(), np.uint8)
        at = np.array([0, len(data)])
        words, first, last = line_dedup.line_words(data, line_dedup.prefix_hash(data), at[:-1], at[1:])
        count = last - first
        width = line_dedup.widths(count, 8, 2)
        return int(count[0]), line_dedup.parity_sketches(line_dedup.nth_words(words, count), count, width)

    passed = total = 0
    for _ in range(800):
        n = rng.choice([10, 12, 19, 20, 41, 80, 160, 400])
        words = [rng.choice(["Shed", "Or", "x", "é1", "甲乙"]) for _ in range(n)] if rng.random() < 0.7 else ["Shed"] * n
        other, line = list(words), " ".join(words)
        near = rng.random()
        if near < 0.4:
            for _ in range(rng.randint(0, max(0, (n - n // 10) // line_dedup.SHARE))):
                at = rng.randrange(len(other))
                other[at : at + rng.randint(0, 1)] = rng.choice([[], ["Or"], ["new"]])
            changed = " ".join(other)
        elif near < 0.8:
            x = list(line)
            for _ in range(2):
                at = rng.randrange(len(x))
                x[at : at + rng.randint(0, 1)] = rng.choice(["", "q", " "])
            changed = "".join(x)
        else:
            changed = " ".join(rng.choice(["Then", "Thin", "In"]) for _ in range(n))
        (m, a), (k, b) = shape(line), shape(changed)
        least = min(len(a), len(b))
        apart = np.bitwise_count(blocks.folded(a, least) ^ blocks.folded(b, least)).sum(keepdims=True).astype(np.int64)
        may = bool(line_dedup.may_link(apart, np.array([m]), np.array([k]))[0])
        same = line_dedup.long_distance(list(line.encode()), list(changed.encode())) <= 2 if near >= 0.4 and near < 0.8 else near < 0.4 and "甲" not in line
        if same:
            limit = min(len(line.split()), len(changed.split())) // line_dedup.SHARE
            assert may or line_dedup.long_distance(line.split(), changed.split()) > limit and near < 0.4
        if near >= 0.8:
            total, passed = total + 1, passed + may
    assert passed == 0 and total > 50


def test_line_dedup_of_lines_with_one_repeated_word(spark):
    rng, rows = random.Random(19), []
    for word in ("Shed", "Thernthe", "Or", "Onwher"):
        for n in (40, 300, 305, 420):
            x = [word] * n
            x[rng.randrange(n)] = "other"
            rows.append((len(rows), " ".join(x)))
    got = line_dedup.summarize(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = brute_lines(rows)
    assert collections.Counter((r["doc_id"], r["n_lines"], tuple(r["removed"])) for r in got) == want and sum(len(k[2]) for k in want) >= 4


def test_line_dedup_settles_alike_lines_inside_blocks(spark, monkeypatch):
    rng, start, rest = random.Random(5), WORDS[:20], WORDS[20:60]
    lines = [" ".join(start + rng.sample(rest, len(rest))) for _ in range(40)]  # alike sketches, far apart
    lines += [x.replace(WORDS[3], "changed", 1) for x in lines[:10]]
    made, cut = {}, line_dedup.cut
    monkeypatch.setattr(line_dedup, "cut", lambda df, name, *a: (out := cut(df, name, *a), made.update({name: made.get(name, 0) + out.count()}))[0])
    got = line_dedup.summarize(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")).where("n_removed > 0")
    assert sorted(r["doc_id"] for r in got.collect()) == list(range(40, 50))
    assert made.get("pairs", 0) + made["links"] <= len(lines)


def test_rows_of_small_groups_meet_once(spark, monkeypatch):
    """Nodes of a small group without a large component are sent to one block, once."""
    rng, sent = random.Random(4), []
    nodes = [(hub, 100 * hub + i, 100 * hub + i // k) for hub, k in ((1, 1), (2, 2)) for i in range(40)]
    placed = spark.createDataFrame(nodes, "hub long, node long, c long")
    facts = spark.createDataFrame([(node, 8, [rng.getrandbits(8), 0]) for _, node, _ in nodes], "node long, m long, s array<long>")
    kind, deal = type(placed), type(placed).repartition
    monkeypatch.setattr(kind, "repartition", lambda self, *a: sent.append(self) or deal(self, *a))
    got = blocks.across(placed, facts, line_dedup.near_sizes, lambda apart, m, n: apart <= 64)
    assert {tuple(r) for r in got.collect()} == {(a, b) for h, a, c in nodes for g, b, d in nodes if h == g and a < b and c != d}
    assert sent[0].count() == len(nodes)


def test_cut_drops_the_shuffles_of_its_write(spark):
    tracker = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker()
    before = tracker.shuffleStatuses().size()
    out = common.cut(spark.range(1000).repartition(5, "id").groupBy("id").count(), "x")
    for _ in range(100):
        if tracker.shuffleStatuses().size() <= before:
            break
        time.sleep(0.1)
    assert tracker.shuffleStatuses().size() <= before and out.count() == 1000


def test_cut_gives_native_memory_of_the_driver_back(spark, monkeypatch):
    trimmed, trim = [], common.trim_driver
    monkeypatch.setattr(common, "trim_driver", lambda s: trimmed.append(trim(s)))
    assert common.cut(spark.range(10), "x").count() == 10
    assert len(trimmed) == 1 and trimmed[0] in (True, False)


def test_spanning_links_against_brute_force():
    rng = np.random.default_rng(3)
    for n in (2, 12, 60):
        c = rng.integers(0, n, n)
        u, v = (x.ravel() for x in np.triu_indices(n, 1))
        pick = rng.random(len(u)) < 0.5
        u, v = u[pick], v[pick]
        good = {(a, b) for a, b in zip(u.tolist(), v.tolist()) if rng.random() < 2 / n}
        a, b = blocks.spanning(u, v, rng.integers(0, 5, len(u)), c, lambda x, y: np.array([(i, j) in good for i, j in zip(x.tolist(), y.tolist())], bool))
        links = set(zip(a.tolist(), b.tolist()))
        assert links <= good and len(links) < max(2, len(np.unique(c)))

        def classes(pairs):
            label = c.copy()
            for _ in range(n):
                for i, j in pairs:
                    label[label == max(label[i], label[j])] = min(label[i], label[j])
            return label.tolist()

        assert classes(links) == classes(good)


def test_line_dedup_applies(spark):
    rows = [(1, "a line that is long enough to count\nb"), (2, "a line that is long enough to cou\nb\n\nc")]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: rows[0][1], 2: "\nc"}


# --------------------------------------------------------------- 4 Jaccard join
def brute_components(rows):
    sets = [grams(t) for _, t in rows]

    def same(i, j):
        both = len(sets[i] & sets[j])
        return both and 100 * both >= 75 * len(sets[i] | sets[j])

    groups = collections.defaultdict(list)
    of = linked(list(range(len(rows))), same)
    for i, c in enumerate(of):
        groups[c].append(i)
    least = {c: min((rows[i][0] for i in g if rows[i][0] is not None), default=None) for c, g in groups.items()}
    return sorted(((rows[i][0], len(sets[i]), least[of[i]]) for i in range(len(rows))), key=str)


def test_ngram_join_matches_brute_force(spark, odd, empty):
    rng, rows = random.Random(11), []
    for i in range(150):
        if rows and rng.random() < 0.7:
            w = (rng.choice(rows)[1] or "a").split()
            for _ in range(rng.choice([0, 1, 1, 2, 4])):
                at = rng.randrange(len(w) + 1)
                w[at : at + rng.randint(0, 2)] = [rng.choice(WORDS) for _ in range(rng.randint(0, 2))]
            rows.append((i, " ".join(w)))
        else:
            rows.append((i, prose(1000 + i, rng.choice([0, 1, 3, 5, 6, 8, 20, 60, 300]))))
    passage = prose(5000, 40)  # a passage that unlike documents share
    rows += [(200 + i, prose(6000 + i, 15) + " " + passage) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, ngram_join.join(df).collect()), key=str)
    assert got == brute_components(rows)
    plain = [(r[0], r[1]) for r in odd_rows()]
    assert sorted(map(tuple, ngram_join.join(odd).collect()), key=str) == brute_components(plain)
    assert ngram_join.join(empty).count() == 0


def test_sets_that_link_share_a_signature():
    rng = np.random.default_rng(2)
    seen = np.zeros(ngram_join.COUNTERS, np.int64)
    for m in [1, 2, 3, 4, 5, 7, 15, 16, 17, 40, 63, 64, 65, 200, 255, 256, 900]:
        for _ in range(20):
            pool = rng.integers(0, 2**64, 3 * m + 8, dtype=np.uint64)
            a = pool[:m]
            drop = int(rng.integers(0, m // 4 + 1))
            add = int(rng.integers(0, m // 3 + 2))
            b = np.concatenate([a[drop:], pool[m : m + add]])
            both, union = m - drop, m + add
            if not len(b) or 100 * both < 75 * union:
                continue
            sets = [np.unique(a), np.unique(b)]
            owner, sign = ngram_join.signatures(np.concatenate(sets), np.array(list(map(len, sets))), seen)
            assert set(sign[owner == 0].tolist()) & set(sign[owner == 1].tolist()), (m, drop, add)


def test_one_of_each(spark, odd):
    kept = ngram_join.one_of_each(odd)
    assert kept.columns == odd.columns
    ids = collections.Counter(r["doc_id"] for r in kept.collect())
    rows = [(r[0], r[1]) for r in odd_rows()]
    groups = {c for i, n, c in brute_components(rows) if n}
    empty = collections.Counter(i for i, n, _ in brute_components(rows) if not n)
    assert ids == collections.Counter(groups) + empty
    a, near, other = prose(71, 90), prose(71, 90) + " more", prose(72, 90)
    rows = [(3, a, "x"), (5, near, "x"), (5, other, "x"), (None, near, "x"), (None, other + " and", "x"), (None, "alone", "x"), (7, a, "x"), (3, a, "y"), (9, None, "x"), (9, None, "x")]
    kept = ngram_join.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, k string"))
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted([(3, a), (5, other), (None, "alone"), (9, None), (9, None)], key=str)


def test_ngram_join_of_many_unlinked_documents_with_a_passage(spark, monkeypatch):
    """They meet in one signature group; no pair of them leaves it."""
    passage, rng = prose(81, 900), random.Random(82)
    words = [f"w{i}" for i in range(50_000)]
    rows = [(i, " ".join([*rng.choices(words, k=550), passage, *rng.choices(words, k=550)])) for i in range(2000)]
    sizes = {}

    def cut(df, name="cut", folder=None):
        out = common.cut(df, name, folder)
        sizes.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(ngram_join, "cut", cut)
    # signatures by rare content would keep these apart: here all content counts as equally rare
    monkeypatch.setattr(ngram_join, "_shingle_counts", lambda table: np.zeros(ngram_join.COUNTERS, np.int64))
    got = ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).collect()
    assert all(r["component_id"] == r["doc_id"] for r in got) and len(got) == 2000
    assert sizes["placed"][0] >= 2000 and sizes["across"] == [0]


def test_components(spark):
    rng, edges = random.Random(4), []
    for _ in range(120):
        edges.append((rng.randrange(200), rng.randrange(200)))
    edges += [(i, i + 1) for i in range(300, 400)] + [(500, i) for i in range(501, 560)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = sorted({x for e in edges if e[0] != e[1] for x in e})
    at = {x: x for x in nodes}

    def find(x):
        while at[x] != x:
            x = at[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            at[y] = x
    assert got == {x: find(x) for x in nodes}


# --------------------------------------------------------------------- 5 media
@pytest.mark.parametrize("kind", range(5))
def test_png_round_trip(kind):
    rng = np.random.default_rng(kind)
    for rows in (1, 2, 31, 70):
        payload = rng.integers(0, 256, rows * 64, dtype=np.uint8).tobytes()
        data = media.to_png(payload, kind)
        assert media.from_png(data).tobytes() == payload
        for at in (0, 20, len(data) // 2, len(data) - 2):
            damaged = bytearray(data)
            damaged[at] ^= 1
            with pytest.raises(ValueError):
                media.from_png(bytes(damaged))


def test_png_of_mixed_filters_and_chunks():
    image = np.arange(40 * 64, dtype=np.uint32).reshape(40, 64).astype(np.uint8)
    raw = np.zeros((40, 65), np.uint8)
    for i in range(40):
        raw[i, 0] = i % 5
        raw[i, 1:] = media._filtered(image, i % 5)[i]
    body = zlib.compress(raw.tobytes())
    parts = [media._chunk(b"IDAT", body[i : i + 50]) for i in range(0, len(body), 50)]
    head = media._chunk(b"IHDR", (64).to_bytes(4, "big") + (40).to_bytes(4, "big") + bytes([8, 0, 0, 0, 0]))
    assert (media.from_png(b"".join([media.SIGNATURE, head, *parts, media._chunk(b"IEND", b"")])) == image).all()


def test_png_cut_off_anywhere():
    data = media.to_png(bytes(range(256)) * 4)
    for n in range(len(data)):
        with pytest.raises(ValueError):
            media.from_png(data[:n])


def test_cosine_hash_against_the_definition():
    rng = np.random.default_rng(9)
    for rows in (1, 5, 32, 33, 100):
        image = rng.integers(0, 256, (rows, 64), dtype=np.uint8)
        bands = [image[i * rows // 32 : max(i * rows // 32 + 1, (i + 1) * rows // 32)].astype(float) for i in range(32)]
        small = [[b[:, 2 * j : 2 * j + 2].mean() for j in range(32)] for b in bands]
        low = [sum(small[y][x] * math.cos(math.pi / 32 * u * (y + 0.5)) * math.cos(math.pi / 32 * v * (x + 0.5)) for y in range(32) for x in range(32)) for u in range(8) for v in range(8)]
        middle = float(np.median(np.round(low[1:], 6)))
        bits = "".join("1" if round(c, 6) > middle else "0" for c in low)
        assert media.cosine_hash(image) == f"{int(bits, 2):016x}"


@pytest.mark.parametrize("kind", ["int", "short", "string", "date", "decimal(9,2)"])
def test_media_of_other_id_types(odd, kind):
    ids = odd.where("doc_id is not null").selectExpr(f"cast(doc_id as {kind}) doc_id" if kind != "date" else "date_add(date'2020-01-01', cast(doc_id as int)) doc_id", "text")
    got = media.with_features(media.with_media(ids))
    assert got.schema["doc_id"].dataType == ids.schema["doc_id"].dataType
    assert sorted(map(str, (r[0] for r in got.collect()))) == sorted(map(str, (r[0] for r in ids.collect())))


def test_media_columns(odd, empty):
    rows = media.with_features(media.with_media(odd)).collect()
    assert len(rows) == len(odd_rows())
    texts = collections.Counter()
    for i, t, *_ in odd_rows():
        raw = (t or "").encode()
        payload = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        texts[i, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])] += 1
    assert collections.Counter(tuple(r)[:5] for r in rows) == texts
    assert len({(r["payload_sha256"], r["media_sha256"], r["feature"]) for r in rows}) == len({r["payload_sha256"] for r in rows})
    assert media.with_features(media.with_media(empty)).count() == 0


# ----------------------------------------------------------- 6 decontamination
def brute_contained(docs, items):
    out = []
    for d, t in docs:
        w = words_of(t or "")
        for i, s in items:
            g = grams(s)
            n = min(5, len(words_of(s or "")))
            have = {tuple(w[j : j + n]) for j in range(len(w) - n + 1)} if n else set()
            k = len(g & have)
            if g and 100 * k >= 75 * len(g):
                out.append((d, i, len(g), k))
    return sorted(out, key=str)


@pytest.mark.parametrize("limit", [decontaminate.BROADCAST_SHINGLES, 0])
def test_decontamination_matches_brute_force(spark, odd, empty, limit):
    rng = random.Random(13)
    items = [(i, prose(300 + i, n)) for i, n in enumerate([1, 2, 4, 5, 6, 9, 16, 30, 60])] + [(20, None), (21, ""), (22, prose(305, 9)), (23, "One two")]
    docs = [(r[0], r[1]) for r in odd_rows()]
    for i in range(60):
        w = prose(400 + i, rng.choice([0, 10, 200])).split()
        item = (rng.choice(items)[1] or "").split()
        for _ in range(rng.randint(0, 3)):
            if item:
                item[rng.randrange(len(item))] = "zz"
        at = rng.randrange(len(w) + 1)
        docs.append((100 + i, " ".join(w[:at] + item + w[at:]).upper()))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.find_items(d, b, broadcast_shingles=limit)
    assert sorted((tuple(r)[:4] for r in found.collect()), key=str) == brute_contained(docs, items)
    assert decontaminate.find_items(empty, b, broadcast_shingles=limit).count() == 0
    assert decontaminate.find_items(d, b.where("false"), broadcast_shingles=limit).count() == 0


def test_decontamination_stage(spark, odd):
    b = spark.createDataFrame([(1, prose(4, 20))], "item_id long, text string")
    kept = decontaminate.clean(odd, b)
    assert kept.columns == odd.columns and kept.count() == len(odd_rows()) - 1
    assert 12 not in {r["doc_id"] for r in kept.collect()}


# ------------------------------------------------------------------------- 7 HTML
ARTICLE = "The court finds that the claim is valid and that it is to be paid by the party in full, as it was agreed."


@pytest.mark.parametrize(
    "source, text",
    [
        (None, ""),
        ("", ""),
        (f"<nav><a href=x>Home</a></nav><article><h1>T &amp; U</h1><p>{ARTICLE}</p><p>Yes.</p></article><footer>by us</footer>", f"T & U\n\n{ARTICLE}\n\nYes."),
        (f"<div class='menu'>one two</div><div><h2>Head</h2><p>{ARTICLE}</p><p>Short.</p><p>{ARTICLE}</p></div><div id=comments><p>{ARTICLE}</p></div>", f"Head\n\n{ARTICLE}\n\nShort.\n\n{ARTICLE}"),
        (f"<article><p>{ARTICLE}<div class='ad banner'>{ARTICLE}</div><form><p>{ARTICLE}</p></form><aside>x</aside><p>a\n  b&nbsp;&#99;<br>d", f"{ARTICLE}\n\na b c d"),
        (f"<script>var t='</p>';</script><style>p{{}}</style><!-- <p>no</p> --><main><p>{ARTICLE}</main>", ARTICLE),
        (f"<article><header><h1>Title</h1></header><p>{ARTICLE}</p></article>", f"Title\n\n{ARTICLE}"),
        (f"<div class=notice>{ARTICLE}<article><p>{ARTICLE}</p></article>", ARTICLE),
        (f"<p>{ARTICLE}</p><p><a href=1>{ARTICLE}</a></p><ul><li><a href=2>x</a></li></ul>", ARTICLE),
        ("<p>unclosed <b>bold", ""),
    ],
)
def test_main_text(source, text):
    assert html_extract.main_text(source) == text


LINKS = "<p><a href=1>one</a> <a href=2>two three</a></p>"
FRENCH_LIKE = "Kelo mara tive sonu brapo delimu kosta verani. " * 6  # in no language with a list


@pytest.mark.parametrize(
    "source, text",
    [
        ("<article><p>Let <math><mi>x</mi></math> be.</p></article>", "Let x be."),
        (f"<div class='page with-sidebar'><p>{ARTICLE}</p></div>", ARTICLE),
        (f"<div class='page-footer'><p>{ARTICLE}</p></div><p>{ARTICLE}</p>", ARTICLE),
        (f"<article><div class='entry-header'><h1>Title</h1></div><p>{ARTICLE}</p></article>", f"Title\n\n{ARTICLE}"),
        (f"<p>{FRENCH_LIKE}</p><p>Sonu.</p><p>{FRENCH_LIKE}</p>{LINKS}", f"{FRENCH_LIKE.strip()}\n\nSonu.\n\n{FRENCH_LIKE.strip()}"),
        # hints: what is long and rich in stop words stays
        (f"<article><p>{ARTICLE}</p><div class=related><p>{ARTICLE} {ARTICLE}</p><p>More of it</p></div></article>", f"{ARTICLE}\n\n{ARTICLE} {ARTICLE}\n\nMore of it"),
        (f"<article><p>{ARTICLE}</p><div class=share><p>{' '.join(['Send'] * 20)}</p></div></article>", ARTICLE),
        # inside the article: a list of links, and the short blocks between and before its links
        (f"<article><p>{ARTICLE}</p><p>Short.</p><h2>Head</h2><p>{ARTICLE}</p><h3>See</h3>{LINKS}<p>and</p>{LINKS}</article>", f"{ARTICLE}\n\nShort.\n\nHead\n\n{ARTICLE}"),
        # an advert inside the article says nothing of its neighbours
        (f"<article><p>{ARTICLE}</p><p>One.</p><p>Two.</p><div class=ad>Buy</div><p>Three.</p></article>", f"{ARTICLE}\n\nOne.\n\nTwo.\n\nThree."),
        # a heading goes with what follows it
        (f"<ul><li><a href=1>menu</a></li></ul><h1>Head</h1><p>{ARTICLE}</p><h2>Links</h2>{LINKS}", f"Head\n\n{ARTICLE}"),
    ],
)
def test_block_rules(source, text):
    assert html_extract.main_text(source) == text


def test_block_rules_find_articles_without_their_tag(spark, sf_dir, monkeypatch):
    """On pages without the article's tag the rules find nearly all of its blocks and
    nothing else; without any one of them they don't."""
    import re

    pages = [r["html"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("html").collect()]

    def share(tags="article"):
        found = wrong = total = 0
        for p in pages:
            want = collections.Counter(inside[p])
            got = collections.Counter(html_extract.main_text(re.sub(f"<(/?)({tags})>", r"<\1div>", p)).split("\n\n")) - collections.Counter([""])
            found, wrong, total = found + (want & got).total(), wrong + (got - want).total(), total + want.total()
        return found / total, wrong / total

    inside = {p: html_extract.main_text(p).split("\n\n") for p in pages}
    full, none = share()
    assert full > 0.85 and none == 0
    first, second = html_extract.first_pass, html_extract.second_pass
    monkeypatch.setattr(html_extract, "second_pass", lambda page, labels: [x == html_extract.GOOD for x in labels])
    assert share()[0] < full - 0.1  # neighbours
    monkeypatch.setattr(html_extract, "second_pass", second)
    menus = share('article|nav|div class="ad"')[1]
    monkeypatch.setattr(html_extract, "LINKED", 2)
    assert share('article|nav|div class="ad"')[1] > menus + 0.1  # link density
    monkeypatch.setattr(html_extract, "LINKED", 0.33)
    monkeypatch.setattr(html_extract, "STOPS", {"none": frozenset()})
    assert share() != (full, none)  # stop words
    monkeypatch.undo()
    monkeypatch.setattr(html_extract, "LONG", 10**9)
    monkeypatch.setattr(html_extract, "STOP_HIGH", 2)
    assert share()[0] < full  # length


def test_main_text_of_long_pages():
    source = "<article>" + f"<p><b>{ARTICLE}<br>" * 3000 + "</x>" * 3000 + "</article>"
    assert html_extract.main_text(source).count(ARTICLE) == 3000
    assert html_extract.main_text("<" * 20000 + "<!--" * 5000) == ""


@pytest.mark.parametrize("signs", ["<" * 300, "3 * 4 = 12; " * 30, "\u2014 " * 200])
def test_long_blocks_without_letters_go_with_others(signs):
    assert html_extract.main_text(f"<div>{signs}</div>") == ""
    assert html_extract.main_text(f"<article><p>{ARTICLE}</p><p>{signs}</p></article>") == f"{ARTICLE}\n\n{' '.join(signs.split())}"
    assert html_extract.main_text(f"<div>{'Ж' * 300}</div>") == "Ж" * 300


@pytest.mark.parametrize("attrs", ['style="overflow:hidden"', 'title="a hidden place"', "data-class='sidebar'", 'data-x="id=menu"', 'class="x" data-hidden', "title='role=banner'"])
def test_html_attributes_are_whole_names(attrs):
    source = f"<article><p {attrs}>{ARTICLE}</p><p>See <a href=/hidden-gems>the gems</a> and more.</p></article>"
    assert html_extract.main_text(source) == f"{ARTICLE}\n\nSee the gems and more."
    for hides in ("hidden", 'hidden=""', "hidden=hidden", f'{attrs}hidden' if attrs[-1] in "\"'" else "x/hidden", 'aria-hidden="true"', "CLASS=sidebar"):
        assert html_extract.main_text(f"<article><p>{ARTICLE}</p><div {hides}>gone</div></article>") == ARTICLE


@pytest.mark.parametrize("tag", html_extract.HIDDEN.split("|"))
def test_html_self_closed_and_unclosed_elements(tag):
    for form in (f'<{tag} width="8"/>', f"<{tag}>", f"<{tag}><{tag}>in</{tag}>", f"<{tag} a=1>in</{tag}>", f"<{tag}><{tag}>in</{tag}>side</{tag}>"):
        assert html_extract.main_text(f"<article><p>one</p>{form}<p>two</p><p>three</p></article>") == "one\n\ntwo\n\nthree"
    assert html_extract.main_text("<article><p>one</p><script>x <p>two</p></article>") == "one"
    assert html_extract.main_text(f"<{tag}>" * 30000) == ""


def test_extract(spark, sf_dir):
    pages = spark.createDataFrame([(1, "u", f"<article>{ARTICLE}</article>", "x"), (1, "u", f"<article>{ARTICLE}</article>", "x"), (None, None, None, None)], "page_id long, url string, html string, text string")
    rows = html_extract.extract(pages).collect()
    assert sorted(map(tuple, rows), key=str) == sorted([(1, "u", ARTICLE, len(ARTICLE))] * 2 + [(None, None, "", 0)], key=str)
    assert html_extract.extract(pages.where("false")).count() == 0
    got = html_extract.op7_html_extract(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/pages.parquet"), "page_id").collect()
    for r in got:  # these pages' articles hold headings and paragraphs only
        inside = r["html"][r["html"].index("<article>") : r["html"].index("</article>")]
        assert r["n_chars"] == len(r["text"]) and r["text"].count("\n\n") == len(html_extract.Page(inside).blocks) - 1


# --------------------------------------------------------------- 8 suffix dedup
def brute_removed(rows):
    texts = [(t or "").encode() for _, t in rows]
    seen = collections.Counter(t[i : i + 200] for t in texts for i in range(len(t) - 199))
    out = []
    for (d, _), t in zip(rows, texts):
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - 199):
            if seen[t[i : i + 200]] > 1:
                gone[i : i + 200] = True
        kept = np.frombuffer(t, np.uint8)[~gone[:-1]].tobytes()
        out.append((d, len(t), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), kept))
    return sorted(out, key=str)


def test_suffix_dedup_matches_brute_force(spark, odd, empty):
    rng = random.Random(17)
    passages = [prose(800 + i, n) for i, n in enumerate([33, 40, 41, 60, 120])]
    rows = [(r[0], r[1]) for r in odd_rows() if r[0] != 11] + [(11, prose(3, 400)), (11, prose(3, 400))]
    for i in range(60):
        rows.append((100 + i, " ".join(x for _ in range(rng.randint(0, 3)) for x in (prose(900 + 10 * i + rng.randrange(9), rng.randint(0, 30)), rng.choice(passages)[rng.randint(0, 20) :]))))
    rows += [(300, "ab" * 300), (301, "z" * 199), (302, "é" * 150), (303, passages[0][:199]), (304, passages[4][7:207])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in suffix_dedup.remove(df).collect()), key=str)
    assert got == brute_removed(rows)
    assert suffix_dedup.remove(empty).count() == 0


def test_repeated_rows_share_their_marks(spark, monkeypatch):
    """Each of n equal rows is told the marks of one of them, not n times as many, and a
    task cuts their spans once."""
    told, compared, spans = [], suffix_dedup._compared, []
    removed = suffix_dedup._removed
    monkeypatch.setattr(suffix_dedup, "_removed", lambda texts, kind: told.append(texts) or removed(texts, kind))
    monkeypatch.setattr(suffix_dedup, "_compared", lambda rows: spans.append(rows) or compared(rows))
    texts = [" ".join(f"{prose(800 + i, 60)} {prose(seed + i, 60)}" for i in range(6)) for seed in (500, 600)]
    rows = [(1, texts[0])] * 24 + [(2, texts[1])]
    got = sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in suffix_dedup.remove(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).collect()), key=str)
    assert got == brute_removed(rows)
    assert told[0].where("size(marks) > size(array_distinct(marks))").count() == 0
    assert 0 < spans[0].count() <= 8 * spans[0].select("k", "a", "fp").distinct().count() < 24 * 8


def test_long_texts_are_cut_without_loss():
    rng = np.random.default_rng(3)
    data = rng.integers(97, 123, 5 * suffix_dedup.CHUNK // 2, dtype=np.uint8)
    offsets = np.array([0, len(data)])
    found = [(lo + shift, hi + shift) for part, at, _, shift in suffix_dedup.text_parts(data, offsets) for lo, hi in zip(*suffix_dedup.ranges(part, at)[3:])]
    assert found[0][0] == 0 and found[-1][1] == len(data) - 200
    assert all(b[0] == a[1] + 1 for a, b in zip(found, found[1:]))


def test_suffix_order():
    rng = random.Random(23)
    text = "".join(rng.choice("ab") for _ in range(400)).encode()
    data = np.frombuffer(text, np.uint8)
    prefix = suffix_dedup.prefix_hash(data)
    starts = np.array(rng.sample(range(400), 137))
    order = suffix_dedup.suffix_order(data, prefix, starts, np.full(len(starts), 400))
    assert [text[s:] for s in starts[order]] == sorted(text[s:] for s in starts)


def test_long_runs_of_one_anchor_are_settled(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HELD_ROWS", 3)
    rows = [(suffix_dedup.SINGLE, 7, fp, i, 0, 5, False) for i, fp in enumerate([1] * 9 + [2] + [3] * 5)] + [(suffix_dedup.SINGLE, 8, 1, 50, 0, 5, False), (suffix_dedup.SINGLE, 9, 1, 51, 0, 5, True)]
    df = spark.createDataFrame(rows, suffix_dedup.RANGE).coalesce(1).sortWithinPartitions("a", "kind", "fp")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        got = suffix_dedup._settled(df).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    marked = {r["k"] for r in got if r["kind"] == suffix_dedup.MARK}
    assert marked == {*range(9), *range(10, 15), 51}
    assert {r["fp"] for r in got if r["kind"] == suffix_dedup.REST and r["a"] == 7} == {1, 2, 3}
    assert not [r for r in got if r["kind"] == suffix_dedup.REST and r["a"] != 7]


# -------------------------------------------------------------------- 9 mixing
def filled(sizes):
    """Targets by repeated sharing of the excess."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    capped, pool = set(), 1.5 * sum(sizes.values())
    while True:
        rest = pool - sum(2 * sizes[s] for s in capped)
        total = sum(weight[s] for s in names if s not in capped)
        target = {s: 2.0 * sizes[s] if s in capped else rest * weight[s] / total for s in names}
        over = {s for s in names if s not in capped and target[s] > 2 * sizes[s]}
        if not over:
            return target
        capped |= over


def test_mix(spark, odd, empty):
    rows = mixing.mix(odd, ["doc_id"]).collect()
    assert len(rows) == len(odd_rows())
    sizes = collections.Counter()
    for _, t, _, s, *_ in odd_rows():
        sizes[s] += len(words_of(t or ""))
    target = filled(sizes)
    by_row = collections.Counter((i, len(words_of(t or "")), sizes[s]) for i, t, _, s, *_ in odd_rows())
    assert collections.Counter((r["doc_id"], r["size"], r["source_size"]) for r in rows) == by_row
    taken = collections.Counter()
    for r in rows:
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source_size"]] += r["taken"]
    for s, n in sizes.items():
        assert any(math.isclose(r["target"], target[s]) for r in rows if r["source_size"] == n)
        assert abs(taken[n] - target[s]) < 1
    again = mixing.mix(odd.repartition(7), ["doc_id"]).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    assert mixing.mix(empty, ["doc_id"]).count() == 0


def test_schedule_is_spread(spark):
    plan = spark.createDataFrame([(0, 500, 0.0, 0.5), (1, 300, 0.5, 0.8), (2, 200, 0.8, 1.0)], "src_no int, quota long, lo double, hi double")
    rows = mixing.schedule(plan, 1000).collect()
    ranks = collections.defaultdict(list)
    for r in sorted(rows, key=lambda r: r["slot"]):
        ranks[r["src_no"]].append(r["rank"])
    assert {s: sorted(x) for s, x in ranks.items()} == {0: list(range(500)), 1: list(range(300)), 2: list(range(200))}
    seen = collections.Counter()
    for i, r in enumerate(sorted((r for r in rows if r["slot"] < 1000), key=lambda r: r["slot"]), 1):
        seen[r["src_no"]] += 1
        assert all(abs(seen[s] - w * i) < 6 for s, w in ((0, 0.5), (1, 0.3), (2, 0.2)))


def test_mixed_rows(spark, odd):
    mixed = mixing.mixed_rows(odd)
    assert mixed.columns == odd.columns
    assert max(collections.Counter(r["doc_id"] for r in mixed.where("doc_id <> 11").collect()).values()) <= 2
    # equal documents of three sources: any stretch of the rows holds them by target
    rows = [(i, prose(i, 20), "abc"[i % 3]) for i in range(900)]
    got = [r["source"] for r in mixing.mixed_rows(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()]
    share = {s: got.count(s) / len(got) for s in "abc"}
    assert len(got) == pytest.approx(1350, abs=4) and got.count("a") == 600
    for at in range(0, len(got) - 200, 100):
        assert all(abs(got[at : at + 200].count(s) / 200 - share[s]) < 0.06 for s in "abc")


def test_mix_of_rows_without_ids(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RUN", 7)
    rows = [(None, prose(i % 5, 3 + i % 4), "a") for i in range(300)] + [(5, "one two", "b")] * 40
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), ["doc_id", "text"]).collect()
    assert collections.Counter((r["doc_id"], r["text"]) for r in got) == collections.Counter((i, t) for i, t, _ in rows)
    for source, n in (("a", 1350), ("b", 80)):
        mine = [r for r in got if (r["doc_id"] is None) == (source == "a")]
        assert {r["source_size"] for r in mine} == {n} and sum(r["taken"] for r in mine) == math.floor(mine[0]["target"])
        assert all(0 <= r["taken"] <= 2 * r["size"] and (r["taken"] > 0) == any(x is not None for x in r["slots"]) for r in mine)


# --------------------------------------------------------------- 10 URL filters
def test_url_filter(spark):
    urls = {
        "http://A.Example.ORG/es/1": ("a.example.org", "/es/1", "example.org/es/", "block"),
        "https://example.org/en/12?x#y": ("example.org", "/en/12", "example.org/en/1", "block"),
        "https://example.org/en/2": ("example.org", "/en/2", "org/", "allow"),
        "https://badexample.org/es/2": ("badexample.org", "/es/2", "org/", "allow"),
        "https://x.com/fr/a": ("x.com", "/fr/a", "com/fr/", "allow"),
        "https://x.com/de/a": ("x.com", "/de/a", "com/de/", "block"),
        "https://x.com/de": ("x.com", "/de", None, "allow"),
        "https://telecom/de/": ("telecom", "/de/", None, "allow"),
        "https://y.net/x.org/es/": ("y.net", "/x.org/es/", None, "allow"),
        "https://ads-1.y.net/": ("ads-1.y.net", "/", None, "block"),
        "https://x.org": ("x.org", "", None, "allow"),
        "https://x.org?a://b.com/de/": ("x.org", "", None, "allow"),
        "no scheme": ("", "", None, "allow"),
        "": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
        "http://" + "a" * 3000 + ".com/de/" + "b" * 3000: ("a" * 3000 + ".com", "/de/" + "b" * 3000, "com/de/", "block"),
        "http://ü.org/ß": ("ü.org", "/ß", "org/", "allow"),
    }
    rows = [(i, u, "clash", "x") for i, u in enumerate(urls)]
    df = spark.createDataFrame(rows + rows[:1], "page_id long, url string, host string, rule string")
    got = collections.Counter(map(tuple, url_filter.judge(df).collect()))
    want = collections.Counter((i, *w) for i, w in enumerate(urls.values()))
    want[(0, *urls[rows[0][1]])] += 1
    assert got == want
    assert url_filter.judge(df.where("false")).count() == 0


def test_automaton_matches_globs():
    import re

    rng = random.Random(31)
    globs = [".a*b/x*", ".*.b/*", ".ab/*b*", ".b/a", ".*a/*/b"] * 9  # several words of bits
    automaton = url_filter.Automaton.build([g.encode() for g in globs])
    regex = [re.compile("".join("[^/]*" if c == "*" and "/" not in g[:i] else ".*" if c == "*" else re.escape(c) for i, c in enumerate(g)), re.S) for g in globs]
    texts = ["." + "".join(rng.choice("ab./x") for _ in range(rng.randint(0, 10))) for _ in range(500)]
    data, sizes = "".join(texts).encode(), list(map(len, texts))
    got = automaton.run(np.frombuffer(data, np.uint8), np.cumsum([0, *sizes]))
    assert (got == np.array([[bool(r.fullmatch(t)) for r in regex] for t in texts])).all()
