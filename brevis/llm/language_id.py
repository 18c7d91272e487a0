"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built over labelled text.  A new text is
parsed greedily into the longest phrases that occur in that text, across words:
from each phrase start the automaton is walked as far as it goes; a byte that the
language hasn't is a phrase of its own.  The language that needs the fewest
phrases a character, weighed by log2 of its training length (the bits of a
phrase's address), wins; ties go to the first language by code point.

Texts are lower-cased and every run of characters that are neither letters nor
marks (Unicode categories L and M) is one space; a space stands at both ends.
Whole texts are read, as UTF-8 bytes, in stretches of ``STRETCH`` bytes that each
begin a phrase, so that thousands of stretches walk the automata of all languages
together, a byte a step, over one table of transitions.

Training takes a bounded sample: about ``SAMPLE_DOCS`` labelled rows of each
language, drawn by a hash of doc_id and text (equal rows once), ``SAMPLE_CHARS``
characters of each and ``TRAIN_BYTES`` of each language.  Only rows with a text
and a label whose crc32(doc_id as text) mod 3 is not 1 are labelled rows here.  A
language's automaton is built where its rows meet; the driver gets its
transitions only, about 400 kB a language, and sends them to the executors.

Defined results: ``und`` with score 0 for a text that is null or has no letter,
or if nothing can be learned; a null doc_id counts as ''; repeated rows are
judged alike; an empty table gives an empty result; other columns are ignored.
``score`` is 1 - best / second best entropy (1 with one language).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from copy import copy

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, pieces, release_memory, utf8

SAMPLE_DOCS, SAMPLE_CHARS, TRAIN_BYTES = 160, 4000, 30_000
STRETCH = 2048
#: Bytes that walk together: a worker needs about 25 times as much beside its batch.
TOGETHER = 1 << 20
#: More phrases a character than this: the text is in none of the languages.
MOST_PHRASES = 0.6
UNKNOWN = "und"


def normalised(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Lower-case words between single spaces, and whether a text has a letter."""
    texts = pc.fill_null(texts, "")
    words = pc.replace_substring_regex(pc.utf8_lower(texts), r"[^\p{L}\p{M}]+", " ")
    has = pc.match_substring_regex(texts, r"\p{L}").to_numpy(zero_copy_only=False)
    return pc.binary_join_element_wise("", pc.ascii_trim(words, " "), "", " "), has


def suffix_automaton(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The transitions of the automaton of all substrings of ``text``, as sorted
    keys state * 256 + byte and the states they lead to; state 0 is the start."""
    moves: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text:
        new = len(moves)
        moves.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(moves)
                moves.append(dict(moves[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    flat = sorted((state * 256 + c, to) for state, out in enumerate(moves) for c, to in out.items())
    keys, to = zip(*flat) if flat else ((), ())
    return np.array(keys, np.int64), np.array(to, np.int32)


class Model:
    """Languages and their automata, given as {language: (training bytes, keys, to)}."""

    def __init__(self, automata: dict[str, tuple[int, np.ndarray, np.ndarray]]):
        self.languages = sorted(automata)
        self.bits = np.array([math.log2(max(2, automata[k][0])) for k in self.languages])
        self.automata = [automata[k][1:] for k in self.languages]
        self._table = None

    def __getstate__(self):
        return self.__dict__ | {"_table": None}

    def table(self) -> tuple[np.ndarray, ...]:
        """Class of each byte; places of the next states for place + class, where
        each language's rows follow each other and a start's own place says that
        there is no transition; the languages' starts; and what follows the starts."""
        if self._table is None:
            known = np.unique(np.concatenate([keys & 255 for keys, _ in self.automata]))
            classes = np.zeros(256, np.uint8)  # bytes of UTF-8 have fewer values
            classes[known] = np.arange(1, len(known) + 1)
            width = len(known) + 1
            states = np.array([int(to.max(initial=0)) + 1 for _, to in self.automata])
            start = ((np.cumsum(states) - states) * width).astype(np.int64)
            moves = np.empty(int(states.sum()) * width, np.int32)
            for at, n, (keys, to) in zip(start, states, self.automata):
                own = moves[at : at + n * width]
                own[:] = at
                own[(keys >> 8) * width + classes[keys & 255]] = at + to.astype(np.int64) * width
            first = moves[start[:, None] + np.arange(width)]
            self._table = classes, moves, start.astype(np.int32), first
        return self._table

    def phrases(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """(languages, texts): phrases of each text."""
        classes, moves, start, first = self.table()
        size = np.diff(offsets)
        parts = -(-size // STRETCH)
        owner = np.repeat(np.arange(len(size)), parts)
        begin = np.repeat(offsets[:-1], parts) + (np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)) * STRETCH
        length = np.minimum(begin + STRETCH, offsets[1:][owner]) - begin
        order = np.argsort(-length, kind="stable")
        owner, begin, length = owner[order], begin[order], length[order]
        codes, start = classes[data], start[:, None]
        state = np.repeat(start, len(owner), 1)
        found = np.zeros(state.shape, np.int32)
        live = len(owner)
        for t in range(int(length[0]) if live else 0):
            while length[live - 1] <= t:
                live -= 1
            c = codes[begin[:live] + t]
            now = state[:, :live]
            to = np.take(moves, now + c)
            none = to == start
            found[:, :live] += none | (now == start)  # this byte begins a phrase
            np.copyto(to, np.take(first, c, 1), where=none)
            state[:, :live] = to
        return np.stack([np.bincount(owner, f, len(size)) for f in found])

    def judge_all(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score, and phrases a character of the best language, of each text."""
        words, has = normalised(texts)
        n = len(words)
        lang, score, rate = [UNKNOWN] * n, np.zeros(n), np.ones(n)
        known = np.flatnonzero(has)
        if not self.languages or not len(known):
            return lang, score, rate
        words = words.take(pa.array(known))
        chars = pc.utf8_length(words).to_numpy(zero_copy_only=False)
        data, offsets = utf8(words)
        found = np.concatenate([self.phrases(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in pieces(offsets, TOGETHER)], 1)
        costs = found * self.bits[:, None] / chars
        best = costs.argmin(0)
        at = np.arange(len(known))
        least = costs[best, at]
        costs[best, at] = np.inf
        second = costs.min(0)
        score[known] = np.clip(np.where(np.isfinite(second), 1 - least / second, 1.0), 0, 1)
        rate[known] = found[best, at] / chars
        for i, k in zip(known.tolist(), best.tolist()):
            lang[i] = self.languages[k]
        return lang, score, rate


def held_out(id_col: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(3)) == 1


def training_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, draw, text): the sample, about ``SAMPLE_DOCS`` rows a language."""
    labelled = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), held_out(id_col).alias("held")).where("lang is not null and text is not null and not held")
    parts = 1 << 30
    limits = labelled.groupBy("lang").agg(F.ceil(F.lit(SAMPLE_DOCS * parts) / F.count("*")).alias("limit"))
    hashed = labelled.select("lang", "text", F.xxhash64(F.lit("sample"), "id", "text").alias("draw"))
    # a row a language, each of which has an automaton anyway: texts stay where they are
    drawn = hashed.join(F.broadcast(limits), "lang").where(F.pmod("draw", F.lit(parts)) < F.col("limit"))
    return drawn.groupBy("lang", "draw").agg(F.min(F.substring("text", 1, SAMPLE_CHARS)).alias("text"))


def training_bytes(rows: pd.DataFrame) -> bytes:
    """One language's rows as the text that its automaton is built over."""
    rows = rows.sort_values(["draw", "text"])
    words, _ = normalised(pa.array(rows["text"], pa.string()))
    text = b"".join(w.encode() for w in words.to_pylist())
    while b"  " in text:
        text = text.replace(b"  ", b" ")
    return text[: text.rfind(b" ", 0, TRAIN_BYTES) + 1] if len(text) > TRAIN_BYTES else text


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    def build(rows: pd.DataFrame) -> pd.DataFrame:
        text = training_bytes(rows)
        keys, to = suffix_automaton(text)
        return pd.DataFrame({"lang": rows["lang"].iloc[:1], "size": [len(text)], "keys": [keys.tobytes()], "to": [to.tobytes()]})

    built = training_texts(docs, id_col, text_col, lang_col).groupBy("lang").applyInPandas(build, "lang string, size long, keys binary, to binary").collect()
    return Model({r["lang"]: (r["size"], np.frombuffer(r["keys"], np.int64), np.frombuffer(r["to"], np.int32)) for r in built if r["size"] > 1})


def judged(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` columns, lang_pred, score, phrase_rate for every row of ``docs``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    # texts make up the rows: they go to the workers once, kept or not
    columns = [*keep, *({text_col} - set(keep))]
    at = columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        model = copy(sent.value)  # its table of transitions is a task's own, and ends with it
        try:
            for batch in batches:
                _, offsets = utf8(batch.column(at))
                for a, b in pieces(offsets, TOGETHER):
                    part = batch.slice(a, b - a)
                    found = [pa.array(x, kind) for x, kind in zip(model.judge_all(part.column(at)), (pa.string(), pa.float64(), pa.float64()))]
                    yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], *found], names=[*(f"k{i}" for i in range(len(keep))), "lang_pred", "score", "phrase_rate"])
        finally:
            batch = part = found = offsets = _ = model = None
            release_memory()

    chosen = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(columns)])
    schema = ", ".join([*(f"k{i} {kind}" for i, (_, kind) in enumerate(chosen.dtypes[: len(keep)])), "lang_pred string, score double, phrase_rate double"])
    out = chosen.mapInArrow(run, schema)
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "lang_pred", "score", "phrase_rate")


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, phrase_rate for every row of ``docs``."""
    out = judged(docs, model or train(docs), ["doc_id"])
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "phrase_rate")


def accepted(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` in a known language: not ``und``, and not in more
    phrases a character than text of any learned language needs."""
    out = judged(docs, train(docs), docs.columns)
    return out.where((F.col("lang_pred") != UNKNOWN) & (F.col("phrase_rate") <= MOST_PHRASES)).select(*docs.columns)


def op1_language_id(spark, sf_dir: str) -> DataFrame:
    return identify(documents(spark, sf_dir))
