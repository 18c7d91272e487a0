"""Pipelines of the four segmentation methods and the baseline.

Each takes documents (doc_id, summary array<string>, sents array<string>) and
runs: segment the source, give each segment its document's summary, match target
sentences, generate, combine, score.  One lazy plan; training is outside, on the
tables that ``write_stage`` leaves.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brevis.operators import ml, rouge, segment
from brevis.plans.config import operator
from brevis.sources.writers import write_cached


@operator("SourceSegmentor")
def by_sentences(docs: DataFrame, budget: int, prompt: str = "") -> DataFrame:
    return segment.pack_sentences(docs, "sents", budget, prompt=prompt)


@operator("MultiStructureSourceSegmentor")
def by_paragraphs(docs: DataFrame, budget: int, prompt: str = "") -> DataFrame:
    return segment.pack_paragraphs(docs, "sents", budget, prompt=prompt)


def _by_spans(docs: DataFrame, budget: int, prompt: str, similarity: Callable[[list[str]], list[float]]) -> DataFrame:
    spans = segment.split_min_similarity(docs, "sents", budget, similarity=similarity)
    return spans.withColumn("segments", segment.prompted(segment.span_texts(F.col("sents"), F.col("spans")), prompt)).drop("spans")


@operator("RougeSourceSimilaritySegmentor")
def by_similarity(docs: DataFrame, budget: int, prompt: str = "") -> DataFrame:
    return _by_spans(docs, budget, prompt, segment.adjacent_rouge1_f)


def embedding_similarity(items: list[str]) -> list[float]:
    """The default embedding similarity: greedy cosine F of hashed token vectors."""
    import numpy as np

    from brevis.operators.similarity import best_f

    units, out = ml.known_units(), []
    before, even = None, None
    for s in items:
        now = units.of(rouge.tokens(s))
        share = np.full(len(now), 1 / len(now))
        if before is not None:
            f = best_f(before @ now.T, even, share)
            out.append(round(f, 6) if f == f else 0.0)
        before, even = now, share
    return out


@operator("BertSourceSimilaritySegmentor")
def by_embedding(docs: DataFrame, budget: int, prompt: str = "") -> DataFrame:
    return _by_spans(docs, budget, prompt, embedding_similarity)


@operator("ClassicSegmentor")
def whole(docs: DataFrame, budget: int, prompt: str = "") -> DataFrame:
    return docs.withColumn("segments", segment.prompted(F.filter(F.array(F.array_join("sents", " ")), lambda s: F.trim(s) != ""), prompt))


@dataclass(frozen=True)
class Preset:
    segmentor: Callable[[DataFrame, int], DataFrame]
    reserve: int  # tokens of the model's input kept for prompts and marks
    input_tokens: int = 512

    @property
    def budget(self) -> int:
        return self.input_tokens - self.reserve


PRESETS = {
    "summ.n": Preset(by_sentences, 34),
    "paragraph.level": Preset(by_paragraphs, 20),
    "paragraph.rouge": Preset(by_similarity, 20),
    "paragraph.bert": Preset(by_embedding, 20),
    "classic": Preset(whole, 0),
}


def run(docs: DataFrame, method: str, generate: Callable[[Column], Column] = ml.lead, stages: int = 1, prompt: str = "", cache: str | None = None) -> dict[str, DataFrame]:
    """Every stage's table by name; later stages cut the combined text again.

    ``pairs`` has a row a document: its last combined text ``hypo``, n_segments and n_picks
    of the last stage and its scores, from one pass over the segments.  ``prompt`` begins
    each segment that is generated from.  With a folder ``cache``,
    each stage's segments are kept there and used again while their input is the same."""
    preset = PRESETS[method]
    out, now = {}, docs
    for stage in range(stages):
        given = now.select("doc_id", "summary", "sents")
        cut = (preset.segmentor if stage == 0 else by_sentences)(given, preset.budget, prompt)
        if cache is not None:
            cut = write_cached(cut, given, f"{cache}/{method}/{preset.budget}/segments{stage}")
        segments = segment.explode_segments(cut, ["doc_id", "summary"])
        matched = segments.withColumn("_m", rouge.greedy_match("source", "summary")).select("doc_id", "summary", "seg_ord", "source", "_m.target", "_m.picks")
        hypos = matched.withColumn("hypo", generate(F.col("source")))
        combined = segment.combine(hypos, docs, ["doc_id"], "seg_ord", "hypo", n_segments=F.count("*"), n_picks=F.sum(F.size("picks")))
        out |= {f"segments{stage}": segments, f"matched{stage}": matched, f"hypos{stage}": hypos, f"combined{stage}": combined.select("doc_id", "hypo")}
        now = combined.join(docs.select("doc_id", "summary"), "doc_id").withColumn("sents", F.split(F.regexp_replace("hypo", "^<s> ", ""), " </s> "))
    reference = docs.select("doc_id", F.array_join("summary", "\n").alias("reference"))
    pairs = rouge.pair_scores(now.select("doc_id", "hypo", "n_segments", "n_picks", F.array_join("sents", "\n").alias("hypothesis")).join(reference, "doc_id"), "hypothesis", "reference")
    return out | {"pairs": pairs, "scores": rouge.corpus_scores(pairs)}


def splits_of(mode: str, finegrained: bool = False) -> tuple[str, ...]:
    """The splits that a run reads: all when it trains, only ``test`` otherwise."""
    return ("test",) if finegrained or mode == "test" else ("train", "val", "test")
