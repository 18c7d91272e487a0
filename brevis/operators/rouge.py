"""ROUGE: pair scores, corpus figures, and greedy selection of summary sentences."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brevis.functions import text as T
from brevis.functions.types import MATCH, SCORES

TOKEN = re.compile("[a-z0-9]+")


def tokens(s: str) -> list[str]:
    return TOKEN.findall(s.lower())


def f_measure(p: float, r: float) -> float:
    return 2 * p * r / (p + r) if p + r else 0.0


def counts_f(x: Counter, y: Counter) -> float:
    n, m = x.total(), y.total()
    return 2 * (x & y).total() / (n + m) if n and m else 0.0


def rouge1_f(a: str, b: str) -> float:
    return counts_f(Counter(tokens(a)), Counter(tokens(b)))


def common_grams(a: str, b: str, n: int) -> tuple[int, int, int]:
    """The n-grams that two texts have in common, each as often as in both, and their
    numbers; linear in the texts' length."""
    x, y = ([tuple(t[i : i + n]) for i in range(len(t) - n + 1)] for t in (tokens(a), tokens(b)))
    return (Counter(x) & Counter(y)).total(), len(x), len(y)


def rouge_n(hypothesis: Column, reference: Column, n: int = 1) -> Column:
    """struct<p,r,f> of clipped n-gram counts; 0 where undefined."""

    @F.pandas_udf(SCORES)
    def scores(hypothesis: pd.Series, reference: pd.Series) -> pd.DataFrame:
        out = []
        for a, b in zip(hypothesis, reference):
            both, x, y = common_grams(a or "", b or "", n)
            out.append((both / x if x else 0.0, both / y if y else 0.0, 2.0 * both / (x + y) if x + y else 0.0))
        return pd.DataFrame(out, columns=["p", "r", "f"])

    return scores(hypothesis, reference)


def set_rouge(segment: Column, summary: Column, n: int = 1) -> Column:
    """struct<f,p,r> of distinct n-grams: p over the segment, r over the summary,
    f with 1e-8 in its denominator."""
    def scores(s: Column) -> Column:
        both = F.size(F.array_intersect(s["x"], s["y"]))
        p = F.coalesce(F.try_divide(both, F.size(s["x"])), F.lit(0.0))
        r = F.coalesce(F.try_divide(both, F.size(s["y"])), F.lit(0.0))
        return F.struct((2.0 * p * r / (p + r + 1e-8)).alias("f"), p.alias("p"), r.alias("r"))

    grams = [F.array_distinct(T.ngrams(T.rouge_tokens(c), n)) for c in (segment, summary)]
    return T.let(F.struct(grams[0].alias("x"), grams[1].alias("y")), scores)


def lcs_rows(x: list[str], y: list[str]) -> list[int]:
    """For each prefix of ``x`` a bit vector over ``y`` (Hyyro's): the longest common
    subsequence with the first j tokens of ``y`` is as long as there are zeros among
    the low j bits."""
    at: dict[str, int] = {}
    for j, b in enumerate(y):
        at[b] = at.get(b, 0) | 1 << j
    full = (1 << len(y)) - 1
    rows = [full]
    for a in x:
        v = rows[-1]
        u = v & at.get(a, 0)
        rows.append(((v + u) | (v - u)) & full)
    return rows


def lcs_length(x: list[str], y: list[str]) -> int:
    """Length of the longest common subsequence."""
    return len(y) - lcs_rows(x, y)[-1].bit_count()


def lcs_places(x: list[str], y: list[str]) -> set[int]:
    """Places in ``y`` of one longest common subsequence: from the ends backwards, equal
    tokens are taken, else the prefix of ``x`` is shortened if that costs nothing."""
    rows, i, j, out = lcs_rows(x, y), len(x), len(y), set()

    def level(i: int) -> int:
        return j - (rows[i] & ((1 << j) - 1)).bit_count()

    while i and j:
        if x[i - 1] == y[j - 1]:
            i, j = i - 1, j - 1
            out.add(j)
        elif level(i - 1) == level(i):
            i -= 1
        else:
            j -= 1
    return out


def rouge_lsum_scores(hypothesis: list[str], reference: list[str]) -> tuple[float, float, float]:
    """Union-LCS over sentences: reference tokens that some hypothesis sentence
    shares in order, each hypothesis token used once."""
    h, r = [tokens(s) for s in hypothesis], [tokens(s) for s in reference]
    n, m = sum(map(len, h)), sum(map(len, r))
    if not n or not m:
        return 0.0, 0.0, 0.0
    left_h, left_r = Counter(t for s in h for t in s), Counter(t for s in r for t in s)
    hits = 0
    for s in r:
        for j in sorted(set().union(*(lcs_places(x, s) for x in h))):
            if left_h[s[j]] > 0 and left_r[s[j]] > 0:
                left_h[s[j]] -= 1
                left_r[s[j]] -= 1
                hits += 1
    return hits / n, hits / m, f_measure(hits / n, hits / m)


@F.pandas_udf(SCORES)
def rouge_l(hypothesis: pd.Series, reference: pd.Series) -> pd.DataFrame:
    out = []
    for a, b in zip(hypothesis, reference):
        x, y = tokens(a or ""), tokens(b or "")
        k = lcs_length(x, y)
        p, r = (k / len(x) if x else 0.0), (k / len(y) if y else 0.0)
        out.append((p, r, f_measure(p, r)))
    return pd.DataFrame(out, columns=["p", "r", "f"])


@F.pandas_udf(SCORES)
def rouge_lsum(hypothesis: pd.Series, reference: pd.Series) -> pd.DataFrame:
    """Sentences are lines."""
    return pd.DataFrame([rouge_lsum_scores((a or "").split("\n"), (b or "").split("\n")) for a, b in zip(hypothesis, reference)], columns=["p", "r", "f"])


def pair_scores(df: DataFrame, hypothesis: str, reference: str, kinds=("1", "2", "L", "Lsum")) -> DataFrame:
    """Columns rouge{kind}_{precision,recall,fmeasure} of each pair."""
    for kind in kinds:
        score = rouge_n(F.col(hypothesis), F.col(reference), int(kind)) if kind.isdigit() else (rouge_l if kind == "L" else rouge_lsum)(hypothesis, reference)
        df = df.withColumn(f"_{kind}", score)
        p, r, f = (F.col(f"_{kind}.{c}") for c in "prf")
        df = df.withColumn(f"rouge{kind}_precision", p).withColumn(f"rouge{kind}_recall", r).withColumn(f"rouge{kind}_fmeasure", f)
    return df.drop(*[f"_{k}" for k in kinds])


Similarity = Callable[[list[str], list[str]], np.ndarray]  # of each token of two texts


def same_token(x: list[str], y: list[str]) -> np.ndarray:
    """Similarity 1 of equal tokens, 0 of others: the cosine of one-hot vectors."""
    places = {t: i for i, t in enumerate(dict.fromkeys(x + y))}
    a, b = (np.array([places[t] for t in s]) for s in (x, y))
    return (a[:, None] == b[None]).astype(np.float64)


def embedding_scores(hypothesis: Column, reference: Column, similarity: Similarity = same_token) -> Column:
    """struct<p,r,f> of greedily matched tokens: each token counts as its best similarity
    on the other side.  A neural scorer plugs in as ``similarity``."""

    @F.pandas_udf(SCORES)
    def scores(hypothesis: pd.Series, reference: pd.Series) -> pd.DataFrame:
        out = []
        for a, b in zip(hypothesis, reference):
            x, y = tokens(a or ""), tokens(b or "")
            p = r = 0.0
            if x and y:
                found = similarity(x, y)
                p, r = float(found.max(1).mean()), float(found.max(0).mean())
            out.append((p, r, f_measure(p, r)))
        return pd.DataFrame(out, columns=["p", "r", "f"])

    return scores(hypothesis, reference)


def corpus_scores(pairs: DataFrame, places: int = 4) -> DataFrame:
    """The mean of each score column over all pairs."""
    return pairs.agg(*[F.round(F.avg(c), places).alias(c) for c in pairs.columns if c.startswith("rouge")])


def greedy_picks(segment: str, summary: list[str], rounds: int = 100) -> list[tuple[int, float, float, float]]:
    """Summary sentences chosen one by one while the set-ROUGE-1 F of their union
    with the segment rises: (place, f, p, r); the first of equals wins.  F is
    rounded to 6 places before comparison.  At most ``rounds`` sentences are chosen."""
    own = set(tokens(segment))
    words = [set(tokens(s)) for s in summary]
    left, have, best, picks = list(range(len(summary))), set(), 0.0, []
    while left and len(picks) < rounds and own:
        top = None
        for i in left:
            joined = have | words[i]
            both = len(joined & own)
            f = round(2 * both / (len(joined) + len(own)), 6) if joined else 0.0
            if top is None or f > top[1]:
                top = i, f, both / len(own), both / len(joined) if joined else 0.0
        if top[1] <= best:
            break
        picks.append(top)
        best = top[1]
        left.remove(top[0])
        have |= words[top[0]]
    return picks


@F.pandas_udf(MATCH)
def greedy_match(segment: pd.Series, summary: pd.Series) -> pd.DataFrame:
    """The picks in the order of choice, and their text in the summary's order."""
    out = []
    for s, sents in zip(segment, summary):
        sents = [] if sents is None else list(sents)
        picks = greedy_picks(s or "", sents)
        out.append(([{"idx": i, "f": f, "p": p, "r": r} for i, f, p, r in picks], " ".join(sents[i] for i in sorted({p[0] for p in picks}))))
    return pd.DataFrame(out, columns=["picks", "target"])
