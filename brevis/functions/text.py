"""Column expressions over text.

White space is Python's (``str.split``, ``str.strip``): Unicode's White_Space
and U+001C to U+001F.  Lengths are code points.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITE = r"(?U)[\s\x1c-\x1f]+"
#: Ends a sentence when white space follows; put there in its place.
SENTENCE_MARK = "\x1e"


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x worked out once, however often f names it in inner functions."""
    return F.element_at(F.transform(F.array(x), f), 1)


def ws_tokens(x: Column) -> Column:
    """Runs of anything but white space."""
    return F.filter(F.split(x, WHITE), lambda t: t != "")


def ws_length(x: Column) -> Column:
    return F.size(ws_tokens(x))


def space_length(x: Column) -> Column:
    """Pieces between single spaces, empty ones included: '' has 1."""
    return F.size(F.split(x, " ", -1))


def strip(x: Column) -> Column:
    """Without white space at either end, newlines included."""
    return F.regexp_replace(F.regexp_replace(x, r"(?U)^[\s\x1c-\x1f]+", ""), r"(?U)[\s\x1c-\x1f]+$", "")


def normalize_space(x: Column) -> Column:
    return F.array_join(ws_tokens(x), " ")


def strip_numbering(x: Column) -> Column:
    """Without a leading paragraph number such as ``(12) ``."""
    return F.regexp_replace(x, r"^\(\d+\)\s+", "")


def sentences(x: Column, least: int = 1) -> Column:
    """The default sentence rule: a sentence ends with ``.``, ``!`` or ``?`` before
    white space; sentences under ``least`` code points go."""
    marked = F.regexp_replace(x, r"([.!?])\s+", "$1" + SENTENCE_MARK)
    return F.filter(F.split(marked, SENTENCE_MARK), lambda s: F.length(s) >= least)


def ngrams(tokens: Column, n: int) -> Column:
    """All n-grams, joined by a space; none if there are fewer than n tokens."""
    if n == 1:
        return tokens

    def grams(t: Column) -> Column:
        return F.when(F.size(t) >= n, F.transform(F.sequence(F.lit(1), F.size(t) - (n - 1)), lambda i: F.array_join(F.slice(t, i, n), " "))).otherwise(F.array().cast("array<string>"))

    return let(tokens, grams)


def rouge_tokens(x: Column, unicode: bool = False) -> Column:
    """Lower-cased runs of a-z and 0-9 (or of all letters and digits)."""
    other = r"[^\p{L}0-9]+" if unicode else "[^a-z0-9]+"
    return F.filter(F.split(F.regexp_replace(F.lower(x), other, " "), " "), lambda t: t != "")


def word_chunks(x: Column, size: int = 512) -> Column:
    """Consecutive chunks of ``size`` words, the last one shorter; none for no words."""

    def cut(tokens: Column) -> Column:
        last = F.ceil(F.size(tokens) / size).cast("int") - 1
        return F.when(F.size(tokens) > 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(tokens, i * size + 1, size))).otherwise(F.array().cast("array<array<string>>"))

    return let(ws_tokens(x), cut)


def last_part(x: Column, separator: str) -> Column:
    """What follows the last separator."""
    return F.substring_index(x, separator, -1)


def seeded_order(seed: int, *parts: Column | str) -> Column:
    """A portable pseudo-random sort key: rows in its order are a seeded shuffle."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.concat_ws(":", *[F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts])))


def basic_value(x: Column) -> dict[str, Column]:
    """A configuration text as integer, float or boolean where it reads as one; ``kind``
    names the first that fits; as text, without the quotes at its ends, which keep
    white space that belongs to it."""
    t = strip(x)
    as_int, as_float = t.try_cast("bigint"), t.try_cast("double")
    as_bool = F.when(t.isin("True", "true", "False", "false"), F.lower(t) == "true")
    as_int = F.when(t.rlike(r"^[+-]?\d+$"), as_int)
    as_float = F.when(t.rlike(r"^[+-]?(\d+\.\d*|\.\d+|\d+)([eE][+-]?\d+)?$"), as_float)
    kind = F.when(as_int.isNotNull(), "int").when(as_float.isNotNull(), "float").when(as_bool.isNotNull(), "bool").otherwise("str")
    return {"kind": kind, "as_int": as_int, "as_float": as_float, "as_bool": as_bool, "as_text": F.regexp_replace(F.regexp_replace(x, "^[\"']+", ""), "[\"']+$", "")}
