"""URL filters: a bit-parallel wildcard automaton (extended Shift-And).

All glob rules are packed into one row of 64-bit words, a bit per pattern
position; one step per URL byte moves every pattern of every URL of a batch at
once.  ``*`` is a self-loop: in a host any byte but ``/``, in a path any byte.

Rules have a host and a path.  A rule fits its host and all subdomains when the
path starts with the rule's; of the fitting rules the longest wins, ties go to
the first listed.  Where none fits, ``DEFAULT_GLOBS`` decide: block if any
matches, else allow.

Defined results: a null url, or one without ``://``, has an empty host and path,
which no rule fits, so the verdict is ``allow``.  Repeated rows stay repeated,
an empty table gives an empty result, and other input columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, utf8

#: (verdict, host, path), the rules of the contract.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)

#: Block globs over ``.host/path`` for URLs that no rule fits.
DEFAULT_GLOBS = (
    ".ads*.*/*",
    ".ad.*/*",
    ".*.ads*.*/*",
    ".track*.*/*",
    ".*.track*.*/*",
    ".cheap-*/*",
    ".*.cheap-*/*",
    ".*/wp-login*",
    ".*/ads/*",
)


@dataclass(frozen=True)
class Automaton:
    """Bit masks of packed patterns.  A pattern's bits lie side by side, its
    first one an entry state; ``enter`` and ``final`` hold the first and last."""

    step: np.ndarray  # [256, words]: bits whose byte is accepted
    loop: np.ndarray  # [256, words]: bits that a byte leaves in place
    enter: np.ndarray  # [words]
    final: np.ndarray  # [patterns, 2]: word and bit

    @staticmethod
    def build(patterns: list[bytes]) -> Automaton:
        """Patterns match from the first byte on; a trailing ``*`` matches any rest.
        ``*`` before the first ``/`` of a pattern stops at ``/``."""
        bits = sum(len(p.replace(b"*", b"")) + 1 for p in patterns)
        n = -(-bits // 64)
        step, loop = np.zeros((256, n), np.uint64), np.zeros((256, n), np.uint64)
        enter, final, at = np.zeros(n, np.uint64), np.zeros((len(patterns), 2), np.int64), 0
        for i, p in enumerate(patterns):
            in_path = False
            enter[at // 64] |= np.uint64(1 << at % 64)
            for c in p:
                word, bit = at // 64, np.uint64(1 << at % 64)
                if c == 42:
                    stay = np.ones(256, bool)
                    stay[47] = in_path
                    loop[stay, word] |= bit
                else:
                    in_path |= c == 47
                    at += 1
                    step[c, at // 64] |= np.uint64(1 << at % 64)
            final[i] = at // 64, at % 64
            at += 1
        return Automaton(step, loop, enter, final)

    def run(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Whether each row matches each pattern: bool [rows, patterns]."""
        sizes = np.diff(offsets)
        order = np.argsort(-sizes, kind="stable")
        sizes, begin = sizes[order], offsets[:-1][order]
        state = np.broadcast_to(self.enter, (len(order), len(self.enter))).copy()
        carry = np.uint64(63)
        for t in range(int(sizes[0]) if len(sizes) else 0):
            live = int(np.searchsorted(-sizes, -t, "left"))
            c, s = data[begin[:live] + t], state[:live]
            moved = s << np.uint64(1)
            moved[:, 1:] |= s[:, :-1] >> carry
            state[:live] = (moved & self.step[c]) | (s & self.loop[c])
        hit = (state[:, self.final[:, 0]] >> self.final[:, 1].astype(np.uint64)) & np.uint64(1)
        out = np.empty((len(order), len(self.final)), bool)
        out[order] = hit.astype(bool)
        return out


def judge(df: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, default_globs=DEFAULT_GLOBS) -> DataFrame:
    """``id_col``, host, path, rule, verdict for every row of ``df``."""
    rules, default_globs = tuple(rules), tuple(default_globs)
    ranked = sorted(range(len(rules)), key=lambda i: -len(rules[i][1] + rules[i][2]))
    # ".host" stands for the host with all its subdomains: "." + text, "*" up to the rule's ".host"
    patterns = [f"{lead}.{rules[i][1]}{rules[i][2]}*".encode() for i in ranked for lead in ("", ".*")] + [g.encode() for g in default_globs]
    names, verdicts = [rules[i][1] + rules[i][2] for i in ranked], [rules[i][0] for i in ranked]
    automaton = Automaton.build(patterns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("canon"))
            for a, b in pieces(offsets):
                hit = automaton.run(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                n = len(names)
                fits = hit[:, : 2 * n].reshape(b - a, n, 2).any(2)
                first = np.where(fits.any(1), fits.argmax(1), -1) if n else np.full(b - a, -1)
                blocked = hit[:, 2 * n :].any(1)
                rule = [names[i] if i >= 0 else None for i in first]
                verdict = [verdicts[i] if i >= 0 else ("block" if x else "allow") for i, x in zip(first, blocked)]
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("host"), part.column("path"), pa.array(rule, pa.string()), pa.array(verdict, pa.string())], names=[id_col, "host", "path", "rule", "verdict"])

    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.translate(F.regexp_extract(url_col, parts, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    canon = (
        df.select(F.col(id_col).alias("id"), F.coalesce(host, F.lit("")).alias("host"), F.coalesce(F.regexp_extract(url_col, parts, 2), F.lit("")).alias("path"))
        .withColumn("canon", F.concat(F.lit("."), "host", "path"))
    )
    kind = dict(df.dtypes)[id_col]
    return canon.mapInArrow(run, f"`{id_col}` {kind}, host string, path string, rule string, verdict string")


def op10_url_filter(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))


_RANKED = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
_FITS = [f"((host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}'))" for _, h, p in _RANKED]


def _glob(g: str) -> str:
    host, slash, path = g.partition("/")
    regex = "".join("[^/]*" if c == "*" else "[.]" if c == "." else c for c in host) + slash + path.replace("*", "(?s:.*)")
    return f"regexp_full_match('.' || host || path, '{regex}')"


ORACLE = f"""
with parts as (
  select page_id,
         coalesce(translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
         coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)([^?#]*)', 2), '') as path
  from pages)
select page_id, host, path,
       case {' '.join(f"when {c} then '{r[1]}{r[2]}'" for c, r in zip(_FITS, _RANKED))} end as rule,
       case {' '.join(f"when {c} then '{r[0]}'" for c, r in zip(_FITS, _RANKED))}
            when {' or '.join(map(_glob, DEFAULT_GLOBS))} then 'block' else 'allow' end as verdict
from parts
"""
