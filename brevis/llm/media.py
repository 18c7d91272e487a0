"""Media columns: texts stored as PNG images in a binary column and read back.

``to_png`` writes an 8-bit greyscale PNG of width 64: the UTF-8 bytes padded
with 0 to a positive multiple of 64, each row filtered (``FILTER``), in zlib
IDAT chunks with checksums.  ``from_png`` verifies every chunk's checksum and
the header, inflates, and undoes all five row filters with numpy.  The feature
is a perceptual hash: the image averaged to 32 x 32, its cosine transform, and
one bit for each of the 8 x 8 lowest frequencies above their median.

Defined results: a null text counts as empty, and an empty text as 64 zero
bytes; equal texts have equal images and features; repeated rows stay repeated;
an empty table gives an empty result; other input columns are ignored.  Memory
is bounded by ``BATCH_BYTES`` or one text, whichever is larger.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type

from .common import documents, utf8

WIDTH = 64
FILTER = 2  # "up": undone by one cumulative sum
LEVEL = 1
IDAT_BYTES = 1 << 16
BATCH_BYTES = 8 << 20
SIGNATURE = b"\x89PNG\r\n\x1a\n"
SIDE, LOW = 32, 8
COSINES = np.cos(np.pi / SIDE * np.outer(np.arange(LOW), np.arange(SIDE) + 0.5))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(body, zlib.crc32(kind)))


def _filtered(image: np.ndarray, kind: int) -> np.ndarray:
    rows, up, left, corner = image, np.zeros_like(image), np.zeros_like(image), np.zeros_like(image)
    up[1:], left[:, 1:], corner[1:, 1:] = rows[:-1], rows[:, :-1], rows[:-1, :-1]
    if kind == 0:
        return rows
    if kind == 1:
        return rows - left
    if kind == 2:
        return rows - up
    if kind == 3:
        return rows - ((left.astype(np.uint16) + up) >> 1).astype(np.uint8)
    return rows - _paeth(left, up, corner)


def _paeth(left: np.ndarray, up: np.ndarray, corner: np.ndarray) -> np.ndarray:
    a, b, c = left.astype(np.int16), up.astype(np.int16), corner.astype(np.int16)
    p = a + b - c
    pa_, pb, pc = abs(p - a), abs(p - b), abs(p - c)
    return np.where((pa_ <= pb) & (pa_ <= pc), left, np.where(pb <= pc, up, corner))


def to_png(payload: bytes, row_filter: int = FILTER) -> bytes:
    """``payload`` (a positive multiple of WIDTH bytes) as a PNG."""
    image = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    raw = np.empty((len(image), WIDTH + 1), np.uint8)
    raw[:, 0] = row_filter
    raw[:, 1:] = _filtered(image, row_filter)
    body = zlib.compress(raw.data, LEVEL)
    head = _chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(image), 8, 0, 0, 0, 0))
    return b"".join([SIGNATURE, head, *(_chunk(b"IDAT", body[i : i + IDAT_BYTES]) for i in range(0, len(body), IDAT_BYTES)), _chunk(b"IEND", b"")])


def unfilter(kinds: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Undo PNG's row filters for one byte a sample; runs of rows of one kind at a time."""
    out = np.empty_like(rows)
    starts = np.flatnonzero(np.r_[True, kinds[1:] != kinds[:-1]])
    for a, b in zip(starts, [*starts[1:], len(kinds)]):
        kind, above = kinds[a], out[a - 1] if a else np.zeros(rows.shape[1], np.uint8)
        if kind == 0:
            out[a:b] = rows[a:b]
        elif kind == 1:
            np.cumsum(rows[a:b], axis=1, dtype=np.uint8, out=out[a:b])
        elif kind == 2:
            np.cumsum(rows[a:b], axis=0, dtype=np.uint8, out=out[a:b])
            out[a:b] += above
        elif kind in (3, 4):
            _unfilter_diagonals(rows[a:b], out[a:b], above, int(kind))
        else:
            raise ValueError(f"PNG: unknown row filter {kind}")
    return out


def _unfilter_diagonals(rows: np.ndarray, out: np.ndarray, above: np.ndarray, kind: int) -> None:
    """Average and Paeth need the left, upper and corner samples: all samples of
    an anti-diagonal are independent, so each is one vector step."""
    h, w = rows.shape
    known = np.zeros((h + 1, w + 1), np.uint8)
    known[0, 1:] = above
    for d in range(h + w - 1):
        i = np.arange(max(0, d - w + 1), min(h, d + 1))
        j = d - i
        left, up, corner = known[i + 1, j], known[i, j + 1], known[i, j]
        guess = ((left.astype(np.uint16) + up) >> 1).astype(np.uint8) if kind == 3 else _paeth(left, up, corner)
        known[i + 1, j + 1] = rows[i, j] + guess
    out[:] = known[1:, 1:]


def from_png(data: bytes) -> np.ndarray:
    """The samples of an 8-bit greyscale PNG; raises ValueError on any damage."""
    try:
        return _samples(data)
    except (struct.error, zlib.error) as e:  # cut off inside a chunk or its fields
        raise ValueError("PNG: it is cut off or damaged") from e


def _samples(data: bytes) -> np.ndarray:
    if data[:8] != SIGNATURE:
        raise ValueError("PNG: bad signature")
    at, shape, body, ended = 8, None, [], False
    view = memoryview(data)
    while at < len(data):
        size, kind = struct.unpack(">I", view[at : at + 4])[0], bytes(view[at + 4 : at + 8])
        content, check = view[at + 8 : at + 8 + size], view[at + 8 + size : at + 12 + size]
        if len(check) != 4 or zlib.crc32(content, zlib.crc32(kind)) != struct.unpack(">I", check)[0]:
            raise ValueError(f"PNG: bad checksum of {kind!r}")
        if kind == b"IHDR":
            w, h, *form = struct.unpack(">IIBBBBB", content)
            if form != [8, 0, 0, 0, 0]:
                raise ValueError("PNG: only 8-bit greyscale without interlace is read")
            shape = h, w
        elif kind == b"IDAT":
            body.append(content)
        ended = kind == b"IEND"
        at += 12 + size
    if shape is None or not ended:
        raise ValueError("PNG: it has no header or no end")
    raw = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8)
    if raw.size != shape[0] * (shape[1] + 1):
        raise ValueError("PNG: wrong number of samples")
    raw = raw.reshape(shape[0], shape[1] + 1)
    return unfilter(raw[:, 0], raw[:, 1:])


def cosine_hash(image: np.ndarray) -> str:
    """64 bits in hex: the lowest 8 x 8 cosine frequencies against their median."""
    edge = np.arange(SIDE + 1) * len(image) // SIDE
    start = edge[:-1]  # under SIDE rows, rows repeat instead
    rows = np.add.reduceat(image, start, axis=0, dtype=np.int64) / np.diff(edge)[:, None] if len(image) >= SIDE else image[start].astype(np.float64)
    small = rows.reshape(SIDE, SIDE, -1).mean(2)
    low = np.round(COSINES @ small @ COSINES.T, 6).ravel()
    return np.packbits(low > np.median(low[1:])).tobytes().hex()


def _batched(names: list[str], kinds: list[pa.DataType], rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """Record batches of about BATCH_BYTES; a row's last item is its weight."""
    held, weight = [], 0
    for *row, w in rows:
        held.append(row)
        weight += w
        if weight >= BATCH_BYTES or len(held) >= 4096:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names=names)
            held, weight = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names=names)


def with_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, n_bytes and the binary column ``media`` with a PNG for each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                data, offsets = utf8(batch.column(1))
                for i, key in enumerate(batch.column(0).to_pylist()):
                    raw = data[offsets[i] : offsets[i + 1]].tobytes()
                    media = to_png(raw.ljust(max(WIDTH, -(-len(raw) // WIDTH) * WIDTH), b"\0"))
                    yield key, len(raw), media, len(media)

        yield from _batched([id_col, "n_bytes", "media"], [key_type, pa.int64(), pa.binary()], rows())

    kind, key_type = dict(df.dtypes)[id_col], to_arrow_type(df.schema[id_col].dataType)
    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, media binary")


def with_features(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Read the images of ``with_media`` back: checksums, sizes and ``feature``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                for key, n, media in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                    media = media.as_py()
                    image = from_png(media)
                    payload = image.tobytes()
                    yield (key, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), cosine_hash(image), 300)

        kinds = [key_type, pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        yield from _batched([id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"], kinds, rows())

    kind, key_type = dict(df.dtypes)[id_col], to_arrow_type(df.schema[id_col].dataType)
    schema = f"`{id_col}` {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return df.select(id_col, "n_bytes", "media").mapInArrow(run, schema)


def op5_media_columns(spark, sf_dir: str) -> DataFrame:
    return with_features(with_media(documents(spark, sf_dir)))
