"""Media columns: any text as the bytes of a greyscale PNG, read back through its chunks, with a cosine-transform hash.

The writer makes 8-bit greyscale rows of 64 samples and gives each row the filter of WRITTEN whose differences are
least; the reader takes any 8-bit greyscale PNG without interlacing: it tests each chunk's checksum, joins and inflates
the data chunks and undoes all five row filters with numpy, those of the writer for runs of rows at once.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, table, text_bytes

#: Fixed values of the PNG format (ISO/IEC 15948): signature, filter types.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
NONE, SUB, UP, AVERAGE, PAETH = range(5)

WIDTH = 64
CHUNK = 1 << 20
GRID, LOW = 32, 8  # the hash averages the picture to GRID x GRID cells and keeps LOW x LOW frequencies


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


WRITTEN = (NONE, SUB, UP)  # what the writer chooses from for each row


def _filtered(samples: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """The rows as filters of these kinds leave them, each behind its kind."""
    rows = np.zeros((samples.shape[0], samples.shape[1] + 1), np.uint8)
    rows[:, 0], out = kinds, rows[:, 1:]
    out[:] = samples
    sub, up = np.flatnonzero(kinds == SUB), np.flatnonzero(kinds == UP)
    out[sub, 1:] -= samples[sub, :-1]
    up = up[up > 0]
    out[up] -= samples[up - 1]
    return rows


def _least(samples: np.ndarray) -> np.ndarray:
    """For each row, the kind of WRITTEN that leaves the least sum of differences, taken as signed; the first of several."""
    size = lambda kind: np.abs(_filtered(samples, np.full(len(samples), kind, np.uint8))[:, 1:].view(np.int8).astype(np.int16)).sum(axis=1)
    return np.array(WRITTEN, np.uint8)[np.argmin([size(kind) for kind in WRITTEN], axis=0)]


def encode(samples: np.ndarray, row_filter: int | None = None, level: int = 4) -> bytes:
    """A PNG of a 2-d uint8 array. row_filter: NONE, SUB or UP for all rows; by default each row has its own."""
    height, width = samples.shape
    if row_filter not in (None, *WRITTEN):
        raise ValueError("row_filter is none, sub or up")
    data = zlib.compress(_filtered(samples, _least(samples) if row_filter is None else np.full(height, row_filter, np.uint8)).tobytes(), level)
    parts = [SIGNATURE, _chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0))]
    parts += [_chunk(b"IDAT", data[k : k + CHUNK]) for k in range(0, len(data), CHUNK)]
    return b"".join([*parts, _chunk(b"IEND", b"")])


def _chunks(png: bytes):
    if png[:8] != SIGNATURE:
        raise ValueError("no PNG signature")
    at = 8
    while at < len(png):
        if at + 12 > len(png):
            raise ValueError("the file ends inside a chunk")
        (length,), kind = struct.unpack_from(">I", png, at), png[at + 4 : at + 8]
        data = png[at + 8 : at + 8 + length]
        if len(data) != length or png[at + 8 + length : at + 12 + length] != struct.pack(">I", zlib.crc32(data, zlib.crc32(kind))):
            raise ValueError(f"the checksum of chunk {kind!r} at {at} doesn't hold")
        yield kind, data
        at += 12 + length
        if kind == b"IEND":
            return
    raise ValueError("no end chunk")


def _unfiltered_row(kind: int, row: np.ndarray, above: np.ndarray) -> np.ndarray:
    """A row of filter AVERAGE or PAETH, in which each sample needs the one before."""
    out, left, corner = np.empty_like(row), 0, 0
    for x, (value, up) in enumerate(zip(row.tolist(), above.tolist(), strict=True)):
        if kind == AVERAGE:
            guess = (left + up) // 2
        else:
            near = left + up - corner
            guess = min((abs(near - left), 0, left), (abs(near - up), 1, up), (abs(near - corner), 2, corner))[2]
        left, corner = (value + guess) & 255, up
        out[x] = left
    return out


def unfiltered(rows: np.ndarray) -> np.ndarray:
    """The samples of rows that have their filter's kind in front; runs of rows of one kind are undone together."""
    kinds, out = rows[:, 0], rows[:, 1:].copy()
    if len(kinds) and kinds.max() > PAETH:
        raise ValueError(f"no row filter {kinds.max()}")
    edges = np.concatenate([[0], np.flatnonzero(np.diff(kinds)) + 1, [len(kinds)]])
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        kind, own = int(kinds[a]) if b > a else NONE, out[a:b]
        if kind == SUB:
            np.cumsum(own, axis=1, dtype=np.uint8, out=own)
        elif kind == UP:
            if a:
                own[0] += out[a - 1]
            np.cumsum(own, axis=0, dtype=np.uint8, out=own)
        elif kind != NONE:
            for y in range(a, b):
                out[y] = _unfiltered_row(kind, out[y], out[y - 1] if y else np.zeros_like(out[y]))
    return out


def decode(png: bytes) -> np.ndarray:
    """The samples of an 8-bit greyscale PNG; ValueError if a checksum, the size or the kind doesn't hold."""
    header, data = None, []
    for kind, body in _chunks(png):
        if kind == b"IHDR":
            header = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        elif kind[0] < 97 and kind != b"IEND":  # an upper-case first letter: needed to understand the picture
            raise ValueError(f"chunk {kind!r} isn't supported")
    if header is None or header[2:] != (8, 0, 0, 0, 0):
        raise ValueError("only 8-bit greyscale without interlacing is supported")
    width, height = header[:2]
    raw = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8)
    if raw.size != height * (width + 1):
        raise ValueError("the data don't fill the picture")
    return unfiltered(raw.reshape(height, width + 1))


@lru_cache
def _cosines() -> np.ndarray:
    k, x = np.arange(LOW)[:, None], np.arange(GRID)[None, :]
    return np.cos(np.pi * k * (2 * x + 1) / (2 * GRID))


def _cells(samples: np.ndarray, n: int) -> np.ndarray:
    """Rows averaged to n: cell k has the rows from k h / n to (k + 1) h / n, in part where that isn't whole."""
    height = samples.shape[0]
    sums = np.zeros((height + 1, samples.shape[1]))
    np.cumsum(samples, axis=0, dtype=np.float64, out=sums[1:])
    at = np.arange(n + 1) * height / n
    low = np.minimum(at.astype(int), height - 1)
    edge = sums[low] + (at - low)[:, None] * samples[low]
    return np.diff(edge, axis=0) * (n / height)


def cosine_hash(samples: np.ndarray) -> str:
    """64 bits in hex: which of the LOW x LOW lowest frequencies of the two-dimensional cosine transform exceed their median."""
    grid = _cells(_cells(samples, GRID).T, GRID).T
    c = _cosines()
    low = np.round((c @ grid @ c.T).ravel(), 6)
    low[0] = 0.0  # the mean brightness says nothing about form
    return np.packbits(low > np.median(low)).tobytes().hex()


def padded(text: bytes) -> bytes:
    """text with bytes 0 up to a positive multiple of WIDTH."""
    return text + bytes(max(WIDTH, -(-len(text) // WIDTH) * WIDTH) - len(text))


def with_media(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_bytes and media, the PNG of the padded bytes; a null text is empty."""
    narrow = docs.select("doc_id", text_bytes().alias("text"))

    def run(batches):
        for batch in batches:
            texts = [x.as_py() for x in batch.column("text")]
            media = [encode(np.frombuffer(padded(x), np.uint8).reshape(-1, WIDTH)) for x in texts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(map(len, texts), pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return narrow.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes bigint, media binary")


_FEATURES = "n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, feature_bits binary"


def features(media: DataFrame) -> DataFrame:
    """What the stored PNG of each row of media(doc_id, n_bytes, media) says once it is read back."""

    def run(batches):
        for batch in batches:
            rows = []
            for n, png in zip(batch.column("n_bytes").to_pylist(), batch.column("media").to_pylist(), strict=True):
                samples = decode(png)
                payload = samples.tobytes()
                feature = cosine_hash(samples)
                rows.append((n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(png), hashlib.sha256(png).hexdigest(), feature, bytes.fromhex(feature)))
            names = [x.split()[0] for x in _FEATURES.split(", ")]
            kinds = [{"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}[x.split()[1]] for x in _FEATURES.split(", ")]
            columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", *names])

    return media.mapInArrow(run, f"doc_id {media.schema['doc_id'].dataType.simpleString()}, {_FEATURES}")


def op8_media(spark, sf_dir):
    return features(stored(with_media(table(spark, sf_dir, "documents")), "media"))
