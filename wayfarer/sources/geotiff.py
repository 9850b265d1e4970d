"""GeoTIFF rasters as layers, and viewsheds as GeoTIFF files, with numpy alone.

Read: classic TIFF of either byte order, strips or tiles, whole or floating numbers, no compression, deflate, LZW or
PackBits, without predictor or with horizontal differences; the first band. Written: 32-bit floating point, PackBits."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.raster import Layer, MapLayer

#: Fixed values of the format: tags, compressions, sizes and codes of field types.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIPS, SAMPLES, STRIP_ROWS, STRIP_BYTES = 256, 257, 258, 259, 262, 273, 277, 278, 279
PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILES, TILE_BYTES, SAMPLE_FORMAT, PIXEL_SCALE, TIEPOINT, NODATA = 317, 322, 323, 324, 325, 339, 33550, 33922, 42113
PLAIN, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d"}
KINDS = {1: "u", 2: "i", 3: "f"}
NO_DATA = -10000.0


class Raster(NamedTuple):
    """values (NaN where there are none) and where the grid lies."""

    values: np.ndarray
    origin_x: float
    origin_y: float
    cell_x: float
    cell_y: float


def _tags(data: bytes) -> tuple[str, dict[int, tuple]]:
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise ValueError("not a classic TIFF file")
    (at,) = struct.unpack_from(order + "I", data, 4)
    tags = {}
    for k in range(struct.unpack_from(order + "H", data, at)[0]):
        place = at + 2 + 12 * k
        tag, kind, n = struct.unpack_from(order + "HHI", data, place)
        if kind in TYPES:
            code = f"{n}s" if kind == 2 else f"{n}{TYPES[kind]}"
            inside = place + 8 if struct.calcsize("<" + code) <= 4 else struct.unpack_from(order + "I", data, place + 8)[0]
            tags[tag] = struct.unpack_from(order + code, data, inside)
    return order, tags


def unpacked(data: bytes) -> bytes:
    """PackBits undone: a count and that many bytes, or a count and a byte that is repeated."""
    out, at = bytearray(), 0
    while at < len(data):
        n, at = data[at], at + 1
        if n < 128:
            out += data[at : at + n + 1]
            at += n + 1
        elif n > 128:
            out += data[at : at + 1] * (257 - n)
            at += 1
    return bytes(out)


def packed(data: bytes) -> bytes:
    """PackBits: runs of three equal bytes or more are counted."""
    out, a = bytearray(), np.frombuffer(data, np.uint8)
    edges = np.concatenate([[0], np.flatnonzero(np.diff(a)) + 1, [len(a)]]) if len(a) else np.zeros(1, int)
    plain = 0

    def flush(end: int) -> None:
        for k in range(plain, end, 128):
            part = data[k : min(end, k + 128)]
            out.append(len(part) - 1)
            out.extend(part)

    for begin, end in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        if end - begin >= 3:
            flush(begin)
            for k in range(begin, end, 128):
                n = min(128, end - k)
                out.extend((0, data[k]) if n == 1 else (257 - n, data[k]))
            plain = end
    flush(len(data))
    return bytes(out)


def _lzw(data: bytes) -> bytes:
    """LZW undone, as this format has it: the highest bit first, codes that widen one early."""
    table, out, width, last = [], bytearray(), 9, b""
    bits = held = 0
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, held = held >> bits, held & ((1 << bits) - 1)
        if code == 257:
            break
        if code == 256:
            table, width, last = [bytes([k]) for k in range(256)] + [b"", b""], 9, b""
            continue
        entry = table[code] if code < len(table) else last + last[:1]
        out += entry
        if last:
            table.append(last + entry[:1])
        last = entry
        width = 12 if len(table) >= 2047 else 11 if len(table) >= 1023 else 10 if len(table) >= 511 else 9
    return bytes(out)


_UNDO = {PLAIN: bytes, LZW: _lzw, DEFLATE: zlib.decompress, OLD_DEFLATE: zlib.decompress, PACKBITS: unpacked}


def decode(data: bytes) -> Raster:
    """The first band of a GeoTIFF file; ValueError for what isn't supported."""
    order, tags = _tags(data)
    one = lambda tag, default=None: tags[tag][0] if tag in tags else default
    width, height, samples = one(WIDTH), one(HEIGHT), one(SAMPLES, 1)
    compression, predictor = one(COMPRESSION, PLAIN), one(PREDICTOR, 1)
    if compression not in _UNDO or predictor not in (1, 2):
        raise ValueError(f"compression {compression} with predictor {predictor} isn't supported")
    kind = np.dtype(f"{order}{KINDS[one(SAMPLE_FORMAT, 1)]}{one(BITS, 8) // 8}")
    tiled = TILES in tags
    block_width, block_height = (one(TILE_WIDTH), one(TILE_HEIGHT)) if tiled else (width, min(one(STRIP_ROWS, height), height))
    offsets, sizes = (tags[TILES], tags[TILE_BYTES]) if tiled else (tags[STRIPS], tags[STRIP_BYTES])
    across = -(-width // block_width)
    out = np.zeros((-(-height // block_height) * block_height, across * block_width), np.float64)
    for k, (at, size) in enumerate(zip(offsets, sizes, strict=True)):
        if k >= across * -(-height // block_height):
            break  # further planes
        values = np.frombuffer(_UNDO[compression](data[at : at + size]), kind)
        rows = min(block_height, len(values) // (block_width * samples))
        block = values[: rows * block_width * samples].reshape(rows, block_width, samples)
        if predictor == 2:
            block = np.cumsum(block, axis=1, dtype=kind)
        r, c = divmod(k, across)
        out[r * block_height : r * block_height + rows, c * block_width : (c + 1) * block_width] = block[:, :, 0]
    out = out[:height, :width]
    if NODATA in tags:
        out[out == np.float64(kind.type(float(tags[NODATA][0].split(b"\0")[0])))] = np.nan
    scale, tie = tags.get(PIXEL_SCALE, (1.0, 1.0, 0.0)), tags.get(TIEPOINT, (0.0,) * 6)
    return Raster(out, tie[3] - tie[0] * scale[0], tie[4] + tie[1] * scale[1], scale[0], -scale[1])


def encode(raster: Raster, no_data: float = NO_DATA) -> bytes:
    """A GeoTIFF file of 32-bit floating point, packed row by row."""
    values = np.where(np.isnan(raster.values), no_data, raster.values).astype("<f4")
    rows = [packed(row.tobytes()) for row in values]
    offsets = np.cumsum([8, *map(len, rows)])[:-1].tolist()
    shorts, longs, doubles = (lambda *v: (3, f"{len(v)}H", v)), (lambda *v: (4, f"{len(v)}I", v)), (lambda *v: (12, f"{len(v)}d", v))
    text = f"{no_data:g}".encode() + b"\0"
    fields = {
        WIDTH: longs(values.shape[1]), HEIGHT: longs(values.shape[0]), BITS: shorts(32), COMPRESSION: shorts(PACKBITS), PHOTOMETRIC: shorts(1),
        STRIPS: longs(*offsets), SAMPLES: shorts(1), STRIP_ROWS: longs(1), STRIP_BYTES: longs(*map(len, rows)), SAMPLE_FORMAT: shorts(3),
        PIXEL_SCALE: doubles(raster.cell_x, -raster.cell_y, 0.0), TIEPOINT: doubles(0.0, 0.0, 0.0, raster.origin_x, raster.origin_y, 0.0), NODATA: (2, f"{len(text)}s", (text,)),
    }
    body = b"".join(rows)
    body += bytes(len(body) % 2)
    head, extra = [], bytearray()
    after = 8 + len(body) + 2 + 12 * len(fields) + 4
    for tag, (kind, code, v) in sorted(fields.items()):
        raw = struct.pack("<" + code, *v)
        n = len(raw) if kind == 2 else len(v)
        if len(raw) <= 4:
            head.append(struct.pack("<HHI", tag, kind, n) + raw.ljust(4, b"\0"))
        else:
            head.append(struct.pack("<HHII", tag, kind, n, after + len(extra)))
            extra += raw + bytes(len(raw) % 2)
    return b"II*\0" + struct.pack("<I", 8 + len(body)) + body + struct.pack("<H", len(fields)) + b"".join(head) + bytes(4) + bytes(extra)


def _files(spark: SparkSession, path: str) -> DataFrame:
    name = F.regexp_extract("path", r"([^/]*)\.tiff?$", 1)
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.{tif,tiff}").load(path).select(name.alias("name"), "path", "content")


def _cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for name, content in zip(batch["name"], batch["content"], strict=True):
            values = decode(content).values
            for at in range(0, len(values), 256):
                part = values[at : at + 256]
                row, col = np.indices(part.shape).reshape(2, -1)
                yield pd.DataFrame({"big_map": name, "row": row + at, "col": col, "value": part.ravel()})


def _grids(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        found = [(n, decode(c)) for n, c in zip(batch["name"], batch["content"], strict=True)]
        rows = [(n, r.origin_x, r.origin_y, r.cell_x, r.cell_y, r.values.shape[1], r.values.shape[0]) for n, r in found]
        yield pd.DataFrame(rows, columns=["big_map", "origin_x", "origin_y", "cell_x", "cell_y", "width", "height"])


def read_maps(spark: SparkSession, folder: str) -> MapLayer:
    """The GeoTIFF files of a folder, a map each, named like its file. A file is decoded by one task."""
    files = _files(spark, folder)
    cells = files.select("name", "content").mapInPandas(_cells, "big_map string, row bigint, col bigint, value double")
    grids = files.select("name", "content").mapInPandas(_grids, "big_map string, origin_x double, origin_y double, cell_x double, cell_y double, width int, height int")
    return MapLayer(cells.withColumn("value", F.when(~F.isnan("value"), F.col("value"))), grids)


def read_layer(spark: SparkSession, path: str) -> Layer:
    """One GeoTIFF file."""
    found = read_maps(spark, path)
    grid = found.grids.first()
    return Layer(found.cells.drop("big_map"), *[grid[c] for c in ("origin_x", "origin_y", "cell_x", "cell_y", "width", "height")])


def write_viewsheds(cells: DataFrame, name: Column, layer: Layer, folder: str) -> DataFrame:
    """A GeoTIFF for each viewshed of cells(…, row, col, visible): 1 and 0, no data where there is no cell. One row per
    file: name, path, viewshed_vis. Runs when the result is read; files that are there are replaced."""
    store, root = (fs.LocalFileSystem(), folder.removeprefix("file:")) if "://" not in folder else fs.FileSystem.from_uri(folder)

    left, top, cell_x, cell_y = layer.origin_x, layer.origin_y, layer.cell_x, layer.cell_y

    def write(own: pd.DataFrame) -> pd.DataFrame:
        row, col = int(own["row"].min()), int(own["col"].min())
        values = np.full((int(own["row"].max()) - row + 1, int(own["col"].max()) - col + 1), np.nan)
        values[own["row"] - row, own["col"] - col] = own["visible"].astype(float)
        path = f"{root}/{own['name'].iloc[0]}"
        store.create_dir(path.rsplit("/", 1)[0], recursive=True)
        with store.open_output_stream(path) as f:
            f.write(encode(Raster(values, left + col * cell_x, top + row * cell_y, cell_x, cell_y)))
        return pd.DataFrame([(own["name"].iloc[0], path, float(np.nanmean(values)))], columns=["name", "path", "viewshed_vis"])

    return cells.select(name.alias("name"), "row", "col", "visible").groupBy("name").applyInPandas(write, "name string, path string, viewshed_vis double")


def viewshed_means(spark: SparkSession, folder: str) -> DataFrame:
    """name, viewshed_vis: the mean of the cells with data of each GeoTIFF below a folder."""

    def means(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"name": batch["name"], "viewshed_vis": [float(np.nanmean(decode(c).values)) for c in batch["content"]]})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tif").option("recursiveFileLookup", "true").load(folder)
    return files.select(F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), "content").mapInPandas(means, "name string, viewshed_vis double")
