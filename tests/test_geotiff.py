"""GeoTIFF files: what is written is read, the other layouts by a writer of their own, and layers sampled from files."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfarer.operators import raster, viewshed
from wayfarer.sources import geotiff


def test_round_trip():
    r = np.random.default_rng(0)
    values = np.round(r.normal(size=(13, 7)), 1).astype(np.float32).astype(float)
    values[3:5, 2:] = np.nan
    values[6] = 4.0
    found = geotiff.decode(geotiff.encode(geotiff.Raster(values, 100.0, 50.0, 0.5, -0.25)))
    assert np.array_equal(found.values, values, equal_nan=True)
    assert found[1:] == (100.0, 50.0, 0.5, -0.25)


@pytest.mark.parametrize("data", [b"", b"a", b"aaa", b"abcabc", b"a" * 1000, bytes(range(256)) * 3 + b"zz" + b"y" * 129])
def test_packbits(data):
    assert geotiff.unpacked(geotiff.packed(data)) == data


def lzw(data):
    """A writer of codes, the highest bit first."""
    out, table, width, word = [(256, 9)], {bytes([k]): k for k in range(256)}, 9, b""
    n = 258
    for byte in data:
        more = word + bytes([byte])
        if more in table:
            word = more
            continue
        out.append((table[word], width))
        table[more], n, word = n, n + 1, bytes([byte])
        width = 12 if n >= 2048 else 11 if n >= 1024 else 10 if n >= 512 else 9
    if word:
        out.append((table[word], width))
        n += 1
        width = 12 if n >= 2048 else 11 if n >= 1024 else 10 if n >= 512 else 9
    bits = "".join(f"{c:0{w}b}" for c, w in [*out, (257, width)])
    return int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")


def file_of(values, order, compression, tile=None, predictor=1):
    """A whole-number TIFF in strips of five rows or in tiles, by hand."""
    kind = values.dtype.newbyteorder(order)
    height, width = values.shape
    blocks = []
    h, w = tile or (5, width)
    for r in range(0, height, h):
        for c in range(0, width, w):
            block = values[r : r + h, c : c + w]
            if tile:
                block = np.pad(block, ((0, h - block.shape[0]), (0, w - block.shape[1])))
            if predictor == 2:
                block = np.concatenate([block[:, :1], np.diff(block, axis=1)], axis=1)
            raw = block.astype(kind).tobytes()
            blocks.append({1: bytes, 5: lzw, 8: zlib.compress, 32773: geotiff.packed}[compression](raw))
    fields = [(256, 3, [width]), (257, 3, [height]), (258, 3, [8 * values.dtype.itemsize]), (259, 3, [compression]), (317, 3, [predictor]), (339, 3, [2])]
    at = 8
    offsets = [at + sum(map(len, blocks[:k])) for k in range(len(blocks))]
    sizes = [len(b) for b in blocks]
    fields += [(322, 3, [w]), (323, 3, [h]), (324, 4, offsets), (325, 4, sizes)] if tile else [(273, 4, offsets), (278, 3, [5]), (279, 4, sizes)]
    body = b"".join(blocks)
    after = 8 + len(body) + 2 + 12 * len(fields) + 4
    head, extra = b"", b""
    for tag, kind_, v in sorted(fields):
        raw = struct.pack(f"{order}{len(v)}{'H' if kind_ == 3 else 'I'}", *v)
        head += struct.pack(f"{order}HHI", tag, kind_, len(v)) + (raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack(f"{order}I", after + len(extra)))
        extra += raw if len(raw) > 4 else b""
    return {"<": b"II", ">": b"MM"}[order] + struct.pack(f"{order}HI", 42, 8 + len(body)) + body + struct.pack(f"{order}H", len(fields)) + head + bytes(4) + extra


@pytest.mark.parametrize("order", "<>")
@pytest.mark.parametrize("compression", [1, 5, 8, 32773])
@pytest.mark.parametrize(("tile", "predictor"), [(None, 1), (None, 2), ((16, 16), 1), ((16, 16), 2)])
def test_layouts(order, compression, tile, predictor):
    values = np.random.default_rng(1).integers(-300, 300, (33, 41)).astype(np.int16)
    found = geotiff.decode(file_of(values, order, compression, tile, predictor))
    assert np.array_equal(found.values, values)


def test_what_is_not_supported():
    with pytest.raises(ValueError, match="classic"):
        geotiff.decode(b"not a file at all")
    values = np.zeros((2, 2), np.int16)
    with pytest.raises(ValueError, match="predictor"):
        geotiff.decode(file_of(values, "<", 1, None, 3))


def test_layers_and_viewsheds(spark, tmp_path):
    r = np.random.default_rng(2)
    for name, up in (("a", 0.0), ("b", 10.0)):
        values = np.round(r.random((20, 30)) * 2, 1) + up
        values[0, 0] = np.nan
        (tmp_path / f"{name}.tif").write_bytes(geotiff.encode(geotiff.Raster(values, 5.0, 40.0, 1.0, -1.0)))
    maps = geotiff.read_maps(spark, str(tmp_path))
    points = spark.createDataFrame([("a", 5.5, 39.5), ("b", 8.5, 35.5), ("c", 8.5, 35.5), ("a", 99.0, 0.0)], "big_map string, x double, y double")
    found = {(p["big_map"], p["x"]): p["v"] for p in raster.sample(points, maps, "v").collect()}
    assert found[("a", 5.5)] is None and found[("c", 8.5)] is None and found[("a", 99.0)] is None
    assert found[("b", 8.5)] == pytest.approx(float(values[4, 3]), abs=1e-5)
    layer = geotiff.read_layer(spark, str(tmp_path / "a.tif"))
    heights = layer.mapped(F.lit(1.5))
    steps = spark.createDataFrame([("observation1", 0, 0.0, 0, 12.5, 30.5), ("observation1", 0, 0.0, 1, 14.5, 28.5)], "observation string, track bigint, offset_m double, step_idx bigint, x double, y double")
    cells = viewshed.viewshed(steps, layer, heights, 4.0)
    at = cells.join(steps, ["observation", "track", "offset_m", "step_idx"]).withColumns({"row": layer.row(F.col("y")) + F.col("drow"), "col": layer.col(F.col("x")) + F.col("dcol")})
    written = geotiff.write_viewsheds(at, F.concat(F.lit("kept/"), F.col("step_idx").cast("string"), F.lit(".tif")), layer, str(tmp_path / "out")).collect()
    share = {f"kept/{p['step_idx']}.tif": p["viewshed_vis"] for p in viewshed.viewshed_share(steps, layer, heights, 4.0).collect()}
    assert {w["name"]: w["viewshed_vis"] for w in written} == pytest.approx(share)
    assert {f"kept/{m['name']}": m["viewshed_vis"] for m in geotiff.viewshed_means(spark, str(tmp_path / "out")).collect()} == pytest.approx(share)
    curved = viewshed.viewshed_share(steps, layer, heights, 4.0, curvature=1e7)
    assert all(p["viewshed_vis"] != share[f"kept/{p['step_idx']}.tif"] for p in curved.collect())
