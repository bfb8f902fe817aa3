"""Rasters written here give the heights of the plain arrays they were made of."""

import math
import random
import struct
import zlib

import numpy as np
import pytest

from velonet.operators import profile
from velonet.sources import raster


def packed(block, predictor, deflate):
    if predictor == 2:
        block = np.diff(block, axis=1, prepend=block[:, :1] * 0).astype(block.dtype)
    if predictor == 3:
        rows, cols = block.shape
        planes = block.astype(block.dtype.newbyteorder(">")).view(np.uint8).reshape(rows, cols, -1).transpose(0, 2, 1).reshape(rows, -1)
        block = np.diff(planes, axis=1, prepend=planes[:, :1] * 0).astype(np.uint8)
    raw = block.tobytes()
    return zlib.compress(raw) if deflate else raw


def write(path, heights, west, north, cell, order="<", side=None, strip=3, predictor=1, deflate=True, nodata=None, crs=3067, big=False, skip=(), extra=()):
    """One band, in tiles of ``side`` or strips of ``strip`` rows; blocks in ``skip`` are not stored."""
    rows, cols = heights.shape
    heights = heights.astype(heights.dtype.newbyteorder(order))
    if side:
        padded = np.zeros((-(-rows // side) * side, -(-cols // side) * side), heights.dtype)
        padded[:rows, :cols] = heights
        blocks = [padded[r : r + side, c : c + side] for r in range(0, rows, side) for c in range(0, cols, side)]
    else:
        blocks = [heights[r : r + strip] for r in range(0, rows, strip)]
    body, spans, at = b"", [], 16
    for i, b in enumerate(blocks):
        raw = b"" if i in skip else packed(b, predictor, deflate)
        spans.append((at + len(body) if raw else 0, len(raw)))
        body += raw
    kind = {"u": 1, "i": 2, "f": 3}[heights.dtype.kind]
    tags = {256: ("I", [cols]), 257: ("I", [rows]), 258: ("H", [heights.dtype.itemsize * 8]), 259: ("H", [8 if deflate else 1]), 277: ("H", [1]), 317: ("H", [predictor]), 339: ("H", [kind]), 33550: ("d", [cell, cell, 0.0]), 33922: ("d", [0.0, 0.0, 0.0, west, north, 0.0])}
    tags[34735] = ("H", [1, 1, 0, 2, 1024, 0, 1, 1, 3072 if crs > 5000 or crs == 3067 else 2048, 0, 1, crs])
    offsets, sizes = zip(*spans)
    tags |= {322: ("H", [side]), 323: ("H", [side]), 324: ("I", offsets), 325: ("I", sizes)} if side else {273: ("I", offsets), 278: ("I", [strip]), 279: ("I", sizes)}
    if nodata is not None:
        tags[42113] = ("s", f"{nodata}\0".encode())
    tags |= dict(extra)
    word, slot = ("Q", 8) if big else ("I", 4)
    numbers = {"H": 3, "I": 4, "d": 12, "s": 2}
    start = at + len(body)
    far = start + (8 if big else 2) + len(tags) * (20 if big else 12) + slot
    entries, tail = b"", b""
    for tag, (form, values) in sorted(tags.items()):
        raw = bytes(values) if form == "s" else struct.pack(f"{order}{len(values)}{form}", *values)
        count = len(values)
        if len(raw) > slot:
            raw, tail = struct.pack(order + word, far + len(tail)), tail + raw
        entries += struct.pack(f"{order}HH{word}", tag, numbers[form], count) + raw.ljust(slot, b"\0")
    first = {"<": b"II", ">": b"MM"}[order] + (struct.pack(f"{order}HHHQ", 43, 8, 0, start) if big else struct.pack(f"{order}HI", 42, start))
    path.write_bytes(first.ljust(16, b"\0") + body + struct.pack(order + ("Q" if big else "H"), len(tags)) + entries + struct.pack(order + word, 0) + tail)


def read(spark, path, window=None):
    """The cells of a file, from its blocks."""
    r = raster.head(str(path))
    out = np.full((r.rows + r.block_rows, r.cols + r.block_cols), -1.0, np.float32)
    got = raster.blocks(spark, str(path), window).collect()
    for b in got:
        block = np.array(b.heights, np.float32).reshape(-1, r.block_cols)
        out[b.block_row * r.block_rows : b.block_row * r.block_rows + len(block), b.block_col * r.block_cols : (b.block_col + 1) * r.block_cols] = block
    return out[: r.rows, : r.cols], len(got)


FORMS = [("f4", 1, "<", 4, True, False), ("f4", 3, "<", 4, True, True), ("f8", 3, ">", None, True, False), ("i2", 2, ">", 4, True, False), ("u2", 2, "<", None, True, False), ("i4", 1, ">", None, False, False), ("u1", 2, "<", 8, True, False), ("f4", 1, ">", None, False, True)]


@pytest.mark.parametrize("form", FORMS, ids=lambda f: "-".join(map(str, f)))
def test_blocks_equal_the_array(spark, tmp_path, form):
    dtype, predictor, order, side, deflate, big = form
    rng = np.random.default_rng(5)
    heights = rng.integers(0, 200, (10, 13)).astype(dtype) + (rng.random((10, 13)).astype(dtype) if dtype[0] == "f" else np.zeros((10, 13), dtype))
    heights[2, 3] = heights[9, 12] = 99
    write(tmp_path / "a.tif", heights, 385_000.0, 6_672_000.0, 10.0, order, side, 3, predictor, deflate, nodata=99, big=big)
    want = heights.astype(np.float32)
    want[heights == 99] = np.nan
    got, _ = read(spark, tmp_path / "a.tif")
    np.testing.assert_array_equal(got, want)


def test_a_window_leaves_out_blocks(spark, tmp_path):
    heights = np.arange(400, dtype="f4").reshape(20, 20)
    write(tmp_path / "a.tif", heights, 0.0, 200.0, 10.0, side=5, skip=(15,))
    assert read(spark, tmp_path / "a.tif")[1] == 16
    got, n = read(spark, tmp_path / "a.tif", (60.0, 110.0, 90.0, 140.0))
    assert n == 1 and got[7, 7] == heights[7, 7] and got[0, 0] == -1
    assert np.isnan(read(spark, tmp_path / "a.tif")[0][15:, 15:]).all()  # not stored
    assert read(spark, tmp_path / "a.tif", (900.0, 900.0, 901.0, 901.0))[1] == 0
    spark.dataSource.register(raster.RasterSource)
    assert spark.read.format("height_raster").option("partitionBytes", 100).load(str(tmp_path / "a.tif")).rdd.getNumPartitions() > 4


def test_sampling_equals_the_arrays(spark, tmp_path):
    rng = np.random.default_rng(8)
    specs, arrays = [("a.tif", 24.0, 61.0, 0.01, 8), ("b.tif", 24.05, 60.98, 0.005, None), ("c.tif", 23.5, 60.2, 0.02, 16)], {}
    for name, west, north, cell, side in specs:
        h = rng.random((21, 17)).astype("f4") * 50
        h[rng.random(h.shape) < 0.3] = -9999
        write(tmp_path / name, h, west, north, cell, side=side, predictor=3, nodata=-9999, crs=4326)
        arrays[name] = h

    def brute(lon, lat):
        for name, west, north, cell, _ in specs:
            h = arrays[name]
            if lon is None or lat is None or not (west <= lon < west + h.shape[1] * cell and north - h.shape[0] * cell < lat <= north):
                continue
            v = h[min(int((north - lat) / cell), h.shape[0] - 1), min(int((lon - west) / cell), h.shape[1] - 1)]
            if v != -9999:
                return float(v)
        return None

    pick = random.Random(2)
    pts = [(i, pick.uniform(23.98, 24.2), pick.uniform(60.8, 61.02), "x") for i in range(300)] + [(i, pick.uniform(23.45, 23.9), pick.uniform(59.7, 60.25), "x") for i in range(300, 500)] + [(900, None, 60.0, "x"), (901, 24.0, 61.0, "x"), (902, float("24.2"), 60.9, None), (903, 0.0, 0.0, "x")]
    df = spark.createDataFrame(pts, "p long, lon double, lat double, tile string")
    out = profile.sample_raster(df.drop("tile"), str(tmp_path), ["p"])
    got = {r.p: r.height for r in out.collect()}
    assert got == {p: brute(lon, lat) for p, lon, lat, _ in pts} and sum(v is not None for v in got.values()) > 100
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert [r.height for r in profile.sample_raster(df.filter("p = 900"), str(tmp_path), ["p"]).collect()] == [None]
    assert profile.sample_raster(df.limit(0), str(tmp_path), ["p"]).count() == 0


def test_sampling_projects(spark, tmp_path):
    # 24.94 E, 60.17 N lies at 385,700 east and 6,672,300 north to within some hundred metres
    h = np.arange(10_000, dtype="f4").reshape(100, 100)
    write(tmp_path / "g.tif", h, 385_000.0, 6_673_000.0, 20.0, side=16)
    from velonet.functions import geo

    df = spark.createDataFrame([(i, 24.93 + i * 0.002, 60.165 + i * 0.001) for i in range(8)], "p long, lon double, lat double")
    x, y = geo.to_grid("lon", "lat", 3067)
    places = {r.p: (r.x, r.y) for r in df.select("p", x.alias("x"), y.alias("y")).collect()}
    got = {r.p: r.height for r in profile.sample_raster(df, str(tmp_path), ["p"]).collect()}
    inside = {p: (math.floor((6_673_000 - y) / 20), math.floor((x - 385_000) / 20)) for p, (x, y) in places.items()}
    assert got == {p: float(h[r, c]) if 0 <= r < 100 and 0 <= c < 100 else None for p, (r, c) in inside.items()} and any(v is not None for v in got.values())


def test_refusals(tmp_path, spark):
    h = np.zeros((4, 4), "f4")
    write(tmp_path / "a.tif", h, 0.0, 4.0, 1.0)
    write(tmp_path / "b.tif", h, 4.0, 4.0, 1.0, crs=3879)
    with pytest.raises(ValueError, match="is in 3879, expected 3067"):
        raster.heads(str(tmp_path))
    write(tmp_path / "lzw.tif", h, 0.0, 4.0, 1.0, extra=[(259, ("H", [5]))])
    with pytest.raises(ValueError, match="packing 5"):
        raster.head(str(tmp_path / "lzw.tif"))
    write(tmp_path / "turned.tif", h, 0.0, 4.0, 1.0, extra=[(34264, ("d", [0.0] * 16))])
    with pytest.raises(ValueError, match="rotated"):
        raster.head(str(tmp_path / "turned.tif"))
    (tmp_path / "no.tif").write_bytes(b"text, not a raster")
    with pytest.raises(ValueError, match="not a TIFF"):
        raster.head(str(tmp_path / "no.tif"))
    with pytest.raises(ValueError, match="no rasters"):
        raster.heads(str(tmp_path / "none") if (tmp_path / "none").mkdir() is None else "")
    write(tmp_path / "none" / "u.tif", h, 0.0, 4.0, 1.0, crs=32635)
    with pytest.raises(ValueError, match="32635"):
        profile.sample_raster(spark.createDataFrame([(1, 1.0, 1.0)], "p long, lon double, lat double"), str(tmp_path / "none"), ["p"])
