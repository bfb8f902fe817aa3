"""Height rasters (GeoTIFF) as a data source: one row for each strip or tile of a file's first band.

    spark.dataSource.register(RasterSource)
    spark.read.format("height_raster").option("window", "385000,6671000,386000,6672000").load("hdfs://.../heights")

The driver lists the files and reads their directories only. Tasks read strips and tiles at their offsets, each partition some
megabytes of them, so a file may be of any size and a lost task repeats its own blocks alone. ``window`` (west, south, east, north, in the
raster's own units) leaves out blocks that don't touch it before anything is read. Cells without data are NaN.

Read are whole and floating numbers of 8 to 64 bits, north up, stored or packed by deflate, with either predictor, in classic and big files.
Refused, by a ValueError with the reason: files of different reference systems, rotated ones, ones without a place, and other packings.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from velonet.sources.shared import list_files, open_file

# Fixed values of the format: tags, the types of their values, and the keys that name a reference system.
COLS, ROWS, BITS, COMPRESSION, STRIP_OFFSETS, SAMPLES, STRIP_ROWS, STRIP_SIZES = 256, 257, 258, 259, 273, 277, 278, 279
PLANAR, PREDICTOR, TILE_COLS, TILE_ROWS, TILE_OFFSETS, TILE_SIZES, FORMAT = 284, 317, 322, 323, 324, 325, 339
CELL_SIZE, TIE_POINT, TRANSFORM, GEO_KEYS, NO_DATA = 33550, 33922, 34264, 34735, 42113
TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "2I", 6: "b", 7: "s", 8: "h", 9: "i", 10: "2i", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
GEOGRAPHIC, PROJECTED, RASTER_TYPE, POINTS = 2048, 3072, 1025, 2

#: Packed bytes of blocks that one partition takes.
PARTITION_BYTES = 16 << 20
SCHEMA = "tile string, block_row int, block_col int, heights array<float>"
_ARROW = pa.schema([("tile", pa.string()), ("block_row", pa.int32()), ("block_col", pa.int32()), ("heights", pa.list_(pa.float32()))])


@dataclass(frozen=True)
class Raster:
    """A file's first band: where it lies and how its blocks are stored. ``spans`` are (offset, bytes) of the blocks, row by row."""

    path: str
    crs: int
    west: float
    north: float
    dx: float
    dy: float
    rows: int
    cols: int
    block_rows: int
    block_cols: int
    tiled: bool
    dtype: str
    samples: int
    compression: int
    predictor: int
    nodata: float | None
    spans: tuple[tuple[int, int], ...]

    @property
    def across(self) -> int:
        return -(-self.cols // self.block_cols)

    def touches(self, i: int, window: tuple[float, float, float, float] | None) -> bool:
        if window is None:
            return True
        west, south, east, north = window
        row, col = i // self.across * self.block_rows, i % self.across * self.block_cols
        left, top = self.west + col * self.dx, self.north - row * self.dy
        return left <= east and left + self.block_cols * self.dx >= west and top >= south and top - self.block_rows * self.dy <= north

    def block(self, i: int, packed: bytes) -> np.ndarray:
        """The heights of block ``i``, as 32-bit numbers; a block that isn't stored has no data."""
        rows = self.block_rows if self.tiled else min(self.block_rows, self.rows - i // self.across * self.block_rows)
        shape = (rows, self.block_cols, self.samples)
        if not packed:
            return np.full(shape[:2], np.nan, np.float32)
        raw = packed if self.compression == 1 else zlib.decompress(packed)
        kind = np.dtype(self.dtype)
        if self.predictor == 3:  # differences of the bytes of a row, which lie most significant first
            planes = np.frombuffer(raw, np.uint8).reshape(rows, -1, self.samples)
            planes = np.cumsum(planes, axis=1, dtype=np.uint8).reshape(rows, kind.itemsize, -1)
            values = np.ascontiguousarray(planes.transpose(0, 2, 1)).view(kind.newbyteorder(">")).reshape(shape)
        else:
            values = np.frombuffer(raw, kind).reshape(shape)
            if self.predictor == 2:
                values = np.cumsum(values, axis=1, dtype=kind.newbyteorder("="))
        first = values[:, :, 0]
        out = first.astype(np.float32)
        if self.nodata is not None:
            out[first == (np.float32(self.nodata) if kind.itemsize == 4 and kind.kind == "f" else self.nodata)] = np.nan
        return out


def _directory(f) -> tuple[str, dict[int, tuple]]:
    """Byte order and values by tag of a file's first image."""
    order = {b"II": "<", b"MM": ">"}.get(f.read(2))
    version = struct.unpack(f"{order}H", f.read(2))[0] if order else 0
    if version not in (42, 43):
        raise ValueError("not a TIFF file")
    big = version == 43
    if big:
        f.read(4)
    word, entry, slot = ("Q", 20, 8) if big else ("I", 12, 4)
    (at,) = struct.unpack(order + word, f.read(slot))
    f.seek(at)
    (n,) = struct.unpack(order + ("Q" if big else "H"), f.read(8 if big else 2))
    body, tags = f.read(n * entry), {}
    for i in range(n):
        tag, kind, count = struct.unpack_from(f"{order}HH{word}", body, i * entry)
        if kind not in TYPES:
            continue
        form = f"{order}{count}s" if TYPES[kind] == "s" else f"{order}{count * (2 if kind in (5, 10) else 1)}{TYPES[kind][-1]}"
        size, place = struct.calcsize(form), i * entry + entry - slot
        if size <= slot:
            tags[tag] = struct.unpack_from(form, body, place)
        else:
            f.seek(struct.unpack_from(order + word, body, place)[0])
            tags[tag] = struct.unpack(form, f.read(size))
    return order, tags


def head(path: str) -> Raster:
    """What a file says of its first band."""
    with open_file(path) as f:
        order, t = _directory(f)

    def refuse(why: str) -> None:
        raise ValueError(f"{path}: {why}")

    one = lambda tag, default=None: t[tag][0] if tag in t else default
    if one(COMPRESSION, 1) not in (1, 8, 32946):
        refuse(f"packing {one(COMPRESSION)} is not read")
    if TRANSFORM in t or CELL_SIZE not in t or TIE_POINT not in t:
        refuse("rotated, or without a place")
    keys = t.get(GEO_KEYS, ())
    named = {keys[i]: keys[i + 3] for i in range(4, len(keys) - 3, 4) if keys[i + 1] == 0}
    dx, dy = t[CELL_SIZE][:2]
    col, row, _, x, y = t[TIE_POINT][:5]
    if named.get(RASTER_TYPE) == POINTS:  # the tie point is a cell's centre
        col, row = col + 0.5, row + 0.5
    tiled, samples = TILE_OFFSETS in t, one(SAMPLES, 1)
    rows, cols = one(ROWS), one(COLS)
    block_rows, block_cols = (one(TILE_ROWS), one(TILE_COLS)) if tiled else (min(one(STRIP_ROWS, rows), rows), cols)
    kind, bits, predictor = {1: "u", 2: "i", 3: "f"}.get(one(FORMAT, 1)), one(BITS, 1), one(PREDICTOR, 1)
    if kind is None or bits not in (8, 16, 32, 64) or predictor not in (1, 2, 3):
        refuse(f"numbers of form {one(FORMAT)}, {bits} bits and predictor {predictor} are not read")
    spans = tuple(zip(t[TILE_OFFSETS], t[TILE_SIZES]) if tiled else zip(t[STRIP_OFFSETS], t[STRIP_SIZES]))
    # bands stored apart follow each other: the first one's blocks come first
    apart = one(PLANAR, 1) == 2
    blocks = -(-rows // block_rows) * -(-cols // block_cols)
    nodata = t[NO_DATA][0].split(b"\0")[0].strip() if NO_DATA in t else b""
    return Raster(path, named.get(PROJECTED, named.get(GEOGRAPHIC, 0)), x - col * dx, y + row * dy, dx, dy, rows, cols, block_rows, block_cols, tiled, f"{order}{kind}{bits // 8}", 1 if apart else samples, one(COMPRESSION, 1), predictor, float(nodata) if nodata else None, spans[:blocks])


def heads(path: str) -> list[Raster]:
    """The rasters of a file or folder, by name, all of one reference system."""
    found = [head(p) for p in list_files(path, (".tif", ".tiff"))]
    if not found:
        raise ValueError(f"no rasters at {path}")
    for r in found[1:]:
        if r.crs != found[0].crs:
            raise ValueError(f"{r.path} is in {r.crs}, expected {found[0].crs}")
    return found


@dataclass
class Blocks(InputPartition):
    """Blocks of a raster: (number, offset, bytes) of each."""

    raster: Raster
    spans: list[tuple[int, int, int]]


class RasterReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        window = options.get("window")
        self.path, self.most = options["path"], int(options.get("partitionbytes", PARTITION_BYTES))
        self.window = tuple(map(float, window.split(","))) if window else None

    def partitions(self) -> list[Blocks]:
        parts: list[Blocks] = []
        for raster in heads(self.path):
            slim, held, size = replace(raster, spans=()), [], 0
            for i, (offset, n) in enumerate(raster.spans):
                if not raster.touches(i, self.window):
                    continue
                if held and size + n > self.most:
                    parts.append(Blocks(slim, held))
                    held, size = [], 0
                held, size = [*held, (i, offset, n)], size + n
            if held:
                parts.append(Blocks(slim, held))
        return parts

    def read(self, partition: Blocks) -> Iterator[pa.RecordBatch]:
        if not isinstance(partition, Blocks):  # nothing touches the window
            return
        r = partition.raster
        with open_file(r.path) as f:
            for i, offset, n in partition.spans:
                f.seek(offset)
                heights = r.block(i, f.read(n) if n else b"").ravel()
                rows = [pa.array([r.path]), pa.array([i // r.across], pa.int32()), pa.array([i % r.across], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(heights)], pa.int32()), pa.array(heights))]
                yield pa.RecordBatch.from_arrays(rows, schema=_ARROW)


class RasterSource(DataSource):
    """Options: path (a file or a folder of .tif files), window, partitionBytes."""

    @classmethod
    def name(cls) -> str:
        return "height_raster"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> RasterReader:
        return RasterReader(self.options)


def blocks(spark: SparkSession, path: str, window: tuple[float, float, float, float] | None = None) -> DataFrame:
    """(tile, block_row, block_col, heights): the blocks that touch ``window``."""
    spark.dataSource.register(RasterSource)
    reader = spark.read.format("height_raster")
    return (reader.option("window", ",".join(map(repr, window))) if window else reader).load(path)


def tiles(spark: SparkSession, path: str) -> DataFrame:
    """(tile, rank, crs, west, north, dx, dy, rows, cols, block_rows, block_cols): one row for each file, ranked by name."""
    rows = [(r.path, i, r.crs, r.west, r.north, r.dx, r.dy, r.rows, r.cols, r.block_rows, r.block_cols) for i, r in enumerate(heads(path))]
    return spark.createDataFrame(rows, "tile string, rank int, crs int, west double, north double, dx double, dy double, rows int, cols int, block_rows int, block_cols int")
