"""GeoTIFF rasters without libraries: first band, strips or tiles, any byte order; plain, deflated or LZW; and a plain writer.

Strips and tiles are fetched by ranges, so that a task reads its part of a raster only, on any file system. Values that are stored as
differences to their neighbours (predictor 2, whole numbers; predictor 3, floats by planes of bytes) are summed up again.
"""

from __future__ import annotations

import io
import struct
import zlib
from dataclasses import dataclass, field
from typing import BinaryIO

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pluvia.sources import storage

#: Fixed values of the format: tags by name, sizes and codes of field types, letters of sample formats.
TAGS = {"width": 256, "height": 257, "bits": 258, "compression": 259, "offsets": 273, "samples": 277, "strip_rows": 278, "counts": 279, "planar": 284, "predictor": 317, "tile_width": 322, "tile_height": 323, "tile_offsets": 324, "tile_counts": 325, "format": 339, "scale": 33550, "tie": 33922, "keys": 34735, "nodata": 42113}
FIELDS = {1: ("B", 1), 2: ("s", 1), 3: ("H", 2), 4: ("I", 4), 6: ("b", 1), 8: ("h", 2), 9: ("i", 4), 11: ("f", 4), 12: ("d", 8)}
KINDS = {1: "u", 2: "i", 3: "f"}
PLAIN, LZW, DEFLATE, ADOBE_DEFLATE = 1, 5, 8, 32946
CLEAR, END, LEAST_BITS, MOST_BITS = 256, 257, 9, 12
GEOGRAPHIC_CRS, PROJECTED_CRS = 2048, 3072


@dataclass
class Raster:
    """``values`` (rows from north to south), centres x0, y0 of the first cell, steps (dy < 0), no-data value and EPSG code."""

    values: np.ndarray
    x0: float = 0.0
    y0: float = 0.0
    dx: float = 1.0
    dy: float = -1.0
    nodata: float | None = None
    epsg: int | None = None
    attrs: dict = field(default_factory=dict)


@dataclass
class Layout:
    """What a header says: where each strip or tile lies and how its values are stored. ``place`` has no values."""

    width: int
    height: int
    kind: np.dtype
    block: tuple[int, int]  # columns and rows
    tiled: bool
    each: int  # values of a cell that lie together
    compression: int
    predictor: int
    offsets: tuple[int, ...]
    counts: tuple[int, ...]
    place: Raster

    @property
    def across(self) -> int:
        return -(-self.width // self.block[0])

    @property
    def blocks(self) -> int:
        return self.across * -(-self.height // self.block[1])


def unpack_lzw(data: bytes) -> bytes:
    """Bytes of codes of growing width, highest bit first; the width grows one code early."""
    single = [bytes([k]) for k in range(256)] + [b"", b""]
    table, out, last, width, kept, have = single[:], [], b"", LEAST_BITS, 0, 0
    for byte in data:
        kept, have = (kept << 8) | byte, have + 8
        if have < width:
            continue
        have -= width
        code, kept = kept >> have, kept & ((1 << have) - 1)
        if code == END:
            break
        if code == CLEAR:
            table, last, width = single[:], b"", LEAST_BITS
            continue
        if code > len(table) or (code == len(table) and not last):
            raise ValueError("the raster's codes are broken")
        here = table[code] if code < len(table) else last + last[:1]
        out.append(here)
        if last:
            table.append(last + here[:1])
        last = here
        width = min(MOST_BITS, max(LEAST_BITS, (len(table) + 1).bit_length()))
    return b"".join(out)


UNPACK = {PLAIN: bytes, LZW: unpack_lzw, DEFLATE: zlib.decompress, ADOBE_DEFLATE: zlib.decompress}


def _read(f: BinaryIO, at: int, n: int) -> bytes:
    f.seek(at)
    return f.read(n)


def _fields(f: BinaryIO) -> tuple[str, dict[int, tuple]]:
    head = _read(f, 0, 8)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    if order is None or struct.unpack_from(order + "H", head, 2)[0] != 42:
        raise ValueError("no classic TIFF file")
    (at,) = struct.unpack_from(order + "I", head, 4)
    (n,) = struct.unpack(order + "H", _read(f, at, 2))
    entries, out = _read(f, at + 2, 12 * n), {}
    for k in range(n):
        tag, kind, count = struct.unpack_from(order + "HHI", entries, 12 * k)
        if kind not in FIELDS:
            continue
        letter, size = FIELDS[kind]
        raw = entries[12 * k + 8 : 12 * k + 12]
        if size * count > 4:
            raw = _read(f, struct.unpack(order + "I", raw)[0], size * count)
        out[tag] = raw[:count].rstrip(b"\0").decode() if letter == "s" else struct.unpack_from(f"{order}{count}{letter}", raw)
    return order, out


def layout(f: BinaryIO) -> Layout:
    order, tags = _fields(f)
    get = lambda name, default=None: tags.get(TAGS[name], default)
    one = lambda name, default: get(name, (default,))[0]
    width, height = one("width", 0), one("height", 0)
    tiled = get("tile_offsets") is not None
    kind = np.dtype(f"{order}{KINDS[one('format', 1)]}{one('bits', 8) // 8}")
    compression, predictor = one("compression", PLAIN), one("predictor", 1)
    if compression not in UNPACK or predictor not in (1, 2, 3) or (predictor == 3) > (kind.kind == "f") or (predictor == 2) > (kind.kind in "ui"):
        raise ValueError("the raster's compression is not supported")
    scale, tie, keys, nodata = get("scale"), get("tie"), get("keys", ()), get("nodata")
    place = Raster(np.zeros((0, width), kind.newbyteorder("=")), nodata=float(nodata) if nodata else None)
    if scale and tie:
        place.dx, place.dy = scale[0], -scale[1]
        place.x0, place.y0 = tie[3] + (0.5 - tie[0]) * place.dx, tie[4] + (0.5 - tie[1]) * place.dy
    codes = {keys[k]: keys[k + 3] for k in range(4, len(keys), 4)}
    place.epsg = codes.get(PROJECTED_CRS, codes.get(GEOGRAPHIC_CRS))
    block = (one("tile_width", width), one("tile_height", height)) if tiled else (width, min(one("strip_rows", height), height))
    at = ("tile_offsets", "tile_counts") if tiled else ("offsets", "counts")
    return Layout(width, height, kind, block, tiled, 1 if one("planar", 1) == 2 else one("samples", 1), compression, predictor, get(at[0]), get(at[1]), place)


def block_values(f: BinaryIO, t: Layout, k: int) -> tuple[int, int, np.ndarray]:
    """(first row, first column, values) of strip or tile ``k``, cut at the raster's edge."""
    w, h = t.block
    r, c = k // t.across * h, k % t.across * w
    rows, size = (h if t.tiled else min(h, t.height - r)), t.kind.itemsize
    data = UNPACK[t.compression](_read(f, t.offsets[k], t.counts[k]))
    if t.predictor == 3:  # a row's highest bytes come first, then the next ones; differences run over bytes
        planes = np.frombuffer(data, np.uint8, rows * w * t.each * size).reshape(rows, w * size, t.each).cumsum(axis=1, dtype=np.uint8)
        values = np.ascontiguousarray(planes.reshape(rows, size, w * t.each).transpose(0, 2, 1)).view(t.kind.newbyteorder(">")).reshape(rows, w, t.each)
    else:
        values = np.frombuffer(data, t.kind, rows * w * t.each).reshape(rows, w, t.each)
    if t.predictor == 2:
        values = values.astype(t.kind.newbyteorder("=")).cumsum(axis=1, dtype=t.kind.newbyteorder("="))
    return r, c, values[: t.height - r, : t.width - c, 0].astype(t.kind.newbyteorder("="))


def parse(data: bytes) -> Raster:
    f = io.BytesIO(data)
    t = layout(f)
    out = t.place
    out.values = np.zeros((t.height, t.width), t.kind.newbyteorder("="))
    for k in range(t.blocks):
        r, c, v = block_values(f, t, k)
        out.values[r : r + v.shape[0], c : c + v.shape[1]] = v
    return out


def place(path: str) -> tuple[int, int, Raster]:
    """(columns, rows, place without values) of one raster; reads its header only."""
    with storage.opened(path) as f:
        t = layout(f)
        return t.width, t.height, t.place


def build(r: Raster) -> bytes:
    """A little-endian file of one deflated strip."""
    v = np.ascontiguousarray(r.values)
    block = zlib.compress(v.astype(v.dtype.newbyteorder("<")).tobytes())
    letter = {"u": 1, "i": 2, "f": 3}[v.dtype.kind]
    entries = [
        ("width", 4, (v.shape[1],)), ("height", 4, (v.shape[0],)), ("bits", 3, (v.dtype.itemsize * 8,)), ("compression", 3, (DEFLATE,)), ("offsets", 4, (8,)), ("samples", 3, (1,)), ("strip_rows", 4, (v.shape[0],)),
        ("counts", 4, (len(block),)), ("format", 3, (letter,)), ("scale", 12, (r.dx, -r.dy, 0.0)), ("tie", 12, (0.0, 0.0, 0.0, r.x0 - r.dx / 2, r.y0 - r.dy / 2, 0.0)),
    ]
    if r.epsg:
        entries.append(("keys", 3, (1, 1, 0, 1, GEOGRAPHIC_CRS if r.epsg < 5000 else PROJECTED_CRS, 0, 1, r.epsg)))
    if r.nodata is not None:
        entries.append(("nodata", 2, f"{r.nodata:g}"))
    block += b"\0" * (len(block) % 2)
    at = 8 + len(block)
    spare = at + 2 + 12 * len(entries) + 4
    head, tail = struct.pack("<H", len(entries)), b""
    for name, kind, values in sorted(entries, key=lambda e: TAGS[e[0]]):
        raw = values.encode() + b"\0" if kind == 2 else struct.pack(f"<{len(values)}{FIELDS[kind][0]}", *values)
        count = len(raw) if kind == 2 else len(values)
        place = raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack("<I", spare + len(tail))
        head += struct.pack("<HHI", TAGS[name], kind, count) + place
        tail += raw if len(raw) > 4 else b""
    return b"II" + struct.pack("<HI", 42, at) + block + head + b"\0\0\0\0" + tail


def read_rasters(spark: SparkSession, path: str, cells: int = 1 << 22) -> DataFrame:
    """(k, file, r, c, x, y, value) of all rasters under a Spark path; ``k`` counts files by name, which is their order in time.

    No-data and not finite values are NULL. Headers are read first; then a task takes strips or tiles of about ``cells`` values
    and fetches their ranges, so that one large raster is many tasks' work.
    """

    def portions(batches):
        for pdf in batches:
            out = []
            for name in pdf["file"]:
                with storage.opened(name) as f:
                    t = layout(f)
                each = max(1, cells // max(1, t.block[0] * t.block[1]))
                out += [(name, lo, min(t.blocks, lo + each)) for lo in range(0, t.blocks, each)]
            yield pd.DataFrame(out, columns=["file", "first", "last"])

    def rows(batches):
        for pdf in batches:
            for name, first, last in zip(pdf["file"], pdf["first"], pdf["last"], strict=True):
                with storage.opened(name) as f:
                    t = layout(f)
                    for k in range(first, last):
                        r0, c0, v = block_values(f, t, k)
                        x = v.astype(float)
                        if t.place.nodata is not None:
                            x[v == np.asarray(t.place.nodata).astype(v.dtype)] = np.nan
                        each = max(1, (1 << 18) // max(1, x.shape[1]))
                        for lo in range(0, x.shape[0], each):
                            part = x[lo : lo + each]
                            r, c = (i.ravel() for i in np.indices(part.shape))
                            r, c = r + r0 + lo, c + c0
                            yield pd.DataFrame({"file": name, "r": r, "c": c, "x": t.place.x0 + c * t.place.dx, "y": t.place.y0 + r * t.place.dy, "value": part.ravel()})

    found = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"))  # names only, no contents
    order = found.withColumn("k", F.row_number().over(Window.orderBy(F.element_at(F.split("file", "/"), -1), "file")) - 1)  # names of files
    parts = found.mapInPandas(portions, "file string, first int, last int")
    parts = parts.repartition(max(1, spark.sparkContext.defaultParallelism), "file", "first")
    d = parts.mapInPandas(rows, "file string, r int, c int, x double, y double, value double")
    return d.join(F.broadcast(order), "file").select("k", "file", "r", "c", "x", "y", F.when(~F.isnan("value"), F.col("value")).alias("value"))
