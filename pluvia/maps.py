"""Maps: shaded relief with a value on top, drawn from a grid that Spark has reduced to the picture's size. PNG without libraries."""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Colours of the four risk classes and of the scale of depths, from low to high: both get darker, so that they read without colour too.
RISK_COLOURS = ("#f1e3d3", "#d9a679", "#a8553c", "#5c1a2e")
DEPTH_COLOURS = ("#e6f4f1", "#a3d5cf", "#5aa9b0", "#2b7088", "#123a5a")


def png(rgb: np.ndarray) -> bytes:
    """A picture of (rows, columns, 3) bytes."""
    h, w, _ = rgb.shape
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    lines = np.concatenate([np.zeros((h, 1), np.uint8), rgb.astype(np.uint8).reshape(h, w * 3)], axis=1)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")


def pixels(cells: DataFrame, width: int, height: int, rows: int, cols: int, value: str) -> DataFrame:
    """(py, px, shade, value): means of cells (r, c, shade, value) by pixel; at most ``width * height`` rows."""
    at = lambda c, n, size: F.floor(F.col(c) * min(size, n) / n).cast("int")
    return cells.groupBy(at("r", rows, height).alias("py"), at("c", cols, width).alias("px")).agg(F.avg("shade").alias("shade"), F.avg(value).alias("value"))


def coloured(shade: np.ndarray, value: np.ndarray, top: float, colours: tuple[str, ...] = DEPTH_COLOURS, classes: bool = False) -> np.ndarray:
    """Relief in grey with colours where there is a value, up to ``top``; in steps with ``classes``."""
    table = np.array([[int(c[k : k + 2], 16) for k in (1, 3, 5)] for c in colours], float)
    grey = np.where(np.isfinite(shade), 60 + 195 * np.nan_to_num(shade), 255)[..., None].repeat(3, -1)
    x = np.clip(np.nan_to_num(value) / max(top, 1e-12), 0, 1)
    if classes:
        over = table[np.minimum((x * len(table)).astype(int), len(table) - 1)]
    else:
        y = x * (len(table) - 1)
        k = np.minimum(y.astype(int), len(table) - 2)
        over = table[k] + (table[k + 1] - table[k]) * (y - k)[..., None]
    return np.where(np.isfinite(value)[..., None], 0.25 * grey + 0.75 * over, grey)


def draw(cells: DataFrame, value: str, top: float, rows: int, cols: int, width: int = 1000, height: int = 1000, risk: bool = False) -> bytes:
    """PNG of cells (r, c, shade, ``value``)."""
    width, height = min(width, cols), min(height, rows)
    p = pixels(cells, width, height, rows, cols, value).toPandas()  # a picture
    shade, v = (np.full((height, width), np.nan) for _ in "sv")
    shade[p["py"], p["px"]], v[p["py"], p["px"]] = p["shade"].to_numpy(float, na_value=np.nan), p["value"].to_numpy(float, na_value=np.nan)
    return png(coloured(shade, v, top, RISK_COLOURS if risk else DEPTH_COLOURS, risk))
