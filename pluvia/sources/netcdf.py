"""Classic NetCDF (CDF-1, CDF-2, CDF-5): a reader and a writer without libraries, and a Spark data source over the reader.

``spark.dataSource.register(NetcdfSource)`` then ``spark.read.format("netcdf").option("path", p).option("variable", v).load()``
gives (t, r, c, value) of a variable of two or three dimensions. The driver reads the header; a partition is a step of the first
of three dimensions, or a part of its rows, and seeks to its own bytes. ``time`` takes one step only. Several variables of equal
dimensions, separated by commas, are columns of their own. HDF5-based files are read through netCDF4 where it is installed.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from pluvia.sources import storage

#: Fixed values of the format: external types by number.
TYPES = {1: "i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8", 7: "u1", 8: ">u2", 9: ">u4", 10: ">i8", 11: ">u8"}
NUMBER = {"i1": 1, "S1": 2, "i2": 3, "i4": 4, "f4": 5, "f8": 6}
DIMENSION, VARIABLE, ATTRIBUTE = 10, 11, 12


@dataclass
class Dataset:
    dims: dict[str, int] = field(default_factory=dict)
    attrs: dict = field(default_factory=dict)
    variables: dict[str, tuple[tuple[str, ...], np.ndarray, dict]] = field(default_factory=dict)


class _Cursor:
    def __init__(self, data: bytes, version: int) -> None:
        self.data, self.at, self.wide = data, 4, version == 5

    def number(self, kind: str = "") -> int:
        code, n = (">q", 8) if (kind or ("q" if self.wide else "i")) == "q" else (">i", 4)
        (v,) = struct.unpack_from(code, self.data, self.at)
        self.at += n
        return v

    def name(self) -> str:
        n = self.number()
        out = self.data[self.at : self.at + n].decode()
        self.at += n + -n % 4
        return out

    def attributes(self) -> dict:
        self.number("i")
        out = {}
        for _ in range(self.number()):
            key, kind, n = self.name(), self.number("i"), self.number()
            size = np.dtype(TYPES[kind]).itemsize * n
            raw = self.data[self.at : self.at + size]
            self.at += size + -size % 4
            values = np.frombuffer(raw, TYPES[kind])
            out[key] = raw.decode() if kind == 2 else (values[0].item() if n == 1 else values.tolist())
        return out


@dataclass
class Entry:
    """Where a variable's values are: ``stride`` is the way from a record to the next, None for fixed variables."""

    dims: tuple[str, ...]
    shape: tuple[int, ...]
    kind: np.dtype
    attrs: dict
    begin: int
    stride: int | None


def header(data: bytes) -> tuple[Dataset, dict[str, Entry]]:
    """Dimensions, attributes and places of variables; ``data`` may end after the header."""
    if data[:3] != b"CDF" or data[3] not in (1, 2, 5):
        raise ValueError("no classic NetCDF file")
    version = data[3]
    cur = _Cursor(data, version)
    records, ds, names = cur.number(), Dataset(), []
    cur.number("i")
    for _ in range(cur.number()):
        name = cur.name()
        ds.dims[name] = cur.number()
        names.append(name)
    ds.attrs = cur.attributes()
    cur.number("i")
    found = []
    for _ in range(cur.number()):
        name = cur.name()
        dims = [cur.number() for _ in range(cur.number())]
        attrs, kind, size = cur.attributes(), cur.number("i"), cur.number()
        begin = cur.number("i" if version == 1 else "q")
        found.append((name, dims, attrs, np.dtype(TYPES[kind]), size, begin))
    unlimited = [n for n in names if ds.dims[n] == 0]
    for n in unlimited:
        ds.dims[n] = records
    of_records = [f for f in found if f[1] and names[f[1][0]] in unlimited]
    stride = sum(f[4] for f in of_records)
    if len(of_records) == 1:  # a single record variable is not padded
        _, dims, _, kind, _, _ = of_records[0]
        stride = int(np.prod([ds.dims[names[k]] for k in dims[1:]], dtype=int)) * kind.itemsize
    entries = {}
    for f in found:
        name, dims, attrs, kind, _, begin = f
        entries[name] = Entry(tuple(names[k] for k in dims), tuple(ds.dims[names[k]] for k in dims), kind, attrs, begin, stride if f in of_records else None)
    return ds, entries


def values_of(data: bytes, e: Entry) -> np.ndarray:
    if e.stride is None:
        return np.frombuffer(data, e.kind, int(np.prod(e.shape, dtype=int)), e.begin).reshape(e.shape)
    count = int(np.prod(e.shape[1:], dtype=int))
    return np.array([np.frombuffer(data, e.kind, count, e.begin + k * e.stride) for k in range(e.shape[0])], e.kind).reshape(e.shape)


def parse(data: bytes, only: str | None = None) -> Dataset:
    """The data set in ``data``; with ``only``, the values of that variable and of axes alone."""
    ds, entries = header(data)
    for name, e in entries.items():
        if only is None or name == only or name in ds.dims:
            ds.variables[name] = (e.dims, values_of(data, e), e.attrs)
    return ds


def opened(path: str) -> tuple[Dataset, dict[str, Entry]]:
    """The header of a file and its one-dimensional variables, without reading more of it."""
    size = 64 << 10
    with storage.opened(path) as f:
        while True:
            f.seek(0)
            data = f.read(size)
            try:
                ds, entries = header(data)
                break
            except (struct.error, ValueError, KeyError, IndexError):
                if len(data) < size:
                    raise
                size *= 4
        for name, e in entries.items():
            if len(e.shape) < 2:
                ds.variables[name] = (e.dims, _axis(f, e), e.attrs)
    return ds, entries


def _axis(f, e: Entry) -> np.ndarray:
    n, width = int(np.prod(e.shape, dtype=int)), e.kind.itemsize
    if e.stride is None:
        f.seek(e.begin)
        return np.frombuffer(f.read(n * width), e.kind).reshape(e.shape)
    out = []
    for k in range(n):
        f.seek(e.begin + k * e.stride)
        out.append(np.frombuffer(f.read(width), e.kind)[0])
    return np.array(out, e.kind)


def decoded(values: np.ndarray, attrs: dict) -> np.ndarray:
    """Doubles; fill values (``_FillValue``, else ``missing_value``) are NaN, scale and offset applied."""
    out = values.astype(float)
    fill = attrs.get("_FillValue", attrs.get("missing_value"))
    if fill is not None:
        out[values == np.asarray(fill).astype(values.dtype)] = np.nan
    return out * attrs.get("scale_factor", 1.0) + attrs.get("add_offset", 0.0)


def _padded(b: bytes) -> bytes:
    return b + b"\0" * (-len(b) % 4)


def _text(s: str) -> bytes:
    return struct.pack(">i", len(s.encode())) + _padded(s.encode())


def _attribute_list(attrs: dict) -> bytes:
    if not attrs:
        return struct.pack(">ii", 0, 0)
    out = [struct.pack(">ii", ATTRIBUTE, len(attrs))]
    for k, v in attrs.items():
        if isinstance(v, str):
            out += [_text(k), struct.pack(">ii", 2, len(v.encode())), _padded(v.encode())]
        else:
            a = np.atleast_1d(np.asarray(v))
            name = f"{a.dtype.kind}{a.dtype.itemsize}"
            name = name if isinstance(v, np.ndarray) and name in NUMBER else "i4" if a.dtype.kind in "iu" else "f8"
            out += [_text(k), struct.pack(">ii", NUMBER[name], len(a)), _padded(a.astype(TYPES[NUMBER[name]]).tobytes())]
    return b"".join(out)


def fill_value(kind: str, attrs: dict):
    return attrs.get("_FillValue", attrs.get("missing_value", 0))


def head(ds: Dataset) -> bytes:
    """The header of ``ds`` as a CDF-2 file with fixed dimensions; variables follow it in order, each padded to four bytes."""
    names = list(ds.dims)
    first = b"CDF\x02" + struct.pack(">i", 0) + (struct.pack(">ii", DIMENSION, len(names)) + b"".join(_text(n) + struct.pack(">i", ds.dims[n]) for n in names) if names else struct.pack(">ii", 0, 0)) + _attribute_list(ds.attrs)
    entries = []
    for name, (dims, values, attrs) in ds.variables.items():
        number = NUMBER[f"{values.dtype.kind}{values.dtype.itemsize}"]
        size = values.size * values.dtype.itemsize
        size += -size % 4
        typed = {k: np.asarray(v).astype(values.dtype) if k in ("_FillValue", "missing_value", "flag_values") else v for k, v in attrs.items()}
        entries.append((_text(name) + struct.pack(f">i{len(dims)}i", len(dims), *(names.index(x) for x in dims)) + _attribute_list(typed) + struct.pack(">ii", number, min(size, 2**31 - 4)), size))
    at = len(first) + 8 + sum(len(e) + 8 for e, _ in entries)
    out = [first, struct.pack(">ii", VARIABLE, len(entries)) if entries else struct.pack(">ii", 0, 0)]
    for e, size in entries:
        out += [e, struct.pack(">q", at)]
        at += size
    return b"".join(out)


def build(ds: Dataset) -> bytes:
    """The bytes of ``ds`` as a CDF-2 file with fixed dimensions."""
    kind = lambda v: TYPES[NUMBER[f"{v.dtype.kind}{v.dtype.itemsize}"]]
    return head(ds) + b"".join(_padded(np.ascontiguousarray(v, kind(v)).tobytes()) for _, v, _ in ds.variables.values())


#: Most values of a variable in a batch.
BATCH = 1 << 18


@dataclass
class _Slice(InputPartition):
    step: int
    first: int
    rows: int


class NetcdfReader(DataSourceReader):
    def __init__(self, path: str, variables: list[str], names: list[str], step: int | None) -> None:
        self.path, self.variables, self.names, self.step = path, variables, names, step
        _, entries = opened(path)
        missing = [v for v in variables if v not in entries]
        if missing:
            raise ValueError(f"{path} has no variable {', '.join(missing)}")
        self.entries = [entries[v] for v in variables]
        if len({e.shape for e in self.entries}) > 1 or len(self.entries[0].shape) not in (2, 3):
            raise ValueError("variables need two or three dimensions, and the same ones")

    def partitions(self):
        shape = self.entries[0].shape
        steps, (rows, cols) = (shape[0] if len(shape) == 3 else 1), shape[-2:]
        if self.step is not None and not 0 <= self.step < steps:
            raise ValueError(f"time {self.step} is not among {steps} steps")
        each = max(1, 4 * BATCH // max(1, cols))
        return [_Slice(k, r, min(each, rows - r)) for k in (range(steps) if self.step is None else [self.step]) for r in range(0, rows, each)]

    def read(self, partition):
        import pyarrow as pa

        rows, cols = self.entries[0].shape[-2:]
        each = max(1, BATCH // max(1, cols))
        with storage.opened(self.path) as f:
            for r in range(partition.first, partition.first + partition.rows, each):
                n = min(each, partition.first + partition.rows - r)
                columns = []
                for e in self.entries:
                    plane = partition.step * (rows * cols * e.kind.itemsize if e.stride is None else e.stride) if len(e.shape) == 3 else 0
                    f.seek(e.begin + plane + r * cols * e.kind.itemsize)
                    x = decoded(np.frombuffer(f.read(n * cols * e.kind.itemsize), e.kind), e.attrs)
                    columns.append(pa.array(x, from_pandas=True))
                place = [np.full(n * cols, partition.step, np.int32), np.repeat(np.arange(r, r + n, dtype=np.int32), cols), np.tile(np.arange(cols, dtype=np.int32), n)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, place), *columns], names=["t", "r", "c", *self.names])


class NetcdfSource(DataSource):
    """For a file on a path or URI that every executor can open, read by ranges; tables of many files go through ``read_files``."""

    @classmethod
    def name(cls) -> str:
        return "netcdf"

    def _variables(self) -> list[str]:
        return [v.strip() for v in self.options["variable"].split(",")]

    def _names(self) -> list[str]:
        v = self._variables()
        return ["value"] if len(v) == 1 else v

    def schema(self) -> str:
        return "t int, r int, c int, " + ", ".join(f"`{n}` double" for n in self._names())

    def reader(self, schema):
        step = self.options.get("time")
        return NetcdfReader(self.options["path"], self._variables(), self._names(), None if step is None else int(step))


def read_files(spark, path: str, variable: str):
    """(file, t, r, c, value) of classic files under a Spark path (any file system), missing values NULL."""
    import pandas as pd

    def rows(batches):
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                _, values, attrs = parse(content, variable).variables[variable]
                x = decoded(values, attrs)
                x = x if x.ndim == 3 else x[None]
                for t, plane in enumerate(x):
                    each = max(1, BATCH // max(1, plane.shape[1]))
                    for lo in range(0, plane.shape[0], each):
                        part = plane[lo : lo + each]
                        r, c = np.indices(part.shape)
                        yield pd.DataFrame({"file": name, "t": t, "r": r.ravel() + lo, "c": c.ravel(), "value": part.ravel()})

    d = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(rows, "file string, t int, r int, c int, value double")
    from pyspark.sql import functions as F

    return d.withColumn("value", F.when(~F.isnan("value"), F.col("value")))
