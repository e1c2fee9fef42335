"""Helpers shared by the training-data operators: shared storage, byte-level words, hashing, components."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: ASCII white space of the word rule ``[^\x20\x09-\x0D]+``.
WHITE = bytes([0x20, 9, 10, 11, 12, 13])
#: A batch of texts is cut into runs of about this many bytes before NumPy sees it.
RUN_BYTES = 512 << 10
#: Arrow batches to and from Python workers end at this many bytes (a longer row is a batch of its own).
BATCH_BYTES = 4 << 20
#: Shares of a key that may be hot.
SALTS = 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; unset, a temporary one in local mode only."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = "file://" + os.path.join(tempfile.gettempdir(), "pluvia-checkpoints")
        spark.conf.set("spark.checkpoint.dir", path)
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` as Parquet below :func:`shared_dir` and reads it again: lineage ends there, lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that :func:`stored` wrote and that no plan reads any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def in_batches(df: DataFrame, f: Callable, schema: str | StructType, arrow: bool = False) -> DataFrame:
    """``df.mapInPandas`` (or ``mapInArrow``) with Arrow batches bounded by bytes, so that long rows do not pile up in a Python worker."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.mapInArrow(f, schema) if arrow else df.mapInPandas(f, schema)


def free(name: str, taken: Iterable[str]) -> str:
    """``name``, with underscores added until no column of ``taken`` has it (Spark does not tell cases apart)."""
    taken = {c.lower() for c in taken}
    while name.lower() in taken:
        name += "_"
    return name


def named(docs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, str, bool]:
    """(``docs`` with a column that names its rows, that column, whether ids do): ids where every row has one of its own.

    Otherwise rows are named by a 64-bit hash of id and text, so that rows of one name are equal in both. Only ids are
    shuffled to find out.
    """
    odd = docs.groupBy(F.col(key).alias("id")).agg(F.count("*").alias("m")).where("id is null or m > 1")
    plain, name = odd.isEmpty(), free("row_id", docs.columns)
    k = F.col(key).cast("long")
    return docs.withColumn(name, k if plain else F.xxhash64(k, F.col(text))), name, plain


def looked_up(rows: DataFrame, on: str, own: str, values: DataFrame) -> DataFrame:
    """``rows`` left-joined to ``values`` (``on`` its key). A third of all rows may hold one value of ``on``: ``own`` spreads it."""
    salt = free("salt", rows.columns + values.columns)
    rows = rows.withColumn(salt, F.pmod(F.xxhash64(own), F.lit(SALTS)).cast("int"))
    return rows.join(rows.select(on, salt).distinct().join(values, on), [on, salt], "left").drop(salt)


def bucket(col: str, mod: int) -> F.Column:
    """crc32 of the decimal text of an id, modulo ``mod``: the fold rule of the classifiers; null for a null id."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % mod


def held_out(col: str, fold: tuple[int, int]) -> F.Column:
    """Is the id in the fold that is not learnt from? Rows without an id are not learnt from either, but belong to no fold."""
    return F.coalesce(bucket(col, fold[0]) == fold[1], F.lit(False)).alias("held_out")


def settled(labels: DataFrame, label: str, where: F.Column) -> DataFrame:
    """(doc_id, ``label``) of ids that ``labels`` calls 0 or 1 without contradicting itself; rows of ids that fulfil ``where``."""
    known = labels.select("doc_id", F.col(label).cast("int").alias(label)).where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & where)
    return known.groupBy("doc_id").agg(F.min(label).alias(label), F.max(label).alias("most")).where(F.col(label) == F.col("most")).drop("most")


def shortest(rows: DataFrame, label: str) -> list:
    """For each label the shortest of ``rows`` (doc_id, text, ``label``): what is learnt from where all texts are beyond a bound."""
    least = F.min(F.struct(F.octet_length("text"), F.xxhash64("doc_id", "text"), "doc_id", "text")).alias("r")
    return [(r["r"]["text"], r[label]) for r in rows.where("text <> ''").groupBy(label).agg(least).orderBy(label).collect()]  # two rows


def bounded_sample(df: DataFrame, by: str, limit: int, key: str = "doc_id", seed: int = 7) -> DataFrame:
    """About ``limit`` rows for each value of ``by``, chosen by a hash of ``key``: same rows however the table is split."""
    counts = {r[0]: r[1] for r in df.groupBy(by).count().collect()}
    rate = F.lit(0.0)
    for value, n in counts.items():
        rate = F.when(F.col(by).eqNullSafe(F.lit(value)), F.lit(min(1.0, limit / n))).otherwise(rate)
    draw = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1 << 20)) / float(1 << 20)
    return df.where(draw < rate)


# --- bytes -------------------------------------------------------------------------------------------------------

_M = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_M), -1, 1 << 64))
_LETTER = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_powers = np.ones(1, np.uint64)
_inverse_powers = np.ones(1, np.uint64)
IS_WHITE = np.zeros(256, bool)
IS_WHITE[list(WHITE)] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverse_powers
    if len(_powers) < n:
        size = max(n, RUN_BYTES + 4096)
        p, q = np.full(size, _M), np.full(size, _INVERSE)
        p[0] = q[0] = 1
        _powers, _inverse_powers = np.multiply.accumulate(p), np.multiply.accumulate(q)
    return _powers[:n], _inverse_powers[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def runs(texts: list[bytes], size: int = RUN_BYTES) -> Iterator[tuple[int, int]]:
    """Index ranges of consecutive texts of about ``size`` bytes; a longer text is alone."""
    start = total = 0
    for i, t in enumerate(texts):
        if i > start and total + len(t) > size:
            yield start, i
            start, total = i, 0
        total += len(t) + 1
    if start < len(texts):
        yield start, len(texts)


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes, a line feed after each, and where each text begins (with the end as last)."""
    data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    return data, np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]).astype(np.int64)


def words(data: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and 64-bit hash of every white-space separated word in ``data`` (which ends with white space)."""
    solid = ~IS_WHITE[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], solid, [False]]).view(np.int8)))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return start, end, np.zeros(0, np.uint64)
    p, q = powers(len(data))
    value = _LETTER[LOWER[data] if lower else data] * p
    value[~solid] = 0
    return start, end, mixed(np.add.reduceat(value, start) * q[start] + (end - start).astype(np.uint64))


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """Hash of the ``k`` bytes that start at each place."""
    p, q = powers(len(data))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_LETTER[data] * p, dtype=np.uint64)])
    return mixed((total[k:] - total[:-k]) * q[: len(total) - k])


def utf8(values) -> list[bytes]:
    """Texts as UTF-8; null is empty."""
    return [v.encode("utf-8", "surrogatepass") if isinstance(v, str) else b"" for v in values]


# --- components --------------------------------------------------------------------------------------------------


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(id, component) of every vertex of ``edges`` (a, b); the component is its smallest id.

    Each round hooks every root under its smallest neighbour, shortens the paths by pointer jumping and keeps only edges
    between different roots, so that edges shrink geometrically. All steps are hash aggregates and joins on ids; every round
    is written to the shared folder.
    """
    edges = stored(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{label}-edges")
    root = edges.select(F.col("a").alias("id")).union(edges.select("b")).distinct().select("id", F.col("id").alias("component"))
    root = stored(root, f"{label}-root")
    while not edges.isEmpty():
        hook = stored(edges.groupBy(F.col("b").alias("root")).agg(F.min("a").alias("up")), f"{label}-hook")
        while True:
            far = hook.select(F.col("root").alias("up"), F.col("up").alias("top"))
            further = stored(hook.join(far, "up", "left").select("root", F.coalesce("top", "up").alias("up"), F.col("top").isNotNull().alias("moved")), f"{label}-hook")
            discard(hook)
            hook = further
            if hook.where("moved").isEmpty():
                break
            hook = hook.drop("moved")
            hook.stored_at = further.stored_at
        to = lambda df, col: df.join(hook.select(F.col("root").alias(col), F.col("up").alias(f"{col}_up")), col, "left").withColumn(col, F.coalesce(f"{col}_up", col)).drop(f"{col}_up")
        spent = [root, edges, hook]
        root = stored(to(root, "component"), f"{label}-root")
        edges = to(to(edges, "a"), "b").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        edges = stored(edges, f"{label}-edges")
        discard(*spent)
    return root.select("id", "component")
