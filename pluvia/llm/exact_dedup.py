"""Exact deduplication with a heavy-hitter split: frequent digests are settled in the map, the others by an ordinary shuffle.

Texts are equal when they are identical after lower-casing A-Z; null counts as empty. Of equal texts the row with the largest id
stays.

1. Every row becomes (id, row number, SHA-256 of the normalised text); only that table is read from here on.
2. Misra-Gries summaries of ``counters`` digests are made in every task and summed up by digest. With N rows, every digest of more
   than N / (counters + 1) rows is among the ``counters`` largest sums: a task that takes c off all its counters takes it off more
   than ``counters`` of them, so all that is lost of one digest is at most (N - S) / (counters + 1), S being what is left in sums.
3. These candidates are verified: a second pass counts them exactly and finds their winners. At most ``counters`` rows come of it,
   so they are broadcast, and rows of frequent digests are settled or removed where they are read.
4. All other digests have at most N / (counters + 1) rows each; they are summed with a partial aggregate and joined back.

Nulls: a null id is smaller than any other; where all ids of equal texts are null, keep_id is null. Rows that tie in id and normalised
text: exactly one of them stays (such rows differ in letter case or in other columns at most). Empty and very long texts are texts like any
others (one digest). Empty tables give empty results. Other columns, whatever their names, are not read by
:func:`exact_copies` and stay as they are in :func:`without_copies`.
"""

from __future__ import annotations

import string

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pluvia.llm.common import free, in_batches, named, stored

#: Counters of a Misra-Gries summary, and the most rows that are broadcast (32 bytes of digest, two numbers and a count each).
COUNTERS = 1024

ORACLE = f"""
with d as (select doc_id, sha256(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')) as text_sha256 from documents)
select doc_id, max(doc_id) over same as keep_id, count(*) over same as group_size,
       row_number() over (partition by text_sha256 order by doc_id desc nulls last) = 1 as kept, text_sha256
from d window same as (partition by text_sha256)
"""


def digest(text: str = "text") -> F.Column:
    """SHA-256 of the normalised text, as bytes."""
    folded = F.translate(F.coalesce(F.col(text), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.unhex(F.sha2(folded.cast("binary"), 256))


class Summary:
    """Misra-Gries: at most ``counters`` keys, each counted too low by at most n / (counters + 1) after n rows."""

    def __init__(self, counters: int) -> None:
        self.counters, self.held = counters, {}

    def add(self, keys: list, counts: list[int]) -> None:
        held = self.held
        for k, m in zip(keys, counts, strict=True):
            held[k] = held.get(k, 0) + m
        if len(held) > self.counters:
            cut = -int(np.partition(-np.fromiter(held.values(), np.int64, len(held)), self.counters)[self.counters])
            self.held = {k: m - cut for k, m in held.items() if m > cut}


def frequent(keys: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """(digest): at most ``counters`` values of the only column of ``keys``, among them all of more than n / (counters + 1) rows."""
    (name,) = keys.columns

    def summarise(batches):
        summary = Summary(counters)
        for batch in batches:
            found = pc.value_counts(batch.column(0))
            summary.add(found.field("values").to_pylist(), found.field("counts").to_pylist())
        yield pa.RecordBatch.from_pydict({name: pa.array(list(summary.held), pa.binary()), "m": pa.array(list(summary.held.values()), pa.int64())})

    sums = in_batches(keys, summarise, f"{name} binary, m long", arrow=True).groupBy(name).agg(F.sum("m").alias("m"))
    return sums.orderBy(F.desc("m"), name).limit(counters).select(name)


def exact_copies(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, digest) of every row."""
    rows = stored(docs.select("doc_id", F.monotonically_increasing_id().alias("row"), digest().alias("digest")), "digests")
    winner = F.max(F.struct("doc_id", F.negative("row").alias("row"))).alias("best")  # nulls are the smallest
    sums = [F.count("*").alias("group_size"), winner]
    heavy = stored(rows.join(F.broadcast(frequent(rows.select("digest"), counters)), "digest").groupBy("digest").agg(*sums).where("group_size > 1"), "heavy")
    split = rows.join(F.broadcast(heavy), "digest", "left")  # at most ``counters`` rows
    settled = split.where("best is not null")
    rest = split.where("best is null").select("digest", "doc_id", "row")
    rest = rest.join(rest.groupBy("digest").agg(*sums), "digest")
    return settled.unionByName(rest).select("doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("row") == -F.col("best.row")).alias("kept"), "digest")


def copies_report(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row."""
    return exact_copies(docs, counters).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def without_copies(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """``docs``, all columns, without the rows that do not stay.

    Texts are shuffled only where ids are not keys and rows that stay have twins of the same id and text.
    """
    kept = exact_copies(docs, counters).where("kept").select(F.col("doc_id").alias("kept_id"), F.col("digest").alias("kept_digest"))
    _, _, plain = named(docs)
    if plain:
        return docs.join(kept, docs["doc_id"] == kept["kept_id"], "left_semi")
    name = free("digest", docs.columns)
    rows = docs.withColumn(name, digest())
    stays = rows.join(kept, rows["doc_id"].eqNullSafe(kept["kept_id"]) & (rows[name] == kept["kept_digest"]), "left_semi")
    return stays.dropDuplicates(["doc_id", name]).select(*docs.columns)
