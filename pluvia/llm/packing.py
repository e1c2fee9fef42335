"""Sequence packing by linear grouping: few-size configurations for large pieces, actual pieces put in, best fit for small ones.

The lengths of all pieces are a histogram of at most ``capacity`` numbers, so the plan is made on the histogram (bounded, on
the driver) and applied to pieces by their rank within their length (distributed):

1. Large lengths are sorted downwards and cut into groups of equal cardinality; each length counts as its group's largest.
2. The configurations of those few sizes are optimised: column generation on the linear programme (prices from a bounded
   knapsack), whole parts of the solution, then first fit for what rounding leaves.
3. Actual lengths replace the rounded ones, run by run; the room this leaves is known exactly.
4. Small pieces go, longest first, where they fit best; new sequences open only when none has room.

Several group counts are tried and the plan with the fewest sequences is kept.

Null texts are empty: they are one piece that holds the end token alone. Repeated rows of one id are packed each for
themselves; rows without an id are packed like others. Texts are tokenised by the ranks file of the same vocabulary, which gives the same ids several times as fast; a
text that holds the spelling of a special token goes through the JSON file's own reader.
"""

from __future__ import annotations

import base64
from collections import defaultdict
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pluvia.llm.common import in_batches, stored

#: A run: ``count`` sequences with the same pieces, as [length, ...]
Run = tuple[int, list[int]]
#: Most slots (40 bytes each) that are broadcast; ranks in a block of the join that takes its place beyond that.
MOST_SLOTS = 200_000
RANKS = 4096


def _knapsack(sizes: list[int], prices: np.ndarray, most: list[int], capacity: int) -> tuple[float, list[int]]:
    """The configuration of the highest price."""
    best = np.zeros(capacity + 1)
    last = np.full(capacity + 1, -1)
    for i, s in enumerate(sizes):
        if prices[i] <= 1e-12:
            continue
        for room in range(s, capacity + 1):
            v = best[room - s] + prices[i]
            if v > best[room] + 1e-12:
                best[room], last[room] = v, i
    counts, room = [0] * len(sizes), int(np.argmax(best))
    value = best[room]
    while room > 0 and last[room] >= 0:
        i = last[room]
        counts[i] += 1
        room -= sizes[i]
    return float(value), [min(c, m) for c, m in zip(counts, most, strict=True)]


def configurations(sizes: list[int], demand: list[int], capacity: int, rounds: int = 400) -> list[tuple[int, list[int]]]:
    """(how often, counts by size) that cover ``demand``: column generation, rounded down, then first fit decreasing."""
    k = len(sizes)
    need = np.array(demand, float)
    base = np.diag([float(max(1, min(capacity // s, d))) for s, d in zip(sizes, demand, strict=True)])  # columns: one size each
    for _ in range(rounds):
        inverse = np.linalg.inv(base)
        x = inverse @ need
        prices = inverse.T @ np.ones(k)
        value, column = _knapsack(sizes, prices, demand, capacity)
        column = np.array(column, float)
        if prices @ column <= 1 + 1e-7:
            break
        step = inverse @ column
        ratio = np.where(step > 1e-9, x / np.where(step > 1e-9, step, 1), np.inf)
        leave = int(np.argmin(ratio))
        if not np.isfinite(ratio[leave]):
            break
        base[:, leave] = column
        if abs(np.linalg.det(base)) < 1e-12:
            break
    x = np.linalg.solve(base, need) if abs(np.linalg.det(base)) > 1e-12 else need / np.diag(base)
    left = list(demand)
    out: list[tuple[int, list[int]]] = []

    def put(times: int, column: list[int]) -> None:
        times = min([times, *(left[i] // c for i, c in enumerate(column) if c)])
        if times > 0:
            for i, c in enumerate(column):
                left[i] -= c * times
            out.append((times, column))

    for j in np.argsort(-x):
        put(int(x[j] + 1e-9), [round(c) for c in base[:, j]])
    while any(left):  # first fit decreasing on what is left, in runs
        column, room = [0] * k, capacity
        for i, s in enumerate(sizes):  # sizes fall
            column[i] = min(left[i], room // s)
            room -= column[i] * s
        put(max(1, min(left[i] // c for i, c in enumerate(column) if c)), column)
    return out


def _plan(histogram: dict[int, int], capacity: int, groups: int, small: int) -> list[Run]:
    large = [(n, histogram[n]) for n in sorted(histogram, reverse=True) if n > small]
    total = sum(m for _, m in large)
    rest: list[Run] = []
    done: list[Run] = []
    if total:
        per = -(-total // groups)
        sizes: list[int] = []
        stock: list[list[list[int]]] = []
        filled = per
        for n, m in large:
            while m:
                if filled >= per:
                    sizes.append(n)
                    stock.append([])
                    filled = 0
                take = min(m, per - filled)
                stock[-1].append([n, take])
                filled += take
                m -= take
        merged: dict[int, list[list[int]]] = {}
        for s, st in zip(sizes, stock, strict=True):  # groups of one size are one size
            merged.setdefault(s, []).extend(st)
        sizes, stock = list(merged), list(merged.values())
        for times, column in configurations(sizes, [sum(m for _, m in st) for st in stock], capacity):
            parts: list[Run] = [(times, [])]
            for i, c in enumerate(column):
                for _ in range(c):
                    split: list[Run] = []
                    for count, have in parts:
                        while count:
                            take = min(count, stock[i][0][1])
                            split.append((take, [*have, stock[i][0][0]]))
                            stock[i][0][1] -= take
                            count -= take
                            if not stock[i][0][1]:
                                stock[i].pop(0)
                    parts = split
            rest += parts
    by_room: dict[int, list[Run]] = defaultdict(list)
    for count, have in rest:
        by_room[capacity - sum(have)].append((count, have))
    for n in sorted((n for n in histogram if n <= small), reverse=True):
        m = histogram[n]
        while m:
            room = min((r for r, runs in by_room.items() if r >= n and runs), default=None)
            if room is None:
                fit = capacity // n
                if m >= fit:
                    by_room[capacity - fit * n].append((m // fit, [n] * fit))
                    m -= m // fit * fit
                else:
                    by_room[capacity - m * n].append((1, [n] * m))
                    m = 0
                continue
            count, have = by_room[room].pop()
            fit = room // n
            if m >= fit:
                take = min(count, m // fit)
                by_room[room - fit * n].append((take, have + [n] * fit))
                m -= take * fit
            else:
                take = 1
                by_room[room - m * n].append((1, have + [n] * m))
                m = 0
            if count > take:
                by_room[room].append((count - take, have))
    for runs in by_room.values():
        done += runs
    return done


def pack(histogram: dict[int, int], capacity: int, trials: tuple[int, ...] = (4, 8, 12, 24, 40), slack: float = 2e-4) -> list[Run]:
    """Runs of equal sequences that hold exactly the histogram's pieces; the fewest sequences of several group counts."""
    best: list[Run] | None = None
    floor = -(-sum(n * m for n, m in histogram.items()) // capacity)
    for groups in trials:
        for small in (capacity // 3, capacity // 2, capacity // 5):
            plan = _plan(histogram, capacity, groups, small)
            if best is None or sum(c for c, _ in plan) < sum(c for c, _ in best):
                best = plan
            if sum(c for c, _ in best) <= floor * (1 + slack):
                return best
    return best or []


def placements(plan: list[Run]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, offset): where the pieces of each length go by rank."""
    used: dict[int, int] = defaultdict(int)
    out, base = [], 0
    for count, have in plan:
        at = 0
        for n in have:
            out.append((n, used[n], used[n] + count, base, at))
            used[n] += count
            at += n
        base += count
    return out


class _Encoder:
    """ids of ``byte_bpe_50k.json``; made once in each Python worker."""

    _made: dict[tuple[str, str], _Encoder] = {}

    def __init__(self, json_path: str, ranks_path: str) -> None:
        import public_tokenizers
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.path = json_path
        self.slow = None

    @classmethod
    def of(cls, json_path: str, ranks_path: str) -> _Encoder:
        if (json_path, ranks_path) not in cls._made:
            cls._made[json_path, ranks_path] = cls(json_path, ranks_path)
        return cls._made[json_path, ranks_path]

    def ids(self, text: str) -> list[int]:
        if "<|" not in text:
            return self.fast.encode_ordinary(text)
        if self.slow is None:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(self.path)
        return self.slow.encode(text, add_special_tokens=False).ids


def tokenizer_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def pieces(docs: DataFrame, capacity: int = 1024, end_id: int = 2, paths: tuple[str, str] | None = None, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): every document's ids and the end token, in pieces of ``capacity``.

    Only longer documents are cut; what is over comes first, so that all later pieces are full.
    """
    paths = paths or tokenizer_paths()

    def cut(batches):
        for pdf in batches:
            out = []
            encoder = _Encoder.of(*paths)
            for doc_id, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                ids = np.array([*(encoder.ids(text) if isinstance(text, str) else ()), end_id], "<u4")
                edge = [0, *range(len(ids) % capacity or min(capacity, len(ids)), len(ids) + 1, capacity)]
                for k, (a, b) in enumerate(zip(edge, edge[1:], strict=False)):
                    out.append((doc_id, k, a, b - a, crc32(ids[a:b].tobytes()), *([ids[a:b].astype(np.int32)] if with_ids else ())))
            yield pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else ())])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return in_batches(docs.select("doc_id", "text"), cut, schema)


def place(cut: DataFrame, capacity: int = 1024, most_slots: int = MOST_SLOTS) -> DataFrame:
    """``cut`` (with ``length``) with sequence_id and offset added.

    Full pieces are sequences of their own. Every other piece gets its rank within its length without bringing a length into
    one task: counts by (task, length) are summed up in order, and rank = tasks before + place within the task.
    """
    spark = cut.sparkSession
    cut = stored(cut, "pieces")
    base = cut.where(F.col("length") < capacity)
    # a piece's share: which of many hash shares of its length it is in
    shares = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    share = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(shares))
    counts = stored(base.groupBy("length", share.alias("share")).agg(F.count("*").alias("m")), "piece-counts")
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("m")).collect()}  # fewer than capacity rows
    plan = pack(histogram, capacity)
    before = Window.partitionBy("length").orderBy("share").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("length", "share", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("length", "share").orderBy("doc_id", "piece", "ids_crc32")
    ranked = base.withColumn("share", share).withColumn("inside", F.row_number().over(inside) - 1).join(counts, ["length", "share"])
    ranked = ranked.withColumn("rank", F.col("inside") + F.col("before")).drop("inside", "before", "share")
    schema = "length long, first long, past long, sequence long, offset long"
    found = placements(plan)
    slots = spark.createDataFrame(pd.DataFrame(found, columns=["length", "first", "past", "sequence", "offset"]) if found else [], schema)
    fits = (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("past"))
    if len(found) <= most_slots:
        placed = ranked.join(F.broadcast(slots), "length").where(fits)
    else:  # a slot stands in every block of ranks that it reaches into
        block = lambda c: F.floor(F.col(c) / RANKS)
        reach = slots.withColumn("block", F.explode(F.sequence(block("first"), F.floor((F.col("past") - 1) / RANKS))))
        placed = ranked.withColumn("block", block("rank")).join(reach, ["length", "block"]).where(fits).drop("block")
    packed = placed.withColumn("sequence_id", F.col("sequence") + F.col("rank") - F.col("first")).drop("rank", "first", "past", "sequence")
    full = cut.where(F.col("length") >= capacity).withColumn("offset", F.lit(0).cast("long"))
    full = full.withColumn("sequence_id", -1 - F.monotonically_increasing_id())
    return packed.unionByName(full)


def packed_documents(docs: DataFrame, capacity: int = 1024, end_id: int = 2, paths: tuple[str, str] | None = None) -> DataFrame:
    return place(pieces(docs, capacity, end_id, paths), capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
