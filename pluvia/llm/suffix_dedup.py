"""Exact substring deduplication by a logarithmic family of suffix arrays.

A byte is removed when it lies in a string of ``length`` bytes that also starts anywhere else (other documents, or the same
one); matches never cross documents and are judged on the input.

* Suffixes are sampled by content: in every window of ``length`` bytes the smallest hash of an ``anchor``-byte string marks a
  place, so equal windows mark the same place in them. A window belongs to its anchor; an anchor that occurs once in the
  corpus cannot be in a repeated window, and is dropped after one count over 64-bit hashes.
* Occurrences of the others travel with the bytes that their windows cover, dealt out by anchor over as many shards as keep
  a shard small. In a shard, :class:`SuffixFamily` takes them in batches: each batch gets a suffix array (text to the right
  of the anchor) and a prefix array (text to the left, read backwards), is merge-scanned against each existing level, and
  levels of equal size merge. A window at distance d before the anchor is repeated where another entry agrees in d bytes to
  the left and length - d to the right: longest common prefixes of neighbours give the classes of both sides.
* Copies need no suffix array: after two equal entries in a task, further ones are known to be repeated and stay there.
* An anchor with more than ``hot`` different entries (a phrase in a third of all documents) is not put in one shard: its
  windows are counted by 128-bit hashes instead, which splits it over all tasks.
* On demand (``words``), so are bytes from the first to the last of that many words in a row that also stand in another
  document, whatever white space parts them: fifty words may be much shorter than ``length``. Anchors are then strings of
  words, and the windows of repeated ones are counted by 128-bit digests, a document once each.

Null texts are empty. Repeated rows of an id, and rows without one, are different documents to each other: where ids do not name
rows, a 64-bit hash of id and text does, so that rows of one name are equal and have the same spans. Very long texts are cut in runs that
overlap by ``length - 1`` bytes, so memory for a task does not grow with them but by the text itself (for ``words``, by three
numbers a word, too; runs end at white space). Other columns stay outside.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pluvia.llm.common import WHITE, free, gram_hashes, in_batches, mixed, named, powers, stored
from pluvia.llm.common import words as split

_FAR = np.uint64(2**64 - 1)
_WHITE = re.compile(b"[" + WHITE + b"]")


def _least(h: np.ndarray, w: int) -> np.ndarray:
    """The smallest of each ``w`` values in a row."""
    n = len(h) - w + 1
    x = np.concatenate([h, np.full(-len(h) % w, _FAR)]).reshape(-1, w)
    ahead = np.minimum.accumulate(x, 1).ravel()
    back = np.minimum.accumulate(x[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[w - 1 : w - 1 + n])


def anchors(text: bytes, length: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(fingerprint, place, first window, last window) of the anchors of ``text``, in order of windows."""
    if len(text) < length:
        z = np.zeros(0, np.int64)
        return z.astype(np.uint64), z, z, z
    return _sampled(gram_hashes(np.frombuffer(text, np.uint8), anchor), length - anchor + 1)


def _sampled(h: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, place, first window, last window) of the smallest of each ``w`` hashes in a row."""
    low = _least(h, w)
    n = len(low)
    # of equal hashes in a window the first counts: the place of the last window's first one that is not behind
    at = np.flatnonzero(h == _nearest(low, h, w))
    own = _place(low, h, at, n, w)
    new = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    first, last = new, np.concatenate([new[1:], [n]]) - 1
    return low[new], own[new], first, last


def _nearest(low: np.ndarray, h: np.ndarray, w: int) -> np.ndarray:
    """For each place the largest of the window minima over windows that hold it: equal to its hash only at anchors."""
    pad = np.concatenate([np.zeros(w - 1, np.uint64), low, np.zeros(w - 1, np.uint64)])
    return ~_least(~pad, w)[: len(h)]


def _place(low: np.ndarray, h: np.ndarray, at: np.ndarray, n: int, w: int) -> np.ndarray:
    """The first place at or behind each window's start that has the window's smallest hash."""
    begin = np.arange(n)
    k = np.searchsorted(at, begin)
    out = at[np.minimum(k, len(at) - 1)]
    while len(wrong := np.flatnonzero(h[out] != low)):  # a larger local minimum lies before
        k[wrong] += 1
        out[wrong] = at[np.minimum(k[wrong], len(at) - 1)]
    return out


def word_places(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of every word of ``text``; long texts are cut in runs at white space."""
    lo, found = 0, []
    while lo < len(text) or not found:
        hi = m.start() if (m := _WHITE.search(text, lo + _CUT)) else len(text)
        start, end, h = split(np.frombuffer(text[lo:hi] + b" ", np.uint8), lower=False)
        found.append((start + lo, end + lo, h))
        lo = hi
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _in_a_row(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each ``k`` hashes in a row."""
    p, q = powers(len(h))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * p, dtype=np.uint64)])
    return mixed((total[k:] - total[:-k]) * q[: len(total) - k])


def word_anchors(h: np.ndarray, words: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As :func:`anchors`, for windows of ``words`` words with hashes ``h``."""
    if len(h) < words:
        return anchors(b"", 1, 1)
    return _sampled(_in_a_row(h, anchor), words - anchor + 1)


# --- the family of suffix arrays ---------------------------------------------------------------------------------------


def _order(keys: np.ndarray) -> np.ndarray:
    """Order of the rows as byte strings; runs that are in order already are merged, not sorted."""
    return np.argsort(np.ascontiguousarray(keys).view(f"S{keys.shape[1]}").ravel(), kind="stable")


def _common(keys: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Common prefix of each row in ``order`` with the row before it; 0 for the first."""
    out = np.zeros(len(order), np.int64)
    for lo in range(1, len(order), 4096):
        a, b = keys[order[lo : lo + 4096]], keys[order[lo - 1 : lo - 1 + len(order[lo : lo + 4096])]]
        differ = a != b
        out[lo : lo + len(a)] = np.where(differ.any(1), differ.argmax(1), keys.shape[1])
    return out


@dataclass
class Level:
    """Entries with their orders by the text right and left of the anchor."""

    right: np.ndarray  # rows: fingerprint, then the bytes from the anchor on
    left: np.ndarray  # rows: fingerprint, then the bytes before the anchor backwards
    near: np.ndarray  # smallest and largest distance of the entry's windows before the anchor
    far: np.ndarray
    name: np.ndarray
    by_right: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    by_left: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    @classmethod
    def of(cls, right, left, near, far, name) -> Level:
        return cls(right, left, near, far, name, _order(right), _order(left))

    def merged(self, other: Level) -> Level:
        """Both levels as one; their orders are two runs, merged in linear time."""
        n = len(self.name)
        out = Level(*(np.concatenate([getattr(self, f), getattr(other, f)]) for f in ("right", "left", "near", "far", "name")))
        for side in ("right", "left"):
            runs = np.concatenate([getattr(self, f"by_{side}"), getattr(other, f"by_{side}") + n])
            setattr(out, f"by_{side}", runs[_order(getattr(out, side)[runs])])
        return out

    def repeated(self, length: int) -> np.ndarray:
        """By entry and distance: is that window equal to another entry's?"""
        n = len(self.name)
        found = np.zeros((n, int(self.far.max(initial=-1)) + 1), bool)
        common_right, common_left = _common(self.right, self.by_right) - 8, _common(self.left, self.by_left) - 8
        right, left = np.empty(n, np.int64), np.empty(n, np.int64)
        # entries alone on either side at the weakest demand never match; drop them first
        for d in range(found.shape[1]):
            here = np.flatnonzero((self.near <= d) & (self.far >= d))
            if len(here) < 2:
                continue
            right[self.by_right] = np.cumsum(common_right < length - d)
            left[self.by_left] = np.cumsum(common_left < d) if d else np.cumsum(common_left < 0)
            _, back, count = np.unique(right[here] * (n + 1) + left[here], return_inverse=True, return_counts=True)
            found[here[count[back] > 1], d] = True
        return found


class SuffixFamily:
    """Levels of doubling sizes. ``add`` scans a batch against every level and tells which windows repeat."""

    def __init__(self, length: int) -> None:
        self.length = length
        self.levels: list[Level] = []
        self.windows: dict[int, np.ndarray] = {}  # by entry

    def _note(self, level: Level) -> None:
        found = level.repeated(self.length)
        for k in np.flatnonzero(found.any(1)):
            name, row = int(level.name[k]), found[k]
            old = self.windows.get(name)
            if old is None:
                self.windows[name] = row
            else:
                long, short = (old, row) if len(old) >= len(row) else (row, old)
                long = long.copy()
                long[: len(short)] |= short
                self.windows[name] = long

    def add(self, batch: Level) -> None:
        if not self.levels:
            self._note(batch)
        for level in self.levels:
            self._note(level.merged(batch))
        self.levels.append(batch)
        while len(self.levels) > 1 and len(self.levels[-2].name) <= 2 * len(self.levels[-1].name):
            small = self.levels.pop()
            self.levels.append(self.levels.pop().merged(small))


def _fixed(rows: list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(r.ljust(width, b"\0") for r in rows), np.uint8).reshape(len(rows), width)


# --- the distributed operator ------------------------------------------------------------------------------------------

_CUT = 8 << 20
#: Windows of words go out in frames of so many rows.
_FRAME = 20_000


def _parts(text: bytes, length: int):
    """Runs of a text that overlap by length - 1 bytes, so that every window lies in one."""
    step = _CUT - length + 1
    for lo in range(0, max(1, len(text) - length + 1), step):
        yield lo, text[lo : lo + _CUT]


def _utf8(v) -> bytes:
    return v.encode("utf-8", "surrogatepass") if isinstance(v, str) else b""


def _union(starts: np.ndarray, ends: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Byte spans covered by windows that start in the closed ranges (a span shorter than ``length`` has its last before its first)."""
    out: list[list[int]] = []
    for k in np.argsort(starts, kind="stable"):
        lo, hi = int(starts[k]), int(ends[k]) + length
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(a, b) for a, b in out]


_RESULT = "row_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _row(row_id, text: bytes, spans: list[tuple[int, int]]):
    kept, at = [], 0
    for lo, hi in spans:
        kept.append(text[at:lo])
        at = hi
    kept.append(text[at:])
    return row_id, len(text), sum(b - a for a, b in spans), len(spans), hashlib.sha256(b"".join(kept)).hexdigest()


def repeated_spans(docs: DataFrame, length: int = 400, anchor: int = 200, batch: int = 1 << 15, shard: int = 1 << 16, hot: int = 1 << 15, key: str = "row_id", words: int | None = None, word_anchor: int = 20) -> tuple[DataFrame, DataFrame]:
    """``docs`` (key, text) -> (key, [(first, last)] starts of removed strings of ``length``) of documents that have any, and (key, z) their texts.

    ``z`` is the UTF-8 text under zstd, for those documents only. Runs of ``words`` words that stand in another document are removed,
    too: one of other length has its end less ``length`` as ``last``, which may be before ``first``.
    """
    spark = docs.sparkSession
    docs = docs.select(key, "text")

    def mark(batches):
        for pdf in batches:
            ids, prints, often = [], [], []
            for k, v in zip(pdf[key], pdf["text"], strict=True):
                text = _utf8(v)
                if words:
                    f = np.unique(word_anchors(word_places(text)[2], words, word_anchor)[0])
                    ids.append(np.full(len(f), k, np.int64))
                    prints.append(f.view(np.int64))
                    often.append(np.ones(len(f), np.int32))  # a document counts once
                if len(text) < length:
                    continue
                f = np.concatenate([anchors(part, length, anchor)[0] for _, part in _parts(text, length)])
                f, m = np.unique(f, return_counts=True)
                ids.append(np.full(len(f), k, np.int64))
                prints.append(f.view(np.int64))
                often.append(np.minimum(m, 2).astype(np.int32))
            if ids:
                yield pd.DataFrame({key: np.concatenate(ids), "f": np.concatenate(prints), "m": np.concatenate(often)})

    marks = stored(in_batches(docs, mark, f"{key} long, f long, m int"), "suffix-anchors")
    again = marks.groupBy("f").agg(F.sum("m").alias("m")).where("m > 1").select("f")
    wanted = marks.select(key, "f").join(again, "f").groupBy(key).agg(F.collect_list("f").alias("prints"))

    def word_windows(k, text, prints):
        """(key, index, start, end, 1 for the first of equal ones, digest) of the windows of words that belong to ``prints``."""
        start, end, hashes = word_places(text)
        f, _, first, last = word_anchors(hashes, words, word_anchor)
        own = np.isin(f.view(np.int64), prints)
        if not own.any():
            return
        at = np.concatenate([np.arange(a, b + 1) for a, b in zip(first[own], last[own], strict=True)])
        new = np.zeros(len(at), np.int64)
        new[np.unique(_in_a_row(hashes, words)[at], return_index=True)[1]] = 1
        for lo in range(0, len(at), _FRAME):
            here = at[lo : lo + _FRAME]
            a, b = start[here], end[here + words - 1]
            h = [hashlib.blake2b(b" ".join(text[i:j].split()), digest_size=16).digest() for i, j in zip(a.tolist(), b.tolist(), strict=True)]
            yield np.full(len(here), k, np.int64), here, a, b, new[lo : lo + _FRAME], np.array(h, object)

    def framed(waiting):
        ids, at, first, last, m, h = (np.concatenate(x) for x in zip(*waiting, strict=True))
        return pd.DataFrame({key: ids, "f": None, "a": at, "first": first, "last": last, "around": None, "z": None, "known": None, "m": m, "h": h})

    def gather(batches):
        """Entries of repeated anchors, with their bytes; a third equal entry is known to be repeated."""
        seen: dict[tuple[int, bytes], int] = {}
        pack = zstandard.ZstdCompressor(level=3)
        for pdf in batches:
            rows, waiting, n_waiting = [], [], 0
            for k, v, prints in zip(pdf[key], pdf["text"], pdf["prints"], strict=True):
                text, known = _utf8(v), []
                prints = np.sort(np.asarray(prints, np.int64))
                if words:
                    for some in word_windows(k, text, prints):
                        waiting.append(some)
                        n_waiting += len(some[0])
                        if n_waiting >= _FRAME:
                            yield framed(waiting)
                            waiting, n_waiting = [], 0
                for base, part in _parts(text, length):
                    f, place, first, last = anchors(part, length, anchor)
                    f = f.view(np.int64)
                    hit = np.minimum(np.searchsorted(prints, f), len(prints) - 1)
                    for j in np.flatnonzero(prints[hit] == f):
                        a, lo, hi = int(place[j]), int(first[j]), int(last[j])
                        around = part[lo : hi + length]
                        name = (int(f[j]), hashlib.blake2b(around + (a - lo).to_bytes(4, "big"), digest_size=12).digest())
                        n = seen[name] = seen.get(name, 0) + 1
                        if n > 2:
                            known.append((base + lo, base + hi))
                        else:
                            rows.append((k, name[0], base + a, base + lo, base + hi, around, None, None, None, None))
                rows.append((k, None, None, None, None, None, pack.compress(text), known, None, None))
            if waiting:
                yield framed(waiting)
            yield pd.DataFrame(rows, columns=[key, "f", "a", "first", "last", "around", "z", "known", "m", "h"]).astype({c: "Int64" for c in ("f", "a", "first", "last", "m")})

    found = in_batches(docs.join(wanted, key), gather, f"{key} long, f long, a long, first long, last long, around binary, z binary, known array<struct<lo:long,hi:long>>, m long, h binary")
    found = stored(found, "suffix-entries")
    texts = found.where("z is not null").select(key, "z")
    known = found.where("size(known) > 0").select(key, F.explode("known").alias("x")).select(key, F.col("x.lo").alias("first"), F.col("x.hi").alias("last"))
    entries = found.where("f is not null").select(key, "f", "a", "first", "last", "around")
    crowd = stored(entries.groupBy("f").agg(F.count("*").alias("m")).where("m > 1"), "suffix-crowds")
    total = crowd.where(F.col("m") <= hot).agg(F.sum("m")).first()[0] or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // shard))

    def scan(batches):
        family, ids, firsts, places, lasts = SuffixFamily(length), [], [], [], []
        waiting: list[tuple] = []

        def add():
            if not waiting:
                return
            f, a, lo, hi, around, names = zip(*waiting, strict=True)
            head = [int(x).to_bytes(8, "big", signed=True) for x in f]
            right = _fixed([h + b[p - q :][:length] for h, b, p, q in zip(head, around, a, lo, strict=True)], 8 + length)
            left = _fixed([h + b[: p - q][::-1] for h, b, p, q in zip(head, around, a, lo, strict=True)], 8 + length - anchor)
            a, lo, hi = (np.array(x, np.int64) for x in (a, lo, hi))
            family.add(Level.of(right, left, a - hi, a - lo, np.array(names, np.int64)))
            waiting.clear()

        for pdf in batches:
            for k, f, a, lo, hi, around in zip(pdf[key], pdf["f"], pdf["a"], pdf["first"], pdf["last"], pdf["around"], strict=True):
                waiting.append((f, a, lo, hi, around, len(ids)))
                ids.append(k)
                firsts.append(lo)
                lasts.append(hi)
                places.append(a)
                if len(waiting) >= batch:
                    add()
        add()
        out = []
        for name, row in family.windows.items():
            edge = np.flatnonzero(np.diff(np.concatenate([[0], row.view(np.int8), [0]])))
            for d0, d1 in zip(edge[::2], edge[1::2], strict=True):
                out.append((ids[name], places[name] - int(d1) + 1, places[name] - int(d0)))
        yield pd.DataFrame(out, columns=[key, "first", "last"])

    span = f"{key} long, first long, last long"
    dealt = entries.join(crowd.where(F.col("m") <= hot).select("f"), "f").select(key, "f", "a", "first", "last", "around").repartition(shards, "f")
    ranges = in_batches(dealt, scan, span)
    ranges = ranges.unionByName(known)
    if not crowd.where(F.col("m") > hot).isEmpty():

        def windows(batches):
            for pdf in batches:
                out = []
                for k, lo, around in zip(pdf[key], pdf["first"], pdf["around"], strict=True):
                    h = gram_hashes(np.frombuffer(around, np.uint8), length)
                    second = gram_hashes(np.frombuffer(around, np.uint8)[::-1].copy(), length)[::-1]
                    out.append(pd.DataFrame({key: k, "first": lo + np.arange(len(h)), "h1": h.view(np.int64), "h2": mixed(second).view(np.int64)}))
                if out:
                    yield pd.concat(out)

        crowded = entries.join(crowd.where(F.col("m") > hot).select("f"), "f")
        each = stored(in_batches(crowded, windows, f"{key} long, first long, h1 long, h2 long"), "suffix-windows")
        twice = each.groupBy("h1", "h2").agg(F.count("*").alias("m")).where("m > 1").drop("m")
        ranges = ranges.unionByName(each.join(twice, ["h1", "h2"]).select(key, "first", F.col("first").alias("last")))
    if words:
        runs = found.where("h is not null").select(key, "a", "first", "last", "m", "h")
        twice = runs.groupBy("h").agg(F.sum("m").alias("m")).where("m > 1").select("h")
        # windows of words one after the other are one range; rows of one name have the same
        island = F.col("a") - F.dense_rank().over(Window.partitionBy(key).orderBy("a"))
        runs = runs.join(twice, "h").withColumn("island", island).groupBy(key, "island").agg(F.min("first").alias("first"), F.max("last").alias("last"))
        ranges = ranges.unionByName(runs.select(key, "first", (F.col("last") - length).alias("last")))
    spans = ranges.groupBy(key).agg(F.collect_list(F.struct("first", "last")).alias("ranges"))
    return spans, texts


def substring_report(docs: DataFrame, length: int = 400, anchor: int = 200) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every document."""
    docs = named(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))[0]
    spans, texts = repeated_spans(docs, length, anchor)

    def cut(batches):
        unpack = zstandard.ZstdDecompressor()
        for pdf in batches:
            rows = []
            for k, z, ranges in zip(pdf["row_id"], pdf["z"], pdf["ranges"], strict=True):
                first, last = (np.array([r[c] for r in ranges], np.int64) for c in ("first", "last"))
                rows.append(_row(k, unpack.decompress(z), _union(first, last, length)))
            yield pd.DataFrame(rows, columns=["row_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    hit = stored(in_batches(texts.join(spans, "row_id"), cut, _RESULT), "suffix-report").dropDuplicates(["row_id"])
    data = F.coalesce("text", F.lit("")).cast("binary")
    whole = docs.select("row_id", "doc_id", F.octet_length(data).cast("long").alias("all_bytes"), F.sha2(data, 256).alias("whole"))
    return whole.join(hit, "row_id", "left").select(
        "doc_id", F.col("all_bytes").alias("n_bytes"), F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("n_spans", F.lit(0)).alias("n_spans"), F.coalesce("kept_sha256", "whole").alias("kept_sha256")
    )


def without_repeats(docs: DataFrame, length: int = 400, anchor: int = 200, words: int | None = None) -> DataFrame:
    """``docs`` with repeated strings cut out of ``text``; spans shrink to whole characters. All columns and rows stay.

    With ``words``, so are runs of that many words that stand in another document as well, however short.
    """
    rows, name, _ = named(docs)
    spans, texts = repeated_spans(rows.select(F.col(name).alias("row_id"), "text"), length, anchor, words=words)

    def cut(batches):
        unpack = zstandard.ZstdDecompressor()
        for pdf in batches:
            rows = []
            for k, z, ranges in zip(pdf["row_id"], pdf["z"], pdf["ranges"], strict=True):
                text = unpack.decompress(z)
                first, last = (np.array([r[c] for r in ranges], np.int64) for c in ("first", "last"))
                kept, at = [], 0
                for lo, hi in _union(first, last, length):
                    while lo < hi and text[lo] & 0xC0 == 0x80:
                        lo += 1
                    while hi > lo and hi < len(text) and text[hi] & 0xC0 == 0x80:
                        hi -= 1
                    kept.append(text[at:lo])
                    at = hi
                kept.append(text[at:])
                rows.append((k, b"".join(kept).decode("utf-8", "replace")))
            yield pd.DataFrame(rows, columns=["row_id", "cut_text"])

    done = stored(in_batches(texts.join(spans, "row_id"), cut, "row_id long, cut_text string"), "suffix-cut").dropDuplicates(["row_id"])
    done = done.select(F.col("row_id").alias(free("of", rows.columns)), F.col("cut_text").alias(free("cut", rows.columns)))
    of, new = done.columns
    out = rows.join(done, F.col(name) == F.col(of), "left")
    return out.withColumn("text", F.coalesce(new, "text")).select(*docs.columns)


#: Every string of 400 bytes against every other; for tables small enough for that.
ORACLE = """
WITH b AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
g AS (SELECT doc_id, i, md5(b[i : i + 399]) AS h FROM b, unnest(range(1, octet_length(b) - 398)) u(i)),
x AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM g WHERE h IN (SELECT h FROM g GROUP BY h HAVING count(*) > 1)),
s AS (SELECT doc_id, i, sum(CASE WHEN p IS NULL OR i > p + 400 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM x),
r AS (SELECT doc_id, k, min(i) AS lo, max(i) + 400 AS hi FROM s GROUP BY doc_id, k),
o AS (SELECT *, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY k), 1) AS from_ FROM r),
c AS (SELECT b.doc_id, any_value(b.b) AS b, CAST(sum(hi - lo) AS BIGINT) AS n_removed, count(*) AS n_spans, max(hi) AS past,
             string_agg(CASE WHEN lo > from_ THEN hex(b.b[from_ : lo - 1]) ELSE '' END, '' ORDER BY k) AS kept FROM o JOIN b USING (doc_id) GROUP BY b.doc_id),
z AS (SELECT doc_id, n_removed, n_spans, sha256(unhex(kept || CASE WHEN past <= octet_length(b) THEN hex(b[past : octet_length(b)]) ELSE '' END)) AS kept FROM c)
SELECT b.doc_id, CAST(octet_length(b.b) AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, coalesce(kept, sha256(b.b)) AS kept_sha256
FROM b LEFT JOIN z USING (doc_id)
"""
