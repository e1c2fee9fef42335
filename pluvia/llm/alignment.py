"""Alignment of two tokenizers: which tokens of one cover the bytes of which tokens of the other.

A is a byte-level BPE and encodes space + text; B is a sentence-piece BPE, which adds the space itself. Where a token of A and a token
of B end at the same byte, a group ends. A link is a pair of an A and a B token whose bytes overlap.

1. Texts are cut before runs of white space, at characters before which neither vocabulary can merge (:func:`cuts` proves it from the
   vocabularies: no entry holds the character after another that is no white space, and none but runs of white space begins with B's
   space and the character). A cut is then a token border of both, and each segment's tokens are those it has alone.
2. Rows are taken up in blocks of about ``BLOCK_CHARS`` of text as they are read, and each block numbers its distinct segments: a
   document becomes a list of numbers. From here on no text is read or shuffled.
3. A block deals its segments out by their hash, one packed row for each share. A share of the corpus's segments comes together from
   all blocks; its distinct segments are tokenised and aligned once, and each block gets back a packed row of alignments.
4. A block's documents are joined to its alignments and counted: how many of them hold an id pair linked. The counts are summed up
   corpus-wide, and every document is composed of its segments: texts of groups, and sums of the counts of its links.

No links cross a segment, so the sums are exact. A segment occurs at most once in a block, so no share holds more than one entry of it
for each block; shares grow in number with the text. Blocks are bounded by characters; a longer text is a block of its own. Counts of
pairs are broadcast up to ``MOST_PAIRS`` of them (counted), and beyond that joined to the blocks that hold the pairs.

Null and empty texts have no tokens: zeros, and an empty list of groups. So have texts in which the joined bytes of either tokenizer are
not space + text; a text that holds U+2581 is such a one, since B reads that sign as a space. As a segment's bytes can get fewer
but not more, a text is whole exactly if all its segments are. Special tokens' strings are ordinary text. Very long texts
are read whole, also without white space (one segment). Repeated rows, null ids and ties need no rule: each row is aligned by itself and counts as a document,
and n_best counts every link whose pair is among its A id's most frequent. Empty tables give empty results. Other columns are not read.
"""

from __future__ import annotations

import ctypes
import json
import os
import re
import sys
from collections import defaultdict
from functools import cached_property
from itertools import count
from zlib import crc32

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pluvia.llm.common import discard, in_batches, stored

#: A block of documents ends at about this many characters of text.
BLOCK_CHARS = 10 << 20
#: Bytes of text of the corpus for each share of its segments.
SHARE_BYTES = 16 << 20
#: Most pairs whose counts are broadcast (24 bytes each).
MOST_PAIRS = 1 << 20
#: Characters before which texts may be cut, if the vocabularies allow it.
CANDIDATES = " \n\t\r"
#: B writes a space so.
SPACE = "▁"
#: Fixed value: the pattern by which byte-level vocabularies of A's kind cut texts before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def tokenizer_files() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def letters_of_bytes() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: printable Latin-1 as itself, the rest from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Pair:
    """Both tokenizers and the bytes of their tokens. ``raw``: the two files' bytes."""

    def __init__(self, raw: tuple[bytes, bytes]) -> None:
        from sentencepiece import SentencePieceProcessor

        self.raw, self.kind = raw, json.loads(raw[0])
        self.b = SentencePieceProcessor(model_proto=raw[1])
        code, vocab = letters_of_bytes(), self.kind["model"]["vocab"]
        self.bytes_a, self.bytes_b = [b""] * (max(vocab.values(), default=-1) + 1), []
        for piece, k in vocab.items():
            self.bytes_a[k] = bytes(code[c] for c in piece) if all(c in code for c in piece) else piece.encode()
        for k in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(k)
            self.bytes_b.append(bytes([int(piece[3:-1], 16)]) if self.b.is_byte(k) else piece.replace(SPACE, " ").encode())
        self.long_a, self.long_b = (np.array([len(x) for x in v], np.int64) for v in (self.bytes_a, self.bytes_b))
        self.blank = self.b.piece_to_id(SPACE)
        self.fast = self._by_ranks(self.kind["model"])

    @cached_property
    def a(self):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark has a task for each core already
        from tokenizers import Tokenizer

        out = Tokenizer.from_buffer(self.raw[0])
        out.encode_special_tokens = True
        return out

    def _by_ranks(self, model: dict):
        """A's ids by rank of merged bytes, several times as fast; None unless ids are in the order of the merges."""
        import tiktoken

        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        known = 256 + len(merges)
        if any(model["vocab"].get(x + y) != 256 + k for k, (x, y) in enumerate(merges)) or len(set(self.bytes_a[:known])) != known:
            return None
        return tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks={self.bytes_a[k]: k for k in range(known)}, special_tokens={}).encode_ordinary

    _known = {}

    @classmethod
    def of(cls, raw: tuple[bytes, bytes]) -> Pair:
        """One a process."""
        if cls._known.get("raw") != raw:
            cls._known.update(raw=raw, pair=cls(raw))
        return cls._known["pair"]

    def cuts(self) -> str:
        """The characters before whose runs a text can be cut, proved from both vocabularies.

        A must cut texts by its byte-level pattern first, which starts a new part at white space after anything else.
        """
        split, model = self.kind["pre_tokenizer"] or {}, self.kind["model"]
        if self.kind["normalizer"] or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True) or model["type"] != "BPE" or model.get("dropout"):
            raise ValueError("A must be a byte-level BPE without a normalizer")
        probe = "  a  éﬁ b "
        if self.b.normalize(probe) != (SPACE + probe).replace(" ", SPACE):
            raise ValueError("B must add a space, and leave texts as they are")
        own = [b.decode("utf-8", "replace") for b in self.bytes_a] + [b.decode("utf-8", "replace") for k, b in enumerate(self.bytes_b) if not self.b.is_byte(k)]
        merged = {c for piece in own for c in re.findall(r"\S(\s)", piece)}
        led = {piece[1] for piece in (b.decode("utf-8", "replace") for b in self.bytes_b) if len(piece) > 1 and piece[0] == " " and piece[1] != " "}
        return "".join(c for c in CANDIDATES if c not in merged and (c == " " or c not in led))

    def aligned(self, segments: list[str]) -> tuple[np.ndarray, ...]:
        """(n_a, n_b, n_links; a, b, steps): by segment, and its ids and steps one after the other.

        A link ends where a token of A (1), of B (2) or one of each (3, the end of a group) does. Segments of which a tokenizer does not
        give the bytes back have none.
        """
        if self.fast is not None:
            ids_a = [self.fast(s) for s in segments]
        else:
            ids_a = [e.ids for e in self.a.encode_batch(segments, add_special_tokens=False)]
        ids_b = self.b.encode([s[1:] if s[0] == " " else s for s in segments], num_threads=1)
        # B adds its space to every text but the empty one; a segment without a space of its own does not have that token
        ids_b = [([self.blank] if s == " " else b if s[0] == " " else b[1:]) for s, b in zip(segments, ids_b, strict=True)]
        data = [s.encode() for s in segments]
        for ids, table in ((ids_a, self.bytes_a), (ids_b, self.bytes_b)):
            if b"".join([table[k] for x in ids for k in x]) != b"".join(data):
                bad = {j for j, x in enumerate(ids) if b"".join([table[k] for k in x]) != data[j]}
                ids_a, ids_b, data = ([[] if j in bad else x for j, x in enumerate(v)] for v in (ids_a, ids_b, data))
                data = [x or b"" for x in data]
        n_a, n_b = (np.array([len(x) for x in v], "<u4") for v in (ids_a, ids_b))
        a, b = (np.array([k for x in v for k in x], "<u4") for v in (ids_a, ids_b))
        end_a, end_b = np.cumsum(self.long_a[a]), np.cumsum(self.long_b[b])  # in all segments' bytes
        ends = np.union1d(end_a, end_b)
        steps = (np.isin(ends, end_a, assume_unique=True) + 2 * np.isin(ends, end_b, assume_unique=True)).astype("u1")
        edge = np.searchsorted(ends, np.cumsum([len(x) for x in data]), side="right")
        return n_a, n_b, np.diff(edge, prepend=0).astype("<u4"), a, b, steps


def links_of(a: np.ndarray, b: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """The id pairs of links, a * 2**32 + b: a link is of the tokens that have not ended before it."""
    at = lambda bit: np.cumsum((steps & bit) > 0) - ((steps & bit) > 0)
    return (a.astype(np.int64)[at(1)] << 32) + b[at(2)] if len(steps) else np.zeros(0, np.int64)


def group_texts(n_links: np.ndarray, a: np.ndarray, b: np.ndarray, steps: np.ndarray, at_once: int = 1 << 17) -> list[str]:
    """``a1,a2|b1;a3|b2,b3;`` of each segment, every group with its semicolon; about ``at_once`` links are spelled out at a time."""
    ends = np.cumsum(n_links.astype(np.int64))
    step_a, step_b = ((steps & k) > 0 for k in (1, 2))
    used_a, used_b = (np.concatenate([[0], np.cumsum(x)]) for x in (step_a, step_b))
    out, lo = [], 0
    last = lambda own: np.append(own[1:] != own[:-1], True)[: len(own)]
    while lo < len(ends):
        from_ = int(ends[lo - 1]) if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, from_ + at_once, side="right")))
        to = int(ends[hi - 1])
        group = np.cumsum(steps[from_:to] == 3) - (steps[from_:to] == 3)
        own_a, own_b = group[step_a[from_:to]], group[step_b[from_:to]]
        order = np.argsort(np.concatenate([2 * own_a, 2 * own_b + 1]), kind="stable")  # by group, A's tokens before B's
        sign = np.concatenate([np.where(last(own_a), "|", ","), np.where(last(own_b), ";", ",")])
        ids = np.concatenate([a[used_a[from_] : used_a[to]], b[used_b[from_] : used_b[to]]])
        pieces = [f"{k}{c}" for k, c in zip(ids[order].tolist(), sign[order].tolist(), strict=True)]
        edge = np.concatenate([[from_], ends[lo:hi]])
        done = (used_a[edge] + used_b[edge] - used_a[from_] - used_b[from_]).tolist()
        out += ["".join(pieces[i:j]) for i, j in zip(done, done[1:], strict=False)]
        lo = hi
    return out


def segments_pattern(cut: str) -> re.Pattern:
    """A segment: white space, then what follows up to the next run of white space that begins with a character of ``cut``."""
    if not cut:
        return re.compile(r"[\s\S]+")
    stay = rf"(?=\s)[^{re.escape(cut)}]"
    return re.compile(rf"\s*\S+(?:{stay}\s*\S*)*|\s+")


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed string, the bytes of numbers in planes: high bytes are mostly zeros."""
    head = np.array([len(arrays), *(x for v in arrays for x in (v.itemsize, len(v)))], "<i8")
    planes = (np.ascontiguousarray(v.view(np.uint8).reshape(len(v), v.itemsize).T).tobytes() for v in arrays)
    return zstandard.compress(b"".join([head.tobytes(), *planes]), 3)


def _unpack(data: bytes) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.decompress(data), np.uint8)
    n = int(raw[:8].view("<i8")[0])
    sizes = raw[8 : 8 + 16 * n].view("<i8").reshape(n, 2)
    out, at = [], 8 + 16 * n
    for width, m in sizes.tolist():
        out.append(np.ascontiguousarray(raw[at : at + width * m].reshape(width, m).T).reshape(-1).view({1: "u1", 4: "<u4", 8: "<i8"}[width]))
        at += width * m
    return out


def _release() -> None:
    """Gives freed memory back to the system: workers go on to other blocks, and a block's arrays are large."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def _strings(values: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and bytes."""
    return np.array([len(v) for v in values], "<u4"), np.frombuffer(b"".join(values), np.uint8)


def _split(sizes: np.ndarray, data: np.ndarray) -> list[str]:
    text, edge = data.tobytes(), np.concatenate([[0], np.cumsum(sizes.astype(np.int64))]).tolist()
    return [text[a:b].decode() for a, b in zip(edge, edge[1:], strict=False)]


def _gathered(sizes: np.ndarray, values: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The values of lists (sizes, values) in another order of the lists."""
    sizes = sizes.astype(np.int64)
    start = (np.cumsum(sizes) - sizes)[order]
    count = sizes[order]
    return values[np.repeat(start - (np.cumsum(count) - count), count) + np.arange(count.sum())]


def numbered(docs: DataFrame, cut: str, shares: int, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(block, share, data): without a share a block's documents (ids, lengths and numbers), else the segments of a share."""
    schema = pa.schema([("block", pa.int64()), ("share", pa.int32()), ("data", pa.binary())])

    def number(batches):
        find, first, block = segments_pattern(cut).findall, TaskContext.get().partitionId() << 32, 0
        numbers = defaultdict(count().__next__)
        ids, lists, held = [], [], 0

        def rows():
            null = np.array([k is None for k in ids], np.uint8)
            of = np.array([k or 0 for k in ids], "<i8")
            yield None, _pack(null, of, np.array([len(x) for x in lists], "<u4"), np.concatenate(lists))
            segments = [s.encode() for s in numbers]
            share = np.array([crc32(s) % shares for s in segments], np.int64)
            order = np.argsort(share, kind="stable")
            edge = np.searchsorted(share[order], np.arange(shares + 1))
            for k in np.flatnonzero(np.diff(edge)).tolist():
                mine = order[edge[k] : edge[k + 1]]
                yield k, _pack(mine.astype("<u4"), *_strings([segments[j] for j in mine.tolist()]))

        def batch_of(part):
            return pa.RecordBatch.from_arrays([pa.array([first + block] * len(part), pa.int64()), pa.array([k for k, _ in part], pa.int32()), pa.array([d for _, d in part], pa.binary())], schema=schema)

        def written():
            part = []
            for row in rows():
                part.append(row)
                if len(part) == 64:
                    yield batch_of(part)
                    part = []
            if part:
                yield batch_of(part)
            _release()

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                size = len(text) if text else 0
                if ids and held + size > block_chars:
                    yield from written()
                    block, held = block + 1, 0
                    numbers = defaultdict(count().__next__)
                    ids, lists = [], []
                ids.append(doc_id)
                lists.append(np.fromiter(map(numbers.__getitem__, find(f" {text}")), "<u4") if text else np.zeros(0, "<u4"))
                held += size
        if ids:
            yield from written()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return in_batches(rows, number, "block long, share int, data binary", arrow=True)


def align(shared: DataFrame, raw) -> DataFrame:
    """(home, data): the alignments of each block's segments, by share. ``shared``: (block, share, data), ``raw``: broadcast files."""

    def run(rows: pa.Table) -> pa.Table:
        pair = Pair.of(raw.value)
        slot = defaultdict(count().__next__)
        members = []
        for data in rows.column("data").to_pylist():
            no, sizes, text = _unpack(data)
            members.append((no, np.fromiter(map(slot.__getitem__, _split(sizes, text)), np.int64)))
        segments = list(slot)
        found = [pair.aligned(segments[at : at + 2000]) for at in range(0, len(segments), 2000)]
        n_a, n_b, n_links, a, b, steps = (np.concatenate(x) for x in zip(*found, strict=True))
        data = [_pack(no, n_a[at], n_b[at], n_links[at], _gathered(n_a, a, at), _gathered(n_b, b, at), _gathered(n_links, steps, at)) for no, at in members]
        _release()
        return pa.table({"home": rows.column("block"), "data": pa.array(data, pa.binary())})

    return shared.groupBy("share").applyInArrow(run, "home long, data binary")


class _Block:
    """A block's documents and the alignments of its segments, by number."""

    def __init__(self, null, ids, lengths, codes, n_a, n_b, n_links, a, b, steps) -> None:
        self.arrays = (null, ids, lengths, codes, n_a, n_b, n_links, a, b, steps)
        self.n, self.codes = len(ids), codes
        self.ids = pa.array(ids, pa.int64(), mask=null.astype(bool))
        self.owner = np.repeat(np.arange(self.n, dtype="<u4"), lengths)
        self.edge = np.concatenate([[0], np.cumsum(lengths.astype(np.int64))])
        self.bad = np.bincount(self.owner[n_a[codes] == 0], minlength=self.n) > 0
        self.links, self.n_links = links_of(a, b, steps), n_links.astype(np.int64)
        self.start = np.cumsum(self.n_links) - self.n_links

    @classmethod
    def of(cls, documents: bytes, alignments: list[bytes]) -> _Block:
        parts = [_unpack(d) for d in alignments]
        empty = [np.zeros(0, t) for t in ("<u4", "<u4", "<u4", "<u4", "<u4", "<u4", "u1")]
        no, n_a, n_b, n_links, a, b, steps = (np.concatenate([e, *(p[k] for p in parts)]) for k, e in enumerate(empty))
        order = np.argsort(no, kind="stable")  # all numbers from 0 on, once each
        return cls(*_unpack(documents), n_a[order], n_b[order], n_links[order], _gathered(n_a, a, order), _gathered(n_b, b, order), _gathered(n_links, steps, order))

    def linked(self) -> tuple[np.ndarray, np.ndarray]:
        """(id pairs, how many documents hold them linked)."""
        pairs, slot = np.unique(self.links, return_inverse=True)
        total, edge = np.zeros(len(pairs), np.int64), self.edge
        at = 0
        while at < self.n:  # some documents at once, one at least
            to = max(at + 1, int(np.searchsorted(edge, edge[at] + (1 << 18), side="right")) - 1)
            good = ~self.bad[self.owner[edge[at] : edge[to]]]
            seen = np.unique(((self.owner[edge[at] : edge[to]][good].astype(np.int64) - at) << 32) + self.codes[edge[at] : edge[to]][good])
            doc, no = seen >> 32, seen & 0xFFFFFFFF
            many = self.n_links[no]
            place = np.repeat(self.start[no] - (np.cumsum(many) - many), many) + np.arange(many.sum())
            once = np.unique((np.repeat(doc, many) << 32) + slot[place])
            total += np.bincount(once & 0xFFFFFFFF, minlength=len(pairs))
            at = to
        return pairs[total > 0], total[total > 0]

    def report(self, pairs: np.ndarray, docs: np.ndarray, best: np.ndarray):
        """Rows of the report, some at a time; ``pairs``: sorted, with their counts and whether they are their A id's best."""
        _, _, _, _, n_a, n_b, _, a, b, steps = self.arrays
        links = self.links
        at = np.minimum(np.searchsorted(pairs, links), max(0, len(pairs) - 1))
        known = pairs[at] == links if len(pairs) else np.zeros(len(links), bool)  # others are of texts without tokens only
        by_segment = lambda v: (lambda c: c[self.start + self.n_links] - c[self.start])(np.concatenate([[0], np.cumsum(np.where(known, v[at], 0) if len(pairs) else np.zeros(len(links), np.int64))]))
        n_groups = (lambda c: c[self.start + self.n_links] - c[self.start])(np.concatenate([[0], np.cumsum(steps == 3)]))
        columns = (n_a, n_b, n_groups, self.n_links, by_segment(best), by_segment(docs))
        sums = []
        for values in columns:
            run = np.concatenate([[0], np.cumsum(values.astype(np.int64)[self.codes])])
            sums.append(np.where(self.bad, 0, run[self.edge[1:]] - run[self.edge[:-1]]))
        texts, codes, lo = group_texts(self.n_links, a, b, steps), self.codes, 0
        while lo < self.n:
            hi = max(lo + 1, int(np.searchsorted(self.edge, self.edge[lo] + (1 << 18), side="right")) - 1)
            groups = ["" if self.bad[k] else "".join([texts[c] for c in codes[self.edge[k] : self.edge[k + 1]].tolist()])[:-1] for k in range(lo, hi)]
            yield pa.RecordBatch.from_arrays([self.ids[lo:hi], *(pa.array(v[lo:hi], pa.int64()) for v in sums), pa.array(groups, pa.string())], schema=_REPORT)
            lo = hi


_REPORT = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")), ("groups", pa.string())])
_REPORT_DDL = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"


def _met(documents: pa.Table, alignments: pa.Table) -> pa.Table:
    """(block, data, pair, docs): the block packed as a whole, and its counts of pairs."""
    if not documents.num_rows:
        raise ValueError("alignments of a block that is not there")
    block = _Block.of(documents.column("data")[0].as_py(), alignments.column("data").to_pylist())
    pairs, counts = block.linked()
    n = len(pairs)
    _release()
    return pa.table({
        "block": pa.array([documents.column("block")[0].as_py()] * (n + 1), pa.int64()), "data": pa.array([_pack(*block.arrays)] + [None] * n, pa.binary()),
        "pair": pa.concat_arrays([pa.nulls(1, pa.int64()), pa.array(pairs, pa.int64())]), "docs": pa.concat_arrays([pa.nulls(1, pa.int64()), pa.array(counts, pa.int64())]),
    })


def token_alignments(docs: DataFrame, files: tuple[str, str] | None = None, block_chars: int = BLOCK_CHARS, most_pairs: int = MOST_PAIRS) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups) of every document; groups is ``a1,a2|b1;a3|b2,b3``."""
    spark, raw = docs.sparkSession, []
    for path in files or tokenizer_files():
        with open(path, "rb") as f:  # on the driver alone: the files' bytes travel as a broadcast of a few megabytes
            raw.append(f.read())
    sent = spark.sparkContext.broadcast(tuple(raw))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shares = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARE_BYTES))
    rows = stored(numbered(docs, Pair.of(sent.value).cuts(), shares, block_chars), "alignment-blocks")
    documents = rows.where("share is null").select("block", "data")
    aligned = align(rows.where("share is not null"), sent)
    met = documents.groupBy("block").cogroup(aligned.groupBy("home")).applyInArrow(_met, "block long, data binary, pair long, docs long")
    met = stored(met, "alignment-met")
    discard(rows)  # nothing reads it any more
    blocks, pairs = met.where("data is not null").select("block", "data"), met.where("pair is not null").select(F.col("block").alias("home"), "pair", "docs")
    counts = pairs.groupBy("pair").agg(F.sum("docs").alias("docs"))
    # an A id has at most as many pairs as B has ids
    top = F.max("docs").over(Window.partitionBy(F.shiftrightunsigned("pair", 32)))
    counts = stored(counts.select("pair", "docs", (F.col("docs") == top).cast("long").alias("best")), "alignment-pairs")
    if counts.count() <= most_pairs:
        table = counts.orderBy("pair").toPandas()  # counted
        known = spark.sparkContext.broadcast(tuple(table[c].to_numpy(np.int64) for c in ("pair", "docs", "best")))

        def compose(batches):
            for batch in batches:
                for data in batch.column("data"):
                    yield from _Block(*_unpack(data.as_py())).report(*known.value)
                    _release()

        return in_batches(blocks, compose, _REPORT_DDL, arrow=True)

    def composed(block: pa.Table, table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("pair").to_numpy(), kind="stable")
        stats = (table.column(c).to_numpy()[order].astype(np.int64) for c in ("pair", "docs", "best"))
        return pa.Table.from_batches(_Block(*_unpack(block.column("data")[0].as_py())).report(*stats), _REPORT)

    here = pairs.select("home", "pair").join(counts, "pair")  # a pair is in one row of each block
    return blocks.groupBy("block").cogroup(here.groupBy("home")).applyInArrow(composed, _REPORT_DDL)


def alignment_report(docs: DataFrame, files: tuple[str, str] | None = None) -> DataFrame:
    """:func:`token_alignments` with the SHA-256 of ``groups`` in its place (empty without tokens)."""
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2(F.col("groups").cast("binary"), 256))
    return token_alignments(docs, files).withColumn("groups_sha256", digest).drop("groups")
