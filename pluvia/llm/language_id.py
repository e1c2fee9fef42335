"""Language identification by bit-sliced Bloom filters over n-grams.

One table of positions serves all languages: bit l of a position belongs to the Bloom filter of language l, so the AND of an
n-gram's positions is the set of all languages that contain it. A document's n-grams give a popcount for each language;
the count expected from false positives alone (the filter's own fill) is taken off, and the largest rest decides.

A language contains an n-gram when the n-gram is at least ``ratio`` times as frequent in it as in the language where it is
most frequent, which keeps foreign passages and mislabelled rows from filling every filter. Counts come from a bounded sample
of labelled rows (``max_docs`` documents for each language, whole texts; at most ``max_grams`` n-grams of each language),
summed on the executors. More than 64 languages take more words to a position. Null texts and texts without a letter (numerals
of any script are none) are ``und`` with score 0; a text too short for any known n-gram gets the first language with score 0. Ties go to
the first language in order of names, and n-grams of equal counts to the smaller hash. Very long texts are read whole, in runs of texts; one
text is one run. Rows without an id are not learnt from and not held out; repeated ids are scored each for itself. Other columns, whatever their
names, are not read. Without anything to learn from, every text is ``und``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pluvia.llm.common import LOWER, bounded_sample, bucket, gram_hashes, held_out, in_batches, joined, runs, utf8

POSITION_BITS = 19
HASHES = 2
GRAM = 5
_FOLD = LOWER.copy()
_FOLD[[c for c in range(128) if not chr(c).isalpha()]] = 32


def _grams(texts: list[bytes], size: int):
    """(lo, hi, text of each n-gram, hash of each n-gram): bytes are folded to lower case, all but letters to spaces."""
    for lo, hi in runs(texts):
        data, begin = joined(texts[lo:hi])
        data = _FOLD[data]
        if len(data) < size:
            continue
        h = gram_hashes(data, size)
        where = np.arange(len(h))
        doc = np.repeat(np.arange(hi - lo), np.diff(begin))[: len(h)]
        inside = (where + size <= begin[doc + 1]) & ~((data[: len(h)] == 32) & (data[1 : len(h) + 1] == 32))
        yield lo, hi, doc[inside], h[inside]


def _positions(h: np.ndarray) -> list[np.ndarray]:
    mask = np.uint64((1 << POSITION_BITS) - 1)
    return [((h >> np.uint64(21 * k)) & mask).astype(np.int64) for k in range(HASHES)]


class Filters:
    """Bit-sliced Bloom filters: ``table[position, word]`` holds 64 languages to a word."""

    def __init__(self, languages: list[str]) -> None:
        self.languages = languages
        self.table = np.zeros((1 << POSITION_BITS, max(1, -(-len(languages) // 64))), np.uint64)

    def add(self, language: int, h: np.ndarray) -> None:
        for at in _positions(h):
            self.table[at, language // 64] |= np.uint64(1 << (language % 64))

    def false_rate(self) -> np.ndarray:
        """By language, how often an unknown n-gram is taken for known: the filter's fill to the power of the hashes."""
        fill = [((self.table[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1)).mean() for k in range(len(self.languages))]
        return np.array(fill) ** HASHES

    def popcounts(self, doc: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
        """n-grams of each document that each language contains."""
        out = np.zeros((n, len(self.languages)))
        first, second = _positions(h)
        for word in range(self.table.shape[1]):
            bits = self.table[first, word] & self.table[second, word]
            own = self.languages[64 * word : 64 * word + 64]
            if len(own) <= 8:  # all sets of languages at once
                sets = 1 << len(own)
                table = np.bincount(doc * sets + bits.astype(np.int64), minlength=n * sets).reshape(n, sets)
                for k in range(len(own)):
                    out[:, 64 * word + k] = table[:, (np.arange(sets) >> k) & 1 == 1].sum(1)
            else:
                for k in range(len(own)):
                    out[:, 64 * word + k] = np.bincount(doc, ((bits >> np.uint64(k)) & np.uint64(1)).astype(float), n)
        return out


def fit(docs: DataFrame, fold: tuple[int, int] = (4, 2), max_docs: int = 1500, max_grams: int = 40_000, ratio: float = 0.2, least: int = 3) -> Filters:
    mod, out = fold
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (bucket("doc_id", mod) != out)).select("doc_id", "lang", "text")
    sample = bounded_sample(known, "lang", max_docs)

    def count(batches):
        held: dict[str, list] = {}  # (n-grams, counts) of each language, put together when they grow large

        def summed(parts):
            g, back = np.unique(np.concatenate([x for x, _ in parts]), return_inverse=True)
            return g, np.bincount(back, np.concatenate([m for _, m in parts])).astype(np.int64)

        for pdf in batches:
            for lang, part in pdf.groupby("lang"):
                mine = held.setdefault(lang, [])
                for _, _, _, h in _grams(utf8(part["text"]), GRAM):
                    mine.append(np.unique(h, return_counts=True))
                    if len(mine) > 16:
                        mine[:] = [summed(mine)]
                if sum(len(g) for g, _ in mine) > 1 << 20:
                    g, m = summed(held.pop(lang))
                    yield pd.DataFrame({"lang": lang, "g": g.view(np.int64), "m": m})
        for lang, mine in held.items():
            g, m = summed(mine) if mine else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            yield pd.DataFrame({"lang": lang, "g": g.view(np.int64), "m": m})

    counts = in_batches(sample.select("lang", "text"), count, "lang string, g long, m long").groupBy("lang", "g").agg(F.sum("m").alias("m"))
    share = counts.withColumn("p", F.col("m") / F.sum("m").over(Window.partitionBy("lang"))).where(F.col("m") >= least)
    share = share.withColumn("top", F.max("p").over(Window.partitionBy("g"))).where(F.col("p") >= ratio * F.col("top"))
    ranked = share.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("m"), "g"))).where(F.col("r") <= max_grams)
    rows = ranked.select("lang", "g").toPandas()
    filters = Filters(sorted(rows["lang"].unique()))
    for k, lang in enumerate(filters.languages):
        filters.add(k, rows.loc[rows["lang"] == lang, "g"].to_numpy().astype(np.int64).view(np.uint64))
    return filters


def languages(docs: DataFrame, fold: tuple[int, int] = (4, 2), **options) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, n_grams): score is the winner's part of all corrected counts."""
    filters = fit(docs, fold, **options)
    model = docs.sparkSession.sparkContext.broadcast(filters)  # 2**POSITION_BITS words for each 64 languages

    def predict(batches):
        filters = model.value
        false = filters.false_rate()
        for pdf in batches:
            n = len(pdf)
            hits, total = np.zeros((n, len(filters.languages))), np.zeros(n)
            for lo, hi, doc, h in _grams(utf8(pdf["text"]), GRAM):
                hits[lo:hi] = filters.popcounts(doc, h, hi - lo)
                total[lo:hi] = np.bincount(doc, minlength=hi - lo)
            true = np.maximum((hits - total[:, None] * false) / (1 - false), 0)
            letters = np.array([isinstance(t, str) and any(map(str.isalpha, t)) for t in pdf["text"]], bool)
            if not filters.languages:
                names, score = np.full(n, "und", object), np.zeros(n)
            else:
                best = true.argmax(1)
                names = np.array(filters.languages, object)[best]
                names[~letters] = "und"
                score = np.where(letters, true[np.arange(n), best] / np.maximum(true.sum(1), 1e-9), 0.0)
            yield pd.DataFrame({"doc_id": pdf["doc_id"].to_numpy(), "lang_pred": names, "score": np.clip(score, 0, 1), "n_grams": total.astype(np.int64)})

    scored = in_batches(docs.select("doc_id", "text"), predict, "doc_id long, lang_pred string, score double, n_grams long")
    return scored.select("doc_id", held_out("doc_id", fold), "lang_pred", "score", "n_grams")
