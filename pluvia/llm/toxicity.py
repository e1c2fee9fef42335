"""Toxicity by multiple-instance learning: sentence scores joined by noisy-or, trained from document labels.

A document is a bag of sentences. A sentence has probability p = sigmoid(bias + sum of the weights of its distinct hashed
words and word parts); a document is toxic unless none of its sentences is, 1 - prod(1 - p). The likelihood of document
labels trains the weights, so the sentences that carry the blame emerge without sentence labels; `offending` lists them.

Features that do not set toxic documents of the sample apart beyond chance (z below ``screen``) have no weight.

Training takes a bounded sample of labelled rows (``max_train`` documents for each label, whole texts, at most
``max_train_bytes`` of them, in UTF-8, on the driver): a text that does not fit any more is passed over, not the ones after it. Ids whose
labels contradict each other are not learnt from. Where no text fits, the shortest of each label is learnt from; without any labelled text
the model calls nothing toxic. Scoring goes over every row in one pass without a shuffle. Null and empty texts have no sentence
and score 0; very long ones are scored whole, in runs of sentences. Ties: a score of the threshold itself is toxic, and of equally bad
sentences the last is the worst one. Every row is scored by its text alone: repeated ids, null ids (never learnt from, ``held_out``
false) and other columns, whatever their names, do not matter.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pluvia.llm.common import LOWER, bounded_sample, bucket, gram_hashes, held_out, in_batches, joined, mixed, runs, settled, shortest, utf8, words

BITS = 18
#: Word beginnings of so many bytes are features beside whole words: inflected forms share them.
PARTS = (4, 5, 6)
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?\n"]] = True
#: Bytes that end a word's core: ASCII punctuation beside words does not change them.
_TRIM = np.zeros(256, bool)
_TRIM[[c for c in range(33, 127) if not chr(c).isalnum()]] = True


def sentence_words(texts: list[bytes]):
    """For runs of texts: (text numbers of sentences, byte ranges of sentences, sentence of each word, bucket of each word)."""
    for lo, hi in runs(texts):
        raw, begin = joined(texts[lo:hi])
        data = raw.copy()
        data[_TRIM[raw]] = 32
        start, end, h = words(data)
        # a sentence ends at a full stop before white space, or at a line feed
        stop = _STOP[raw]
        after = np.append(raw[1:], 10)
        stop &= (raw == 10) | (after == 32) | (after == 10)
        number = np.cumsum(stop) - stop  # sentence of each byte
        owner = number[start] if len(start) else np.zeros(0, np.int64)
        new = np.flatnonzero(np.diff(owner, prepend=-1))  # words come in order of their sentences
        own = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(owner))))
        first, last = start[new], end[np.append(new[1:], len(owner)) - 1] if len(new) else start[new]
        doc = np.searchsorted(begin, first, side="right") - 1
        low = LOWER[data]
        names, owners = [h], [own]
        for k in PARTS:
            at = np.flatnonzero(end - start > k)
            names.append(gram_hashes(low, k)[start[at]] + np.uint64(k))
            owners.append(own[at])
        pair = np.sort((np.concatenate(owners) << BITS) + (mixed(np.concatenate(names)) >> np.uint64(64 - BITS)).astype(np.int64))
        pair = pair[np.diff(pair, prepend=-1) > 0]
        yield lo, hi, doc, first - begin[doc], last - begin[doc], pair >> BITS, pair & ((1 << BITS) - 1)


def _logits(own: np.ndarray, where: np.ndarray, n: int, weights: np.ndarray, bias: float) -> np.ndarray:
    return bias + np.bincount(own, weights[where], n)


def _screened(a: np.ndarray, b: np.ndarray, n_bad: int, n_good: int, least: float) -> np.ndarray:
    """Starting weights: log ratio of a feature's shares of toxic (a) and other (b) documents; 0 where that may be chance (z < least)."""
    n_bad, n_good = max(1, n_bad), max(1, n_good)
    p = (a + b + 1) / (n_bad + n_good + 2)
    z = (a / n_bad - b / n_good) / np.sqrt(p * (1 - p) * (1 / n_bad + 1 / n_good))
    ratio = np.log((a + 0.3) / (n_bad + 0.6)) - np.log((b + 0.3) / (n_good + 0.6))
    return np.where((z >= least) & (a >= 3), np.maximum(ratio, 0), 0.0)


def train(texts: list[bytes], labels: np.ndarray, prior: float = 0.5, epochs: int = 40, rate: float = 0.05, decay: float = 3e-5, screen: float = 5.0) -> tuple[np.ndarray, float, float]:
    """(weights, bias, shift): noisy-or likelihood, balanced classes, Adam over minibatches.

    A fifth of the sample takes no part in the gradient; ``shift`` is the log odds that err least on it, with the classes
    weighted as in the population (``prior``: share of label 1), and becomes score 0.5. The texts are read twice, once to
    count features by label and once for the features that are left: words of a run are all that is held beside those.
    """
    size = 1 << BITS
    rng = np.random.default_rng(1)
    tried, taught = np.split(rng.permutation(len(texts)), [len(texts) // 5])
    use = np.isin(np.arange(len(texts)), taught)
    seen = np.zeros((2, size), np.int64)
    for lo, _, doc, _, _, own, where in sentence_words(texts):
        pair = np.unique(((doc[own] + lo) << BITS) + where)
        d, w = pair >> BITS, pair & (size - 1)
        for y in (0, 1):
            seen[y] += np.bincount(w[use[d] & (labels[d] == y)], minlength=size)
    start = _screened(seen[1], seen[0], int((use & (labels == 1)).sum()), int((use & (labels == 0)).sum()), screen)
    feature = np.flatnonzero(start > 0)
    slot = np.full(size, -1, np.int64)
    slot[feature] = np.arange(len(feature))
    docs, sentences, places, base = [], [], [], 0
    for lo, _, doc, _, _, own, where in sentence_words(texts):
        at = slot[where]
        docs.append(doc + lo)
        sentences.append(own[at >= 0] + base)
        places.append(at[at >= 0])
        base += len(doc)
    doc, own, where = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (docs, sentences, places))
    weights, bias = start[feature], -6.0
    m, v, mb, vb, step = np.zeros(len(feature)), np.zeros(len(feature)), 0.0, 0.0, 0
    cost = np.where(labels == 1, 0.5 / max(1, (labels == 1).sum()), 0.5 / max(1, (labels == 0).sum())) * len(labels)
    word_at = np.searchsorted(own, np.arange(base + 1))
    doc_at = np.searchsorted(doc, np.arange(len(texts) + 1))
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(taught), max(1, len(taught) // 256)):
            s = np.concatenate([np.arange(doc_at[d], doc_at[d + 1]) for d in part]) if len(part) else np.zeros(0, int)
            if not len(s):
                continue
            count = word_at[s + 1] - word_at[s]
            w = np.repeat(word_at[s] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
            local = np.repeat(np.arange(len(s)), count)
            z = np.clip(bias + np.bincount(local, weights[where[w]], len(s)), -30, 30)
            p = 1 / (1 + np.exp(-z))
            of = np.repeat(np.arange(len(part)), doc_at[part + 1] - doc_at[part])
            none = np.bincount(of, np.log1p(-np.minimum(p, 1 - 1e-12)), len(part))
            some = -np.expm1(none)
            pull = np.where(labels[part] == 1, -np.exp(none) / np.maximum(some, 1e-9), 1.0) * cost[part] / len(part)
            g = p * pull[of]
            gw = np.bincount(where[w], g[local], len(feature)) + decay * weights  # under Adam's scaling this empties words without evidence
            step += 1
            m, v = 0.9 * m + 0.1 * gw, 0.999 * v + 0.001 * gw * gw
            mb, vb = 0.9 * mb + 0.1 * g.sum(), 0.999 * vb + 0.001 * g.sum() ** 2
            a, b = 1 - 0.9**step, 1 - 0.999**step
            weights = weights - rate * (m / a) / (np.sqrt(v / b) + 1e-8)
            bias -= rate * 0.3 * (mb / a) / (np.sqrt(vb / b) + 1e-8)
    z = np.clip(bias + np.bincount(own, weights[where], base), -30, 30)
    odds, truth = _odds(np.bincount(doc, -np.logaddexp(0, z), len(texts)))[tried], labels[tried]
    full = np.zeros(size)
    full[feature] = weights
    order = np.argsort(odds)
    worth = np.where(truth == 1, prior / max(1, (truth == 1).sum()), (1 - prior) / max(1, (truth == 0).sum()))[order]
    right = np.round(np.cumsum(worth * (truth[order] == 0)) - np.cumsum(worth * (truth[order] == 1)), 12)
    best = np.flatnonzero(right == right.max()) if len(right) else np.zeros(0, int)
    if not len(best):
        return full, bias, 0.0
    k = best[len(best) // 2]
    return full, bias, float((odds[order[k]] + odds[order[min(k + 1, len(order) - 1)]]) / 2)


def _odds(none: np.ndarray) -> np.ndarray:
    """Log odds of 1 - exp(none)."""
    none = np.minimum(none, -1e-13)
    return np.log(-np.expm1(none)) - none


def _fit(docs: DataFrame, labels: DataFrame, label: str, fold: tuple[int, int], max_train: int, max_train_bytes: int):
    mod, out = fold
    known = settled(labels, label, bucket("doc_id", mod) != out)
    sample = bounded_sample(known, label, max_train)
    size = F.octet_length("text")
    # the sample is bounded, and its texts are: what does not fit is passed over, and the next one is tried
    rows = docs.select("doc_id", "text").where(size <= max_train_bytes).join(F.broadcast(sample), "doc_id")
    kept, used = [], 0
    for r in rows.orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text")).toLocalIterator():
        text = utf8([r["text"]])[0]
        if used + len(text) <= max_train_bytes:
            used += len(text)
            kept.append((text, r[label]))
    counts = {r[0]: r[1] for r in known.groupBy(label).count().collect()}
    if not any(t for t, _ in kept):
        kept = [(utf8([t])[0], y) for t, y in shortest(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id"), label)]
    return [t for t, _ in kept], np.array([y for _, y in kept], np.int64), counts.get(1, 0) / max(1, sum(counts.values()))


def _scores(texts: list[bytes], weights: np.ndarray, bias: float, shift: float):
    """(score, sentences, first and last byte of the worst sentence) of each text."""
    n = len(texts)
    none, count = np.zeros(n), np.zeros(n, np.int64)
    first, last = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for lo, hi, doc, a, b, own, where in sentence_words(texts):
        z = np.clip(_logits(own, where, len(doc), weights, bias), -30, 30)
        none[lo:hi] += np.bincount(doc, -np.logaddexp(0, z), hi - lo)
        count[lo:hi] += np.bincount(doc, minlength=hi - lo)
        order = np.argsort(z, kind="stable")
        first[lo + doc[order]], last[lo + doc[order]] = a[order], b[order]
    return np.where(count > 0, 1 / (1 + np.exp(-np.clip(_odds(none) - shift, -30, 30))), 0.0), count, first, last


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, max_train: int = 1800, max_train_bytes: int = 12 << 20, fold: tuple[int, int] = (5, 0)) -> DataFrame:
    """(doc_id, held_out, score, predicted, n_sentences, worst_start, worst_end): the last two are bytes of the worst sentence."""
    texts, y, prior = _fit(docs, labels, "toxic", fold, max_train, max_train_bytes)
    model = docs.sparkSession.sparkContext.broadcast(train(texts, y, prior))  # 2**18 numbers

    def score(batches):
        for pdf in batches:
            s, count, first, last = _scores(utf8(pdf["text"]), *model.value)
            yield pd.DataFrame({"doc_id": pdf["doc_id"].to_numpy(), "score": s, "predicted": (s >= threshold).astype(np.int32), "n_sentences": count, "worst_start": first, "worst_end": last})

    out = in_batches(docs.select("doc_id", "text"), score, "doc_id long, score double, predicted int, n_sentences long, worst_start long, worst_end long")
    return out.select("doc_id", held_out("doc_id", fold), "score", "predicted", "n_sentences", "worst_start", "worst_end")


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, max_train: int = 1800, max_train_bytes: int = 12 << 20, fold: tuple[int, int] = (5, 0)) -> DataFrame:
    """``docs``, all columns, without the rows whose own text is predicted toxic: one pass, nothing is shuffled."""
    texts, y, prior = _fit(docs, labels, "toxic", fold, max_train, max_train_bytes)
    model = docs.sparkSession.sparkContext.broadcast(train(texts, y, prior))  # 2**18 numbers

    def keep(batches):
        for rows in batches:
            s = _scores(utf8(rows.column("text").to_pylist()), *model.value)[0]
            yield rows.filter(pa.array(s < threshold))

    return in_batches(docs, keep, docs.schema, arrow=True)


def offending(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """(doc_id, score, sentence) of documents predicted toxic: the sentence with the highest probability."""
    s = toxicity_scores(docs, labels, **options).where("predicted = 1")
    data = F.col("text").cast("binary")
    return docs.select("doc_id", "text").join(s, "doc_id").select("doc_id", "score", F.substring(data, F.col("worst_start").cast("int") + 1, (F.col("worst_end") - F.col("worst_start")).cast("int")).cast("string").alias("sentence"))
