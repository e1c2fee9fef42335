"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. Unary potentials see features of the line and of the lines beside it, pair potentials tie
neighbours together. Forward-backward gives each line's marginal; the mean of the marginals, weighted by line length, is
shifted in log odds so that the threshold errs least on a part of the sample that the field was not trained on: the score.

Training uses weak labels (lines carry their document's label) on a bounded sample of labelled rows (``max_train`` documents
for each label, at most ``max_lines`` lines on the driver, of texts of at most ``max_text_bytes`` and a twentieth of those lines): a text
beyond that is passed over, not the ones after it. Ids whose labels contradict each other are not learnt from; where no text fits, the
shortest of each label is learnt from. Scoring is one pass over all rows without a shuffle. Null, empty and white-space texts have one empty line and
get a score like any other text; very long ones, also of very many lines, are scored whole, in blocks of lines. Ties: a score of the
threshold itself is predicted good. Rows without an id are not learnt from and not held out; repeated ids are scored each for itself. Other
columns, whatever their names, are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pluvia.llm.common import bounded_sample, bucket, held_out, in_batches, joined, runs, settled, shortest, utf8, words

_CLASS = np.full(256, 6, np.int64)  # other
for _k, _chars in enumerate((range(97, 123), range(65, 91), range(48, 58), b" \t\r\x0b\x0c", b".,;:?'\"-()", b"#*$%&|<>!=+_~^@\\/[]{}`")):
    _CLASS[list(_chars)] = _k
_CLASS[128:] = 7
_CLASS[10] = 8
N_CLASS = 8
N_OWN = N_CLASS + 6


def line_features(texts: list[bytes]):
    """For runs of texts: (lo, hi, text of each line, bytes of each line, features of lines)."""
    for lo, hi in runs(texts):
        data, begin = joined(texts[lo:hi])
        ends = np.flatnonzero(data == 10)
        starts = np.concatenate([[0], ends[:-1] + 1])
        n = len(ends)
        doc = np.searchsorted(begin, starts, side="right") - 1
        size = ends - starts
        line = np.repeat(np.arange(n), size + 1)
        table = np.bincount(line * 9 + _CLASS[data], minlength=n * 9).reshape(n, 9)[:, :N_CLASS]
        ws, we, h = words(data)
        own = np.searchsorted(ends, ws)
        count = np.bincount(own, minlength=n)
        same = np.zeros(n)
        if len(h) > 1:
            twin = (h[1:] == h[:-1]) & (own[1:] == own[:-1])
            same = np.bincount(own[1:][twin], minlength=n)
        key = np.sort((own << 40) | (h >> np.uint64(24)).astype(np.int64))  # a line's words, by hash
        distinct = np.bincount(key[np.diff(key, prepend=-1) != 0] >> 40, minlength=n)
        x = np.zeros((n, N_OWN))
        x[:, :N_CLASS] = np.sqrt(table / np.maximum(size, 1)[:, None])
        w = np.maximum(count, 1)
        x[:, N_CLASS] = np.log1p(size) / 6
        x[:, N_CLASS + 1] = np.log1p(count) / 5
        x[:, N_CLASS + 2] = np.sqrt(same / w)
        x[:, N_CLASS + 3] = 1 - distinct / w
        x[:, N_CLASS + 4] = np.minimum(np.bincount(own, we - ws, n) / w, 30) / 10
        x[:, N_CLASS + 5] = size == 0
        yield lo, hi, doc, size, x


def with_neighbours(x: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Own features, those of the lines before and after (0 outside the document, with a mark), and a constant."""
    n, k = x.shape
    out = np.zeros((n, 3 * k + 3))
    out[:, :k] = x
    before = np.flatnonzero(doc[1:] == doc[:-1])
    out[before + 1, k : 2 * k] = x[before]
    out[before, 2 * k : 3 * k] = x[before + 1]
    out[:, 3 * k] = 1
    out[before + 1, 3 * k] = 0
    out[:, 3 * k + 1] = 1
    out[before, 3 * k + 1] = 0
    out[:, 3 * k + 2] = 1
    return out


#: Lines of a document that one step of the forward-backward pass takes one after the other; longer ones are cut into blocks.
BLOCK_LINES = 256


def _log_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of 2 x 2 matrices of logarithms."""
    return np.logaddexp(a[..., :, :1] + b[..., :1, :], a[..., :, 1:] + b[..., 1:, :])


def _running(m: np.ndarray) -> np.ndarray:
    """Products m[0], m[0] m[1], ... by doubling: as many rounds as the number has binary digits."""
    out, step = m.copy(), 1
    while step < len(out):
        out[step:] = _log_product(out[:-step].copy(), out[step:])
        step *= 2
    return out


def marginals(score: np.ndarray, doc: np.ndarray, pull: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """P(good) of each line, expected label pairs (2 x 2), log partition: forward-backward over all documents side by side.

    ``score``: log odds of good by line; ``pull``: pair potentials. Documents are cut into blocks of ``BLOCK_LINES``, and blocks of all
    documents are passed through side by side, longest first: once from either label to get each block's transfer matrix, whose running products
    tell every block what comes before and after it, and then with that.
    """
    n = len(score)
    if not n:
        return np.zeros(0), np.zeros((2, 2)), 0.0
    new = np.diff(doc, prepend=doc[0] - 1) != 0
    place = np.arange(n) - np.repeat(np.flatnonzero(new), np.diff(np.append(np.flatnonzero(new), n)))  # of a line in its document
    first = np.flatnonzero(place % BLOCK_LINES == 0)
    size = np.diff(np.append(first, n))
    begins, ends = place[first] == 0, np.append(place[first][1:] == 0, True)
    order = np.argsort(-size, kind="stable")
    start, long = first[order], size[order]
    alive = np.searchsorted(-long, -np.arange(1, int(long[0]) + 1), side="right")  # blocks with more than t lines
    unary = np.stack([np.zeros(n), score], 1)
    # what comes into a block's first line, and out of its last one, by label
    into, beyond = np.zeros((len(first), 2)), np.zeros((len(first), 2))
    if not begins.all():
        through = np.zeros((len(start), 2, 2))  # from the label before the block to that of its last line
        for t in range(int(long[0])):
            at = start[: alive[t]] + t
            step = pull[None] + unary[at][:, None, :]
            through[: alive[t]] = step if t == 0 else _log_product(through[: alive[t]], step)
        matrix = np.empty_like(through)
        matrix[order] = through
        edge = np.append(np.flatnonzero(begins), len(first))
        for lo, hi in zip(edge, edge[1:], strict=False):  # documents of several blocks
            if hi - lo > 1:
                t = _first_block(unary[first[lo] : first[lo] + size[lo]], pull)
                after = _running(matrix[lo + 1 : hi])
                into[lo + 1] = t
                into[lo + 2 : hi] = np.logaddexp(t[0] + after[:-1, 0], t[1] + after[:-1, 1])
                back = _running(matrix[lo + 1 : hi][::-1].transpose(0, 2, 1)).transpose(0, 2, 1)[::-1]  # products up to the end
                beyond[lo : hi - 1] = np.logaddexp(back[:, :, 0], back[:, :, 1])
    inflow, outflow, opens = into[order], beyond[order], begins[order]
    ahead, back = np.zeros((n, 2)), np.zeros((n, 2))
    for t in range(int(long[0])):
        at = start[: alive[t]] + t
        prev = inflow[: alive[t]] if t == 0 else ahead[at - 1]
        came = np.logaddexp(prev[:, :1] + pull[0], prev[:, 1:] + pull[1])
        if t == 0:
            came = np.where(opens[: alive[0], None], 0.0, came)
        ahead[at] = unary[at] + came
    final = start + long - 1
    back[final] = outflow
    for t in range(int(long[0]) - 2, -1, -1):
        at = start[: alive[t + 1]] + t
        nxt = unary[at + 1] + back[at + 1]
        back[at] = np.logaddexp(pull[:, 0] + nxt[:, :1], pull[:, 1] + nxt[:, 1:])
    total = ahead + back
    z = np.logaddexp(total[:, 0], total[:, 1])  # the document's, at each of its lines
    inside = np.flatnonzero(~new[1:])
    nxt = unary[inside + 1] + back[inside + 1]
    pairs = np.exp(ahead[inside][:, :, None] + pull[None] + nxt[:, None, :] - z[inside, None, None]).sum(0)
    good = 1 / (1 + np.exp(np.clip(total[:, 0] - total[:, 1], -500, 500)))
    return good, pairs, float(z[np.flatnonzero(new)].sum())


def _first_block(unary: np.ndarray, pull: np.ndarray) -> np.ndarray:
    """Forward sums of a block that begins a document, at its last line."""
    out = unary[0]
    for row in unary[1:]:
        out = row + np.logaddexp(out[0] + pull[0], out[1] + pull[1])
    return out


def train_field(x: np.ndarray, doc: np.ndarray, y: np.ndarray, steps: int = 150, rate: float = 0.1, decay: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """(unary weights, pair potentials) by full-batch Adam on the conditional likelihood of the line labels ``y``."""
    w, pull = np.zeros(x.shape[1]), np.zeros((2, 2))
    inside = doc[1:] == doc[:-1]
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[:-1][inside], y[1:][inside]), 1)
    m = v = np.zeros(x.shape[1] + 4)
    for step in range(1, steps + 1):
        good, pairs, _ = marginals(x @ w, doc, pull)
        g = np.concatenate([x.T @ (good - y), (pairs - seen).ravel()]) / len(y) + decay * np.concatenate([w, pull.ravel()])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w, pull = w - move[:-4], pull - move[-4:].reshape(2, 2)
    return w, np.clip(pull, -1.5, 1.5)


def _document(good: np.ndarray, doc: np.ndarray, size: np.ndarray, n: int) -> np.ndarray:
    weight = np.maximum(size, 1)
    return np.bincount(doc, good * weight, n) / np.maximum(np.bincount(doc, weight, n), 1)


def _shift(p: np.ndarray, y: np.ndarray, threshold: float) -> float:
    """What is added to the log odds of the mean marginal, so that ``threshold`` errs least."""
    s = np.clip(p, 1e-4, 1 - 1e-4)
    s = np.log(s / (1 - s))
    order = np.argsort(s)
    right = np.cumsum(y[order] == 0) - np.cumsum(y[order] == 1)
    best = np.flatnonzero(right == right.max())
    k = int(best[len(best) // 2])
    cut = (s[order[k]] + s[order[min(k + 1, len(s) - 1)]]) / 2
    return float(np.log(threshold / (1 - threshold)) - cut)


def fit(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, max_train: int = 1500, max_lines: int = 60_000, max_text_bytes: int = 4 << 20, fold: tuple[int, int] = (4, 2)) -> tuple[np.ndarray, np.ndarray, float]:
    """(unary weights, pair potentials, shift) from the bounded sample of labelled rows."""
    mod, out = fold
    known = settled(labels, "quality", bucket("doc_id", mod) != out)
    sample = bounded_sample(known, "quality", max_train)
    # the sample is bounded, so that it is broadcast and no text is shuffled; a text that does not fit is passed over
    rows = docs.select("doc_id", "text").where(F.octet_length("text") <= max_text_bytes).join(F.broadcast(sample), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text"))
    feats, ids, sizes, truth = [], [], [], []

    def learn(text: str, label: int) -> int:
        n = 0
        for _, _, _, size, x in line_features(utf8([text])):
            n += len(x)
            feats.append(x)
            ids.append(np.full(len(x), len(truth)))
            sizes.append(size)
        truth.append(label)
        return n

    lines = 0
    for r in rows.toLocalIterator():
        if r["text"].count("\n") + 1 <= max(1, min(max_lines - lines, max_lines // 20)):
            lines += learn(r["text"], r["quality"])
        if lines >= max_lines:
            break
    if not truth:
        for text, label in shortest(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id"), "quality"):
            learn(text, label)
    weights, pull, shift = np.zeros(3 * N_OWN + 3), np.zeros((2, 2)), 0.0
    if truth:
        doc, x, size, y = np.concatenate(ids), np.concatenate(feats), np.concatenate(sizes), np.array(truth, np.int64)
        full = with_neighbours(x, doc)
        taught = doc % 4 != 3
        weights, pull = train_field(full[taught], doc[taught], y[doc[taught]])
        good, _, _ = marginals(full @ weights, doc, pull)
        p = _document(good, doc, size, len(y))
        test = np.arange(len(y)) % 4 == 3
        if test.any():
            shift = _shift(p[test], y[test], threshold)
    return weights, pull, shift


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, max_train: int = 1500, max_lines: int = 60_000, max_text_bytes: int = 4 << 20, fold: tuple[int, int] = (4, 2)) -> DataFrame:
    """(doc_id, held_out, score, predicted, n_lines, bad_bytes) of every document."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, threshold, max_train, max_lines, max_text_bytes, fold))  # a few numbers

    def score(batches):
        w, pair, shift = model.value
        for pdf in batches:
            n = len(pdf)
            s, lines, bad = np.zeros(n), np.zeros(n, np.int64), np.zeros(n)
            for lo, hi, doc, size, x in line_features(utf8(pdf["text"])):
                good, _, _ = marginals(with_neighbours(x, doc) @ w, doc, pair)
                p = np.clip(_document(good, doc, size, hi - lo), 1e-4, 1 - 1e-4)
                s[lo:hi] = 1 / (1 + np.exp(-(np.log(p / (1 - p)) + shift)))
                lines[lo:hi] = np.bincount(doc, minlength=hi - lo)
                bad[lo:hi] = np.bincount(doc, np.where(good < 0.5, size, 0), hi - lo)
            yield pd.DataFrame({"doc_id": pdf["doc_id"].to_numpy(), "score": s, "predicted": (s >= threshold).astype(np.int32), "n_lines": lines, "bad_bytes": bad.astype(np.int64)})

    scored = in_batches(docs.select("doc_id", "text"), score, "doc_id long, score double, predicted int, n_lines long, bad_bytes long")
    return scored.select("doc_id", held_out("doc_id", fold), "score", "predicted", "n_lines", "bad_bytes")
