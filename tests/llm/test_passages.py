"""Passages of over 50 words that are shorter than 400 bytes, in the stage that cuts repeats."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np

from pluvia.llm import suffix_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _say(name: str, n: int) -> str:
    return " ".join(f"{name}{j}" for j in range(n))


def _rows() -> list[tuple[int | None, str | None]]:
    short, longer, fifty, once, wide = _say("p", 51), _say("ü", 70), _say("f", 50), _say("o", 55), _say("a-much-wider-word", 60)
    assert len(short) < 300 and len(longer.encode()) < 400
    return [
        (1, f"{_say('a', 80)} {short} {_say('b', 40)}"), (2, f"{_say('c', 30)}\n{short}\n{_say('d', 90)}"), (3, f"{_say('e', 9)} {short.replace(' ', chr(10), 7)}"),  # one is wrapped elsewhere
        (4, f"{longer} {_say('g', 200)}"), (4, f"{_say('h', 200)} {longer} "), (None, f"{_say('i', 5)} {longer}"), (None, longer), (None, longer),
        (5, f"{fifty} {_say('j', 60)}"), (6, f"{_say('k', 60)} {fifty}"), (7, f"{once} {_say('l', 3)} {once}"), (8, f"{_say('m', 7)} {_say('o', 50)} {_say('n', 7)}"),
        (9, f"{_say('q', 20)} {wide} {short} {_say('r', 20)}"), (10, f"{_say('s', 20)} {wide} {_say('t', 20)}"), (11, None), (12, ""), (13, "one"), (14, short.upper()),
    ]


def _cut(texts: list[str], length: int, words: int) -> list[str]:
    """Every window of bytes and of words against all others, by plain counts."""
    data = [t.encode() for t in texts]
    strings = Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    places = [[m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", b)] for b in data]
    windows = [[tuple(b[x:y] for x, y in p[i : i + words]) for i in range(len(p) - words + 1)] for b, p in zip(data, places, strict=True)]
    holders = Counter(w for own in windows for w in set(own))
    out = []
    for b, p, own in zip(data, places, windows, strict=True):
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            gone[i : i + length] |= strings[b[i : i + length]] > 1
        for i, w in enumerate(own):
            gone[p[i][0] : p[i + words - 1][1]] |= holders[w] > 1
        out.append(bytes(c for c, g in zip(b, gone, strict=True) if not g).decode("utf-8", "ignore"))
    return out


def test_stage_cuts_passages_of_over_50_words_in_under_400_bytes(spark):
    import corpus_pipeline

    docs = spark.createDataFrame(_rows(), "doc_id long, text string")
    got = corpus_pipeline.repeated_passages(spark, docs, "")
    assert got.columns == docs.columns
    want = [(k, t and x) for (k, t), x in zip(_rows(), _cut([t or "" for _, t in _rows()], 400, 51), strict=True)]
    assert Counter((r["doc_id"], r["text"]) for r in got.collect()) == Counter(want)
    kept = " ".join(t or "" for _, t in want)
    assert "p7 " not in kept and "ü30 " not in kept and "f30 " in kept and "o30 " in kept and "P30 " in kept and "a79 " in kept


def test_words_at_random_equal_brute_force(spark):
    rng = np.random.default_rng(11)
    source = [str(x) for x in rng.choice(["a", "bb", "ccc", "é", "of"], 4000)]
    texts = []
    for _ in range(60):  # pieces of one long sequence: windows overlap in all ways
        a, b = (int(x) for x in rng.integers(0, 3900, 2))
        n = int(rng.integers(1, 60))
        texts.append("".join(w + str(rng.choice([" ", "\n", " \t"])) for w in [*source[a : a + n], "x", *source[b : b + 20]]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    want = dict(enumerate(_cut(texts, 400, 12)))
    for anchor in (1, 5):
        spans, _ = suffix_dedup.repeated_spans(docs.withColumnRenamed("doc_id", "row_id"), 400, 200, words=12, word_anchor=anchor)
        spans, got = spans.collect(), dict(want)
        for k, ranges in spans:
            kept, at = b"", 0
            for lo, hi in suffix_dedup._union(*(np.array(x, np.int64) for x in zip(*ranges, strict=True)), 400):
                kept, at = kept + texts[k].encode()[at:lo], hi
            got[k] = (kept + texts[k].encode()[at:]).decode()
        assert got == want and {k for k, t in enumerate(texts) if t != want[k]} == {r[0] for r in spans}


def test_words_of_long_texts_are_found_in_runs(monkeypatch):
    text = ("  " + _say("w", 300) + "\n\nü " + "z" * 90 + "\t" + _say("v", 50)).encode()
    whole = suffix_dedup.word_places(text)
    monkeypatch.setattr(suffix_dedup, "_CUT", 64)
    for a, b in zip(whole, suffix_dedup.word_places(text), strict=True):
        assert a.tolist() == b.tolist()
    assert [text[a:b].decode() for a, b in zip(*whole[:2], strict=True)] == WORD.findall(text.decode())
    assert [len(x) for x in suffix_dedup.word_places(b"")] == [0, 0, 0]
