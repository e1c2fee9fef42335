"""Texts beyond the bounds of training, many lines, letters and n-gram sets."""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pluvia.llm import language_id, line_crf, toxicity
from pluvia.llm.common import bucket


@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.default_rng(13)
    say = lambda k: " ".join(rng.choice([f"w{j}" for j in range(120)], k)) + "."
    rows = []
    for k in range(320):
        lines = [say(8) for _ in range(4)]
        if k % 4 == 0:
            lines[1] = f"{say(3)} idiot scum {say(2)}"
        if k % 3 == 0:
            lines = [" ".join(f"{w.upper()}!!" for w in x.split()) for x in lines]
        rows.append((k, "\n".join(lines), int(k % 3 > 0), int(k % 4 == 0)))
    return spark.createDataFrame(rows, "doc_id long, text string, quality int, toxic int").coalesce(2)


def _first_by_hash(spark, fold, than):
    """An id outside the fold whose hash comes before those of ``than``."""
    ids = spark.range(10_000, 60_000).select(F.col("id").alias("doc_id"), F.xxhash64(F.col("id")).alias("h")).where(bucket("doc_id", fold[0]) != fold[1])
    return ids.orderBy("h").first()["doc_id"]


@pytest.mark.parametrize("text", [("word idiot scum. " * 800_000)[: 13 << 20], "a line idiot scum\n" * 200_000])
def test_a_text_beyond_the_bounds_changes_no_other_row(spark, labelled, text):
    for scores, label, fold in ((toxicity.toxicity_scores, "toxic", (5, 0)), (line_crf.quality_scores, "quality", (4, 2))):
        long_id = _first_by_hash(spark, fold, labelled)
        more = labelled.unionByName(spark.createDataFrame([(long_id, text, 1, 1)], labelled.schema))
        before = {r["doc_id"]: (r["predicted"], r["held_out"]) for r in scores(labelled.select("doc_id", "text"), labelled.select("doc_id", label)).collect()}
        after = {r["doc_id"]: (r["predicted"], r["held_out"], r["score"]) for r in scores(more.select("doc_id", "text"), more.select("doc_id", label)).collect()}
        assert sum(p for p, _ in before.values()) > 20
        odd = [k for k, v in before.items() if after[k][:2] != v]
        assert len(odd) <= (0 if len(text) > 12 << 20 or label == "quality" else 3), (label, odd)
        assert 0 <= after[long_id][2] <= 1


def test_contradicting_labels_and_only_long_texts(spark, labelled):
    labels = labelled.select("doc_id", "toxic")
    both = labels.unionByName(labels.where("doc_id % 16 = 0").withColumn("toxic", 1 - F.col("toxic")))
    s = toxicity.toxicity_scores(labelled.select("doc_id", "text"), both.repartition(3))
    assert s.where("predicted = 1").count() > 40
    few = labelled.where("doc_id in (1, 2, 3, 4, 8)")
    assert toxicity.toxicity_scores(few.select("doc_id", "text"), few.select("doc_id", "toxic"), max_train_bytes=10).count() == 5
    assert line_crf.quality_scores(few.select("doc_id", "text"), few.select("doc_id", "quality"), max_lines=1).count() == 5


@pytest.mark.parametrize("block", [1, 2, 3, 256])
def test_marginals_of_blocks_equal_enumeration(monkeypatch, block):
    monkeypatch.setattr(line_crf, "BLOCK_LINES", block)
    rng = np.random.default_rng(1)
    doc = np.repeat([0, 1, 2, 5], [1, 9, 3, 8])
    score, pull = rng.normal(size=len(doc)), rng.normal(size=(2, 2))
    good, pairs, z = line_crf.marginals(score, doc, pull)
    total_z, seen = 0.0, np.zeros((2, 2))
    for d in (0, 1, 2, 5):
        at = np.flatnonzero(doc == d)
        weight, total, joint = np.zeros(len(at)), 0.0, np.zeros((2, 2))
        for m in range(2 ** len(at)):
            y = [(m >> k) & 1 for k in range(len(at))]
            w = np.exp(sum(score[a] * b for a, b in zip(at, y, strict=True)) + sum(pull[a, b] for a, b in zip(y, y[1:], strict=False)))
            total += w
            weight += w * np.array(y)
            for a, b in zip(y, y[1:], strict=False):
                joint[a, b] += w
        assert np.allclose(good[at], weight / total)
        seen, total_z = seen + joint / total, total_z + np.log(total)
    assert np.allclose(pairs, seen) and z == pytest.approx(total_z)
    assert line_crf.marginals(np.zeros(0), np.zeros(0, int), pull)[0].shape == (0,)


def test_languages_equal_exact_sets(spark):
    """n-grams counted and chosen by plain loops, documents decided by exact sets: the filters' predictions are the same."""
    rng = np.random.default_rng(4)
    parts = {"aa": "lomi tera suno keli", "bb": "grsch wund stach ich", "cc": "eaux oire ment elle"}
    rows = [(k, " ".join("".join(rng.choice(parts[x].split(), 2)) for _ in range(rng.integers(4, 50))), x) for k in range(400) for x in [list(parts)[k % 3]]]
    rows += [(500, "½ ² ①", None), (501, "Ⅷ ³", "aa"), (502, None, "bb"), (503, "", None), (504, "12 34 _ !", None), (505, "日本", None), (506, "keli " * 100_000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in language_id.languages(docs).collect()}
    assert [got[k]["lang_pred"] for k in (500, 501, 502, 503, 504)] == ["und"] * 5 and got[505]["lang_pred"] != "und" and got[506]["lang_pred"] == "aa"

    def grams(text):
        data = "".join(c.lower() if c.isalpha() or ord(c) > 127 else " " for c in text).encode() + b" "
        return [g for g in (data[i : i + 5] for i in range(len(data) - 5)) if not (g[0] == 32 and g[1] == 32)]

    from zlib import crc32

    counts = defaultdict(Counter)
    for k, t, x in rows:
        if t is not None and x is not None and crc32(str(k).encode()) % 4 != 2:
            counts[x].update(grams(t))
    share = {x: {g: m / sum(c.values()) for g, m in c.items() if m >= 3} for x, c in counts.items()}
    top = defaultdict(float)
    for s in share.values():
        for g, p in s.items():
            top[g] = max(top[g], p)
    sets = {x: {g for g, p in s.items() if p >= 0.2 * top[g]} for x, s in share.items()}
    odd = 0
    for k, t, _ in rows[:400]:
        hits = {x: sum(g in s for g in grams(t)) for x, s in sets.items()}
        odd += got[k]["lang_pred"] != max(sorted(hits), key=hits.get)
    assert odd == 0
