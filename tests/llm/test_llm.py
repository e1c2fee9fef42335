"""Training-data operators against brute force, on small tables with null, empty, very long, repeated and tied rows."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pluvia.llm import image_copies as I
from pluvia.llm import jaccard_join, language_id, line_crf, mixing, packing, quality_rules, queries, suffix_dedup, toxicity, warc
from pluvia.llm.common import components
from pluvia.llm.jaccard_join import jaccard_components, needed
from pluvia.llm.language_id import languages
from pluvia.llm.line_crf import marginals, quality_scores
from pluvia.llm.quality_rules import divergence_rules
from pluvia.llm.toxicity import offending, toxicity_scores

SCHEMA = T.StructType([T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("n_chars", T.LongType()), ("score", T.StringType()), ("rate", T.StringType()), ("words", T.StringType()))])
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _texts() -> list[str | None]:
    rng = np.random.default_rng(5)
    vocabulary = ["the", "of", "and", "Ünder", "straße", "naïve", *(f"w{k}" for k in range(300))]
    say = lambda n: " ".join(rng.choice(vocabulary, n))
    base, passage = say(200), say(130)
    near = base.split()
    near[17] = "CHANGED"
    return [
        base, base, " ".join(near), None, "", " \n\t ", "one", "one two", "One two", "one two three", say(120), f"{say(80)}\n{passage}\n{say(70)}", f"{say(60)} {passage}.", passage[3:], "a b " * 400,
        "line\nline\n line\n\nline", say(60) + " #*$%&|<> " * 9, say(20_000), "x" * 5000, "\x00\x00 nul \x0b vt", "日本語 テキスト " * 60, say(55) + "!",
    ]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, None if k % 5 == 4 else "en", None if k % 7 == 6 else f"s{k % 3}", 0, "clash", "clash", "clash") for k, t in enumerate(_texts())]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def test_components(spark):
    edges = [(k, k + 1) for k in range(30)] + [(50, 40), (40, 45), (7, 7), (60, 61), (61, 60)]
    got = {r[0]: r[1] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(31)}, 50: 40, 40: 40, 45: 40, 60: 60, 61: 60}


def test_rules_equal_brute_force(docs, nothing):
    got = {r["doc_id"]: r for r in divergence_rules(docs).collect()}
    assert len(got) == len(_texts())
    for k, t in enumerate(_texts()):
        t = t or ""
        w = WORD.findall(t)
        windows = list(zip(w, w[1:], w[2:], strict=False))
        often = Counter(windows)
        repeat = {j for i, x in enumerate(windows) if often[x] > 1 for j in (i, i + 1, i + 2)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        r = got[k]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(repeat))
        assert r["base_failed"] == (len(w) < 50 or 100 * len(repeat) > 50 * len(w))
        assert not (r["base_failed"] and r["kept"])
    assert divergence_rules(nothing).count() == 0
    assert divergence_rules(docs.withColumn("lang", F.lit(None).cast("string"))).where("kept").count() > 0


def test_suffix_dedup_equals_brute_force(docs, nothing):
    texts = [(t or "").encode() for t in _texts()]
    for length, anchor in ((400, 200), (60, 24)):
        count = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
        got = {r["doc_id"]: r for r in suffix_dedup.substring_report(docs, length, anchor).collect()}
        for k, t in enumerate(texts):
            cover = np.zeros(len(t) + 1, int)
            for i in range(len(t) - length + 1):
                if count[t[i : i + length]] > 1:
                    cover[i] += 1
                    cover[i + length] -= 1
            gone = np.cumsum(cover)[: len(t)] > 0
            kept = bytes(np.frombuffer(t, np.uint8)[~gone]) if t else b""
            r = got[k]
            assert (r["n_bytes"], r["n_removed"], r["kept_sha256"]) == (len(t), int(gone.sum()), hashlib.sha256(kept).hexdigest())
            assert r["n_spans"] == int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
    assert suffix_dedup.substring_report(nothing).count() == 0


def test_suffix_dedup_of_hot_anchors_and_small_batches(spark, docs):
    want = sorted(map(tuple, suffix_dedup.substring_report(docs, 60, 24).collect()))
    plain = docs.select(F.col("doc_id").alias("row_id"), "text")
    for options in ({"hot": 1}, {"batch": 8}, {"shard": 16}):
        spans, _ = suffix_dedup.repeated_spans(plain, 60, 24, **options)
        got = {r[0]: sum(b - a for a, b in suffix_dedup._union(np.array([x[0] for x in r[1]]), np.array([x[1] for x in r[1]]), 60)) for r in spans.collect()}
        assert {r[0]: r[2] for r in want if r[2]} == got


def test_cut_texts_keep_rows_columns_and_whole_characters(docs):
    out = suffix_dedup.without_repeats(docs, 60, 24)
    assert out.columns == docs.columns
    got = {r["doc_id"]: r["text"] for r in out.collect()}
    assert len(got) == len(_texts()) and got[3] is None and "�" not in "".join(t or "" for t in got.values())


def test_rows_of_one_id_are_cut_each_for_itself(spark):
    say = lambda name, k: " ".join(f"{name}{j}" for j in range(k))
    passage, again = say("passage", 60), say("again", 90)
    rows = [(1, f"{say('a', 40)} {passage} {say('b', 30)}"), (1, f"{say('c', 150)} {passage}"), (1, say("d", 120)), (2, f"{passage} {say('e', 9)}"), (3, again), (3, again), (4, None)]
    texts = [(t or "").encode() for _, t in rows]
    count = Counter(t[i : i + 400] for t in texts for i in range(len(t) - 399))
    kept = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - 399):
            gone[i : i + 400] |= count[t[i : i + 400]] > 1
        kept.append(bytes(b for b, g in zip(t, gone, strict=True) if not g))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["kept_sha256"]) for r in suffix_dedup.substring_report(docs).collect())
    assert got == sorted((k, len(t), len(t) - len(x), hashlib.sha256(x).hexdigest()) for (k, _), t, x in zip(rows, texts, kept, strict=True))
    got = sorted((r["doc_id"], (r["text"] or "").encode()) for r in suffix_dedup.without_repeats(docs).collect())
    assert got == sorted((k, x) for (k, _), x in zip(rows, kept, strict=True))


def _components(texts, width, percent):
    sets = []
    for t in texts:
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.append(set() if not w else {tuple(w)} if len(w) < width else set(zip(*(w[k:] for k in range(width)), strict=False)))
    root = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= percent * len(a | sets[j]):
                x, y = root[i], root[j]
                root = [min(x, y) if r in (x, y) else r for r in root]
    return {k: (len(s), root[k]) for k, s in enumerate(sets)}


@pytest.mark.parametrize(("width", "percent"), [(3, 90), (5, 80), (3, 50)])
def test_jaccard_components(spark, docs, nothing, width, percent):
    rng = np.random.default_rng(9)
    texts = list(_texts())
    for family in range(6):  # families of near copies about the threshold, some of them in chains
        words = [f"f{family}_{k}" for k in range(60 + 20 * family)]
        for _ in range(14):
            words = words.copy()
            words[rng.integers(len(words))] = f"n{rng.integers(10**9)}"
            texts.append(" ".join(words) + (" common line that all share and more of it" if family % 2 else ""))
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_components(d, width, percent).collect()}
    assert got == _components(texts, width, percent)
    assert jaccard_components(nothing, width, percent).count() == 0


@pytest.mark.parametrize(("width", "percent", "n", "m"), [(3, 90, 100, 109), (5, 80, 85, 104)])
def test_jaccard_links_into_groups_of_uneven_sizes(spark, width, percent, n, m):
    """A link of exactly the threshold, to the smaller one of a group of two: the bound for the larger size is higher."""
    both = -(-(n + m) * percent // (100 + percent))
    say = lambda name, k: " ".join(f"{name}{j}" for j in range(k))
    base = say("b", both + width - 1)
    y = f"{base} {say('y', m - both)}"
    texts = [f"{base} {say('x', n - both)}", y, f"{y} more"]
    want = _components(texts, width, percent)
    assert want == {0: (n, 0), 1: (m, 0), 2: (m + 1, 0)}
    got = jaccard_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1), width, percent).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want


@pytest.mark.parametrize("percent", [50, 80, 90])
def test_needed_overlap_is_the_least_over_all_sizes(spark, percent):
    up = lambda a, b: -(-a // b)
    rows = []
    for n in range(1, 131):
        for lo in range(up(n * percent, 100), n * 100 // percent + 1, 2):
            least = n
            for hi in range(lo, n * 100 // percent + 1):
                both = up((n + hi) * percent, 100 + percent)
                least = min(least, both - up(n * percent, 100) + 1, both - up(hi * percent, 100) + 1)
                rows.append((n, lo, hi, max(1, least)))
    d = spark.createDataFrame(rows, "n long, lo long, hi long, least long")
    assert d.where(needed(F.col("n"), F.col("lo"), F.col("hi"), percent) != F.col("least")).count() == 0


def test_packing(docs, nothing):
    from tokenizers import Tokenizer

    reader = Tokenizer.from_file(packing.tokenizer_paths()[0])
    got, sequences = defaultdict(list), defaultdict(list)
    for r in packing.packed_documents(docs).collect():
        got[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    total = 0
    for k, t in enumerate(_texts()):
        ids = np.array([*reader.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for n, p in enumerate(sorted(got[k], key=lambda p: p["piece"])):
            assert (p["piece"], p["start"], p["ids_crc32"]) == (n, at, zlib.crc32(ids[at : at + p["length"]].tobytes()))
            assert p["length"] == 1024 or n == 0
            at += p["length"]
        assert at == len(ids)
        total += at
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(sequences) <= -(-total // 1024) + 1
    assert packing.packed_documents(nothing).count() == 0


def test_special_token_spelling_is_read_as_the_tokenizer_reads_it():
    from tokenizers import Tokenizer

    t = "a <|endoftext|> b"
    paths = packing.tokenizer_paths()
    assert packing._Encoder.of(*paths).ids(t) == Tokenizer.from_file(paths[0]).encode(t, add_special_tokens=False).ids


def test_plans_hold_their_histograms():
    rng = np.random.default_rng(2)
    for _ in range(5):
        h = {int(n): int(m) for n, m in zip(rng.integers(1, 1024, 60), rng.integers(1, 40, 60), strict=True)}
        plan, seen = packing.pack(h, 1024), Counter()
        for count, have in plan:
            assert sum(have) <= 1024
            for n in have:
                seen[n] += count
        assert seen == Counter(h)
    assert packing.pack({}, 1024) == []


def test_mixture_equals_its_sql(docs, nothing):
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text", "source").toPandas())
    got = sorted(map(tuple, mixing.mixture_report(docs).collect()), key=repr)
    assert got == sorted(con.sql(mixing.ORACLE).fetchall(), key=repr)
    assert mixing.mixture_report(nothing).count() == 0


def test_mixture_meets_its_rates(spark):
    d = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("abcd").alias("text"), F.when(F.col("id") % 4 == 0, "a").otherwise("b").alias("source"))
    got = {r[0]: r[1] for r in mixing.replicated(d, weights={"a": 3.0, "b": 1.0}).groupBy("source").count().collect()}
    assert got["a"] == pytest.approx(15_000, rel=0.03) and got["b"] == pytest.approx(5_000, rel=0.05)


def test_archive_round_trip(spark, tmp_path):
    html = ["<p>ä</p>", "same", "same", None, "", "with\r\n\r\nWARC/1.1\r\n in it", "x" * 100_000]
    pages = spark.createDataFrame([(k, None if k == 1 else f"http://h/{k}", h) for k, h in enumerate(html)], "page_id long, url string, html string")
    path = f"file://{tmp_path}/a"
    got = {r["page_id"]: r for r in warc.capture_report(pages, path).collect()}
    for k, h in enumerate(html):
        data = (h or "").encode()
        last = max(j for j, x in enumerate(html) if (x or "") == (h or ""))
        r = got[k]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
        assert (r["record_type"], r["refers_to"]) == (("response", None) if last == k else ("revisit", last))
    t = warc.transactions(warc.read_records(spark, path)).collect()
    assert len(t) == len(html) and all(r["request"] and len(r["metadata"]) == 1 for r in t)
    assert warc.capture_report(pages.where("false"), f"file://{tmp_path}/b").count() == 0


def test_archive_reader_takes_members_and_refuses_noise():
    record = b"WARC/1.1\r\nWARC-Type: x\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n"
    import gzip

    assert [b for _, b in warc.parse(warc._inflated(gzip.compress(record) + gzip.compress(record)))] == [b"hi", b"hi"]
    with pytest.raises(ValueError):
        list(warc.parse(b"noise\r\n\r\n"))


def _labelled(spark, n=400):
    rng = np.random.default_rng(3)
    say = lambda k: " ".join(rng.choice([f"w{j}" for j in range(150)], k)) + "."
    rows = []
    for k in range(n):
        toxic, bad = k % 4 == 0, k % 3 == 0
        lines = [say(9) for _ in range(5)]
        if toxic:
            lines[2] = f"{say(4)} idiot scum {say(3)}"
        if bad:
            lines = [" ".join(f"{w.upper()}!!" for w in x.split()) for x in lines]
        rows.append((k, "\n".join(lines), int(not bad), int(toxic)))
    rows += [(n, None, 1, 0), (n + 1, "", 1, 0), (n + 2, "   \n ", None, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, quality int, toxic int")
    return d.select("doc_id", "text", F.lit("clash").alias("score")), d.select("doc_id", "quality", "toxic")


def test_toxicity(spark, nothing):
    docs, labels = _labelled(spark)
    s = toxicity_scores(docs, labels).join(labels, "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in s)
    tried = [r for r in s if r["held_out"] and r["toxic"] is not None]
    assert np.mean([r["predicted"] == r["toxic"] for r in tried]) > 0.95
    found = offending(docs, labels).collect()
    assert found and np.mean(["idiot" in r["sentence"].lower() for r in found]) > 0.9
    assert toxicity_scores(nothing, labels).count() == 0
    assert toxicity_scores(docs, labels.where("false")).count() == docs.count()


def test_quality(spark, nothing):
    docs, labels = _labelled(spark)
    s = quality_scores(docs, labels).join(labels, "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in s)
    assert np.mean([r["predicted"] == r["quality"] for r in s if r["held_out"] and r["quality"] is not None and r["n_lines"] > 1]) > 0.95
    assert quality_scores(nothing, labels).count() == 0
    assert quality_scores(docs, labels.where("false")).count() == docs.count()


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(0)
    doc = np.array([0, 0, 0, 1, 2, 2])
    score, pull = rng.normal(size=6), rng.normal(size=(2, 2))
    good, _, _ = marginals(score, doc, pull)
    for d in range(3):
        at = np.flatnonzero(doc == d)
        weight, total = np.zeros(len(at)), 0.0
        for m in range(2 ** len(at)):
            y = [(m >> k) & 1 for k in range(len(at))]
            w = np.exp(sum(score[a] * b for a, b in zip(at, y, strict=True)) + sum(pull[a, b] for a, b in zip(y, y[1:], strict=False)))
            total += w
            weight += w * np.array(y)
        assert np.allclose(good[at], weight / total)


def test_languages(spark, nothing):
    rng = np.random.default_rng(4)
    parts = {"aa": "lomi tera suno keli", "bb": "grsch wund stach ich", "cc": "eaux oire ment elle"}
    rows = [(k, " ".join("".join(rng.choice(parts[x].split(), 2)) for _ in range(rng.integers(3, 60))), x) for k in range(600) for x in [list(parts)[k % 3]]]
    rows += [(900, None, "aa"), (901, "12 34 !", "aa"), (902, "é", None), (903, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    s = {r["doc_id"]: r for r in languages(docs).collect()}
    assert [s[k]["lang_pred"] for k in (900, 901, 903)] == ["und"] * 3 and s[902]["lang_pred"] in parts
    assert np.mean([s[k]["lang_pred"] == x for k, _, x in rows[:600] if s[k]["held_out"]]) > 0.98
    assert languages(nothing).count() == 0


def test_image_copies(spark):
    vectors = spark.range(130).select(F.col("id").alias("vec_id"), F.transform(F.sequence(F.lit(1), F.lit(64)), lambda j: F.sin(j * 7.1 + F.col("id") * 1.7)).alias("embedding"))
    images = I.rendered(vectors).unionByName(spark.createDataFrame([(900, None, 900), (901, bytearray(b"P5 broken"), 901), (902, bytearray(I.to_pgm(np.full((40, 40), 9))), 902)], "image_id long, image binary, made_from long"))
    found = {(r["query_id"], r["image_id"]) for r in I.find_copies(images, images.where("image_id % 10 = 0 or image_id > 899"), block=4).collect()}
    true = {(k, k + 1) for k in range(0, 129, 10)}
    assert len(found & true) >= 0.9 * len(true) and not found - true
    assert I.find_copies(images.where("false"), images).count() == 0


def test_turned_images_match():
    x = np.clip(128 + 45 * I._stretched(np.random.default_rng(1).normal(size=(10, 10)), 64), 0, 255).astype(np.float32)
    a, b = I.describe(x), I.describe(np.rot90(x).copy())
    near = np.argwhere(np.bitwise_count(a[1].view(np.uint64)[:, None] ^ b[1].view(np.uint64)[None]).sum(2) <= 40)
    assert I.consensus(a[0][near[:, 0]], b[0][near[:, 1]])[0] >= 6


def test_pipeline_runs_and_keeps_clean_documents(spark):
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    n = docs.count()
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:3]):
        out = stage(spark, docs, d)
        assert out.columns == docs.columns
        m = out.count()
        assert m == n if k == 2 else 0.7 * n <= m <= n
        docs, n = out, m


def test_pipeline_equals_brute_force_stage_by_stage(spark, tmp_path, monkeypatch):
    import corpus_pipeline
    from tokenizers import Tokenizer

    learnt, labels = _labelled(spark)
    rows = [(r["doc_id"], r["text"], "learnt") for r in learnt.select("doc_id", "text").collect()]
    toxic = {r["doc_id"] for r in labels.where("toxic = 1").collect()}
    say = lambda name, n: " ".join(f"{name}{j}" for j in range(n))
    first, passage = max(r[0] for r in rows) + 1, say("passage", 70)
    planted = [say("base", 200), say("base", 200), say("base", 200) + " more", f"{say('a', 250)} {passage} {say('b', 150)}", f"{say('c', 200)} {passage} {say('d', 150)}", say("long", 1500), "", None]
    rows += [(first + k, t, f"s{k % 2}") for k, t in enumerate(planted)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    seen = []

    def watched(stage):
        def run(*a):
            out = stage(*a)
            seen.append([r.asDict() for r in out.collect()])
            return out

        return run

    monkeypatch.setattr(corpus_pipeline, "STAGES", [(name, watched(stage)) for name, stage in corpus_pipeline.STAGES])
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(map(repr, seen[4])) == sorted(repr(r.asDict()) for r in packed)
    tuples = lambda k: [(r["doc_id"], r["text"], r["source"]) for r in seen[k]]

    left = tuples(0)
    gone = {r[0] for r in rows} - {r[0] for r in left}
    assert set(left) <= set(rows) and len(left) + len(gone) == len(rows)
    assert len(gone & toxic) >= 0.95 * len(toxic) and len(gone - toxic) <= 0.05 * (len(rows) - len(toxic)) and max(gone) < first

    left.sort()
    part = _components([t for _, t, _ in left], 5, 80)
    left = [r for k, r in enumerate(left) if part[k][1] == k]
    assert sorted(tuples(1)) == left and {first + 1, first + 2}.isdisjoint(r[0] for r in left)

    count = Counter(t[i : i + 400] for _, t, _ in left if t for i in range(len(t) - 399))
    cut = []
    for k, t, source in left:
        lost = np.zeros(len(t or ""), bool)
        for i in range(len(lost) - 399):
            lost[i : i + 400] |= count[t[i : i + 400]] > 1
        cut.append((k, t and "".join(c for c, x in zip(t, lost, strict=True) if not x), source))
    assert sorted(tuples(2), key=repr) == sorted(cut, key=repr)
    assert all("passage30 " not in (t or "") for _, t, _ in cut)

    con = duckdb.connect()
    con.register("documents", spark.createDataFrame(cut, "doc_id long, text string, source string").toPandas())
    text = {k: (k, t, source) for k, t, source in cut}
    mixed = [text[r[0]] for r in con.sql(mixing.ORACLE).fetchall()]
    assert Counter(tuples(3)) == Counter(mixed)

    reader, want = Tokenizer.from_file(packing.tokenizer_paths()[0]), Counter()
    for k, t, _ in mixed:
        ids = np.array([*reader.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        cuts = [0, *range((len(ids) - 1) % 1024 + 1, len(ids) + 1, 1024)]
        want.update((k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for a, b in zip(cuts, cuts[1:], strict=False))
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in packed) == want
    sequences = defaultdict(list)
    for r in packed:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for s in sequences.values():
        ends = [a + n for a, n in sorted(s)]
        assert [a for a, _ in sorted(s)] == [0, *ends[:-1]] and ends[-1] <= 1024


def test_every_operator_has_a_query():
    assert [int(re.match(r"op(\d+)_", k)[1]) for k in queries.queries()] == list(range(1, 14))


# --- odd tables: rows without an id, ids of several rows, columns with the operators' own names ------------------------------

CLASH = ("row_id", "cdf", "of", "rate", "copy", "shuffle_key", "slice", "cut", "cut_text", "salt", "key", "predicted", "kept", "level", "name", "payload", "to", "n", "m", "component_id", "held_out", "first", "words")


def _odd_texts():
    say = lambda name, k: " ".join(f"{name}{j}" for j in range(k))
    passage = say("passage", 70)
    return [
        (1, say("a", 120)), (1, say("b", 120)), (1, say("b", 120)), (None, say("a", 120)), (None, f"{say('c', 60)} {passage}"), (None, f"{say('d', 60)} {passage}"), (None, None), (None, ""), (2, f"{say('b', 120)} more"),
        (3, say("e", 90)), (4, None), (5, " "), (6, say("f", 3)), (7, say("f", 3)), (8, say("g", 20_000)),
    ]


@pytest.fixture(scope="module")
def odd(spark):
    d = spark.createDataFrame([(k, t, "en" if i % 2 else None, f"s{i % 3}" if i % 4 else None) for i, (k, t) in enumerate(_odd_texts())], "doc_id long, text string, lang string, source string")
    return d.select("*", *(F.lit("clash").alias(c) for c in CLASH)).repartition(4)


def _oracle(name, **tables):
    con = duckdb.connect()
    for k, d in tables.items():
        con.register(k, d.toPandas().astype({c: "Int64" for c, t in d.dtypes if t == "bigint"}))
    r = con.sql(queries.oracle_sql()[name])
    order = sorted(r.columns)
    return order, sorted((tuple(row[r.columns.index(c)] for c in order) for row in r.fetchall()), key=repr)


def _same(name, got, **tables):
    order, want = _oracle(name, **tables)
    assert sorted(got.columns) == order
    assert sorted((tuple(r[c] for c in order) for r in got.collect()), key=repr) == want


def test_rules_equal_sql_with_their_verdicts(docs, odd, nothing):
    for d in (docs, odd):
        d = d.select("text", "lang", F.monotonically_increasing_id().alias("doc_id"))
        got = quality_rules.rules_report(d)
        _same("op1_divergence_rules", got, documents=d)
    assert {r["doc_id"] for r in quality_rules.divergence_rules(odd).collect()} == {None, 1, 2, 3, 4, 5, 6, 7, 8}
    assert quality_rules.rules_report(nothing).count() == 0


def test_other_operators_equal_their_sql(docs):
    plain = docs.select("doc_id", "text", "source")
    _same("op2_suffix_family", suffix_dedup.substring_report(plain), documents=plain)
    _same("op4_poisson_mix", mixing.mixture_report(plain), documents=plain)
    _same("op8_token_group_join", jaccard_join.jaccard_components(plain, 3, 90), documents=plain)
    pages = docs.select(F.col("doc_id").alias("page_id"), F.when(F.col("doc_id") % 3 != 0, F.concat(F.lit("http://h/"), F.col("doc_id"))).alias("url"), F.col("text").alias("html"))
    _same("op6_warc_transactions", warc.capture_report(pages), pages=pages)


def test_odd_rows_are_cut_each_for_itself(odd):
    want = Counter()
    texts = [(k, (t or "").encode()) for k, t in _odd_texts()]
    count = Counter(t[i : i + 400] for _, t in texts for i in range(len(t) - 399))
    for k, t in texts:
        gone = np.zeros(len(t) + 1, int)
        for i in range(len(t) - 399):
            if count[t[i : i + 400]] > 1:
                gone[i] += 1
                gone[i + 400] -= 1
        left = bytes(np.frombuffer(t, np.uint8)[np.cumsum(gone)[: len(t)] == 0])
        want[k, len(t), hashlib.sha256(left).hexdigest()] += 1
    assert Counter((r["doc_id"], r["n_bytes"], r["kept_sha256"]) for r in suffix_dedup.substring_report(odd).collect()) == want
    out = suffix_dedup.without_repeats(odd)
    assert out.columns == odd.columns and out.count() == len(texts) and out.where("cdf <> 'clash' or cut <> 'clash'").count() == 0
    assert Counter((r["doc_id"], hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in out.collect()) == Counter((k, h) for (k, _, h), n in want.items() for _ in range(n))


def test_odd_rows_of_the_join(spark, odd):
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(odd, 5, 80).collect())
    rows = _odd_texts()
    part = _components([t for _, t in rows], 5, 80)
    least = {}
    for k, (_, p) in part.items():
        if rows[k][0] is not None:
            least[p] = min(least.get(p, 10**9), rows[k][0])
    assert got == Counter((rows[k][0], n, least.get(p)) for k, (n, p) in part.items())
    left = jaccard_join.one_of_each(odd, 5, 80)
    assert left.columns == odd.columns
    kept = Counter((r["doc_id"], r["text"]) for r in left.collect())
    assert len(kept) == sum(kept.values()) == len({p for _, p in part.values()})
    # of two different texts with one id, only the copy goes
    assert {(1, rows[0][1]), (1, rows[1][1])} <= set(kept) and (None, rows[3][1]) not in kept and (2, rows[8][1]) not in kept


def test_unlinked_documents_in_many_partitions(spark):
    say = lambda k: " ".join(f"w{k}_{j}" for j in range(30))
    for n, parts in ((2, 1), (10, 4), (3, 20)):
        d = spark.createDataFrame([(k, say(k)) for k in range(n)], "doc_id long, text string").repartition(parts)
        assert {(r["doc_id"], r["component_id"]) for r in jaccard_join.jaccard_components(d).collect()} == {(k, k) for k in range(n)}
    d = spark.createDataFrame([(k, say(0 if k in (3, 7) else k)) for k in range(10)], "doc_id long, text string").repartition(8)
    assert {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_components(d).collect()} == {**{k: k for k in range(10)}, 3: 0, 7: 0}


def test_hot_tokens_change_no_component(spark, monkeypatch):
    rng = np.random.default_rng(3)
    line = " ".join(f"c{j}" for j in range(30))
    texts = [line, line, None, *(f"{line} x{k}" for k in range(12)), *(" ".join([line, *(f"o{rng.integers(10**9)}" for _ in range(3 * k))]) for k in range(12)), *(f"a{k} b{k} c{k} d{k} e{k} f{k}" for k in range(5))]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want = _components(texts, 3, 90)
    for most in (0, 4):
        monkeypatch.setattr(jaccard_join, "HOT", most)
        order = spark.sparkContext.broadcast(jaccard_join._sketch(d, 3))
        assert jaccard_join.signatures(d, 3, 90, order).where("size(hot) > 0 and size(hot) < size(signature)" if most else "size(hot) > 0").count() > 0
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_components(d, 3, 90).collect()} == want


def test_sketches_are_summed_by_a_tree(spark):
    d = spark.range(200).select(F.col("id").alias("doc_id"), F.concat(F.lit("a b c "), F.col("id").cast("string")).alias("text")).repartition(150)
    often = jaccard_join._sketch(d, 3)
    assert often.max() == 200 and int(often.sum()) == 400


def test_odd_rows_of_the_mixture(odd):
    own = odd.columns
    d = mixing.replicated(odd, epochs=3.0)
    assert d.columns == [*own, "rate_", "copy_", "shuffle_key_"] and d.where("cdf <> 'clash' or rate <> 'clash' or copy <> 'clash'").count() == 0
    few = lambda x: sorted((r["doc_id"] or -1, r["text"] or "", r["copy_"], r["shuffle_key_"]) for r in x.collect())
    assert few(d) == few(mixing.replicated(odd, epochs=3.0, most_broadcast=0)) and d.count() > 0
    _same("op4_poisson_mix", mixing.mixture_report(odd.select("doc_id", "source", "text")), documents=odd.select("doc_id", "source", "text"))
    # rows without an id draw apart
    a = odd.sparkSession.createDataFrame([(None, f"text {k}", "s") for k in range(300)], "doc_id long, text string, source string")
    assert len({r["n"] for r in mixing.replicated(a).groupBy("text").agg(F.count("*").alias("n")).collect()}) > 1


def test_odd_captures(spark):
    rows = [(1, "u", "same"), (1, "v", "same"), (1, "v", "same"), (None, None, "same"), (None, "w", "other"), (2, None, None), (3, "x", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").select("*", *(F.lit("clash").alias(c) for c in CLASH))
    got = Counter((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"], r["url"]) for r in warc.capture_report(pages).collect())
    assert sum(got.values()) == len(rows) and sum(n for k, n in got.items() if k[2] == "response") == 3
    assert got[None, 4, "revisit", 1, "about:blank"] == 1 and got[None, 5, "response", None, "w"] == 1 and got[2, 0, "revisit", 3, "about:blank"] == 1 and got[3, 0, "response", None, "x"] == 1
    assert sum(n for k, n in got.items() if k[:4] == (1, 4, "revisit", 1)) == 2
    assert Counter(r["record_type"] for r in warc.capture_report(pages.where("page_id is null")).collect()) == {"response": 2}


def test_archives_of_large_captures_are_split(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 1 << 16)
    pages = spark.createDataFrame([(k, f"http://h/{k}", ("x" if k % 5 else "yz" * 200) * (k + 900)) for k in range(120)], "page_id long, url string, html string").coalesce(1)
    path = f"{tmp_path}/a"
    assert warc.capture_report(pages, f"file://{path}").count() == 120
    import glob

    assert len(glob.glob(f"{path}/*/*.gz")) > 8


def test_odd_rows_of_the_classifiers(spark, odd, nothing):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (None, 1, 1), (3, None, None), (3, 0, 0)], "doc_id long, quality int, toxic int")
    for out in (toxicity_scores(odd, labels), quality_scores(odd, labels), languages(odd)):
        rows = out.collect()
        assert len(rows) == len(_odd_texts()) and all(r["held_out"] is not None and 0 <= r["score"] <= 1 for r in rows)
        assert not any(r["held_out"] for r in rows if r["doc_id"] is None)
    left = toxicity.without_toxic(odd, labels)
    assert left.columns == odd.columns and left.schema == odd.schema
    assert sum(r["predicted"] == 0 for r in toxicity_scores(odd, labels).collect()) == left.count()
    assert toxicity.without_toxic(nothing, labels).count() == 0


def test_odd_rows_are_packed(odd):
    rows = packing.packed_documents(odd).collect()
    assert sum(r["piece"] == 0 for r in rows) == len(_odd_texts())
    spread = packing.place(packing.pieces(odd), most_slots=0).collect()
    key = lambda r: (r["doc_id"] or -1, r["piece"], r["ids_crc32"], r["length"])
    assert sorted(map(key, spread)) == sorted(map(key, rows))
    for found in (rows, spread):
        sequences = defaultdict(list)
        for r in found:
            sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        for s in sequences.values():
            ends = [a + n for a, n in sorted(s)]
            assert [a for a, _ in sorted(s)] == [0, *ends[:-1]] and ends[-1] <= 1024


def test_pipeline_of_odd_and_empty_tables(spark, odd, nothing, tmp_path):
    import corpus_pipeline

    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int")
    for name, d in (("odd", odd), ("nothing", nothing)):
        folder = f"{tmp_path}/{name}"
        d.write.parquet(f"{folder}/documents.parquet")
        labels.write.parquet(f"{folder}/labels.parquet")
        at = spark.read.parquet(f"{folder}/documents.parquet")
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
            out = stage(spark, at, folder)
            assert out.columns == d.columns
            if k in (0, 2):
                assert out.count() == at.count()
            at = out
        assert (corpus_pipeline.run(spark, folder).count() > 0) == (name == "odd")


# --- the methods themselves against plain versions ---------------------------------------------------------------------------


def test_document_quality_equals_enumeration(spark):
    docs, labels = _labelled(spark)
    weights, pull, shift = line_crf.fit(docs, labels)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = {r["doc_id"]: r["score"] for r in quality_scores(docs, labels).collect()}
    for k in (0, 1, 2, 3, 50, 400, 402):
        ((_, _, doc, size, x),) = line_crf.line_features([(texts[k] or "").encode()])
        s = line_crf.with_neighbours(x, doc) @ weights
        total, good = 0.0, np.zeros(len(s))
        for m in range(2 ** len(s)):
            y = [(m >> j) & 1 for j in range(len(s))]
            w = np.exp(sum(a * b for a, b in zip(s, y, strict=True)) + sum(pull[a, b] for a, b in zip(y, y[1:], strict=False)))
            total, good = total + w, good + w * np.array(y)
        length = np.maximum(size, 1)
        p = np.clip((good / total * length).sum() / length.sum(), 1e-4, 1 - 1e-4)
        assert got[k] == pytest.approx(1 / (1 + np.exp(-(np.log(p / (1 - p)) + shift))), abs=1e-9)


def test_noisy_or_by_hand(spark):
    docs, labels = _labelled(spark)
    texts, y, prior = toxicity._fit(docs, labels, "toxic", (5, 0), 1800, 12 << 20)
    weights, bias, shift = toxicity.train(texts, y, prior)
    got = {r["doc_id"]: r for r in toxicity_scores(docs, labels).collect()}
    for r in docs.where("doc_id in (0, 1, 2, 4, 9, 400, 401, 402)").collect():
        none = 1.0
        sentences = [x for part in (r["text"] or "").split("\n") for x in re.split(r"(?<=[.!?]) ", part) if x.strip()]
        for x in sentences:
            ((*_, where),) = toxicity.sentence_words([x.encode()])
            none *= 1 - 1 / (1 + np.exp(-(bias + weights[where].sum())))
        p = 1 - none
        want = 0.0 if not sentences else 1 / (1 + np.exp(-(np.log(max(p, 1e-13)) - np.log(none) - shift)))
        assert got[r["doc_id"]]["n_sentences"] == len(sentences) and got[r["doc_id"]]["score"] == pytest.approx(want, abs=1e-6)


def test_filters_hold_their_sets():
    rng = np.random.default_rng(8)
    known = {k: rng.integers(0, 1 << 63, 3000, dtype=np.uint64) for k in range(3)}
    known[1][:500] = known[0][:500]
    f = language_id.Filters(["a", "b", "c"])
    for k, h in known.items():
        f.add(k, h)
    asked = np.concatenate([known[0][:700], known[2][:40], rng.integers(0, 1 << 63, 5000, dtype=np.uint64)])
    counts = f.popcounts(np.zeros(len(asked), np.int64), asked, 1)[0]
    exact = np.array([np.isin(asked, h).sum() for h in known.values()])
    assert (counts >= exact).all()
    rate = f.false_rate()
    true = (counts - len(asked) * rate) / (1 - rate)
    assert np.abs(true - exact).max() < 4 * np.sqrt(len(asked) * rate.max() + 1) + 1
    many = language_id.Filters([f"l{k}" for k in range(70)])
    many.add(69, known[0])
    assert many.popcounts(np.zeros(700, np.int64), known[0][:700], 1)[0][69] == 700


def test_image_tables_find_what_all_pairs_find(spark):
    rng = np.random.default_rng(21)
    blob = lambda: np.clip(128 + 45 * I._stretched(rng.normal(size=(9, 9)), 96) + 35 * I._stretched(rng.normal(size=(18, 18)), 96), 0, 255)
    rows, k = [], 0
    edits = [
        lambda x: np.rot90(x), lambda x: np.rot90(x, 2), lambda x: x[10:80, 14:90], lambda x: x[5:60, 30:92] * 0.7 + 40, lambda x: np.clip(x + rng.normal(0, 6, x.shape), 0, 255),
        lambda x: I._shrunk(x.astype(np.float32), 1.25), lambda x: np.rint(x / 16) * 16, lambda x: I._shrunk(x.astype(np.float32), 2.0), lambda x: x[24:72, 24:72],
    ]
    for _ in range(16):
        x = blob()
        rows.append((k, bytearray(I.to_pgm(np.rint(x)))))
        rows += [(k + 1 + j, bytearray(I.to_pgm(np.clip(np.rint(np.ascontiguousarray(e(x))), 0, 255)))) for j, e in enumerate(edits)]
        k += 10
    images = spark.createDataFrame(rows, "image_id long, image binary").repartition(4)
    found = {(r["query_id"], r["image_id"]) for r in I.find_copies(images, images.where("image_id % 10 = 0"), block=8).collect()}
    described = {i: I.describe(I.from_pgm(b)) for i, b in rows}
    exact = set()
    for q in range(0, k, 10):
        for i, (p, b) in described.items():
            if i == q:
                continue
            near = np.argwhere(np.bitwise_count(described[q][1].view(np.uint64)[:, None] ^ b.view(np.uint64)[None]).sum(2) <= 40)
            if len(near) >= 6 and I.consensus(described[q][0][near[:, 0]], p[near[:, 1]])[0] >= 6:
                exact.add((q, i))
    true = {(q, i) for q, i in exact if i // 10 == q // 10}
    assert len(true) >= 0.95 * 16 * len(edits) and len(exact - true) <= 0.02 * 16 * 15 * len(edits)
    assert not found - exact
    for j in range(1, len(edits) + 1):  # each edit by itself
        of_edit = {p for p in true if p[1] % 10 == j}
        assert len(found & of_edit) >= 0.95 * len(of_edit), j
    again = images.unionByName(images).unionByName(spark.createDataFrame([(None, rows[0][1])], "image_id long, image binary"))
    twice = [(r["query_id"], r["image_id"]) for r in I.find_copies(again, again.where("image_id % 10 = 0"), block=8).collect()]
    assert len(twice) == len(set(twice)) and set(twice) == found
