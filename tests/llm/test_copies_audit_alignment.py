"""Exact copies, the audit of filters and the alignment of tokenizers against brute force and SQL, on odd rows."""

from __future__ import annotations

import hashlib
import re
import string
from collections import Counter, defaultdict
from itertools import permutations

import duckdb
import numpy as np
import pytest
from pyspark.sql import types as T

from pluvia.llm import alignment, exact_dedup, filter_audit

SCHEMA = T.StructType([T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("digest", T.StringType()), ("row", T.StringType()), ("part", T.StringType()), ("mask", T.StringType()), ("block", T.StringType()))])


def _texts() -> list[str | None]:
    rng = np.random.default_rng(11)
    say = lambda n: " ".join(rng.choice(["the", "of", "Ünder", "straße", "don't", "x1", "naïve", *(f"w{k}" for k in range(60))], n))
    base = say(120)
    return [
        base, base, base.upper(), base.swapcase(), None, "", "", " ", "  ", " \n\t ", "ÄÖ", "äö", "one", "One", say(300), "A B C # " * 60, "word " * 130, " ".join(f"u{k}" for k in range(140)), "x" * 5000, say(20_000),
        "a\r\nb;\r\nc );\r x", "tab\tand\n\n  lines\n", "no\xa0break 　 wide em\x1cfs \x85nel", "▁marked ▁ text", "<|endoftext|> <s> </s> <unk> <0x41>", "\x00nul \x00", "日本語 テキスト ﬁ ﬃ é 👩‍👩‍👧", "'s 'll it's  we'll", "12345 6 7,8.9",
    ]


@pytest.fixture(scope="module")
def rows():
    out = [(k, t, ("en", "de", None, "")[k % 4], *["clash"] * 5) for k, t in enumerate(_texts())]
    return [*out, (0, _texts()[0], "en", *["twin"] * 5), (14, "another text of one id", "de", *["clash"] * 5), (None, "one", "en", *["clash"] * 5), (None, "ONE", None, *["clash"] * 5), (None, "lonely", None, *["clash"] * 5), (None, "lonely", "en", *["clash"] * 5)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    marks = [(k, int(k % 3 == 0), int(k % 4 == 0)) for k in range(0, 25)] + [(3, None, 1), (4, 0, None), (None, 1, 1), (999, 1, 1)]
    return spark.createDataFrame(marks, "doc_id long, quality int, toxic int")


def _sql(query: str, **tables) -> Counter:
    db = duckdb.connect()
    for name, df in tables.items():
        db.register(name, df.toArrow())
    out = db.sql(query)
    return sorted(out.columns), Counter(tuple(dict(zip(out.columns, r, strict=True)).items()) for r in out.fetchall())


def _same(df, query: str, **tables) -> None:
    names, want = _sql(query, **tables)
    got = Counter(tuple((c, r[c]) for c, _ in next(iter(want))) for r in df.collect()) if want else Counter(tuple(r) for r in df.collect())
    assert sorted(df.columns) == names and got == want


# --- exact copies ------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("counters", [1, 2, 1024])
def test_copies_equal_sql_and_brute_force(docs, rows, counters):
    got = exact_dedup.copies_report(docs, counters)
    _same(got, exact_dedup.ORACLE, documents=docs)
    lower = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
    groups = defaultdict(list)
    for r in rows:
        groups[hashlib.sha256((r[1] or "").translate(lower).encode()).hexdigest()].append(r[0])
    want = Counter()
    for name, ids in groups.items():
        order = sorted(ids, key=lambda k: -1 if k is None else k, reverse=True)
        want.update((k, order[0], len(ids), j == 0, name) for j, k in enumerate(order))
    assert Counter(tuple(r) for r in got.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()) == want


def test_copies_of_nothing_and_of_null_texts(spark, nothing):
    assert exact_dedup.copies_report(nothing).count() == 0 and exact_dedup.without_copies(nothing).columns == nothing.columns
    null = spark.createDataFrame([(k, None, None, *["x"] * 5) for k in range(40)], SCHEMA)
    assert [(r["keep_id"], r["group_size"]) for r in exact_dedup.copies_report(null).where("kept").collect()] == [(39, 40)]


def test_rows_that_stay_keep_their_columns(docs, rows, spark):
    report = exact_dedup.copies_report(docs)
    left = exact_dedup.without_copies(docs)
    assert left.columns == docs.columns
    assert Counter(r["doc_id"] for r in left.collect()) == Counter(r["doc_id"] for r in report.where("kept").collect())
    unique = spark.createDataFrame([(k, t, None, *["x"] * 5) for k, t in enumerate(_texts())], SCHEMA)
    kept = {r["doc_id"] for r in exact_dedup.copies_report(unique).where("kept").collect()}
    assert {(r["doc_id"], r["text"]) for r in exact_dedup.without_copies(unique).collect()} == {(k, t) for k, t in enumerate(_texts()) if k in kept}


def test_summaries_never_miss_a_frequent_key(spark):
    rng = np.random.default_rng(2)
    for k in (1, 3, 8):
        keys = [bytes([min(int(x), 255)]) * 4 for x in rng.zipf(1.3, 4000)] + [b"late"] * 600
        want = {x for x, m in Counter(keys).items() if m * (k + 1) > len(keys)}
        df = spark.createDataFrame([(x,) for x in keys], "digest binary").repartition(7)
        got = {bytes(r[0]) for r in exact_dedup.frequent(df, k).collect()}
        assert want <= got and len(got) <= k
        summary = exact_dedup.Summary(k)
        for lo in range(0, len(keys), 97):
            part = Counter(keys[lo : lo + 97])
            summary.add(list(part), list(part.values()))
        for x, m in Counter(keys).items():
            assert m - len(keys) / (k + 1) <= summary.held.get(x, 0) <= m


def test_frequent_digests_are_not_shuffled(spark):
    """Half of the rows are of one text: no exchange of the plan holds them row by row."""
    docs = spark.createDataFrame([(k, "hot" if k % 2 else f"t{k}") for k in range(4000)], "doc_id long, text string")
    out = exact_dedup.copies_report(docs)
    assert out.where("kept and group_size = 2000 and keep_id = 3999").count() == 1 and out.count() == 4000
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


# --- audit -------------------------------------------------------------------------------------------------------


def _audit(rows, labels):
    word = re.compile(r"[^\x20\x09-\x0D]+")
    good, toxic, least = defaultdict(bool), defaultdict(bool), {}
    for r in labels.collect():
        good[r["doc_id"]] |= r["quality"] == 1
        toxic[r["doc_id"]] |= r["toxic"] == 1
    for r in rows:
        if r[0] is not None:
            least[r[1] or ""] = min(least.get(r[1] or "", r[0]), r[0])
    parts = defaultdict(list)
    for r in rows:
        t = r[1] or ""
        w = word.findall(t)
        fails = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * sum(c in string.ascii_uppercase for c in t) > 10 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": r[0] is not None and r[0] > least[t]}
        parts[r[2] or ""].append(({c for c in fails if fails[c]}, r[0] is not None and good[r[0]], r[0] is not None and toxic[r[0]]))
    out = []
    for part, members in parts.items():
        removed = defaultdict(int)
        rows_ = []
        for order in permutations("ABCDE"):
            left = members
            for step, c in enumerate(order, 1):
                gone = [m for m in left if c in m[0]]
                left = [m for m in left if c not in m[0]]
                removed[c] += len(gone)
                rows_.append((part, "".join(order), step, len(left), len(gone), sum(c in m[0] for m in members) - len(gone), sum(m[0] == {c} for m in members), sum(m[1] for m in gone), sum(m[2] for m in gone)))
        out += [(*r, removed[r[1][r[2] - 1]]) for r in rows_]
    return out


def test_audit_equals_sql_and_brute_force(docs, rows, labels, nothing):
    got = filter_audit.interaction_audit(docs, labels)
    names = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    assert sorted(tuple(r) for r in got.select(*names).collect()) == sorted(_audit(rows, labels))
    _same(got, filter_audit.ORACLE, documents=docs, labels=labels)
    assert filter_audit.interaction_audit(nothing, labels).count() == 0
    assert filter_audit.interaction_audit(docs, labels.limit(0)).where("good_lost + toxic_lost > 0").count() == 0


def test_audit_of_one_text_everywhere(spark, labels):
    docs = spark.createDataFrame([(k, "same", "en") for k in range(500)], "doc_id long, text string, lang string")
    got = filter_audit.interaction_audit(docs, labels).where("filter_order = 'EABCD' and step = 1").first()
    assert (got["removed"], got["kept"], got["unique_fails"]) == (499, 1, 0)


# --- alignment ---------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def pair():
    return alignment.Pair(tuple(open(p, "rb").read() for p in alignment.tokenizer_files()))


def _plain(pair, text):
    """(a ids, b ids, groups, links) of a whole text, all pairs of tokens compared; None where the bytes differ."""
    if not text:
        return None
    data = f" {text}".encode()
    a, b = pair.a.encode(f" {text}", add_special_tokens=False).ids, pair.b.encode(text)
    if b"".join(pair.bytes_a[k] for k in a) != data or b"".join(pair.bytes_b[k] for k in b) != data:
        return None
    end_a, end_b = np.cumsum([len(pair.bytes_a[k]) for k in a]), np.cumsum([len(pair.bytes_b[k]) for k in b])
    start_a, start_b = np.append(0, end_a[:-1]), np.append(0, end_b[:-1])
    links = [(a[i], b[j]) for i in range(len(a)) for j in range(np.searchsorted(end_b, start_a[i], side="right"), np.searchsorted(start_b, end_a[i]))]
    groups, i, j = [], 0, 0
    for cut in sorted(set(end_a) & set(end_b)):
        m, n = int(np.searchsorted(end_a, cut)) + 1, int(np.searchsorted(end_b, cut)) + 1
        groups.append(",".join(map(str, a[i:m])) + "|" + ",".join(map(str, b[j:n])))
        i, j = m, n
    return a, b, groups, links


def _report(pair, rows):
    found = [(r[0], _plain(pair, r[1])) for r in rows]
    count = Counter(x for _, p in found if p for x in set(p[3]))
    best = defaultdict(int)
    for (a, _), m in count.items():
        best[a] = max(best[a], m)
    return sorted(
        ((k, len(p[0]), len(p[1]), len(p[2]), len(p[3]), sum(count[x] == best[x[0]] for x in p[3]), sum(count[x] for x in p[3]), hashlib.sha256(";".join(p[2]).encode()).hexdigest()) if p else (k, 0, 0, 0, 0, 0, 0, "") for k, p in found),
        key=str,
    )


@pytest.mark.parametrize(("block_chars", "most_pairs"), [(1, 1 << 20), (2000, 0), (alignment.BLOCK_CHARS, 1 << 20)])
def test_alignment_equals_brute_force(docs, rows, pair, block_chars, most_pairs):
    got = alignment.token_alignments(docs, block_chars=block_chars, most_pairs=most_pairs)
    names = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
    found = sorted(((*(r[c] for c in names), hashlib.sha256(r["groups"].encode()).hexdigest() if r["groups"] else "") for r in got.collect()), key=str)
    odd = [(g[0], w[0]) for g, w in zip(found, _report(pair, rows), strict=True) if g != w]
    assert not odd and sum(r[1] > 0 for r in found) > 25


def test_alignment_report_of_nothing(docs, nothing, spark, pair):
    assert alignment.alignment_report(nothing).count() == 0
    only = spark.createDataFrame([(1, None), (2, ""), (None, "▁")], "doc_id long, text string")
    assert sorted((r["n_a"], r["n_links"], r["groups_sha256"]) for r in alignment.alignment_report(only).collect()) == [(0, 0, "")] * 3
    one = alignment.alignment_report(spark.createDataFrame([(7, "Hello  world")], "doc_id long, text string")).first()
    p = _plain(pair, "Hello  world")
    assert one["groups_sha256"] == hashlib.sha256(";".join(p[2]).encode()).hexdigest() and one["n_links"] == len(p[3]) == one["n_best"] == one["count_sum"]


def test_cuts_are_proved_and_segments_are_whole(pair):
    cut = pair.cuts()
    assert " " in cut and "\n" in cut and "\r" not in cut  # B has pieces such as ";\r"
    find = alignment.segments_pattern(cut).findall
    rng = np.random.default_rng(4)
    signs = [" ", " ", "\n", "\t", "\r", "\xa0", " ", "\x1c", "a", "the", "'s", ";", ")", "}", "<", "0x0A", ">", "é", "ß", "日", "👍", "1", "ing", "́"]
    for _ in range(3000):
        text = " " + "".join(rng.choice(signs, rng.integers(1, 25)))
        parts = find(text)
        assert "".join(parts) == text
        a = [k for s in parts for k in pair.a.encode(s, add_special_tokens=False).ids]
        assert a == pair.a.encode(text, add_special_tokens=False).ids == [k for s in parts for k in pair.fast(s)]
        b = [k for s in parts for k in ([pair.blank] if s == " " else pair.b.encode(s[1:]) if s[0] == " " else pair.b.encode(s)[1:])]
        assert b == (pair.b.encode(text[1:]) or [pair.blank])


def test_a_tokenizer_that_merges_across_is_not_cut_there(pair):
    class Odd(alignment.Pair):
        def __init__(self):
            self.kind, self.b, self.bytes_a, self.bytes_b = pair.kind, pair.b, pair.bytes_a, [*pair.bytes_b, b"of the", b" \n"]

    odd = Odd()
    odd.b = type("B", (), {"normalize": pair.b.normalize, "is_byte": lambda self, k: k < pair.b.get_piece_size() and pair.b.is_byte(k)})()
    assert " " not in odd.cuts() and "\n" not in odd.cuts()


def test_texts_of_groups_do_not_depend_on_portions(pair):
    parts = alignment.segments_pattern(pair.cuts()).findall(" " + " ".join(t for t in _texts() if t and len(t) < 3000))
    _, _, n_links, a, b, steps = pair.aligned(parts)
    whole = alignment.group_texts(n_links, a, b, steps)
    assert whole == alignment.group_texts(n_links, a, b, steps, 1) == alignment.group_texts(n_links, a, b, steps, 97) and len(whole) == len(parts)
    slow = alignment.Pair(pair.raw)
    slow.fast = None
    assert all((x == y).all() for x, y in zip(pair.aligned(parts), slow.aligned(parts), strict=True))


def test_documents_of_a_large_block_are_counted_once(spark, pair):
    rng = np.random.default_rng(8)
    rows = [(k, " ".join(rng.choice(["alpha", "beta", "gamma", "delta", f"w{k}"], 30))) for k in range(400)]
    got = alignment.token_alignments(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1))
    assert sorted((r["doc_id"], r["n_best"], r["count_sum"]) for r in got.collect()) == sorted((r[0], r[5], r[6]) for r in _report(pair, rows))
