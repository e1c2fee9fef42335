"""Quality rules: distribution divergence from language references, in DataFrame expressions only.

For every text: a histogram of character classes and one of the languages' common words. For every language: the same two
histograms over all its documents. A text is kept when, for some language, both Jensen-Shannon distances are below their
limits; below a minimum number of words a distance says little and is not judged (each histogram has its own guard). The
base rules (see `base_columns`) come first.

The common words are the most frequent words of each language over the whole corpus, by exact counts (ties by the word itself).
They are looked up through a table without collisions, so that a word costs one
hash and one comparison. Work per row is linear but for a sort of its common words, and of its word windows where any window
repeats; nothing is exploded by document, and only counts by language are shuffled.

Null and empty texts have no words and fail the base rules. Rows without a language are judged like all others but add to no
reference; without any reference only the base rules count. Repeated rows are judged each for itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pluvia.llm.common import stored

WHITE = r"[\x20\x09-\x0D]+"
#: Removed from a text one after the other; what each takes is its class. The rest is the last class.
CLASSES = (
    ("lower", r"\p{Ll}+"),
    ("white", WHITE),
    ("letters", r"\p{L}+"),
    ("symbols", r"[#*$%&|<>]+"),
    ("points", r"[.,;:?'\"()-]+"),
    ("digits", r"[0-9]+"),
)


def _words(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WHITE))


def base_columns(docs: DataFrame) -> DataFrame:
    """Adds words, class sizes and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed to (doc_id, lang, text)."""
    d = docs.withColumn("text", F.coalesce("text", F.lit("")))
    d = d.withColumn("words", _words(F.col("text"))).withColumn("n_words", F.size("words").cast("long"))
    rest = "text"
    for name, pattern in CLASSES:
        d = d.withColumn(f"rest_{name}", F.regexp_replace(rest, pattern, ""))
        d = d.withColumn(f"c_{name}", (F.length(rest) - F.length(f"rest_{name}")).cast("long"))
        rest = f"rest_{name}"
    d = d.withColumn("c_other", F.length(rest).cast("long"))
    d = d.withColumn("word_chars", F.length("text") - F.col("c_white")).withColumn("word_chars", F.col("word_chars").cast("long"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    d = d.withColumn("lines", lines).withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"))
    # three-word windows by hash; positions are sorted out only where a window repeats
    window = F.slice(F.transform("words", lambda w, i: F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2))), 1, F.greatest(F.size("words") - 2, F.lit(0)))
    d = d.withColumn("windows", window)
    ranked = F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    d = d.withColumn("ranked", F.when(F.size(F.array_distinct("windows")) < F.size("windows"), ranked))
    twice = F.filter("ranked", lambda x, k: (x["h"] == F.get("ranked", k - 1)["h"]) | (x["h"] == F.get("ranked", k + 1)["h"]))
    d = d.withColumn("at", F.sort_array(F.transform(twice, lambda x: x["i"])))
    covered = F.aggregate(F.transform("at", lambda p, k: F.least(F.coalesce(F.get("at", k + 1) - p, F.lit(3)), F.lit(3))), F.lit(0), lambda a, x: a + x)
    d = d.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
    d = d.withColumn("n_symbols", F.col("c_symbols"))
    return d.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def _common_words(docs: DataFrame, count: int) -> tuple[list[str], int]:
    """The most frequent words of each language, as a table without collisions, and its size; empty places are ''."""
    each = docs.where("lang is not null and text is not null").select("lang", F.explode(_words(F.col("text"))).alias("w")).groupBy("lang", "w").agg(F.count("*").alias("m"))
    # Spark limits the rows of each language before it shuffles them for the ranking
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("m"), "w"))
    found = each.withColumn("rank", rank).where(F.col("rank") <= count).select("w").distinct().select("w", F.xxhash64("w").alias("h")).orderBy("w").collect()
    size = 256
    while len({r["h"] % size for r in found}) < len(found):
        size += 1 if size > 1 << 16 else size
    table = [""] * size
    for r in found:
        table[r["h"] % size] = r["w"]
    return table, size


def _array(values: list, kind: str) -> Column:
    """A constant: values hold no white space, so one split literal is folded into it."""
    return F.split(F.lit(" ".join(map(str, values))), " ", -1).cast(f"array<{kind}>")


def _part(p: Column, q: Column) -> Column:
    """What one bin adds to twice the divergence, in nats."""
    log = lambda x: F.when(x > 0, x * F.ln(2 * x / (p + q))).otherwise(F.lit(0.0))
    return log(p) + log(q)


def _distance(twice: Column) -> Column:
    return F.sqrt(F.greatest(twice / 2, F.lit(0.0)) / 0.6931471805599453)


def _pairs(reference: Column) -> Column:
    """A text's share and the reference's share of every common word of the text."""
    return F.transform("hist", lambda x: F.struct((x["m"] / F.greatest("n_words", F.lit(1))).alias("p"), F.get(reference, x["c"]).alias("q")))


def divergence_rules(docs: DataFrame, common: int = 48, char_limit: float = 0.26, word_limit: float = 0.25, char_guard: int = 50, word_guard: int = 50) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, char_distance, word_distance, nearest)."""
    docs = docs.select("doc_id", "lang", "text")
    table, size = _common_words(docs, common)
    words = _array(table, "string")
    d = base_columns(docs)
    code = F.transform("words", lambda w: F.pmod(F.xxhash64(w), F.lit(size)).cast("int"))
    d = d.withColumn("codes", F.sort_array(F.filter(code, lambda c, i: F.get(words, c) == F.get("words", i))))
    d = d.withColumn("ends", F.filter(F.sequence(F.lit(0), F.size("codes")), lambda i: (i < F.size("codes")) & ~F.get("codes", i).eqNullSafe(F.get("codes", i + 1))))
    classes = [c for c, _ in CLASSES] + ["other"]
    hist = F.transform("ends", lambda e, j: F.struct(F.get("codes", e).alias("c"), (e - F.coalesce(F.get("ends", j - 1), F.lit(-1))).cast("long").alias("m")))
    kept = stored(d.select("doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.array(*(f"c_{c}" for c in classes)).alias("classes"), hist.alias("hist")), "rules")

    known = kept.where("lang is not null")
    chars = known.groupBy("lang").agg(F.sum("n_words").alias("n"), *(F.sum(F.col("classes")[i]).alias(f"c{i}") for i in range(len(classes)))).collect()
    counts: dict[str, dict[int, int]] = {}
    for r in known.select("lang", F.explode("hist").alias("x")).groupBy("lang", "x.c").agg(F.sum("x.m").alias("m")).collect():
        counts.setdefault(r["lang"], {})[r["c"]] = r["m"]
    p = F.transform("classes", lambda c: c / F.greatest(F.aggregate("classes", F.lit(0).cast("long"), lambda a, x: a + x), F.lit(1)))
    judged = kept.withColumn("p", p).withColumn("rest", 1 - F.aggregate(F.transform("hist", lambda x: x["m"]), F.lit(0).cast("long"), lambda a, x: a + x) / F.greatest("n_words", F.lit(1)))
    # a sample of n from b bins is about sqrt(b / (8 n ln 2)) away from its own distribution; that much is allowed on top
    noisy = lambda limit, bins: F.sqrt(F.lit(limit**2) + bins / (8 * 0.6931471805599453 * F.greatest("n_words", F.lit(1))))
    each = []
    for r in sorted(chars, key=lambda r: r["lang"]):
        total, n = max(1, sum(r[f"c{i}"] for i in range(len(classes)))), max(1, r["n"])
        q = [r[f"c{i}"] / total for i in range(len(classes))]
        by_char = sum((_part(F.col("p")[i], F.lit(q[i])) for i in range(len(classes))), F.lit(0.0))
        share = [counts.get(r["lang"], {}).get(k, 0) / n for k in range(size)]
        ref = _array(share, "double")
        seen = _pairs(ref)
        both = F.aggregate(seen, F.struct(F.lit(0.0).alias("d"), F.lit(0.0).alias("q")), lambda a, x: F.struct((a["d"] + _part(x["p"], x["q"])).alias("d"), (a["q"] + x["q"]).alias("q")))
        name = f"l{len(each)}"
        judged = judged.withColumn(f"{name}_w", both)
        # words of the reference that the text lacks are apart altogether
        by_word = F.col(f"{name}_w.d") + 0.6931471805599453 * F.greatest(sum(share) - F.col(f"{name}_w.q"), F.lit(0.0)) + _part(F.greatest("rest", F.lit(0.0)), F.lit(1 - sum(share)))
        c = F.when(F.col("n_words") >= char_guard, _distance(by_char)).otherwise(0.0)
        w = F.when(F.col("n_words") >= word_guard, _distance(by_word)).otherwise(0.0)
        each.append(F.struct(F.greatest(c / noisy(char_limit, len(classes)), w / noisy(word_limit, common + 1)).alias("worst"), c.alias("c"), w.alias("w"), F.lit(r["lang"]).alias("lang")))
    best = F.array_min(F.array(*each)) if each else F.struct(F.lit(0.0).alias("worst"), F.lit(0.0).alias("c"), F.lit(0.0).alias("w"), F.lit(None).cast("string").alias("lang"))
    judged = judged.withColumn("best", best)
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.col("best.worst") <= 1)).alias("kept"),
        F.col("best.c").alias("char_distance"), F.col("best.w").alias("word_distance"), F.col("best.lang").alias("nearest"),
    )


def rules_report(docs: DataFrame) -> DataFrame:
    """:func:`divergence_rules` with rounded distances."""
    return divergence_rules(docs).withColumn("char_distance", F.round("char_distance", 6)).withColumn("word_distance", F.round("word_distance", 6))


def _oracle(common: int = 48, char_limit: float = 0.26, word_limit: float = 0.25, guard: int = 50) -> str:
    part = lambda p, q: f"(CASE WHEN {p} > 0 THEN {p} * ln(2 * {p} / ({p} + {q})) ELSE 0 END + CASE WHEN {q} > 0 THEN {q} * ln(2 * {q} / ({p} + {q})) ELSE 0 END)"
    names = [c for c, _ in CLASSES] + ["other"]
    steps, rest = [], "t"
    for name, pattern in CLASSES:
        steps.append(f"r_{name} AS (SELECT *, regexp_replace({rest}, '{pattern.replace(chr(39), chr(39) * 2)}', '', 'g') AS x_{name} FROM {steps[-1].split()[0] if steps else 'w'})")
        rest = f"x_{name}"
    before = ["t"] + [f"x_{c}" for c, _ in CLASSES]
    sizes = ", ".join(f"length({a}) - length({b}) AS c_{c}" for c, a, b in zip(names, before, before[1:], strict=False)) + f", length({rest}) AS c_other"
    total = " + ".join(f"c_{c}" for c in names)
    shares = ", ".join(f"c_{c} / greatest(1, {total}) AS p_{c}" for c in names)
    sums = ", ".join(f"sum(c_{c}) AS s_{c}" for c in names)
    far = f"greatest(1, {' + '.join(f's_{c}' for c in names)})"
    by_char = " + ".join(part(f"p_{c}", f"(s_{c} / {far})") for c in names)
    dist = lambda x: f"sqrt(greatest(({x}) / 2, 0) / ln(2))"
    noisy = lambda limit, bins: f"sqrt({limit * limit!r} + {bins} / (8 * ln(2) * greatest(n_words, 1)))"
    rest_word = part("greatest(1 - coalesce(seen_m, 0) / greatest(n_words, 1), 0)", "(1 - all_q)")
    return rf"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, CAST(len(ws) AS BIGINT) AS n_words FROM d),
{", ".join(steps)},
b AS (SELECT doc_id, lang, t, ws, n_words, {sizes} FROM r_digits),
f AS (SELECT *, {shares} FROM b),
e AS (SELECT doc_id, lang, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM w),
win AS (SELECT doc_id, i, ws[i : i + 2] AS g FROM w, unnest(range(1, n_words - 1)) u(i)),
twice AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, range(0, 3) o(k) GROUP BY doc_id),
top AS (SELECT lang, w FROM (SELECT lang, w, count(*) AS m FROM e WHERE lang IS NOT NULL GROUP BY lang, w) QUALIFY row_number() OVER (PARTITION BY lang ORDER BY m DESC, w) <= {common}),
h AS (SELECT doc_id, lang, w, count(*) AS m FROM e WHERE w IN (SELECT w FROM top) GROUP BY ALL),
l AS (SELECT lang, greatest(sum(n_words), 1) AS n, {sums} FROM b WHERE lang IS NOT NULL GROUP BY lang),
q AS (SELECT h.lang, w, sum(m) / any_value(l.n) AS q FROM h JOIN l ON h.lang = l.lang GROUP BY h.lang, w),
a AS (SELECT l.*, coalesce((SELECT sum(q) FROM q WHERE q.lang = l.lang), 0) AS all_q FROM l),
s AS (SELECT f.doc_id, a.lang AS of, sum({part("(h.m / f.n_words)", "coalesce(q.q, 0)")}) AS part, sum(coalesce(q.q, 0)) AS seen_q, sum(h.m) AS seen_m
      FROM f JOIN h ON h.doc_id = f.doc_id CROSS JOIN a LEFT JOIN q ON q.lang = a.lang AND q.w = h.w GROUP BY f.doc_id, a.lang),
j AS (SELECT f.doc_id, f.n_words, a.lang AS of, CASE WHEN f.n_words >= {guard} THEN {dist(by_char)} ELSE 0 END AS c,
             CASE WHEN f.n_words >= {guard} THEN {dist(f"coalesce(part, 0) + ln(2) * greatest(all_q - coalesce(seen_q, 0), 0) + {rest_word}")} ELSE 0 END AS v
      FROM f CROSS JOIN a LEFT JOIN s ON s.doc_id = f.doc_id AND s.of = a.lang),
k AS (SELECT *, greatest(c / {noisy(char_limit, len(names))}, v / {noisy(word_limit, common + 1)}) AS worst FROM j QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY worst, c, v, of) = 1)
SELECT f.doc_id, f.n_words, CAST(length(t) - c_white AS BIGINT) AS word_chars, c_symbols AS n_symbols,
       CAST(len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS BIGINT) AS n_dup_lines,
       CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, f.n_words < 50 OR 100 * coalesce(rep.n, 0) > 50 * f.n_words AS base_failed,
       NOT (f.n_words < 50 OR 100 * coalesce(rep.n, 0) > 50 * f.n_words) AND coalesce(k.worst, 0) <= 1 AS kept,
       round(coalesce(k.c, 0), 6) AS char_distance, round(coalesce(k.v, 0), 6) AS word_distance, k.of AS nearest
FROM f LEFT JOIN k ON k.doc_id = f.doc_id LEFT JOIN rep ON rep.doc_id = f.doc_id
"""


ORACLE = _oracle()
