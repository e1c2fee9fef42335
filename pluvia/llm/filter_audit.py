"""Filter interaction audit: what each of five filters removes in each part, in every order in which they can be applied.

Failure conditions over whole texts (null: empty): A under 100 words; B 100 * distinct words < 80 * words; C 100 * characters A-Z
> 10 * code points; D any of ``#$%&*|``; E identical to the text of a row with a smaller id, table-wide.

1. One pass gives each row its flags; E takes the smallest id of each text that comes more than once. Rows are summed up by part and
   flags, at most 32 rows a part, so that what follows does not grow with the rows of a part.
2. CUBE over the five flags and the part: the row of the grouping set (S, part) in which all flags of S are false counts the rows
   that survive the filters S. Sets without such a row have no survivor.
3. Pairs of subsets (S, S with one more filter) give what that filter removes after S: 80 pairs a part. A step of an order is one of
   them, and so are what a filter fails at all (S empty) and fails alone (S all the others). The Shapley count weighs a pair by the
   number of orders that pass through it, |S|! (4 - |S|)!.

Nulls: a null ``lang`` is the part ``''``, as an empty one is; a row without an id is never a copy, and no row is a copy of it. Rows
that share an id and a text are no copies of each other (none is smaller). Ids that occur several times in ``labels`` count as good or
toxic if any of their rows says so; each row of a repeated document is counted. Empty texts fail A alone (and E). Very long texts are
read whole by the same expressions. Empty tables give no part, so no row. Other columns are not read.
"""

from __future__ import annotations

import string
from itertools import permutations
from math import factorial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pluvia.llm.common import looked_up, stored

FILTERS = "ABCDE"
ALL = (1 << len(FILTERS)) - 1
COUNTS = ("n", "good", "toxic")
WHITE = r"[\x20\x09-\x0D]+"

ORACLE = rf"""
with recursive l as (select doc_id, max(coalesce(quality = 1, false)::int) as good, max(coalesce(toxic = 1, false)::int) as toxic from labels group by 1),
t as (select doc_id, coalesce(text, '') as text, coalesce(lang, '') as part, min(doc_id) over (partition by coalesce(text, '')) as least from documents),
w as (select *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as words from t),
f as (select w.doc_id, part, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic,
             (len(words) < 100)::int + 2 * (100 * len(list_distinct(words)) < 80 * len(words))::int
             + 4 * (100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 10 * length(text))::int
             + 8 * regexp_matches(text, '[#$%&*|]')::int + 16 * coalesce(w.doc_id > least, false)::int as mask
      from w left join l on w.doc_id = l.doc_id),
m as (select part, mask, count(*) as n, sum(good) as good, sum(toxic) as toxic from f group by 1, 2),
letters as (select unnest(['A', 'B', 'C', 'D', 'E']) as letter, unnest([1, 2, 4, 8, 16]) as bit),
walk as (select '' as path, 0 as seen, 0 as before, 0 as bit, 0 as step
         union all select path || letter, seen + l.bit, seen, l.bit, step + 1 from walk join letters l on seen & l.bit = 0),
orders as (select path as filter_order from walk where step = 5),
steps as (select filter_order, step, before, bit from orders join walk on step > 0 and starts_with(filter_order, path)),
alone as (select part, bit, sum(case when mask = bit then n else 0 end) as unique_fails from m cross join letters group by 1, 2),
rows_ as (select part, filter_order, step, bit,
                 sum(case when mask & (before + bit) = 0 then n else 0 end) as kept,
                 sum(case when mask & before = 0 and mask & bit > 0 then n else 0 end) as removed,
                 sum(case when mask & before > 0 and mask & bit > 0 then n else 0 end) as redundant,
                 sum(case when mask & before = 0 and mask & bit > 0 then good else 0 end) as good_lost,
                 sum(case when mask & before = 0 and mask & bit > 0 then toxic else 0 end) as toxic_lost
          from m cross join steps group by 1, 2, 3, 4)
select part, filter_order, step::int as step, kept::bigint as kept, removed::bigint as removed, redundant::bigint as redundant,
       unique_fails::bigint as unique_fails, good_lost::bigint as good_lost, toxic_lost::bigint as toxic_lost,
       (sum(removed) over (partition by part, bit))::bigint as shapley
from rows_ join alone using (part, bit)
"""


def failures(docs: DataFrame) -> DataFrame:
    """(doc_id, part, A, B, C, D, E) of every row: does it fail the filter?"""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.filter(F.split("text", WHITE), lambda w: w != "")
    upper = F.length("text") - F.length(F.translate("text", string.ascii_uppercase, ""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.coalesce(F.col("lang"), F.lit("")).alias("part"))
    rows = rows.withColumn("words", words).select(
        "doc_id", "part",
        (F.size("words") < 100).alias("A"),
        (100 * F.size(F.array_distinct("words")) < 80 * F.size("words")).alias("B"),
        (100 * upper.cast("long") > 10 * F.length("text").cast("long")).alias("C"),
        F.col("text").rlike("[#$%&*|]").alias("D"),
        F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"),
    )
    rows = stored(rows, "audit-rows")  # texts are read once, though their digests are grouped and joined back
    first = rows.groupBy("digest").agg(F.count("*").alias("m"), F.min("doc_id").alias("first")).where("m > 1 and first is not null").select("digest", "first")
    # a third of all rows may have one text: its rows are spread over the shares of looked_up
    own = F.xxhash64("doc_id", "part")
    found = looked_up(rows.withColumn("own", own), "digest", "own", first)
    return found.select("doc_id", "part", "A", "B", "C", "D", F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)).alias("E"))


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, A, B, C, D, E, n, good, toxic): rows by part and flags, at most 32 a part."""
    mark = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("long")).alias(c)
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(mark("quality").alias("good"), mark("toxic").alias("toxic"))
    flags = list(FILTERS)
    # documents of one id may be many: they are summed up by id before they meet its labels
    rows = failures(docs).groupBy("doc_id", "part", *flags).agg(F.count("*").alias("n")).join(known, "doc_id", "left")
    kinds = [F.sum("n").alias("n"), *(F.sum(F.coalesce(F.col(c), F.lit(0)) * F.col("n")).alias(c) for c in ("good", "toxic"))]
    return rows.groupBy("part", *flags).agg(*kinds)


def survivors(summed: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic) for all 32 sets of filters: rows of the part that fail none of them."""
    cube = summed.cube(*FILTERS, "part").agg(F.grouping("part").alias("whole"), *(F.grouping(c).alias(f"no_{c}") for c in FILTERS), *(F.sum(c).alias(c) for c in COUNTS))
    selected = [F.when(F.col(f"no_{c}") == 0, F.lit(1 << k)).otherwise(0) for k, c in enumerate(FILTERS)]
    passing = [(F.col(f"no_{c}") == 1) | ~F.col(c) for c in FILTERS]
    mask = sum(selected[1:], selected[0])
    alive = passing[0]
    for p in passing[1:]:
        alive = alive & p
    found = cube.where((F.col("whole") == 0) & alive).select("part", mask.alias("mask"), *COUNTS)
    every = summed.select("part").distinct().withColumn("mask", F.explode(F.sequence(F.lit(0), F.lit(ALL))))
    return every.join(found, ["part", "mask"], "left").na.fill(0, list(COUNTS))


def pairs(alive: DataFrame) -> DataFrame:
    """(part, bit, before, kept, removed, good_lost, toxic_lost): the filter ``bit`` after the filters ``before``."""
    bits = F.array(*(F.lit(1 << k) for k in range(len(FILTERS))))
    left = alive.withColumn("bit", F.explode(F.filter(bits, lambda b: F.col("mask").bitwiseAND(b) == 0)))
    left = left.select("part", "bit", F.col("mask").alias("before"), (F.col("mask") + F.col("bit")).alias("mask"), *(F.col(c).alias(f"{c}_before") for c in COUNTS))
    both = left.join(alive, ["part", "mask"])
    lost = lambda c, name: (F.col(f"{c}_before") - F.col(c)).alias(name)
    return both.select("part", "bit", "before", F.col("n").alias("kept"), lost("n", "removed"), lost("good", "good_lost"), lost("toxic", "toxic_lost"))


def interaction_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley): 600 rows a part."""
    spark = docs.sparkSession
    alive = stored(survivors(stored(cells(docs, labels), "audit-cells")), "audit-survivors")  # 32 rows a part
    step = stored(pairs(alive), "audit-pairs")  # 80 rows a part
    n = len(FILTERS)
    ways = F.element_at(F.array(*(F.lit(factorial(k) * factorial(n - 1 - k)) for k in range(n))), F.bit_count("before") + 1)
    at = lambda mask: F.sum(F.when(F.col("before") == mask, F.col("removed")).otherwise(0))
    by_filter = step.groupBy("part", "bit").agg(at(F.lit(0)).alias("fails"), at(F.lit(ALL) - F.col("bit")).alias("unique_fails"), F.sum(ways * F.col("removed")).alias("shapley"))
    bit = {c: 1 << k for k, c in enumerate(FILTERS)}
    orders = [("".join(p), k + 1, bit[p[k]], sum(bit[c] for c in p[:k])) for p in permutations(FILTERS) for k in range(n)]
    steps = spark.createDataFrame(orders, "filter_order string, step int, bit int, before int")  # 600 rows, whatever the input
    out = step.join(F.broadcast(steps), ["bit", "before"]).join(by_filter, ["part", "bit"])
    long = lambda c: F.col(c).cast("long").alias(c)
    redundant = (F.col("fails") - F.col("removed")).cast("long").alias("redundant")
    return out.select("part", "filter_order", "step", long("kept"), long("removed"), redundant, *map(long, ("unique_fails", "good_lost", "toxic_lost", "shapley")))
