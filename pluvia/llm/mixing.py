"""Mixing sources to target weights by Poisson replication.

Every source has a mean repetition rate: its target share of the mixture's size over its own size. Every document draws its
count from the Poisson distribution with that mean, by inverting the distribution at a number hashed from seed and id, and is
repeated so often; a global shuffle by hashed keys puts the copies in random order. Draws depend on nothing but seed, id and
rate: partitions, retries and lost executors change nothing.

Sizes are characters of the whole texts (null: 0). A null source is a source of its own. Repeated rows of one id draw the same
count; a row without an id draws by its text. Sources without characters get rate 1. Rates above ``MAX_RATE`` raise an error:
exp(-rate) would leave the range of doubles. Columns of the input keep their names; a column that is added gets underscores
behind its name where the input has it already.

Rates are one row for each source. Up to ``MOST_SOURCES`` of them (counted first; at most 13 MB) are broadcast, more are joined
with every source spread over several tasks. Texts are shuffled once, by hashed keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pluvia.llm.common import SALTS, free, stored

MAX_RATE = 500.0
#: A rate with its distribution function takes at most 800 numbers.
MOST_SOURCES = 2000


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """What a row draws by: its id; without one its text."""
    return F.coalesce(F.col(doc_id).cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))))


def uniform(seed: str, *key: Column) -> Column:
    """A number in (0, 1) from 52 bits of the MD5 of seed and key; the same in any SQL engine."""
    text = F.concat_ws(":", F.lit(seed), *(k.cast("string") for k in key))
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def source_rates(docs: DataFrame, alpha: float = 0.7, epochs: float = 1.0, weights: dict[str, float] | None = None) -> DataFrame:
    """(source, size, rate, cdf): targets are ``weights``, or proportional to size ** ``alpha``; the whole is ``epochs`` times the input."""
    sizes = docs.groupBy("source").agg(F.sum(F.coalesce(F.length("text"), F.lit(0))).cast("double").alias("size"))
    if weights is None:
        target = F.when(F.col("size") > 0, F.pow("size", F.lit(alpha))).otherwise(0.0)
    else:
        target = F.lit(0.0)
        for name, w in weights.items():
            target = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(w))).otherwise(target)
    sizes = sizes.withColumn("target", target)
    total = sizes.agg(F.sum("target").alias("all_target"), F.sum("size").alias("all_size"))  # one row
    # one row of totals is broadcast: a lookup of two numbers
    sizes = sizes.join(F.broadcast(total), F.lit(True), "left")
    rate = F.when((F.col("size") > 0) & (F.col("all_target") > 0), epochs * F.col("all_size") * F.col("target") / F.col("all_target") / F.col("size")).otherwise(1.0)
    rate = F.when(rate > MAX_RATE, F.raise_error(F.lit(f"a repetition rate is above {MAX_RATE}")).cast("double")).otherwise(rate)
    sizes = sizes.select("source", "size", rate.alias("rate"))
    # the distribution function, far into the tail
    last = F.ceil(F.col("rate") + 12 * F.sqrt("rate") + 20).cast("int")
    start = F.struct(F.exp(-F.col("rate")).alias("p"), F.array(F.exp(-F.col("rate"))).alias("cdf"))
    step = lambda a, k: F.struct((a["p"] * F.col("rate") / k).alias("p"), F.concat(a["cdf"], F.array(F.element_at(a["cdf"], -1) + a["p"] * F.col("rate") / k)).alias("cdf"))
    return sizes.withColumn("cdf", F.aggregate(F.sequence(F.lit(1), last), start, step)["cdf"])


def replicated(docs: DataFrame, seed: str = "mix-1", most_broadcast: int = MOST_SOURCES, **options) -> DataFrame:
    """``docs`` with rate, copy (from 0) and shuffle_key; a document that draws 0 has no row. In global random order."""
    own = {c: free(c, docs.columns) for c in ("of", "rate", "cdf", "salt", "key", "n", "copy", "shuffle_key", "slice")}
    of, rate, cdf, salt, key, n, copy, order, part = own.values()
    rates = stored(source_rates(docs, **options), "mix-rates").select(F.col("source").alias(of), F.col("rate").alias(rate), F.col("cdf").alias(cdf))
    d = docs.withColumn(key, row_key())
    if rates.count() <= most_broadcast:
        d = d.join(F.broadcast(rates), F.col("source").eqNullSafe(F.col(of)))
    else:
        spread = rates.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        d = d.withColumn(salt + "_own", F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int"))
        d = d.join(spread, F.col("source").eqNullSafe(F.col(of)) & (F.col(salt + "_own") == F.col(salt))).drop(salt, salt + "_own")
    u = uniform(seed, F.col(key))
    d = d.withColumn(n, F.aggregate(cdf, F.struct(u.alias("u"), F.lit(0).alias("n")), lambda a, c: F.struct(a["u"].alias("u"), (a["n"] + (c <= a["u"]).cast("int")).alias("n")), lambda a: a["n"]))
    d = d.where(F.col(n) > 0).withColumn(copy, F.explode(F.sequence(F.lit(0), F.col(n) - 1))).drop(of, cdf, n)
    d = d.withColumn(order, uniform(seed + "-order", F.col(key), F.col(copy))).drop(key)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # equal slices of the unit interval need no sampling pass to be balanced
    return d.withColumn(part, F.floor(F.col(order) * parts)).repartition(parts, part).sortWithinPartitions(order, "doc_id", copy).drop(part)


ORACLE = """
WITH b AS (SELECT doc_id, source, length(coalesce(text, '')) AS n, coalesce(CAST(doc_id AS VARCHAR), 'text:' || md5(coalesce(text, ''))) AS key FROM documents),
d AS (SELECT *, (CAST('0x' || substr(md5('mix-1:' || key), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0 AS u FROM b),
s AS (SELECT source, CAST(sum(n) AS DOUBLE) AS size, pow(CAST(sum(n) AS DOUBLE), 0.7) AS target FROM d GROUP BY source),
r AS (SELECT source, sum(size) OVER () * target / sum(target) OVER () / size AS rate FROM s),
k AS (SELECT source, rate, k, sum(exp(-rate + k * ln(rate) - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS cdf FROM r, range(0, 80) t(k)),
c AS (SELECT d.doc_id, d.source, d.key, k.rate, (count(*) FILTER (WHERE k.cdf <= d.u)) // count(*) FILTER (WHERE k.k = 0) AS n, count(*) FILTER (WHERE k.k = 0) AS m
      FROM d JOIN k ON d.source IS NOT DISTINCT FROM k.source GROUP BY d.doc_id, d.source, d.key, k.rate)
SELECT doc_id, source, CAST(x AS INTEGER) AS copy, round(rate, 6) AS rate,
       CAST('0x' || substr(md5('mix-1-order:' || key || ':' || x), 1, 13) AS BIGINT) AS shuffle_bits
FROM c, unnest(range(0, n)) u(x), unnest(range(0, m))
"""


def mixture_report(docs: DataFrame) -> DataFrame:
    """(doc_id, source, copy, rate, shuffle_bits) of the mixture; texts stay outside the shuffle."""
    d = replicated(docs.select("doc_id", "source", "text"), "mix-1")
    return d.select("doc_id", "source", "copy", F.round("rate", 6).alias("rate"), F.floor(F.col("shuffle_key") * float(1 << 52)).cast("long").alias("shuffle_bits"))
