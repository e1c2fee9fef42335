"""The engine's tables made from the driver's star schema, once as DataFrames and once as SQL for the oracle.

grid: one cell for each part, 40 columns wide, a valley with noise; every 89th cell is inactive. rain: event types are sources,
days are slices. stations: users of events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pluvia.functions import scalars as S

NCOL = 40
DX = DY = 0.01
X0, Y0 = 10.0, 45.0
STEP_S = 21600.0


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    p = read(spark, sf_dir, "part").select("p_partkey", "p_size")
    g = p.select(
        k.alias("cell_id"), F.floor(k / NCOL).cast("int").alias("r"), (k % NCOL).cast("int").alias("c"),
        F.when(k % 89 != 88, (F.floor(k / NCOL) * 16 + F.abs(k % NCOL - 20) * 10 + ((k * 37) % 11) * 3).cast("double")).alias("dem"),
        (40 + F.col("p_size")).cast("double").alias("cn"), (k % 7 == 0).alias("channel"),
    )
    g = g.withColumn("active", F.col("dem").isNotNull()).withColumn("x", X0 + F.col("c") * DX).withColumn("y", Y0 - F.col("r") * DY)
    return g.withColumn("area_m2", S.sphere_cell_area(F.col("y"), DX, DY))


def rows(spark: SparkSession, sf_dir: str) -> int:
    """Rows of the grid."""
    return grid(spark, sf_dir).agg(F.max("r") + 1).first()[0]


GRID = """grid AS (SELECT p_partkey AS cell_id, CAST(p_partkey // 40 AS INTEGER) AS r, CAST(p_partkey % 40 AS INTEGER) AS c,
  CASE WHEN p_partkey % 89 <> 88 THEN CAST((p_partkey // 40) * 16 + abs(p_partkey % 40 - 20) * 10 + ((p_partkey * 37) % 11) * 3 AS DOUBLE) END AS dem,
  CAST(40 + p_size AS DOUBLE) AS cn, p_partkey % 7 = 0 AS channel, p_partkey % 89 <> 88 AS active,
  10.0::DOUBLE + (p_partkey % 40) * 0.01::DOUBLE AS x, 45.0::DOUBLE - (p_partkey // 40) * 0.01::DOUBLE AS y,
  abs(6371000.0::DOUBLE * 6371000.0::DOUBLE * radians(0.01::DOUBLE) * (sin(radians(45.0::DOUBLE - (p_partkey // 40) * 0.01::DOUBLE)) - sin(radians(45.0::DOUBLE - (p_partkey // 40) * 0.01::DOUBLE - 0.01::DOUBLE)))) AS area_m2
  FROM part)"""

D8 = """nb AS (SELECT * FROM (VALUES (0,1,0,1),(1,2,1,1),(2,4,1,0),(3,8,1,-1),(4,16,0,-1),(5,32,-1,-1),(6,64,-1,0),(7,128,-1,1)) t(k, code, dr, dc)),
slopes AS (SELECT g.cell_id, nb.k, nb.code, (g.dem - n.dem) / CASE WHEN nb.dr <> 0 AND nb.dc <> 0 THEN sqrt(0.0002::DOUBLE) ELSE 0.01::DOUBLE END AS s
  FROM grid g CROSS JOIN nb JOIN grid n ON n.r = g.r + nb.dr AND n.c = g.c + nb.dc WHERE g.dem IS NOT NULL AND n.dem IS NOT NULL),
best AS (SELECT cell_id, code FROM slopes WHERE s > 0 QUALIFY row_number() OVER (PARTITION BY cell_id ORDER BY s DESC, k) = 1),
d8 AS (SELECT g.cell_id, coalesce(b.code, 0) AS d8 FROM grid g LEFT JOIN best b USING (cell_id) WHERE g.dem IS NOT NULL),
flow AS (SELECT g.cell_id, t.cell_id AS ds_id, coalesce(d.d8, 0) AS d8 FROM grid g LEFT JOIN d8 d USING (cell_id) LEFT JOIN nb ON nb.code = d.d8
  LEFT JOIN grid t ON t.r = g.r + nb.dr AND t.c = g.c + nb.dc)"""


def directed(g: DataFrame) -> DataFrame:
    """The grid with d8, 0 for inactive cells."""
    from pluvia.operators import grid as G

    return g.join(G.d8_from_dem(g, DX, DY), "cell_id", "left").withColumn("d8", F.coalesce("d8", F.lit(0)))


def slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, k, t, base): mean value of each event type and day."""
    e = read(spark, sf_dir, "events").select("event_type", F.to_date("ts").alias("day"), "value")
    e = e.groupBy(F.col("event_type").alias("source"), "day").agg((F.avg("value") / 20).alias("base"))
    return e.select("source", F.day("day").alias("k"), F.to_timestamp("day").alias("t"), "base")


SLICES = """slices AS (SELECT event_type AS source, CAST(day(ts) AS INTEGER) AS k, CAST(CAST(ts AS DATE) AS TIMESTAMP) AS t, avg(value) / 20 AS base
  FROM events GROUP BY ALL)"""


def n_steps(spark: SparkSession, sf_dir: str) -> int:
    """Steps of six hours from the first to the last day of events."""
    return _span(spark, sf_dir)[1]


def _span(spark: SparkSession, sf_dir: str) -> tuple[int, int]:
    """(seconds of the first day's beginning, steps)."""
    day = F.unix_seconds(F.to_timestamp(F.to_date("ts")))
    first, last = read(spark, sf_dir, "events").agg(F.min(day), F.max(day)).first()
    return (0, 0) if first is None else (first, (last - first) // 21600 + 4)


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(step, t): every six hours of all days of events."""
    first, n = _span(spark, sf_dir)
    return spark.range(n).select(F.col("id").cast("int").alias("step"), F.timestamp_seconds(F.lit(first) + F.col("id") * 21600).alias("t"))


STEPS = """span AS (SELECT CAST(min(CAST(ts AS DATE)) AS TIMESTAMP) AS t0, CAST(4 * (date_diff('day', min(CAST(ts AS DATE)), max(CAST(ts AS DATE))) + 1) AS INTEGER) AS n FROM events),
steps AS (SELECT CAST(i AS INTEGER) AS step, t0 + INTERVAL 6 HOUR * i AS t FROM span, unnest(range(0, n)) u(i))"""

WEIGHTS = {"click": 0.5, "view": 0.3, "purchase": 0.2}


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(record, ts, station, lon, lat, rate): users of events as stations; 0 is no rate."""
    e = read(spark, sf_dir, "events")
    u = F.col("user_id")
    return e.select(F.col("event_id").alias("record"), F.col("ts").cast("timestamp").alias("ts"), u.alias("station"), (10.0 + (u % 40) * 0.01).alias("lon"), (45.0 - (u % 37) * 0.01).alias("lat"), F.when(F.col("event_id") % 17 != 0, F.col("value")).alias("rate"))
