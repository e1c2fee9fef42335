"""Alert operators: rules over feature properties, ids, memory of what was sent, routing. Sending is a sink of its own."""

from __future__ import annotations

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Operators in the order in which an expression is searched for them.
OPERATORS = (" in ", ">=", "<=", "!=", "==", ">", "<")


def parse_rule(text: str) -> tuple[str, str, str]:
    """(property, operator, value) of an expression such as ``depth >= 0.5`` or ``class in R3,R4``."""
    for op in OPERATORS:
        left, found, right = text.partition(op)
        if found:
            return left.strip(), op.strip(), right.strip()
    raise ValueError(f"no operator in rule {text!r}")


def compared(actual: Column, op: Column, value: Column) -> Column:
    """Numeric comparison where both are numbers, else false; ``in`` is membership of a comma list, ``contains`` a substring."""
    a, v = actual.try_cast("double"), value.try_cast("double")
    number = F.when(op == ">", a > v).when(op == ">=", a >= v).when(op == "<", a < v).when(op == "<=", a <= v).when(op == "==", a == v).when(op == "!=", a != v)
    listed = F.array_contains(F.transform(F.split(value, ","), lambda s: F.trim(s)), actual)
    return F.coalesce(F.when(op == "in", listed).when(op == "contains", F.contains(actual, value)).otherwise(number), F.lit(False))


def matches(features: DataFrame, rules: DataFrame, max_rules: int = 10_000) -> DataFrame:
    """Features (feature_id, properties map) that satisfy rules (rule, property, op, value, ...), one row for each match.

    A rule looks at one property, so properties are exploded and joined to rules by name: no cross join. Rules are
    configuration; they are broadcast after a check of their number.
    """
    if rules.count() > max_rules:
        raise ValueError("too many rules")
    f = features.select("feature_id", F.explode("properties").alias("property", "actual"))
    return f.join(F.broadcast(rules), "property").where(compared(F.col("actual"), F.col("op"), F.col("value")))


@F.pandas_udf(StringType())
def six_digits(x: pd.Series) -> pd.Series:
    """Numbers as six significant digits, other texts as they are."""

    def one(v):
        try:
            return format(float(v), ".6g")
        except (TypeError, ValueError):
            return v

    return x.map(one)


def alert_id(feature: Column, rule: Column, prop: Column, op: Column, value: Column, actual: Column) -> Column:
    return F.sha2(F.concat_ws("|", feature, rule, prop, op, value, actual), 256)


def read_sent(spark: SparkSession, path: str) -> DataFrame:
    """(alert_id, ts) of what has been sent; empty where there is no such table or it cannot be read."""
    none = spark.createDataFrame([], "alert_id string, ts timestamp")
    try:
        sent = spark.read.parquet(path)
        return sent.select("alert_id", "ts") if {"alert_id", "ts"} <= set(sent.columns) else none
    except AnalysisException:  # no table, or no schema to be found in it
        return none


def remember(sent: DataFrame, path: str) -> None:
    """Adds (alert_id, ts) to the table of what has been sent: both are written beside it, then take its place."""
    spark = sent.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    here, there = hadoop(path), hadoop(path.rstrip("/") + ".part")
    fs = here.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(there, True)
    read_sent(spark, path).unionByName(sent.select("alert_id", "ts")).groupBy("alert_id").agg(F.min("ts").alias("ts")).write.parquet(str(there))
    fs.delete(here, True)
    if not fs.rename(there, here):
        raise OSError(f"cannot rename {there} to {here}")


def unsent(alerts: DataFrame, sent: DataFrame) -> DataFrame:
    """Alerts whose id is not in ``sent``, once each."""
    return alerts.join(sent.select("alert_id"), "alert_id", "left_anti").dropDuplicates(["alert_id"])


def routed(alerts: DataFrame, enabled: list[str], contacts: dict[str, list[str]]) -> DataFrame:
    """``alerts`` (channels, properties) with ``routes``: channels that are asked for, enabled and have a contact, and ``missing_route``.

    ``contacts``: for each channel the properties of which all must be filled.
    """
    have = F.array(*(F.when(_all_filled(names), F.lit(c)) for c, names in contacts.items() if c in enabled)) if any(c in enabled for c in contacts) else F.array().cast("array<string>")
    r = alerts.withColumn("routes", F.array_sort(F.array_intersect("channels", F.array_compact(have))))
    return r.withColumn("missing_route", F.size("routes") == 0)


def _all_filled(names: list[str]) -> Column:
    ok = F.lit(True)
    for n in names:
        ok = ok & F.nullif(F.trim(F.try_element_at("properties", F.lit(n))), F.lit("")).isNotNull()
    return ok


def payload(columns: list[str]) -> Column:
    return F.to_json(F.struct(*columns))


def rendered(template: str | None, rule: Column, feature: Column, prop: Column, actual: Column, severity: Column) -> Column:
    """Message text: ``{name}`` fields of the template, else the default sentence."""
    if not template:
        return F.format_string("[%s] %s: %s on %s is %s", severity, rule, prop, feature, actual)
    out = F.lit(template)
    for name, column in (("rule", rule), ("feature", feature), ("property", prop), ("actual", actual), ("severity", severity)):
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(column.cast("string"), F.lit("")))
    return out


def run_summary(alerts: DataFrame, sent: DataFrame | None = None) -> DataFrame:
    """One row of counts: matched, deduplicated (sent before), missing_route, deliverable (a row of (alert, channel) each)."""
    if sent is None:
        a = alerts.withColumn("old", F.lit(False))
    else:
        a = alerts.join(sent.select("alert_id", F.lit(True).alias("old")).distinct(), "alert_id", "left").fillna(False, ["old"])
    n = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0))
    new = ~F.col("old")
    routes = F.coalesce(F.sum(F.when(new, F.size("routes")).otherwise(0)), F.lit(0)).alias("deliveries") if "routes" in alerts.columns else F.lit(0).alias("deliveries")
    return a.agg(F.count("*").alias("matched"), n(F.col("old")).alias("deduplicated"), n(new & F.col("missing_route")).alias("missing_route"), n(new & ~F.col("missing_route")).alias("deliverable"), routes)


def deliveries(alerts: DataFrame) -> DataFrame:
    """(alert_id, channel, message): one row for each route of an alert, for the outbox or a sender of that channel."""
    return alerts.select("alert_id", F.explode("routes").alias("channel"), "message")
