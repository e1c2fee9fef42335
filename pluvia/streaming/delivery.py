"""Delivery of alerts from an outbox: claimed, sent, acknowledged; what fails is sent again, what is sent is not.

The outbox has rows (alert_id, channel, message). A delivery's key is made of alert and channel, so it is the same in every attempt, and a
sender gets it beside the message: a receiver that knows the key can drop what reaches it twice (a lost executor's task is run
again). Below ``log`` lie ``claims`` and ``acks``, one part for each run; nothing is changed in place, so a run that dies leaves a claim that
runs out after ``lease_s`` and no acknowledgement. An alert is remembered as sent when all its deliveries are acknowledged.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from pluvia.operators import alerts as A
from pluvia.plans.storage import cut

OUTBOX = "alert_id string, channel string, message string"
CLAIMS, ACKS = "key string, run string, at timestamp", "key string, alert_id string, channel string, status string, at timestamp"


def key() -> F.Column:
    return F.sha2(F.concat_ws("|", "alert_id", "channel"), 256)


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What is there; empty without a table."""
    none = spark.createDataFrame([], schema)
    try:
        return spark.read.schema(schema).parquet(path).select(*none.columns)
    except AnalysisException:
        return none


def queued(spark: SparkSession, outbox: str) -> DataFrame:
    """(key, alert_id, channel, message): one row a delivery, however often it was put into the outbox."""
    return _table(spark, outbox, OUTBOX).withColumn("key", key()).groupBy("key", "alert_id", "channel").agg(F.min("message").alias("message"))


def status(spark: SparkSession, outbox: str, log: str) -> DataFrame:
    """(key, alert_id, channel, message, attempts, sent) of every delivery."""
    acks = _table(spark, f"{log}/acks", ACKS).groupBy("key").agg(F.count("*").alias("attempts"), F.max(F.col("status") == "sent").alias("sent"))
    return queued(spark, outbox).join(acks, "key", "left").fillna(0, ["attempts"]).fillna(False, ["sent"])


def deliver(spark: SparkSession, outbox: str, log: str, senders: dict[str, Callable[[str, str], None]], sent: str | None = None, most_attempts: int = 8, lease_s: int = 900) -> DataFrame:
    """(key, alert_id, channel, status) of this run's attempts. ``senders``: by channel, a function of message and key that raises on failure.

    Deliveries whose channel has no sender stay where they are; after ``most_attempts`` failures no more is tried. ``sent``: the table in which
    alerts are remembered.
    """
    run = uuid.uuid4().hex
    open_ = cut(status(spark, outbox, log).where(~F.col("sent") & (F.col("attempts") < most_attempts) & F.col("channel").isin(list(senders))))
    out = spark.createDataFrame([], "key string, alert_id string, channel string, status string")
    if not open_.isEmpty():
        open_.select("key", F.lit(run).alias("run"), F.current_timestamp().alias("at")).write.parquet(f"{log}/claims/part={run}")
        live = _table(spark, f"{log}/claims", CLAIMS).where(F.col("at") > F.timestamp_seconds(F.unix_seconds(F.current_timestamp()) - lease_s))
        # a claim ends with its attempt: only those count that are younger than the last acknowledgement
        last = _table(spark, f"{log}/acks", ACKS).groupBy("key").agg(F.max("at").alias("last"))
        live = live.join(last, "key", "left").where("last is null or at > last")
        mine = live.groupBy("key").agg(F.min_by("run", F.struct("at", "run")).alias("run")).where(F.col("run") == run).select("key")

        def attempt(batches):
            for pdf in batches:
                found = []
                for channel, message, k in zip(pdf["channel"], pdf["message"], pdf["key"], strict=True):
                    try:
                        senders[channel](message, k)
                        found.append("sent")
                    except Exception as e:  # a sender's own failure, of whatever kind
                        found.append(f"failed: {e}")
                yield pd.DataFrame({"key": pdf["key"], "alert_id": pdf["alert_id"], "channel": pdf["channel"], "status": found})

        claimed = open_.join(mine, "key").select("key", "alert_id", "channel", "message")
        done = claimed.mapInPandas(attempt, out.schema).withColumn("at", F.current_timestamp())
        done.write.parquet(f"{log}/acks/part={run}")
        out = spark.read.schema(ACKS).parquet(f"{log}/acks/part={run}").select(*out.columns)
    if sent:
        whole = status(spark, outbox, log).groupBy("alert_id").agg(F.min("sent").alias("all")).where("all").select("alert_id", F.current_timestamp().alias("ts"))
        A.remember(cut(whole), sent)
    return out
