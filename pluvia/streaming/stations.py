"""Streams: station bins with late data dropped behind a watermark, sliding and session windows, alerts sent once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pluvia.functions.scalars import EPOCH_1900_S


def bins_begin(interval_s: int) -> str:
    """Where windows of ``interval_s`` begin, so that they are those of the batch operator: multiples counted from 1900."""
    return f"{-EPOCH_1900_S % interval_s} seconds"


def binned_stream(records: DataFrame, interval_s: int = 900, late: str = "1 hour") -> DataFrame:
    """(start, station, lon, lat, rate, n) of (ts, station, lon, lat, rate): tumbling means; records later than ``late`` drop.

    The same bins as :func:`pluvia.operators.stations.station_bins`, which numbers them from the first.
    """
    r = records.where("rate is not null").withWatermark("ts", late)
    window = F.window("ts", f"{interval_s} seconds", startTime=bins_begin(interval_s))
    a = r.groupBy(window, "station").agg(F.min_by("lon", "ts").alias("lon"), F.min_by("lat", "ts").alias("lat"), F.avg("rate").alias("rate"), F.count("*").alias("n"))
    return a.select(F.col("window.start").alias("start"), "station", "lon", "lat", "rate", "n")


def sliding(records: DataFrame, interval_s: int, slide_s: int, late: str | None = None) -> DataFrame:
    """(start, station, rate, n): means in windows of ``interval_s`` that begin every ``slide_s``; tables and streams alike."""
    r = records.where("rate is not null")
    r = r.withWatermark("ts", late) if late else r
    window = F.window("ts", f"{interval_s} seconds", f"{slide_s} seconds", bins_begin(slide_s))
    return r.groupBy(window, "station").agg(F.avg("rate").alias("rate"), F.count("*").alias("n")).select(F.col("window.start").alias("start"), "station", "rate", "n")


def spells(records: DataFrame, gap_s: int, late: str | None = None) -> DataFrame:
    """(start, last, station, rate, n): a station's spells of rain, that end when it reports none for ``gap_s`` seconds."""
    r = records.where("rate > 0")
    r = r.withWatermark("ts", late) if late else r
    s = r.groupBy(F.session_window("ts", f"{gap_s} seconds"), "station").agg(F.min("ts").alias("start"), F.max("ts").alias("last"), F.avg("rate").alias("rate"), F.count("*").alias("n"))
    return s.select("start", "last", "station", "rate", "n")


def alerts_once(alerts: DataFrame, within: str = "1 day") -> DataFrame:
    """A stream of alerts (alert_id, ts) without those seen before within the watermark."""
    return alerts.withWatermark("ts", within).dropDuplicatesWithinWatermark(["alert_id"])


def outbox(path: str) -> Callable[[DataFrame, int], None]:
    """A sink for ``foreachBatch``: alerts are appended to a table by batch; a repeated batch overwrites itself. No network."""

    def put(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={epoch}")

    return put


def senders(channels: dict[str, Callable[[str], None]], path: str) -> Callable[[DataFrame, int], None]:
    """A sink that hands messages (alert_id, channel, message) to functions by channel and notes what became of each.

    A failure is noted and does not stop the others. Channels without a function are dry runs. Delivery is at least once: the
    table of results below ``path`` is written by batch, and a repeated batch sends again.
    """
    import pandas as pd

    def send(batches):
        for pdf in batches:
            out = []
            for channel, message in zip(pdf["channel"], pdf["message"], strict=True):
                if channel not in channels:
                    out.append("dry run")
                    continue
                try:
                    channels[channel](message)
                    out.append("sent")
                except Exception as e:  # a sender's own failure, of whatever kind
                    out.append(f"failed: {e}")
            yield pd.DataFrame({"alert_id": pdf["alert_id"], "channel": pdf["channel"], "status": out})

    def put(batch: DataFrame, epoch: int) -> None:
        batch.select("alert_id", "channel", "message").mapInPandas(send, "alert_id string, channel string, status string").write.mode("overwrite").parquet(f"{path}/batch={epoch}")

    return put
