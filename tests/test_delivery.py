"""Delivery: failures are repeated, what is sent is not, claims hold and run out, alerts are remembered on success only."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from pluvia.operators import alerts as A
from pluvia.streaming import delivery as O


def post(folder):
    """A sender that writes (message, key) to a folder and fails where ``broken`` lies there."""
    place = str(folder)

    def send(message, key):
        import json
        import os
        import uuid

        if os.path.exists(f"{place}/broken"):
            raise OSError("no line")
        with open(f"{place}/{uuid.uuid4().hex}.json", "w") as f:
            json.dump([message, key], f)

    return send


def _got(folder):
    return sorted(tuple(json.loads(p.read_text())) for p in folder.glob("*.json"))


@pytest.fixture
def places(spark, tmp_path):
    for name in ("rest", "email"):
        (tmp_path / name).mkdir()
    rows = [("a", "rest", "A"), ("a", "email", "A"), ("b", "rest", "B"), ("b", "sms", "B"), ("a", "rest", "A")]
    spark.createDataFrame(rows, O.OUTBOX).write.parquet(str(tmp_path / "outbox"))
    return tmp_path


def test_failures_are_sent_again_and_successes_are_not(spark, places):
    senders = {c: post(places / c) for c in ("rest", "email")}
    run = lambda: {(r["alert_id"], r["channel"]): r["status"] for r in O.deliver(spark, str(places / "outbox"), str(places / "log"), senders, str(places / "sent")).collect()}
    (places / "email" / "broken").touch()
    first = run()
    assert first == {("a", "rest"): "sent", ("a", "email"): "failed: no line", ("b", "rest"): "sent"}
    assert A.read_sent(spark, str(places / "sent")).count() == 0  # a waits for its mail, b for a channel without a sender
    assert run() == {("a", "email"): "failed: no line"}
    (places / "email" / "broken").unlink()
    assert run() == {("a", "email"): "sent"} and run() == {}
    assert [m for m, _ in _got(places / "rest")] == ["A", "B"] and [m for m, _ in _got(places / "email")] == ["A"]
    assert [r["alert_id"] for r in A.read_sent(spark, str(places / "sent")).collect()] == ["a"]
    assert len({k for c in ("rest", "email") for _, k in _got(places / c)}) == 3
    state = {(r["alert_id"], r["channel"]): (r["attempts"], r["sent"]) for r in O.status(spark, str(places / "outbox"), str(places / "log")).collect()}
    assert state == {("a", "rest"): (1, True), ("a", "email"): (3, True), ("b", "rest"): (1, True), ("b", "sms"): (0, False)}


def test_attempts_end(spark, places):
    (places / "rest" / "broken").touch()
    senders = {"rest": post(places / "rest")}
    for n in (2, 2, 0):
        assert O.deliver(spark, str(places / "outbox"), str(places / "log"), senders, most_attempts=2).count() == n


def test_claims_of_another_run_hold_until_they_run_out(spark, places):
    senders = {"rest": post(places / "rest")}
    other = spark.createDataFrame([("a", "rest"), ("b", "rest")], "alert_id string, channel string").select(O.key().alias("key"), F.lit("other").alias("run"))
    early = F.timestamp_seconds(F.unix_seconds(F.current_timestamp()) - F.when(F.col("key") == F.sha2(F.lit("a|rest"), 256), 60).otherwise(5000))
    other.withColumn("at", early).write.parquet(str(places / "log" / "claims" / "part=other"))
    done = O.deliver(spark, str(places / "outbox"), str(places / "log"), senders, lease_s=900).collect()
    assert [(r["alert_id"], r["status"]) for r in done] == [("b", "sent")]


def test_nothing_to_send(spark, tmp_path):
    assert O.deliver(spark, str(tmp_path / "none"), str(tmp_path / "log"), {"rest": print}, str(tmp_path / "sent")).count() == 0
