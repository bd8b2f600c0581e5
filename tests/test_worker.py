"""Retries with timers, and the ledger in two phases, as streams."""

import os
import time

import pytest
from pyspark.sql import functions as F

from lumenshelf.streaming import worker

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def test_settle(spark):
    log = spark.createDataFrame([(1, 10, True, "x"), (1, 20, False, "y"), (2, 1, False, "a"), (2, 2, False, "b"), (2, 3, False, "c"), (2, 4, True, "d"), (3, 5, False, "e"), (3, 7, False, "f")], "k int, s int, ok boolean, error string")
    log = log.withColumn("at", F.timestamp_seconds("s"))
    got = {r.k: (r.tries, r.status, r.next_at and r.next_at.timestamp(), r.reason) for r in worker.settle(log, "k", "at", "ok", "error").collect()}
    assert got[1] == (1, "done", None, None) and got[2] == (3, "dead", None, "store failed after 3 attempts: c")
    assert got[3][:2] == (2, "waiting") and abs(got[3][2] - 7.2) < 1e-6
    assert worker.settle(log.limit(0), "k", "at", "ok", "error").count() == 0


def test_retry_stream(spark, tmp_path):
    """Keys that fail 0, 1, 2 and 3 times before they are stored; the last one is given up. What came twice is tried once."""
    tried = str(tmp_path / "tried")
    os.makedirs(tried)

    def store(key, value):
        with open(f"{tried}/{key}", "a") as f:
            f.write(f"{time.time()}\n")
        n = len(open(f"{tried}/{key}").readlines())
        if n <= int(value):
            raise OSError(f"down {n}")

    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        rows = [(f"event-{i}", str(i)) for i in range(4)]
        spark.createDataFrame([*rows, rows[1]], "event_id string, value string").coalesce(1).write.json(str(tmp_path / "in"))
        stream = spark.readStream.schema("event_id string, value string").json(str(tmp_path / "in"))
        q = worker.retry_stream(stream, store).writeStream.format("memory").queryName("retried").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="100 milliseconds").start()
        try:
            end = time.time() + 90
            while time.time() < end and q.exception() is None and spark.table("retried").count() < 4:
                time.sleep(0.5)
            assert q.exception() is None
            got = {r.event_id: (r.status, r.tries, r.reason) for r in spark.table("retried").collect()}
        finally:
            q.stop()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    assert got == {"event-0": ("stored", 1, None), "event-1": ("stored", 2, None), "event-2": ("stored", 3, None), "event-3": ("dead", 3, "store failed after 3 attempts: down 3")}
    times = [float(x) for x in open(f"{tried}/event-3")]
    assert len(times) == 3 and times[1] - times[0] >= 0.1 and times[2] - times[1] >= 0.2


def test_stream_killed_between_the_phases(spark, tmp_path):
    """The run ends after the second batch was decided and before it was completed. The next one takes it up as decided."""
    for n, rows in enumerate([[("a", 1.0), ("b", 2.0), ("a", 1.0)], [("b", 2.0), ("c", 3.0), ("d", 4.0)], [("d", 4.0), ("e", 5.0)]]):
        spark.createDataFrame(rows, "event_id string, price double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1 if n < 2 else 0)  # files are read in the order of their times
    done: list[str] = []
    state = {"runs": 0}

    def run(fail: bool, decided: str) -> None:
        ledger = worker.Ledger(spark, str(tmp_path / "ledger"))

        def work(rows):
            keys = sorted(r.event_id for r in rows.collect())
            if fail and "c" in keys:
                raise OSError("killed")
            done.extend(keys)

        def decide(rows):
            state["runs"] += 1
            return rows.withColumn("decided", F.lit(decided))

        stream = spark.readStream.schema("event_id string, price double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        stream.writeStream.foreachBatch(ledger.sink(work, decide)).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()

    with pytest.raises(Exception, match="killed"):
        run(True, "first")
    ledger = worker.Ledger(spark, str(tmp_path / "ledger"))
    assert {(r.event_id, r.status) for r in ledger.status().collect()} == {("a", "done"), ("b", "done"), ("c", "pending"), ("d", "pending")}
    run(False, "second")
    assert sorted(done) == ["a", "b", "c", "d", "e"]
    assert {(r.event_id, r.decided, r.status) for r in ledger.status().collect()} == {("a", "first", "done"), ("b", "first", "done"), ("c", "first", "done"), ("d", "first", "done"), ("e", "second", "done")}
    assert ledger.status().count() == 5 and state["runs"] == 3
    run(False, "third")
    assert len(done) == 5


def test_leases(spark, tmp_path):
    now = [1000.0]
    one, two, three = (worker.Ledger(spark, str(tmp_path / "ledger"), lease_seconds=60, owner=o, clock=lambda: now[0]) for o in ("one", "two", "three"))
    assert one.holder("q") is None and one.claim("q") and one.holder("q") == ("one", 1060.0)
    assert not two.claim("q") and not two.release("q")
    rows = spark.createDataFrame([("a",)], "event_id string")
    with pytest.raises(worker.Busy):
        two.sink(lambda r: None, name="q")(rows, 0)
    now[0] = 1050.0
    assert one.claim("q") and one.holder("q")[1] == 1110.0  # one's own lease can be renewed
    now[0] = 1111.0
    assert two.claim("q") and not three.claim("q")
    assert not one.release("q") and two.release("q")  # one's lease had run out
    assert three.claim("q") and three.release("q")
    assert worker.Ledger(spark, str(tmp_path / "other")).status().count() == 0
