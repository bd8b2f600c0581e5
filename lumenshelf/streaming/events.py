"""Product and feedback events: validation, dead letters, deduplication, and product state guarded by event time.

The batch functions and the streams give the same state. A stale event is stored but never overwrites newer state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.folds import fold

TYPES = ("discovered", "price_changed", "feedback")
#: What shoppers do, and where.
ACTIONS = ("result_click", "save", "unsave", "thumb_up", "thumb_down", "tryon_start", "outfit_accept", "outfit_reject")
SURFACES, CATALOGS = ("search", "product", "outfit", "agent", "tryon"), ("clothing", "shoes", "jewelry", "watches")
PAYLOAD = (
    "product_url string, brand string, name string, price double, compare_at_price double, old_price double, new_price double, currency string, image_url string, category string, "
    "action string, client_event_id string, actor string, surface string, catalog string, query string, position double"
)
ENVELOPE = f"event_id string, type string, version int, occurred_at string, source string, payload struct<{PAYLOAD.replace(' string', ':string').replace(' double', ':double')}>"


FIELDS = ("event_id", "type", "version", "occurred_at", "source", "payload")


def parse(raw: DataFrame, value: str = "value") -> DataFrame:
    """All columns, with the event's fields and `reason`: why it is not valid, null if it is. Each message is parsed once: the
    fields are generated from one struct, so that filters on them aren't moved in front of it with copies of the parser."""
    read = F.struct(F.from_json(F.col(value), ENVELOPE, {"mode": "PERMISSIVE"}).alias("e"), F.try_parse_json(F.col(value)).isNull().alias("bad"))

    def event(x: Column) -> Column:
        ts = F.try_to_timestamp(x["e"]["occurred_at"])
        return F.struct(*(x["e"][f].alias(f) for f in FIELDS), ts.alias("ts"), F.substring(_reason(x["e"], x["bad"], ts), 1, 500).alias("reason"))

    return raw.select(*raw.columns, F.inline(F.transform(F.array(read), event)))


def _reason(e: Column, bad: Column, ts: Column) -> Column:
    p = lambda c: e["payload"][c]
    size = lambda c: F.length(F.coalesce(c, F.lit("")))
    kind = e["type"]
    url = lambda c: F.coalesce(c.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^\s/]+"), F.lit(False))
    money = lambda c: F.coalesce(c >= 0, F.lit(False))
    product, changed, feedback = kind.isin("discovered", "price_changed"), kind == "price_changed", kind == "feedback"
    checks = [
        (bad, "not JSON"),
        (size(e["event_id"]) < 8, "envelope: event_id"),
        (~F.coalesce(kind.isin(*TYPES), F.lit(False)), "envelope: type"),
        (~e["version"].eqNullSafe(F.lit(1)), "envelope: version"),
        (ts.isNull(), "envelope: occurred_at"),
        (size(e["source"]) < 1, "envelope: source"),
        (e["payload"].isNull(), "envelope: payload"),
        (product & ~url(p("product_url")), "payload: product_url"),
        (product & (size(p("brand")) < 1), "payload: brand"),
        (product & ~size(p("name")).between(1, 200), "payload: name"),
        ((kind == "discovered") & ~money(p("price")), "payload: price"),
        (changed & ~money(p("old_price")), "payload: old_price"),
        (changed & ~money(p("new_price")), "payload: new_price"),
        (product & p("currency").isNotNull() & (size(p("currency")) != 3), "payload: currency"),
        (feedback & ~F.coalesce(p("action").isin(*ACTIONS), F.lit(False)), "payload: action"),
        (feedback & ~size(p("client_event_id")).between(8, 64), "payload: client_event_id"),
        (feedback & ~size(p("actor")).between(8, 64), "payload: actor"),
        (feedback & p("surface").isNotNull() & ~p("surface").isin(*SURFACES), "payload: surface"),
        (feedback & p("catalog").isNotNull() & ~p("catalog").isin(*CATALOGS), "payload: catalog"),
        (feedback & (size(p("query")) > 200), "payload: query"),
        (feedback & p("position").isNotNull() & ~(p("position").between(0, 200) & (p("position") == F.floor(p("position")))), "payload: position"),
    ]
    return F.coalesce(*(F.when(c, F.lit(r)) for c, r in checks))


def split(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid events, dead letters)"""
    return parsed.where("reason is null").drop("reason"), parsed.where("reason is not null")


def dedupe(events: DataFrame, key: str = "event_id", order: str = "ts") -> DataFrame:
    """The first event of each id; of those at one time, the one with the least hash of its columns."""
    w = Window.partitionBy(key).orderBy(order, F.xxhash64(*events.columns))
    return events.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def dedupe_stream(events: DataFrame, delay: str = "24 hours", key: str = "event_id", time: str = "ts") -> DataFrame:
    return events.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def latest(events: DataFrame, key: str, value: str, time: str = "ts", tie: str = "event_id") -> DataFrame:
    """State of each key: the value of its last event by time, of those at one time the one with the largest tie; first and
    last time, number of events."""
    return events.groupBy(key).agg(F.max_by(value, F.struct(time, tie)).alias(value), F.min(time).alias("first_seen"), F.max(time).alias("last_event"), F.count(F.lit(1)).alias("events"))


def price_drops(events: DataFrame, key: str, value: str, time: str = "ts", tie: str = "event_id") -> DataFrame:
    """Events whose value is below the one before, in time order."""
    w = Window.partitionBy(key).orderBy(time, tie)
    return events.withColumn("old_value", F.lag(value).over(w)).where(F.col(value) < F.col("old_value"))


STATE = "price double, ts long, first long, n long"
OUT = "key long, price double, first long, ts long, n long, old_price double"


def fold_stream(events: DataFrame, key: str, value: str, time: str = "ts") -> DataFrame:
    """The stream form of latest() and price_drops(): a row for each batch and key with the state after it, and the price before a
    drop (null if there was none). Times are microseconds."""

    def fold(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        price, at, first, n = state.get if state.exists else (None, None, None, 0)
        dropped = None
        rows = pd.concat(list(frames)).sort_values("ts", kind="stable")
        for value_now, ts in zip(rows["v"], rows["ts"], strict=True):
            n += 1
            first = ts if first is None else min(first, ts)
            if at is None or ts >= at:
                if price is not None and value_now < price:
                    dropped = price
                price, at = value_now, ts
        state.update((float(price), int(at), int(first), int(n)))
        yield pd.DataFrame({"key": [k[0]], "price": [float(price)], "first": [int(first)], "ts": [int(at)], "n": [int(n)], "old_price": [dropped]}).astype({"old_price": "float64"})

    rows = events.select(F.col(key).cast("long").alias("k"), F.col(value).cast("double").alias("v"), F.unix_micros(time).alias("ts"))
    return rows.groupBy("k").applyInPandasWithState(fold, OUT, STATE, "update", GroupStateTimeout.NoTimeout)


def fan_out(valid: DataFrame) -> dict[str, DataFrame]:
    """Jobs by queue: images of new products, notifications of price drops, feedback to append."""
    p = F.col("payload")
    return {
        "images": valid.where((F.col("type") == "discovered") & p["image_url"].isNotNull()).select("event_id", p["product_url"].alias("product_url"), p["image_url"].alias("image_url")),
        "drops": valid.where((F.col("type") == "price_changed") & (p["new_price"] < p["old_price"])).select("event_id", p["product_url"].alias("product_url"), p["old_price"].alias("old_price"), p["new_price"].alias("new_price")),
        "feedback": valid.where(F.col("type") == "feedback").select("event_id", p["actor"].alias("actor"), p["action"].alias("action"), p["product_url"].alias("product_url")),
    }


def append_once(batch: DataFrame, ledger: str, key: str = "event_id", batch_id: int = 0) -> None:
    """foreachBatch sink: rows whose key the ledger doesn't have yet, in a folder of the batch that a replay overwrites."""
    spark = batch.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(ledger)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    fresh = batch.dropDuplicates([key])
    if fs.exists(path):
        fresh = fresh.join(spark.read.parquet(ledger).where(F.col("batch") != batch_id).select(key), key, "left_anti")
    fresh.write.mode("overwrite").parquet(f"{ledger}/batch={batch_id}")


def breaker(outcomes: DataFrame, key: str, ok: str, time: str = "ts", failures: int = 3, open_seconds: int = 60) -> DataFrame:
    """Circuit breaker by key: `open` tells whether an attempt met an open breaker. So many failures in a row open it for a while;
    attempts then are refused and don't count. The state of a provider is two numbers."""

    def step(state: tuple[int, float], row: tuple) -> tuple[tuple[int, float], tuple]:
        run, until = state
        good, at = row
        if at < until:
            return state, (True,)
        run = 0 if good else run + 1
        return ((0, at + open_seconds * 1_000_000) if run >= failures else (run, until)), (False,)

    timed = outcomes.withColumn("_us", F.unix_micros(time))
    return fold(timed, [key], ["_us", F.xxhash64(*outcomes.columns)], [ok, "_us"], "open boolean", lambda: (0, float("-inf")), step).drop("_us")
