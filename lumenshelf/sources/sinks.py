"""Exports, backups and event sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def flat(df: DataFrame) -> DataFrame:
    """Arrays joined by ` | `, structs as JSON, line breaks in texts as spaces: one cell a column."""

    def cell(f: T.StructField) -> object:
        c = F.col(f.name)
        if isinstance(f.dataType, T.ArrayType):
            inner = f.dataType.elementType
            parts = F.transform(c, lambda x: F.to_json(x)) if isinstance(inner, (T.StructType, T.ArrayType, T.MapType)) else c.cast("array<string>")
            return F.array_join(parts, " | ").alias(f.name)
        if isinstance(f.dataType, (T.StructType, T.MapType)):
            return F.to_json(c).alias(f.name)
        return F.regexp_replace(c, r"\s*[\r\n]+\s*", " ").alias(f.name) if isinstance(f.dataType, T.StringType) else c

    return df.select(*(cell(f) for f in df.schema))


def export(df: DataFrame, folder: str) -> None:
    """JSON lines and CSV of one table."""
    df.write.mode("overwrite").json(f"{folder}/json")
    flat(df).write.mode("overwrite").option("header", True).option("escape", '"').csv(f"{folder}/csv")


def backup(tables: dict[str, DataFrame], root: str) -> DataFrame:
    """JSON lines of every table, and (table, rows), also written as `_summary`."""
    spark = next(iter(tables.values())).sparkSession
    counts = []
    for name, df in tables.items():
        df.write.mode("overwrite").json(f"{root}/{name}")
        counts.append((name, spark.read.text(f"{root}/{name}").count()))
    out = spark.createDataFrame(counts, "table string, rows long")
    out.coalesce(1).write.mode("overwrite").json(f"{root}/_summary")
    return out


def may_wipe(backup_age_minutes: float | None, table: str, keep: tuple[str, ...] = ("users", "favorites", "outfits", "wardrobe")) -> bool:
    """A table may be emptied only with a backup of the last hour, user tables never."""
    return table not in keep and backup_age_minutes is not None and backup_age_minutes < 60


def dead_letters(df: DataFrame, raw: str = "value", reason: str = "reason") -> DataFrame:
    return df.where(F.col(reason).isNotNull()).select(F.col(raw).alias("raw"), F.substring(reason, 1, 500).alias("reason"), F.current_timestamp().alias("failed_at"))


def to_topic(events: DataFrame, key: str, topic: str) -> DataFrame:
    """(topic, key, value) as a message sink takes them: one key, one partition, in order."""
    return events.select(F.concat(F.lit(f"{topic}."), "type").alias("topic"), F.col(key).cast("string").alias("key"), F.to_json(F.struct(*events.columns)).alias("value"))


def prune(jobs: DataFrame, now: str, days: int = 30) -> DataFrame:
    """Finished jobs older than so many days go; queued or running ones become failed (their process is gone)."""
    old = F.col("status").isin("done", "failed") & (F.col("updated_at") < F.lit(now).cast("timestamp") - F.expr(f"interval {int(days)} days"))
    return jobs.where(~F.coalesce(old, F.lit(False))).withColumn("status", F.when(F.col("status").isin("queued", "running"), "failed").otherwise(F.col("status")))
