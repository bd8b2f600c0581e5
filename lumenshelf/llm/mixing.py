"""Mixing sources to target weights by Pfair scheduling.

Each source's rows, in a pseudo-random order, form blocks. Block j of a source of weight w is released at slot floor(j / w)
and due at slot ceil((j + 1) / w); the earliest deadline among released blocks takes the next slot. At any slot each
source then has within one block of its share. Weights are whole units, UNITS of them in all or a few more, not shares of a
frame: the deviation from the given weights grows by less than 1/UNITS of a block a slot.

Slots are scheduled in frames that need nothing of each other: with C the sum of a source's weight and of those before it,
floor(C t) - floor(C' t) blocks of it come before slot t, which adds up to t and is within one of its share. A frame takes
the blocks between two such counts; all windows can be kept within it, so the earliest deadlines do. Frames are scheduled apart
from each other, whatever the number of blocks. They are FRAME slots long, or so long that each source has a block in each, which
takes up to MOST slots (four for each source, if that is more); a weight that is still smaller counts as one block of these.

Results: every row comes back once. When a source has run out, its slots stay empty and the others keep their order. A null
source is a source of its own. Sources without a weight, or with one that isn't positive, come after all others, mixed by
their sizes. Rows with one id, or none, are ordered by the other columns; rows repeated whole have places of their own.
Columns named as the added ones are replaced.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh

UNITS = 1 << 40
FRAME, MOST = 1024, 1 << 20
BLOCK = 32
GROUP = 4096  # rows ranked together
ADDED = ("block", "release", "deadline", "slot", "place")
SLOTS = "phase int, key string, block long, release long, deadline long, slot long"


def earliest_first(blocks: list[tuple], begin: int) -> list[int]:
    """The slot of each block (release, deadline, name, number): from `begin` on, one at a time, the earliest deadline among
    those released; equal ones by name."""
    waiting = sorted(range(len(blocks)), key=lambda i: blocks[i][0])
    ready: list[tuple] = []
    slots = [0] * len(blocks)
    k, now = 0, begin
    while k < len(waiting) or ready:
        if not ready:
            now = max(now, blocks[waiting[k]][0])
        while k < len(waiting) and blocks[waiting[k]][0] <= now:
            heapq.heappush(ready, (*blocks[waiting[k]][1:], waiting[k]))
            k += 1
        slots[heapq.heappop(ready)[-1]] = now
        now += 1
    return slots


def _times(a: Column, b: Column, c: Column) -> Column:
    """floor(a * b / c) of whole numbers, exactly: a, c up to 2^42, b up to 2^60"""
    return F.call_function("div", a.cast("decimal(14,0)") * b.cast("decimal(20,0)"), c.cast("decimal(14,0)"))


def _ordered_by(df: DataFrame) -> Column:
    plain = [c for c, t in zip(df.columns, df.schema, strict=True) if not isinstance(t.dataType, (T.MapType, T.VariantType))]
    return F.xxhash64(*(F.col(f"`{c}`") for c in plain)) if plain else F.lit(0)


def _sources(sizes: DataFrame, weights: dict[str | None, float] | None, temperature: float) -> DataFrame:
    """sizes: (key, n rows). Adds phase, w, upto (weights of those before and its own, added) and total, in units."""
    if weights is None:
        weighed = sizes.withColumn("_w", F.pow("n", F.lit(temperature)))
    else:
        rows = [("-" if k is None else f"s{k}", float(v or 0)) for k, v in weights.items()]
        given = sizes.sparkSession.createDataFrame(rows, "key string, _w double")
        weighed = sizes.join(given, "key", "left")
    fine = F.coalesce(F.col("_w") > 0, F.lit(False))
    weighed = weighed.withColumns({"phase": (~fine).cast("int"), "_w": F.when(fine, F.col("_w")).otherwise(F.col("n").cast("double"))})
    phase = Window.partitionBy("phase")
    most = F.greatest(F.lit(MOST), 4 * F.count(F.lit(1)).over(phase))
    units = F.greatest(F.ceil(UNITS / most), F.round(F.col("_w") / F.sum("_w").over(phase) * UNITS)).cast("long")
    summed = weighed.withColumn("w", units)
    return summed.withColumns({"upto": F.sum("w").over(phase.orderBy("key").rowsBetween(Window.unboundedPreceding, 0)), "total": F.sum("w").over(phase)}).drop("_w")


def _slots(blocks: DataFrame, frame: int) -> DataFrame:
    """blocks: (phase, key, block, w, upto, total), each once. SLOTS rows."""
    j = F.col("block")
    before = F.col("upto") - F.col("w")
    done = lambda t: _times(F.col("upto"), t, F.col("total")) - _times(before, t, F.col("total"))
    windows = blocks.withColumns({"release": _times(j, F.col("total"), F.col("w")), "deadline": _times(j + 1, F.col("total"), F.col("w")) + (_times(j + 1, F.col("total"), F.col("w")) * F.col("w").cast("decimal(20,0)") < (j + 1).cast("decimal(18,0)") * F.col("total").cast("decimal(14,0)")).cast("long")})
    guess = F.floor(F.col("release") / frame).cast("long")  # the window may reach into the frames beside
    ends = [guess - 2, guess - 1, guess, guess + 1]
    number = F.coalesce(*(F.when(done((f + 1) * frame) > j, f) for f in ends), guess + 2)
    framed = windows.withColumn("frame", F.greatest(number, F.lit(0)))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        begin = int(pdf["frame"].iloc[0]) * frame
        rows = zip(pdf["release"].clip(lower=begin).tolist(), pdf["deadline"].tolist(), pdf["key"].tolist(), pdf["block"].tolist(), strict=True)
        return pdf.assign(slot=earliest_first(list(rows), begin))[[x.split()[0] for x in SLOTS.split(", ")]]

    return framed.select("phase", "key", "block", "release", "deadline", "frame").groupBy("phase", "frame").applyInPandas(one, SLOTS)


def mix(df: DataFrame, weights: dict[str | None, float] | None = None, temperature: float = 0.7, doc_id: str = "doc_id", source: str = "source", block: int = BLOCK, frame: int = FRAME, seed: int = 17) -> DataFrame:
    """All columns, with block, release, deadline, slot and place. Without weights, those are the sources' numbers of rows to the
    power `temperature`."""
    base = df.drop(*ADDED)
    key, u, g, tie, i, arr, first, offset, at = fresh(base, "_key", "_u", "_g", "_tie", "_i", "_slots", "_first", "_offset", "_at")
    named = F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit("-"))
    spread = F.when(F.col(doc_id).isNull(), F.xxhash64(F.lit(seed), F.col(tie))).otherwise(F.xxhash64(F.lit(seed), doc_id))
    rows = base.withColumns({key: named, tie: _ordered_by(base)}).withColumn(u, F.shiftrightunsigned(spread, 1))
    sizes = rows.groupBy(F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("n"))
    sources = _sources(sizes, weights, temperature)
    frame = max(frame, sources.agg(F.max(F.ceil(F.col("total") / F.col("w")))).first()[0] or 0)
    # rows are ranked in groups: an even cut of the hashes, more groups for larger sources
    groups = sizes.select(F.col("key").alias(key), F.ceil(F.col("n") / GROUP).alias(at))
    ranked = rows.join(groups, key).withColumn(g, F.least(F.col(at) - 1, (F.col(u) / float(2**63) * F.col(at)).cast("long"))).drop(at)
    counts = ranked.groupBy(F.col(key).alias("key"), F.col(g).alias("g")).agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("key").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = counts.withColumn("before", before).join(sources.drop("n"), "key")
    held = placed.withColumn("block", F.explode(F.sequence(F.expr(f"before div {block}"), F.expr(f"(before + n - 1) div {block}"))))
    slots = _slots(held.select("phase", "key", "block", "w", "upto", "total").distinct(), frame)
    late = F.lit(0)
    per_group = held.select("key", "g", "before", "block").join(slots, ["key", "block"])
    if weights is not None:
        last = slots.where("phase = 0").agg((F.coalesce(F.max("slot"), F.lit(-1)) + 1).alias("shift"))
        per_group = per_group.join(F.broadcast(last))  # one row
        late = F.when(F.col("phase") == 1, F.col("shift")).otherwise(0)
    found = F.struct("block", (F.col("release") + late).alias("release"), (F.col("deadline") + late).alias("deadline"), (F.col("slot") + late).alias("slot"))
    lists = per_group.groupBy(F.col("key").alias(key), F.col("g").alias(g)).agg(F.array_sort(F.collect_list(found)).alias(arr), F.first("before").alias(first))
    numbered = ranked.withColumn(i, F.row_number().over(Window.partitionBy(key, g).orderBy(u, doc_id, tie)) - 1).join(lists, [key, g])
    rank = F.col(first) + F.col(i)
    own = F.element_at(arr, (F.floor(rank / block) - F.col(arr)[0]["block"] + 1).cast("int"))
    done = numbered.withColumns({at: own, offset: rank % block})
    return done.select(*(F.col(f"`{c}`") for c in base.columns), *(F.col(at)[x].alias(x) for x in ADDED[:4]), (F.col(at)["slot"] * block + F.col(offset)).alias("place"))


def ordered(df: DataFrame, **options) -> DataFrame:
    """The rows of df, sorted by place: file after file, row after row, the mixture."""
    own = {c: f"{c}_of_df" for c in df.columns if c in ADDED}
    mixed = mix(df.withColumnsRenamed(own), **options).orderBy("place")
    return mixed.select(*(F.col(own.get(c, c)).alias(c) for c in df.columns))
