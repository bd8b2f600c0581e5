"""Work on events that is done once: retries with growing delays, and a ledger in two phases with leases.

`attempts` and `settle` are the batch forms of the retry rule: the n-th failure waits BASE_MS * 2^(n - 1), the TRIES-th one makes a dead letter.
`retry_stream` keeps the rule as keyed state with timers. `Ledger` gives each event a status: pending with what was decided about it,
then done. A run that ended between the phases is taken up again with the decision of the first time, and an event that is done
isn't taken up at all. All its changes of state are atomic: a file that only one can create, or a folder that is renamed.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

TRIES, BASE_MS = 3, 100
RESULT = "event_id string, value string, status string, tries int, reason string"


def waited_ms(failures: int | Column, base_ms: int = BASE_MS) -> Column:
    """How long an event has waited in all after so many failures: base * (1 + 2 + 4 + ...)."""
    n = F.lit(failures) if isinstance(failures, int) else failures
    return base_ms * (F.pow(F.lit(2), n) - 1).cast("long")


def reason_of(error: str | Column, tries: int = TRIES) -> Column:
    return F.concat(F.lit(f"store failed after {tries} attempts: "), F.col(error) if isinstance(error, str) else error)


def attempts(events: DataFrame, key: str, at: str, failures: str, tries: int = TRIES, base_ms: int = BASE_MS) -> DataFrame:
    """(key, attempt, due, ok, outcome): a row for each attempt of events of which the first `failures` attempts fail (null: all). The outcome of
    the last attempt is stored or dead, before that it is retry."""
    n = F.coalesce(F.least(F.col(failures).cast("int") + 1, F.lit(tries)), F.lit(tries))
    each = events.select(key, F.col(at).alias("_at"), F.col(failures).alias("_f"), n.alias("_n"), F.explode(F.sequence(F.lit(1), n)).alias("attempt"))
    ok = F.coalesce(F.col("attempt") > F.col("_f"), F.lit(False))
    outcome = F.when(ok, "stored").when(F.col("attempt") == tries, "dead").otherwise("retry")
    when = F.timestamp_micros(F.unix_micros(F.col("_at").cast("timestamp")) + 1000 * waited_ms(F.col("attempt") - 1, base_ms))
    return each.select(key, "attempt", when.alias("due"), ok.alias("ok"), outcome.alias("outcome"))


def settle(log: DataFrame, key: str, at: str, ok: str, error: str, tries: int = TRIES, base_ms: int = BASE_MS) -> DataFrame:
    """What a log of attempts comes to, one row a key: (key, tries, status, next_at, reason). Attempts count up to the first success or
    the TRIES-th failure. done: it succeeded; dead: with the reason of the last failure; waiting: due again at next_at."""
    order = Window.partitionBy(key).orderBy(at)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    done, failed = F.coalesce(F.max(F.col(ok).cast("int")).over(before), F.lit(0)), F.coalesce(F.sum((~F.col(ok)).cast("int")).over(before), F.lit(0))
    counted = log.withColumns({"_done": done, "_failed": failed}).where((F.col("_done") == 0) & (F.col("_failed") < tries))
    last = counted.groupBy(key).agg(F.count(F.lit(1)).cast("int").alias("tries"), F.max_by(F.struct(ok, at, error), at).alias("last"))
    status = F.when(F.col(f"last.{ok}"), "done").when(F.col("tries") >= tries, "dead").otherwise("waiting")
    micros = F.unix_micros(F.col(f"last.{at}").cast("timestamp")) + (1000 * base_ms * F.pow(F.lit(2), F.col("tries") - 1)).cast("long")
    return last.select(key, "tries", status.alias("status"), F.when(status == "waiting", F.timestamp_micros(micros)).alias("next_at"), F.when(status == "dead", reason_of(F.col(f"last.{error}"), tries)).alias("reason"))


class Retry(StatefulProcessor):
    """Tries `store(key, value)` for each new key, again after each delay, and tells when it is stored or dead. A key that has been
    settled, or is waiting, is not tried because it came again."""

    def __init__(self, store: Callable[[str, str], None], tries: int = TRIES, base_ms: int = BASE_MS):
        self.store, self.tries, self.base_ms = store, tries, base_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("attempts", "value string, tries int, settled boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        if not self.state.exists():
            yield from self.attempt(key[0], next(iter(rows)).value, 0, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        if self.state.exists():
            value, tries, settled = self.state.get()
            if not settled:
                yield from self.attempt(key[0], value, tries, timerValues)

    def attempt(self, key: str, value: str, tries: int, timers) -> Iterator[Row]:
        tries += 1
        try:
            self.store(key, value)
        except Exception as e:
            if tries >= self.tries:
                self.state.update((value, tries, True))
                yield Row(event_id=key, value=value, status="dead", tries=tries, reason=f"store failed after {tries} attempts: {e}")
            else:
                self.state.update((value, tries, False))
                self.handle.registerTimer(timers.getCurrentProcessingTimeInMs() + self.base_ms * 2 ** (tries - 1))
            return
        self.state.update((value, tries, True))
        yield Row(event_id=key, value=value, status="stored", tries=tries, reason=None)

    def close(self) -> None:
        pass


def retry_stream(events: DataFrame, store: Callable[[str, str], None], key: str = "event_id", value: str = "value", tries: int = TRIES, base_ms: int = BASE_MS) -> DataFrame:
    """(RESULT) of a stream of events: a row for each that was stored, or given up after so many tries. Spark keeps the state in RocksDB
    (spark.sql.streaming.stateStore.providerClass), and runs the timers by processing time. A batch that Spark repeats tries its events again:
    `store` must bear that, as a Ledger does."""
    rows = events.select(F.col(key).cast("string").alias("event_id"), F.col(value).cast("string").alias("value"))
    return rows.groupBy("event_id").transformWithState(Retry(store, tries, base_ms), RESULT, "append", "processingTime")


class Busy(RuntimeError):
    """Another worker holds the lease."""


class Ledger:
    """Events by batch, under `root`: pending/batch=N, then done/batch=N, and leases/NAME. owner tells workers apart; a lease that has run
    out may be taken over. Batches' numbers come from the stream, so a batch that is repeated finds its own folder."""

    def __init__(self, spark: SparkSession, root: str, key: str = "event_id", lease_seconds: float = 60, owner: str | None = None, clock: Callable[[], float] = time.time):
        self.spark, self.root, self.key, self.lease_seconds, self.clock = spark, root, key, lease_seconds, clock
        self.owner = owner or uuid.uuid4().hex
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, *parts: object):
        return self._path("/".join([self.root, *map(str, parts)]))

    def _rename(self, source, target) -> bool:
        self.fs.mkdirs(target.getParent())
        return self.fs.rename(source, target)

    # leases

    def holder(self, name: str) -> tuple[str, float] | None:
        """(owner, when the lease runs out)"""
        return self._holder(self._at("leases", name))

    def _holder(self, path) -> tuple[str, float] | None:
        try:
            data = self.fs.open(path)
            try:
                owner, _, until = bytes(data.readAllBytes()).decode().partition(" ")
            finally:
                data.close()
            # an empty file is a lease that is just being written
            return (owner, float(until)) if until else ("", self.fs.getFileStatus(path).getModificationTime() / 1000 + self.lease_seconds)
        except Exception:  # gone meanwhile, or never there
            return None

    def claim(self, name: str) -> bool:
        """Take the lease, unless another worker holds one that hasn't run out."""
        path = self._at("leases", name)
        held = self.holder(name)
        mine = bool(held and held[0] == self.owner)
        if held and not mine:
            if held[1] > self.clock():
                return False
            gone = self._at("leases", f".{name}-{uuid.uuid4().hex}")  # of all who want to take it over only one can rename it
            if not self.fs.rename(path, gone):
                return False
            if self._holder(gone) != held:  # somebody has been faster and has a new one
                self.fs.rename(gone, path)
                return False
            self.fs.delete(gone, False)
        self.fs.mkdirs(path.getParent())
        try:
            out = self.fs.create(path, mine)  # fails if another one has made it
        except Exception:
            return False
        out.write(bytearray(f"{self.owner} {self.clock() + self.lease_seconds}".encode()))
        out.close()
        return True

    def release(self, name: str) -> bool:
        held = self.holder(name)
        return bool(held and held[0] == self.owner and self.fs.delete(self._at("leases", name), False))

    # phases

    def read(self, phase: str) -> DataFrame | None:
        path = self._at(phase)
        if not self.fs.exists(path) or not self.fs.listStatus(path):
            return None
        return self.spark.read.parquet(path.toString())

    def begin(self, batch: DataFrame, batch_id: int, decide: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame | None:
        """The rows to work on: those of this batch that are neither done nor pending in another one, each key once, with what `decide`
        adds to them. If the batch had begun before, the rows as decided then; None if it is done."""
        name = f"batch={batch_id}"
        if self.fs.exists(self._at("done", name)):
            return None
        place = self._at("pending", name)
        if not self.fs.exists(place):
            fresh = batch.dropDuplicates([self.key])
            for phase in ("done", "pending"):
                known = self.read(phase)
                if known is not None:
                    fresh = fresh.join(known.select(self.key), self.key, "left_anti")
            temporary = self._at(".new", uuid.uuid4().hex)
            decide(fresh).write.parquet(temporary.toString())
            self._rename(temporary, place)
        return self.spark.read.parquet(place.toString())

    def complete(self, batch_id: int) -> None:
        name = f"batch={batch_id}"
        if not self.fs.exists(self._at("done", name)) and not self._rename(self._at("pending", name), self._at("done", name)):
            raise RuntimeError(f"{name} can't be completed")

    def status(self) -> DataFrame:
        """The rows of all batches with `batch` and `status`."""
        parts = [(p, df) for p in ("pending", "done") if (df := self.read(p)) is not None]
        if not parts:
            return self.spark.createDataFrame([], f"{self.key} string, batch int, status string")
        out = None
        for phase, df in parts:
            rows = df.withColumn("status", F.lit(phase))
            out = rows if out is None else out.unionByName(rows)
        return out

    def sink(self, work: Callable[[DataFrame], None], decide: Callable[[DataFrame], DataFrame] = lambda rows: rows, name: str = "worker") -> Callable[[DataFrame, int], None]:
        """For foreachBatch: one worker at a time; a batch is done once `work` has come back. `work` may see rows again of which a run that was
        lost had done a part."""

        def run(batch: DataFrame, batch_id: int) -> None:
            if not self.claim(name):
                raise Busy(f"{name} is held by {self.holder(name)}")
            try:
                rows = self.begin(batch, batch_id, decide)
                if rows is not None:
                    work(rows)
                    self.complete(batch_id)
            finally:
                self.release(name)

        return run
