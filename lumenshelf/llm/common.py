"""Shared helpers of the training-data operators: table access and durable intermediate tables."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like `names` that no column of df has, whatever its case, for helper columns."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where nothing is set, a local master (tests) gets a temporary one of this process;
    on a cluster that would be a folder of one machine, so it is an error there."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="lumenshelf-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        sc.setCheckpointDir(found)
    return found


class Scratch:
    """Written intermediate tables. They cut lineage and survive the loss of executors. What an operator returns reads only its
    last table (`finish`); the others go as soon as it is written, and the last when the application ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.n = 0
        self.live: dict[str, DataFrame] = {}

    def keep(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/t{self.n}"
        df.write.option("compression", "zstd").parquet(path)
        if self.n == 1:
            self._hadoop(self.root)[0].deleteOnExit(self._hadoop(self.root)[1])
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        self.live[path] = out
        return out

    def bucketed(self, df: DataFrame, key: str) -> DataFrame:
        """df as a table in as many buckets of `key` as a shuffle has partitions: joins by the key move the other side only. Its
        name is in the session's catalog until the table is dropped, its files are with the other tables'."""
        self.n += 1
        path, name = f"{self.root}/t{self.n}", f"scratch_{uuid.uuid4().hex}"
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        df.write.option("compression", "zstd").option("path", path).bucketBy(parts, key).saveAsTable(name)
        out = self.spark.table(name)
        out._scratch_path, out._scratch_name = path, name
        self.live[path] = out
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables nothing will read again."""
        for df in tables:
            if self.live.pop(df._scratch_path, None) is not None:
                if hasattr(df, "_scratch_name"):
                    self.spark.sql(f"DROP TABLE IF EXISTS {df._scratch_name}")
                fs, path = self._hadoop(df._scratch_path)
                fs.delete(path, True)

    def folder(self) -> str:
        """The qualified address of this run's folder, for files that are not tables. It goes when the application ends."""
        fs, path = self._hadoop(self.root)
        fs.deleteOnExit(path)
        fs.mkdirs(path)
        return fs.makeQualified(path).toString()

    def delete(self, path: str) -> None:
        fs, at = self._hadoop(path)
        fs.delete(at, True)

    def finish(self, df: DataFrame) -> DataFrame:
        """Keep df as the only table."""
        out = self.keep(df)
        self.drop(*[t for t in self.live.values() if t is not out])
        return out

    def _hadoop(self, path: str) -> tuple:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def release(self) -> None:
        """Let Spark delete the shuffle files of plans that are done: its cleaner does so once the driver has collected its
        garbage, which a small heap does by itself, but a large one seldom."""
        gc.collect()
        self.spark._jvm.System.gc()
