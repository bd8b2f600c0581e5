"""Session helpers."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent


def ship(spark: SparkSession) -> None:
    """Give this package to the executors' Python, once per application."""
    sc = spark.sparkContext
    if getattr(sc, "_lumenshelf_shipped", False):
        return
    d = tempfile.mkdtemp(prefix="lumenshelf-")  # the driver serves the file from here while it lives
    atexit.register(shutil.rmtree, d, ignore_errors=True)
    sc.addPyFile(shutil.make_archive(f"{d}/{ROOT.name}", "zip", ROOT.parent, ROOT.name))
    sc._lumenshelf_shipped = True


def local_session(cpus: int | str = 8, memory: str = "16g", partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    settings = {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": memory,
        "spark.sql.adaptive.enabled": "true",
    } | conf
    return SparkSession.builder.master(f"local[{cpus}]").appName("lumenshelf").config(map=settings).getOrCreate()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder for files that all executors see: under spark.checkpoint.dir, or, with a local master, a temporary one."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not root:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="lumenshelf-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}-{uuid.uuid4().hex}")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return path.toString()
