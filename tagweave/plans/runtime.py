"""Session helpers: tables, the shared folder and cutting lineage.

Lineage is cut with tables written to the folder in ``spark.checkpoint.dir``, which every executor
shares, so a lost executor never loses an intermediate result.
"""

from __future__ import annotations

import atexit
import contextlib
import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table of a data folder (a Parquet file or a folder of them)."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The shared folder that the session names in ``spark.checkpoint.dir``.

    A session on one machine that names none (tests, benchmarks) gets a folder of its own, deleted at the
    end. On a cluster there is no such way out: a folder of one machine would lose the others' rows.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="tagweave-")
        atexit.register(shutil.rmtree, at[len("file://"):], ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", at)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a file or folder, of whatever file system, if it is there."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


class Scratch:
    """Written intermediate tables of one query, under the shared folder.

    ``keep(df)`` writes ``df`` (in a folder for each value of its last columns ``by``) and reads it back, which cuts its lineage; ``drop(df)`` deletes a table
    that no later step reads. A query's result may read its tables for as long as it is used, so the rest
    goes with ``close()``, or when the program ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/tables/{name}-{uuid.uuid4().hex}"
        self._count = 0
        self._path_of: dict[int, tuple[DataFrame, str]] = {}
        atexit.register(self.close)

    def keep(self, df: DataFrame, *by: str) -> DataFrame:
        path = f"{self.root}/{self._count}"
        self._count += 1
        df.write.option("compression", "zstd").parquet(path, partitionBy=list(by) or None)
        kept = self.spark.read.schema(df.schema).parquet(path)
        self._path_of[id(kept)] = (kept, path)
        return kept

    def path(self, kept: DataFrame) -> str:
        return self._path_of[id(kept)][1]

    def drop(self, kept: DataFrame) -> None:
        delete(self.spark, self._path_of.pop(id(kept))[1])

    def close(self) -> None:
        """Deletes all that was written; results that read it can't be used any more."""
        atexit.unregister(self.close)
        self._path_of.clear()
        with contextlib.suppress(Exception):  # the session may be gone, and its folder with it
            delete(self.spark, self.root)


def local_session(cores: int | str = "*", **conf: str) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("tagweave")
    settings = {
        "spark.ui.enabled": "false",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": "8",
        "spark.driver.memory": os.environ.get("TAGWEAVE_DRIVER_MEMORY", "8g"),
        "spark.ui.showConsoleProgress": "false",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
