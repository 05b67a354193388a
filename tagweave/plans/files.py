"""Small files and folders on any file system that Hadoop knows."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def _of(spark: SparkSession, path: str):
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(str(path))
    return at.getFileSystem(conf), at, jvm, conf


def exists(spark: SparkSession, path: str) -> bool:
    fs, at, _, _ = _of(spark, path)
    return fs.exists(at)


def read_text(spark: SparkSession, path: str) -> str:
    fs, at, jvm, _ = _of(spark, path)
    stream = fs.open(at)
    try:
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes beside ``path`` and renames over it, so that readers see the old file or the new one."""
    fs, at, jvm, conf = _of(spark, path)
    fs.mkdirs(at.getParent())
    staged = jvm.org.apache.hadoop.fs.Path(f"{at.toString()}.{uuid.uuid4().hex}")
    stream = fs.create(staged)
    stream.write(bytearray(text.encode("utf-8")))
    stream.close()
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf).rename(fs.makeQualified(staged), fs.makeQualified(at), options)


def replace_folder(spark: SparkSession, staged: str, target: str) -> None:
    """Puts a written folder in the place of another, which is moved aside first and deleted last."""
    fs, at, jvm, _ = _of(spark, target)
    aside = jvm.org.apache.hadoop.fs.Path(f"{at.toString()}.{uuid.uuid4().hex}")
    fs.mkdirs(at.getParent())
    old = fs.exists(at) and fs.rename(at, aside)
    if not fs.rename(jvm.org.apache.hadoop.fs.Path(str(staged)), at):
        if old:
            fs.rename(aside, at)
        raise OSError(f"{staged} can't be moved to {target}")
    if old:
        fs.delete(aside, True)
