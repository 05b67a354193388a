"""Writers of runs, documents and tables."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from tagweave.functions.text import bound
from tagweave.plans import files


def _published(df: DataFrame, path: str, write) -> None:
    """Writes beside ``path`` and moves it there, so that readers never see half a table."""
    staged = f"{path}.{uuid.uuid4().hex}"
    write(df, staged)
    files.replace_folder(df.sparkSession, staged, path)


def run(df: DataFrame, folder: str, kind: str) -> None:
    """Rows of a run (results, selections or predictions), a partition a run; an empty table is an error."""
    if df.isEmpty():
        raise ValueError(f"{kind} is empty")
    df.write.mode("append").partitionBy("run_id").parquet(f"{folder}/{kind}")


def packed_predictions(df: DataFrame, column: str = "predicted") -> DataFrame:
    """Tag arrays as numbers into the row's sorted distinct tags (256 at most) with the sentences' lengths."""
    def checked(labels):
        return F.when(F.size(labels) <= 256, labels).otherwise(F.raise_error(F.lit("more than 256 tags")).cast("array<string>"))

    def coded(s):
        return F.struct(s["labels"].alias("labels"), F.transform(s["tags"], lambda t: (F.array_position(s["labels"], t) - 1).cast("smallint")).alias("codes"))

    flat = F.flatten(F.col(column))
    both = bound(flat, lambda tags: F.struct(checked(F.array_sort(F.array_distinct(tags))).alias("labels"), tags.alias("tags")))
    out = df.withColumn("_p", bound(both, coded)).withColumn("lengths", F.transform(F.col(column), F.size))
    return out.withColumns({"labels": F.col("_p.labels"), "codes": F.col("_p.codes")}).drop(column, "_p")


def _unpacked(labels: pa.Array, lengths: pa.Array, codes: pa.Array) -> pa.Array:
    """Tag arrays of a batch's rows, all at once."""
    sizes = [pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False).astype(np.int64) for x in (labels, lengths)]
    row = pc.list_parent_indices(codes).to_numpy(zero_copy_only=False).astype(np.int64)
    at = (np.cumsum(sizes[0]) - sizes[0])[row] + pc.list_flatten(codes).to_numpy(zero_copy_only=False)
    tags = pc.list_flatten(labels).take(pa.array(at.astype(np.int64)))
    ends = np.cumsum(pc.list_flatten(lengths).to_numpy(zero_copy_only=False))
    sentences = pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), tags)
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes[1])].astype(np.int32)), sentences)


def unpacked_predictions(df: DataFrame, column: str = "predicted") -> DataFrame:
    """The reverse of packed_predictions."""
    tags = F.arrow_udf(_unpacked, T.ArrayType(T.ArrayType(T.StringType())))
    return df.withColumn(column, tags("labels", "lengths", "codes")).drop("labels", "lengths", "codes")


def documents(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "errorifexists").json(path)


def test_predictions(predicted: DataFrame, path: str) -> bool:
    """Tags put on test sentences (see testsplit.on_test_sentences) as JSON lines; nothing, and false, if any has none."""
    if not predicted.where("tags is null").isEmpty():
        return False
    rows = predicted.select(F.col("document_name").alias("document name"), F.col("sentence_id").alias("sentence-ID"), "tokens", F.col("tags").alias("ner-tags"))
    _published(rows, path, lambda d, p: d.write.json(p))
    return True


def progress(df: DataFrame, path: str) -> None:
    """The rows so far, in the place of those of the round before."""
    _published(df, path, lambda d, p: d.write.parquet(p))


def metrics(scores: DataFrame, path: str) -> None:
    """One row of scores as a JSON object."""
    import json

    rows = scores.limit(2).collect()
    if len(rows) != 1:
        raise ValueError("metrics are of one run")
    files.write_text(scores.sparkSession, path, json.dumps(rows[0].asDict(recursive=True), indent=2, sort_keys=True))


def heatmap(marked: DataFrame, path: str) -> None:
    """Words of each sentence with their marks and scores, a JSON line a sentence: ``row_id, words``."""
    word = F.struct(*(c for c in marked.columns if c != "row_id"))
    nested = marked.groupBy("row_id").agg(F.array_sort(F.collect_list(word)).alias("words"))
    _published(nested, path, lambda d, p: d.write.json(p))


def table_csv(df: DataFrame, path: str) -> None:
    """A small table as CSV, replaced as a whole."""
    _published(df, path, lambda d, p: d.coalesce(1).write.option("header", True).csv(p))


def snapshot_name(seed: int, metric: str, round_no: int) -> str:
    return f"seed{seed}/{metric}/round_{round_no:03d}"
