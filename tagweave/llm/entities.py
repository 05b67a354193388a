"""Groups of sentence rows whose documents are related (problem 1)."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tagweave.llm.components import connected_components, proportional_splits
from tagweave.plans.runtime import Scratch

# How a missing value is put in words, once lower-cased and trimmed.
MISSING = {"", "-", "--", "?", "none", "null", "nil", "nan", "unknown", "n/a", "na", "n.a.", "not given", "(not given)", "missing", "(none)", "(unknown)", "<na>", "tbd", "unbekannt"}
# Endings of files that hold a document's text or annotation.
EXTENSIONS = ("txt", "json", "jsonl", "ann", "xml", "csv", "tsv", "md", "html", "conll")

#: Rows from which a key may be hot, and hot keys at most.
HOT_ROWS, MOST_HOT = 100_000, 500

_extension = re.compile(r"\.(?:%s)$" % "|".join(EXTENSIONS))
_revision = re.compile(r"[\s_.\-]*(?:\(\s*(?:rev(?:ision)?|v(?:ersion)?)[\s._\-]*\d+\s*\)|(?<=[\s_.\-])(?:rev(?:ision)?|v(?:ersion)?)[\s._\-]*\d+)$")
_dashes = re.compile("[‐-―−]")
_breaks = re.compile(r"[\s_.\-]+")


def _plain(value: str | None) -> str | None:
    """Composed form, lower case, single spaces; null for a missing value however it is put."""
    if value is None:
        return None
    text = _dashes.sub("-", " ".join(unicodedata.normalize("NFKC", value).split())).casefold()
    return None if text in MISSING else unicodedata.normalize("NFC", text)


def document_key(name: str | None) -> str | None:
    """What all spellings and revisions of a document's name share; null if the name is missing.

    Case, Unicode form, white space, folders, file endings, revision marks and the choice of
    separators don't count.
    """
    text = _plain(name)
    if text is None:
        return None
    text = text.replace("\\", "/").rstrip("/ ").rpartition("/")[2].strip()
    while (short := _revision.sub("", _extension.sub("", text))) != text and short.strip(" _.-"):
        text = short
    return _breaks.sub("_", text).strip("_") or None


def entity_key(value: str | None) -> str | None:
    """What all spellings of an author or a source file share; null if it is missing."""
    text = _plain(value)
    if text is None:
        return None
    text = re.sub("/+", "/", text.replace("\\", "/"))
    return (text[2:] if text.startswith("./") else text) or None


@F.pandas_udf(T.StringType())
def document_key_of(names: pd.Series) -> pd.Series:
    return names.map(document_key, na_action="ignore").astype(object)


@F.pandas_udf(T.StringType())
def entity_key_of(values: pd.Series) -> pd.Series:
    return values.map(entity_key, na_action="ignore").astype(object)


#: Times that names are hashed anew before the search is given up.
MOST_SEEDS = 8


def _seed(names: DataFrame) -> int:
    """A seed under which no two different ``names(kind, name)`` share their hash of 64 bits."""
    for seed in range(MOST_SEEDS):
        same = names.groupBy(_node(seed, F.col("kind"), F.col("name"))).agg(F.min(F.struct("kind", "name")).alias("a"), F.max(F.struct("kind", "name")).alias("b"))
        if same.where("a <> b").isEmpty():
            return seed
    raise RuntimeError("no seed tells all names apart")


def _node(seed: int, kind: Column, name: Column) -> Column:
    return F.xxhash64(F.lit(seed), kind, name)


def related_names(sentences: DataFrame, registry: DataFrame, scratch: Scratch) -> DataFrame:
    """One row per distinct raw document name of ``sentences``: ``document_name, group_id, n_names, n_rows``.

    ``group_id`` is the smallest ``row_id`` over all rows of the name's group and ``n_names`` the group's
    number of raw names; both are null for a name that stands for a missing one. Names are reduced to one row
    each, with their row counts, before anything else is done, so that a name holding much of the table costs
    no more than another. Documents, authors and files are nodes; each registry row gives at most two edges,
    so the edges never outnumber twice the registry's rows and no pairs within a group arise. Null, blank and
    worded missing names, authors and files connect nothing. Empty tables give an empty result.
    """
    all_names = scratch.keep(
        sentences.groupBy("document_name").agg(F.min("row_id").alias("first_row"), F.count("*").alias("n_rows"))
        .where("document_name is not null").withColumn("document", document_key_of("document_name")))
    known = scratch.keep(
        registry.select("document_name", "author", "source_file").distinct()
        .select(document_key_of("document_name").alias("document"), entity_key_of("author").alias("author"), entity_key_of("source_file").alias("source_file"))
        .where("document is not null"))
    entity = F.explode(F.array(*(F.when(F.col(c).isNotNull(), F.struct(F.lit(c).alias("kind"), F.col(c).alias("name"))) for c in ("author", "source_file"))))
    ends = known.select("document", entity.alias("e")).where("e is not null").select("document", "e.kind", "e.name")
    document = F.lit("document")
    named = all_names.where("document is not null")
    seed = _seed(named.select(document.alias("kind"), F.col("document").alias("name")).unionByName(known.select(document.alias("kind"), F.col("document").alias("name"))).unionByName(ends.select("kind", "name")).distinct())
    links = ends.select(_node(seed, document, F.col("document")).alias("u"), _node(seed, F.col("kind"), F.col("name")).alias("v"))
    members = connected_components(links, scratch)
    grouped = named.withColumn("node", _node(seed, document, F.col("document"))).join(members, "node", "left").withColumn("component", F.coalesce("component", "node"))
    totals = grouped.groupBy("component").agg(F.min("first_row").alias("group_id"), F.count("*").alias("n_names"))
    out = grouped.join(totals, "component").select("document_name", "group_id", "n_names", "n_rows")
    missing = all_names.where("document is null").select("document_name", F.lit(None).cast("long").alias("group_id"), F.lit(None).cast("long").alias("n_names"), "n_rows")
    return out.unionByName(missing)


def related_rows(sentences: DataFrame, registry: DataFrame, scratch: Scratch) -> DataFrame:
    """``row_id, group_id, n_names`` for every row with a document name."""
    names = scratch.keep(related_names(sentences, registry, scratch))
    rows = with_groups(sentences.select("row_id", "document_name").where("document_name is not null"), names, "document_name")
    return rows.where("group_id is not null").select("row_id", "group_id", "n_names")


def with_groups(rows: DataFrame, groups: DataFrame, key: str) -> DataFrame:
    """``rows`` joined to ``groups``, one row a key with its ``n_rows``.

    Keys that hold more than a MOST_HOT-th of the rows (so there are fewer of them than that) are joined by
    broadcast, so that no task gets all rows of one; the others meet in the shuffle.
    """
    total = groups.agg(F.sum("n_rows")).first()[0] or 0
    limit = max(HOT_ROWS, total // MOST_HOT)
    hot = [tuple(r) for r in groups.where(F.col("n_rows") > limit).collect()] if total > limit else []
    if not hot:
        return rows.join(groups, key)
    is_hot = F.col(key).isin([dict(zip(groups.columns, r))[key] for r in hot])
    few = F.broadcast(rows.sparkSession.createDataFrame(hot, groups.schema))
    return rows.where(~is_hot).join(groups.where(~is_hot), key).unionByName(rows.where(is_hot).join(few, key))


def related_splits(sentences: DataFrame, registry: DataFrame, scratch: Scratch, shares: dict[str, float], seed: int = 0) -> DataFrame:
    """``row_id, group_id, split`` for every row of ``sentences``.

    Rows of one group share a split. A row whose document name is missing is a group of its own, known
    by its ``row_id``.
    """
    names = scratch.keep(related_names(sentences, registry, scratch))
    slim = sentences.select("row_id", "document_name")
    named = with_groups(slim.where("document_name is not null"), names, "document_name").select("row_id", F.coalesce("group_id", "row_id").alias("group_id"))
    rows = scratch.keep(named.unionByName(slim.where("document_name is null").select("row_id", F.col("row_id").alias("group_id"))))
    groups = rows.groupBy("group_id").agg(F.count("*").alias("n_rows"))
    splits = scratch.keep(proportional_splits(groups, shares, seed).select("group_id", "split", "n_rows"))
    return with_groups(rows, splits, "group_id").select("row_id", "group_id", "split")
