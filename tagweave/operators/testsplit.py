"""Predicted documents on test sentences, scores of saved runs, and splits with their checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tagweave.functions import spans
from tagweave.operators import annotation, evaluation, quality, selection
from tagweave.plans.order import numbered
from tagweave.plans.runtime import Scratch


def sentence_name(document: Column, sentence: Column) -> Column:
    """``name#id`` of a sentence that is a document of its own."""
    return F.concat(document, F.lit("#"), sentence.cast("string"))


def sentence_documents(test: DataFrame) -> DataFrame:
    """A document of one sentence, without mentions, for each test row ``(document_name, sentence_id, tokens)``."""
    own = sentence_name(F.col("document_name"), F.col("sentence_id"))
    tokens = F.transform("tokens", lambda t, i: F.struct(t.alias("text"), i.cast("int").alias("index"), F.lit(0).alias("sentence_index")))
    return test.select(own.alias("id"), own.alias("name"), F.array_join("tokens", " ").alias("text"), tokens.alias("tokens"), F.array().cast("array<struct<type:string,tokens:array<int>>>").alias("mentions"))


def document_sentences(documents: DataFrame) -> DataFrame:
    """``id, sentence, tokens, spans`` of every sentence of ``documents(id, tokens, mentions)``.

    A sentence is a run of tokens of one index; a mention belongs to the sentence of its first token, and its span
    ``(type, first, last)`` counts from there. Spans keep the mentions' order.
    """
    placed = documents.select("id", F.posexplode("tokens").alias("i", "t")).select("id", "i", F.coalesce("t.text", F.lit("")).alias("text"), F.col("t.sentence_index").alias("index"))
    tokens = annotation.sentence_groups(placed, ["id"], "i", "index").withColumnRenamed("sentence_group", "sentence")
    sentences = tokens.groupBy("id", "sentence").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "text"))), lambda x: x["text"]).alias("tokens"), F.min("i").alias("start"))
    found = documents.select("id", F.posexplode("mentions").alias("no", "m")).select("id", "no", "m.type", F.array_min("m.tokens").alias("i"), F.array_max("m.tokens").alias("last")).where("i is not null")
    at = found.join(tokens.select("id", "i", "sentence"), ["id", "i"]).groupBy("id", "sentence").agg(F.array_sort(F.collect_list(F.struct("no", "type", F.col("i").alias("first"), "last"))).alias("m"))
    joined = sentences.join(at, ["id", "sentence"], "left")
    moved = F.transform(F.coalesce("m", F.array().cast("array<struct<no:int,type:string,first:int,last:int>>")), lambda m: F.struct(m["type"].alias("type"), (m["first"] - F.col("start")).alias("first"), (m["last"] - F.col("start")).alias("last")))
    return joined.select("id", "sentence", "tokens", moved.alias("spans"))


def on_test_sentences(test: DataFrame, documents: DataFrame, types: Sequence[str] = ()) -> DataFrame:
    """``test`` with ``tags`` from predicted documents and the number of mentions ``dropped`` for overlapping an earlier one.

    A sentence that was predicted on its own (``name#id``) comes before its whole document; one that neither covers has
    null tags. Types get the spelling of ``types`` where they have one. An error if a sentence's tokens differ.
    """
    found = document_sentences(documents)
    own = found.where("sentence = 0").select(F.col("id").alias("_own"), F.col("tokens").alias("_t1"), F.col("spans").alias("_s1"))
    whole = found.select(F.col("id").alias("document_name"), F.col("sentence").cast("int").alias("sentence_id"), F.col("tokens").alias("_t2"), F.col("spans").alias("_s2"))
    joined = test.withColumn("_own", sentence_name(F.col("document_name"), F.col("sentence_id"))).join(own, "_own", "left").join(whole, ["document_name", "sentence_id"], "left")
    theirs = F.coalesce("_t1", "_t2")
    same = theirs.eqNullSafe(F.transform("tokens", lambda t: F.coalesce(t, F.lit(""))))
    checked = F.when(theirs.isNull() | same, F.when(F.col("_t1").isNotNull(), F.col("_s1")).otherwise(F.col("_s2"))).otherwise(
        F.raise_error(F.concat(F.lit("tokens differ in "), F.col("_own"))).cast(spans.SPAN))
    if types:
        names = F.create_map(*(F.lit(x) for t in types for x in (t.lower(), t)))
        spelt = F.transform(checked, lambda s: F.struct(F.coalesce(F.try_element_at(names, F.lower(s["type"])), s["type"]).alias("type"), s["first"].alias("first"), s["last"].alias("last")))
    else:
        spelt = checked
    out = joined.withColumn("_s", spelt)
    out = out.withColumn("tags", F.when(F.col("_s").isNotNull(), spans.tags_of(F.coalesce("_s", F.array().cast(spans.SPAN)), F.size("tokens"))))
    begun = F.size(F.filter("tags", lambda t: t.startswith("B-")))
    return out.withColumn("dropped", F.when(F.col("tags").isNotNull(), F.size("_s") - begun)).drop("_own", "_t1", "_s1", "_t2", "_s2", "_s")


def covers(predicted: DataFrame) -> bool:
    """Whether every test sentence has tags."""
    return predicted.where("tags is null").isEmpty()


def known_documents(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """``id, gold, predicted`` mentions of every predicted document; one that the gold data lack is an error."""
    both = predicted.select("id", F.col("mentions").alias("predicted")).join(gold.select("id", F.col("mentions").alias("gold"), F.lit(True).alias("_known")), "id", "left")
    known = F.when(F.col("_known"), True).otherwise(F.raise_error(F.concat(F.lit("no gold document "), F.col("id"))).cast("boolean"))
    return both.where(known).select("id", "gold", "predicted")


def document_scores(gold: DataFrame, predicted: DataFrame, exact: bool = False) -> DataFrame:
    """One row: macro and micro scores of the predicted documents' mentions."""
    counts = evaluation.mention_counts(known_documents(gold, predicted), ["id"], predicted="predicted", exact=exact).withColumn("_all", F.lit(1))
    return evaluation.mention_summary(counts, ["_all"], "id").drop("_all")


def rescored(saved: DataFrame, run: Sequence[str]) -> DataFrame:
    """Scores of saved runs anew: ``saved`` holds ``gold`` and ``predicted``, arrays of the sentences' tags, a row a run."""
    sentences = saved.select(*run, F.explode(F.arrays_zip("gold", "predicted")).alias("s")).select(*run, F.col("s.gold").alias("gold"), F.col("s.predicted").alias("pred"))
    return evaluation.evaluation(sentences, run)


def entity_types(mentions: DataFrame, entity: Sequence[str]) -> DataFrame:
    """The type of each entity's mentions, and whether they are of several (then the first in the alphabet counts)."""
    return mentions.groupBy(*entity).agg(F.min("type").alias("type"), (F.count_distinct("type") > 1).alias("mixed"))


def holdout(pool: DataFrame, n: int, key: Column, order: Sequence[str], seed: int, scratch: Scratch) -> DataFrame:
    """``pool`` with ``held_out``, true for the ``n`` rows of the smallest draws, and ``place`` among the rows of its side.

    An error if that leaves nothing to learn from. What is held out depends on the draws alone, never on labels.
    """
    total = pool.count()
    if not 0 < n < total:
        raise ValueError("a holdout must leave rows on both sides")
    drawn = pool.withColumn("draw", selection.uniform(seed, key))
    sides = drawn.withColumn("held_out", selection._first_drawn(drawn, n, order)).drop("draw")
    return numbered(sides, ["held_out"], order, "place", scratch)


def split_checks(rows: DataFrame, raw: DataFrame, key: Sequence[str], sizes: dict[str, int], pool_labels: DataFrame, word: Sequence[str]) -> DataFrame:
    """Checks of a split: ``rows(key, part, tokens, tags)``, with null tags in the pool, against the raw rows ``raw(key, tokens, tags)``.

    Sizes of the parts; keys that are in several parts, in one only or in ``raw`` only; pool rows with tags; pool words
    without a label; and rows whose tokens, or tags where they have any, aren't the raw ones.
    """
    checks = [quality.check(rows.where(F.col("part") == p), f"{p} rows", F.count("*"), n) for p, n in sizes.items()]
    parts = rows.groupBy(*key).agg(F.count("*").alias("_n"))
    checks.append(quality.check(parts, "keys in several parts", F.count_if(F.col("_n") > 1)))
    other = raw.select(*key, F.col("tokens").alias("_tokens"), F.col("tags").alias("_tags"), F.lit(1).alias("_raw"))
    both = rows.select(*key, "part", "tokens", "tags", F.lit(1).alias("_row")).join(other, list(key), "full")
    checks.append(quality.check(both, "keys on one side only", F.count_if(F.col("_row").isNull() | F.col("_raw").isNull())))
    checks.append(quality.check(rows.where("part = 'pool'"), "pool rows with tags", F.count_if(F.col("tags").isNotNull())))
    words = rows.where("part = 'pool'").select(*key, F.posexplode("tokens").alias("wid", "_w")).join(pool_labels.select(*word, F.lit(1).alias("_l")), list(word), "left")
    checks.append(quality.check(words, "pool words without a label", F.count_if(F.col("_l").isNull())))
    differs = ~F.col("tokens").eqNullSafe(F.col("_tokens")) | F.col("tags").isNotNull() & ~F.col("tags").eqNullSafe(F.col("_tags"))
    checks.append(quality.check(both.where("_row = 1 and _raw = 1"), "rows that differ from the raw ones", F.count_if(differs)))
    return quality.all_checks(checks)


def apart_and_whole(parts: Sequence[DataFrame], whole: DataFrame, key: Sequence[str]) -> DataFrame:
    """One row: ``shared``, keys that several tables have, ``missing`` and ``extra`` against ``whole``."""
    marked = [p.select(*key).distinct().withColumns({"_part": F.lit(1), "_whole": F.lit(0)}) for p in parts]
    every = whole.select(*key).distinct().withColumns({"_part": F.lit(0), "_whole": F.lit(1)})
    for p in marked:
        every = every.unionByName(p)
    counts = every.groupBy(*key).agg(F.sum("_part").alias("_p"), F.sum("_whole").alias("_w"))
    return counts.agg(F.count_if(F.col("_p") > 1).alias("shared"), F.count_if(F.col("_p") == 0).alias("missing"), F.count_if(F.col("_w") == 0).alias("extra"))


def training_items(sentences: DataFrame, words: DataFrame, key: Sequence[str]) -> DataFrame:
    """What a model is trained on: whole labelled sentences, and single revealed words in their sentence, as ``key, tokens,
    targets``, a map of places to tags. ``words(key, wid, gold)`` are the revealed ones; ``sentences`` hold null tags where
    the sentence isn't labelled."""
    full = sentences.where("tags is not null").select(*key, "tokens", F.map_from_entries(F.transform("tags", lambda t, i: F.struct(i.cast("int").alias("key"), t.alias("value")))).alias("targets"))
    single = words.join(sentences.select(*key, "tokens"), list(key)).select(*key, "tokens", F.create_map(F.col("wid").cast("int"), "gold").alias("targets"))
    return full.unionByName(single)


def scoreable_words(pieces: DataFrame, key: Sequence[str]) -> DataFrame:
    """Words all of whose pieces survive truncation, with the place of the first: from ``pieces(key, wid, position, kept)``."""
    return pieces.groupBy(*key, "wid").agg(F.bool_and("kept").alias("_whole"), F.min("position").alias("position")).where("_whole").drop("_whole")


def best_by(rows: DataFrame, by: Sequence[str], score: str) -> DataFrame:
    """The whole row of the best score of each group."""
    rest = [c for c in rows.columns if c not in by]
    return rows.groupBy(*by).agg(F.max_by(F.struct(*rest), score).alias("_b")).select(*by, "_b.*")
