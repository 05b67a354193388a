"""Consensus of several annotators by latent ability and difficulty (problem 2).

An annotator gives an item's true type with the probability that grows with its ability for that type and
falls with the item's difficulty, sigmoid(ability * ease); when it errs, it does so by habit, with a
distribution of its own over the other types. Abilities, habits, the types' frequencies and every item's
ease are learned together by expectation-maximisation, each round one gradient step on the abilities, scaled
by the curvature. Repeated runs of one annotator say much the same, so together they count as one vote, shared
among the types they gave. Annotators and items may be any number; the types are a closed vocabulary.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pyarrow.dataset
import pyarrow.fs
from pyspark.sql import Column, DataFrame, Window, functions as F

from tagweave.plans.runtime import Scratch

ROUNDS, LEAST_CHANGE = 25, 1e-3
#: Numbers in all annotators' parameters up to which they travel with the tasks (32 MB); more stay in a written table,
#: of which each task reads its own annotators.
HELD = 4_000_000
MOST_SEEDS = 8


def plain_type(value: Column) -> Column:
    """Lower case, underscores and white space of any kind as single blanks; null if nothing is left."""
    text = F.lower(F.trim(F.regexp_replace(value, r"[\s _]+", " ")))
    return F.when(F.length(text) > 0, text)


def votes_by_item(items: DataFrame, votes: DataFrame) -> DataFrame:
    """``item_id, annotator, type, weight``: what each annotator's runs said of an item, weights adding up to 1.

    A vote belongs to the item of its document with which it shares most tokens, the smallest of equal ones;
    votes that share none, and null or blank types, are left out. Of a run's repeated deliveries the last one
    with a type counts. The join is by document and token, so a document with many votes is spread out.
    """
    place = items.select("item_id", "document_id", F.explode(F.array_distinct("token_document_indices")).alias("token"))
    given = votes.select("vote_id", "document_id", "config_name", "run_no", "received_at", plain_type(F.col("mention_type")).alias("type"), "token_document_indices")
    given = given.where("type is not null and config_name is not null")
    parts = given.withColumn("token", F.explode(F.array_distinct("token_document_indices"))).drop("token_document_indices")
    shared = parts.join(place, ["document_id", "token"]).groupBy("vote_id", "item_id").agg(
        F.count("*").alias("n"), *(F.first(c).alias(c) for c in ("config_name", "run_no", "received_at", "type")))
    best = shared.groupBy("vote_id").agg(F.max_by(F.struct("item_id", "config_name", "run_no", "received_at", "type"), F.struct("n", -F.col("item_id"))).alias("v")).select("vote_id", "v.*")
    once = best.groupBy("item_id", "config_name", "run_no").agg(F.max_by("type", F.struct("received_at", "vote_id")).alias("type"))
    each = once.groupBy("item_id", "config_name", "type").agg(F.count("*").alias("n"))
    own = Window.partitionBy("item_id", "config_name")
    return each.select("item_id", F.col("config_name").alias("annotator"), "type", (F.col("n") / F.sum("n").over(own)).alias("weight"))


class Parameters:
    """Abilities and habits of some annotators, by their sorted numbers."""

    def __init__(self, ids: np.ndarray, n_types: int):
        k = n_types
        self.ids = ids
        self.ability = np.full((len(ids), k), 1.2)
        self.habit = np.broadcast_to(np.full((k, k), 1 / max(1, k - 1)) * (1 - np.eye(k)), (len(ids), k, k))  # [annotator, truth, said]

    def of(self, ids: np.ndarray) -> Parameters:
        at = np.searchsorted(self.ids, ids)
        out = Parameters(ids, 0)
        out.ability, out.habit = self.ability[at], self.habit[at]
        return out


class Stored:
    """Parameters in a written table; before the first round there is none."""

    def __init__(self, uri: str | None, n_types: int):
        self.uri, self.n_types = uri, n_types

    def of(self, ids: np.ndarray) -> Parameters:
        out, k = Parameters(ids, self.n_types), self.n_types
        if self.uri is not None and len(ids):
            fs, path = pyarrow.fs.FileSystem.from_uri(self.uri)
            own = pyarrow.dataset.dataset(path, filesystem=fs, format="parquet").to_table(columns=["who", "ability", "habit"], filter=pyarrow.dataset.field("who").isin(pa.array(ids)))
            at = np.searchsorted(ids, own.column("who").to_numpy())
            out.habit = out.habit.copy()
            out.ability[at] = own.column("ability").combine_chunks().flatten().to_numpy().reshape(-1, k)
            out.habit[at] = own.column("habit").combine_chunks().flatten().to_numpy().reshape(-1, k, k)
        return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def posterior(p: Parameters, frequency: np.ndarray, item: np.ndarray, who: np.ndarray, said: np.ndarray, weight: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distribution over types, and ease, of ``n`` items from votes sorted by item; ``who`` are places among ``p``'s annotators."""
    k = len(frequency)
    log_ease = np.zeros(n)
    chosen = np.eye(k, dtype=bool)[said]
    ability = p.ability[who]
    with np.errstate(divide="ignore"):
        wrong = np.log(np.maximum(np.where(chosen, 1.0, p.habit[who, :, said]), 1e-9))
    truth = np.zeros((n, k))
    for _ in range(4):
        ease = np.exp(log_ease)
        s = np.clip(_sigmoid(ability * ease[item][:, None]), 1e-6, 1 - 1e-6)
        log = np.where(chosen, np.log(s), np.log(1 - s) + wrong) * weight[:, None]
        total = np.stack([np.bincount(item, log[:, t], n) for t in range(k)], 1) + np.log(frequency)
        truth = np.exp(total - total.max(1, keepdims=True))
        truth /= truth.sum(1, keepdims=True)
        slope = np.bincount(item, weight * (truth[item] * (chosen - s) * ability).sum(1) * ease[item], n) - 2.0 * log_ease  # a prior holds the ease near 1
        log_ease = np.clip(log_ease + 0.3 * slope, -2, 2)
    return truth, np.exp(log_ease)


def _unpack(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    lists = [batch.column(c) for c in ("who", "said", "weight")]
    sizes = np.diff(lists[0].offsets.to_numpy())
    return np.repeat(np.arange(batch.num_rows), sizes), *(x.flatten().to_numpy(zero_copy_only=False) for x in lists)


_SLOPE, _CURVE, _SAID, _FREQUENCY = range(4)
_SUMS = "who long, kind int, at long, value double"


def _statistics(source: Parameters | Stored, frequency: np.ndarray):
    """Items with their votes -> sums for each annotator's parameters, and for the types' frequencies."""
    k = len(frequency)

    def rows(ids: np.ndarray, kind: int, x: np.ndarray) -> pa.RecordBatch:
        flat = x.reshape(len(ids), -1)
        own, at = np.nonzero(flat)
        return pa.RecordBatch.from_arrays([pa.array(ids[own]), pa.array(np.full(len(at), kind, np.int32)), pa.array(at), pa.array(flat[own, at])], ["who", "kind", "at", "value"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = isinstance(source, Parameters)  # then a task's sums are few enough to be held
        held = [np.zeros((len(source.ids), *x)) for x in ((k,), (k,), (k, k))] if whole else None
        types = np.zeros(k)
        for batch in batches:
            item, who, said, weight = _unpack(batch)
            if not len(item):
                continue
            ids, own = np.unique(who, return_inverse=True)
            p = source.of(ids)
            truth, ease = posterior(p, frequency, item, own, said, weight, batch.num_rows)
            s = _sigmoid(p.ability[own] * ease[item][:, None])
            t = truth[item] * weight[:, None]
            sums = held or [np.zeros((len(ids), *x)) for x in ((k,), (k,), (k, k))]
            at = np.searchsorted(source.ids, ids)[own] if whole else own
            np.add.at(sums[_SLOPE], at, t * (np.eye(k)[said] - s) * ease[item][:, None])
            np.add.at(sums[_CURVE], at, t * s * (1 - s) * ease[item][:, None] ** 2)
            np.add.at(sums[_SAID], (at, slice(None), said), t)
            types += truth[np.unique(item)].sum(0)
            if not whole:
                yield from (rows(ids, kind, x) for kind, x in enumerate(sums))
        if whole:
            yield from (rows(source.ids, kind, x) for kind, x in enumerate(held))
        yield rows(np.array([-1]), _FREQUENCY, types[None])

    return run


def maximised(ability: np.ndarray, slope: np.ndarray, curve: np.ndarray, said: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """New abilities and habits of annotators from their sums."""
    k = ability.shape[1]
    # one gradient step, scaled by the curvature, towards a prior that an annotator's abilities are alike
    mean = ability.mean(1, keepdims=True)
    ability = np.clip(ability + (slope - 0.5 * (ability - mean)) / (curve + 0.5), -3, 6)
    seen = said * (1 - np.eye(k))
    overall = seen.sum(1, keepdims=True)  # an annotator's habit whatever the truth
    start = (overall + 0.2) / (overall + 0.2).sum(2, keepdims=True)
    habit = (seen + 1.5 * start) * (1 - np.eye(k))
    return ability, habit / np.maximum(habit.sum(2, keepdims=True), 1e-12)


def _dense(kind: np.ndarray, at: np.ndarray, value: np.ndarray, who: np.ndarray, n: int, k: int) -> list[np.ndarray]:
    out = [np.zeros((n, *x)) for x in ((k,), (k,), (k, k))]
    for j, x in enumerate(out):
        own = kind == j
        x.reshape(n, -1)[who[own], at[own]] = value[own]
    return out


def _annotators(source: Stored, k: int):
    """Annotators with their sums -> their new parameters, and by how much the abilities changed."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(i, 1000) for i in range(0, whole.num_rows, 1000)):
                sums = batch.column("sums")
                kind, at, value = (pa.compute.struct_field(sums.flatten(), [i]).to_numpy(zero_copy_only=False) for i in range(3))
                own = np.repeat(np.arange(batch.num_rows), pa.compute.list_value_length(sums).to_numpy(zero_copy_only=False))
                ids = batch.column("who").to_numpy(zero_copy_only=False)
                order = np.argsort(ids)
                before = source.of(ids[order]).ability[np.argsort(order)]
                ability, habit = maximised(before, *_dense(kind, at, value, own, batch.num_rows, k))
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * x[0].size), pa.array(x.ravel())) for x in (ability, habit)] if batch.num_rows else [pa.array([], pa.list_(pa.float64()))] * 2
                yield pa.RecordBatch.from_arrays([pa.array(ids), *lists, pa.array(np.abs(ability - before).max(1))], ["who", "ability", "habit", "change"])

    return run


def learn(packed: DataFrame, ids: np.ndarray | None, n_types: int, scratch: Scratch) -> tuple[Parameters | Stored, np.ndarray, DataFrame | None]:
    """Expectation-maximisation over all items: parameters, the types' frequencies, and the table that stores the former.

    With ``ids``, all annotators, the parameters are held here and each round's sums for them come back; without,
    they stay in a table that each round writes anew. Both ways compute the same.
    """
    k, table = n_types, None
    source = Parameters(ids, k) if ids is not None else Stored(None, k)
    frequency = np.full(k, 1 / k)
    for _ in range(ROUNDS):
        sums = packed.mapInArrow(_statistics(source, frequency), _SUMS).groupBy("who", "kind", "at").agg(F.sum("value").alias("value"))
        if ids is not None:
            got = sums.toArrow()  # HELD rows at most, and a row a type
            who, kind, at, value = (got.column(c).to_numpy() for c in ("who", "kind", "at", "value"))
            common = kind == _FREQUENCY
            ability, habit = maximised(source.ability, *_dense(kind[~common], at[~common], value[~common], np.searchsorted(ids, who[~common]), len(ids), k))
            change = np.abs(ability - source.ability).max(initial=0.0)
            source.ability, source.habit = ability, habit
            counted = dict(zip(at[common].tolist(), value[common].tolist()))
        else:
            sums = scratch.keep(sums)
            own = sums.where(F.col("kind") < _FREQUENCY).groupBy("who").agg(F.collect_list(F.struct("kind", "at", "value")).alias("sums"))
            new = scratch.keep(own.mapInArrow(_annotators(source, k), "who long, ability array<double>, habit array<double>, change double"))
            change = new.agg(F.max("change")).first()[0] or 0.0
            counted = {r["at"]: r["value"] for r in sums.where(F.col("kind") == _FREQUENCY).collect()}  # a row a type
            for spent in (sums, table):
                if spent is not None:
                    scratch.drop(spent)
            table, source = new, Stored(scratch.path(new), k)
        frequency = np.array([counted.get(t, 0.0) for t in range(k)]) + 1
        frequency /= frequency.sum()
        if change < LEAST_CHANGE:
            break
    return source, frequency, table


class Consensus:
    """The learned model over one table of votes."""

    def __init__(self, items: DataFrame, votes: DataFrame, scratch: Scratch):
        self.items, self.spark = items, items.sparkSession
        self.votes = scratch.keep(votes_by_item(items, votes))
        self.types = sorted(r[0] for r in self.votes.select("type").distinct().collect())  # a closed vocabulary
        self.source = None
        if not self.types:
            return
        names = scratch.keep(self.votes.select("annotator").distinct())
        n = names.count()
        seed = next((s for s in range(MOST_SEEDS) if names.select(self._number(s)).distinct().count() == n), None)
        if seed is None:
            raise RuntimeError("no seed tells all annotators apart")
        self.who, k = self._number(seed), len(self.types)
        said = (F.array_position(F.array(*map(F.lit, self.types)), F.col("type")) - 1).cast("int")
        grouped = self.votes.groupBy("item_id").agg(F.collect_list(F.struct(self.who.alias("who"), said.alias("said"), "weight")).alias("v"))
        self.packed = scratch.keep(grouped.select("item_id", F.col("v.who").alias("who"), F.col("v.said").alias("said"), F.col("v.weight").alias("weight")))
        ids = np.sort(names.select(self.who.alias("who")).toArrow().column("who").to_numpy()) if n * k * (k + 2) <= HELD else None
        self.source, self.frequency, self.table = learn(self.packed, ids, k, scratch)

    @staticmethod
    def _number(seed: int) -> Column:
        return F.xxhash64(F.lit(seed), "annotator")

    def labels(self) -> DataFrame:
        """``item_id, mention_type, confidence, agreement`` of every item.

        ``agreement`` is the share of vote pairs of different annotators that agree, corrected for chance by
        the types' overall shares; null with fewer than two annotators. An item without votes gets the most
        frequent type at its frequency, and null types if there are no votes at all.
        """
        if self.source is None:
            return self.items.select("item_id", F.lit(None).cast("string").alias("mention_type"), F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("double").alias("agreement"))
        source, frequency, types = self.source, self.frequency, self.types
        shares = [r["w"] for r in self.votes.groupBy("type").agg(F.sum("weight").alias("w")).collect()]
        chance = sum((w / sum(shares)) ** 2 for w in shares)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                item, who, said, weight = _unpack(batch)
                ids, own = np.unique(who, return_inverse=True)
                truth, _ = posterior(source.of(ids), frequency, item, own, said, weight, batch.num_rows)
                best = truth.argmax(1)
                k = len(types)
                total = np.bincount(item * k + said, weight, batch.num_rows * k).reshape(-1, k)
                pairs = np.unique(item * max(1, len(ids)) + own)
                n = np.bincount(pairs // max(1, len(ids)), minlength=batch.num_rows)
                same = np.bincount(item, weight**2, batch.num_rows)  # pairs within an annotator don't count
                with np.errstate(divide="ignore", invalid="ignore"):
                    observed = ((total**2).sum(1) - same) / (n * n - n)
                    agreement = np.where(n > 1, (observed - chance) / max(1e-12, 1 - chance), np.nan)
                yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array(types).take(pa.array(best)), pa.array(truth.max(1)), pa.array(agreement, from_pandas=True)], ["item_id", "mention_type", "confidence", "agreement"])

        found = self.packed.mapInArrow(run, "item_id long, mention_type string, confidence double, agreement double")
        top = int(frequency.argmax())
        return self.items.select("item_id").join(found, "item_id", "left").select(
            "item_id", F.coalesce("mention_type", F.lit(types[top])).alias("mention_type"), F.coalesce("confidence", F.lit(float(frequency[top]))).alias("confidence"), "agreement")

    def reliability(self) -> DataFrame:
        """``config_name, n_items, accuracy, kappa, mean_ability`` of every annotator that voted, against the consensus."""
        if self.source is None:
            return self.spark.createDataFrame([], "config_name string, n_items long, accuracy double, kappa double, mean_ability double")
        truth = self.labels().select("item_id", "mention_type")
        cells = self.votes.join(truth, "item_id").groupBy("annotator", "mention_type", "type").agg(F.sum("weight").alias("w"))
        sides = cells.select("annotator", "w", F.explode(F.array(F.struct(F.col("mention_type").alias("type"), F.lit(True).alias("true")), F.struct("type", F.lit(False).alias("true")))).alias("s"))
        margins = sides.groupBy("annotator", "s.type").agg(F.sum(F.when(F.col("s.true"), F.col("w")).otherwise(0)).alias("a"), F.sum(F.when(~F.col("s.true"), F.col("w")).otherwise(0)).alias("b"))
        chance = margins.groupBy("annotator").agg((F.sum(F.col("a") * F.col("b")) / F.sum("a") / F.sum("b")).alias("chance"))
        right = cells.groupBy("annotator").agg((F.sum(F.when(F.col("mention_type") == F.col("type"), F.col("w")).otherwise(0.0)) / F.sum("w")).alias("accuracy"))
        counted = self.votes.groupBy("annotator").agg(F.count_distinct("item_id").alias("n_items"))
        if self.table is None:
            means = self.spark.createDataFrame(pa.table({"who": self.source.ids, "mean_ability": self.source.ability.mean(1)}))
        else:
            means = self.table.select("who", (F.aggregate("ability", F.lit(0.0), lambda a, x: a + x) / F.size("ability")).alias("mean_ability"))
        kappa = (F.col("accuracy") - F.col("chance")) / F.greatest(F.lit(1e-12), 1 - F.col("chance"))
        joined = counted.join(right, "annotator").join(chance, "annotator").withColumn("who", self.who).join(means, "who")
        return joined.select(F.col("annotator").alias("config_name"), "n_items", "accuracy", kappa.alias("kappa"), "mean_ability")
