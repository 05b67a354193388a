"""Scoring and choosing words to be labelled next."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tagweave.functions.text import bound

#: Rows chosen that may be held on the driver.
FEW = 10_000
#: Multiplier and modulus of the draw that both this engine and SQL can compute.
_STEP, _HALF = 2654435761, 1 << 31


def softmax(x: Column) -> Column:
    shifted = bound(F.array_max(x).cast("double"), lambda m: F.transform(x, lambda v: F.exp(v.cast("double") - m)))
    total = lambda e: F.struct(e.alias("e"), F.aggregate(e, F.lit(0.0), lambda a, w: a + w).alias("sum"))
    return bound(bound(shifted, total), lambda s: F.transform(s["e"], lambda v: v / s["sum"]))


def entropy(p: Column) -> Column:
    """Entropy as a share of its largest value."""
    return -F.aggregate(p, F.lit(0.0), lambda a, x: a + x * F.ln(F.greatest(x, F.lit(1e-12)))) / F.ln(F.size(p).cast("double"))


def least_confidence(p: Column) -> Column:
    return 1 - F.array_max(p)


def margin(p: Column) -> Column:
    ordered = F.sort_array(p, asc=False)
    return 1 - (F.get(ordered, 0) - F.get(ordered, 1))


METRICS = {"entropy": entropy, "least_confidence": least_confidence, "margin": margin}


def uniform(seed: int, key: Column) -> Column:
    """A number within (0, 1) for each whole-number key, the same on any partitioning."""
    first = F.pmod(F.pmod(key.cast("long") + F.lit(seed), F.lit(_HALF)) * F.lit(_STEP), F.lit(2 * _HALF))
    return (F.pmod(F.pmod(first, F.lit(_HALF)) * F.lit(1103515245) + F.lit(12345), F.lit(_HALF)) + 0.5) / F.lit(float(_HALF))


def gumbel_score(score: Column, draw: Column, beta: float = 1.0) -> Column:
    """Logarithm of the score plus Gumbel noise; a score of 0 comes last."""
    low = F.lit(float("-inf"))
    return F.when(score > 0, F.lit(beta) * F.ln(F.when(score > 0, score)) - F.ln(-F.ln(draw))).otherwise(low)


def top(candidates: DataFrame, k: int, score: str, keys: Sequence[str], within: Sequence[str] = (), cap: int | None = None, form: str | None = None) -> DataFrame:
    """The ``k`` best of each group with their rank; equal scores by key.

    With a cap, at most so many of each lower-cased form, and if that leaves fewer than ``k``, the best of
    those passed over. Without groups this is a top-k without a full sort.
    """
    order = [F.desc(score), *keys]
    if cap is None and not within:
        best = candidates.orderBy(*order).limit(k)
        return best.withColumn("rank", F.row_number().over(Window.orderBy(*order)))  # k rows
    if cap is not None:
        # rank <= cap is cut to its best rows before the shuffle, so a form that much of the table has costs no more
        form_rank = F.row_number().over(Window.partitionBy(*within, F.lower(form)).orderBy(*order))
        if not within:
            allowed = candidates.withColumn("_r", form_rank).where(F.col("_r") <= cap).drop("_r").orderBy(*order).limit(k).withColumn("_over", F.lit(0))
            if k <= FEW:
                allowed = candidates.sparkSession.createDataFrame(allowed.toArrow(), allowed.schema)  # chosen once, not once more for its number
            missing = k - allowed.count()
            if missing > 0:  # every row within the cap is chosen: what is left was passed over
                rest = candidates.join(allowed.select(*keys), list(keys), "left_anti").orderBy(*order).limit(missing).withColumn("_over", F.lit(1))
                allowed = allowed.unionByName(rest)
            return allowed.withColumn("rank", F.row_number().over(Window.orderBy("_over", *order))).drop("_over")  # k rows
        candidates = candidates.withColumn("_over", (form_rank > cap).cast("int"))
        order = ["_over", *order]
    return candidates.withColumn("rank", F.row_number().over(Window.partitionBy(*within).orderBy(*order))).where(F.col("rank") <= k).drop("_over")


def random_choice(candidates: DataFrame, k: int, seed: int, key: Column, keys: Sequence[str]) -> DataFrame:
    """``k`` rows drawn without replacement: those of the smallest draws."""
    return candidates.withColumn("draw", uniform(seed, key)).orderBy("draw", *keys).limit(k)


def replay(items: DataFrame, k: int, share: float, seed: int, key: Column, keys: Sequence[str]) -> DataFrame:
    """As many old items as round half-even of ``k * share``, or all."""
    return random_choice(items, round(k * share), seed, key, keys)


def schedule(n: Column, k: int, percent: float) -> Column:
    """``(round, size, acquired)`` of each round: ``k`` items, the last round what is left of the budget."""
    budget = (n * F.lit(percent) / 100).cast("int")
    rounds = F.floor((budget + F.lit(k - 1)) / F.lit(k)).cast("int")
    return F.when(rounds > 0, F.transform(F.sequence(F.lit(1), F.greatest(rounds, F.lit(1))), lambda r: F.struct(
        r.alias("round"), F.least(F.lit(k), budget - (r - 1) * k).alias("size"), F.least(r * k, budget).alias("acquired"))))


def remaining(candidates: DataFrame, acquired: DataFrame, keys: Sequence[str]) -> DataFrame:
    return candidates.join(acquired.select(*keys).distinct(), list(keys), "left_anti")


def reveal(selected: DataFrame, labels: DataFrame, sentences: DataFrame, sentence: Sequence[str]) -> DataFrame:
    """Labels and sentence tokens of the selected words only.

    ``labels`` hold the tags ``gold`` of a sentence as an array: a row a sentence is moved, not one a word.
    """
    sized = labels.withColumn("_n", F.size("gold"))
    found = selected.join(sized, list(sentence)).where("wid >= 0 and wid < _n").drop("_n")
    return found.withColumn("gold", F.get("gold", F.col("wid").cast("int"))).join(sentences, list(sentence))


def prefix(ordered: DataFrame, order: str, percent: float) -> DataFrame:
    """The first rows, round half-even of a percentage; none left is an error."""
    n = ordered.count()
    most = round(n * percent / 100)
    if n and not most:
        raise ValueError("no row is left")
    return ordered.where(F.col(order) < most)


def _first_drawn(drawn: DataFrame, n: int, keys: Sequence[str], bins: int = 4096) -> Column:
    """Condition for the ``n`` rows of the smallest draws. Counts by bin find the bin in which the last one lies;
    only that bin, a small share of the rows, is ordered."""
    place = F.floor(F.col("draw") * bins).cast("int")
    counts = {r["b"]: r["n"] for r in drawn.groupBy(place.alias("b")).agg(F.count("*").alias("n")).collect()}
    passed = 0
    for b in range(bins):
        if passed + counts.get(b, 0) >= n:
            break
        passed += counts.get(b, 0)
    if n - passed <= 0:
        return place < b
    last = drawn.where(place == b).orderBy("draw", *keys).limit(n - passed).agg(F.max(F.struct("draw", *keys)).alias("x")).first()["x"]
    return (place < b) | ((place == b) & (F.struct("draw", *keys) <= F.struct(*(F.lit(v).cast(drawn.schema[c].dataType).alias(c) for c, v in zip(("draw", *keys), last)))))


def first_rows(rows: DataFrame, n: int, order: Sequence[str], bins: int = 4096) -> Column:
    """Condition for the ``n`` first rows by ``order``, which no two rows share.

    Counts by bin of a numeric column tell in which bin the last one lies; that bin is cut into bins again, by the next
    column where all its values are one, until it has few rows. Only those are ordered.
    """
    within, need, m = rows, n, None
    for c in order:
        if m is not None and m <= FEW or not isinstance(rows.schema[c].dataType, T.NumericType):
            break
        about = (F.count("*").alias("m"), F.count(c).alias("there"), F.min(c).cast("double").alias("low"), F.max(c).cast("double").alias("high"))
        x = within.agg(*about).first()
        while True:
            m = x["m"]
            if m <= need and within is rows:
                return F.lit(True)
            width = (x["high"] - x["low"]) / bins if x["there"] else 0.0
            if m <= FEW or x["there"] in (0, m) and not 0 < width < math.inf:
                break
            inner = F.least(F.floor((F.col(c).cast("double") - x["low"]) / width), F.lit(bins - 1)) if 0 < width < math.inf else F.lit(0)
            place = F.when(F.col(c).isNull(), -1).otherwise(inner.cast("int"))  # nulls come first
            for x in sorted(within.groupBy(place.alias("b")).agg(*about).collect(), key=lambda r: r["b"]):
                if need <= x["m"]:
                    break
                need -= x["m"]
            within = within.where(place == x["b"])
    last = within.orderBy(*order).limit(need).agg(F.max(F.struct(*order)).alias("x")).first()["x"]
    if last is None:
        return F.lit(False)
    return F.struct(*order) <= F.struct(*(F.lit(v).cast(rows.schema[c].dataType).alias(c) for c, v in zip(order, last)))


def split_rows(rows: DataFrame, key: Column, keys: Sequence[str], test_share: float, bootstrap: int, seed: int = 0) -> DataFrame:
    """``part`` of each row: 'test' for the share of the smallest draws, rounded up, then ``bootstrap`` rows, then 'pool'."""
    n = rows.count()
    n_test = math.ceil(n * test_share)
    drawn = rows.withColumn("draw", uniform(seed, key))
    if not n:
        return drawn.withColumn("part", F.lit("pool")).drop("draw")
    test, early = _first_drawn(drawn, n_test, keys), _first_drawn(drawn, min(n, n_test + bootstrap), keys)
    return drawn.withColumn("part", F.when(test, "test").when(early, "bootstrap").otherwise("pool")).drop("draw")
