"""Learning curves: areas, gaps between arms, crossings, label efficiency and headroom.

A curve is the rows of one run in round order, ``x`` its share of labels and ``y`` its score. Run keys are
columns, so one plan handles all runs; each operator is one aggregation over them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

RANDOM, UNCERTAINTY = "random", "uncertainty"


def complete(curves: DataFrame, keys: Sequence[str], field: str) -> DataFrame:
    """Rows of the groups in which ``field`` is never null."""
    return curves.withColumn("_missing", F.max(F.col(field).isNull().cast("int")).over(Window.partitionBy(*keys))).where("_missing = 0").drop("_missing")


def arm_scores(curves: DataFrame, keys: Sequence[str], x: str, y: str, order: str = "round", strict: bool = True) -> DataFrame:
    """``auc``, the area under each curve over the span of its x, and ``final``, the last y.

    Curves of one row, or whose x doesn't rise with the order, raise an error, or have a null area if not ``strict``.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    steps = curves.withColumns({"_dx": F.col(x) - F.lag(x).over(w), "_ym": (F.col(y) + F.lag(y).over(w)) / 2})
    out = steps.groupBy(*keys).agg(
        F.sum(F.col("_dx") * F.col("_ym")).alias("_area"), (F.max(x) - F.min(x)).alias("_span"), F.min("_dx").alias("_least"),
        F.count("*").alias("_n"), F.max_by(y, order).alias("final"))
    good = (F.col("_n") > 1) & (F.col("_least") > 0)
    bad = F.raise_error(F.lit("x must rise strictly over two rounds at least")).cast("double") if strict else F.lit(None).cast("double")
    return out.withColumn("auc", F.when(good, F.col("_area") / F.col("_span")).otherwise(bad)).select(*keys, "auc", "final")


def paired(scores: DataFrame, keys: Sequence[str], values: Sequence[str], arm: str = "arm") -> DataFrame:
    """One row per key with each value of both arms and ``gap_`` of it; keys without both arms are left out.

    Null keys pair with null keys, as grouping takes them to be equal.
    """
    def of(v, a):
        return F.max(F.when(F.col(arm) == a, F.col(v)))

    both = F.count_distinct(F.when(F.col(arm).isin(RANDOM, UNCERTAINTY), F.col(arm)))
    out = scores.groupBy(*keys).agg(both.alias("_arms"), *(of(v, a).alias(f"{a}_{v}") for v in values for a in (UNCERTAINTY, RANDOM))).where("_arms = 2")
    return out.drop("_arms").withColumns({f"gap_{v}": F.col(f"{UNCERTAINTY}_{v}") - F.col(f"{RANDOM}_{v}") for v in values})


def seed_scores(curves: DataFrame, keys: Sequence[str], x: str, y: str, seed: str = "seed", strict: bool = True) -> DataFrame:
    """Areas, finals and gaps of both arms for each key and seed, groups with a missing ``y`` left out."""
    return paired(arm_scores(complete(curves, [*keys, seed], y), [*keys, seed, "arm"], x, y, strict=strict), [*keys, seed], ["auc", "final"])


def config_scores(seed_level: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Means of the gaps over seeds."""
    return seed_level.groupBy(*keys).agg(F.avg("gap_auc").alias("gap_auc"), F.avg("gap_final").alias("gap_final"), F.count("*").alias("n_seeds"))


def arm_series(curves: DataFrame, keys: Sequence[str], metric: str = "uq_metric") -> DataFrame:
    """Series of each arm: the random arm once, however many metrics it was copied to; others by metric."""
    first = F.min(metric).over(Window.partitionBy(*keys))
    random = F.col("arm") == RANDOM
    return curves.withColumn("_first", first).where(~random | (F.col(metric) == F.col("_first"))).withColumn("series", F.when(random, F.lit(RANDOM)).otherwise(F.col(metric))).drop("_first")


def mean_curves(series: DataFrame, keys: Sequence[str], x: str, y: str, order: str = "round") -> DataFrame:
    return series.groupBy(*keys, order).agg(F.avg(x).alias(x), F.avg(y).alias(y), F.count("*").alias("n_seeds"))


def final_scores(curves: DataFrame, run: Sequence[str], by: Sequence[str], fields: Sequence[str], order: str = "round") -> DataFrame:
    """Mean and sample deviation over the last rounds of runs; the deviation of one run is null."""
    last = curves.withColumn("_last", F.max(order).over(Window.partitionBy(*run))).where(F.col(order) == F.col("_last"))
    stats = [f(v).alias(f"{v}_{n}") for v in fields for f, n in ((F.avg, "mean"), (F.stddev, "sd"))]
    return last.groupBy(*by).agg(*stats, F.count("*").alias("n_runs"))


def gap_curves(curves: DataFrame, keys: Sequence[str], y: str) -> DataFrame:
    """Both arms side by side at equal keys, and their gap."""
    out = curves.groupBy(*keys).pivot("arm", [UNCERTAINTY, RANDOM]).agg(F.first(y))
    return out.where(F.col(UNCERTAINTY).isNotNull() & F.col(RANDOM).isNotNull()).withColumn("gap", F.col(UNCERTAINTY) - F.col(RANDOM))


def first_reaching(curves: DataFrame, targets: DataFrame, by: Sequence[str], x: str, y: str, on: Sequence[str] = ()) -> DataFrame:
    """``pool``, the least x at which a curve reaches each target; null if it never does. ``targets`` is small by nature."""
    joined = curves.join(targets, list(on)) if on else curves.crossJoin(F.broadcast(targets))
    return joined.groupBy(*by, "target").agg(F.min(F.when(F.col(y) >= F.col("target"), F.col(x))).alias("pool"))


def median_pool(reach: DataFrame, by: Sequence[str]) -> DataFrame:
    """Median over curves, misses ranked last: null if half of them or more miss."""
    far = F.lit(float("inf"))
    m = F.median(F.coalesce("pool", far))
    return reach.groupBy(*by).agg(F.when(m < far, m).alias("pool"), F.count("pool").alias("reached"), F.count("*").alias("curves"))


def labeling_efficiency(pools: DataFrame, keys: Sequence[str], series: str = "series") -> DataFrame:
    """Ratio of the random arm's pool to each other series'; a random arm that misses counts as all labels, as a bound."""
    random = pools.where(F.col(series) == RANDOM).select(*keys, F.col("pool").alias("random_pool"))
    out = pools.where(F.col(series) != RANDOM).join(random, list(keys), "left").withColumnRenamed("pool", "uq_pool")
    ratio = F.when(F.col("uq_pool") > 0, F.coalesce("random_pool", F.lit(100.0)) / F.col("uq_pool"))
    return out.withColumns({"efficiency": ratio, "lower_bound": F.col("random_pool").isNull() & F.col("uq_pool").isNotNull()})


def efficiency_summary(efficiency: DataFrame, by: Sequence[str]) -> DataFrame:
    e = F.col("efficiency")
    return efficiency.groupBy(*by).agg(
        F.exp(F.avg(F.ln(F.when(e > 0, e)))).alias("geometric_mean"), F.min(e).alias("least"), F.max(e).alias("most"),
        F.bool_or("lower_bound").alias("lower_bound"), F.count(e).alias("n"), F.count_if(F.col("uq_pool").isNull()).alias("missed"))


def at_budgets(curves: DataFrame, keys: Sequence[str], x: str, y: str, budgets: Sequence[float]) -> DataFrame:
    """y at each budget, linear between rounds, the end values beyond the ends. Two rounds of one x: the later y."""
    w = Window.partitionBy(*keys).orderBy(x)
    steps = curves.select(*keys, x, y, F.lead(x).over(w).alias("_x2"), F.lead(y).over(w).alias("_y2"))
    steps = steps.withColumn("budget", F.explode(F.array(*map(F.lit, map(float, budgets)))))
    b = F.col("budget")
    within = (F.col(x) <= b) & (b < F.col("_x2"))
    line = F.col(y) + (b - F.col(x)) * (F.col("_y2") - F.col(y)) / F.when(F.col("_x2") > F.col(x), F.col("_x2") - F.col(x))
    out = steps.groupBy(*keys, "budget").agg(
        F.max(F.when(within, line)).alias("_in"), F.min(x).alias("_first"), F.min_by(y, x).alias("_low"), F.max_by(y, x).alias("_high"))
    value = F.when(b < F.col("_first"), F.col("_low")).otherwise(F.coalesce("_in", "_high"))
    return out.select(*keys, "budget", value.alias(y))


def floor_and_ceiling(curves: DataFrame, ceiling: DataFrame, keys: Sequence[str], y: str) -> DataFrame:
    """Mean of the random arm's round 0 against mean, deviation and number of the supervised rows; either may be absent."""
    low = curves.where((F.col("round") == 0) & (F.col("arm") == RANDOM)).groupBy(*keys).agg(F.avg(y).alias("floor"))
    high = ceiling.groupBy(*keys).agg(F.avg(y).alias("ceiling"), F.stddev(y).alias("ceiling_sd"), F.count(y).alias("ceiling_n"))
    return low.join(high, list(keys), "full")


def headroom(at: DataFrame, ceilings: DataFrame, by: Sequence[str], setting: Sequence[str], on: Sequence[str], y: str) -> DataFrame:
    """Mean gap at each budget, the ceiling's headroom over the random arm, and the share of it that the gap closes."""
    pairs = paired(at.withColumnRenamed(y, "score"), [*setting, "seed", "budget"], ["score"]).join(ceilings.select(*on, "ceiling"), list(on))
    out = pairs.groupBy(*by, "budget").agg(
        F.avg("gap_score").alias("gap"), F.stddev("gap_score").alias("gap_sd"), F.count("*").alias("pairs"),
        F.avg(F.col("ceiling") - F.col("random_score")).alias("headroom"))
    return out.withColumn("closed", F.when(F.col("headroom") > 0, F.col("gap") / F.col("headroom")))


def band(curves: DataFrame, by: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Mean, deviation (0 for one row) and the bounds one deviation away, kept within 0 and 1, of each field."""
    stats = [F.avg(v).alias(f"{v}_mean") for v in fields] + [F.coalesce(F.stddev(v), F.when(F.count(v) > 0, F.lit(0.0))).alias(f"{v}_sd") for v in fields]
    out = curves.groupBy(*by).agg(*stats)
    return out.withColumns({f"{v}_{n}": f for v in fields for n, f in (
        ("low", F.greatest(F.lit(0.0), F.col(f"{v}_mean") - F.col(f"{v}_sd"))), ("high", F.least(F.lit(1.0), F.col(f"{v}_mean") + F.col(f"{v}_sd"))))})


def stability(curves: DataFrame, keys: Sequence[str], y: str, order: str = "round") -> DataFrame:
    """First score, largest fall below the best so far (from the second round on), and mean distance from the
    midpoint of the neighbours (null with fewer than three rounds)."""
    w = Window.partitionBy(*keys).orderBy(order)
    steps = curves.withColumns({
        "_best": F.max(y).over(w.rowsBetween(Window.unboundedPreceding, 0)), "_n": F.row_number().over(w),
        "_mid": (F.lag(y).over(w) + F.lead(y).over(w)) / 2})
    fall = F.when(F.col("_n") > 1, F.col("_best") - F.col(y))
    return steps.groupBy(*keys).agg(F.min_by(y, order).alias("first_score"), F.max(fall).alias("largest_fall"), F.avg(F.abs(F.col(y) - F.col("_mid"))).alias("jitter"))


def tuning_objective(curves: DataFrame, keys: Sequence[str], x: str, y: str, seed: str = "seed", total: str = "total_rounds") -> DataFrame:
    """Seed means of area and final of the runs that have every round from 0 to the last one planned."""
    runs = curves.withColumns({
        "_n": F.count("*").over(Window.partitionBy(*keys, seed)), "_last": F.max("round").over(Window.partitionBy(*keys, seed))})
    whole = runs.where((F.col("_n") == F.col(total) + 1) & (F.col("_last") == F.col(total)))
    return arm_scores(whole, [*keys, seed], x, y, strict=False).groupBy(*keys).agg(F.avg("auc").alias("auc"), F.avg("final").alias("final"), F.count("*").alias("n_seeds"))


def wins(scores: DataFrame, by: Sequence[str], gap: Column, tolerance: float = 1e-12) -> DataFrame:
    """Wins, ties and losses of a gap, and the share of wins (null without rows)."""
    return scores.groupBy(*by).agg(
        F.avg(gap).alias("mean_gap"), F.count_if(gap > tolerance).alias("wins"), F.count_if(F.abs(gap) <= tolerance).alias("ties"), F.count_if(gap < -tolerance).alias("losses"),
    ).withColumn("win_share", F.try_divide("wins", F.col("wins") + F.col("ties") + F.col("losses")))


def best_config(scores: DataFrame, by: Sequence[str], score: str = "score", config: str = "config_id") -> DataFrame:
    """The configuration of the highest score, the smallest id of equal ones."""
    return scores.groupBy(*by).agg(F.min_by(F.struct(config, score), F.struct(-F.col(score), F.col(config))).alias("b")).select(*by, f"b.{config}", f"b.{score}")
