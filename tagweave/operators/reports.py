"""Report tables over runs, settings and sweeps, each an aggregation over the keys of its runs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tagweave.operators import curves as C, stats as ST

#: Fall of a run's score that counts as a drop, score below which a bootstrap failed, share that a verdict may lose, settings that it needs.
DROP, FAILED, TOLERANCE, NEEDED = 0.10, 0.05, 0.01, 3


def dataset_bounds(bounds: DataFrame, supervised: DataFrame, by: Sequence[str], score: str) -> DataFrame:
    """Mean floor over models, and mean and 95 % interval of all supervised rows; ``models`` counts those with a ceiling."""
    low = bounds.groupBy(*by).agg(F.avg("floor").alias("floor"), F.count("ceiling").alias("models"))
    high = ST.mean_interval(supervised.where(F.col(score).isNotNull()), by, score).select(*by, F.col("mean").alias("ceiling"), F.col("low").alias("ceiling_low"), F.col("high").alias("ceiling_high"))
    return low.join(high, list(by), "left").withColumn("floor_to_ceiling", F.col("ceiling") - F.col("floor"))


def first_settings(runs: DataFrame, by: Sequence[str], run: str, settings: Sequence[str], most: str) -> DataFrame:
    """Settings of the run of the smallest name in each group, and the largest ``most`` of any run."""
    return runs.groupBy(*by).agg(F.min_by(F.struct(*settings), run).alias("s"), F.max(most).alias(most)).select(*by, "s.*", most)


def winners(trials: DataFrame, sweep: Sequence[str], score: str = "score", config: str = "config_id") -> DataFrame:
    """The best configuration of every sweep that has no trial left to run."""
    finished = trials.groupBy(*sweep).agg(F.count_if(F.col("status") == "pending").alias("_left")).where("_left = 0").drop("_left")
    done = trials.where("status = 'complete'").join(finished, list(sweep), "left_semi")
    return C.best_config(done, sweep, score, config)


def headline(seed_level: DataFrame, setting: Sequence[str]) -> DataFrame:
    """Means and deviations of the gaps in points, the seeds that favour the uncertain arm, and both arms' areas."""
    points = {"gap_auc": "gap_auc_pp", "gap_final": "gap_final_pp"}
    return seed_level.groupBy(*setting).agg(
        *(f(100 * F.col(c)).alias(n.replace("_pp", end)) for c, n in points.items() for f, end in ((F.avg, "_pp"), (F.stddev, "_sd_pp"))),
        F.count_if(F.col("gap_auc") > 0).alias("seeds_favouring"), F.count("*").alias("seeds"),
        F.avg(100 * F.col("random_auc")).alias("random_auc_pp"), F.avg(100 * F.col("uncertainty_auc")).alias("uncertainty_auc_pp"))


def measure_means(rows: DataFrame, by: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Mean of each measure as a row of its own."""
    return rows.unpivot(list(by), list(measures), "measure", "value").groupBy(*by, "measure").agg(F.avg("value").alias("value"))


def spans_of(means: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    return means.groupBy(*by).agg(F.min(value).alias("low"), F.max(value).alias("high"), F.count(value).alias("n"))


def paired_difference(means: DataFrame, index: Sequence[str], variant: str, value: str, base: str, other: str, by: Sequence[str]) -> DataFrame:
    """By group: mean of ``other`` less ``base`` over the settings that have both, and how often ``other`` is better."""
    both = means.groupBy(*index).pivot(variant, [base, other]).agg(F.first(value)).where(F.col(base).isNotNull() & F.col(other).isNotNull())
    gap = F.col(other) - F.col(base)
    return both.groupBy(*by).agg(F.avg(gap).alias("mean_difference"), F.count_if(gap > 0).alias("better"), F.count("*").alias("pairs"))


def times_best(means: DataFrame, within: Sequence[str], metric: str, value: str, column: str, columns: Sequence[str]) -> DataFrame:
    """How often each metric has the largest value of a group, a column for each of ``columns`` and the total."""
    best = means.groupBy(*within).agg(F.max_by(metric, F.struct(value, metric)).alias(metric))
    counts = best.groupBy(metric).pivot(column, list(columns)).count()
    whole = means.select(metric).distinct().join(counts, metric, "left").na.fill(0, list(columns))
    return whole.withColumn("total", sum((F.col(c) for c in columns), F.lit(0)))


def spread(means: DataFrame, within: Sequence[str], value: str, by: Sequence[str]) -> DataFrame:
    """Mean over groups of the largest less the smallest value."""
    return means.groupBy(*within).agg((F.max(value) - F.min(value)).alias("_s")).groupBy(*by).agg(F.avg("_s").alias("spread"))


def significance(tests: DataFrame, by: Sequence[str], p: str = "holm", level: float = 0.05) -> DataFrame:
    """How many tests of each group are significant, and the verdict: all, no or some metrics."""
    counts = tests.groupBy(*by).agg(F.count_if(F.col(p) < level).alias("significant"), F.count("*").alias("metrics"))
    verdict = F.when(F.col("significant") == F.col("metrics"), "all metrics").when(F.col("significant") == 0, "no metric").otherwise("some metrics")
    return counts.withColumn("verdict", verdict)


def gap_auc(curves: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Area under the gap of the arms by seed, then its mean over seeds: ``gap_auc``, ``n_seeds``.

    An error if an arm repeats or lacks a round, if the arms' x differ, or if x doesn't rise over two rounds.
    """
    run = [*keys, "seed"]
    of = lambda c, a: F.max(F.when(F.col("arm") == a, F.col(c)))
    both = curves.groupBy(*run, "round").agg(
        F.count("*").alias("_n"), F.count_distinct("arm").alias("_arms"), of(x, C.UNCERTAINTY).alias("_x"), of(x, C.RANDOM).alias("_rx"), (of(y, C.UNCERTAINTY) - of(y, C.RANDOM)).alias("_gap"))
    fits = (F.col("_n") == 2) & (F.col("_arms") == 2) & F.col("_x").eqNullSafe(F.col("_rx"))
    checked = both.withColumn("_x", F.when(fits, F.col("_x")).otherwise(F.raise_error(F.lit("each round needs both arms once, at one x")).cast("double")))
    areas = C.arm_scores(checked, run, "_x", "_gap")
    return areas.groupBy(*keys).agg(F.avg("auc").alias("gap_auc"), F.avg("final").alias("final_gap"), F.count("*").alias("n_seeds"))


def paired_summary(curves: DataFrame, keys: Sequence[str], x: str, measures: Sequence[str]) -> DataFrame:
    """Areas and final gaps of several measures, a row each, from one layout of the rounds."""
    long = curves.unpivot([*keys, "seed", "arm", "round", x], list(measures), "measure", "score")
    return gap_auc(long, [*keys, "measure"], x, "score")


def recipe_summary(curves: DataFrame, recipe: Sequence[str], x: str, y: str) -> DataFrame:
    """Stability over all runs of a recipe, and its winner: the configuration of the best mean area, the smallest of equal ones."""
    run = [*recipe, "config_id", "seed"]
    stable = C.stability(curves, run, y).groupBy(*recipe).agg(
        F.count_distinct("config_id").alias("configs"), (F.count_if(F.col("largest_fall") >= DROP) / F.count("*")).alias("drop_share"),
        F.when(F.count("jitter") == F.count("*"), F.median("jitter")).alias("median_jitter"), (F.count_if(F.col("first_score") < FAILED) / F.count("*")).alias("failed_share"))
    scores = C.arm_scores(curves, run, x, y, strict=False).groupBy(*recipe, "config_id").agg(F.avg("auc").alias("score"), F.coalesce(F.stddev("final"), F.lit(0.0)).alias("final_sd"))
    best = scores.groupBy(*recipe).agg(F.min_by(F.struct("config_id", "score", "final_sd"), F.struct(-F.col("score"), "config_id")).alias("b"))
    return stable.join(best.select(*recipe, F.col("b.config_id").alias("winner"), F.col("b.score").alias("winner_auc"), F.col("b.final_sd").alias("winner_final_sd")), list(recipe))


def verdict(summaries: DataFrame, setting: Sequence[str], recipe: str, base: str, candidate: str) -> DataFrame:
    """Settings in which the candidate has fewer drops and loses no more than TOLERANCE of the winner's area, and whether
    these are enough to adopt it."""
    of = lambda c, r: F.max(F.when(F.col(recipe) == r, F.col(c)))
    both = summaries.groupBy(*setting).agg(
        ((of("drop_share", candidate) < of("drop_share", base)) & (of("winner_auc", candidate) >= of("winner_auc", base) - TOLERANCE)).alias("improves"))
    name = F.concat_ws(" ", *(F.col(s).cast("string") for s in setting))
    return both.agg(F.array_join(F.array_sort(F.collect_list(F.when(F.col("improves"), name))), ", ").alias("improved"), F.count_if("improves").alias("n_improved"),
                    F.count("*").alias("n_settings")).withColumn("adopt", F.col("n_improved") >= NEEDED)


def unpaired_plans(base: DataFrame, pilot: DataFrame, new: Sequence[str] = ()) -> DataFrame:
    """Configurations of a pilot that don't repeat the parameters of the base's at the same place, new settings aside.

    Both hold ``place, config_id, parameters`` (a map); places that only one has are no fault.
    """
    plain = F.map_filter("parameters", lambda k, _: ~k.isin(*new)) if new else F.col("parameters")
    entries = lambda c: F.array_sort(F.map_entries(c))
    other = base.select("place", entries(F.col("parameters")).alias("_base"))
    return pilot.withColumn("_own", entries(plain)).join(other, "place").where(~F.col("_own").eqNullSafe(F.col("_base"))).select("place", "config_id")


def mean_and_deviation(mean: Column, sd: Column, digits: int = 1) -> Column:
    """'12.3 ± 4.5', empty if either is null."""
    return F.coalesce(F.when(mean.isNotNull() & sd.isNotNull(), F.format_string(f"%.{digits}f ± %.{digits}f", mean, sd)), F.lit(""))


def throughput(rows: DataFrame, order: str, rounds: str, minutes: str) -> DataFrame:
    """Rounds a minute, those a process, and the gain over the first row (a row a number of processes)."""
    rate = F.col(rounds) / F.col(minutes)
    out = rows.withColumns({"rounds_per_minute": rate, "per_process": rate / F.col(order)})
    return out.withColumn("speed_up", F.col("rounds_per_minute") / F.first("rounds_per_minute").over(Window.orderBy(order)))


def inconsistent(ledger: DataFrame, recomputed: DataFrame, keys: Sequence[str], score: str, tolerance: float = 1e-12) -> DataFrame:
    """Ledger rows whose score another computation doesn't give, or doesn't have."""
    other = recomputed.select(*keys, F.col(score).alias("_other"))
    return ledger.join(other, list(keys), "left").where(F.col("_other").isNull() | (F.abs(F.col(score) - F.col("_other")) > tolerance)).select(*keys, score)


def jitter(rows: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """A place within (0, 1) for each row of a panel: the same one whenever it is drawn."""
    return rows.withColumn("jitter", F.round((0.618 * (F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1)) % 1, 9))


def display(value: Column, names: Mapping[str, str], strict: bool = True) -> Column:
    """A value's display name; an unknown one is an error, or stays as it is if not ``strict``. Null stays null."""
    name = F.try_element_at(F.create_map(*(F.lit(x) for kv in names.items() for x in kv)), value)
    other = F.raise_error(F.concat(F.lit("no name for "), value)).cast("string") if strict else value
    return F.when(value.isNotNull(), F.coalesce(name, other))


def same_number(a: Column, b: Column, digits: int = 14) -> Column:
    """Equality to so many significant digits."""
    form = lambda c: F.format_string(f"%.{digits - 1}e", c.cast("double"))
    return form(a).eqNullSafe(form(b))


def evaluation_payload(rows: DataFrame, keys: Sequence[str], shared: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """One row a key with both arms' measures as columns; an error unless each arm is there once and ``shared`` fields agree."""
    of = lambda c, a: F.max(F.when(F.col("arm") == a, F.col(c)))
    arms = (C.UNCERTAINTY, C.RANDOM)
    agg = rows.groupBy(*keys).agg(
        F.count("*").alias("_n"), *(F.count_if(F.col("arm") == a).alias(f"_{a}") for a in arms), *(F.count_distinct(c).alias(f"_d_{c}") for c in shared),
        *(F.first(c).alias(c) for c in shared), *(of(m, a).alias(f"{a}_{m}") for m in measures for a in arms))
    good = (F.col("_n") == 2) & (F.col(f"_{arms[0]}") == 1) & (F.col(f"_{arms[1]}") == 1)
    for c in shared:
        good &= F.col(f"_d_{c}") <= 1
    return agg.where(F.when(good, True).otherwise(F.raise_error(F.lit("a payload needs each arm once, with equal shared fields")).cast("boolean"))).select(*keys, *shared, *(f"{a}_{m}" for m in measures for a in arms))
