import math

import pytest
from pyspark.sql import functions as F

from tagweave.operators import curves as C, stats as ST
from tagweave.plans.runtime import Scratch

CURVE = "ds string, metric string, seed int, arm string, round int, x double, y double"


def curve(spark, rows):
    return spark.createDataFrame(rows, CURVE)


def run(arm, ys, seed=0, metric="m", ds="d", xs=None):
    return [(ds, metric, seed, arm, i, float(xs[i] if xs else 50 * i), y) for i, y in enumerate(ys)]


def test_area_and_gap(spark):
    df = curve(spark, run("random", [0.0, 0.2, 0.4]) + run("uncertainty", [0.0, 0.4, 0.5]) + run("random", [0.1, None, 0.2], seed=1) + run("uncertainty", [0.1, 0.1, 0.2], seed=1))
    out = C.seed_scores(df, ["ds"], "x", "y").collect()
    assert [(r.seed, round(r.random_auc, 6), round(r.uncertainty_auc, 6), round(r.gap_auc, 6), round(r.gap_final, 6)) for r in out] == [(0, 0.2, 0.325, 0.125, 0.1)]


def test_curves_must_rise(spark):
    df = curve(spark, run("random", [0.1, 0.2], xs=[0, 0]))
    with pytest.raises(Exception, match="rise strictly"):
        C.arm_scores(df, ["arm"], "x", "y").collect()
    assert C.arm_scores(df, ["arm"], "x", "y", strict=False).first().auc is None


def test_null_keys_pair(spark):
    rows = spark.createDataFrame([(None, "random", 1.0), (None, "uncertainty", 3.0), ("a", "random", 1.0)], "k string, arm string, v double")
    assert [tuple(r) for r in C.paired(rows, ["k"], ["v"]).select("k", "gap_v").collect()] == [(None, 2.0)]


def test_median_ranks_misses_last(spark):
    df = spark.createDataFrame([("a", 30.0), ("a", None), ("a", 50.0), ("b", 20.0), ("b", None)], "g string, pool double")
    assert {r.g: (r.pool, r.reached, r.curves) for r in C.median_pool(df, ["g"]).collect()} == {"a": (50.0, 2, 3), "b": (None, 1, 2)}


def test_budgets_interpolate_and_hold_the_ends(spark):
    df = curve(spark, run("random", [0.2, 0.4, 0.8], xs=[10, 20, 40]))
    assert [round(r.y, 6) for r in C.at_budgets(df, ["arm"], "x", "y", [0, 10, 15, 30, 99]).orderBy("budget").collect()] == [0.2, 0.2, 0.3, 0.6, 0.8]


def test_efficiency_bounds(spark):
    pools = spark.createDataFrame([("d", "random", None), ("d", "m", 20.0), ("e", "random", 60.0), ("e", "m", None), ("f", "random", 10.0), ("f", "m", 0.0)], "ds string, series string, pool double")
    assert {r.ds: (r.efficiency, r.lower_bound) for r in C.labeling_efficiency(pools, ["ds"]).collect()} == {"d": (5.0, True), "e": (None, False), "f": (None, False)}


def test_random_arm_counts_once(spark):
    df = curve(spark, run("random", [0.1], metric="a") + run("random", [0.1], metric="b") + run("uncertainty", [0.1], metric="a") + run("uncertainty", [0.1], metric="b"))
    assert sorted(r.series for r in C.arm_series(df, ["ds"], "metric").collect()) == ["a", "b", "random"]


def test_stability(spark):
    out = C.stability(curve(spark, run("r", [0.3, 0.1, 0.5, 0.4])), ["arm"], "y").first()
    assert (round(out.first_score, 6), round(out.largest_fall, 6), round(out.jitter, 6)) == (0.3, 0.2, round((abs(0.1 - 0.4) + abs(0.5 - 0.25)) / 2, 6))
    assert C.stability(curve(spark, run("r", [0.3, 0.1])), ["arm"], "y").first().jitter is None


def test_wins_of_nothing(spark):
    assert C.wins(spark.createDataFrame([("a", None)], "g string, v double"), ["g"], F.col("v")).first().win_share is None


def test_best_config_prefers_the_smallest_id(spark):
    df = spark.createDataFrame([("s", 3, 0.5), ("s", 1, 0.5), ("s", 2, 0.4)], "sweep string, config_id int, score double")
    assert C.best_config(df, ["sweep"]).first().config_id == 1


def test_interval(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 3.0), ("b", 5.0)], "g string, v double")
    out = {r.g: r for r in ST.mean_interval(df, ["g"], "v").collect()}
    assert round((out["a"].high - out["a"].mean) * math.sqrt(3), 3) == 4.303 and out["b"].low == out["b"].high == 5
    assert round(ST.t_quantile(0.975, 2), 3) == 4.303 and round(ST.t_quantile(0.975, 30), 3) == 2.042
    assert round(ST.t_two_sided(2.0, 10), 4) == 0.0734


def test_holm_counts_the_planned_tests(spark):
    df = spark.createDataFrame([("f", "a", 0.01), ("f", "b", 0.04), ("f", "c", None)], "fam string, k string, p double")
    out = {r.k: (r.bonferroni, r.holm) for r in ST.adjusted(df, ["fam"], 3, tie=["k"]).collect()}
    assert out == {"a": (0.03, 0.03), "b": (0.12, 0.08), "c": (None, None)}


def test_rank_tests():
    assert round(ST.mann_whitney_p(0, 3, 3, 0), 4) == 0.1 and ST.mann_whitney_p(4.5, 3, 3, 0) == 1.0


def test_rank_tests_on_tables(spark):
    df = spark.createDataFrame([("a", float(v)) for v in (1, 2, 3)] + [("b", float(v)) for v in (4, 5, 6)] + [("c", None)], "g string, v double")
    out = ST.pairwise_mann_whitney(df, "g", "v", ["a", "b", "c"], Scratch(spark, "t")).collect()
    assert [(r.first, r.second, r.u, round(r.p, 4)) for r in out] == [("a", "b", 0.0, 0.1)]
    signed = spark.createDataFrame([("g", float(v)) for v in (1, 2, 3, 4, 5, 0)], "g string, d double")
    assert [(r.n, r.w, round(r.p, 4)) for r in ST.wilcoxon(signed, ["g"], "d", Scratch(spark, "t")).collect()] == [(5, 0.0, 0.0625)]
    assert ST.spearman(spark.createDataFrame([("g", 1.0, 1.0), ("g", 2.0, 1.0)], "g string, x double, y double"), ["g"], "x", "y", Scratch(spark, "t")).first().rho is None
