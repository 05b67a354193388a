"""The queries over report tables, by name, with their SQL. Each runs over whole tables."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tagweave.functions import spans, text
from tagweave.operators import annotation, curves as C, profile as P, reports as R, selection as A, stats as ST, testsplit as T
from tagweave.plans import adapters as D, catalog as K
from tagweave.plans.catalog import RUN, SETTING, r6
from tagweave.plans.runtime import Scratch, table
from tagweave.sources import readers, runs, writers
from tagweave.streaming import live

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


_SEEDS = """
sides AS (SELECT dataset, model, uq_metric, seed, max(CASE WHEN arm = 'uncertainty' THEN auc END) AS u, max(CASE WHEN arm = 'random' THEN auc END) AS r, max(CASE WHEN arm = 'uncertainty' THEN final END) AS uf, max(CASE WHEN arm = 'random' THEN final END) AS rf
          FROM areas GROUP BY ALL HAVING count(DISTINCT arm) = 2),
settings AS (SELECT dataset, model, uq_metric, avg(100 * (u - r)) AS gap FROM sides GROUP BY ALL)"""
SEEDS = D.with_ctes(D.CURVES, K._AREAS, _SEEDS)


def _setting_gaps(spark, folder):
    return K._seed_scores(spark, folder).groupBy(*SETTING).agg(F.avg(100 * F.col("gap_auc")).alias("gap"))


_SUPERVISED = "supervised AS (SELECT dataset, model, entity_f1 FROM (SELECT *, max(round) OVER (PARTITION BY dataset, model, uq_metric, seed, arm) AS last FROM curves) WHERE arm = 'uncertainty' AND round = last)"


@query("g15_dataset_bounds", K._recursive(D.CURVES, _SUPERVISED) + """,
floors AS (SELECT dataset, avg(floor) AS floor, count(ceiling) AS models FROM (
  SELECT dataset, model, floor, ceiling FROM (SELECT dataset, model, avg(entity_f1) AS floor FROM curves WHERE round = 0 AND arm = 'random' GROUP BY ALL) FULL JOIN (SELECT dataset, model, avg(entity_f1) AS ceiling FROM supervised GROUP BY ALL) USING (dataset, model)) GROUP BY dataset),
means AS (SELECT dataset, avg(entity_f1) AS mean, stddev_samp(entity_f1) AS sd, count(*) AS n FROM supervised GROUP BY dataset),""" + K._quantiles("n - 1", "means") + """
SELECT f.dataset, round(floor, 6) AS floor, round(mean, 6) AS ceiling, round(mean - q * sd / sqrt(n), 6) AS ceiling_low, round(mean + q * sd / sqrt(n), 6) AS ceiling_high, round(mean - floor, 6) AS floor_to_ceiling, models
FROM floors f JOIN means m ON f.dataset = m.dataset JOIN quantiles ON df = n - 1""")
def _(spark, folder):
    c = D.curves(spark, folder)
    high = K._supervised(c)
    out = R.dataset_bounds(C.floor_and_ceiling(c, high, ["dataset", "model"], "entity_f1"), high, ["dataset"], "entity_f1")
    return out.select("dataset", *r6("floor", "ceiling", "ceiling_low", "ceiling_high", "floor_to_ceiling"), "models")


@query("g17_dataset_sizes", "SELECT o_orderpriority, arg_min(o_custkey, o_orderkey) AS o_custkey, arg_min(o_orderstatus, o_orderkey) AS o_orderstatus, round(max(o_totalprice), 2) AS o_totalprice FROM orders GROUP BY o_orderpriority")
def _(spark, folder):
    o = table(spark, folder, "orders")
    return R.first_settings(o, ["o_orderpriority"], "o_orderkey", ["o_custkey", "o_orderstatus"], "o_totalprice").withColumn("o_totalprice", F.round("o_totalprice", 2))


_BY_CUSTOMER = """
runs AS (SELECT o_custkey AS sweep, o_orderkey % 10 AS config_id, CASE o_orderstatus WHEN 'F' THEN 'complete' WHEN 'O' THEN 'failed' ELSE 'pending' END AS status, round(o_totalprice / 1000) / 500 AS score FROM orders)"""


def _customer_runs(spark, folder):
    status = F.when(F.col("o_orderstatus") == "F", "complete").when(F.col("o_orderstatus") == "O", "failed").otherwise("pending")
    return table(spark, folder, "orders").select(F.col("o_custkey").alias("sweep"), (F.col("o_orderkey") % 10).alias("config_id"), status.alias("status"), (F.round(F.col("o_totalprice") / 1000) / 500).alias("score"))


@query("g19_winners", D.with_ctes(_BY_CUSTOMER) + """
SELECT sweep, config_id, score FROM (SELECT *, row_number() OVER (PARTITION BY sweep ORDER BY score DESC, config_id) AS r FROM runs
  WHERE status = 'complete' AND sweep NOT IN (SELECT sweep FROM runs WHERE status = 'pending')) WHERE r = 1""")
def _(spark, folder):
    return R.winners(_customer_runs(spark, folder), ["sweep"])


@query("g20_headline", SEEDS + """
SELECT dataset, model, uq_metric, round(avg(100 * (u - r)), 6) AS gap_auc_pp, round(stddev_samp(100 * (u - r)), 6) AS gap_auc_sd_pp, round(avg(100 * (uf - rf)), 6) AS gap_final_pp, round(stddev_samp(100 * (uf - rf)), 6) AS gap_final_sd_pp,
       count(*) FILTER (WHERE u > r) AS seeds_favouring, count(*) AS seeds, round(avg(100 * r), 6) AS random_auc_pp, round(avg(100 * u), 6) AS uncertainty_auc_pp FROM sides GROUP BY ALL""")
def _(spark, folder):
    out = R.headline(K._seed_scores(spark, folder), SETTING)
    return out.select(*SETTING, *r6("gap_auc_pp", "gap_auc_sd_pp", "gap_final_pp", "gap_final_sd_pp", "random_auc_pp", "uncertainty_auc_pp"), "seeds_favouring", "seeds")


@query("g21_measure_means", D.with_ctes(D.CURVES) + """
SELECT arm, round, measure, round(avg(value), 6) AS value FROM (SELECT arm, round, 'entity_f1' AS measure, entity_f1 AS value FROM curves UNION ALL SELECT arm, round, 'percent_acquired', percent_acquired FROM curves) GROUP BY ALL""")
def _(spark, folder):
    return R.measure_means(D.curves(spark, folder), ["arm", "round"], ["entity_f1", "percent_acquired"]).select("arm", "round", "measure", *r6("value"))


@query("g22_spans", SEEDS + "SELECT dataset, model, round(min(gap), 6) AS low, round(max(gap), 6) AS high, count(*) AS n FROM settings GROUP BY ALL")
def _(spark, folder):
    return R.spans_of(_setting_gaps(spark, folder), ["dataset", "model"], "gap").select("dataset", "model", *r6("low", "high"), "n")


@query("g24_paired_variants", SEEDS + """
SELECT dataset, round(avg(b.gap - a.gap), 6) AS mean_difference, count(*) FILTER (WHERE b.gap > a.gap) AS better, count(*) AS pairs
FROM settings a JOIN settings b USING (dataset, uq_metric) WHERE a.model = 'm0' AND b.model = 'm1' GROUP BY dataset""")
def _(spark, folder):
    return R.paired_difference(_setting_gaps(spark, folder), ["dataset", "uq_metric"], "model", "gap", "m0", "m1", ["dataset"]).select("dataset", *r6("mean_difference"), "better", "pairs")


@query("g25_times_best", SEEDS + """,
best AS (SELECT dataset, model, arg_max(uq_metric, gap) AS uq_metric FROM settings GROUP BY ALL)
SELECT m.uq_metric, count(*) FILTER (WHERE dataset = 'd0') AS d0, count(*) FILTER (WHERE dataset = 'd1') AS d1, count(dataset) AS total FROM (SELECT DISTINCT uq_metric FROM settings) m LEFT JOIN best USING (uq_metric) GROUP BY m.uq_metric""")
def _(spark, folder):
    return R.times_best(_setting_gaps(spark, folder), ["dataset", "model"], "uq_metric", "gap", "dataset", ["d0", "d1"])


@query("g25_spread", SEEDS + "SELECT dataset, round(avg(s), 6) AS spread FROM (SELECT dataset, model, max(gap) - min(gap) AS s FROM settings GROUP BY ALL) GROUP BY dataset")
def _(spark, folder):
    return R.spread(_setting_gaps(spark, folder), ["dataset", "model"], "gap", ["dataset"]).select("dataset", *r6("spread"))


@query("g26_significance", D.with_ctes(D.CURVES, K._AREAS, K._GAPS, K._HOLM) + """
SELECT dataset, model, count(*) FILTER (WHERE holm < 0.5) AS significant, count(*) AS metrics, CASE WHEN count(*) FILTER (WHERE holm < 0.5) = count(*) THEN 'all metrics' WHEN count(*) FILTER (WHERE holm < 0.5) = 0 THEN 'no metric' ELSE 'some metrics' END AS verdict
FROM holm GROUP BY dataset, model""")
def _(spark, folder):
    return R.significance(K._holm(spark, folder), ["dataset", "model"], level=0.5)


_MEANS_OF_CONFIGS = """
means AS (SELECT sweep, config_id, any_value(config_id % 7) AS setting, avg(score) AS gap FROM trials WHERE status = 'complete' GROUP BY sweep, config_id),
ranked AS (SELECT sweep, rank() OVER (PARTITION BY sweep ORDER BY setting) + (count(*) OVER (PARTITION BY sweep, setting) - 1) / 2 AS x, rank() OVER (PARTITION BY sweep ORDER BY gap) + (count(*) OVER (PARTITION BY sweep, gap) - 1) / 2 AS y FROM means)"""


@query("g27_config_drivers", D.with_ctes(D.TRIALS, _MEANS_OF_CONFIGS) + "SELECT sweep, round(corr(x, y), 6) AS rho, count(*) AS n FROM ranked GROUP BY sweep")
def _(spark, folder):
    t = D.trials(spark, folder).where("status = 'complete'")
    means = t.groupBy("sweep", "config_id").agg(F.first(F.col("config_id") % 7).alias("setting"), F.avg("score").alias("gap"))
    return ST.spearman(means, ["sweep"], "setting", "gap", Scratch(spark, "g27")).select("sweep", *r6("rho"), "n")


@query("g30_lexicon_summary", K.LEX + """,
sizes AS (SELECT part, row_id, count(*) AS n, count(DISTINCT word) / count(*) AS ttr FROM lexicon GROUP BY part, row_id),
means AS (SELECT part, avg(ttr) AS window_ttr, count(*) AS windows FROM windows GROUP BY part)
SELECT l.part, n_words, n_forms, entity_share, round(median_words, 6) AS median_words, round(sentence_ttr, 6) AS sentence_ttr, round(window_ttr, 6) AS window_ttr, coalesce(windows, 0) AS windows
FROM (SELECT part, count(*) AS n_words, count(DISTINCT word) AS n_forms, round(count(*) FILTER (WHERE entity) / count(*), 6) AS entity_share FROM lexicon GROUP BY part) l
JOIN (SELECT part, median(n) AS median_words, avg(ttr) AS sentence_ttr FROM sizes GROUP BY part) s ON l.part IS NOT DISTINCT FROM s.part LEFT JOIN means m ON l.part IS NOT DISTINCT FROM m.part""")
def _(spark, folder):
    out = P.lexicon_summary(K._lexicon(spark, folder), ["part"], "row_id", 100, Scratch(spark, "g30"))
    return out.select("part", "n_words", "n_forms", *r6("entity_share", "median_words", "sentence_ttr", "window_ttr"), "windows")


_GAP_AREAS = """
gaps_at AS (SELECT dataset, model, uq_metric, seed, round, max(percent_acquired) AS x, max(CASE WHEN arm = 'uncertainty' THEN entity_f1 END) - max(CASE WHEN arm = 'random' THEN entity_f1 END) AS g FROM curves GROUP BY dataset, model, uq_metric, seed, round HAVING count(*) = 2),
steps2 AS (SELECT *, (x - lag(x) OVER w) * (g + lag(g) OVER w) / 2 AS a FROM gaps_at WINDOW w AS (PARTITION BY dataset, model, uq_metric, seed ORDER BY round)),
seed_areas AS (SELECT dataset, model, uq_metric, seed, sum(a) / (max(x) - min(x)) AS auc, arg_max(g, round) AS final FROM steps2 GROUP BY ALL)"""


@query("g36_gap_auc", D.with_ctes(D.CURVES, _GAP_AREAS) + "SELECT dataset, model, uq_metric, round(avg(auc), 6) AS gap_auc, round(avg(final), 6) AS final_gap, count(*) AS n_seeds FROM seed_areas GROUP BY ALL")
def _(spark, folder):
    return R.gap_auc(K._paired_rounds(D.curves(spark, folder)), SETTING, "percent_acquired", "entity_f1").select(*SETTING, *r6("gap_auc", "final_gap"), "n_seeds")


@query("g38_paired_summary", D.with_ctes(D.CURVES, _GAP_AREAS) + """
SELECT dataset, model, uq_metric, 'entity_f1' AS measure, round(avg(auc), 6) AS gap_auc, round(avg(final), 6) AS final_gap FROM seed_areas GROUP BY ALL
UNION ALL SELECT dataset, model, uq_metric, 'entity_partial_f1', round(avg(auc) / 2, 6), round(avg(final) / 2, 6) FROM seed_areas GROUP BY ALL""")
def _(spark, folder):
    c = K._paired_rounds(D.curves(spark, folder)).withColumn("entity_partial_f1", F.col("entity_f1") / 2)
    return R.paired_summary(c, SETTING, "percent_acquired", ["entity_f1", "entity_partial_f1"]).select(*SETTING, "measure", *r6("gap_auc", "final_gap"))


@query("g41_supervised_ledger", D.with_ctes(_BY_CUSTOMER) + """
SELECT sweep, count(*) AS planned, count(*) FILTER (WHERE status = 'complete') AS complete, count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE status = 'complete') = count(*) AS done,
       arg_max(config_id, score * 1000 - config_id / 100) FILTER (WHERE status = 'complete') AS selected FROM runs GROUP BY sweep""")
def _(spark, folder):
    from tagweave.operators import ledger as L

    runs = _customer_runs(spark, folder)
    return L.status_counts(runs, ["sweep"]).join(C.best_config(runs.where("status = 'complete'"), ["sweep"]).select("sweep", F.col("config_id").alias("selected")), "sweep", "left")


_RECIPES = """
jitters AS (SELECT dataset, model, uq_metric, seed, arg_min(entity_f1, round) AS first_score, max(CASE WHEN n > 1 THEN best - entity_f1 END) AS fall, avg(abs(entity_f1 - mid)) AS jitter FROM (
  SELECT *, max(entity_f1) OVER (w ROWS UNBOUNDED PRECEDING) AS best, row_number() OVER w AS n, (lag(entity_f1) OVER w + lead(entity_f1) OVER w) / 2 AS mid FROM curves WHERE arm = 'random' WINDOW w AS (PARTITION BY dataset, model, uq_metric, seed ORDER BY round))
  GROUP BY dataset, model, uq_metric, seed),
stable AS (SELECT dataset, model, count(DISTINCT uq_metric) AS configs, count(*) FILTER (WHERE fall >= 0.1) / count(*) AS drop_share, median(jitter) AS median_jitter, count(*) FILTER (WHERE first_score < 0.05) / count(*) AS failed_share FROM jitters GROUP BY dataset, model),
scored AS (SELECT dataset, model, uq_metric, avg(auc) AS score, coalesce(stddev_samp(final), 0) AS sd FROM areas WHERE arm = 'random' GROUP BY ALL),
recipes AS (SELECT s.dataset, s.model, configs, drop_share, median_jitter, failed_share, b.uq_metric AS winner, b.score AS winner_auc, b.sd AS winner_final_sd FROM stable s
  JOIN (SELECT *, row_number() OVER (PARTITION BY dataset, model ORDER BY score DESC, uq_metric) AS r FROM scored) b ON s.dataset = b.dataset AND s.model = b.model AND b.r = 1)"""


def _recipes(spark, folder):
    c = D.curves(spark, folder).where("arm = 'random'").withColumnRenamed("uq_metric", "config_id")
    return R.recipe_summary(c, ["dataset", "model"], "percent_acquired", "entity_f1")


@query("g43_recipe_summary", D.with_ctes(D.CURVES, K._AREAS, _RECIPES) + "SELECT dataset, model, configs, round(drop_share, 6) AS drop_share, round(median_jitter, 6) AS median_jitter, round(failed_share, 6) AS failed_share, winner, round(winner_auc, 6) AS winner_auc, round(winner_final_sd, 6) AS winner_final_sd FROM recipes")
def _(spark, folder):
    return _recipes(spark, folder).select("dataset", "model", "configs", *r6("drop_share", "median_jitter", "failed_share"), "winner", *r6("winner_auc", "winner_final_sd"))


@query("g44_verdict", D.with_ctes(D.CURVES, K._AREAS, _RECIPES) + """,
improved AS (SELECT a.dataset, b.drop_share < a.drop_share AND b.winner_auc >= a.winner_auc - 0.01 AS improves FROM recipes a JOIN recipes b ON a.dataset = b.dataset WHERE a.model = 'm0' AND b.model = 'm1')
SELECT coalesce(string_agg(dataset, ', ' ORDER BY dataset) FILTER (WHERE improves), '') AS improved, count(*) FILTER (WHERE improves) AS n_improved, count(*) AS n_settings, count(*) FILTER (WHERE improves) >= 3 AS adopt FROM improved""")
def _(spark, folder):
    return R.verdict(_recipes(spark, folder), ["dataset"], "model", "m0", "m1")


@query("j25_unpaired_plans", """
SELECT o.place, o.c AS config_id FROM (SELECT row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) + 1000000 * o_custkey AS place, o_orderkey AS c, o_orderpriority AS p, o_orderstatus AS s FROM orders) o
JOIN (SELECT row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) + 1000000 * o_custkey AS place, o_orderpriority AS p FROM orders) b ON o.place = b.place WHERE o.p <> b.p""")
def _(spark, folder):
    o = table(spark, folder, "orders")

    def plan(*order, **settings):
        place = F.row_number().over(Window.partitionBy("o_custkey").orderBy(*order)) + 1000000 * F.col("o_custkey")
        return o.select(place.alias("place"), F.col("o_orderkey").alias("config_id"), F.create_map(*(x for k, v in settings.items() for x in (F.lit(k), F.col(v)))).alias("parameters"))

    base, pilot = plan(F.desc("o_orderkey"), priority="o_orderpriority"), plan("o_orderkey", priority="o_orderpriority", status="o_orderstatus")
    return R.unpaired_plans(base, pilot, new=["status"])


@query("g50_mean_and_deviation", D.with_ctes(D.TRIALS) + """
SELECT sweep, config_id, CASE WHEN count(score) > 1 THEN format('{:.2f} ± {:.2f}', avg(100 * score), stddev_samp(100 * score)) ELSE '' END AS shown FROM trials WHERE status = 'complete' GROUP BY ALL""")
def _(spark, folder):
    t = D.trials(spark, folder).where("status = 'complete'").groupBy("sweep", "config_id")
    return t.agg(F.avg(100 * F.col("score")).alias("m"), F.stddev(100 * F.col("score")).alias("s")).select("sweep", "config_id", R.mean_and_deviation(F.col("m"), F.col("s"), 2).alias("shown"))


@query("g54_type_table", D.with_ctes(D.TAGGED, D.WORDS, D.GOLD, K._MENTION_ROWS) + """,
tags AS (SELECT substr(gold, 3) AS type, count(*) FILTER (WHERE gold LIKE 'B-%') AS n_begin, count(*) FILTER (WHERE gold LIKE 'I-%') AS n_inside FROM words WHERE gold <> 'O' GROUP BY 1),
forms AS (SELECT type, surface, count(*) AS n, row_number() OVER (PARTITION BY type ORDER BY count(*) DESC, surface) AS r FROM found GROUP BY type, surface)
SELECT t.type, n_begin, n_inside, e.n AS n_entities, f.top FROM tags t JOIN (SELECT type, count(*) AS n FROM found GROUP BY type) e ON t.type = e.type
JOIN (SELECT type, string_agg(surface || ' (' || n || ')', ', ' ORDER BY r) AS top FROM forms WHERE r <= 6 GROUP BY type) f ON t.type = f.type""")
def _(spark, folder):
    return P.type_table(D.words(spark, folder), K._mentions(spark, folder))


@query("g55_suggestion_counts", K.W_SEL + """,
marks AS (SELECT row_id, wid, bool_or(round <= 3) AS labelled, bool_or(round = 4) AS suggested FROM selections GROUP BY ALL)
SELECT w.part, count(*) AS n_words, count(*) FILTER (WHERE labelled) AS n_labelled, count(*) FILTER (WHERE suggested) AS n_suggested, count(*) FILTER (WHERE suggested AND gold <> 'O') AS n_suggested_inside
FROM words w LEFT JOIN marks m ON w.row_id = m.row_id AND w.wid = m.wid GROUP BY w.part""")
def _(spark, folder):
    from tagweave.operators import loop

    return loop.sentence_suggestion_counts(D.selections(spark, folder), D.tagged(spark, folder).select("row_id", "part", "gold"), 3, ["row_id"], ["part"])


@query("g56_throughput", """
WITH n AS (SELECT l_linenumber AS processes, count(*) AS rounds, sum(l_quantity)::DOUBLE / 60 AS minutes FROM lineitem GROUP BY 1)
SELECT processes, round(rounds / minutes, 6) AS rounds_per_minute, round(rounds / minutes / processes, 6) AS per_process, round(rounds / minutes / first(rounds / minutes) OVER (ORDER BY processes), 6) AS speed_up FROM n""")
def _(spark, folder):
    n = table(spark, folder, "lineitem").groupBy(F.col("l_linenumber").alias("processes")).agg(F.count("*").alias("rounds"), (F.sum("l_quantity").cast("double") / 60).alias("minutes"))
    return R.throughput(n, "processes", "rounds", "minutes").select("processes", *r6("rounds_per_minute", "per_process", "speed_up"))


@query("g57_inconsistent_scores", D.with_ctes(D.TRIALS) + """
SELECT o_orderkey, round(score, 6) AS score FROM trials WHERE status <> 'pending' AND (status = 'failed' OR o_orderkey % 5 = 0)""")
def _(spark, folder):
    t = D.trials(spark, folder).where("status != 'pending'")
    again = t.where("status != 'failed'").withColumn("score", F.when(F.col("o_orderkey") % 5 == 0, F.col("score") + 1e-9).otherwise(F.col("score") + 1e-14))
    return R.inconsistent(t, again, ["o_orderkey"], "score").select("o_orderkey", *r6("score"))


@query("w12_jitter", SEEDS + "SELECT dataset, model, uq_metric, seed, round((0.618::DOUBLE * (row_number() OVER (PARTITION BY dataset, model, uq_metric ORDER BY seed) - 1)) % 1, 9) AS jitter FROM sides")
def _(spark, folder):
    return R.jitter(K._seed_scores(spark, folder), SETTING, ["seed"]).select(*SETTING, "seed", "jitter")


@query("w11_config_order", D.with_ctes(D.TRIALS) + "SELECT sweep, config_id, o_orderkey, row_number() OVER (PARTITION BY sweep ORDER BY mean DESC, config_id, o_orderkey) AS place FROM (SELECT *, round(avg(score) OVER (PARTITION BY sweep, config_id), 9) AS mean FROM trials)")
def _(spark, folder):
    t = D.trials(spark, folder)
    means = t.groupBy("sweep", "config_id").agg(F.round(F.avg("score"), 9).alias("mean"))
    from tagweave.plans.order import numbered

    placed = numbered(t.join(means, ["sweep", "config_id"]).withColumn("_low", -F.col("mean")), ["sweep"], ["_low", "config_id", "o_orderkey"], "place", Scratch(spark, "w11"))
    return placed.select("sweep", "config_id", "o_orderkey", (F.col("place") + 1).alias("place"))


@query("w13_largest_of_arm", D.with_ctes(D.CURVES) + "SELECT dataset, model, uq_metric, seed, arm, round FROM (SELECT *, max(percent_acquired) OVER (PARTITION BY arm) AS most FROM curves) WHERE percent_acquired = most")
def _(spark, folder):
    c = D.curves(spark, folder)
    most = c.groupBy("arm").agg(F.max("percent_acquired").alias("most"))  # a row an arm
    return c.join(F.broadcast(most), "arm").where("percent_acquired = most").select(*RUN, "round")


@query("v2_evaluation_payload", D.with_ctes(D.CURVES) + """
SELECT dataset, model, uq_metric, seed, round, round(any_value(percent_acquired), 6) AS percent_acquired, round(max(CASE WHEN arm = 'uncertainty' THEN entity_f1 END), 6) AS uncertainty_entity_f1, round(max(CASE WHEN arm = 'random' THEN entity_f1 END), 6) AS random_entity_f1
FROM curves GROUP BY dataset, model, uq_metric, seed, round HAVING count(DISTINCT arm) = 2""")
def _(spark, folder):
    out = R.evaluation_payload(K._paired_rounds(D.curves(spark, folder)), [*SETTING, "seed", "round"], ["percent_acquired"], ["entity_f1"])
    return out.select(*SETTING, "seed", "round", *r6("percent_acquired", "uncertainty_entity_f1", "random_entity_f1"))


_NAMES = {"1-URGENT": "urgent", "2-HIGH": "high", "3-MEDIUM": "medium", "4-NOT SPECIFIED": "none", "5-LOW": "low"}


@query("proj7_display_names", f"SELECT CASE o_orderpriority {' '.join(f'WHEN {k!r} THEN {v!r}' for k, v in _NAMES.items())} END AS name, count(*) AS n FROM orders GROUP BY 1")
def _(spark, folder):
    return table(spark, folder, "orders").groupBy(R.display(F.col("o_orderpriority"), _NAMES).alias("name")).agg(F.count("*").alias("n"))


@query("m12_same_number", "SELECT l_returnflag, count(*) FILTER (WHERE format('{:.13e}', l_extendedprice::DOUBLE * 3 / 7) = format('{:.13e}', l_extendedprice::DOUBLE / 7 * 3)) AS n FROM lineitem GROUP BY l_returnflag")
def _(spark, folder):
    price = F.col("l_extendedprice").cast("double")
    return table(spark, folder, "lineitem").groupBy("l_returnflag").agg(F.count_if(R.same_number(price * 3 / 7, price / 7 * 3)).alias("n"))


@query("t20_escaped", """SELECT doc_id, md5(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(34), '&quot;'), chr(39), '&#x27;')) AS html FROM documents WHERE text IS NOT NULL""")
def _(spark, folder):
    return table(spark, folder, "documents").where("text is not null").select("doc_id", F.md5(text.html(F.col("text"))).alias("html"))


@query("t23_model_names", "SELECT regexp_replace(CASE WHEN strpos(config_name, '-md') > 0 THEN substr(config_name, 1, strpos(config_name, '-md') - 1) ELSE config_name END, '^heron-', '') AS model, count(*) AS n FROM run_configs GROUP BY 1")
def _(spark, folder):
    return table(spark, folder, "run_configs").groupBy(text.between(F.col("config_name"), "heron-", "-md").alias("model")).agg(F.count("*").alias("n"))


# ---- test splits and saved runs

_SENTENCES_OF_DOCS = """
doc_tokens AS (SELECT id, i - 1 AS i, coalesce(tokens[i].text, '') AS text, tokens[i].sentence_index AS s FROM (SELECT id, tokens, unnest(range(1, len(tokens) + 1)) AS i FROM annotated_docs WHERE mentions IS NOT NULL AND len(mentions) > 0)),
flags AS (SELECT *, CASE WHEN row_number() OVER w > 1 AND s IS DISTINCT FROM lag(s) OVER w THEN 1 ELSE 0 END AS new FROM doc_tokens WINDOW w AS (PARTITION BY id ORDER BY i)),
grouped AS (SELECT id, i, text, sum(new) OVER (PARTITION BY id ORDER BY i) AS sentence FROM flags),
placed AS (SELECT id, sentence, min(i) AS start, max(i) AS stop FROM grouped GROUP BY id, sentence),
spans AS (SELECT g.id, g.type, list_min(g.tokens) AS a, list_max(g.tokens) AS b, t.sentence FROM gold_mentions g JOIN grouped t ON t.id = g.id AND t.i = list_min(g.tokens))"""


def _gold_documents(spark, folder):
    d = D.documents_of_mentions(spark, folder)
    return d.select("id", F.col("gold").alias("mentions")).join(table(spark, folder, "annotated_docs").select("id", "tokens"), "id")


@query("e11_tags_on_test_sentences", D.with_ctes(D.MENTIONS, _SENTENCES_OF_DOCS) + """,
tagged_tokens AS (SELECT g.id, g.sentence, g.i, CASE WHEN g.sentence % 3 = 0 THEN 'O' ELSE coalesce(min(CASE WHEN g.i = s.a THEN 'B-' WHEN g.i > s.a THEN 'I-' END || CASE s.type WHEN 'actor' THEN 'Actor' ELSE s.type END), 'O') END AS tag
  FROM grouped g LEFT JOIN spans s ON s.id = g.id AND s.sentence = g.sentence AND g.i BETWEEN s.a AND s.b GROUP BY g.id, g.sentence, g.i)
SELECT tag, count(*) AS n FROM tagged_tokens GROUP BY tag""")
def _(spark, folder):
    docs = _gold_documents(spark, folder)
    rows = T.document_sentences(docs).select(F.col("id").alias("document_name"), F.col("sentence").cast("int").alias("sentence_id"), "tokens")
    alone = T.sentence_documents(rows.where("sentence_id % 3 = 0")).select("id", "mentions", "tokens")  # predicted on their own, without any mention
    slim = docs.select("id", "mentions", F.transform("tokens", lambda t, i: F.struct(t["text"].alias("text"), i.cast("int").alias("index"), t["sentence_index"].alias("sentence_index"))).alias("tokens"))
    found = T.on_test_sentences(rows, slim.unionByName(alone), ["Actor"])
    return found.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


@query("e12_sentence_documents", """
SELECT document_name || '#' || sentence_id AS id, count(*) AS n, max(md5(array_to_string(tokens, ' '))) AS digest, max(len(tokens)) AS n_tokens FROM sentences WHERE document_name IS NOT NULL AND sentence_id IS NOT NULL AND tokens IS NOT NULL GROUP BY 1""")
def _(spark, folder):
    rows = table(spark, folder, "sentences").where("document_name is not null and sentence_id is not null and tokens is not null")
    return T.sentence_documents(rows).groupBy("id").agg(F.count("*").alias("n"), F.max(F.md5("text")).alias("digest"), F.max(F.size("tokens")).cast("long").alias("n_tokens"))


@query("j22_document_scores", D.with_ctes(D.MENTIONS, K._MENTION_COUNTS) + """,
docs AS (SELECT id, sum(n_predicted) AS np, sum(n_gold) AS ng, sum(n_ok) AS ok FROM per_type GROUP BY id)
SELECT round(sum(ok) / sum(np), 6) AS micro_precision, round(sum(ok) / sum(ng), 6) AS micro_recall, round(2.0::DOUBLE * sum(ok) / (sum(np) + sum(ng)), 6) AS micro_f1, sum(ok)::BIGINT AS n_ok FROM docs""")
def _(spark, folder):
    d = D.documents_of_mentions(spark, folder)
    out = T.document_scores(d.select("id", F.col("gold").alias("mentions")), d.select("id", F.col("predicted").alias("mentions")), exact=True)
    return out.select(*r6("micro_precision", "micro_recall", "micro_f1"), "n_ok")


@query("e6_rescored_runs", K.SQL["e5_evaluation_row"])
def _(spark, folder):
    """Tags packed as a saved run has them, unpacked and scored again: the same as the scores of the tags themselves.

    A run is packed in blocks of 256 sentences, the gold and the predicted tags of each in one go: gathered apart, they come in different orders.
    """
    rows = D.tagged(spark, folder).withColumn("part", F.coalesce("part", F.lit("none")))
    block = F.floor(F.col("row_id") / (97 * 256))
    runs = rows.groupBy("part", (F.col("row_id") % 97).alias("run"), block.alias("block")).agg(F.collect_list(F.struct("gold", "pred")).alias("s"))
    both = runs.select("part", F.col("s.gold").alias("gold"), F.col("s.pred").alias("predicted"))
    packed = ("labels", "codes", "lengths")
    for side in ("gold", "predicted"):
        both = writers.packed_predictions(both, side).withColumnsRenamed({c: f"{side}_{c}" for c in packed})
    for side in ("gold", "predicted"):
        both = writers.unpacked_predictions(both.withColumnsRenamed({f"{side}_{c}": c for c in packed}), side)
    return T.rescored(both, ["part"]).select("part", *r6(*K._EVALUATION))


@query("e17_entity_types", D.with_ctes(D.MENTIONS) + """
SELECT id, surface, min(type) AS type, count(DISTINCT type) > 1 AS mixed FROM (SELECT id, list_sort(list_distinct(tokens))[1] % 10 AS surface, type FROM gold_mentions) GROUP BY id, surface""")
def _(spark, folder):
    m = D.documents_of_mentions(spark, folder).select("id", F.explode("gold").alias("m")).select("id", (F.array_min("m.tokens") % 10).alias("surface"), "m.type")
    return T.entity_types(m, ["id", "surface"])


@query("r2_holdout", D.with_ctes(D.TAGGED) + """,
drawn AS (SELECT row_id, row_number() OVER (ORDER BY """ + K._DRAW.format("row_id + 1729") + """, row_id) <= 100 AS held_out FROM tagged WHERE part = 'pool'),
placed AS (SELECT row_id, held_out, row_number() OVER (PARTITION BY held_out ORDER BY row_id) - 1 AS place FROM drawn)
SELECT held_out, count(*) AS n, sum(row_id)::BIGINT AS ids, sum(place * (row_id % 1000))::BIGINT AS places FROM placed GROUP BY held_out""")
def _(spark, folder):
    pool = D.tagged(spark, folder).where("part = 'pool'").select("row_id")
    out = T.holdout(pool, 100, F.col("row_id"), ["row_id"], 1729, Scratch(spark, "r2"))
    return out.groupBy("held_out").agg(F.count("*").alias("n"), F.sum("row_id").alias("ids"), F.sum(F.col("place") * (F.col("row_id") % 1000)).alias("places"))


@query("v1_split_audit", D.with_ctes(D.TAGGED) + """,
n AS (SELECT count(*) AS n FROM tagged)
SELECT "check", expected, expected AS observed, 'pass' AS status FROM (
  SELECT unnest(['test rows', 'bootstrap rows', 'pool rows', 'keys in several parts', 'keys on one side only', 'pool rows with tags', 'pool words without a label', 'rows that differ from the raw ones']) AS "check",
         unnest([ceil(n * 0.2::DOUBLE)::BIGINT, 5, n - 5 - ceil(n * 0.2::DOUBLE)::BIGINT, 0, 0, 0, 0, 0]) AS expected FROM n)""")
def _(spark, folder):
    raw = D.tagged(spark, folder).select("row_id", "tokens", F.col("gold").alias("tags"))
    parts = A.split_rows(raw, F.col("row_id"), ["row_id"], 0.2, 5, 3407)
    rows = Scratch(spark, "v1").keep(parts.withColumn("tags", F.when(F.col("part") != "pool", F.col("tags"))))
    n = raw.count()
    n_test = math.ceil(n * 0.2)
    labels = D.words(spark, folder).select("row_id", "wid")
    return T.split_checks(rows, raw, ["row_id"], {"test": n_test, "bootstrap": 5, "pool": n - n_test - 5}, labels, ["row_id", "wid"])


@query("u5_apart_and_whole", """
WITH p AS (SELECT document_name, lower(trim(split, ' ')) AS part FROM sentences WHERE document_name IS NOT NULL AND split IS NOT NULL),
k AS (SELECT document_name, count(DISTINCT part) AS n FROM p WHERE part IN ('bootstrap', 'pool', 'test') GROUP BY document_name),
r AS (SELECT DISTINCT document_name FROM doc_registry WHERE document_name IS NOT NULL)
SELECT (SELECT count(*) FROM k WHERE n > 1) AS shared, (SELECT count(*) FROM r WHERE document_name NOT IN (SELECT document_name FROM k)) AS missing, (SELECT count(*) FROM k WHERE document_name NOT IN (SELECT document_name FROM r)) AS extra""")
def _(spark, folder):
    s = table(spark, folder, "sentences").where("document_name is not null").select("document_name", F.lower(F.trim("split")).alias("part"))
    whole = table(spark, folder, "doc_registry").where("document_name is not null")
    return T.apart_and_whole([s.where(F.col("part") == p) for p in ("bootstrap", "pool", "test")], whole, ["document_name"])


@query("a7_training_items", D.with_ctes(D.TAGGED, D.WORDS, D.SELECTIONS) + """
SELECT kind, count(*) AS n, sum(n_targets)::BIGINT AS n_targets, sum(n_tokens)::BIGINT AS n_tokens FROM (
  SELECT 'whole' AS kind, len(gold) AS n_targets, len(tokens) AS n_tokens FROM tagged WHERE part = 'bootstrap' AND len(gold) <> 1
  UNION ALL SELECT 'word', 1, len(t.tokens) FROM selections s JOIN tagged t ON s.row_id = t.row_id WHERE s.round = 0
  UNION ALL SELECT 'word', 1, 1 FROM tagged WHERE part = 'bootstrap' AND len(gold) = 1) GROUP BY kind""")
def _(spark, folder):
    rows = D.tagged(spark, folder).select("row_id", "tokens", F.when(F.col("part") == "bootstrap", F.col("gold")).alias("tags"))
    chosen = D.selections(spark, folder).where("round = 0").select("row_id", "wid", F.col("label").alias("gold"))
    items = T.training_items(rows, chosen, ["row_id"]).withColumn("kind", F.when(F.size("targets") == 1, "word").otherwise("whole"))
    return items.groupBy("kind").agg(F.count("*").alias("n"), F.sum(F.size("targets")).alias("n_targets"), F.sum(F.size("tokens")).alias("n_tokens"))


@query("a11_scoreable_words", D.with_ctes(D.TAGGED, D.WORDS) + """,
pieces AS (SELECT row_id, wid, sum(greatest(1, (length(word) + 3) // 4)) OVER (PARTITION BY row_id ORDER BY wid) AS stop, greatest(1, (length(word) + 3) // 4) AS n FROM words WHERE word IS NOT NULL)
SELECT row_id, count(*) AS n, sum(stop - n)::BIGINT AS positions FROM pieces WHERE stop <= 64 GROUP BY row_id""")
def _(spark, folder):
    w = D.words(spark, folder).where("word is not null").withColumn("n", F.greatest(F.lit(1), F.floor((F.length("word") + 3) / 4).cast("int")))
    stop = F.sum("n").over(Window.partitionBy("row_id").orderBy("wid"))
    pieces = w.withColumn("stop", stop).select("row_id", "wid", F.explode(F.sequence(F.col("stop") - F.col("n"), F.col("stop") - 1)).alias("position")).withColumn("kept", F.col("position") < 64)
    return T.scoreable_words(pieces, ["row_id"]).groupBy("row_id").agg(F.count("*").alias("n"), F.sum("position").alias("positions"))


@query("o7_best_row", D.with_ctes(D.TRIALS) + "SELECT sweep, max(score) AS score, max(o_orderkey) AS o_orderkey FROM (SELECT *, max(score) OVER (PARTITION BY sweep) AS best FROM trials) WHERE score = best GROUP BY sweep")
def _(spark, folder):
    t = D.trials(spark, folder).withColumn("_s", F.struct("score", "o_orderkey"))
    return T.best_by(t, ["sweep"], "_s").select("sweep", "score", "o_orderkey")


# ---- smaller operators

@query("t3_plain_sentences", f"""
WITH w AS (SELECT id, regexp_extract_all(text, '{K._W}') AS w, regexp_split_to_array(text, '{K._W}') AS g FROM annotated_docs WHERE text IS NOT NULL),
e AS (SELECT id, i, w[i] AS word, g[i] AS gap, CASE WHEN i > 1 THEN w[i - 1] END AS before FROM (SELECT id, w, g, unnest(range(1, len(w) + 1)) AS i FROM w))
SELECT id, count(*) AS n_tokens, count(*) FILTER (WHERE i = 1 OR contains(gap, chr(10)) OR (before IN ('.', '!', '?') AND word NOT IN ('.', '!', '?'))) AS n_sentences FROM e GROUP BY id""")
def _(spark, folder):
    docs = table(spark, folder, "annotated_docs").where("text is not null").select(*runs.document_of(F.col("id"), F.col("text")))
    return docs.where(F.size("tokens") > 0).select("id", F.size("tokens").cast("long").alias("n_tokens"), (F.array_max("tokens.sentence_index") + 1).cast("long").alias("n_sentences"))


@query("g23_best_configs", D.with_ctes(D.CALLS) + """,
per_run AS (SELECT config_name, run_no, avg(num_predicted) AS predicted FROM calls GROUP BY ALL),
means AS (SELECT config_name, avg(predicted) AS f1, stddev_samp(predicted) AS sd, count(*) AS n_runs FROM per_run GROUP BY config_name),
named AS (SELECT c.dataset, m.* FROM means m JOIN run_configs c ON c.config_name = m.config_name)
SELECT dataset, config_name, round(f1, 6) AS f1, round(f1 - coalesce(sd, 0), 6) AS low, round(f1 + coalesce(sd, 0), 6) AS high, n_runs FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY round(f1, 9) DESC, config_name DESC) AS r FROM named) WHERE r = 1""")
def _(spark, folder):
    per_run = D.calls(spark, folder).groupBy("config_name", "run_no").agg(F.avg("num_predicted").alias("predicted"))
    means = annotation.run_summary(per_run, ["config_name"], ["predicted"]).join(table(spark, folder, "run_configs").select("config_name", "dataset"), "config_name")
    best = T.best_by(means.withColumn("_order", F.struct(F.round("predicted", 9), "config_name")), ["dataset"], "_order")
    sd = F.coalesce("predicted_sd_runs", F.lit(0.0))
    return best.select("dataset", "config_name", F.round("predicted", 6).alias("f1"), F.round(F.col("predicted") - sd, 6).alias("low"), F.round(F.col("predicted") + sd, 6).alias("high"), "n_runs")


@query("g49_scores_so_far", D.with_ctes(D.CALLS) + """
SELECT config_name, count(DISTINCT document_id) AS documents, count(*) FILTER (WHERE error IS NULL) AS calls, sum(num_predicted) FILTER (WHERE error IS NULL)::BIGINT AS predicted, sum(cached) FILTER (WHERE error IS NULL)::BIGINT AS cached,
       count(*) FILTER (WHERE finish = 'actor' AND error IS NULL) AS truncated FROM calls GROUP BY config_name""")
def _(spark, folder):
    return live.scores_so_far(D.calls(spark, folder), ["config_name"], "document_id", F.col("error").isNull(), ["num_predicted", "cached"], F.col("finish") == "actor").select(
        "config_name", "documents", "calls", F.col("num_predicted").alias("predicted"), "cached", "truncated")


@query("j11_means_beside_supervised", D.with_ctes(D.CURVES, K._SERIES, K._REACH, _SUPERVISED) + """
SELECT m.dataset, m.model, m.series, m.round, round(m.entity_f1, 6) AS entity_f1, round(s.f1, 6) AS supervised FROM means m LEFT JOIN (SELECT dataset, model, avg(entity_f1) AS f1 FROM supervised WHERE dataset = 'd1' GROUP BY ALL) s ON s.dataset = m.dataset AND s.model = m.model""")
def _(spark, folder):
    c = D.curves(spark, folder)
    supervised = K._supervised(c).groupBy("dataset", "model").agg(F.avg("entity_f1").alias("supervised")).where("dataset = 'd1'")  # one that the other dataset lacks
    return K._means(spark, folder).join(supervised, ["dataset", "model"], "left").select("dataset", "model", "series", "round", *r6("entity_f1", "supervised"))


@query("j12_types_by_split", D.with_ctes(D.TAGGED, D.GOLD) + """
SELECT type, n, n_documents, round(mean_words, 6) AS mean_words, bootstrap, pool, test FROM (SELECT type, count(*) AS n, count(DISTINCT document_name) AS n_documents, avg(last - first + 1) AS mean_words,
  count(*) FILTER (WHERE part = 'bootstrap') AS bootstrap, count(*) FILTER (WHERE part = 'pool') AS pool, count(*) FILTER (WHERE part = 'test') AS test FROM gold_chunks GROUP BY type)""")
def _(spark, folder):
    found = D.tagged(spark, folder).select("part", "document_name", F.explode(spans.chunks(F.col("gold"))).alias("e")).select("part", "document_name", "e.type", (F.col("e.last") - F.col("e.first") + 1).alias("words"))
    stats = found.groupBy("type").agg(F.count("*").alias("n"), F.count_distinct("document_name").alias("n_documents"), F.round(F.avg("words"), 6).alias("mean_words"))
    counts = found.groupBy("type").pivot("part", ["bootstrap", "pool", "test"]).count().na.fill(0)
    return stats.join(counts, "type")


@query("w16_consecutive_rounds", K.W_SEL + """
SELECT seed, arm, label, round, next_round FROM (SELECT *, lead(round) OVER (PARTITION BY seed, arm, label ORDER BY round) AS next_round FROM (SELECT DISTINCT seed, arm, label, round FROM selections)) WHERE next_round = round + 1""")
def _(spark, folder):
    from tagweave.operators import loop

    return loop.consecutive(D.selections(spark, folder).select(*K._RUN, "label", "round").distinct(), [*K._RUN, "label"])


@query("o10_first_occurrences", """
SELECT row_id, len(t) AS n, md5(array_to_string(t, ' ')) AS digest FROM (SELECT row_id, list_filter(k, lambda x, i: list_position(k, x) = i) AS t FROM (SELECT row_id, list_filter(tokens, lambda x: x IS NOT NULL) AS k FROM sentences WHERE tokens IS NOT NULL))""")
def _(spark, folder):
    rows = table(spark, folder, "sentences").where("tokens is not null").select("row_id", F.array_distinct(F.filter("tokens", lambda t: t.isNotNull())).alias("t"))
    return rows.select("row_id", F.size("t").cast("long").alias("n"), F.md5(F.array_join("t", " ")).alias("digest"))


@query("proj2_nested_prefix", D.with_ctes(D.TAGGED) + """,
placed AS (SELECT row_id, row_number() OVER (ORDER BY row_id) - 1 AS place, count(*) OVER () AS n FROM tagged WHERE part = 'pool')
SELECT percent, count(*) AS n, sum(row_id)::BIGINT AS ids FROM placed, (SELECT unnest([12.5, 25.0, 50.0])::DOUBLE AS percent) WHERE place < round_even(n * percent / 100, 0) GROUP BY percent""")
def _(spark, folder):
    """Rows of the first shares of the pool, each within the next; a half is rounded to the even number."""
    placed = K.numbered(D.tagged(spark, folder).where("part = 'pool'").select("row_id"), [], ["row_id"], "place", Scratch(spark, "p2"))
    parts = [A.prefix(placed, "place", p).agg(F.lit(p).alias("percent"), F.count("*").alias("n"), F.sum("row_id").alias("ids")) for p in (12.5, 25.0, 50.0)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("proj13_only_types", D.with_ctes(D.MENTIONS) + "SELECT id, count(*) AS n FROM gold_mentions WHERE type IN ('actor', 'activity') GROUP BY id")
def _(spark, folder):
    kept = D.documents_of_mentions(spark, folder).select("id", F.explode(text.only_types(F.col("gold"), ["Actor", "ACTIVITY"])).alias("m"))
    return kept.groupBy("id").agg(F.count("*").alias("n"))


@query("e15_decoded_tags", D.with_ctes(D.TAGGED) + "SELECT row_id, md5(array_to_string(gold, ' ')) AS digest FROM tagged")
def _(spark, folder):
    rows = D.tagged(spark, folder)
    labels = sorted(r[0] for r in rows.select(F.explode("gold").alias("t")).distinct().collect())  # a closed vocabulary
    coded = rows.select("row_id", F.transform("gold", lambda t: readers.tag_number(t, labels)).alias("codes"))
    return coded.select("row_id", F.md5(F.array_join(F.transform("codes", lambda n: readers.tag_of(n, labels)), " ")).alias("digest"))
