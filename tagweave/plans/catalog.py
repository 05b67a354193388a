"""The queries over the annotation engine's own operators, by name, with their SQL.

Each runs over whole tables. Names begin with the operator's number in the inventory.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tagweave.functions import spans, text
from tagweave.operators import annotation, curves as C, evaluation as E, profile as P, quality as V, selection as A, stats as ST, ledger as L
from tagweave.plans import adapters as D
from tagweave.operators import loop
from tagweave.plans.order import numbered
from tagweave.plans.runtime import Scratch, table
from tagweave.streaming import live

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

RUN = ["dataset", "model", "uq_metric", "seed", "arm"]
SETTING = ["dataset", "model", "uq_metric"]
TARGETS = [0.1, 0.2, 0.3, 0.5]
BUDGETS = [10.0, 25.0, 50.0]


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def r6(*columns: str) -> list:
    return [F.round(F.col(c), 6).alias(c) for c in columns]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


# ---- entities and their scores

ALL = D.with_ctes(D.TAGGED, D.GOLD, D.PRED)
_TYPE_COUNTS = """
counts AS (
  SELECT part, type, sum(p) AS n_predicted, sum(g) AS n_gold, sum(ok) AS n_ok FROM (
    SELECT part, type, 1 AS p, 0 AS g, 0 AS ok FROM pred_chunks UNION ALL SELECT part, type, 0, 1, 0 FROM gold_chunks
    UNION ALL SELECT p.part, p.type, 0, 0, 1 FROM pred_chunks p JOIN gold_chunks g ON p.row_id = g.row_id AND p.type = g.type AND p.first = g.first AND p.last = g.last)
  GROUP BY part, type)"""


@query("e1_bio_chunks", ALL + "SELECT part, type, count(*) AS n, CAST(sum(last - first + 1) AS BIGINT) AS n_words FROM gold_chunks GROUP BY part, type")
def _(spark, folder):
    rows = D.tagged(spark, folder).select("part", F.explode(spans.chunks(F.col("gold"))).alias("e"))
    return rows.groupBy("part", F.col("e.type").alias("type")).agg(F.count("*").alias("n"), F.sum(F.col("e.last") - F.col("e.first") + 1).alias("n_words"))


@query("e2_exact_type_counts", D.with_ctes(D.TAGGED, D.GOLD, D.PRED, _TYPE_COUNTS) + "SELECT part, type, n_predicted::BIGINT AS n_predicted, n_gold::BIGINT AS n_gold, n_ok::BIGINT AS n_ok FROM counts")
def _(spark, folder):
    return E.exact_type_counts(D.tagged(spark, folder), ["part"])


@query("e2_exact_entity_scores", D.with_ctes(D.TAGGED, D.GOLD, D.PRED, _TYPE_COUNTS) + """
SELECT part, round(p, 6) AS entity_precision, round(r, 6) AS entity_recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS entity_f1, round(m, 6) AS entity_macro_f1 FROM (
  SELECT part, CASE WHEN sum(n_predicted) > 0 THEN sum(n_ok) / sum(n_predicted) ELSE 0 END AS p, CASE WHEN sum(n_gold) > 0 THEN sum(n_ok) / sum(n_gold) ELSE 0 END AS r,
         avg(CASE WHEN n_ok > 0 THEN 2.0::DOUBLE * n_ok / (n_predicted + n_gold) ELSE 0 END) AS m FROM counts GROUP BY part)""")
def _(spark, folder):
    return E._of_types(E.exact_type_counts(D.tagged(spark, folder), ["part"]), ["part"], "entity_").select("part", *r6("entity_precision", "entity_recall", "entity_f1", "entity_macro_f1"))


# Greedy matching, predicted entity by predicted entity: each takes the first gold one of its type that meets it and isn't taken.
_GREEDY = """
gold_numbered AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY first) AS m FROM gold_chunks),
pred_numbered AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY first) AS k FROM pred_chunks),
choices AS (SELECT p.row_id, p.part, p.type, p.k, coalesce(list(g.m ORDER BY g.m) FILTER (WHERE g.m IS NOT NULL), []) AS near
            FROM pred_numbered p LEFT JOIN gold_numbered g ON g.row_id = p.row_id AND g.type = p.type AND g.first <= p.last AND g.last >= p.first GROUP BY ALL),
walk AS (SELECT DISTINCT row_id, 0::BIGINT AS k, []::BIGINT[] AS taken, NULL::VARCHAR AS part, NULL::VARCHAR AS type, false AS hit FROM choices
  UNION ALL SELECT row_id, k, CASE WHEN len(free) > 0 THEN list_append(taken, free[1]) ELSE taken END, part, type, len(free) > 0
  FROM (SELECT c.row_id, c.k, w.taken, c.part, c.type, list_filter(c.near, lambda m: NOT list_contains(w.taken, m)) AS free FROM walk w JOIN choices c ON c.row_id = w.row_id AND c.k = w.k + 1)),
partial AS (
  SELECT part, type, sum(p)::BIGINT AS n_predicted, sum(g)::BIGINT AS n_gold, sum(ok)::BIGINT AS n_ok FROM (
    SELECT part, type, 1 AS p, 0 AS g, 0 AS ok FROM pred_chunks UNION ALL SELECT part, type, 0, 1, 0 FROM gold_chunks UNION ALL SELECT part, type, 0, 0, 1 FROM walk WHERE hit) GROUP BY part, type)"""


@query("e3_partial_type_counts", D.with_ctes(D.TAGGED, D.GOLD, D.PRED, _GREEDY).replace("WITH ", "WITH RECURSIVE ", 1) + "SELECT part, type, n_predicted, n_gold, n_ok FROM partial")
def _(spark, folder):
    return E.partial_type_counts(D.tagged(spark, folder), ["part"])


@query("e4_token_accuracy", D.with_ctes(D.TAGGED, D.WORDS) + "SELECT part, round(sum(CASE WHEN gold = pred THEN 1 ELSE 0 END) / count(*), 6) AS token_accuracy FROM words GROUP BY part")
def _(spark, folder):
    return E.token_accuracy(D.tagged(spark, folder), ["part"]).select("part", *r6("token_accuracy"))


def _of_counts(source: str, prefix: str) -> str:
    p, r = "CASE WHEN sum(n_predicted) > 0 THEN sum(n_ok) / sum(n_predicted) ELSE 0 END", "CASE WHEN sum(n_gold) > 0 THEN sum(n_ok) / sum(n_gold) ELSE 0 END"
    return (f"(SELECT coalesce(part, 'none') AS part, round({p}, 6) AS {prefix}precision, round({r}, 6) AS {prefix}recall, round(CASE WHEN sum(n_ok) > 0 THEN 2.0::DOUBLE * sum(n_ok) / (sum(n_predicted) + sum(n_gold)) ELSE 0 END, 6) AS {prefix}f1, "
            f"round(avg(CASE WHEN n_ok > 0 THEN 2.0::DOUBLE * n_ok / (n_predicted + n_gold) ELSE 0 END), 6) AS {prefix}macro_f1 FROM {source} GROUP BY part)")


_EVALUATION = ["token_accuracy", *(f"entity_{p}{n}" for p in ("", "partial_") for n in ("precision", "recall", "f1", "macro_f1"))]


@query("e5_evaluation_row", D.with_ctes(D.TAGGED, D.WORDS, D.GOLD, D.PRED, _TYPE_COUNTS, _GREEDY).replace("WITH ", "WITH RECURSIVE ", 1) + f"""
SELECT a.part, {", ".join(_EVALUATION)} FROM (SELECT coalesce(part, 'none') AS part, round(sum(CASE WHEN gold = pred THEN 1 ELSE 0 END) / count(*), 6) AS token_accuracy FROM words GROUP BY 1) a
JOIN {_of_counts("counts", "entity_")} e ON a.part = e.part JOIN {_of_counts("partial", "entity_partial_")} p ON a.part = p.part""")
def _(spark, folder):
    rows = D.tagged(spark, folder).withColumn("part", F.coalesce("part", F.lit("none")))
    return E.evaluation(rows, ["part"]).select("part", *r6(*_EVALUATION))


@query("e7_entity_listing", ALL + """
SELECT side, type, matched, count(*) AS n FROM (
  SELECT 'gold' AS side, type, EXISTS (SELECT 1 FROM pred_chunks p WHERE p.row_id = g.row_id AND p.type = g.type AND p.first = g.first AND p.last = g.last) AS matched FROM gold_chunks g
  UNION ALL
  SELECT 'predicted', type, EXISTS (SELECT 1 FROM gold_chunks g WHERE p.row_id = g.row_id AND p.type = g.type AND p.first = g.first AND p.last = g.last) FROM pred_chunks p)
GROUP BY ALL""")
def _(spark, folder):
    return E.entity_listing(D.tagged(spark, folder), ["row_id"]).groupBy("side", "type", "matched").agg(F.count("*").alias("n"))


_MENTION_COUNTS = """
keyed AS (SELECT id, type, list_sort(list_distinct(tokens)) AS t, 1 AS p, 0 AS g FROM pred_mentions UNION ALL SELECT id, type, list_sort(list_distinct(tokens)), 0, 1 FROM gold_mentions),
each AS (SELECT id, type, t, sum(p) AS p, sum(g) AS g, least(sum(p), sum(g)) AS ok FROM keyed GROUP BY id, type, t),
per_type AS (SELECT id, type, sum(p)::BIGINT AS n_predicted, sum(g)::BIGINT AS n_gold, sum(ok)::BIGINT AS n_ok FROM each GROUP BY id, type)"""


@query("e8_mention_counts_exact", D.with_ctes(D.MENTIONS, _MENTION_COUNTS) + "SELECT type, sum(n_predicted)::BIGINT AS n_predicted, sum(n_gold)::BIGINT AS n_gold, sum(n_ok)::BIGINT AS n_ok FROM per_type GROUP BY type")
def _(spark, folder):
    counts = E.mention_counts(D.documents_of_mentions(spark, folder), ["id"], predicted="predicted", exact=True)
    return counts.groupBy("type").agg(*(F.sum(c).alias(c) for c in ("n_predicted", "n_gold", "n_ok")))


_GREEDY_SETS = """
choices AS (SELECT p.id, p.type, row_number() OVER (PARTITION BY p.id ORDER BY p.no) AS k, coalesce((SELECT list(g.no ORDER BY g.no) FROM gold_mentions g WHERE g.id = p.id AND g.type = p.type AND list_has_any(g.tokens, p.tokens)), []) AS near FROM pred_mentions p),
walk AS (SELECT DISTINCT id, 0::BIGINT AS k, []::BIGINT[] AS taken, NULL::VARCHAR AS type, false AS hit FROM choices
  UNION ALL SELECT id, k, CASE WHEN len(free) > 0 THEN list_append(taken, free[1]) ELSE taken END, type, len(free) > 0
  FROM (SELECT c.id, c.k, w.taken, c.type, list_filter(c.near, lambda m: NOT list_contains(w.taken, m)) AS free FROM walk w JOIN choices c ON c.id = w.id AND c.k = w.k + 1))"""


@query("e8_mention_counts_overlap", D.with_ctes(D.MENTIONS, _GREEDY_SETS).replace("WITH ", "WITH RECURSIVE ", 1) + """
SELECT type, sum(p)::BIGINT AS n_predicted, sum(g)::BIGINT AS n_gold, sum(ok)::BIGINT AS n_ok FROM (
  SELECT type, 1 AS p, 0 AS g, 0 AS ok FROM pred_mentions UNION ALL SELECT type, 0, 1, 0 FROM gold_mentions UNION ALL SELECT type, 0, 0, 1 FROM walk WHERE hit) GROUP BY type""")
def _(spark, folder):
    counts = E.mention_counts(D.documents_of_mentions(spark, folder), ["id"], predicted="predicted")
    return counts.groupBy("type").agg(*(F.sum(c).alias(c) for c in ("n_predicted", "n_gold", "n_ok")))


@query("e9_mention_summary", D.with_ctes(D.MENTIONS, _MENTION_COUNTS) + """,
docs AS (SELECT id, sum(n_predicted) AS np, sum(n_gold) AS ng, sum(n_ok) AS ok FROM per_type GROUP BY id),
scored AS (SELECT *, CASE WHEN np > 0 THEN ok / np WHEN ng = 0 THEN 1.0 ELSE 0.0 END AS p, CASE WHEN ng > 0 THEN ok / ng WHEN np = 0 THEN 1.0 ELSE 0.0 END AS r FROM docs)
SELECT round(avg(p), 6) AS macro_precision, round(stddev_pop(p), 6) AS macro_precision_sd, round(avg(r), 6) AS macro_recall, round(sum(ok) / sum(np), 6) AS micro_precision, round(sum(ok) / sum(ng), 6) AS micro_recall,
       round(avg(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END), 6) AS macro_f1, sum(ok)::BIGINT AS n_ok FROM scored""")
def _(spark, folder):
    counts = E.mention_counts(D.documents_of_mentions(spark, folder), ["id"], predicted="predicted", exact=True).withColumn("all", F.lit(1))
    return E.mention_summary(counts, ["all"], "id").select(*r6("macro_precision", "macro_precision_sd", "macro_recall", "micro_precision", "micro_recall", "macro_f1"), "n_ok")


@query("e10_sentence_tags", D.with_ctes(D.TAGGED) + """
SELECT tag, count(*) AS n FROM (SELECT unnest(list_transform(gold, lambda t, i: CASE
  WHEN t = 'O' THEN 'O' WHEN t LIKE 'B-%' OR i = 1 OR gold[i - 1] = 'O' OR substr(gold[i - 1], 3) <> substr(t, 3) THEN 'B-' || substr(t, 3) ELSE 'I-' || substr(t, 3) END)) AS tag FROM tagged) GROUP BY tag""")
def _(spark, folder):
    found = D.tagged(spark, folder).select(F.size("gold").alias("n"), spans.chunks(F.col("gold")).alias("found"))
    rows = found.select(F.explode(spans.tags_of(F.col("found"), F.col("n"))).alias("tag"))
    return rows.groupBy("tag").agg(F.count("*").alias("n"))


_ORDERED = """
ordered AS (SELECT document_name FROM tagged WHERE document_name IS NOT NULL GROUP BY document_name HAVING min(sentence_id) = 0 AND count(*) = count(DISTINCT sentence_id) AND max(sentence_id) = count(*) - 1)"""


@query("e13_documents_from_sentences", D.with_ctes(D.TAGGED, D.GOLD, _ORDERED) + """,
numbered AS (SELECT row_id, document_name, len(tokens) AS n, sum(len(tokens)) OVER (PARTITION BY document_name ORDER BY sentence_id) - len(tokens) AS start FROM tagged WHERE document_name IN (FROM ordered)),
found AS (SELECT n.document_name, count(*) AS n_mentions, sum(n.start + g.first)::BIGINT AS first_tokens FROM numbered n JOIN gold_chunks g ON n.row_id = g.row_id GROUP BY 1)
SELECT t.document_name, t.n_tokens, coalesce(f.n_mentions, 0) AS n_mentions, coalesce(f.first_tokens, 0) AS first_tokens FROM (SELECT document_name, sum(n)::BIGINT AS n_tokens FROM numbered GROUP BY 1) t LEFT JOIN found f ON t.document_name = f.document_name""")
def _(spark, folder):
    rows = D.tagged(spark, folder).where("document_name is not null")
    whole = rows.groupBy("document_name").agg(F.min("sentence_id").alias("a"), F.max("sentence_id").alias("b"), F.count("*").alias("n"), F.count_distinct("sentence_id").alias("k")).where("a = 0 and n = k and b = n - 1")
    ordered = rows.join(whole.select("document_name"), "document_name", "left_semi").select("document_name", "sentence_id", "tokens", F.col("gold").alias("tags"))
    docs = annotation.document_parts(ordered, Scratch(spark, "e13"))
    firsts = F.aggregate("mentions", F.lit(0).cast("long"), lambda a, m: a + m["first"])
    return docs.groupBy("document_name").agg(F.sum(F.size("tokens")).alias("n_tokens"), F.sum(F.size("mentions")).alias("n_mentions"), F.sum(firsts).alias("first_tokens"))


@query("e13_number_rule", D.with_ctes(D.TAGGED, _ORDERED) + "SELECT (document_name IN (FROM ordered)) AS whole, count(*) AS n FROM (SELECT DISTINCT document_name FROM tagged WHERE document_name IS NOT NULL) GROUP BY 1")
def _(spark, folder):
    """Which documents have sentences 0, 1, ... each once, by the rule that makes the operator refuse the others."""
    rows = D.tagged(spark, folder).where("document_name is not null").select("document_name", "sentence_id", "tokens", F.col("gold").alias("tags"))
    placed = annotation.document_parts(rows, Scratch(spark, "e13"), strict=False)
    return placed.groupBy("document_name").agg(F.every(F.col("in_order")).alias("whole")).groupBy("whole").agg(F.count("*").alias("n"))


@query("e14_lookup_baseline", D.with_ctes(D.TAGGED, D.WORDS) + """,
forms AS (SELECT lower(word) AS form, CASE WHEN gold = 'O' THEN 'O' ELSE substr(gold, 3) END AS type, count(*) AS n, min(row_id * 1000000 + wid) AS seen FROM words WHERE part IN ('bootstrap', 'pool') AND word IS NOT NULL GROUP BY 1, 2),
best AS (SELECT form, type FROM (SELECT *, row_number() OVER (PARTITION BY form ORDER BY n DESC, seen) AS r FROM forms) WHERE r = 1),
typed AS (SELECT w.row_id, w.wid, w.gold, coalesce(b.type, 'O') AS type FROM words w LEFT JOIN best b ON lower(w.word) = b.form WHERE w.part IN ('validation', 'test')),
tags AS (SELECT gold, CASE WHEN type = 'O' THEN 'O' WHEN lag(type) OVER (PARTITION BY row_id ORDER BY wid) = type THEN 'I-' || type ELSE 'B-' || type END AS tag FROM typed)
SELECT tag, count(*) AS n, sum(CASE WHEN tag = gold THEN 1 ELSE 0 END)::BIGINT AS n_right FROM tags GROUP BY tag""")
def _(spark, folder):
    w = D.words(spark, folder).withColumn("ord", F.col("row_id") * 1000000 + F.col("wid"))
    found = E.lookup_tags(w.where("part in ('bootstrap', 'pool') and word is not null"), w.where("part in ('validation', 'test')"), ["row_id"], Scratch(spark, "e14"))
    return found.groupBy("tag").agg(F.count("*").alias("n"), F.sum((F.col("tag") == F.col("gold")).cast("long")).alias("n_right"))


@query("x1_words", D.with_ctes(D.TAGGED, D.WORDS) + "SELECT part, count(*) AS n_words, count(DISTINCT word) AS n_forms, sum(wid)::BIGINT AS places FROM words GROUP BY part")
def _(spark, folder):
    return D.words(spark, folder).groupBy("part").agg(F.count("*").alias("n_words"), F.count_distinct("word").alias("n_forms"), F.sum("wid").alias("places"))


@query("x2_regrouped_words", D.with_ctes(D.TAGGED, D.WORDS) + """
SELECT t.part, count(*) AS n_rows, count(*) FILTER (WHERE b.again = t.gold) AS n_same FROM tagged t JOIN (SELECT row_id, list(gold ORDER BY wid) AS again FROM words GROUP BY row_id) b ON t.row_id = b.row_id GROUP BY t.part""")
def _(spark, folder):
    back = D.words(spark, folder).groupBy("row_id", "part").agg(F.transform(F.array_sort(F.collect_list(F.struct("wid", "gold"))), lambda x: x["gold"]).alias("again"))
    both = back.join(D.tagged(spark, folder).select("row_id", "gold"), "row_id")
    return both.groupBy("part").agg(F.count("*").alias("n_rows"), F.count_if(F.col("again") == F.col("gold")).alias("n_same"))


# ---- learning curves

CU = D.with_ctes(D.CURVES)
_AREAS = """
steps AS (SELECT *, percent_acquired - lag(percent_acquired) OVER w AS dx, (entity_f1 + lag(entity_f1) OVER w) / 2 AS ym FROM curves WINDOW w AS (PARTITION BY dataset, model, uq_metric, seed, arm ORDER BY round)),
areas AS (SELECT dataset, model, uq_metric, seed, arm, CASE WHEN count(*) > 1 THEN sum(dx * ym) / (max(percent_acquired) - min(percent_acquired)) END AS auc, arg_max(entity_f1, round) AS final FROM steps GROUP BY ALL)"""
_GAPS = """
gaps AS (SELECT dataset, model, uq_metric, seed, max(CASE WHEN arm = 'uncertainty' THEN auc END) - max(CASE WHEN arm = 'random' THEN auc END) AS gap_auc,
                max(CASE WHEN arm = 'uncertainty' THEN final END) - max(CASE WHEN arm = 'random' THEN final END) AS gap_final
         FROM areas GROUP BY ALL HAVING count(DISTINCT arm) = 2)"""
_SERIES = """
series AS (SELECT *, CASE WHEN arm = 'random' THEN 'random' ELSE uq_metric END AS series FROM (SELECT *, min(uq_metric) OVER (PARTITION BY dataset, model) AS first FROM curves) WHERE arm <> 'random' OR uq_metric = first)"""
_REACH = """
means AS (SELECT dataset, model, series, round, avg(percent_acquired) AS percent_acquired, avg(entity_f1) AS entity_f1, count(*) AS n_seeds FROM series GROUP BY ALL),
targets AS (SELECT unnest([0.1, 0.2, 0.3, 0.5])::DOUBLE AS target),
reach AS (SELECT dataset, model, series, target, min(CASE WHEN entity_f1 >= target THEN percent_acquired END) AS pool FROM means, targets GROUP BY ALL)"""
_POOLS = """
pools AS (SELECT dataset, series, target, CASE WHEN median(coalesce(pool, 'inf'::DOUBLE)) < 'inf'::DOUBLE THEN median(coalesce(pool, 'inf'::DOUBLE)) END AS pool, count(pool) AS reached, count(*) AS curves FROM reach GROUP BY ALL)"""
_EFFICIENCY = """
efficiency AS (SELECT u.dataset, u.model, u.series, u.target, u.pool AS uq_pool, r.pool AS random_pool, CASE WHEN u.pool > 0 THEN coalesce(r.pool, 100.0) / u.pool END AS efficiency, (r.pool IS NULL AND u.pool IS NOT NULL) AS lower_bound
               FROM reach u LEFT JOIN (SELECT * FROM reach WHERE series = 'random') r ON u.dataset = r.dataset AND u.model = r.model AND u.target = r.target WHERE u.series <> 'random')"""


@query("g4_arm_auc", D.with_ctes(D.CURVES, _AREAS) + "SELECT dataset, model, uq_metric, seed, arm, round(auc, 6) AS auc, round(final, 6) AS final FROM areas")
def _(spark, folder):
    return C.arm_scores(D.curves(spark, folder), RUN, "percent_acquired", "entity_f1", strict=False).select(*RUN, *r6("auc", "final"))


def _seed_scores(spark, folder):
    return C.seed_scores(D.curves(spark, folder), SETTING, "percent_acquired", "entity_f1", strict=False)


@query("g5_seed_scores", D.with_ctes(D.CURVES, _AREAS, _GAPS) + "SELECT dataset, model, uq_metric, seed, round(gap_auc, 6) AS gap_auc, round(gap_final, 6) AS gap_final FROM gaps")
def _(spark, folder):
    return _seed_scores(spark, folder).select(*SETTING, "seed", *r6("gap_auc", "gap_final"))


@query("g6_config_scores", D.with_ctes(D.CURVES, _AREAS, _GAPS) + "SELECT dataset, model, uq_metric, round(avg(gap_auc), 6) AS gap_auc, round(avg(gap_final), 6) AS gap_final, count(*) AS n_seeds FROM gaps GROUP BY ALL")
def _(spark, folder):
    return C.config_scores(_seed_scores(spark, folder), SETTING).select(*SETTING, *r6("gap_auc", "gap_final"), "n_seeds")


@query("g7_final_scores", CU + """
SELECT dataset, arm, round(avg(entity_f1), 6) AS entity_f1_mean, round(stddev_samp(entity_f1), 6) AS entity_f1_sd, count(*) AS n_runs
FROM (SELECT *, max(round) OVER (PARTITION BY dataset, model, uq_metric, seed, arm) AS last FROM curves) WHERE round = last GROUP BY ALL""")
def _(spark, folder):
    return C.final_scores(D.curves(spark, folder), RUN, ["dataset", "arm"], ["entity_f1"]).select("dataset", "arm", *r6("entity_f1_mean", "entity_f1_sd"), "n_runs")


def _means(spark, folder):
    series = C.arm_series(D.curves(spark, folder), ["dataset", "model"])
    return C.mean_curves(series, ["dataset", "model", "series"], "percent_acquired", "entity_f1")


@query("w1_arm_series", D.with_ctes(D.CURVES, _SERIES) + "SELECT series, count(*) AS n FROM series GROUP BY series")
def _(spark, folder):
    return C.arm_series(D.curves(spark, folder), ["dataset", "model"]).groupBy("series").agg(F.count("*").alias("n"))


@query("g8_mean_curves", D.with_ctes(D.CURVES, _SERIES, _REACH) + "SELECT dataset, model, series, round, round(percent_acquired, 6) AS percent_acquired, round(entity_f1, 6) AS entity_f1, n_seeds FROM means")
def _(spark, folder):
    return _means(spark, folder).select("dataset", "model", "series", "round", *r6("percent_acquired", "entity_f1"), "n_seeds")


def _reach(spark, folder):
    targets = spark.createDataFrame([(t,) for t in TARGETS], "target double")
    return C.first_reaching(_means(spark, folder), targets, ["dataset", "model", "series"], "percent_acquired", "entity_f1")


@query("g9_first_crossing", D.with_ctes(D.CURVES, _SERIES, _REACH) + "SELECT dataset, model, series, target, round(pool, 6) AS pool FROM reach")
def _(spark, folder):
    return _reach(spark, folder).select("dataset", "model", "series", "target", *r6("pool"))


@query("g10_median_pool", D.with_ctes(D.CURVES, _SERIES, _REACH, _POOLS) + "SELECT dataset, series, target, round(pool, 6) AS pool, reached, curves FROM pools")
def _(spark, folder):
    return C.median_pool(_reach(spark, folder), ["dataset", "series", "target"]).select("dataset", "series", "target", *r6("pool"), "reached", "curves")


@query("g11_labeling_efficiency", D.with_ctes(D.CURVES, _SERIES, _REACH, _EFFICIENCY) + "SELECT dataset, model, series, target, round(uq_pool, 6) AS uq_pool, round(random_pool, 6) AS random_pool, round(efficiency, 6) AS efficiency, lower_bound FROM efficiency")
def _(spark, folder):
    out = C.labeling_efficiency(_reach(spark, folder), ["dataset", "model", "target"])
    return out.select("dataset", "model", "series", "target", *r6("uq_pool", "random_pool", "efficiency"), "lower_bound")


@query("g12_efficiency_summary", D.with_ctes(D.CURVES, _SERIES, _REACH, _EFFICIENCY) + """
SELECT dataset, series, round(exp(avg(CASE WHEN efficiency > 0 THEN ln(efficiency) END)), 6) AS geometric_mean, round(min(efficiency), 6) AS least, round(max(efficiency), 6) AS most, bool_or(lower_bound) AS lower_bound,
       count(efficiency) AS n, count(*) FILTER (WHERE uq_pool IS NULL) AS missed FROM efficiency GROUP BY ALL""")
def _(spark, folder):
    out = C.efficiency_summary(C.labeling_efficiency(_reach(spark, folder), ["dataset", "model", "target"]), ["dataset", "series"])
    return out.select("dataset", "series", *r6("geometric_mean", "least", "most"), "lower_bound", "n", "missed")


_CEILING = "ceiling AS (SELECT dataset, model, avg(entity_f1) AS ceiling, stddev_samp(entity_f1) AS ceiling_sd, count(entity_f1) AS ceiling_n FROM (SELECT *, max(round) OVER (PARTITION BY dataset, model, uq_metric, seed, arm) AS last FROM curves) WHERE arm = 'uncertainty' AND round = last GROUP BY ALL)"


def _supervised(curves):
    """Stands for supervised runs: the last rounds of the uncertain arm."""
    return curves.withColumn("_last", F.max("round").over(Window.partitionBy(*RUN))).where("arm = 'uncertainty' and round = _last").drop("_last")


@query("g13_floor_and_ceiling", D.with_ctes(D.CURVES, _CEILING) + """
SELECT dataset, model, round(floor, 6) AS floor, round(ceiling, 6) AS ceiling, round(ceiling_sd, 6) AS ceiling_sd, coalesce(ceiling_n, 0) AS ceiling_n
FROM (SELECT dataset, model, avg(entity_f1) AS floor FROM curves WHERE round = 0 AND arm = 'random' GROUP BY ALL) FULL JOIN ceiling USING (dataset, model)""")
def _(spark, folder):
    c = D.curves(spark, folder)
    out = C.floor_and_ceiling(c, _supervised(c), ["dataset", "model"], "entity_f1")
    return out.select("dataset", "model", *r6("floor", "ceiling", "ceiling_sd"), F.coalesce("ceiling_n", F.lit(0)).alias("ceiling_n"))


@query("g14_variance_band", CU + """
SELECT arm, round, round(m, 6) AS entity_f1_mean, round(s, 6) AS entity_f1_sd, round(greatest(0.0, m - s), 6) AS entity_f1_low, round(least(1.0, m + s), 6) AS entity_f1_high
FROM (SELECT arm, round, avg(entity_f1) AS m, coalesce(stddev_samp(entity_f1), 0) AS s FROM curves GROUP BY ALL)""")
def _(spark, folder):
    return C.band(D.curves(spark, folder), ["arm", "round"], ["entity_f1"]).select("arm", "round", *r6("entity_f1_mean", "entity_f1_sd", "entity_f1_low", "entity_f1_high"))


_AT = """
budgets AS (SELECT unnest([10.0, 25.0, 50.0])::DOUBLE AS budget),
segments AS (SELECT *, lead(percent_acquired) OVER w AS x2, lead(entity_f1) OVER w AS y2 FROM curves WINDOW w AS (PARTITION BY dataset, model, uq_metric, seed, arm ORDER BY percent_acquired)),
scores_at AS (SELECT dataset, model, uq_metric, seed, arm, budget, CASE WHEN budget < min(percent_acquired) THEN arg_min(entity_f1, percent_acquired)
         ELSE coalesce(max(CASE WHEN percent_acquired <= budget AND budget < x2 THEN entity_f1 + (budget - percent_acquired) * (y2 - entity_f1) / (x2 - percent_acquired) END), arg_max(entity_f1, percent_acquired)) END AS entity_f1
       FROM segments, budgets GROUP BY ALL)"""


@query("m10_scores_at_budgets", D.with_ctes(D.CURVES, _AT.replace("GROUP BY ALL", "GROUP BY dataset, model, uq_metric, seed, arm, budget")) + "SELECT dataset, model, uq_metric, seed, arm, budget, round(entity_f1, 6) AS entity_f1 FROM scores_at")
def _(spark, folder):
    return C.at_budgets(D.curves(spark, folder), RUN, "percent_acquired", "entity_f1", BUDGETS).select(*RUN, "budget", *r6("entity_f1"))


@query("g16_headroom", D.with_ctes(D.CURVES, _CEILING, _AT.replace("GROUP BY ALL", "GROUP BY dataset, model, uq_metric, seed, arm, budget")) + """,
pairs AS (SELECT dataset, model, uq_metric, seed, budget, max(CASE WHEN arm = 'uncertainty' THEN entity_f1 END) AS u, max(CASE WHEN arm = 'random' THEN entity_f1 END) AS r FROM scores_at GROUP BY ALL HAVING count(DISTINCT arm) = 2),
rooms AS (SELECT p.dataset, budget, avg(u - r) AS gap, count(*) AS pairs, avg(c.ceiling - r) AS headroom FROM pairs p JOIN ceiling c ON p.dataset = c.dataset AND p.model = c.model GROUP BY ALL)
SELECT dataset, budget, round(gap, 6) AS gap, pairs, round(headroom, 6) AS headroom, round(CASE WHEN headroom > 0 THEN gap / headroom END, 6) AS closed FROM rooms""")
def _(spark, folder):
    c = D.curves(spark, folder)
    ceiling = C.floor_and_ceiling(c, _supervised(c), ["dataset", "model"], "entity_f1").where("ceiling is not null")
    at = C.at_budgets(c, RUN, "percent_acquired", "entity_f1", BUDGETS)
    out = C.headroom(at, ceiling, ["dataset"], SETTING, ["dataset", "model"], "entity_f1")
    return out.select("dataset", "budget", *r6("gap", "headroom", "closed"), "pairs")


def _paired_rounds(curves):
    """Rounds that both arms have."""
    n = F.count("*").over(Window.partitionBy(*SETTING, "seed", "round"))
    return curves.withColumn("_n", n).where("_n = 2").drop("_n")


@query("pv1_gap_curves", CU + """
SELECT dataset, model, uq_metric, seed, round, round(u, 6) AS uncertainty, round(r, 6) AS random, round(u - r, 6) AS gap FROM (
  SELECT dataset, model, uq_metric, seed, round, max(CASE WHEN arm = 'uncertainty' THEN entity_f1 END) AS u, max(CASE WHEN arm = 'random' THEN entity_f1 END) AS r FROM curves GROUP BY ALL) WHERE u IS NOT NULL AND r IS NOT NULL""")
def _(spark, folder):
    return C.gap_curves(D.curves(spark, folder), [*SETTING, "seed", "round"], "entity_f1").select(*SETTING, "seed", "round", *r6("uncertainty", "random", "gap"))


@query("g51_gap_by_round", CU + """
SELECT round, round(avg(u - r), 6) AS gap, round(stddev_samp(u - r), 6) AS gap_sd FROM (
  SELECT dataset, model, uq_metric, seed, round, max(CASE WHEN arm = 'uncertainty' THEN entity_f1 END) AS u, max(CASE WHEN arm = 'random' THEN entity_f1 END) AS r FROM curves GROUP BY ALL) WHERE u IS NOT NULL AND r IS NOT NULL GROUP BY round""")
def _(spark, folder):
    gaps = C.gap_curves(D.curves(spark, folder), [*SETTING, "seed", "round"], "entity_f1")
    return gaps.groupBy("round").agg(F.avg("gap").alias("gap"), F.stddev("gap").alias("gap_sd")).select("round", *r6("gap", "gap_sd"))


@query("g42_run_stability", CU + """
SELECT dataset, model, uq_metric, seed, arm, round(arg_min(entity_f1, round), 6) AS first_score, round(max(CASE WHEN n > 1 THEN best - entity_f1 END), 6) AS largest_fall, round(avg(abs(entity_f1 - mid)), 6) AS jitter FROM (
  SELECT *, max(entity_f1) OVER (w ROWS UNBOUNDED PRECEDING) AS best, row_number() OVER w AS n, (lag(entity_f1) OVER w + lead(entity_f1) OVER w) / 2 AS mid FROM curves WINDOW w AS (PARTITION BY dataset, model, uq_metric, seed, arm ORDER BY round))
GROUP BY ALL""".replace("GROUP BY ALL", "GROUP BY dataset, model, uq_metric, seed, arm"))
def _(spark, folder):
    return C.stability(D.curves(spark, folder), RUN, "entity_f1").select(*RUN, *r6("first_score", "largest_fall", "jitter"))


@query("g37_tuning_objective", D.with_ctes(D.CURVES, _AREAS) + """,
whole AS (SELECT dataset, model, uq_metric, seed, arm FROM curves GROUP BY ALL HAVING count(*) = 30 AND max(round) = 29)
SELECT a.dataset, a.model, a.arm, round(avg(auc), 6) AS auc, round(avg(final), 6) AS final, count(*) AS n_seeds FROM areas a JOIN whole w ON a.dataset = w.dataset AND a.model = w.model AND a.uq_metric = w.uq_metric AND a.seed = w.seed AND a.arm = w.arm
WHERE a.uq_metric = 'entropy' GROUP BY ALL""")
def _(spark, folder):
    c = D.curves(spark, folder).where("uq_metric = 'entropy'").withColumn("total_rounds", F.lit(D.ROUNDS))
    return C.tuning_objective(c, ["dataset", "model", "arm"], "percent_acquired", "entity_f1").select("dataset", "model", "arm", *r6("auc", "final"), "n_seeds")


@query("g39_wins", D.with_ctes(D.CURVES, _AREAS, _GAPS) + """
SELECT uq_metric, round(avg(gap_auc), 6) AS mean_gap, count(*) FILTER (WHERE gap_auc > 1e-12) AS wins, count(*) FILTER (WHERE abs(gap_auc) <= 1e-12) AS ties, count(*) FILTER (WHERE gap_auc < -1e-12) AS losses,
       round(CASE WHEN count(gap_auc) > 0 THEN count(*) FILTER (WHERE gap_auc > 1e-12) / count(gap_auc) END, 6) AS win_share FROM gaps GROUP BY uq_metric""")
def _(spark, folder):
    return C.wins(_seed_scores(spark, folder), ["uq_metric"], F.col("gap_auc")).select("uq_metric", *r6("mean_gap", "win_share"), "wins", "ties", "losses")


@query("pv4_unpivot", D.with_ctes(D.CURVES, _AREAS) + "SELECT arm, measure, round(avg(value), 6) AS value FROM (SELECT arm, 'auc' AS measure, auc AS value FROM areas UNION ALL SELECT arm, 'final', final FROM areas) GROUP BY ALL")
def _(spark, folder):
    scores = C.arm_scores(D.curves(spark, folder), RUN, "percent_acquired", "entity_f1", strict=False)
    return scores.unpivot(["arm"], ["auc", "final"], "measure", "value").groupBy("arm", "measure").agg(F.avg("value").alias("value")).select("arm", "measure", *r6("value"))


@query("u1_diagonal_union", CU + """
SELECT dataset, count(*) AS n, count(entity_f1) AS scored, count(extra) AS extra FROM (SELECT dataset, entity_f1, NULL AS extra FROM curves WHERE arm = 'random' UNION ALL SELECT dataset, NULL, round FROM curves WHERE arm = 'uncertainty') GROUP BY dataset""")
def _(spark, folder):
    c = D.curves(spark, folder)
    left, right = c.where("arm = 'random'").select("dataset", "entity_f1"), c.where("arm = 'uncertainty'").select("dataset", F.col("round").alias("extra"))
    return left.unionByName(right, allowMissingColumns=True).groupBy("dataset").agg(F.count("*").alias("n"), F.count("entity_f1").alias("scored"), F.count("extra").alias("extra"))


# ---- intervals and tests

@query("st1_mean_interval")
def _(spark, folder):
    return ST.mean_interval(_seed_scores(spark, folder), ["dataset", "model"], "gap_auc")


@query("st2_gap_ttests", D.with_ctes(D.CURVES, _AREAS, _GAPS) + """
SELECT dataset, model, uq_metric, round(avg(gap_auc), 6) AS mean, count(gap_auc) AS n, round(CASE WHEN stddev_samp(gap_auc) > 0 THEN avg(gap_auc) / (stddev_samp(gap_auc) / sqrt(count(gap_auc))) END, 4) AS t FROM gaps GROUP BY ALL HAVING count(gap_auc) > 1""")
def _(spark, folder):
    return ST.t_tests(_seed_scores(spark, folder), SETTING, "gap_auc").select(*SETTING, *r6("mean"), "n", F.round("t", 4).alias("t"))


@query("st3_holm")
def _(spark, folder):
    return ST.adjusted(ST.t_tests(_seed_scores(spark, folder), SETTING, "gap_auc"), ["dataset", "model"], 3, tie=["uq_metric"])


_TTR = """
lexicon AS (SELECT row_id, part, wid, lower(word) AS word, gold AS tag, gold <> 'O' AS entity FROM words WHERE regexp_matches(word, '[\\p{L}\\p{N}]')),
windows AS (SELECT part, w, count(DISTINCT word) / count(*) AS ttr FROM (SELECT *, (row_number() OVER (PARTITION BY part ORDER BY row_id, wid) - 1) // 100 AS w FROM lexicon) GROUP BY part, w HAVING count(*) = 100)"""


def _lexicon(spark, folder):
    return P.lexicon(D.tagged(spark, folder), ["row_id", "part"])


_RANKS = ["bootstrap", "pool", "validation", "test"]
# Two-sided p of a normal deviate by Simpson's rule, and of t with whole degrees of freedom by its finite series.
_NORMAL_P = """greatest(0, 1 - 2 * list_sum(list_transform(range(0, 2001), lambda i: (CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * exp(-pow(least({z}, 12) * i / 2000, 2) / 2))) * least({z}, 12) / 6000 / sqrt(2 * pi()))"""
_T_IN = """(CASE WHEN {df} % 2 = 1 THEN 2 / pi() * (atan({t} / sqrt({df})) + CASE WHEN {df} > 1 THEN sin(atan({t} / sqrt({df}))) * cos(atan({t} / sqrt({df})))
  * list_sum(list_transform(range(0, ({df} - 1) // 2), lambda j: exp(lgamma(j + 1) - lgamma(j + 1.5)) * sqrt(pi()) / 2 * pow(cos(atan({t} / sqrt({df}))), 2 * j))) ELSE 0 END)
  ELSE sin(atan({t} / sqrt({df}))) * list_sum(list_transform(range(0, {df} // 2), lambda j: exp(lgamma(j + 0.5) - lgamma(j + 1)) / sqrt(pi()) * pow(cos(atan({t} / sqrt({df}))), 2 * j))) END)"""


def _quantiles(df: str, source: str) -> str:
    """97.5 % quantiles of t for the degrees of freedom ``df`` in ``source``, by halving."""
    return f"""
halving AS (SELECT DISTINCT {df} AS df, 0.0::DOUBLE AS low, 1000.0::DOUBLE AS high, 0 AS i FROM {source} WHERE {df} > 0
  UNION ALL SELECT df, CASE WHEN {_T_IN.format(t="((low + high) / 2)", df="df")} < 0.95 THEN (low + high) / 2 ELSE low END,
                       CASE WHEN {_T_IN.format(t="((low + high) / 2)", df="df")} < 0.95 THEN high ELSE (low + high) / 2 END, i + 1 FROM halving WHERE i < 60),
quantiles AS (SELECT df, high AS q FROM halving WHERE i = 60)"""


def _recursive(*ctes: str) -> str:
    return D.with_ctes(*ctes).replace("WITH ", "WITH RECURSIVE ", 1)


_INTERVAL = ", means AS (SELECT dataset, model, avg(gap_auc) AS mean, coalesce(stddev_samp(gap_auc), 0) AS sd, count(gap_auc) AS n FROM gaps GROUP BY ALL)," + _quantiles("n - 1", "means") + """
SELECT dataset, model, round(mean, 6) AS mean, round(mean - coalesce(q, 0) * sd / sqrt(n), 6) AS low, round(mean + coalesce(q, 0) * sd / sqrt(n), 6) AS high, n FROM means LEFT JOIN quantiles ON df = n - 1"""


@query("st1_mean_interval", _recursive(D.CURVES, _AREAS, _GAPS) + _INTERVAL)
def _(spark, folder):
    return ST.mean_interval(_seed_scores(spark, folder), ["dataset", "model"], "gap_auc").select("dataset", "model", *r6("mean", "low", "high"), "n")


@query("st2_gap_ttests", D.with_ctes(D.CURVES, _AREAS, _GAPS) + """
SELECT dataset, model, uq_metric, round(avg(gap_auc), 6) AS mean, count(gap_auc) AS n, round(CASE WHEN stddev_samp(gap_auc) > 0 THEN avg(gap_auc) / (stddev_samp(gap_auc) / sqrt(count(gap_auc))) END, 4) AS t FROM gaps GROUP BY ALL HAVING count(gap_auc) > 1""")
def _(spark, folder):
    return ST.t_tests(_seed_scores(spark, folder), SETTING, "gap_auc").select(*SETTING, *r6("mean"), "n", F.round("t", 4).alias("t"))


_HOLM = """
t AS (SELECT dataset, model, uq_metric, avg(gap_auc) AS mean, count(gap_auc) AS n, avg(gap_auc) / (stddev_samp(gap_auc) / sqrt(count(gap_auc))) AS t FROM gaps GROUP BY ALL HAVING count(gap_auc) > 1),
p AS (SELECT *, 1 - """ + _T_IN.format(t="abs(t)", df="(n - 1)") + """ AS p FROM t),
k AS (SELECT *, row_number() OVER (PARTITION BY dataset, model ORDER BY p, uq_metric) AS k FROM p),
holm AS (SELECT *, least(1, 3 * p) AS bonferroni, max(least(1, p * (3 - k + 1))) OVER (PARTITION BY dataset, model ORDER BY k) AS holm FROM k)"""


def _holm(spark, folder):
    return ST.adjusted(ST.t_tests(_seed_scores(spark, folder), SETTING, "gap_auc"), ["dataset", "model"], 3, tie=["uq_metric"])


@query("st3_holm", D.with_ctes(D.CURVES, _AREAS, _GAPS, _HOLM) + "SELECT dataset, model, uq_metric, round(p, 6) AS p, round(bonferroni, 6) AS bonferroni, round(holm, 6) AS holm FROM holm")
def _(spark, folder):
    return _holm(spark, folder).select(*SETTING, *r6("p", "bonferroni", "holm"))


_TTR = """
lexicon AS (SELECT row_id, part, wid, lower(word) AS word, gold AS tag, gold <> 'O' AS entity FROM words WHERE regexp_matches(word, '[\\p{L}\\p{N}]')),
windows AS (SELECT part, w, count(DISTINCT word) / count(*) AS ttr FROM (SELECT *, (row_number() OVER (PARTITION BY part ORDER BY row_id, wid) - 1) // 100 AS w FROM lexicon) GROUP BY part, w HAVING count(*) = 100)"""


def _lexicon(spark, folder):
    return P.lexicon(D.tagged(spark, folder), ["row_id", "part"])


@query("st4_window_ranks", D.with_ctes(D.TAGGED, D.WORDS, _TTR) + """,
ordered AS (SELECT list_position(['bootstrap', 'pool', 'validation', 'test'], part) AS o, part, ttr FROM windows WHERE part IN ('bootstrap', 'pool', 'validation', 'test')),
pairs AS (SELECT a.part AS first, b.part AS second, x.part AS own, x.ttr FROM (SELECT DISTINCT part, o FROM ordered) a JOIN (SELECT DISTINCT part, o FROM ordered) b ON a.o < b.o JOIN ordered x ON x.part IN (a.part, b.part)),
ranked AS (SELECT *, rank() OVER (PARTITION BY first, second ORDER BY ttr) + (count(*) OVER (PARTITION BY first, second, ttr) - 1) / 2 AS r, count(*) OVER (PARTITION BY first, second, ttr) AS t FROM pairs),
sums AS (SELECT first, second, count(*) FILTER (WHERE own = first) AS n1, count(*) FILTER (WHERE own = second) AS n2, sum(CASE WHEN own = first THEN r END) AS s, sum(t * t - 1)::DOUBLE AS ties, count(*)::DOUBLE AS n FROM ranked GROUP BY first, second),
z AS (SELECT *, s - n1 * (n1 + 1) / 2 AS u, greatest(0, (abs(s - n1 * (n1 + 1) / 2 - n1 * n2 / 2) - 0.5) / sqrt(n1 * n2 / 12 * (n + 1 - ties / (n * (n - 1))))) AS z FROM sums),
p AS (SELECT *, """ + _NORMAL_P.format(z="z") + """ AS p FROM z),
k AS (SELECT *, row_number() OVER (ORDER BY p, first, second) AS k, count(*) OVER () AS m FROM p)
SELECT first, second, n1, n2, round(u, 4) AS u, round(p, 5) AS p, round(least(1, m * p), 5) AS bonferroni, round(max(least(1, p * (m - k + 1))) OVER (ORDER BY k), 5) AS holm FROM k""")
def _(spark, folder):
    scratch = Scratch(spark, "st4")
    w = P.window_ttr(_lexicon(spark, folder).where("part is not null"), ["part"], ["row_id", "wid"], 100, scratch)
    tests = ST.pairwise_mann_whitney(w, "part", "ttr", _RANKS, scratch).withColumn("all", F.lit(1))
    return ST.adjusted(tests, ["all"], None, tie=["first", "second"]).select("first", "second", "n1", "n2", F.round("u", 4).alias("u"), *(F.round(c, 5).alias(c) for c in ("p", "bonferroni", "holm")))


@query("st5_wilcoxon", _recursive(D.CURVES, _AREAS, _GAPS) + """,
ranked AS (SELECT dataset, gap_auc, rank() OVER (PARTITION BY dataset ORDER BY abs(gap_auc)) AS r FROM gaps WHERE gap_auc <> 0),
sums AS (SELECT dataset, count(*) AS n, least(sum(CASE WHEN gap_auc > 0 THEN r ELSE 0 END), count(*) * (count(*) + 1) / 2 - sum(CASE WHEN gap_auc > 0 THEN r ELSE 0 END)) AS w FROM ranked GROUP BY dataset),
ways AS (SELECT 0 AS k, [1::DOUBLE] AS ways UNION ALL
  SELECT k + 1, list_transform(range(0, (k + 1) * (k + 2) // 2 + 1), lambda s: (CASE WHEN s < len(ways) THEN ways[s + 1] ELSE 0 END) + (CASE WHEN s >= k + 1 THEN ways[s - k] ELSE 0 END)) FROM ways WHERE k < 50)
SELECT dataset, n, round(w, 4) AS w, round(least(1, 2 * list_sum(ways[1 : CAST(floor(w) AS INTEGER) + 1]) / pow(2, n)), 6) AS p FROM sums JOIN ways ON k = n""")
def _(spark, folder):
    return ST.wilcoxon(_seed_scores(spark, folder), ["dataset"], "gap_auc", Scratch(spark, "st5")).select("dataset", "n", F.round("w", 4).alias("w"), *r6("p"))


@query("st6_spearman", """
WITH r AS (SELECT l_returnflag, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2 AS x,
                  rank() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_returnflag, l_extendedprice) - 1) / 2 AS y FROM lineitem)
SELECT l_returnflag, round(corr(x, y), 6) AS rho, count(*) AS n FROM r GROUP BY l_returnflag""")
def _(spark, folder):
    return ST.spearman(table(spark, folder, "lineitem"), ["l_returnflag"], "l_quantity", "l_extendedprice", Scratch(spark, "st6")).select("l_returnflag", *r6("rho"), "n")


@query("st7_exact_quantiles", "SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.025), 4) AS low, round(median(l_extendedprice), 4) AS middle, round(quantile_cont(l_extendedprice, 0.975), 4) AS high FROM lineitem GROUP BY l_returnflag")
def _(spark, folder):
    rows = table(spark, folder, "lineitem").groupBy("l_returnflag")
    return rows.agg(*(F.round(F.percentile("l_extendedprice", F.lit(q)), 4).alias(n) for q, n in ((0.025, "low"), (0.5, "middle"), (0.975, "high"))))


# ---- choosing words

W_SEL = D.with_ctes(D.TAGGED, D.WORDS, D.SELECTIONS)
_RUN = ["seed", "arm"]


@query("j1_selection_progress", D.with_ctes(D.TAGGED, D.WORDS, D.SELECTIONS) + """,
progress AS (SELECT seed, arm, round, sum(count(*)) OVER (PARTITION BY seed, arm ORDER BY round) AS n_acquired FROM selections GROUP BY seed, arm, round)
SELECT s.seed, s.arm, s.label, count(*) AS n, sum(p.n_acquired)::BIGINT AS progress FROM selections s LEFT JOIN progress p ON s.seed = p.seed AND s.arm = p.arm AND s.round = p.round GROUP BY ALL""")
def _(spark, folder):
    s = D.selections(spark, folder)
    per_round = s.groupBy(*_RUN, "round").agg(F.count("*").alias("k"))
    progress = per_round.withColumn("n_acquired", F.sum("k").over(Window.partitionBy(*_RUN).orderBy("round"))).drop("k")
    return s.join(V.require_unique(progress, [*_RUN, "round"]), [*_RUN, "round"], "left").groupBy(*_RUN, "label").agg(F.count("*").alias("n"), F.sum("n_acquired").alias("progress"))


_GRID = """
runs AS (SELECT DISTINCT seed, arm FROM selections), labels AS (SELECT DISTINCT label FROM selections),
grid AS (SELECT * FROM runs, labels),
share AS (SELECT g.seed, g.arm, g.label, 100.0::DOUBLE * coalesce(c.n, 0) / (SELECT count(*) FROM selections) AS share FROM grid g
          LEFT JOIN (SELECT seed, arm, label, count(*) AS n FROM selections WHERE round <= 4 GROUP BY ALL) c ON g.seed = c.seed AND g.arm = c.arm AND g.label = c.label)"""


@query("g1_label_pool_share", D.with_ctes(D.TAGGED, D.WORDS, D.SELECTIONS, _GRID) + "SELECT arm, label, round(avg(share), 6) AS share, round(coalesce(stddev_samp(share), 0), 6) AS share_sd FROM share GROUP BY ALL")
def _(spark, folder):
    s = D.selections(spark, folder)
    grid = s.select(*_RUN).distinct().crossJoin(F.broadcast(s.select("label").distinct()))  # a row a run and label: both are few by nature
    counts = s.where("round <= 4").groupBy(*_RUN, "label").agg(F.count("*").alias("n"))
    total = s.agg(F.count("*").alias("total"))
    share = grid.join(counts, [*_RUN, "label"], "left").join(F.broadcast(total)).withColumn("share", 100.0 * F.coalesce("n", F.lit(0)) / F.col("total"))
    return share.groupBy("arm", "label").agg(F.avg("share").alias("share"), F.coalesce(F.stddev("share"), F.lit(0.0)).alias("share_sd")).select("arm", "label", *r6("share", "share_sd"))


@query("g2_label_coverage", W_SEL + """
SELECT t.label, coalesce(c.arm, 'none') AS arm, round(100.0::DOUBLE * coalesce(c.n, 0) / t.n, 6) AS coverage FROM (SELECT label, count(DISTINCT row_id * 1000000 + wid) AS n FROM selections GROUP BY label) t
LEFT JOIN (SELECT label, arm, count(DISTINCT row_id * 1000000 + wid) AS n FROM selections WHERE round <= 4 GROUP BY label, arm) c ON t.label = c.label""")
def _(spark, folder):
    s = D.selections(spark, folder)
    totals = s.groupBy("label").agg(F.count_distinct("row_id", "wid").alias("total"))
    counts = s.where("round <= 4").groupBy("label", "arm").agg(F.count_distinct("row_id", "wid").alias("n"))
    return totals.join(counts, "label", "left").select("label", F.coalesce("arm", F.lit("none")).alias("arm"), F.round(100.0 * F.coalesce("n", F.lit(0)) / F.col("total"), 6).alias("coverage"))


@query("g3_label_order", W_SEL + "SELECT label, n, row_number() OVER (ORDER BY n DESC, label) AS place FROM (SELECT label, count(*) AS n FROM (SELECT DISTINCT row_id, wid, label FROM selections) GROUP BY label)")
def _(spark, folder):
    counts = D.selections(spark, folder).select("row_id", "wid", "label").distinct().groupBy("label").agg(F.count("*").alias("n"))
    return counts.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "label")))  # a row a label


_SCORES = """
scores AS (SELECT vec_id, label, -list_sum(list_transform(p, lambda x: x * ln(greatest(x, 1e-12)))) / ln(len(p)) AS entropy, 1 - list_max(p) AS least_confidence,
                  1 - (list_reverse_sort(p)[1] - list_reverse_sort(p)[2]) AS margin FROM probabilities)"""


def _scores(spark, folder):
    return D.probabilities(spark, folder).select("vec_id", "label", *(f(F.col("p")).alias(n) for n, f in A.METRICS.items()))


@query("m2_uncertainty", D.with_ctes(D.PROBABILITIES, _SCORES) + "SELECT vec_id, round(entropy, 6) AS entropy, round(least_confidence, 6) AS least_confidence, round(margin, 6) AS margin FROM scores")
def _(spark, folder):
    return _scores(spark, folder).select("vec_id", *r6("entropy", "least_confidence", "margin"))


@query("m1_softmax", D.with_ctes(D.PROBABILITIES) + "SELECT vec_id, round(list_max(p), 6) AS largest, round(list_sum(p), 6) AS total, list_position(p, list_max(p)) - 1 AS predicted FROM probabilities")
def _(spark, folder):
    p = F.col("p")
    return D.probabilities(spark, folder).select("vec_id", F.round(F.array_max(p), 6).alias("largest"), F.round(F.aggregate(p, F.lit(0.0), lambda a, x: a + x), 6).alias("total"), (F.array_position(p, F.array_max(p)) - 1).alias("predicted"))


@query("o1_most_uncertain", D.with_ctes(D.PROBABILITIES, _SCORES) + "SELECT vec_id, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, vec_id) AS rank FROM (SELECT vec_id, round(margin, 9) AS score FROM scores ORDER BY score DESC, vec_id LIMIT 32)")
def _(spark, folder):
    scores = _scores(spark, folder).select("vec_id", F.round("margin", 9).alias("score"))
    return A.top(scores, 32, "score", ["vec_id"]).select("vec_id", *r6("score"), "rank")


@query("a3_word_form_cap", D.with_ctes(D.TAGGED, D.WORDS) + """,
ranked AS (SELECT row_id, wid, word, (row_id * 31 + wid * 17) % 1009 AS score, row_number() OVER (PARTITION BY lower(word) ORDER BY (row_id * 31 + wid * 17) % 1009 DESC, row_id, wid) > 2 AS over FROM words WHERE part = 'pool' AND word IS NOT NULL)
SELECT row_id, wid, word, score, row_number() OVER (ORDER BY over, score DESC, row_id, wid) AS rank FROM ranked ORDER BY over, score DESC, row_id, wid LIMIT 64""")
def _(spark, folder):
    w = D.words(spark, folder).where("part = 'pool' and word is not null").select("row_id", "wid", "word", ((F.col("row_id") * 31 + F.col("wid") * 17) % 1009).alias("score"))
    return A.top(w, 64, "score", ["row_id", "wid"], cap=2, form="word")


_DRAW = "((((({0}) % 2147483648) * 2654435761) % 4294967296 % 2147483648 * 1103515245 + 12345) % 2147483648 + 0.5::DOUBLE) / 2147483648"


@query("a4_random_choice", D.with_ctes(D.TAGGED, D.WORDS) + "SELECT row_id, wid, word FROM (SELECT row_id, wid, word, " + _DRAW.format("row_id * 4096 + wid + 20001") + " AS draw FROM words WHERE part = 'pool' ORDER BY draw, row_id, wid LIMIT 64)")
def _(spark, folder):
    w = D.words(spark, folder).where("part = 'pool'").select("row_id", "wid", "word")
    return A.random_choice(w, 64, 20001, F.col("row_id") * 4096 + F.col("wid"), ["row_id", "wid"]).drop("draw")


@query("a5_replay", D.with_ctes(D.TAGGED, D.WORDS) + "SELECT row_id, wid FROM (SELECT row_id, wid, " + _DRAW.format("row_id * 4096 + wid + 7") + " AS draw FROM words WHERE part = 'bootstrap' ORDER BY draw, row_id, wid LIMIT 12)")
def _(spark, folder):
    w = D.words(spark, folder).where("part = 'bootstrap'").select("row_id", "wid")
    return A.replay(w, 25, 0.5, 7, F.col("row_id") * 4096 + F.col("wid"), ["row_id", "wid"]).select("row_id", "wid")


@query("a2_gumbel_top", D.with_ctes(D.PROBABILITIES, _SCORES) + "SELECT vec_id FROM (SELECT vec_id, CASE WHEN entropy > 0 THEN ln(entropy) - ln(-ln(" + _DRAW.format("vec_id + 3") + ")) ELSE '-inf'::DOUBLE END AS g FROM scores ORDER BY g DESC, vec_id LIMIT 32)")
def _(spark, folder):
    s = _scores(spark, folder)
    noisy = s.withColumn("g", A.gumbel_score(F.col("entropy"), A.uniform(3, F.col("vec_id"))))
    return A.top(noisy, 32, "g", ["vec_id"]).select("vec_id")


@query("a6_schedule", """
WITH n AS (SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1), b AS (SELECT l_returnflag, CAST(trunc(n * 80.0 / 100) AS INTEGER) AS budget FROM n)
SELECT l_returnflag, r AS round, least(1000, budget - (r - 1) * 1000)::INTEGER AS size, least(r * 1000, budget)::INTEGER AS acquired FROM (SELECT *, unnest(range(1, (budget + 999) // 1000 + 1))::INTEGER AS r FROM b)""")
def _(spark, folder):
    n = table(spark, folder, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"))
    return n.select("l_returnflag", F.explode(A.schedule(F.col("n"), 1000, 80.0)).alias("s")).select("l_returnflag", "s.*")


@query("r1_split", D.with_ctes(D.TAGGED) + """,
drawn AS (SELECT row_id, row_number() OVER (ORDER BY draw, row_id) AS r, count(*) OVER () AS n FROM (SELECT row_id, """ + _DRAW.format("row_id + 3407") + """ AS draw FROM tagged))
SELECT CASE WHEN r <= ceil(n * 0.2::DOUBLE) THEN 'test' WHEN r <= ceil(n * 0.2::DOUBLE) + 5 THEN 'bootstrap' ELSE 'pool' END AS part, count(*) AS n_rows, sum(row_id)::BIGINT AS ids FROM drawn GROUP BY 1""")
def _(spark, folder):
    rows = D.tagged(spark, folder).select("row_id")
    return A.split_rows(rows, F.col("row_id"), ["row_id"], 0.2, 5, 3407).groupBy("part").agg(F.count("*").alias("n_rows"), F.sum("row_id").alias("ids"))


@query("j16_remaining", W_SEL + "SELECT w.part, count(*) AS n FROM words w WHERE NOT EXISTS (SELECT 1 FROM selections s WHERE s.row_id = w.row_id AND s.wid = w.wid AND s.round < 5) GROUP BY w.part")
def _(spark, folder):
    left = A.remaining(D.words(spark, folder), D.selections(spark, folder).where("round < 5"), ["row_id", "wid"])
    return left.groupBy("part").agg(F.count("*").alias("n"))


@query("j23_reveal", W_SEL + "SELECT s.label, count(*) AS n, sum(len(t.tokens))::BIGINT AS context FROM selections s JOIN words w ON s.row_id = w.row_id AND s.wid = w.wid JOIN tagged t ON t.row_id = s.row_id WHERE s.round = 0 GROUP BY s.label")
def _(spark, folder):
    chosen = D.selections(spark, folder).where("round = 0").select("row_id", "wid", "label")
    rows = D.tagged(spark, folder)
    out = A.reveal(chosen, rows.select("row_id", "gold"), rows.select("row_id", F.size("tokens").alias("n_tokens")), ["row_id"])
    return out.groupBy("label").agg(F.count("*").alias("n"), F.sum("n_tokens").alias("context"))


@query("a8_acquisition_loop")
def _(spark, folder):
    w = D.words(spark, folder).where("word is not null").select("row_id", "part", "wid", "word", "gold")
    parts = [w.where(F.col("part") == p).drop("part") for p in ("bootstrap", "pool", "test")]
    k = max(1, math.ceil(parts[1].count() / 10))  # the whole pool in ten rounds
    results, _ = loop.run(*parts, Scratch(spark, "a8"), "row_id", k, 100.0, "entropy", 1)
    return results


# ---- profile of a corpus

LEX = D.with_ctes(D.TAGGED, D.WORDS, _TTR)


@query("g31_sentence_ttr", LEX + "SELECT part, round(avg(ttr), 6) AS ttr, count(*) AS n FROM (SELECT part, row_id, count(DISTINCT word) / count(*) AS ttr FROM lexicon GROUP BY part, row_id) GROUP BY part")
def _(spark, folder):
    each = P.type_token_ratio(_lexicon(spark, folder), ["part", "row_id"])
    return each.groupBy("part").agg(F.avg("ttr").alias("ttr"), F.count("*").alias("n")).select("part", *r6("ttr"), "n")


@query("w7_window_ttr", LEX + "SELECT part, w AS window, round(ttr, 6) AS ttr FROM windows")
def _(spark, folder):
    return P.window_ttr(_lexicon(spark, folder), ["part"], ["row_id", "wid"], 100, Scratch(spark, "w7")).select("part", "window", *r6("ttr"))


@query("w6_entity_contexts", LEX + """
SELECT part, count(*) AS n, count(DISTINCT context) AS n_contexts FROM (SELECT part, entity, coalesce(lag(word) OVER w, '<s>') || ' ' || word || ' ' || coalesce(lead(word) OVER w, '</s>') AS context FROM lexicon WINDOW w AS (PARTITION BY row_id ORDER BY wid)) WHERE entity GROUP BY part""")
def _(spark, folder):
    found = P.entity_contexts(_lexicon(spark, folder), ["row_id", "part"])
    return found.groupBy("part").agg(F.count("*").alias("n"), F.count_distinct("context").alias("n_contexts"))


@query("g32_overview", ALL + """
SELECT t.part, t.n_documents, t.n_sentences, t.n_words, t.tagged_share, coalesce(g.n_entities, 0) AS n_entities, coalesce(g.n_types, 0) AS n_types FROM (
  SELECT part, count(DISTINCT document_name) AS n_documents, count(*) AS n_sentences, sum(len(tokens))::BIGINT AS n_words, round(sum(len(list_filter(gold, lambda t: t <> 'O'))) / sum(len(gold)), 6) AS tagged_share FROM tagged GROUP BY part) t
LEFT JOIN (SELECT part, count(*) AS n_entities, count(DISTINCT type) AS n_types FROM gold_chunks GROUP BY part) g ON t.part IS NOT DISTINCT FROM g.part""")
def _(spark, folder):
    rows = D.tagged(spark, folder)
    own = rows.groupBy("part").agg(F.count_distinct("document_name").alias("n_documents"), F.count("*").alias("n_sentences"), F.sum(F.size("tokens")).alias("n_words"),
                                   F.round(F.sum(F.size(F.filter("gold", lambda t: t != "O"))) / F.sum(F.size("gold")), 6).alias("tagged_share"))
    found = rows.select("part", F.explode(spans.chunks(F.col("gold"))).alias("e")).groupBy("part").agg(F.count("*").alias("n_entities"), F.count_distinct("e.type").alias("n_types"))
    joined = own.join(found.withColumnRenamed("part", "_p"), F.col("part").eqNullSafe(F.col("_p")), "left").drop("_p")
    return joined.na.fill(0, ["n_entities", "n_types"])


@query("g28_type_stats", ALL + """
SELECT type, count(*) AS n, round(avg(last - first + 1), 6) AS mean_words, max(last - first + 1) AS most_words, count(DISTINCT document_name) AS n_documents, count(*) FILTER (WHERE part = 'pool') AS pool, count(*) FILTER (WHERE part = 'test') AS test FROM gold_chunks GROUP BY type""")
def _(spark, folder):
    rows = D.tagged(spark, folder).select("part", "document_name", F.explode(spans.chunks(F.col("gold"))).alias("e"))
    n = (F.col("e.last") - F.col("e.first") + 1)
    return rows.groupBy(F.col("e.type").alias("type")).agg(F.count("*").alias("n"), F.round(F.avg(n), 6).alias("mean_words"), F.max(n).cast("long").alias("most_words"), F.count_distinct("document_name").alias("n_documents"),
                                                          F.count_if(F.col("part") == "pool").alias("pool"), F.count_if(F.col("part") == "test").alias("test"))


@query("w10_type_share", ALL + "SELECT part, type, round(n / sum(n) OVER (PARTITION BY part), 6) AS share FROM (SELECT part, type, count(*) AS n FROM gold_chunks GROUP BY ALL)")
def _(spark, folder):
    counts = D.tagged(spark, folder).select("part", F.explode(spans.chunks(F.col("gold"))).alias("e")).groupBy("part", F.col("e.type").alias("type")).agg(F.count("*").alias("n"))
    return counts.select("part", "type", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("part")), 6).alias("share"))


@query("g29_documents_in_several_splits", "SELECT count(*) AS n FROM (SELECT document_name FROM sentences WHERE document_name IS NOT NULL GROUP BY document_name HAVING count(DISTINCT lower(trim(split, ' '))) > 1)")
def _(spark, folder):
    s = table(spark, folder, "sentences").where("document_name is not null").groupBy("document_name").agg(F.count_distinct(F.lower(F.trim("split"))).alias("k"))
    return s.agg(F.count_if(F.col("k") > 1).alias("n"))


_MENTION_ROWS = """
found AS (SELECT part, type, first, last - first + 1 AS words, lower(array_to_string(list_transform(tokens[first + 1 : last + 1], lambda t: coalesce(t, '')), ' ')) AS surface,
                 array_to_string(list_transform(tokens[first + 1 : last + 1], lambda t: coalesce(t, '')), ' ') AS form FROM gold_chunks)"""


def _mentions(spark, folder):
    rows = D.tagged(spark, folder).withColumn("tokens", F.transform("tokens", lambda t: F.coalesce(t, F.lit(""))))
    return P.mentions(rows, ["part"])


@query("g33_type_frequencies", D.with_ctes(D.TAGGED, D.GOLD, _MENTION_ROWS) + """,
types AS (SELECT unnest(['Actor', 'Activity', 'Activity Data', 'XOR Gateway', 'AND Gateway', 'Unseen']) AS type, unnest(range(1, 7)) AS ord),
n AS (SELECT t.type, t.ord, count(f.type) AS n FROM types t LEFT JOIN (SELECT * FROM found WHERE part = 'pool') f ON f.type = t.type GROUP BY ALL)
SELECT type, n, round(CASE WHEN sum(n) OVER () > 0 THEN n / sum(n) OVER () ELSE 0 END, 6) AS share, row_number() OVER (ORDER BY n DESC, ord) AS rank FROM n""")
def _(spark, folder):
    names = ["Actor", "Activity", "Activity Data", "XOR Gateway", "AND Gateway", "Unseen"]
    types = spark.createDataFrame([(t, i) for i, t in enumerate(names)], "type string, ord int")
    return P.type_frequencies(_mentions(spark, folder).where("part = 'pool'"), types).select("type", "n", *r6("share"), "rank")


@query("g34_pool_profile", D.with_ctes(D.TAGGED, D.WORDS, D.GOLD, _TTR, _MENTION_ROWS) + """,
t AS (SELECT part, type, count(*) AS n FROM found GROUP BY ALL),
mix AS (SELECT part, -sum(p * ln(p)) / ln(7.0::DOUBLE) AS type_entropy, sum(CASE WHEN n < 10 THEN n ELSE 0 END) / sum(n) AS rare_share FROM (SELECT part, n, n / sum(n) OVER (PARTITION BY part) AS p FROM t) GROUP BY part),
shape AS (SELECT part, count(*) FILTER (WHERE words > 1) / count(*) AS multi_word, avg(words) AS mean_words, count(*) FILTER (WHERE first > 0 AND regexp_matches(form, '^\\p{Lu}')) / count(*) FILTER (WHERE first > 0) AS capitalised, count(*) AS n_mentions FROM found GROUP BY part),
share AS (SELECT part, count(*) FILTER (WHERE entity) / count(*) AS entity_share FROM lexicon GROUP BY part)
SELECT s.part, round(entity_share, 6) AS entity_share, round(type_entropy, 6) AS type_entropy, round(rare_share, 6) AS rare_share, round(multi_word, 6) AS multi_word, round(mean_words, 6) AS mean_words, round(capitalised, 6) AS capitalised, n_mentions
FROM share s LEFT JOIN shape ON s.part = shape.part LEFT JOIN mix ON s.part = mix.part WHERE s.part IS NOT NULL""")
def _(spark, folder):
    out = P.pool_profile(_mentions(spark, folder).where("part is not null"), _lexicon(spark, folder).where("part is not null"), ["part"], 7)
    return out.select("part", *r6("entity_share", "type_entropy", "rare_share", "multi_word", "mean_words", "capitalised"), "n_mentions")


@query("g34_unseen_and_ambiguous", D.with_ctes(D.TAGGED, D.WORDS, D.GOLD, _TTR, _MENTION_ROWS) + """
SELECT (SELECT round(count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM found k WHERE k.part = 'pool' AND k.type = f.type AND k.surface = f.surface)) / count(*), 6) FROM found f WHERE f.part = 'test') AS unseen_rate,
       (SELECT round(sum(CASE WHEN tags > 1 THEN n ELSE 0 END) / sum(n), 6) FROM (SELECT word, count(DISTINCT tag) AS tags, count(*) AS n FROM lexicon WHERE part = 'pool' GROUP BY word)) AS ambiguous_share""")
def _(spark, folder):
    m = _mentions(spark, folder)
    unseen = P.unseen_rate(m.where("part = 'pool'"), m.where("part = 'test'")).select(*r6("unseen_rate"))
    doubtful = P.ambiguous_share(_lexicon(spark, folder).where("part = 'pool'").withColumn("all", F.lit(1)), ["all"]).select(*r6("ambiguous_share"))
    return unseen.join(F.broadcast(doubtful))  # a row each


@query("g35_size_matched")
def _(spark, folder):
    t = D.tagged(spark, folder).where("part is not null and size(tokens) > 0").withColumn("tokens", F.transform("tokens", lambda t: F.coalesce(t, F.lit(""))))
    test = t.where("part = 'test'").select("row_id", "tokens", "gold")
    return P.size_matched_profile(t.where("part != 'test'").select("row_id", "part", "tokens", "gold"), test, Scratch(spark, "g35"), "part", 7)


@query("w20_top_surfaces", D.with_ctes(D.TAGGED, D.GOLD, _MENTION_ROWS) + """,
c AS (SELECT type, surface, count(*) AS n, row_number() OVER (PARTITION BY type ORDER BY count(*) DESC, surface) AS r FROM found GROUP BY type, surface)
SELECT type, string_agg(surface || ' (' || n || ')', ', ' ORDER BY r) AS top FROM c WHERE r <= 6 GROUP BY type""")
def _(spark, folder):
    return P.top_surfaces(_mentions(spark, folder), ["type"])


# ---- text

_W = r"(?:[A-Za-z]\.){2,}|[\p{L}\p{N}_]+(?:[''’-][\p{L}\p{N}_]+)*|[^\p{L}\p{N}_\s\p{Z}\x{85}]"


@query("t1_word_tokens", f"SELECT doc_id, len(regexp_extract_all(text, '{_W}')) AS n_words, list_sum(list_transform(regexp_extract_all(text, '{_W}'), lambda w: length(w)))::BIGINT AS n_letters FROM documents")
def _(spark, folder):
    w = text.words(F.col("text"))
    return table(spark, folder, "documents").select("doc_id", w.alias("w")).select("doc_id", F.size("w").cast("long").alias("n_words"), F.aggregate("w", F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("n_letters"))


@query("t2_word_offsets", f"""
WITH w AS (SELECT id, regexp_extract_all(text, '{_W}') AS w, regexp_split_to_array(text, '{_W}') AS g FROM annotated_docs WHERE text IS NOT NULL),
e AS (SELECT id, i, length(w[i]) AS n, length(g[i]) AS gap FROM (SELECT id, w, g, unnest(range(1, len(w) + 1)) AS i FROM w)),
s AS (SELECT id, n, sum(n + gap) OVER (PARTITION BY id ORDER BY i) AS e FROM e)
SELECT id, count(*) AS n_words, sum(n)::BIGINT AS n_letters, sum(e - n)::BIGINT AS starts FROM s GROUP BY id""")
def _(spark, folder):
    docs = table(spark, folder, "annotated_docs").where("text is not null")
    found = docs.select("id", F.explode(text.word_spans(F.col("text"))).alias("w")).groupBy("id")
    return found.agg(F.count("*").alias("n_words"), F.sum(F.col("w.end") - F.col("w.start")).alias("n_letters"), F.sum("w.start").alias("starts"))


@query("t4_byte_offsets", "SELECT doc_id, length(decode(encode(text))) AS chars FROM documents")
def _(spark, folder):
    d = table(spark, folder, "documents")
    return d.select("doc_id", text.char_offset(F.col("text"), F.octet_length("text")).cast("long").alias("chars"))


@query("t7_tag_parts", D.with_ctes(D.TAGGED, D.WORDS) + "SELECT gold AS tag, CASE WHEN gold = 'O' THEN NULL ELSE substr(gold, 3) END AS type, count(*) AS n FROM words GROUP BY 1, 2")
def _(spark, folder):
    return D.words(spark, folder).groupBy(F.col("gold").alias("tag"), spans.tag_type(F.col("gold")).alias("type")).agg(F.count("*").alias("n"))


@query("t11_plain_text", "SELECT doc_id, ' ' || trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'), ' ') || ' ' AS plain FROM documents")
def _(spark, folder):
    return table(spark, folder, "documents").select("doc_id", text.padded_plain(F.col("text")).alias("plain"))


@query("t16_numbered_lines", """
WITH lines AS (SELECT document_name, (row_number() OVER (PARTITION BY document_name ORDER BY row_id) - 1) || ': ' || array_to_string(list_transform(tokens, lambda t: coalesce(t, '')), ' ') AS line FROM sentences WHERE tokens IS NOT NULL AND document_name IS NOT NULL)
SELECT document_name, count(*) AS n_lines, min(md5(line)) AS first_digest, max(md5(line)) AS last_digest FROM lines GROUP BY document_name""")
def _(spark, folder):
    rows = table(spark, folder, "sentences").where("tokens is not null and document_name is not null")
    plain = rows.select("document_name", "row_id", F.transform("tokens", lambda t: F.coalesce(t, F.lit(""))).alias("tokens"))
    lines = numbered(plain, ["document_name"], ["row_id"], "no", Scratch(spark, "t16")).select("document_name", F.md5(text.numbered_line(F.col("no"), F.col("tokens"))).alias("d"))
    return lines.groupBy("document_name").agg(F.count("*").alias("n_lines"), F.min("d").alias("first_digest"), F.max("d").alias("last_digest"))


@query("t17_inline_tags", """
WITH d AS (SELECT id, tokens, list_transform(mentions, lambda m: replace(lower(m.mention_type), ' ', '_')) AS names,
             list_transform(mentions, lambda m: list_min(list_filter(m.token_document_indices, lambda i: i >= 0 AND i < len(tokens)))) AS firsts,
             list_transform(mentions, lambda m: list_max(list_filter(m.token_document_indices, lambda i: i >= 0 AND i < len(tokens)))) AS lasts FROM annotated_docs WHERE mentions IS NOT NULL),
w AS (SELECT id, i, array_to_string(list_concat(
    list_transform(list_filter(range(1, len(names) + 1), lambda k: firsts[k] = i), lambda k: '<' || coalesce(names[k], '') || ' id=' || (k - 1) || '>'), [coalesce(tokens[i + 1].text, '')],
    list_transform(list_reverse(list_filter(range(1, len(names) + 1), lambda k: lasts[k] = i)), lambda k: '</' || coalesce(names[k], '') || '>')), ' ') AS piece
  FROM (SELECT *, unnest(range(0, len(tokens))) AS i FROM d))
SELECT id, md5(string_agg(piece, ' ' ORDER BY i)) AS digest FROM w GROUP BY id""")
def _(spark, folder):
    d = table(spark, folder, "annotated_docs").where("mentions is not null")
    m = F.transform("mentions", lambda m: F.struct(m["mention_type"].alias("type"), m["token_document_indices"].alias("tokens")))
    return d.select("id", F.md5(text.inline_tags(F.col("tokens.text"), m)).alias("digest"))


@query("t18_answer_lines", """
WITH own AS (SELECT id, tokens, coalesce(list_max(list_transform(tokens, lambda t: t.sentence_index)) + 1, 0) AS n FROM annotated_docs),
lines AS (SELECT n, tokens[i].text || chr(9) || coalesce(tokens[i].pos_tag, '') || chr(9) || coalesce(CAST(tokens[i].sentence_index AS VARCHAR), 'x') AS l FROM (SELECT n, tokens, unnest(range(1, len(tokens) + 1)) AS i FROM own)),
parsed AS (SELECT n AS most, list_filter(list_transform(string_split(l, chr(9)), lambda x: trim(x, ' ')), lambda x: x <> '') AS f FROM lines WHERE l IS NOT NULL)
SELECT CASE WHEN len(f) < 2 THEN 'ignored_line' WHEN NOT coalesce(len(f) BETWEEN 3 AND 4 AND try_cast(f[3] AS INTEGER) >= 0 AND try_cast(f[3] AS INTEGER) < most, false) THEN 'dropped_malformed' END AS issue, count(*) AS n FROM parsed GROUP BY 1""")
def _(spark, folder):
    own = F.coalesce(F.array_max("tokens.sentence_index") + 1, F.lit(0))
    d = table(spark, folder, "annotated_docs").select("id", own.alias("n_sentences"), F.explode("tokens").alias("t"))
    line = F.concat(F.col("t.text"), F.lit("\t"), F.coalesce("t.pos_tag", F.lit("")), F.lit("\t"), F.coalesce(F.col("t.sentence_index").cast("string"), F.lit("x")))
    parsed = d.select("n_sentences", line.alias("line")).where("line is not null").select(text.answer_line(F.col("line"), F.col("n_sentences")).alias("p"))
    return parsed.groupBy(F.col("p.issue").alias("issue")).agg(F.count("*").alias("n"))


@query("l5_clusters", """
WITH l AS (SELECT id, len(mentions) AS n, unnest(mentions).token_document_indices AS t FROM annotated_docs WHERE mentions IS NOT NULL),
f AS (SELECT id, n, list_filter(t, lambda i: i < n) AS t FROM l WHERE n > 0),
c AS (SELECT id, count(*) FILTER (WHERE len(t) > 0) AS used, list_distinct(flatten(coalesce(list(t) FILTER (WHERE len(t) > 1), []))) AS named, any_value(n) AS n FROM f GROUP BY id)
SELECT d.id, coalesce(used + n - len(named), 0)::INTEGER AS n_clusters FROM (SELECT id FROM annotated_docs WHERE mentions IS NOT NULL) d LEFT JOIN c ON c.id = d.id""")
def _(spark, folder):
    d = table(spark, folder, "annotated_docs").where("mentions is not null")
    answer = F.concat_ws("\n", F.transform("mentions", lambda m: F.array_join(F.transform(m["token_document_indices"], lambda t: t.cast("string")), " ")))
    return d.select("id", F.size(text.cluster_lines(answer, F.size("mentions"))).alias("n_clusters"))


@query("t19_token_spans", """
WITH w AS (SELECT row_id, tokens, unnest(range(1, len(tokens) + 1)) AS i FROM sentences WHERE tokens IS NOT NULL),
s AS (SELECT row_id, i, length(coalesce(tokens[i], '')) AS n, sum(length(coalesce(tokens[i], '')) + 1) OVER (PARTITION BY row_id ORDER BY i) AS e FROM w)
SELECT row_id, count(*) AS n_tokens, max(e - 1)::BIGINT AS last_end, sum(e - 1 - n)::BIGINT AS starts FROM s GROUP BY row_id""")
def _(spark, folder):
    rows = table(spark, folder, "sentences").where("tokens is not null").select("row_id", F.explode(text.token_char_spans(F.col("tokens"))).alias("s"))
    return rows.groupBy("row_id").agg(F.count("*").alias("n_tokens"), F.max("s.end").cast("long").alias("last_end"), F.sum("s.start").alias("starts"))


# ---- documents, calls, sweeps

@query("j13_interval_overlap", """
WITH m AS (SELECT document_id, vote_id, list_min(token_document_indices) AS a, list_max(token_document_indices) AS b FROM mention_votes)
SELECT x.document_id, count(*) AS n FROM m x JOIN m y ON x.document_id = y.document_id AND x.vote_id < y.vote_id AND x.a <= y.b AND x.b >= y.a GROUP BY x.document_id""")
def _(spark, folder):
    m = table(spark, folder, "mention_votes").where("document_id is not null").select("document_id", F.array_min("token_document_indices").alias("a"), F.array_max("token_document_indices").alias("b"))
    return annotation.overlap_counts(m, ["document_id"], "a", "b").where("n > 0")


@query("w17_sentence_groups", """
WITH t AS (SELECT id, i, tokens[i].sentence_index AS s FROM (SELECT id, tokens, unnest(range(1, len(tokens) + 1)) AS i FROM annotated_docs)),
n AS (SELECT id, CASE WHEN row_number() OVER w > 1 AND s IS DISTINCT FROM lag(s) OVER w THEN 1 ELSE 0 END AS new FROM t WINDOW w AS (PARTITION BY id ORDER BY i))
SELECT id, sum(new)::BIGINT + 1 AS n_groups FROM n GROUP BY id""")
def _(spark, folder):
    t = table(spark, folder, "annotated_docs").select("id", F.posexplode("tokens").alias("i", "t")).select("id", "i", F.col("t.sentence_index").alias("s"))
    return annotation.sentence_groups(t, ["id"], "i", "s").groupBy("id").agg((F.max("sentence_group") + 1).alias("n_groups"))


@query("w4_latest_call", D.with_ctes(D.CALLS) + "SELECT document_id, config_name, arg_max(vote_id, run_no::BIGINT * 1000000000 + vote_id) AS vote_id FROM calls WHERE error IS NULL GROUP BY document_id, config_name")
def _(spark, folder):
    return annotation.latest_calls(D.calls(spark, folder), ["document_id", "config_name"], ["run_no", "vote_id"], F.col("error").isNull()).select("document_id", "config_name", "vote_id")


@query("g47_call_totals", D.with_ctes(D.CALLS) + """,
f AS (SELECT config_name, finish, count(*) AS n FROM calls WHERE finish IS NOT NULL GROUP BY ALL), e AS (SELECT config_name, error, count(*) AS n FROM calls WHERE error IS NOT NULL GROUP BY ALL)
SELECT c.config_name, count(*) AS n_calls, sum(num_predicted)::BIGINT AS num_predicted, coalesce(sum(cached), 0)::BIGINT AS cached,
       (SELECT string_agg(finish || ':' || n, ',' ORDER BY finish) FROM f WHERE f.config_name = c.config_name) AS finish_counts, (SELECT string_agg(error || ':' || n, ',' ORDER BY error) FROM e WHERE e.config_name = c.config_name) AS error_counts
FROM calls c GROUP BY c.config_name""")
def _(spark, folder):
    return annotation.call_totals(D.calls(spark, folder), ["config_name"], ["num_predicted", "cached"], ["finish", "error"]).withColumn("cached", F.coalesce("cached", F.lit(0)))


@query("g48_run_summary", D.with_ctes(D.CALLS) + """,
runs AS (SELECT config_name, run_no, avg(num_predicted) AS predicted, count(error) / count(*) AS errors FROM calls GROUP BY ALL)
SELECT config_name, count(*) AS n_runs, round(avg(predicted), 6) AS predicted, round(stddev_samp(predicted), 6) AS predicted_sd_runs, round(avg(errors), 6) AS errors, round(stddev_samp(errors), 6) AS errors_sd_runs FROM runs GROUP BY config_name""")
def _(spark, folder):
    runs = D.calls(spark, folder).groupBy("config_name", "run_no").agg(F.avg("num_predicted").alias("predicted"), (F.count("error") / F.count("*")).alias("errors"))
    return annotation.run_summary(runs, ["config_name"], ["predicted", "errors"]).select("config_name", "n_runs", *r6("predicted", "predicted_sd_runs", "errors", "errors_sd_runs"))


@query("q3_live_totals", D.with_ctes(D.CALLS) + "SELECT document_id, count(*) AS n_calls, sum(num_predicted)::BIGINT AS num_predicted FROM calls GROUP BY document_id")
def _(spark, folder):
    return live.live_totals(D.calls(spark, folder), ["document_id"], ["num_predicted"])


@query("q4_latest_by_key", D.with_ctes(D.CALLS) + "SELECT document_id, config_name, arg_max(finish, vote_id) AS finish, count(*) AS n_rows FROM (SELECT document_id, config_name, coalesce(finish, '-') AS finish, vote_id FROM calls) GROUP BY ALL")
def _(spark, folder):
    c = D.calls(spark, folder).withColumn("finish", F.coalesce("finish", F.lit("-")))
    return live.latest_by_key(c, ["document_id", "config_name"], "vote_id", ["finish"])


@query("j18_still_to_do", "SELECT id FROM annotated_docs WHERE id NOT IN (SELECT document_id FROM mention_votes WHERE document_id IS NOT NULL)")
def _(spark, folder):
    done = table(spark, folder, "mention_votes").select(F.col("document_id").alias("id"))
    return live.still_to_do(table(spark, folder, "annotated_docs").select("id"), done, "id")


@query("j17_training_rows", "SELECT count(*) AS n FROM sentences s WHERE NOT EXISTS (SELECT 1 FROM sentences t WHERE lower(trim(t.split)) = 'test' AND t.document_name = s.document_name AND t.sentence_id = s.sentence_id)")
def _(spark, folder):
    s = table(spark, folder, "sentences")
    test = s.where(F.lower(F.trim("split")) == "test").select("document_name", "sentence_id").distinct()
    return s.join(test, ["document_name", "sentence_id"], "left_anti").agg(F.count("*").alias("n"))


@query("j19_calls_of_items", "SELECT v.config_name, count(*) AS n FROM mention_votes v WHERE EXISTS (SELECT 1 FROM mention_items i WHERE i.document_id = v.document_id) GROUP BY v.config_name")
def _(spark, folder):
    items = table(spark, folder, "mention_items").select("document_id").distinct()
    return table(spark, folder, "mention_votes").join(items, "document_id", "left_semi").groupBy("config_name").agg(F.count("*").alias("n"))


_COVER = """
docs AS (SELECT DISTINCT CASE WHEN row_id % 3 = 0 THEN document_name ELSE document_name || '#' || sentence_id END AS id FROM sentences WHERE document_name IS NOT NULL)"""


@query("j20_covered_rows", D.with_ctes(_COVER) + """
SELECT source, count(*) AS n FROM (SELECT CASE WHEN EXISTS (SELECT 1 FROM docs WHERE docs.id = s.document_name || '#' || s.sentence_id) THEN 'sentence' WHEN EXISTS (SELECT 1 FROM docs WHERE docs.id = s.document_name) THEN 'document' END AS source FROM sentences s WHERE lower(trim(split, ' ')) = 'test') WHERE source IS NOT NULL GROUP BY source""")
def _(spark, folder):
    s = table(spark, folder, "sentences")
    own = F.when(F.col("row_id") % 3 == 0, F.col("document_name")).otherwise(F.concat("document_name", F.lit("#"), F.col("sentence_id").cast("string")))
    docs = s.where("document_name is not null").select(own.alias("id"))
    return annotation.covered(s.where(F.lower(F.trim("split")) == "test"), docs).groupBy("source").agg(F.count("*").alias("n"))


@query("j5_null_safe_pairing", """
WITH s AS (SELECT category, doc_id % 2 AS side, avg(n_chars) AS score FROM documents GROUP BY ALL)
SELECT a.category, round(a.score - b.score, 6) AS gap FROM s a JOIN s b ON a.category IS NOT DISTINCT FROM b.category AND a.side = 1 AND b.side = 0""")
def _(spark, folder):
    d = table(spark, folder, "documents").withColumn("arm", F.when(F.col("doc_id") % 2 == 1, C.UNCERTAINTY).otherwise(C.RANDOM))
    scores = d.groupBy("category", "arm").agg(F.avg("n_chars").alias("score"))
    return C.paired(scores, ["category"], ["score"]).select("category", F.round("gap_score", 6).alias("gap"))


@query("g18_sweep_status", D.with_ctes(D.TRIALS) + "SELECT sweep, count(*) AS planned, count(*) FILTER (WHERE status = 'complete') AS complete, count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE status = 'complete') = count(*) AS done FROM trials GROUP BY sweep")
def _(spark, folder):
    return L.status_counts(D.trials(spark, folder), ["sweep"])


@query("o2_best_config", D.with_ctes(D.TRIALS) + """
SELECT sweep, config_id, score FROM (SELECT *, row_number() OVER (PARTITION BY sweep ORDER BY score DESC, config_id) AS r FROM trials WHERE status = 'complete') WHERE r = 1""")
def _(spark, folder):
    return C.best_config(D.trials(spark, folder).where("status = 'complete'"), ["sweep"])


@query("g40_seed_statistics", D.with_ctes(D.TRIALS) + "SELECT sweep, config_id, round(avg(score), 6) AS mean, round(coalesce(stddev_samp(score), 0), 6) AS sd FROM trials WHERE status = 'complete' GROUP BY ALL")
def _(spark, folder):
    t = D.trials(spark, folder).where("status = 'complete'")
    return t.groupBy("sweep", "config_id").agg(F.avg("score").alias("mean"), F.coalesce(F.stddev("score"), F.lit(0.0)).alias("sd")).select("sweep", "config_id", *r6("mean", "sd"))


@query("o4_declared_order", "SELECT o_orderpriority, count(*) AS n, list_position(['1-URGENT', '3-MEDIUM', '2-HIGH', '5-LOW', '4-NOT SPECIFIED'], o_orderpriority) AS place FROM orders GROUP BY o_orderpriority")
def _(spark, folder):
    order = F.array(*map(F.lit, ["1-URGENT", "3-MEDIUM", "2-HIGH", "5-LOW", "4-NOT SPECIFIED"]))
    counts = table(spark, folder, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"))
    return counts.withColumn("place", F.array_position(order, F.col("o_orderpriority")).cast("int")).orderBy("place")


@query("pv3_count_pivot", D.with_ctes(D.TRIALS) + "SELECT sweep, count(*) FILTER (WHERE status = 'complete') AS complete, count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE status = 'pending') AS pending FROM trials GROUP BY sweep")
def _(spark, folder):
    return D.trials(spark, folder).groupBy("sweep").pivot("status", ["complete", "failed", "pending"]).count().na.fill(0)


@query("u4_missing_types", D.with_ctes(D.TAGGED, D.GOLD) + "SELECT DISTINCT type FROM gold_chunks WHERE part = 'pool' EXCEPT SELECT DISTINCT type FROM gold_chunks WHERE part = 'bootstrap'")
def _(spark, folder):
    found = D.tagged(spark, folder).select("part", F.explode(spans.chunks(F.col("gold"))).alias("e")).select("part", F.col("e.type").alias("type"))
    return found.where("part = 'pool'").select("type").subtract(found.where("part = 'bootstrap'").select("type"))


@query("u7_merged_mentions", D.with_ctes(D.MENTIONS) + "SELECT id, count(*) AS n FROM (SELECT DISTINCT id, type, list_sort(list_distinct(tokens)) AS t FROM (SELECT id, type, tokens FROM gold_mentions UNION ALL SELECT id, type, tokens FROM pred_mentions)) GROUP BY id")
def _(spark, folder):
    d = D.documents_of_mentions(spark, folder)
    merged = annotation.merged_mentions(d.select("id", F.col("gold").alias("mentions")), d.select("id", F.col("predicted").alias("mentions")), "id")
    return merged.select("id", F.size("mentions").cast("long").alias("n"))


# ---- checks

@query("g53_tagged_audit", """
WITH c AS (SELECT count(*) FILTER (WHERE tokens IS NULL OR ner_tags IS NULL) AS null_arrays, count(*) FILTER (WHERE tokens IS NOT NULL AND ner_tags IS NOT NULL AND len(tokens) <> len(ner_tags)) AS unequal_lengths,
  coalesce(sum(len(list_filter(tokens, lambda x: x IS NULL OR regexp_matches(x, '^[\\s\\x{a0}]*$')))), 0)::BIGINT AS blank_words,
  coalesce(sum(len(list_filter(range(1, len(ner_tags) + 1), lambda i: coalesce(ner_tags[i], '') LIKE 'I-_%' AND (i = 1 OR NOT regexp_matches(coalesce(ner_tags[i - 1], ''), '^[BI]-.') OR substr(ner_tags[i - 1], 3) <> substr(ner_tags[i], 3))))), 0)::BIGINT AS stray_inside,
  coalesce(sum(len(list_filter(ner_tags, lambda x: x IS NULL OR NOT regexp_matches(x, '^(O|[BI]-.+)$')))), 0)::BIGINT AS damaged_tags FROM sentences)
SELECT "check", 0::BIGINT AS expected, observed, CASE WHEN observed = 0 THEN 'pass' ELSE 'fail' END AS status FROM (UNPIVOT c ON null_arrays, unequal_lengths, blank_words, stray_inside, damaged_tags INTO NAME "check" VALUE observed)""")
def _(spark, folder):
    return V.tagged_audit(table(spark, folder, "sentences"))


@query("v1_repeated_keys", "SELECT document_name, coalesce(sentence_id, -1) AS sentence_id, count(*) AS n FROM sentences GROUP BY ALL HAVING count(*) > 1")
def _(spark, folder):
    rows = table(spark, folder, "sentences").withColumn("sentence_id", F.coalesce("sentence_id", F.lit(-1)))
    return V.repeated_keys(rows, ["document_name", "sentence_id"])


@query("g53_gaps_in_ids", "SELECT document_name, min(sentence_id) AS first, max(sentence_id) AS last, count(DISTINCT sentence_id) AS n FROM sentences GROUP BY document_name HAVING count(DISTINCT sentence_id) <> max(sentence_id) - min(sentence_id) + 1")
def _(spark, folder):
    return V.gaps_in_ids(table(spark, folder, "sentences"), ["document_name"], "sentence_id")


@query("v4_prompt_leaks", """
WITH p AS (SELECT passage_id AS text_id, ' ' || trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'), ' ') || ' ' AS plain FROM eval_passages),
d AS (SELECT doc_id AS prompt_id, ' ' || trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'), ' ') || ' ' AS plain FROM documents)
SELECT text_id, prompt_id FROM p JOIN d ON contains(d.plain, p.plain) WHERE len(string_split(trim(p.plain, ' '), ' ')) >= 5""")
def _(spark, folder):
    prompts = table(spark, folder, "documents").select(F.col("doc_id").alias("prompt_id"), F.col("text").alias("prompt"))
    return V.contained_texts(table(spark, folder, "eval_passages").select(F.col("passage_id").alias("text_id"), "text"), prompts)


@query("v5_table_difference", "SELECT side, count(*) AS n FROM (SELECT 'left' AS side FROM (SELECT document_name, author FROM doc_registry EXCEPT ALL SELECT DISTINCT document_name, author FROM doc_registry) UNION ALL SELECT 'right' FROM (SELECT DISTINCT document_name, author FROM doc_registry EXCEPT ALL SELECT document_name, author FROM doc_registry)) GROUP BY side")
def _(spark, folder):
    r = table(spark, folder, "doc_registry").select("document_name", "author")
    return V.difference(r, r.distinct()).groupBy("side").agg(F.count("*").alias("n"))
