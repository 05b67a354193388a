"""Views of the test tables in the shapes that the operators take, each also as a common table expression."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tagweave.functions import spans
from tagweave.plans.runtime import table

ROUNDS = 29


def tagged(spark: SparkSession, folder: str) -> DataFrame:
    """Sentence rows with as many tags as tokens: ``row_id, document_name, part, tokens, gold, pred``.

    ``gold`` is the cleaned tags; ``pred`` differs from it by a rule on the row and place.
    """
    rows = table(spark, folder, "sentences").where("tokens is not null and ner_tags is not null and size(tokens) = size(ner_tags)")
    base = rows.select("row_id", "document_name", "sentence_id", F.lower(F.trim("split")).alias("part"), "tokens", spans.clean_tags(F.col("ner_tags")).alias("gold"))

    def change(t, i):
        m = (F.col("row_id") * 31 + i * 7) % 11
        return F.when((m == 0) | (t == "O"), "O").when(m == 1, F.concat(F.substring(t, 1, 2), F.lit("Activity"))).when(m == 2, F.concat(F.lit("I-"), F.substring(t, 3, 1000))).otherwise(t)

    return base.withColumn("pred", F.transform("gold", change))


TAGGED = """
cleaned AS (
  SELECT row_id, document_name, sentence_id, lower(trim(split, ' ')) AS part, tokens,
         list_transform(ner_tags, lambda t: CASE WHEN regexp_matches(coalesce(t, ''), '^[BI]-.') THEN t ELSE 'O' END) AS gold
  FROM sentences WHERE tokens IS NOT NULL AND ner_tags IS NOT NULL AND len(tokens) = len(ner_tags)),
tagged AS (
  SELECT *, list_transform(gold, lambda t, i: CASE
    WHEN (row_id * 31 + (i - 1) * 7) % 11 = 0 OR t = 'O' THEN 'O'
    WHEN (row_id * 31 + (i - 1) * 7) % 11 = 1 THEN substr(t, 1, 2) || 'Activity'
    WHEN (row_id * 31 + (i - 1) * 7) % 11 = 2 THEN 'I-' || substr(t, 3) ELSE t END) AS pred
  FROM cleaned)"""


def _chunk_cte(name: str, column: str) -> str:
    return f"""
{name} AS (
  SELECT row_id, document_name, part, tokens, substr({column}[s], 3) AS type, s - 1 AS first, e - 1 AS last FROM (
    SELECT *, unnest(list_filter(range(1, len({column}) + 1), lambda i: {column}[i] <> 'O' AND ({column}[i] LIKE 'B-%' OR i = 1 OR {column}[i - 1] = 'O'
                OR substr({column}[i - 1], 3) <> substr({column}[i], 3)))) AS s,
              unnest(list_filter(range(1, len({column}) + 1), lambda i: {column}[i] <> 'O' AND (i = len({column}) OR {column}[i + 1] = 'O' OR {column}[i + 1] LIKE 'B-%'
                OR substr({column}[i + 1], 3) <> substr({column}[i], 3)))) AS e
    FROM tagged))"""


GOLD, PRED = _chunk_cte("gold_chunks", "gold"), _chunk_cte("pred_chunks", "pred")


def words(spark: SparkSession, folder: str) -> DataFrame:
    """A row per word: ``row_id, document_name, part, wid, word, gold, pred``."""
    zipped = F.arrays_zip(F.col("tokens").alias("word"), "gold", "pred")
    return tagged(spark, folder).select("row_id", "document_name", "part", F.posexplode(zipped).alias("wid", "w")).select("row_id", "document_name", "part", "wid", "w.word", "w.gold", "w.pred")


WORDS = """
words AS (
  SELECT row_id, document_name, part, w - 1 AS wid, tokens[w] AS word, gold[w] AS gold, pred[w] AS pred
  FROM (SELECT *, unnest(range(1, len(tokens) + 1)) AS w FROM tagged))"""


def curves(spark: SparkSession, folder: str) -> DataFrame:
    """Daily means of the events of a user group, taken as the rounds of a run."""
    e = table(spark, folder, "events")
    u = F.col("user_id")
    keyed = e.select(
        F.concat(F.lit("d"), (u % 2).cast("string")).alias("dataset"), F.concat(F.lit("m"), (F.floor(u / 2) % 2).cast("string")).alias("model"),
        F.when(F.col("event_id") % 2 == 0, "entropy").otherwise("margin").alias("uq_metric"), (u % 3).cast("int").alias("seed"),
        F.when(F.col("event_type").isin("click", "purchase", "signup"), "uncertainty").otherwise("random").alias("arm"),
        F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).alias("round"), "value")
    return keyed.groupBy("dataset", "model", "uq_metric", "seed", "arm", "round").agg((F.avg("value") / 499).alias("entity_f1")).withColumn("percent_acquired", 100.0 * F.col("round") / ROUNDS)


CURVES = f"""
curves AS (
  SELECT 'd' || (user_id % 2) AS dataset, 'm' || ((user_id // 2) % 2) AS model, CASE WHEN event_id % 2 = 0 THEN 'entropy' ELSE 'margin' END AS uq_metric,
         CAST(user_id % 3 AS INTEGER) AS seed, CASE WHEN event_type IN ('click', 'purchase', 'signup') THEN 'uncertainty' ELSE 'random' END AS arm,
         CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER) AS round, avg(value) / 499 AS entity_f1,
         100.0::DOUBLE * CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER) / {ROUNDS} AS percent_acquired
  FROM events GROUP BY ALL)"""


def selections(spark: SparkSession, folder: str) -> DataFrame:
    """Words chosen in rounds: those inside an entity, by a rule on row and place."""
    w = words(spark, folder).where("gold <> 'O'")
    h = F.col("row_id") * 13 + F.col("wid") * 5
    return w.select((F.col("row_id") % 2).cast("int").alias("seed"), F.when(h % 3 == 0, "random").otherwise("uncertainty").alias("arm"), (h % 10).cast("int").alias("round"), "row_id", "wid", "word", spans.tag_type(F.col("gold")).alias("label"))


SELECTIONS = """
selections AS (
  SELECT CAST(row_id % 2 AS INTEGER) AS seed, CASE WHEN (row_id * 13 + wid * 5) % 3 = 0 THEN 'random' ELSE 'uncertainty' END AS arm,
         CAST((row_id * 13 + wid * 5) % 10 AS INTEGER) AS round, row_id, wid, word, substr(gold, 3) AS label
  FROM words WHERE gold <> 'O')"""


def probabilities(spark: SparkSession, folder: str) -> DataFrame:
    """Class probabilities: softmax of each vector."""
    from tagweave.operators.selection import softmax

    return table(spark, folder, "embeddings").select("vec_id", "label", softmax(F.transform("embedding", lambda v: v.cast("double"))).alias("p"))


PROBABILITIES = """
logits AS (SELECT vec_id, label, list_transform(embedding, lambda v: v::DOUBLE) AS x FROM embeddings),
shifted AS (SELECT vec_id, label, list_transform(x, lambda v: exp(v - list_max(x))) AS e FROM logits),
probabilities AS (SELECT vec_id, label, list_transform(e, lambda v: v / list_sum(e)) AS p FROM shifted)"""


def calls(spark: SparkSession, folder: str) -> DataFrame:
    """Votes as calls of annotating models: one of ``error`` or a type, with durations."""
    v = table(spark, folder, "mention_votes")
    error = F.when(F.col("mention_type").isNull() | (F.trim("mention_type") == ""), "no type")
    return v.select(
        "vote_id", "document_id", "config_name", "run_no", error.alias("error"), F.size("token_document_indices").cast("long").alias("num_predicted"),
        F.lower(F.trim("mention_type")).alias("finish"), F.when(F.col("run_no") > 1, F.col("vote_id") % 7).alias("cached"))


CALLS = """
calls AS (
  SELECT vote_id, document_id, config_name, run_no, CASE WHEN mention_type IS NULL OR trim(mention_type, ' ') = '' THEN 'no type' END AS error,
         len(token_document_indices) AS num_predicted, lower(trim(mention_type, ' ')) AS finish, CASE WHEN run_no > 1 THEN vote_id % 7 END AS cached
  FROM mention_votes)"""


def trials(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as the trials of a sweep."""
    o = table(spark, folder, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "complete").when(F.col("o_orderstatus") == "O", "failed").otherwise("pending")
    return o.select((F.col("o_custkey") % 30).alias("config_id"), F.col("o_orderpriority").alias("sweep"), status.alias("status"), (F.round(F.col("o_totalprice") / 1000) / 500).alias("score"), "o_orderkey")


TRIALS = """
trials AS (
  SELECT o_custkey % 30 AS config_id, o_orderpriority AS sweep,
         CASE o_orderstatus WHEN 'F' THEN 'complete' WHEN 'O' THEN 'failed' ELSE 'pending' END AS status, round(o_totalprice / 1000) / 500 AS score, o_orderkey
  FROM orders)"""


def documents_of_mentions(spark: SparkSession, folder: str) -> DataFrame:
    """Annotated documents with gold mentions, and predicted ones that leave out or move some by a rule."""
    d = table(spark, folder, "annotated_docs").where("mentions is not null and size(mentions) > 0")
    kind = lambda m: F.regexp_replace(F.lower(F.trim(m["mention_type"])), "[ _]+", " ")
    gold = F.transform("mentions", lambda m: F.struct(kind(m).alias("type"), m["token_document_indices"].alias("tokens")))
    numbered = F.transform("mentions", lambda m, i: F.struct((i % 5).alias("r"), kind(m).alias("type"), m["token_document_indices"].alias("tokens")))
    moved = F.transform(F.filter(numbered, lambda m: m["r"] != 0), lambda m: F.struct(m["type"].alias("type"), F.transform(m["tokens"], lambda t: F.when(m["r"] == 1, t + 1).otherwise(t)).alias("tokens")))
    return d.select("id", "category", gold.alias("gold"), moved.alias("predicted"))


MENTIONS = """
gold_mentions AS (
  SELECT id, category, i - 1 AS no, regexp_replace(lower(trim(mentions[i].mention_type, ' ')), '[ _]+', ' ', 'g') AS type, mentions[i].token_document_indices AS tokens
  FROM (SELECT *, unnest(range(1, len(mentions) + 1)) AS i FROM annotated_docs WHERE mentions IS NOT NULL AND len(mentions) > 0)),
pred_mentions AS (
  SELECT id, category, no, type, CASE WHEN no % 5 = 1 THEN list_transform(tokens, lambda t: t + 1) ELSE tokens END AS tokens
  FROM gold_mentions WHERE no % 5 <> 0)"""


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",".join(ctes) + "\n"
