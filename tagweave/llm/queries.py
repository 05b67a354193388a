"""The queries of the training-data problems, by name, and the SQL of those that have any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tagweave.llm import consensus, entities, leaks, overlap, packing, pieces, sentences, subjects, terms
from tagweave.plans.runtime import Scratch, table

SHARES = {"train": 0.8, "validation": 0.1, "test": 0.1}


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    rows = entities.related_rows(table(spark, folder, "sentences"), table(spark, folder, "doc_registry"), Scratch(spark, "p1"))
    return rows.where("n_names > 1").select("row_id", "group_id")


def p1_splits(spark: SparkSession, folder: str) -> DataFrame:
    return entities.related_splits(table(spark, folder, "sentences"), table(spark, folder, "doc_registry"), Scratch(spark, "p1"), SHARES)


def p1_split_sizes(spark: SparkSession, folder: str) -> DataFrame:
    return p1_splits(spark, folder).groupBy("split").agg(F.count("*").alias("n_rows"), F.countDistinct("group_id").alias("n_groups"))


def _consensus(spark: SparkSession, folder: str) -> consensus.Consensus:
    return consensus.Consensus(table(spark, folder, "mention_items"), table(spark, folder, "mention_votes"), Scratch(spark, "p2"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return _consensus(spark, folder).labels().select("item_id", "mention_type")


def p2_agreement(spark: SparkSession, folder: str) -> DataFrame:
    return _consensus(spark, folder).labels()


def p2_reliability(spark: SparkSession, folder: str) -> DataFrame:
    """Reliability of every configuration, those without a vote included."""
    configs = table(spark, folder, "run_configs").select("config_name", "model_name", "reasoning_effort")
    return configs.join(_consensus(spark, folder).reliability(), "config_name", "left")


def p3_terms(spark: SparkSession, folder: str) -> DataFrame:
    return terms.term_counts(table(spark, folder, "sentences"), "row_id", ["tokens", "ner_tags"])


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return p3_terms(spark, folder).where("mark is not null").select("field_name", "term", "mark")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    return sentences.sentence_spans(documents, sentences.fit(documents, table(spark, folder, "annotated_docs")))


def p5_pieces(spark: SparkSession, folder: str) -> DataFrame:
    rows = pieces.oversized_pieces(table(spark, folder, "sentences"), "row_id", "tokens")
    documents = table(spark, folder, "annotated_docs").select("id", "text", F.col("tokens.text").alias("words"), F.col("tokens.sentence_index").alias("indices"))
    cut = pieces.oversized_pieces(documents, "id", "words", sentence_index="indices", text="text")
    return rows.withColumn("item_table", F.lit("sentences")).unionByName(cut.withColumn("item_table", F.lit("annotated_docs")))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return p5_pieces(spark, folder).where("piece_no = 0").select("item_table", "item_key", "cut_kind")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    pairs = overlap.cross_split_pairs(table(spark, folder, "sentences"), Scratch(spark, "p6"))
    return pairs.select(F.least("train_id", "eval_id").alias("row_id_a"), F.greatest("train_id", "eval_id").alias("row_id_b"))


def p6_report(spark: SparkSession, folder: str) -> DataFrame:
    """Evaluation rows with a partner in training, their pairs and the mean of their best coverage, by split and document."""
    rows = table(spark, folder, "sentences")
    scratch = Scratch(spark, "p6")
    of_row = scratch.keep(overlap.cross_split_pairs(rows, scratch).groupBy("eval_id").agg(F.count("*").alias("n_pairs"), F.min("edits").alias("edits"), F.max("coverage").alias("coverage")))
    where = rows.select(F.col("row_id").alias("eval_id"), F.lower(F.trim("split")).alias("split"), entities.document_key_of("document_name").alias("document"))
    return where.join(of_row, "eval_id").groupBy("split", "document").agg(
        F.count("*").alias("n_rows"), F.sum("n_pairs").alias("n_pairs"), F.sum(F.when(F.col("edits") == 0, 1).otherwise(0)).alias("n_same_rows"), F.round(F.avg("coverage"), 6).alias("coverage"))


def _subjects(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    boundaries = sentences.fit(documents, table(spark, folder, "annotated_docs"))
    classifier = subjects.fit(documents, table(spark, folder, "subject_labels"), table(spark, folder, "subject_areas"), boundaries)
    return subjects.document_subjects(documents, classifier)


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return _subjects(spark, folder).select("doc_id", "subject")


def p9_makeup(spark: SparkSession, folder: str) -> DataFrame:
    """Documents, and sentences that deal with it, of every subject by source and language."""
    code = F.substring(F.lower(F.trim("lang")), 1, 2)
    lang = F.when(code == "cn", "zh").when(code == "jp", "ja").otherwise(code)
    about = table(spark, folder, "documents").select("doc_id", "source", lang.alias("lang"))
    return about.join(_subjects(spark, folder), "doc_id").groupBy("source", "lang", "subject").agg(
        F.count("*").alias("n_documents"), F.round(F.sum(F.col("share") * F.col("n_sentences"))).cast("long").alias("n_sentences"))


def p7_containers(spark: SparkSession, folder: str) -> DataFrame:
    return packing.containers(table(spark, folder, "documents"), Scratch(spark, "p7"))


def p7_fill(spark: SparkSession, folder: str) -> DataFrame:
    """Containers by how full they are."""
    filled = p7_containers(spark, folder).groupBy("container_id").agg(F.sum("n_tokens").alias("n_tokens"))
    return filled.groupBy("n_tokens").agg(F.count("*").alias("n_containers"))


def _leaks(spark: SparkSession, folder: str) -> DataFrame:
    return leaks.leaked_passages(table(spark, folder, "documents"), table(spark, folder, "eval_passages"), Scratch(spark, "p8"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return _leaks(spark, folder).select("passage_id", "doc_id")


def p8_leaked_items(spark: SparkSession, folder: str) -> DataFrame:
    """Every passage with the documents that give it away, none for a clean one."""
    found = _leaks(spark, folder).groupBy("passage_id").agg(F.count("*").alias("n_documents"), F.max("part").alias("largest_part"))
    items = table(spark, folder, "eval_passages").select("passage_id", "test_set", "lang")
    return items.join(found, "passage_id", "left").select("passage_id", "test_set", "lang", F.coalesce("n_documents", F.lit(0)).alias("n_documents"), F.round(F.coalesce("largest_part", F.lit(0.0)), 6).alias("largest_part"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p1_found": p1_found, "p1_splits": p1_splits, "p1_split_sizes": p1_split_sizes, "p2_found": p2_found, "p2_agreement": p2_agreement, "p2_reliability": p2_reliability, "p3_found": p3_found, "p3_terms": p3_terms, "p4_found": p4_found, "p5_found": p5_found, "p5_pieces": p5_pieces, "p6_found": p6_found, "p6_report": p6_report, "p7_containers": p7_containers, "p7_fill": p7_fill, "p8_found": p8_found, "p8_leaked_items": p8_leaked_items, "p9_found": p9_found, "p9_makeup": p9_makeup}


# White space of any kind, as a class of DuckDB's patterns.
_BLANK = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]"

_TERMS = f"""
WITH v AS (SELECT 'tokens' AS field_name, row_id, unnest(tokens) AS v FROM sentences UNION ALL SELECT 'ner_tags', row_id, unnest(ner_tags) FROM sentences),
n AS (SELECT field_name, row_id, lower(regexp_replace(nfc_normalize(v), '^{_BLANK}+|{_BLANK}+$', '', 'g')) AS term FROM v WHERE v IS NOT NULL),
terms AS (SELECT field_name, term, count(*) AS n_occurrences, count(DISTINCT row_id) AS n_rows FROM n WHERE term <> '' GROUP BY ALL),
marked AS (SELECT *, CASE WHEN n_rows < 3 THEN 'rare' WHEN 5 * n_rows > (SELECT count(*) FROM sentences) THEN 'common' END AS mark FROM terms)
"""

_PIECES = f"""
WITH k AS (SELECT row_id, list_filter(tokens, lambda t: t IS NOT NULL AND NOT regexp_matches(t, '^{_BLANK}*$')) AS k FROM sentences),
rows_cut AS (
  SELECT row_id, list_concat([0], list_filter(range(1, len(k) + 1), lambda i: regexp_replace(k[i], '^{_BLANK}+|{_BLANK}+$', '', 'g') IN ('.', ';', ':', '!', '?')), [len(k)]) AS b FROM k WHERE len(k) > 200),
t AS (SELECT id, i, tokens[i].text AS w, tokens[i].sentence_index AS s FROM (SELECT id, tokens, unnest(range(1, len(tokens) + 1)) AS i FROM annotated_docs)),
f AS (SELECT id, i, w, last_value(s IGNORE NULLS) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s FROM t),
g AS (SELECT id, row_number() OVER p AS no, coalesce(s <> lag(s) OVER p, false) AS new FROM f WHERE w IS NOT NULL AND NOT regexp_matches(w, '^{_BLANK}*$') WINDOW p AS (PARTITION BY id ORDER BY i)),
docs_cut AS (SELECT id, list_concat([0], list(no - 1 ORDER BY no) FILTER (WHERE new), [max(no)]) AS b FROM g GROUP BY id HAVING max(no) > 200),
every AS (SELECT 'sentences' AS item_table, CAST(row_id AS VARCHAR) AS item_key, b FROM rows_cut UNION ALL SELECT 'annotated_docs', id, b FROM docs_cut)
SELECT item_table, item_key, CASE WHEN list_max(list_transform(range(1, len(b)), lambda i: b[i + 1] - b[i])) > 200 THEN 'forced' ELSE 'natural' END AS cut_kind FROM every
"""


def _plain(x: str) -> str:
    return f"regexp_replace(lower(trim(regexp_replace(nfc_normalize({x}), '{_BLANK}+', ' ', 'g'), ' ')), '[‐-―−]', '-', 'g')"


# Fixed values, written out once more so that SQL and query don't share a mistake: how a missing value is put in words.
_NO_NAMES = "'', '?', '-', '--', '<na>', '(none)', '(not given)', '(unknown)', 'missing', 'n.a.', 'n/a', 'na', 'nan', 'nil', 'none', 'not given', 'null', 'tbd', 'unbekannt', 'unknown'"


def _known(plain: str, x: str) -> str:
    return f"CASE WHEN {plain} NOT IN ({_NO_NAMES}) THEN {x} END"


def _shorter(x: str) -> str:
    ending = r"\.(?:ann|conll|csv|html|jsonl?|md|tsv|txt|xml)$"
    mark = r"(?:rev(?:ision)?|v(?:ersion)?)[\s._\-]*\d+"
    return f"regexp_replace(regexp_replace({x}, '{ending}', ''), '[\\s_.\\-]*\\(\\s*{mark}\\s*\\)$|[\\s_.\\-]+{mark}$', '')"


def _document_key(column: str) -> str:
    plain = _plain(column)
    base = f"trim(regexp_replace({plain}, '^.*[/\\\\]', ''), ' ')"
    for _ in range(3):
        base = _shorter(base)
    return _known(plain, f"trim(regexp_replace({base}, '[\\s_.\\-]+', '_', 'g'), '_')")


def _entity_key(column: str) -> str:
    plain = _plain(column)
    return _known(plain, f"replace({plain}, '\\', '/')")


_RELATED = f"""
WITH RECURSIVE s AS (SELECT row_id, document_name, {_document_key("document_name")} AS d FROM sentences WHERE document_name IS NOT NULL),
r AS (SELECT DISTINCT {_document_key("document_name")} AS d, {_entity_key("author")} AS a, {_entity_key("source_file")} AS f FROM doc_registry WHERE document_name IS NOT NULL),
links AS (SELECT d, 'a' || a AS e FROM r WHERE d IS NOT NULL AND a IS NOT NULL UNION SELECT d, 'f' || f FROM r WHERE d IS NOT NULL AND f IS NOT NULL),
near AS (SELECT DISTINCT x.d AS d1, y.d AS d2 FROM links x JOIN links y ON x.e = y.e),
reach(a, b) AS (SELECT DISTINCT d, d FROM s WHERE d IS NOT NULL UNION SELECT reach.a, near.d2 FROM reach JOIN near ON reach.b = near.d1),
groups AS (SELECT reach.a AS d, min(s.row_id) AS group_id, count(DISTINCT s.document_name) AS n_names FROM reach JOIN s ON reach.b = s.d GROUP BY reach.a)
SELECT s.row_id, groups.group_id FROM s JOIN groups ON s.d = groups.d WHERE n_names > 1
"""


# A draw within (0, 1) for a whole number, and the splits of 4096 ranges of it: 0.8, 0.1 and 0.1 of the rows.
_DRAW = "((((({0}) % 2147483648) * 2654435761) % 4294967296 % 2147483648 * 1103515245 + 12345) % 2147483648 + 0.5::DOUBLE) / 2147483648"
_SPLITS = _RELATED.replace("SELECT s.row_id, groups.group_id FROM s JOIN groups ON s.d = groups.d WHERE n_names > 1", f"""SELECT * FROM (
  WITH own AS (SELECT a.row_id, coalesce(groups.group_id, a.row_id) AS group_id FROM sentences a LEFT JOIN s ON a.row_id = s.row_id LEFT JOIN groups ON s.d = groups.d),
  ranged AS (SELECT row_id, group_id, floor({_DRAW.format("group_id")} * 4096) AS place FROM own),
  weights AS (SELECT place, count(*) AS n, sum(count(*)) OVER (ORDER BY place) AS upto, sum(count(*)) OVER () AS total FROM ranged GROUP BY place)
  SELECT row_id, group_id, CASE WHEN upto - n / 2 < 0.8 * total THEN 'train' WHEN upto - n / 2 < 0.9 * total THEN 'validation' ELSE 'test' END AS split FROM ranged JOIN weights USING (place))""")


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": _RELATED,
        "p1_splits": _SPLITS,
        "p1_split_sizes": f"SELECT split, count(*) AS n_rows, count(DISTINCT group_id) AS n_groups FROM ({_SPLITS}) GROUP BY split",
        "p3_terms": _TERMS + "SELECT field_name, term, n_occurrences, n_rows, mark FROM marked",
        "p3_found": _TERMS + "SELECT field_name, term, mark FROM marked WHERE mark IS NOT NULL",
        "p5_found": _PIECES,
    }
