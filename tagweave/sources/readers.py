"""Readers of corpora, runs and logs. All schemas are given, none is inferred but that of results tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tagweave.functions import spans, text

SENTENCES = "`document name` string, `sentence-ID` tinyint, tokens array<string>, `ner-tags` array<string>"
DOCUMENTS = (
    "id string, text string, category string, name string, tokens array<struct<text:string,indexInDocument:int,posTag:string,sentenceIndex:int>>,"
    " mentions array<struct<type:string,tokenDocumentIndices:array<int>>>, entities array<struct<mentionIndices:array<int>>>")
CALLS = (
    "document_id string, step string, started_at string, error string, duration_s double, response_model string, finish_reason string, prompt_tokens long,"
    " completion_tokens long, reasoning_tokens long, cached_tokens long, cost double, upstream_provider string, num_predicted int,"
    " issues array<struct<kind:string,message:string>>, response string")


def sentences(spark: SparkSession, path: str, tags: list[str] | None = None) -> DataFrame:
    """Sentence rows of JSON lines: ``document_name, sentence_id, tokens, ner_tags``; with ``tags``, tags as their numbers.

    A broken line, or a tag that isn't among ``tags``, is an error. Blank lines are skipped.
    """
    rows = spark.read.schema(SENTENCES).option("mode", "FAILFAST").json(path)
    out = rows.select(F.col("document name").alias("document_name"), F.col("sentence-ID").cast("int").alias("sentence_id"), "tokens", F.col("ner-tags").alias("ner_tags"))
    if tags is None:
        return out
    return out.withColumn("ner_tags", F.transform("ner_tags", lambda t: tag_number(t, tags)))


def tag_number(tag: Column, tags: list[str]) -> Column:
    place = F.array_position(F.array(*map(F.lit, tags)), tag)
    return F.when(place > 0, place - 1).otherwise(F.raise_error(F.concat(F.lit("unknown tag "), F.coalesce(tag, F.lit("null"))))).cast("int")


def tag_of(number: Column, tags: list[str]) -> Column:
    """The tag that tag_number gave a number to; a number of none is an error."""
    return F.coalesce(F.get(F.array(*map(F.lit, tags)), number.cast("int")), F.raise_error(F.concat(F.lit("unknown tag number "), number.cast("string"))).cast("string"))


def integer_tagged(spark: SparkSession, paths: list[str], types: list[str]) -> DataFrame:
    """Sentences with numbers for tags, from several files: 0 is 'O', odd numbers begin and even ones continue a type."""
    schema = "document_unique_id string, document_id string, sentence_id int, tokens array<string>, ner_tags array<int>"
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(paths)
    return rows.withColumn("ner_tags", F.transform("ner_tags", lambda n: number_tag(n, types)))


def number_tag(n: Column, types: list[str]) -> Column:
    name = F.get(F.array(*map(F.lit, types)), F.floor((n - 1) / 2).cast("int"))
    known = F.coalesce(name, F.raise_error(F.concat(F.lit("unknown tag number "), n.cast("string"))).cast("string"))
    return F.when(n == 0, "O").otherwise(F.concat(F.when(n % 2 == 1, "B-").otherwise("I-"), known))


def documents(spark: SparkSession, path: str) -> DataFrame:
    """Documents of JSON lines: types lower-cased and trimmed, tokens numbered by their place."""
    rows = spark.read.schema(DOCUMENTS).json(path)
    tokens = F.transform("tokens", lambda t, i: F.struct(t["text"].alias("text"), i.cast("int").alias("index"), t["posTag"].alias("pos_tag"), t["sentenceIndex"].alias("sentence_index")))
    mentions = F.transform("mentions", lambda m: F.struct(F.lower(F.trim(m["type"])).alias("type"), m["tokenDocumentIndices"].alias("tokens")))
    return rows.select("id", "text", "category", "name", tokens.alias("tokens"), mentions.alias("mentions"), "entities")


def either(spark: SparkSession, path: str) -> tuple[str, DataFrame]:
    """'sentences' or 'documents' and the rows, by the fields of the first line."""
    first = spark.read.text(path).where("trim(value) <> ''").limit(1).collect()
    kind = "sentences" if first and '"ner-tags"' in first[0][0] else "documents"
    return kind, (sentences if kind == "sentences" else documents)(spark, path)


def stand_off(spark: SparkSession, folder: str) -> DataFrame:
    """``document_name, text, spans`` of pairs of ``.txt`` and ``.ann`` files; offsets in bytes become characters.

    A span whose surface isn't the text at its place is an error; lines of other kinds are left out.
    """
    def stem(c):
        return F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.(?:txt|ann)$", 1)

    texts = spark.read.text(f"{folder}/*.txt", wholetext=True).select(stem("p").alias("document_name"), F.col("value").alias("text"))
    lines = spark.read.text(f"{folder}/*.ann").select(stem("p").alias("document_name"), text.annotation_line(F.col("value")).alias("a")).where("a is not null")
    joined = lines.join(texts, "document_name")
    start, end = (text.char_offset(F.col("text"), F.col(f"a.{c}")) for c in ("start", "end"))
    placed = joined.select("document_name", "text", F.col("a.type").alias("type"), start.alias("start"), end.alias("end"), F.col("a.surface").alias("surface"))
    right = F.substring("text", F.col("start") + 1, F.col("end") - F.col("start")) == F.col("surface")
    checked = placed.withColumn("type", F.when(right, F.col("type")).otherwise(F.raise_error(F.concat(F.lit("surface differs from text in "), F.col("document_name"))).cast("string")))
    spans = F.array_sort(F.collect_set(F.struct("start", "end", "type")))
    return texts.join(checked.groupBy("document_name").agg(spans.alias("spans")), "document_name", "left").withColumn("spans", F.coalesce("spans", F.array().cast("array<struct<start:int,end:int,type:string>>")))


def stand_off_sentences(docs: DataFrame) -> DataFrame:
    """Tagged sentences of stand-off documents, in columns: no document is shuffled.

    The longest span comes first, of equally long ones the earlier, and one that shares a word with a span
    before it is dropped, as is one that covers no word. Sentences end after a run of end marks and at line
    breaks. A document without words has no sentence.
    """
    longest = F.array_sort(F.transform("spans", lambda s: F.struct((s["start"] - s["end"]).alias("shortness"), s["start"].alias("start"), s["end"].alias("end"), s["type"].alias("type"))))
    placed = docs.select("document_name", text.words(F.col("text")).alias("w"), text.gaps(F.col("text")).alias("g"), text.word_spans(F.col("text")).alias("at"),
                         F.transform(longest, lambda s: F.struct(s["type"].alias("type"), s["start"].alias("start"), s["end"].alias("end"))).alias("s"))
    n = F.size("w")
    tagged = placed.where(n > 0).select("document_name", "w", "g", spans.tags_of(spans.over_words(F.col("s"), F.col("at")), n).alias("t"))

    cut = tagged.withColumn("c", F.filter(F.sequence(F.lit(0), n - 1), text.begins_sentence(F.col("w"), F.col("g"))))
    part = lambda c, k: F.coalesce(F.get("c", k + 1), n) - c
    # the tags come from Arrow, which a lambda can take as its argument only
    found = F.get(F.transform(F.array("t"), lambda t: F.transform("c", lambda c, k: F.struct(F.slice("w", c + 1, part(c, k)).alias("tokens"), F.slice(t, c + 1, part(c, k)).alias("ner_tags")))), 0)
    return cut.select("document_name", F.posexplode(found).alias("sentence_id", "s")).select("document_name", "sentence_id", "s.*")


def results(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Results tables of runs in one scan, with the folder that each row came from as ``run_dir``."""
    rows = spark.read.option("header", True).option("inferSchema", True).csv(paths)
    return rows.select("*", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1).alias("run_dir"))


def plans(spark: SparkSession, glob: str) -> DataFrame:
    """Plans or summaries, one JSON object a file, with their folder."""
    return spark.read.option("multiLine", True).json(glob).select("*", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1).alias("sweep"))


def calls(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CALLS).json(path)


def calls_stream(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(CALLS).json(folder)


def identity(spark: SparkSession, path: str) -> DataFrame:
    """File name and SHA-256 of each file."""
    return spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", "([^/]+)$", 1).alias("file"), F.sha2("content", 256).alias("sha256"))
