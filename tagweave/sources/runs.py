"""Scans of the folders that sweeps and runs leave. Each kind of file is read by one scan, however many runs there are."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tagweave.functions import text
from tagweave.operators import evaluation
from tagweave.sources import readers

PLAN = "fixed_config map<string,string>, num_configs int, search_space map<string,string>"
_ITEM = "struct<config_id:string,status:string,uq_metric:string,run_dir:string,parameters:map<string,string>>"
SUMMARY = f"complete boolean, comparisons array<{_ITEM}>, trials array<{_ITEM}>, test_runs array<struct<slot:string,status:string>>, selection struct<config_id:string,validation_score:double>"
MANIFEST = "config string, run int, settings struct<task:string,dataset:string,model:string,reasoning_effort:string>"
PREDICTIONS = "`document name` string, `sentence-ID` int, tokens array<string>, `ner-tags` array<string>"


def _folder(up: int = 0) -> Column:
    """The folder of the file, or the one so many above it."""
    return F.regexp_replace(F.col("_metadata.file_path"), "(?:/[^/]+){%d}$" % (up + 1), "")


def _files(spark: SparkSession, root: str, name: str, schema: str) -> DataFrame:
    """JSON objects of all files of a name below ``root``, a file each, with their ``folder``."""
    rows = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", name).json(root)
    return rows.select("*", _folder().alias("folder"))


def _tables(spark: SparkSession, root: str) -> DataFrame:
    """Rows of all results tables below ``root``, in one scan, with their ``folder``."""
    rows = spark.read.option("header", True).option("inferSchema", True).option("recursiveFileLookup", True).option("pathGlobFilter", "results.csv").csv(root)
    return rows.select("*", _folder().alias("folder"))


def sweeps(spark: SparkSession, root: str) -> DataFrame:
    """``folder, dataset, model`` (from the plan, never from names), plan and, where there is one, summary of every sweep.

    A plan without a dataset is from before there were several: 'pet'.
    """
    plans = _files(spark, root, "plan.json", PLAN)
    fixed = lambda k: F.try_element_at(F.col("fixed_config"), F.lit(k))
    named = plans.select("folder", F.coalesce(fixed("dataset"), F.lit("pet")).alias("dataset"), fixed("checkpoint").alias("model"), F.coalesce(fixed("gumbel_noise") == "true", F.lit(False)).alias("noisy"), "num_configs")
    return named.join(_files(spark, root, "summary.json", SUMMARY), "folder", "left")


def comparisons(spark: SparkSession, root: str) -> DataFrame:
    """Every results row of every completed comparison, with its sweep's dataset, model and kind of acquisition, and its
    metric, configuration and sampled ``parameters``. A completed comparison without results is an error."""
    done = sweeps(spark, root).select("folder", "dataset", "model", "noisy", F.explode("comparisons").alias("c")).where("c.status = 'complete'")
    keys = done.select(F.concat_ws("/", "folder", "c.run_dir").alias("folder"), "dataset", "model", "noisy", F.col("c.uq_metric").alias("uq_metric"), F.col("c.config_id").alias("config_id"), F.col("c.parameters").alias("parameters"))
    rows = _tables(spark, root).withColumn("_there", F.lit(True)).drop("uq_metric", "dataset", "model", "config_id")
    there = F.when(F.col("_there"), True).otherwise(F.raise_error(F.concat(F.lit("no results in "), F.col("folder"))).cast("boolean"))
    return keys.join(rows, "folder", "left").where(there).drop("_there").withColumnRenamed("folder", "run_dir")


def parameter_columns(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    """Sampled parameters as columns, null where a run has none."""
    return rows.withColumns({n: F.try_element_at(F.col("parameters"), F.lit(n)) for n in names}).drop("parameters")


def supervised(spark: SparkSession, root: str) -> DataFrame:
    """Test rows of every supervised sweep with a summary, with the winner's settings and its validation score."""
    best = _files(spark, root, "best_config.json", "epochs int, learning_rate double, batch_size int, weight_decay double")
    sweep = sweeps(spark, root).where("selection is not null").select("folder", "dataset", "model", F.col("selection.validation_score").alias("validation_score")).join(best, "folder")
    markers = _files(spark, root, "completed.json", "run_dir string").where(F.col("folder").rlike("/test/[^/]+$"))
    runs = markers.select(F.regexp_replace("folder", "/test/[^/]+$", "").alias("folder"), F.col("run_dir").alias("_run"))
    keyed = sweep.join(runs, "folder").withColumn("run_dir", F.concat_ws("/", "folder", "_run")).drop("folder", "_run")
    return keyed.join(_tables(spark, root).drop("dataset", "model").withColumnRenamed("folder", "run_dir"), "run_dir")


def first_test_results(spark: SparkSession, root: str, checkpoint: str, dataset: str = "pet", percent: float = 100.0) -> DataFrame:
    """Test rows of the first sweep, by name, whose saved settings are those asked for; none if there isn't any."""
    saved = _files(spark, root, "config.json", "checkpoint string, dataset string, dataset_percent double")
    fits = saved.where((F.col("checkpoint") == checkpoint) & (F.coalesce("dataset", F.lit("pet")) == dataset) & (F.coalesce("dataset_percent", F.lit(100.0)) == percent)).select("folder")
    markers = _files(spark, root, "completed.json", "run_dir string").where(F.col("folder").rlike("/test/[^/]+$"))
    runs = markers.select(F.regexp_replace("folder", "/test/[^/]+$", "").alias("sweep"), "run_dir").select("sweep", F.concat_ws("/", "sweep", "run_dir").alias("folder"))
    rows = runs.join(fits, "folder", "left_semi").join(_tables(spark, root), "folder")
    first = rows.agg(F.min("sweep").alias("sweep"))  # one row
    return rows.join(F.broadcast(first), "sweep", "left_semi").withColumn("sweep", F.regexp_extract("sweep", "([^/]+)$", 1)).drop("folder")


def selections(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Words that runs chose: files that hold one JSON array each, with their ``run_dir``."""
    rows = spark.read.schema("seed int, round int, arm string, pool_idx int, word_idx int, token string, label string, score double").option("multiLine", True).json(paths)
    return rows.select("*", _folder().alias("run_dir"))


def annotation_runs(spark: SparkSession, root: str, task: str) -> DataFrame:
    """``run_dir`` and settings of every finished run of a task. Runs from before there were several datasets are 'pet'."""
    rows = _files(spark, root, "run.json", MANIFEST).where(F.col("settings.task") == task)
    effort = F.coalesce("settings.reasoning_effort", F.lit("default"))
    dataset = F.coalesce("settings.dataset", F.lit("pet"))
    name = text.between(F.col("config"), "", f"-{task}")
    name = F.when(F.startswith(name, F.concat(dataset, F.lit("-"))), F.substring(name, F.length(dataset) + 2, F.lit(1 << 20))).otherwise(name)
    return rows.select(F.col("folder").alias("run_dir"), dataset.alias("dataset"), name.alias("name"), effort.alias("reasoning_effort"), F.col("settings.model").alias("model"), "run")


def predictions(spark: SparkSession, root: str, file: str = "test-predictions.jsonl") -> DataFrame:
    """Predicted sentences of all runs, of both layouts (``run-1/task/file`` and ``task/file``), with their ``run_dir``."""
    rows = spark.read.schema(PREDICTIONS).option("recursiveFileLookup", True).option("pathGlobFilter", file).json(root)
    return rows.select(
        _folder(1).alias("run_dir"), F.regexp_extract(_folder(), "([^/]+)$", 1).alias("task"), F.col("document name").alias("document_name"), F.col("sentence-ID").alias("sentence_id"), "tokens", F.col("ner-tags").alias("tags"))


def annotation_scores(spark: SparkSession, root: str, task: str, gold: DataFrame) -> DataFrame:
    """The nine scores of every finished run of a task, its predictions scored anew against ``gold(dataset, document_name,
    sentence_id, tokens, gold)``. A run that lacks a gold sentence, or has other words in one, is an error."""
    runs = annotation_runs(spark, root, task)
    found = predictions(spark, root).where(F.col("task") == task).select("run_dir", "document_name", "sentence_id", F.col("tokens").alias("_tokens"), F.col("tags").alias("pred"))
    there = runs.join(found.select("run_dir").distinct(), "run_dir", "left_semi")
    rows = there.join(gold, "dataset").join(found, ["run_dir", "document_name", "sentence_id"], "left")
    same = F.when(F.col("_tokens").eqNullSafe(F.col("tokens")), F.col("pred")).otherwise(F.raise_error(F.concat(F.lit("another test split in "), F.col("run_dir"))).cast("array<string>"))
    scores = evaluation.evaluation(rows.withColumn("pred", same), ["run_dir"])
    return there.join(scores, "run_dir")


def same_rows(saved: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """``saved``, if it has the rows that were built anew; else an error."""
    if not saved.exceptAll(rebuilt).isEmpty() or not rebuilt.exceptAll(saved).isEmpty():
        raise ValueError("the saved rows differ from those built anew")
    return saved


def known_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``document_name, sentence_id, tokens`` of a file of sentences; empty if there is no file."""
    from tagweave.plans import files

    if not files.exists(spark, path):
        return spark.createDataFrame([], "document_name string, sentence_id int, tokens array<string>")
    return readers.sentences(spark, path).select("document_name", "sentence_id", "tokens")


def demo_run(spark: SparkSession, words: int = 99, k: int = 9, seeds: Sequence[int] = (0, 1)) -> tuple[DataFrame, DataFrame]:
    """Results and selections of a made-up run of both arms, for tests and displays: the uncertain arm rises faster."""
    arms = F.explode(F.array(F.lit("random"), F.lit("uncertainty"))).alias("arm")
    seed = F.explode(F.array(*map(F.lit, seeds))).alias("seed")
    rounds = -(-words // k)
    rows = spark.range(rounds + 1).select(F.col("id").cast("int").alias("round"), arms).select("*", seed)
    got = F.least(F.col("round") * k, F.lit(words))
    rate = F.when(F.col("arm") == "uncertainty", 3.0).otherwise(2.0) + F.col("seed") * 0.1
    results = rows.select("seed", "arm", "round", got.alias("n_acquired"), (100.0 * got / words).alias("percent_acquired"), (0.9 * (1 - F.exp(-rate * got / words))).alias("entity_f1"))
    chosen = spark.range(words).select(F.col("id").cast("int").alias("wid"), arms).select("*", seed)
    place = F.when(F.col("arm") == "uncertainty", F.lit(words - 1) - F.col("wid")).otherwise(F.col("wid"))
    selections_ = chosen.select("seed", "arm", (F.floor(place / k) + 1).cast("int").alias("round"), "wid", F.concat(F.lit("word"), F.col("wid").cast("string")).alias("word"), F.when(F.col("wid") % 3 == 0, "Actor").otherwise("Activity").alias("label"))
    return results, selections_


def document_of(id: Column, body: Column) -> tuple[Column, ...]:
    """Columns of a document made of a plain text: its words, numbered, with their sentences; no tags of speech."""
    def numbered(s):
        def part(c, k):
            words = F.slice(s["w"], c + 1, F.coalesce(F.get(s["c"], k + 1), F.size(s["w"])) - c)
            return F.transform(words, lambda t: F.struct(t.alias("text"), k.cast("int").alias("sentence_index")))

        return F.flatten(F.transform(s["c"], part))

    def cut(s):
        n = F.size(s["w"])
        places = F.when(n > 0, F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))).otherwise(F.array().cast("array<int>"))
        return F.struct(s["w"].alias("w"), F.filter(places, text.begins_sentence(s["w"], s["g"])).alias("c"))

    words = F.struct(text.words(body).alias("w"), text.gaps(body).alias("g"))
    tokens = F.transform(text.bound(text.bound(words, cut), numbered), lambda t, i: F.struct(t["text"].alias("text"), i.cast("int").alias("index"), F.lit("").alias("pos_tag"), t["sentence_index"].alias("sentence_index")))
    return id.alias("id"), body.alias("text"), tokens.alias("tokens")
