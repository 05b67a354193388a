import json

import pytest
from pyspark.sql import functions as F

from tagweave.functions import text
from tagweave.operators import annotation, ledger, reports as R, settings as S, testsplit as T
from tagweave.plans.order import numbered, ranks, running
from tagweave.plans.runtime import Scratch, shared_folder
from tagweave.plans.skew import join_counted
from tagweave.sources import runs, writers


def put(path, value):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(value if isinstance(value, str) else json.dumps(value, indent=1))


def sweep(root, name, dataset, metric="entropy", complete=("a",), failed=("b",)):
    fixed = {"checkpoint": "bert", **({"dataset": dataset} if dataset else {})}
    put(root / name / "plan.json", {"fixed_config": fixed, "num_configs": 2})
    items = [{"config_id": c, "status": "complete", "uq_metric": metric, "run_dir": f"runs/{c}", "parameters": {"k": 4, "rate": 0.5}} for c in complete]
    put(root / name / "summary.json", {"comparisons": items + [{"config_id": c, "status": "failed", "uq_metric": metric} for c in failed]})
    for c in complete:
        put(root / name / "runs" / c / "results.csv", "seed,arm,round,entity_f1\n0,random,0,0.5\n0,uncertainty,0,1\n")


def test_comparisons_of_sweeps(spark, tmp_path):
    sweep(tmp_path, "s1", None)
    sweep(tmp_path, "s2", "medical", "margin")
    put(tmp_path / "s3" / "plan.json", {"fixed_config": {"checkpoint": "x"}})
    rows = runs.parameter_columns(runs.comparisons(spark, str(tmp_path)), ["k", "gone"]).collect()
    assert sorted((r.dataset, r.model, r.uq_metric, r.config_id, r.arm, r.entity_f1, r.k, r.gone) for r in rows) == sorted(
        (d, "bert", m, "a", arm, y, "4", None) for d, m in (("pet", "entropy"), ("medical", "margin")) for arm, y in (("random", 0.5), ("uncertainty", 1.0)))
    assert runs.sweeps(spark, str(tmp_path)).where("comparisons is null").count() == 1
    (tmp_path / "s1" / "runs" / "a" / "results.csv").unlink()
    with pytest.raises(Exception, match="no results"):
        runs.comparisons(spark, str(tmp_path)).collect()


def test_supervised_runs_and_the_first_that_fits(spark, tmp_path):
    for k, (name, dataset) in enumerate((("s1", "medical"), ("s2", "pet"), ("s3", "pet"))):
        put(tmp_path / name / "plan.json", {"fixed_config": {"checkpoint": "bert", "dataset": dataset}})
        put(tmp_path / name / "summary.json", {"selection": {"config_id": "c", "validation_score": 0.25 * k}})
        put(tmp_path / name / "best_config.json", {"epochs": 3, "learning_rate": 0.1, "batch_size": 8, "weight_decay": 0.0})
        put(tmp_path / name / "test" / "pool_100pct" / "completed.json", {"run_dir": "runs/t"})
        put(tmp_path / name / "tuning" / "c" / "completed.json", {"run_dir": "runs/u"})
        put(tmp_path / name / "runs" / "t" / "results.csv", f"seed,entity_f1\n0,0.{k}\n1,0.5\n")
        put(tmp_path / name / "runs" / "t" / "config.json", {"checkpoint": "bert", "dataset": dataset})
    rows = runs.supervised(spark, str(tmp_path)).collect()
    assert sorted((r.dataset, r.seed, r.entity_f1, r.epochs, r.validation_score) for r in rows if r.seed == 0) == [("medical", 0, 0.0, 3, 0.0), ("pet", 0, 0.1, 3, 0.25), ("pet", 0, 0.2, 3, 0.5)] and len(rows) == 6
    first = runs.first_test_results(spark, str(tmp_path), "bert").collect()
    assert {r.sweep for r in first} == {"s2"} and len(first) == 2
    assert runs.first_test_results(spark, str(tmp_path), "other").count() == 0


def test_annotation_runs_are_scored_anew(spark, tmp_path):
    task = "md"
    for no, tags in ((1, ["B-A", "O"]), (2, ["O", "O"])):
        put(tmp_path / "pet-small-md" / f"run-{no}" / "run.json", {"config": "pet-small-md", "run": no, "settings": {"task": task, "model": "m"}})
        put(tmp_path / "pet-small-md" / f"run-{no}" / task / "test-predictions.jsonl", json.dumps({"document name": "d", "sentence-ID": 0, "tokens": ["x", "y"], "ner-tags": tags}) + "\n")
    put(tmp_path / "other" / "run-1" / "run.json", {"config": "other", "run": 1, "settings": {"task": "else"}})
    gold = spark.createDataFrame([("pet", "d", 0, ["x", "y"], ["B-A", "O"])], "dataset string, document_name string, sentence_id int, tokens array<string>, gold array<string>")
    out = runs.annotation_scores(spark, str(tmp_path), task, gold).collect()
    assert sorted((r.name, r.run, r.reasoning_effort, r.entity_f1) for r in out) == [("small", 1, "default", 1.0), ("small", 2, "default", 0.0)]
    with pytest.raises(Exception, match="another test split"):
        runs.annotation_scores(spark, str(tmp_path), task, gold.withColumn("tokens", F.array(F.lit("z")))).collect()


def test_small_readers(spark, tmp_path):
    put(tmp_path / "r1" / "selections.json", [{"seed": 1, "round": 0, "arm": "random", "pool_idx": 3, "word_idx": 1, "token": "a", "label": "X", "score": None}])
    row = runs.selections(spark, str(tmp_path / "*" / "selections.json")).first()
    assert (row.seed, row.pool_idx, row.label, row.run_dir[-2:]) == (1, 3, "X", "r1")
    assert runs.known_tokens(spark, str(tmp_path / "none.jsonl")).count() == 0
    df = spark.range(3)
    assert runs.same_rows(df, spark.range(3)).count() == 3
    with pytest.raises(ValueError):
        runs.same_rows(df, spark.range(4))
    results, chosen = runs.demo_run(spark)
    assert chosen.count() == 2 * 2 * 99 and results.where("round = 11").agg(F.min("percent_acquired")).first()[0] == 100.0
    docs = spark.createDataFrame([("a", "One two. Three!\nFour"), ("b", ""), ("c", None)], "id string, body string")
    made = {r.id: r.tokens for r in docs.select(*runs.document_of(F.col("id"), F.col("body"))).collect()}
    assert [(t["text"], t["index"], t["sentence_index"]) for t in made["a"]] == [("One", 0, 0), ("two", 1, 0), (".", 2, 0), ("Three", 3, 1), ("!", 4, 1), ("Four", 5, 2)] and not made["b"]


def test_predictions_on_test_sentences(spark, tmp_path):
    test = spark.createDataFrame([("d", 0, ["a", "b"]), ("d", 1, ["c", None]), ("e", 0, ["x"])], "document_name string, sentence_id int, tokens array<string>")
    schema = "id string, tokens array<struct<text:string,index:int,sentence_index:int>>, mentions array<struct<type:string,tokens:array<int>>>"
    whole = ("d", [("a", 0, 0), ("b", 1, 0), ("c", 2, 1), (None, 3, 1)], [("actor", [0, 1]), ("thing", [1]), ("thing", [2]), ("lost", [])])
    alone = ("d#1", [("c", 0, 0), ("", 1, 0)], [("actor", [1])])
    out = {(r.document_name, r.sentence_id): (r.tags, r.dropped) for r in T.on_test_sentences(test, spark.createDataFrame([whole, alone], schema), ["Actor"]).collect()}
    assert out == {("d", 0): (["B-Actor", "I-Actor"], 1), ("d", 1): (["O", "B-Actor"], 0), ("e", 0): (None, None)}
    found = T.on_test_sentences(test, spark.createDataFrame([whole], schema))
    assert not T.covers(found) and not writers.test_predictions(found, str(tmp_path / "p"))
    some = T.on_test_sentences(test.where("document_name = 'd'"), spark.createDataFrame([whole], schema))
    assert writers.test_predictions(some, str(tmp_path / "p")) and spark.read.json(str(tmp_path / "p")).count() == 2
    with pytest.raises(Exception, match="tokens differ"):
        T.on_test_sentences(test.withColumn("tokens", F.array(F.lit("q"))), spark.createDataFrame([whole], schema)).collect()
    with pytest.raises(Exception, match="no gold document"):
        gold = spark.createDataFrame([("z", [])], "id string, mentions array<struct<type:string,tokens:array<int>>>")
        T.known_documents(gold, gold.withColumn("id", F.lit("y"))).collect()


def test_running_sums_match_windows(spark):
    rows = [(k if k else None, i * 7919 % 1000, i % 5 if i % 11 else None) for i in range(400) for k in (i % 3,)]
    df = spark.createDataFrame(rows, "g int, o int, v int").repartition(5)
    out = {(r.g, r.o): r.v_before for r in running(df, ["g"], ["o"], ["v"], Scratch(spark, "t")).collect()}
    for g in (None, 1, 2):
        total = 0
        for _, o, v in sorted((r for r in rows if r[0] == g), key=lambda r: r[1]):
            assert out[g, o] == total
            total += v or 0
    assert sorted(r.n for r in numbered(df, [], ["o"], "n", Scratch(spark, "t")).collect()) == list(range(400))
    assert running(df.limit(0), ["g"], ["o"], ["v"], Scratch(spark, "t")).count() == 0
    hot = spark.range(1000).select(F.lit(1).alias("g"), "id")
    assert [r.n for r in numbered(hot, ["g"], ["id"], "n", Scratch(spark, "t")).orderBy("id").collect()] == list(range(1000))
    ranked = {r.v: r.rank for r in ranks(spark.createDataFrame([(1,), (1,), (5,), (7,)], "v int"), [], "v", Scratch(spark, "t")).collect()}
    assert ranked == {1: 1.5, 5: 3.0, 7: 4.0}


def test_hot_keys_are_joined_apart(spark, monkeypatch):
    from tagweave.plans import skew

    monkeypatch.setattr(skew, "HOT_ROWS", 5)
    rows = spark.createDataFrame([("a", i) for i in range(20)] + [("b", 30), ("c", 31), (None, 32)], "k string, i int")
    table = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    counts = rows.groupBy("k").agg(F.count("*").alias("n"))
    out = {r.i: r.v for r in join_counted(rows, table, "k", counts).collect()}
    assert len(out) == 23 and {out[i] for i in range(20)} == {1} and out[30] == 2 and out[31] is None and out[32] is None
    assert join_counted(rows, table, "k", counts, "inner").count() == 21


def test_a_cluster_must_name_its_folder(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda *_: None)

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_folder(Session())


def test_reports(spark):
    curves = spark.createDataFrame([("s", 0, a, r, 50.0 * r, 0.5 + 0.1 * r * (a == "uncertainty")) for a in ("random", "uncertainty") for r in range(3)], "k string, seed int, arm string, round int, x double, y double")
    assert round(R.gap_auc(curves, ["k"], "x", "y").first().gap_auc, 9) == 0.1
    with pytest.raises(Exception, match="both arms"):
        R.gap_auc(curves.where("not (arm = 'random' and round = 1)"), ["k"], "x", "y").collect()
    with pytest.raises(Exception, match="payload"):
        R.evaluation_payload(curves.withColumn("z", F.col("arm")), ["k", "seed", "round"], ["z"], ["y"]).collect()
    assert [r.n for r in spark.createDataFrame([("a",), (None,)], "v string").select(R.display(F.col("v"), {"a": "A"}).alias("n")).collect()] == ["A", None]
    with pytest.raises(Exception, match="no name"):
        spark.createDataFrame([("b",)], "v string").select(R.display(F.col("v"), {"a": "A"})).collect()
    one = spark.range(1).select(R.mean_and_deviation(F.lit(1.25), F.lit(None).cast("double")).alias("a"), R.mean_and_deviation(F.lit(1.25), F.lit(0.5)).alias("b"), R.same_number(F.lit(0.1) + F.lit(0.2), F.lit(0.3)).alias("c"),
                                text.html(F.lit("<a & 'b'>")).alias("d"), text.latex(F.lit("a_b\\{")).alias("e")).first()
    assert tuple(one) == ("", "1.2 ± 0.5", True, "&lt;a &amp; &#x27;b&#x27;&gt;", r"a\_b\textbackslash{}\{") or one.b == "1.3 ± 0.5"
    assert annotation.overlap_counts(spark.createDataFrame([("k", 0, 3), ("k", 3, 5), ("k", 4, 4), ("k", 9, 9), ("k", None, 2)], "k string, a int, b int"), ["k"], "a", "b").first().n == 2


def test_settings(spark, tmp_path):
    s = S.Settings({"name": S.Field(str, required=True, pattern=r"[a-z-]+"), "seeds": S.Field(list, default=[1], items=S.Field(int, low=0), unique=True), "rate": S.Field((int, float), default=0.1, low=0, high=1)},
                   [("a low rate needs a seed", lambda x: x["rate"] > 0.01 or x["seeds"])])
    assert s.checked({"name": "a-b"}) == {"name": "a-b", "seeds": [1], "rate": 0.1}
    for bad in ({}, {"name": "A"}, {"name": "a", "seeds": [1, 1]}, {"name": "a", "rate": 2}, {"name": "a", "other": 1}, {"name": "a", "seeds": [True]}, {"name": "a", "rate": 0.001, "seeds": []}):
        with pytest.raises(ValueError):
            s.checked(bad)
    assert s.without_defaults({"name": "a", "seeds": [1], "rate": 0.2}) == {"name": "a", "rate": 0.2}
    put(tmp_path / "c.json", {"name": "x"})
    assert s.read(spark, str(tmp_path / "c.json"))["name"] == "x"
    assert S.chosen(["a1", "a2", "b"], ["a*"]) == ["a1", "a2"] and S.chosen(["a"], []) == ["a"]
    with pytest.raises(ValueError):
        S.chosen(["a"], ["z*"])
    assert S.problems(spark, [{"name": "x", "gold": str(tmp_path / "c.json")}, {"name": "x", "gold": str(tmp_path / "d.json")}], ["gold"]) == ["x is the name of several", f"x needs {tmp_path / 'd.json'}"]
    one = spark.range(1).select(S.averaged(F.array(F.lit(1.0)), F.array(F.lit(3.0)), 0.25).alias("a"), *(S.schedule_factor(F.lit(i), 10, 2).alias(f"f{i}") for i in (0, 1, 2, 10))).first()
    assert tuple(one) == ([1.5], 0.0, 0.5, 1.0, 0.0)


def test_repeats_stop_at_the_first_failure(spark, tmp_path):
    seen = []

    def step(folder, no):
        seen.append(no)
        if no == 2 and len(seen) < 4:
            raise RuntimeError("late")
        return no

    assert ledger.run_repeats(spark, tmp_path / "r", 3, {"annotate": step}) == 1
    assert json.loads((tmp_path / "r" / "run-2" / "failure.json").read_text())["step"] == "annotate"
    seen += [0, 0]
    assert ledger.run_repeats(spark, tmp_path / "r", 3, {"annotate": step}) == 3 and seen.count(1) == 1
    scores = spark.createDataFrame([(2, 0.5), (1, 0.5), (3, 0.1)], "config_id int, score double")
    assert ledger.winner(scores, spark, tmp_path / "w.json", {1: {"k": 8}}) == {"config_id": 1, "score": 0.5, "k": 8}
    with pytest.raises(ValueError):
        ledger.winner(scores.where("config_id = 3"), spark, tmp_path / "w.json")
    writers.metrics(scores.limit(1), str(tmp_path / "m.json"))
    writers.progress(scores, str(tmp_path / "p"))
    writers.progress(scores.limit(1), str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 1
    writers.heatmap(spark.createDataFrame([(1, 0, "a", 0.5), (1, 1, "b", 0.1)], "row_id int, wid int, word string, score double"), str(tmp_path / "h"))
    assert [w.word for w in spark.read.json(str(tmp_path / "h")).first().words] == ["a", "b"]
