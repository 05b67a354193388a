import json

import pytest
from pyspark.sql import functions as F

from tagweave.operators import ledger, quality
from tagweave.plans.runtime import Scratch
from tagweave.sources import readers, writers
from tagweave.streaming import live


def test_sentences(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_text('{"document name": "d", "sentence-ID": 0, "tokens": ["a", "b"], "ner-tags": ["O", "B-X"]}\n\n{"document name": "d", "sentence-ID": 1, "tokens": [], "ner-tags": []}\n')
    out = readers.sentences(spark, str(path), ["O", "B-X"]).orderBy("sentence_id").collect()
    assert [tuple(r) for r in out] == [("d", 0, ["a", "b"], [0, 1]), ("d", 1, [], [])]
    with pytest.raises(Exception, match="unknown tag"):
        readers.sentences(spark, str(path), ["O"]).collect()
    assert readers.either(spark, str(path))[0] == "sentences"


def test_integer_tags_of_two_files(spark, tmp_path):
    for k in (1, 2):
        (tmp_path / f"{k}.jsonl").write_text(json.dumps({"document_unique_id": f"u{k}", "document_id": "d", "sentence_id": 0, "tokens": ["a"] * 4, "ner_tags": [0, 1, 2, 3]}))
    out = readers.integer_tagged(spark, [str(tmp_path / f"{k}.jsonl") for k in (1, 2)], ["T1", "T2"]).collect()
    assert [r.ner_tags for r in out] == [["O", "B-T1", "I-T1", "B-T2"]] * 2
    with pytest.raises(Exception, match="unknown tag number"):
        readers.integer_tagged(spark, [str(tmp_path / "1.jsonl")], ["T1"]).collect()


def test_documents_round_trip(spark, tmp_path):
    (tmp_path / "d.jsonl").write_text(json.dumps({"id": "d", "text": "a b", "tokens": [{"text": "a", "indexInDocument": 9}, {"text": "b"}], "mentions": [{"type": " Actor", "tokenDocumentIndices": [1]}], "relations": []}))
    docs = readers.documents(spark, str(tmp_path / "d.jsonl"))
    r = docs.first()
    assert [t["index"] for t in r.tokens] == [0, 1] and r.mentions[0].type == "actor"
    writers.documents(docs, str(tmp_path / "out"))
    writers.documents(docs, str(tmp_path / "out"), append=True)
    assert spark.read.json(str(tmp_path / "out")).count() == 2


def test_stand_off(spark, tmp_path):
    (tmp_path / "a.txt").write_text("Où the clerk stamps it. New\nline here", encoding="utf-8")
    (tmp_path / "a.ann").write_text("T1\tActor 4 13\tthe clerk\nT2\tThing 8 13\tclerk\nR1\tx Arg1:T1\nT3\tTask 14 20\tstamps\n", encoding="utf-8")
    (tmp_path / "b.txt").write_text("no spans")
    docs = readers.stand_off(spark, str(tmp_path))
    out = readers.stand_off_sentences(docs).orderBy("document_name", "sentence_id").collect()
    assert [(r.document_name, r.tokens, r.ner_tags) for r in out] == [
        ("a", ["Où", "the", "clerk", "stamps", "it", "."], ["O", "B-Actor", "I-Actor", "B-Task", "O", "O"]), ("a", ["New"], ["O"]), ("a", ["line", "here"], ["O", "O"]), ("b", ["no", "spans"], ["O", "O"])]
    (tmp_path / "b.ann").write_text("T1\tX 0 2\twrong\n")
    with pytest.raises(Exception, match="surface differs"):
        readers.stand_off(spark, str(tmp_path)).collect()


def test_results_keep_their_run(spark, tmp_path):
    for k in (1, 2):
        (tmp_path / f"run{k}").mkdir()
        (tmp_path / f"run{k}" / "results.csv").write_text(f"seed,round,f1\n{k},0,0.5\n")
    assert sorted((r.run_dir, r.seed, r.f1) for r in readers.results(spark, str(tmp_path / "*" / "results.csv")).collect()) == [("run1", 1, 0.5), ("run2", 2, 0.5)]
    (tmp_path / "run1" / "plan.json").write_text(json.dumps({"mode": "tune"}, indent=1))
    assert [(r.mode, r.sweep) for r in readers.plans(spark, str(tmp_path / "*" / "plan.json")).collect()] == [("tune", "run1")]
    assert readers.identity(spark, str(tmp_path / "run1" / "plan.json")).first().file == "plan.json"


def test_predictions_pack_and_unpack(spark):
    df = spark.createDataFrame([(1, [["O", "B-X"], [], ["I-X"]]), (2, [])], "id int, predicted array<array<string>>")
    packed = writers.packed_predictions(df)
    assert packed.first().labels == ["B-X", "I-X", "O"]
    assert {r.id: r.predicted for r in writers.unpacked_predictions(packed).collect()} == {1: [["O", "B-X"], [], ["I-X"]], 2: []}


def test_tables_are_replaced_whole(spark, tmp_path):
    for n in (3, 1):
        writers.table_csv(spark.range(n), str(tmp_path / "t"))
    assert spark.read.option("header", True).csv(str(tmp_path / "t")).count() == 1
    with pytest.raises(ValueError):
        writers.run(spark.range(0).withColumn("run_id", F.lit(1)), str(tmp_path), "results")
    assert writers.snapshot_name(3, "margin", 7) == "seed3/margin/round_007"


def test_streams_agree_with_batches(spark, tmp_path):
    folder, seen = tmp_path / "calls", {}
    folder.mkdir()
    (folder / "1.json").write_text('{"document_id": "a", "step": "x", "prompt_tokens": 5, "started_at": "1"}\n{"document_id": "b", "step": "x", "started_at": "2"}\n')
    live_of = lambda: live.publish(live.live_totals(readers.calls_stream(spark, str(folder)), ["document_id"], ["prompt_tokens"]), str(tmp_path / "cp"), lambda df, _: seen.update({r.document_id: (r.n_calls, r.prompt_tokens) for r in df.collect()})).awaitTermination()
    live_of()
    assert seen == {"a": (1, 5), "b": (1, None)}
    (folder / "2.json").write_text('{"document_id": "a", "step": "x", "prompt_tokens": 7, "started_at": "3"}\n')
    live_of()  # goes on from the checkpoint
    assert seen == {r.document_id: (r.n_calls, r.prompt_tokens) for r in live.live_totals(readers.calls(spark, str(folder)), ["document_id"], ["prompt_tokens"]).collect()}
    newest = live.latest_by_key(readers.calls(spark, str(folder)), ["document_id"], "started_at", ["prompt_tokens"]).collect()
    assert {r.document_id: r.prompt_tokens for r in newest} == {"a": 7, "b": None}


def test_windows_of_events(spark):
    events = spark.createDataFrame([("2024-01-01 00:01:00", "x"), ("2024-01-01 00:09:00", "x"), ("2024-01-01 00:11:00", "x")], "t string, k string").withColumn("t", F.to_timestamp("t"))
    assert sorted(r.n for r in live.windowed_counts(events, "t", ["k"], "10 minutes", "1 hour").collect()) == [1, 2]


def test_ledger(spark, tmp_path):
    plan = ledger.sample_plan({"batch": [8, 16]}, (1e-5, 1e-3), 3, 7)
    assert plan == ledger.sample_plan({"batch": [8, 16]}, (1e-5, 1e-3), 3, 7) and all(1e-5 <= c["parameters"]["learning_rate"] <= 1e-3 for c in plan)

    def run(parameters):
        if parameters is plan[1]["parameters"]:
            raise RuntimeError("no memory")
        return 0.5

    ledger.run_pending(spark, tmp_path, plan[:2], run)
    table = ledger.ledger(spark, tmp_path, range(3))
    assert [(r.config_id, r.status, r.score, r.error) for r in table.collect()] == [(0, "complete", 0.5, None), (1, "failed", None, "RuntimeError: no memory"), (2, "pending", None, None)]
    counts = ledger.status_counts(table.withColumn("s", F.lit(1)), ["s"]).first()
    assert (counts.planned, counts.complete, counts.failed, counts.done) == (3, 1, 1, False)
    ledger.publish(spark, tmp_path / "p.json", {"a": 1}, keep=True)
    ledger.publish(spark, tmp_path / "p.json", {"a": 1}, keep=True)
    with pytest.raises(ValueError):
        ledger.publish(spark, tmp_path / "p.json", {"a": 2}, keep=True)


def test_job_order_and_blocking(spark):
    needs = {"b": ["a"], "c": ["b"], "d": []}
    assert ledger.job_order({"a": 1, "b": 5, "c": 5, "d": 3}, needs) == ["a", "b", "c", "d"]
    with pytest.raises(ValueError):
        ledger.job_order({"a": 1, "b": 1}, {"a": ["b"], "b": ["a"]})
    jobs = spark.createDataFrame([(j,) for j in "abcd"], "job string")
    edges = spark.createDataFrame([("b", "a"), ("c", "b")], "job string, needed string")
    assert sorted(r.job for r in ledger.blocked(jobs, edges, jobs.where("job = 'a'"), Scratch(spark, "t")).collect()) == ["b", "c"]


def test_checks(spark):
    df = spark.createDataFrame([(1, ["a", None, " "], ["O", "I-X", "B_X"]), (2, None, ["O"]), (3, ["a"], ["O", "O"])], "id int, tokens array<string>, ner_tags array<string>")
    assert {r.check: r.observed for r in quality.tagged_audit(df).collect()} == {"null_arrays": 1, "unequal_lengths": 1, "blank_words": 2, "stray_inside": 1, "damaged_tags": 1}
    assert quality.require_unique(df, ["id"]).count() == 3
    with pytest.raises(Exception, match="repeat"):
        quality.require_unique(df.unionByName(df), ["id"]).collect()
    assert quality.difference(df.select("id"), df.select("id").where("id > 1")).first().side == "left"
    assert quality.ordinal_difference(df.select("id", "ner_tags"), df.select("id", F.array(F.lit("O")).alias("ner_tags")), "id").count() == 2
    prompts = spark.createDataFrame([("p", "Say: The clerk stamps the old form! End"), ("q", "nothing")], "prompt_id string, prompt string")
    texts = spark.createDataFrame([(1, "the clerk, stamps the old form"), (2, "the clerk"), (3, "The clerk stamps the old form!"), (4, None), (5, "the clerk stamps the old forms")], "text_id int, text string")
    assert sorted(tuple(r) for r in quality.contained_texts(texts, prompts.unionByName(spark.createDataFrame([("n", None)], prompts.schema))).collect()) == [(1, "p"), (3, "p")]
    assert quality.all_checks([quality.check(df, "rows", F.count("*"), 3), quality.check(df, "none", F.count("*"))]).where("status = 'pass'").count() == 1
