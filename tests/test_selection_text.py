import pytest
from pyspark.sql import functions as F

from tagweave.functions import text
from tagweave.operators import annotation, loop, profile, selection as A
from tagweave.plans.runtime import Scratch


def one(spark, schema, row, column):
    return spark.createDataFrame([row], schema).select(column.alias("x")).first().x


def test_uncertainty(spark):
    df = spark.createDataFrame([([0.8, 0.1, 0.1],)], "p array<double>").select(*(f(F.col("p")).alias(n) for n, f in A.METRICS.items())).first()
    assert [round(df[n], 6) for n in A.METRICS] == [0.581672, 0.2, 0.3]


def test_cap_fills_up_from_those_passed_over(spark):
    rows = spark.createDataFrame([(0, 0, "The", 0.9), (0, 1, "the", 0.8), (1, 0, "THE", 0.7), (2, 0, "new", 0.6), (3, 0, "x", 0.6)], "s int, w int, t string, score double")
    pick = lambda k, cap: [(r.s, r.w) for r in A.top(rows, k, "score", ["s", "w"], cap=cap, form="t").orderBy("rank").collect()]
    assert pick(3, 1) == [(0, 0), (2, 0), (3, 0)] and pick(4, 1) == [(0, 0), (2, 0), (3, 0), (0, 1)] and pick(2, None) == [(0, 0), (0, 1)] and len(pick(9, 1)) == 5


def test_gumbel_puts_a_score_of_nothing_last(spark):
    rows = spark.range(40).select("id", F.when(F.col("id") == 7, 0.0).otherwise(0.5).alias("s")).withColumn("g", A.gumbel_score(F.col("s"), A.uniform(1, F.col("id"))))
    assert A.top(rows, 40, "g", ["id"]).orderBy("rank").collect()[-1].id == 7


def test_draws_do_not_depend_on_partitioning(spark):
    pick = lambda n: sorted(r.id for r in A.random_choice(spark.range(500).repartition(n), 20, 9, F.col("id"), ["id"]).collect())
    assert pick(1) == pick(7) and len(set(pick(1))) == 20
    u = spark.range(20_000).select(A.uniform(3, F.col("id")).alias("u")).agg(F.avg("u"), F.min("u"), F.max("u")).first()
    assert abs(u[0] - 0.5) < 0.02 and 0 < u[1] and u[2] < 1


def test_first_rows_of_many_equal_ones(spark, monkeypatch):
    monkeypatch.setattr(A, "FEW", 7)
    rows = spark.range(600).select(F.when(F.col("id") % 5 > 0, (F.col("id") % 4) / 8).alias("x"), F.when(F.col("id") > 30, (F.col("id") * 7) % 601).alias("k"), "id")
    for n in (0, 1, 60, 121, 300, 599, 600, 700):
        assert sorted(r.id for r in rows.where(A.first_rows(rows, n, ["x", "k", "id"], 16)).collect()) == sorted(r.id for r in rows.orderBy("x", "k", "id").limit(n).collect())


def test_rounds_of_a_loop_are_evaluated_together(spark, monkeypatch):
    calls, evaluated = [], loop.evaluation.evaluation
    monkeypatch.setattr(loop.evaluation, "evaluation", lambda *a: calls.append(1) or evaluated(*a))
    df = spark.createDataFrame([(s, w, f"f{(s * 3 + w) % 6}", "B-Actor" if w else "O") for s in range(10) for w in range(3)], "s int, wid int, word string, gold string")
    results, chosen = loop.run(df.where("s < 1"), df.where("s between 1 and 7"), df.where("s > 7"), Scratch(spark, "t"), "s", 5, 50.0, "entropy", 1)
    assert len(calls) == 1 and results.count() == 6 and chosen.count() == 20


def test_splits_are_exact_in_size(spark):
    parts = {r.part: r["count"] for r in A.split_rows(spark.range(417), F.col("id"), ["id"], 0.2, 5, 3407).groupBy("part").count().collect()}
    assert parts == {"test": 84, "bootstrap": 5, "pool": 328}
    assert A.split_rows(spark.range(0), F.col("id"), ["id"], 0.2, 5).count() == 0


def test_schedule_and_rounding(spark):
    assert [tuple(x) for x in one(spark, "n int", (10,), A.schedule(F.col("n"), 4, 90.0))] == [(1, 4, 4), (2, 4, 8), (3, 1, 9)]
    assert one(spark, "n int", (0,), A.schedule(F.col("n"), 4, 90.0)) is None
    assert A.prefix(spark.range(10).withColumnRenamed("id", "o"), "o", 25.0).count() == 2
    with pytest.raises(ValueError):
        A.prefix(spark.range(1).withColumnRenamed("id", "o"), "o", 25.0)


def test_words_and_offsets(spark):
    line = "The U.S. café's well-kept form\xa0(no. 3)…"
    found = one(spark, "t string", (line,), text.word_spans(F.col("t")))
    assert [w.word for w in found] == ["The", "U.S.", "café's", "well-kept", "form", "(", "no", ".", "3", ")", "…"]
    assert all(line[w.start : w.end] == w.word for w in found)
    assert one(spark, "t string", (line,), text.words(F.col("t"))) == [w.word for w in found]
    assert one(spark, "t string", (None,), text.word_spans(F.col("t"))) == []
    assert one(spark, "t string, n int", ("aé漢b", 6), text.char_offset(F.col("t"), F.col("n"))) == 3


def test_annotation_lines(spark):
    assert tuple(one(spark, "l string", ("T1\tActor 3 8\tclerk",), text.annotation_line(F.col("l")))) == ("T1", "Actor", 3, 8, "clerk")
    assert one(spark, "l string", ("R1\tx",), text.annotation_line(F.col("l"))) is None


def test_answer_lines(spark):
    parse = lambda line: tuple(one(spark, "l string", (line,), text.answer_line(F.col("l"), F.lit(3))))
    assert parse("the clerk\tActor\t2") == ("the clerk", "actor", 2, None)
    assert parse("the clerk\tActor\t3")[3] == parse("a\tb\tx")[3] == parse("a\tb\t1\tc\td")[3] == "dropped_malformed"
    assert parse("")[3] == parse("only words")[3] == "ignored_line"


def test_clusters(spark):
    assert one(spark, "a string, n int", ("0 2\nx 1\n3 9 4", 5), text.cluster_lines(F.col("a"), F.col("n"))) == [[0, 2], [], [3, 4], [1]]


def test_inline_tags(spark):
    m = [("Activity Data", [1, 2]), ("actor", [2])]
    out = one(spark, "t array<string>, m array<struct<type:string,tokens:array<int>>>", (["a", "b", "c"], m), text.inline_tags(F.col("t"), F.col("m")))
    assert out == "a <activity_data id=0> b <actor id=1> c </actor> </activity_data>"


def test_placed_mentions(spark):
    sentences = spark.createDataFrame([("d", 0, "the old clerk sees the old clerk".split())], "id string, sentence int, tokens array<string>")
    lines = spark.createDataFrame([("d", 0, "old clerk", "actor", 0, None), ("d", 1, "old clerk", "actor", 0, None), ("d", 2, "old clerk", "actor", 0, None), ("d", 3, "seees", "activity", 0, None), ("d", 4, "zebra", "actor", 0, None), ("d", 5, None, None, None, "ignored_line")],
                                  "id string, line_no int, text string, type string, sentence int, issue string")
    out = {r.line_no: (r.first, r.last, r.issue) for r in annotation.placed_mentions(lines, sentences, ["id"]).collect()}
    assert out == {0: (1, 2, None), 1: (5, 6, None), 2: (None, None, "dropped_no_free_occurrence"), 3: (3, 3, "placed_fuzzy"), 4: (None, None, "dropped_not_found")}


def test_documents_need_ids_without_a_gap(spark):
    schema = "document_name string, sentence_id int, tokens array<string>, tags array<string>"
    good = annotation.documents_from_sentences(spark.createDataFrame([("d", 1, ["x", "y"], ["O", "B-Actor"]), ("d", 0, ["a"], ["B-Task"])], schema), Scratch(spark, "t")).first()
    assert [tuple(m) for m in good.mentions] == [("task", [0]), ("actor", [2])] and [t.text for t in good.tokens] == ["a", "x", "y"]
    with pytest.raises(Exception, match="in order"):
        annotation.documents_from_sentences(spark.createDataFrame([("d", 1, ["x"], ["O"])], schema), Scratch(spark, "t")).collect()


def test_annotate_stops_after_failures(spark):
    def annotator(body):
        if body == "bad":
            raise OSError("down")
        return body.upper()

    todo = spark.createDataFrame([(str(i), b) for i, b in enumerate(["a", "bad", "bad", "b", "bad", "bad", "bad", "c"])], "id string, body string").coalesce(1)
    out = {r.id: (r.answer, r.error) for r in annotation.annotate(todo, annotator, Scratch(spark, "t"), wave=7).collect()}
    assert out["0"] == ("A", None) and out["1"] == (None, "OSError: down") and out["3"] == ("B", None) and out["7"] == (None, "stopped")


def test_templates():
    assert annotation.fill_template("{{a}} and {{b}}", {"a": "1", "b": "2"}) == "1 and 2"
    for values in ({"a": "1"}, {"a": "1", "b": "2", "c": "3"}):
        with pytest.raises(ValueError):
            annotation.fill_template("{{a}} and {{b}}", values)


def test_windows_leave_out_a_short_tail(spark):
    words = spark.createDataFrame([("d", i, w, True) for i, w in enumerate("a a b c c".split())], "ds string, wid int, word string, entity boolean")
    assert [(r.window, r.ttr) for r in profile.window_ttr(words, ["ds"], ["wid"], 2, Scratch(spark, "t")).orderBy("window").collect()] == [(0, 0.5), (1, 1.0)]


def test_loop_draws_without_replacement_and_arms_share_round_0(spark):
    words = [(s, i, w, t) for s in range(12) for i, (w, t) in enumerate([("the", "O"), (f"n{s % 4}", "B-X"), (f"v{s % 3}", "B-Y")])]
    df = spark.createDataFrame(words, "s int, wid int, word string, gold string")
    results, chosen = loop.run(df.where("s < 1"), df.where("s between 1 and 7"), df.where("s > 7"), Scratch(spark, "t"), "s", 5, 50.0, "entropy", 1)
    out = {(r.arm, r.round): r for r in results.collect()}
    assert [out["random", i].n_acquired for i in range(3)] == [0, 5, 10] and out["random", 0].entity_f1 == out["uncertainty", 0].entity_f1
    picked = [(r.arm, r.s, r.wid) for r in chosen.collect()]
    assert len(picked) == len(set(picked)) == 20 and out["uncertainty", 2].entity_f1 > out["uncertainty", 0].entity_f1
