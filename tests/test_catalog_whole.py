"""Queries that take the whole of their tables, on small tables of their own."""

import math

from pyspark.sql import functions

import __spark_entry__ as entry


def rows(spark, tmp_path, query, **tables):
    for name, (data, schema) in tables.items():
        spark.createDataFrame(data, schema).write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
    return entry.queries()[query](spark, str(tmp_path)).collect()


def test_spans_of_long_sentences(spark, tmp_path):
    data = [(1, ["ab", None, "ü"]), (2, [f"w{i}" for i in range(898)]), (3, None), (4, [])]
    expected = {}
    for row_id, tokens in data:
        at, ends, starts = 0, [], []
        for t in tokens or []:
            starts.append(at)
            at += len(t or "") + 1
            ends.append(at - 1)
        if ends:
            expected[row_id] = (len(tokens), ends[-1], sum(starts))
    out = rows(spark, tmp_path, "t19_token_spans", sentences=(data, "row_id long, tokens array<string>"))
    assert {r.row_id: (r.n_tokens, r.last_end, r.starts) for r in out} == expected and set(expected) == {1, 2}


def test_byte_offset_of_the_end_of_long_texts(spark, tmp_path):
    texts = ["Größe 第三条 😀 " * 200, "x" * 39 + "é" * 30, "short", "", None]
    out = rows(spark, tmp_path, "t4_byte_offsets", documents=(list(enumerate(texts)), "doc_id long, text string"))
    assert {r.doc_id: r.chars for r in out} == {i: None if t is None else len(t.encode().decode()) for i, t in enumerate(texts)}


def test_rows_covered_by_any_row(spark, tmp_path):
    data = [(i, f"d{i // 4}" if i % 7 else None, i % 4, "test" if i % 2 else "pool") for i in range(1, 60)]
    ids = {name if row_id % 3 == 0 else f"{name}#{sentence}" for row_id, name, sentence, _ in data if name}
    sources = ["sentence" if f"{name}#{sentence}" in ids else "document" if name in ids else None for _, name, sentence, part in data if part == "test" and name]
    out = rows(spark, tmp_path, "j20_covered_rows", sentences=(data, "row_id long, document_name string, sentence_id int, split string"))
    assert {r.source: r.n for r in out} == {s: sources.count(s) for s in set(sources) - {None}} and {"sentence", "document"} <= set(sources)


def test_answer_lines_of_documents_with_many_sentences(spark, tmp_path):
    data = [("a", [(f"w{i}", "NN", i) for i in range(12)] + [("x", "NN", None), (" ", "", 3), ("y", "NN", -1)]), ("b", [("w", "NN", 0), (None, "NN", 1)]), ("c", [("w", "NN", None)]), ("d", None)]
    out = rows(spark, tmp_path, "t18_answer_lines", annotated_docs=(data, "id string, tokens array<struct<text:string,pos_tag:string,sentence_index:int>>"))
    assert {r.issue: r.n for r in out} == {None: 13, "dropped_malformed": 3, "ignored_line": 1}


def test_loop_acquires_the_whole_pool(spark, tmp_path):
    data = [(i, f"d{i}", 0, part, [f"w{i % 5}", "x", f"y{i % 3}"], ["B-Actor", "O", "O"]) for i, part in enumerate(["bootstrap"] * 3 + ["pool"] * 9 + ["test"] * 3)]
    out = rows(spark, tmp_path, "a8_acquisition_loop", sentences=(data, "row_id long, document_name string, sentence_id int, split string, tokens array<string>, ner_tags array<string>"))
    for arm in ("random", "uncertainty"):
        assert [r.n_acquired for r in sorted((r for r in out if r.arm == arm), key=lambda r: r.round)] == [*range(0, 27, 3), 27]
        assert max(r.percent_acquired for r in out if r.arm == arm) == 100.0


def test_size_matched_profile(spark, tmp_path):
    one, two = (["Ann", "stamps", "form", "now"], ["B-Actor", "O", "B-Activity Data", "O"]), (["The", "form", "waits"], ["O", "O", "O"])
    data = [(1, "d", 0, "bootstrap", *one), (2, "d", 1, "bootstrap", *two), (3, "e", 0, "test", ["Ann", "reads", "form"], ["B-Actor", "O", "B-Activity Data"]), (4, "e", 1, "test", ["Bob"], ["B-Actor"])]
    data += [(10 + i, "f", i, "pool", *(two if i % 2 else one)) for i in range(12)]
    out = rows(spark, tmp_path, "g35_size_matched", sentences=(data, "row_id long, document_name string, sentence_id int, split string, tokens array<string>, ner_tags array<string>"))
    assert len(out) == 18 and {(r.part, r.draws) for r in out} == {("bootstrap", 1), ("pool", 200)}
    whole = {r.measure: r.mean for r in out if r.part == "bootstrap"}
    expected = {"entity_share": 2 / 7, "type_entropy": math.log(2) / math.log(7), "rare_share": 1, "multi_word": 0, "mean_words": 1, "capitalised": 0, "unseen_rate": 1 / 3, "ambiguous_share": 2 / 7, "lookup_f1": 0.8}
    assert {m: round(v, 9) for m, v in whole.items()} == {m: round(v, 9) for m, v in expected.items()}
    assert all(r.low == r.mean == r.high for r in out if r.part == "bootstrap") and all(r.low <= r.mean + 1e-9 and r.mean <= r.high + 1e-9 for r in out)


def test_rescored_runs_whatever_order_sentences_come_in(spark, tmp_path, monkeypatch):
    tags = [["B-Actor", "O", "B-Activity Data", "I-Activity Data"][: 1 + i % 4] for i in range(400)]
    data = [(i * 97, "d", i, "pool" if i % 3 else None, ["w"] * len(t), t) for i, t in enumerate(tags)]
    schema = "row_id long, document_name string, sentence_id int, split string, tokens array<string>, ner_tags array<string>"
    expected = {r.part or "none": tuple(r)[1:] for r in rows(spark, tmp_path, "e5_evaluation_row", sentences=(data, schema))}
    listed = functions.collect_list
    monkeypatch.setattr(functions, "collect_list", lambda c: functions.shuffle(listed(c)))
    out = rows(spark, tmp_path, "e6_rescored_runs", sentences=(data, schema))
    assert {r.part: tuple(r)[1:] for r in out} == expected and len(expected) == 2



def moved(node):
    """Rows that the shuffles of a plan wrote."""
    kind, children = node.nodeName(), node.children()
    own = node.metrics().apply("shuffleRecordsWritten").value() if kind == "Exchange" else 0
    inner = [node.executedPlan()] if kind == "AdaptiveSparkPlan" else [node.plan()] if kind.endswith("QueryStage") else [children.apply(i) for i in range(children.size())]
    return own + sum(map(moved, inner))


def long_sentences(spark, tmp_path, query):
    data = [(i, "d", i, "pool" if i % 3 else None, ["w"] * (i * 4), ["O" if j % 9 == 8 else "B-Actor" for j in range(i * 4)]) for i in range(60)]
    spark.createDataFrame(data, "row_id long, document_name string, sentence_id int, split string, tokens array<string>, ner_tags array<string>").write.parquet(f"{tmp_path}/sentences.parquet")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as with tables that are too large
    try:
        df = entry.queries()[query](spark, str(tmp_path))
        out = df.collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    return data, {r[0]: tuple(r)[1:] for r in out}, moved(df._jdf.queryExecution().executedPlan())


def test_suggestions_are_counted_without_moving_every_word(spark, tmp_path):
    data, out, n = long_sentences(spark, tmp_path, "g55_suggestion_counts")
    places = [(part, (i * 13 + j * 5) % 10, t != "O") for i, _, _, part, _, tags in data for j, t in enumerate(tags)]
    assert out == {p: (len(own := [(r, e) for q, r, e in places if q == p]), sum(e and r <= 3 for r, e in own), sum(e and r == 4 for r, e in own), sum(e and r == 4 for r, e in own)) for p in ("pool", None)}
    assert 0 < n < len(places) / 10


def test_labels_are_revealed_without_moving_every_word(spark, tmp_path):
    data, out, n = long_sentences(spark, tmp_path, "j23_reveal")
    chosen = [len(tags) for i, _, _, _, _, tags in data for j, t in enumerate(tags) if t != "O" and (i * 13 + j * 5) % 10 == 0]
    assert out == {"Actor": (len(chosen), sum(chosen))}
    assert 0 < n < sum(len(tags) for *_, tags in data) / 4
