from collections import Counter

import pytest
from hypothesis import given, settings, strategies as st

from tagweave.llm import pieces, terms

SCHEMA = "row_id long, tokens array<string>, ner_tags array<string>, term string, part long, bits string"


def brute(data, field):
    occurrences, rows = Counter(), Counter()
    for r in data:
        own = [t for t in map(terms.normal_term, r[field] or []) if t]
        occurrences.update(own)
        rows.update(set(own))
    return {t: (occurrences[t], rows[t]) for t in occurrences}


@pytest.mark.parametrize("offsets", [4096, 3])
def test_counts_match_brute_force(spark, monkeypatch, offsets):
    monkeypatch.setattr(terms, "MOST_OFFSETS", offsets)  # with 3, frequent terms travel as bitmaps
    data = [(i * 7919 if i % 3 else (1 << 30) + i, [f"w{i % 13}", "The", "the ", "\xa0the", None, "", " ", "café" if i % 2 else "café"] * (1 + i % 2), None if i % 5 == 0 else ["O", f"B-{i % 3}"]) for i in range(200)]
    data += [(-5, [], []), (10**15, ["x" * 50_000], ["O"]), (None, ["never"], ["O"])]
    df = spark.createDataFrame([(*r, None, None, None) for r in data], SCHEMA).repartition(7)
    out = terms.term_counts(df, "row_id", ["tokens", "ner_tags"]).collect()
    for k, field in enumerate(("tokens", "ner_tags"), 1):
        assert {r.term: (r.n_occurrences, r.n_rows) for r in out if r.field_name == field} == brute([x for x in ({field: d[k]} for d in data if d[0] is not None)], field)
    marks = {(r.field_name, r.term): r.mark for r in out}
    assert marks["tokens", "the"] == "common" and marks["tokens", "x" * 50_000] == "rare" and marks["ner_tags", "b-1"] is not None


def test_bounds_of_the_marks(spark):
    data = [(i, ["two"] if i < 2 else ["fifth"] if i < 4 else ["three"] if i < 7 else [], None, None, None, None) for i in range(10)]
    marks = {r.term: r.mark for r in terms.term_counts(spark.createDataFrame(data, SCHEMA), "row_id", ["tokens"]).collect()}
    assert marks == {"two": "rare", "fifth": "rare", "three": "common"}  # 3 of 10 rows are more than a fifth


def test_no_rows(spark):
    assert terms.term_counts(spark.createDataFrame([], SCHEMA), "row_id", ["tokens", "ner_tags"]).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", ".", ";", "!", ":"]), max_size=120), st.integers(3, 30), st.integers(0, 2))
def test_pieces_fit_and_rebuild_the_item(tokens, limit, overlap):
    levels = pieces.sentence_levels(tokens)
    cuts, kind = pieces.cut(len(tokens), levels, limit, overlap)
    back = []
    for no, (a, b) in enumerate(cuts):
        assert 0 < b - a <= limit
        assert no == 0 or a == max(0, cuts[no - 1][1] - overlap)
        back += tokens[a + (cuts[no - 1][1] - a if no else 0) : b]
    assert back == tokens
    ends = sorted({0, len(tokens), *(i + 1 for i, t in enumerate(tokens) if t in ".;:!?")})
    assert kind == ("forced" if any(b - a > limit for a, b in zip(ends, ends[1:])) else "natural")


def test_cuts_prefer_the_stronger_boundary():
    tokens = ["w"] * 5 + ["."] + ["w"] * 3 + [";"] + ["w"] * 8
    assert pieces.cut(len(tokens), pieces.sentence_levels(tokens), 12, 0)[0][0] == (0, 6)


def test_indices_with_nulls():
    assert pieces.index_levels([None, 0, 0, None, 1, None, 1, 2, 0]) == [[4, 7, 8]]


def test_items_of_tables(spark):
    long = ["w"] * 150 + [".", None, " ", "\xa0"] + ["v"] * 150
    rows = [(1, long, None), (2, ["w"] * 201, None), (3, ["w"] * 200 + [None, ""], None), (4, None, None), (5, [], None), (6, [None] * 300, None), (7, ["w"] * 100_000, None), (1, long, None)]
    df = spark.createDataFrame(rows, "row_id long, tokens array<string>, item_key string")
    out = pieces.oversized_pieces(df, "row_id", "tokens").collect()
    kinds = {r.item_key: r.cut_kind for r in out}
    assert kinds == {"1": "natural", "2": "forced", "7": "forced"}
    assert all(len(r.tokens) <= 200 for r in out)
    assert [(r.start_token, r.end_token) for r in out if r.item_key == "1"][:2] == [(0, 151), (131, 301)]
    docs = spark.createDataFrame([("d", ["w"] * 250, [0] * 120 + [None] * 10 + [1] * 120), ("e", ["w"] * 250, [None] * 250)], "id string, words array<string>, idx array<int>")
    assert {(r.item_key, r.cut_kind) for r in pieces.oversized_pieces(docs, "id", "words", sentence_index="idx").collect()} == {("d", "natural"), ("e", "forced")}
    assert pieces.oversized_pieces(df.limit(0), "row_id", "tokens").count() == 0


def test_no_piece_is_shorter_than_its_parts_force_it_to_be():
    assert pieces.cut(600, [[200, 201], []], 200, 20)[0] == [(0, 200), (180, 380), (360, 560), (540, 600)]
    assert pieces.cut(10, [[3], [5, 7]], 4, 0)[0] == [(0, 3), (3, 7), (7, 10)]
    assert pieces.cut(0, [[]], 5, 1)[0] == []


def test_texts_are_cut_at_sections_paragraphs_sentences_words_and_characters():
    text = "Scope of use\n\nOne two three. Four five six!\n\nOffice hours\n\nSeven; eight nine. " + "x" * 50 + " ten"
    out = pieces.cut_text(text, 30)
    assert "".join(out) == text and max(map(len, out)) <= 30
    assert out == ["Scope of use\n\nOne two three. ", "Four five six!\n\n", "Office hours\n\n", "Seven; eight nine. ", "x" * 30, "x" * 20 + " ten"]
    assert all(pieces.cut_text(text, k, min(3, k - 1)) for k in range(1, 40))
    assert pieces.cut_text("", 5) == [] and pieces.cut_text("一二三。四五六。", 4) == ["一二三。", "四五六。"]


def test_layout_tells_sections_from_paragraphs():
    words = ["A", "b", ".", "Head", "c", ".", "d", "."]
    text = "A b.\n\nHead\n\nc.\n\nd."
    assert pieces.layout_levels(words, [3, 4, 6], text) == [[3], [3, 4, 6], [3, 4, 6]]
    assert pieces.layout_levels(words, [3, 4, 6], None) == pieces.layout_levels(words, [3, 4, 6], "other") == [[], [], [3, 4, 6]]
