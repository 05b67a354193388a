import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
import pyarrow as pa
from pyspark.sql import functions as F

from tagweave.functions import spans, spans as S
from tagweave.operators import evaluation as E
from tagweave.plans.runtime import Scratch

TAGS = ["O", "B-A", "I-A", "B-B", "I-B"]


def by_hand(tags):
    out, open_ = [], None
    for i, t in enumerate(tags):
        kind = None if t == "O" else t[2:]
        if open_ and (kind != open_[0] or t.startswith("B-")):
            out.append((open_[0], open_[1], i - 1))
            open_ = None
        if kind and not open_:
            open_ = (kind, i)
    return out + ([(open_[0], open_[1], len(tags) - 1)] if open_ else [])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.lists(st.sampled_from(TAGS), max_size=9)), max_size=12))
def test_chunks_match_a_walk_by_hand(batch):
    found = spans.chunk_batch(pa.array(batch, pa.list_(pa.string()))).to_pylist()
    assert [[(c["type"], c["first"], c["last"]) for c in row] for row in found] == [by_hand(t or []) for t in batch]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from(TAGS), max_size=9), st.lists(st.sampled_from(TAGS), max_size=9)), max_size=8))
def test_greedy_matches_match_a_walk_by_hand(pairs):
    def walk(predicted, gold):
        left, out = list(gold), []
        for t, a, b in predicted:
            hit = next((g for g in left if g[0] == t and g[1] <= b and g[2] >= a), None)
            if hit:
                left.remove(hit)
                out.append(t)
        return out

    kind = pa.list_(pa.struct([("type", pa.string()), ("first", pa.int32()), ("last", pa.int32())]))
    arrays = [pa.array([[dict(zip(("type", "first", "last"), c)) for c in by_hand(p[k])] for p in pairs] + [None], kind) for k in (0, 1)]
    assert spans.greedy_batch(*arrays).to_pylist() == [walk(by_hand(p), by_hand(g)) for p, g in pairs] + [[]]


def test_chunks_of_a_slice_and_of_damaged_tags():
    whole = pa.array([["B-X"], ["I-A", None, "I-A", "", "B_A", "O"], ["B-A", "I-B"]], pa.list_(pa.string()))
    assert spans.chunk_batch(whole.slice(1, 1)).to_pylist() == [[{"type": "A", "first": 0, "last": 0}, {"type": "A", "first": 2, "last": 2}]]


def tagged(spark, pairs, **more):
    return spark.createDataFrame([(i, g, p, 1) for i, (g, p) in enumerate(pairs)], "id int, gold array<string>, pred array<string>, run int")


def test_partial_scores_take_each_gold_entity_once(spark):
    df = tagged(spark, [(["B-A", "I-A", "O", "O"], ["B-A", "B-A", "B-A", "B-B"])])
    out = E.evaluation(df, ["run"]).first()
    assert out.entity_partial_precision == 1 / 4 and out.entity_partial_recall == 1 and out.entity_f1 == 0
    assert out.token_accuracy == 1 / 4


def test_perfect_and_empty(spark):
    assert E.evaluation(tagged(spark, [(["B-A", "I-A"], ["B-A", "I-A"]), ([], [])]), ["run"]).first().entity_macro_f1 == 1
    none = E.evaluation(tagged(spark, [(["O"], ["O"])]), ["run"]).first()
    assert none.entity_f1 == none.entity_partial_f1 == 0 and none.token_accuracy == 1
    assert E.evaluation(tagged(spark, []), ["run"]).count() == 0


def test_macro_averages_over_the_types_of_both_sides(spark):
    out = E.evaluation(tagged(spark, [(["B-A", "O"], ["B-A", "B-B"])]), ["run"]).first()
    assert out.entity_precision == 0.5 and out.entity_macro_f1 == 0.5


def test_unequal_lengths_are_an_error(spark):
    with pytest.raises(Exception, match="differ in length"):
        E.evaluation(tagged(spark, [(["O"], ["O", "O"])]), ["run"]).collect()


def test_mentions_with_gaps(spark):
    m = "array<struct<type:string,tokens:array<int>>>"
    df = spark.createDataFrame([("d", [("a", [1, 2, 5]), ("a", [7])], [("a", [5]), ("a", [1]), ("b", [7]), ("a", None)])], f"id string, gold {m}, predicted {m}")
    count = lambda exact: {r.type: (r.n_predicted, r.n_gold, r.n_ok) for r in E.mention_counts(df, ["id"], predicted="predicted", exact=exact).collect()}
    assert count(False) == {"a": (3, 2, 1), "b": (1, 0, 0)}
    assert count(True) == {"a": (3, 2, 0), "b": (1, 0, 0)}


def test_nothing_to_find_is_right_in_mention_scores(spark):
    rows = spark.createDataFrame([("r", "d1", "a", 0, 0, 0), ("r", "d2", "a", 1, 2, 1)], "run string, id string, type string, n_predicted long, n_gold long, n_ok long")
    out = E.mention_summary(rows, ["run"], "id").first()
    assert out.macro_precision == 1 and out.macro_recall == 0.75 and out.micro_recall == 0.5 and out.macro_recall_sd == 0.25


def test_tags_of_spans(spark):
    df = spark.createDataFrame([([("A", 0, 1), ("B", 1, 2), ("C", 3, 3)], 5), ([], 0), (None, 2)], f"s {spans.SPAN}, n int")
    assert [r[0] for r in df.select(spans.tags_of(F.col("s"), F.col("n"))).collect()] == [["B-A", "I-A", "O", "B-C", "O"], [], ["O", "O"]]


def test_lookup_takes_the_type_seen_first_of_equal_ones(spark):
    schema = "s int, wid int, word string, gold string, ord int"
    train = spark.createDataFrame([(0, 0, "Bank", "B-X", 0), (0, 1, "bank", "B-Y", 1), (0, 2, "of", "O", 2)], schema)
    test = spark.createDataFrame([(1, 0, "BANK", None, 0), (1, 1, "bank", None, 0), (1, 2, "new", None, 0)], schema)
    assert [r.tag for r in E.lookup_tags(train, test, ["s"], Scratch(spark, "t")).orderBy("wid").collect()] == ["B-X", "I-X", "O"]


def test_spans_apart_are_those_of_a_walk_in_order():
    rng = np.random.default_rng(3)
    for _ in range(300):
        n = int(rng.integers(1, 30))
        first = rng.integers(0, n, int(rng.integers(0, 12)))
        last = np.minimum(first + rng.integers(0, 6, len(first)), n - 1)
        taken, walked = set(), []
        for a, b in zip(first.tolist(), last.tolist()):
            words = set(range(a, b + 1))
            walked.append(not words & taken)
            taken |= words if walked[-1] else set()
        assert S.apart(first, last, n).tolist() == walked
