import random

import pytest
from pyspark.sql import functions as F

from tagweave.llm import entities
from tagweave.llm.components import connected_components, proportional_splits
from tagweave.plans.runtime import Scratch

SENTENCES = "row_id long, document_name string, node string, u int"
REGISTRY = "document_name string, dataset string, author string, source_file string, component string"


def test_spellings_of_a_name_agree():
    same = ["97-6_lens_grinding", " 97-6_lens_grinding ", "97-6 lens grinding", "97-6-Lens-Grinding (Rev 3)", "97-6__lens_grinding_v2.txt", "input/texts/97-6_LENS_GRINDING_REV5.jsonl",
            "./97-6.lens.grinding-Rev.9", "97-6 - lens - grinding", "97-6_lens_grinding\xa0", "97-6_lens_grinding (rev 7).txt"]
    assert {entities.document_key(x) for x in same} == {"97_6_lens_grinding"}
    assert entities.document_key("révision") == entities.document_key("révision")
    assert len({entities.document_key(x) for x in ("104729822", "104729829", "104729850_rev3", "9-1_a", "91_a")}) == 5


@pytest.mark.parametrize("value", [None, "", "  ", "-", "N/A", "n/a", "none", "(not given)", "UNKNOWN", "\xa0"])
def test_missing_values_are_null(value):
    assert entities.document_key(value) is None and entities.entity_key(value) is None


def test_entity_spelling():
    assert entities.entity_key(" box88\\Scan-1.pdf ") == entities.entity_key("BOX88/scan-1.pdf") == "box88/scan-1.pdf"


def test_components_match_union_find(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(320)] + [(7, 7), (900, 900), (None, 3), (5, None)] + [(1000, 2000 + i) for i in range(300)]
    edges += [(3000 + i, 3001 + i) for i in range(150)]  # a long chain
    edges += edges[:40]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            ra, rb = find(a), find(b)
            parent[max(ra, rb)] = min(ra, rb)
    found = connected_components(spark.createDataFrame(edges, "u long, v long"), Scratch(spark, "t"))
    assert {(r.node, r.component) for r in found.collect()} == {(x, find(x)) for x in parent}
    assert found.count() == len(parent)


def test_components_with_hot_nodes(spark, monkeypatch):
    from tagweave.llm import components

    monkeypatch.setattr(components, "HOT_EDGES", 20)
    monkeypatch.setattr(components, "MOST_HOT", 50)
    edges = [(1, i) for i in range(2, 300)] + [(500, 501)]
    found = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long"), Scratch(spark, "t")).collect()}
    assert found == {**{i: 1 for i in range(1, 300)}, 500: 500, 501: 500}


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "u long, v long"), Scratch(spark, "t")).count() == 0


def _tables(spark):
    sentences = spark.createDataFrame([
        (1, "a_x", None, 1), (2, "A-X.txt", None, 1), (3, "b_x", None, 1), (4, None, None, 1), (5, "c", None, 1), (6, "c", None, 1), (7, "d (rev 2)", None, 1), (8, " - ", None, 1), (9, "e", None, 1)], SENTENCES)
    registry = spark.createDataFrame([
        ("a_x", None, "Ann ", None, "x"), ("b_x_rev3", None, "unknown", "S/1", None), ("ghost", None, "ann", "s\\1 ", None), ("c", None, None, "-", None), ("d", None, "n/a", "", None),
        ("ghost", None, "ann", "s\\1 ", None), (None, None, "ann", "s/1", None)], REGISTRY)
    return sentences, registry


def test_related_rows_are_transitive_and_missing_values_connect_nothing(spark):
    found = {r.row_id: (r.group_id, r.n_names) for r in entities.related_rows(*_tables(spark), Scratch(spark, "t")).collect()}
    assert found == {1: (1, 3), 2: (1, 3), 3: (1, 3), 5: (5, 1), 6: (5, 1), 7: (7, 1), 9: (9, 1)}


def test_splits_keep_groups_whole_and_cover_all_rows(spark):
    sentences, registry = _tables(spark)
    out = entities.related_splits(sentences, registry, Scratch(spark, "t"), {"train": 0.8, "validation": 0.1, "test": 0.1}).collect()
    assert sorted(r.row_id for r in out) == list(range(1, 10))
    assert len({r.split for r in out if r.row_id in (1, 2, 3)}) == 1 and len({r.split for r in out if r.row_id in (5, 6)}) == 1


def test_split_proportions(spark):
    groups = spark.createDataFrame([(i, 1 + i % 7) for i in range(4000)], "group_id long, n_rows long")
    out = proportional_splits(groups, {"train": 8, "validation": 1, "test": 1}).groupBy("split").sum("n_rows").collect()
    total = sum(r[1] for r in out)
    assert {r[0]: round(r[1] / total, 2) for r in out} == {"train": 0.8, "validation": 0.1, "test": 0.1}


def test_hot_names_give_the_same(spark, monkeypatch):
    plain = sorted(map(tuple, entities.related_rows(*_tables(spark), Scratch(spark, "t")).collect()))
    monkeypatch.setattr(entities, "HOT_ROWS", 1)
    assert sorted(map(tuple, entities.related_rows(*_tables(spark), Scratch(spark, "t")).collect())) == plain


def test_empty_tables(spark):
    s, r = spark.createDataFrame([], SENTENCES), spark.createDataFrame([], REGISTRY)
    assert entities.related_rows(s, r, Scratch(spark, "t")).count() == 0
    assert entities.related_splits(s, r, Scratch(spark, "t"), {"train": 1.0}).count() == 0


def test_names_of_one_hash_are_hashed_anew(spark, monkeypatch):
    names = spark.createDataFrame([("author", "a"), ("author", "b"), ("document", "a")], "kind string, name string")
    whole = entities._node
    monkeypatch.setattr(entities, "_node", lambda seed, kind, name: F.lit(1) if seed < 2 else whole(seed, kind, name))
    assert entities._seed(names) == 2
    monkeypatch.setattr(entities, "_node", lambda seed, kind, name: F.lit(1))
    with pytest.raises(RuntimeError):
        entities._seed(names)


def test_worded_missing_names_stay_alone(spark):
    rows = spark.createDataFrame([(1, "a.txt"), (2, "unknown"), (3, "unknown"), (4, None), (5, "A")], "row_id long, document_name string")
    registry = spark.createDataFrame([("unknown", "x", None), ("a", "x", None)], "document_name string, author string, source_file string")
    found = {r.row_id: r.group_id for r in entities.related_rows(rows, registry, Scratch(spark, "t")).collect()}
    assert found == {1: 1, 5: 1}
    split = {r.row_id: r.group_id for r in entities.related_splits(rows, registry, Scratch(spark, "t"), {"train": 0.5, "test": 0.5}).collect()}
    assert split == {1: 1, 2: 2, 3: 3, 4: 4, 5: 1}
