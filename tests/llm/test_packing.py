import random
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings, strategies as st

from tagweave.llm import packing
from tagweave.plans.runtime import Scratch


def fullest_by_search(counts, capacity):
    items = sorted(counts.elements(), reverse=True)
    best = {items[0]}
    sums = {0}
    for x in items[1:]:
        sums |= {s + x for s in sums if s + x <= capacity - items[0]}
    return max(sums) + max(best)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 30), min_size=1, max_size=12))
def test_the_fullest_combination_is_found(items):
    counts = Counter(items)
    chosen = packing.fullest(dict(counts), 30)
    assert all(n <= counts[x] for x, n in chosen.items()) and max(counts) in chosen
    assert sum(x * n for x, n in chosen.items()) == fullest_by_search(counts, 30)


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(0, 60)))
def test_a_plan_uses_every_item_once(counts):
    used = Counter()
    for chosen, times in packing.plan(counts, 40):
        assert sum(x * n for x, n in chosen.items()) <= 40 and times > 0
        used.update({x: n * times for x, n in chosen.items()})
    assert used == Counter({x: n for x, n in counts.items() if n})


def test_lengths_beyond_the_capacity_are_an_error():
    with pytest.raises(ValueError):
        packing.plan({41: 1}, 40)


def test_containers_of_texts(spark):
    rng = random.Random(1)
    data = [(i, " ".join("word" for _ in range(rng.randrange(1, 60))), 0) for i in range(300)] + [(500, "long " * 3000, 0), (501, "", 0), (502, None, 0), (None, "no id", 0), (7, "again", 0), (7, "again", 0)]
    df = spark.createDataFrame(data, "doc_id long, text string, rank int").repartition(5)
    out = packing.containers(df, Scratch(spark, "t"), capacity=64).collect()
    fill, by_doc = Counter(), defaultdict(list)
    for r in out:
        fill[r.container_id] += r.n_tokens
        by_doc[r.doc_id].append(r)
    assert max(fill.values()) <= 64 and sorted(fill) == list(range(len(fill)))
    encode = packing.tokenizer(None).encode_ordinary
    assert sum(fill.values()) == sum(len(encode(t)) for _, t, _ in data if t)
    assert len(fill) <= 1.03 * sum(fill.values()) / 64 + 1
    assert {d for d in by_doc} == {d for d, t, _ in data if t}
    pieces = sorted(by_doc[500], key=lambda r: r.piece_no)
    assert [r.first_token for r in pieces] == [64 * i for i in range(len(pieces))] and all(r.n_tokens == 64 for r in pieces[:-1])
    assert all(len(v) == 1 for d, v in by_doc.items() if d not in (500, 7)) and len(by_doc[7]) == 3
    assert packing.containers(df.limit(0), Scratch(spark, "t")).count() == 0
