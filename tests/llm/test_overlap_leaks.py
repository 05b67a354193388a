import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from tagweave.llm import leaks, overlap
from tagweave.llm.words import words
from tagweave.plans.runtime import Scratch

SCHEMA = "row_id long, tokens array<string>, split string, key string, n string, text string, training string"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=14), st.lists(st.sampled_from("abcd"), max_size=14), st.integers(0, 8))
def test_edits_match_the_full_table(a, b, most):
    d = distance(a, b)
    assert overlap.edits_within(a, b, most) == (d if d <= most else None)


def test_spans_cover_their_text_and_outnumber_the_edits():
    rng = np.random.default_rng(3)
    sizes = [1, 2, 6, 7, 13, 14, 40, 900, 31, 8]
    starts = np.concatenate(([0], np.cumsum(sizes)))
    info = rng.random(starts[-1]) * (rng.random(starts[-1]) < 0.4) * 9
    owner, a, b = overlap.telling_spans(info, starts)
    for t, n in enumerate(sizes):
        own = [(x, y) for o, x, y in zip(owner, a, b) if o == t]
        assert len(own) == n // 7 + 1
        assert all(starts[t] <= x < y <= starts[t + 1] for x, y in own) and all(p[1] <= q[0] for p, q in zip(own, own[1:]))


def edited(w, k, rng):
    w = list(w)
    for _ in range(k):
        at = rng.randrange(len(w))
        how = rng.randrange(3)
        if how == 0:
            w[at] = "z%d" % rng.randrange(10**6)
        elif how == 1:
            w.insert(at, "y%d" % rng.randrange(10**6))
        elif len(w) > 1:
            del w[at]
    return w


def test_pairs_match_brute_force(spark):
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(60)]
    data, base = [], []
    for i in range(140):
        w = [rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 7, 8, 9, 16, 30, 60]))] if not base or rng.random() < 0.4 else edited(rng.choice(base), rng.randrange(5), rng)
        base.append(w)
        shape = rng.randrange(4)
        tokens = [x.upper() if shape == 1 else x for x in w] + (["."] if shape == 2 else []) + ([None, " "] if shape == 3 else [])
        if shape == 2 and len(w) > 2:
            tokens = [w[0] + " " + w[1], *tokens[2:]]
        data.append((i, tokens, rng.choice(["Pool", "bootstrap ", "test", "VALIDATION", None]), None, None, None, None))
    data += [(900, None, "test", *[None] * 4), (901, [], "pool", *[None] * 4), (902, ["."], "test", *[None] * 4), (903, ["w1"] * 20_000, "test", *[None] * 4), (904, ["w1"] * 20_000, "pool", *[None] * 4)]
    side = {"pool": True, "bootstrap": True, "test": False, "validation": False}
    clean = [(r[0], words(" ".join(t for t in r[1] or [] if t)), side.get((r[2] or "").strip().lower())) for r in data]
    expected = {(a[0], b[0]) for a in clean for b in clean if a[2] is True and b[2] is False and a[1] and b[1] and
                (a[1] == b[1] or len(a[1]) < 100 and distance(a[1], b[1]) <= max(len(a[1]), len(b[1])) // 8)}
    out = overlap.cross_split_pairs(spark.createDataFrame(data, SCHEMA), Scratch(spark, "t")).collect()
    assert {(r.train_id, r.eval_id) for r in out} == expected and len(out) == len(expected)
    assert all(0 < r.coverage <= 1 for r in out)


def test_several_shards_give_the_same(spark, monkeypatch):
    rng = random.Random(2)
    data = [(i, [f"w{rng.randrange(40)}" for _ in range(20)], "test" if i % 2 else "pool", *[None] * 4) for i in range(60)]
    data += [(1000 + r[0], edited(r[1], 2, rng), "pool" if r[2] == "test" else "test", *r[3:]) for r in data]
    df = spark.createDataFrame(data, SCHEMA)
    once = {(r.train_id, r.eval_id) for r in overlap.cross_split_pairs(df, Scratch(spark, "t")).collect()}
    monkeypatch.setattr(overlap, "SHARD_PATTERNS", 20)
    assert {(r.train_id, r.eval_id) for r in overlap.cross_split_pairs(df, Scratch(spark, "t")).collect()} == once and len(once) >= 60
    monkeypatch.setattr(overlap, "MOST_BRANCHES", 2)  # several jobs, small slices of places, and hot classes
    monkeypatch.setattr(overlap, "MOST_PLACES", 3)
    monkeypatch.setattr(overlap, "HOT_ROWS", 1)
    monkeypatch.setattr(overlap, "MOST_HOT", 10**6)
    copies = df.unionByName(df.withColumn("row_id", df.row_id + 10_000))
    again = [(r.train_id, r.eval_id) for r in overlap.cross_split_pairs(copies, Scratch(spark, "t")).collect()]
    assert len(again) == len(set(again)) == 4 * len(once) and {(a % 10_000, b % 10_000) for a, b in again} == once


def test_texts_are_sent_only_to_shards_that_may_hold_a_partner(spark, monkeypatch):
    rng = random.Random(5)
    phrase = [f"p{i}" for i in range(9)]  # a run of words that every text has, so that many share its pattern
    data = [(i, phrase + [f"w{rng.randrange(10**6)}" for _ in range(20)], "test" if i % 2 else "pool", *[None] * 4) for i in range(200)]
    data += [(1000 + r[0], edited(r[1], 2, rng), "pool", *r[3:]) for r in data if r[0] % 20 == 1]
    monkeypatch.setattr(overlap, "SHARD_PATTERNS", 20)
    scratch, sent = Scratch(spark, "t"), []
    keep = scratch.keep

    def kept(df):
        out = keep(df)
        if {"shard", "text"} <= set(out.columns):
            sent.append(out)
        return out

    monkeypatch.setattr(scratch, "keep", kept)
    found = {(r.train_id, r.eval_id) for r in overlap.cross_split_pairs(spark.createDataFrame(data, SCHEMA), scratch).collect()}
    assert found == {(1000 + i, i) for i in range(1, 200, 20)}
    assert len(sent) == 1 and 10 <= sent[0].count() < 20  # of 110 training texts and about 25 shards


def test_no_side(spark):
    df = spark.createDataFrame([(1, ["a"], "pool", *[None] * 4)], SCHEMA)
    assert overlap.cross_split_pairs(df, Scratch(spark, "t")).count() == 0
    assert overlap.cross_split_pairs(df.limit(0), Scratch(spark, "t")).count() == 0


PASSAGE = ("the quiet harbour master signs every third ledger before dawn while two clerks carry sealed crates of dried apricots along the eastern quay and a "
           "visiting surveyor measures the old granary walls with a brass chain so that repairs may begin once the winter storms have passed over the bay again")


def found(spark, texts, passages):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    both = []
    for held in (leaks.HELD_WORDS, 0):  # with the passages in the tasks, and with tables
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(leaks, "HELD_WORDS", held)
            both.append(leaks.leaked_passages(docs, spark.createDataFrame(list(enumerate(passages)), "passage_id long, text string"), Scratch(spark, "t")).collect())
    rows, tables = both
    assert sorted(map(tuple, rows)) == sorted(map(tuple, tables))
    assert len(rows) == len({(r.passage_id, r.doc_id) for r in rows})
    return {(r.doc_id, r.passage_id) for r in rows}


def test_whole_partial_and_edited_passages_are_found(spark):
    w = PASSAGE.split()
    rng = random.Random(4)
    edits = list(w)
    for at in range(4, len(edits), 11):
        edits[at] = "changed"
    texts = [
        "Something else. " + PASSAGE.upper() + "! And more.", " ".join(w[10:36]), " ".join(w[:20]), " ".join(edits), "unrelated words only " * 40,
        " ".join(rng.sample(w, len(w))), "", " ".join(w[:24]) + "\n\nScope and purpose\n\n" + " ".join(w[24:]), ",\n".join(w), " ".join(w[:26]) + ". 3) " + " ".join(w[26:])]
    other = "another passage entirely made of different tokens that never occur here or anywhere else in these documents at all"
    assert found(spark, texts, [PASSAGE, other]) == {(0, 0), (1, 0), (3, 0), (7, 0), (8, 0), (9, 0)}
    # a passage of two words, each of them half of it, changes nothing for the others
    three = found(spark, texts, [PASSAGE, other, "granary zebra"])
    assert {t for t, o in three if o == 2} == {t for t, text in enumerate(texts) if "granary" in text.lower()}
    assert {x for x in three if x[1] != 2} == {(0, 0), (1, 0), (3, 0), (7, 0), (8, 0), (9, 0)}


def test_numbers_of_long_lists_are_no_words():
    said = lambda t: leaks.sequences([t], 1).hash.tolist()
    plain = said("\n".join("the desk opens" for _ in range(120)))
    assert said("\n".join(f"{k}. the desk opens" for k in range(1, 121))) == said("\n".join(f"{k}) the desk opens" for k in range(1, 121))) == plain
    assert said("first 1a2. word") != said("first word") and said("the year 1987. word") != said("the year word")


def test_every_shared_run_of_the_bound_has_a_common_fingerprint():
    rng = random.Random(9)
    for _ in range(30):
        shared = " ".join(f"s{rng.randrange(1000)}" for _ in range(6))
        a, b = leaks.sequences(["x1 x2 x3 " + shared + " x4"], 1), leaks.sequences(["y1 " + shared + " y2 y3 y4 y5"], 0)
        prints = [set(leaks.fingerprints(s, 6, leaks.windows(s, 6, sep))[1].tolist()) for s, sep in ((a, 1), (b, 0))]
        assert prints[0] & prints[1]


def test_chinese_counts_characters(spark):
    passage = "根据第三条规定质谱图先批准再处理科学假设并抄送档案处备案" * 2
    docs = spark.createDataFrame([(1, "前文。" + passage[:30] + "。后文", None), (2, passage[:12], None), (3, None, None)], "doc_id long, text string, words string")
    found = leaks.leaked_passages(docs, spark.createDataFrame([(5, passage), (6, None), (None, "")], "passage_id long, text string"), Scratch(spark, "t"))
    assert [(r.passage_id, r.doc_id) for r in found.collect()] == [(5, 1)]


def test_no_passages_or_documents(spark):
    docs = spark.createDataFrame([(1, PASSAGE)], "doc_id long, text string")
    passages = spark.createDataFrame([(1, PASSAGE)], "passage_id long, text string")
    assert leaks.leaked_passages(docs, passages.limit(0), Scratch(spark, "t")).count() == 0
    assert leaks.leaked_passages(docs.limit(0), passages, Scratch(spark, "t")).count() == 0
    assert leaks.leaked_passages(docs, passages.unionByName(passages), Scratch(spark, "t")).count() == 2


def test_many_passages_and_copies_give_each_pair_once(spark):
    rng = random.Random(1)
    passages = [" ".join(f"w{rng.randrange(300)}" for _ in range(rng.randrange(2, 60))) for _ in range(300)]
    texts = [" ".join(f"v{rng.randrange(50)}" for _ in range(30)) + " " + (passages[i % 300] if i % 2 else "") for i in range(400)]
    got = found(spark, texts, passages)
    assert {(i, i % 300) for i in range(1, 400, 2)} <= got
    same = found(spark, [passages[0]] * 50, [passages[0]] * 40)
    assert len(same) == 2000
