import numpy as np

from tagweave.llm import consensus
from tagweave.plans.runtime import Scratch

ITEMS = "item_id long, document_id string, token_document_indices array<int>, type string, n int"
VOTES = "vote_id long, document_id string, config_name string, run_no int, mention_type string, token_document_indices array<int>, started_at timestamp, received_at timestamp, token int"
T = ["activity", "actor", "xor gateway"]


def panel(n, seed):
    """Votes of a good, a fair, a lazy and a confused annotator (who swaps two types), over runs that repeat themselves."""
    rng = np.random.default_rng(seed)
    items, votes, truth = [], [], {}
    for i in range(n):
        truth[i] = T[rng.choice(3, p=[0.5, 0.3, 0.2])]
        items.append((i, f"d{i % 7}", [10 * i, 10 * i + 1], None, None))
        for name, runs in (("good", 1), ("fair", 2), ("lazy", 3), ("swap", 5), ("swap2", 4)):
            said = truth[i]
            if name == "good" and rng.random() < 0.08 or name == "fair" and rng.random() < 0.3:
                said = T[rng.integers(3)]
            if name == "lazy" and rng.random() < 0.7:
                said = "activity"
            if name.startswith("swap") and rng.random() < 0.85:
                said = {"activity": "actor", "actor": "activity"}.get(said, said)
            for run in range(runs):
                votes.append((len(votes), f"d{i % 7}", name, run + 1, said.upper().replace(" ", "_") if run % 2 else f" {said} ", [10 * i + run % 2, 10 * i + 3], None, None, None))
    return items, votes, truth


def test_truth_is_found_where_a_majority_errs(spark):
    items, votes, truth = panel(300, 1)
    votes += [votes[0], (10**6, "d0", "good", 1, None, [0], None, None, None), (10**6 + 1, "d0", "good", 1, "  ", [0], None, None, None), (10**6 + 2, "nowhere", "good", 1, "actor", [0], None, None, None), (10**6 + 3, None, None, None, "actor", None, None, None, None)]
    items += [(900, "d0", [99_999], None, None), (901, None, None, None, None)]
    model = consensus.Consensus(spark.createDataFrame(items, ITEMS), spark.createDataFrame(votes, VOTES), Scratch(spark, "t"))
    labels = {r.item_id: r for r in model.labels().collect()}
    assert len(labels) == len(items)
    right = sum(labels[i].mention_type == t for i, t in truth.items()) / len(truth)
    majority = 0
    for i, t in truth.items():
        own = [v[4].strip().lower().replace("_", " ") for v in votes[: len(votes) - 5] if v[5][0] // 10 == i]
        majority += max(T, key=own.count) == t
    assert right >= 0.9 and right > majority / len(truth) + 0.3
    assert labels[900].mention_type in T and labels[901].agreement is None
    assert all(r.agreement is None or -1 <= r.agreement <= 1 for r in labels.values())
    reliable = {r.config_name: r.kappa for r in model.reliability().collect()}
    assert reliable["good"] > reliable["fair"] > reliable["lazy"] > reliable["swap"]


def test_ties_go_to_the_smallest_item_and_late_copies_count_once(spark):
    items = spark.createDataFrame([(2, "d", [1, 2], None, None), (1, "d", [3, 4], None, None)], ITEMS)
    votes = spark.createDataFrame([(1, "d", "a", 1, "Actor", [2, 3], None, None, None), (2, "d", "a", 1, "Actor", [2, 3], None, None, None)], VOTES)
    assert [(r.item_id, r.annotator, r.type, r.weight) for r in consensus.votes_by_item(items, votes).collect()] == [(1, "a", "actor", 1.0)]


def test_no_votes_or_items(spark):
    items, votes, _ = panel(3, 2)
    items, votes = spark.createDataFrame(items, ITEMS), spark.createDataFrame(votes, VOTES)
    none = consensus.Consensus(items, votes.limit(0), Scratch(spark, "t"))
    assert [r.mention_type for r in none.labels().collect()] == [None] * 3 and none.reliability().count() == 0
    assert consensus.Consensus(items.limit(0), votes, Scratch(spark, "t")).labels().count() == 0


def test_parameters_in_a_table_give_the_same(spark, monkeypatch):
    items, votes, _ = panel(120, 3)
    monkeypatch.setattr(consensus, "ROUNDS", 4)
    items, votes = spark.createDataFrame(items, ITEMS), spark.createDataFrame(votes, VOTES)
    both = []
    for held in (consensus.HELD, 0):
        monkeypatch.setattr(consensus, "HELD", held)
        model = consensus.Consensus(items, votes, Scratch(spark, "t"))
        both.append(([(r.item_id, r.mention_type, round(r.confidence, 9)) for r in model.labels().orderBy("item_id").collect()],
                     [(r.config_name, r.n_items, round(r.kappa, 9), round(r.mean_ability, 9)) for r in model.reliability().orderBy("config_name").collect()]))
    assert model.table is not None and both[0] == both[1]


def test_more_types_and_annotators_than_are_held(spark, monkeypatch):
    monkeypatch.setattr(consensus, "HELD", 0)
    monkeypatch.setattr(consensus, "ROUNDS", 2)
    rng = np.random.default_rng(5)
    items = [(i, "d", [i], None, None) for i in range(220)]
    votes = [(len(items) * w + i, "d", f"a{(i * 7 + w * 131) % 60}", 1, f"type {i % 205}" if rng.random() < 0.9 else "type 0", [i], None, None, None) for i in range(220) for w in range(6)]
    model = consensus.Consensus(spark.createDataFrame(items, ITEMS), spark.createDataFrame(votes, VOTES), Scratch(spark, "t"))
    labels = {r.item_id: r.mention_type for r in model.labels().collect()}
    assert model.table is not None and sum(labels[i] == f"type {i % 205}" for i in labels) > 205
