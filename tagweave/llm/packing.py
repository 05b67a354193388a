"""Filling containers of fixed capacity with texts (problem 7).

Minimum bin slack: for one container after another, a bitset subset-sum over the lengths still there finds
the fullest combination with the longest of them, which is then taken out. Texts of one length can stand
for each other, so the plan needs only the number of texts of each length: a few hundred numbers at any
size of the collection, exact for all of it. A combination is used as often as its lengths last. The texts,
numbered within their length, then read their container off the plan.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from tagweave.plans.runtime import Scratch

CAPACITY = 512
TOKENIZER = "byte_bpe_multi_50k.tiktoken"


def fullest(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """How many of each length make up the fullest container, the longest length there being one of them.

    Of equally full ones, that with the longest lengths. ``counts`` may not be empty.
    """
    longest = max(counts)
    room = capacity - longest
    lengths = sorted(x for x, n in counts.items() if x <= room)
    mask, bits, reached = (1 << (room + 1)) - 1, 1, [1]
    for x in lengths:
        left, step = min(counts[x] - (x == longest), room // x), 1
        while left > 0:  # so many of a length, by powers of two
            take = min(step, left)
            bits |= (bits << (x * take)) & mask
            left, step = left - take, step * 2
        reached.append(bits)
    rest, chosen = bits.bit_length() - 1, {longest: 1}
    for i in range(len(lengths) - 1, -1, -1):
        x = lengths[i]
        most = min(counts[x] - (x == longest), rest // x)
        used = next(n for n in range(most, -1, -1) if reached[i] >> (rest - n * x) & 1)
        if used:
            chosen[x] = chosen.get(x, 0) + used
            rest -= used * x
    return chosen


def plan(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Combinations, and the number of containers filled with each. Uses every item once."""
    left = {x: n for x, n in counts.items() if n > 0}
    if any(not 0 < x <= capacity for x in left):
        raise ValueError("lengths must lie between 1 and the capacity")
    out = []
    while left:
        chosen = fullest(left, capacity)
        times = min(left[x] // n for x, n in chosen.items())
        out.append((chosen, times))
        for x, n in chosen.items():
            left[x] -= n * times
            if not left[x]:
                del left[x]
    return out


@cache
def tokenizer(path: str | None):
    """A public byte-pair tokenizer; ``path`` names its ranks, or None the installed default."""
    import public_tokenizers
    import tiktoken

    with open(path or public_tokenizers.path(TOKENIZER), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _ranks(lengths: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Number of each item among those of its length so far; ``seen`` is brought up to date."""
    order = np.argsort(lengths, kind="stable")
    ordered = lengths[order]
    head = np.r_[True, np.diff(ordered) != 0] if len(ordered) else np.zeros(0, bool)
    starts = np.flatnonzero(head)
    out = np.empty(len(lengths), np.int64)
    out[order] = np.arange(len(ordered)) - np.repeat(starts, np.diff(np.r_[starts, len(ordered)])) + seen[ordered]
    seen += np.bincount(lengths, minlength=len(seen))
    return out


def _measure(capacity: int, path: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, seen = tokenizer(path).encode_ordinary, TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            n = np.fromiter((len(encode(t)) for t in batch.column(1).to_pylist()), np.int64, batch.num_rows)
            pieces = -(-n // capacity)
            row = np.repeat(np.arange(len(n)), pieces)
            no = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            size = np.minimum(capacity, n[row] - no * capacity)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(row)), pa.array(no.astype(np.int32)), pa.array(no * capacity), pa.array(size.astype(np.int32)),
                pa.array(np.full(len(row), part, np.int32)), pa.array(_ranks(size, seen))], ["doc_id", "piece_no", "first_token", "n_tokens", "part", "rank"])

    return run


def _place(of: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, rank = batch.column("n_tokens").to_numpy(), batch.column("rank").to_numpy()
            container = np.empty(len(size), np.int64)
            for x in np.unique(size).tolist():
                start, base, uses = of[x]
                own = size == x
                at = np.searchsorted(start, rank[own], side="right") - 1
                container[own] = base[at] + (rank[own] - start[at]) // uses[at]
            yield pa.RecordBatch.from_arrays([pa.array(container), *(batch.column(c) for c in ("doc_id", "piece_no", "first_token", "n_tokens"))], ["container_id", "doc_id", "piece_no", "first_token", "n_tokens"])

    return run


def containers(documents: DataFrame, scratch: Scratch, capacity: int = CAPACITY, tokenizer_path: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``container_id, doc_id, piece_no, first_token, n_tokens``: a container for each text, with little unused space.

    A text longer than ``capacity`` tokens is split into pieces of ``capacity`` and a rest; others stay whole.
    Null texts and those without tokens are in no container. Numbering within a length is local to a task,
    with the tasks' counts added up, so a length that many texts share gathers nowhere.
    """
    rows = documents.where(F.col(text).isNotNull()).select(F.col(key).cast("long").alias("doc_id"), text)
    items = scratch.keep(rows.mapInArrow(_measure(capacity, tokenizer_path), "doc_id long, piece_no int, first_token long, n_tokens int, part int, rank long"))
    counts = scratch.keep(items.groupBy("n_tokens", "part").agg(F.count("*").alias("n")))
    before = Window.partitionBy("n_tokens").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    histogram = {r.n_tokens: r.n for r in counts.groupBy("n_tokens").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    runs: dict[int, list[tuple[int, int, int]]] = {}
    used, base = dict.fromkeys(histogram, 0), 0
    for chosen, times in plan(histogram, capacity):
        for x, n in chosen.items():
            runs.setdefault(x, []).append((used[x], base, n))
            used[x] += n * times
        base += times
    of = {x: tuple(np.array(c, np.int64) for c in zip(*r)) for x, r in runs.items()}
    numbered = items.join(offsets, ["n_tokens", "part"]).withColumn("rank", F.col("rank") + F.col("before")).select("doc_id", "piece_no", "first_token", "n_tokens", "rank")
    return numbered.mapInArrow(_place(of), "container_id long, doc_id long, piece_no int, first_token long, n_tokens int")
