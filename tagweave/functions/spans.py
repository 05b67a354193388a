"""Column functions over tag sequences and spans of one sentence. None needs a shuffle."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F, types as T

SPAN = "array<struct<type:string,first:int,last:int>>"


def tag_type(tag: Column) -> Column:
    """Type of an inside-outside-begin tag; null for 'O'."""
    return F.when(tag.rlike("^[BI]-"), F.substring(tag, 3, 1 << 20))


def clean_tags(tags: Column) -> Column:
    """Tags with everything that isn't 'B-' or 'I-' and a type, nulls included, as 'O'."""
    return F.transform(tags, lambda t: F.when(t.rlike("^[BI]-."), t).otherwise(F.lit("O")))


def _flat(tags: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str | None]]:
    """For every tag of a batch: its row, whether it begins ('B-'), and the number of its type (-1 for none)."""
    rows = pc.list_parent_indices(tags).to_numpy(zero_copy_only=False)
    coded = pc.list_flatten(tags).dictionary_encode(null_encoding="encode")
    names = coded.dictionary.to_pylist()
    types = [n[2:] if n is not None and n[:2] in ("B-", "I-") else None for n in names]
    number = {t: i for i, t in enumerate(dict.fromkeys(t for t in types if t is not None))}
    of = np.array([number.get(t, -1) for t in types] or [0], np.int64)
    begins = np.array([n is not None and n[:2] == "B-" for n in names] or [False])
    codes = coded.indices.to_numpy(zero_copy_only=False) if len(coded) else np.zeros(0, np.int64)
    return rows, begins[codes], of[codes], list(number)


def chunk_batch(tags: pa.Array) -> pa.Array:
    """Entities of every sequence of a batch, all tags at once."""
    rows, begins, kind, names = _flat(tags)
    n = len(rows)
    before = np.r_[-1, np.where(rows[1:] == rows[:-1], kind[:-1], -1)] if n else kind
    after_begins = np.r_[begins[1:], False] if n else begins
    after = np.r_[np.where(rows[1:] == rows[:-1], kind[1:], -1), -1] if n else kind
    first = np.flatnonzero((kind >= 0) & (begins | (before != kind)))
    last = np.flatnonzero((kind >= 0) & (after_begins | (after != kind)))
    starts = np.searchsorted(rows, np.arange(len(tags) + 1))
    base = starts[rows[first]] if n else first
    values = pa.StructArray.from_arrays(
        [pa.array(names, pa.string()).take(pa.array(kind[first])), pa.array((first - base).astype(np.int32)), pa.array((last - base).astype(np.int32))], ["type", "first", "last"])
    offsets = np.searchsorted(rows[first] if n else first, np.arange(len(tags) + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), values)


def chunks(tags: Column) -> Column:
    """Entities of a tag sequence as ``(type, first, last)``, both ends included, in order.

    An entity starts at 'B-', and at 'I-' after 'O' or another type; it ends before 'O', 'B-' or another
    type. Null and empty sequences have none. Whole batches of sequences are cut at once; lambdas over
    arrays are evaluated tag by tag, which takes ten times as long.
    """
    return F.arrow_udf(chunk_batch, T.ArrayType(T.StructType([T.StructField("type", T.StringType()), T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType())])))(tags)


def stray_inside(tags: Column) -> Column:
    """Positions of 'I-' tags that continue no entity of their type."""
    def run(tags: pa.Array) -> pa.Array:
        rows, begins, kind, _ = _flat(tags)
        before = np.r_[-1, np.where(rows[1:] == rows[:-1], kind[:-1], -1)] if len(rows) else kind
        at = np.flatnonzero((kind >= 0) & ~begins & (before != kind))
        starts = np.searchsorted(rows, np.arange(len(tags) + 1))
        offsets = np.searchsorted(rows[at], np.arange(len(tags) + 1)).astype(np.int32) if len(rows) else np.zeros(len(tags) + 1, np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array((at - starts[rows[at]]).astype(np.int32) if len(rows) else at.astype(np.int32)))

    return F.arrow_udf(run, T.ArrayType(T.IntegerType()))(tags)


def _columns(spans: pa.Array) -> tuple[list[int], list[str], list[int], list[int]]:
    """Where each row's spans begin (and the last row's end), and the spans' types, first and last words."""
    sizes = pc.fill_null(pc.list_value_length(spans), 0).to_numpy(zero_copy_only=False)
    flat = pc.list_flatten(spans)
    return [0, *np.cumsum(sizes).tolist()], *(pc.struct_field(flat, [i]).to_pylist() for i in range(3))


def greedy_batch(predicted: pa.Array, gold: pa.Array) -> pa.Array:
    """Types of the matched predicted spans of every row of a batch."""
    at_p, type_p, first_p, last_p = _columns(predicted)
    at_g, type_g, first_g, last_g = _columns(gold)
    out, ends = [], [0]
    for row in range(len(at_p) - 1):
        left = list(range(at_g[row], at_g[row + 1]))
        for p in range(at_p[row], at_p[row + 1]) if left else ():
            for k, g in enumerate(left):
                if type_g[g] == type_p[p] and first_g[g] <= last_p[p] and last_g[g] >= first_p[p]:
                    out.append(type_p[p])
                    del left[k]
                    break
        ends.append(len(out))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(out, pa.string()))


def greedy_matches(predicted: Column, gold: Column) -> Column:
    """Types of the predicted spans that take a gold span, in predicted order.

    A span takes the first gold span of its type, not taken yet, with which it shares a word. What is left
    for a span depends on those before it, so sentences are gone through in batches of rows.
    """
    return F.arrow_udf(greedy_batch, T.ArrayType(T.StringType()))(predicted, gold)


def _match_sets(predicted: list[dict], gold: list[dict]) -> list[str]:
    """Gold mentions are found by their tokens, so that documents with many cost no more than their tokens."""
    by_token: dict[int, list[int]] = {}
    for i, g in enumerate(gold):
        for t in g["tokens"] or ():
            by_token.setdefault(t, []).append(i)
    taken, out = set(), []
    for p in predicted:
        near = sorted({i for t in p["tokens"] or () for i in by_token.get(t, ())})
        if (hit := next((i for i in near if i not in taken and gold[i]["type"] == p["type"]), None)) is not None:
            taken.add(hit)
            out.append(p["type"])
    return out


def greedy_set_matches(predicted: Column, gold: Column) -> Column:
    """As greedy_matches for mentions ``(type, tokens)`` whose tokens may have gaps."""
    def run(p: pa.Array, g: pa.Array) -> pa.Array:
        return pa.array([_match_sets(a or [], b or []) for a, b in zip(p.to_pylist(), g.to_pylist())], pa.list_(pa.string()))

    return F.arrow_udf(run, T.ArrayType(T.StringType()))(predicted, gold)


def _places(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All words from each ``first`` to its ``last``, and which span each belongs to."""
    size = last - first + 1
    of = np.repeat(np.arange(len(size)), size)
    return np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + first[of], of


def apart(first: np.ndarray, last: np.ndarray, n: int) -> np.ndarray:
    """Which spans of words share none with a kept one before them.

    All spans go through the same rounds: one that is the foremost on each of its words is kept, those that
    meet it are dropped, and what is left over goes into the next round.
    """
    kept, live, taken = np.zeros(len(first), bool), np.arange(len(first)), np.zeros(n, bool)
    while len(live):
        at, of = _places(first[live], last[live])
        foremost = np.full(n, len(first))
        np.minimum.at(foremost, at, live[of])
        heads = np.searchsorted(of, np.arange(len(live)))
        wins = np.logical_and.reduceat(foremost[at] == live[of], heads)
        taken[at[wins[of]]] = True
        kept[live[wins]] = True
        live = live[~np.logical_or.reduceat(taken[at], heads)]
    return kept


def paint_batch(spans: pa.Array, n: pa.Array) -> pa.Array:
    """Tag sequences of all rows of a batch at once."""
    ends = np.cumsum(np.maximum(pc.fill_null(n, 0).to_numpy(zero_copy_only=False).astype(np.int64), 0))
    starts = np.r_[0, ends[:-1]] if len(ends) else ends
    rows = pc.list_parent_indices(spans).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.list_flatten(spans)
    coded = pc.struct_field(flat, [0]).dictionary_encode(null_encoding="encode")
    first, last = (pc.struct_field(flat, [i]).to_numpy(zero_copy_only=False).astype(np.int64) for i in (1, 2))
    first, last = starts[rows] + np.maximum(first, 0), np.minimum(starts[rows] + last, ends[rows] - 1)
    there = np.flatnonzero(first <= last)
    there = there[apart(first[there], last[there], int(ends[-1]) if len(ends) else 0)]
    at, of = _places(first[there], last[there])
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)[there]
    tags = np.zeros(ends[-1] if len(ends) else 0, np.int64)
    tags[at] = 1 + 2 * codes[of] + (at != first[there][of])
    names = ["O", *(f"{b}-{t or ''}" for t in coded.dictionary.to_pylist() for b in "BI")]
    return pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(names).take(pa.array(tags)))


def tags_of(spans: Column, n: Column) -> Column:
    """Tag sequence of ``n`` words from spans ``(type, first, last)``; a span that overlaps an earlier one is dropped,
    and so is what lies outside the words."""
    return F.arrow_udf(paint_batch, T.ArrayType(T.StringType()))(spans, n)


def over_words(spans: Column, words: Column) -> Column:
    """Character spans ``(type, start, end)`` as spans of the words ``(word, start, end)`` that they overlap, in order;
    those that overlap none are left out."""
    def run(spans: pa.Array, words: pa.Array) -> pa.Array:
        row_w, row_s = (pc.list_parent_indices(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in (words, spans))
        flat_w, flat_s = pc.list_flatten(words), pc.list_flatten(spans)
        begins, ends = (pc.struct_field(flat_w, [i]).to_numpy(zero_copy_only=False).astype(np.int64) for i in (1, 2))
        start, end = (pc.struct_field(flat_s, [i]).to_numpy(zero_copy_only=False).astype(np.int64) for i in (1, 2))
        far = 2 + max(ends.max(initial=0), end.max(initial=0))  # rows lie so far apart on one line
        first = np.searchsorted(ends + row_w * far, start + row_s * far, side="right")
        last = np.searchsorted(begins + row_w * far, end + row_s * far, side="left") - 1
        base = np.searchsorted(row_w, np.arange(len(words) + 1))
        first, last = np.maximum(first, base[row_s]), np.minimum(last, base[row_s + 1] - 1)
        keep = np.flatnonzero(first <= last)
        offsets = np.searchsorted(row_s[keep], np.arange(len(spans) + 1)).astype(np.int32)
        own = base[row_s[keep]]
        values = [pc.struct_field(flat_s, [0]).take(pa.array(keep)), pa.array((first[keep] - own).astype(np.int32)), pa.array((last[keep] - own).astype(np.int32))]
        return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(values, ["type", "first", "last"]))

    return F.arrow_udf(run, T.ArrayType(T.StructType([T.StructField("type", T.StringType()), T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType())])))(spans, words)
