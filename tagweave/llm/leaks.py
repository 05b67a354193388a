"""Evaluation passages inside a corpus, by winnowing (problem 8).

Of each sliding window of word k-grams the one with the smallest hash is kept, in passages and documents
alike, so every shared run of ``k + window - 1`` words has a common fingerprint. How long a run a leak must
have follows from the number of words and edits that it may have; k and the window are set to it, class by
class of passages, so no leak is missed and a short passage doesn't coarsen the search for the others.
Fingerprints of both sides are joined on their hash: in the scan of the documents, where the passages have
few enough words to travel to the tasks, else as tables. Common ones are extended to whole runs and over one
edit; what reaches the least length that a leak must have is aligned word by word.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tagweave.llm import characters as C
from tagweave.llm.characters import Characters, spread, units
from tagweave.llm.sentences import _classes, _DIGITS, _forward, _SPACES
from tagweave.plans.runtime import Scratch

#: A leak holds one in so many of the passage's words at least; one word in so many of it may differ.
PART, EDIT_SHARE = 2, 8
#: Bits of the map of the passages' windows that travels to the tasks: 8 MB at most, whatever the number of passages.
LEAST_BITS, MOST_BITS = 20, 26
#: Words of all passages up to which they travel to the tasks (32 MB with their fingerprints); with more, tables are joined.
HELD_WORDS = 2_000_000
#: Parts into which the hits of one fingerprint, and of one passage, are split by document.
SALTS = 16
HEADING_WORDS = 6
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_ENDS = _classes(C.DOT, C.BANG, C.ELLIPSIS, C.CJK_END, C.DANDA, C.NEWLINE, C.CLOSE, C.QUOTE_CLOSE, C.QUOTE_EITHER, C.EDGE)
_WORDS = _classes(C.LOWER, C.UPPER, C.DIGIT, C.LETTER)


@dataclass
class Sequences:
    """Hashes of the words of many texts, a separator after each text; list numbers and headings left out."""

    hash: np.ndarray
    text: np.ndarray
    first: np.ndarray


def sequences(texts: list[str], separator: int) -> Sequences:
    chars = Characters([unicodedata.normalize("NFC", t) for t in texts])
    u, kinds, codes = units(chars), chars.kinds, chars.codes
    keep = np.ones(len(u.start), bool)
    # numbers of list items: digits, a full stop or bracket and a blank, at the start of a line or sentence
    after = kinds[u.start - 1]
    back = np.where(_SPACES[after], kinds[np.maximum(u.start - 2, 0)], after)
    number = (_forward(kinds, u.start, _DIGITS) == u.end) & ((codes[u.end] == 0x2E) | (codes[u.end] == 0x29))
    keep &= ~(number & _SPACES[kinds[np.minimum(u.end + 1, len(kinds) - 1)]] & (_SPACES[after] | (after == C.EDGE)) & ((after == C.NEWLINE) | _ENDS[back] | _SPACES[back]))
    # headings: a few words without an end mark, before a blank line
    newline_at = np.flatnonzero(kinds == C.NEWLINE)
    if len(newline_at) and len(u.start):
        gap = np.flatnonzero(_SPACES[kinds[1:]] & ~_SPACES[kinds[:-1]]) + 1
        gap_end = _forward(kinds, gap, _SPACES)
        blank = (np.searchsorted(newline_at, gap_end) - np.searchsorted(newline_at, gap) >= 2) & _WORDS[kinds[gap - 1]]
        gap = gap[blank]
        ends = np.flatnonzero(_ENDS[kinds])
        begin = ends[np.searchsorted(ends, gap) - 1]
        a, b = np.searchsorted(u.start, begin), np.searchsorted(u.start, gap)
        for x, y in zip(a[b - a <= HEADING_WORDS].tolist(), b[b - a <= HEADING_WORDS].tolist()):
            keep[x:y] = False
    text, h = u.text[keep], u.hash[keep]
    count = np.bincount(text, minlength=len(texts))
    first = np.cumsum(count + 1) - count - 1
    out = np.full(len(h) + len(texts) + 64, np.uint64(separator), np.uint64)
    out[np.arange(len(h)) + text] = h
    owner = np.repeat(np.arange(len(texts) + 1), np.r_[count + 1, 64])
    return Sequences(out, owner, first)


def least_runs(sizes: np.ndarray) -> tuple[int, int, int]:
    """Words that the longest shared run of any leak has at least, the best two neighbouring runs, and the best three."""
    run = pair = three = 1 << 30
    for n in np.unique(sizes).tolist():
        for s in range(-(-n // PART), n + 1):
            edits = s // (EDIT_SHARE - 1)  # the longer of the two stretches decides, it has s + edits words at most
            run = min(run, -(-(s - edits) // (edits + 1)))
            pair = min(pair, -(-(s - edits) // (edits // 2 + 1)))
            three = min(three, -(-(s - edits) // (edits // 3 + 1)))
    return max(1, run), max(1, pair), max(1, three)


@cache
def bounds(n: int) -> tuple[int, int, int, int, int]:
    """Of a passage of ``n`` words: the least longest run, pair and triple of runs, k and the window."""
    run, pair, three = least_runs(np.array([n]))
    k = max(1, min(4, run - 2)) if run > 2 else run
    return run, pair, three, k, run - k + 1


def setting(run: int) -> tuple[int, int]:
    """k and window of the passages whose leaks have a run of so many words."""
    k = max(1, min(4, run - 2)) if run > 2 else run
    return k, run - k + 1


def windows(s: Sequences, run: int, separator: int) -> np.ndarray:
    """Places where ``run`` words of one text begin."""
    n = len(s.hash) - run + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    whole = s.text[:n] == s.text[run - 1 : run - 1 + n]
    for j in (0, run - 1):
        whole &= s.hash[j : j + n] != np.uint64(separator)
    return np.flatnonzero(whole)


def fingerprints(s: Sequences, run: int, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the k-grams that winnowing keeps in the windows that begin at ``starts``."""
    k, window = setting(run)
    grams = np.stack([gram_hashes(s, starts + j, k) for j in range(window)]) if len(starts) else np.zeros((window, 0), np.uint64)
    at = np.unique(starts + grams.argmin(0))
    return at, gram_hashes(s, at, k)


def gram_hashes(s: Sequences, at: np.ndarray, k: int) -> np.ndarray:
    return spread(reduce(lambda g, j: g * _MULTIPLIER + s.hash[at + j], range(1, k), s.hash[at]))


def slots(grams: np.ndarray, run: int, bits: int) -> np.ndarray:
    """The bit of each window of ``run`` words in the map."""
    return (spread(grams ^ np.uint64(run)) & np.uint64((1 << bits) - 1)).astype(np.int64)


_DOCUMENT, _PASSAGE = 0, 1
#: Words that a run is followed for; a longer one is long enough.
FAR = 48


def _same(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, step: int) -> np.ndarray:
    """Equal words from places ``i`` of ``a`` and ``j`` of ``b`` on, in the direction ``step``."""
    n, live = np.zeros(len(i), np.int64), np.arange(len(i))
    for far in range(FAR):
        x, y = i[live] + far * step, j[live] + far * step
        live = live[(x >= 0) & (y >= 0) & (a[np.minimum(x, len(a) - 1)] == b[np.minimum(y, len(b) - 1)]) & (x < len(a)) & (y < len(b))]
        if not len(live):
            break
        n[live] += 1
    return n


def _grown(a: np.ndarray, b: np.ndarray, p: np.ndarray, q: np.ndarray, size: np.ndarray, step: int, edits: int) -> np.ndarray:
    """Most equal words that follow a run on one side over so many edits."""
    x, y = (p + size, q + size) if step > 0 else (p - 1, q - 1)
    best = np.zeros(len(p), np.int64)
    for dx, dy in ((1, 1), (1, 0), (0, 1)):
        i, j = x + dx * step, y + dy * step
        n = _same(a, b, i, j, step)
        best = np.maximum(best, n)
        if edits > 1:
            for ex, ey in ((1, 1), (1, 0), (0, 1)):
                best = np.maximum(best, n + _same(a, b, i + (n + ex) * step, j + (n + ey) * step, step))
    return best


def _reach(a: list[int], b: list[int], most: int) -> list[tuple[int, int, int]]:
    """For 0, 1, ... edits from the start of both: words of ``b`` and of ``a`` up to the last that agree, furthest in ``b``."""
    n, m = len(a), len(b)

    def slide(i: int, d: int) -> int:
        while i < n and i + d < m and a[i] == b[i + d]:
            i += 1
        return i

    reach, out, best = {0: slide(0, 0)}, [], (0, 0)
    best = (reach[0], reach[0])
    out.append(best)
    for e in range(1, most + 1):
        after = {}
        for d in range(-e, e + 1):
            i = max(reach.get(d, -9) + 1, reach.get(d - 1, -9), reach.get(d + 1, -9) + 1)
            i = min(i, n, m - d)
            if i < 0 or i + d < 0:
                continue
            after[d] = far = slide(i, d)
            if far > i and far + d > best[0]:
                best = (far + d, far)
        reach = after
        out.append(best)
    return out


def _triples(h: np.ndarray) -> np.ndarray:
    return spread((h[:-2] * _MULTIPLIER + h[1:-1]) * _MULTIPLIER + h[2:])


def _hopeless(doc: np.ndarray, passage: np.ndarray, at: int, length: int, span: int) -> bool:
    """Whether too few word triples of the passage stand near the run: each edit takes three of a stretch at most."""
    words = -(-len(passage) // PART)
    least = words - 2 - 3 * (words // (EDIT_SHARE - 1))
    if least <= 0 or len(passage) < 3:
        return False
    near = doc[max(0, at - span) : at + length + span]
    return len(near) < 3 or int(np.isin(_triples(passage), _triples(near)).sum()) < least


def alignment(doc: np.ndarray, passage: np.ndarray, at: int, of: int, length: int) -> tuple[int, int] | None:
    """Words of ``passage`` in the longest stretch around a shared run, and its edits, if it makes a leak."""
    n = len(passage)
    most = n // (EDIT_SHARE - 1)
    span = n + most
    if _hopeless(doc, passage, at, length, span):
        return None
    right = _reach(doc[at + length : at + length + span].tolist(), passage[of + length :].tolist(), most)
    left = _reach(doc[max(0, at - span) : at][::-1].tolist(), passage[:of][::-1].tolist(), most)
    best = None
    for x, (rp, rd) in enumerate(right):
        for y, (lp, ld) in enumerate(left):
            words = lp + length + rp
            if words * PART >= n and (x + y) * EDIT_SHARE <= max(words, ld + length + rd) and (best is None or words > best[0]):
                best = (words, x + y)
    return best


def _numbered(n: int, seen: int) -> np.ndarray:
    """Numbers of rows that no other task gives."""
    return (np.int64(TaskContext.get().partitionId()) << np.int64(40)) + seen + np.arange(n)


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(values))


_PASSAGES = "no long, passage_id long, run int, words array<long>, at array<int>, prints array<long>, windows array<long>"


def _of_passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words, fingerprints and hashes of all windows of every passage that has words."""
    seen = 0
    for batch in batches:
        s = sequences(batch.column("text").to_pylist(), _PASSAGE)
        word = s.hash != _PASSAGE
        size = np.bincount(s.text[word], minlength=batch.num_rows)[: batch.num_rows]
        run = np.array([bounds(n)[0] if n else 0 for n in size.tolist()], np.int64)
        parts = []
        for r in np.unique(run[run > 0]).tolist():
            starts = windows(s, r, _PASSAGE)
            starts = starts[run[s.text[starts]] == r]
            at, prints = fingerprints(s, r, starts)
            parts.append((starts, gram_hashes(s, starts, r), at, prints))
        starts, grams, at, prints = (np.concatenate(x) for x in zip(*parts)) if parts else [np.zeros(0, np.int64)] * 4
        by = [np.argsort(x, kind="stable") for x in (starts, at)]
        starts, grams, at, prints = starts[by[0]], grams[by[0]], at[by[1]], prints[by[1]]
        count = lambda x: np.bincount(s.text[x], minlength=batch.num_rows)[: batch.num_rows] if len(x) else np.zeros(batch.num_rows, np.int64)
        out = pa.RecordBatch.from_arrays([
            pa.array(_numbered(batch.num_rows, seen)), batch.column("passage_id"), pa.array(run.astype(np.int32)), _lists(s.hash[word].view(np.int64), size),
            _lists((at - s.first[s.text[at]]).astype(np.int32), count(at)), _lists(prints.view(np.int64), count(at)), _lists(grams.view(np.int64), count(starts))],
            ["no", "passage_id", "run", "words", "at", "prints", "windows"])
        seen += batch.num_rows
        yield out.filter(pa.array(run > 0))


def _mapped(bits: int):
    """Rows of a passage's windows -> 64 bits of the map each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.list_value_length(batch.column("windows")).to_numpy(zero_copy_only=False)
            grams = pc.list_flatten(batch.column("windows")).to_numpy(zero_copy_only=False).view(np.uint64)
            kinds = np.repeat(batch.column("run").to_numpy(zero_copy_only=False), sizes)
            own = [slots(grams[kinds == r], r, bits) for r in np.unique(kinds).tolist()]
            at = np.unique(np.concatenate(own)) if own else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array(np.int64(1) << (at & 63))], ["word", "bit"])

    return run


def _held_windows(s: Sequences, runs: list[int], known: np.ndarray, bits: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each length of runs, the places and hashes of the fingerprints in windows that the map holds."""
    gram = s.hash
    for r in range(1, max(runs) + 1):
        if r > 1:
            gram = gram[:-1] * _MULTIPLIER + s.hash[r - 1 :]
        if r in runs:
            slot = slots(spread(gram), r, bits)
            maybe = np.flatnonzero(known[slot >> 3] >> (slot & 7).astype(np.uint8) & 1)
            fits = (s.text[maybe] == s.text[maybe + r - 1]) & (s.hash[maybe + r - 1] != _DOCUMENT) & (s.hash[maybe] != _DOCUMENT)
            yield r, *fingerprints(s, r, maybe[fits])


_HITS = "row long, doc_id long, words array<long>, run int, print long, at int"


def _of_documents(runs: list[int], shared, bits: int):
    """Documents -> the fingerprints of those of their windows that the map holds, and their words if there are any."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, seen = [f.split()[0] for f in _HITS.split(", ")], 0
        for whole in batches:
            for batch in (whole.slice(i, 1000) for i in range(0, whole.num_rows, 1000)):
                s = sequences(batch.column(1).to_pylist(), _DOCUMENT)
                found = [(np.full(len(at), r, np.int32), prints.view(np.int64), at) for r, at, prints in _held_windows(s, runs, shared.value, bits)]
                kinds, prints, at = (np.concatenate(x) for x in zip(*found))
                number, text, n = _numbered(batch.num_rows, seen), s.text[at], len(at)
                seen += batch.num_rows
                yield pa.RecordBatch.from_arrays([
                    pa.array(number[text]), pa.nulls(n, pa.int64()), pa.nulls(n, pa.list_(pa.int64())), pa.array(kinds), pa.array(prints),
                    pa.array((at - s.first[text]).astype(np.int32))], names)
                own = np.unique(text)
                size = _sizes(s)[own]
                words = s.hash[np.repeat(s.first[own], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)]
                yield pa.RecordBatch.from_arrays([
                    pa.array(number[own]), batch.column(0).take(pa.array(own)), _lists(words.view(np.int64), size), *(pa.nulls(len(own), t) for t in (pa.int32(), pa.int64(), pa.int32()))], names)

    return run


def _sizes(s: Sequences) -> np.ndarray:
    return np.r_[s.first[1:], len(s.hash) - 64] - 1 - s.first


def _joined(lists: pa.Array, separator: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of all rows in one array, a separator after each; where each row begins, and its number of words."""
    size = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.list_flatten(lists).to_numpy(zero_copy_only=False).view(np.uint64)
    out = np.full(len(flat) + len(size) + 64, np.uint64(separator), np.uint64)
    out[np.arange(len(flat)) + np.repeat(np.arange(len(size)), size)] = flat
    return out, np.cumsum(size + 1) - size - 1, size


@dataclass
class Held:
    """Words of many texts in one array, where each text begins, and its number of words."""

    hash: np.ndarray
    first: np.ndarray
    size: np.ndarray


def confirm(doc: Held, pas: Held, text: np.ndarray, own: np.ndarray, p: np.ndarray, q: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Text, passage, words and edits of every leak, from the places ``p`` and ``q`` of common fingerprints of a text and a passage."""
    run, pair, three = np.array([bounds(n)[:3] if n else (1, 1, 1) for n in pas.size.tolist()], np.int64).reshape(-1, 3).T
    right, left = _same(doc.hash, pas.hash, p, q, 1), _same(doc.hash, pas.hash, p - 1, q - 1, -1)
    found = np.unique(np.stack([text, own, p - left, q - left, right + left], 1)[right + left >= run[own]], axis=0)
    text, own, p, q, size = found.T if len(found) else np.zeros((5, 0), np.int64)
    one = np.maximum(*(_grown(doc.hash, pas.hash, p, q, size, step, 1) for step in (1, -1)))
    text, own, p, q, size = (x[size + one >= pair[own]] for x in (text, own, p, q, size))
    r1, l1 = (_grown(doc.hash, pas.hash, p, q, size, step, 1) for step in (1, -1))
    r2, l2 = (_grown(doc.hash, pas.hash, p, q, size, step, 2) for step in (1, -1))
    text, own, p, q, size = (x[size + np.maximum(r1 + l1, np.maximum(r2, l2)) >= three[own]] for x in (text, own, p, q, size))
    out: dict[tuple[int, int], tuple[int, int]] = {}
    for i in np.argsort(-size, kind="stable").tolist():  # the longest run of a pair first; the first that holds decides
        t, o = int(text[i]), int(own[i])
        if (t, o) not in out:
            first, start = int(pas.first[o]), int(doc.first[t])
            got = alignment(doc.hash[start : start + int(doc.size[t])], pas.hash[first : first + int(pas.size[o])], int(p[i]) - start, int(q[i]) - first, int(size[i]))
            if got:
                out[t, o] = got
    return [(t, o, w, e) for (t, o), (w, e) in sorted(out.items())]


@dataclass
class Index:
    """All passages with their fingerprints, sorted by hash for each length of runs."""

    ids: list[int | None]
    words: Held
    prints: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]


def _index(mine: pa.Table) -> Index:
    mine = mine.combine_chunks()
    lists = {c: mine.column(c).combine_chunks() for c in ("words", "at", "prints")}
    held = Held(*_joined(lists["words"], _PASSAGE))
    owner = np.repeat(np.arange(mine.num_rows), pc.list_value_length(lists["at"]).to_numpy(zero_copy_only=False))
    at, prints = (pc.list_flatten(lists[c]).to_numpy(zero_copy_only=False) for c in ("at", "prints"))
    kind, of = mine.column("run").to_numpy()[owner], {}
    for r in np.unique(kind).tolist():
        own = np.flatnonzero(kind == r)
        own = own[np.argsort(prints[own].view(np.uint64), kind="stable")]
        of[r] = prints[own].view(np.uint64), owner[own], held.first[owner[own]] + at[own]
    return Index(mine.column("passage_id").to_pylist(), held, of)


def _found(shared_index, shared, bits: int):
    """Documents -> leaks, with all passages at hand."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = shared_index.value
        for whole in batches:
            for batch in (whole.slice(i, 1000) for i in range(0, whole.num_rows, 1000)):
                s = sequences(batch.column(1).to_pylist(), _DOCUMENT)
                places = []
                for r, at, prints in _held_windows(s, sorted(index.prints), shared.value, bits):
                    hashes, owner, of = index.prints[r]
                    low, high = np.searchsorted(hashes, prints, "left"), np.searchsorted(hashes, prints, "right")
                    count = high - low
                    hit = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
                    places.append((np.repeat(at, count), owner[hit], of[hit]))
                p, own, q = (np.concatenate(x) for x in zip(*places))
                yield _leaks_of(confirm(Held(s.hash, s.first, _sizes(s)), index.words, s.text[p], own, p, q), batch.column(0), pa.array(index.ids, pa.int64()), index.words.size)

    return run


def _leaks_of(rows: list[tuple[int, int, int, int]], doc_ids: pa.Array, passage_ids: pa.Array, sizes: np.ndarray) -> pa.RecordBatch:
    text, own, words, edits = zip(*rows) if rows else ([], [], [], [])
    take = pa.array(own, pa.int64())
    return pa.RecordBatch.from_arrays([
        passage_ids.take(take), doc_ids.take(pa.array(text, pa.int64())), pa.array(words, pa.int32()), pa.array(edits, pa.int32()),
        pa.array(np.array(words, np.float64) / sizes[np.array(own, np.int64)])], ["passage_id", "doc_id", "words", "edits", "part"])


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a document's and a passage's words and the places of their common fingerprints -> leaks."""
    for whole in batches:
        for batch in (whole.slice(i, 300) for i in range(0, whole.num_rows, 300)):
            doc, pas = Held(*_joined(batch.column("doc_words"), _DOCUMENT)), Held(*_joined(batch.column("passage_words"), _PASSAGE))
            row = np.repeat(np.arange(batch.num_rows), pc.list_value_length(batch.column("at")).to_numpy(zero_copy_only=False))
            p, q = (pc.list_flatten(batch.column(c)).to_numpy(zero_copy_only=False) + side.first[row] for c, side in (("at", doc), ("of", pas)))
            yield _leaks_of(confirm(doc, pas, row, row, p, q), batch.column("doc_id"), batch.column("passage_id"), pas.size)


def leaked_passages(documents: DataFrame, passages: DataFrame, scratch: Scratch) -> DataFrame:
    """``passage_id, doc_id, words, edits, part`` of every passage that a document gives away, whole or in part.

    Documents are scanned once, where they lie, whatever the number of passages. With more than HELD_WORDS words
    in the passages, the documents' fingerprints in windows that some passage may have, and the words of those
    that have any, are shuffled; a hash, or a passage, that many documents share is split by document. Null and blank texts and passages give no row;
    equal passages, and equal documents, each give theirs. An empty table gives an empty result.
    """
    spark = documents.sparkSession
    schema = "passage_id long, doc_id long, words int, edits int, part double"
    mine = scratch.keep(passages.where("text is not null").select(F.col("passage_id").cast("long").alias("passage_id"), "text").mapInArrow(_of_passages, _PASSAGES))
    total = mine.groupBy("run").agg(F.sum(F.size("windows")).alias("n"), F.sum(F.size("words")).alias("n_words")).collect()  # a run has six words at most
    if not total:
        return spark.createDataFrame([], schema)
    bits = min(MOST_BITS, max(LEAST_BITS, (32 * sum(r.n for r in total)).bit_length()))
    words = mine.select("run", "windows").mapInArrow(_mapped(bits), "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()  # 2 ** (MOST_BITS - 6) rows at most
    known = np.zeros(1 << (bits - 6), np.int64)
    known[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    shared = spark.sparkContext.broadcast(known.view(np.uint8))
    docs = documents.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if sum(r.n_words for r in total) <= HELD_WORDS:
        index = spark.sparkContext.broadcast(_index(mine.select("passage_id", "run", "words", "at", "prints").toArrow()))
        return docs.mapInArrow(_found(index, shared, bits), schema)
    found = scratch.keep(docs.mapInArrow(_of_documents(sorted(r.run for r in total), shared, bits), _HITS))
    part = F.pmod(F.col("row"), F.lit(SALTS)).cast("int").alias("salt")
    parts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    theirs = found.where("print is not null").select("row", "run", "print", "at", part)
    prints = mine.select("no", "run", F.explode(F.arrays_zip(F.col("prints").alias("print"), F.col("at").alias("of"))).alias("x")).select("no", "run", "x.print", "x.of", parts)
    pairs = theirs.join(prints, ["run", "print", "salt"]).groupBy("row", "no").agg(F.collect_list(F.struct("at", "of")).alias("places"))
    pairs = pairs.join(found.where("words is not null").select("row", "doc_id", F.col("words").alias("doc_words")), "row").withColumn("salt", F.pmod("row", F.lit(SALTS)).cast("int"))
    whole = pairs.join(mine.select("no", "passage_id", F.col("words").alias("passage_words"), parts), ["no", "salt"])
    columns = whole.select("passage_id", "doc_id", "doc_words", "passage_words", F.col("places.at").alias("at"), F.col("places.of").alias("of"))
    return columns.mapInArrow(_confirmed, schema)
