"""Same or nearly the same records in training and evaluation splits (problem 6).

Every evaluation text is cut into one span more than the edits that a partner may have, so that one span
at least stands unaltered in any partner. Spans are cut to hold equal information, measured by word pair
counts over all rows; the most telling words of each span are the patterns of Aho-Corasick automata over
shards of the evaluation texts, which scan the training texts: all of them if the shards are few, else each
text only in the shards that hold a pattern of its own words, found by the patterns' hashes. Intervals that match
at a fitting place are merged into the coverage of the evaluation text, and each candidate is then compared word by word.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.dataset
import pyarrow.fs
import pyarrow.parquet
from pyspark.sql import DataFrame, functions as F

from tagweave.llm.words import words
from tagweave.plans.runtime import Scratch

TRAINING, EVALUATION = ("bootstrap", "pool"), ("validation", "test")
#: One word in so many may differ.
EDIT_SHARE = 8
#: Counters of word pairs; pairs that share one count together, which only makes a pattern look more frequent.
COUNTERS, COUNTER_BLOCK = 1 << 18, 512
#: Words in a pattern at most, patterns in a shard, training texts in a file, which a task scans.
PATTERN_WORDS, SHARD_PATTERNS, TASK_TEXTS = 8, 400_000, 200_000
#: Shards up to which every training text is scanned in each that its length fits; with more, texts are sent to the
#: shards that hold a pattern of theirs, so that the work doesn't grow with texts times shards.
MOST_BRANCHES = 3
#: Bits of a filter for each pattern at least, and the growth of lengths from one band of texts to the next.
FILTER_BITS, BAND = 16, 1.15
#: Places of patterns, each with all texts that it belongs to, that are held at once.
MOST_PLACES = 2_000_000
#: Rows from which a class of equal texts may be hot, hot classes at most, and the parts that one is split into.
HOT_ROWS, MOST_HOT, HOT_PARTS = 50_000, 500, 32
_BITS, _PLACES = 8, 2


def most_edits(n):
    """Edits that a partner of a text of ``n`` words may have: the longer text has at most n + edits words."""
    return n // (EDIT_SHARE - 1)


class _Coded(dict):
    """Word -> two letters, each from a range of its own, so that matches start at words."""

    def __missing__(self, word: str) -> str:
        if len(self) > 400_000:
            self.clear()
        h = zlib.crc32(word.encode())
        self[word] = s = "".join(chr(0x100 * (i + 1) + (h >> _BITS * i) % (1 << _BITS)) for i in range(_PLACES))
        return s


class _Numbered(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 400_000:
            self.clear()
        self[word] = h = zlib.crc32(word.encode())
        return h


def _pair_counters(numbers: np.ndarray) -> np.ndarray:
    """Counter of each word with the one before it."""
    return ((numbers[:-1].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + numbers[1:] * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(46)).astype(np.int64)


def _one_counters(numbers: np.ndarray) -> np.ndarray:
    return ((numbers.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(46)).astype(np.int64)


def _flat_numbers(texts: list[list[str]], number: _Numbered) -> tuple[np.ndarray, np.ndarray]:
    """The words of many texts in one array, and where each text begins (and the last one ends)."""
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=starts[1:])
    return np.fromiter(map(number.__getitem__, chain.from_iterable(texts)), np.uint64, starts[-1]), starts


def _prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows -> their words joined by blanks; in rows of their own, counts of words and word pairs."""
    number = _Numbered()
    ones, pairs = np.zeros(COUNTERS, np.int64), np.zeros(COUNTERS, np.int64)
    for batch in batches:
        texts = list(map(words, batch.column("joined").to_pylist()))
        flat, starts = _flat_numbers(texts, number)
        if len(flat):
            ones += np.bincount(_one_counters(flat), minlength=COUNTERS)
            inner = np.ones(len(flat), bool)
            inner[starts[:-1][np.diff(starts) > 0]] = False  # a text's first word has none before it
            pairs += np.bincount(_pair_counters(flat)[inner[1:]], minlength=COUNTERS)
        out = pa.RecordBatch.from_arrays([batch.column("row_id"), batch.column("training"), pa.array(np.diff(starts).astype(np.int32)), pa.array(list(map(" ".join, texts)), pa.string())], ["row_id", "training", "n", "text"])
        yield out.filter(pa.compute.greater(out.column("n"), 0))
    blocks = np.concatenate([ones, pairs]).reshape(-1, COUNTER_BLOCK)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(blocks))), pa.nulls(len(blocks), pa.bool_()), pa.array(np.full(len(blocks), -1, np.int32)), pa.array([" ".join(map(str, b)) for b in blocks.tolist()])], ["row_id", "training", "n", "text"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of counters -> their sums, block by block."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            sums[block] = sums.get(block, 0) + np.array(counts.split(" "), np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([x.tolist() for x in sums.values()], pa.list_(pa.int64()))], ["block", "counts"])


def information(flat: np.ndarray, starts: np.ndarray, ones: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """How unexpected each word is after the one before it in its text, in nats."""
    single = ones[_one_counters(flat)]
    out = np.empty(len(flat))
    out[1:] = np.log(np.maximum(1.0, single[:-1] / np.maximum(1, pairs[_pair_counters(flat)])))
    out[starts[:-1]] = np.log(ones.sum() / np.maximum(1, single[starts[:-1]]))
    return out


def _packed(info: np.ndarray, starts: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Goes through all texts at once, closing a span as soon as it holds ``least``: the number of spans of
    each text, and the number of spans closed up to and including each word."""
    n = np.diff(starts)
    held, closed, so_far = np.zeros(len(n)), np.zeros(len(n), np.int64), np.zeros(len(info), np.int64)
    order = np.argsort(-n, kind="stable")
    there = np.searchsorted(-n[order], -np.arange(n.max()), side="left")  # texts with a word at each place
    for place, count in enumerate(there.tolist()):
        own = order[:count]
        at = starts[own] + place
        total = held[own] + info[at]
        full = total >= least[own]
        held[own] = np.where(full, 0.0, total)
        closed[own] += full
        so_far[at] = closed[own]
    return closed, so_far


def telling_spans(info: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Patterns of many texts at once: the text of each, and its first word and the one after its last.

    Each text (none may be empty) is cut into ``most_edits + 1`` spans so that the one that holds the least
    information holds as much as it can; the bound is found by halving. A pattern is the most telling
    PATTERN_WORDS words of a span, or the span if it has no more.
    """
    info = info + 1e-6
    n = np.diff(starts)
    parts = most_edits(n) + 1
    reached = np.concatenate(([0.0], np.cumsum(info)))
    least, most = np.zeros(len(n)), (reached[starts[1:]] - reached[starts[:-1]]) / parts
    for _ in range(7):
        middle = (least + most) / 2
        enough = _packed(info, starts, middle)[0] >= parts
        least, most = np.where(enough, middle, least), np.where(enough, most, middle)
    _, closed = _packed(info, starts, least)
    owner = np.repeat(np.arange(len(n)), parts)
    j = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts) + 1  # 1 to parts within each text
    closing = np.flatnonzero(np.diff(closed, prepend=0) * (np.arange(len(info)) != np.repeat(starts[:-1], n)) + (np.arange(len(info)) == np.repeat(starts[:-1], n)) * closed)
    text = np.repeat(np.arange(len(n)), n)[closing]
    use = closed[closing] <= parts[text]
    ends = closing[use] + 1
    ends = np.where(j == parts[owner], starts[1:][owner], ends)
    begins = np.where(j == 1, starts[:-1][owner], np.r_[0, ends[:-1]])
    size = np.minimum(ends - begins, PATTERN_WORDS)
    long = np.flatnonzero(ends - begins > PATTERN_WORDS)
    if len(long):
        choices = (ends - begins)[long] - PATTERN_WORDS + 1
        first = np.cumsum(choices) - choices
        at = np.arange(choices.sum()) - np.repeat(first, choices) + np.repeat(begins[long], choices)
        total = reached[at + PATTERN_WORDS] - reached[at]
        best = np.flatnonzero(total == np.repeat(np.maximum.reduceat(total, first), choices))
        of = np.repeat(np.arange(len(long)), choices)[best]
        begins[long[of[::-1]]] = at[best[::-1]]  # reversed, so that the first of several stays
    return owner, begins, begins + size


def _patterns(ones: np.ndarray, pairs: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = _Numbered()
        for batch in batches:
            if not batch.num_rows:
                continue
            flat, starts = _flat_numbers([t.split(" ") for t in batch.column("text").to_pylist()], number)
            owner, a, b = telling_spans(information(flat, starts, ones, pairs), starts)
            offsets = pa.array(np.searchsorted(owner, np.arange(batch.num_rows + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array((x - starts[owner]).astype(np.int32))) for x in (a, b)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("key", "key2", "n", "text")), *lists], ["key", "key2", "n", "text", "starts", "ends"])

    return run


def edits_within(a: list[str], b: list[str], most: int) -> int | None:
    """Words replaced, dropped or added between ``a`` and ``b``, or None if more than ``most``.

    Furthest-reaching points per diagonal: the time is that of the differences, not of the lengths' product.
    """
    n, m = len(a), len(b)
    if abs(n - m) > most:
        return None

    def slide(i: int, k: int) -> int:
        while i < n and i + k < m and a[i] == b[i + k]:
            i += 1
        return i

    reach = {0: slide(0, 0)}
    for d in range(most + 1):
        if reach.get(m - n, -1) >= n:
            return d
        after = {}
        for k in range(-d - 1, d + 2):
            i = max(reach.get(k, -2) + 1, reach.get(k - 1, -2), reach.get(k + 1, -2) + 1)
            if i >= 0 and (i := min(i, n, m - k)) >= 0:
                after[k] = slide(i, k)
        reach = after
    return None


def _marks(coded: list[str]) -> np.ndarray:
    """64 marks for each coded text, each of its words setting one."""
    letters = np.frombuffer("".join(coded).encode("utf-16-le"), np.uint16).reshape(-1, _PLACES).astype(np.uint64)
    sizes = np.fromiter(map(len, coded), np.int64, len(coded)) // _PLACES
    bits = np.uint64(1) << ((letters[:, 0] * np.uint64(31) + letters[:, 1]) % np.uint64(64))
    return np.bitwise_or.reduceat(bits, np.cumsum(sizes) - sizes) if len(coded) else np.zeros(0, np.uint64)


class _Shard:
    """Automaton over the patterns of one shard of evaluation texts."""

    def __init__(self, data: pa.Table):
        code = _Coded()
        self.keys = list(zip(data.column("key").to_pylist(), data.column("key2").to_pylist()))
        self.n, self.texts = data.column("n").to_numpy(), data.column("text").to_pylist()
        coded = ["".join(map(code.__getitem__, t.split(" "))) for t in self.texts]
        first = np.concatenate(([0], np.cumsum(pa.compute.list_value_length(data.column("starts")).to_numpy())))
        begins, ends = (pa.compute.list_flatten(data.column(c)).to_numpy() for c in ("starts", "ends"))
        owners = np.repeat(np.arange(len(coded)), np.diff(first))
        ids: dict[str, int] = {}
        patterns = [ids.setdefault(coded[o][a:b], len(ids)) for o, a, b in zip(owners.tolist(), (begins * _PLACES).tolist(), (ends * _PLACES).tolist())]
        automaton, known = ahocorasick.Automaton(), len(ids)
        for pattern, at in ids.items():
            automaton.add_word(pattern, at)
        self.marks = _marks(coded)
        if known:
            automaton.make_automaton()
        self.automaton = automaton
        order = np.argsort(np.asarray(patterns, np.int64), kind="stable")
        self.first = np.searchsorted(np.asarray(patterns, np.int64)[order], np.arange(known + 1)).astype(np.int32)
        self.owner, self.begin, self.end = (np.asarray(x, np.int32)[order] for x in (owners, begins, ends))

    def partners(self, held: list[tuple[int, int, str]], code: _Coded) -> Iterator[tuple[int, int, int, int, float]]:
        """Row, both keys, edits and merged coverage of every evaluation text that a held text nearly equals."""
        if not len(self.owner) or not held:
            return
        coded = ["".join(map(code.__getitem__, text.split(" "))) for _, _, text in held]
        sizes = np.fromiter(map(len, coded), np.int64, len(coded)) + 1
        starts = np.cumsum(sizes) - sizes
        found = np.array(list(self.automaton.iter("|".join(coded))), np.int64).reshape(-1, 2)
        of = np.searchsorted(starts, found[:, 0], side="right") - 1
        ends, patterns = (found[:, 0] + 1 - starts[of]) // _PLACES, found[:, 1]
        counts = self.first[patterns + 1] - self.first[patterns]
        marks, all_n = _marks(coded), np.fromiter((x[1] for x in held), np.int64, len(held))
        kept = []
        # a pattern that many texts share is gone through in slices, of which only the fitting places are held
        slice_of = (np.cumsum(counts) - counts) // MOST_PLACES
        heads = np.flatnonzero(np.r_[True, np.diff(slice_of) != 0]) if len(counts) else np.zeros(0, np.int64)
        for low, high in zip(heads.tolist(), np.r_[heads[1:], len(counts)].tolist()):
            c, text = counts[low:high], of[low:high]
            at = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c) + np.repeat(self.first[patterns[low:high]], c)
            own, text, place = self.owner[at], np.repeat(text, c), np.repeat(ends[low:high], c)
            n = all_n[text]
            edits = np.maximum(self.n[own], n) // EDIT_SHARE
            # an edit adds one word at most to either side, so it sets one mark at most that the other text lacks
            fits = (np.abs(self.n[own] - n) <= edits) & (np.abs(place - self.end[at]) <= edits)
            fits &= (np.bitwise_count(marks[text] & ~self.marks[own]) <= edits) & (np.bitwise_count(self.marks[own] & ~marks[text]) <= edits)
            kept.append((at[fits], own[fits], text[fits]))
        if not kept:
            return
        at, own, of = (np.concatenate(x) for x in zip(*kept))
        order = np.lexsort((self.begin[at], own, of))
        at, own, of = at[order], own[order], of[order]
        heads = np.flatnonzero(np.r_[True, (np.diff(own) != 0) | (np.diff(of) != 0)]) if len(at) else []
        for head, after in zip(heads, [*heads[1:], len(at)]):
            row_id, size, text = held[of[head]]
            theirs, mine = self.texts[own[head]].split(" "), text.split(" ")
            most = max(size, len(theirs)) // EDIT_SHARE
            if len(set(mine).difference(theirs)) > most or len(set(theirs).difference(mine)) > most:
                continue
            if (d := edits_within(theirs, mine, most)) is not None:
                covered, reached = 0, 0
                for a, b in zip(self.begin[at[head:after]].tolist(), self.end[at[head:after]].tolist()):
                    covered += max(0, b - max(a, reached))
                    reached = max(reached, b)
                yield row_id, *self.keys[own[head]], d, covered / len(theirs)


_ready: dict[str, _Shard] = {}


def _shard(uri: str) -> _Shard:
    """The shard of a worker; kept for its next task, one at a time."""
    if uri not in _ready:
        _ready.clear()
        fs, path = pa.fs.FileSystem.from_uri(uri)
        _ready[uri] = _Shard(pa.parquet.read_table(path, filesystem=fs))
    return _ready[uri]


_HIT = pa.schema([("row_id", pa.int64()), ("key", pa.int64()), ("key2", pa.int64()), ("edits", pa.int32()), ("coverage", pa.float64())])


def _hits(uri: str, batch: pa.RecordBatch, code: _Coded) -> Iterator[pa.RecordBatch]:
    """Partners of a batch's texts in the shard at ``uri``."""
    for part in (batch.slice(i, 5000) for i in range(0, batch.num_rows, 5000)):
        held = list(zip(*(part.column(c).to_pylist() for c in ("row_id", "n", "text"))))
        rows = list(_shard(uri).partners(held, code))
        columns = list(zip(*rows)) if rows else [[]] * len(_HIT)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _HIT)], schema=_HIT)


def _scan(uri: str):
    """Texts -> their partners in the shard at ``uri``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = _Coded()
        for batch in batches:
            yield from _hits(uri, batch, code)

    return run


def _scan_own(uris: list[str]):
    """Texts, each with the ``shard`` that it is sent to and in order of these -> their partners."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = _Coded()
        for batch in batches:
            shards = batch.column("shard").to_numpy()
            heads = np.flatnonzero(np.diff(shards, prepend=-1)).tolist()
            for a, b in zip(heads, [*heads[1:], len(shards)]):
                yield from _hits(uris[shards[a]], batch.slice(a, b - a), code)

    return run


def _grams(flat: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each number of words in a pattern: it, the places where so many words stand in one text, and their hashes."""
    with np.errstate(over="ignore"):
        x = (flat + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        left = np.repeat(starts[1:], np.diff(starts)) - np.arange(len(flat))
        h = x
        for size in range(1, PATTERN_WORDS + 1):
            if size > 1:
                h = h[:-1] * np.uint64(0xD6E8FEB86659FD93) + x[size - 1 :]
            at = np.flatnonzero(left[: len(h)] >= size)
            own = (h[at] ^ np.uint64(size)) * np.uint64(0xFF51AFD7ED558CCD)
            yield size, at, own ^ (own >> np.uint64(32))


def _word_marks(flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """64 marks for each text (none may be empty), each of its words setting one."""
    return np.bitwise_or.reduceat(np.uint64(1) << (flat % np.uint64(64)), starts[:-1])


def _routes(shard_of: dict[str, int]):
    """Patterns of shards -> their hashes, with the length and marks of their text and the place of their end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = _Numbered()
        for batch in batches:
            if not batch.num_rows:
                continue
            shards = np.array([shard_of[u] for u in batch.column("uri").to_pylist()], np.int32)
            flat, starts = _flat_numbers([t.split(" ") for t in batch.column("text").to_pylist()], number)
            of = np.repeat(np.arange(batch.num_rows), pa.compute.list_value_length(batch.column("starts")).to_numpy())
            begins, ends = (pa.compute.list_flatten(batch.column(c)).to_numpy() for c in ("starts", "ends"))
            marks, n, first = _word_marks(flat, starts).view(np.int64), np.diff(starts).astype(np.int32), starts[of] + begins
            for size, at, hashes in _grams(flat, starts):
                use = np.flatnonzero(ends - begins == size)
                own = hashes[np.searchsorted(at, first[use])].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (shards[of[use]], own, n[of[use]], ends[use].astype(np.int32), marks[of[use]])], ["shard", "hash", "own_n", "end", "own_marks"])

    return run


class _Filter:
    """Tells of hashes whether a pattern may have them: two bits each."""

    def __init__(self, most: int):
        self.shift = np.uint64(64 - max(16, math.ceil(math.log2(FILTER_BITS * max(1, most)))))
        self.bits = np.zeros(1 << (61 - int(self.shift)), np.uint8)

    def _places(self, hashes: np.ndarray) -> Iterator[np.ndarray]:
        with np.errstate(over="ignore"):
            yield hashes >> self.shift
            yield (hashes * np.uint64(0x9E3779B97F4A7C15)) >> self.shift

    def add(self, hashes: np.ndarray) -> None:
        for at in self._places(hashes):
            np.bitwise_or.at(self.bits, at >> np.uint64(3), np.left_shift(np.uint8(1), (at & np.uint64(7)).astype(np.uint8)))

    def has(self, hashes: np.ndarray) -> np.ndarray:
        own = np.arange(len(hashes))
        for at in self._places(hashes):
            own = own[(self.bits[at[own] >> np.uint64(3)] >> (at[own] & np.uint64(7)).astype(np.uint8)) & 1 == 1]
        return own


_filters: dict[tuple[str, int], _Filter] = {}


def _filter(uri: str, band: int, sizes: list[tuple[int, int, int]]) -> _Filter:
    """The filter of all patterns that a text of a band of lengths may have; kept for a worker's next task, one at a time."""
    if (uri, band) not in _filters:
        _filters.clear()
        low, high = int(BAND**band) - 1, int(BAND ** (band + 1)) + 1
        low, high = low - low // EDIT_SHARE - 1, high + most_edits(high) + 1
        made = _Filter(sum(count for a, b, count in sizes if a <= high and b >= low))
        fs, path = pa.fs.FileSystem.from_uri(uri)
        table = pa.dataset.dataset(path, filesystem=fs, format="parquet")
        for batch in table.to_batches(columns=["hash"], filter=(pa.dataset.field("own_n") <= high) & (pa.dataset.field("own_n") >= low), batch_readahead=1, fragment_readahead=1):
            made.add(batch.column(0).to_numpy().view(np.uint64))
        _filters[uri, band] = made
    return _filters[uri, band]


def _own_grams(uri: str, sizes: list[tuple[int, int, int]]):
    """Texts -> their runs of words that may be a pattern, with the place of the end, by the filter of their length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = _Numbered()
        for batch in batches:
            n = batch.column("n").to_numpy()
            bands = np.floor(np.log(n) / math.log(BAND)).astype(int)
            for band in np.unique(bands).tolist():
                own = batch.filter(pa.array(bands == band))
                flat, starts = _flat_numbers([t.split(" ") for t in own.column("text").to_pylist()], number)
                text, made = np.repeat(np.arange(own.num_rows), np.diff(starts)), _filter(uri, band, sizes)
                marks = pa.array(_word_marks(flat, starts).view(np.int64))
                for size, at, hashes in _grams(flat, starts):
                    kept = made.has(hashes)
                    place, of = at[kept], text[at[kept]]
                    yield pa.RecordBatch.from_arrays([own.column("row_id").take(pa.array(of)), own.column("n").take(pa.array(of)), pa.array(hashes[kept].view(np.int64)), pa.array((place + size - starts[of]).astype(np.int32)), marks.take(pa.array(of))], ["row_id", "n", "hash", "place", "marks"])

    return run


def _sent(training: DataFrame, shards: DataFrame, ranges: list, scratch: Scratch) -> DataFrame:
    """Each training text with the shards that hold one of its runs of words as a pattern of a text that it can fit.

    A pair within the edits has a pattern unaltered, and passes the tests of length, place and marks that ``partners``
    makes too, so no pair is lost."""
    shard_of = {r.uri: i for i, r in enumerate(ranges)}
    routes = scratch.keep(shards.select(F.input_file_name().alias("uri"), "text", "starts", "ends").mapInArrow(_routes(shard_of), "shard int, hash long, own_n int, end int, own_marks long"))
    sizes = [(r.low, r.high, r.n) for r in routes.groupBy("shard").agg(F.min("own_n").alias("low"), F.max("own_n").alias("high"), F.count("*").alias("n")).collect()]
    runs = training.mapInArrow(_own_grams(scratch.path(routes), sizes), "row_id long, n int, hash long, place int, marks long")
    most = F.expr(f"greatest(n, own_n) div {EDIT_SHARE}")
    fits = (F.abs(F.col("n") - F.col("own_n")) <= most) & (F.abs(F.col("place") - F.col("end")) <= most)
    lacks = lambda a, b: F.bit_count(F.col(a).bitwiseAND(F.bitwise_not(b))) <= most
    own = runs.join(routes, "hash").where(fits & lacks("marks", "own_marks") & lacks("own_marks", "marks")).select("row_id", "shard").distinct()
    return scratch.keep(training.join(own, "row_id"))


def _with_members(hits: DataFrame, members: DataFrame, classes: DataFrame) -> DataFrame:
    """``hits`` joined to the rows of their class of equal texts; a class with much of the rows is split in parts."""
    key = ["key", "key2"]
    total = classes.agg(F.sum("n_rows")).first()[0] or 0
    limit = max(HOT_ROWS, total // MOST_HOT)
    hot = [(r.key, r.key2) for r in classes.where(F.col("n_rows") > limit).select(*key).collect()] if total > limit else []
    if not hot:
        return hits.join(members, key)
    is_hot = reduce(lambda a, b: a | b, ((F.col("key") == k) & (F.col("key2") == k2) for k, k2 in hot))
    split = members.where(is_hot).withColumn("part", F.pmod("eval_id", F.lit(HOT_PARTS)).cast("int"))
    copied = hits.where(is_hot).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(HOT_PARTS - 1))))
    return hits.where(~is_hot).join(members.where(~is_hot), key).unionByName(copied.join(split, [*key, "part"]).drop("part"))


def cross_split_pairs(df: DataFrame, scratch: Scratch, id_column: str = "row_id", tokens: str = "tokens", split: str = "split") -> DataFrame:
    """``train_id, eval_id, edits, coverage`` of every training and evaluation row whose words nearly agree.

    Of the longer row's words at most one in EDIT_SHARE is replaced, misspelt, dropped or added; ``coverage``
    is the share of the evaluation row's words inside matched patterns. Rows without words or split give no
    row; equal evaluation texts (by two hashes of 64 bits) are searched once and joined back by their class, so a
    large group of copies costs no more than its pairs. Training texts are laid out by their number of words. An empty table, or one without either side, gives an empty result.
    """
    spark = df.sparkSession
    side = F.lower(F.trim(F.regexp_replace(F.col(split), "[\\s\\u00a0]+", " ")))
    known = df.where(F.col(tokens).isNotNull() & side.isin(*TRAINING, *EVALUATION)).select(F.col(id_column).alias("row_id"), side.isin(*TRAINING).alias("training"), F.concat_ws(" ", tokens).alias("joined"))
    rows = scratch.keep(known.mapInArrow(_prepare, "row_id long, training boolean, n int, text string"))
    blocks = rows.where("n < 0").select(F.col("row_id").alias("block"), "text").repartition(8, "block").mapInArrow(_added, "block long, counts array<long>").toArrow()
    counts = np.zeros((2 * COUNTERS // COUNTER_BLOCK, COUNTER_BLOCK), np.int64)  # of one size, whatever the input's
    for block, own in zip(blocks.column("block").to_pylist(), blocks.column("counts").to_pylist()):
        counts[block] = own
    texts = rows.where("n > 0")
    evaluation = texts.where("not training").withColumns({"key": F.xxhash64("text"), "key2": F.xxhash64("text", F.lit(1))})
    classes = scratch.keep(evaluation.groupBy("key", "key2").agg(F.first("n").alias("n"), F.first("text").alias("text"), F.count("*").alias("n_rows")))
    n_patterns = classes.agg(F.sum(F.expr(f"n div {EDIT_SHARE - 1} + 1"))).first()[0] or 0
    n_training = texts.where("training").count()
    if not n_patterns or not n_training:
        return spark.createDataFrame([], "train_id long, eval_id long, edits int, coverage double")
    n_shards = math.ceil(n_patterns / SHARD_PATTERNS)
    shards = scratch.keep(classes.select("key", "key2", "n", "text").repartitionByRange(n_shards, "n", "key").mapInArrow(_patterns(*counts.reshape(2, -1)), "key long, key2 long, n int, text string, starts array<int>, ends array<int>"))
    # shards hold texts of neighbouring lengths: each is scanned by the training texts whose length can fit only
    ranges = shards.groupBy(F.input_file_name().alias("uri")).agg(F.min("n").alias("low"), F.max("n").alias("high")).orderBy("low", "uri").collect()
    training = texts.where("training").select("row_id", "n", "text")
    if len(ranges) > 1:
        # a file holds a task's texts; where none of them can fit a shard, it is passed over by its statistics
        training = scratch.keep(training.repartitionByRange(math.ceil(n_training / TASK_TEXTS), "n", "row_id").sortWithinPartitions("n"))
    hit = "row_id long, key long, key2 long, edits int, coverage double"
    if len(ranges) > MOST_BRANCHES:
        sent = _sent(training, shards, ranges, scratch)
        laid = sent.repartitionByRange(len(ranges), "shard", "row_id").sortWithinPartitions("shard")
        hits = scratch.keep(laid.mapInArrow(_scan_own([r.uri for r in ranges]), hit))
    else:
        hits = scratch.keep(reduce(DataFrame.unionByName, (training.where(F.col("n").between(r.low - r.low // EDIT_SHARE - 1, r.high + most_edits(r.high) + 1)).mapInArrow(_scan(r.uri), hit) for r in ranges)))
    members = evaluation.select("key", "key2", F.col("row_id").alias("eval_id"))
    return _with_members(hits, members, classes.select("key", "key2", "n_rows")).select(F.col("row_id").alias("train_id"), "eval_id", "edits", "coverage")
