"""Occurrences and record counts of every distinct value, from compressed record bitmaps (problem 3).

Vertical layout: each task keeps, per term, the identifiers of its records and a counter of occurrences.
The identifiers leave the task as sorted offsets, or as a bitmap where a block of 65,536 identifiers holds
more than 4,096 of them. The shuffle brings the pieces of one term and identifier range together, they are
united, and the number of records is the cardinality of the union.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

#: Identifiers in one range: 2 ** 24. A term's bitmap is split into ranges, so no task holds more than one of them.
RANGE_BITS = 24
#: Identifiers in one block, and the most of them that are kept as offsets.
BLOCK_BITS, MOST_OFFSETS = 16, 4096
#: Pairs of term and record that a task holds before it hands them on, and spellings that it knows by then.
HELD, MOST_NAMES = 3_000_000, 1_000_000
_PIECES = "field_name string, term string, part long, occurrences long, block long, bits binary"


def normal_term(value: str | None) -> str:
    """NFC, without white space of any kind at the ends, lower case; empty for null."""
    return "" if value is None else unicodedata.normalize("NFC", value).strip().lower()


def _binary(lengths: np.ndarray, data: bytes) -> pa.Array:
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


class _Vertical:
    """A task's terms, with the record identifiers and occurrences of each."""

    def __init__(self, field: str):
        self.field, self.known, self.names, self._id_of = field, {}, [], {}
        self.clear()

    def full(self) -> bool:
        return self.held > HELD or len(self.known) > MOST_NAMES

    def clear(self) -> None:
        if len(self.known) > MOST_NAMES:
            self.known, self.names, self._id_of = {}, [], {}
        self.terms, self.rows, self.counts, self.held = [], [], np.zeros(len(self.names), np.int64), 0

    def _term(self, raw: str | None) -> int:
        if (at := self.known.get(raw)) is None:
            name = normal_term(raw)
            at = -1 if not name else self._id_of.setdefault(name, len(self.names))
            if at == len(self.names):
                self.names.append(name)
            self.known[raw] = at
        return at

    def add(self, ids: np.ndarray, lists: pa.ListArray) -> None:
        parents = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
        coded = pc.list_flatten(lists).dictionary_encode(null_encoding="encode")
        here = np.fromiter(map(self._term, coded.dictionary.to_pylist()), np.int64, len(coded.dictionary))
        terms = here[coded.indices.to_numpy(zero_copy_only=False)] if len(here) else np.zeros(0, np.int64)
        used = terms >= 0
        terms, parents = terms[used], parents[used].astype(np.int64)
        if len(self.counts) < len(self.names):
            self.counts = np.pad(self.counts, (0, len(self.names) - len(self.counts)))
        self.counts += np.bincount(terms, minlength=len(self.names))
        pairs = np.unique(terms * len(ids) + parents) if len(ids) else terms
        self.terms.append((pairs // max(1, len(ids))).astype(np.int32))
        self.rows.append(ids[pairs % max(1, len(ids))])
        self.held += len(pairs)

    def pieces(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            terms, rows = np.concatenate(self.terms), np.concatenate(self.rows)
            order = np.lexsort((rows, terms))
            terms, rows = terms[order], rows[order]
            blocks = rows >> BLOCK_BITS
            starts = np.flatnonzero(np.r_[True, (np.diff(terms) != 0) | (np.diff(blocks) != 0)])
            sizes = np.diff(np.r_[starts, len(terms)])
            out_terms, out_blocks, lengths, data = [], [], [], []
            for at, size in ((s, n) for s, n in zip(starts[sizes > MOST_OFFSETS].tolist(), sizes[sizes > MOST_OFFSETS].tolist())):
                bits = np.zeros(1 << BLOCK_BITS, np.uint8)
                bits[rows[at : at + size] & ((1 << BLOCK_BITS) - 1)] = 1
                out_terms.append(int(terms[at])), out_blocks.append(int(blocks[at]))
                data.append(np.packbits(bits).tobytes()), lengths.append(len(data[-1]))
            sparse = np.repeat(sizes <= MOST_OFFSETS, sizes)
            terms, rows = terms[sparse], rows[sparse]
            first = np.asarray(out_terms, np.int32), np.asarray(out_blocks, np.int64) >> (RANGE_BITS - BLOCK_BITS), np.asarray(out_blocks, np.int64)
            parts = rows >> RANGE_BITS
            if len(terms):
                starts = np.flatnonzero(np.r_[True, (np.diff(terms) != 0) | (np.diff(parts) != 0)])
                sizes = np.diff(np.r_[starts, len(terms)]) * 4
                data.append((rows & ((1 << RANGE_BITS) - 1)).astype(np.uint32).tobytes())
                all_terms, all_parts = np.r_[first[0], terms[starts]], np.r_[first[1], parts[starts]]
                all_blocks, all_sizes = np.r_[first[2], np.full(len(starts), -1)], np.r_[np.asarray(lengths, np.int64), sizes]
            else:
                all_terms, all_parts, all_blocks, all_sizes = *first, np.asarray(lengths, np.int64)
            # a term's occurrences travel with the first of its pieces
            occurrences = np.zeros(len(all_terms), np.int64)
            seen, where = np.unique(all_terms, return_index=True)
            occurrences[where] = self.counts[seen]
            names = pa.array(self.names).take(pa.array(all_terms))
            batch = pa.RecordBatch.from_arrays([
                pa.array([self.field] * len(all_terms)), names, pa.array(all_parts.astype(np.int64)), pa.array(occurrences),
                pa.array(all_blocks.astype(np.int64)), _binary(all_sizes, b"".join(data))], ["field_name", "term", "part", "occurrences", "block", "bits"])
            yield from (batch.slice(i, 50_000) for i in range(0, batch.num_rows, 50_000))
        self.clear()


def _build(fields: list[str], id_column: str):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [_Vertical(f) for f in fields]
        for batch in batches:
            ids = batch.column(id_column).to_numpy(zero_copy_only=False).astype(np.int64)
            for one in held:
                one.add(ids, batch.column(one.field))
                if one.full():
                    yield from one.pieces()
        for one in held:
            yield from one.pieces()

    return build


def _offsets(bits: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets of each value and the bytes that they point into."""
    at = np.frombuffer(bits.buffers()[1], np.int32)[bits.offset : bits.offset + len(bits) + 1].astype(np.int64)
    return at, np.frombuffer(bits.buffers()[2], np.uint8) if bits.buffers()[2] is not None else np.zeros(0, np.uint8)


def _unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces sorted by field, term and range -> one row for each of these, with the size of the union."""
    schema = pa.schema([("field_name", pa.string()), ("term", pa.string()), ("occurrences", pa.int64()), ("rows", pa.int64())])
    left: pa.Table | None = None

    def united(t: pa.Table) -> pa.RecordBatch:
        b = t.combine_chunks().to_batches()[0]
        codes = [b.column(c).dictionary_encode().indices.to_numpy() for c in ("field_name", "term")] + [b.column("part").to_numpy()]
        new = np.r_[True, np.any([np.diff(c) != 0 for c in codes], axis=0)]
        group, starts = np.cumsum(new) - 1, np.flatnonzero(new)
        at, data = _offsets(b.column("bits"))
        block, sizes = b.column("block").to_numpy(), np.diff(at)
        lists = block < 0
        use = np.repeat(lists, sizes)
        members = [(np.repeat(group[lists], sizes[lists] // 4) << RANGE_BITS) | np.ascontiguousarray(data[at[0] : at[-1]][use]).view(np.uint32)]
        for i in np.flatnonzero(~lists):
            within = np.flatnonzero(np.unpackbits(data[at[i] : at[i + 1]]))
            members.append((group[i] << RANGE_BITS) | ((int(block[i]) << BLOCK_BITS) & ((1 << RANGE_BITS) - 1)) | within)
        union = np.unique(np.concatenate(members))
        rows = np.bincount(union >> RANGE_BITS, minlength=len(starts))
        occurrences = np.add.reduceat(b.column("occurrences").to_numpy(), starts)
        heads = b.take(pa.array(starts))
        return pa.RecordBatch.from_arrays([heads.column("field_name"), heads.column("term"), pa.array(occurrences), pa.array(rows)], schema=schema)

    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch]) if left is None else pa.concat_tables([left, pa.Table.from_batches([batch])])
        n, last = t.num_rows, [t.column(c)[t.num_rows - 1] for c in ("field_name", "term", "part")]
        same = pc.and_(pc.and_(pc.equal(t.column("field_name"), last[0]), pc.equal(t.column("term"), last[1])), pc.equal(t.column("part"), last[2]))
        cut = n - pc.sum(same).as_py()
        if cut:
            yield united(t.slice(0, cut))
        left = t.slice(cut)
    if left is not None and left.num_rows:
        yield united(left)


def term_counts(df: DataFrame, id_column: str, fields: list[str], rare_below: int = 3, common_above: float = 0.2) -> DataFrame:
    """``field_name, term, n_occurrences, n_rows, mark`` of every distinct term of the array columns ``fields``.

    ``mark`` is 'rare' for terms in fewer than ``rare_below`` rows, 'common' for those in more than
    ``common_above`` of all rows, else null. A row is a distinct ``id_column``. Null arrays hold no term but
    count as rows; null and blank elements count nowhere. An empty table gives an empty result.
    """
    total = df.count()
    pieces = df.select(id_column, *fields).where(F.col(id_column).isNotNull()).mapInArrow(_build(fields, id_column), _PIECES)
    counted = (
        pieces.repartition("field_name", "term", "part").sortWithinPartitions("field_name", "term", "part")
        .mapInArrow(_unite, "field_name string, term string, occurrences long, rows long")
        .groupBy("field_name", "term").agg(F.sum("occurrences").alias("n_occurrences"), F.sum("rows").alias("n_rows"))
    )
    mark = F.when(F.col("n_rows") < rare_below, "rare").when(F.col("n_rows") / max(total, 1) > common_above, "common")
    return counted.withColumn("mark", mark)
