"""Cutting oversized items at natural boundaries, with overlap (problem 5).

A hierarchy of separators (section, paragraph, sentence, clause, word, character) is gone down recursively:
what fits into a piece stays whole, what doesn't is split at the next weaker separators. The parts are then
packed greedily, in order, so no piece is shorter than its parts force it to be.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# Tokens after which a natural boundary lies, the stronger kind first.
SENTENCE_ENDS, CLAUSE_ENDS = frozenset(".!?"), frozenset(";:")
#: Words of a line between blank lines, without end mark, up to which it heads a section.
HEADING_WORDS = 8

_SECTION = re.compile(r"\n[^\S\n]*\n\s*(?=(?:\S+[^\S\n]+){0,%d}\S*[^\s.!?;:,。！？][^\S\n]*\n[^\S\n]*\n)" % (HEADING_WORDS - 1))
_PARAGRAPH, _LINE = re.compile(r"\n[^\S\n]*\n\s*"), re.compile(r"\n\s*")
_SENTENCE, _CLAUSE, _BLANK = re.compile(r"[.!?]+[\"'”’»)\]]*\s+|[。！？]+|[।॥]\s*"), re.compile(r"[;:,]\s+|[；：，、]"), re.compile(r"\s+")


def sentence_levels(tokens: list[str]) -> list[list[int]]:
    """Boundaries (as positions after a token) of a sentence row, from the strongest level to the weakest."""
    return [[i + 1 for i, t in enumerate(tokens) if t.strip() in ends] for ends in (SENTENCE_ENDS, CLAUSE_ENDS)]


def text_levels(text: str) -> list[list[int]]:
    """Boundaries of a text as character places: sections, paragraphs, lines, sentences, clauses and words."""
    return [[m.end() for m in pattern.finditer(text)] for pattern in (_SECTION, _PARAGRAPH, _LINE, _SENTENCE, _CLAUSE, _BLANK)]


def index_levels(indices: list[int | None]) -> list[list[int]]:
    """Boundaries where the sentence index changes; a null index counts as the last one given before it."""
    changes, last = [], next((i for i in indices if i is not None), None)
    for at, index in enumerate(indices):
        if index is not None and index != last:
            changes.append(at)
            last = index
    return [changes]


def layout_levels(tokens: list[str], changes: list[int], text: str | None) -> list[list[int]]:
    """Sentence boundaries told apart by the text's layout: those that open a section, those that open a paragraph, all.

    Without a text, or where the tokens aren't found in it in order, all are of one kind.
    """
    if not text or not changes:
        return [[], [], changes]
    at, starts = 0, []
    for t in tokens:
        word = t.strip()
        found = text.find(word, at)
        if found < 0:
            return [[], [], changes]
        starts.append(found)
        at = found + len(word)
    sections, paragraphs = ({m.end() for m in p.finditer(text)} for p in (_SECTION, _PARAGRAPH))
    return [[c for c in changes if starts[c] in own] for own in (sections, paragraphs)] + [changes]


def parts(start: int, end: int, levels: Sequence[Sequence[int]], room: int) -> Iterator[int]:
    """Ends of the parts of a stretch, in order: whole if it fits into ``room``, else split at the strongest level's
    boundaries, each stretch between them gone into by the weaker levels; without any, single units.

    ``levels`` are sorted lists of boundaries strictly within the stretch.
    """
    if end - start <= room:
        yield end
    elif not levels:
        yield from range(start + 1, end + 1)
    else:
        before = [0] * (len(levels) - 1)
        for stop in [*levels[0], end]:
            inner = []
            for k, own in enumerate(levels[1:]):
                low = before[k]
                while low < len(own) and own[low] <= start:
                    low += 1
                high = low
                while high < len(own) and own[high] < stop:
                    high += 1
                before[k] = high
                inner.append(own[low:high])
            yield from parts(start, stop, inner, room)
            start = stop


def cut(n: int, levels: Sequence[Sequence[int]], limit: int, overlap: int) -> tuple[list[tuple[int, int]], str]:
    """Pieces ``(start, end)`` of ``n`` units, and whether the item's natural boundaries suffice.

    Parts found recursively are packed greedily; a full piece ends at the last of the strongest boundaries in its
    second half, so it is never cut short for one. Each piece starts ``overlap`` units before the end of the one
    before, so it has room for ``limit - overlap`` new ones, the first for ``limit``. The kind is 'forced' if a
    stretch between neighbouring boundaries of any level, or the ends, exceeds ``limit``.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and less than limit")
    inner = [sorted({b for b in level if 0 < b < n}) for level in levels]
    strength = {b: k for k in range(len(inner) - 1, -1, -1) for b in inner[k]}
    ends = sorted({0, n, *strength})
    kind = "forced" if any(b - a > limit for a, b in zip(ends, ends[1:])) else "natural"
    pieces, done, room, held = [], 0, limit, []

    def close(end: int) -> None:
        nonlocal done, room, held
        pieces.append((max(0, done - overlap) if pieces else 0, end))
        done, room, held = end, limit - overlap, [e for e in held if e > end]

    for end in parts(0, n, inner, limit - overlap) if n else ():
        while end - done > room:
            late = [e for e in held if 2 * (e - done) >= room] or held[-1:]
            close(max(late, key=lambda e: (-strength.get(e, len(inner)), e)))
        held.append(end)
    if held:
        close(held[-1])
    return pieces, kind


def cut_text(text: str, limit: int, overlap: int = 0) -> list[str]:
    """Pieces of at most ``limit`` characters of a text, down to its words and, where one is longer, its characters."""
    return [text[a:b] for a, b in cut(len(text), text_levels(text), limit, overlap)[0]]


def _cutter(limit: int, overlap: int, indexed: bool):
    fields = "item_key string, piece_no int, start_token int, end_token int, cut_kind string, tokens array<string>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            data = [batch.column(c).to_pylist() for c in range(batch.num_columns)]
            for row in zip(*data):
                key, tokens = row[0], row[1]
                held = [i for i, t in enumerate(tokens) if t is not None and t.strip()]
                if len(held) <= limit:
                    continue
                words = [tokens[i] for i in held]
                if indexed:
                    last, filled = None, []
                    for index in row[2]:
                        last = last if index is None else index
                        filled.append(last)
                    levels = layout_levels(words, index_levels([filled[i] for i in held])[0], row[3])
                else:
                    levels = sentence_levels(words)
                cuts, kind = cut(len(held), levels, limit, overlap)
                rows += [(key, no, a, b, kind, words[a:b]) for no, (a, b) in enumerate(cuts)]
            names = [f.split()[0] for f in fields.split(", ")]
            types = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.list_(pa.string())]
            columns = list(zip(*rows)) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    return run, fields


def oversized_pieces(df: DataFrame, key: str, tokens: str, limit: int = 200, overlap: int = 20, sentence_index: str | None = None, text: str | None = None) -> DataFrame:
    """Pieces of every item with more than ``limit`` tokens: ``item_key, piece_no, start_token, end_token, cut_kind, tokens``.

    Null and blank tokens don't count and positions are those of the tokens that do. Boundaries come from
    ``sentence_index`` (an array beside the tokens) if given, else from the tokens themselves; with a ``text``, those
    that open its sections and paragraphs are the stronger ones. Items with null tokens, or with too few, give no
    row; only oversized arrays leave the JVM. Each item is cut on its own, without a shuffle. Dropping the first
    ``overlap`` tokens of every later piece gives the item back.
    """
    run, fields = _cutter(limit, overlap, sentence_index is not None)
    columns = [F.col(key).cast("string").alias("item_key"), F.col(tokens).alias("item_tokens")]
    if sentence_index:
        columns += [F.col(sentence_index).alias("item_index"), (F.col(text) if text else F.lit(None).cast("string")).alias("item_text")]
    return df.where(F.size(tokens) > limit).select(*columns).mapInArrow(run, fields)
