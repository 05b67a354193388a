"""Sentence boundaries by a linear-chain model over characters (problem 4).

Every character is tagged as the last of a sentence or as one inside it. Only characters before white space
or after an end mark can be last (the model gives all others no chance), so the chain runs over these:
end marks with what closes after them, line breaks, blanks in scripts without any between words, and every
character of ideographic texts that hold no end mark at all. Tags of a text are decoded together by Viterbi.
The model is a conditional random field, trained on all annotated documents with known sentences and all
texts of the collection, labelled by rules of typography, with the shortened words that a sentence goes on
after told by how the collection's words behave before a full stop. Texts in scripts that may lack end marks
are also used with these stripped, their true cuts as labels, and every text in capitals.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tagweave.llm import characters as C
from tagweave.llm.characters import Characters
from tagweave.plans.runtime import Scratch

#: Hashed features, and rounds of training.
WIDTH, ROUNDS = 1 << 16, 80
#: Weight in training of a text in capitals, and of an ideographic one with all end marks (and blanks) stripped. Annotated
#: documents together weigh so much of the texts, or of FEW texts, at most.
LOUD, STRIPPED, KNOWN, FEW = 0.1, 0.6, 0.2, 2500
#: Characters up to which a collection is trained on by the driver. Beyond, each round takes one of so many parts in turn.
LOCAL, PARTS = 4_000_000, 16
#: Splits of a part that a task of a round takes.
FILES = 3
#: Characters of the texts that make a block, and candidates of a text that are gone through at a time.
BLOCK, STRETCH = 1 << 20, 64
#: Occurrences before a full stop from which a word's behaviour counts, and the share after which the sentence goes on
#: from which it is a shortened word. The same for a word after a number and a full stop, against those that begin sentences.
LEAST_SEEN, GOES_ON_SHARE, AFTER_NUMBER = 3, 0.25, 2.0
#: Letters of a word up to which it may be a shortened one though a capital always follows it.
SHORT = 4
#: Tokens of a sentence in an annotated document from which its index is taken for damaged.
LONGEST = 80
_END_MARK, _BREAK, _BLANK = 0, 1, 2


@dataclass
class Candidates:
    """Places where a sentence may end. ``end`` and ``start`` are those of the gap between two sentences."""

    chars: Characters
    text: np.ndarray
    kind: np.ndarray
    mark: np.ndarray
    last_mark: np.ndarray
    end: np.ndarray
    start: np.ndarray
    newlines: np.ndarray
    quote: np.ndarray
    number_next: np.ndarray
    number_here: np.ndarray
    bare: np.ndarray
    weight: float = 1.0


NO_QUOTE, INSIDE, AFTER_COLON, AT_START, IN_MIDDLE = range(5)


def _forward(kinds: np.ndarray, at: np.ndarray, members: np.ndarray) -> np.ndarray:
    """The first place from each of ``at`` on whose class isn't in ``members``."""
    at = at.copy()
    moving = np.flatnonzero(members[kinds[at]])
    while len(moving):
        at[moving] += 1
        moving = moving[members[kinds[at[moving]]]]
    return at


def _classes(*which: int) -> np.ndarray:
    table = np.zeros(32, bool)
    table[list(which)] = True
    return table


_SPACES, _DIGITS, _MARKS = _classes(C.SPACE, C.NEWLINE), _classes(C.DIGIT), _classes(C.DOT, C.BANG, C.ELLIPSIS, C.CJK_END, C.DANDA)
_BEFORE_OPENING = _classes(C.EDGE, C.SPACE, C.NEWLINE, C.CJK, C.CJK_END, C.COLON, C.OPEN)
_OPENS_NEXT = _classes(C.UPPER, C.OPEN, C.QUOTE_OPEN)
_WORDLESS = _classes(C.EDGE, C.SPACE, C.NEWLINE, C.QUOTE_OPEN, C.QUOTE_EITHER, C.OPEN)


def _count(chars: Characters, mask: np.ndarray) -> np.ndarray:
    """How many characters of each text are in ``mask``."""
    bounds = [*chars.starts.tolist(), len(chars.kinds)]
    return np.fromiter((np.count_nonzero(mask[a:b]) for a, b in zip(bounds, bounds[1:])), np.int64, len(chars.starts))


def bare_texts(chars: Characters) -> np.ndarray:
    """Whether each text is mostly ideographic and holds no end mark; a point within a number is none."""
    out = 2 * _count(chars, chars.kinds == C.CJK) > chars.ends - chars.starts
    if out.any():
        mark, digit = _MARKS[chars.kinds], chars.kinds == C.DIGIT
        mark[1:-1] &= ~((chars.kinds[1:-1] == C.DOT) & digit[:-2] & digit[2:])
        out &= _count(chars, mark) == 0
    return out


def candidates(chars: Characters) -> Candidates:
    kinds, codes = chars.kinds, chars.codes
    edge = len(kinds) - 1
    # end marks, with what closes after them
    is_mark = _MARKS[kinds]
    last = np.flatnonzero(is_mark[:-1] & ~is_mark[1:])
    first = np.flatnonzero(is_mark[1:] & ~is_mark[:-1]) + 1
    end, wide = last + 1, kinds[last] == C.CJK_END
    closing = _classes(C.CLOSE, C.QUOTE_CLOSE)
    had_quote = np.zeros(len(end), bool)
    for _ in range(4):
        here = kinds[end]
        either = (here == C.QUOTE_EITHER) & ~wide
        spaced = (here == C.SPACE) & (codes[np.minimum(end + 1, edge)] == 0xBB)  # a blank before a French closing mark
        step = np.where(spaced, 2, closing[here] | either)
        had_quote |= (here == C.QUOTE_CLOSE) | either | spaced
        end = np.minimum(end + step, edge)
        if not step.any():
            break
    start = _forward(kinds, end, _SPACES)
    before = kinds[first - 1]
    glued = (start == end) & (kinds[end] != C.EDGE)
    joined = glued & ~wide & (kinds[last] != C.DANDA)
    may = ~joined | (_OPENS_NEXT[kinds[end]] & ((before == C.LOWER) | (before == C.LETTER) | (end > last + 1) | (before == C.CLOSE)))
    may &= (kinds[start] != C.EDGE) & (before != C.EDGE)
    first, last, end, start, had_quote = first[may], last[may], end[may], start[may], had_quote[may]
    # gaps without an end mark: line breaks and, beside Thai, blanks
    is_space = _SPACES[kinds]
    gap_from = np.flatnonzero(is_space[1:] & ~is_space[:-1]) + 1
    gap_to = np.flatnonzero(is_space[:-1] & ~is_space[1:]) + 1
    newline_at = np.flatnonzero(kinds == C.NEWLINE)
    lines = lambda a, b: np.searchsorted(newline_at, b) - np.searchsorted(newline_at, a)
    thai = (kinds[gap_from - 1] == C.THAI) | (kinds[gap_to] == C.THAI) | (kinds[gap_from - 1] == C.CJK) & (kinds[gap_to] == C.CJK)
    broken = (gap_to - gap_from > 1) | (kinds[gap_from] == C.NEWLINE)
    broken[broken] = lines(gap_from[broken], gap_to[broken]) > 0
    other = (broken | thai) & (kinds[gap_from - 1] != C.EDGE) & (kinds[gap_to] != C.EDGE)
    gap_from, gap_to, thai = gap_from[other], gap_to[other], thai[other]
    other = ~np.isin(gap_from, end) & ~(is_mark[gap_from - 1] & np.isin(gap_from - 1, last))
    gap_from, gap_to, thai = gap_from[other], gap_to[other], thai[other]
    # ideographic texts without any end mark: every character may be the last one
    bare = bare_texts(chars)
    if bare.any():
        inside = np.flatnonzero((kinds[:-1] == C.CJK) & (kinds[1:] == C.CJK)) + 1
        inside = inside[bare[np.searchsorted(chars.starts, inside, side="right") - 1]]
        gap_from, gap_to, thai = np.concatenate([gap_from, inside]), np.concatenate([gap_to, inside]), np.concatenate([thai, np.ones(len(inside), bool)])
    all_end = np.concatenate([end, gap_from])
    order = np.argsort(all_end, kind="stable")
    join = lambda a, b: np.concatenate([a, b])[order]
    kind = join(np.zeros(len(end), np.int8), np.where(thai, _BLANK, _BREAK).astype(np.int8))
    end, start_, mark, last = all_end[order], join(start, gap_to), join(first, gap_from), join(last, gap_from)
    had_quote = join(had_quote, np.zeros(len(gap_from), bool))
    text = np.searchsorted(chars.starts, end, side="right") - 1
    # quotations
    quotes = np.flatnonzero((kinds == C.QUOTE_OPEN) | (kinds == C.QUOTE_CLOSE) | (kinds == C.QUOTE_EITHER))
    opens = (kinds[quotes] == C.QUOTE_OPEN) | ((kinds[quotes] == C.QUOTE_EITHER) & _BEFORE_OPENING[kinds[quotes - 1]])
    opened, closed = quotes[opens], quotes[~opens]
    quote = np.zeros(len(end), np.int8)
    if len(opened):
        k = np.searchsorted(opened, mark) - 1
        o = np.where(k >= 0, opened[np.maximum(k, 0)], 0)
        c = np.searchsorted(closed, mark) - 1
        c = np.where(c >= 0, closed[np.maximum(c, 0)], 0) if len(closed) else np.zeros(len(end), np.int64)
        near = (o >= chars.starts[text]) & (mark - o < 400) & (o > c)
        back = o - 1
        for _ in range(3):
            back = np.where(_SPACES[kinds[back]], back - 1, back)
        b = kinds[np.maximum(back, 0)]
        fresh = _MARKS[b] | (b == C.EDGE) | (b == C.CLOSE) | (b == C.QUOTE_CLOSE) | (b == C.QUOTE_EITHER)
        how = np.where(b == C.COLON, AFTER_COLON, np.where(fresh, AT_START, IN_MIDDLE))
        quote = np.where(near, np.where(had_quote, how, INSIDE), np.where(had_quote, IN_MIDDLE, NO_QUOTE)).astype(np.int8)
    # numbers of list items: digits, a full stop or bracket and a blank
    past = _forward(kinds, start_, _DIGITS)
    number_next = (past > start_) & ((codes[past] == 0x2E) | (codes[past] == 0x29)) & _SPACES[kinds[np.minimum(past + 1, edge)]]
    number_here = np.zeros(len(end), bool)
    number_here[1:] = number_next[:-1] & (mark[1:] == past[:-1]) & (kind[1:] == _END_MARK)
    begin = _forward(kinds, chars.starts, _SPACES)
    begun = _forward(kinds, begin, _DIGITS)
    from_start = (begun > begin)[text] & (mark == begun[text]) & (kind == _END_MARK)
    return Candidates(chars, text, kind, mark, last, end, start_, lines(end, start_), quote, number_next, number_here | from_start, bare)


def _token(chars: Characters, at: np.ndarray, step: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the lower-cased token from ``at`` on in the direction ``step``, up to white space, and its length."""
    h, size, live = np.zeros(len(at), np.uint64), np.zeros(len(at), np.int64), np.arange(len(at))
    here = at.copy()
    for _ in range(most):
        kind = chars.kinds[here[live]]
        live = live[~_WORDLESS[kind] if step < 0 else ~_SPACES[kind] & (kind != C.EDGE)]
        if not len(live):
            break
        h[live] = (h[live] ^ chars.lower(here[live])) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)
        size[live] += 1
        here[live] += step
    return h, size


def _mix(*parts) -> np.ndarray:
    h = np.uint64(0xCBF29CE484222325)
    for p in parts:
        h = (h ^ np.asarray(p).astype(np.uint64)) * np.uint64(0xFF51AFD7ED558CCD)
        h = h ^ (h >> np.uint64(29))
    return h


def shout(chars: Characters) -> np.ndarray:
    """Whether each text is all in capitals."""
    return _count(chars, chars.kinds == C.UPPER) > 8 * _count(chars, chars.kinds == C.LOWER) + 10


def features(c: Candidates) -> np.ndarray:
    """Hashed features of every candidate, a column for each template."""
    with np.errstate(over="ignore"):
        kinds = c.chars.kinds
        before, before_size = _token(c.chars, c.mark - 1, -1, 10)
        begin, further = c.chars.starts[c.text], c.mark - 2 - before_size
        two_before, _ = _token(c.chars, np.where(further >= begin, further, 0), -1, 8)  # never that of the text before
        suffix = np.zeros(len(c.end), np.uint64)
        for k in range(1, 6):
            at = np.where(c.mark - k >= begin, c.mark - k, 0)
            suffix = _mix(suffix, np.where(_SPACES[kinds[at]], 32, c.chars.lower(at)))
        after, _ = _token(c.chars, c.start, 1, 8)
        end_code = np.where(c.kind == _END_MARK, c.chars.codes[c.last_mark], 0)
        several = np.minimum(c.last_mark - c.mark, 3)
        nxt, second = kinds[c.start], kinds[np.minimum(c.start + 1, len(kinds) - 1)]
        prev = kinds[c.mark - 1]
        gap = np.where(c.start == c.end, 0, np.where(c.newlines == 0, 1, np.minimum(c.newlines, 2) + 1))
        loud, bare = shout(c.chars)[c.text], c.bare[c.text]
        spaced = _SPACES[prev]
        base = _mix(c.kind, end_code, several)
        mixed_case = (nxt == C.LOWER) & (second == C.UPPER)
        place = lambda h: ((h >> np.uint64(20)) % np.uint64(WIDTH)).astype(np.uint16)
        own = lambda *parts: place(_mix(*parts))
        columns = [
            place(base), own(1, base, nxt, loud, mixed_case), own(2, before, nxt, gap == 0), own(3, before), own(4, suffix, nxt),
            own(5, after), own(6, c.quote, nxt, base), own(7, gap, c.kind, nxt, c.number_next), own(8, c.number_here, base),
            own(9, prev, nxt, base), own(10, np.minimum(before_size, 6), nxt, base), own(11, spaced, several, end_code, nxt, loud),
            own(12, before, after), own(13, c.quote, prev, gap, loud), own(14, suffix, loud),
            own(15, c.quote), own(16, c.quote, end_code), own(17, c.number_here, prev == C.DIGIT, np.minimum(before_size, 3), nxt), own(18, np.minimum(c.newlines, 2)),
            own(19, prev == C.DIGIT, after), own(20, prev == C.DIGIT, two_before, nxt), own(21, c.kind, bare, prev, nxt, gap),
        ]
        return np.stack(columns, 1)


def _steps(text: np.ndarray, n_texts: int) -> Iterator[np.ndarray]:
    """Candidates of the first, second, ... place of each text, texts with the most candidates first."""
    count = np.bincount(text, minlength=n_texts)
    first = np.cumsum(count) - count
    order = np.argsort(-count, kind="stable")
    for place in range(int(count.max(initial=0))):
        order = order[: np.searchsorted(-count[order], -place, side="left")]
        yield first[order] + place


def _distance(c: Candidates) -> np.ndarray:
    """How far a candidate is from the one before it, in three steps."""
    gap = c.end - np.r_[0, c.start[:-1]]
    return np.where(gap <= 4, 0, np.where(gap <= 14, 1, 2))


class Model:
    """Weights of the features, and of pairs of neighbouring tags by distance."""

    def __init__(self, weights: np.ndarray, pairs: np.ndarray):
        self.weights, self.pairs = weights, pairs

    def decode(self, c: Candidates) -> np.ndarray:
        """Viterbi: the best tags of each text's candidates, true for boundaries."""
        n = len(c.end)
        score = self.weights[features(c)].sum(1) + 30.0 * (c.newlines >= 2) if n else np.zeros(0)  # a blank line always ends a sentence
        far, came = _distance(c), np.zeros((n, 2), bool)
        best = np.zeros((n, 2))
        steps = list(_steps(c.text, len(c.chars.starts)))
        for k, at in enumerate(steps):
            if k == 0:
                best[at, 1] = score[at]
                continue
            pairs, old = self.pairs[far[at]], best[at - 1]
            for tag in (0, 1):
                stay, move = old[:, 0] + pairs[:, 0, tag], old[:, 1] + pairs[:, 1, tag]
                came[at, tag] = move > stay
                best[at, tag] = np.maximum(stay, move) + tag * score[at]
        tags = np.zeros(n, bool)
        count = np.bincount(c.text, minlength=len(c.chars.starts))
        ends = np.cumsum(count) - 1
        tags[ends[count > 0]] = best[ends[count > 0], 1] > best[ends[count > 0], 0]
        for at in reversed(steps[1:]):
            tags[at - 1] = came[at, tags[at].astype(int)]
        return tags


@dataclass
class Chains:
    """Candidates of many texts for training, in stretches of at most STRETCH: the first ones of all stretches, then the second
    ones, ..., stretches with the most first. ``before`` is the stretch that one goes on from, ``level`` how many come before it."""

    weight: float
    sizes: np.ndarray
    level: np.ndarray
    before: np.ndarray
    features: np.ndarray
    far: np.ndarray
    labels: np.ndarray


_STORED = {"sizes": np.int32, "level": np.int32, "before": np.int32, "features": np.uint16, "far": np.uint8, "labels": np.uint8}


def chains(c: Candidates, labels: np.ndarray) -> Chains:
    count = np.bincount(c.text, minlength=len(c.chars.starts))
    place = np.arange(len(c.text)) - (np.cumsum(count) - count)[c.text]
    stretch = np.cumsum(place % STRETCH == 0) - 1
    steps = list(_steps(stretch, int(stretch[-1]) + 1 if len(stretch) else 0))
    order, first = (np.concatenate(steps), steps[0]) if steps else (np.zeros(0, int), np.zeros(0, int))
    level, rank = place[first] // STRETCH, np.argsort(stretch[first])
    before = np.where(level > 0, rank[stretch[first] - 1], -1)
    given = {"sizes": [len(x) for x in steps], "level": level, "before": before, "features": features(c)[order].T, "far": _distance(c)[order], "labels": labels[order]}
    return Chains(c.weight, **{k: np.array(x, _STORED[k], order="C") for k, x in given.items()})


def gradient(x: Chains, w: np.ndarray, pairs: np.ndarray, total: np.ndarray) -> None:
    """Adds the gradient of the negative log likelihood, by weights and then by pairs, and the number of candidates; all weighted.

    Forward and backward messages are held as the odds of a boundary. Those between stretches of one text come first, by the
    product of each stretch's steps, so that no text is gone through one candidate at a time.
    """
    n, m = len(x.labels), len(x.level)
    if not n:
        return
    score = np.zeros(n)
    for column in x.features:
        score += w.take(column, mode="clip")
    odds = np.exp(np.clip(score, -250, 250))
    p00, p01, p10, p11 = p = [p[x.far] for p in np.exp(pairs).reshape(3, 4).T.copy()]
    for own in p:  # a text's first candidate depends on none
        own[:m][x.level == 0] = 1
    at = np.r_[0, np.cumsum(x.sizes)].tolist()
    start, final = np.ones(m), np.ones(m)
    linked = np.flatnonzero(x.level)
    if len(linked):
        t01, t11 = p01 * odds, p11 * odds
        a, b, c, d = p00[:m].copy(), t01[:m].copy(), p10[:m].copy(), t11[:m].copy()
        for k in range(1, len(x.sizes)):
            here, size = slice(at[k], at[k + 1]), at[k + 1] - at[k]
            for left, right in ((a[:size], b[:size]), (c[:size], d[:size])):
                left[:], right[:] = left * p00[here] + right * p10[here], left * t01[here] + right * t11[here]
            scale = 1 / (a[:size] + b[:size] + c[:size] + d[:size])
            for own in (a, b, c, d):
                own[:size] *= scale
        by_level = np.split(np.argsort(x.level, kind="stable"), np.cumsum(np.bincount(x.level))[:-1])
        out = np.ones(m)
        for j, own in enumerate(by_level):
            if j:
                start[own] = out[x.before[own]]
            out[own] = (b[own] + d[own] * start[own]) / (a[own] + c[own] * start[own])
        for own in by_level[:0:-1]:
            final[x.before[own]] = (c[own] + d[own] * final[own]) / (a[own] + b[own] * final[own])
    last = np.array(at)[np.searchsorted(-x.sizes, -np.arange(m), side="left") - 1] + np.arange(m)
    ahead, back = odds.copy(), np.ones(n)
    back[last] = final
    ahead[:m] *= (p01[:m] + p11[:m] * start) / (p00[:m] + p10[:m] * start)
    for k in range(1, len(x.sizes)):
        here, size = slice(at[k], at[k + 1]), at[k + 1] - at[k]
        old = ahead[at[k - 1] : at[k - 1] + size]
        ahead[here] *= (p01[here] + p11[here] * old) / (p00[here] + p10[here] * old)
    for k in range(len(x.sizes) - 1, 0, -1):
        here, size = slice(at[k], at[k + 1]), at[k + 1] - at[k]
        new = odds[here] * back[here]
        back[at[k - 1] : at[k - 1] + size] = (p10[here] + p11[here] * new) / (p00[here] + p01[here] * new)
    off = x.weight * (1 / (1 + 1 / (ahead * back)) - x.labels)
    for column in x.features:
        np.add.at(total, column.astype(np.intp), off)
    follow = np.r_[linked, np.arange(m, n)]
    before = np.r_[last[x.before[linked]], np.arange(m, n) - np.repeat(x.sizes[:-1], x.sizes[1:])]
    old, new, far = ahead[before], (odds * back)[follow], x.far[follow].astype(int)
    joint = np.stack([p00[follow], p01[follow] * new, p10[follow] * old, p11[follow] * old * new])
    joint /= joint.sum(0)
    expected = np.stack([np.bincount(far, j, 3) for j in joint], 1).ravel()
    seen = np.bincount(4 * far + 2 * x.labels[before] + x.labels[follow], minlength=12)
    total[WIDTH:] += x.weight * np.r_[expected - seen, n]


def learned(total: Callable[[int, np.ndarray, np.ndarray], np.ndarray]) -> Model:
    """Maximum likelihood of a linear-chain conditional random field, by gradient steps with adaptive rates.

    ``total`` gives the summed gradient of the round.
    """
    w, pairs = np.zeros(WIDTH), np.zeros((3, 2, 2))
    state = [(np.zeros_like(x), np.zeros_like(x)) for x in (w, pairs)]
    for t in range(1, ROUNDS + 1):
        g = total(t, w, pairs)
        if not (n := g[-1]):
            continue
        for x, g, (m, v), rate in ((w, g[:WIDTH] / n + 3e-6 * w, state[0], 0.25), (pairs, g[WIDTH:-1].reshape(3, 2, 2) / n, state[1], 0.1)):
            m += 0.1 * (g - m)
            v += 0.02 * (g * g - v)
            x -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.98**t)) + 1e-8)
    return Model(w, pairs)


def train(chars: list[Candidates], labels: list[np.ndarray]) -> Model:
    """A model from labelled candidates, all in each round."""
    every = [chains(c, y) for c, y in zip(chars, labels)]

    def total(_: int, w: np.ndarray, pairs: np.ndarray) -> np.ndarray:
        out = np.zeros(WIDTH + 13)
        for x in every:
            gradient(x, w, pairs, out)
        return out

    return learned(total)


@dataclass
class Habits:
    """How words of the collection behave: those after whose full stop sentences go on, those that may end one all the
    same, and those that a number with a full stop belongs to."""

    short: set[str]
    ending: set[str]
    counted: set[str]


_OPENING = re.compile("[(«„“\"'’]")


def _before(whole: str, mark: int) -> str:
    """The word before the end mark, in lower case."""
    lead = whole[max(0, mark - 24) : mark].lower()
    if "\0" in lead:
        lead = lead.rsplit("\0", 1)[1]
    token = lead.rsplit(None, 1)[-1] if lead and not lead[-1].isspace() else ""
    return token if token.isalnum() else _OPENING.split(token)[-1]


def _following(whole: str, start: int) -> str:
    """What follows the gap, up to white space."""
    following = whole[start : start + 20]
    following = following.split(None, 1)[0] if following and not following[0].isspace() else ""
    return following.split("\0", 1)[0] if "\0" in following else following


_WORD = re.compile(r"(?<!\w)[^\W\d_](?:[^\W\d_]|[\u0900-\u097f])*(?=[\s,;:])")
_LETTERS = re.compile(r"(?:[^\W\d_]{1,2}\.)+[^\W\d_]{1,2}")
_INITIAL = re.compile(r"[^\W\d_]{1,2}\.")
_UNIT = re.compile(r"[^\W\d_]{1,2}[A-ZÀ-Þ]")


class Behaviour:
    """Counts of what words do: ``plain``, without a full stop; ``seen`` and ``on``, before one, and where the sentence plainly
    goes on; ``after``, what follows where it doesn't; ``after_number``, what follows a number and a full stop."""

    def __init__(self):
        self.plain, self.seen, self.on, self.after, self.after_number = (Counter() for _ in range(5))

    def add(self, c: Candidates) -> None:
        whole = c.chars.codes.tobytes().decode("utf-32-le", "surrogatepass")
        for chunk, n in Counter(whole.lower().split()).items():
            for word in _WORD.findall(chunk + " "):
                self.plain[word] += n
        stops = np.flatnonzero((c.kind == _END_MARK) & (c.mark == c.last_mark) & (c.quote != INSIDE) & ~c.number_here & (c.newlines < 2) & (c.chars.codes[c.mark] == 0x2E))
        columns = (c.mark[stops], c.start[stops], c.chars.kinds[c.start[stops]], c.newlines[stops] > 0)
        for mark, start, nxt, broken in zip(*(x.tolist() for x in columns)):
            token, following = _before(whole, mark), _following(whole, start)
            word = following.lower().strip(".,;:")
            if token.isdigit():
                self.after_number[word] += 1
                continue
            if not any(ch.isalpha() for ch in token):
                continue
            goes_on = nxt == C.LOWER and not _UNIT.match(following) or nxt == C.DIGIT and not broken or following[:1] in (",", ";", "—", "–", ")")
            self.seen[token] += 1
            if goes_on:
                self.on[token] += 1
            else:
                self.after[token, "" if broken else word] += 1  # what a line begins with may begin a sentence

    def habits(self) -> Habits:
        plain, seen, on = self.plain, self.seen, self.on
        lone = {w for w, n in seen.items() if len(w) <= SHORT and 20 * plain[w] <= n}
        begun, follows = Counter({"": LEAST_SEEN}), {}
        for (token, word), n in self.after.items():
            follows.setdefault(token, []).append((word, n))
            if token not in lone:
                begun[word] += n

        def begins(token: str) -> bool:
            """Whether what follows a full stop, where the sentence doesn't plainly go on, begins sentences elsewhere."""
            what = follows.get(token, [])
            return 2 * sum(n for w, n in what if begun[w] >= LEAST_SEEN) > sum(n for _, n in what)

        short = {w for w, n in seen.items() if n >= LEAST_SEEN and on[w] >= max(2, GOES_ON_SHARE * n) and plain[w] <= n}
        short |= {w for w, n in seen.items() if n >= 2 * LEAST_SEEN and w in lone and not begins(w)}
        short |= {w for w in seen if _LETTERS.fullmatch(w) and on[w]}  # letters with inner full stops
        ending = {w for w in short if seen[w] - on[w] >= max(LEAST_SEEN, 0.1 * seen[w]) and begins(w)}
        counted = {w for w, n in self.after_number.items() if n >= LEAST_SEEN and n >= AFTER_NUMBER * begun[w]}
        return Habits(short, ending, counted)

    def rows(self) -> Iterator[tuple[str, str, str, int, int, bool]]:
        for kind, counts in (("plain", self.plain), ("number", self.after_number)):
            yield from ((kind, w, "", n, 0, False) for w, n in counts.items())
        yield from (("seen", w, "", n, self.on[w], bool(_LETTERS.fullmatch(w))) for w, n in self.seen.items())
        yield from (("after", token, w, n, 0, False) for (token, w), n in self.after.items())


def habits(c: Candidates) -> Habits:
    """Shortened words, told by what they do before a full stop.

    A sentence rarely begins with a small letter or a digit, but goes on with one. A short word that never stands
    without its full stop is one too if what follows isn't what begins sentences elsewhere.
    """
    behaviour = Behaviour()
    behaviour.add(c)
    return behaviour.habits()


def _behaviour_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        behaviour = Behaviour()
        for batch in (whole.slice(i, 1000) for i in range(0, whole.num_rows, 1000)):
            behaviour.add(candidates(Characters(batch.column(0).to_pylist())))
        if rows := list(behaviour.rows()):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], ["kind", "token", "word", "n", "n_on", "lettered"])


def table_habits(texts: DataFrame, scratch: Scratch) -> Habits:
    """``habits`` of a table of texts. Only the shortened words and those of numbers come to the driver."""
    rows = texts.mapInArrow(_behaviour_rows, "kind string, token string, word string, n long, n_on long, lettered boolean")
    counts = scratch.keep(rows.groupBy("kind", "token", "word").agg(F.sum("n").alias("n"), F.sum("n_on").alias("n_on"), F.max("lettered").alias("lettered")))
    of = lambda kind: counts.where(F.col("kind") == kind)
    seen = of("seen").select("token", "n", "n_on", "lettered").join(of("plain").select("token", F.col("n").alias("plain")), "token", "left").fillna(0, ["plain"])
    seen = scratch.keep(seen.withColumn("lone", (F.length("token") <= SHORT) & (20 * F.col("plain") <= F.col("n"))))
    after = of("after").select("token", "word", F.col("n").alias("n_after"))
    begun = after.join(seen.where("not lone"), "token", "left_semi").groupBy("word").agg(F.sum("n_after").alias("begun"))
    begun = scratch.keep(begun.union(begun.sparkSession.createDataFrame([("", LEAST_SEEN)], begun.schema)).groupBy("word").agg(F.sum("begun").alias("begun")))
    begins = after.join(begun, "word", "left").groupBy("token").agg((2 * F.sum(F.when(F.col("begun") >= LEAST_SEEN, F.col("n_after")).otherwise(0)) > F.sum("n_after")).alias("begins"))
    told = seen.join(begins, "token", "left").fillna(False, ["begins"])
    n, on = F.col("n"), F.col("n_on")
    short = (n >= LEAST_SEEN) & (on >= F.greatest(F.lit(2), GOES_ON_SHARE * n)) & (F.col("plain") <= n)
    short = short | (n >= 2 * LEAST_SEEN) & F.col("lone") & ~F.col("begins") | F.col("lettered") & (on > 0)
    ending = (n - on >= F.greatest(F.lit(LEAST_SEEN), 0.1 * n)) & F.col("begins")
    found = told.where(short).select("token", ending.alias("ending")).collect()
    numbers = of("number").select(F.col("token").alias("word"), "n").join(begun, "word", "left").fillna(0, ["begun"])
    counted = numbers.where((n >= LEAST_SEEN) & (n >= AFTER_NUMBER * F.col("begun"))).collect()
    return Habits({r.token for r in found}, {r.token for r in found if r.ending}, {r.word for r in counted})


def rule_labels(c: Candidates, own: Habits | None = None) -> np.ndarray:
    """Labels by rules of typography, for training only."""
    own = own or habits(c)
    kinds = c.chars.kinds
    whole = c.chars.codes.tobytes().decode("utf-32-le", "surrogatepass")
    out = np.zeros(len(c.end), bool)
    columns = (c.mark, c.last_mark, c.start, c.kind, c.quote, c.newlines, c.number_here, kinds[c.mark - 1], kinds[c.start])
    for i, (mark, last, start, kind, quote, newlines, number_here, prev, nxt) in enumerate(zip(*(x.tolist() for x in columns))):
        if newlines >= 2:
            out[i] = True
            continue
        if kind == _BLANK:  # between ideographs a blank is odd white space
            out[i] = prev != C.CJK or nxt != C.CJK
            continue
        if kind == _BREAK:
            out[i] = c.number_next[i]
            continue
        if quote == INSIDE or number_here and (i == 0 or c.text[i - 1] != c.text[i] or out[i - 1]):
            continue
        if quote == AT_START or quote == IN_MIDDLE and nxt == C.CJK:
            continue
        goes_on = nxt == C.LOWER and not _UNIT.match(_following(whole, start)) or (first := whole[start]) in ",;—–)\0" or first.isspace()
        cluster = whole[mark : last + 1]
        if quote != NO_QUOTE:
            out[i] = not goes_on
        elif cluster[-1] in "。！？｡।॥؟۔":
            out[i] = True
        elif cluster != ".":
            out[i] = not goes_on and not (set(cluster) <= {".", "…"} and _SPACES[prev])
        elif goes_on:
            continue
        elif (token := _before(whole, mark)).isdigit():
            out[i] = _following(whole, start).lower().strip(".,;:") not in own.counted
        elif len(token) == 1 and token.isalpha() and _INITIAL.match(_following(whole, start)):  # the first letter of two or more
            continue
        elif token in own.short and (token not in own.ending or nxt == C.DIGIT and not c.number_next[i]):
            continue
        else:
            out[i] = True
    return out


def known_ends(words: list[str | None], indices: list[int], text: str) -> set[int] | None:
    """Where sentences of an annotated document end: before a token of another index.

    None if its tokens don't cover its text, or if one index holds so many tokens that it can't be a sentence's.
    """
    if max(Counter(indices).values(), default=0) > LONGEST:
        return None
    ends, at, last = set(), 0, None
    for word, own in zip(words, indices):
        word = (word or "").strip()
        if not word:
            continue
        if (found := text.find(word, at)) < 0 or text[at:found].strip():
            return None
        if last is not None and own != last:
            ends.add(at)
        at, last = found + len(word), own
    return None if text[at:].strip() else ends


def stripped(c: Candidates, labels: np.ndarray, texts: list[str]) -> Iterator[tuple[Candidates, np.ndarray]]:
    """Texts of scripts that may lack end marks without these, cut and labelled where their sentences were: with a blank
    in place of each end (Thai, and ideographs in odd layouts), and, of ideographic ones, with nothing at all."""
    ends = np.split(c.end[labels], np.searchsorted(c.text[labels], np.arange(1, len(texts))))
    for script, joint, weight in (("[\u0e00-\u0e7f]", " ", 1.0), ("[\u3040-\u9fff]", " ", STRIPPED), ("[\u3040-\u9fff]", "", STRIPPED)):
        lines, cuts = [], []
        for k, t in enumerate(texts):
            if not re.search(script, t):
                continue
            at = [0, *(ends[k] - c.chars.starts[k]).tolist(), len(t)]
            bare = [re.sub(r"[.!?…。！？｡]+|\s+" if joint == "" or script[1] == "\u3040" else r"[.!?…]+(?=\s|$)", "", t[a:b]).strip() for a, b in zip(at, at[1:])]
            bare = [x for x in bare if x]
            lines.append(joint.join(bare))
            cuts.append(set(np.cumsum([len(x) + len(joint) for x in bare[:-1]]).tolist()))
        if lines:
            own = candidates(Characters(lines))
            own.weight = weight
            yield own, np.fromiter((x - own.chars.starts[k] in cuts[k] for x, k in zip(own.start.tolist(), own.text.tolist())), bool, len(own.end))


def examples(texts: list[str], c: Candidates, own: Habits) -> Iterator[tuple[Candidates, np.ndarray]]:
    """What is trained on of texts without known sentences: as they are, stripped, and in capitals."""
    labels = rule_labels(c, own)
    yield c, labels
    yield from stripped(c, labels, texts)
    loud = candidates(Characters([t.upper() for t in texts]))
    loud.weight = LOUD
    yield loud, rule_labels(loud, own)


def known_examples(rows: Iterable[tuple[str, list, list]], weight: float) -> Iterator[tuple[Candidates, np.ndarray]]:
    """What is trained on of annotated documents: those whose sentences are known."""
    known = [(text, e) for text, words, indices in rows if (e := known_ends(words, indices, text)) is not None]
    if known:
        own = candidates(Characters([t for t, _ in known]))
        own.weight = weight
        yield own, np.fromiter((e - own.chars.starts[k] in known[k][1] for e, k in zip(own.end.tolist(), own.text.tolist())), bool, len(own.end))


_CHAINS = f"weight double, {', '.join(f'{k} binary' for k in _STORED)}, part int"


def _chain_rows(of: Callable[[list[tuple]], Iterable[tuple[Candidates, np.ndarray]]]):
    """Chains of the examples that ``of`` makes of rows, in blocks by part; a row has its text first and its part last."""

    def block(part: int, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        for c, y in of(rows):
            x = chains(c, y)
            stored = [pa.array([getattr(x, k).tobytes()], pa.binary()) for k in _STORED]
            yield pa.RecordBatch.from_arrays([pa.array([x.weight]), *stored, pa.array([part], pa.int32())], ["weight", *_STORED, "part"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = {}, Counter()
        for whole in batches:
            for batch in (whole.slice(i, 1000) for i in range(0, whole.num_rows, 1000)):
                for row in zip(*(x.to_pylist() for x in batch.columns)):
                    part = row[-1]
                    held.setdefault(part, []).append(row[:-1])
                    size[part] += len(row[0])
                    if size[part] >= BLOCK:
                        yield from block(part, held.pop(part))
                        size[part] = 0
        for part, rows in held.items():
            yield from block(part, rows)

    return run


def _gradient_rows(w: np.ndarray, pairs: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(WIDTH + 13)
        for batch in batches:
            for k in range(batch.num_rows):
                weight, *stored = (column[k] for column in batch.columns)
                if len(stored[-1].as_buffer()):
                    x = Chains(weight.as_py(), *(np.frombuffer(v.as_buffer(), t) for v, t in zip(stored, _STORED.values())))
                    x.features = x.features.reshape(-1, len(x.labels))
                    gradient(x, w, pairs, total)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["total"])

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(WIDTH + 13)
    for batch in batches:
        for x in batch.column(0):
            total += np.frombuffer(x.as_buffer())
    yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["total"])


def _table_gradient(parts: list[DataFrame]) -> Callable[[int, np.ndarray, np.ndarray], np.ndarray]:
    # Few tasks a round, as the weights and sums that travel with each may take longer than a split.
    parts = [p.coalesce(max(1, -(-p.rdd.getNumPartitions() // FILES))) for p in parts]
    many = [p.rdd.getNumPartitions() > 64 for p in parts]

    def total(t: int, w: np.ndarray, pairs: np.ndarray) -> np.ndarray:
        k = (t - 1) % len(parts)
        rows = parts[k].mapInArrow(_gradient_rows(w, pairs), "total binary")
        if many[k]:  # few sums reach the driver
            rows = rows.repartition(16).mapInArrow(_summed, "total binary")
        return sum((np.frombuffer(r.total) for r in rows.collect()), np.zeros(WIDTH + 13))

    return total


def fit(documents: DataFrame, annotated: DataFrame | None, text: str = "text", key: str = "doc_id") -> Model:
    """A model from all texts of the collection and all annotated documents with known sentences.

    Small collections are trained on by the driver. Of others the tasks count the words, write what is trained on in at most
    PARTS parts, by the hash of key and text, and sum up the gradient of one part a round.
    """
    texts = documents.where(F.col(text).isNotNull())
    n, size = texts.agg(F.count("*"), F.coalesce(F.sum(F.length(text)), F.lit(0))).first()
    weight = 0.0
    if annotated is not None:
        annotated = annotated.where("text is not null and tokens is not null and forall(tokens, x -> x.sentence_index is not null)")
        n_known, size_known = annotated.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
        weight, size = min(1.0, KNOWN * max(n, FEW) / max(1, n_known)), size + size_known
    columns = ("text", F.col("tokens.text").alias("words"), F.col("tokens.sentence_index").alias("indices"))
    if size <= LOCAL:
        every = [r[0] for r in texts.select(text).collect()]
        c = candidates(Characters(every))
        found = list(examples(every, c, habits(c)))
        if annotated is not None:
            found += known_examples((tuple(r) for r in annotated.select(*columns).collect()), weight)
        return train([c for c, _ in found], [y for _, y in found])
    parts = min(PARTS, -(-size // LOCAL))
    scratch = Scratch(documents.sparkSession, "sentences")
    own = table_habits(texts.select(text), scratch)

    def of_texts(rows: list[tuple]) -> Iterator[tuple[Candidates, np.ndarray]]:
        every = [r[0] for r in rows]
        return examples(every, candidates(Characters(every)), own)

    part = lambda *of: F.pmod(F.xxhash64(*of), F.lit(parts)).cast("int")
    rows = texts.select(text, part(key, text).alias("part")).mapInArrow(_chain_rows(of_texts), _CHAINS)
    if annotated is not None:
        rows = rows.union(annotated.select(*columns, part("id", "text").alias("part")).mapInArrow(_chain_rows(lambda rows: known_examples(rows, weight)), _CHAINS))
    kept = scratch.keep(rows, "part")
    model = learned(_table_gradient([kept.where(F.col("part") == k).drop("part") for k in range(parts)]))
    scratch.close()
    return model


def cut(model: Model, chars: Characters) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, first character and the one after the last (within the text) of every sentence."""
    c = candidates(chars)
    keep = model.decode(c)
    full = chars.ends > chars.starts
    own = np.flatnonzero(full)
    first = _forward(chars.kinds, chars.starts[own], _SPACES)
    own, first = own[first < chars.ends[own]], first[first < chars.ends[own]]
    last = chars.ends[own]
    while (blank := _SPACES[chars.kinds[last - 1]]).any():
        last = last - blank
    starts, ends = np.sort(np.concatenate([first, c.start[keep]])), np.sort(np.concatenate([c.end[keep], last]))
    text = np.searchsorted(chars.starts, starts, side="right") - 1
    return text, starts - chars.starts[text], ends - chars.starts[text]


def _cutter(weights: np.ndarray, pairs: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(weights, pairs)
        for whole in batches:
            for batch in (whole.slice(i, 1000) for i in range(0, whole.num_rows, 1000)):
                text, starts, ends = cut(model, Characters(batch.column(1).to_pylist()))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(text)), pa.array(starts.astype(np.int64)), pa.array(ends.astype(np.int64))], ["doc_id", "start_char", "end_char"])

    return run


def sentence_spans(documents: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, start_char, end_char`` of every sentence, without white space at its ends.

    Texts are cut where they lie, without a shuffle; null, empty and blank texts have no sentence. Long
    texts are decoded whole.
    """
    rows = documents.where(F.col(text).isNotNull()).select(F.col(key).cast("long").alias("doc_id"), text)
    return rows.mapInArrow(_cutter(model.weights.astype(np.float32), model.pairs), "doc_id long, start_char long, end_char long")
