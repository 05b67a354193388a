"""Many texts as one array of code points, with a class for each character."""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass
from functools import cache

import numpy as np

(EDGE, SPACE, NEWLINE, DOT, BANG, ELLIPSIS, CJK_END, DANDA, CLOSE, QUOTE_CLOSE, QUOTE_OPEN, QUOTE_EITHER,
 OPEN, COLON, LOWER, UPPER, DIGIT, CJK, THAI, LETTER, MARK) = range(21)

# Characters of each class that Unicode's categories don't tell.
_GIVEN = {
    NEWLINE: "\n\r\x0b\x0c\x85  ", DOT: ".", BANG: "!?‼⁇⁈⁉", ELLIPSIS: "…", CJK_END: "。！？｡", DANDA: "।॥؟۔",
    CLOSE: ")]}）】〉》’", QUOTE_CLOSE: "»”」』", QUOTE_OPEN: "«„「『", QUOTE_EITHER: "\"“", OPEN: "([{（【〈《¿¡", COLON: ":：",
}
_TOP = 0x20000


@cache
def tables() -> tuple[np.ndarray, np.ndarray]:
    """Class and lower case of each code point below _TOP; the last entry stands for all others (ideographs, mostly)."""
    kinds, lower = np.full(_TOP + 1, MARK, np.uint8), np.arange(_TOP + 1, dtype=np.uint32)
    for cp in range(_TOP):
        if 0xD800 <= cp < 0xE000:
            continue
        ch = chr(cp)
        category = unicodedata.category(ch)
        if ch.isspace():
            kinds[cp] = SPACE
        elif 0x0E00 <= cp < 0x0E80:
            kinds[cp] = THAI
        elif category[0] == "L" and (0x2E80 <= cp < 0xA000 or 0xF900 <= cp < 0xFB00 or 0xFF66 <= cp < 0xFFA0) or cp == 0x30FC:
            kinds[cp] = CJK
        elif category in ("Lu", "Lt"):
            kinds[cp] = UPPER
        elif category == "Ll":
            kinds[cp] = LOWER
        elif category[0] in "LM":
            kinds[cp] = LETTER
        elif category[0] == "N":
            kinds[cp] = DIGIT
        if len(low := ch.lower()) == 1:
            lower[cp] = ord(low)
    for kind, chars in _GIVEN.items():
        kinds[[ord(c) for c in chars]] = kind
    kinds[0], kinds[_TOP] = EDGE, CJK
    return kinds, lower


class Characters:
    """Code points of the texts, a zero before, between and after them. Zeros within a text become blanks."""

    def __init__(self, texts: list[str]):
        texts = [t.replace("\0", " ") if "\0" in t else t for t in texts]
        self.codes = np.frombuffer(("\0" + "\0".join(texts) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32)
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        self.starts = np.cumsum(size + 1) - size  # place of each text's first character
        self.ends = self.starts + size
        self.kinds = tables()[0].take(self.codes, mode="clip")

    def lower(self, at: np.ndarray | slice) -> np.ndarray:
        return tables()[1].take(self.codes[at], mode="clip")


_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    if base not in _powers or len(_powers[base]) < n:
        steps = np.full(max(n, 1 << 20), base, np.uint64)
        steps[0] = 1
        _powers[base] = np.cumprod(steps)
    return _powers[base][:n]


def spread(h: np.ndarray) -> np.ndarray:
    """Mixes 64-bit hashes."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _is(*kinds: int) -> np.ndarray:
    table = np.zeros(32, bool)
    table[list(kinds)] = True
    return table


@dataclass
class Units:
    """Words (runs of letters or digits) of many texts; in scripts without blanks, characters."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    single: np.ndarray
    text: np.ndarray


def units(chars: Characters, singles: tuple[int, ...] = (CJK,)) -> Units:
    """The units of every text, in order. The hash of a unit is that of its lower case, wherever it stands."""
    single = _is(*singles)[chars.kinds]
    word = _is(*({LOWER, UPPER, DIGIT, LETTER, CJK, THAI} - set(singles)))[chars.kinds]
    start = np.flatnonzero(single | (word & ~np.r_[False, word[:-1]]))
    end = np.where(single[start], start + 1, 0)
    end[~single[start]] = np.flatnonzero(word & ~np.r_[word[1:], False]) + 1
    sums = np.zeros(len(chars.codes) + 1, np.uint64)
    np.cumsum((chars.lower(slice(None)).astype(np.uint64) + np.uint64(1)) * _power(_BASE, len(chars.codes)), out=sums[1:])
    h = (sums[end] - sums[start]) * _power(_INVERSE, len(chars.codes))[start]
    return Units(start, end, spread(h), single[start], np.searchsorted(chars.starts, start, side="right") - 1)
