"""Words of a text: runs of letters or digits in composed form and lower case."""

from __future__ import annotations

import re
import unicodedata

_word = re.compile(r"[^\W_]+")
#: Of the first 256 code points, those that aren't letters or digits become blanks.
_LATIN = bytes(i if chr(i).isalnum() else 32 for i in range(256))


def normal(text: str) -> str:
    return unicodedata.normalize("NFC", text).lower()


def words(text: str) -> list[str]:
    text = normal(text)
    try:  # most texts hold the first 256 code points only, whose words a byte table finds faster
        return text.encode("latin-1").translate(_LATIN).decode("latin-1").split()
    except UnicodeEncodeError:
        return _word.findall(text)
