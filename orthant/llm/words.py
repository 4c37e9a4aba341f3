"""Words of a text in Python: lower-cased runs of letters, digits and non-ASCII characters."""

from __future__ import annotations

import re

_WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def find_words(text: str) -> list[str]:
    return _WORDS.findall(text.lower())
