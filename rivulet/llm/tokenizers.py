"""Vocabulary files, pre-tokenisation and memoised per-piece work.

The place of the vocabulary files is a parameter everywhere; by default it is that of
the installed ``public_tokenizers`` package, so executors read their own copy.
"""

from __future__ import annotations

import base64
import functools
import re
import sys
from collections.abc import Callable, Hashable

import regex

#: A space that starts a piece: one that a character other than white space follows.
_BEFORE_PIECE = re.compile(r" (?!\s|$)")
_ODD_SPACE = re.compile(r" (?:\s|\Z)|[\x1c-\x1f]")
#: Bytes that a memo may hold, those of a memo of plain words, and a memo's longest key:
#: text without spaces is no key.
MEMO_BYTES, WORD_BYTES, MEMO_KEY = 16 << 20, 72 << 20, 64
#: Marks that are a piece of their own between letters and a space or the end.
MARKS = frozenset(".,;:!?")


def vocabulary_path(name: str, folder: str | None = None) -> str:
    if folder:
        return f"{folder}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.lru_cache(maxsize=4)
def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank from a .tiktoken file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@functools.lru_cache(maxsize=4)
def piece_pattern(pattern: str | None = None) -> regex.Pattern:
    """The split pattern with white space as the libraries define it.

    \\s there is Unicode's White_Space, which lacks U+001C to U+001F.
    """
    if pattern is None:
        import public_tokenizers

        pattern = public_tokenizers.PATTERN
    return regex.compile(pattern)


def split_words(text: str) -> tuple[list[str], list[str]]:
    """(parts as they stand, parts that a space precedes) which make up the text.

    The text is cut before spaces where a match of the pattern also ends: a run of
    white space gives its last space to the piece that follows, and no piece has a
    space elsewhere, so a cut before a space that no white space follows never
    divides a piece. All parts of the first list come before those of the second.
    """
    if _ODD_SPACE.search(text):
        out, at = [], 0
        for m in _BEFORE_PIECE.finditer(text):
            if m.start() > at:
                out.append(text[at : m.start()])
                at = m.start()
        out.append(text[at:])
        return out, []
    first, *rest = text.split(" ")
    return [first] if first else [], rest


class Memo(dict):
    """value = f(key), remembered in two generations of half the bytes each.

    Once one is full it becomes the older generation and the one before is dropped;
    what is used again moves up. So memory stays bounded whatever the texts, and
    frequent keys stay known. Long keys are computed every time.
    """

    #: Bytes of an entry besides key and value.
    ENTRY = 110

    def __init__(self, f: Callable[[Hashable], object], limit: int = MEMO_BYTES) -> None:
        super().__init__()
        self.f, self.limit, self.used, self.older = f, limit // 2, 0, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.f(key)
        if isinstance(key, str) and len(key) > MEMO_KEY:
            return value
        cost = sys.getsizeof(key) + sys.getsizeof(value) + self.ENTRY
        if self.used + cost > self.limit:
            self.older = dict(self)
            self.clear()
            self.used = 0
        self[key] = value
        self.used += cost
        return value
