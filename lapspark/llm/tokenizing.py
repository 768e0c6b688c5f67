"""Cutting texts at places no token crosses, so that whatever a tokenizer does can be kept per distinct unit."""

from __future__ import annotations

import re
from collections.abc import Callable

import public_tokenizers
from tokenizers import Tokenizer

_ASCII = re.compile(r" ?\S+|\s+(?!\S)|\s+", re.ASCII)
#: White space beside which a unit could not be cut without looking further.
_DOUBLED = re.compile(r"[ \n][ \n]|\A[ \n]|[ \n]\Z|[\t\r\x0b\x0c]")
_EXOTIC = re.compile("[\x1c-\x1f\x85\xa0  -     　]")
#: From bytes to the characters byte-level vocabularies show them by: those hidden in Latin-1 count on from 256.
BYTE_ALPHABET = {b: 256 + k for k, b in enumerate([*range(33), *range(127, 161), 173])}

_loaded: dict[str, Tokenizer] = {}


def tokenizer(name: str) -> Tokenizer:
    """The tokenizer file ``name``, read once in each Python worker."""
    if name not in _loaded:
        _loaded[name] = Tokenizer.from_file(public_tokenizers.path(name))
    return _loaded[name]


def specials(tok: Tokenizer) -> dict[str, int]:
    return {t.content: i for i, t in tok.get_added_tokens_decoder().items()}


def by_special(text: str, special: dict[str, int]) -> list[str]:
    """``text`` cut around the special strings in it, which stay as parts of their own."""
    if not any(s in text for s in special):
        return [text]
    return [p for p in re.split("(" + "|".join(map(re.escape, special)) + ")", text) if p]


def space_units(text: str) -> list[str]:
    r"""Units of a text without special strings, for byte-level patterns that take one leading space into a word.

    Joined they give the text. Where words stand one space or line feed apart, a cut before that character is safe
    (``foo`` | `` bar`` and ``foo`` | ``\nbar``: the pattern never continues over it). Other ASCII white space is cut as
    the pattern itself does; a text with further kinds of white space is one unit.
    """
    if not text:
        return []
    if _EXOTIC.search(text):
        return [text]
    if _DOUBLED.search(text):
        return _ASCII.findall(text)
    first, *rest = text.replace("\n", " \n").split(" ")
    return [first, *[u if u[0] == "\n" else " " + u for u in rest]]


def batches_of(texts: list[str], chars: int = 4_000_000):
    """``texts`` in runs of about ``chars`` characters, so that their units fit in memory together."""
    start = size = 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= chars:
            yield texts[start:i + 1]
            start, size = i + 1, 0
    if start < len(texts):
        yield texts[start:]


class Memo:
    """Values by key, computed for all missing keys of a batch at once; emptied when it holds ``limit`` keys."""

    def __init__(self, compute: Callable[[list], list], limit: int = 300_000):
        self.compute, self.limit, self.known = compute, limit, {}

    def prepare(self, keys) -> dict:
        missing = [k for k in dict.fromkeys(keys) if k not in self.known]
        if missing:
            if len(self.known) + len(missing) > self.limit:
                self.known.clear()
                missing = list(dict.fromkeys(keys))
            self.known.update(zip(missing, self.compute(missing)))
        return self.known
