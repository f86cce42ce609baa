"""Terms of a text, and their fingerprints, in Python workers."""

from __future__ import annotations

import re

import numpy as np
import xxhash

_TERM = re.compile("[0-9A-Za-zЀ-ѿ]+(?:[-'][0-9A-Za-zЀ-ѿ]+)*")
# Capitals of the term alphabet that keep their case.
_KEPT = re.compile("[ЀЂ-ЏѠ-ѿ]")
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZАБВГДЕЁЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ"
_LOWER = str.maketrans(_CAPITALS, _CAPITALS.lower())


def terms(text: str | None) -> list[str]:
    """Longest runs of ASCII letters, digits and U+0400 to U+047F, with - or ' kept between two such characters; lower-cased."""
    if not text:
        return []
    found = _TERM.findall(text)
    if not found:
        return found
    joined = "\n".join(found)
    return (joined.translate(_LOWER) if _KEPT.search(joined) else joined.lower()).split("\n")


class _Prints(dict):
    """64-bit fingerprint of a term, smaller for longer terms: six bits of its length over 58 of a hash. Remembers up to a bound."""

    def __missing__(self, term: str) -> int:
        if len(self) > 400_000:
            self.clear()
        value = self[term] = (63 - min(len(term), 63)) << 58 | xxhash.xxh3_64_intdigest(term) >> 6
        return value


_PRINTS = _Prints()


def term_prints(found: list[str]) -> np.ndarray:
    """Fingerprints of terms as 64-bit integers."""
    return np.fromiter(map(_PRINTS.__getitem__, found), dtype=np.uint64, count=len(found))
