"""Tokenizers, lower case and stemmer as Catalyst expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The token alphabet (ASCII letters and digits, U+0400 to U+047F), the capitals that are lowered, the suffixes that the
# stemmer strips, in order of trial.
TOKEN_CLASS = "A-Za-z0-9Ѐ-ѿ"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZАБВГДЕЁЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ"
SMALL = "abcdefghijklmnopqrstuvwxyzабвгдеёжзийклмнопрстуфхцчшщъыьэюя"
SUFFIXES = ("ями", "ами", "ого", "ему", "ому", "ее", "ие", "ые", "ий", "ый", "ой", "ая", "яя", "ам", "ям", "ах", "ях", "ов", "ев", "ей", "ом", "ем", "ым", "им", "а", "я", "о", "е", "и", "ы", "у", "ю")

#: Capitals of the alphabet that keep their case.
KEPT = "[ЀЂ-ЏѠ-ѿ]"
TOKEN = rf"[{TOKEN_CLASS}]+(?:[-'][{TOKEN_CLASS}]+)*"


#: What the bytes from 0x80 mean in windows-1251, and in the charset that gives each byte its own number.
CYRILLIC_HIGH, _LATIN_HIGH = bytes(range(128, 256)).decode("windows-1251", "replace"), bytes(range(128, 256)).decode("latin-1")


def raw_tokens(text: Column) -> Column:
    """Runs of the token alphabet, a - or ' inside a run kept. Null gives null, a text without tokens an empty array."""
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def html_strip(page: Column) -> Column:
    """A page without tags, which join what they part; an unclosed tag drops the rest; - or ' right before a tag parts."""
    return F.regexp_replace(F.regexp_replace(page, r"[-']<", " <"), r"<[^>]*>?", "")


def ru_lower(term: Column) -> Column:
    """Lower case of ASCII and of А to Я with Ё; other letters stay. Spark's own lower case does for all terms but those with such."""
    return F.when(term.rlike(KEPT), F.translate(term, CAPITALS, SMALL)).otherwise(F.lower(term))


def ru_stem(term: Column) -> Column:
    """A term without the first suffix that fits; it may become empty. Longer suffixes are tried first, as in their order, so a look-up of
    the last three, two and one characters does it."""
    out = term
    for n in (1, 2, 3):
        fits = [s for s in SUFFIXES if len(s) == n]
        out = F.when(F.right(term, F.lit(n)).isin(fits), F.substring(term, F.lit(1), F.length(term) - n)).otherwise(out)
    return out


def term(token: Column) -> Column:
    """The index term of a raw token."""
    return ru_stem(ru_lower(token))


_TO_SMALL, _KEPT = str.maketrans(CAPITALS, SMALL), re.compile(KEPT)
_BY_LENGTH = tuple((n, frozenset(s for s in SUFFIXES if len(s) == n)) for n in (3, 2, 1))


def term_of(token: str) -> str:
    """What `term` gives, for workers that hold the token."""
    low = token.translate(_TO_SMALL) if _KEPT.search(token) else token.lower()
    for n, fits in _BY_LENGTH:
        if low[-n:] in fits:
            return low[:-n]
    return low


def input_units(text: Column) -> Column:
    """Scanner steps over a plain text: a Cyrillic letter is one, any other character its bytes."""
    return F.octet_length(text) - F.length(F.regexp_replace(text, "[^Ѐ-ѿ]", ""))


def html_input_units(page: Column) -> Column:
    """Scanner steps over a page: inside tags every byte counts."""
    return F.octet_length(page) - F.length(F.regexp_replace(html_strip(page), "[^Ѐ-ѿ]", ""))


def page_text(page: Column) -> Column:
    """A binary page as text: UTF-8, or windows-1251 where it is none. Null stays null."""
    return F.coalesce(F.try_validate_utf8(page.cast("string")), F.translate(F.decode(page, "ISO-8859-1"), _LATIN_HIGH, CYRILLIC_HIGH))
