"""Name normalisation as column expressions.

Folding one name means: compatibility decomposition, removal of characters with
a nonzero combining class, full case folding. All three act on one character at
a time once combining characters are gone, so the fold of a string is the
concatenation of the folds of its characters. That makes most rows a
``lower`` (ASCII) or a ``translate`` (one-to-one folds) inside the JVM. Only
rows holding a character whose fold is longer than one character, or one from a
rarely used block, carry a value into the Arrow function; all others pass NULL.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from namesieve.params import HONORIFICS

# Code points folded by ``translate``; within these ranges every fold has at
# most one character, except for sharp s, which has its own replacement.
_ONE_TO_ONE = (
    (0x00, 0xBB), (0xBF, 0x131), (0x134, 0x13E), (0x141, 0x148), (0x14A, 0x1C3),
    (0x1F4, 0x586), (0x588, 0x674), (0x679, 0x9CA), (0x2010, 0x2024), (0x4E00, 0x9FFF),
)
_SHARP_S = "ß"
# ASCII first: a long text is left at one comparison per character.
_FOLDED_HERE = "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in _ONE_TO_ONE)
_NEEDS_PYTHON = f"[\\x{{80}}-\\x{{10FFFF}}&&[^{_FOLDED_HERE}]]"


def fold_text(text: str) -> str:
    """Reference definition of the fold for one string."""
    kept = (c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    return "".join(kept).casefold()


@lru_cache(maxsize=1)
def _translate_table() -> tuple[str, str]:
    """(matching, replacement) for ``translate``; the unmatched tail is deleted."""
    mapped, removed = [], []
    for first, last in _ONE_TO_ONE:
        if first >= 0x4E00:  # ideographs fold to themselves
            continue
        for char in map(chr, range(first, last + 1)):
            folded = fold_text(char)
            if char == _SHARP_S or folded == char:
                continue
            if folded:
                mapped.append((char, folded))
            else:
                removed.append(char)
    matching = "".join(c for c, _ in mapped) + "".join(removed)
    return matching, "".join(f for _, f in mapped)


@F.pandas_udf(T.StringType())
def _fold_udf(values: pd.Series) -> pd.Series:
    return values.map(fold_text, na_action="ignore")


def folded(name: Column) -> Column:
    """Decompose, drop combining marks, case-fold."""
    matching, replacement = _translate_table()
    hard = name.rlike(_NEEDS_PYTHON)
    return (
        F.when(name.rlike(r"^\p{ASCII}*$"), F.lower(name))
        .when(
            ~hard,
            F.translate(F.replace(name, F.lit(_SHARP_S), F.lit("ss")), matching, replacement),
        )
        .otherwise(_fold_udf(F.when(hard, name)))
    )


def letters_and_digits(text: Column) -> Column:
    """Every run of other characters becomes one space; ends are trimmed."""
    return F.trim(F.regexp_replace(text, r"[^\p{L}\p{N}]+", " "))


def normalise_name(name: Column) -> Column:
    """Canonical search form of a name; empty when nothing matchable is left."""
    return letters_and_digits(folded(name))


def honorific_pattern(honorifics: Sequence[str] = HONORIFICS) -> str:
    """Leading titles, longest phrase first.

    Each is followed by a space, so the last token of a trimmed name is never
    part of the match and no name is consumed whole.
    """
    phrases = sorted(honorifics, key=lambda h: (-len(h.split()), h))
    return "^(?:(?:" + "|".join(phrases) + ") )+"


def strip_honorifics(normalised: Column, honorifics: Sequence[str] = HONORIFICS) -> Column:
    if not honorifics:
        return normalised
    # Possessive, so that any number of titles needs no stack.
    return F.regexp_replace(normalised, honorific_pattern(honorifics) + "+", "")


def name_variants(normalised: Column, honorifics: Sequence[str] = HONORIFICS) -> Column:
    """Search forms of a normalised name: canonical first, then without titles."""
    stripped = strip_honorifics(normalised, honorifics)
    return F.when(normalised == "", F.array().cast("array<string>")).otherwise(
        F.array_distinct(F.array(normalised, stripped))
    )


def sorted_tokens(normalised: Column) -> Column:
    """Tokens in binary order, joined again: equal for reordered names."""
    return F.array_join(F.array_sort(F.split(normalised, " ")), " ")
