"""Sound keys and Unicode folding, which Spark has no built-in for: Arrow-batched pandas functions."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

VOWELS = "AEIOU"

# The rules of the original Metaphone (L. Philips, "Hanging on the Metaphone", Computer
# Language 7, 1990), whose results are defined by them. One rule per entry, tried in order at each letter: (letter, what must follow, what must stand
# before, result). Patterns are anchored at the letter; "" as result codes nothing.
_RULES: list[tuple[str, str, str, str]] = [
    ("B", r"$", r"M$", ""), ("B", "", "", "B"),
    ("C", r"IA|H", r"S$", "K"), ("C", r"IA|H", "", "X"), ("C", r"[IEY]", r"S$", ""), ("C", r"[IEY]", "", "S"), ("C", "", "", "K"),
    ("D", r"G[EIY]", "", "J"), ("D", "", "", "T"),
    ("G", r"H[^AEIOU]", "", ""), ("G", r"N$|NED$", "", ""), ("G", r"[EIY]", r"D$", ""), ("G", r"[IEY]", r"G$", "K"), ("G", r"[IEY]", "", "J"), ("G", "", "", "K"),
    ("H", r"[AEIOU]", r"[CSPTG]$", ""), ("H", r"[AEIOU]", "", "H"), ("H", "", "", ""),
    ("K", "", r"C$", ""), ("K", "", "", "K"),
    ("P", r"H", "", "F"), ("P", "", "", "P"),
    ("Q", "", "", "K"),
    ("S", r"H|I[OA]", "", "X"), ("S", "", "", "S"),
    ("T", r"I[OA]", "", "X"), ("T", r"H", "", "0"), ("T", r"CH", "", ""), ("T", "", "", "T"),
    ("V", "", "", "F"),
    ("W", r"[AEIOU]", "", "W"), ("W", "", "", ""),
    ("Y", r"[AEIOU]", "", "Y"), ("Y", "", "", ""),
    ("X", "", "", "KS"),
    ("Z", "", "", "S"),
]
_BY_LETTER: dict[str, list[tuple[re.Pattern, re.Pattern, str]]] = {}
for _letter, _after, _before, _code in _RULES:
    _BY_LETTER.setdefault(_letter, []).append((re.compile(_after), re.compile(_before), _code))
_START = ((re.compile(r"^(?=AE|GN|KN|PN|WR)."), ""), (re.compile(r"^X"), "S"), (re.compile(r"^WH"), "W"))


def sound_key(word: str) -> str:
    """The original Metaphone code of a word's ASCII letters; a vowel at the start is A."""
    rest = re.sub("[^A-Z]", "", word.upper())
    for pattern, put in _START:
        changed = pattern.sub(put, rest)
        if changed != rest:
            rest = changed
            break
    out = []
    for i, letter in enumerate(rest):
        if i and letter == rest[i - 1] and letter != "C":
            continue
        if letter in VOWELS:
            out.append("A" if i == 0 else "")
            continue
        before, after = rest[:i], rest[i + 1 :]
        rules = _BY_LETTER.get(letter)
        out.append(next(code for a, b, code in rules if a.match(after) and b.search(before)) if rules else letter)
    return "".join(out)


@pandas_udf(StringType())
def metaphone(words: pd.Series) -> pd.Series:
    known = {w: sound_key(w) for w in words.dropna().unique()}
    return words.map(known)


def fold_for_alignment(word: str, alphabet: str = "abcdefghijklmnopqrstuvwxyz'") -> str:
    """Compatibility forms and apostrophes folded, lower case, marks removed, other signs dropped."""
    text = unicodedata.normalize("NFKC", word).replace("’", "'").replace("‘", "'").lower()
    text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    return re.sub("'{2,}", "'", "".join(c for c in text if c in alphabet)).strip("'")


@pandas_udf(StringType())
def alignment_word(words: pd.Series) -> pd.Series:
    known = {w: fold_for_alignment(w) for w in words.dropna().unique()}
    return words.map(known)
