"""Spelled-out numbers: rewriting them as digits, and spelling digits out.

Reading is a small state machine over a text's tokens, so it runs as an Arrow pandas UDF.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Number words and their values, signs, the decimal word.
ONES = {w: i for i, w in enumerate("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split())}
ONES_READ = ONES | {"nought": 0, "naught": 0, "oh": 0}
TENS = {"twenty": 20, "thirty": 30, "forty": 40, "fifty": 50, "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90}
TENS_READ = TENS | {"fourty": 40}
SIGNS = {"minus", "negative"}

_PIECE = re.compile(r"[a-z]+|[0-9]+(?:\.[0-9]+)?|[^\sa-z0-9]+|\s+", re.I)


class _Reader:
    """Cursor over the tokens of one text that are not white space, remembering where each stood."""

    def __init__(self, pieces: list[str]):
        self.at = [i for i, p in enumerate(pieces) if not p.isspace()]
        self.word = [pieces[i].lower() for i in self.at]

    def number(self, k: int) -> tuple[str, int] | None:
        """The number that starts at the k-th token and the token after it."""
        sign = ""
        if self.word[k] in SIGNS:
            sign, k = "-", k + 1
            if k >= len(self.word) or not self._opens(self.word[k], signed=True):
                return None
        if not self._opens(self.word[k]):
            return None
        value, after = self._whole(k)
        if after == k:
            return None
        tail = self._decimals(after)
        if tail:
            digits, after = tail
            return f"{sign}{_trim(float(f'{value}.{digits}'))}", after
        return f"{sign}{value}", after

    @staticmethod
    def _opens(word: str, signed: bool = False) -> bool:
        known = word in ONES_READ or word in TENS_READ or word == "hundred"
        return known and (signed or word != "oh")

    def _whole(self, k: int) -> tuple[int, int]:
        value, seen = 0, False
        while k < len(self.word):
            w = self.word[k]
            if w in ONES_READ or w in TENS_READ:
                value += ONES_READ.get(w, TENS_READ.get(w, 0))
                seen = True
            elif not seen:
                break
            elif w == "hundred":
                value = 100 * max(value, 1)
            elif not (w == "-" or w == "and" and value and value % 100 == 0):
                break
            k += 1
        return value, k

    def _decimals(self, k: int) -> tuple[str, int] | None:
        if k >= len(self.word) or self.word[k] != "point":
            return None
        k += 1
        digits = ""
        while k < len(self.word) and ONES_READ.get(self.word[k], 10) <= 9:
            digits += str(ONES_READ[self.word[k]])
            k += 1
        return (digits, k) if digits else None


def _trim(x: float) -> str:
    return f"{x:.10f}".rstrip("0").rstrip(".")


def digits_of(text: str) -> str:
    """text with spelled-out numbers from 0 to 999 (sign, decimals) as digits; all else unchanged."""
    pieces = _PIECE.findall(text)
    reader = _Reader(pieces)
    out, k, copied = [], 0, 0
    while k < len(reader.at):
        found = reader.number(k)
        if found is None:
            k += 1
            continue
        start, stop = reader.at[k], reader.at[found[1] - 1] + 1
        out += [*pieces[copied:start], found[0]]
        copied, k = stop, found[1]
    return "".join([*out, *pieces[copied:]])


def spell_int(n: int) -> str:
    if n < 20:
        return next(w for w, v in ONES.items() if v == n)
    if n < 100:
        tens = next(w for w, v in TENS.items() if v == n - n % 10)
        return tens if n % 10 == 0 else f"{tens}-{spell_int(n % 10)}"
    rest = n % 100
    return f"{spell_int(n // 100)} hundred" + (f" and {spell_int(rest)}" if rest else "")


def spell(x: float) -> str:
    """English for a number of at most three whole digits and one decimal."""
    sign = "minus " if x < 0 else ""
    whole, tenth = divmod(round(abs(x) * 10), 10)
    return sign + spell_int(int(whole)) + (f" point {spell_int(int(tenth))}" if tenth else "")


@F.pandas_udf(T.StringType())
def words_to_digits(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else digits_of(t))


@F.pandas_udf(T.StringType())
def number_to_words(x: pd.Series) -> pd.Series:
    return x.map(lambda v: None if pd.isna(v) else spell(float(v)))


def normalise(text):
    """Lower case, numbers as digits, apostrophes closed up, other marks as word breaks; decimal points and leading minus signs stay."""
    c = words_to_digits(F.lower(text))
    c = F.regexp_replace(c, r"(?<=\d)\.(?=\d)", "Q")
    c = F.regexp_replace(c, r"(?<![a-z0-9])-(?=\d)", "Z")
    c = F.regexp_replace(c, r"['‘’ʼ]", "")
    c = F.regexp_replace(c, r"[^a-z0-9\sQZ]", " ")
    c = F.regexp_replace(c, r"(?<=\d)Q(?=\d)", ".")
    c = F.regexp_replace(c, r"Z(?=\d)", "-")
    return F.trim(F.regexp_replace(c, r"\s+", " "))
