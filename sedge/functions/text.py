"""Text functions as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import struct


def normalise_transcript(text: Column) -> Column:
    """Lower case, no marks, single blanks, trimmed; letters and digits of any script stay, and any script's white space is a blank."""
    bare = F.regexp_replace(F.lower(text), r"(?U)[^a-z 0-9\p{L}\p{N}_\s]+", "")
    # runs of white space but for single blanks, which most are: those needn't be replaced by themselves
    return F.trim(F.regexp_replace(bare, r"(?U)[\s&&[^ ]]\s*| \s+", " "))


def tokens(text: Column) -> Column:
    """Blank-separated words; none for an empty or null text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), " "), lambda t: t != "")


def ngrams(words: Column, n: int) -> Column:
    """Distinct runs of n words joined by blanks; a shorter text is one run of all its words."""
    runs = F.greatest(F.size(words) - n + 1, F.lit(1))
    out = F.slice(words, 1, runs)
    # shifted copies zipped together: the words are computed once for each copy, not once for each run
    for k in range(1, n):
        out = F.zip_with(out, F.slice(words, k + 1, runs), lambda a, b: F.concat_ws(" ", a, b))
    return F.when(F.size(words) == 0, F.array(F.lit(""))).otherwise(F.array_distinct(out))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all members of two sets; 0 if either is empty."""
    shared = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(shared / (F.size(F.array_distinct(a)) + F.size(F.array_distinct(b)) - shared))


def leakage_similarity(a: Column, b: Column) -> Column:
    """The larger Jaccard similarity of words and of word pairs."""
    return F.greatest(jaccard(F.array_distinct(a), F.array_distinct(b)), jaccard(ngrams(a, 2), ngrams(b, 2)))


def edit_counts(reference: Sequence[str], hypothesis: Sequence[str]) -> tuple[int, int, int]:
    """Substitutions, deletions and insertions of a least-cost alignment, from two rows of its table.

    A cell that no substitution or deletion reaches as cheaply is an insertion after the nearest
    earlier cell of its row that isn't one, so a row takes a few array operations.
    """
    codes: dict[str, int] = {}
    ref, hyp = (np.array([codes.setdefault(w, len(codes)) for w in x], np.int64) for x in (reference, hypothesis))
    at = np.arange(len(hyp) + 1)
    # rows: cost, substitutions, deletions, insertions
    row = np.stack([at, 0 * at, 0 * at, at])
    add_sub, add_del, add_ins = (np.array(x)[:, None] for x in ((1, 1, 0, 0), (1, 0, 1, 0), (1, 0, 0, 1)))
    for word in ref:
        down = row + add_del
        diagonal = row[:, :-1] + add_sub * (hyp != word)
        down[:, 1:] = np.where(diagonal[0] <= down[0, 1:], diagonal, down[:, 1:])
        least = np.minimum.accumulate(down[0] - at) + at
        origin = np.maximum.accumulate(np.where(least < down[0], 0, at))
        row = down[:, origin] + add_ins * (at - origin)
    return int(row[1, -1]), int(row[2, -1]), int(row[3, -1])


#: Fields of a cell from the highest: cost less its place, 2 x (places to the right) + 1 if a deletion ends it, deletions.
_DEL, _PLACE, _COST = 1, 1 << 20, 1 << 41
#: Cells of a row of tables that are worked on together, and words beyond which a pair goes by edit_counts().
_CELLS, _LONGEST = 1 << 15, (1 << 19) - 1


def _edits_together(ref: np.ndarray, hyp: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """sub, del, ins of pairs in descending order of n words of ref; rows of codes, filled up with different negative numbers.

    The table of edit_counts() for many pairs at once. A cell is one number, so that the least of two is the
    cheaper, then a substitution before a deletion; of a row's cells that insertions may start from, the last.
    """
    width = hyp.shape[1] + 1
    places = np.arange(width)
    right = 2 * (width - 1 - places) * _PLACE
    row = np.zeros((len(n), width), np.int64)  # insertions only: cost less place 0, no deletion
    costs, deletions = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
    down, across = right + _COST + _PLACE + _DEL, right[1:] - _COST
    live = len(n)
    for i in range(int(n.max(initial=0)) + 1):
        ended = np.arange(np.searchsorted(-n[:live], -i, "left"), live)
        last = row[ended, m[ended]]
        costs[ended], deletions[ended] = (last >> 41) + m[ended], last & (_PLACE - 1)
        live -= len(ended)
        if not live:
            break
        here = row[:live] + down
        np.minimum(here[:, 1:], row[:live, :-1] + across + np.where(hyp[:live] != ref[:live, i, None], _COST, 0), out=here[:, 1:])
        np.minimum.accumulate(here, axis=1, out=here)
        row = here & ~(_COST - _PLACE)
    insertions = deletions + m - n
    return np.stack([costs - deletions - insertions, deletions, insertions])


def edits_of_pairs(reference: Sequence, hypothesis: Sequence) -> np.ndarray:
    """edit_counts() of each pair, as rows."""
    n, m = (np.array([len(w) for w in x], np.int64) for x in (reference, hypothesis))
    codes, _ = pd.factorize(np.concatenate([np.zeros(0, object), *(np.asarray(w, object) for x in (reference, hypothesis) for w in x)]), use_na_sentinel=False)
    ends = np.cumsum(np.concatenate([[0], n, m]))
    out = np.zeros((len(n), 3), np.int64)
    order = np.lexsort((-n, m))  # pairs of like width together
    at = 0
    while at < len(order):
        here = order[at : at + 1]
        if max(n[here[0]], m[here[0]]) > _LONGEST:
            out[here[0]] = edit_counts(reference[here[0]], hypothesis[here[0]])
            at += 1
            continue
        many = max(1, _CELLS // (int(m[here[0]]) + 1))
        here = order[at : at + many]
        fits = (np.maximum(n[here], m[here]) <= _LONGEST) & (m[here] <= 2 * m[here[0]] + 8)
        here = here[: int(np.argmin(fits))] if not fits.all() else here
        at += len(here)
        here = here[np.argsort(-n[here], kind="stable")]
        ref, hyp = np.full((len(here), int(n[here].max())), -1, np.int64), np.full((len(here), int(m[here].max())), -2, np.int64)
        for k, pair in enumerate(here):
            ref[k, : n[pair]] = codes[ends[pair] : ends[pair + 1]]
            hyp[k, : m[pair]] = codes[ends[len(n) + pair] : ends[len(n) + pair + 1]]
        out[here] = _edits_together(ref, hyp, n[here], m[here]).T
    return out


@F.pandas_udf(struct(**{"sub": "integer", "del": "integer", "ins": "integer"}))
def word_edits(reference: pd.Series, hypothesis: pd.Series) -> pd.DataFrame:
    """struct(sub, del, ins) of a least-cost word alignment; of equal costs a substitution is taken before a deletion before an insertion. Null if a side is null."""
    known = (reference.notna() & hypothesis.notna()).to_numpy()
    rows = pd.DataFrame(edits_of_pairs(reference[known].tolist(), hypothesis[known].tolist()), columns=["sub", "del", "ins"], index=np.flatnonzero(known))
    return rows.reindex(range(len(known))).astype("Int32")


def first_outside_parens(text: Column) -> Column:
    """What stands before the first comma that is not in parentheses."""
    return F.trim(F.regexp_extract(text, r"^((?:[^,(]|\([^)]*\))*)", 1))


def clean_lines(text: Column) -> Column:
    """Trimmed, non-empty lines joined by blanks."""
    return F.array_join(F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != ""), " ")


def starts_with_verb(text: Column, verbs: list[str]) -> Column:
    """Whether a text is one of the verbs or starts with one and a blank."""
    return F.exists(F.array(*map(F.lit, verbs)), lambda v: (text == v) | F.startswith(text, F.concat(v, F.lit(" "))))


def parse_pattern(pattern: Column) -> Column:
    """'shape:circle,dir:up,radius,ids' as a map from slot to value (null for a bare slot)."""
    parts = F.filter(F.transform(F.split(pattern, ","), lambda x: F.trim(x)), lambda p: p != "")
    entries = F.transform(parts, lambda p: F.struct(F.get(F.split(p, ":", 2), F.lit(0)).alias("k"), F.get(F.split(p, ":", 2), F.lit(1)).alias("v")))
    return F.map_from_entries(entries)


def edit_rate(errors: Column, words: Column) -> Column:
    """Errors a reference word; null for an empty reference."""
    return F.try_divide(errors.cast("double"), F.nullif(words, F.lit(0)))
