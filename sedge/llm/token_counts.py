"""Token counts of whole texts under a byte-level vocabulary, by the whole-token shortcut.

Before any text is read, `prove` asks the library which strings of the vocabulary, given alone, are
one pre-token and encode as their own single id. A pre-token's ids depend on nothing around it, so
a pre-token that is such a string counts one without merging, wherever it stands; only the rest are
merged. The set has at most as many strings as the vocabulary, whatever the input, and is broadcast.

A text is cut at every blank before something that isn't white space: the vocabulary's pattern never
joins what lies before such a blank with what follows, so the parts count on their own. Counts of
parts are kept, up to CACHE_ENTRIES; results don't depend on it. A part is split into pre-tokens
here only if the library classes each of its characters as the pattern here does (tables of Unicode
differ by version; each character is tried once); other parts are encoded whole by the library.

Nulls: a null text is an empty one (0 bytes, 0 tokens); a null doc_id is carried. Repeated rows are
counted once each, and nothing depends on the rows' order. Texts of any length are counted whole, in
blocks that end at such a blank. Special strings inside a text count one each, as the library has
it by default, and what stands between them counts as texts of their own. Only doc_id and text are
read, so other columns may have any names. An empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_letters

#: Tokens beyond which a text is over the limit.
LIMIT = 1024
#: Parts whose counts a worker keeps before it forgets them.
CACHE_ENTRIES = 400_000
#: Characters of a text that are split at a time, up to the next place where it can be cut.
BLOCK = 1 << 20

#: The pre-token pattern of byte-level vocabularies, and the characters that are white space in it.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WHITE = "\t\n\v\f\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_CUT = re.compile(f" (?=[^{WHITE}])")
_PRE = regex.compile(PATTERN)


def _file(path: str) -> dict:
    """The vocabulary file, if it is of the kind whose counts this module can prove."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    split, model = spec["pre_tokenizer"] or {}, spec["model"]
    plain = all(not model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback"))
    if spec["normalizer"] or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True) or model["type"] != "BPE" or not plain:
        raise ValueError(f"{path} is not a plain byte-level vocabulary")
    if any(t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError(f"{path} has special tokens that take their surroundings in")
    return spec


def _library(path: str):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def prove(path: str) -> frozenset[str]:
    """The strings of the vocabulary that, alone, are one pre-token and encode as their own single id."""
    byte_of = {letter: b for b, letter in byte_letters().items()}
    texts, own = [], []
    for spelled, i in _file(path)["model"]["vocab"].items():
        try:
            texts.append(bytes([byte_of[c] for c in spelled]).decode())
            own.append(i)
        except (KeyError, UnicodeDecodeError):
            pass  # part of a character, or no spelling of bytes: never a whole pre-token
    tokenizer = _library(path)
    ids = [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    return frozenset(t for t, got, i in zip(texts, ids, own, strict=True) if got == [i] and len(tokenizer.pre_tokenizer.pre_tokenize_str(t)) == 1)


class TokenCounter(dict):
    """Tokens of each part, counted once: the key is what follows the part's leading blank."""

    def __init__(self, path: str, whole: frozenset[str]):
        super().__init__()
        self.whole = whole
        self.tokenizer = _library(path)
        self.letters = byte_letters()
        special = [t["content"] for t in _file(path)["added_tokens"] if t["content"]]
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.alike: dict[str, bool] = {}
        self.common = re.compile(f"[{''.join(re.escape(chr(c)) for c in range(0x250) if self._classed_alike(chr(c)))}]*")
        self.merges: dict[str, int] = {}

    def _classed_alike(self, c: str) -> bool:
        """Whether the library splits around c, in every kind of company, as the pattern here does."""
        got = self.alike.get(c)
        if got is None:
            probe = f"a{c}a1{c}1 {c} !{c}!{c}"
            ours = [m.span() for m in _PRE.finditer(probe)]
            got = self.alike[c] = ours == [span for _, span in self.tokenizer.pre_tokenizer.pre_tokenize_str(probe)]
        return got

    def _part(self, text: str) -> int:
        if not self.common.fullmatch(text) and not all(map(self._classed_alike, set(text))):
            return len(self.tokenizer.encode(text, add_special_tokens=False).ids)
        whole = self.whole
        return sum([1 if pre in whole else self._merged(pre) for pre in _PRE.findall(text)])

    def _merged(self, pre: str) -> int:
        """Tokens of a pre-token that isn't one token whole."""
        got = self.merges.get(pre)
        if got is None:
            if len(self.merges) >= CACHE_ENTRIES:
                self.merges.clear()
            got = self.merges[pre] = len(self.tokenizer.model.tokenize("".join([self.letters[b] for b in pre.encode()])))
        return got

    def __missing__(self, rest: str) -> int:
        got = self._part(" " + rest)
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        self[rest] = got
        return got

    def _plain(self, text: str) -> int:
        n, at = 0, 0
        while at < len(text):
            cut = _CUT.search(text, at + BLOCK)
            end = cut.start() if cut else len(text)
            first, *rest = _CUT.split(text[at:end])
            n += (self._part(first) if first else 0) + sum(map(self.__getitem__, rest))
            at = end
        return n

    def count(self, text: str) -> int:
        parts = self.special.split(text) if self.special else [text]
        return len(parts) - 1 + sum(map(self._plain, parts))


_counters: dict[str, TokenCounter] = {}


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) of every row of docs."""
    whole = docs.sparkSession.sparkContext.broadcast(prove(tokenizer_path))

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer_path not in _counters:
            _counters[tokenizer_path] = TokenCounter(tokenizer_path, whole.value)
        of = _counters[tokenizer_path].count
        for batch in it:
            texts = batch.column(1)
            tokens = pa.array([of(t.as_py()) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pc.binary_length(texts).cast(pa.int64()), tokens, pc.greater(tokens, limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(F.col("doc_id").cast("bigint"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(count, "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean")
