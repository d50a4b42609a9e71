"""Best-fit packing of tokenized documents into fixed-length sequences, with swap-based local search.

A document's ids (its own, then an end id) are cut into pieces of at most `capacity` tokens.
Pieces are dealt into groups of bounded size by a hash of their row number in the stored table, so
that no group depends on what the pieces hold. Each group is packed best fit, longest first; then a
local search exchanges pieces between underfull bins (move, one-for-one, two-for-one) as long as the
sum of squared fills grows, until bins empty. A group is one task's work; the only loss against
packing all pieces at once is the last, partly filled bins of each group.

Nulls: a null text is an empty one (its only token is the end id); a null doc_id is carried.
Repeated rows are packed once each. A text of any length is encoded whole and cut into pieces. Ties go
by row number. Only doc_id and text are read, so other columns may have any names. An empty table
gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_letters, store

CAPACITY = 2048
GROUP_PIECES = 20_000
#: Donors in a row that may fail before the local search of a group ends.
PATIENCE = 40
#: Entries that a worker's two caches hold before they are emptied; results don't depend on it.
CACHE_ENTRIES = 400_000

_PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"

#: Chunks of these characters only (ASCII and Latin-1 letters) are split here, as the vocabulary file's pattern does.
_SIMPLE = re.compile(r"[\x21-\x7eÀ-ÖØ-öø-ÿ]+")
_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")


class ChunkEncoder(dict):
    """Ids (little-endian bytes) of text chunks between white space, encoded once each.

    No id of the vocabulary spans white space, so a text's ids are its chunks' ids in order.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenize = self.tokenizer.model.tokenize
        self.letters = byte_letters()
        self.id_bytes = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size() + 1)]
        self.parts: dict[str, bytes] = {}

    def _part(self, part: str) -> bytes:
        got = self.parts.get(part)
        if got is None:
            if len(self.parts) >= CACHE_ENTRIES:
                self.parts.clear()
            spelled = part if part.isascii() else "".join([self.letters[b] for b in part.encode()])
            ids = self.id_bytes
            got = self.parts[part] = b"".join([ids[t.id] for t in self.tokenize(spelled)])
        return got

    def __missing__(self, chunk: bytes) -> bytes:
        text = chunk.decode(errors="replace")
        if _SIMPLE.fullmatch(text) and "<|" not in text:
            part = self._part
            got = b"".join([part(p) for p in _SPLIT.findall(text.lower())])
        else:
            got = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        self[chunk] = got
        return got

    def encode(self, text: bytes) -> bytes:
        return b"".join(map(self.__getitem__, text.split()))


_encoders: dict[str, ChunkEncoder] = {}


def _encoder(path: str) -> ChunkEncoder:
    if path not in _encoders:
        _encoders[path] = ChunkEncoder(path)
    return _encoders[path]


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32."""
    end = end_id.to_bytes(4, "little")
    step = 4 * capacity

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(tokenizer_path).encode
        for batch in it:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encode(text or b"") + end
                rows += [(doc_id, k, at // 4, (min(at + step, len(ids)) - at) // 4, zlib.crc32(ids[at : at + step])) for k, at in enumerate(range(0, len(ids), step))]
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("binary").alias("text")).mapInArrow(cut, _PIECES)


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins (lists of indexes), longest first, each into the fullest bin that has room."""
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_rooms = 0  # bit r: some bin has r free
    bins: list[list[int]] = []
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        fits = open_rooms >> size
        if fits:
            r = size + (fits & -fits).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                open_rooms &= ~(1 << r)
        else:
            r, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        left = r - size
        if left:
            room[left].append(b)
            open_rooms |= 1 << left
    return bins


def _exchange(mine: np.ndarray, size: np.ndarray, room: np.ndarray) -> tuple[tuple[int, ...], int, int] | None:
    """(pieces out of the donor, piece into it or -1, a piece of the bin they go to): the exchange that leaves the least room there.

    mine: the donor's pieces; room: of each piece's bin, what it can take besides, below zero where
    it may take nothing. A piece moves where it fits; else one or two pieces go against a shorter one.
    """
    theirs = np.flatnonzero(room >= 0)
    if not len(theirs):
        return None
    mine = mine[np.argsort(size[mine], kind="stable")]
    own = size[mine]
    best: tuple[int, tuple[int, ...], int, int] | None = None

    def offer(sums: np.ndarray, back: np.ndarray | int, pieces, swapped: bool) -> None:
        """sums: ascending sizes that may leave; back: sizes that come instead."""
        nonlocal best
        most = back + room[theirs]
        k = np.searchsorted(sums, most, "right") - 1
        waste = np.where((k >= 0) & (sums[np.maximum(k, 0)] > back), most - sums[np.maximum(k, 0)], np.iinfo(np.int64).max)
        at = int(np.argmin(waste))
        if waste[at] < (np.iinfo(np.int64).max if best is None else best[0]):
            there = int(theirs[at])
            best = (int(waste[at]), pieces(int(k[at])), there if swapped else -1, there)

    offer(own, 0, lambda k: (int(mine[k]),), False)
    if best is None:
        offer(own, size[theirs], lambda k: (int(mine[k]),), True)
        if len(mine) > 1:
            a, b = np.triu_indices(len(mine), 1)
            order = np.argsort(own[a] + own[b], kind="stable")
            a, b = a[order], b[order]
            offer(own[a] + own[b], size[theirs], lambda k: (int(mine[a[k]]), int(mine[b[k]])), True)
    return None if best is None else best[1:]


def local_search(bins: list[list[int]], lengths: np.ndarray, capacity: int, patience: int = PATIENCE) -> list[list[int]]:
    """Empty the least filled bins by exchanges that each increase the sum of squared fills.

    The donor is the emptiest bin not tried yet. Its pieces move into another bin with room, or go
    one-for-one against a shorter piece, or two-for-one against a piece shorter than both together,
    always into a bin at least as full as the donor; so the donor's fill falls with every exchange, and
    each donor comes to an end. The search ends when the other bins' room together can't take the
    emptiest donor, so that no bin can be emptied any more, or after `patience` donors in a row that
    could not be emptied.
    """
    fills = [sum(int(lengths[i]) for i in b) for b in bins]
    full = [b for b, f in zip(bins, fills, strict=True) if f == capacity]
    loose = [list(b) for b, f in zip(bins, fills, strict=True) if f < capacity]
    if len(loose) < 2:
        return bins
    fill = np.array([f for f in fills if f < capacity])
    item = np.array([i for b in loose for i in b])
    home = np.array([k for k, b in enumerate(loose) for _ in b])
    size = lengths[item].astype(np.int64)
    live, tried = np.ones(len(loose), bool), np.zeros(len(loose), bool)
    failed = 0
    while failed < patience:
        left = np.flatnonzero(live & ~tried)
        if not len(left):
            break
        donor = int(left[np.argmin(fill[left])])
        if fill[donor] > (capacity - fill[live]).sum() - (capacity - fill[donor]):
            break
        while len(mine := np.flatnonzero(home == donor)):
            room = np.where(live & (fill >= fill[donor]), capacity - fill, -1)
            room[donor] = -1
            found = _exchange(mine, size, room[home])
            if found is None:
                break
            out, back, there = found
            b = int(home[there])
            gain = int(size[list(out)].sum()) - (int(size[back]) if back >= 0 else 0)
            home[list(out)] = b
            if back >= 0:
                home[back] = donor
            fill[b] += gain
            fill[donor] -= gain
        live[donor] = fill[donor] > 0
        tried[donor] = True
        failed = failed + 1 if live[donor] else 0
    packed: dict[int, list[int]] = {}
    for i, h in zip(item.tolist(), home.tolist(), strict=True):
        packed.setdefault(h, []).append(i)
    return full + list(packed.values())


def pack(cut: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Adds sequence_id and offset to pieces(); cut must be a stored table, as it is read twice."""
    groups = max(1, -(-cut.count() // group_pieces))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        lengths = pdf["length"].to_numpy()
        group = int(pdf["grp"].iloc[0])
        sequence = np.zeros(len(pdf), np.int64)
        offset = np.zeros(len(pdf), np.int64)
        for k, members in enumerate(local_search(best_fit(lengths, capacity), lengths, capacity)):
            sequence[members] = (group << 32) + k
            offset[members] = np.cumsum(lengths[members]) - lengths[members]
        return pdf.drop(columns="grp").assign(sequence_id=sequence, offset=offset)

    dealt = cut.withColumn("grp", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))
    return dealt.groupBy("grp").applyInPandas(fit, f"{_PIECES}, sequence_id bigint, offset bigint")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    return pack(store(pieces(docs, tokenizer_path, capacity), "pieces"), capacity)
