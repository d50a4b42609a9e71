"""Toxic passages as maximum-scoring segments of token log-odds.

Fit: over a bounded sample of labelled documents, every letter run of a word and the word itself
(bounded by `^` and `$`) is a feature; its log-odds between toxic and clean documents carry an
informative Dirichlet prior (the features' shares in both together), and a feature counts only
if its likelihood ratio against equal shares is far beyond chance. A word scores as its best feature,
and a word without one as OTHER, a little below zero, so that sums drift down in clean text.

Score: one linear scan finds all maximal scoring segments of a document (Ruzzo and Tompa). A word
below zero costs OTHER, so a passage ends where some 15 words without a telling feature follow a telling one, and 30 after three. The
chance of a best segment this high in a clean text of that many words follows the extreme-value
law 1 - exp(-K n exp(-lambda s)); lambda solves the scores' moment equation on clean documents
that the fit did not see and K matches their best segments. The chance of the r best together follows
from the same law (Karlin and Altschul's sum statistic); the least of these chances counts, each
divided by its share 1/2, 1/4, 1/8 and so on of the tries. The document's score is the posterior
1 / (1 + p (1 - prior) / prior), so a text without evidence gets at most the prior.

Null, empty and wordless texts have no segment: p = 1, the score is the prior; long texts are scanned
whole. A table of labels without both classes gives a model without features, and every score is
the prior. Repeated rows are scored each, and repeated labelled texts are counted once. Of features
no two are tied: each counts by its own ratio. Only doc_id and text are read, so other columns may have
any names. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_held_out, store
from .labelled import training_rows

PER_CLASS = 4000
#: Features beyond which a model is refused as too large to broadcast; fewer labelled rows a class make it smaller. None is ever left out.
MOST_FEATURES = 500_000
#: Weight of the Dirichlet prior, in documents, and log-odds below which a feature tells nothing.
PRIOR_DOCS, LEAST_ODDS = 20.0, 4.0
#: Toxic documents that must show a feature. Its log likelihood ratio against equal shares must pass the log of the number of features tried, and this more.
LEAST_DOCS, MARGIN = 4, 1.0
MAX_SCORE = 8.0
#: Score of a word without a telling feature: passages end where such words outweigh.
OTHER = -0.6
#: Best segments that may count together.
TOGETHER = 8
PRIOR = 0.1
CUTOFF = 0.7
GRAMS = (4, 5)
_EDGE = ".,;:!?\"'()[]{}<>#$%&*|+-_=/\\~^`@…«»“”„’‘"


def features_of(word: str) -> set[str]:
    word = word.strip(_EDGE)
    if len(word) < 3:
        return set()
    return {f"^{word}$", *(word[i : i + n] for n in GRAMS for i in range(len(word) - n + 1))}


@dataclass
class ToxicModel:
    weights: dict[str, float]
    other: float  # score of a word without a telling feature
    rate: float  # lambda
    scale: float  # K

    def word_score(self, word: str) -> float:
        return max((self.weights[f] for f in features_of(word) if f in self.weights), default=self.other)

    def score(self, sums: list[float], n: int) -> float:
        """Of a text of n words with segments of these sums."""
        if n <= 0 or not sums:
            return PRIOR
        least, total = 1.0, 0.0
        for r, s in enumerate(sorted(sums, reverse=True)[:TOGETHER], 1):
            x = self.rate * s - math.log(self.scale * n)
            total += x
            if r == 1:
                p = -math.expm1(-math.exp(min(-x, 50)))
            elif total > r:  # the tail's form holds beyond its mode
                p = math.exp(-total + (r - 1) * math.log(total) - math.lgamma(r + 1) - math.lgamma(r))
            else:
                continue
            least = min(least, p * 2**r)
        return 1 / (1 + least * (1 - PRIOR) / PRIOR)


class WordScores(dict):
    """Scores of the words met so far; emptied when large."""

    def __init__(self, model: ToxicModel, most: int = 400_000):
        super().__init__()
        self.model, self.most = model, most

    def __missing__(self, word: str) -> float:
        if len(self) >= self.most:
            self.clear()
        got = self[word] = self.model.word_score(word)
        return got


def maximal_segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, sum), left to right, in linear time.

    Each segment remembers the nearest one before it that starts lower, so a new segment passes over
    those that start higher once: from then on its own link passes over them.
    """
    segments: list[tuple[int, int, float, float, int]] = []  # start, end, sum before it, sum through it, link
    total = 0.0
    for i, s in enumerate(scores):
        before, total = total, total + s
        if s <= 0:
            continue
        start, low, at = i, before, len(segments) - 1
        while True:
            while at >= 0 and segments[at][2] >= low:
                at = segments[at][4]
            if at < 0 or segments[at][3] >= total:
                break
            # together with what lies between, the two are one better segment
            start, _, low, _, link = segments[at]
            del segments[at:]
            at = link
        segments.append((start, i + 1, low, total, at))
    return [(a, b, hi - lo) for a, b, lo, hi, _ in segments]


def _scored(words: list[str], scores: WordScores) -> tuple[list[tuple[int, int, float]], int]:
    """Segments of a text by runs: only the telling words are visited, stretches between them at once."""
    values = list(map(scores.__getitem__, words))
    other = scores.model.other
    hits = [i for i, v in enumerate(values) if v > 0]
    if not hits:
        return [], len(words)
    line: list[float] = []
    at: list[int] = []
    last = -1
    for i in hits:
        gap = i - last - 1
        if gap and last >= 0:
            line.append(sum(values[last + 1 : i]) if other != 0 else 0.0)
            at.append(last + 1)
        line.append(values[i])
        at.append(i)
        last = i
    return [(at[a], at[b - 1] + 1, s) for a, b, s in maximal_segments(line)], len(words)


def fit(docs: DataFrame, labels: DataFrame, column: str = "toxic", per_class: int = PER_CLASS) -> ToxicModel:
    rows = store(training_rows(docs, labels, column, per_class).withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(3))), "toxic")

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents that show each feature, by label, summed over the task's rows before they are shuffled."""
        names = ["feature", "label", "docs", "words"]
        types = [pa.string(), pa.int32(), pa.int64(), pa.int64()]
        found: dict[int, Counter] = {0: Counter(), 1: Counter()}
        words: Counter = Counter()

        def out() -> Iterator[pa.RecordBatch]:
            flat = [(f, y, n, 0) for y in (0, 1) for f, n in found[y].items()] + [("", y, n, words[f"n{y}"]) for y, n in ((0, words[0]), (1, words[1])) if n]
            for y in (0, 1):
                found[y].clear()
            words.clear()
            for k in range(0, len(flat), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*flat[k : k + 50_000], strict=True), types, strict=True)], names)

        for batch in it:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                unique = text.lower().split()
                words[label] += 1
                words[f"n{label}"] += len(unique)
                found[label].update(set().union(*map(features_of, set(unique))))
            if len(found[0]) + len(found[1]) > 500_000:
                yield from out()
        yield from out()

    counted = rows.where("part <> 0").select("text", "label").mapInArrow(count, "feature string, label int, docs bigint, words bigint")
    table = counted.groupBy("feature").agg(*[F.sum(F.when(F.col("label") == y, F.col(c)).otherwise(0)).alias(f"{c}{y}") for c in ("docs", "words") for y in (0, 1)])
    total = table.where("feature = ''").first()
    if total is None or not total["docs0"] or not total["docs1"]:
        return ToxicModel({}, OTHER, 1.0, 1.0)
    n0, n1 = total["docs0"], total["docs1"]
    share = n1 / (n0 + n1)
    both = F.col("docs0") + F.col("docs1")
    own = F.col("docs1") / both
    divergence = own * F.log(own / share) + F.when(own < 1, (1 - own) * F.log((1 - own) / (1 - share))).otherwise(0.0)
    tried = store(table.where((F.col("feature") != "") & (F.col("docs1") >= LEAST_DOCS)).select("feature", "docs0", "docs1", (both * divergence).alias("ratio"), own.alias("own")), "features")
    best = tried.where(F.col("own") > share).where(F.col("ratio") >= math.log(max(1, tried.count())) + MARGIN)
    if best.count() > MOST_FEATURES:
        raise ValueError(f"more than {MOST_FEATURES} telling features; take fewer labelled rows a class")
    weights = {}
    for r in best.collect():
        # the prior holds both classes' documents in proportion, so a rare feature's odds shrink towards even
        prior = (r["docs0"] + r["docs1"]) / (n0 + n1) * PRIOR_DOCS
        a, b = r["docs1"] + prior, r["docs0"] + prior
        odds = math.log(a / (n1 + PRIOR_DOCS - a)) - math.log(b / (n0 + PRIOR_DOCS - b)) if a < n1 + PRIOR_DOCS and b < n0 + PRIOR_DOCS else 0.0
        if odds >= LEAST_ODDS:
            weights[r["feature"]] = min(odds, MAX_SCORE)
    model = ToxicModel(weights, OTHER, 1.0, 1.0)
    return calibrate(model, rows.where("part = 0 and label = 0").select("text"))


def calibrate(model: ToxicModel, clean: DataFrame) -> ToxicModel:
    """lambda and K from clean documents: how often words score, and how high their best segments reach."""
    spark = clean.sparkSession
    weights = spark.sparkContext.broadcast(model)

    def scan(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = WordScores(weights.value)
        for batch in it:
            out = []
            for text in batch.column(0).to_pylist():
                words = text.lower().split()
                segments, n = _scored(words, scores)
                hits = Counter(round(scores[w] * 2) / 2 for w in words if scores[w] > 0)
                out.append((n, max((s for *_, s in segments), default=0.0), list(hits), list(hits.values())))
            cols = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.int64())), strict=True)], ["n", "best", "value", "times"])

    seen = clean.mapInArrow(scan, "n bigint, best double, value array<double>, times array<bigint>").collect()  # at most per_class rows
    n = sum(r["n"] for r in seen)
    values: Counter = Counter()
    for r in seen:
        for v, k in zip(r["value"], r["times"], strict=True):
            values[v] += k
    values[MAX_SCORE / 2] += 1  # a word this telling is assumed once more than it was seen
    n += 1
    shares = {v: k / n for v, k in values.items()}
    rest = max(1e-9, 1 - sum(shares.values()))
    moment = lambda x: rest * math.exp(x * model.other) + sum(p * math.exp(x * v) for v, p in shares.items()) - 1
    low, high = 1e-6, 20.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if moment(mid) < 0 else (low, mid)
    rate = max(0.2, min(low, 5.0))
    # K: the law gives the share of clean texts that reached the lowest best segment seen
    hits = [r["best"] for r in seen if r["best"] > 0]
    scale = max(1, len(hits)) / n * math.exp(rate * min(hits, default=1.0))
    return ToxicModel(model.weights, model.other, rate, scale)


def score(docs: DataFrame, model: ToxicModel) -> DataFrame:
    """doc_id, held_out, score, predicted, then the segments that are significant by themselves (start and end word, sum)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = "doc_id bigint, held_out boolean, score double, predicted int, segments array<struct<start:bigint,stop:bigint,score:double>>"

    def scan(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        scores = WordScores(own)
        passage = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("score", pa.float64())]))
        for batch in it:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                segments, n = _scored((text or "").lower().split(), scores)
                value = own.score([s for *_, s in segments], n)
                telling = [{"start": a, "stop": b, "score": s} for a, b, s in segments if own.score([s], n) >= CUTOFF]
                out.append((doc_id, doc_id is not None and crc_held_out(doc_id), value, int(value >= CUTOFF), telling))
            cols = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.bool_(), pa.float64(), pa.int32(), passage), strict=True)], ["doc_id", "held_out", "score", "predicted", "segments"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(scan, schema)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, fit(docs, labels))
