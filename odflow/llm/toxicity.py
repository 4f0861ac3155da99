"""Toxic passages as maximum-scoring segments.

Words and their beginnings are scored by the log-odds of occurring in toxic against clean
documents, with an informative Dirichlet prior, lowered by their uncertainty; any other
word costs a little. One linear scan finds every segment that no longer one beats.
A segment of score s in a text of n words is expected K n exp(-s) times by chance
(extreme-value theory; log-odds have the decay 1), K being fitted to the clean documents.
Evidence of the significant segments, added up, becomes a probability by logistic
regression.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from odflow.llm.common import cut, few, memo, slices, small, unused

#: Lengths of the beginnings of words that are scored besides whole words.
STEMS = range(3, 9)
PRIOR_WORDS = 1000.0
LEAST_PRIOR = 0.5
MIN_Z, MIN_TOXIC = 3.0, 3
#: Standard deviations by which log-odds are lowered, and the cost of any other word.
CAUTION, COST = 1.0, 0.25
#: Scored words and stems that are broadcast; more stay a table, which words are joined with.
MAX_UNITS = 50_000
#: Rows that fit the regression.
MAX_FIT_ROWS = 20_000
SIGNIFICANT = 0.1
THRESHOLD = 0.7
REMEMBERED = 100_000
#: Bytes of text whose words are held at a time.
SLICE = 500_000

WORD = re.compile(r"[^\W\d_]+")
PASSAGE = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("expected", pa.float64())])
SCORED = pa.struct([("score", pa.float64()), ("passages", pa.list_(PASSAGE))])


@dataclass
class Model:
    #: Scores of words and beginnings; a table (unit, s) if they are too many to broadcast.
    units: dict[str, float] | DataFrame
    k: float
    weights: list[float]


class _Words(dict):
    """Score of each word: the best of the word itself and its beginnings, else nothing."""

    def __init__(self, units: dict[str, float]) -> None:
        super().__init__()
        self.units = units

    def __missing__(self, word: str) -> float:
        own = [word, *(word[:n] + "*" for n in STEMS if n < len(word))]
        if len(self) >= REMEMBERED:
            self.clear()
        value = self[word] = max((self.units.get(u, 0.0) for u in own), default=0.0)
        return value


def _remembered(model: str, units: dict[str, float]) -> _Words:
    """The words of a model, kept for the later tasks of a worker; it keeps those of one model."""
    held = memo("toxic words", dict)
    if model not in held:
        held.clear()
        held[model] = _Words(units)
    return held[model]


def _words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch.column(1), SLICE, batch.column(0)):
            texts, rows = part
            own = [set(WORD.findall((t or "").lower())) for t in texts.to_pylist()]
            yield pa.record_batch(
                [
                    pa.array([r for r, words in zip(rows.to_pylist(), own) for _ in words], pa.int64()),
                    pa.array([w for words in own for w in words], pa.string()),
                ],
                ["row", "word"],
            )


def _stems(word: str) -> Column:
    """The word itself and its beginnings, as units."""
    stems = [F.when(F.length(word) > n, F.concat(F.substring(word, 1, n), F.lit("*"))) for n in STEMS]
    return F.array_compact(F.array(word, *stems))


def _with_scores(rows: DataFrame, text: str, units: DataFrame, scores: str) -> DataFrame:
    """Add the map ``scores`` of every row's scored words, by joins that shuffle."""
    row = unused("_row", rows)
    rows = cut(rows.withColumn(row, F.monotonically_increasing_id()))
    words = cut(rows.select(row, F.col(text)).mapInArrow(_words_of, "row bigint, word string"))
    scored = (
        words.select("word").distinct()
        .select("word", F.explode(_stems("word")).alias("unit"))
        .join(units, "unit")
        .groupBy("word")
        .agg(F.max("s").alias("s"))
    )
    maps = (
        words.join(scored, "word")
        .groupBy(F.col("row").alias(row))
        .agg(F.map_from_entries(F.collect_list(F.struct("word", "s"))).alias(scores))
    )
    return rows.join(maps, row, "left").drop(row)


def segments(hits: list[tuple[int, float]], cost: float = COST) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score), in one pass over the scored words.

    ``hits`` are places and positive scores; every word between them costs ``cost``. A
    list of candidates is kept with the totals before and behind each; a new one
    swallows earlier candidates when their union scores more than either. Each knows the
    last candidate before it with a smaller total before, so that none is passed twice.
    """
    # start, end, total before, total behind, last candidate with a smaller total before
    out: list[tuple[int, int, float, float, int]] = []
    total, last = 0.0, 0
    for place, score in hits:
        total -= cost * (place - last)
        last = place + 1
        start, before, total = place, total, total + score
        j = len(out) - 1
        while True:
            while j >= 0 and out[j][2] >= before:
                j = out[j][4]
            if j < 0 or out[j][3] >= total:
                break
            start, _, before, _, k = out[j]
            del out[j:]
            j = k
        out.append((start, place + 1, before, total, j))
    return [(a, b, behind - before) for a, b, before, behind, _ in out]


def _evidence(expected: float) -> float:
    """Minus log of the probability to see such a segment by chance."""
    return -math.log(-math.expm1(-expected)) if expected > 1e-12 else -math.log(max(expected, 1e-300))


def _scan(words: dict[str, float], text: str | None) -> tuple[int, list[tuple[int, int, float]]]:
    own = WORD.findall((text or "").lower())
    return len(own), segments([(i, s) for i, s in enumerate(map(words.__getitem__, own)) if s > 0])


def _signals(n: int, found: list[tuple[int, int, float]], k: float) -> list[float]:
    best = max((s for _, _, s in found), default=0.0)
    expected = [k * n * math.exp(-s) for _, _, s in found]
    strong = [e for e in expected if e <= SIGNIFICANT]
    return [1.0, math.log1p(sum(map(_evidence, strong))), math.log1p(len(strong)), best / 10]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counted = Counter(), Counter()
        for texts, labels in slices(batch.column(0), SLICE, batch.column(1)):
            for text, label in zip(texts.to_pylist(), labels.to_pylist()):
                counted[label].update(set(WORD.findall((text or "").lower())))
        words = list(counted[0].keys() | counted[1].keys())
        yield pa.record_batch(
            [
                pa.array(words, pa.string()),
                pa.array([counted[1][w] for w in words], pa.int64()),
                pa.array([counted[0][w] for w in words], pa.int64()),
            ],
            ["word", "toxic", "clean"],
        )


def _units(labelled: DataFrame) -> dict[str, float] | DataFrame:
    words = labelled.mapInArrow(_counts, "word string, toxic bigint, clean bigint")
    words = cut(few(words.groupBy("word").agg(F.sum("toxic").alias("y1"), F.sum("clean").alias("y0"))))
    n1, n0 = words.agg(F.sum("y1"), F.sum("y0")).first()
    if not n1 or not n0:
        return {}
    units = (
        words.select(F.explode(_stems("word")).alias("unit"), "y1", "y0")
        .groupBy("unit")
        .agg(F.sum("y1").alias("y1"), F.sum("y0").alias("y0"))
        .filter(F.col("y1") >= MIN_TOXIC)
    )
    share = (F.col("y1") + F.col("y0")) / (n1 + n0)
    a = F.greatest(share * PRIOR_WORDS, F.lit(LEAST_PRIOR))
    odds = lambda y, n: F.log(y + a) - F.log(F.lit(float(n)) + PRIOR_WORDS - y - a)
    spread = F.sqrt(1 / (F.col("y1") + a) + 1 / (F.col("y0") + a))
    delta = odds(F.col("y1"), n1) - odds(F.col("y0"), n0)
    scored = units.select("unit", (delta - CAUTION * spread).alias("s"), (delta / spread).alias("z"))
    scored = cut(few(scored.filter((F.col("z") >= MIN_Z) & (F.col("s") > 0)).select("unit", "s")))
    if scored.count() > MAX_UNITS:
        return scored
    return {r["unit"]: r["s"] for r in scored.collect()}


def _regression(x: np.ndarray, y: np.ndarray) -> list[float]:
    """Logistic regression with a weak ridge, by Newton steps."""
    w, ridge = np.zeros(x.shape[1]), np.diag([1e-6] + [0.05] * (x.shape[1] - 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(
            (x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w
        )
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w.tolist()


def fit(documents: DataFrame, labels: DataFrame, *, id: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Learn from documents labelled 0 or 1, whole and all of them.

    Copies count once. Only the regression and K are fitted to a sample, the
    ``MAX_FIT_ROWS`` rows with the smallest hash. Without labels of both kinds there are
    no scored words, and every text gets the same score.
    """
    known = labels.filter(F.col(label).isin(0, 1) & F.col(id).isNotNull())
    known = known.groupBy(F.col(id).alias("id")).agg(F.max(label).cast("int").alias("y"))
    rows = documents.select(F.col(id).alias("id"), F.col(text).alias("text")).join(small(known), "id")
    single = rows.groupBy(F.md5(F.col("text").cast("binary"))).agg(F.min("id").alias("id")).select("id")
    rows = rows.join(small(cut(few(single))), "id", "left_semi")
    units = _units(rows.select("text", "y"))

    hashed = rows.select("text", F.xxhash64("id").alias("h"), "y")
    joined = isinstance(units, DataFrame)
    if joined:
        hashed = _with_scores(hashed, "text", units, "scores")
    known_words = None if joined else units

    key = str(uuid.uuid4())

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = None if joined else _remembered(key, known_words)
        for batch in batches:
            for texts, *others in slices(batch.column(0), SLICE, *batch.columns[1:]):
                own = (defaultdict(float, m or ()) for m in others[2].to_pylist()) if joined else repeat(words)
                found = [_scan(w, t) for w, t in zip(own, texts.to_pylist())]
                yield pa.record_batch(
                    [
                        *others[:2],
                        pa.array([n for n, _ in found], pa.int64()),
                        pa.array([[float(s) for _, _, s in parts] for _, parts in found], pa.list_(pa.float64())),
                    ],
                    ["h", "y", "n", "parts"],
                )

    scanned = hashed.mapInArrow(scan, "h bigint, y int, n bigint, parts array<double>")
    sample = scanned.orderBy("h").limit(MAX_FIT_ROWS).toPandas()
    y = sample["y"].to_numpy(float) if len(sample) else np.zeros(0)
    if not len(y) or not 0 < y.sum() < len(y):
        return Model({}, 1.0, [math.log((y.sum() + 1) / (len(y) - y.sum() + 1)), 0.0, 0.0, 0.0])
    clean = sample[y == 0]
    chance = sum(n * math.exp(-max(p, default=0.0)) for n, p in zip(clean["n"], clean["parts"]))
    k = len(clean) / max(chance, 1.0)
    x = np.array([_signals(n, [(0, 0, s) for s in p], k) for n, p in zip(sample["n"], sample["parts"])])
    return Model(units, k, _regression(x, y))


def toxicity(documents: DataFrame, model: Model, *, text: str = "text", result: str = "toxicity") -> DataFrame:
    """Add the struct ``result`` (score, passages) to every document.

    ``passages`` are the significant segments, ranges of words (end exclusive) with score
    and expected number by chance. Null and empty texts have none and get the score of
    a text without evidence. A column called like ``result`` is replaced.
    """
    joined = isinstance(model.units, DataFrame)
    scores = unused("_scores", documents)
    if joined:
        documents = _with_scores(documents, text, model.units, scores)
    weights, k = model.weights, model.k
    shared = documents.sparkSession.sparkContext.broadcast({} if joined else model.units)

    def row(n: int, found: list[tuple[int, int, float]]) -> dict:
        logit = sum(a * b for a, b in zip(weights, _signals(n, found, k)))
        passages = [{"start": a, "end": b, "score": s, "expected": k * n * math.exp(-s)} for a, b, s in found]
        strong = [p for p in passages if p["expected"] <= SIGNIFICANT]
        return {"score": 1 / (1 + math.exp(-max(-30.0, min(30.0, logit)))), "passages": strong}

    key = str(uuid.uuid4())

    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        words = _remembered(key, shared.value)
        for batch in batches:
            yield pa.array([row(*_scan(words, t)) for part in slices(batch, SLICE) for t in part.to_pylist()], SCORED)

    def score_joined(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for batch in batches:
            found = []
            for texts, maps in slices(batch[0], SLICE, batch[1]):
                own = (defaultdict(float, m or ()) for m in maps.to_pylist())
                found += [row(*_scan(w, t)) for w, t in zip(own, texts.to_pylist())]
            yield pa.array(found, SCORED)

    kind = "struct<score: double, passages: array<struct<start: int, end: int, score: double, expected: double>>>"
    if joined:
        return documents.withColumn(result, F.arrow_udf(score_joined, kind)(text, scores)).drop(scores)
    return documents.withColumn(result, F.arrow_udf(score, kind)(text))


def without_toxic(documents: DataFrame, model: Model, *, threshold: float = THRESHOLD, **options) -> DataFrame:
    """The documents that score below the threshold, with their own columns."""
    result = unused("_toxicity", documents)
    scored = toxicity(documents, model, result=result, **options)
    return scored.filter(F.col(f"{result}.score") < threshold).select(
        *(F.col(f"`{c}`") for c in documents.columns)
    )
