"""Quality by attention-based multiple-instance learning.

A document is a bag of passages. Every passage is encoded by a small network from counts
of its characters and words; gated attention, learned from labels of whole documents,
weighs the passages; the weighted representation is scored. Encoder, gates and scorer are
trained together by gradient descent on a bounded sample of the labelled documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from odflow.llm.common import small

PASSAGE_WORDS = 128
#: Labelled documents, those with the smallest hash, that the network is trained on.
MAX_FIT_ROWS = 4000
HIDDEN, GATES, STEPS, RATE, DECAY = 16, 8, 400, 0.02, 1e-4

#: Class of each byte: 0 others, 1 a-z, 2 A-Z, 3 digits, 4 .,;:'"-()? 5 !, 6 |, 7 other signs, 8 beyond ASCII.
CLASSES = np.array(
    [
        8 if b > 127
        else 1 if 97 <= b <= 122
        else 2 if 65 <= b <= 90
        else 3 if 48 <= b <= 57
        else 4 if chr(b) in ".,;:'\"-()?"
        else 5 if chr(b) == "!"
        else 6 if chr(b) == "|"
        else 7 if 33 <= b <= 126
        else 0
        for b in range(256)
    ],
    np.uint8,
)
N_FEATURES = 14


def features(text: bytes | None) -> np.ndarray:
    """One row for each passage, one row of zeros for a text without words."""
    words = text.split() if text else []
    rows = np.zeros((max(1, -(-len(words) // PASSAGE_WORDS)), N_FEATURES))
    for row, at in zip(rows, range(0, len(words), PASSAGE_WORDS)):
        own = words[at : at + PASSAGE_WORDS]
        n, blob = len(own), b"".join(own)
        row[:9] = np.bincount(CLASSES[np.frombuffer(blob, np.uint8)], minlength=9) / len(blob)
        row[9] = np.log(len(blob) / n)
        row[10] = len(set(own)) / n
        row[11] = sum(map(eq, own, own[1:])) / n
        row[12] = np.log(n) / np.log(PASSAGE_WORDS)
        row[13] = len(set(blob)) / 64
    return rows


class Network:
    """Encoder, gated attention and scorer; bags are runs of rows that begin at ``starts``."""

    NAMES = "W b V U w c d"

    def __init__(self, seed: int = 0) -> None:
        rng = np.random.default_rng(seed)
        draw = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
        self.mean, self.scale = np.zeros(N_FEATURES), np.ones(N_FEATURES)
        self.p = {
            "W": draw(N_FEATURES, HIDDEN),
            "b": np.zeros(HIDDEN),
            "V": draw(HIDDEN, GATES),
            "U": draw(HIDDEN, GATES),
            "w": draw(GATES),
            "c": draw(HIDDEN),
            "d": np.zeros(1),
        }

    def _forward(self, x: np.ndarray, starts: np.ndarray):
        p, bag = self.p, np.repeat(np.arange(len(starts)), np.diff([*starts, len(x)]))
        h = np.tanh(x @ p["W"] + p["b"])
        t, s = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-np.clip(h @ p["U"], -30, 30)))
        e = (t * s) @ p["w"]
        e = np.exp(e - np.maximum.reduceat(e, starts)[bag])
        a = e / np.add.reduceat(e, starts)[bag]
        z = np.add.reduceat(a[:, None] * h, starts)
        q = 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["d"], -30, 30)))
        return bag, h, t, s, a, z, q

    def attend(self, x: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Score of each bag and attention of each passage."""
        _, _, _, _, a, _, q = self._forward((x - self.mean) / self.scale, starts)
        return q, a

    def _gradients(self, x: np.ndarray, starts: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        bag, h, t, s, a, z, q = self._forward(x, starts)
        g = (q - y) / len(y)
        gz = g[:, None] * p["c"]
        gh = a[:, None] * gz[bag]
        ga = (h * gz[bag]).sum(1)
        ge = a * (ga - np.add.reduceat(a * ga, starts)[bag])
        gt = ge[:, None] * p["w"] * s * (1 - t * t)
        gs = ge[:, None] * p["w"] * t * s * (1 - s)
        gh += gt @ p["V"].T + gs @ p["U"].T
        gx = gh * (1 - h * h)
        return {
            "W": x.T @ gx,
            "b": gx.sum(0),
            "V": h.T @ gt,
            "U": h.T @ gs,
            "w": (t * s).T @ ge,
            "c": z.T @ g,
            "d": np.array([g.sum()]),
        }

    def train(self, bags: list[np.ndarray], y: np.ndarray) -> None:
        x = np.concatenate(bags)
        starts = np.cumsum([0] + [len(b) for b in bags[:-1]])
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-3
        x = (x - self.mean) / self.scale
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        for step in range(1, STEPS + 1):
            for k, g in self._gradients(x, starts, y).items():
                g = g + DECAY * self.p[k]
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                self.p[k] = self.p[k] - RATE * (first[k] / (1 - 0.9**step)) / (
                    np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8
                )


def _encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        yield pa.array([features(t).ravel() for t in batch.to_pylist()], pa.list_(pa.float64()))


def fit(documents: DataFrame, labels: DataFrame, *, id: str = "doc_id", text: str = "text", label: str = "quality") -> Network:
    """Train on documents labelled 0 or 1; without any the network is left as drawn."""
    known = labels.filter(F.col(label).isin(0, 1) & F.col(id).isNotNull())
    known = known.groupBy(F.col(id).alias("id")).agg(F.max(label).cast("int").alias("y"))
    # the rows are chosen by id before any text is read
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(MAX_FIT_ROWS)
    rows = documents.select(F.col(id).alias("id"), F.col(text).cast("binary").alias("text"))
    rows = rows.join(small(chosen), "id").select("id", "y", F.arrow_udf(_encode, "array<double>")("text").alias("x"))
    # one row for each id, whatever repeats
    sample = rows.groupBy("id").agg(F.min(F.struct("x", "y")).alias("r")).orderBy("id").select("r.*").collect()
    network = Network()
    if sample:
        bags = [np.array(r["x"]).reshape(-1, N_FEATURES) for r in sample]
        network.train(bags, np.array([r["y"] for r in sample], float))
    return network


RESULT = pa.struct([("score", pa.float64()), ("attention", pa.list_(pa.float64()))])


def quality(documents: DataFrame, network: Network, *, text: str = "text", result: str = "quality_score") -> DataFrame:
    """Add the struct ``result`` (score, attention of each passage) to every document.

    Passages are ``PASSAGE_WORDS`` words; a null or empty text is one passage of
    nothing. A column called like ``result`` is replaced.
    """
    shared = documents.sparkSession.sparkContext.broadcast(network)

    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = shared.value
        for batch in batches:
            bags = [features(t) for t in batch.to_pylist()]
            if not bags:
                yield pa.array([], RESULT)
                continue
            starts = np.cumsum([0] + [len(b) for b in bags[:-1]])
            q, a = own.attend(np.concatenate(bags), starts)
            parts = np.split(a, starts[1:])
            yield pa.array([{"score": s, "attention": w} for s, w in zip(q.tolist(), parts)], RESULT)

    scored = F.arrow_udf(score, "struct<score: double, attention: array<double>>")
    return documents.withColumn(result, scored(F.col(text).cast("binary")))
