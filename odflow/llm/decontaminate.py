"""Benchmark decontamination: a broadcast set of the test items' word windows.

The items are broadcast in blocks, of which a worker makes sorted arrays: the hash of
every distinct window and its place in the items' words, as ids in a vocabulary of the
items. Each task turns the words of its documents into the same ids, so that any word
foreign to all items ends a candidate at once, looks up the hash of every remaining
window, and verifies hits word by word. There is no shuffle. A worker keeps the arrays
of few blocks from one batch to the next, whatever the size of the benchmark.
"""

from __future__ import annotations

import pickle
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from odflow.llm.common import chunks, memo, slices, unused

WIDTH = 13
#: Words of benchmark items in one broadcast block, some 40 bytes each in a Python worker beside the distinct words.
BLOCK_WORDS = 1_000_000
CHUNK_BYTES = 4_000_000

#: Every byte outside words becomes a space, A-Z become a-z; bytes above 127 are parts of words.
NORMAL = bytes(
    c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32
    for c in range(256)
)
RESULT = "struct<n_words: bigint, spans: array<struct<start: int, end: int>>, items: array<string>>"
ARROW = pa.struct(
    [
        ("n_words", pa.int64()),
        ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
        ("items", pa.list_(pa.string())),
    ]
)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(NORMAL).split() if text else []


class Windows(NamedTuple):
    """Distinct windows of one length, by hash; ``items[first[g] : first[g + 1]]`` hold the g-th."""

    hashes: np.ndarray
    at: np.ndarray
    first: np.ndarray
    items: np.ndarray


class WindowIndex:
    """The windows of some items: places in their words, sorted by hash, for each length."""

    def __init__(self, items: list[tuple[str, bytes]], width: int) -> None:
        self.names = [item for item, _ in items]
        self.ids: dict[bytes, int] = {}
        own = []
        for _, text in items:
            words = words_of(text)
            own.append(np.array([self.ids.setdefault(w, len(self.ids) + 1) for w in words], np.int32))
        sizes = np.array([len(o) for o in own], np.int64)
        self.words = np.concatenate([np.empty(0, np.int32), *own])
        begin, lengths = np.cumsum(sizes) - sizes, np.minimum(sizes, width)
        self.tables = {
            int(n): self._windows(begin[lengths == n], sizes[lengths == n], np.flatnonzero(lengths == n), int(n))
            for n in np.unique(lengths[lengths > 0])
        }

    def _windows(self, begin: np.ndarray, sizes: np.ndarray, items: np.ndarray, length: int) -> Windows:
        counts = sizes - length + 1
        within = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        at, items = np.repeat(begin, counts) + within, np.repeat(items, counts)
        hashed = _hashed(self.words, at, length)
        order = np.argsort(hashed, kind="stable")
        at, items, hashed = at[order], items[order], hashed[order]
        fresh = np.ones(len(at), bool)
        fresh[1:] = (hashed[1:] != hashed[:-1]) | ~_equal(self.words, at[1:], self.words, at[:-1], length)
        first = np.flatnonzero(fresh)
        return Windows(hashed[first], at[first], np.append(first, len(at)), items)

    def named(self, length: int, groups: np.ndarray) -> set[str]:
        """The items that hold some of the windows."""
        table = self.tables[length]
        return {
            self.names[i]
            for g in np.unique(groups).tolist()
            for i in table.items[table.first[g] : table.first[g + 1]].tolist()
        }

    def occurrences(self, ids: np.ndarray) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
        """Starts, in order, and the windows found there, of one length; 0 is a foreign word."""
        foreign = np.concatenate(([0], np.cumsum(ids == 0)))
        for length, table in self.tables.items():
            if len(ids) < length:
                continue
            starts = np.flatnonzero(foreign[length:] == foreign[:-length])
            for at in np.array_split(starts, len(starts) // 200_000 + 1):
                hashed = _hashed(ids, at, length)
                group = np.searchsorted(table.hashes, hashed)
                known = table.hashes[np.minimum(group, len(table.hashes) - 1)] == hashed
                at, group = at[known], group[known]
                end = np.searchsorted(table.hashes, hashed[known], "right")
                while len(at):  # one round, but for distinct windows with one hash
                    same = _equal(self.words, table.at[group], ids, at, length)
                    yield at[same], length, group[same]
                    more = group + 1 < end
                    at, group, end = at[more], group[more] + 1, end[more]


def _hashed(words: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    out = np.zeros(len(at), np.uint64)
    for k in range(length):
        out = out * _BASE + words[at + k].astype(np.uint64)
    return out


def _equal(left: np.ndarray, i: np.ndarray, right: np.ndarray, j: np.ndarray, length: int) -> np.ndarray:
    same = np.ones(len(i), bool)
    for k in range(length):
        same &= left[i + k] == right[j + k]
    return same


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _scan(index: WindowIndex, texts: list[bytes | None]) -> Iterator[tuple[int, list, set]]:
    for first, last in chunks(texts, CHUNK_BYTES):
        words = [words_of(t) for t in texts[first:last]]
        # a foreign id between documents keeps windows inside them
        starts = np.cumsum([0] + [len(w) + 1 for w in words])
        ids = np.zeros(starts[-1], np.int64)
        for at, own in zip(starts, words):
            ids[at : at + len(own)] = [index.ids.get(w, 0) for w in own]
        found: dict[int, tuple[list, set]] = {}
        for at, length, groups in index.occurrences(ids):
            docs = np.searchsorted(starts, at, "right") - 1
            cuts = np.flatnonzero(np.diff(docs)) + 1
            for own_at, own_groups in zip(np.split(at, cuts), np.split(groups, cuts)):
                if not len(own_at):
                    continue
                k = int(np.searchsorted(starts, own_at[0], "right")) - 1
                spans, named = found.setdefault(k, ([], set()))
                spans.extend((a, a + length) for a in (own_at - starts[k]).tolist())
                named |= index.named(length, own_groups)
        for k, own in enumerate(words):
            yield len(own), *found.get(k, ([], set()))


def _blocks(benchmark: DataFrame, item_id: str, text: str, limit: int) -> Iterator[list]:
    rows = benchmark.select(
        F.coalesce(F.col(item_id).cast("string"), F.lit("")), F.col(text).cast("binary")
    )
    block, held = [], 0
    for item, own in rows.toLocalIterator():
        n = len(own or b"") // 4 + 1
        if block and held + n > limit:
            yield block
            block, held = [], 0
        block.append((item, bytes(own or b"")))
        held += n
    yield block


def _found(index: WindowIndex, texts: list[bytes | None], rows: list[tuple]) -> None:
    for k, (n, spans, items) in enumerate(_scan(index, texts)):
        rows[k] = n, rows[k][1] + spans, rows[k][2] | items


def _scanner(blocks: list, width: int):
    name = f"benchmark {uuid.uuid4()}"

    def index(k: int) -> WindowIndex:
        """The index of a block, built once in a worker, which keeps the last few."""
        return memo(f"{name} {k}", lambda: WindowIndex(pickle.loads(zlib.decompress(blocks[k].value)), width))

    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            rows: list[tuple] = [(0, [], set())] * len(batch)
            for k in range(len(blocks)):
                at = 0
                for part in slices(batch, CHUNK_BYTES):
                    texts = part.to_pylist()
                    own = rows[at : at + len(texts)]
                    _found(index(k), texts, own)
                    rows[at : at + len(texts)] = own
                    at += len(texts)
            yield pa.array(
                [
                    {
                        "n_words": n,
                        "spans": [{"start": a, "end": b} for a, b in _merged(spans)],
                        "items": sorted(items),
                    }
                    for n, spans, items in rows
                ],
                ARROW,
            )

    return F.arrow_udf(scan, RESULT)


def find_benchmark_words(
    documents: DataFrame,
    benchmark: DataFrame,
    *,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    width: int = WIDTH,
    result: str = "benchmark_hits",
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """Add the struct ``result`` (n_words, spans, items) to every document.

    Words are runs of letters, digits and any characters beyond ASCII, A-Z lower-cased.
    ``spans`` are the merged ranges of words (end exclusive) that lie in a window of
    ``width`` consecutive words of an item, or of the whole of a shorter item;
    ``items`` are the sorted ids of the items with such a window. Null or empty
    texts have no words; items without words have no windows; an item without an id
    is named by the empty string; repeated items count once; a column of documents
    called like ``result`` is replaced. The benchmark passes through the driver in
    blocks of some ``block_words`` words; a longer single item is a block of its own.
    """
    share = documents.sparkSession.sparkContext.broadcast
    blocks = [
        share(zlib.compress(pickle.dumps(block)))
        for block in _blocks(benchmark, item_id, item_text, block_words)
    ]
    return documents.withColumn(result, _scanner(blocks, width)(F.col(text).cast("binary")))


def n_hit(result: str = "benchmark_hits"):
    """Words of a document that lie in a window."""
    return F.aggregate(
        F.transform(f"{result}.spans", lambda s: (s["end"] - s["start"]).cast("long")),
        F.lit(0).cast("long"),
        lambda a, b: a + b,
    )


def contaminated(result: str = "benchmark_hits", one_in: int = 20):
    """At least one word in ``one_in`` of a document lies in a window."""
    return (n_hit(result) > 0) & (n_hit(result) * one_in >= F.col(f"{result}.n_words"))


def without_contaminated(documents: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that are not contaminated, with their own columns."""
    hits = unused("_benchmark_hits", documents)
    marked = find_benchmark_words(documents, benchmark, result=hits, **options)
    return marked.filter(~contaminated(hits)).select(
        *(F.col(f"`{c}`") for c in documents.columns)
    )
