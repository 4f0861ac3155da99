"""Best-fit packing of tokenised documents into sequences of fixed capacity.

Pieces are at most ``capacity`` tokens long, so how many there are of each length is a
table of at most ``capacity`` rows, whatever the size of the corpus. The plan is made
from that table alone: pieces above a third of the capacity pair up greedily, at most two
to a sequence, each with the longest partner that fits; shorter ones, longest first, go
where they leave the smallest gap. The plan says for runs of equal pieces, by their rank
among pieces of their length, which sequence and place they take; every piece looks
up its own place.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from odflow.llm.common import cut, few, slices
from odflow.llm.tokens import ids_by_word

CAPACITY = 2048
CHUNK_BYTES = 2_000_000
#: Pieces in one bucket, about, and the least number of buckets.
RANKED, BUCKETS = 20_000, 32

PIECES = pa.list_(
    pa.struct([("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
)


def _cut_pieces(path: str, capacity: int, end: bytes, with_ids: bool):
    def pieces(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            rows = []
            for texts in slices(batch, CHUNK_BYTES):
                for ids in ids_by_word(path, texts):
                    ids, own = ids + end, []
                    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[at : at + 4 * capacity]
                        piece = {
                            "piece": k,
                            "start": at // 4,
                            "length": len(part) // 4,
                            "ids_crc32": zlib.crc32(part),
                        }
                        own.append(piece | {"ids": np.frombuffer(part, np.uint32)} if with_ids else piece)
                    rows.append(own)
            yield pa.array(rows, _with_ids(PIECES) if with_ids else PIECES)

    ids = ", ids: array<int>" if with_ids else ""
    return F.arrow_udf(
        pieces,
        f"array<struct<piece: int, start: bigint, length: bigint, ids_crc32: bigint{ids}>>",
    )


def _with_ids(pieces: pa.DataType) -> pa.DataType:
    return pa.list_(pa.struct([*pieces.value_type, ("ids", pa.list_(pa.int32()))]))


def pieces_of(
    documents: DataFrame,
    tokenizer: str,
    *,
    id: str = "doc_id",
    text: str = "text",
    capacity: int = CAPACITY,
    end_id: int = 0,
    with_ids: bool = False,
) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32[, ids])``: documents cut to the capacity.

    ``tokenizer`` is the path of a tokenizers file that drops white space; ``end_id``
    ends every document. A null or empty text is its end alone.
    """
    end = np.array([end_id], np.uint32).tobytes()
    cut_pieces = _cut_pieces(tokenizer, capacity, end, with_ids)
    return documents.select(
        F.col(id).alias("doc_id"), F.explode(cut_pieces(F.col(text).cast("binary"))).alias("p")
    ).select("doc_id", "p.*")


class _Gaps:
    """Runs of equally filled sequences, by the gap that is left in them."""

    def __init__(self) -> None:
        self.order: list[int] = []
        self.runs: dict[int, list[tuple[int, int]]] = {}

    def put(self, gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in self.runs:
                self.runs[gap] = []
                insort(self.order, gap)
            self.runs[gap].append((first, n))

    def take(self, length: int) -> tuple[int, int, int] | None:
        """A run with the smallest gap that holds ``length``: gap, first sequence, sequences."""
        at = bisect_left(self.order, length)
        if at == len(self.order):
            return None
        gap = self.order[at]
        run = self.runs[gap].pop()
        if not self.runs[gap]:
            del self.runs[gap], self.order[at]
        return gap, *run


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Where the pieces of each length go.

    Rows are (length, from_rank, to_rank, first sequence, pieces per sequence, offset):
    the pieces with these ranks fill consecutive sequences, so many to each, from the
    offset on.
    """
    left, used = dict(counts), dict.fromkeys(counts, 0)
    out, gaps, sequences = [], _Gaps(), 0

    def place(length: int, n: int, first: int, each: int, offset: int) -> None:
        out.append((length, used[length], used[length] + n, first, each, offset))
        used[length] += n
        left[length] -= n

    large = sorted(n for n in counts if 3 * n > capacity)
    for length in reversed(large):
        while left[length]:
            partner = next(
                (p for p in reversed(large[: bisect_left(large, capacity - length + 1)]) if left[p] > (p == length)),
                None,
            )
            if partner is None:
                n = left[length]
                place(length, n, sequences, 1, 0)
                gaps.put(capacity - length, sequences, n)
            elif partner == length:
                n = left[length] // 2
                place(length, 2 * n, sequences, 2, 0)
                gaps.put(capacity - 2 * length, sequences, n)
            else:
                n = min(left[length], left[partner])
                place(length, n, sequences, 1, 0)
                place(partner, n, sequences, 1, length)
                gaps.put(capacity - length - partner, sequences, n)
            sequences += n
    for length in sorted((n for n in counts if 3 * n <= capacity), reverse=True):
        while left[length]:
            run = gaps.take(length)
            if run is None:
                # open as many sequences as these pieces fill
                n = -(-left[length] // (capacity // length))
                run = capacity, sequences, n
                sequences += n
            gap, first, n = run
            each = min(gap // length, left[length])
            full = min(n, left[length] // each)
            place(length, full * each, first, each, capacity - gap)
            gaps.put(gap - each * length, first, full)
            gaps.put(gap, first + full, n - full)
    return out


def _places(rows: list[tuple]):
    by_length: dict[int, np.ndarray] = {}
    table = np.array(sorted(rows), np.int64).reshape(-1, 6)
    for length in np.unique(table[:, 0]):
        by_length[int(length)] = table[table[:, 0] == length]

    def places(lengths: pd.Series, ranks: pd.Series) -> pd.DataFrame:
        length, rank = lengths.to_numpy(), ranks.to_numpy()
        sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        for n in np.unique(length):
            own = np.flatnonzero(length == n)
            runs = by_length[int(n)]
            run = runs[np.searchsorted(runs[:, 1], rank[own], "right") - 1]
            at = rank[own] - run[:, 1]
            sequence[own] = run[:, 3] + at // run[:, 4]
            offset[own] = run[:, 5] + at % run[:, 4] * n
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    return F.pandas_udf(places, "sequence_id bigint, offset bigint")


def ranked_by_length(pieces: DataFrame) -> DataFrame:
    """Add ``rank``, from 0 without gaps among the pieces of a length.

    Pieces of a length are dealt to buckets by hash and ranked within them, after the
    pieces in earlier buckets, so that a length of very many pieces is not sorted in
    one task.
    """
    buckets = max(BUCKETS, pieces.count() // RANKED)
    dealt = pieces.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).cast("int"))
    sizes = dealt.groupBy("length", "_bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("length", "_bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))
    own = Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece")
    return (
        dealt.withColumn("_own", F.row_number().over(own) - 1)
        .join(starts, ["length", "_bucket"])
        .withColumn("rank", F.col("_start") + F.col("_own"))
        .drop("_bucket", "_own", "_start")
    )


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces of 1 to ``capacity`` tokens.

    Sequences have no gaps and no overlaps. Repeated rows are packed as often as they
    occur; no pieces give no sequences.
    """
    pieces = cut(pieces)
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    places = _places(plan(counts, capacity))
    columns = [F.col(f"`{c}`") for c in pieces.columns]
    return few(ranked_by_length(pieces)).select(*columns, places("length", "rank").alias("p")).select(*columns, "p.*")


def pack_documents(documents: DataFrame, tokenizer: str, *, capacity: int = CAPACITY, **options) -> DataFrame:
    """Documents tokenised, cut and packed: see ``pieces_of`` and ``pack``."""
    return pack(pieces_of(documents, tokenizer, capacity=capacity, **options), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """``(sequence_id, ids, doc_ids)`` of packed pieces that carry their ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("parts")).select(
        "sequence_id", F.flatten("parts.ids").alias("ids"), F.col("parts.doc_id").alias("doc_ids")
    )
