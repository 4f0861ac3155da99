"""Approximate nearest neighbours by permutations of pivots.

Every vector is represented by the order in which it sees the pivots, nearest first. The
index holds, for each pivot, a file with the vectors' places of that pivot. For a query
the files are walked one after another and add up the footrule distance, the sum of
differences between places; the best share of the vectors is then ranked by its true
cosine. Copies of a vector count once in that share, and vectors with the footrule of the
last one belong to it. Index and search run in blocks of vectors; queries are broadcast in
blocks of bounded size. Every vector is indexed; only pivots come from a bounded sample of distinct ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PIVOTS = 128
#: Share of a block's rows, and least number, of distinct vectors that are ranked by cosine.
SHARE, LEAST = 0.2, 100
BLOCK_ROWS, BLOCK_QUERIES = 8192, 2048


def unit(vectors: np.ndarray) -> np.ndarray:
    # each row is scaled by its largest part first, so that no square overflows or vanishes
    scaled = vectors / np.abs(vectors).max(1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(1, keepdims=True))


def places(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The place of every pivot in the order in which each unit vector sees them."""
    order = np.argsort(-(vectors @ pivots.T), axis=1, kind="stable")
    out = np.empty(order.shape, np.int16)
    np.put_along_axis(out, order, np.arange(order.shape[1], dtype=np.int16)[None], axis=1)
    return out


def _copies(ids: np.ndarray, vectors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A row of each distinct vector, the ``k + 1`` smallest ids of each, and whose they are.

    No more can be among the ``k`` best of a query, which may be one of them itself.
    """
    seen: dict[bytes, int] = {}
    # adding 0 makes both zeros equal
    group = np.array([seen.setdefault(v.tobytes(), len(seen)) for v in vectors + 0.0], np.int64)
    _, first = np.unique(group, return_index=True)
    pairs = np.unique(np.stack((group, ids), 1), axis=0)
    starts = np.searchsorted(pairs[:, 0], np.arange(len(first)))
    pairs = pairs[np.arange(len(pairs)) - starts[pairs[:, 0]] <= k]
    return first, pairs[:, 1], pairs[:, 0]


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores))
    _, first = np.unique(ids[order], return_index=True)
    order = order[np.sort(first)[:k]]
    return ids[order], scores[order]


def _search(shared, pivots: np.ndarray, k: int, share: float, least: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, queries = shared.value
        asked = places(queries, pivots)
        none = np.empty(0, np.int64), np.empty(0)
        best = [none] * len(query_ids)
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                ids = part.column(0).to_numpy()
                flat = part.column(1).flatten().to_numpy()
                vectors = unit(flat.reshape(len(ids), -1))
                n = max(least, int(share * len(ids)))
                first, ids, group = _copies(ids, vectors, k)
                vectors = vectors[first]
                files = np.ascontiguousarray(places(vectors, pivots).T)
                n = min(len(vectors), n)
                for q, own in enumerate(query_ids):
                    footrule = np.zeros(len(vectors), np.int32)
                    for file, place in zip(files, asked[q]):
                        footrule += np.abs(file - place)
                    near = footrule <= np.partition(footrule, n - 1)[n - 1]
                    # summed row by row, so that equal vectors have equal scores
                    scores = np.zeros(len(vectors))
                    scores[near] = (vectors[near] * queries[q]).sum(1)
                    found = near[group] & (ids != own)
                    best[q] = _best(
                        np.concatenate((best[q][0], ids[found])),
                        np.concatenate((best[q][1], scores[group[found]])),
                        k,
                    )
        rows = [(q, int(i), float(s)) for q, own in zip(query_ids.tolist(), best) for i, s in zip(*own)]
        names = ["query_id", "vec_id", "score"]
        columns = list(zip(*rows)) or [(), (), ()]
        types = [pa.int64(), pa.int64(), pa.float64()]
        yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types)], names)

    return search


def nearest(
    vectors: DataFrame,
    *,
    id: str = "vec_id",
    vector: str = "embedding",
    every: int = 50,
    k: int = 5,
    n_pivots: int = PIVOTS,
    share: float = SHARE,
    least: int = LEAST,
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` nearest found for each query.

    Queries are the rows whose id is divisible by ``every``, candidates all rows with
    another id; nearness is the cosine in double precision, ties go to the smaller id.
    Rows without an id, and vectors that are null, empty, zero, of another length than
    most, or hold null or non-finite components, take no part. Repeated ids are
    one candidate, with its largest score. Other columns are ignored.
    """
    spark = vectors.sparkSession
    values = F.transform(vector, lambda x: x.cast("double"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    points = vectors.select(F.col(id).cast("long").alias("id"), values.alias("v")).filter(
        F.col("id").isNotNull() & F.forall("v", finite) & F.exists("v", lambda x: x != 0)
    )
    lengths = points.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n")
    length = lengths.first()
    if length is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    points = points.filter(F.size("v") == length["n"])
    # distinct vectors, as copies among the pivots would outweigh the others
    key = F.xxhash64("v")
    keys = [r["key"] for r in points.select(key.alias("key")).distinct().orderBy("key").limit(n_pivots).collect()]
    sample = points.filter(key.isin(keys)).select("v").distinct().orderBy(key, "v").collect()
    pivots = unit(np.array([r["v"] for r in sample]))

    queries = points.filter(F.col("id") % every == 0)
    blocks = -(-queries.count() // BLOCK_QUERIES)
    found = spark.createDataFrame([], "query_id bigint, vec_id bigint, score double")
    for block in range(blocks):
        # hashing bounds a block only on average; a block holds a fixed share of the queries
        own = queries.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block).dropDuplicates(["id"]).collect()
        if own:
            ids = np.array([r["id"] for r in own], np.int64)
            shared = spark.sparkContext.broadcast((ids, unit(np.array([r["v"] for r in own]))))
            part = points.mapInArrow(
                _search(shared, pivots, k, share, least), "query_id bigint, vec_id bigint, score double"
            )
            found = found.unionByName(part)
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        best.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
