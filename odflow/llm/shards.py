"""Byte-balanced shards by Karmarkar-Karp differencing.

Texts that are equal form a group that no shard border may cut. A partial partition deals
some groups to bins, one bin for each shard. The two with the largest spread (fullest less
emptiest bin) are combined, the fullest bin of one with the emptiest of the other, until
one is left. A single group is a partial partition with all its bytes in one bin.

All groups never meet in one place. Groups are dealt to chunks by hash; each chunk is
differenced on its own, and its bins, a few even bundles, are the groups of the next round,
until few are left. Groups of at least a ``FINAL``-th of all bytes skip the rounds, and so
do those of one chunk, so that the last differencing has the large groups to balance and
small ones to balance them with. It sees at most three times ``FINAL`` rows and some,
however many documents there are.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from odflow.llm.common import cut, stored

SHARDS = 8
#: Groups that one task differences, and about how many the last differencing takes.
CHUNK, FINAL = 4096, 8192


def differenced(sizes: np.ndarray, bins: int) -> np.ndarray:
    """The bin of every item, by Karmarkar-Karp differencing into ``bins`` bins.

    Every combination is kept as a node with the order in which it took the bins of its
    two parts, so that nothing is moved until the bins are handed down from the last one.
    Equal spreads combine in the order in which they came up.
    """
    n = len(sizes)
    if n == 0 or bins == 1:
        return np.zeros(n, np.int64)
    # partial partitions: loads from low to high; the items of load k are those of its k-th bin
    loads: list[list[int]] = [[0] * (bins - 1) + [int(s)] for s in sizes]
    heap = [(-own[-1], i) for i, own in enumerate(loads)]
    heapq.heapify(heap)
    parts: list[tuple[int, int, list[int]]] = []
    places = range(bins)
    while len(heap) > 1:
        _, first = heapq.heappop(heap)
        spread, second = heap[0]
        low, high = loads[first], loads[second]
        sums = [x + y for x, y in zip(low, reversed(high))]
        order = sorted(places, key=sums.__getitem__)
        node = len(loads)
        parts.append((first, second, order))
        loads.append([sums[k] for k in order])
        loads[first] = loads[second] = None
        heapq.heapreplace(heap, (loads[node][0] - loads[node][-1], node))
    # bins of each node's places, from the last combination down to the items
    bins_of: list[list[int] | None] = [None] * len(loads)
    bins_of[-1] = list(places)
    for node in range(len(loads) - 1, n - 1, -1):
        first, second, order = parts[node - n]
        own, bins_of[node] = bins_of[node], None
        forward = [0] * bins
        for place, k in enumerate(order):
            forward[k] = own[place]
        bins_of[first], bins_of[second] = forward, forward[::-1]
    return np.array([bins_of[i][-1] for i in range(n)], np.int64)


def _bundles(bins: int):
    def bundle(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["bytes", "key"], ascending=[False, True])
        held = differenced(rows["bytes"].to_numpy(), bins)
        bundle = rows["chunk"].to_numpy() * bins + held
        return pd.DataFrame({"key": rows["key"].to_numpy(), "bytes": rows["bytes"].to_numpy(), "bundle": bundle})

    return bundle


def group_shards(groups: DataFrame, shards: int = SHARDS, *, chunk: int = CHUNK, final: int = FINAL) -> DataFrame:
    """``(key, shard)`` of groups ``(key long, bytes long)``, whose keys are distinct.

    The shards' bytes differ as little as differencing can make them; a group with more
    than its share of all bytes still lies in one shard.
    """
    spark = groups.sparkSession
    groups = cut(groups.select("key", "bytes"))
    n, total = groups.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    level, last, bundled = groups, [], []
    while n > final:
        chunks = -(-n // chunk)
        dealt = level.withColumn("chunk", F.pmod(F.xxhash64("key", F.lit(len(bundled))), F.lit(chunks)))
        apart = (F.col("bytes") * final >= total) | (F.col("chunk") == 0)
        last.append((len(bundled), dealt.filter(apart).select("key", "bytes")))
        held = stored(
            dealt.filter(~apart)
            .groupBy("chunk")
            .applyInPandas(_bundles(shards), "key bigint, bytes bigint, bundle bigint")
        )
        bundled.append(held.select("key", "bundle"))
        level = held.groupBy(F.col("bundle").alias("key")).agg(F.sum("bytes").alias("bytes"))
        n = level.count()
    last.append((len(bundled), level))
    # what is left of every round: at most final large ones, one chunk, and the last bundles
    rows = [(r, *row) for r, part in last for row in part.select("key", "bytes").toPandas().itertuples(index=False)]
    rows.sort(key=lambda row: (-row[2], row[0], row[1]))
    bins = differenced(np.array([row[2] for row in rows], np.int64), shards)
    settled = spark.createDataFrame(
        pd.DataFrame({"round": [r for r, *_ in rows], "key": [k for _, k, _ in rows], "shard": bins}),
        "round int, key bigint, shard int",
    )
    shard_of = settled.filter(F.col("round") == len(bundled)).select("key", "shard")
    for number in reversed(range(len(bundled))):
        own = settled.filter(F.col("round") == number).select("key", "shard")
        bundles = shard_of.withColumnRenamed("key", "bundle")
        shard_of = bundled[number].join(bundles, "bundle").select("key", "shard").unionByName(own)
    return shard_of


def _slots(shared, shards: int):
    """Number the rows of a task's partition, each shard from where earlier partitions end."""

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = shared.value.get(TaskContext.get().partitionId(), np.zeros(shards, np.int64)).copy()
        for batch in batches:
            shard = batch.column(batch.schema.get_field_index("shard")).to_numpy()
            slot = np.zeros(len(shard), np.int64)
            for s in np.unique(shard):
                own = np.flatnonzero(shard == s)
                slot[own] = at[s] + np.arange(len(own))
                at[s] += len(own)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(slot)], [*batch.schema.names, "slot"])

    return slots


def with_slots(placed: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Add ``slot``: a number from 0 without gaps among the rows of a ``shard``.

    The rows are written once, so that a partition holds the same rows whenever it is read;
    rows are counted per partition, and every partition numbers its own rows from where the
    earlier ones end. No shard is gathered or sorted. The driver sees a number for each
    partition and shard.
    """
    placed = cut(placed)
    counts = placed.groupBy(F.spark_partition_id().alias("part"), "shard").count().collect()
    table = np.zeros((max((r["part"] for r in counts), default=-1) + 2, shards), np.int64)
    for r in counts:
        table[r["part"] + 1, r["shard"]] = r["count"]
    starts = np.cumsum(table, axis=0)
    shared = placed.sparkSession.sparkContext.broadcast(dict(enumerate(starts[:-1])))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in placed.schema)
    return placed.mapInArrow(_slots(shared, shards), f"{schema}, slot bigint")


def _keyed(documents: DataFrame, id: str, text: str) -> DataFrame:
    """Sizes and group keys. Texts whose 64-bit hash is equal share a group, equal ones do."""
    own = F.col(f"`{text}`").cast("string")
    held = F.coalesce(own, F.lit(""))
    return documents.select(
        F.col(f"`{id}`").alias("id"),
        (F.octet_length(held) + 1).cast("long").alias("size"),
        F.crc32(held.cast("binary")).alias("text_crc32"),
        F.xxhash64(held).alias("key"),
    )


def shard_documents(
    documents: DataFrame,
    shards: int = SHARDS,
    *,
    id: str = "doc_id",
    text: str = "text",
    chunk: int = CHUNK,
    final: int = FINAL,
) -> DataFrame:
    """``(id, size, text_crc32, shard, slot)`` of every document: shards of nearly equal size.

    ``size`` is the bytes of the text and 1; a null text counts as an empty one. Equal
    texts share a shard, so a text with more than its share of all bytes makes its shard
    larger than the others. ``slot`` numbers the documents of a shard from 0. Repeated rows
    are placed as often as they occur, rows without an id too; no rows give no rows. Other
    columns are neither read nor returned.

    Groups of at least a ``final``-th of all rows, of which there cannot be more than
    ``final``, are joined by broadcast; each other key brings few rows to its task.
    """
    rows = stored(_keyed(documents, id, text))
    groups = cut(rows.groupBy("key").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")))
    n_rows = groups.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    shard_of = groups.select("key", "n").join(group_shards(groups, shards, chunk=chunk, final=final), "key")
    shard_of = cut(shard_of.select("key", "shard", (F.col("n") * final >= n_rows).alias("hot")))
    hot = shard_of.filter("hot").select(F.col("key").alias("hot_key"), F.col("shard").alias("hot_shard"))
    cold = shard_of.filter("not hot").select(F.col("key").alias("cold_key"), F.col("shard").alias("cold_shard"))
    placed = (
        rows.join(F.broadcast(hot), F.col("key") == F.col("hot_key"), "left")
        # rows that are placed already are spread out; they find no cold key that counts
        .withColumn("to", F.when(F.col("hot_key").isNull(), F.col("key")).otherwise(F.xxhash64("id", F.monotonically_increasing_id())))
        .join(cold, F.col("to") == F.col("cold_key"), "left")
        .select("id", "size", "text_crc32", F.coalesce("hot_shard", "cold_shard").alias("shard"))
    )
    return with_slots(placed, shards).withColumnRenamed("id", id)


def write_shards(documents: DataFrame, path: str, shards: int = SHARDS, *, text: str = "text", **options) -> None:
    """Write every document, all columns, into the folder ``shard=<n>`` of its text.

    A column of the documents called ``shard`` is replaced. Rows of a shard are spread over
    several tasks and files.
    """
    found = _keyed(documents, text, text).select("key", "size")
    groups = found.groupBy("key").agg(F.sum("size").alias("bytes"))
    shard_of = cut(group_shards(groups, shards, **options))
    kept = [F.col(f"d.`{c}`") for c in documents.columns if c != "shard"]
    keyed = F.xxhash64(F.coalesce(F.col(f"d.`{text}`").cast("string"), F.lit(""))) == F.col("s.key")
    placed = documents.alias("d").join(shard_of.alias("s"), keyed).select(*kept, F.col("s.shard").alias("shard"))
    placed.hint("rebalance", "shard").write.partitionBy("shard").parquet(path)
