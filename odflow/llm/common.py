"""Helpers of several operators: checkpoints, checked broadcasts, word hashes, components."""

from __future__ import annotations

import ctypes
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Ids that may be broadcast; 8 bytes each, some 30 MB as a hash table.
BROADCAST_IDS = 1_000_000

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_M1, _M2, _M3 = (np.uint64(x) for x in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x9E3779B97F4A7C15))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where all run in one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
        folder = vars(sys).setdefault("_odflow_llm_folder", None) or tempfile.mkdtemp(prefix="odflow-shared-")
        sys._odflow_llm_folder = folder
    return folder.rstrip("/")


def unused(name: str, documents: DataFrame) -> str:
    """The name, made longer until the documents have no such column (names are told apart without case)."""
    taken = {c.lower() for c in documents.columns}
    while name.lower() in taken:
        name += "_"
    return name


def stored(df: DataFrame) -> DataFrame:
    """The rows written to the shared folder as Parquet, which packs them, and read again."""
    path = f"{shared_folder(df.sparkSession)}/odflow-{uuid.uuid4()}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Files of one write, at least, and shuffle partitions that go into one.
FILES, PARTITIONS_PER_FILE = 12, 16


def few(df: DataFrame) -> DataFrame:
    """The rows in few partitions, without a shuffle: a task takes several, one after another.

    There are two for every core, or more as the shuffle partitions that are set. Without Hadoop's native
    library a local file system runs two ``chmod`` for every file, for each of which the executor's JVM is
    forked. To be set below functions in Python, not above them: a task keeps a buffer for each of their
    partitions until it ends.
    """
    spark = df.sparkSession
    shuffled = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return df.coalesce(max(FILES, 2 * spark.sparkContext.defaultParallelism, shuffled // PARTITIONS_PER_FILE))


def cut(df: DataFrame) -> DataFrame:
    """The rows written to the shared checkpoint folder, without their lineage."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()


def small(df: DataFrame, limit: int = BROADCAST_IDS, items: str = "1") -> DataFrame:
    """``df``, marked for broadcast if it was counted to hold at most ``limit`` items.

    ``items`` is how many a row holds, as SQL; rows count 1, rows with an array its size.
    Beyond the limit the join that takes ``df`` shuffles.
    """
    held = df.agg(F.sum(F.expr(items).cast("long"))).first()[0] or 0
    return F.broadcast(df) if held <= limit else df


def give_back() -> None:
    """Return what Arrow and the C library hold of freed memory to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


#: Objects that a Python worker keeps, those used last; one operator needs four at most.
KEPT = 4


def memo(name: str, make: Callable[[], object]) -> object:
    """An object kept for the later tasks of a stage in the same Python worker, until others take its place.

    Objects of an earlier stage are dropped first.
    """
    kept = vars(sys).setdefault("_odflow_llm_memo", {})
    task = TaskContext.get()
    stage = task and task.stageId()
    if kept and vars(sys).get("_odflow_llm_stage") != stage:
        kept.clear()
        give_back()
    sys._odflow_llm_stage = stage
    held = kept.pop(name) if name in kept else make()
    kept[name] = held
    while len(kept) > KEPT:
        del kept[next(iter(kept))]
    return held


class WordHashes(dict):
    """64-bit hash of each word, computed when first asked for; emptied when full."""

    LIMIT = 300_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def hashed_words(words: list[bytes]) -> np.ndarray:
    table = memo("word_hashes", WordHashes)
    return np.fromiter(map(table.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (a bijection)."""
    x = (x ^ (x >> np.uint64(33))) * _M1
    x = (x ^ (x >> np.uint64(33))) * _M2
    return x ^ (x >> np.uint64(33))


def gram_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` words, one for each start."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(width):
        out = out * _M3 + hashes[i : i + n]
    return mix(out)


def chunks(texts: list[bytes | None], size: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``size`` bytes, one text at least."""
    start = held = 0
    for i, text in enumerate(texts):
        if held and held + len(text or b"") > size:
            yield start, i
            start, held = i, 0
        held += len(text or b"")
    if start < len(texts):
        yield start, len(texts)


def slices(texts: pa.Array, size: int, *others: pa.Array) -> Iterator[pa.Array | tuple[pa.Array, ...]]:
    """Parts of an array of texts, and of arrays beside it, of about ``size`` bytes.

    Tasks that turn one part after another into Python objects stay small, however
    long the texts of a batch; behind the last part, freed memory is given back. An empty
    array is one part.
    """
    lengths = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).tolist()
    cuts, held = [0], 0
    for i, n in enumerate(lengths):
        if held and held + n > size:
            cuts.append(i)
            held = 0
        held += n
    for first, last in zip(cuts, [*cuts[1:], len(lengths)]):
        parts = tuple(a.slice(first, last - first) for a in (texts, *others))
        yield parts if others else parts[0]
    give_back()


def joined_components(reached: DataFrame, late: DataFrame) -> DataFrame:
    """``reached`` (id, component) after further links (a, b): only components are linked anew."""
    ends = late
    for side in ("a", "b"):
        own = reached.select(F.col("id").alias(side), F.col("component").alias(f"component_{side}"))
        ends = ends.join(own, side, "left").withColumn(side, F.coalesce(f"component_{side}", side)).drop(f"component_{side}")
    merged = connected_components(ends.select("a", "b"))
    merged = merged.select(F.col("id").alias("old"), F.col("component").alias("new"))
    known = reached.join(merged, F.col("component") == F.col("old"), "left").select(
        "id", F.coalesce("new", "component").alias("component")
    )
    # documents that only the further links reach are components of their own so far
    single = merged.join(reached, F.col("old") == F.col("id"), "left_anti")
    return known.unionByName(single.select(F.col("old").alias("id"), F.col("new").alias("component")))


#: Links in one partition where they are contracted before components are sought, about.
CONTRACTED = 100_000


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of a partition as stars: each id with the smallest that it reaches there."""
    parts = [(batch.column(0).to_numpy(), batch.column(1).to_numpy()) for batch in batches]
    if not parts:
        return
    a, b = (np.concatenate(ends) for ends in zip(*parts))
    ids, ends = np.unique(np.concatenate((a, b)), return_inverse=True)
    a, b = ends[: len(a)], ends[len(a) :]
    # labels are places, so that smaller ids have smaller ones; every label is that of its own label
    label = np.arange(len(ids))
    while len(a):
        low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
        apart = low < high
        a, b = a[apart], b[apart]
        np.minimum.at(label, high[apart], low[apart])
        while (label[label] != label).any():
            label = label[label]
    moved = np.flatnonzero(label != np.arange(len(ids)))
    yield pa.record_batch([pa.array(ids[label[moved]]), pa.array(ids[moved])], ["a", "b"])


def connected_components(links: DataFrame) -> DataFrame:
    """``(id, component)`` of every id in ``links`` (a, b): the smallest id it reaches.

    Alternates two steps until no link changes. Each joins a node's neighbours with
    the smallest of them, so a node with very many neighbours is never gathered in
    one place; a path of length n takes O(log n) rounds. Before, every partition turns the
    links that it holds into stars, which leaves fewer links and rounds.
    """

    def hook(edges: DataFrame, to_larger: bool) -> DataFrame:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rows = both if to_larger else both.filter("b < a")
        least = rows.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        joined = rows.join(least, "a")
        moved = joined.filter("b > a") if to_larger else joined.filter("b <> m")
        hooked = moved.select(F.col("b").alias("x"), "m")
        if not to_larger:
            hooked = hooked.unionByName(least.select(F.col("a").alias("x"), "m"))
        return (
            hooked.filter("x <> m")
            .select(F.least("x", "m").alias("a"), F.greatest("x", "m").alias("b"))
            .distinct()
        )

    def written(edges: DataFrame) -> tuple[DataFrame, tuple]:
        """The edges cut, with their number and the sum of their hashes, counted on the way."""
        seen = Observation()
        total = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        edges = cut(few(edges).observe(seen, F.count("*").alias("n"), total.alias("total")))
        return edges, (seen.get["n"], seen.get["total"])

    edges, (n, _) = written(
        links.filter("a <> b").select(
            F.least("a", "b").cast("long").alias("a"), F.greatest("a", "b").cast("long").alias("b")
        )
    )
    parts = n // CONTRACTED + 1
    stars = edges.coalesce(parts).mapInArrow(_contracted, "a bigint, b bigint")
    edges, before = written(stars.distinct() if parts > 1 else stars)
    # stars of a single partition reach all there is to reach
    while parts > 1 and before[0]:
        edges, after = written(hook(hook(edges, True), False))
        if after == before:
            break
        before = after
    members = edges.select(F.col("b").alias("id"), F.col("a").alias("component"))
    roots = edges.select(F.col("a").alias("id"), F.col("a").alias("component")).distinct()
    return members.unionByName(roots)
