"""MinHash near-duplicates with sequential Bayesian verification.

1. One pass over the texts gives each document its shingle count, a fingerprint of its
   shingle set and a MinHash signature. Documents with one shingle set form a class,
   and only its smallest document goes on.
2. Signatures are cut into bands. In every bucket of a band each member is paired with
   the bucket's smallest member, so that a bucket of n members gives n - 1 pairs.
3. Signatures of a pair are compared in batches. The pair is dropped as soon as the
   posterior probability that its similarity reaches the threshold falls below the miss
   probability. Survivors are verified on their whole shingle sets.
4. Links give components. Only buckets that still hold several components can hide a
   link: their members outside the component of the smallest member are compared with
   all members of other components in blocks of bounded size, and those that stay in the
   race are verified in blocks too. No pairs leave a block but links that connect.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from odflow.llm.common import (
    LOWER,
    chunks,
    connected_components,
    cut,
    few,
    gram_hashes,
    hashed_words,
    joined_components,
    slices,
    small,
    unused,
)

WORDS = 5
SIMILARITY = (80, 100)
#: Probability that a pair at the threshold shares no band, and the posterior
#: probability of a link below which a pair is dropped.
MISS = 1e-6
ROWS_PER_BAND = 5
#: Hashes of a signature compared at a time.
BATCH = 20
CHUNK_BYTES = 1_000_000
SLICE = 4_000_000
#: Members of a bucket in one block, and rows in one task, of the block comparison.
BLOCK, SHARD_ROWS = 1024, 5_000
#: Shingles in one task where blocks are verified, 8 bytes each.
SHARD_SHINGLES = 1_000_000


def bands_for(similarity: float, rows: int = ROWS_PER_BAND, miss: float = MISS) -> int:
    """Bands with which a pair at the threshold is missed with probability ``miss``."""
    return math.ceil(math.log(miss) / math.log1p(-(similarity**rows)))


def least_matches(n: int, similarity: float, miss: float = MISS) -> int:
    """Fewest equal hashes of ``n`` that leave a pair in the race.

    With a uniform prior the similarity is Beta(m + 1, n - m + 1) after m matches; the
    probability that it reaches the threshold is a binomial tail.
    """
    total, t = 0.0, similarity
    for m in range(n + 1):
        total += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        if total >= miss:
            return m
    return n


def shingle_sets(texts: list[bytes | None], width: int) -> Iterator[list[np.ndarray]]:
    """Sorted distinct shingle hashes of each text, for one chunk of texts after another."""
    for first, last in chunks(texts, CHUNK_BYTES):
        sets = []
        for text in texts[first:last]:
            words = text.translate(LOWER).split() if text else []
            hashes = hashed_words(words)
            # a shorter text is one shingle, kept apart from longer ones by its length
            sets.append(np.unique(gram_hashes(hashes, min(width, max(len(words), 1)))))
        yield sets


def signatures(sets: list[np.ndarray], n: int) -> np.ndarray:
    """MinHash signatures of non-empty sets, one row each."""
    rng = np.random.default_rng(12345)
    odd = rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    values = np.concatenate(sets)
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    out = np.empty((len(sets), n), np.uint32)
    for k in range(n):
        out[:, k] = np.minimum.reduceat((values * odd[k]) >> np.uint64(32), starts)
    return out


FEATURES = pa.struct([("n", pa.int64()), ("fp", pa.binary()), ("sig", pa.binary())])


def _features(width: int, n_hashes: int):
    def features(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            rows: list[dict | None] = []
            for sets in (s for part in slices(batch, SLICE) for s in shingle_sets(part.to_pylist(), width)):
                full = [s for s in sets if len(s)]
                sigs = iter(signatures(full, n_hashes) if full else ())
                rows += [
                    {
                        "n": len(s),
                        "fp": xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None,
                        "sig": next(sigs).tobytes() if len(s) else None,
                    }
                    for s in sets
                ]
            yield pa.array(rows, FEATURES)

    return F.arrow_udf(features, "struct<n: bigint, fp: binary, sig: binary>")


def _sets(width: int):
    def sets(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            found = (
                pa.array([s.tobytes() for some in shingle_sets(part.to_pylist(), width) for s in some], pa.binary())
                for part in slices(batch, SLICE)
            )
            yield pa.concat_arrays(list(found))

    return F.arrow_udf(sets, "binary")


def _schedule(n_hashes: int, similarity: float, miss: float) -> list[tuple[int, int]]:
    ends = [*range(BATCH, n_hashes, BATCH), n_hashes]
    return [(n, least_matches(n, similarity, miss)) for n in ends]


def in_the_race(left: np.ndarray, right: np.ndarray, schedule: list[tuple[int, int]]) -> np.ndarray:
    """Which pairs of signatures survive all batches."""
    alive, matches, start = np.arange(len(left)), np.zeros(len(left), np.int32), 0
    for end, least in schedule:
        matches[alive] += (left[alive, start:end] == right[alive, start:end]).sum(1, dtype=np.int32)
        alive = alive[matches[alive] >= least]
        start = end
    out = np.zeros(len(left), bool)
    out[alive] = True
    return out


def _stacked(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(len(column), -1)


def _survives(schedule: list[tuple[int, int]]):
    def survives(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for left, right in batches:
            if len(left):
                yield pa.array(in_the_race(_stacked(left), _stacked(right), schedule))
            else:
                yield pa.array([], pa.bool_())

    return F.arrow_udf(survives, "boolean")


def _linked(similarity: tuple[int, int]):
    part, whole = similarity

    def linked(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for left, right in batches:
            out = []
            for some, others in slices(left, SLICE, right):
                for a, b in zip(some.to_pylist(), others.to_pylist()):
                    a, b = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                    shared = len(a) + len(b) - len(np.union1d(a, b))
                    out.append(whole * shared >= part * (len(a) + len(b) - shared))
            yield pa.array(out, pa.bool_())

    return F.arrow_udf(linked, "boolean")


def _size_fits(n: int, others: np.ndarray, similarity: tuple[int, int]) -> np.ndarray:
    part, whole = similarity
    return whole * np.minimum(n, others) >= part * np.maximum(n, others)


def _compare_blocks(schedule: list[tuple[int, int]], similarity: tuple[int, int]):
    """For each member of a block its partners in other components that stay in the race.

    A pair is left to the block of the first band that it shares, and a pair of strays
    to the one with the smaller id.
    """

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        found = []
        for (key, i, j), block in rows.groupby(["key", "i", "j"], sort=False):
            left, right = block[block.side == 0], block[block.side == 1]
            if not len(left) or not len(right):
                continue
            sigs = np.frombuffer(b"".join(right.sig), np.uint32).reshape(len(right), -1)
            ids, comps = right.id.to_numpy(), right.component.to_numpy()
            sizes, strays = right.n.to_numpy(), right.stray.to_numpy()
            members = {}
            for own in left.itertuples():
                other = (comps != own.component) & (~strays | (ids > own.id))
                other = np.flatnonzero(other & _size_fits(own.n, sizes, similarity))
                mine = np.frombuffer(own.sig, np.uint32)
                other = other[in_the_race(np.broadcast_to(mine, (len(other), len(mine))), sigs[other], schedule)]
                bands = (sigs[other] == mine).reshape(len(other), len(mine) // ROWS_PER_BAND, ROWS_PER_BAND).all(2)
                other = other[~bands[:, : own.band].any(1)]
                if len(other):
                    partners = ids[other].tolist()
                    members.setdefault(own.id, (own.component, own.n, []))[2].extend(partners)
                    for k in other.tolist():
                        members.setdefault(int(ids[k]), (comps[k], sizes[k], []))
            found += [(key, i, j, m, c, n, partners) for m, (c, n, partners) in members.items()]
        return pd.DataFrame(found, columns=["key", "i", "j", "id", "component", "n", "partners"])

    return compare


def _verify_blocks(similarity: tuple[int, int]):
    """Links of a block's candidate pairs, as far as they connect components."""
    part, whole = similarity

    def verify(rows: pd.DataFrame) -> pd.DataFrame:
        links = []
        for _, block in rows.groupby(["key", "i", "j"], sort=False):
            sets = {r.id: np.frombuffer(r.set, np.uint64) for r in block.itertuples()}
            component = dict(zip(block.id, block.component))
            joined = {c: c for c in component.values()}

            def root(c):
                while joined[c] != c:
                    c = joined[c]
                return c

            for row in block.itertuples():
                for other in row.partners:
                    x, y = root(component[row.id]), root(component[other])
                    if x == y:
                        continue
                    a, b = sets[row.id], sets[other]
                    shared = len(np.intersect1d(a, b, assume_unique=True))
                    if whole * shared >= part * (len(a) + len(b) - shared):
                        joined[x] = y
                        links.append((min(row.id, other), max(row.id, other)))
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    return verify


def near_duplicates(
    documents: DataFrame,
    *,
    id: str = "doc_id",
    text: str = "text",
    words: int = WORDS,
    similarity: tuple[int, int] = SIMILARITY,
    miss: float = MISS,
) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` of every document.

    Words are runs of anything but ASCII white space, A-Z lower-cased; a document's set
    holds its distinct runs of ``words`` words (64-bit hashes of them), a shorter
    document's is its one run of all words. Documents are linked when intersection /
    union reaches ``similarity`` = (part, whole). ``component_id`` is the smallest id
    reachable over links and ``kept`` marks it.

    Null texts and texts without words have no shingles and are linked with nothing.
    Rows that share an id count as one document for links; each is returned. A row
    without an id takes part as a copy only: it gets the component of the documents
    with its shingle set, or null. Other columns are ignored.
    """
    part, whole = similarity
    bands = bands_for(part / whole, ROWS_PER_BAND, miss)
    n_hashes = bands * ROWS_PER_BAND
    schedule = _schedule(n_hashes, part / whole, miss)
    source = documents.select(F.col(id).cast("long").alias("id"), F.col(text).cast("binary").alias("text"))

    features = cut(
        source.select("id", _features(words, n_hashes)("text").alias("f")).select("id", "f.*")
    )
    classes = cut(few(
        features.filter("fp is not null and id is not null")
        .groupBy("fp")
        .agg(F.min(F.struct("id", "n", "sig")).alias("m"))
        .select("m.*")
    ))

    width = 4 * ROWS_PER_BAND
    keys = [
        F.xxhash64(F.lit(k), F.substring("sig", k * width + 1, width)) for k in range(bands)
    ]
    buckets = classes.select("id", F.posexplode(F.array(*keys)).alias("band", "key"))
    crowded = (
        buckets.groupBy("key").agg(F.min("id").alias("leader"), F.count("*").alias("n")).filter("n > 1")
    )
    members = cut(few(buckets.join(crowded, "key")))

    sized = classes.select("id", F.col("n").alias("n_shingles"), "sig")
    near_in_size = F.expr(
        f"least(n_shingles_a, n_shingles_b) * {whole} >= greatest(n_shingles_a, n_shingles_b) * {part}"
    )

    def both_sides(pairs: DataFrame, table: DataFrame, columns: list[str]) -> DataFrame:
        for side in ("a", "b"):
            own = table.select(F.col("id").alias(side), *(F.col(c).alias(f"{c}_{side}") for c in columns))
            pairs = pairs.join(own, side)
        return pairs

    def sets_of(ids: DataFrame) -> DataFrame:
        needed = source.join(small(ids.distinct()), "id", "left_semi")
        return needed.select("id", _sets(words)("text").alias("set"))

    stars = (
        members.filter("id <> leader").select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct()
    )
    stars = few(both_sides(stars, sized, ["n_shingles", "sig"]).filter(near_in_size))
    pairs = cut(stars.filter(_survives(schedule)("sig_a", "sig_b")).select("a", "b"))
    sets = sets_of(pairs.select(F.explode(F.array("a", "b")).alias("id")))
    tested = both_sides(pairs, sets, ["set"]).filter(_linked(similarity)("set_a", "set_b"))
    links = cut(few(tested.select("a", "b").distinct()))
    reached = connected_components(links)

    # buckets of two are settled by their one pair
    placed = (
        members.filter("n > 2")
        .join(reached, "id", "left")
        .select("band", "key", "id", "leader", F.coalesce("component", "id").alias("component"))
    )
    mixed = (
        placed.groupBy("key")
        .agg(
            F.count("*").alias("n"),
            F.max(F.when(F.col("id") == F.col("leader"), F.col("component"))).alias("main"),
            F.min("component").alias("least"),
            F.max("component").alias("most"),
        )
        .filter("least < most")
        .select("key", "n", "main")
    )
    rows = placed.join(mixed, "key")
    strays = rows.filter("component <> main").groupBy("key").agg(F.count("*").alias("r"))
    rows = cut(few(
        rows.join(strays, "key").join(sized, "id").select(
            "band",
            "key",
            "id",
            "component",
            "n_shingles",
            "sig",
            (F.col("component") != F.col("main")).alias("stray"),
            F.ceil(F.col("r") / BLOCK).cast("int").alias("parts_l"),
            F.ceil(F.col("n") / BLOCK).cast("int").alias("parts_r"),
        )
    ))
    own = F.xxhash64("id")
    columns = ["band", "key", "id", "component", F.col("n_shingles").alias("n"), "sig", "stray"]
    left = rows.filter("stray").select(
        *columns,
        F.lit(0).alias("side"),
        F.pmod(own, "parts_l").cast("int").alias("i"),
        F.explode(F.sequence(F.lit(0), F.col("parts_r") - 1)).alias("j"),
    )
    right = rows.select(
        *columns,
        F.lit(1).alias("side"),
        F.explode(F.sequence(F.lit(0), F.col("parts_l") - 1)).alias("i"),
        F.pmod(own, "parts_r").cast("int").alias("j"),
    )
    blocks = left.unionByName(right)
    shards = max(1, blocks.count() // SHARD_ROWS)
    shard = F.pmod(F.xxhash64("key", "i", "j"), F.lit(shards))
    block = "key bigint, i int, j int, id bigint, component bigint, n bigint"
    racing = cut(few(
        blocks.withColumn("shard", shard)
        .groupBy("shard")
        .applyInPandas(_compare_blocks(schedule, similarity), f"{block}, partners array<bigint>")
    ))
    # sets are much larger than signatures: shards by their size
    shards = max(1, (racing.agg(F.sum("n")).first()[0] or 0) // SHARD_SHINGLES)
    racing_sets = sets_of(racing.select("id")).dropDuplicates(["id"])
    late = (
        racing.join(racing_sets, "id")
        .withColumn("shard", F.pmod(F.xxhash64("key", "i", "j"), F.lit(shards)))
        .groupBy("shard")
        .applyInPandas(_verify_blocks(similarity), "a bigint, b bigint")
        .distinct()
    )
    late = cut(few(late))
    if late.limit(1).count():
        reached = cut(few(joined_components(reached, late)))

    class_of = features.filter("fp is not null").groupBy("fp").agg(F.min("id").alias("first"))
    component = F.coalesce("component", "first", "id")
    return (
        features.select("id", "n", "fp")
        .join(class_of, "fp", "left")
        .join(reached.withColumnRenamed("id", "first"), "first", "left")
        .select(
            F.col("id").alias("doc_id"),
            F.col("n").alias("n_shingles"),
            component.alias("component_id"),
            F.col("id").eqNullSafe(component).alias("kept"),
        )
    )


def one_of_each_group(documents: DataFrame, *, id: str = "doc_id", **options) -> DataFrame:
    """One document of each group of near-duplicates, with its own columns."""
    kept = near_duplicates(documents, id=id, **options).filter("kept")
    kept_id = unused("_kept_id", documents)
    ids = kept.select(F.col("doc_id").alias(kept_id)).distinct()
    columns = [F.col(f"`{c}`") for c in documents.columns]
    return few(documents.join(ids, F.col(id).eqNullSafe(F.col(kept_id)), "left_semi")).select(*columns)
