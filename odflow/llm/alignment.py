"""Cross-tokenizer alignment by products of token-byte incidence matrices.

A text's tokens under tokenizer A are the rows of a 0/1 matrix over its bytes, those under
tokenizer B another; both are built here as CSR. The row products A·Bᵀ (Gustavson: the row
of a token is the sum of the rows of Bᵀ that its bytes select) hold, for every pair of
tokens that overlap, the bytes they share. Byte offsets at which tokens of both end cut a
text into groups; products of the two group-token matrices link the tokens of a group.

Both tokenizers work on a space and the text. It is cut before spaces and line feeds behind
a character that nothing takes for white space: no pre-token of A and no piece of B reaches
over such a place (checked for B's vocabulary), so tokens, groups and links of a text are
those of its parts, and each distinct part is aligned once, in block-diagonal products of
many parts.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from odflow.llm.common import memo, slices, stored

#: Distinct parts of texts whose alignment a Python worker remembers; emptied when full.
REMEMBERED = 250_000
#: Bytes of text that one slice, one call of a tokenizer and one product take.
SLICE, CALL, PRODUCT = 2_000_000, 50_000, 1_000_000
#: Id pairs that may be broadcast, 17 bytes each.
BROADCAST_PAIRS = 1_000_000

#: Characters that some tokenizer may take for white space, and the one that stands for it in
#: pieces: first and last of each range.
BLANK_RANGES = (
    (0x0, 0x20), (0x7F, 0xA0), (0x1680, 0x1680), (0x180E, 0x180E), (0x2000, 0x200F), (0x2028, 0x202F),
    (0x205F, 0x206F), (0x2581, 0x2581), (0x3000, 0x3000), (0xFEFF, 0xFEFF),
)
BLANK = "".join(f"\\U{first:08x}-\\U{last:08x}" for first, last in BLANK_RANGES)
PARTS = re.compile(rf"[ \n](?:[^ \n]+|(?<=[{BLANK}])[ \n])*")
HOLDS_BLANK = re.compile(rf"[{BLANK}]")


class CSR(NamedTuple):
    """A sparse matrix by rows: row i has the columns indices[indptr[i]:indptr[i + 1]]."""

    indptr: np.ndarray
    indices: np.ndarray
    columns: int


def gathered(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions start, start + 1, ... of every run, one run after another."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def incidence(lengths: np.ndarray) -> CSR:
    """Rows that hold the next ``length`` columns each: tokens by bytes, or groups by tokens."""
    indptr = np.concatenate(([0], np.cumsum(lengths)))
    return CSR(indptr, np.arange(indptr[-1]), int(indptr[-1]))


def transposed(matrix: CSR) -> CSR:
    rows = np.repeat(np.arange(len(matrix.indptr) - 1), np.diff(matrix.indptr))
    order = np.argsort(matrix.indices, kind="stable")
    indptr = np.concatenate(([0], np.cumsum(np.bincount(matrix.indices, minlength=matrix.columns))))
    return CSR(indptr, rows[order], len(matrix.indptr) - 1)


def product(left: CSR, right: CSR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries (row, column, value) of left · right, row by row.

    Every entry of a row of ``left`` selects a row of ``right``; the selected rows are
    laid one after another and equal columns of a row are added up.
    """
    rows = np.repeat(np.arange(len(left.indptr) - 1), np.diff(left.indptr))
    held = np.diff(right.indptr)[left.indices]
    columns = right.indices[gathered(right.indptr[left.indices], held)]
    keys, values = np.unique(np.repeat(rows, held) * right.columns + columns, return_counts=True)
    return keys // right.columns, keys % right.columns, values


def group_ends(a_ends: np.ndarray, b_ends: np.ndarray) -> np.ndarray:
    return np.intersect1d(a_ends, b_ends, assume_unique=True)


def overlap_links(a_lengths: np.ndarray, b_lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, bytes) of all tokens that share bytes, by place, of two tokenisations of the same bytes.

    No link reaches over the end of a group, so long inputs are multiplied in blocks of
    whole groups.
    """
    a_ends, b_ends = np.cumsum(a_lengths), np.cumsum(b_lengths)
    cuts = group_ends(a_ends, b_ends)
    cuts = cuts[np.concatenate((np.diff(cuts // PRODUCT) > 0, [True]))] if len(cuts) else cuts
    found, a_at, b_at = [], 0, 0
    for cut in cuts.tolist():
        a_to, b_to = (int(np.searchsorted(ends, cut, "right")) for ends in (a_ends, b_ends))
        a, b, n = product(incidence(a_lengths[a_at:a_to]), transposed(incidence(b_lengths[b_at:b_to])))
        found.append((a + a_at, b + b_at, n))
        a_at, b_at = a_to, b_to
    if not found:
        return (np.empty(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*found))


def groups_of(a_lengths: np.ndarray, b_lengths: np.ndarray) -> tuple[CSR, CSR]:
    """The group-token matrices of A and of B."""
    a_ends, b_ends = np.cumsum(a_lengths), np.cumsum(b_lengths)
    cuts = group_ends(a_ends, b_ends)
    return tuple(
        incidence(np.diff(np.searchsorted(ends, cuts, "right"), prepend=0)) for ends in (a_ends, b_ends)
    )


def group_links(a_groups: CSR, b_groups: CSR) -> tuple[np.ndarray, np.ndarray]:
    """(a, b) of all tokens that share a group."""
    return product(transposed(a_groups), b_groups)[:2]


class Tokens(NamedTuple):
    ids: np.ndarray
    lengths: np.ndarray


_NONE = Tokens(np.empty(0, np.int64), np.empty(0, np.int64))


class Encoded(NamedTuple):
    """Parts with their tokens one after another, and how many tokens each part has."""

    parts: list[str]
    a: Tokens
    b: Tokens
    n_a: np.ndarray
    n_b: np.ndarray


class Tokenizers:
    """Both tokenizers, and the bytes of every token."""

    def __init__(self, a_path: str, b_path: str) -> None:
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=b_path)
        with open(a_path, encoding="utf-8") as file:
            held = json.load(file)
        vocabulary = held["model"]["vocab"] | {t["content"]: t["id"] for t in held["added_tokens"]}
        byte_of = _byte_of_character()
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(byte_of[c] for c in token) if set(token) <= byte_of.keys() else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
            for i, p in enumerate(pieces)
        ]
        self.a_lengths, self.b_lengths = (np.array([*map(len, x)]) for x in (self.a_bytes, self.b_bytes))
        # parts are independent if no piece reaches over their border and nothing is normalised
        inner = [p.lstrip("▁") for p in pieces]
        plain = not any("▁" in p or "\n" in p for p in inner)
        self.apart = plain and self._b(" a  b c\td\n e") is not None

    def _a(self, text: str) -> Tokens | None:
        ids = self.a.encode_batch_fast([text], add_special_tokens=False)[0].ids  # without offsets
        return self._checked(ids, self.a_bytes, self.a_lengths, text)

    def _b(self, text: str) -> Tokens | None:
        return self._checked(self.b.encode(text[1:]), self.b_bytes, self.b_lengths, text)  # it adds the space

    @staticmethod
    def _checked(ids: list[int], token_bytes: list[bytes], lengths: np.ndarray, text: str) -> Tokens | None:
        if b"".join(map(token_bytes.__getitem__, ids)) != text.encode():
            return None
        held = np.array(ids, np.int64)
        return Tokens(held, lengths[held])

    def parts(self, text: str) -> list[str]:
        """A space and the text, cut into independent parts."""
        return PARTS.findall(" " + text) if self.apart else [" " + text]

    def encoded(self, parts: list[str]) -> Iterator[Encoded]:
        """Tokens of the parts, in blocks; parts whose bytes A's or B's tokens do not give are left out.

        Parts without inner or trailing white space are encoded many at a time.
        """
        group, held = [], 0
        for part in parts:
            if not self.apart or len(part) < 2 or HOLDS_BLANK.search(part, 1):
                yield from self._block([part])
                continue
            group.append(part)
            held += len(part)
            if held > CALL:
                yield from self._block(group)
                group, held = [], 0
        if group:
            yield from self._block(group)

    def whole(self, text: str) -> tuple[Tokens, Tokens]:
        """Tokens of a space and the text by A and B; none if the text has none."""
        a, b = (self._a(" " + text), self._b(" " + text)) if text else (None, None)
        return (_NONE, _NONE) if a is None or b is None else (a, b)

    def _block(self, group: list[str]) -> Iterator[Encoded]:
        # a word in front, whose tokens are dropped, as a part may begin with a line feed
        first = " ." if self.apart else ""
        text = first + "".join(group)
        a = self._a(text)
        b = self._b(text) if a is not None else None
        if b is not None:
            ends = len(first) + np.cumsum([len(p.encode()) for p in group])
            sides = []
            for side in (a, b):
                cuts = np.searchsorted(np.cumsum(side.lengths), np.concatenate(([len(first)], ends)), "right")
                sides.append((Tokens(*(x[cuts[0] :] for x in side)), np.diff(cuts)))
            yield Encoded(group, sides[0][0], sides[1][0], sides[0][1], sides[1][1])
        elif len(group) > 1:
            for part in group:
                yield from self._block([part])


def _byte_of_character() -> dict[str, int]:
    """The byte that each printable character stands for in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class _Growing:
    """An array that grows at its end."""

    def __init__(self, *shape: int) -> None:
        self.held, self.used = np.empty((1024, *shape), np.int64), 0

    def add(self, rows: np.ndarray) -> None:
        need = self.used + len(rows)
        if need > len(self.held):
            more = np.empty((max(need, 2 * len(self.held)) - self.used, *self.held.shape[1:]), np.int64)
            self.held = np.concatenate((self.held[: self.used], more))
        self.held[self.used : need] = rows
        self.used = need


class Alignments:
    """Alignments of parts, each computed once as long as it is remembered."""

    def __init__(self, a_path: str, b_path: str, limit: int = REMEMBERED) -> None:
        self.tokenizers, self.limit = Tokenizers(a_path, b_path), limit
        self.base = len(self.tokenizers.b_bytes)
        # ids as text with what may follow one: a comma, a bar, a semicolon, nothing
        self.n_ids = len(self.tokenizers.a_bytes) + self.base
        ids = [*map(str, range(len(self.tokenizers.a_bytes))), *map(str, range(self.base))]
        self.id_texts = [i + mark for mark in (",", "|", ";", "") for i in ids]
        self._empty()

    def _empty(self) -> None:
        self.known: dict[str, int] = {}  # the number of an aligned part, -1 for one without tokens
        self.texts: list[str] = []
        self.sizes, self.runs = _Growing(len(SIZES)), _Growing(2)
        self.pairs = _Growing(2)

    def learn(self, needed: Iterable[str]) -> None:
        fresh = [p for p in needed if p not in self.known]
        if len(self.known) + len(fresh) > self.limit:
            self._empty()
            fresh = list(needed)
        self.known.update(dict.fromkeys(fresh, -1))
        for block in self.tokenizers.encoded(fresh):
            self._align(block)

    def _align(self, block: Encoded) -> None:
        """One block-diagonal product for all parts: a part's last byte ends a group."""
        parts, a, b, n_a, n_b = block
        a_at, b_at, _ = overlap_links(a.lengths, b.lengths)
        of_a = np.repeat(np.arange(len(parts)), n_a)
        a_groups, b_groups = groups_of(a.lengths, b.lengths)
        in_a, in_b = np.diff(a_groups.indptr), np.diff(b_groups.indptr)
        of_group = of_a[a_groups.indptr[:-1]]
        n_links, n_groups = (np.bincount(x, minlength=len(parts)) for x in (of_a[a_at], of_group))
        n_shared = np.bincount(of_group, in_a * in_b, len(parts)).astype(np.int64)
        # id pairs of every part with their numbers of links
        key, part = a.ids[a_at] * self.base + b.ids[b_at], of_a[a_at]
        order = np.lexsort((key, part))
        key, part = key[order], part[order]
        first = np.flatnonzero(np.concatenate(([True], (np.diff(key) != 0) | (np.diff(part) != 0))))
        held = np.bincount(part[first], minlength=len(parts))
        starts = self.pairs.used + np.cumsum(held) - held
        self.pairs.add(np.stack((key[first], np.diff(np.append(first, len(key)))), 1))
        self.sizes.add(np.stack((n_a, n_b, n_groups, n_links, n_shared), 1))
        self.runs.add(np.stack((starts, held), 1))
        self.known.update(zip(parts, range(len(self.texts), len(self.texts) + len(parts))))
        # tokens in the order of groups, A before B, each with the mark that follows it
        code = np.empty(len(a.ids) + len(b.ids), np.int64)
        a_place = np.arange(len(a.ids)) + np.repeat(b_groups.indptr[:-1], in_a)
        b_place = np.arange(len(b.ids)) + np.repeat(a_groups.indptr[1:], in_b)
        code[a_place], code[b_place] = a.ids, b.ids + (self.n_ids - self.base)
        code[a_place[a_groups.indptr[1:] - 1]] += self.n_ids
        code[b_place[b_groups.indptr[1:] - 1]] += 2 * self.n_ids
        ends = np.cumsum(n_a + n_b)
        code[ends - 1] += self.n_ids
        marked = [*map(self.id_texts.__getitem__, code.tolist())]
        self.texts += ["".join(marked[x:y]) for x, y in zip([0, *ends.tolist()], ends.tolist())]

    def document(self, parts: list[str]) -> tuple | None:
        """Sizes, hash of the groups, and id pairs with their numbers of links, of one text."""
        held = [*map(self.known.__getitem__, parts)]
        numbers = np.array(held, np.int64)
        if not held or numbers.min() < 0:
            return None
        own, times = np.unique(numbers, return_counts=True)
        starts, lengths = self.runs.held[own].T
        key, links = self.pairs.held[gathered(starts, lengths)].T
        keys, where = np.unique(key, return_inverse=True)
        counts = np.bincount(where, links * np.repeat(times, lengths), len(keys)).astype(np.int64)
        digest = hashlib.sha256(";".join(map(self.texts.__getitem__, held)).encode()).hexdigest()
        return (self.sizes.held[own] * times[:, None]).sum(0), digest, keys, counts


SIZES = ("n_a", "n_b", "n_groups", "n_links", "n_group_links")
_DIGEST = (
    ", ".join(f"{name} bigint" for name in SIZES)
    + ", groups_sha256 string, pairs array<bigint>, pair_links array<bigint>"
)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([*map(len, arrays)]))).astype(np.int32)
    return pa.ListArray.from_arrays(offsets, np.concatenate(arrays) if arrays else np.empty(0, np.int64))


def _digests(a_path: str, b_path: str, limit: int):
    nothing = ([0] * len(SIZES), "", np.empty(0, np.int64), np.empty(0, np.int64))

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligned = memo(f"alignments {a_path} {b_path} {limit}", lambda: Alignments(a_path, b_path, limit))
        for batch in batches:
            for texts, ids in slices(batch.column(1), SLICE, batch.column(0)):
                parts = [aligned.tokenizers.parts(t) if t else [] for t in texts.to_pylist()]
                aligned.learn(dict.fromkeys(p for own in parts for p in own))
                found = [aligned.document(own) or nothing for own in parts]
                sizes = [pa.array(x) for x in np.array([f[0] for f in found], np.int64).reshape(-1, len(SIZES)).T]
                yield pa.RecordBatch.from_arrays(
                    [ids, *sizes, pa.array([f[1] for f in found], pa.string()), *(_lists([f[k] for f in found]) for k in (2, 3))],
                    [batch.schema.names[0], *SIZES, "groups_sha256", "pairs", "pair_links"],
                )

    return digests


def _partial_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums per pair, emptied as soon as they are as many as a broadcast may hold."""
    keys, counts = np.empty(0, np.int64), np.empty(0, np.int64)
    for batch in batches:
        own, n = (batch.column(k).flatten().to_numpy(zero_copy_only=False) for k in (0, 1))
        keys, where = np.unique(np.concatenate((keys, own)), return_inverse=True)
        counts = np.bincount(where, np.concatenate((counts, n)), len(keys)).astype(np.int64)
        if len(keys) > BROADCAST_PAIRS:
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], ["pair", "n"])
            keys, counts = keys[:0], counts[:0]
    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], ["pair", "n"])


def _scores(shared):
    """Links with the best pair of their B id, and sums of counts, over the broadcast pairs; the other pairs."""

    def scores(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        pairs, counts, best = shared.value
        for keys, links in batches:
            offsets = keys.offsets.to_numpy() - keys.offsets[0].as_py()
            own, n = (x.flatten().to_numpy(zero_copy_only=False) for x in (keys, links))
            at = np.minimum(np.searchsorted(pairs, own), max(0, len(pairs) - 1))
            hit = pairs[at] == own if len(pairs) else np.zeros(len(own), bool)
            sums = []
            for values in (np.where(hit, best[at] * n, 0), np.where(hit, counts[at] * n, 0)) if len(pairs) else (n * 0, n * 0):
                total = np.concatenate(([0], np.cumsum(values)))
                sums.append(pa.array(total[offsets[1:]] - total[offsets[:-1]], pa.int64()))
            rest = np.concatenate(([0], np.cumsum(~hit)))[offsets].astype(np.int32)
            lists = [pa.ListArray.from_arrays(rest, x[~hit]) for x in (own, n)]
            yield pa.StructArray.from_arrays([*sums, *lists], ["n_best", "count_sum", "pairs", "links"])

    return F.arrow_udf(scores, "struct<n_best: bigint, count_sum: bigint, pairs: array<bigint>, links: array<bigint>>")


def pair_counts(digests: DataFrame, b_size: int) -> DataFrame:
    """``(pair, n, best)``: the links of every id pair, and whether no pair of its B id has more."""
    partial = digests.select("pairs", "pair_links").mapInArrow(_partial_counts, "pair bigint, n bigint")
    counts = stored(partial.groupBy("pair").agg(F.sum("n").alias("n")))
    b = (F.col("pair") % b_size).alias("b")
    most = counts.groupBy(b).agg(F.max("n").alias("most"))  # one row for each entry of B's vocabulary
    return counts.join(F.broadcast(most), F.col("pair") % b_size == F.col("b")).select(
        "pair", "n", (F.col("n") == F.col("most")).alias("best")
    )


def aligned_documents(
    documents: DataFrame,
    a_path: str,
    b_path: str,
    *,
    id: str = "doc_id",
    text: str = "text",
    remembered: int = REMEMBERED,
    broadcast_pairs: int = BROADCAST_PAIRS,
) -> DataFrame:
    """How tokens of two tokenizers lie on each other, one row for each row of ``documents``.

    ``a_path`` is a byte-level tokenizers file, ``b_path`` a sentencepiece model; both
    encode a space and the text, with special tokens' strings as plain text. Columns:
    ``id``; ``n_a``, ``n_b`` tokens; ``n_groups`` between offsets where both end;
    ``n_links`` of tokens that share bytes, ``n_group_links`` of tokens that share a
    group; ``n_best`` links whose id pair is linked as often as any pair of its B id in
    all documents; ``count_sum``, over the links, of how often their pair is linked;
    ``groups_sha256`` of ``a1,a2|b1;a3|b2,b3``. A text that is null or empty, or whose
    bytes the tokens of A or B do not give, has no tokens: zeros and an empty hash.
    Repeated rows count as often as they occur; other columns are neither read nor
    returned; no rows give no rows.

    Id pairs within ``broadcast_pairs`` are broadcast; if there are more, those of at
    least that share of all links are, of which there cannot be more, and the rest is
    joined.
    """
    spark = documents.sparkSession
    rows = documents.select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    found = rows.mapInArrow(_digests(a_path, b_path, remembered), f"id {kind}, {_DIGEST}")
    found = stored(found.withColumn("row", F.monotonically_increasing_id()))
    counts = stored(pair_counts(found, len(Tokenizers(a_path, b_path).b_bytes)))
    size, total = counts.agg(F.count("*"), F.sum("n")).first()
    every = size <= broadcast_pairs
    hot = counts if every else counts.filter(F.col("n") * broadcast_pairs >= total)
    held = hot.orderBy("pair").toPandas()
    shared = spark.sparkContext.broadcast(tuple(held[c].to_numpy(np.int64) for c in ("pair", "n", "best")))
    scored = found.withColumn("s", _scores(shared)("pairs", "pair_links"))
    best, count_sum = F.col("s.n_best"), F.col("s.count_sum")
    if not every:
        rest = scored.select("row", F.explode(F.arrays_zip("s.pairs", "s.links")).alias("x"))
        rest = (
            rest.select("row", F.col("x.pairs").alias("pair"), F.col("x.links").alias("links"))
            .join(counts, "pair")
            .groupBy(F.col("row").alias("rest_row"))
            .agg(
                F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("rest_best"),
                F.sum(F.col("links") * F.col("n")).alias("rest_sum"),
            )
        )
        scored = scored.join(rest, F.col("row") == F.col("rest_row"), "left")
        best = best + F.coalesce("rest_best", F.lit(0))
        count_sum = count_sum + F.coalesce("rest_sum", F.lit(0))
    return scored.select(
        F.col("id").alias(id), *SIZES, best.alias("n_best"), count_sum.alias("count_sum"), "groups_sha256"
    )


def _link_rows(a_path: str, b_path: str):
    def links(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tokenizers = memo(f"tokenizers {a_path} {b_path}", lambda: Tokenizers(a_path, b_path))
        for batch in batches:
            out = []
            for text in batch.to_pylist():
                a, b = tokenizers.whole(text or "")
                found = zip(*(x.tolist() for x in overlap_links(a.lengths, b.lengths)))
                a_groups, b_groups = groups_of(a.lengths, b.lengths)
                ends = zip(a_groups.indptr[1:].tolist(), b_groups.indptr[1:].tolist())
                out.append(
                    {
                        "a_ids": a.ids.tolist(),
                        "b_ids": b.ids.tolist(),
                        "overlaps": [{"a": x, "b": y, "bytes": n} for x, y, n in found],
                        "groups": [{"a_end": x, "b_end": y} for x, y in ends],
                    }
                )
            yield pa.array(out, _LINKS)

    return F.arrow_udf(
        links,
        "struct<a_ids: array<int>, b_ids: array<int>, overlaps: array<struct<a: int, b: int, bytes: int>>,"
        " groups: array<struct<a_end: int, b_end: int>>>",
    )


_INTS = pa.list_(pa.int32())
_LINKS = pa.struct(
    [
        ("a_ids", _INTS),
        ("b_ids", _INTS),
        ("overlaps", pa.list_(pa.struct([(x, pa.int32()) for x in ("a", "b", "bytes")]))),
        ("groups", pa.list_(pa.struct([("a_end", pa.int32()), ("b_end", pa.int32())]))),
    ]
)


def with_links(
    documents: DataFrame, a_path: str, b_path: str, *, text: str = "text", result: str = "alignment"
) -> DataFrame:
    """Add the struct ``result``: ids, overlap links (places and shared bytes) and ends of groups.

    A text without tokens, as ``aligned_documents`` says, has empty lists. A column called
    like ``result`` is replaced.
    """
    return documents.withColumn(result, _link_rows(a_path, b_path)(F.col(f"`{text}`").cast("string")))
