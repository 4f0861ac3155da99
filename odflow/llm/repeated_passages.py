"""Removal of passages that an earlier document holds, by suffix automata of reference shards.

A window is ``length`` consecutive words. A word goes if it lies in a window that also
starts in a document with a smaller id.

1. Every window owns an anchor: the run of ``ANCHOR_WORDS`` words in it with the
   smallest hash, the leftmost of equals. Equal windows own equal anchors at the same
   place, so only windows of anchors that occur twice can repeat. Neighbouring windows
   with one anchor make a context, and equal contexts of all documents make a class
   with its smallest document.
   A class that has its anchor alone holds all occurrences of its windows, and their
   smallest document is known. Only anchors with several classes go on. In any class all
   documents but the smallest lose the whole context.
2. These classes are dealt by anchor to reference shards of bounded size. A task builds the
   generalised suffix automaton of its shard, whose states know the smallest document in
   which their words occur, and streams the contexts through it for matching statistics.
   The reference side of an anchor with very many classes is cut into parts, and every
   part is sent to every part of the streamed side.
3. Spans whose match is long enough and whose state knows a smaller document are cut
   from the smallest document of the class.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from odflow.llm.common import cut, gram_hashes, hashed_words, mix, slices, small

LENGTH = 50
ANCHOR_WORDS = 8
CHUNK_BYTES = 2_000_000
#: Classes in a shard, and of one anchor before it is cut into parts.
SHARD_CLASSES, PART_CLASSES = 1_000, 250
#: Bits of a sort key that hold the place in a chunk; the rest are of the hash.
_PLACE = 30
_B = 0x9E3779B97F4A7C15
_M64 = (1 << 64) - 1

CONTEXT = pa.struct(
    [("anchor", pa.int64()), ("context", pa.int64()), ("start", pa.int32()), ("n", pa.int32())]
)


def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.concatenate(([1], np.full(n, _B, np.uint64))).astype(np.uint64))


def _sliding_least(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive keys, by doubling."""
    least, span = keys, 1
    while 2 * span <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    rest = width - span
    return np.minimum(least[: len(least) - rest], least[rest:]) if rest else least


def contexts_of(hashes: list[np.ndarray], length: int) -> pa.Array:
    """The contexts of some documents, a list for each, given the hashes of their words."""
    none = pa.array([[]] * len(hashes), pa.list_(CONTEXT))
    sizes = np.array([len(h) for h in hashes])
    ends = np.cumsum(sizes)
    words = np.concatenate(hashes) if len(hashes) else np.empty(0, np.uint64)
    if len(words) < length:
        return none
    width = min(ANCHOR_WORDS, length)
    grams = gram_hashes(words, width)
    place = np.uint64(_PLACE)
    keys = (grams >> place << place) | np.arange(len(grams), dtype=np.uint64)
    least = _sliding_least(keys, length - width + 1)
    anchor = (least & np.uint64((1 << _PLACE) - 1)).astype(np.int64)
    owner = np.repeat(np.arange(len(hashes)), sizes)[: len(anchor)]
    inside = np.arange(len(anchor)) + length <= ends[owner]
    first = inside.copy()
    first[1:] &= ~inside[:-1] | (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])
    starts = np.flatnonzero(first)
    if not len(starts):
        return none
    run = np.cumsum(first)[inside]
    n = np.bincount(run, minlength=len(starts) + 1)[1:]
    # a hash of the context's words, from the start to the last word of the last window
    spans = n + length - 1
    content = np.zeros(len(starts), np.uint64)
    powers = _powers(int(spans.max()))
    for i in range(int(spans.max())):
        more = spans > i
        content[more] = content[more] * np.uint64(_B) + words[starts[more] + i]
    offset = (anchor[starts] - starts).astype(np.uint64)
    content = mix(content + powers[n] + mix(offset + np.uint64(1)))
    own = owner[starts]
    columns = [
        grams[anchor[starts]].astype(np.int64),
        content.astype(np.int64),
        (starts - (ends - sizes)[own]).astype(np.int32),
        n.astype(np.int32),
    ]
    rows = pa.StructArray.from_arrays([pa.array(c) for c in columns], fields=list(CONTEXT))
    offsets = np.concatenate(([0], np.cumsum(np.bincount(own, minlength=len(hashes)))))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), rows)


def _contexts(length: int):
    def contexts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for texts in slices(batch, CHUNK_BYTES):
                yield contexts_of([hashed_words(t.split() if t else []) for t in texts.to_pylist()], length)

    return F.arrow_udf(
        contexts, "array<struct<anchor: bigint, context: bigint, start: int, n: int>>"
    )


def _passages(length: int):
    def passages(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for batch, wanted in batches:
            for texts, own in slices(batch, CHUNK_BYTES, wanted):
                rows = []
                for text, spans in zip(texts.to_pylist(), own.to_pylist()):
                    words = text.split() if text else []
                    rows.append([b" ".join(words[s["start"] : s["start"] + s["n"] + length - 1]) for s in spans])
                yield pa.array(rows, pa.list_(pa.binary()))

    return F.arrow_udf(passages, "array<binary>")


class SuffixAutomaton:
    """Generalised suffix automaton whose states know the smallest document of their words."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.len = [0]
        self.least: list[int | None] = [None]

    def _state(self, length: int, moves: dict, link: int, least: int | None) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.len.append(length)
        self.least.append(least)
        return len(self.len) - 1

    def _split(self, p: int, q: int, word) -> int:
        """The state for the words that reach q over p, made apart from q if longer ones share it."""
        if self.len[p] + 1 == self.len[q]:
            return q
        copy = self._state(self.len[p] + 1, dict(self.next[q]), self.link[q], None)
        self.link[q] = copy
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        return copy

    def add(self, words: list, document: int) -> None:
        last = 0
        for word in words:
            p = last
            if (q := self.next[p].get(word)) is not None:
                last = self._split(p, q, word)
            else:
                last = self._state(self.len[p] + 1, {}, 0, None)
                while p >= 0 and word not in self.next[p]:
                    self.next[p][word] = last
                    p = self.link[p]
                if p >= 0:
                    target = self._split(p, self.next[p][word], word)
                    self.link[last] = target
            known = self.least[last]
            self.least[last] = document if known is None else min(known, document)

    def finish(self) -> None:
        """Tell every suffix the smallest document of the words that end in it."""
        for v in sorted(range(1, len(self.len)), key=self.len.__getitem__, reverse=True):
            up, own = self.link[v], self.least[v]
            if up > 0 and own is not None and (self.least[up] is None or own < self.least[up]):
                self.least[up] = own

    def stream(self, words: list, length: int) -> Iterator[int | None]:
        """For each window of ``length`` words the smallest document that holds it, if any."""
        state = matched = 0
        moves, link, lens = self.next, self.link, self.len
        for i, word in enumerate(words):
            while state and word not in moves[state]:
                state = link[state]
                matched = lens[state]
            if word in moves[state]:
                state, matched = moves[state][word], matched + 1
            if matched > length:
                matched = length
            while state and lens[link[state]] >= length:
                state = link[state]
            if i >= length - 1:
                yield self.least[state] if matched >= length else None


def _with_repeats(rows: pd.DataFrame, words: list[list[bytes]], length: int) -> np.ndarray:
    """Which rows hold a window whose hash occurs again in their block.

    Equal windows have equal hashes, so the other rows share no window with a row.
    """
    sizes = np.array([len(w) for w in words])
    owner, ends = np.repeat(np.arange(len(words)), sizes), np.cumsum(sizes)
    grams = gram_hashes(np.concatenate([hashed_words(w) for w in words]), length)
    at = np.flatnonzero(np.arange(len(grams)) + length <= ends[owner[: len(grams)]])
    block = rows.groupby(["anchor", "i", "j"], sort=False).ngroup().to_numpy().astype(np.uint64)
    windows = grams[at] + block[owner[at]] * np.uint64(_B)
    _, which, times = np.unique(windows, return_inverse=True, return_counts=True)
    again = np.zeros(len(words), bool)
    again[owner[at[times[which] > 1]]] = True
    return again


def _match(length: int):
    def match(rows: pd.DataFrame) -> pd.DataFrame:
        words = [w.split(b" ") for w in rows["words"]]
        rows["words"] = pd.Series(words, rows.index, dtype=object)
        again = _with_repeats(rows, words, length)
        # a context that shares no window has the smallest document of its class alone
        single = rows[~again & rows.reference & rows.streamed]
        out = [(r.anchor, r.context, 0, len(r.words) - length + 1, r.document) for r in single.itertuples()]
        for _, shard in rows[again].groupby(["anchor", "i", "j"], sort=False):
            automaton = SuffixAutomaton()
            for row in shard[shard.reference].itertuples():
                automaton.add(row.words, row.document)
            automaton.finish()
            for row in shard[shard.streamed].itertuples():
                begin, known = 0, None
                found = [*automaton.stream(row.words, length), None]
                for at, document in enumerate(found):
                    if document != known:
                        if known is not None:
                            out.append((row.anchor, row.context, begin, at, known))
                        begin, known = at, document
        return pd.DataFrame(out, columns=["anchor", "context", "begin", "end", "least"]).astype("int64")

    return match


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _merge(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        rows = []
        for spans in batch.to_pylist():
            merged: list[dict] = []
            for start, end in sorted((s["start"], s["end"]) for s in spans):
                if merged and start <= merged[-1]["end"]:
                    merged[-1]["end"] = max(end, merged[-1]["end"])
                else:
                    merged.append({"start": start, "end": end})
            rows.append(merged)
        yield pa.array(rows, SPANS)


def _merged_udf():
    return F.arrow_udf(_merge, "array<struct<start: bigint, end: bigint>>")


CLEANED = pa.struct(
    [
        ("n_words", pa.int64()),
        ("n_removed", pa.int64()),
        ("kept_text", pa.string()),
        ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
    ]
)


def _clean(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for batch, spans in batches:
        for texts, cut_out in slices(batch, CHUNK_BYTES, spans):
            rows = []
            for text, own in zip(texts.to_pylist(), cut_out.to_pylist()):
                words = text.split() if text else []
                kept, at = [], 0
                for span in own or ():
                    kept += words[at : span["start"]]
                    at = span["end"]
                kept += words[at:]
                rows.append(
                    {
                        "n_words": len(words),
                        "n_removed": len(words) - len(kept),
                        "kept_text": b" ".join(kept).decode(),
                        "spans": own or [],
                    }
                )
            yield pa.array(rows, CLEANED)


def remove_repeated_passages(
    documents: DataFrame, *, id: str = "doc_id", text: str = "text", length: int = LENGTH
) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept_text, spans)`` of every document.

    Words are runs of anything but ASCII white space; ``kept_text`` joins the words that
    stay by a space and ``spans`` are the merged ranges of removed words (end exclusive).
    Windows are judged on the input. Null texts have no words, documents of fewer than
    ``length`` words no windows. Rows that share an id do not remove each other's words;
    a row without an id is neither smaller nor larger than any, so it keeps its words.
    Other columns are ignored.
    """
    source = documents.select(F.col(id).cast("long").alias("id"), F.col(text).cast("binary").alias("text"))
    known = source.filter("id is not null")
    contexts = known.select("id", F.explode(_contexts(length)("text")).alias("c")).select("id", "c.*")

    repeated = contexts.groupBy("anchor").agg(F.count("*").alias("n_found")).filter("n_found > 1")
    live = cut(contexts.join(small(cut(repeated.select("anchor"))), "anchor"))
    classes = cut(
        live.groupBy("anchor", "context").agg(F.min(F.struct("id", "start", "n")).alias("at")).select(
            "anchor", "context", "at.*"
        )
    )

    per_anchor = classes.groupBy("anchor").agg(F.count("*").alias("n_classes"))
    classes = classes.join(per_anchor, "anchor")
    several = cut(classes.filter("n_classes > 1"))

    # the words of each class, from its smallest document
    wanted = several.groupBy("id").agg(
        F.collect_list(F.struct("anchor", "context", "start", "n", "n_classes")).alias("wanted")
    )
    spans = F.transform("wanted", lambda w: F.struct(w["start"].alias("start"), w["n"].alias("n")))
    passages = (
        known.join(small(cut(wanted), items="size(wanted)"), "id")
        .withColumn("found", _passages(length)("text", spans))
        .select("id", F.explode(F.arrays_zip("wanted", "found")).alias("z"))
        .select("id", "z.wanted.*", F.col("z.found").alias("words"))
        # a row that shares its id with another one may not be the one the class was taken from
        .filter(F.size(F.split(F.col("words").cast("string"), " ")) == F.col("n") + length - 1)
        .groupBy("anchor", "context")
        .agg(
            F.min("words").alias("words"),
            F.min("id").alias("document"),
            F.ceil(F.max("n_classes") / PART_CLASSES).cast("int").alias("parts"),
        )
    )
    # rows in the shards: one for each class, or two for each part of its anchor
    parts = F.ceil(F.col("n_classes") / PART_CLASSES)
    copies = F.when(parts > 1, 2 * parts).otherwise(1)
    shards = max(1, (several.agg(F.sum(copies).cast("long")).first()[0] or 0) // SHARD_CLASSES)
    ready = passages.withColumn("part", F.pmod(F.xxhash64("context"), "parts").cast("int"))
    every = F.sequence(F.lit(0), F.col("parts") - 1)
    columns = ["anchor", "context", "document", "words"]
    whole = ready.filter("parts = 1").select(
        *columns, F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(True).alias("reference"), F.lit(True).alias("streamed")
    )
    split = ready.filter("parts > 1")
    references = split.select(
        *columns, F.explode(every).alias("i"), F.col("part").alias("j"), F.lit(True).alias("reference"), F.lit(False).alias("streamed")
    )
    streams = split.select(
        *columns, F.col("part").alias("i"), F.explode(every).alias("j"), F.lit(False).alias("reference"), F.lit(True).alias("streamed")
    )
    matched = (
        whole.unionByName(references)
        .unionByName(streams)
        .withColumn("shard", F.pmod(F.xxhash64("anchor", "i", "j"), F.lit(shards)))
        .groupBy("shard")
        .applyInPandas(
            _match(length), "anchor bigint, context bigint, begin bigint, end bigint, least bigint"
        )
    )
    # Every window of a class starts in its smallest document, so that the other documents
    # lose the whole context, and only the smallest needs the spans of earlier documents.
    earlier = matched.groupBy("anchor", "context").agg(
        F.collect_set(F.struct("begin", "end", "least")).alias("found")
    )
    first = (
        classes.select("anchor", "context", F.col("id").alias("first"))
        .join(earlier, ["anchor", "context"], "left")
        .select("anchor", "context", "first", F.filter("found", lambda x: x["least"] < F.col("first")).alias("found"))
    )
    context = F.array(F.struct(F.lit(0).cast("long").alias("begin"), F.col("n").cast("long").alias("end")))
    own = F.transform("found", lambda x: F.struct(x["begin"].alias("begin"), x["end"].alias("end")))
    removed = (
        live.join(first, ["anchor", "context"])
        .select("id", "start", F.explode(F.when(F.col("id") > F.col("first"), context).otherwise(own)).alias("x"))
        .select(
            "id",
            F.struct(
                (F.col("start") + F.col("x.begin")).alias("start"),
                (F.col("start") + F.col("x.end") + length - 1).alias("end"),
            ).alias("span"),
        )
        .distinct()
        .groupBy("id")
        .agg(_merged_udf()(F.collect_list("span")).alias("removed"))
    )
    result = _clean_udf()("text", "removed")
    return (
        source.join(small(cut(removed), items="size(removed)"), "id", "left")
        .select(F.col("id").alias("doc_id"), result.alias("r"))
        .select("doc_id", "r.*")
    )


def _clean_udf():
    return F.arrow_udf(
        _clean,
        "struct<n_words: bigint, n_removed: bigint, kept_text: string, "
        "spans: array<struct<start: bigint, end: bigint>>>",
    )
