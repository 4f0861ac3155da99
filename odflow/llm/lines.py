"""Removal of lines that spread over many sites.

HyperLogLog sketches of a line's sites merge by aggregation. Lines whose estimate lies
near the threshold get an exact distinct count, so sketch errors decide nothing. A line
is known by its 128-bit hash; its first place stays, so that what only exists as copies
on several sites is not lost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from odflow.llm.common import cut, few, slices, unused

MIN_SITES = 5
MIN_WORDS = 3
LG_K = 12
#: Bytes of text whose lines are held at a time.
SLICE = 4_000_000

#: Scripts written without spaces between words; each of their characters counts as a word.
UNSPACED = "".join(
    rf"\p{{Is{script}}}"
    for script in (
        "Han Hiragana Katakana Bopomofo Yi Thai Lao Khmer Myanmar Tibetan Tai_Le New_Tai_Lue Tai_Tham Tai_Viet "
        "Javanese Balinese"
    ).split()
)

RESULT = pa.struct([("text", pa.string()), ("n_lines", pa.int64()), ("n_removed", pa.int64())])


def shared_lines(rows: DataFrame, min_sites: int, lg_k: int = LG_K) -> DataFrame:
    """``(key, first)`` of lines on at least ``min_sites`` sites; rows (id, pos, key, site)."""
    place = F.when(F.col("id").isNotNull(), F.struct("id", "pos"))
    spread = cut(few(
        rows.groupBy("key").agg(
            F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(lg_k))).alias("sites"),
            F.count("*").alias("n"),
            F.min(place).alias("first"),
        )
        .filter(F.col("n") >= min_sites)
    ))
    margin = max(2.0, 4 * 1.04 / math.sqrt(2**lg_k) * min_sites)
    near = spread.filter(F.abs(F.col("sites") - min_sites) <= margin)
    exact = (
        rows.join(near.select("key"), "key", "left_semi")
        .groupBy("key", "site")
        .agg(F.lit(1))
        .groupBy("key")
        .agg(F.count("site").alias("exact"))
        .filter(F.col("exact") >= min_sites)
    )
    above = spread.filter(F.col("sites") > min_sites + margin).select("key", "first")
    return above.unionByName(near.join(exact, "key").select("key", "first"))


def _without(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for batch in batches:
        done = []
        for texts, places in slices(batch[0], SLICE, batch[1]):
            out = []
            for text, gone in zip(texts.to_pylist(), places.to_pylist()):
                if text is None:
                    out.append({"text": None, "n_lines": 0, "n_removed": 0})
                    continue
                lines, gone = text.split("\n"), set(gone or ())
                kept = [line for i, line in enumerate(lines) if i not in gone]
                out.append({"text": "\n".join(kept), "n_lines": len(lines), "n_removed": len(lines) - len(kept)})
            done.append(pa.array(out, RESULT))
        yield pa.concat_arrays(done)


def remove_shared_lines(
    documents: DataFrame,
    *,
    id: str = "doc_id",
    text: str = "text",
    site: str = "source",
    min_sites: int = MIN_SITES,
    min_words: int = MIN_WORDS,
    lg_k: int = LG_K,
    result: str = "without_shared_lines",
) -> DataFrame:
    """Add the struct ``result`` (text, n_lines, n_removed) to every document.

    Lines end at line feeds. Lines of at least ``min_words`` words that stand on
    ``min_sites`` or more distinct sites go, but for their first place (smallest id,
    then line). Words are runs between ASCII white space; in scripts written without
    spaces every character counts as one. A null text stays null, without lines; an empty
    one has one line. A missing site is no site. Rows that share an id lose the same
    places. Lines of a row without an id count, but stay. A column called like ``result``
    is replaced.
    """
    space = r"\x20\x09-\x0D"
    spaced = rf"(?:[^{space}]+[{space}]+){{{min_words - 1}}}[^{space}]"
    word = rf"(?:[{UNSPACED}]|[^{space}{UNSPACED}]++)"
    unspaced = rf"(?:{word}[{space}]*+){{{min_words - 1}}}{word}"
    rows = documents.select(
        F.col(id).cast("long").alias("id"),
        F.col(site).cast("string").alias("site"),
        F.posexplode(F.split(F.col(text), "\n")).alias("pos", "line"),
    ).filter(F.col("line").rlike(spaced) | F.col("line").rlike(unspaced))
    rows = rows.select("id", "site", "pos", F.unhex(F.md5(F.col("line").cast("binary"))).alias("key"))
    line_id, places = (unused(name, documents) for name in ("_line_id", "_line_places"))
    gone = (
        rows.join(shared_lines(rows, min_sites, lg_k), "key")
        .filter((F.col("id") != F.col("first.id")) | (F.col("pos") != F.col("first.pos")))
        .groupBy(F.col("id").alias(line_id))
        .agg(F.collect_set("pos").alias(places))
    )
    without = F.arrow_udf(_without, "struct<text: string, n_lines: bigint, n_removed: bigint>")
    columns = [F.col(f"`{c}`") for c in documents.columns if c != result]
    return few(documents.join(gone, F.col(id) == F.col(line_id), "left")).select(
        *columns, without(F.col(text), places).alias(result)
    )


def with_lines_removed(documents: DataFrame, *, text: str = "text", **options) -> DataFrame:
    """The documents with the text that stays, and ``n_chars`` of it where there is that column."""
    result = unused("_cleaned", documents)
    cleaned = remove_shared_lines(documents, text=text, result=result, **options)
    new = {text: F.col(f"{result}.text"), "n_chars": F.length(f"{result}.text").cast("long")}
    return cleaned.select(*(new.get(c, F.col(f"`{c}`")).alias(c) for c in documents.columns))
