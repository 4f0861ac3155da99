"""Token counts with a whole-token shortcut.

Offline, every string of the vocabulary that is one pre-token and that the library
encodes as exactly one token is proved to be a whole token. A text is split by the
tokenizer's own pattern; pre-tokens among the proved strings count 1 without merging, and
only the rest goes through the library, once for each distinct pre-token.

The pattern is run by another engine than the library's, and the two might differ on
controls and characters beyond Latin. A text that holds some is cut where a printable
ASCII character meets ASCII white space. No pre-token crosses such a place, as those that
hold the character hold no white space behind it, and the pattern looks only ahead, so
each part is split as it would be in the text. Parts with such characters go through the
library, once for each distinct one; the parts between them are split here. A text with
a special token's string goes through the library whole.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from odflow.llm.common import memo, slices
from odflow.llm.tokens import REMEMBERED, load

#: Bytes of texts whose pre-tokens are held at a time.
SLICE = 1_000_000

#: The pre-tokenizer's pattern of byte-level files, which they name but do not hold.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts of tab, line ends, printable ASCII and Latin letters only.
PLAIN = r"[\t\n\r\x20-\x7e -ɏ]*"


#: Places that no pre-token crosses, whatever stands around them.
BORDER = re.compile(r"(?<=[!-~])(?=[\t\n\r ])")
#: Longer pre-tokens, in characters, are counted but not remembered.
LONG = 100
_split, _plain = regex.compile(PATTERN).findall, regex.compile(PLAIN).fullmatch


def pretokens(text: str) -> list[str]:
    """Pre-tokens of a text; a part between borders that holds other than plain characters is left whole."""
    if _plain(text):
        return _split(text)
    out: list[str] = []
    for plain, parts in groupby(BORDER.split(text), lambda part: _plain(part) is not None):
        out.extend(_split("".join(parts)) if plain else parts)
    return out


def whole_tokens(path: str) -> set[str]:
    """The vocabulary strings that are one pre-token and encode, alone, as one token."""
    with open(path, encoding="utf-8") as file:
        held = json.load(file)
    special = {t["content"] for t in held["added_tokens"]}
    byte_of = {c: b for b, c in _byte_characters().items()}
    strings = []
    for token in held["model"]["vocab"]:
        try:
            strings.append(bytes(byte_of[c] for c in token).decode())
        except (KeyError, UnicodeDecodeError):
            continue  # a special token, or part of a character
    split = regex.compile(PATTERN)
    alone = [s for s in strings if s not in special and split.fullmatch(s) and split.findall(s) == [s]]
    encoded = load(path).encode_batch_fast(alone, add_special_tokens=False)
    return {s for s, found in zip(alone, encoded) if len(found) == 1}


def _byte_characters() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class _Counts(dict):
    """Tokens of pre-tokens: 1 for the proved strings, the library's count for others."""

    def __init__(self, path: str, whole: set[str]) -> None:
        super().__init__(dict.fromkeys(whole, 1))
        self.whole, self.tokenizer = whole, load(path)

    def __missing__(self, pretoken: str) -> int:
        return len(self.tokenizer.encode(pretoken, add_special_tokens=False))

    def learn(self, pretokens: set[str]) -> None:
        fresh = list(pretokens - self.keys())
        if len(self) + len(fresh) > len(self.whole) + REMEMBERED:
            self.clear()
            self.update(dict.fromkeys(self.whole, 1))
            fresh = list(pretokens - self.whole)
        for pretoken, found in zip(fresh, self.tokenizer.encode_batch_fast(fresh, add_special_tokens=False)):
            self[pretoken] = len(found)


def _counter(path: str, shared):
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counts = memo(f"token counts {path}", lambda: _Counts(path, shared.value))
        with open(path, encoding="utf-8") as file:
            special = [t["content"] for t in json.load(file)["added_tokens"]]
        for batch in batches:
            out: list[int] = []
            for part in slices(batch, SLICE):
                group = [
                    [text] if any(s in text for s in special) else pretokens(text)
                    for text in (t or "" for t in part.to_pylist())
                ]
                counts.learn({p for own in group for p in own if len(p) <= LONG})
                out.extend(sum(map(counts.__getitem__, own)) for own in group)
            yield pa.array(out, pa.int64())

    return F.arrow_udf(count, "bigint")


def with_token_counts(
    documents: DataFrame, tokenizer: str, *, text: str = "text", limit: int = 1024
) -> DataFrame:
    """Add ``n_bytes``, ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens).

    ``tokenizer`` is the path of a byte-level tokenizers file. Counts are the library's:
    special strings inside texts are special tokens, none are added. A null text counts
    as empty. Columns of these names are replaced.
    """
    shared = documents.sparkSession.sparkContext.broadcast(whole_tokens(tokenizer))
    return documents.withColumns(
        {
            "n_bytes": F.coalesce(F.octet_length(text), F.lit(0)).cast("long"),
            "n_tokens": _counter(tokenizer, shared)(text),
        }
    ).withColumn("over_limit", F.col("n_tokens") > limit)
