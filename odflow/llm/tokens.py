"""Token ids of public tokenizers, computed once per distinct piece of text."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable
from itertools import filterfalse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from odflow.llm.common import memo

#: Distinct words whose tokens a Python worker remembers, and with the pieces of words; each is emptied when full.
REMEMBERED, REMEMBERED_PIECES = 400_000, 600_000

#: The pattern by which the tokenizer splits words, as its file holds it (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Words of printable ASCII and Latin letters that are composed and have one lower-case form.
LATIN = re.compile(r"[!-~À-ÖØ-öø-įı-ſ]+")
#: The same pattern for such words in lower case, one to a line, and the ends of the lines.
PIECES = re.compile(r"\n|'(?:s|t|re|ve|m|ll|d)|[a-zß-öø-įı-ſ]+|[0-9]|[^\na-z0-9ß-öø-įı-ſ]+")


def load(path: str):
    from tokenizers import Tokenizer

    return memo(f"tokenizer {path}", lambda: Tokenizer.from_file(path))


def _merger(path: str):
    """The tokenizer's merges alone, for pieces that are split and lower-cased already,
    and the bytes of each token.

    None if the tokenizer splits or normalises in another way than ``PATTERN`` and
    lower case of composed characters.
    """
    from tokenizers import Tokenizer, pre_tokenizers

    held = json.loads(load(path).to_str())
    steps = (held["normalizer"] or {}).get("normalizers", [])
    splits = (held["pre_tokenizer"] or {}).get("pretokenizers", [])
    if [s["type"] for s in steps] != ["NFC", "Replace", "Lowercase"]:
        return None
    if [s["type"] for s in splits] != ["Split", "ByteLevel"] or splits[0]["pattern"] != {"Regex": PATTERN}:
        return None
    bare = Tokenizer(load(path).model)
    by_byte = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), by_byte])
    vocab, suffix = held["model"]["vocab"], held["model"]["end_of_word_suffix"] or ""
    lengths = np.zeros(max(vocab.values()) + 1, np.int64)
    lengths[list(vocab.values())] = [len(token.removesuffix(suffix)) for token in vocab]
    return bare, lengths


def word_ids(path: str) -> dict[bytes, bytes]:
    """The remembered words and pieces of this worker: their ids as 4-byte integers."""
    return memo(f"word ids {path}", dict)


def _dealt(ids: list[int], places: list[int] | np.ndarray, ends: np.ndarray) -> list[bytes]:
    """Ids of one text dealt back to its parts: those with places before each end."""
    held = np.array(ids, np.uint32).tobytes()
    cuts = (4 * np.searchsorted(np.array(places, np.int64), np.concatenate(([0], ends)))).tolist()
    return [held[first:last] for first, last in zip(cuts, cuts[1:])]


def _learn_whole(path: str, known: dict[bytes, bytes], words: list[bytes]) -> None:
    """Ids of new words, encoded as one text and dealt back by the place of each token."""
    if not words:
        return
    texts = [w.decode() for w in words]
    found = load(path).encode(" ".join(texts), add_special_tokens=False)
    ends = np.cumsum([len(t) + 1 for t in texts])
    known.update(zip(words, _dealt(found.ids, [start for start, _ in found.offsets], ends)))


def _merged(merger, lengths: np.ndarray, pieces: list[bytes]) -> list[bytes]:
    """Ids of pieces, encoded as one text and dealt back by the bytes of each token."""
    if not pieces:
        return []
    text, ends = b" ".join(pieces).decode(), np.cumsum(list(map(len, pieces)))
    # the library is much faster if it need not say where tokens lie
    ids = merger.encode_batch_fast([text], add_special_tokens=False)[0].ids
    behind = np.cumsum(lengths[ids])
    if np.isin(ends, behind).all() and behind[-1] == ends[-1]:
        return _dealt(ids, behind - lengths[ids], ends)
    found = merger.encode(text, add_special_tokens=False)
    return _dealt(found.ids, found.word_ids, np.arange(1, len(pieces) + 1))


def _learn(path: str, known: dict[bytes, bytes], words: Iterable[bytes]) -> None:
    """Ids of new words. Latin words are split into pieces, which many words share and
    which are words themselves, so that each is merged once; others go through the library whole."""
    merger = memo(f"merger {path}", lambda: _merger(path))
    if merger is None:
        return _learn_whole(path, known, list(words))
    # all words go through each step together, what costs is a step for a word
    pieces, others = set(), []
    for word in words:
        if word.isalpha() and word.islower():
            pieces.add(word)
        else:
            others.append(word)
    several, texts, whole = [], [], []
    for word, text in zip(others, b"\n".join(others).decode().split("\n")):
        if LATIN.fullmatch(text) and "<|" not in text:
            several.append(word)
            texts.append(text)
        else:
            whole.append(word)
    lines = " ".join(PIECES.findall("\n".join(texts).lower())).encode()
    fresh = list(pieces.union(filterfalse(known.__contains__, lines.split())))
    known.update(zip(fresh, _merged(*merger, fresh)))
    for word, line in zip(several, lines.split(b"\n")):
        known[word] = b"".join(map(known.__getitem__, line.split()))
    _learn_whole(path, known, whole)


def _forgotten(known: dict, needed: set, limit: int) -> list:
    """What is needed and not known. If all would be too much, ``known`` keeps what is needed."""
    fresh = needed.difference(known)
    if len(known) + len(fresh) > limit:
        kept = {w: known[w] for w in needed - fresh}
        known.clear()
        known.update(kept)
    return list(fresh)


def ids_by_word(path: str, texts: pa.Array | list[bytes | None]) -> list[bytes]:
    """Token ids of texts, 4 bytes each, by a tokenizer that drops case and white space.

    Such a tokenizer gives a text the ids of its white-space separated words one after
    another, so each distinct word goes through the library once, and through Python once
    for all texts. Words are lower-cased first unless the text may hold a special token.
    """
    known = word_ids(path)
    strings = pc.fill_null(pa.array(texts, pa.binary()), b"").view(pa.string())
    strings = pc.if_else(pc.match_substring(strings, "<|"), strings, pc.ascii_lower(strings))
    split = pc.ascii_split_whitespace(strings)
    words = split.flatten().dictionary_encode()
    distinct = words.dictionary.view(pa.binary()).to_numpy(zero_copy_only=False).tolist()
    fresh = set(filterfalse(known.__contains__, distinct))
    if len(known) + len(fresh) > REMEMBERED_PIECES:
        fresh = set(_forgotten(known, set(distinct), REMEMBERED_PIECES))
    # the split leaves empty strings at the ends of texts
    known[b""] = b""
    _learn(path, known, fresh - {b""})

    own = list(map(known.__getitem__, distinct))
    sizes = np.array(list(map(len, own)), np.int64) // 4
    places, codes = np.cumsum(sizes) - sizes, words.indices.to_numpy()
    n = sizes[codes]
    ends = np.concatenate(([0], np.cumsum(n)))
    at = np.repeat(places[codes] - ends[:-1], n) + np.arange(ends[-1])
    ids = np.frombuffer(b"".join(own), np.uint32)[at].tobytes()
    cuts = 4 * ends[np.concatenate(([0], np.cumsum(pc.list_value_length(split).to_numpy())))]
    return [ids[first:last] for first, last in zip(cuts.tolist(), cuts[1:].tolist())]
