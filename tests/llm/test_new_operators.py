"""Conversation repair, sharding and alignment against plain loops."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from odflow.llm import alignment, common, conversations, queries, shards

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
SPACE = " \t\n\x0b\x0c\r"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# Conversation repair ---------------------------------------------------------------


def damage(rows):
    for conv, turn, role, text in rows:
        said = [" " if x is None else str(x) for x in (conv, turn)]
        fate = zlib.crc32(":".join(said).encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        if fate == 1:
            text = ""
        elif fate == 2:
            text = "".join(c for c in text if c not in ".!?")
        elif fate == 4:
            role = "user"
        for _ in range({0: 0, 3: 2}.get(fate, 1)):
            yield conv, turn, role, text


def cheapest(turns):
    """(cost, edits, repaired turns) of (role, must go, truncated) by plain search from the end."""
    after = {"": "u", "s": "u", "u": "a", "a": "u"}
    names = {"u": "user", "a": "assistant"}
    ends = {"": (0, ""), "a": (0, ""), "u": (2, "I"), "s": (4, "II")}
    table = [ends]
    for role, gone, cut in reversed(turns):
        behind, own = table[-1], {}
        for state in after:
            ways = [(3 + behind[state][0], "D" + behind[state][1])]
            if not gone:
                initial = role[:1]
                if initial == after[state] or (state == "" and initial == "s"):
                    ways.append((cut + behind[initial][0], "K" + behind[initial][1]))
                to = after[state]
                ways.append((2 + cut + behind[to][0], "R" + behind[to][1]))
            own[state] = min(ways)
        for _ in range(3):
            own = {q: min(x, (2 + own[after[q]][0], "I" + own[after[q]][1])) for q, x in own.items()}
        table.append(own)
    cost, edits = table[-1][""]
    out, i, state = [], 0, ""
    for e in edits:
        if e != "D":
            state = turns[i][0][:1] if e == "K" else after[state]
            out.append((i if e != "I" else None, turns[i][0] if e == "K" else names[state]))
        i += e != "I"
    return cost, edits, out


def repaired(rows, original):
    by_conv = {c: [] for c in original}
    for conv, turn, role, text in rows:
        by_conv[conv].append((turn is not None, turn or 0, role, text))
    found = {}
    for conv, turns in by_conv.items():
        turns.sort()
        counts, seen, marked = Counter(), set(), []
        for _, _, role, text in turns:
            plain = text.strip(SPACE)
            fault = "blank" if not plain else "duplicate" if (role, text) in seen else "truncated" if plain[-1] not in ".!?" else None
            seen.add((role, text))
            counts[fault] += 1
            marked.append((role, fault in ("blank", "duplicate"), fault == "truncated"))
        known = [t for there, t, *_ in turns if there]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        cost, edits, out = cheapest(marked)
        lines = [f"{role}:{'' if i is None else turns[i][3]}" for i, role in out]
        found[conv] = (gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, edits, sha("\n".join(lines)))
    return found


COLUMNS = [*conversations.COLUMNS, "audit", "repaired_sha256"]


def random_turns(rng, n_conv, length):
    roles, texts = ["system", "user", "assistant", "tool", "", "sage"], ["Yes.", "No!", "so it", " \t", "", "Why?\n", "é…", "Yes. \r"]
    for conv in range(n_conv):
        for turn in range(rng.randrange(length)):
            yield conv, turn * rng.choice([1, 1, 2]), rng.choice(roles[:3] if conv % 2 else roles), rng.choice(texts) + str(rng.randrange(3)) * rng.randrange(2)


def frame(spark, rows):
    rows = [(*r, "clash", 1, True) for r in rows]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, conv string, cost int, present boolean").repartition(3)


def test_conversation_repair(spark):
    rng = random.Random(5)
    rows = list(random_turns(rng, 150, 9))
    rows += [(900, t, rng.choice(["user", "assistant"]), f"turn {t}" + rng.choice(["", ".", "?"])) for t in range(2500)]
    rows += [(1000 + i, 0, "user", "Hi.") for i in range(60)]  # some lose their only turn
    rows += [(None, 1, None, None), (None, None, "user", "Hi."), (901, None, "assistant", None), (902, None, "user", "x"), (903, 5, "a", "."), (903, 5, "a", ".")]
    # different turns that share a number would be a tie, which is settled by a hash
    ties = Counter(r[:2] for r in rows)
    rows = [r for r in rows if ties[r[:2]] == 1 or r[0] == 903]
    undamaged = conversations.repair_plans(frame(spark, rows))
    plain = [(c, t, *(" " if x is None else x for x in rest)) for c, t, *rest in rows]
    got = {r[0]: tuple(r[1:]) for r in undamaged.select("conv_id", *COLUMNS).collect()}
    assert got == repaired(plain, {r[0] for r in rows})
    found = conversations.repair_plans(conversations.damaged(frame(spark, rows)), present=F.col("present"))
    got = {r[0]: tuple(r[1:]) for r in found.select("conv_id", *COLUMNS).collect()}
    assert got == repaired(damage(rows), {r[0] for r in rows})
    assert any(g[6] == "" and g[7] == sha("") for g in got.values())


def test_repaired_turns(spark):
    rows = list(random_turns(random.Random(6), 40, 12))
    rows = list({r[:3]: r for r in rows}.values())
    turns = conversations.damaged(frame(spark, rows))
    plans = {r.conv_id: r for r in conversations.repair_plans(turns, present=F.col("present")).collect()}
    said = {}
    for r in sorted(conversations.repaired_turns(turns, present=F.col("present")).collect(), key=lambda r: (r.conv_id, r.place)):
        said.setdefault(r.conv_id, []).append(r)
    for conv, plan in plans.items():
        own = said.get(conv, [])
        assert [r.place for r in own] == list(range(len(own)))
        assert "".join(r.edit for r in own) == plan.audit.replace("D", "")
        assert sha("\n".join(f"{r.role}:{r.text}" for r in own)) == plan.repaired_sha256
        initials = "".join(r.role[0] for r in own).removeprefix("s")
        assert initials == "ua" * (len(initials) // 2)


def test_conversation_repair_without_rows(spark):
    nothing = frame(spark, [(1, 1, "user", "x")]).limit(0)
    assert conversations.repair_plans(conversations.damaged(nothing), present=F.col("present")).count() == 0
    assert conversations.repaired_turns(nothing).count() == 0


@pytest.mark.parametrize("size", [1, 2, 4])
def test_blocks_of_any_size(size):
    blocks, rng = conversations.Blocks(size), random.Random(size)
    roles = ["system", "user", "assistant", "tool"]
    for _ in range(300):
        turns = [(rng.choice(roles), rng.random() < 0.2, rng.random() < 0.3) for _ in range(rng.randrange(14))]
        symbols = [0 if gone else (5 if cut else 1) + roles.index(role) for role, gone, cut in turns]
        turns = [(role, gone, cut and not gone) for role, gone, cut in turns]
        assert blocks.plan(np.array(symbols, np.int64)) == cheapest(turns)[:2]


# Sharding --------------------------------------------------------------------------


def plain_differencing(sizes, bins):
    parts = [([0] * (bins - 1) + [s]) for s in sizes]
    order = list(range(len(parts)))
    while len(parts) > 1:
        ranked = sorted(zip(parts, order), key=lambda x: (x[0][0] - x[0][-1], x[1]))
        (one, _), (two, _), rest = ranked[0], ranked[1], ranked[2:]
        parts = [p for p, _ in rest] + [sorted(x + y for x, y in zip(one, reversed(two)))]
        order = [o for _, o in rest] + [max(order) + 1]
    return parts[0] if parts else [0] * bins


@pytest.mark.parametrize("bins", [1, 2, 3, 8])
def test_differencing(bins):
    rng = random.Random(bins)
    for n in [0, 1, 2, 7, 8, 60, 200]:
        sizes = [rng.choice([1, 5, 5, rng.randrange(1, 10_000)]) for _ in range(n)]
        held = shards.differenced(np.array(sizes, np.int64), bins)
        loads = np.bincount(held, sizes, bins).astype(int) if n else [0] * bins
        assert sorted(loads) == plain_differencing(sizes, bins)
    assert sorted(np.bincount(shards.differenced(np.array([8, 7, 6, 5, 4]), 2), [8, 7, 6, 5, 4])) == [14, 16]


def check_shards(rows, corpus, n):
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter(
        (d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in corpus
    )
    by_text, of_doc = {}, {}
    for d, t in corpus:
        of_doc.setdefault((d, zlib.crc32((t or "").encode())), t or "")
    loads = [0] * n
    for r in rows:
        by_text.setdefault(of_doc[r.doc_id, r.text_crc32], set()).add(r.shard)
        loads[r.shard] += r.size
    assert all(len(s) == 1 for s in by_text.values())
    for s in range(n):
        own = sorted(r.slot for r in rows if r.shard == s)
        assert own == list(range(len(own)))
    return loads


def test_sharding(spark, documents, corpus, empty):
    loads = check_shards(shards.shard_documents(documents, 8).collect(), corpus, 8)
    sizes = Counter()
    for _, t in corpus:
        sizes[t or ""] += len((t or "").encode()) + 1
    assert sorted(loads) == plain_differencing(sorted(sizes.values(), reverse=True), 8)
    assert shards.shard_documents(empty, 8).count() == 0


def test_sharding_in_rounds_with_hot_groups(spark):
    rng = random.Random(9)
    corpus = [(i % 2900 if i % 5 else None, "x" * rng.randrange(200) + str(i % 1900)) for i in range(3000)]
    corpus += [(i, "the same short text") for i in range(1500)] + [(7, None), (7, ""), (7, "y" * 9000)]
    df = spark.createDataFrame(corpus, "doc_id long, text string").repartition(5)
    for chunk, final in ((16, 40), (64, 64), (4096, 8192)):
        rows = shards.shard_documents(df, 4, chunk=chunk, final=final).collect()
        loads = check_shards(rows, corpus, 4)
        assert max(loads) - min(loads) <= 16


def test_written_shards(spark, documents, corpus, tmp_path):
    shards.write_shards(documents, str(tmp_path / "out"), 3)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert {*back.columns} == {*documents.columns, "shard"}
    assert Counter((r.doc_id, r.text) for r in back.collect()) == Counter(corpus)
    assert back.groupBy(F.coalesce("text", F.lit(""))).agg(F.count_distinct("shard").alias("n")).filter("n > 1").count() == 0


# Alignment --------------------------------------------------------------------------


def aligned(corpus):
    """The digest of every document by walking both tokenisations side by side."""
    both = alignment.Tokenizers(BYTE_BPE, PIECES)
    own, counts = [], Counter()
    for doc, text in corpus:
        if not text:
            own.append((doc, None))
            continue
        said = " " + text
        a = both.a.encode(said, add_special_tokens=False).ids
        b = both.b.encode(text)
        a_bytes, b_bytes = [both.a_bytes[i] for i in a], [both.b_bytes[i] for i in b]
        if b"".join(a_bytes) != said.encode() or b"".join(b_bytes) != said.encode():
            own.append((doc, None))
            continue
        spans = [np.cumsum([0, *map(len, x)]).tolist() for x in (a_bytes, b_bytes)]
        links, groups, i, j, start = [], [], 0, 0, (0, 0)
        while i < len(a) and j < len(b):
            links.append((i, j))
            ends = spans[0][i + 1], spans[1][j + 1]
            i, j = i + (ends[0] <= ends[1]), j + (ends[1] <= ends[0])
            if ends[0] == ends[1]:
                groups.append((range(start[0], i), range(start[1], j)))
                start = i, j
        counts.update((a[i], b[j]) for i, j in links)
        text = ";".join("|".join(",".join(str(ids[k]) for k in g) for ids, g in zip((a, b), group)) for group in groups)
        own.append((doc, (a, b, groups, links, text)))
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    out = []
    for doc, found in own:
        if found is None:
            out.append((doc, 0, 0, 0, 0, 0, 0, 0, ""))
            continue
        a, b, groups, links, text = found
        pairs = [(a[i], b[j]) for i, j in links]
        out.append(
            (
                doc, len(a), len(b), len(groups), len(links), sum(len(x) * len(y) for x, y in groups),
                sum(counts[p] == best[p[1]] for p in pairs), sum(counts[p] for p in pairs), sha(text),
            )
        )
    return Counter(out)


AWKWARD = [
    "\n\nlines\n and  spaces \n\n  more\t\ttabs \r\n end  ",
    "special <|endoftext|> </s> <s> <unk> ▁ under ▁▁ bars",
    "nul \x00 and \x1c\x85\xa0 ​ odd　blanks ﻿",
    " ",
    "\n",
    "中文字 日本語 ไทย 😀😀👩‍👩‍👧 ḍ̇ é ﬁ Ⅳ ½",
    "it's I'LL  we've ''s 'S x's\n's 12345 1,000.00 ---- ....",
    "a" * 3000 + " " + "ab" * 2000,
    "one  two   three    four" * 50,
]


def same(df, corpus):
    columns = ["doc_id", *alignment.SIZES, "n_best", "count_sum", "groups_sha256"]
    assert df.columns == columns
    assert Counter(map(tuple, df.collect())) == aligned(corpus)


def test_alignment(spark, corpus, documents, empty):
    more = [(i, t) for i, t in enumerate(AWKWARD * 2)]
    rows = [(i, t, "en", "s", 0, "clash", 1) for i, t in more]
    df = documents.unionByName(spark.createDataFrame(rows, documents.schema))
    same(alignment.aligned_documents(df, BYTE_BPE, PIECES), corpus + more)
    # few pairs broadcast, few parts remembered: the same rows
    same(alignment.aligned_documents(df, BYTE_BPE, PIECES, broadcast_pairs=50, remembered=40), corpus + more)
    assert alignment.aligned_documents(empty, BYTE_BPE, PIECES).count() == 0


def test_alignment_of_the_query(spark):
    sf = "/root/testdata/sf0.001"
    texts = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    same(queries.op13_alignment(spark, sf), texts)


def test_links(spark, documents, corpus):
    both = alignment.Tokenizers(BYTE_BPE, PIECES)
    for r in alignment.with_links(documents, BYTE_BPE, PIECES).select("text", "alignment").collect():
        a = [both.a_bytes[i] for i in r.alignment.a_ids]
        b = [both.b_bytes[i] for i in r.alignment.b_ids]
        if not r.text:
            assert not a and not b and not r.alignment.overlaps
            continue
        shared = sum(link["bytes"] for link in r.alignment.overlaps)
        assert shared == len((" " + r.text).encode()) == len(b"".join(a))
        ends = [(x.a_end, x.b_end) for x in r.alignment.groups]
        assert ends[-1] == (len(a), len(b))


def test_products():
    rng = np.random.default_rng(1)
    for _ in range(40):
        n = rng.integers(1, 60)
        cuts = [np.unique(np.append(rng.integers(1, n + 1, 12), n)) for _ in "ab"]
        a, b = (np.diff(c, prepend=0) for c in cuts)
        dense = [np.repeat(np.eye(len(x), dtype=int), x, 1) for x in (a, b)]
        want = dense[0] @ dense[1].T
        i, j, values = alignment.overlap_links(a, b)
        got = np.zeros_like(want)
        got[i, j] = values
        assert (got == want).all() and len(i) == (want > 0).sum()
        ga, gb = alignment.groups_of(a, b)
        of = [np.repeat(np.arange(len(g.indptr) - 1), np.diff(g.indptr)) for g in (ga, gb)]
        i, j = alignment.group_links(ga, gb)
        assert {*zip(i.tolist(), j.tolist())} == {(x, y) for x in range(len(a)) for y in range(len(b)) if of[0][x] == of[1][y]}


def test_components_after_further_links(spark):
    rng = random.Random(11)
    for n in (0, 1, 60):
        first = [(rng.randrange(100), rng.randrange(100)) for _ in range(n)]
        late = [(rng.randrange(160), rng.randrange(160)) for _ in range(n // 2)]
        frames = [spark.createDataFrame(x, "a long, b long") for x in (first, late)]
        reached = common.connected_components(frames[0])
        got = {r.id: r.component for r in common.joined_components(reached, frames[1]).collect()}
        want = {r.id: r.component for r in common.connected_components(frames[0].unionByName(frames[1])).collect()}
        assert {i: c for i, c in got.items() if i != c} == {i: c for i, c in want.items() if i != c}


def test_a_worker_keeps_what_was_used_last():
    made = []
    for name in ("m1", "m2", "m3", "m4", "m1", "m5", "m1", "m2"):
        common.memo(name, lambda name=name: made.append(name))
    assert made == ["m1", "m2", "m3", "m4", "m5", "m2"]
