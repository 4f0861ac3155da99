"""The registered queries that SQL can express, for DuckDB."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ITEM_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

SQL: dict[str, str] = {
    "op6_decontaminate": f"""
        WITH d AS (SELECT doc_id, {_ITEM_WORDS} AS w FROM documents),
        b AS (
            SELECT CAST(item_id AS VARCHAR) AS item_id, w, least(13, len(w)) AS n
            FROM (SELECT item_id, {_ITEM_WORDS} AS w FROM benchmark)
        ),
        windows AS (
            SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS win
            FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM b WHERE n > 0)
        ),
        places AS (
            SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
            FROM (
                SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
                FROM d, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n
            )
        ),
        hits AS (SELECT doc_id, i, n, item_id FROM places JOIN windows USING (n, win)),
        words AS (
            SELECT doc_id, count(DISTINCT p) AS n_hit
            FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY 1
        ),
        items AS (
            SELECT doc_id, count(DISTINCT item_id) AS n_items,
                string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids
            FROM hits GROUP BY 1
        )
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
            coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
            coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
    """,
    "op7_line_dedup": r"""
        WITH l AS (
            SELECT doc_id, source, unnest(l) AS line, unnest(range(len(l))) AS pos
            FROM (SELECT doc_id, source, string_split(text, chr(10)) AS l FROM documents)
        ),
        shared AS (
            SELECT line, min({'id': doc_id, 'pos': pos}) AS first FROM l
            WHERE len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) >= 3
            GROUP BY line HAVING count(DISTINCT source) >= 5
        ),
        marked AS (
            SELECT doc_id, pos, l.line,
                first IS NOT NULL AND (first.id <> doc_id OR first.pos <> pos) AS gone
            FROM l LEFT JOIN shared ON l.line = shared.line
        )
        SELECT doc_id, count(*) AS n_lines, CAST(sum(CAST(gone AS INT)) AS BIGINT) AS n_removed,
            sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), ''))
                AS kept_sha256
        FROM marked GROUP BY doc_id
    """,
    "op9_near_duplicates": f"""
        WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format(_LOWER)} AS w FROM documents),
        s AS (
            SELECT DISTINCT doc_id, array_to_string(w[i:i + least(3, len(w)) - 1], ' ') AS g
            FROM (
                SELECT doc_id, w, unnest(range(1, len(w) - least(3, len(w)) + 2)) AS i
                FROM d WHERE len(w) > 0
            )
        ),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
        p AS (
            SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS m
            FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2
        ),
        l AS (
            SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
            WHERE 100 * m >= 85 * (x.n + y.n - m)
        ),
        e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
        r(doc_id, c) AS (
            SELECT doc_id, doc_id FROM d UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id
        )
        SELECT r.doc_id, coalesce(max(n), 0) AS n_shingles, min(c) AS component_id,
            r.doc_id = min(c) AS kept
        FROM r LEFT JOIN n USING (doc_id) GROUP BY r.doc_id
    """,
    "op10_repeated_passages": f"""
        WITH d AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
        windows AS (
            SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS win
            FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)
        ),
        earliest AS (SELECT win, min(doc_id) AS least FROM windows GROUP BY win HAVING count(*) > 1),
        gone AS (
            SELECT DISTINCT doc_id, p
            FROM (
                SELECT doc_id, unnest(range(i, i + 50)) AS p
                FROM windows JOIN earliest USING (win) WHERE least < doc_id
            )
        ),
        words AS (
            SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d
        ),
        kept AS (
            SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept, count(*) AS n
            FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY 1
        )
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
            CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
            sha256(coalesce(kept, '')) AS kept_sha256
        FROM d LEFT JOIN kept USING (doc_id)
    """,
}

# Conversation repair: costs and cheapest edits from the last turn to the first, for the four
# states (nothing written, or the last role: system, user, assistant).


def _way(when: str, cost: str, edit: str, to: int) -> str:
    return f"CASE WHEN {when} THEN {{'c': v{to}.c + {cost}, 's': '{edit}' || v{to}.s}} END"


_KEEPS = {0: (("s", 1), ("u", 2)), 1: (("u", 2),), 2: (("a", 3),), 3: (("u", 2),)}
_NEXT = (2, 2, 3, 2)


def _turn(state: int) -> str:
    ways = [_way("true", "3", "D", state), _way("NOT gone", "2 + t", "R", _NEXT[state])]
    ways += [_way(f"NOT gone AND initial = '{i}'", "t", "K", to) for i, to in _KEEPS[state]]
    return f"least({', '.join(ways)}) AS b{state}"


def _insert(n: int, to: int) -> str:
    return f"{{'c': b{to}.c + {2 * n}, 's': '{'I' * n}' || b{to}.s}}"


SQL["op11_conversation_repair"] = rf"""
    WITH RECURSIVE crc AS (
        SELECT list_transform(range(256), lambda i: list_reduce(range(8),
            lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, i)) AS t
    ),
    original AS (
        SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
            coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name
        FROM conversations
    ),
    fates AS (
        SELECT * EXCLUDE (name), xor(list_reduce(list_transform(range(1, len(name) + 1), lambda i: CAST(ascii(name[i]) AS BIGINT)),
            lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % 20 AS fate
        FROM original, crc
    ),
    turns AS (
        SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
            CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
            unnest(range(CASE fate WHEN 3 THEN 2 ELSE 1 END)) AS copy
        FROM fates WHERE fate <> 0
    ),
    placed AS (
        SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
            NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank,
            row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS seen,
            NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') AS cut_off
        FROM turns
    ),
    marked AS (
        SELECT *, left(role, 1) AS initial, blank OR seen AS gone, CAST(NOT blank AND NOT seen AND cut_off AS INT) AS t,
            lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair
        FROM placed
    ),
    totals AS (
        SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
            count(*) FILTER (blank) AS blank, count(*) FILTER (seen AND NOT blank) AS duplicate, CAST(sum(t) AS BIGINT) AS truncated,
            count(*) FILTER (i > 1 AND pair NOT IN ('su', 'ua', 'au')) AS illegal
        FROM marked GROUP BY conv_id
    ),
    costs AS (
        SELECT conv_id, n AS i, {{'c': 0, 's': ''}} AS v0, {{'c': 4, 's': 'II'}} AS v1, {{'c': 2, 's': 'I'}} AS v2, {{'c': 0, 's': ''}} AS v3 FROM totals
        UNION ALL
        SELECT conv_id, i - 1, least(b0, {_insert(1, 2)}, {_insert(2, 3)}), least(b1, {_insert(1, 2)}, {_insert(2, 3)}),
            least(b2, {_insert(1, 3)}), least(b3, {_insert(1, 2)})
        FROM (
            SELECT c.conv_id, c.i, {', '.join(map(_turn, range(4)))}
            FROM costs c JOIN marked m ON m.conv_id IS NOT DISTINCT FROM c.conv_id AND m.i = c.i
        )
    ),
    plans AS (SELECT conv_id, v0.c AS cost, v0.s AS audit FROM costs WHERE i = 0),
    edits AS (
        SELECT conv_id, k, audit[k] AS edit,
            count(*) FILTER (audit[k] <> 'I') OVER (PARTITION BY conv_id ORDER BY k) AS i,
            count(*) FILTER (audit[k] <> 'D') OVER (PARTITION BY conv_id ORDER BY k) AS m
        FROM (SELECT conv_id, audit, unnest(range(1, len(audit) + 1)) AS k FROM plans)
    ),
    written AS (
        SELECT e.conv_id, k, m, edit, CASE WHEN edit <> 'I' THEN text ELSE '' END AS text, role,
            bool_or(m = 1 AND edit = 'K' AND initial = 's') OVER (PARTITION BY e.conv_id) AS with_system
        FROM edits e LEFT JOIN marked t ON t.conv_id IS NOT DISTINCT FROM e.conv_id AND t.i = e.i
        WHERE edit <> 'D'
    ),
    repaired AS (
        SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (m % 2 = 1) <> with_system THEN 'user' ELSE 'assistant' END
            || ':' || text, chr(10) ORDER BY k) AS said
        FROM written GROUP BY conv_id
    )
    SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
        coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(cost, 0) AS BIGINT) AS cost,
        coalesce(audit, '') AS audit, sha256(coalesce(said, '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) o
    LEFT JOIN totals t ON t.conv_id IS NOT DISTINCT FROM o.conv_id
    LEFT JOIN plans p ON p.conv_id IS NOT DISTINCT FROM o.conv_id
    LEFT JOIN repaired r ON r.conv_id IS NOT DISTINCT FROM o.conv_id
"""
