"""Personal data: fixed rules, and identifiers learned from their contexts.

Spans of the rules are seeds. Every token with a digit or an at sign, and so every token
of a seed, is an instance; other tokens are not. The words before
and behind it, alone and with its shape, are patterns. In the graph of patterns and
instances a pattern's confidence for a kind is the mean score of its distinct instances,
an instance's score the chance that one of its patterns is right; seeds stay at 1. After
some rounds, tokens outside all seeds that stand in a confident pattern with enough
support are identifiers of that kind too. All of it are DataFrame operations.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from odflow.llm.common import cut

KINDS = ("email", "ip", "card", "phone")
ROUNDS = 3
#: A pattern needs so many distinct seeds, and such confidence to extract and to vote.
MIN_SEEDS, MIN_CONFIDENCE, VOTES = 5, 0.9, 0.5

# A run that fails from its first character fails from all, so that matches begin where a
# run begins, or where the match before ended, and repetitions need no way back.
_LOCAL = "A-Za-z0-9._%+-"
RULES = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?:\G|(?<![0-9]))[0-9](?:[\x20-]?[0-9]){11,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a rule to be tried.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
#: Only emails need no digit.
TOKEN = r"(?<![^\s])[^\s0-9@]*+[0-9@][^\s]*+"
SPACE = r"[\s]+"

#: Matches whose places are added up at a time.
BLOCK = 256

SPAN = "struct<start: int, ord: int, kind: string, end: int>"


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def _sums(numbers: Column) -> Column:
    """Running sums of few numbers, behind a leading 0; copies them at every step."""
    return F.aggregate(
        numbers, F.array(F.lit(0)), lambda out, n: F.concat(out, F.array(F.element_at(out, -1) + n))
    )


def running_sums(numbers: Column, block: int = BLOCK) -> Column:
    """Sum of every number (int) and those before it.

    Blocks are summed on their own and moved by the sums of the blocks before, so that
    the copies of a step are as short as a block or the list of blocks.
    """

    def blocks(own: Column) -> Column:
        firsts = F.sequence(F.lit(0), F.floor(F.size(own) / block).cast("int"))
        return F.transform(firsts, lambda k: _sums(F.slice(own, k * block + 1, F.lit(block))))

    def moved(sums: Column) -> Column:
        starts = _sums(F.transform(sums, lambda own: F.element_at(own, -1)))
        parts = F.arrays_zip(sums.alias("own"), F.slice(starts, F.lit(1), F.size(sums)).alias("at"))
        return F.flatten(
            F.transform(parts, lambda p: F.transform(F.slice(p["own"], 2, block), lambda n: n + p["at"]))
        )

    return _bound(numbers, lambda own: _bound(blocks(own), moved))


def _places(text: Column, rule: str, around: bool = False) -> Column:
    """Matches with their place in code points, and the text before and behind each.

    The text is split at the matches; the lengths of gaps and matches add up to places.
    With ``around`` the texts before and behind reach over two matches and one.
    """

    def zipped(gaps: Column, found: Column) -> Column:
        n = F.size(found)
        lengths = F.zip_with(F.slice(gaps, F.lit(1), n), found, lambda gap, own: F.length(gap) + F.length(own))
        columns = [
            F.slice(gaps, F.lit(1), n).alias("gap"),
            found.alias("match"),
            F.slice(gaps, F.lit(2), n).alias("behind"),
            running_sums(lengths).alias("end"),
        ]
        if around:
            none = F.array(F.lit(""))
            columns += [
                F.slice(F.concat(none, none, found), F.lit(1), n).alias("second"),
                F.slice(F.concat(none, gaps), F.lit(1), n).alias("between"),
                F.slice(F.concat(none, found), F.lit(1), n).alias("first"),
                F.slice(F.concat(found, none), F.lit(2), n).alias("next"),
            ]
        return F.arrays_zip(*columns)

    def place(part: Column) -> Column:
        gap = F.concat(part["second"], part["between"], part["first"], part["gap"]) if around else part["gap"]
        behind = F.concat(part["behind"], part["next"]) if around else part["behind"]
        return F.struct(
            (part["end"] - F.length(part["match"])).alias("start"),
            part["end"].alias("end"),
            part["match"].alias("match"),
            gap.alias("gap"),
            behind.alias("behind"),
        )

    gaps, found = F.split(text, rule, -1), F.regexp_extract_all(text, F.lit(rule), F.lit(0))
    parts = _bound(gaps, lambda g: _bound(found, lambda m: zipped(g, m)))
    return F.transform(parts, place)


def _luhn(digits: Column) -> Column:
    places = F.sequence(F.lit(1), F.length(digits))

    def part(i: Column) -> Column:
        d = F.substring(F.reverse(digits), i, F.lit(1)).cast("int")
        twice = d * 2
        return F.when(i % 2 == 1, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.transform(places, part), F.lit(0), lambda a, b: a + b) % 10 == 0


def _is_kind(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        # at most three digits after leading zeros, so that every part is a small number
        return F.forall(
            F.split(match, r"\."),
            lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(p.try_cast("int"), F.lit(0)) <= 255),
        )
    if kind == "card":
        return F.length(digits).between(12, 19) & _luhn(digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """Spans of the fixed rules, by start and then by kind."""
    none = F.expr(f"cast(array() as array<{SPAN}>)")

    def of(order: int, kind: str, rule: str) -> Column:
        hint = F.contains(text, F.lit("@")) if kind == "email" else text.rlike(HINTS[kind])
        good = F.filter(_places(text, rule), lambda m: _is_kind(kind, m["match"]))
        spans = F.transform(
            good,
            lambda m: F.struct(
                m["start"].alias("start"),
                F.lit(order).alias("ord"),
                F.lit(kind).alias("kind"),
                m["end"].alias("end"),
            ),
        )
        return F.when(hint, spans).otherwise(none)

    kinds = [of(order, kind, rule) for order, (kind, rule) in enumerate(RULES.items())]
    return F.array_sort(F.concat(*kinds))


def as_text(spans: Column) -> Column:
    """``kind:start:end`` of every span, joined by commas."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))),
        ",",
    )


def _instances(found: DataFrame) -> DataFrame:
    """One row for each token with a digit or an at sign: its place, the kind of a seed over it, its patterns."""
    rows = found.filter("size(tokens) > 0").select("row", "base", F.explode("tokens").alias("t"))
    over = F.filter("base", lambda s: (s["start"] < F.col("t.end")) & (s["end"] > F.col("t.start")))
    word = lambda text, rule: F.lower(F.regexp_extract(text, rule, 1))
    token = F.lower("t.match")
    shape = F.regexp_replace(F.regexp_replace(token, "[0-9]+", "9"), r"\p{L}+", "a")
    before = F.regexp_extract("t.gap", r"([^\s]{1,40})\s*$", 1)
    two_before = F.regexp_extract("t.gap", r"([^\s]{1,40}\s+[^\s]{1,40})\s*$", 1)
    behind = F.regexp_extract("t.behind", r"^\s*([^\s]{1,40})", 1)
    named = [
        F.when(F.length(value) > 0, F.concat(F.lit(name), F.lower(F.regexp_replace(value, SPACE, " ")), extra))
        for name, value, extra in (
            ("<", before, F.lit("")),
            ("<<", two_before, F.lit("")),
            (">", behind, F.lit("")),
            ("<9 ", before, F.concat(F.lit(" "), shape)),
            (">9 ", behind, F.concat(F.lit(" "), shape)),
        )
    ]
    return rows.select(
        "row",
        F.col("t.start").alias("start"),
        F.col("t.end").alias("end"),
        F.element_at(F.concat(over["kind"], F.array(F.lit(None).cast("string"))), 1).alias("kind"),
        F.xxhash64(token).alias("instance"),
        F.array_compact(F.array(*named)).alias("patterns"),
    )


def learned_patterns(
    instances: DataFrame,
    rounds: int = ROUNDS,
    min_seeds: int = MIN_SEEDS,
    min_confidence: float = MIN_CONFIDENCE,
) -> DataFrame:
    """``(pattern, kind, confidence)`` of the patterns that may extract."""
    edges = instances.select("instance", F.explode("patterns").alias("pattern")).distinct()
    seeds = instances.filter("kind is not null").select("instance", "kind").distinct()
    # only patterns with enough seeds can ever extract
    support = (
        edges.join(seeds, "instance").groupBy("pattern", "kind").agg(F.count("*").alias("seeds"))
        .filter(F.col("seeds") >= min_seeds)
    )
    sizes = edges.groupBy("pattern").agg(F.count("*").alias("size"))
    # checkpoints end the lineage: every round reads these two tables again
    graph = cut(edges.join(support.select("pattern").distinct(), "pattern"))
    known = cut(support.join(sizes, "pattern"))
    scores = seeds.withColumn("score", F.lit(1.0))
    patterns = None
    for round in range(rounds):
        sums = graph.join(scores, "instance").groupBy("pattern", "kind").agg(F.sum("score").alias("total"))
        patterns = known.join(sums, ["pattern", "kind"]).select(
            "pattern", "kind", F.least(F.col("total") / F.col("size"), F.lit(1.0)).alias("confidence")
        )
        patterns = cut(patterns)
        if round + 1 < rounds:
            votes = patterns.filter(F.col("confidence") >= VOTES)
            wrong = F.greatest(1 - F.col("confidence"), F.lit(1e-9))
            learned = (
                graph.join(votes, "pattern").groupBy("instance", "kind")
                .agg((1 - F.exp(F.sum(F.log(wrong)))).alias("score"))
            )
            scores = (
                learned.unionByName(seeds.withColumn("score", F.lit(1.0)))
                .groupBy("instance", "kind").agg(F.max("score").alias("score"))
            )
    return patterns.filter(F.col("confidence") >= min_confidence)


def personal_data(
    documents: DataFrame, *, id: str = "doc_id", text: str = "text", **options
) -> DataFrame:
    """``(doc_id, base, spans)`` of every document: arrays of (start, ord, kind, end).

    ``base`` holds the spans of the fixed rules, ``spans`` also the learned ones; both
    by start, kind as listed, end. Places are code points, the end is exclusive. A null
    text counts as empty. Each row stands for itself, also where ids repeat or are
    null. Other columns are ignored. A token in several confident patterns has the kind
    of the most confident one, the first kind as listed on ties.
    """
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    tokens = F.transform(
        _places(F.col("text"), TOKEN, around=True),
        lambda m: F.struct(
            m["start"].alias("start"),
            m["end"].alias("end"),
            m["match"].alias("match"),
            F.right(m["gap"], F.lit(90)).alias("gap"),
            F.left(m["behind"], F.lit(50)).alias("behind"),
        ),
    )
    none = F.expr(
        "cast(array() as array<struct<start: int, end: int, match: string, gap: string, behind: string>>)"
    )
    found = cut(
        documents.select(F.col(id).alias("doc_id"), whole.alias("text")).select(
            F.monotonically_increasing_id().alias("row"),
            "doc_id",
            base_spans(F.col("text")).alias("base"),
            F.when(F.col("text").rlike("[0-9@]"), tokens).otherwise(none).alias("tokens"),
        )
    )
    instances = cut(_instances(found))
    confident = learned_patterns(instances, **options)
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int") - 1
    extra = (
        instances.filter("kind is null")
        .select("row", "start", "end", F.explode("patterns").alias("pattern"))
        .join(confident, "pattern")
        .groupBy("row", "start", "end")
        .agg(F.max(F.struct("confidence", (-order).alias("order"), "kind")).alias("best"))
        .groupBy("row")
        .agg(
            F.collect_list(
                F.struct("start", (-F.col("best.order")).alias("ord"), F.col("best.kind").alias("kind"), "end")
            ).alias("extra")
        )
    )
    spans = F.array_sort(F.concat("base", F.coalesce("extra", F.array().cast(f"array<{SPAN}>"))))
    return found.select("row", "doc_id", "base").join(extra, "row", "left").select(
        "doc_id", "base", spans.alias("spans")
    )
