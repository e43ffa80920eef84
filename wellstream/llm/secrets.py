"""Secret scans with a trigram inverted index, in SQL functions only.

From each rule's regex follows a Boolean query over trigrams that every match contains (case aside). The index maps each
trigram that some query mentions to the texts with it. A rule's postings are intersected and united by its query, and
only texts that pass are searched with the regex. A rule without mandatory trigrams searches all texts.

Matches are leftmost and do not overlap, per rule; those whose value is shorter than the rule asks for are dropped.
Positions are code points, end exclusive. Null text is empty and has no matches. Texts are indexed by a 128-bit hash, so
copies have one entry and doc_id plays no part: it may be null or repeated. Extra columns are left alone.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from re import _constants as kinds
from re import _parser as parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wellstream.llm.common import packed, unpacked, written


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int
    least: int


RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16),
)
#: Candidates whose keys may be broadcast (16 bytes each); with more, texts and keys are shuffled.
BROADCAST_KEYS = 1_000_000
EXPAND = 64
BLOCK = 256

ALL = ("all",)


def trigram_query(pattern: str) -> tuple:
    """ALL, ("has", trigram), ("and", *queries) or ("or", *queries): true of the folded form of any text with a match."""
    exact, query = _sequence(parser.parse(pattern))
    return _and(query, _trigrams(exact) if exact is not None else ALL)


def _and(*queries: tuple) -> tuple:
    parts = list(dict.fromkeys(p for q in queries if q != ALL for p in (q[1:] if q[0] == "and" else (q,))))
    return ALL if not parts else parts[0] if len(parts) == 1 else ("and", *parts)


def _or(*queries: tuple) -> tuple:
    if ALL in queries:
        return ALL
    parts = list(dict.fromkeys(p for q in queries for p in (q[1:] if q[0] == "or" else (q,))))
    needs = {p: {*p[1:]} if p[0] == "and" else {p} for p in parts}
    parts = [p for p in parts if not any(needs[other] < needs[p] for other in parts)]  # what asks for more adds nothing
    return parts[0] if len(parts) == 1 else ("or", *parts)


def _trigrams(texts: set[str]) -> tuple:
    if min(map(len, texts)) < 3:
        return ALL
    return _or(*(_and(*(("has", t[i : i + 3]) for i in range(len(t) - 2))) for t in sorted(texts)))


def _sequence(nodes) -> tuple[set[str] | None, tuple]:
    """The texts that may match, if few; and a query."""
    run, whole, query = {""}, True, ALL
    for op, arg in nodes:
        exact, own = _node(op, arg)
        query = _and(query, own)
        if exact is not None and len(run) * len(exact) <= EXPAND:
            run = {a + b for a in run for b in exact}
        else:
            query, whole = _and(query, _trigrams(run)), False
            run = exact if exact is not None else {""}
    return (run, query) if whole else (None, _and(query, _trigrams(run)))


def _node(op, arg) -> tuple[set[str] | None, tuple]:
    if op is kinds.LITERAL:
        return {chr(arg).lower() if arg < 128 else chr(arg)}, ALL
    if op is kinds.IN:
        chars: set[str] = set()
        for kind, value in arg:
            if kind is kinds.LITERAL:
                chars.add(chr(value).lower() if value < 128 else chr(value))
            elif kind is kinds.RANGE and value[1] - value[0] < EXPAND:
                chars |= {chr(c).lower() if c < 128 else chr(c) for c in range(value[0], value[1] + 1)}
            else:
                return None, ALL
        return (chars, ALL) if len(chars) <= 8 else (None, ALL)
    if op is kinds.SUBPATTERN:
        return _sequence(arg[3])
    if op is kinds.BRANCH:
        parts = [_sequence(x) for x in arg[1]]
        if all(e is not None for e, _ in parts) and sum(len(e) for e, _ in parts) <= EXPAND:
            return set().union(*(e for e, _ in parts)), _or(*(q for _, q in parts))
        return None, _or(*(_and(q, _trigrams(e) if e is not None else ALL) for e, q in parts))
    if op in (kinds.MAX_REPEAT, kinds.MIN_REPEAT):
        least, most, inner = arg
        exact, query = _sequence(inner)
        if (least, most) == (1, 1):
            return exact, query
        if least == 0:
            return (exact | {""}, ALL) if most == 1 and exact is not None else (None, ALL)
        return None, _and(query, _trigrams(exact) if exact is not None else ALL)
    if op is kinds.AT:
        return {""}, ALL
    return None, ALL


def mentioned(query: tuple) -> set[str]:
    return {query[1]} if query[0] == "has" else set().union(*map(mentioned, query[1:])) if query != ALL else set()


def _key(text: str) -> list[Column]:
    return [F.xxhash64(text).alias("key_a"), F.xxhash64(F.lit(1), F.col(text)).alias("key_b")]


def build_index(documents: DataFrame, trigrams: set[str], text: str = "text") -> DataFrame:
    """Postings (trigram, key_a, key_b) of the trigrams over folded texts."""
    folded = documents.select(F.col(text).alias("text")).where("text is not null").select(*_key("text"), F.lower("text").alias("folded"))
    present = F.array_compact(F.array(*[F.when(F.contains("folded", F.lit(t)), F.lit(t)) for t in sorted(trigrams)]))
    return folded.select("key_a", "key_b", F.explode(present).alias("trigram")).select("trigram", "key_a", "key_b")


def candidates(index: DataFrame, query: tuple) -> DataFrame:
    """(key_a, key_b) of texts whose postings satisfy the query; each posting list is combined before the shuffle."""
    names = sorted(mentioned(query))
    lists = index.where(F.col("trigram").isin(names)).groupBy("key_a", "key_b")
    found = lists.agg(*[F.bool_or(F.col("trigram") == t).alias(f"has {t}") for t in names])

    def holds(q: tuple) -> Column:
        if q[0] == "has":
            return F.col(f"has {q[1]}")
        out = holds(q[1])
        for part in q[2:]:
            out = out & holds(part) if q[0] == "and" else out | holds(part)
        return out

    return found.where(holds(query)).select("key_a", "key_b")


def _let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.transform(F.array(value), body)[0]


def running_sums(values: Column) -> Column:
    """Sum of the values before each, in blocks, so that long arrays don't take quadratic time."""
    total = lambda x: F.aggregate(x, F.lit(0), lambda a, v: a + v)

    def from_blocks(box: Column) -> Column:
        own = box["v"]
        offsets = F.transform(box["s"], lambda _, b: total(F.slice(box["s"], F.lit(1), b)))
        return _let(
            F.struct(own.alias("v"), offsets.alias("o")),
            lambda w: F.transform(w["v"], lambda _, i: w["o"][F.floor(i / BLOCK).cast("int")] + total(F.slice(w["v"], (F.floor(i / BLOCK) * BLOCK + 1).cast("int"), i % BLOCK))),
        )

    def with_blocks(v: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.greatest(F.size(v) - 1, F.lit(0)), F.lit(BLOCK))
        return _let(F.struct(v.alias("v"), F.transform(blocks, lambda b: total(F.slice(v, b + 1, F.lit(BLOCK)))).alias("s")), from_blocks)

    return _let(values, with_blocks)


def matches(text: Column, rule: Rule, number: int) -> Column:
    """Spans (start, kind as a number, end) of a rule's matches whose value is long enough."""

    def placed(box: Column) -> Column:
        steps = F.transform(box["all"], lambda m, i: F.char_length(box["gaps"][i]) + F.char_length(m))

        def spans(sums: Column) -> Column:
            found = F.transform(
                box["all"],
                lambda m, i: F.struct(
                    (sums[i] + F.char_length(box["gaps"][i])).alias("start"),
                    F.lit(number).alias("kind"),
                    (sums[i] + F.char_length(box["gaps"][i]) + F.char_length(m)).alias("end"),
                    F.char_length(box["values"][i]).alias("length"),
                ),
            )
            kept = F.filter(found, lambda s: s["length"] >= rule.least)
            return F.transform(kept, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))

        return _let(running_sums(steps), spans)

    found = F.struct(
        F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)).alias("all"),
        F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)).alias("values"),
        F.split(text, rule.pattern, -1).alias("gaps"),
    )
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    return F.when(text.rlike(rule.pattern), _let(found, placed)).otherwise(none)


def scan(documents: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """documents with secret_spans: all matches of all rules by start, then rule. An input column of that name is replaced; others may have any name."""
    for rule in rules:
        re.compile(rule.pattern)
    kept, text = packed(documents), f"row.`{text}`"
    keyed = kept.withColumn("__text", F.coalesce(F.col(text), F.lit("")))
    queries = {i: trigram_query(rule.pattern) for i, rule in enumerate(rules)}
    indexed = {i: q for i, q in queries.items() if q != ALL}
    if indexed:
        index = written(build_index(kept, set().union(*map(mentioned, indexed.values())), text))
        found = None
        for i, query in indexed.items():
            own = candidates(index, query).withColumn("rule", F.lit(1 << i))
            found = own if found is None else found.unionByName(own)
        found = written(found.groupBy(F.col("key_a").alias("__a"), F.col("key_b").alias("__b")).agg(F.bit_or("rule").alias("__rules")))
        if found.count() <= BROADCAST_KEYS:
            found = F.broadcast(found)
        a, b = _key(text)
        keyed = keyed.withColumns({"__key_a": a, "__key_b": b}).join(found, (F.col("__key_a") == F.col("__a")) & (F.col("__key_b") == F.col("__b")), "left")
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    parts = []
    for i, rule in enumerate(rules):
        spans = matches(F.col("__text"), rule, i)
        parts.append(F.when(F.coalesce(F.col("__rules"), F.lit(0)).bitwiseAND(1 << i) != 0, spans).otherwise(none) if i in indexed else spans)
    return unpacked(keyed.withColumn("secret_spans", F.array_sort(F.concat(*parts))), "secret_spans")


def _number_of(kind: int) -> Column:
    return F.size(F.filter("secret_spans", lambda s: s["kind"] == kind)).cast("long")


def summary(documents: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every document."""
    found = scan(documents.select("doc_id", "text"), RULES)
    names = F.array(*[F.lit(r.kind) for r in RULES])
    listed = F.array_join(F.transform("secret_spans", lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"])), ",")
    found = found.select("doc_id", "secret_spans", listed.alias("spans"))
    counts = [_number_of(i).alias(f"n_{r.kind}") for i, r in enumerate(RULES)]
    return found.select("doc_id", *counts, F.sha2(F.col("spans").cast("binary"), 256).alias("base_sha256"), "spans")
