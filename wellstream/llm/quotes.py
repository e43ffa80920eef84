"""Quotation linking: what a message quotes is linked to the message that said it first, and taken out of the text.

A line that begins with one or more `>` (blanks between them don't matter) is a quote of that level; consecutive lines
of one level are a passage. A line that announces a quote (`... wrote:` just before it) goes with it. Passages and lines
are hashed in normal form: lower case, words only, one blank between. Every line of a message's own text and the text as
a whole is hashed too; the earliest message of a conversation with that hash is the original. The shallowest level that
quotes earlier messages names the parent: the one with most quoted lines of that level, then the latest. Own text in parent order makes the reply order.

No group of equal lines is expanded into pairs: originals are a minimum, combined before the shuffle.

Null text has a null body and links to nothing. Messages are known by (conv_id, turn); where either is null, nothing is
linked. Rows that share both are one place in the order and keep their own texts. Extra columns are left alone.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wellstream.llm.common import cut, map_batches, written

QUOTE = re.compile(r"[ \t]*>(?:[ \t]*>)*[ \t]?")
ANNOUNCES = re.compile(r"(wrote|writes|said|a écrit|schrieb|escribió)\s*:\s*$", re.IGNORECASE)
WORDS = re.compile(r"\w+")
PAGE = 256


def split_quotes(text: str) -> tuple[str, list[tuple[int, str]]]:
    """Text without quotes, and (level, passage) of each quoted passage in order."""
    own: list[str] = []
    passages: list[tuple[int, list[str]]] = []
    open_ = False
    for line in text.split("\n"):
        found = QUOTE.match(line)
        if not found:
            own.append(line)
            open_ = False
            continue
        level, rest = found[0].count(">"), line[found.end() :].rstrip("\r")
        if not open_ and own and ANNOUNCES.search(own[-1].strip()):
            own.pop()
        if open_ and passages[-1][0] == level:
            passages[-1][1].append(rest)
        else:
            passages.append((level, [rest]))
        open_ = True
    body = "\n".join(own)
    if passages:
        body = re.sub(r"\n{3,}", "\n\n", body).strip("\n")
    return body, [(level, "\n".join(lines)) for level, lines in passages]


def normal(text: str) -> str:
    return " ".join(WORDS.findall(text.lower()))


def hashes_of(text: str) -> list[str]:
    """128-bit hashes of the whole text and of its lines, in normal form."""
    forms = {form for form in [normal(text)] if form}
    if "\n" in text:
        forms |= {form for form in map(normal, text.split("\n")) if form}
    return sorted(hashlib.blake2b(form.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest() for form in forms)


def parsed(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, body, n_quotes, quote_depth, quoted (hashes of passages, each with its shallowest level), spoken (hashes of the body)."""

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        bodies, counts, depths, quoted, spoken = [], [], [], [], []
        for text in part.column(3).to_pylist():
            body, passages = split_quotes(text) if text is not None else (None, [])
            bodies.append(body)
            counts.append(len(passages))
            depths.append(max((level for level, _ in passages), default=0))
            least: dict[str, int] = {}
            for level, passage in passages:
                for h in hashes_of(passage):
                    least[h] = min(level, least.get(h, level))
            quoted.append([{"hash": h, "level": level} for h, level in sorted(least.items())])
            spoken.append(hashes_of(body) if body else [])
        strings = pa.list_(pa.string())
        new = [pa.array(bodies, pa.string()), pa.array(counts, pa.int64()), pa.array(depths, pa.int32()), pa.array(quoted, pa.list_(pa.struct([("hash", pa.string()), ("level", pa.int32())]))), pa.array(spoken, strings)]
        return pa.RecordBatch.from_arrays([*part.columns[:3], *new], ["conv_id", "turn", "role", "body", "n_quotes", "quote_depth", "quoted", "spoken"])

    rows = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    return map_batches(rows, run, "conv_id long, turn long, role string, body string, n_quotes long, quote_depth int, quoted array<struct<hash: string, level: int>>, spoken array<string>")


def parents(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, parent_turn, n_linked) of messages whose quotes were found."""
    known = rows.where("conv_id is not null and turn is not null")
    quotes = written(known.where("size(quoted) > 0").select("conv_id", "turn", F.explode("quoted").alias("quote")).select("conv_id", "turn", "quote.hash", "quote.level"))
    wanted = quotes.select("conv_id").distinct()
    said = known.join(wanted, "conv_id", "left_semi").select("conv_id", "turn", F.explode("spoken").alias("hash"))
    first = said.groupBy("conv_id", "hash").agg(F.min("turn").alias("parent_turn"))
    links = quotes.join(first, ["conv_id", "hash"]).where("parent_turn < turn")
    counted = links.groupBy("conv_id", "turn", "level", "parent_turn").agg(F.count("*").alias("n_linked"))
    best = counted.groupBy("conv_id", "turn").agg(F.max(F.struct((-F.col("level")).alias("height"), "n_linked", "parent_turn")).alias("best"))
    return best.select("conv_id", "turn", "best.parent_turn", "best.n_linked")


def roots(links: DataFrame) -> DataFrame:
    """(conv_id, turn, root_turn, depth) by doubling the way to the root each round."""
    state = cut(links.select("conv_id", "turn", F.col("parent_turn").alias("root_turn"), F.lit(1).cast("long").alias("depth")))
    while True:
        up = state.select("conv_id", F.col("turn").alias("root_turn"), F.col("root_turn").alias("higher"), F.col("depth").alias("more"))
        step = state.join(up, ["conv_id", "root_turn"], "left")
        new = cut(step.select("conv_id", "turn", F.coalesce("higher", "root_turn").alias("root_turn"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("higher").isNotNull().alias("moved")))
        if not new.where("moved").limit(1).count():
            return new.drop("moved")
        state = new.drop("moved")


def linked(messages: DataFrame) -> DataFrame:
    """Every message: conv_id, turn, role, body, n_quotes, quote_depth, n_linked, parent_turn, root_turn, depth.

    Sorted by (conv_id, root_turn, turn) messages follow what they reply to; a message without link is its own root.
    """
    rows = written(parsed(messages))
    links = written(parents(rows))
    tree = roots(links).join(links, ["conv_id", "turn"])
    out = rows.drop("quoted", "spoken").join(tree, ["conv_id", "turn"], "left")
    return out.select("conv_id", "turn", "role", "body", "n_quotes", "quote_depth", F.coalesce("n_linked", F.lit(0).cast("long")).alias("n_linked"), "parent_turn", F.coalesce("root_turn", "turn").alias("root_turn"), F.coalesce("depth", F.lit(0).cast("long")).alias("depth"))


def conversation_pages(rows: DataFrame, page: int = PAGE) -> DataFrame:
    """(conv_id, root_page, turn_page, messages): reply-ordered messages (role, content, turn, parent_turn) of linked(), a page holding `page` roots and turns at most."""
    paged = rows.withColumns({"root_page": F.floor(F.col("root_turn") / page), "turn_page": F.floor(F.col("turn") / page)})
    message = F.struct("root_turn", "turn", "role", F.col("body").alias("content"), "parent_turn")
    return paged.groupBy("conv_id", "root_page", "turn_page").agg(F.array_sort(F.collect_list(message)).alias("messages"))


def summary(conversations: DataFrame) -> DataFrame:
    """All messages of all conversations, linked and without quotes."""
    return linked(conversations)
