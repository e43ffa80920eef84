"""Benchmark decontamination with suffix arrays over the training text.

Every slice of the documents is a shard with a suffix array of its words. Every suffix of every benchmark item is found
in it by binary search: the interval of its longest match gives the match and all places, the interval at window length
gives the words that are hit. Items come in blocks of bounded size, each broadcast to all shards; a document meets all
blocks where it lies, so nothing is shuffled.

Null or empty text has no words and is never hit. A null item_id is not listed among a document's items, its words are
hit all the same. Repeated rows are judged row by row. Extra columns are left alone.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wellstream.llm.common import ALNUM_BYTES, map_batches, words_of, written

WINDOW_WORDS = 10
#: Text of benchmark items that is broadcast at once.
BLOCK_BYTES = 8 << 20
#: Text of a shard; its suffix array and the arrays that sort it take many times as much.
SHARD_BYTES = 2 << 20


class SuffixArray:
    """The suffixes of several texts in order of their words, compared up to `depth` words; texts don't run into each other."""

    def __init__(self, words: np.ndarray, first: np.ndarray, depth: int) -> None:
        counts = np.diff(first)
        self.vocabulary, ranks = np.unique(words, return_inverse=True)
        n = len(words) + len(counts)
        self.text = np.zeros(n + 1, dtype=np.int64)  # 0 ends a text and is no word
        self.place = np.arange(len(words)) + np.repeat(np.arange(len(counts)), counts)
        self.text[self.place] = ranks.reshape(-1) + 1
        self.owner = np.repeat(np.arange(len(counts)), counts + 1)
        self.order = self._sorted(self.place, depth)

    def _sorted(self, places: np.ndarray, depth: int) -> np.ndarray:
        bits = max(1, int(len(self.vocabulary)).bit_length())
        known = max(1, min(3, 62 // bits))
        key = self.text[places]
        for j in range(1, known):
            key = (key << bits) | self.text[np.minimum(places + j, len(self.text) - 1)]
        order = np.argsort(key)
        key = key[order]
        order = places[order]
        group = np.zeros(len(self.text), dtype=np.int64)  # of a place: where its group of equal prefixes begins, from 1
        new = np.concatenate(([True], key[1:] != key[:-1])) if len(key) else np.zeros(0, dtype=bool)
        begin = np.flatnonzero(new)
        group[order] = np.repeat(begin, np.diff(np.append(begin, len(order)))) + 1
        tied = np.arange(len(order))
        while known < depth:
            last = np.append(new[1:], True) if len(new) else new
            left = ~(new & last)
            if not left.any():
                break
            tied = tied[left]
            some = order[tied]
            key = (group[some] << 32) | group[np.minimum(some + known, len(self.text) - 1)]
            by = np.argsort(key)
            key, some = key[by], some[by]
            order[tied] = some
            new = np.concatenate(([True], key[1:] != key[:-1]))
            begin = np.flatnonzero(new)
            group[some] = np.repeat(tied[begin], np.diff(np.append(begin, len(some)))) + 1
            known *= 2
        return order

    def ranks(self, words: np.ndarray) -> np.ndarray:
        """Of words outside the shard: -1."""
        if not len(self.vocabulary):
            return np.full(len(words), -1)
        at = np.minimum(np.searchsorted(self.vocabulary, words), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == words, at + 1, -1)

    def _bound(self, low: np.ndarray, high: np.ndarray, depth: int, rank: np.ndarray, after: bool) -> np.ndarray:
        low, high = low.copy(), high.copy()
        while (open_ := low < high).any():
            middle = (low + high) >> 1
            seen = self.text[np.minimum(self.order[np.minimum(middle, len(self.order) - 1)] + depth, len(self.text) - 1)]
            right = open_ & ((seen <= rank) if after else (seen < rank))
            low = np.where(right, middle + 1, low)
            high = np.where(open_ & ~right, middle, high)
        return low

    def search(self, queries: Suffixes) -> tuple[np.ndarray, ...]:
        """Of each suffix: the interval of matches of its window (empty if none), length and interval of its longest match."""
        n = len(queries.start)
        rank = np.append(self.ranks(queries.words), -1)
        low, high = np.zeros(n, dtype=np.int64), np.full(n, len(self.order), dtype=np.int64)
        window_low, window_high = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        longest = np.zeros(n, dtype=np.int64)
        active, depth = np.arange(n) if len(self.order) else np.arange(0), 0
        while len(active):
            active = active[queries.length[active] > depth]
            r = rank[queries.start[active] + depth]
            active, r = active[r > 0], r[r > 0]
            a, b = low[active], high[active]
            a, b = self._bound(a, b, depth, r, False), self._bound(a, b, depth, r, True)
            active, a, b = active[a < b], a[a < b], b[a < b]
            low[active], high[active] = a, b
            depth += 1
            longest[active] = depth
            full = active[queries.window[active] == depth]
            window_low[full], window_high[full] = low[full], high[full]
        return window_low, window_high, longest, low, high

    def places(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in the intervals, and the interval of each."""
        sizes = high - low
        which = np.repeat(np.arange(len(low)), sizes)
        inside = np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return self.order[low[which] + inside], which


@dataclass
class Suffixes:
    """All suffixes of the items of a block."""

    words: np.ndarray
    start: np.ndarray
    length: np.ndarray
    window: np.ndarray
    item: np.ndarray
    ids: list[str | None]

    @staticmethod
    def of(ids: list, texts: list, window: int) -> Suffixes:
        words, first = words_of(pa.array(texts, pa.string()), ALNUM_BYTES)
        counts = np.diff(first)
        item = np.repeat(np.arange(len(counts)), counts)
        length = np.repeat(first[1:], counts) - np.arange(len(words))
        total = counts[item]
        # an item shorter than a window is one window; a suffix shorter than its window has none
        size = np.where(total < window, total, window)
        size = np.where(length >= size, size, 0)
        return Suffixes(words, np.arange(len(words)), length, size, item, [None if x is None else str(x) for x in ids])


def item_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES, item_id: str = "item_id", text: str = "text") -> list[DataFrame]:
    """Items in blocks of about block_bytes; the number follows from their size."""
    items = benchmark.select(F.col(item_id).alias("item_id"), F.col(text).alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // block_bytes) or 1
    if n == 1:
        return [items]
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    return [items.where(block == i) for i in range(n)]


def _hits(texts: pa.Array, block: Suffixes) -> tuple[np.ndarray, list[np.ndarray], list[list[str]]]:
    """Words of each text; of those with a hit the runs of hit words, and the items."""
    words, first = words_of(texts, ALNUM_BYTES)
    counts = np.diff(first)
    runs: list[np.ndarray] = [np.empty(0, dtype=np.int64)] * len(counts)
    items: list[list[str]] = [[]] * len(counts)
    shard = SuffixArray(words, first, int(block.length.max(initial=0)))
    low, high, *_ = shard.search(block)
    some = np.flatnonzero(high > low)
    if len(some):
        place, which = shard.places(low[some], high[some])
        change = np.zeros(len(shard.text) + 1, dtype=np.int64)
        np.add.at(change, place, 1)
        np.add.at(change, place + block.window[some][which], -1)
        hit = np.concatenate(([False], np.cumsum(change) > 0))
        begin = np.flatnonzero(hit[1:] & ~hit[:-1])
        end = np.flatnonzero(hit[:-1] & ~hit[1:])
        offset = first[:-1] + np.arange(len(counts))  # of a text's first word in shard.text
        owner = shard.owner[begin]
        for doc in np.unique(owner):
            mine = owner == doc
            runs[doc] = np.column_stack((begin[mine], end[mine])).reshape(-1) - offset[doc]
        pairs = np.unique(shard.owner[place] * np.int64(len(block.ids)) + block.item[some][which])
        for pair in pairs:
            doc, item = divmod(int(pair), len(block.ids))
            if (name := block.ids[item]) is not None:
                items[doc] = [*items[doc], name]
    return counts, runs, items


def find_overlaps(documents: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW_WORDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """documents with hit_words (all words), hit_runs (start, end, start, ... in words, end exclusive) and hit_items."""
    spark = documents.sparkSession
    blocks = item_blocks(benchmark, block_bytes, item_id, item_text)
    schema = "hit_words long, hit_runs array<long>, hit_items array<string>"
    for number, frame in enumerate(blocks):
        rows = frame.collect()  # at most about block_bytes
        block = spark.sparkContext.broadcast(Suffixes.of([r.item_id for r in rows], [r.text for r in rows], window))
        if number:
            documents = written(documents)  # one block in memory at a time
        documents = _matched(documents, block, text, schema, first=number == 0)
    return documents


def _matched(documents: DataFrame, block, text: str, schema: str, first: bool) -> DataFrame:
    from pyspark.sql import types as T

    added = T._parse_datatype_string(schema)
    kept = documents.drop(*added.fieldNames()) if first else documents
    position = kept.columns.index(text)

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        counts, runs, items = _hits(part.column(position), block.value)
        if not first:
            at = part.num_columns - 2
            runs = [_merged(a, b) for a, b in zip(runs, part.column(at).to_pylist(), strict=True)]
            items = [sorted({*a, *b}) for a, b in zip(items, part.column(at + 1).to_pylist(), strict=True)]
        columns = part.columns if first else part.columns[:-3]
        return pa.RecordBatch.from_arrays(
            [*columns, pa.array(counts, pa.int64()), pa.array(runs, pa.list_(pa.int64())), pa.array([sorted({*x}) for x in items], pa.list_(pa.string()))],
            [*(part.schema.names if first else part.schema.names[:-3]), *added.fieldNames()],
        )

    return map_batches(kept, run, T.StructType([*kept.schema.fields, *added.fields]) if first else kept.schema, text, SHARD_BYTES)


def _merged(a: np.ndarray, b: list[int]) -> np.ndarray:
    both = sorted([*zip(a[::2].tolist(), a[1::2].tolist(), strict=True), *zip(b[::2], b[1::2], strict=True)])
    out: list[list[int]] = []
    for start, end in both:
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return np.array(out, dtype=np.int64).reshape(-1)


def decontaminated(documents: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """The documents without any word inside a benchmark window; all their columns as they were, whatever their names."""
    names = documents.columns
    plain = documents.toDF(*(f"c{i}" for i in range(len(names))))
    found = find_overlaps(plain, benchmark, text=f"c{names.index(text)}", **options)
    return found.where(F.size("hit_runs") == 0).select(*plain.columns).toDF(*names)


def longest_matches(documents: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES, least_words: int = 1) -> DataFrame:
    """One row per benchmark suffix that occurs: item_id (text), start, words, places, and the first place (doc_id, at) of its longest verbatim match."""
    docs = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    out = None
    for frame in item_blocks(benchmark, block_bytes):
        rows = frame.collect()
        block = documents.sparkSession.sparkContext.broadcast(Suffixes.of([r.item_id for r in rows], [r.text for r in rows], WINDOW_WORDS))

        def run(part: pa.RecordBatch, block=block) -> pa.RecordBatch:
            queries = block.value
            words, first = words_of(part.column(1), ALNUM_BYTES)
            shard = SuffixArray(words, first, int(queries.length.max(initial=0)))
            *_, longest, low, high = shard.search(queries)
            some = np.flatnonzero(longest >= least_words)
            place, which = shard.places(low[some], high[some])
            doc = shard.owner[place]
            at = place - (first[:-1] + np.arange(len(first) - 1))[doc]
            ids = part.column(0)
            begin = np.concatenate(([0], np.cumsum(np.bincount(queries.item, minlength=len(queries.ids)))))
            suffix = some[which]
            return pa.RecordBatch.from_arrays(
                [pa.array([queries.ids[i] for i in queries.item[suffix]], pa.string()), pa.array(suffix - begin[queries.item[suffix]]), pa.array(longest[suffix]), ids.take(pa.array(doc)).cast(pa.string()), pa.array(at)],
                ["item_id", "start", "words", "doc_id", "at"],
            )

        found = map_batches(docs, run, "item_id string, start long, words long, doc_id string, at long")
        best = found.groupBy("item_id", "start", "words").agg(F.count("*").alias("places"), F.min(F.struct("doc_id", "at")).alias("first_place"))
        best = best.groupBy("item_id", "start").agg(F.max(F.struct("words", "places", "first_place")).alias("best")).select("item_id", "start", "best.words", "best.places", "best.first_place.doc_id", "best.first_place.at")
        out = best if out is None else out.unionByName(best)
    return out


def summary(documents: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, longest_run (hit words on end)."""
    found = find_overlaps(documents.select("doc_id", "text"), benchmark, **options)
    lengths = F.expr("""case when size(hit_runs) = 0 then cast(array() as array<bigint>)
        else transform(sequence(0, size(hit_runs) - 2, 2), i -> hit_runs[i + 1] - hit_runs[i]) end""")
    return found.select(
        "doc_id",
        F.col("hit_words").alias("n_words"),
        F.aggregate(lengths, F.lit(0).cast("long"), lambda a, x: a + x).alias("n_hit"),
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("hit_runs") > 0).alias("contaminated"),
        F.coalesce(F.array_max(lengths), F.lit(0).cast("long")).alias("longest_run"),
    )


