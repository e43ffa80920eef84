"""MinHash near-duplicates with odd sketches.

Each document becomes a set of word shingles, a MinHash signature and an odd sketch: every signature value flips one bit
of a short bitmap, so the bits that differ between two bitmaps tell how many values differ. Equal sets are one node.
Nodes that agree in a whole band of the signature meet in a bucket. Buckets are never expanded into all pairs:

1. every node of a bucket is compared with the smallest one (a star), and links make components;
2. in buckets that still hold several components, blocks of at most BLOCK nodes are compared by their sketches; each
   node offers its best partner in another component, the links found join components, and so on while that helps;
3. all pairs left between different components whose sketches allow a link are confirmed.

A candidate is dropped if its sketches put it MARGIN below the threshold, or if it can't be a link: a second bitmap holds
the parity of the set itself, and two of these never differ in more bits than the sets differ in shingles. The rest are
confirmed on full sets.

Null or empty text has no shingles and is linked with nothing. Rows that share a doc_id are one document. A row without
doc_id gets the component of documents with the same set (null if there is none). Extra columns are left alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wellstream.llm.common import map_batches, mix, packed, shingles_of, ship, unpacked, words_of, written, NONBLANK_BYTES
from wellstream.llm.components import components

SHINGLE_WORDS = 5
BANDS, ROWS = 40, 6
SKETCH_BITS = 512
#: Sketches whose estimate is this much below the threshold are no candidates: over four standard errors.
MARGIN = 0.1
BLOCK = 1024
#: Nodes whose ids may be broadcast to pick their texts (16 bytes each); with more, texts and ids are shuffled.
BROADCAST_NODES = 1_000_000
#: Rounds in which each node offers its best partner before all pairs that are left are confirmed.
ROUNDS = 3
_SEEDS = mix(np.arange(1, 2 * BANDS * ROWS + 1, dtype=np.uint64))
_TIMES = (_SEEDS[::2] | np.uint64(1)).astype(np.uint32)
_PLUS = _SEEDS[1::2].astype(np.uint32)
_CACHED = 1 << 16


def distinct_shingles(texts: pa.Array, k: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The shingle set of each text, ascending, and the shingles before each text."""
    words, first = words_of(texts, NONBLANK_BYTES)
    shingles, before = shingles_of(words, first, k)
    sets = [np.unique(shingles[a:b]) for a, b in zip(before[:-1], before[1:], strict=True)]
    return np.concatenate(sets) if sets else shingles, np.concatenate(([0], np.cumsum([len(s) for s in sets], dtype=np.int64)))


def signatures(shingles: np.ndarray, before: np.ndarray) -> np.ndarray:
    """MinHash of each set that isn't empty: BANDS * ROWS values of 32 bits."""
    low = shingles.astype(np.uint32)
    filled = np.flatnonzero(np.diff(before))
    out = np.empty((len(filled), BANDS * ROWS), dtype=np.uint32)
    starts, ends = before[:-1][filled], before[1:][filled]
    at = 0
    while at < len(filled):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + _CACHED, side="right")))
        x, s = low[starts[at] : ends[to - 1]], starts[at:to] - starts[at]
        for i in range(BANDS * ROWS):
            out[at:to, i] = np.minimum.reduceat(x * _TIMES[i] + _PLUS[i], s)
        at = to
    return out


def odd_sketches(values: np.ndarray) -> np.ndarray:
    """Parity bitmaps of signatures as SKETCH_BITS / 64 words each."""
    n, k = values.shape
    elements = mix((values.astype(np.uint64) << np.uint64(16)) + np.arange(k, dtype=np.uint64))
    return _parities(elements.reshape(-1), np.arange(n + 1) * k)


def set_parities(shingles: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Parity bitmaps of the sets themselves, empty ones included."""
    return _parities(mix(shingles ^ np.uint64(0x2545F4914F6CDD1D)), before)


def _parities(elements: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Bitmaps in which each element of a row flips one bit; before: the elements before each row."""
    n = len(before) - 1
    bits = (elements % np.uint64(SKETCH_BITS)).astype(np.int64)
    out = np.empty((n, SKETCH_BITS // 64), dtype=np.uint64)
    for a in range(0, n, 2048):
        b = min(n, a + 2048)
        row = np.repeat(np.arange(b - a), np.diff(before[a : b + 1]))
        parity = (np.bincount(bits[before[a] : before[b]] + row * SKETCH_BITS, minlength=(b - a) * SKETCH_BITS) & 1).astype(np.uint8)
        out[a:b] = np.packbits(parity.reshape(-1, SKETCH_BITS), axis=1).view(np.uint64)
    return out


def most_differing_bits(similarity: float) -> int:
    """Bits in which the sketches of sets so similar are expected to differ."""
    return math.floor(SKETCH_BITS / 2 * (1 - math.exp(-4 * BANDS * ROWS * (1 - similarity) / SKETCH_BITS)))


def estimated_similarity(differing: np.ndarray | float) -> np.ndarray | float:
    """What that many differing bits say of the sets."""
    return 1 + SKETCH_BITS / (4 * BANDS * ROWS) * np.log(np.maximum(1 - 2 * np.asarray(differing) / SKETCH_BITS, 1e-9))


def _long(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def _lists(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), _long(np.ascontiguousarray(values).reshape(-1)))


def sketched(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, n_shingles, set_a and set_b (a 128-bit key of the set), bands, sketch, parity."""

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        shingles, before = distinct_shingles(part.column(1), k)
        n = np.diff(before)
        filled = np.flatnonzero(n)
        values = signatures(shingles, before)
        banded = values.reshape(len(values), BANDS, ROWS).astype(np.uint64)
        keys = mix(np.arange(BANDS, dtype=np.uint64)[None, :] + np.uint64(1))
        keys = np.repeat(keys, len(values), axis=0)
        for r in range(ROWS):
            keys = mix(keys + banded[:, :, r])
        set_a, set_b = np.zeros(len(n), dtype=np.uint64), np.zeros(len(n), dtype=np.uint64)
        if len(filled):
            begin = before[:-1][filled]
            set_a[filled] = np.add.reduceat(mix(shingles), begin)
            set_b[filled] = np.add.reduceat(mix(shingles ^ np.uint64(0x5851F42D4C957F2D)), begin)
        offsets = lambda width: np.concatenate(([0], np.cumsum((n > 0) * width)))
        bitmaps = [_lists(x, offsets(SKETCH_BITS // 64)) for x in (odd_sketches(values), set_parities(shingles, before)[filled])]
        return pa.RecordBatch.from_arrays(
            [part.column(0), pa.array(n), _long(set_a), _long(set_b), _lists(keys, offsets(BANDS)), *bitmaps],
            ["doc_id", "n_shingles", "set_a", "set_b", "bands", "sketch", "parity"],
        )

    rows = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return map_batches(rows, run, "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>, sketch array<long>, parity array<long>")


def _differing(a: str, b: str) -> Column:
    words = [F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in range(SKETCH_BITS // 64)]
    return sum(words[1:], words[0])


def _sets(documents: DataFrame, nodes: DataFrame, doc_id: str, text: str, k: int) -> DataFrame:
    """(node, shingles) of the documents that name a node."""
    if nodes.count() <= BROADCAST_NODES:
        nodes = F.broadcast(nodes)
    rows = documents.select(F.col(doc_id).cast("long").alias("node"), F.col(text).alias("text")).join(nodes, "node", "left_semi")

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        shingles, before = distinct_shingles(part.column(1), k)
        return pa.RecordBatch.from_arrays([part.column(0), _lists(shingles, before)], ["node", "shingles"])

    return map_batches(rows, run, "node long, shingles array<long>")


class NearDuplicates:
    """One run over a table of documents."""

    def __init__(self, documents: DataFrame, percent: int, doc_id: str, text: str, k: int) -> None:
        self.documents, self.percent, self.doc_id, self.text, self.k = documents, percent, doc_id, text, k
        self.rows = written(sketched(documents, doc_id, text, k))
        filled = self.rows.where("n_shingles > 0 and doc_id is not null")
        sets = filled.groupBy("set_a", "set_b").agg(F.min(F.struct("doc_id", "n_shingles", "bands", "sketch", "parity")).alias("least"))
        self.nodes = written(sets.select("set_a", "set_b", F.col("least.doc_id").alias("node"), F.col("least.n_shingles").alias("n"), "least.bands", "least.sketch", "least.parity"))
        self.most_bits = most_differing_bits(percent / 100 - MARGIN)

    def promising(self, pairs: DataFrame) -> DataFrame:
        """Those of the pairs (a, b) whose sketches allow a link, with the sizes of their sets."""
        for end in ("b", "a"):
            names = {"node": end, "n": f"n_{end}", "sketch": f"sketch_{end}", "parity": f"parity_{end}"}
            pairs = pairs.join(self.nodes.select(*names).withColumnsRenamed(names), end)
        small, large = F.least("n_a", "n_b"), F.greatest("n_a", "n_b")
        pairs = pairs.where((100 * small >= self.percent * large) & (_differing("sketch_a", "sketch_b") <= self.most_bits))
        # (100 - percent) * both sizes >= (100 + percent) * symmetric difference is the threshold itself
        pairs = pairs.where((100 - self.percent) * (small + large) >= (100 + self.percent) * _differing("parity_a", "parity_b"))
        return pairs.select("a", "b", "n_a", "n_b")

    def confirmed(self, pairs: DataFrame) -> DataFrame:
        """Those of the pairs (a, b, n_a, n_b) whose full sets are similar enough."""
        pairs = written(pairs)
        ends = pairs.select(F.col("a").alias("node")).distinct().unionByName(pairs.select(F.col("b").alias("node")).distinct()).distinct()
        sets = written(_sets(self.documents, written(ends), self.doc_id, self.text, self.k))
        both = pairs.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("shingles_b")), "b")
        both = both.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("shingles_a")), "a")
        shared = F.size(F.array_intersect("shingles_a", "shingles_b"))
        return both.where(100 * shared >= self.percent * (F.col("n_a") + F.col("n_b") - shared)).select("a", "b")

    def linked(self) -> tuple[DataFrame, DataFrame]:
        """Confirmed links (a, b) between nodes that connect all that is connected, and the components (node, component)."""
        banded = self.nodes.select(F.explode("bands").alias("bucket"), "node")
        buckets = banded.groupBy("bucket").agg(F.min("node").alias("least"), F.count("*").alias("size")).where("size > 1")
        members = written(banded.join(buckets, "bucket"))
        stars = members.where("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b")).distinct()
        links = written(self.confirmed(self.promising(stars)))
        for turn in range(ROUNDS + 1):
            labels = components(links)
            pairs = written(self.across(members, labels, best=turn < ROUNDS))
            if not pairs.limit(1).count():
                return links, labels
            found = written(self.confirmed(pairs))
            if turn < ROUNDS and not found.limit(1).count():
                # the best offers were no links: what is left is settled at once
                found, turn = written(self.confirmed(self.across(members, labels, best=False))), ROUNDS
            if not found.limit(1).count():
                return links, labels
            links = links.unionByName(found)
            if turn == ROUNDS:
                break
        return links, components(links)

    def across(self, members: DataFrame, labels: DataFrame, best: bool) -> DataFrame:
        """Pairs (a, b, n_a, n_b) of a bucket in different components whose sketches allow a link; best: for each node and block the best one."""
        named = members.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
        mixed = named.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("bucket")
        rows = named.join(mixed, "bucket").join(self.nodes.select("node", "n", "sketch", "parity"), "node")
        blocks = F.ceil(F.col("size") / BLOCK).cast("int")
        rows = rows.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
        rows = rows.select("bucket", "node", "component", "n", "sketch", "parity", "own", other.alias("other"))
        low, high = F.least("own", "other"), F.greatest("own", "other")
        rows = rows.select("bucket", low.alias("low"), high.alias("high"), "own", "node", "component", "n", "sketch", "parity")
        rows = rows.repartition("bucket", "low", "high").sortWithinPartitions("bucket", "low", "high")
        percent, most_bits = self.percent, self.most_bits

        def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for table in whole_groups(source, ["bucket", "low", "high"]):
                yield block_pairs(table, percent, most_bits, best)

        ship(rows.sparkSession)
        return rows.mapInArrow(run, "a long, b long, n_a long, n_b long").distinct()


def whole_groups(source: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Sorted batches regrouped so that no group is cut."""
    held: pa.Table | None = None
    for batch in source:
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table]).combine_chunks()
        new = group_starts(table, keys)
        if len(new) > 1:
            yield table.slice(0, int(new[-1]))
            held = table.slice(int(new[-1]))
        else:
            held = table
    if held is not None and held.num_rows:
        yield held.combine_chunks()


def group_starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    new = np.zeros(table.num_rows, dtype=bool)
    new[:1] = True
    for key in keys:
        column = table.column(key).to_numpy()
        new[1:] |= column[1:] != column[:-1]
    return np.flatnonzero(new)


def block_pairs(table: pa.Table, percent: int, most_bits: int, best: bool) -> pa.RecordBatch:
    """Pairs within the groups of sorted rows; between two blocks only pairs across."""
    table = table.combine_chunks()
    starts = group_starts(table, ["bucket", "low", "high"])
    rows = table.num_rows
    group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, rows)))
    node, component, n, own = (table.column(c).to_numpy() for c in ("node", "component", "n", "own"))
    two = table.column("low").to_numpy() != table.column("high").to_numpy()
    sketch, parity = (
        np.concatenate([c.values.to_numpy()[c.offsets[0].as_py() : c.offsets[-1].as_py()] for c in table.column(name).chunks]).view(np.uint64).reshape(rows, -1)
        for name in ("sketch", "parity")
    )
    score = np.full(rows, SKETCH_BITS + 1)
    partner = np.full(rows, -1)
    left, right = [], []
    i = np.arange(rows)
    for d in range(1, int(np.diff(np.append(starts, rows)).max(initial=0))):
        i = i[i + d < rows]
        i = i[group[i] == group[i + d]]
        j = i + d
        ok = (component[i] != component[j]) & (~two[i] | (own[i] != own[j]))
        ok &= 100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])
        a, b = i[ok], j[ok]
        apart = np.bitwise_count(parity[a] ^ parity[b]).sum(axis=1, dtype=np.int64)
        able = (100 - percent) * (n[a] + n[b]) >= (100 + percent) * apart
        a, b = a[able], b[able]
        bits = np.bitwise_count(sketch[a] ^ sketch[b]).sum(axis=1, dtype=np.int64)
        a, b, bits = a[bits <= most_bits], b[bits <= most_bits], bits[bits <= most_bits]
        if best:
            for x, y in ((a, b), (b, a)):  # no place occurs twice on a side
                better = bits < score[x]
                score[x[better]], partner[x[better]] = bits[better], y[better]
        else:
            left.append(a)
            right.append(b)
    if best:
        a = np.flatnonzero(partner >= 0)
        b = partner[a]
    else:
        a, b = (np.concatenate(x) if x else np.empty(0, dtype=np.int64) for x in (left, right))
    a, b = np.where(node[a] < node[b], a, b), np.where(node[a] < node[b], b, a)
    return pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b]), pa.array(n[a]), pa.array(n[b])], ["a", "b", "n_a", "n_b"])


def near_duplicates(documents: DataFrame, percent: int = 80, doc_id: str = "doc_id", text: str = "text", k: int = SHINGLE_WORDS) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id reachable), kept, n_links (see below).

    Links are between documents whose shingle sets share at least `percent` per cent of their union. n_links counts the
    confirmed links of the document's set that were needed to connect its component.
    """
    run = NearDuplicates(documents, percent, doc_id, text, k)
    links, labels = run.linked()
    links = written(links)
    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))
    nodes = run.nodes.select("set_a", "set_b", "node").join(labels, "node", "left").join(degree, "node", "left")
    nodes = nodes.select("set_a", "set_b", F.coalesce("component", "node").alias("component"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))
    rows = run.rows.select("doc_id", "n_shingles", "set_a", "set_b")
    filled = rows.where("n_shingles > 0").join(nodes, ["set_a", "set_b"], "left")
    empty = rows.where("n_shingles = 0").withColumns({"component": F.col("doc_id"), "n_links": F.lit(0).cast("long")})
    out = filled.select("doc_id", "n_shingles", "component", "n_links").unionByName(empty.select("doc_id", "n_shingles", "component", "n_links"))
    return out.select("doc_id", "n_shingles", F.col("component").alias("component_id"), F.coalesce(F.col("doc_id") == F.col("component"), F.lit(False)).alias("kept"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))


def representatives(documents: DataFrame, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group of near duplicates: that with the smallest doc_id, rows without doc_id last; all columns as they were.

    For the run a row is known by a hash of doc_id and text, so rows that share a doc_id, or have none, are linked by their
    own texts. Of rows equal in both the one with the smallest hash of all columns stays. Rows without shingles stay.
    """
    name = "key of the run"
    keyed = packed(documents).withColumn(name, F.xxhash64(f"row.`{doc_id}`", f"row.`{text}`"))
    found = near_duplicates(keyed.select(F.col(name).alias("doc_id"), F.col(f"row.`{text}`").alias("text")), percent)
    groups = found.where("n_shingles > 0").select(F.col("doc_id").alias(name), "component_id").distinct()
    ids = keyed.groupBy(name).agg(F.first(F.col(f"row.`{doc_id}`").cast("long")).alias("id"), F.count("*").alias("n"))
    groups = written(groups.join(ids, name))
    best = groups.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", name, "n")).alias("best"))
    best = written(best.select(f"best.`{name}`", "best.n"))
    dropped = _picked(groups.select(name).join(best, name, "left_anti"))
    kept = keyed.join(dropped, name, "left_anti")
    several = best.where("n > 1").select(name)
    if not several.limit(1).count():
        return unpacked(kept)
    several = _picked(several)
    hashed = [F.col(f"row.`{n}`") for n, kind in documents.dtypes if "map<" not in kind]
    one = kept.join(several, name, "left_semi").groupBy(name).agg(F.min_by("row", F.xxhash64(*hashed)).alias("row"))
    return unpacked(kept.join(several, name, "left_anti").select("row").unionByName(one.select("row")))


def _picked(keys: DataFrame) -> DataFrame:
    """keys written, to be broadcast if they are few."""
    keys = written(keys)
    return F.broadcast(keys) if keys.count() <= BROADCAST_NODES else keys
