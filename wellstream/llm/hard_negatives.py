"""Hard negatives by rotated one-bit codes, exactly.

Every vector of integers is rotated (random signs and Hadamard transforms, the same for all vectors of a length) and
coded as signs: the sign vector, and its alignment, which is how far the vector reaches along it. What is left of the
vector is coded again, CODES times in all; the length of the last remainder is stored. Popcounts of differing signs give
the inner product of two coded vectors, and by Cauchy and Schwarz the true one differs from it by at most
|coded row| * remainder(anchor) + remainder(row) * |anchor|. This interval always holds. A pair is scored in integers
only if its interval reaches the limits of an anchor and what the task has found so far, so the result is exact.

Anchors are dealt into blocks of bounded size; a block is broadcast and meets all rows, task by task, and each task
returns the first few rows of each anchor. Nothing is grouped by label or by vector, so no label or vector is hot.

Rows without vec_id take no part, and neither do those with a null label, a null vector or any null or non-finite
component. Rows that share vec_id are one: the one with the least label, then the least vector. Of two vectors of different lengths
the shorter counts as filled up with zeros. Components are held within 2^31 / sqrt(length) on either side, so that
scores fit a long. Equal vectors are ties, ordered by vec_id. An empty table gives no rows; extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wellstream.llm.common import mix, ship, written

#: Codes of one vector; each leaves about 0.6 of the length that the one before it left.
CODES = 4
POSITIVES = 5
NEGATIVES = 5
#: Bytes of the anchors that are broadcast at once.
BLOCK_BYTES = 16 << 20
#: Bytes of vectors that a task aims at.
TASK_BYTES = 64 << 20
#: Rows that meet a block at a time, and numbers held at a time when pairs are scored.
CHUNK_ROWS = 1024
CHUNK_NUMBERS = 1 << 22
#: Allowance for rounding, as a part of the product of both lengths.
SLACK = 1e-9

CODED = "vec_id long, label int, vector array<double>, codes binary, scales array<double>, rest double, length double"


def taking_part(embeddings: DataFrame, label: Column, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, label, vector) of the rows that take part, one for each vec_id."""
    rows = embeddings.select(F.col(vec_id).cast("long").alias("vec_id"), label.cast("int").alias("label"), F.col(embedding).cast("array<double>").alias("vector"))
    rows = rows.where("vec_id is not null and label is not null and vector is not null").where(F.forall("vector", lambda x: F.coalesce(F.abs(x * 256) < float("inf"), F.lit(False))))
    if rows.groupBy("vec_id").count().where("count > 1").isEmpty():
        return rows
    least = F.min(F.struct("label", "vector")).alias("least")
    return rows.groupBy("vec_id").agg(least).select("vec_id", "least.label", "least.vector")


def rotated(vectors: np.ndarray) -> np.ndarray:
    """Rows of one length, turned by random signs and Hadamard transforms, at a power of two of numbers."""
    n, length = vectors.shape
    width = max(64, 1 << max(0, length - 1).bit_length())
    x = np.zeros((n, width))
    x[:, :length] = vectors
    for turn in range(2):
        x *= np.where(mix(np.arange(width, dtype=np.uint64) + np.uint64((turn + 1) << 40)) & np.uint64(1), 1.0, -1.0)
        step = 1
        while step < width:
            pairs = x.reshape(n, -1, 2, step)
            x = np.stack((pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]), axis=2).reshape(n, width)
            step *= 2
        x /= np.sqrt(width)
    return x


def encode(vectors: np.ndarray, codes: int = CODES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signs (row, code, word of 64 bits), alignments per code, and the length of what all codes leave."""
    left = rotated(vectors)
    width = left.shape[1]
    words = np.empty((len(left), codes, width // 64), dtype=np.uint64)
    scales = np.empty((len(left), codes))
    for k in range(codes):
        above = left >= 0
        words[:, k] = np.packbits(above, axis=1).view(np.uint64)
        scales[:, k] = np.abs(left).sum(axis=1) / np.sqrt(width)
        left = left - np.where(above, 1.0, -1.0) * (scales[:, k : k + 1] / np.sqrt(width))
    return words, scales, np.sqrt((left * left).sum(axis=1))


@dataclass
class Vectors:
    """Coded vectors of one length."""

    ids: np.ndarray
    labels: np.ndarray
    numbers: np.ndarray
    words: np.ndarray
    scales: np.ndarray
    rest: np.ndarray
    length: np.ndarray

    def take(self, rows: slice) -> Vectors:
        return Vectors(*(getattr(self, name)[rows] for name in self.__dataclass_fields__))


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    at = column.offsets.to_numpy()
    return column.values.to_numpy(zero_copy_only=False)[at[0] : at[-1]], at - at[0]


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, their vectors) of each length in a batch."""
    flat, at = _lists(batch.column("vector"))
    lengths = np.diff(at)
    for length in np.unique(lengths):
        rows = np.flatnonzero(lengths == length)
        most = max(1, CHUNK_NUMBERS // max(1, int(length)))
        for i in range(0, len(rows), most):
            some = rows[i : i + most]
            yield some, flat[at[some][:, None] + np.arange(length)]


def _coded(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in source:
        for rows, vectors in _by_length(batch):
            limit = np.floor(2.0**31 / np.sqrt(max(1, vectors.shape[1])))
            numbers = np.clip(np.floor(vectors * 256), -limit, limit)
            words, scales, rest = encode(numbers)
            some = batch.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays(
                [some.column("vec_id"), some.column("label"), pa.array(list(numbers), pa.list_(pa.float64())), pa.array([w.tobytes() for w in words], pa.binary()),
                 pa.array(list(scales), pa.list_(pa.float64())), pa.array(rest), pa.array(np.sqrt((numbers * numbers).sum(axis=1)))],
                ["vec_id", "label", "vector", "codes", "scales", "rest", "length"],
            )


def coded(rows: DataFrame) -> DataFrame:
    """(vec_id, label, vector) with codes, as a table; vectors become integers."""
    ship(rows.sparkSession)
    total = rows.agg(F.sum(F.size("vector") * 8 + 96)).first()[0] or 0
    tasks = max(2 * rows.sparkSession.sparkContext.defaultParallelism, -(-total // TASK_BYTES))
    return written(rows.repartition(tasks, "vec_id").mapInArrow(_coded, CODED))


def _vectors(batch: pa.RecordBatch) -> Iterator[Vectors]:
    ids, labels = batch.column("vec_id").to_numpy(), batch.column("label").to_numpy()
    rest, length = batch.column("rest").to_numpy(), batch.column("length").to_numpy()
    codes, scales = batch.column("codes"), _lists(batch.column("scales"))[0].reshape(-1, CODES)
    for rows, numbers in _by_length(batch):
        words = np.frombuffer(b"".join(codes[i].as_py() for i in rows), dtype=np.uint64).reshape(len(rows), CODES, -1)
        yield Vectors(ids[rows], labels[rows], numbers.astype(np.int64), words, scales[rows], rest[rows], length[rows])


def intervals(rows: Vectors, anchors: Vectors) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product of each row with each anchor."""
    most = rows.length[:, None] * anchors.length * (1 + SLACK) + 1e-3
    if rows.numbers.shape[1] != anchors.numbers.shape[1]:
        return -most, most
    width = rows.words.shape[2] * 64
    middle = np.zeros((len(rows.ids), len(anchors.ids)))
    for j in range(CODES):
        for k in range(CODES):
            differing = np.zeros(middle.shape, dtype=np.int64)
            for w in range(width // 64):
                differing += np.bitwise_count(rows.words[:, j, w][:, None] ^ anchors.words[:, k, w])
            middle += (rows.scales[:, j][:, None] * anchors.scales[:, k]) * (1 - differing * (2 / width))
    reach = (rows.length + rows.rest)[:, None] * anchors.rest + rows.rest[:, None] * anchors.length + most * SLACK + 1e-3
    return np.maximum(middle - reach, -most), np.minimum(middle + reach, most)


def scores(rows: Vectors, anchors: Vectors, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Integer inner products of row i[n] and anchor j[n]."""
    common = min(rows.numbers.shape[1], anchors.numbers.shape[1])
    out, slab = np.empty(len(i), dtype=np.int64), max(1, CHUNK_NUMBERS // max(1, common))
    for at in range(0, len(i), slab):
        part = slice(at, at + slab)
        out[part] = np.einsum("ij,ij->i", rows.numbers[i[part], :common], anchors.numbers[j[part], :common])
    return out


class Lanes:
    """For each lane, which is an anchor with limits of the score, the first few rows seen so far."""

    def __init__(self, anchors: Vectors, of: np.ndarray, floors: np.ndarray, caps: np.ndarray, same_label: bool, wanted: int):
        self.anchors, self.of, self.floors, self.caps, self.same_label, self.wanted = anchors, of, floors, caps, same_label, wanted
        self.lane, self.score, self.id = (np.empty(0, dtype=np.int64) for _ in range(3))
        self.least = floors.copy()

    def offer(self, rows: Vectors) -> None:
        low, high = intervals(rows, self.anchors)
        fits = (rows.labels[:, None] == self.anchors.labels) == self.same_label
        fits &= rows.ids[:, None] != self.anchors.ids
        reaching = fits[:, self.of] & (high[:, self.of] >= self.least) & (low[:, self.of] <= self.caps)
        i, lane = np.nonzero(reaching)
        score = scores(rows, self.anchors, i, self.of[lane])
        good = (score >= self.least[lane]) & (score <= self.caps[lane])
        lane, score, ids = (np.concatenate(x) for x in ((self.lane, lane[good]), (self.score, score[good]), (self.id, rows.ids[i[good]])))
        order = np.lexsort((ids, -score, lane))
        lane, score, ids = lane[order], score[order], ids[order]
        place = np.arange(len(lane)) - np.searchsorted(lane, lane)
        kept = place < self.wanted
        self.lane, self.score, self.id = lane[kept], score[kept], ids[kept]
        full = place == self.wanted - 1
        self.least[lane[full]] = score[full]


def _lanes(block: pa.Table, same_label: bool, wanted: int) -> list[Lanes]:
    """One for each length of anchors. limits: the greatest score that a lane takes; 80 % of it is the least."""
    out = []
    limits, at = _lists(block.column("limits").combine_chunks())
    limits = limits.astype(np.int64)
    numbered = {int(v): n for n, v in enumerate(block.column("vec_id").to_numpy())}
    for batch in block.combine_chunks().to_batches():
        for anchors in _vectors(batch):
            rows = np.array([numbered[int(v)] for v in anchors.ids], dtype=np.int64)
            if same_label:
                of, ends = np.arange(len(rows)), np.iinfo(np.int64)
                floors, caps = np.full(len(rows), ends.min, dtype=np.int64), np.full(len(rows), ends.max, dtype=np.int64)
            else:
                counts = at[rows + 1] - at[rows]
                of = np.repeat(np.arange(len(rows)), counts)
                caps = limits[np.repeat(at[rows], counts) + np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)]
                floors = -(-4 * caps // 5)
                of, floors, caps = (x[caps >= 0] for x in (of, floors, caps))  # 80 % of a negative score lies above it
            out.append(Lanes(anchors, of, floors, caps, same_label, wanted))
    return out


FOUND = "anchor_id long, cap long, vec_id long, score long"


def _first(rows: DataFrame, anchors: DataFrame, same_label: bool, wanted: int) -> DataFrame:
    """The first rows of each lane in each task; anchors: coded, with limits."""
    spark = rows.sparkSession
    ship(spark)
    total = anchors.agg(F.sum(F.size("vector") * 24 + 256)).first()[0] or 0
    blocks = -(-total // BLOCK_BYTES)
    block_of = F.pmod(F.xxhash64("vec_id"), F.lit(max(1, blocks)))
    found = None
    for number in range(blocks):
        block = anchors.where(block_of == number).select(*(c.split()[0] for c in CODED.split(", ")), "limits").toArrow()
        shared = spark.sparkContext.broadcast(block)

        def run(source: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            lanes = _lanes(shared.value, same_label, wanted)
            for batch in source:
                for some in _vectors(batch):
                    chunk = max(16, min(CHUNK_ROWS, CHUNK_NUMBERS // max(1, *(len(x.of) for x in lanes))))
                    for at in range(0, len(some.ids), chunk):
                        for x in lanes:
                            x.offer(some.take(slice(at, at + chunk)))
            for x in lanes:
                if len(x.lane):
                    yield pa.RecordBatch.from_arrays([pa.array(v) for v in (x.anchors.ids[x.of[x.lane]], x.caps[x.lane], x.id, x.score)], ["anchor_id", "cap", "vec_id", "score"])

        # one table for each block: its broadcast can go, and the plan doesn't grow with the blocks
        part = written(rows.mapInArrow(run, FOUND)) if blocks > 1 else rows.mapInArrow(run, FOUND)
        found = part if found is None else found.unionByName(part)
    return spark.createDataFrame([], FOUND) if found is None else found


def _places(found: DataFrame, by: list[str], wanted: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= wanted)


def mined(embeddings: DataFrame, label: Column, anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """For each anchor and each of its positives, the first negatives that score from 80 to 100 % of the positive.

    label: an expression over embeddings; anchor: a condition on vec_id. Positives are the first other rows of the label.
    """
    rows = coded(taking_part(embeddings, label, vec_id, embedding))
    anchors = rows.where(anchor)
    near = written(_places(_first(rows, anchors.withColumn("limits", F.array().cast("array<long>")), True, positives), ["anchor_id"], positives).select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))
    limits = near.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.sort_array(F.collect_set("positive_score")).alias("limits"))  # as many as positives at most
    far = _places(_first(rows, anchors.join(limits, "vec_id"), False, negatives), ["anchor_id", "cap"], negatives)
    far = far.select("anchor_id", F.col("cap").alias("positive_score"), F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return near.join(far, ["anchor_id", "positive_score"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def summary(embeddings: DataFrame) -> DataFrame:
    """Anchors are the rows whose vec_id 100 divides; where 7 divides it, the label is the next of ten."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mined(embeddings, label, F.col("vec_id") % 100 == 0)


ORACLE = """
with rows as (
    select cast(vec_id as bigint) as vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
        list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as numbers
    from embeddings
    where vec_id is not null and label is not null and embedding is not null
        and coalesce(list_bool_and(list_transform(embedding, lambda x: x is not null and isfinite(x))), true)
), scored as (
    select a.vec_id as anchor_id, b.vec_id as other_id, a.label = b.label as same,
        cast(list_sum(list_transform(list_zip(a.numbers, b.numbers), lambda z: z[1] * z[2])) as bigint) as score
    from rows a join rows b on a.vec_id % 100 = 0 and b.vec_id <> a.vec_id
), positives as (
    select * from scored where same
    qualify row_number() over (partition by anchor_id order by score desc, other_id) <= 5
)
select p.anchor_id, p.other_id as positive_id,
    cast(row_number() over (partition by p.anchor_id, p.other_id order by n.score desc, n.other_id) as integer) as rank,
    n.other_id as negative_id, p.score as positive_score, n.score as negative_score
from positives p join scored n on n.anchor_id = p.anchor_id and not n.same
    and 80 * p.score <= 100 * n.score and 100 * n.score <= 100 * p.score
qualify row_number() over (partition by p.anchor_id, p.other_id order by n.score desc, n.other_id) <= 5
"""
