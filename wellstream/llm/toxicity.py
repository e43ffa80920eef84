"""Toxicity by two class-conditional Kneser-Ney models.

A model gives the bytes of a word, A-Z folded, from the five bytes before. The counts of six bytes are those of toxic or
of ordinary labelled text; both models back off to one Kneser-Ney model of all documents (counts of six bytes, and
continuation counts below). An expression that neither class has seen thus gets nearly equal likelihoods, however rare
it is. The score is the difference of the log-likelihoods, normalised by length, calibrated by logistic regression on
labelled rows that the models have not seen.

Labels are taken from at most SAMPLE_ROWS rows of each class (the smallest hashes of doc_id), so the class counts have a
bounded size and are broadcast; the shared counts are tables. Rows without label or doc_id teach nothing. Repeated
labels of a document count once, as toxic if any says so. Null or empty text has a difference of 0. If a class has no
row among the documents to make the models or to calibrate them, there is no model: nothing is called toxic, every score
is 0. Extra columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wellstream.llm.calibrate import Calibration, fit, has_both_classes, held_out_of, labelled_sample, sampled_texts
from wellstream.llm.common import ALNUM_BYTES, FOLD, map_batches, span_hashes, text_bytes, with_results, word_spans, written

ORDER = 6
DISCOUNT = 0.75
#: Labelled rows of each class that the models and their calibration learn from.
SAMPLE_ROWS = 4000
#: A word this much likelier as toxic (natural logarithm) stands out.
OUTSTANDING = 3.0
#: Score from which a document is called toxic, in the operator and in the pipeline.
THRESHOLD = 0.3
#: Score of all documents where the labels teach no model.
NO_MODEL = 0.0
PIECE = 1 << 20
_BLANK = np.uint64(32)


def grams_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(word, gram) for each byte of each word and its end: the six bytes up to it as one number, blanks before a word."""
    sizes = ends - starts + 1
    total = np.concatenate(([0], np.cumsum(sizes)))
    word = 0
    while word < len(starts):
        to = max(word + 1, int(np.searchsorted(total, total[word] + PIECE, side="right")) - 1)
        whole = total[to] - total[word]
        for a in range(0, whole, PIECE):  # more than one piece only for one very long word
            n = min(PIECE, whole - a)
            if to == word + 1:
                owner, at = np.full(n, word), np.arange(a, a + n)
            else:
                owner = np.repeat(np.arange(word, to), sizes[word:to])
                at = np.arange(n) - np.repeat(total[word:to] - total[word], sizes[word:to])
            gram = np.zeros(n, dtype=np.uint64)
            start, size = starts[owner], sizes[owner] - 1
            for back in range(ORDER - 1, -1, -1):
                q = at - back
                inside = (q >= 0) & (q < size)
                byte = np.where(inside, data[np.where(inside, start + q, 0)].astype(np.uint64), _BLANK)
                gram = (gram << np.uint64(8)) | byte
            yield owner, gram
        word = to


def _distinct_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Folded bytes, starts and ends of distinct words, which of them each word is, and the words before each text."""
    data, at = text_bytes(texts)
    data = FOLD[data]
    starts, ends, first = word_spans(data, at, ALNUM_BYTES)
    _, sample, which = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
    return data, starts[sample], ends[sample], which.reshape(-1), first


def _gram_counts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, starts, ends, which, _ = _distinct_words(texts)
    times = np.bincount(which, minlength=len(starts))
    grams, counts = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    for owner, gram in grams_of(data, starts, ends) if len(starts) else ():
        keys, where = np.unique(gram, return_inverse=True)
        grams.append(keys)
        counts.append(np.bincount(where.reshape(-1), weights=times[owner], minlength=len(keys)).astype(np.int64))
    keys, where = np.unique(np.concatenate(grams), return_inverse=True)
    return keys, np.bincount(where.reshape(-1), weights=np.concatenate(counts), minlength=len(keys)).astype(np.int64)


def gram_counts(texts: DataFrame, text: str = "text") -> DataFrame:
    """(gram, n) of all words of all texts."""

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        grams, counts = _gram_counts(part.column(0))
        return pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64)), pa.array(counts)], ["gram", "n"])

    return map_batches(texts.select(F.col(text).alias("text")), run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def class_counts(sample: DataFrame, text: str = "text", label: str = "label") -> DataFrame:
    """(gram, toxic, ordinary): how often each gram occurs in the texts of either class."""

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        labels = part.column(1).to_numpy(zero_copy_only=False)
        columns = [[], [], []]
        for value in (0, 1):
            rows = np.flatnonzero(labels == value)
            grams, counts = _gram_counts(part.column(0).take(pa.array(rows)))
            columns[0].append(grams.view(np.int64))
            columns[1].append(counts * value)
            columns[2].append(counts * (1 - value))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in columns], ["gram", "toxic", "ordinary"])

    rows = map_batches(sample.select(F.col(text).alias("text"), F.col(label).alias("label")), run, "gram long, toxic long, ordinary long")
    return rows.groupBy("gram").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))


def _last(gram: Column, n: int) -> Column:
    """The last n bytes."""
    return gram.bitwiseAND(F.lit((1 << (8 * n)) - 1))


def shared_model(counts: DataFrame) -> DataFrame:
    """(gram, p): interpolated Kneser-Ney probability of the last byte of each gram. Below the highest order, a gram counts as often as bytes differ before it."""
    levels = {ORDER: counts}
    for n in range(ORDER - 1, 0, -1):
        levels[n] = written(levels[n + 1].groupBy(_last(F.col("gram"), n).alias("gram")).agg(F.count("*").alias("n")))
    below: DataFrame | None = None
    for n in range(1, ORDER + 1):
        context = Window.partitionBy(F.shiftright("gram", 8))  # at most 256 rows each
        level = levels[n].select("gram", "n", F.sum("n").over(context).alias("total"), F.count("*").over(context).alias("kinds"))
        if below is None:
            level = level.withColumn("below", F.lit(1 / 256))
        else:
            level = level.withColumn("lower", _last(F.col("gram"), n - 1)).join(below.select(F.col("gram").alias("lower"), F.col("p").alias("below")), "lower")
        below = level.select("gram", ((F.col("n") - DISCOUNT + DISCOUNT * F.col("kinds") * F.col("below")) / F.col("total")).alias("p"))
    return below


def weights(counts: DataFrame, shared: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(gram, weight) of grams that a class has seen and (context, weight) of the contexts, for all other last bytes."""
    context = Window.partitionBy(F.shiftright("gram", 8))
    seen = counts.join(shared, "gram", "left").withColumn("p", F.coalesce("p", F.lit(1 / 256)))
    free = {}
    for side in ("toxic", "ordinary"):
        seen = seen.withColumn(f"{side}_total", F.sum(side).over(context)).withColumn(f"{side}_kinds", F.sum((F.col(side) > 0).cast("int")).over(context))
        free[side] = F.when(F.col(f"{side}_total") > 0, DISCOUNT * F.col(f"{side}_kinds") / F.col(f"{side}_total")).otherwise(F.lit(1.0))
        own = F.when(F.col(f"{side}_total") > 0, F.greatest(F.col(side) - DISCOUNT, F.lit(0.0)) / F.col(f"{side}_total")).otherwise(F.lit(0.0))
        seen = seen.withColumn(f"{side}_p", own + free[side] * F.col("p"))
    seen = written(seen.select("gram", F.log(F.col("toxic_p") / F.col("ordinary_p")).alias("weight"), F.log(free["toxic"] / free["ordinary"]).alias("rest")))
    return seen.select("gram", "weight"), seen.select(F.shiftright("gram", 8).alias("gram"), F.col("rest").alias("weight")).distinct()


class Model:
    """Weights of grams and contexts, sorted by key."""

    def __init__(self, seen: DataFrame, contexts: DataFrame) -> None:
        self.tables = []
        for frame in (seen, contexts):
            table = frame.toArrow()  # bounded by the sample
            keys = table.column(0).to_numpy().astype(np.uint64)
            order = np.argsort(keys)
            self.tables.append((keys[order], table.column(1).to_numpy().astype(np.float32)[order]))

    def _looked_up(self, table: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        known, values = self.tables[table]
        if not len(known):
            return np.zeros(len(keys), dtype=bool), np.zeros(len(keys), dtype=np.float32)
        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        found = known[at] == keys
        return found, np.where(found, values[at], np.float32(0))

    def differences(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each text: log-likelihood as toxic less that as ordinary, the same of its outstanding words, and its bytes (one more for each word)."""
        data, starts, ends, which, first = _distinct_words(texts)
        per_word = np.zeros(len(starts))
        for owner, gram in grams_of(data, starts, ends) if len(starts) else ():
            keys, where = np.unique(gram, return_inverse=True)
            found, value = self._looked_up(0, keys)
            value = np.where(found, value, self._looked_up(1, keys >> np.uint64(8))[1])
            per_word += np.bincount(owner, weights=value[where.reshape(-1)], minlength=len(starts))
        outstanding = np.maximum(per_word - OUTSTANDING, 0)
        return tuple(_totals(x[which], first) for x in (per_word, outstanding, (ends - starts + 1).astype(float)))


def _totals(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    sums = np.concatenate(([0.0], np.cumsum(values)))
    return sums[first[1:]] - sums[first[:-1]]


def features(differences: np.ndarray, outstanding: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Both differences per byte; and per root of bytes, which says how sure these means are."""
    n = np.maximum(sizes, 1)
    return np.column_stack((differences / n, differences / np.sqrt(n), np.log1p(100 * outstanding / n), np.log1p(outstanding / np.sqrt(n))))


def scored(documents: DataFrame, labels: DataFrame, learn: Column | None = None, label: str = "toxic", doc_id: str = "doc_id", text: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """documents with toxicity (0 to 1). learn: a condition on doc_id; labels of other rows are never looked at."""
    spark = documents.sparkSession
    sample, totals = labelled_sample(labels, learn, label, sample_rows, doc_id)
    texts = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    rows = written(sampled_texts(documents, sample, doc_id, text))
    if not has_both_classes(rows):
        return documents.drop("toxicity").withColumn("toxicity", F.lit(NO_MODEL))
    shared = shared_model(written(gram_counts(texts)))
    model = spark.sparkContext.broadcast(Model(*weights(class_counts(rows.where("not calibrate")), shared)))

    def measured(found: pa.Array) -> dict[str, pa.Array]:
        return dict(zip(names, map(pa.array, model.value.differences(found)), strict=True))

    names = ["difference", "outstanding", "size"]
    taught = with_results(rows.where("calibrate").select("text", "label"), measured, "difference double, outstanding double, size double").select("label", *names).toArrow()
    calibration: Calibration = fit(features(*(taught.column(n).to_numpy() for n in names)), taught.column(0).to_numpy(), totals)

    def run(found: pa.Array) -> dict[str, pa.Array]:
        return {"toxicity": pa.array(calibration.probability(features(*model.value.differences(found))))}

    return with_results(documents, run, "toxicity double", text)


def summary(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    out = held_out_of("doc_id", 4, 2)
    found = scored(documents.select("doc_id", "text"), labels, ~out)
    return found.select("doc_id", F.coalesce(out, F.lit(False)).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= THRESHOLD).cast("int").alias("predicted"))


def without_toxic(documents: DataFrame, labels: DataFrame, learn: Column | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that op4 doesn't call toxic (score below the threshold); all their columns as they were."""
    names = documents.columns
    clash = {"toxicity": "toxicity of the input"} if "toxicity" in names else {}
    found = scored(documents.withColumnsRenamed(clash), labels, learn)
    return found.where(F.col("toxicity") < threshold).drop("toxicity").withColumnsRenamed({new: n for n, new in clash.items()}).select(*[f"`{n}`" for n in names])
