"""Quality by compression with dictionaries of good and of bad text.

Two zstandard dictionaries are trained on labelled text. A text is compressed with each, in pieces, so that the
dictionaries and not the text's own beginning make the difference. The difference of the compressed sizes over their sum,
with how far the text compresses as a whole, is calibrated by logistic regression on labelled rows that the dictionaries
have not seen.

Labels are taken from at most SAMPLE_ROWS rows of each class, and a dictionary sees at most SAMPLE_BYTES of their text.
Rows without label or doc_id teach nothing. Null or empty text compresses to nothing: difference 0. If one class has no
rows, every score is 0.5 (no model). Extra columns are left alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wellstream.llm.calibrate import Calibration, fit, has_both_classes, held_out_of, labelled_sample, sampled_texts
from wellstream.llm.common import text_bytes, with_results, written

#: Labelled rows of each class that dictionaries and calibration learn from.
SAMPLE_ROWS = 4000
#: Text of a class that a dictionary is trained on, and the size of the dictionary.
SAMPLE_BYTES = 8 << 20
DICTIONARY_BYTES = 64 << 10
PIECE_BYTES = 2048
LEVEL = 3


class Dictionaries:
    """Compressors with the dictionary of bad (0) and of good text (1); made anew in each process."""

    def __init__(self, bad: list[bytes], good: list[bytes]) -> None:
        self.raw = [trained(x) for x in (bad, good)]
        self._made: list | None = None

    def __getstate__(self) -> dict:
        return {"raw": self.raw, "_made": None}

    def compressors(self) -> list:
        if self._made is None:
            options = {"write_content_size": False, "write_checksum": False, "write_dict_id": False}
            self._made = []
            for raw in self.raw:
                dictionary = zstandard.ZstdCompressionDict(raw)
                dictionary.precompute_compress(level=LEVEL)
                self._made.append(zstandard.ZstdCompressor(dict_data=dictionary, **options))
            self._made.append(zstandard.ZstdCompressor(level=LEVEL, **options))
        return self._made

    def features(self, texts: pa.Array) -> np.ndarray:
        """Of each text: difference over sum of the sizes with either dictionary, size in pieces and as a whole per byte."""
        bad, good, plain = self.compressors()
        data, at = text_bytes(texts)
        view = memoryview(data.tobytes())
        out = np.zeros((len(at) - 1, 4))
        for row in range(len(at) - 1):
            a, b = int(at[row]), int(at[row + 1])
            if a == b:
                continue
            with_bad = with_good = 0
            for p in range(a, b, PIECE_BYTES):
                piece = view[p : min(b, p + PIECE_BYTES)]
                with_bad += len(bad.compress(piece))
                with_good += len(good.compress(piece))
            n = b - a
            whole = len(plain.compress(view[a:b]))
            out[row] = (with_bad - with_good) / (with_bad + with_good), with_good / n, np.log(whole / n), np.log(whole / with_good)
        return out


def trained(samples: list[bytes]) -> bytes:
    """A dictionary of the samples; of too few samples, their plain text."""
    kept, size = [], 0
    for sample in samples:
        if size >= SAMPLE_BYTES:
            break
        kept += [sample[i : i + PIECE_BYTES] for i in range(0, len(sample), PIECE_BYTES)]
        size += len(sample)
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, kept).as_bytes()
    except zstandard.ZstdError:
        return b"".join(kept)[-DICTIONARY_BYTES:]


def scored(documents: DataFrame, labels: DataFrame, learn: Column | None = None, label: str = "quality", doc_id: str = "doc_id", text: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """documents with quality_score (0 to 1). learn: a condition on doc_id; labels of other rows are never looked at."""
    spark = documents.sparkSession
    sample, totals = labelled_sample(labels, learn, label, sample_rows, doc_id)
    rows = written(sampled_texts(documents, sample, doc_id, text))
    if not has_both_classes(rows):
        # no model: the share of good labels
        return documents.drop("quality_score").withColumn("quality_score", F.lit(totals[1] / max(1, sum(totals))))
    # whole texts in the order of their hash, until the bound is met; no more reaches the driver
    classes = []
    for value in (0, 1):
        own = rows.where(f"not calibrate and label = {value}").select(F.xxhash64("doc_id", "text").alias("order"), F.col("text"), F.octet_length("text").alias("bytes"))
        total = own.agg(F.sum("bytes")).first()[0] or 0
        if total > SAMPLE_BYTES:
            # hash below the share of rows that meets the bound
            own = own.where(F.col("order") < F.lit(int(-(2**63) + 2**64 * (SAMPLE_BYTES / total))))
        classes.append([r.text.encode() for r in own.orderBy("order").collect() if r.text])
    model = spark.sparkContext.broadcast(Dictionaries(*classes))

    def measured(found: pa.Array) -> dict[str, pa.Array]:
        values = model.value.features(found)
        return {"features": pa.FixedSizeListArray.from_arrays(pa.array(values.reshape(-1)), values.shape[1]).cast(pa.list_(pa.float64()))}

    taught = with_results(rows.where("calibrate").select("text", "label"), measured, "features array<double>").select("label", "features").toArrow()
    values = np.array(taught.column(1).to_pylist(), dtype=float).reshape(-1, 4)
    calibration: Calibration = fit(values, taught.column(0).to_numpy(), totals)

    def run(found: pa.Array) -> dict[str, pa.Array]:
        return {"quality_score": pa.array(calibration.probability(model.value.features(found)))}

    return with_results(documents, run, "quality_score double", text)


def summary(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    out = held_out_of("doc_id", 5, 0)
    found = scored(documents.select("doc_id", "text"), labels, ~out)
    return found.select("doc_id", F.coalesce(out, F.lit(False)).alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.3).cast("int").alias("predicted"))
