"""Language identification by rank-order profiles.

The profile of a language is the list of its most frequent n-grams of one to three letters, most frequent first, with
word ends counted as a letter; so is the profile of a document. The out-of-place distance sums, over the n-grams of the document, how far
apart their places are in both lists; an n-gram that the language's list lacks counts as far as can be. The
language with the least distance is predicted, the first by name among equals. The score is 1 less the distance as a part of the greatest possible.

Profiles come from all documents that may be learnt from, counted task by task and summed; whole texts count. Texts
are in lower case, everything but letters ends a word, and long texts are counted in chunks. Equal counts are
ordered by the code points of the n-gram, so results don't depend on the order of rows.

Null, empty and letterless texts are "und" with score 0; so is everything if nothing can be learnt. Rows with null lang,
null text or without letters teach nothing. A row without doc_id is not held out and teaches nothing. Repeated rows count as often as they occur.
Extra columns are left out. At most LANGUAGES languages are learnt, those with the most documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wellstream.llm.calibrate import held_out_of
from wellstream.llm.common import batches, map_batches, ship, written

UNDETERMINED = "und"
#: Length of the list of a language and of a document.
PROFILE = 1500
DOCUMENT_PROFILE = 400
#: Languages that are learnt; the profiles of so many are broadcast (24 bytes for each n-gram of each).
LANGUAGES = 500
#: Letters counted at a time.
CHUNK = 1 << 20
#: Distinct n-grams that a task of the count holds before it hands them on.
HELD = 1 << 20
_EDGE = 1
_BITS = np.int64(21)


@cache
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def _codes(text: str) -> np.ndarray:
    """Code points of the letters of a text in lower case; all else is an edge."""
    codes = np.frombuffer(text.lower().encode("utf-32-le"), dtype=np.uint32)
    return np.where(_letters()[codes], codes, _EDGE).astype(np.int64)


def _grams(codes: np.ndarray) -> np.ndarray:
    """All n-grams of up to three characters that end after the first two places; edges stand only at the ends of a word."""
    first, middle, last = codes[:-2], codes[1:-1], codes[2:]
    inner, end = middle != _EDGE, last != _EDGE
    pair = (middle << _BITS) | last
    return np.concatenate((((first << (_BITS + _BITS)) | pair)[inner], pair[inner | end], last[end]))


def _summed(grams: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    keys, of = np.unique(np.concatenate(grams), return_inverse=True)
    return keys, np.bincount(of, weights=np.concatenate(counts), minlength=len(keys)).astype(np.int64)


def counted(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of a text, ascending, and how often each occurs."""
    before = np.full(2, _EDGE, dtype=np.int64)
    found = []
    for at in range(0, len(text or ""), CHUNK):
        codes = np.concatenate((before, _codes(text[at : at + CHUNK]), before[:0] if at + CHUNK < len(text) else np.full(1, _EDGE)))
        found.append(np.unique(_grams(codes), return_counts=True))
        if len(found) > 8:
            found = [_summed(*zip(*found, strict=True))]
        before = codes[-2:]
    if not found:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    return found[0] if len(found) == 1 else _summed(*zip(*found, strict=True))


def ranked(grams: np.ndarray, counts: np.ndarray, most: int) -> np.ndarray:
    """The most frequent n-grams, most frequent first; equal counts by code points."""
    if len(grams) > most:
        kept = counts >= np.partition(counts, len(counts) - most)[len(counts) - most]
        grams, counts = grams[kept], counts[kept]
    return grams[np.argsort(-counts, kind="stable")[:most]]


def gram_counts(documents: DataFrame, lang: str = "lang", text: str = "text") -> DataFrame:
    """(lang, gram, n) of whole texts with a language."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for name, (grams, counts) in held.items():
                yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(name), len(grams)), pa.array(grams), pa.array(counts)], ["lang", "gram", "n"])
            held.clear()

        for whole in source:
            for batch in batches(whole, "text"):
                names = batch.column("lang").to_pylist()
                for name in dict.fromkeys(names):
                    texts = batch.column("text").filter(pa.array([n == name for n in names])).to_pylist()
                    new = counted("\n".join(texts))
                    held[name] = _summed(*zip(held[name], new, strict=True)) if name in held else new
                if sum(len(grams) for grams, _ in held.values()) > HELD:
                    yield from out()
        yield from out()

    rows = documents.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")).where("lang is not null and text is not null")
    ship(documents.sparkSession)
    return rows.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Profiles:
    """Lists of n-grams of some languages, as places by n-gram."""

    def __init__(self, names: list[str], langs: np.ndarray, grams: np.ndarray, places: np.ndarray, length: int):
        order = np.argsort(grams, kind="stable")
        self.names, self.length = names, length
        self.grams, self.first = np.unique(grams[order], return_index=True)
        self.end = np.append(self.first[1:], len(grams))
        self.langs, self.places = langs[order], places[order]

    def nearest(self, text: str | None) -> tuple[str, float]:
        """The language with the least out-of-place distance, and the score."""
        grams = ranked(*counted(text), DOCUMENT_PROFILE)
        if not len(grams) or not self.names:
            return UNDETERMINED, 0.0
        at = np.minimum(np.searchsorted(self.grams, grams), len(self.grams) - 1)
        own = np.flatnonzero(self.grams[at] == grams)
        at = at[own]
        size = self.end[at] - self.first[at]
        entry = np.repeat(self.first[at] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        apart = np.minimum(np.abs(self.places[entry] - np.repeat(own, size)), self.length)
        greatest = len(grams) * self.length
        distance = greatest + np.bincount(self.langs[entry], weights=apart - self.length, minlength=len(self.names))
        best = int(distance.argmin())
        return self.names[best], float(1 - distance[best] / greatest)


def profiles(documents: DataFrame, lang: str = "lang", text: str = "text", length: int = PROFILE, languages: int = LANGUAGES) -> Profiles:
    """Learnt from all documents with a language; at most length * languages n-grams come to the driver."""
    counts = written(gram_counts(documents, lang, text))
    totals = counts.groupBy("lang").agg(F.sum("n").alias("all")).orderBy(F.col("all").desc(), "lang").limit(languages)
    names = sorted(r.lang for r in totals.select("lang").collect())
    known = documents.sparkSession.createDataFrame([(name, i) for i, name in enumerate(names)], "lang string, number int")
    order = Window.partitionBy("lang").orderBy(F.col("n").desc(), "gram")
    first = counts.withColumn("place", F.row_number().over(order) - 1).where(F.col("place") < length).join(F.broadcast(known), "lang").select("number", "gram", "place").toArrow()
    return Profiles(names, *(first.column(c).to_numpy() for c in ("number", "gram", "place")), length)


def identified(documents: DataFrame, learnt: Profiles, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns to keep, lang_pred and score of every row."""
    shared = documents.sparkSession.sparkContext.broadcast(learnt)
    rows = documents.select(*keep, F.col(text).alias("text"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [shared.value.nearest(t.as_py()) for t in batch.column("text")]
        columns = [batch.column(c) for c in keep]
        return pa.RecordBatch.from_arrays([*columns, pa.array([n for n, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], [*keep, "lang_pred", "score"])

    kept = rows.select(*keep).schema
    return map_batches(rows, run, kept.add("lang_pred", "string").add("score", "double"))


def summary(documents: DataFrame) -> DataFrame:
    """The language of every document; learnt from those that aren't held out."""
    held_out = F.coalesce(held_out_of("doc_id", 3, 1), F.lit(False))
    learnt = profiles(documents.where(F.col("doc_id").isNotNull() & ~held_out))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), "text")
    return identified(rows, learnt, keep=("doc_id", "held_out"))
