"""Helpers shared by the text operators: words and their hashes in NumPy, Arrow batches of bounded size, shared storage."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: Text that one call of a NumPy kernel works on; a longer document is a batch of its own.
BATCH_BYTES = 4 << 20
#: Bytes hashed at a time.
CHUNK_BYTES = 1 << 20

_BYTES = np.arange(256)
FOLD = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
#: Bytes of words once A-Z is folded. In UTF-8 all bytes of other characters are 0x80 or more.
ALNUM_BYTES = ((_BYTES >= 48) & (_BYTES <= 57)) | ((_BYTES >= 97) & (_BYTES <= 122)) | (_BYTES >= 128)
NONBLANK_BYTES = ~((_BYTES == 32) | ((_BYTES >= 9) & (_BYTES <= 13)))

_ODD = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD1342543DE82EF95
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


BYTE_CODES = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _ODD)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(CHUNK_BYTES.bit_length() - 1, (n - 1).bit_length())
    if size not in _powers:
        tables = []
        for base in (_BASE, _BASE_INVERSE):
            t = np.full(size, base, dtype=np.uint64)
            t[0] = 1
            tables.append(np.multiply.accumulate(t))
        if size > CHUNK_BYTES:
            return tables[0], tables[1]
        _powers[size] = (tables[0], tables[1])
    return _powers[size]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span; spans are in ascending order and don't overlap."""
    out = np.empty(len(starts), dtype=np.uint64)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + CHUNK_BYTES, side="right")))
        first, last = int(starts[at]), int(ends[to - 1])
        power, inverse = _power_tables(last - first)
        sums = np.empty(last - first + 1, dtype=np.uint64)
        sums[0] = 0
        np.cumsum(BYTE_CODES[data[first:last]] * power[: last - first], out=sums[1:])
        s, e = starts[at:to] - first, ends[at:to] - first
        out[at:to] = mix((sums[e] - sums[s]) * inverse[s] + (e - s).astype(np.uint64) * _ODD)
        at = to
    return out


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, and where each begins (one more entry than texts); null is empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, dtype=np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def word_spans(data: np.ndarray, at: np.ndarray, word_bytes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of words, and the number of words before each text (one more entry than texts)."""
    inside = np.zeros(len(data) + 1, dtype=bool)
    inside[:-1] = word_bytes[data]
    cut = np.zeros(len(data) + 1, dtype=bool)
    cut[at] = True
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | cut))
    ends = np.flatnonzero(before & (~inside | cut))
    return starts, ends, np.searchsorted(starts, at)


def words_of(texts: pa.Array, word_bytes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word with A-Z folded, and the number of words before each text (one more entry than texts)."""
    data, at = text_bytes(texts)
    data = FOLD[data]
    starts, ends, first = word_spans(data, at, word_bytes)
    return span_hashes(data, starts, ends), first


def shingles_of(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of k words within a text, a shorter text being one run; and the runs before each text."""
    counts = np.diff(first)
    runs = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    before = np.concatenate(([0], np.cumsum(runs)))
    at = np.repeat(first[:-1] - before[:-1], runs) + np.arange(before[-1])
    size = np.repeat(np.minimum(counts, k), runs)
    out = mix(size.astype(np.uint64) * _ODD)
    padded = np.concatenate((words, np.zeros(k, dtype=np.uint64)))
    short = size < k
    for j in range(k):
        step = mix(out + padded[at + j])
        out = np.where(short & (j >= size), out, step) if short.any() else step
    return out, before


def batches(batch: pa.RecordBatch, column: str, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices with at most so many bytes of text, or a single row."""
    if not batch.num_rows:
        return
    column_at = batch.schema.get_field_index(column)
    _, at = text_bytes(batch.column(column_at))
    row = 0
    while row < batch.num_rows:
        to = max(row + 1, int(np.searchsorted(at, at[row] + limit, side="right")) - 1)
        yield batch.slice(row, to - row)
        row = to


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors' Python, once per application; they need not have it installed."""
    context = spark.sparkContext
    if not getattr(context, "_wellstream_shipped", False):
        package = Path(__file__).resolve().parents[1]
        target = Path(tempfile.mkdtemp(prefix="wellstream-")) / f"{package.name}.zip"
        with zipfile.ZipFile(target, "w") as archive:
            for file in sorted(package.rglob("*.py")):
                archive.write(file, file.relative_to(package.parent))
        context.addPyFile(str(target))
        context._wellstream_shipped = True


def map_batches(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str | T.StructType, text: str = "text", limit: int = BATCH_BYTES) -> DataFrame:
    """f over slices of bounded text; rows stay where they are."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for part in batches(batch, text, limit):
                out = f(part)
                if out.num_rows:
                    yield out

    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def with_results(df: DataFrame, f: Callable[[pa.Array], dict[str, pa.Array]], results: str, text: str = "text") -> DataFrame:
    """df with the columns that f derives from its text; they replace columns of the same names."""
    added = T._parse_datatype_string(results)
    kept = df.drop(*added.fieldNames())
    names = kept.columns
    if len({*names}) < len(names) or text not in names:
        raise ValueError(f"one column {text} and no repeated names are needed, got {names}")
    position = names.index(text)
    plain = kept.toDF(*(f"c{i}" for i in range(len(names))))  # a name with a dot can't go to Python

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        found = f(part.column(position))
        return pa.RecordBatch.from_arrays([*part.columns, *found.values()], [*part.schema.names, *found])

    return map_batches(plain, run, T.StructType([*plain.schema.fields, *added.fields]), f"c{position}").toDF(*names, *added.fieldNames())


def packed(df: DataFrame) -> DataFrame:
    """df with all its columns in one struct, row, so that no name of theirs meets a name of ours."""
    return df.select(F.struct(*[F.col(f"`{n}`") for n in df.columns]).alias("row"))


def unpacked(df: DataFrame, *added: str) -> DataFrame:
    """The columns of the struct row, and columns that are added; these replace columns of the same names."""
    names = [n for n in df.schema["row"].dataType.fieldNames() if n not in added]
    return df.select(*[F.col(f"row.`{n}`").alias(n) for n in names], *added)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where it is unset, as in tests, one of our own on a local master."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = held.get() if held.isDefined() else None
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="wellstream-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: what it took to make it is not run again, and a lost executor loses nothing."""
    path = f"{shared_folder(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """df through a reliable checkpoint, for small tables of iterations."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def folded(column: str):
    """Text with A-Z in lower case; null is empty."""
    return F.translate(F.coalesce(F.col(column), F.lit("")), UPPER, LOWER)
