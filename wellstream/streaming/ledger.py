"""Tables of micro-batches that become visible together, and state that is rewritten bucket by bucket.

Every table of a batch is written to a folder ``<table>/batch_id=N/attempt=K`` of its own. The last step writes one commit
file, ``_commits/N.K.json``, under another name first and renamed then. Readers list the commits and read the folders these
name, so they see all of a batch or nothing of it, however far a failed attempt came; a replay writes a new attempt and
replaces the old one by its commit.

State tables are cut into buckets by a hash of their key. A commit holds, for each bucket, where its rows lie. A batch
reads and rewrites the buckets of its own keys only; the other pointers are copied.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

COMMITS = "_commits"
BUCKET = "bucket"
#: Buckets of a table. More of them let a batch touch a smaller part of the state; each may be a file of each batch.
BUCKETS = 32


def bucket_of(*columns: str, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(buckets)).cast("int")


class Files:
    """The few file operations that Spark's readers and writers don't have, on any file system that Hadoop knows."""

    def __init__(self, spark: SparkSession, root: str):
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self._fs = self._path(root).getFileSystem(self._conf)

    def _path(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def names(self, folder: str) -> list[str]:
        path = self._path(folder)
        return [s.getPath().getName() for s in self._fs.listStatus(path)] if self._fs.exists(path) else []

    def read(self, path: str) -> str:
        stream = self._fs.open(self._path(path))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def publish(self, path: str, text: str) -> None:
        """The file appears with all of its contents."""
        folder, _, name = path.rpartition("/")
        draft = self._path(f"{folder}/.{name}.{uuid.uuid4().hex}")
        stream = self._fs.create(draft, True)
        try:
            stream.write(bytearray(text, "utf-8"))
        finally:
            stream.close()
        if not self._fs.rename(draft, self._path(path)):
            raise OSError(f"{path} can't be published")

    def delete(self, path: str) -> None:
        self._fs.delete(self._path(path), True)


@dataclass(frozen=True, order=True)
class Commit:
    batch_id: int
    attempt: int

    @property
    def folder(self) -> str:
        return f"batch_id={self.batch_id}/attempt={self.attempt}"

    @property
    def file(self) -> str:
        return f"{self.batch_id:012d}.{self.attempt:06d}.json"


@dataclass(frozen=True)
class Ledger:
    """The tables of one job under a shared root folder. Schemas name the columns that files hold."""

    spark: SparkSession
    root: str
    schemas: dict[str, T.StructType]
    state_tables: tuple[str, ...] = ()
    partitions: dict[str, tuple[str, ...]] = field(default_factory=dict)

    @property
    def files(self) -> Files:
        return Files(self.spark, self.root)

    def commits(self, before: int | None = None) -> list[Commit]:
        """The valid attempt of each batch, in order; ``before`` leaves out this batch and later ones."""
        newest: dict[int, Commit] = {}
        for name in sorted(self.files.names(f"{self.root}/{COMMITS}")):
            if name.endswith(".json") and not name.startswith("."):
                batch, attempt, _ = name.split(".")
                newest[int(batch)] = Commit(int(batch), int(attempt))
        return [c for b, c in sorted(newest.items()) if before is None or b < before]

    def pointers(self, commit: Commit | None) -> dict[str, dict[str, str]]:
        """Where the buckets of each state table lie as of a commit."""
        if commit is None:
            return {table: {} for table in self.state_tables}
        return json.loads(self.files.read(f"{self.root}/{COMMITS}/{commit.file}"))["state"]

    def _scan(self, table: str, folders: list[str], columns: list[str]) -> DataFrame:
        schema = self.schemas[table]
        known = T.StructType([*schema.fields, T.StructField("batch_id", T.LongType()), T.StructField("attempt", T.IntegerType())])
        if not folders:
            return self.spark.createDataFrame([], known).select(*schema.fieldNames(), *columns)
        base = f"{self.root}/{table}"
        rows = self.spark.read.schema(known).option("basePath", base).parquet(*(f"{base}/{f}" for f in folders))
        return rows.select(*schema.fieldNames(), *columns)

    def read(self, table: str, columns: tuple[str, ...] = ("batch_id",), before: int | None = None) -> DataFrame:
        """The committed rows of a table; of a state table, its rows as of the last commit."""
        commits = self.commits(before)
        if table in self.state_tables:
            return self.state(table, commits[-1] if commits else None).select(*self.schemas[table].fieldNames())
        return self._scan(table, [c.folder for c in commits], [*columns])

    def folders(self, table: str, folders: list[str]) -> DataFrame:
        """Rows of some folders below a table."""
        return self._scan(table, folders, ["batch_id"])

    def state(self, table: str, commit: Commit | None, buckets: list[int] | None = None) -> DataFrame:
        """A state table as of a commit, or these buckets of it."""
        found = self.pointers(commit).get(table, {})
        wanted = sorted(found) if buckets is None else [str(b) for b in buckets if str(b) in found]
        return self._scan(table, [found[b] for b in wanted], [])

    def attempt(self, batch_id: int) -> Attempt:
        before = self.commits(batch_id)
        made = [n for n in self.files.names(f"{self.root}/{COMMITS}") if n.startswith(f"{batch_id:012d}.")]
        previous = before[-1] if before else None
        return Attempt(self, Commit(batch_id, len(made)), previous, self.pointers(previous))

    def expire(self, batch_id: int, retained: int) -> None:
        """Delete state that no replay can ask for any more: what the commit after the oldest one kept doesn't point to."""
        commits = [c for c in self.commits() if c.batch_id <= batch_id - retained]
        if len(commits) < 2:
            return
        old, kept = (self.pointers(c) for c in commits[-2:])
        files = self.files
        for table in self.state_tables:
            for bucket, path in old.get(table, {}).items():
                if kept.get(table, {}).get(bucket) != path:
                    files.delete(f"{self.root}/{table}/{path}")


@dataclass
class Attempt:
    """One try at a batch. Nothing of it counts before ``commit``."""

    ledger: Ledger
    commit_id: Commit
    previous: Commit | None
    pointers: dict[str, dict[str, str]]

    def _path(self, table: str) -> str:
        return f"{self.ledger.root}/{table}/{self.commit_id.folder}"

    def write(self, table: str, rows: DataFrame) -> DataFrame:
        """Replaces what an earlier failure left of this attempt; returns the rows as the files hold them."""
        partitions = self.ledger.partitions.get(table, ())
        rows = rows.select(*self.ledger.schemas[table].fieldNames())
        if BUCKET in partitions:
            rows = rows.hint("rebalance", BUCKET)  # whole buckets, large ones in parts
        writer = rows.write.mode("overwrite")
        (writer.partitionBy(*partitions) if partitions else writer).parquet(self._path(table))
        return self.rows(table)

    def rows(self, table: str) -> DataFrame:
        return self.ledger.folders(table, [self.commit_id.folder])

    def state(self, table: str, buckets: list[int]) -> DataFrame | None:
        """These buckets as the batch before left them; None if there is nothing."""
        known = self.pointers.get(table, {})
        return self.ledger.state(table, self.previous, buckets) if any(str(b) in known for b in buckets) else None

    def write_state(self, table: str, rows: DataFrame, buckets: list[int]) -> DataFrame:
        """All rows of these buckets anew; the other buckets stay where they are."""
        written = self.write(table, rows)
        present = {n.partition("=")[2] for n in self.ledger.files.names(self._path(table)) if n.startswith(f"{BUCKET}=")}
        kept = {b: path for b, path in self.pointers.get(table, {}).items() if int(b) not in buckets}
        self.pointers[table] = kept | {b: f"{self.commit_id.folder}/{BUCKET}={b}" for b in sorted(present)}
        return written

    def commit(self) -> None:
        self.ledger.files.publish(f"{self.ledger.root}/{COMMITS}/{self.commit_id.file}", json.dumps({"state": self.pointers}))
