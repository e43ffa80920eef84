"""Upgrade a folder whose files were written by different versions of the readings table.

The files are read as a stream of files with the current columns: a column that a file doesn't have is null, so one scan
serves all versions and the steps of the upgrade fill what is missing. The checkpoint remembers which files were read; a
rerun opens new files only, whatever their version. All rows of a batch of files become visible by one commit, those that
break a rule among them under their reason.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from wellstream.operators import backfill, ingest
from wellstream.schemas import READING_SCHEMA
from wellstream.session import configure
from wellstream.streaming.ledger import Ledger

KEPT = "kept"
UPGRADED_SCHEMA = T.StructType([
    *READING_SCHEMA.fields,
    T.StructField("reject_reason", T.StringType()),
    T.StructField("source_file", T.StringType()),
    T.StructField("row_version", T.IntegerType()),
    T.StructField(KEPT, T.BooleanType()),
])
FILES_SCHEMA = T.StructType([
    T.StructField("source_file", T.StringType()),
    T.StructField("from_version", T.IntegerType()),
    T.StructField("rows", T.LongType()),
    T.StructField("rejected", T.LongType()),
])


class UpgradedTables(Ledger):
    """What was read from a mixed folder so far, in the current version."""

    def __init__(self, spark: SparkSession, root: str):
        super().__init__(
            spark, root, {"upgraded": UPGRADED_SCHEMA, "files": FILES_SCHEMA}, partitions={"upgraded": (KEPT,)})

    def readings(self) -> DataFrame:
        """Rows that keep all rules, with the content column."""
        return backfill.with_payload(self.read("upgraded").where(F.col(KEPT)).select(*READING_SCHEMA.fieldNames()))

    def rejects(self) -> DataFrame:
        """The other rows, upgraded as far as they go."""
        return self.read("upgraded").where(~F.col(KEPT)).drop(KEPT, "row_version", "batch_id")

    def upgraded_files(self) -> DataFrame:
        """One row for each file: its version, rows and rejected rows. An empty file has none."""
        return self.read("files").drop("batch_id")


def read_mixed(spark: SparkSession, folder: str, max_files_per_trigger: int = 1000) -> DataFrame:
    """All files below a folder, of any version, as a stream; the rate limit bounds the rows of one batch."""
    return (
        spark.readStream.schema(READING_SCHEMA)
        .option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", max_files_per_trigger)
        .parquet(folder)
        .select("*", F.col("_metadata.file_path").alias("source_file"))
    )


def upgrade_batch(tables: UpgradedTables, rows: DataFrame, batch_id: int) -> None:
    """Rows with ``source_file``; they are read once, the list of files is taken from what was written."""
    configure(rows.sparkSession)
    attempt = tables.attempt(batch_id)
    versioned = rows.withColumn("row_version", backfill.row_version())
    current = ingest.validate(backfill.fill(versioned)).withColumn(KEPT, F.col("reject_reason").isNull())
    written = attempt.write("upgraded", current)
    attempt.write("files", written.groupBy("source_file").agg(
        F.max("row_version").alias("from_version"),
        F.count(F.lit(1)).alias("rows"),
        F.count_if(~F.col(KEPT)).alias("rejected"),
    ))
    attempt.commit()


def start(files: DataFrame, root: str, checkpoint: str) -> StreamingQuery:
    """Upgrade the files that no earlier run has read, then stop."""

    def run(batch: DataFrame, batch_id: int) -> None:
        upgrade_batch(UpgradedTables(batch.sparkSession, root), batch, batch_id)

    return (
        files.writeStream.foreachBatch(run)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
