"""The processing chain as a micro-batch job on plain Parquet tables.

A batch becomes visible in all tables at once, by its commit (``ledger``). A batch that is replayed after a failure, with
the same input from the checkpointed source, writes the same rows again and replaces its earlier attempt.

A batch costs what its own keys need: state is read and rewritten in the buckets of its devices only, and of the stored
table it opens only files that may hold a late or repeated key, by a Bloom filter per bucket and batch (``key_index``).

There is no watermark: a reading is stored however late it is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamReader, StreamingQuery

from wellstream.operators import events, ingest, metrics, ordering, sessions, store
from wellstream.schemas import EVENT_SCHEMA, LATE_ARRIVAL, NATURAL_KEY, PUBLISHED, RAW_MESSAGE_SCHEMA, READING_SCHEMA, STREAM_KEY
from wellstream.session import configure
from wellstream.streaming import key_index
from wellstream.streaming.ledger import BUCKET, Attempt, Ledger, bucket_of

KAFKA_OFFSET_BITS = 44
STORED_OUTCOMES = [PUBLISHED, LATE_ARRIVAL]

PROCESSED_SCHEMA = T.StructType(READING_SCHEMA.fields + [
    T.StructField("store_status", T.StringType()),
    T.StructField("previous_sequence", T.LongType()),
    T.StructField("sequence_status", T.StringType()),
    T.StructField("gap_size", T.LongType()),
    T.StructField("outcome", T.StringType()),
    T.StructField(BUCKET, T.IntegerType()),
])
REJECT_SCHEMA = T.StructType([
    T.StructField("received_at_utc", T.TimestampType()),
    T.StructField("arrival_no", T.LongType()),
    T.StructField("value", T.StringType()),
    T.StructField("reject_reason", T.StringType()),
])
EVENTS_SCHEMA = T.StructType(EVENT_SCHEMA.fields + [
    T.StructField("arrival_no", T.LongType()), T.StructField("event_rank", T.IntegerType()),
])
CONFLICT_SCHEMA = T.StructType([
    T.StructField("device_id", T.StringType()),
    T.StructField("first_session", T.StringType()),
    T.StructField("second_session", T.StringType()),
    T.StructField("first_episode", T.LongType()),
    T.StructField("second_episode", T.LongType()),
    T.StructField("existing_session_id", T.StringType()),
    T.StructField("observed_session_id", T.StringType()),
    T.StructField("arrival_no", T.LongType()),
    T.StructField("received_at_utc", T.TimestampType()),
])
STREAMS_SCHEMA = T.StructType([
    T.StructField("device_id", T.StringType()),
    T.StructField("acquisition_session_id", T.StringType()),
    T.StructField("last_sequence", T.LongType()),
    T.StructField(BUCKET, T.IntegerType()),
])
ACTIVITY_SCHEMA = T.StructType([
    T.StructField("device_id", T.StringType()),
    T.StructField("session", T.StringType()),
    T.StructField("received_at_utc", T.TimestampType()),
    T.StructField("arrival_no", T.LongType()),
    T.StructField("episode", T.LongType()),
    T.StructField(BUCKET, T.IntegerType()),
])
REPORTED_SCHEMA = T.StructType(
    [f for f in CONFLICT_SCHEMA.fields if f.name in sessions.REPORT_KEY] + [T.StructField(BUCKET, T.IntegerType())])

METRICS_SCHEMA = T.StructType([
    T.StructField("kind", T.StringType()),
    T.StructField("acquisition_mode", T.StringType()),
    *[T.StructField(c, T.LongType()) for c in ("gap_size", "readings", "recorded", "sum_us", "minimum_us", "maximum_us")],
    T.StructField("sketch", T.BinaryType()),
])

TABLES = {
    "processed": PROCESSED_SCHEMA,
    "stored_index": key_index.INDEX_SCHEMA,
    "rejects": REJECT_SCHEMA,
    "events": EVENTS_SCHEMA,
    "conflicts": CONFLICT_SCHEMA,
    "metrics": METRICS_SCHEMA,
    "state_streams": STREAMS_SCHEMA,
    "state_activity": ACTIVITY_SCHEMA,
    "state_reported": REPORTED_SCHEMA,
}
STATE_TABLES = ("state_streams", "state_activity", "state_reported")
PARTITIONS = {"processed": (BUCKET, "outcome"), **{t: (BUCKET,) for t in STATE_TABLES}}
#: All tables are cut by device, so that one batch touches the same buckets of each.
DEVICE_BUCKET = ("device_id",)


class ReadingTables(Ledger):
    """The tables of one job under a shared root folder."""

    def __init__(self, spark: SparkSession, root: str):
        super().__init__(spark, root, TABLES, STATE_TABLES, PARTITIONS)

    def stored(self) -> DataFrame:
        """The readings table: whatever was the first of its natural key."""
        return self.read("processed").where(F.col("outcome").isin(STORED_OUTCOMES))

    def published(self) -> DataFrame:
        """Readings that advanced their stream."""
        return self.read("processed").where(F.col("outcome") == PUBLISHED)

    def gap_sizes(self) -> DataFrame:
        """M2 of all batches, from a few rows of each."""
        return metrics.merged_gap_sizes(self.read("metrics"))

    def latency(self) -> DataFrame:
        """M3 of all batches, from a few rows of each."""
        return metrics.merged_latency(self.read("metrics"))

    def stored_with(self, keys: DataFrame, before: int) -> DataFrame:
        """What the batches before this one stored in the buckets and batches that may hold one of the keys."""
        index = self.read("stored_index", ("batch_id", "attempt"), before)
        found = key_index.candidates(index, keys.withColumn(BUCKET, bucket_of(*DEVICE_BUCKET)), NATURAL_KEY)
        return self.folders("processed", found).where(F.col("outcome").isin(STORED_OUTCOMES))


def process_batch(tables: ReadingTables, messages: DataFrame, batch_id: int, window_seconds: int) -> None:
    """One micro-batch of messages. Later steps read what earlier ones wrote, so nothing is computed twice."""
    configure(messages.sparkSession)
    # Several steps read the parsed batch; what a lost executor held of it is parsed again from the source.
    validated = ingest.validate(ingest.parse_messages(messages)).persist()
    try:
        _process(tables, tables.attempt(batch_id), validated, window_seconds)
    finally:
        validated.unpersist()


def _bucketed(rows: DataFrame) -> DataFrame:
    return rows.withColumn(BUCKET, bucket_of(*DEVICE_BUCKET))


def _process(tables: ReadingTables, attempt: Attempt, validated: DataFrame, window_seconds: int) -> None:
    rejected = attempt.write("rejects", ingest.rejects(validated))
    readings = ingest.valid_readings(validated)
    touched = [r[0] for r in readings.select(bucket_of(*DEVICE_BUCKET)).distinct().collect()]  # as many as buckets at most

    last = attempt.state("state_streams", touched)
    ordered = ordering.classify_sequence(readings, last_sequences=last)
    if last is None:
        statused = ordering.classify_copies(ordered, readings)
    else:
        # Above the last sequence of its stream nothing can have been stored before this batch.
        not_ahead = readings.join(last, STREAM_KEY).where(F.col("sequence_number") <= F.col("last_sequence")).select(*NATURAL_KEY)
        before = tables.stored_with(not_ahead, attempt.commit_id.batch_id)
        statused = store.classify_against(before, ordered, readings, not_ahead)
    processed = attempt.write("processed", _bucketed(ordering.judged(readings, statused)))
    stored = processed.where(F.col("outcome").isin(STORED_OUTCOMES))
    attempt.write("stored_index", key_index.build(stored, NATURAL_KEY))
    attempt.write_state("state_streams", _bucketed(ordering.last_sequences(stored, None if last is None else last.drop(BUCKET))), touched)

    activity, reported = attempt.state("state_activity", touched), attempt.state("state_reported", touched)
    conflicts = attempt.write("conflicts", sessions.keyed_conflicts(stored, window_seconds, activity, reported))
    current = attempt.write_state("state_activity", _bucketed(sessions.latest_activity(stored, window_seconds, activity)), touched)
    keys = conflicts.select(*sessions.REPORT_KEY)
    if reported is not None:
        keys = keys.unionByName(reported.select(*sessions.REPORT_KEY))
    attempt.write_state("state_reported", _bucketed(_still_current(keys, current)), touched)
    attempt.write("metrics", metrics.metric_states(processed.where(F.col("outcome") == PUBLISHED)))
    attempt.write("events", events.event_stream(processed, rejected, conflicts))
    attempt.commit()


def _still_current(reported: DataFrame, activity: DataFrame) -> DataFrame:
    """Reports that can still suppress another one: both sessions are in the episode that was reported."""
    for side in ("first", "second"):
        now = activity.select(
            "device_id", F.col("session").alias(f"{side}_session"), F.col("episode").alias(f"{side}_episode")
        )
        reported = reported.join(now, ["device_id", f"{side}_session", f"{side}_episode"], "left_semi")
    return reported.select(*sessions.REPORT_KEY)


def read_messages(spark: SparkSession, source: str, path: str, max_files_per_trigger: int = 1000) -> DataFrame:
    """A folder of message files as a stream. The rate limit bounds the rows of one batch."""
    reader: DataStreamReader = spark.readStream.schema(RAW_MESSAGE_SCHEMA)
    return reader.option("maxFilesPerTrigger", max_files_per_trigger).format(source).load(path)


def read_kafka_messages(spark: SparkSession, servers: str, topic: str, max_offsets_per_trigger: int) -> DataFrame:
    """S1 from Kafka: one partition per topic partition; needs the Kafka connector on the class path.

    Messages must be keyed by device, so that a stream stays in one topic partition. Offsets are unique
    within a partition; the partition number goes into the high bits, which keeps the numbers of a stream
    dense.
    """
    raw = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("maxOffsetsPerTrigger", max_offsets_per_trigger)
        .load()
    )
    return raw.select(
        (F.shiftleft(F.col("partition").cast("bigint"), KAFKA_OFFSET_BITS) + F.col("offset")).alias("arrival_no"),
        F.col("timestamp").alias("received_at_utc"),
        F.col("value").cast("string").alias("value"),
    )


def start(
    messages: DataFrame,
    root: str,
    checkpoint: str,
    window_seconds: int = sessions.DEFAULT_WINDOW_SECONDS,
    trigger: dict[str, object] | None = None,
    retained: int | None = None,
) -> StreamingQuery:
    """Process what is available, then stop, or go on for ever with a ``trigger`` like {"processingTime": "10 seconds"}.

    A restart continues after the last batch. State is kept for ``retained`` batches, by default as many as
    the checkpoint of the query retains.
    """
    if retained is None:
        retained = int(messages.sparkSession.conf.get("spark.sql.streaming.minBatchesToRetain", "100"))

    def run(batch: DataFrame, batch_id: int) -> None:
        tables = ReadingTables(batch.sparkSession, root)
        process_batch(tables, batch, batch_id, window_seconds)
        tables.expire(batch_id, retained)

    return (
        messages.writeStream.foreachBatch(run)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
