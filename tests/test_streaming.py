import json
import os
import tempfile
from datetime import timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tests.helpers import A, B, T0, frame, model, model_conflicts, random_trace, reading
from wellstream.operators import events, ingest, metrics, ordering, sessions
from wellstream.schemas import READING_COLUMNS, READING_FIELDS, READING_SCHEMA
from wellstream.streaming import key_index, ledger, microbatch, series, stateful, views

WINDOW = 30
PARTS = 3


def folder(name):
    return tempfile.mkdtemp(prefix=f"wellstream-{name}-")


@pytest.fixture(scope="module")
def trace():
    return random_trace(11, 240, devices=2, sessions=3, hot=0.4)


@pytest.fixture(scope="module")
def message_files(spark, trace):
    """The trace as JSON messages in several files in arrival order, some messages broken."""
    path = folder("messages")
    members = [m for m, _, _ in READING_FIELDS]
    rows = []
    for r in trace:
        doc = dict(zip(members, r[:15], strict=True))
        doc["TimestampUtc"] = r[13].isoformat() + "Z"
        text = json.dumps(doc)
        rows.append((r[16], r[15], text))
    rows += [(10_000 + i, trace[i * 50][15], "{broken") for i in range(4)]
    rows.sort(key=lambda r: (r[1], r[0]))
    for part in range(PARTS):
        chunk = rows[part * len(rows) // PARTS:(part + 1) * len(rows) // PARTS]
        spark.createDataFrame(chunk, "arrival_no long, received_at_utc timestamp, value string").coalesce(1).write.mode(
            "append").parquet(path)
    return path


def feed(spark, path, root, checkpoint):
    messages = microbatch.read_messages(spark, "parquet", path, max_files_per_trigger=1)
    query = microbatch.start(messages, root, checkpoint, WINDOW)
    query.awaitTermination()
    assert query.exception() is None
    return query


@pytest.fixture(scope="module")
def tables(spark, message_files):
    root, checkpoint = folder("tables"), folder("checkpoint")
    feed(spark, message_files, root, checkpoint)
    return microbatch.ReadingTables(spark, root)


def batch_result(spark, message_files):
    messages = spark.read.schema(microbatch.RAW_MESSAGE_SCHEMA).parquet(message_files)
    validated = ingest.validate(ingest.parse_messages(messages))
    readings = ingest.valid_readings(validated)
    return readings, ingest.rejects(validated), ordering.process(readings)


def rows_of(df, *columns):
    return sorted(tuple(str(v) for v in r) for r in df.select(*columns).collect())


PROCESSED = [*READING_COLUMNS, "arrival_no", "store_status", "previous_sequence", "sequence_status", "gap_size", "outcome"]


def test_micro_batches_give_the_batch_result(spark, tables, message_files, trace):
    readings, rejected, processed = batch_result(spark, message_files)
    assert tables.read("processed").select("batch_id").distinct().count() == PARTS
    assert rows_of(tables.read("processed"), *PROCESSED) == rows_of(processed, *PROCESSED)
    assert {r.arrival_no: r.outcome for r in processed.collect()} == {n: o[4] for n, o in model(trace).items()}
    assert tables.read("rejects").count() == 4
    conflicts = sessions.session_conflicts(ordering.first_arrivals(readings), WINDOW)
    columns = ["device_id", "existing_session_id", "observed_session_id", "arrival_no"]
    assert rows_of(tables.read("conflicts"), *columns) == rows_of(conflicts, *columns)
    stored = [r for r in trace if model(trace)[r[16]][0] == "Stored"]
    assert conflicts.count() == len(model_conflicts(stored, WINDOW)) > 0
    stream = events.event_stream(processed, rejected, conflicts)
    assert rows_of(tables.read("events"), *stream.columns) == rows_of(stream, *stream.columns)


def test_metrics_of_all_batches_are_merged(tables):
    published = tables.published()
    assert rows_of(tables.gap_sizes(), "gap_size", "gaps") == rows_of(metrics.gap_size_distribution(published), "gap_size", "gaps")
    found, exact = ({r.acquisition_mode: r for r in x.collect()} for x in (tables.latency(), metrics.latency_summary(published)))
    assert found.keys() == exact.keys()
    for mode, r in found.items():
        assert tuple(r)[:6] == tuple(exact[mode])[:6]
        us = sorted(x[0] for x in published.where(F.col("acquisition_mode") == mode).select(metrics.latency_micros()).collect() if x[0] is not None)
        for value, rank in ((r.median_ms, 0.5), (r.p95_ms, 0.95)):
            assert abs(sum(x <= value * 1000 for x in us) / len(us) - rank) <= metrics.RANK_ERROR + 1 / len(us) or us.count(value * 1000) > 1


def test_replayed_batch_writes_the_same_rows(spark, tables, message_files):
    before = {t: rows_of(tables.read(t), *tables.read(t).columns) for t in microbatch.TABLES}
    batch = 1
    numbers = [r[0] for t in ("processed", "rejects") for r in tables.read(t).where(f"batch_id = {batch}").select("arrival_no").collect()]
    messages = spark.read.parquet(message_files).where(F.col("arrival_no").isin(numbers))
    microbatch.process_batch(tables, messages, batch, WINDOW)
    assert {t: rows_of(tables.read(t), *tables.read(t).columns) for t in microbatch.TABLES} == before
    assert [(c.batch_id, c.attempt) for c in tables.commits()] == [(0, 0), (1, 1), (2, 0)]


def batches(spark, tables):
    """The messages of each batch of a finished job."""
    numbers = {n: [r[0] for t in ("processed", "rejects") for r in tables.read(t).where(f"batch_id = {n}").select("arrival_no").collect()] for n in range(PARTS)}
    return lambda messages, n: messages.where(F.col("arrival_no").isin(numbers[n]))


def failing_after(monkeypatch, writes):
    """Attempts that fail when so many tables are written."""
    write, done = ledger.Attempt.write, []

    def counted(self, table, rows):
        if len(done) == writes:
            raise OSError("lost")
        done.append(table)
        return write(self, table, rows)

    monkeypatch.setattr(ledger.Attempt, "write", counted)


def test_readers_never_see_a_part_of_a_batch(spark, monkeypatch):
    """A batch fails between any two of its writes, before its commit and while the commit is written, and is tried again."""
    schema = T.StructType([T.StructField("v", T.LongType()), T.StructField("bucket", T.IntegerType())])
    job = ledger.Ledger(spark, folder("torn"), dict.fromkeys(("a", "b", "s"), schema), ("s",), {"s": ("bucket",)})

    def run(batch, fails_at=None):
        attempt = job.attempt(batch)
        with monkeypatch.context() as m:
            if fails_at is not None:
                failing_after(m, fails_at)
            if fails_at == 4:
                m.setattr(ledger.Files, "publish", lambda *_: (_ for _ in ()).throw(OSError("lost")))
            rows = spark.createDataFrame([(batch * 10, 1), (batch * 10 + 1, batch)], schema)
            attempt.write("a", rows)
            attempt.write("b", rows)
            attempt.write_state("s", rows, [1, batch])
            if fails_at == 3:
                raise OSError("lost")
            attempt.commit()

    def contents():
        return {t: rows_of(job.read(t), "v", "bucket") for t in ("a", "b", "s")}

    run(0)
    first = contents()
    for fails_at in (0, 1, 2, 3, 4):
        with pytest.raises(OSError):
            run(1, fails_at)
        assert contents() == first
    run(1)
    second = contents()
    assert second["a"] == second["b"] == [("0", "1"), ("1", "0"), ("10", "1"), ("11", "1")] and second["s"] == [("1", "0"), ("10", "1"), ("11", "1")]
    run(1)
    assert contents() == second and job.commits() == [ledger.Commit(0, 0), ledger.Commit(1, 1)]


def test_a_batch_that_failed_late_is_tried_again(spark, tables, message_files, monkeypatch):
    messages, of = spark.read.parquet(message_files), batches(spark, tables)
    torn = microbatch.ReadingTables(spark, folder("torn"))
    microbatch.process_batch(torn, of(messages, 0), 0, WINDOW)
    with monkeypatch.context() as m:
        failing_after(m, len(microbatch.TABLES) - 1)
        with pytest.raises(OSError):
            microbatch.process_batch(torn, of(messages, 1), 1, WINDOW)
    assert torn.read("processed").select("batch_id").distinct().count() == 1
    microbatch.process_batch(torn, of(messages, 1), 1, WINDOW)
    for t in ("processed", "conflicts", "events"):
        assert rows_of(torn.read(t), *torn.read(t).columns) == rows_of(tables.read(t).where("batch_id < 2"), *torn.read(t).columns)


def scanned(df):
    """Files that a plan reads."""
    return {f.split("/processed/", 1)[1].rsplit("/", 1)[0] for f in df.inputFiles()}


def test_a_lookup_opens_buckets_and_batches_of_its_keys(spark, tables, trace):
    rows = tables.stored().select("device_id", "acquisition_session_id", "sequence_number", "batch_id", "outcome").collect()
    for n in range(PARTS):
        one = next(r for r in rows if r.batch_id == n)
        keys = spark.createDataFrame([one[:3]], "device_id string, acquisition_session_id string, sequence_number long")
        found = tables.stored_with(keys, PARTS)
        assert found.join(keys, keys.columns, "left_semi").count() == 1
        buckets = {f.split("/")[2] for f in scanned(found)}
        assert len(buckets) == 1
        # a filter may err on a batch now and then, but it doesn't name all of them
        assert len({f.split("/")[0] for f in scanned(found)}) < PARTS
    absent = spark.createDataFrame([("nobody", "s", 1)], "device_id string, acquisition_session_id string, sequence_number long")
    assert tables.stored_with(absent, PARTS).count() == 0


def test_many_keys_are_looked_up_without_filters(spark, tables, monkeypatch):
    monkeypatch.setattr(key_index, "PROBES", 1)
    keys = tables.stored().where("batch_id < 2").select("device_id", "acquisition_session_id", "sequence_number")
    assert tables.stored_with(keys, PARTS).join(keys, keys.columns, "left_semi").count() == keys.count()


def test_state_of_other_devices_is_left_where_it_is(spark):
    job = microbatch.ReadingTables(spark, folder("buckets"))
    def messages(device, sequence, at):
        row = reading(device, A, sequence, at, at)
        text = json.dumps(dict(zip([m for m, _, _ in READING_FIELDS], row[:13], strict=False)) | {"TimestampUtc": row[13].isoformat() + "Z", "AcquisitionMode": "RealTime"})
        return (row[16], row[15], text)
    for n, rows in enumerate([[messages(f"D{i}", 1, i + 1) for i in range(40)], [messages("D7", 3, 100)]]):
        microbatch.process_batch(job, spark.createDataFrame(rows, microbatch.RAW_MESSAGE_SCHEMA), n, WINDOW)
    first, second = (job.pointers(c)["state_streams"] for c in job.commits())
    assert len(first) > 5 and [b for b in second if second[b] != first[b]] == [b for b in second if second[b].startswith("batch_id=1")]
    assert sum(p.startswith("batch_id=1") for p in second.values()) == 1
    assert {r.device_id: r.last_sequence for r in job.read("state_streams").collect()} == {f"D{i}": 3 if i == 7 else 1 for i in range(40)}
    assert [r.sequence_status for r in job.read("processed").where("batch_id = 1").collect()] == ["Gap"]


def test_restart_continues_after_the_last_batch(spark, tables, message_files, trace):
    root, checkpoint, source = folder("tables"), folder("checkpoint"), folder("messages")
    messages = spark.read.parquet(message_files)
    half = trace[len(trace) // 2][15]
    messages.where(F.col("received_at_utc") < half).coalesce(1).write.mode("append").parquet(source)
    feed(spark, source, root, checkpoint)
    messages.where(F.col("received_at_utc") >= half).coalesce(1).write.mode("append").parquet(source)
    feed(spark, source, root, checkpoint)
    again = microbatch.ReadingTables(spark, root)
    assert rows_of(again.read("processed"), *PROCESSED) == rows_of(tables.read("processed"), *PROCESSED)
    assert rows_of(again.published(), "arrival_no") == rows_of(tables.published(), "arrival_no")


def test_state_that_no_replay_needs_goes(spark):
    schema = T.StructType([T.StructField("v", T.LongType()), T.StructField("bucket", T.IntegerType())])
    job = ledger.Ledger(spark, folder("expire"), {"s": schema}, ("s",), {"s": ("bucket",)})
    for batch, buckets in enumerate([[1, 2, 3], [1], [2], [1], [1]]):
        attempt = job.attempt(batch)
        attempt.write_state("s", spark.createDataFrame([(batch, b) for b in buckets], schema), buckets)
        attempt.commit()
        job.expire(batch, 1)
    kept = {path for c in job.commits()[-2:] for path in job.pointers(c)["s"].values()}
    there = {f"batch_id={n}/attempt=0/{b}" for n in range(5) for b in os.listdir(f"{job.root}/s/batch_id={n}/attempt=0") if b.startswith("bucket=")}
    assert kept == there == {"batch_id=0/attempt=0/bucket=3", "batch_id=2/attempt=0/bucket=2", "batch_id=3/attempt=0/bucket=1", "batch_id=4/attempt=0/bucket=1"}
    assert rows_of(job.read("s"), "v", "bucket") == [("0", "3"), ("2", "2"), ("4", "1")]


def streamed(spark, rows, transform):
    """Results of a stateful operator over the rows in several micro-batches."""
    source = folder("readings")
    ordered = sorted(rows, key=lambda r: r[16])
    for part in range(3):
        chunk = ordered[part * len(rows) // 3:(part + 1) * len(rows) // 3]
        frame(spark, chunk).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(READING_SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    name = "out_" + source.rsplit("-", 1)[1].replace("-", "_")
    query = (
        transform(stream).writeStream.format("memory").queryName(name).outputMode("append")
        .option("checkpointLocation", folder("checkpoint")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.table(name)


def test_stateful_copies(spark, trace):
    got = streamed(spark, trace, stateful.classify_copies_stream).collect()
    assert {r.arrival_no: r.store_status for r in got} == {n: o[0] for n, o in model(trace).items()}


def test_stateful_sequences(spark, trace):
    stored = [r for r in trace if model(trace)[r[16]][0] == "Stored"]
    got = streamed(spark, stored, stateful.classify_sequence_stream).collect()
    assert {r.arrival_no: (r.previous_sequence, r.sequence_status, r.gap_size) for r in got} == {
        n: o[1:4] for n, o in model(trace).items() if o[0] == "Stored"}


def test_stateful_conflicts(spark, trace):
    stored = [r for r in trace if model(trace)[r[16]][0] == "Stored"]
    got = streamed(spark, stored, lambda s: stateful.session_conflicts_stream(s, WINDOW)).collect()
    assert {(r.device_id, r.existing_session_id, r.observed_session_id, r.arrival_no) for r in got} == model_conflicts(
        stored, WINDOW)


def test_series_of_a_stream(spark):
    rows, at = [], 0.0
    for n in range(1, 90):
        at += [0.2, 0.9, 3.0, 40.0][n % 4]
        rows.append(reading(sequence=n, arrival=n, at=at, acquired=T0 + timedelta(seconds=at - [2, -1, 0.5][n % 3])))
    rows.append(reading(sequence=90, arrival=90, at=at - 700))  # late for the watermark of the batch before
    rows.append(reading(sequence=91, arrival=91, at=at + 20))
    batch = {r.sampled_at_utc: tuple(r) for r in metrics.metrics_series(frame(spark, rows[:89])).collect()}
    got = {r.sampled_at_utc: tuple(r) for r in streamed(spark, rows, lambda s: series.metrics_series_stream(s, delay="5 seconds")).collect()}
    assert 0 < len(got) <= len(batch) and max(got) >= max(batch) - timedelta(seconds=41)
    assert got == {t: r for t, r in batch.items() if t <= max(got)}


def test_refreshes_follow_a_plain_model(spark, trace):
    """Three refreshes: the session shown stays while it sends, the buffer holds the newest readings."""
    found = streamed(spark, trace, lambda s: views.refreshes(s, 7)).collect()
    got = {}
    for r in found:
        got.setdefault((r.device_id, r.active_session_id), []).append((r.position, r.timestamp_ms, r.sequence_number, r.acquisition_session_id, r.arrival_no))
    ordered, wanted, state = sorted(trace, key=lambda r: r[16]), {}, {}
    for part in range(3):
        chunk = ordered[part * len(trace) // 3:(part + 1) * len(trace) // 3]
        for device in {r[0] for r in chunk}:
            kept, shown, seen = state.get(device, ({}, None, {}))
            for r in (r for r in chunk if r[0] == device):
                ms = round((r[13] - T0).total_seconds() * 1000)
                kept[r[1], r[2]] = (ms, r[2], r[1], r[16])
                seen[r[1]] = max(seen.get(r[1], ms), ms)
            newest = sorted(kept.values(), reverse=True)[:7]
            shown = shown if shown in seen and max(seen.values()) - seen[shown] <= 30_000 else newest[0][2]
            kept = {(row[2], row[1]): row for row in newest}
            state[device] = (kept, shown, seen)
            wanted.setdefault((device, shown), []).extend((i, *row) for i, row in enumerate(newest))
    base = round(T0.timestamp() * 1000)
    assert {k: sorted((p, ms - base, *rest) for p, ms, *rest in v) for k, v in got.items()} == {k: sorted(v) for k, v in wanted.items()}


def test_sessions_of_the_trace_differ(trace):
    assert {A, B} <= {r[1] for r in trace}
