import pytest
from pyspark.sql import functions as F

from tests.helpers import A, B, frame, model, model_conflicts, random_trace, reading
from wellstream.operators import slices, events, ordering, sessions, store


def outcomes(df):
    return {
        r.arrival_no: (r.store_status, r.previous_sequence, r.sequence_status, r.gap_size, r.outcome)
        for r in df.collect()
    }


def published(spark, rows):
    found = ordering.process(frame(spark, rows)).where("outcome = 'Published'").orderBy("arrival_no").collect()
    return [(r.device_id, r.sequence_number) for r in found]


@pytest.mark.parametrize("sequences, expected", [([1, 2], [1, 2]), ([10, 13], [10, 13]), ([10, 10], [10]), ([10, 12, 11], [10, 12])])
def test_which_readings_are_published(spark, sequences, expected):
    rows = [reading(sequence=s, arrival=i) for i, s in enumerate(sequences, 1)]
    rows = [r[:13] + (rows[0][13],) + r[14:] for r in rows]
    assert published(spark, rows) == [("D1", s) for s in expected]


def test_gap_size_and_events(spark):
    rows = [reading(sequence=10, arrival=1), reading(sequence=13, arrival=2, at=1), reading(sequence=11, arrival=3, at=2)]
    found = events.reading_events(ordering.process(frame(spark, rows))).orderBy("arrival_no").collect()
    assert [(e.event_type, e.previous_sequence_number, e.gap_size, e.message) for e in found] == [
        ("SequenceGap", 10, 2, "2 sequence positions were skipped after 10."),
        ("OutOfOrderReading", 13, None, "Sequence 11 arrived after sequence 13 had already been observed."),
    ]


def test_devices_are_independent(spark):
    assert published(spark, [reading("D1", sequence=10), reading("D2", sequence=1, arrival=2)]) == [("D1", 10), ("D2", 1)]


def test_direct_sequence_classification_can_be_duplicate(spark):
    rows = [reading(sequence=5), reading(sequence=5, arrival=2)]
    found = ordering.classify_sequence(frame(spark, rows)).orderBy("arrival_no").collect()
    assert [r.sequence_status for r in found] == ["Baseline", "Duplicate"]


@pytest.mark.parametrize("seed, width", [(1, 1 << 20), (2, 7), (3, 50)])
def test_random_traces_for_any_slice_width(spark, seed, width):
    trace = random_trace(seed, 400)
    assert outcomes(ordering.process(frame(spark, trace), width)) == model(trace)
    live = ordering.live_stream(frame(spark, trace), width)
    assert {r.arrival_no for r in live.collect()} == {n for n, o in model(trace).items() if o[4] == "Published"}


def test_stored_only_keeps_first_arrivals(spark):
    trace = random_trace(4, 300)
    want = {n for n, o in model(trace).items() if o[0] == "Stored"}
    df = frame(spark, trace)
    assert {r.arrival_no for r in ordering.stored_only(df).collect()} == want
    assert {r.arrival_no for r in ordering.first_arrivals(df).collect()} == want


@pytest.mark.parametrize("times, window, arrivals", [
    ([(A, 0), (B, 0), (A, 20), (B, 20), (A, 40)], 30, [2]),
    ([(A, 0), (B, 0), (A, 31), (B, 31)], 30, [2, 4]),
    ([(A, 0), (B, 30)], 30, [2]),
    ([(A, 0), (B, 31)], 30, []),
])
def test_conflict_is_reported_once_until_idle(spark, times, window, arrivals):
    rows = [reading(session=s, sequence=i, arrival=i, at=at) for i, (s, at) in enumerate(times, 1)]
    found = sessions.session_conflicts(frame(spark, rows), window)
    assert sorted(r.arrival_no for r in found.collect()) == arrivals


@pytest.mark.parametrize("seed, rows_per_slice", [(0, 1 << 20), (1, 7), (2, 40), (3, 1)])
def test_conflicts_of_random_traces(spark, seed, rows_per_slice):
    trace = random_trace(seed, 500, devices=2, sessions=4, hot=0.3)
    outcome = model(trace)
    stored = [r for r in trace if outcome[r[16]][0] == "Stored"]
    found = sessions.session_conflicts(frame(spark, stored), 30, rows_per_slice).collect()
    got = {(r.device_id, r.existing_session_id, r.observed_session_id, r.arrival_no) for r in found}
    assert got == model_conflicts(stored, 30)
    assert got


def test_a_device_that_sends_all_at_once_makes_many_slices(spark):
    """Three sessions within one activity window, most readings of one instant."""
    names = [A, B, "33333333-3333-4333-8333-333333333333"]
    rows = [reading("D0", names[n * n % 3], n, n, 0.0 if n < 300 else (n - 300) / 100) for n in range(1, 700)]
    rows += [reading(f"D{d}", A, d, 1000 + d, d) for d in range(1, 30)]
    obs = sessions._observations(frame(spark, rows), 50)
    sizes = {r.device_id: [] for r in obs.select("device_id").distinct().collect()}
    for r in obs.groupBy("device_id", "_slice").count().collect():
        sizes[r.device_id].append(r["count"])
    assert max(sizes["D0"]) <= 100 and len(sizes["D0"]) >= 10 and sizes["D7"] == [1]
    found = sessions.session_conflicts(frame(spark, rows), 30, 50).collect()
    assert {(r.device_id, r.existing_session_id, r.observed_session_id, r.arrival_no) for r in found} == model_conflicts(rows, 30)


@pytest.mark.parametrize("rows_per_slice", [1 << 20, 5])
def test_conflicts_continue_from_earlier_input(spark, rows_per_slice):
    trace = random_trace(9, 240, devices=2, sessions=4, hot=0.3)
    stored = sorted((r for r in trace if model(trace)[r[16]][0] == "Stored"), key=lambda r: (r[15], r[16]))
    got, activity, reported = set(), None, None
    for part in range(3):
        rows = frame(spark, stored[part * len(stored) // 3:(part + 1) * len(stored) // 3])
        found = sessions.keyed_conflicts(rows, 30, activity, reported, rows_per_slice).collect()
        got |= {(r.device_id, r.existing_session_id, r.observed_session_id, r.arrival_no) for r in found}
        latest = sessions.latest_activity(rows, 30, activity, rows_per_slice)
        activity = spark.createDataFrame(latest.collect(), latest.schema)
        keys = spark.createDataFrame([tuple(r)[:5] for r in found], "device_id string, first_session string, second_session string, first_episode long, second_episode long")
        reported = keys if reported is None else reported.unionByName(keys)
    assert got == model_conflicts(stored, 30)


def test_sequences_in_slices_by_density(spark):
    """Arrival numbers in dense runs far apart, and a stream with most of the rows."""
    trace = [(*r[:16], r[16] * 1000 if r[16] % 50 else r[16] * 1000 + 10**15) for r in random_trace(31, 400, hot=0.7)]
    rows = frame(spark, trace)
    sliced = slices.balanced(rows, ["device_id", "acquisition_session_id"], "arrival_no", "arrival_no", 12)
    sizes = sliced.groupBy("device_id", "acquisition_session_id", "_slice").count().collect()
    assert sum(r["count"] for r in sizes) == 400 and max(r["count"] for r in sizes) <= 24 and len(sizes) > 25
    got = {r.arrival_no: (r.previous_sequence, r.sequence_status, r.gap_size) for r in ordering.classify_sequence(rows, rows_per_slice=12).collect()}
    assert got == {r.arrival_no: (r.previous_sequence, r.sequence_status, r.gap_size) for r in ordering.classify_sequence(rows, 1 << 60).collect()}
    expected = model(trace)
    assert all(got[n] == o[1:4] for n, o in expected.items() if o[0] == "Stored")


def test_insert_if_absent_compares_with_the_table(spark):
    table = frame(spark, [reading(sequence=1)])
    incoming = frame(spark, [
        reading(sequence=1, arrival=2), reading(sequence=1, arrival=3, gamma=60.0),
        reading(sequence=2, arrival=4), reading(sequence=2, arrival=5),
    ])
    status = {r.arrival_no: r.store_status for r in store.classify_against(table, incoming).collect()}
    assert status == {2: "Duplicate", 3: "Conflict", 4: "Stored", 5: "Duplicate"}
    assert [r.arrival_no for r in store.insert_if_absent(table, incoming).collect()] == [4]


def test_negative_zero_is_the_same_content(spark):
    rows = [reading(operation="Stationary", rate=0.0), reading(operation="Stationary", rate=-0.0, arrival=2)]
    assert [r.store_status for r in ordering.classify_copies(frame(spark, rows)).orderBy("arrival_no").collect()] == [
        "Stored", "Duplicate"]


def test_partitions_hold_whole_slices(spark):
    df = ordering.partition_streams(frame(spark, random_trace(5, 300)), 8, 50).withColumn("p", F.spark_partition_id())
    spread = df.groupBy("device_id", "acquisition_session_id", "_slice").agg(F.count_distinct("p").alias("n"))
    assert spread.agg(F.max("n")).first()[0] == 1
    hot = df.where("device_id = 'D0'").where(F.col("acquisition_session_id") == A)
    assert hot.select("p").distinct().count() > 1
