"""Plans at cluster size: what one busy key may not do. Broadcasts are off, as for large inputs."""

import re
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from tests.helpers import T0, frame, model, random_trace, reading
from wellstream.functions import predicates
from wellstream.operators import history, ingest, metrics, ordering, sessions, slices, views, welllog
from wellstream.plans.feed import DerivedFeed
from wellstream.schemas import READING_SCHEMA
from wellstream.session import shared_folder, written
from wellstream.sources import derived, welllogs


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.fixture
def table(spark, tmp_path):
    frame(spark, random_trace(21, 300)).write.parquet(str(tmp_path / "readings"))
    return spark.read.schema(READING_SCHEMA).parquet(str(tmp_path / "readings"))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_outcomes_never_put_a_stream_into_one_task(no_broadcast, table):
    df = ordering.process(table)
    # Either a slice of a stream, or one summary row per slice (ordered by the slice).
    for spec in re.findall(r"windowspecdefinition\(([^)]*)\)", plan(df)):
        assert "_slice" in spec
    exchanged = re.findall(r"hashpartitioning\(([^)]*)\)", plan(df))
    assert any("_slice" in e for e in exchanged) and any("sequence_number" in e for e in exchanged)
    assert "CartesianProduct" not in plan(df) and "BroadcastNestedLoopJoin" not in plan(df)
    assert len(df.collect()) == 300


def test_repeated_keys_are_found_by_hash_aggregates(no_broadcast, table):
    assert "SortAggregate" not in plan(ordering.process(table))


def test_every_rule_is_broken_by_some_reading(spark):
    broken = ingest.validate(derived.broken_readings(spark, "/root/testdata/sf0.001"))
    found = {r.reject_reason for r in broken.select("reject_reason").distinct().collect()}
    rules = {v for k, v in vars(predicates).items() if k.startswith(("BLANK_", "BAD_", "EMPTY_SESSION_ID"))}
    assert found == rules - {predicates.BAD_JSON} | {None}


def test_conflicts_window_by_slice(no_broadcast, table):
    df = sessions.session_conflicts(table, 30)
    for spec in re.findall(r"windowspecdefinition\(([^)]*)\)", plan(df)):
        assert "_slice" in spec  # rows of one slice, or one row per slice in their order
    assert "CartesianProduct" not in plan(df)


def test_filters_and_columns_reach_the_scan(table):
    text = plan(history.device_ids(table.where(F.col("device_id") == "D0")))
    assert "EqualTo(device_id,D0)" in text
    assert "ReadSchema: struct<device_id:string>" in text


def test_first_rows_are_limited_before_the_shuffle(table):
    text = plan(history.recent_readings_per_device(table, 5))
    assert "WindowGroupLimit" in text
    assert "WindowGroupLimit" in plan(views.live_buffer(table))


def test_one_hot_key_gives_the_same_result(spark):
    trace = [reading("D0", sequence=7, arrival=n, at=n, gamma=50.0 + (n % 5 == 0)) for n in range(1, 200)]
    got = {r.arrival_no: r.outcome for r in ordering.process(frame(spark, trace), 16).collect()}
    assert got == {n: o[4] for n, o in model(trace).items()}


def test_series_of_one_second_against_brute_force(spark):
    trace = [reading(sequence=n, arrival=n, at=at, acquired=T0 + timedelta(seconds=at - lag)) for n, (at, lag) in enumerate(
        [(0.2, 1), (0.9, -2), (3.5, 2), (3500.0, 0.5), (3601.5, -1), (7300.0, 3)], 1)]
    found = metrics.metrics_series(frame(spark, trace)).orderBy("sampled_at_utc").collect()
    assert len(found) == 7301
    total, latest = 0, None
    for second, row in enumerate(found):
        here = [r for r in trace if second <= (r[15] - T0).total_seconds() < second + 1]
        total += len(here)
        for r in here:
            if r[15] >= r[13]:
                latest = (r[15] - r[13]).total_seconds() * 1000
        assert (row.readings_processed_total, row.readings_per_second) == (total, float(len(here)))
        assert row.latest_end_to_end_latency_ms == latest


def test_a_wrong_time_of_receipt_makes_one_sample(spark):
    trace = [reading(sequence=n, arrival=n, at=at) for n, at in enumerate([0, 3, 5 + 86400 * 365 * 1000, 9 + 86400 * 365 * 1000], 1)]
    found = [(r.readings_processed_total, r.readings_per_second) for r in metrics.metrics_series(frame(spark, trace)).orderBy("sampled_at_utc").collect()]
    assert found == [(1, 1.0), (1, 0.0), (1, 0.0), (2, 1.0), (3, 1.0), (3, 0.0), (3, 0.0), (3, 0.0), (4, 1.0)]


def test_query_parameters_are_checked(table):
    with pytest.raises(ValueError, match="blank"):
        history.recent_readings(table, " ")
    for limit in (0, 1001):
        with pytest.raises(ValueError, match="limit"):
            history.recent_readings(table, "D0", limit)
    with pytest.raises(ValueError, match="limit"):
        history.recent_events(table, 101)


def test_intermediate_tables_lie_in_the_shared_folder(spark, table):
    df = written(ordering.process(table))
    assert "Window" not in plan(df)
    assert df.inputFiles()[0].removeprefix("file://").startswith(shared_folder(spark).removeprefix("file:") + "/tables/")
    assert df.count() == 300


def test_every_user_keeps_a_device_of_its_own(spark):
    users = spark.range(1500).select(derived.device_of(F.col("id")).alias("device_id"))
    assert users.distinct().count() == 1500
    assert {r.device_id for r in users.where("device_id like '%7'").take(1)} == {"DRILL-007"}
    events = derived.read_events(spark, "/root/testdata/sf0.1")
    devices = events.select(derived.device_of(F.col("user_id")).alias("device_id")).distinct().count()
    assert devices == events.select("user_id").distinct().count()


def test_log_texts_are_derived_and_shuffled_once(spark, no_broadcast, tmp_path):
    rows = [("a.xml", b, i, t) for b, i, t in [
        (-1, 0, "<logs><logData>"), (0, 1, "<data>1</data>\n"), (0, 2, "<!-- <"), (1, 3, "<data>2</data>\n-->"),
        (1, 4, "<data>2</data>"), (1, 5, "<!-- x -->"), (1, 6, "<data>a &lt; b</data> <w:data>4</w:data><data>5]]></data>"),
        (2, 0, "</logData></logs>")]]
    spark.createDataFrame([(None, 0, 0, "<data>0</data>"), *rows], "path string, block bigint, at bigint, text string").write.parquet(str(tmp_path / "texts"))
    found = welllogs.tokens(welllogs.split_pieces(spark.read.parquet(str(tmp_path / "texts"))))
    rows = found.orderBy("block", "at").collect()
    assert "ReusedExchange" in plan_after(found)
    assert [(r.name, r.line) for r in rows if r.name] == [("data", "1"), ("data", "2"), ("data", "a < b"), ("w:data", "4")]
    assert all((r.text is None) == (r.line is not None) for r in rows) and len({(r.block, r.run) for r in rows if r.name}) == 3
    header = welllogs.header_texts(found).first().header
    assert header == ('<logs><logData><data wellstream-run="0:0:1:1"/><data wellstream-run="1:0:1:2"/><w:data wellstream-run="1:1:3:1"/>'
                      '<data>5]]></data></logData></logs>')


def plan_after(df):
    """The plan as it was run."""
    df.collect()
    return plan(df)


@pytest.mark.parametrize("rows_per_slice", [1, 10_000])
def test_only_large_keys_are_cut_when_events_are_numbered(spark, no_broadcast, tmp_path, rows_per_slice):
    events = [(i, None if i % 11 == 0 else T0 + timedelta(hours=i * 5 % 97), None if i % 13 == 0 else i % 3, 1.0) for i in range(200)]
    spark.createDataFrame(events, "event_id bigint, ts timestamp, user_id bigint, value double").write.parquet(str(tmp_path / "events.parquet"))
    found = derived.numbered_events(spark, str(tmp_path), ["device_id"], rows_per_slice=rows_per_slice)
    known = []
    for user in range(3):
        own = sorted((e for e in events if e[2] == user), key=lambda e: (e[1] is not None, e[1] or T0, e[0]))
        known += [(e[0], n) for n, e in enumerate(own, 1) if e[1] is not None]  # those without a time count but are left out
    assert sorted((r.event_id, r.rn) for r in found.collect()) == sorted(known)


def test_texts_of_lines_stay_out_of_the_shuffle(no_broadcast, spark):
    names = ("depth", "dtim", "gr", "spp", "temp")
    header = {c: "x" for c in ("path", "device_id", "uid_well", "name_well", "uid_wellbore", "name_wellbore", "index_curve")}
    row = header | {"depth_unit": "m", "columns": 5, "curve_reason": None} | {f"{n}_at": i for i, n in enumerate(names, 1)} | {f"{n}_null": "n" for n in names}
    texts = ["1.5,2024-01-01T00:00Z,1,2,3", "2,2024-01-01T00:00:00Z,1,2,3", "3,2024-01-01T00:00:01Z,1,2", "n,2024,1,2,3"]
    schema = ", ".join(f"{c} {'int' if c == 'columns' or c.endswith('_at') else 'string'}" for c in row) + ", line_no bigint, line string"
    mapped = welllog.map_lines(spark.createDataFrame([(*row.values(), i, t) for i, t in enumerate(texts, 1)], schema))
    steps = plan(mapped).splitlines()
    shuffled = steps[next(i for i, step in enumerate(steps) if "Exchange hashpartitioning(path" in step) + 1]
    assert "_reason" in shuffled and "dtim_text" not in shuffled and "depth_null" not in shuffled
    assert [(r.stage, r.reason, r.rate) for r in mapped.orderBy("line_no").collect()] == [
        (None, None, 0.0), (welllog.VALUES, "time is not later than that of the previous line", 0.0),
        (welllog.FIELD_COUNT, "4 fields but 5 columns", 3600.0), (welllog.VALUES, "x uses the null value 'n'", 0.0)]


@pytest.mark.parametrize("values", [[7], [-5, 5, 5, 5, None], [i * i * 7919 % 100_003 - 50_000 for i in range(5000)], [0, 1 << 62]])
def test_shares_of_the_order_are_exact(spark, values):
    rows = spark.createDataFrame([(v,) for v in values], "at bigint")
    shares = [0.0, 1 / 3, 0.5, 2 / 3, 1.0]
    known = sorted(v for v in values if v is not None)
    assert slices.at_shares(rows, "at", shares) == [known[int((len(known) - 1) * s)] for s in shares]


def test_batches_need_no_percentile_in_one_task(spark, tmp_path, monkeypatch):
    def refused(*_):
        raise AssertionError("all arrival numbers in one task")

    monkeypatch.setattr(F, "percentile", refused)
    spark.range(300).select(F.col("id").alias("event_id"), F.timestamp_seconds(F.col("id") + 1_704_067_200).cast("timestamp_ntz").alias("ts"),
                            (F.col("id") % 7).alias("user_id"), F.lit(1.5).alias("value")).write.parquet(str(tmp_path / "events.parquet"))
    feed = DerivedFeed(spark, str(tmp_path))
    processed = feed.micro_batches
    assert sorted(r[0] for r in processed.groupBy("batch_id").count().select("batch_id").collect()) == [0, 1, 2]
    assert sorted(processed.select("arrival_no", "outcome").collect()) == sorted(feed.processed.select("arrival_no", "outcome").collect())
