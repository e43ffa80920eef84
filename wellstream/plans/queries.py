"""Registered queries: one per operator, over the tables of a data directory."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wellstream.functions import labels, predicates, welltext
from wellstream.operators import audit, backfill, events, evidence, history, metrics, ordering, store, views, welllog
from wellstream.operators.slices import SLICE
from wellstream.plans.feed import DerivedFeed
from wellstream.sources import derived, varied, welllogs
from wellstream.schemas import ARRIVAL_COLUMNS, NATURAL_KEY, READING_COLUMNS, STREAM_KEY


SINCE = "2024-01-10 00:00:00"
ARRIVAL = [*READING_COLUMNS, *ARRIVAL_COLUMNS]
IMPORT_ID = "import-1"


def plain(df: DataFrame) -> DataFrame:
    """UTC instants as time-zone-less timestamps, the type of the input tables."""
    return df.select(*[
        F.col(f"`{f.name}`").cast("timestamp_ntz").alias(f.name) if isinstance(f.dataType, T.TimestampType) else f.name
        for f in df.schema
    ])


def _o1(f: DerivedFeed) -> DataFrame:
    spread = ordering.partition_streams(f.readings, int(f.spark.conf.get("spark.sql.shuffle.partitions")))
    placed = spread.withColumn("_p", F.spark_partition_id())
    per_slice = placed.groupBy(*STREAM_KEY, SLICE).agg(
        F.count(F.lit(1)).alias("_n"), F.min("_p").alias("_low"), F.max("_p").alias("_high")
    )
    return per_slice.groupBy(*STREAM_KEY).agg(
        F.sum("_n").alias("readings"), F.max(F.col("_high") - F.col("_low") + 1).alias("partitions_used")
    )


def _s4(f: DerivedFeed) -> DataFrame:
    """A table that holds a third of the reading events; all of them arrive, every fifth twice."""
    found = events.reading_events(f.processed)
    times = F.when(F.col("arrival_no") % 5 == 0, 2).otherwise(1)
    incoming = found.withColumn("_time", F.explode(F.sequence(F.lit(1), times)))
    return store.insert_events(
        events.events_table(found.where("arrival_no % 3 = 0")), events.events_table(incoming))


def _event_type(f: DerivedFeed, name: str) -> DataFrame:
    return events.events_table(events.reading_events(f.processed).where(F.col("event_type") == name))


def _e7(f: DerivedFeed) -> DataFrame:
    counted = f.stored.groupBy("acquisition_session_id").agg(F.count(F.lit(1)).alias("readings"))
    return counted.select(
        "acquisition_session_id", labels.run_label(F.col("acquisition_session_id")).alias("run_label"), "readings"
    )


def _merged_latency(f: DerivedFeed) -> DataFrame:
    """The merged summary; of its quantiles, whether their ranks are right within the error of the sketch."""
    found = metrics.merged_latency(f.metric_states)
    us = metrics.latency_micros()
    ranks = f.published.where(us.isNotNull()).join(F.broadcast(found.select("acquisition_mode", "median_ms", "p95_ms")), "acquisition_mode").groupBy("acquisition_mode").agg(*[
        (F.avg((us < F.col(c) * 1000).cast("double")).between(0, rank + metrics.RANK_ERROR)
         & (F.avg((us <= F.col(c) * 1000).cast("double")) >= rank - metrics.RANK_ERROR)).alias(f"{c}_is_right")
        for c, rank in (("median_ms", 0.5), ("p95_ms", 0.95))])
    return found.drop("median_ms", "p95_ms").join(ranks, "acquisition_mode")


def _o3(f: DerivedFeed) -> DataFrame:
    return (
        ordering.classify_copies(f.readings)
        .groupBy(*NATURAL_KEY)
        .agg(
            F.count_if(F.col("store_status") == "Duplicate").alias("equal_copies"),
            F.count_if(F.col("store_status") == "Conflict").alias("different_copies"),
            F.count(F.lit(1)).alias("_n"),
        )
        .where("_n > 1")
        .drop("_n")
    )


def _o8(conflicts: DataFrame) -> DataFrame:
    pair = ordering.session_pair(F.col("existing_session_id"), F.col("observed_session_id"))
    return (
        conflicts.groupBy("device_id", pair.alias("_pair"))
        .agg(F.count(F.lit(1)).alias("conflicts"))
        .select("device_id", "_pair.first", "_pair.second", "conflicts")
    )


def _l4(f: DerivedFeed) -> DataFrame:
    zipped = F.arrays_zip("mnemonics", "units")
    return f.documents.select("path", F.size("mnemonics").alias("_n"), F.posexplode(zipped).alias("_i", "_z")).where(
        "_i < _n"
    ).select(
        "path", (F.col("_i") + 1).alias("position"), F.col("_z.mnemonics").alias("mnemonic"), F.col("_z.units").alias("unit")
    )


def _reason(f: DerivedFeed, *endings: str) -> DataFrame:
    match = F.lit(False)
    for ending in endings:
        match = match | F.col("reason").like(ending)
    return f.mapped.where(match).select("path", "line_no", "reason")


def _round(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def _upgraded(f: DerivedFeed, version: int) -> DataFrame:
    return backfill.upgrade(f.legacy(version)).select(
        *ARRIVAL,
        F.col("payload.gamma_ray_api").alias("payload_gamma_ray_api"),
        F.col("payload.well_name").alias("payload_well_name"),
        F.col("payload.acquisition_mode").alias("payload_acquisition_mode"),
    )


def _b6(f: DerivedFeed) -> DataFrame:
    versions = [backfill.upgrade(f.legacy(v)).withColumn("version", F.lit(v)) for v in range(1, 6)]
    united = versions[0]
    for other in versions[1:]:
        united = united.unionByName(other)
    return united.groupBy("version").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct("well_name").alias("wells"),
        F.count_if(F.col("acquisition_mode") == "RealTime").alias("real_time"),
    )


def _mixed_folder(f: DerivedFeed) -> DataFrame:
    """Every row of the mixed folder as upgraded, with the version of its file."""
    rows = f.upgraded.read("upgraded").select(*ARRIVAL, "reject_reason", "source_file")
    return rows.join(f.upgraded.upgraded_files().select("source_file", "from_version"), "source_file").drop("source_file")


def _mixed_files(f: DerivedFeed) -> DataFrame:
    return f.upgraded.upgraded_files().groupBy("from_version").agg(
        F.sum("rows").alias("rows"), F.sum("rejected").alias("rejected"))


QUERIES: dict[str, Callable[[DerivedFeed], DataFrame]] = {
    "s1_ingest_messages": lambda f: f.message_results.where("reject_reason is null").select(*ARRIVAL),
    "s2_dead_letters": lambda f: f.message_results.where("reject_reason is not null").select(
        "arrival_no", "received_at_utc", "reject_reason"),
    "s3_store_status": lambda f: store.classify_against(f.table_before, f.incoming).select(
        *NATURAL_KEY, "arrival_no", "store_status"),
    "s3_insert_if_absent": lambda f: store.insert_if_absent(f.table_before, f.incoming),
    "s4_insert_events": _s4,
    "s5_published_readings": lambda f: f.processed.where(F.col("outcome") == "Published").select(*ARRIVAL),
    "s6_readings_scan": lambda f: f.arrivals,
    "s7_log_documents": lambda f: f.documents.select("path", "malformed", "xmlns", "version", "log_count", "has_log_data"),
    "s7_log_lines": lambda f: welllogs.lines(f.log_tokens, f.documents),
    "s8_reading_response": lambda f: history.reading_response(f.stored),
    "s8_event_response": lambda f: history.event_response(f.event_stream),
    "v1_validate": lambda f: f.validated.select("arrival_no", "reject_reason"),
    "v1_reason_counts": lambda f: f.validated.groupBy("reject_reason").agg(F.count(F.lit(1)).alias("readings")),
    "v1_broken_readings": lambda f: f.broken.select("arrival_no", "reject_reason"),
    "v2_rate_consistency": lambda f: f.arrivals.select(
        "arrival_no", "drilling_operation",
        predicates.rate_matches_operation(F.col("drilling_operation"), F.col("depth_change_rate_metres_per_hour"))
        .alias("consistent")),
    "v3_constraint_report": lambda f: audit.constraint_report(f.arrivals, f.events),
    "v3_violations": lambda f: audit.violations(f.arrivals).select("arrival_no", "broken"),
    "v3_broken_report": lambda f: audit.constraint_report(f.broken, derived.broken_events(f.spark, f.sf_dir)),
    "v3_broken_violations": lambda f: audit.violations(f.broken).select("arrival_no", "broken"),
    "v3_repeated_keys": lambda f: audit.repeated_keys(f.readings),
    "v4_defaults": lambda f: f.message_results.where("parsed").select("arrival_no", "acquisition_mode"),
    "o1_stream_partitions": _o1,
    "o2_store_status": lambda f: ordering.classify_copies(f.readings).select("arrival_no", "store_status"),
    "o3_same_content": _o3,
    "o4_sequence_status": lambda f: ordering.classify_sequence(f.stored).select(
        "arrival_no", "previous_sequence", "sequence_status", "gap_size"),
    "o4_sequence_status_in_slices": lambda f: ordering.classify_sequence(f.readings, rows_per_slice=16).select(
        "arrival_no", "previous_sequence", "sequence_status", "gap_size"),
    "o5_outcome": lambda f: f.processed,
    "o6_live_stream": lambda f: ordering.live_stream(f.readings).select(*ARRIVAL),
    "o7_session_conflicts": lambda f: f.conflicts,
    "o7_conflicts_at_30_seconds": lambda f: f.burst_conflicts,
    "o8_session_pairs": lambda f: _o8(f.conflicts),
    "o8_pairs_at_30_seconds": lambda f: _o8(f.burst_conflicts),
    "o9_late_arrivals": lambda f: f.processed.where(F.col("outcome") == "LateArrival").select(
        "arrival_no", "sequence_number", (F.col("previous_sequence") - F.col("sequence_number")).alias("sequences_late")),
    "o10_micro_batches": lambda f: f.micro_batches.select(*f.processed.columns),
    "e1_duplicate_events": lambda f: _event_type(f, events.DUPLICATE_READING),
    "e2_conflict_events": lambda f: _event_type(f, events.CONFLICTING_READING),
    "e3_gap_events": lambda f: _event_type(f, events.SEQUENCE_GAP),
    "e4_out_of_order_events": lambda f: _event_type(f, events.OUT_OF_ORDER_READING),
    "e5_invalid_message_events": lambda f: events.events_table(events.invalid_message_events(f.rejects)),
    "e6_concurrent_session_events": lambda f: events.events_table(events.concurrent_session_events(f.conflicts)),
    "e7_run_labels": _e7,
    "e8_event_stream": lambda f: f.event_stream,
    "m1_counters": lambda f: metrics.outcome_counters(f.processed, f.rejects),
    "m1_outcome_counts": lambda f: metrics.outcome_counts(f.processed),
    "m2_gap_sizes": lambda f: metrics.gap_size_distribution(f.published),
    "m3_latency": lambda f: metrics.latency_summary(f.published),
    "m2_merged_gap_sizes": lambda f: metrics.merged_gap_sizes(f.metric_states),
    "m3_merged_latency": _merged_latency,
    "m4_metrics_series": lambda f: metrics.metrics_series(f.published),
    "m5_totals": lambda f: metrics.totals(f.published),
    "h1_device_ids": lambda f: history.device_ids(f.stored),
    "h2_latest_sessions": lambda f: history.latest_sessions(f.stored),
    "h3_recent_readings": lambda f: history.recent_readings(f.stored, "DRILL-007", 25),
    "h3_recent_readings_per_device": lambda f: history.recent_readings_per_device(f.stored, 10),
    "h4_recent_events": lambda f: history.recent_events(f.events),
    "q1_latest_session": lambda f: evidence.latest_session_since(f.stored, SINCE),
    "q2_session_throughput": lambda f: evidence.session_throughput(f.stored, SINCE),
    "q2_latest_session_throughput": lambda f: evidence.latest_session_throughput(f.stored, SINCE),
    "q3_sequence_continuity": lambda f: evidence.sequence_continuity(
        f.stored, evidence.latest_session_since(f.stored, SINCE)),
    "q4_event_counts": lambda f: evidence.event_counts(f.events, SINCE),
    "q5_order_event_counts": lambda f: evidence.order_event_counts(f.events, SINCE),
    "l1_document_checks": lambda f: f.documents.select("path", "structure_reason"),
    "l2_headers": lambda f: f.documents.select(
        "path", "uid_well", "name_well", "uid_wellbore", "name_wellbore", "uid", "name", "index_curve"),
    "l3_curves": lambda f: f.documents.select("path", F.inline("curves")),
    "l4_lists": _l4,
    "l5_lines": lambda f: f.mapped.select("path", "line_no", "fields", "columns"),
    "l6_unit_counts": lambda f: f.documents.select(
        "path", F.size("mnemonics").alias("mnemonics"), F.size("units").alias("units"),
        (F.size("mnemonics") == F.size("units")).alias("consistent")),
    "l7_columns": lambda f: f.documents.select("path", "depth_at", "dtim_at", "gr_at", "spp_at", "temp_at"),
    "l8_required_curves": lambda f: f.documents.where(
        F.col("curve_reason").like("required mnemonic%") | F.col("curve_reason").like("index curve%")
    ).select("path", "curve_reason"),
    "l9_units": lambda f: f.documents.where("structure_reason is null").select("path", "depth_unit", "curve_reason"),
    "l10_mandatory_values": lambda f: _reason(f, "%has an empty value", "%uses the null value%"),
    "l11_numbers": lambda f: f.mapped.select("path", "line_no", "gr", "spp", "temp"),
    "l12_ranges": lambda f: _reason(f, "%is negative"),
    "l13_depth_metres": lambda f: _round(f.mapped.select("path", "line_no", "depth_metres"), "depth_metres"),
    "l14_times": lambda f: f.mapped.select("path", "line_no", "dtim"),
    "l15_time_order": lambda f: _reason(f, "time is not later%"),
    "l16_rates": lambda f: _round(f.mapped.where("reason is null").select("path", "line_no", "rate"), "rate"),
    "l17_readings": lambda f: _round(
        welllog.import_readings(f.mapped, f.log_rejects, IMPORT_ID),
        "measured_depth_metres", "depth_change_rate_metres_per_hour"),
    "l18_rejects": lambda f: f.log_rejects,
    "l19_summary": lambda f: welllog.import_summary(f.documents, f.mapped, f.log_rejects),
    "d1_merged_readings": lambda f: f.merged,
    "d2_displayed_readings": lambda f: history.reading_response(f.displayed),
    "d3_live_buffer": lambda f: history.reading_response(views.live_buffer(f.merged)),
    "d4_latest_readings": lambda f: history.reading_response(views.latest_readings(f.displayed)),
    "d5_active_sessions": lambda f: f.active,
    "d6_all_devices": lambda f: views.all_devices(f.baseline, f.incoming),
    "d7_merged_events": lambda f: views.merge_events(
        events.events_table(f.event_stream.where("event_rank = 1")),
        events.events_table(f.event_stream.where("event_rank = 0 or event_type = 'SequenceGap'"))),
    "d8_visible_events": lambda f: views.visible_events(history.recent_events(f.events)),
    "d9_depth_axis": lambda f: _round(views.depth_axis(f.displayed), "axis_min", "axis_max"),
    "d10_gamma_axis": lambda f: _round(views.gamma_axis(f.displayed), "axis_min", "axis_max"),
    "d11_depth_series": lambda f: views.depth_series(f.displayed),
    "d11_gamma_series": lambda f: views.gamma_series(f.displayed),
    "d11_pressure_temperature_series": lambda f: views.pressure_temperature_series(f.displayed),
    "d12_status_labels": lambda f: views.status_labels(views.latest_readings(f.displayed)),
    "d13_rate_labels": lambda f: f.stored.groupBy(
        labels.rate_label(F.col("depth_change_rate_metres_per_hour")).alias("rate_label")
    ).agg(F.count(F.lit(1)).alias("readings")),
    "d14_event_cards": lambda f: views.event_cards(f.events),
    "b1_well_context": lambda f: _upgraded(f, 1),
    "b2_operation": lambda f: _upgraded(f, 2),
    "b3_gamma_ray": lambda f: _upgraded(f, 3),
    "b4_names": lambda f: _upgraded(f, 4),
    "b5_mode": lambda f: _upgraded(f, 5),
    "b6_upgrade_counts": _b6,
    "b6_mixed_folder": _mixed_folder,
    "b6_mixed_files": _mixed_files,
    "e7_varied_run_labels": lambda f: varied.readings(f.spark, f.sf_dir).select(
        "device_id", labels.run_label(F.col("acquisition_session_id")).alias("run_label")),
    "d12_varied_status_labels": lambda f: views.status_labels(varied.readings(f.spark, f.sf_dir), live=True),
    "d13_varied_rate_labels": lambda f: varied.readings(f.spark, f.sf_dir).select(
        "device_id", labels.rate_label(F.col("depth_change_rate_metres_per_hour")).alias("rate_label")),
    "l9_varied_units": lambda f: welllog.resolve(varied.headers(f.spark, f.sf_dir)).select("path", "curve_reason"),
    "l11_varied_numbers": lambda f: varied.fields(f.spark, f.sf_dir).select(
        "event_id", welltext.parse_number(F.col("number")).alias("number")),
    "l14_varied_times": lambda f: varied.fields(f.spark, f.sf_dir).select(
        "event_id", welltext.parse_time(F.col("time")).alias("time")),
}


def run(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(QUERIES[name](DerivedFeed(spark, sf_dir)))


__all__ = ["QUERIES", "plain", "run"]
