"""Counters, distributions and the per-second metrics series (M1 to M5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wellstream.operators.slices import SLICE, slice_start

SECOND = 1_000_000
# With one-second intervals a span is an hour.
INTERVALS_PER_SPAN = 3600
# Merged states: kinds of rows, and the size of a sketch with the share of ranks that its quantiles may be off.
GAPS, LATENCY = "gaps", "latency"
SKETCH_SIZE, RANK_ERROR = 800, 0.01
# A longer silence makes no empty samples.
LONGEST_SILENCE = 7 * 86400


def latency_micros() -> Column:
    """End-to-end latency; null where the clock of the device runs ahead."""
    micros = F.unix_micros("received_at_utc") - F.unix_micros("timestamp_utc")
    return F.when(micros >= 0, micros)


def outcome_counters(processed: DataFrame, rejected: DataFrame) -> DataFrame:
    """M1: one row of counters. Each side is reduced to one row before they meet."""
    found = processed.agg(
        F.count_if(F.col("outcome") == "Published").alias("processed"),
        F.count_if(F.col("sequence_status") == "Gap").alias("gaps"),
        F.count_if(F.col("outcome") == "Duplicate").alias("duplicates"),
        F.count_if(F.col("outcome") == "Conflict").alias("conflicts"),
        F.count_if(F.col("outcome") == "LateArrival").alias("out_of_order"),
    )
    invalid = rejected.agg(F.count(F.lit(1)).alias("invalid"))
    counters = ["processed", "gaps", "duplicates", "conflicts", "out_of_order", "invalid"]
    return (
        found.withColumn("invalid", F.lit(0).cast("bigint"))
        .unionByName(invalid.select(*[
            (F.col(c) if c == "invalid" else F.lit(0)).cast("bigint").alias(c) for c in counters
        ]))
        .agg(*[F.sum(c).alias(c) for c in counters])
    )


def outcome_counts(processed: DataFrame) -> DataFrame:
    """Rows per outcome and sequence status."""
    return processed.groupBy("outcome", "sequence_status").agg(F.count(F.lit(1)).alias("readings"))


def gap_size_distribution(processed: DataFrame) -> DataFrame:
    """M2: how often each gap size occurred."""
    return (
        processed.where(F.col("sequence_status") == "Gap")
        .groupBy("gap_size")
        .agg(F.count(F.lit(1)).alias("gaps"))
    )


def latency_summary(published: DataFrame) -> DataFrame:
    """M3: recorded latencies per acquisition mode; readings with a negative one still count."""
    ms = F.col("_latency") / 1000
    return (
        published.withColumn("_latency", latency_micros())
        .groupBy("acquisition_mode")
        .agg(
            F.count(F.lit(1)).alias("readings"),
            F.count("_latency").alias("recorded"),
            F.round(F.avg(ms), 6).alias("average_ms"),
            F.min(ms).alias("minimum_ms"),
            F.max(ms).alias("maximum_ms"),
            F.percentile_approx(ms, 0.5, 10000).alias("median_ms"),
            F.percentile_approx(ms, 0.95, 10000).alias("p95_ms"),
        )
    )


def metric_states(published: DataFrame) -> DataFrame:
    """M2 and M3 of some readings in a form that can be merged: a histogram of gaps, and sums and a KLL sketch per mode.

    Rows are (kind, acquisition_mode, gap_size, readings, recorded, sum_us, minimum_us, maximum_us, sketch).
    """
    latency = published.withColumn("_us", latency_micros())
    none = F.lit(None)
    gaps = gap_size_distribution(published).select(
        F.lit(GAPS).alias("kind"), none.cast("string").alias("acquisition_mode"), "gap_size", F.col("gaps").alias("readings"),
        *[none.cast("bigint").alias(c) for c in ("recorded", "sum_us", "minimum_us", "maximum_us")], none.cast("binary").alias("sketch"))
    modes = latency.groupBy("acquisition_mode").agg(
        F.count(F.lit(1)).alias("readings"), F.count("_us").alias("recorded"), F.sum("_us").alias("sum_us"), F.min("_us").alias("minimum_us"),
        F.max("_us").alias("maximum_us"), F.kll_sketch_agg_bigint("_us", F.lit(SKETCH_SIZE)).alias("sketch"))
    # a sketch of nothing has no quantiles, and merges with nothing
    own = modes.withColumn("sketch", F.when(F.col("recorded") > 0, F.col("sketch")))
    return gaps.unionByName(own.select(F.lit(LATENCY).alias("kind"), none.cast("bigint").alias("gap_size"), *own.columns))


def merged_gap_sizes(states: DataFrame) -> DataFrame:
    """M2 from states, exactly."""
    return states.where(F.col("kind") == GAPS).groupBy("gap_size").agg(F.sum("readings").alias("gaps"))


def merged_latency(states: DataFrame) -> DataFrame:
    """M3 from states: all but the quantiles exactly, these within the error of the sketch (RANK_ERROR of the ranks)."""
    merged = states.where(F.col("kind") == LATENCY).groupBy("acquisition_mode").agg(
        F.sum("readings").alias("readings"), F.sum("recorded").alias("recorded"), F.sum("sum_us").alias("_sum"), F.min("minimum_us").alias("_minimum"),
        F.max("maximum_us").alias("_maximum"), F.kll_merge_agg_bigint("sketch", F.lit(SKETCH_SIZE)).alias("_sketch"))

    def quantile(rank: float) -> Column:
        return F.when(F.col("recorded") > 0, F.kll_sketch_get_quantile_bigint("_sketch", F.lit(rank)) / 1000)

    return merged.select(
        "acquisition_mode", "readings", "recorded", F.round(F.try_divide("_sum", "recorded") / 1000, 6).alias("average_ms"),
        (F.col("_minimum") / 1000).alias("minimum_ms"), (F.col("_maximum") / 1000).alias("maximum_ms"),
        quantile(0.5).alias("median_ms"), quantile(0.95).alias("p95_ms"))


def totals(published: DataFrame) -> DataFrame:
    """M5: readings so far and the latest recorded latency, or null."""
    latency = latency_micros()
    return published.agg(
        F.count(F.lit(1)).alias("readings_processed_total"),
        (F.max_by(latency, F.when(latency.isNotNull(), F.struct("received_at_utc", "arrival_no"))) / 1000)
        .alias("latest_end_to_end_latency_ms"),
    )


def per_interval(published: DataFrame, interval_micros: int) -> DataFrame:
    """Published readings per interval of receipt, with the latest recorded latency of that interval."""
    latency = latency_micros()
    return (
        published.withColumn("_from", slice_start(F.unix_micros("received_at_utc"), interval_micros))
        .groupBy("_from")
        .agg(
            F.count(F.lit(1)).alias("_n"),
            F.max(F.when(latency.isNotNull(), F.struct("received_at_utc", "arrival_no", latency.alias("us"))))
            .alias("_latest"),
        )
        .select("_from", "_n", F.col("_latest.us").alias("_latency"))
    )


def metrics_series(published: DataFrame, interval_seconds: int = 1, longest_silence_seconds: int = LONGEST_SILENCE) -> DataFrame:
    """M4: one sample at the end of every interval between the first and the last receipt, empty ones too.

    Running values are built in two levels: whole spans of intervals are accumulated first, then the intervals inside
    each span. A task sees the intervals of one span, or one row per span. An interval with receipts makes the samples of
    the empty ones behind it; a silence longer than ``longest_silence_seconds`` is left out of the series, so that one
    wrong time of receipt far off can't fill the output.
    """
    step = interval_seconds * SECOND
    counted = per_interval(published, step).withColumn(SLICE, slice_start(F.col("_from"), step * INTERVALS_PER_SPAN))
    spans = counted.groupBy(SLICE).agg(
        F.sum("_n").alias("_n"),
        F.max_by("_latency", F.when(F.col("_latency").isNotNull(), F.col("_from"))).alias("_latency"),
        F.min("_from").alias("_first"),
    )
    order = Window.orderBy(SLICE)  # one row per span that has receipts
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    carried = spans.select(
        SLICE,
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_total"),
        F.last("_latency", ignorenulls=True).over(before).alias("_carried_latency"),
        F.lead("_first").over(order).alias("_next_span"),
    )
    inside = Window.partitionBy(SLICE).orderBy("_from")
    so_far = inside.rowsBetween(Window.unboundedPreceding, 0)
    following = F.coalesce(F.lead("_from").over(inside), F.col("_next_span"))
    last = F.when(following - F.col("_from") <= longest_silence_seconds * SECOND, following - step).otherwise(F.col("_from"))
    rows = counted.join(carried, SLICE).select(
        "_from", "_n",
        (F.col("_total") + F.sum("_n").over(so_far)).alias("readings_processed_total"),
        F.coalesce(F.last("_latency", ignorenulls=True).over(so_far), F.col("_carried_latency")).alias("_latency"),
        F.coalesce(last, F.col("_from")).alias("_last"),
    )
    samples = rows.select("*", F.explode(F.sequence("_from", "_last", F.lit(step))).alias("_at"))
    return samples.select(
        F.timestamp_micros(F.col("_at") + step).alias("sampled_at_utc"),
        "readings_processed_total",
        F.when(F.col("_at") == F.col("_from"), F.col("_n") / F.lit(float(interval_seconds))).otherwise(0.0).alias("readings_per_second"),
        (F.col("_latency") / 1000).alias("latest_end_to_end_latency_ms"),
    )
