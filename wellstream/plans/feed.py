"""The processing chain over one feed of arrivals, as lazily built DataFrames."""

from __future__ import annotations

import uuid
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wellstream.operators import backfill, events, ingest, metrics, ordering, sessions, views, welllog
from wellstream.operators.slices import at_shares
from wellstream.session import configure, shared_folder, written
from wellstream.sources import derived, welllogs
from wellstream.streaming import microbatch, upgrade

CONFLICT_WINDOW_SECONDS = 12 * 3600
LOG_DEVICE = r"(DRILL-\d+)\.xml$"


class Feed:
    """Everything derived from typed arrivals: validation, outcomes, conflicts, events."""

    def __init__(self, arrivals: DataFrame, window_seconds: int = sessions.DEFAULT_WINDOW_SECONDS):
        self.arrivals = arrivals
        self.window_seconds = window_seconds

    @cached_property
    def validated(self) -> DataFrame:
        return ingest.validate(self.arrivals)

    @cached_property
    def rejects(self) -> DataFrame:
        return ingest.rejects(self.validated)

    @cached_property
    def readings(self) -> DataFrame:
        return ingest.valid_readings(self.validated)

    @cached_property
    def stored(self) -> DataFrame:
        return ordering.stored_only(self.readings)

    @cached_property
    def processed(self) -> DataFrame:
        return ordering.process(self.readings)

    @cached_property
    def published(self) -> DataFrame:
        """Published readings; the order alone decides, so no copies have to be compared."""
        return ordering.live_stream(self.readings)

    @cached_property
    def conflicts(self) -> DataFrame:
        return sessions.session_conflicts(ordering.first_arrivals(self.readings), self.window_seconds)

    @cached_property
    def event_stream(self) -> DataFrame:
        return events.event_stream(self.processed, self.rejects, self.conflicts)

    @cached_property
    def events(self) -> DataFrame:
        return events.events_table(self.event_stream)


class DerivedFeed(Feed):
    """The feed derived from the ``events`` table, with the inputs of the views, log and upgrade queries."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        configure(spark)
        self.spark, self.sf_dir = spark, sf_dir
        super().__init__(derived.arrivals(spark, sf_dir), CONFLICT_WINDOW_SECONDS)

    @cached_property
    def message_results(self) -> DataFrame:
        return ingest.validate(ingest.parse_messages(derived.raw_messages(self.spark, self.sf_dir)))

    @cached_property
    def broken(self) -> DataFrame:
        """Readings of which many break a rule."""
        return ingest.validate(derived.broken_readings(self.spark, self.sf_dir))

    @cached_property
    def burst_conflicts(self) -> DataFrame:
        """Conflicts at the default activity window."""
        return sessions.session_conflicts(derived.session_bursts(self.spark, self.sf_dir))

    @cached_property
    def metric_states(self) -> DataFrame:
        """States of M2 and M3 of the published readings in eight parts, as so many batches leave them."""
        published, states = written(self.published), None
        for part in range(8):
            own = metrics.metric_states(published.where(F.pmod("arrival_no", F.lit(8)) == part))
            states = own if states is None else states.unionByName(own)
        return states

    @cached_property
    def micro_batches(self) -> DataFrame:
        """What a streaming job over the arrivals as messages, in three batches by order of arrival, leaves in its table."""
        messages = written(derived.messages(self.arrivals))
        root = f"{shared_folder(self.spark)}/jobs/{uuid.uuid4().hex}"
        ends = at_shares(messages, "arrival_no", [1 / 3, 2 / 3])
        batch = F.when(F.col("arrival_no") <= ends[0], 0).when(F.col("arrival_no") <= ends[1], 1).otherwise(2)
        tables = microbatch.ReadingTables(self.spark, root)
        for number in range(3):
            microbatch.process_batch(tables, messages.where(batch == number), number, self.window_seconds)
        return tables.read("processed")

    # Originals and redeliveries: every arrival number ends in 0 or 3 for originals.
    @cached_property
    def baseline(self) -> DataFrame:
        return self.readings.where((F.col("arrival_no") % 10).isin(0, 3))

    @cached_property
    def incoming(self) -> DataFrame:
        return self.readings.where(~(F.col("arrival_no") % 10).isin(0, 3))

    @cached_property
    def table_before(self) -> DataFrame:
        return ordering.stored_only(self.baseline).where(F.col("sequence_number") % 4 != 0)

    @cached_property
    def merged(self) -> DataFrame:
        return views.merge_readings(self.baseline, self.incoming)

    @cached_property
    def active(self) -> DataFrame:
        return views.active_sessions(self.merged, derived.pinned_sessions(self.spark, self.sf_dir))

    @cached_property
    def displayed(self) -> DataFrame:
        return views.displayed_readings(self.merged, self.active)

    @cached_property
    def log_tokens(self) -> DataFrame:
        return written(welllogs.tokens(welllogs.split_pieces(derived.well_log_fragments(self.spark, self.sf_dir))))

    @cached_property
    def documents(self) -> DataFrame:
        device = F.regexp_extract("path", LOG_DEVICE, 1)
        return welllog.resolve(written(welllogs.documents(welllogs.header_texts(self.log_tokens), device)))

    @cached_property
    def lines(self) -> DataFrame:
        return welllog.join_lines(self.documents, welllogs.lines(self.log_tokens, self.documents))

    @cached_property
    def mapped(self) -> DataFrame:
        return welllog.map_lines(self.lines)

    @cached_property
    def log_rejects(self) -> DataFrame:
        return welllog.import_rejects(self.documents, self.mapped)

    @cached_property
    def upgraded(self) -> upgrade.UpgradedTables:
        """A folder with files of six versions, good and broken rows, upgraded in two runs; the second one finds three new versions."""
        rows = written(derived.broken_readings(self.spark, self.sf_dir))
        root = f"{shared_folder(self.spark)}/jobs/{uuid.uuid4().hex}"
        source, version = f"{root}/mixed", F.expr("arrival_no div 10 % 6 + 1")
        for run in ((1, 2, 3), (4, 5, 6)):
            for v in run:
                rows.where(version == v).select(
                    *backfill.columns_at(v), "received_at_utc", "arrival_no").write.mode("append").parquet(source)
            files = upgrade.read_mixed(self.spark, source)
            upgrade.start(files, f"{root}/upgraded", f"{root}/checkpoint").awaitTermination()
        return upgrade.UpgradedTables(self.spark, f"{root}/upgraded")

    def legacy(self, version: int) -> DataFrame:
        """The stored readings as a table of an older version held them."""
        return self.stored.select(*backfill.columns_at(version), "received_at_utc", "arrival_no")


__all__ = ["CONFLICT_WINDOW_SECONDS", "DerivedFeed", "Feed"]
