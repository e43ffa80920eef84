"""Folders with files of several table versions."""

import pytest
from pyspark.sql import functions as F

from tests.helpers import T0, frame, reading
from wellstream.functions import predicates
from wellstream.operators import backfill
from wellstream.schemas import ARRIVAL_COLUMNS, READING_COLUMNS, READING_SCHEMA
from wellstream.streaming import ledger, upgrade


def rows_of(version, count=4):
    return [reading(sequence=n, arrival=version * 100 + n, at=n) for n in range(1, count + 1)]


def write(spark, folder, version, rows):
    columns = [*backfill.columns_at(version), *ARRIVAL_COLUMNS]
    frame(spark, rows).select(*columns).coalesce(1).write.mode("append").parquet(folder)


def run(spark, base, max_files=1000):
    files = upgrade.read_mixed(spark, f"{base}/mixed", max_files)
    query = upgrade.start(files, f"{base}/upgraded", f"{base}/checkpoint")
    query.awaitTermination()
    return sum(p["numInputRows"] for p in query.recentProgress)


def expected(version, row):
    """A row as the steps after its version leave it, in plain Python."""
    out = dict(zip(READING_SCHEMA.fieldNames(), row, strict=True))
    if version < 2:
        out |= {"well_id": "LEGACY-WELL", "wellbore_id": "LEGACY-WELLBORE", "measured_depth_metres": 0.0}
    if version < 3:
        out |= {"drilling_operation": "Stationary", "depth_change_rate_metres_per_hour": 0.0}
    if version < 4:
        out["gamma_ray_api"] = 0.0
    if version < 5:
        out |= {"well_name": f"Legacy well ({out['well_id']})", "wellbore_name": f"Legacy wellbore ({out['wellbore_id']})"}
    if version < 6:
        out["acquisition_mode"] = "RealTime"
    return tuple(out.values())


def found(tables):
    return sorted(tuple(r) for r in tables.readings().select(*READING_SCHEMA.fieldNames()).collect())


def test_files_of_all_versions_in_one_folder(spark, tmp_path):
    for version in range(1, 7):
        write(spark, f"{tmp_path}/mixed", version, rows_of(version))
    assert run(spark, tmp_path, max_files=4) == 24  # every row is read once
    tables = upgrade.UpgradedTables(spark, f"{tmp_path}/upgraded")
    assert found(tables) == sorted(expected(v, r) for v in range(1, 7) for r in rows_of(v))
    files = sorted((r.from_version, r.rows, r.rejected) for r in tables.upgraded_files().collect())
    assert files == [(v, 4, 0) for v in range(1, 7)]
    payload = tables.readings().where(F.col("payload.acquisition_mode") != F.col("acquisition_mode"))
    assert payload.count() == 0


def test_a_rerun_opens_new_files_only(spark, tmp_path):
    write(spark, f"{tmp_path}/mixed", 2, rows_of(2))
    assert run(spark, tmp_path) == 4
    tables = upgrade.UpgradedTables(spark, f"{tmp_path}/upgraded")
    before = set(tables.read("upgraded").inputFiles())
    assert run(spark, tmp_path) == 0
    write(spark, f"{tmp_path}/mixed", 6, rows_of(6, 3))
    write(spark, f"{tmp_path}/mixed", 1, rows_of(1, 2))
    assert run(spark, tmp_path) == 5
    assert before <= set(tables.read("upgraded").inputFiles())
    assert found(tables) == sorted(expected(v, r) for v, n in ((2, 4), (6, 3), (1, 2)) for r in rows_of(v, n))


@pytest.mark.parametrize("step", ["upgraded", "files", "commit"])
def test_a_failed_run_is_tried_again(spark, tmp_path, monkeypatch, step):
    for version in (1, 4):
        write(spark, f"{tmp_path}/mixed", version, rows_of(version))
    whole_write, whole_commit = ledger.Attempt.write, ledger.Attempt.commit

    def failing_write(self, table, rows):
        written = whole_write(self, table, rows)
        if table == step:
            raise OSError("lost")
        return written

    def failing_commit(self):
        raise OSError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(ledger.Attempt, "commit" if step == "commit" else "write", failing_commit if step == "commit" else failing_write)
        with pytest.raises(Exception, match="lost"):
            run(spark, tmp_path)
    tables = upgrade.UpgradedTables(spark, f"{tmp_path}/upgraded")
    assert found(tables) == []
    run(spark, tmp_path)
    assert found(tables) == sorted(expected(v, r) for v in (1, 4) for r in rows_of(v))
    assert tables.upgraded_files().count() == 2


def test_rows_that_break_a_rule_are_rejected(spark, tmp_path):
    good, bad = reading(sequence=1, arrival=1), reading(device=" ", sequence=2, arrival=2)
    unnamed = (*reading(sequence=3, arrival=3)[:4], "", *reading(sequence=3, arrival=3)[5:])
    no_mode = (*reading(sequence=4, arrival=4)[:14], None, T0, 4)
    write(spark, f"{tmp_path}/mixed", 6, [good, bad, unnamed, no_mode])
    run(spark, tmp_path)
    tables = upgrade.UpgradedTables(spark, f"{tmp_path}/upgraded")
    names = {r.arrival_no: (r.well_name, r.acquisition_mode) for r in tables.readings().collect()}
    assert names == {1: ("Well", "RealTime"), 3: ("Legacy well (W)", "RealTime"), 4: ("Well", "RealTime")}
    assert [(r.arrival_no, r.reject_reason) for r in tables.rejects().collect()] == [(2, predicates.BLANK_DEVICE)]
    assert [(r.from_version, r.rows, r.rejected) for r in tables.upgraded_files().drop("source_file").collect()] == [(6, 4, 1)]


def test_narrower_numbers_foreign_files_and_empty_folders(spark, tmp_path):
    folder = f"{tmp_path}/mixed"
    write(spark, folder, 1, [])
    assert run(spark, tmp_path) == 0
    old = frame(spark, rows_of(1)).select(*backfill.columns_at(1), *ARRIVAL_COLUMNS)
    old.withColumns({"sequence_number": F.col("sequence_number").cast("int"), "pressure_psi": F.col("pressure_psi").cast("float")}) \
        .coalesce(1).write.mode("append").parquet(folder)
    spark.range(3).coalesce(1).write.mode("append").parquet(folder)
    run(spark, tmp_path)
    tables = upgrade.UpgradedTables(spark, f"{tmp_path}/upgraded")
    assert found(tables) == sorted(expected(1, r) for r in rows_of(1))
    # A file with none of the columns is of version 0 and all of its rows are rejected.
    assert sorted((r.from_version, r.rows, r.rejected) for r in tables.upgraded_files().collect()) == [(0, 3, 3), (1, 4, 0)]


def test_version_of_a_row(spark):
    row = spark.createDataFrame([rows_of(1)[0]], READING_SCHEMA)
    for version in range(1, 7):
        kept = backfill.columns_at(version)
        old = row.select(*[F.col(c) if c in kept else F.lit(None).cast(row.schema[c].dataType).alias(c) for c in READING_COLUMNS])
        assert old.select(backfill.row_version()).first()[0] == version
