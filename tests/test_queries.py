"""Every registered query against its SQL on the smallest data set."""

import math
import os
from concurrent.futures import ThreadPoolExecutor

import duckdb
import pytest

import __spark_entry__ as contract
from wellstream.plans.queries import QUERIES as OWN

SF_DIR = os.environ.get("WELLSTREAM_TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLES = ({n: x for n, x in of.items() if n in OWN} for of in (contract.queries(), contract.oracle_sql()))


def normal(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return ""
    if isinstance(value, float):
        return repr(value + 0.0)
    return str(value)


def rows(table):
    columns = sorted(table.column_names)
    data = [table.column(c).to_pylist() for c in columns]
    return columns, sorted(tuple(normal(v) for v in row) for row in zip(*data, strict=True))


@pytest.fixture(scope="module")
def results(spark):
    def run(name):
        return name, QUERIES[name](spark, SF_DIR).toArrow()

    with ThreadPoolExecutor(4) as pool:
        return dict(pool.map(run, QUERIES))


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW events AS SELECT * FROM '{SF_DIR}/events.parquet'")
    return connection


@pytest.mark.parametrize("name", QUERIES)
def test_same_rows_as_sql(results, duck, name):
    assert rows(results[name]) == rows(duck.execute(ORACLES[name]).to_arrow_table())


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_entry(spark):
    counts = {(r.outcome, r.sequence_status): r.readings for r in contract.entry(spark).collect()}
    assert counts[("Published", "Baseline")] == 30
    assert counts[("Duplicate", None)] == 55
    assert counts[("Conflict", None)] == 41
