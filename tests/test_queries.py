import re

import duckdb
import pytest

import __spark_entry__ as entry
import check_oracles as check
from riskloom.plans.registry import COVERS, QUERIES

INVENTORY = {
    "SRC": 8, "SNK": 7, "PRJ": 6, "FLT": 9, "SCL": 18, "JN": 13, "AG": 20, "WN": 10, "TK": 7, "ST": 6, "AS": 11, "GR": 8,
    "ML": 16, "EV": 10, "EX": 8,
}


def test_every_inventory_row_has_a_query():
    covered = {i for ids in COVERS.values() for i in ids}
    wanted = {f"{group}{i}" for group, n in INVENTORY.items() for i in range(1, n + 1)}
    assert wanted <= covered, sorted(wanted - covered)
    assert covered <= wanted, sorted(covered - wanted)


def test_every_sql_check_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_query_names_are_plain():
    assert all(re.fullmatch(r"[a-z][a-z0-9_]+", n) for n in entry.queries())
    assert not any(re.match(r"op\d", n) for n in QUERIES)


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["FlightDate", "Origin", "origin_recent_delay_rate"] and df.count() > 0


@pytest.fixture(scope="module")
def con(sf_dir):
    connection: duckdb.DuckDBPyConnection = check.connect(sf_dir)
    yield connection
    connection.close()


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_its_sql(spark, con, sf_dir, name):
    result = check.compare(spark, con, name, sf_dir, entry.oracle_sql()[name])
    assert result.startswith("ok"), result
