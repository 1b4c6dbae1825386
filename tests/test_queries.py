"""Every registered query next to its SQL on the smallest tables, and its plan."""

import duckdb
import pytest

import __spark_entry__ as driver
from glossmill.plans.catalogue import ORACLES, QUERIES
from tools.check_oracle import TABLES, compare

SLOW_TRAINING = {"v1_word_vectors", "v2_projection"}
NAMES = [n for n in QUERIES if n not in SLOW_TRAINING]


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, sf_dir, name):
    _, note = compare(spark, con, name, QUERIES[name], ORACLES[name], sf_dir)
    assert note.startswith("ok") and "TYPES" not in note, note


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - SLOW_TRAINING))
def test_no_unkeyed_joins(spark, sf_dir, name):
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_training_is_the_only_query_without_sql():
    assert set(QUERIES) - set(ORACLES) == SLOW_TRAINING


def test_the_driver_gets_all_queries():
    assert QUERIES.keys() <= driver.queries().keys() and ORACLES.keys() <= driver.oracle_sql().keys()


def test_entry(spark):
    assert driver.entry(spark).count() > 0
