"""Every registered query against its SQL on the smallest data set."""

import os

import pytest

import __spark_entry__ as entry
import check
from clickweir.plans import oracle, queries as registered

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def db():
    return check.connect(SF)


def test_every_query_has_sql():
    assert set(registered.queries()) == set(oracle.oracle_sql())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", registered.queries())
def test_query(spark, db, name):
    assert check.compare(spark, db, SF, entry.queries()[name], oracle.oracle_sql()[name]) == ""


def test_session_must_be_utc(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        with pytest.raises(RuntimeError, match="timeZone"):
            registered.queries()["metrics_1min"](spark, SF)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_entry(spark):
    assert entry.entry(spark).count() > 0
