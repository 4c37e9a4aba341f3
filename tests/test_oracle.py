"""Registered queries against their SQL. The slow ones run in tests/oracle_check.py."""

import re

import pytest
from oracle_check import compare, connect

import __spark_entry__ as entry

SF_DIR = "/root/testdata/sf0.001"
SLOW = ("robust", "joint_fit", "spectral_embedding", "compare", "riemann", "corrected", "agglomerate")
# the optional subpackage has tests of its own
OWN = re.compile(r"op\d+_|pipeline$")
NAMES = [n for n in entry.queries() if not n.startswith(SLOW) and not OWN.match(n)]


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    sql = entry.oracle_sql().get(name)
    assert compare(spark, con, name, entry.queries()[name], sql, SF_DIR) is None
    spark.catalog.clearCache()


def test_entry(spark):
    scores = {r["metric"]: r["value"] for r in entry.entry(spark).collect()}
    assert scores["accuracy"] == 1.0 and scores["ari"] == 1.0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
