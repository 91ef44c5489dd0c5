"""Every registered query against its SQL counterpart at the smallest scale."""

import pytest
from oracle_check import compare

import __spark_entry__ as entry


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, sf_dir, name):
    assert compare(spark, name, sf_dir) is None


def test_entry(spark):
    row = entry.entry(spark).first()
    assert row["threads"] > 0 and 0 < row["escalation_rate"] < 1
