"""Every core query against the SQL that restates it; those without SQL return rows with a stable schema."""

import pytest

from stavewright.plans import compaction, reference, scores
from tests.conftest import SMALL

QUERIES = compaction.QUERIES | reference.QUERIES | scores.QUERIES
ORACLES = compaction.ORACLES | reference.ORACLES | scores.ORACLES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(name, same):
    same(QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows_only(name, spark):
    df = QUERIES[name](spark, SMALL)
    assert len(df.collect()) > 0
    assert df.schema == QUERIES[name](spark, SMALL).schema


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
