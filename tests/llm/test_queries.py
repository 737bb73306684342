"""Every query of the subpackage against the SQL that restates it, on the smallest tables."""

import pytest

from stavewright.llm.oracle import ORACLES
from stavewright.llm.queries import QUERIES
from tests.conftest import SMALL


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(name, same):
    same(QUERIES[name], ORACLES[name])


def test_shares_are_near_what_was_asked(spark):
    for r in QUERIES["p3_shares"](spark, SMALL).collect():
        if not r.reachable:
            assert r.used_tokens == r.max_repeats * r.n_tokens
        else:
            # Off by the documents landed, which are at most the longest two.
            assert abs(r.used_tokens - r.target_share * r.budget_tokens) <= 2 * 10000 and r.used_tokens <= r.max_repeats * r.n_tokens


def test_splits_part_no_group(spark):
    rows = QUERIES["p5_splits"](spark, SMALL).collect()
    assert len({(r.group_id, r.split) for r in rows}) == len({r.group_id for r in rows}) and len(rows) == spark.read.parquet(f"{SMALL}/scores.parquet").count()


def test_containers_hold_what_fits(spark):
    rows = QUERIES["p7_containers"](spark, SMALL).collect()
    load = {}
    for r in rows:
        assert (r.container is None) == (r.doc_tokens == 0) and r.end_token - r.start_token <= 2048
        load[r.container] = load.get(r.container, 0) + r.end_token - r.start_token
    assert max(load.values()) <= 2048
    total = sum(v for k, v in load.items() if k is not None)
    assert len([k for k in load if k is not None]) <= -(-total // 2048) + 1  # hardly anything is left empty
