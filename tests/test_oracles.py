"""Registered queries against their DuckDB oracles on the smallest tables.
The full set at sf0.01 runs with ``python tests/run_oracles.py``."""

import pytest

from harness import compare
from verba.plans import catalog

QUERIES = catalog.queries()
ORACLES = catalog.oracles()
# Everything except the streaming runs (covered in test_streaming.py).
FAST = [k for k in ORACLES if not k.startswith("stream_")]
# Texts are projected by hashes that SQL lacks: compared with a plain computation in test_scoring.py.
NO_SQL = {"classify_topic"}


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES) | NO_SQL


@pytest.mark.parametrize("key", FAST)
def test_query_matches_oracle(spark, sf, duck_small, key):
    r = compare(QUERIES[key](spark, sf), duck_small, ORACLES[key])
    assert r["hash_match"], r
