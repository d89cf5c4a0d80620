"""A sample of the registered queries against their SQL on the smallest tables."""

from pathlib import Path

import pytest

SF = "/root/testdata/sf0.001"
SAMPLE = [
    "read_pings", "read_raw_strings", "build_features", "trip_number_global", "audit_totals", "out_of_order",
    "adjacent_duplicates", "weight_verdict", "detect_stops", "evaluate", "eta_response", "stream_trips",
    "near_opt_candidates", "detection_lag",
]

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="test tables not present")


def test_every_query_has_a_callable_and_most_have_sql():
    from __spark_entry__ import oracle_sql, queries

    names, sql = set(queries()), set(oracle_sql())
    assert sql <= names and len(sql) >= 0.85 * len(names)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_sql(spark, name):
    from __spark_entry__ import oracle_sql, queries
    from workload.check import compare, connect

    assert compare(queries()[name](spark, SF), connect(SF), oracle_sql()[name]) == ""
