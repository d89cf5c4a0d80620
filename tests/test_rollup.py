"""The coverage roll-up tells totals from empty values."""

from haulcast.operators.audit import coverage_rollup

SCHEMA = "VIN string, Source string, Weight_lbs string, Speed string"


def test_levels_and_empty_values(spark):
    rows = [("a", "x", "1", ""), ("a", "x", "", "3"), ("a", "y", "2", "4"), ("", "x", "", ""), ("b", "", "5", "6"), (None, "x", None, None)]
    raw = spark.createDataFrame(rows, SCHEMA)
    got = {
        (r["level"], r["Source"], r["VIN"]): (r["n"], r["vehicles"], r["with_weight"], r["missing_speed"])
        for r in coverage_rollup(raw).collect()
    }
    assert got == {
        (0, "x", "a"): (2, 1, 1, 1), (0, "x", ""): (2, 0, 0, 2), (0, "y", "a"): (1, 1, 1, 0), (0, "", "b"): (1, 1, 1, 0),
        (1, "x", None): (4, 1, 1, 3), (1, "y", None): (1, 1, 1, 0), (1, "", None): (1, 1, 1, 0),
        (3, None, None): (6, 2, 3, 3),
    }
    assert coverage_rollup(raw.limit(0)).count() == 0
