"""Usable and rejected requests come from one pass over the pings."""

import json


def test_both_outcomes_read_the_placed_requests_once(spark, tmp_path):
    from workload.queries import QUERIES

    kinds = ["view", "click", "purchase"]
    rows = [(k, f"2024-01-{1 + k // 4:02d} {k % 4 * 6:02d}:00:00", 1 + k % 2, kinds[k % 3], 60.0 + k, json.dumps({"k": k})) for k in range(1, 80)]
    events = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string")
    events.selectExpr("event_id", "cast(ts as timestamp_ntz) ts", "user_id", "event_type", "value", "props").write.parquet(f"{tmp_path}/events.parquet")
    found = QUERIES["batch_predict"](spark, str(tmp_path))
    assert "FileScan" not in found._jdf.queryExecution().executedPlan().toString()
    counts = {r["outcome"]: r["n"] for r in found.collect()}
    assert counts.get("Invalid JSON") == 1 and sum(counts.values()) > 10
