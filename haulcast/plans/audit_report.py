"""The full data-quality audit of one raw table."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import audit


def audit_report(raw: DataFrame) -> dict[str, DataFrame]:
    """All parts of the audit, by name; nothing runs until a part is used."""
    return {
        "missing_columns": audit.missing_columns(raw),
        "missingness": audit.missingness(raw),
        "totals": audit.audit_totals(raw),
        "adjacent_duplicates": audit.adjacent_duplicates(raw),
        "out_of_order_vins": audit.out_of_order_vins(raw),
        "top_vins": audit.extreme_vins(raw, most=True),
        "bottom_vins": audit.extreme_vins(raw, most=False),
        "coverage_extremes": audit.coverage_extremes(raw),
        "weight_verdict": audit.weight_verdict(raw),
    }
