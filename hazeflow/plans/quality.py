"""The full audit of a feature table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from hazeflow.operators.audit import coverage, find_gaps, null_audit, summary_stats


@dataclass(frozen=True)
class Audit:
    coverage: DataFrame
    gaps: DataFrame
    nulls: DataFrame
    summary: DataFrame


def audit_table(df: DataFrame, cadence_hours: float = 1.0, threshold_hours: float = 1.5) -> Audit:
    """Give it a stored table: each part scans only the columns it needs."""
    columns = [c for c in df.columns if c != "day"]
    df = df.select(*columns)
    return Audit(
        coverage(df, cadence_hours), find_gaps(df, cadence_hours, threshold_hours), null_audit(df), summary_stats(df)
    )
