"""Spans inside wider spans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def row_of(findings: DataFrame) -> list[str]:
    """The columns that tell whose a finding is: the id alone where findings come from elsewhere and have no doc_key."""
    return [c for c in ("doc_id", "doc_key") if c in findings.columns]


def outermost(findings: DataFrame) -> DataFrame:
    """Findings that no wider finding of their line holds strictly; equal and crossing spans stay.

    Sorted by start and then by end descending, a span lies in a wider one just if an earlier span ends
    where it does or later and is longer: the running largest end tells, without a self-join.  A line's
    findings are one window partition.
    """
    line = Window.partitionBy(*row_of(findings), "line_number")
    peers = Window.partitionBy(*row_of(findings), "line_number", "start_col")
    before = F.max("end_col").over(line.orderBy("start_col").rangeBetween(Window.unboundedPreceding, -1))
    marked = findings.withColumns({"before_end": before, "peer_end": F.max("end_col").over(peers)})
    inside = (F.coalesce("before_end", F.lit(-1)) >= F.col("end_col")) | (F.col("peer_end") > F.col("end_col"))
    return marked.where(~inside).drop("before_end", "peer_end")
