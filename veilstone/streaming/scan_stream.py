"""Scanning a stream: the batch plan on each micro-batch, and windowed counts of findings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from veilstone.plans.scan import detect, scan_and_redact


def findings_stream(docs: DataFrame, checks: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Findings of a stream of documents: stateless, so any trigger and the append mode do."""
    return detect(docs, checks, id_col, text_col, reuse=False)


def redacting_writer(docs: DataFrame, path: str, checks: list[str], strategy: str = "simple", id_col: str = "doc_id", text_col: str = "text") -> DataStreamWriter:
    """Writes redacted documents as Parquet; a batch that is run again replaces its own folder."""

    def put(batch: DataFrame, number: int) -> None:
        scan_and_redact(batch, checks, strategy, id_col, text_col).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return docs.writeStream.foreachBatch(put)


def counts(findings: DataFrame, ts_col: str = "ts", every: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Findings by type in windows of event time, with a watermark for late rows."""
    return findings.withWatermark(ts_col, late).groupBy(F.window(ts_col, every).alias("period"), "type").agg(F.count(F.lit(1)).alias("n"))
