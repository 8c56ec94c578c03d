"""Helpers that the operators share: numbering of rows, batches, names and schemas.

Everything that has to outlast an executor is written below the session's shared folder
(``veilstone.functions.tables``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

from veilstone.functions.tables import fresh_path, shared_dir, written
from veilstone.functions.text import quoted

__all__ = ["batches", "columns", "free_name", "fresh_path", "global_rank", "mapped", "partitions", "quoted", "shared_dir", "small_batches", "with_fields", "written"]


def free_name(df: DataFrame, *wanted: str) -> list[str]:
    """Names for helper columns that no column of ``df`` has, whatever the case of its letters."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession, rows: int = 256) -> None:
    """Bounds the rows of an Arrow batch, as documents can be long.

    For frames that are returned before they run: Spark reads the setting when they do, so it stays
    lowered in the session.  What an operator runs itself has ``batches`` instead.
    """
    if not 0 < int(spark.conf.get(BATCH)) <= rows:
        spark.conf.set(BATCH, rows)


@contextmanager
def batches(spark: SparkSession, rows: int = 256) -> Iterator[None]:
    """Arrow batches of at most ``rows`` rows for what runs inside; then the session's setting is back."""
    before = spark.conf.get(BATCH)
    spark.conf.set(BATCH, rows)
    try:
        yield
    finally:
        spark.conf.set(BATCH, before)


def columns(df: DataFrame, names: list[str] | None = None) -> list[Column]:
    """The columns of ``df`` (or those named) by their quoted names."""
    return [F.col(quoted(c)) for c in (df.columns if names is None else names)]


def with_fields(fields: list[StructField], **new: DataType) -> StructType:
    """A schema of kept fields, nested ones included as they are, and new ones."""
    return StructType([*fields, *(StructField(k, v) for k, v in new.items())])


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType) -> DataFrame:
    """``df.mapInArrow(run, schema)`` for columns of any name: it takes none with backticks, so columns travel by number."""
    names, given = df.columns, [f"c{i}" for i in range(len(df.columns))]
    out = StructType([StructField(f"c{i}", f.dataType, f.nullable) for i, f in enumerate(schema.fields)])

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in run(b.rename_columns(names) for b in batches):
            yield b.rename_columns(out.names)

    return df.toDF(*given).mapInArrow(inner, out).toDF(*schema.names)


def global_rank(df: DataFrame, order: list[Column], rank: str, group: str | None = None, name: str = "ranked") -> DataFrame:
    """``df`` with the 1-based position of each row within its ``group`` in the order of ``order``.

    No group is gathered in one task: rows are dealt by range of (group, order), sorted and written
    with their running number; the rows of each (partition, group) are counted, a prefix sum over
    these few counts gives where each piece begins, and the running number does the rest.
    """
    spark = df.sparkSession
    run, part = free_name(df, "run_no", "part_no")
    keys = ([F.col(group).asc_nulls_last()] if group else []) + order
    base = written(
        df.repartitionByRange(partitions(spark), *keys)
        .sortWithinPartitions(*keys)
        .withColumns({run: F.monotonically_increasing_id(), part: F.spark_partition_id()}),
        name,
    )
    first, count, before, same = free_name(base, "first_no", "count_no", "before_no", "group_no")
    pieces = base.groupBy(part, *([F.col(group).alias(same)] if group else [])).agg(F.min(run).alias(first), F.count(F.lit(1)).alias(count))
    w = (Window.partitionBy(same) if group else Window.partitionBy(F.lit(0))).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn(before, F.coalesce(F.sum(count).over(w), F.lit(0))).withColumnRenamed(part, part2 := free_name(base, "piece_no")[0])
    on = base[part] == pieces[part2]
    if group:
        on &= base[group].eqNullSafe(pieces[same])
    return base.join(pieces, on).withColumn(rank, F.col(run) - F.col(first) + F.col(before) + 1).select(*[base[quoted(c)] for c in df.columns], F.col(rank))
