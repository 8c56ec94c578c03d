"""Texts made from the keys of customers: work in proportion to the table, on all cores, and once."""

from pyspark.sql import functions as F

from veilstone.operators import suppress
from veilstone.plans import queries


def test_one_row_group_is_dealt_over_all_cores(spark, tmp_path):
    """A file with one row group comes in several pieces, all but one of them empty."""
    spark.range(4000).select(F.col("id").alias("c_custkey")).coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    cores, before = spark.sparkContext.defaultParallelism, {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k in before:
            spark.conf.set(k, "1024")
        for docs in (queries._people(spark, str(tmp_path), queries.SSN_TEXT), queries.labelled_people(spark, str(tmp_path))[0]):
            sizes = [r["count"] for r in docs.groupBy(F.spark_partition_id()).count().collect()]
            assert len(sizes) >= cores and max(sizes) <= 4000 / cores and sum(sizes) == 4000
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_rules_and_lookup_detect_once(spark, sf_dir, monkeypatch):
    """The plan of the result reads written findings: none of it detects anything again."""
    seen = []
    monkeypatch.setattr(queries.suppress, "split", lambda found, rules, as_of: seen.extend([found, rules]) or suppress_split(found, rules, as_of))
    out = queries.suppressed_findings(spark, sf_dir)
    for df in (*seen, out):
        assert "customer.parquet" not in " ".join(df.inputFiles())
    assert {r["state"]: r["n"] for r in out.groupBy("state").agg(F.count(F.lit(1)).alias("n")).collect()} == {"active": 125, "suppressed": 25}


suppress_split = suppress.split


def test_no_filter_computes_a_score_once_more(spark, sf_dir):
    """What is asked of a score is asked of a generator's row: no filter has the words' lists that make it."""
    plan = queries.QUERIES["detect_ssn_customers"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "array_except" in plan
    assert not [line for line in plan.split("\n") if "Filter" in line[:40] and "array_except" in line]
