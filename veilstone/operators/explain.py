"""Why a finding is one: verdict and rationale as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilstone.functions.text import band, word_pattern

#: Words that tell of a test.
TEST_WORDS = ["test", "tests", "testing", "example", "sample", "dummy", "mock", "fake", "fixture", "placeholder", "demo"]


def verdict(confidence: Column, test: Column) -> Column:
    """real from 90; test data below 60 with a sign of a test; real from 60; else uncertain."""
    return F.when(confidence >= 90, "likely_real").when(test & (confidence < 60), "likely_test_data").when(confidence >= 60, "likely_real").otherwise("uncertain")


def explained(findings: DataFrame, name: Column | None = None) -> DataFrame:
    """Findings with band, verdict, rationale and a draft reason for suppressing them."""
    test = F.lower("line").rlike(word_pattern(TEST_WORDS))
    if name is not None:
        test |= F.lower(name).rlike(r"(?:^|[/_.-])(?:tests?|testdata|fixtures?|examples?|mocks?)(?:[/_.-]|$)")
    c = F.col("confidence")
    rows = findings.withColumn("test_sign", F.coalesce(test, F.lit(False))).withColumn("band", band(c)).withColumn("verdict", verdict(c, F.col("test_sign")))
    why = F.concat(
        F.col("type"), F.lit(" found with "), F.lower("band"), F.lit(" confidence ("), F.format_string("%.0f", c), F.lit("%) on line "), F.col("line_number").cast("string"),
        F.when(F.col("test_sign"), "; the line or path tells of test data").otherwise(""), F.lit("."),
    )
    reason = F.when(F.col("verdict") == "likely_test_data", F.concat(F.lit("Test data: "), F.col("type"))).otherwise(F.concat(F.lit("Reviewed: "), F.col("type")))
    return rows.withColumns({"rationale": why, "draft_reason": reason}).drop("test_sign")
