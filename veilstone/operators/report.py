"""Report formats and statistics, each a projection or one aggregation of findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilstone.functions.text import band

#: How sensitive a type is, and the severity of a band.
SENSITIVITY = {"SSN": 10, "PASSPORT": 10, "VIN": 6, "PHONE": 5, "IP_ADDRESS": 4}
BY_VALIDATOR = {"creditcard": 10, "secrets": 9, "cloud_resources": 7, "email": 5}


def priority(findings: DataFrame) -> list[Column]:
    """Order of reports: confidence descending, then type, line, document and text."""
    return [F.col("confidence").desc(), F.col("type"), F.col("line_number"), F.col("doc_id"), F.col("text")]


def top(findings: DataFrame, n: int = 200) -> DataFrame:
    """The first n findings in the order of reports (0: all); Spark keeps n rows of each task only."""
    ordered = findings.orderBy(*priority(findings))
    return ordered.limit(n) if n else ordered


def bands(findings: DataFrame, keep: list[str]) -> DataFrame:
    return findings.where(band(F.col("confidence")).isin([b.upper() for b in keep]))


def shown(text: Column, show_match: bool) -> Column:
    return text if show_match else F.lit("[HIDDEN]")


def safe_cell(value: Column) -> Column:
    """A cell that no spreadsheet takes for a formula, quoted where CSV needs it."""
    plain = F.when(value.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), value)).otherwise(value)
    return F.when(plain.rlike(r"[\",\r\n]"), F.concat(F.lit('"'), F.replace(plain, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(plain)


def csv_rows(findings: DataFrame, name: Column, show_match: bool = False) -> DataFrame:
    """A line for each finding: Filename,Type,Confidence Level,Confidence %,Line Number,Text."""
    cells = [safe_cell(name), safe_cell(F.col("type")), band(F.col("confidence")), F.format_string("%.1f", F.col("confidence")), F.col("line_number").cast("string"), safe_cell(shown(F.col("text"), show_match))]
    return findings.select("doc_id", F.concat_ws(",", *cells).alias("value"))


def json_rows(findings: DataFrame, name: Column, show_match: bool = False) -> DataFrame:
    body = F.struct(shown(F.col("text"), show_match).alias("text"), F.col("line_number"), F.col("type"), F.col("confidence"), band(F.col("confidence")).alias("confidence_level"), name.alias("filename"), F.col("validator"))
    return findings.select("doc_id", F.to_json(body).alias("value"))


def sensitivity() -> Column:
    kind, by = F.col("type"), F.col("validator")
    out = F
    for t, w in SENSITIVITY.items():
        out = out.when(kind == t, w)
    for v, w in BY_VALIDATOR.items():
        out = out.when(by == v, w)
    return out.otherwise(5)


def sarif_rows(findings: DataFrame, name: Column) -> DataFrame:
    """A SARIF 2.1 result for each finding, with region columns and rank."""
    rank = F.least(F.lit(100.0), 5.0 * sensitivity() + 5.0 * (F.col("confidence") / 10.0))
    region = F.struct(F.col("line_number").alias("startLine"), F.col("start_col").alias("startColumn"), F.col("end_col").alias("endColumn"))
    where = F.array(F.struct(F.struct(F.struct(name.alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation")))
    body = F.struct(F.col("type").alias("ruleId"), F.lit("error").alias("level"), F.struct(F.concat(F.col("type"), F.lit(" detected")).alias("text")).alias("message"), where.alias("locations"), rank.alias("rank"))
    return findings.select("doc_id", rank.alias("rank"), F.to_json(body).alias("value"))


def gitlab_rows(findings: DataFrame, name: Column) -> DataFrame:
    """A GitLab SAST vulnerability for each finding: id, severity and place."""
    level = F.when(F.col("confidence") >= 90, "Critical").when(F.col("confidence") >= 60, "High").otherwise("Medium")
    ident = F.concat(F.lit("veilstone-"), F.substring(F.sha2(F.concat_ws(":", name, F.col("line_number").cast("string"), F.col("type")), 256), 1, 16))
    place = F.struct(name.alias("file"), F.col("line_number").alias("start_line"), F.col("line_number").alias("end_line"))
    return findings.select("doc_id", ident.alias("id"), level.alias("severity"), F.to_json(F.struct(ident.alias("id"), level.alias("severity"), F.col("type").alias("name"), place.alias("location"))).alias("value"))


def xml_text(value: Column) -> Column:
    """A value as text or an attribute of XML."""
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        value = F.replace(value, F.lit(mark), F.lit(name))
    return value


def junit_cases(findings: DataFrame, name: Column) -> DataFrame:
    """A test case for each document with findings; its failure is their type, or SECURITY_FINDINGS of several."""
    by = findings.groupBy("doc_id", name.alias("name")).agg(F.count(F.lit(1)).alias("n"), F.min("type").alias("low"), F.max("type").alias("high"), F.max("confidence").alias("most"))
    kind = F.when(F.col("low") == F.col("high"), F.col("low")).otherwise("SECURITY_FINDINGS")
    return by.select("doc_id", "name", "n", kind.alias("failure"), F.concat(F.lit('<testcase name="'), xml_text(F.col("name")), F.lit('"><failure type="'), xml_text(kind), F.lit('" message="'), F.col("n").cast("string"), F.lit(' findings"/></testcase>')).alias("value"))


def rules(findings: DataFrame) -> DataFrame:
    """The types that occur, with their sensitivity: the rules of a SARIF report."""
    return findings.groupBy("type").agg(F.max(sensitivity()).cast("long").alias("weight"), F.count(F.lit(1)).alias("n"))


def stats(findings: DataFrame) -> DataFrame:
    """(type, band, n) with totals by type, by band, and of all: null stands for any."""
    return findings.withColumn("band", band(F.col("confidence"))).cube("type", "band").agg(F.count(F.lit(1)).alias("n"), F.max("confidence").alias("most"))


def exit_code(findings: DataFrame, incomplete: DataFrame | None = None, least: float = 90.0) -> int:
    """1 if there are findings of ``least`` or more (HIGH by default), else 3 if some input wasn't read whole, else 0."""
    if findings.where(F.col("confidence") >= least).limit(1).count():
        return 1
    return 3 if incomplete is not None and incomplete.limit(1).count() else 0


FORMATS = {"csv": csv_rows, "json": json_rows, "sarif": sarif_rows, "gitlab-sast": gitlab_rows, "junit": junit_cases}
