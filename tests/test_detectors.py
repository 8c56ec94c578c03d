"""Detectors on single lines, and the known results of whole texts."""

import pytest

from veilstone.functions.lines import lines
from veilstone.operators import redact, suppress
from veilstone.operators.metadata import metadata
from veilstone.operators.overlap import outermost
from veilstone.plans.scan import DETECTORS, checks_of, detect, scan, scan_and_redact

SCHEMA = "doc_id LONG, text STRING"


def run(spark, name, *texts):
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    rows = DETECTORS[name](lines(docs)).select("doc_id", "line_number", "type", "text", "confidence").collect()
    return sorted(tuple(r) for r in rows)


def test_cards(spark):
    got = run(spark, "CREDIT_CARD", "card 4532015112830366 here", "4532015112830367", "visa 4111111111111111", "a,4532015112830366,5425233430109903,b", "test 4532015112830366", "x4532015112830366")
    assert [r[0] for r in got] == [0, 2, 3, 3, 4]
    assert got[0][2:] == ("VISA", "4532015112830366", 100.0)
    assert got[1][4] == 15.0 and got[4][4] == 15.0
    assert {r[2] for r in got if r[0] == 3} == {"VISA", "MASTERCARD"}


def test_email_kinds(spark):
    got = run(spark, "EMAIL", "contact ann.lee@gmail.com", "write to bob@acmecorp.com", "git@github.com:org/repo", "x@y", "é")
    assert [(r[0], r[2]) for r in got] == [(0, "GMAIL"), (1, "BUSINESS")]


def test_ssn_rules(spark):
    got = run(spark, "SSN", "employee ssn 536-22-8726", "value 536-22-8726", "123-45-6789", "000-12-3456", "666-12-3456", "900-12-3456", "536-00-8726")
    assert [(r[0], r[4]) for r in got] == [(0, 100.0), (1, 60.0)]


def test_addresses_of_hosts(spark):
    assert [r[3] for r in run(spark, "IP_ADDRESS", "from 52.95.110.1 and 10.0.0.1, 8.8.8.8, 192.0.2.7", "1.2.3.4.5", "v52.95.110.1")] == ["52.95.110.1"]


def test_vin_and_bank_and_medical(spark):
    assert [r[4] for r in run(spark, "VIN", "vin 1HGCM82633A004352", "1HGCM82633A004353")] == [100.0]
    assert [r[2] for r in run(spark, "BANK_ACCOUNT", "iban DE89370400440532013000", "DE89370400440532013001", "GB82 WEST 1234 5698 7654 32")] == ["IBAN", "IBAN"]
    assert [r[2] for r in run(spark, "MEDICAL_ID", "npi 1234567893", "1234567890", "dea AB1234563", "medicare 1EG4-TE5-MK73")] == ["NPI", "DEA_NUMBER", "MEDICARE_MBI"]


def test_secrets_and_cloud(spark):
    key = "AKIA" + "IOSFODNN7ABCDEFG"
    got = run(spark, "SECRETS", f"id {key}", 'token = "a8f5f167f44f4964e6c998dee827110c"', 'name = "a8f5f167f44f4964e6c998dee827110c"')
    assert [(r[0], r[2], r[4]) for r in got] == [(0, "AWS_ACCESS_KEY", 94.0), (1, "API_KEY_OR_SECRET", 100.0), (2, "API_KEY_OR_SECRET", 55.0)]
    got = run(spark, "CLOUD_RESOURCES", "arn:aws:iam::123456789012:user/joe", "arn:aws:s3:::bucket-name-x/key", "projects/p1/zones/us-a/instances/i-1")
    assert [(r[2], r[4]) for r in got] == [("AWS_ARN", 95.0), ("AWS_ARN", 55.0), ("GCP_RESOURCE_NAME", 85.0)]


def test_labelled(spark):
    assert [r[0] for r in run(spark, "PHONE", "call me: +1 (415) 555-2671", "phone (212) 736-5000", "build 1234567890 checksum")] == [0, 1]
    assert [r[0] for r in run(spark, "DATE_OF_BIRTH", "date of birth: 1984-03-12", "born March 3, 1979", "created 2020-01-02", "dob 31/12/1990", "dob 13/13/1990")] == [0, 1, 3]
    assert [r[0] for r in run(spark, "DRIVERS_LICENSE", "drivers license D1234567", "D1234567")] == [0]
    assert [r[2] for r in run(spark, "OTP", "otpauth://totp/x?secret=MFRGGZDFMZTWQ2LK", "backup codes: wx12-yz34 ef56-gh78")] == ["OTPAUTH_URI", "RECOVERY_CODES", "RECOVERY_CODES"]
    assert len(run(spark, "PASSPORT", "L898902C36UTO7408122F1204159ZE184226B<<<<<10", "number X12345678")) == 1
    assert [r[2] for r in run(spark, "PHYSICAL_ADDRESS", "ship to 221 Baker Street, Springfield IL 62704", "P.O. Box 123", "PSC 3 Box 12, APO AE 09123")] == ["US_STREET_ADDRESS", "PO_BOX", "US_MILITARY_ADDRESS"]
    assert [r[0] for r in run(spark, "INTELLECTUAL_PROPERTY", "Copyright 2021 Acme Inc.", "plain words")] == [0]
    assert [r[3] for r in run(spark, "PERSON_NAME", "signed by Dr. Mary Johnson today", "Blue Horse")] == ["Dr. Mary Johnson"]
    assert run(spark, "SOCIAL_MEDIA", "linkedin.com/in/someone") == []


def test_scan_and_redaction(spark):
    docs = spark.createDataFrame([(1, "mail ann.lee@gmail.com\r\nssn 536-22-8726, again 536-22-8726\n"), (2, None), (3, ""), (4, "é 4532015112830366 ü\n\n")], SCHEMA)
    checks = ["EMAIL", "SSN", "CREDIT_CARD"]
    out = {r.doc_id: r for r in scan_and_redact(docs, checks).collect()}
    assert out[1].redacted == "mail [EMAIL-REDACTED]\r\nssn [SSN-REDACTED], again [SSN-REDACTED]\n" and out[1].n_redacted == 3
    assert out[4].redacted == "é [CREDIT-CARD-REDACTED] ü\n\n" and out[2].redacted == "" and out[3].n_redacted == 0
    kept = {r.doc_id: r.redacted for r in scan_and_redact(docs, checks, "format_preserving").collect()}
    assert kept[1] == "mail a******@gmail.com\r\nssn ***-**-8726, again ***-**-8726\n" and kept[4] == "é ************0366 ü\n\n"
    made = {r.doc_id: r.redacted for r in scan_and_redact(docs, checks, "synthetic").collect()}
    assert len(made[1]) == len(docs.first().text) and "536-22-8726" not in made[1]
    with pytest.raises(ValueError):
        redact.replacement("unknown", None, None)


def test_rows_are_told_apart_by_more_than_their_ids(spark):
    """Null ids, ids of two texts, and rows that repeat both: each row has its own findings and is redacted by them."""
    rows = [(None, "contact ann.lee@gmail.com"), (None, "ssn 536-22-8726 of ann"), (1, "xx yy zz write bob@acmecorp.com here"), (1, "contact ann.lee@gmail.com"), (2, "to cat@acmecorp.com"), (2, "to cat@acmecorp.com")]
    docs = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id LONG, text STRING, doc_key INT")
    for checks in (["EMAIL", "SSN"], ["EMAIL", "SSN", "SECRETS", "IP_ADDRESS", "PHONE", "INTELLECTUAL_PROPERTY"]):
        found = scan(docs, checks).where("type != 'PHONE'").collect()
        assert sorted((r.doc_id or 0, r.text) for r in found) == [(0, "536-22-8726"), (0, "ann.lee@gmail.com"), (1, "ann.lee@gmail.com"), (1, "bob@acmecorp.com"), (2, "cat@acmecorp.com"), (2, "cat@acmecorp.com")]
    mail, number = "[EMAIL-REDACTED]", "[SSN-REDACTED]"
    out = scan_and_redact(docs, ["EMAIL", "SSN"]).select("doc_id", "redacted", "n_redacted", "doc_key").collect()
    assert sorted((r.doc_id or 0, r.redacted) for r in out) == sorted([(0, f"contact {mail}"), (0, f"ssn {number} of ann"), (1, f"xx yy zz write {mail} here"), (1, f"contact {mail}"), (2, f"to {mail}"), (2, f"to {mail}")])
    assert all(r.n_redacted == 1 and r.doc_key == 7 for r in out)


def test_blocks_side_by_side(spark):
    begin, end = "-----" + "BEGIN CERTIFICATE-----", "-----" + "END CERTIFICATE-----"
    one = f"{begin}MIIabc{end}"
    docs = spark.createDataFrame([(1, f"top\n{one} {one} {begin}\nx\n{end} {one}\nlast {one}")], SCHEMA)
    got = sorted((r.line_number, r.start_col, r.text) for r in scan(docs, ["SECRETS"]).collect())
    n = len(one)
    assert got == [(2, 1, one), (2, n + 2, one), (2, 2 * n + 3, begin), (3, 1, "x"), (4, 1, end), (4, len(end) + 2, one), (5, 6, one)]


def test_overlap_drops_contained_spans_only(spark):
    rows = [(1, 1, 1, 10, "a"), (1, 1, 2, 5, "b"), (1, 1, 1, 10, "c"), (1, 1, 8, 12, "d"), (1, 2, 2, 5, "e"), (1, 1, 1, 4, "f")]
    found = spark.createDataFrame(rows, "doc_id LONG, line_number INT, start_col INT, end_col INT, text STRING")
    assert sorted(r.text for r in outermost(found).collect()) == ["a", "c", "d", "e"]


def test_rules(spark):
    from pyspark.sql import functions as F

    found = detect(spark.createDataFrame([(i, f"employee ssn 536-22-87{i:02d}") for i in range(1, 6)], SCHEMA), ["SSN"])
    now = F.lit("2024-01-08 00:00:00").cast("timestamp")
    rules = suppress.generate(found.where("doc_id < 4"), F.lit("2024-01-02 00:00:00").cast("timestamp"))
    assert sorted(r.id for r in rules.collect()) == ["SUP-00000001", "SUP-00000002", "SUP-00000003"]
    stay, gone = suppress.split(found, suppress.set_enabled(rules, ["SUP-00000001"], False), now)
    assert stay.count() == 3 and gone.count() == 2
    assert suppress.cleanup(rules, F.lit("2024-01-09 00:00:00").cast("timestamp")).count() == 0
    allowed = spark.createDataFrame([("SSN", "536-22-8701", None)], "type STRING, value STRING, expires_at TIMESTAMP")
    assert suppress.allow(found, allowed, now).count() == 4
    rules = spark.createDataFrame(
        [(5, "SSN", None, "b", "of b", None), (3, "SSN", "536-22-8702", "", "this one", None), (1, "SSN", None, None, "expired", "2023-01-01 00:00:00"), (2, "EMAIL", None, None, "other type", None)],
        "no INT, type STRING, value STRING, scope STRING, reason STRING, until STRING",
    ).withColumn("expires_at", F.col("until").cast("timestamp"))
    label = F.when(F.col("doc_id") % 2 == 0, "b").otherwise("a")
    got = {r.doc_id: r.rule_reason for r in suppress.ruled(found, rules, now, label).collect()}
    assert got == {1: None, 2: "this one", 3: None, 4: "of b", 5: None}
    assert sorted(r.doc_id for r in suppress.allow(found, rules, now, label).collect()) == [1, 3, 5]
    assert suppress.allow(found, rules.limit(0), now).count() == 5


def test_table_context_raises_confidence(spark):
    docs = spark.createDataFrame([(1, "people.csv", "example 4532015112830366"), (2, "people.txt", "example 4532015112830366")], "doc_id LONG, name STRING, text STRING")
    got = {r.doc_id: r.confidence for r in scan(docs, ["CREDIT_CARD"], name_col="name").collect()}
    assert got == {1: 35.0, 2: 15.0}


def test_checks():
    assert checks_of(None) == list(DETECTORS) and checks_of(["ssn", "EMAIL"]) == ["EMAIL", "SSN"]
    with pytest.raises(ValueError):
        checks_of(["nothing"])


def test_no_documents(spark):
    assert scan(spark.createDataFrame([], SCHEMA), ["EMAIL", "SSN"]).count() == 0


def test_one_long_line(spark):
    text = " ".join(f"u{i}@host{i}.com" for i in range(300))
    assert len(run(spark, "EMAIL", text)) == 300


def test_key_blocks_are_redacted_whole(spark):
    begin, end = "-----" + "BEGIN RSA PRIVATE KEY-----", "-----" + "END RSA PRIVATE KEY-----"
    docs = spark.createDataFrame([(1, f"é key {begin}\nMIIabc\nDEF=\n{end} tail\nlast"), (2, f"{begin}\nno end")], SCHEMA)
    out = {r.doc_id: r.redacted for r in scan_and_redact(docs, ["SECRETS"]).collect()}
    assert out[1] == "é key [SSH_PRIVATE_KEY-REDACTED]\n[SSH_PRIVATE_KEY-REDACTED]\n[SSH_PRIVATE_KEY-REDACTED]\n[SSH_PRIVATE_KEY-REDACTED] tail\nlast"
    assert out[2] == f"{begin}\nno end"


def test_metadata(spark):
    units = spark.createDataFrame([(1, "Creator: Ann Lee\nTitle: x\nGPS Latitude: 51.5\nGPS Longitude: 0.1\nLastModifiedBy: Bob Roe"), (2, None)], SCHEMA)
    got = metadata(units).select("line_number", "type", "text", "start_col", "confidence").collect()
    assert sorted(tuple(r) for r in got) == [(1, "AUTHOR_INFO", "Ann Lee", 10, 60.0), (3, "GPS", "51.5, 0.1", 15, 95.0), (4, "GPS", "0.1", 16, 95.0), (5, "LAST_MODIFIED_BY", "Bob Roe", 17, 60.0)]


def test_a_changed_line_is_not_suppressed(spark):
    from pyspark.sql import functions as F

    now = F.lit("2024-01-08 00:00:00").cast("timestamp")
    before = detect(spark.createDataFrame([(1, "employee ssn 536-22-8701 filed")], SCHEMA), ["SSN"])
    rules = suppress.generate(before, F.lit("2024-01-02 00:00:00").cast("timestamp"))
    after = detect(spark.createDataFrame([(1, "employee ssn 536-22-8701 leaked")], SCHEMA), ["SSN"])
    assert suppress.split(before, rules, now)[1].count() == 1 and suppress.split(after, rules, now)[1].count() == 0
    assert [r.n for r in suppress.hashed(before).select(F.size("hashes").alias("n")).collect()] == [2]


def test_redaction_of_crossing_spans_and_long_texts(spark):
    text = "\u00e9" * 3000 + " 12345 " + "x" * 2000 + "\nsecond 678 line\U0001F600 end"
    rows = [(1, 1, 3001, 5), (1, 1, 3003, 4), (1, 2, 5015, 3)]
    found = spark.createDataFrame(rows, "doc_id LONG, line_number INT, start INT, length INT").selectExpr("*", "start + 1 AS start_col", "start + length + 1 AS end_col", "'SSN' AS type", "'t' AS text")
    done = redact.redact(spark.createDataFrame([(1, text), (2, None)], SCHEMA), found).orderBy("doc_id").collect()
    mark = "[SSN-REDACTED]"
    assert done[0].redacted == text[:3001] + mark + mark + text[3007:5015] + mark + text[5018:] and done[0].n_redacted == 3
    assert done[1].redacted == "" and done[1].n_redacted == 0
