"""Registered queries over the driver's tables, with SQL for DuckDB that states the same in its own terms."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilstone.functions.documents import DOMAIN_SAMPLE, DOMAINS, ENVIRONMENTS, SIGNALS
from veilstone.functions.lines import lines
from veilstone.functions.tables import dealt, spread, written
from veilstone.functions.text import band, sql_text
from veilstone.operators import context, evaluate, explain, profiles, redact, report, suppress
from veilstone.operators import detectors as d
from veilstone.operators.labelled import LEGAL_AGAINST, LEGAL_WORDS, MARKS, PHONE_AGAINST, PHONE_WORDS, social_media
from veilstone.operators.overlap import outermost
from veilstone.plans.scan import detect, scan, scan_and_redact

#: Fixed moments, so that results don't depend on the day: of rules, and the last plausible year of a birth.
AS_OF, LAST_YEAR = "2024-06-01 00:00:00", 2025


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def _people(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """Text made from the keys of customers, the same in both engines; ``text`` is SQL that both read."""
    return dealt(spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey")).select(F.col("c_custkey").alias("doc_id"), F.expr(text).alias("text"))


SSN_VALUE = (
    "lpad(cast((c_custkey*7919)%665+1 as varchar(9)),3,'0') || '-' || lpad(cast(c_custkey%99+1 as varchar(9)),2,'0') || '-' || lpad(cast((c_custkey*31)%9999+1 as varchar(9)),4,'0')"
)
SSN_TEXT = f"CASE c_custkey % 3 WHEN 0 THEN 'employee ssn ' WHEN 1 THEN 'value ' ELSE 'order number ' END || {SSN_VALUE}"
CARD_VALUE = "'4532' || lpad(cast((c_custkey*104729)%1000000000000 as varchar(12)),12,'0')"
CARD_TEXT = f"CASE c_custkey % 3 WHEN 0 THEN 'card ' WHEN 1 THEN 'value ' ELSE 'serial ' END || {CARD_VALUE}"
MAIL_VALUE = "'user' || cast(c_custkey as varchar(12)) || '@acme' || cast(c_custkey%7 as varchar(2)) || 'corp.com'"
#: Several values in a text, of which some are labelled: numbers of orders aren't, nor are cards without a good check digit.
LABELLED_TEXT = f"{SSN_TEXT} || chr(10) || {CARD_TEXT} || chr(10) || 'contact ' || {MAIL_VALUE} || CASE c_custkey % 5 WHEN 0 THEN ' example' ELSE '' END"
VIN_TEXT = "CASE c_custkey % 3 WHEN 0 THEN 'vehicle id ' WHEN 1 THEN 'value ' ELSE 'sku ' END || '1HGCM8263A' || lpad(cast(c_custkey%10000000 as varchar(9)),7,'0')"
IP_TEXT = (
    "CASE c_custkey % 3 WHEN 0 THEN 'server ' WHEN 1 THEN 'value ' ELSE 'version ' END || cast(20+c_custkey%80 as varchar(9)) || '.' || cast((c_custkey*7)%256 as varchar(9)) || '.' || "
    "cast((c_custkey*13)%256 as varchar(9)) || '.' || cast(1+c_custkey%254 as varchar(9))"
)
ABA_TEXT = "CASE c_custkey % 2 WHEN 0 THEN 'bank routing ' ELSE 'value ' END || lpad(cast(21000000 + (c_custkey*7919)%9999999 as varchar(9)),9,'0')"
NPI_TEXT = "CASE c_custkey % 2 WHEN 0 THEN 'provider npi ' ELSE 'value ' END || cast(1000000000 + (c_custkey*7919777)%999999999 as varchar(10))"
DEA_TEXT = "CASE c_custkey % 2 WHEN 0 THEN 'prescriber dea ' ELSE 'value ' END || 'AB' || lpad(cast((c_custkey*7919)%10000000 as varchar(9)),7,'0')"
IBAN_TEXT = "CASE c_custkey % 2 WHEN 0 THEN 'iban ' ELSE 'value ' END || 'DE' || lpad(cast(c_custkey%98+2 as varchar(9)),2,'0') || lpad(cast(c_custkey*104729 as varchar(18)),18,'0')"
ARN_TEXT = "'resource arn:aws:iam::' || lpad(cast(c_custkey*7919 as varchar(12)),12,'0') || ':user/u' || cast(c_custkey as varchar(9)) || CASE c_custkey % 2 WHEN 0 THEN ' example' ELSE '' END"


_LETTERS = "translate(cast(c_custkey as varchar(9)), '0123456789', 'abcdefghij')"
NAME_TEXT = f"'Contact: Ka' || {_LETTERS} || ' Vo' || {_LETTERS} || CASE c_custkey % 4 WHEN 0 THEN ' arrived' WHEN 1 THEN ', vendor' ELSE '.' END"
#: Two profiles of one user at most nine lines apart, and one of another user.
PROFILE_TEXT = "'github.com/anna' || cast(c_custkey as varchar(9)) || repeat(chr(10), c_custkey % 10) || ' linkedin.com/in/anna-' || cast(c_custkey as varchar(9)) || chr(10) || 'twitter.com/zz' || cast(c_custkey as varchar(9))"
PLATFORMS = {"GITHUB": r"github\.com/[A-Za-z0-9-]{1,39}", "LINKEDIN": r"linkedin\.com/in/[A-Za-z0-9_-]{3,100}", "TWITTER": r"twitter\.com/[A-Za-z0-9_]{1,15}"}


def _result(findings: DataFrame) -> DataFrame:
    return findings.select("doc_id", F.col("line_number").cast("long").alias("line_number"), "start_col", "type", "text", "confidence").withColumn("start_col", F.col("start_col").cast("long"))


def _detector(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: _result(detect(_docs(spark, sf_dir), [name]))


def _on_people(name: str, text: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: _result(detect(_people(spark, sf_dir, text), [name]))


def scan_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: the detectors of values with shapes or check digits, with the documents' context."""
    found = scan(_docs(spark, sf_dir), ["CREDIT_CARD", "EMAIL", "SSN", "IP_ADDRESS", "VIN", "BANK_ACCOUNT", "MEDICAL_ID", "SECRETS", "CLOUD_RESOURCES"])
    return _result(found).withColumn("band", band(F.col("confidence")))


def scan_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every detector over every document."""
    return _result(scan(_docs(spark, sf_dir), last_year=LAST_YEAR))


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(_docs(spark, sf_dir)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.octet_length("line")).cast("long").alias("n_bytes"))


def document_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.document_context(_docs(spark, sf_dir))


def document_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.document_facts(_docs(spark, sf_dir))


def email_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _result(context.adjusted(detect(_docs(spark, sf_dir), ["EMAIL"])))


def outermost_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect(_docs(spark, sf_dir), ["CREDIT_CARD", "EMAIL", "SECRETS"])
    return outermost(found).select("doc_id", F.col("line_number").cast("long").alias("line_number"), "type", "text")


def _redacted(strategy: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        done = scan_and_redact(_people(spark, sf_dir, SSN_TEXT), ["SSN"], strategy)
        return done.select("doc_id", "redacted", F.col("n_redacted").cast("long").alias("n_redacted"))

    return query


def redact_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = scan_and_redact(_docs(spark, sf_dir), ["CREDIT_CARD", "EMAIL", "IP_ADDRESS", "SECRETS"], "format_preserving")
    return done.select("doc_id", "redacted", "n_redacted")


def finding_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.stats(detect(_docs(spark, sf_dir), ["CREDIT_CARD", "EMAIL"]))


def top_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = report.top(detect(_people(spark, sf_dir, CARD_TEXT), ["CREDIT_CARD"]), 20)
    return _result(found)


def detect_legal_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copyright, patent and trademark signs and secrecy notices in raw pages, whose copyright sign is written out."""
    pages = spread(spark.read.parquet(f"{sf_dir}/pages.parquet")).select(F.col("page_id").alias("doc_id"), F.replace("html", F.lit("&copy;"), F.lit("©")).alias("text"))
    return _result(detect(pages, ["INTELLECTUAL_PROPERTY"]))


def allowed_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Social security numbers of customers, beside rules by type, value and scope: which rule allows each, if one does."""
    found = detect(_people(spark, sf_dir, SSN_TEXT), ["SSN"])
    keys = spark.read.parquet(f"{sf_dir}/customer.parquet").where("c_custkey % 10 = 0")
    by_value = keys.select(F.col("c_custkey").alias("no"), F.lit("SSN").alias("type"), F.expr(SSN_VALUE).alias("value"), F.lit(None).cast("string").alias("scope"), F.lit("value").alias("reason"))
    by_scope = keys.limit(1).select(F.lit(10**9).cast("long").alias("no"), F.lit("SSN").alias("type"), F.lit(None).cast("string").alias("value"), F.lit("shard 3").alias("scope"), F.lit("scope").alias("reason"))
    rules = by_value.unionByName(by_scope)
    label = F.concat(F.lit("shard "), (F.col("doc_id") % 7).cast("string"))
    return suppress.ruled(found, rules, F.lit(AS_OF).cast("timestamp"), label).select("doc_id", "rule_no", F.coalesce("rule_reason", F.lit("none")).alias("rule_reason"))


def detect_names_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of customers by tables of names: of first names with even keys, and of last names with keys divisible by three."""
    table = lambda start, n: spark.read.parquet(f"{sf_dir}/customer.parquet").where(F.col("c_custkey") % n == 0).select(F.concat(F.lit(start), F.expr(_LETTERS)).alias("name"))
    return _result(detect(_people(spark, sf_dir, NAME_TEXT), ["PERSON_NAME"], names=(table("ka", 2), table("vo", 3))))


def profile_clusters_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    useful = lambda x: "(" + " OR ".join(f"{x} RLIKE {sql_text(p)}" for p in PLATFORMS.values()) + ")"
    found = social_media(lines(_people(spark, sf_dir, PROFILE_TEXT), only=useful, around=None), PLATFORMS)
    clusters = profiles.profile_clusters(found, list(PLATFORMS))
    return clusters.select("doc_id", *[F.col(c).cast("long").alias(c) for c in ("line_number", "last_line")], F.size("members").cast("long").alias("n_members"), "confidence")


def redaction_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redact.audit(detect(_docs(spark, sf_dir), ["CREDIT_CARD", "EMAIL"])).select("doc_id", F.col("n").cast("long").alias("n"), F.size("by_type").cast("long").alias("n_types"))


def suppressed_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third customer's finding has a rule; those with even keys have expired."""
    # written once, as the rules and both sides of the lookup read it
    found = written(detect(_people(spark, sf_dir, SSN_TEXT), ["SSN"]), "people-findings")
    as_of = F.lit(AS_OF).cast("timestamp")
    ruled = suppress.generate(found.where("doc_id % 3 = 0"), as_of - F.expr("INTERVAL 1 DAY")).join(
        suppress.hashed(found).select(F.col("finding_hash").alias("hash"), "doc_id"), "hash"
    )
    rules = ruled.withColumn("expires_at", F.when(F.col("doc_id") % 2 == 0, as_of - F.expr("INTERVAL 1 HOUR")).otherwise(F.col("expires_at"))).drop("doc_id")
    stay, gone = suppress.split(found, rules, as_of)
    return stay.select("doc_id", F.lit("active").alias("state")).unionByName(gone.select("doc_id", F.lit("suppressed").alias("state")))


def labelled_people(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text) of customers, and the spans in them that are to be found, with their value."""
    docs = dealt(spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey")).select(F.col("c_custkey").alias("doc_id"), F.expr(LABELLED_TEXT).alias("text"), *[F.expr(v).alias(k) for k, v in (("ssn", SSN_VALUE), ("card", CARD_VALUE), ("mail", MAIL_VALUE))])
    span = lambda by, value, types, least, is_one: F.when(is_one, F.struct(F.lit(by).alias("validator"), F.col(value).alias("value"), F.array(*map(F.lit, types)).alias("types"), F.lit(least).alias("min_band")))
    spans = [
        span("ssn", "ssn", ["SSN"], "HIGH", F.col("doc_id") % 3 != 2), span("creditcard", "card", ["VISA"], "MEDIUM", F.expr("luhn_check(card)")), span("email", "mail", ["BUSINESS", "EMAIL"], "HIGH", F.lit(True)),
    ]
    truth = docs.select("doc_id", "text", F.inline(F.array_compact(F.array(*spans))))
    truth = truth.select("doc_id", "validator", "value", "types", "min_band", (F.instr("text", F.col("value")) - 1).alias("start"), F.char_length("value").alias("length"))
    return docs.select("doc_id", "text"), truth


def detection_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the detectors find of labelled values, miss, and find besides, by detector and over all."""
    docs, truth = labelled_people(spark, sf_dir)
    return evaluate.quality(truth, detect(docs, ["SSN", "CREDIT_CARD", "EMAIL"]))


def redaction_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled values that stand in the redacted texts, by detector, beside how many there are."""
    docs, truth = labelled_people(spark, sf_dir)
    left = evaluate.leaks(truth, scan_and_redact(docs, ["SSN", "CREDIT_CARD", "EMAIL"], "format_preserving")).groupBy("validator").agg(F.count(F.lit(1)).alias("leaked"))
    return truth.groupBy("validator").agg(F.count(F.lit(1)).alias("labels")).join(left, "validator", "left").select("validator", "labels", F.coalesce("leaked", F.lit(0)).cast("long").alias("leaked"))


def explained_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = explain.explained(detect(_people(spark, sf_dir, CARD_TEXT), ["CREDIT_CARD"]))
    return found.select("doc_id", "type", "band", "verdict", "rationale")


def _report(kind: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = detect(_people(spark, sf_dir, CARD_TEXT), ["CREDIT_CARD"])
        return report.FORMATS[kind](found, F.concat(F.lit("customer/"), F.col("doc_id").cast("string"))).select("doc_id", "value")

    return query


def sarif_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.rules(detect(_docs(spark, sf_dir), ["CREDIT_CARD", "EMAIL"]))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "scan_documents": scan_documents,
    "scan_all": scan_all,
    "document_lines": document_lines,
    "detect_phone": _detector("PHONE"),
    "detect_intellectual_property": _detector("INTELLECTUAL_PROPERTY"),
    "detect_credit_card": _detector("CREDIT_CARD"),
    "detect_email": _detector("EMAIL"),
    "detect_ip_address": _detector("IP_ADDRESS"),
    "detect_secrets": _detector("SECRETS"),
    "detect_credit_card_customers": _on_people("CREDIT_CARD", CARD_TEXT),
    "detect_ssn_customers": _on_people("SSN", SSN_TEXT),
    "detect_ip_address_customers": _on_people("IP_ADDRESS", IP_TEXT),
    "detect_vin_customers": _on_people("VIN", VIN_TEXT),
    "detect_aba_customers": _on_people("BANK_ACCOUNT", ABA_TEXT),
    "detect_iban_customers": _on_people("BANK_ACCOUNT", IBAN_TEXT),
    "detect_npi_customers": _on_people("MEDICAL_ID", NPI_TEXT),
    "detect_dea_customers": _on_people("MEDICAL_ID", DEA_TEXT),
    "detect_cloud_customers": _on_people("CLOUD_RESOURCES", ARN_TEXT),
    "document_context": document_context,
    "document_facts": document_facts,
    "email_context": email_context,
    "outermost_spans": outermost_spans,
    "redact_simple_customers": _redacted("simple"),
    "redact_format_customers": _redacted("format_preserving"),
    "redact_documents": redact_documents,
    "finding_stats": finding_stats,
    "top_findings": top_findings,
    "redaction_audit": redaction_audit,
    "suppressed_findings": suppressed_findings,
    "explained_findings": explained_findings,
    "detect_legal_pages": detect_legal_pages,
    "detect_names_customers": detect_names_customers,
    "profile_clusters_customers": profile_clusters_customers,
    "allowed_findings": allowed_findings,
    "detection_quality": detection_quality,
    "redaction_leaks": redaction_leaks,
    "report_csv": _report("csv"),
    "report_json": _report("json"),
    "report_sarif": _report("sarif"),
    "report_gitlab": _report("gitlab-sast"),
    "report_junit": _report("junit"),
    "sarif_rules": sarif_rules,
}


# ---- the same in DuckDB -------------------------------------------------------------------------------------------


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _re(words: list[str], gap: str = "[ \\t_-]+") -> str:
    alts = "|".join(gap.join(re.escape(p) for p in w.split(" ")) for w in words)
    return _q(f"(^|[^a-z0-9])({alts})($|[^a-z0-9])")


def _has(words: list[str], gap: str = "[ \\t_-]+") -> str:
    return f"regexp_matches(lower, {_re(words, gap)})"


def _sum(words: list[str], each: float) -> str:
    return "(" + " + ".join(f"CASE WHEN {_has([w])} THEN {each} ELSE 0.0 END" for w in words) + ")"


#: What stands before a value and the line's head, the line's tail and what stands after the value.
_SEAM = (
    "lower(right(lead, 50)) || ' ' || left(lower, 64) || CASE WHEN length(lower) > 64 THEN '0' ELSE '' END || chr(7) || CASE WHEN length(lower) > 64 THEN '0' ELSE '' END || right(lower, 64) || ' ' || lower(left(after, 50)) AS seam"
)


def _near(words: list[str], on: float, beside: float, parted: bool = False) -> str:
    """An amount for each word of the line, another for each that only the seam has (parted: if it has several parts)."""
    reach = lambda w: f"WHEN regexp_matches(seam, {_re([w])}) THEN {beside}" if not parted or " " in w else ""
    return "(" + " + ".join(f"CASE WHEN {_has([w])} THEN {on} {reach(w)} ELSE 0.0 END" for w in words) + ")"


def _in(values: list[str]) -> str:
    return "(" + ", ".join(map(_q, values)) + ")"


def _table(name_value: str) -> str:
    count = lambda c: f"(length(line) - length(replace(line, {c}, '')))"
    return (
        f"(contains(line, chr(9)) OR {count(_q(','))} >= 2 OR {count(_q(';'))} >= 2 OR {count(_q('|'))} >= 2 "
        f"OR len(regexp_extract_all(line, '\\s{{2,}}')) >= 2 OR regexp_matches(line, {_q(name_value)}))"
    )


def _lines(source: str) -> str:
    return f"""l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS line_number FROM ({source})),
        w AS (SELECT *, lower(line) AS lower FROM l)"""


def _found(source: str, pattern: str, group: int, where: str, extra: str = "") -> str:
    """CTEs up to c: a row for each match of a pattern, with start_col from the text before its n-th occurrence."""
    return f"""WITH {_lines(source)},
        m AS (SELECT *, regexp_extract_all(line, {_q(pattern)}, {group}) AS found FROM w WHERE regexp_matches(line, {_q(pattern)})),
        u AS (SELECT * EXCLUDE (found), unnest(found) AS text, unnest(range(1, len(found) + 1)) AS nth, found FROM m),
        s AS (SELECT *, len(list_filter(found[:nth - 1], lambda x: x = text)) AS same_before FROM u),
        c AS (SELECT *, list_reduce(string_split(line, text)[:same_before + 1], lambda a, b: a || text || b) AS lead, strlen(lead) + 1 AS start_col,
              substr(line, length(lead) + length(text) + 1) AS after, right(lead, 1) AS b {extra} FROM s WHERE {where})"""


def _people_sql(text: str) -> str:
    return f"SELECT c_custkey AS doc_id, {text} AS text FROM customer"


DOCS = "SELECT doc_id, text FROM documents"
BORDER = "[\\s,;|\"'(){}\\[\\]<>=:]"


def _luhn(n: str) -> str:
    """Sum over the digits from the right, every second doubled."""
    return (
        f"(list_sum(list_transform(range(1, length({n}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN substr(reverse({n}), i, 1)::INT "
        f"WHEN substr(reverse({n}), i, 1)::INT >= 5 THEN substr(reverse({n}), i, 1)::INT * 2 - 9 ELSE substr(reverse({n}), i, 1)::INT * 2 END)) % 10 = 0)"
    )


def card_ctes(source: str) -> str:
    ranges = " OR ".join(f"substr(number, 1, 6)::INT BETWEEN {a} AND {b}" for a, b in d.CARD_RANGES)
    runs = "|".join(f"{i}{{12}}" for i in range(10))
    same = "|".join(f"^{i}{{14,16}}$" for i in range(10))
    return f"""{_found(source, f"(?:^|{BORDER})({'|'.join(d.CARD_SHAPES)})", 1, "true", ", regexp_replace(text, '[ -]', '', 'g') AS number")},
        k AS (SELECT *, (number IN {_in(d.CARD_TESTS)} OR regexp_matches(number, '{same}')) AS test,
              (regexp_matches(number, '{runs}') OR substr(repeat(substr(number, 1, 2), 10), 1, length(number)) = number OR contains('{d.UP}', number)) AS repeats,
              len(list_distinct(string_split(number, ''))) AS kinds, {_has(d.CARD_WORDS, " ")} AS card, {_has(d.CARD_NEVER, " ")} AS never, {_has(d.CARD_LABELS, " ")} AS label
              FROM c WHERE (after = '' OR regexp_matches(after, {_q("^" + BORDER)})) AND length(number) IN (13, 14, 15, 16, 19) AND regexp_matches(number, '^[0-9]+$') AND {_luhn("number")}),
        o AS (SELECT *, greatest(0, least(100, CASE WHEN test THEN 5.0 WHEN {ranges} THEN 75.0 ELSE 40.0 END + CASE WHEN repeats THEN -35.0 ELSE 10.0 END
              + CASE WHEN kinds < 5 THEN -20.0 WHEN kinds >= 7 THEN 10.0 ELSE 0.0 END)) AS own FROM k),
        p AS (SELECT *, greatest(0, least(100, CASE WHEN test OR repeats THEN greatest(5, least(15, own)) ELSE own END
              + CASE WHEN never OR (NOT card AND label) THEN -100.0 WHEN card THEN 15.0 ELSE 0.0 END + CASE WHEN {_table(d.CARD_NAME_VALUE)} THEN 10.0 ELSE 0.0 END)) AS total FROM o),
        f AS (SELECT doc_id, line_number, start_col::BIGINT AS start_col, text,
              CASE WHEN number LIKE '4%' THEN 'VISA' WHEN substr(number, 1, 2) BETWEEN '51' AND '55' THEN 'MASTERCARD' WHEN number LIKE '5%' THEN 'MAESTRO'
                   WHEN substr(number, 1, 2) IN ('34', '37') THEN 'AMERICAN_EXPRESS' WHEN number LIKE '35%' THEN 'JCB' WHEN substr(number, 1, 2) IN ('30', '36', '38') THEN 'DINERS_CLUB'
                   WHEN number LIKE '62%' THEN 'UNIONPAY' WHEN number LIKE '6%' THEN 'DISCOVER' WHEN substr(number, 1, 6) BETWEEN '222100' AND '272099' THEN 'MASTERCARD' ELSE 'CREDIT_CARD' END AS type,
              (CASE WHEN test OR repeats THEN greatest(1, least(15, total)) WHEN total <= 0 THEN 15.0 ELSE total END)::DOUBLE AS confidence FROM p)"""


def _or(column: str, parts: list[str], how: str) -> str:
    return "(" + " OR ".join(f"{how}({column}, {_q(p)})" for p in parts) + ")"


def email_ctes(source: str) -> str:
    providers = " ".join(f"WHEN domain IN {_in(v)} THEN {_q(k)}" for k, v in d.EMAIL_PROVIDERS.items())
    return f"""{_found(source, f"\\b{d.EMAIL}\\b", 0, "true", ", lower(text) AS t")},
        a AS (SELECT *, {_SEAM}, split_part(t, '@', 1) AS usr, split_part(t, '@', 2) AS domain, string_split(t, '.')[-1] AS top FROM c),
        o AS (SELECT *, 100.0 - CASE WHEN length(t) > 254 OR length(usr) > 64 OR length(domain) > 253 THEN 30 ELSE 0 END - CASE WHEN regexp_matches(domain, '^[.-]') THEN 100 ELSE 0 END
              - CASE WHEN domain IN {_in(d.EMAIL_TEST_DOMAINS)} OR regexp_matches(domain, '\\.(local|localhost|test|invalid|example)$') THEN 25 ELSE 0 END - CASE WHEN length(top) = 2 OR top IN {_in(d.TOP_LEVELS)} THEN 0 ELSE 10 END
              - CASE WHEN usr IN {_in(d.EMAIL_TEST_USERS)} THEN 20 ELSE 0 END + CASE WHEN contains(usr, '.') AND usr NOT LIKE '.%' AND usr NOT LIKE '%.' THEN 5 ELSE 0 END
              - CASE WHEN length(t) > 254 OR length(t) < 6 THEN 10 ELSE 0 END - CASE WHEN contains(t, '..') THEN 10 ELSE 0 END - CASE WHEN {_or("t", d.EMAIL_TEST_PARTS, "contains")} THEN 15 ELSE 0 END AS own FROM a),
        x AS (SELECT *, CASE WHEN regexp_matches(after, '^(@|[:/\\\\][^ \\t\\r])') THEN -100.0 ELSE greatest(-60, least(30, {_near(d.EMAIL_WORDS, 8.0, 4.0)} + {_near(d.EMAIL_AGAINST, -20.0, -10.0)})) END
              + CASE WHEN {_table(d.EMAIL_NAME_VALUE)} THEN 15.0 ELSE 0.0 END AS context FROM o),
        f AS (SELECT doc_id, line_number, start_col::BIGINT AS start_col, text, CASE {providers} WHEN {_or("domain", d.EMAIL_SCHOOLS, "suffix")} THEN 'EDUCATIONAL' WHEN {_or("domain", d.EMAIL_STATE, "suffix")} THEN 'GOVERNMENT'
              WHEN domain IN {_in(d.EMAIL_DISPOSABLE)} THEN 'DISPOSABLE' WHEN {_or("domain", d.EMAIL_COMPANY_PARTS, "contains")} OR {_or("domain", d.EMAIL_COMPANY_ENDS, "suffix")} OR length(split_part(domain, '.', 1)) > 3 THEN 'BUSINESS' ELSE 'EMAIL' END AS type,
              greatest(0, least(100, CASE WHEN regexp_matches(usr, {_q(d.EMAIL_MACHINES)}) THEN least(85, greatest(own, 0) + context) ELSE greatest(own, 0) + context END))::DOUBLE AS confidence FROM x WHERE greatest(own, 0) + context > 0)"""


SELECT = "SELECT doc_id, line_number, start_col, type, text, confidence FROM f"


def ssn_sql(source: str) -> str:
    """For lines without tables: a few words and one number."""
    fields = " + ".join(f"CASE WHEN {_has(words)} OR regexp_matches(seam, {_re([w for w in words if ' ' in w] or ['no such word'])}) THEN {boost} ELSE 0.0 END" for boost, words in d.SSN_FIELDS)
    runs = lambda n: "|".join(str(i) * n for i in range(10))
    return f"""{_found(source, r"\b([0-9]{3}-[0-9]{2}-[0-9]{4}|[0-9]{3}\s[0-9]{2}\s[0-9]{4}|[0-9]{9})\b", 1, "true", ", regexp_replace(text, '[^0-9]', '', 'g') AS number")},
        o AS (SELECT *, substr(number, 1, 3) AS area, substr(number, 4, 2) AS grp, substr(number, 6, 4) AS serial, contains(text, '-') AS dashes, {_sum(d.SSN_WORDS, 25.0)} AS positive, {_sum(d.SSN_AGAINST, 15.0)} AS negative, {_SEAM},
              (contains('{d.UP}', number) OR contains('{d.DOWN}', number)) AS runs FROM c),
        p AS (SELECT *, 85.0 + CASE WHEN dashes THEN 10 WHEN text = number THEN -15 ELSE 0 END - CASE WHEN runs THEN 15 ELSE 0 END
              - CASE WHEN regexp_matches(number, '{runs(3)}') OR area = grp || substr(grp, 1, 1) OR area = substr(serial, 1, 3) THEN 15 ELSE 0 END
              + greatest(-50, least(50, {_near(d.SSN_WORDS, 25.0, 10.0, True)} - {_near(d.SSN_AGAINST, 15.0, 8.0, True)} + {fields} - CASE WHEN runs OR regexp_matches(number, '{runs(4)}') OR {_has(d.SSN_MARKS)} THEN 40.0 ELSE 0.0 END)) AS total
              FROM o WHERE area NOT IN ('000', '666') AND area < '900' AND grp <> '00' AND serial <> '0000' AND number NOT IN {_in(d.SSN_TESTS)}),
        f AS (SELECT doc_id, line_number, start_col::BIGINT AS start_col, 'SSN' AS type, text,
              greatest(0, least(100, CASE WHEN positive > 0 THEN total WHEN negative > 0 THEN total - 25 WHEN dashes THEN least(60, total) ELSE least(50, total) END))::DOUBLE AS confidence FROM p)
        {SELECT} WHERE confidence > 0"""


def ip_sql(source: str) -> str:
    nets = []
    for net in d.IP_PLAIN:
        base, bits = net.split("/")
        x = 0
        for part in base.split("."):
            x = x * 256 + int(part)
        nets.append(f"(n >> {32 - int(bits)}) = {x >> (32 - int(bits))}")
    return f"""{_found(source, d.IPV4, 0, "true")},
        o AS (SELECT *, (split_part(text, '.', 1)::BIGINT * 16777216 + split_part(text, '.', 2)::BIGINT * 65536 + split_part(text, '.', 3)::BIGINT * 256 + split_part(text, '.', 4)::BIGINT) AS n, left(after, 1) AS a, left(after, 2) AS a2 FROM c),
        p AS (SELECT *, greatest(0, 110.0 + greatest(-80, least(40, {_sum(d.IP_WORDS, 12.0)} + {_sum(d.IP_AGAINST, -30.0)}))) AS total, {_has(d.IP_WORDS)} AS positive FROM o
              WHERE (b = '' OR NOT regexp_matches(b, '[0-9A-Za-z.:]')) AND NOT regexp_matches(a, '[0-9A-Za-z.]')
              AND NOT ({" OR ".join(nets)}) AND text NOT IN {_in(d.IP_RESOLVERS + d.IP_SAMPLES)} AND NOT regexp_matches(text, '(^|\\.)0[0-9]')),
        f AS (SELECT doc_id, line_number, start_col::BIGINT AS start_col, 'IP_ADDRESS' AS type, text, (CASE WHEN NOT positive AND NOT regexp_matches(after, '^(:[0-9]{{1,5}}|/[0-9]{{1,2}})\\b') AND total >= 90 THEN 75.0 ELSE least(100, total) END)::DOUBLE AS confidence
              FROM p WHERE total > 0 QUALIFY row_number() OVER (PARTITION BY doc_id, line_number, text ORDER BY start_col) = 1)
        {SELECT}"""


def vin_sql(source: str) -> str:
    value = f"CASE WHEN substr(number, i, 1) BETWEEN '0' AND '9' THEN substr(number, i, 1)::INT ELSE substr('{'12345678123457923456789'}', instr('ABCDEFGHJKLMNPRSTUVWXYZ', substr(number, i, 1)), 1)::INT END"
    return f"""{_found(source, r"\b[A-HJ-NPR-Za-hj-npr-z0-9]{17}\b", 0, "true", ", upper(text) AS number")},
        o AS (SELECT *, list_sum(list_transform(range(1, 18), lambda i: [8,7,6,5,4,3,2,10,0,9,8,7,6,5,4,3,2][i] * ({value}))) % 11 AS rest, substr(number, 1, 3) IN {_in(d.VIN_MAKERS)} AS maker, {_SEAM} FROM c),
        p AS (SELECT *, substr(number, 9, 1) = CASE WHEN rest = 10 THEN 'X' ELSE rest::INT::VARCHAR END AS good FROM o),
        f AS (SELECT doc_id, line_number, start_col::BIGINT AS start_col, 'VIN' AS type, text,
              greatest(0, least(100, 65.0 + CASE WHEN good THEN 20 ELSE -10 END + CASE WHEN maker THEN 10 ELSE 0 END + CASE WHEN regexp_matches(substr(number, 10, 1), '[A-HJ-NPR-TV-Y1-9]') THEN 5 ELSE 0 END
              + greatest(-50, least(50, {_near(d.VIN_WORDS, 25.0, 10.0)} + {_near(d.VIN_AGAINST, -15.0, -8.0)}))))::DOUBLE AS confidence
              FROM p WHERE number NOT IN {_in(d.VIN_TESTS)} AND regexp_matches(number, '[A-Z]') AND regexp_matches(number, '[0-9]') AND (good OR (maker AND NOT regexp_matches(number, '^[1-5]'))))
        {SELECT} WHERE confidence > 0"""


def _bank_context() -> str:
    return f"greatest(-50, least(40, {_sum(d.BANK_WORDS, 15.0)} + {_sum(d.BANK_AGAINST, -20.0)}))"


def bank_ctes(source: str) -> str:
    """All four kinds of numbers, on lines of any text: words for and against, postal lines, and their own checks."""
    flex = "[ \\t_-]*"
    routing = [w for w in d.BANK_WORDS if w not in ("routing", "routing number", "transit")]
    n = lambda words: "(" + " + ".join(f"{_has([w])}::INT" for w in words) + ")"
    lengths = " ".join(f"WHEN '{k}' THEN {v}" for k, v in d.IBAN_LENGTHS.items())
    digits = "list_reduce(list_transform(string_split(compact[5:] || compact[1:4], ''), lambda ch: CASE WHEN ch BETWEEN '0' AND '9' THEN ch ELSE (ascii(ch) - 55)::VARCHAR END), lambda a, b: ((a || b)::HUGEINT % 97)::VARCHAR)"
    s = lambda i: f"substr(text, {i}, 1)::INT"
    shapes = [
        ("IBAN", r"(?i)\b(?:[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}|[A-Z]{2}[0-9]{2}(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,4})?)\b"), ("SWIFT_BIC", r"\b[A-Z]{6}[A-Z0-9]{2}(?:[A-Z0-9]{3})?\b"),
        ("ABA_ROUTING", r"\b[0-9]{9}\b"), ("US_BANK_ACCOUNT", r"\b[0-9]{8,17}\b"),
    ]
    each = " UNION ALL ".join(f"SELECT * FROM ({_found(source, p, 0, 'true')} SELECT *, '{k}' AS type FROM c)" for k, p in shapes)
    return f"""WITH numbers AS ({each}),
        o AS (SELECT *, {_bank_context()} AS context, {_has(d.BANK_WORDS, flex)} AS banking, {n(d.BANK_WORDS)} AS n_for, {n(d.BANK_AGAINST)} AS n_against, {_has(["zip", "postal"])} AND NOT {_has(routing)} AS postal,
              {_has(d.BANK_PHONES)} AS phones, upper(replace(text, ' ', '')) AS compact, right(lead, 30) AS before FROM numbers),
        p AS (SELECT *, (n_for <= 1 AND n_against >= 3) OR (n_for = 0 AND n_against >= 2) OR (n_for <= 1 AND postal) AS refused FROM o),
        i AS (SELECT * FROM p WHERE type = 'IBAN' AND length(compact) = CASE substr(compact, 1, 2) {lengths} END AND substr(compact, 3, 2) NOT IN ('00', '01', '99')),
        q AS (SELECT *, CASE WHEN refused OR 85.0 + context <= 0 THEN 15.0 ELSE 85.0 + context END AS score FROM i WHERE {digits}::INT % 97 = 1
              UNION ALL SELECT *, CASE WHEN banking THEN 75.0 ELSE 50.0 END + context FROM p WHERE type = 'SWIFT_BIC' AND substr(text, 5, 2) IN {_in(d.COUNTRIES)} AND NOT refused
                        AND (banking OR (regexp_matches(text, '[0-9]') AND 50 + context >= 40))
              UNION ALL SELECT *, CASE WHEN banking THEN 70.0 ELSE 40.0 END + context FROM p WHERE type = 'ABA_ROUTING' AND NOT refused AND (banking OR 40 + context >= 50) AND text NOT IN {_in(d.ABA_TESTS)}
                        AND (3 * ({s(1)} + {s(4)} + {s(7)}) + 7 * ({s(2)} + {s(5)} + {s(8)}) + {s(3)} + {s(6)} + {s(9)}) % 10 = 0 AND (text[1:2]::INT BETWEEN 1 AND 32 OR text[1:2]::INT BETWEEN 61 AND 72 OR text[1:2] = '80')
              UNION ALL SELECT *, 55.0 + context + CASE WHEN regexp_matches(lower(before || text || left(after, 64)), 'account|acct') THEN 15.0 ELSE 0.0 END FROM p
                        WHERE type = 'US_BANK_ACCOUNT' AND banking AND NOT refused AND length(text) <> 9 AND NOT (length(text) BETWEEN 13 AND 17 AND {_luhn("text")})
                        AND NOT (length(text) = 10 AND (phones OR regexp_matches(right(lead, 6) || text || left(after, 2), '\\([0-9]{{3}}\\)\\s?[0-9]{{3}}[-.]?[0-9]{{4}}|[0-9]{{3}}[-.\\s][0-9]{{3}}[-.\\s][0-9]{{4}}')))
                        AND NOT regexp_matches(right(lead, 3) || text || left(after, 3), '[0-9]{{1,2}}[/-][0-9]{{1,2}}[/-][0-9]{{2,4}}|[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}')
                        AND NOT regexp_matches(right(lead, 10), '(?i)\\bv?[0-9]+\\.[0-9]+\\.[0-9]+|(^|[^a-z0-9])version($|[^a-z0-9])|\\bv\\.?[0-9]')),
        f AS (SELECT doc_id, line_number, start_col::BIGINT AS start_col, type, text, greatest(0, least(100, score))::DOUBLE AS confidence FROM q WHERE score > 0)"""


def medical_sql(source: str, pattern: str, check: str, kind: str, words: list[str], base: float, without: float) -> str:
    strong = _sum(d.MEDICAL_STRONG_AGAINST, 25.0)
    context = f"greatest(-60, least(40, {_sum(d.MEDICAL_WORDS, 10.0)} - {strong} + {_sum(d.MEDICAL_AGAINST, -15.0)}))"
    return f"""{_found(source, pattern, 0, check)},
        o AS (SELECT *, CASE WHEN {strong} > 0 THEN least(-25, {context}) ELSE {context} END AS context, CASE WHEN {_has(words)} THEN {base} ELSE {base - without} END AS own FROM c),
        f AS (SELECT doc_id, line_number, start_col::BIGINT AS start_col, '{kind}' AS type, text, (CASE WHEN own + context <= 0 THEN 15.0 ELSE least(100, own + context) END)::DOUBLE AS confidence FROM o)
        {SELECT}"""


def medical_label_sql(source: str) -> str:
    """Record numbers beside their words (no tables, no labels above)."""
    flex = "[ \\t_-]*"
    strong = _sum(d.MEDICAL_STRONG_AGAINST, 25.0)
    words = "(" + " + ".join(f"CASE WHEN {_has([w], flex)} THEN 10.0 ELSE 0.0 END" for w in d.MEDICAL_WORDS) + ")"
    context = f"greatest(-60, least(40, {words} - {strong} + {_sum(d.MEDICAL_AGAINST, -15.0)}))"
    shaped = f"length(text) = 9 OR (length(text) = 10 AND (text LIKE '1%' OR (text LIKE '2%' AND {_luhn("('80840' || text)")})))"
    return f"""{_found(source, r"\b[0-9]{6,10}\b", 0, _has(d.MEDICAL_LABELS["medical"], flex))},
        o AS (SELECT *, CASE WHEN {strong} > 0 THEN least(-25, {context}) ELSE {context} END AS context, {_has(d.MEDICAL_LABELS["mrn"], flex)} AS mrn FROM c WHERE NOT ({shaped}) AND NOT {_has(d.NOT_RECORDS)}),
        f AS (SELECT doc_id, line_number, start_col::BIGINT AS start_col, 'MRN' AS type, text, greatest(0, least(100, CASE WHEN mrn THEN 70.0 ELSE 45.0 END + context))::DOUBLE AS confidence FROM o WHERE mrn OR NOT {_has(d.NOT_RECORDS_SOFT)})
        {SELECT} WHERE confidence > 0"""


def cloud_sql(source: str) -> str:
    test = _has(["test", "example", "sample", "dummy", "mock", "fake", "placeholder"])
    return f"""{_found(source, d.CLOUD[0][0], 0, "true")},
        f AS (SELECT doc_id, line_number, start_col::BIGINT AS start_col, 'AWS_ARN' AS type, text, (95.0 - CASE WHEN length(text) < 20 THEN 10 ELSE 0 END - CASE WHEN {test} THEN 20 ELSE 0 END)::DOUBLE AS confidence FROM c)
        {SELECT}"""


def _kinds_sql() -> str:
    parts = ", ".join(f"{{'share': len(list_filter(cut, lambda x: regexp_matches(x, {_q(p)})))::DOUBLE / len(cut), 'kind': {_q(k)}}}" for k, (p, _) in context.KINDS.items())
    test = " + ".join(f"contains(low, {_q(w)})::INT" for w in context.PHRASES["TestData"])
    prod = " + ".join(f"contains(low, {_q(w)})::INT" for w in context.PHRASES["Production"])
    return f"""b AS (SELECT doc_id, string_split(substr(coalesce(text, ''), 1, {context.SAMPLE}), chr(10)) AS cut, lower(coalesce(text, '')) AS low FROM documents),
        g AS (SELECT doc_id, low, [{parts}] AS shares FROM b),
        h AS (SELECT doc_id, low, list_sort(shares, 'DESC')[1].share AS best, shares FROM g),
        ctx AS (SELECT doc_id, CASE WHEN best >= 0.3 THEN list_filter(shares, lambda x: x.share = best)[1].kind ELSE 'Unknown' END AS doc_kind,
              ({test})::DOUBLE / {len(context.PHRASES["TestData"])} AS test_score, ({prod})::DOUBLE / {len(context.PHRASES["Production"])} AS production_score FROM h),
        adj AS (SELECT *, (CASE WHEN doc_kind IN ('CSV', 'TSV', 'FixedWidth') THEN 20.0 ELSE 0.0 END - CASE WHEN test_score > 0.5 THEN 30.0 ELSE 0.0 END)::DOUBLE AS adjustment FROM ctx)"""


def _about_sql() -> str:
    """A document's environment and domain, over the CTEs of ``_kinds_sql``."""
    held = lambda low, words: " + ".join(f"contains({low}, {_q(w)})::INT" for w in words)
    env = ", ".join(f"({held('low', w)}) AS n_{k}" for k, w in ENVIRONMENTS.items())
    fields = ", ".join(f"{{'n': {held('cut', w)}, 'name': {_q(k)}}}" for k, w in DOMAINS.items())
    return f"""e0 AS (SELECT doc_id, lower(coalesce(text, '')) AS low, lower(substr(coalesce(text, ''), 1, {DOMAIN_SAMPLE})) AS cut FROM documents),
        e1 AS (SELECT doc_id, {env}, [{fields}] AS fields FROM e0),
        e2 AS (SELECT *, list_max(list_transform(fields, lambda x: x.n)) AS most, list_sum(list_transform(fields, lambda x: x.n)) AS every FROM e1),
        about AS (SELECT doc_id, CASE WHEN n_test > n_development AND n_test > n_production THEN 'test' WHEN n_development > n_production THEN 'development' WHEN n_production > 0 THEN 'production' ELSE 'unknown' END AS env,
              CASE WHEN most > 0 AND most >= 0.3 * every THEN list_filter(fields, lambda x: x.n = most)[1].name ELSE 'Unknown' END AS dom FROM e2)"""


def secret_ctes(source: str) -> str:
    """Quoted values that a name assigns, the only shape that the documents hold."""
    names = "|".join(d.SECRET_NAMES)
    share = "(len(list_filter(string_split(text, ''), lambda x: x = ch))::DOUBLE / length(text))"
    specific = " OR ".join(f"regexp_matches(text, {_q(p)})" for p, _, _ in d.TOKENS)
    amounts = lambda column, found: "CASE " + " ".join(f"WHEN {column} = {_q(k)} THEN {v}" for k, v in found.items()) + " ELSE 0.0 END"
    part = lambda words, n: "(" + " OR ".join(f"(contains(lower(text), {_q(w)}) AND length(text) <= {len(w) * n})" for w in words) + ")"
    return f"""{_found(source, f"(?i)(?:{names})[\"']?\\s*[=:]\\s*[\"']([^\"']{{8,}})[\"']", 1, "true")}, {_kinds_sql()}, {_about_sql()},
        e AS (SELECT *, -list_sum(list_transform(list_distinct(string_split(text, '')), lambda ch: {share} * log2({share}))) AS bits FROM c WHERE NOT ({specific})),
        f0 AS (SELECT e.*, greatest(0, least(100, greatest(0, 85.0 - CASE WHEN strlen(e.text) > 100 THEN 10 ELSE 0 END - CASE WHEN {part(d.SECRET_COMMON, 2)} THEN 20 ELSE 0 END - CASE WHEN {part(d.SECRET_TESTS, 3)} THEN 30 ELSE 0 END
              - CASE WHEN bits < 3 THEN 25 ELSE 0 END - CASE WHEN regexp_matches(e.text, '[ \\t]') THEN 15 ELSE 0 END)
              + adjustment + least(30, {amounts("env", d.BY_ENVIRONMENT)} + {amounts("dom", {"Financial": 12.0, "Healthcare": -5.0})} + {amounts("doc_kind", d.BY_KIND)}))) AS score
              FROM e JOIN adj USING (doc_id) JOIN about USING (doc_id)),
        f AS (SELECT doc_id, line_number, start_col::BIGINT AS start_col, text, 'API_KEY_OR_SECRET' AS type, score::DOUBLE AS confidence
              FROM f0 WHERE score > CASE WHEN regexp_matches(text, '^[0-9A-Fa-f]{{16,}}$') AND bits > 3 THEN 50 ELSE 60 END)"""


def phone_sql(source: str) -> str:
    """North American numbers with their area in brackets, the first shape tried and the only one that the documents hold (a country code before it makes the longer number a later, ruled out one)."""
    near = lambda words, a, b: " + ".join(f"CASE WHEN contains(line, {_q(w)}) THEN {a} WHEN contains(lower, {_q(w)}) THEN {b} ELSE 0.0 END" for w in words)
    return f"""{_found(source, r"(?:^|[\s,;|\"'<>])(\([0-9]{3}\)\s?[0-9]{3}[-.\s]?[0-9]{4})\b", 1, "true", ", regexp_replace(text, '[^0-9]', '', 'g') AS digits")},
        p AS (SELECT *, 105.0 - CASE WHEN length(digits) > 15 THEN 15 ELSE 0 END - CASE WHEN regexp_matches(digits, '^1?([0-9]{{3}})?55501[0-9]{{2}}$') THEN 20 ELSE 0 END - CASE WHEN regexp_matches(digits, '00000|11111|22222|33333|44444|55555|66666|77777|88888|99999') THEN 15 ELSE 0 END
              - CASE WHEN regexp_matches(digits, '01234|12345|23456|34567|45678|56789|98765|87654|76543|65432|54321|43210') THEN 15 ELSE 0 END AS own,
              greatest(-80, least(40, {near(PHONE_WORDS, 15.0, 8.0)} - CASE WHEN {_or("lower", PHONE_WORDS, "contains")} THEN 0 ELSE 20 END + {near(PHONE_AGAINST, -35.0, -18.0)}))
              + CASE WHEN {_table("[A-Z][a-z]+\\s+[A-Z][a-z]+\\s+\\(?[0-9]{3}")} THEN 15.0 ELSE 0.0 END AS context FROM c),
        q AS (SELECT *, greatest(0, least(100, own + context)) AS total FROM p),
        f AS (SELECT doc_id, line_number, start_col::BIGINT AS start_col, 'PHONE' AS type, text, (CASE WHEN regexp_matches(digits, '55501[0-9]{{2}}$') THEN least(15, total) ELSE total END)::DOUBLE AS confidence FROM q)
        {SELECT} WHERE confidence > 0"""


def legal_sql(source: str) -> str:
    """Copyright signs, one in a line: the pages hold no other mark."""
    near = lambda words, n: " + ".join(f"CASE WHEN contains(lower, {_q(w)}) THEN {n} ELSE 0.0 END" for w in words)
    return f"""{_found(source, MARKS["copyright"], 0, "true")},
        o AS (SELECT *, CASE WHEN contains(text, '©') THEN 90.0 ELSE 80.0 END - CASE WHEN regexp_matches(text, '[0-9]{{4}}') THEN 0 ELSE 20 END - CASE WHEN regexp_matches(text, '(Example|Sample|Test|Demo) Company') THEN 30 ELSE 0 END
              + greatest(-50, least(25, {near(LEGAL_WORDS, 7.0)} + {near(LEGAL_AGAINST, -15.0)})) AS score FROM c),
        f AS (SELECT doc_id, line_number, start_col::BIGINT AS start_col, 'INTELLECTUAL_PROPERTY' AS type, text, greatest(0, least(100, score))::DOUBLE AS confidence FROM o WHERE score > 0)
        {SELECT}"""


def facts_sql() -> str:
    scores = ", ".join("(" + " + ".join(f"contains(lower(t), {_q(w)})::INT" for w in words) + f")::DOUBLE / {len(words)} AS {m[0].lower()}{m[1:]}" for m, words in context.PHRASES.items())
    flags = ", ".join(f"regexp_matches(t, {_q(p)}) AS {s[0].lower()}{s[1:]}" for s, p in SIGNALS.items())
    counts = ", ".join(f"(length(t) - length(replace(t, {c}, '')))::BIGINT AS n_{k}" for k, c in (("commas", "','"), ("tabs", "chr(9)"), ("pipes", "'|'"), ("semicolons", "';'")))
    shares = ", ".join(f"CASE WHEN strlen(t) > 0 THEN len(regexp_extract_all(t, '{p}'))::DOUBLE / strlen(t) ELSE 0.0 END AS {k}_share" for k, p in (("digit", "[0-9]"), ("letter", "[A-Za-z]"), ("space", "[ \\t]")))
    return f"""WITH {_about_sql()}, d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
        SELECT doc_id, dom AS domain, {scores}, {flags}, strlen(t)::BIGINT AS n_bytes, (length(t) - length(replace(t, chr(10), '')) + 1)::BIGINT AS n_lines, {counts}, {shares} FROM d JOIN about USING (doc_id)"""


CARDS = card_ctes(_people_sql(CARD_TEXT))
_BAND = "CASE WHEN confidence >= 90 THEN 'HIGH' WHEN confidence >= 60 THEN 'MEDIUM' ELSE 'LOW' END"
_NAME = "'customer/' || doc_id::VARCHAR"
_BOTH = f"bth AS (SELECT * FROM ({card_ctes(DOCS)} SELECT * FROM f) UNION ALL SELECT * FROM ({email_ctes(DOCS)} SELECT doc_id, line_number, start_col, text, type, confidence FROM f))"

#: The other detectors of the flagship, each whole but for what the documents lack: tables around social security and members' numbers, compressed
#: IPv6 addresses, and secrets that no name tells.
_NPI = (r"\b[12][0-9]{9}\b", _luhn("('80840' || text)") + f" AND NOT {_has(d.MEDICAL_CONTEXTS['phones'])}", "NPI", d.MEDICAL_CONTEXTS["provider"], 80.0, 40.0)
_DEA = (
    r"\b[ABCDFGMabcdfgm][A-Za-z][0-9]{7}\b", "(text[3]::INT + text[5]::INT + text[7]::INT + 2 * (text[4]::INT + text[6]::INT + text[8]::INT)) % 10 = text[9]::INT", "DEA_NUMBER", d.MEDICAL_CONTEXTS["dea"],
    85.0, 30.0,
)
_OTHERS = [
    ip_sql(DOCS), f"{secret_ctes(DOCS)} SELECT * FROM f", ssn_sql(DOCS), vin_sql(DOCS), f"{bank_ctes(DOCS)} SELECT * FROM f", medical_sql(DOCS, *_NPI), medical_sql(DOCS, *_DEA), medical_label_sql(DOCS), cloud_sql(DOCS),
]

_LABELLED = f"SELECT c_custkey AS doc_id, {LABELLED_TEXT} AS text FROM customer"
_TRUTH = f"""k AS (SELECT c_custkey AS doc_id, {SSN_VALUE} AS ssn, {CARD_VALUE} AS card, {MAIL_VALUE} AS mail FROM customer),
        truth AS (SELECT doc_id, 'ssn' AS validator, ssn AS value, 90 AS least FROM k WHERE doc_id % 3 <> 2 UNION ALL SELECT doc_id, 'creditcard', card, 60 FROM k WHERE {_luhn("card")}
                  UNION ALL SELECT doc_id, 'email', mail, 90 FROM k)"""

ORACLE_SQL: dict[str, str] = {
    "detection_quality": f"""WITH {_TRUTH},
        found AS (SELECT doc_id, 'ssn' AS validator, text, confidence FROM ({ssn_sql(_LABELLED)}) UNION ALL SELECT doc_id, 'creditcard', text, confidence FROM ({card_ctes(_LABELLED)} SELECT * FROM f)
                  UNION ALL SELECT doc_id, 'email', text, confidence FROM ({email_ctes(_LABELLED)} SELECT * FROM f)),
        j AS (SELECT coalesce(t.validator, f.validator) AS validator, t.value, f.confidence AS c, least FROM truth t FULL JOIN found f ON t.doc_id = f.doc_id AND t.validator = f.validator AND t.value = f.text),
        n AS (SELECT validator, count(*) FILTER (WHERE value IS NOT NULL AND c >= least) AS tp, count(*) FILTER (WHERE value IS NOT NULL AND c >= 60) AS tp_medium,
                     count(*) FILTER (WHERE c IS NULL) AS fn_missed, count(*) FILTER (WHERE value IS NOT NULL AND c < least) AS fn_band, count(*) FILTER (WHERE value IS NULL AND c >= 60) AS fp_medium,
                     count(*) FILTER (WHERE value IS NULL AND c < 60) AS fp_low, 0::BIGINT AS extra FROM j GROUP BY ROLLUP (validator))
        SELECT *, CASE WHEN tp + fn_band + fn_missed = 0 THEN 1.0 ELSE (tp + fn_band)::DOUBLE / (tp + fn_band + fn_missed) END::DOUBLE AS recall_all,
               CASE WHEN tp + fn_band + fn_missed = 0 THEN 1.0 ELSE tp_medium::DOUBLE / (tp + fn_band + fn_missed) END::DOUBLE AS recall_medium,
               CASE WHEN tp_medium + fp_medium = 0 THEN 1.0 ELSE tp_medium::DOUBLE / (tp_medium + fp_medium) END::DOUBLE AS precision_medium FROM n""",
    "detect_names_customers": f"""WITH n AS (SELECT c_custkey AS k, {_LETTERS} AS w, 'Ka' || w || ' Vo' || w AS text FROM customer WHERE c_custkey % 3 = 0),
        o AS (SELECT *, CASE WHEN k % 2 = 0 THEN 92.0 ELSE 67.0 END - CASE WHEN regexp_matches(lower(text), 'abc|xyz|qwerty|asdf') THEN 10 ELSE 0 END
              - CASE WHEN regexp_matches(lower(text), 'aaa|bbb|ccc|ddd|eee|fff|ggg|hhh|iii|jjj|kkk|ooo') THEN 20 ELSE 0 END - CASE WHEN k % 4 = 1 THEN 15 ELSE 0 END AS score FROM n)
        SELECT k AS doc_id, 1::BIGINT AS line_number, 10::BIGINT AS start_col, 'PERSON_NAME' AS type, text, least(100, score)::DOUBLE AS confidence FROM o WHERE score >= 50""",
    "profile_clusters_customers": "SELECT c_custkey AS doc_id, 1::BIGINT AS line_number, (1 + c_custkey % 10)::BIGINT AS last_line, 2::BIGINT AS n_members, 60.0::DOUBLE AS confidence FROM customer WHERE c_custkey % 10 <= 6",
    "detect_legal_pages": legal_sql("SELECT page_id AS doc_id, replace(html, '&copy;', '©') AS text FROM pages"),
    "allowed_findings": f"""WITH s AS ({ssn_sql(_people_sql(SSN_TEXT))}), v AS (SELECT {SSN_VALUE} AS value, min(c_custkey) AS no FROM customer WHERE c_custkey % 10 = 0 GROUP BY 1)
        SELECT doc_id, coalesce(v.no, CASE WHEN doc_id % 7 = 3 THEN 1000000000 END)::BIGINT AS rule_no, CASE WHEN v.no IS NOT NULL THEN 'value' WHEN doc_id % 7 = 3 THEN 'scope' ELSE 'none' END AS rule_reason
        FROM s LEFT JOIN v ON v.value = s.text""",
    "redaction_leaks": f"WITH {_TRUTH} SELECT validator, count(*)::BIGINT AS labels, 0::BIGINT AS leaked FROM truth GROUP BY validator",
    "scan_documents": f"""WITH {_kinds_sql()}, {_BOTH},
        every AS (SELECT * FROM bth UNION ALL {" UNION ALL ".join(f"SELECT doc_id, line_number, start_col, text, type, confidence FROM ({q})" for q in _OTHERS)}),
        fin AS (SELECT doc_id, line_number, start_col, type, text, greatest(0, least(100, confidence + adjustment))::DOUBLE AS confidence FROM every JOIN adj USING (doc_id))
        SELECT *, {_BAND} AS band FROM fin WHERE confidence > 0""",
    "document_lines": "SELECT doc_id, len(string_split(coalesce(text, ''), chr(10)))::BIGINT AS n_lines, (strlen(coalesce(text, '')) - (len(string_split(coalesce(text, ''), chr(10))) - 1))::BIGINT AS n_bytes FROM documents",
    "detect_credit_card": f"{card_ctes(DOCS)} {SELECT}",
    "detect_email": f"{email_ctes(DOCS)} {SELECT}",
    "detect_ip_address": ip_sql(DOCS),
    "detect_secrets": f"{secret_ctes(DOCS)} {SELECT}",
    "detect_phone": phone_sql(DOCS),
    "detect_credit_card_customers": f"{CARDS} {SELECT}",
    "detect_ssn_customers": ssn_sql(_people_sql(SSN_TEXT)),
    "detect_ip_address_customers": ip_sql(_people_sql(IP_TEXT)),
    "detect_vin_customers": vin_sql(_people_sql(VIN_TEXT)),
    "detect_aba_customers": f"{bank_ctes(_people_sql(ABA_TEXT))} {SELECT}",
    "detect_iban_customers": f"{bank_ctes(_people_sql(IBAN_TEXT))} {SELECT}",
    "detect_npi_customers": medical_sql(_people_sql(NPI_TEXT), *_NPI),
    "detect_dea_customers": medical_sql(_people_sql(DEA_TEXT), *_DEA),
    "detect_cloud_customers": cloud_sql(_people_sql(ARN_TEXT)),
    "document_facts": facts_sql(),
    "document_context": f"WITH {_kinds_sql()} SELECT doc_id, doc_kind, test_score, production_score, adjustment FROM adj",
    "email_context": f"{email_ctes(DOCS)}, {_kinds_sql()} SELECT doc_id, line_number, start_col, type, f.text, greatest(0, least(100, confidence + adjustment))::DOUBLE AS confidence FROM f JOIN adj USING (doc_id)",
    "outermost_spans": f"""WITH {_BOTH}, every AS (SELECT *, start_col + strlen(text) AS end_col FROM (SELECT doc_id, line_number, start_col, text, type FROM bth
                  UNION ALL SELECT * FROM ({secret_ctes(DOCS)} SELECT doc_id, line_number, start_col, text, type FROM f)))
        SELECT doc_id, line_number, type, text FROM every a WHERE NOT EXISTS (SELECT 1 FROM every b WHERE a.doc_id = b.doc_id AND a.line_number = b.line_number
            AND b.start_col <= a.start_col AND a.end_col <= b.end_col AND b.end_col - b.start_col > a.end_col - a.start_col)""",
    "redact_simple_customers": f"""WITH s AS ({ssn_sql(_people_sql(SSN_TEXT))}), p AS ({_people_sql(SSN_TEXT)})
        SELECT p.doc_id, CASE WHEN s.doc_id IS NULL THEN p.text ELSE replace(p.text, s.text, '[SSN-REDACTED]') END AS redacted, (s.doc_id IS NOT NULL)::BIGINT AS n_redacted FROM p LEFT JOIN s USING (doc_id)""",
    "redact_format_customers": f"""WITH s AS ({ssn_sql(_people_sql(SSN_TEXT))}), p AS ({_people_sql(SSN_TEXT)})
        SELECT p.doc_id, CASE WHEN s.doc_id IS NULL THEN p.text ELSE replace(p.text, s.text, '***-**-' || right(s.text, 4)) END AS redacted, (s.doc_id IS NOT NULL)::BIGINT AS n_redacted FROM p LEFT JOIN s USING (doc_id)""",
    "finding_stats": f"WITH {_BOTH} SELECT type, {_BAND} AS band, count(*)::BIGINT AS n, max(confidence) AS most FROM bth GROUP BY CUBE (type, {_BAND})",
    "top_findings": f"{CARDS} {SELECT} ORDER BY confidence DESC, type, line_number, doc_id, text LIMIT 20",
    "redaction_audit": f"WITH {_BOTH} SELECT doc_id, count(*)::BIGINT AS n, count(DISTINCT type)::BIGINT AS n_types FROM bth GROUP BY doc_id",
    "suppressed_findings": f"WITH s AS ({ssn_sql(_people_sql(SSN_TEXT))}) SELECT doc_id, CASE WHEN doc_id % 3 = 0 AND doc_id % 2 = 1 THEN 'suppressed' ELSE 'active' END AS state FROM s",
    "explained_findings": f"""{CARDS} SELECT doc_id, type, {_BAND} AS band, CASE WHEN confidence >= 60 THEN 'likely_real' ELSE 'uncertain' END AS verdict,
        type || ' found with ' || lower({_BAND}) || ' confidence (' || format('{{:.0f}}', confidence) || '%) on line 1.' AS rationale FROM f""",
    "report_csv": f"{CARDS} SELECT doc_id, concat_ws(',', {_NAME}, type, {_BAND}, format('{{:.1f}}', confidence), line_number::VARCHAR, '[HIDDEN]') AS value FROM f",
    "report_json": f"""{CARDS} SELECT doc_id, '{{"text":"[HIDDEN]","line_number":' || line_number || ',"type":"' || type || '","confidence":' || confidence || ',"confidence_level":"' || {_BAND}
        || '","filename":"' || {_NAME} || '","validator":"creditcard"}}' AS value FROM f""",
    "report_sarif": f"""{CARDS} SELECT doc_id, '{{"ruleId":"' || type || '","level":"error","message":{{"text":"' || type || ' detected"}},"locations":[{{"physicalLocation":{{"artifactLocation":{{"uri":"' || {_NAME}
        || '"}},"region":{{"startLine":' || line_number || ',"startColumn":' || start_col || ',"endColumn":' || (start_col + strlen(text)) || '}}}}}}],"rank":' || least(100.0, 5.0 * 10 + 5.0 * (confidence / 10.0)) || '}}' AS value FROM f""",
    "report_gitlab": f"""{CARDS}, g AS (SELECT doc_id, type, 'veilstone-' || substr(sha256({_NAME} || ':1:' || type), 1, 16) AS id, CASE WHEN confidence >= 90 THEN 'Critical' WHEN confidence >= 60 THEN 'High' ELSE 'Medium' END AS severity FROM f)
        SELECT doc_id, '{{"id":"' || id || '","severity":"' || severity || '","name":"' || type || '","location":{{"file":"' || {_NAME} || '","start_line":1,"end_line":1}}}}' AS value FROM g""",
    "report_junit": f"{CARDS} SELECT doc_id, '<testcase name=\"' || {_NAME} || '\"><failure type=\"' || min(type) || '\" message=\"' || count(*)::VARCHAR || ' findings\"/></testcase>' AS value FROM f GROUP BY doc_id",
    "sarif_rules": f"WITH {_BOTH} SELECT type, max(CASE WHEN type IN {_in(redact.CARDS)} THEN 10 ELSE 5 END)::BIGINT AS weight, count(*)::BIGINT AS n FROM bth GROUP BY type",
}
