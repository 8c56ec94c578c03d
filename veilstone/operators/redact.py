"""Redaction: replacements by type, and one fold over the outermost spans of each document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilstone.functions.lines import text_key
from veilstone.functions.text import let, quoted
from veilstone.operators.overlap import outermost, row_of
from veilstone.operators.profiles import expanded

#: Which types share a label.
CARDS = ["CREDIT_CARD", "VISA", "MASTERCARD", "MAESTRO", "AMERICAN_EXPRESS", "JCB", "DINERS_CLUB", "DISCOVER", "UNIONPAY"]
MAILS = ["EMAIL", "GMAIL", "BUSINESS"]


def simple(kind: Column) -> Column:
    """A label that says what stood there."""
    label = F.when(kind.isin(CARDS), "CREDIT-CARD").when(kind.isin(MAILS), "EMAIL").when(kind == "SECRETS", "SECRET").when(kind == "IP_ADDRESS", "IP-ADDRESS").when(kind == "PERSON_NAME", "PERSON-NAME")
    return F.concat(F.lit("["), label.otherwise(kind), F.lit("-REDACTED]"))


def _last_four(text: Column, least: int) -> Column:
    digits = F.regexp_replace(text, r"[^0-9]", "")
    return F.when(F.char_length(digits) < least, F.repeat(F.lit("*"), F.octet_length(text))).otherwise(F.regexp_replace(text, r"[0-9](?=(?:[^0-9]*[0-9]){4})", "*"))


def format_preserving(text: Column, kind: Column) -> Column:
    """Stars, but for the last four digits, an address's first letter and domain, or two octets."""
    stars = F.repeat(F.lit("*"), F.octet_length(text))
    user, domain = F.substring_index(text, "@", 1), F.regexp_replace(text, r"^[^@]*", "")
    mail = F.when(~text.contains("@"), stars).when(F.char_length(user) <= 1, F.concat(F.lit("*"), domain))
    mail = mail.otherwise(F.concat(F.substring(user, 1, 1), F.repeat(F.lit("*"), F.octet_length(user) - 1), domain))
    parts = F.split(text, r"\.", -1)
    address = F.when(F.size(parts) == 4, F.concat(parts[0], F.lit("."), parts[1], F.lit(".*.*"))).otherwise(stars)
    return (
        F.when(kind.isin(CARDS), _last_four(text, 8))
        .when(kind.isin("SSN", "PHONE"), _last_four(text, 4))
        .when(kind.isin(MAILS), mail)
        .when(kind == "IP_ADDRESS", address)
        .otherwise(stars)
    )


def synthetic(text: Column, kind: Column, seed: int = 0) -> Column:
    """The shape of the value with other letters and digits, which depend on the seed and the value alone."""
    code = F.sha2(F.concat(F.lit(f"{seed}:"), kind, F.lit(":"), text), 256)
    pick = lambda i: F.conv(F.substring(code, (i % 60) + 1, 4), 16, 10).cast("long") + i * 7
    swap = lambda c, i: F.when(c.rlike("[0-9]"), (pick(i) % 10).cast("string")).when(c.rlike("[a-z]"), F.char(97 + pick(i) % 26)).when(c.rlike("[A-Z]"), F.char(65 + pick(i) % 26)).otherwise(c)
    return F.array_join(F.transform(F.filter(F.split(text, ""), lambda c: c != ""), swap), "")


def replacement(strategy: str, text: Column, kind: Column, seed: int = 0) -> Column:
    if strategy == "simple":
        return simple(kind)
    if strategy == "format_preserving":
        return format_preserving(text, kind)
    if strategy == "synthetic":
        return synthetic(text, kind, seed)
    raise ValueError(f"unknown strategy {strategy!r}: simple, format_preserving or synthetic")


#: Characters of a piece of a text; a span is cut from the few pieces it lies in.
PIECE = 1024


def _cut(pieces: Column, at: Column, size: Column) -> Column:
    """``size`` characters from ``at`` (from 0) of a text in pieces."""
    first = F.floor(at / PIECE).cast("int")
    last = F.floor((at + size - 1) / PIECE).cast("int")
    return F.when(size <= 0, F.lit("")).otherwise(F.substring(F.array_join(F.slice(pieces, first + 1, last - first + 1), ""), at % PIECE + 1, size))


def redact(docs: DataFrame, findings: DataFrame, strategy: str = "simple", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with redacted (the text) and n_redacted.

    Findings of every confidence are redacted; of spans inside wider ones the widest.  Spans that cross
    are replaced in order, a later one from where the earlier ends.  The text travels once, joined by
    row with its spans, and is put together from what lies between them in one pass.  A row is known
    by its id and a hash of its text, so null and repeated ids are fine, and rows that repeat both are
    redacted alike; of a cluster its members are; findings without doc_key go by the id alone, which must be unique then.
    """
    findings = expanded(findings)
    row = row_of(findings)
    spans = outermost(findings).dropDuplicates([*row, "line_number", "start_col", "end_col"])
    spans = spans.withColumns({"to": replacement(strategy, F.col("text"), F.col("type")), "end": F.col("start") + F.col("length")})
    earlier = Window.partitionBy(*row).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("from", F.coalesce(F.max("end").over(earlier), F.lit(0)))
    by_doc = spans.groupBy(*[F.col(c).alias(f"span_{c}") for c in row]).agg(F.array_sort(F.collect_list(F.struct("start", "end", "from", "to"))).alias("spans"))
    on = F.col(quoted(id_col)).eqNullSafe(F.col("span_doc_id"))
    if "doc_key" in row:
        on &= text_key(text_col) == F.col("span_doc_key")
    kept = docs.join(by_doc, on, "left")
    whole = F.coalesce(F.col(text_col), F.lit(""))

    def rebuilt(pieces: Column) -> Column:
        parts = F.transform("spans", lambda s: F.concat(_cut(pieces, s["from"], s["start"] - s["from"]), s["to"]))
        end = F.array_max(F.transform("spans", lambda s: s["end"]))
        return F.concat(F.array_join(parts, ""), let(end, lambda e: _cut(pieces, e, F.char_length(whole) - e)))

    text = F.when(F.col("spans").isNull(), whole).otherwise(let(F.split(whole, f"(?s)(?<=\\G.{{{PIECE}}})", -1), rebuilt))
    return kept.withColumns({"redacted": text, "n_redacted": F.coalesce(F.size("spans"), F.lit(0))}).drop("spans", *[f"span_{c}" for c in row])


def audit(findings: DataFrame) -> DataFrame:
    """(doc_id, counts by type, n): what was found in each document, without any value."""
    by = findings.groupBy("doc_id", "type").agg(F.count(F.lit(1)).alias("n"))
    return by.groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "n")))).alias("by_type"), F.sum("n").alias("n"))
