"""Document context: kind of document, domain, phrases, and what they add to a finding's confidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilstone.functions.documents import KINDS, LEAST, PHRASES, SIGNALS, adjustment_sql, document_domain, document_kind, phrase_score
from veilstone.functions.documents import KIND_SAMPLE as SAMPLE
from veilstone.functions.text import clamp, quoted

__all__ = ["KINDS", "LEAST", "PHRASES", "SAMPLE", "adjusted", "document_context", "document_facts"]


def document_context(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", name_col: str | None = None) -> DataFrame:
    """(doc_id, doc_kind, test_score, production_score, adjustment): one row for each document."""
    scores = {"test_score": "TestData", "production_score": "Production"}
    ctx = docs.select(F.col(quoted(id_col)).alias("doc_id"), document_kind(text_col, name_col).alias("doc_kind"), *[phrase_score(text_col, m).alias(k) for k, m in scores.items()])
    return ctx.withColumn("adjustment", F.expr(adjustment_sql("doc_kind", "test_score")))


def document_facts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, domain, a score for each meaning of phrases, a flag for each kind of record, sizes and shares of characters)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    count = lambda p: F.regexp_count(text, F.lit(p)).cast("long")
    share = lambda p: F.when(F.octet_length(text) > 0, count(p) / F.octet_length(text)).otherwise(0.0)
    scores = [phrase_score(text_col, m).alias(f"{m[0].lower()}{m[1:]}") for m in PHRASES]
    flags = [text.rlike(p).alias(f"{s[0].lower()}{s[1:]}") for s, p in SIGNALS.items()]
    sizes = [F.octet_length(text).cast("long").alias("n_bytes"), (count("\n") + 1).alias("n_lines"), *(count(p).alias(f"n_{k}") for k, p in (("commas", ","), ("tabs", "\t"), ("pipes", r"\|"), ("semicolons", ";")))]
    shares = [share("[0-9]").alias("digit_share"), share("[A-Za-z]").alias("letter_share"), share("[ \t]").alias("space_share")]
    return docs.select(F.col(id_col).alias("doc_id"), document_domain(text_col).alias("domain"), *scores, *flags, *sizes, *shares)


def adjusted(findings: DataFrame) -> DataFrame:
    """Findings with their documents' adjustment, below their ceiling, between 0 and 100; those at 0 go.

    What a document adds travels with its lines, so nothing is joined here.
    """
    score = F.col("confidence") + F.coalesce("adjustment", F.lit(0.0))
    total = clamp(F.least(score, F.coalesce("ceiling", F.lit(100.0))), 0, 100)
    return findings.withColumn("confidence", total).where(F.col("confidence") > 0).drop("adjustment")
