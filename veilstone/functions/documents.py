"""What a whole document tells about the values in it: its kind, its domain, phrases, its environment.

Each is a handful of counts over the text, as column expressions without arrays of lines.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilstone.functions.text import count_sql, let_sql, quoted, sql_text

#: Patterns of a line by kind of document, in the order of their names, each also written for all lines of a
#: text at once (a match begins a line and stays in it).
KINDS = {
    "CSV": (r"^[^,]*,[^,]*,.*$", r"(?dm)^[^,\n]*,[^,\n]*,"),
    "Code": (r"(?i)(function|class|import|include|def\s)", r"(?dmi)^.*(?:function|class|import|include|def[ \t\r\f])"),
    "Configuration": (r"^[a-zA-Z_][a-zA-Z0-9_]*\s*[=:]\s*.*$", r"(?dm)^[a-zA-Z_][a-zA-Z0-9_]*[ \t\r\f]*[=:]"),
    "Email": (r"(?i)(from:|to:|subject:|date:)", r"(?dmi)^.*(?:from:|to:|subject:|date:)"),
    "FixedWidth": (r"^.{20,}\s{3,}.{20,}\s{3,}.*$", r"(?dm)^.{20,}[ \t\r\f]{3,}.{20,}[ \t\r\f]{3,}"),
    "JSON": (r"^\s*[\{\[].*[\}\]]\s*$", r"(?dm)^[ \t\r\f]*[\{\[].*[\}\]][ \t\r\f]*$"),
    "Log": (r"\d{4}-\d{2}-\d{2}[\sT]\d{2}:\d{2}:\d{2}", r"(?dm)^.*\d{4}-\d{2}-\d{2}[ \t\r\fT]\d{2}:\d{2}:\d{2}"),
    "Report": (r"(?i)(report|summary|total|subtotal|balance)", r"(?dmi)^.*(?:report|summary|total|subtotal|balance)"),
    "SQL": (r"(?i)\b(SELECT|INSERT|UPDATE|DELETE|CREATE|ALTER|DROP)\b", r"(?dmi)^.*\b(?:SELECT|INSERT|UPDATE|DELETE|CREATE|ALTER|DROP)\b"),
    "TSV": (r"^[^\t]*\t[^\t]*\t.*$", r"(?dm)^[^\t\n]*\t[^\t\n]*\t"),
    "XML": (r"<\?xml|<[a-zA-Z][^>]*>", r"(?dm)^.*(?:<\?xml|<[a-zA-Z][^>\n]*>)"),
}
#: Phrases by meaning; words by domain, in the order of the names (the first of equals counts).
PHRASES = {
    "PersonalData": ["personal information", "personally identifiable", "pii", "private data", "confidential", "sensitive information"],
    "FinancialData": ["financial information", "bank details", "account information", "payment data", "credit information", "financial records"],
    "MedicalData": ["medical information", "health records", "patient data", "medical history", "health information", "clinical data"],
    "TestData": ["test data", "sample data", "example", "dummy data", "mock data", "test case", "test scenario", "placeholder"],
    "Production": ["production", "live data", "real data", "actual", "operational", "customer data", "user data"],
}
DOMAINS = {
    "Education": ["student", "school", "university", "college", "education", "academic", "grade", "course", "curriculum", "teacher", "professor", "enrollment", "transcript", "ferpa", "student id"],
    "Financial": [
        "bank", "account", "transaction", "payment", "credit", "debit", "loan", "mortgage", "investment", "finance", "financial", "routing", "aba", "iban", "swift", "pci", "payment card",
    ],
    "Government": [
        "federal", "state", "government", "agency", "department", "public", "citizen", "taxpayer", "irs", "tax", "social security", "medicare", "veterans", "military", "passport", "immigration",
    ],
    "HR_Payroll": [
        "employee", "payroll", "salary", "wage", "benefits", "hr", "human resources", "personnel", "staff", "hire", "employment", "w2", "w-2", "1099", "tax", "withholding", "pto", "vacation",
    ],
    "Healthcare": [
        "patient", "medical", "hospital", "doctor", "nurse", "treatment", "diagnosis", "medication", "healthcare", "clinic", "physician", "medicare", "medicaid", "insurance", "health plan", "hipaa",
    ],
    "Retail": ["customer", "purchase", "order", "product", "inventory", "sale", "receipt", "refund", "shipping", "delivery", "merchant", "pos", "retail", "store", "warehouse"],
}
#: Records that speak for several detectors at once.
SIGNALS = {
    "EmployeeRecord": r"[A-Z][a-z]+\s+[A-Z][a-z]+\s+\d{3}-\d{2}-\d{4}", "CustomerDatabase": r"\d{4}-\d{4}-\d{4}-\d{4}.*\d{3}-\d{2}-\d{4}",
    "FinancialReport": r"(?i)(?:total|balance|amount|payment).*\$\d+",
}
ENVIRONMENTS = {
    "development": ["dev", "development", "staging", "stage", "local", "localhost", "sandbox", "preview"],
    "production": ["production", "prod-", "prod_", ".prod", "live", "release", "deploy", "stable", "node_env=production"],
    "test": ["test", "example", "sample", "demo", "mock", "fake", "dummy", "placeholder", "template", "tutorial", "readme", "documentation"],
}
SHELL = [
    "#!/bin/bash", "#!/bin/sh", "#!/usr/bin/env bash", "set -e", "set -x", "export ", "source ", ". ", "if [", "then", "fi", "for ", "while ", "do", "done", "echo ", "printf ", "curl ", "wget ",
]
#: Characters that the kind and the domain are judged by, and the least share that counts.
KIND_SAMPLE, DOMAIN_SAMPLE, LEAST = 2000, 5000, 0.3


def held(low: str, words: list[str]) -> str:
    """SQL for how many of the words a lower-cased text contains."""
    return "(" + " + ".join(f"int(contains({low}, {sql_text(w)}))" for w in words) + ")"


def best_of(counts: str, names: list[str], least: str) -> str:
    """SQL for the first name with the largest of some counts, if that is at least ``least``; else Unknown."""
    cases = " ".join(f"WHEN cs[{i}] = most AND most > 0 AND most >= {least} THEN {sql_text(n)}" for i, n in enumerate(names))
    return let_sql(counts, "cs", let_sql("array_max(cs)", "most", f"CASE {cases} ELSE 'Unknown' END"))


def _whole(text_col: str) -> str:
    return f"coalesce({quoted(text_col)}, '')"


def kind_sql(text_col: str, name_col: str | None = None) -> str:
    counts = "array(" + ", ".join(f"regexp_count(cut, {sql_text(p)})" for _, p in KINDS.values()) + ")"
    by_text = let_sql(f"substring({_whole(text_col)}, 1, {KIND_SAMPLE})", "cut", best_of(counts, list(KINDS), f"{LEAST} * ({count_sql('cut', chr(10))} + 1)"))
    if name_col is None:
        return by_text
    ends = " ".join(f"WHEN endswith(lower({quoted(name_col)}), '.{k.lower()}') THEN '{k}'" for k in ("CSV", "JSON", "XML"))
    return f"CASE {ends} ELSE {by_text} END"


def document_kind(text_col: str, name_col: str | None = None) -> Column:
    """The kind that most lines look like (0.3 of them at least; ties by name); file names decide first."""
    return F.expr(kind_sql(text_col, name_col))


def domain_sql(text_col: str) -> str:
    counts = "array(" + ", ".join(held("cut", w) for w in DOMAINS.values()) + ")"
    return let_sql(f"lower(substring({_whole(text_col)}, 1, {DOMAIN_SAMPLE}))", "cut", best_of(counts, list(DOMAINS), f"{LEAST} * aggregate(cs, 0, (p, q) -> p + q)"))


def document_domain(text_col: str) -> Column:
    """The domain that has most of its words in the text's beginning, and 0.3 of all domains' at least."""
    return F.expr(domain_sql(text_col))


def phrase_sql(text_col: str, meaning: str) -> str:
    return let_sql(f"lower({_whole(text_col)})", "low", f"double({held('low', PHRASES[meaning])}) / {len(PHRASES[meaning])}")


def phrase_score(text_col: str, meaning: str) -> Column:
    """Share of the phrases of a meaning that the text has."""
    return F.expr(phrase_sql(text_col, meaning))


def adjustment_sql(kind: str, test_score: str) -> str:
    """SQL for what of a document's calls reaches a finding: a table's +20 and test data's -30."""
    return f"greatest(-50D, least(50D, IF({kind} IN ('CSV', 'TSV', 'FixedWidth'), 20D, 0D) - IF({test_score} > 0.5, 30D, 0D)))"


def environment_sql(text_col: str) -> str:
    """SQL for test, development or production, by the words of each that the text has; else unknown."""
    counts = "array(" + ", ".join(held("low", ENVIRONMENTS[k]) for k in ("development", "production", "test")) + ")"
    pick = "CASE WHEN es[2] > es[0] AND es[2] > es[1] THEN 'test' WHEN es[0] > es[1] THEN 'development' WHEN es[1] > 0 THEN 'production' ELSE 'unknown' END"
    return let_sql(f"lower({_whole(text_col)})", "low", let_sql(counts, "es", pick))


def known(text_col: str, name_col: str | None = None) -> Column:
    """(doc_kind, adjustment) of a document: what every finding's score needs of it."""
    fields = f"'doc_kind', dk, 'adjustment', {adjustment_sql('dk', phrase_sql(text_col, 'TestData'))}"
    return F.expr(let_sql(kind_sql(text_col, name_col), "dk", f"named_struct({fields})"))


def about(text_col: str) -> Column:
    """(domain, environment, shell) of a document, for detectors that score by it."""
    shell = let_sql(f"lower({_whole(text_col)})", "low", f"{held('low', SHELL)} >= 2")
    return F.expr(f"named_struct('domain', {domain_sql(text_col)}, 'environment', {environment_sql(text_col)}, 'shell', {shell})")
