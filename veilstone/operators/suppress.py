"""Suppression rules: hashes of findings, rule management, and the two sides of the lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilstone.functions.tables import written
from veilstone.functions.text import BESIDE, quoted

RULES = "id STRING, hash STRING, reason STRING, enabled BOOLEAN, created_at TIMESTAMP, expires_at TIMESTAMP"


def _sha(x: Column) -> Column:
    return F.sha2(x, 256)


#: Detectors whose older rules knew no context; for the others such a rule would hide a new value on a changed line.
CONTEXTLESS = ["secrets", "PERSON_NAME", "cloud_resources"]


def _bytes(text: Column, size: int, end: bool) -> Column:
    """The first or last ``size`` bytes of a text."""
    raw = text.cast("binary")
    return F.substring(raw, F.greatest(F.lit(1), F.octet_length(raw) - size + 1) if end else F.lit(1), F.lit(size)).cast("string")


def finding_hash(name: Column | None = None, with_confidence: bool = False, with_context: bool = True) -> Column:
    """Identity of a finding: type, (confidence,) line (its first bytes), file, line number, hashes of context and value."""
    line = F.trim("line") if with_context else F.lit("")
    context = F.concat(_bytes(F.col("before"), BESIDE, True), _bytes(F.col("after"), BESIDE, False)) if with_context else F.lit("")
    file = F.substring_index(name, "/", -1) if name is not None else F.lit("")
    parts = [F.col("type"), *([F.format_string("%.2f", F.col("confidence"))] if with_confidence else []), line, file, F.col("line_number").cast("string"), _sha(context), _sha(F.col("text"))]
    return _sha(F.concat_ws("|", *parts))


def hashed(findings: DataFrame, name: Column | None = None) -> DataFrame:
    """Findings with the hashes that a rule may have: today's first, then the older forms."""
    known = [finding_hash(name), finding_hash(name, True)]
    older = [finding_hash(name, c, False) for c in (False, True)]
    forms = F.when(F.col("validator").isin(CONTEXTLESS), F.array(*known, *older)).otherwise(F.array(*known))
    return findings.withColumn("hashes", forms).withColumn("finding_hash", F.col("hashes")[0])


def active(rules: DataFrame, as_of: Column) -> DataFrame:
    return rules.where(F.col("enabled") & (F.col("expires_at").isNull() | (F.col("expires_at") > as_of)))


def split(findings: DataFrame, rules: DataFrame, as_of: Column, name: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(findings that stay, findings that a rule suppresses, with rule_id and reason).

    A rule counts if it is enabled and not expired at ``as_of``.  The first form of hash that has a rule
    decides, then the smallest id.  Rules join by their hash; Spark broadcasts them only while small.
    """
    # written once: the rules, their hashes and both results read the findings, which cost a scan of the texts
    rows = written(hashed(findings, name).withColumn("finding_no", F.monotonically_increasing_id()), "hashed-findings")
    each = rows.select("finding_no", F.posexplode("hashes").alias("form", "hash"))
    found = each.join(active(rules, as_of).select("hash", F.col("id").alias("rule_id"), "reason"), "hash")
    first = Window.partitionBy("finding_no").orderBy("form", "rule_id")
    found = written(found.withColumn("n", F.row_number().over(first)).where("n = 1").select("finding_no", "rule_id", "reason"), "suppressed-findings")
    stay = rows.join(found, "finding_no", "left_anti").drop("finding_no", "hashes")
    return stay, rows.join(found, "finding_no").drop("finding_no", "hashes")


def generate(findings: DataFrame, created_at: Column, days: int = 7, first_no: int = 1, name: Column | None = None) -> DataFrame:
    """A rule for each distinct finding, enabled, that expires after some days; ids SUP-00000001 on.

    Ids follow the order of the hashes; each is its place in a distributed sort, so nothing is gathered.  The hashes
    are written once, as they are read for the counts and for the places.
    """
    distinct = written(hashed(findings, name).groupBy(F.col("finding_hash").alias("hash")).agg(F.min(F.concat(F.lit("Reviewed "), F.col("type"))).alias("reason")), "reviewed-findings")
    dealt = distinct.withColumn("part", F.substring("hash", 1, 3))
    counts = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("c"))
    before = F.coalesce(F.sum("c").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = dealt.join(counts.withColumn("before", before), "part").withColumn("no", F.row_number().over(Window.partitionBy("part").orderBy("hash")) + F.col("before"))
    return placed.select(
        F.format_string("SUP-%08d", F.col("no") + first_no - 1).alias("id"), "hash", "reason", F.lit(True).alias("enabled"), created_at.alias("created_at"),
        (created_at + F.make_interval(days=F.lit(days))).alias("expires_at"),
    )


def set_enabled(rules: DataFrame, ids: list[str], enabled: bool) -> DataFrame:
    return rules.withColumn("enabled", F.when(F.col("id").isin(ids), F.lit(enabled)).otherwise(F.col("enabled")))


def remove(rules: DataFrame, ids: list[str]) -> DataFrame:
    return rules.where(~F.col("id").isin(ids))


def cleanup(rules: DataFrame, as_of: Column) -> DataFrame:
    """Rules that haven't expired."""
    return rules.where(F.col("expires_at").isNull() | (F.col("expires_at") > as_of))


#: Parts that the findings of one type are dealt into where they meet the rules, which are few and go to each part.
SALTS = 16


def _rule_key(kind: Column, value: Column, scope: Column) -> Column:
    """What a rule and a finding have to share; null stands for any value or any document."""
    return F.xxhash64(F.lit("rule"), kind, value.isNull(), value, scope.isNull(), scope)


def ruled(findings: DataFrame, rules: DataFrame, as_of: Column, label: Column | None = None) -> DataFrame:
    """``findings`` with rule_no, rule_reason and rule_expires of the first rule of a request that allows each; null where none does.

    rules: type, and where the table has them no (their order), value and scope (null or empty: any), reason,
    expires_at (null: never).  A rule counts if its type is the finding's, its value the text, its scope the
    document's label, and it hasn't expired; of several the smallest number does.  A finding asks for the four
    kinds of rules by key.  One type may have most findings, so each is dealt to one of SALTS parts by its row.
    """
    have = lambda c, kind: F.col(c) if c in rules.columns else F.lit(None).cast(kind)
    some = lambda c: F.when(have(c, "string") != "", have(c, "string"))
    live = rules.where(have("expires_at", "timestamp").isNull() | (have("expires_at", "timestamp") >= as_of))
    first = F.struct(F.coalesce(have("no", "long"), F.lit(0)).cast("long").alias("no"), have("reason", "string").alias("reason"), have("expires_at", "timestamp").alias("expires"))
    keyed = live.select(_rule_key(F.col("type"), some("value"), some("scope")).alias("rule_key"), first.alias("rule")).groupBy("rule_key").agg(F.min("rule").alias("rule"))
    keyed = keyed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    here, anywhere, anything = F.lit(None).cast("string") if label is None else label, F.lit(None).cast("string"), F.lit(None).cast("string")
    keys = F.array(*[_rule_key(F.col("type"), v, s) for v in (F.col("text"), anything) for s in (here, anywhere)])
    rows = findings.withColumns({"finding_key": F.monotonically_increasing_id(), "asked": F.array_distinct(keys)})
    rows = written(rows.withColumn("salt", F.pmod(F.col("finding_key"), F.lit(SALTS)).cast("int")), "asked-rules")
    hits = rows.select("finding_key", "salt", F.explode("asked").alias("rule_key")).join(keyed, ["rule_key", "salt"]).groupBy("finding_key").agg(F.min("rule").alias("rule"))
    joined = rows.join(hits, "finding_key", "left")
    return joined.select(*[F.col(quoted(c)) for c in findings.columns], F.col("rule.no").alias("rule_no"), F.col("rule.reason").alias("rule_reason"), F.col("rule.expires").alias("rule_expires"))


def allow(findings: DataFrame, allowed: DataFrame, as_of: Column, label: Column | None = None) -> DataFrame:
    """Findings without those that a request's rules allow (see ``ruled``)."""
    numbered = allowed if "no" in allowed.columns else allowed.withColumn("no", F.lit(0))
    return ruled(findings, numbered, as_of, label).where("rule_no IS NULL").drop("rule_no", "rule_reason", "rule_expires")
