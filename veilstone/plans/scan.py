"""The scan: documents -> findings, and scan with redaction."""

from __future__ import annotations

from functools import partial

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilstone.functions.lines import lines
from veilstone.functions.text import sql_text
from veilstone.operators.context import adjusted
from veilstone.operators.detectors import DETECTORS as CHECKED
from veilstone.operators.detectors import key_blocks
from veilstone.operators.labelled import LABELLED
from veilstone.operators.metadata import metadata
from veilstone.operators.redact import redact

DETECTORS = CHECKED | LABELLED
_EDGE = "(?<![0-9A-Za-z_])"
#: What a line has to have for a detector: any of some patterns (literals, if they begin with "="), which let through every line
#: in which it can find something.  Each is a plain scan of the text, which is faster than one pattern with many branches.
USES = {
    "CREDIT_CARD": [r"\d{4}"], "EMAIL": ["=@"], "SSN": [r"\d{3}"], "IP_ADDRESS": [r"\d\.\d", ":[0-9A-Fa-f]*:"], "VIN": [_EDGE + "[A-HJ-NPR-Za-hj-npr-z0-9]{17}"],
    "BANK_ACCOUNT": [r"\d{8}", _EDGE + "[A-Z]{6}[A-Z0-9]{2}", _EDGE + r"[A-Za-z]{2}\d{2}"], "MEDICAL_ID": [r"\d"],
    "SECRETS": [
        r"[=:]\s{0,8}[^\s\"';,#]{8}", r"[=:]\s{0,8}[\"'][^\"']{8}", r"[\"'][A-Za-z0-9+/=\\_-]{16}", "(?<![A-Za-z0-9/+])[A-Za-z0-9/+]{40}", "=eyJ", "=AKIA", "gh[pousr]_", "=AIza", "[sp]k_(?:live|test)_", "=glpat-",
        "=dckr_pat_", "xox[bp]-",
    ],
    "CLOUD_RESOURCES": ["=arn:aws", "=/subscriptions/", "=/providers/", "=projects/", "=folders/", "=organizations/", "=ocid1.", "=crn:v1:", "=acs:"],
    "PHONE": [r"\d{3}"], "DATE_OF_BIRTH": [r"\d"], "DRIVERS_LICENSE": [r"\d[\d -]"],
    "OTP": ["=otpauth://", _EDGE + "[A-Z2-7]{16}", _EDGE + "[a-z2-7]{16}", "(?<=[A-Za-z0-9]{4})-[A-Za-z0-9]{4}"], "PASSPORT": [r"\d{6}", _EDGE + "[A-Z]{2}[A-Z0-9]{7}", "=<"], "PHYSICAL_ADDRESS": [r"\d"],
    "INTELLECTUAL_PROPERTY": ["(?i)copyright", r"(?i)\(c\)", "=©", r"\d{3}[,.]?\d{2}", "(?i)trademark", r"(?i)\((?:tm|r)\)", "[™®]", "(?i)confidential", "(?i)secret", "(?i)proprietary", "(?i)internal", "(?i)restricted", "(?i)classified"],
    "PERSON_NAME": ["[A-ZÀ-ÖØ-Þ][A-Za-zÀ-ÿ.,'-]*\\s+[A-ZÀ-ÖØ-Þ]"], "SOCIAL_MEDIA": [],
}
#: For PERSON_NAME without a table of last names: a title before a name, or a degree or suffix after it.
MARKED_NAME = [r"(?:Mr|Ms|Mrs|Dr|Prof|Sir|Dame|Lord|Lady)\.\s", r"\s(?:Jr|Sr|III|IV|PhD|MD|Esq|DDS|JD|EdD|PharmD|PsyD|DVM|RN|CPA|PE)(?![A-Za-z])"]
#: Which detectors read what is around a line.
READS = {
    "table": ["SSN", "MEDICAL_ID", "DRIVERS_LICENSE", "OTP", "PASSPORT"], "about": ["SECRETS"], "above2": ["PHYSICAL_ADDRESS"], "below2": ["PHYSICAL_ADDRESS"],
    "above": ["MEDICAL_ID", "DRIVERS_LICENSE", "PASSPORT", "PHYSICAL_ADDRESS", "SECRETS"], "below": ["PHYSICAL_ADDRESS", "SECRETS"],
}


def checks_of(checks: list[str] | None) -> list[str]:
    """The detectors to run: all for none or "all"; an unknown name is an error."""
    wanted = [c.strip().upper() for c in checks or ["all"]]
    if "ALL" in wanted:
        return list(DETECTORS)
    if unknown := sorted(set(wanted) - set(DETECTORS)):
        raise ValueError(f"unknown checks: {', '.join(unknown)}; there are {', '.join(DETECTORS)}")
    return [c for c in DETECTORS if c in wanted]


def uses(names: list[str], text: str = "line", marked: bool = False) -> str:
    """SQL for whether a text has what one of the detectors needs.  marked: names are found by their marks only."""
    parts = dict.fromkeys(p for n in names for p in (MARKED_NAME if marked and n == "PERSON_NAME" else USES[n]))
    return "(" + " OR ".join([f"contains({text}, {sql_text(p[1:])})" if p[0] == "=" else f"{text} RLIKE {sql_text(p)}" for p in parts] or ["false"]) + ")"


def shared(rows: DataFrame, names: list[str], marked: bool = False) -> dict[str, DataFrame]:
    """The lines that some of the detectors can use, kept once on the executors' disks, and each detector's part of them.

    A line carries a bit for each detector that its gate lets through, and only those of its surroundings that
    one of them reads.  Lost parts are computed again from the texts; nothing is written to the shared
    folder, so no line outlives the session, or ``release``.
    """
    bits = {n: 1 << i for i, n in enumerate(names)}
    gates = sum((F.expr(f"IF({uses([n], marked=marked)}, {b}, 0)") for n, b in bits.items()), F.lit(0))
    wanted = {c: sum(bits[n] for n in readers if n in bits) for c, readers in READS.items()}
    has = lambda mask: F.col("gates").bitwiseAND(F.lit(mask)) > 0
    kept = rows.withColumn("gates", gates).where("gates > 0").drop("lower", *[c for c, mask in wanted.items() if not mask])
    kept = kept.withColumns({c: F.when(has(mask), F.col(c)) for c, mask in wanted.items() if mask}).persist(StorageLevel.DISK_ONLY)
    _held.append(kept)
    empty = {c: F.coalesce(c, F.lit("")) if c in kept.columns else F.lit("") for c in ("above", "above2", "below", "below2")}
    back = kept.withColumns({"lower": F.lower("line"), **empty})
    return {n: back.where(has(b)).drop("gates") for n, b in bits.items()}


_held: list[DataFrame] = []


def release() -> None:
    """Frees the lines that scans of this session hold; results not yet read are computed from the texts again."""
    while _held:
        _held.pop().unpersist()


#: From so many detectors on, one pass over the texts that keeps the lines they can use is faster than a pass for each.
SEVERAL = 4


def detect(
    docs: DataFrame, checks: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text", name_col: str | None = None, reuse: bool | None = None,
    last_year: int | None = None, limit: int = 0, names: tuple[DataFrame | list[str], DataFrame | list[str]] | None = None,
) -> DataFrame:
    """What the detectors find line by line, before the documents' context.

    Rows that repeat an id, or have none, are documents of their own; each row's findings are reported.  reuse: whether
    the detectors share one pass over the texts (``shared``), by default from SEVERAL on; a
    stream needs False.  names: tables of first and last names, for PERSON_NAME.  last_year: the last plausible year of a birth (by default this one).  limit: most
    findings of a detector in a document, in the order of their places (0: all).
    """
    wanted, out = checks_of(checks), None
    marked = names is None or names[1] is None
    near = [n for n in wanted if n in READS["above"]]
    rows = lines(docs, id_col, text_col, name_col, lambda x: uses(wanted, x, marked), (lambda x: uses(near, x)) if near else None)
    of = shared(rows, wanted, marked) if (len(wanted) >= SEVERAL if reuse is None else reuse) else {n: rows.where(uses([n], marked=marked)) for n in wanted}
    options = {"DATE_OF_BIRTH": {"last_year": last_year}, "PERSON_NAME": dict(zip(("first_names", "last_names"), names or (None, None), strict=True))}
    for name in wanted:
        find = partial(DETECTORS[name], **options.get(name, {}))
        part = find(of[name])
        if name == "SECRETS":
            part = part.unionByName(key_blocks(docs, id_col, text_col, name_col))
        out = part if out is None else out.unionByName(part)
    return first_of(out, limit) if limit else out


def first_of(findings: DataFrame, limit: int) -> DataFrame:
    """At most ``limit`` findings of each detector in a document: the first by place."""
    nth = F.row_number().over(Window.partitionBy("doc_id", "doc_key", "validator").orderBy("start", "end_col", "type"))
    return findings.withColumn("nth", nth).where(F.col("nth") <= limit).drop("nth")


def scan(docs: DataFrame, checks: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text", name_col: str | None = None, **options) -> DataFrame:
    """Findings of ``docs`` with their final confidence.  Null and empty texts have none."""
    return adjusted(detect(docs, checks, id_col, text_col, name_col, **options))


def scan_units(units: DataFrame, checks: list[str] | None = None, **options) -> DataFrame:
    """Findings of extracted files: units of (path, part, name, text), metadata being known by its part.

    Bodies go to all detectors; a metadata unit goes to them as well, and its fields to the fields' table.
    """
    unit = units.withColumn("doc_id", F.concat_ws("#", "path", "part"))
    found = scan(unit, checks, name_col="name", **options)
    fields = metadata(unit.where(F.col("part") == "metadata")).withColumn("doc_kind", F.lit("Unknown")).drop("adjustment")
    return found.unionByName(fields)


def scan_and_redact(docs: DataFrame, checks: list[str] | None = None, strategy: str = "simple", id_col: str = "doc_id", text_col: str = "text", name_col: str | None = None, **options) -> DataFrame:
    """``docs`` with the redacted text and the number of replaced spans."""
    return redact(docs, scan(docs, checks, id_col, text_col, name_col, **options), strategy, id_col, text_col)
