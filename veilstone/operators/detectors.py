"""Detectors: lines -> findings, each one declarative plan of the same shape.

A detector takes the table of lines and returns FINDINGS: candidates by a pattern, checks by column
expressions, a confidence from 0 to 100, and those that reach their threshold.  ``ceiling`` bounds what
a document's context may add later.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilstone.functions import checksums
from veilstone.functions.documents import about, known
from veilstone.functions.lines import text_key
from veilstone.functions.text import CLOSE, LABEL_GAP, OPEN, any_of, beside, candidates, clamp, count_words, field_label, has_word, let, let_sql, line_ends, quoted, running_sql, seam, spans, tabular_line, word_pattern, words_in, words_score

FINDINGS = ["doc_id", "doc_key", "line_number", "start_col", "end_col", "validator", "type", "text", "confidence", "ceiling", "line", "before", "after", "start", "length", "doc_kind", "adjustment"]
#: What a value that passes a check digit keeps, whatever stands beside it.
FLOOR = 15.0

NOT_WORD_BEFORE, NOT_WORD_AFTER = r"(?<![0-9A-Za-z_])", r"(?![0-9A-Za-z_])"


def _found(rows: DataFrame, validator: str, kind: Column, confidence: Column, ceiling: Column | None = None, least: float = 0.0) -> DataFrame:
    """Candidates with a confidence above ``least`` (from it on, if it isn't 0) as FINDINGS.

    start counts characters from the document's first; length is that of the text, or of what a finding covers instead.
    """
    if "length" not in rows.columns:
        rows = rows.withColumn("length", F.char_length("text"))
    # a generator's row, so that no filter on it, here or above, is pulled down and computes the long expression once more
    # for each use of each column in it; the outer form, as Spark filters by the array of the plain one first
    given = F.explode_outer(F.array(let(confidence.cast("double"), lambda c: c)))
    new = {"validator": F.lit(validator), "type": kind, "confidence": given, "ceiling": (F.lit(None) if ceiling is None else ceiling).cast("double"), "start": F.col("offset") + F.col("start")}
    scored = rows.select(*[new[c].alias(c) if c in new else F.col(c) for c in FINDINGS])
    return scored.where(F.col("confidence") > 0 if not least else F.col("confidence") >= least)


def _word(pattern: str) -> str:
    return f"{NOT_WORD_BEFORE}(?:{pattern}){NOT_WORD_AFTER}"


def _chars(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda c: c != "")


#: Runs of digits that go up or down by one, 9 and 0 being neighbours.
UP = "01234567890123456789012345678"
DOWN = UP[::-1]


# ---- payment cards ------------------------------------------------------------------------------------------------
# Fixed values of the detector: number shapes, ranges of issuers, words, known test numbers.
CARD_BORDER = r"\s,;|\"'(){}\[\]<>=:"
CARD_SHAPES = [
    r"\d{4}[\s\-]\d{4}[\s\-]\d{4}[\s\-]\d{4}", r"\d{4}[\s\-]\d{6}[\s\-]\d{5}", r"\d{4}[\s\-]\d{4}[\s\-]\d{4}[\s\-]\d{3}",
    r"\d{4}[\s\-]\d{4}[\s\-]\d{4}[\s\-]\d{2}", r"\d{19}", r"\d{16}", r"\d{15}", r"\d{14}", r"\d{13}",
]
CARD_RANGES = [
    (400000, 499999), (510000, 559999), (222100, 272099), (340000, 349999), (370000, 379999), (601100, 601199), (644000, 649999), (650000, 659999),
    (350000, 359999), (300000, 309999), (360000, 369999), (380000, 389999), (620000, 629999), (500000, 509999), (560000, 589999),
]
CARD_WORDS = [
    "credit", "debit", "card", "visa", "mastercard", "amex", "american express", "discover", "jcb", "diners", "cardholder", "payment", "transaction",
    "purchase", "expiration", "expiry", "exp", "cvv", "cvc", "ccv", "billing", "checkout", "pay", "paid", "pci", "merchant",
]
CARD_NEVER = [
    "timestamp", "unix", "epoch", "phone", "tel", "telephone", "md5", "sha", "hash", "uuid", "guid", "crc", "checksum", "version", "build", "test",
    "example", "fake", "mock", "sample",
]
CARD_LABELS = [
    "account", "id", "identifier", "serial", "tracking", "reference", "order", "invoice", "s/n", "sn#", "nameplate", "waybill", "parcel", "booking",
    "barcode", "asset", "asset tag", "sku", "part", "designator", "receipt", "session", "token", "imei", "iccid", "loyalty", "rewards", "membership",
]
CARD_TESTS = [
    "1234567890123456", "1111222233334444", "1212121212121212", "4111111111111111", "5555555555554444", "4444444444444448", "4000000000000002",
    "5100000000000008", "340000000000009",
]
CARD_NAME_VALUE = r"[A-Z][a-z]+\s+[A-Z][a-z]+\s+\d{4}[\s-]?\d{4}"


def _plain(words: list[str]) -> str:
    """Whole words whose spaces are single spaces."""
    return word_pattern(words, " ")


def card_brand(n: Column) -> Column:
    one, two, six = F.substring(n, 1, 1), F.substring(n, 1, 2), F.substring(n, 1, 6)
    return (
        F.when(one == "4", "VISA")
        .when(two.between("51", "55"), "MASTERCARD")
        .when(one == "5", "MAESTRO")
        .when(two.isin("34", "37"), "AMERICAN_EXPRESS")
        .when(two == "35", "JCB")
        .when(two.isin("30", "36", "38"), "DINERS_CLUB")
        .when(two == "62", "UNIONPAY")
        .when(one == "6", "DISCOVER")
        .when(six.between("222100", "272099"), "MASTERCARD")
        .otherwise("CREDIT_CARD")
    )


def credit_card(lines: DataFrame) -> DataFrame:
    pattern = f"(?<![^{CARD_BORDER}])(?:{'|'.join(CARD_SHAPES)})(?![^{CARD_BORDER}])"
    low = F.col("lower")
    asked = {k: low.rlike(_plain(w)) for k, w in (("card", CARD_WORDS), ("never", CARD_NEVER), ("label", CARD_LABELS))}
    rows = candidates(lines, pattern, table=tabular_line(CARD_NAME_VALUE), **asked).withColumn("number", F.regexp_replace("text", r"[ \-]", ""))
    n = F.col("number")
    rows = rows.where(F.char_length(n).isin(13, 14, 15, 16, 19) & n.rlike(r"^\d+$") & checksums.luhn(n))
    issuer = F.substring(n, 1, 6).cast("int")
    known = F.lit(False)
    for low, high in CARD_RANGES:
        known |= issuer.between(low, high)
    test = n.isin(CARD_TESTS) | n.rlike(r"^(\d)\1{13,15}$")
    repeats = n.rlike(r"(\d)\1{11}|^(\d)\2*$|^(\d)(?!\3)(\d)(?:\3\4)*\3?$") | F.lit(UP).contains(n)
    kinds = F.size(F.array_distinct(_chars(n)))
    first = F.when(test, 5.0).otherwise(F.when(known, 75.0).otherwise(40.0)) + F.when(repeats, -35.0).otherwise(10.0)
    own = clamp(first + F.when(kinds < 5, -20.0).when(kinds >= 7, 10.0).otherwise(0.0), 0, 100)
    weak = test | repeats
    own = F.when(weak, clamp(own, 5, 15)).otherwise(own)
    context = F.when(F.col("never") | (~F.col("card") & F.col("label")), -100.0).when(F.col("card"), 15.0).otherwise(0.0)
    total = clamp(own + context + F.when(F.col("table"), 10.0).otherwise(0.0), 0, 100)
    total = F.when(weak, clamp(total, 1, 15)).otherwise(total)
    return _found(rows, "creditcard", card_brand(n), F.when(total <= 0, FLOOR).otherwise(total))


# ---- e-mail -------------------------------------------------------------------------------------------------------
# The address pattern, words, test addresses, and providers by domain.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
EMAIL_WORDS = [
    "email", "e-mail", "contact", "mailto", "address", "recipient", "sender", "from", "to", "cc", "bcc", "reply", "subscribe", "unsubscribe",
    "notification", "alert", "newsletter", "support", "info", "admin", "sales", "marketing", "customer", "service", "help", "noreply", "donotreply",
    "bounce", "postmaster", "webmaster",
]
EMAIL_AGAINST = [
    "test", "example", "fake", "mock", "sample", "dummy", "placeholder", "demo", "template", "tutorial", "documentation", "readme", "lorem", "ipsum",
    "foo", "bar", "baz", "temp", "temporary", "invalid", "nonexistent", "blackhole", "devnull", "git clone", "git@", "ssh://", "https://", "http://",
    "repository", "repo", "clone", "checkout", "fetch", "pull", "push",
]
EMAIL_TEST_PARTS = ["test@", "example@", "user@", "admin@", "noreply@", "@test", "@example", "@localhost", "@domain", "@company"]
EMAIL_TEST_DOMAINS = [
    "example.com", "example.org", "example.net", "test.com", "test.org", "localhost", "domain.com", "company.com", "email.com", "mail.com", "foo.com",
    "bar.com", "baz.com", "temp.com", "dummy.com", "sample.com", "demo.com", "placeholder.com", "invalid.com",
]
EMAIL_TEST_USERS = [
    "test", "example", "user", "admin", "root", "demo", "sample", "dummy", "placeholder", "foo", "bar", "baz", "temp", "invalid", "john.doe",
    "jane.smith", "user123", "testuser", "demouser",
]
EMAIL_PROVIDERS = {
    "GMAIL": ["gmail.com", "googlemail.com"], "GOOGLE_WORKSPACE": ["google.com"], "OUTLOOK": ["outlook.com", "hotmail.com", "live.com", "msn.com"],
    "MICROSOFT_365": ["microsoft.com"],
    "YAHOO": ["yahoo.com", "yahoo.co.uk", "yahoo.ca", "yahoo.au", "yahoo.de", "yahoo.fr", "yahoo.it", "yahoo.es", "yahoo.co.jp", "yahoo.co.in"],
    "ICLOUD": ["icloud.com", "me.com", "mac.com"], "APPLE_CORPORATE": ["apple.com"], "AOL": ["aol.com"], "PROTONMAIL": ["protonmail.com", "proton.me", "pm.me"],
    "TUTANOTA": ["tutanota.com", "tutanota.de", "tutamail.com", "tuta.io"], "FASTMAIL": ["fastmail.com", "fastmail.fm"], "ZOHO": ["zoho.com", "zohomail.com"],
    "YANDEX": ["yandex.com", "yandex.ru"], "MAIL_RU": ["mail.ru", "inbox.ru", "list.ru", "bk.ru"], "SALESFORCE": ["salesforce.com"], "SLACK": ["slack.com"],
    "ATLASSIAN": ["atlassian.com"], "GITHUB": ["github.com"], "GITLAB": ["gitlab.com"],
}
EMAIL_SCHOOLS = [".edu", ".ac.uk", ".edu.au", ".edu.ca", ".ac.in", ".edu.sg"]
EMAIL_STATE = [".gov", ".gov.uk", ".gov.au", ".gov.ca", ".mil"]
EMAIL_COMPANY_PARTS = [
    "corp", "company", "inc", "ltd", "llc", "group", "enterprise", "solutions", "services", "consulting", "tech", "software", "systems", "digital",
    "online", "web", "net", "org",
]
EMAIL_COMPANY_ENDS = [".biz", ".co", ".inc", ".corp", ".company"]
EMAIL_NAME_VALUE = r"[A-Z][a-z]+\s+[A-Z][a-z]+\s+[A-Za-z0-9._%+-]+@"
EMAIL_DISPOSABLE = [
    "10minutemail.com", "guerrillamail.com", "mailinator.com", "tempmail.org", "temp-mail.org", "throwaway.email", "maildrop.cc", "sharklasers.com",
    "guerrillamailblock.com", "pokemail.net", "spam4.me", "tempail.com", "20minutemail.it", "emailondeck.com", "fakeinbox.com", "getnada.com",
    "harakirimail.com", "incognitomail.org", "jetable.org", "mailcatch.com", "mailnesia.com", "mytrashmail.com", "no-spam.ws", "nowmymail.com",
    "objectmail.com", "oneoffmail.com", "pookmail.com", "quickinbox.com", "rcpt.at", "rtrtr.com", "sendspamhere.com", "tempemail.com", "tempinbox.com",
    "tempmailo.com", "tempmailaddress.com", "trashmail.at", "trashmail.com", "trashmail.de", "trashmail.me", "trashmail.net", "wegwerfmail.de",
    "wegwerfmail.net", "wegwerfmail.org", "yopmail.com",
]
EMAIL_TEST_ENDS = [".local", ".localhost", ".test", ".invalid", ".example"]
#: Mailboxes of machines (a number or sign may follow), and what their confidence stops at.
EMAIL_MACHINES = (
    r"^(?:(?:noreply|no-reply|no_reply|donotreply|do-not-reply|mailer-daemon|postmaster|bounce|bounces|alerts|alert|notifications|notification|notify|automated|auto-confirm|auto-reply|autoreply|"
    r"service-account|system|daemon|cron|robot|bot)(?:$|[-+_0-9])|svc-)"
)
EMAIL_MACHINE_CAP = 85.0
#: Top-level domains: any of two letters, and these; more can be given as a parameter.
TOP_LEVELS = ["com", "org", "net", "edu", "gov", "mil", "int", "arpa", "info", "biz", "name", "mobi", "app", "dev", "cloud", "online", "tech", "shop", "site", "email", "news", "blog", "bank", "health"]


def email_provider(domain: Column) -> Column:
    kind = F
    for name, domains in EMAIL_PROVIDERS.items():
        kind = kind.when(domain.isin(domains), name)
    company = any_of(domain, EMAIL_COMPANY_PARTS, "contains") | any_of(domain, EMAIL_COMPANY_ENDS, "endswith") | (F.char_length(F.substring_index(domain, ".", 1)) > 3)
    return kind.when(any_of(domain, EMAIL_SCHOOLS, "endswith"), "EDUCATIONAL").when(any_of(domain, EMAIL_STATE, "endswith"), "GOVERNMENT").when(domain.isin(EMAIL_DISPOSABLE), "DISPOSABLE").when(company, "BUSINESS").otherwise("EMAIL")


def email(lines: DataFrame, top_levels: list[str] | None = None) -> DataFrame:
    asked = {"on_for": words_in(EMAIL_WORDS), "on_against": words_in(EMAIL_AGAINST), "table": tabular_line(EMAIL_NAME_VALUE), **line_ends()}
    rows = candidates(lines, NOT_WORD_BEFORE + EMAIL + NOT_WORD_AFTER, F.col("line").contains("@"), **asked).withColumn("seam", seam())
    near = 4.0 * beside(EMAIL_WORDS, "on_for") - 10.0 * beside(EMAIL_AGAINST, "on_against")
    rows = rows.withColumn("context", clamp(8.0 * F.size("on_for") - 20.0 * F.size("on_against") + near, -60, 30))
    t = F.lower("text")
    user, domain = F.substring_index(t, "@", 1), F.substring_index(t, "@", -1)
    top = F.substring_index(domain, ".", -1)
    size = F.char_length(t)
    own = (
        F.lit(100.0)
        - F.when((size > 254) | (F.char_length(user) > 64) | (F.char_length(domain) > 253), 30.0).otherwise(0.0)
        - F.when(domain.rlike(r"^[.-]"), 100.0).otherwise(0.0)
        - F.when(domain.isin(EMAIL_TEST_DOMAINS) | any_of(domain, EMAIL_TEST_ENDS, "endswith"), 25.0).otherwise(0.0)
        - F.when((F.char_length(top) == 2) | top.isin(top_levels or TOP_LEVELS), 0.0).otherwise(10.0)
        - F.when(user.isin(EMAIL_TEST_USERS), 20.0).otherwise(0.0)
        + F.when(user.rlike(r"^[^.].*\.(?:.*[^.])$"), 5.0).otherwise(0.0)
        - F.when((size > 254) | (size < 6), 10.0).otherwise(0.0)
        - F.when(t.contains(".."), 10.0).otherwise(0.0)
        - F.when(any_of(t, EMAIL_TEST_PARTS, "contains"), 15.0).otherwise(0.0)
    )
    url = F.col("after").rlike(r"^(?:@|[:/\\][^ \t\r])")
    total = F.greatest(own, F.lit(0.0)) + F.when(url, -100.0).otherwise(F.col("context")) + F.when(F.col("table"), 15.0).otherwise(0.0)
    return _found(rows, "email", email_provider(domain), clamp(F.when(user.rlike(EMAIL_MACHINES), F.least(total, F.lit(EMAIL_MACHINE_CAP))).otherwise(total), 0, 100))


# ---- social security numbers --------------------------------------------------------------------------------------
# Words for and against, by field, and test numbers.
SSN_WORDS = [
    "ssn", "social security", "social security number", "social", "ein", "tax id", "taxpayer id", "identification number", "employee id", "federal id",
    "government id", "national id", "personal id", "identity", "benefits", "medicare", "medicaid", "irs", "w2", "w-2", "1099", "tax return", "tax form",
    "employment", "payroll", "hr", "human resources", "personnel", "employee record",
]
SSN_AGAINST = [
    "phone", "telephone", "fax", "zip", "postal", "area code", "extension", "ext", "routing", "account", "credit card", "card", "test", "example",
    "sample", "dummy", "fake", "mock", "demo", "template", "placeholder", "serial", "model", "version", "build", "encoded", "numeric", "code", "hash",
    "uuid", "guid", "part number", "part no", "requisition", "lot", "batch", "work order", "invoice", "rma", "asset tag", "asset", "case", "ticket",
    "sku", "purchase order", "docket", "tracking", "shipment", "order number", "po", "permit", "reservation", "bin", "accession", "specimen",
    "contract", "txn", "transaction", "policy number", "policy no", "grant number", "grant no", "000-00-0000", "123-45-6789",
    *(f"{d * 3}-{d * 2}-{d * 4}" for d in "123456789"),
]
SSN_MARKS = ["test", "example", "sample", "demo", "placeholder", "mock", "fake", "lorem ipsum", "john doe", "jane smith", "foo bar", "qwerty"]
SSN_MARK_NUMBERS = [*(d * 9 for d in "12345789"), "123456789", "987654321"]
SSN_FIELDS = [
    (20.0, ["payroll", "hr", "human resources", "employee", "personnel", "staff", "employment", "hire", "onboarding", "benefits", "compensation"]),
    (25.0, ["tax", "w2", "w-2", "1099", "irs", "taxpayer"]),
    (18.0, ["medical", "medicare", "medicaid", "insurance", "patient", "healthcare", "health record", "health plan"]),
]
SSN_TESTS = [
    "078051120", "123456789", "111111111", "222222222", "333333333", "444444444", "555555555", "777777777", "888888888", "999999999", "987654321",
    "123454321",
]
#: What a number in a column whose header speaks against it stops at; what an encoded line takes, and leaves.
SSN_HEADER_CAP, SSN_ENCODED, SSN_ENCODED_FLOOR = 55.0, 40.0, 60.0


def _ssn_line() -> dict[str, Column]:
    """What the rules for social security numbers ask of a line."""
    line = F.col("line")
    count = lambda p, of=line: F.regexp_count(of, F.lit(p))
    commas, tabs, semicolons, pipes = (count(p) for p in (",", r"\t", ";", r"\|"))
    mails, dates = count(r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"), r"\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|\d{4}-\d{2}-\d{2}"
    strict, cards, phones = count(r"\d{3}-\d{2}-\d{4}"), count(r"\d{4}-\d{4}-\d{4}-\d{4}"), count(r"\d{3}-\d{3}-\d{4}")
    loose = r"\d{3}[-\s]?\d{2}[-\s]?\d{4}"
    shaped = strict + cards + phones + mails + count(dates, F.regexp_replace(line, r"\d{3}-\d{2}-\d{4}", " "))
    tabular = (tabs > 0) | (commas >= 2) | (semicolons >= 2) | (pipes >= 2) | (count(r"\s{2,}") >= 2) | line.rlike(r'[A-Z][a-z]+\s+[A-Z][a-z]+\s+\d{3}-\d{2}-\d{4}|"[^"]*",\s*"[^"]*"') | (shaped >= 2)
    rich = mails + count(r"\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}") + count(loose) + count(dates, F.regexp_replace(line, loose, " ")) + count(r"\b[A-Z][a-z]+\s+[A-Z][a-z]+\b")
    records = (rich >= 3) | (tabs >= 2) | (commas >= 3) | (pipes >= 2) | (count(r"\s{3,}") >= 2)
    numbers, bare = count(r"\d+"), count(r"[0-9 ]").cast("double") / F.greatest(F.octet_length(line), F.lit(1))
    encoded = ~tabular & F.when(numbers > 15, strict + cards + phones < 2).otherwise((bare > 0.85) & (numbers > 3))
    marks = has_word(SSN_MARKS) | any_of(F.col("lower"), SSN_MARK_NUMBERS, "contains")
    fields = {f"field{i}": has_word(words) for i, (_, words) in enumerate(SSN_FIELDS)}
    return {"on_for": words_in(SSN_WORDS), "on_against": words_in(SSN_AGAINST), **fields, **line_ends(), "marks": marks, "tabular": tabular, "records": records, "encoded": encoded}


def ssn(lines: DataFrame) -> DataFrame:
    """A row's header counts like a word beside the number; without any word for it, shape alone decides little."""
    rows = candidates(lines, _word(r"\d{3}-\d{2}-\d{4}|\d{3}\s\d{2}\s\d{4}|\d{9}"), headers=True, **_ssn_line())
    rows = rows.withColumn("number", F.regexp_replace("text", r"[^0-9]", ""))
    n = F.col("number")
    area, group, serial = F.substring(n, 1, 3), F.substring(n, 4, 2), F.substring(n, 6, 4)
    rows = rows.where(~area.isin("000", "666") & (area < "900") & (group != "00") & (serial != "0000") & ~n.isin(SSN_TESTS))
    # of the words beside a value only those of several parts can be no words of the line
    parted = lambda words: [w for w in words if " " in w]
    none = F.expr("CAST(array() AS ARRAY<STRING>)")
    rows = rows.withColumn("seam", seam())
    rows = rows.withColumns({k: F.when(F.col("header") == "", none).otherwise(words_in(w, "header")) for k, w in (("head_words", SSN_WORDS), ("head_others", SSN_AGAINST))})
    rows = rows.withColumns(
        {
            "for_it": F.size("on_for"), "against": F.size("on_against"), "head_for": F.size("head_words"), "head_against": F.size("head_others"),
            "near_for": F.size(F.array_except(F.array_union("head_words", words_in(parted(SSN_WORDS), "seam")), "on_for")),
            "near_against": F.size(F.array_except(F.array_union("head_others", words_in(parted(SSN_AGAINST), "seam")), "on_against")),
        }
    )
    named_field = lambda i, words: F.col(f"field{i}") | has_word(words, "header") | (has_word(parted(words), "seam") if parted(words) else F.lit(False))
    rows = rows.withColumn("fields", sum((F.when(named_field(i, words), F.lit(boost)).otherwise(F.lit(0.0)) for i, (boost, words) in enumerate(SSN_FIELDS)), F.lit(0.0)))
    dashes, bare = F.col("text").contains("-"), F.col("text") == n
    repeats = n.rlike(r"(\d)\1\1") | (area == F.concat(group, F.substring(group, 1, 1))) | (area == F.substring(serial, 1, 3))
    runs = F.lit(UP).contains(n) | F.lit(DOWN).contains(n)
    own = F.lit(85.0) + F.when(dashes, 10.0).when(bare, -15.0).otherwise(0.0) - F.when(runs, 15.0).otherwise(0.0) - F.when(repeats, 15.0).otherwise(0.0)
    own = F.when(F.col("encoded"), F.when(dashes, F.greatest(own - SSN_ENCODED, F.lit(SSN_ENCODED_FLOOR))).otherwise(own - SSN_ENCODED)).otherwise(own)
    marked = F.col("marks") | n.rlike(r"(\d)\1\1\1") | runs
    context = 25.0 * F.col("for_it") + 10.0 * F.col("near_for") - 15.0 * F.col("against") - 8.0 * F.col("near_against") + F.col("fields")
    context = context + F.when(F.col("records"), 25.0).when(F.col("tabular"), 15.0).otherwise(0.0) - F.when(marked, 40.0).otherwise(0.0)
    total = own + clamp(context, -50, 50)
    named, refused = F.col("for_it") + F.col("head_for") > 0, F.col("against") + F.col("head_against") > 0
    capped = F.col("tabular") & (F.col("head_against") > 0) & (F.col("head_for") == 0)
    in_table = total - F.when(refused, 10.0).otherwise(0.0)
    in_text = F.when(named, total).when(refused, total - 25).otherwise(F.least(total, F.when(dashes, 60.0).otherwise(50.0)))
    score = F.when(F.col("tabular"), F.when(capped, F.least(in_table, F.lit(SSN_HEADER_CAP))).otherwise(in_table)).otherwise(in_text)
    return _found(rows, "ssn", F.lit("SSN"), clamp(score, 0, 100), F.when(capped, SSN_HEADER_CAP))


# ---- IP addresses -------------------------------------------------------------------------------------------------
# Patterns, networks that tell nothing about a person, public resolvers, words.
OCTET = r"(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)"
IPV4 = rf"(?:{OCTET}\.){{3}}{OCTET}"
_H = "[0-9a-fA-F]{1,4}"
IPV6 = rf"(?:{_H}:){{7}}{_H}"
IPV6_MIXED = rf"(?:{_H}:){{6}}{IPV4}"
#: A run of groups with :: in it, seven groups at most.
IPV6_SHORT = rf"(?=(?:[0-9a-fA-F]*:){{2,8}}[0-9a-fA-F]*(?![0-9a-fA-F:]))(?:{_H}:(?:{_H}:)*|:):(?:{_H}(?::{_H})*)?"
IP_PLAIN = [
    "10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "127.0.0.0/8", "0.0.0.0/8", "224.0.0.0/4", "240.0.0.0/4", "169.254.0.0/16", "192.0.2.0/24",
    "198.51.100.0/24", "203.0.113.0/24", "100.64.0.0/10", "198.18.0.0/15", "192.0.0.0/24",
]
IP_SAMPLES = ["1.2.3.4"]
IP_RESOLVERS = ["8.8.8.8", "8.8.4.4", "1.1.1.1", "1.0.0.1", "208.67.222.222", "208.67.220.220", "9.9.9.9", "149.112.112.112"]
IP_WORDS = [
    "ip", "address", "host", "server", "client", "endpoint", "node", "network", "subnet", "gateway", "router", "dns", "nameserver", "connection", "tcp", "udp",
    "http", "https", "ftp", "ssh", "ping", "traceroute", "nslookup", "dig", "whois", "firewall", "proxy", "vpn", "nat", "dhcp", "static", "dynamic", "lease",
]
IP_AGAINST = [
    "test", "example", "fake", "mock", "sample", "dummy", "placeholder", "demo", "template", "tutorial", "documentation", "readme", "lorem", "ipsum", "foo", "bar",
    "baz", "temp", "temporary", "invalid", "nonexistent", "blackhole", "devnull", "null", "version", "build", "revision", "release",
]


def ip_number(ip: Column) -> Column:
    part = F.split(ip, r"\.")
    return sum((part[i].cast("long") * (1 << (8 * (3 - i))) for i in range(4)), F.lit(0).cast("long"))


def in_networks(number: Column, networks: list[str]) -> Column:
    out = F.lit(False)
    for net in networks:
        base, _, bits = net.partition("/")
        a, b, c, d = map(int, base.split("."))
        low = (a << 24) + (b << 16) + (c << 8) + d
        out |= number.between(low, low + (1 << (32 - int(bits))) - 1)
    return out


def ip_address(lines: DataFrame) -> DataFrame:
    """An address is reported once a line; a shape that may be a version keeps 75 without a sign of a network."""
    border = r"(?<![0-9A-Za-z.:])", r"(?![0-9A-Za-z]|\.)"
    asked = {"named": has_word(IP_WORDS), "context": clamp(words_score(IP_WORDS, 12.0) + words_score(IP_AGAINST, -30.0), -80, 40)}
    rows = candidates(lines, f"{border[0]}(?:{IPV6_MIXED}|{IPV4}|(?:{IPV6}|{IPV6_SHORT})(?!:)){border[1]}", F.col("line").contains(".") | F.col("line").contains(":"), **asked)
    t = F.col("text")
    four = t.rlike(rf"^{IPV4}$")
    plain = F.when(four, in_networks(ip_number(t), IP_PLAIN) | t.isin(IP_RESOLVERS + IP_SAMPLES) | t.rlike(r"(?:^|\.)0\d")).otherwise(F.lower(t).rlike(r"^(?:f[cd]|fe[89ab]|2001:0?db8:|[0:]*:0*1$|[0:]*$)"))
    rows = rows.where(~plain)
    total = F.lit(110.0) + F.col("context")
    signs = F.col("named") | F.col("after").rlike(r"^(?::\d{1,5}|/\d{1,2})\b")
    unclear = (four | t.rlike(rf"^{IPV6}$")) & (total >= 90) & ~signs
    # all of a line's equal addresses score alike, so the first of them can be taken before they are scored
    nth = F.row_number().over(Window.partitionBy("line_key", "text").orderBy("start_col"))
    rows = rows.withColumn("nth", nth).where("nth = 1")
    return _found(rows, "ipaddress", F.lit("IP_ADDRESS"), F.when(unclear, 75.0).otherwise(clamp(total, 0, 100)))


# ---- vehicles -----------------------------------------------------------------------------------------------------
# Maker codes, words, test numbers.
VIN_MAKERS = [
    "1G1", "1G2", "1GC", "1GT", "1HG", "1J4", "1FA", "1FB", "1FC", "1FD", "1FM", "1FT", "1FU", "1GY", "1HD", "1HF", "1LN", "1ME", "1N4", "1NX", "2C3",
    "2FA", "2G1", "2HG", "2HM", "2T1", "3FA", "3G1", "3HG", "3VW", "JHM", "JN1", "JT2", "JTE", "JTD", "JTH", "KM8", "KNA", "KND", "SAJ", "SAL", "SCA",
    "SCF", "WAU", "WBA", "WBS", "WDB", "WDD", "WF0", "WMW", "WP0", "WUA", "WVW", "YV1", "ZAR", "ZFF",
]
VIN_WORDS = [
    "vin", "vehicle identification", "vehicle id", "chassis", "title", "registration", "dmv", "odometer", "mileage", "carfax", "autocheck", "recall",
    "nhtsa", "manufacturer", "make", "model", "year", "vehicle number", "frame number", "hull id", "automobile", "car", "truck", "motorcycle", "trailer",
    "fleet", "motor vehicle", "insurance claim", "accident report", "vehicle history", "dealer", "dealership", "automotive",
]
VIN_AGAINST = [
    "serial", "part number", "sku", "product code", "model number", "uuid", "hash", "token", "key", "password", "api", "mac address", "isbn", "test",
    "example", "sample", "dummy", "base64", "encoded", "hex", "checksum", "digest", "signature", "commit", "sha", "md5", "certificate", "license key",
    "activation", "registration key", "product key",
]
VIN_TESTS = ["11111111111111111", "00000000000000000", "AAAAAAAAAAAAAAAAA", "12345678901234567"]


def vin(lines: DataFrame) -> DataFrame:
    asked = {"on_for": words_in(VIN_WORDS), "on_against": words_in(VIN_AGAINST), **line_ends()}
    rows = candidates(lines, _word("[A-HJ-NPR-Za-hj-npr-z0-9]{17}"), **asked).withColumns({"number": F.upper("text"), "seam": seam()})
    near = 10.0 * beside(VIN_WORDS, "on_for") - 8.0 * beside(VIN_AGAINST, "on_against")
    rows = rows.withColumn("context", clamp(25.0 * F.size("on_for") - 15.0 * F.size("on_against") + near, -50, 50))
    n = F.col("number")
    good, maker = checksums.vin(n), F.substring(n, 1, 3).isin(VIN_MAKERS)
    rows = rows.where(~n.isin(VIN_TESTS) & ~n.rlike(r"^(.)\1*$") & n.rlike("[A-Z]") & n.rlike("[0-9]") & (good | (maker & ~n.rlike("^[1-5]"))))
    own = F.lit(65.0) + F.when(good, 20.0).otherwise(-10.0) + F.when(maker, 10.0).otherwise(0.0) + F.when(F.substring(n, 10, 1).rlike("[A-HJ-NPR-TV-Y1-9]"), 5.0).otherwise(0.0)
    return _found(rows, "vin", F.lit("VIN"), clamp(own + F.col("context"), 0, 100))


# ---- bank accounts ------------------------------------------------------------------------------------------------
# Lengths of account numbers by country, test numbers, words.
IBAN_LENGTHS = {
    "AL": 28, "AD": 24, "AT": 20, "AZ": 28, "BH": 22, "BY": 28, "BE": 16, "BA": 20, "BR": 29, "BG": 22, "CR": 22, "HR": 21, "CY": 28, "CZ": 24, "DK": 18,
    "DO": 28, "TL": 23, "EE": 20, "FO": 18, "FI": 18, "FR": 27, "GE": 22, "DE": 22, "GI": 23, "GR": 27, "GL": 18, "GT": 28, "HU": 28, "IS": 26, "IQ": 23,
    "IE": 22, "IL": 23, "IT": 27, "JO": 30, "KZ": 20, "XK": 20, "KW": 30, "LV": 21, "LB": 28, "LI": 21, "LT": 20, "LU": 20, "MK": 19, "MT": 31, "MR": 27,
    "MU": 30, "MC": 27, "MD": 24, "ME": 22, "NL": 18, "NO": 15, "PK": 24, "PS": 29, "PL": 28, "PT": 25, "QA": 29, "RO": 24, "LC": 32, "SM": 27, "SA": 24,
    "RS": 22, "SC": 31, "SK": 24, "SI": 19, "ES": 24, "SE": 24, "CH": 21, "TN": 24, "TR": 26, "UA": 29, "AE": 23, "GB": 22, "VA": 22, "VG": 24,
}
ABA_TESTS = ["011000015", "021000021", "000000000", "123456789", "987654321", *(str(d) * 9 for d in range(1, 10))]
BANK_WORDS = [
    "routing", "aba", "account number", "bank account", "checking", "savings", "wire", "swift", "bic", "iban", "transit", "financial institution", "deposit",
    "ach", "direct deposit", "bank", "routing number", "account no", "acct",
]
BANK_AGAINST = [
    "phone", "zip", "postal", "serial", "model", "version", "test", "example", "sample", "ssn", "social security", "placeholder", "fake", "mock", "demo",
    "ip address", "order", "invoice", "tracking", "confirmation",
]
BANK_PHONES = ["phone", "telephone", "fax", "call us", "mobile", "cell"]
#: Countries of bank identifiers.
COUNTRIES = (
    "AD AE AF AG AL AM AO AR AT AU AZ BA BB BD BE BF BG BH BI BJ BM BN BO BR BS BT BW BY BZ CA CD CF CG CH CI CL CM CN CO CR CU CV CY CZ DE DJ DK DM DO DZ EC EE EG ER ES ET FI FJ FK FM "
    "FO FR GA GB GD GE GH GI GL GM GN GQ GR GT GW GY HK HN HR HT HU ID IE IL IN IQ IR IS IT JM JO JP KE KG KH KI KM KN KP KR KW KY KZ LA LB LC LI LK LR LS LT LU LV LY MA MC MD ME MG MH "
    "MK ML MM MN MO MR MT MU MV MW MX MY MZ NA NE NG NI NL NO NP NR NZ OM PA PE PG PH PK PL PS PT PW PY QA RO RS RU RW SA SB SC SD SE SG SI SK SL SM SN SO SR SS ST SV SY SZ TD TG TH TJ "
    "TL TM TN TO TR TT TV TW TZ UA UG US UY UZ VA VC VE VG VN VU WS XK YE ZA ZM ZW"
).split()


def bank_account(lines: DataFrame) -> DataFrame:
    """Numbers of four kinds; a line with several words against it and hardly one for it leaves IBANs at the floor
    and drops the others."""
    postal, routing = has_word(["zip", "postal"]), ["routing", "routing number", "transit"]
    asked = {
        "context": clamp(words_score(BANK_WORDS, 15.0) + words_score(BANK_AGAINST, -20.0), -50, 40), "banking": has_word(BANK_WORDS, gap=LABEL_GAP), "n_for": count_words(BANK_WORDS),
        "n_against": count_words(BANK_AGAINST), "postal": postal & ~has_word([w for w in BANK_WORDS if w not in routing]), "phones": has_word(BANK_PHONES),
    }
    few, many = F.col("n_for") <= 1, F.col("n_against")
    refused = (few & (many >= 3)) | ((F.col("n_for") == 0) & (many >= 2)) | (few & F.col("postal"))
    banking = has_word(BANK_WORDS, gap=LABEL_GAP)
    shapes = {
        "IBAN": ("(?i:[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}|[A-Z]{2}[0-9]{2}(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,4})?)", None), "SWIFT_BIC": ("[A-Z]{6}[A-Z0-9]{2}(?:[A-Z0-9]{3})?", None),
        "ABA_ROUTING": (r"\d{9}", None), "US_BANK_ACCOUNT": (r"\d{8,17}", banking),
    }
    rows = candidates(lines, [(_word(shape), only) for shape, only in shapes.values()], **asked)
    t, context, named = F.col("text"), F.col("context"), F.col("banking")
    n = F.upper(F.replace(t, F.lit(" "), F.lit("")))
    lengths = F.create_map(*[F.lit(x) for pair in IBAN_LENGTHS.items() for x in pair])
    iban = (F.char_length(n) == F.try_element_at(lengths, F.substring(n, 1, 2))) & ~F.substring(n, 3, 2).isin("00", "01", "99") & checksums.iban(n)
    swift = F.substring(t, 5, 2).isin(COUNTRIES) & ~refused & (named | t.rlike("[0-9]")) & (named | (50 + context >= 40))
    two = F.substring(t, 1, 2).cast("int")
    aba = checksums.aba(t) & (two.between(1, 32) | two.between(61, 72) | (two == 80)) & ~t.isin(ABA_TESTS) & ~refused & (named | (40 + context >= 50))
    size, before, after = F.char_length(t), F.col("before"), F.col("after")
    near = F.concat(F.right(before, F.lit(6)), t, F.left(after, F.lit(2)))
    phone = (size == 10) & (F.col("phones") | near.rlike(r"\(\d{3}\)\s?\d{3}[-.]?\d{4}|\d{3}[-.\s]\d{3}[-.\s]\d{4}"))
    dated = F.concat(F.right(before, F.lit(3)), t, F.left(after, F.lit(3))).rlike(r"\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|\d{4}-\d{2}-\d{2}")
    version = F.right(before, F.lit(10)).rlike(r"(?i)\bv?\d+\.\d+\.\d+|(?<![a-z0-9])version(?![a-z0-9])|\bv\.?\d")
    account = (size != 9) & ~(size.between(13, 17) & checksums.luhn(t)) & ~phone & ~dated & ~version & ~refused
    by_account = F.lower(F.concat(F.right(before, F.lit(30)), t, after)).rlike("account|acct")
    by_way = lambda *values: F.when(F.col("way") == 0, values[0]).when(F.col("way") == 1, values[1]).when(F.col("way") == 2, values[2]).otherwise(values[3])
    own = by_way(F.lit(85.0), F.when(named, 75.0).otherwise(50.0), F.when(named, 70.0).otherwise(40.0), F.lit(55.0) + F.when(by_account, 15.0).otherwise(0.0))
    score = clamp(own + context, 0, 100)
    score = F.when((F.col("way") == 0) & (refused | (score <= 0)), FLOOR).otherwise(score)
    return _found(rows.where(by_way(iban, swift, aba, account)), "bank_account", by_way(*map(F.lit, shapes)), score)


# ---- medical numbers ----------------------------------------------------------------------------------------------
# The shape of a beneficiary's number, words.
_A, _AN = "[AC-HJ-KM-NP-RT-Y]", "[0-9AC-HJ-KM-NP-RT-Y]"
MBI = f"[1-9]{_A}{_AN}[0-9](?:-?|[ -]){_A}{_AN}[0-9](?:-?|[ -]){_A}{_A}[0-9][0-9]"
MBI_PLAIN = f"[1-9]{_A}{_AN}[0-9]{_A}{_AN}[0-9]{_A}{_A}[0-9][0-9]"
MEDICAL_WORDS = [
    "medical record", "mrn", "patient id", "member id", "insurance", "npi", "provider", "medicare", "medicaid", "beneficiary", "subscriber", "policy number",
    "group number", "dea", "prescriber", "pharmacy", "hospital", "clinic", "health plan", "health insurance", "patient", "physician", "doctor", "medical",
    "healthcare", "health record", "enrollment", "covered", "copay", "deductible", "claims", "formulary", "prior authorization", "referral", "hicn", "rxbin",
    "rxpcn", "rxgrp",
]
MEDICAL_STRONG_AGAINST = ["test", "example", "sample", "placeholder", "fake", "mock", "demo"]
MEDICAL_AGAINST = ["phone", "ssn", "account", "order", "invoice", "tracking", "serial", "model", "version", "ip address", "zip", "lorem", "foo", "bar", "todo", "fixme"]
#: Words for each kind of number; those of the first group may be written without their spaces.
MEDICAL_LABELS = {
    "medical": [
        "medical record", "mrn", "patient", "hospital", "clinic", "physician", "doctor", "healthcare", "health record", "medical", "admission", "discharge", "diagnosis",
        "treatment", "chart number",
    ],
    "mrn": ["mrn", "medical record", "patient id", "patient number", "record number", "chart number", "admission number", "patient account", "patient identification"],
    "insured": [
        "insurance", "member id", "member number", "subscriber", "policy number", "group number", "health plan", "enrollee", "covered", "copay", "deductible", "claims",
        "member identification", "subscriber identification", "policyholder", "rxbin", "rxpcn", "rxgrp", "rx bin", "rx group",
    ],
    "member": [
        "member id", "member number", "subscriber id", "policy number", "insurance id", "group number", "enrollee id", "member identification",
        "subscriber identification", "enrollee identification", "policyholder id",
    ],
}
MEDICAL_CONTEXTS = {
    "provider": ["npi", "provider", "physician", "doctor", "nurse", "practitioner", "clinician", "medical", "healthcare", "hospital", "clinic", "practice", "health plan", "registry"],
    "phones": ["phone", "call", "fax", "contact", "dial", "reach", "tel", "telephone", "mobile", "cell"],
    "dea": ["dea", "prescriber", "pharmacy", "controlled substance", "narcotic", "schedule", "dispensing", "prescription", "drug enforcement", "registrant"],
    "medicare": [
        "medicare", "mbi", "beneficiary", "cms", "medicaid", "enrollment", "coverage", "part a", "part b", "part d", "hicn", "health insurance claim", "member identification",
    ],
}
#: Other kinds of numbers: always, and unless a label names the kind.
NOT_RECORDS, NOT_RECORDS_SOFT = ["phone", "ssn", "zip", "postal", "fax", "extension"], ["account", "order", "invoice", "tracking", "serial"]
NOT_MEMBERS, NOT_MEMBERS_SOFT = ["phone", "ssn", "serial", "model", "version", "ip address"], ["account", "order", "invoice", "tracking"]


def medical_id(lines: DataFrame) -> DataFrame:
    """A label on the line above counts as on the line, and a table's header for members' numbers."""
    above = F.when(field_label(F.col("above"), MEDICAL_WORDS), F.concat(F.lit(" "), F.lower(F.trim("above")))).otherwise("")
    lines = lines.withColumn("seen", F.concat("lower", above)).withColumn("heads", F.coalesce(F.array_join("table.headers", " | "), F.lit("")))
    test = count_words(MEDICAL_STRONG_AGAINST, "seen")
    score = clamp(words_score(MEDICAL_WORDS, 10.0, "seen", LABEL_GAP) - test * 25.0 + words_score(MEDICAL_AGAINST, -15.0, "seen"), -60, 40)
    asked = {"context": F.when(test > 0, F.least(score, F.lit(-25.0))).otherwise(score)}
    asked |= {k: has_word(w, "seen", LABEL_GAP) for k, w in MEDICAL_LABELS.items()} | {k: has_word(w, "seen") for k, w in MEDICAL_CONTEXTS.items()}
    asked |= {"other": has_word(NOT_RECORDS), "other_soft": has_word(NOT_RECORDS_SOFT), "no_member": has_word(NOT_MEMBERS), "no_member_soft": has_word(NOT_MEMBERS_SOFT)}
    medical_line = has_word(MEDICAL_LABELS["medical"], "lower", LABEL_GAP)
    insured = has_word(MEDICAL_LABELS["insured"], "seen", LABEL_GAP) | has_word(MEDICAL_LABELS["insured"], "heads", LABEL_GAP)
    shapes = {
        "NPI": (r"[12]\d{9}", None), "DEA_NUMBER": (r"[ABCDFGMabcdfgm][A-Za-z]\d{7}", None), "MEDICARE_MBI": (MBI, None), "MRN": (r"\d{6,10}", medical_line),
        "INSURANCE_MEMBER_ID": ("[A-Za-z0-9]{8,20}", insured),
    }
    rows = candidates(lines, [(_word(shape), only) for shape, only in shapes.values()], headers=True, **asked)
    t, way = F.col("text"), F.col("way")
    npi, dea = checksums.npi(t), checksums.dea(t)
    shape = (F.char_length(t) == 9) | ((F.char_length(t) == 10) & (t.startswith("1") | (t.startswith("2") & npi)))
    record = ~F.col("other") & ~(F.col("other_soft") & ~F.col("mrn")) & ~shape
    named = F.col("member") | has_word(MEDICAL_LABELS["insured"], "header", LABEL_GAP)
    hexed = F.lower(t).rlike("^[0-9a-f]+$") & (~named | ~t.rlike("[A-Z]"))
    other = hexed | F.lower(t).rlike("^0x[0-9a-f]+$") | (t.rlike("^[A-Z0-9]+$") & ~named)
    taken = (t.rlike("^[ABCDFGMabcdfgm][A-Za-z][0-9]{7}$") & dea) | t.rlike(f"^{MBI_PLAIN}$")
    member = t.rlike("[A-Za-z]") & t.rlike("[0-9]") & ~F.col("no_member") & ~(F.col("no_member_soft") & ~named) & ~other & ~taken
    checked = F.when(way == 0, npi & ~F.col("phones")).when(way == 1, dea).when(way == 2, True).when(way == 3, record).otherwise(member)
    pick = lambda asked, yes, no: F.when(asked, yes).otherwise(no)
    own = F.when(way == 0, pick(F.col("provider"), 80.0, 40.0)).when(way == 1, pick(F.col("dea"), 85.0, 55.0)).when(way == 2, pick(F.col("medicare"), 75.0, 40.0))
    own = own.when(way == 3, F.when(F.col("mrn"), 70.0).when(F.col("medical"), 45.0).otherwise(15.0)).otherwise(pick(named, 70.0, 50.0))
    total = clamp(own + F.col("context"), 0, 100)
    kind = F.element_at(F.array(*map(F.lit, shapes)), way + 1)
    return _found(rows.where(checked), "medicalid", kind, F.when((total <= 0) & (way <= 1), FLOOR).otherwise(total))


# ---- secrets ------------------------------------------------------------------------------------------------------
# Token shapes with their types and scores, stems of names that hold secrets, words.
TOKENS = [
    (r"eyJ[A-Za-z0-9_-]*\.[A-Za-z0-9_-]*\.[A-Za-z0-9_-]*", "JWT_TOKEN", 92.0), (r"AKIA[0-9A-Z]{16}", "AWS_ACCESS_KEY", 94.0),
    (r"gh[pousr]_[a-zA-Z0-9]{36}", "GITHUB_TOKEN", 93.0), (r"AIza[0-9A-Za-z_-]{35}", "GOOGLE_CLOUD_API_KEY", 94.0),
    (r"[sp]k_(?:live|test)_[0-9a-zA-Z]{24}", "STRIPE_API_KEY", 95.0), (r"glpat-[a-zA-Z0-9_-]{20}", "GITLAB_TOKEN", 93.0),
    (r"dckr_pat_[a-zA-Z0-9_-]{36}", "DOCKER_TOKEN", 92.0), (r"xoxb-[0-9]{11,12}-[0-9]{11,12}-[a-zA-Z0-9]{24}", "SLACK_TOKEN", 94.0),
    (r"xoxp-[0-9]{11,12}-[0-9]{11,12}-[0-9]{11,12}-[a-zA-Z0-9]{32}", "SLACK_TOKEN", 94.0),
]
SECRET_NAMES = [
    "api_?key", "auth_?key", "service_?key", "account_?key", "db_?key", "database_?key", "priv_?key", "private_?key", "client_?key", "password", "passwd",
    "pwd", "secret", "token", "bearer", "oauth", "jwt", "session", "credential", "access_?token",
]
ASSIGNED_NAMES = [*SECRET_NAMES, "access_?key", "secret_?access_?key", "secret_?key"]
SECRET_WORDS = [
    "api", "key", "secret", "token", "password", "passwd", "pass", "pwd", "passphrase", "auth", "credential", "private", "access", "session", "bearer", "oauth",
    "jwt", "signature", "salt", "nonce", "seed", "entropy", "connectionstring",
]
SECRET_LABELS = [
    "key", "secret", "token", "password", "pass", "pwd", "auth", "credential", "private", "bearer", "jwt", "api", "signature", "hmac", "session", "cookie", "access",
    "refresh", "client_id", "clientid",
]
SECRET_COMMON, SECRET_TESTS = ["password", "secret", "example", "test", "sample", "default"], ["test", "demo", "example", "sample", "fake", "mock"]
SECRET_BLANKS = [
    "xxxxxxxxxxxxxxxx", "000000000000000", "1234567890abcdef", "abcdef123456789", "replace_with_actual", "insert_key_here", "your_api_key_here", "test_api_key_here",
]
SECRET_SAMPLES = [
    "your_password_here", "your_secret_here", "your_token_here", "insert_password_here", "insert_secret_here", "insert_token_here", "example_secret_key",
    "placeholder_token", "sample_password", "demo_private_key", "mock_jwt_token", "fake_access_token", "dummy_credential", "tutorial_secret", "readme_example",
    "documentation_key",
]
BASE64, HEX = r"A-Za-z0-9+/=\\\-_", "0-9A-Fa-f"
AWS_SECRET = "(?<![A-Za-z0-9/+])[A-Za-z0-9/+]{40}(?==*(?:$|[^A-Za-z0-9/+=]))"
AWS_NAME, AWS_ID = r"(?i)(?:aws_?)?secret_?access_?key|aws_?secret(?:_?key)?", r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b"
#: Kinds of documents and environments, with what they add; the most they add to a secret that only its name tells.
BY_KIND, BY_ENVIRONMENT = {"Configuration": 15.0, "Code": 8.0, "JSON": 12.0}, {"development": -15.0, "production": 10.0, "test": -25.0}
GENERIC_BOOST, UNNAMED_CAP, HEX_CAP = 30.0, 55.0, 55.0


def _mapped(value: Column, amounts: dict[str, float]) -> Column:
    out = F
    for k, v in amounts.items():
        out = out.when(value == k, v)
    return out.otherwise(0.0)


def _surroundings(generic: Column, block: bool = False) -> Column:
    """What the document adds to a secret: once for its table or test data, and by environment, domain and kind."""
    about = F.col("about")
    more = _mapped(about["environment"], BY_ENVIRONMENT) + _mapped(about["domain"], {"Financial": 12.0, "Healthcare": 8.0 if block else -5.0}) + _mapped(F.col("doc_kind"), BY_KIND)
    return F.col("adjustment") + F.when(generic, F.least(more, F.lit(GENERIC_BOOST))).otherwise(more)


def _named_secret() -> Column:
    """Whether the line has a word for secrets, by itself, with signs, or as a part of a name in camel case."""
    alts = "|".join(SECRET_WORDS)
    capital = "|".join(w.capitalize() for w in SECRET_WORDS)
    return F.col("line").rlike(f"(?i:(?<![a-z0-9])(?:{alts})(?![a-z0-9]))|(?<=[a-z0-9])(?:{capital})(?![A-Za-z0-9])|(?<=[a-z0-9])(?:{capital})(?=[A-Z])|(?<![A-Za-z0-9])(?i:{alts})(?<=[a-z])(?=[A-Z])")


def _shares(text: Column, longest: list[str], times: int) -> Column:
    """Whether the text consists of one of the words to a good part."""
    low, out = F.lower(text), F.lit(False)
    for w in longest:
        out |= low.contains(w) & (F.char_length(text) <= len(w) * times)
    return out


def secrets(lines: DataFrame) -> DataFrame:
    """Tokens by shape, assigned values by name, quoted random strings, and secret access keys near their ids.

    A span that several methods find counts as the first of them found it.
    """
    line = F.col("line")
    quote = line.contains('"') | line.contains("'")
    refers = line.rlike(r"\$(?:\{|[A-Za-z_])")
    asked = {"about": F.col("about"), "named": _named_secret(), "labelled": any_of(F.col("lower"), SECRET_LABELS, "contains"), "refers": refers}
    package = line.rlike('"(?:integrity|checksum)"') & line.rlike("sha|md5") | line.rlike('"(?:resolved|url|homepage)"') & line.rlike("https?://") & line.rlike(r"registry\.|github\.com|gitlab\.com|bitbucket\.org")
    keyed = ~package & (F.char_length(line) >= 12)
    stems, assigned = "|".join(SECRET_NAMES), "|".join(ASSIGNED_NAMES)
    ways = [
        (rf"(?<=[\"'])[{BASE64}]{{20,}}(?=[\"'])", quote, checksums.entropy(F.col("text")) > 4.5, 50.0),
        (rf"(?<=[\"'])[{HEX}]{{16,}}(?=[\"'])", quote, checksums.entropy(F.col("text")) > 3.0, 50.0),
        ("(?:" + "|".join(p for p, _, _ in TOKENS) + ")", keyed, F.lit(True), 60.0),
        (rf"(?i)(?<=(?:{stems})[\"']?\s{{0,8}}[=:]\s{{0,8}}[\"'])[^\"']{{8,}}(?=[\"'])", keyed & quote, F.lit(True), 60.0),
        (rf"(?i)(?<=(?:{assigned})\s{{0,8}}[=:]\s{{0,8}})[^\s\"';,#<{{$(\[][^\s\"';,#]{{7,}}", keyed & (line.contains("=") | line.contains(":")), _plausible(F.col("text")), 60.0),
    ]
    aws, t = len(ways), F.col("text")
    checked, least = F.when(F.col("way") == aws, _aws_shape(t)), F
    for order, (_, _, check, score) in enumerate(ways):
        checked, least = checked.when(F.col("way") == order, check), least.when(F.col("way") == order, score)
    paired = F.concat_ws(" ", "above", "below").rlike(AWS_ID)
    near = (F.char_length(line) >= 40) & (line.rlike(AWS_NAME) | line.rlike(AWS_ID) | paired) & ~has_word(["test", "example", "sample", "fake", "mock", "placeholder", "dummy"])
    asked["sure"] = line.rlike(AWS_NAME) & paired
    rows = candidates(lines, [*((p, o) for p, o, _, _ in ways), (AWS_SECRET, near)], **asked).where(checked).withColumn("least", least.otherwise(0.0))
    kind, base = F, F
    for pattern, name, score in TOKENS:
        whole = t.rlike(f"^(?:{pattern})$") & (_jwt(t) if name == "JWT_TOKEN" else F.lit(True))
        kind, base = kind.when(whole, name), base.when(whole, score)
    rows = rows.withColumn("type", F.when(F.col("way") == aws, "AWS_SECRET_ACCESS_KEY").otherwise(kind.otherwise("API_KEY_OR_SECRET")))
    generic = F.col("type") == "API_KEY_OR_SECRET"
    own = F.lit(85.0) - F.when(F.octet_length(t) > 100, 10.0).otherwise(0.0) - F.when(_shares(t, SECRET_COMMON, 2), 20.0).otherwise(0.0) - F.when(_shares(t, SECRET_TESTS, 3), 30.0).otherwise(0.0)
    own = own - F.when(checksums.entropy(t, f"[{BASE64}]") < 3.0, 25.0).otherwise(0.0) - F.when(t.rlike("[ \\t]"), 15.0).otherwise(0.0)
    low = F.lower(t)
    sample = low.isin(SECRET_SAMPLES) | (any_of(low, SECRET_BLANKS + SECRET_SAMPLES, "contains") & low.rlike("^(?:test|example|demo|sample)_|_(?:test|example|demo|sample)$"))
    variable = F.col("about.shell") & (F.char_length(t) <= 50) & t.rlike("^[A-Za-z_][A-Za-z0-9_]*$") & low.rlike("_(?:token|key|secret|password|auth|credential)$")
    score = base.otherwise(clamp(own, 0, 100)) + _surroundings(generic) - F.when(sample, 35.0).otherwise(0.0) - F.when(variable, 20.0).otherwise(0.0)
    score = F.when(low.isin(SECRET_BLANKS), 0.0).when(generic & ~F.col("named"), F.least(score, F.lit(UNNAMED_CAP))).otherwise(score)
    reference = F.col("refers") & (F.col("before").rlike(r"\$\{?$") | (t.startswith("$") & F.col("before").rlike("[\"']$")))
    bare = generic & low.rlike("^(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64})$") & ~F.col("labelled")
    scored = rows.withColumn("score", F.when(reference, 0.0).otherwise(clamp(score, 0, 100)))
    kept = F.when(F.col("score") > F.col("least"), F.when(bare, F.least("score", F.lit(HEX_CAP))).otherwise(F.col("score"))).otherwise(0.0)
    by_itself = F.when(F.upper(t).contains("EXAMPLE"), 65.0).when(F.col("sure"), 95.0).otherwise(90.0)
    scored = scored.withColumns({"shown": F.when(F.col("way") == aws, by_itself).otherwise(kept), "cap": F.when((F.col("way") < aws) & bare, HEX_CAP)})
    span = Window.partitionBy("line_key", "start_col", "end_col")
    first = scored.withColumn("nth", F.row_number().over(span.orderBy("way"))).where((F.col("nth") == 1) | (F.col("way") == aws))
    ranked = span.orderBy((F.col("type") == "API_KEY_OR_SECRET") | (F.col("shown") <= 0), F.col("shown").desc())
    best = first.withColumns({"nth": F.row_number().over(ranked), "shown": F.max("shown").over(span)}).where("nth = 1")
    return _found(best, "secrets", F.col("type"), F.col("shown"), F.col("cap"))


def _jwt(t: Column) -> Column:
    """Three parts, the first of which decodes to a header with an algorithm."""
    head = F.translate(F.substring_index(t, ".", 1), "-_", "+/")
    decoded = F.try_to_binary(F.rpad(head, (F.ceil(F.char_length(head) / 4) * 4).cast("int"), "="), F.lit("base64")).cast("string")
    return t.rlike(r"^.{10,}\..{10,}\..{5,}$") & F.coalesce(decoded.contains('"alg"'), F.lit(False))


def _plausible(v: Column) -> Column:
    """Whether an unquoted value can be a secret: no short word, no number, no universal identifier."""
    word = v.rlike("^[a-z]+$") & (F.char_length(v) < 16)
    return ~word & ~v.rlike("^[0-9-]+$") & ~v.rlike("^[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$")


def _aws_shape(t: Column) -> Column:
    """Whether 40 characters can be a secret access key: mixed case, and as irregular as chance makes them."""
    return ~t.rlike("^(?:AKIA|ASIA)") & t.rlike("[a-z]") & t.rlike("[A-Z]") & (checksums.entropy(t) > 4.5)


# ---- cloud resources ----------------------------------------------------------------------------------------------
# Name shapes with their types and scores.
_GUID = r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"
CLOUD = [
    (r"arn:aws(?:-[a-z0-9-]+)?:[a-zA-Z0-9-]+:[a-zA-Z0-9-]*:[0-9]{12}:[^\s\"',;)\]}<>]+", "AWS_ARN", 85.0, True),
    (r"arn:aws(?:-[a-z0-9-]+)?:s3:::[^\s\"',;)\]}<>]+", "AWS_ARN", 55.0, False),
    (rf"/subscriptions/{_GUID}/resourceGroups/[^/\s]+(?:/providers/[^/\s]+/[^/\s]+/[^/\s]+)?", "AZURE_RESOURCE_ID", 90.0, True),
    (r"/providers/Microsoft\.Management/managementGroups/[a-zA-Z0-9_.-]+", "AZURE_RESOURCE_ID", 55.0, False),
    (r"projects/[a-zA-Z0-9.:-]+/(?:zones|regions|locations)/[a-zA-Z0-9-]+/[a-zA-Z0-9]+/[a-zA-Z0-9-]+(?:/[a-zA-Z0-9-]+)*", "GCP_RESOURCE_NAME", 85.0, False),
    (r"projects/[a-zA-Z0-9.:-]+/global/[a-zA-Z0-9]+/[a-zA-Z0-9-]+", "GCP_RESOURCE_NAME", 85.0, False),
    (r"projects/[a-zA-Z0-9.:-]+/serviceAccounts/[^\s/]+", "GCP_RESOURCE_NAME", 85.0, False),
    (r"(?:folders|organizations)/[0-9]+(?:/[a-zA-Z0-9-]+)*", "GCP_RESOURCE_NAME", 65.0, False),
    (r"ocid1\.[a-z]{3,}\.oc[0-9]+\.[a-zA-Z0-9-]*\.[a-zA-Z0-9]{8,}", "OCI_OCID", 55.0, False),
    (r"crn:v1:[a-zA-Z0-9-]+:[a-zA-Z0-9-]+:[a-zA-Z0-9-]+:[a-zA-Z0-9-]*(?::[a-zA-Z0-9/_.-]*){1,4}", "IBM_CRN", 80.0, False),
    (r"acs:[a-zA-Z0-9-]+:[a-zA-Z0-9-]*:[0-9]*:[a-zA-Z0-9:/_.-]+", "ALIBABA_ARN", 80.0, False),
]


def cloud_resources(lines: DataFrame, more: dict[str, str] | None = None) -> DataFrame:
    """Names of cloud resources; more: patterns of other kinds of names, as CLOUD_RESOURCE_ID, by a name for each.

    Names inside longer ones go, as do those of public resources.
    """
    size = F.char_length("text")
    shapes = [*CLOUD, *((p, "CLOUD_RESOURCE_ID", 65.0, False) for p in (more or {}).values())]
    kind, base = F, F
    for pattern, name, score, account in shapes:
        whole = F.col("text").rlike(f"^(?:{pattern})$")
        kind, base = kind.when(whole, name), base.when(whole, score + 10.0 * account)
    test = has_word(["test", "example", "sample", "dummy", "mock", "fake", "placeholder"])
    rows = candidates(lines, "(?:" + "|".join(p for p, _, _, _ in shapes) + ")", test=test)
    score = base - F.when(size < 20, 10.0).otherwise(0.0) - F.when(size > 500, 15.0).otherwise(0.0) - F.when(F.col("test"), 20.0).otherwise(0.0)
    return _found(rows, "cloud_resources", kind, clamp(score, 0, 100), least=45.0)


DETECTORS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "CREDIT_CARD": credit_card,
    "EMAIL": email,
    "SSN": ssn,
    "IP_ADDRESS": ip_address,
    "VIN": vin,
    "BANK_ACCOUNT": bank_account,
    "MEDICAL_ID": medical_id,
    "SECRETS": secrets,
    "CLOUD_RESOURCES": cloud_resources,
}


# ---- key and certificate blocks -----------------------------------------------------------------------------------
# Kinds of blocks with their types and scores.
BLOCKS = {
    "(?:RSA |DSA |EC |OPENSSH )?PRIVATE KEY": ("SSH_PRIVATE_KEY", 95.0), "ENCRYPTED PRIVATE KEY": ("CERTIFICATE", 90.0), "CERTIFICATE": ("CERTIFICATE", 90.0),
    "PGP PRIVATE KEY BLOCK": ("PGP_PRIVATE_KEY", 96.0),
}


def key_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", name_col: str | None = None) -> DataFrame:
    """FINDINGS of the lines of PEM and PGP blocks, one for each line, so that redaction removes all of them."""
    text = F.translate(F.coalesce(F.col(quoted(text_col)), F.lit("")), OPEN + CLOSE, "  ")
    whose = ["doc_id", "doc_key", "doc_kind", "adjustment", "about"]
    whole = docs.where(F.col(quoted(text_col)).contains("-----BEGIN ")).select(
        F.col(quoted(id_col)).alias("doc_id"), text_key(text_col).alias("doc_key"), text.alias("line"), known(text_col, name_col).alias("known"), about(text_col).alias("about")
    )
    whole = whole.select("doc_id", "doc_key", "known.*", "about", "line")
    pattern = "|".join(f"-----BEGIN {k}-----[\\s\\S]*?-----END {k}-----" for k in BLOCKS)
    # line breaks are matches too: a block's line is one more than the breaks above it, and begins after the last of them
    each = whole.select(*whose, spans(f"(?:{pattern})|\\n").alias("found")).where(F.exists("found", lambda x: x["text"] != "\n"))
    # where the match before a block has a break, the line begins after it; else (blocks side by side) further back
    back = "array_max(transform(filter(slice(found, 1, i), y -> instr(y.text, chr(10)) > 0), y -> y.end_col - octet_length(substring_index(y.text, chr(10), -1))))"
    broken = f"IF(i = 0, 1, IF(instr(found[i - 1].text, chr(10)) > 0, found[i - 1].end_col - octet_length(substring_index(found[i - 1].text, chr(10), -1)), coalesce({back}, 1)))"
    place = f"named_struct('no', get(above, i), 'at', x.start, 'col', x.start_col - {broken} + 1, 'lead', x.before, 'block', x.text)"
    numbered = let_sql(running_sql("transform(found, x -> regexp_count(x.text, '\\n'))"), "above", f"transform(found, (x, i) -> IF(x.text = chr(10), NULL, {place}))")
    rows = each.select(*whose, F.expr(f"inline_outer(array_compact({numbered}))"))
    kind, base = F, F
    for k, (name, score) in BLOCKS.items():
        kind, base = kind.when(F.col("block").rlike(f"^-----BEGIN {k}-----"), name), base.when(F.col("block").rlike(f"^-----BEGIN {k}-----"), score)
    rows = rows.select(*whose, "no", "at", "col", F.substring_index("lead", "\n", -1).alias("left"), kind.alias("type"), base.alias("base"), F.expr(let_sql(running_sql("transform(split(block, '\\n', -1), x -> char_length(x) + 1)"), "offsets", "transform(split(block, '\\n', -1), (x, i) -> named_struct('pos', i, 'text', x, 'by', get(offsets, i)))")).alias("parts"))
    rows = rows.select(*whose, "no", "at", "col", "left", "type", "base", F.inline_outer("parts"))
    left = F.when(F.col("pos") == 0, F.col("left")).otherwise("")
    score = clamp(F.col("base") + _surroundings(F.lit(False), block=True), 0, 100)
    out = rows.where("text != ''").withColumns({"line_number": (F.col("no") + F.col("pos") + 1).cast("int"), "line": F.concat(left, "text"), "start_col": F.when(F.col("pos") == 0, F.col("col")).otherwise(1), "start": F.col("at") + F.col("by")})
    more = {"end_col": F.col("start_col") + F.octet_length("text"), "validator": F.lit("secrets"), "confidence": score, "ceiling": F.lit(None).cast("double"), "before": left, "after": F.lit(""), "length": F.char_length("text")}
    return out.withColumns(more).select(*FINDINGS).where("confidence > 0")
