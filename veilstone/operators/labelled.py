"""Detectors whose values have no check digit of their own: the words beside them decide."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilstone.functions.membership import listed_in
from veilstone.functions.text import LABEL_GAP, any_of, candidates, clamp, count_words, either_score, field_label, has_word, parts_score, sql_text, tabular_line, word_pattern, words_score
from veilstone.operators.accept import first_numbers, longest_names
from veilstone.operators.detectors import DOWN, NOT_WORD_AFTER, NOT_WORD_BEFORE, UP, _chars, _found, _mapped, _word

TESTS = ["test", "example", "sample", "placeholder", "fake", "mock", "demo"]
#: After a value, an opening that says what it is.
ASIDE = r"^[ \t\-/(<\[|,;:#>]*(?i:{})(?![0-9A-Za-z_])"


# ---- phone numbers ------------------------------------------------------------------------------------------------
# Number shapes in the order in which they are tried, words, fictional and often printed numbers.
_LEAD = r"(?<![^\s,;|\"'<>])"
_TOLL = "(?:800|833|844|855|866|877|888)"
PHONES = [
    _LEAD + r"\(\d{3}\)\s?\d{3}[-.\s]?\d{4}" + NOT_WORD_AFTER,
    NOT_WORD_BEFORE + r"\d{3}[-.\s]\d{3}[-.\s]\d{4}" + NOT_WORD_AFTER,
    _word(r"\d{10}"),
    _LEAD + r"\+1[-.\s]?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}" + NOT_WORD_AFTER,
    _LEAD + r"\+\d{1,4}[-.\s]?\d{2,4}[-.\s]?\d{2,4}[-.\s]?\d{3,9}" + NOT_WORD_AFTER,
    _word(r"00\d{1,4}[-.\s]?\d{1,4}[-.\s]?\d{1,4}[-.\s]?\d{1,9}"),
    _word(r"0\d{2,4}[-.\s]?\d{3,8}(?:[-.\s]\d{3,4})?"),
    _LEAD + r"\+44[-.\s]?\d{1,4}[-.\s]?\d{3,8}" + NOT_WORD_AFTER,
    _LEAD + r"\+\d{2}[-.\s]?\d{2,4}[-.\s]?\d{2,4}[-.\s]?\d{3,4}" + NOT_WORD_AFTER,
    _LEAD + r"\+\d{1,3}[-.\s]?\d{2,4}[-.\s]?\d{3,4}[-.\s]?\d{3,4}" + NOT_WORD_AFTER,
    _LEAD + r"\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}[-.\s]?(?:ext\.?|extension|x)[-.\s]?\d{1,6}" + NOT_WORD_AFTER,
    _LEAD + r"\+\d{1,4}[-.\s]?\d{1,4}[-.\s]?\d{1,4}[-.\s]?\d{1,9}[-.\s]?(?:ext\.?|extension|x)[-.\s]?\d{1,6}" + NOT_WORD_AFTER,
    NOT_WORD_BEFORE + rf"(?:1[-.\s]?)?{_TOLL}[-.\s]?\d{{3}}[-.\s]?\d{{4}}" + NOT_WORD_AFTER,
    _LEAD + rf"(?:1[-.\s]?)?\({_TOLL}\)[-.\s]?\d{{3}}[-.\s]?\d{{4}}" + NOT_WORD_AFTER,
    _LEAD + rf"\+1[-.\s]?{_TOLL}[-.\s]?\d{{3}}[-.\s]?\d{{4}}" + NOT_WORD_AFTER,
]
PHONE_WORDS = [
    "phone", "telephone", "tel", "call", "mobile", "cell", "cellular", "contact", "number", "fax", "voicemail", "extension", "ext", "dial", "ring", "caller",
    "emergency", "hotline", "helpline", "support", "service", "customer", "sales", "office", "home", "work", "business", "personal", "primary", "secondary",
    "toll-free", "tollfree", "free", "800", "888", "877", "866", "855", "844", "833", "directory", "assistance", "operator",
]
PHONE_AGAINST = [
    "test", "example", "fake", "mock", "sample", "dummy", "placeholder", "demo", "template", "tutorial", "documentation", "readme", "lorem", "ipsum", "foo",
    "bar", "baz", "temp", "temporary", "invalid", "nonexistent", "blackhole", "devnull", "null", "ssn", "social", "security", "social security", "tax",
    "identification", "taxpayer", "employee", "federal", "ein", "itin", "credit", "card", "visa", "mastercard", "amex", "american express", "discover",
    "balance", "payment", "transaction", "amount", "first and last name", "last name", "first name", "timestamp", "unix", "epoch", "milliseconds", "seconds",
    "time", "created", "modified", "updated", "generated", "build", "version", "revision", "commit", "hash", "checksum", "uuid", "guid", "error code",
    "fault code", "order reference", "order ref", "rma", "serial", "serial number", "s/n", "part no", "part number", "case number", "permit", "batch", "lot",
    "sku", "fixture", "row id", "bib number", "model", "promo code", "certificate", "asset tag", "bin", "accession", "stamped", "etched",
]
PHONE_TESTS = ["5550100", "5550199", "5551212", "8675309", "1234567890", *(d * 10 for d in "0123456789"), "9876543210", "0123456789"]
PHONE_LABELS = "phone|tel|telephone|mobile|cell|fax|contact|call|emergency|support|office|home|work"
IDENTIFIER_LABELS = "timestamp|build|version|revision|id|key|hash|uuid|guid|token|session|request|response"
IDENTIFIER_PARTS = (
    "instance|ami-|vpc-|subnet-|sg-|igw-|rtb-|acl-|vol-|snap-|eni-|eip-|nat-|tgw-|vpce-|pcx-|build|version|revision|timestamp|id:|key:|hash|uuid|guid|token|session|request|response"
)
#: A number reserved for fiction stops at this.
FICTIONAL = 15.0


def _inside_identifier(t: Column, before: Column, after: Column) -> Column:
    """Whether a number is a part of an identifier, by the signs and labels next to it."""
    end = lambda words: rf"(?:^|[-_./)\]])(?:{words})$"
    label = F.lower(F.regexp_extract(before, r"([^ \t]+): ?$", 1))
    phone, other = label.rlike(end(PHONE_LABELS)), label.rlike(end(IDENTIFIER_LABELS))
    governs = F.lower(F.regexp_extract(before, r"([A-Za-z0-9_]+)[ \t:=]*[0-9.()+-]*-$", 1))
    fraction = before.rlike(r"[0-9]\.$") & ~t.rlike(r"^[0-9]+\.")
    beside = F.lower(F.concat(F.right(before, F.lit(10)), t, F.left(after, F.lit(10)))).rlike(IDENTIFIER_PARTS) & ~t.rlike(r"^\+|[0-9][-. ()]")
    next_to = after.rlike("^[A-Za-z0-9_:-]")
    return (
        F.when(before.endswith(":"), ~phone & other)
        .when(before.rlike(r"(?:^|[ \t+(])1-$"), governs.rlike(end(IDENTIFIER_LABELS)) & ~governs.rlike(end(PHONE_LABELS)))
        .when(fraction | before.rlike("[A-Za-z0-9_-]$"), True)
        .when(before.endswith(": ") & (phone | other), ~phone)
        .otherwise(next_to | beside)
    )


def _phone_like(t: Column, before: Column, after: Column) -> Column:
    """Whether what stands beside a number leaves it a phone number."""
    marks = F.right(before, F.lit(10))
    broken = before.rlike("[A-Za-z]-$|[A-Za-z_]$") | after.rlike("^[A-Za-z_:-]") | marks.rlike("::|arn:")
    counted = F.lower(marks).rlike("timestamp|build|created|updated|modified|version") & t.rlike(r"^[0-9+]+$")
    return ~broken & ~counted & ((after == "") | after.rlike(r"^[ \t,;.!?)\]}\r]") | t.rlike(r"[- ()]|^\+|[^0-9+]"))


def phone(lines: DataFrame) -> DataFrame:
    """Each shape's matches in the order of the shapes; of numbers that are, hold or lie in a number that the line has
    already given, none is a finding (``first_numbers``).  A number that scores nothing takes no one's place."""
    line = F.col("line")
    positive = any_of(F.col("lower"), PHONE_WORDS, "contains")
    context = clamp(either_score("line", "lower", dict.fromkeys(PHONE_WORDS, (15.0, 8.0))) - F.when(positive, 0.0).otherwise(20.0) + either_score("line", "lower", dict.fromkeys(PHONE_AGAINST, (-35.0, -18.0))), -80, 40)
    plus, round_ = line.contains("+"), line.contains("(")
    tried = [(p, (plus if r"\+" in p else round_ if r"\(\d" in p or r"\((?:" in p else F.lit(True)) & line.rlike(r"\d{3}")) for p in PHONES]
    rows = candidates(lines, tried, context=context, table=tabular_line(r"[A-Z][a-z]+\s+[A-Z][a-z]+\s+\(?\d{3}\)?"))
    t, before, after = F.col("text"), F.col("before"), F.col("after")
    rows = rows.withColumn("number", F.regexp_replace(t, r"[^0-9+]", "")).where(~_inside_identifier(t, before, after))
    n = F.col("number")
    d, size = F.regexp_replace(n, r"\+", ""), F.char_length(n)
    bare = ~t.rlike(r"[()\-. ]|^\+")
    epoch = bare & ((d.rlike(r"^\d{10}$") & d.cast("long").between(1000000000, 2147483647)) | d.rlike(r"^1\d{12}$") | (d.rlike(r"^(?:19|20)\d{6,}")))
    zeros = F.char_length(F.regexp_replace(n, "[^0]", "")).cast("double") / F.greatest(size, F.lit(1))
    invalid = n.rlike(r"^\+?0000") | (size < 7) | (zeros > 0.8)
    card = ((size == 8) & t.contains("-")) | (n.rlike("^[3-6]") & size.between(4, 8))
    bare_end = F.regexp_replace(n, r"^\+?1?(?=\d{3}55501\d\d$|55501\d\d$)", "")
    fictional = bare_end.rlike(r"^(?:\d{3})?55501\d\d$")
    stripped = F.regexp_replace(F.regexp_replace(t, r"(?i)[-.\s]?(?:ext\.?|extension|x)[-.\s]?\d{1,6}\s*$", ""), r"[^0-9]", "")
    runs = d.rlike("|".join([UP[i : i + 5] for i in range(6)] + [DOWN[i : i + 5] for i in range(9, 15)])) & (size >= 7)
    ten = F.regexp_replace(d, r"^1(?=\d{10}$)", "")
    foreign = t.startswith("0") | (t.startswith("+") & ~t.rlike(r"^\+1[-.\s]?\(?\d{3}"))
    own = (
        F.lit(100.0)
        - F.when(t.rlike(r"^\d{3}[-.\s]\d{2}[-.\s]\d{4}$"), 50.0).otherwise(0.0)
        - F.when(epoch, 60.0).otherwise(0.0)
        - F.when(card, 60.0).otherwise(0.0)
        - F.when(invalid, 70.0).otherwise(0.0)
        - F.when(size.between(7, 15), 0.0).otherwise(15.0)
        - F.when(n.isin(PHONE_TESTS) | fictional, 20.0).otherwise(0.0)
        - F.when(t.rlike(r"[^\d+\-.\s()]"), 10.0).otherwise(0.0)
        - F.when(runs, 15.0).otherwise(0.0)
        - F.when(d.rlike(r"(\d)\1{4}") & (size >= 7), 15.0).otherwise(0.0)
        + F.when(foreign | (F.char_length(ten) == 10), 5.0).otherwise(-10.0)
        + F.when(t.startswith("+") & (size >= 10), 10.0).otherwise(0.0)
    )
    seen = F.when(_phone_like(t, before, after), F.col("context")).otherwise(-100.0)
    total = clamp(F.greatest(own, F.lit(0.0)) + seen + F.when(F.col("table"), 15.0).otherwise(0.0), 0, 100)
    total = F.when(stripped.rlike(r"^1?(?:\d{3})?55501\d\d$"), F.least(total, F.lit(FICTIONAL))).otherwise(total)
    return _found(first_numbers(rows.withColumn("score", total).where("score > 0")), "phone", F.lit("PHONE"), F.col("score"))


# ---- dates of birth -----------------------------------------------------------------------------------------------
# Months, labels, words against.
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sep|Oct|Nov|Dec"
MONTH_STARTS, MONTH_DAYS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"], [31, 29, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31]
BIRTH_STRONG = ["date of birth", "dob", "d.o.b", "date-of-birth", "date_of_birth", "patient dob", "applicant dob", "member dob", "birthdate", "birth date"]
BIRTH_WORDS = [*BIRTH_STRONG, "born", "birthday", "age", "years old", "birth", "born on"]
BIRTH_LABELS = "date of birth|date-of-birth|date_of_birth|patient dob|applicant dob|member dob|birthdate|birth date|dob"
BIRTH_AGAINST = [
    "created", "modified", "expires", "expiry", "due", "deadline", "meeting", "published", "released", "updated", "version", "build", "compiled", "deployed",
    "installed", "accessed", "logged", "timestamp", "last modified", "created at", "updated at", "file date", "upload date", "download date", "start date",
    "end date", "effective date", "issue date", "event date", "schedule", "appointment", "calendar", "copyright",
]
BIRTH_THINGS = [
    "project", "company", "idea", "server", "building", "wine", "team", "system", "tool", "framework", "software", "tradition", "service", "organization",
    "product", "brand", "initiative", "movement", "control", "minimum", "policy", "certificate", "bottled",
]
VERSIONS = r"(?i)\b(?:version|build|release|upgrade|patch|changelog|semver|pip|npm|v\d+\.\d+)\b|==\d"


def date_of_birth(lines: DataFrame, last_year: int | None = None) -> DataFrame:
    """last_year bounds plausible years and is the pivot of two-digit ones; by default the current year."""
    year_now = F.year(F.current_date()) if last_year is None else F.lit(last_year)
    numeric = r"\d{1,2}[/\-.]\d{1,2}[/\-.]\d{4}|" + "|".join(rf"\d{{1,2}}{s}\d{{1,2}}{s}\d{{2}}" for s in ("/", "-", r"\."))
    worded = rf"(?:{MONTHS})\s+\d{{1,2}}(?:st|nd|rd|th)?,?\s+\d{{4}}|\d{{1,2}}(?:st|nd|rd|th)?\s+(?:{MONTHS}),?\s+\d{{4}}"
    low = F.col("lower")
    named, strong, tests, against = count_words(BIRTH_WORDS), has_word(BIRTH_STRONG), has_word(TESTS), count_words(BIRTH_AGAINST)
    lead = F.regexp_extract(low, rf"^(.*?)(?:{BIRTH_LABELS})", 1)
    before_label = ~low.rlike(BIRTH_LABELS) | lead.rlike(word_pattern(TESTS))
    weak = F.when((named == 0) | has_word(BIRTH_THINGS), -10.0).when(named >= 2, 70.0).otherwise(55.0)
    context = F.when(tests & (~strong | before_label), -50.0).when(strong, 75.0).when(against > 0, F.greatest(F.lit(-50.0), against * F.lit(-20.0))).otherwise(weak)
    rows = candidates(lines, _word(rf"\d{{4}}-\d{{2}}-\d{{2}}|{numeric}|{worded}"), F.col("line").rlike(r"\d"), context=context, versions=F.col("line").rlike(VERSIONS))
    t = F.col("text")
    digits = F.regexp_extract_all(t, F.lit(r"\d+"), F.lit(0))
    number = lambda i: F.try_element_at(digits, F.lit(i)).cast("int")
    iso, month_name = t.rlike(r"^\d{4}-"), F.array_position(F.array(*map(F.lit, MONTH_STARTS)), F.substring(F.lower(F.regexp_extract(t, "[A-Za-z]{3,}", 0)), 1, 3)).cast("int")
    named_month = t.rlike("[A-Z][a-z]{2}")
    a, b = number(1), number(2)
    short = F.char_length(F.element_at(digits, -1)) == 2
    year = F.when(iso, a).otherwise(number(-1))
    year = F.when(short & ~iso, F.when(year <= year_now % 100, year + 2000).otherwise(year + 1900)).otherwise(year)
    day_first = a.between(13, 31) & b.between(1, 12)
    month = F.when(iso, b).when(named_month, month_name).when(day_first, b).otherwise(a)
    day = F.when(iso, number(3)).when(named_month, a).when(day_first, a).otherwise(b)
    most = F.get(F.array(*map(F.lit, MONTH_DAYS)), month - 1)
    rows = rows.where(month.between(1, 12) & (day >= 1) & (day <= most) & year.between(1900, year_now) & ~(short & t.contains(".") & F.col("versions")))
    score = F.lit(15.0) + F.when(F.col("after").rlike(ASIDE.format("|".join(TESTS))), -50.0).otherwise(F.col("context"))
    return _found(rows, "dob", F.lit("DATE_OF_BIRTH"), clamp(score, 0, 100))


# ---- driver's licences --------------------------------------------------------------------------------------------
# Number shapes by state, labels, words.
LICENCES = [r"[A-Za-z]{2}\d{6}", r"[A-Za-z]\d{14}", r"[A-Za-z]\d{13}", r"[A-Za-z]\d{12}", r"[A-Za-z]\d{11}", r"[A-Za-z]\d{7}", r"\d{9}", r"\d{8}"]
LICENCE_PARTS = r"[A-Za-z]{0,2}\d{1,4}(?:[- ]\d{1,4}){1,4}"
LICENCE_WORDS = [
    "driver", "license", "licence", "dl", "dmv", "motor vehicle", "driving", "permit", "state id", "identification card", "operator", "driver's license",
    "drivers license", "driver license", "dl number", "license number", "licence number",
]
LICENCE_LABELS = [
    "dl:", "dl #", "dl#", "d.l.", "driver's license:", "drivers license:", "driver license:", "license number:", "licence number:", "license no:", "license no.",
]
LICENCE_FORMS = r"driver's license|drivers license|driver license|licence number|license number|license no|d\.l\.|dl:|dl #|dl#|dl "
LICENCE_AGAINST = [
    "ssn", "social security", "phone", "account", "serial", "order", "invoice", "reference", "tracking", "confirmation", "ip", "port", "version", "build", "hash",
    "isbn", "sku", "model", "software", "fishing", "hunting", "gun", "concealed", "business", "plate", "immigration", "construction", "key", "expires", "expiry",
    "renew", "mailed", "activation", "work permit",
]
LICENCE_TESTS = [*TESTS, "uuid", "guid"]
LICENCE_STATES = r"(?i)\b(?:california|texas|florida|new york|new jersey|pennsylvania|illinois|ohio|georgia|north carolina|michigan|wisconsin|CA|TX|FL|NY|NJ|PA|IL|OH|GA|NC|MI|WI)\b"


def _licence_context(column: str) -> Column:
    """What the words of a line or a header add to a number that may be a licence."""
    low = F.col(column)
    lead = F.regexp_extract(low, rf"^(.*?)(?:{LICENCE_FORMS})", 1)
    marked = F.when(low.rlike(LICENCE_FORMS), lead.rlike(rf"(?<![a-z0-9_])(?:{'|'.join(LICENCE_TESTS)})(?![a-z0-9_])")).otherwise(has_word(LICENCE_TESTS, column))
    n = count_words(LICENCE_WORDS, column, LABEL_GAP)
    by_words = F.when(n > 0, 45.0 + F.least(F.lit(20.0), (n - 1) * F.lit(10.0))).otherwise(0.0) + F.when(low.rlike(LICENCE_STATES), 20.0).otherwise(0.0)
    score = F.when(any_of(low, LICENCE_LABELS, "contains"), 75.0).otherwise(by_words) - F.when(has_word(LICENCE_AGAINST, column), 20.0).otherwise(0.0)
    return F.when(marked, -20.0).otherwise(clamp(score, -30, 80))


def _licence_named(column: str) -> Column:
    low = F.col(column)
    return has_word(LICENCE_WORDS, column, LABEL_GAP) | (low.rlike(LICENCE_STATES) & (has_word(["id"], column) | low.contains("number") | low.contains("no.") | low.contains("no:")))


def drivers_license(lines: DataFrame) -> DataFrame:
    """A number counts only with a label on its line, on the line above, or as its column's header."""
    label = F.when(field_label(F.col("above"), LICENCE_WORDS), F.lower("above")).otherwise("")
    lines = lines.withColumns({"label": label, "heads": F.coalesce(F.array_join("table.headers", " | "), F.lit(""))})
    named = _licence_named("lower") | (F.col("label") != "")
    asked = {"named": named, "context": _licence_context("lower"), "from_above": F.when(F.col("label") == "", 0.0).otherwise(F.greatest(F.lit(0.0), _licence_context("label")))}
    rows = candidates(lines, _word(f"(?:{'|'.join(LICENCES)})(?![- ]\\d)|{LICENCE_PARTS}|{'|'.join(LICENCES)}"), named | _licence_named("heads"), True, **asked)
    t = F.col("text")
    bare = F.regexp_replace(t, "[- ]", "")
    parts = F.split(t, "[- ]")
    sizes = lambda *want: (F.size(parts) == len(want)) & F.expr(" AND ".join(f"length(get(split(text, '[- ]'), {i})) {w}" for i, w in enumerate(want)))
    dated = t.rlike("^[0-9 -]+$") & (t != bare) & (sizes("= 5", "= 4") | sizes("<= 2", "<= 2", "IN (2, 4)") | sizes("= 4", "<= 2", "<= 2"))
    shaped = bare.rlike("^(?:" + "|".join(LICENCES) + ")$")
    column = F.when(F.col("header") == "", 0.0).otherwise(F.greatest(F.lit(0.0), _licence_context("header")))
    rows = rows.where(shaped & ~dated & ~t.rlike(r"^\d{3}-\d{2}-\d{4}$") & (F.col("named") | (column > 0)))
    d = F.regexp_replace(t, "[^0-9]", "")
    runs = (F.char_length(d) >= 8) & (F.lit(UP).contains(d) | F.lit(DOWN).contains(d))
    own = F.greatest(F.lit(0.0), F.lit(20.0) - F.when(d.rlike("^0+$"), 20.0).otherwise(0.0) - F.when(d.rlike(r"^(\d)\1*$"), 20.0).otherwise(0.0) - F.when(runs, 15.0).otherwise(0.0))
    context = F.when(F.col("after").rlike(ASIDE.format("|".join(LICENCE_TESTS))), -20.0).otherwise(F.col("context"))
    return _found(rows, "driverslicense", F.lit("DRIVERS_LICENSE"), clamp(own + context + F.col("from_above") + column, 0, 100))


# ---- one-time passwords -------------------------------------------------------------------------------------------
# Words, secrets that specifications print.
OTP_WORDS = [
    "two-factor", "2fa", "mfa", "authenticator", "recovery code", "backup code", "totp", "hotp", "secret key", "otpauth", "google authenticator", "authy", "otp",
    "one-time", "multi-factor", "verification code", "secret", "seed", "provisioning", "enrollment", "setup key", "passcode", "one time", "one-time password",
    "one time password", "two-step", "two step", "authentication code", "security code",
]
OTP_AGAINST = [
    "license", "activation", "product key", "serial", "uuid", "hash", "jwt", "bearer", "certificate", "test", "example", "sample", "placeholder", "fake", "mock",
    "demo", "padding", "encoded", "base64",
]
OTP_RECOVERY = ["recovery code", "backup code", "recovery codes", "backup codes", "recovery", "backup", "2fa", "mfa", "two-factor", "emergency"]
OTP_NOT_RECOVERY = [
    "product key", "product keys", "license", "activation", "serial", "version", "firmware", "patch", "release", "exit", "room", "door", "floor", "staff",
    "employee", "device id", "tracking", "order", "invoice", "disk", "contains key", "replacement",
]
OTP_PUBLISHED = ["GEZDGNBVGY3TQOJQGEZDGNBVGY3TQOJQ", "GEZDGNBVGY3TQOJQ", "JBSWY3DPEHPK3PXP"]
OTP_ENGLISH = "DOCUMENT|SECRET|PRIVATE|PUBLIC|SERVER|CLIENT|ACCESS|CHANGE|DELETE|CREATE|UPDATE|SELECT|INSERT|MASTER|BACKUP|RETURN|EXPORT|IMPORT|SECURE"
OTP_BLOCK = r"[A-Za-z0-9]{4,10}(?:-[A-Za-z0-9]{4,10}){1,4}"
BASE32, PUBLISHED_CAP = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 15.0
JWT = r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"


def _word_like(upper: Column) -> Column:
    """Whether base32 letters look written rather than drawn: repeats, runs, alternation, or English words."""
    places = F.transform(_chars(upper), lambda c: F.instr(F.lit(BASE32), c))
    n = F.char_length(upper)
    steps = F.size(F.filter(F.zip_with(F.slice(places, F.lit(2), n - 1), F.slice(places, F.lit(1), n - 1), lambda x, y: F.abs(x - y)), lambda d: d == 1))
    blocks = F.aggregate(F.regexp_extract_all(upper, F.lit(r"(.)\1{2,}"), F.lit(0)), F.lit(0), lambda a, x: a + F.char_length(x))
    letter = lambda odd, digit: F.size(F.filter(places, lambda p, i: (i % 2 == odd) & ((p > 26) == digit)))
    least = F.floor(F.floor(n / 2) * 0.8)
    zigzag = ((letter(0, False) >= least) & (letter(1, True) >= least)) | ((letter(0, True) >= least) & (letter(1, False) >= least))
    return upper.rlike(r"^(.{1,4}?)\1+$") | (steps / F.greatest(n - 1, F.lit(1)) > 0.7) | zigzag | (blocks / F.greatest(n, F.lit(1)) > 0.7) | upper.rlike(OTP_ENGLISH)


def otp(lines: DataFrame) -> DataFrame:
    """URIs anywhere; base32 secrets beside their words or below their headers; blocks of recovery codes in twos or more."""
    line, t = F.col("line"), F.col("text")
    token = line.rlike(JWT)
    refused = has_word(OTP_AGAINST) | (token & has_word(["session"]))
    context = clamp(words_score(OTP_WORDS, 15.0) + words_score(OTP_AGAINST, -15.0) - F.when(token & has_word(["session"]), 15.0).otherwise(0.0), -40, 40)
    lines = lines.withColumn("heads", F.when(F.col("line_number") != F.col("table.header_line"), F.array_join("table.headers", " | ")))
    headed = F.coalesce(has_word(OTP_WORDS, "heads"), F.lit(False))
    asked = {"context": context, "refused": refused, "named": has_word(OTP_WORDS), "headed": headed}
    published = F.upper(F.regexp_replace(t, "[= -]", "")).isin(OTP_PUBLISHED) | F.upper(F.regexp_extract(t, "(?i)[?&]secret=([A-Za-z2-7]+)", 1)).isin(OTP_PUBLISHED)

    def part(rows: DataFrame, kind: str, own: Column, negative: bool) -> DataFrame:
        rows = rows.where(F.col("named") | ~F.col("headed") | has_word(OTP_WORDS, "header"))
        score = clamp(own + F.col("context") - (F.when(F.col("refused"), 30.0).otherwise(0.0) if negative else 0.0), 0, 100)
        return _found(rows, "otp", F.lit(kind), F.when(published, F.least(score, F.lit(PUBLISHED_CAP))).otherwise(score))

    uri = candidates(lines, NOT_WORD_BEFORE + r"otpauth://(?:totp|hotp)/[^\s\"'<>]+", None, True, **asked)
    out = part(uri, "OTPAUTH_URI", F.when(t.contains("secret="), 95.0).otherwise(90.0), False)
    secret = candidates(lines, _word("[A-Z2-7]{16,64}|[a-z2-7]{16,64}"), has_word(OTP_WORDS) | headed, True, **asked)
    upper, lower_case = F.upper(t), t.rlike("[a-z]")
    secret = secret.where(~F.col("before").rlike("otpauth://[^ ]*$") & ~t.rlike("^[0-9a-fA-F]{32,}$|^(?:AKIA|ASIA)[A-Z0-9]{16}$") & ~(lower_case & _word_like(upper)))
    size = F.char_length(t)
    own = F.lit(55.0) + F.when(size >= 32, 10.0).when(size >= 20, 5.0).otherwise(0.0) - F.when(_word_like(upper), 50.0).otherwise(0.0)
    out = out.unionByName(part(secret, "OTP_SECRET", own, True))
    low = F.col("lower")
    strong = F.regexp_instr(low, F.lit(word_pattern(["recovery code", "recovery codes", "backup code", "backup codes"])))
    other = F.regexp_instr(low, F.lit(word_pattern(OTP_NOT_RECOVERY)))
    recovery = has_word(OTP_RECOVERY) & ((other == 0) | ((strong > 0) & (other > strong)))
    codes = candidates(lines, _word(OTP_BLOCK), recovery & (F.regexp_count(line, F.lit(_word(OTP_BLOCK))) >= 2), True, **asked)
    codes = codes.where(~t.rlike(r"(?i)^[0-9a-f]+(?:-[0-9a-f]+)+$"))
    blocks = F.split(t, "-")
    even = F.size(F.array_distinct(F.transform(blocks, F.char_length))) == 1
    own = F.lit(50.0) + F.when(F.size(blocks) >= 3, 10.0).otherwise(0.0) + F.when(even, 10.0).otherwise(0.0)
    return out.unionByName(part(codes, "RECOVERY_CODES", own, True))


# ---- passports ----------------------------------------------------------------------------------------------------
# Number shapes, words with their weights, countries, published numbers.
PASSPORTS = {"US": r"[A-Z]\d{8}", "UK": r"\d{9}", "Canada": r"[A-Z]{2}\d{6}", "EU": r"[A-Z]{2}[A-Z0-9]{7}"}
MRZ_FIRST, MRZ_SECOND = r"P<[A-Z]{3}[A-Z0-9<]{38,40}", r"[A-Z0-9<]{44}"
PASSPORT_WORDS = {
    "passport": 15, "passport number": 15, "passport no": 15, "travel document": 12, "travel document number": 12, "document number": 10, "document no": 10, "mrz": 12,
    "machine readable": 10, "icao": 8, "passport holder": 10, "visa": 6, "immigration": 6, "border control": 6, "customs": 5, "embassy": 5, "consulate": 5,
    "nationality": 4, "citizenship": 4, "issuing authority": 6, "passport authority": 8, "identification": 3, "identity": 3, "travel": 2, "international": 2,
    "foreign": 2, "expiry": 3, "expiration": 3, "issue date": 3, "valid until": 3, "expires": 3, "surname": 2, "given name": 2, "date of birth": 2,
    "place of birth": 2, "gender": 1, "sex": 1,
}
PASSPORT_AGAINST = [
    "example", "test", "sample", "mock", "fake", "dummy", "placeholder", "template", "demo", "random", "generated", "simulation", "synthetic", "uuid", "guid",
    "serial", "serial number", "product code", "model", "version", "build", "revision", "commit", "hash", "checksum", "tracking", "shipment", "order", "invoice",
    "receipt", "transaction", "customer", "account", "username", "login", "password", "pin", "reference", "confirmation", "booking", "reservation", "primary key",
    "foreign key", "index", "database", "table", "record", "field", "column", "row", "entry", "item", "element",
]
PASSPORT_STRONG = ["passport", "travel document", "document number", "mrz", "machine readable zone"]
PASSPORT_MEDIUM = [
    "visa", "immigration", "border", "customs", "embassy", "consulate", "nationality", "citizenship", "travel", "international", "foreign", "expiry", "expiration",
    "expires", "valid until", "issue date",
]
PASSPORT_FORM = r"passport.*[:=]|document.*:|number.*:|no.*:|#.*:|\t[^\t]*\t|\s{3,}"
PASSPORT_TESTS = ["A00000000", "A11111111", "A12345678", "AA000000", "XX0000000", "000000000", "123456789", "AB123456", "AB000000"]
PASSPORT_COUNTRIES = "AT BE BG HR CY CZ DK EE FI FR DE GR HU IE IT LV LT LU MT NL PL PT RO SK SI ES SE GB CH NO IS LI US CA MX CN JP KR IN SG AU NZ BR AR CL ZA EG NG".split()
MRZ_COUNTRIES = (
    "GBR DEU FRA ITA ESP NLD BEL CHE AUT SWE NOR DNK FIN IRL PRT POL CZE GRC HUN ROU USA CAN MEX CHN JPN KOR IND SGP HKG TWN THA MYS IDN AUS NZL BRA ARG CHL COL PER ZAF EGY NGA ARE SAU ISR TUR"
).split()


def mrz_digit(s: Column) -> Column:
    """Check digit of a machine-readable field: weights 7, 3, 1 over digits, letters as 10 to 35, < as 0."""
    n = lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).when(c == "<", 0).otherwise(F.ascii(c) - 55)
    parts = F.transform(_chars(s), lambda c, i: n(c) * F.when(i % 3 == 0, 7).when(i % 3 == 1, 3).otherwise(1))
    return F.aggregate(parts, F.lit(0), lambda a, x: a + x) % 10


def mrz_second(t: Column) -> Column:
    """Whether a text is a second machine-readable line, by its shape, dates and five check digits."""
    good = lambda field, at: F.substring(t, at, 1) == mrz_digit(field).cast("string")
    part = lambda at, n: F.substring(t, at, n)
    date = r"\d\d(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])"
    whole = F.concat(part(1, 10), part(14, 7), part(22, 22))
    shape = t.rlike(rf"^[A-Z0-9<]{{9}}\d[A-Z<]{{3}}{date}\d[MF<]{date}\d[A-Z0-9<]{{14}}\d\d$")
    return shape & good(part(1, 9), 10) & good(part(14, 6), 20) & good(part(22, 6), 28) & good(part(29, 14), 43) & good(whole, 44)


def passport(lines: DataFrame) -> DataFrame:
    """Reported from above 60 only, and only with a word for it near, on the line above, or in the column's header."""
    line, low = F.col("line"), F.col("lower")
    above = F.when(field_label(F.col("above"), list(PASSPORT_WORDS)), F.lower(F.trim("above"))).otherwise("")
    lines = lines.withColumn("label", above)
    lines = lines.withColumn("seen", F.concat_ws(" ", "lower", "label"))
    seen = F.col("seen")
    weighed, against = either_score("line", "seen", {w: (n * 1.5, n) for w, n in PASSPORT_WORDS.items()}), either_score("line", "seen", dict.fromkeys(PASSPORT_AGAINST, (-20.0, -10.0)))
    medium = parts_score("seen", PASSPORT_MEDIUM, 1.0)
    form = low.rlike(PASSPORT_FORM)
    strong = any_of(seen, PASSPORT_STRONG, "contains") | (medium >= 2) | (form & any_of(seen, ["travel", "document", "identification", "identity", "international"], "contains"))
    asked = {"weighed": weighed + against, "form": form, "strong": strong, "named_at": F.instr(low, "passport"), "table": tabular_line(r"[A-Z][a-z]+\s+[A-Z][a-z]+\s+[A-Z0-9]{6,10}")}
    first, second = rf"(?<![A-Z0-9<]){MRZ_FIRST}", rf"(?<![A-Z0-9<]){MRZ_SECOND}(?![A-Z0-9<])"
    rows = candidates(lines, f"{first}|{second}|{_word('|'.join(PASSPORTS.values()))}", None, True, **asked)
    t = F.col("text")
    is_first, is_second = t.startswith("P<"), mrz_second(t)
    kind = F.when(is_first, "MRZ").when(is_second, "MRZ2")
    for name, shape in PASSPORTS.items():
        kind = kind.when(t.rlike(f"^{shape}$"), name)
    same = t.rlike(r"^(.)\1{5,}$") | (t.rlike("^[0-9]{6,}$") & F.lit(UP[:10]).contains(t))
    rows = rows.withColumn("kind", kind).where(F.col("kind").isNotNull() & ~t.isin("A12345678", "123456789", "AB123456") & ~same)
    kind = F.col("kind")
    vowels = F.char_length(F.regexp_replace(F.upper(t), "[^AEIOU]", "")).cast("double")
    wordy = (vowels >= 1) & (vowels / F.greatest(F.char_length(t), F.lit(1))).between(0.2, 0.6)
    known = F.substring(t, 1, 2).isin(PASSPORT_COUNTRIES)
    mrz = F.when(kind == "MRZ", F.when(F.substring(t, 3, 3).isin(MRZ_COUNTRIES), 20.0).otherwise(-10.0)).when(kind == "MRZ2", F.when(F.substring(t, 11, 3).isin(MRZ_COUNTRIES), 25.0).otherwise(15.0))
    own = (
        F.lit(60.0) + mrz.otherwise(0.0) - F.when(t.isin(PASSPORT_TESTS), 45.0).otherwise(0.0) - F.when(wordy, 65.0).otherwise(0.0)
        - F.when(kind.isin("Canada", "EU") & ~known, 15.0).otherwise(0.0) - F.when((kind == "EU") & F.substring(t, 1, 2).isin("XX", "YY", "ZZ"), 20.0).otherwise(0.0)
    )
    header = either_score("header", "header", {w: (n, n) for w, n in PASSPORT_WORDS.items()}) - parts_score("header", PASSPORT_AGAINST, 10.0)
    apart = F.abs(F.col("start") + 1 - F.col("named_at"))
    beside = F.lower(F.concat(F.right("before", F.lit(50)), F.lit(" "), F.left("after", F.lit(50)))).contains("passport")
    near = F.when((F.col("named_at") > 0) & t.rlike("^[0-9]+$"), F.when(apart <= 20, 25.0).when(apart <= 50, 15.0).otherwise(8.0)).when(beside, 5.0).otherwise(0.0)
    context = clamp(near + F.col("weighed") + F.when(F.col("header") == "", 0.0).otherwise(header) + F.when(F.col("form"), 15.0).otherwise(0.0), -60, 40)
    score = clamp(F.greatest(own, F.lit(0.0)) + context + F.when(F.col("table"), 15.0).otherwise(0.0), 0, 100)
    strong = F.col("strong") | any_of(F.col("header"), PASSPORT_STRONG, "contains") | (kind == "MRZ2")
    strong = strong | ((kind == "MRZ") & (F.char_length(t) >= 44) & t.rlike("(?:<[^<]*){5}") & F.substring(t, 3, 3).isin(MRZ_COUNTRIES))
    return _found(rows.where(strong & (score > 60)), "passport", F.lit("PASSPORT"), score)


# ---- postal addresses ---------------------------------------------------------------------------------------------
# Suffixes of streets, states, labels, words that no street begins with.
SUFFIXES = (
    "Street|St|Avenue|Ave|Boulevard|Blvd|Drive|Dr|Lane|Ln|Court|Ct|Road|Rd|Way|Parkway|Pkwy|Circle|Cir|Place|Pl|Terrace|Ter|Trail|Trl|Loop|Run|Pass|Pike|Highway|Hwy|Square|Sq|Ridge|Point|Cove|Bend|"
    "Landing|Crossing|Commons|Row|Walk|Green|Path|Glen|Hollow|Meadow|Summit|Vista"
)
STATES = "AL|AK|AZ|AR|CA|CO|CT|DE|FL|GA|HI|ID|IL|IN|IA|KS|KY|LA|ME|MD|MA|MI|MN|MS|MO|MT|NE|NV|NH|NJ|NM|NY|NC|ND|OH|OK|OR|PA|RI|SC|SD|TN|TX|UT|VT|VA|WA|WV|WI|WY|DC"
PLACE, ZIP, UNIT = rf"(?i)\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*,?\s+(?:{STATES})\s+\d{{5}}(?:-\d{{4}})?\b", r"\b\d{5}(?:-\d{4})?\b", r"(?i)\b(?:Apt|Apartment|Ste|Suite|Unit|#)\s*\.?\s*[A-Za-z0-9-]+\b"
ADDRESS_WORDS = [
    "address", "street", "mailing", "shipping", "billing", "residence", "home", "office", "deliver", "apt", "suite", "unit", "floor", "location", "postal", "mail to",
    "ship to", "send to", "located at",
]
ADDRESS_AGAINST = [
    "ip", "version", "line", "page", "step", "item", "chapter", "section", "figure", "table", "equation", "test", "example", "sample", "placeholder", "fake", "mock",
    "demo", "lorem", "foo", "bar",
]
ADDRESS_LABEL = r"(?i)\b(?:mailing|home|business|billing|shipping|street|physical|postal|residence|work)\s+address\b|\baddress\s*:"
ADDRESS_PLACE = r",\s*[A-Z][A-Za-z.'-]*(?:\s+[A-Z][A-Za-z.'-]*)*\s+[A-Z]{2}\s+\d{5}(?:-\d{4})?\b"
NOT_STREETS = "on|in|at|the|of|for|to|from|with|by|is|are|was|were|be|an|and|or|not|but|connections|processes|items|records|entries|requests|events|sessions"
DAYS = "january|february|march|april|may|june|july|august|september|october|november|december|jan|feb|mar|apr|jun|jul|aug|sep|oct|nov|dec|monday|tuesday|wednesday|thursday|friday|saturday|sunday"
SOURCES = "go|py|js|ts|java|rb|rs|c|cpp|h|cs|swift|kt|php|scala|m|mm"
_NAME = r"(?:[A-Za-z][A-Za-z0-9'\-]*[A-Za-z0-9]|[A-Za-z]|\d{1,4}(?:st|nd|rd|th|ST|ND|RD|TH))"
#: A street's number, its name of at most ten words, and its suffix.
STREET = rf"\d{{1,6}}\s+(?:[NSEW]\.\s+|(?:N[EW]|S[EW])\.\s+)?{_NAME}(?:\s+{_NAME}){{0,9}}\s+(?:(?:Hwy|Highway)\.?(?:\s+\d{{1,4}})?|(?:{SUFFIXES})\.?)(?<=[0-9A-Za-z])"


def physical_address(lines: DataFrame) -> DataFrame:
    """Two lines around an address tell about it too."""
    line, low = F.col("line"), F.col("lower")
    around, next_to = F.concat_ws(" ", "above2", "above", "below", "below2"), F.concat_ws(" ", "above", "below")
    lines = lines.where(~line.rlike(r"^\s*\d*\s*$")).withColumn("around", F.lower(around))
    here, there, code, state = line.rlike(PLACE), around.rlike(PLACE), around.rlike(ZIP), around.rlike(rf"\b(?:{STATES})\b")
    worded = has_word(ADDRESS_WORDS)
    boost = F.when(worded, 15.0).when(has_word(ADDRESS_WORDS, "around"), 8.0).otherwise(0.0) - F.when(has_word(ADDRESS_AGAINST), 25.0).otherwise(0.0)
    unit = F.when(line.rlike(UNIT), 10.0).when(next_to.rlike(UNIT), 5.0).otherwise(0.0)
    place = lambda own, near, both, alone: F.when(here, own).when(there, near).when(state & code, both).when(code, alone).otherwise(0.0)

    def part(pattern: str, kind: str, base: float, near: Column, only: Column) -> DataFrame:
        return _found(candidates(lines, pattern, only, score=clamp(F.lit(base) + near + boost, 0, 100)), "physical_address", F.lit(kind), F.col("score"))

    long_route = r"(?i:(?:Rural\s+Route|Star\s+Route)\s+\d{1,4}(?:\s*,?\s*Box\s+\d{1,6})?|(?:RR|R\.R\.|HC)\s+\d{1,4}\s*,?\s*Box\s+\d{1,6})"
    out = part(_word(r"(?i:P\.?\s*O\.?\s*Box|Post\s+Office\s+Box)\s+\d{1,10}"), "PO_BOX", 60.0, place(25.0, 20.0, 10.0, 10.0), low.contains("box"))
    out = out.unionByName(part(_word(long_route), "US_RURAL_ROUTE", 55.0, place(20.0, 20.0, 15.0, 10.0), low.rlike("route|rr|r\\.r\\.|hc")))
    out = out.unionByName(part(_word(r"(?i:RR|R\.R\.|HC)\s+\d{1,4}"), "US_RURAL_ROUTE", 40.0, place(20.0, 20.0, 15.0, 10.0), low.rlike("rr|r\\.r\\.|hc") & ~line.rlike(_word(long_route))))
    army = r"(?i:(?:PSC|CMR|Unit)\s+\d{1,5}(?:\s*,?\s*Box\s+\d{1,6})?\s*,?\s*(?:APO|FPO|DPO)\s+(?:AA|AE|AP)\s+\d{5}(?:-\d{4})?)"
    out = out.unionByName(part(_word(army), "US_MILITARY_ADDRESS", 80.0, F.lit(0.0), low.rlike("apo|fpo|dpo")))
    asked = {"score": F.lit(50.0) + place(30.0, 25.0, 20.0, 10.0) + unit + boost, "evidence": line.rlike(ADDRESS_LABEL) | line.rlike(ADDRESS_PLACE)}
    any_case = worded | here
    streets = candidates(lines, _word(f"(?i:{STREET})"), any_case & line.rlike(r"\d\s+\S"), **asked).unionByName(candidates(lines, _word(STREET), ~any_case & line.rlike(r"\d\s+[A-Za-z0-9]"), **asked))
    t, before, after = F.col("text"), F.col("before"), F.col("after")
    named = F.lower(F.regexp_extract(t, r"^\d+\s+(.*)\s+\S+$", 1))
    inside = before.rlike(r"\d\.$|\d\s*[+\-*/=<>]+\s*$") | t.rlike(r"^\d+\.\d") | F.concat(t, after).rlike(rf"^\d+\s+\w+\.(?:{SOURCES})\b") | after.rlike(rf"^\.?(?i:{SOURCES})(?![0-9A-Za-z_])") & after.startswith(".")
    unlikely = ~F.col("evidence") & (named.rlike(rf"^(?:{DAYS})$") | named.rlike(rf"^(?:{NOT_STREETS})\s+(?:\S+\s+)*(?!(?:{NOT_STREETS})(?:\s|$))\S"))
    streets = streets.where(~inside & ~unlikely & (F.char_length(named) != 1))
    score = F.col("score") - F.when(t.rlike(f"^{STREET}$"), 0.0).otherwise(10.0)
    return out.unionByName(_found(streets, "physical_address", F.lit("US_STREET_ADDRESS"), clamp(score, 0, 100)))


# ---- legal marks --------------------------------------------------------------------------------------------------
# Shapes of marks, words, printed examples, and what several marks of one line add.
MARKS = {
    "copyright": r"(?i)(?:©|\(c\)|Copyright)\s*(?:\d{4}(?:[-,–—]\s?\d{4})?)?[\s,–—-]*[\p{L}0-9][\p{L}0-9\s.,&'()\-–—]*",
    "patent": r"\b(?:US|EP|JP|CN|WO)[ -]?(?:\d{1,3}[,.]?\d{3}[,.]?\d{3}|\d{1,3}[,.]?\d{3}[,.]?\d{2}[A-Z]\d?)\b",
    "trademark": r"(?i)\b(?:\w+\s*\(TM\)|\w+\s*\(R\)|\w+\s*[™®]|\w+\s+Registered\s+Trademark\b|\w+\s+Trademark\b)",
    "trade_secret": r"(?i)\b(?:Confidential|Trade\s+Secret|Proprietary|Company\s+Confidential|Internal\s+Use\s+Only|Restricted|Classified)\b",
}
MARK_SIGNS = {"copyright": r"copyright|\(c\)|©", "patent": r"us|ep|jp|cn|wo", "trademark": r"trademark|\(tm\)|\(r\)|[™®]", "trade_secret": "confidential|secret|proprietary|internal|restricted|classified"}
LEGAL_WORDS = [
    "patent", "trademark", "copyright", "intellectual property", "ip rights", "proprietary", "confidential", "trade secret", "invention", "inventor", "assignee",
    "priority date", "filing date", "granted", "registered", "uspto", "epo", "wipo", "infringement", "license", "royalty", "exclusive rights", "protected", "patented",
    "copyrighted", "all rights reserved", "unauthorized use", "proprietary technology", "proprietary algorithm", "proprietary process", "proprietary method",
    "proprietary formula", "confidentiality agreement", "nda", "non-disclosure", "trade dress", "service mark", "industrial design", "mask work", "sui generis",
    "patent pending", "patent-pending", "licensed under", "respective owners", "all trademarks", "patents pending",
]
LEGAL_AGAINST = [
    "example", "sample", "test", "dummy", "placeholder", "template", "demo", "mock", "fake", "random", "tutorial", "learning", "public domain", "open source",
    "creative commons", "mit license", "gpl", "apache license", "bsd license", "free to use", "royalty-free", "no warranty", "as-is", "disclaimer", "not protected",
]
LEGAL_SAMPLES = {"copyright": r"(?:Example|Sample|Test|Demo) Company", "patent": r"^(?:US|EP|WO) ?(?:1234567|1,234,567)$", "trademark": "(?:Example|Sample|Test|Demo)TM", "trade_secret": "(?:Example|Sample|Test) Confidential"}
NOTICE_LENGTH, NOTICE_MOST, NOTICE_KINDS, NOTICE_REPEATED = 200, 98.0, {1: 0.0, 2: 6.0, 3: 9.0, 4: 9.0}, 5.0


def legal_marks(lines: DataFrame) -> DataFrame:
    """Each mark by itself, with its kind as mark."""
    low, t = F.col("lower"), F.col("text")
    context = clamp(parts_score("lower", LEGAL_WORDS, 7.0) + parts_score("lower", LEGAL_AGAINST, -15.0), -50, 25)
    free = low.rlike("apache|mit license|bsd|gpl|open source|creative commons")
    whole = F.when(F.octet_length(F.trim("line")) <= NOTICE_LENGTH, F.trim("line"))
    size = F.struct(F.char_length("line").alias("chars"), F.octet_length("line").alias("octets"))
    signed = [(pattern, low.rlike(MARK_SIGNS[mark])) for mark, pattern in MARKS.items()]
    rows = candidates(lines, signed, context=context, free=free, whole=whole, size=size)
    base = {
        "copyright": F.when(t.contains("©"), 90.0).otherwise(80.0) - F.when(t.rlike(r"\d{4}"), 0.0).otherwise(20.0),
        "patent": F.lit(80.0),
        "trademark": F.when(t.rlike("[™®]"), 90.0).otherwise(80.0),
        "trade_secret": F.when(t.rlike("Confidential|Trade Secret|Internal Use Only") & ~F.col("free"), 70.0).otherwise(45.0),
    }
    kind, score = F, F
    for i, mark in enumerate(MARKS):
        kind, score = kind.when(F.col("way") == i, mark), score.when(F.col("way") == i, base[mark] - F.when(t.rlike(LEGAL_SAMPLES[mark]), 30.0).otherwise(0.0))
    return rows.withColumns({"mark": kind, "score": clamp(score + F.col("context"), 0, 100)}).where("score > 0")


def intellectual_property(lines: DataFrame, urls: list[str] | None = None) -> DataFrame:
    """Legal marks; those of one line are one notice over the line, scored by its best mark and their kinds.

    urls: patterns of internal addresses, which score 95.  A long line's notice shows its first mark.
    """
    line = Window.partitionBy("line_key")
    best = line.orderBy((F.col("score") + F.char_length("text") * 0.1 + F.when(F.col("mark") == "copyright", 10.0).otherwise(0.0)).desc(), "start", "mark")
    marks = legal_marks(lines).withColumns({"n": F.count(F.lit(1)).over(line), "kinds": F.size(F.collect_set("mark").over(line)), "nth": F.row_number().over(best)}).where("nth = 1")
    several = F.col("n") > 1
    boost = F.when(several & (F.col("kinds") == 1), NOTICE_REPEATED).otherwise(_mapped(F.col("kinds"), NOTICE_KINDS))
    score = F.when(several, F.least(F.lit(NOTICE_MOST), F.col("score") + boost)).otherwise(F.col("score"))
    shown = F.coalesce("whole", F.concat("text", F.lit(" [+"), (F.col("n") - 1).cast("string"), F.lit(" more matches on line]")))
    notice = marks.withColumns({"score": score, "shown": F.when(several, shown).otherwise(F.col("text"))})
    over = {"start": F.when(several, F.lit(0)).otherwise(F.col("start")), "length": F.when(several, F.col("size.chars")).otherwise(F.char_length("text")), "start_col": F.when(several, F.lit(1)).otherwise(F.col("start_col")), "end_col": F.when(several, F.col("size.octets") + 1).otherwise(F.col("end_col"))}
    out = _found(notice.withColumns(over).withColumn("text", F.col("shown")), "INTELLECTUAL_PROPERTY", F.lit("INTELLECTUAL_PROPERTY"), F.col("score"))
    for pattern in urls or []:
        out = out.unionByName(_found(candidates(lines, f"(?i){pattern}"), "INTELLECTUAL_PROPERTY", F.lit("INTELLECTUAL_PROPERTY"), F.lit(95.0)))
    return out


# ---- names of people ----------------------------------------------------------------------------------------------
# Letters, shapes of names with what they add, words for and against, words of machines.
_U, _L = "A-ZÀ-ÖØ-Þ", "a-zß-öø-ÿ"
_N = f"[{_U}][{_L}]{{1,29}}"
_O = f"[{_U}][{_L}]*'{_N}"
#: (name, shape, formal, marked): a formal shape adds to known names; a marked one stands without a known last name.
NAME_SHAPES = [
    ("titles", rf"(?:Dr|Prof)\.\s+(?:Mr|Ms|Mrs)\.\s+{_N}\s+{_N}", True, True), ("title", rf"(?:Mr|Ms|Mrs|Dr|Prof|Sir|Dame|Lord|Lady)\.\s+{_N}\s+{_N}", True, True),
    ("degree", rf"{_N}\s+{_N},\s+(?:PhD|MD|DDS|JD|EdD|PharmD|PsyD|DVM|RN|CPA|PE)", True, True), ("suffix", rf"{_N}\s+{_N}\s+(?:Jr\.?|Sr\.?|III|IV|PhD|MD|Esq\.?)", True, True),
    ("comma_initial", rf"{_N},\s+{_N}\s+[{_U}]\.", True, False), ("comma_middle", rf"{_N},\s+{_N}\s+{_N}", True, False), ("comma", rf"{_N},\s+{_N}", True, False),
    ("initial", rf"{_N}\s+[{_U}]\.\s+{_N}", False, False), ("double_both", rf"{_N}-{_N}\s+{_N}-{_N}", False, False), ("double_first_long", rf"{_N}-{_N}\s+{_N}\s+{_N}", False, False),
    ("double_first", rf"{_N}-{_N}\s+{_N}", False, False), ("double_last", rf"{_N}\s+{_N}-{_N}", False, False), ("apostrophe_first", rf"{_O}\s+{_N}", False, False),
    ("apostrophe_last", rf"{_N}\s+{_O}", False, False), ("four", rf"{_N}\s+{_N}\s+{_N}\s+{_N}", False, False), ("three", rf"{_N}\s+{_N}\s+{_N}", False, False),
    ("basic", rf"{_N}\s+{_N}", False, False), ("capitals", rf"[{_U}]{{2,30}}\s+[{_U}]{{2,30}}", False, False),
]
#: What a line has to have for a shape: one of some literals; the others are tried in every line.
NAME_NEEDS = {
    "titles": ["."], "title": ["."], "degree": [","], "suffix": ["Jr", "Sr", "III", "IV", "PhD", "MD", "Esq"], "comma_initial": [","], "comma_middle": [","], "comma": [","], "initial": ["."],
    "double_both": ["-"], "double_first_long": ["-"], "double_first": ["-"], "double_last": ["-"], "apostrophe_first": ["'"], "apostrophe_last": ["'"],
}
NAME_CULTURE = {"basic": 2.0, "titles": 4.0, "title": 3.0, "degree": 6.0, "suffix": 3.0, "capitals": 3.0, "four": 2.0, "comma": 2.0, "comma_middle": 2.0, "comma_initial": 2.0}
NAME_AGAINST = [
    "company", "organization", "business", "product", "service", "brand", "system", "application", "software", "corporation", "enterprise", "platform", "solution",
    "technology", "framework", "vendor", "supplier", "manufacturer", "publisher", "agency", "firm", "studio", "lab", "laboratory", "institute", "inc", "llc", "ltd", "corp",
    "enterprises", "industries", "manufacturing", "consulting", "group", "associates", "partners", "holdings", "catalog", "collection", "series", "line", "model",
    "version", "city", "county", "state", "country", "mountain", "lake", "river", "creek", "valley", "street", "avenue", "road", "drive", "algorithm", "method",
    "protocol", "function", "pattern", "transform",
]
NAME_TESTS = "john doe|jane doe|foo bar|test user|sample name|example name|lorem ipsum|first last|firstname lastname|your name|user name|full name"
NAME_MACHINES = [
    "user", "admin", "system", "manual", "auto", "automatic", "primary", "secondary", "backup", "test", "production", "staging", "development", "local", "remote",
    "public", "private", "internal", "external", "global", "regional", "cross", "multi", "single", "dual", "max", "min", "bulk", "batch", "pool", "gateway", "service",
    "manager", "handler", "processor", "validator", "monitor", "controller", "executor", "scheduler", "builder", "factory", "registry", "repository", "store", "cache",
    "execution", "deployment", "configuration",
]
ACCENTS, PLAIN = "àáâãäåçèéêëìíîïñòóôõöøùúûüýÿ", "aaaaaaceeeeiiiinoooooouuuuyy"
NAME_LEAST, UNKNOWN_CAP = 50.0, 65.0


def person_name(lines: DataFrame, first_names: DataFrame | list[str] | None = None, last_names: DataFrame | list[str] | None = None) -> DataFrame:
    """Names by shape whose last name is known, or that a title, suffix or degree marks.

    first_names, last_names: tables of one column, of any size (lower case, accents as in the texts or without), or short
    lists; without last names only marked names are found, and only their shapes are tried.  Every shape is tried by itself, so a name is found where a
    longer shape around it comes to nothing; of equal names of a line the most certain is kept, and names whose
    words a longer name of the line has in a row go (``longest_names``).
    """
    mails = F.when(F.col("line").rlike(r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"), 8.0).otherwise(0.0) + F.when(F.col("line").rlike(r"\b\d{3}[-.]?\d{3}[-.]?\d{4}\b"), 5.0).otherwise(0.0)
    shapes = [s for s in NAME_SHAPES if last_names is not None or s[3]]
    useful = lambda name: F.expr(" OR ".join(f"contains(line, {sql_text(x)})" for x in NAME_NEEDS.get(name, [""])))
    tried = [(f"(?<![{_U}{_L}])(?:{shape})(?![{_U}{_L}])", useful(name) & F.col("line").rlike(f"[{_U}][{_U}{_L}]")) for name, shape, _, _ in shapes]
    rows = candidates(lines, tried, marks=mails, size=F.char_length(F.trim("line")))
    t = F.col("text")
    rows = rows.withColumn("shape", F.element_at(F.array(*[F.lit(n) for n, _, _, _ in shapes]), F.col("way") + 1))
    formal, marked = (F.col("shape").isin([n for n, _, a, b in NAME_SHAPES if (a, b)[i]]) for i in (0, 1))
    bare = F.regexp_replace(F.regexp_replace(t, r"^(?:(?:Mr|Ms|Mrs|Dr|Prof|Sir|Dame|Lord|Lady)\.\s+)+", ""), r",?\s+(?:Jr\.?|Sr\.?|III|IV|PhD|MD|Esq\.?|DDS|JD|EdD|PharmD|PsyD|DVM|RN|CPA|PE)$", "")
    near = F.lower(F.concat(F.right("before", F.lit(15)), F.lit("\n"), F.left("after", F.lit(15))))
    rows = rows.withColumns({"words": F.split(F.lower(bare), r"\s+"), "against": F.size(F.regexp_extract_all(near, F.lit(word_pattern(NAME_AGAINST)), F.lit(0)))})
    words, comma = F.col("words"), F.col("shape").startswith("comma")
    first = F.when(comma, F.get(words, F.lit(1))).otherwise(F.get(words, F.lit(0)))
    last = F.when(comma, F.regexp_replace(F.get(words, F.lit(0)), ",$", "")).otherwise(F.element_at(words, -1))
    rows = rows.withColumns({"first": first, "last": last, "middle": F.size(words) > 2})
    machine = F.col("first").isin(NAME_MACHINES) | F.col("last").isin(NAME_MACHINES)
    low, size = F.lower(t), F.char_length(t)
    own = F.lit(0.0) - F.when(low.rlike(NAME_TESTS), 50.0).otherwise(0.0) - F.when(size < 4, 20.0).when(size > 60, 15.0).otherwise(0.0) - F.when(low.rlike(r"abc|xyz|qwerty|asdf"), 10.0).otherwise(0.0) - F.when(low.rlike(r"(\S)\1\1"), 20.0).otherwise(0.0)
    titled = F.col("shape").isin("titles", "title")
    own = own + F.when(titled, 5.0).otherwise(0.0) + F.when(F.col("shape").isin("suffix", "degree"), 3.0).otherwise(0.0) + F.when(F.col("middle"), 2.0).otherwise(0.0)
    culture = F
    for name, amount in NAME_CULTURE.items():
        culture = culture.when(F.col("shape") == name, amount)
    against = F.col("against")
    context = F.col("marks") + F.when(against > 1, -25.0).when(against == 1, -15.0).otherwise(0.0) + F.when(F.col("size") == size, 13.0).otherwise(0.0)
    scored = lambda known: clamp(clamp(known + own + culture.otherwise(1.0), 0, 100) + clamp(context, -50, 25), 0, 100)
    scores = F.struct(
        scored(F.when(machine, 65.0).otherwise(90.0 + F.when(formal, 5.0).otherwise(0.0))).alias("both"), scored(65.0 - F.when(machine, 20.0).otherwise(0.0)).alias("one"), marked.alias("marked")
    )
    # what the score is by what will be known of the name, in a generator's row, so that nothing above computes it once more
    rows = rows.select(*[c for c in rows.columns if c not in ("marks", "size", "shape", "words", "against", "middle")], F.inline_outer(F.array(scores)))
    rows = rows.where(F.greatest("both", "one") >= NAME_LEAST)
    rows = _known(rows, {"first": first_names, "last": last_names})
    score = F.when(F.col("last_known"), F.when(F.col("first_known"), F.col("both")).otherwise(F.col("one"))).when(F.col("marked"), F.least("one", F.lit(UNKNOWN_CAP))).otherwise(0.0)
    rows = longest_names(rows.withColumn("score", score).where(F.col("score") >= NAME_LEAST))
    return _found(rows, "PERSON_NAME", F.lit("PERSON_NAME"), F.col("score"), least=NAME_LEAST)


def _known(rows: DataFrame, names: dict[str, DataFrame | list[str] | None]) -> DataFrame:
    """Rows with whether each part of the name, a half of it, or it without accents is in that part's table of names.

    Of names without a mark those may be dropped of which the last table has no part.
    """
    asked = {}
    for part, table in names.items():
        if table is None:
            rows = rows.withColumn(f"{part}_known", F.lit(False))
            continue
        halves = F.filter(F.split(part, "-"), lambda x: F.char_length(x) > 1)
        forms = F.array_distinct(F.flatten(F.transform(F.concat(F.array(part), halves), lambda x: F.array(x, F.translate(x, ACCENTS, PLAIN)))))
        if isinstance(table, list):
            rows = rows.withColumn(f"{part}_known", F.arrays_overlap(forms, F.array(*map(F.lit, table))))
        else:
            rows, asked[f"{part}_known"] = rows.withColumn(f"{part}_forms", forms), (f"{part}_forms", table)
    if not asked:
        return rows
    found = listed_in(rows, ["line_key", "way", "start"], asked, home=["line_key"], lone=F.col("marked") if "last_known" in asked else None)
    return found.drop(*[forms for forms, _ in asked.values()])


# ---- social profiles ----------------------------------------------------------------------------------------------
#: Patterns by platform come from the caller, as there is no useful default; these are for tests.
SOCIAL_EXAMPLES = {"LINKEDIN": r"(?i)linkedin\.com/in/[A-Za-z0-9_-]{3,100}", "GITHUB": r"(?i)github\.com/[A-Za-z0-9-]{1,39}"}
SOCIAL_RESERVED = ["login", "signup", "about", "help", "settings", "home", "search", "explore", "jobs", "features", "pricing"]


def social_media(lines: DataFrame, platforms: dict[str, str] | None = None) -> DataFrame:
    """Profiles by patterns of platforms; no patterns, no findings; a pattern that doesn't compile is left out."""
    import re

    names, tried = [], []
    for name, pattern in (platforms or {}).items():
        try:
            re.compile(pattern)
        except re.error:
            continue
        names.append(name)
        tried.append((pattern, None))
    if not names:
        return _found(candidates(lines, "(?!)"), "social_media", F.lit("SOCIAL_MEDIA"), F.lit(0.0))
    rows = candidates(lines, tried, profile=F.col("lower").contains("profile"), test=has_word(TESTS)).where(~F.lower(F.substring_index("text", "/", -1)).isin(SOCIAL_RESERVED))
    score = F.lit(80.0) + F.when(F.col("profile"), 7.0).otherwise(0.0) - F.when(F.col("test"), 15.0).otherwise(0.0)
    return _found(rows, "social_media", F.element_at(F.array(*map(F.lit, names)), F.col("way") + 1), clamp(score, 0, 100))


LABELLED = {
    "PHONE": phone,
    "DATE_OF_BIRTH": date_of_birth,
    "DRIVERS_LICENSE": drivers_license,
    "OTP": otp,
    "PASSPORT": passport,
    "PHYSICAL_ADDRESS": physical_address,
    "INTELLECTUAL_PROPERTY": intellectual_property,
    "PERSON_NAME": person_name,
    "SOCIAL_MEDIA": partial(social_media, platforms=None),
}
