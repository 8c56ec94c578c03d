"""Metadata of files: ``Field: value`` lines -> findings by a table of fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilstone.functions.lines import lines
from veilstone.functions.text import any_of, candidates, clamp
from veilstone.operators.detectors import _found

#: Types of fields by name (lower case, without spaces, dots and dashes).
FIELDS = {
    "creator": "AUTHOR_INFO", "author": "AUTHOR_INFO", "owner": "AUTHOR_INFO", "artist": "AUTHOR_INFO", "iptcbyline": "AUTHOR_INFO", "lastmodifiedby": "LAST_MODIFIED_BY", "manager": "MANAGER_INFO",
    "company": "COMPANY_INFO", "comments": "DOCUMENT_COMMENTS", "comment": "DOCUMENT_COMMENTS", "description": "DOCUMENT_DESCRIPTION", "subject": "DOCUMENT_DESCRIPTION", "keywords": "DOCUMENT_KEYWORDS",
    "copyright": "IMAGE_COPYRIGHT", "rights": "IMAGE_COPYRIGHT", "copyrightnotice": "IMAGE_COPYRIGHT", "software": "APPLICATION_INFO", "application": "APPLICATION_INFO", "producer": "APPLICATION_INFO",
    "template": "TEMPLATE_INFO", "gpslatitude": "GPS", "gpslongitude": "GPS", "gpsaltitude": "GPS", "xyz": "GPS", "coordinates": "GPS", "gpsposition": "GPS", "cameramake": "DEVICE_INFO",
    "cameramodel": "DEVICE_INFO", "cameraserialnumber": "DEVICE_INFO", "devicemake": "DEVICE_INFO", "devicemodel": "DEVICE_INFO", "deviceserial": "DEVICE_INFO", "recordingdevice": "DEVICE_INFO",
    "performer": "AUDIO_ARTIST_IDENTITY", "composer": "AUDIO_ARTIST_IDENTITY", "conductor": "AUDIO_ARTIST_IDENTITY", "albumartist": "AUDIO_ARTIST_IDENTITY", "engineer": "AUDIO_ARTIST_IDENTITY",
    "director": "VIDEO_CREATOR_INFO", "cinematographer": "VIDEO_CREATOR_INFO", "recordedby": "VIDEO_CREATOR_INFO", "contact": "AUDIO_CONTACT_INFO", "management": "AUDIO_CONTACT_INFO", "booking": "AUDIO_CONTACT_INFO",
    "venue": "AUDIO_LOCATION_INFO", "studio": "AUDIO_LOCATION_INFO", "recordedat": "AUDIO_LOCATION_INFO", "recordinglocation": "AUDIO_LOCATION_INFO", "location": "AUDIO_LOCATION_INFO", "publisher": "AUDIO_BUSINESS_INFO",
    "label": "AUDIO_BUSINESS_INFO", "recordlabel": "AUDIO_BUSINESS_INFO",
}
#: What the base of 0.4 gets for a line that matches a pattern: for fields, kinds of values, and signs of test data.
BONUS = [
    (r"@(?:.*)(?:gmail|yahoo|hotmail|outlook)\.com", 0.3), (r"^(?!.*(?:gmail|yahoo|hotmail|outlook)\.com).*@", 0.2), ("email:", 0.1), (r"author:|creator:", 0.2), ("owner:", 0.15), ("artist:", 0.1),
    (r"lastmodifiedby:|last modified by:", 0.2), (r"company:|producer:|keywords:|identifier:", 0.15), ("manager:", 0.25), ("comments?:", 0.3), ("description:", 0.2), (r"copyright:|rights:|copyrightnotice:", 0.3),
    (r"\b\d{3}[-.\s]?\d{3}[-.\s]?\d{4}\b", 0.4), ("gps", 0.25), (r"latitude|longitude", 0.3), (r"gpslatitude|gpslongitude", 0.4), ("gpsaltitude", 0.5), (r"location|position", 0.2),
    (r"camera_?ma?ke:|camera_?model:|device_?make:|device_?model:", 0.3), (r"recording_?device:|recorder:", 0.25), (r"recorded_?by:|encoded_?by:|created_?by:", 0.3), (r"xyz:.*[+-]", 0.4),
    (r"artist:|performer:|albumartist:|composer:", 0.3), (r"recording_?location:|studio:|venue:|recorded_?at:", 0.25), (r"publisher:|label:|management:", 0.2), (r"subject:|keywords:|description:", 0.1), ("title:", 0.05),
    ("serial", 0.2), (r"/users/|/home/|\\users\\", 0.15), (r"test|example|sample|demo", -0.2),
]
PRIVATE = ["personal", "private", "confidential", "sensitive", "restricted", "identity", "contact", "address", "phone", "individual", "profile"]
NOT_PRIVATE = ["test", "example", "sample", "demo", "placeholder", "dummy", "template", "default", "anonymous", "unknown"]


def metadata(units: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """FINDINGS of the values of known fields, and of templates on other machines.

    A latitude shows its unit's longitude beside it; the longitude is a finding too, so that redaction
    reaches it.  Null and empty units have none.
    """
    table = F.create_map(*[F.lit(x) for pair in FIELDS.items() for x in pair])
    field = F.lower(F.regexp_replace(F.substring_index("line", ":", 1), r"[ _.-]", ""))
    low = F.col("lower")
    value = F.regexp_extract(low, r"^[^:]*:\s*(.*)$", 1)
    score = F.lit(0.4) + sum((F.when(low.rlike(p), F.lit(x)).otherwise(F.lit(0.0)) for p, x in BONUS), F.lit(0.0))
    score = clamp(score, 0, 1) + F.when(any_of(low, PRIVATE, "contains"), 0.1).otherwise(0.0) - F.when(any_of(value, NOT_PRIVATE, "contains"), 0.15).otherwise(0.0) + F.when(low.rlike(r"@.*\.(?:com|org|net|edu)"), 0.15).otherwise(0.0)
    rows = candidates(lines(units, id_col, text_col), r"(?<=^[A-Za-z][A-Za-z0-9_ .-]{0,60}:[ \t]{0,8})\S.*?(?=\s*$)", None, key=field, score=score)
    rows = rows.withColumn("type", F.try_element_at(table, F.col("key"))).where("type IS NOT NULL")
    path = (F.col("key") == "template") & F.col("text").rlike(r"^(?:\\\\|/|[A-Za-z]:\\|https?://)")
    rows = rows.where((F.col("key") != "template") | path).withColumn("score", F.col("score") + F.when(path, 0.45).otherwise(0.0))
    unit = Window.partitionBy("doc_id", "doc_key")
    longitude = F.max(F.when(F.col("key") == "gpslongitude", F.col("text"))).over(unit)
    rows = rows.withColumns({"length": F.char_length("text"), "text": F.when((F.col("key") == "gpslatitude") & longitude.isNotNull(), F.concat("text", F.lit(", "), longitude)).otherwise(F.col("text"))})
    return _found(rows, "metadata", F.col("type"), F.round(clamp(F.col("score"), 0, 1) * 100, 6))
