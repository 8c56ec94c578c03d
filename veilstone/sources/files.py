"""Files as documents: discovery, gates, decoding, and text out of containers.

Files are rows of ``binaryFile``; gates and plain text stay column expressions, and only containers
(zip-based office files, WAV tags) go through Arrow batches.  Every file gets a row in coverage.
"""

from __future__ import annotations

import io
import re
import struct
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Extensions by kind of file, and bounds in bytes.
KINDS = {
    "image": ["jpg", "jpeg", "tiff", "tif", "png", "gif", "bmp", "webp"], "pdf": ["pdf"], "office": ["docx", "xlsx", "pptx", "odt", "ods", "odp"], "legacy": ["doc", "xls", "ppt"],
    "audio": ["mp3", "flac", "wav", "m4a"], "video": ["mp4", "m4v", "mov"],
}
TEXT_ENDS = ["txt", "log", "md", "yaml", "yml", "json", "csv", "tsv", "xml", "html", "htm", "ini", "cfg", "conf", "env", "py", "js", "ts", "java", "go", "rs", "c", "h", "cpp", "cs", "rb", "php", "sh", "sql", "toml", "properties"]
MOST_BYTES, MOST_ENTRY, MOST_TEXT = 100 << 20, 50 << 20, 200 << 20
WAV_TAGS = {"INAM": "Title", "IART": "Artist", "ICMT": "Comment", "ICOP": "Copyright", "ISFT": "Software", "ICRD": "Date", "IGNR": "Genre", "IENG": "Engineer"}


def discover(spark: SparkSession, path: str, recursive: bool = True, glob: str | None = None, exclude: list[str] | None = None) -> DataFrame:
    """(path, name, end, length, modificationTime, content) of files below a path, without the excluded ones."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    rows = reader.load(path).withColumn("name", F.substring_index("path", "/", -1))
    rows = rows.withColumn("end", F.when(F.col("name").contains("."), F.lower(F.substring_index("name", ".", -1))).otherwise(""))
    for e in exclude or []:
        pattern = "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in e.rstrip("/"))
        rows = rows.where(~F.col("name").rlike(f"^{pattern}$") & ~F.col("path").contains(f"/{e.rstrip('/')}/"))
    return rows


def kind() -> Column:
    out = F
    for name, ends in KINDS.items():
        out = out.when(F.col("end").isin(ends), name)
    return out.when(F.col("end").isin(TEXT_ENDS) | ~F.hex(F.substring("content", 1, 512)).rlike("^(?:..)*?00"), "text").otherwise("unknown")


def encoding(content: Column) -> Column:
    """utf-8, utf-16le or utf-16be by the byte order mark, else by where the first 512 bytes have zeros."""
    head = F.hex(F.substring(content, 1, 512))
    even, odd = F.regexp_count(head, F.lit(r"\G(?:(?!00..)....)*?00..")), F.regexp_count(head, F.lit(r"\G(?:(?!..00)....)*?..00"))
    pairs = F.greatest(F.length(head) / 4, F.lit(1.0))
    mark = F.when(head.startswith("FFFE"), "UTF-16LE").when(head.startswith("FEFF"), "UTF-16BE").when(head.startswith("EFBBBF"), "UTF-8")
    return mark.when((odd / pairs > 0.3) & (even / pairs < 0.02), "UTF-16LE").when((even / pairs > 0.3) & (odd / pairs < 0.02), "UTF-16BE").otherwise("UTF-8")


def decoded(content: Column) -> Column:
    """Text of a plain file, without its byte order mark; bytes that aren't UTF-8 become U+FFFD."""
    e = encoding(content)
    text = F.when(e == "UTF-16LE", F.expr("decode(content, 'UTF-16LE')")).when(e == "UTF-16BE", F.expr("decode(content, 'UTF-16BE')")).otherwise(F.make_valid_utf8(content.cast("string")))
    return F.regexp_replace(text, "^﻿", "")


def office_text(data: bytes) -> tuple[str, str]:
    """(body, metadata) of a zip-based office file: text of its XML parts in order, and its properties."""
    body, meta, left = [], [], MOST_TEXT
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        number = lambda n: [int(x) if x.isdigit() else x for x in re.split(r"(\d+)", n)]
        for name in sorted(z.namelist(), key=number):
            properties = re.search(r"^(?:docProps/(?:core|app|custom)|meta)\.xml$", name)
            part = re.search(r"^(?:word/(?:document|header\d*|footer\d*|footnotes|comments)|xl/(?:sharedStrings|worksheets/sheet\d+)|ppt/slides/slide\d+|content)\.xml$", name)
            size = z.getinfo(name).file_size
            if not (properties or part) or size > MOST_ENTRY or size > left:
                continue
            left -= size
            root = ElementTree.fromstring(z.read(name))
            if properties:
                meta += [f"{e.tag.rpartition('}')[2]}: {e.text.strip()}" for e in root.iter() if e.text and e.text.strip()]
                continue
            for e in root.iter():
                tag = e.tag.rpartition("}")[2]
                if tag in ("p", "si", "h", "row", "table-row") and body and body[-1] != "\n":
                    body.append("\n")
                if e.text and tag in ("t", "v", "p", "h", "span", "is"):
                    body.append(e.text)
                if tag in ("tab", "c", "table-cell"):
                    body.append("\t")
    return "".join(body).strip("\n"), "\n".join(meta)


def wav_tags(data: bytes) -> str:
    """``Field: value`` lines of the INFO tags of a WAV file."""
    out, at = [], 12
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack("<I", data[at + 4 : at + 8])[0]
        if name == b"LIST" and data[at + 8 : at + 12] == b"INFO":
            inner, end = at + 12, min(at + 8 + size, len(data))
            while inner + 8 <= end:
                tag, n = data[inner : inner + 4].decode("latin-1"), struct.unpack("<I", data[inner + 4 : inner + 8])[0]
                value = data[inner + 8 : inner + 8 + n].split(b"\0")[0].decode("utf-8", "replace").strip()
                if value:
                    out.append(f"{WAV_TAGS.get(tag, tag)}: {value}")
                inner += 8 + n + n % 2
        at += 8 + size + size % 2
    return "\n".join(out)


def extracted(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(units, coverage): units (path, name, part body or metadata, text); coverage (path, reason) of what isn't read whole."""
    rows = files.withColumn("kind", kind())
    small = F.col("length") <= MOST_BYTES
    plain = rows.where(small & (F.col("kind") == "text")).select("path", "name", F.lit("body").alias("part"), decoded(F.col("content")).alias("text"))

    def containers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, name, end, content in zip(*(b.column(c).to_pylist() for c in ("path", "name", "end", "content")), strict=True):
                got, error = [], None
                try:
                    if end == "wav":
                        got = [("metadata", wav_tags(content))]
                    else:
                        got = list(zip(("body", "metadata"), office_text(content), strict=True))
                except Exception as e:  # a broken file is reported, not fatal
                    error = f"unreadable: {type(e).__name__}"
                found = [(path, name, p, t, None) for p, t in got if t] or [(path, name, None, None, error or "no text")]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()) for c in zip(*found, strict=True)], ["path", "name", "part", "text", "reason"])

    inside = rows.where(small & ((F.col("kind") == "office") | (F.col("end") == "wav"))).select("path", "name", "end", "content")
    opened = inside.mapInArrow(containers, "path STRING, name STRING, part STRING, text STRING, reason STRING")
    reason = F.when(~small, "larger than the bound").when(~((F.col("kind") == "text") | (F.col("kind") == "office") | (F.col("end") == "wav")), F.concat(F.lit("not supported: "), F.col("kind")))
    coverage = rows.select("path", reason.alias("reason")).where(F.col("reason").isNotNull()).unionByName(opened.where(F.col("reason").isNotNull()).select("path", "reason"))
    return plain.unionByName(opened.where(F.col("text").isNotNull()).drop("reason")), coverage
