"""Files and streams."""

import io
import struct
import zipfile

from veilstone.plans.scan import scan
from veilstone.sources.files import discover, extracted, office_text, wav_tags
from veilstone.streaming.scan_stream import counts, findings_stream, redacting_writer


def wav(**tags):
    info = b"INFO" + b"".join(k.encode() + struct.pack("<I", len(v) + 1) + v.encode() + b"\0" + b"\0" * ((len(v) + 1) % 2) for k, v in tags.items())
    body = b"WAVE" + b"LIST" + struct.pack("<I", len(info)) + info
    return b"RIFF" + struct.pack("<I", len(body)) + body


def docx(text, author="Ann Lee"):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="w"><w:body><w:p><w:r><w:t>{text}</w:t></w:r></w:p><w:p><w:r><w:t>end</w:t></w:r></w:p></w:body></w:document>')
        z.writestr("docProps/core.xml", f'<cp:core xmlns:cp="cp" xmlns:dc="dc"><dc:creator>{author}</dc:creator></cp:core>')
    return out.getvalue()


def test_containers():
    assert office_text(docx("mail x@acmecorp.com")) == ("mail x@acmecorp.com\nend", "creator: Ann Lee")
    assert wav_tags(wav(INAM="Tune", IART="Ann")) == "Title: Tune\nArtist: Ann"


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("contact ann@acmecorp.com")
    (tmp_path / "b.csv").write_bytes("name,mail,x\nAnn,bob@acmecorp.com,1".encode("utf-16"))
    (tmp_path / "c.docx").write_bytes(docx("contact eve@acmecorp.com"))
    (tmp_path / "d.wav").write_bytes(wav(ICMT="contact joe@acmecorp.com"))
    (tmp_path / "e.pdf").write_bytes(b"%PDF")
    (tmp_path / "f.docx").write_bytes(b"broken")
    (tmp_path / "skip.txt").write_text("contact no@acmecorp.com")
    units, coverage = extracted(discover(spark, str(tmp_path), exclude=["skip*"]))
    found = scan(units.selectExpr("concat(path, '#', part) AS doc_id", "name", "text"), ["EMAIL"], name_col="name")
    assert sorted(r.text.split("@")[0] for r in found.collect()) == ["ann", "bob", "eve", "joe"]
    assert sorted((r.path.rsplit("/", 1)[1], r.reason) for r in coverage.collect()) == [("e.pdf", "not supported: pdf"), ("f.docx", "unreadable: BadZipFile")]


def test_streams(spark, tmp_path):
    source = tmp_path / "in"
    spark.createDataFrame([(1, "contact ann@acmecorp.com"), (2, "none")], "doc_id LONG, text STRING").write.parquet(str(source))
    docs = spark.readStream.schema("doc_id LONG, text STRING").parquet(str(source))
    q = findings_stream(docs, ["EMAIL"]).selectExpr("*", "timestamp'2024-01-01 00:01:00' AS ts").writeStream.format("memory").queryName("found").option("checkpointLocation", str(tmp_path / "c1")).start()
    q.processAllAvailable()
    q.stop()
    assert [r.text for r in spark.table("found").collect()] == ["ann@acmecorp.com"]
    assert [(r.type, r.n) for r in counts(spark.table("found")).collect()] == [("BUSINESS", 1)]
    q = redacting_writer(docs, str(tmp_path / "out"), ["EMAIL"]).option("checkpointLocation", str(tmp_path / "c2")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.redacted for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["contact [EMAIL-REDACTED]", "none"]
