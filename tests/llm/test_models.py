"""Toxicity, quality, mixing, nearest neighbours and archives on small fixtures."""

import base64
import hashlib
import math
import random
from zlib import crc32

import numpy as np
import pytest

from veilstone.llm import hnsw, mixing, quality, toxicity, warc

PLAIN = "the of and to in that is was for on with as by at from this have or had not are but what all were when we there can an your which their said".split()
BAD = ["idiot", "moron", "worthless", "scum"]


def corpus(n=600, seed=2):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(PLAIN) for _ in range(rng.choice([5, 40, 200]))]
        toxic, good = i % 5 == 0, i % 7 != 0
        if toxic:
            for _ in range(2):
                words.insert(rng.randrange(len(words)), rng.choice(BAD))
        if not good:
            words = [w + "###" for w in words]
        rows.append((i, " ".join(words)))
        labels.append((i, int(good), int(toxic)))
    return rows, labels


def test_toxicity_on_held_out_rows(spark):
    rows, labels = corpus()
    extra = [(9001, None), (9002, ""), (9003, "\n\t"), (None, "the of and"), (9004, "the of and to " * 5000 + "moronn " + "in that " * 3000), (9003, "?!")]
    docs = spark.createDataFrame(rows + extra, "doc_id LONG, text STRING")
    lab = spark.createDataFrame([(i, q, t if i % 11 else None) for i, q, t in labels] + [(None, 1, 1)], "doc_id LONG, quality INT, toxic INT")
    got = toxicity.toxicity(spark, docs, lab).collect()
    assert len(got) == len(rows) + len(extra) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert all(r.held_out == (r.doc_id is not None and crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    truth = {i: t for i, _, t in labels}
    tested = [(truth[r.doc_id], r.predicted) for r in got if r.held_out and r.doc_id in truth]
    assert sum(t == p for t, p in tested) >= 0.95 * len(tested)
    assert next(r.score for r in got if r.doc_id == 9002) < 0.3


def test_toxicity_without_labels_or_rows(spark):
    empty = spark.createDataFrame([], "doc_id LONG, toxic INT")
    docs = spark.createDataFrame([(1, "a")], "doc_id LONG, text STRING")
    assert [r.predicted for r in toxicity.toxicity(spark, docs, empty).collect()] == [0]
    assert toxicity.toxicity(spark, docs.limit(0), empty).count() == 0


def test_quality_keeps_good_and_drops_bad(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame([(i, t, "x", 1.0) for i, t in rows] + [(None, "the of and", None, 2.0), (7001, None, "y", 3.0), (7002, "", "y", 3.0)], "doc_id LONG, text STRING, kept STRING, key DOUBLE")
    lab = spark.createDataFrame([(i, q) for i, q, _ in labels if i % 3], "doc_id LONG, quality INT")
    out = quality.keep_good(docs, lab)
    assert out.columns == docs.columns
    ids = {r.doc_id for r in out.collect()}
    good = {i for i, q, _ in labels if q}
    assert len(ids & good) >= 0.97 * len(good) and not ids & ({i for i, q, _ in labels if not q})
    scored = quality.resample(docs, lab)
    assert scored.columns == ["doc_id", "log_weight", "key", "kept"] and scored.count() == docs.count()
    assert {r.doc_id for r in scored.where("kept").collect()} == ids


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id LONG, text STRING")
    lab = spark.createDataFrame([], "doc_id LONG, quality INT")
    assert quality.keep_good(docs, lab).count() == 2
    assert quality.keep_good(docs.limit(0), lab).count() == 0


def brute_targets(sizes):
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    want, free = 1.5 * sum(sizes.values()), set(sizes)
    target = {}
    while free:
        share = {s: want * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * sizes[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = 2.0 * sizes[s]
            want -= target[s]
        free -= over
    return target


def test_mix(spark):
    rng = random.Random(8)
    rows = [(i, rng.choice(["a", "a", "a", "b", "B", "ö", None, "z"]), " ".join("w" * 1 for _ in range(rng.choice([0, 1, 5, 50, 2000])))) for i in range(900)]
    rows += [(None, "a", "one two"), (1, "a", None), (1, "a", None), (2, "void", ""), (3, "void", None)]
    docs = spark.createDataFrame([(*r, 1, "c") for r in rows], "doc_id LONG, source STRING, text STRING, size INT, copies STRING")
    got = mixing.mix(docs).collect()
    sizes = {}
    for _, s, t in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = brute_targets(sizes)
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        assert r.size == len((r.text or "").split()) and r.source_size == sizes[r.source] and 0 <= r.copies <= 2
        assert math.isclose(r.target, want[r.source], rel_tol=1e-12)
        taken[r.source] += r.copies * r.size
    assert len(got) == len(rows) and all(abs(taken[s] - want[s]) <= 2000 for s in sizes)
    again = {(r.doc_id, r.source, r.text, r.copies) for r in mixing.mix(docs.repartition(7)).collect()}
    assert again == {(r.doc_id, r.source, r.text, r.copies) for r in got}
    copies = mixing.repeated(mixing.mix(docs), ["doc_id", "text"])
    assert copies.columns == ["doc_id", "text"] and copies.count() == sum(r.copies for r in got)


def test_mix_no_rows(spark):
    assert mixing.mix(spark.createDataFrame([], "doc_id LONG, source STRING, text STRING")).count() == 0


def test_nearest_recall_and_edges(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 16)).astype(np.float32)
    x[200:500] = x[200]
    x[700] = 0
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(None, x[3].tolist(), 1), (9000, None, 1), (9050, [1.0, None] * 8, 1), (9100, [float("nan")] * 16, 1), (9150, [1.0, 2.0], 1), (9200, [], 1), (9250, [float("inf")] + [0.0] * 15, 1)]
    table = spark.createDataFrame(rows, "vec_id LONG, embedding ARRAY<FLOAT>, label INT")
    got = {}
    for r in hnsw.nearest(table, rows_of_shard=400).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    ok = [i for i in range(1500) if i != 700]
    d = x.astype(np.float64)
    norm = np.sqrt((d * d).sum(axis=1))
    hit = total = 0
    for q in (i for i in range(0, 1500, 50) if i != 700):
        s = {i: float((d[i] * d[q]).sum() / (norm[i] * norm[q])) for i in ok if i != q}
        best = sorted(s, key=lambda i: (-s[i], i))[:5]
        found = sorted(got[q])
        assert [k for k, _, _ in found] == [1, 2, 3, 4, 5]
        assert all(math.isclose(v, s[i], rel_tol=1e-12) for _, i, v in found)
        assert found == sorted(found, key=lambda r: (-r[2], r[1]))
        hit += len(set(best) & {i for _, i, _ in found})
        total += 5
        if 200 <= q < 500:
            assert [i for _, i, _ in found] == best
    assert hit >= 0.9 * total and set(got) == {i for i in range(0, 1500, 50) if i != 700}
    assert hnsw.nearest(table.limit(0)).count() == 0


@pytest.mark.parametrize("least", [0, 5])
def test_archives(spark, least):
    big = "".join(random.Random(3).choice("abcdef <p>") for _ in range(300_000))
    rows = [(i, f"http://h/{i}", f"<p>page {i % 40}</p>" + "é" * (i % 3), "x") for i in range(300)]
    rows += [(1000, None, None, "x"), (1001, "http://h/a b\r\nX: y", "", "y"), (None, "u", "<p>page 1</p>é", "x"), (None, "u", "alone", "x"), (1002, "u", big, "x"), (1003, "u", big, "x"), (1004, "u", "a\r\n\r\nb", "x"), (0, "http://h/0", rows[0][2], "x")]
    pages = spark.createDataFrame(rows, "page_id LONG, url STRING, html STRING, digest STRING")
    archives = warc.write_archives(pages, least=least)
    got = [tuple(r) for r in warc.read_archives(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()]
    want = []
    for i, _, h, _ in rows:
        b = (h or "").encode()
        same = [r[0] for r in rows if (r[2] or "") == (h or "") and r[0] is not None]
        first = min(same, default=None) if len(b) >= least else i
        want.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if i == first else "revisit", None if i == first else first))
    key = lambda r: tuple((v is None, v) for v in r)
    assert sorted(got, key=key) == sorted(want, key=key)
    assert archives.agg({"records": "sum"}).first()[0] == len(rows)


def test_archive_has_its_dictionary(tmp_path):
    path = tmp_path / "a.warc.zst"
    with open(path, "wb") as f:
        w = warc.ArchiveWriter(f)
        for i in range(3000):
            w.add(warc.record(str(i), f"http://h/{i}", f"<html><body>common words {i}</body></html>".encode() * 3, "D", None))
        w.close()
    assert path.read_bytes()[:4] == b"\x5d\x2a\x4d\x18" and w.stored < w.raw / 4
    with open(path, "rb") as f:
        assert [h["x-page-id"] for h, _ in warc.read_archive(f)] == [str(i) for i in range(3000)]


def test_archives_of_no_pages(spark):
    pages = spark.createDataFrame([], "page_id LONG, url STRING, html STRING")
    assert warc.read_archives(warc.write_archives(pages)).count() == 0
