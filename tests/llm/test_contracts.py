"""Values of the registered queries on a small fixture, and awkward rows and columns in every operator and stage."""

import hashlib
import re

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

import corpus_pipeline
from veilstone.llm import bpe, exact_dedup, hnsw, line_dedup, mixing, quality, queries, simhash, token_counts, toxicity, warc

TEXTS = ["the of and to in that is", "One two  three\nfour", None, "", " \t ", "x" * 20_000, "Café naïve 12 <|endoftext|> don't", "the of and to in that is", "idiot moron the of", "a b c d e f g"]


@pytest.fixture(scope="module")
def small_dir(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("sf")
    rows = [(i, t, "xx", "ab"[i % 2], len(t or "")) for i, t in enumerate(TEXTS * 3)]
    spark.createDataFrame(rows, "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG").coalesce(1).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 3 > 0), int("idiot" in (TEXTS[i % 10] or ""))) for i in range(30)], "doc_id LONG, quality INT, toxic INT").coalesce(1).write.parquet(f"{path}/labels.parquet")
    return str(path), rows


def test_token_queries(spark, small_dir):
    from tokenizers import Tokenizer

    path, rows = small_dir
    word, byte = (Tokenizer.from_file(public_tokenizers.path(n)) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in queries.op3_token_counts(spark, path).collect()}
    count = {i: len(word.encode(t or "", add_special_tokens=False)) for i, t, *_ in rows}
    assert got == {i: (len((t or "").encode()), count[i], count[i] > 2048) for i, t, *_ in rows}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op4_bpe(spark, path).collect()}
    ids = {i: byte.encode(t or "", add_special_tokens=False).ids for i, t, *_ in rows}
    assert got == {i: (len(x), sha(",".join(map(str, x))), sha(byte.decode(x, skip_special_tokens=False))) for i, x in ids.items()}


def test_other_tokenizers_count_whole_texts(spark, small_dir):
    import sentencepiece
    from tokenizers import Tokenizer

    _, rows = small_dir
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id LONG, text STRING")
    byte, piece = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for name, n in (("byte_bpe_50k.json", lambda t: len(byte.encode(t, add_special_tokens=False))), ("piece_bpe_32k.model", lambda t: len(piece.encode(t)))):
        got = {r.doc_id: r.n_tokens for r in token_counts.TokenCache(spark, public_tokenizers.path(name)).count(docs).collect()}
        assert got == {i: n(t or "") for i, t, *_ in rows}


def test_simhash_query(spark, small_dir):
    path, rows = small_dir
    got = {r.doc_id: r.fingerprint for r in queries.op6_simhash(spark, path).collect()}
    assert got == {i: f"{simhash.fingerprint(t):016x}" for i, t, *_ in rows}


def test_toxicity_query_scores_by_the_fitted_model(spark, small_dir):
    path, rows = small_dir
    docs, labels = (spark.read.parquet(f"{path}/{t}.parquet") for t in ("documents", "labels"))
    scorer = toxicity.Scorer(toxicity.fit(*toxicity.sample(docs, labels)))
    for r in queries.op5_toxicity(spark, path).collect():
        assert r.score == pytest.approx(scorer.score(rows[r.doc_id][1]), abs=1e-12) and r.predicted == int(r.score >= 0.3)


def test_contradictory_labels_train_nothing(spark):
    docs = spark.createDataFrame([(i, f"word{i} bad") for i in range(40)], "doc_id LONG, text STRING")
    labels = spark.createDataFrame([(i, t) for i in range(40) for t in ([0, 1] if i % 2 else [i % 4 // 2])], "doc_id LONG, toxic INT")
    texts, _ = toxicity.sample(docs, labels)
    assert texts and all(int(re.search(r"\d+", t).group()) % 2 == 0 for t in texts)
    assert len(toxicity.sample(docs.union(docs).union(docs), labels, texts=5)[0]) <= 10


def test_quality_query_against_gumbel_top_k(spark, small_dir):
    path, rows = small_dir
    grams = quality.Grams()
    bags = {i: [x for part in grams.of(t) for x in part.tolist()] for i, t, *_ in rows}
    count = lambda ids: np.bincount([x for i in ids for x in bags[i]], minlength=quality.BUCKETS).astype(float)
    good = [i for i in range(30) if i % 3]
    ratio = quality.log_ratio(count([i for i in good if len(rows[i][1] or "") <= quality.LENGTH and rows[i][1] is not None]), count(range(30)))
    weight = {i: sum(ratio[x] for x in b) for i, b in bags.items()}
    got = queries.op10_quality(spark, path).collect()
    assert all(r.log_weight == pytest.approx(weight[r.doc_id], abs=1e-6) for r in got)
    chances = sum(min(1.0, len(good) / 30 * np.exp(min(weight[i], 50.0))) for i in range(30))
    kept = [r for r in got if r.kept]
    assert chances - 1e-6 <= len(kept) < chances + 1 + 1e-6
    assert {r.doc_id for r in kept} == {r.doc_id for r in sorted(got, key=lambda r: -r.key)[: len(kept)]}


SCHEMA = StructType([
    StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType()), StructField("source", StringType()), StructField("size", StringType()),
    StructField("copies", StringType()), StructField("key", StringType()), StructField("row_no", StringType()), StructField("we`ird", StringType()), StructField("meta", StructType([StructField("a-b", IntegerType())])),
])
ROWS = [(i, t, "xx", s, "S", "C", "K", "R", "W", (i,)) for i, (t, s) in enumerate(zip(TEXTS, ["a", None, "b"] * 4))] + [(None, "null id", None, None, "S", "C", "K", "R", "W", None)] + [(3, "", "xx", "a", "S", "C", "K", "R", "W", (3,))] * 2


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_take_awkward_columns_and_no_rows(spark, small_dir, stage):
    run = dict(corpus_pipeline.STAGES)[stage]
    docs = spark.createDataFrame(ROWS, SCHEMA)
    out = run(spark, docs, small_dir[0])
    rows = out.collect()
    if stage != "bpe encoding":
        assert out.schema.fieldNames() == docs.schema.fieldNames() and {tuple(r) for r in rows} <= {tuple(r) for r in docs.collect()} and rows
    else:
        assert len(rows) == len(ROWS) and all(r.round_trip for r in rows)
    assert run(spark, docs.limit(0), small_dir[0]).count() == 0


def test_operators_take_awkward_columns(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    assert bpe.encode_texts(docs, public_tokenizers.path("byte_bpe_50k.json")).select("doc_id", "ids", "`we``ird`", "meta").count() == len(ROWS)
    assert simhash.simhash_groups(docs).count() == len(ROWS) and toxicity.score(docs, toxicity.fit([], []), keep=["meta", "we`ird"]).count() == len(ROWS)
    runs = line_dedup.LineRuns(spark)
    runs.add(docs, batch="a")
    runs.add(docs, batch="a")
    assert len(runs.runs()[0]) == 1 and line_dedup.drop_lines(docs, runs).count() == len(ROWS)
    with pytest.raises(ValueError):
        line_dedup.LineRuns(spark, runs.path, min_docs=runs.min_docs + 1)
    mixed = mixing.mix(docs).collect()
    assert len(mixed) == len(ROWS) and all(r.copies in (0, 1, 2) for r in mixed)


def test_a_stopped_merge_doubles_nothing(spark, tmp_path):
    docs = [spark.createDataFrame([(10 * b + i, "common line") for i in range(3)], "doc_id LONG, text STRING") for b in range(4)]
    runs = line_dedup.LineRuns(spark, f"file://{tmp_path}/runs", min_docs=12)
    for b in range(3):
        runs.add(docs[b], batch=str(b))
    runs.add(docs[3], batch="3")
    assert list(runs.runs()) == [1]
    again = line_dedup.LineRuns(spark, runs.path, min_docs=12)
    again.add(docs[3], batch="3")
    assert sum(r.n_docs for r in again._read([p for v in again.runs().values() for p in v]).collect()) == 12 and again.frequent().count() == 1
    # inputs that weren't deleted in time don't count beside the merged run
    again._read(again.runs()[1]).write.parquet(f"{again.path}/L0-1")
    assert again.frequent().count() == 1 and 0 not in again.runs()


def test_a_batch_again_keeps_its_rows(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "doc_id LONG, text STRING")
    index = exact_dedup.DigestIndex(spark, f"file://{tmp_path}/it's", buckets=2)
    want = sorted((r.doc_id, r.keep_id, r.kept) for r in index.add(docs, batch_id="one").collect())
    again = sorted((r.doc_id, r.keep_id, r.kept) for r in index.add(docs, batch_id="one").collect())
    assert want == again == [(1, 2, False), (2, 2, True), (3, 3, True)] and index.rows().count() == 2
    assert not any(r.kept for r in index.add(docs, batch_id="two").collect())


def test_archives_on_disk(spark, tmp_path):
    import zstandard

    pages = spark.createDataFrame([(i, f"http://h/{i}", f"<p>some page {i % 7}</p>" * 20) for i in range(40)] + [(3, "http://h/3", "<p>some page 3</p>" * 20)], "page_id LONG, url STRING, html STRING")
    folder = f"file://{tmp_path}/archives"
    archives = warc.write_archives(pages.repartition(3), folder).collect()
    assert sorted(p.name for p in (tmp_path / "archives").iterdir()) == sorted(a.path.rsplit("/", 1)[1] for a in archives)
    seen = set()
    for a in archives:
        raw = open(a.path.removeprefix("file://"), "rb").read()
        assert len(raw) == a.bytes and raw[:4] == b"\x5d\x2a\x4d\x18"
        size = int.from_bytes(raw[4:8], "little")
        dictionary = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(raw[8 : 8 + size]))
        at, frames = 8 + size, 0
        while at < len(raw):
            d = zstandard.ZstdDecompressor(dict_data=dictionary).decompressobj()
            text = d.decompress(raw[at:])
            assert text.startswith(b"WARC/1.1") and text.endswith(b"\r\n\r\n")
            seen.add(re.search(rb"WARC-Record-ID: (\S+)", text).group(1))
            at, frames = len(raw) - len(d.unused_data), frames + 1
        assert frames == a.records
    assert len(seen) == 41
    lone = warc.write_archives(spark.createDataFrame([(1, "u", "")], "page_id LONG, url STRING, html STRING"), date="2020-01-01T00:00:00Z")
    assert open(lone.first().path.removeprefix("file://"), "rb").read()[:4] == b"\x5d\x2a\x4d\x18"


def test_nearest_with_repeated_ids_and_several_shards(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    rows = [(r.vec_id, np.array(r.embedding, dtype=np.float64)) for r in table.collect()]
    ids, x = np.array([i for i, _ in rows]), np.stack([v for _, v in rows])
    unit = x / np.sqrt((x * x).sum(axis=1))[:, None]
    hit = total = 0
    found = {}
    for r in hnsw.nearest(table, rows_of_shard=max(20, len(rows) // 4)).collect():
        found.setdefault(r.query_id, []).append(r.vec_id)
    for q in [i for i in ids.tolist() if i % 50 == 0]:
        s = unit @ unit[ids.tolist().index(q)]
        best = [i for _, i in sorted((-v, i) for v, i in zip(s.tolist(), ids.tolist()) if i != q)[:5]]
        hit, total = hit + len(set(best) & set(found[q])), total + 5
    assert hit >= 0.9 * total
    twice = spark.createDataFrame([(50, [1.0, 0.0]), (50, [0.0, 1.0]), (7, [1.0, 0.1]), (8, [0.1, 1.0])], "vec_id LONG, embedding ARRAY<DOUBLE>")
    assert sorted((r.rank, r.vec_id) for r in hnsw.nearest(twice).collect()) == [(1, 7), (1, 8), (2, 7), (2, 8)]


def test_arrow_setting_is_restored(spark):
    from veilstone.llm.store import BATCH

    before = spark.conf.get(BATCH)
    spark.conf.set(BATCH, 5000)
    try:
        pages = spark.createDataFrame([(1, "u", "x")], "page_id LONG, url STRING, html STRING")
        warc.read_archives(warc.write_archives(pages)).count()
        hnsw.nearest(spark.createDataFrame([(50, [1.0]), (1, [2.0])], "vec_id LONG, embedding ARRAY<DOUBLE>")).count()
        assert int(spark.conf.get(BATCH)) == 5000
    finally:
        spark.conf.set(BATCH, before)
