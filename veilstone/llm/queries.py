"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilstone.llm import bpe, exact_dedup, filter_audit, hnsw, line_dedup, mixing, prefix_trie, quality, sharding, simhash, token_counts, toxicity, warc


#: Batches that the line runs take the documents in: the last ones meet a merged run and a new one.
BATCHES = 5


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    runs = line_dedup.LineRuns(spark, min_docs=10)
    for i in range(BATCHES):
        runs.add(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(BATCHES)) == i), batch=f"part-{i}")
    return line_dedup.drop_lines(docs, runs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.planned(docs).select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    counts = token_counts.TokenCache(spark, public_tokenizers.path("word_bpe_49k.json")).count(docs)
    return counts.withColumn("over_limit", F.col("n_tokens") > 2048)


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    done = bpe.encode_texts(docs, public_tokenizers.path("byte_bpe_50k.json"), decoded=True)
    ids = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(spark, _read(spark, sf_dir, "documents").select("doc_id", "text"), _read(spark, sf_dir, "labels").select("doc_id", "toxic"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    found = simhash.simhash_groups(docs)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.nearest(_read(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    index = exact_dedup.DigestIndex(spark)
    found = index.add(docs)
    index.drop()
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.write_archives(_read(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return warc.read_archives(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _read(spark, sf_dir, "documents").select("doc_id", "text"), _read(spark, sf_dir, "labels").select("doc_id", "quality")
    return quality.resample(docs, labels).select("doc_id", "log_weight", "key", "kept")


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(_read(spark, sf_dir, "documents").select("doc_id", "text"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang"), _read(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    return filter_audit.filter_audit(docs, labels)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = prefix_trie.prefix_trie(_read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    return found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_mixing": op2_mixing,
    "op3_token_counts": op3_token_counts,
    "op4_bpe": op4_bpe,
    "op5_toxicity": op5_toxicity,
    "op6_simhash": op6_simhash,
    "op7_nearest": op7_nearest,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_warc": op9_warc,
    "op10_quality": op10_quality,
    "op11_sharding": op11_sharding,
    "op12_filter_audit": op12_filter_audit,
    "op13_prefix_trie": op13_prefix_trie,
}

#: A line's key in DuckDB; A-Z alone are lower-cased.
_KEY = r"translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL: dict[str, str] = {
    "op1_line_dedup": f"""
        WITH docs AS (SELECT doc_id, row_number() OVER () AS r, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
        each AS (SELECT r, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM docs),
        keyed AS (SELECT r, pos, line, {_KEY} AS key FROM each),
        often AS (SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT r) >= 10),
        marked AS (SELECT r, pos, line, key IN (SELECT key FROM often) AS gone FROM keyed)
        SELECT any_value(d.doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
        FROM marked m JOIN docs d USING (r) GROUP BY r""",
    "op2_mixing": r"""
        WITH docs AS (SELECT doc_id, source, text, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
        s AS (SELECT source, sum(size)::BIGINT AS source_size FROM docs GROUP BY source),
        w AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w, 2.0::DOUBLE * source_size AS cap FROM s),
        l AS (SELECT *, (1.5::DOUBLE * (SELECT sum(source_size) FROM s)::DOUBLE
                         - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                        / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
        f AS (SELECT level FROM l WHERE level * w <= cap ORDER BY cap / w, source NULLS LAST LIMIT 1),
        c AS (SELECT source, source_size, least(cap, coalesce(w * (SELECT level FROM f), cap)) AS target FROM l),
        t AS (SELECT source, source_size, target, ('0x' || substr(md5('mix:' || coalesce(source, '')), 1, 5))::BIGINT::DOUBLE / 1048576 AS u,
                     CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM c),
        r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY size, doc_id) AS i FROM docs)
        SELECT doc_id, size, source_size, target, size * (floor(i * rate + u) - floor((i - 1) * rate + u))::BIGINT AS taken
        FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source""",
    "op8_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""",
    "op9_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS hex FROM pages),
        d AS (SELECT *, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                     (((('0x' || substr(hex, ((i // 4) * 5 + 1)::INT, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31) + 1)::INT, 1)), '') AS payload_digest,
                     min(page_id) OVER (PARTITION BY body) AS first FROM p)
        SELECT page_id, strlen(body)::BIGINT AS payload_bytes, payload_digest,
               CASE WHEN page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to FROM d""",
    "op12_filter_audit": r"""
        WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
        w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY t) AS least FROM d),
        m AS (SELECT part, (len(words) < 200)::INT + 2 * (100 * len(list_distinct(words)) < 50 * len(words))::INT + 4 * (100 * len(regexp_extract_all(t, '[A-Z]')) > 3 * length(t))::INT
                     + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(doc_id > least, false)::INT AS mask,
                     coalesce(doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL), false) AS good,
                     coalesce(doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL), false) AS toxic FROM w),
        c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM m GROUP BY part, mask),
        f(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
        o AS (SELECT f1.letter || f2.letter || f3.letter || f4.letter || f5.letter AS filter_order, [f1.bit, f2.bit, f3.bit, f4.bit, f5.bit] AS bits
              FROM f f1, f f2, f f3, f f4, f f5 WHERE len(list_distinct([f1.bit, f2.bit, f3.bit, f4.bit, f5.bit])) = 5),
        s AS (SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS earlier FROM o, (SELECT unnest(range(1, 6))::INT AS step)),
        a AS (SELECT part, filter_order, step, bit, sum(n) FILTER (WHERE mask & (earlier | bit) = 0) AS kept, sum(n) FILTER (WHERE mask & bit > 0 AND mask & earlier = 0) AS removed,
                     sum(n) FILTER (WHERE mask & bit > 0 AND mask & earlier > 0) AS redundant, sum(n) FILTER (WHERE mask = bit) AS unique_fails,
                     sum(good) FILTER (WHERE mask & bit > 0 AND mask & earlier = 0) AS good_lost, sum(toxic) FILTER (WHERE mask & bit > 0 AND mask & earlier = 0) AS toxic_lost
              FROM c, s GROUP BY part, filter_order, step, bit)
        SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
               coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost, coalesce(sum(removed) OVER (PARTITION BY part, bit), 0)::BIGINT AS shapley FROM a""",
    "op13_prefix_trie": r"""
        WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, turn FROM conversations WHERE conv_id IS NOT NULL),
        g AS (SELECT c, list({'role': role, 'text': text} ORDER BY turn NULLS FIRST, role, substr(text, 1, 32), sha256(strlen(role) || ':' || role || text)) AS own FROM t GROUP BY c),
        h AS (SELECT *, xor(list_reduce(flatten(list_transform(string_split(c::VARCHAR, ''), lambda ch: [ascii(ch)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])),
                     lambda crc, op: CASE WHEN op >= 0 THEN xor(crc, op) WHEN crc % 2 = 1 THEN xor(crc >> 1, 3988292384) ELSE crc >> 1 END, 4294967295), 4294967295) % 6 AS h FROM g),
        r AS (SELECT h.c, coalesce(b.own[1:h.h], []) || h.own[h.h + 1:] AS turns FROM h LEFT JOIN g b ON b.c = h.c - h.c % 100),
        p AS (SELECT c, d, turns[1:d] AS prefix, len(turns) = d AS ends FROM (SELECT c, turns, unnest(range(0, len(turns) + 1)) AS d FROM r)),
        n AS (SELECT prefix, d AS depth, min(c) AS conv_id, count(*) AS n_convs, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE ends), '') AS ends FROM p GROUP BY prefix, d),
        k AS (SELECT prefix[1:depth - 1] AS prefix, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
        v AS (SELECT n.*, coalesce(n_children, 0) AS n_children, CASE WHEN depth > 0 THEN (n_convs - 1) * length(prefix[depth].text) ELSE 0 END AS saved FROM n LEFT JOIN k USING (prefix)),
        u AS (SELECT prefix[1:a] AS prefix, sum((n_children = 0)::BIGINT) AS n_leaves, sum(saved) AS saved_tokens FROM (SELECT *, unnest(range(0, depth + 1)) AS a FROM v) GROUP BY 1)
        SELECT v.conv_id, v.depth, q.conv_id AS parent_conv_id, v.n_convs, v.n_children, u.n_leaves::BIGINT AS n_leaves, u.saved_tokens::BIGINT AS saved_tokens, sha256(v.ends) AS ends_sha256
        FROM v JOIN u USING (prefix) LEFT JOIN n q ON v.depth > 0 AND q.depth = v.depth - 1 AND q.prefix = v.prefix[1:v.depth - 1]""",
}
