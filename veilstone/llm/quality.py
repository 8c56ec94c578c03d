"""Quality by importance resampling.

Two bag models of hashed n-grams are fitted: one of target text (texts labelled good) and one of the
raw text (all documents).  The log of a text's importance weight is the sum, over its n-grams, of the
log ratio of the two.  With Gumbel noise added, the k largest are a sample without replacement in
proportion to the weights; k is the number of texts that the weights themselves call for.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from veilstone.llm.store import batches as arrow_batches
from veilstone.llm.store import columns, free_name, global_rank, mapped, small_batches, with_fields, written

#: Words and runs of other marks; two white-space-separated words alike are one n-gram of their own.
TOKEN = re.compile(r"\w+|[^\w\s]+")
#: Hash buckets; how many counts the target model begins with, for each that it has, dealt as raw text is
#: (n-grams that a small sample happens to lack then weigh little).
BUCKETS, PRIOR = 1 << 16, 1.0
#: Bound of the labelled sample: texts, and characters of a text.
TEXTS, LENGTH = 6000, 30_000
#: Tokens at once; words whose hashes a worker keeps, and the longest such word.
AT_ONCE, REMEMBERED, REMEMBERED_LENGTH = 1 << 18, 300_000, 64


class Grams:
    """Hashed word unigrams and bigrams of whole texts."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def of(self, text: str | None) -> Iterator[np.ndarray]:
        """Buckets of a text's n-grams, some at a time."""
        words, known = TOKEN.findall((text or "").lower()), self.known
        for i in range(0, len(words), AT_ONCE):
            part = words[i : i + AT_ONCE + 1]
            if len(known) > REMEMBERED:
                known.clear()
            long = set()
            for w in part:
                if w not in known:
                    known[w] = crc32(w.encode("utf-8", "surrogatepass"))
                    if len(w) > REMEMBERED_LENGTH:
                        long.add(w)
            h = np.fromiter(map(known.__getitem__, part), dtype=np.uint64, count=len(part))
            for w in long:
                del known[w]
            pair = (h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]) ^ np.uint64(0x5BD1E995)
            pair ^= pair >> np.uint64(29)
            pair[h[:-1] == h[1:]] = np.uint64(1)
            yield np.concatenate([h[:AT_ONCE], pair]) % np.uint64(BUCKETS)


def histogram(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """How often each bucket occurs in all of ``docs``: a count for each bucket and task, summed by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, counts = Grams(), np.zeros(BUCKETS, dtype=np.int64)
        held: list[np.ndarray] = []

        def settle() -> None:
            counts[:] += np.bincount(np.concatenate(held).astype(np.int64), minlength=BUCKETS)
            held.clear()

        for b in batches:
            for t in b.column(0).to_pylist():
                for x in grams.of(t):
                    held.append(x)
                    if sum(map(len, held[-64:])) > AT_ONCE or len(held) >= 4096:
                        settle()
        if held:
            settle()
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(counts[at], pa.int64())], ["bucket", "n"])

    with arrow_batches(docs.sparkSession):
        rows = docs.select(*columns(docs, [text_col])).mapInArrow(run, "bucket INT, n LONG").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(BUCKETS)
    for r in rows:
        out[r.bucket] = r.n
    return out


def sample_target(docs: DataFrame, labels: DataFrame, texts: int = TEXTS, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, float]:
    """(texts labelled good, share of good among the labelled rows).

    At most ``texts`` rows of at most ``length`` characters: those with the smallest hashes of their ids.
    """
    good = F.col("quality") == 1
    usable = labels.where(F.col(id_col).isNotNull() & F.col("quality").isin(0, 1))
    n, n_good = usable.agg(F.count(F.lit(1)), F.sum(good.cast("long"))).first()
    ids = usable.where(good).select(id_col).distinct().orderBy(F.xxhash64(F.lit("quality"), F.col(id_col)), id_col).limit(texts)
    return docs.where(F.length(text_col) <= length).join(F.broadcast(ids), id_col, "left_semi"), (n_good or 0) / n if n else 1.0


def log_ratio(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """For each bucket the log of its probability in target text over that in raw text."""
    r = (raw + 1.0) / (raw + 1.0).sum()
    t = target + PRIOR * target.sum() * r
    return np.log(t / t.sum()) - np.log(r)


def gumbel(doc_id: Column, seed: str) -> Column:
    """Standard Gumbel noise that depends on the seed and the id alone."""
    u = (F.pmod(F.xxhash64(F.lit(seed), doc_id), F.lit(1 << 40)).cast("double") + 0.5) / float(1 << 40)
    return -F.log(-F.log(u))


def weigh(docs: DataFrame, ratio: np.ndarray, name: str, id_col: str, text_col: str, keep_text: bool) -> DataFrame:
    """``docs`` with the log weight of each whole text; null and empty texts have 0."""
    small_batches(docs.sparkSession)
    kept = [f for f in docs.schema if keep_text or f.name != text_col]
    sent = docs.sparkSession.sparkContext.broadcast(ratio)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, table = Grams(), sent.value
        for b in batches:
            w = []
            for t in b.column(text_col).to_pylist():
                parts = [float(table[x].sum()) for x in grams.of(t)]
                w.append(sum(parts))
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in kept), pa.array(w, pa.float64())], [*(f.name for f in kept), name])

    return mapped(docs, run, with_fields(kept, **{name: DoubleType()}))


@dataclass
class Resampling:
    """The fitted ratio, the noise's seed, and the smallest key that stays."""

    ratio: np.ndarray
    seed: str
    least: float


def scored(docs: DataFrame, found: Resampling, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` with log_weight, key and kept."""
    w = weigh(docs.drop("log_weight", "key", "kept"), found.ratio, "log_weight", id_col, text_col, keep_text)
    return w.withColumn("key", F.col("log_weight") + gumbel(F.col(id_col), found.seed)).withColumn("kept", F.col("key") >= found.least)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: str = "gumbel", **bounds) -> tuple[Resampling, DataFrame]:
    """(the resampling of ``docs`` towards the labelled good texts, the written keys of all rows).

    A text's weight times the share of good labels is the chance that it is target text, 1 at most; k
    is the sum of these chances, rounded up, and the k-th largest key the least that stays.  Without
    good labels everything stays.
    """
    docs = docs.select(*columns(docs, [id_col, text_col]))
    target, share = sample_target(docs, labels, id_col=id_col, text_col=text_col, **bounds)
    t = histogram(target, text_col)
    ratio = log_ratio(t, histogram(docs, text_col)) if t.sum() else np.zeros(BUCKETS)
    share = share if t.sum() else 1.0
    with arrow_batches(docs.sparkSession):
        keys = written(scored(docs, Resampling(ratio, seed, 0.0), id_col, text_col, keep_text=False).drop("kept"), "quality-keys")
    chance = F.least(F.lit(1.0), F.lit(share) * F.exp(F.least("log_weight", F.lit(50.0))))
    k = int(np.ceil(keys.agg(F.sum(chance)).first()[0] or 0))
    rank = free_name(keys, "rank_no")[0]
    kth = global_rank(keys.select("key"), [F.col("key").desc()], rank).where(F.col(rank) == k).select("key").collect()
    return Resampling(ratio, seed, kth[0][0] if kth else float("-inf")), keys


def resample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(id, log_weight, key, kept) for each row of ``docs``.

    kept: the key, log weight plus noise, is among the k largest (ties of the k-th stay too).  Null and
    empty texts have no n-grams and log weight 0; null and repeated ids are fine (rows that repeat id
    and text have one key); long texts are weighed whole, some tokens at a time; other columns aren't
    read.  No rows in, no rows out.
    """
    found, keys = fit(docs, labels, id_col, text_col, **options)
    return keys.withColumn("kept", F.col("key") >= found.least)


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that resampling keeps, with their columns.

    Texts are scored once for the keys and once for the filter, so that they are neither shuffled nor
    stored in between.  Nulls, long texts and repeats are as in ``resample``; all columns are kept,
    whatever their names and types.  No rows in, no rows out.
    """
    found, _ = fit(docs, labels, id_col, text_col, **options)
    weight = free_name(docs, "log_weight_of_row")[0]
    rows = weigh(docs, found.ratio, weight, id_col, text_col, keep_text=True)
    return rows.where(F.col(weight) + gumbel(F.col(id_col), found.seed) >= found.least).select(*columns(docs))
