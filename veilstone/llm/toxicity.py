"""Toxicity by subword bags: averaged embeddings into a linear softmax, trained jointly in numpy.

The features of a word are the word itself and its character n-grams, so a misspelling that was never
seen shares most vectors of the word it comes from.  A text is scored in windows of words: the
vectors of a window's features are averaged, the linear softmax gives its probability, and the text
has that of its worst window, so that a long text doesn't drown a short insult.  Training alternates
between fitting the windows and choosing, of texts labelled toxic, the windows that make them so.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from veilstone.llm.store import columns, mapped, quoted, small_batches, with_fields, written

WORD = re.compile(r"\w+")
#: Hash buckets and size of the vectors; words in a window; lengths of the n-grams.
BUCKETS, SIZE, WINDOW, GRAMS = 1 << 18, 8, 20, (3, 4)
#: A window counts as so many features at least, so that a few words alone don't weigh more than in a sentence.
LEAST = 150
#: Bounds of the training sample: texts of each class, characters of a text, windows of each class (drawn at random).
TEXTS, LENGTH, WINDOWS = 2400, 30_000, 20_000
#: Where the squared gradients of a vector start, which keeps rare features near zero; share of texts for the line.
START, ASIDE = 3e-3, 4
#: Words that a worker remembers, by a digest if they are longer than this; the threshold of a prediction.
REMEMBERED, REMEMBERED_LENGTH, THRESHOLD = 250_000, 64, 0.3


def features(word: str) -> list[int]:
    """Buckets of a lower-cased word and its character n-grams, with its borders marked."""
    w = f"<{word}>".encode("utf-8", "surrogatepass")
    out = [crc32(w)]
    for n in GRAMS:
        out += [crc32(w[i : i + n], n) for i in range(len(w) - n + 1)]
    return [x % BUCKETS for x in out]


def held_out(doc_id: Column) -> Column:
    """Rows that training never sees: crc32 of the id as text leaves 2 by 4 (a null id is none)."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


@dataclass
class Model:
    """What scoring needs: for each bucket its vector's share in the logit, the bias, and the line from a
    text's worst window to its logit."""

    logit: np.ndarray
    bias: float
    slope: float = 1.0
    level: float = 0.0


class Bags:
    """Windows of training texts as bags of features; a word's features are computed once."""

    def __init__(self, texts: list[str]):
        known: dict[str, int] = {}
        word_features: list[np.ndarray] = []
        windows: list[np.ndarray] = []
        self.text: list[int] = []
        for t, text in enumerate(texts):
            ids = []
            for w in WORD.findall(text.lower()):
                if (i := known.get(w)) is None:
                    i = known[w] = len(word_features)
                    word_features.append(np.array(features(w), dtype=np.int32))
                if not ids or ids[-1] != i:  # a word that repeats itself counts once
                    ids.append(i)
            for at in range(0, len(ids), WINDOW):
                windows.append(np.array(ids[at : at + WINDOW]))
                self.text.append(t)
        sizes = np.array([len(f) for f in word_features], dtype=np.int64)
        self.flat = np.concatenate(word_features) if word_features else np.empty(0, np.int32)
        self.sizes, self.starts = sizes, np.cumsum(sizes) - sizes
        self.windows, self.text = windows, np.array(self.text)

    def of(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(features, size of each window) of some windows."""
        words = np.concatenate([self.windows[i] for i in which])
        sizes = self.sizes[words]
        ends = np.cumsum(sizes)
        flat = self.flat[np.arange(ends[-1]) + np.repeat(self.starts[words] - (ends - sizes), sizes)]
        lengths = np.array([len(self.windows[i]) for i in which])
        return flat, np.add.reduceat(sizes, np.cumsum(lengths) - lengths)


def fit(texts: list[str], toxic: list[int], rounds: int = 3, passes: int = 2, rate: float = 0.5, seed: int = 11, most: int = WINDOWS) -> Model:
    """A model from texts and labels; the same input gives the same model.  Without both classes it scores 0 or 1.

    most: windows of each class that it learns from, drawn at random of those of the sample.
    """
    y_text = np.array(toxic, dtype=np.int64)
    if not len(y_text) or y_text.min() == y_text.max():
        return Model(np.zeros(BUCKETS, dtype=np.float32), -20.0 if not len(y_text) or not y_text.max() else 20.0)
    rng = np.random.default_rng(seed)
    aside = rng.permutation(len(texts)) % ASIDE == 0
    if len({*y_text[aside]}) < 2 or len({*y_text[~aside]}) < 2:
        aside[:] = False
    all_texts, all_labels = texts, y_text
    texts, y_text = [t for t, a in zip(texts, aside, strict=True) if not a], y_text[~aside]
    bags = Bags(texts)
    y = y_text[bags.text]
    positive = rng.permutation(np.flatnonzero(y == 1))[:most]
    negative = rng.permutation(np.flatnonzero(y == 0))[:most]
    vectors = rng.normal(0, 0.1, (BUCKETS, SIZE)).astype(np.float32)
    weights, bias = rng.normal(0, 0.5, (SIZE, 2)).astype(np.float32), np.zeros(2, dtype=np.float32)
    g_vec, g_w, g_b = np.full(BUCKETS, START, dtype=np.float32), np.full((SIZE, 2), 1e-3, dtype=np.float32), np.full(2, 1e-3, dtype=np.float32)

    def forward(which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        flat, sizes = bags.of(which)
        mean = np.add.reduceat(vectors[flat], np.cumsum(sizes) - sizes, axis=0) / np.maximum(sizes, LEAST)[:, None]
        z = mean @ weights + bias
        z -= z.max(axis=1, keepdims=True)
        p = np.exp(z)
        return flat, sizes, mean, p / p.sum(axis=1, keepdims=True)

    chosen = positive
    for turn in range(rounds):
        if turn:
            p = np.concatenate([forward(positive[i : i + 1024])[3][:, 1] for i in range(0, len(positive), 1024)])
            best = np.full(len(y_text), -1.0)
            np.maximum.at(best, bags.text[positive], p)
            top = best[bags.text[positive]]
            chosen = positive[(p >= top) | (p >= np.maximum(0.5, 0.7 * top))]
        for _ in range(passes):
            rows = np.concatenate([chosen, negative])
            # classes weigh alike in the first round; later, windows without insults shall weigh more
            lift = len(negative) / max(1, len(chosen)) if turn == 0 else min(4.0, len(negative) / max(1, len(chosen)))
            rows = rng.permutation(rows)
            for i in range(0, len(rows), 128):
                which = rows[i : i + 128]
                flat, sizes, mean, p = forward(which)
                d = p.copy()
                d[np.arange(len(which)), y[which]] -= 1
                d *= np.where(y[which] == 1, lift, 1.0)[:, None] / len(which)
                dw, db = mean.T @ d, d.sum(axis=0)
                dm = (d @ weights.T * len(which)).astype(np.float32)
                g_w += dw * dw
                g_b += db * db
                weights -= (rate * dw / np.sqrt(g_w)).astype(np.float32)
                bias -= (rate * db / np.sqrt(g_b)).astype(np.float32)
                # each bucket's vector moves along the sum of what its windows ask for
                order = np.argsort(flat, kind="stable")
                f = flat[order]
                cut = np.concatenate([[0], np.flatnonzero(f[1:] != f[:-1]) + 1])
                share = (dm / np.maximum(sizes, LEAST)[:, None].astype(np.float32))[np.repeat(np.arange(len(which)), sizes)[order]]
                total = np.add.reduceat(share, cut, axis=0)
                at = f[cut]
                g_vec[at] += (total * total).mean(axis=1)
                vectors[at] -= rate * total / np.sqrt(g_vec[at])[:, None]
    vectors[g_vec <= np.float32(START)] = 0  # features that no window had say nothing
    model = Model((vectors @ (weights[:, 1] - weights[:, 0])).astype(np.float32), float(bias[1] - bias[0]))
    if aside.any():
        scorer = Scorer(model)
        z = np.array([scorer.worst(t) for t, a in zip(all_texts, aside, strict=True) if a])
        model.slope, model.level = line(z, all_labels[aside])
    return model


def line(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and level of a logistic regression of y on z, by Newton steps, the slope kept above 0."""
    shift, scale = z.mean(), z.std() + 1e-9
    x = np.stack([(z - shift) / scale, np.ones_like(z)], axis=1)
    b = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = x.T @ (x * (p * (1 - p))[:, None]) + 1e-2 * np.eye(2)
        b += np.linalg.solve(h, x.T @ (y - p) - 1e-2 * b)
    slope = max(b[0], 1e-3) / scale
    return float(slope), float(b[1] - slope * shift)


class Scorer:
    """Scores whole texts; a word's sum over its features is kept until REMEMBERED words are known."""

    def __init__(self, model: Model):
        self.model, self.words = model, {}
        self.sums, self.sizes = np.zeros(REMEMBERED * 2), np.zeros(REMEMBERED * 2)

    def _ids(self, words: list[str]) -> np.ndarray:
        if len(self.words) > REMEMBERED:
            self.words.clear()
        known, logit = self.words, self.model.logit
        keys = [w if len(w) <= REMEMBERED_LENGTH else blake2b(w.encode("utf-8", "surrogatepass"), digest_size=16).digest() for w in words]
        for w, key in zip(words, keys, strict=True):
            if key not in known:
                f = features(w)
                i = known[key] = len(known)
                self.sums[i], self.sizes[i] = logit[f].sum(dtype=np.float64), len(f)
        return np.fromiter(map(known.__getitem__, keys), dtype=np.int64, count=len(words))

    def worst(self, text: str | None) -> float:
        """The logit of the worst window; of no words that of an empty bag."""
        words, worst = WORD.findall((text or "").lower()), -np.inf
        for i in range(0, len(words), REMEMBERED // 2):
            ids = self._ids(words[i : i + REMEMBERED // 2])
            ids = ids[np.concatenate([[True], ids[1:] != ids[:-1]])]
            cuts = np.arange(0, len(ids), WINDOW)
            z = np.add.reduceat(self.sums[ids], cuts) / np.maximum(np.add.reduceat(self.sizes[ids], cuts), LEAST)
            worst = max(worst, float(z.max()))
        return (worst if words else 0.0) + self.model.bias

    def score(self, text: str | None) -> float:
        z = self.model.slope * self.worst(text) + self.model.level
        return float(1.0 / (1.0 + np.exp(-min(max(z, -500.0), 500.0))))


def sample(docs: DataFrame, labels: DataFrame, texts: int = TEXTS, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> tuple[list[str], list[int]]:
    """Labelled texts for training: at most ``texts`` rows of each class, of ``length`` characters at most.

    Those with the smallest hashes of their ids are taken, and of rows that repeat an id those with the
    smallest hashes of their texts.  Held-out rows, rows without an id or a label, and ids that are
    labelled both 0 and 1, never are.
    """
    label, doc_id = F.col("toxic"), F.col(quoted(id_col))
    usable = labels.where(~held_out(doc_id) & doc_id.isNotNull() & label.isin(0, 1))
    usable = usable.groupBy(doc_id.alias("id")).agg(F.min(label).alias("toxic"), F.max(label).alias("most")).where("toxic = most").drop("most")
    order = [F.xxhash64(F.lit("toxicity"), F.col("id")), F.col("id")]
    parts = [usable.where(F.col("toxic") == c).orderBy(*order).limit(texts) for c in (0, 1)]
    chosen = F.broadcast(parts[0].unionByName(parts[1]))  # at most 2 x texts rows
    text = F.col(quoted(text_col))
    rows = docs.where(F.length(text) <= length).select(doc_id.alias("id"), text.alias("text")).join(chosen, "id")
    rows = written(rows, "toxicity-sample")
    got = [tuple(r) for c in (0, 1) for r in rows.where(F.col("toxic") == c).orderBy(*order, F.xxhash64("text"), "text").limit(texts).collect()]
    got.sort(key=lambda r: (str(r[0]), r[1], r[2]))
    return [r[1] for r in got], [r[2] for r in got]


def score(docs: DataFrame, model: Model, name: str = "score", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (the columns ``keep``; by default all but the text) with the score of each whole text.

    Null and empty texts get what no evidence gives.  The model travels with the task; its size is fixed.
    """
    small_batches(docs.sparkSession)
    kept = [f for f in docs.schema if (f.name in keep if keep is not None else f.name != text_col)]
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for b in batches:
            s = [scorer.score(t) for t in b.column(text_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in kept), pa.array(s, pa.float64())], [*(f.name for f in kept), name])

    return mapped(docs, run, with_fields(kept, **{name: DoubleType()}))


def toxicity(spark: SparkSession, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id, held_out, score, predicted) for each row, by a model of the labelled rows that aren't held out.

    Null and empty texts get the score of no evidence; a null id is not held out; every row is scored by
    itself and whole, so repeated rows have equal scores; other columns aren't read.  Without labels of
    both classes all rows get one score, 0 or 1 but for rounding.  No rows in, no rows out.
    """
    model = fit(*sample(docs, labels, id_col=id_col, text_col=text_col))
    scored = score(docs.select(*columns(docs, [id_col, text_col])), model, text_col=text_col)
    doc_id = F.col(quoted(id_col))
    return scored.select(doc_id, held_out(doc_id).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
