"""Token counts with a digest cache.

The count of a text depends on its normalised content and on the tokenizer alone.  Both are known by
digests; counts that are stored for such a pair are joined, and only one text for each digest that
is missing is encoded and appended to the cache.
"""

from __future__ import annotations

import functools
import hashlib
import json
from collections.abc import Iterator
from itertools import chain, filterfalse

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilstone.llm.store import batches as arrow_batches
from veilstone.llm.store import fresh_path, quoted, written

#: Characters whose words go to the library at once; words that a worker remembers in each generation, and the
#: longest such word.
AT_ONCE, REMEMBERED, REMEMBERED_LENGTH = 1 << 20, 400_000, 64


def normalised(text: Column, by_word: bool = True) -> Column:
    """Null as empty; for counting by word, runs of ASCII white space as one space, none at the ends.

    That changes no count where the tokenizer drops white space, and special strings hold none.
    """
    text = F.coalesce(text, F.lit(""))
    return F.trim(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ")) if by_word else text


def counts_by_word(path: str) -> bool:
    """Whether a text has just the tokens of its words: white space ends words and is dropped.

    True for a tokenizer file whose first pre-tokenizer drops all that its pattern of words doesn't
    match, with a pattern of no white space, whose normaliser works within words, and whose special
    strings hold no white space and take none; for any other, whole texts are encoded.
    """
    if path.endswith(".model"):
        return False
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    steps = lambda x, key: [] if x is None else x[key] if x["type"] == "Sequence" else [x]
    first = (steps(spec.get("pre_tokenizer"), "pretokenizers") or [{"type": ""}])[0]
    words = first.get("pattern", {}).get("Regex", "") if first["type"] == "Split" and first.get("behavior") == "Removed" and first.get("invert") else ""
    split = bool(words) and r"[^\s" in words and r"|\s" not in words and " " not in words
    inside = all(n["type"] in {"NFC", "NFD", "NFKC", "NFKD", "Lowercase"} or (n["type"] == "Replace" and n["pattern"] == {"Regex": r"\s+"} and n["content"] == " ") for n in steps(spec.get("normalizer"), "normalizers"))
    plain = all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or any(c.isspace() for c in t["content"])) for t in spec.get("added_tokens", []))
    return bool((split or first["type"] in {"WhitespaceSplit", "Whitespace", "BertPreTokenizer"}) and inside and plain)


@functools.lru_cache(maxsize=4)
def _tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


@functools.lru_cache(maxsize=4)
def _pieces(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def version(path: str) -> str:
    """Digest of the tokenizer: its file, the library's version and the normalisation here."""
    import sentencepiece
    import tokenizers

    library = sentencepiece.__version__ if path.endswith(".model") else tokenizers.__version__
    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + f"|{library}|{'one space' if counts_by_word(path) else 'as it is'}".encode()).hexdigest()


class WordCounts(dict):
    """word -> tokens, for the words a worker met lately (two generations of REMEMBERED words)."""

    def __init__(self, path: str):
        self.tokenizer, self.older = _tokenizer(path), {}

    def learn(self, words: list[str]) -> None:
        """Counts the words that aren't known, through the library."""
        missing = []
        for w in words:
            if (n := self.older.get(w)) is None:
                missing.append(w)
            else:
                self[w] = n
        for i in range(0, len(missing), 20_000):
            part = missing[i : i + 20_000]
            for w, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                self[w] = len(e)


@functools.lru_cache(maxsize=2)
def _words(path: str) -> WordCounts:
    return WordCounts(path)


def count_whole(texts: list[str], path: str) -> list[int]:
    """Tokens of each text, one text at a time, without begin, end or added special tokens."""
    if path.endswith(".model"):
        return [len(_pieces(path).encode(t)) for t in texts]
    return [len(_tokenizer(path).encode(t, add_special_tokens=False)) for t in texts]


def count_tokens(texts: list[str], path: str) -> list[int]:
    """Tokens of each normalised text, for a tokenizer that ``counts_by_word``.

    Neither its normaliser nor its pattern nor a special string reaches across white space; so a text
    has the tokens of its words, and a word is encoded once.  Words of over REMEMBERED_LENGTH
    characters are forgotten at once, so that texts without spaces don't fill a worker's memory.
    """
    known, out, waiting, size = _words(path), [], [], 0

    def settle() -> None:
        if len(known) > REMEMBERED:
            known.older = dict(known)
            known.clear()
        known.learn(list(filterfalse(known.__contains__, set(chain.from_iterable(waiting)))))
        out.extend(sum(map(known.__getitem__, words)) for words in waiting)
        for w in {w for words in waiting for w in words if len(w) > REMEMBERED_LENGTH}:
            known.pop(w, None)
        waiting.clear()

    for text in texts:
        waiting.append(text.split(" "))
        size += len(text)
        if size > AT_ONCE:
            settle()
            size = 0
    settle()
    return out


class TokenCache:
    """Stored counts: (tokenizer digest, content digest, n_tokens) as Parquet below ``path``.

    One writer at a time; a text is known by the SHA-256 of its normalised content.
    """

    def __init__(self, spark: SparkSession, tokenizer_path: str, path: str | None = None):
        self.spark, self.tokenizer_path, self.version = spark, tokenizer_path, version(tokenizer_path)
        self.path = f"{path or fresh_path(spark, 'token-cache')}/tokenizer={self.version}"
        self._empty().write.mode("ignore").parquet(self.path)

    def _empty(self) -> DataFrame:
        return self.spark.createDataFrame([], "digest BINARY, n_tokens BIGINT")

    def rows(self) -> DataFrame:
        return self.spark.read.schema("digest BINARY, n_tokens BIGINT").parquet(self.path)

    def count(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """(id, n_bytes, n_tokens) for each row of ``docs``.

        Null and empty texts have 0 bytes and 0 tokens; null and repeated ids are kept as they are;
        equal texts are encoded once; long ones are encoded whole; other columns aren't read.  No rows
        in, no rows out.
        """
        path, by_word = self.tokenizer_path, counts_by_word(self.tokenizer_path)
        text = normalised(F.col(quoted(text_col)), by_word)
        digest = F.unhex(F.sha2(text, 256)).alias("digest")
        n_bytes = F.coalesce(F.octet_length(F.col(quoted(text_col))), F.lit(0)).cast("long").alias("n_bytes")
        keys = written(docs.select(F.col(quoted(id_col)).alias("id"), F.xxhash64(F.col(quoted(id_col))).alias("k"), n_bytes, digest), "token-keys")
        # written first: else the anti-join moves below the aggregation, and copies meet in one task
        distinct = written(keys.groupBy("digest").agg(F.min("k").alias("k")), "token-digests")
        misses = written(distinct.join(self.rows().hint("merge"), "digest", "left_anti"), "token-misses")
        texts = docs.select(digest, F.xxhash64(F.col(quoted(id_col))).alias("k"), text.alias("text")).join(misses, ["digest", "k"], "left_semi").select("digest", "text")

        def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                n = (count_tokens if by_word else count_whole)(b.column("text").to_pylist(), path)
                yield pa.RecordBatch.from_arrays([b.column("digest"), pa.array(n, pa.int64())], ["digest", "n_tokens"])

        new = texts.mapInArrow(encode, "digest BINARY, n_tokens BIGINT")
        with arrow_batches(self.spark):
            new.dropDuplicates(["digest"]).write.mode("append").parquet(self.path)
        return keys.join(self.rows(), "digest").select(F.col("id").alias(id_col), "n_bytes", "n_tokens")
