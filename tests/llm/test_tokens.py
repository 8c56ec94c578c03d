"""Token counts and byte-pair encoding against the library."""

import random

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from veilstone.llm import bpe, token_counts  # noqa: E402

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id LONG, text STRING, ids STRING, digest STRING, k INT"


def texts(n=1500, seed=4):
    rng = random.Random(seed)
    odd = "abcdehilnorST '!*#$ \n\t019\x1c\x1f\x85\xa0 ​᠎\x00Σσ̧́é"
    parts = ["ing", "tion", "The", " ", "  ", "re", "'s", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "aaaa", "ab", "\n", "ü"]
    out = ["", " ", "\n\n", "word " * 5000, "a" * 20_000, "<|endoftext|>", "x<|endoftext|>y  <|endoftext|> z"]
    for _ in range(n):
        k = rng.choice([1, 2, 8, 30])
        kind = rng.random()
        if kind < 0.4:
            out.append("".join(chr(rng.choice([rng.randrange(1, 0xD800), rng.randrange(1, 0x370), rng.randrange(0xE000, 0x11000), rng.randrange(0x1F000, 0x1FA00)])) for _ in range(k)))
        elif kind < 0.7:
            out.append("".join(rng.choice(odd) for _ in range(k * 2)))
        else:
            out.append("".join(rng.choice(parts) for _ in range(k)))
    return out


@pytest.fixture(scope="module")
def rows():
    t = texts()
    return [(i, x, "x", None, i) for i, x in enumerate(t)] + [(5000, None, "x", "y", 1), (None, t[9], "x", "y", 1), (None, t[9], "x", "y", 1), (3, t[10], "x", "y", 1), (3, t[11], None, "y", 2)]


def test_counts(spark, rows):
    t = Tokenizer.from_file(WORD)
    docs = spark.createDataFrame(rows, SCHEMA)
    cache = token_counts.TokenCache(spark, WORD)
    want = sorted((r[0] if r[0] is not None else -1, len((r[1] or "").encode()), len(t.encode(r[1] or "", add_special_tokens=False))) for r in rows)
    for _ in range(2):
        got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.n_tokens) for r in cache.count(docs).collect())
        assert got == want
    stored = cache.rows()
    assert stored.count() == stored.select("digest").distinct().count()


def test_counts_use_what_is_stored(spark):
    cache = token_counts.TokenCache(spark, WORD)
    docs = spark.createDataFrame([(1, "one two"), (2, " one\n two ")], "doc_id LONG, text STRING")
    cache.count(docs).collect()
    assert cache.rows().count() == 1
    cache.rows().selectExpr("digest", "n_tokens").collect()
    other = token_counts.TokenCache(spark, BYTE, path=cache.path.rsplit("/", 1)[0])
    assert other.rows().count() == 0
    cache.count(spark.createDataFrame([(3, "one two"), (4, "three")], docs.schema)).collect()
    assert cache.rows().count() == 2


def test_counts_of_no_rows(spark):
    assert token_counts.TokenCache(spark, WORD).count(spark.createDataFrame([], SCHEMA)).count() == 0


def test_encode_and_decode(spark, rows):
    t = Tokenizer.from_file(BYTE)
    docs = spark.createDataFrame(rows, SCHEMA)
    got = bpe.encode_texts(docs, BYTE, decoded=True).select("doc_id", "text", "ids", "decoded").collect()
    assert len(got) == len(rows)
    for r in got:
        ids = t.encode(r.text or "", add_special_tokens=False).ids
        assert r.ids == ids
        assert r.decoded == t.decode(ids, skip_special_tokens=False)


def test_encode_no_rows(spark):
    assert bpe.encode_texts(spark.createDataFrame([], SCHEMA), BYTE).count() == 0


def test_a_word_is_encoded_in_linear_time_and_exactly():
    b, t = bpe.load(BYTE), Tokenizer.from_file(BYTE)
    for word in ("a" * 100_000, "abab" * 20_000, "ionization" * 5000):
        assert [b.ids[n] for n in b.encode_word(word.encode())] == t.encode(word, add_special_tokens=False).ids


def test_forgetting_words_changes_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 50)
    b, t = bpe.Bpe(BYTE), Tokenizer.from_file(BYTE)
    for x in texts(400, 9):
        assert b.encode(x).tolist() == t.encode(x, add_special_tokens=False).ids


def test_words_are_the_librarys_for_every_character():
    """Each code point before and after a letter, a number, a sign and an apostrophe's ending, in one long text."""
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library, own = Tokenizer.from_file(path).pre_tokenizer, bpe.load(path)
    codes = [c for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF and not 0xE000 <= c <= 0xF8FF and c < 0xF0000]
    for i in range(0, len(codes), 50_000):
        text = "".join(f"a{chr(c)}1{chr(c)}!{chr(c)}'s {chr(c)}" for c in codes[i : i + 50_000])
        ends = [e for _, (_, e) in library.pre_tokenize_str(text)]
        mine, at = [], 0
        for w in own.split(text):
            at += len(w)
            mine.append(at)
        assert mine == ends


def test_unassigned_letters_encode_as_in_the_library():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library, own = Tokenizer.from_file(path), bpe.load(path)
    for c in (0x558, 0x88F, 0xA7CE, 0x191A3, 0x1C89, 0xE9, 0x4E00):
        for text in (f"{chr(c)}'s", f"x{chr(c)}y  {chr(c)} {chr(c)}1", f"don't {chr(c)}\n"):
            assert own.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids
