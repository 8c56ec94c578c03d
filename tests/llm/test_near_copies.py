"""Near copies of the pipeline's stage against brute force."""

import re

import numpy as np
import pytest

from veilstone.llm import near_copies

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def brute_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    k = min(5, len(words))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if words else {()}


def brute_kept(rows):
    sets, comp = [brute_set(r[1]) for r in rows], list(range(len(rows)))

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            y = sets[j]
            if 5 * min(len(x), len(y)) >= 4 * max(len(x), len(y)) and 5 * len(x & y) >= 4 * len(x | y):
                comp[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return sorted(least.values()), len({find(i) for i in range(len(rows))})


def awkward_rows():
    rng = np.random.default_rng(11)
    rows = []
    for base in range(30):
        text = rng.choice([f"w{i}" for i in range(400)], int(rng.integers(4, 260))).tolist()
        for copy in range(6):
            t = list(text)
            for _ in range(copy * len(text) // 100):  # similarities on both sides of 0.8
                t[int(rng.integers(len(t)))] = f"new{rng.integers(10**6)}"
            rows.append((base * 10 + copy, " ".join(t)))
    return rows + [(900, None), (901, " \t"), (902, "One two"), (903, "one  TWO"), (None, "lonely text"), (904, "twice"), (904, "twice"), (None, rows[0][1])]


def test_stage_drops_all_pairs_of_the_rule(spark):
    rows = awkward_rows()
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING")
    got = corpus_pipeline.distinct_content(spark, docs, "").collect()
    ids, groups = brute_kept(rows)
    assert sorted(r.doc_id for r in got if r.doc_id is not None) == ids
    assert len(got) == groups and len(ids) < 150


def test_stage_against_tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = corpus_pipeline.distinct_content(spark, docs, sf_dir)
    assert sorted(r.doc_id for r in got.select("doc_id").collect()) == brute_kept([tuple(r) for r in docs.select("doc_id", "text").collect()])[0]


def test_no_rows(spark):
    assert near_copies.near_copies(spark.createDataFrame([], "doc_id LONG, text STRING")).count() == 0


@pytest.mark.parametrize("own", [4096, 7])
def test_large_groups_in_blocks(spark, monkeypatch, own):
    """A group whose members are similar to some others only, in tiles of many blocks."""
    rng = np.random.default_rng(5)
    text = rng.choice([f"w{i}" for i in range(900)], 200).tolist()
    rows = []
    for i in range(90):
        t = list(text)
        for _ in range(int(rng.integers(0, 6))):
            t[int(rng.integers(len(t)))] = f"new{rng.integers(10**6)}"
        rows.append((i, " ".join(t)))
    monkeypatch.setattr(near_copies, "OWN", own)
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING")
    assert sorted(r.doc_id for r in near_copies.near_copies(docs).collect()) == brute_kept(rows)[0]


def test_tiles_are_bits_of_the_fingerprint():
    """Fingerprints of similarity 0.8 share a key but for a chance of MISSED, and unrelated ones share few, at any number of texts."""
    rng = np.random.default_rng(3)
    for n, most in ((300, 0.2), (200_000, 0.2), (2_000_000, 0.05)):
        samples = near_copies.bit_samples(n)
        fp = rng.integers(0, 2**64, (5000, near_copies.WORDS), dtype=np.uint64)
        flip = np.packbits(rng.random((5000, 64 * near_copies.WORDS)) < 0.1515, axis=1, bitorder="little").view("<u8")
        keys, near, other = (near_copies.tile_keys(x, samples) for x in (fp, fp ^ flip, np.roll(fp, 1, axis=0)))
        assert (~(keys == near).any(axis=1)).mean() <= 3 * near_copies.MISSED
        assert (keys == other).any(axis=1).mean() <= most
        assert (keys >> 32 == np.arange(len(samples))).all()


def test_similar_texts_share_a_key_of_their_fingerprint():
    rng, samples = np.random.default_rng(9), near_copies.bit_samples(1000)
    for _ in range(50):
        words = rng.choice([f"w{i}" for i in range(5000)], 300).tolist()
        cut = words[:267]  # similarity 263 / 296
        a, b = (near_copies.tile_keys(near_copies.fingerprint(near_copies.shingles(" ".join(w)))[None, :], samples) for w in (words, cut))
        assert (a == b).any()
