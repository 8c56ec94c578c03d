"""The trie of conversations against nested dictionaries, with long conversations in small blocks."""

import hashlib
import zlib
from collections import defaultdict

import pytest

from veilstone.llm import prefix_trie, queries

NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SCHEMA = "conv_id LONG, turn LONG, role STRING, text STRING, pos STRING, n INT"


def brute(rows):
    """rows: (conv, turn, role, text) -> the nodes as tuples, sorted."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            code = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own[conv].append(((turn is not None, turn or 0), role, text[:32], code, text))
    own = {c: [(t[1], t[4]) for t in sorted(v)] for c, v in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in own.items():
        h, base = zlib.crc32(str(c).encode()) % 6, c - (abs(c) % 100) * (1 if c >= 0 else -1)
        whole = tuple(own.get(base, [])[:h] + turns[h:])
        for d in range(len(whole) + 1):
            members[whole[:d]].append(c)
        ends[whole].append(c)
    children = defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in children
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    out = [
        (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children.get(p, 0), leaves[p], saved[p], hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest())
        for p, m in members.items()
    ]
    return sorted(out, key=lambda r: (r[1], r[0], r[3:]))


def got(frame):
    return sorted((tuple(r[n] for n in NAMES) for r in frame.collect()), key=lambda r: (r[1], r[0], r[3:]))


def awkward():
    rows = [(c, t, "user" if t % 2 == 0 else "bot", f"turn {t} of {c % 3}") for c in list(range(95, 130)) + [200, 205, 299, 1000, 1001, -7, -100, -107] for t in range(c % 9)]
    rows += [(300 + c, t, "user", "the same words") for c in range(60) for t in range(4)]
    rows += [(400, None, None, None), (400, 0, "", "é" * 40 + "b"), (400, 0, "", "é" * 40 + "a"), (400, 0, "a", "x"), (400, 0, "a", "x"), (400, 5, "bot", "y" * 50_000)]
    return rows + [(None, 1, "user", "lost"), (500, 1, "user", "alone"), (501, 2, "user", ""), (501, 1, None, "z")]


def test_awkward_rows(spark):
    rows = awkward()
    frame = spark.createDataFrame([(*r, "p", 1) for r in rows], SCHEMA)
    assert got(prefix_trie.prefix_trie(frame)) == brute(rows)
    assert prefix_trie.prefix_trie(frame.limit(0)).collect() == []


@pytest.mark.parametrize("n", [5, 64])
def test_long_conversations_are_cut_into_blocks(spark, monkeypatch, n):
    """Two conversations of 65 turns that part at the 50th, one that ends where a block does, and a family of copies."""
    monkeypatch.setattr(prefix_trie, "BLOCK", n)
    monkeypatch.setattr(prefix_trie, "CHUNK", 7)
    monkeypatch.setattr(prefix_trie, "FAN_IN", 2)
    rows = [(c, t, "user", f"t{t}" if t < 50 or c == 3 else f"u{t}") for c in (3, 4) for t in range(65)] + [(c, t, "user", f"t{t}") for c in (5, 6) for t in range(n)]
    rows += [(100 * k, t, "bot", f"t{t % 3}") for k in range(1, 40) for t in range(12)]
    assert got(prefix_trie.prefix_trie(spark.createDataFrame([(*r, "p", 1) for r in rows], SCHEMA).repartition(5))) == brute(rows)


def test_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(queries.op13_prefix_trie(spark, sf_dir)) == brute(rows)
