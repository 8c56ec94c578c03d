"""Exact, line and near deduplication against brute force, with the awkward rows."""

import hashlib
import re

import numpy as np
import pytest
import xxhash

from veilstone.llm import exact_dedup, line_dedup, simhash

SCHEMA = "doc_id LONG, text STRING, digest STRING, key INT"
ROWS = [
    (1, "a b c d", "x", 1), (2, "a b c d", None, 2), (7, "a b c d", "x", 3), (3, "", "x", 4), (4, None, "x", 5), (None, "n n", "x", 6),
    (None, "n n", "x", 6), (5, "z" * 50_000, "y", 7), (5, "other text", "y", 8), (6, "twice", "y", 9), (6, "twice", "y", 9),
]


def brute_exact(rows):
    out = []
    for r in rows:
        same = [x[0] for x in rows if (x[1] or "") == (r[1] or "") and x[0] is not None]
        out.append((r[0], max(same, default=None), sum((x[1] or "") == (r[1] or "") for x in rows), hashlib.sha256((r[1] or "").encode()).hexdigest()))
    return out


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x) for x in r))


def test_exact_labels(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    got = exact_dedup.DigestIndex(spark, buckets=3).add(docs).collect()
    assert order([(r.doc_id, r.keep_id, r.group_size, r.digest.hex()) for r in got]) == order(brute_exact(ROWS))
    kept = [r for r in got if r.kept]
    assert len(kept) == len({r.digest for r in got}) and all(r.doc_id == r.keep_id for r in kept)


def test_exact_keeps_columns_and_one_row(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    out = exact_dedup.exact_dedup(docs)
    assert out.columns == docs.columns
    got = out.collect()
    assert sorted(r.text or "" for r in got) == sorted({r[1] or "" for r in ROWS})
    assert {r.doc_id for r in got if r.text == "a b c d"} == {7}


def test_exact_second_batch_and_reopened_index(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    first = exact_dedup.DigestIndex(spark, path, buckets=3)
    first.add(spark.createDataFrame([(1, "a"), (2, "b")], "doc_id LONG, text STRING"))
    again = exact_dedup.DigestIndex(spark, path, buckets=3)
    got = again.add(spark.createDataFrame([(9, "a"), (8, "c"), (10, "c")], "doc_id LONG, text STRING"))
    assert sorted((r.doc_id, r.keep_id, r.kept) for r in got.collect()) == [(8, 10, False), (9, 1, False), (10, 10, True)]
    assert again.rows().count() == 3


def test_exact_index_is_never_shuffled(spark):
    """In both joins with the index its scan is of buckets, without an exchange above it."""
    index = exact_dedup.DigestIndex(spark, buckets=4)
    index.add(spark.createDataFrame([(i, f"t{i}") for i in range(50)], "doc_id LONG, text STRING"))
    index.add(spark.createDataFrame([(i, f"t{i}") for i in range(40, 90)], "doc_id LONG, text STRING"))
    groups = spark.createDataFrame([(hashlib.sha256(b"t7").digest(), 7)], "digest BINARY, keep_id LONG")
    for joined in (index.known(groups), groups.join(spark.table(index.table).hint("merge"), "digest", "left_anti")):
        plan = joined._jdf.queryExecution().executedPlan().toString()
        above = plan[: plan.index("Bucketed: true")].splitlines()
        scan = next(i for i in range(len(above) - 1, -1, -1) if index.table in above[i])
        depth = lambda line: len(line) - len(line.lstrip(" :+-"))
        over = [line for i, line in enumerate(above[:scan]) if depth(line) < depth(above[scan]) and all(depth(x) > depth(line) for x in above[i + 1 : scan + 1])]
        assert over and not any("Exchange" in line for line in over)
    assert [r.held_id for r in index.known(groups).collect()] == [7]


def test_exact_empty(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert exact_dedup.exact_dedup(docs).count() == 0


def brute_lines(rows, least):
    strip = " \t\n\x0b\x0c\r"
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(strip))
    split = [(r[0], (r[1] or "").split("\n")) for r in rows]
    count = {}
    for _, ls in split:
        for k in {key(x) for x in ls}:
            count[k] = count.get(k, 0) + 1
    out = []
    for i, ls in split:
        kept = [x for x in ls if not key(x) or count[key(x)] < least]
        out.append((i, len(ls), len(ls) - len(kept), "\n".join(kept)))
    return out


LINES = [(i, f"Same Line\nown {i}\n\n Étude\t", "q") for i in range(12)] + [
    (20, None, "q"), (21, "", "q"), (22, " same line \nsame line\nSAME LINE", "q"), (None, "own 3\nsame line", "q"), (23, "\n\n", "q"),
    (24, "\n".join(f"l{i}" for i in range(5000)) + "\nsame line", "q"), (22, "x\nsame line", "q"), (23, "\n\n", "q"), (25, "étude", "q"),
]


@pytest.mark.parametrize("batches", [1, 5])
def test_lines(spark, batches):
    docs = spark.createDataFrame(LINES, "doc_id LONG, text STRING, n_lines STRING")
    runs = line_dedup.LineRuns(spark, min_docs=10, fan_out=2)
    for i in range(batches):
        runs.add(spark.createDataFrame(LINES[i::batches], docs.schema))
    if batches > 1:
        assert max(runs.runs()) > 0 and all(len(v) < 2 for v in runs.runs().values())
    got = line_dedup.drop_lines(docs, runs).collect()
    assert order([(r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in got]) == order(brute_lines(LINES, 10))


def test_lines_empty(spark):
    docs = spark.createDataFrame([], "doc_id LONG, text STRING")
    runs = line_dedup.LineRuns(spark)
    runs.add(docs)
    assert line_dedup.drop_lines(docs, runs).count() == 0


def brute_print(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    k = min(3, len(words))
    hs = [xxhash.xxh64_intdigest(" ".join(words[i : i + k]).encode(), 42) for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(rows):
    fps = [brute_print(r[1]) for r in rows]
    comp = list(range(len(rows)))
    find = lambda i: i if comp[i] == i else find(comp[i])
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                comp[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return [(r[0], fps[i], least.get(find(i))) for i, r in enumerate(rows)]


def near_rows(seed=3):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for base in range(12):
        text = rng.choice(words, 200).tolist()
        for copy in range(10):
            t = list(text)
            if copy:
                t[int(rng.integers(200))] = "changed"
            rows.append((base * 10 + copy, " ".join(t)))
    return rows + [(900, None), (901, ""), (902, " \t\n"), (903, "One"), (904, "one"), (905, "a b"), (None, "a b"), (905, "a b"), (906, "w1 " * 30_000), (None, "lonely text here")]


def test_near(spark):
    rows = near_rows()
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING")
    got = [(r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in simhash.simhash_groups(docs).collect()]
    want = brute_components(rows)
    assert order(got) == order(want)
    kept = simhash.near_dedup(docs.selectExpr("text", "doc_id", "doc_id AS fp", "text AS component")).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == sorted({c for _, _, c in want if c is not None})
    assert len(kept) == len({c for _, _, c in want})


def test_near_links_in_large_tiles_are_whole():
    rng = np.random.default_rng(5)
    center = int(rng.integers(2**63))
    fps = np.array(sorted({center ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 8, (40, 2))} | {center ^ int(x) for x in rng.integers(0, 2**40, 300)}), dtype=np.uint64)
    for cut in (len(fps), 120):
        own, guests = fps[:cut], fps[cut:]
        found = {}

        def root(x):
            while found.get(x, x) != x:
                x = found[x]
            return x

        tree = simhash._Tree(own, 2)
        for a, b in [*tree.among(), *tree.with_guests(guests)]:
            for x, y in zip(a.tolist(), b.tolist(), strict=True):
                found[root(x)] = root(y)
        brute = {}

        def top(x):
            while brute.get(x, x) != x:
                x = brute[x]
            return x

        for i, x in enumerate(own.tolist()):
            for y in fps[i + 1 :].tolist():
                if (x ^ y).bit_count() <= 2:
                    brute[top(x)] = top(y)
        same = lambda f: {frozenset(x for x in fps.tolist() if f(x) == r) for r in {f(x) for x in fps.tolist()}}
        assert same(root) == same(top)


@pytest.mark.parametrize("own", [4096, 8])
def test_near_links_in_blocks(spark, own):
    """Fingerprints of few tiles, with tiles in one block and in many."""
    rng = np.random.default_rng(6)
    fps = sorted({sum(1 << int(x) for x in rng.choice(16, 8, replace=False)) for _ in range(160)} | {int(x) for x in rng.integers(0, 2**40, 40)})
    found = simhash.components(simhash.links(spark.createDataFrame([(x,) for x in fps], "fp LONG"), own=own))
    got = {x: x for x in fps} | {r.node: r.component for r in found.collect()}
    want = {x: x for x in fps}
    while True:
        nxt = {x: min(want[y] for y in fps if (x ^ y).bit_count() <= 2) for x in fps}
        if nxt == want:
            break
        want = nxt
    assert got == want


def test_near_against_tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    got = [(r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in simhash.simhash_groups(docs).collect()]
    assert sorted(got) == sorted(brute_components(rows))


def test_near_empty(spark):
    docs = spark.createDataFrame([], "doc_id LONG, text STRING")
    assert simhash.simhash_groups(docs).count() == 0 and simhash.near_dedup(docs).count() == 0
