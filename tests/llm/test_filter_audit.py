"""Filters in every order: the polynomial against a plain run of each order, and the query against brute force."""

import re
from collections import Counter, defaultdict
from fractions import Fraction
from itertools import permutations

from hypothesis import given
from hypothesis import strategies as st

from veilstone.llm import filter_audit, queries

ORDERS = ["".join(o) for o in permutations("ABCDE")]
NAMES = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def fails(rows):
    """The letters that each (id, text) fails, by the contract's words."""
    least = {}
    for i, t, *_ in rows:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    out = []
    for i, t, *_ in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        tests = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and i > least[t]}
        out.append({k for k, v in tests.items() if v})
    return out


def brute(rows, labels):
    """rows: (id, text, part); labels: (id, quality, toxic); every order applied to every part, document by document."""
    good, toxic = ({i for i, q, t in labels if (q, t)[k] == 1 and i is not None} for k in (0, 1))
    parts = defaultdict(list)
    for (i, _, part), f in zip(rows, fails(rows), strict=True):
        parts[part or ""].append((i, f))
    out = {}
    for part, docs in parts.items():
        shares = Counter()
        for order in ORDERS:
            left = list(docs)
            for step, letter in enumerate(order, 1):
                gone, left = [d for d in left if letter in d[1]], [d for d in left if letter not in d[1]]
                shares[letter] += len(gone)
                out[part, order, step] = [len(left), len(gone), sum(letter in f for _, f in docs) - len(gone), sum(f == {letter} for _, f in docs), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)]
        for order in ORDERS:
            for step, letter in enumerate(order, 1):
                out[part, order, step].append(shares[letter])
    return out


def got(frame):
    return {(r.part, r.filter_order, r.step): [r[n] for n in NAMES] for r in frame.collect()}


LONG = " ".join(f"word{i}" for i in range(250))
ROWS = [
    (1, LONG, "en"), (2, LONG, "en"), (3, LONG, "de"), (3, LONG, "de"), (None, LONG, "en"), (0, "same " * 300, "en"), (5, LONG.upper(), "de"), (6, LONG + " #1", None), (7, LONG + " #1", ""),
    (8, None, "en"), (9, "", "fr"), (10, " ".join("ab" for _ in range(300)), "fr"), (11, "x" * 90_000, "fr"), (12, "A B C | d", "de"), (1, "A B C | d", "de"), (13, LONG + " Ä\x0bé\x0cz", "en"), (14, "same " * 300, "en"),
]
LABELS = [(1, 1, 0), (2, 1, 1), (2, 0, 0), (3, None, 1), (5, 0, 1), (None, 1, 1), (11, 1, None), (14, 1, 0), (99, 1, 1)]


def test_awkward_rows(spark):
    docs = spark.createDataFrame([(*r, "z", 1) for r in ROWS], "doc_id LONG, text STRING, lang STRING, part STRING, mask INT")
    labels = spark.createDataFrame(LABELS, "doc_id LONG, quality INT, toxic INT")
    assert got(filter_audit.filter_audit(docs, labels)) == brute(ROWS, LABELS)
    assert filter_audit.filter_audit(docs.limit(0), labels).collect() == []
    assert got(filter_audit.filter_audit(docs, labels.limit(0))) == brute(ROWS, [])


def test_query(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang").collect()]
    assert got(queries.op12_filter_audit(spark, sf_dir)) == brute(rows, [tuple(r) for r in labels.select("doc_id", "quality", "toxic").collect()])


def test_other_filters(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "a"), (3, "bb"), (4, "bb")], "doc_id LONG, text STRING").selectExpr("*", "'p' AS lang")
    labels = spark.createDataFrame([], "doc_id LONG, quality INT, toxic INT")
    rows = filter_audit.filter_audit(docs, labels, {"S": docs["text"] == "a", "X": filter_audit.COPY}).collect()
    assert sorted((r.filter_order, r.step, r.kept, r.removed, r.shapley) for r in rows) == [("SX", 1, 2, 2, 3), ("SX", 2, 1, 1, 3), ("XS", 1, 2, 2, 3), ("XS", 2, 1, 1, 3)]


@given(st.dictionaries(st.integers(0, 31), st.integers(0, 1000)))
def test_polynomial(counts):
    poly = filter_audit.polynomial(counts)
    for x in range(32):
        assert filter_audit.corner(poly, x) == sum(n for m, n in counts.items() if m & x)
    for i in range(5):
        assert filter_audit.shapley(poly, 1 << i) == sum((Fraction(n, m.bit_count()) for m, n in counts.items() if m >> i & 1), Fraction(0))
