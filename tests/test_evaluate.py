"""Labelled spans against findings: overlaps and assignments by brute force, and what a redaction leaves."""

import random

from veilstone.operators import evaluate

FOUND = "doc_id LONG, start INT, length INT, validator STRING, type STRING, confidence DOUBLE"
TRUTH = "doc_id LONG, start INT, length INT, validator STRING, types ARRAY<STRING>, min_band STRING"


def test_overlaps_are_all_and_come_once(spark):
    rng = random.Random(5)
    spans = [[(rng.choice([1, 2, None]), rng.randrange(3000), rng.choice([0, 1, 5, 300, 900])) for _ in range(120)] for _ in range(2)]
    left = spark.createDataFrame([(*s, i) for i, s in enumerate(spans[0])], "doc_id LONG, start INT, length INT, a INT")
    right = spark.createDataFrame([(*s, i) for i, s in enumerate(spans[1])], "doc_id LONG, other_start INT, other_length INT, b INT")
    got = sorted((r.a, r.b) for r in evaluate.overlaps(left, right, ["doc_id"]).collect())
    want = sorted((i, j) for i, (d, s, n) in enumerate(spans[0]) for j, (e, t, m) in enumerate(spans[1]) if d == e and n and m and s < t + m and t < s + n)
    assert got == want


def test_labels_choose_in_their_order(spark):
    rng = random.Random(7)
    for _ in range(3):
        pairs = {(a, b): rng.choice([15.0, 60.0, 90.0]) for a in range(30) for b in range(30) if rng.random() < 0.12}
        free, want = set(range(30)), set()
        for a in range(30):
            mine = sorted((-s, b) for (x, b), s in pairs.items() if x == a and b in free)
            if mine:
                want.add((a, mine[0][1]))
                free.discard(mine[0][1])
        frame = spark.createDataFrame([(a, b, s) for (a, b), s in pairs.items()], "label_no LONG, finding_no LONG, score DOUBLE")
        assert {(r.label_no, r.finding_no) for r in evaluate.assigned(frame).collect()} == want


def test_counts(spark):
    truth = spark.createDataFrame(
        [(1, 0, 11, "ssn", ["SSN"], "HIGH"), (1, 20, 11, "ssn", ["SSN"], "HIGH"), (1, 40, 11, "ssn", ["SSN"], "LOW"), (2, 0, 16, "creditcard", ["VISA", "CREDIT_CARD"], "MEDIUM"), (None, 0, 9, "ssn", ["SSN"], "LOW")], TRUTH
    )
    found = spark.createDataFrame(
        [
            (1, 0, 11, "ssn", "SSN", 95.0), (1, 2, 9, "phone", "PHONE", 70.0), (1, 19, 12, "ssn", "SSN", 70.0), (1, 44, 3, "ssn", "SSN", 100.0), (1, 80, 11, "ssn", "SSN", 60.0),
            (2, 0, 16, "creditcard", "JCB", 100.0), (2, 60, 16, "creditcard", "VISA", 15.0), (None, 0, 9, "ssn", "SSN", 50.0),
        ], FOUND,
    )
    got = {r.validator: tuple(r[c] for c in evaluate.COUNTS) for r in evaluate.quality(truth, found).collect()}
    # tp, tp_medium, fn_missed, fn_band, fp_medium, fp_low, extra
    assert got == {"ssn": (2, 2, 1, 1, 1, 0, 1), "creditcard": (0, 0, 1, 0, 0, 1, 1), "phone": (0, 0, 0, 0, 0, 0, 1), None: (2, 2, 2, 1, 1, 1, 3)}
    whole = evaluate.quality(truth, found).where("validator IS NULL").first()
    assert (whole.recall_all, whole.recall_medium, whole.precision_medium) == (3 / 5, 2 / 5, 2 / 3)
    assert evaluate.quality(truth.limit(0), found.limit(0)).collect() == []


def test_leaks(spark):
    truth = spark.createDataFrame([(1, "536-22-8726"), (1, "ann"), (None, "x y"), (2, ""), (3, None)], "doc_id LONG, value STRING")
    texts = spark.createDataFrame([(1, "ssn ***-**-8726 of ann"), (None, "x y z"), (2, "abc"), (3, None)], "doc_id LONG, redacted STRING")
    assert sorted(r.value for r in evaluate.leaks(truth, texts).collect()) == ["ann", "x y"]
