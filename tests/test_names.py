"""Names by tables of many names, and the filter before them."""

import re
import time

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veilstone.functions import membership
from veilstone.plans.scan import detect, scan

SCHEMA = "doc_id LONG, text STRING"


def tables(spark, n):
    """Tables of n first and n last names of letters only; the last names of odd numbers have an accent."""
    letters = F.translate(F.lpad(F.conv(F.col("id"), 10, 26), 4, "0"), "0123456789ABCDEFGHIJKLMNOP", "abcdefghijklmnopqrstuvwxyz")
    first, last = F.concat(F.lit("ka"), letters), F.concat(F.lit("vo"), letters, F.when(F.col("id") % 2 == 1, "é").otherwise(""))
    return spark.range(n).select(first.alias("name")), spark.range(n).select(last.alias("name"))


def test_the_filter_drops_no_member_and_lets_few_others_through(spark):
    first, last = tables(spark, 200_000)
    words = membership.filter_words(first)
    assert words.count() == 1 and len(words.first()["words"]) == membership.WORDS
    through = membership.might_hold(words, F.col("name"))
    assert first.where(~through).count() == 0 and last.where(through).count() < 0.03 * 200_000
    assert first.select(F.lit(None).cast("string").alias("name")).where(through).count() == 0


def test_listed_is_exact(spark):
    first, _ = tables(spark, 5000)
    names = [r.name for r in first.limit(300).collect()]
    rows = spark.createDataFrame([(i, [n, n + "x"] if i % 3 else [n + "q"], "c") for i, n in enumerate(names)] + [(900, [], "c"), (901, None, None), (902, [None, names[0]], "c")], "id LONG, forms ARRAY<STRING>, c STRING")
    got = {r.id: (r.has, r.c) for r in membership.listed(rows, ["id"], "forms", first, "has").collect()}
    assert got == {i: (i % 3 > 0, "c") for i in range(300)} | {900: (False, "c"), 901: (False, None), 902: (True, "c")}
    plan = membership.listed(rows, ["id"], "forms", first.repartition(3), "has")._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftOuter" in plan and "Cross" not in plan


def test_names_of_large_tables(spark):
    first, last = tables(spark, 200_000)
    a, b, c = (r.name.capitalize() for r in (first.first(), last.where("name NOT LIKE '%é'").first(), last.where("name LIKE '%é'").first()))
    text = f"met {a} {b} today\nmet {a} {c} too\n{a} Unknown\nDr. Zoe Unknown came\n"
    got = {(r.line_number, r.text) for r in scan(spark.createDataFrame([(1, text)], SCHEMA), ["PERSON_NAME"], names=(first, last)).collect()}
    assert {(1, f"{a} {b}"), (2, f"{a} {c}"), (4, "Dr. Zoe Unknown")} <= got and not any(n == 3 for n, _ in got)


def test_shapes_overlap_and_the_longest_stays(spark):
    names = (["mary", "john", "ann"], ["johnson", "smith", "lee"])
    found = lambda text: sorted((r.start_col, r.text) for r in scan(spark.createDataFrame([(1, text)], SCHEMA), ["PERSON_NAME"], names=names).collect())
    # the longer shape ends with a word that is no name: the shorter one inside is found all the same
    assert found("Mary Johnson Arrived here") == [(1, "Mary Johnson")]
    assert found("signed Dr. Mary Johnson and Mary Johnson") == [(8, "Dr. Mary Johnson")]
    assert found("Ann Lee met Joann Leeson and Ann Lee") == [(1, "Ann Lee")]


@settings(max_examples=30, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["Ann", "Lee", "Bo", "Cy"]), min_size=1, max_size=4), max_size=12))
def test_runs_of_words(names):
    """The rule of ``longest_names`` by itself: a text goes if a longer one has its words in a row."""
    texts = sorted({" ".join(n) for n in names}, key=lambda t: (-len(t), t))
    runs, kept = set(), []
    for t in texts:
        words = tuple(re.findall(r"\w+|\W", t))
        if words not in runs:
            kept.append(t)
            runs.update(words[i:j] for i in range(len(words)) for j in range(i + 1, len(words) + 1))
    assert kept == [t for t in texts if not any(t != x and f" {t} " in f" {x} " for x in texts)]


def test_many_names_of_one_line(spark):
    def seconds(n):
        docs = spark.createDataFrame([(1, "; ".join(f"Ann Le{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676 % 26)}" for i in range(n)))], SCHEMA)
        began = time.time()
        assert scan(docs, ["PERSON_NAME"], names=(["ann"], [f"le{chr(97 + i)}aa" for i in range(26)])).count() == 26
        return time.time() - began

    seconds(100)
    assert seconds(17_000) < 6 * max(3.0, seconds(4_000))


def test_names_meet_their_tables_once_and_are_compared_in_place(spark):
    """Both parts of a name go to the tables in one join, no Python sees the rows, and what nobody reads isn't made."""
    first, last = (spark.createDataFrame([(n,) for n in names], "name STRING") for names in (["mary", "john", "ann"], ["johnson", "smith", "lee"]))
    text = "Mary Johnson Smith met Ann Lee; Ann Lee and Mary Johnson; Zoe-John Smith left\nUnknown Smith or Mary Unknown"
    found = scan(spark.createDataFrame([(1, text), (1, text)], SCHEMA), ["PERSON_NAME"], names=(first, last))
    got = sorted((r.line_number, r.text) for r in found.collect())
    assert got == sorted(2 * [(1, "Mary Johnson Smith"), (1, "Ann Lee"), (1, "Zoe-John Smith"), (2, "Unknown Smith")])
    plain = detect(spark.createDataFrame([(1, text)], SCHEMA), ["PERSON_NAME"], names=(first, last)).select("doc_id", "text", "confidence")
    plan = plain._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftOuter, ((part") == 1 and "MapInArrow" not in plan and "subtotal" not in plan
