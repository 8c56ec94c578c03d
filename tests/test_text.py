"""Words tried only where one pattern finds any, and prefix sums of short and long arrays, against plain ones."""

from pyspark.sql import functions as F

from veilstone.functions import text

WORDS = ["ssn", "tax id", "tax", "order number", "w-2", "social security", "social security number"]
LINES = {
    "ssn 1": ["ssn"], "nothing": [], "tax-id of a tax  id": ["tax", "tax id"], "order number; w-2": ["order number", "w-2"], "taxid": [], "syntax idle": [],
    "social security number": ["social security", "social security number"], "social\tsecurity ssn": ["social security", "ssn"],
}


def test_words_of_several_parts_behind_one_pattern(spark):
    rows = spark.createDataFrame([(k,) for k in LINES], "lower STRING").select("lower", text.words_in(WORDS).alias("words"), text.count_words(WORDS).alias("n"))
    for r in rows.collect():
        assert sorted(r.words) == sorted(LINES[r.lower]) and r.n == len(LINES[r.lower]), r
    several = "|".join(p for p in (r"tax[ \t_-]+id", r"order[ \t_-]+number", r"w\-2", r"social[ \t_-]+security", r"social[ \t_-]+security[ \t_-]+number"))
    assert f"(?:{several})" in rows._jdf.queryExecution().analyzed().toString()


def test_prefix_sums(spark):
    sizes = [[], [5], [3, 0, 4], list(range(64)), list(range(65)), [7] * 200]
    got = spark.createDataFrame([(s,) for s in sizes], "sizes ARRAY<INT>").select("sizes", F.expr(text.running_sql("sizes")).alias("sums")).collect()
    assert len(got) == len(sizes)
    for r in got:
        assert r.sums == [sum(r.sizes[:i]) for i in range(len(r.sizes))]
