from pyspark.sql import functions as F

from veilstone.llm import store


class Named:
    """A session whose spark.checkpoint.dir is a given one; it can't be set while a session runs."""

    def __init__(self, spark, value):
        self._jvm, self._jsc, self.sparkContext = spark._jvm, spark._jsc, spark.sparkContext
        self.conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: value)})


def test_shared_dir_is_a_uri(spark, tmp_path):
    assert store.shared_dir(spark).startswith("file:///")
    for value in (str(tmp_path), f"file://{tmp_path}/"):
        assert store.shared_dir(Named(spark, value)) == f"file://{tmp_path}"
    assert store.fresh_path(Named(spark, str(tmp_path)), "x").startswith(f"file://{tmp_path}/x-")


def test_free_name(spark):
    df = spark.createDataFrame([(1, 2)], "Key INT, _key INT")
    assert store.free_name(df, "key", "other", "key") == ["__key", "other", "___key"]


def test_global_rank(spark):
    rows = [(g, i % 50) for i in range(3000) for g in (["a"] * 3 + ["b", None])[i % 5 : i % 5 + 1]]
    df = spark.createDataFrame(rows, "g STRING, v INT")
    got = store.global_rank(df, [F.col("v").asc()], "r", "g").collect()
    by = {}
    for r in got:
        by.setdefault(r.g, []).append((r.r, r.v))
    for x in by.values():
        x.sort()
        assert [r for r, _ in x] == list(range(1, len(x) + 1)) and [v for _, v in x] == sorted(v for _, v in x)
    assert sum(map(len, by.values())) == 3000
