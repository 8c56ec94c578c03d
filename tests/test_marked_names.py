"""Names without a table of last names: by titles, degrees and suffixes alone, for which alone lines are kept."""

from pyspark.sql import functions as F

from veilstone.plans.scan import detect, uses

MARKED = ["Dr. Anna Smith", "Prof. Mr. Karl Olson", "Lady. Anna Smith", "Anna Smith, PhD", "x Anna Smith,  RN.", "Karl Olson Jr", "Karl Olson Jr.", "Karl Olson III", "Zoë Ångström Esq. x"]
PLAIN = ["Anna Smith", "Smith, Anna", "Karl Olson PERSON", "Avec Jours Vieux", "Jr Drive"]


def test_lines_without_marks_are_left_out(spark):
    docs = spark.createDataFrame(list(enumerate(MARKED + PLAIN)), "doc_id LONG, text STRING")
    kept = {r.doc_id for r in docs.where(F.expr(uses(["PERSON_NAME"], "text", marked=True))).collect()}
    assert kept == set(range(len(MARKED)))
    found = {r.doc_id for r in detect(docs, ["PERSON_NAME"]).select("doc_id").collect()}
    assert found == set(range(len(MARKED)))
    plan = detect(docs, ["PERSON_NAME"])._jdf.queryExecution().optimizedPlan().toString()
    assert "(?:Mr|Ms|Mrs|Dr|Prof|Sir|Dame|Lord|Lady)" in plan and "{2,30}" not in plan
