"""How good findings are: labelled spans against findings, and values that a redaction left.

Spans meet by overlap: both sides are dealt into bins of positions, a pair is made in the first bin that its
spans share, and no document's spans are paired with all of its others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilstone.functions.tables import written
from veilstone.functions.text import band, quoted
from veilstone.operators.overlap import row_of

#: Characters of a bin; the bands from the weakest; what is counted.
BIN = 256
RANKS = {"LOW": 1, "MEDIUM": 2, "HIGH": 3}
COUNTS = ["tp", "tp_medium", "fn_missed", "fn_band", "fp_medium", "fp_low", "extra"]
#: Fewest characters of a finding that can stand for a label: a shorter one would be right about anything.
LEAST_LENGTH = 8


def _rank(name: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in RANKS.items() for x in pair]), name)


def _binned(spans: DataFrame, start: str, length: str) -> DataFrame:
    """A row for each bin that a span reaches into; spans without characters reach into none."""
    first, last = F.floor(F.col(start) / BIN), F.floor((F.col(start) + F.col(length) - 1) / BIN)
    return spans.where(F.col(length) > 0).withColumn("bin", F.explode(F.sequence(first, last)))


def overlaps(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Pairs of overlapping spans: rows of ``left`` (start, length and others) and ``right`` (other_start, other_length and others) of equal ``on``.

    A pair is kept in the bin where the later of both spans begins, so none comes twice and nothing has to be
    made distinct.  Null keys are equal.  Only spans that share a bin ever meet, so a document with many spans costs
    about as much as its spans and their overlaps.
    """
    a, b = _binned(left, "start", "length"), _binned(right, "other_start", "other_length")
    b = b.select(*[F.col(c).alias(f"other_{c}") for c in (*on, "bin")], *[c for c in right.columns if c not in on])
    same = F.col("bin") == F.col("other_bin")
    for c in on:
        same &= F.col(c).eqNullSafe(F.col(f"other_{c}"))
    begins = F.greatest("start", "other_start")
    touch = (F.col("start") < F.col("other_start") + F.col("other_length")) & (F.col("other_start") < F.col("start") + F.col("length"))
    return a.join(b, same & touch & (F.floor(begins / BIN) == F.col("bin"))).drop("bin", "other_bin", *[f"other_{c}" for c in on])


def assigned(pairs: DataFrame) -> DataFrame:
    """(label_no, finding_no): each label its best finding that no earlier label has, each finding at most once.

    pairs: label_no, finding_no, score.  Labels in the order of their numbers each take the finding with the largest score
    that is left (ties: the smallest number).  It is found by deferred acceptance: all labels ask at once, a finding
    keeps the earliest that asked, the others ask their next best.  Rounds go on while someone was
    refused: few, as labels that compete for one finding are few.
    """
    best = Window.partitionBy("label_no").orderBy(F.col("score").desc(), "finding_no")
    earliest = Window.partitionBy("finding_no").orderBy("label_no")
    left = written(pairs, "pairs")
    while True:
        asked = left.withColumn("nth", F.row_number().over(best)).where("nth = 1").withColumn("place", F.row_number().over(earliest))
        asked = written(asked.select("label_no", "finding_no", "place"), "asked")
        if not asked.where("place > 1").limit(1).count():
            return asked.select("label_no", "finding_no")
        left = written(left.join(asked.where("place > 1"), ["label_no", "finding_no"], "left_anti"), "pairs")


def outcomes(truth: DataFrame, findings: DataFrame) -> DataFrame:
    """(validator, outcome): one row for each label and for each finding that isn't a label's.

    truth: doc_id (and doc_key, where the findings have it), start (characters from the document's first), length, validator,
    types (those that are right) and min_band (the weakest that will do).  A finding can stand for a label
    if they overlap, it is not shorter than LEAST_LENGTH, and its type is one of the label's.  Outcomes of labels: tp
    (with tp_medium, if the finding is MEDIUM at least), fn_band (found, but weaker than wanted), fn_missed;
    of other findings: extra (over a label that another finding has or that wants another type), fp_medium, fp_low.
    """
    on = [c for c in row_of(findings) if c in truth.columns]
    labels = written(truth.select(*on, "start", "length", "validator", "types", "min_band").withColumn("label_no", F.monotonically_increasing_id()), "labels")
    found = findings.select(*on, F.col("start").alias("other_start"), F.col("length").alias("other_length"), F.col("validator").alias("by"), "type", "confidence")
    found = written(found.withColumn("finding_no", F.monotonically_increasing_id()), "found")
    pairs = written(overlaps(labels, found, on), "overlaps")
    right = pairs.where((F.col("other_length") >= LEAST_LENGTH) & F.array_contains("types", F.col("type"))).select("label_no", "finding_no", F.col("confidence").alias("score"))
    taken = assigned(right)
    got = labels.join(taken.join(found.select("finding_no", "confidence"), "finding_no"), "label_no", "left")
    rank = _rank(band(F.col("confidence")))
    kind = F.when(F.col("confidence").isNull(), "fn_missed").when(rank < _rank(F.col("min_band")), "fn_band").otherwise("tp")
    of_labels = got.select("validator", kind.alias("outcome"), (F.coalesce(rank, F.lit(0)) >= RANKS["MEDIUM"]).alias("medium"))
    free = found.join(taken.select("finding_no"), "finding_no", "left_anti")
    free = free.join(pairs.select("finding_no", F.lit(True).alias("over")).distinct(), "finding_no", "left")
    medium = _rank(band(F.col("confidence"))) >= RANKS["MEDIUM"]
    other = F.when(F.col("over"), "extra").when(medium, "fp_medium").otherwise("fp_low")
    return of_labels.unionByName(free.select(F.col("by").alias("validator"), other.alias("outcome"), medium.alias("medium")))


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, 1.0).otherwise(part / whole)


def quality(truth: DataFrame, findings: DataFrame) -> DataFrame:
    """Counts of ``outcomes`` by validator and over all (validator null), with recall_all (found at all), recall_medium and precision_medium.

    Nothing to find is a recall of 1, nothing found a precision of 1.  Without labels and findings there are no rows.
    """
    is_a = lambda name: F.count_if((F.col("outcome") == name)).cast("long").alias(name)
    counts = [F.count_if(F.col("medium") & F.col("outcome").isin("tp", "fn_band")).cast("long").alias("tp_medium"), *[is_a(c) for c in COUNTS if c != "tp_medium"]]
    table = outcomes(truth, findings).rollup("validator").agg(*counts, F.grouping("validator").alias("total"))
    table = table.where("total = 1 OR validator IS NOT NULL")
    labelled = F.col("tp") + F.col("fn_band") + F.col("fn_missed")
    shares = [
        _share(F.col("tp") + F.col("fn_band"), labelled).alias("recall_all"), _share(F.col("tp_medium"), labelled).alias("recall_medium"),
        _share(F.col("tp_medium"), F.col("tp_medium") + F.col("fp_medium")).alias("precision_medium"),
    ]
    return table.select("validator", *COUNTS, *shares)


def leaks(truth: DataFrame, redacted: DataFrame, id_col: str = "doc_id", text_col: str = "redacted") -> DataFrame:
    """The rows of ``truth`` (doc_id, value and others) whose value still stands in its document's redacted text.

    Values join their documents by id; null and empty values can't leak.
    """
    texts = redacted.select(F.col(quoted(id_col)).alias("text_doc"), F.col(quoted(text_col)).alias("left_text"))
    joined = truth.where("value != ''").join(texts, F.col("doc_id").eqNullSafe(F.col("text_doc")))
    return joined.where(F.contains("left_text", "value")).drop("text_doc", "left_text")
