"""How filters interact: what each removes in every order, and its Shapley share.

Documents become counts by part and by the set of filters that they fail (a mask).  From the counts of a
part its removal polynomial is formed, f(x) = sum over masks m of n_m (1 - product over i in m of
(1 - x_i)): the documents removed where filter i is applied with chance x_i.  It is multilinear, so

- its value at a corner (each x_i 0 or 1) is what these filters remove together: differences of
  corners along an order give each step, and all minus a corner the survivors;
- a filter's Shapley share is the integral over t of df/dx_i at (t, ..., t), a sum of exact
  rationals; times the number of orders it is an integer.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from itertools import permutations
from math import factorial

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilstone.functions.text import let
from veilstone.llm.exact_dedup import digest
from veilstone.llm.store import quoted, written

#: The filter that an earlier copy of the text fails; the others are conditions on the text.
COPY = "copy"


def failures(text: Column) -> dict[str, Column | str]:
    """Conditions under which a text fails the filters of the contract, by letter, in the order of the mask's bits."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+", -1), lambda w: w != "")
    many = lambda n, times: n.cast("long") * times
    return {
        "A": F.size(words) < 200,
        "B": let(words, lambda w: many(F.size(F.array_distinct(w)), 100) < many(F.size(w), 50)),
        "C": many(F.regexp_count(text, F.lit("[A-Z]")), 100) > many(F.char_length(text), 3),
        "D": text.rlike("[#$%&*|]"),
        "E": COPY,
    }


def mask_counts(docs: DataFrame, labels: DataFrame, filters: dict[str, Column | str] | None = None, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(part, mask, n, good, toxic): documents by part and failed filters, and how many are labelled good and toxic.

    Texts are read once, for their mask and digest, and never travel.  Rows of one (id, digest, part) are
    counted before they meet the labels; a text's copies are counted by part and label before the smallest id of
    the text is sought, so a text that a third of all rows have is a few rows a task.  A row fails COPY if a
    row of any part with a smaller id has its text; null ids are neither smaller nor larger.  Null texts
    are empty, a null part is the empty string, a document is good (toxic) if any of its labels says 1.
    """
    text = F.coalesce(F.col(quoted(text_col)), F.lit(""))
    filters = failures(text) if filters is None else filters
    bits = [(1 << i, c) for i, c in enumerate(filters.values())]
    mask = sum((F.when(c, b).otherwise(0) for b, c in bits if not isinstance(c, str)), F.lit(0))
    copy = sum(b for b, c in bits if isinstance(c, str))
    rows = docs.select(F.col(quoted(id_col)).alias("id"), F.coalesce(F.col(quoted(part_col)).cast("string"), F.lit("")).alias("part"), digest(text).alias("digest"), mask.alias("mask"))
    rows = written(rows.groupBy("id", "part", "digest", "mask").agg(F.count(F.lit(1)).alias("n")), "audit-rows")
    said = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(*[F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0)).alias(k) for k, c in (("good", "quality"), ("toxic", "toxic"))])
    # rows without an id have no labels; they stay out of the join, where they would meet in one task
    known = rows.where("id IS NOT NULL").join(said, "id", "left").select(*rows.columns, F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    every = known.unionByName(rows.where("id IS NULL").withColumns({"good": F.lit(0), "toxic": F.lit(0)}))
    key = ["digest", "part", "mask", "good", "toxic"]
    # first: rows with the smallest id of their (part, label); it may or may not be the smallest of the text
    each = every.groupBy(*key).agg(
        F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("id").isNotNull(), F.col("n"))), F.lit(0)).alias("named"), F.min("id").alias("least"), F.min_by("n", "id").alias("first")
    )
    smallest = F.min("least").over(Window.partitionBy("digest"))
    late = F.col("named") - F.when(F.col("least") == smallest, F.col("first")).otherwise(0)
    split = each.withColumn("late", late).select(
        "part", "good", "toxic", F.inline(F.array(F.struct(F.col("mask").alias("mask"), (F.col("n") - F.col("late")).alias("n")), F.struct(F.col("mask").bitwiseOR(F.lit(copy)).alias("mask"), F.col("late").alias("n"))))
    )
    return split.where("n > 0").groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))


def polynomial(counts: dict[int, int]) -> dict[int, int]:
    """The removal polynomial of counts by mask: coefficients by monomial, a set of filters as bits."""
    out: dict[int, int] = {}
    for mask, n in counts.items():
        part = mask
        while part:
            out[part] = out.get(part, 0) + (n if part.bit_count() % 2 else -n)
            part = (part - 1) & mask
    return out


def corner(poly: dict[int, int], applied: int) -> int:
    """The polynomial where the filters of ``applied`` are on and the others off: what they remove together."""
    return sum(c for part, c in poly.items() if not part & ~applied)


def shapley(poly: dict[int, int], bit: int) -> Fraction:
    """The integral from 0 to 1 of the derivative by the filter's variable, along the diagonal."""
    return sum((Fraction(c, part.bit_count()) for part, c in poly.items() if part & bit), Fraction(0))


def interactions(counts: DataFrame, letters: str) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of counts by mask.

    One part's counts are at most 2 to the number of filters, which is what a task holds at once; parts
    are dealt over the tasks.  No rows in, no rows out.
    """
    orders, everything = ["".join(o) for o in permutations(letters)], (1 << len(letters)) - 1
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]

    def table(rows: pd.DataFrame) -> pd.DataFrame:
        part, total = rows["part"].iloc[0], int(rows["n"].sum())
        polys = {c: polynomial({int(m): int(n) for m, n in zip(rows["mask"], rows[c], strict=True)}) for c in ("n", "good", "toxic")}
        gone = {c: [corner(p, x) for x in range(everything + 1)] for c, p in polys.items()}
        shares = {1 << i: shapley(polys["n"], 1 << i) * factorial(len(letters)) for i in range(len(letters))}

        def steps() -> Iterator[tuple]:
            for order in orders:
                before = 0
                for step, letter in enumerate(order, 1):
                    bit = 1 << letters.index(letter)
                    after = before | bit
                    removed = gone["n"][after] - gone["n"][before]
                    lost = [gone[c][after] - gone[c][before] for c in ("good", "toxic")]
                    yield part, order, step, total - gone["n"][after], removed, gone["n"][bit] - removed, gone["n"][everything] - gone["n"][everything ^ bit], *lost, int(shares[bit])
                    before = after

        return pd.DataFrame(list(steps()), columns=["part", "filter_order", "step", *names])

    return counts.groupBy("part").applyInPandas(table, "part STRING, filter_order STRING, step INT, " + ", ".join(f"{n} LONG" for n in names))


def filter_audit(docs: DataFrame, labels: DataFrame, filters: dict[str, Column | str] | None = None, **columns: str) -> DataFrame:
    """Every order of the filters over every part of ``docs``: see ``mask_counts`` and ``interactions``.

    filters: conditions of failing by letter (COPY: an earlier row has the text), the contract's five by default.
    """
    letters = "ABCDE" if filters is None else "".join(filters)
    return interactions(mask_counts(docs, labels, filters, **columns), letters)
