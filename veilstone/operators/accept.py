"""Acceptance in order: candidates of a line of which each one accepted rules out others."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilstone.functions.text import let_sql

#: Shortest number whose places inside longer ones are kept; shorter ones are compared one by one.
SHORTEST, LONGEST = 6, 32


class Accepted:
    """The numbers that a line has given, for the question whether another equals, holds or lies in one of them.

    All parts of an accepted number from SHORTEST characters on are kept, so a question costs as many look-ups as the
    asked number has parts, however many were accepted; very short and very long ones are rare and looked through.
    """

    def __init__(self) -> None:
        self.whole: set[str] = set()
        self.parts: set[str] = set()
        self.odd: list[str] = []

    def rules_out(self, number: str) -> bool:
        if not number:
            return False
        if len(number) < SHORTEST or len(number) > LONGEST:
            return any(number in x or x in number for x in self.whole) or any(number in x or x in number for x in self.odd)
        inside = any(number[i:j] in self.whole for i in range(len(number) - SHORTEST + 1) for j in range(i + SHORTEST, len(number) + 1))
        return inside or number in self.parts or any(number in x or x in number for x in self.odd)

    def add(self, number: str) -> None:
        if not number:
            return
        if len(number) < SHORTEST or len(number) > LONGEST:
            self.odd.append(number)
            return
        self.whole.add(number)
        self.parts.update(number[i:j] for i in range(len(number) - SHORTEST + 1) for j in range(i + SHORTEST, len(number) + 1))


def first_numbers(rows: DataFrame, number: str = "number", line: str = "line_key") -> DataFrame:
    """The rows whose ``number`` no earlier accepted number of their line equals, holds or lies in.

    A line's candidates come from one row of the lines, so they follow each other in a partition in the order in
    which they were made (pattern by pattern, each from left to right): they are folded as they stream
    by, without a shuffle or a sort, in memory that one line's accepted numbers take.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, taken = None, Accepted()
        for b in batches:
            keep = []
            for key, n in zip(b.column(line).to_pylist(), b.column(number).to_pylist(), strict=True):
                if key != at:
                    at, taken = key, Accepted()
                out = taken.rules_out(n)
                keep.append(not out)
                if not out:
                    taken.add(n)
            yield b.filter(pa.array(keep, pa.bool_()))

    return rows.mapInArrow(fold, rows.schema)


def longest_names(rows: DataFrame, line: str = "line_key") -> DataFrame:
    """Of the rows of a line (text, score, start) the surest of each text, without texts that a longer one has as some of its words.

    Each text stands beside its own parts of several words (few, as names are short; most have none), and in a line a
    text that equals a part of another goes: what is in a part of a longer text is in that text too, so it doesn't
    matter which texts stay.  Time is in proportion to the line's candidates; columns that nothing reads aren't made.
    Streams, which have no such windows, are folded.
    """
    if rows.isStreaming:
        return _folded(rows, line)
    # parts begin with a word and end with a word or its dot, as names do, and have a space inside
    cuts = let_sql("filter(sequence(1, size(ws)), k -> ws[k - 1] RLIKE '^[\\\\w.]')", "cs", "flatten(transform(cs, (a, n) -> transform(slice(cs, n + 2, size(cs)), b -> array_join(slice(ws, a, b - a + 1), ''))))")
    parts = let_sql("regexp_extract_all(text, '(?U)\\\\w+|\\\\W', 0)", "ws", f"IF(size(ws) <= 3, CAST(array() AS ARRAY<STRING>), {cuts})")
    each = rows.select("*", F.posexplode(F.expr(f"concat(array(text), filter({parts}, p -> p <> text AND p RLIKE '\\\\s'))")).alias("part_no", "part"))
    others = [F.when(F.col("part_no") == 0, F.col(c)).alias(c) for c in rows.columns if c != line]
    first = F.row_number().over(Window.partitionBy(line, "part").orderBy((F.col("part_no") == 0).asc(), F.col("score").desc(), "start"))
    kept = each.select(line, *others, "part_no", "part").withColumn("nth", first).where("nth = 1 AND part_no = 0")
    return kept.select(*rows.columns)


def _folded(rows: DataFrame, line: str) -> DataFrame:
    """``longest_names`` of rows that come together sorted, longest texts first, and are folded as they stream by."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, runs = None, set()
        for b in batches:
            keep = []
            for key, text in zip(b.column(line).to_pylist(), b.column("text").to_pylist(), strict=True):
                if key != at:
                    at, runs = key, set()
                words = tuple(re.findall(r"\w+|\W", text))
                out = words in runs
                keep.append(not out)
                if not out:
                    runs.update(words[i:j] for i in range(len(words)) for j in range(i + 1, len(words) + 1))
            yield b.filter(pa.array(keep, pa.bool_()))

    order = [line, F.char_length("text").desc(), "text", F.col("score").desc(), "start"]
    return rows.repartition(line).sortWithinPartitions(*order).mapInArrow(fold, rows.schema)
