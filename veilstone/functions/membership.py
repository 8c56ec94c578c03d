"""Membership in tables of any size: a filter of fixed size first, an exact join for what it lets through."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words of 64 bits of the filter (half a megabyte, whatever the table's size) and bits that an element sets in its word.
WORDS, BITS = 1 << 16, 4


def _hash(value: Column) -> Column:
    return F.xxhash64(F.lit("member"), value)


def _word(value: Column) -> Column:
    return F.pmod(_hash(value), F.lit(WORDS)).cast("int")


def _mask(value: Column) -> Column:
    """The bits of an element in its word, from parts of the hash above those that choose the word."""
    out = F.lit(0).cast("long")
    for i in range(BITS):
        place = F.shiftrightunsigned(_hash(value), 16 + 6 * i).bitwiseAND(F.lit(63)).cast("int")
        out = out.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), place))
    return out


def filter_words(values: DataFrame) -> DataFrame:
    """One row with the filter of ``values`` (one column): an array of WORDS words.

    Each task combines its own elements' bits before they are shuffled, and what meets in the end is WORDS numbers
    at most, so a table of any size gives a filter of this one size; a larger table lets more through.
    """
    column = F.col(values.columns[0])
    bits = values.where(column.isNotNull()).groupBy(_word(column).alias("word")).agg(F.bit_or(_mask(column)).alias("bits"))
    every = values.sparkSession.range(WORDS).select(F.col("id").cast("int").alias("word"))
    whole = every.join(bits, "word", "left").select(F.struct("word", F.coalesce("bits", F.lit(0).cast("long")).alias("bits")).alias("x"))
    return whole.agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["bits"]).alias("words"))


def might_hold(words: DataFrame, value: Column) -> Column:
    """Whether the filter (see ``filter_words``) lets a value through: always, if it is in the table; null never."""
    mask = _mask(value)
    return F.coalesce(F.get(words.scalar(), _word(value)).bitwiseAND(mask) == mask, F.lit(False)) & value.isNotNull()


def listed(rows: DataFrame, key: list[str], forms: str, table: DataFrame, flag: str) -> DataFrame:
    """``rows`` with ``flag``: whether one of the array ``forms`` is in ``table`` (one column); see ``listed_in``."""
    return listed_in(rows, key, {flag: (forms, table)})


def listed_in(rows: DataFrame, key: list[str], asked: dict[str, tuple[str, DataFrame]], home: list[str] | None = None, lone: Column | None = None) -> DataFrame:
    """``rows`` with a flag for each array of forms that is asked of a table (one column): whether one of them is in it.

    key: columns that tell the rows apart.  All tables are one table by number, so that rows meet it in one join, whatever
    they ask.  Of a row's forms only those that a filter lets through go there, and its other columns once, with its first
    form (if the filter stops that, with a key that nothing has, so that they don't meet in one task).  The table is
    joined, not sent around: Spark broadcasts it only below its own threshold.  Rows without forms have false.
    home: some of the key, by which the rows are dealt afterwards.  lone: rows for which it is false are
    wanted only if the last flag is true; those of which the filter says that it isn't are dropped at once, others may stay.
    """
    wanted, through, others = None, F.lit(False), [c for c in rows.columns if c not in key]
    for i, (forms, table) in enumerate(asked.values()):
        names = table.toDF("form").where("form IS NOT NULL")
        words = filter_words(names)
        if lone is not None and i == len(asked) - 1:
            rows = rows.where(F.coalesce(lone, F.lit(False)) | (F.size(forms) > 1) | might_hold(words, F.get(forms, F.lit(0))))
        through = through | ((F.col("part") == i) & might_hold(words, F.col("form")))
        numbered = names.select(F.lit(i).alias("part"), "form")
        wanted = numbered if wanted is None else wanted.unionByName(numbered)
    numbered = lambda i: lambda x: F.struct(F.lit(i).alias("part"), x.alias("form"))
    tests = F.concat(*[F.transform(F.coalesce(F.col(forms), F.array().cast("array<string>")), numbered(i)) for i, (forms, _) in enumerate(asked.values())])
    each = rows.select("*", F.posexplode_outer(tests).alias("nth", "test"))
    each = each.select(*rows.columns, F.coalesce("nth", F.lit(0)).alias("nth"), F.coalesce("test.part", F.lit(0)).alias("part"), F.col("test.form").alias("form"))
    each = each.withColumn("through", through).where("through OR nth = 0")
    once = [F.when(F.col("nth") == 0, F.col(c)).alias(c) for c in others]
    form = F.when(F.col("through"), F.col("form")).otherwise(F.concat(F.lit("\x00"), F.xxhash64(*key).cast("string")))
    joined = each.select(*key, *once, "nth", "part", form.alias("form")).join(wanted.distinct().withColumn("is_listed", F.lit(True)), ["part", "form"], "left")
    if home:
        joined = joined.repartition(*home)
    own = Window.partitionBy(*key)
    flags = {flag: F.coalesce(F.max(F.when(F.col("part") == i, F.col("is_listed"))).over(own), F.lit(False)) for i, flag in enumerate(asked)}
    return joined.select(*key, *others, "nth", *[f.alias(flag) for flag, f in flags.items()]).where("nth = 0").drop("nth")
