"""Mixing sources to target weights by systematic sampling (DataFrame operations only).

Each document of a source is expected ``target / source size`` times.  The documents of a source
stand in order of size; the prefix sum of the expected copies, plus one random offset of the source,
crosses an integer once for each copy.  As the order is by size, short and long documents are taken
in proportion and the words taken come near the target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilstone.llm.store import columns, free_name, global_rank, quoted, written

#: Fixed values of the contract: weights by order of source, share of all sizes, most copies of a source.
WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2.0


def word_count(text: Column) -> Column:
    """Number of runs of characters other than ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long"), F.lit(0).cast("long"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size) -> the same with target.

    Weights go round by code point of the source, null last.  Targets share ``share`` times all sizes
    by weight, stop at ``most`` times the source's size, and what is over is shared again by weight:
    with sources in order of cap / weight, all from the first that stays below its cap on get one
    level times their weight, the others their cap.  The levels are prefix sums over one row a source,
    in one task: sources are names of collections, not of pages.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_cap = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before, rest = by_cap.rowsBetween(Window.unboundedPreceding, -1), by_cap.rowsBetween(0, Window.unboundedFollowing)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    level = (F.lit(share) * F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(rest)
    s = sizes.withColumns({"w": w, "cap": F.lit(most) * F.col("source_size")}).withColumn("level", level)
    fits = F.min(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct(F.col("cap") / F.col("w"), F.col("source").isNull(), F.col("source"), F.col("level")))).over(Window.partitionBy())
    return s.withColumn("fits", fits["level"]).select("source", "source_size", F.least("cap", F.coalesce(F.col("w") * F.col("fits"), F.col("cap"))).alias("target"))


def offset(source: Column, seed: str) -> Column:
    """A number in [0, 1) with 20 bits that depends on the seed and the source alone."""
    hexed = F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(source, F.lit("")))), 1, 5)
    return F.conv(hexed, 16, 10).cast("double") / (1 << 20)


def _text_key(docs: DataFrame, text_col: str) -> Column:
    return F.xxhash64(F.lit("row"), *([F.col(quoted(text_col))] if text_col in docs.columns else []))


def planned(docs: DataFrame, size: Column | None = None, seed: str = "mix", id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **shares) -> DataFrame:
    """(id, source, tie, size, source_size, target, copies), one row for each of ``docs``; tie is a hash of the text.

    size: by default the words of the text.  The texts are read once, for this; nothing else of them
    travels or is stored.  Nulls, ties and empty tables are as in ``mix``.
    """
    size = word_count(F.col(quoted(text_col))) if size is None else size
    keys = docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(source_col)).alias("source"), _text_key(docs, text_col).alias("tie"), size.alias("size"))
    ranked = global_rank(written(keys, "mix-sizes"), [F.col("size"), F.col("id"), F.col("tie")], "rank_no", "source", "mix-ranked")
    plan = written(targets(ranked.groupBy("source").agg(F.sum("size").alias("source_size")), **shares), "mix-targets").withColumnRenamed("source", "plan_source")
    joined = ranked.join(plan, ranked["source"].eqNullSafe(plan["plan_source"]))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    u = offset(F.col("source"), seed)
    copies = F.floor(F.col("rank_no") * rate + u) - F.floor((F.col("rank_no") - 1) * rate + u)
    return joined.withColumn("copies", copies.cast("long")).drop("rank_no", "plan_source")


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", names: tuple[str, ...] = ("size", "source_size", "target", "copies"), **options) -> DataFrame:
    """``docs`` with size, source_size, target and copies (0, 1 or 2 with the defaults), under ``names``.

    Empty and null texts have size 0: a source of such texts alone has target 0 and no copies.  Null is
    a source of its own.  Columns of ``docs`` named like the new ones are replaced.  Reruns give the
    same copies; ties are broken by id, then by text; rows that repeat source, id and text share their
    copies evenly.  Long texts are counted whole.  No rows in, no rows out.

    Copies are found on (id, source, size) alone and come back to the rows in a join by hashes of id,
    source and text, in which alone texts travel.
    """
    done = planned(docs, id_col=id_col, source_col=source_col, text_col=text_col, **options)
    a, b, c, n, rows, total = free_name(docs, "id_key", "text_key", "source_key", "row_no", "rows_no", "all_copies")
    same = done.groupBy(F.xxhash64("id").alias(a), F.col("tie").alias(b), F.xxhash64("source").alias(c)).agg(
        F.count(F.lit(1)).alias(rows), F.sum("copies").alias(total), *[F.min(x).alias(y) for x, y in zip(("size", "source_size", "target"), names[:3], strict=True)]
    )
    keys = {a: F.xxhash64(F.col(quoted(id_col))), b: _text_key(docs, text_col), c: F.xxhash64(F.col(quoted(source_col)))}
    kept = docs.withColumns(keys).select(*columns(docs, [x for x in docs.columns if x not in names]), a, b, c).join(same, [a, b, c])
    nth = F.row_number().over(Window.partitionBy(a, b, c).orderBy(a))
    share = lambda i: F.floor(F.col(total) * i / F.col(rows))
    return kept.withColumn(n, nth).withColumn(names[3], (share(F.col(n)) - share(F.col(n) - 1)).cast("long")).drop(a, b, c, n, rows, total)


def repeated(mixed: DataFrame, names: list[str], copies: str = "copies") -> DataFrame:
    """The columns ``names``, a row for each copy; rows without copies go."""
    each = free_name(mixed, "copy_no")[0]
    return mixed.where(F.col(quoted(copies)) > 0).withColumn(each, F.explode(F.sequence(F.lit(1), F.col(quoted(copies)).cast("int")))).select(*columns(mixed, names))


def mixture(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, all their columns and no others, each as often as the mix takes it."""
    names = tuple(free_name(docs, "size", "source_size", "target", "copies"))
    return repeated(mix(docs, names=names, **options), docs.columns, names[3])
