"""Documents as lines, with what is known about their surroundings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilstone.functions.documents import about, known
from veilstone.functions.text import CLOSE, OPEN, cells_sql, count_sql, let_sql, quoted, running_sql, sql_text

# Fixed values of tables: separators by rank, least fields and letter cells, longest header cell, rows looked at, share that fits.
DELIMITERS, FIELDS, LETTERS, HEADER, ROWS, FITS = ["\t", ",", ";", "|"], 3, 2, 64, 20, 0.8


def table_sql(rows: str) -> str:
    """SQL for (delimiter, headers, header_line from 1) of a document's lines, or null if they are no table.

    The first line that is neither blank nor a comment heads the table if it has at least three short
    fields, two of them with letters, and most of the next twenty lines have as many.
    """
    blank, trim = sql_text(r"^\s*(?:$|#|//|;)"), sql_text(r'^[\s"]+|[\s"]+$')
    outside = lambda x: f"regexp_replace({x}, {sql_text(chr(34) + '[^' + chr(34) + ']*' + chr(34))}, '')"
    odd = lambda x: f"{count_sql(x, chr(34))} % 2 = 1"
    width = f"size(split({outside('r')}, concat({sql_text(chr(92) + 'Q')}, dl, {sql_text(chr(92) + 'E')}), -1))"
    heads = lambda of: f"get(filter(transform({of}, (r, n) -> named_struct('line', r, 'no', n + 1)), h -> NOT h.line RLIKE {blank}), 0)"
    # the first lines have the header nearly always; the others are looked at only if they don't
    first = f"coalesce({heads(f'slice({rows}, 1, 20)')}, {heads(rows)})"
    delimiter = "CASE " + " ".join(f"WHEN ms[{i}] = array_max(ms) THEN {sql_text(d)}" for i, d in enumerate(DELIMITERS)) + " END"
    counts = let_sql(outside("hd.line"), "ol", "array(" + ", ".join(count_sql("ol", d) for d in DELIMITERS) + ")")
    clean = f"transform(fs, f -> lower(regexp_replace(f, {trim}, '')))"
    below = f"slice(filter(slice({rows}, hd.no + 1, {ROWS * 2}), r -> trim(r) <> ''), 1, {ROWS})"
    good = (
        f"size(bl) > 0 AND size(fs) >= {FIELDS} AND NOT exists(bl, r -> {odd('r')}) AND size(filter(bl, r -> {width} = size(fs))) >= {FITS} * size(bl) "
        f"AND NOT exists(hs, f -> octet_length(f) > {HEADER}) AND size(filter(hs, f -> f RLIKE '[a-z]')) >= {LETTERS}"
    )
    made = let_sql(below, "bl", f"CASE WHEN {good} THEN named_struct('delimiter', dl, 'headers', hs, 'header_line', hd.no) END")
    made = let_sql(delimiter, "dl", let_sql(cells_sql("hd.line", "dl"), "fs", let_sql(clean, "hs", made)))
    judged = let_sql(counts, "ms", f"CASE WHEN array_max(ms) >= {FIELDS - 1} AND NOT {odd('hd.line')} THEN {made} END")
    return let_sql(first, "hd", f"CASE WHEN hd IS NOT NULL THEN {judged} END")


def text_key(text_col: str) -> Column:
    """A hash of the text: with the id it tells the rows of a table apart, where ids are null or repeat."""
    return F.xxhash64(F.coalesce(F.col(quoted(text_col)), F.lit("")))


def lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", name_col: str | None = None, only: Callable[[str], str] | None = None,
    around: Callable[[str], str] | None = lambda x: "true",
) -> DataFrame:
    """Each line of each document: doc_id, doc_key (see ``text_key``), line_number from 1, line, lower, offset (characters
    before it), the lines around it whole, the document's table, and what is known about the document.

    A null text is one empty line.  only: SQL for the texts that are wanted, given a text's SQL: other lines are left out,
    and other documents before anything is computed of them.  around: likewise for the lines whose
    neighbours are wanted; the others, and all with None, have empty ones.
    """
    if only is not None:
        docs = docs.where(only(quoted(text_col)))
    text = F.translate(F.coalesce(F.col(quoted(text_col)), F.lit("")), OPEN + CLOSE, "  ")
    cut = docs.select(
        F.col(quoted(id_col)).alias("doc_id"), text_key(text_col).alias("doc_key"), F.split(text, "\n", -1).alias("rows"), known(text_col, name_col).alias("known"), about(text_col).alias("about")
    )
    near = lambda i, has: "''" if around is None else f"IF(nb AND {has}, coalesce(get(rows, {i}), ''), '')"
    fields = f"'line_number', i + 1, 'line', x, 'offset', get(offsets, i), 'above', {near('i - 1', 'i >= 1')}, 'above2', {near('i - 2', 'i >= 2')}, 'below', {near('i + 1', 'true')}, 'below2', {near('i + 2', 'true')}"
    one = f"named_struct({fields})" if around is None else let_sql(around("x"), "nb", f"named_struct({fields})")
    each = f"transform(rows, (x, i) -> {one})" if only is None else f"array_compact(transform(rows, (x, i) -> IF({only("x")}, {one}, NULL)))"
    each = let_sql(running_sql("transform(rows, x -> char_length(x) + 1)"), "offsets", each)
    made = cut.select("doc_id", "doc_key", "known.*", "about", F.expr(table_sql("rows")).alias("table"), F.expr(f"{'inline_outer' if only is None else 'inline'}({each})"))
    return made.withColumn("lower", F.lower("line"))
