"""Lines, candidate spans and keyword predicates: the column functions all detectors share.

What a detector asks of a whole line (words, tables, labels) is computed once for each line that its
pattern hits; what it asks of a value sees the value and up to ``NEAR`` characters beside it.  Offsets
come from prefix sums.  So the work on a line grows with its length plus its matches, not with their
product.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Marks put around matches; a line's own marks become spaces first, so that offsets stay.
OPEN, CLOSE = "\x01", "\x02"
#: Characters beside a value that a detector can see; bytes of them that tell findings apart, and bytes of a line that
#: a finding carries on.
NEAR, BESIDE, CARRIED = 64, 50, 8192
#: Characters of a value's window, and of a line's head and tail beside it: more than the longest word has.
WINDOW, EDGE = 50, 64
#: Elements of a group of a prefix sum.
GROUP = 64


def sql_text(s: str) -> str:
    """A string literal of SQL.

    Expressions of many parts are written as SQL text here: one call builds them, where columns take one
    for each part.
    """
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def quoted(name: str) -> str:
    """A column's name as SQL reads it, whatever marks it has."""
    return "`" + name.replace("`", "``") + "`"


def let_sql(value: str, name: str, body: str) -> str:
    """SQL of ``body``, in which ``name`` is a value that is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running_sql(sizes: str) -> str:
    """SQL for the sum of the elements before each element of an array of integers, by groups of their sums."""
    total = lambda a: f"aggregate({a}, 0, (p, q) -> p + q)"
    groups = f"transform(sequence(0, int(floor((size(sz) - 1) / {GROUP}))), g -> slice(sz, g * {GROUP} + 1, {GROUP}))"
    within = let_sql(total("slice(sums, 1, gi)"), "base", f"transform(g, (z, j) -> base + {total('slice(g, 1, j)')})")
    body = let_sql(groups, "gs", let_sql(f"transform(gs, g -> {total('g')})", "sums", f"flatten(transform(gs, (g, gi) -> {within}))"))
    few = f"transform(sz, (z, j) -> {total('slice(sz, 1, j)')})"
    return let_sql(sizes, "sz", f"CASE WHEN size(sz) = 0 THEN CAST(array() AS ARRAY<INT>) WHEN size(sz) <= {GROUP} THEN {few} ELSE {body} END")


# ---- tables -------------------------------------------------------------------------------------------------------


def count_sql(text: str, mark: str) -> str:
    return f"(char_length({text}) - char_length(replace({text}, {sql_text(mark)}, '')))"


def cells_sql(line: str, delimiter: str) -> str:
    """SQL for the fields of a line: separators inside quotes don't count."""
    marks, kept = sql_text("\t,;|"), sql_text("\x03\x04\x05\x06")
    outside = f"array_join(transform(split({line}, '\"', -1), (part, pn) -> CASE WHEN pn % 2 = 1 THEN translate(part, {marks}, {kept}) ELSE part END), '\"')"
    return f"transform(split({outside}, concat({sql_text(chr(92) + 'Q')}, {delimiter}, {sql_text(chr(92) + 'E')}), -1), cl -> translate(cl, {kept}, {marks}))"


# ---- candidates ---------------------------------------------------------------------------------------------------


SPAN = ["start", "start_col", "end_col", "text", "before", "after", "header"]
#: What a candidate keeps of its line: whose it is, where it lies, and what the document adds to a score.
PLACE = ["doc_id", "doc_key", "line_number", "offset", "doc_kind", "adjustment"]


def spans(pattern: str, line: str = "line", headers: str = "CAST(NULL AS ARRAY<STRING>)") -> Column:
    """An array of the matches of ``pattern`` in the column ``line``: start (characters from 0), start_col and end_col
    (bytes from 1, the end exclusive), text, before and after (up to NEAR characters each), and header.

    headers: SQL of an array with the header of each match.
    """
    return F.expr(spans_sql(marked_sql(pattern, line), headers))


def marked_sql(pattern: str, line: str = "line") -> str:
    """SQL for a line with marks around the matches of a pattern."""
    return f"regexp_replace({line}, {sql_text(f'({pattern})')}, {sql_text(f'{OPEN}$1{CLOSE}')})"


def spans_sql(marked: str, headers: str) -> str:
    """SQL for ``spans`` of a line with marks around its matches."""
    mark, close, n = sql_text(OPEN), sql_text(CLOSE), NEAR
    pieces = f"split({marked}, {mark}, -1)"
    # x is a piece that begins with a match; i counts them from 0, so that the piece is number i + 1
    before = f"right(array_join(slice(tails, greatest(1, i - 14), least(16, i + 1)), ''), {n})"
    after = f"left(concat(left(substring_index(x, {close}, -1), {n}), array_join(slice(heads, i + 3, 16), '')), {n})"
    one = (
        f"named_struct('start', get(chars, i + 1), 'start_col', get(octets, i + 1) + 1, 'end_col', get(octets, i + 1) + 1 + octet_length(substring_index(x, {close}, 1)), "
        f"'text', substring_index(x, {close}, 1), 'before', {before}, 'after', {after}, 'header', coalesce(get(names, i), ''))"
    )
    each = f"transform(slice(pieces, 2, greatest(size(pieces) - 1, 0)), (x, i) -> {one})"
    each = let_sql(headers, "names", let_sql(running_sql("transform(bare, b -> octet_length(b))"), "octets", let_sql(running_sql("transform(bare, b -> char_length(b))"), "chars", each)))
    each = let_sql(f"transform(bare, b -> left(b, {n}))", "heads", let_sql(f"transform(bare, b -> right(b, {n}))", "tails", each))
    each = let_sql(f"transform(pieces, b -> replace(b, {close}, ''))", "bare", each)
    # most lines have one match, which needs no sums
    lone = (
        f"named_struct('start', char_length(pieces[0]), 'start_col', octet_length(pieces[0]) + 1, 'end_col', octet_length(pieces[0]) + 1 + octet_length(substring_index(pieces[1], {close}, 1)), "
        f"'text', substring_index(pieces[1], {close}, 1), 'before', right(pieces[0], {n}), 'after', left(substring_index(pieces[1], {close}, -1), {n}), 'header', coalesce(get({headers}, 0), ''))"
    )
    return let_sql(pieces, "pieces", f"IF(size(pieces) = 2, array({lone}), {each})")


def candidates(lines_df: DataFrame, pattern: str | list[tuple[str, Column | None]], only: Column | None = None, headers: bool = False, **features: Column) -> DataFrame:
    """A row for each match of ``pattern`` (the value alone; borders by look-around) in the lines that ``only`` lets
    through: PLACE, the features (computed once for each line that is hit), the line's first bytes as line, line_key
    (equal for the matches of one line of one row, and only there), and what ``spans`` tells.

    pattern: or several, each with the lines that it is for; their matches, which may overlap, come one pattern after
    the other, with its number from 0 as way.  headers: whether a table's headers are looked up.
    """
    carried = F.when(F.octet_length("line") > CARRIED, F.substring(F.col("line").cast("binary"), 1, CARRIED).cast("string")).otherwise(F.col("line"))
    # streams have no numbers of rows: there rows that repeat id and text share their lines' keys
    number = F.xxhash64("doc_id", "doc_key", "line_number") if lines_df.isStreaming else F.monotonically_increasing_id()
    kept = [F.col(c) for c in PLACE]
    if isinstance(pattern, str):
        hit = F.col("line").rlike(pattern)
        rows, shown = lines_df.where(hit if only is None else only & hit).withColumn("line_key", number), SPAN
        found = spans(pattern, headers=headers_of(pattern)) if headers else spans(pattern)
    else:
        # each pattern is tried once, and the spans of all are cut by one expression; beside the number, as no filter is
        # pulled down below that and tries them once more
        names = "CAST(NULL AS ARRAY<STRING>)"
        tried = [F.struct(F.lit(i).alias("way"), F.expr(marked_sql(p)).alias("marked"), F.expr(headers_of(p) if headers else names).alias("names")) for i, (p, _) in enumerate(pattern)]
        hits = [F.col("line").rlike(p) if o is None else o & F.col("line").rlike(p) for p, o in pattern]
        rows = lines_df.select("*", number.alias("line_key"), F.array(*[F.when(h, m) for h, m in zip(hits, tried, strict=True)]).alias("tried")).where("exists(tried, m -> m IS NOT NULL)")
        shown = [*SPAN, "way"]
        one = "named_struct(" + ", ".join(f"'{c}', s.{c}" for c in SPAN) + ", 'way', m.way)"
        found = F.expr(f"flatten(transform(filter(tried, m -> m IS NOT NULL), m -> transform({spans_sql('m.marked', 'm.names')}, s -> {one})))")
    # the outer form, as Spark filters by the array of the plain one first and so computes it twice; no array is empty
    if features:
        # in the generator, so that no filter above pulls them down to be computed once more
        whole, asked = found, F.struct(*[v.alias(k) for k, v in features.items()])
        found = let(asked, lambda f: F.transform(whole, lambda x: F.struct(*[x[c].alias(c) for c in shown], *[f[k].alias(k) for k in features])))
    rows = rows.select(*kept, carried.alias("carried"), "line_key", found.alias("found"))
    return rows.select(*kept, "line_key", F.col("carried").alias("line"), F.inline_outer("found"))


# ---- words --------------------------------------------------------------------------------------------------------


def word_pattern(words: list[str], gap: str = r"[ \t_-]+") -> str:
    """A pattern for any of some words, not inside a run of letters or digits; spaces may be several marks."""
    alts = "|".join(gap.join(re.escape(p) for p in w.lower().split(" ")) for w in words)
    return f"(?<![a-z0-9])(?:{alts})(?![a-z0-9])"


#: The gap of labels: "member id" is "memberid" too.
LABEL_GAP = r"[ \t_-]*"


def has_word(words: list[str], column: str = "lower", gap: str = r"[ \t_-]+") -> Column:
    """Whether the lower-cased text has one of the words."""
    return F.col(column).rlike(word_pattern(words, gap))


def if_any(words: list[str], text: str, each: str, none: str, gap: str = r"[ \t_-]+") -> str:
    """SQL of ``each``, which tries the words one by one, for the texts in which one pattern finds any of them; else ``none``.

    Most texts have none of the words, and so cost one pattern instead of one for each word.
    """
    return f"IF({text} RLIKE {sql_text(word_pattern(words, gap))}, {each}, {none})" if len(words) > 1 else each


def count_words(words: list[str], column: str = "lower", gap: str = r"[ \t_-]+") -> Column:
    """How many of the words the lower-cased text has.

    Words of letters and digits alone can't overlap, so one pattern finds all of them; each of the others
    is looked for by itself.
    """
    plain = [w for w in words if re.fullmatch("[a-z0-9]+", w)]
    found = f"size(array_distinct(regexp_extract_all(`{column}`, {sql_text(word_pattern(plain))}, 0)))" if plain else "0"
    others = [w for w in words if w not in plain]
    each = " + ".join(f"IF(`{column}` RLIKE {sql_text(word_pattern([w], gap))}, 1, 0)" for w in others)
    return F.expr(f"{found} + {if_any(others, f'`{column}`', each, '0', gap)}" if others else found)


def words_in(words: list[str], column: str = "lower", gap: str = r"[ \t_-]+") -> Column:
    """Those of the words that the lower-cased text has, as an array."""
    plain = [w for w in words if re.fullmatch("[a-z0-9]+", w)]
    found = f"array_distinct(regexp_extract_all({column}, {sql_text(word_pattern(plain))}, 0))" if plain else "CAST(array() AS ARRAY<STRING>)"
    others = [w for w in words if w not in plain]
    each = f"array_compact(array({', '.join(f'IF({column} RLIKE {sql_text(word_pattern([w], gap))}, {sql_text(w)}, NULL)' for w in others)}))"
    return F.expr(f"concat({found}, {if_any(others, column, each, 'CAST(array() AS ARRAY<STRING>)', gap)})" if others else found)


def line_ends() -> dict[str, Column]:
    """What ``seam`` needs of a line, as features of candidates: its head and tail, with a mark where they are cut."""
    cut = F.char_length("lower") > EDGE
    mark = F.when(cut, "0").otherwise("")
    return {"head": F.concat(F.left("lower", F.lit(EDGE)), mark), "tail": F.concat(mark, F.right("lower", F.lit(EDGE)))}


def seam() -> Column:
    """The text in which words count as beside a value: what stands before it and then the line's head, the line's
    tail and then what stands after the value.

    The window around the value may cut a word, and a word of several parts may go across where two pieces meet.
    Pieces are short, so it costs the same in a line of any length.
    """
    before, after = F.lower(F.right("before", F.lit(WINDOW))), F.lower(F.left("after", F.lit(WINDOW)))
    return F.concat(before, F.lit(" "), F.col("head"), F.lit("\x07"), F.col("tail"), F.lit(" "), after)


def beside(words: list[str], on_line: str, column: str = "seam") -> Column:
    """How many of the words the seam has that the line (an array of its words) hasn't."""
    return F.size(F.array_except(words_in(words, column), F.col(on_line)))


def words_score(words: list[str], each: float, column: str = "lower", gap: str = r"[ \t_-]+") -> Column:
    """``each`` for every one of the words that the lower-cased text has; one SQL text, as the lists are long."""
    return count_words(words, column, gap) * F.lit(each)


def any_of(column: Column, parts: list[str], how: str) -> Column:
    """Whether a text contains, or ends with, one of some parts."""
    end = "$" if how == "endswith" else ""
    return column.rlike(f"(?:{'|'.join(map(re.escape, parts))}){end}")


def parts_score(column: str, parts: list[str], each: float) -> Column:
    """``each`` for every one of the parts that a text contains, as a word or not."""
    return F.expr(" + ".join(f"IF(contains({column}, {sql_text(p)}), {each}D, 0D)" for p in parts))


def either_score(first: str, second: str, weights: dict[str, tuple[float, float]]) -> Column:
    """For each part the first amount if the first text contains it, else the second if the second does."""
    return F.expr(" + ".join(f"CASE WHEN contains({first}, {sql_text(p)}) THEN {a}D WHEN contains({second}, {sql_text(p)}) THEN {b}D ELSE 0D END" for p, (a, b) in weights.items()))


# Words that a label may have beside its own, and its longest length.
LABEL_WORDS = [
    "field", "value", "number", "no", "num", "id", "identifier", "identification", "code", "primary", "secondary", "optional", "required", "of", "or", "and", "the",
    "a", "an", "details", "detail", "info", "information", "type", "name", "date", "issued", "expiry", "state", "country", "region", "status",
]
LABEL_LENGTH = 48


def field_label(line: Column, words: list[str]) -> Column:
    """Whether a line is only the label of a field: one of the words is in it, and nothing but their parts and general
    ones; no end of a sentence, no four digits in a row."""
    own = sorted({p for w in words for p in re.split(r"[^a-z0-9']+", w.lower()) if p} | {re.sub(r"[^a-z0-9']+", "", w.lower()) for w in words} | set(LABEL_WORDS))
    bare = F.lower(F.trim(line))
    named = bare.rlike(word_pattern(words, LABEL_GAP))
    others = F.regexp_replace(bare, f"(?<![a-z0-9'])(?:{'|'.join(map(re.escape, own))})(?![a-z0-9'])", "")
    return (F.octet_length(bare) <= LABEL_LENGTH) & ~bare.rlike(r"[.!?]$") & named & ~others.rlike("[a-z][a-z']*(?![a-z0-9'])") & ~bare.rlike(r"\d{4}")


def headers_of(pattern: str) -> str:
    """SQL, for a table's row below the header, of the header of the column of each match of ``pattern``; else null.

    Matches become marks, the line's fields are cut outside quotes, and a field's marks get its header.
    """
    marked = f"regexp_replace(regexp_replace(line, {sql_text(pattern)}, {sql_text(CLOSE)}), {sql_text(f'[^{CLOSE}{chr(92)}t,;|' + chr(34) + ']')}, '')"
    each = f"flatten(transform({cells_sql(marked, 'table.delimiter')}, (f, fn) -> array_repeat(coalesce(get(table.headers, fn), ''), {count_sql('f', CLOSE)})))"
    return f"CASE WHEN table IS NOT NULL AND line_number <> table.header_line THEN {each} END"


# ---- shapes of lines ----------------------------------------------------------------------------------------------


def tabular_line(name_value: str) -> Column:
    """Whether the line looks like a row of a table: separators, gaps, or a name before a value."""
    marks = " OR ".join(f"{count_sql('line', m)} >= 2" for m in ",;|")
    return F.expr(rf"contains(line, {sql_text(chr(9))}) OR {marks} OR regexp_count(line, {sql_text(chr(92) + 's{2,}')}) >= 2 OR line RLIKE {sql_text(name_value)}")


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def band(confidence: Column) -> Column:
    """HIGH from 90, MEDIUM from 60, else LOW."""
    return F.when(confidence >= 90, "HIGH").when(confidence >= 60, "MEDIUM").otherwise("LOW")
