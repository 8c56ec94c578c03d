"""Line deduplication over levelled sorted runs of line hashes (DataFrame operations only).

A run is a Parquet folder of (h1, h2, n_docs) sorted by the 128-bit hash of a line's key.  Each batch
merge-anti-joins the keys that the runs already hold as frequent, counts the rest and adds its own
run to level 0; when a level has ``fan_out`` runs they are merged into one of the next level.  Lines
whose keys are found in ``min_docs`` documents or more over all runs are dropped.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilstone.llm.store import free_name, fresh_path, written

#: White space that is stripped, and the letters that are lower-cased.
SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lines_of(text: Column) -> Column:
    """The lines of a text; null and empty texts have one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """A line without outer ASCII white space, A-Z in lower case (plain ASCII lines take the fast way)."""
    bare = F.btrim(line, F.lit(SPACE))
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def _hashes(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("second"), key).alias("h2")]


class LineRuns:
    """The runs below ``path``: ``<path>/L<level>-<name>``, each complete once it has ``_SUCCESS``.

    A merge is announced in ``<path>/merges`` before it begins, with its inputs.  Once the merged run is
    complete its inputs count no more, whether they were deleted in time or not; until then it doesn't
    count itself.  So a stop at any point loses and doubles nothing.  The runs belong to one
    ``min_docs``: frequent keys aren't counted on, so reopening them with another is an error.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, min_docs: int = 10, fan_out: int = 4):
        self.spark, self.path, self.min_docs, self.fan_out = spark, path or fresh_path(spark, "line-runs"), min_docs, fan_out
        self._fs_path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._fs_path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._fs_path(f"{self.path}/merges"))
        if (was := self._get("settings.json")) is None:
            self._put("settings.json", {"min_docs": min_docs})
        elif was["min_docs"] != min_docs:
            raise ValueError(f"these runs were built with min_docs {was['min_docs']}")

    def _put(self, name: str, value: dict) -> None:
        """A small file, whole or not at all: written aside and renamed."""
        aside = self._fs_path(f"{self.path}/.{uuid.uuid4().hex}")
        out = self._fs.create(aside)
        out.write(bytearray(json.dumps(value).encode()))
        out.close()
        self._fs.rename(aside, self._fs_path(f"{self.path}/{name}"))

    def _get(self, name: str) -> dict | None:
        at = self._fs_path(f"{self.path}/{name}")
        if not self._fs.exists(at):
            return None
        rows = self.spark.read.text(f"{self.path}/{name}", wholetext=True).collect()
        return json.loads(rows[0][0])

    def _names(self, folder: str = "") -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._fs_path(f"{self.path}{folder}")))

    def _complete(self, run: str) -> bool:
        return self._fs.exists(self._fs_path(f"{self.path}/{run}/_SUCCESS"))

    def _merged(self) -> set[str]:
        """Runs whose rows a complete merged run holds."""
        inputs = {m.removesuffix(".json"): self._get(f"merges/{m}")["inputs"] for m in self._names("/merges")}
        done = {x for runs in inputs.values() for x in runs}  # what was merged on was complete once
        return {x for run, runs in inputs.items() if run in done or self._complete(run) for x in runs}

    def runs(self) -> dict[int, list[str]]:
        """Complete runs by level, from the folder itself."""
        gone, out = self._merged(), {}
        for name in self._names():
            if name.startswith("L") and name not in gone and self._complete(name):
                out.setdefault(int(name[1:].split("-")[0]), []).append(f"{self.path}/{name}")
        return dict(sorted(out.items()))

    def _read(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema("h1 BIGINT, h2 BIGINT, n_docs BIGINT").parquet(*paths)

    def _write(self, counts: DataFrame, run: str) -> None:
        counts.sortWithinPartitions("h1", "h2").write.mode("overwrite").parquet(f"{self.path}/{run}")

    def frequent(self) -> DataFrame:
        """Hashes of the keys in ``min_docs`` documents or more, over all runs."""
        paths = [p for v in self.runs().values() for p in v]
        if not paths:
            return self.spark.createDataFrame([], "h1 BIGINT, h2 BIGINT")
        rows = self._read(paths)
        if len(paths) > 1:
            rows = rows.groupBy("h1", "h2").agg(F.sum("n_docs").alias("n_docs"))
        return rows.where(F.col("n_docs") >= self.min_docs).select("h1", "h2")

    def add(self, docs: DataFrame, text_col: str = "text", batch: str | None = None) -> None:
        """Counts the documents of a batch that have each key, as a new run of level 0.

        Keys that are frequent already are left out by a merge-anti-join: their count can't matter more.
        A batch with a name is counted once, however often it is added.
        """
        run = f"L0-{batch or uuid.uuid4().hex}"
        if self._complete(run) or run in self._merged():
            return
        keys = docs.select(F.explode(F.array_distinct(F.transform(lines_of(F.col(text_col)), line_key))).alias("key")).where("key != ''")
        hashes = keys.select(*_hashes(F.col("key")))
        counts = hashes.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_docs"))
        if self.runs():
            # counted first, so that a key's many lines shrink to a row a task before they meet the runs
            counts = written(counts, "line-counts").join(written(self.frequent(), "line-frequent").hint("merge"), ["h1", "h2"], "left_anti")
        self._write(counts, run)
        self.compact()

    def compact(self) -> None:
        """Merges the runs of each full level into one of the next; the old ones go only afterwards."""
        level = 0
        while len(paths := self.runs().get(level, [])) >= self.fan_out:
            run, inputs = f"L{level + 1}-{uuid.uuid4().hex}", [p.rsplit("/", 1)[1] for p in paths]
            self._put(f"merges/{run}.json", {"inputs": inputs})
            self._write(self._read(paths).groupBy("h1", "h2").agg(F.sum("n_docs").alias("n_docs")), run)
            level += 1
        for name in self._merged() & set(self._names()):
            self._fs.delete(self._fs_path(f"{self.path}/{name}"), True)


def drop_lines(docs: DataFrame, runs: LineRuns, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs``, without the text, with n_lines, n_dropped and kept_text, by the keys that are frequent in ``runs``.

    Each line's (row, position, hash) meets the frequent keys in a join that can be split where a
    line is common; the positions that go come back to their row, and the other lines stay in their
    order.  A row is known by its id and a hash of its text, so null and repeated ids are fine; rows
    that repeat id and text get the same result each.  A null text is one empty line.  Columns of
    ``docs`` named like the new ones are replaced.  A text's lines are exploded in one task, which
    holds one line at a time; only its dropped positions (4 bytes each) and the text itself are held
    whole.  No rows in, no rows out.
    """
    text_hash, cut, lines, at = free_name(docs, "text_key", "cut_at", "line_list", "row_id")
    keyed = docs.withColumns({at: F.xxhash64(F.col(id_col)), text_hash: F.xxhash64(F.lit("row"), F.col(text_col))})
    each = keyed.select(at, text_hash, F.posexplode(lines_of(F.col(text_col))).alias("pos", "line")).select(at, text_hash, "pos", line_key(F.col("line")).alias("key"))
    each = each.where("key != ''").select(at, text_hash, "pos", *_hashes(F.col("key")))
    frequent = written(runs.frequent(), "line-frequent")
    goes = each.join(frequent, ["h1", "h2"], "left_semi").groupBy(at, text_hash).agg(F.collect_set("pos").alias(cut))
    joined = keyed.withColumn(lines, lines_of(F.col(text_col))).drop(text_col).join(goes, [at, text_hash], "left")
    size = F.size(lines)
    kept = F.transform(F.array_except(F.sequence(F.lit(0), size - 1), F.col(cut)), lambda i: F.get(F.col(lines), i))
    return joined.withColumns(
        {
            "n_lines": size.cast("long"),
            "n_dropped": F.coalesce(F.size(cut), F.lit(0)).cast("long"),
            "kept_text": F.array_join(F.when(F.col(cut).isNull(), F.col(lines)).otherwise(kept), "\n"),
        }
    ).drop(at, text_hash, cut, lines)
