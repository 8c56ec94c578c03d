"""Social profiles that belong together, and their members again where they are redacted."""

from __future__ import annotations

import re
from collections import defaultdict, deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilstone.functions.text import clamp
from veilstone.operators.overlap import row_of

#: Lines between a seed and its members, letters of a name that may lie in another, and of a part that names share;
#: the least, the most and the step of a cluster's score.
CLUSTER_LINES, CONTAINED, SHARED = 6, 4, 3
CLUSTER_LEAST, CLUSTER_MOST, CLUSTER_STEP = 30.0, 95.0, 15.0
#: Seeds that a profile is compared with one by one; where more are near, they are looked up by their texts.
FEW = 8


def bare(user: str) -> str:
    """A user's name without dots, dashes and the digits at its end."""
    return re.sub(r"[._-]", "", user).rstrip("0123456789")


def parts(user: str) -> set[str]:
    """The runs of letters (SHARED at least) between signs and digits."""
    return {p for p in re.split(r"[._\-0-9]", user) if len(p) >= SHARED}


def related(seed: str, seed_platform: str, seed_near: str, user: str, platform: str, near: str, platforms: set[str]) -> bool:
    """Whether a profile belongs to a seed, given the user, platform and surroundings of each (see ``seeded``)."""
    if (platform in platforms and platform in seed_near) or (seed_platform in platforms and seed_platform in near):
        return True
    if not seed or not user:
        return False
    within = (CONTAINED <= len(user) and user in seed) or (CONTAINED <= len(seed) and seed in user)
    return within or seed == user or bare(seed) == bare(user) or not parts(seed).isdisjoint(parts(user))


class Seeds:
    """The seeds of the last lines; where they are many, by all that may relate a later profile to one of them.

    A seed stands under its name, its bare name, its parts, the inner texts of its name, its platform, and the platforms that
    its surroundings mention.  Asking costs as many look-ups as the profile has such texts, however many seeds there are.
    """

    def __init__(self, lines: int = CLUSTER_LINES):
        self.lines = lines
        self.at: dict[int, int] = {}
        self.by: dict[tuple[str, str], deque[int]] = defaultdict(deque)
        #: The latest seeds, at most FEW of them when a profile asks: they are compared one by one.
        self.waiting: list[tuple] = []

    @staticmethod
    def _inner(user: str) -> set[str]:
        return {user[i:j] for i in range(len(user)) for j in range(i + CONTAINED, len(user) + 1)}

    def _first(self, key: tuple[str, str], line: int) -> int | None:
        waiting = self.by.get(key)
        while waiting and line - self.at[waiting[0]] > self.lines:
            waiting.popleft()
        return waiting[0] if waiting else None

    def of(self, line: int, user: str, platform: str, near: str, platforms: set[str]) -> int | None:
        """The earliest seed that a profile belongs to."""
        self.waiting = [s for s in self.waiting if line - s[1] <= self.lines]
        if len(self.waiting) > FEW:
            for seed in self.waiting:
                self._index(*seed)
            self.waiting = []
        if self.at and (found := self._indexed(line, user, platform, near, platforms)) is not None:
            return found  # what is indexed came before what waits
        return next((n for n, _, *seed, _ in self.waiting if related(*seed, user, platform, near, platforms)), None)

    def _indexed(self, line: int, user: str, platform: str, near: str, platforms: set[str]) -> int | None:
        keys = [("mentions", platform)] + [("platform", p) for p in platforms if p and p in near]
        if user:
            keys += [("name", user), ("bare", bare(user)), *(("part", p) for p in parts(user))]
            if len(user) >= CONTAINED:
                keys += [("inner", user), *(("whole", x) for x in self._inner(user))]
        return min((n for k in keys if (n := self._first(k, line)) is not None), default=None)

    def add(self, number: int, line: int, user: str, platform: str, near: str, platforms: set[str]) -> None:
        self.waiting.append((number, line, user, platform, near, platforms))

    def _index(self, number: int, line: int, user: str, platform: str, near: str, platforms: set[str]) -> None:
        self.at[number] = line
        keys = [("platform", platform), *(("mentions", p) for p in platforms if p and p in near)]
        if user:
            keys += [("name", user), ("bare", bare(user)), *(("part", p) for p in parts(user))]
            if len(user) >= CONTAINED:
                keys += [("whole", user), *(("inner", x) for x in self._inner(user))]
        for k in dict.fromkeys(keys):
            self.by[k].append(number)


def user_of(text: Column) -> Column:
    """The user's name at the end of a profile's address, in lower case."""
    return F.lower(F.regexp_extract(text, r"([A-Za-z0-9_.-]+)/?$", 1))


def seeded(profiles: DataFrame, platforms: list[str], lines: int = CLUSTER_LINES) -> DataFrame:
    """``profiles`` (findings) with cluster: the number of the seed that each belongs to, from 0 in each document.

    In the order of their places, a profile joins the earliest seed at most ``lines`` lines above that it is related to, and
    is a seed itself if there is none: only seeds take members, so chains don't grow.  Two are related if their names
    are equal, equal without signs and final digits, one inside the other (CONTAINED letters at least), or share a part of SHARED
    letters, or if what stands beside one of them names the other's platform.  A document's profiles are
    folded as they stream by; what is kept are the seeds of the last few lines.
    """
    row = row_of(profiles)
    known = {p.lower() for p in platforms}
    near = F.lower(F.concat(F.right("before", F.lit(50)), F.lit(" "), F.left("after", F.lit(50))))
    asked = profiles.withColumns({"cluster_user": user_of(F.col("text")), "cluster_near": near, "cluster": F.lit(0).cast("long")})

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, seeds, n = None, Seeds(lines), 0
        for b in batches:
            out = []
            columns = [b.column(c).to_pylist() for c in (*row, "line_number", "cluster_user", "type", "cluster_near")]
            for *who, line, user, kind, beside in zip(*columns, strict=True):
                if who != at:
                    at, seeds, n = who, Seeds(lines), 0
                mine = (line, user or "", kind.lower(), beside or "", known)
                if (seed := seeds.of(*mine)) is None:
                    seed = n
                    seeds.add(n, *mine)
                    n += 1
                out.append(seed)
            yield b.set_column(b.schema.get_field_index("cluster"), "cluster", pa.array(out, pa.int64()))

    dealt = asked.repartition(*row).sortWithinPartitions(*row, "line_number", "start", "type")
    return dealt.mapInArrow(fold, asked.schema).drop("cluster_user", "cluster_near")


def profile_clusters(profiles: DataFrame, platforms: list[str] | None = None, lines: int = CLUSTER_LINES) -> DataFrame:
    """(doc_id, doc_key, cluster, line_number, last_line, members, platforms, confidence): groups of two profiles or more.

    platforms: the names whose mention beside a profile counts (none by default).  members: their places, texts and types,
    in their order.
    """
    row, told = row_of(profiles), ["line_number", "start", "length", "start_col", "end_col", "text", "type"]
    member = F.struct(*told)
    # the fold passes its rows on whole, so what clusters don't read is left out before it
    groups = seeded(profiles.select(*row, *told, "before", "after"), platforms or [], lines).groupBy(*row, "cluster").agg(
        F.min("line_number").alias("line_number"), F.max("line_number").alias("last_line"), F.array_sort(F.collect_list(member)).alias("members"), F.array_sort(F.collect_set("type")).alias("platforms")
    )
    return groups.where(F.size("members") > 1).withColumn("confidence", clamp(F.lit(CLUSTER_LEAST) + CLUSTER_STEP * F.size("platforms"), CLUSTER_LEAST, CLUSTER_MOST))


def expanded(findings: DataFrame) -> DataFrame:
    """Findings with members (an array as in ``profile_clusters``, or null) by their members; others as they are.

    Members without text can't be found in a document and are left out.
    """
    if "members" not in findings.columns:
        return findings
    fields = ["line_number", "start", "length", "start_col", "end_col", "text", "type"]
    own = F.when(F.col("members").isNull(), F.array(F.struct(*[F.col(c).alias(c) for c in fields])))
    each = own.otherwise(F.filter("members", lambda m: m["text"] != ""))
    others = [c for c in findings.columns if c not in (*fields, "members")]
    return findings.select(*others, F.inline(each))
