"""SimHash near-duplicates by tiled exact comparison.

Distinct fingerprints fall into tiles by the population counts of their eight bytes.  Two
fingerprints that differ in r bits have population counts that differ by r in sum at most, so a tile
is compared, by exclusive-or and bit counts in numpy, with itself and the tiles within that radius
only; all other pairs of tiles are skipped.  Each comparison is exact and none is left out, however
large a tile is: large tiles are cut into blocks, which are tasks of their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from veilstone.llm.components import components

from veilstone.llm.store import batches as arrow_batches
from veilstone.llm.store import columns, free_name, mapped, partitions, quoted, small_batches, with_fields, written

#: Words in a shingle, seed of its hash, and bits in which linked fingerprints may differ.
SHINGLE, SEED, RADIUS = 3, 42, 2
#: Most elements of a block of comparisons, and shingles that are counted at once; own fingerprints of a task's block.
BLOCK, AT_ONCE, OWN = 1 << 21, 1 << 15, 4096


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64 bits that are set in over half of the hashes of a text's shingles; 0 without words.

    Words are separated by ASCII white space and have A-Z in lower case; a text with fewer words than
    a shingle has is one shingle.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    counts, n = np.zeros(64, dtype=np.int64), len(words) - k + 1
    s, e = starts[:n].tolist(), ends[k - 1 :].tolist()
    for i in range(0, n, AT_ONCE):
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(s[i : i + AT_ONCE], e[i : i + AT_ONCE], strict=True)], dtype="<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def with_fingerprint(docs: DataFrame, name: str, text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """``docs``, with or without its text, with the fingerprint as a signed LONG."""
    small_batches(docs.sparkSession)
    kept = [f for f in docs.schema if keep_text or f.name != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = np.array([fingerprint(t) for t in b.column(text_col).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in kept), pa.array(h)], [*(f.name for f in kept), name])

    return mapped(docs, run, with_fields(kept, **{name: LongType()}))


def steps(radius: int = RADIUS, lanes: int = 8) -> list[int]:
    """Differences of packed population counts within the radius; of each and its opposite, one."""
    found = {0}
    for r in range(1, radius + 1):
        for where in combinations(range(lanes), min(r, lanes)):
            for by in product(range(-radius, radius + 1), repeat=len(where)):
                if sum(map(abs, by)) <= radius:
                    found.add(sum(d << (4 * i) for i, d in zip(where, by, strict=True)))
    return sorted(x for x in found if x >= 0)


class _Tree:
    """A block's own fingerprints, joined into trees as links are found."""

    def __init__(self, own: np.ndarray, radius: int):
        self.own, self.radius = own, radius
        self.of = np.arange(len(own))

    def among(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Links among the block's own: breadth first, each compared with those not reached yet."""
        if len(self.own) < 2:
            return
        left = np.ones(len(self.own), dtype=bool)
        for root in range(len(self.own)):
            if not left[root]:
                continue
            left[root] = False
            queue = [root]
            while queue:
                i = queue.pop()
                rest = np.flatnonzero(left)
                hit = rest[np.bitwise_count(self.own[rest] ^ self.own[i]) <= self.radius]
                if len(hit):
                    left[hit] = False
                    self.of[hit] = root
                    queue.extend(hit.tolist())
                    yield np.full(len(hit), self.own[i]), self.own[hit]

    def with_guests(self, guests: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each guest a link to each tree that it is near to."""
        step = max(1, BLOCK // max(1, len(self.own)))
        for k in range(0, len(guests), step):
            part = guests[k : k + step]
            g, o = np.nonzero(np.bitwise_count(part[:, None] ^ self.own[None, :]) <= self.radius)
            if len(g):
                _, first = np.unique(np.stack([g, self.of[o]]), axis=1, return_index=True)
                yield part[g[first]], self.own[o[first]]


def links(prints: DataFrame, radius: int = RADIUS, own: int = OWN) -> DataFrame:
    """(fp LONG), distinct -> the written table of (src, dst): links that connect all pairs within ``radius`` bits.

    A tile of more than ``own`` fingerprints is cut into blocks of about so many by a hash.  A block is
    compared with itself, with the earlier blocks' rows of its tile, and with the rows of near tiles,
    which come as guests in any order; a task holds one block and one batch of guests.
    """
    tile = sum((F.bit_count(F.shiftrightunsigned("fp", 8 * i).bitwiseAND(F.lit(255))).cast("long") * F.lit(1 << (4 * i)) for i in range(8)), F.lit(0).cast("long"))
    tiled = prints.select("fp", tile.alias("own"))
    large = written(tiled.groupBy(F.col("own").alias("tile")).agg(F.ceil(F.count(F.lit(1)) / own).cast("int").alias("n_blocks")).where("n_blocks > 1"), "simhash-tiles")
    near = F.explode(F.array(*[F.lit(x).cast("long") for x in steps(radius)]))
    dealt = tiled.select("fp", "own", near.alias("step")).select("fp", (F.col("own") + F.col("step")).alias("tile"), (F.col("step") != 0).alias("guest"))
    dealt = dealt.join(large, "tile", "left").withColumn("n_blocks", F.coalesce("n_blocks", F.lit(1)))
    home = F.pmod(F.xxhash64("fp"), F.col("n_blocks")).cast("int")
    last = F.when(F.col("guest"), F.col("n_blocks") - 1).otherwise(home)
    dealt = dealt.select("fp", "tile", "guest", home.alias("home"), F.explode(F.sequence(F.lit(0), last)).alias("block"))
    dealt = dealt.select("fp", "tile", "block", (F.col("guest") | (F.col("block") != F.col("home"))).alias("guest"))
    dealt = dealt.repartition(partitions(prints.sparkSession), "tile", "block").sortWithinPartitions("tile", "block", "guest")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        src: list[np.ndarray] = []
        dst: list[np.ndarray] = []
        now, parts, tree = None, [], None

        def out() -> pa.RecordBatch:
            b = pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) if x else pa.array([], pa.int64()) for x in (src, dst)], ["src", "dst"])
            src.clear()
            dst.clear()
            return b

        def take(found: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
            for a, b in found:
                src.append(a)
                dst.append(b)
                if len(src) > 4096:
                    yield out()

        def settle() -> Iterator[pa.RecordBatch]:
            """The own rows of the block are complete."""
            nonlocal tree, parts
            tree, parts = _Tree(np.concatenate(parts) if parts else np.empty(0, dtype=np.uint64), radius), []
            yield from take(tree.among())

        for b in batches:
            keys = b.column("tile").to_numpy() * 4096 * 4096 + b.column("block").to_numpy()
            fp = b.column("fp").to_numpy().view(np.uint64)
            g = b.column("guest").to_numpy(zero_copy_only=False)
            cuts = np.concatenate([[0], np.flatnonzero((keys[1:] != keys[:-1]) | (g[1:] != g[:-1])) + 1, [len(keys)]])
            for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if i == j:
                    continue
                if keys[i] != now:
                    if tree is None:
                        yield from settle()
                    now, parts, tree = keys[i], [], None
                if g[i]:
                    if tree is None:
                        yield from settle()
                    if len(tree.own):
                        yield from take(tree.with_guests(fp[i:j]))
                else:
                    parts.append(fp[i:j])
        if tree is None:
            yield from settle()
        yield out()

    with arrow_batches(prints.sparkSession, 1 << 14):
        return written(dealt.mapInArrow(compare, "src LONG, dst LONG"), "simhash-links")


def near_duplicates(prints: DataFrame, fp: str, id_col: str = "doc_id", radius: int = RADIUS) -> tuple[DataFrame, DataFrame]:
    """(classes, groups) of rows with an id and a fingerprint.

    classes: (fp, component) for each distinct fingerprint; groups: (component, component_id, stay_fp):
    the smallest id in the component (null only if it has none) and a fingerprint that has it.
    Equal fingerprints are one node, so copies are never paired.
    """
    nodes = written(prints.groupBy(F.col(fp).alias("fp")).agg(F.min(id_col).alias("least_id")), "fingerprints")
    found = components(links(nodes.select("fp"), radius))
    classes = written(
        nodes.join(found, nodes["fp"] == found["node"], "left").select("fp", "least_id", F.coalesce("component", "fp").alias("component")), "simhash-classes"
    )
    groups = classes.groupBy("component").agg(F.min("least_id").alias("component_id"), F.coalesce(F.min_by("fp", "least_id"), F.min("fp")).alias("stay_fp"))
    return classes.select("fp", "component"), written(groups, "simhash-groups")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """(id, fp LONG, component_id) for each row of ``docs``.

    component_id is the smallest id that links reach.  Null and empty texts have fingerprint 0 and are
    linked like any other; null ids are never the smallest, but rows with them have a component;
    rows that repeat an id are all returned; other columns aren't read.  Texts are read whole, counted
    by the thousand shingles.  No rows in, no rows out.
    """
    prints = written(with_fingerprint(docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).alias("text")), "fp"), "simhash-prints")
    classes, groups = near_duplicates(prints, "fp", "id", radius)
    of = written(classes.join(groups, "component").select("fp", "component_id"), "simhash-of")
    return prints.join(of, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` that stay: of each component the one with the smallest id, and one only.

    Fingerprints are computed once for the groups and once for the final join, so that texts travel
    once and aren't stored in between.  Nulls, long texts and repeats are as in ``simhash_groups``; all
    columns are kept, whatever their names and types.  No rows in, no rows out.
    """
    fp, key, n = free_name(docs, "simhash_fp", "id_key", "row_no")
    prints = written(with_fingerprint(docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).alias("text")), "fp"), "simhash-prints")
    _, groups = near_duplicates(prints, "fp", "id", radius)
    stay = groups.select(F.col("stay_fp").alias(fp), F.xxhash64("component_id").alias(key))
    first = Window.partitionBy(fp, key).orderBy(fp)
    rows = with_fingerprint(docs, fp, text_col, keep_text=True).withColumn(key, F.xxhash64(id_col))
    kept = rows.join(stay, [fp, key], "left_semi").withColumn(n, F.row_number().over(first)).where(F.col(n) == 1)
    return kept.select(*columns(docs))
