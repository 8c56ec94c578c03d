"""Near copies at a word-shingle similarity of 0.8 by long SimHash fingerprints, compared tile by tile.

At that similarity 64 bits differ in about ten, which is too near to unrelated texts, so a fingerprint
here has 512 bits.  The first 256 are compared: such pairs differ in 39 of them on average and in
``RADIUS`` at most (four standard deviations above).  All 512 make the tiles: texts that agree in some
sampled bits of the fingerprint share one.  ``bit_samples`` takes as many bits for a key that about
``TILE`` texts agree in them by chance, and as many keys that texts of similarity 0.8 share none with
a chance of ``MISSED``.  In a tile fingerprints meet by exclusive-or and bit counts in numpy, and what
lies within the radius is checked by the whole sets of shingles.

Pairs are checked in three passes: each text with its nearest one of a tile; with its nearest one in
another component; and at last all pairs within the radius that lie in different components still.
So a group of many copies is joined by about as many checks as it has members, and no pair that tiles
and radius find is left out.  The first pass deals all texts to all their tiles and tells in which of
them a text has another within the radius; the later ones deal these alone.  The last pass makes no
pairs: the texts that have some are sent, as sets of shingles, to the first tile of each, where a
text's set meets all others of the tile at once.  Tiles of more than ``OWN`` texts are cut into
blocks; in the last pass all but a tile's largest component go to each of its blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilstone.llm.components import components
from veilstone.llm.store import batches as arrow_batches
from veilstone.llm.store import columns, free_name, partitions, quoted, written

#: Words in a shingle, and the least similarity, as a fraction.
SHINGLE, ALIKE = 5, (4, 5)
#: 64-bit words of a fingerprint, those of them that are compared, and bits of these in which texts to check may differ.
WORDS, COMPARED, RADIUS = 8, 4, 62
#: Texts that share a tile by chance, at most; the chance that texts of similarity ALIKE share none; least bits of a key.
TILE, MISSED, LEAST = 512, 0.0007, 8
#: Texts of a block of a tile; most elements of a block of comparisons; shingles at once.
OWN, BLOCK, AT_ONCE = 4096, 1 << 20, 1 << 10
FACTORS = np.array([xxhash.xxh64_intdigest(str(i), 7) | 1 for i in range(64)], dtype=np.uint64)


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles; words as in ``simhash.fingerprint``, 0 alone without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(1, dtype=np.uint64)
    k = min(shingle, len(words))
    w = np.array([xxhash.xxh64_intdigest(x, 42) for x in words], dtype=np.uint64)
    n = len(w) - k + 1
    h = np.full(n, k, dtype=np.uint64)
    for i in range(k):
        h += w[i : i + n] * FACTORS[i]
        h ^= h >> np.uint64(29)
    return np.unique(h)


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets' similarity is at least ``ALIKE``."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * sum(ALIKE) >= ALIKE[0] * (len(a) + len(b))


def fingerprint(found: np.ndarray) -> np.ndarray:
    """The SimHash of WORDS words of a set of shingles."""
    counts = np.zeros(64 * WORDS, dtype=np.int64)
    for i in range(0, len(found), AT_ONCE):
        h = found[i : i + AT_ONCE]
        mixed = np.stack([(h ^ (h >> np.uint64(31))) * FACTORS[10 + j] for j in range(WORDS)], axis=1)
        mixed ^= mixed >> np.uint64(32)
        counts += np.unpackbits(np.ascontiguousarray(mixed).view(np.uint8).reshape(len(h), -1), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(counts * 2 > len(found), bitorder="little").view("<u8")


def bit_samples(n: int) -> np.ndarray:
    """For n texts, which bits of a fingerprint make each of its keys: an array of (keys, bits of a key).

    Texts of similarity ALIKE differ in a bit with the angle of their sets over pi.  Keys have bits of their own as long
    as there are enough; after that they share some, and the chance to meet is averaged over the bits that differ.
    """
    size, width = 64 * WORDS, max(LEAST, math.ceil(math.log2(max(1, n) / TILE)))
    apart = math.acos(2 * ALIKE[0] / sum(ALIKE)) / math.pi
    keys = math.ceil(math.log(MISSED) / math.log(1 - (1 - apart) ** width))
    if keys * width > size:
        bits = np.arange(size + 1)
        chance = np.array([math.comb(size, d) * apart**d * (1 - apart) ** (size - d) for d in range(size + 1)])
        agree = np.prod([np.maximum(size - bits - i, 0) / (size - i) for i in range(width)], axis=0)
        while (chance * (1 - agree) ** keys).sum() > MISSED:
            keys += 1
    each = size // width
    order = [np.random.default_rng(i).permutation(size)[: each * width].reshape(each, width) for i in range(-(-keys // each))]
    return np.concatenate(order)[:keys]


def tile_keys(fp: np.ndarray, samples: np.ndarray) -> np.ndarray:
    """Keys of fingerprints (rows of WORDS words): the number of the sample, and the bits that it takes."""
    bits = np.unpackbits(np.ascontiguousarray(fp).view(np.uint8).reshape(len(fp), 8 * WORDS), axis=1, bitorder="little")
    keys = np.zeros((len(fp), len(samples)), dtype=np.int64)
    for j in range(samples.shape[1]):
        keys = keys * 2 + bits[:, samples[:, j]]
    return keys + (np.arange(len(samples), dtype=np.int64) << 32)


def _row(id_col: str, text_col: str) -> list[Column]:
    """A row's own keys: hashes of its id and its text."""
    return [F.xxhash64(F.col(quoted(id_col))), F.xxhash64(F.lit("row"), F.col(quoted(text_col)))]


def signatures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, id_key, text_key, node, size, fp) of each row; equal sets are one node."""
    id_key, text_key = _row(id_col, text_col)
    rows = docs.select(F.col(quoted(id_col)).alias("id"), id_key.alias("id_key"), text_key.alias("text_key"), F.col(quoted(text_col)).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(t) for t in b.column("text").to_pylist()]
            node = np.array([xxhash.xxh64_intdigest(s.tobytes(), 42) for s in sets], dtype=np.uint64).view(np.int64)
            fp = pa.array([fingerprint(s).tobytes() for s in sets], pa.binary())
            arrays = [b.column("id"), b.column("id_key"), b.column("text_key"), pa.array(node), pa.array([len(s) for s in sets], pa.int32()), fp]
            yield pa.RecordBatch.from_arrays(arrays, ["id", "id_key", "text_key", "node", "size", "fp"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, id_key LONG, text_key LONG, node LONG, size INT, fp BINARY")


def keyed(nodes: DataFrame, samples: np.ndarray) -> DataFrame:
    """(node, size, fp, key): each node once for each of its keys, with the words that are compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b for b in batches if len(b)):
            keys = tile_keys(_words(b.column("fp")), samples)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * len(samples)), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("node"), b.column("size"), b.column("fp"), flat], ["node", "size", "fp", "keys"])

    rows = nodes.select("node", "size", "fp").mapInArrow(run, "node LONG, size INT, fp BINARY, keys ARRAY<LONG>")
    return rows.select("node", "size", _compared().alias("fp"), F.explode("keys").alias("key"))


def _compared() -> Column:
    return F.substring("fp", 1, 8 * COMPARED)


def _words(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<u8").reshape(len(column), -1)


class _Tile:
    """The texts of a block: nodes, components, sizes, fingerprints, and, given samples, the keys of tiles before this one."""

    def __init__(self, parts: list[tuple[np.ndarray, ...]], earlier: np.ndarray | None = None):
        self.node, self.of, self.size, self.fp = (np.concatenate(x) for x in zip(*parts, strict=True))
        self.keys = None if earlier is None else tile_keys(self.fp, earlier)

    def near(self, rows: slice, other: _Tile) -> np.ndarray:
        """How many bits some rows here differ in from all of another block; over RADIUS for those that can't be linked."""
        apart = np.zeros((len(self.node[rows]), len(other.node)), dtype=np.int16)
        for w in range(COMPARED):
            apart += np.bitwise_count(self.fp[rows, w][:, None] ^ other.fp[None, :, w])
        a, b = self.size[rows][:, None], other.size[None, :]
        small, large = np.minimum(a, b), np.maximum(a, b)
        out = (self.of[rows][:, None] == other.of[None, :]) | (small * ALIKE[1] < large * ALIKE[0])
        apart[out] = RADIUS + 1
        return apart

    def nearest(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each text the nearest one within the radius that it isn't linked to."""
        step = max(1, BLOCK // len(self.node))
        for i in range(0, len(self.node), step):
            apart = self.near(slice(i, i + step), self)
            best = apart.argmin(axis=1)
            a = np.flatnonzero(apart[np.arange(len(best)), best] <= RADIUS)
            if len(a):
                yield self.node[i : i + step][a], self.node[best[a]]

    def partners(self, other: _Tile) -> tuple[np.ndarray, np.ndarray]:
        """Which texts here, and which of another block, have a pair within the radius that no earlier tile has."""
        mine, theirs = np.zeros(len(self.node), dtype=bool), np.zeros(len(other.node), dtype=bool)
        step = max(1, BLOCK // len(other.node))
        for i in range(0, len(self.node), step):
            a, b = np.nonzero(self.near(slice(i, i + step), other) <= RADIUS)
            first = ~(self.keys[i + a] == other.keys[b]).any(axis=1)
            mine[i + a[first]] = True
            theirs[b[first]] = True
        return mine, theirs


def met(nodes: DataFrame, samples: np.ndarray) -> tuple[DataFrame, DataFrame]:
    """The first pass: written tables of distinct (src, dst), each text with its nearest one of a tile, and of (node, key)
    of tiles in which the node has another within the radius, or that are cut into blocks and so don't tell."""
    rows = keyed(nodes, samples)
    large = written(rows.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / OWN).cast("int").alias("n_blocks")).where("n_blocks > 1"), "near-large")
    block = F.when(F.col("n_blocks").isNull(), 0).otherwise(F.pmod(F.xxhash64("node", F.lit(0)), F.col("n_blocks")).cast("int"))
    rows = rows.join(large, "key", "left").select("key", block.alias("block"), F.lit(False).alias("guest"), "node", F.col("node").alias("component"), "size", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for at, parts, _ in _runs(batches, _sketches):
            for a, b in _Tile(parts).nearest() if parts else ():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), at[0])), pa.array(a), pa.array(b)], ["key", "src", "dst"])

    with arrow_batches(nodes.sparkSession, 1 << 14):
        first = written(_sorted(rows).mapInArrow(run, "key LONG, src LONG, dst LONG"), "near-met")
    pairs = written(first.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct(), "near-pairs")
    tiles = first.select(F.col("src").alias("node"), "key").union(keyed(nodes, samples).join(large, "key", "left_semi").select("node", "key"))
    return pairs, written(tiles.distinct(), "near-tiles")


def dealt(nodes: DataFrame, tiles: DataFrame, labels: DataFrame, last: bool, salt: int) -> DataFrame:
    """(key, block, guest, node, component, size, fp) of tiles with several components, a block's own rows first.

    In the last pass a row of a smaller component is a guest in the other blocks of its tile, and fingerprints are whole.
    """
    rows = tiles.join(labels, "node", "left").select("node", "key", F.coalesce("component", "node").alias("component"))
    by = rows.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n")).groupBy("key")
    plan = by.agg(F.ceil(F.sum("n") / OWN).cast("int").alias("n_blocks"), F.max_by("component", "n").alias("major"), F.count(F.lit(1)).alias("kinds"))
    rows = rows.join(written(plan.where("kinds > 1").drop("kinds"), "near-plan"), "key")
    home = F.pmod(F.xxhash64("node", F.lit(salt)), F.col("n_blocks")).cast("int")
    to = F.when(F.col("component") == F.col("major"), F.array(home)).otherwise(F.sequence(F.lit(0), F.col("n_blocks") - 1)) if last else F.array(home)
    rows = rows.join(nodes.select("node", "size", (F.col("fp") if last else _compared()).alias("fp")), "node").withColumns({"home": home, "to": to})
    rows = rows.select("key", "node", "component", "size", "fp", "home", F.explode("to").alias("block")).withColumn("guest", F.col("block") != F.col("home"))
    return _sorted(rows.select("key", "block", "guest", "node", "component", "size", "fp"))


def _sorted(rows: DataFrame) -> DataFrame:
    return rows.repartition(partitions(rows.sparkSession), "key", "block").sortWithinPartitions("key", "block", "guest")


def _runs(batches: Iterator[pa.RecordBatch], read) -> Iterator[tuple[tuple, list | None, tuple | None]]:
    """Of rows sorted by (key, block, guest): (place, own parts, None) once a block's own rows are complete, and then
    (place, None, part) for each part of its guests.  read makes a part of some rows of a batch."""
    now, parts, told = None, [], False
    for b in batches:
        key, block, guest = (b.column(c).to_numpy(zero_copy_only=False) for c in ("key", "block", "guest"))
        cuts = np.concatenate([[0], np.flatnonzero((key[1:] != key[:-1]) | (block[1:] != block[:-1]) | (guest[1:] != guest[:-1])) + 1, [len(key)]])
        for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if i == j:
                continue
            if (at := (key[i], block[i])) != now:
                if parts and not told:
                    yield now, parts, None
                now, parts, told = at, [], False
            part = read(b, i, j)
            if not guest[i]:
                parts.append(part)
                continue
            if not told:
                if parts:
                    yield now, parts, None
                told = True
            if parts:
                yield now, None, part
    if parts and not told:
        yield now, parts, None


def _sketches(b: pa.RecordBatch, i: int, j: int) -> tuple[np.ndarray, ...]:
    part = b.slice(i, j - i)
    node, of, size = (part.column(c).to_numpy() for c in ("node", "component", "size"))
    return node, of, size.astype(np.int64), _words(part.column("fp"))


def candidates(nodes: DataFrame, tiles: DataFrame, labels: DataFrame, salt: int) -> DataFrame:
    """The written table of distinct (src, dst) to check: each text with its nearest one of another component in a tile."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            pairs = np.unique(np.concatenate(found, axis=1), axis=1) if found else np.zeros((2, 0), dtype=np.int64)
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["src", "dst"])

        for _, parts, _ in _runs(batches, _sketches):
            for a, b in _Tile(parts).nearest() if parts else ():
                found.append(np.stack([np.minimum(a, b), np.maximum(a, b)]))
            if len(found) > 4096:
                yield out()
        yield out()

    with arrow_batches(nodes.sparkSession, 1 << 14):
        return written(dealt(nodes, tiles, labels, False, salt).mapInArrow(run, "src LONG, dst LONG").where("src != dst").distinct(), "near-pairs")


def undecided(nodes: DataFrame, tiles: DataFrame, labels: DataFrame, samples: np.ndarray) -> DataFrame:
    """The written table of (key, block, guest, node, component): texts that have a pair within the radius in another
    component, in the first tile of such a pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, which, shown, earlier = None, None, None, None
        names = ["key", "block", "guest", "node", "component"]

        def rows(at: tuple, guest: bool, t: _Tile, mask: np.ndarray) -> pa.RecordBatch:
            n = int(mask.sum())
            values = [np.full(n, at[0]), np.full(n, at[1], dtype=np.int32), np.full(n, guest), t.node[mask], t.of[mask]]
            return pa.RecordBatch.from_arrays([pa.array(v) for v in values], names)

        for at, parts, part in _runs(batches, _sketches):
            if parts is not None:
                earlier = samples[: at[0] >> 32]
                tile = _Tile(parts, earlier)
                which, shown = tile.partners(tile)[0], np.zeros(len(tile.node), dtype=bool)
            else:
                guests = _Tile([part], earlier)
                mine, theirs = guests.partners(tile)
                which = which | theirs
                if mine.any():
                    yield rows(at, True, guests, mine)
            fresh = which & ~shown
            if fresh.any():
                yield rows(at, False, tile, fresh)
                shown |= fresh

    with arrow_batches(nodes.sparkSession, 1 << 12):
        return written(dealt(nodes, tiles, labels, True, 2).mapInArrow(run, "key LONG, block INT, guest BOOLEAN, node LONG, component LONG"), "near-undecided")


def decided(places: DataFrame, sets: DataFrame) -> DataFrame:
    """The written table of (src, dst): what is similar of the texts of ``undecided``, by their whole sets (node, grams)."""

    def read(b: pa.RecordBatch, i: int, j: int) -> tuple:
        part = b.slice(i, j - i)
        return part.column("node").to_numpy(), part.column("component").to_numpy(), [np.frombuffer(x, dtype="<u4") for x in part.column("grams").to_pylist()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node = of = flat = starts = sizes = None

        def meet(nodes: np.ndarray, comps: np.ndarray, sets: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            src, dst = [], []
            for n, c, x in zip(nodes.tolist(), comps.tolist(), sets, strict=True):
                at = np.minimum(np.searchsorted(x, flat), len(x) - 1)
                both = np.add.reduceat((x[at] == flat).astype(np.int64), starts)
                hit = np.flatnonzero((of != c) & (both * sum(ALIKE) >= ALIKE[0] * (sizes + len(x))))
                src += [n] * len(hit)
                dst += node[hit].tolist()
            if src:
                yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], ["src", "dst"])

        for _, parts, part in _runs(batches, read):
            if parts is not None:
                node, of = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
                own = [x for p in parts for x in p[2]]
                flat, sizes = np.concatenate(own), np.array([len(x) for x in own])
                starts = np.cumsum(sizes) - sizes
                kinds, inverse, counts = np.unique(of, return_inverse=True, return_counts=True)
                small = np.flatnonzero(inverse != counts.argmax())  # pairs have one of these at least
                yield from meet(node[small], of[small], [own[i] for i in small])
            else:
                yield from meet(*part)

    rows = _sorted(places.join(sets, "node").select("key", "block", "guest", "node", "component", "grams"))
    with arrow_batches(places.sparkSession):
        return written(rows.mapInArrow(run, "src LONG, dst LONG"), "near-links")


def checked(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of the pairs whose whole sets are similar."""
    both = pairs.join(texts.select(F.col("node").alias("src"), F.col("text").alias("a")), "src").join(texts.select(F.col("node").alias("dst"), F.col("text").alias("b")), "dst")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets: dict[int, np.ndarray] = {}
            hit = []
            for x, y, s, t in zip(*(b.column(c).to_pylist() for c in ("src", "dst", "a", "b")), strict=True):
                for n, text in ((x, s), (y, t)):
                    if n not in sets:
                        sets[n] = shingles(text)
                hit.append(alike(sets[x], sets[y]))
            yield pa.RecordBatch.from_arrays([b.column("src"), b.column("dst")], ["src", "dst"]).filter(pa.array(hit, pa.bool_()))

    return both.select("src", "dst", "a", "b").mapInArrow(run, "src LONG, dst LONG")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: of each component of similar texts the one with the smallest id, and one only.

    Null and empty texts have one shingle, the same; a text of fewer than five words is one shingle; null
    ids are larger than all others; of repeated rows one stays; texts are read whole, whatever their
    length.  All columns are kept, whatever their names and types.  No rows in, no rows out.
    """
    spark = docs.sparkSession
    with arrow_batches(spark):
        signed = written(signatures(docs, id_col, text_col), "near-signatures")
    least = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "text_key", "id_key")).alias("least")
    nodes = written(signed.groupBy("node").agg(least, F.first("size").alias("size"), F.first("fp").alias("fp")), "near-nodes")
    id_key, text_key = _row(id_col, text_col)
    rows = docs.select(id_key.alias("id_key"), text_key.alias("text_key"), F.col(quoted(text_col)).alias("text"))

    samples = bit_samples(nodes.count())
    with arrow_batches(spark, 1 << 10):
        first, tiles = met(nodes, samples)
    # the texts of all that any pass may ask for, fetched once: each join with the whole table deals all its texts
    at = written(nodes.join(tiles.select("node").distinct(), "node", "left_semi").select("node", F.col("least.id_key").alias("id_key"), F.col("least.text_key").alias("text_key")), "near-need")
    texts = written(rows.join(at, ["id_key", "text_key"]).select("node", "text").dropDuplicates(["node"]), "near-texts")

    def links(pairs: DataFrame) -> DataFrame:
        with arrow_batches(spark):
            return written(checked(pairs, texts), "near-links")

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [np.unique((shingles(t) >> np.uint64(32)).astype("<u4")).tobytes() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(sets, pa.binary())], ["node", "grams"])

    found = links(first)
    labels = components(found)
    found = found.union(links(written(candidates(nodes, tiles, labels, 1).join(first, ["src", "dst"], "left_anti"), "near-untried")))
    places = undecided(nodes, tiles, components(found), samples)
    with arrow_batches(spark):
        sets = written(texts.join(places.select("node").distinct(), "node", "left_semi").mapInArrow(grams, "node LONG, grams BINARY"), "near-sets")
    labels = components(found.union(decided(places, sets)))
    stay = nodes.select("node", "least").join(labels, "node", "left").groupBy(F.coalesce("component", "node").alias("component")).agg(F.min("least").alias("least"))
    a, b, n = free_name(docs, "id_key", "text_key", "row_no")
    stay = written(stay.select(F.col("least.id_key").alias(a), F.col("least.text_key").alias(b)), "near-stay")
    kept = docs.withColumns({a: id_key, b: text_key}).join(stay, [a, b], "left_semi").withColumn(n, F.row_number().over(Window.partitionBy(a, b).orderBy(a))).where(F.col(n) == 1)
    return kept.select(*columns(docs))
