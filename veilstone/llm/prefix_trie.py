"""A trie of conversations by their turns, out of mergeable partial tries.

A node is a sequence of first turns, known by a chained hash.  Each partition combines its conversations'
nodes into a table of its own; the tables are merged by hash, so many pieces at a time, until each
node is one row.  Then values are rolled up from the bottom: each node's value starts at the
conversation that stands for it (its smallest member), is summed along that conversation's path towards
the root, and the sums are merged in the same way.  No step goes level by level, so depth costs no rounds.

Long conversations are cut into blocks of turns: a chain begins anew in each block and is joined to the
hash of what lies before, so neither one task nor one row holds a whole conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilstone.llm.store import global_rank, partitions, quoted, written

#: Turns of a block; pieces that one merge takes together; ids of a chunk of an end list; bytes of a hash.
BLOCK, FAN_IN, CHUNK, WIDTH = 1024, 64, 4096, 16
ROOT = b"\0" * WIDTH
#: Fixed values of the contract: where a conversation's first turns come from, and how many they are at most.
FAMILY, HEADS = 100, 6


def _short(value: Column) -> Column:
    return F.substring(F.unhex(F.sha2(value, 256)), 1, WIDTH)


def ordered(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, pos, turn_hash, chars): turns numbered from 1 within their conversation, without their texts.

    Null turns come first; equal ones go by role, the text's first 32 characters and a hash of the turn.
    Null roles and texts are empty; rows without a conversation's id belong to none and are left out.
    No conversation is gathered in a task: rows are dealt by range and numbered by prefix sums.
    """
    role, text = (F.coalesce(F.col(quoted(c)), F.lit("")) for c in (role_col, text_col))
    code = _short(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))
    rows = conversations.where(F.col(quoted(id_col)).isNotNull()).select(
        F.col(quoted(id_col)).cast("long").alias("conv"), F.col(quoted(turn_col)).alias("turn"), role.alias("role"), F.left(text, F.lit(32)).alias("head"), code.alias("turn_hash"), F.char_length(text).alias("chars")
    )
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("head"), F.col("turn_hash")]
    return global_rank(rows, order, "pos", "conv", "trie-turns").select("conv", "pos", "turn_hash", "chars")


def rebuilt(turns: DataFrame, family: int = FAMILY, heads: int = HEADS) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations) of ``ordered`` turns after their beginnings were exchanged.

    Conversation c gets the first h turns of conversation c - c % family (all if there are fewer, none if
    it is absent), h = crc32(c in decimal) % heads, and then its own turns after its first h.
    turns: (conv, pos, turn_hash, chars, last); conversations: (conv, length), those without turns too.
    """
    sizes = written(turns.groupBy("conv").agg(F.count(F.lit(1)).alias("n")), "trie-sizes")
    h = F.crc32(F.col("conv").cast("string")) % heads
    plan = sizes.withColumns({"h": h, "base": F.col("conv") - F.col("conv") % family})
    plan = plan.join(sizes.select(F.col("conv").alias("base"), F.col("n").alias("base_n")), "base", "left").withColumn("taken", F.least("h", F.coalesce("base_n", F.lit(0))))
    plan = written(plan.select("conv", "base", "h", "taken", (F.col("taken") + F.greatest(F.lit(0), F.col("n") - F.col("h"))).alias("length")), "trie-plan")
    own = turns.join(plan, "conv").where("pos > h").withColumn("pos", F.col("pos") - F.col("h") + F.col("taken"))
    first = turns.where(F.col("pos") < heads).withColumnRenamed("conv", "base").join(plan, "base").where("pos <= h")
    kept = ["conv", "pos", "turn_hash", "chars", (F.col("pos") == F.col("length")).alias("last")]
    return own.select(*kept).unionByName(first.select(*kept)), plan.select("conv", "length")


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of the turns of blocks, in order: each from the one before it (null at a block's beginning) and its turn."""
    at, state = None, None
    for b in batches:
        before, after = [], []
        for conv, block, code in zip(*(b.column(c).to_pylist() for c in ("conv", "block", "turn_hash")), strict=True):
            if (conv, block) != at:
                at, state = (conv, block), None
            before.append(state)
            state = hashlib.blake2b((state or b"") + code, digest_size=WIDTH).digest()
            after.append(state)
        kept = [b.column(c) for c in ("conv", "block", "pos", "chars", "last")]
        yield pa.record_batch([*kept, pa.array(before, pa.binary()), pa.array(after, pa.binary())], names=["conv", "block", "pos", "chars", "last", "before", "link"])


def _seeded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of what lies before each block but the first, from the last links of the blocks in order."""
    at, state = None, b""
    for b in batches:
        out = []
        for conv, link in zip(b.column("conv").to_pylist(), b.column("link").to_pylist(), strict=True):
            state = link if conv != at else hashlib.sha256(state + link).digest()[:WIDTH]
            at = conv
            out.append(state)
        yield pa.record_batch([b.column("conv"), b.column("block"), pa.array(out, pa.binary())], names=["conv", "block", "seed"])


def paths(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """(conv, pos, node, parent, chars, last): the nodes along each conversation, its root at pos 0."""
    blocks = turns.withColumn("block", F.floor((F.col("pos") - 1) / BLOCK)).repartition("conv", "block").sortWithinPartitions("conv", "block", "pos")
    links = written(blocks.mapInArrow(_chained, "conv LONG, block LONG, pos LONG, chars INT, last BOOLEAN, before BINARY, link BINARY"), "trie-links")
    ends = links.where((F.col("pos") % BLOCK == 0) & ~F.col("last")).select("conv", (F.col("block") + 1).alias("block"), "link")
    seeds = ends.repartition("conv").sortWithinPartitions("conv", "block").mapInArrow(_seeded, "conv LONG, block LONG, seed BINARY")
    joined = lambda link: _short(F.concat("seed", link))
    begun = links.where("block = 0").select("conv", "pos", F.col("link").alias("node"), F.coalesce("before", F.lit(ROOT)).alias("parent"), "chars", "last")
    later = links.where("block > 0").join(seeds, ["conv", "block"]).select("conv", "pos", joined("link").alias("node"), F.coalesce(joined("before"), F.col("seed")).alias("parent"), "chars", "last")
    roots = conversations.select("conv", F.lit(0).cast("long").alias("pos"), F.lit(ROOT).alias("node"), F.lit(None).cast("binary").alias("parent"), F.lit(0).alias("chars"), (F.col("length") == 0).alias("last"))
    return written(begun.unionByName(later).unionByName(roots), "trie-paths")


def merged(rows: DataFrame, **sums: Column) -> DataFrame:
    """(node, sums): the partial tables of the partitions, merged FAN_IN at a time by hash until each node is one row.

    sums: aggregates that can be taken of themselves again, under the names of the columns that they read.
    """
    pieces = partitions(rows.sparkSession)
    rows = rows.withColumn("piece", F.pmod(F.spark_partition_id(), F.lit(pieces)))
    while True:
        # Spark combines a task's rows of (node, piece) before it sends them: the partition's own table
        pieces = -(-pieces // FAN_IN)
        rows = rows.groupBy("node", F.floor(F.col("piece") / FAN_IN).alias("piece")).agg(*[a.alias(k) for k, a in sums.items()])
        if pieces <= 1:
            return rows.drop("piece")


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted ids of a node's ends as decimal text, CHUNK at most in a row."""
    node, ids = None, []
    for b in batches:
        out = []
        for n, conv in zip(b.column("node").to_pylist(), b.column("conv").to_pylist(), strict=True):
            if n != node or len(ids) == CHUNK:
                if ids:
                    out.append((node, ids[0], ",".join(map(str, ids))))
                node, ids = n, []
            ids.append(conv)
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.binary(), pa.int64(), pa.string()))], names=["node", "first", "ids"])
    if ids:
        yield pa.record_batch([pa.array([node], pa.binary()), pa.array(ids[:1], pa.int64()), pa.array([",".join(map(str, ids))])], names=["node", "first", "ids"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's chunks, which come in order; no list is held, only the state of the hash."""
    node, state = None, hashlib.sha256()
    names = ["node", "ends"]
    for b in batches:
        out = []
        for n, ids in zip(b.column("node").to_pylist(), b.column("ids").to_pylist(), strict=True):
            if n == node:
                state.update(b",")
            else:
                if node is not None:
                    out.append((node, state.hexdigest()))
                node, state = n, hashlib.sha256()
            state.update(ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.binary(), pa.string()))], names=names)
    if node is not None:
        yield pa.record_batch([pa.array([node], pa.binary()), pa.array([state.hexdigest()])], names=names)


def end_lists(found: DataFrame) -> DataFrame:
    """(node, ends): SHA-256 of the decimal ids of the conversations that end at each node, ascending, joined by commas.

    The lists are sorted by range over all tasks and written as chunks; a node's chunks then run through one
    hash, which is a chain by nature, in bounded memory.
    """
    ends = found.where("last").select("node", "conv")
    chunks = ends.repartitionByRange(partitions(found.sparkSession), "node", "conv").sortWithinPartitions("node", "conv").mapInArrow(_chunks, "node BINARY, first LONG, ids STRING")
    return chunks.repartition("node").sortWithinPartitions("node", "first").mapInArrow(_digests, "node BINARY, ends STRING")


def rolled_up(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, saved_tokens, n_leaves): sums over each node's subtree of (saved, leaf) of ``nodes``.

    A node's values stand at its smallest member, at its depth.  Along a conversation's path the sum of
    what stands at this depth or below goes to the node there; a block's sum is a running one over at most BLOCK
    turns, plus the sums of the blocks below.
    """
    at = nodes.select(F.col("first").alias("conv"), F.col("depth").alias("pos"), "saved", "leaf")
    path = found.select("conv", "pos", "node").join(at, ["conv", "pos"], "left").na.fill(0, ["saved", "leaf"]).withColumn("block", F.floor(F.col("pos") / BLOCK))
    path = written(path, "trie-values")
    names = ["saved", "leaf"]
    below = path.where("block > 0").groupBy("conv", "block").agg(*[F.sum(c).alias(c) for c in names])
    under = Window.partitionBy("conv").orderBy(F.col("block").desc())
    below = below.select("conv", (F.col("block") - 1).alias("block"), *[F.sum(c).over(under).alias(f"below_{c}") for c in names])
    along = Window.partitionBy("conv", "block").orderBy(F.col("pos").desc())
    sums = path.withColumns({c: F.sum(c).over(along) for c in names}).join(below, ["conv", "block"], "left")
    sums = sums.select("node", *[(F.col(c) + F.coalesce(f"below_{c}", F.lit(0))).alias(c) for c in names]).where("saved > 0 OR leaf > 0")
    return merged(sums, saved=F.sum("saved"), leaf=F.sum("leaf")).select("node", F.col("saved").alias("saved_tokens"), F.col("leaf").alias("n_leaves"))


def trie(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """One row for each node of the trie of (conv, pos, turn_hash, chars, last) turns and (conv, length) conversations.

    node, parent (null for the root), conv_id (smallest member), depth, parent_conv_id, n_convs (members),
    n_children, n_leaves, saved_tokens, ends_sha256, as ``prefix_trie`` tells.
    """
    found = paths(turns, conversations)
    ones = found.select("node", F.lit(1).cast("long").alias("n_convs"), F.col("conv").alias("first"), F.col("pos").alias("depth"), "parent", "chars")
    nodes = merged(ones, n_convs=F.sum("n_convs"), first=F.min("first"), depth=F.max("depth"), parent=F.max("parent"), chars=F.max("chars"))
    nodes = written(nodes, "trie-nodes")
    children = nodes.where("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = nodes.join(children, "node", "left").na.fill(0, ["n_children"])
    nodes = written(nodes.withColumns({"saved": (F.col("n_convs") - 1) * F.col("chars"), "leaf": (F.col("n_children") == 0).cast("long")}), "trie-counted")
    above = nodes.select(F.col("node").alias("parent"), F.col("first").alias("parent_conv_id"))
    whole = nodes.join(rolled_up(found, nodes), "node").join(end_lists(found), "node", "left").join(above, "parent", "left")
    return whole.select(
        "node", "parent", F.col("first").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends", F.sha2(F.lit(""), 256)).alias("ends_sha256")
    )


def prefix_trie(conversations: DataFrame, family: int = FAMILY, heads: int = HEADS, **columns: str) -> DataFrame:
    """The trie of ``conversations`` with exchanged beginnings (see ``ordered`` and ``rebuilt``), a row for each node.

    A conversation is a member of the node of each of its beginnings, the empty one included, and ends at
    that of all its turns.  n_leaves: childless nodes of the subtree; saved_tokens: over the subtree, (members
    - 1) times the code points of the node's last text.  Long conversations, ids and turns that repeat,
    and nulls are as told there; other columns don't matter.  No conversations, no rows.
    """
    return trie(*rebuilt(written(ordered(conversations, **columns), "trie-ordered"), family, heads))
