"""Sharding by balanced label propagation (DataFrame operations only).

Documents are linked where their link keys are equal (by default a hash of the text), and a document's
label is its shard.  It starts in a shard dealt by a hash of its id.  In each round every linked document looks at how many
of its neighbours each shard holds and wants to move to the one with most; how many may move from one
shard to another is a quota: two shards swap as many as both want, and beyond that a move needs a free
seat.  Documents without links are indifferent: the free seats are theirs, and they take what is left at
the end.  So the numbers of rows stay even (the law ``rows``: at most one apart) while cut links fall.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilstone.llm.store import global_rank, quoted, written


def seats(n: int, shards: int) -> list[int]:
    """Rows of each shard: as even as they can be, the larger ones first."""
    return [n // shards + (s < n % shards) for s in range(shards)]


def _cycle(rest: dict[tuple[int, int], int], shards: int) -> list[tuple[int, int]]:
    """A closed way along moves that are still wanted, or none."""
    done: set[int] = set()
    for start in range(shards):
        way, at = [], start
        while at not in done:
            if at in way:
                way = [*way[way.index(at) :], at]
                return list(zip(way, way[1:], strict=False))
            way.append(at)
            following = [b for b in range(shards) if rest.get((at, b), 0) > 0 and b not in done]
            if following:
                at = following[0]
                continue
            # a dead end: no cycle goes through it
            done.add(way.pop())
            at = way.pop() if way else at
    return []


def quotas(wants: dict[tuple[int, int], int], free: list[int]) -> dict[tuple[int, int], int]:
    """How many may move from one shard to another.

    First exchanges that leave all numbers as they are: moves along closed ways, as many as all of a way's moves are
    wanted (each way uses up one of them, so there are at most shards x shards ways).  Then moves to free
    seats, which the sources share in proportion.
    """
    shards, rest = len(free), dict(wants)
    out = dict.fromkeys(((a, b) for a in range(shards) for b in range(shards) if a != b), 0)
    while way := _cycle(rest, shards):
        n = min(rest[x] for x in way)
        for x in way:
            rest[x] -= n
            out[x] += n
    for b in range(shards):
        asked = {a: rest.get((a, b), 0) for a in range(shards) if a != b}
        total, left = sum(asked.values()), free[b]
        shares = {a: n * min(left, total) // max(total, 1) for a, n in asked.items()}
        left = min(left, total) - sum(shares.values())
        for a, n in asked.items():
            more = min(left, n - shares[a])
            out[a, b] += shares[a] + more
            left -= more
    return out


def _array(values: list[int], kind: str = "BIGINT") -> Column:
    return F.expr(f"CAST(array({', '.join(map(str, values))}) AS ARRAY<{kind}>)")


def _wishes(linked: DataFrame, closed: list[bool], shards: int, turn: int) -> DataFrame:
    """(node, link, shard, to, gain) for each linked document: where it wants to be, itself included in the counts.

    Of equal counts the shard with the larger hash of (link, shard, round) counts, the same for all members, so that
    pairs don't swap for ever.  A full shard is wanted only where no other is better than one's own.
    Counts by (link, shard) are combined in each task before they are shuffled, and a link key has
    at most one entry a shard; the join back to a key's documents can be split where the key is common.
    """
    held = linked.groupBy("link", "shard").agg(F.count(F.lit(1)).alias("n"))
    entry = F.struct("n", F.xxhash64("link", "shard", F.lit(turn)).alias("tie"), "shard")
    by_link = held.groupBy("link").agg(F.collect_list(entry).alias("held"))
    own = F.get(F.filter("held", lambda x: x["shard"] == F.col("shard")), F.lit(0))
    shut = _array([int(c) for c in closed], "INT")
    best = F.array_max(F.filter("held", lambda x: (x["shard"] == F.col("shard")) | (F.get(shut, x["shard"]) == 0)))
    both = linked.join(by_link, "link").withColumns({"own": own, "best": best})
    both = both.withColumn("best", F.when(F.col("best.shard") == F.col("shard"), F.array_max("held")).otherwise(F.col("best")))
    return both.select("node", "link", "shard", F.col("best.shard").alias("to"), (F.col("best.n") - F.col("own.n")).alias("gain"))


def placed(docs: DataFrame, shards: int = 16, rounds: int = 16, id_col: str = "doc_id", text_col: str = "text", link: Column | None = None) -> DataFrame:
    """(id, size, text_crc32, link, node, shard, slot): one row for each of ``docs``; see ``sharded``."""
    text = F.col(quoted(text_col))
    whole = F.coalesce(text, F.lit(""))
    key = F.xxhash64(whole) if link is None else F.when(link.isNotNull(), F.xxhash64(link))
    key = F.xxhash64(whole) if link is None else F.when(link.isNotNull(), F.xxhash64(link))
    base = docs.select(
        F.col(quoted(id_col)).alias("id"), (F.octet_length(whole).cast("long") + 1).alias("size"), F.crc32(whole).alias("text_crc32"),
        key.alias("link"), F.xxhash64(F.lit("row"), whole).alias("tie"),
    )
    # the texts are read once; node numbers the rows by content alone, so that reruns agree
    base = written(base, "shard-rows")
    base = written(global_rank(base, [F.xxhash64("id"), F.col("id"), F.col("tie")], "node", name="shard-nodes").drop("tie"), "shard-base")
    several = base.where("link IS NOT NULL").groupBy("link").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("link", F.lit(True).alias("several"))
    base = written(base.join(several, "link", "left").withColumn("linked", F.coalesce("several", F.lit(False))).drop("several"), "shard-linked")
    linked = global_rank(base.where("linked").select("node", "link"), [F.col("node")], "nth", name="shard-start")
    linked = linked.select("node", "link", F.pmod(F.col("nth") - 1, F.lit(shards)).cast("int").alias("shard"))
    total, n_linked = base.count(), base.where("linked").count()
    free, closed = [a - b for a, b in zip(seats(total, shards), seats(n_linked, shards), strict=True)], [False] * shards
    for turn in range(rounds if n_linked else 0):
        wishes = written(_wishes(linked, closed, shards, turn), "shard-wishes")
        # at most shards x shards numbers
        wants = {(r["shard"], r["to"]): r["count"] for r in wishes.where("shard != to").groupBy("shard", "to").count().collect()}
        may = quotas(wants, free)
        for (a, b), n in may.items():
            free[a], free[b] = free[a] + n, free[b] - n
        # a full shard that more wanted is closed to newcomers: they look for their next best
        was, closed = closed, [not free[b] and (closed[b] or sum(n - may[a, c] for (a, c), n in wants.items() if c == b) > 0) for b in range(shards)]
        if not sum(may.values()):
            if closed == was:
                break
            continue
        ranked = global_rank(wishes.withColumn("way", F.col("shard") * shards + F.col("to")), [F.col("gain").desc(), F.col("link"), F.col("node")], "nth", "way", "shard-moves")
        quota = F.get(_array([may.get((a, b), 0) for a in range(shards) for b in range(shards)]), F.col("way"))
        linked = ranked.select("node", "link", F.when(F.col("nth") <= quota, F.col("to")).otherwise(F.col("shard")).alias("shard"))
    alone = global_rank(base.where("NOT linked").select("node"), [F.col("node")], "nth", name="shard-alone")
    upto = [sum(free[: s + 1]) for s in range(shards)]
    alone = alone.select("node", F.size(F.filter(_array(upto), lambda x: x < F.col("nth"))).alias("shard"))
    done = written(base.join(linked.select("node", "shard").unionByName(alone), "node"), "shard-placed")
    return global_rank(done, [F.col("link"), F.col("node")], "slot", "shard", "shard-slots").withColumn("slot", F.col("slot") - 1).drop("linked")


def sharded(docs: DataFrame, shards: int = 16, rounds: int = 16, id_col: str = "doc_id", text_col: str = "text", link: Column | None = None) -> DataFrame:
    """(id_col, size, text_crc32, law, shard, slot, grown_shard): one row for each of ``docs``, repeated rows too.

    The law is ``rows``: the shards' numbers of rows are at most one apart, whatever the sizes.  size: UTF-8
    bytes of the text plus 1.  slot numbers a shard's rows from 0 without gaps, linked ones beside each
    other.  link: documents with equal values are linked, null ones aren't; by default equal texts are.
    Null texts are empty ones; null ids are dealt like any other; ties in id are broken by text; other
    columns don't matter.  A link key that more documents have than a shard has seats fills several
    shards, one after the other.  rounds bounds the rounds (each costs a few shuffles of 30 bytes a linked document);
    it ends earlier where nothing can move.  No rows in, no rows out.
    """
    done = placed(docs, shards, rounds, id_col, text_col, link)
    return done.select(F.col("id").alias(id_col), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def cut_links(rows: DataFrame) -> int:
    """Shards beyond the first over which the documents of a link key are spread, summed over all keys."""
    spread = rows.where("link IS NOT NULL").groupBy("link", "shard").count().groupBy("link").agg((F.count(F.lit(1)) - 1).alias("cut"))
    return spread.agg(F.coalesce(F.sum("cut"), F.lit(0)).alias("cut")).first()["cut"]
