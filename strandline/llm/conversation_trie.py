"""The trie of conversation prefixes, by double arrays: what conversations share, node by node.

A node is a distinct sequence of a conversation's first turns. Conversations become paths of turns:

1. Turns are ranked inside their conversation and become 128-bit keys; texts go no further. A path has the keys, the
   bytes of each turn and a chained digest of every prefix, which is the name of a node wherever it is met. Equal
   paths become one row with their number and least conversation.
2. Prefixes that hold more than ``SHARD_TURNS`` turns of different paths are upper nodes. Below them every prefix is a
   unit of its own, and units are dealt to shards. So a first turn that a third of all conversations share is split
   below itself, as deep as needed.
3. A shard packs its paths into a double array: BASE and CHECK over dense ids of its turns, where the child of
   state s by turn c is t = BASE[s] + c if CHECK[t] = s. Its paths are walked through the arrays, which counts members,
   and states in reverse order of their making pass what lies under them to their parents. Sums for whole subtrees never
   leave the shard.
4. Upper nodes come from every shard that has a path through them; their parts are merged by digest, and what they
   hold goes to their ancestors, which are upper nodes too and few.
5. The digest of the members that end at a node is taken over chunks of 4096 neighbouring ids, made in parallel.

Defined cases: null role or text is empty; turns come by turn (null first), then role, then text; rows without conv_id
belong to no conversation; a repeated row is a turn more. A conversation without turns is a member of the root.
An empty table has no members and gives no nodes. Other columns take no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise

#: Turns of different paths in a unit of a shard, and (about) in a shard.
SHARD_TURNS = 100_000
#: Bits of neighbouring ids that a chunk of the members' digest holds.
CHUNK_BITS = 12
#: Keys over which the paths below one upper node are dealt where they meet it.
SPREAD = 16
#: Free slots that are tried for the children of a state before they go to the end of the arrays.
TRIES = 32
ROOT = hashlib.md5(b"").digest()
PATHS = "conv_id long, keys array<binary>, bytes array<long>, prefixes array<binary>, path binary"
NODES = "node binary, parent binary, upper boolean, under_upper boolean, depth int, conv_id long, parent_conv_id long, n_convs long, bytes long, n_children long, n_leaves long, saved long, ancestors array<binary>"


# Turns and paths.


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, place from 1, key, bytes of the text) of conversations(conv_id, turn, role, text)."""
    empty = F.lit("")
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"))
    # The length of the role tells where the text begins.
    key = F.unhex(F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary")))
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    return rows.select("conv_id", F.row_number().over(order).alias("place"), key.alias("key"), F.octet_length("text").cast("long").alias("bytes"))


def borrowed(own: DataFrame) -> DataFrame:
    """(conv_id, place, key, bytes): every conversation c with its first h turns replaced by those of c - c % 5,
    h = crc32 of c in decimal, modulo 9. Places stay in order, but may have a gap. A conversation that is left without
    turns has one row without place. From ``turns``."""
    c = F.col("conv_id")
    convs = own.select("conv_id").distinct().select("conv_id", (c - c % 5).alias("donor"), F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(9)).alias("h"))
    lent = convs.where("h > 0").join(own.where("place <= 8").withColumnRenamed("conv_id", "donor"), "donor").where("place <= h").select("conv_id", "place", "key", "bytes")
    kept = own.where(F.col("place") > F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(9)))
    none = [F.lit(None).cast(t).alias(n) for n, t in (("place", "int"), ("key", "binary"), ("bytes", "long"))]
    return lent.union(kept).union(convs.select("conv_id", *none))


def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the digest of every prefix, which is that of the one before and the next key, and the last of them."""
    for batch in batches:
        prefixes, last = [], []
        for keys in batch.column("keys").to_pylist():
            own, digest = [], ROOT
            for key in keys:
                digest = hashlib.md5(digest + key).digest()
                own.append(digest)
            prefixes.append(own)
            last.append(digest)
        columns = {c: batch.column(c) for c in ("conv_id", "keys", "bytes")}
        yield pa.RecordBatch.from_pydict(columns | {"prefixes": pa.array(prefixes, pa.list_(pa.binary())), "path": pa.array(last, pa.binary())})


def paths(rows: DataFrame) -> DataFrame:
    """One row per conversation, from (conv_id, place, key, bytes); a row without place is no turn."""
    turn = F.when(F.col("place").isNotNull(), F.struct("place", "key", "bytes"))
    found = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("t"))
    return found.select("conv_id", F.col("t.key").alias("keys"), F.col("t.bytes").alias("bytes")).mapInArrow(chained, PATHS)


# One shard.


def pack(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int, int]]]:
    """BASE, CHECK and the states (slot, depth, first row, row after the last) in the order of their making, root first.

    ``rows``: sequences of codes from 1, sorted and different. Rows that start alike follow each other, so the children
    of a state are runs of one code. Slots are given to the children of the states of one depth, those with most
    children first, as single children fit anywhere.
    """
    size = max(64, 2 * sum(map(len, rows)))
    base, check = np.zeros(size, np.int64), np.full(size, -1, np.int64)
    check[0] = 0
    made, level, free, top, depth = [(0, 0, 0, len(rows))], [(0, 0, len(rows))], 1, 0, 0
    while level:
        below = []
        for slot, lo, hi in level:
            if lo < hi and len(rows[lo]) == depth:
                lo += 1  # a row that ends here comes before all that go on
            if lo < hi:
                codes = np.fromiter((rows[k][depth] for k in range(lo, hi)), np.int64, hi - lo)
                begins = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
                below.append((codes[begins], slot, begins + lo, np.append(begins[1:] + lo, hi)))
        below.sort(key=lambda x: -len(x[0]))
        level = []
        depth += 1
        for codes, slot, begins, ends in below:
            while free < len(check) and check[free] >= 0:
                free += 1
            at, span = free, int(codes[-1] - codes[0])
            for _ in range(TRIES):
                wanted = at + codes - codes[0]
                if (check[wanted[wanted < len(check)]] < 0).all():
                    break
                at += 1
                while at < len(check) and check[at] >= 0:
                    at += 1
            else:
                at = top + 1
            top = max(top, at + span)
            if at + span >= len(check):
                more = max(len(check), at + span + 1 - len(check))
                base, check = np.concatenate([base, np.zeros(more, np.int64)]), np.concatenate([check, np.full(more, -1, np.int64)])
            base[slot] = at - int(codes[0])
            slots = (base[slot] + codes).tolist()
            check[slots] = slot
            for child, lo, hi in zip(slots, begins.tolist(), ends.tolist(), strict=True):
                made.append((child, depth, lo, hi))
                level.append((child, lo, hi))
    return base, check, made


def walk(base: np.ndarray, check: np.ndarray, codes: np.ndarray) -> list[int]:
    """The states of a sequence of codes, the root first; it ends where the trie has no such child."""
    state, out = 0, [0]
    for c in codes.tolist():
        nxt = int(base[state]) + c
        if not 0 < nxt < len(check) or check[nxt] != state:
            break
        state = nxt
        out.append(state)
    return out


def shard_nodes(group: pa.Table) -> pa.Table:
    """The nodes of a shard's paths (keys, bytes, prefixes, cut, n, first). Those from a path's depth ``cut`` on lie in
    this shard alone and are whole; upper ones are a part, with the sums of the whole subtrees next to them."""
    keys, sizes, prefixes = (group.column(c).to_pylist() for c in ("keys", "bytes", "prefixes"))
    cut, n, first = (group.column(c).to_pylist() for c in ("cut", "n", "first"))
    # Ids by depth, so that the children of a state mostly have neighbouring ones.
    dense: dict[bytes, int] = {}
    level, depth = keys, 0
    while level := [path for path in level if len(path) > depth]:
        for path in level:
            dense.setdefault(path[depth], len(dense) + 1)
        depth += 1
    rows = [np.array([dense[k] for k in path], np.int64) for path in keys]
    order = sorted(range(len(rows)), key=lambda r: rows[r].tolist())
    base, check, made = pack([rows[r] for r in order])
    members, least = np.zeros(len(check), np.int64), np.full(len(check), np.iinfo(np.int64).max, np.int64)
    for r in range(len(rows)):
        states = walk(base, check, rows[r])
        members[states] += n[r]
        least[states] = np.minimum(least[states], first[r])
    # A row that passes through a state knows its prefix, its bytes, and whether it is an upper node.
    own = {slot: (order[lo], depth) for slot, depth, lo, hi in made}
    children, leaves, saved = (np.zeros(len(check), np.int64) for _ in range(3))
    out = {c: [] for c in ("node", "parent", "upper", "under_upper", "depth", "conv_id", "parent_conv_id", "n_convs", "bytes", "n_children", "n_leaves", "saved", "ancestors")}
    for slot, depth, _, _ in reversed(made):
        r, _ = own[slot]
        upper, size, up = depth < cut[r], sizes[r][depth - 1] if depth else 0, int(check[slot])
        if not upper:
            leaves[slot] += children[slot] == 0
            saved[slot] += (members[slot] - 1) * size
            children[up] += 1
            leaves[up] += leaves[slot]
            saved[up] += saved[slot]
        below = not upper and depth == cut[r]
        ancestors = [ROOT, *prefixes[r][: depth - 1]] if depth else []
        values = (prefixes[r][depth - 1] if depth else ROOT, ancestors[-1] if depth else None, upper, below, depth, int(least[slot]), None if upper or below else int(least[up]), int(members[slot]), size)
        for c, v in zip(out, (*values, int(children[slot]), int(leaves[slot]), int(saved[slot]), ancestors if upper else None), strict=True):
            out[c].append(v)
    kinds = [pa.binary(), pa.binary(), pa.bool_(), pa.bool_(), pa.int32(), *[pa.int64()] * 7, pa.list_(pa.binary())]
    return pa.table([pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)], names=list(out))


# All shards.


def salt(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(SPREAD)).cast("int")


def spread(df: DataFrame) -> DataFrame:
    """Every row once for each of ``SPREAD`` salts: for upper nodes, which many paths meet."""
    return df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))


def cut_paths(distinct: DataFrame) -> DataFrame:
    """Adds ``cut``: the depth from which on a path's prefixes are a shard's own. Above it they hold too many turns; the
    root always does."""
    weight = F.greatest(F.size("keys"), F.lit(1)).cast("long")
    prefix = distinct.select("path", weight.alias("w"), F.explode("prefixes").alias("prefix"))
    heavy = materialise(prefix.groupBy("prefix").agg(F.sum("w").alias("w")).where(F.col("w") > SHARD_TURNS).select("prefix"), "heavy")
    met = prefix.withColumn("salt", salt("path")).join(spread(heavy), ["prefix", "salt"], "left_semi").groupBy("path").agg(F.count("*").alias("above"))
    return distinct.join(met, "path", "left").withColumn("cut", (F.coalesce("above", F.lit(0)) + 1).cast("int")).drop("above")


def ends(members: DataFrame) -> DataFrame:
    """(node, ends_sha256) from (path, conv_id): SHA-256 of the ids that end at a path, in numeric order, joined by commas."""
    chunk = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",")
    chunks = members.groupBy("path", F.shiftright("conv_id", CHUNK_BITS).alias("chunk")).agg(chunk.alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, digest, done = None, None, []
        for batch in batches:
            for key, ids in zip(batch.column("path").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if key != path:
                    if path is not None:
                        done.append((path, digest.hexdigest()))
                    path, digest = key, hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), (pa.binary(), pa.string()), strict=True)], ["node", "ends_sha256"])
                done = []
        if path is not None:
            yield pa.RecordBatch.from_arrays([pa.array([path], pa.binary()), pa.array([digest.hexdigest()])], ["node", "ends_sha256"])

    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return chunks.repartition(parts, "path").sortWithinPartitions("path", "chunk").select("path", "ids").mapInArrow(run, "node binary, ends_sha256 string")


def merged(parts: DataFrame) -> DataFrame:
    """Upper nodes from their parts: (node, parent, depth, conv_id, n_convs, n_children, n_leaves, saved)."""
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved")]
    same = [F.first(c).alias(c) for c in ("parent", "depth", "bytes", "ancestors")]
    upper = materialise(parts.groupBy("node").agg(F.min("conv_id").alias("conv_id"), *sums, *same), "upper")
    more = upper.groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("more"))
    whole = upper.join(more, "node", "left").withColumn("n_children", F.col("n_children") + F.coalesce("more", F.lit(0)))
    leaf = (F.col("n_children") == 0).cast("long")
    own = whole.select("node", "ancestors", (F.col("n_leaves") + leaf).alias("l"), (F.col("saved") + (F.col("n_convs") - 1) * F.col("bytes")).alias("s"))
    below = own.select(F.explode(F.concat("ancestors", F.array("node"))).alias("node"), "l", "s").groupBy("node").agg(F.sum("l").alias("n_leaves"), F.sum("s").alias("saved"))
    return whole.drop("n_leaves", "saved").join(below, "node")


def trie(conversation_paths: DataFrame) -> DataFrame:
    """One row per node, from ``paths``: conv_id (its least member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens (bytes of turns that members share, over the subtree), ends_sha256, and node, parent (digests)."""
    all_paths = materialise(conversation_paths, "paths")
    members = all_paths.select("path", "conv_id")
    counted = members.groupBy("path").agg(F.count("*").alias("n"), F.min("conv_id").alias("first"))
    distinct = counted.join(all_paths.select(F.col("conv_id").alias("first"), "keys", "bytes", "prefixes"), "first")
    distinct = materialise(distinct, "distinct")
    total = distinct.agg(F.sum(F.greatest(F.size("keys"), F.lit(1)))).first()[0] or 0
    unit = F.coalesce(F.get("prefixes", F.col("cut") - 1), F.col("path"))
    dealt = cut_paths(distinct).withColumn("shard", F.pmod(F.xxhash64(unit), F.lit(max(1, -(-total // SHARD_TURNS)))).cast("int"))
    nodes = materialise(dealt.select("shard", "keys", "bytes", "prefixes", "cut", "n", "first").groupBy("shard").applyInArrow(lambda group: shard_nodes(group.drop_columns(["shard"])), NODES), "nodes")
    upper = materialise(merged(nodes.where("upper")), "merged")
    columns = ("node", "parent", "depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved")
    above = upper.select(F.col("node").alias("parent"), F.col("conv_id").alias("above"))
    below = nodes.where("under_upper").withColumn("salt", salt("node")).join(spread(above), ["parent", "salt"]).withColumn("parent_conv_id", F.col("above"))
    tops = upper.join(above, "parent", "left").withColumn("parent_conv_id", F.col("above"))
    every = nodes.where("not upper and not under_upper").select(*columns).unionByName(below.select(*columns)).unionByName(tops.select(*columns))
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    out = every.join(ends(members), "node", "left")
    return out.select("conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", empty).alias("ends_sha256"), "node", "parent")
