"""Conversation prefix trie (operator 13) as balanced parentheses per shard.

A conversation is the sequence of its turns (role, text); only digests and lengths
of turns travel. Conversations with one sequence are one path, with the number of
its conversations and their least id. Paths are sorted by their digests and dealt
by ranges, so the trie's subtrees are stretches of the order. A task cuts its range
to shards of at most ``SHARD_NODES`` nodes and writes each shard's trie as balanced
parentheses: the excess (its running sum) is held with a range min-max tree over
blocks, findclose gives each node's end, ranks between the two count its nodes and
its leaf pairs ``()``, and differences of cumulative arrays give members and savings.

Only nodes on a shard's first and last path can have parts in other shards. These
spines travel with a digest of their path and are merged by it: counts add up; what
parts of one node counted twice (a child, a leaf, the first member of a node) is
taken off along the spines. All other nodes are final in their shard.

A conversation's path is one row of 16 bytes a turn. The digest of a node's ends is
a SHA-256 over ids in ascending order, which cannot be combined from parts: ids
stream through one task per path, sorted, and are never held together.

Turns are ordered by turn, null first, ties by a digest of role and text; repeated
rows are repeated turns. Null roles and texts are empty. Rows without conv_id belong
to no conversation and are left out. Extra columns, whatever their names, are
ignored. An empty table has no conversations and gives no node, not even the root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import CRC_TABLE, crc32_sql, forget, materialize

#: First turns that a conversation takes from the first of its hundred: the crc32 of its id modulo this.
LEADS, HUNDRED = 6, 100
SHARD_NODES = 500_000
BLOCK, FANOUT = 64, 8
DIGEST = 16
NOTHING = hashlib.sha256(b"").hexdigest()


# -- balanced parentheses ---------------------------------------------------------
class Parens:
    """Balanced parentheses (+1 and -1) with the excess after each and a range minimum tree over its blocks."""

    def __init__(self, signs: np.ndarray):
        self.signs, self.excess = signs, np.cumsum(signs, dtype=np.int64)
        self.opens = np.flatnonzero(signs > 0)
        padded = np.concatenate([self.excess, np.full(-len(signs) % BLOCK, np.iinfo(np.int64).max)])
        self.lows = [padded.reshape(-1, BLOCK).min(axis=1)]
        while len(self.lows[-1]) > 1:
            low = self.lows[-1]
            low = np.concatenate([low, np.full(-len(low) % FANOUT, np.iinfo(np.int64).max)])
            self.lows.append(low.reshape(-1, FANOUT).min(axis=1))
        self.opened = np.cumsum(signs > 0)
        leaf = np.zeros(len(signs), bool)
        leaf[:-1] = (signs[:-1] > 0) & (signs[1:] < 0)
        self.leaves = np.cumsum(leaf)

    def findclose(self, at: np.ndarray) -> np.ndarray:
        """Where each opening parenthesis closes: the first place behind it with one less excess."""
        want, out = self.excess[at] - 1, np.full(len(at), -1)

        def within(which: np.ndarray, place: np.ndarray) -> np.ndarray:
            """Look from each place to its block's end; the queries that found nothing."""
            for _ in range(BLOCK):
                hit = self.excess[place] == want[which]
                out[which[hit]] = place[hit]
                which, place = which[~hit], place[~hit] + 1
                on = (place % BLOCK != 0) & (place < len(self.excess))
                ended.append(which[~on])
                which, place = which[on], place[on]
                if not len(which):
                    break
            return np.concatenate(ended)

        ended: list[np.ndarray] = []
        inside = at + 1 < len(self.excess)
        same = inside & ((at + 1) % BLOCK != 0)
        ended.append(np.flatnonzero(inside & ~same))
        which = within(np.flatnonzero(same), at[same] + 1)
        # climb until a node to the right holds the excess, then descend to its first such block
        level, node = np.zeros(len(which), np.int64), at[which] // BLOCK
        done_which, done_block = [], []
        up = np.ones(len(which), bool)
        while len(which):
            turn = up & (node % FANOUT == FANOUT - 1)
            node = np.where(turn, node // FANOUT, np.where(up, node + 1, node))
            level = level + turn
            low = np.empty(len(which), np.int64)
            for k in np.unique(level):
                here = level == k
                lows = self.lows[k]
                low[here] = np.where(node[here] < len(lows), lows[np.minimum(node[here], len(lows) - 1)], np.iinfo(np.int64).max)
            hit = ~turn & (low <= want[which])
            found = hit & (level == 0)
            done_which.append(which[found])
            done_block.append(node[found])
            down = hit & ~found
            # the first child, one before it while descending, as the next step moves on by one
            node = np.where(down, node * FANOUT, np.where(~up & ~hit, node + 1, node))
            level = level - down
            up = np.where(down, False, up)
            go = ~found
            which, node, level, up = which[go], node[go], level[go], up[go]
        if done_which:
            which, block = np.concatenate(done_which), np.concatenate(done_block)
            ended = []
            within(which, block * BLOCK)
        return out


def shared_lengths(turns: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Length of the common beginning of each path and the one before it; turns (rows of digests), first (where paths begin, one more)."""
    size = np.diff(first)
    least = np.concatenate([[0], np.minimum(size[1:], size[:-1])]) if len(size) else size
    ends = np.cumsum(least)
    path = np.repeat(np.arange(len(size)), least)
    place = np.arange(len(path)) - np.repeat(ends - least, least)
    unlike = np.flatnonzero((turns[first[path] + place] != turns[first[path - 1] + place]).any(axis=1))
    at = np.searchsorted(unlike, ends - least)
    begin = np.append(unlike, len(path))[at]
    return np.minimum(least, begin - (ends - least))


class Shard:
    """The trie of sorted distinct paths: per node (in preorder) its figures within the shard."""

    def __init__(self, turns: np.ndarray, lengths: np.ndarray, first: np.ndarray, n: np.ndarray, least: np.ndarray):
        size = np.diff(first)
        lcp = shared_lengths(turns, first)
        opens, closes = size - lcp, np.append(size[:-1] - lcp[1:], size[-1] + 1)
        runs = np.empty(2 * len(size), np.int64)
        runs[0::2], runs[1::2] = opens, closes
        signs = np.concatenate([[1], np.repeat(np.tile(np.array([1, -1]), len(size)), runs)]).astype(np.int8)
        parens = Parens(signs)
        at = parens.opens
        close = parens.findclose(at)
        path = np.repeat(np.arange(len(size)), opens)
        # the root is node 0; path i opens its nodes from depth lcp + 1 on
        self.depth = parens.excess[at] - 1
        self.last = np.concatenate([[-1], first[path] + self.depth[1:] - 1])
        self.length = np.concatenate([[0], lengths[self.last[1:]]]).astype(np.int64)
        self.ends = np.full(len(at), -1)
        self.ends[np.cumsum(opens)] = np.arange(len(size))
        stop = parens.opened[close]
        ended = self.ends >= 0
        weight = np.zeros(len(at) + 1, np.int64)
        weight[1:][ended] = n[self.ends[ended]]
        weight = np.cumsum(weight)
        node = np.arange(len(at))
        self.n = weight[stop] - weight[node]
        self.leaves = parens.leaves[close] - np.where(at > 0, parens.leaves[at - 1], 0)
        saved = np.concatenate([[0], np.cumsum((self.n - 1) * self.length)])
        self.saved = saved[stop] - saved[node]
        self.parent, self.least = self._tree(np.where(ended, least[self.ends], np.iinfo(np.int64).max))
        self.children = np.bincount(self.parent[1:], minlength=len(at))

    def _tree(self, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each node's parent and the least id in its subtree, level by level."""
        order = np.argsort(self.depth, kind="stable")
        levels = np.split(order, np.flatnonzero(np.diff(self.depth[order])) + 1)
        parent = np.full(len(least), -1)
        for above, nodes in zip(levels[:-1], levels[1:], strict=True):
            parent[nodes] = above[np.searchsorted(above, nodes) - 1]
        for nodes in reversed(levels[1:]):
            np.minimum.at(least, parent[nodes], least[nodes])
        return parent, least

    def spine(self, node: int) -> np.ndarray:
        """The nodes from the root to a node."""
        out = [node]
        while self.parent[out[-1]] >= 0:
            out.append(int(self.parent[out[-1]]))
        return np.array(out[::-1])


NODES = (
    "shard long, side int, key binary, parent_key binary, conv_id long, depth long, parent_conv_id long, n_convs long, "
    "n_children long, n_leaves long, saved long, length long, ends string"
)


def _nodes(s: Shard, turns: np.ndarray, ends: list[str], shard: int) -> pa.RecordBatch:
    """Rows of NODES: side 0 and 1 for the spines of the first and the last path, null for the other nodes.

    A spine's rows have a key and their parent's; another node has its parent's conv_id,
    or the key of a parent that lies on a spine.
    """
    on: dict[int, bytes] = {0: bytes(DIGEST)}
    sides = [s.spine(int(np.flatnonzero(s.ends >= 0)[k])) for k in (0, -1)]
    for side in sides:
        for up, node in zip(side[:-1].tolist(), side[1:].tolist(), strict=True):
            if node not in on:
                on[node] = hashlib.blake2b(on[up] + turns[s.last[node]].tobytes(), digest_size=DIGEST).digest()
    spine = np.zeros(len(s.n), bool)
    spine[list(on)] = True
    rest = np.flatnonzero(~spine)
    rows = np.concatenate([*sides, rest])
    side = pa.array([0] * len(sides[0]) + [1] * len(sides[1]) + [None] * len(rest), pa.int32())
    up = s.parent[rows]
    above = spine[up] & (up >= 0)
    key = [on.get(i) for i in rows.tolist()]
    parent_key = [on[u] if a else None for u, a in zip(up.tolist(), above.tolist(), strict=True)]
    known = np.zeros(len(rows), bool)
    known[len(rows) - len(rest) :] = True
    parent = pa.array(s.least[np.maximum(up, 0)], pa.int64(), mask=~known | above)
    sha = [ends[e] if e >= 0 else None for e in s.ends[rows].tolist()]
    numbers = [pa.array(x[rows], pa.int64()) for x in (s.n, s.children, s.leaves, s.saved, s.length)]
    columns = [pa.array(np.full(len(rows), shard)), side, pa.array(key, pa.binary()), pa.array(parent_key, pa.binary()), pa.array(s.least[rows], pa.int64()), pa.array(s.depth[rows], pa.int64()), parent, *numbers, pa.array(sha, pa.string())]
    return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in NODES.split(", ")])


def _shards(most: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of NODES for sorted rows (task, path, lengths, n, least, ends), in shards of at most ``most`` nodes or one path."""
    forget()
    held: list[pa.RecordBatch] = []
    weight = made = 0

    def solve(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(rows).combine_chunks()
        column = lambda k: table.column(k).combine_chunks()
        paths = column("path")
        first = np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(paths)).astype(np.int64))])
        turns = np.frombuffer(b"".join(paths.flatten().to_pylist()), np.uint64).reshape(-1, 2)
        lengths = np.asarray(column("lengths").flatten()).astype(np.int64)
        s = Shard(turns, lengths, first, np.asarray(column("n")), np.asarray(column("least")))
        return _nodes(s, turns, column("ends").to_pylist(), (int(table.column("task")[0].as_py()) << 32) + made)

    for batch in batches:
        sizes = np.asarray(pc.list_value_length(batch.column(1))).astype(np.int64)
        start = 0
        while start < len(sizes):
            # as many more paths as the shard has room for, at least one
            room = np.searchsorted(np.cumsum(sizes[start:]), most - weight, "right")
            stop = start + max(int(room), 0 if held else 1)
            if stop > start:
                held.append(batch.slice(start, stop - start))
                weight += int(sizes[start:stop].sum())
            if stop < len(sizes):
                yield solve(held)
                made += 1
                held, weight = [], 0
            start = stop
    if held:
        yield solve(held)


# -- conversations ------------------------------------------------------------------
def _leads(conv_id: Column) -> Column:
    return F.crc32(conv_id.cast("string").cast("binary")) % LEADS


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(conv_id, path, lengths): the turns' digests and lengths of every rebuilt conversation, in order."""
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    digest = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))
    turns = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("digest"), F.length(text).cast("long").alias("length"))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "digest"))
    turns = materialize(turns.select("conv_id", place.alias("at"), "digest", "length"))
    convs = turns.where("at = 1").select("conv_id")
    base = F.col("conv_id") - F.pmod("conv_id", F.lit(HUNDRED))
    lead = turns.where((F.col("conv_id") == base) & (F.col("at") < LEADS)).withColumnRenamed("conv_id", "base")
    lead = convs.withColumn("base", base).join(lead, "base").where(F.col("at") <= _leads(F.col("conv_id"))).select("conv_id", "at", "digest", "length")
    own = turns.where(F.col("at") > _leads(F.col("conv_id")))
    turn = F.struct("at", "digest", "length")
    paths = own.unionByName(lead).groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    paths = convs.join(paths, "conv_id", "left").withColumn("turns", F.coalesce("turns", F.array().cast("array<struct<at:int,digest:binary,length:bigint>>")))
    return paths.select("conv_id", F.col("turns.digest").alias("path"), F.col("turns.length").alias("lengths"))


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(name, n, least, ends) of each path for rows (name, conv_id) in order: ids pass through the digest one by one."""
    forget()
    rows: list[tuple] = []
    name, n, least, sha = None, 0, 0, None

    def out() -> pa.RecordBatch:
        kinds = pa.binary(), pa.int64(), pa.int64(), pa.string()
        batch = pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["name", "n", "least", "ends"])
        rows.clear()
        return batch

    for batch in batches:
        names = batch.column(0).to_pylist()
        for own, conv_id in zip(names, batch.column(1).to_pylist(), strict=True):
            if own != name or sha is None:
                if sha is not None:
                    rows.append((name, n, least, sha.hexdigest()))
                name, n, least, sha = own, 1, conv_id, hashlib.sha256(str(conv_id).encode())
            else:
                n += 1
                sha.update(f",{conv_id}".encode())
        yield out()
    if sha is not None:
        rows.append((name, n, least, sha.hexdigest()))
    yield out()


def distinct_paths(convs: DataFrame) -> DataFrame:
    """(path, lengths, n, least, ends) of the distinct paths of convs (conv_id, path, lengths)."""
    name = F.unhex(F.md5(F.array_join(F.transform("path", F.hex), "").cast("binary")))
    convs = materialize(convs.withColumn("name", name))
    ids = convs.select("name", "conv_id").repartition("name").sortWithinPartitions("name", "conv_id")
    ends = ids.mapInArrow(_ends, "name binary, n long, least long, ends string")
    # one row of each path, by its least conversation
    return convs.select("conv_id", "path", "lengths").join(ends.select(F.col("least").alias("conv_id"), "least", "n", "ends"), "conv_id").drop("conv_id")


# -- the trie -------------------------------------------------------------------------
def merged_spines(parts: DataFrame) -> DataFrame:
    """The nodes of the shards' spines, each merged from its parts (rows of NODES with a side)."""
    once = parts.groupBy("shard", "key").agg(*[F.first(c).alias(c) for c in ("parent_key", "conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved", "length", "ends")])
    childless = F.sum((F.col("n_children") == 0).cast("long"))
    nodes = once.groupBy("key").agg(
        F.first("parent_key").alias("parent_key"), F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("children"),
        F.sum("n_leaves").alias("leaves"), F.sum("saved").alias("sum_saved"), F.first("length").alias("length"), F.max("ends").alias("ends"), F.count(F.lit(1)).alias("parts"), childless.alias("childless"),
    )
    nodes = materialize(nodes)
    # a child in several parts is one child
    again = nodes.where("parts > 1").groupBy(F.col("parent_key").alias("key")).agg(F.sum(F.col("parts") - 1).alias("again"))
    # what a node's parts count too often or too little, taken off it and all above it
    leaf_off = F.col("childless") - F.when(F.col("childless") == F.col("parts"), 1).otherwise(0)
    off = nodes.where("parts > 1").select("key", leaf_off.alias("leaf_off"), ((F.col("parts") - 1) * F.col("length")).alias("more"))
    places = parts.select("key", "shard", "side", "depth")
    chosen = places.groupBy("key").agg(F.min(F.struct("shard", "side")).alias("at")).select("key", "at.*").join(off, "key")
    spines = places.join(chosen, ["key", "shard", "side"], "left")
    below = Window.partitionBy("shard", "side").orderBy(F.desc("depth"))
    spines = spines.select("key", F.sum(F.coalesce("leaf_off", F.lit(0))).over(below).alias("leaf_off"), F.sum(F.coalesce("more", F.lit(0))).over(below).alias("more"))
    sums = spines.groupBy("key").agg(F.sum("leaf_off").alias("leaf_off"), F.sum("more").alias("more"))
    rows = nodes.join(again, "key", "left").join(sums, "key")
    n_children = (F.col("children") - F.coalesce("again", F.lit(0))).alias("n_children")
    return rows.select("key", "parent_key", "conv_id", "depth", "n_convs", n_children, (F.col("leaves") - F.col("leaf_off")).alias("n_leaves"), (F.col("sum_saved") + F.col("more")).alias("saved"), "ends")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per node of the trie of all rebuilt conversations; see the module for its columns' meaning."""
    paths = distinct_paths(rebuilt(conversations))
    dealt = materialize(paths).repartitionByRange("path").sortWithinPartitions("path")
    dealt = dealt.select(F.spark_partition_id().cast("long").alias("task"), "path", "lengths", "n", "least", "ends")
    most = SHARD_NODES
    nodes = materialize(dealt.mapInArrow(lambda batches: _shards(most, batches), NODES))
    parts = nodes.where("side IS NOT NULL")
    spines = materialize(merged_spines(parts))
    figures = ("conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved", "ends")
    # parents on a spine: joined by shard too, so that the many children of a common node are spread
    heads = parts.select("shard", "key").distinct().join(spines.select("key", F.col("conv_id").alias("head")), "key").select("shard", F.col("key").alias("parent_key"), "head")
    others = nodes.where("side IS NULL")
    final = others.where("parent_key IS NULL").select(*figures, "parent_conv_id").unionByName(
        others.where("parent_key IS NOT NULL").join(heads, ["shard", "parent_key"]).select(*figures, F.col("head").alias("parent_conv_id"))
    )
    up = spines.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    final = final.unionByName(spines.join(up, "parent_key", "left").select(*figures, "parent_conv_id"))
    ends = F.coalesce("ends", F.lit(NOTHING)).alias("ends_sha256")
    return final.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), ends)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


#: Nodes named by their turns' digests on end; each node's own figures are carried up along the turns of its least conversation.
SQL = f"""
WITH {CRC_TABLE}, turns AS (
  SELECT conv_id, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest, length(coalesce(text, '')) AS size,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base, {crc32_sql("list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)")} % 6 AS h FROM (SELECT DISTINCT conv_id FROM turns), crc_table
), rebuilt AS (
  SELECT t.conv_id, pos, digest, size FROM turns t JOIN convs c ON t.conv_id = c.conv_id WHERE pos > h
  UNION ALL SELECT c.conv_id, pos, digest, size FROM convs c JOIN turns t ON t.conv_id = c.base WHERE pos <= h
), steps AS (
  SELECT conv_id, 0 AS depth, '' AS node, 0 AS size FROM convs
  UNION ALL SELECT conv_id, row_number() OVER w, string_agg(digest, '') OVER (w ROWS UNBOUNDED PRECEDING), size FROM rebuilt WINDOW w AS (PARTITION BY conv_id ORDER BY pos)
), nodes AS (
  SELECT node, depth, CASE WHEN depth > 0 THEN left(node, length(node) - 32) END AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * min(size) AS own FROM steps GROUP BY node, depth
), children AS (
  SELECT parent AS node, count(*) AS n_children FROM nodes WHERE parent IS NOT NULL GROUP BY 1
), sums AS (
  SELECT s.node, sum(own)::BIGINT AS saved_tokens, count(*) FILTER (WHERE c.node IS NULL) AS n_leaves
  FROM nodes n LEFT JOIN children c ON c.node = n.node JOIN steps s ON s.conv_id = n.conv_id AND s.depth <= n.depth GROUP BY 1
), ends AS (
  SELECT node, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids FROM (SELECT conv_id, arg_max(node, depth) AS node FROM steps GROUP BY 1) GROUP BY 1
)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM nodes n LEFT JOIN nodes p ON p.node = n.parent LEFT JOIN children c ON c.node = n.node JOIN sums s ON s.node = n.node LEFT JOIN ends e ON e.node = n.node
"""
