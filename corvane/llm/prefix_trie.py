"""Prefix tries of conversations: ternary search trees over turn ids, one a range shard, merged along shard boundaries."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.ranges import numbered
from corvane.functions.storage import durable

#: A shard ends after so many turns.
SHARD_TURNS = 500_000
NO_ENDS = hashlib.sha256(b"").hexdigest()
ROOT = bytes(16)


class TernaryTree:
    """A ternary search tree of sequences: node 0 is the root, `same` leads to the tree of a node's children."""

    def __init__(self) -> None:
        self.turn, self.low, self.same, self.high = [0], [-1], [-1], [-1]
        self.size, self.n, self.least = [0], [0], [None]
        self.ends: dict[int, list[int]] = {}

    def _child(self, turn: int, size: int) -> int:
        for k, v in ((self.turn, turn), (self.low, -1), (self.same, -1), (self.high, -1), (self.size, size), (self.n, 0), (self.least, None)):
            k.append(v)
        return len(self.turn) - 1

    def _met(self, node: int, member: int) -> None:
        self.n[node] += 1
        if self.least[node] is None or member < self.least[node]:
            self.least[node] = member

    def insert(self, turns: list[int], sizes: list[int], member: int) -> None:
        at = 0
        self._met(0, member)
        for turn, size in zip(turns, sizes, strict=True):
            arm, q = self.same, at
            while (to := arm[q]) >= 0 and self.turn[to] != turn:
                arm, q = (self.low if turn < self.turn[to] else self.high), to
            if to < 0:
                arm[q] = to = self._child(turn, size)
            at = to
            self._met(at, member)
        self.ends.setdefault(at, []).append(member)

    def insert_sorted(self, rows: list[tuple[int, list[int], list[int]]]) -> None:
        """Rows (member, turns, sizes) in order of turns: the middle one first, then those of either half, so that trees stay low."""
        spans = [(0, len(rows))]
        while spans:
            low, high = spans.pop()
            if low < high:
                middle = (low + high) // 2
                member, turns, sizes = rows[middle]
                self.insert(turns, sizes, member)
                spans += [(low, middle), (middle + 1, high)]

    def children(self, node: int) -> Iterator[int]:
        stack = [self.same[node]]
        while stack:
            if (q := stack.pop()) >= 0:
                yield q
                stack += [self.low[q], self.high[q]]

    def path(self, turns: list[int]) -> Iterator[tuple[int, bytes]]:
        """The nodes of a sequence, and a key for each that is the same in all shards."""
        at, key = 0, ROOT
        yield at, key
        for turn in turns:
            to = self.same[at]
            while self.turn[to] != turn:
                to = (self.low if turn < self.turn[to] else self.high)[to]
            at, key = to, hashlib.blake2b(key + turn.to_bytes(8, "little"), digest_size=16).digest()
            yield at, key

    def nodes(self, edge: dict[int, bytes]) -> Iterator[tuple]:
        """Rows of _SHARD: nodes that lie inside the shard, whole, and those on its edges (with their keys), without what other edge nodes add."""
        order, parent, depth = [0], {0: -1}, {0: 0}
        for node in order:
            for q in self.children(node):
                parent[q], depth[q] = node, depth[node] + 1
                order.append(q)
        kids, leaves, saved = ([0] * len(order) for _ in range(3))
        for node in reversed(order):
            up, on_edge = parent[node], node in edge
            if not on_edge:
                leaves[node] += not kids[node]
                saved[node] += (self.n[node] - 1) * self.size[node]
                kids[up] += 1
                leaves[up] += leaves[node]
                saved[up] += saved[node]
        for node in order:
            up = parent[node]
            ends = ",".join(map(str, sorted(self.ends.get(node, ()))))
            if node not in edge:
                whole = up not in edge
                sha = hashlib.sha256(ends.encode()).hexdigest()
                yield 0, self.least[node], depth[node], self.least[up] if whole else None, self.n[node], kids[node], leaves[node], saved[node], None, sha, None, None if whole else edge[up]
                continue
            yield 1, self.least[node], depth[node], None, self.n[node], kids[node], leaves[node], saved[node], self.size[node], None, edge[node], edge.get(up)
            if ends:
                yield 2, min(self.ends[node]), depth[node], None, None, None, None, None, None, ends, edge[node], None


_SHARD = pa.schema(
    [(k, pa.int64()) for k in ("kind", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "size")]
    + [("ends", pa.string()), ("key", pa.binary()), ("parent_key", pa.binary())]
)
_MERGED = pa.schema([(k, pa.int64()) for k in ("conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens")] + [("key", pa.binary()), ("parent_key", pa.binary())])
_ENDS = pa.schema([("key", pa.binary()), ("ends_sha256", pa.string())])
_DDL = {pa.int64(): "long", pa.string(): "string", pa.binary(): "binary"}


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {_DDL[f.type]}" for f in schema)


def _batches(rows: Iterator[tuple], schema: pa.Schema, at_once: int = 10_000) -> Iterator[pa.RecordBatch]:
    made: list[tuple] = []
    for row in rows:
        made.append(row)
        if len(made) >= at_once:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*made, strict=True), schema, strict=True)], schema=schema)
            made = []
    if made:
        yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*made, strict=True), schema, strict=True)], schema=schema)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _shard_nodes(shard_turns: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def built(rows: list[tuple]) -> Iterator[tuple]:
            tree = TernaryTree()
            tree.insert_sorted(rows)
            edge = dict([*tree.path(rows[0][1]), *tree.path(rows[-1][1])])
            yield from tree.nodes(edge)

        def all_nodes() -> Iterator[tuple]:
            rows, turns = [], 0
            for row in _rows(batches):
                rows.append(row)
                turns += 1 + len(row[1])
                if turns >= shard_turns:
                    yield from built(rows)
                    rows, turns = [], 0
            if rows:
                yield from built(rows)

        yield from _batches(all_nodes(), _SHARD)

    return run


def _accumulated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edge nodes, deepest first, with what edge nodes below them add; only nodes of one depth are held."""

    def rows() -> Iterator[tuple]:
        below: dict[bytes, list[int]] = {}
        for _, level in groupby(_rows(batches), key=lambda r: r[1]):
            here: dict[bytes, list[int]] = {}
            for conv, depth, n, kids, leaves, saved, size, key, parent in level:
                more = below.get(key, (0, 0, 0))
                kids += more[0]
                leaves += more[1] + (not kids)
                saved += more[2] + (n - 1) * size
                if parent is not None:
                    up = here.setdefault(parent, [0, 0, 0])
                    up[0] += 1
                    up[1] += leaves
                    up[2] += saved
                yield conv, depth, n, kids, leaves, saved, key, parent
            below = here

    yield from _batches(rows(), _MERGED)


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per key the digest of its members, which come in order and are not held."""

    def rows() -> Iterator[tuple]:
        for key, parts in groupby(_rows(batches), key=lambda r: r[0]):
            sha = hashlib.sha256()
            for i, (_, _, ends) in enumerate(parts):
                sha.update(b"," * (i > 0) + ends.encode())
            yield key, sha.hexdigest()

    yield from _batches(rows(), _ENDS)


def turn_sequences(conversations: DataFrame) -> DataFrame:
    """conv_id, turns (array of dictionary ids) and sizes (of bytes of each text): the rows of a conversation in order.

    Ordered by turn, nulls first, then role and text; a null role or text is an empty one; repeated rows are
    turns. Rows without conv_id belong to no conversation and go. The dictionary numbers distinct pairs of role
    and text by their md5.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    given = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), "turn", text("role").alias("role"), text("text").alias("text"))
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    digest = F.unhex(F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text")))
    placed = durable(given.select("conv_id", F.row_number().over(order).alias("place"), digest.alias("digest"), F.octet_length("text").alias("size")))
    dictionary = numbered(placed.select("digest").distinct(), ["digest"], "id")
    turn = F.struct("place", "id", "size")
    met = placed.join(dictionary, "digest").groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("t"))
    return met.select("conv_id", F.col("t.id").alias("turns"), F.col("t.size").alias("sizes"))


def rebuilt(sequences: DataFrame, every: int = 5, most: int = 8) -> DataFrame:
    """Conversations that share their beginnings: conv_id c gets the first h turns of conversation c - c % every, then its own after the first h.

    h is crc32 of c in decimals, modulo most + 1. All turns of a shorter conversation are taken, none of an absent one.
    """
    own = durable(sequences)
    heads = own.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("_base"), *(F.slice(k, 1, most).alias(f"_{k}") for k in ("turns", "sizes")))
    h = (F.crc32(F.col("conv_id").cast("string")) % (most + 1)).cast("int")
    met = own.withColumns({"_at": F.col("conv_id") - F.col("conv_id") % every, "_h": h}).join(heads, F.col("_at") == F.col("_base"), "left")
    joined = lambda k: F.concat(F.slice(F.coalesce(f"_{k}", F.array().cast("array<long>")), F.lit(1), F.col("_h")), F.slice(k, F.col("_h") + 1, F.size(k)))
    return met.select("conv_id", joined("turns").alias("turns"), joined("sizes").alias("sizes"))


def prefix_nodes(sequences: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """A row for each distinct beginning of sequences (conv_id, turns, sizes), the empty one, the root, included.

    conv_id (the smallest member), depth, parent_conv_id (null for the root), n_convs, n_children, n_leaves (of
    the subtree, itself included), saved_tokens (over the subtree, (n_convs - 1) times the bytes of each node's
    last text), ends_sha256 (of the members that end here, ascending, joined by commas). Sequences without turns
    end at the root. No sequence, no row.

    Sequences are range-partitioned and sorted; each shard of a bounded number of turns (and one sequence at
    least) becomes a ternary search tree, and equal sequences may fall to several shards. Only nodes on the first and the
    last path of a shard can be in others too: these are merged by their keys, in parallel, and then summed up
    from the deepest on by one task, which reads two paths a shard and holds one depth of them.
    """
    dealt = sequences.select("conv_id", F.col("turns").cast("array<long>").alias("turns"), F.col("sizes").cast("array<long>").alias("sizes"))
    parts = int(sequences.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = durable(dealt).repartitionByRange(parts, "turns", "conv_id").sortWithinPartitions("turns", "conv_id")
    made = durable(ordered.mapInArrow(_shard_nodes(shard_turns), _ddl(_SHARD)))

    total = {k: F.sum(k).alias(k) for k in ("n_convs", "n_children", "n_leaves", "saved_tokens")}
    edges = made.where("kind = 1").groupBy("key", "parent_key", "depth", "size").agg(F.min("conv_id").alias("conv_id"), *total.values())
    deepest = edges.select("conv_id", "depth", *total, "size", "key", "parent_key").repartition(1).sortWithinPartitions(F.desc("depth"), "key")
    merged = durable(deepest.mapInArrow(_accumulated, _ddl(_MERGED)))
    ends = made.where("kind = 2").select("key", "conv_id", "ends").repartition("key").sortWithinPartitions("key", "conv_id").mapInArrow(_digested, _ddl(_ENDS))

    columns = ["conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "parent_key"]
    on_edges = merged.join(ends, "key", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NO_ENDS))).select(*columns, F.lit(None).cast("long").alias("_up"))
    inside = made.where("kind = 0").withColumnRenamed("ends", "ends_sha256").select(*columns, F.col("parent_conv_id").alias("_up"))
    parents = merged.select(F.col("key").alias("_key"), F.col("conv_id").alias("_parent"))
    # rows whose parent lies inside a shard know it already and need no join
    known = inside.where(F.col("parent_key").isNull()).select(*columns[:-1], F.col("_up").alias("parent_conv_id"))
    asked = inside.where(F.col("parent_key").isNotNull()).unionByName(on_edges)
    told = asked.join(parents, F.col("parent_key") == F.col("_key"), "left").select(*columns[:-1], F.col("_parent").alias("parent_conv_id"))
    return known.unionByName(told).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
