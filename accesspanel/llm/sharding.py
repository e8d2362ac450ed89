"""Shards of near equal bytes by best-fit-decreasing bin packing.

Rows of equal text are one indivisible group. Groups enter, largest first, the shard
with the least remaining capacity that still holds them; remaining capacities are
kept in a balanced search tree. Only sizes decide, so the packing runs on a table of
size classes (exact up to 2 ** PRECISION bytes, rounded up by at most one part in
2 ** (PRECISION - 1) above) and their numbers of groups; its size is bounded whatever the input.
Spark then ranks the groups within their class and hands each its shard.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accesspanel.llm.common import materialize, with_rank

SHARDS = 16
PRECISION = 12
#: Above 2 ** (PRECISION + 51) classes end: 2 ** (PRECISION - 1) for each further bit of a BIGINT.
MAX_CLASSES = 1 << 18


class Capacities:
    """Balanced search tree (AVL) of (remaining capacity, shard)."""

    @dataclass
    class Node:
        key: tuple[int, int]
        left: Capacities.Node | None = None
        right: Capacities.Node | None = None
        height: int = 1

    def __init__(self) -> None:
        self.root: Capacities.Node | None = None

    def add(self, key: tuple[int, int]) -> None:
        self.root = self._add(self.root, key)

    def remove(self, key: tuple[int, int]) -> None:
        self.root = self._remove(self.root, key)

    def tightest(self, size: int) -> tuple[int, int] | None:
        """The least capacity of at least ``size``; of equal ones the first shard."""
        node, best = self.root, None
        while node:
            if node.key >= (size, -1):
                best, node = node.key, node.left
            else:
                node = node.right
        return best

    def _add(self, node: Node | None, key: tuple[int, int]) -> Node:
        if node is None:
            return self.Node(key)
        if key < node.key:
            node.left = self._add(node.left, key)
        else:
            node.right = self._add(node.right, key)
        return self._balanced(node)

    def _remove(self, node: Node | None, key: tuple[int, int]) -> Node | None:
        if node is None:
            return None
        if key < node.key:
            node.left = self._remove(node.left, key)
        elif key > node.key:
            node.right = self._remove(node.right, key)
        elif node.left is None or node.right is None:
            return node.left or node.right
        else:
            after = node.right
            while after.left:
                after = after.left
            node.key = after.key
            node.right = self._remove(node.right, after.key)
        return self._balanced(node)

    @staticmethod
    def _height(node: Node | None) -> int:
        return node.height if node else 0

    def _balanced(self, node: Node) -> Node:
        lean = self._height(node.left) - self._height(node.right)
        if lean > 1:
            if self._height(node.left.left) < self._height(node.left.right):
                node.left = self._turn(node.left, "right", "left")
            return self._turn(node, "left", "right")
        if lean < -1:
            if self._height(node.right.right) < self._height(node.right.left):
                node.right = self._turn(node.right, "left", "right")
            return self._turn(node, "right", "left")
        node.height = 1 + max(self._height(node.left), self._height(node.right))
        return node

    def _turn(self, node: Node, up: str, other: str) -> Node:
        """Rotates the child on side ``up`` above the node."""
        child = getattr(node, up)
        setattr(node, up, getattr(child, other))
        setattr(child, other, node)
        for n in (node, child):
            n.height = 1 + max(self._height(n.left), self._height(n.right))
        return child


Run = tuple[int, int, int]  # size class, shard, groups


def best_fit_decreasing(classes: Sequence[tuple[int, int]], capacity: int) -> tuple[list[Run], int]:
    """Packs ``classes`` of (size, number of groups) into shards of ``capacity``; a larger
    group has a shard to itself. Returns the runs and the number of shards.

    Groups of one size act alike, and a shard that is tightest stays so while it
    takes more of them, so a run is placed at once."""
    free, runs, shards = Capacities(), [], 0
    for size, groups in sorted(classes, reverse=True):
        while groups:
            room = free.tightest(size)
            if room is None:
                room = max(capacity, size), shards
                shards += 1
            else:
                free.remove(room)
            taken = min(groups, room[0] // size)
            runs.append((size, room[1], taken))
            groups -= taken
            if room[0] - taken * size > 0:
                free.add((room[0] - taken * size, room[1]))
    return runs, shards


def pack(classes: Sequence[tuple[int, int]], shards: int) -> list[Run]:
    """The packing of least capacity found that needs no more than ``shards``.

    Groups larger than an equal share of what is left have a shard of their own.
    The capacity of the others starts at their equal share and grows by steps that double."""
    classes = sorted(((s, n) for s, n in classes if n), reverse=True)
    alone: list[Run] = []
    rest = dict(classes)
    left = shards
    for size, groups in classes:
        while groups and left > 1 and size * left > sum(s * n for s, n in rest.items()):
            alone.append((size, shards - left, 1))
            groups -= 1
            left -= 1
            rest[size] = groups
    rest = {s: n for s, n in rest.items() if n}
    if not rest:
        return alone
    total = sum(s * n for s, n in rest.items())
    capacity, step = max(-(-total // left), max(rest)), 1
    while True:
        runs, used = best_fit_decreasing(list(rest.items()), capacity)
        if used <= left:
            break
        capacity += step
        step *= 2
    shift = shards - left
    return alone + [(size, shard + shift, n) for size, shard, n in runs]


def size_class(size: Column) -> Column:
    """Sizes rounded up to PRECISION leading bits."""
    shift = F.greatest(F.lit(0), F.length(F.bin(size)) - PRECISION)
    unit = F.pow(F.lit(2.0), shift).cast("bigint")
    return F.ceil(size / unit).cast("bigint") * unit


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """One row per row of ``docs`` (``doc_id``, ``text``): ``size`` (UTF-8 bytes plus 1),
    ``text_crc32``, ``law`` (``bytes``), ``shard``, ``slot`` (0 up within the shard, by
    ``doc_id``, NULL ids first) and ``grown_shard`` (always NULL under this law).

    NULL and empty texts are one group of size-1 rows. Repeated rows share a shard
    and get slots of their own. A group larger than an equal share has a shard to
    itself, so sizes are then as equal as whole groups allow. With fewer groups
    than shards, some stay empty. No rows: none."""
    raw = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rows = materialize(
        docs.select(
            F.col("doc_id").cast("bigint").alias("doc_id"),
            (F.length(raw) + 1).cast("bigint").alias("size"),
            F.crc32(raw).alias("text_crc32"),
            F.unhex(F.sha2(raw, 256)).alias("content"),
        ),
        "sizes",
    )
    groups = rows.groupBy("content").agg(F.sum("size").alias("bytes")).withColumn("class", size_class(F.col("bytes")))
    classes = groups.groupBy("class").agg(F.count("*").alias("n")).limit(MAX_CLASSES + 1).collect()
    if len(classes) > MAX_CLASSES:
        raise ValueError("more size classes than PRECISION allows")
    ends: dict[int, list[tuple[int, int]]] = {}
    for size, shard, n in pack([(r["class"], r["n"]) for r in classes], shards):
        done = ends.setdefault(size, [])
        done.append((shard, n + (done[-1][1] if done else 0)))
    plan = rows.sparkSession.createDataFrame(
        [(size, [s for s, _ in e], [n for _, n in e]) for size, e in ends.items()],
        "class bigint, shards array<int>, ends array<bigint>",
    )
    ranked = with_rank(groups.select("content", "class"), "class", "content", "place")
    # the first run that ends beyond the group's place
    run = F.size(F.filter("ends", lambda e: e <= F.col("place")))
    chosen = ranked.join(plan, "class").select("content", F.get("shards", run).alias("shard"))
    placed = rows.join(chosen, "content").drop("content")
    return with_rank(placed, "shard", "doc_id", "slot").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
