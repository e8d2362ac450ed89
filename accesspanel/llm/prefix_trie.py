"""Prefix trie of conversations, with subtree totals by time-forward processing.

A node is a distinct sequence of first turns. It is named by its depth and the XOR of
two 64-bit hashes of each of its turns (place, role and text), a running value that is
summed over ranges, so that no conversation, however long, is gathered in one task.

Totals of subtrees flow from children to parents. Nodes of one conversation only need no
message: what is below them is a single path. The others are cut into shards: a node with
many conversations is a heavy one, of which there is a bounded number, and what hangs
below heavy nodes are the shards. Within each shard the nodes are externally sorted by
reverse level order (Spark's sort, which spills); each takes the messages for it from a
spilling priority queue and sends its totals to its parent. Messages that leave a shard are
summed per heavy node, and the heavy nodes are then processed the same way.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accesspanel.llm.common import materialize, ship_package, with_rank
from accesspanel.operators.joins import lookup_join
from accesspanel.operators.windows import running_totals

#: Turns shared with the first conversation of a block of BLOCK ids: crc32 of the id, modulo SHARED.
BLOCK = 20
SHARED = 4
#: Heavy nodes hold over 1 / HEAVY_NODES of all turns each way, so there are at most so many.
HEAVY_NODES = 50_000
LEAST_HEAVY = 64
#: Messages a queue holds in memory before it writes a sorted run to its own unnamed scratch file.
QUEUE_ROWS = 1 << 20
#: Ids hashed as one piece of text.
ENDS_AT_ONCE = 1 << 16

NODE = ["depth", "h1", "h2"]
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def shared_turns(conv_id: Column) -> Column:
    """How many first turns a conversation takes from the first one of its block."""
    return (F.crc32(conv_id.cast("string").cast("binary")) % SHARED).cast("bigint")


def turns_of(conversations: DataFrame) -> DataFrame:
    """``conv_id``, ``turn``, ``role``, content hashes ``c1`` and ``c2`` and ``words`` of each row.
    Rows without a conversation id belong to none and are left out."""
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return (
        conversations.where(F.col("conv_id").cast("bigint").isNotNull())
        .select(
            F.col("conv_id").cast("bigint").alias("conv_id"),
            F.col("turn").cast("bigint").alias("turn"),
            role.alias("role"),
            text.alias("text"),
        )
        .select(
            "conv_id",
            "turn",
            "role",
            F.xxhash64("role", "text").alias("c1"),
            F.xxhash64(F.lit("second"), F.reverse("role"), "text", F.octet_length("text")).alias("c2"),
            F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint").alias("words"),
        )
    )


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rebuilt conversations: their turns (``conv_id``, ``depth`` from 1, ``c1``, ``c2``,
    ``words``, ``last``) and their lengths (``conv_id``, ``length``)."""
    order = F.struct("turn", "role", "c1", "c2")
    ranked = with_rank(turns.withColumn("order", order), "conv_id", "order", "rank").select(
        "conv_id", (F.col("rank") + 1).alias("pos"), "c1", "c2", "words"
    )
    ranked = materialize(ranked, "ranked_turns")
    own = ranked.groupBy("conv_id").agg(F.max("pos").alias("n"))
    base = F.col("conv_id") - F.col("conv_id") % BLOCK
    given = own.where(F.col("conv_id") % BLOCK == 0).select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    h = shared_turns(F.col("conv_id"))
    head = F.least("h", F.coalesce("base_n", F.lit(0).cast("bigint")))
    convs = own.withColumns({"h": h, "base": base}).join(given, "base", "left").withColumn("head", head)
    length = F.col("head") + F.greatest(F.lit(0).cast("bigint"), F.col("n") - F.col("h"))
    convs = materialize(convs.select("conv_id", "base", "h", "head", length.alias("length")), "conversations")
    heads = ranked.where((F.col("conv_id") % BLOCK == 0) & (F.col("pos") < SHARED)).withColumnRenamed("conv_id", "base")
    taken = convs.where("head > 0").join(heads, "base").where("pos <= head")
    kept = lookup_join(ranked, convs.drop("base"), "conv_id").where("pos > h")
    content = ["c1", "c2", "words"]
    rows = taken.select("conv_id", F.col("pos").alias("depth"), *content, "length").unionByName(
        kept.select("conv_id", (F.col("pos") - F.col("h") + F.col("head")).alias("depth"), *content, "length")
    )
    return rows.select("conv_id", "depth", *content, (F.col("depth") == F.col("length")).alias("last")), convs


class SpillingQueue:
    """Messages to nodes, taken in the order of their nodes (deepest first). Messages to one
    node are added up. Beyond ``limit`` rows in memory a sorted run goes to a scratch file
    that has no name and ends with the task, as Spark's own spills do."""

    TYPE = np.dtype([("level", "<i8"), ("h1", "<i8"), ("h2", "<i8"), ("children", "<i8"), ("leaves", "<i8"), ("saved", "<i8")])
    KEY = ["level", "h1", "h2"]

    def __init__(self, limit: int = QUEUE_ROWS) -> None:
        self.limit = limit
        self.fresh: list[np.ndarray] = []
        self.held = 0
        #: Sorted runs: what is loaded of each, and where the rest lies (file, offset, rows left).
        self.runs: list[list] = []

    @classmethod
    def added_up(cls, rows: np.ndarray) -> np.ndarray:
        if not len(rows):
            return rows
        rows = rows[np.lexsort((rows["h2"], rows["h1"], rows["level"]))]
        new = np.ones(len(rows), bool)
        new[1:] = False
        for k in cls.KEY:
            new[1:] |= rows[k][1:] != rows[k][:-1]
        at = np.flatnonzero(new)
        out = rows[at].copy()
        for c in ("children", "leaves", "saved"):
            out[c] = np.add.reduceat(rows[c], at)
        return out

    def push(self, rows: np.ndarray) -> None:
        """``level`` is minus the depth, so that ascending order is reverse level order."""
        if len(rows):
            self.fresh.append(rows)
            self.held += len(rows)
        if self.held > self.limit:
            run = self.added_up(np.concatenate(self.fresh))
            self.fresh, self.held = [], 0
            file = tempfile.TemporaryFile()
            file.write(run.tobytes())
            self.runs.append([run[:0], file, 0, len(run)])

    def _load(self, run: list) -> None:
        """The next block of a run."""
        file, at, left = run[1], run[2], run[3]
        n = min(left, max(1, self.limit // 16))
        file.seek(at)
        block = np.frombuffer(file.read(n * self.TYPE.itemsize), self.TYPE)
        run[0], run[2], run[3] = np.concatenate([run[0], block]), at + n * self.TYPE.itemsize, left - n

    def pop(self, level: int, h1: int, h2: int) -> np.ndarray:
        """Takes all messages up to a node, added up and in order."""
        key = (level, h1, h2)
        out = []
        if self.fresh:
            rows = self.added_up(np.concatenate(self.fresh))
            cut = self._until(rows, key)
            out.append(rows[:cut])
            self.fresh = [rows[cut:]] if cut < len(rows) else []
            self.held = len(rows) - cut
        for run in self.runs:
            while True:
                if not len(run[0]) and run[3]:
                    self._load(run)
                cut = self._until(run[0], key)
                out.append(run[0][:cut])
                run[0] = run[0][cut:]
                if len(run[0]) or not run[3]:
                    break
        for run in self.runs:
            if not len(run[0]) and not run[3]:
                run[1].close()
        self.runs = [r for r in self.runs if len(r[0]) or r[3]]
        return self.added_up(np.concatenate(out)) if out else np.zeros(0, self.TYPE)

    @staticmethod
    def _until(rows: np.ndarray, key: tuple[int, int, int]) -> int:
        """Number of sorted rows up to a key."""
        a, b = 0, len(rows)
        while a < b:
            m = (a + b) // 2
            if (int(rows["level"][m]), int(rows["h1"][m]), int(rows["h2"][m])) <= key:
                a = m + 1
            else:
                b = m
        return a


#: Nodes with what their single-conversation children and messages from below already add
#: (``children``, ``leaves``, ``saved``) and their own saving; ``top`` ones report to a heavy node.
IN = ["depth", "h1", "h2", "p1", "p2", "own", "children", "leaves", "saved", "top"]
OUT = "up boolean, depth bigint, h1 bigint, h2 bigint, children bigint, leaves bigint, saved bigint"


def time_forward(limit: int = QUEUE_ROWS):
    """Totals of nodes that come in reverse level order: one row per node, and per ``top``
    node one message (``up``) to its parent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queue = SpillingQueue(limit)
        for batch in batches:
            get = {c: batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in IN}
            depth = get["depth"]
            starts = np.flatnonzero(np.r_[True, depth[1:] != depth[:-1]]) if len(depth) else []
            for a, b in zip(starts, [*starts[1:], len(depth)], strict=True):
                yield from _level({c: v[a:b] for c, v in get.items()}, queue)

    return run


def _level(get: dict[str, np.ndarray], queue: SpillingQueue) -> Iterator[pa.RecordBatch]:
    """Nodes of one depth, in the order of their names."""
    depth = int(get["depth"][0])
    got = queue.pop(-depth, int(get["h1"][-1]), int(get["h2"][-1]))
    children, leaves, saved = (get[c].copy() for c in ("children", "leaves", "saved"))
    if len(got):
        names = np.zeros(len(get["h1"]), np.dtype([("h1", "<i8"), ("h2", "<i8")]))
        names["h1"], names["h2"] = get["h1"], get["h2"]
        wanted = np.zeros(len(got), names.dtype)
        wanted["h1"], wanted["h2"] = got["h1"], got["h2"]
        at = np.searchsorted(names, wanted)
        for total, c in ((children, "children"), (leaves, "leaves"), (saved, "saved")):
            np.add.at(total, at, got[c])
    saved += get["own"]
    leaves = np.where(children == 0, 1, leaves)
    yield _totals(False, get["depth"], get["h1"], get["h2"], children, leaves, saved)
    top = get["top"] != 0
    if top.any():
        one = np.ones(int(top.sum()), np.int64)
        yield _totals(True, get["depth"][top] - 1, get["p1"][top], get["p2"][top], one, leaves[top], saved[top])
    sent = np.zeros(int((~top).sum()), SpillingQueue.TYPE)
    sent["level"], sent["h1"], sent["h2"] = 1 - depth, get["p1"][~top], get["p2"][~top]
    sent["children"], sent["leaves"], sent["saved"] = 1, leaves[~top], saved[~top]
    queue.push(sent)


def _totals(up: bool, *columns: np.ndarray) -> pa.RecordBatch:
    names = ["up", "depth", "h1", "h2", "children", "leaves", "saved"]
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(columns[0]), up)), *map(pa.array, columns)], names)


def processed(nodes: DataFrame, shard: list[str], limit: int = QUEUE_ROWS) -> DataFrame:
    """:func:`time_forward` over nodes dealt by the columns ``shard`` (none: one task)."""
    dealt = nodes.repartition(*shard) if shard else nodes.coalesce(1)
    in_order = dealt.sortWithinPartitions(F.col("depth").desc(), "h1", "h2")
    return in_order.select(*IN).mapInArrow(time_forward(limit), OUT)


def ends(rows: DataFrame) -> DataFrame:
    """``ends_sha256`` of nodes at which several conversations end: the digest of their ids
    in order. Ids are put into text where they lie in the order, so that only the pieces of a
    node, not its ids, go through one task, which hashes them one after the other."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, ENDS_AT_ONCE):
                part = batch.slice(start, ENDS_AT_ONCE)
                get = [part.column(c).to_numpy(zero_copy_only=False) for c in (*NODE, "conv_id")]
                new = np.ones(len(get[0]), bool)
                new[1:] = False
                for v in get[:3]:
                    new[1:] |= v[1:] != v[:-1]
                at = np.flatnonzero(new)
                stop = [*at[1:], len(new)]
                text = [b",".join(str(i).encode() for i in get[3][a:b].tolist()) for a, b in zip(at, stop, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [*[pa.array(v[at]) for v in get], pa.array(text, pa.binary())], [*NODE, "conv_id", "ids"]
                )

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, state = None, None
        done: list[tuple] = []

        def frame() -> pa.RecordBatch:
            columns = list(zip(*done, strict=True)) if done else [[], [], [], []]
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [*NODE, "ends_sha256"])

        for batch in batches:
            for *node, ids in zip(*[batch.column(c).to_pylist() for c in (*NODE, "ids")], strict=True):
                if node != name:
                    if state is not None:
                        done.append((*name, state.hexdigest()))
                    name, state = node, hashlib.sha256(ids)
                else:
                    state.update(b"," + ids)
            yield frame()
            done.clear()
        if state is not None:
            done.append((*name, state.hexdigest()))
            yield frame()

    schema = "depth bigint, h1 bigint, h2 bigint"
    ordered = rows.select(*NODE, "conv_id").repartitionByRange("h1", "h2", "depth", "conv_id")
    joined = ordered.sortWithinPartitions("h1", "h2", "depth", "conv_id").mapInArrow(pieces, f"{schema}, conv_id bigint, ids binary")
    return (
        joined.repartition("h1", "h2", "depth")
        .sortWithinPartitions("h1", "h2", "depth", "conv_id")
        .mapInArrow(digests, f"{schema}, ends_sha256 string")
    )


def prefix_trie(conversations: DataFrame, heavy_nodes: int = HEAVY_NODES, queue_rows: int = QUEUE_ROWS) -> DataFrame:
    """One row per node of the trie of the rebuilt conversations: ``conv_id`` (least member),
    ``depth``, ``parent_conv_id`` (NULL for the root), ``n_convs``, ``n_children``, ``n_leaves``,
    ``saved_tokens`` and ``ends_sha256``.

    A NULL role or text is empty; a NULL turn comes first. Turns with equal numbers come in the
    order of role and a hash of the content; repeated rows are turns of their own. Rows
    without ``conv_id`` are left out. No conversation: no rows, not even a root."""
    ship_package(conversations.sparkSession)
    rows, convs = rebuilt(turns_of(conversations))
    # written first: Spark would take the size of the joins before it for their product
    rows = materialize(rows, "rebuilt")
    hashed = rows.withColumns({"g1": F.xxhash64("depth", "c1", "c2"), "g2": F.xxhash64("c2", "depth", "c1")})
    placed = running_totals(
        hashed.drop("c1", "c2"), {"h1": "g1", "h2": "g2"}, "depth", "conv_id", ["conv_id"], combine="xor"
    )
    placed = materialize(placed, "prefixes")
    parent = {"p1": F.col("h1").bitwiseXOR(F.col("g1")), "p2": F.col("h2").bitwiseXOR(F.col("g2"))}
    nodes = (
        placed.withColumns(parent)
        .groupBy(*NODE)
        .agg(
            F.min("conv_id").alias("conv_id"),
            F.count("*").alias("n_convs"),
            F.max("words").alias("words"),
            F.min("p1").alias("p1"),
            F.min("p2").alias("p2"),
            F.count(F.when(F.col("last"), 1)).alias("n_ends"),
            F.min(F.when(F.col("last"), F.col("conv_id"))).alias("end_id"),
        )
    )
    zero = F.lit(0).cast("bigint")
    empty = F.col("length") == 0
    root = convs.agg(
        F.min("conv_id").alias("conv_id"),
        F.count("*").alias("n_convs"),
        F.count(F.when(empty, 1)).alias("n_ends"),
        F.min(F.when(empty, F.col("conv_id"))).alias("end_id"),
    ).where("n_convs > 0")
    fixed = [zero.alias(c) for c in (*NODE, "words", "p1", "p2")]
    nodes = materialize(nodes.unionByName(root.select("*", *fixed)), "nodes")
    n_rows = nodes.agg(F.coalesce(F.sum("n_convs"), F.lit(0))).first()[0]
    # nodes of over T conversations: their conversations add up to the rows, so at most rows / T of them
    least = max(min(LEAST_HEAVY, n_rows // 4), -(-n_rows // heavy_nodes))
    is_heavy = (F.col("n_convs") > least) | (F.col("depth") == 0)
    heavy = materialize(nodes.where(is_heavy), "heavy")
    several = nodes.where((F.col("n_convs") > 1) & ~is_heavy)
    single = nodes.where((F.col("n_convs") == 1) & (F.col("depth") > 0))
    # parents: a heavy one is looked up in the bounded table, a light one by its name
    up_heavy = F.broadcast(heavy.select((F.col("depth") + 1).alias("depth"), F.col("h1").alias("p1"), F.col("h2").alias("p2"), F.col("conv_id").alias("heavy_parent")))
    up_light = several.select((F.col("depth") + 1).alias("depth"), F.col("h1").alias("p1"), F.col("h2").alias("p2"), F.col("conv_id").alias("light_parent"))
    placed_nodes = nodes.join(up_heavy, ["depth", "p1", "p2"], "left").join(up_light, ["depth", "p1", "p2"], "left")
    own_parent = F.when(F.col("n_convs") == 1, F.col("conv_id"))
    family = placed_nodes.withColumn("parent_conv_id", F.when(F.col("depth") > 0, F.coalesce("heavy_parent", "light_parent", own_parent)))
    family = materialize(family, "family")
    # of a node's single children all that matters is how many there are
    lone = family.where((F.col("n_convs") == 1) & (F.col("depth") > 0) & (F.col("heavy_parent").isNotNull() | F.col("light_parent").isNotNull()))
    lone = lone.groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("h1"), F.col("p2").alias("h2")).agg(F.count("*").alias("lone"))
    # the shard of a conversation's light nodes: the first of its nodes that is not heavy
    at_heavy = F.broadcast(heavy.select(*NODE))
    shard_of = (
        placed.select("conv_id", *NODE).join(at_heavy, NODE, "left_anti").groupBy("conv_id").agg(F.min(F.struct(*NODE)).alias("shard"))
    )
    light = family.where((F.col("n_convs") > 1) & ~is_heavy).join(lone, NODE, "left").join(shard_of, "conv_id")
    own = F.col("words") * (F.col("n_convs") - 1)
    alone = F.coalesce("lone", zero)
    prepared = light.select(
        *NODE, "p1", "p2", own.alias("own"), alone.alias("children"), alone.alias("leaves"), zero.alias("saved"),
        F.col("heavy_parent").isNotNull().alias("top"), "shard",
    )
    below = materialize(processed(prepared, ["shard"], queue_rows), "light_totals")
    messages = below.where("up").groupBy(*NODE).agg(*[F.sum(c).alias(f"sent_{c}") for c in ("children", "leaves", "saved")])

    def with_sent(c: str) -> Column:
        return (F.coalesce(f"sent_{c}", zero) + (zero if c == "saved" else alone)).alias(c)

    crown = heavy.join(lone, NODE, "left").join(messages, NODE, "left").select(
        *NODE, "p1", "p2", own.alias("own"), with_sent("children"), with_sent("leaves"), with_sent("saved"),
        F.lit(False).alias("top"),
    )
    crown = crown.withColumn("own", F.when(F.col("depth") == 0, zero).otherwise(F.col("own")))
    above = processed(crown, [], queue_rows)
    totals = materialize(below.where("not up").unionByName(above.where("not up")), "totals")
    finished = lookup_ends(placed, convs)
    out = family.join(totals, NODE, "left").join(finished, NODE, "left")
    path = F.col("n_ends") == 0
    is_single = F.col("children").isNull()
    return out.select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        F.when(is_single, path.cast("bigint")).otherwise(F.col("children")).alias("n_children"),
        F.coalesce("leaves", F.lit(1).cast("bigint")).alias("n_leaves"),
        F.coalesce("saved", zero).alias("saved_tokens"),
        F.when(path, F.lit(EMPTY_SHA))
        .when(F.col("n_ends") == 1, F.sha2(F.col("end_id").cast("string").cast("binary"), 256))
        .otherwise(F.col("ends_sha256"))
        .alias("ends_sha256"),
    )


def lookup_ends(placed: DataFrame, convs: DataFrame) -> DataFrame:
    """Digests per node at which conversations end, the root among them."""
    zero = F.lit(0).cast("bigint")
    at_root = convs.where("length = 0").select(*[zero.alias(c) for c in NODE], "conv_id")
    return ends(placed.where("last").select(*NODE, "conv_id").unionByName(at_root))


#: The same rows in SQL: turns as lists, subtrees by equal prefixes.
ORACLE_SQL = r"""
WITH RECURSIVE tab AS MATERIALIZED (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_concat([i::BIGINT], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
    FROM range(256) r(i))),
src AS MATERIALIZED (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT conv_id, conv_id - conv_id % 20 AS base, count(*) AS n FROM src GROUP BY conv_id),
crc AS (
  SELECT conv_id, base, n, xor(list_reduce(
    list_concat([4294967295], list_transform(string_split(conv_id::VARCHAR, ''), lambda s: ascii(s)::BIGINT)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 4 AS h FROM ids, tab),
turns AS (
  SELECT c.conv_id, 0 AS part, s.pos, s.role, s.text FROM crc c JOIN src s ON s.conv_id = c.base AND s.pos <= c.h
  UNION ALL
  SELECT c.conv_id, 1, s.pos, s.role, s.text FROM crc c JOIN src s ON s.conv_id = c.conv_id AND s.pos > c.h),
paths AS MATERIALIZED (
  SELECT i.conv_id, coalesce(list({'r': role, 't': text} ORDER BY part, pos) FILTER (WHERE part IS NOT NULL), []) AS path
  FROM ids i LEFT JOIN turns u ON u.conv_id = i.conv_id GROUP BY i.conv_id),
members AS (SELECT conv_id, d, path[1:d] AS prefix, len(path) AS length FROM paths, unnest(range(0, len(path) + 1)) x(d)),
nodes AS MATERIALIZED (
  SELECT prefix, d, min(conv_id) AS conv_id, count(*) AS n_convs,
    CASE WHEN d = 0 THEN 0 ELSE len(regexp_extract_all(prefix[d].t, '[^\x20\x09-\x0D]+')) END AS words,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE length = d), '')) AS ends_sha256
  FROM members GROUP BY prefix, d),
kids AS (SELECT prefix[1:d - 1] AS prefix, count(*) AS n FROM nodes WHERE d > 0 GROUP BY ALL),
full_nodes AS MATERIALIZED (SELECT n.*, coalesce(k.n, 0) AS n_children FROM nodes n LEFT JOIN kids k ON k.prefix = n.prefix),
below AS (
  SELECT f.prefix[1:u.a] AS prefix, sum((f.n_children = 0)::INT) AS n_leaves,
    sum((f.n_convs - 1) * f.words) AS saved FROM full_nodes f, unnest(range(0, f.d + 1)) u(a) GROUP BY ALL)
SELECT f.conv_id, f.d::BIGINT AS depth, CASE WHEN f.d > 0 THEN p.conv_id END AS parent_conv_id, f.n_convs::BIGINT AS n_convs,
  f.n_children::BIGINT AS n_children, b.n_leaves::BIGINT AS n_leaves, b.saved::BIGINT AS saved_tokens, f.ends_sha256
FROM full_nodes f JOIN below b ON b.prefix = f.prefix LEFT JOIN full_nodes p ON f.d > 0 AND p.prefix = f.prefix[1:f.d - 1]
"""
