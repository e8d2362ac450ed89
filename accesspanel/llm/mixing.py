"""Mixing of sources to target weights by a multivariate-hypergeometric splitting tree.

All words of a source lie on one line: its documents in a hashed order, one after the
other. The line is cut into blocks of equal length. A source's target fixes exactly how
many block draws it gives: whole rounds of all its blocks, and part of one more round.
The draws of all sources are dealt to output shards of equal size by a tree that halves
the shards again and again: each half gets a multivariate-hypergeometric share of what is
left, so every way of dealing is as likely as any other. Sources are dealt in buckets first
and within each bucket after, in a task of its own.

Which block a draw is follows from a keyed permutation of the block numbers, so draws are
disjoint within a round, nothing is exchanged, and each document works out which pieces of
it are drawn. Only the rows of a shard are then put into a random order, where they lie.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accesspanel.llm.common import materialize, row_hash, ship_package, slices
from accesspanel.operators.joins import lookup_join
from accesspanel.operators.windows import global_rank, running_totals

#: Weights of the sources in order, repeating, and the most rounds of a source.
WEIGHTS = (5, 2, 1)
ROUNDS = 3
#: Words of a block, unless the corpus would have more than MAX_BLOCKS of them.
BLOCK_WORDS = 256
MAX_BLOCKS = 1 << 29
SHARDS = 64
SEED = 42
#: Buckets that sources are dealt in; only their totals reach the driver.
BUCKETS = 256
#: Blocks that a worker permutes at once.
BLOCKS_AT_ONCE = 1 << 18

BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True


def word_starts(data: np.ndarray) -> np.ndarray:
    """Positions at which a word starts, in bytes of text."""
    word = ~BLANK[data]
    word[1:] &= BLANK[data[:-1]]
    return np.flatnonzero(word)


def count_words(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Words of each text; the texts of a slice are scanned as one array."""
    n = []
    for t in batch.column("text").cast(pa.binary()):
        data = np.frombuffer(t.as_buffer(), np.uint8) if t.is_valid else np.zeros(0, np.uint8)
        step = 1 << 24
        total = 0
        for start in range(0, len(data), step):
            piece = data[max(0, start - 1) : start + step]
            total += len(word_starts(piece)) - int(start > 0 and not BLANK[piece[0]])
        n.append(total)
    return pa.RecordBatch.from_arrays(
        [batch.column("doc_id"), batch.column("source"), batch.column("row"), pa.array(n, pa.int64())],
        ["doc_id", "source", "row", "size"],
    )


def sizes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``doc_id``, ``source``, ``row`` (row_hash) and ``size`` in words of every row."""
    ship_package(docs.sparkSession)
    rows = docs.select(
        F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"),
        F.col(f"`{text}`").cast("string").alias("text"),
        F.col(f"`{source}`").cast("string").alias("source"),
        row_hash(doc_id, text).alias("row"),
    )

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                yield count_words(part)

    return rows.mapInArrow(counted, "doc_id bigint, source string, row bigint, size bigint")


def targets(sources: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``sources`` (``source_size``, ``weight``) with ``target``: shares of all words by
    weight. A source stops at ``rounds`` times its size and what is above goes to the others by weight,
    until none is above. Each step is one aggregate; the driver holds its two sums."""
    words, weights = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    most = F.col("source_size") * rounds
    rate = words / weights if weights else 0.0
    while True:
        full = most.cast("double") <= F.col("weight") * F.lit(rate)
        held, rest = sources.agg(
            F.coalesce(F.sum(F.when(full, most)), F.lit(0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0))
        ).first()
        new = (words - held) / rest if rest else rate
        if new <= rate:
            break
        rate = new
    return sources.withColumn("target", F.least(most.cast("double"), F.col("weight") * F.lit(float(rate))))


def split_tree(quota: np.ndarray, capacity: np.ndarray, seed: int) -> np.ndarray:
    """Draws of each source (``quota``) dealt to shards of the given ``capacity``, which add
    up to the same: rows are shards. The shards are halved down to one; the left half's
    share of every source is multivariate-hypergeometric."""
    out = np.zeros((len(capacity), len(quota)), np.int64)

    def deal(left: int, right: int, have: np.ndarray) -> None:
        if right - left == 1:
            out[left] = have
            return
        middle = (left + right) // 2
        rng = np.random.default_rng([seed & 0xFFFFFFFF, left, right])
        share = rng.multivariate_hypergeometric(have, int(capacity[left:middle].sum()), method="marginals")
        deal(left, middle, share)
        deal(middle, right, have - share)

    if len(capacity) and len(quota):
        deal(0, len(capacity), np.asarray(quota, np.int64))
    return out


def even(total: int, shards: int) -> np.ndarray:
    """Sizes of ``shards`` shards that hold ``total`` draws, at most one apart."""
    return np.array([total // shards + (i < total % shards) for i in range(shards)], np.int64)


def mix64(x: np.ndarray, key: np.ndarray | int) -> np.ndarray:
    """A 64-bit hash of each number under a key."""
    x = x.astype(np.uint64) + np.asarray(key, np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permuted(block: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Place of each block among the ``n`` blocks of its source: four rounds of a Feistel
    network over the least power of four that holds n, again until the place is below n."""
    bits = np.maximum(1, (np.ceil(np.log2(np.maximum(n, 2).astype(np.float64))).astype(np.int64) + 1) // 2).astype(np.uint64)
    mask = (np.uint64(1) << bits) - np.uint64(1)
    out = block.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        b, m, k = bits[todo], mask[todo], key[todo]
        left, right = out[todo] >> b, out[todo] & m
        for step in range(4):
            left, right = right, left ^ (mix64(right, k + np.uint64(step + 1)) & m)
        out[todo] = left << b | right
        todo = todo[out[todo] >= n[todo].astype(np.uint64)]
    return out.astype(np.int64)


def source_key(source: str | None, seed: int) -> int:
    """Key of a source's permutation; that of NULL is no text's."""
    return xxhash.xxh64_intdigest(b"\x00" if source is None else b"\x01" + source.encode(), seed & 0xFFFFFFFF)


def part_round(size: np.ndarray, length: np.ndarray, n: np.ndarray, last_place: np.ndarray, words: np.ndarray):
    """Blocks drawn in the round that is not whole, and the words the last of them lacks, so
    that exactly ``words`` (less than the source's) are taken. The source's last block may
    be shorter than ``length``; ``last_place`` is its place."""
    missing = n * length - size
    drawn = -(-words // length)
    short = (words > 0) & (last_place < drawn)
    reach = drawn * length - np.where(short, missing, 0)
    # with the short block among them, one block more may be needed
    more = (words > 0) & (reach < words)
    drawn = drawn + more
    reach = drawn * length - np.where((words > 0) & (last_place < drawn), missing, 0)
    return drawn, np.where(words > 0, reach - words, 0)


PLAN = "rounds bigint, drawn bigint, cut bigint, blocks bigint, length bigint, key bigint, last_place bigint"


def plan(sources: DataFrame, shards: int, seed: int, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Draws of each source and where those of each shard end (``ends``, running over the
    source's draws)."""
    total = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    length = max(block_words, -(-total // MAX_BLOCKS))

    def draws(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            size = f["source_size"].to_numpy(np.int64)
            n = np.maximum(1, -(-size // length))
            key = np.array([source_key(s, seed) for s in f["source"].astype(object).where(f["source"].notna(), None)], np.uint64)
            last = permuted(n - 1, n, key)
            words = np.rint(f["target"].to_numpy(np.float64)).astype(np.int64)
            rounds = np.where(size > 0, words // np.maximum(size, 1), 0)
            drawn, cut = part_round(size, np.full(len(size), length), n, last, np.where(size > 0, words - rounds * size, 0))
            yield f.assign(
                rounds=rounds, drawn=drawn, cut=cut, blocks=n, length=length, key=key.view(np.int64), last_place=last
            )

    schema = f"source string, source_size bigint, target double, {PLAN}"
    drawn = materialize(sources.select("source", "source_size", "target").mapInPandas(draws, schema), "draws")
    quota = (F.col("rounds") * F.col("blocks") + F.col("drawn")).alias("quota")
    keyed = drawn.select("*", quota, F.pmod(F.xxhash64("source"), F.lit(BUCKETS)).cast("int").alias("bucket"))
    in_bucket = np.zeros(BUCKETS, np.int64)
    for r in keyed.groupBy("bucket").agg(F.sum("quota").alias("n")).collect():
        in_bucket[r["bucket"]] = r["n"]
    dealt = split_tree(in_bucket, even(int(in_bucket.sum()), shards), seed)

    def deal(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("source", na_position="last")
        bucket = int(f["bucket"].iloc[0])
        parts = split_tree(f["quota"].to_numpy(np.int64), dealt[:, bucket], seed + 1 + bucket)
        return f.assign(ends=list(np.cumsum(parts, axis=0).T)).drop(columns=["bucket", "quota"])

    return keyed.groupBy("bucket").applyInPandas(deal, f"{schema}, ends array<bigint>")


def pieces_of(
    start: int, size: int, source_size: int, rounds: int, drawn: int, cut: int, blocks: int, length: int, key: int, ends: np.ndarray
) -> tuple[np.ndarray, ...]:
    """Pieces drawn of one document that lies at ``start`` of its source's line: arrays of
    shard, draw, first word and number of words. Of the last block drawn in the round that
    is not whole the last ``cut`` words are left out."""
    out: list[tuple[np.ndarray, ...]] = []
    first, stop = start // length, -(-(start + size) // length)
    for a in range(first, stop if size else first, BLOCKS_AT_ONCE):
        block = np.arange(a, min(a + BLOCKS_AT_ONCE, stop))
        place = permuted(block, np.full(len(block), blocks), np.full(len(block), key, np.uint64))
        low = np.maximum(block * length, start)
        high = np.minimum((block + 1) * length, source_size)
        for turn in range(rounds + 1):
            whole = turn < rounds
            end = np.minimum(high if whole else high - np.where(place == drawn - 1, cut, 0), start + size)
            some = (end > low) & (whole | (place < drawn))
            draw = place[some] + turn * blocks
            out.append((np.searchsorted(ends, draw, "right"), draw, low[some] - start, end[some] - low[some]))
    if not out:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


PIECES = "array<struct<shard: int, draw: bigint, first_word: bigint, words: bigint>>"
_PIECE = pa.struct([("shard", pa.int32()), ("draw", pa.int64()), ("first_word", pa.int64()), ("words", pa.int64())])


def _drawn(batch: pa.RecordBatch) -> pa.RecordBatch:
    get = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in ("start", "size", "source_size", "rounds", "drawn", "cut", "blocks", "length", "key")}
    lists = batch.column("ends")
    offsets, values = [0], [[], [], [], []]
    total = 0
    for i in range(batch.num_rows):
        row = {n: int(v[i]) for n, v in get.items()}
        row["key"] &= 0xFFFFFFFFFFFFFFFF
        found = pieces_of(**row, ends=np.asarray(lists[i].values))
        for column, v in zip(values, found, strict=True):
            column.append(v)
        total += len(found[0])
        offsets.append(total)
    flat = [np.concatenate(v) if v else np.zeros(0, np.int64) for v in values]
    items = pa.StructArray.from_arrays([pa.array(v.astype(np.int32) if k == 0 else v) for k, v in enumerate(flat)], fields=list(_PIECE))
    pieces = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), items)
    keep = ["doc_id", "row", "source", "size", "source_size", "target"]
    return pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pieces], [*keep, "pieces"])


def mix(
    docs: DataFrame,
    shards: int = SHARDS,
    seed: int = SEED,
    block_words: int = BLOCK_WORDS,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """Every row as ``doc_id``, ``row``, ``source``, ``size``, ``source_size``, ``target`` and
    ``pieces``: the runs of its words that the mix takes, each with the output shard and the
    source's draw it belongs to.

    Words taken of a source add up to its target, rounded to a whole word. A NULL or empty
    text has size 0 and no pieces; a NULL source is one more source, the last. Equal rows are
    rows of their own. With equal tables the result is the same whatever the partitions
    (rows equal in id, source and text may swap pieces). No rows: none."""
    counted = materialize(sizes(docs, doc_id, text, source), "sizes")
    summed = counted.groupBy("source").agg(F.sum("size").alias("source_size"))
    ordered = summed.select("*", F.struct(F.col("source").isNull().alias("last"), "source").alias("place"))
    ranked = global_rank(ordered, "place", "source_size")
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), ((F.col("rank") - 1) % len(WEIGHTS) + 1).cast("int"))
    sources = materialize(ranked.select("source", "source_size", weight.cast("bigint").alias("weight")), "sources")
    planned = materialize(plan(targets(sources), shards, seed, block_words), "plan")
    # rows alike in all columns are told apart by where they lie in the written files
    lined = counted.withColumns({"place": F.xxhash64("row", F.lit(seed)), "copy": F.monotonically_increasing_id()})
    placed = running_totals(
        lined.withColumn("tie", F.struct("row", "copy")), {"end": "size"}, "place", "tie", ["source"]
    ).drop("place", "copy", "tie")
    rows = lookup_join(placed, planned, "source", null_is_key=True).withColumn("start", F.col("end") - F.col("size"))
    ship_package(docs.sparkSession)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                yield _drawn(batch.slice(start, 512))

    wanted = ["doc_id", "row", "source", "start", "size", "source_size", "target", "rounds", "drawn", "cut", "blocks", "length", "key", "ends"]
    schema = f"doc_id bigint, row bigint, source string, size bigint, source_size bigint, target double, pieces {PIECES}"
    return rows.select(*wanted).mapInArrow(pieces, schema)


def mixed_texts(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The mix itself: one row per piece with ``shard``, ``place`` (a random number; rows lie in
    its order within their shard), ``doc_id``, ``source`` and the piece's ``text``, its words
    single-spaced. Write it with ``partitionBy("shard")``."""
    at = mix(docs, shards, seed, block_words).select(F.col("row").alias("_row"), "source", "pieces")
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = texts.withColumn("_row", row_hash()).dropDuplicates(["_row"])
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    opened = texts.join(at, "_row").select("doc_id", "source", words.alias("w"), F.inline("pieces"))
    cut = F.array_join(F.slice("w", (F.col("first_word") + 1).cast("int"), F.col("words").cast("int")), " ")
    rows = opened.select(
        "shard", F.xxhash64("source", "draw", F.lit(seed)).alias("place"), "doc_id", "source", "first_word", cut.alias("text")
    )
    return rows.repartitionByRange("shard", "place").sortWithinPartitions("shard", "place", "doc_id", "first_word")


def mixture(docs: DataFrame) -> DataFrame:
    """How much the mix takes of every row: ``doc_id``, ``size``, ``source_size``, ``target``
    (of its source), ``taken`` (words, repeats counted) and ``n_pieces``."""
    mixed = mix(docs)
    taken = F.aggregate("pieces", F.lit(0).cast("bigint"), lambda total, p: total + p["words"])
    return mixed.select("doc_id", "size", "source_size", "target", taken.alias("taken"), F.size("pieces").alias("n_pieces"))
