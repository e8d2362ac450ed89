"""Near-duplicate groups by SimHash, with Golay-code fuzzy keys for the search.

A fingerprint of 64 bits is cut into segments of 23, 23 and 18 bits (the last
padded with zeros). The perfect binary Golay code (23, 12, 7) maps every 23-bit
word to one of 4096 codewords; a word and its one-bit neighbours decode to one or
six codeword indices, so two words that differ in at most one bit share an index.

With at most three differing bits in all, either every segment has at most one
(then the three index sets meet: a 36-bit key), or one has two or three, and of
the other two one is equal and the other has at most one (an exact segment plus an
index: six ordered pairs of segments). Each distinct fingerprint emits these
keys, rows of one key are compared, and linked pairs become component edges.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accesspanel.llm.common import components, free_name, held, materialize, per_slice, row_hash, text_rows, utf8

#: Fixed value: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1 generates the binary Golay code.
GENERATOR = 0b101011100011
WIDTHS = (23, 23, 18)
MAX_BITS = 3
#: Shingles counted at once, so that a long text needs no more memory than a short one.
SHINGLES_AT_ONCE = 1 << 16
#: Fingerprints that one task turns into keys.
FINGERPRINTS_A_TASK = 50_000
#: Rows of one key compared in one task; larger groups are cut into blocks of half this.
GROUP_ROWS = 2048


def fingerprint(text: bytes, words: int = 3) -> int:
    """SimHash of the word shingles, repeats included. A bit is set if set in
    over half the XXH64 values (seed 42). No words: 0."""
    tokens = text.lower().split()
    if not tokens:
        return 0
    size = min(words, len(tokens))
    n = len(tokens) - size + 1
    ones = np.zeros(64, np.int64)
    for start in range(0, n, SHINGLES_AT_ONCE):
        run = tokens[start : min(start + SHINGLES_AT_ONCE, n) + size - 1]
        joined = b" ".join(run)
        ends = np.cumsum([len(t) + 1 for t in run]) - 1
        begins = [0, *(ends[: len(ends) - size] + 1).tolist()]
        digest = xxhash.xxh64_intdigest
        h = [digest(joined[a:b], 42) for a, b in zip(begins, ends[size - 1 :].tolist(), strict=True)]
        bits = np.unpackbits(np.array(h, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return sum(1 << int(i) for i in np.flatnonzero(2 * ones > n))


def fingerprints(docs: DataFrame, words: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``row`` (row_hash) and ``fp`` (the 64 bits as a signed BIGINT) of every row."""

    def hashed(batch: pa.RecordBatch) -> pa.RecordBatch:
        held("fingerprints", dict)
        fp = np.array([fingerprint(t, words) for t in utf8(batch.column("text"))], np.uint64)
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("row"), pa.array(fp.view(np.int64))], ["doc_id", "row", "fp"]
        )

    rows = text_rows(docs, doc_id, text).withColumn("row", row_hash())
    return rows.mapInArrow(per_slice(hashed), "doc_id bigint, row bigint, fp bigint")


def codeword_index() -> np.ndarray:
    """Index of the nearest codeword for each of the 2**23 words: every word is
    within three bits of exactly one."""
    messages = np.arange(4096, dtype=np.int64)
    codewords = np.zeros(4096, np.int64)
    for bit in range(12):
        codewords ^= np.where(messages >> bit & 1, GENERATOR << bit, 0)
    table = np.zeros(1 << 23, np.uint16)
    one = [1 << i for i in range(23)]
    two = [a | b for i, a in enumerate(one) for b in one[:i]]
    three = [a | b | c for i, a in enumerate(one) for j, b in enumerate(one[:i]) for c in one[:j]]
    for error in [0, *one, *two, *three]:
        table[codewords ^ error] = messages
    return table


def fuzzy_indices(word: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(n, 6) codeword indices of each word and its one-bit neighbours, and which
    of the six are new."""
    table = held("Golay codewords", codeword_index)
    flips = np.array([0, *(1 << i for i in range(width))], np.int64)
    found = np.sort(table[word[:, None] ^ flips[None, :]].astype(np.int64), axis=1)
    new = np.ones(found.shape, bool)
    new[:, 1:] = found[:, 1:] != found[:, :-1]
    slot = np.cumsum(new, axis=1) - 1
    out = np.zeros((len(word), 6), np.int64)
    rows = np.broadcast_to(np.arange(len(word))[:, None], found.shape)
    out[rows[new], slot[new]] = found[new]
    return out, np.arange(6)[None, :] <= slot[:, -1:]


def search_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the fingerprints: row numbers and key values."""
    bits = fp.view(np.uint64)
    at = (0, WIDTHS[0], WIDTHS[0] + WIDTHS[1])
    seg = [((bits >> np.uint64(a)) & np.uint64((1 << w) - 1)).astype(np.int64) for a, w in zip(at, WIDTHS, strict=True)]
    fuzzy = [fuzzy_indices(s, w) for s, w in zip(seg, WIDTHS, strict=True)]
    row, key = [], []

    def add(value: np.ndarray, valid: np.ndarray) -> None:
        which = np.broadcast_to(np.arange(len(fp)).reshape(-1, *[1] * (value.ndim - 1)), value.shape)
        row.append(which[valid])
        key.append(value[valid])

    (a, av), (b, bv), (c, cv) = fuzzy
    add(
        a[:, :, None, None] << 24 | b[:, None, :, None] << 12 | c[:, None, None, :],
        av[:, :, None, None] & bv[:, None, :, None] & cv[:, None, None, :],
    )
    tag = 0
    for i in range(3):
        for j in range(3):
            if i != j:
                tag += 1
                add(tag << 40 | seg[i][:, None] << 12 | fuzzy[j][0], fuzzy[j][1])
    return np.concatenate(row), np.concatenate(key)


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, 2048):
            fp = batch.column("fp").slice(start, 2048).to_numpy().astype(np.int64)
            row, key = search_keys(fp)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[row])], ["key", "fp"])


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits; counted unsigned, as the count of a negative number is that of its size."""
    return np.bitwise_count((a ^ b).view(np.uint64))


def spanning(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what links of at most MAX_BITS connect: each member to
    the least member it reaches."""
    near = distance(fp[:, None], fp[None, :]) <= MAX_BITS
    label = np.arange(len(fp))
    while True:
        least = np.where(near, label[None, :], len(fp)).min(axis=1)
        least = np.minimum(least, least[least])
        if (least == label).all():
            break
        label = least
    other = label != np.arange(len(fp))
    return fp[other], fp[label[other]]


def _linked(keys: np.ndarray, fps: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Edges within runs of equal keys (sorted): small runs by shifted
    comparison of the whole array, larger ones by a matrix of their own."""
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    length = np.diff(np.r_[starts, len(keys)])
    small = (length >= 2) & (length <= 16)
    first = np.repeat(starts[small], length[small])
    offset = np.arange(len(first)) - np.repeat(np.cumsum(length[small]) - length[small], length[small])
    index, left = first + offset, np.repeat(length[small], length[small]) - offset
    for lag in range(1, 16):
        index, left = index[left > lag], left[left > lag]
        if not len(index):
            break
        a, b = fps[index], fps[index + lag]
        near = distance(a, b) <= MAX_BITS
        yield a[near], b[near]
    for s, n in zip(starts[length > 16], length[length > 16], strict=True):
        yield spanning(fps[s : s + n])


def _compare(split: bool):
    """Reads rows sorted by key and yields edges (``hot`` false). With ``split``,
    rows of a key with over GROUP_ROWS members come out as they are (``hot``)."""

    def frame(hot: bool, key: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(a), hot)), pa.array(key), pa.array(a), pa.array(b)], ["hot", "key", "a", "b"]
        )

    def settled(keys: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
        if split and len(keys):
            _, inverse, n = np.unique(keys, return_inverse=True, return_counts=True)
            hot = n[inverse] > GROUP_ROWS
            if hot.any():
                yield frame(True, keys[hot], fps[hot], fps[hot])
                keys, fps = keys[~hot], fps[~hot]
        if len(keys):
            for a, b in _linked(keys, fps):
                if len(a):
                    yield frame(False, np.zeros(len(a), np.int64), a, b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps = np.zeros(0, np.int64), np.zeros(0, np.int64)
        streaming = None  # key of a run already known to be hot
        for batch in batches:
            keys = np.r_[keys, batch.column("key").to_numpy()]
            fps = np.r_[fps, batch.column("fp").to_numpy()]
            if streaming is not None:
                cut = np.searchsorted(keys, streaming, "right")
                yield frame(True, keys[:cut], fps[:cut], fps[:cut])
                keys, fps = keys[cut:], fps[cut:]
                streaming = None if len(keys) else streaming
            if not len(keys):
                continue
            cut = np.searchsorted(keys, keys[-1], "left")
            yield from settled(keys[:cut], fps[:cut])
            keys, fps = keys[cut:], fps[cut:]
            if split and len(keys) > GROUP_ROWS:
                streaming = keys[0]
                yield frame(True, keys, fps, fps)
                keys, fps = keys[:0], fps[:0]
        yield from settled(keys, fps)

    return run


EDGES = "hot boolean, key bigint, a bigint, b bigint"


def near_edges(fps: DataFrame) -> DataFrame:
    """Edges (``a``, ``b``) that connect all distinct fingerprints ``fp`` within
    MAX_BITS of each other.

    One shuffle deals the keys. A key with over GROUP_ROWS members is cut into
    blocks, and each pair of blocks is a group of its own, so no task holds
    more; a group yields at most one edge per member, never all its pairs."""
    fps = materialize(fps.select("fp"), "distinct_fingerprints")
    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # by number: each row becomes some 180, which the size of the rows does not show
    parts = max(parts, -(-fps.count() // FINGERPRINTS_A_TASK))
    keyed = fps.repartition(parts).mapInArrow(_keyed, "key bigint, fp bigint")
    found = materialize(
        keyed.repartition("key").sortWithinPartitions("key").mapInArrow(_compare(True), EDGES), "golay"
    )
    hot = found.where("hot").select("key", F.col("a").alias("fp"))
    sizes = hot.groupBy("key").agg(F.ceil(F.count("*") / F.lit(GROUP_ROWS // 2)).cast("int").alias("blocks"))
    mine = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    paired = (
        hot.join(sizes, "key")
        .withColumn("mine", mine)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other")).alias("key"), "fp")
    )
    again = paired.repartition("key").sortWithinPartitions("key").mapInArrow(_compare(False), EDGES)
    return found.where("not hot").select("a", "b").unionByName(again.select("a", "b"))


def _grouped(marked: DataFrame) -> DataFrame:
    """``fp`` and ``root``, the fingerprint that names its component."""
    distinct = marked.select("fp").distinct()
    roots = components(near_edges(distinct))
    return distinct.join(roots, F.col("fp") == F.col("node"), "left").select(
        "fp", F.coalesce("root", "fp").alias("root")
    )


def near_duplicates(docs: DataFrame, words: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hex digits) and ``component_id`` of every row.

    A NULL or wordless text has fingerprint zero and is linked like any other;
    repeated rows share a component. A NULL id never names a component while
    another id can; one of only NULL ids has a NULL component. No rows: none."""
    marked = materialize(fingerprints(docs, words, doc_id, text), "fingerprints")
    named = _grouped(marked).join(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "fp")
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = named.join(ids, "root").select("fp", "component_id")
    return marked.join(classes, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def rows_that_stay(docs: DataFrame, marked: DataFrame, grouped: DataFrame) -> DataFrame:
    """The rows of ``docs`` of least rank in each ``root`` of ``grouped`` (``fp``, ``root``)."""
    rank = F.struct(F.col("doc_id").isNull(), "doc_id", "row")
    least = marked.groupBy("fp", "row").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))
    stay = materialize(
        least.join(grouped, "fp").groupBy("root").agg(F.min_by(F.struct("row", "n"), rank).alias("best")), "stay"
    ).select("best.*")
    key = free_name(docs, "stay_row")
    kept = docs.join(stay.select(F.col("row").alias(key)), row_hash() == F.col(key))
    if not stay.where("n > 1").isEmpty():  # the same row more than once
        kept = kept.dropDuplicates([key])
    return kept.select(*docs.columns)


def one_of_each(docs: DataFrame, words: int = 3) -> DataFrame:
    """The rows of ``docs`` that stand for their component, as they are: the one of
    least ``doc_id`` (a NULL id last), and of equal ids that of least row_hash."""
    marked = materialize(fingerprints(docs, words), "fingerprints")
    return rows_that_stay(docs, marked, _grouped(marked))
