"""Interpolated modified Kneser-Ney n-gram model of text, over bytes.

Spark counts every n-gram of the highest order over all training rows (each task
sums its own first); shorter orders follow from the distinct longer n-grams, and
probabilities and back-offs from joins with the order below. The model is one array
of records per order, sorted by a 64-bit hash of the n-gram and written to the shared
folder by ranges, which workers map into memory, so workers of one machine share the
pages.

A text is its words joined by single spaces and one end symbol, so its probability
is that of the word sequence and the end. Bytes keep the model small (its size
follows the alphabet and the order, not the vocabulary) and give unseen words a
probability of their own.
"""

from __future__ import annotations

import contextlib
import fcntl
import os
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from urllib.parse import unquote, urlsplit

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accesspanel.llm.common import discard, held, materialize, slices, utf8

ORDER = 6
END = b"\n"
#: Of one order: hashes in order, log10 probability (NaN: only a context) and log10
#: back-off (NaN: no context) of each n-gram.
Table = tuple[np.ndarray, np.ndarray, np.ndarray]
TYPES = ("<u8", "<f4", "<f4")
STORED = pa.schema([("level", pa.int32()), ("hash", pa.int64()), ("log_p", pa.float32()), ("backoff", pa.float32())])
SIGN = np.uint64(1 << 63)
#: Entries of one file of a model.
FILE_ENTRIES = 1_000_000
#: n-grams a counting task holds before it passes its sums on.
HELD_NGRAMS = 1_000_000
PIECE_BYTES = 1 << 20


SPACES = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")


def normal(text: bytes, lower: bool = False) -> bytes:
    """The words of a text, single-spaced."""
    text = (text.lower() if lower else text).translate(SPACES)
    while b"  " in text:
        text = text.replace(b"  ", b" ")
    return text.strip(b" ")


def pieces(texts: list[bytes], order: int) -> Iterator[list[tuple[int, bytes]]]:
    """Groups of (text number, bytes) of about PIECE_BYTES, so that a long text needs no
    more memory than a short one. Each starts with the ``order - 1`` bytes before
    it (END pads the start, which no word contains) and the last ends in END."""
    group, size = [], 0
    for i, text in enumerate(texts):
        body = END * (order - 1) + text + END
        for a in range(0, len(text) + 1, PIECE_BYTES):
            part = body[a : min(a + PIECE_BYTES, len(text) + 1) + order - 1]
            group.append((i, part))
            size += len(part)
            if size >= PIECE_BYTES:
                yield group
                group, size = [], 0
    if group:
        yield group


def ngrams(parts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram ending at each byte after the first ``order - 1`` of each part,
    as an integer, and where each part starts in the result."""
    data = np.frombuffer(b"".join(parts), np.uint8).astype(np.uint64)
    grams = np.zeros(len(data) - order + 1, np.uint64)
    for j in range(order):
        grams <<= np.uint64(8)
        grams |= data[j : len(data) - order + 1 + j]
    lengths = np.array([len(t) - order + 1 for t in parts], np.int64)
    starts = np.cumsum(lengths) - lengths
    index = np.arange(int(lengths.sum())) + np.repeat(np.arange(len(parts)) * (order - 1), lengths)
    return grams[index], starts


def _groups(batch: pa.RecordBatch, order: int, lower: bool) -> Iterator[list[tuple[int, bytes]]]:
    for part in slices(batch, "text"):
        yield from pieces([normal(t, lower) for t in utf8(part.column("text"))], order)


def _counter(order: int, lower: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        key, count = np.concatenate(keys), np.concatenate(counts)
        by = np.argsort(key, kind="stable")
        key, count = key[by], count[by]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        return key[first], np.add.reduceat(count, first)

    def frame(key: np.ndarray, count: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(count)], ["gram", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("n-gram counts", dict)
        keys: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        for batch in batches:
            for group in _groups(batch, order, lower):
                grams, _ = ngrams([part for _, part in group], order)
                key, count = np.unique(grams, return_counts=True)
                keys.append(key)
                counts.append(count.astype(np.int64))
                if len(keys) >= 4:
                    key, count = summed(keys, counts)
                    keys, counts = [key], [count]
                if len(key) > HELD_NGRAMS:
                    yield frame(*summed(keys, counts))
                    keys, counts = [], []
        if keys:
            yield frame(*summed(keys, counts))

    return run


def count_ngrams(rows: DataFrame, order: int = ORDER, lower: bool = False) -> DataFrame:
    """``gram`` (its bytes as an integer) and ``n`` over all ``text`` of the rows."""
    parts = rows.select("text").mapInArrow(_counter(order, lower), "gram bigint, n bigint")
    return parts.groupBy("gram").agg(F.sum("n").alias("n"))


def mix(x: np.ndarray, order: int) -> np.ndarray:
    """Hash of n-grams of one order; one to one on 64 bits, so nothing collides."""
    h = x + np.uint64(order * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(31)


def discounts(n1: int, n2: int, n3: int, n4: int) -> np.ndarray:
    """Discounts for counts 1, 2 and 3 or more, from the numbers of n-grams counted once to
    four times; the usual constants where these give none."""
    if min(n1, n2, n3) > 0:
        y = n1 / (n1 + 2 * n2)
        d = np.array([0.0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3])
        if (d[1:] > 0).all() and (d[1:] <= np.array([1, 2, 3])).all():
            return d
    return np.array([0.0, 0.5, 1.0, 1.5])


def levels(counted: DataFrame, order: int) -> list[DataFrame]:
    """``gram`` and ``n`` of each order, shortest first. An order below the highest counts
    the distinct bytes before each n-gram."""
    out = [counted]
    for n in range(order - 1, 0, -1):
        shorter = F.col("gram").bitwiseAND((1 << 8 * n) - 1).alias("gram")
        out.append(materialize(out[-1].groupBy(shorter).agg(F.count("*").alias("n")), "ngrams"))
    return out[::-1]


def _all_discounts(counted: list[DataFrame]) -> list[np.ndarray]:
    """Discounts of each order; at most four numbers an order reach the driver."""
    seen = [c.where("n <= 4").groupBy("n").count().select(F.lit(i).alias("i"), "n", "count") for i, c in enumerate(counted)]
    of = {(r["i"], r["n"]): r["count"] for r in reduce(DataFrame.unionByName, seen).collect()}
    return [discounts(*(of.get((i, k), 0) for k in (1, 2, 3, 4))) for i in range(len(counted))]


def _contexts(level: DataFrame, d: np.ndarray) -> DataFrame:
    """``total`` of the counts after each context and ``backoff``, the share that the discounts
    take from it. Exact counts are weighted at the end, so the order of rows does not matter."""
    n = F.col("n")
    taken = [F.count_if(n == 1) * float(d[1]), F.count_if(n == 2) * float(d[2]), F.count_if(n >= 3) * float(d[3])]
    return level.groupBy(F.shiftrightunsigned("gram", 8).alias("gram")).agg(
        F.sum("n").alias("total"), (sum(taken, F.lit(0.0)) / F.sum("n")).alias("backoff")
    )


def estimate(counted: list[DataFrame]) -> DataFrame:
    """Entries of all orders: ``level``, ``hash``, ``log_p`` (NaN: only a context) and
    ``backoff`` (NaN: no context).

    An order is two equi-joins of its n-grams with the entries one shorter, on the bytes
    before the last and on the bytes after the first. At most 256 n-grams share either, so
    no key is hot. Each order is written before the next reads it; the counts and entries
    that nothing reads again are removed."""
    d = _all_discounts(counted)
    last = materialize(_contexts(counted[0], d[0]).withColumn("p", F.lit(1 / 256)), "entries")
    hashed = [_hash(last, 0)]
    for i, level in enumerate(counted):
        before = last.where("total is not null").select(F.col("gram").alias("context"), "total", "backoff")
        shorter = last.where("p is not null").select(F.col("gram").alias("suffix"), F.col("p").alias("below"))
        n = F.col("n")
        cut = F.when(n == 1, float(d[i][1])).when(n == 2, float(d[i][2])).otherwise(float(d[i][3]))
        found = (
            level.withColumn("context", F.shiftrightunsigned("gram", 8))
            .withColumn("suffix", F.col("gram").bitwiseAND((1 << 8 * i) - 1))
            .join(before, "context")
            .join(shorter, "suffix")
            .select("gram", ((n - cut) / F.col("total") + F.col("backoff") * F.col("below")).alias("p"))
        )
        if i + 1 < len(counted):
            found = found.join(_contexts(counted[i + 1], d[i + 1]), "gram", "full")
        else:
            found = found.withColumn("backoff", F.lit(None).cast("double"))
        now = materialize(found, "entries")
        discard(level)
        discard(last)
        last = now
        hashed.append(_hash(last, i + 1))
    discard(last)
    return reduce(DataFrame.unionByName, hashed)


def _hash(entries: DataFrame, level: int) -> DataFrame:
    values = [F.coalesce(F.log10(c), F.lit(float("nan"))).cast("float").alias(c) for c in ("p", "backoff")]
    narrow = entries.select(F.lit(level).alias("level"), "gram", *values)
    return materialize(narrow.mapInArrow(_hashed, "level int, hash bigint, log_p float, backoff float"), "hashed")


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        level, gram = (batch.column(c).to_numpy() for c in ("level", "gram"))
        hashes = mix(gram.astype(np.int64).view(np.uint64), int(level[0])) if len(level) else np.zeros(0, np.uint64)
        signed = pa.array((hashes ^ SIGN).view(np.int64))  # in the order of the unsigned hash
        yield pa.RecordBatch.from_arrays([batch.column("level"), signed, *batch.columns[2:]], STORED.names)


def store(entries: DataFrame) -> tuple[DataFrame, tuple[int, ...]]:
    """The entries by level and hash, written in files of some FILE_ENTRIES with a range each,
    and where each level starts."""
    sizes = {r["level"]: r["count"] for r in entries.groupBy("level").count().collect()}
    bounds = (0, *np.cumsum([sizes.get(i, 0) for i in range(max(sizes, default=-1) + 1)]).tolist())
    files = -(-bounds[-1] // FILE_ENTRIES) or 1
    by = ["level", "hash"]
    stored = materialize(entries.repartitionByRange(files, *by).sortWithinPartitions(*by), "model")
    discard(entries)
    return stored, bounds


def find(table: Table, column: int, hashes: np.ndarray) -> np.ndarray:
    """A column of the n-grams with these hashes; NaN where unknown."""
    if not len(table[0]):
        return np.full(len(hashes), np.nan, np.float32)
    by = np.argsort(hashes)  # in order, neighbours share pages of the table
    asked = hashes[by]
    at = np.minimum(np.searchsorted(table[0], asked), len(table[0]) - 1)
    out = np.empty(len(hashes), np.float32)
    out[by] = np.where(table[0][at] == asked, table[column][at], np.float32(np.nan))
    return out


def log_probabilities(tables: list[Table], grams: np.ndarray) -> np.ndarray:
    """log10 probability of the last byte of each n-gram after the others: that of
    the longest known n-gram, after the back-offs of the longer contexts."""
    log_p = np.zeros(len(grams))
    left = np.arange(len(grams))
    for n in range(len(tables) - 1, 0, -1):
        rest = grams[left]
        value = find(tables[n], 1, mix(rest & np.uint64((1 << 8 * n) - 1), n))
        known = ~np.isnan(value)
        log_p[left[known]] += value[known]
        left, rest = left[~known], rest[~known]
        if not len(left):
            break
        context = rest >> np.uint64(8) & np.uint64((1 << 8 * (n - 1)) - 1)
        log_p[left] += np.nan_to_num(find(tables[n - 1], 2, mix(context, n - 1)))
    log_p[left] += np.log10(1 / 256)
    return log_p


@dataclass(frozen=True)
class Model:
    """Files with the ranges of a model, in order, and where each order starts in them.
    ``folder`` is None where Spark sends them."""

    name: str
    folder: str | None
    files: tuple[str, ...]
    bounds: tuple[int, ...]

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """log10 probability of each normalised text and its end."""
        order = len(self.bounds) - 2
        out = np.zeros(len(texts))
        for group in pieces(texts, order):
            grams, starts = ngrams([part for _, part in group], order)
            distinct, where = np.unique(grams, return_inverse=True)
            tables = held(self, lambda: mapped(self))
            sums = np.add.reduceat(log_probabilities(tables, distinct)[where], starts)
            np.add.at(out, [i for i, _ in group], sums)
        return out


def mapped(model: Model) -> list[Table]:
    """The arrays of a model, mapped into memory. The first worker lays the ranges out as one
    file beside them, in the shared folder or where Spark put them; the others wait for it."""
    n = model.bounds[-1]
    if not n:
        return [tuple(np.zeros(0, t) for t in TYPES) for _ in model.bounds[1:]]
    folder = model.folder or SparkFiles.getRootDirectory()
    path = f"{folder}/{model.name}"
    with open(f"{path}.lock", "a") as lock:
        with contextlib.suppress(OSError):  # without locks each lays out a file, and one stays
            fcntl.flock(lock, fcntl.LOCK_EX)
        if not os.path.exists(path):
            own = f"{path}.{uuid.uuid4().hex}"
            _lay_out([f"{folder}/{x}" for x in model.files], n, own)
            os.replace(own, path)
    columns = _columns(path, n, "r")
    return [tuple(c[a:b] for c in columns) for a, b in zip(model.bounds, model.bounds[1:], strict=False)]


def _columns(path: str, n: int, mode: str) -> list[np.memmap]:
    return [np.memmap(path, t, mode, at * n, n) for t, at in zip(TYPES, (0, 8, 12), strict=True)]


def _lay_out(parts: list[str], n: int, path: str) -> None:
    at = 0
    with open(path, "wb") as file:
        file.truncate(16 * n)
    hashes, *values = _columns(path, n, "r+")
    for file in parts:
        part = pq.read_table(file, schema=STORED)
        end = at + part.num_rows
        hashes[at:end] = part.column("hash").to_numpy().view(np.uint64) ^ SIGN
        for column, value in zip(values, ("log_p", "backoff"), strict=True):
            column[at:end] = part.column(value).to_numpy()
        at = end
    if at != n:
        raise ValueError(f"{at} of {n} entries of the model arrived")


def train(rows: DataFrame, order: int = ORDER, lower: bool = False) -> Model:
    """Counts the ``text`` of the rows and estimates the model in Spark.

    Counts, contexts, probabilities and back-offs are grouped sums and joins over tables in the
    shared folder. Workers map its last table, cut by ranges of the hash, there where the
    folder is a mounted one; of any other file system Spark sends them the files. The driver holds four counts of
    counts and a size an order, and the names of the files. No n-gram is left out, whatever
    their number. Without a row the model is uniform over bytes."""
    counted = materialize(count_ngrams(rows, order, lower), "ngrams")
    stored, bounds = store(estimate(levels(counted, order)))
    if not bounds[-1]:
        return Model("", None, (), (0,) * (order + 2))
    paths = sorted(stored.inputFiles())
    mounted = [urlsplit(x) for x in paths]
    folder = os.path.dirname(unquote(mounted[0].path)) if mounted[0].scheme in ("", "file") else None
    if folder is None:
        for path in paths:
            rows.sparkSession.sparkContext.addFile(path)
    # Spark's readers pass over names that start with an underscore
    return Model(f"_ngram-{uuid.uuid4().hex}.bin", folder, tuple(os.path.basename(unquote(x.path)) for x in mounted), bounds)
