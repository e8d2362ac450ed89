"""Scores of texts under a word frequency model and a Kneser-Ney n-gram model.

Word counts are exact and their table may be of any size, so no worker holds it.
A scoring task cuts its rows into chunks and replaces words by numbers local to the
chunk; a chunk's distinct words (not its tokens) meet the counts in one join and
come back as one array per chunk, which prices the chunk's tokens.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accesspanel.llm import ngram_lm
from accesspanel.llm.common import crc_mod, materialize, ship_package, slices, utf8

#: A chunk is closed when it holds so many bytes of text or distinct words, within a
#: text if need be.
CHUNK_BYTES = 24 << 20
CHUNK_WORDS = 400_000
BLOCK_BYTES = 1 << 20

#: Two kinds of rows: a chunk with its documents (``words`` NULL), or one of its words.
CHUNKS = (
    "chunk bigint, row array<bigint>, doc_id array<bigint>, held_out array<boolean>, "
    "score array<double>, tokens array<bigint>, numbers binary, "
    "word string, number int, trained bigint"
)


def _frame(**columns: pa.Array) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    types = {
        "chunk": pa.int64(), "row": pa.list_(pa.int64()), "doc_id": pa.list_(pa.int64()),
        "held_out": pa.list_(pa.bool_()), "score": pa.list_(pa.float64()), "tokens": pa.list_(pa.int64()),
        "numbers": pa.binary(), "word": pa.string(), "number": pa.int32(), "trained": pa.int64(),
    }
    return pa.RecordBatch.from_arrays(
        [columns.get(k, pa.nulls(n, t)).cast(t) for k, t in types.items()], list(types)
    )


class Numbers(dict):
    """Word -> its number by first appearance."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def packed(numbers: np.ndarray) -> bytes:
    """Integers as four planes of like bytes, compressed: most are small."""
    planes = np.ascontiguousarray(numbers.astype("<i4").view(np.uint8).reshape(-1, 4).T)
    return zstandard.compress(planes.tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<i4").ravel()


def word_blocks(text: bytes) -> Iterator[list[bytes]]:
    """The words of a normalised text and the end token, about BLOCK_BYTES at a time."""
    at = 0
    while len(text) - at > BLOCK_BYTES:
        cut = text.find(b" ", at + BLOCK_BYTES)
        if cut < 0:
            break
        yield text[at:cut].split(b" ")
        at = cut + 1
    yield [*(text[at:].split(b" ") if at < len(text) else []), ngram_lm.END]


def _chunks(model: ngram_lm.Model) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def closed(chunk: int, number: Numbers, rows: list[tuple], held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        """``rows``: row number, doc_id, held_out, score, number of tokens."""
        numbers = np.concatenate(held)
        in_training = np.repeat([not r[2] for r in rows], [r[4] for r in rows])
        trained = np.bincount(numbers[in_training], minlength=len(number))
        listed = [pa.array([[r[k] for r in rows]]) for k in range(5)]
        yield _frame(
            chunk=pa.array([chunk]), row=listed[0], doc_id=listed[1], held_out=listed[2], score=listed[3],
            tokens=listed[4], numbers=pa.array([packed(numbers)], pa.binary()),
        )
        words = list(number)
        for a in range(0, len(words), 50_000):
            part = words[a : a + 50_000]
            yield _frame(
                chunk=pa.array(np.full(len(part), chunk)),
                word=pa.array(part, pa.binary()),
                number=pa.array(np.arange(a, a + len(part), dtype=np.int32)),
                trained=pa.array(trained[a : a + len(part)]),
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = row = TaskContext.get().partitionId() << 33
        number, rows, held, size = Numbers(), [], [], 0
        for batch in batches:
            for part in slices(batch, "text"):
                texts = [ngram_lm.normal(t, lower=True) for t in utf8(part.column("text"))]
                for text, score, doc_id, held_out in zip(
                    texts,
                    model.scores(texts).tolist(),
                    part.column("doc_id").to_pylist(),
                    part.column("held_out").to_pylist(),
                    strict=True,
                ):
                    for words in word_blocks(text):
                        held.append(np.fromiter(map(number.__getitem__, words), np.int32, len(words)))
                        rows.append((row, doc_id, held_out, score, len(words)))
                        score = 0.0
                        size += sum(map(len, words)) + len(words)
                        if size > CHUNK_BYTES or len(number) > CHUNK_WORDS:
                            yield from closed(chunk, number, rows, held)
                            chunk += 1
                            number, rows, held, size = Numbers(), [], [], 0
                    row += 1
        if held:
            yield from closed(chunk, number, rows, held)

    return run


PRICED = (
    "row bigint, doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, "
    "base_score double, score double"
)


def _price(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Prices chunks: ``counts`` lists (word number, count in training)."""
    for batch in batches:
        for i in range(batch.num_rows):
            get = {k: batch.column(k)[i] for k in batch.schema.names}
            numbers = unpacked(get["numbers"].as_py())
            counted = get["counts"].values
            trained = np.zeros(len(counted), np.int64)
            trained[counted.field("number").to_numpy()] = counted.field("n").to_numpy()
            total, kinds = get["total"].as_py() or 0, get["kinds"].as_py() or 0
            price = np.log10((trained + 0.5) / (total + 0.5 * (kinds + 1)))
            lengths = get["tokens"].values.to_numpy().astype(np.int64)
            ends = np.cumsum(lengths)
            known, base = np.zeros(len(lengths), np.int64), np.zeros(len(lengths))
            cuts = np.unique(np.r_[0, np.searchsorted(ends, np.arange(0, ends[-1], 1 << 20), "right"), len(lengths)])
            for a, b in zip(cuts, cuts[1:], strict=False):  # a million tokens at a time
                part = numbers[ends[a] - lengths[a] : ends[b - 1]]
                starts = (ends - lengths)[a:b] - (ends[a] - lengths[a])
                known[a:b] = np.add.reduceat((trained > 0)[part], starts, dtype=np.int64)
                base[a:b] = np.add.reduceat(price[part], starts)
            yield pa.RecordBatch.from_arrays(
                [
                    get["row"].values,
                    get["doc_id"].values,
                    get["held_out"].values,
                    pa.array(lengths),
                    pa.array(known),
                    pa.array(base),
                    get["score"].values,
                ],
                ["row", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"],
            )


def score_documents(docs: DataFrame, folds: int = 5, held_fold: int = 1) -> DataFrame:
    """One row per row of ``docs`` (``doc_id``, ``text``): ``held_out`` (crc32 of the
    id modulo ``folds`` is ``held_fold``; such rows train nothing), ``n_tokens``,
    ``n_known``, ``train_tokens``, ``base_score`` and ``score`` (log10).

    A NULL or empty text is the end token alone. A NULL id counts as empty text for
    the fold. Repeated rows are scored (and counted) each. Without training rows
    every word has count 0. No rows: none."""
    ship_package(docs.sparkSession)
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
        (crc_mod(F.col("doc_id"), folds) == held_fold).alias("held_out"),
    )
    model = ngram_lm.train(rows.where("not held_out"), lower=True)
    chunks = materialize(rows.mapInArrow(_chunks(model), CHUNKS), "chunks")
    words = chunks.where("word is not null").select("chunk", "word", "number", "trained")
    counts = materialize(words.groupBy("word").agg(F.sum("trained").alias("n")).where("n > 0"), "words")
    totals = counts.agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
    asked = (
        words.select("chunk", "word", "number")
        .join(counts, "word", "left")
        .groupBy("chunk")
        .agg(F.collect_list(F.struct("number", F.coalesce("n", F.lit(0)).alias("n"))).alias("counts"))
    )
    priced = (
        chunks.where("word is null")
        .drop("word", "number", "trained")
        .join(asked, "chunk")
        .crossJoin(F.broadcast(totals))
        .mapInArrow(_price, PRICED)
    )
    return (
        priced.groupBy("row")
        .agg(
            F.first("doc_id").alias("doc_id"),
            F.first("held_out").alias("held_out"),
            *[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")],
        )
        .crossJoin(F.broadcast(totals.select(F.coalesce("total", F.lit(0)).alias("train_tokens"))))
        .drop("row")
    )
