"""Quality score of a text by a small convolutional network over its bytes.

Learned filters run over every byte of a document. The maximum of each filter is
taken in overlapping chunks, which cover the whole document; the chunks' means
and maxima feed one logistic unit. Besides the byte itself, a position shows
whether the bytes before it repeat what stood a word's length earlier.

A filter of width WIDTH is a table of weights per offset and byte class, so the
convolution is a sum of look-ups, and the gradient of a maximum reaches only the
position that attained it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accesspanel.llm.common import crc_mod, hash_sample, per_slice, ship_package, spread_text, utf8

#: Bound of the training sample: labelled rows per label, and characters of each, from all
#: over its text.
SAMPLE_ROWS = 512
SAMPLE_TEXT = 2048
FILTERS = 16
WIDTH = 4
#: A chunk is two blocks; the next one starts a block later.
BLOCK = 128
BYTES_AT_ONCE = 1 << 18
#: Lags at which a repeat of at least MATCH bytes is looked for.
LAGS = range(2, 25)
MATCH = 6
EPOCHS = 40
SEED = 7
THRESHOLD = 0.3

#: Byte classes: 0 ends, letters by case, digits, white space, each ASCII sign, other bytes.
_CLASS = np.zeros(256, np.uint8)
_CLASS[128:] = 1
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 2, 3, 4
_CLASS[10], _CLASS[[9, 11, 12, 13, 32]] = 5, 6
for _i, _b in enumerate(b for b in range(33, 127) if not _CLASS[b]):
    _CLASS[_b] = 7 + _i
KINDS = int(_CLASS.max()) + 1
INPUTS = 2 * KINDS


def symbols(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Input symbol of each position (class, doubled where the text repeats) of the
    texts, each padded to whole blocks, and the number of blocks of each."""
    blocks = np.array([max(1, -(-len(t) // BLOCK)) for t in texts], np.int64)
    data = np.frombuffer(b"".join([t.ljust(int(n) * BLOCK, b"\0") for t, n in zip(texts, blocks, strict=True)]), np.uint8)
    repeats = np.zeros(len(data), bool)
    run = np.empty(len(data), bool)
    for lag in LAGS:
        same = np.zeros(len(data), bool)
        same[lag:] = data[lag:] == data[:-lag]
        run[:] = same
        reach = 1
        while reach < MATCH:
            step = min(reach, MATCH - reach)
            run[step:] &= run[:-step].copy()
            reach += step
        repeats |= run
    kind = _CLASS[data]
    kind[data == 0] = 0
    kind[repeats & (data != 0)] += KINDS
    return kind, blocks


@dataclass
class Network:
    """``filters``: (WIDTH, INPUTS, FILTERS); ``bias``: FILTERS; ``out``: mean and maximum
    of each filter, then the constant."""

    filters: np.ndarray
    bias: np.ndarray
    out: np.ndarray

    def chunk_maxima(self, symbol: np.ndarray, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(blocks, FILTERS) maxima of the filters in each block, not below zero, and
        the position of each."""
        high = np.empty((len(symbol) // BLOCK, FILTERS), np.float32)
        where = np.empty(high.shape, np.int64)
        padded = np.r_[symbol, np.zeros(WIDTH, np.uint8)]
        step = BYTES_AT_ONCE // BLOCK
        for a in range(0, len(high), step):
            n = min(step, len(high) - a) * BLOCK
            at = a * BLOCK
            h = self.filters[0].take(padded[at : at + n], axis=0)
            for j in range(1, WIDTH):
                h += self.filters[j].take(padded[at + j : at + j + n], axis=0)
            h = h.reshape(-1, BLOCK, FILTERS)
            high[a : a + step] = h.max(axis=1)
            if self.tracking:
                best = h.argmax(axis=1)
                where[a : a + step] = best + (at + np.arange(len(h)) * BLOCK)[:, None]
        return np.maximum(high + self.bias, 0), where

    tracking = False

    def probabilities(self, texts: list[bytes]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        symbol, blocks = symbols(texts)
        high, _ = self.chunk_maxima(symbol, blocks)
        x, _, _ = pooled(high, blocks)
        return 1 / (1 + np.exp(-np.clip(x @ self.out, -30, 30)))


def pooled(high: np.ndarray, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of each document from its blocks; and of each block, whether its
    successor is of the same document, and the chunk maxima."""
    starts = np.cumsum(blocks) - blocks
    last = np.zeros(len(high), bool)
    last[starts + blocks - 1] = True
    chunk = high.copy()
    chunk[:-1] = np.where(last[:-1, None], high[:-1], np.maximum(high[:-1], high[1:]))
    mean = np.add.reduceat(chunk, starts) / blocks[:, None]
    top = np.maximum.reduceat(chunk, starts)
    return np.hstack([mean, top, np.ones((len(blocks), 1))]), last, chunk


def fit(texts: list[bytes], labels: np.ndarray) -> Network:
    """Adam on the logistic loss, both labels weighted alike; the same rows give the same network."""
    rng = np.random.default_rng(SEED)
    net = Network(
        rng.normal(0, 0.3, (WIDTH, INPUTS, FILTERS)).astype(np.float32),
        np.zeros(FILTERS, np.float32),
        rng.normal(0, 0.1, 2 * FILTERS + 1),
    )
    net.tracking = True
    share = labels.mean()
    weight = np.where(labels == 1, 0.5 / max(share, 1e-9), 0.5 / max(1 - share, 1e-9))
    parameters = [net.filters, net.bias, net.out]
    moments = [(np.zeros(p.shape), np.zeros(p.shape)) for p in parameters]
    ready = [symbols([t]) for t in texts]
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(texts))
        for batch in np.array_split(order, max(1, len(order) // 64)):
            symbol = np.concatenate([ready[i][0] for i in batch])
            blocks = np.concatenate([ready[i][1] for i in batch])
            step += 1
            for p, g, (m, v) in zip(
                parameters, _gradients(net, symbol, blocks, labels[batch], weight[batch]), moments, strict=True
            ):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= (0.02 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(p.dtype)
    net.tracking = False
    return net


def _gradients(
    net: Network, symbol: np.ndarray, blocks: np.ndarray, labels: np.ndarray, weight: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    high, where = net.chunk_maxima(symbol, blocks)
    x, last, chunk = pooled(high, blocks)
    p = 1 / (1 + np.exp(-np.clip(x @ net.out, -30, 30)))
    error = weight * (p - labels) / len(labels)
    out = x.T @ error + 1e-3 * net.out
    owner = np.repeat(np.arange(len(blocks)), blocks)
    to_x = error[:, None] * net.out[None, :-1]
    grad = (to_x[:, :FILTERS] / blocks[:, None])[owner]
    is_top = chunk == x[owner, FILTERS : 2 * FILTERS]
    ties = np.add.reduceat(is_top.astype(float), np.cumsum(blocks) - blocks)
    grad = grad + np.where(is_top, (to_x[:, FILTERS:] / ties)[owner], 0)
    own = np.ones(chunk.shape, bool)
    own[:-1] = last[:-1, None] | (high[:-1] >= high[1:])
    to_high = np.where(own, grad, 0)
    to_high[1:] += np.where(own[:-1], 0, grad[:-1])
    to_high = np.where(high > 0, to_high, 0)
    filters = np.zeros(net.filters.shape)
    padded = np.r_[symbol, np.zeros(WIDTH, np.uint8)]
    lane = np.broadcast_to(np.arange(FILTERS), where.shape)
    for j in range(WIDTH):
        np.add.at(filters[j], (padded[where + j], lane), to_high)
    return filters, to_high.sum(axis=0), out


def learn(rows: DataFrame, labels: DataFrame, label: str = "quality") -> Network | None:
    """Network from a bounded sample of labelled rows; None without both labels."""
    known = labels.select(F.col("doc_id").alias("labelled"), F.col(label).cast("int").alias("label")).where(
        "label in (0, 1)"
    )
    chosen = hash_sample(known, "label", "labelled", SAMPLE_ROWS).select("labelled", "label").distinct()
    taken = (
        rows.join(F.broadcast(chosen), F.col("doc_id") == F.col("labelled"))
        .groupBy("doc_id", "label")
        .agg(F.min(spread_text(F.col("text"), SAMPLE_TEXT)).alias("text"))
        .collect()
    )
    taken.sort(key=lambda r: (r["doc_id"], r["label"], r["text"] or ""))
    y = np.array([r["label"] for r in taken])
    if len(set(y.tolist())) < 2:
        return None
    return fit([(r["text"] or "").encode() for r in taken], y)


def score(docs: DataFrame, labels: DataFrame, folds: int = 5, held_fold: int = 0) -> DataFrame:
    """One row per row of ``docs`` (``doc_id``, ``text``): ``held_out`` (crc32 of the id
    modulo ``folds`` is ``held_fold``; such rows teach nothing), ``score`` (probability of
    label 1) and ``predicted`` (1 from THRESHOLD on).

    NULL and empty texts are scored as a text of no bytes. Labels other than 0 and 1
    are passed over. Without rows of both labels every score is 0.5. A NULL id counts
    as empty text for the fold. Repeated rows are scored each. No rows: none."""
    ship_package(docs.sparkSession)
    fold = crc_mod(F.col("doc_id"), folds) == held_fold
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), fold.alias("held_out")
    )
    net = learn(rows.where("not held_out"), labels.where(~fold))

    def scored(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = utf8(batch.column("text"))
        p = net.probabilities(texts) if net else np.full(len(texts), 0.5)
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("held_out"), pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32))],
            ["doc_id", "held_out", "score", "predicted"],
        )

    return rows.mapInArrow(per_slice(scored), "doc_id bigint, held_out boolean, score double, predicted int")
