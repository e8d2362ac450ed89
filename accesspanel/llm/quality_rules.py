"""Quality rules: counts of words, symbols and repeats, and perplexity bands.

The perplexity of a text is that of its words under a modified Kneser-Ney model
counted over all rows. Each language has a lower and an upper bound, Tukey fences
around the quartiles of its own rows (those that pass the simple rules): text
below repeats itself, text above is not the language.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accesspanel.llm import ngram_lm
from accesspanel.llm.common import free_name, materialize, per_slice, ship_package

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEATED = 0.5
#: Distance of the bounds from the quartiles, in quartile distances.
FENCES = 3.5
SPACES = re.compile(r"[\x20\x09-\x0D]")

MEASURED = (
    "row_key bigint, doc_id bigint, lang string, n_words bigint, word_chars bigint, n_symbols bigint, "
    "n_dup_lines bigint, n_repeat_words bigint, surprise double"
)


def repeated_words(words: list[bytes], size: int = 3) -> int:
    """Words inside windows of ``size`` words that occur twice or more in the text."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    ids = np.fromiter(map(number.__getitem__, words), np.uint64, len(words))
    # windows as integers, renumbered after each word so that they always fit
    window = ids
    for k in range(1, size):
        window = window[:-1] * np.uint64(len(number)) + ids[k:]
        _, window = np.unique(window, return_inverse=True)
        window = window.astype(np.uint64)
    again = np.bincount(window.astype(np.int64))[window.astype(np.int64)] > 1
    covered = np.zeros(len(words), bool)
    for k in range(size):
        covered[k : k + n] |= again
    return int(covered.sum())


def repeated_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = Counter(x for x in text.split(b"\n") if x.strip())
    return sum(lines.values()) - len(lines)


def _measurer(model: ngram_lm.Model):
    def measured(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t or "" for t in batch.column("text").to_pylist()]
        raw = [t.encode() for t in texts]
        words = [t.split() for t in raw]
        n_words = [len(w) for w in words]
        columns = [
            batch.column("row_key"),
            batch.column("doc_id"),
            batch.column("lang"),
            pa.array(n_words, pa.int64()),
            pa.array([len(t) - sum(map(t.count, " \t\n\x0b\x0c\r")) for t in texts], pa.int64()),
            pa.array([sum(map(t.count, SYMBOLS)) for t in texts], pa.int64()),
            pa.array([repeated_lines(t) for t in raw], pa.int64()),
            pa.array([repeated_words(w) for w in words], pa.int64()),
        ]
        scores = model.scores([b" ".join(w) for w in words])
        columns.append(pa.array(-scores / (np.array(n_words) + 1)))
        return pa.RecordBatch.from_arrays(columns, MEASURED.replace(" bigint", "").replace(" string", "").replace(" double", "").split(", "))

    return per_slice(measured, "text")


def measure(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (``doc_id``, ``text``, ``lang``) with the counts,
    ``base_failed`` and ``surprise``, the log10 perplexity per word."""
    ship_package(docs.sparkSession)
    rows = docs.select(
        _row_key().alias("row_key"),
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.col("lang").cast("string").alias("lang"),
        F.col("text").cast("string").alias("text"),
    )
    model = ngram_lm.train(rows)
    failed = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > int(100 * MAX_REPEATED) * F.col("n_words")
    )
    return rows.mapInArrow(_measurer(model), MEASURED).withColumn("base_failed", failed)


def _row_key() -> Column:
    """Tells rows apart by all that the verdict and its place depend on; never NULL."""
    return F.xxhash64(F.col("doc_id").cast("bigint"), F.col("text").cast("string"), F.col("lang").cast("string"))


def _judged(docs: DataFrame) -> DataFrame:
    measured = materialize(measure(docs), "quality")
    quartiles = F.percentile_approx("surprise", F.array(F.lit(0.25), F.lit(0.75)), F.lit(10000))
    low, high = F.col("q")[0], F.col("q")[1]
    spread = F.greatest(high - low, F.lit(0.05))
    bands = (
        measured.where("not base_failed")
        .groupBy(F.col("lang").alias("band_lang"))
        .agg(quartiles.alias("q"))
        .select("band_lang", (low - FENCES * spread).alias("lower"), (high + FENCES * spread).alias("upper"))
    )
    inside = F.coalesce(F.col("surprise").between(F.col("lower"), F.col("upper")), F.lit(False))
    return (
        measured.join(bands, F.col("lang").eqNullSafe(F.col("band_lang")), "left")
        .withColumn("kept", ~F.col("base_failed") & inside)
        .drop("band_lang")
    )


def verdicts(docs: DataFrame) -> DataFrame:
    """The counts of ``measure`` and ``kept``: no simple rule failed and the
    perplexity lies in the band of the row's language.

    A NULL text has no words and fails; a NULL language is a language of its own.
    Repeated rows each get the same verdict. A language none of whose rows passes
    the simple rules has no band and keeps none. No rows: none."""
    return _judged(docs).drop("row_key")


def keep(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``verdicts`` keeps, as they are."""
    key = free_name(docs, "row_key")
    rejected = _judged(docs).where("not kept").select(F.col("row_key").alias(key)).distinct()
    return docs.join(rejected, _row_key() == F.col(key), "left_anti")
