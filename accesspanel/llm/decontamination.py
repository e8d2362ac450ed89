"""Benchmark decontamination by template canonicalisation.

Numbers, names (capitalised words) and units become typed placeholders, everything
else is lower-cased; what stood in a placeholder is the value of its slot. Beside this stream of
template words a second, *folded* one takes names as lower-cased words, so that a text
copied in other case is found as well. Windows of WINDOW tokens of either stream are joined by their
hash. A window counts only in an alignment (one distance between the places in document and
item) that fills the item's slots consistently: equal values of the item stand for equal values in the
document and different ones for different ones. Re-parameterised questions are so found like
verbatim ones. An item is found in a document if in one of the streams most of its windows are, or
RUN windows in a row, so that a long part of an item is enough.

Documents send only windows that a bitmap of fixed size lets pass, in which the
benchmark's window hashes are marked; the join decides.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from itertools import chain, product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accesspanel.llm.common import free_name, held, materialize, row_hash, ship_package, slices

WINDOW = 8
#: Tokens of a window that are not placeholders; fewer say nothing about its source.
LEAST_LITERALS = 4
#: Share of an item's windows that a document must have.
COVERAGE = 0.8
#: Windows in a row, RUN + WINDOW - 1 tokens, that are enough whatever the item's length.
RUN = 13
#: Rows of one window are spread over so many tasks.
SALTS = 16
#: The filter's size: 2 ** 24 bits are 2 MB, whatever the benchmark holds.
FILTER_BITS = 24

#: Units of measurement as they stand in questions.
UNITS = frozenset(
    "km cm mm kg mg lb lbs oz ml kw kwh mph kph hz khz mhz ghz kb mb gb tb "
    "metre metres meter meters mile miles inch inches foot feet yard yards gram grams kilogram kilograms "
    "pound pounds ounce ounces litre litres liter liters second seconds minute minutes hour hours day days "
    "week weeks month months year years percent degree degrees dollar dollars cent cents euro euros".split()
)
NUMBER, NAME, UNIT = "<number>", "<name>", "<unit>"

#: The two streams: names as placeholders, names as words.
TEMPLATE, FOLDED = 0, 1

#: A number or a word.
TOKEN = re.compile(r"\d+(?:[.,]\d+)*|\w+")


def canonical(token: str, stream: int = TEMPLATE) -> tuple[str, str | None]:
    """Template word of a token as TOKEN finds it, and its slot value if it is a placeholder."""
    if any(c.isdigit() for c in token):
        return NUMBER, token
    low = token.lower()
    if low in UNITS:
        return UNIT, low
    if stream == TEMPLATE and len(token) > 1 and token[0].isupper() and token[1:].islower():
        return NAME, low
    return low, None


class Hashes(dict):
    """Token -> its number; ``of`` holds the hash of its template word in either stream by
    that number. A placeholder's hash has its lowest bit set."""

    def __init__(self) -> None:
        self.of = (array("Q"), array("Q"))

    def __missing__(self, token: str) -> int:
        for stream, column in enumerate(self.of):
            word, slot = canonical(token, stream)
            column.append(xxhash.xxh64_intdigest(word.encode()) & ~1 | (slot is not None))
        self[token] = len(self.of[0]) - 1
        return self[token]


MULTIPLIER = 0x9E3779B97F4A7C15
#: Tokens a worker remembers from one slice of texts to the next.
REMEMBERED = 500_000


def word_hashes(texts: list[list[str]]) -> list[np.ndarray]:
    """Hashes of the template words of all texts in a row, for either stream."""
    known = held("template hashes", Hashes)
    if len(known) > REMEMBERED:
        known.clear()
        known.of = (array("Q"), array("Q"))
    number = np.fromiter(map(known.__getitem__, chain.from_iterable(texts)), np.int64, sum(map(len, texts)))
    return [np.array(column, np.uint64)[number] for column in known.of]


def windows(
    texts: list[list[str]], size: int, stream: int = TEMPLATE, hashes: list[np.ndarray] | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of each window of ``size`` tokens within one of the texts; starts
    count through all texts. ``hashes`` are those of ``word_hashes``, if at hand."""
    ends = np.cumsum([len(t) for t in texts])
    h = (hashes or word_hashes(texts))[stream]
    n = len(h) - size + 1
    if n < 1:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    key = np.full(n, size << 1 | stream, np.uint64)
    for k in range(size):
        key *= np.uint64(MULTIPLIER)
        key += h[k : k + n]
    key ^= key >> np.uint64(29)
    key *= np.uint64(0xBF58476D1CE4E5B9)
    key ^= key >> np.uint64(32)
    inside = np.ones(n, bool)
    for k in range(1, size):  # a window may not start so close before an end
        inside[ends[(ends - k >= 0) & (ends - k < n)] - k] = False
    place = np.flatnonzero(inside)
    return key[place], place


def tokenize(text: str) -> list[str]:
    return TOKEN.findall(text)


def slots(tokens: list[str], stream: int = TEMPLATE) -> list[str]:
    """Slot values of a window, each with its type, so that unlike types never meet."""
    found = (canonical(t, stream) for t in tokens)
    return [f"{word}{value}" for word, value in found if value is not None]


WINDOWS = "id bigint, row bigint, stream int, place bigint, hash bigint, slots array<string>"


def _window_rows(sizes: tuple[int, ...], marked: np.ndarray | None, short_items: bool):
    """Window rows of texts: those ``marked`` lets pass, or all; with ``short_items`` a text
    under WINDOW tokens is one window of its own length."""

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, at, hashes, values, keys, streams = [], [], [], [], [], []
        texts = [tokenize(t or "") for t in batch.column("text").to_pylist()]
        starts = np.cumsum([0, *map(len, texts)])
        id_of, row_of = batch.column("id").to_pylist(), batch.column("row").to_pylist()
        lengths = sorted({min(WINDOW, len(t)) for t in texts} - {0}) if short_items else sizes
        words = word_hashes(texts)
        for size, stream in product(lengths, (TEMPLATE, FOLDED)):
            # an item has windows of one length only; the others' tokens stay where they are
            key, place = windows(texts, size, stream, words)
            if marked is not None:
                bit = key & np.uint64((1 << FILTER_BITS) - 1)
                met = marked[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8) & 1 > 0
                key, place = key[met], place[met]
            owner = np.searchsorted(starts, place, "right") - 1
            for k, i, p in zip(key.astype(np.int64).tolist(), owner.tolist(), (place - starts[owner]).tolist(), strict=True):
                if short_items and size != min(WINDOW, len(texts[i])):
                    continue
                filled = slots(texts[i][p : p + size], stream)
                if size - len(filled) < min(LEAST_LITERALS, size):
                    continue
                ids.append(id_of[i])
                keys.append(row_of[i])
                streams.append(stream)
                at.append(p)
                hashes.append(k)
                values.append(filled)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(ids, pa.int64()), pa.array(keys, pa.int64()), pa.array(streams, pa.int32()),
                pa.array(at, pa.int64()), pa.array(hashes, pa.int64()), pa.array(values, pa.list_(pa.string())),
            ],
            ["id", "row", "stream", "place", "hash", "slots"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                yield rows(part)

    return run


def _keyed(df: DataFrame, id_column: str, text: str) -> DataFrame:
    ship_package(df.sparkSession)
    return df.select(
        F.col(id_column).cast("bigint").alias("id"),
        row_hash(id_column, text).alias("row"),
        F.col(text).cast("string").alias("text"),
    )


def found_items(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``hit_row`` (row_hash of a document), ``coverage``, ``found`` and ``item_ids`` of the
    documents that hold a window of an item, whether the item is found or not."""
    items = materialize(
        _keyed(benchmark, "item_id", "text")
        .distinct()
        .mapInArrow(_window_rows((), None, True), WINDOWS)
        .select(
            F.col("id").alias("item_id"), F.col("row").alias("item"), "stream", F.col("place").alias("item_place"),
            "hash", F.col("slots").alias("item_slots"),
        ),
        "item-windows",
    )
    totals = items.groupBy("item", "stream").agg(F.countDistinct("hash").alias("total"))
    filled = items.selectExpr(
        f"shiftright(hash & {(1 << FILTER_BITS) - 1}, 3) AS byte", "shiftleft(1, CAST(hash & 7 AS INT)) AS bit"
    )
    marked = np.zeros(1 << FILTER_BITS - 3, np.uint8)
    # at most one number per byte of the filter reaches the driver
    for r in filled.groupBy("byte").agg(F.bit_or("bit").alias("bits")).toLocalIterator():
        marked[r["byte"]] = r["bits"]
    bitmap = docs.sparkSession.sparkContext.broadcast(marked)
    sizes = _sizes(benchmark)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _window_rows(sizes, bitmap.value, False)(batches)

    # a window that every other document has is met in SALTS tasks
    salted = items.withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    met = materialize(
        _keyed(docs, "doc_id", "text")
        .mapInArrow(scan, WINDOWS)
        .withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int"))
        .join(salted, ["hash", "stream", "salt"])
        .drop("salt"),
        "met-windows",
    ).withColumn("shift", F.col("place") - F.col("item_place"))
    aligned = ["row", "item", "stream", "shift"]
    pairs = met.select(*aligned, F.explode(F.arrays_zip("item_slots", "slots")).alias("p")).select(
        *aligned, F.col("p.item_slots").alias("a"), F.col("p.slots").alias("b")
    )
    torn = (
        pairs.distinct()
        .groupBy(*aligned)
        .agg(F.count("*").alias("n"), F.countDistinct("a").alias("na"), F.countDistinct("b").alias("nb"))
        .where("n > na or n > nb")
        .select(*aligned)
    )
    whole = met.join(torn, aligned, "left_anti")
    # places of an item, so no more than it has
    places = F.array_sort(F.collect_set("item_place"))
    in_a_row = F.exists(
        F.transform("places", lambda p, i: F.get("places", i + (RUN - 1)) - p), lambda d: d == RUN - 1
    )
    runs = (
        whole.groupBy(*aligned)
        .agg(places.alias("places"))
        .where(F.coalesce(in_a_row, F.lit(False)))
        .select("row", "item", "stream")
        .distinct()
        .withColumn("run", F.lit(True))
    )
    hits = (
        whole.groupBy("row", "item", "stream", "item_id")
        .agg(F.countDistinct("hash").alias("n"))
        .join(totals, ["item", "stream"])
        .join(runs, ["row", "item", "stream"], "left")
        .withColumn("share", F.col("n") / F.col("total"))
        .withColumn("is_found", F.coalesce("run", F.lit(False)) | (F.col("share") >= COVERAGE))
    )
    return hits.groupBy(F.col("row").alias("hit_row")).agg(
        F.max("share").alias("coverage"),
        F.max("is_found").alias("found"),
        F.array_sort(F.collect_set(F.when(F.col("is_found"), F.col("item_id")))).alias("item_ids"),
    )


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (``doc_id``, ``text``): ``contaminated``, ``item_ids`` (the
    items of ``benchmark`` (``item_id``, ``text``) found, in order) and ``coverage`` (the
    greatest share of an item's windows found; a long run of windows is enough at any share).

    NULL and empty texts on either side hold no windows: nothing is found in or by
    them. An item of fewer than WINDOW tokens is one window; one whose windows are
    all placeholders cannot be found. Repeated items count once; repeated rows get
    the same answer. A NULL ``item_id`` marks the document but is not listed. No
    benchmark: nothing is contaminated."""
    found = found_items(docs, benchmark)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), row_hash().alias("row"))
    return rows.join(found, F.col("row") == F.col("hit_row"), "left").select(
        "doc_id",
        F.coalesce("found", F.lit(False)).alias("contaminated"),
        F.coalesce("item_ids", F.array().cast("array<bigint>")).alias("item_ids"),
        F.coalesce("coverage", F.lit(0.0)).alias("coverage"),
    )


def _sizes(benchmark: DataFrame) -> tuple[int, ...]:
    """Window lengths in use: WINDOW, and the lengths of shorter items (at most WINDOW - 1 of them)."""

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [min(WINDOW, len(tokenize(t or ""))) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(n, pa.int64())], ["n"])

    found = benchmark.select(F.col("text").cast("string").alias("text")).mapInArrow(lengths, "n bigint").distinct()
    return tuple(sorted({r["n"] for r in found.collect()} - {0} | {WINDOW}))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` in which no item is found, as they are."""
    key = free_name(docs, "hit_row")
    dirty = found_items(docs, benchmark).where("found").select(F.col("hit_row").alias(key))
    return docs.join(dirty, row_hash() == F.col(key), "left_anti")
