"""Removal of passages that an earlier document holds, by Burrows-Wheeler intervals.

Where do strings of MATCH bytes also start in a document of smaller id? Documents
meet at anchors: of the KGRAM-byte strings inside each MATCH-byte string, the one of least hash,
so that equal strings choose equal anchors. Occurrences of an anchor are grouped by
their context, the bytes of the MATCH-byte strings in a row that chose it. An
occurrence in a later document of the same context is covered whole. The first of each
context is compared with the anchor's other contexts:

Their texts are sorted into a suffix array, and breadth-first backward extension on its
Burrows-Wheeler transform visits string intervals by length, which sets the common
prefixes of neighbouring suffixes in rising order. It stops below MATCH: what stays unset are
neighbours that share MATCH bytes or more. The least document of each such run tells which
starts an earlier document has.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accesspanel.llm.common import materialize, row_hash, ship_package, slices, utf8

MATCH = 50
KGRAM = 24
WINDOW = MATCH - KGRAM + 1
#: Places in a segment fit in so many bits.
PLACE_BITS = 20
SEGMENT_BYTES = 1_000_000
#: Bytes of contexts in one transform, and contexts of one anchor in a group.
TRANSFORM_BYTES = 4 << 20
GROUP_CONTEXTS = 1 << 14
#: Never part of UTF-8: ends each text.
STOP = b"\xff"
LAST = (1 << 63) - 1


def kgram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the KGRAM bytes from each position on (16 and 8 of them put together)."""
    base = 0x9E3779B97F4A7C15
    h = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    size, eight = 1, h
    while size < 16:
        h = h[:-size] * np.uint64(pow(base, size, 1 << 64)) + h[size:]
        size *= 2
        eight = h if size == 8 else eight
    n = len(data) - KGRAM + 1
    h = h[:n] * np.uint64(pow(base, 8, 1 << 64)) + eight[16 : 16 + n]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    return np.maximum(h ^ h >> np.uint64(32), np.uint64(1))


def sliding(x: np.ndarray, width: int, fn) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        x = fn(x[:-size], x[size:])
        size *= 2
    rest = width - size
    return fn(x[: len(x) - rest], x[rest:]) if rest else x


def anchors(text: bytes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of MATCH-byte strings with one anchor: the start of the first string, the
    number of bytes the run covers, the anchor's hash and a hash of those bytes.

    A string's anchor is the first of its KGRAM-byte strings of least hash (by its high
    bits). Texts are taken in segments; a run may be cut at a segment's end."""
    for a in range(0, len(text) - MATCH + 1, SEGMENT_BYTES):
        data = np.frombuffer(text[a : a + SEGMENT_BYTES + MATCH - 1], np.uint8)
        h = kgram_hashes(data)
        place = np.arange(len(h), dtype=np.uint64)
        ranked = h >> np.uint64(PLACE_BITS) << np.uint64(PLACE_BITS) | place
        chosen = (sliding(ranked, WINDOW, np.minimum) & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
        low = np.flatnonzero(np.r_[True, chosen[1:] != chosen[:-1]])
        end = np.r_[low[1:], len(chosen)] - 1 + MATCH
        anchor = chosen[low]
        context = (end - low).astype(np.uint64) << np.uint64(8) | (anchor - low).astype(np.uint64)
        # these four strings of KGRAM bytes cover all of up to 4 * KGRAM
        for at in (low, low + KGRAM, end - 2 * KGRAM, end - KGRAM):
            context = (context ^ context >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9) + h[at]
        yield low + a, end - low, h[anchor], context


OCCURRENCES = "anchor bigint, context bigint, doc bigint, row bigint, spot bigint"


#: A spot: the run's start and the bytes beyond MATCH that it covers.
START_BITS = 34
#: Set in the spot of an occurrence known to be covered.
KNOWN = -(1 << 63)


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences of a batch. Those whose context stands in a smaller document of the
    same batch are known to be covered: they go out with a negative spot and an anchor
    that spreads them, so that a passage in many documents sends few rows to its anchor."""
    for batch in batches:
        columns: list[list[np.ndarray]] = [[], [], [], [], []]
        for part in slices(batch, "text", SEGMENT_BYTES):
            for text, doc, row in zip(
                utf8(part.column("text")), part.column("doc").to_pylist(), part.column("row").to_pylist(), strict=True
            ):
                for low, size, h, context in anchors(text):
                    columns[0].append(h)
                    columns[1].append(context)
                    columns[2].append(np.full(len(h), doc))
                    columns[3].append(np.full(len(h), row))
                    columns[4].append(low | size - MATCH << START_BITS)
        if not columns[0]:
            continue
        h, context, doc, row, spot = (np.concatenate(c) for c in columns)
        both = h * np.uint64(0x9E3779B97F4A7C15) ^ context
        by = np.argsort(both)
        first = np.flatnonzero(np.r_[True, both[by][1:] != both[by][:-1]])
        least = np.empty(len(doc), np.int64)
        least[by] = np.repeat(np.minimum.reduceat(doc[by], first), np.diff(np.r_[first, len(by)]))
        known = doc > least
        spot[known] |= KNOWN
        h[known] = ((spot ^ row)[known].view(np.uint64) ^ doc[known].astype(np.uint64)) * np.uint64(0x94D049BB133111EB)
        yield pa.RecordBatch.from_arrays(
            [pa.array(h.view(np.int64)), pa.array(context.view(np.int64)), pa.array(doc), pa.array(row), pa.array(spot)],
            ["anchor", "context", "doc", "row", "spot"],
        )


SORTED = "open boolean, " + OCCURRENCES


def _sorted_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads occurrences by (anchor, context, doc). Those after the first document of
    their context come out as covered; those of the first document as open, if the
    anchor has another context. Nothing but the current first document's rows is held."""
    none = np.zeros(0, np.int64)
    anchor = context = first = None
    several, held = False, (none,) * 5

    def frame(is_open: bool, h, c, d, r, w) -> pa.RecordBatch:
        if not is_open:
            h = c = np.zeros(len(d), np.int64)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(d), is_open)), *map(pa.array, (h, c, d, r, w))],
            ["open", "anchor", "context", "doc", "row", "spot"],
        )

    for batch in batches:
        h, c, d, r, w = (batch.column(k).to_numpy() for k in ("anchor", "context", "doc", "row", "spot"))
        known = w < 0
        if known.any():
            yield frame(False, h, c, d[known], r[known], w[known] & ~KNOWN)
            h, c, d, r, w = (x[~known] for x in (h, c, d, r, w))
        if not len(h):
            continue
        new_h = np.r_[h[0] != anchor if anchor is not None else True, h[1:] != h[:-1]]
        new_c = new_h | np.r_[c[0] != context if context is not None else True, c[1:] != c[:-1]]
        least = np.r_[first if first is not None else 0, d[new_c]][np.cumsum(new_c)]
        run = np.cumsum(new_h)  # 0: the anchor carried over
        kinds = np.bincount(run[new_c], minlength=int(run[-1]) + 1)
        kinds[0] += anchor is not None
        multiple = kinds > 1
        if several:
            multiple[0] = True
        if len(held[0]) and multiple[0]:
            yield frame(True, *held)
        if run[-1] > 0 or multiple[0]:
            held = (none,) * 5
        of_first = d == least
        later = ~of_first
        if later.any():
            yield frame(False, *(x[later] for x in (h, c, d, r, w)))
        out = of_first & multiple[run]
        if out.any():
            yield frame(True, *(x[out] for x in (h, c, d, r, w)))
        wait = of_first & (run == run[-1]) & ~multiple[run[-1]]
        held = tuple(np.r_[x, y[wait]] for x, y in zip(held, (h, c, d, r, w), strict=True))
        anchor, context, first, several = h[-1], c[-1], least[-1], bool(multiple[run[-1]])


def suffix_order(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes by their first 64 bytes, and the eight-byte keys they start with."""
    padded = np.r_[data, np.zeros(8, np.uint8)]
    keys = np.zeros(len(data), np.uint64)
    for j in range(8):
        keys <<= np.uint64(8)
        keys |= padded[j : j + len(data)]
    order = suffix = np.argsort(keys)
    order = order.copy()
    key = keys[suffix]
    tied = np.arange(len(data))  # places whose suffix ties with a neighbour so far
    rank = np.zeros(len(data) + 32, np.uint32)
    for size in (8, 16, 32):
        same = key[1:] == key[:-1]
        first = np.r_[True, ~same]
        # a suffix is ranked by the first place of those it ties with
        rank[suffix] = tied[np.flatnonzero(first)][np.cumsum(first) - 1] + 1
        still = np.r_[False, same] | np.r_[same, False]
        suffix, tied = suffix[still], tied[still]
        if not len(tied):
            break
        key = rank[suffix].astype(np.uint64) << np.uint64(32) | rank[suffix + size]
        by = np.argsort(key)
        suffix, key = suffix[by], key[by]
        order[tied] = suffix
    return order, keys


def shared_neighbours(data: np.ndarray, order: np.ndarray, keys: np.ndarray, match: int) -> np.ndarray:
    """For each suffix in order: whether it shares ``match`` bytes or more with the one before.

    Common prefixes below eight are read off the sorted keys. From there on a queue
    holds the intervals of strings whose right border was set last; extending a string
    by each byte before it (the transform maps those to intervals of the longer strings)
    sets a border not yet set, and puts such intervals in the queue."""
    n = len(data)
    transform = data[order - 1]
    by_byte = np.argsort(transform, kind="stable")
    forward = np.empty(n, np.int64)
    forward[by_byte] = np.arange(n)
    starts_byte = np.zeros(n + 1, bool)
    starts_byte[np.cumsum(np.bincount(transform, minlength=256))] = True
    first = keys[order]
    differing = first[1:] ^ first[:-1]
    is_set = np.zeros(n + 1, bool)  # border before each suffix
    is_set[0] = is_set[n] = True
    is_set[1:n] = differing != 0
    border = np.flatnonzero(is_set)
    low, high = border[:-1], border[1:]
    # strings of eight bytes that share seven with the next
    queued = np.r_[(differing[high[:-1] - 1] < 256), False]
    low, high = low[queued], high[queued]
    owner = np.full(n + 1, -1, np.int64)
    for _ in range(8, match):
        if not len(low):
            break
        size = high - low
        string = np.repeat(np.arange(len(low)), size)
        suffix = np.arange(len(string)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(low, size)
        image = np.sort(forward[suffix])
        owner[forward[suffix]] = string
        which = owner[image]
        begins = np.r_[True, (which[1:] != which[:-1]) | (image[1:] != image[:-1] + 1) | starts_byte[image[1:]]]
        at = np.flatnonzero(begins)
        low, high = image[at], image[np.r_[at[1:], len(image)] - 1] + 1
        fresh = ~is_set[high]
        low, high = low[fresh], high[fresh]
        is_set[high] = True
    return ~is_set[:n]


def found_earlier(texts: list[bytes], docs: np.ndarray, match: int = MATCH) -> list[np.ndarray]:
    """Of each text, the starts whose ``match`` bytes also start in a text of a smaller doc."""
    data = np.frombuffer(STOP.join(texts) + STOP, np.uint8)
    size = np.array([len(t) + 1 for t in texts])
    begin = np.cumsum(size) - size
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), size)
    is_start = np.arange(len(data)) + match < np.repeat(begin + size, size)
    order, keys = suffix_order(data)
    run = np.cumsum(~shared_neighbours(data, order, keys, match), dtype=np.int32)
    whole = is_start[order]
    run, suffix = run[whole], order[whole]
    text = owner[suffix]
    if not len(run):
        return [np.zeros(0, np.int64) for _ in texts]
    at = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
    least = np.repeat(np.minimum.reduceat(docs[text], at), np.diff(np.r_[at, len(run)]))
    later = least < docs[text]
    suffix = np.sort(suffix[later])
    text = owner[suffix]
    return np.split(suffix - begin[text], np.searchsorted(text, np.arange(1, len(texts))))


FOUND = "anchor bigint, context bigint, low int, high int"


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads contexts by group; transforms whole groups together."""

    def settled(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        out = []
        docs = np.array([r[3] for r in rows], np.int64)
        for r, starts in zip(rows, found_earlier([r[4] for r in rows], docs), strict=True):
            if len(starts):
                gap = np.flatnonzero(np.diff(starts) > MATCH)
                for low, high in zip(starts[np.r_[0, gap + 1]], starts[np.r_[gap, len(starts) - 1]], strict=True):
                    out.append((r[1], r[2], int(low), int(high) + MATCH))
        yield pa.RecordBatch.from_arrays(
            [pa.array([o[k] for o in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int32()))],
            ["anchor", "context", "low", "high"],
        )

    rows: list[tuple] = []
    size = 0
    for batch in batches:
        for row in zip(*(batch.column(k).to_pylist() for k in ("chunk", "anchor", "context", "doc", "bytes")), strict=True):
            if rows and size > TRANSFORM_BYTES and row[0] != rows[-1][0]:
                yield from settled(rows)
                rows, size = [], 0
            rows.append(row)
            size += len(row[4])
    if rows:
        yield from settled(rows)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes of the asked contexts of each text."""
    for batch in batches:
        texts = batch.column("text").cast(pa.binary())
        columns: list[list] = [[], [], [], []]
        for i, asked in enumerate(batch.column("asked").to_pylist()):
            text, doc = texts[i].as_py(), batch.column("doc")[i].as_py()
            for a in asked:
                low = a["spot"] & (1 << START_BITS) - 1
                high = low + MATCH + (a["spot"] >> START_BITS)
                for column, value in zip(columns, (a["anchor"], a["context"], doc, text[low:high]), strict=True):
                    column.append(value)
        yield pa.RecordBatch.from_arrays(
            [*(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.binary())],
            ["anchor", "context", "doc", "bytes"],
        )


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[list] = [[], [], [], []]
        texts, spans = batch.column("text").cast(pa.binary()), batch.column("spans")
        for i in range(batch.num_rows):
            text = texts[i].as_py() or b""
            kept, n, runs = [], 0, 0
            at = 0
            if spans[i].is_valid:
                low = spans[i].values.field("low").to_numpy()
                high = np.minimum(spans[i].values.field("high").to_numpy(), len(text))
                change = np.zeros(len(text) + 1, np.int64)
                np.add.at(change, low, 1)
                np.add.at(change, high, -1)
                gone = np.cumsum(change[:-1]) > 0
                edges = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(np.int8)))
                for a, b in edges.reshape(-1, 2).tolist():
                    kept.append(text[at:a])
                    n, runs, at = n + b - a, runs + 1, b
            kept.append(text[at:])
            for column, value in zip(out, (len(text), n, runs, hashlib.sha256(b"".join(kept)).hexdigest()), strict=True):
                column.append(value)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in out[:3]), pa.array(out[3], pa.string())],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
        )


def remove_repeated(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (``doc_id``, ``text``): ``n_bytes``, ``n_removed``, ``n_spans``
    (runs of removed bytes) and ``kept_sha256`` of what stays.

    A NULL text is empty. A NULL id counts as greater than any other. Rows of one id
    remove nothing from each other. Texts under MATCH bytes lose nothing. No rows: none."""
    ship_package(docs.sparkSession)
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LAST)).alias("doc"),
        row_hash().alias("row"),
        F.col("text").cast("string").alias("text"),
    )
    met = materialize(
        rows.select("doc", "row", "text")
        .mapInArrow(_occurrences, OCCURRENCES)
        .repartition("anchor")
        .sortWithinPartitions("anchor", "context", "doc")
        .mapInArrow(_sorted_out, SORTED),
        "anchors",
    ).withColumns(
        {
            "start": F.col("spot").bitwiseAND((1 << START_BITS) - 1),
            "size": F.shiftright("spot", START_BITS) + MATCH,
        }
    )
    still_open = met.where("open")
    one = still_open.groupBy("anchor", "context").agg(F.min(F.struct("doc", "row", "spot")).alias("least"))
    asked = one.select("anchor", "context", "least.*").groupBy("doc", "row").agg(
        F.collect_list(F.struct("anchor", "context", "spot")).alias("asked")
    )
    # a repeated row gives its contexts again, which changes no minimum
    contexts = materialize(
        rows.select("doc", "row", "text")
        .join(asked, ["doc", "row"])
        .mapInArrow(_cut, "anchor bigint, context bigint, doc bigint, bytes binary"),
        "contexts",
    )
    sizes = contexts.groupBy("anchor").agg(F.ceil(F.count("*") / F.lit(GROUP_CONTEXTS // 2)).cast("int").alias("blocks"))
    mine = F.pmod(F.xxhash64("context"), F.col("blocks")).cast("int")
    # contexts of an anchor with very many are compared block against block
    chunked = (
        contexts.join(sizes, "anchor")
        .withColumn("mine", mine)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.col("blocks") - 1))))
        .withColumn("chunk", F.xxhash64("anchor", F.least("mine", "other"), F.greatest("mine", "other")))
    )
    found = (
        chunked.select("chunk", "anchor", "context", "doc", "bytes")
        .repartition("chunk")
        .sortWithinPartitions("chunk")
        .mapInArrow(_compared, FOUND)
    )
    covered = met.where("not open").selectExpr("doc", "row", "start AS low", "start + size AS high")
    part = still_open.join(found, ["anchor", "context"]).selectExpr(
        "doc", "row", "start + low AS low", "start + high AS high"
    )
    spans = covered.unionByName(part).groupBy("doc", "row").agg(F.collect_list(F.struct("low", "high")).alias("spans"))
    return rows.join(spans, ["doc", "row"], "left").select("doc_id", "text", "spans").mapInArrow(
        _removed, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
    )
