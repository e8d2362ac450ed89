"""Language identification by cross-parsing entropy.

For each language a suffix automaton holds a bounded sample of its labelled text. A
text is parsed against it into phrases, each the longest match that can be
continued no further; text of that language needs few. Phrases times the bits that
name a place in the sample, per byte, estimate the cross entropy; the language
with the least wins.

An automaton becomes one table (state, byte class) -> state. Texts are cut into
segments that are parsed side by side, one byte of every segment a step, so the
work is array look-ups. A phrase ends at the end of its segment, for every language alike.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accesspanel.llm.common import crc_mod, hash_sample, per_slice, ship_package, spread_text, utf8

#: Bound of the training sample: rows per language, characters of each (from all over its
#: text) and bytes of all of them.
SAMPLE_ROWS = 64
SAMPLE_TEXT = 512
SAMPLE_BYTES = 32 << 10
MAX_LANGUAGES = 512
SEGMENT = 256
SEGMENTS_AT_ONCE = 1 << 14
UNKNOWN = "und"


def suffix_automaton(text: bytes) -> list[dict[int, int]]:
    """Transitions of each state; state 0 has read nothing."""
    go: list[dict[int, int]] = [{}]
    link, longest, last = [-1], [0], 0
    for byte in text:
        state = len(go)
        go.append({})
        longest.append(longest[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and byte not in go[p]:
            go[p][byte] = state
            p = link[p]
        if p >= 0:
            q = go[p][byte]
            if longest[q] == longest[p] + 1:
                link[state] = q
            else:
                copy = len(go)
                go.append(dict(go[q]))
                longest.append(longest[p] + 1)
                link.append(link[q])
                while p >= 0 and go[p].get(byte) == q:
                    go[p][byte] = copy
                    p = link[p]
                link[q] = link[state] = copy
        last = state
    return go


class Parser:
    """Phrase counts of texts against each language's sample."""

    def __init__(self, samples: tuple[tuple[str, bytes], ...]) -> None:
        self.languages = [name for name, _ in samples]
        used = sorted(set(b"".join(s for _, s in samples)))
        self.kind = np.zeros(256, np.int32)  # class 0: bytes no sample has
        self.kind[used] = np.arange(1, len(used) + 1)
        self.width = len(used) + 1
        self.bits = np.log2([max(2, len(s)) for _, s in samples])
        self.tables = [self._table(suffix_automaton(s)) for _, s in samples]

    def _table(self, go: list[dict[int, int]]) -> np.ndarray:
        """Next state times the width; a new phrase (sign bit set) where the match ends.
        The last state continues nothing: texts start there, and go there with a
        byte the sample lacks."""
        table = np.full((len(go) + 1, self.width), -1, np.int64)
        for state, to in enumerate(go):
            for byte, after in to.items():
                table[state, self.kind[byte]] = after * self.width
        restart = np.where(table[0] >= 0, table[0], len(go) * self.width)
        return np.where(table >= 0, table, restart - 2**31).astype(np.int32).ravel()

    def phrases(self, texts: list[bytes]) -> np.ndarray:
        """(texts, languages) numbers of phrases."""
        out = np.zeros((len(texts), len(self.tables)), np.int64)
        owner, start, size = [], [], []
        at = 0
        for i, t in enumerate(texts):
            for a in range(0, len(t), SEGMENT):
                owner.append(i)
                start.append(at + a)
                size.append(min(SEGMENT, len(t) - a))
            at += len(t)
        data = self.kind[np.frombuffer(b"".join(texts) + bytes(SEGMENT), np.uint8)]
        owner, start, size = (np.array(x, np.int64) for x in (owner, start, size))
        by = np.argsort(-size, kind="stable")
        owner, start, size = owner[by], start[by], size[by]
        for a in range(0, len(owner), SEGMENTS_AT_ONCE):
            who, n = owner[a : a + SEGMENTS_AT_ONCE], size[a : a + SEGMENTS_AT_ONCE]
            columns = np.ascontiguousarray(
                data[start[a : a + SEGMENTS_AT_ONCE, None] + np.arange(n[0])[None, :]].T
            )
            alive = np.searchsorted(-n, -np.arange(n[0]), "left")  # segments longer than each step
            for k, table in enumerate(self.tables):
                state = np.full(len(who), len(table) - self.width, np.int32)
                count = np.zeros(len(who), np.int32)
                for step in range(int(n[0])):
                    m = alive[step]
                    found = table.take(state[:m] + columns[step, :m])
                    count[:m] += found < 0
                    np.bitwise_and(found, 0x7FFFFFFF, out=state[:m])
                out[:, k] += np.bincount(who, count, len(texts)).astype(np.int64)
        return out

    def entropies(self, texts: list[bytes]) -> np.ndarray:
        """(texts, languages) bits per byte."""
        length = np.maximum(1, np.array([len(t) for t in texts]))
        return self.phrases(texts) * self.bits[None, :] / length[:, None]


@lru_cache(maxsize=2)
def _parser(samples: tuple[tuple[str, bytes], ...]) -> Parser:
    return Parser(samples)


def letters(text: str) -> Column:
    """Lower-cased words of letters, single-spaced: case, digits and signs tell no language."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{M}]+", " "))


def learn(rows: DataFrame) -> tuple[tuple[str, bytes], ...]:
    """Sample of each language of the rows (``doc_id``, ``text``, ``lang``)."""
    usable = rows.where("lang is not null and text is not null and length(text) > 0")
    picked = (
        hash_sample(usable, "lang", "doc_id", SAMPLE_ROWS, MAX_LANGUAGES)
        .groupBy("lang", "sample_hash")
        .agg(F.min(spread_text(letters("text"), SAMPLE_TEXT, 4)).alias("text"))
        .collect()
    )
    texts: dict[str, bytes] = {}
    for r in sorted(picked, key=lambda r: (r["lang"], r["sample_hash"], r["text"])):
        so_far = texts.get(r["lang"], b"")
        if len(so_far) < SAMPLE_BYTES:
            texts[r["lang"]] = (so_far + r["text"].encode() + b"\n")[:SAMPLE_BYTES]
    return tuple(sorted(texts.items()))


def predict(docs: DataFrame, folds: int = 3, held_fold: int = 1) -> DataFrame:
    """One row per row of ``docs`` (``doc_id``, ``text``, ``lang``): ``held_out`` (crc32
    of the id modulo ``folds`` is ``held_fold``; such rows teach nothing),
    ``lang_pred`` and ``score``, how far the best language leads the next (0 to 1).

    NULL text, text without a letter, and any text while nothing was learned are
    ``und`` with score 0. Equal entropies go to the language first by name. A
    single learned language scores 1. A NULL id counts as empty text for the fold.
    Repeated rows are predicted each. No rows: none."""
    ship_package(docs.sparkSession)
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
        F.col("lang").cast("string").alias("lang"),
        (crc_mod(F.col("doc_id"), folds) == held_fold).alias("held_out"),
    )
    samples = learn(rows.where("not held_out"))

    def predicted(batch: pa.RecordBatch) -> pa.RecordBatch:
        parser = _parser(samples)
        h = parser.entropies(utf8(batch.column("text")))
        best = h.argmin(axis=1) if h.size else np.zeros(0, int)
        ordered = np.sort(h, axis=1)
        lead = 1 - ordered[:, 0] / np.maximum(ordered[:, 1], 1e-9) if h.shape[1] > 1 else np.ones(len(h))
        letters = batch.column("has_letter").to_numpy(zero_copy_only=False)
        names = [parser.languages[b] if ok else UNKNOWN for b, ok in zip(best, letters, strict=True)]
        return pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                batch.column("held_out"),
                pa.array(names, pa.string()),
                pa.array(np.where(letters, np.clip(lead, 0, 1), 0.0)),
            ],
            ["doc_id", "held_out", "lang_pred", "score"],
        )

    if not samples:
        return rows.select("doc_id", "held_out", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    asked = rows.select(
        "doc_id", letters("text").alias("text"), "held_out", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("has_letter")
    )
    return asked.mapInArrow(
        per_slice(predicted), "doc_id bigint, held_out boolean, lang_pred string, score double"
    )
