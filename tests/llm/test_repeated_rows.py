"""Rows of one id whose hashes agree in their first bits are told apart."""

import random
from collections import Counter

import xxhash
from test_duplicates import brute_removal, frame, sentence

from accesspanel.llm import repeated_passages


def test_rows_of_one_id_with_like_hashes(spark):
    rng = random.Random(4)
    shared, own = sentence(rng, 30), sentence(rng, 20)
    head = lambda t: xxhash.xxh64_intdigest(t.encode(), 42) >> 42  # noqa: E731  (row_hash without an id)
    long = {head(t): t for t in (f"{i} {own} {shared}" for i in range(9000))}
    pairs = [(long[head(t)], t) for t in (f"{i} of its own" * 5 for i in range(9000)) if head(t) in long]
    assert pairs
    rows = [(1, shared), *((None, t) for t in pairs[0])]
    got = repeated_passages.remove_repeated(frame(spark, rows)).collect()
    names = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert Counter(tuple(r[n] for n in names) for r in got) == brute_removal(rows)
