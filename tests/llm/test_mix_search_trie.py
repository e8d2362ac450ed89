"""Mixing, lexical search and the prefix trie on small inputs."""

import random
from collections import Counter

import duckdb
import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from accesspanel.llm import lexical_search, mixing, prefix_trie

DOCS = "doc_id bigint, text string, source string, size string, place string, row string, pieces string"


def frame(spark, rows):
    """Rows (doc_id, text, source) with columns whose names clash with the operators'."""
    return spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], DOCS)


def order(row):
    return tuple((v is not None, v if v is not None else 0) for v in row)


# mixing


def brute_targets(sizes):
    """Targets by source, excess handed on round after round."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), {}
    while True:
        open_ = [s for s in names if s not in capped]
        left = total - sum(capped.values())
        share = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        above = [s for s in open_ if share[s] > 3 * sizes[s]]
        if not above:
            return {**capped, **share}
        capped |= {s: 3 * sizes[s] for s in above}


def mix_rows():
    rng = random.Random(5)
    rows = []
    for i in range(300):
        source = rng.choice(["hot", "hot", "hot", "a", "b", "é", None])
        rows.append((i, " ".join(f"w{i}x{k}" for k in range(rng.randint(0, 60))), source))
    rows += [(1000, None, "a"), (1001, "", "empty"), (1002, " \t\r\n ", "empty"), (1003, "one", "tiny"), (1004, "long " * 9000, "b")]
    rows += [(None, "no id here", "a"), rows[3], rows[3]]
    return rows


def test_mix_meets_targets_and_limits(spark):
    rows = mix_rows()
    got = mixing.mixture(frame(spark, rows)).collect()
    size = Counter()
    for _, t, s in rows:
        size[s] += len((t or "").split())
    assert sorted((r["doc_id"], r["size"]) for r in got if r["doc_id"] is not None) == sorted(
        (i, len((t or "").split())) for i, t, _ in rows if i is not None
    )
    want = brute_targets(size)
    source_of = {i: s for i, _, s in rows}
    taken = Counter()
    for r in got:
        s = source_of[r["doc_id"]]
        assert r["source_size"] == size[s] and abs(r["target"] - want[s]) < 1e-6
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
    assert all(taken[s] == round(want[s]) for s in size)
    again = mixing.mixture(frame(spark, rows[::-1]).repartition(5)).collect()
    assert sorted(map(tuple, got), key=order) == sorted(map(tuple, again), key=order)


def test_pieces_are_disjoint_draws_in_even_shards(spark):
    rows = mix_rows()
    mixed = mixing.mix(frame(spark, rows), shards=7, block_words=16).collect()
    shards, seen, words = Counter(), {}, Counter()
    for r in mixed:
        times = Counter()
        for p in r["pieces"]:
            draw = (r["source"], p["draw"])
            assert seen.setdefault(draw, p["shard"]) == p["shard"]
            words[draw] += p["words"]
            times.update(range(p["first_word"], p["first_word"] + p["words"]))
        assert all(n <= 3 for n in times.values()) and (not times or max(times) < r["size"])
    shards.update(seen.values())
    assert max(words.values()) <= 16
    assert set(shards) == set(range(7)) and max(shards.values()) - min(shards.values()) <= 1


def test_mixed_texts_hold_the_pieces(spark):
    rows = [(i, " ".join(f"{s}{i}x{k}" for k in range(25)), s) for s in "abc" for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    texts = mixing.mixed_texts(docs, shards=3, block_words=8).collect()
    got = Counter(w for r in texts for w in r["text"].split())
    mixed = mixing.mix(docs, shards=3, block_words=8).collect()
    want = Counter()
    for r in mixed:
        for p in r["pieces"]:
            want.update(f"{r['source']}{r['doc_id']}x{k}" for k in range(p["first_word"], p["first_word"] + p["words"]))
    assert got == want
    by_shard = {}
    for r in texts:
        by_shard.setdefault(r["shard"], []).append(r["place"])
    assert sorted(by_shard) == [0, 1, 2]


def test_mix_of_nothing(spark):
    assert mixing.mixture(frame(spark, [])).collect() == []
    only = mixing.mixture(frame(spark, [(1, None, None), (2, "", "a")])).collect()
    assert sorted(tuple(r) for r in only) == [(1, 0, 0, 0.0, 0, 0), (2, 0, 0, 0.0, 0, 0)]


def test_permutation_and_part_round():
    for n in (1, 2, 3, 4, 5, 16, 17, 1000):
        place = mixing.permuted(np.arange(n), np.full(n, n), np.full(n, 99, np.uint64))
        assert sorted(place) == list(range(n))
    for size, length in ((10, 4), (12, 4), (1, 4), (100, 7)):
        n = -(-size // length)
        lengths = np.array([min(length, size - length * b) for b in range(n)])
        for key in range(6):
            place = mixing.permuted(np.arange(n), np.full(n, n), np.full(n, key, np.uint64))
            for words in range(size):
                one = [np.array([v]) for v in (size, length, n, place[-1], words)]
                drawn, cut = (int(v[0]) for v in mixing.part_round(*one))
                assert lengths[place < drawn].sum() - cut == words
                assert not words or cut < lengths[place == drawn - 1].sum()


def test_splitting_tree_is_exact_and_even():
    quota = np.array([1000, 0, 37, 5])
    out = mixing.split_tree(quota, mixing.even(int(quota.sum()), 7), 3)
    assert (out.sum(axis=0) == quota).all() and np.ptp(out.sum(axis=1)) <= 1
    shares = [mixing.split_tree(quota, mixing.even(1042, 7), seed)[0, 0] for seed in range(200)]
    assert abs(np.mean(shares) - 1000 / 7) < 1.5


def test_word_count_equals_split():
    blank = " \t\n\x0b\x0c\r"
    for t in ("", "a", f"{blank}a{blank}b\x1cc{blank}", "é\u00a0ü x", "a" * 5):
        data = np.frombuffer(t.encode(), np.uint8)
        assert len(mixing.word_starts(data)) == len(t.encode().split())


# search


def search_rows(spark, docs, items, **options):
    got = lexical_search.search_documents(frame(spark, docs), spark.createDataFrame(items, "item_id bigint, text string"), **options)
    return sorted((tuple(r) for r in got.select("item_id", "rank", "doc_id", "score").collect()), key=order)


def sql_rows(docs, items):
    con = duckdb.connect()
    con.execute("create table documents(doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", [r[:2] for r in docs])
    con.execute("create table benchmark(item_id bigint, text varchar)")
    con.executemany("insert into benchmark values (?, ?)", items)
    cursor = con.execute(lexical_search.ORACLE_SQL)
    at = [[d[0] for d in cursor.description].index(c) for c in ("item_id", "rank", "doc_id", "score")]
    return sorted((tuple(r[i] for i in at) for r in cursor.fetchall()), key=order)


def library():
    rng = random.Random(8)
    words = [f"t{k}" for k in range(80)] + ["Straße", "ÉTÉ", "été", "x9"]
    docs = []
    for i in range(700):
        n = rng.choice([0, 1, 3, 20, 90])
        docs.append((i, "".join(rng.choice(words[: rng.choice([6, 84])]) + rng.choice(" .,\n-_[`{") for _ in range(n)), "s"))
    docs += [(900 + i, docs[5][1], "s") for i in range(60)] + [(None, docs[5][1], "s"), docs[7], docs[7]]
    docs += [(1000, None, "s"), (1001, "", "s"), (1002, "?! ...", "s"), (1003, "T1 t2 " * 40_000, "s"), (1004, "y" * 3_000_000 + " t3", "s")]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 30)))) for i in range(25)]
    items += [(50, None), (51, ""), (52, "unknown words only"), (53, "T1, t1; T1!"), items[0], (None, "t4 t5")]
    return docs, items


def test_search_equals_sql(spark):
    docs, items = library()
    got, want = search_rows(spark, docs, items), sql_rows(docs, items)
    assert got == want and len({r[0] for r in got}) == 27


def test_search_in_small_trees_and_item_blocks(spark):
    docs, items = library()
    assert search_rows(spark, docs, items, tree_entries=400, tree_docs=50, block_terms=60) == sql_rows(docs, items)


def test_search_of_nothing(spark):
    assert search_rows(spark, [], [(1, "a")]) == []
    assert search_rows(spark, [(1, "a", "s")], []) == []
    assert search_rows(spark, [(1, "a", "s"), (2, None, "s")], [(1, "A")]) == [(1, 1, 1, 287 * (10**9 // 1800))]


@settings(max_examples=40, deadline=None)
@given(st.text(alphabet="aB1é .-_[", max_size=60), st.integers(1, 9))
def test_term_pieces_equal_whole(text, size):
    before, lexical_search.PIECE_BYTES = lexical_search.PIECE_BYTES, size
    try:
        found = [t for piece in lexical_search.term_pieces(text.encode()) for t in piece]
    finally:
        lexical_search.PIECE_BYTES = before
    assert found == lexical_search.terms(text.encode())


def test_tree_nodes_bound_their_documents():
    rng = np.random.default_rng(1)
    size = rng.integers(1, 12, 3000)
    start = np.r_[0, np.cumsum(size)]
    rank = np.concatenate([np.sort(rng.choice(40, n, replace=False)) for n in size])
    tf, m = rng.integers(1, 5, len(rank)), rng.integers(25, 900, len(size))
    tree = lexical_search.build(start, rank, tf, m, 40)
    seen = []
    stack = [(int(n), []) for n in tree.roots]
    while stack:
        node, path = stack.pop()
        path = [*path, node]
        for d in tree.doc_order[tree.docs[node] : tree.docs[node + 1]]:
            seen.append(d)
            mine = list(zip(rank[start[d] : start[d + 1]], tf[start[d] : start[d + 1]], strict=True))
            for p, (t, n) in zip(path, mine, strict=False):
                assert tree.term[p] == t and tree.top[p] >= n and tree.least_m[p] <= m[d]
            assert tree.kind_m[tree.kind[node]] <= m[d]
        stack += [(n, path) for n in range(tree.child[node], tree.child[node + 1])]
    assert sorted(seen) == list(range(len(size)))


# trie


TURNS = "conv_id bigint, turn bigint, role string, text string, depth string, h1 string, shard string"


def conversations():
    rng = random.Random(3)
    rows = []
    for c in [*range(-25, 90), 777, 2**62]:
        # long runs of equal first turns, so that many conversations share nodes
        turns = [("user" if k % 2 == 0 else None, f"turn {k} {rng.choice('ab' if k < 3 else 'abcdefgh')}") for k in range(rng.randint(1, 6))]
        if c % 7 == 0:
            turns = [("user", "hello"), ("assistant", None), ("user", ""), ("system", "same end")]
        rows += [(c, None if k == 0 else k, role, text) for k, (role, text) in enumerate(turns)]
    rows = [r for r in rows if r[0] not in (40, 60)]  # blocks without a first conversation
    rows += [(300, k, "user", f"t{k % 3}") for k in range(150)] + [(301, k, "user", f"t{k % 3}") for k in range(150)]
    rows += [(302, 5, "b", "tie"), (302, 5, "a", "tie"), (302, 5, "a", "tie"), (None, 1, "user", "of none")]
    return rows


def trie_sql(rows):
    con = duckdb.connect()
    con.execute("create table conversations(conv_id bigint, turn bigint, role varchar, text varchar)")
    con.executemany("insert into conversations values (?, ?, ?, ?)", rows)
    cursor = con.execute(prefix_trie.ORACLE_SQL)
    return [d[0] for d in cursor.description], sorted(cursor.fetchall(), key=order)


def trie_rows(spark, rows, names, **options):
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], TURNS)
    return sorted((tuple(r[n] for n in names) for r in prefix_trie.prefix_trie(df, **options).collect()), key=order)


def test_trie_equals_sql(spark):
    rows = conversations()
    names, want = trie_sql(rows)
    got = trie_rows(spark, rows, names)
    assert got == want


def test_trie_in_many_shards_with_spilling_queues(spark):
    rows = conversations() + [(1000 + i, k, "user", f"shared {k}") for i in range(200) for k in range(3 + i % 4)]
    names, want = trie_sql(rows)
    assert trie_rows(spark, rows, names, heavy_nodes=40, queue_rows=5) == want


def test_trie_of_nothing(spark):
    df = spark.createDataFrame([], TURNS)
    assert prefix_trie.prefix_trie(df).collect() == []


def test_queue_gives_all_messages_in_order():
    rng = np.random.default_rng(2)
    queue = prefix_trie.SpillingQueue(limit=16)
    rows = np.zeros(500, queue.TYPE)
    rows["level"], rows["h1"], rows["children"] = rng.integers(-9, 0, 500), rng.integers(-5, 5, 500), 1
    for k in range(0, 500, 7):
        queue.push(rows[k : k + 7])
    assert queue.runs
    got = np.concatenate([queue.pop(level, h, 0) for level in range(-9, 0) for h in (-2, 4)])
    want = queue.added_up(rows)
    assert (got == want).all() and got["children"].sum() == 500
    assert not queue.runs and not queue.held


# samples


def test_samples_come_from_all_over_a_text(spark):
    from pyspark.sql import functions as F

    from accesspanel.llm.common import spread_text

    rows = [(0, None), (1, ""), (2, "é" * 40), (3, "".join(chr(0x4E00 + i) for i in range(1000)))]
    df = spark.createDataFrame(rows, "i int, t string").select("i", spread_text(F.col("t"), 40, 4).alias("s"))
    got = {r["i"]: r["s"] for r in df.collect()}
    assert got[0] is None and got[1] == "" and got[2] == "é" * 40
    assert got[3] == "".join(rows[3][1][a : a + 10] for a in (0, 330, 660, 990))
