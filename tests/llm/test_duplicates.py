"""SimHash groups, repeated passages and line templates against brute force."""

import hashlib
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash

from accesspanel.llm import common, golay_simhash, line_templates, repeated_passages

DOCS = "doc_id bigint, text string, source string, fp string, row string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "s", "x", "y") for i, t in rows], DOCS)


def sentence(rng, n=60):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(n))


@pytest.fixture(scope="module")
def mixed():
    rng = random.Random(5)
    base = [sentence(rng, rng.randint(5, 120)) for _ in range(25)]
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(100 + i, rng.choice(base)) for i in range(20)]
    for i in range(40):
        words = rng.choice(base).split()
        words[rng.randrange(len(words))] = "changed"
        rows.append((200 + i, " ".join(words)))
    rows += [(300, None), (301, ""), (302, "  \n "), (303, "One"), (304, "one two"), (305, base[0] * 400)]
    rows += [(100, rows[25][1]), (None, base[1]), (None, None)]
    return rows


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows):
    fps = [brute_fingerprint(t) for _, t in rows]
    of = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for a in range(len(rows)):
            for b in range(a):
                if (fps[a] ^ fps[b]).bit_count() <= 3 and of[a] != of[b]:
                    of = [min(of[a], of[b]) if x in (of[a], of[b]) else x for x in of]
                    changed = True
    least = {c: min((rows[k][0] for k in range(len(rows)) if of[k] == c and rows[k][0] is not None), default=None) for c in of}
    return Counter((rows[k][0], f"{fps[k]:016x}", least[of[k]]) for k in range(len(rows)))


def test_simhash_groups_equal_brute_force(spark, mixed):
    got = golay_simhash.near_duplicates(frame(spark, mixed)).collect()
    assert Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got) == brute_components(mixed)


def test_one_row_of_each_group_stays(spark, mixed):
    kept = golay_simhash.one_of_each(frame(spark, mixed)).collect()
    groups = {c for _, _, c in brute_components(mixed)}
    assert sorted(r["doc_id"] for r in kept) == sorted(groups)
    assert set(kept[0].asDict()) == {"doc_id", "text", "source", "fp", "row"}


@pytest.mark.parametrize("limit", [2048, 4])
def test_search_keys_miss_no_link(spark, monkeypatch, limit):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 40).astype(np.uint64) << np.uint64(1)
    near = [b ^ np.uint64(1 << 63) for b in base[:10]] + [b ^ np.bitwise_or.reduce(np.uint64(1) << rng.choice(64, 3, replace=False).astype(np.uint64)) for b in base]
    dense = [base[0] ^ np.uint64(1 << k) for k in range(40)]
    fps = np.unique(np.r_[base, near, dense].astype(np.uint64)).view(np.int64)
    monkeypatch.setattr(golay_simhash, "GROUP_ROWS", limit)
    edges = golay_simhash.near_edges(spark.createDataFrame([(int(x),) for x in fps], "fp bigint"))
    roots = {r["node"]: r["root"] for r in common.components(edges).collect()}
    bits = fps.view(np.uint64)
    close = np.bitwise_count(bits[:, None] ^ bits[None, :]) <= 3
    for a, b in zip(*np.where(close), strict=True):
        if a != b:
            assert roots[int(fps[a])] == roots[int(fps[b])]
    for r in edges.collect():
        assert roots[r["a"]] == roots[r["b"]]


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 140)] + [(7, 7)]
    found = common.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    assert {(r["node"], r["root"]) for r in found} == {(i, 0) for i in range(41)} | {(k, 100) for k in range(100, 140)}


def test_found_earlier_equals_brute_force():
    rng = random.Random(3)
    for _ in range(60):
        match = rng.choice([9, 12, 20, 50])
        base = [bytes(rng.choice(b"ab") for _ in range(90)) for _ in range(3)]
        texts = [rng.choice(base)[rng.randint(0, 20) : rng.randint(30, 90)] for _ in range(rng.randint(1, 8))]
        docs = np.array([rng.randint(0, 5) for _ in texts])
        for t, d, got in zip(texts, docs, repeated_passages.found_earlier(texts, docs, match), strict=True):
            want = [a for a in range(len(t) - match + 1) if any(e < d and t[a : a + match] in u for u, e in zip(texts, docs, strict=True))]
            assert got.tolist() == want


def brute_removal(rows):
    out = Counter()
    key = lambda i: 1 << 63 if i is None else i
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for a in range(len(b) - 49):
            s = b[a : a + 50]
            first[s] = min(first.get(s, key(i)), key(i))
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for a in range(len(b) - 49):
            if first[b[a : a + 50]] < key(i):
                gone[a : a + 50] = True
        spans = int((np.diff(np.r_[False, gone].astype(int)) == 1).sum())
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out[(i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())] += 1
    return out


@pytest.mark.parametrize("groups", [1 << 14, 8])
def test_repeated_passages_equal_brute_force(spark, mixed, monkeypatch, groups):
    monkeypatch.setattr(repeated_passages, "GROUP_CONTEXTS", groups)
    rng = random.Random(8)
    shared = sentence(rng, 30)
    rows = mixed + [(400 + i, sentence(rng, 4) + shared[: 40 + 5 * i] + sentence(rng, 5)) for i in range(12)]
    rows += [(500, "é" * 60), (501, "x" + "é" * 40), (502, "ab" * 300), (503, "ab" * 200), (503, sentence(rng, 20))]
    got = repeated_passages.remove_repeated(frame(spark, rows)).collect()
    names = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert Counter(tuple(r[n] for n in names) for r in got) == brute_removal(rows)


def test_long_texts_are_cut_into_segments(spark, monkeypatch):
    rng = random.Random(2)
    text = sentence(rng, 900)
    rows = [(1, text), (2, "x" + text), (3, text[100:900] + "?" + text[:300])]
    monkeypatch.setattr(repeated_passages, "SEGMENT_BYTES", 257)
    occurrences = list(repeated_passages.anchors(text.encode()))
    assert len(occurrences) > 10
    covered = sorted((int(a), int(a + n)) for lows, sizes, _, _ in occurrences for a, n in zip(lows, sizes, strict=True))
    starts = [p for a, b in covered for p in range(a, b - 49)]
    assert starts == list(range(len(text) - 49))  # every string once
    got = repeated_passages.remove_repeated(frame(spark, rows)).collect()
    names = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert Counter(tuple(r[n] for n in names) for r in got) == brute_removal(rows)


BOILER = "This page was made on 1 May for you"
LINES = [
    (1, f"{BOILER}\nAlpha beta gamma delta epsilon zeta\n"),
    (2, "This page was made on 23 May for you\nsome other words that stand here alone"),
    (3, "x\nThis  page was made on 4 May for you\r\nlast"),
    (4, "Posted with great care by our friend Ann in town today\nshort"),
    (5, "Posted with great care by our friend Bob in town today\nshort"),
    (6, "Posted with great care by our friend Cy in town today\nshort"),
    (7, None),
    (8, ""),
    (9, "\n\n"),
]


def test_recurring_templates_stay_in_their_first_document(spark):
    got = {r["doc_id"]: r for r in line_templates.drop_recurring(frame(spark, [*LINES, (None, BOILER)])).collect()}
    assert got[1]["text"] == LINES[0][1] and got[1]["n_dropped"] == 0
    assert got[2]["text"] == "some other words that stand here alone"
    assert got[3]["text"] == "x\nlast" and (got[3]["n_lines"], got[3]["n_dropped"]) == (3, 1)
    assert got[4]["text"] == LINES[3][1] and got[5]["text"] == got[6]["text"] == "short"
    assert got[7]["text"] is None and got[7]["n_lines"] == 0
    assert got[8]["text"] == "" and got[9]["text"] == "\n\n" and got[9]["n_lines"] == 3
    assert got[None]["text"] == "" and got[None]["source"] == "s"


@pytest.mark.parametrize("each", [2, 12])
def test_two_fields_of_repeated_values_are_found_at_any_size(spark, each):
    names, towns = [f"Name{chr(65 + i)}" for i in range(each)], [f"Town{chr(65 + i)}" for i in range(3)]
    rows = [(i, f"Sent with regards from {n} of {t} today") for i, (n, t) in enumerate((n, t) for n in names for t in towns)]
    rows += [(1000 + i, f"Sent with regards to all of them number{chr(97 + i)} x y") for i in range(2)]
    got = {r["doc_id"]: r["text"] for r in line_templates.drop_recurring(frame(spark, rows)).collect()}
    assert got[0] == rows[0][1] and got[1000] and got[1001]
    # with two names only towns vary in three lines: one template for each name
    kept = [i for i, t in got.items() if t and i < 1000]
    assert kept == ([0] if each > 2 else kept) and len(kept) == (1 if each > 2 else 2)


def test_long_lines_recur_from_two_documents_and_lines_of_one_count_once(spark):
    long = " ".join(f"{chr(97 + i % 26)}word{chr(97 + i // 26)}" for i in range(60))
    rows = [(1, long), (2, f"own words here\n{long}"), (3, "Call us at 5 or more\nCall us at 6 or more"), (4, "Call us at 7 or more")]
    rows += [(10 + i, f"All rights reserved.\n12\nline of its own {chr(97 + i) * 3}") for i in range(10)]
    rows += [(30 + i, "Home page\n12") for i in range(9)]
    got = {r["doc_id"]: r["text"] for r in line_templates.drop_recurring(frame(spark, rows)).collect()}
    assert got[1] == long and got[2] == "own words here"
    assert got[3] == rows[2][1] and got[4] == rows[3][1]
    assert got[10] == rows[4][1] and got[11] == "12"
    assert all(got[30 + i] == "Home page\n12" for i in range(9))


def test_line_templates_equal_sql(spark):
    rng = random.Random(1)
    words = ["alpha", "beta", "7", "gamma", "x1", "delta"]
    rows = LINES[:6] + [
        (10 + i, "\n".join(" ".join(rng.choice(words[:2]) for _ in range(4)) + f" {rng.choice(words)} end" for _ in range(5)))
        for i in range(40)
    ]
    con = duckdb.connect()
    con.execute("create table documents(doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", rows)
    cursor = con.execute(line_templates.ORACLE_SQL)
    names = [d[0] for d in cursor.description]
    got = line_templates.drop_recurring(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {tuple(r[n] for n in names) for r in got} == set(cursor.fetchall())


def test_line_templates_broadcast_no_repeated_rows(spark, monkeypatch):
    plans, written = [], common.materialize

    def materialize(df, label):
        df.collect()  # the plan with Spark's own choice of joins
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return written(df, label)

    monkeypatch.setattr(line_templates, "materialize", materialize)
    rows = [(10 * i + k, f"Sent with regards from Name{chr(65 + k)} of Town{chr(65 + i)} today") for i in range(4) for k in range(5)]
    left = line_templates.drop_recurring(frame(spark, rows))
    assert [r["doc_id"] for r in left.collect() if r["text"]] == [0]
    plans.append(left._jdf.queryExecution().executedPlan().toString())
    repeated = re.findall(r"(\w+Join) \[[^]\n]*salt#", "\n".join(plans))
    assert repeated and set(repeated) == {"SortMergeJoin"}
    assert set(re.findall(r"(\w+Join) .*LeftAnti", "\n".join(plans))) == {"SortMergeJoin"}


def test_no_rows(spark):
    empty = frame(spark, [])
    assert golay_simhash.near_duplicates(empty).count() == 0
    assert golay_simhash.one_of_each(empty).count() == 0
    assert repeated_passages.remove_repeated(empty).count() == 0
    assert line_templates.drop_recurring(empty).count() == 0
