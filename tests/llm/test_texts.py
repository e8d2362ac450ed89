"""Language, decontamination, shards, tokens, rules, quality and scores on small inputs."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from urllib.parse import SplitResult, urlsplit

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from accesspanel.llm import (
    bpe,
    decontamination,
    language_id,
    lm_scoring,
    ngram_lm,
    quality_cnn,
    quality_rules,
    sharding,
)

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id bigint, text string, lang string, score string, held_out string, size string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def frame(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", "c")[:6] if len(r) == 3 else (*r, None, "a", "b", "c") for r in rows], SCHEMA)


def prose(rng, syllables, n):
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(n))


EN, DE = ["the", "ing", "tion", "an", "or"], ["sch", "ung", "ein", "ß", "keit"]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(4)
    rows = [(i, prose(rng, EN, rng.randint(60, 120)), "en") for i in range(60)]
    rows += [(100 + i, prose(rng, DE, rng.randint(60, 120)), "de") for i in range(60)]
    rows += [(200, None, "en"), (201, "", "de"), (202, "12 !? 3", "en"), (203, "the", None), (None, prose(rng, EN, 80), "en")]
    rows += [(204, prose(rng, EN, 5000), "en"), (205, "junk junk junk " * 100, "en"), rows[0]]
    return rows


# language


def test_phrases_equal_brute_force():
    rng = random.Random(0)
    for _ in range(20):
        samples = [bytes(rng.choice(b"abcd"[: 3 + k]) for _ in range(rng.randint(1, 50))) for k in range(2)]
        parser = language_id.Parser(tuple(zip("xy", samples, strict=True)))
        texts = [bytes(rng.choice(b"abcde") for _ in range(rng.randint(0, 600))) for _ in range(6)]
        for t, row in zip(texts, parser.phrases(texts), strict=True):
            for sample, got in zip(samples, row, strict=True):
                want = 0
                for a in range(0, len(t), language_id.SEGMENT):
                    rest = t[a : a + language_id.SEGMENT]
                    while rest:
                        n = 1
                        while n < len(rest) and rest[: n + 1] in sample:
                            n += 1
                        want, rest = want + 1, rest[n:]
                assert got == want


def test_languages_are_told_apart(spark, corpus):
    got = language_id.predict(frame(spark, corpus)).collect()
    assert len(got) == len(corpus)
    told = {r["doc_id"]: r for r in got}
    assert all(told[i]["lang_pred"] == lang for i, t, lang in corpus if t and len(t) > 100)
    assert told[None]["lang_pred"] == "en" and told[203]["lang_pred"] == "en"
    assert [told[i]["lang_pred"] for i in (200, 201, 202)] == ["und"] * 3
    assert all(0 <= r["score"] <= 1 for r in got)
    assert told[5]["held_out"] == (zlib.crc32(b"5") % 3 == 1)


def test_nothing_learned_is_undetermined(spark):
    got = language_id.predict(frame(spark, [(2, "words", None), (3, None, "en")])).collect()
    assert {r["lang_pred"] for r in got} == {"und"}


# decontamination

ITEM = "Tom has 12 apples and gives 5 apples to Ann. How many apples does Tom have now in total?"


def test_reparameterised_items_are_found(spark):
    items = spark.createDataFrame([(1, ITEM), (1, ITEM), (2, None), (3, ""), (4, "short one here")], "item_id bigint, text string")
    texts = {
        1: "Well. " + ITEM.replace("Tom", "Bob").replace("12", "1,000").replace("Ann", "Zoe") + " The end.",
        2: ITEM.replace("12", "30").replace("does Tom", "does Ann"),
        3: "Nothing of the kind " * 20,
        4: None,
        5: "x " * 500 + ITEM.upper().lower(),
        6: "A short one here too",
        None: ITEM,
    }
    docs = frame(spark, list(texts.items()) + [(1, texts[1]), (7, "")])
    got = {r["doc_id"]: (r["contaminated"], r["item_ids"]) for r in decontamination.contaminated(docs, items).collect()}
    assert got[1] == got[None] == got[5] == (True, [1])
    assert got[6] == (True, [4])
    assert [got[i][0] for i in (2, 3, 4, 7)] == [False] * 4
    kept = decontamination.clean(docs, items)
    assert sorted(r["doc_id"] for r in kept.collect()) == [i for i in (2, 3, 4, 5, 7) if not got[i][0]]
    assert kept.columns == docs.columns


def brute_found(text, item):
    """Whether the item is found in the text, from the rules, window by window."""
    for stream in (decontamination.TEMPLATE, decontamination.FOLDED):
        sides = [[decontamination.canonical(w, stream) for w in re.findall(r"\d+(?:[.,]\d+)*|\w+", t)] for t in (text, item)]
        size = min(8, len(sides[1]))

        def at(side, start, size=size):
            part = side[start : start + size]
            values = [w + v for w, v in part if v is not None]
            return (tuple(w for w, _ in part), values) if size - len(values) >= min(4, size) else None

        doc, own = ([at(s, k) for k in range(len(s) - size + 1)] for s in sides)
        total = {w[0] for w in own if w}
        seen = set()
        for shift in range(-len(own), len(doc)):
            met = [k for k in range(len(own)) if 0 <= k + shift < len(doc) and own[k] and doc[k + shift] and own[k][0] == doc[k + shift][0]]
            slots = {p for k in met for p in zip(own[k][1], doc[k + shift][1], strict=True)}
            if any(len({p[i] for p in slots}) < len(slots) for i in (0, 1)):
                continue
            seen |= {own[k][0] for k in met}
            if any(all(k + j in met for j in range(13)) for k in met):
                return True
        if total and len(seen) >= 0.8 * len(total):
            return True
    return False


def test_found_items_equal_window_by_window_comparison(spark):
    rng = random.Random(8)
    words = "the cost of a new red box is paid by Ann Bob Eve 12 31 miles 5 hours in May when all boxes are sold".split()
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(3, 40)))) for i in range(12)]
    texts = []
    for _ in range(60):
        part = rng.choice(items)[1].split()
        k = rng.randrange(len(part))
        part = part[k:] if rng.random() < 0.3 else part
        part = [rng.choice(words) if rng.random() < 0.04 else w for w in part]
        swap = dict(zip(["Ann", "Bob", "Eve"], rng.sample(["Zoe", "Max", "Ann"], 3), strict=True))
        part = [swap.get(w, w) for w in part] if rng.random() < 0.5 else part
        text = " ".join([*rng.choices(words, k=rng.randint(0, 30)), *part, *rng.choices(words, k=9)])
        texts.append(rng.choice([str, str.lower, str.upper])(text))
    got = decontamination.contaminated(
        frame(spark, list(enumerate(texts))), spark.createDataFrame(items, "item_id bigint, text string")
    ).collect()
    want = {i: [n for n, item in items if brute_found(t, item)] for i, t in enumerate(texts)}
    assert {r["doc_id"]: r["item_ids"] for r in got} == want
    assert 10 < sum(map(bool, want.values())) < 60


def test_other_case_parts_and_sentence_initial_names(spark):
    long = "A farmer sells eggs at the market. Natalia then buys 12 of them for 3 dollars each. " \
        "Natalia gives half of these to her oldest friend Max and keeps all of the others for herself"
    items = spark.createDataFrame([(1, long)], "item_id bigint, text string")
    tokens = long.split()
    texts = [
        long.upper(), long.lower(), "Question: " + long.replace("Natalia", "Maria").replace("12", "90"),
        "some words first " + " ".join(tokens[12:]), " ".join(tokens[:14]), long.replace("Max", "Natalia"),
    ]
    got = decontamination.contaminated(frame(spark, list(enumerate(texts))), items).collect()
    assert {r["doc_id"]: r["contaminated"] for r in got} == {i: brute_found(t, long) for i, t in enumerate(texts)}
    assert [r["contaminated"] for r in sorted(got, key=lambda r: r["doc_id"])][:5] == [True] * 4 + [False]


def test_a_very_long_text(spark):
    text = "filler words that say nothing " * 200_000 + ITEM + " and more of it" * 1000
    items = spark.createDataFrame([(1, ITEM)], "item_id bigint, text string")
    assert [r["item_ids"] for r in decontamination.contaminated(frame(spark, [(1, text)]), items).collect()] == [[1]]


def test_windows_stay_within_their_text():
    texts = [["a", "b"], [], ["c", "d", "e", "f"], ["g"]]
    key, place = decontamination.windows(texts, 3)
    assert place.tolist() == [2, 3]
    assert key[0] == decontamination.windows([["c", "d", "e"]], 3)[0][0]
    assert not len(decontamination.windows([], 3)[0])


def test_no_benchmark_marks_nothing(spark):
    empty = spark.createDataFrame([], "item_id bigint, text string")
    assert [r["contaminated"] for r in decontamination.contaminated(frame(spark, [(1, ITEM)]), empty).collect()] == [False]


# shards


def test_packing_equals_brute_force():
    rng = random.Random(1)
    for _ in range(200):
        sizes = [rng.choice([rng.randint(1, 40), 7, 9]) for _ in range(rng.randint(1, 80))]
        capacity = rng.randint(20, 100)
        runs, shards = sharding.best_fit_decreasing(list(Counter(sizes).items()), capacity)
        free = []
        for size in sorted(sizes, reverse=True):
            fits = [k for k, f in enumerate(free) if f >= size]
            if fits:
                free[min(fits, key=lambda k: (free[k], k))] -= size
            else:
                free.append(max(capacity, size) - size)
        filled, largest = Counter(), {}
        for size, shard, n in runs:
            filled[shard] += size * n
            largest[shard] = max(largest.get(shard, 0), size)
        assert shards == len(free)
        assert sorted(max(capacity, largest[s]) - filled[s] for s in filled) == sorted(free)


def test_shards_are_even_and_groups_whole(spark, corpus):
    rows = corpus + [(1000 + i, "same text") for i in range(50)] + [(None, "same text")]
    got = sharding.shard_documents(frame(spark, rows), 8).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in rows)
    bytes_of, slots = Counter(), {}
    for r in got:
        bytes_of[r["shard"]] += r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
        assert r["law"] == "bytes" and r["grown_shard"] is None
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len({r["shard"] for r in got if r["text_crc32"] == zlib.crc32(b"same text")}) == 1
    own = max(r["size"] for r in got)
    rest = sorted(v for v in bytes_of.values() if v != own)
    assert rest[-1] - rest[0] <= 0.05 * rest[-1]
    assert sharding.shard_documents(frame(spark, [])).count() == 0


def test_size_classes_round_up_and_are_few(spark):
    sizes = [1, 4095, 4096, 4097, 10**6, 10**9 + 1, 10**15]
    df = spark.createDataFrame([(s,) for s in sizes], "s bigint")
    for r in df.select("s", sharding.size_class(df["s"]).alias("c")).collect():
        assert r["s"] <= r["c"] <= r["s"] * (1 + 2.0 ** (1 - sharding.PRECISION))


# tokens


@pytest.fixture(scope="module")
def coders():
    with open(VOCABULARY) as f:
        return bpe.Bpe(f.read()), Tokenizer.from_file(VOCABULARY)


LETTERS = st.one_of(
    st.characters(exclude_categories=["Cs", "Cn"], max_codepoint=0x1FFFF),
    st.sampled_from("aeinthor'st ' <|endoftext|>İΣΑς\x1c\x85\n"),
)


@settings(max_examples=400, deadline=None)
@given(text=st.text(alphabet=LETTERS))
def test_bpe_equals_the_library(coders, text):
    mine, library = coders
    ids = library.encode(text, add_special_tokens=False).ids
    assert mine.encode(text) == ids
    assert mine.encode_and_decode(text)[1].decode() == library.decode(ids, skip_special_tokens=False)


def test_bpe_on_joined_tokens_and_long_words(coders):
    mine, library = coders
    rng = random.Random(0)
    tokens = list(library.get_vocab())
    for text in ["".join(rng.choice(tokens).replace("</w>", "") for _ in range(6)) for _ in range(2000)] + ["ab" * 50_000]:
        assert mine.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_tokenized_rows(spark, coders):
    rows = [(1, "Hello wörld <|endoftext|> 12"), (2, None), (3, ""), (None, "x"), (1, "Hello wörld <|endoftext|> 12")]
    got = bpe.tokenize(frame(spark, rows), VOCABULARY).collect()
    want = Counter()
    for i, t in rows:
        ids = coders[1].encode(t or "", add_special_tokens=False).ids
        decoded = coders[1].decode(ids, skip_special_tokens=False).encode()
        want[(i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded).hexdigest())] += 1
    assert Counter(tuple(r) for r in got) == want


# n-gram model, rules and scores


def brute_model(texts, order):
    """Kneser-Ney over bytes with plain dictionaries."""
    counts = {n: Counter() for n in range(1, order + 1)}
    for t in texts:
        body = b"\n" * (order - 1) + t + b"\n"
        for i in range(order - 1, len(body)):
            counts[order][body[i - order + 1 : i + 1]] += 1
    for n in range(order - 1, 0, -1):
        for gram in counts[n + 1]:
            counts[n][gram[1:]] += 1
    d = {n: ngram_lm.discounts(*([*c.values()].count(k) for k in (1, 2, 3, 4))) for n, c in counts.items()}

    def p(context, byte):
        n = len(context) + 1
        below = p(context[1:], byte) if n > 1 else 1 / 256
        after = {g[-1]: c for g, c in counts[n].items() if g[:-1] == context}
        total = sum(after.values())
        if not total:
            return below
        left = sum(d[n][min(c, 3)] for c in after.values()) / total
        c = after.get(byte, 0)
        return (c - d[n][min(c, 3)]) / total + left * below

    return p


def plain_model(texts, order):
    """The model of all texts with sorted arrays in one process: tables as workers map them."""
    parts = [ngram_lm.END * (order - 1) + t + ngram_lm.END for t in texts]
    last = np.unique(ngram_lm.ngrams(parts, order)[0], return_counts=True)
    counts = [last]
    for n in range(order - 1, 0, -1):
        counts.append(np.unique(counts[-1][0] & np.uint64((1 << 8 * n) - 1), return_counts=True))
    p, backoff = {0: {0: 1 / 256}}, {}
    for n, (grams, times) in enumerate(reversed(counts), 1):
        d = ngram_lm.discounts(*(int((times == k).sum()) for k in (1, 2, 3, 4)))
        total, taken = Counter(), Counter()
        for g, c in zip(grams.tolist(), times.tolist(), strict=True):
            total[g >> 8] += c
            taken[g >> 8] += d[min(c, 3)]
        backoff[n - 1] = {c: taken[c] / total[c] for c in total}
        p[n] = {
            g: (c - d[min(c, 3)]) / total[g >> 8] + backoff[n - 1][g >> 8] * p[n - 1][g & ((1 << 8 * (n - 1)) - 1)]
            for g, c in zip(grams.tolist(), times.tolist(), strict=True)
        }
    tables = []
    for n in range(order + 1):
        keys = np.array(sorted({*p[n], *backoff.get(n, {})}), np.uint64)
        values = [np.log10([x.get(k, np.nan) for k in keys.tolist()]).astype("f4") for x in (p[n], backoff.get(n, {}))]
        hashes = ngram_lm.mix(keys, n)
        by = np.argsort(hashes)
        tables.append((hashes[by], values[0][by], values[1][by]))
    return tables


def test_model_equals_brute_force_and_sums_to_one():
    texts = [b"abab cab", b"ba", b"", b"abc abc abc", b"cc"]
    order = 3
    p = brute_model(texts, order)
    tables = plain_model(texts, order)
    for context in (b"ab", b"\n\n", b"zz", b"za"):
        asked = np.array([int.from_bytes(context + bytes([b]), "big") for b in range(256)], np.uint64)
        got = 10 ** ngram_lm.log_probabilities(tables, asked)
        assert abs(got.sum() - 1) < 1e-5
        assert np.allclose(got, [p(context, b) for b in range(256)], rtol=1e-5)


@pytest.mark.parametrize("order", [1, 3, 8])
def test_model_of_spark_equals_the_plain_one(spark, monkeypatch, order):
    monkeypatch.setattr(ngram_lm, "FILE_ENTRIES", 700)
    rng = random.Random(order)
    texts = [prose(rng, EN, 60) for _ in range(20)] + ["".join(chr(rng.randint(1, 0x9000)) for _ in range(300)), "", None]
    model = ngram_lm.train(spark.createDataFrame([(t,) for t in texts + texts[:3]], "text string"), order)
    raw = [ngram_lm.normal((t or "").encode()) for t in texts + texts[:3]]
    want = plain_model(raw, order)
    got = ngram_lm.mapped(model)
    assert order == 1 or len(model.files) > 1
    assert len(got) == len(want) == order + 1
    for mine, plain in zip(got, want, strict=True):
        assert np.array_equal(mine[0], plain[0])
        for k in (1, 2):
            assert np.allclose(mine[k], plain[k], rtol=1e-5, atol=1e-6, equal_nan=True)
    parts = [ngram_lm.END * (order - 1) + t + ngram_lm.END for t in raw]
    one_by_one = [ngram_lm.log_probabilities(want, ngram_lm.ngrams([x], order)[0]).sum() for x in parts]
    assert np.allclose(model.scores(raw), one_by_one, rtol=1e-5)


def test_model_that_spark_sends_equals_the_mounted_one(spark, monkeypatch):
    rows = spark.createDataFrame([("one two three",), ("two three four",)], "text string")
    mounted = ngram_lm.train(rows)
    monkeypatch.setattr(ngram_lm, "urlsplit", lambda x: SplitResult("remote", "", urlsplit(x).path, "", ""))
    sent = ngram_lm.train(rows)
    assert mounted.folder and sent.folder is None
    texts = [b"one two", b"", b"five"]
    assert np.allclose(mounted.scores(texts), sent.scores(texts))


def test_model_of_no_rows_is_uniform(spark):
    model = ngram_lm.train(spark.createDataFrame([], "text string"))
    assert np.allclose(model.scores([b"", b"ab"]), np.log10([1 / 256, 1 / 256**3]))


def test_pieces_count_every_byte_once(monkeypatch):
    texts = [b"abcdefgh" * 5, b"", b"xyz"]
    whole = np.sort(ngram_lm.ngrams([p for _, p in next(ngram_lm.pieces(texts, 4))], 4)[0])
    monkeypatch.setattr(ngram_lm, "PIECE_BYTES", 7)
    cut = np.concatenate([ngram_lm.ngrams([p for _, p in g], 4)[0] for g in ngram_lm.pieces(texts, 4)])
    assert np.array_equal(whole, np.sort(cut))


def brute_rules(text):
    words = WORD.findall(text or "")
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = Counter(x for x in (text or "").split("\n") if WORD.search(x))
    n_symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), n_symbols, sum(lines.values()) - len(lines), len(covered), failed


def test_rules_equal_brute_force(spark, corpus):
    rng = random.Random(9)
    odd = " ".join("".join(chr(rng.randint(0x4E00, 0x9000)) for _ in range(9)) for _ in range(100))
    rows = corpus + [(300, odd, "en"), (301, "a b é\x1c# a\n\na b\na b", "en"), (302, prose(rng, EN, 70), None)]
    got = quality_rules.verdicts(frame(spark, rows)).collect()
    by_id = {r["doc_id"]: r for r in got}
    assert len(got) == len(rows)
    for i, t, _ in rows:
        r = by_id[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == brute_rules(t)
        assert not (r["kept"] and r["base_failed"])
    assert not by_id[300]["kept"] and not by_id[205]["kept"] and by_id[302]["kept"]
    assert all(by_id[i]["kept"] for i in [*range(60), *range(100, 160), None])
    kept = quality_rules.keep(frame(spark, rows))
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(i for i, _, _ in rows if by_id[i]["kept"])


@pytest.mark.parametrize("chunk", [32 << 20, 300])
def test_scores_equal_brute_force(spark, corpus, monkeypatch, chunk):
    monkeypatch.setattr(lm_scoring, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(lm_scoring, "BLOCK_BYTES", chunk // 2)
    got = lm_scoring.score_documents(frame(spark, corpus)).collect()
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    tokens = [[*WORD.findall((t or "").translate(lower)), "\n"] for _, t, _ in corpus]
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1 for i, _, _ in corpus]
    counts = Counter(w for ws, h in zip(tokens, held, strict=True) if not h for w in ws)
    total, kinds = sum(counts.values()), len(counts)
    want = Counter()
    for (i, _, _), ws, h in zip(corpus, tokens, held, strict=True):
        base = sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (kinds + 1))) for w in ws)
        want[(i, h, len(ws), sum(counts[w] > 0 for w in ws), total, round(base, 6))] += 1
    names = ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens")
    assert Counter((*(r[n] for n in names), round(r["base_score"], 6)) for r in got) == want
    unseen = [r for r in got if r["held_out"] and r["n_tokens"] > 50]
    assert sum(r["score"] for r in unseen) > sum(r["base_score"] for r in unseen)
    assert all(r["score"] < 0 for r in got)


# quality


def test_gradients_equal_differences():
    rng = np.random.default_rng(0)
    texts = [bytes(rng.integers(97, 123, n).astype(np.uint8)) for n in (30, 300, 500)]
    y, w = np.array([0, 1, 1]), np.ones(3)
    net = quality_cnn.Network(
        rng.normal(0, 0.5, (quality_cnn.WIDTH, quality_cnn.INPUTS, quality_cnn.FILTERS)),
        rng.normal(0, 0.5, quality_cnn.FILTERS), rng.normal(0, 0.5, 2 * quality_cnn.FILTERS + 1),
    )
    net.tracking = True
    symbol, blocks = quality_cnn.symbols(texts)

    def loss():
        p = net.probabilities(texts)
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p)) + 5e-4 * (net.out**2).sum()

    for parameter, gradient in zip((net.filters, net.bias, net.out), quality_cnn._gradients(net, symbol, blocks, y, w), strict=True):
        for k in np.argsort(-np.abs(gradient).ravel())[:5]:
            at, step = np.unravel_index(k, gradient.shape), 1e-3
            parameter[at] += step
            up = loss()
            parameter[at] -= 2 * step
            down = loss()
            parameter[at] += step
            assert gradient[at] == pytest.approx((up - down) / (2 * step), rel=0.1, abs=1e-3)


def test_quality_on_held_out_rows(spark):
    rng = random.Random(3)
    rows, marks = [], []
    for i in range(160):
        good = i % 2
        text = prose(rng, EN, 60) if good else " ".join(w + "!!" for w in prose(rng, EN, 60).upper().split())
        rows.append((i, text))
        marks.append((i, good, 0))
    rows += [(500, None), (501, ""), (None, prose(rng, EN, 40)), (0, rows[0][1]), (502, "the " * 20_000)]
    labels = spark.createDataFrame([*marks, (500, None, None), (501, 7, 0), (None, 1, 0)], "doc_id bigint, quality int, text int")
    got = quality_cnn.score(frame(spark, rows), labels).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["predicted"] == (r["score"] >= 0.3) for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 160]
    assert np.mean([r["predicted"] == r["doc_id"] % 2 for r in held]) > 0.95
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in held)
    none = quality_cnn.score(frame(spark, rows[:3]), labels.where("quality = 9"))
    assert [r["score"] for r in none.collect()] == [0.5] * 3


def test_no_rows(spark):
    empty = frame(spark, [])
    items = spark.createDataFrame([(1, ITEM)], "item_id bigint, text string")
    labels = spark.createDataFrame([], "doc_id bigint, quality int")
    assert language_id.predict(empty).count() == 0
    assert decontamination.contaminated(empty, items).count() == 0
    assert bpe.tokenize(empty, VOCABULARY).count() == 0
    assert quality_rules.verdicts(empty).count() == 0
    assert quality_cnn.score(empty, labels).count() == 0
    assert lm_scoring.score_documents(empty).count() == 0
