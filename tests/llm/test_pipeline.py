"""The corpus pipeline against the same five steps done plainly in one process."""

import hashlib
import math
import random
import re

import corpus_pipeline
import duckdb
import numpy as np
import public_tokenizers
from test_duplicates import brute_components
from test_texts import DE, EN, ITEM, brute_rules, plain_model, prose
from tokenizers import Tokenizer

from accesspanel.llm import decontamination, line_templates, ngram_lm, quality_rules

BOILER = "All of this text was printed on 7 May by us"


def corpus():
    rng = random.Random(12)
    rows = [(i, prose(rng, EN, rng.randint(60, 90)), "en") for i in range(40)]
    rows += [(100 + i, prose(rng, DE, rng.randint(60, 90)), "de") for i in range(40)]
    rows += [(200 + i, rows[3][1], "en") for i in range(5)]
    words = rows[50][1].split()
    rows += [(300 + i, " ".join([*words[:20], f"other{i}", *words[21:]]), "de") for i in range(2)]
    rows += [(400 + i, f"{prose(rng, EN, 60)}\n{BOILER.replace('7', str(i))}", "en") for i in range(6)]
    rows += [(500, f"{prose(rng, EN, 60)}. {ITEM}", "en"), (501, f"{prose(rng, EN, 60)}.\n{ITEM.replace('12', '31').replace('Tom', 'Eve')}", "en")]
    rows += [(600, None, "en"), (601, "", None), (602, "junk " * 90, "en"), (603, prose(rng, EN, 70), None)]
    rows += [(604, " ".join("".join(chr(rng.randint(0x4E00, 0x9000)) for _ in range(9)) for _ in range(100)), "en"), rows[5]]
    return [(i, t, lang, "src", len(t or "")) for i, t, lang in rows]


def plain(rows):
    """Rows (doc_id, text, lang, source, n_chars) to the result's rows."""
    # quality
    words = [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()) for _, t, *_ in rows]
    texts = [b" ".join(w) for w in words]
    parts = [ngram_lm.END * (ngram_lm.ORDER - 1) + t + ngram_lm.END for t in texts]
    tables = plain_model(texts, ngram_lm.ORDER)
    surprise = [
        -ngram_lm.log_probabilities(tables, ngram_lm.ngrams([p], ngram_lm.ORDER)[0]).sum() / (len(w) + 1)
        for p, w in zip(parts, words, strict=True)
    ]
    failed = [brute_rules(t)[-1] for _, t, *_ in rows]
    bands = {}
    for lang in {r[2] for r in rows}:
        values = sorted(s for s, r, f in zip(surprise, rows, failed, strict=True) if r[2] == lang and not f)
        if values:
            low, high = (values[max(0, math.ceil(p * len(values)) - 1)] for p in (0.25, 0.75))
            spread = quality_rules.FENCES * max(high - low, 0.05)
            bands[lang] = low - spread, high + spread
    kept = [
        r for r, s, f in zip(rows, surprise, failed, strict=True) if not f and bands[r[2]][0] <= s <= bands[r[2]][1]
    ]
    # lines
    con = duckdb.connect()
    con.execute("create table documents(doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", sorted({r[:2] for r in kept}))
    lines = dict(con.execute(f"select doc_id, text from ({line_templates.ORACLE_SQL})").fetchall())
    kept = [(r[0], lines[r[0]]) for r in kept]
    # near-duplicates
    named = {i for i, _, c in brute_components(kept) if i == c}
    kept = sorted({r for r in kept if r[0] in named})
    # benchmark
    item = decontamination.tokenize(ITEM)
    shape = [decontamination.canonical(t)[0] for t in item]
    windows = {tuple(shape[k : k + 8]) for k in range(len(shape) - 7)}

    def clean(text):
        found = [decontamination.canonical(t)[0] for t in decontamination.tokenize(text)]
        return len(windows & {tuple(found[k : k + 8]) for k in range(len(found) - 7)}) < 0.8 * len(windows)

    kept = [r for r in kept if clean(r[1])]
    # tokens
    coder = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out = set()
    for i, t in kept:
        ids = coder.encode(t, add_special_tokens=False).ids
        decoded = coder.decode(ids, skip_special_tokens=False).encode()
        out.add((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded).hexdigest()))
    return out


def test_pipeline_equals_the_plain_steps(spark, folder):
    rows = corpus()
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    got = corpus_pipeline.run(spark, folder).collect()
    assert len(got) == len({r["doc_id"] for r in got})
    assert {tuple(r) for r in got} == plain(rows)
    ids = {r["doc_id"] for r in got}
    assert {3, 5, 110, 603} <= ids
    assert not ids & {201, 204, 500, 501, 600, 602}, ids


def test_line_dedup_sends_the_driver_no_repeated_rows(spark, monkeypatch):
    plans, written = [], line_templates.materialize

    def materialize(df, label):
        df.collect()  # the plan with Spark's own choice of joins
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return written(df, label)

    monkeypatch.setattr(line_templates, "materialize", materialize)
    rows = [(i, f"All rights of Name{chr(65 + i)} are reserved here", "en", "s", 0) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = corpus_pipeline.line_dedup(spark, docs, "")
    assert {(r["doc_id"], r["n_chars"]) for r in kept.collect()} == {(i, len(rows[0][1]) if i == 0 else 0) for i in range(12)}
    plans.append(kept._jdf.queryExecution().executedPlan().toString())
    assert set(re.findall(r"(\w+Join) \[[^]\n]*salt#", "\n".join(plans))) == {"SortMergeJoin"}


def test_stages_return_documents(spark, folder):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, row_key string, drop_id string, n_lines string, stay_row string, hit_row string"
    docs = spark.createDataFrame([(*r, *"abcde") for r in corpus()[:12]], schema)
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs.drop("n_lines"), folder)
        assert kept.columns == docs.drop("n_lines").columns
        assert kept.count() == 12
