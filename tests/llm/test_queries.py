"""The registered queries over a given set of tables."""

import os

import __spark_entry__ as registry
import duckdb
import pytest

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="given tables absent")

COLUMNS = {
    "op1_cross_parsing": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op2_benchmark_templates": "doc_id bigint, contaminated boolean, item_ids array<bigint>, coverage double",
    "op3_golay_simhash": "doc_id bigint, fingerprint string, component_id bigint",
    "op4_repeated_passages": "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string",
    "op5_best_fit_shards": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op6_backtracking_bpe": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op7_perplexity_rules": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, "
    "n_repeat_words bigint, base_failed boolean, kept boolean",
    "op8_byte_cnn": "doc_id bigint, held_out boolean, score double, predicted int",
    "op9_kneser_ney": "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, "
    "base_score double, score double",
    "op10_line_templates": "doc_id bigint, text string, n_lines bigint, n_dropped bigint",
    "op11_hypergeometric_mix": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
}


@pytest.fixture(scope="module")
def documents(spark):
    return sorted(r["doc_id"] for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect())


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_one_row_per_document(spark, documents, name):
    df = registry.queries()[name](spark, SF_DIR)
    types = dict(df.dtypes)
    for column in COLUMNS[name].split(", "):
        column, kind = column.rsplit(" ", 1)
        assert types[column] == kind
    assert sorted(r["doc_id"] for r in df.select("doc_id").collect()) == documents


@pytest.mark.parametrize("name", ["op10_line_templates", "op12_fp_tree_search", "op13_prefix_trie"])
def test_rows_equal_their_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "conversations"):
        con.execute(f"create view {table} as select * from '{SF_DIR}/{table}.parquet'")
    cursor = con.execute(registry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    got = registry.queries()[name](spark, SF_DIR).collect()

    def order(row):
        return tuple((v is not None, v if v is not None else 0) for v in row)

    assert sorted((tuple(r[n] for n in names) for r in got), key=order) == sorted(cursor.fetchall(), key=order)


def test_pipeline_keeps_some_documents(spark, documents):
    got = [r["doc_id"] for r in registry.queries()["pipeline"](spark, SF_DIR).collect()]
    assert got and len(got) == len(set(got)) and set(got) < set(documents)
