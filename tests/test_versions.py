"""Table versions, checks while writing, rejected rows."""

import os

import pytest
from conftest import rows
from pyspark.sql import functions as F

from accesspanel.operators import observed
from accesspanel.operators.quality import CheckFailed
from accesspanel.plans import builders
from accesspanel.sources import rejects, tables, versions
from accesspanel.sources.contracts import Contract, Field


def failing(df, column="id"):
    stop = F.raise_error(F.lit("stopped")).cast("bigint")
    return df.withColumn(column, F.when(F.col(column) == 900, stop).otherwise(F.col(column)))


def test_a_write_that_dies_leaves_the_old_table(spark, folder):
    tables.write_layer(spark.range(10), folder, "raw", "t")
    path = tables.layer_path(folder, "raw", "t")
    before = versions.current_version(spark, path)
    with pytest.raises(Exception, match="stopped"):
        tables.write_layer(failing(spark.range(1000, numPartitions=4)), folder, "raw", "t")
    # the dead run's files are there, and nobody sees them
    assert len(os.listdir(f"{path}/versions")) == 2
    assert versions.current_version(spark, path) == before and versions.versions(spark, path) == [before]
    assert tables.read_layer(spark, folder, "raw", "t").count() == 10
    tables.write_layer(spark.range(7), folder, "raw", "t")
    tables.write_layer(spark.range(8), folder, "raw", "t")
    assert tables.read_layer(spark, folder, "raw", "t").count() == 8
    assert len(versions.versions(spark, path)) == versions.KEPT == len(os.listdir(f"{path}/versions"))
    assert [n for n in os.listdir(path) if "CURRENT-" in n] == []


def test_running_readers_keep_their_files(spark, folder):
    old = tables.write_layer(spark.range(10), folder, "raw", "t")
    tables.write_layer(spark.range(3), folder, "raw", "t")
    assert old.count() == 10
    path = tables.layer_path(folder, "raw", "t")
    versions.restore_previous(spark, path)
    assert tables.read_layer(spark, folder, "raw", "t").count() == 10
    with pytest.raises(ValueError, match="no earlier version"):
        versions.restore_previous(spark, path)
    with pytest.raises(ValueError, match="no complete version"):
        versions.publish(spark, path, "v0")


def test_folder_without_versions_is_read_as_it_is(spark, folder):
    spark.range(4).write.parquet(f"{folder}/raw/plain")
    assert tables.read_layer(spark, folder, "raw", "plain").count() == 4
    tables.write_layer(spark.range(5), folder, "raw", "empty")
    tables.write_layer(spark.range(0), folder, "raw", "empty")
    assert tables.read_layer(spark, folder, "raw", "empty").count() == 0


CONTRACT = Contract("clean.t", (Field("id", "bigint", required=True), Field("v", "int")), keys=("id",))


def test_repeated_key_leaves_the_old_table(spark, folder):
    good = spark.range(5).withColumn("v", F.lit(1))
    reports = []
    builders.write_checked(good, folder, CONTRACT, reports)
    assert [tuple(r)[:5] for r in reports[0].collect()] == [
        ("clean.t", "rows", "", 5, 1),
        ("clean.t", "nulls", "id", 0, 1),
    ]
    with pytest.raises(CheckFailed, match="repeated key"):
        builders.write_checked(good.union(good), folder, CONTRACT)
    assert tables.read_layer(spark, folder, "clean", "t").count() == 5


def test_checks_while_writing_cost_no_job(spark, folder):
    df = spark.createDataFrame([(1, "a", 3.0), (2, None, -1.0), (3, "b", None), (4, "c", 99.0)], "id int, s string, v double")
    checks = observed.WriteChecks(["s", "v"], {"v": (0, 10), "id": (None, 9)}, expected=5, tolerance=0.2)

    def jobs(name, work):
        spark.sparkContext.setJobGroup(name, name)
        out = work()
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))

    _, plain = jobs("plain", lambda: tables.write_layer(df, folder, "clean", "plain"))
    (written, report), watched = jobs("watched", lambda: observed.write_observed(df, folder, "clean", "t", checks, gate=False))
    assert watched == plain == 1
    assert written.count() == 4
    assert [tuple(r)[1:5] for r in report.collect()] == [
        ("rows", "", 4, 1), ("nulls", "s", 1, 0), ("nulls", "v", 1, 0), ("below", "v", 1, 0), ("above", "v", 1, 0), ("above", "id", 0, 1),
    ]


def test_failed_check_leaves_the_old_table(spark, folder):
    good = observed.WriteChecks(not_null=["id"], expected=3)
    observed.write_observed(spark.range(3), folder, "clean", "t", good)
    with pytest.raises(CheckFailed, match="rows : 9"):
        observed.write_observed(spark.range(9), folder, "clean", "t", good)
    assert tables.read_layer(spark, folder, "clean", "t").count() == 3
    empty = observed.WriteChecks(not_null=["id"])
    observed.write_observed(spark.range(0), folder, "clean", "t", empty)
    assert tables.read_layer(spark, folder, "clean", "t").count() == 0


def put(folder, name, text):
    path = os.path.join(folder, name)
    with open(path, "w", newline="", encoding="utf-8") as f:
        f.write(text)
    return path


def test_rejected_rows_are_named(spark, folder):
    os.mkdir(f"{folder}/in")
    put(folder, "in/a.csv", 'id,name\r\n1,"x, ""y"""\r\n2\r\n\r\n3,a,b\r\n4,"open\r\n')
    put(folder, "in/b.csv", "id,name\r\n5,é\r\n6,\r\n")
    good, bad = rejects.load_with_rejects(spark, f"{folder}/in", f"{folder}/out", "t")
    assert good.columns == ["id", "name"]
    assert rows(good) == [("1", 'x, "y"'), ("5", "é"), ("6", None)]
    assert rows(bad.select("row_text", "reject_reason")) == [
        ("2", "wrong number of fields"), ("3,a,b", "wrong number of fields"), ('4,"open', "unbalanced quote"),
    ]
    assert [(r["reject_reason"], r["n"]) for r in rejects.reject_report(bad).orderBy("reject_reason").collect()] == [
        ("unbalanced quote", 1), ("wrong number of fields", 2),
    ]
    assert all(r["source_file"].endswith("a.csv") for r in bad.collect())


def test_rejects_with_given_names_and_line_feeds_only(spark, folder):
    path = put(folder, "a.csv", "A,B\r\n1,2\r\n3\r\n")
    good, bad = rejects.load_with_rejects(spark, path, f"{folder}/out", "t", ["a", "b"], line_sep="\n")
    assert rows(good) == [("1", "2\r")] and [r["row_text"] for r in bad.collect()] == ["3\r"]
    with pytest.raises(ValueError, match="reserved"):
        rejects.parse_raw_csv(spark, path, ["a", "row_text"])
    only_header = put(folder, "h.csv", "A,B\n")
    good, bad = rejects.load_with_rejects(spark, only_header, f"{folder}/out", "h")
    assert good.columns == ["A", "B"] and good.count() == bad.count() == 0


def test_layers_are_stored_compressed_well(spark, folder):
    tables.write_layer(spark.range(1000).selectExpr("cast(id AS string) AS a"), folder, "raw", "t")
    files = [f for _, _, names in os.walk(folder) for f in names if f.endswith(".parquet")]
    assert files and all(f.endswith(".zstd.parquet") for f in files)
    assert tables.read_layer(spark, folder, "raw", "t").count() == 1000
