from vitrine.sources import tables
from vitrine.storage import fresh_path, materialise, shared_folder

from .conftest import rows


def test_stored_tables_never_give_passwords(spark, tmp_path):
    stored = spark.createDataFrame([(1, "n", "hash")], "id bigint, name string, password string")
    stored.write.parquet(f"{tmp_path}/users.parquet")
    users = tables.load(spark, str(tmp_path), "users")
    assert "password" not in users.columns
    assert rows(users, "id", "name", "email") == [(1, "n", None)]


def test_rows_keep_their_nulls_on_the_way_out(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, "b")], "id bigint, name string")
    tables.save_rows(df, f"{tmp_path}/out")
    assert rows(spark.read.text(f"{tmp_path}/out")) == [('{"id":1,"name":null}',), ('{"id":2,"name":"b"}',)]
    tables.save_rows(df, f"{tmp_path}/columns", "parquet")
    assert rows(spark.read.parquet(f"{tmp_path}/columns")) == rows(df)


def test_filters_and_columns_reach_the_files(spark, tmp_path):
    spark.createDataFrame([(1, 2, "l", 1)], tables.SCHEMAS["images"]).write.parquet(f"{tmp_path}/images.parquet")
    plan = tables.load(spark, str(tmp_path), "images").where("priority = 1").select("link")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(priority,1)" in text and "ReadSchema: struct<link:string,priority:bigint>" in text


def test_written_tables_go_to_the_shared_folder(spark):
    assert fresh_path(spark, "x").startswith(shared_folder(spark))
    df = spark.range(5).toDF("n")
    again = materialise(df, "numbers")
    assert rows(again) == rows(df)
    assert shared_folder(spark) in again.inputFiles()[0]
