"""Streams end where the batch ends, whatever the files and their order, and a rerun changes nothing."""

from pyspark.sql import functions as F

from vitrine.operators import changes
from vitrine.plans.queries import Shop, _first_and_later
from vitrine.streaming import changes as streams

from .conftest import SMALL, rows


def _files(spark, df, folder, parts):
    df.withColumn("_p", F.rand(7)).repartitionByRange(parts, "_p").drop("_p").write.parquet(folder)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_ratings(spark, tmp_path):
    shop = Shop(spark, SMALL)
    held, _ = _first_and_later(shop)
    want = rows(changes.upsert_ratings(held, shop.rating_submission).table, "user_id", "product_id", "id", "value")
    for parts in (1, 4):
        home = f"{tmp_path}/home{parts}"
        stream = _files(spark, shop.rating_submission, f"{tmp_path}/in{parts}", parts)
        streams.take_in_ratings(stream, home)
        got = streams.ratings_now(held, stream, home).table
        assert rows(got, "user_id", "product_id", "id", "value") == want
        streams.take_in_ratings(stream, home)
        assert rows(streams.ratings_now(held, stream, home).table, "user_id", "product_id", "id", "value") == want


def test_status(spark, tmp_path):
    shop = Shop(spark, SMALL)
    batch = changes.update_status(shop.shop_orders, shop.status_request, shop.users)
    stream = _files(spark, shop.status_request, f"{tmp_path}/in", 3)
    streams.take_in_status(stream, f"{tmp_path}/home")
    done = streams.status_now(shop.shop_orders, shop.users, stream, f"{tmp_path}/home")
    assert rows(done.table, "id", "status") == rows(batch.table, "id", "status")
    assert {r.reject_reason for r in done.refused.collect()} == {"status_unknown", "order_unknown"}
    assert rows(done.refused, "seq") == rows(batch.refused, "seq")


def test_replayed_micro_batch_overwrites_itself(spark, tmp_path):
    shop = Shop(spark, SMALL)
    sent = shop.rating_submission
    for _ in range(2):
        changes.digest_submissions(sent).write.mode("overwrite").parquet(f"{tmp_path}/digest/batch=0")
    got = streams.ratings_now(shop.rating.limit(0), sent, str(tmp_path)).table
    assert rows(got, "user_id", "product_id", "value") == rows(shop.rating, "user_id", "product_id", "value")
