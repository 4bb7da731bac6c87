"""Change streams. Each micro-batch leaves its own digest, and the current state is the merge of all digests.

A replayed micro-batch overwrites its own folder with the same rows, and digests keep the (ts, seq) they stand for,
so neither replay nor late files change the result. No micro-batch rewrites the table it will be merged into.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.changes import (
    Changed, apply_update, combine_digests, digest_submissions, merge_ratings, unknown_orders,
)
from ..operators.lookups import accepted, latest, rejected, validate_status
from ..operators.orders import with_user


def _run(stream: DataFrame, work, folder: str) -> None:
    """Take in everything that is there, from the last checkpoint on."""
    query = (
        stream.writeStream.foreachBatch(work)
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def _read(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """The batches taken in so far; a stream that had no files yet has left no folder."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], like.schema)
    return spark.read.schema(like.schema).option("recursiveFileLookup", "true").parquet(path)


def take_in_ratings(submissions: DataFrame, folder: str) -> None:
    """Digest a stream of submissions (seq, ts, user_id, product_id, value) into `folder`."""

    def work(batch: DataFrame, batch_id: int) -> None:
        digest_submissions(batch).write.mode("overwrite").parquet(f"{folder}/digest/batch={batch_id}")

    _run(submissions, work, folder)


def ratings_now(ratings: DataFrame, submissions: DataFrame, folder: str) -> Changed:
    """Ratings after all digested submissions; `submissions` gives the schema only."""
    digests = _read(ratings.sparkSession, f"{folder}/digest", digest_submissions(_no_rows(submissions)))
    return merge_ratings(ratings, combine_digests(digests))


def take_in_status(changes: DataFrame, folder: str) -> None:
    """Split a stream of status changes (seq, ts, order_id, status) into valid ones, the last of them per order, and
    invalid ones. All valid ones are kept, since whether their order exists shows only when the orders are read."""

    def work(batch: DataFrame, batch_id: int) -> None:
        checked = validate_status(batch)
        accepted(checked).write.mode("overwrite").parquet(f"{folder}/asked/batch={batch_id}")
        last = latest(accepted(checked), ["order_id"], ["ts", "seq"])
        last.write.mode("overwrite").parquet(f"{folder}/valid/batch={batch_id}")
        rejected(checked).write.mode("overwrite").parquet(f"{folder}/refused/batch={batch_id}")

    _run(changes, work, folder)


def status_now(orders: DataFrame, users: DataFrame, changes: DataFrame, folder: str) -> Changed:
    """Orders after all changes taken in; invalid changes and those of unknown orders are refused, with their reason."""
    spark, shape = orders.sparkSession, validate_status(_no_rows(changes))
    valid = latest(accepted(shape), ["order_id"], ["ts", "seq"])
    last = latest(_read(spark, f"{folder}/valid", valid), ["order_id"], ["ts", "seq"])
    done = apply_update(orders, last.select(F.col("order_id").alias("id"), "status"), ["status"])
    unknown = unknown_orders(_read(spark, f"{folder}/asked", accepted(shape)), orders)
    refused = _read(spark, f"{folder}/refused", rejected(shape)).unionByName(unknown)
    return Changed(done.table, with_user(done.rows, users), refused)


def _no_rows(stream: DataFrame) -> DataFrame:
    return stream.sparkSession.createDataFrame([], stream.schema)
