"""Batches of changes applied to whole tables: each returns new states; nothing is written in place."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import materialise
from .catalog import rating_summary
from .lookups import latest, missing_keys, rejected, accepted, rows_for_keys, validate_status
from .orders import with_user
from .ranking import fresh_ids


class Changed(NamedTuple):
    table: DataFrame  # the new state
    rows: DataFrame  # the rows inserted, changed or deleted
    refused: DataFrame | None  # changes that did not apply


def apply_insert(table: DataFrame, batch: DataFrame, order: Sequence[Column], id_col: str = "id") -> DataFrame:
    """Table plus the batch with new ids in the given order; columns the batch lacks are null."""
    added = fresh_ids(batch, table, order, id_col)
    kinds = dict(table.dtypes)
    shaped = added.select(
        *[(F.col(c) if c in added.columns else F.lit(None)).cast(kinds[c]).alias(c) for c in table.columns]
    )
    return table.unionByName(shaped)


def apply_update(
    table: DataFrame, batch: DataFrame, cols: Sequence[str], key: str = "id", order: Sequence[str] | None = None
) -> Changed:
    """Replace `cols` by key; a listed column the batch lacks becomes null.

    `order` picks the last of repeated keys; without it the greatest row by its columns counts, so no row of the table
    is ever doubled.
    """
    rest = [c for c in batch.columns if c != key]
    last = latest(batch, [key], order or rest) if rest else batch.distinct()
    kinds = dict(table.dtypes)
    new = last.select(
        key, F.lit(True).alias("_hit"),
        *[(F.col(c) if c in last.columns else F.lit(None)).cast(kinds[c]).alias(f"_new_{c}") for c in cols],
    )
    joined = table.join(new, key, "left")
    kept = [F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in cols else F.col(c)
            for c in table.columns]
    state = joined.select(*kept)
    return Changed(state, joined.where("_hit").select(*kept), missing_keys(table, batch, key))


def apply_delete(table: DataFrame, keys: DataFrame, key: str = "id") -> Changed:
    kept = table.join(keys.select(key).distinct(), key, "left_anti")
    return Changed(kept, rows_for_keys(table, keys, key), missing_keys(table, keys, key))


def delete_orders(orders: DataFrame, keys: DataFrame, users: DataFrame) -> Changed:
    """Deleted orders come back with their customer; stock is not given back."""
    done = apply_delete(orders, keys)
    return done._replace(rows=with_user(done.rows, users))


def delete_products(
    products: DataFrame, images: DataFrame, ratings: DataFrame, keys: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Products, images and ratings without the given products."""
    gone = keys.select("id").distinct()
    owned = gone.withColumnRenamed("id", "product_id")
    return (
        products.join(gone, "id", "left_anti"),
        images.join(owned, "product_id", "left_anti"),
        ratings.join(owned, "product_id", "left_anti"),
    )


def digest_submissions(submissions: DataFrame) -> DataFrame:
    """Per (user, product) the last value with its (ts, seq), and the first (ts, seq)."""
    order = F.struct("ts", "seq")
    return submissions.groupBy("user_id", "product_id").agg(
        F.max_by("value", order).alias("value"), F.max(order).alias("last"), F.min(order).alias("first")
    )


def combine_digests(digests: DataFrame) -> DataFrame:
    """Digests of several batches as one, whatever order the batches came in."""
    return digests.groupBy("user_id", "product_id").agg(
        F.max_by("value", "last").alias("value"), F.max("last").alias("last"), F.min("first").alias("first")
    )


def merge_ratings(ratings: DataFrame, digest: DataFrame) -> Changed:
    """Ratings after digested submissions: held pairs take the last value, new pairs get ids by first arrival.

    `rows` has each touched (user, product) with its outcome and the product's new average and number of users.
    """
    keys = ["user_id", "product_id"]
    touched = digest.select(*keys, F.col("value").alias("_value"), F.col("first").alias("_first"))
    held = ratings.select(*keys).distinct().withColumn("_held", F.lit(True))
    # Written, as new ids, the new state and the answers all start from it.
    flagged = materialise(touched.join(held, keys, "left"), "touched")
    added = fresh_ids(flagged.where("_held IS NULL"), ratings, [F.col("_first").asc()])
    updated = ratings.join(flagged, keys, "left").withColumn("value", F.coalesce("_value", "value"))
    state = updated.select(*ratings.columns).unionByName(
        added.select("id", *keys, F.col("_value").alias("value")).select(*ratings.columns)
    )
    summary = rating_summary(rows_for_keys(state, flagged, "product_id"))
    outcome = F.when(F.col("_held"), "updated").otherwise("added").alias("outcome")
    rows = flagged.select(*keys, F.col("_value").alias("value"), outcome).join(summary, "product_id")
    return Changed(state, rows, None)


def upsert_ratings(ratings: DataFrame, submissions: DataFrame) -> Changed:
    """Ratings after the submissions (seq, ts, user_id, product_id, value) in (ts, seq) order."""
    return merge_ratings(ratings, digest_submissions(submissions))


def unknown_orders(changes: DataFrame, orders: DataFrame) -> DataFrame:
    """Changes whose `order_id` has no order, as refused."""
    unknown = changes.join(orders.select(F.col("id").alias("order_id")), "order_id", "left_anti")
    return unknown.withColumn("reject_reason", F.lit("order_unknown"))


def update_status(orders: DataFrame, changes: DataFrame, users: DataFrame) -> Changed:
    """Orders after the status changes (seq, ts, order_id, status); `rows` are the changed orders with customer."""
    checked = validate_status(changes)
    last = latest(accepted(checked).select("order_id", "ts", "seq", "status"), ["order_id"], ["ts", "seq"])
    change = last.select(F.col("order_id").alias("id"), "status")
    done = apply_update(orders, change, ["status"])
    refused = rejected(checked).unionByName(unknown_orders(accepted(checked), orders))
    return Changed(done.table, with_user(done.rows, users), refused)
