"""Catalogue operators: images and ratings per product, and the views built from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.jsonio import decode_related
from ..functions.values import by_priority, mean_rating
from .lookups import catalog_filter, rows_for_keys
from .ranking import ranked



def primary_image(images: DataFrame) -> DataFrame:
    """product_id, primary_image: the link of the first image by priority (nulls last), then id."""
    order = F.struct(F.col("priority").isNull(), "priority", "id")
    return images.groupBy("product_id").agg(F.min_by("link", order).alias("primary_image"))


def strict_primary_image(images: DataFrame) -> DataFrame:
    """Only images of priority 1 count; the lowest id wins."""
    return images.where("priority = 1").groupBy("product_id").agg(F.min_by("link", "id").alias("primary_image"))


def product_rating(ratings: DataFrame, digits: int = 1) -> DataFrame:
    return ratings.groupBy("product_id").agg(
        mean_rating(F.col("value"), digits).alias("avg_rating"), F.count("*").alias("rating_count")
    )


def rating_summary(ratings: DataFrame) -> DataFrame:
    """Average and number of different users per product."""
    return ratings.groupBy("product_id").agg(
        mean_rating(F.col("value"), 1).alias("avg_rating"), F.countDistinct("user_id").alias("rating_count")
    )


def max_priority(images: DataFrame) -> DataFrame:
    return images.groupBy("product_id").agg(F.max("priority").alias("max_priority"))


def _of(facts: DataFrame, ids: DataFrame | None) -> DataFrame:
    """When only some products are asked for, drop the other products' rows before they are aggregated."""
    if ids is None:
        return facts
    return rows_for_keys(facts, ids.select(F.col("id").alias("product_id")), "product_id")


def with_primary_image(
    products: DataFrame, images: DataFrame, strict: bool = False, ids: DataFrame | None = None
) -> DataFrame:
    """`ids` names the products where they are few; the same below."""
    first = (strict_primary_image if strict else primary_image)(_of(images, ids))
    return products.join(first.withColumnRenamed("product_id", "id"), "id", "left")


def with_rating(products: DataFrame, ratings: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Average of one digit (null without ratings) and count (0 without)."""
    found = product_rating(_of(ratings, ids)).withColumnRenamed("product_id", "id")
    joined = products.join(found, "id", "left")
    return joined.withColumn("rating_count", F.coalesce("rating_count", F.lit(0).cast("bigint")))


def product_cards(
    products: DataFrame, images: DataFrame, ratings: DataFrame, ids: DataFrame | None = None
) -> DataFrame:
    """The product fields banners show: two-digit average and count, both 0 without ratings."""
    if ids is not None:
        products = rows_for_keys(products, ids)
    found = product_rating(_of(ratings, ids), 2).withColumnRenamed("product_id", "id")
    joined = with_primary_image(products, images, ids=ids).join(found, "id", "left")
    return joined.select(
        "id", "name", "description", "price", "endprice", "primary_image",
        F.coalesce("avg_rating", F.lit(0.0)).alias("avg_rating"),
        F.coalesce("rating_count", F.lit(0).cast("bigint")).alias("rating_count"),
    )


def images_in_order(images: DataFrame, window_rows: int | None = None) -> DataFrame:
    """product_id, pos, id, link, priority: the images of every product in display order, one per row."""
    placed = ranked(images, ["product_id"], by_priority(), "pos", window_rows)
    return placed.select("product_id", "pos", "id", "link", "priority")


def links_in_order(products: DataFrame, images: DataFrame) -> DataFrame:
    """product_id, pos, link; a product without images keeps one row without a link."""
    placed = images_in_order(images).select(F.col("product_id").alias("id"), "pos", "link")
    return products.select("id").join(placed, "id", "left").withColumnRenamed("id", "product_id")


def images_counted(products: DataFrame, images: DataFrame) -> DataFrame:
    """All images of every product in order, one per row, with their number; a product without images keeps one row."""
    placed = images_in_order(images)
    counted = images.groupBy("product_id").agg(F.count("*").alias("_n")).withColumnRenamed("product_id", "id")
    return products.join(counted, "id", "left").join(placed.select(*image_columns()), "id", "left").select(
        *products.columns, F.coalesce("_n", F.lit(0)).cast("bigint").alias("n_images"),
        "image_pos", "image_id", "image_link", "image_priority",
    )


def nest(rows: DataFrame, keys: Sequence[str], pos: str, fields: Sequence[str], name: str) -> DataFrame:
    """Ordered array of the fields, one row per group whatever its size: for groups that are known to be small."""
    gathered = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(pos, *fields))).alias("_rows"))
    shape = F.transform("_rows", lambda r: F.struct(*[r[f].alias(f) for f in fields]))
    return gathered.select(*keys, shape.alias(name))


def images_nested(products: DataFrame, images: DataFrame) -> DataFrame:
    """Products with their images array, null without images; `images_counted` has the same without arrays."""
    arrays = nest(images_in_order(images), ["product_id"], "pos", ["id", "link", "priority"], "images")
    return products.join(arrays.withColumnRenamed("product_id", "id"), "id", "left")


def links_nested(products: DataFrame, images: DataFrame) -> DataFrame:
    """Products with their list of links, empty without images."""
    arrays = nest(images_in_order(images), ["product_id"], "pos", ["link"], "_links")
    links = F.coalesce(F.col("_links.link"), F.array().cast("array<string>")).alias("links")
    return products.join(arrays.withColumnRenamed("product_id", "id"), "id", "left").select(
        *products.columns, links
    )


def image_columns() -> list[Column]:
    return [
        F.col("product_id").alias("id"), F.col("pos").alias("image_pos"), F.col("id").alias("image_id"),
        F.col("link").alias("image_link"), F.col("priority").alias("image_priority"),
    ]


def user_rating(pairs: DataFrame, ratings: DataFrame) -> DataFrame:
    """The rating of each asked (user, product) pair, or null; of repeated ratings the lowest id counts."""
    asked = pairs.select("user_id", "product_id").distinct()
    first = ratings.groupBy("user_id", "product_id").agg(
        F.min("id").alias("rating_id"), F.min_by("value", "id").alias("value")
    )
    return asked.join(first, ["user_id", "product_id"], "left")


# Whole views


def catalog_with_primary_image(
    products: DataFrame, images: DataFrame, ratings: DataFrame, category_id: int | None = None
) -> DataFrame:
    shown = catalog_filter(products, category_id, active_only=False)
    ids = shown if category_id else None
    return with_rating(with_primary_image(shown, images, ids=ids), ratings, ids).orderBy(F.col("id").desc_nulls_first())


def catalog_full(
    products: DataFrame, images: DataFrame, ratings: DataFrame, category_id: int | None = None,
    search: str | None = None, ids: DataFrame | None = None,
) -> DataFrame:
    """Active products with rating and their images in order, one row per image (or one without)."""
    shown = catalog_filter(products, category_id, search)
    if ids is not None:
        shown = rows_for_keys(shown, ids)
    few = shown if category_id or search or ids is not None else None
    placed = images_in_order(_of(images, few))
    rated = with_rating(shown, ratings, few)
    return rated.join(placed.select(*image_columns()), "id", "left").orderBy(
        F.col("id").desc_nulls_first(), F.col("image_pos").asc_nulls_last()
    )


def catalog_admin(products: DataFrame, images: DataFrame) -> DataFrame:
    return with_primary_image(products, images, strict=True).orderBy(F.col("id").asc_nulls_last())


def related_products(
    sources: DataFrame, products: DataFrame, images: DataFrame, ratings: DataFrame
) -> DataFrame:
    """For every source product the enriched products its `related` list names, each once, unknown ids dropped."""
    wanted = decode_related(sources).select(F.col("product_id").alias("source_id"), F.col("related_id").alias("id"))
    wanted = wanted.where(F.col("id").isNotNull()).distinct()
    cards = with_rating(with_primary_image(products, images), ratings)
    return wanted.join(cards, "id")
