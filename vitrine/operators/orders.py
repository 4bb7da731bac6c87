"""Order operators: defaults, lines, customers and product details of lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import effective_price, or_else
from .catalog import with_primary_image
from .lookups import rows_for_keys


def normalise_orders(orders: DataFrame, now: Column) -> DataFrame:
    """Defaults of a placed order: an empty status, cost or voucher gives way, `active` only when null."""
    defaults = {
        "status": or_else(F.col("status"), "", F.lit("Created")),
        "created_at": F.coalesce("created_at", now),
        "active": F.coalesce("active", F.lit(True)),
        "delivery_cost": or_else(F.col("delivery_cost"), 0, F.lit(0)).cast("decimal(12,2)"),
        "voucher_id": F.nullif(F.col("voucher_id"), F.lit(0)),
    }
    return orders.withColumns({name: rule for name, rule in defaults.items() if name in orders.columns})


def line_product() -> Column:
    """Product of a decoded line: product_id, else id; 0 counts as missing."""
    return or_else(F.col("product_id"), 0, F.nullif(F.col("id"), F.lit(0)))


def line_quantity(amend: bool = False) -> Column:
    """A placed line reads quantity before qty and counts 1 without either; an amended one qty first, and counts 0."""
    first, second, default = ("qty", "quantity", 0) if amend else ("quantity", "qty", 1)
    return or_else(F.col(first), 0, or_else(F.col(second), 0, F.lit(default))).cast("bigint")


def normalise_items(lines: DataFrame, amend: bool = False) -> DataFrame:
    """order_id, pos, product_id, qty, selected_option of decoded lines."""
    return lines.select(
        "order_id", "pos", line_product().alias("product_id"), line_quantity(amend).alias("qty"), "selected_option"
    )


def user_columns(users: DataFrame, avatar: bool = False) -> DataFrame:
    return users.select(
        F.col("id").alias("user_id"), F.col("name").alias("user_name"), F.col("email").alias("user_email"),
        F.col("user_name").alias("username"), F.col("phone").alias("user_phone"), *(["avatar"] if avatar else []),
    )


def with_user(orders: DataFrame, users: DataFrame, avatar: bool = False) -> DataFrame:
    """Orders with their customer; orders of unknown or no customer stay, with nulls."""
    return orders.join(user_columns(users, avatar), "user_id", "left")


def orders_of_users(orders: DataFrame, users: DataFrame, keys: DataFrame) -> DataFrame:
    """Orders of the given users, newest first; undated orders count as newest."""
    own = rows_for_keys(orders, keys, "user_id")
    return with_user(own, users, avatar=True).orderBy(
        F.col("user_id"), F.col("created_at").desc_nulls_first(), F.col("id")
    )


def item_products(lines: DataFrame) -> DataFrame:
    """Different products of every order; lines without a product id are left out."""
    named = lines.select("order_id", line_product().alias("product_id"))
    return named.where(F.col("product_id").isNotNull()).distinct()


def last_quantities(lines: DataFrame) -> DataFrame:
    """Quantity of the last line of every product of every order, from amended-order lines."""
    amended = normalise_items(lines, amend=True).where(F.col("product_id").isNotNull())
    return amended.groupBy("order_id", "product_id").agg(F.max_by("qty", "pos").alias("qty"))


def merge_products(lines: DataFrame, products: DataFrame) -> DataFrame:
    """Every line with the product's name, price and stock where known, else its own."""
    known = products.select(
        F.col("id").alias("pid"), F.col("name").alias("_name"), F.col("price").alias("_price"),
        F.col("stock").alias("_stock"),
    )
    return lines.withColumn("pid", line_product()).join(known, "pid", "left").select(
        "order_id", "pos", F.col("pid").alias("id"), F.coalesce("_name", "name").alias("name"),
        F.coalesce("_price", "price").alias("price"), F.coalesce("_stock", "stock").alias("stock"), "primary_image",
        "quantity", "qty", "selected_option",
    )


def dedupe_items(lines: DataFrame) -> DataFrame:
    """The first of an order's decoded lines per product and option."""
    option = F.coalesce("selected_option", F.lit("")).alias("_option")
    rest = [c for c in lines.columns if c != "order_id"]
    first = F.min_by(F.struct(*rest), "pos").alias("_first")
    kept = lines.groupBy("order_id", line_product().alias("_product"), option).agg(first)
    return kept.select("order_id", "_first.*")


def item_detail(lines: DataFrame, products: DataFrame, images: DataFrame) -> DataFrame:
    """Placed lines with name, effective price, first image and stock; an unknown product leaves only id and qty."""
    cards = with_primary_image(products.select("id", "name", "price", "endprice", "stock"), images)
    cards = cards.select(
        F.col("id").alias("product_id"), F.lit(True).alias("known"), "name",
        effective_price(F.col("endprice"), F.col("price")).alias("price"), F.col("primary_image").alias("image"),
        F.col("stock").alias("remaining_stock"),
    )
    detailed = lines.select("order_id", "pos", "product_id", "qty").join(cards, "product_id", "left")
    return detailed.withColumn("known", F.coalesce("known", F.lit(False)))


def order_products(lines: DataFrame, orders: DataFrame, users: DataFrame, products: DataFrame) -> DataFrame:
    """Per order the customer's name and each known product of its lines once; an order without any has one row of nulls."""
    heads = orders.select(F.col("id").alias("order_id"), "user_id").join(
        users.select(F.col("id").alias("user_id"), F.col("name").alias("user_name")), "user_id", "left"
    )
    found = item_products(lines).join(products.withColumnRenamed("id", "product_id"), "product_id")
    return heads.join(found, "order_id", "left")
