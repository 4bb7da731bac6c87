"""The registered queries: each builds its inputs from a folder of driver tables and runs one operator."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import jsonio, values
from ..operators import admission, banners, catalog, changes, images, lookups, orders, ranking
from ..sources import fixtures, tables
from ..storage import fresh_path
from ..streaming import changes as streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


class Shop:
    """The tables of one folder, built when asked for."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def view(self, name: str) -> DataFrame:
        return fixtures.view(self.spark, self.folder, name)

    __getattr__ = view

    def driver(self, name: str) -> DataFrame:
        return tables.load_driver_table(self.spark, self.folder, name)

    def stream(self, name: str) -> DataFrame:
        return tables.stream_driver_table(self.spark, self.folder, name)

    @property
    def lines(self) -> DataFrame:
        return jsonio.decode_lines(self.order_items.select("order_id", "pos", "item_json"))


def as_of() -> Column:
    return F.lit(fixtures.AS_OF).cast("timestamp_ntz")


def plain(df: DataFrame) -> DataFrame:
    """Amounts as double and times as text, so that results compare alike everywhere."""
    kinds = dict(df.dtypes)

    def shown(name: str) -> Column:
        if kinds[name].startswith("decimal"):
            return F.col(name).cast("double").alias(name)
        if kinds[name].startswith("timestamp"):
            return F.date_format(name, "yyyy-MM-dd HH:mm:ss").alias(name)
        return F.col(name)

    return df.select(*[shown(c) for c in df.columns])


def query(build: Callable[[Shop], DataFrame]) -> Callable[[Shop], DataFrame]:
    QUERIES[build.__name__] = lambda spark, folder: plain(build(Shop(spark, folder)))
    return build


# Scans, sources, sinks


SCANNED = ("product", "category", "images", "rating", "voucher", "users")


@query
def table_scan(shop):
    """All rows of the six tables that are listed as a whole, told apart by `part`; passwords are not among the columns."""
    scans = [lookups.public_users(shop.view(name)).select(F.lit(name).alias("part"), "*") for name in SCANNED]
    wide = [s.withColumns({c: F.col(c).cast("bigint") for c, kind in s.dtypes if kind == "int"}) for s in scans]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), wide)


@query
def users_public(shop):
    return lookups.public_users(shop.users)


@query
def items_decode(shop):
    lines = jsonio.decode_items(shop.order_docs)
    return lines.select("order_id", "pos", "product_id", "id", "quantity", "qty", "selected_option", "raw")


@query
def map_decode(shop):
    return jsonio.decode_map(shop.banner).select("banner_id", "elem_pos", "kind", "elem")


@query
def related_decode(shop):
    return jsonio.decode_related(shop.product)


@query
def json_encode(shop):
    """The JSON columns as they are written: lines and header of an order, related ids of a product, a banner's map as text."""
    header = F.struct("id", "user_id", "status", "active", "voucher_code")
    head = shop.shop_orders.select(F.lit("order").alias("part"), "id", header.alias("body"))

    def line(x: Column) -> Column:
        return F.struct(x["product_id"], x["quantity"], x["selected_option"].alias("selectedOption"))

    ordered = F.array_sort(F.collect_list(F.struct("pos", "product_id", "quantity", "selected_option")))  # one document
    decoded = jsonio.decode_items(shop.order_docs)
    items = decoded.groupBy(F.col("order_id").alias("id")).agg(F.transform(ordered, line).alias("body"))
    related = shop.product.select(F.lit("related").alias("part"), "id", F.from_json("related", "array<bigint>").alias("body"))
    maps = shop.banner.select(F.lit("map").alias("part"), "id", F.col("map").alias("body"))
    parts = [head, items.select(F.lit("items").alias("part"), "id", "body"), related, maps]
    return reduce(DataFrame.unionByName, [jsonio.encode_columns(p, ["body"]) for p in parts])


@query
def sink_rows(shop):
    rows = lookups.public_users(shop.users)
    path = fresh_path(shop.spark, "rows")
    tables.save_rows(rows, path)
    return shop.spark.read.schema(rows.schema).json(path)


# Filters and predicates


def _asked_ids(shop: Shop) -> DataFrame:
    return shop.driver("lineitem").select((F.col("l_orderkey") + 1).alias("id"))


@query
def lookup_by_key(shop):
    return lookups.rows_for_keys(shop.product, _asked_ids(shop))


@query
def lookup_missing(shop):
    return lookups.missing_keys(shop.product, _asked_ids(shop))


@query
def admin_active(shop):
    return lookups.active_accounts(lookups.public_users(shop.users), "active")


@query
def catalog_filter(shop):
    return lookups.catalog_filter(shop.product, search="r%g")


@query
def user_rating(shop):
    heads = shop.driver("orders").select("o_orderkey", (F.col("o_custkey") + 1).alias("user_id"))
    lines = shop.driver("lineitem").select("l_orderkey", (F.col("l_partkey") + 1).alias("product_id"))
    bought = lines.join(heads, F.col("l_orderkey") == F.col("o_orderkey"))
    return catalog.user_rating(bought, shop.rating)


@query
def product_images(shop):
    return catalog.images_in_order(shop.images)


@query
def product_links(shop):
    return catalog.links_in_order(shop.product, shop.images)


@query
def voucher_by_code(shop):
    codes = shop.shop_orders.select(F.col("voucher_code").alias("code"))
    return lookups.voucher_by_code(shop.voucher, codes, as_of())


@query
def voucher_valid_for_orders(shop):
    found = lookups.voucher_state_of_orders(shop.shop_orders, shop.voucher, as_of())
    return found.select("id", "voucher_code", "voucher_id", "voucher_state")


@query
def order_normalise(shop):
    return orders.normalise_orders(shop.order_request, as_of())


@query
def item_normalise(shop):
    return shop.lines.select(
        "order_id", "pos", orders.line_product().alias("product_id"), orders.line_quantity().alias("placed_qty"),
        orders.line_quantity(amend=True).alias("amended_qty"),
    )


@query
def effective_price(shop):
    return shop.product.select("id", values.effective_price(F.col("endprice"), F.col("price")).alias("effective_price"))


@query
def validate_status(shop):
    return lookups.validate_status(shop.status_request).select("seq", "order_id", "status", "reject_reason")


@query
def validate_voucher(shop):
    placed = lookups.validate_voucher(shop.voucher_request).withColumnRenamed("reject_reason", "create_reason")
    return lookups.validate_voucher(placed, update=True).withColumnRenamed("reject_reason", "update_reason")


@query
def validate_items(shop):
    return lookups.validate_items(shop.shop_orders, shop.lines).select("id", "reject_reason")


@query
def validate_image(shop):
    return lookups.validate_image(shop.image_request)


@query
def validate_unique(shop):
    return lookups.validate_unique(shop.account_request, shop.account, ["username", "email"])


@query
def order_user_columns(shop):
    return orders.user_columns(lookups.public_users(shop.users))


# Joins


@query
def orders_with_user(shop):
    return orders.with_user(shop.shop_orders, shop.users)


@query
def orders_of_user(shop):
    keys = shop.users.where("active").select(F.col("id").alias("user_id"))
    return orders.orders_of_users(shop.shop_orders, shop.users, keys)


@query
def primary_image(shop):
    return catalog.with_primary_image(shop.product.select("id"), shop.images)


@query
def strict_primary_image(shop):
    return catalog.with_primary_image(shop.product.select("id"), shop.images, strict=True)


@query
def product_rating(shop):
    return catalog.with_rating(shop.product.select("id"), shop.rating)


@query
def product_rating_banner(shop):
    cards = catalog.product_cards(shop.product, shop.images, shop.rating)
    return cards.select("id", "avg_rating", "rating_count")


@query
def any_array_semi(shop):
    named = jsonio.decode_related(shop.product).select(F.col("related_id").alias("id"))
    return lookups.rows_for_keys(shop.product.select("id", "name"), named)


@query
def unnest_join(shop):
    found = jsonio.decode_related(shop.product).join(
        shop.product.select(F.col("id").alias("related_id"), "name"), "related_id"
    )
    return found.select("product_id", "pos", "related_id", "name")


@query
def unnest_left_category(shop):
    elements = banners.banner_elements(shop.banner, banners.ADMIN)
    named = banners.referenced_ids(elements).where("form = 'categories'")
    known = shop.category.select(F.col("id").cast("bigint").alias("category_id"), "name", "image")
    return named.join(known, F.col("ref_id") == F.col("category_id"), "left").select(
        "banner_id", "elem_pos", "sub_pos", "category_id", "name", "image"
    )


@query
def items_merge_product(shop):
    return orders.merge_products(shop.lines, shop.product)


@query
def order_item_detail(shop):
    return orders.item_detail(orders.normalise_items(shop.lines), shop.product, shop.images)


# Aggregations


@query
def table_count(shop):
    counts = [
        shop.view(name).agg(F.lit(name).alias("table_name"), F.count("*").alias("n"))
        for name in ("product", "shop_orders", "users")
    ]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query
def rating_summary(shop):
    return catalog.rating_summary(shop.rating_submission)


@query
def images_agg(shop):
    return catalog.images_counted(shop.product.select("id"), shop.images)


@query
def max_priority(shop):
    return catalog.max_priority(shop.images)


@query
def distinct_item_products(shop):
    return orders.item_products(shop.lines)


@query
def items_qty_last(shop):
    return orders.last_quantities(shop.lines)


@query
def banner_regroup(shop):
    return banners.nest_banners(_resolved(shop, banners.ADMIN), banners.ADMIN)


# First and last rows of groups


@query
def items_dedupe(shop):
    return orders.merge_products(orders.dedupe_items(shop.lines), shop.product)


@query
def image_next_priority(shop):
    return images.next_priorities(shop.images, shop.image_request)


@query
def rating_latest(shop):
    keys = ["user_id", "product_id"]
    return lookups.latest(shop.rating_submission, keys, ["ts", "seq"]).select(*keys, "seq", "value")


@query
def status_latest(shop):
    valid = lookups.accepted(lookups.validate_status(shop.status_request))
    return lookups.latest(valid, ["order_id"], ["ts", "seq"]).select("order_id", "seq", "status")


# Sorts and pages


@query
def paginate(shop):
    return ranking.paginate(shop.shop_orders, [F.col("id").desc_nulls_first()], page=3, limit=25)


@query
def page_index(shop):
    return ranking.page_index(shop.shop_orders.select("id"), [F.col("id").desc_nulls_first()])


@query
def sort_products_desc(shop):
    return shop.product.select("id", "name").orderBy(F.col("id").desc_nulls_first())


@query
def sort_banners(shop):
    return banners.sort_banners(shop.banner.select("id", "priority", "type"))


# Whole views


@query
def catalog_with_primary_image(shop):
    return catalog.catalog_with_primary_image(shop.product, shop.images, shop.rating)


@query
def catalog_full(shop):
    return catalog.catalog_full(shop.product, shop.images, shop.rating)


@query
def product_detail(shop):
    return catalog.catalog_full(shop.product, shop.images, shop.rating, ids=_asked_ids(shop))


@query
def catalog_admin(shop):
    return catalog.catalog_admin(shop.product, shop.images)


@query
def catalog_admin_page(shop):
    # The page is chosen first, so only its products look for their image.
    page = ranking.paginate(shop.product, [F.col("id").asc_nulls_last()], page=2, limit=20)
    return catalog.with_primary_image(page, shop.images, strict=True, ids=page).orderBy("id")


@query
def related_products(shop):
    return catalog.related_products(shop.product, shop.product, shop.images, shop.rating)


@query
def orders_page(shop):
    page = ranking.paginate(shop.shop_orders, [F.col("id").desc_nulls_first()])
    return orders.with_user(page, shop.users).orderBy(F.col("id").desc_nulls_first())


@query
def order_products(shop):
    return orders.order_products(shop.lines, shop.shop_orders, shop.users, shop.product)


@query
def order_details(shop):
    placed = orders.normalise_orders(shop.order_request, as_of()).withColumnRenamed("id", "order_id")
    detail = orders.item_detail(orders.normalise_items(shop.lines), shop.product, shop.images)
    return placed.select("order_id", "status", "delivery_cost").join(detail, "order_id")


def _resolved(shop: Shop, listing: banners.Listing, shown: DataFrame | None = None) -> DataFrame:
    shown = shop.banner if shown is None else shown
    return banners.resolve_banners(shown, shop.product, shop.images, shop.rating, shop.category, listing)


@query
def banners_admin(shop):
    return _resolved(shop, banners.ADMIN)


@query
def banners_admin_products(shop):
    return _resolved(shop, banners.ADMIN_PRODUCTS)


@query
def banners_client(shop):
    return _resolved(shop, banners.CLIENT)


@query
def banners_client_products(shop):
    return _resolved(shop, banners.CLIENT_PRODUCTS)


@query
def banner_client_by_id(shop):
    asked = shop.users.select("id")
    return _resolved(shop, banners.CLIENT_BY_ID, lookups.rows_for_keys(shop.banner, asked))


# Change batches


@query
def apply_insert(shop):
    return changes.apply_insert(
        shop.rating, shop.rating_submission.drop("id"), [F.col("ts").asc(), F.col("seq").asc()]
    )


@query
def apply_update(shop):
    done = changes.apply_update(shop.product, shop.product_update, ["price", "endprice", "stock"])
    state = done.table.select("id", "name", "price", "endprice", "stock", F.lit("kept").alias("outcome"))
    return state.unionByName(done.refused.withColumn("outcome", F.lit("unknown")), allowMissingColumns=True)


@query
def apply_delete(shop):
    keys = shop.driver("events").select((F.col("event_id") * 2).alias("id"))
    done = changes.delete_orders(shop.shop_orders, keys, shop.users)
    kept = done.table.select("id", F.lit("kept").alias("outcome"))
    gone = done.rows.select("id", F.lit("deleted").alias("outcome"), "user_name", "username")
    unknown = done.refused.withColumn("outcome", F.lit("unknown"))
    return kept.unionByName(gone, allowMissingColumns=True).unionByName(unknown, allowMissingColumns=True)


@query
def delete_product_cascade(shop):
    keys = shop.product.where("NOT active").select("id")
    products, pictures, ratings = changes.delete_products(shop.product, shop.images, shop.rating, keys)
    left = {"product": products, "images": pictures, "rating": ratings}
    parts = [df.select(F.lit(name).alias("table_name"), "id") for name, df in left.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _first_and_later(shop: Shop) -> tuple[DataFrame, DataFrame]:
    """Ratings as they stood at mid-month, and the submissions after that."""
    noon = F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")
    sent = shop.rating_submission
    held = changes.digest_submissions(sent.where(F.col("ts") < noon)).select(
        (F.col("last.seq") + 1).alias("id"), "user_id", "product_id", "value"
    )
    return held, sent.where(F.col("ts") >= noon)


@query
def rating_upsert(shop):
    held, later = _first_and_later(shop)
    return changes.upsert_ratings(held, later).rows


@query
def order_status_update(shop):
    done = changes.update_status(shop.shop_orders, shop.status_request, shop.users)
    moved = done.rows.select("id", "status", "user_name", F.lit("updated").alias("outcome"))
    refused = done.refused.select(F.col("order_id").alias("id"), "seq", "status", F.col("reject_reason").alias("outcome"))
    return moved.unionByName(refused, allowMissingColumns=True)


@query
def set_primary_image(shop):
    return images.set_primary(shop.images, shop.image_choice)


@query
def set_secondary_priority(shop):
    return images.set_secondary(shop.images, shop.image_choice)


@query
def update_image_priority(shop):
    return images.set_priority(shop.images, shop.image_choice)


@query
def add_product_images(shop):
    fit = lookups.accepted(lookups.validate_image(shop.image_request))
    return images.add_images(shop.images, fit)


# Orders against stock


@query
def order_admission(shop):
    return admission.admit_orders(shop.order_request, shop.lines, shop.product).orders


@query
def order_place(shop):
    _, detail, _ = admission.place_orders(
        shop.order_request, shop.lines, shop.product, shop.images, shop.shop_orders, as_of()
    )
    return detail


@query
def order_amend(shop):
    amended = jsonio.decode_lines(shop.amend_items.select("order_id", "pos", "item_json"))
    return admission.amend_orders(shop.order_request, amended, shop.lines, shop.product).orders


def _tables_after(after: admission.After) -> DataFrame:
    """Orders, lines, stock and refusals after a batch as flat rows, told apart by `part`."""
    lines = after.lines.select(
        F.lit("line").alias("part"), F.col("order_id").alias("id"), "pos", "product_id", F.col("id").alias("line_id"),
        "quantity", "qty", "selected_option",
    )
    parts = [
        after.orders.select(F.lit("order").alias("part"), *after.orders.columns), lines,
        after.products.select(F.lit("product").alias("part"), "id", "stock"),
        after.refused.select(F.lit("refused").alias("part"), F.col("order_id").alias("id"), "reason", "product_id", "available"),
    ]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part, allowMissingColumns=True)
    return whole


@query
def order_place_after(shop):
    return _tables_after(admission.place_after(
        shop.order_request, shop.lines, shop.product, shop.shop_orders, shop.lines, as_of()
    ))


@query
def order_amend_after(shop):
    amended, held = (shop.view(name).select("order_id", "pos", "item_json") for name in ("amend_items", "order_items"))
    return _tables_after(admission.amend_after(
        shop.order_request, amended, held, shop.product, shop.shop_orders, decode=jsonio.decode_lines
    ))


# Streams


@query
def stream_rating_upsert(shop):
    held, _ = _first_and_later(shop)
    folder = fresh_path(shop.spark, "rating-stream")
    sent = fixtures.rating_submissions(shop.stream("events"))
    streams.take_in_ratings(sent, folder)
    return streams.ratings_now(held, sent, folder).table


@query
def stream_order_status(shop):
    folder = fresh_path(shop.spark, "status-stream")
    sent = fixtures.over(fixtures.COMMON["status_request"], events=shop.stream("events"))
    streams.take_in_status(sent, folder)
    done = streams.status_now(shop.shop_orders, shop.users, sent, folder)
    state = done.table.select("id", "status", F.lit("current").alias("outcome"))
    refused = done.refused.select(F.col("order_id").alias("id"), "seq", "status", F.lit("refused").alias("outcome"))
    return state.unionByName(refused, allowMissingColumns=True)
