"""Home-page banners: their JSON maps resolved to products and categories.

The five listings differ only in which elements they resolve, so each is a `Listing` of switches over one plan:
decode the maps, collect the referenced ids, join the product cards and categories, and attach the hits to their
elements. Results are flat, one row per hit or per element without one; `nest_banners` builds the JSON documents.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.jsonio import decode_map, encode
from ..storage import materialise
from .catalog import product_cards


class Listing(NamedTuple):
    category_lists: bool = False  # {categoryIds: […]} of Category banners becomes one flat list
    category_numbers: bool = False  # numbers of Category banners are categories
    list_numbers: bool = False  # numbers of List banners are products
    list_objects: bool = False  # {productIds: […]} of List banners becomes {products}
    timer: str = "object"  # Timer banners: "object" elements only, "any" element, or "none"
    once: bool = False  # Timer products by membership: each once, by product id
    end_date: bool = True  # Timer objects keep their end date
    id_objects: bool = False  # Timer ids may be {id} objects too


ADMIN = Listing(category_lists=True, list_numbers=True)
ADMIN_PRODUCTS = Listing(category_numbers=True, list_numbers=True, timer="any", once=True)
CLIENT = Listing(category_numbers=True, list_numbers=True, timer="none")
CLIENT_PRODUCTS = Listing(category_lists=True, list_objects=True)
CLIENT_BY_ID = Listing(category_lists=True, list_objects=True, end_date=False, id_objects=True)

CARD = ["name", "description", "price", "endprice", "primary_image", "avg_rating", "rating_count"]


def sort_banners(banners: DataFrame) -> DataFrame:
    return banners.orderBy(F.col("priority").asc_nulls_last(), F.col("id").asc())


def _form(listing: Listing) -> Column:
    """What an element becomes: none, categories, category, products, product or the element itself."""
    kind, of = F.col("kind"), lambda t: F.col("type") == t
    rule = F.when(F.lit(listing.timer == "any") & of("Timer") & kind.isNull(), "none")
    rule = rule.when(F.lit(listing.category_lists) & of("Category"), "categories")
    rule = rule.when(F.lit(listing.category_numbers) & of("Category") & (kind == "number"), "category")
    timer = F.lit(listing.timer == "any") | (F.lit(listing.timer == "object") & (kind == "object"))
    rule = rule.when(of("Timer") & timer, "products")
    rule = rule.when(F.lit(listing.list_objects) & of("List") & (kind == "object"), "products")
    rule = rule.when(F.lit(listing.list_numbers) & of("List") & (kind == "number"), "product")
    return rule.otherwise("element")


def banner_elements(banners: DataFrame, listing: Listing) -> DataFrame:
    """Decoded elements with their form, end date and `ref_ids`, the product or category ids they name.

    `slot` is the element's place, 0 for a whole-map list. Ids are whole numbers, as numbers or as text; what is
    neither (nor an {id} object where those count), such as `true` or 1.5, stays as a null entry, so that positions are kept.
    """
    decoded = decode_map(banners).withColumn("form", _form(listing))
    dated = (F.col("form") == "products") & (F.col("type") == "Timer") & F.lit(listing.end_date)
    with_objects = (F.col("type") == "List") | F.lit(listing.id_objects)

    def entries(path: str) -> Column:
        return F.try_variant_get("value", path, "array<variant>")

    def number(entry: Column, path: str = "$") -> Column:
        text = F.try_variant_get(entry, path, "string")
        return F.when(text.rlike(r"^\s*[+-]?\d+\s*$"), text.try_cast("bigint"))

    def number_or_id(entry: Column) -> Column:
        return F.coalesce(number(entry), F.when(with_objects, number(entry, "$.id")))

    form = F.col("form")
    ids = (
        F.when(form.isin("product", "category"), F.array(number(F.col("value"))))
        .when(form == "products", F.transform(entries("$.productIds"), number_or_id))
        .when(form == "categories", F.transform(entries("$.categoryIds"), lambda x: number(x)))
    )
    return decoded.withColumns({
        "end_date": F.when(dated, F.try_variant_get("value", "$.endDate", "string")),
        "slot": F.when(form == "categories", 0).otherwise(F.coalesce("elem_pos", F.lit(1))).cast("bigint"),
        "ref_ids": ids,
    }).drop("value")


def referenced_ids(elements: DataFrame) -> DataFrame:
    """banner_id, slot, form, type, elem_pos, sub_pos, ref_id: one row per id an element names."""
    exploded = elements.select(
        "banner_id", "slot", "form", "type", "elem_pos", F.posexplode("ref_ids").alias("sub_pos", "ref_id")
    )
    return exploded.withColumn("sub_pos", F.col("sub_pos").cast("bigint") + 1)


def resolve_banners(
    banners: DataFrame, products: DataFrame, images: DataFrame, ratings: DataFrame, categories: DataFrame,
    listing: Listing,
) -> DataFrame:
    """Flat rows of a listing; use `sort_banners` order (priority with nulls last, id) and slot, elem_pos, sub_pos."""
    # Decoded once: the elements are read again for their rows, for the ids, and for the cards of those ids.
    elements = materialise(banner_elements(banners, listing), "banner-elements")
    refs = referenced_ids(elements)

    of_products = F.col("form").isin("product", "products")
    wanted = refs.where(of_products & F.col("ref_id").isNotNull())
    if listing.once:
        members = wanted.where("form = 'products'").select("banner_id", "slot", "elem_pos", "ref_id").distinct()
        wanted = wanted.where("form = 'product'").select("banner_id", "slot", "elem_pos", "sub_pos", "ref_id").unionByName(
            members.withColumn("sub_pos", F.col("ref_id"))
        )
    cards = product_cards(products, images, ratings, wanted.select(F.col("ref_id").alias("id")).distinct())
    product_hits = wanted.select("banner_id", "slot", "elem_pos", "sub_pos", F.col("ref_id").alias("id")).join(cards, "id")

    named = categories.select("id", F.col("name").alias("category_name"), F.col("image").alias("category_image"))
    of_categories = refs.where("form IN ('category', 'categories')").join(
        named.withColumn("ref_id", F.col("id").cast("bigint")), "ref_id", "left"
    )
    category_hits = of_categories.where("form = 'categories' OR id IS NOT NULL").select(
        "banner_id", "slot", "elem_pos", "sub_pos", F.col("id").cast("bigint").alias("category_id"),
        "category_name", "category_image",
    )
    hits = product_hits.withColumnRenamed("id", "product_id").unionByName(category_hits, allowMissingColumns=True)

    # One base row per element; a whole-map list has one for its banner (its first element, or none for []).
    base = elements.where("form <> 'categories' OR elem_pos IS NULL OR elem_pos = 1").select(
        "banner_id", "type", "priority", "slot", "form", F.when(F.col("slot") > 0, F.col("kind")).alias("kind"),
        "end_date", F.when(F.col("form") == "element", F.col("elem")).alias("elem"),
    )
    return base.join(hits, ["banner_id", "slot"], "left").select(
        "banner_id", "type", "priority", "slot", "kind", "form", "end_date", "elem", "elem_pos", "sub_pos",
        "product_id", *CARD, "category_id", "category_name", "category_image",
    )


def quarantined_banners(banners: DataFrame) -> DataFrame:
    """Banners whose map is not JSON."""
    return decode_map(banners).where("malformed").select("banner_id", "type").distinct()


def nest_banners(flat: DataFrame, listing: Listing) -> DataFrame:
    """banner_id, type, priority, map: the listing's JSON documents. A document holds what one stored map names."""
    card = F.struct(F.col("product_id").alias("id"), *[F.col(c) for c in CARD])
    category = F.struct(
        F.col("category_id").alias("id"), F.col("category_name").alias("name"), F.col("category_image").alias("image")
    )
    # elem_pos is set on hits only; a list entry of an unknown category is a hit with null fields.
    hit = F.struct("elem_pos", "sub_pos", F.when(F.col("product_id").isNotNull(), card).alias("card"),
                   category.alias("category"))
    element = flat.groupBy("banner_id", "type", "priority", "slot", "form", "end_date", "elem").agg(
        F.array_sort(F.collect_list(F.when(F.col("elem_pos").isNotNull(), hit))).alias("hits")
    )

    def array(of: str) -> Column:
        texts = F.transform("hits", lambda h: encode(h[of]))
        return F.when(F.size("hits") > 0, F.concat(F.lit("["), F.array_join(texts, ","), F.lit("]")))

    null = F.lit("null")
    products = F.coalesce(array("card"), null)
    dated = (F.col("type") == "Timer") & F.lit(listing.end_date)
    end_date = F.coalesce(encode(F.struct(F.col("end_date").alias("endDate"))), null)
    timed = F.concat(F.expr("left(_end, length(_end) - 1)"), F.lit(',"products":'), products, F.lit("}"))
    text = (
        F.when(F.col("form") == "product", products)
        .when((F.col("form") == "products") & dated, timed)
        .when(F.col("form") == "products", F.concat(F.lit('{"products":'), products, F.lit("}")))
        .when(F.col("form") == "category", F.when(F.size("hits") > 0, encode(F.col("hits")[0]["category"])))
        .when(F.col("form") == "categories", array("category"))
        .otherwise(F.col("elem"))
    )
    rows = element.withColumn("_end", end_date).select(
        "banner_id", "type", "priority", "slot", F.col("form").isin("categories", "none").alias("_whole"),
        text.alias("text"),
    )
    ordered = F.array_sort(F.collect_list(F.struct("slot", F.coalesce("text", null).alias("text"))))
    whole = F.bool_or("_whole")
    grouped = rows.groupBy("banner_id", "type", "priority").agg(
        ordered.alias("parts"), whole.alias("whole"), F.max("text").alias("only")
    )
    listed = F.concat(F.lit("["), F.array_join("parts.text", ","), F.lit("]"))
    return grouped.select(
        "banner_id", "type", "priority", F.when(F.col("whole"), F.col("only")).otherwise(listed).alias("map")
    )
