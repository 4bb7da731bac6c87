"""Reading and writing the JSON columns: order items, banner maps and related ids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _opens_array(text: Column) -> Column:
    return text.rlike(r"^[ \t\r\n]*\[")


def as_array_text(text: Column) -> Column:
    """JSON text as a JSON array: arrays pass, one other value (null included) becomes the only element.

    Text that holds several values, or none, is not JSON and gives null.
    """
    wrapped = F.concat(F.lit("["), F.coalesce(text, F.lit("null")), F.lit("]"))
    return F.when(_opens_array(text), text).when(F.json_array_length(wrapped) == 1, wrapped)


def decode_items(docs: DataFrame, order_id: str = "id") -> DataFrame:
    """One row per line of `docs.items`: order_id, pos (1-based), the raw ids and quantities, option, raw.

    Text that is not valid JSON, or no array, has no lines.
    """
    return docs.sparkSession.sql(
        f"""
        SELECT d.{order_id} AS order_id, CAST(e.pos AS BIGINT) + 1 AS pos,
          try_variant_get(e.value, '$.product_id', 'bigint') AS product_id,
          try_variant_get(e.value, '$.id', 'bigint') AS id,
          try_variant_get(e.value, '$.quantity', 'bigint') AS quantity,
          try_variant_get(e.value, '$.qty', 'bigint') AS qty,
          try_variant_get(e.value, '$.selectedOption', 'string') AS selected_option,
          try_variant_get(e.value, '$.name', 'string') AS name,
          try_variant_get(e.value, '$.price', 'decimal(12,2)') AS price,
          try_variant_get(e.value, '$.stock', 'int') AS stock,
          try_variant_get(e.value, '$.primary_image', 'string') AS primary_image,
          to_json(e.value) AS raw
        FROM {{docs}} d, LATERAL variant_explode(try_parse_json(d.items)) e
        """,
        docs=docs.withColumn("items", F.when(_opens_array(F.col("items")), F.col("items"))),
    )


def decode_lines(lines: DataFrame, text: str = "item_json") -> DataFrame:
    """The same fields for lines already stored one per row as JSON objects; other columns are kept."""
    value = F.try_parse_json(F.col(text))
    fields = {
        "product_id": "bigint", "id": "bigint", "quantity": "bigint", "qty": "bigint", "selectedOption": "string",
        "name": "string", "price": "decimal(12,2)", "stock": "int", "primary_image": "string",
    }
    parsed = lines.drop(text).columns
    return lines.withColumn("_v", value).select(
        *[c for c in parsed if c not in fields],
        *[
            F.try_variant_get("_v", f"$.{name}", kind).alias("selected_option" if name == "selectedOption" else name)
            for name, kind in fields.items()
        ],
    )


def decode_map(banners: DataFrame) -> DataFrame:
    """One row per element of `banner.map`: banner_id, type, priority, elem_pos (1-based), kind, elem, value.

    A scalar map counts as an array of one. An empty array keeps one row whose kind is null; `malformed` marks text
    that is not JSON. `value` is the element as a variant, for use before the next shuffle only.
    """
    return banners.sparkSession.sql(
        """
        SELECT id AS banner_id, type, priority, malformed,
          CASE WHEN value IS NOT NULL THEN CAST(pos AS BIGINT) + 1 END AS elem_pos,
          CASE WHEN value IS NULL THEN NULL WHEN t = 'VOID' THEN 'null' WHEN t = 'STRING' THEN 'string'
               WHEN t = 'BOOLEAN' THEN 'boolean' WHEN t LIKE 'OBJECT%' THEN 'object' WHEN t LIKE 'ARRAY%' THEN 'array'
               ELSE 'number' END AS kind,
          to_json(value) AS elem, value
        FROM (
          SELECT b.id, b.type, b.priority, try_parse_json(b.text) IS NULL AS malformed, e.pos, e.value, schema_of_variant(e.value) AS t
          FROM {wrapped} b, LATERAL variant_explode_outer(try_parse_json(b.text)) e)
        """,
        wrapped=banners.select("id", "type", "priority", as_array_text(F.col("map")).alias("text")),
    )


def decode_related(products: DataFrame) -> DataFrame:
    """One row per entry of `product.related`, repeats and unknown ids included: product_id, pos, related_id."""
    ids = F.from_json("related", "array<bigint>")
    return products.select(F.col("id").alias("product_id"), F.posexplode(ids).alias("pos", "related_id")).select(
        "product_id", (F.col("pos") + 1).cast("bigint").alias("pos"), "related_id"
    )


def encode(value: Column) -> Column:
    """An object or array as JSON text with its null fields kept."""
    return F.to_json(value, {"ignoreNullFields": "false"})


def encode_columns(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    """The rows as they are stored: objects and arrays of `names` as JSON text, text unchanged, null as null."""
    kinds = dict(rows.dtypes)
    return rows.withColumns({c: F.col(c) if kinds[c] == "string" else encode(F.col(c)) for c in names})
