"""The shop tables derived from the driver's parquet tables; FIXTURES.md describes every column.

`COMMON` holds view bodies that Spark and DuckDB read alike; names in braces are the tables a body reads.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranking import ranked
from . import tables

AS_OF = "1998-01-01 00:00:00"
DRIVER_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

COMMON = {
    "category": """
SELECT DISTINCT CAST(substr(p_brand, 7) AS INT) AS id, p_brand AS name,
  CASE WHEN CAST(substr(p_brand, 7) AS INT) % 6 = 0 THEN NULL ELSE CAST(substr(p_brand, 7) AS INT) % 4 END AS priority,
  CAST(substr(p_brand, 7) AS INT) % 5 <> 0 AS active,
  concat('img://category/', substr(p_brand, 7)) AS image
FROM {part}""",
    "product": """
SELECT p_partkey + 1 AS id, p_name AS name, CAST(substr(p_brand, 7) AS INT) AS category_id,
  concat(p_type, ' ', p_name) AS description, p_size % 10 <> 0 AS active,
  CAST(p_retailprice AS DECIMAL(12,2)) AS price,
  CASE WHEN p_size % 3 = 0 THEN CAST(CAST(p_retailprice AS DECIMAL(12,2)) - 50 AS DECIMAL(12,2))
       WHEN p_size % 3 = 1 THEN CAST(0 AS DECIMAL(12,2)) END AS endprice,
  CAST(p_size * 20 AS INT) AS stock,
  CASE WHEN p_partkey % 5 = 0 THEN NULL WHEN p_partkey % 5 = 1 THEN '[]'
       ELSE concat('[', CAST(p_partkey + 2 AS STRING), ',', CAST(p_partkey + 3 AS STRING), ',',
                   CAST(p_partkey + 3 AS STRING), ',', CAST(p_partkey + 1000000 AS STRING), ']') END AS related
FROM {part}""",
    "images": """
SELECT l_partkey * 100000 + l_suppkey + 1 AS id,
  CASE WHEN l_partkey % 11 = 0 THEN l_partkey + 2 ELSE l_partkey + 1 END AS product_id,
  concat('img://', CAST(l_partkey AS STRING), '/', CAST(l_suppkey AS STRING)) AS link,
  CASE WHEN l_suppkey % 7 = 0 THEN NULL ELSE l_suppkey % 4 END AS priority
FROM (SELECT DISTINCT l_partkey, l_suppkey FROM {lineitem}) t""",
    "users": """
SELECT c_custkey + 1 AS id, c_name AS name, lower(c_name) AS user_name,
  concat('555-', CAST(c_custkey AS STRING)) AS phone, concat(lower(c_name), '@example.org') AS email,
  CAST(NULL AS STRING) AS avatar, c_acctbal > 0 AS active, 'x' AS password FROM {customer}""",
    "shop_orders": """
SELECT o_orderkey + 1 AS id,
  CASE WHEN o_orderkey % 97 = 0 THEN NULL WHEN o_orderkey % 89 = 0 THEN 1000000000 ELSE o_custkey + 1 END AS user_id,
  CASE CAST(o_orderkey % 6 AS INT) WHEN 0 THEN 'Created' WHEN 1 THEN 'Accepted' WHEN 2 THEN 'Preparing'
    WHEN 3 THEN 'Shipping' WHEN 4 THEN 'Delivered' ELSE 'Canceled' END AS status,
  CASE WHEN o_orderkey % 101 = 0 THEN NULL ELSE o_orderdate END AS created_at, o_orderkey % 13 <> 0 AS active,
  CAST(o_orderkey % 20 AS DECIMAL(12,2)) AS delivery_cost, concat('V', CAST(o_orderkey % 200 AS STRING)) AS voucher_code
FROM {orders}""",
    "order_request": """
SELECT o_orderkey + 1 AS id, o_custkey + 1 AS user_id,
  CASE CAST(o_orderkey % 4 AS INT) WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'Accepted' END AS status,
  CASE WHEN o_orderkey % 101 = 0 THEN NULL ELSE o_orderdate END AS created_at,
  CASE CAST(o_orderkey % 3 AS INT) WHEN 0 THEN NULL WHEN 1 THEN false ELSE true END AS active,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(o_orderkey % 5 AS DECIMAL(12,2)) END AS delivery_cost,
  CASE WHEN o_orderkey % 8 = 0 THEN NULL ELSE o_orderkey % 9 END AS voucher_id
FROM {orders}""",
    "voucher": """
SELECT c_custkey + 1 AS id, concat('V', CAST(c_custkey AS STRING)) AS code,
  CASE WHEN c_custkey % 2 = 0 THEN 'num' ELSE 'per' END AS type, CAST(c_custkey % 50 AS INT) AS value,
  CAST(c_custkey % 10 AS INT) AS min_value, CAST(c_custkey % 10 + 100 AS INT) AS max_value, c_custkey % 4 <> 0 AS active,
  CASE WHEN c_custkey % 9 = 0 THEN NULL WHEN c_custkey % 3 = 0 THEN TIMESTAMP '1997-06-01 00:00:00'
       WHEN c_custkey % 3 = 1 THEN TIMESTAMP '1998-01-01 00:00:00' ELSE TIMESTAMP '1999-06-01 00:00:00' END AS expire_date
FROM {customer}""",
    "voucher_request": """
SELECT c_custkey + 1 AS id, concat('V', CAST(c_custkey AS STRING)) AS code,
  CASE CAST(c_custkey % 4 AS INT) WHEN 0 THEN 'num' WHEN 1 THEN 'per' WHEN 2 THEN 'gift' END AS type
FROM {customer}""",
    "banner": """
SELECT p_partkey + 1 AS id, concat('banner ', CAST(p_partkey + 1 AS STRING)) AS name,
  CASE WHEN p_partkey % 13 IN (0, 1, 2, 3, 12) THEN 'List' WHEN p_partkey % 13 IN (4, 5, 6) THEN 'Timer'
       WHEN p_partkey % 13 IN (7, 8, 9) THEN 'Category' WHEN p_partkey % 13 = 10 THEN 'Slider' ELSE 'Single' END AS type,
  CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_size % 5 END AS priority,
  p_size % 2 = 0 AS active, p_size % 3 = 0 AS hidden,
  CASE CAST(p_partkey % 13 AS INT)
    WHEN 0 THEN concat('[', CAST(p_partkey + 1 AS STRING), ',', CAST(p_partkey + 2 AS STRING), ',',
                       CAST(p_partkey + 2 AS STRING), ',-1]')
    WHEN 1 THEN CAST(p_partkey + 1 AS STRING)
    WHEN 2 THEN concat('[{{"productIds":[', CAST(p_partkey + 1 AS STRING), ',{{"id":', CAST(p_partkey + 2 AS STRING),
                       '}},', CAST(p_partkey + 1 AS STRING), ']}}]')
    WHEN 3 THEN '{{"productIds":[]}}'
    WHEN 4 THEN concat('[{{"endDate":"2030-01-01","productIds":[', CAST(p_partkey + 1 AS STRING), ',',
                       CAST(p_partkey + 2 AS STRING), ',', CAST(p_partkey + 2 AS STRING), ']}}]')
    WHEN 5 THEN '{{"endDate":"2030-02-01"}}'
    WHEN 6 THEN concat('[', CAST(p_partkey + 1 AS STRING), ']')
    WHEN 7 THEN concat('[', substr(p_brand, 7), ',', CAST(CAST(substr(p_brand, 7) AS INT) + 1 AS STRING), ',-1]')
    WHEN 8 THEN concat('{{"categoryIds":[', substr(p_brand, 7), ',', CAST(CAST(substr(p_brand, 7) AS INT) + 1 AS STRING),
                       ',-1]}}')
    WHEN 9 THEN concat('[{{"categoryIds":', substr(p_brand, 7), '}}]')
    WHEN 10 THEN concat('["', p_name, '",{{"x":null}},true]')
    WHEN 11 THEN '[]' END AS map
FROM {part}""",
    "image_request": """
SELECT event_id AS seq, user_id * 13 + event_id % 17 AS product_id,
  CASE WHEN event_id % 19 = 0 THEN NULL ELSE concat('new://', CAST(event_id AS STRING)) END AS link
FROM {events}""",
    "status_request": """
SELECT event_id AS seq, ts, user_id * 100 + event_id % 100 + 1
    + CASE WHEN event_id % 211 = 0 THEN 1000000000 ELSE 0 END AS order_id,
  CASE event_type WHEN 'signup' THEN 'Accepted' WHEN 'view' THEN 'Preparing' WHEN 'click' THEN 'Shipping'
    WHEN 'purchase' THEN 'Delivered' ELSE event_type END AS status
FROM {events}""",
    "image_choice": """
SELECT l_partkey * 100000 + l_suppkey + 1 + CASE WHEN l_suppkey % 9 = 0 THEN 50000 ELSE 0 END AS image_id,
  l_orderkey * 10 + l_linenumber AS seq, CAST(l_quantity AS BIGINT) % 4 AS priority
FROM {lineitem}""",
    "account": """
SELECT s_suppkey + 1 AS id, s_name AS name, concat('u', CAST(s_suppkey * 5 AS STRING)) AS username,
  concat('e', CAST(s_suppkey * 7 AS STRING)) AS email FROM {supplier}""",
    "account_request": """
SELECT c_custkey AS seq, c_name AS name, concat('u', CAST(CAST(floor(c_custkey / 2) AS BIGINT) AS STRING)) AS username,
  CASE WHEN c_custkey % 10 = 0 THEN concat('x', CAST(c_custkey AS STRING))
       ELSE concat('e', CAST(CAST(floor((c_custkey + 1) / 2) AS BIGINT) AS STRING)) END AS email
FROM {customer}""",
    "product_update": """
SELECT l_partkey + 1 + CASE WHEN l_partkey % 50 = 0 THEN 1000000000 ELSE 0 END AS id,
  CAST(max(l_extendedprice) AS DECIMAL(12,2)) AS price, CAST(max(l_quantity) AS INT) AS stock
FROM {lineitem} GROUP BY l_partkey""",
}

RATING_SUBMISSION = """
SELECT event_id AS seq, ts, user_id + 1 AS user_id,
  CAST(get_json_object(props, '$.k') AS BIGINT) + 1 AS product_id,
  CAST(floor(value) AS INT) % 5 + 1 AS value FROM {events}"""

def tables_of(body: str) -> list[str]:
    return [t for t in DRIVER_TABLES if re.search(r"\{%s\}" % t, body)]


def view(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One shop table, derived from the driver tables in `folder`."""
    if name in _DERIVED:
        return _DERIVED[name](spark, folder)
    body = COMMON[name]
    inputs = {t: tables.load_driver_table(spark, folder, t) for t in tables_of(body)}
    return over(body, **inputs)


def over(body: str, **inputs: DataFrame) -> DataFrame:
    """A view body over the given tables, streams included."""
    spark = next(iter(inputs.values())).sparkSession
    # The driver's timestamps carry no zone, so the literals compared with them must not either.
    return spark.sql(body.replace("TIMESTAMP '", "TIMESTAMP_NTZ '"), **inputs)


def rating_submissions(events: DataFrame) -> DataFrame:
    return over(RATING_SUBMISSION, events=events)


def _rating_submission(spark: SparkSession, folder: str) -> DataFrame:
    return rating_submissions(tables.load_driver_table(spark, folder, "events"))


def _rating(spark: SparkSession, folder: str) -> DataFrame:
    last = F.max_by(F.struct("seq", "value"), F.struct("ts", "seq")).alias("last")
    kept = _rating_submission(spark, folder).groupBy("user_id", "product_id").agg(last)
    return kept.select(
        (F.col("last.seq") + 1).alias("id"), "user_id", "product_id", F.col("last.value").alias("value")
    )


def _order_items(spark: SparkSession, folder: str) -> DataFrame:
    # The key gets its final form before the lines are dealt by it, so joins by order_id find them in place.
    lines = tables.load_driver_table(spark, folder, "lineitem").select(
        (F.col("l_orderkey") + 1).alias("order_id"),
        "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
    )
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    placed = ranked(lines, ["order_id"], [F.col(c).asc() for c in order], "pos")
    product, quantity = F.format_string("%d", F.col("l_partkey") + 1), F.col("l_quantity").cast("int").cast("string")
    spelling = F.col("pos") % 3
    return placed.select(
        "order_id",
        "pos",
        (F.col("l_partkey") + 1).alias("product_id"),
        F.when(spelling != 0, F.col("l_quantity").cast("int")).alias("qty"),
        F.when(spelling == 1, F.concat(F.lit('{"product_id":'), product, F.lit(',"quantity":'), quantity, F.lit("}")))
        .when(spelling == 2, F.concat(F.lit('{"id":'), product, F.lit(',"qty":'), quantity,
                                      F.lit(',"selectedOption":"L"}')))
        .otherwise(F.concat(F.lit('{"product_id":'), product, F.lit("}")))
        .alias("item_json"),
    )


def _order_docs(spark: SparkSession, folder: str) -> DataFrame:
    lines = _order_items(spark, folder)
    sorted_lines = F.array_sort(F.collect_list(F.struct("pos", "item_json")))
    docs = lines.groupBy(F.col("order_id").alias("id")).agg(sorted_lines.alias("lines"))
    text = F.concat(F.lit("["), F.concat_ws(",", F.col("lines.item_json")), F.lit("]"))
    return docs.select("id", text.alias("items"))


def _amend_items(spark: SparkSession, folder: str) -> DataFrame:
    """New contents of every order: other quantities, and every fourth line another product."""
    pos, pid = F.col("pos"), F.col("product_id")
    product = F.when(pos % 4 == 0, pid + 1).otherwise(pid).cast("string")
    quantity = F.greatest(F.coalesce("qty", F.lit(2)) + 3 * pos - 5, F.lit(0)).cast("string")
    text = F.concat(F.lit('{"product_id":'), product, F.lit(',"qty":'), quantity, F.lit("}"))
    return _order_items(spark, folder).select("order_id", "pos", text.alias("item_json"))


_DERIVED = {
    "amend_items": _amend_items,
    "rating_submission": _rating_submission,
    "rating": _rating,
    "order_items": _order_items,
    "order_docs": _order_docs,
}
