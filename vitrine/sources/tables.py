"""The nine shop tables: schemas, readers and the row sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

MONEY = T.DecimalType(12, 2)


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


_BIG, _INT, _TEXT, _BOOL, _TIME = T.LongType(), T.IntegerType(), T.StringType(), T.BooleanType(), T.TimestampNTZType()

SCHEMAS = {
    "product": _schema(
        id=_BIG, name=_TEXT, category_id=_INT, related=_TEXT, description=_TEXT, active=_BOOL, created_at=_TIME,
        options=_TEXT, price=MONEY, endprice=MONEY, endpricdate=_TIME, stock=_INT, available=_BOOL,
        created_at_product=_TIME,
    ),
    "images": _schema(id=_BIG, product_id=_BIG, link=_TEXT, priority=_BIG),
    "rating": _schema(id=_BIG, user_id=_BIG, product_id=_BIG, value=_INT),
    "category": _schema(id=_INT, name=_TEXT, priority=_INT, active=_BOOL, image=_TEXT, created_at=_TIME),
    # The password hash is part of the stored table and is left out of the schema, so no scan ever reads it.
    "users": _schema(
        id=_BIG, name=_TEXT, user_name=_TEXT, phone=_TEXT, email=_TEXT, avatar=_TEXT, active=_BOOL, created_at=_TIME,
    ),
    "shop_orders": _schema(
        id=_BIG, user_id=_BIG, items=_TEXT, phone=_TEXT, address=_TEXT, status=_TEXT, created_at=_TIME, active=_BOOL,
        voucher_info=_TEXT, delivery_cost=MONEY, voucher_id=_BIG,
    ),
    "voucher": _schema(
        id=_BIG, name=_TEXT, code=_TEXT, type=_TEXT, value=_INT, min_value=_INT, max_value=_INT, expire_date=_TIME,
        active=_BOOL, created_at=_TIME, is_first=_BOOL, no_of_usage=_INT,
    ),
    "banner": _schema(
        id=_BIG, name=_TEXT, priority=_INT, type=_TEXT, active=_BOOL, map=_TEXT, background=_TEXT, created_at=_TIME,
        hidden=_BOOL,
    ),
    "admin": _schema(
        id=_BIG, name=_TEXT, username=_TEXT, email=_TEXT, role=_TEXT, status=_BOOL, created_at=_TIME, updated_at=_TIME,
    ),
}


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Full scan of one stored table; later filters and column choices reach the files."""
    return spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")


def load_driver_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stream_driver_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The same table as a stream of its files."""
    schema = load_driver_table(spark, folder, name).schema
    # A pattern, so that one file and a folder of part files both do.
    return spark.readStream.schema(schema).parquet(f"{folder}/{name}.parque[t]")


def load_jdbc(
    spark: SparkSession, url: str, table: str, key: str = "id", *, lower: int, upper: int, parts: int, **options: str
) -> DataFrame:
    """One table of a relational database, read by `parts` tasks over ranges of its key."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    return reader.options(
        partitionColumn=key, lowerBound=lower, upperBound=upper, numPartitions=parts
    ).load().drop("password", "password_hash")


def save_rows(df: DataFrame, path: str, form: str = "json") -> None:
    """Result rows with their field names, written by the tasks that hold them; null fields stay in the text."""
    writer = df.write.format(form)
    if form == "json":
        writer = writer.option("ignoreNullFields", "false")
    writer.save(path)
