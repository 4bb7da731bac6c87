"""Column helpers for the value rules of the shop data."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def or_else(value: Column, empty, *fallbacks: Column) -> Column:
    """`value || fallback`: null and the empty value (0, '' or false) both give way to the fallback."""
    return F.coalesce(F.nullif(value, F.lit(empty)), *fallbacks)


def effective_price(endprice: Column, price: Column) -> Column:
    """The reduced price, else the price, else 0; a reduced price of 0 means there is none."""
    kind = "decimal(12,2)"
    return F.coalesce(F.nullif(endprice, F.lit(0).cast(kind)), price, F.lit(0).cast(kind)).cast(kind)


def mean_rating(value: Column, digits: int) -> Column:
    return F.round(F.avg(value), digits)


def by_priority(image_id: str = "id") -> list[Column]:
    """Display order of images: priority with nulls last, then id."""
    return [F.col("priority").asc_nulls_last(), F.col(image_id).asc()]
