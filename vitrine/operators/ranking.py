"""Positions, ranks and running sums that stay spread over the cluster when one group is huge.

A Spark window works through each of its groups in one task. The helpers here look at the size of the largest group
first (one map-side combined count) and use a plain window up to `WINDOW_ROWS`; larger groups are sorted across
tasks by the whole sort key, or summed in fixed blocks, with the same result.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialise, shuffles_dropped

WINDOW_ROWS = 2_000_000
BLOCK = 100_000
TOP_ROWS = 100_000
_LOCAL_BITS = 33  # monotonically_increasing_id keeps the task number above these bits


def _same(left: DataFrame, keys: Sequence[str], right: DataFrame) -> Column:
    """Equal keys, nulls included; the right side names them `_k0`, `_k1`, …"""
    return reduce(Column.__and__, [left[k].eqNullSafe(right[f"_k{i}"]) for i, k in enumerate(keys)])


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    with shuffles_dropped(df.sparkSession):
        found = df.groupBy(*keys).agg(F.count("*").alias("_n")).agg(F.max("_n").alias("n")).first()
    return found["n"] or 0


def positions(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """0-based position of every row in the total order, from a range sort instead of a one-task window."""
    marked = materialise(df.orderBy(*order).withColumn("_mark", F.monotonically_increasing_id()), "sorted")
    task = F.shiftright("_mark", _LOCAL_BITS)
    # One row per sort task, so the side sent to every executor is bounded by the number of tasks.
    starts = marked.groupBy(task.alias("_task")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select("_task", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    local = F.col("_mark").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1))
    return (
        marked.withColumn("_task", task)
        .join(F.broadcast(starts), "_task")
        .withColumn(name, F.col("_start") + local)
        .drop("_task", "_mark", "_start")
    )


def ranked(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str, window_rows: int | None = None
) -> DataFrame:
    """1-based position of every row within its group."""
    if largest_group(df, keys) <= (WINDOW_ROWS if window_rows is None else window_rows):
        window = Window.partitionBy(*keys).orderBy(*order)
        return df.withColumn(name, F.row_number().over(window).cast("bigint"))
    placed = positions(df, [*[F.col(k).asc() for k in keys], *order], "_at")
    first = placed.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.min("_at").alias("_first"))
    found = placed.join(first, _same(placed, keys, first)).select(*df.columns, (F.col("_at") - F.col("_first") + 1).alias(name))
    # Written, because a later grouping by more columns would else keep the partitions of this join, hot key included.
    return materialise(found, "ranked")


def sums_before(
    df: DataFrame, keys: Sequence[str], rank: str, sums: dict[str, Column], window_rows: int | None = None,
    block: int | None = None, largest: int | None = None,
) -> DataFrame:
    """For every row, sums over the earlier rows of its group by `rank` (a whole number, unique in the group).

    The largest group size may be passed in when it is already known.
    """
    if largest is None:
        largest = largest_group(df, keys)
    if largest <= (WINDOW_ROWS if window_rows is None else window_rows):
        earlier = Window.partitionBy(*keys).orderBy(rank).rowsBetween(Window.unboundedPreceding, -1)
        return df.select("*", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(n) for n, c in sums.items()])
    # Sums of whole earlier blocks plus the earlier rows of the own block; no group is larger than a block.
    # Written once, since totals and rows both read it: chained steps would else double their plan each time. The
    # files also drop any partitioning by the bare key that the rows come with.
    blocked = materialise(df.withColumn("_block", F.floor(F.col(rank) / F.lit(block or BLOCK))), "blocked")
    totals = blocked.groupBy(*keys, "_block").agg(*[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()])
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        *keys, "_block", *[F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_c_{n}") for n in sums]
    )
    inside = Window.partitionBy(*keys, "_block").orderBy(rank).rowsBetween(Window.unboundedPreceding, -1)
    local = blocked.select(
        "*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"_l_{n}") for n, c in sums.items()]
    )
    held = carried.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate([*keys, "_block"])], *[f"_c_{n}" for n in sums]
    )
    return local.join(held, _same(local, [*keys, "_block"], held)).select(
        *df.columns, *[(F.col(f"_l_{n}") + F.col(f"_c_{n}")).alias(n) for n in sums]
    )


def with_group(
    df: DataFrame, keys: Sequence[str], values: dict[str, Column], window_rows: int | None = None,
    largest: int | None = None,
) -> DataFrame:
    """Every row with aggregates of its whole group; rows with a null key are a group like others.

    Up to `WINDOW_ROWS` per group this is one window (one shuffle); larger groups are aggregated and joined back, where
    the join may split them.
    """
    if largest is None:
        largest = largest_group(df, keys)
    if largest <= (WINDOW_ROWS if window_rows is None else window_rows):
        group = Window.partitionBy(*keys)
        return df.select("*", *[value.over(group).alias(name) for name, value in values.items()])
    df = materialise(df, "grouped")  # read for the aggregates and for the rows
    found = df.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(
        *[value.alias(name) for name, value in values.items()]
    )
    return df.join(found, _same(df, keys, found)).select(*[df[c] for c in df.columns], *values)


def page_index(df: DataFrame, order: Sequence[Column], limit: int = 10) -> DataFrame:
    """Page number (1-based) and place on the page of every row: all pages at once."""
    at = F.col("_at")
    return positions(df, order, "_at").select(
        *df.columns,
        (F.floor(at / F.lit(limit)) + 1).cast("bigint").alias("page"),
        (at % F.lit(limit) + 1).cast("bigint").alias("place"),
    )


def paginate(df: DataFrame, order: Sequence[Column], page: int | None = 1, limit: int | None = 10) -> DataFrame:
    """One page with page, limit, total and total_pages on its rows; page and size fall back to 1 and 10.

    Early pages are a top-k; pages beyond `TOP_ROWS` rows come from the distributed positions, so that the rows
    before them never gather in one place. A page past the end is one row whose other columns are null.
    """
    # The remaining columns break ties, so that both ways below, and every run, agree on a page.
    order = [*order, *[F.col(c) for c, kind in df.dtypes if "map<" not in kind]]
    page = page if page and page > 0 else 1
    limit = limit if limit and limit > 0 else 10
    total = df.count()
    start = (page - 1) * limit
    if start >= total:  # one row of nulls still tells the totals
        rows = df.sparkSession.range(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema])
    elif start + limit <= TOP_ROWS:
        rows = df.orderBy(*order).offset(start).limit(limit)
    else:
        at = F.col("_at")
        rows = positions(df, order, "_at").where((at >= start) & (at < start + limit)).drop("_at").orderBy(*order)
    return rows.select(
        *df.columns,
        F.lit(page).cast("bigint").alias("page"),
        F.lit(limit).cast("bigint").alias("limit"),
        F.lit(total).cast("bigint").alias("total"),
        F.lit(-(-total // limit)).cast("bigint").alias("total_pages"),
    )


def fresh_ids(batch: DataFrame, table: DataFrame, order: Sequence[Column], id_col: str = "id") -> DataFrame:
    """Ids for new rows, counting on from the largest id of the table in the given order."""
    top = table.agg(F.coalesce(F.max(id_col), F.lit(0)).alias("top")).first()["top"]
    numbered = positions(batch, order, "_at")
    return numbered.withColumn(id_col, (F.col("_at") + F.lit(top + 1)).cast("bigint")).drop("_at")
