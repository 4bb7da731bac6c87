"""Placing and amending orders against stock, a whole batch at a time.

Whether an order fits depends on which earlier ones did. Instead of walking the orders one by one, every round
bounds the stock each open order can meet: at least what is left if all earlier open orders take theirs, at most
what is left if none does. Orders that fit the lower bound are in, orders that miss the upper bound are out, and the
rest wait for the next round. The earliest open order always settles, so the result is exactly the sequential one.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import fresh_path, materialise, remove, scratch, shuffles_dropped
from .orders import item_detail, normalise_items, normalise_orders
from .ranking import fresh_ids, largest_group, positions, sums_before, with_group


class Groups(NamedTuple):
    """Largest number of lines of one product and of one order, and the limits that choose how to sum over them."""

    by_product: int
    by_order: int
    window_rows: int | None
    block: int | None


def _groups(lines: DataFrame, window_rows: int | None, block: int | None) -> Groups:
    # Every later table has at most the lines' rows per product and per order, so this is counted once.
    return Groups(largest_group(lines, ["product_id"]), largest_group(lines, ["rank"]), window_rows, block)


def _sums_by_product(df: DataFrame, sums: dict[str, Column], groups: Groups) -> DataFrame:
    return sums_before(df, ["product_id"], "rank", sums, groups.window_rows, groups.block, groups.by_product)


class Admission(NamedTuple):
    orders: DataFrame  # order_id, rank, accepted, reason, product_id, available
    products: DataFrame  # product_id, taken: stock used by the accepted orders (negative: given back)
    claims: DataFrame  # rank, product_id, take of the accepted orders
    groups: Groups


def _step(state: DataFrame, groups: Groups) -> DataFrame:
    """One round over rows that are open, in (not yet taken off later stock), done (taken off) or out."""
    take, open_row, new = F.col("take"), F.col("state") == "open", F.col("state") == "in"
    bounded = _sums_by_product(
        state,
        {
            "spent": F.when(new, take),
            "up": F.when(open_row & (take > 0), take),
            "down": F.when(open_row & (take < 0), -take),
        },
        groups,
    )
    base = F.when(open_row, F.col("base") - F.col("spent")).otherwise(F.col("base"))
    judged = bounded.withColumn("base", base).withColumns({
        "_out": open_row & (F.col("need") > F.col("base") + F.col("down")),
        "_in": open_row & (F.col("need") <= F.col("base") - F.col("up")),
    })
    decided = with_group(
        judged, ["rank"], {"_any_out": F.bool_or("_out"), "_all_in": F.bool_and("_in")}, groups.window_rows, groups.by_order
    )
    now = (
        F.when(new, "done")
        .when(open_row & F.col("_any_out"), "out")
        .when(open_row & F.col("_all_in"), "in")
        .otherwise(F.col("state"))
    )
    return decided.select("rank", "product_id", "take", "need", "base", now.alias("state"))


def _settle(claims: DataFrame, groups: Groups) -> DataFrame:
    """rank, accepted for the orders of `claims` (rank, product_id, take, need, base), a written table.

    The rows of an order share one state, and settled rows leave the table, so later rounds get smaller. Every round is
    written, by state, and the rows that went on are taken from the round before: each row is there twice at most,
    however many rounds there are, and the shuffles of a round are all that is needed besides.
    """
    spark = claims.sparkSession
    root = fresh_path(spark, "admission")
    state = claims.select("rank", "product_id", "take", "need", "base", F.lit("open").alias("state"))
    schema = state.schema
    paths: list[str] = []
    while not state.where("state = 'open'").isEmpty():
        paths.append(f"{root}/round={len(paths)}")
        with shuffles_dropped(spark):
            _step(state, groups).write.partitionBy("state").parquet(paths[-1])
        for gone in [f"{path}/state={name}" for path in paths[-2:-1] for name in ("open", "in")]:
            remove(spark, gone)
        state = spark.read.schema(schema).parquet(paths[-1]).where("state IN ('open', 'in')")
    if not paths:
        return claims.select("rank", F.lit(True).alias("accepted")).limit(0)
    settled = spark.read.schema(schema).parquet(root)
    return settled.select("rank", (F.col("state") != "out").alias("accepted")).distinct()


def _admit(
    orders: DataFrame, lines: DataFrame, live: DataFrame, products: DataFrame, refused: DataFrame, groups: Groups
) -> Admission:
    """`lines` have rank, pos, product_id, unknown, ask (what the line tests), earlier (asked before it by its order).

    `live`, a written table, has rank, product_id, take, need, asked of the other ranks than `refused`, which are out
    whatever the stock. Every step that moves all lines is written on its own, so their shuffles never add up.
    """
    # A product whose stock covers all that is asked of it never turns anyone away.
    asked = live.groupBy("product_id").agg(F.sum("asked").alias("_asked"))
    tight = products.select(F.col("id").alias("product_id"), F.col("stock").cast("bigint").alias("base"))
    tight = materialise(tight.join(asked, "product_id").where("_asked > base").drop("_asked"), "tight")
    contended = materialise(live.drop("asked").join(tight, "product_id"), "contended")
    settled = materialise(_settle(contended, groups), "settled")

    lost = settled.where("NOT accepted").select("rank")
    losers = refused.select("rank").unionByName(lost)
    claims = live.join(lost, "rank", "left_anti").select("rank", "product_id", "take")

    # The stock each refused order met, to name the first line that failed: one of a tight or unknown product.
    tests = lines.join(losers, "rank").join(tight, "product_id", "left").where("unknown OR base IS NOT NULL")
    tests = materialise(tests.select("rank", "pos", "product_id", "unknown", "ask", "earlier", "base"), "tests")
    at = tests.where("NOT unknown").select("rank", "product_id", "base", F.lit(0).cast("bigint").alias("take")).distinct()
    both = at.unionByName(
        contended.join(lost, "rank", "left_anti").select("rank", "product_id", "base", "take")
    )
    met = _sums_by_product(both, {"spent": F.col("take")}, groups).select(
        "rank", "product_id", (F.col("base") - F.col("spent")).alias("available")
    )
    failing = tests.join(met, ["rank", "product_id"], "left").where(
        F.col("unknown") | (F.col("ask") > F.col("available"))
    )
    reason = F.when(F.col("unknown"), "unknown product").otherwise("stock").alias("reason")
    left = (F.col("available") - F.col("earlier")).alias("available")
    first = failing.groupBy("rank").agg(
        F.min_by(F.struct(reason, "product_id", left), "pos").alias("_first")
    ).select("rank", "_first.*")

    out = losers.withColumn("_out", F.lit(True))
    result = orders.join(out, "rank", "left").join(first, "rank", "left").select(
        "order_id", "rank", F.col("_out").isNull().alias("accepted"),
        F.when(F.col("_out"), F.coalesce("reason", F.lit("no items"))).alias("reason"), "product_id", "available",
    )
    taken = claims.groupBy("product_id").agg(F.sum("take").alias("taken"))
    return Admission(result, taken, claims, groups)


def order_ranks(orders: DataFrame) -> DataFrame:
    """order_id, rank: the order in which a batch is served, undated orders last."""
    heads = orders.select(F.col("id").alias("order_id"), "created_at")
    placed = positions(heads, [F.col("created_at").asc_nulls_last(), F.col("order_id").asc()], "rank")
    return placed.select("order_id", "rank")


def admit_orders(
    orders: DataFrame, lines: DataFrame, products: DataFrame, window_rows: int | None = None, block: int | None = None
) -> Admission:
    """Place `orders` (id, created_at) with their decoded lines.

    An order is out if it has no line, names an unknown product, or any single line asks more than the stock before
    it; repeated lines of a product are each tested alone, so they may take the stock below zero.
    """
    ranks = order_ranks(orders)
    stock = products.select(F.col("id").alias("product_id"), F.col("stock").cast("bigint").alias("stock"))
    asked = normalise_items(lines).join(ranks, "order_id").select("rank", "pos", "product_id", "qty")
    known = materialise(asked.join(stock, "product_id", "left"), "lines")
    empty = ranks.join(known.select("rank").distinct(), "rank", "left_anti").select("rank")
    refused = known.where("stock IS NULL").select("rank").distinct().unionByName(empty)
    qty = F.col("qty")
    steps = known.where("stock IS NOT NULL").groupBy("rank", "product_id").agg(
        F.sum(qty).alias("take"), F.max(qty).alias("need"), F.sum(F.greatest(qty, F.lit(0))).alias("asked")
    )
    live = materialise(steps.join(refused, "rank", "left_anti"), "asked")
    tests = known.select(
        "rank", "pos", "product_id", F.col("stock").isNull().alias("unknown"), qty.alias("ask"),
        F.lit(0).cast("bigint").alias("earlier"),
    )
    return _admit(ranks, tests, live, products, refused, _groups(known, window_rows, block))


def amend_orders(
    amendments: DataFrame, new_lines: DataFrame, old_lines: DataFrame, products: DataFrame,
    window_rows: int | None = None, block: int | None = None,
) -> Admission:
    """Replace the contents of `amendments` (id, created_at: one per order) by their new lines.

    Every line asks for its increase over the order's last old line of that product, after the lines before it; the
    whole amendment is out at the first line the stock cannot meet. Unknown products are skipped, and products that
    the new lines drop give nothing back.
    """
    ranks = order_ranks(amendments)
    # At most so many lines of one order, old and new; a bound is all that is needed.
    by_order = largest_group(new_lines, ["order_id"]) + largest_group(old_lines, ["order_id"])
    # Old and new lines are dealt by order alone, once: the joins and all sums of an order's lines of a product keep
    # that. Lines of unknown or no products share none of these sums; the joins by product leave them out later, where
    # leaving them out sooner would decode every line twice.
    keys = ["order_id", "product_id"]
    asked = reduce(DataFrame.unionByName, [
        normalise_items(lines, amend=True).join(ranks, "order_id").select(
            "rank", *keys, "pos", "qty", F.lit(is_old).alias("is_old")
        )
        for lines, is_old in ((new_lines, False), (old_lines, True))
    ])
    held = {"held": F.max_by("qty", F.when(F.col("is_old"), F.col("pos")))}
    asked = with_group(asked, keys, held, window_rows, by_order).where("NOT is_old").select(
        "rank", *keys, "pos", (F.col("qty") - F.coalesce("held", F.lit(0))).alias("diff")
    )
    asked = sums_before(asked, keys, "pos", {"earlier": F.col("diff")}, window_rows, block, by_order)
    asked = asked.withColumn("ask", F.col("earlier") + F.col("diff"))
    totals = {
        "take": F.sum("diff"), "need": F.max("ask"), "asked": F.sum(F.greatest(F.col("diff"), F.lit(0))),
        "last": F.max("pos"),
    }
    last = F.col("pos") == F.col("last")  # the line that stands for the order's claim on the product
    asked = with_group(asked, keys, totals, window_rows, by_order).select(
        "rank", "pos", "product_id", "earlier", "ask", *[F.when(last, F.col(c)).alias(c) for c in ("take", "need", "asked")]
    )
    asked = materialise(asked, "lines")
    tests = asked.select("rank", "pos", "product_id", F.lit(False).alias("unknown"), "ask", "earlier")
    live = asked.where("take IS NOT NULL").select("rank", "product_id", "take", "need", "asked")
    groups = Groups(largest_group(asked, ["product_id"]), by_order, window_rows, block)
    admission = _admit(ranks, tests, live, products, ranks.select("rank").limit(0), groups)
    known = products.select(F.col("id").alias("product_id"))
    return admission._replace(
        products=admission.products.join(known, "product_id", "left_semi"),
        claims=admission.claims.join(known, "product_id", "left_semi"),
    )


def stock_after(products: DataFrame, admission: Admission) -> DataFrame:
    """The product table after the accepted orders."""
    taken = admission.products.withColumnRenamed("product_id", "id")
    left = F.col("stock") - F.coalesce("taken", F.lit(0))
    return products.join(taken, "id", "left").withColumn("stock", left.cast("int")).select(*products.columns)


def _numbered(requests: DataFrame, admission: Admission, orders: DataFrame, now) -> DataFrame:
    """The accepted requests as order rows with new `id`s, besides `order_id` (of the request) and `rank`."""
    won = admission.orders.where("accepted").select("order_id", "rank")
    numbered = fresh_ids(
        normalise_orders(requests, now).withColumnRenamed("id", "order_id").join(won, "order_id"),
        orders, [F.col("rank").asc()],
    )
    return materialise(numbered, "placed")


def place_orders(
    requests: DataFrame, lines: DataFrame, products: DataFrame, images: DataFrame, orders: DataFrame, now,
    window_rows: int | None = None, block: int | None = None,
) -> tuple[DataFrame, DataFrame, Admission]:
    """New order rows, their enriched lines, and the admission.

    New ids count on from `orders` in serving order. `remaining_stock` is what was left right after each order.
    """
    admission = admit_orders(requests, lines, products, window_rows, block)
    admission = admission._replace(orders=materialise(admission.orders, "verdicts"))
    placed = _numbered(requests, admission, orders, now)
    left = _sums_by_product(admission.claims, {"earlier": F.col("take")}, admission.groups).select("rank", "product_id", (F.col("earlier") + F.col("take")).alias("used"))
    ids = placed.select("order_id", "id", "rank")
    detail = item_detail(normalise_items(lines).join(ids.select("order_id"), "order_id", "left_semi"), products, images)
    detail = detail.join(ids, "order_id").join(left, ["rank", "product_id"], "left")
    detail = detail.withColumn("remaining_stock", F.col("remaining_stock") - F.coalesce("used", F.lit(0)))
    return placed.drop("order_id", "rank"), detail.drop("order_id", "rank", "used", "known"), admission


class After(NamedTuple):
    """The tables after a batch."""

    orders: DataFrame
    lines: DataFrame  # decoded lines by order_id and pos
    products: DataFrame
    refused: DataFrame  # order_id (of the batch), reason, product_id, available


def _after(orders: DataFrame, lines: DataFrame, products: DataFrame, admission: Admission) -> After:
    refused = admission.orders.where("NOT accepted").select("order_id", "reason", "product_id", "available")
    return After(orders, lines, stock_after(products, admission), refused)


def place_after(
    requests: DataFrame, lines: DataFrame, products: DataFrame, orders: DataFrame, old_lines: DataFrame, now,
    window_rows: int | None = None, block: int | None = None,
) -> After:
    """The tables after `requests` are placed: accepted ones follow the orders under new ids, with their lines as sent."""
    admission = admit_orders(requests, lines, products, window_rows, block)
    admission = admission._replace(orders=materialise(admission.orders, "verdicts"))
    placed = _numbered(requests, admission, orders, now)
    sent = lines.join(placed.select("order_id", F.col("id").alias("_id")), "order_id").drop("order_id")
    return _after(
        orders.unionByName(placed.drop("order_id", "rank"), allowMissingColumns=True),
        old_lines.unionByName(sent.withColumnRenamed("_id", "order_id")), products, admission,
    )


AMENDED = ["user_id", "status", "active", "delivery_cost", "voucher_id"]  # replaced as sent, nulls too


def amend_after(
    amendments: DataFrame, new_lines: DataFrame, old_lines: DataFrame, products: DataFrame, orders: DataFrame,
    window_rows: int | None = None, block: int | None = None,
    decode: Callable[[DataFrame], DataFrame] = lambda lines: lines,
) -> After:
    """The tables after `amendments`: accepted ones replace `AMENDED` and all lines of their order, if it is there.

    Lines as they are stored come with the function that decodes them: of the tables after it, only what stays is.
    """
    with scratch(orders.sparkSession):
        admission = amend_orders(amendments, decode(new_lines), decode(old_lines), products, window_rows, block)
        admission = admission._replace(
            orders=materialise(admission.orders, "verdicts", lasting=True),
            products=materialise(admission.products, "taken", lasting=True),
        )
        won = admission.orders.where("accepted").select("order_id")
        sent = amendments.withColumnRenamed("id", "order_id").join(won, "order_id").select(
            F.col("order_id").alias("id"), F.struct(*[c for c in AMENDED if c in amendments.columns]).alias("_sent")
        )
        replaced = {
            c: F.when(F.col("_sent").isNotNull(), F.col(f"_sent.{c}")).otherwise(F.col(c) if c in orders.columns else None)
            for c in AMENDED if c in amendments.columns
        }
        joined = orders.join(sent, "id", "left").withColumns(replaced)
        # Written, so that only the lines are still shuffled when the result is read.
        joined = materialise(
            joined.withColumn("_changed", F.col("_sent").isNotNull()).drop("_sent"), "orders", lasting=True
        )
    changed = joined.where("_changed").select(F.col("id").alias("order_id"), "_changed").distinct()
    # One join of old and new lines: a semi join of the new ones alone would filter them first, and tables that both
    # come from would be shuffled twice.
    either = old_lines.withColumn("_new", F.lit(False)).unionByName(new_lines.withColumn("_new", F.lit(True)))
    now = either.join(changed, "order_id", "left").where(F.col("_new") == F.coalesce("_changed", F.lit(False)))
    return _after(joined.drop("_changed"), decode(now.drop("_new", "_changed")), products, admission)
