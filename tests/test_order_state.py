"""Orders, lines and stock after a batch, by hand."""

from pyspark.sql import functions as F

from vitrine.operators import admission

from .conftest import rows

ORDER = "id long, user_id long, status string, created_at timestamp_ntz, active boolean, delivery_cost decimal(12,2)"
LINE = (
    "order_id long, pos long, product_id long, id long, quantity long, qty long, selected_option string, name string, "
    "price double, stock long"
)


def tables(spark, sent):
    """Products 1 and 2 with 10 and 5 in stock, orders 1 to 3 with two of product 1 each, and the lines of a batch."""
    def lines(found):
        return spark.createDataFrame([(o, k, p, None, None, q, None, None, None, None) for o, k, p, q in found], LINE)

    products = spark.createDataFrame([(1, 10), (2, 5)], "id long, stock int")
    old = lines([(o, 1, 1, 2) for o in (1, 2, 3)])
    orders = spark.createDataFrame([(o, 7, "Created", None, True, None) for o in (1, 2, 3)], ORDER)
    return orders.withColumn("voucher_code", F.lit("V")), old, lines(sent), products


def requests(spark, ids):
    batch = spark.createDataFrame([(o, None, "Accepted" if o % 2 else None, None, None, None) for o in ids], ORDER)
    return batch.withColumn("voucher_id", F.lit(4).cast("long"))


def test_amended_orders_replace_lines_and_fields_and_move_stock(spark):
    sent = [(1, 1, 2, 4), (1, 2, 99, 1), (2, 1, 2, 3), (4, 1, 1, 6)]  # 1 fits, 2 does not, 4 is in no table, 3 is not sent
    orders, old, new, products = tables(spark, sent)
    after = admission.amend_after(requests(spark, [1, 2, 4]), new, old, products, orders)
    assert rows(after.orders, "id", "user_id", "status", "active", "voucher_id", "voucher_code") == [
        (1, None, "Accepted", None, 4, "V"), (2, 7, "Created", True, None, "V"), (3, 7, "Created", True, None, "V"),
    ]
    assert rows(after.lines, "order_id", "pos", "product_id", "qty") == [(1, 1, 2, 4), (1, 2, 99, 1), (2, 1, 1, 2), (3, 1, 1, 2)]
    assert rows(after.products) == [(1, 4), (2, 1)]
    assert rows(after.refused) == [(2, "stock", 2, 1)]


def test_placed_orders_follow_the_others_and_take_stock(spark):
    sent = [(1, 1, 1, 8), (2, 1, 1, 3), (3, 1, 2, 5), (5, 1, 9, 1)]
    orders, old, new, products = tables(spark, sent)
    now = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    after = admission.place_after(requests(spark, [1, 2, 3, 4, 5]), new, products, orders, old, now)
    assert rows(after.orders, "id", "user_id", "status", "active", "voucher_id", "voucher_code") == [
        *[(o, 7, "Created", True, None, "V") for o in (1, 2, 3)], *[(o, None, "Accepted", True, 4, None) for o in (4, 5)],
    ]
    assert rows(after.lines, "order_id", "product_id", "qty") == [(1, 1, 2), (2, 1, 2), (3, 1, 2), (4, 1, 8), (5, 2, 5)]
    assert rows(after.products) == [(1, 2), (2, 0)]
    assert rows(after.refused) == [(2, "stock", 1, 2), (4, "no items", None, None), (5, "unknown product", 9, None)]
