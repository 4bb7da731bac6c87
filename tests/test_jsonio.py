from pyspark.sql import functions as F

from vitrine.functions import jsonio
from vitrine.functions.values import effective_price, or_else
from vitrine.operators import orders
from vitrine.plans.queries import as_of

from .conftest import rows


def test_items_of_odd_texts(spark):
    docs = spark.createDataFrame(
        [
            (1, '[{"product_id":"7","quantity":2,"selectedOption":"L"},{"id":8,"price":"1.50"},5]'),
            (2, "not json"), (3, '{"product_id":1}'), (4, None), (5, "[]"), (6, ' [{"product_id":0,"id":4}]'),
            (7, '\n\t[{"id":9,"quantity":3000000000}]'),
        ],
        "id bigint, items string",
    )
    lines = jsonio.decode_items(docs)
    assert rows(lines, "order_id", "pos", "product_id", "id", "quantity", "selected_option") == [
        (1, 1, 7, None, 2, "L"), (1, 2, None, 8, None, None), (1, 3, None, None, None, None), (6, 1, 0, 4, None, None),
        (7, 1, None, 9, 3000000000, None),
    ]
    assert rows(orders.item_products(lines)) == [(1, 7), (1, 8), (6, 4), (7, 9)]


def test_long_orders_are_one_document(spark):
    text = "[" + ",".join(f'{{"id":{k}}}' for k in range(3000)) + "]"
    lines = jsonio.decode_items(spark.createDataFrame([(1, text)], "id bigint, items string"))
    assert sorted((r["pos"], r["id"]) for r in lines.collect()) == [(k + 1, k) for k in range(3000)]


def test_kinds_of_map_elements(spark):
    maps = {
        1: '[1, 2.5, "a", true, null, {"x": 1}, [3]]', 2: "7", 3: "[]", 4: None, 5: "{broken", 6: '{"endDate":"d"}',
        7: '"word"', 8: "\n[1]", 9: "1,2", 10: "",
    }
    table = spark.createDataFrame(list(maps.items()), "id bigint, map string").selectExpr(
        "id", "'List' AS type", "1 AS priority", "map"
    )
    got = jsonio.decode_map(table)
    assert rows(got, "banner_id", "elem_pos", "kind", "elem", "malformed") == [
        (1, 1, "number", "1", False), (1, 2, "number", "2.5", False), (1, 3, "string", '"a"', False),
        (1, 4, "boolean", "true", False), (1, 5, "null", "null", False), (1, 6, "object", '{"x":1}', False),
        (1, 7, "array", "[3]", False), (2, 1, "number", "7", False), (3, None, None, None, False),
        (4, 1, "null", "null", False), (5, None, None, None, True), (6, 1, "object", '{"endDate":"d"}', False),
        (7, 1, "string", '"word"', False), (8, 1, "number", "1", False), (9, None, None, None, True),
        (10, None, None, None, True),
    ]


def test_related_ids(spark):
    table = spark.createDataFrame([(1, "[4,4,9]"), (2, "[]"), (3, None), (4, "oops")], "id bigint, related string")
    assert rows(jsonio.decode_related(table)) == [(1, 1, 4), (1, 2, 4), (1, 3, 9)]


def test_encoded_nulls_stay(spark):
    row = spark.range(1).select(jsonio.encode(F.struct(F.lit(None).cast("int").alias("a"), F.lit("x").alias("b"))))
    assert row.first()[0] == '{"a":null,"b":"x"}'


def test_falling_back(spark):
    values = spark.createDataFrame([(None, None), (0, ""), (5, "x")], "n int, s string")
    got = values.select(or_else(F.col("n"), 0, F.lit(9)).alias("n"), or_else(F.col("s"), "", F.lit("d")).alias("s"))
    assert rows(got) == [(5, "x"), (9, "d"), (9, "d")]
    prices = spark.createDataFrame([(None, None), (0, 3), (2, 3)], "e int, p int").selectExpr(
        "CAST(e AS decimal(12,2)) AS e", "CAST(p AS decimal(12,2)) AS p"
    )
    assert rows(prices.select(effective_price(F.col("e"), F.col("p")).cast("int"))) == [(0,), (2,), (3,)]


def test_quantities_when_placing_and_amending(spark):
    lines = spark.createDataFrame(
        [(1, 1, 5, None, 2, 3, None), (1, 2, 0, 6, 0, 4, None), (1, 3, None, None, None, None, "L")],
        "order_id bigint, pos bigint, product_id bigint, id bigint, quantity int, qty int, selected_option string",
    )
    assert rows(orders.normalise_items(lines), "pos", "product_id", "qty") == [(1, 5, 2), (2, 6, 4), (3, None, 1)]
    assert rows(orders.normalise_items(lines, amend=True), "pos", "product_id", "qty") == [
        (1, 5, 3), (2, 6, 4), (3, None, 0)
    ]


def test_order_defaults(spark):
    table = spark.createDataFrame(
        [(1, "", None, None, None, 0), (2, "Shipping", None, False, None, 8)],
        "id bigint, status string, created_at timestamp_ntz, active boolean, delivery_cost double, voucher_id bigint",
    )
    got = orders.normalise_orders(table, as_of())
    assert rows(got, "id", "status", "active", "delivery_cost", "voucher_id")[0][:3] == (1, "Created", True)
    assert rows(got, "id", "status", "active", "voucher_id")[1] == (2, "Shipping", False, 8)
    assert got.where("created_at IS NULL").count() == 0


def test_columns_as_they_are_stored(spark):
    table = spark.createDataFrame(
        [(1, [2, 2], (None, "L"), '{"kept": as it is'), (2, None, None, None), (3, [], (5, None), "")],
        "id bigint, related array<bigint>, line struct<qty:bigint,option:string>, map string",
    )
    got = jsonio.encode_columns(table, ["related", "line", "map"])
    assert [tuple(r) for r in got.orderBy("id").collect()] == [
        (1, "[2,2]", '{"qty":null,"option":"L"}', '{"kept": as it is'), (2, None, None, None),
        (3, "[]", '{"qty":5,"option":null}', ""),
    ]
