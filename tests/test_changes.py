import random

import pytest
from pyspark.sql import functions as F

from vitrine.operators import catalog, changes, lookups, orders
from vitrine.plans.queries import as_of

from .conftest import rows


def test_update_nulls_missing_fields_and_reports_unknown(spark):
    table = spark.createDataFrame([(1, "a", 5), (2, "b", 6)], "id bigint, name string, stock int")
    batch = spark.createDataFrame([(2, 7, 1), (2, 8, 2), (3, 9, 1)], "id bigint, stock int, seq int")
    done = changes.apply_update(table, batch, ["name", "stock"], order=["seq"])
    assert rows(done.table) == [(1, "a", 5), (2, None, 8)]
    assert rows(done.rows) == [(2, None, 8)]
    assert rows(done.refused) == [(3,)]


def test_insert_and_delete(spark):
    table = spark.createDataFrame([(1, "a"), (5, "b")], "id bigint, name string")
    batch = spark.createDataFrame([("d",), ("c",)], "name string")
    assert rows(changes.apply_insert(table, batch, [F.col("name").asc()])) == [(1, "a"), (5, "b"), (6, "c"), (7, "d")]
    keys = spark.createDataFrame([(5,), (5,), (9,)], "id bigint")
    done = changes.apply_delete(table, keys)
    assert (rows(done.table), rows(done.rows), rows(done.refused)) == ([(1, "a")], [(5, "b")], [(9,)])
    assert rows(changes.apply_delete(table, keys.limit(0)).table) == rows(table)


def test_rating_upsert_one_after_another(spark):
    rng = random.Random(4)
    held = [(10 + i, i % 3, i % 2, 3) for i in range(5)]
    sent = [(s, rng.randint(0, 9), rng.randint(0, 4), rng.randint(0, 2), rng.randint(1, 5)) for s in range(40)]
    state, added, top = {(u, p): (i, v) for i, u, p, v in held}, set(), 14
    for s, t, u, p, v in sorted(sent, key=lambda r: (r[1], r[0])):
        if (u, p) not in state:
            top += 1
            added.add((u, p))
        state[(u, p)] = (state.get((u, p), (top,))[0], v)
    table = spark.createDataFrame(held, "id bigint, user_id bigint, product_id bigint, value int")
    batch = spark.createDataFrame(sent, "seq bigint, t int, user_id bigint, product_id bigint, value int")
    batch = batch.withColumn("ts", F.timestamp_seconds("t").cast("timestamp_ntz")).drop("t")
    done = changes.upsert_ratings(table, batch)
    assert rows(done.table, "user_id", "product_id", "id", "value") == sorted((*k, *v) for k, v in state.items())
    touched = {(u, p) for _, _, u, p, _ in sent}
    assert rows(done.rows, "user_id", "product_id", "outcome") == sorted(
        (*k, "added" if k in added else "updated") for k in touched
    )


def test_rating_summary_counts_users_not_rows(spark):
    table = spark.createDataFrame([(1, 1, 4), (1, 1, 5), (2, 1, 3)], "user_id bigint, product_id bigint, value int")
    assert rows(catalog.rating_summary(table)) == [(1, 4.0, 2)]
    assert rows(catalog.product_rating(table)) == [(1, 4.0, 3)]


def test_status_changes(spark):
    head = spark.createDataFrame([(1, 7, "Created"), (2, None, "Created")], "id bigint, user_id bigint, status string")
    users = spark.createDataFrame([(7, "n", "e", "u", "p")], "id bigint, name string, email string, user_name string, phone string")
    sent = spark.createDataFrame(
        [(1, 5, 1, "Shipping"), (2, 5, 1, "Delivered"), (3, 9, 1, "Cancelled"), (4, 1, 3, "Accepted"), (5, 1, 2, None)],
        "seq bigint, t int, order_id bigint, status string",
    ).withColumn("ts", F.timestamp_seconds("t").cast("timestamp_ntz")).drop("t")
    done = changes.update_status(head, sent, users)
    assert rows(done.table, "id", "status") == [(1, "Delivered"), (2, "Created")]
    assert rows(done.rows, "id", "user_name") == [(1, "n")]
    assert rows(done.refused, "seq") == [(3,), (4,), (5,)]


def test_vouchers(spark):
    vouchers = spark.createDataFrame(
        [(1, "A", True, 1), (2, "B", True, 0), (3, "C", False, 1), (4, "D", True, None)],
        "id bigint, code string, active boolean, days int",
    ).select("id", "code", "active", (as_of() + F.make_dt_interval(F.col("days"))).alias("expire_date"))
    held = spark.createDataFrame([(i, c) for i, c in enumerate("ABCDE")], "id bigint, voucher_code string")
    got = lookups.voucher_state_of_orders(held, vouchers, as_of())
    assert rows(got, "voucher_code", "voucher_state") == [
        ("A", "valid"), ("B", "expired"), ("C", "inactive"), ("D", "expired"), ("E", "unknown")
    ]
    codes = held.select(F.col("voucher_code").alias("code"))
    assert rows(lookups.voucher_by_code(vouchers, codes, as_of()), "code") == [("A",)]


@pytest.mark.parametrize("seed,window_rows", [(1, None), (2, None), (3, 0)])
def test_unique_accounts_one_after_another(spark, seed, window_rows):
    rng = random.Random(seed)
    names = [None, *"abcdefghij"]
    held = [("a", "j"), (None, "i")]
    sent = [(s, rng.choice(names), rng.choice(names)) for s in range(30)]
    users, mails, want = {"a"}, {"j", "i"}, []
    for s, u, m in sent:
        ok = u not in users and m not in mails
        want.append((s, ok))
        if ok:
            users |= {u} - {None}
            mails |= {m} - {None}
    accounts = spark.createDataFrame(held, "username string, email string")
    requests = spark.createDataFrame(sent, "seq bigint, username string, email string")
    got = lookups.validate_unique(requests, accounts, ["username", "email"], window_rows=window_rows)
    assert rows(got.select("seq", F.col("reject_reason").isNull())) == want


def test_a_long_chain_of_requests(spark):
    n, jobs = 3000, []
    tracker = spark.sparkContext.statusTracker()
    # Each shares its name with the one before and its mail with the one after: every second one is in.
    requests = spark.range(n).select(
        F.col("id").alias("seq"), F.concat(F.lit("u"), F.floor(F.col("id") / 2)).alias("username"),
        F.concat(F.lit("e"), F.floor((F.col("id") + 1) / 2)).alias("email"))
    accounts = spark.createDataFrame([("none", "none")], "username string, email string")
    spark.sparkContext.setJobGroup("chain", "chain")
    got = lookups.validate_unique(requests, accounts, ["username", "email"])
    jobs = len(tracker.getJobIdsForGroup("chain"))
    spark.sparkContext.setJobGroup("rest", "rest")
    assert rows(got.where("reject_reason IS NULL"), "seq") == [(k,) for k in range(0, n, 2)]
    assert jobs < 300


def test_voucher_types_on_create_and_update(spark):
    table = spark.createDataFrame([(1, "num"), (2, "gift"), (3, None), (4, "")], "id bigint, type string")
    assert rows(lookups.accepted(lookups.validate_voucher(table)), "id") == [(1,)]
    assert rows(lookups.accepted(lookups.validate_voucher(table, update=True)), "id") == [(1,), (3,), (4,)]


def test_catalog_filter_conditions(spark):
    table = spark.createDataFrame(
        [(1, "Red ring", 3, True), (2, "ring", 4, False), (3, "rang", 3, True)],
        "id bigint, name string, category_id int, active boolean",
    )
    ids = lambda **given: [r[0] for r in rows(lookups.catalog_filter(table, **given), "id")]
    assert ids() == [1, 3]
    assert ids(active_only=False) == [1, 2, 3]
    assert ids(search="RING", active_only=False) == [1, 2]
    assert ids(search="r_ng", category_id=3) == [1, 3]


def test_items_dedupe_keeps_the_first_of_product_and_option(spark):
    table = spark.createDataFrame(
        [(1, 1, 5, None, None), (1, 2, None, 5, ""), (1, 3, 5, 9, "L"), (1, 4, 0, 5, "L"), (2, 1, 5, None, None)],
        "order_id bigint, pos bigint, product_id bigint, id bigint, selected_option string",
    )
    assert rows(orders.dedupe_items(table), "order_id", "pos") == [(1, 1), (1, 3), (2, 1)]


def test_repeated_keys_and_codes_do_not_double_rows(spark):
    table = spark.createDataFrame([(1, "a"), (2, "b")], "id long, name string")
    batch = spark.createDataFrame([(1, "x"), (1, "y"), (9, "z")], "id long, name string")
    assert sorted(tuple(r) for r in changes.apply_update(table, batch, ["name"]).table.collect()) == [(1, "y"), (2, "b")]
    as_of = F.to_timestamp_ntz(F.lit("2020-01-01 00:00:00"))
    vouchers = spark.createDataFrame(
        [(1, "c", True, "2019-01-01"), (2, "c", True, "2021-01-01"), (3, "c", True, "2022-01-01")],
        "id long, code string, active boolean, d string",
    ).select("id", "code", "active", F.to_timestamp_ntz("d").alias("expire_date"))
    orders = spark.createDataFrame([(7, "c"), (8, "other")], "id long, voucher_code string")
    found = lookups.voucher_state_of_orders(orders, vouchers, as_of).collect()
    assert sorted((r["id"], r["voucher_id"], r["voucher_state"]) for r in found) == [(7, 2, "valid"), (8, None, "unknown")]
