"""Batch admission against a plain one-by-one replay of the orders."""

import json
import os
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from vitrine.functions.jsonio import decode_items, decode_lines
from vitrine.operators import admission
from vitrine.plans.queries import QUERIES
from vitrine.storage import materialise, shared_folder, shuffles_dropped

from .conftest import SMALL, rows


def product_of(item):
    return item.get("product_id") or item.get("id")


def replay_create(orders, stock):
    """orders: (order_id, items) in serving order. Returns verdicts and the stock afterwards."""
    stock, verdicts = dict(stock), {}
    for order_id, items in orders:
        verdict = (True, None, None, None) if items else (False, "no items", None, None)
        for it in items:
            pid, qty = product_of(it), it.get("quantity") or it.get("qty") or 1
            if pid not in stock:
                verdict = (False, "unknown product", pid, None)
                break
            if qty > stock[pid]:
                verdict = (False, "stock", pid, stock[pid])
                break
        if verdict[0]:
            for it in items:
                stock[product_of(it)] -= it.get("quantity") or it.get("qty") or 1
        verdicts[order_id] = verdict
    return verdicts, stock


def replay_amend(amendments, old_items, stock):
    stock, verdicts = dict(stock), {}
    for order_id, items in amendments:
        old = {product_of(i): i.get("qty") or i.get("quantity") or 0 for i in old_items.get(order_id, []) if product_of(i)}
        trial, verdict = dict(stock), (True, None, None, None)
        for it in items:
            pid, qty = product_of(it), it.get("qty") or it.get("quantity") or 0
            if pid not in trial:
                continue
            if qty > trial[pid] + old.get(pid, 0):
                verdict = (False, "stock", pid, trial[pid])
                break
            trial[pid] -= qty - old.get(pid, 0)
        if verdict[0]:
            stock = trial
        verdicts[order_id] = verdict
    return verdicts, stock


def random_items(rng, products):
    def item():
        it = {rng.choice(["product_id", "id"]): rng.randint(1, products + 1)}
        if rng.random() < 0.8:
            it[rng.choice(["qty", "quantity"])] = rng.choice([-3, -1, 0, 1, 2, 3, 5, 8])
        if rng.random() < 0.1:
            it["product_id"] = 0
        return it

    return [item() for _ in range(rng.choice([0, 1, 1, 2, 3, 4]))]


def case(seed, orders=30, products=5):
    rng = random.Random(seed)
    stock = {p: rng.choice([-2, 0, 3, 10, 25, 60]) for p in range(1, products + 1)}
    batch = [(i + 1, rng.choice([None, rng.randint(0, 9)]), random_items(rng, products)) for i in range(orders)]
    old = {i + 1: random_items(rng, products) for i in range(orders) if rng.random() < 0.8}
    served = sorted(batch, key=lambda o: (o[1] is None, o[1], o[0]) if o[1] is not None else (True, 0, o[0]))
    return stock, batch, old, [(o[0], o[2]) for o in served]


def frames(spark, stock, batch, old):
    products = spark.createDataFrame(list(stock.items()), "id bigint, stock int")
    head = spark.createDataFrame([(o, None if t is None else t) for o, t, _ in batch], "id bigint, t int")
    head = head.select("id", F.timestamp_seconds("t").cast("timestamp_ntz").alias("created_at"))
    new = spark.createDataFrame([(o, json.dumps(i)) for o, _, i in batch], "id bigint, items string")
    held = spark.createDataFrame([(o, json.dumps(i)) for o, i in old.items()], "id bigint, items string")
    return products, head, decode_items(new), decode_items(held)


def verdicts_of(admitted):
    return {
        r.order_id: (r.accepted, r.reason, r.product_id, r.available) for r in admitted.orders.collect()
    }


def stock_of(products, admitted):
    return {r.id: r.stock for r in admission.stock_after(products, admitted).collect()}


@pytest.mark.parametrize("seed,limits", [(1, (None, None)), (3, (3, 5)), (4, (0, 2))])
def test_placing_equals_replay(spark, seed, limits):
    stock, batch, old, served = case(seed)
    products, head, lines, _ = frames(spark, stock, batch, old)
    admitted = admission.admit_orders(head, lines, products, *limits)
    verdicts, left = replay_create(served, stock)
    assert verdicts_of(admitted) == verdicts
    assert stock_of(products, admitted) == left


@pytest.mark.parametrize("seed,limits", [(5, (None, None)), (7, (3, 5)), (8, (0, 2))])
def test_amending_equals_replay(spark, seed, limits):
    stock, batch, old, served = case(seed)
    products, head, lines, held = frames(spark, stock, batch, old)
    admitted = admission.amend_orders(head, lines, held, products, *limits)
    verdicts, left = replay_amend(served, old, stock)
    assert verdicts_of(admitted) == verdicts
    assert stock_of(products, admitted) == left


def test_ample_stock_and_empty_batch(spark):
    stock, batch, old, _ = case(9, orders=10)
    products, head, lines, _ = frames(spark, {p: 10**6 for p in range(1, 9)}, batch, old)
    admitted = admission.admit_orders(head, lines, products)
    assert {v[1] for v in verdicts_of(admitted).values()} <= {None, "no items"}
    assert admission.admit_orders(head.limit(0), lines.limit(0), products).orders.count() == 0


def test_hot_products_keep_the_plan_flat(spark):
    rows = [(r, p, 1, 1, 5, "open") for r in range(20) for p in (1, 2)]
    state = spark.createDataFrame(rows, "rank bigint, product_id bigint, take bigint, need bigint, base bigint, state string")

    def three_steps(window_rows):
        groups, df = admission.Groups(20, 2, window_rows, 4), state
        for _ in range(3):
            df = admission._step(df, groups)
        plan = df._jdf.queryExecution().executedPlan().toString()
        return plan.count("Exchange "), plan.count("FileScan") + plan.count("Scan ExistingRDD"), sorted(df.collect())

    exchanges, scans, settled = three_steps(None)
    hot_exchanges, hot_scans, hot_settled = three_steps(1)
    assert hot_settled == settled
    assert hot_exchanges <= 2 * exchanges and hot_scans <= 2 * scans


def shared_tables(spark):
    return set(os.listdir(shared_folder(spark).removeprefix("file:")))


@pytest.mark.parametrize("seed,limits", [(5, (None, None)), (8, (0, 2))])
def test_amended_tables_leave_little_on_disk(spark, seed, limits):
    stock, batch, old, served = case(seed)
    products, head, _, _ = frames(spark, stock, batch, old)
    docs = [spark.createDataFrame([(o, p, json.dumps(x)) for o, items in found for p, x in enumerate(items, 1)],
                                  "order_id bigint, pos bigint, item_json string")
            for found in ([(o, i) for o, _, i in batch], old.items())]
    known = [o for o, _, _ in batch if o % 7]
    orders = spark.createDataFrame([(o, "Created") for o in known], "id bigint, status string")
    before, setting = shared_tables(spark), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    switch = spark.conf.get(setting)
    after = admission.amend_after(
        head.withColumn("status", F.lit("Accepted")), *docs, products, orders, *limits, decode=decode_lines
    )
    # What the result reads is all that stays; the lines, claims and rounds on the way are gone.
    assert sorted(name.split("-")[0] for name in shared_tables(spark) - before) == ["orders", "taken", "verdicts"]
    assert spark.conf.get(setting) == switch

    verdicts, left = replay_amend(served, old, stock)
    won = {o for o in known if verdicts[o][0]}
    assert {r.id: r.status for r in after.orders.collect()} == {o: "Accepted" if o in won else "Created" for o in known}
    assert {r.id: r.stock for r in after.products.collect()} == left
    assert {(r.order_id, r.reason, r.product_id, r.available) for r in after.refused.collect()} == {
        (o, *v[1:]) for o, v in verdicts.items() if not v[0]
    }
    held = {o: items for o, items in old.items() if o not in won} | {o: i for o, _, i in batch if o in won}
    assert rows(after.lines, "order_id", "pos", "product_id", "id", "qty", "quantity") == sorted(
        ((o, p, *[x.get(c) for c in ("product_id", "id", "qty", "quantity")]) for o, items in held.items()
         for p, x in enumerate(items, 1)),
        key=lambda t: tuple((v is None, str(v) if v is None else v) for v in t),
    )


def test_amended_lines_are_dealt_once(spark):
    df = QUERIES["order_amend_after"](spark, SMALL)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    lines = [x for x in plan.split("\n") if "Exchange hashpartitioning(order_id" in x and "Reused" not in x]
    # The lines of the orders, and the orders that changed.
    assert len(lines) <= 2 and plan.count("FileScan parquet [l_orderkey") == 1


def test_rounds_keep_every_claim_once(spark):
    # Order r waits for order r - 1, which takes the rest of their common product or not, so this takes many rounds.
    claims = [(r, p, 1, 1, 1) for r in range(12) for p in (r, r + 1)]
    df = spark.createDataFrame(claims, "rank bigint, product_id bigint, take bigint, need bigint, base bigint")
    before = shared_tables(spark)
    settled = admission._settle(df, admission.Groups(2, 2, None, None))
    assert {r.rank: r.accepted for r in settled.collect()} == {r: r % 2 == 0 for r in range(12)}
    (root,) = shared_tables(spark) - before
    written = spark.read.parquet(f"{shared_folder(spark)}/{root}")
    assert written.select("round").distinct().count() > 3
    assert rows(written, "rank", "product_id") == sorted((r, p) for r, p, *_ in claims)


def test_shuffle_files_go_with_their_action(spark):
    def held():
        return spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(" ")

    df = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    seen = set(re.findall(r"shuffle_\d+", held()))
    with shuffles_dropped(spark):
        assert materialise(df, "counted").count() == 7
        assert admission.largest_group(df, ["k"]) == 1
    for _ in range(50):  # executors are told, not waited for
        left = set(re.findall(r"shuffle_\d+", held())) - seen
        if not left:
            break
        time.sleep(0.1)
    assert not left
