"""Image priorities against one-by-one replays, and the nested forms of images and links."""

import random

import pytest
from pyspark.sql import functions as F

from vitrine.operators import catalog, images

from .conftest import rows


def table(spark, seed=1, products=4):
    rng = random.Random(seed)
    data = [(i + 1, rng.randint(1, products), f"l{i}", rng.choice([None, 0, 1, 1, 2, 3])) for i in range(25)]
    return data, spark.createDataFrame(data, "id bigint, product_id bigint, link string, priority bigint")


def choices(spark, seed):
    rng = random.Random(seed)
    data = [(s, rng.randint(1, 27), rng.choice([1, 2, 2, 3])) for s in range(40)]
    return data, spark.createDataFrame(data, "seq bigint, image_id bigint, priority bigint")


@pytest.mark.parametrize("window_rows", [None, 3])
def test_primary_choices_one_after_another(spark, window_rows):
    data, df = table(spark)
    picks, picked = choices(spark, 2)
    state = {i: [p, v] for i, p, _, v in data}
    for _, chosen, _ in picks:
        if chosen in state:
            for i, (p, v) in state.items():
                if p == state[chosen][0] and i != chosen and v is not None:
                    state[i][1] = v + 1
            state[chosen][1] = 1
    got = images.set_primary(df, picked, window_rows)
    assert rows(got, "id", "priority") == [(i, v[1]) for i, v in sorted(state.items())]
    assert rows(images.unknown_images(df, picked)) == sorted({(c,) for _, c, _ in picks if c > 25})


def replayed(data, picks):
    """Moves to a place, one after another; a null value moves no other image."""
    state, products = {i: [p, v] for i, p, _, v in data}, {}
    for i, p, _, _ in data:
        products.setdefault(p, []).append(i)
    for _, chosen, to in sorted(picks, key=lambda c: (c[0], c[1], c[2] is not None, c[2] or 0)):
        if chosen in state and state[chosen][0] is not None:
            for i in products[state[chosen][0]]:
                v = state[i][1]
                if i != chosen and v is not None and to is not None and v >= to:
                    state[i][1] = v + 1
            state[chosen][1] = to
    return [(i, v[1]) for i, v in sorted(state.items())]


@pytest.mark.parametrize("seed,window_rows", [(3, None), (5, 3)])
def test_secondary_choices_one_after_another(spark, monkeypatch, seed, window_rows):
    monkeypatch.setattr(images, "LEVELS_PER_TABLE", 2)
    data, df = table(spark, seed)
    picks, picked = choices(spark, seed)
    rng = random.Random(seed)
    picks += [(rng.randint(0, 40), rng.randint(1, 27), rng.choice([None, -1, 0, 5, 9])) for _ in range(30)]  # ties in seq
    data.append((26, None, "x", 1))
    df = spark.createDataFrame(data, df.schema)
    picked = spark.createDataFrame(picks, picked.schema)
    assert rows(images.set_secondary(df, picked, window_rows), "id", "priority") == replayed(data, picks)


def test_many_moves_of_one_product(spark):
    rng = random.Random(9)
    data = [(k, 1, "l", rng.randint(0, 50)) for k in range(1, 300)] + [(400, 2, "m", 1), (401, 3, "n", None)]
    picks = [(s, rng.choice([1, 2, rng.randint(1, 299), 400]), rng.randint(0, 60)) for s in range(4000)]
    df = spark.createDataFrame(data, "id bigint, product_id bigint, link string, priority bigint")
    picked = spark.createDataFrame(picks, "seq bigint, image_id bigint, priority bigint")
    assert rows(images.set_secondary(df, picked), "id", "priority") == replayed(data, picks)


def test_no_choices_change_nothing(spark):
    _, df = table(spark)
    none = choices(spark, 1)[1].limit(0)
    for moved in (images.set_primary(df, none), images.set_secondary(df, none), images.set_priority(df, none)):
        assert rows(moved, *df.columns) == rows(df)


@pytest.mark.parametrize("window_rows", [None, 2])
def test_additions_one_after_another(spark, window_rows):
    data, df = table(spark)
    added = [(s, s % 6 + 1, f"n{s}") for s in range(20)]
    state = [(p, v) for _, p, _, v in data]
    want = []
    for s, p, _ in added:
        own = [v for q, v in state if q == p]
        top = max((v for v in own if v is not None), default=None)
        priority = (top or 1) + 1 if 1 in own else 1
        state.append((p, priority))
        want.append((s, priority))
    batch = spark.createDataFrame(added, "seq bigint, product_id bigint, link string")
    assert rows(images.next_priorities(df, batch, window_rows), "seq", "priority") == want
    assert images.add_images(df, batch).agg(F.max("id")).first()[0] == 45


def test_first_image_rules(spark):
    df = spark.createDataFrame(
        [(1, 1, "a", None), (2, 1, "b", 2), (3, 1, "c", 2), (4, 2, "d", None), (6, 3, "f", 1), (5, 3, "e", 1)],
        "id bigint, product_id bigint, link string, priority bigint",
    )
    assert rows(catalog.primary_image(df)) == [(1, "b"), (2, "d"), (3, "e")]
    assert rows(catalog.strict_primary_image(df)) == [(3, "e")]


def test_no_images_is_null_or_empty(spark):
    df = spark.createDataFrame(
        [(1, 1, "a", 2), (2, 1, "b", 1), (3, 1, "c", None)], "id bigint, product_id bigint, link string, priority bigint"
    )
    products = spark.createDataFrame([(1,), (2,)], "id bigint")
    nested = {r.id: r.images for r in catalog.images_nested(products, df).collect()}
    assert nested[2] is None and [tuple(i) for i in nested[1]] == [(2, "b", 1), (1, "a", 2), (3, "c", None)]
    assert rows(catalog.links_nested(products, df), "id", "links") == [(1, ["b", "a", "c"]), (2, [])]
    flat = catalog.images_counted(products, df)
    assert rows(flat, "id", "n_images", "image_pos", "image_link") == [
        (1, 3, 1, "b"), (1, 3, 2, "a"), (1, 3, 3, "c"), (2, 0, None, None)]
