from pyspark.sql import functions as F

from vitrine.operators import ranking

from .conftest import rows


def _numbers(spark, n=500):
    # A third of all rows share one key; some keys are null.
    key = F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 50 == 1, None).otherwise(F.col("id") % 11)
    return spark.range(n).select(
        key.alias("k"), (F.hash("id") % 40).cast("bigint").alias("v"), F.col("id"), (F.col("id") % 9 - 3).alias("x")
    ).repartition(6)


def test_positions_follow_the_order(spark):
    df = _numbers(spark)
    got = rows(ranking.positions(df, [F.col("v").desc(), F.col("id").asc()], "at"), "at", "v", "id")
    want = sorted([(r.v, r.id) for r in df.collect()], key=lambda t: (-t[0], t[1]))
    assert got == [(i, v, d) for i, (v, d) in enumerate(want)]


def test_spread_rank_is_the_window_rank(spark):
    df, order = _numbers(spark), [F.col("v").asc(), F.col("id").desc()]
    plain = ranking.ranked(df, ["k"], order, "n")
    spread = ranking.ranked(df, ["k"], order, "n", window_rows=5)
    assert rows(plain, "id", "k", "v", "n") == rows(spread, "id", "k", "v", "n")


def test_blocked_sums_are_the_window_sums(spark):
    df = _numbers(spark).where("k IS NOT NULL")
    sums = {"before": F.col("x"), "positive": F.when(F.col("x") > 0, F.col("x"))}
    plain = ranking.sums_before(df, ["k"], "id", sums)
    blocked = ranking.sums_before(df, ["k"], "id", sums, window_rows=5, block=16)
    assert rows(plain, "id", "before", "positive") == rows(blocked, "id", "before", "positive")


def test_group_values_by_join_and_by_window(spark):
    df = _numbers(spark).where("k IS NOT NULL")
    value = {"top": F.max("v")}
    assert rows(ranking.with_group(df, ["k"], value), "id", "top") == rows(
        ranking.with_group(df, ["k"], value, window_rows=1), "id", "top"
    )


def test_pages(spark, monkeypatch):
    df = spark.range(95).repartition(5)
    order = [F.col("id").desc()]
    page = ranking.paginate(df, order, page=2, limit=30)
    assert [r.id for r in page.collect()] == list(range(64, 34, -1))
    assert page.first().asDict() == {"id": 64, "page": 2, "limit": 30, "total": 95, "total_pages": 4}
    monkeypatch.setattr(ranking, "TOP_ROWS", 10)
    assert rows(ranking.paginate(df, order, page=4, limit=30)) == [(i, 4, 30, 95, 4) for i in range(5)]
    first = ranking.paginate(df, order, page=-1, limit=0)
    assert rows(first, "id") == [(i,) for i in range(85, 95)]
    assert rows(ranking.page_index(df, order, 30)) == [(i, (94 - i) // 30 + 1, (94 - i) % 30 + 1) for i in range(95)]
    ended = ranking.paginate(df, order, page=5, limit=30).collect()
    assert [tuple(r) for r in ended] == [(*[None] * len(df.columns), 5, 30, 95, 4)]
    empty = ranking.paginate(df.limit(0), order).collect()
    assert [tuple(r) for r in empty] == [(*[None] * len(df.columns), 1, 10, 0, 0)]


def test_fresh_ids_count_on(spark):
    table = spark.createDataFrame([(4, "a"), (9, "b")], "id bigint, name string")
    batch = spark.createDataFrame([("y",), ("x",)], "name string")
    assert rows(ranking.fresh_ids(batch, table, [F.col("name").asc()]), "id", "name") == [(10, "x"), (11, "y")]
    assert rows(ranking.fresh_ids(batch, table.limit(0), [F.col("name").asc()]), "id", "name") == [(1, "x"), (2, "y")]


def test_rows_with_null_keys_stay_in_large_groups(spark):
    df = spark.createDataFrame([(None, 1, 5), (None, 2, 6), ("a", 1, 7), ("a", 2, 8)], "k string, r int, v int")
    for rows_ in (2, 0):
        total = ranking.with_group(df, ["k"], {"t": F.sum("v")}, window_rows=rows_)
        assert sorted(r["t"] for r in total.collect()) == [11, 11, 15, 15]
        before = ranking.sums_before(df, ["k"], "r", {"b": F.col("v")}, window_rows=rows_, block=1)
        assert sorted(r["b"] for r in before.collect()) == [0, 0, 5, 7]
