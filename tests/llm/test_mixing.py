import re
from collections import defaultdict

import pytest

from vitrine.llm import mixing
from vitrine.llm.queries import QUERIES

from ..conftest import SMALL

WORD = re.compile("[^\x20\x09-\x0d]+")


def wanted(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weights = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    full, budget = {}, 1.5 * sum(sizes.values())
    while True:
        open_ = [s for s in names if s not in full]
        level = (budget - sum(full.values())) / sum(weights[s] for s in open_) if open_ else 0
        over = [s for s in open_ if weights[s] * level > 2 * sizes[s]]
        if not over:
            return {s: full.get(s, weights[s] * level) for s in names}
        full |= {s: 2.0 * sizes[s] for s in over}


def check(rows, docs):
    sizes, taken = defaultdict(int), defaultdict(int)
    for doc, source, text in docs:
        sizes[source] += len(WORD.findall(text or ""))
    goal = wanted(sizes)
    source_of = {d: s for d, s, _ in docs}
    assert len(rows) == len(docs)
    for r in rows:
        source = source_of[r["doc_id"]]
        assert r["source_size"] == sizes[source] and r["target"] == pytest.approx(goal[source])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[source] += r["taken"]
    for source, target in goal.items():
        assert abs(taken[source] - target) <= 1 + len(docs) * 0.01, (source, taken[source], target)


def test_query(spark):
    docs = [(r["doc_id"], r["source"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    rows = QUERIES["op7_hypergeometric_mix"](spark, SMALL).collect()
    check(rows, docs)
    assert {r["doc_id"]: r["size"] for r in rows} == {d: len(WORD.findall(t or "")) for d, _, t in docs}
    assert sorted(rows) == sorted(QUERIES["op7_hypergeometric_mix"](spark, SMALL).collect())


def test_odd_rows(spark):
    docs = [(k, ["a", "b", "B", None, "é", "empty"][k % 6], None if k % 6 == 5 else "w " * (k % 50)) for k in range(600)]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string").selectExpr("*", "1 size", "2 place")
    mixed = mixing.mix(df)
    check(mixed.collect(), docs)
    assert mixing.mix(df.where("false")).count() == 0
    assert mixing.mix(df.where("source = 'empty'")).agg({"taken": "sum"}).first()[0] == 0
    twice = mixing.mix(df.unionAll(df)).groupBy("doc_id").agg({"taken": "count"}).where("`count(taken)` <> 2").count()
    assert twice == 0


def test_shards_hold_the_quotas(spark):
    docs = [(k, "ab"[k % 3 == 0], "w " * 20) for k in range(3000)]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string")
    copies = mixing.mix(df, block_words=500, shard_words=12000).selectExpr("size", "explode(copies) c").select("size", "c.*")
    assert copies.where("shard is null").count() == 0
    shards = {r["shard"]: r["w"] for r in copies.groupBy("shard").agg({"words": "sum"}).withColumnRenamed("sum(words)", "w").collect()}
    assert len(shards) == 8 and max(shards.values()) < 1.5 * min(shards.values())
