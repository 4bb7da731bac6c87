import numpy as np

from vitrine.llm import permutations
from vitrine.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.1"


def test_recall_and_exact_scores(spark):
    table = spark.read.parquet(f"{FOLDER}/embeddings.parquet").toPandas()
    ids, vectors = table["vec_id"].to_numpy(), np.array(table["embedding"].tolist(), dtype=float)
    row = {k: v for k, v in zip(ids, vectors)}
    rows = QUERIES["op4_permutation_index"](spark, FOLDER).collect()
    found = {}
    for r in rows:
        assert abs(r["score"] - float(row[r["query_id"]] @ row[r["vec_id"]])) < 1e-12 and r["query_id"] != r["vec_id"]
        found.setdefault(r["query_id"], []).append((r["rank"], -r["score"], r["vec_id"]))
    asked = ids[ids % 20 == 0]
    assert set(found) == set(asked.tolist())
    hits = 0
    for query in asked.tolist():
        own = sorted(found[query])
        assert [x[0] for x in own] == list(range(1, 21)) and [x[1:] for x in own] == sorted(x[1:] for x in own)
        score = vectors @ row[query]
        score[ids == query] = -np.inf
        hits += len(set(ids[np.lexsort((ids, -score))[:20]].tolist()) & {x[2] for x in own})
    assert hits >= 0.9 * 20 * len(asked)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(k, [1.0, float(k % 3)]) for k in range(60)] + [
        (100, None), (120, [0.0, 0.0]), (140, [nan, 1.0]), (160, [inf, 1.0]), (180, [None, 1.0]), (200, [1.0]), (None, [1.0, 1.0]),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 rank", "2 v")
    got = permutations.search(df, df.where("vec_id % 20 = 0"), index_block=16, query_block=2).collect()
    by = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        by.setdefault(r["query_id"], []).append(r["vec_id"])
    assert set(by) == {0, 20, 40}
    for query, near in by.items():
        best = sorted((-(1 + (k % 3) * (query % 3)), k) for k in range(60) if k != query)[:20]
        assert near == [k for _, k in best]
    assert permutations.search(df.where("false"), df).count() == 0
    assert permutations.search(df.where("vec_id < 3"), df.where("vec_id < 3")).count() == 6
