import math
import random
import re
from collections import Counter

import numpy as np

from vitrine.llm import lexical

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(items, docs, top=10):
    own = [(d, Counter(TERM.findall((t or "").translate(LOWER)))) for d, t in docs]
    own = [(d, c, c.total()) for d, c in own if c]
    n_docs, total = len(own), sum(n for _, _, n in own)
    df = Counter(t for _, c, _ in own for t in c)
    asked = {}
    for item, text in items:
        asked.setdefault(item, Counter()).update(TERM.findall((text or "").translate(LOWER)))
    out = []
    for item, wanted in asked.items():
        scored = []
        for d, c, n in own:
            m = 25 + 75 * n * n_docs // total
            score = sum(
                k * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
                for t, k in wanted.items())
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        out += [(item, k, d, -s) for k, (s, _, _, d) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out, key=str)


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_against_brute_force_with_ties_nulls_and_blocks(spark):
    draw = random.Random(3)
    words = [f"w{k}" for k in range(300)] + ["É", "été", "ärger"]
    docs = [(k, " ".join(draw.choices(words, k=draw.choice([1, 5, 40, 200])))) for k in range(400)]
    docs += [(1000 + k, "w1 w2, W3-w3") for k in range(60)]  # ties
    docs += [(None, "w1 w2 w3 w3"), (7, docs[7][1]), (500, None), (501, ""), (502, " -- "), (503, "w5 " * 20_000)]
    items = [(k, " ".join(draw.choices(words, k=12))) for k in range(30)]
    items += [(40, "w1 w2 w3 w3"), (41, None), (42, "?!"), (43, "unheard of"), (None, "w9 w10"), (5, "w11 W11")]
    schema = "doc_id long, text string, item_id long, terms string"
    d = table(spark, [(*r, 1, "x") for r in docs], schema)
    i = table(spark, [(*r, 1) for r in items], "item_id long, text string, doc_id long")
    want = brute(items, docs)
    got = lexical.search(i, d)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == want
    assert sorted(map(tuple, lexical.search(i, d, item_terms=60).collect()), key=str) == want
    assert lexical.search(i.limit(0), d).count() == 0 and lexical.search(i, d.limit(0)).count() == 0


def test_buckets_prune_and_stay_exact():
    draw = np.random.default_rng(4)
    vocabulary, n = 400, 3000
    weight = draw.integers(500, 9000, vocabulary)
    rows = [np.sort(draw.choice(vocabulary, draw.integers(1, 30), replace=False)) for _ in range(n)]
    values = [draw.integers(1, 900_000, len(r)) // draw.choice([1, 4, 40]) + 1 for r in rows]
    items = lexical.Items(list(range(20)), [np.sort(draw.choice(vocabulary, 8, replace=False)) for _ in range(20)],
                          [np.ones(8, dtype=np.int64)] * 20, {})
    for j in range(20):  # documents that hold an item's terms, so that thresholds rise
        for c in range(12):
            rows[j * 12 + c], values[j * 12 + c] = items.terms[j], np.full(8, 950_000 - c)
    lengths = np.array([math.sqrt(float((weight[r] * (v.astype(float) ** 2)).sum())) for r, v in zip(rows, values)])
    order = np.argsort(-lengths)
    ranking = lexical.Ranking(items, weight, np.zeros(20), 10)
    for at in range(0, n, 128):
        own = order[at : at + 128]
        starts = np.concatenate([[0], np.cumsum([len(rows[k]) for k in own])])
        ranking.add(list(map(int, own)), starts, np.concatenate([rows[k] for k in own]).astype(np.int32),
                    np.concatenate([values[k] for k in own]), lengths[own])
    for j in range(20):
        gain = np.zeros(vocabulary, dtype=np.int64)
        gain[items.terms[j]] = weight[items.terms[j]]
        scores = [(-int((gain[r] * v).sum()), k) for k, (r, v) in enumerate(zip(rows, values))]
        assert ranking.best[j] == [(-s, k) for s, k in sorted(scores)[:10] if s]
    assert ranking.scored < 20 * n / 4  # most vectors are never rescored
