import math
import random
import re
import zlib
from collections import Counter
from dataclasses import replace

import numpy as np

from vitrine.llm import maxent
from vitrine.llm.queries import QUERIES

from ..conftest import SMALL

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(docs):
    """held_out, n_tokens, n_known, train_tokens, base_score of each document, in order."""
    words = [[*WORD.findall((text or "").translate(LOWER)), None] for _, text in docs]
    fold = [None if d is None else zlib.crc32(str(d).encode()) % 5 for d, _ in docs]
    c = Counter(w for f, own in zip(fold, words) if f not in (None, 1) for w in own)
    n, v = c.total(), len(c)
    return [
        (f == 1, len(own), sum(c[w] > 0 for w in own), n, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own))
        for f, own in zip(fold, words)
    ], c


def one_by_one(model, c, text):
    """A text's score, token by token, from the weights."""
    words = [*(w.encode() for w in WORD.findall((text or "").translate(LOWER))), maxent.END]

    def hashed(word):
        k = model.words.get(word)
        return k if k is not None and k < maxent.HEAD else maxent.HEAD + zlib.crc32(word) % (0xFFFF - maxent.HEAD)

    total = 0.0
    for at, word in enumerate(words):
        one = hashed(words[at - 1]) if at else 0xFFFF
        two = hashed(words[at - 2]) if at > 1 else 0xFFFF
        rows = [one if one < maxent.HEAD else maxent.HEAD + one % (3072 - maxent.HEAD), 3072 + (two * 40503 >> 4) % 1024,
                4096 + (one * 1_000_003 + two * 8191 >> 3) % 4096]
        logits = model.class_bias + sum(model.class_rows[r].astype(float) for r in rows)
        rank = model.words.get(word)
        head = rank is not None and rank < maxent.HEAD
        cls = rank % maxent.HEAD_CLASSES if head else maxent.HEAD_CLASSES + maxent.tail_class(word)
        total += logits[cls] - math.log(np.exp(logits).sum())
        if head:
            rows = [((r * 37 + cls * 2_654_435) * 40_503 >> 7) % maxent.WORD_ROWS for r in rows[:1]]
            logits = model.word_bias[cls] + sum(model.word_rows[r].astype(float) for r in rows)
            total += logits[rank // maxent.HEAD_CLASSES] - math.log(np.exp(logits).sum())
        else:
            t = maxent.tail_class(word)
            n = model.tail_tokens[t]
            times = c[None if word == maxent.END else word.decode()]
            if times:
                total += math.log((times - model.discount[t]) / n)
            elif n:
                total += math.log(model.discount[t] * model.tail_words[t] / n)
    return total / math.log(10)


def test_query_against_plain_counts_and_token_by_token(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    want, _ = plain(docs)
    rows = {r["doc_id"]: r for r in QUERIES["op12_hashed_maxent"](spark, SMALL).collect()}
    assert len(rows) == len(docs)
    for (doc, _), (held, n, known, total, base) in zip(docs, want):
        r = rows[doc]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held, n, known, total)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9) and r["score"] < 0
    held = [r for r in rows.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_odd_rows_and_a_small_dictionary(spark):
    draw = random.Random(6)
    words = [f"w{k}" for k in range(3000)] + ["Été", "ÄRGER", "the.", "the"]
    docs = [(k, " ".join(draw.choices(words, weights=[3000 / (j + 1) for j in range(len(words))], k=draw.choice([0, 3, 80]))))
            for k in range(300)]
    docs += [(None, "w1 w2"), (5, None), (5, "w1 unseen unseen"), (400, "x" * 100_000), (401, "w1 " * 30_000)]
    table = spark.createDataFrame([(*r, 1, "z", 2) for r in docs], "doc_id long, text string, c long, word string, row int")
    want, c = plain(docs)
    model, counts = maxent.fit(table, dictionary=1200)
    assert 100 < len(model.words) <= 1200 < len(c) and np.abs(model.class_rows).sum() > 0
    got = maxent.score(table, model, counts).collect()
    key = lambda x: tuple(str(v) for v in x)
    assert sorted(((r["doc_id"], *r[1:5]) for r in got), key=key) == sorted(((d, *w[:4]) for (d, _), w in zip(docs, want)), key=key)
    own = {(d, t): one_by_one(model, c, t) for d, t in docs if (t or "") == "" or len(t) < 1000}
    scores = sorted(r["score"] for r in got if r["n_tokens"] < 1000 and r["doc_id"] != 400)
    assert np.allclose(scores, sorted(own.values()), rtol=1e-4)
    assert np.allclose(sorted(r["base_score"] for r in got), sorted(w[4] for w in want))
    empty = maxent.learn_and_score(table.limit(0))
    assert empty.count() == 0 and empty.columns[-1] == "score"
    unlearned = maxent.learn_and_score(table.where("doc_id is null")).collect()  # nothing to learn from
    assert [(r["n_tokens"], r["n_known"], r["train_tokens"]) for r in unlearned] == [(3, 0, 0)]
    assert math.isfinite(unlearned[0]["score"])


def test_probabilities_of_all_words_sum_to_one():
    draw = np.random.default_rng(7)
    size = maxent.HEAD + 500
    words = {f"w{k}".encode(): k for k in range(size)}
    counts = np.sort(draw.integers(1, 400, size))[::-1]
    tails = np.array([maxent.tail_class(w) for w in words])
    behind = np.arange(size) >= maxent.HEAD
    n, v = (np.bincount(tails[behind], w, maxent.TAIL_CLASSES) for w in (counts[behind], None))
    by_class = counts[: maxent.HEAD].reshape(maxent.PLACES, maxent.HEAD_CLASSES).T
    model = maxent.Model(
        words, counts, np.arange(size), tails, int(counts.sum()), size, n, v, np.full(maxent.TAIL_CLASSES, 0.4),
        draw.normal(size=maxent.CLASSES).astype(np.float32), draw.normal(size=(maxent.CLASS_ROWS, maxent.CLASSES)).astype(np.float32),
        np.log(by_class).astype(np.float32), draw.normal(size=(maxent.WORD_ROWS, maxent.PLACES)).astype(np.float32))
    for before in ([], [3], [7, 1200], [size - 1, 2]):
        codes = np.array([[*before, k] for k in range(size)]).ravel()
        inside = np.tile(np.arange(len(before) + 1), size)
        last = maxent.histories(model, codes, inside)[np.arange(len(before), len(codes), len(before) + 1)]
        each = maxent.log_probabilities(model, last)
        each[behind] += model.known(counts[behind], tails[behind]) * math.log(10)
        total = np.exp(each).sum()
        some = replace(last, features=[f[:1].repeat(maxent.TAIL_CLASSES) for f in last.features],
                       cls=maxent.HEAD_CLASSES + np.arange(maxent.TAIL_CLASSES), place=np.full(maxent.TAIL_CLASSES, -1))
        total += np.exp(maxent.log_probabilities(model, some) + model.unknown() * math.log(10)).sum()
        assert abs(total - 1) < 1e-4


def test_order_of_words_matters():
    """After steps over texts in which b follows a, the pair is likelier in that order."""
    text = b"alpha beta gamma delta " * 4000
    words = {w: k for k, w in enumerate([b"alpha", b"beta", b"gamma", b"delta", maxent.END])}
    counts, tails = np.array([4000] * 4 + [1]), np.array([maxent.tail_class(w) for w in words])
    head = np.full((maxent.HEAD_CLASSES, maxent.PLACES), -60.0, np.float32)
    head[:5, 0] = 0
    ones = np.ones(maxent.TAIL_CLASSES)
    model = maxent.Model(
        words, counts, np.arange(5), tails, int(counts.sum()), 5, ones, ones, ones / 2, np.zeros(maxent.CLASSES, np.float32),
        np.zeros((maxent.CLASS_ROWS, maxent.CLASSES), np.float32), head, np.zeros((maxent.WORD_ROWS, maxent.PLACES), np.float32))
    learner, codes = maxent.Learner(model), maxent.Codes(model)

    def seen(t):
        return maxent.histories(model, *next(maxent._coded(codes, iter([t]), 1))[:2])

    for at in range(0, 16_000, 1000):
        learner.step(seen(text)[at : at + 1000])
    right, wrong = (maxent.log_probabilities(learner.model, seen(t)).sum() for t in (b"alpha beta gamma", b"gamma beta alpha"))
    assert right > wrong + 2
