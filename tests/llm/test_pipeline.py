import re
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
from vitrine.llm import language, secrets
from vitrine.storage import materialise

from ..conftest import SMALL
from .test_minhash import brute as components
from .test_secrets import brute as spans


def gated(model, texts):
    """Ids of texts in a learned language: the share of known n-grams of their words, one text at a time."""
    known, kept = np.unpackbits(model.gate.known, axis=1).astype(bool), set()
    landmarks = np.unpackbits(model.landmarks, axis=1).astype(np.float32)
    for doc, text in texts.items():
        if not any(map(str.isalpha, text or "")):
            continue
        whole, words = np.zeros(language.BUCKETS, dtype=bool), np.zeros(language.BUCKETS, dtype=bool)
        language.presence(text, whole)
        language.presence(language.words_only(text), words)
        shares = (known & words).sum(axis=1) / max(words.sum(), 1)
        best = int(model.scores(whole[None].astype(np.float32), landmarks).argmax())
        if np.isnan(model.gate.limits[best]) or any(s >= m for s, m in zip(shares, model.gate.limits)):
            kept.add(doc)
    return kept


def test_stages_against_a_plain_version(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    known = gated(language.fit(docs, gated=True), text)
    one = {r[0] for r in components([(k, text[k]) for k in known], corpus_pipeline.NEAR_PERCENT) if r[3]}
    current, columns = docs, docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        current = materialise(stage(spark, current, SMALL), "stage")
        assert current.columns == columns
        seen[name] = current.collect()
    assert {r["doc_id"] for r in seen["language ID"]} == known
    assert {r["doc_id"] for r in seen["near-dedup"]} == one and len(seen["near-dedup"]) == len(one)
    clean = {r["doc_id"]: r["text"] for r in seen["secrets"]}
    assert set(clean) == one
    for k, t in clean.items():
        own = spans(text[k])[1]
        assert (t == text[k]) == (not own) or own == []
        assert t.count(secrets.MASK) >= min(1, len(own)) and not spans(t)[1]
    times = Counter(r["doc_id"] for r in seen["mixture"])
    assert max(times.values()) <= 2 and set(times) <= one
    for r in seen["mixture"]:
        assert clean[r["doc_id"]] == r["text"]
    pieces = defaultdict(int)
    for r in corpus_pipeline.run(spark, SMALL).select("doc_id", "length").collect():
        pieces[r["doc_id"]] += r["length"]
    assert set(pieces) == set(times)
    assert re.search("[A-Za-z]", "".join(clean.values()))
