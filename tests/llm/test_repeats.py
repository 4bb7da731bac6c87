import hashlib
import random
import tracemalloc
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vitrine.llm import repeats
from vitrine.llm.queries import QUERIES
from vitrine.llm.suffixes import suffix_array

from ..conftest import SMALL


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.lists(st.integers(0, 2), max_size=60), st.lists(st.integers(0, 9), max_size=60)))
def test_suffix_array(text):
    assert suffix_array(text) == sorted(range(len(text)), key=lambda k: text[k:])


def brute(docs, length):
    where = defaultdict(list)
    raws = [(t or "").encode() for _, t in docs]
    for k, raw in enumerate(raws):
        for at in range(len(raw) - length + 1):
            where[hash(raw[at : at + length])].append((k, at))
    gone = [bytearray(len(raw)) for raw in raws]
    for found in where.values():
        if len(found) > 1:
            for k, at in found:
                gone[k][at : at + length] = b"\1" * length
    out = []
    for (doc, _), raw, mask in zip(docs, raws, gone):
        kept = bytes(b for b, g in zip(raw, mask) if not g)
        runs = sum(1 for k, g in enumerate(mask) if g and not (k and mask[k - 1]))
        out.append((doc, len(raw), sum(mask), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_query_against_all_windows(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    got = sorted((tuple(r) for r in QUERIES["op3_lyndon_suffixes"](spark, SMALL).collect()), key=str)
    assert got == brute(docs, 400)


@pytest.mark.parametrize("block", [2, 24])
def test_crowded_cores_and_odd_rows(spark, block, monkeypatch):
    monkeypatch.setattr(repeats, "BLOCK", block)
    draw = random.Random(3)
    text = lambda n: "".join(draw.choice("abcdé ") for _ in range(n))
    passage, docs = text(90), []
    for k in range(40):
        cut = draw.randrange(0, 50)
        docs.append((k, text(draw.randrange(0, 60)) + passage[cut:] + text(draw.randrange(0, 60))))
    docs += [(100, "ab" * 100), (101, "x" * 39), (102, "x" * 40), (103, "x" * 41), (104, None), (105, ""), (106, docs[0][1])]
    docs += [(107, docs[1][1]), (107, docs[1][1]), (None, text(300)), (108, text(30) * 3), (109, passage), (110, passage[:45])]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' raw", "1 core")
    got = repeats.remove_repeats(df, length=40, core=12).collect()
    want = brute(docs, 40)
    assert sorted(((*r[:4], hashlib.sha256(r["kept"]).hexdigest()) for r in got), key=str) == want
    assert repeats.remove_repeats(df.where("false")).count() == 0


def test_long_texts_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(repeats, "_PIECE", 64)
    draw = random.Random(4)
    text = lambda n: "".join(draw.choice("abcdé ") for _ in range(n))
    passage = text(150)
    docs = [(k, text(draw.randrange(0, 200)) + passage[draw.randrange(0, 60) :] + text(draw.randrange(0, 200))) for k in range(20)]
    docs += [(100, "a" * 400), (101, "ab" * 150), (102, docs[0][1]), (103, text(70) * 4), (104, text(103)), (105, None)]
    got = repeats.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string"), length=40, core=12).collect()
    assert sorted(((*r[:4], hashlib.sha256(r["kept"]).hexdigest()) for r in got), key=str) == brute(docs, 40)


def test_workers_memory_does_not_grow_with_the_text():
    raw = np.random.default_rng(6).integers(97, 123, 9_000_000, dtype=np.uint8).tobytes()
    batch = pa.RecordBatch.from_pydict({"text_id": [b"x"], "raw": [raw]})
    tracemalloc.start()
    try:
        windows = sum(pa.compute.sum(x.column("windows")).as_py()
                      for x in repeats._listed(iter([batch]), 400, 100, repeats._PIECE))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert windows == len(raw) - 399
    assert peak < 150_000_000


def test_slices_hold_few_bytes(monkeypatch):
    monkeypatch.setattr(repeats, "_HELD", 10)
    batch = pa.RecordBatch.from_pydict({"raw": [b"x" * n for n in (4, 6, 1, 50, 0, 0, 0, 0, 9)]})
    assert [len(x) for x in repeats._slices(batch, 3)] == [2, 1, 1, 3, 2]
    assert list(repeats._slices(batch.slice(0, 0), 3)) == []


def test_ranges_of_a_text_in_little_memory():
    n, one = 1_000_000, pa.struct([("start", pa.int64()), ("end", pa.int64())])
    at = np.arange(n) + 7
    covered = pa.ListArray.from_arrays(
        pa.array([0, None, n, n + 3], pa.int32()),
        pa.StructArray.from_arrays([pa.array([*at, 0, 2, 9]), pa.array([*(at + 400), 5, 4, 10])], fields=list(one)))
    raws = [b"y" * (n + 420), b"abc", b"0123456789ab"]
    batch = pa.RecordBatch.from_arrays(
        [pa.array([1, 2, 3]), pa.array(raws), covered], names=["doc_id", "raw", "covered"])
    tracemalloc.start()
    try:
        got = [r for x in repeats._removed(iter([batch])) for r in x.to_pylist()]
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert [r["n_removed"] for r in got] == [n + 399, 0, 6] and [r["n_spans"] for r in got] == [1, 0, 2]
    assert got[2]["kept"] == b"5678ab" and got[2]["spans"] == [{"start": 0, "end": 5}, {"start": 9, "end": 10}]
    assert peak < 60_000_000
