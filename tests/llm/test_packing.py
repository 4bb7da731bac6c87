import zlib
from collections import defaultdict

import numpy as np
from tokenizers import Tokenizer

from vitrine.llm import packing
from vitrine.llm.queries import QUERIES
from vitrine.llm.tokens import TextEncoder, vocabulary

from ..conftest import SMALL

ODD = [
    "", " ", "  a b", " a", "a\n b", " é  b", "x <|endoftext|> y", "a \x1c c", "日本 語 😀 x", "'s it's  ", "\n\n \n a",
]


def checked(rows, expected):
    """Every id in exactly one piece, sequences gapless and of a length that needs no padding but for few."""
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    assert set(pieces) == set(expected)
    for doc, own in pieces.items():
        at = 0
        for r in sorted(own, key=lambda r: r["start"]):
            assert r["start"] == at and r["length"] > 0 and r["doc_tokens"] == len(expected[doc])
            crc = zlib.crc32(np.array(expected[doc][at : at + r["length"]], dtype="<u4").tobytes())
            assert r["ids_crc32"] == crc
            at += r["length"]
        assert at == len(expected[doc])
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at == own[0]["window"] <= 2048 and at & (at - 1) == 0


def test_query_against_plain_tokenizer(spark):
    tokenizer = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    rows = QUERIES["op1_hierarchical_packing"](spark, SMALL).collect()
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    checked(rows, {d["doc_id"]: tokenizer.encode(d["text"] or "", add_special_tokens=False).ids + [1] for d in docs})


def test_odd_rows(spark, tmp_path):
    tokenizer = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    texts = [*ODD, None, "word " * 30_000]
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, length string")
    docs.coalesce(2).write.parquet(str(tmp_path / "documents.parquet"))
    rows = QUERIES["op1_hierarchical_packing"](spark, str(tmp_path)).collect()
    checked(rows, {k: tokenizer.encode(t or "", add_special_tokens=False).ids + [1] for k, t in enumerate(texts)})
    assert packing.pack(docs.where("false")).count() == 0
    twice = packing.pack(docs.limit(3).unionAll(docs.limit(3)).withColumn("doc_id", docs.doc_id * 0)).collect()
    assert sum(r["length"] for r in twice) == sum(r["doc_tokens"] for r in twice if r["start"] == 0)


def test_small_chunks_carry_the_open_window(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").coalesce(1)
    rows = packing.pack(docs, chunk_tokens=5000, step_tokens=4096).collect()
    lengths = defaultdict(int)
    for r in rows:
        lengths[r["sequence_id"]] += r["length"]
    assert sum(n & (n - 1) == 0 for n in lengths.values()) == len(lengths)
    assert len({r["step_id"] for r in rows}) > 1


def test_steps_weigh_alike():
    windows = [(256, [(n, 0, 0), (256 - n, 1, 0)]) for n in range(1, 129)]
    groups = packing.step_groups(windows, 4096)
    cost = defaultdict(int)
    for (_, held), group in zip(windows, groups):
        cost[group] += sum(p[0] ** 2 for p in held)
    assert len(cost) == 8 and max(cost.values()) < 1.1 * min(cost.values())


def test_spans_are_those_of_the_tokenizer():
    encoder = TextEncoder()
    for text in [t for t in ODD if t] + ["naïve 漢字😀 words"]:
        first, last = encoder.spans(text)
        found = encoder.tokenizer().encode(text, add_special_tokens=False).offsets
        assert list(zip(first.tolist(), last.tolist())) == found
