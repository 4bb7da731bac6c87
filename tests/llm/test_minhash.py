import random
import re

from vitrine.llm import minhash
from vitrine.llm.components import components
from vitrine.llm.queries import QUERIES

from ..conftest import SMALL, rows

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, percent=85):
    sets = []
    for _, text in docs:
        words = WORD.findall((text or "").translate(LOWER))
        n = min(5, len(words))
        sets.append({tuple(words[k : k + n]) for k in range(len(words) - n + 1)} if words else set())
    parent = list(range(len(docs)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for k, (doc, _) in enumerate(docs):
        if doc is not None:
            least[root(k)] = min(doc, least.get(root(k), doc))
    return sorted(
        ((doc, len(s), least.get(root(k)), doc == least.get(root(k))) for k, ((doc, _), s) in enumerate(zip(docs, sets))),
        key=str,
    )


def test_query_against_all_pairs(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    got = [tuple(r) for r in QUERIES["op2_minhash_components"](spark, SMALL).collect()]
    assert sorted(got, key=str) == brute(docs)


def test_chains_copies_and_odd_rows(spark):
    draw = random.Random(5)
    base = [f"w{k}" for k in range(120)]
    docs, words = [], base[:]
    for k in range(40):  # a chain: neighbours are near, its ends are not
        words[(3 * k) % 120] = f"x{k}"
        docs.append((1000 - k, " ".join(words)))
    for k in range(60):  # one group around a text, most pairs of which are near
        own = base[:]
        for at in draw.sample(range(120), draw.choice([1, 1, 1, 2, 3])):
            own[at] = f"y{k}"
        docs.append((2000 + k, " ".join(own).upper()))
    docs += [(3000 + k, "same short") for k in range(5)] + [(3010, "same  SHORT\n"), (3011, "short same")]
    docs += [(4000, None), (4001, ""), (4002, " \t\n"), (4003, "a b c d e"), (4004, "a b c d e f"), (4003, "a b c d e")]
    docs += [(None, "no id here at all"), (None, None), (None, "same short"), (4005, "q " * 5000), (4006, "é É x y z")]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' kept", "1 class")
    got = sorted((tuple(r) for r in minhash.near_duplicates(df).collect()), key=str)
    assert got == brute(docs)
    assert minhash.near_duplicates(df.where("false")).count() == 0
    assert minhash.near_duplicates(df.where("text is null")).count() == 2


def test_components_of_a_path_and_a_star(spark):
    edges = [(k, k + 1) for k in range(100, 160)] + [(7, k) for k in range(200, 260)] + [(5, 5), (300, 301), (301, 300)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = dict(rows(components(df), "node", "label"))
    assert got == {**{k: 100 for k in range(100, 161)}, 7: 7, **{k: 7 for k in range(200, 260)}, 300: 300, 301: 300}
