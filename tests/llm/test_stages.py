"""Stages of the corpus pipeline against what they are for, on small tables made here."""

import base64
import itertools
import random
import string
import zlib

import corpus_pipeline

from ..conftest import SMALL

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows):
    return spark.createDataFrame([(k, t, lang, "s", len(t or "")) for k, t, lang in rows], DOCS)


def near(a, b):
    """Shared shingles of five words over all of both, in percent."""
    a, b = ({tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (a.lower().split(), b.lower().split()))
    return 100 * len(a & b) / len(a | b)


def test_near_copies_from_eighty_percent_leave_one_document(spark):
    def text(name, other, n=100):
        return " ".join(f"{name}{'x' if k in other else 'w'}{k}" for k in range(n))

    pairs = {  # words changed, alone or side by side, in a text of 100 words
        "a": {10, 50}, "b": {10, 11, 12, 13, 14, 15}, "c": {10, 50, 51}, "d": {10, 50, 90}, "e": set(range(20, 30)),
    }
    rows = [r for k, (name, other) in enumerate(pairs.items()) for r in (
        (10 * k, text(name, set()), "en"), (10 * k + 1, text(name, other), "en"))]
    share = [near(rows[k][1], rows[k + 1][1]) for k in range(0, len(rows), 2)]
    assert sum(80 <= s < 85 for s in share) >= 2 and sum(s < 80 for s in share) >= 2
    wanted = {r[0] for k, s in enumerate(share) for r in rows[2 * k : 2 * k + (1 if s >= 80 else 2)]}
    assert {r["doc_id"] for r in corpus_pipeline.one_of_each(spark, table(spark, rows), SMALL).collect()} == wanted


def test_no_two_kept_documents_of_the_test_data_are_near(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    left = [r["text"] or "" for r in corpus_pipeline.one_of_each(spark, docs, SMALL).collect()]
    long = [t for t in left if len(t.split()) >= 5]
    assert long and not [1 for a, b in itertools.combinations(long, 2) if near(a, b) >= 80]


def test_language_stage_rejects_gibberish_and_unlearned_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    draw = random.Random(7)
    letters = [" ".join("".join(draw.choices(string.ascii_lowercase, k=draw.randint(2, 9))) for _ in range(n)) for n in (30, 300)]
    odd = [
        *letters, base64.b64encode(draw.randbytes(300)).decode(), draw.randbytes(300).hex(), None, "12 !? 4",
        "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i "
        "sumieniem i powinni postępować wobec innych w duchu braterstwa.",
        "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью",
        "人人生而自由在尊严和权利上一律平等他们赋有理性和良心",
    ]
    odd = table(spark, [(10**9 + k, t, None) for k, t in enumerate(odd)])
    kept = {r["doc_id"] for r in corpus_pipeline.known_language(spark, docs.unionByName(odd), SMALL).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert kept == {k for k, t in texts.items() if any(map(str.isalpha, t or ""))}


def test_language_stage_without_labels_and_with_a_rare_language(spark):
    rows = [(k, f"the cat {k} sat on the mat" if k % 3 else None, None) for k in range(30)] + [(99, "1 2 3", None)]
    kept = corpus_pipeline.known_language(spark, table(spark, rows), SMALL)
    assert {r["doc_id"] for r in kept.collect()} == {k for k in range(30) if k % 3}
    assert corpus_pipeline.known_language(spark, table(spark, rows).where("false"), SMALL).count() == 0
    few = table(spark, [(k, "the cat sat on the mat", "en") for k in range(3)] + [(9, "qwzx kjvq", None)])
    assert corpus_pipeline.known_language(spark, few, SMALL).count() == 4


def test_language_found_reaches_the_mixture(spark):
    draw, spoken = random.Random(5), {"en": "the cat and dog sat on mat with old grey hat", "de": "der hund und die katze sitzen auf dem alten dach"}
    rows, true = [], {}
    for k in range(720):
        true[k] = "de" if k % 8 == 3 else "en"
        text = " ".join(draw.choice(spoken[true[k]].split()) for _ in range(20))
        rows.append((k, text, [true[k], None, {"en": "de", "de": "en"}[true[k]]][2 if zlib.crc32(str(k).encode()) % 15 == 0 else int(k % 3 == 0)], "abcdef"[k // 120], len(text)))
    docs = corpus_pipeline.known_language(spark, spark.createDataFrame(rows, DOCS), SMALL)
    found = {r["doc_id"]: r["lang"] for r in docs.collect()}
    assert found == true
    taken = [(r["source"], true[r["doc_id"]]) for r in corpus_pipeline.mixed(spark, docs, SMALL).collect()]
    for source in "abcdef":
        rate = sum(s == source for s, _ in taken) / 120
        own = [k for k in true if rows[k][3] == source]
        for la in ("de", "en"):
            assert abs(taken.count((source, la)) - rate * sum(true[k] == la for k in own)) <= 1


def test_one_document_of_each_group_whatever_the_ids(spark):
    def texts(name):  # four near copies of 100 words
        return [" ".join(f"{name}{'x' if j == k else 'w'}{j}" for j in range(100)) for k in range(4)]

    rows = [(None, t, "en") for t in texts("a")] + [(7, t, "en") for t in texts("b")] + [(8, texts("c")[0], "en")] * 3
    rows += [(9, "alone among these", "en"), (9, "quite another text here", "en"), (None, None, "en"), (None, "", "en")]
    kept = [(r["doc_id"], (r["text"] or "")[:1]) for r in corpus_pipeline.one_of_each(spark, table(spark, rows), SMALL).collect()]
    # One of each group of four, one of the three equal rows, both texts of id 9, and both rows without words.
    assert sorted(kept, key=str) == sorted(
        [(None, "a"), (7, "b"), (8, "c"), (9, "a"), (9, "q"), (None, ""), (None, "")], key=str)


def test_extra_columns_with_clashing_names(spark):
    docs = table(spark, [(k, f"document {k} with token=abcdefgh and words", "en") for k in range(40)])
    names = ["language", "secret_spans", "_spans", "row", "copies", "size", "_id", "_text", "class", "kept", "copy"]
    docs = docs.selectExpr("*", *[f"'{n}' AS `{n}`" for n in names])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, SMALL)
        assert got.columns == docs.columns and got.where(" and ".join(f"`{n}` = '{n}'" for n in names)).count() > 0
    assert corpus_pipeline.packed(spark, docs, SMALL).count() > 0


def test_mixture_takes_whole_documents(spark):
    rows = [(None if k % 3 == 0 else k, " ".join(f"w{k}\nline" for _ in range(k % 40)), "en") for k in range(300)]
    docs = spark.createDataFrame([(k, t, la, "ab"[j % 2], len(t)) for j, (k, t, la) in enumerate(rows)], DOCS)
    texts = {t for _, t, _ in rows}
    got = corpus_pipeline.mixed(spark, docs, SMALL).collect()
    assert {r["text"] for r in got} <= texts
    words = {s: sum(len(r["text"].split()) for r in docs.collect() if r["source"] == s) for s in "ab"}
    taken = {s: sum(len(r["text"].split()) for r in got if r["source"] == s) for s in "ab"}
    goal = 1.5 * sum(words.values())
    assert abs(taken["a"] - min(2 * words["a"], 0.75 * goal)) <= 80 and abs(sum(taken.values()) - goal) <= 160


def test_private_keys_go_with_their_bodies(spark):
    body = "\n".join(base64.b64encode(bytes([k] * 48)).decode() for k in range(30))
    whole = f"before\n-----BEGIN RSA PRIVATE KEY-----\n{body}\nAb==\n-----END RSA PRIVATE KEY-----\nafter"
    cut = f"before\n-----BEGIN PRIVATE KEY-----\n{body}\nsome prose goes on here"
    many = "-----BEGIN " + "WORD " * 20_000 + "PRIVATE KEY-----"
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.without_secrets(
        spark, table(spark, [(1, whole, "en"), (2, cut, "en"), (3, many, "en")]), SMALL).collect()}
    assert got[1] == "before\n[removed]\nafter" and got[2] == "before\n[removed]\nsome prose goes on here" and got[3] == many
