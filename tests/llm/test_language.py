import zlib

from vitrine.llm import language
from vitrine.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.01"


def test_query_on_held_out_documents(spark):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    rows = QUERIES["op5_string_kernel"](spark, FOLDER).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in held) >= 0.97 * len(held)


def test_odd_rows(spark):
    texts = [None, "", "123 !? 4", "the cat sat on the mat and the dog", "der hund und die katze", "é" * 50_000]
    docs = spark.createDataFrame(
        [(k, texts[k % 6], [None, "en", "en", "en", "de", "fr"][k % 6], "x") for k in range(120)] + [(None, "the end", "en", "y")],
        "doc_id long, text string, lang string, score string",
    )
    got = language.identify(docs).collect()
    assert len(got) == 121 and {r["score"] for r in got} == {"x", "y"}
    for r in got:
        if r["text"] in (None, "", "123 !? 4"):
            assert r["language"]["lang_pred"] == "und" and r["language"]["score"] == 0
        elif r["doc_id"] is not None:
            assert r["language"]["lang_pred"] == r["lang"]
    assert language.identify(docs.where("false")).count() == 0
    unlearned = language.identify(docs.drop("lang").selectExpr("*", "cast(null as string) lang"))
    assert {r["language"]["lang_pred"] for r in unlearned.collect()} == {"und"}
