import re

import duckdb

from vitrine.llm import attribution, licenses, quality
from vitrine.llm.queries import ORACLES, QUERIES
from vitrine.llm.tokens import TextEncoder

from ..conftest import SMALL

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ODD = [
    None, "", "...", "Under the MIT License", "x under-the (mit) LICENSE: mit.", "apache license version 2 apache license, version 2.0",
    "CC BY-NC 4.0", "licensed under the GNU General Public License, version 3.", "é under the mit license é", "word " * 30_000 + "cc by nc",
]


def test_lines_against_sql(spark, tmp_path):
    con = duckdb.connect()
    long = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"
    texts = [*ODD, long, f"{long}\n{long}", f"Shared LINE 1\n{long} 7\n \nshared  line 2", "a b c d e f g h " * 400, f"{long}\nx\nx\n x"]
    rows = [(k, texts[k % len(texts)], ["a", None, "b"][k % 3]) for k in range(len(texts) * 3)]
    rows += [(1000 + k, f"{long} {k}\nBoiler plate {k % 10}\ntail {k} of it", "hot") for k in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "'x' host", "1 row")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    df = QUERIES["op6_line_frequency"](spark, str(tmp_path))
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({ORACLES['op6_line_frequency']})").fetchall()
    got = [tuple(r) for r in df.collect()]
    assert sorted(got) == sorted(want)
    assert any(r[7] for r in got) and quality.line_frequency(docs.where("false")).count() == 0


def test_frequent_lines_leave_the_texts(spark):
    draw = ["Read MORE  1", "\tread more 2 ", "own", "", " ", "x y", "a\rb"]
    rows = [(k, "\n".join([draw[k % 7], f"only in {'abc'[k % 3] * k}", draw[(k + 1) % 7], draw[k % 2], ""]), "ab"[k % 2]) for k in range(60)]
    rows += [(None, "without id\nand more", "c")] * 3 + [(7, "one id\nand more", "d")] * 3 + [(8, None, "a"), (9, "", None), (2, rows[2][1], "a")]
    rows += [(10 + k, "no host", None) for k in range(3)] + [(500, "\n".join(f"read more {k % 10}" for k in range(20_000)), "a")]

    def words(line):
        return re.findall("[^\x20\x09-\x0d]+", line)

    def key(line):
        return re.sub("[0-9]", "0", " ".join(words(line)).lower())

    holders = {}
    for number, (doc, text, host) in enumerate(rows):
        for line in (text or "").split("\n"):
            holders.setdefault((host, key(line)), set()).add(("row", number) if doc is None else doc)
    want = []
    for doc, text, host in rows:
        left = [x for x in (text or "").split("\n") if not words(x) or len(holders[host, key(x)]) <= 2]
        want.append((doc, "\n".join(left), len(words(text or "")) - len(words(" ".join(left)))))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 gone", "2 `all`")
    got = quality.line_frequency(docs, line_documents=2).select("doc_id", "text", "n_removed").collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert {(500, "", 60_000), (None, "", 4), (9, "", 0), (7, "one id\nand more", 0)} <= set(want)


def test_licenses_against_words(spark, tmp_path):
    texts = {k: t for k, t in enumerate(ODD)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").selectExpr("*", "'x' words", "1 row")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    rows = QUERIES["op8_license_rules"](spark, str(tmp_path)).collect()
    for r in rows:
        words, places, found = WORD.findall((texts[r["doc_id"]] or "").translate(LOWER)), [], set()
        for phrase, label in licenses.PHRASES.items():
            own = phrase.split()
            here = [k for k in range(len(words)) if words[k : k + len(own)] == own]
            places += here
            found |= {label} if here else set()
        assert r["n_words"] == len(words) and r["n_base"] == len(places) and r["base_labels"] == ",".join(sorted(found))
        assert (r["first_word"], r["last_word"]) == ((min(places), max(places)) if places else (None, None))
        assert found <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    labels = {r["doc_id"]: r["labels"] for r in rows}
    assert labels[7] == "gpl-3" and labels[6] == "cc-by-nc" and len(rows) == len(texts)
    assert licenses.scan_licenses(docs.where("false")).count() == 0
    assert len(QUERIES["op8_license_rules"](spark, SMALL).collect()) == 200


def test_token_counts_add_up(spark):
    texts = [*ODD, "a\n\nb\n", "\n", "x\r\n\r\n y", "漢字\n😀"]
    docs = spark.createDataFrame([*enumerate(texts), (None, "z"), (0, "again")], "doc_id long, text string").selectExpr("*", "1 start")
    rows = attribution.token_counts(docs).collect()
    encoder = TextEncoder()
    for k, text in list(enumerate(texts))[1:]:
        own = sorted((r["section"], r["start"], r["end"], r["n_tokens"]) for r in rows if r["doc_id"] == k)
        assert sum(r[3] for r in own) == (len(encoder.ids(text)) if text else 0)
        assert own[0][1] == 0 and own[-1][2] == len(text or "") and all(a[2] == b[1] for a, b in zip(own, own[1:]))
    assert attribution.token_counts(docs.where("false")).count() == 0
    import numpy as np
    section, crossing = attribution.attribute(np.array([0, 2, 5]), np.array([2, 5, 9]), np.array([0, 3, 6, 9]))
    assert section.tolist() == [0, 1, 2] and crossing.tolist() == [False, True, True]
