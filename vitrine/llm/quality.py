"""Quality rules with cross-document line frequency, in DataFrame operations.

Base rules look at one document. The method's rule looks across: lines are normalised and hashed, the documents that
hold a line are counted within each host, lines in more documents than a limit are removed from the texts, and documents
that lose most of their words are rejected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialise

WINDOW = 8
LINE_DOCUMENTS = 100  # a line in more documents of its host is boilerplate
LOST_PERCENT = 70  # a document that loses more of its words is depleted
_BLANKS = r"[\x20\x09-\x0D]+"
_WORD = r"[^\x20\x09-\x0D]"


def _words(text):
    return F.filter(F.split(text, _BLANKS), lambda x: x != "")


def _text_id():
    return F.unhex(F.md5(F.encode("text", "utf-8")))


def _removed_lines(read: DataFrame, line_documents: int) -> DataFrame:
    """Of texts with lines in more than `line_documents` documents of their host: `of_host`, `of_doc`, `of_text` and `gone`,
    the places of those lines, from 0."""
    def line(x):
        return F.transform(F.array(x), lambda y: F.when(
            y.rlike(_WORD), F.xxhash64(F.regexp_replace(F.lower(F.array_join(_words(y), " ")), "[0-9]", "0"))))[0]

    hashed = materialise(read.select(
        "host", "doc_id", _text_id().alias("text_id"), F.transform(F.split("text", "\n"), line).alias("lines")), "lines")
    held = hashed.select("host", "doc_id", F.explode(F.array_distinct("lines")).alias("h")).where("h is not null")
    documents = F.sum(F.when(F.col("doc_id").isNull(), F.col("rows")).otherwise(1))
    frequent = materialise(
        held.groupBy("host", "doc_id", "h").agg(F.count("*").alias("rows"))
        .groupBy("host", "h").agg(documents.alias("documents")).where(F.col("documents") > line_documents)
        .select(F.col("host").alias("at"), F.col("h").alias("often")), "frequent-lines")
    lines = hashed.select("host", "doc_id", "text_id", F.posexplode("lines").alias("place", "h")).where("h is not null")
    removed = lines.join(frequent, lines["host"].eqNullSafe(frequent["at"]) & (lines["h"] == frequent["often"]))
    return removed.groupBy(
        F.col("host").alias("of_host"), F.col("doc_id").alias("of_doc"), F.col("text_id").alias("of_text"),
    ).agg(F.collect_set("place").alias("gone"))


def line_frequency(
    docs: DataFrame, host: str = "source", line_documents: int = LINE_DOCUMENTS, lost_percent: int = LOST_PERCENT
) -> DataFrame:
    """One row per document: `doc_id`, `n_words`, `word_chars`, `n_symbols`, `n_dup_lines`, `n_repeat_words`,
    `base_failed`, `n_removed` (words on removed lines), `kept` and `text`, what is left without the removed lines.

    A line is normalised to its words in lower case with digits as 0. Hosts may be null (one host). Rows with one
    `doc_id` count as one document for a line and are each listed; rows without id count each. Null texts are empty, have
    no words and fail; other columns are not read; no rows give no rows.
    """
    read = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col(host).cast("string").alias("host"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    gone = _removed_lines(read, line_documents)
    texts = read.withColumn("text_id", _text_id())
    joined = texts.join(
        gone, texts["host"].eqNullSafe(gone["of_host"]) & texts["doc_id"].eqNullSafe(gone["of_doc"])
        & (texts["text_id"] == gone["of_text"]), "left").select("doc_id", "text", "gone")
    split = joined.withColumn("words", _words(F.col("text"))).withColumn("all", F.split("text", "\n")).withColumn(
        "lines", F.filter("all", lambda x: x.rlike(_WORD)))
    hashed = split.withColumn("hashes", F.transform("words", lambda x: F.xxhash64(x)))
    windows = F.when(
        F.size("hashes") >= WINDOW,
        F.transform(F.sequence(F.lit(1), F.size("hashes") - (WINDOW - 1)), lambda k: F.xxhash64(F.slice("hashes", k, WINDOW))),
    ).otherwise(F.array().cast("array<bigint>"))
    windowed = hashed.withColumn("windows", windows)
    repeats = F.size("windows") > F.size(F.array_distinct("windows"))
    placed = windowed.withColumn("placed", F.when(
        repeats, F.array_sort(F.transform("windows", lambda x, k: F.struct(x.alias("x"), k.alias("k"))))))
    again = F.transform("placed", lambda e, k: F.when(
        F.coalesce(F.get("placed", k - 1)["x"] == e["x"], F.lit(False))
        | F.coalesce(F.get("placed", k + 1)["x"] == e["x"], F.lit(False)), e["k"]))
    found = placed.withColumn("at", F.array_sort(F.filter(again, lambda k: k.isNotNull())))
    covered = F.aggregate(
        F.transform("at", lambda p, k: F.least(F.coalesce(F.get("at", k + 1) - p, F.lit(WINDOW)), F.lit(WINDOW))),
        F.lit(0), lambda s, x: s + x)

    places = F.array_except(F.sequence(F.lit(0), F.size("all") - 1), F.col("gone"))
    left = F.when(F.col("gone").isNull(), F.col("text")).otherwise(
        F.array_join(F.transform(places, lambda k: F.get("all", k)), "\n"))
    counted = found.select(
        "doc_id", F.size("words").cast("long").alias("n_words"),
        F.char_length(F.translate("text", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.char_length("text") - F.char_length(F.translate("text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"), "gone", left.alias("text"),
    )
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    lost = F.when(F.col("gone").isNull(), F.lit(0)).otherwise(F.col("n_words") - F.size(_words(F.col("text"))))
    judged = counted.withColumn("base_failed", failed).withColumn("n_removed", lost.cast("long"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_removed",
        (~F.col("base_failed") & (100 * F.col("n_removed") <= lost_percent * F.col("n_words"))).alias("kept"), "text",
    )


ORACLE_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
win AS (SELECT r, i, array_to_string(ws[i:i + 7], ' ') AS k
        FROM (SELECT r, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)),
dup AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS c FROM win) WHERE c > 1),
rep AS (SELECT r, sum(least(8, coalesce(nx - i, 8))) AS n
        FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nx FROM dup) GROUP BY r),
ln AS (SELECT r, doc_id, source, l, regexp_extract_all(l, '[^\x20\x09-\x0D]+') AS lw
       FROM (SELECT r, doc_id, source, unnest(string_split(t, chr(10))) AS l FROM d)),
lines AS (SELECT r, doc_id, source, l, len(lw) AS n,
                 regexp_replace(lower(array_to_string(lw, ' ')), '[0-9]', '0', 'g') AS k FROM ln WHERE len(lw) > 0),
often AS (SELECT source, k FROM lines GROUP BY source, k HAVING count(DISTINCT doc_id) > {LINE_DOCUMENTS}),
per AS (SELECT lines.r, count(*) - count(DISTINCT l) AS dups,
               sum(CASE WHEN often.k IS NOT NULL THEN n ELSE 0 END) AS removed
        FROM lines LEFT JOIN often ON lines.source IS NOT DISTINCT FROM often.source AND lines.k = often.k
        GROUP BY lines.r),
q AS (SELECT doc_id, len(ws)::BIGINT AS n_words,
             length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
             (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             coalesce(dups, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
             coalesce(removed, 0)::BIGINT AS n_removed
      FROM w LEFT JOIN rep ON w.r = rep.r LEFT JOIN per ON w.r = per.r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed, n_removed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND 100 * n_removed <= {LOST_PERCENT} * n_words AS kept
FROM q
"""
