"""License scan with ordered signature rules, in DataFrame operations.

A text is reduced to its words (letters and digits in lower case) with single blanks. A keyword prefilter decides which
documents, and then which license families, are looked at; each remaining document meets the rules of its families, a
small table. Detections whose words lie within those of an earlier or equal priority are suppressed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialise

# Base phrases and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# Families: keyword that must occur, name as words, versions as words, label.
FAMILIES = (
    ("mit", "(?:the )?(?:mit|expat)(?: expat)?", ("",), "mit"),
    ("apache", "(?:the )?apache(?: software)?(?: foundation)?", ("2 0", "2", "1 1", "1 0", ""), "apache"),
    ("general public", "(?:the )?(?:gnu )?general public", ("1", "2", "2 0", "3", "3 0", ""), "gpl"),
    ("lesser general", "(?:the )?(?:gnu )?(?:lesser|library) general public", ("2", "2 0", "2 1", "3", "3 0", ""), "lgpl"),
    ("affero", "(?:the )?(?:gnu )?affero general public", ("1", "3", "3 0", ""), "agpl"),
    ("gpl", "(?:the )?(?:gnu )?gpl", ("1", "2", "2 0", "3", "3 0", ""), "gpl"),
    ("bsd", "(?:the )?(?:(?:new|modified|revised|simplified) )?bsd", ("2 clause", "3 clause", "4 clause", ""), "bsd"),
    ("mozilla", "(?:the )?mozilla public", ("1 0", "1 1", "2 0", ""), "mpl"),
    ("mpl", "(?:the )?mpl", ("1 0", "1 1", "2 0", ""), "mpl"),
    ("eclipse", "(?:the )?eclipse (?:public|distribution)", ("1 0", "2 0", ""), "epl"),
    ("by nc sa", "(?:cc|creative commons) by nc sa", ("2 0", "2 5", "3 0", "4 0", ""), "cc-by-nc-sa"),
    ("by nc nd", "(?:cc|creative commons) by nc nd", ("2 0", "2 5", "3 0", "4 0", ""), "cc-by-nc-nd"),
    ("by nc", "(?:cc|creative commons) by nc", ("2 0", "2 5", "3 0", "4 0", ""), "cc-by-nc"),
    ("by sa", "(?:cc|creative commons) by sa", ("2 0", "2 5", "3 0", "4 0", ""), "cc-by-sa"),
    ("by nd", "(?:cc|creative commons) by nd", ("2 0", "2 5", "3 0", "4 0", ""), "cc-by-nd"),
    ("cc by", "cc by", ("2 0", "2 5", "3 0", "4 0", ""), "cc-by"),
    ("creative commons", "(?:the )?creative commons attribution", ("2 0", "2 5", "3 0", "4 0", ""), "cc-by"),
    ("cc0", "(?:the )?cc0", ("1 0", ""), "cc0"),
    ("isc", "(?:the )?isc", ("",), "isc"),
    ("unlicense", "(?:the )?unlicense", ("",), "unlicense"),
    ("zlib", "(?:the )?zlib(?: libpng)?", ("",), "zlib"),
    ("boost", "(?:the )?boost software", ("1 0", ""), "bsl"),
    ("artistic", "(?:the )?(?:perl )?artistic", ("1 0", "2 0", ""), "artistic"),
    ("european union", "(?:the )?european union public", ("1 0", "1 1", "1 2", ""), "eupl"),
    ("common development", "(?:the )?common development and distribution", ("1 0", "1 1", ""), "cddl"),
    ("python", "(?:the )?python software foundation", ("2", ""), "psf"),
    ("open font", "(?:the )?(?:sil )?open font", ("1 0", "1 1", ""), "ofl"),
    ("wtfpl", "(?:the )?wtfpl", ("2", ""), "wtfpl"),
    ("academic free", "(?:the )?academic free", ("2 1", "3 0", ""), "afl"),
    ("microsoft", "(?:the )?microsoft (?:public|reciprocal)", ("",), "ms"),
)
# Templates in order of priority: words around name (N) and version (V), and how sure a match is.
TEMPLATES = (
    ("spdx license identifier N(?: V)?", 1.0),
    ("(?:licensed|released|distributed|available|provided|published)(?: to you)?(?: only)? under(?: the terms of)? N(?: license| licence)?(?: version| v)? V", 0.95),
    ("N (?:license|licence)(?: version| v)? V", 0.85),
    ("under(?: the terms of)? N(?: license| licence)? V", 0.75),
)
_GATE = ("licen", "spdx", "under")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def rules() -> list[tuple[str, int, int, float, str, str]]:
    """(keyword, rule, priority, confidence, label, pattern) of every family, version and template, in order."""
    out = []
    for priority, (template, sure) in enumerate(TEMPLATES):
        for keyword, name, versions, label in FAMILIES:
            for version in versions:
                pattern = template.replace("(?: V)?", " V").replace("V", version) if version else (
                    template.replace("(?: V)?", "").replace("(?: version| v)? V", "").replace(" V", ""))
                label_of = f"{label}-{version.removesuffix(' 0').replace(' ', '.')}" if version and not label.startswith("cc") else label
                out.append((keyword, len(out), priority, sure, label_of, pattern.replace("N", name)))
    return out


def _spaces(text: Column) -> Column:
    return F.char_length(text) - F.char_length(F.translate(text, " ", ""))


def scan_licenses(docs: DataFrame) -> DataFrame:
    """One row per document: `doc_id`, `n_words`, `n_base`, `first_word`, `last_word`, `base_labels`, `labels`, `score`
    and `n_detections` (after suppression).

    Base phrases count wherever their words stand in a row. Null or wordless texts have zeros, null places, empty labels
    and score 0; repeated rows are each listed; other columns are not read; no rows give no rows.
    """
    lowered = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), _UPPER, _LOWER)
    words = F.trim(F.regexp_replace(lowered, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))
    read = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), words.alias("words"))
    counted = read.withColumn(
        "n_words", F.when(F.col("words") == "", 0).otherwise(_spaces(F.col("words")) + 1).cast("long")
    ).withColumn("norm", F.concat(F.lit("~ "), "words", F.lit(" ")))
    held = [F.col("norm").contains(f" {phrase} ") for phrase in PHRASES]
    any_base = held[0] | held[1] | held[2]
    pieces = counted.withColumn("pieces", F.when(any_base, F.split("norm", f"(?<= )(?=(?:{'|'.join(PHRASES)}) )")))
    base = materialise(pieces.select(
        "row", "doc_id", "n_words", F.when(any_base, F.size("pieces") - 1).otherwise(0).cast("long").alias("n_base"),
        F.when(any_base, _spaces(F.element_at("pieces", 1)) - 1).cast("long").alias("first_word"),
        F.when(any_base, F.col("n_words") - _spaces(F.element_at("pieces", -1))).cast("long").alias("last_word"),
        F.array_compact(F.array(*[F.when(h, label) for h, label in zip(held, PHRASES.values())])).alias("base_list"),
        F.when(F.col("norm").rlike("|".join(_GATE)), F.filter(
            F.array(*[F.lit(k) for k in dict.fromkeys(f[0] for f in FAMILIES)]), lambda k: F.contains("norm", k)
        )).alias("keywords"),
        "norm",
    ).withColumn("norm", F.when(F.size("keywords") > 0, F.col("norm"))), "licenses")

    table = docs.sparkSession.createDataFrame(
        rules(), "keyword string, rule int, priority int, sure double, label string, pattern string")
    met = base.where("norm is not null").select("row", "norm", F.explode("keywords").alias("keyword")).join(
        F.broadcast(table), "keyword")  # a few hundred rows, fixed
    cut = met.where(F.expr("norm rlike concat(' ', pattern, ' ')")).withColumn(
        "pieces", F.expr("split(norm, concat('(?<= )(?=(?:', pattern, ') )'))"))
    spans = F.expr("""
        aggregate(
          slice(pieces, 2, size(pieces)),
          named_struct('at', char_length(pieces[0]) - char_length(translate(pieces[0], ' ', '')) - 1,
                       'out', cast(array() as array<struct<s:int,e:int>>)),
          (x, p) -> named_struct(
            'at', x.at + char_length(p) - char_length(translate(p, ' ', '')),
            'out', concat(x.out, array(named_struct('s', x.at, 'e', x.at + 1
              + char_length(regexp_extract(p, concat('^(', pattern, ') '), 1))
              - char_length(translate(regexp_extract(p, concat('^(', pattern, ') '), 1), ' ', ''))))))
        ).out""")
    found = cut.select("row", "rule", "priority", "sure", "label", F.explode(spans).alias("x")).select(
        "row", "rule", "priority", "sure", "label", "x.s", "x.e")
    before = Window.partitionBy("row").orderBy("s", F.desc("e"), "priority", "rule").rowsBetween(Window.unboundedPreceding, -1)
    reach = [F.max(F.when(F.col("priority") <= p, F.col("e"))).over(before).alias(f"reach{p}") for p in range(len(TEMPLATES))]
    own = F.element_at(F.array(*[F.col(f"reach{p}") for p in range(len(TEMPLATES))]), F.col("priority") + 1)
    left = found.select("*", *reach).where(F.coalesce(own < F.col("e"), F.lit(True)))
    method = left.groupBy("row").agg(
        F.collect_set("label").alias("more"), F.max("sure").alias("sure"), F.count("*").cast("long").alias("n_detections"))
    joined = base.drop("norm", "keywords").join(method, "row", "left")
    labels = F.array_sort(F.array_union("base_list", F.coalesce("more", F.array().cast("array<string>"))))
    score = F.greatest(F.coalesce("sure", F.lit(0.0)), F.when(F.col("n_base") > 0, 0.9).otherwise(0.0))
    return joined.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join(F.array_sort("base_list"), ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"),
        score.alias("score"), F.coalesce("n_detections", F.lit(0).cast("long")).alias("n_detections"),
    )
