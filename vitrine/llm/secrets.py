"""Secret scan with an incremental blob ledger.

Every text is content-addressed. The ledger, Parquet files in a folder, records which rules (with version) have scanned
which blob, and the findings. A run scans each distinct blob once, and only with rules the ledger has not seen for it;
findings then join back to every document that holds the blob, old or new. All of it is DataFrame code.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import fresh_path


@dataclass(frozen=True)
class Rule:
    """`pattern` finds matches (leftmost, not overlapping); `least` is the least length of its group `measured`."""

    kind: str
    pattern: str
    gate: str
    measured: int = 0
    least: int = 1
    version: int = 1


# The three base kinds, in the order that breaks ties.
BASE = (
    Rule(
        "assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]""", measured=2, least=6,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", "AKIA[A-Z0-9]{16}", least=20),
    Rule("hex", r"(?<![0-9a-f])[0-9a-f]{24,}+", "[0-9a-f]{24}", least=24),
)
_LABEL = "(?:[A-Z0-9]{1,20} ){0,6}PRIVATE KEY-----"
MORE = (
    # The whole block up to its END line; without one, the lines of base64 behind BEGIN.
    Rule("private_key", rf"-----BEGIN {_LABEL}(?:[^-]*+-----END {_LABEL}|(?:[\x20\x09-\x0D]{{1,4}}[A-Za-z0-9+/=]{{20,}}+){{0,40}})",
         "PRIVATE KEY-----", version=2),
    Rule("bearer", r"(?i:bearer)\x20+[A-Za-z0-9._~+/-]{20,}+=*", "(?i:bearer)\\x20"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+", "eyJ"),
    Rule("url_login", r"[a-z][a-z0-9+.-]{1,20}://[^\s:/@]{1,64}:[^\s:/@]{3,64}@", "://"),
    Rule("prefixed", r"(?<![A-Za-z0-9_])(?:gh[pousr]_|glpat-|xox[abprs]-|sk_live_)[A-Za-z0-9_-]{16,}+",
         "gh[pousr]_|glpat-|xox[abprs]-|sk_live_"),
)
RULES = BASE + MORE
MASK = "[removed]"


def _spans(text: Column, rule: Rule) -> Column:
    """Kind, start and end (code points, end exclusive) of a rule's matches in one text."""
    pattern = F.lit(rule.pattern)
    gaps = F.transform(F.split(text, rule.pattern, -1), F.char_length)
    found = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), F.char_length)
    measured = F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.measured)), F.char_length)
    steps = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(found)).alias("g"), found.alias("f"), measured.alias("m"))
    start = F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<s:int,e:int>>").alias("out"))

    def step(state: Column, x: Column) -> Column:
        begin = state["end"] + x["g"]
        end = begin + x["f"]
        span = F.array(F.struct(begin.alias("s"), end.alias("e")))
        return F.struct(
            end.alias("end"),
            F.when(x["m"] >= rule.least, F.concat(state["out"], span)).otherwise(state["out"]).alias("out"),
        )

    spans = F.transform(
        F.aggregate(steps, start, step)["out"],
        lambda x: F.struct(F.lit(rule.kind).alias("kind"), x["s"].alias("start"), x["e"].alias("end")),
    )
    none = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    return F.when(text.rlike(rule.gate), spans).otherwise(none)


def _read(spark, path: str, schema: str) -> DataFrame:
    """The ledger's files; an empty table if nothing has been written yet."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.read.schema(schema).parquet(path)
    return spark.createDataFrame([], schema)


_SEEN = "blob binary, rules array<string>"
_FOUND = "blob binary, rule string, start int, end int, kind string"


def scan(docs: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES) -> None:
    """Adds to the ledger what it does not know about the texts of `docs`. Each run appends two folders' files; the
    findings come first, so that a run broken off is done again and repeated findings are read as one."""
    spark = docs.sparkSession
    names = [f"{rule.kind}@{rule.version}" for rule in rules]
    blobs = _blobs(docs).groupBy("blob").agg(F.any_value("text").alias("text"))
    seen = _read(spark, f"{ledger}/seen", _SEEN).groupBy("blob").agg(
        F.array_distinct(F.flatten(F.collect_list("rules"))).alias("done")
    )
    every = F.array(*[F.lit(n) for n in names])
    todo = (
        blobs.join(seen, "blob", "left")
        .withColumn("rules", F.array_except(every, F.coalesce("done", F.array().cast("array<string>"))))
        .where(F.size("rules") > 0)
    )
    none = F.array().cast("array<struct<rule:string,at:struct<kind:string,start:int,end:int>>>")

    def asked(rule: Rule, name: str) -> Column:
        named = F.transform(_spans(F.col("text"), rule), lambda x: F.struct(F.lit(name).alias("rule"), x.alias("at")))
        return F.when(F.array_contains("rules", name), named).otherwise(none)

    spans = F.concat(*[asked(rule, name) for rule, name in zip(rules, names, strict=True)])
    scanned = todo.select("blob", "rules", spans.alias("found"))
    path = fresh_path(spark, "scanned")
    scanned.write.parquet(path)
    written = spark.read.parquet(path)
    written.select("blob", F.explode("found").alias("f")).select(
        "blob", "f.rule", "f.at.start", "f.at.end", "f.at.kind"
    ).write.mode("append").parquet(f"{ledger}/found")
    written.select("blob", "rules").write.mode("append").parquet(f"{ledger}/seen")


def _blobs(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.unhex(F.sha2(F.encode(text, "utf-8"), 256)).alias("blob"), text.alias("text"))


def findings(docs: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Blob and spans (by start, then kind in the order of `rules`) of every blob of `docs` with findings."""
    order = F.array_position(F.array(*[F.lit(rule.kind) for rule in rules]), F.col("kind"))
    current = [f"{rule.kind}@{rule.version}" for rule in rules]
    found = _read(docs.sparkSession, f"{ledger}/found", _FOUND).where(F.col("rule").isin(current)).distinct()
    return found.groupBy("blob").agg(
        F.array_sort(F.collect_list(F.struct("start", order.alias("place"), "end", "kind"))).alias("spans")
    )


def find_secrets(
    docs: DataFrame, ledger: str | None = None, rules: tuple[Rule, ...] = RULES, name: str = "secret_spans"
) -> DataFrame:
    """The rows of `docs` with a column `name`: array of (start, place, end, kind), in code points, end exclusive.

    `ledger` is a shared folder that later runs go on with (default: a new one). Null texts count as empty; other
    columns pass unchanged (one called `name` would be there twice: pass another name); repeated rows stay; texts without secrets have an empty array; no rows give no rows. The
    spans of one blob are kept in one row, as its text is.
    """
    ledger = ledger or fresh_path(docs.sparkSession, "ledger")
    scan(docs, ledger, rules)
    blob = F.unhex(F.sha2(F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "utf-8"), 256))
    known = findings(docs, ledger, rules).select(F.col("blob").alias("_secret_blob"), F.col("spans").alias("_spans"))
    none = F.array().cast("array<struct<start:int,place:bigint,end:int,kind:string>>")
    left = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), blob.alias("_blob_of_text"))
    return left.join(known, left["_blob_of_text"] == known["_secret_blob"], "left").select(
        *[F.col("_row")[c].alias(c) for c in docs.columns], F.coalesce("_spans", none).alias(name)
    )


def masked(text: Column, spans: Column, mask: str = MASK) -> Column:
    """The text with each run of overlapping spans (sorted by start) replaced by `mask`."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(state: Column, x: Column) -> Column:
        gap = F.substring(text, state["at"] + 1, F.greatest(x["start"] - state["at"], F.lit(0)))
        fresh = (x["start"] >= state["at"]) | (state["at"] == 0)
        return F.struct(
            F.greatest(state["at"], x["end"]).alias("at"),
            F.when(fresh, F.concat(state["out"], gap, F.lit(mask))).otherwise(state["out"]).alias("out"),
        )

    done = F.aggregate(spans, start, step)
    return F.when(F.size(spans) == 0, text).otherwise(
        F.concat(done["out"], F.substring(text, done["at"] + 1, F.char_length(text)))
    )
