"""A corpus pipeline: language, near-duplicates, secrets, mixture, packed sequences.

Each stage takes (spark, docs, folder) and returns the documents it kept, with their columns; the last returns pieces of
packed sequences. Between stages `run` writes Parquet to the shared folder and reads it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.llm import language, minhash, mixing, packing, secrets
from vitrine.storage import materialise

NEAR_PERCENT = 80  # shared shingles of five words, in percent, from which two documents are near; op2 has its own 85
NEAR_BANDS, NEAR_ROWS = 36, 5  # two documents at 0.8 share no bucket with probability 6e-7; 180 minima, as in op2
ORACLE_SQL = None  # tokens and kernels are beyond SQL; tests compare with a brute-force version


def known_language(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents in a language that the model learned from labelled documents of this input, with that language as `lang`,
    by which the mixture goes; a label stays only where the model claims the text for no language. Texts without letters are
    in none. Where nothing is labelled nothing can be learned, and all documents with letters stay."""
    name = _unused(docs, "found_language")
    found = docs.withColumn(name, language.known_language(language.fit(docs, gated=True), F.col("text")))
    own = F.when(F.col(name) != "", F.col(name)).otherwise(F.col("lang"))
    return found.where(F.col(name).isNotNull()).withColumn("lang", own).select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of near duplicates, whatever the ids; rows that repeat an id and a text are one document."""
    found = minhash.near_duplicates(docs, percent=NEAR_PERCENT, bands=NEAR_BANDS, rows=NEAR_ROWS, by_text=True)
    first = found.where("first").select(F.col("doc_id").alias("_id"), F.col("text_id").alias("_text"))
    text_id = F.unhex(F.md5(F.encode(docs["text"].cast("string"), "utf-8")))
    left = docs.join(
        first, docs["doc_id"].cast("long").eqNullSafe(first["_id"]) & text_id.eqNullSafe(first["_text"]), "left_semi")
    return left.dropDuplicates(["doc_id", "text"])


def _unused(docs: DataFrame, name: str) -> str:
    while name in docs.columns:
        name += "_"
    return name


def without_secrets(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """All documents, secrets in their texts replaced."""
    spans = _unused(docs, "secret_spans")
    found = secrets.find_secrets(docs, name=spans)
    clean = found.withColumn("text", secrets.masked(F.col("text"), F.col(spans)))
    if "n_chars" in docs.columns:
        clean = clean.withColumn(
            "n_chars", F.when(F.size(spans) > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars")))
    return clean.select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents as often as the mixture takes them, in the shuffled order of their shards. Each language of a source, as the
    language stage found it, is taken at the source's rate. Documents are whole: the one at a language's cut in its source
    goes in if the mixture wants at least half of it."""
    taken = mixing.mix(docs, by_text=True, carry=True, strata="lang").select("row", "size", F.explode("copies").alias("copy"))
    whole = taken.where(2 * F.col("copy.words") >= F.col("size"))
    shuffled = whole.repartition("copy.shard", F.pmod("copy.key", F.lit(16))).sortWithinPartitions("copy.shard", "copy.key")
    return shuffled.select(*[F.col("row")[c].alias(c) for c in docs.columns])


def packed(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Pieces of documents in sequences, with their token ids."""
    return packing.pack(docs)


STAGES = [
    ("language ID", known_language),
    ("near-dedup", one_of_each),
    ("secrets", without_secrets),
    ("mixture", mixed),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
