"""Language identification with a string kernel, Nyström landmarks and kernel ridge regression, one against the rest.

The kernel is the blended spectrum of n-gram presence: the number of n-grams of 1 to 3 characters that two texts share
(n-grams are hashed to `BUCKETS` places), over the geometric mean of their own numbers. Landmarks and training rows are
a bounded sample of labelled documents; every text is scored whole, in batches, by two matrix products: presence times
landmarks, and kernel values times coefficients.

The score tells the learned languages apart, not whether a text is in one of them. For that a `Gate` holds the n-grams of
each language's training words: a text is in a learned language if enough of the n-grams of its own words are known.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

BUCKETS = 1 << 14
TRAIN_PER_LANGUAGE = 256  # labelled documents kept of each language, those with the smallest id hash
LANDMARKS = 128
RIDGE = 0.01
FOLDS = 5
UNKNOWN = "und"
KNOWN_IN = 128  # an n-gram is known in a language if one in so many of its training rows has it, one at least
GATE_ROWS = 16  # a language with fewer training rows turns no text away that is predicted as it
GATE_QUANTILE, GATE_SHARE = 0.01, 0.75  # the limit: so much of the share that this quantile of the training rows has
_BATCH = 128
_FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], dtype=np.uint64)


def presence(text: str, row: np.ndarray) -> None:
    """Marks in `row` (booleans) the hashed n-grams of a text, in lower case."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64) + np.uint64(1)
    hashed = np.zeros(len(points), dtype=np.uint64)
    for n, factor in enumerate(_FACTORS):
        if len(points) <= n:
            break
        hashed = hashed[: len(points) - n] * np.uint64(1_000_003) + points[n:]
        row[(((hashed + np.uint64(n)) * factor) >> np.uint64(7)) % np.uint64(BUCKETS)] = True


_RUNS = re.compile(r"[^\W_]+")


def words_only(text: str) -> str:
    """The words of letters only, so that numbers, marks and secrets neither speak for a language nor against it; all runs
    of letters and digits where there is no such word."""
    found = _RUNS.findall(text)
    return " ".join([w for w in found if w.isalpha()] or found)


@dataclass
class Gate:
    known: np.ndarray  # packed presence bits of the n-grams known in each language
    limits: np.ndarray  # least share of known n-grams; nan for a language with too few training rows

    def passed(self, rows: np.ndarray, dense: np.ndarray, best: np.ndarray) -> np.ndarray:
        """Whether texts (presence of the n-grams of their words) are in any language, or in one (`best`) without limit."""
        share = (rows @ dense.T) / np.maximum(rows.sum(axis=1), 1)[:, None]
        return (share >= self.limits).any(axis=1) | np.isnan(self.limits)[best]


@dataclass
class Model:
    languages: list[str]
    landmarks: np.ndarray  # packed presence bits
    coefficients: np.ndarray
    gate: Gate | None = None

    def scores(self, rows: np.ndarray, dense: np.ndarray) -> np.ndarray:
        return kernel(rows, dense) @ self.coefficients


def kernel(rows: np.ndarray, landmarks: np.ndarray) -> np.ndarray:
    own, theirs = rows.sum(axis=1), landmarks.sum(axis=1)
    return (rows @ landmarks.T) / np.sqrt(np.maximum(own, 1))[:, None] / np.sqrt(np.maximum(theirs, 1))


def in_training(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % FOLDS != 0


def _gate(packed: np.ndarray, number: np.ndarray, languages: int) -> Gate:
    """The share of a training row's n-grams that its language's other rows make known sets the limit of the language."""
    known, limits = [], np.full(languages, np.nan)
    for k in range(languages):
        rows = np.unpackbits(packed[number == k], axis=1)
        counts, least = rows.sum(axis=0, dtype=np.int64), max(1, len(rows) // KNOWN_IN)
        known.append(counts >= least)
        if len(rows) >= GATE_ROWS:
            share = rows @ (counts > least).astype(np.int64) / np.maximum(rows.sum(axis=1, dtype=np.int64), 1)
            limits[k] = GATE_SHARE * np.quantile(share, GATE_QUANTILE)
    return Gate(np.packbits(np.array(known), axis=1), limits)


def fit(
    docs: DataFrame, per_language: int = TRAIN_PER_LANGUAGE, landmarks: int = LANDMARKS, gated: bool = False
) -> Model:
    """Learns from `text` and `lang` of training documents. Only presence bits of the sample come to the driver: at most
    `per_language` rows of 2 KB for each language, twice that with a gate. Without labelled texts the model knows no
    language."""
    labelled = docs.select("doc_id", "text", "lang").where(in_training(F.col("doc_id")) & F.col("lang").isNotNull())
    labelled = labelled.where("text is not null").withColumn("h", F.xxhash64("doc_id"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    cuts = (
        labelled.select("lang", "h").withColumn("place", place).where(F.col("place") <= per_language)
        .groupBy("lang").agg(F.max("h").alias("cut"))
    )

    def packed_bits(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            row = np.zeros(BUCKETS, dtype=bool)
            presence(text, row)
            out.append(np.packbits(row).tobytes())
        return pd.Series(out)

    @pandas_udf("binary")
    def bits(texts: pd.Series) -> pd.Series:
        return packed_bits(texts)

    @pandas_udf("binary")
    def word_bits(texts: pd.Series) -> pd.Series:
        return packed_bits(texts.map(words_only))

    # One row per language, of which the driver keeps many more rows below: small enough to go to every executor, so that
    # the texts of a frequent language need not meet in one task.
    sample = labelled.join(F.broadcast(cuts), "lang").where("h <= cut").dropDuplicates(["lang", "h"])
    columns = [bits("text").alias("bits"), *([word_bits("text").alias("words")] if gated else [])]
    rows = sample.select("lang", "h", *columns).orderBy("lang", "h").collect()
    languages = sorted({r["lang"] for r in rows})
    if not rows:
        return Model([], np.zeros((0, BUCKETS // 8), np.uint8), np.zeros((0, 0), np.float32))
    packed = np.array([np.frombuffer(r["bits"], np.uint8) for r in rows])
    number = np.array([languages.index(r["lang"]) for r in rows])
    each = max(1, landmarks // len(languages))
    chosen = np.concatenate([np.flatnonzero(number == k)[:each] for k in range(len(languages))])
    x = np.unpackbits(packed, axis=1).astype(np.float32)
    near = kernel(x, x[chosen]).astype(np.float64)
    values, vectors = np.linalg.eigh(near[chosen])
    kept = values > 1e-6 * values.max()
    root = vectors[:, kept] / np.sqrt(values[kept])
    features = near @ root
    wanted = np.where(number[:, None] == np.arange(len(languages)), 1.0, -1.0)
    gram = features.T @ features + RIDGE * len(rows) / 100 * np.eye(features.shape[1])
    solved = root @ np.linalg.solve(gram, features.T @ wanted)
    gate = _gate(np.array([np.frombuffer(r["words"], np.uint8) for r in rows]), number, len(languages)) if gated else None
    return Model(languages, packed[chosen], solved.astype(np.float32), gate)


def predicted(model: Model, text: Column) -> Column:
    """Struct of `lang_pred` and `score` (0 to 1): `und` and 0 for a null text, one without letters, or no model."""
    @pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        dense = np.unpackbits(model.landmarks, axis=1).astype(np.float32)
        for texts in batches:
            languages = np.full(len(texts), UNKNOWN, dtype=object)
            scores = np.zeros(len(texts))
            known = [k for k, t in enumerate(texts) if t is not None and any(map(str.isalpha, t))] if model.languages else []
            for at in range(0, len(known), _BATCH):
                own = known[at : at + _BATCH]
                rows = np.zeros((len(own), BUCKETS), dtype=bool)
                for row, k in zip(rows, own):
                    presence(texts.iloc[k], row)
                found = model.scores(rows.astype(np.float32), dense)
                best = found.argmax(axis=1)
                languages[own] = [model.languages[k] for k in best]
                scores[own] = np.clip((found[np.arange(len(own)), best] + 1) / 2, 0, 1).round(6)
            yield pd.DataFrame({"lang_pred": languages, "score": scores})

    return predict(text.cast("string"))


def known_language(model: Model, text: Column) -> Column:
    """The learned language that a text is in, empty where the (gated) model claims the text for none of its languages, null
    if it is in no learned language; without languages empty for any text with letters. Evaluated once a row."""
    @pandas_udf("string")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        dense = np.unpackbits(model.landmarks, axis=1).astype(np.float32)
        known = np.unpackbits(model.gate.known, axis=1).astype(np.float32) if model.languages else None
        names = np.array([*model.languages, ""], dtype=object)
        for texts in batches:
            kept = np.array([t is not None and any(map(str.isalpha, t)) for t in texts], dtype=bool)
            found = np.full(len(kept), "", dtype=object)
            lettered = np.flatnonzero(kept) if model.languages else []
            for at in range(0, len(lettered), _BATCH):
                own = lettered[at : at + _BATCH]
                rows = np.zeros((len(own), BUCKETS), dtype=bool)
                words = np.zeros_like(rows)
                for row, word_row, k in zip(rows, words, own):
                    presence(texts.iloc[k], row)
                    presence(words_only(texts.iloc[k]), word_row)
                values = model.scores(rows.astype(np.float32), dense)
                best = values.argmax(axis=1)
                kept[own] = model.gate.passed(words.astype(np.float32), known, best)
                found[own] = names[np.where(values.max(axis=1) > 0, best, -1)]
            found[~kept] = None
            yield pd.Series(found)

    return judge.asNondeterministic()(text.cast("string"))


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """The rows of `docs` with a struct column `language` (`lang_pred`, `score`); the model is fitted on `docs` unless given.

    Only `text` is read for a prediction. Null texts, texts without letters, and any text where nothing could be learned
    are `und` with score 0; other columns pass unchanged (select what is needed where one is called `language`); repeated
    rows stay; no rows give no rows.
    """
    return docs.select("*", predicted(model or fit(docs), F.col("text")).alias("language"))
