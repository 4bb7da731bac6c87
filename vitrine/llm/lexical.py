"""Ranked lexical search in norm buckets.

Documents are sparse impact vectors over the terms that the items ask for, items are weight vectors over the same terms,
and a score is their inner product. Each coordinate is spread as the square root of the term's weight on both sides, so
that lengths bound scores tightly. Vectors are range-partitioned by falling length; a task walks through its buckets
of `BUCKET_ROWS` vectors and, for every item with a best list already full,

- leaves a bucket out if item length times largest vector length stays below the item's threshold (Cauchy-Schwarz),
- else turns the threshold into an interval for each coordinate of unit vectors; coordinates whose lower end is positive
  demand the term, and only documents inside all of the strongest such intervals go on,
- and rescores what is left exactly, in 64-bit integers, from the unscaled impacts.

Thresholds start from the longest vectors of the whole table and rise within each task; bounds give way by `SLACK`, so a
score equal to the threshold is never lost. The result is exact.

Items are answered in blocks of about `ITEM_TERMS` terms, each sent to the tasks as arrays; the documents are scanned once
a block. Defined cases: a null or termless item has no rows; items that share an id are one item; documents without a
term count for nothing and are never found; rows that share a doc_id are documents of their own (null ids order last);
empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..storage import materialise

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
TOP = 10
BUCKET_ROWS = 4096
ITEM_TERMS = 1_000_000
SEED_ROWS = 2048  # longest vectors, from which the first thresholds come
FOCUS = 5  # coordinates whose intervals are looked at
SLACK = 1e-9
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Bytes of a text: A-Z lowered, everything between terms a blank; bytes from 0x80 on belong to terms.
_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def _kind(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()


def _column(batch: pa.RecordBatch, name: str):
    return batch.column(batch.schema.get_field_index(name))


@dataclass
class Items:
    """A block of items; an item's terms are numbers in the block's own vocabulary."""

    ids: list
    terms: list[np.ndarray]
    times: list[np.ndarray]
    vocabulary: dict[bytes, int]


def item_blocks(items: DataFrame, item_terms: int = ITEM_TERMS) -> Iterator[Items]:
    words = F.regexp_extract_all(F.translate("text", _UPPER, _LOWER), F.lit(TERM), 0)
    counts = materialise(
        items.select("item_id", F.explode(words).alias("term")).groupBy("item_id", "term").agg(F.count("*").alias("times")),
        "item-terms",
    )
    blocks = -(-counts.count() // item_terms)
    for block in range(blocks):
        rows = counts.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).collect()
        vocabulary = {t.encode(): k for k, t in enumerate(sorted({r["term"] for r in rows}))}
        own = defaultdict(list)
        for r in rows:
            own[r["item_id"]].append((vocabulary[r["term"].encode()], r["times"]))
        ids = sorted(own, key=lambda k: (k is None, k))
        arrays = [np.array(sorted(own[k]), dtype=np.int64) for k in ids]
        yield Items(ids, [a[:, 0] for a in arrays], [a[:, 1] for a in arrays], vocabulary)


def term_counts(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """Of every document: `n`, its terms with repeats, and the times of the vocabulary's terms in it."""
    schema = f"doc_id {_kind(docs, 'doc_id')}, n long, terms array<int>, tf array<long>"

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = vocabulary.get
        for batch in batches:
            sizes, terms, times = [], [], []
            for text in _column(batch, "text").cast(pa.binary()):
                words = (text.as_py() or b"").translate(_BYTES).split()
                found = Counter(map(number, words))
                found.pop(None, None)
                sizes.append(len(words))
                terms.append(list(found))
                times.append(list(found.values()))
            yield pa.RecordBatch.from_arrays(
                [_column(batch, "doc_id"), pa.array(sizes, pa.int64()), pa.array(terms, pa.list_(pa.int32())),
                 pa.array(times, pa.list_(pa.int64()))], ["doc_id", "n", "terms", "tf"])

    return docs.select("doc_id", "text").mapInArrow(counted, schema)


def impacts(counts: DataFrame, documents: int, total: int, weight: np.ndarray) -> DataFrame:
    """Impact vectors and their lengths; documents without a term of the vocabulary have none."""
    m = F.expr(f"cast(25 + (75 * cast(n as decimal(20,0)) * {documents}) div {total} as long)")
    schema = f"doc_id {_kind(counts, 'doc_id')}, terms array<int>, impact array<long>, length double"
    root = np.sqrt(weight.astype(np.float64))

    def scaled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, tf = _column(batch, "terms"), _column(batch, "tf").flatten().to_numpy(zero_copy_only=False)
            terms = lists.flatten().to_numpy(zero_copy_only=False)
            sizes = np.diff(lists.offsets.to_numpy())
            row = np.repeat(np.arange(len(sizes)), sizes)
            m_row = _column(batch, "m").to_numpy(zero_copy_only=False)[row]
            impact = (1_000_000_000 * tf) // (1000 * tf + 8 * m_row)
            length = np.sqrt(np.bincount(row, (root[terms] * impact) ** 2, minlength=len(sizes)))
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [_column(batch, "doc_id"), pa.ListArray.from_arrays(offsets, pa.array(terms, pa.int32())),
                 pa.ListArray.from_arrays(offsets, pa.array(impact, pa.int64())), pa.array(length)],
                ["doc_id", "terms", "impact", "length"])

    return counts.where(F.size("terms") > 0).select("doc_id", "terms", "tf", m.alias("m")).mapInArrow(scaled, schema)


class Ranking:
    """The best documents of each item among the vectors seen, in order of falling length."""

    def __init__(self, items: Items, weight: np.ndarray, least: np.ndarray, top: int):
        self.items, self.top, self.least = items, top, least.copy()
        self.gain = [weight[t] * k for t, k in zip(items.terms, items.times)]  # weight times repeats, integers
        root = np.sqrt(weight.astype(np.float64))
        spread = [root[t] * k for t, k in zip(items.terms, items.times)]
        self.length = np.array([math.sqrt(float(v @ v)) for v in spread])
        self.unit = [v / n if n else v for v, n in zip(spread, self.length)]
        self.root, self.best = root, [[] for _ in items.ids]
        self.scored = 0  # vectors rescored, over all items

    def add(self, ids: list, starts: np.ndarray, terms: np.ndarray, impact: np.ndarray, lengths: np.ndarray) -> None:
        """One bucket of vectors: `starts` has the first place of each in `terms` and `impact`, and the end."""
        row = np.repeat(np.arange(len(ids)), np.diff(starts))
        order = np.argsort(terms, kind="stable")
        by_row, by_impact = row[order], impact[order]
        by_unit = self.root[terms[order]] * by_impact / np.maximum(lengths[by_row], 1e-300)
        edges = np.searchsorted(terms[order], np.arange(len(self.root) + 1))
        longest = lengths.max()
        for k in np.flatnonzero(self.length * longest * (1 + SLACK) >= self.least):
            wanted = self.items.terms[k]
            inside = None
            if self.least[k] > 0:
                cosine = min(1.0, self.least[k] / (self.length[k] * longest) * (1 - SLACK))
                wide = np.sqrt((1 - cosine**2) * np.maximum(1 - self.unit[k] ** 2, 0))
                low = self.unit[k] * cosine - wide - SLACK
                high = np.where(self.unit[k] > cosine, 1.0, self.unit[k] * cosine + wide) + SLACK
                strong = np.argsort(-low)[:FOCUS]
                for f in strong[low[strong] > 0]:
                    at = slice(edges[wanted[f]], edges[wanted[f] + 1])
                    fits = by_row[at][(by_unit[at] >= low[f]) & (by_unit[at] <= high[f])]
                    inside = fits if inside is None else np.intersect1d(inside, fits, assume_unique=True)
                    if not len(inside):
                        break
            if inside is not None and not len(inside):
                continue
            score = np.zeros(len(ids), dtype=np.int64)
            for t, gain in zip(wanted, self.gain[k]):
                at = slice(edges[t], edges[t + 1])
                score[by_row[at]] += gain * by_impact[at]  # a vector has a term once
            kept = np.flatnonzero(score > 0) if inside is None else inside[score[inside] > 0]
            self.scored += len(kept)
            kept = kept[score[kept] >= self.least[k]]
            if len(kept) > self.top:
                kept = kept[score[kept] >= np.partition(score[kept], -self.top)[-self.top]]
            if len(kept):
                own = self.best[k] + [(int(score[j]), ids[j]) for j in kept]
                own.sort(key=lambda x: (-x[0], x[1] is None, x[1]))
                self.best[k] = own[: self.top]
                if len(own) >= self.top:
                    self.least[k] = max(self.least[k], self.best[k][-1][0])


def ranked_in_tasks(
    vectors: DataFrame, items: Items, weight: np.ndarray, least: np.ndarray, top: int, bucket_rows: int = BUCKET_ROWS
) -> DataFrame:
    """At most `top` rows of each item from each task: item (its place in the block), doc_id, score."""
    found = f"doc_id {_kind(vectors, 'doc_id')}, item int, score long"
    doc_type = to_arrow_type(vectors.schema["doc_id"].dataType)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranking = Ranking(items, weight, least, top)
        for batch in batches:
            for at in range(0, batch.num_rows, bucket_rows):
                part = batch.slice(at, bucket_rows)
                lists = _column(part, "terms")
                starts = lists.offsets.to_numpy()
                ranking.add(
                    _column(part, "doc_id").to_pylist(), starts - starts[0],
                    lists.flatten().to_numpy(zero_copy_only=False),
                    _column(part, "impact").flatten().to_numpy(zero_copy_only=False),
                    _column(part, "length").to_numpy(zero_copy_only=False))
        rows = [(doc, k, score) for k, own in enumerate(ranking.best) for score, doc in own]
        if rows:
            docs, numbers, scores = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(docs, doc_type), pa.array(numbers, pa.int32()), pa.array(scores, pa.int64())],
                ["doc_id", "item", "score"])

    return vectors.mapInArrow(best, found)


def search(items: DataFrame, docs: DataFrame, top: int = TOP, item_terms: int = ITEM_TERMS) -> DataFrame:
    """item_id, rank, doc_id and score of each item's `top` documents."""
    out = None
    for block in item_blocks(items, item_terms):
        counts = materialise(term_counts(docs, block.vocabulary), "term-counts")
        sizes = counts.where("n > 0").agg(F.count("*").alias("n"), F.sum("n").alias("total")).first()
        df = np.zeros(len(block.vocabulary), dtype=np.int64)
        for r in counts.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # one row a term of the block
            df[r["t"]] = r["count"]
        weight = np.array([math.floor(1000 * math.log((2 * sizes["n"] + 2) / (2 * int(k) + 1))) for k in df], dtype=np.int64)
        vectors = materialise(impacts(counts, sizes["n"], sizes["total"] or 1, weight), "impacts")
        longest = vectors.orderBy(F.desc("length"), F.xxhash64("doc_id")).limit(SEED_ROWS).toArrow()
        seed = Ranking(block, weight, np.zeros(len(block.ids)), top)
        for batch in longest.combine_chunks().to_batches():
            lists = _column(batch, "terms")
            seed.add(
                _column(batch, "doc_id").to_pylist(), lists.offsets.to_numpy(),
                lists.flatten().to_numpy(zero_copy_only=False),
                _column(batch, "impact").flatten().to_numpy(zero_copy_only=False),
                _column(batch, "length").to_numpy(zero_copy_only=False))
        # Vectors of equal length (copies) are dealt by their ids as well.
        sorted_by = [F.desc("length"), F.xxhash64("doc_id")]
        spread = vectors.repartitionByRange(*sorted_by).sortWithinPartitions(*sorted_by)
        found = ranked_in_tasks(spread, block, weight, seed.least, top)
        names = docs.sparkSession.createDataFrame(
            list(enumerate(block.ids)), schema=f"item int, item_id {_kind(items, 'item_id')}")
        place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
        best = (
            found.withColumn("rank", place).where(F.col("rank") <= top).join(names, "item")
            .select("item_id", "rank", "doc_id", "score")
        )
        out = best if out is None else out.unionByName(best)
    if out is None:
        schema = f"item_id {_kind(items, 'item_id')}, rank int, doc_id {_kind(docs, 'doc_id')}, score long"
        return docs.sparkSession.createDataFrame([], schema)
    return out


# The same ranking by a join of all documents' terms with the items' terms.
ORACLE_SQL = rf"""
WITH lower_docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
        translate(text, '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
own AS (SELECT r, doc_id, len(ts)::BIGINT AS n FROM lower_docs WHERE len(ts) > 0),
everything AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS total FROM own),
q AS (SELECT item_id, t, count(*)::BIGINT AS times FROM (SELECT item_id, unnest(regexp_extract_all(
        translate(text, '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark) GROUP BY ALL),
tf AS (SELECT r, t, count(*)::BIGINT AS tf FROM (SELECT r, unnest(ts) AS t FROM lower_docs)
       WHERE t IN (SELECT t FROM q) GROUP BY r, t),
w AS (SELECT t, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w
      FROM (SELECT t, count(*) AS df FROM tf GROUP BY t), everything),
s AS (SELECT item_id, tf.r, sum(times * w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 8 * (25 + (75 * n * docs) // total))))::BIGINT AS score
      FROM q JOIN tf USING (t) JOIN w USING (t) JOIN own ON own.r = tf.r, everything GROUP BY item_id, tf.r),
placed AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank
           FROM s JOIN own USING (r) WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM placed WHERE rank <= {TOP}
"""
