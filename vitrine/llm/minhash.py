"""Near-duplicate documents: universal hash minima, bands, signature check, exact check, connected components.

Documents with the same shingle set are one class, so copies meet once. First, every class that shares a band's bucket
with others is compared with two pivots of the bucket: a bucket of n near copies costs 2n pairs. What they link becomes
one component. In buckets that still hold several components, the members outside the largest one are compared with
all others, block by block inside tasks that emit links only. So two classes that share a bucket are compared, or
connected anyway. A pair at similarity 0.85 shares one of the 30 buckets of 6 minima with probability 1 - 7e-7.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialise
from .components import components

WORDS = 5
PERCENT = 85
BANDS, ROWS = 30, 6
SLACK = 0.18  # about six standard deviations of the share of equal minima
PIVOTS = 2
BLOCK = 256  # classes of a bucket that meet as many others in one step of a task
PART_ROWS = 2048  # rows of such blocks in one task's group, on average
_U = np.uint64


def _constants(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**63, n, dtype=np.uint64) * _U(2) + _U(1)


_WORD = _constants(16, 11)
_BAND = _constants(64, 13)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text; a shorter text is one shingle; no words, none."""
    import xxhash

    found = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: letters and blanks of ASCII only
    if not found:
        return np.empty(0, dtype=np.uint64)
    hashed = np.fromiter(map(xxhash.xxh64_intdigest, found), dtype=np.uint64, count=len(found))
    n = min(words, len(found))
    total = np.full(len(found) - n + 1, 0 if n == words else n, dtype=np.uint64)
    for k in range(n):
        total += hashed[k : len(hashed) - n + 1 + k] * _WORD[k]
    return np.unique(_mixed(total))


class _Sketcher:
    def __init__(self, bands: int, rows: int):
        self.bands, self.rows = bands, rows
        self.factors = _constants(bands * rows, 17)[:, None]
        self.shifts = _constants(bands * rows, 19)[:, None]

    def minima(self, found: np.ndarray) -> np.ndarray:
        least = np.full(self.bands * self.rows, 2**32 - 1, dtype=np.uint64)
        for at in range(0, len(found), 256):
            hashed = self.factors * found[None, at : at + 256]
            hashed += self.shifts
            hashed >>= _U(32)
            np.minimum(least, hashed.min(axis=1), out=least)
        return least

    def buckets(self, least: np.ndarray) -> np.ndarray:
        grid = least.reshape(self.bands, self.rows)
        keys = (grid * _BAND[: self.rows]).sum(axis=1, dtype=np.uint64)
        return _mixed(keys + np.arange(1, self.bands + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))


_SKETCH = "doc_id long, text_id binary, n_shingles long, class binary, minima array<int>, buckets array<long>"
_SKETCH_ARROW = pa.schema([
    ("doc_id", pa.int64()), ("text_id", pa.binary()), ("n_shingles", pa.int64()), ("class", pa.binary()),
    ("minima", pa.list_(pa.int32())), ("buckets", pa.list_(pa.int64())),
])


def _sketch(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    def sketched(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        sketcher = _Sketcher(bands, rows)
        for batch in batches:
            for part in (batch.slice(at, 500) for at in range(0, batch.num_rows, 500)):
                out = []
                for text in part.column(2).to_pylist():
                    found = shingles(text, words)
                    if len(found):
                        least = sketcher.minima(found)
                        out.append((
                            len(found), xxhash.xxh3_128_digest(found.tobytes()),
                            least.astype(np.uint32).view(np.int32), sketcher.buckets(least).view(np.int64),
                        ))
                    else:
                        out.append((0, None, None, None))
                yield pa.RecordBatch.from_arrays([
                    part.column(0), part.column(1), *[
                        pa.array([row[k] for row in out], kind)
                        for k, kind in enumerate(_SKETCH_ARROW.types[2:])
                    ],
                ], schema=_SKETCH_ARROW)

    return _named(docs).mapInArrow(sketched, _SKETCH)


def _named(docs: DataFrame) -> DataFrame:
    return docs.selectExpr(
        "cast(doc_id as long) doc_id", "unhex(md5(encode(cast(text as string), 'utf-8'))) text_id",
        "cast(text as string) text",
    )


def _sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """`wanted` (one row per class, with one of its texts' `text_id`) and the full shingle sets."""
    def listed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(at, 500) for at in range(0, batch.num_rows, 500)):
                found = [shingles(text, words).view(np.int64) for text in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(found, pa.list_(pa.int64()))],
                    schema=pa.schema([("class", pa.binary()), ("shingles", pa.list_(pa.int64()))]),
                )

    texts = (
        _named(docs).join(wanted.select("class", "text_id"), "text_id")
        .groupBy("class").agg(F.any_value("text").alias("text"))
    )
    sets = texts.mapInArrow(listed, "class binary, shingles array<long>")
    return sets.join(wanted.drop("text_id"), "class")


def _pivot_links(live: DataFrame, sets: DataFrame, percent: int, n_minima: int) -> DataFrame:
    """Links between the first classes of each bucket and its others: checked by minima, then by full sets."""
    place = F.row_number().over(Window.partitionBy("bucket").orderBy("class"))
    pivots = live.withColumn("place", place).where(F.col("place") <= PIVOTS).select("bucket", F.col("class").alias("b"))
    pairs = materialise(live.join(pivots, "bucket").where("class > b").selectExpr("class a", "b").distinct(), "pairs")
    a = sets.selectExpr("class a", "minima ma", "n_shingles na", "shingles sa")
    b = sets.selectExpr("class b", "minima mb", "n_shingles nb", "shingles sb")
    equal = F.aggregate(F.zip_with("ma", "mb", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    both = F.size(F.array_intersect("sa", "sb")).cast("long")
    return (
        pairs.join(a, "a").join(b, "b")
        .where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)
        .where(equal >= F.lit((percent / 100 - SLACK) * n_minima))
        .withColumn("both", both)
        .where(F.col("both") * 100 >= (F.col("na") + F.col("nb") - F.col("both")) * percent).select("a", "b")
    )


def _linked_in_block(asking: list, asked: list, percent: int) -> Iterator[tuple[bytes, bytes]]:
    """One link for every pair of labels that a class of `asking` links with a class of `asked` (class, label, set)."""
    sizes = np.array([len(s) for _, _, s in asked])
    values, codes = np.unique(np.concatenate([s for _, _, s in asked]), return_inverse=True)
    owner = np.repeat(np.arange(len(asked)), sizes)
    labels = np.array([label for _, label, _ in asked], dtype=object)
    for node, label, own in asking:
        at = np.searchsorted(values, own)
        held = np.zeros(len(values), dtype=bool)
        known = at < len(values)
        held[at[known][values[at[known]] == own[known]]] = True
        both = np.bincount(owner[held[codes]], minlength=len(asked))
        near = np.flatnonzero((100 * both >= percent * (len(own) + sizes - both)) & (labels != label))
        for other in {labels[k]: k for k in near}.values():
            yield node, asked[other][0]


def _block_links(labelled: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between components within the buckets of `labelled` (`bucket`, `class`, `label`)."""
    sizes = labelled.groupBy("bucket", "label").agg(F.count("*").alias("n"))
    buckets = sizes.groupBy("bucket").agg(
        F.max(F.struct("n", "label")).alias("top"), F.sum("n").alias("n"), F.count("*").alias("labels")
    ).where("labels > 1").selectExpr(
        "bucket", "top.label top_label", f"ceil(n / {BLOCK}) blocks", f"ceil((n - top.n) / {BLOCK}) askers"
    )
    known = materialise(
        labelled.join(buckets, "bucket").withColumn("own", F.xxhash64("class", "bucket"))
        .withColumn("rows", F.col("askers") + F.when(F.col("label") != F.col("top_label"), F.col("blocks")).otherwise(0)),
        "open",
    )
    total = known.agg(F.sum("rows")).first()[0] or 0
    every = "bucket", "class", "label"
    asked = known.select(
        *every, F.lit(False).alias("asks"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("askers") - 1)).alias("i"),
        F.expr("pmod(own, blocks)").alias("j"),
    )
    asking = known.where("label <> top_label").select(
        *every, F.lit(True).alias("asks"), F.expr("pmod(own, askers)").alias("i"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("j"),
    )
    part = F.pmod(F.xxhash64("bucket", "i", "j"), F.lit(total // PART_ROWS + 1))
    met = asked.unionAll(asking).withColumn("part", part).join(sets.select("class", "shingles"), "class")

    def linked(table: pa.Table) -> pa.Table:
        groups: dict = {}
        columns = [table.column(c).to_pylist() for c in ("bucket", "i", "j", "asks", "class", "label")]
        lists = table.column("shingles").combine_chunks()
        for k, (bucket, i, j, asks, node, label) in enumerate(zip(*columns, strict=True)):
            found = np.asarray(lists[k].values).view(np.uint64)
            groups.setdefault((bucket, i, j), ([], []))[asks].append((node, label, found))
        links = {
            (max(a, b), min(a, b))
            for asked, asking in groups.values() if asked and asking for a, b in _linked_in_block(asking, asked, percent)
        }
        return pa.table({
            "a": pa.array([a for a, _ in links], pa.binary()), "b": pa.array([b for _, b in links], pa.binary()),
        })

    return met.groupBy("part").applyInArrow(linked, "a binary, b binary")


def near_duplicates(
    docs: DataFrame, words: int = WORDS, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS, by_text: bool = False
) -> DataFrame:
    """One row per document: `doc_id`, `n_shingles`, `component_id` and `kept`.

    Words are runs between ASCII blanks, with A-Z in lower case. Two documents are linked if 100 times the shared
    shingles reach `percent` times all their shingles; components follow links. `component_id` is the smallest `doc_id`
    of the component, `kept` marks that document. Null or blank texts have no shingles and are alone. Null ids: a
    component of null ids only has a null id and is kept. Repeated rows are each listed, with the same result. Other
    columns are not read; no rows give no rows.

    With `by_text` two columns follow: `text_id` (MD5 of the text, null for a null text) and `first`, which is true for the
    rows of one text and id of each component (the smallest id, nulls last, then the smallest `text_id`), so that rows with
    null or repeated ids are told apart; every row without shingles is a first.
    """
    sketch = materialise(_sketch(docs, words, bands, rows), "sketch")
    members = (
        sketch.where("n_shingles > 0").select("class", "buckets").distinct()
        .select(F.explode("buckets").alias("bucket"), "class")
    )
    shared = members.groupBy("bucket").count().where("count > 1").select("bucket")
    live = materialise(members.join(shared, "bucket"), "buckets")
    wanted = sketch.where("n_shingles > 0").groupBy("class").agg(
        F.min(F.struct("text_id", "n_shingles", "minima")).alias("c")
    ).join(live.select("class").distinct(), "class").select("class", "c.*")
    sets = materialise(_sets(docs, wanted, words), "sets")

    links = materialise(_pivot_links(live, sets, percent, bands * rows), "links")
    labels = components(links)
    labelled = live.join(labels, live["class"] == labels["node"], "left").select(
        "bucket", "class", F.coalesce("label", "class").alias("label")
    )
    more = materialise(_block_links(labelled, sets, percent), "links")
    labels = components(labels.selectExpr("node a", "label b").unionAll(more))

    listed = sketch.select("doc_id", "n_shingles", "class", *(["text_id"] if by_text else []))
    lead = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_id") if by_text else F.col("doc_id")
    least = (
        listed.join(labels, listed["class"] == labels["node"])
        .groupBy("label").agg(F.min(lead).alias("linked_id"))
    )
    linked = labels.join(least, "label").select(F.col("node").alias("class"), "linked_id")
    own = listed.where("n_shingles > 0").groupBy("class").agg(F.min(lead).alias("own_id"))
    known = own.join(linked, "class", "left").select("class", F.coalesce("linked_id", "own_id").alias("least_id"))
    least_id = F.col("least_id.doc_id") if by_text else F.col("least_id")
    component = F.when(F.col("n_shingles") > 0, least_id).otherwise(F.col("doc_id"))
    first = F.when(F.col("n_shingles") > 0, F.col("least_id") == lead).otherwise(True)
    return listed.join(known, "class", "left").select(
        "doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"),
        *(["text_id", first.alias("first")] if by_text else []),
    )
