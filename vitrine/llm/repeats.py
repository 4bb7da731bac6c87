"""Removal of long repeated byte strings across documents.

Every window of `length` bytes has an anchor: the position of its least `core`-byte hash. Consecutive windows with one
anchor form a segment, so equal windows lie at the same place of segments with the same core. Segments that are equal as
a whole (by two 64-bit hashes) settle all their windows without moving text. What is left, segments of one core that
differ somewhere, is gathered core by core, in blocks of bounded size; in each block a suffix array, built by linear
grouping, brings equal windows side by side. Cores with more segments than a block holds compare the windows that no
block has settled once more, by hash, across blocks.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import partial
from os.path import commonprefix

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialise
from .suffixes import suffix_array

LENGTH, CORE = 400, 100
BLOCK = 24  # segments sorted together
PART_BLOCKS = 20
_U = np.uint64
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_PIECE = 1 << 19  # bytes of a text that are hashed at a time: a worker holds some hundred bytes for each
_HELD, _ROWS = 1 << 22, 20_000  # bytes of texts that a worker takes at a time, segments that it holds before it gives them out


def _powers(base: int, n: int) -> np.ndarray:
    factors = np.full(n + 1, base, dtype=np.uint64)
    factors[0] = 1
    return np.cumprod(factors)


class _Hasher:
    """Hashes of substrings from running sums: the sum of byte times base^place, moved to place 0."""

    def __init__(self):
        self.powers = self.inverses = [np.ones(1, np.uint64)] * 2

    def sums(self, raw: np.ndarray) -> list[np.ndarray]:
        if len(self.powers[0]) <= len(raw):
            size = max(2 * len(self.powers[0]), len(raw) + 1)
            self.powers = [_powers(b, size) for b in _BASES]
            self.inverses = [_powers(pow(b, -1, 2**64), size) for b in _BASES]
        symbols = raw.astype(np.uint64) + _U(1)
        none = np.zeros(1, np.uint64)
        return [np.concatenate([none, np.cumsum(symbols * p[: len(raw)])]) for p in self.powers]

    def of(self, sums: list[np.ndarray], start: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
        return [(s[end] - s[start]) * inverse[start] for s, inverse in zip(sums, self.inverses)]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(29))


def segments(raw: np.ndarray, hasher: _Hasher, length: int, core: int) -> tuple[np.ndarray, ...]:
    """First window, number of windows, anchor, core hash and two hashes of every segment of a text's bytes."""
    n, width = len(raw), length - core + 1
    sums = hasher.sums(raw)
    at = np.arange(n - core + 1)
    cores = _mixed(hasher.of(sums[:1], at, at + core)[0])
    keys = (cores & _U(0xFFFFFFFFFF000000)) | at.astype(np.uint64)
    rows = -(-len(keys) // width)
    grid = np.full(rows * width, 2**64 - 1, dtype=np.uint64)
    grid[: len(keys)] = keys
    grid = grid.reshape(rows, width)
    upto = np.minimum.accumulate(grid, axis=1).ravel()
    onward = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = n - length + 1
    anchor = (np.minimum(onward[:windows], upto[width - 1 : width - 1 + windows]) & _U(0xFFFFFF)).astype(np.int64)
    first = np.concatenate([[0], np.flatnonzero(anchor[1:] != anchor[:-1]) + 1])
    count = np.diff(np.concatenate([first, [windows]]))
    anchor = anchor[first]
    h1, h2 = hasher.of(sums, first, first + count + length - 1)
    return first, count, anchor, cores[anchor], _mixed(h1), _mixed(h2)


_CLASS = "core long, h1 long, h2 long, lead int, windows int"


def _slices(batch: pa.RecordBatch, rows: int) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of `batch`: at most `rows` rows, and `_HELD` bytes of `raw` unless one row alone has more."""
    first = held = 0
    for k, n in enumerate(pc.binary_length(batch.column("raw")).to_pylist()):
        if k > first and (k - first == rows or held + n > _HELD):
            yield batch.slice(first, k - first)
            first, held = k, 0
        held += n
    if batch.num_rows:
        yield batch.slice(first)


_SEGMENTS = "text_id binary, core long, h1 long, h2 long, lead int, windows int, starts array<long>"


def _listed(batches: Iterable[pa.RecordBatch], length: int, core: int, piece: int) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in _SEGMENTS.split(", ")]
    kinds = {"text_id": pa.binary(), "lead": pa.int32(), "windows": pa.int32(), "starts": pa.list_(pa.int64())}
    hasher, out = _Hasher(), {k: [] for k in names}

    def taken() -> pa.RecordBatch:
        made = pa.RecordBatch.from_pydict({k: pa.array(v, kinds.get(k, pa.int64())) for k, v in out.items()})
        for v in out.values():
            v.clear()
        return made

    for batch in batches:
        for part in _slices(batch, 200):
            for text_id, raw in zip(part.column("text_id").to_pylist(), part.column("raw").to_pylist(), strict=True):
                raw = np.frombuffer(raw, np.uint8)
                for shift in range(0, max(1, len(raw) - length + 1), piece):
                    first, count, anchor, *hashes = segments(raw[shift : shift + piece + length - 1], hasher, length, core)
                    found: dict[tuple, list[int]] = {}
                    for s, w, lead, *key in zip(
                        (first + shift).tolist(), count.tolist(), (anchor - first).tolist(),
                        *[h.view(np.int64).tolist() for h in hashes],
                    ):
                        found.setdefault((*key, lead, w), []).append(s)
                    out["text_id"] += [text_id] * len(found)
                    for name, values in zip(("core", "h1", "h2", "lead", "windows"), zip(*found)):
                        out[name] += values
                    out["starts"] += found.values()
                    if len(out["starts"]) >= _ROWS:
                        yield taken()
            yield taken()


def _occurrences(docs: DataFrame, length: int, core: int) -> DataFrame:
    """Segments of every text: their class, where they start in it (a row for each piece of a long text), and how often."""
    return _texts(docs).where(F.octet_length("raw") >= length).select("text_id", "raw").mapInArrow(
        partial(_listed, length=length, core=core, piece=_PIECE), _SEGMENTS)


def _texts(docs: DataFrame) -> DataFrame:
    raw = F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "utf-8")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), raw.alias("raw")).withColumn(
        "text_id", F.unhex(F.md5("raw")))


def _cut_out(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """`wanted` segments (class columns, `text_id`, `start`) with their bytes."""
    per_text = wanted.groupBy("text_id").agg(
        F.collect_list(F.struct("core", "h1", "h2", "lead", "windows", "copies", "start")).alias("s"))
    joined = _texts(docs).join(per_text, "text_id").select("s", "raw").dropDuplicates(["s"])
    return joined.select("raw", F.explode("s").alias("s")).select(
        "s.*", F.expr(f"substring(raw, cast(s.start + 1 as int), s.windows + {length - 1})").alias("bytes"))


_BLOCK_ROWS = "core long, h1 long, h2 long, lead int, windows int, at int, until int, lead_at int, w1 long, w2 long, n int"


def _most_shared(parts: list[bytes]) -> list[int]:
    """Length of the longest start that each part shares with another one."""
    longest = [0] * len(parts)
    order = sorted(range(len(parts)), key=parts.__getitem__)
    for one, other in zip(order, order[1:]):
        shared = len(commonprefix([parts[one], parts[other]]))
        longest[one], longest[other] = max(longest[one], shared), max(longest[other], shared)
    return longest


def repeated_windows(block: list[tuple[int, int, bytes]], length: int, core: int) -> list[np.ndarray]:
    """For segments (lead, windows, bytes) of one core: which of their windows another one, too, has.

    A repeated window lies within what its segment shares with some other one before the core and with some other one
    after it. Segments are cut to that, or left out where it is shorter than a window; the suffix array of the rest
    decides.
    """
    around = length - core
    before = _most_shared([raw[:lead][::-1] for lead, _, raw in block])
    after = _most_shared([raw[lead + core :] for lead, _, raw in block])
    symbols: list[int] = []
    start_of: dict[int, tuple[int, int]] = {}
    for number, ((lead, windows, raw), left, right) in enumerate(zip(block, before, after)):
        if left + right < around:
            continue
        place = len(symbols) - (lead - left)
        for k in range(lead - left, min(windows, lead - max(0, around - right) + 1)):
            start_of[place + k] = (number, k)
        symbols += raw[lead - left : lead]
        symbols.append(256)  # the core, which all share
        symbols += raw[lead + core : lead + core + right]
        symbols.append(257 + number)
    packed, width = np.array(symbols, dtype="<u4").tobytes(), 4 * (around + 1)
    found = [np.zeros(windows, dtype=bool) for _, windows, _ in block]
    last = None
    for at in suffix_array(symbols) if start_of else ():
        if at not in start_of:
            continue
        if last is not None and packed[4 * at : 4 * at + width] == packed[4 * last : 4 * last + width]:
            for number, k in (start_of[at], start_of[last]):
                found[number][k] = True
        last = at
    return found


def _sorted_blocks(cut: DataFrame, parts: int, length: int, core: int) -> DataFrame:
    def settled(table: pa.Table) -> pa.Table:
        hasher, groups = _Hasher(), {}
        for row in table.to_pylist():
            groups.setdefault((row["core"], row["block"]), []).append(row)
        out: list[tuple] = []
        for rows in groups.values():
            if len(rows) == 1 and rows[0]["blocks"] == 1:
                continue
            found = repeated_windows([(r["lead"], r["windows"], r["bytes"]) for r in rows], length, core)
            seen = set()
            for row, dup in zip(rows, found):
                own = row["core"], row["h1"], row["h2"], row["lead"], row["windows"]
                if row["copies"] > 1:
                    dup = np.ones(len(dup), dtype=bool)
                else:
                    edges = np.flatnonzero(np.diff(np.concatenate([[0], dup, [0]])))
                    out += [(*own, lo, hi, None, None, None, 0) for lo, hi in edges.reshape(-1, 2).tolist()]
                if row["blocks"] > 1:
                    sums = hasher.sums(np.frombuffer(row["bytes"], np.uint8))
                    at = np.arange(row["windows"])
                    w1, w2 = (_mixed(h).view(np.int64).tolist() for h in hasher.of(sums, at, at + length))
                    for k, (a, b, d) in enumerate(zip(w1, w2, dup.tolist())):
                        if not d or (row["lead"] - k, a, b) not in seen:
                            seen.add((row["lead"] - k, a, b))
                            out.append((*own, k, k + 1, row["lead"] - k, a, b, 2 if d else 1))
        names = [c.split()[0] for c in _BLOCK_ROWS.split(", ")]
        kinds = [pa.int64() if c.split()[1] == "long" else pa.int32() for c in _BLOCK_ROWS.split(", ")]
        return pa.table({n: pa.array([r[k] for r in out], kind) for k, (n, kind) in enumerate(zip(names, kinds))})

    part = F.pmod(F.xxhash64("core", "block"), F.lit(parts))
    return cut.withColumn("part", part).groupBy("part").applyInArrow(settled, _BLOCK_ROWS)


def remove_repeats(docs: DataFrame, length: int = LENGTH, core: int = CORE) -> DataFrame:
    """One row per document: `doc_id`, `n_bytes`, `n_removed`, `n_spans`, `kept` (the remaining bytes) and `spans`
    (array of start and end, in bytes).

    A byte is removed if a string of `length` bytes over it also starts anywhere else in the texts, overlaps included;
    strings are judged on the input. A null text is empty; texts shorter than `length` stay whole; repeated rows are
    texts that repeat; other columns are not read; no rows give no rows.
    """
    key = "core", "h1", "h2", "lead", "windows"
    found = materialise(
        _occurrences(docs, length, core).groupBy("text_id", *key, "starts").agg(F.count("*").alias("texts")), "segments")
    classes = found.groupBy(*key).agg(
        F.sum(F.col("texts") * F.size("starts")).alias("copies"), F.min(F.struct("text_id", F.get("starts", F.lit(0)).alias("start"))).alias("one"))
    classes = materialise(classes.select(*key, "copies", "one.*"), "classes")
    shared = classes.groupBy("core").agg(F.count("*").alias("n"), F.sum(F.when(F.col("copies") == 1, 1).otherwise(0)).alias("open"))
    shared = shared.where("n > 1 and open > 0").select("core", F.expr(f"cast(ceil(n / {BLOCK}) as long)").alias("blocks"))
    wanted = materialise(classes.join(shared, "core"), "open")
    cut = _cut_out(docs, wanted.drop("blocks"), length).join(shared, "core").withColumn(
        "block", F.expr("pmod(xxhash64(h1, h2), blocks)"))
    parts = wanted.count() // (BLOCK * PART_BLOCKS) + 1
    settled = materialise(_sorted_blocks(cut, parts, length, core), "settled")
    across = settled.where("n > 0")
    often = across.groupBy("core", "lead_at", "w1", "w2").agg(F.sum("n").alias("times")).where("times > 1").drop("times")
    met = across.where("n = 1").join(often, ["core", "lead_at", "w1", "w2"]).select(*key, "at", "until")
    ranges = settled.where("n = 0").select(*key, "at", "until").unionAll(met).unionAll(
        classes.where("copies > 1").select(*key, F.lit(0).alias("at"), F.col("windows").alias("until")))
    ranges = ranges.groupBy(*key).agg(F.collect_list(F.struct("at", "until")).alias("ranges"))
    covered = found.join(ranges, list(key)).select(
        "text_id", F.explode("starts").alias("s"), "ranges").select("text_id", "s", F.explode("ranges").alias("r")).select(
        "text_id", F.struct((F.col("s") + F.col("r.at")).alias("start"), (F.col("s") + F.col("r.until") + length - 1).alias("end")).alias("x"))
    covered = covered.groupBy("text_id").agg(F.array_sort(F.collect_set("x")).alias("covered"))
    return _texts(docs).join(covered, "text_id", "left").select("doc_id", "raw", "covered").mapInArrow(
        _removed, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, spans array<struct<start:long,end:long>>")


def _merged(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Start and end of the maximal runs of ranges, sorted by start, that overlap or touch."""
    reach = np.maximum.accumulate(end)
    fresh = np.flatnonzero(start[1:] > reach[:-1]) + 1
    return np.stack([start[np.append(0, fresh)], reach[np.append(fresh - 1, len(end) - 1)]], axis=1)


def _removed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in _slices(batch, 500):
            rows, covered, at = [], part.column("covered"), 0
            starts, ends = (x.to_numpy() for x in covered.flatten().flatten())
            upto = np.cumsum(pc.fill_null(pc.list_value_length(covered), 0).to_numpy()).tolist()
            for raw, to in zip(part.column("raw").to_pylist(), upto, strict=True):
                spans = _merged(starts[at:to], ends[at:to]).tolist() if to > at else []
                at = to
                edges = [0, *[e for span in spans for e in span], len(raw)]
                kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2]))
                rows.append((len(raw), len(raw) - len(kept), len(spans), kept, [{"start": a, "end": b} for a, b in spans]))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), *[pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "spans"])
