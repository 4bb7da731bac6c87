"""Hierarchical multi-length packing of tokenised documents.

Every task packs the documents of its own partition, so nothing is shuffled and no group gathers in one place. A
document longer than the longest window fills whole windows first; its rest, like every shorter document, is routed to
the smallest window size (tier) that holds it. Windows open from the longest rest down; the gap behind it is filled with
the largest shorter rests that fit whole, and at last with a piece cut from a shorter one, so that windows of every tier
are exactly full. Only the last open window of a partition has no more to take: it is divided into windows whose sizes
are powers of two. Full windows of one tier are dealt into step groups of equal token count, in snake order of their
attention cost (sum of squared piece lengths), so that groups weigh alike.

Memory is bounded by `chunk_tokens` (open rests are carried from chunk to chunk) and one Arrow batch. Results are a
function of a partition's rows in their order; a task run again gives the same rows.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .tokens import TextEncoder

TIERS = (256, 512, 1024, 2048)
END = 1
CHUNK_TOKENS = 1 << 21
STEP_TOKENS = 1 << 16
_LOCAL_BITS = 40  # a sequence's number within its partition stays below these bits

SCHEMA = (
    "doc_id long, start long, length long, input_ids binary, doc_tokens long, sequence_id long, offset long, "
    "window int, step_id long"
)
_ARROW = pa.schema([
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("input_ids", pa.binary()),
    ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("window", pa.int32()),
    ("step_id", pa.int64()),
])

Piece = tuple[int, int, int]  # length, document (its number within the chunk), start


def fill_windows(rests: list[Piece], tiers: tuple[int, ...], last: bool) -> tuple[list[tuple[int, list[Piece]]], list[Piece]]:
    """Full windows (size, pieces) of the rests, and the pieces left in the one window that could not be filled.

    With `last` that window is divided into windows of powers of two, and nothing is left.
    """
    pool = sorted(rests)
    windows = []
    while pool:
        length, doc, start = pool.pop()
        size = next(t for t in tiers if t >= length)
        held, gap = [(length, doc, start)], size - length
        while gap and pool:
            at = bisect_right(pool, (gap, float("inf"), 0))
            if at:
                held.append(pool.pop(at - 1))
                gap -= held[-1][0]
            else:
                whole, doc, start = pool.pop(0)
                held.append((gap, doc, start))
                insort(pool, (whole - gap, doc, start + gap))
                gap = 0
        if not gap:
            windows.append((size, held))
        elif last:
            windows += halved(held)
        else:
            return windows, held
    return windows, []


def halved(held: list[Piece]) -> list[tuple[int, list[Piece]]]:
    """The same tokens in windows of falling powers of two."""
    total = sum(piece[0] for piece in held)
    windows, held = [], held[::-1]
    for size in (1 << bit for bit in range(total.bit_length() - 1, -1, -1) if total >> bit & 1):
        own, gap = [], size
        while gap:
            length, doc, start = held.pop()
            taken = min(gap, length)
            own.append((taken, doc, start))
            if taken < length:
                held.append((length - taken, doc, start + taken))
            gap -= taken
        windows.append((size, own))
    return windows


def step_groups(windows: list[tuple[int, list[Piece]]], step_tokens: int) -> list[int]:
    """Number of the step group of every window: groups hold windows of one size and weigh alike."""
    groups, used = [0] * len(windows), 0
    for size in sorted({w[0] for w in windows}):
        costly = sorted((-sum(p[0] ** 2 for p in held), k) for k, (own, held) in enumerate(windows) if own == size)
        n = -(-len(costly) * size // step_tokens)
        for place, (_, k) in enumerate(costly):
            turn, seat = divmod(place, n)
            groups[k] = used + (n - 1 - seat if turn % 2 else seat)
        used += n
    return groups


def _pack(batches: Iterable[pa.RecordBatch], partition: int, tiers, end, chunk_tokens, step_tokens) -> Iterator[pa.RecordBatch]:
    encoder, tail = TextEncoder(), int(end).to_bytes(4, "little")
    longest = tiers[-1]
    base = partition << _LOCAL_BITS
    sequences = steps = tokens = 0
    docs: list[tuple[int | None, bytes]] = []
    whole: list[tuple[int, list[Piece]]] = []
    rests: list[Piece] = []

    def finish(last: bool) -> pa.RecordBatch:
        nonlocal sequences, steps, tokens, docs, whole, rests
        windows, left = fill_windows(rests, tiers, last)
        windows = whole + windows
        groups = step_groups(windows, step_tokens)
        rows = [
            (doc, start, length, offset, size, sequences + k, steps + groups[k])
            for k, (size, held) in enumerate(windows)
            for (length, doc, start), offset in zip(held, _offsets(held), strict=True)
        ]
        out = pa.RecordBatch.from_arrays([
            pa.array([docs[r[0]][0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
            pa.array([r[2] for r in rows], pa.int64()),
            pa.array([docs[r[0]][1][4 * r[1] : 4 * (r[1] + r[2])] for r in rows], pa.binary()),
            pa.array([len(docs[r[0]][1]) // 4 for r in rows], pa.int64()),
            pa.array([base + r[5] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.int64()),
            pa.array([r[4] for r in rows], pa.int32()), pa.array([base + r[6] for r in rows], pa.int64()),
        ], schema=_ARROW)
        sequences += len(windows)
        steps += max(groups, default=-1) + 1
        kept = sorted({piece[1] for piece in left})
        new = {doc: k for k, doc in enumerate(kept)}
        docs, whole, rests = [docs[doc] for doc in kept], [], [(n, new[doc], start) for n, doc, start in left]
        tokens = sum(piece[0] for piece in rests)
        return out

    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            packed = (encoder.ids(text).tobytes() if text else b"") + tail
            n = len(packed) // 4
            docs.append((doc_id, packed))
            for start in range(0, n - longest + 1, longest):
                whole.append((longest, [(longest, len(docs) - 1, start)]))
            if n % longest:
                rests.append((n % longest, len(docs) - 1, n - n % longest))
            tokens += n
            if tokens >= chunk_tokens:
                yield finish(False)
    if docs:
        yield finish(True)


def _offsets(held: list[Piece]) -> list[int]:
    offsets, at = [], 0
    for piece in held:
        offsets.append(at)
        at += piece[0]
    return offsets


def pack(
    docs: DataFrame, tiers: tuple[int, ...] = TIERS, end: int = END, chunk_tokens: int = CHUNK_TOKENS,
    step_tokens: int = STEP_TOKENS,
) -> DataFrame:
    """Pieces of documents in sequences: `doc_id`, `start` and `length` (tokens before and in the piece), `input_ids`
    (little-endian unsigned 32-bit numbers), `doc_tokens`, `sequence_id`, `offset` in the sequence, `window` (its length)
    and `step_id`.

    `tiers` are rising powers of two. A null or empty text is the one token `end`; other columns are not read; a null
    `doc_id` stays null; repeated rows are packed each; no rows give no rows.
    """
    if list(tiers) != sorted(set(tiers)) or any(t < 1 or t & (t - 1) for t in tiers):
        raise ValueError("tiers are rising powers of two")

    def packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        return _pack(batches, TaskContext.get().partitionId(), tiers, end, chunk_tokens, step_tokens)

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(packed, SCHEMA)
