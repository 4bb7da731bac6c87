"""Token counts of sections by offset-mapped attribution.

A whole document is encoded once; every token keeps its span of characters. The spans are interval-joined to the
sections of the document by binary search in the task that encoded it. A token across a boundary goes to the section
that holds most of its characters, the earlier one on a tie, so the counts of a document's sections add up to its
tokens, which they need not do if sections are encoded alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .tokens import TextEncoder

SCHEMA = "doc_id long, section long, start long, end long, n_tokens long, n_crossing long"
_ROWS = 200_000


def lines(text: str) -> list[int]:
    """Starts of the lines; a newline belongs to the line it ends."""
    starts = [0]
    at = text.find("\n")
    while 0 <= at < len(text) - 1:
        starts.append(at + 1)
        at = text.find("\n", at + 1)
    return starts


def attribute(first: np.ndarray, end: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Section of every token, and whether it crosses a boundary; `bounds` are the sections' starts and the text's end."""
    section = np.searchsorted(bounds[:-1], first, side="right") - 1
    last = np.searchsorted(bounds[:-1], np.maximum(end - 1, first), side="right") - 1
    crossing = last > section
    for k in np.flatnonzero(crossing):
        parts = np.arange(section[k], last[k] + 1)
        held = np.minimum(bounds[parts + 1], end[k]) - np.maximum(bounds[parts], first[k])
        section[k] = parts[held.argmax()]
    return section, crossing


def token_counts(docs: DataFrame, sections: Callable[[str], list[int]] = lines) -> DataFrame:
    """One row per document and section: `doc_id`, `section` (from 0), `start` and `end` in code points, `n_tokens` and
    `n_crossing` (tokens among them that cross a boundary of a section).

    `sections` gives the starts of a text's sections, from 0, rising. A null or empty text is one empty section without
    tokens; a null `doc_id` stays null; repeated rows are counted each; other columns are not read; no rows give no rows.
    """
    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, out, rows = TextEncoder(), [], 0

        def flush() -> pa.RecordBatch:
            ids = pa.array([k for k, *_ in out], pa.int64())
            sizes = [len(c) for *_, c, _ in out]
            return pa.RecordBatch.from_arrays([
                ids.take(pa.array(np.repeat(np.arange(len(out)), sizes))),
                pa.array(np.concatenate([np.arange(n) for n in sizes])),
                *[pa.array(np.concatenate(part).astype(np.int64)) for part in (
                    [b[:-1] for _, b, *_ in out], [b[1:] for _, b, *_ in out], [c for *_, c, _ in out],
                    [x for *_, x in out])],
            ], names=["doc_id", "section", "start", "end", "n_tokens", "n_crossing"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                text = text or ""
                bounds = np.array([*sections(text), len(text)], dtype=np.int64)
                section, crossing = attribute(*encoder.spans(text), bounds)
                n = len(bounds) - 1
                out.append((
                    doc_id, bounds, np.bincount(section, minlength=n), np.bincount(section[crossing], minlength=n),
                ))
                rows += n
                if rows >= _ROWS:
                    yield flush()
                    out, rows = [], 0
        if out:
            yield flush()

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(counted, SCHEMA)
