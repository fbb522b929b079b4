"""Token counts of sections by offset-mapped attribution.

Method: each document is encoded once, whole. The tokens' spans (cumulative byte lengths of their vocabulary strings)
are interval-joined to the sections' spans by binary search on the sorted section ends. Rule for a token that crosses
a boundary: it counts for the section that holds most of its bytes, the earlier one among equals. So the counts of a
document's sections sum to its tokens, which encoding sections one by one would not give.

A section is a maximal line with its line feed; a character belongs to the token that holds its first byte.

Defined results: null and empty texts have no sections and no tokens. Repeated rows repeat. A very long text is
encoded once, whole, by one task. An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_text, map_slices, texts_of
from .packing import encoder


def line_ends(data: bytes) -> np.ndarray:
    """Byte offsets where sections end."""
    ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 10) + 1
    return ends if len(data) == 0 or (len(ends) and ends[-1] == len(data)) else np.append(ends, len(data))


def attribute(lengths: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, int]:
    """Tokens of each section, and how many tokens cross a boundary. lengths: bytes of each token, in order."""
    stops = np.cumsum(lengths)
    starts = stops - lengths
    first = np.searchsorted(ends, starts, side="right")
    last = np.searchsorted(ends, np.maximum(stops - 1, starts), side="right")
    owner = first.copy()
    crossing = np.flatnonzero(last > first)
    for t in crossing.tolist():
        a, b, i, j = int(starts[t]), int(stops[t]), int(first[t]), int(last[t])
        shares = np.diff(np.concatenate([[a], ends[i:j], [b]]))
        owner[t] = i + int(np.argmax(shares))
    return np.bincount(owner, minlength=len(ends)), len(crossing)


SCHEMA = "doc_id long, n_tokens long, n_sections long, n_crossing long, section_tokens array<int>"


def count_tokens(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: tokens, sections, boundary-crossing tokens and the tokens of each section in order. No shuffle."""

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        enc = encoder(path)
        size = np.array([len(b) for b in enc.bytes_of], np.int64)
        tokens, sections, crossings, each = [], [], [], []
        for text in texts_of(batch.column(1)):
            ids = np.frombuffer(enc.encode(text), np.uint32)
            counts, crossing = attribute(size[ids], line_ends(text.encode("utf-8")))
            tokens.append(len(ids))
            sections.append(len(counts))
            crossings.append(crossing)
            each.append(counts.astype(np.int32))
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in (tokens, sections, crossings)), pa.array(each, pa.list_(pa.int32()))], ["doc_id", "n_tokens", "n_sections", "n_crossing", "section_tokens"])

    return map_slices(id_text(df, id_col, text_col), kernel, SCHEMA)
