"""Document fingerprints by locally consistent parsing.

Method: deterministic coin tossing. Symbols (bytes at first) are compared with their predecessor: a label is twice the
lowest differing bit plus that bit's value, and is itself relabelled until the alphabet has six letters. Strict local
maxima of the labels begin phrases, so where a cut falls depends on a few symbols around it alone; a phrase is named by a
hash of its symbols, and the names are parsed again. Equal substrings therefore share their interior names whatever
their offset. A fingerprint is the `size` first names in an order that all texts share: third-level names first, then
those of the second and the first level, each by their scrambled value. So a long text is told by names of its longest
phrases, and a short one, which has few of them, by names of its shorter phrases too; two fingerprints estimate the
Jaccard likeness of the two sets' first names. In a run of equal symbols the labels are 0, so it lies within one phrase.

The next document is that of the next row by (id, hash of text, text), nulls first, and after the last the first. Rows
are range-partitioned by that order; a partition's last row meets the next partition's first row in a second, tiny step
of one row a partition.

Defined results: null counts as the empty text, whose fingerprint is empty; two empty fingerprints are alike (1), an
empty one and another are not (0). A table of one row is its own next document. Equal texts have equal fingerprints;
repeated rows repeat. A very long text is parsed whole by one task; beyond three levels its phrases only grow in number,
of which the smallest names are kept. An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Powers, id_text, map_slices, mix, partitions_for, settle, sha, slices, texts_of, tidy

LEVELS, SIZE = 3, 64
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1


def _pair_label(bits: int) -> np.ndarray:
    """Labels of all pairs (symbol, predecessor) of so many bits; 0 where they are equal."""
    n = 1 << bits
    x, p = np.arange(n)[:, None], np.arange(n)[None, :]
    d = x ^ p
    low = np.where(d == 0, 0, np.log2(np.maximum(d & -d, 1)).astype(np.int64))
    return np.where(d == 0, 0, 2 * low + ((x >> low) & 1)).astype(np.uint8).ravel()


_BYTE, _SEVEN, _FOUR, _THREE = _pair_label(8), _pair_label(7), _pair_label(4), _pair_label(3)
_BYTE_NAMES = mix(np.arange(1, 257, dtype=_U) * _U(_BASE))
powers = Powers(_BASE)


def _before(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Each symbol's predecessor; at a text's start the symbol with its lowest bit turned."""
    p = np.empty_like(x)
    p[1:] = x[:-1]
    p[starts] = x[starts] ^ x.dtype.type(1)
    return p


def _relabel(x: np.ndarray, starts: np.ndarray, table: np.ndarray, bits: int) -> np.ndarray:
    return table[(x.astype(np.uint16) << bits) | _before(x, starts)]


def labels(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Labels of at most eight letters."""
    if x.dtype == np.uint8:
        x = _relabel(x, starts, _BYTE, 8)
    else:
        p = _before(x, starts)
        d = x ^ p
        low = d & (~d + _U(1))
        # The position of the lowest set bit, through the exponent of its value as a float.
        position = (low.astype(np.float64).view(np.int64) >> 52) - 1023
        position[d == 0] = 0
        bit = (x >> position.astype(_U)) & _U(1)
        x = np.where(d == 0, 0, 2 * position + bit.astype(np.int64)).astype(np.uint8)
        x = _relabel(x, starts, _SEVEN, 7)
    x = _relabel(x, starts, _FOUR, 4)
    return _relabel(x, starts, _THREE, 3)


def parse(x: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the phrases of all texts, and where each text's phrases start. starts: of the texts that aren't empty."""
    lab = labels(x, starts)
    cut = np.zeros(len(x), bool)
    cut[1:-1] = (lab[1:-1] > lab[:-2]) & (lab[1:-1] > lab[2:])
    cut[starts[1:] - 1] = False  # a text's last symbol has no successor
    cut[starts] = True
    at = np.flatnonzero(cut)
    up, down = powers(len(x))
    values = _BYTE_NAMES[x] if x.dtype == np.uint8 else mix(x)
    values *= up
    names = mix(np.add.reduceat(values, at) * down[at])
    return names, np.searchsorted(at, starts)


def sketches(data: np.ndarray, offsets: np.ndarray, levels: int = LEVELS, size: int = SIZE) -> list[np.ndarray]:
    """The first `size` names of every text, as 32-bit numbers, ascending. At most four levels fit the order."""
    lengths = np.diff(offsets)
    full = np.flatnonzero(lengths)
    out = [np.zeros(0, np.uint32)] * len(lengths)
    if not len(full):
        return out
    x, starts, parsed = data, offsets[full], []
    for k in range(levels):
        x, starts = parse(x, starts)
        # Two bits of the order tell the level, the highest first; the others are the name's.
        order = (mix(x) >> _U(34)).astype(np.uint32) | np.uint32((levels - 1 - k) << 30)
        parsed.append((order, starts.tolist(), [*starts[1:].tolist(), len(x)]))
    for n, i in enumerate(full.tolist()):
        held = np.zeros(0, np.uint32)
        for order, begins, ends in reversed(parsed):
            held = np.concatenate([held, np.unique(order[begins[n] : ends[n]])])
            if len(held) >= size:
                break
        out[i] = held[:size]
    return out


def likeness(a: np.ndarray, b: np.ndarray, size: int = SIZE) -> float:
    """The share of the smallest names of both together that both have."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.union1d(a, b)[:size]
    return len(np.intersect1d(np.intersect1d(a, b, assume_unique=True), both, assume_unique=True)) / len(both)


def fingerprint_texts(texts: list[str]) -> list[np.ndarray]:
    raw = [t.encode("utf-8") for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw], dtype=np.int64)]).astype(np.int64)
    return sketches(np.frombuffer(b"".join(raw), np.uint8), offsets)


def spell(sketch: np.ndarray) -> str:
    return sketch.astype(">u4").tobytes().hex()


def fingerprint(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id and fingerprint, in the table's own partitions."""

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([spell(s) for s in fingerprint_texts(texts_of(batch.column(1)))], pa.string())], ["doc_id", "fingerprint"])

    return map_slices(id_text(df, id_col, text_col), kernel, "doc_id long, fingerprint string")


def edit(text: str, following: str) -> str:
    """The last quarter of the text's code points replaced by as many, or all, of the following text's first ones."""
    q = len(text) // 4
    return text[: len(text) - q] + following[:q]


FIELDS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compare(ids: list, texts: list[str], following: list[str]) -> list[pa.Array]:
    own = fingerprint_texts([*texts, *following[-1:]]) if following[:-1] == texts[1:] else None
    after = own[1:] if own is not None else fingerprint_texts(following)
    own = own[:-1] if own is not None else fingerprint_texts(texts)
    edits = [edit(t, n) for t, n in zip(texts, following)]
    changed = fingerprint_texts(edits)
    return [
        pa.array(ids, pa.int64()),
        pa.array([len(t) for t in texts], pa.int64()),
        pa.array([sha(e.encode("utf-8")) for e in edits], pa.string()),
        pa.array([spell(s) for s in own], pa.string()),
        pa.array([spell(s) for s in changed], pa.string()),
        pa.array([likeness(a, b) for a, b in zip(own, changed)], pa.float64()),
        pa.array([likeness(a, b) for a, b in zip(own, after)], pa.float64()),
    ]


NAMES = [f.split(" ")[0] for f in FIELDS.split(", ")]
CLOSED, OPEN, HEAD = 0, 1, 2


def with_neighbours(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: fingerprints of the text and of its edited text, and their likeness and that to the next document."""
    spark = df.sparkSession
    rows = id_text(df, id_col, text_col).withColumn("h", F.xxhash64("text"))
    rows = rows.repartitionByRange(partitions_for(df), "doc_id", "h").sortWithinPartitions("doc_id", "h", "text").select("doc_id", "text")

    def boundary(kind: int, part: int, doc: int | None, text: str) -> pa.RecordBatch:
        blank = [pa.nulls(1, pa.string() if k in (2, 3, 4) else pa.int64() if k < 2 else pa.float64()) for k in range(7)]
        return pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([part], pa.int32()), pa.array([text], pa.string()), pa.array([doc], pa.int64()), *blank[1:]], ["kind", "part", "text", *NAMES])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        carry: tuple | None = None
        for batch in batches:
            for piece in slices(batch):
                ids, texts = piece.column(0).to_pylist(), texts_of(piece.column(1))
                if carry is None:
                    yield boundary(HEAD, part, ids[0], texts[0])
                else:
                    ids, texts = [carry[0], *ids], [carry[1], *texts]
                carry = ids[-1], texts[-1]
                m = len(ids) - 1
                if m:
                    yield pa.RecordBatch.from_arrays([pa.array([CLOSED] * m, pa.int32()), pa.array([part] * m, pa.int32()), pa.nulls(m, pa.string()), *_compare(ids[:-1], texts[:-1], texts[1:])], ["kind", "part", "text", *NAMES])
        if carry is not None:
            yield boundary(OPEN, part, *carry)

    done = settle(rows.mapInArrow(tidy(run), f"kind int, part int, text string, {FIELDS}"), "fingerprints")
    # One row for each partition that has rows: bounded by the number of partitions, not by the data.
    parts = sorted(r[0] for r in done.filter(F.col("kind") == HEAD).select("part").collect())
    follow = spark.createDataFrame([(p, parts[(i + 1) % len(parts)]) for i, p in enumerate(parts)], "part int, next_part int")
    opened = done.filter(F.col("kind") == OPEN).select("part", "doc_id", "text")
    heads = done.filter(F.col("kind") == HEAD).select(F.col("part").alias("next_part"), F.col("text").alias("next_text"))
    pairs = opened.join(follow, "part").join(heads, "next_part").select("doc_id", "text", "next_text")

    def close(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(_compare(batch.column(0).to_pylist(), texts_of(batch.column(1)), texts_of(batch.column(2))), NAMES)

    return done.filter(F.col("kind") == CLOSED).select(*NAMES).unionByName(map_slices(pairs, close, FIELDS))
