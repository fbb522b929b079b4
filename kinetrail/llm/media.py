"""Media columns: payloads stored in deduplicated, content-defined chunks and read back verified.

A payload (a text's UTF-8 bytes, padded with zeros to a positive multiple of 64) is stored as a WAV file of 8-bit mono
samples. Method: a rolling gear hash over the file's last 32 bytes cuts it where its top bits are zero, within a least and
a most chunk size. Chunks are named by digests and deduplicated by Spark joins: digests that occur once stay within
their file's row; bytes of digests that occur more often go to a chunk table once. A file's ordered list of digests is
its manifest; reading joins the listed digests to the chunk table, puts the chunks in order and verifies each chunk's and
the file's digest before any feature is computed.

Which digests occur more often is first settled on digests alone; a Bloom filter of fixed bounds then tells the writing
pass which chunks to keep in place (a false hit only moves a chunk to the table). Only files with moved chunks are
shuffled when reading. Equal files are one file there: it's read back, verified and measured once, and its rows learn
the result by its digest.

Defined results: null counts as the empty text: 64 zero bytes. Equal texts have equal values; repeated rows repeat.
A very long text is cut into chunks by one task and is one file. An empty table gives no rows. Only the id and text
columns are read. A file that doesn't verify stops the job.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bloom, id_text, in_bloom, map_slices, mix, settle, sha, table_bits, texts_of, tidy

LEAST, MOST = 256, 8192
#: Top bits of the gear hash that are zero at a cut: 2^10 bytes between cuts on average.
CUT_BITS = 10
UNIT = 64
RATE = 8000
BLOOM_BITS = (16, 27)
_GEAR = (mix(np.arange(77, 333, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)
_HEADER = struct.Struct("<4sI4s4sIHHIIHH4sI")


def wav(payload: bytes) -> bytes:
    """8-bit mono samples behind a RIFF header of 44 bytes."""
    return _HEADER.pack(b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(payload)) + payload


def samples(media: bytes) -> bytes:
    """The samples of a stored file; raises if its header doesn't fit its length."""
    head = _HEADER.unpack_from(media)
    if head[0] != b"RIFF" or head[11] != b"data" or head[12] != len(media) - _HEADER.size:
        raise ValueError("not a stored file")
    return media[_HEADER.size :]


def padded(raw: bytes) -> bytes:
    return raw + bytes(-len(raw) % UNIT if raw else UNIT)


def chunk_ends(data: np.ndarray) -> list[int]:
    """Ends of content-defined chunks. The gear hash is h = 2h + gear[byte] modulo 2^32, so it covers 32 bytes."""
    if len(data) <= LEAST:
        return [len(data)]
    h = _GEAR[data]
    for k in range(5):
        step = 1 << k
        h[step:] = h[step:] + (h[:-step] << np.uint32(step))
    at = (np.flatnonzero(h >> np.uint32(32 - CUT_BITS) == 0) + 1).tolist()
    ends, last = [], 0
    for e in at:
        while e - last > MOST:
            last += MOST
            ends.append(last)
        if e - last >= LEAST:
            ends.append(e)
            last = e
    while len(data) - last > MOST:
        last += MOST
        ends.append(last)
    if last < len(data):
        ends.append(len(data))
    return ends


def chunks_of(media: bytes) -> list[bytes]:
    ends = chunk_ends(np.frombuffer(media, np.uint8))
    return [media[a:b] for a, b in zip([0, *ends], ends)]


def digest(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


def number(d: bytes) -> int:
    return int.from_bytes(d[:8], "little", signed=True)


def repeated_digests(plain: DataFrame) -> DataFrame:
    """Digests (as k, their leading 64 bits) that occur more than once."""

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [number(digest(c)) for t in texts_of(batch.column(0)) for c in chunks_of(wav(padded(t.encode("utf-8"))))]
        return pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], ["k"])

    return map_slices(plain.select("text"), kernel, "k long", text_at=0).groupBy("k").agg(F.count("*").alias("c")).filter("c > 1").select("k")


FILE = "doc_id long, n_bytes long, media_bytes long, media_sha256 string, manifest array<binary>, kept array<binary>, moved boolean"


def store(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The file table (manifest, and the chunks that stay in place) and the chunk table (digest, data)."""
    plain = id_text(df, id_col, text_col)
    repeated = settle(repeated_digests(plain), "digests")
    table = df.sparkSession.sparkContext.broadcast(bloom(repeated, "k", table_bits(plain, 64, *BLOOM_BITS)))

    def files(batch: pa.RecordBatch) -> pa.RecordBatch:
        columns: tuple[list, ...] = ([], [], [], [], [], [])
        for text in texts_of(batch.column(1)):
            raw = text.encode("utf-8")
            media = wav(padded(raw))
            parts = chunks_of(media)
            names = [digest(c) for c in parts]
            hit = in_bloom(table.value, np.array([number(d) for d in names], np.int64).view(np.uint64)).tolist()
            for column, v in zip(columns, (len(raw), len(media), sha(media), names, [None if h else c for h, c in zip(hit, parts)], any(hit))):
                column.append(v)
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.binary()), pa.list_(pa.binary()), pa.bool_()]
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds))], ["doc_id", "n_bytes", "media_bytes", "media_sha256", "manifest", "kept", "moved"])

    def moved(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        out: dict[bytes, bytes] = {}
        for text in texts_of(batch.column(0)):
            for c in chunks_of(wav(padded(text.encode("utf-8")))):
                out.setdefault(digest(c), c)
        names = list(out)
        hit = in_bloom(table.value, np.array([number(d) for d in names], np.int64).view(np.uint64)) if names else np.zeros(0, bool)
        names = [d for d, h in zip(names, hit.tolist()) if h]
        return pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array([out[d] for d in names], pa.binary())], ["digest", "data"])

    chunks = map_slices(plain.select("text"), moved, "digest binary, data binary", text_at=0).dropDuplicates(["digest"])
    return settle(map_slices(plain, files, FILE), "media-files"), settle(chunks, "media-chunks")


def assemble(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """media_bytes, media_sha256, manifest, kept and found (moved chunks by digest) of every distinct file that has moved chunks."""
    shared = settle(files.filter("moved").select("media_bytes", "media_sha256", "manifest", "kept").dropDuplicates(["media_sha256"]), "media-shared")
    listed = shared.select("media_sha256", F.explode(F.arrays_zip("manifest", "kept")).alias("x")).filter("x.kept is null").select("media_sha256", F.col("x.manifest").alias("digest")).distinct()
    found = listed.join(chunks, "digest").groupBy("media_sha256").agg(F.map_from_entries(F.collect_list(F.struct("digest", "data"))).alias("found"))
    return shared.join(found, "media_sha256", "left").select("media_bytes", "media_sha256", "manifest", "kept", "found")


def feature(payload: bytes) -> str:
    """Integer statistics of the samples around their middle: mean square, crossings, extremes and eight-bin spread."""
    x = np.frombuffer(payload, np.uint8)
    y = x.astype(np.int64) - 128
    crossings = int(((y[1:] < 0) != (y[:-1] < 0)).sum())
    spread = np.bincount(x >> 5, minlength=8)
    return f"sum={int(y.sum())};square={int((y * y).sum())};cross={crossings};min={int(x.min())};max={int(x.max())};spread={'/'.join(map(str, spread.tolist()))}"


OUT = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


VALUES = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def read_features(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """Features of the stored files, computed from the bytes read back after each digest has been verified."""
    names = [f.split(" ")[0] for f in VALUES.split(", ")]

    def measured(batch: pa.RecordBatch, found: list) -> list[pa.Array]:
        columns: tuple[list, ...] = ([], [], [], [], [], [])
        for name, manifest, kept, moved in zip(*(batch.column(c).to_pylist() for c in ("media_sha256", "manifest", "kept")), found):
            held = dict(moved or ())
            parts = [held[d] if c is None else c for d, c in zip(manifest, kept)]
            media = b"".join(parts)
            if [digest(p) for p in parts] != manifest or sha(media) != name:
                raise ValueError("a stored file does not verify")
            payload = samples(media)
            for column, v in zip(columns, (len(payload), sha(payload), zlib.crc32(payload[-UNIT:]), len(media), name, feature(payload))):
                column.append(v)
        return [pa.array(c, pa.string() if n in ("payload_sha256", "media_sha256", "feature") else pa.int64()) for n, c in zip(names, columns)]

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            sizes = np.cumsum(np.asarray(batch.column("media_bytes")))
            while at < batch.num_rows:
                stop = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + (4 << 20), side="right")))
                yield batch.slice(at, stop - at)
                at = stop

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), *measured(b, [None] * b.num_rows)], ["doc_id", "n_bytes", *names])

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            yield pa.RecordBatch.from_arrays(measured(b, b.column("found").to_pylist()), names)

    by_file = settle(assemble(files, chunks).mapInArrow(tidy(once), VALUES), "media-features")
    single = files.filter(~F.col("moved")).select("doc_id", "n_bytes", "media_bytes", "media_sha256", "manifest", "kept").mapInArrow(tidy(alone), OUT)
    return single.unionByName(files.filter("moved").select("doc_id", "n_bytes", "media_sha256").join(by_file, "media_sha256"))


def round_trip(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return read_features(*store(df, id_col, text_col))
