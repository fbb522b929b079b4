"""Packing documents into training sequences of at most `length` tokens.

Method: order-preserving dynamic programming. The documents of a partition, in table order and each closed by an end
id, form one token stream. A window may end at a document end (free), after a sentence (small penalty) or, where no
boundary is near, at a hard cut (large penalty). With f(j) the least cost of packing the stream up to cut j,
f(j) = min over cuts i with p[j] - p[i] <= length of f(i) + (length - (p[j] - p[i])) + penalty(j). The bracket is
linear in p[i], so the minimum over the sliding range of i is the head of a monotone queue keyed f(i) + p[i].

A stream is closed after `block` tokens, at a document end, which bounds memory. No shuffle: each input partition is
packed where it is read; sequence ids carry the partition number above bit 40.

Defined results: a null or empty text is the end id alone. Repeated rows are packed as often as they occur. A document
longer than a sequence, however long, is cut into pieces. An empty table gives no pieces. Other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from .bpe import byte_symbols
from .common import id_text, slices, texts_of, tidy

SENTENCE_PENALTY, HARD_PENALTY = 2, 16
#: Hard cuts are offered only inside runs without a boundary longer than this, as far apart.
HARD_GAP = 32
BLOCK_TOKENS = 1 << 21
#: The byte-level pre-tokenizer's pieces (a fixed value of the public vocabulary).
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LONG_RUN = re.compile(r"\S{4000}|\s{4000}")


class ByteEncoder:
    """Ids of whole texts by a byte-level tokenizer file.

    Such a file's vocabulary is also a table of merge ranks, which tiktoken applies several times as fast to the same
    pieces; a text with an added token's string, or with a very long run without white space, goes to the tokenizer
    itself. Tests hold both to the same ids."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.specials = {x.content for x in self.tokenizer.get_added_tokens_decoder().values()}
        stand_in = {c: b for b, c in enumerate(byte_symbols())}
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        plain = {bytes(map(stand_in.__getitem__, s)): i for s, i in vocab.items() if s not in self.specials}
        self.bytes_of = [b""] * self.tokenizer.get_vocab_size()
        for raw, i in plain.items():
            self.bytes_of[i] = raw
        for x, i in ((x, self.tokenizer.token_to_id(x)) for x in self.specials):
            self.bytes_of[i] = x.encode("utf-8")
        self.ends_sentence = np.array([bool(re.search(rb"[.!?\n][\"')\]]*$", b)) for b in self.bytes_of])
        self.ranked = tiktoken.Encoding("ranked", pat_str=PIECES, mergeable_ranks=plain, special_tokens={})

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if any(s in text for s in self.specials) or LONG_RUN.search(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return array("I", self.ranked.encode_ordinary(text)).tobytes() if text else b""


_loaded: dict[str, ByteEncoder] = {}


def encoder(path: str) -> ByteEncoder:
    if path not in _loaded:
        _loaded[path] = ByteEncoder(path)
    return _loaded[path]


def merged(*positions: np.ndarray) -> np.ndarray:
    """All positions, ascending and distinct."""
    x = np.sort(np.concatenate(positions))
    return x[np.concatenate([[True], x[1:] != x[:-1]])]


def candidate_cuts(n: int, document_ends: np.ndarray, sentence_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cut positions in ascending order from 0 to n, and the penalty of ending a window at each."""
    soft = merged(document_ends, sentence_ends, [0, n])
    gaps = np.diff(soft)
    wide = np.flatnonzero(gaps > HARD_GAP)
    per = (gaps[wide] - 1) // HARD_GAP
    step = np.arange(int(per.sum())) - np.repeat(np.cumsum(per) - per, per) + 1
    hard = [np.repeat(soft[wide], per) + step * HARD_GAP]
    at = merged(soft, *hard)
    penalty = np.full(len(at), HARD_PENALTY, np.int64)
    penalty[np.searchsorted(at, sentence_ends)] = SENTENCE_PENALTY
    penalty[np.searchsorted(at, document_ends)] = 0
    penalty[[0, -1]] = 0
    return at, penalty


def windows(at: np.ndarray, penalty: np.ndarray, length: int) -> list[int]:
    """Positions where windows end, minimising padding plus penalties."""
    p, pen = at.tolist(), penalty.tolist()
    cost, back = [0] * len(p), [0] * len(p)
    queue: deque[tuple[int, int]] = deque([(0, 0)])  # (cost + position, cut), keys ascending from the head
    for j in range(1, len(p)):
        reach = p[j] - length
        while p[queue[0][1]] < reach:
            queue.popleft()
        key, i = queue[0]
        back[j] = i
        cost[j] = key + length - p[j] + pen[j]
        key = cost[j] + p[j]
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, j))
    ends, j = [], len(p) - 1
    while j > 0:
        ends.append(p[j])
        j = back[j]
    return ends[::-1]


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, `offset` long"


def _pack_block(docs: list[tuple[int | None, bytes]], ends_sentence: np.ndarray, length: int, first: int) -> tuple[pa.RecordBatch, int]:
    """Pieces of one closed stream; sequence ids start at `first`."""
    sizes = np.array([len(b) // 4 for _, b in docs], np.int64)
    stops = np.cumsum(sizes)
    begins = stops - sizes
    data = b"".join([b for _, b in docs])
    ids = np.frombuffer(data, np.uint32)
    sentence = np.flatnonzero(ends_sentence[ids]) + 1
    ends = np.array(windows(*candidate_cuts(len(ids), stops, sentence), length), np.int64)
    # A piece starts at every document begin and every window begin.
    starts = merged(begins, [0], ends[:-1])
    piece_ends = np.append(starts[1:], len(ids))
    doc = np.searchsorted(stops, starts, side="right")
    seq = np.searchsorted(ends, starts, side="right")
    seq_begin = np.concatenate([[0], ends])[seq]
    view = memoryview(data)
    crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(starts.tolist(), piece_ends.tolist())]
    names = [docs[i][0] for i in doc.tolist()]
    columns = [names, starts - begins[doc], piece_ends - starts, crc, sizes[doc], first + seq, starts - seq_begin]
    fields = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], fields), first + len(ends)


def pack(df: DataFrame, path: str, end_id: int = 1, length: int = 2048, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK_TOKENS) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    end = np.array([end_id], np.uint32).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        context = TaskContext.get()
        sequence = (context.partitionId() if context else 0) << 40
        held: list[tuple[int | None, bytes]] = []
        tokens = 0
        for batch in batches:
            for part in slices(batch):
                for doc, text in zip(part.column(0).to_pylist(), texts_of(part.column(1))):
                    ids = enc.encode(text) + end
                    held.append((doc, ids))
                    tokens += len(ids) // 4
                    if tokens >= block:
                        out, sequence = _pack_block(held, enc.ends_sentence, length, sequence)
                        yield out
                        held, tokens = [], 0
        if held:
            yield _pack_block(held, enc.ends_sentence, length, sequence)[0]

    return id_text(df, id_col, text_col).mapInArrow(tidy(run), SCHEMA)
