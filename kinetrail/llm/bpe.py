"""Byte-pair encoding and decoding with a word-end vocabulary.

Method: the symbols of a piece form a doubly linked list; a priority queue holds the merges that adjacent symbols
allow, ordered by merge rank and then by position. The best entry is popped, skipped as stale when either symbol has
changed since it was queued, and otherwise applied by relinking, which queues the two new neighbours. Decoding
concatenates vocabulary strings (joined by the separator the vocabulary's missing decoder implies, one space).

Defined results: null and empty texts, and texts of white space only, have no ids (0 tokens, digests of the empty
string). Equal texts have equal results. Repeated ids give repeated rows. A very
long text is encoded whole by one task, with a linked list as long as its longest run without white space. An empty table
gives no rows. Other columns of the table are not read.
"""

from __future__ import annotations

import heapq
import json
import os
import re
import unicodedata

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import id_text, map_slices, sha, texts_of

#: Entries a worker's piece cache may hold before it starts afresh; bounds memory, never results.
CACHE_ENTRIES = 250_000
#: str.split() also cuts at these separators, which the tokenizer's \s does not match.
CONTROL_SEPARATORS = re.compile("[\x1c-\x1f]")


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte: itself where printable, else the next free code point from 256 on."""
    kept = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, free = [], 256
    for b in range(256):
        if b in kept:
            out.append(chr(b))
        else:
            out.append(chr(free))
            free += 1
    return out


class WordBPE:
    """Encoder and decoder for a tokenizer file whose pre-tokenizer is one splitting pattern over normalised text."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.symbols = byte_symbols()
        self.ranks: dict[tuple[str, str], int] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks[(a, b)] = rank
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.added_mark = os.path.commonprefix(list(self.added))  # no text without it holds an added token
        by_length = sorted(self.added, key=len, reverse=True)
        self.added_pattern = re.compile("(" + "|".join(map(re.escape, by_length)) + ")") if by_length else None
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pieces = regex.compile(pattern)
        self.strings = {str(i): s for s, i in self.vocab.items()} | {str(i): s for s, i in self.added.items()}
        self.cache: dict[str, str] = {}

    def merge(self, symbols: list[str]) -> list[str]:
        """All merges of one piece, best rank first and leftmost among equals."""
        n = len(symbols)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        ranks, queue = self.ranks, []
        for i in range(n - 1):
            r = ranks.get((symbols[i], symbols[i + 1]))
            if r is not None:
                queue.append((r, i, symbols[i], symbols[i + 1]))
        heapq.heapify(queue)
        live: list[str | None] = list(symbols)
        while queue:
            _, i, a, b = heapq.heappop(queue)
            j = right[i]
            if live[i] != a or j < 0 or live[j] != b:
                continue  # stale: one of the two symbols was merged away
            live[i], live[j] = a + b, None
            right[i] = k = right[j]
            if k >= 0:
                left[k] = i
                r = ranks.get((live[i], live[k]))
                if r is not None:
                    heapq.heappush(queue, (r, i, live[i], live[k]))
            h = left[i]
            if h >= 0:
                r = ranks.get((live[h], live[i]))
                if r is not None:
                    heapq.heappush(queue, (r, h, live[h], live[i]))
        return [s for s in live if s is not None]

    def piece_ids(self, piece: str) -> str:
        table = self.symbols
        symbols = [table[b] for b in piece.encode("utf-8")]
        symbols[-1] += self.suffix
        vocab = self.vocab
        return " ".join([str(vocab[s]) for s in self.merge(symbols) if s in vocab])

    def chunk_ids(self, chunk: str) -> str:
        """Ids of a run without white space, which pieces never cross."""
        found = self.pieces.findall(chunk)
        if len(found) == 1:
            return self.piece_ids(found[0])
        cache, out = self.cache, []
        for piece in found:
            got = cache.get(piece)
            if got is None:
                cache[piece] = got = self.piece_ids(piece)
            out.append(got)
        return " ".join(out)

    def encode_plain(self, text: str) -> list[str]:
        text = unicodedata.normalize("NFC", text)
        # The tokenizer lowers each character alone, so a capital sigma never takes its final form.
        text = text.replace("Σ", "σ").lower()
        if CONTROL_SEPARATORS.search(text):
            chunks = self.pieces.findall(text)
        else:
            chunks = text.split()
        cache = self.cache
        if len(cache) > CACHE_ENTRIES:
            cache.clear()
        try:
            return list(map(cache.__getitem__, chunks))
        except KeyError:
            for chunk in chunks:
                if chunk not in cache:
                    cache[chunk] = self.chunk_ids(chunk)
            return list(map(cache.__getitem__, chunks))

    def encode(self, text: str) -> str:
        """Decimal ids joined by one space."""
        if self.added_pattern is not None and self.added_mark in text:
            out: list[str] = []
            for part in self.added_pattern.split(text):
                out += [str(self.added[part])] if part in self.added else self.encode_plain(part)
        else:
            out = self.encode_plain(text)
        return " ".join(out)

    def decode(self, ids: str) -> str:
        return " ".join(map(self.strings.__getitem__, ids.split(" "))) if ids else ""


_loaded: dict[str, WordBPE] = {}


def codec(path: str) -> WordBPE:
    """One codec for each worker process and file."""
    if path not in _loaded:
        _loaded[path] = WordBPE(path)
    return _loaded[path]


SCHEMA = "doc_id long, n_tokens long, ids array<int>, decoded string"
DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_decode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """Per row: doc_id, n_tokens, and either ids and the decoded text or, with digests, their SHA-256 digests.

    One pass over the table's own partitions, no shuffle."""

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = codec(path)
        counts, first, second = [], [], []
        for text in texts_of(batch.column(1)):
            ids = c.encode(text)
            counts.append(ids.count(" ") + 1 if ids else 0)
            decoded = c.decode(ids)
            if digests:
                first.append(sha(ids.encode()))
                second.append(sha(decoded.encode("utf-8")))
            else:
                first.append([int(x) for x in ids.split(" ")] if ids else [])
                second.append(decoded)
        kind = pa.string() if digests else pa.list_(pa.int32())
        names = ["doc_id", "n_tokens", *(("ids_sha256", "decoded_sha256") if digests else ("ids", "decoded"))]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(first, kind), pa.array(second, pa.string())], names)

    return map_slices(id_text(df, id_col, text_col), kernel, DIGESTS if digests else SCHEMA)
