"""Finding secrets in whole texts: three fixed patterns and entropy windows.

Method: candidate strings are maximal runs of token characters. For each character class (lower-case hex; upper case
and digits; base 64) a window slides over the parts of a candidate made of that class. Character counts change by one
in and one out, and with them the sum of c*log2(c), so the Shannon entropy of each window costs O(1). Windows at or above
the class's threshold merge into `entropy` spans. The allow-list suppresses the part of a candidate that it matches, and
the rest is still scanned: UUIDs, dates, and path or assignment parts with a placeholder's name are taken out first;
a span without a digit or without a letter (words, plain numbers) is no finding.

Defined results: null counts as the empty text, which has no spans. Spans are code points, end exclusive, ordered by
start and then kind (assign, access, hex, entropy). Equal texts have equal results; repeated rows repeat. A very
long text is scanned whole by one task. An empty table gives no rows. Only the id and text columns are read.
"""

from __future__ import annotations

import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_text, map_slices, sha, texts_of

KINDS = ("assign", "access", "hex", "entropy")
# Fixed patterns of the base kinds; the least length of what counts follows each.
ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ASSIGN_VALUE = 12
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
ACCESS_LENGTH = 18
HEX = re.compile(r"[0-9a-f]{16,}")

WINDOW = 20
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: Character classes and the entropy in bits from which a window of WINDOW characters is suspect.
CLASSES = (
    (re.compile(r"[0-9a-f]{20,}"), 2.9),
    (re.compile(r"[0-9A-Z]{20,}"), 3.3),
    (re.compile(r"[A-Za-z0-9+/_=-]{20,}"), 3.6),
)
#: Parts of a candidate that are no secret; what stands beside them is scanned.
ALLOWED = re.compile(
    r"(?<![0-9A-Za-z])[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}(?![0-9A-Za-z])"  # UUID
    r"|(?<![0-9])\d{4}-\d\d-\d\d(?![0-9])"  # date
    r"|[^/=]*(?i:example|placeholder|changeme|xxxxxx|0000000000|abcdefghij)[^/=]*"  # placeholder
)
#: A finding that is one of these as a whole is none: words, paths and rules without a digit; plain numbers.
HARMLESS = re.compile(r"[^0-9]*|[^A-Za-z]*")
_CLOGC = [0.0, *(c * math.log2(c) for c in range(1, WINDOW + 2))]  # a count is one too high before the oldest goes


def entropy_runs(part: str, threshold: float) -> list[tuple[int, int]]:
    """Merged ranges of the windows whose entropy reaches the threshold, by incremental counts."""
    counts: dict[str, int] = {}
    total, runs = 0.0, []
    # entropy = log2(W) - sum(c log2 c) / W >= threshold
    most = WINDOW * (math.log2(WINDOW) - threshold) + 1e-9
    for i, ch in enumerate(part):
        c = counts.get(ch, 0)
        counts[ch] = c + 1
        total += _CLOGC[c + 1] - _CLOGC[c]
        if i >= WINDOW:
            old = part[i - WINDOW]
            c = counts[old]
            counts[old] = c - 1
            total += _CLOGC[c - 1] - _CLOGC[c]
        if i >= WINDOW - 1 and total <= most:
            a, b = i - WINDOW + 1, i + 1
            if runs and a <= runs[-1][1]:
                runs[-1] = (runs[-1][0], b)
            else:
                runs.append((a, b))
    return runs


def entropy_spans(text: str) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for m in CANDIDATE.finditer(text):
        run, at, parts = m.group(), 0, []
        if HARMLESS.fullmatch(run):
            continue  # so is each part of it
        for allowed in ALLOWED.finditer(run):
            parts.append((at, allowed.start()))
            at = allowed.end()
        parts.append((at, len(run)))
        found = []
        for begin, end in parts:
            if end - begin >= WINDOW:
                for pattern, threshold in CLASSES:
                    for p in pattern.finditer(run, begin, end):
                        found += [(p.start() + a, p.start() + b) for a, b in entropy_runs(p.group(), threshold)]
        for a, b in sorted((m.start() + a, m.start() + b) for a, b in found if not HARMLESS.fullmatch(run, a, b)):
            if out and a <= out[-1][1]:
                out[-1] = (out[-1][0], max(b, out[-1][1]))
            else:
                out.append((a, b))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the three fixed kinds; kind is an index of KINDS."""
    out = []
    if "=" in text or ":" in text:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(1)) >= ASSIGN_VALUE]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LENGTH]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def spell(spans: list[tuple[int, int, int]], kinds: tuple[str, ...] = KINDS) -> str:
    return ",".join([f"{kinds[k]}:{a}:{b}" for a, k, b in spans])


def all_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    base = base_spans(text)
    return base, sorted(base + [(a, 3, b) for a, b in entropy_spans(text)])


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, n_entropy long, n_spans long, base_sha256 string, spans string"


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: counts by kind, the digest of the base spans and all spans spelled kind:start:end. No shuffle."""

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts: tuple[list[int], ...] = ([], [], [], [], [])
        digests, spelled = [], []
        for text in texts_of(batch.column(1)):
            base, both = all_spans(text)
            for k, c in enumerate(counts[:4]):
                c.append(sum(s[1] == k for s in both))
            counts[4].append(len(both))
            digests.append(sha(spell(base).encode()))
            spelled.append(spell(both))
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(spelled, pa.string())], ["doc_id", "n_assign", "n_access", "n_hex", "n_entropy", "n_spans", "base_sha256", "spans"])

    return map_slices(id_text(df, id_col, text_col), kernel, SCHEMA)


def redact(text: str, mark: str = "[SECRET]") -> str:
    """The text with every union of overlapping spans replaced by the mark."""
    out, at = [], 0
    for a, _, b in all_spans(text)[1]:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact_documents(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with secrets in its text replaced; all columns, rows and null texts stay, n_chars follows where it exists."""
    names = df.columns
    at = names.index(text_col)

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [None if t is None else redact(t) for t in batch.column(at).to_pylist()]
        columns = list(batch.columns)
        columns[at] = pa.array(texts, pa.string())
        if "n_chars" in names:
            k = names.index("n_chars")
            columns[k] = pa.array([None if t is None else len(t) for t in texts], pa.int64()).cast(batch.schema.field(k).type)
        return pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return map_slices(df, kernel, df.schema, text_at=at)
