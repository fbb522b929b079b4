"""Removing every byte that a long repeated byte string covers.

A string of `length` bytes repeats if it also starts anywhere else, same document included. Which positions can match at
all is decided first: in each window of `length` bytes the leftmost smallest hash of its `CORE`-byte strings is the
window's anchor, so equal windows have equal anchors at equal offsets. An anchor owns a run of windows; together they
span its context, and anchors are grouped by their core's hash.

1. Contexts that occur more than once (by a 128-bit digest of their bytes and shape) repeat as wholes.
2. Contexts that share their core with others but occur once go to suffix sorting: the contexts of a core's group are
   sorted by the suffix that starts at the anchor, in a bottom-up mergesort whose comparisons find the common extension
   by binary search on prefix polynomial hashes, so each costs O(log length). Neighbouring extensions give those of all
   pairs to the right, binary search those to the left; a pair whose two extensions together reach `length` repeats, after
   its bytes have been compared (collision verification).
3. Groups of more than `GROUP` different contexts are not sorted in one task: their contexts are cut into runs of 64, 8 and
   at last 1 windows, keyed by the digest of the bytes all windows of the run share, and take steps 1 and 2 again. At one
   window a context is its key, so this ends, whatever the skew.

Anchors whose core occurs once in the corpus are left out first, by a table of bits that is merged over all partitions
(a false hit only costs time). All counting is by keys with map-side partial aggregates. Documents are named by a
120-bit digest of their text, so copies share their spans and a lost task recomputes the same names.

Two lengths at once: whatever repeats at the longer one lies within a maximal run at the shorter one, so the longer one
is looked for within those runs alone.

Defined results: null counts as the empty text; texts shorter than `length` keep all bytes; exact copies of at least
`length` bytes lose all bytes, in every copy. A long text is read in segments, so memory does not follow its length
beyond its own bytes. Repeated rows are copies of each other. An empty table gives no rows. Only the id and text columns
are read. Lengths over 1000 are refused: places in a context are packed into ten bits each.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Powers, blocks_of, bloom, forget, get_bits, id_text, map_slices, merged_table, mix, partitions_for, set_bits, settle, sha, sift, sifter, slices, table_bits, tidy, utf8_of

LENGTH, CORE = 400, 48
#: A passage is a repeated string of over PASSAGE_WORDS words; words are taken to fill five bytes each, space included,
#: which gives the length in bytes from which strings are compared for it.
PASSAGE_WORDS = 50
PASSAGE = 5 * PASSAGE_WORDS
GROUP = 64
RUNS = (64, 8, 1)
#: Contexts sorted together in one kernel call.
CHUNK = 2000
#: Text bytes that an anchor kernel sees at once: it holds some dozen arrays of eight bytes for each.
ANCHOR_BYTES = 1 << 19
#: Bytes of input for a bit of a Bloom filter over texts.
BYTES_PER_BIT = 128
BLOOM_BITS = (16, 27)
#: Cells of the table that tells which cores occur again: about eight for an anchor.
SEEN_BITS = (16, 29)
_U = np.uint64
_POWERS = Powers(0xD1342543DE82EF95)
_BYTES = mix(np.arange(1001, 1257, dtype=_U) * _U(0x9E3779B97F4A7C15))
_POSITION_BITS = 28
_LOW = _U((1 << _POSITION_BITS) - 1)


def prefix_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of a polynomial over the bytes, and the powers that move a difference of two to position 0."""
    up, down = _POWERS(len(data) + 1)
    out = np.empty(len(data) + 1, _U)
    out[0] = 0
    np.cumsum(_BYTES[data] * up[:-1], out=out[1:])
    return out, down


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w neighbours."""
    n = len(x) - w + 1
    padded = np.full(-(-len(x) // w) * w, np.iinfo(np.uint64).max, _U)
    padded[: len(x)] = x
    grid = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[w - 1 : w - 1 + n])


def place(first: np.ndarray, lead: np.ndarray, more: np.ndarray) -> np.ndarray:
    """Position of a context's first window, bytes from there to the anchor, and its windows less one, in a long."""
    return (first.astype(np.int64) << 20) | (lead.astype(np.int64) << 10) | more.astype(np.int64)


#: Longest strings whose contexts `place` can pack.
MOST_LENGTH = 1000
FIRST, LEAD, MORE = "shiftright(at, 20)", "(shiftright(at, 10) & 1023)", "(at & 1023)"


def anchors_of(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Row, first window (in data), lead, windows less one and core hash of every anchor, in order.

    The data is read in segments of ANCHOR_BYTES; an anchor's windows may end with a segment and go on in the next."""
    m = len(data) - length + 1
    parts = [_anchors(data[a : a + ANCHOR_BYTES + length - 1], np.clip(offsets - a, 0, None), a, length) for a in range(0, max(m, 0), ANCHOR_BYTES)]
    return tuple(np.concatenate(x) for x in zip(*parts)) if parts else tuple(np.zeros(0, np.int64) for _ in range(5))


def _anchors(data: np.ndarray, offsets: np.ndarray, at: int, length: int) -> tuple[np.ndarray, ...]:
    core = min(CORE, length)
    p, down = prefix_hashes(data)
    m = len(data) - core + 1
    hashes = mix((p[core:] - p[:m]) * down[:m])
    keys = (hashes & ~_LOW) | np.arange(m, dtype=_U)
    chosen = (sliding_min(keys, length - core + 1) & _LOW).astype(np.int64)
    # Windows lie within a text: those that start in the last bytes of one are left out.
    ends = np.minimum(offsets, len(data))
    valid = np.zeros(len(chosen) + 1, np.int64)
    long = np.flatnonzero(np.diff(ends) >= length)
    np.add.at(valid, ends[long], 1)
    np.add.at(valid, ends[long + 1] - length + 1, -1)
    starts = np.flatnonzero(np.cumsum(valid[:-1]))
    if not len(starts):
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    a = chosen[starts]
    row = np.searchsorted(ends, starts, side="right") - 1
    # A run ends where the anchor or the text changes.
    begin = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (row[1:] != row[:-1])]))
    s1, s2 = starts[begin], starts[np.append(begin[1:], len(starts)) - 1]
    return row[begin], s1 + at, a[begin] - s1, s2 - s1, hashes[a[begin]].view(np.int64)


CONTEXT = "kh long, u1 long, u2 long, n1 long, n2 long, at long"


def named(df: DataFrame, text_col: str = "text", mark: str = "") -> DataFrame:
    """df with n1 and n2 (behind the mark), 120 bits of its text's digest."""
    digest = F.sha2(F.coalesce(F.col(text_col).cast("binary"), F.expr("X''")), 256)
    return df.withColumn(f"{mark}n1", F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")).withColumn(f"{mark}n2", F.conv(F.substring(digest, 16, 15), 16, 10).cast("long"))


def anchors_met(plain: DataFrame, length: int) -> DataFrame:
    """Anchors whose core may occur again, with a digest of their context. Two passes: the first fills a table of bits."""
    bits = table_bits(plain, 4, *SEEN_BITS)
    shift = _U(64 - bits)
    cell = lambda kh: mix(kh.view(_U)) >> shift
    size = 1 << (bits - 3)  # bytes of a bit for each cell; one table tells what was seen, another what was seen again

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Two bits' tables that take memory by the pages touched; a table is laid out for the merge block by block.
        once, twice = np.zeros(size, np.uint8), np.zeros(size, np.uint8)
        for batch in batches:
            for part in slices(batch, 0, ANCHOR_BYTES):
                with np.errstate(over="ignore"):
                    cells, c = np.unique(cell(anchors_of(*utf8_of(part.column(0)), length)[4]), return_counts=True)
                set_bits(twice, cells[(c > 1) | get_bits(once, cells)])
                set_bits(once, cells)
        yield from blocks_of(once, twice)

    def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.stack([a[:, 0] | b[:, 0], a[:, 1] | b[:, 1] | (a[:, 0] & b[:, 0])], axis=1)

    met = merged_table(plain.select("text"), run, np.zeros((size, 2), np.uint8), merge, lambda x: x[:, 1])
    sent = plain.sparkSession.sparkContext.broadcast(met)

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        data, offsets = utf8_of(batch.column(0))
        with np.errstate(over="ignore"):
            found = anchors_of(data, offsets, length)
            hit = get_bits(sent.value, cell(found[4])) if len(found[4]) else np.zeros(0, bool)
        row, first, lead, more, kh = (x[hit] for x in found)
        if not len(row):
            return None
        view, digests = memoryview(data), bytearray()
        for a, shape, b in zip(first.tolist(), (lead * 1024 + more).tolist(), (first + more + length).tolist()):
            digests += hashlib.blake2b(view[a:b], digest_size=16, salt=shape.to_bytes(4, "little")).digest()
        u = np.frombuffer(bytes(digests), np.int64).reshape(-1, 2)
        names = [np.asarray(batch.column(k))[row] for k in (1, 2)]
        columns = (kh, u[:, 0], u[:, 1], *names, place(first - offsets[row], lead, more))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["kh", "u1", "u2", "n1", "n2", "at"])

    return map_slices(plain.select("text", "n1", "n2"), kernel, CONTEXT, text_at=0, most=ANCHOR_BYTES)


def lce(p: np.ndarray, down: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray, back: bool = False) -> np.ndarray:
    """Common extension, at most `most`, of the byte strings that start (back: end) at a and b, by binary search."""
    low, high = np.zeros(len(a), np.int64), most.astype(np.int64).copy()
    for _ in range(int(high.max(initial=0)).bit_length()):
        mid = (low + high + 1) >> 1
        x, y = (a - mid, b - mid) if back else (a, b)
        same = (p[x + mid] - p[x]) * down[x] == (p[y + mid] - p[y]) * down[y]
        low = np.where(same, mid, low)
        high = np.where(same, high, mid - 1)
    return low


def sorted_suffixes(data: np.ndarray, p: np.ndarray, down: np.ndarray, start: np.ndarray, size: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Indices of the suffixes, ascending within each group: a bottom-up mergesort, all runs of a width at once.

    group ascends. Each element's rank in its partner run is found by binary search over suffix comparisons."""
    n = len(start)
    first = np.searchsorted(group, group)
    count = np.searchsorted(group, group, side="right") - first
    local = np.arange(n) - first
    order = np.arange(n)

    def before(i: np.ndarray, j: np.ndarray, ties: np.ndarray) -> np.ndarray:
        """Whether suffix i sorts before suffix j; equal ones as `ties` says."""
        most = np.minimum(size[i], size[j])
        e = lce(p, down, start[i], start[j], most)
        x = np.where(e < size[i], data[np.minimum(start[i] + e, len(data) - 1)].astype(np.int64), -1)
        y = np.where(e < size[j], data[np.minimum(start[j] + e, len(data) - 1)].astype(np.int64), -1)
        return np.where(x == y, ties, x < y)

    width = 1
    while width < int(count.max(initial=1)):
        run = local // width
        left = run % 2 == 0
        other = np.where(left, run + 1, run - 1) * width
        low = np.minimum(other, count)
        high = np.minimum(other + width, count)
        base = low.copy()
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                break
            mid = (low[open_] + high[open_]) >> 1
            # The partner at mid stays before this element; of equal ones the left run's come first.
            ahead = before(order[first[open_] + mid], order[open_], ~left[open_])
            low[open_] = np.where(ahead, mid + 1, low[open_])
            high[open_] = np.where(ahead, high[open_], mid)
        target = first + (local // (2 * width)) * 2 * width + local % width + (low - base)
        moved = np.empty_like(order)
        moved[target] = order
        order = moved
        width *= 2
    return order


def repeated_in_groups(group: np.ndarray, texts: list[bytes], lead: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each context the bytes (from, to) that repeated strings around its anchor cover; from >= to if none."""
    sizes = np.array([len(t) for t in texts], np.int64)
    stops = np.cumsum(sizes)
    begins = stops - sizes
    joined = b"".join(texts)
    data = np.frombuffer(joined, np.uint8)
    p, down = prefix_hashes(data)
    a = begins + lead
    order = sorted_suffixes(data, p, down, a, stops - a, group)
    lo, hi = lead.copy(), lead.copy()
    # Extensions of sorted neighbours; that of two further apart is the least between them.
    right = np.full(len(order), 1 << 40, np.int64)
    i = np.arange(len(order) - 1)
    i = i[group[order[i]] == group[order[i + 1]]]
    near = np.zeros(len(order), np.int64)
    near[i] = lce(p, down, a[order[i]], a[order[i + 1]], np.minimum((stops - a)[order[i]], (stops - a)[order[i + 1]]))
    gap, active = 1, i
    while len(active):
        right[active] = np.minimum(right[active], near[active + gap - 1])
        active = active[right[active] > 0]
        x, y = order[active], order[active + gap]
        back = lce(p, down, a[x], a[y], np.minimum(lead[x], lead[y]), back=True)
        hit = np.flatnonzero(back + right[active] >= length)
        for u, v, l, r in zip(x[hit].tolist(), y[hit].tolist(), back[hit].tolist(), right[active][hit].tolist()):
            s, t = int(a[u]), int(a[v])
            if joined[s - l : s + r] == joined[t - l : t + r]:  # not a collision
                for w in (u, v):
                    lo[w] = min(lo[w], lead[w] - l)
                    hi[w] = max(hi[w], lead[w] + r)
        gap += 1
        active = active[active + gap < len(order)]
        active = active[group[order[active]] == group[order[active + gap]]]
    return lo, hi


SPANS = "n1 long, n2 long, lo long, hi long"
WORK = "kh long, n1 long, n2 long, first long, lead int, target boolean, data binary"


def sort_groups(work: DataFrame, length: int) -> DataFrame:
    """Spans from groups of at most GROUP contexts, which lie together in partitions sorted by kh."""

    def solve(rows: pa.Table) -> pa.RecordBatch:
        kh, lead = np.asarray(rows["kh"]), np.asarray(rows["lead"]).astype(np.int64)
        with np.errstate(over="ignore"):
            lo, hi = repeated_in_groups(np.unique(kh, return_inverse=True)[1], rows["data"].to_pylist(), lead, length)
        keep = np.asarray(rows["target"]).astype(bool) & (hi > lo)
        first = np.asarray(rows["first"])
        return pa.RecordBatch.from_arrays([pa.array(np.asarray(rows["n1"])[keep]), pa.array(np.asarray(rows["n2"])[keep]), pa.array((first + lo)[keep]), pa.array((first + hi)[keep])], ["n1", "n2", "lo", "hi"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= CHUNK:
                table = pa.Table.from_batches(held)
                kh = np.asarray(table["kh"])
                cut = int(np.searchsorted(kh, kh[-1]))  # the last group may go on
                if cut:
                    yield solve(table.slice(0, cut))
                held = table.slice(cut).combine_chunks().to_batches()
                rows = table.num_rows - cut
        if rows:
            yield solve(pa.Table.from_batches(held))

    return work.repartition(partitions_for(work), "kh").sortWithinPartitions("kh").mapInArrow(tidy(run), SPANS)


def cut_contexts(work: DataFrame, windows: int, length: int) -> DataFrame:
    """Contexts cut into runs of so many windows, aligned to the anchor, each keyed by the bytes all its windows share."""

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: tuple[list, ...] = tuple([] for _ in range(9))
        rows = zip(*(batch.column(c).to_pylist() for c in ("kh", "n1", "n2", "first", "lead", "target", "data")))
        for kh, n1, n2, first, lead, target, data in rows:
            last = len(data) - length  # windows 0..last; a window w has w - lead relative to the anchor
            w = 0
            while w <= last:
                block = (w - lead) // windows
                stop = min(last, (block + 1) * windows + lead - 1)
                # The bytes that all windows of the whole block share lie in each of them, so in this part.
                a = block * windows + lead + windows - 1
                shared = data[a : a - windows + 1 + length]
                part = data[w : stop + length]
                key = hashlib.blake2b(repr((kh, block)).encode() + shared, digest_size=8).digest()
                whole = hashlib.blake2b(repr((kh, block, w - lead)).encode() + part, digest_size=16).digest()
                for x, v in zip(out, (int.from_bytes(key, "little", signed=True), int.from_bytes(whole[:8], "little", signed=True), int.from_bytes(whole[8:], "little", signed=True), n1, n2, first + w, lead - w, target, part)):
                    x.append(v)
                w = stop + 1
        kinds = [*[pa.int64()] * 6, pa.int32(), pa.bool_(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds)], ["kh", "u1", "u2", "n1", "n2", "first", "lead", "target", "data"])

    return map_slices(work, kernel, "kh long, u1 long, u2 long, n1 long, n2 long, first long, lead int, target boolean, data binary", text_at=6)


def one_of_each_text(wanted: DataFrame, plain: DataFrame) -> DataFrame:
    """text, n1, n2 and copies (how often it occurs) of the texts named in wanted, and perhaps of a few others."""
    table = plain.sparkSession.sparkContext.broadcast(bloom(wanted.select("n1").distinct(), "n1", table_bits(plain, BYTES_PER_BIT, *BLOOM_BITS)))
    return sift(plain.select("text", "n1", "n2"), table, True, 1).groupBy("n1", "n2").agg(F.first("text").alias("text"), F.count("*").alias("copies")).select("text", "n1", "n2", "copies")


def fetched(wanted: DataFrame, plain: DataFrame, length: int) -> DataFrame:
    """The contexts' bytes, from one copy of each text that has any."""
    lists = wanted.groupBy("n1", "n2").agg(F.collect_list(F.struct("kh", "at", "target", "different")).alias("list"))

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: tuple[list, ...] = tuple([] for _ in range(8))
        for raw, n1, n2, found in zip(*(batch.column(k).to_pylist() for k in range(4))):
            for x in found:
                first, lead, more = x["at"] >> 20, (x["at"] >> 10) & 1023, x["at"] & 1023
                for o, v in zip(out, (x["kh"], n1, n2, first, lead, x["target"], raw[first : first + more + length], x["different"])):
                    o.append(v)
        kinds = [*[pa.int64()] * 4, pa.int32(), pa.bool_(), pa.binary(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds)], ["kh", "n1", "n2", "first", "lead", "target", "data", "different"])

    joined = one_of_each_text(wanted, plain).join(lists, ["n1", "n2"]).select("text", "n1", "n2", "list")
    return map_slices(joined, kernel, f"{WORK}, different long", text_at=0)


def open_groups(each: DataFrame, unsolved: F.Column) -> DataFrame:
    """Cores with several contexts of which one is unsolved: kh and their number; settled, so that joins can split them."""
    return settle(each.groupBy("kh").agg(F.count("*").alias("different"), F.max(unsolved).alias("open")).filter("different > 1 and open").select("kh", "different"), "groups")


def repeated_spans(plain: DataFrame, length: int = LENGTH) -> DataFrame:
    """Byte ranges covered by repeated strings, by the text's name: n1, n2, lo, hi. plain: text (binary), n1, n2."""
    if length > MOST_LENGTH:
        raise ValueError(f"repeated strings of over {MOST_LENGTH} bytes can't be placed in ten bits")
    table = settle(anchors_met(plain, length), "anchors-met")
    each = settle(table.groupBy("u1", "u2").agg(F.count("*").alias("c"), *(F.min(x).alias(x) for x in ("kh", "n1", "n2", "at"))), "contexts")
    groups = open_groups(each, F.col("c") == 1)
    whole = settle(table.join(each.filter("c > 1").select("u1", "u2"), ["u1", "u2"], "left_semi"), "contexts-met")
    spans = whole.select("n1", "n2", F.expr(FIRST).alias("lo"), F.expr(f"{FIRST} + {MORE} + {length}").alias("hi")).distinct()
    one = whole.dropDuplicates(["u1", "u2"]).select("kh", "n1", "n2", "at", F.lit(False).alias("target"))
    own = each.filter("c = 1").select("kh", "n1", "n2", "at", F.lit(True).alias("target"))
    wanted = settle(own.unionByName(one).join(groups, "kh"), "wanted")
    work = settle(fetched(wanted, plain, length), "work")
    forget(table, each, groups, wanted)
    held = [whole, work]
    for windows in RUNS:
        few = F.col("different") <= GROUP
        spans = spans.unionByName(sort_groups(work.filter(few).drop("different"), length))
        many = work.filter(~few).drop("different")
        if many.isEmpty():
            break
        cut = settle(cut_contexts(many, windows, length), "cut")
        each = settle(cut.groupBy("u1", "u2").agg(F.count("*").alias("c"), F.min("kh").alias("kh"), F.max("target").alias("target")), "cut-contexts")
        again = each.filter("c > 1").select("u1", "u2")
        met = cut.filter("target").join(again, ["u1", "u2"], "left_semi")
        spans = spans.unionByName(met.select("n1", "n2", F.col("first").alias("lo"), (F.col("first") + F.length("data")).alias("hi")))
        groups = open_groups(each, (F.col("c") == 1) & F.col("target"))
        state = each.join(groups, "kh").select("u1", "u2", "c", "different")
        work = cut.dropDuplicates(["u1", "u2"]).join(state, ["u1", "u2"]).withColumn("target", F.col("target") & (F.col("c") == 1))
        work = settle(work.select("kh", "n1", "n2", "first", "lead", "target", "data", "different"), "work")
        held += [cut, each, groups, work]
    out = settle(spans, "spans")
    forget(*held)
    return out


def repeated_runs(rows: DataFrame, length: int, longer: int | None = None) -> DataFrame:
    """By the text's name: n1, n2, runs (maximal ranges that repeated strings of `length` bytes cover) and, with a longer
    length, removed (the same for that length; null where there are none). rows: text (binary), n1, n2. Settled."""
    spans = repeated_spans(rows, length)
    runs = spans.groupBy("n1", "n2").agg(F.collect_set(F.struct("lo", "hi")).alias("runs"))
    kind = "array<struct<lo:long,hi:long>>"

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            merged = [union_of([(x["lo"], x["hi"]) for x in found]) for found in batch.column("runs").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("n1"), batch.column("n2"), pa.array([[{"lo": a, "hi": b} for a, b in m] for m in merged], pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())])))], ["n1", "n2", "runs"])

    runs = settle(runs.mapInArrow(joined, f"n1 long, n2 long, runs {kind}"), "runs")
    forget(spans)
    if longer is None:
        return runs
    enough = runs.select("n1", "n2", F.filter("runs", lambda x: x["hi"] - x["lo"] >= longer).alias("runs")).filter(F.size("runs") > 0)

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: tuple[list, ...] = tuple([] for _ in range(5))
        for raw, n1, n2, copies, found in zip(*(batch.column(k).to_pylist() for k in range(5))):
            for x in found:
                for o, v in zip(out, (raw[x["lo"] : x["hi"]], n1, n2, copies, x["lo"])):
                    o.append(v)
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.binary(), *[pa.int64()] * 4))], ["text", "t1", "t2", "copies", "base"])

    pieces = one_of_each_text(enough, rows).join(enough, ["n1", "n2"]).select("text", "n1", "n2", "copies", "runs")
    pieces = settle(named(map_slices(pieces, cut, "text binary, t1 long, t2 long, copies long, base long", text_at=0)), "long-runs")
    within = repeated_spans(pieces.select("text", "n1", "n2"), longer)
    # A text that occurs more than once repeats wherever it is long enough.
    spread = within.join(pieces.select("n1", "n2", "t1", "t2", "base"), ["n1", "n2"]).select(F.col("t1").alias("n1"), F.col("t2").alias("n2"), (F.col("base") + F.col("lo")).alias("lo"), (F.col("base") + F.col("hi")).alias("hi"))
    whole = pieces.filter("copies > 1").select(F.col("t1").alias("n1"), F.col("t2").alias("n2"), F.col("base").alias("lo"), (F.col("base") + F.length("text")).alias("hi"))
    removed = settle(spread.union(whole).groupBy("n1", "n2").agg(F.collect_set(F.struct("lo", "hi")).alias("removed")), "removed")
    out = settle(runs.join(removed, ["n1", "n2"], "left"), "runs-both")
    forget(runs, within, pieces, removed)
    return out


def words_in(raw: bytes) -> int:
    return len(re.findall(rb"[^\x20\x09-\x0D]+", raw))


def passages(raw: bytes, runs: list[tuple[int, int]], words: int = PASSAGE_WORDS, length: int = LENGTH) -> list[tuple[int, int]]:
    """The runs that hold over so many words, or `length` bytes whatever they hold (text without spaces)."""
    return [(a, b) for a, b in runs if b - a >= length or words_in(raw[a:b]) > words]


def union_of(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs, ascending."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def without(raw: bytes, runs: list[tuple[int, int]]) -> bytes:
    kept, at = [], 0
    for lo, hi in runs:
        kept.append(raw[at:lo])
        at = hi
    return b"".join([*kept, raw[at:]])


def map_with_runs(df: DataFrame, text_col: str, length: int, longer: int | None, kernel: Callable[[pa.RecordBatch, list[dict]], pa.RecordBatch], schema) -> DataFrame:
    """kernel(rows, found) over df's rows; found holds each row's runs and removed (see repeated_runs), {} if it has none.

    Rows without any are not shuffled, and pass the Bloom filter and the kernel in one worker. The columns of df are
    carried under names of their own, so none can clash."""
    columns, n, text_at = df.columns, len(df.columns), df.columns.index(text_col)
    plain = df.toDF(*(f"c{k}" for k in range(n)))
    rows = named(plain, f"c{text_at}")
    texts = named(plain.select(F.coalesce(F.col(f"c{text_at}").cast("string"), F.lit("")).alias("text"))).select(F.col("text").cast("binary").alias("text"), "n1", "n2")
    lists = repeated_runs(texts, length, longer)
    table = df.sparkSession.sparkContext.broadcast(bloom(lists.select("n1"), "n1", table_bits(df, BYTES_PER_BIT, *BLOOM_BITS)))
    kept = [f"c{k}" for k in range(n)]
    extra = [c for c in lists.columns if c not in ("n1", "n2")]

    def with_lists(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = pa.RecordBatch.from_arrays(batch.columns[:n], columns)
        if batch.schema.names[n] == "n1":
            return kernel(own, [{}] * batch.num_rows)
        return kernel(own, [dict(zip(extra, x)) for x in zip(*(batch.column(c).to_pylist() for c in extra))])

    free = map_slices(rows, with_lists, schema, text_at, first=sifter(table, False, n))
    held = sift(rows, table, True, n).join(lists, ["n1", "n2"], "left").select(*kept, *extra)
    return free.unionByName(map_slices(held, with_lists, schema, text_at))


def remove_repeats(df: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", passage: int = PASSAGE, words: int = PASSAGE_WORDS) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans and the digest of the remaining bytes, for strings of `length` bytes;
    n_passages and passage_bytes count the repeated passages of over `words` words, which shorter strings make."""
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passages", "passage_bytes"]
    short = min(length, passage)
    cut_by = "removed" if length > short else "runs"

    def kernel(batch: pa.RecordBatch, found: list[dict]) -> pa.RecordBatch:
        out: tuple[list, ...] = tuple([] for _ in range(6))
        for text, x in zip(batch.column(1).to_pylist(), found):
            raw = (text or "").encode("utf-8")
            cut = union_of([(s["lo"], s["hi"]) for s in x.get(cut_by) or ()])
            rest = without(raw, cut)
            held = passages(raw, [(s["lo"], s["hi"]) for s in x.get("runs") or ()], words, length)
            for o, v in zip(out, (len(raw), len(raw) - len(rest), len(cut), sha(rest), len(held), sum(b - a for a, b in held))):
                o.append(v)
        kinds = [pa.string() if n == "kept_sha256" else pa.int64() for n in names[1:]]
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(o, t) for o, t in zip(out, kinds))], names)

    return map_with_runs(id_text(df, id_col, text_col), "text", short, length if length > short else None, kernel, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passages long, passage_bytes long")


def clean_documents(df: DataFrame, length: int = PASSAGE, words: int = PASSAGE_WORDS, text_col: str = "text") -> DataFrame:
    """df with repeated passages cut from its text, whole code points only; a row whose text is used up is dropped.

    A passage is a maximal run of repeated strings of `length` bytes that holds over `words` words, or LENGTH bytes. n_chars
    follows where it exists; rows that had no text or an empty one stay as they are."""
    at, columns = df.columns.index(text_col), df.columns

    def whole_points(raw: bytes, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
        out = []
        for lo, hi in runs:
            while lo < hi and raw[lo] & 0xC0 == 0x80:
                lo += 1
            while hi > lo and hi < len(raw) and raw[hi] & 0xC0 == 0x80:
                hi -= 1
            out.append((lo, hi))
        return out

    def kernel(batch: pa.RecordBatch, found: list[dict]) -> pa.RecordBatch:
        texts, keep = [], []
        for text, x in zip(batch.column(at).to_pylist(), found):
            raw = text.encode("utf-8") if x.get("runs") else b""
            cut = passages(raw, [(s["lo"], s["hi"]) for s in x.get("runs") or ()], words)
            if cut:
                text = without(raw, whole_points(raw, cut)).decode("utf-8")
                keep.append(bool(text.strip()))
            else:
                keep.append(True)
            texts.append(text)
        out = list(batch.columns)
        out[at] = pa.array(texts, pa.string())
        if "n_chars" in columns:
            k = columns.index("n_chars")
            out[k] = pa.array([None if t is None else len(t) for t in texts], pa.int64()).cast(batch.schema.field(k).type)
        return pa.RecordBatch.from_arrays(out, columns).filter(pa.array(keep, pa.bool_()))

    return map_with_runs(df, text_col, length, None, kernel, df.schema)
