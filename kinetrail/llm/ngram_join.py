"""Near-duplicate documents by a Jaccard join on word n-grams.

Method: every set of n-grams is ordered rare first, by a corpus-wide frequency table (a count sketch whose size follows
the input up to a bound; any one global order gives right results, a sharper table only fewer candidates). Two sets
with Jaccard likeness >= t share an n-gram among the first n - ceil(t n) + 1 of each, so only those prefixes are
joined. Candidates pass a length filter and a positional filter in the join, are made distinct, pass a suffix filter
(per range of hash values, no more n-grams can be shared than the smaller count) and are verified once each, against the
whole sets. Documents with equal sets form one class first and only class representatives join.

Prefix n-grams that only one class has are dropped before the join. A pair meets only where a run of n-grams that both
prefixes share begins. Each bucket's classes first meet its leader, and then only pairs that those links have not
connected: that gives the components exactly, with few pairs of a group of copies.

All links lie within components, so the numbers of links are found there. Where a component's prefix buckets promise fewer
pairs than its classes could make, the prefix join makes them as rows. In a dense component (a group of near copies) they
would be all pairs of a group; there the classes are dealt into blocks, each pair of blocks is one kernel call that joins
the two blocks' prefixes, filters and verifies each candidate once, and only each class's number of links leaves it.
Buckets of more than `BLOCK` classes are split into block pairs too, so no task holds a whole hot bucket. N-grams are
64-bit hashes of their words.

Defined results: null texts and texts without words have an empty set, linked with nothing, and are their own
component. Fewer words than n count as one n-gram. Repeated rows link with each other. Components take the smallest
doc_id; a null id stays null unless its component has another. A very long text is
one set, hashed whole by one task. An empty table gives no rows. Only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from .common import Powers, blocks_of, bloom, forget, id_text, in_bloom, map_slices, merged_table, mix, settle, sha, sift, slices, table_bits, tidy, utf8_of

_U = np.uint64
_POWERS = Powers(0xA24BAED4963EE407)
_BYTES = mix(np.arange(11, 267, dtype=_U) * _U(0x9FB21C651E98DF25))
_BYTES[[9, 10, 11, 12, 13, 32]] = 0  # separators add nothing to a word's hash
_BYTES[65:91] = _BYTES[97:123]  # A-Z count as a-z
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[9, 10, 11, 12, 13, 32]] = True
#: Classes of a bucket that join within one block pair.
BLOCK = 256
#: Whole sets of a block of classes hold about so many n-grams at most (a larger set is a block of its own).
BLOCK_GRAMS = 1 << 18
#: A component whose buckets hold at least this many pairs, for the square of its classes, is dense.
DENSE_SHARE = 1 / 16
SKETCH_BITS = (14, 25)
BLOOM_BITS = (16, 27)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and the rows+1 offsets of each text's words."""
    if not len(data):
        return np.zeros(0, _U), np.zeros(len(offsets), np.int64)
    inside = ~_SEPARATOR[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = offsets[:-1][np.diff(offsets) > 0]
    begins[edges] = inside[edges]
    at = np.flatnonzero(begins)
    bounds = np.searchsorted(at, offsets)
    if not len(at):
        return np.zeros(0, _U), bounds
    up, down = _POWERS(len(data))
    return mix(np.add.reduceat(_BYTES[data] * up, at) * down[at]), bounds


def ngram_hashes(words: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams in order (not distinct) and their offsets; a text of fewer words has one."""
    sizes = np.diff(bounds)
    m = max(0, len(words) - n + 1)
    rolled = np.zeros(m, _U)
    for k in range(n):
        rolled += words[k : k + m] * _U((2 * k + 1) * 0xC2B2AE3D27D4EB4F & 0xFFFFFFFFFFFFFFFF)
    counts = np.where(sizes >= n, sizes - n + 1, (sizes > 0).astype(np.int64))
    stops = np.cumsum(counts)
    out = np.empty(int(stops[-1]) if len(stops) else 0, _U)
    keep = np.ones(m, bool)
    # The last n-1 starts of a text, and every start of a short one, run into the next text.
    for k in range(1, n):
        tail = bounds[1:] - k
        tail = tail[(tail >= bounds[:-1]) & (tail < m)]
        keep[tail] = False
    is_full = np.repeat(sizes >= n, counts)
    out[is_full] = mix(rolled[keep])
    for i in np.flatnonzero((sizes > 0) & (sizes < n)).tolist():
        h = _U(sizes[i])
        for w in words[bounds[i] : bounds[i + 1]]:
            h = mix(np.array([h * _U(0x9E3779B97F4A7C15) + w], _U))[0]
        out[stops[i] - 1] = h
    return out, np.concatenate([[0], stops]).astype(np.int64)


def sets_of(column: pa.Array, n: int) -> list[np.ndarray]:
    """The distinct n-gram hashes of every text, ascending."""
    with np.errstate(over="ignore"):
        grams, bounds = ngram_hashes(*word_hashes(*utf8_of(column)), n)
    b = bounds.tolist()
    out = []
    for i, j in zip(b, b[1:]):
        s = np.sort(grams[i:j])
        if len(s) > 1:
            s = s[np.concatenate([[True], s[1:] != s[:-1]])]
        out.append(s)
    return out


def frequencies(df: DataFrame, n: int) -> np.ndarray:
    """Corpus-wide n-gram counts by the leading bits of the hash, on a logarithmic scale of one byte."""
    bits = table_bits(df, 32, *SKETCH_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << bits, np.uint32)
        for batch in batches:
            for part in slices(batch):
                with np.errstate(over="ignore"):
                    grams, _ = ngram_hashes(*word_hashes(*utf8_of(part.column(1))), n)
                at, c = np.unique(grams >> _U(64 - bits), return_counts=True)
                counts[at] += c.astype(np.uint32)
        yield from blocks_of(counts)

    def scaled(total: np.ndarray) -> np.ndarray:
        return np.minimum(255, np.rint(8 * np.log2(total.astype(np.float32) + 1))).astype(np.uint8)

    return merged_table(df, run, np.zeros(1 << bits, np.uint32), np.add, scaled)


def histogram(s: np.ndarray) -> bytes:
    """N-grams by range of hash values; as many ranges as a quarter of the set, a power of two."""
    bits = min(10, max(4, int(len(s) // 4).bit_length()))
    return np.bincount((s >> _U(64 - bits)).astype(np.int64), minlength=1 << bits).clip(max=65535).astype(np.uint16).tobytes()


def shared_at_most(a: bytes, b: bytes) -> int:
    x, y = np.frombuffer(a, np.uint16), np.frombuffer(b, np.uint16)
    if max(x.max(), y.max()) == 65535:
        return 1 << 62  # counts were cut: no bound
    if len(x) > len(y):
        x, y = y, x
    return int(np.minimum(x, y.reshape(len(x), -1).sum(axis=1)).sum())


def prefixes(df: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """Per row: doc_id, a key of its set, its size, the prefix n-grams rare first, and the suffix histogram."""
    table = df.sparkSession.sparkContext.broadcast(frequencies(df, n))

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        rank = table.value
        shift = _U(64 - (len(rank).bit_length() - 1))
        keys, sizes, tokens, sums = [], [], [], []
        for s in sets_of(batch.column(1), n):
            m = len(s)
            keys.append(sha(s.tobytes())[:32] if m else None)
            sizes.append(m)
            length = m - (m * num + den - 1) // den + 1 if m else 0
            order = (rank[s >> shift].astype(_U) << _U(56)) | (s >> _U(8))
            first = np.argpartition(order, length - 1)[:length] if 0 < length < m else np.arange(m)
            tokens.append(s[first[np.argsort(order[first], kind="stable")]][:length].view(np.int64))
            sums.append(histogram(s) if m else None)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.string()), pa.array(sizes, pa.int64()), pa.array(tokens, pa.list_(pa.int64())), pa.array(sums, pa.binary())], ["doc_id", "key", "n", "tokens", "sums"])

    return map_slices(df, kernel, "doc_id long, key string, n long, tokens array<long>, sums binary")


def prefix_entries(reps: DataFrame) -> DataFrame:
    """Prefix n-grams (t) that more than one class has: t, the one before it in the prefix, node, n, pos, and the bucket's size c."""
    before = F.concat(F.array(F.lit(None).cast("long")), F.slice("tokens", 1, F.size("tokens") - 1))
    entries = reps.withColumn("before", before).select("node", "n", F.posexplode(F.arrays_zip("tokens", "before")).alias("pos", "x"))
    entries = entries.select("node", "n", "pos", F.col("x.tokens").alias("t"), F.col("x.before").alias("before"))
    shared = entries.groupBy("t").agg(F.count("*").alias("c")).filter("c > 1")
    return settle(entries.join(shared, "t"), "prefix-entries")


def may_reach(num: int, den: int) -> F.Column:
    """Length and positional filters on columns na, pa and nb, pb: sizes, and the shared n-gram's place in each prefix.

    Up to the shared n-gram nothing need be shared, so the intersection is at most the shorter rest."""
    least = F.ceil((F.col("na") + F.col("nb")) * num / (num + den) - 1e-9)
    lengths = F.least("na", "nb") * den >= F.greatest("na", "nb") * num
    return lengths & (F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) >= least)


def leader_pairs(entries: DataFrame, num: int, den: int) -> DataFrame:
    """Each bucket's classes with its leader, the one that comes to the shared n-gram first: a row for each entry."""
    leaders = entries.groupBy("t").agg(F.min_by("node", "pos").alias("b"), F.min_by("n", "pos").alias("nb"), F.min("pos").alias("pb"))
    met = entries.select("t", F.col("node").alias("a"), F.col("n").alias("na"), F.col("pos").alias("pa")).join(leaders, "t")
    met = met.filter(F.col("a") != F.col("b")).filter(may_reach(num, den))
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def block_pairs(entries: DataFrame, carry: str, fits: F.Column) -> DataFrame:
    """The distinct pairs (a < b) of a bucket's classes that pass `fits`, which sees na, pa, nb, pb and xa, xb (of `carry`).

    A bucket of c classes has ceil(c / BLOCK) blocks, and block i meets every block j >= i, so a hot bucket spreads over
    many tasks."""
    blocks = F.ceil(F.col("c") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("node", "t"), blocks).cast("int")
    entries = entries.select("t", "node", "n", "pos", carry, own.alias("own"), blocks.alias("blocks"))
    left = entries.select("t", F.col("own").alias("i"), F.explode(F.sequence("own", F.col("blocks") - 1)).alias("j"), F.col("node").alias("a"), F.col("n").alias("na"), F.col("pos").alias("pa"), F.col(carry).alias("xa"))
    right = entries.select("t", F.explode(F.sequence(F.lit(0), "own")).alias("i"), F.col("own").alias("j"), F.col("node").alias("b"), F.col("n").alias("nb"), F.col("pos").alias("pb"), F.col(carry).alias("xb"))
    met = left.join(right, ["t", "i", "j"]).filter(((F.col("i") < F.col("j")) | (F.col("a") < F.col("b"))) & fits)
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def all_pairs(entries: DataFrame, num: int, den: int) -> DataFrame:
    """All pairs of classes that share a prefix n-gram and pass the filters, met where a shared run begins.

    If the n-grams before are the same, that bucket holds both classes too, at earlier places, where the filters pass."""
    begins = ~F.coalesce(F.col("xa") == F.col("xb"), F.lit(False))
    return block_pairs(entries, "before", begins & may_reach(num, den))


def remaining_pairs(entries: DataFrame, labels: DataFrame, num: int, den: int) -> DataFrame:
    """All pairs of a bucket that the leaders' links have not connected yet, by the same filters.

    Buckets whose classes are connected already go as a whole."""
    entries = entries.join(labels, "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component")
    apart = entries.groupBy("t").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x <> y").select("t")
    return block_pairs(entries.join(apart, "t"), "label", (F.col("xa") != F.col("xb")) & may_reach(num, den))


def whole_sets(needed: DataFrame, plain: DataFrame, n: int) -> DataFrame:
    """key and grams (the whole set) of the needed keys; a Bloom filter of fixed bounds lets other documents pass by. Settled."""
    number = F.conv(F.substring("key", 1, 15), 16, 10).cast("long")
    table = plain.sparkSession.sparkContext.broadcast(bloom(needed.select(number.alias("k")), "k", table_bits(plain, 128, *BLOOM_BITS)))

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[str] = set()  # a partition sends each set once, however many copies of its text it has
        for batch in batches:
            for part in slices(batch):
                sets = [s for s in sets_of(part.column(1), n) if len(s)]
                keys = [sha(s.tobytes())[:32] for s in sets]
                hit = in_bloom(table.value, np.array([int(k[:15], 16) for k in keys], np.uint64)) if keys else []
                got = {k: s.tobytes() for k, s, h in zip(keys, sets, hit) if h and k not in seen}
                seen.update(got)
                if got:
                    yield pa.RecordBatch.from_arrays([pa.array(list(got), pa.string()), pa.array(list(got.values()), pa.binary())], ["key", "grams"])

    found = plain.mapInArrow(tidy(wanted), "key string, grams binary").dropDuplicates(["key"])
    return settle(found.join(needed.distinct(), "key", "left_semi"), "whole-sets")


def verified(pairs: DataFrame, reps: DataFrame, plain: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose whole sets reach num/den: a suffix filter first, then each pair once."""
    sides = reps.select("node", "key", "n", "sums")
    one = sides.select(F.col("node").alias("a"), F.col("key").alias("key_a"), F.col("n").alias("na"), F.col("sums").alias("sums_a"))
    two = sides.select(F.col("node").alias("b"), F.col("key").alias("key_b"), F.col("n").alias("nb"), F.col("sums").alias("sums_b"))

    def suffix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb, x, y = (batch.column(c).to_pylist() for c in ("na", "nb", "sums_a", "sums_b"))
            keep = [shared_at_most(p, q) * (num + den) >= num * (i + j) for i, j, p, q in zip(na, nb, x, y)]
            yield batch.select(["a", "b", "key_a", "key_b"]).filter(pa.array(keep, pa.bool_()))

    passed = pairs.join(one, "a").join(two, "b").select("a", "b", "na", "nb", "key_a", "key_b", "sums_a", "sums_b").mapInArrow(tidy(suffix), "a long, b long, key_a string, key_b string")
    passed = settle(passed, "near-pairs")
    needed = passed.select(F.col("key_a").alias("key")).union(passed.select("key_b")).distinct()
    whole = whole_sets(needed, plain, n)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for p, q in zip(batch.column("grams_a"), batch.column("grams_b")):
                x, y = np.frombuffer(p.as_buffer(), np.uint64), np.frombuffer(q.as_buffer(), np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(den * common >= num * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    both = passed.join(whole.select(F.col("key").alias("key_a"), F.col("grams").alias("grams_a")), "key_a").join(whole.select(F.col("key").alias("key_b"), F.col("grams").alias("grams_b")), "key_b")
    out = settle(both.select("a", "b", "grams_a", "grams_b").mapInArrow(tidy(verify), "a long, b long"), "links")
    forget(passed, whole)
    return out


def ranges(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All integers of the ranges, one range after the other."""
    sizes = ends - starts
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


class _Index:
    """Which rows of a block hold a value, and at which place of theirs."""

    def __init__(self, lists: list[np.ndarray]):
        sizes = np.array([len(x) for x in lists], np.int64)
        values = np.concatenate(lists)
        order = np.argsort(values, kind="stable")
        self.values, self.rows = values[order], np.repeat(np.arange(len(lists)), sizes)[order]
        self.places = ranges(np.zeros(len(sizes), np.int64), sizes)[order]

    def __call__(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entries that hold a wanted value, in the order of `wanted`, and which one each of them holds."""
        a, b = np.searchsorted(self.values, wanted), np.searchsorted(self.values, wanted, side="right")
        return ranges(a, b), np.repeat(np.arange(len(wanted)), b - a)


def _histograms(sums: list[bytes]) -> np.ndarray:
    """The rows' counts by range of hash values, on the coarsest scale of them all; a row whose counts were cut bounds nothing."""
    each = [np.frombuffer(x, np.uint16).astype(np.int64) for x in sums]
    least = min(map(len, each))
    return np.stack([np.full(least, 1 << 40) if x.max() == 65535 else x.reshape(least, -1).sum(axis=1) for x in each])


def links_between(left: dict[str, list], right: dict[str, list] | None, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """How many rows each left and each right class is linked with by links between the two blocks (within the left one
    if there is no right one). Columns: n, w, tokens, sums, grams."""
    same, other = right is None, right or left
    n, m = np.array(left["n"], np.int64), np.array(other["n"], np.int64)
    w, v = np.array(left["w"], np.int64), np.array(other["w"], np.int64)
    prefix = _Index([np.array(x, np.int64) for x in other["tokens"]])
    whole = _Index([np.frombuffer(x, _U) for x in other["grams"]])
    joint = _histograms([*left["sums"], *other["sums"]])
    mine, theirs = joint[: len(n)], joint[len(n) :]
    got, back = np.zeros(len(n), np.int64), np.zeros(len(m), np.int64)
    for i in range(len(n)):
        at, token = prefix(np.array(left["tokens"][i], np.int64))
        # Entries come in the order of this prefix, so a class's first one is the first n-gram that both prefixes share.
        rows, first = np.unique(prefix.rows[at], return_index=True)
        pa_, pb = token[first], prefix.places[at[first]]
        least = -(-(n[i] + m[rows]) * num // (num + den))
        fits = (np.minimum(n[i], m[rows]) * den >= np.maximum(n[i], m[rows]) * num) & (np.minimum(n[i] - pa_, m[rows] - pb) >= least)
        if same:
            fits &= rows > i
        rows, least = rows[fits], least[fits]
        if len(rows):
            keep = np.minimum(mine[i], theirs[rows]).sum(axis=1) >= least
            rows, least = rows[keep], least[keep]
        if len(rows):
            shared = np.bincount(whole.rows[whole(np.frombuffer(left["grams"][i], _U))[0]], minlength=len(m))
            rows = rows[shared[rows] >= least]
            got[i] += v[rows].sum()
            back[rows] += w[i]
    if same:
        return got + back, np.zeros(0, np.int64)
    return got, back


def links_of_dense(members: DataFrame, num: int, den: int) -> DataFrame:
    """node and others (rows it is linked with), by pairs of blocks. members: component, node, n, w, tokens, sums, grams, blocks."""
    own = F.pmod(F.xxhash64("node", "component"), "blocks").cast("int")
    dealt = members.withColumn("own", own).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)))
    dealt = dealt.select("component", F.least("own", "k").alias("i"), F.greatest("own", "k").alias("j"), (F.col("k") < F.col("own")).alias("second"), "node", "n", "w", "tokens", "sums", "grams")

    def solve(key: tuple, rows: pa.Table) -> pa.Table:
        fields = ["node", "n", "w", "tokens", "sums", "grams"]
        sides = [rows.filter(pa.compute.equal(rows["second"], x)).select(fields).to_pydict() for x in (False, True)]
        if not sides[0]["node"]:
            sides = sides[::-1]
        within = key[1].as_py() == key[2].as_py()
        if within or sides[1]["node"]:
            one, two = links_between(sides[0], None if within else sides[1], num, den)
        else:
            one, two = np.zeros(len(sides[0]["node"]), np.int64), np.zeros(0, np.int64)
        nodes = sides[0]["node"] + ([] if within else sides[1]["node"])
        return pa.table({"node": pa.array(nodes, pa.int64()), "others": pa.array(np.concatenate([one, two]), pa.int64())})

    return dealt.groupBy("component", "i", "j").applyInArrow(solve, "node long, others long").groupBy("node").agg(F.sum("others").alias("others"))


def link_counts(entries: DataFrame, components: DataFrame, classes: DataFrame, reps: DataFrame, plain: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """node and others: the rows of other classes that a class is linked with. Settled."""
    ours = settle(entries.select("t", "before", "node", "n", "pos").join(components, "node").withColumn("t", F.xxhash64("t", "component")), "entries-within")
    weights = classes.select("node", "w")
    size = reps.select("node", "n").join(components, "node").join(weights, "node").groupBy("component")
    size = settle(size.agg(F.count("*").alias("m"), F.sum("n").alias("grams"), F.sum("w").alias("rows")), "component-sizes")
    buckets = ours.groupBy("component", "t").agg(F.count("*").alias("c"))
    made = buckets.groupBy("component").agg(F.sum(F.col("c") * (F.col("c") - 1) / 2).alias("pairs"))
    m = F.col("m")
    dense = (m <= BLOCK) | (F.col("pairs") >= m * m * DENSE_SHARE)
    blocks = F.greatest(F.ceil(m / BLOCK), F.ceil(F.col("grams") / BLOCK_GRAMS), F.lit(1))
    kind = F.when(m == 2, "pair").when(dense, "dense").otherwise("sparse")
    kinds = settle(size.join(made, "component", "left").fillna(0, ["pairs"]).select("component", kind.alias("kind"), F.least(blocks, m).alias("blocks"), "rows"), "component-kinds")
    # Two classes are one component by their link alone.
    twos = components.join(kinds.filter("kind = 'pair'").select("component", "rows"), "component").join(weights, "node").select("node", (F.col("rows") - F.col("w")).alias("others"))
    dense_nodes = components.join(kinds.filter("kind = 'dense'").select("component", "blocks"), "component")
    members = settle(reps.select("node", "key", "n", "tokens", "sums").join(dense_nodes, "node").join(weights, "node"), "dense-members")
    whole = whole_sets(members.select("key"), plain, n)
    within = links_of_dense(members.join(whole, "key").drop("key"), num, den).union(twos)
    sparse = ours.join(kinds.filter("kind = 'sparse'").select("component"), "component", "left_semi").select("t", "before", "node", "n", "pos")
    held = [ours, size, kinds, members, whole]
    if not kinds.filter("kind = 'sparse'").isEmpty():
        sparse = settle(sparse.join(sparse.groupBy("t").agg(F.count("*").alias("c")).filter("c > 1"), "t"), "sparse-entries")
        found = verified(all_pairs(sparse, num, den), reps, plain, n, num, den)
        ways = found.union(found.select("b", "a"))
        within = within.union(ways.join(weights.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.sum("w").alias("others")))
        held += [sparse, found]
    out = settle(within, "link-counts")
    forget(*held)
    return out


def near_duplicates(df: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text", count_links: bool = True) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (smallest doc_id reachable by links), set_key (of equal sets) and n_links.

    n_links is the number of other rows that the row is linked with; it's left out, and only as many links are found as
    the components need, if count_links is false."""
    plain, rows, classes, reps = _classes(df, n, num, den, id_col, text_col)
    entries = prefix_entries(reps)
    first = verified(leader_pairs(entries, num, den), reps, plain, n, num, den)
    labels = settle(connected_components(first, "a", "b"), "labels")
    rest = verified(remaining_pairs(entries, labels, num, den), reps, plain, n, num, den)
    found = settle(connected_components(first.union(rest), "a", "b"), "node-components")
    forget(first, rest, labels)
    labelled = classes.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    if count_links:
        counted = link_counts(entries, found, classes, reps, plain, n, num, den)
        labelled = labelled.join(counted, "node", "left").withColumn("n_links", F.col("w") - 1 + F.coalesce("others", F.lit(0)))
    # Both sides of each join below are tables, so that a group of copies, one key, can be split among tasks.
    labelled = settle(labelled.select("key", "component", *(["n_links"] if count_links else [])), "labelled")
    members = settle(rows.select("doc_id", "n", "key").join(labelled, "key", "left"), "members")
    smallest = settle(members.filter("component is not null").groupBy("component").agg(F.min("doc_id").alias("component_id")), "smallest")
    forget(entries, rows, classes, labelled, found)
    out = [F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), F.col("key").alias("set_key")]
    return members.join(smallest, "component", "left").select("doc_id", *out, *([F.coalesce("n_links", F.lit(0)).alias("n_links")] if count_links else []))


def linked_sets(df: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every link between different sets, once: their set_keys key_a and key_b (as near_duplicates has them)."""
    plain, _, classes, reps = _classes(df, n, num, den, id_col, text_col)
    found = verified(all_pairs(prefix_entries(reps), num, den), reps, plain, n, num, den)
    side = lambda x: classes.select(F.col("node").alias(x), F.col("key").alias(f"key_{x}"))
    return found.join(side("a"), "a").join(side("b"), "b").select("key_a", "key_b")


def _classes(df: DataFrame, n: int, num: int, den: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(id and text; rows with their prefixes; classes of equal sets: key, node, rows w; rows of the representatives)."""
    plain = id_text(df, id_col, text_col)
    rows = settle(prefixes(plain, n, num, den).withColumn("node", F.monotonically_increasing_id()), "prefixes")
    classes = settle(rows.filter("n > 0").groupBy("key").agg(F.min("node").alias("node"), F.count("*").alias("w")), "classes")
    return plain, rows, classes, rows.join(classes.select("node"), "node", "left_semi")


def one_of_each(df: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df with one document of each component, the one with the smallest id; of rows with an equal id and text, one.

    Only rows whose id may be affected are shuffled; rows with a null id stay."""
    found = settle(near_duplicates(df, n, num, den, id_col, text_col, count_links=False).select("doc_id", "component_id"), "components-found")
    losers = found.filter("doc_id <> component_id").select("doc_id").distinct()
    repeated = found.groupBy("doc_id").count().filter("count > 1 and doc_id is not null").select("doc_id")
    touched = settle(losers.withColumn("lost", F.lit(True)).unionByName(repeated.withColumn("lost", F.lit(False))).groupBy("doc_id").agg(F.max("lost").alias("lost")), "touched")
    forget(found)
    # The columns of df travel under names of their own, so none can clash with ours.
    columns, k = df.columns, len(df.columns)
    own = [f"c{i}" for i in range(k)]
    keyed = df.toDF(*own).withColumn("doc_id", F.col(own[columns.index(id_col)]).cast("long"))
    table = df.sparkSession.sparkContext.broadcast(bloom(touched, "doc_id", table_bits(df, 128, *BLOOM_BITS)))
    free = sift(keyed, table, False, k).select(*own)
    held = sift(keyed, table, True, k).join(touched, "doc_id", "left")
    single = held.filter("lost is null").select(*own)
    doubled = held.filter("not lost").dropDuplicates(["doc_id", own[columns.index(text_col)]]).select(*own)
    return free.unionByName(single).unionByName(doubled).toDF(*columns)
