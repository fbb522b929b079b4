"""Hard negatives by dual-tree search: trees over anchors and over candidates, node pairs pruned by inner-product intervals.

Components become floor(256 x), so scores are exact integers. Candidates of one label lie in blocks of some `BLOCK_ROWS`
rows, routed by a k-d tree over a bounded sample (`SAMPLE`; it decides where a row lies, never whether it is looked at) and
dealt out by hash where a cell holds more. Each block has a tree of its own whose nodes have a centre and a radius, and so
have the groups of anchors (leaves of the anchors' trees). For two nodes all inner products lie within
c.d +- (|c| r_d + |d| r_c + r_c r_d).

A home pass searches each anchor's own block and yields the node summaries. Then a group goes only to blocks of its label
whose interval reaches the least fifth-best score of its anchors; in the second search, for negatives, to blocks of other
labels whose interval meets a window [4/5 p, p] of some positive score p. Within a block both trees are descended
together, and leaf pairs that remain are scored exactly, best bounds first. Candidates never move after their block is
made but once a search; a block's task holds its rows and a batch of anchors. Each block returns at most `k` rows for an
anchor (and positive), which a window reduces.

Defined results: rows with a null id, label or vector, or with a null or non-finite component take no part. Vectors of
different lengths have no score. Rows that agree in id and vector count once; another row of an anchor's id is never its
positive. Negative positive scores have an empty window. Scores beyond 64 bits are exact in comparisons and saturate as
values. Ties go to smaller ids. An empty table gives no rows; other columns are ignored; a long vector is one value.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Batches, bound_batches, forget, partitions_for, settle, tidy
from .embedding_dedup import matrix

BLOCK_ROWS = 8192
#: Rows that the router is fitted on, and the least of them in one of its cells.
SAMPLE, SAMPLE_CELL = 20_000, 32
#: Rows of a leaf: candidates, anchors.
LEAF, GROUP = 64, 32
#: Anchor groups are dealt to so many lanes, each of which meets all summaries of blocks.
LANES = 16
EXACT = 1 << 53


def quantised(vectors: np.ndarray) -> np.ndarray:
    """floor(256 x) as integers held in doubles."""
    return np.floor(vectors * 256.0)


class Tree:
    """Rows in leaf order, and nodes with centres and radii: recursive halving along the widest axis."""

    def __init__(self, rows: np.ndarray, leaf: int) -> None:
        self.order = np.arange(len(rows))
        spans, kids = [(0, len(rows))], [(-1, -1)]
        at = 0
        while at < len(spans):
            a, b = spans[at]
            if b - a > leaf:
                some = rows[self.order[a:b]]
                axis = int(np.argmax(some.max(axis=0) - some.min(axis=0))) if some.shape[1] else 0
                half = (b - a) // 2
                self.order[a:b] = self.order[a:b][np.argpartition(some[:, axis], half, kind="introselect")] if some.shape[1] else self.order[a:b]
                kids[at] = (len(spans), len(spans) + 1)
                spans += [(a, a + half), (a + half, b)]
                kids += [(-1, -1)] * 2
            at += 1
        self.spans, self.kids = np.array(spans), np.array(kids)
        self.rows = rows[self.order]
        self.centre = np.array([self.rows[a:b].mean(axis=0) for a, b in spans]).reshape(len(spans), rows.shape[1])
        self.radius = np.array([np.sqrt(((self.rows[a:b] - c) ** 2).sum(axis=1)).max() for (a, b), c in zip(spans, self.centre)])
        self.norm = np.sqrt((self.centre**2).sum(axis=1))

    def leaves(self) -> np.ndarray:
        return np.flatnonzero(self.kids[:, 0] < 0)


def interval(c: np.ndarray, c_norm: np.ndarray, c_radius: np.ndarray, d: np.ndarray, d_norm: np.ndarray, d_radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of all inner products between node pairs, widened by what rounding may take."""
    middle = (c * d).sum(axis=1)
    reach = c_norm * d_radius + d_norm * c_radius + c_radius * d_radius
    reach = reach + 1e-9 * (np.abs(middle) + reach + c_norm * d_norm) + 1e-6
    return middle - reach, middle + reach


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products, as doubles while they are whole there, else as Python's integers."""
    if not a.size or not b.size or a.shape[1] * np.abs(a).max() * np.abs(b).max() < EXACT:
        return a @ b.T
    return np.array([[int(x) for x in r] for r in a], object) @ np.array([[int(x) for x in r] for r in b], object).T


class Best:
    """For each anchor and window the k best (score, smallest id) so far."""

    def __init__(self, anchors: int, windows: int, k: int) -> None:
        self.score = np.full((anchors, windows, k), -np.inf)
        self.at = np.full((anchors, windows, k), -1, np.int64)

    def exact(self) -> None:
        if self.score.dtype != object:
            self.score = self.score.astype(object)

    def offer(self, anchors: np.ndarray, score: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        """Scores of anchors x candidates; `at` are positions in id order, so smaller ones win ties."""
        if score.dtype == object:
            self.exact()
        k = self.score.shape[2]
        for w in range(self.score.shape[1]):
            lo, hi = low[:, w, None], high[:, w, None]
            worst = self.score[anchors, w, -1]
            rows, cols = np.nonzero((score >= np.maximum(lo, worst[:, None])) & (score <= hi))
            for r in np.unique(rows):
                c = cols[rows == r]
                s = np.concatenate([self.score[anchors[r], w], score[r, c]])
                p = np.concatenate([self.at[anchors[r], w], at[c]])
                best = np.lexsort((p, -s))[:k] if s.dtype != object else np.array(sorted(range(len(s)), key=lambda i: (-s[i], p[i]))[:k])
                self.score[anchors[r], w], self.at[anchors[r], w] = s[best], p[best]


def search(tree: Tree, place: np.ndarray, anchors: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, own: np.ndarray | None = None) -> Best:
    """The k best candidates of every anchor within each of its windows [low, high] (anchors x windows).

    place: each leaf-ordered candidate's position in id order. own: a position that an anchor must not take, per anchor."""
    best = Best(len(anchors), low.shape[1], k)
    if not len(anchors) or not len(tree.rows):
        return best
    mine = Tree(anchors, GROUP)
    low, high = low[mine.order], high[mine.order]
    least = np.array([low[a:b].min() for a, b in mine.spans])
    most = np.array([high[a:b].max() for a, b in mine.spans])
    x = y = np.zeros(1, np.int64)
    done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while len(x):
        lo, hi = interval(mine.centre[x], mine.norm[x], mine.radius[x], tree.centre[y], tree.norm[y], tree.radius[y])
        keep = (hi >= least[x]) & (lo <= most[x])
        x, y, hi = x[keep], y[keep], hi[keep]
        x_leaf, y_leaf = mine.kids[x, 0] < 0, tree.kids[y, 0] < 0
        both = x_leaf & y_leaf
        done.append((x[both], y[both], hi[both]))
        x, y, x_leaf, y_leaf = x[~both], y[~both], x_leaf[~both], y_leaf[~both]
        wide = x_leaf | (~y_leaf & (tree.radius[y] >= mine.radius[x]))  # descend into the wider node
        x, y = np.concatenate([x[wide], x[wide], mine.kids[x[~wide], 0], mine.kids[x[~wide], 1]]), np.concatenate([tree.kids[y[wide], 0], tree.kids[y[wide], 1], y[~wide], y[~wide]])
    x, y, hi = (np.concatenate(c) for c in zip(*done))
    for leaf in np.unique(x):
        a, b = mine.spans[leaf]
        group = mine.order[a:b]
        turn = np.flatnonzero(x == leaf)
        turn = turn[np.argsort(-hi[turn], kind="stable")]
        at, step = 0, 4
        while at < len(turn):
            # Once k are known for every window, leaves that can't beat the worst of them are done, and so are all later ones.
            floor = np.maximum(low[a:b].astype(np.float64), best.score[group, :, -1].astype(np.float64)).min()
            some = turn[at : at + step]
            some = some[hi[some] >= floor]
            if not len(some):
                break
            cand = np.concatenate([np.arange(*tree.spans[n]) for n in y[some]])
            score = products(mine.rows[a:b], tree.rows[cand])
            if own is not None:
                score = score.copy()
                score[own[group][:, None] == place[cand][None, :]] = -np.inf
            best.offer(group, score, place[cand], low[a:b], high[a:b])
            at, step = at + step, min(64, step * 4)
    return best


def long_of(score) -> int:
    return max(-(1 << 63), min((1 << 63) - 1, int(score)))


class Fitted:
    """The router: cell paths of vectors, by axis and cut of a k-d tree over a sample."""

    def __init__(self, sample: np.ndarray, depth: int) -> None:
        self.depth, self.axis, self.cut = 0, [], []
        parts = [sample]
        while self.depth < depth and min(map(len, parts)) >= 2 * SAMPLE_CELL:
            axes = [int(np.argmax(p.max(axis=0) - p.min(axis=0))) for p in parts]
            cuts = [float(np.median(p[:, a])) for p, a in zip(parts, axes)]
            self.axis.append(np.array(axes))
            self.cut.append(np.array(cuts))
            parts = [q for p, a, c in zip(parts, axes, cuts) for q in (p[p[:, a] < c], p[p[:, a] >= c])]
            self.depth += 1

    def __call__(self, vectors: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """Each vector's cell at its own depth, as a number with a leading one."""
        cell = np.ones(len(vectors), np.int64)
        for k in range(self.depth):
            at = cell - (1 << k)
            axis = np.minimum(self.axis[k][np.clip(at, 0, (1 << k) - 1)], vectors.shape[1] - 1)
            right = vectors[np.arange(len(vectors)), axis] >= self.cut[k][np.clip(at, 0, (1 << k) - 1)] if vectors.shape[1] else np.zeros(len(vectors), bool)
            cell = np.where(depth > k, 2 * cell + right, cell)
        return cell


def by_length(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        if batch.num_rows:
            lengths = np.asarray(pa.compute.list_value_length(batch.column(at)))
            for dim in np.unique(lengths):
                part = batch.filter(pa.array(lengths == dim))
                yield part, matrix(part.column(at)) if dim else np.zeros((part.num_rows, 0))


def routed(router: Fitted) -> Callable[[Batches], Batches]:
    """(vec_id, lab, v, depth) with each row's cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, vectors in by_length(batches, 2):
            yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(router(vectors, np.asarray(part.column(3))))], ["vec_id", "lab", "v", "cell"])

    return run


Runs = Iterator[tuple[pa.RecordBatch, bool]]


def runs_of(batches: Iterator[pa.RecordBatch], keys: int) -> Runs:
    """Stretches of sorted batches that agree in the first `keys` columns, and whether each begins a run."""
    before = None
    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows, bool)
        for k in range(keys):
            x = np.asarray(batch.column(k))
            change[1:] |= x[1:] != x[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            part = batch.slice(a, b - a)
            key = tuple(part.column(k)[0].as_py() for k in range(keys))
            yield part, key != before
            before = key


class Block:
    """A block's candidates: distinct rows in id order, and their tree."""

    def __init__(self, ids: list[np.ndarray], vectors: list[np.ndarray]) -> None:
        ids, rows = np.concatenate(ids), quantised(np.concatenate(vectors))
        order = np.argsort(ids, kind="stable")
        ids, rows = ids[order], rows[order]
        for i in np.flatnonzero(np.concatenate([[False], ids[1:] == ids[:-1]])):
            j = i - 1
            while j >= 0 and ids[j] == ids[i]:
                if (rows[j] == rows[i]).all():
                    ids[i] = np.iinfo(np.int64).min  # repeated
                    break
                j -= 1
        kept = ids != np.iinfo(np.int64).min
        self.ids, self.rows = ids[kept], rows[kept]
        self.tree = Tree(self.rows, LEAF)
        self.place = self.tree.order


_NODE = "kind int, block long, lab long, dim int, grp long, n long, centre array<double>, radius double, least double, most double, vec_id long, v array<double>, ids array<long>, scores array<long>"
_NODE_TYPES = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "array<double>": pa.list_(pa.float64()), "array<long>": pa.list_(pa.int64())}
_NODES = [(x.split()[0], _NODE_TYPES[x.split()[1]]) for x in _NODE.split(", ")]


def table(rows: list[dict], fields: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], t) for n, t in fields], [n for n, _ in fields])


def home(k: int, every: int) -> Callable[[Batches], Batches]:
    """Rows (block, lab, dim, vec_id, v) of whole blocks to node summaries (kind 0: the block, 1: a group of anchors) and
    anchors with their k best of the block (kind 2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, vectors = None, [], []
        for part, new in runs_of(batches, 1):
            if new and key is not None:
                yield from close(key, Block(ids, vectors))
            if new:
                key, ids, vectors = tuple(part.column(c)[0].as_py() for c in range(3)), [], []
            ids.append(np.asarray(part.column(3)))
            vectors.append(matrix(part.column(4)) if key[2] else np.zeros((part.num_rows, 0)))
        if key is not None:
            yield from close(key, Block(ids, vectors))

    def close(key: tuple, b: Block) -> Iterator[pa.RecordBatch]:
        at = dict(zip(("block", "lab", "dim"), key))
        rows = [at | {"kind": 0, "n": len(b.ids), "centre": b.tree.centre[0], "radius": b.tree.radius[0]}]
        mine = np.flatnonzero(b.ids % every == 0)
        if len(mine):
            some = b.rows[mine]
            no = np.full((len(mine), 1), -np.inf)
            best = search(b.tree, b.place, some, no, -no, k, own=mine)
            groups = Tree(some, GROUP)
            for leaf in groups.leaves():
                span = groups.order[slice(*groups.spans[leaf])]
                grp = int(b.ids[mine[span]].min())
                rows.append(at | {"kind": 1, "grp": grp, "centre": groups.centre[leaf], "radius": groups.radius[leaf], "least": float(best.score[span, 0, -1].astype(np.float64).min())})
                for i in span:
                    known = best.at[i, 0] >= 0
                    rows.append(at | {"kind": 2, "grp": grp, "vec_id": int(b.ids[mine[i]]), "v": some[i], "least": float(best.score[i, 0, -1]), "ids": b.ids[best.at[i, 0][known]].tolist(), "scores": [long_of(s) for s in best.score[i, 0][known]]})
        for a in range(0, len(rows), 256):
            yield table(rows[a : a + 256], _NODES)

    return run


def reaching(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Node pairs (grp, block, least, most, gc, gr, bc, br) whose interval meets [least, most]."""
    for part, c in by_length(batches, 4):
        d = matrix(part.column(6)) if c.shape[1] else c
        lo, hi = interval(c, np.sqrt((c * c).sum(axis=1)), np.asarray(part.column(5)), d, np.sqrt((d * d).sum(axis=1)), np.asarray(part.column(7)))
        keep = pa.array((hi >= np.asarray(part.column(2))) & (lo <= np.asarray(part.column(3))))
        yield pa.RecordBatch.from_arrays([part.column(0).filter(keep), part.column(1).filter(keep)], ["grp", "block"])


_FOUND = [("anchor_id", pa.int64()), ("pos_rank", pa.int32()), ("id", pa.int64()), ("score", pa.int64())]


def searched(k: int) -> Callable[[Batches], Batches]:
    """Sorted rows (block, kind, dim, id, v, lows, highs), candidates (kind 0) before anchors, to the k best of each window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors, block, whole = [], [], None, None
        for part, _ in runs_of(batches, 2):
            now, kind, dim = (part.column(c)[0].as_py() for c in range(3))
            if now != block:
                ids, vectors, block, whole = [], [], now, None
            if kind == 0:
                ids.append(np.asarray(part.column(3)))
                vectors.append(matrix(part.column(4)) if dim else np.zeros((part.num_rows, 0)))
                continue
            if not ids:
                continue
            whole = whole or Block(ids, vectors)
            anchors = matrix(part.column(4)) if dim else np.zeros((part.num_rows, 0))
            lows, highs = part.column(5).to_pylist(), part.column(6).to_pylist()
            width = max(map(len, lows))
            low = np.full((part.num_rows, width), np.inf)
            high = np.full((part.num_rows, width), -np.inf)
            for i, (x, y) in enumerate(zip(lows, highs)):
                low[i, : len(x)], high[i, : len(y)] = x, y
            best = search(whole.tree, whole.place, anchors, low, high, k)
            a, w, n = np.nonzero(best.at >= 0)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(np.asarray(part.column(3))[a]), pa.array(w.astype(np.int32)), pa.array(whole.ids[best.at[a, w, n]]), pa.array([long_of(s) for s in best.score[a, w, n]], pa.int64())], [x for x, _ in _FOUND])

    return run


def looked_up(blocks: DataFrame, anchors: DataFrame, pairs: DataFrame, k: int, parts: int) -> DataFrame:
    """Search the blocks that anchor groups reach: (anchor_id, pos_rank: number of the window, id, score)."""
    units = pairs.join(anchors, "grp").select("block", F.lit(1).alias("kind"), F.size("v").alias("dim"), F.col("vec_id").alias("id"), "v", "lows", "highs")
    none = F.lit(None).cast("array<double>")
    held = blocks.join(pairs.select("block").distinct(), "block").select("block", F.lit(0).alias("kind"), "dim", F.col("vec_id").alias("id"), F.transform("v", lambda x: x.cast("double")).alias("v"), none.alias("lows"), none.alias("highs"))
    both = held.unionByName(units).repartition(parts, "block").sortWithinPartitions("block", "kind", "id")
    return both.mapInArrow(tidy(searched(k)), "anchor_id long, pos_rank int, id long, score long")


def node_pairs(groups: DataFrame, blocks: DataFrame, on: Column) -> DataFrame:
    """(grp, block) of groups (g_*) and blocks (b_*) of one vector length that meet `on` and whose interval meets the group's window."""
    laned = groups.withColumn("lane", F.pmod(F.xxhash64("grp"), F.lit(LANES)))
    copies = blocks.withColumn("lane", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(LANES - 1).cast("long"))))
    joined = laned.join(copies, (laned.lane == copies.lane) & (F.col("g_dim") == F.col("b_dim")) & on)
    return joined.select("grp", "block", "least", "most", "g_centre", "g_radius", "b_centre", "b_radius").mapInArrow(tidy(reaching), "grp long, block long")


def first_k(df: DataFrame, by: list[str], k: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "id")).cast("int")).filter(F.col("rank") <= k)


def hard_negatives(df: DataFrame, every: int = 100, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", label: Column | None = None) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): anchors are rows whose id is divisible by
    `every`; `label` may give another label than the column's."""
    bound_batches(df.sparkSession)
    sound = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    lab = F.col(label_col) if label is None else label
    rows = df.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(vector_col).isNotNull() & sound)
    rows = rows.select(F.col(id_col).cast("long").alias("vec_id"), lab.cast("long").alias("lab"), F.col(vector_col).alias("v"))
    kind = dict(rows.dtypes)["v"]

    # Blocks: as many cells of the router as a label needs, dealt out where a cell holds more than a block.
    sizes = rows.groupBy("lab", F.size("v").alias("dim")).agg(F.count("*").alias("n"))
    depth = F.ceil(F.log2(F.greatest(F.lit(1.0), F.col("n") / BLOCK_ROWS))).cast("int")
    most = sizes.agg(F.max("n")).first()[0] or 0
    deepest = max(0, int(np.ceil(np.log2(max(1, most / BLOCK_ROWS)))))
    sample = [r[0] for r in rows.filter(F.size("v") > 0).orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").collect()] if deepest else []
    width = max(map(len, sample), default=0)
    router = Fitted(np.array([[*x, *[0.0] * (width - len(x))] for x in sample]).reshape(len(sample), width), deepest if sample else 0)
    sized = rows.withColumn("dim", F.size("v")).join(sizes.select("lab", "dim", depth.alias("depth")), ["lab", "dim"]).select("vec_id", "lab", "v", "depth")
    celled = sized.mapInArrow(tidy(routed(router)), f"vec_id long, lab long, v {kind}, cell long").withColumn("dim", F.size("v"))
    cells = celled.groupBy("lab", "dim", "cell").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("m"))
    placed = celled.join(cells, ["lab", "dim", "cell"]).withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.col("m")))
    parts = partitions_for(df)
    blocks = placed.select(F.xxhash64("lab", "dim", "cell", "salt").alias("block"), "lab", "dim", "vec_id", "v")
    blocks = settle(blocks.repartition(parts, "block").sortWithinPartitions("block"), "vector-blocks")

    nodes = settle(blocks.repartition(parts, "block").sortWithinPartitions("block").mapInArrow(tidy(home(k, every)), _NODE), "vector-nodes")
    summaries = nodes.filter("kind = 0").select("block", F.col("lab").alias("b_lab"), F.col("dim").alias("b_dim"), F.col("centre").alias("b_centre"), F.col("radius").alias("b_radius"))
    group = ["grp", F.col("block").alias("g_block"), F.col("lab").alias("g_lab"), F.col("dim").alias("g_dim"), F.col("centre").alias("g_centre"), F.col("radius").alias("g_radius")]
    groups = nodes.filter("kind = 1").select(*group, "least", F.lit(float("inf")).alias("most"))
    groups = groups.withColumn("grp", F.xxhash64("grp", "g_block"))
    anchors = nodes.filter("kind = 2").select(F.xxhash64("grp", "block").alias("grp"), "vec_id", "v", "least", "ids", "scores")

    # Positives: the home block's and those of other blocks of the label that may hold better ones.
    seeds = anchors.select(F.col("vec_id").alias("anchor_id"), F.explode(F.arrays_zip("ids", "scores")).alias("x")).select("anchor_id", F.lit(0).alias("pos_rank"), F.col("x.ids").alias("id"), F.col("x.scores").alias("score"))
    pairs = settle(node_pairs(groups, summaries, (F.col("g_lab") == F.col("b_lab")) & (F.col("g_block") != F.col("block"))), "vector-pairs")
    open_anchors = anchors.select("grp", "vec_id", "v", F.array("least").alias("lows"), F.array(F.lit(float("inf"))).alias("highs"))
    offers = seeds.unionByName(looked_up(blocks, open_anchors, pairs, k, parts)).filter("id <> anchor_id")
    positives = settle(first_k(offers, ["anchor_id"], k).select("anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), (F.col("rank") - 1).alias("pos_rank")), "positives")

    # Negatives: windows [4/5 p, p] of the positives' scores.
    lists = positives.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("pos_rank", "positive_score"))).alias("p"))
    high = F.transform("p", lambda x: x.positive_score.cast("double"))
    low = F.transform("p", lambda x: F.ceil(x.positive_score * 4 / 5.0).cast("double"))
    windows = settle(anchors.join(lists, anchors.vec_id == lists.anchor_id).select("grp", "vec_id", "v", low.alias("lows"), high.alias("highs")), "negative-windows")
    spans = windows.groupBy("grp").agg(F.min(F.array_min("lows")).alias("least"), F.max(F.array_max("highs")).alias("most"))
    wide = groups.drop("least", "most").join(spans, "grp")
    others = settle(node_pairs(wide, summaries, F.col("g_lab") != F.col("b_lab")), "vector-pairs")
    found = first_k(looked_up(blocks, windows, others, k, parts), ["anchor_id", "pos_rank"], k)
    out = positives.join(found, ["anchor_id", "pos_rank"]).select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
    out = settle(out, "hard-negatives")
    forget(blocks, nodes, pairs, positives, windows, others)
    return out
