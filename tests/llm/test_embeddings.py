"""Operators on vectors against brute force."""

from __future__ import annotations

import math

import numpy as np
import pytest

from kinetrail.llm import embedding_dedup as ed
from kinetrail.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int, node long, ball long, v string, w long, component long, low long, n long"
EXTRA = (1, 2, "x", 3, 4, 5, 6)


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(*r, *EXTRA) for r in rows], SCHEMA).repartition(parts)


def vectors(seed, n, dim=64, copies=300):
    """Random vectors, small families of near copies, one large family, exact copies, and vectors that take no part."""
    r = np.random.default_rng(seed)
    out = [(r.standard_normal(dim), int(r.integers(0, 4))) for _ in range(n)]
    for k in range(0, n, 7):
        base, label = out[k]
        out += [(base + r.standard_normal(dim) * s, label) for s in (0.05, 0.2, 0.3)]
    centre = r.standard_normal(dim)
    out += [(centre + r.standard_normal(dim) * r.choice([0.05, 0.15, 0.3]), 1) for _ in range(copies)]
    out += [(out[0][0], out[0][1])] * 20 + [(out[0][0] * 3, out[0][1]), (out[0][0], (out[0][1] + 1) % 4)]
    rows = [(i, [float(x) for x in np.float32(v)], label) for i, (v, label) in enumerate(out)]
    odd = [[0.0] * dim, [float("nan")] * dim, [1.0] * (dim - 1) + [None], [1.0] * (dim - 1) + [float("inf")], None, [], [1.0] * 3, [1.0] * 3, [1e-40] * dim, [3e38] * dim]
    rows += [(len(rows) + i, v, 2) for i, v in enumerate(odd)] + [(len(rows) + 50, rows[0][1], None), (None, [5.0] * 3, 3)]
    return [*rows, rows[0], rows[3]]


def cosines(rows, threshold=0.93):
    """All links (i, j), by row."""
    sound = [(k, np.array(v, np.float64), label) for k, (_, v, label) in enumerate(rows) if v and label is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = set()
    for label in {x[2] for x in sound}:
        for dim in {len(x[1]) for x in sound if x[2] == label}:
            some = [(k, v / np.linalg.norm(v)) for k, v, q in sound if q == label and len(v) == dim]
            near = np.array([v for _, v in some]) @ np.array([v for _, v in some]).T >= threshold
            out |= {(some[i][0], some[j][0]) for i, j in zip(*np.nonzero(near)) if i < j}
    return out


def test_near_vectors(spark):
    rows = vectors(3, 400)
    links = cosines(rows)
    many = [0] * len(rows)
    for i, j in links:
        many[i] += 1
        many[j] += 1
    low = list(range(len(rows)))

    def find(i):
        while low[i] != i:
            i = low[i]
        return i

    for i, j in sorted(links):
        a, b = find(i), find(j)
        low[max(a, b)] = min(a, b)
    want = {}
    for k, (vec_id, _, _) in enumerate(rows):
        want.setdefault(vec_id, []).append((many[k], rows[find(k)][0]))
    got = {}
    for x in ed.near_vectors(frame(spark, rows)).collect():
        got.setdefault(x.vec_id, []).append((x.n_links, x.component_id))
        assert x.kept == (x.vec_id == x.component_id)
    assert {k: len(v) for k, v in got.items()} == {k: len(v) for k, v in want.items()}
    assert all(g[0] <= w[0] for k in want for g, w in zip(sorted(got[k]), sorted(want[k])))
    assert sum(g[0] for v in got.values() for g in v) >= ed.RECALL * sum(w[0] for v in want.values() for w in v)
    assert np.mean([sorted(c for _, c in got[k]) == sorted(c for _, c in want[k]) for k in want if k is not None]) > 0.99


@pytest.mark.parametrize("block,short,hold", [(8, 48, 16), (8, 4, 1 << 11), (256, 2, 1)])
def test_blocks_and_runs_change_nothing(spark, monkeypatch, block, short, hold):
    rows = vectors(4, 60, copies=60)
    want = sorted(map(tuple, ed.near_vectors(frame(spark, rows)).na.fill(-1).collect()))
    for name, x in (("BLOCK", block), ("SHORT", short), ("HOLD_ROWS", hold)):
        monkeypatch.setattr(ed, name, x)
    assert sorted(map(tuple, ed.near_vectors(frame(spark, rows, 2)).na.fill(-1).collect())) == want


def test_collision_chances():
    r = np.random.default_rng(1)
    for cosine in (0.93, 0.0):
        d = math.sqrt(2 - 2 * cosine)
        a, b = r.standard_normal(200_000) * d, r.uniform(0, ed.WIDTH, 200_000)
        assert abs(np.mean(np.floor((a + b) / ed.WIDTH) == 0) - ed.chance(d)) < 0.005
    k, tables = ed.tables_for(10_000, 0.93, 0.95)
    assert 1 - (1 - ed.chance(math.sqrt(0.14)) ** k) ** tables >= 0.95 and ed.chance(math.sqrt(2)) ** k <= 1e-4


def test_no_vectors(spark):
    assert ed.near_vectors(frame(spark, [])).collect() == []
    assert [tuple(x) for x in ed.near_vectors(frame(spark, [(4, None, 1), (5, [0.0], 1)])).orderBy("vec_id").collect()] == [(4, 0, 4, True), (5, 0, 5, True)]


def plain_negatives(rows, every=100, k=5):
    """The query's rows by exact integers, pair by pair."""
    sound, seen = [], set()
    for vec_id, v, label in rows:
        if vec_id is None or v is None or label is None or not all(x is not None and math.isfinite(x) for x in v):
            continue
        q = tuple(math.floor(256 * float(np.float32(x))) for x in v)
        if (vec_id, q) not in seen:
            seen.add((vec_id, q))
            sound.append((vec_id, q, (label + 1) % 10 if vec_id % 7 == 0 else label))
    out = []
    for a, q, label in sound:
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(q, p)), b, other) for b, p, other in sound if len(p) == len(q) and b != a)
        for s, b, _ in [x for x in scored if x[2] == label][:k]:
            good = [(-t, c) for t, c, other in scored if other != label and 80 * -s <= 100 * -t <= 100 * -s][:k]
            out += [(a, b, n + 1, c, -s, t) for n, (t, c) in enumerate(good)]
    return sorted(out)


def marked(df):
    from pyspark.sql import functions as F

    return F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))


def mined(spark, rows, every=100, parts=3):
    df = frame(spark, rows, parts)
    return sorted(map(tuple, hn.hard_negatives(df, every=every, label=marked(df)).collect()))


@pytest.mark.parametrize("block,leaf,sample", [(8192, 64, 20_000), (64, 8, 20_000), (40, 4, 300)])
def test_hard_negatives(spark, monkeypatch, block, leaf, sample):
    for name, x in (("BLOCK_ROWS", block), ("LEAF", leaf), ("GROUP", max(1, leaf // 4)), ("SAMPLE", sample)):
        monkeypatch.setattr(hn, name, x)
    rows = [(i, v, label) for i, v, label in vectors(6, 200, dim=6, copies=150) if v is None or all(x is None or not abs(x) > 1e30 or math.isinf(x) for x in v)]
    want = plain_negatives(rows, every=10)
    assert len(want) > 200 and mined(spark, rows, every=10) == want


def test_large_components_are_exact(spark):
    r = np.random.default_rng(2)
    rows = [(i, [float(np.float32(x)) for x in r.standard_normal(4) * 2.0**18], int(i % 3)) for i in range(120)]
    assert mined(spark, rows, every=10) == plain_negatives(rows, every=10)


def test_intervals_hold_all_products():
    r = np.random.default_rng(5)
    a, b = hn.Tree(r.standard_normal((300, 7)), 16), hn.Tree(r.standard_normal((400, 7)) + 1, 16)
    for x, y in zip(r.integers(0, len(a.spans), 200), r.integers(0, len(b.spans), 200)):
        p = a.rows[slice(*a.spans[x])] @ b.rows[slice(*b.spans[y])].T
        lo, hi = hn.interval(a.centre[[x]], a.norm[[x]], a.radius[[x]], b.centre[[y]], b.norm[[y]], b.radius[[y]])
        assert lo[0] <= p.min() and p.max() <= hi[0]


def test_no_anchors(spark):
    assert mined(spark, []) == [] and mined(spark, [(1, [1.0], 1), (2, [1.0], 2)]) == [] and mined(spark, [(100, [1.0], 1)]) == []
