import numpy as np
import pytest

pytest.importorskip("reelspan.llm")

from reelspan.llm.neighbours import balanced_partition, fit_router, nearest


def brute(rows, k=5, least=0.85):
    good = {}
    for r, v in rows:
        if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good[r] = np.float32(v).astype(float)
    ids = np.array(sorted(good))
    unit = np.array([good[i] / np.linalg.norm(good[i]) for i in ids])
    sims = np.round(unit @ unit.T, 6)
    np.fill_diagonal(sims, -1)
    out = {}
    for a in range(len(ids)):
        c = np.nonzero(sims[a] >= least)[0]
        out[int(ids[a])] = [int(ids[b]) for b in c[np.lexsort((ids[c], -sims[a, c]))][:k]]
    return out


def cloud(n, seed, spread=0.5):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((max(1, n // 8), 64))
    return (centres[rng.integers(len(centres), size=n)] + spread * rng.standard_normal((n, 64)) * rng.random((n, 1))).astype(np.float32)


def test_one_partition_is_exact_with_copies_and_dirt(spark):
    points = cloud(150, 1)
    rows = [(k, [float(x) for x in p]) for k, p in enumerate(points)]
    rows += [(1000 + k, [float(x) for x in points[3] * (1 + k % 3)]) for k in range(40)]
    rows += [(2000, None), (2001, []), (2002, [0.0] * 64), (2003, [float("nan")] * 64), (2004, [1.0] * 63), (2005, [None] + [1.0] * 63), (2006, [float("inf")] * 64)]
    rows += rows[:5]
    df = spark.createDataFrame(rows, "index_row long, embedding array<float>").repartition(3)
    found = {}
    for r in nearest(df).collect():
        found.setdefault(r.index_row, {})[r["rank"]] = r.neighbour
    want = {k: v for k, v in brute(rows).items() if v}
    assert {k: [v[n] for n in sorted(v)] for k, v in found.items()} == want
    assert nearest(df.limit(0)).count() == 0


def test_many_partitions_find_nine_in_ten(spark):
    points = cloud(3000, 2)
    rows = [(k, [float(x) for x in p]) for k, p in enumerate(points)]
    df = spark.createDataFrame(rows, "index_row long, embedding array<float>")
    found = {(r.index_row, r.neighbour) for r in nearest(df, partition_rows=150, sample_rows=1500).collect()}
    want = {(a, b) for a, bs in brute(rows).items() for b in bs}
    assert len(found & want) >= 0.95 * len(want)
    # blocks change nothing
    dealt = {(r.index_row, r.neighbour) for r in nearest(df, partition_rows=150, sample_rows=1500, block_rows=60).collect()}
    assert dealt == found


def test_the_exact_way_meets_all(spark):
    points = cloud(900, 4)
    rows = [(k, [float(x) for x in p]) for k, p in enumerate(points)] + [(2000 + k, [float(x) for x in points[5]]) for k in range(30)]
    df = spark.createDataFrame(rows, "index_row long, embedding array<float>")
    found = {(r.index_row, r.neighbour) for r in nearest(df, partition_rows=100, probes=10**6, reach=float("inf"), block_rows=50).collect()}
    assert found == {(a, b) for a, bs in brute(rows).items() for b in bs}


def test_partitions_are_balanced_and_learnt():
    unit = cloud(800, 3).astype(float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    label = balanced_partition(unit, 8)
    sizes = np.bincount(label, minlength=8)
    assert sizes.max() <= 800 / 8 * 1.15 + 1
    top, wanted = fit_router(unit, 8).route(unit, 3, 0.06)
    assert top.shape == (800, 3) and wanted[:, 0].all()
