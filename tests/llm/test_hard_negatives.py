from __future__ import annotations

import math

import numpy as np
import pytest

from calltide.llm import hard_negatives, queries
from pyspark.sql import functions as F


def brute(rows, step=100, k=5):
    """Straight from the definition; rows of (vec_id, vector, label)."""
    good = {}
    for i, v, label in rows:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            q = [math.floor(256 * float(x)) for x in v]
            good[i] = min(good.get(i, (label, v, q)), (label, v, q))
    score = lambda p, q: sum(a * b for a, b in zip(p, q, strict=False))
    out = []
    for a, (label, _, q) in good.items():
        if a % step:
            continue
        scored = sorted((-score(q, r), i, other) for i, (other, _, r) in good.items() if i != a)
        for minus, p, _ in [s for s in scored if s[2] == label][:k]:
            fits = [s for s in scored if s[2] != label and 80 * -minus <= 100 * -s[0] <= 100 * -minus][:k]
            out += [(a, p, n, i, -minus, -s) for n, (s, i, _) in enumerate(fits, 1)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, label, "clash") for i, v, label in rows], "vec_id long, embedding array<double>, label int, rank string")


def vectors(seed, n, d, spread):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(4, d))
    x = centres[rng.integers(0, 4, n)] * spread + rng.normal(size=(n, d)) * 0.3
    return [(i, [float(np.float32(y)) for y in x[i]], int(rng.integers(0, 4))) for i in range(n)]


@pytest.mark.parametrize("spread", [0.0, 1.0])
def test_against_brute_force(spark, monkeypatch, spread):
    monkeypatch.setattr(hard_negatives, "BLOCK_BYTES", 6 * 7 * 16)  # several blocks
    monkeypatch.setattr(hard_negatives, "ANCHORS_AT_ONCE", 3)
    monkeypatch.setattr(hard_negatives, "PAIRS_AT_ONCE", 50)
    rows = vectors(1, 900, 7, spread)
    rows[200:500] = [(i, rows[200][1], label) for i, _, label in rows[200:500]]  # a third of the rows are one vector
    rows += [(None, rows[0][1], 1), (2000, None, 1), (2100, rows[1][1], None), (2200, [1.0, None], 1), (2300, [float("nan")] * 7, 2), (2400, [1e300] * 7, 1), (2500, [], 3), (2600, [0.5, 0.5], 0), (2700, [0.0] * 7, 1)]
    rows += [rows[100], rows[100], (7, rows[9][1], 3)]
    got = hard_negatives.mine(frame(spark, rows), F.col("vec_id") % 20 == 0)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = brute([r for r in rows if r[0] != 2400], step=20)
    assert len(want) > 300 and sorted(map(tuple, got.collect())) == want


def test_most_pairs_go_early():
    """On vectors with few strong components hardly any pair outlives the first step, and none that belongs goes."""
    rng = np.random.default_rng(4)
    x = np.floor(256 * rng.normal(size=(3000, 48)) * 0.8 ** np.arange(48)).astype(np.int64) @ np.linalg.qr(rng.normal(size=(48, 48)))[0]
    x = np.floor(x).astype(np.int64)
    rotation = hard_negatives.Rotation((x.T @ x).astype(float))
    a, scores = x[:50], x[:50] @ x.T
    lowest = np.sort(scores, axis=1)[:, -6]
    highest = np.sort(scores, axis=1)[:, -2]
    i, j = hard_negatives.survivors(rotation, rotation.apply(a.astype(float)), rotation.apply(x.astype(float)), np.ones((50, 3000), bool), lowest, highest)
    fits = np.argwhere((scores >= lowest[:, None]) & (scores <= highest[:, None]))
    assert {tuple(p) for p in fits} <= set(zip(i.tolist(), j.tolist(), strict=True))
    assert len(i) < 0.01 * scores.size
    assert (hard_negatives.products(a, x, i, j) == scores[i, j]).all()


def test_large_integers_are_exact(spark):
    rows = [(0, [2.0**20, 1.0], 1), (1, [2.0**20, 3.0], 1), (2, [2.0**20, 2.0], 2), (3, [2.0**20, 2.00390625], 2), (4, [2.0**20, 3.00390625], 2)]
    got = sorted(map(tuple, hard_negatives.mine(frame(spark, rows), F.col("vec_id") == 0).collect()))
    assert got == [r for r in brute(rows) if r[0] == 0] and [r[3] for r in got] == [3, 2]


def test_nothing_to_mine(spark):
    for rows in ([], [(100, None, 1)], [(1, [1.0], 1)], [(100, [1.0], 1)], [(100, [1.0], 1), (1, [1.0], 2)], [(100, [1.0], 1), (1, [-1.0], 1), (2, [-1.0], 2)]):
        assert hard_negatives.mine(frame(spark, rows), F.col("vec_id") % 100 == 0).count() == 0


def test_query_on_the_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.vec_id, [float(x) for x in r.embedding], (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert sorted(map(tuple, queries.op13_hard_negatives(spark, sf).collect())) == brute(rows)
