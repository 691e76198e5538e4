from __future__ import annotations

import numpy as np

from calltide.llm import ann
from pyspark.sql import functions as F


def brute(ids, x, k):
    out = {}
    for q in np.flatnonzero(ids % 20 == 0):
        score = (x * x[q]).sum(axis=1)
        order = [j for j in np.lexsort((ids, -score)) if ids[j] != ids[q]][:k]
        out[int(ids[q])] = [(int(ids[j]), float(score[j])) for j in order]
    return out


def rows_of(got):
    out = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        assert r.rank == len(out.setdefault(r.query_id, [])) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return out


def test_recall_and_exact_scores(spark, monkeypatch):
    monkeypatch.setattr(ann, "CELL_VECTORS", 500)
    monkeypatch.setattr(ann, "BLOCK", 700)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 40)
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 30)).astype(np.float32).astype(float)
    x[1000:1900] = x[1000]  # a third of the rows are one vector
    ids = np.arange(3000)
    df = spark.createDataFrame([(int(i), v.tolist(), 1.5) for i, v in zip(ids, x)], "vec_id long, embedding array<float>, score double")
    got, want = rows_of(ann.search(df, F.col("vec_id") % 20 == 0).collect()), brute(ids, x, 20)
    assert got.keys() == want.keys()
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits / (20 * len(want)) >= 0.95
    for q, found in got.items():
        assert len(found) == 20 and len({i for i, _ in found}) == 20
        for i, s in found:
            assert abs(s - float((x[i] * x[q]).sum())) < 1e-12
        assert found == sorted(found, key=lambda r: (-r[1], r[0]))
    assert got[1000] == want[1000]


def test_unusable_vectors_ties_and_few_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.0]), (4, None), (5, [0.0, 0.0]), (6, [1.0, None]), (7, [nan, 1.0]), (8, [inf, 1.0]), (9, [1.0]), (None, [1.0, 1.0]), (20, [-1.0, 0.0]), (3, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = rows_of(ann.search(df, F.col("vec_id") % 20 == 0).collect())
    assert got == {0: [(1, 1.0), (3, 1.0), (2, 0.0), (20, -1.0)], 20: [(2, 0.0), (0, -1.0), (1, -1.0), (3, -1.0)]}
    assert ann.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert ann.search(df.where("vec_id = 5"), F.col("vec_id") % 20 == 0).count() == 0


def test_parallel_error_weighs_more():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, 32))
    plain = ann._fit_books(x - x.mean(0), ann._unit(x), 1.0, np.random.default_rng(2), 2)
    aware = ann._fit_books(x - x.mean(0), ann._unit(x), 8.0, np.random.default_rng(2), 2)

    def parallel(books, eta):
        codes = ann._assign(x - x.mean(0), ann._unit(x), books, eta, 2)
        error = x - x.mean(0) - np.concatenate([books[k][codes[:, k]] for k in range(len(books))], axis=1)
        return ((error * ann._unit(x)).sum(axis=1) ** 2).mean()

    assert parallel(aware, 8.0) < 0.7 * parallel(plain, 1.0)


def test_recall_on_the_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    local = rows.where("embedding IS NOT NULL").collect()
    ids, x = np.array([r.vec_id for r in local]), np.array([r.embedding for r in local], float)
    got, want = rows_of(ann.search(rows, F.col("vec_id") % 20 == 0).collect()), brute(ids, x, 20)
    assert got.keys() == want.keys()
    assert sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want) >= 0.9 * 20 * len(want)


def exactly(spark, x):
    ids = np.arange(len(x))
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<double>")
    got, want = rows_of(ann.search(df, F.col("vec_id") % 20 == 0).collect()), brute(ids, x, 20)
    assert {q: [i for i, _ in found] for q, found in got.items()} == {q: [i for i, _ in found] for q, found in want.items()}


def test_no_neighbour_is_missed_whatever_the_vectors_have_in_common(spark):
    rng = np.random.default_rng(3)
    x = 1 + 0.05 * rng.normal(size=(2000, 64))  # nearly the same direction, told apart by a small rest
    exactly(spark, x / np.linalg.norm(x, axis=1, keepdims=True))
    exactly(spark, rng.normal(size=(2000, 30)) * np.exp(1.5 * rng.normal(size=(2000, 1))))  # lengths of many sizes
    exactly(spark, np.round(rng.normal(size=(2000, 2)), 6) * 1e150)


def test_cells_that_are_not_probed_first_are_scanned_where_they_may_hold_a_neighbour(spark, monkeypatch):
    monkeypatch.setattr(ann, "CELL_VECTORS", 100)
    monkeypatch.setattr(ann, "CELL_RECALL", 0.3)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(25, 16))[rng.integers(0, 25, 2500)] + 0.3 * rng.normal(size=(2500, 16))
    x[7::500] *= 20  # near to queries of other cells by their length
    probes = []
    fit = ann.fit
    monkeypatch.setattr(ann, "fit", lambda *a: probes.append(fit(*a)) or probes[-1])
    exactly(spark, x)
    assert probes[0].probes < len(probes[0].cells)
