from __future__ import annotations

import random
import re

import numpy as np

from calltide.llm import jaccard_join
from calltide.llm.components import components


def shingle_set(text) -> frozenset:
    words = re.findall("[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute(docs: list[tuple]) -> list[tuple]:
    sets = [shingle_set(t) for _, t in docs]
    n = len(docs)
    close = [[j for j in range(n) if j != i and sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])] for i in range(n)]
    root = list(range(n))
    for _ in range(n):
        new = [min([root[i], *(root[j] for j in close[i])], key=lambda k: docs[k][0]) for i in range(n)]
        if new == root:
            break
        root = new
    return sorted((docs[i][0], docs[root[i]][0], len(close[i])) for i in range(n))


def corpus(seed: int) -> list[tuple]:
    rng, docs = random.Random(seed), []
    words = [f"w{k}" for k in range(400)] + ["É", "ß"]
    for _ in range(25):
        base = [rng.choice(words) for _ in range(rng.choice([3, 30, 120, 300]))]
        for _ in range(rng.choice([1, 1, 2, 5, 12])):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                own[rng.randrange(len(own))] = rng.choice(words)
            docs.append((len(docs), rng.choice([" ", ", "]).join(own).upper() if rng.random() < 0.3 else " ".join(own)))
    return docs + [(len(docs), None), (len(docs) + 1, ""), (len(docs) + 2, ""), (len(docs) + 3, "...")]


def test_against_brute_force(spark, monkeypatch):
    docs = corpus(5)
    rows = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in docs], "doc_id long, text string, key int, class int, class_id int")
    want = brute(docs)
    assert sorted(map(tuple, jaccard_join.link(rows).collect())) == want
    monkeypatch.setattr(jaccard_join, "LEAF", 3)  # recursion to the last depth, blocks and the joins without broadcast
    monkeypatch.setattr(jaccard_join, "BLOCK", 3)
    monkeypatch.setattr(jaccard_join, "BROADCAST_ROWS", -1)
    assert sorted(map(tuple, jaccard_join.link(rows).collect())) == want
    kept = jaccard_join.deduplicate(rows)
    assert kept.columns == rows.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, c, _ in want if i == c)


def test_repeated_rows_ids_and_empty_tables(spark):
    a, b = " ".join(f"a{k}" for k in range(40)), " ".join(f"b{k}" for k in range(40))
    rows = spark.createDataFrame([(1, a), (1, a), (1, b), (None, b), (3, "x " * 300_000)], "doc_id long, text string")
    got = sorted(map(tuple, jaccard_join.link(rows).na.fill(-9).collect()))
    assert got == [(-9, -1, 1), (1, -1, 1), (1, 1, 1), (1, 1, 1), (3, 3, 0)]
    # one row of each class stays, though ids repeat and one is null
    assert sorted((r.doc_id or 0, r.text[:1]) for r in jaccard_join.deduplicate(rows).collect()) == [(0, "b"), (1, "a"), (3, "x")]
    assert jaccard_join.link(rows.limit(0)).count() == 0 and jaccard_join.deduplicate(rows.limit(0)).count() == 0


def test_rows_without_ids_meet_their_own_class_only(spark, monkeypatch):
    """A class's text is one row's, found by its number: rows that share an id, or have none, are not read for other classes."""
    rng = random.Random(8)
    words = [f"w{k}" for k in range(500)]
    texts = []
    for _ in range(60):
        own = [rng.choice(words) for _ in range(60)]
        texts += [" ".join(own), " ".join([*own[:-1], "other"]), " ".join(own)]
    read = []
    exact = jaccard_join._verify
    monkeypatch.setattr(jaccard_join, "_verify", lambda members, threshold: read.append(members.count()) or exact(members, threshold))
    for ids in ([None] * len(texts), [5] * len(texts)):
        rows = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")
        got = jaccard_join.link(rows).collect()
        assert [r.n_links for r in got] == [2] * len(texts)
        assert read.pop() == 120  # classes of equal sets
        kept = {r.text for r in jaccard_join.deduplicate(rows).collect()}
        assert len(kept) == 60 and all(len(kept & set(texts[k : k + 3])) == 1 for k in range(0, len(texts), 3))
        read.clear()


def test_components(spark):
    rng = random.Random(1)
    chain = [(k, k + 1) for k in range(100, 160)]
    edges = chain + [(rng.randrange(50), rng.randrange(50)) for _ in range(30)] + [(7, 7), (None, 3), (-5, 160)]
    root = {x: x for e in edges for x in e if x is not None}
    for _ in root:
        for x, y in edges:
            if x is not None and y is not None:
                root[x] = root[y] = min(root[x], root[y])
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: r for x, r in root.items() if x in got} and all(x in got for x, y in edges if None not in (x, y) and x != y)


def test_signature_estimates_similarity():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 2**63, 1000).astype(np.uint64)
    y = np.concatenate([x[:900], rng.integers(0, 2**63, 100).astype(np.uint64)])
    same = (jaccard_join.signature(np.sort(x)) == jaccard_join.signature(np.sort(y))).mean()
    assert abs(same - 900 / 1100) < 0.14
    assert jaccard_join.miss_probability(0.8) < 1e-4


def test_chance_of_a_miss_at_every_depth():
    for threshold in (0.7, 0.8, 0.9):
        for depth in range(jaccard_join.FIRST_DEPTH, jaccard_join.DEPTH + 1):
            assert jaccard_join.miss_probability(threshold, depth, threshold=threshold) < 1e-4
    assert jaccard_join.miss_probability(0.8, jaccard_join.DEPTH, 10) > 1e-3


def test_paths_meet_as_often_as_computed():
    """Measured on signatures that agree in 4 of 5 coordinates, with the runs and depth of the code."""
    rng = np.random.default_rng(2)
    runs, depth, pairs = jaccard_join.runs_needed(0.8), jaccard_join.DEPTH, 3000
    x = rng.integers(0, 2**32, (pairs, jaccard_join.COORDINATES)).astype(np.uint32)
    y = np.where(rng.random(x.shape) < 0.8, x, rng.integers(0, 2**32, x.shape)).astype(np.uint32)

    def leaves(signatures):
        row, key = np.tile(np.arange(pairs), runs), jaccard_join.mix(np.repeat(np.arange(1, runs + 1).astype(np.uint64), pairs))
        for _ in range(depth):
            row, key = jaccard_join.paths(signatures, row, key, 0.8)
        return set(zip(row.tolist(), key.tolist(), strict=True))

    met = {row for row, _ in leaves(x) & leaves(y)}
    assert pairs - len(met) <= 3


def test_links_of_near_copies_are_fewer_than_rows():
    """Equal and nearly equal sketches, within a block and between two: links grow with the rows, not with their pairs."""
    rng = np.random.default_rng(4)
    base = rng.integers(0, 256, jaccard_join.COORDINATES).astype(np.uint8)
    for m in (100, 400):
        sketches = np.tile(base, (2 * m, 1))
        sketches[np.arange(2 * m), rng.integers(0, jaccard_join.COORDINATES, 2 * m)] += 1
        sizes = np.full(2 * m, 150, np.int32)
        x, y = jaccard_join._close_stars(sketches, sizes, 0.8)
        assert len(x) == 2 * m - 1 and len(set(zip(x.tolist(), y.tolist(), strict=True))) == len(x)
        x, y = jaccard_join._close_stars(sketches, sizes, 0.8, cross=m)
        assert len(x) == 1 and x[0] < m <= y[0]


def test_links_between_blocks_join_the_same_groups():
    rng = np.random.default_rng(5)
    kinds = rng.integers(0, 256, (12, jaccard_join.COORDINATES)).astype(np.uint8)
    kind = rng.integers(0, 12, 300)
    sizes = np.full(300, 100, np.int32)
    x, y = jaccard_join._close_stars(kinds[kind], sizes, 0.8, cross=140)
    assert (kind[x] == kind[y]).all() and (x < 140).all() and (y >= 140).all()
    assert set(kind[x]) == set(kind[:140]) & set(kind[140:]) and len(x) == len(set(kind[x]))
