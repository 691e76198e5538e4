from __future__ import annotations

import random
from datetime import datetime, timedelta
from pathlib import Path

import pytest

from calltide.functions.values import age_days
from calltide.operators import postings, relevance
from pyspark.sql import functions as F

NOW = datetime(2026, 5, 8)


def entries(spark, seed, n, begin=0):
    rng = random.Random(seed)
    words = [f"word{k}" for k in range(400)]
    rows = []
    for i in range(begin, begin + n):
        own = [words[min(399, int(rng.expovariate(1 / 60)))] for _ in range(rng.randint(0, 25))] + ["everywhere"] * (rng.random() < 0.7)
        rows.append((i, " ".join(own), NOW - timedelta(days=rng.choice((0, 0.5, 3, 9, 12, 20, 29, 31, -1)))))
    rows += [(begin + n, None, NOW), (begin + n + 1, "word1 word2 word3 word4", None)]
    return spark.createDataFrame(rows, "entry long, text string, time timestamp_ntz")


def queries(spark):
    rng = random.Random(9)
    rows = [(k, " ".join(f"word{int(rng.expovariate(1 / 60))}" for _ in range(30)) + " everywhere") for k in range(25)]
    return spark.createDataFrame([*rows, (90, "everywhere"), (91, None), (92, "the")], "q long, asks string")


@pytest.mark.parametrize("min_score", [1.0, 2.0, 3.5])
def test_search_equals_ranking_of_all_entries(spark, tmp_path, monkeypatch, min_score):
    monkeypatch.setattr(postings, "BLOCK", 4)
    parts = [entries(spark, 1, 150), entries(spark, 2, 100, 1000), entries(spark, 3, 1, 2000)]
    for part in parts:
        postings.append(part, str(tmp_path), "entry", "text", "time", block=4)
    whole = parts[0].union(parts[1]).union(parts[2])
    got = postings.search(spark, str(tmp_path), queries(spark), "q", "asks", NOW, min_score=min_score)
    want = relevance.rank(queries(spark), whole, "q", "asks", "entry", "text", age_days(F.lit(NOW), "time"), min_score=min_score)
    assert got.columns == want.columns
    want = sorted((r.q, r.rank, r.entry, r.score) for r in want.collect())
    assert len(want) > 10 and sorted((r.q, r.rank, r.entry, r.score) for r in got.collect()) == want


def test_appending_leaves_blocks_and_unfinished_segments_alone(spark, tmp_path):
    path = str(tmp_path)
    postings.append(entries(spark, 1, 30), path, "entry", "text", "time")
    files = lambda: {p: (p.stat().st_mtime_ns, p.stat().st_size) for p in Path(path).rglob("*.parquet")}
    before = files()
    name = postings.append(entries(spark, 2, 30, 500), path, "entry", "text", "time")
    assert before.items() <= files().items() and len(postings.segments(spark, path)) == 2
    (tmp_path / name / "counts" / "_SUCCESS").unlink()  # as if the writer had been stopped
    assert len(postings.segments(spark, path)) == 1
    got = postings.search(spark, path, queries(spark), "q", "asks", NOW, min_score=1.0)
    assert {r.entry for r in got.collect()} <= set(range(32))
    with pytest.raises(FileNotFoundError):
        postings.search(spark, str(tmp_path / "none"), queries(spark), "q", "asks", NOW)


def test_postings_read_do_not_grow_with_frequent_tokens(spark, tmp_path):
    """A query of six tokens that must share four reads the postings of its three rarest, and only blocks that are new enough."""
    rare = [(i, f"alpha{i % 3} beta gamma delta", NOW) for i in range(6)]
    ask = spark.createDataFrame([(1, "alpha0 beta gamma delta common1 common2")], "q long, asks string")
    seen = []
    for n in (200, 800):
        path = str(tmp_path / str(n))
        filler = [(1000 + i, f"common1 common2 filler{i}" if i % 12 == 0 else f"filler{i} other{i}", NOW) for i in range(n)]
        postings.append(spark.createDataFrame(rare + filler, "entry long, text string, time timestamp_ntz"), path, "entry", "text", "time")
        found = postings.segments(spark, path)
        asked = postings._asked(spark, found, ask, "q", "asks", 0.1, ())
        wanted = postings.essential(asked, 4)
        assert asked.count() == 6 and wanted.count() == 3
        blocks = spark.read.parquet(*(f"{at}/blocks" for at in found))
        seen.append(blocks.join(wanted, "token").agg(F.sum(F.size("entries"))).first()[0])
        assert postings.read_blocks(blocks, wanted, F.lit(NOW + timedelta(days=15)), None, 4.0, 30.0).count() == 0
        got = postings.search(spark, path, ask, "q", "asks", NOW)
        assert [(r.entry, r.score) for r in got.orderBy("rank").collect()] == [(0, 4.0), (3, 4.0)]
    assert seen[0] == seen[1] <= 14
