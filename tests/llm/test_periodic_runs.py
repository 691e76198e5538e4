from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np

from calltide.llm import periodic_runs
from pyspark.sql import functions as F


def brute(words, least=12):
    """All (start, length, period), straight from the definition."""
    found, n = {}, len(words)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, 2 * q):
                found.setdefault((i, j + q - i), q)  # smaller periods come first
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def sequences(seed, n):
    rng = random.Random(seed)
    for k in range(n):
        letters = "abcdefgh"[: rng.randint(1, 8)]
        parts = []
        for _ in range(rng.randint(0, 8)):
            part = [rng.choice(letters) for _ in range(rng.randint(1, 14))]
            parts += part * rng.choice((1, 1, 2, 3, 5)) + part[: rng.randint(0, len(part))]
        yield parts


def test_runs_against_brute_force():
    for words in sequences(1, 1500):
        ids = periodic_runs.word_ids([w.encode() for w in words])
        for least in (12, 4, 7, 20):
            assert (periodic_runs.find_runs(ids, least) if len(ids) else []) == brute(words, least), (least, "".join(words))


def test_fibonacci_words_and_long_stretches():
    a, b = "a", "ab"
    for _ in range(12):
        a, b = b, b + a
    assert periodic_runs.find_runs(periodic_runs.word_ids([c.encode() for c in b])) == brute(b)
    ids = np.tile(np.arange(7), 30_000)
    assert periodic_runs.find_runs(ids) == [(0, 210_000, 7)]
    assert periodic_runs.find_runs(np.zeros(100_000, np.int64)) == [(0, 100_000, 1)]
    assert periodic_runs.find_runs(np.arange(50_000)) == []


def test_small_visits_give_the_same(monkeypatch):
    monkeypatch.setattr(periodic_runs, "VISIT", 3)
    for words in sequences(2, 100):
        ids = periodic_runs.word_ids([w.encode() for w in words])
        assert (periodic_runs.find_runs(ids) if len(ids) else []) == brute(words)


def expected(doc_id, text):
    """The contract's row, by brute force."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(b"" if doc_id is None else str(doc_id).encode()), len(words)
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = brute(words)
    dropped = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (
        doc_id, len(runs), *(best or (None, None, None)), best and 1000 * best[1] // best[2],
        sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in dropped)),
    )


def corpus(seed):
    rng = random.Random(seed)
    texts = [" ".join(words) for words in sequences(seed, 150)]
    texts += ["\t\n ".join(rng.choice(("é", "naïve x", "w\x1fy", "z")) for _ in range(40)), "  ", "", None, "one", " \x0b".join(["u v w"] * 30), " ".join(f"w{i}" for i in range(4000))]
    return [(i, t) for i, t in enumerate(texts)] + [(None, "x y " * 9), (3, "x y " * 9), (3, "x y " * 9)]


def test_query_against_brute_force(spark):
    rows = corpus(5)
    df = spark.createDataFrame([(i, t, 7, "clash") for i, t in rows], "doc_id long, text string, runs int, collapsed string")
    got = periodic_runs.digest(periodic_runs.find(periodic_runs.plant(df))).collect()
    assert got and got[0].__fields__ == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    key = lambda r: (r[0] is None, r[0], r[7], r[6])
    assert sorted((tuple(r) for r in got), key=key) == sorted((expected(*r) for r in rows), key=key)
    assert sum(r.n_runs for r in got) > 50


def test_operator_keeps_texts_and_other_ids(spark):
    df = spark.createDataFrame([("a", "k " + "x y z " * 6 + "end"), ("b", None)], "name string, body string")
    a, b = sorted(periodic_runs.find(df, "name", "body").collect())
    assert (a.doc_id, a.n_words, [tuple(r) for r in a.runs], a.collapsed) == ("a", 20, [(1, 18, 3)], "k x y z end")
    assert (b.doc_id, b.n_words, b.runs, b.collapsed) == ("b", 0, [], "")
    assert periodic_runs.find(df.where(F.lit(False)), "name", "body").count() == 0
