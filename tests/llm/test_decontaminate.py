from __future__ import annotations

import hashlib
import random
import re

from calltide.llm import decontaminate


def words_of(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text, items, window=13):
    doc, hit, found = words_of(text), set(), set()
    for item, item_text in items:
        own = words_of(item_text)
        n = min(window, len(own))
        for a in range(len(own) - n + 1 if n else 0):
            for p in range(len(doc) - n + 1):
                if doc[p : p + n] == own[a : a + n]:
                    hit |= set(range(p, p + n))
                    found.add(str(item))
    listed = ",".join(sorted(found))
    return len(doc), len(hit), len(found), hashlib.sha256(listed.encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(doc)


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = ["a", "b", "the", "É", "x1", "of", "w", "zz"]
    text = lambda n: rng.choice([" ", ", ", "\n"]).join(rng.choice(vocabulary) for _ in range(n))
    items = [(k, text(rng.choice([1, 2, 3, 5, 13, 14, 20, 40]))) for k in range(12)] + [(50, None), (51, ""), (52, "!!"), (2, text(16))]
    docs = []
    for k in range(40):
        t = text(rng.randint(0, 80))
        if rng.random() < 0.6 and (own := rng.choice(items)[1]):
            t += " " + own.upper() + " " + text(rng.randint(0, 30))
        docs.append((k, t))
    return [*docs, (100, None), (101, ""), (3, docs[3][1])], items


def test_against_brute_force(spark, monkeypatch):
    docs, items = corpus(1)
    d = spark.createDataFrame([(i, t, 1, "r") for i, t in docs], "doc_id long, text string, n_words int, ranges string")
    b = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, doc_id int")
    want = sorted((i, *brute(t, items)) for i, t in docs)
    assert sorted(map(tuple, decontaminate.report(d, b).collect())) == want
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 60)  # several blocks of the benchmark, one after the other
    monkeypatch.setattr(decontaminate, "PART_WORDS", 5)  # and items in several parts
    assert sorted(map(tuple, decontaminate.report(d, b).collect())) == want
    kept = decontaminate.clean(d, b)
    assert kept.columns == d.columns and sorted(r.doc_id for r in kept.collect()) == [i for i, *_, bad in want if not bad]


def test_ranges_empty_tables_and_long_texts(spark):
    b = spark.createDataFrame([(1, " ".join(f"w{k}" for k in range(20)))], "item_id long, text string")
    d = spark.createDataFrame([(1, "x " * 200_000 + " ".join(f"w{k}" for k in range(3, 20)))], "doc_id long, text string")
    row = decontaminate.overlaps(d, b).first()
    assert row.n_words == 200_017 and [(r.start, r.end) for r in row.ranges] == [(200_000, 200_017)] and row["items"] == ["1"]
    assert decontaminate.report(d.limit(0), b).count() == 0
    assert decontaminate.report(d, b.limit(0)).first().n_hit == 0 and decontaminate.clean(d, b.limit(0)).count() == 1


def test_null_item_ids_and_windows_of_many_items(spark):
    own = " ".join(f"w{k}" for k in range(15))
    b = spark.createDataFrame([(None, own), (None, own), (7, own), (12, "x " + own)], "item_id long, text string")
    row = decontaminate.report(spark.createDataFrame([(1, own + " tail")], "doc_id long, text string"), b).first()
    assert (row.n_hit, row.n_items, row.items_sha256) == (15, 3, hashlib.sha256(b"12,7").hexdigest())


def test_index_is_flat():
    """Size by word of the benchmark, and every window is found where it stands."""
    import pickle

    import numpy as np

    rng = np.random.default_rng(3)
    parts = [rng.integers(0, 1 << 63, 4000).astype(np.uint64) for _ in range(20)]
    windows = decontaminate.Windows([str(k) for k in range(20)], parts, 13)
    index = decontaminate.Index(windows, {n: (keys, np.ones(len(keys), np.int64)) for n, keys in windows.shingles().items()})
    assert len(pickle.dumps(index)) < 24 * 80_000 + (5 << 20)
    start, end, item = index.occurrences(parts[3], np.array([0, 4000]))
    assert len(start) == 4000 - 12 and (end - start == 13).all() and set(item.tolist()) == {index.names.index("3")}
