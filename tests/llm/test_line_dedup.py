from __future__ import annotations

import random
import re

import corpus_pipeline

from calltide.llm import line_dedup


def shingle_set(line: str) -> frozenset:
    """Five-word shingles; fewer words are one token."""
    words = re.findall("[0-9a-z\x80-\U0010ffff]+", line.lower())
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute(docs: list[tuple]) -> dict[tuple, list[int]]:
    """Removed lines by (doc_id, text): ids here have one text each, so order is by id and line."""
    seen, out = [], {}
    for doc_id, text in sorted(set(docs), key=lambda r: r[0]):
        removed = []
        for k, line in enumerate(text.split("\n") if text is not None else []):
            s = shingle_set(line)
            if s:
                if any(100 * len(s & t) >= 80 * len(s | t) for t in seen):
                    removed.append(k)
                seen.append(s)
        out[doc_id] = removed
    return out


def corpus(seed: int, n: int) -> list[tuple]:
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(60)] + ["é", "ß1"]
    lines = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 30))) for _ in range(25)]
    docs = []
    for i in range(n):
        own = []
        for _ in range(rng.randint(0, 6)):
            parts = rng.choice(lines).split(" ")
            if rng.random() < 0.5:
                parts[rng.randrange(len(parts))] = rng.choice(words)
            if rng.random() < 0.2:
                parts = parts[: rng.randint(1, len(parts))]
            own.append(rng.choice([" ", ", ", "  "]).join(parts))
        docs.append((i, "\n".join(own)))
    return docs


def test_against_brute_force(spark):
    docs = corpus(3, 120) + [(500, None), (501, ""), (502, "a b c d e f\n\nA b, c d e f"), (502, "a b c d e f\n\nA b, c d e f")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("kept", line_dedup.F.lit("clash"))
    got = line_dedup.judged_lines(df).collect()
    assert len(got) == len(docs)
    want = brute(docs)
    for row in got:
        assert sorted(row.removed) == want[row.doc_id], row
    texts = {r.doc_id: r.text for r in line_dedup.clean(df, drop_emptied=False).collect()}
    for doc_id, text in docs:
        lines = text.split("\n") if text is not None else None
        assert texts[doc_id] == (None if lines is None else "\n".join(x for k, x in enumerate(lines) if k not in want[doc_id]))
    assert line_dedup.clean(df).columns == df.columns
    dropped = {r.doc_id for r in line_dedup.clean(df).collect()}
    assert {500, 501, 502} <= dropped and len(dropped) < len(texts)


def test_empty_and_null_ids(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert line_dedup.judged_lines(empty).count() == 0 and line_dedup.clean(empty).count() == 0
    df = spark.createDataFrame([(None, "one two three four five"), (7, "one two three four five\nshort"), (7, "other text"), (7, "x " * 200_000)], "doc_id long, text string")
    got = sorted((r.doc_id is not None, r.n_lines, list(r.removed)) for r in line_dedup.judged_lines(df).collect())
    assert got == [(False, 1, []), (True, 1, []), (True, 1, []), (True, 2, [0])]


def test_many_variants_of_one_line(spark):
    base = [f"t{k}" for k in range(60)]
    docs = [(i, " ".join(base[: i % 50] + [f"v{i}"] + base[i % 50 + 1 :])) for i in range(300)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r.doc_id: list(r.removed) for r in line_dedup.judged_lines(df).collect()} == brute(docs)


def test_only_native_operations(spark):
    df = spark.createDataFrame(corpus(1, 5), "doc_id long, text string")
    plan = line_dedup.judged_lines(df)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_short_lines(spark):
    docs = corpus(7, 60) + [(400, "Read more\n\none, TWO\n--\nread"), (401, "read  MORE!\n\n--\nread more now\none two\none two three four five"), (402, "read")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = brute(docs)
    assert want[401] == [0, 4] and want[402] == [0]
    assert {r.doc_id: list(r.removed) for r in line_dedup.judged_lines(df).collect()} == want


def test_pipeline_stage_takes_short_lines(spark):
    df = spark.createDataFrame([(1, "Read more\nfirst of all texts"), (2, "read more\nanother one"), (3, "READ MORE")], "doc_id long, text string")
    left = {r.doc_id: r.text for r in corpus_pipeline.line_deduplication(spark, df, "").collect()}
    assert left == {1: "Read more\nfirst of all texts", 2: "another one"}


def test_unlike_lines_with_equal_32_bit_hashes_stay(spark):
    """Two lines of one shingle each, which Spark's murmur hash of their words maps to the same value."""
    docs = [(1, "line number 247325 of many"), (2, "line number 262656 of many"), (3, "line number 98830 of many"), (4, "line number 134566 of many"), (5, "Line number 98830 of many")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    hashed = df.select("doc_id", line_dedup.F.expr("hash(xxhash64('line'), xxhash64('number'), xxhash64(split(text, ' ')[2]), xxhash64('of'), xxhash64('many'))").alias("h"))
    assert hashed.where("doc_id < 5").select("h").distinct().count() == 2
    assert {r.doc_id: list(r.removed) for r in line_dedup.judged_lines(df).collect()} == {1: [], 2: [], 3: [], 4: [], 5: [0]}


def test_prefix_tokens_of_equal_low_bits(spark, monkeypatch):
    """With 3 bits left of a prefix token, sets hold equal ones; the result does not change."""
    monkeypatch.setattr(line_dedup, "BUCKETS", 1)
    monkeypatch.setattr(line_dedup, "_token", lambda place: place.bitwiseAND(7).cast("int"))
    monkeypatch.setattr(line_dedup, "ordered", lambda tokens, ranks: line_dedup.F.sort_array(line_dedup.F.transform(tokens, lambda s: s.bitwiseAND(7))))
    docs = corpus(11, 80)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r.doc_id: list(r.removed) for r in line_dedup.judged_lines(df).collect()} == brute(docs)


def test_joins_without_broadcast(spark, monkeypatch):
    docs = corpus(13, 60)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    monkeypatch.setattr(line_dedup, "BROADCAST_ROWS", -1)
    monkeypatch.setattr(line_dedup, "BROADCAST_BYTES", -1)
    assert {r.doc_id: list(r.removed) for r in line_dedup.judged_lines(df).collect()} == brute(docs)


def test_short_unlike_lines_all_stay(spark):
    """400,000 lines of five words, none of them shared: 32-bit tokens would take some 18 away."""
    df = spark.range(400_000).selectExpr("id AS doc_id", "concat_ws(' ', concat('a', id), concat('b', id), concat('c', id), concat('d', id), concat('e', id)) AS text")
    assert line_dedup.removals(df).count() == 0


def test_plans_print_a_small_rarity_order(spark, monkeypatch):
    """The driver keeps the nodes of every plan as text."""
    plans = []
    materialize = line_dedup.materialize
    monkeypatch.setattr(line_dedup, "materialize", lambda df, *a: plans.append(df._jdf.queryExecution().executedPlan().treeString()) or materialize(df, *a))
    docs = corpus(17, 40)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r.doc_id: list(r.removed) for r in line_dedup.judged_lines(df).collect()} == brute(docs)
    largest = max((line for plan in plans for line in plan.split("\n")), key=len)
    assert 10_000 < len(largest) < 120_000


def test_common_tokens_come_last(spark):
    df = spark.createDataFrame([(k, f"the same five words follow n{k} m{k} l{k} k{k} j{k}") for k in range(200)], "doc_id long, text string")
    lines = line_dedup.token_sets(df, "doc_id", "text").cache()
    order = line_dedup.rarity_order(lines)
    common = lines.select(line_dedup.F.explode("tokens").alias("t")).groupBy("t").count().where("count = 200").first().t
    firsts = lines.select(line_dedup.ordered("tokens", order).alias("o")).collect()
    assert len({r.o[-1] for r in firsts}) == 1 and all(r.o[-1] & (1 << 60) - 1 == (common & (1 << 64) - 1) >> 4 and sorted(r.o) == r.o for r in firsts)
    lines.unpersist()


def test_prefixes_follow_the_rarity_order(spark, monkeypatch):
    """Taken without sorting where enough tokens are not common, a prefix is that of the whole order."""
    monkeypatch.setattr(line_dedup, "BUCKETS", 1 << 10)
    shared = " ".join(f"s{k}" for k in range(40))
    docs = [(k, f"{shared}\n{' '.join(f'o{k}x{j}' for j in range(k % 30))} {shared if k % 2 else 'end'}") for k in range(300)]
    lines = line_dedup.token_sets(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text").cache()
    F = line_dedup.F
    classes, common = line_dedup._rarity(lines)
    length = F.greatest(F.floor(F.size("tokens") / 5), F.lit(1)).cast("int")
    rows = lines.select(line_dedup.ordered("tokens", classes).alias("all"), line_dedup._prefix(classes, common, length).alias("prefix"), length.alias("n")).collect()
    assert 0 < len(common) <= 32
    for r in rows:
        assert [(e & (1 << 64) - 1) >> 4 for e in r.prefix] == [e & (1 << 60) - 1 for e in r["all"][: r.n]]
    lines.unpersist()


def test_bitmaps_grow_with_their_keys(spark):
    """At 64 bits a key, few others pass: of a fixed 2**24 bits a ninth would here."""
    F = line_dedup.F
    keys = spark.range(2_000_000).select(F.hash("id").alias("key"))
    bitmap, bits = line_dedup._bitmap(keys, 2_000_000)
    ids = spark.range(1_990_000, 2_200_000).withColumn("key", F.hash("id"))
    found = line_dedup._marked(ids, F.col("key"), bitmap, bits).groupBy((F.col("id") < 2_000_000).alias("own")).agg(F.avg(F.col("marked").cast("int")).alias("share")).collect()
    share = {r.own: r.share for r in found}
    assert share[True] == 1 and share[False] < 0.03


def test_rows_held_twice(spark, monkeypatch):
    """Rows of equal id and text, null ids too, whose lines other documents repeat; by broadcasts and without."""
    twice = [(None, "one two three four five\none two three four five"), (3, "six seven eight nine ten"), (8, "alone and not to be found elsewhere")]
    docs = [*twice, *twice, (7, "one two three four five\nshort"), (9, "six seven eight nine ten\nSHORT")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for rows in (line_dedup.BROADCAST_ROWS, -1):
        monkeypatch.setattr(line_dedup, "BROADCAST_ROWS", rows)
        got = sorted((r.doc_id or 0, list(r.removed)) for r in line_dedup.judged_lines(df).collect())
        assert got == [(0, [1]), (0, [1]), (3, []), (3, []), (7, [0]), (8, []), (8, []), (9, [0, 1])]


def test_earliest_lines_come_first_only_in_crowds(spark, monkeypatch):
    """Lines meet the earliest of their token and length first only where many share it; the result is the same for every limit."""
    met = []
    verified = line_dedup._verified
    monkeypatch.setattr(line_dedup, "_verified", lambda pairs, *a: met.append(pairs.count()) or verified(pairs, *a))
    docs = [(i, " ".join(f"{'v' if k == i % 3 * 30 else 't'}{i // 3}x{k}" for k in range(60))) for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = brute(docs)
    assert any(want.values())
    for crowd, early in ((line_dedup.CROWD, False), (1, True)):
        met.clear()
        monkeypatch.setattr(line_dedup, "CROWD", crowd)
        assert {r.doc_id: list(r.removed) for r in line_dedup.judged_lines(df).collect()} == want
        assert len(met) == 2 and (met[0] > 0) == early
