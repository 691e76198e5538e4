"""Near copies of documents by a chosen-path join on word shingles, then exact verification.

Every text becomes the set of its five-word shingles, embedded as ``COORDINATES`` minhash values. Sets that are equal
are one class from the start. A run splits the classes recursively: at each node a coordinate (at times two, so that a
pair at the threshold keeps about one common path) is chosen by a hash of the path, and a class goes to the child of its
minhash there. A bucket of at most ``LEAF`` classes is compared by brute force on byte sketches; larger ones are split
again, and what is still large at ``DEPTH`` is compared in pairs of blocks, so no bucket is cut. Every level loses pairs,
so there are as many runs as leave a pair at the threshold a chance of under ``MISSED`` to be missed even where all its
buckets are split down to ``DEPTH`` (see ``miss_probability``).

Candidate links make groups; within a group the whole shingle sets are compared exactly, all against all, block by
block, and each class counts its links. Only classes in candidate groups ship their sets, once each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calltide.llm.common import SHINGLE_WORDS, SIMILARITY, bound_batches, drop_table, lean, materialize
from calltide.llm.components import components
from calltide.llm.textvec import U64, ascii_lower_words, mix, slices, span_hashes, utf8

COORDINATES = 128
MISSED = 1e-4
FIRST_DEPTH = 2
DEPTH = 6
LEAF = 64
BLOCK = 1024
#: Sketches are compared at the threshold less this: over four standard deviations of 128 coordinates.
SKETCH_MARGIN = 0.16
#: Ids of candidate classes up to which they are broadcast to the scan that makes their sets: 16 bytes each.
BROADCAST_ROWS = 500_000

#: Shingles of all sets in a block at most about so many (8 bytes each), so that two blocks fit in a worker.
BLOCK_SHINGLES = 2_000_000

_SALTS = (mix(np.arange(1, COORDINATES + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)) >> U64(32)).astype(np.uint32) | np.uint32(1)


def miss_probability(similarity: float, depth: int = DEPTH, runs: int | None = None, threshold: float = SIMILARITY) -> float:
    """That a pair of this similarity shares no bucket in any run, where buckets are leaves at ``depth``.

    All runs draw from the same minhash values, so they are independent only given how many of these agree.
    """
    runs, second, missed = runs or runs_needed(threshold), min(1.0, 1 / threshold - 1), 0.0
    for agree in range(COORDINATES + 1):
        alive = 1.0
        for _ in range(depth):
            hit = agree / COORDINATES * alive
            alive = 1 - (1 - second) * (1 - hit) - second * (1 - hit) ** 2
        missed += math.comb(COORDINATES, agree) * similarity**agree * (1 - similarity) ** (COORDINATES - agree) * (1 - alive) ** runs
    return missed


@lru_cache
def runs_needed(threshold: float) -> int:
    """The least number of runs that misses a pair at the threshold with a chance of under MISSED at DEPTH."""
    return next(n for n in count(1) if miss_probability(threshold, DEPTH, n, threshold) < MISSED)


def shingle_sets(texts: list[str], words_each: int = SHINGLE_WORDS) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text; fewer words than a shingle make one of their own, no words none."""
    out: list[np.ndarray] = []
    for i, j in slices(np.array([len(t) for t in texts], np.int64)):
        raw, offsets = utf8(texts[i:j])
        low, starts, ends, first = ascii_lower_words(raw, offsets)
        words = span_hashes(low, starts, ends)
        rolled = np.zeros(max(0, len(words) - words_each + 1), U64)
        for k in range(words_each):
            rolled = mix(rolled * U64(0x9E3779B97F4A7C15) + words[k : k + len(rolled)] + U64(words_each))
        for k in range(j - i):
            a, b = first[k], first[k + 1]
            if b - a >= words_each:
                out.append(np.unique(rolled[a : b - words_each + 1]))
            elif b > a:
                short = np.array([b - a], U64)
                for k_ in range(a, b):
                    short = mix(short * U64(0x9E3779B97F4A7C15) + words[k_ : k_ + 1])
                out.append(short)
            else:
                out.append(np.zeros(0, U64))
    return out


def signature(shingles: np.ndarray) -> np.ndarray:
    """32-bit minhash values of a non-empty set at all coordinates."""
    least = np.full(COORDINATES, 0xFFFFFFFF, np.uint32)
    short = (shingles >> U64(32)).astype(np.uint32) ^ shingles.astype(np.uint32)
    for a in range(0, len(short), 2048):
        x = short[a : a + 2048, None] * _SALTS[None, :]
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x2C1B3C6D)
        x ^= x >> np.uint32(13)
        x *= _SALTS[None, ::-1]
        np.minimum(least, x.min(axis=0), out=least)
    return least


def set_keys(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set, as two signed longs."""
    if not len(shingles):
        return 0, 0
    total, n = mix(shingles).sum(dtype=U64), U64(len(shingles))
    other = mix(shingles ^ U64(0xA5A5A5A5A5A5A5A5)).sum(dtype=U64)
    both = mix(np.array([total + n, other ^ (n << U64(32))], U64)).view(np.int64)
    return int(both[0]), int(both[1])


def paths(signatures: np.ndarray, row: np.ndarray, key: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of the children of each node: one coordinate each, and a second with chance 1/threshold - 1."""
    h = mix(key ^ U64(0x5151515151515151))
    rows, keys = [], []
    second = (mix(h + U64(3)) >> U64(11)).astype(float) / (1 << 53) < 1 / threshold - 1
    for k, used in enumerate((np.ones(len(h), bool), second)):
        at = np.flatnonzero(used)
        coordinate = (mix(h[at] + U64(17 + k)) % U64(COORDINATES)).astype(np.int64)
        rows.append(row[at])
        keys.append(mix(h[at] * U64(0x9E3779B97F4A7C15) + signatures[row[at], coordinate].astype(U64) * U64(0xD6E8FEB86659FD93) + coordinate.astype(U64)))
    return np.concatenate(rows), np.concatenate(keys)


def _features(docs: DataFrame) -> DataFrame:
    """(row, doc_id, k1, k2, n, signature) of every row of (row, doc_id, text); n is the number of shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets([t or "" for t in batch.column("text").to_pylist()])
            keys = [set_keys(s) for s in sets]
            signed = [signature(s).astype("<u4").tobytes() if len(s) else b"" for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("doc_id"), pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array([len(s) for s in sets], pa.int32()), pa.array(signed, pa.binary())],
                ["row", "doc_id", "k1", "k2", "n", "signature"],
            )

    return docs.mapInArrow(lean(run), "row long, doc_id long, k1 long, k2 long, n int, signature binary")


def _children(level: DataFrame, threshold: float, first: bool) -> DataFrame:
    """(class, n, key) of the next nodes of (class, n, signature[, key]); without keys, all runs' nodes at FIRST_DEPTH."""
    runs = runs_needed(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes = np.array(batch.column("class"), np.int64), np.array(batch.column("n"), np.int32)
            signatures = np.frombuffer(b"".join(batch.column("signature").to_pylist()), "<u4").reshape(-1, COORDINATES)
            if first:
                row, key = np.tile(np.arange(len(ids)), runs), mix(np.repeat(np.arange(1, runs + 1).astype(U64), len(ids)))
            else:
                row, key = np.arange(len(ids)), np.array(batch.column("key"), np.int64).view(U64)
            for _ in range(FIRST_DEPTH if first else 1):
                row, key = paths(signatures, row, key, threshold)
            yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(sizes[row]), pa.array(key.view(np.int64))], ["class", "n", "key"])

    return level.mapInArrow(lean(run), "class long, n int, key long")


def _close_stars(sketches: np.ndarray, sizes: np.ndarray, threshold: float, cross: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(x, y) local links that join what sketches call close; with ``cross`` only links between [:cross] and [cross:].

    Every link makes two groups one, so there are fewer links than rows. With ``cross`` the groups within either part
    are made first, without links, as the pairs of one block give those.
    """
    m = len(sizes)
    root = np.arange(m)
    xs, ys = [], []

    def star(i: int, lo: int, hi: int, linked: bool) -> None:
        fits = np.minimum(sizes[lo:hi], sizes[i]) >= threshold * np.maximum(sizes[lo:hi], sizes[i])
        near = np.flatnonzero(fits & (root[lo:hi] != root[i])) + lo
        close = near[(sketches[near] == sketches[i]).mean(axis=1) >= threshold - SKETCH_MARGIN] if len(near) else near
        if len(close):
            merged, at = np.unique(root[close], return_index=True)
            root[np.isin(root, merged)] = root[i]
            if linked:
                xs.append(np.full(len(at), i))
                ys.append(close[at])

    for i in range(m):
        star(i, i + 1, m if cross is None or i >= cross else cross, linked=cross is None)
    for i in range(cross or 0):
        star(i, cross, m, linked=True)
    none = np.zeros(0, np.int64)
    return (np.concatenate(xs), np.concatenate(ys)) if xs else (none, none)


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
    """Consecutive rows of equal (key, pair), whole buckets, from sorted batches."""
    pending: dict[str, np.ndarray] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = {c: np.array(batch.column(c)) for c in ("key", "pair", "side", "class", "n")}
        now["sketch"] = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint8).reshape(batch.num_rows, COORDINATES)
        if pending is not None:
            now = {c: np.concatenate([pending[c], now[c]]) for c in now}
        bounds = np.concatenate([[0], np.flatnonzero((now["key"][1:] != now["key"][:-1]) | (now["pair"][1:] != now["pair"][:-1])) + 1])
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            yield {c: v[a:b] for c, v in now.items()}
        pending = {c: v[bounds[-1] :] for c, v in now.items()}
    if pending is not None:
        yield pending


def _leaf_links(rows: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) that join each bucket's close classes, from (key, pair, side, class, n, sketch) sorted by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket in _buckets(batches):
            order = np.argsort(bucket["side"], kind="stable")
            cross = int((bucket["side"] == 0).sum()) if bucket["side"].max() else None
            x, y = _close_stars(bucket["sketch"][order], bucket["n"][order], threshold, cross)
            if len(x):
                ids = bucket["class"][order]
                yield pa.RecordBatch.from_arrays([pa.array(ids[x]), pa.array(ids[y])], ["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def _block_pairs(blocks: Column) -> Column:
    """The pairs of blocks that a class takes part in, (pair, side); one pair where there is one block."""
    own = F.pmod(F.xxhash64("class"), blocks).cast("int")
    pair = lambda j: (F.least(own, j).cast("long") * blocks + F.greatest(own, j)).alias("pair")
    return F.transform(F.sequence(F.lit(0), blocks - 1), lambda j: F.struct(pair(j), F.when(own > j, 1).otherwise(0).alias("side")))


def candidate_links(classes: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """Links (a, b) between classes (class, n, signature) that join all whose sketches are close; the recursion on buckets."""
    level, parts, written = _children(classes.select("class", "n", "signature"), threshold, first=True), [], []
    for depth in range(FIRST_DEPTH, DEPTH + 1):
        level = materialize(level)
        members = level.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
        shared = materialize(level.join(members, "key").select("class", "n", "key", "members"))
        drop_table(level)
        written.append(shared)
        parts.append(shared if depth == DEPTH else shared.where(F.col("members") <= LEAF))
        deeper = shared.where(F.col("members") > LEAF)
        if depth == DEPTH or deeper.isEmpty():
            break
        level = _children(deeper.drop("n", "members").join(classes.select("class", "n", "signature"), "class").select("class", "n", "signature", "key"), threshold, first=False)
    leaves = parts[0]
    for part in parts[1:]:
        leaves = leaves.unionByName(part)
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    placed = leaves.select("class", "n", "key", F.explode(_block_pairs(blocks)).alias("p")).select("class", "n", "key", "p.*")
    rows = placed.join(_sketched(classes.select("class", "signature")), "class")
    rows = rows.select("key", "pair", "side", "class", "n", "sketch").repartition("key", "pair").sortWithinPartitions("key", "pair", "class")
    links = materialize(_leaf_links(rows, threshold).distinct())
    for used in written:
        drop_table(used)
    return links


def _sketched(classes: DataFrame) -> DataFrame:
    """The lowest byte of each minhash value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low = np.frombuffer(b"".join(batch.column("signature").to_pylist()), "<u4").reshape(-1, COORDINATES).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([batch.column("class"), pa.array([r.tobytes() for r in low], pa.binary())], ["class", "sketch"])

    return classes.mapInArrow(run, "class long, sketch binary")


def exact_links(sets: list[np.ndarray], threshold: float, cross: int | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """(i, linked js) of sets with Jaccard of at least ``threshold``; with ``cross`` only between [:cross] and [cross:]."""
    sizes = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, column, times = np.unique(flat, return_inverse=True, return_counts=True)
    keep = times[column] > 1
    order = np.argsort(column[keep], kind="stable")
    column, owner = column[keep][order], owner[keep][order]
    _, dense = np.unique(column, return_inverse=True)
    left = len(sets) if cross is None else cross
    common = np.zeros((left, len(sets)), np.float32)
    width = int(dense[-1]) + 1 if len(dense) else 0
    step = max(256, (1 << 22) // max(1, len(sets)))
    for a in range(0, width, step):
        lo, hi = np.searchsorted(dense, [a, a + step])
        block = np.zeros((len(sets), min(step, width - a)), np.float32)
        block[owner[lo:hi], dense[lo:hi] - a] = 1
        common += block[:left] @ block.T
    for i in range(left):
        close = common[i] >= threshold * (sizes[i] + sizes - common[i]) - 1e-6
        close[i] = False
        if cross is not None:
            close[:cross] = False
        yield i, np.flatnonzero(close)


def _verify(members: DataFrame, threshold: float) -> DataFrame:
    """(class, links, root) from rows (group, pair, side, class, copies, shingles), one pair of blocks at a time.

    ``links`` counts the copies of linked classes in the other block (or the same), ``root`` joins linked classes.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["side", "class"], kind="stable", ignore_index=True)
        cross = int((pdf["side"] == 0).sum()) if pdf["side"].max() else None
        ids, copies = pdf["class"].to_numpy(), pdf["copies"].to_numpy(np.int64)
        links, root = np.zeros(len(ids), np.int64), np.arange(len(ids))
        for i, close in exact_links([np.frombuffer(s, "<u8") for s in pdf["shingles"]], threshold, cross):
            links[i] += copies[close].sum()
            if cross is not None:
                links[close] += copies[i]
            apart = close[root[close] != root[i]]
            if len(apart):
                root[np.isin(root, root[apart])] = root[i]
        _, part = np.unique(root, return_inverse=True)
        least = np.full(len(ids), np.iinfo(np.int64).max)
        np.minimum.at(least, part, ids)
        return pd.DataFrame({"class": ids, "links": links, "root": least[part]})

    return members.groupBy("group", "pair").applyInPandas(run, "class long, links long, root long")


def _numbered(docs: DataFrame, *columns: Column) -> DataFrame:
    """The columns with a number for every row, which stays as it is written: ids may be null or repeat."""
    return materialize(docs.select(F.monotonically_increasing_id().alias("row"), *columns))


def link(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = SIMILARITY) -> DataFrame:
    """(doc_id, class_id, n_links), one row per row of ``docs``.

    ``class_id`` is the least doc_id of the document's connected component of links, ``n_links`` the number of other
    rows whose shingle set has a Jaccard similarity of at least ``threshold`` to its own; equal sets are similar.
    Documents without words (null, empty) are linked to nothing and are each their own class. Words are runs of
    [0-9a-z] and characters beyond ASCII after lower-casing A-Z. A null doc_id counts as -1.
    """
    bound_batches(docs.sparkSession)
    texts = _numbered(docs, F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    out = _linked(texts, threshold).drop("row", "stays")
    drop_table(texts)
    return out


def _linked(texts: DataFrame, threshold: float) -> DataFrame:
    """(row, doc_id, class_id, n_links, stays) of a written table (row, doc_id, text), which is read no more afterwards.

    ``stays`` marks one row of each component, the first by (doc_id, row), and every row without words.
    """
    features = materialize(_features(texts))
    # copies meet here: one row per set, combined on the map side; a class is named by its first key
    first = F.min(F.struct(F.coalesce("doc_id", F.lit(-1)).alias("least"), "row"))
    classes = features.where("n > 0").groupBy("k1", "k2").agg(first.alias("first"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("signature").alias("signature"))
    classes = materialize(classes.select(F.col("k1").alias("class"), "k2", "first.least", "first.row", "copies", "n", "signature"))
    groups = components(candidate_links(classes, threshold))
    sized = groups.withColumnRenamed("node", "class").join(classes.select("class", "row", "copies", "n"), "class")
    per_group = sized.groupBy("component").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("shingles"))
    blocks = F.greatest(F.ceil(F.col("members") / BLOCK), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    named = materialize(sized.join(per_group.select("component", blocks.alias("blocks")), "component").select("class", F.col("component").alias("group"), "row", "copies", "blocks"))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets([t or "" for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in batch.schema.names[:-1]), pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary())], [*batch.schema.names[:-1], "shingles"])

    small = F.broadcast(named) if named.count() <= BROADCAST_ROWS else named
    wanted = texts.select("row", "text").join(small, "row").select("class", "group", "copies", "blocks", "text")
    shingled = wanted.mapInArrow(lean(make), "class long, group long, copies long, blocks int, shingles binary")
    members = shingled.select("class", "group", "copies", "shingles", F.explode(_block_pairs(F.col("blocks"))).alias("p")).select("class", "group", "copies", "shingles", "p.*")
    verified = materialize(_verify(members, threshold))
    roots = components(verified.select(F.col("class").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "class")
    facts = classes.select("class", "k2", F.struct("least", "row").alias("first"), "copies").join(verified.groupBy("class").agg(F.sum("links").alias("links")), "class", "left").join(roots, "class", "left")
    facts = facts.withColumn("component", F.coalesce("component", "class"))
    names = facts.groupBy("component").agg(F.min("first").alias("of"))
    facts = materialize(facts.join(names, "component").select("class", "k2", "of", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")))
    joined = features.select("row", "doc_id", "n", F.col("k1").alias("class"), "k2").join(facts, ["class", "k2"], "left")
    class_id = F.coalesce("of.least", "doc_id", F.lit(-1)).alias("class_id")
    return joined.select("row", "doc_id", class_id, F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce(F.col("row") == F.col("of.row"), F.lit(True)).alias("stays"))


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = SIMILARITY) -> DataFrame:
    """The documents with their own columns, whatever those are called, of each class the first by doc_id.

    Rows without words all stay. A null id counts as -1; of rows that share the class's least id one stays.
    """
    bound_batches(docs.sparkSession)
    columns = docs.columns
    numbered = _numbered(docs, *(F.col(f"`{c}`").alias(f"__{k}") for k, c in enumerate(columns)))
    texts = numbered.select("row", F.col(f"__{columns.index(doc_id)}").cast("long").alias("doc_id"), F.col(f"__{columns.index(text)}").alias("text"))
    gone = materialize(_linked(texts, threshold).where("NOT stays").select("row"))
    small = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
    return numbered.join(small, "row", "left_anti").select(*(F.col(f"__{k}").alias(c) for k, c in enumerate(columns)))
