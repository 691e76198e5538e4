"""Hard negatives by exact inner products, most of which an orthogonal rotation spares.

Components are quantised to integers, so that scores are exact and ties are ties. The rotation to principal components
(eigenvectors of the second moments of all vectors) keeps inner products and moves most of them into the leading
components. A task streams its rows past a block of anchors: partial products over the leading components, plus the
product of the norms of what is left, plus a slack for rounding, bound each pair's score from both sides; pairs that
cannot come among the best go early, step by step, and the survivors are verified by integer products.

Two passes: the first finds each anchor's positives (best scores of its label), the second, for each positive, the best
scores of other labels within a window below the positive's. Vectors are never shuffled or copied: each pass reads the
table where it lies, anchors go to the tasks in blocks of at most ``BLOCK_BYTES``, and a task returns a few rows an anchor
for each window. The passes of one block follow those of another, each over all executors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from calltide.llm.common import bound_batches, drop_table, materialize

POSITIVES = 5
NEGATIVES = 5
#: A component x becomes floor(SCALE * x).
SCALE = 256
#: Least share of the positive's score that a hard negative has, in percent.
LEAST_PERCENT = 80
#: Bytes of a block of anchors: integers and rotated components.
BLOCK_BYTES = 32 << 20
#: Anchors and pairs that a task holds at once.
ANCHORS_AT_ONCE = 2048
PAIRS_AT_ONCE = 1 << 17
#: Leading shares of the components after which pairs are looked through.
STEPS = (0.25, 0.5, 0.75)
_LOWEST = np.iinfo(np.int64).min


class Best:
    """The ``depth`` best (score, then least id) seen so far for each key."""

    def __init__(self, keys: int, depth: int):
        self.depth = depth
        self.key, self.score, self.id = (np.empty(0, np.int64) for _ in range(3))
        self.floor = np.full(keys, _LOWEST)

    def add(self, key: np.ndarray, score: np.ndarray, id_: np.ndarray) -> None:
        good = score >= self.floor[key]
        if not good.any():
            return
        key, score, id_ = (np.concatenate(x) for x in ((self.key, key[good]), (self.score, score[good]), (self.id, id_[good])))
        order = np.lexsort((id_, -score, key))
        key = key[order]
        place = np.arange(len(key)) - np.searchsorted(key, key)
        kept = order[place < self.depth]
        self.key, self.score, self.id = key[place < self.depth], score[kept], id_[kept]
        full = place == self.depth - 1
        self.floor[key[full]] = score[order[full]]


class Rotation:
    """An orthogonal matrix whose leading columns hold most of the vectors' second moments, and the slack that it needs."""

    def __init__(self, moments: np.ndarray):
        d = len(moments)
        self.matrix = np.linalg.eigh(moments)[1][:, ::-1].copy()
        apart = np.linalg.norm(self.matrix.T @ self.matrix - np.eye(d))
        #: error of a partial product plus its remainder, as a share of both vectors' norms
        self.slack = 8 * d**1.5 * np.finfo(float).eps + 4 * apart
        self.steps = sorted({max(1, min(d, round(d * s))) for s in STEPS} | {d})

    def apply(self, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rotated, norms): norms[k] of all and then of what is left after each step."""
        out = whole @ self.matrix
        left = np.cumsum((out * out)[:, ::-1], axis=1)[:, ::-1]
        return out, np.sqrt(np.stack([(whole * whole).sum(axis=1), *(left[:, k] if k < out.shape[1] else np.zeros(len(out)) for k in self.steps)]))


def survivors(rotation: Rotation, a: tuple[np.ndarray, np.ndarray], x: tuple[np.ndarray, np.ndarray], wanted: np.ndarray, lowest: np.ndarray, highest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) of the ``wanted`` pairs (anchors by rows) whose product may lie in [lowest[i], highest[i]]."""
    (ya, na), (yx, nx) = a, x
    low, high = (np.nextafter(v.astype(float), to) for v, to in ((lowest, -np.inf), (highest, np.inf)))
    i, j = np.nonzero(wanted)
    partial, begin, dense = np.zeros(len(i)), 0, True
    for step, end in enumerate(rotation.steps, 1):
        if not len(i):
            break
        if dense:
            partial += (ya[:, begin:end] @ yx[:, begin:end].T)[i, j]
        else:
            for s in range(0, len(i), PAIRS_AT_ONCE):
                own = slice(s, s + PAIRS_AT_ONCE)
                partial[own] += np.einsum("pd,pd->p", ya[i[own], begin:end], yx[j[own], begin:end])
        rest = na[step, i] * nx[step, j] + rotation.slack * na[0, i] * nx[0, j]
        alive = (partial + rest >= low[i]) & (partial - rest <= high[i])
        i, j, partial, begin = i[alive], j[alive], partial[alive], end
        dense = len(i) > 0.1 * len(ya) * len(yx)
    return i, j


def products(a: np.ndarray, x: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Integer inner products of the pairs."""
    out = np.empty(len(i), np.int64)
    for s in range(0, len(i), PAIRS_AT_ONCE):
        own = slice(s, s + PAIRS_AT_ONCE)
        out[own] = np.einsum("pd,pd->p", a[i[own]], x[j[own]])
    return out


def _integers(batch: pa.RecordBatch, d: int) -> np.ndarray:
    x = batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, d)
    return np.floor(SCALE * x).astype(np.int64)


def _usable(df: DataFrame, vec_id: str, vector: str, label: str) -> DataFrame:
    c = F.col(f"`{vector}`").cast("array<double>")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    rows = df.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{label}`").cast("long").alias("label"), c.alias("vector"))
    return rows.where("vec_id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL").where(F.forall("vector", finite))


def _once(rows: DataFrame) -> DataFrame:
    """One row an id, the least (label, vector); tables without repeated ids, as told by the ids alone, are left as they are."""
    repeated = rows.groupBy("vec_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("vec_id")
    if repeated.isEmpty():
        return rows
    first = rows.join(repeated, "vec_id", "left_semi").groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("r")).select("vec_id", "r.*")
    return materialize(rows.join(repeated, "vec_id", "left_anti").unionByName(first))


def _moments(rows: DataFrame, d: int) -> np.ndarray:
    """Second moments of all quantised vectors: d x d sums, added up per task and then by cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for batch in batches:
            x = _integers(batch, d).astype(float)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d * d, dtype=np.int32)), pa.array(total.ravel())], ["cell", "value"])

    out = np.zeros(d * d)
    for r in rows.select("vector").mapInArrow(run, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect():
        out[r.cell] = r.value
    return out.reshape(d, d)


def _scan(rows: DataFrame, d: int, shared, names: tuple[str, str]) -> DataFrame:
    """(key, id, score) of each task's best rows for the keys of one block: windows of scores with or without the anchor's label.

    A key is anchor * windows + window; the window of an anchor's places w is [low, high][anchor, w].
    """
    key_name, id_name = names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        rotation, ids, labels, whole = block["rotation"], block["ids"], block["labels"], block["whole"]
        low, high, same, depth = block["low"], block["high"], block["same"], block["depth"]
        windows = low.shape[1]
        best = Best(len(ids) * windows, depth)
        ya, na = rotation.apply(whole.astype(float))
        for batch in batches:
            x, own, row_labels = _integers(batch, d), np.array(batch.column("vec_id"), np.int64), np.array(batch.column("label"), np.int64)
            yx, nx = rotation.apply(x.astype(float))
            for label in np.unique(row_labels) if same else [None]:
                at = np.flatnonzero(labels == label) if same else np.arange(len(ids))
                of = np.flatnonzero(row_labels == label) if same else np.arange(len(own))
                for s in range(0, len(at), ANCHORS_AT_ONCE):
                    part = at[s : s + ANCHORS_AT_ONCE]
                    floor = np.maximum(low[part], best.floor.reshape(-1, windows)[part])
                    open_ = high[part] >= floor
                    lowest = np.where(open_, floor, np.iinfo(np.int64).max).min(axis=1)
                    wanted = (ids[part, None] != own[None, of]) & open_.any(axis=1)[:, None]
                    if not same:
                        wanted &= labels[part, None] != row_labels[None, of]
                    i, j = survivors(rotation, (ya[part], na[:, part]), (yx[of], nx[:, of]), wanted, lowest, high[part].max(axis=1))
                    score = products(whole[part], x[of], i, j)
                    for w in range(windows):
                        inside = np.flatnonzero((score >= floor[i, w]) & (score <= high[part[i], w]))
                        best.add(part[i[inside]] * windows + w, score[inside], own[of[j[inside]]])
        yield pa.RecordBatch.from_arrays([pa.array(ids[best.key // windows]), pa.array((best.key % windows).astype(np.int32)), pa.array(best.id), pa.array(best.score)], [key_name, "place", id_name, "score"])

    found = rows.mapInArrow(run, f"{key_name} long, place int, {id_name} long, score long")
    order = Window.partitionBy(key_name, "place").orderBy(F.desc("score"), id_name)
    return found.withColumn("rank", F.row_number().over(order))


def mine(rows: DataFrame, is_anchor: Column, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """(anchor_id, positive_id, rank from 1, negative_id, positive_score, negative_score) of each anchor row's hard negatives.

    A score is the inner product of components floor(256 x). Higher scores come first, ties by smaller id. Positives are the
    first ``positives`` other rows of the anchor's label; negatives of a positive are the first ``negatives`` rows of other
    labels whose score is at least 80 % of the positive's and at most as high. A positive without such rows gives none; a
    positive below zero has none.

    Rows with a null id, label or vector, or a null or non-finite component, take no part; nor do those with components so
    large that a product could leave a long. Of rows that repeat an id the least (label, vector) counts. Shorter vectors
    count as if zeros followed. ``is_anchor`` is a condition on vec_id and label. Other columns are not looked at.
    """
    spark = rows.sparkSession
    bound_batches(spark)
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    rows = _usable(rows, vec_id, vector, label)
    d = rows.agg(F.max(F.size("vector")).alias("d")).first().d
    if not d:
        return spark.createDataFrame([], schema)
    most = int(((1 << 63) - 1) // d) ** 0.5 - 1
    rows = rows.where(F.forall("vector", lambda x: F.abs(x * SCALE) < F.lit(most)))
    rows = _once(rows.withColumn("vector", F.when(F.size("vector") < d, F.concat("vector", F.array_repeat(F.lit(0.0), d - F.size("vector")))).otherwise(F.col("vector"))))
    rotation = Rotation(_moments(rows, d))
    anchors = materialize(rows.where(is_anchor))
    blocks = max(1, -(-anchors.count() * d * 16 // BLOCK_BYTES))
    parts = []
    for k in range(blocks):
        block = anchors.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == k).orderBy("vec_id").toArrow()
        if not block.num_rows:
            continue
        ids, labels = np.array(block["vec_id"], np.int64), np.array(block["label"], np.int64)
        whole = np.concatenate([_integers(b, d) for b in block.to_batches() if b.num_rows])
        fixed = {"rotation": rotation, "ids": ids, "labels": labels, "whole": whole}
        anyhow = np.full((len(ids), 1), _LOWEST), np.full((len(ids), 1), np.iinfo(np.int64).max)
        sent = spark.sparkContext.broadcast(fixed | {"low": anyhow[0], "high": anyhow[1], "same": True, "depth": positives})
        first = materialize(_scan(rows, d, sent, ("anchor_id", "positive_id")).where(F.col("rank") <= positives).select("anchor_id", (F.col("rank") - 1).alias("place"), "positive_id", F.col("score").alias("positive_score")))
        # windows of the block's positives: anchors * positives pairs of longs
        low, high = np.full((len(ids), positives), np.iinfo(np.int64).max), np.full((len(ids), positives), _LOWEST)
        known = first.where("positive_score >= 0").select("anchor_id", "place", "positive_score").toArrow()
        at, place, score = np.searchsorted(ids, np.array(known["anchor_id"], np.int64)), np.array(known["place"], np.int64), np.array(known["positive_score"], np.int64)
        high[at, place] = score
        low[at, place] = [-(-LEAST_PERCENT * s // 100) for s in score.tolist()]
        again = spark.sparkContext.broadcast(fixed | {"low": low, "high": high, "same": False, "depth": negatives})
        second = _scan(rows, d, again, ("anchor_id", "negative_id")).where(F.col("rank") <= negatives)
        parts.append(materialize(first.join(second, ["anchor_id", "place"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", F.col("score").alias("negative_score"))))
        drop_table(first)
        sent.destroy()
        again.destroy()
    drop_table(anchors)
    out = parts[0] if parts else spark.createDataFrame([], schema)
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
