"""Maximum inner product search with score-aware (anisotropic) quantisation.

A coarse partition of the vectors' directions and 4-bit codebooks of one dimension each are fitted on a bounded sample.
The loss weighs the part of a residual that is parallel to its vector ``ETA`` times as much as the rest, since that part
moves large inner products. Every direction u is encoded, and with it go its length and the two parts of its code's error
e: a = e.u and b, the length of the rest. A query q of length 1 builds its tables once and scans the codes of the cells it
probes two codes a byte; the best ``RERANK`` of each block are scored on the original vectors in double precision. For
a score s = q.u and a scanned score t, s (1 - a) <= t + b sqrt(1 - s^2): whatever this does not part from the k best so
far is scored as well. So no vector is missed, however they are spread; codes that fit badly only cost more scores.

Cells are cut into blocks of about ``BLOCK`` vectors and queries into blocks of ``QUERY_BLOCK``, so a cell with a third
of all vectors is many tasks. Equal vectors in a block are scanned once and give their least ids. How many cells a query
probes first is measured on the sample: the fewest that keep ``CELL_RECALL`` of its true neighbours (without clusters:
all). A second scan takes the cells whose widest angle and lengths could still hold one of its k best.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from calltide.llm.common import bound_batches, materialize

#: Vectors of the fitting sample, by least hash of the id: some MB on the driver.
SAMPLE = 16_384
#: Vectors a cell, as long as the sample has eight for each cell; beyond that cells are larger and are cut into more blocks.
CELL_VECTORS = 16_384
CENTRES = 16
SUBSPACE = 1
#: Weight of parallel against orthogonal residual error, (d - 1) t^2 / (1 - t^2) at the threshold t.
SCORE_THRESHOLD = 0.2
SWEEPS = 2
BLOCK = 16_384
QUERY_BLOCK = 4096
RERANK = 200
#: What rounding may add to angles and, by terms of a sum, to scanned scores.
ANGLE_SLACK = 1e-6
TERM_SLACK = 2.0**-22
CELL_RECALL = 0.99


@dataclass
class Quantiser:
    cells: np.ndarray  # cells x d
    codebooks: np.ndarray  # subspaces x CENTRES x SUBSPACE
    probes: int

    @property
    def width(self) -> int:
        """Dimensions after padding to an even number of subspaces."""
        return self.codebooks.shape[0] * SUBSPACE

    def padded(self, x: np.ndarray) -> np.ndarray:
        return np.pad(x, ((0, 0), (0, self.width - x.shape[1])))

    def cell_of(self, x: np.ndarray) -> np.ndarray:
        return _nearest(x, self.cells)

    def encode(self, unit: np.ndarray, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of vectors of length 1: packed codes, two subspaces a byte, and the error's part along the vector and the length of its rest."""
        residual, padded = self.padded(unit - self.cells[cell]), self.padded(unit)
        codes = _assign(residual, padded, self.codebooks, _eta(unit.shape[1]), SWEEPS)
        error = residual - self.codebooks[np.arange(len(self.codebooks)), codes].reshape(residual.shape)
        along = (error * padded).sum(axis=1)
        across = np.linalg.norm(error - along[:, None] * padded, axis=1)
        return codes[:, 0::2] | codes[:, 1::2] << 4, along, across

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """queries x bytes x 256: what a byte of codes adds to the inner product."""
        parts = self.padded(queries).reshape(len(queries), -1, SUBSPACE)
        each = np.einsum("qsd,scd->qsc", parts, self.codebooks).astype(np.float32)
        return (each[:, 1::2, :, None] + each[:, 0::2, None, :]).reshape(len(queries), -1, CENTRES * CENTRES)


def _unit(x: np.ndarray) -> np.ndarray:
    return _polar(x)[0]


def _polar(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Directions and lengths; components are scaled first, so that no square leaves the range of doubles."""
    largest = np.abs(x).max(axis=1, initial=0.0, keepdims=True)
    scaled = x / np.where(largest > 0, largest, 1.0)
    length = np.linalg.norm(scaled, axis=1, keepdims=True)
    return scaled / np.where(length > 0, length, 1.0), (length * largest)[:, 0]


def _eta(d: int) -> float:
    return max(1.0, (d - 1) * SCORE_THRESHOLD**2 / (1 - SCORE_THRESHOLD**2))


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), np.int64)
    bias = (centres**2).sum(axis=1) / 2
    for a in range(0, len(x), 4096):
        out[a : a + 4096] = (x[a : a + 4096] @ centres.T - bias).argmax(axis=1)
    return out


def _k_means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        at = _nearest(x, centres)
        n = np.bincount(at, minlength=k)
        for d in range(x.shape[1]):
            sums = np.bincount(at, x[:, d], k)
            centres[:, d] = np.where(n > 0, sums / np.maximum(n, 1), centres[:, d])
    return centres


def _assign(residual: np.ndarray, unit: np.ndarray, books: np.ndarray, eta: float, sweeps: int) -> np.ndarray:
    """Codes that lower |e|^2 + (eta - 1)(e . unit)^2, by coordinate descent over the subspaces from the plain ones."""
    n, s = len(residual), len(books)
    r, u = residual.reshape(n, s, SUBSPACE), unit.reshape(n, s, SUBSPACE)
    codes = np.empty((n, s), np.uint8)
    along = np.empty((n, s))
    for k in range(s):
        codes[:, k] = _nearest(r[:, k], books[k])
        along[:, k] = ((r[:, k] - books[k][codes[:, k]]) * u[:, k]).sum(axis=1)
    total = along.sum(axis=1)
    for _ in range(sweeps):
        for k in range(s):
            error = r[:, k, None, :] - books[k][None]
            toward = np.einsum("ncd,nd->nc", error, u[:, k])
            cost = (error**2).sum(axis=2) + (eta - 1) * ((total - along[:, k])[:, None] + toward) ** 2
            codes[:, k] = cost.argmin(axis=1)
            now = np.take_along_axis(toward, codes[:, k, None].astype(np.int64), 1)[:, 0]
            total += now - along[:, k]
            along[:, k] = now
    return codes


def _fit_books(residual: np.ndarray, unit: np.ndarray, eta: float, rng: np.random.Generator, rounds: int = 4) -> np.ndarray:
    """Codebooks by alternating score-aware assignment and, per centre, the weighted least-squares solution."""
    n, s = len(residual), residual.shape[1] // SUBSPACE
    r, u = residual.reshape(n, s, SUBSPACE), unit.reshape(n, s, SUBSPACE)
    books = np.stack([_k_means(r[:, k], CENTRES, rng, 8) for k in range(s)])
    for _ in range(rounds):
        codes = _assign(residual, unit, books, eta, 1)
        along = np.stack([((r[:, k] - books[k][codes[:, k]]) * u[:, k]).sum(axis=1) for k in range(s)], axis=1)
        total = along.sum(axis=1)
        for k in range(s):
            rest = total - along[:, k]
            for c in range(CENTRES):
                own = codes[:, k] == c
                if own.sum() < SUBSPACE:
                    continue
                uc, rc = u[own, k], r[own, k]
                left = own.sum() * np.eye(SUBSPACE) + (eta - 1) * uc.T @ uc
                right = rc.sum(axis=0) + (eta - 1) * uc.T @ (rest[own] + (rc * uc).sum(axis=1))
                books[k, c] = np.linalg.solve(left, right)
            now = ((r[:, k] - books[k][codes[:, k]]) * u[:, k]).sum(axis=1)
            total += now - along[:, k]
            along[:, k] = now
    return books


def fit(sample: np.ndarray, vectors: int, k: int, seed: int = 5) -> Quantiser:
    """A quantiser for about ``vectors`` vectors from a sample of them; deterministic."""
    rng = np.random.default_rng(seed)
    d = sample.shape[1]
    sample, length = _polar(sample)
    cells = _k_means(sample, int(np.clip(vectors // CELL_VECTORS, 1, max(1, len(sample) // 8))), rng)
    at = _nearest(sample, cells)
    width = -(-d // (2 * SUBSPACE)) * 2 * SUBSPACE
    pad = lambda x: np.pad(x, ((0, 0), (0, width - d)))
    books = _fit_books(pad(sample - cells[at]), pad(sample), _eta(d), rng)
    queries = sample[:: max(1, len(sample) // 256)]
    best = np.argsort(-(queries @ sample.T) * (length / length.max()), axis=1, kind="stable")[:, : k + 1]
    order = np.argsort(-(queries @ cells.T), axis=1, kind="stable")
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(len(cells))[None, :], 1)
    needed = np.take_along_axis(rank, at[best], 1)
    recall = [(needed < p).mean() for p in range(1, len(cells) + 1)]
    return Quantiser(cells, books, next((p + 1 for p, x in enumerate(recall) if x >= CELL_RECALL), len(cells)))


def _usable(df: DataFrame, vector: str) -> Column:
    c = F.col(vector).cast("array<double>")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return c.isNotNull() & F.forall(c, finite) & F.exists(c, lambda x: x != 0)


def _block_result(base: pd.DataFrame, queries: pd.DataFrame, model: Quantiser, k: int) -> pd.DataFrame:
    """The k best of one block for each query, without those below the query's ``floor``."""
    vectors = np.frombuffer(b"".join(base["vector"]), "<f8").reshape(len(base), -1)
    ids = base["vec_id"].to_numpy(np.int64)
    codes = np.frombuffer(b"".join(base["codes"]), np.uint8).reshape(len(base), -1)
    order = np.argsort(ids, kind="stable")
    as_bytes = np.ascontiguousarray(vectors[order]).view(np.dtype((np.void, vectors.shape[1] * 8)))[:, 0]
    _, first, which = np.unique(as_bytes, return_index=True, return_inverse=True)
    distinct, codes = vectors[order][first], np.ascontiguousarray(codes[order][first].T)
    length, along, across = (base[c].to_numpy(float)[order][first] for c in ("length", "along", "across"))
    by_vector = np.argsort(which, kind="stable")  # ids of equal vectors in rising order
    by_vector = by_vector[np.append(True, np.diff(which[by_vector]) | np.diff(ids[order][by_vector]) != 0)]  # an id once
    begin, sorted_ids = np.searchsorted(which[by_vector], np.arange(len(first) + 1)), ids[order][by_vector]
    offset = model.cells[int(base["cell"].iloc[0])]
    # single precision: the terms of a scan add up to at most the length of what the codes stand for
    slack = TERM_SLACK * (len(codes) + 2) * (2 + np.linalg.norm(offset) + np.abs(along) + across)
    out: list[pd.DataFrame] = []
    asked = np.frombuffer(b"".join(queries["vector"]), "<f8").reshape(len(queries), -1)
    directions, lengths = _polar(asked)
    for a in range(0, len(asked), 64):
        tables = model.tables(directions[a : a + 64])
        for i, table in enumerate(tables, a):
            query, q = int(queries["vec_id"].iloc[i]), asked[i]
            approximate = np.full(len(distinct), float(directions[i] @ offset), np.float32)
            for j in range(len(codes)):
                approximate += table[j].take(codes[j])
            take = min(RERANK, len(distinct))
            near = np.argpartition(-approximate * length, take - 1)[:take]
            score = (distinct[near] * q).sum(axis=1)
            if take < len(distinct):
                # the least cosine with which a vector of this length would be among the best, and whether its code allows that
                floor = max(np.partition(score, max(0, take - k - 1))[max(0, take - k - 1)], queries["floor"].iloc[i])
                with np.errstate(over="ignore"):
                    least = floor / lengths[i] / length
                wide = np.sqrt(np.clip(1 - np.maximum(least, 0) ** 2, 0, 1))
                open_ = (least <= 1 + slack) & ((along >= 1) | (least * (1 - along) <= approximate + across * wide + slack))
                open_[near] = False
                more = np.flatnonzero(open_)
                near = np.concatenate([near, more])
                score = np.concatenate([score, (distinct[more] * q).sum(axis=1)])
            ranked = np.argsort(-score, kind="stable")
            # enough of the best vectors to fill k places besides the query's own, and all that tie with the last
            size = np.cumsum(begin[near[ranked] + 1] - begin[near[ranked]])
            last = min(int(np.searchsorted(size, k + 1)), len(ranked) - 1)
            ranked = ranked[score[ranked] >= max(score[ranked[last]], queries["floor"].iloc[i])]
            if not len(ranked):
                continue
            members = [m[m != query][:k] for m in (sorted_ids[begin[x] : begin[x + 1]] for x in near[ranked])]
            found, scores = np.concatenate(members), np.repeat(score[ranked], [len(m) for m in members])
            top = np.lexsort((found, -scores))[:k]
            out.append(pd.DataFrame({"query_id": query, "vec_id": found[top], "score": scores[top]}))
    return pd.concat(out, ignore_index=True) if out else pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})


def search(base: DataFrame, is_query: Column, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank from 1, vec_id, score): of each query row's other vectors the k of largest inner product.

    Ties go to the smaller id. Vectors that are null, zero, of another length than most, or that hold a null or
    non-finite component take no part, nor do null ids; an id that repeats with one vector counts once.
    """
    spark = base.sparkSession
    bound_batches(spark)
    rows = base.where(F.col(vec_id).isNotNull() & _usable(base, vector)).select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"), is_query.alias("is_query"))
    lengths = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    schema = "query_id long, rank int, vec_id long, score double"
    if not lengths:
        return spark.createDataFrame([], schema)
    d, n = lengths[0].d, lengths[0]["count"]
    rows = rows.where(F.size("vector") == d)
    sample = np.array([r.vector for r in rows.orderBy(F.xxhash64(F.lit("ann"), "vec_id"), "vec_id").limit(SAMPLE).select("vector").collect()])
    model = fit(sample, n, k)
    shared = spark.sparkContext.broadcast(model)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quantiser = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, d)
            unit, length = _polar(x)
            cell = quantiser.cell_of(unit)
            codes, along, across = quantiser.encode(unit, cell)
            near = np.argsort(-(unit @ quantiser.cells.T), axis=1, kind="stable")[:, : quantiser.probes].astype(np.int32)
            angle = _angles(unit, quantiser.cells[cell])
            asks = batch.column("is_query").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id"), pa.array(cell.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array([v.astype("<f8").tobytes() for v in x], pa.binary()),
                    pa.array([p.tolist() if q else None for p, q in zip(near, asks, strict=True)], pa.list_(pa.int32())),
                    pa.array(length), pa.array(along), pa.array(across), pa.array(angle),
                ],
                ["vec_id", "cell", "codes", "vector", "probes", *facts],
            )

    facts = ["length", "along", "across", "angle"]
    encoded = materialize(rows.mapInArrow(encode, "vec_id long, cell int, codes binary, vector binary, probes array<int>, " + ", ".join(f"{c} double" for c in facts)))
    queries = encoded.where("probes IS NOT NULL").groupBy("vec_id").agg(F.min(F.struct("vector", "probes")).alias("q")).select("vec_id", "q.*")
    probed = queries.select("vec_id", "vector", F.lit(float("-inf")).alias("floor"), F.explode("probes").alias("cell"))
    in_cell = {r.cell: r for r in encoded.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("angle"), F.min("length").alias("least"), F.max("length").alias("most")).collect()}
    found = _scan(encoded, probed, {c: r.n for c, r in in_cell.items()}, shared, k)
    ranked = _best(found, k)
    if model.probes < len(model.cells):
        ranked = materialize(ranked)
        floors = ranked.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("floor"))
        bounds = spark.sparkContext.broadcast([(c, r.angle, r.least, r.most) for c, r in in_cell.items()])

        def beyond(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            centres = shared.value.cells
            at, angle, least, most = (np.array(x) for x in zip(*bounds.value, strict=True))
            for batch in batches:
                if not batch.num_rows:
                    continue
                unit, length = _polar(np.frombuffer(b"".join(batch.column("vector").to_pylist()), "<f8").reshape(batch.num_rows, d))
                apart = np.stack([_angles(unit, np.broadcast_to(centres[c], unit.shape)) for c in at], axis=1)
                cosine = np.cos(np.clip(apart - angle - ANGLE_SLACK, 0, np.pi))
                highest = np.where(cosine > 0, most, least) * cosine * length[:, None]
                floor = batch.column("floor").to_numpy(zero_copy_only=False)
                could = highest * (1 + np.sign(highest) * ANGLE_SLACK) >= floor[:, None]
                cells = [[int(c) for c in at[row] if c not in p] for row, p in zip(could, batch.column("probes").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("vector"), batch.column("floor"), pa.array(cells, pa.list_(pa.int32()))], ["vec_id", "vector", "floor", "cells"])

        floored = queries.join(floors, "vec_id", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
        rest = materialize(floored.mapInArrow(beyond, "vec_id long, vector binary, floor double, cells array<int>").select("vec_id", "vector", "floor", F.explode("cells").alias("cell")))
        found = _scan(encoded, rest, {c: r.n for c, r in in_cell.items()}, shared, k)
        ranked = _best(ranked.drop("rank").unionByName(found), k)
    return ranked


def _angles(unit: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The angles between vectors of length 1 and centres, row by row; a centre of length 0 has no direction, and pi is said."""
    towards, length = _polar(centres)
    return np.where(length > 0, np.arccos(np.clip((unit * towards).sum(axis=1), -1, 1)), np.pi)


def _best(found: DataFrame, k: int) -> DataFrame:
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _scan(encoded: DataFrame, probed: DataFrame, in_cell: dict[int, int], shared: Broadcast, k: int) -> DataFrame:
    """(query_id, vec_id, score): the k best of every block of the cells that ``probed`` (vec_id, vector, floor, cell) asks for."""
    asked = {r.cell: r["count"] for r in probed.groupBy("cell").count().collect()}
    cells = range(len(shared.value.cells))
    blocks = F.array(*(F.lit(-(-in_cell.get(c, 0) // BLOCK) or 1) for c in cells))
    askers = F.array(*(F.lit(-(-asked.get(c, 0) // QUERY_BLOCK) or 1) for c in cells))
    part = lambda total: F.pmod(F.xxhash64("vec_id"), total).cast("int")
    every = lambda total: F.explode(F.sequence(F.lit(0), total - 1))
    left = encoded.where(F.get(F.array(*(F.lit(c in asked) for c in cells)), F.col("cell"))).select("vec_id", "cell", "codes", "vector", "length", "along", "across", part(F.get(blocks, F.col("cell"))).alias("block"), every(F.get(askers, F.col("cell"))).alias("asker"))
    right = probed.select("vec_id", "cell", "vector", "floor", part(F.get(askers, F.col("cell"))).alias("asker"), every(F.get(blocks, F.col("cell"))).alias("block"))
    keys = ["cell", "block", "asker"]
    tasks = max(1, min(20_000, sum((-(-in_cell.get(c, 0) // BLOCK) or 1) * (-(-asked.get(c, 0) // QUERY_BLOCK) or 1) for c in cells)))

    def run(base_rows: pd.DataFrame, query_rows: pd.DataFrame) -> pd.DataFrame:
        if base_rows.empty or query_rows.empty:
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        return _block_result(base_rows, query_rows, shared.value, k)

    return left.repartition(tasks, *keys).groupBy(*keys).cogroup(right.repartition(tasks, *keys).groupBy(*keys)).applyInPandas(run, "query_id long, vec_id long, score double")
