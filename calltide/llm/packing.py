"""Best-fit packing of tokenised documents into sequences by a grouping genetic algorithm on islands.

Documents become pieces of at most ``capacity`` tokens; only (doc_id, piece, start, length, crc) rows travel from there
on, some 40 bytes each. Pieces are dealt by a hash of their row, whatever their id, into shards of about ``SHARD_PIECES``; a shard is packed on its own
and costs at most one part-filled sequence. Each shard has ``ISLANDS`` populations that evolve apart and pass their
elites round a ring after every round. A crossover puts whole well-filled bins of one parent into a copy of the other,
takes away the bins that hold the same pieces, and best-fits the displaced pieces.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calltide.llm.common import bound_batches, drop_table, lean, materialize, partitions
from calltide.llm.textvec import slices, text_column
from calltide.llm.wordbpe import word_bpe

CAPACITY = 4096
END_OF_DOCUMENT = 1
SHARD_PIECES = 4096
ISLANDS = 2
ROUNDS = 2
POPULATION = 4
GENERATIONS = 6
ELITES = 2
PIECE_FIELDS = "piece int, start long, length long, ids_crc32 long"


def tokenize_pieces(docs: DataFrame, tokenizer: str, text: str = "text", capacity: int = CAPACITY, with_ids: bool = False, doc_id: str = "doc_id") -> DataFrame:
    """One row per piece of each document: its ids and then id 1, cut every ``capacity`` ids.

    A null text is an empty one (its only token is id 1). Repeated rows give repeated pieces; ids may be of any type. ``with_ids`` adds the ids
    themselves (array<int>) for those who write the sequences out.
    """
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(tokenizer)
        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), text_column(batch, "text")
            for i, j in slices(np.array([len(t) for t in texts], np.int64)):
                ids, offsets = bpe.ids(texts[i:j])
                rows: list[tuple] = []
                for k in range(j - i):
                    own = np.append(ids[offsets[k] : offsets[k + 1]], np.uint32(END_OF_DOCUMENT)).astype("<u4")
                    for piece, start in enumerate(range(0, len(own), capacity)):
                        part = own[start : start + capacity]
                        rows.append((doc_ids[i + k], piece, start, len(part), zlib.crc32(part.tobytes()), *([part.astype(np.int32)] if with_ids else [])))
                kinds = [batch.column(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), *([pa.list_(pa.int32())] if with_ids else [])]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    chosen = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return chosen.mapInArrow(lean(run), f"doc_id {chosen.schema['doc_id'].dataType.simpleString()}, {PIECE_FIELDS}" + (", ids array<int>" if with_ids else ""))


# One shard, in arrays. A solution is an array that gives each piece's bin.


def best_fit(sizes: list[int], order: list[int], bins: np.ndarray, room: list[int], capacity: int) -> None:
    """Put the pieces of ``order`` into the fullest bin that takes each, or a new one; ``room`` is free space by bin."""
    free = sorted(r << 32 | b for b, r in enumerate(room) if r)
    for item in order:
        size = sizes[item]
        at = bisect_left(free, size << 32)
        if at < len(free):
            entry = free.pop(at)
            left, b = (entry >> 32) - size, entry & 0xFFFFFFFF
        else:
            left, b = capacity - size, len(room)
            room.append(0)
        bins[item] = b
        if left:
            insort(free, left << 32 | b)


def fitness(sizes: np.ndarray, bins: np.ndarray, capacity: int) -> tuple[int, float]:
    """Smaller is better: the number of bins, then minus the sum of squared fill."""
    fill = np.bincount(bins, sizes) / capacity
    return len(fill), -float((fill * fill).sum())


def compact(bins: np.ndarray) -> np.ndarray:
    return np.unique(bins, return_inverse=True)[1].astype(np.int32)


def founder(sizes: np.ndarray, capacity: int, noise: float, rng: np.random.Generator) -> np.ndarray:
    """Best fit in falling order of size, the sizes blurred by ``noise`` to make founders differ."""
    order = np.argsort(-sizes * rng.uniform(1 - noise, 1, len(sizes)), kind="stable")
    bins = np.zeros(len(sizes), np.int32)
    best_fit(sizes.tolist(), order.tolist(), bins, [], capacity)
    return bins


def crossover(sizes: np.ndarray, into: np.ndarray, donor: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """A copy of ``into`` with whole well-filled bins of ``donor``; what they displace is best-fitted, largest first.

    A few of the emptiest bins that stay are broken up as well, so that their pieces can fill the others.
    """
    fill = np.bincount(donor, sizes)
    good = fill >= np.quantile(fill, 0.5)
    good &= rng.random(len(fill)) < 0.5
    injected = good[donor]
    hit = np.zeros(into.max() + 1, bool)
    hit[into[injected]] = True
    load = np.bincount(into, sizes, len(hit))
    spare = np.flatnonzero(~hit)
    hit[spare[np.argsort(load[spare], kind="stable")[: max(1, len(spare) // 16)]]] = True
    loose = np.flatnonzero(hit[into] & ~injected)
    child = np.where(injected, donor + len(hit), into)
    child[loose] = -1
    kept = np.flatnonzero(child >= 0)
    child[kept] = compact(child[kept])
    room = (capacity - np.bincount(child[kept], sizes[kept])).astype(np.int64).tolist()
    order = loose[np.argsort(-sizes[loose], kind="stable")]
    best_fit(sizes.tolist(), order.tolist(), child, room, capacity)
    return child.astype(np.int32)


def evolve(sizes: np.ndarray, capacity: int, seed: int, migrants: list[np.ndarray]) -> list[np.ndarray]:
    """One round on one island; returns its elites, best first."""
    rng = np.random.default_rng(seed)
    least = -(-int(sizes.sum()) // capacity)
    people = [*migrants]
    for k in range(POPULATION - len(people)):
        people.append(founder(sizes, capacity, 0.0 if k == 0 and not migrants else 0.15 * (k + 1), rng))
    scored = sorted(((fitness(sizes, p, capacity), k, p) for k, p in enumerate(people)), key=lambda x: x[:2])
    for generation in range(GENERATIONS):
        if scored[0][0][0] <= least:
            break
        for _ in range(POPULATION // 2):
            a, b = rng.choice(len(scored), 2, replace=False)
            child = crossover(sizes, scored[min(a, b)][2], scored[max(a, b)][2], capacity, rng)
            scored.append((fitness(sizes, child, capacity), len(scored) + POPULATION * (generation + 1), child))
        scored = sorted(scored, key=lambda x: x[:2])[:POPULATION]
    return [p for _, _, p in scored[:ELITES]]


def _ordered(pdf: pd.DataFrame) -> pd.DataFrame:
    return pdf.sort_values("row", kind="stable", ignore_index=True)


def pack(pieces: DataFrame, capacity: int = CAPACITY, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Pieces with their sequence_id and offset; every piece is placed once and no sequence exceeds ``capacity``.

    Pieces that fill a sequence alone are one without further search. Null doc_ids, ties and repeated rows are pieces
    like any others, told apart by the number that each row gets as it is written; of no pieces comes an empty table.
    An ``ids`` column, where there is one, stays with its piece.
    """
    whole = materialize(pieces.withColumn("row", F.monotonically_increasing_id()))
    facts = ["doc_id", *(f.split(" ")[0] for f in PIECE_FIELDS.split(", "))]
    n = whole.count()
    shards = max(1, -(-n // shard_pieces))
    dealt = whole.select(*facts, "row").withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int"))
    tasks = partitions(shards * ISLANDS, 1)
    state_schema = "shard int, island int, elite int, bins binary"

    def state_of(shard: int, island: int, elites: list[np.ndarray]) -> pd.DataFrame:
        return pd.DataFrame({"shard": shard, "island": (island + 1) % ISLANDS, "elite": range(len(elites)), "bins": [e.astype("<i4").tobytes() for e in elites]}).astype({"shard": "int32", "island": "int32", "elite": "int32"})

    def settle(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        sizes = _ordered(pdf)["length"].to_numpy(np.int64)
        return state_of(int(key[0]), int(key[1]), evolve(sizes, capacity, int(key[0]) * 1009 + int(key[1]), []))

    def migrate(round_: int):
        def run(key: tuple, pdf: pd.DataFrame, came: pd.DataFrame) -> pd.DataFrame:
            sizes = _ordered(pdf)["length"].to_numpy(np.int64)
            migrants = [np.frombuffer(b, "<i4") for b in came.sort_values("elite")["bins"]]
            return state_of(int(key[0]), int(key[1]), evolve(sizes, capacity, int(key[0]) * 1009 + int(key[1]) + 500 * round_, migrants))

        return run

    def place(key: tuple, pdf: pd.DataFrame, came: pd.DataFrame) -> pd.DataFrame:
        pdf = _ordered(pdf)
        sizes = pdf["length"].to_numpy(np.int64)
        best = min((np.frombuffer(b, "<i4") for b in came.sort_values(["elite", "island"])["bins"]), key=lambda p: fitness(sizes, p, capacity))
        order = np.argsort(best, kind="stable")
        first = np.concatenate([[True], best[order][1:] != best[order][:-1]])
        before = np.cumsum(sizes[order]) - sizes[order]
        offset = np.empty(len(sizes), np.int64)
        offset[order] = before - before[np.maximum.accumulate(np.where(first, np.arange(len(first)), 0))]
        pdf["sequence_id"] = int(key[0]) * (1 << 32) + best.astype(np.int64)
        pdf["offset"] = offset
        return pdf.drop(columns=["shard"])

    small = dealt.where(F.col("length") < capacity)
    on_islands = small.withColumn("island", F.explode(F.array(*[F.lit(k) for k in range(ISLANDS)]))).repartition(tasks, "shard", "island")
    state = materialize(on_islands.groupBy("shard", "island").applyInPandas(settle, state_schema))
    for round_ in range(1, ROUNDS):
        before = state
        moved = state.repartition(tasks, "shard", "island").groupBy("shard", "island")
        state = materialize(on_islands.groupBy("shard", "island").cogroup(moved).applyInPandas(migrate(round_), state_schema))
        drop_table(before)
    placed_schema = f"doc_id {pieces.schema['doc_id'].dataType.simpleString()}, {PIECE_FIELDS}, row long, sequence_id long, offset long"
    placed = small.repartition(tasks, "shard").groupBy("shard").cogroup(state.repartition(tasks, "shard").groupBy("shard")).applyInPandas(place, placed_schema)
    full = dealt.where(F.col("length") >= capacity).drop("shard").withColumns({"sequence_id": -F.col("row") - 1, "offset": F.lit(0).cast("long")})
    out = placed.unionByName(full)
    if "ids" in whole.columns:
        out = out.join(whole.select("row", "ids"), "row")
    return out.drop("row")


def assemble_sequences(placed: DataFrame) -> DataFrame:
    """The packed sequences themselves, of packed pieces with ids: sequence_id and its ids in order, at most ``capacity`` of them."""
    return placed.groupBy("sequence_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])).alias("ids"))


def pack_documents(docs: DataFrame, tokenizer: str, text: str = "text", capacity: int = CAPACITY, doc_id: str = "doc_id") -> DataFrame:
    """Tokenise, cut and pack; see ``tokenize_pieces`` and ``pack``."""
    return pack(tokenize_pieces(docs, tokenizer, text, capacity, doc_id=doc_id), capacity)
