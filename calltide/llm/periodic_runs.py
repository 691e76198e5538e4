"""Periodic runs of words: stretches that repeat with a period, found by Stoye and Gusfield's traversal of a suffix tree.

The suffix tree is held as the intervals of a suffix array: suffixes that share their first words are sorted by doubling,
the depths between neighbours follow from the ranks of every doubling, and a pass with a stack gives the inner nodes. For
a node of depth D all leaves but those of its largest child are visited (the smaller halves: n log n of them in all); a
leaf i whose partner i + D or i - D hangs below the node as well starts or ends a tandem repeat, and a branching one where
the next words differ. Each branching repeat is rotated to the left as far as it goes, which gives a maximal run; repeats
of repeats, which end where a shorter period does, are merged into the run of the smallest period.

Only runs of ``min_length`` words or more are asked for, so nodes above the depth ``min_length // 4 + 1`` are never made:
a run of so many words and a period below that depth has a multiple of its period between the depth and half its length,
which gives the run away, and its own period is read off that repeat. In ordinary prose hardly any suffix is left.

Texts are independent rows; a task holds one text's arrays at a time, some 4 bytes a word for each doubling of the longest
repeat in it (100 MB for a text that is one run of a million words).
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from calltide.functions.text import let
from calltide.llm.common import bound_batches

MIN_LENGTH = 12
#: A word, for the JVM; in Python bytes.split() cuts at the same six characters.
WORD = r"[^\x20\x09-\x0D]+"
#: Leaves that are visited at once.
VISIT = 1 << 20

_RUN = T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("period", T.LongType())])


def word_ids(words: list[bytes]) -> np.ndarray:
    """Numbers from 0 by first occurrence."""
    numbers: defaultdict[bytes, int] = defaultdict()
    numbers.default_factory = numbers.__len__
    return np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))


def _windows(symbols: np.ndarray, width: int) -> np.ndarray:
    """A number for each window of ``width`` symbols, which sort as the windows do."""
    out, have, bound = symbols, 1, int(symbols.max()) + 1
    while have < width:
        step = min(have, width - have)
        if bound >= 1 << 31:
            out = np.unique(out, return_inverse=True)[1].astype(np.int64)
            bound = int(out.max()) + 1
        out = out[:-step] * bound + out[step:]
        bound, have = bound * bound, have + step
    return out


def _sorted_suffixes(symbols: np.ndarray, floor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(order, rank, at, depth): the suffix array, its inverse, and the places ``at`` in it of the suffixes whose first
    ``floor`` symbols occur elsewhere, with the symbols each shares with the one before (0 where fewer than ``floor``).

    The order holds among those suffixes and between them and others; others share no ``floor`` symbols with any.
    """
    n = len(symbols)
    padded = np.concatenate([symbols + 1, np.zeros(floor, np.int64)])
    keys = _windows(padded, floor)
    order = np.argsort(keys, kind="stable")
    fresh = np.append(True, np.diff(keys[order]) != 0)
    if fresh.all():
        return order, np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    first = np.flatnonzero(fresh)
    sizes = np.diff(np.append(first, n + 1))
    rank = np.empty(n + 1, np.int32 if n < 1 << 30 else np.int64)
    rank[order] = np.repeat(first, sizes)
    at = np.flatnonzero(np.repeat(sizes > 1, sizes))
    levels, h, open_ = [rank], floor, at
    while len(open_):
        pos = order[open_]
        key = rank[pos].astype(np.int64) * (n + 1) + rank[pos + h]
        by = np.argsort(key, kind="stable")
        order[open_] = pos[by]
        fresh = np.append(True, np.diff(key[by]) != 0)
        rank = rank.copy()
        rank[order[open_]] = np.maximum.accumulate(np.where(fresh, open_, 0))
        levels.append(rank)
        open_ = open_[~(fresh & np.append(fresh[1:], True))]
        h *= 2
    a, b = order[at - 1], order[at]
    depth = np.zeros(len(at), np.int64)
    same = np.flatnonzero(levels[0][a] == levels[0][b])
    for k in range(len(levels) - 1, -1, -1):
        x, y = a[same] + depth[same], b[same] + depth[same]
        depth[same[levels[k][x] == levels[k][y]]] += floor << k
    for _ in range(floor - 1):
        same = same[padded[a[same] + depth[same]] == padded[b[same] + depth[same]]]
        depth[same] += 1
    return order, rank, at, depth


def _inner_nodes(at: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """Rows (depth, first, last, first and last of the largest child) of the inner nodes, places in the suffix array."""
    out: list[tuple[int, int, int, int, int]] = []
    stack = [[0, -1, -1, -1]]
    places, depths = at.tolist(), [*depth.tolist()[1:], 0]
    for place, shared in zip(places, depths, strict=True):
        lo, hi = place, place  # the child that ends here: first a leaf
        while stack[-1][0] >= shared:
            top = stack[-1]
            if hi - lo > top[3] - top[2]:
                top[2], top[3] = lo, hi
            if top[0] == shared:
                break
            stack.pop()
            out.append((top[0], top[1], place, top[2], top[3]))
            lo, hi = top[1], place
        else:
            stack.append([shared, lo, lo, hi])
    return np.array(out, np.int64).reshape(-1, 5)


def branching_repeats(symbols: np.ndarray, floor: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, half) of the tandem repeats of halves of ``floor`` symbols or more that go no further to the right."""
    none = np.empty(0, np.int64)
    if len(symbols) < 2 * floor:
        return none, none
    order, rank, at, depth = _sorted_suffixes(symbols, floor)
    if not len(at):
        return none, none
    n, ended = len(symbols), np.append(symbols, -1)
    nodes = _inner_nodes(at, depth)
    nodes = nodes[2 * nodes[:, 0] <= n]
    # the leaves of a node on either side of its largest child
    parts = np.concatenate([nodes[:, [0, 1, 2, 1, 3]], nodes[:, [0, 1, 2, 4, 2]]])
    parts[: len(nodes), 4] = nodes[:, 3] - 1
    parts[len(nodes) :, 3] += 1
    parts = parts[parts[:, 4] >= parts[:, 3]]
    counts = parts[:, 4] - parts[:, 3] + 1
    total = np.cumsum(counts)
    starts, halves, done = [none], [none], 0
    while done < len(parts):
        upto = max(done + 1, int(np.searchsorted(total, (total[done - 1] if done else 0) + VISIT, side="right")))
        some, each = parts[done:upto], counts[done:upto]
        half, lo, hi = (np.repeat(some[:, k], each) for k in range(3))
        leaf = order[np.arange(each.sum()) + np.repeat(some[:, 3] - (np.cumsum(each) - each), each)]
        for i in (leaf, leaf - half):
            fits = np.flatnonzero((i >= 0) & (i + 2 * half <= n))
            i, d = i[fits], half[fits]
            both = (rank[i] >= lo[fits]) & (rank[i] <= hi[fits]) & (rank[i + d] >= lo[fits]) & (rank[i + d] <= hi[fits])
            i, d = i[both], d[both]
            ends = ended[i + d] != ended[i + 2 * d]
            starts.append(i[ends])
            halves.append(d[ends])
        done = upto
    return np.concatenate(starts), np.concatenate(halves)


def _rotated(symbols: np.ndarray, start: int, period: int) -> int:
    """The least start to which a repeat can be rotated."""
    width = 64
    while start:
        a = max(0, start - width)
        apart = np.flatnonzero(symbols[a:start] != symbols[a + period : start + period])
        if len(apart):
            return a + int(apart[-1]) + 1
        start, width = a, width * 2
    return 0


def find_runs(symbols: np.ndarray, min_length: int = MIN_LENGTH) -> list[tuple[int, int, int]]:
    """(start, length, smallest period) of all maximal runs of at least ``min_length`` symbols and two periods, in order."""
    floor = min_length // 4 + 1
    starts, halves = branching_repeats(symbols, floor)
    ends = starts + 2 * halves
    out, kept, last = [], [], -1
    for k in np.lexsort((halves, ends)).tolist():
        start, half, end = int(starts[k]), int(halves[k]), int(ends[k])
        if end != last:
            kept, last = [], end
        if any(half % period == 0 and begin <= start for begin, period in kept):
            continue  # a repeat of a repeat, or the same one from its other leaf
        word = symbols[start : start + half]
        period = next((p for p in range(1, min(floor, half)) if half % p == 0 and np.array_equal(word[p:], word[:-p])), half)
        begin = _rotated(symbols, start, period)
        kept.append((begin, period))
        if end - begin >= max(min_length, 2 * period):
            out.append((begin, end - begin, period))
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by blanks, without those of a run that follow its first period."""
    if not runs:
        return b" ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return b" ".join([words[k] for k in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()])


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_length: int = MIN_LENGTH) -> DataFrame:
    """(doc_id, n_words, runs array<struct<start, length, period>>, collapsed) of every row of ``docs``.

    Words are stretches without the characters 0x20 and 0x09 to 0x0D, numbered from 0; equal words are equal texts. ``runs``
    are sorted by start, then period; ``collapsed`` are the words that no run holds after its first period, joined by one
    blank. A null or empty text has no words, no runs and an empty ``collapsed``. Rows are independent of each other: repeated
    ones give equal results, ids may be null or of any type, and other columns of ``docs`` are not looked at.
    """
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    schema = T.StructType([rows.schema["doc_id"], T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(_RUN)), T.StructField("collapsed", T.StringType())])
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, found, left = [], [], []
            for value in batch.column("text"):
                words = (value.as_py() or "").encode("utf-8", "surrogatepass").split()
                runs = find_runs(word_ids(words), min_length) if len(words) >= min_length else []
                n_words.append(len(words))
                found.append([{"start": s, "length": n, "period": p} for s, n, p in runs])
                left.append(collapse(words, runs).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(found, kind), pa.array(left, pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    return rows.mapInArrow(run, schema)


def plant(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text) with a run in about one text of ten, by the crc32 h of the id's decimal text (null: empty text).

    Where h % 10 = 0 each word i from a = g % n on becomes the word a + (i - a) % p of the original, g = h div 10 and
    p = 1 + (n - a) div (3 + g % 8); the words are joined by blanks. All other texts stay as they are.
    """
    h = F.crc32(F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("")).cast("binary"))
    g = F.floor(h / 10)

    def periodic(words: Column) -> Column:
        n = F.size(words)
        at = lambda a, p: F.transform(words, lambda w, i: F.get(words, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")))
        return let(g % n, lambda a: let(1 + F.floor((n - a) / (3 + g % 8)), lambda p: at(a, p)))

    words = F.regexp_extract_all(F.col(f"`{text}`"), F.lit(WORD), F.lit(0))
    planted = let(words, lambda w: F.when(F.size(w) > 0, F.array_join(periodic(w), " ")).otherwise(""))
    return docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.when(h % 10 == 0, planted).otherwise(F.col(f"`{text}`")).alias("text"))


def digest(found: DataFrame) -> DataFrame:
    """One row of numbers and hashes per row of ``find``: n_runs, the longest run (ties: least start, then period), sha256s."""
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    length, period = F.col("best.length"), -F.col("best.p")
    return found.withColumn("best", longest).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.s")).alias("start"), length.alias("length"), period.alias("period"),
        F.floor(length * 1000 / period).alias("exponent_milli"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
