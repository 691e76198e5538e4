"""Benchmark decontamination by a prefix-filtered join of exact word windows.

A benchmark item is cut into windows of ``WINDOW`` consecutive words. A window that occurs in a document has all its
word shingles there, so the window's rarest shingle is a sufficient prefix: the index holds one shingle per window, the
one that occurs least often in the corpus (counted over all documents). Documents are scanned for those shingles; a
match's position and the document's length bound where the window could lie, and the words are then compared.

The benchmark is hashed to words on the executors, in parts of at most ``PART_WORDS`` words, so an item of any length is
never whole anywhere. The index, flat arrays of some 21 bytes a word, is broadcast block by block, each of about
``BLOCK_WORDS`` words, so its size does not depend on the benchmark. Documents are never shuffled with their texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calltide.llm.common import bound_batches, drop_table, lean, materialize
from calltide.llm.textvec import U64, ascii_lower_words, mix, slices, span_hashes, utf8

WINDOW = 13
SHINGLE = 3
#: Words of the parts that items are cut into, and of a block of parts: an index of about 60 MB.
PART_WORDS = 100_000
BLOCK_WORDS = 3_000_000


def _words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of all words, index of each text's first word and the total)."""
    raw, offsets = utf8(texts)
    low, starts, ends, first = ascii_lower_words(raw, offsets)
    return span_hashes(low, starts, ends), first


def _shingles(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each position on (positions near the end of the array are left out)."""
    out = np.zeros(max(0, len(words) - n + 1), U64)
    for k in range(n):
        out = mix(out * U64(0x9E3779B97F4A7C15) + words[k : k + len(out)] + U64(n))
    return out


class Windows:
    """The windows of a block of benchmark parts, in flat arrays: the parts' words end to end, and where each window starts.

    A part of fewer words than a window is one window; longer items come in parts that overlap by a window less one word.
    """

    def __init__(self, ids: list[str | None], parts: list[np.ndarray], window: int):
        self.window = window
        self.names = sorted(set(ids), key=lambda i: (i is not None, i))
        number = {name: k for k, name in enumerate(self.names)}
        self.item = np.array([number[i] for i in ids], np.int32)
        self.words = np.concatenate(parts) if parts else np.zeros(0, U64)
        self.first = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
        self.length = np.minimum(np.diff(self.first), window)
        windows = np.where(self.length > 0, np.diff(self.first) - self.length + 1, 0)
        before = np.cumsum(windows) - windows
        part = np.repeat(np.arange(len(parts)), windows)
        self.start = self.first[:-1][part] + np.arange(len(part)) - before[part]
        self.part = part

    def shingle_sizes(self) -> np.ndarray:
        """The words of a shingle of each window."""
        return np.minimum(SHINGLE, self.length[self.part])

    def shingles(self) -> dict[int, np.ndarray]:
        """The distinct shingle hashes of the windows, sorted, by words of a shingle."""
        out, size = {}, np.diff(self.first)
        for n in np.unique(np.minimum(SHINGLE, size[size > 0])).tolist():
            own = np.flatnonzero(np.minimum(SHINGLE, size) == n)
            times = size[own] - n + 1
            places = np.repeat(self.first[own] - np.cumsum(times) + times, times) + np.arange(int(times.sum()))
            out[n] = np.unique(_shingles(self.words, n)[places])
        return out


class Index:
    """The prefix shingle of each window, sorted by shingle length: key, where the window starts, and the shingle's place in it."""

    def __init__(self, windows: Windows, counts: dict[int, tuple[np.ndarray, np.ndarray]]):
        """``counts``: sorted shingles of each length with how often the corpus has them."""
        self.words, self.first, self.window = windows.words, windows.first, windows.window
        self.item, self.names = windows.item, windows.names
        self.tables = {}
        sizes, lengths = windows.shingle_sizes(), windows.length[windows.part]
        for n, (keys, times) in counts.items():
            hashes = _shingles(windows.words, n)
            at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
            order = np.lexsort((keys, times))
            rank_of = np.empty(len(keys), np.int64)
            rank_of[order] = np.arange(len(keys))
            rank = np.where(keys[at] == hashes, rank_of[at], len(keys))
            starts, places = [], []
            for length in np.unique(lengths[sizes == n]).tolist():
                own = windows.start[(sizes == n) & (lengths == length)]
                views = np.lib.stride_tricks.sliding_window_view(rank, length - n + 1)
                for a in range(0, len(own), 1 << 18):
                    starts.append(own[a : a + (1 << 18)])
                    places.append(views[own[a : a + (1 << 18)]].argmin(axis=1))
            start, place = np.concatenate(starts), np.concatenate(places)
            key = hashes[start + place]
            order = np.argsort(key, kind="stable")
            self.tables[n] = (key[order], start[order].astype(np.uint32), place[order].astype(np.uint8), _bits(key))

    def occurrences(self, words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, number of the item) of every occurrence in the concatenated words, inside one document each."""
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for n, (keys, start, place, bits) in self.tables.items():
            shingles = _shingles(words, n)
            at = np.flatnonzero(_member(shingles, keys, bits))
            lo, hi = np.searchsorted(keys, shingles[at], "left"), np.searchsorted(keys, shingles[at], "right")
            times = hi - lo
            for a, b in slices(times, 1 << 18):
                entry = np.repeat(lo[a:b] - np.cumsum(times[a:b]) + times[a:b], times[a:b]) + np.arange(int(times[a:b].sum()))
                begin, there = np.repeat(at[a:b], times[a:b]) - place[entry], start[entry].astype(np.int64)
                part = np.searchsorted(self.first, there, side="right") - 1
                length = np.minimum(self.first[part + 1] - self.first[part], self.window)
                doc = np.searchsorted(first, np.repeat(at[a:b], times[a:b]), side="right") - 1
                fits = np.flatnonzero((begin >= first[doc]) & (begin + length <= first[doc + 1]))
                for size in np.unique(length[fits]).tolist():
                    own = fits[length[fits] == size]
                    span = np.arange(size)
                    equal = own[(words[begin[own][:, None] + span] == self.words[there[own][:, None] + span]).all(axis=1)]
                    found.append((begin[equal], begin[equal] + size, self.item[part[equal]].astype(np.int64)))
        if not found:
            return (np.zeros(0, np.int64),) * 3
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


_BITS = 22


def _bits(keys: np.ndarray) -> np.ndarray:
    """A table of the low bits that occur among the keys."""
    table = np.zeros(1 << _BITS, bool)
    table[(keys & U64((1 << _BITS) - 1)).astype(np.int64)] = True
    return table


def _member(values: np.ndarray, keys: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Whether each value is among the sorted keys: the table of low bits first, then the exact comparison."""
    maybe = np.flatnonzero(bits[(values & U64((1 << _BITS) - 1)).astype(np.int64)])
    at = np.minimum(np.searchsorted(keys, values[maybe]), len(keys) - 1)
    out = np.zeros(len(values), bool)
    out[maybe[keys[at] == values[maybe]]] = True
    return out


def _parts(benchmark: DataFrame, item: str, text: str, window: int) -> DataFrame:
    """(item, n, words binary): the word hashes of every item in parts that hold each window once; no words, no part."""
    size = PART_WORDS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, value in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words = _words([value or ""])[0]
                windows = max(1, len(words) - window + 1) if len(words) else 0
                parts = [words[a : min(a + size, windows) + window - 1] for a in range(0, windows, size)]
                if parts:
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(parts), pa.string()), pa.array([len(p) for p in parts], pa.int64()), pa.array([p.tobytes() for p in parts], pa.binary())], ["item", "n", "words"])

    return benchmark.select(F.col(item).cast("string").alias("item"), F.col(text).alias("text")).mapInArrow(run, "item string, n long, words binary")


def _blocks(benchmark: DataFrame, item: str, text: str, window: int) -> Iterator[Windows]:
    """The windows of the benchmark, about BLOCK_WORDS words at a time."""
    parts = _parts(benchmark, item, text, window)
    total = parts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    blocks = -(-total // BLOCK_WORDS)
    parts = materialize(parts) if blocks > 1 else parts
    for k in range(blocks):
        got = parts.where(F.pmod(F.xxhash64("words"), F.lit(blocks)) == k).select("item", "words").toArrow()
        ids, held = got.column("item").to_pylist(), got.column("words").to_pylist()
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i], held[i]))
        yield Windows([ids[i] for i in order], [np.frombuffer(held[i], U64) for i in order], window)
    if blocks > 1:
        drop_table(parts)


def _count(docs: DataFrame, windows: Windows) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """The shingles of the windows by their length, sorted, and how often each occurs in the corpus."""
    wanted = windows.shingles()
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = {n: np.zeros(len(keys), np.int64) for n, keys in shared.value.items()}
        bits = {n: _bits(keys) for n, keys in shared.value.items()}
        for batch in batches:
            for words, first in _batch_words(batch):
                doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
                for n, keys in shared.value.items():
                    shingles = _shingles(words, n)
                    inside = doc[: len(shingles)] == doc[n - 1 :]
                    hit = shingles[inside & _member(shingles, keys, bits[n])]
                    counts[n] += np.bincount(np.searchsorted(keys, hit), minlength=len(keys))
        for n, held in counts.items():
            at = np.flatnonzero(held)
            for a in range(0, len(at), 1 << 16):
                some = at[a : a + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), n), pa.int32()), pa.array(some, pa.int64()), pa.array(held[some], pa.int64())], ["size", "place", "n"])

    got = docs.mapInArrow(lean(run), "size int, place long, n long").groupBy("size", "place").agg(F.sum("n").alias("n")).toArrow()
    sizes, places, times = (got.column(c).to_numpy() for c in ("size", "place", "n"))
    out = {}
    for n, keys in wanted.items():
        own = np.zeros(len(keys), np.int64)
        own[places[sizes == n]] = times[sizes == n]
        out[n] = (keys, own)
    return out


def _batch_words(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    texts = [t or "" for t in batch.column("__text").to_pylist()]
    for i, j in slices(np.array([len(t) for t in texts], np.int64)):
        yield _words(texts[i:j])


def _merged(ranges: list[tuple[int, int]]) -> list[dict]:
    out: list[dict] = []
    for s, e in sorted(ranges):
        if out and s <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], e)
        else:
            out.append({"start": s, "end": e})
    return out


_RANGES = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _scan(docs: DataFrame, index: Index) -> DataFrame:
    """Add an index's hits to the columns __n_words, __ranges and __items of each document; the text column comes last."""
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            before_ranges, before_items = batch.column("__ranges").to_pylist(), batch.column("__items").to_pylist()
            n_words: list[int] = []
            ranges: list[list[dict]] = []
            items: list[list[str]] = []
            for words, first in _batch_words(batch):
                start, end, item = shared.value.occurrences(words, first)
                order = np.argsort(start, kind="stable")
                start, end, item = start[order], end[order], item[order]
                bounds = np.searchsorted(start, first)
                for k in range(len(first) - 1):
                    row, a, b = len(n_words), bounds[k], bounds[k + 1]
                    n_words.append(int(first[k + 1] - first[k]))
                    known = [(r["start"], r["end"]) for r in before_ranges[row]]
                    ranges.append(_merged(known + list(zip((start[a:b] - first[k]).tolist(), (end[a:b] - first[k]).tolist(), strict=True))) if b > a or known else [])
                    items.append(sorted({*before_items[row], *(shared.value.names[w] for w in set(item[a:b].tolist()))}, key=lambda i: (i is not None, i)))
            made = {"__n_words": pa.array(n_words, pa.int64()), "__ranges": pa.array(ranges, _RANGES), "__items": pa.array(items, pa.list_(pa.string()))}
            yield pa.RecordBatch.from_arrays([made[c] if c in made else batch.column(c) for c in batch.schema.names], batch.schema.names)

    return docs.mapInArrow(lean(run), docs.schema)


def _found(docs: DataFrame, benchmark: DataFrame, text: str, item: str, item_text: str, keep: tuple[str, ...], window: int) -> DataFrame:
    bound_batches(docs.sparkSession)
    no_hits = F.array().cast("array<struct<start: bigint, end: bigint>>")
    out = docs.select(*keep, F.lit(0).cast("long").alias("__n_words"), no_hits.alias("__ranges"), F.array().cast("array<string>").alias("__items"), F.col(text).alias("__text"))
    texts = docs.select(F.col(text).alias("__text"))
    for windows in _blocks(benchmark, item, item_text, window):
        out = _scan(out, Index(windows, _count(texts, windows)))
    return out.drop("__text")


def overlaps(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", keep: tuple[str, ...] = ("doc_id",), window: int = WINDOW) -> DataFrame:
    """``keep`` columns, n_words, ``ranges`` of hit words (disjoint, rising, end exclusive) and ``items``, one row per document.

    Words are runs of [0-9a-z] and characters beyond ASCII after lower-casing A-Z. Null texts have no words and
    no windows; equal items and repeated rows are each reported. An item with a null id hits words and counts as one item
    (all of them as the same), and has no id to be listed. Without documents or items the
    result is empty or has no hits.
    """
    found = _found(docs, benchmark, text, item, item_text, keep, window)
    return found.withColumnsRenamed({"__n_words": "n_words", "__ranges": "ranges", "__items": "items"})


def n_hit(ranges: str | Column = "ranges") -> Column:
    """Words in disjoint ranges."""
    return F.aggregate(ranges, F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["start"])


def contaminated(n_hit_: Column, n_words: Column) -> Column:
    return (n_hit_ > 0) & (n_hit_ * 20 >= n_words)


def report(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Per document: n_words, n_hit, n_items, items_sha256 and whether hits are a twentieth of the words or more."""
    found = overlaps(docs, benchmark, **options).withColumn("n_hit", n_hit())
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """The documents that are not contaminated, with their own columns, whatever those are called."""
    found = _found(docs, benchmark, text, item, item_text, tuple(docs.columns), window)
    return found.where(~contaminated(n_hit(F.col("__ranges")), F.col("__n_words"))).select(*docs.columns)
