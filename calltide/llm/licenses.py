"""Licence scans: sparse TF-IDF cosine of headers and licence files to templates, then inheritance by directory.

A file's own licence is the best-matching template among its header segments (a line with a gate word, alone and
with up to five lines after it) and, for files named like one, its whole text. Document frequencies are counted over all
texts for the words of the templates; other words weigh as words never seen. A file without a licence of its own takes
that of the nearest ancestor directory that holds a licence file, found by joins on directory paths.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calltide.llm.common import bound_batches, materialize
from calltide.llm.textvec import ascii_lower_words, slices, span_hashes, utf8

THRESHOLD = 0.75
LINES_AFTER = 5
#: Distinct directories up to which their licences are broadcast to the files.
BROADCAST_DIRECTORIES = 200_000
#: Names of licence files, in lower case.
LICENCE_FILES = ("license", "licence", "copying", "copyright", "unlicense")
#: Besides such a name with any extension, words or versions may follow it or stand before it: LICENSE-MIT, MIT-LICENSE.txt, LICENSE_1_0.txt.
LICENCE_NAME = r"(?i)(?:^|/)(?:{0}(?:\.[^/]*)?|(?:{0}(?:[-_][a-z0-9+]+(?:\.[0-9]+)*)+|[a-z0-9+]+(?:[-_.][a-z0-9+]+)*[-_]{0})(?:\.(?:txt|md|rst|html))?)$".format(f"(?:{'|'.join(LICENCE_FILES)})")
#: A line with one of these words may begin a licence header; `gate` adds what the templates need besides.
LICENCE_WORDS = ("license", "licensed", "licence", "licenced", "copyright", "spdx", "gpl", "lgpl", "agpl", "unlicense", "copying", "redistribution", "permission", "dedicated")
#: Well-known headers and notices, by SPDX id.
TEMPLATES = {
    "AGPL-3.0": ("This work is licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0-only"),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "BSD-2-Clause": ("Released under the BSD 2-Clause License.", "SPDX-License-Identifier: BSD-2-Clause"),
    "BSD-3-Clause": (
        "Released under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "SPDX-License-Identifier: CC-BY-4.0"),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC0-1.0": ("This work is dedicated to the public domain under CC0 1.0.", "SPDX-License-Identifier: CC0-1.0"),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.", "SPDX-License-Identifier: GPL-2.0-only"),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0-only"),
    "LGPL-3.0": ("This work is licensed under the GNU Lesser General Public License, version 3.", "SPDX-License-Identifier: LGPL-3.0-only"),
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
        "SPDX-License-Identifier: MIT",
    ),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0"),
    "Proprietary": ("Copyright. All rights reserved.", "Proprietary and confidential. Unauthorized copying of this file is strictly prohibited."),
    "Unlicense": ("This is free and unencumbered software released into the public domain.", "SPDX-License-Identifier: Unlicense"),
}
_TEXTS = Path(__file__).parent / "licence_texts"
_WORD = re.compile("[0-9a-z\x80-\U0010ffff]+")


def all_templates() -> dict[str, tuple[str, ...]]:
    """TEMPLATES and the whole texts of the licences in ``licence_texts``, for files that hold one; read on the driver."""
    out = dict(TEMPLATES)
    for path in sorted(_TEXTS.glob("*.txt")):
        out[path.stem] = (*out.get(path.stem, ()), path.read_text(encoding="utf-8"))
    return out


def words_of(text: str) -> list[str]:
    """Runs of [0-9a-z] and characters beyond ASCII after lower-casing A-Z, as the array code has them."""
    return _WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text))


def gate(templates: dict[str, tuple[str, ...]] = TEMPLATES) -> frozenset[str]:
    """The words that begin header segments: LICENCE_WORDS, and of each template without any of them its longest word."""
    lacking = [words for texts in templates.values() for t in texts if (words := words_of(t)) and set(LICENCE_WORDS).isdisjoint(words)]
    return frozenset(LICENCE_WORDS).union(max(words, key=len) for words in lacking)


def _hashes(words: list[str]) -> np.ndarray:
    raw, offsets = utf8(words)
    return span_hashes(raw, offsets[:-1], offsets[1:])


class Matcher:
    """Cosines to all templates, with the idf of a corpus of ``total`` texts in which word w occurs in df[w]."""

    def __init__(self, templates: dict[str, tuple[str, ...]], df: dict[str, int], total: int):
        self.unseen = math.log(1 + total) + 1
        self.idf = {w: math.log((1 + total) / (1 + n)) + 1 for w, n in df.items()}
        self.by_word: dict[str, list[tuple[int, float]]] = defaultdict(list)
        self.names: list[str] = []
        for name, texts in sorted(templates.items()):
            for text in texts:
                weights = self._weights(words_of(text))
                norm = math.sqrt(sum(x * x for x in weights.values()))
                for w, x in weights.items():
                    self.by_word[w].append((len(self.names), x / norm))
                self.names.append(name)

    def _weights(self, words: list[str]) -> dict[str, float]:
        return {w: n * self.idf.get(w, self.unseen) for w, n in Counter(words).items()}

    def best(self, segment: str) -> tuple[str | None, float]:
        """The template of largest cosine, the first by name of equals."""
        weights = self._weights(words_of(segment))
        norm = math.sqrt(sum(x * x for x in weights.values()))
        dots: dict[int, float] = defaultdict(float)
        for w, x in weights.items():
            for k, y in self.by_word.get(w, ()):
                dots[k] += x * y
        if not dots:
            return None, 0.0
        k = min(dots, key=lambda k: (-round(dots[k] / norm, 12), k))
        return self.names[k], min(1.0, dots[k] / norm)


def segments(text: str, whole: bool, words: frozenset[str] = gate()) -> Iterator[str]:
    """The header segments of a text, begun by lines with one of the words, and the text itself for a licence file."""
    lines = text.split("\n")
    for k, line in enumerate(lines):
        if not words.isdisjoint(words_of(line)):
            yield line
            for after in range(1, min(LINES_AFTER, len(lines) - 1 - k) + 1):
                yield "\n".join(lines[k : k + 1 + after])
    if whole:
        yield text


def document_frequencies(files: DataFrame, vocabulary: list[str], text: str = "text") -> tuple[dict[str, int], int]:
    """In how many texts each word of a fixed vocabulary occurs, and how many texts there are."""
    hashes = _hashes(vocabulary)
    order = np.argsort(hashes)
    keys = hashes[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, rows = np.zeros(len(keys), np.int64), 0
        for batch in batches:
            texts = [t or "" for t in batch.column(0).to_pylist()]
            rows += len(texts)
            for i, j in slices(np.array([len(t) for t in texts], np.int64)):
                raw, offsets = utf8(texts[i:j])
                low, starts, ends, first = ascii_lower_words(raw, offsets)
                words = span_hashes(low, starts, ends)
                at = np.minimum(np.searchsorted(keys, words), len(keys) - 1)
                hit = np.flatnonzero(keys[at] == words)
                doc = np.searchsorted(first, hit, side="right") - 1
                seen = np.unique(doc * len(keys) + at[hit])
                counts += np.bincount(seen % len(keys), minlength=len(keys))
        yield pa.RecordBatch.from_arrays([pa.array([*range(-1, len(keys))], pa.int32()), pa.array([rows, *counts.tolist()], pa.int64())], ["word", "n"])

    got = {r.word: r.n for r in files.select(F.col(text)).mapInArrow(run, "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}
    return {vocabulary[order[k]]: got.get(k, 0) for k in range(len(keys))}, got.get(-1, 0)


def _directory(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def _is_licence_file(path: Column) -> Column:
    return path.rlike(LICENCE_NAME)


def own_licences(files: DataFrame, path: str = "path", text: str = "text", keep: tuple[str, ...] = ("doc_id",), templates: dict[str, tuple[str, ...]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """``keep`` columns, path, own_license and own_score (null and 0 below the threshold), one row per file."""
    bound_batches(files.sparkSession)
    vocabulary = sorted({w for texts in templates.values() for t in texts for w in words_of(t)})
    df, total = document_frequencies(files, vocabulary, text)
    shared = files.sparkSession.sparkContext.broadcast(Matcher(templates, df, total))
    words_marked = gate(templates)
    marks = np.sort(_hashes(sorted(words_marked)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, whole = [t or "" for t in batch.column("__text").to_pylist()], batch.column("__whole").to_pylist()
            names: list[str | None] = []
            scores: list[float] = []
            for i, j in slices(np.array([len(t) for t in texts], np.int64)):
                raw, offsets = utf8(texts[i:j])
                low, starts, ends, first = ascii_lower_words(raw, offsets)
                marked = np.concatenate([[0], np.cumsum(np.isin(span_hashes(low, starts, ends), marks))])
                for k, has in enumerate(marked[first[1:]] > marked[first[:-1]]):
                    best = (None, 0.0)
                    if has or whole[i + k]:
                        best = min((shared.value.best(s) for s in segments(texts[i + k], bool(whole[i + k]), words_marked)), key=lambda b: (-b[1], b[0] or "~"), default=best)
                    found = best[1] >= threshold
                    names.append(best[0] if found else None)
                    scores.append(best[1] if found else 0.0)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in batch.schema.names[:-2]), pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*batch.schema.names[:-2], "own_license", "own_score"])

    chosen = files.select(*keep, F.col(path).alias("path"), _is_licence_file(F.col(path)).alias("__whole"), F.col(text).alias("__text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-2])
    return chosen.mapInArrow(run, f"{fields}, own_license string, own_score double")


def inherit(scanned: DataFrame) -> DataFrame:
    """Add ``license``, ``origin`` (header, file, inherited or null), ``licensed_by`` (the directory it comes from) and ``licenses``.

    A directory's licence is that of its licence file; of several the best score, then the first by licence and path, while
    ``licenses`` has all of them by name (of a file with a licence of its own, that one; without any, none). A directory with a third of all files meets its licence in a broadcast or in a join that can be split. Files without
    path belong to no directory.
    """
    licence_file = _is_licence_file(F.col("path"))
    best = F.min_by(F.col("own_license"), F.struct(-F.col("own_score"), "own_license", "path"))
    licensed = scanned.where(licence_file & F.col("own_license").isNotNull()).groupBy(_directory(F.col("path")).alias("ancestor")).agg(best.alias("license"), F.sort_array(F.collect_set("own_license")).alias("licenses"))
    directories = scanned.where("path IS NOT NULL").select(_directory(F.col("path")).alias("directory")).distinct()
    parts = F.split("directory", "/")
    upward = directories.select("directory", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(parts, 1, i), "/").alias("ancestor")))).alias("a")).select("directory", "a.*")
    nearest = upward.join(licensed, "ancestor").groupBy("directory").agg(F.max_by(F.struct("license", "ancestor", "licenses"), "depth").alias("__near"))
    nearest = materialize(nearest.withColumnRenamed("directory", "__directory"))
    near = F.broadcast(nearest) if nearest.count() <= BROADCAST_DIRECTORIES else nearest
    joined = scanned.withColumn("__directory", _directory(F.col("path"))).join(near, "__directory", "left").drop("__directory")
    own = F.col("own_license").isNotNull()
    return joined.select(
        *(f"`{c}`" for c in scanned.columns), F.coalesce("own_license", "__near.license").alias("license"),
        F.when(own & licence_file, "file").when(own, "header").when(F.col("__near").isNotNull(), "inherited").alias("origin"),
        F.when(~own, F.col("__near.ancestor")).alias("licensed_by"), F.when(own, F.array("own_license")).otherwise(F.coalesce("__near.licenses", F.array().cast("array<string>"))).alias("licenses"),
    )


def scan(files: DataFrame, path: str = "path", text: str = "text", keep: tuple[str, ...] = ("doc_id",), templates: dict[str, tuple[str, ...]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """Own licences and inheritance in one; the scan is written once, since it is read for directories and for files.

    Null and empty texts and null paths are files without header; repeated rows each have their row.
    """
    return inherit(materialize(own_licences(files, path, text, keep, templates, threshold)))
