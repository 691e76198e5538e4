"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts n-grams per language on the executors and brings one bounded matrix (languages x ``BUCKETS``) to the
driver; the log-probabilities are broadcast, and prediction is one pass over whole texts without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calltide.llm.common import bound_batches, drop_table, materialize
from calltide.llm.textvec import U64, codepoints, slices, text_column

BUCKETS = 1 << 14
ORDERS = (1, 2, 3)
SMOOTHING = 0.5
#: About so many labelled documents are counted, chosen by a hash of their id.
TRAIN_DOCS = 20_000
#: Languages of a model, so that its matrix stays at some 130 MB: of more labels those of most documents are learned.
MOST_LANGUAGES = 1000
#: Labels whose counts a task holds at once (128 KB each).
LABELS_AT_ONCE = 256
UNDETERMINED = "und"
#: Elements of one gather of log-probabilities.
GATHER = 1 << 22


def _letters() -> np.ndarray:
    """Which code points up to U+FFFF are letters."""
    return np.array([chr(c).isalpha() for c in range(1 << 16)])


_TABLES: dict[str, np.ndarray] = {}


def _tables() -> dict[str, np.ndarray]:
    if not _TABLES:
        _TABLES["letter"] = _letters()
        low = np.arange(1 << 16, dtype=np.uint32)
        for c in range(1 << 16):
            if len(x := chr(c).lower()) == 1:
                low[c] = ord(x)
        _TABLES["lower"] = low
    return _TABLES


def grams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order, (text index of every n-gram in rising order, its bucket); digits and white space are one blank."""
    tables = _tables()
    codes, offsets = codepoints(texts)
    small = np.minimum(codes, 0xFFFF)
    low = np.where(codes < 1 << 16, tables["lower"][small], codes).astype(U64)
    low[(codes < 1 << 16) & ~tables["letter"][small]] = 0
    text = np.repeat(np.arange(len(texts)), np.diff(offsets))
    key = np.zeros(len(low), U64)
    for n in ORDERS:
        key = key[: max(0, len(low) - n + 1)] * U64(0x100000001B3) + low[n - 1 :] + U64(n)
        inside = text[n - 1 :] == text[: len(key)]
        bucket = ((key * U64(0x9E3779B97F4A7C15)) >> U64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)
        yield text[: len(key)][inside], bucket[inside]


@dataclass
class LanguageModel:
    languages: list[str]
    log_probability: np.ndarray  # BUCKETS x languages
    log_prior: np.ndarray


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", sample_by: str = "doc_id", train_docs: int = TRAIN_DOCS) -> LanguageModel:
    """Count n-grams of about ``train_docs`` rows (all of them, if there are fewer), chosen by a hash of ``sample_by``.

    Rows with a null label, or a null or empty text, teach nothing. Without any row the model knows no language. Of more
    than MOST_LANGUAGES labels those of most rows are learned (of equals the first by name); rows of others teach nothing.
    """
    bound_batches(labelled.sparkSession)
    rows = labelled.where(F.col(lang).isNotNull() & (F.length(text) > 0))
    share = min(1.0, train_docs / max(1, rows.count()))
    if share < 1:
        rows = rows.where(F.pmod(F.xxhash64(F.lit("language"), F.col(sample_by).cast("string")), F.lit(1_000_000)) < int(share * 1_000_000))
    rows = rows.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).repartition(16)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        docs: dict[str, int] = {}

        def told() -> Iterator[pa.RecordBatch]:
            for name, held in counts.items():
                at = np.flatnonzero(held)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * (len(at) + 1), pa.string()), pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(held[at], docs[name]), pa.int64())], ["lang", "bucket", "n"]
                )
            counts.clear()
            docs.clear()

        for batch in batches:
            texts, langs = text_column(batch, "text"), batch.column("lang").to_pylist()
            own_texts: dict[str, list[str]] = {}
            for t, x in zip(texts, langs, strict=True):
                own_texts.setdefault(x, []).append(t)
            for name, own in own_texts.items():
                if name not in counts and len(counts) >= LABELS_AT_ONCE:
                    yield from told()
                docs[name] = docs.get(name, 0) + len(own)
                held = counts.setdefault(name, np.zeros(BUCKETS, np.int64))
                for i, j in slices(np.array([len(t) for t in own], np.int64)):
                    for _, bucket in grams(own[i:j]):
                        held += np.bincount(bucket, minlength=BUCKETS)
        yield from told()

    summed = materialize(rows.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")))
    learned = summed.where("bucket = -1").orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES).select("lang")
    packed = summed.join(F.broadcast(learned), "lang", "left_semi").groupBy("lang").agg(F.collect_list("bucket").alias("buckets"), F.collect_list("n").alias("ns")).orderBy("lang").collect()
    drop_table(summed)
    matrix, prior = np.zeros((BUCKETS + 1, len(packed))), np.zeros(len(packed))
    for k, row in enumerate(packed):
        matrix[np.array(row.buckets), k] = row.ns  # bucket -1 is the last row: the documents
        prior[k] = matrix[-1, k]
    counts_ = matrix[:-1] + SMOOTHING
    return LanguageModel([r.lang for r in packed], np.log(counts_) - np.log(counts_.sum(axis=0, keepdims=True)), np.log(np.maximum(prior, 1) / max(1, prior.sum())))


def predict_batch(model: LanguageModel, texts: list[str]) -> tuple[list[str], np.ndarray]:
    """(language, posterior probability) of each text; UNDETERMINED and 0 where a text has no letter."""
    letter = _tables()["letter"]
    names: list[str] = []
    scores: list[np.ndarray] = []
    for i, j in slices(np.array([len(t) for t in texts], np.int64)):
        part = texts[i:j]
        codes, offsets = codepoints(part)
        is_letter = np.where(codes < 1 << 16, letter[np.minimum(codes, 0xFFFF)], True)
        total = np.concatenate([[0], np.cumsum(is_letter)])
        known = total[offsets[1:]] > total[offsets[:-1]]
        for k in np.flatnonzero(known):  # beyond U+FFFF, ask Python
            own = codes[offsets[k] : offsets[k + 1]]
            if own.max(initial=0) > 0xFFFF:
                known[k] = any(map(str.isalpha, part[k]))
        log = np.tile(model.log_prior, (j - i, 1))
        step = max(1, GATHER // max(1, len(model.languages)))
        for text, bucket in grams(part):
            for a in range(0, len(text), step):
                own, at = np.unique(text[a : a + step], return_index=True)
                log[own] += np.add.reduceat(model.log_probability[bucket[a : a + step]], at, axis=0)
        if model.languages:
            best = log.argmax(axis=1)
            posterior = 1 / np.exp(log - log.max(axis=1, keepdims=True)).sum(axis=1)
            names += [model.languages[b] if k else UNDETERMINED for b, k in zip(best, known, strict=True)]
            scores.append(np.where(known, posterior, 0.0))
        else:
            names += [UNDETERMINED] * (j - i)
            scores.append(np.zeros(j - i))
    return names, np.concatenate(scores) if scores else np.zeros(0)


def predict(docs: DataFrame, model: LanguageModel, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns with lang_pred and score for every row; only ``text`` enters a prediction.

    A text that is null, empty or without a letter is UNDETERMINED with score 0; of languages of equal probability the
    first by name is predicted. Repeated rows are each predicted; a kept column named lang_pred or score is replaced.
    """
    keep = tuple(c for c in keep if c not in ("lang_pred", "score"))
    spark = docs.sparkSession
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = predict_batch(shared.value, text_column(batch, "__text"))
            kept = [batch.column(c) for c in batch.schema.names[:-1]]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*batch.schema.names[:-1], "lang_pred", "score"])

    chosen = docs.select(*keep, F.col(text).alias("__text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1])
    return chosen.mapInArrow(run, f"{fields}, lang_pred string, score double")
