"""Quality scores by Bradley-Terry pairwise ranking.

A labelled document of quality 1 is preferred to one of quality 0. Weights minimise the logistic loss on the feature
differences of such pairs; a document's score is its weighted features, and a quantile of the training scores is the
threshold. Features come from whole texts in one pass; training takes a bounded sample of labelled rows to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calltide.llm.common import bound_batches, lean
from calltide.llm.textvec import U64, codepoints, mix, slices, span_hashes, text_column

#: Labelled documents that training takes at most, chosen by a hash of their id: some 8 MB of features on the driver.
TRAIN_DOCS = 20_000
PAIRS = 100_000
RIDGE = 1e-3
NEWTON_STEPS = 12
#: Punctuation whose share of the text is a feature of its own.
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
FEATURES = ["log_chars", "log_words", "word_length", "word_length_spread", "upper", "digit", "mark", "line_breaks", "distinct_words", "repeated_next", "repeated_pair", "distinct_chars_of_words", "long_words", *(f"mark_{ord(c)}" for c in MARKS)]

_KIND: dict[str, np.ndarray] = {}


def _kinds() -> dict[str, np.ndarray]:
    if not _KIND:
        chars = [chr(c) for c in range(1 << 16)]
        _KIND["space"] = np.array([c.isspace() for c in chars])
        _KIND["upper"] = np.array([c.isupper() for c in chars])
        _KIND["letter"] = np.array([c.isalpha() for c in chars])
        _KIND["digit"] = np.array([c.isdigit() for c in chars])
    return _KIND


def features(texts: list[str]) -> np.ndarray:
    """len(texts) x len(FEATURES); an empty text has zeros only."""
    out = np.zeros((len(texts), len(FEATURES)))
    for i, j in slices(np.array([len(t) for t in texts], np.int64)):
        out[i:j] = _features(texts[i:j])
    return out


def _features(texts: list[str]) -> np.ndarray:
    kinds, n = _kinds(), len(texts)
    codes, offsets = codepoints(texts)
    chars = np.diff(offsets)
    if not len(codes):
        return np.zeros((n, len(FEATURES)))
    small = np.minimum(codes, 0xFFFF)
    text = np.repeat(np.arange(n), chars)

    def per_text(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags)])
        return (total[offsets[1:]] - total[offsets[:-1]]).astype(float)

    space, letter = kinds["space"][small], kinds["letter"][small]
    begin = ~space
    begin[1:] &= space[:-1] | (text[1:] != text[:-1])
    finish = ~space
    finish[:-1] &= space[1:] | (text[1:] != text[:-1])
    starts, ends = np.flatnonzero(begin), np.flatnonzero(finish) + 1
    word_text, length = text[starts], (ends - starts).astype(float)
    words = np.bincount(word_text, minlength=n).astype(float)
    some_words, some_chars = np.maximum(words, 1), np.maximum(chars, 1)
    hashes = span_hashes(codes, starts, ends)
    salted = hashes ^ mix(word_text.astype(U64) + U64(77))
    distinct = np.bincount(word_text[np.unique(salted, return_index=True)[1]], minlength=n)
    same = np.zeros(len(hashes), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (word_text[1:] == word_text[:-1])
    pair = mix(salted + np.concatenate([[U64(0)], hashes[:-1]]))
    pairs = np.bincount(word_text[np.unique(pair, return_index=True)[1]], minlength=n)
    mean = np.bincount(word_text, length, n) / some_words
    spread = np.sqrt(np.maximum(np.bincount(word_text, length**2, n) / some_words - mean**2, 0))
    letters = np.maximum(per_text(letter), 1)
    mark_counts = np.zeros((n, 128))
    ascii_marks = np.flatnonzero((codes < 128) & ~letter & ~space)
    np.add.at(mark_counts, (text[ascii_marks], codes[ascii_marks]), 1)
    share = np.sqrt(mark_counts[:, [ord(c) for c in MARKS]] / some_chars[:, None])
    word_letters = np.add.reduceat(letter.astype(np.int64), starts) if len(starts) else np.zeros(0)
    no_letters = np.bincount(word_text, word_letters == 0, n) if len(starts) else np.zeros(n)
    columns = [
        np.log1p(chars), np.log1p(words), np.log1p(mean), np.log1p(spread), per_text(kinds["upper"][small]) / letters, np.sqrt(per_text(kinds["digit"][small]) / some_chars),
        np.sqrt(per_text(~letter & ~space) / some_chars), np.sqrt(per_text(codes == 10) / some_chars), distinct / some_words, np.bincount(word_text, same, n) / some_words,
        pairs / some_words, no_letters / some_words, np.bincount(word_text, length > 20, n) / some_words,
    ]
    return np.where(chars[:, None] > 0, np.column_stack([*columns, share]), 0.0)


@dataclass
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x) - self.threshold, -500, 500)))


def fit(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, ridge: float = RIDGE, seed: int = 7) -> QualityModel:
    """Bradley-Terry weights from at most ``pairs`` random (preferred, other) pairs, then the threshold.

    The threshold is the score quantile that parts the training labels with the fewest errors. With only one label
    there are no pairs: weights are 0 and every score is 0.5.
    """
    if not len(x):
        return QualityModel(np.zeros(len(FEATURES)), np.ones(len(FEATURES)), np.zeros(len(FEATURES)), 0.0)
    mean, scale = x.mean(axis=0), x.std(axis=0)
    model = QualityModel(mean, np.where(scale > 1e-9, scale, 1.0), np.zeros(x.shape[1]), 0.0)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return model
    rng, z = np.random.default_rng(seed), (x - mean) / model.scale
    d = z[rng.choice(good, pairs)] - z[rng.choice(bad, pairs)]
    w = np.zeros(x.shape[1])
    loss = lambda v: float(np.logaddexp(0, -(d @ v)).mean() + ridge / 2 * v @ v)
    now = loss(w)
    for _ in range(NEWTON_STEPS):
        p = 1 / (1 + np.exp(np.clip(d @ w, -500, 500)))
        gradient = ridge * w - d.T @ p / pairs
        hessian = (d * (p * (1 - p))[:, None]).T @ d / pairs + ridge * np.eye(len(w))
        step, size = np.linalg.solve(hessian, gradient), 1.0
        while size > 1e-4 and (then := loss(w - size * step)) > now:
            size /= 2
        if size <= 1e-4 or now - then < 1e-9:
            break
        w, now = w - size * step, then
    model.weights = w
    raw = model.raw(x)
    order = np.argsort(raw, kind="stable")
    below_good, below_bad = np.cumsum(y[order] == 1), np.cumsum(y[order] == 0)
    cut = int(np.argmin(below_good + (len(bad) - below_bad)))
    model.threshold = float(raw[order[cut]] + (raw[order[min(cut + 1, len(x) - 1)]] - raw[order[cut]]) / 2)
    return model


def train(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality", train_docs: int = TRAIN_DOCS) -> QualityModel:
    """Fit on at most ``train_docs`` labelled rows (the smallest hashes of ``key``) that have a document.

    The chosen labels are at most ``train_docs`` small rows and so are broadcast. Rows with a null key or a label other
    than 0 and 1 teach nothing; a document with both labels counts once for each. Of several texts of one key the one with
    the least features counts, so that what reaches the driver is bounded by ``train_docs`` whatever is repeated.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    usable = labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1)).select(F.col(key).alias("__key"), F.col(label).cast("int").alias("label"))
    chosen = usable.orderBy(F.xxhash64(F.lit("quality"), F.col("__key").cast("string")), "__key", "label").limit(train_docs)
    rows = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("__key"), F.col(text).alias("text")).join(F.broadcast(chosen), "__key").select("text", "label", "__key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features(text_column(batch, "text"))
            yield pa.RecordBatch.from_arrays([batch.column("__key").cast(pa.string()), batch.column("label"), pa.array([r.tobytes() for r in x], pa.binary())], ["key", "label", "x"])

    got = rows.mapInArrow(lean(run), "key string, label int, x binary").groupBy("key", "label").agg(F.min("x").alias("x")).orderBy("key", "label").collect()
    x = np.array([np.frombuffer(r.x) for r in got]).reshape(len(got), len(FEATURES))
    return fit(x, np.array([r.label for r in got], int))


def score(docs: DataFrame, model: QualityModel, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns with score and predicted for every row, null and empty texts too; only ``text`` is read."""
    spark = docs.sparkSession
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = shared.value.score(features(text_column(batch, "__text")))
            kept = [batch.column(c) for c in batch.schema.names[:-1]]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32), pa.int32())], [*batch.schema.names[:-1], "score", "predicted"])

    chosen = docs.select(*keep, F.col(text).alias("__text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1])
    return chosen.mapInArrow(lean(run), f"{fields}, score double, predicted int")
