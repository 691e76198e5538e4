from __future__ import annotations

import random

import numpy as np

from calltide.llm import language, quality
from calltide.llm.common import crc_mod

PARTS = {"en": ["th", "ing", "and", "er", "ou"], "de": ["sch", "ung", "ein", "ö", "keit"], "es": ["ción", "ñ", "que", "os", "lla"]}


def text_in(lang, rng, n=40):
    return " ".join("".join(rng.choice(PARTS[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


def test_language_on_held_out_documents(spark):
    rng = random.Random(0)
    rows = [(k, text_in(lang, rng), lang, "clash") for k, lang in enumerate(["en", "en", "de", "es"] * 40)]
    rows += [(900, None, "en", "x"), (901, "123 !?", "en", "x"), (902, "", None, "x"), (903, text_in("de", rng), None, "x"), (904, text_in("es", rng, 30_000), "es", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    out = language.predict(df, language.train(df.where(crc_mod("doc_id", 4) != 2)))
    got = {r.doc_id: r for r in out.collect()}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got.values())
    assert sum(got[i].lang_pred == lang for i, _, lang, _ in rows[:160]) >= 158
    assert [got[i].lang_pred for i in (900, 901, 902, 903, 904)] == ["und", "und", "und", "de", "es"]
    assert out.columns == ["doc_id", "lang_pred", "score"]


def test_language_without_labels_rows_or_training_bound(spark):
    df = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    model = language.train(df)
    assert language.predict(df, model).first().lang_pred == "und" and language.predict(df.limit(0), model).count() == 0
    rng = random.Random(1)
    many = spark.createDataFrame([(k, text_in("en" if k % 2 else "de", rng, 5), "en" if k % 2 else "de") for k in range(400)], "doc_id long, text string, lang string")
    assert sorted(language.train(many, train_docs=100).languages) == ["de", "en"]


def test_language_scores_are_those_of_naive_bayes():
    rng = random.Random(2)
    texts = [text_in("en", rng, 6), text_in("es", rng, 6), "é"]
    log = np.log(np.random.default_rng(0).dirichlet(np.ones(language.BUCKETS), 2).T)
    model = language.LanguageModel(["a", "b"], log, np.log([0.4, 0.6]))
    names, scores = language.predict_batch(model, texts)
    for k, text in enumerate(texts):
        total = model.log_prior.copy()
        for _, bucket in language.grams([text]):
            total = total + log[bucket].sum(axis=0)
        p = np.exp(total - total.max()) / np.exp(total - total.max()).sum()
        assert names[k] == "ab"[p.argmax()] and abs(scores[k] - p.max()) < 1e-9


def good(rng):
    return " ".join("".join(rng.choice("aeionrst") for _ in range(rng.randint(2, 9))) for _ in range(60)) + "."


def bad(rng):
    word = "".join(rng.choice("aeionrst") for _ in range(6))
    return rng.choice([" ".join([word] * 60), " ".join(w.upper() + "!!" for w in good(rng).split()), " | ".join(good(rng).split())])


def test_quality_on_held_out_documents(spark):
    rng = random.Random(3)
    labels = [(k, int(rng.random() < 0.7)) for k in range(400)]
    docs = [(k, good(rng) if q else bad(rng), "clash") for k, q in labels] + [(900, None, "x"), (901, "", "x"), (902, "word " * 100_000, "x")]
    d = spark.createDataFrame(docs, "doc_id long, text string, score string")
    lab = spark.createDataFrame([*labels, (None, 1), (5, None), (7, 9)], "doc_id long, quality int")
    model = quality.train(d, lab.where(crc_mod("doc_id", 3) != 1))
    rows = quality.score(d.withColumn("held_out", crc_mod("doc_id", 3) == 1), model, keep=("doc_id", "held_out")).collect()
    truth = dict(labels)
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert len(rows) == len(docs) and len(held) > 80 and np.mean([r.predicted == truth[r.doc_id] for r in held]) >= 0.98
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows) and {r.doc_id: r.predicted for r in rows}[902] == 0
    assert quality.score(d.limit(0), model).count() == 0


def test_quality_without_pairs(spark):
    d = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")
    lab = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    for labels in (lab, lab.limit(0)):
        assert [r.score for r in quality.score(d, quality.train(d, labels)).collect()] == [0.5, 0.5]


def test_bradley_terry_recovers_an_order():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(2000, 4))
    truth = x @ np.array([2.0, -1.0, 0.5, 0.0])
    model = quality.fit(x, (truth + rng.logistic(size=2000) * 0.3 > 0).astype(int))
    assert np.corrcoef(model.raw(x), truth)[0, 1] > 0.98


def test_language_training_against_plain_counts(spark):
    """Counts, smoothing and priors of a model against n-grams counted one by one."""
    rng = random.Random(5)
    rows = [(k, text_in(lang, rng, 8), lang) for k, lang in enumerate(["en", "de", "es", "en"] * 8)]
    model = language.train(spark.createDataFrame([*rows, (99, None, "en"), (98, "", "de"), (97, "x", None)], "doc_id long, text string, lang string"))
    assert model.languages == ["de", "en", "es"]
    for k, name in enumerate(model.languages):
        counts = np.zeros(language.BUCKETS)
        own = [t for _, t, lang in rows if lang == name]
        for text in own:
            for _, buckets in language.grams([text]):
                for b in buckets.tolist():
                    counts[b] += 1
        want = np.log((counts + language.SMOOTHING) / (counts.sum() + language.SMOOTHING * language.BUCKETS))
        assert np.allclose(model.log_probability[:, k], want) and np.isclose(model.log_prior[k], np.log(len(own) / len(rows)))
    replaced = language.predict(spark.createDataFrame([("t", "x")], "text string, score string"), model, keep=("text", "score"))
    assert replaced.columns == ["text", "lang_pred", "score"]


def test_quality_fit_against_gradient_descent():
    """The weights minimise the logistic loss on the pairs' differences, and the threshold makes the fewest errors of all."""
    rng = np.random.default_rng(11)
    x = rng.normal(size=(300, len(quality.FEATURES)))
    y = (x[:, 0] - 0.7 * x[:, 3] + rng.normal(size=300) * 0.8 > 0).astype(int)
    model = quality.fit(x, y, pairs=2000, seed=3)
    coin, z = np.random.default_rng(3), (x - x.mean(axis=0)) / x.std(axis=0)
    d = z[coin.choice(np.flatnonzero(y == 1), 2000)] - z[coin.choice(np.flatnonzero(y == 0), 2000)]
    w = np.zeros(x.shape[1])
    for _ in range(6000):  # plain descent, another way to the same minimum
        w -= 0.2 * (quality.RIDGE * w - d.T @ (1 / (1 + np.exp(d @ w))) / len(d))
    assert np.abs(w - model.weights).max() < 1e-2
    raw = model.raw(x)
    errors = lambda cut: int(((raw >= cut) != (y == 1)).sum())
    assert errors(model.threshold) <= min(errors(c) for c in np.sort(raw)) + 1


def test_quality_training_takes_one_row_per_key_and_label(spark):
    rng = random.Random(3)
    docs = [(k, good(rng) if k % 2 else bad(rng)) for k in range(60)] + [(7, good(rng)) for _ in range(50)]
    labels = [(k, k % 2) for k in range(60)] * 2 + [(None, 1), (5, 7)]
    model = quality.train(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int"), train_docs=60)
    again = quality.train(spark.createDataFrame(docs[::-1], "doc_id long, text string"), spark.createDataFrame(labels[::-1], "doc_id long, quality int"), train_docs=60)
    assert np.array_equal(model.weights, again.weights) and model.threshold == again.threshold


def test_more_labels_than_a_model_holds(spark, monkeypatch):
    """Those of most rows are learned, of equals the first by name; counts are flushed when a task meets many labels."""
    monkeypatch.setattr(language, "MOST_LANGUAGES", 3)
    rows = [(i, f"{'abcdefghijklmnop'[i % 16] * 3} text", f"l{i % 16:02}") for i in range(160)] + [(200 + i, "zzz text", "often") for i in range(20)] + [(300, "q", "l15")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(df)
    assert model.languages == ["l00", "l15", "often"]
    monkeypatch.setattr(language, "LABELS_AT_ONCE", 2)
    again = language.train(df)
    assert again.languages == model.languages and (again.log_probability == model.log_probability).all() and (again.log_prior == model.log_prior).all()
