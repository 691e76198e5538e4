from __future__ import annotations

import random
import subprocess
import sys
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from calltide.llm import common, packing
from calltide.llm.wordbpe import WordBPE, word_bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
BPE = WordBPE(PATH)
LIBRARY = Tokenizer.from_file(PATH)
LIBRARY.encode_special_tokens = True


def library_ids(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab'stre lvmd12\n\té½ªÀßŁΣ—“…#_-中かİ\x00́ 😀ﬁ"), max_size=40), max_size=6))
def test_ids_are_the_librarys(texts):
    ids, offsets = BPE.ids(texts)
    for k, text in enumerate(texts):
        assert ids[offsets[k] : offsets[k + 1]].tolist() == library_ids(text)


def test_ids_of_long_and_plain_texts_and_a_full_cache():
    small = WordBPE(PATH, cache_ids=10)
    texts = ["don't they're 'tis", "a" * 50_000, "<|endoftext|> x", "The Quick brown fox " * 200, ""]
    for _ in range(2):
        ids, offsets = small.ids(texts)
        assert [ids[offsets[k] : offsets[k + 1]].tolist() for k in range(len(texts))] == [library_ids(t) for t in texts]


def test_pieces_and_sequences(spark):
    rng = random.Random(0)
    docs = [(k, " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(rng.choice([0, 3, 40, 200, 700])))) for k in range(60)] + [(100, None), (101, ""), (3, "twice"), (3, "twice"), (None, "no id")]
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, piece int")
    capacity = 256
    pieces = packing.tokenize_pieces(df, PATH, capacity=capacity, with_ids=True)
    got = packing.pack(packing.tokenize_pieces(df, PATH, capacity=capacity), capacity, shard_pieces=40).toPandas()
    want = []
    for i, text in docs:
        ids = [*library_ids(text or ""), 1]
        for piece, start in enumerate(range(0, len(ids), capacity)):
            part = ids[start : start + capacity]
            want.append((-1 if i is None else i, piece, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, got[columns].fillna(-1).astype("int64").itertuples(index=False))) == sorted(want)
    for _, own in got.sort_values("offset").groupby("sequence_id"):
        assert own["length"].sum() <= capacity and (own["length"].cumsum() - own["length"] == own["offset"]).all()
    assert got["sequence_id"].nunique() <= 1.1 * sum(w[3] for w in want) / capacity + 3
    sequences = packing.assemble_sequences(packing.pack(pieces, capacity)).collect()  # repeated rows and null ids too
    assert sorted(t for s in sequences for t in s.ids) == sorted(t for _, text in docs for t in [*library_ids(text or ""), 1])
    assert all(len(s.ids) <= capacity for s in sequences)
    assert packing.pack_documents(df.limit(0), PATH).count() == 0


def test_pieces_of_one_id_are_dealt_to_all_shards(spark):
    pieces = spark.range(2000).selectExpr("CAST(NULL AS BIGINT) AS doc_id", "0 AS piece", "0L AS start", "id % 97 + 1 AS length", "7L AS ids_crc32")
    got = packing.pack(pieces, 256, shard_pieces=100).toPandas()
    per_shard = (got["sequence_id"] // (1 << 32)).value_counts()
    assert len(got) == 2000 and len(per_shard) == 20 and per_shard.max() < 200
    assert got.groupby("sequence_id")["length"].sum().max() <= 256


def test_genetic_search_is_no_worse_than_best_fit():
    rng = np.random.default_rng(1)
    sizes = rng.integers(900, 2200, 600)
    first = packing.founder(sizes, 4096, 0.0, np.random.default_rng(0))
    best = packing.evolve(sizes, 4096, 3, [])[0]
    assert packing.fitness(sizes, best, 4096) <= packing.fitness(sizes, first, 4096)
    again = packing.evolve(sizes, 4096, 9, [best, first])[0]
    assert packing.fitness(sizes, again, 4096) <= packing.fitness(sizes, best, 4096)
    assert np.bincount(again, sizes).max() <= 4096
    child = packing.crossover(sizes, first, best, 4096, np.random.default_rng(4))
    assert np.bincount(child, sizes).max() <= 4096 and (np.bincount(child) > 0).all()


MARKED = ["end <|endoftext|> next", "a<|startoftext|>b<|endoftext|>", "Upper <|ENDOFTEXT|> x", "<|endoftext", "é½ <|endoftext|>中", "plain words", "", "x " * 2000 + "<|endoftext|>"]


def test_added_tokens_are_those_of_the_unaltered_library(spark):
    library = Tokenizer.from_file(PATH)
    want = [library.encode(t, add_special_tokens=False).ids for t in MARKED]
    assert want[0] == [806, 49407, 1131]
    bpe = WordBPE(PATH, added_tokens=True)
    ids, offsets = bpe.ids(MARKED)
    assert [ids[offsets[k] : offsets[k + 1]].tolist() for k in range(len(MARKED))] == want
    df = spark.createDataFrame(list(enumerate(MARKED)), "doc_id long, text string")
    got = {r.doc_id: (r.length, r.ids_crc32) for r in packing.pack_documents(df, PATH).collect() if r.piece == 0}
    for k, own in enumerate(want):
        part = [*own, 1][:4096]
        assert got[k] == (len(part), zlib.crc32(np.array(part, "<u4").tobytes())), MARKED[k]


def test_ids_of_any_type(spark):
    df = spark.createDataFrame([("a", "one text"), (None, None), ("b", "x " * 9000)], "doc_id string, text string")
    got = packing.pack_documents(df, public_tokenizers.path("word_bpe_49k.json"))
    assert got.schema["doc_id"].dataType.simpleString() == "string"
    assert {r.doc_id for r in got.collect()} == {"a", None, "b"}


def test_known_words_are_kept_in_few_bytes():
    bpe, rng = WordBPE(PATH), random.Random(1)
    words = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(60_000)]
    texts = [" ".join(words[i : i + 500]) for i in range(0, len(words), 500)]
    tracemalloc.start()
    before = tracemalloc.get_traced_memory()[0]
    made = [bpe.ids(texts)[0].tobytes() for _ in range(2)]
    assert made[0] == made[1]
    made.clear()
    held = tracemalloc.get_traced_memory()[0] - before
    tracemalloc.stop()
    assert held < 60 * len(set(words))


def test_a_worker_keeps_tables_only_between_tasks_that_use_them():
    seen = []

    def uses(batches):
        seen.append(word_bpe(PATH))
        yield from batches

    def other(batches):
        yield from batches

    common._HELD.clear()
    for run, kept in ((uses, 1), (uses, 1), (other, 0), (uses, 1)):
        assert list(common.lean(run)(iter([1, 2]))) == [1, 2]
        assert len(common._HELD) == kept
    assert seen[0] is seen[1] is not seen[2]


def test_freed_memory_goes_back():
    code = """
import re
from calltide.llm.common import lean

def mb():
    return sum(map(int, re.findall(r"Pss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024

def run(batches):
    held = [bytes(1000) for _ in range(60_000)]
    pin.append(bytes(1000))
    yield mb()

pin = []
before = mb()
print(before, *lean(run)(iter([])), mb())
"""
    before, most, after = map(float, subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout.split())
    assert most > before + 50 and after < before + 10
