"""Removal of repeated and nearly repeated lines by an exact set-similarity join, in DataFrame operations only.

A line's tokens are its five-word shingles, as 64-bit hashes, written once as a table that all later steps read: sets are
named (by 128 bits) and verified by them. Candidates are found by 32-bit hashes of them, which only costs a few more of
them. Tokens are ordered by rarity (counts over the whole corpus, kept in ``BUCKETS`` hashed counters of 16 classes, so that the order
fits in a small literal): those of counters that stand out come last, the commoner the later, all others in the order of
their hashes, in which sets are written; only a set with few tokens that are not common needs sorting. A line of one to four words has one token, made of all its words, so that it goes where it
repeats such a line. Two sets with Jaccard similarity of at least ``PERCENT`` share a token within their prefixes; candidates
come from a join on prefix tokens with length and positional bounds, and are verified on whole token sets. A line with an
earlier match goes. Lines without words have no tokens and stay.

Equal sets are one class, their first line, from the start: the lines that repeat it go, and only it is compared. Within a class of near copies the pairs would grow with
the square of its size; only whether an earlier match exists matters, so where more than ``CROWD`` classes share a token, lines
first meet the earliest line of their token and length, and just those that it does not settle are joined with all earlier lines.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from calltide.llm.common import SHINGLE_WORDS, drop_table, materialize

BUCKETS = 1 << 16
PERCENT = 80
#: A word after lower-casing: all but the listed characters, one by one, since Java looks such a class up in a bit table.
WORD = "[^" + "".join(f"\\x{c:02x}" for c in range(128) if not chr(c).isdigit() and not "a" <= chr(c) <= "z") + "]+"
#: Common counters are of this class at least (the upper 32nd), and so many times the spread of counts above the middle one.
LEAST_CLASS, DEVIATIONS = 5, 3
#: Bits of a bitmap for each of its keys, and at least and at most (32 MB); a fuller one only lets more rows pass to the exact joins.
BITS_EACH, LEAST_BITS, MOST_BITS = 64, 1 << 18, 1 << 28
#: Classes that share a token beyond which they meet their earliest line first: up to that, all of them meet at once.
CROWD = 16
#: Lines (positions of some 40 bytes) up to which a join broadcasts them: some 60 MB with the table's overhead.
BROADCAST_ROWS = 500_000
#: Bytes of the result up to which it is broadcast to the documents, counted with ROW_BYTES for the fixed part of a row.
BROADCAST_BYTES = 64 << 20
ROW_BYTES = 80
#: Characters of a plan's description while the rarity order is part of plans.
PLAN_CHARS = 20_000
#: How tables of hashes are written: a dictionary of them only costs time.
HASHED = {"parquet.enable.dictionary": "false"}
#: Parity of a set's tokens by their low six bits: no two sets differ in fewer tokens than in bits.
PARITY = "aggregate(tokens, 0L, (a, t) -> a ^ shiftleft(1L, CAST(t & 63 AS INT)))"
#: What names a line: its document's id, the hash of the document's text, and its number.
POSITION = ["d", "h", "line"]


def _named(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).alias("d"), F.xxhash64(text).alias("h"), F.split(F.lower(F.col(text)), "\n").alias("lines"))


def _word_hashes(line: Column) -> Column:
    return F.transform(F.regexp_extract_all(line, F.lit(WORD), F.lit(0)), lambda w: F.xxhash64(w))


def _shingles(words: Column) -> Column:
    each = lambda w, i: F.xxhash64(w, *(F.get(words, i + F.lit(k)) for k in range(1, SHINGLE_WORDS)))
    return F.slice(F.transform(words, each), F.lit(1), F.greatest(F.size(words) - (SHINGLE_WORDS - 1), F.lit(1)))


def token_sets(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(d, h, line, k, tokens array<long>): the distinct shingles, rising, of every line with words; k, two longs, names the set."""
    shingles = lambda line: _let(_word_hashes(line), _shingles)
    found = _named(docs, doc_id, text).select("d", "h", F.posexplode(F.transform("lines", shingles)).alias("line", "shingles"))
    sets = found.where(F.size("shingles") >= 1).select(*POSITION, F.sort_array(F.array_distinct("shingles")).alias("tokens"))
    return sets.select(*POSITION, F.struct(F.xxhash64("tokens").alias("a"), F.xxhash64(F.lit(1), "tokens").alias("b")).alias("k"), "tokens")


def _rarity(sets: DataFrame) -> tuple[Column, list[int]]:
    """``rarity_order``, and the counters that are common."""
    counted = sets.select(F.explode("tokens").alias("s")).groupBy(_counter(F.col("s")).alias("bucket")).count().collect()
    counts = [0] * BUCKETS
    for row in counted:
        counts[row.bucket] = row["count"]
    order = sorted(range(BUCKETS), key=lambda b: (counts[b], b))
    middle, upper = counts[order[BUCKETS // 2]], counts[order[BUCKETS * 21 // 25]]
    spread = max(math.sqrt(middle), upper - middle)  # a standard deviation, were the counts normal; copies widen it
    # the rest, as sort_array has it: negative tokens first
    classes = [0 if b >= BUCKETS // 2 else 1 for b in range(max(16, BUCKETS))]
    common = []
    for rank, bucket in enumerate(order):
        class_ = (BUCKETS // (BUCKETS - rank)).bit_length() - 1
        if class_ >= LEAST_CLASS and counts[bucket] > middle + DEVIATIONS * spread:
            classes[bucket] = min(15, class_)
            common.append(bucket)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    # the first counter in the highest bits; the top bit of a class is the sign: class 0 comes first
    words = [signed(sum((c ^ 8) << 60 - 4 * k for k, c in enumerate(classes[w : w + 16]))) for w in range(0, len(classes), 16)]
    return F.from_json(F.lit(json.dumps(words)), "array<bigint>"), common


def rarity_order(sets: DataFrame) -> Column:
    """A literal array of each counter's class in four bits, 16 counters a long: 5 and more for those that are common, the class rising
    by one for half of the rest each time; 0 and 1 for all others.

    Only the common counters need to be told apart, and the driver keeps every plan that holds the literal.
    """
    return _rarity(sets)[0]


def _counter(token: Column) -> Column:
    """The number of a token's counter: its high bits."""
    return F.shiftrightunsigned(token, 65 - BUCKETS.bit_length()) if BUCKETS > 1 else F.lit(0)


def ordered(tokens: str, classes: Column) -> Column:
    """The tokens as longs that sort by rarity, rarest first: the class of the counter, then the upper 60 bits."""
    at = 69 - BUCKETS.bit_length()  # above: the number of the counter's long; the next four bits: its place there
    class_ = lambda s: F.call_function("shiftleft", F.get(classes, F.shiftrightunsigned(s, at)), F.shiftrightunsigned(s, at - 6).bitwiseAND(60).cast("int"))
    return F.sort_array(F.transform(tokens, lambda s: class_(s).bitwiseAND(-1 << 60).bitwiseOR(F.shiftrightunsigned(s, 4))))


def _prefix(classes: Column, common: list[int], length: Column) -> Column:
    """The rarest tokens, rarest first, of which the upper 60 bits count."""
    first = lambda tokens: F.slice(tokens, F.lit(1), length)
    if not common:
        return first("tokens")
    rare = lambda tokens: F.filter(tokens, lambda s: ~_counter(s).isin(common))
    late = F.transform(first(ordered("tokens", classes)), lambda e: F.shiftleft(e, 4))
    take = lambda tokens, otherwise: _let(rare(tokens), lambda found: F.when(F.size(found) >= length, first(found)).otherwise(otherwise))
    # mostly the first few tokens hold enough that are not common, and the others need not be looked at
    return take(F.slice("tokens", F.lit(1), length * 2 + 4), take(F.col("tokens"), late))


def _least_common(n: Column, percent: int) -> Column:
    return F.floor((n * percent + 99) / 100).cast("int")


def _could_match(nx: Column, px: Column, ny: Column, py: Column, percent: int) -> Column:
    """Length and positional bounds of two sets that share a token at 0-based places px and py."""
    rest = F.lit(1) + F.least(nx - px, ny - py) - 1
    return (ny * 100 >= nx * percent) & (nx * 100 >= ny * percent) & (rest * (100 + percent) >= (nx + ny) * percent)


def _token(place: Column) -> Column:
    """An entry of ``_prefix`` in 32 bits."""
    return F.hash(F.shiftrightunsigned(place, 4))


def _few_differ(x: str, y: str, percent: int) -> Column:
    """A necessary condition on the parities of similar sets."""
    differ = F.bit_count(F.col(f"{x}.parity").bitwiseXOR(F.col(f"{y}.parity")))
    return differ * (100 + percent) <= (F.col(f"{x}.n") + F.col(f"{y}.n")) * (100 - percent)


def _at(x: str) -> Column:
    return F.struct(*(F.col(f"{x}.{c}").alias(c) for c in POSITION))


def _before(a: str, b: str) -> Column:
    return _at(a) < _at(b)


def _bitmap(keys: DataFrame, n: int) -> tuple[DataFrame, int]:
    """(block, words array<long>): a bitmap of the low bits of the n integers ``key``, 64 words a row; and the number of its bits."""
    bits = max(LEAST_BITS, min(MOST_BITS, 1 << (BITS_EACH * n).bit_length()))
    word = F.shiftright(F.col("key").cast("long").bitwiseAND(bits - 1), 6)
    words = keys.groupBy(word.alias("word")).agg(F.expr("bit_or(shiftleft(1L, CAST(key & 63 AS INT)))").alias("bits"))
    slot = F.struct(F.col("word").bitwiseAND(63).cast("int").alias("slot"), "bits")
    blocks = words.groupBy(F.shiftright("word", 6).alias("block")).agg(F.map_from_entries(F.collect_list(slot)).alias("found"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: F.coalesce(F.try_element_at("found", k), F.lit(0).cast("long")))
    return blocks.select("block", dense.alias("words")), bits


def _marked(rows: DataFrame, key: Column, bitmap: DataFrame, bits: int) -> DataFrame:
    """``rows`` with ``marked``: false only where ``key`` is none of the bitmap's. Nothing is shuffled: a bitmap is at most some 40 MB."""
    found = rows.withColumn("__bit", key.cast("long").bitwiseAND(bits - 1)).join(F.broadcast(bitmap), F.shiftright("__bit", 12) == F.col("block"), "left")
    word = F.get("words", F.shiftright("__bit", 6).bitwiseAND(63).cast("int"))
    return found.withColumn("marked", F.coalesce(F.getbit(word, F.col("__bit").bitwiseAND(63).cast("int")) == 1, F.lit(False))).drop("__bit", "block", "words")


def _maybe(rows: DataFrame, on: str, keys: DataFrame, n: int, used: list[DataFrame]) -> DataFrame:
    """``rows`` with ``marked``: false only where ``on`` is none of the n keys."""
    bitmap, bits = _bitmap(keys.select(F.xxhash64(on).alias("key")), n)
    used.append(bitmap := materialize(bitmap))
    return _marked(rows, F.xxhash64(on), bitmap, bits)


def _at_some(rows: DataFrame, on: str, keys: DataFrame, used: list[DataFrame]) -> DataFrame:
    """The rows whose ``on`` is among the keys. Of many keys a bitmap tells first which rows need to be shuffled."""
    n = keys.count()
    if n <= BROADCAST_ROWS:
        return rows.join(F.broadcast(keys), on, "left_semi")
    return _maybe(rows, on, keys, n, used).where("marked").drop("marked").join(keys, on, "left_semi")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The classes x of the pairs (x, y) whose sets (at, tokens) reach the similarity, written."""
    used = [pairs := materialize(pairs)]
    if pairs.isEmpty():
        return pairs.select(F.col("x").alias("at"))
    wanted = materialize(pairs.select(F.explode(F.array("x", "y")).alias("at")).distinct())
    used.append(wanted)
    sets = _at_some(sets, "at", wanted, used).dropDuplicates(["at"])
    joined = pairs.join(sets.select(F.col("at").alias("x"), F.col("tokens").alias("tx")), "x").join(sets.select(F.col("at").alias("y"), F.col("tokens").alias("ty")), "y")
    common = F.size(F.array_intersect("tx", "ty"))
    found = materialize(joined.where(common * 100 >= (F.size("tx") + F.size("ty") - common) * percent).select(F.col("x").alias("at")).distinct())
    for table in used:
        drop_table(table)
    return found


def _repeats(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(at) of the lines whose set an earlier line has, and (k, first, rows) of such sets: the earliest line and its rows; each written.

    A line has several rows if its document has, with equal id and text.
    """
    used = [copied := materialize(lines.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("k"))]
    members = _at_some(lines.select("k", F.struct(*POSITION).alias("at")), "k", copied, used)
    used.append(members := materialize(members.groupBy("k", "at").agg(F.count(F.lit(1)).alias("rows"))))
    firsts = materialize(members.groupBy("k").agg(F.min("at").alias("first"), F.min_by("rows", "at").alias("rows")))
    known = F.broadcast(firsts) if firsts.count() <= BROADCAST_ROWS else firsts
    repeats = materialize(members.join(known.select("k", "first"), "k").where("at <> first").select("at"))
    for table in used:
        drop_table(table)
    return repeats, firsts


def _classes(sets: DataFrame, firsts: DataFrame, percent: int) -> DataFrame:
    """(at, parity, n, prefix) of each set (k, at, tokens), at its first line, written."""
    used = [firsts]
    n = F.size("tokens")
    columns = lambda order: ["at", F.expr(PARITY).alias("parity"), n.alias("n"), _prefix(*order, n - _least_common(n, percent) + 1).alias("prefix")]
    if (several := firsts.count()) <= BROADCAST_ROWS:
        known = sets.join(F.broadcast(firsts), "k", "left")
        once = known.where("rows IS NULL OR rows = 1 AND at = first").select("at", "tokens")
        if not firsts.where("rows > 1").isEmpty():
            once = once.unionByName(known.where("rows > 1 AND at = first").select("at", "tokens").dropDuplicates(["at"]))
        classes = once.select(*columns(_rarity(once)))
    else:
        order = _rarity(sets)
        marked = _maybe(sets, "k", firsts, several, used)
        rest = marked.where("marked").select("k", *columns(order)).join(firsts, "k", "left").where("rows IS NULL OR at = first")
        classes = marked.where("NOT marked").select(*columns(order)).unionByName(rest.drop("k", "first", "rows").dropDuplicates(["at"]))
    classes = materialize(classes, HASHED)
    for table in used:
        drop_table(table)
    return classes


@contextmanager
def _short_plans(spark: SparkSession) -> Iterator[None]:
    """Keep the descriptions of plans short meanwhile: each would print the whole rarity order several times, and Spark keeps them on the driver."""
    key = "spark.sql.maxPlanStringLength"
    before = spark.conf.get(key)
    spark.conf.set(key, str(PLAN_CHARS))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def removals(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """(d, h, removed array<int>) of each document, named by id and text hash, that loses lines: their numbers, rising."""
    with _short_plans(docs.sparkSession):
        return _removals(docs, doc_id, text, percent)


def _removals(docs: DataFrame, doc_id: str, text: str, percent: int) -> DataFrame:
    lines = materialize(token_sets(docs, doc_id, text), HASHED)
    sets = lines.select("k", F.struct(*POSITION).alias("at"), "tokens")
    # a class is named by its first line, ``at``
    repeats, firsts = _repeats(lines)
    used = [classes := _classes(sets, firsts, percent)]
    sets = sets.drop("k")

    # tokens of one class only, most of them, go before anything is shuffled
    token = _token(F.col("place_token"))
    often = classes.select(F.explode("prefix").alias("place_token")).select(token.alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    used.append(often := materialize(often))
    seen, bits = _bitmap(often, often.count())
    used.append(seen := materialize(seen))
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / percent))).cast("int")
    entries = classes.select("at", "n", "parity", F.posexplode("prefix").alias("place", "place_token")).withColumn("token", token).drop("place_token")
    entries = _marked(entries, F.col("token"), seen, bits).where("marked")
    entries = materialize(entries.select("token", band.alias("band"), F.struct("at.*", "n", "parity", "place").alias("x")), HASHED)
    crowds = materialize(often.where(F.col("n") > CROWD).select(F.col("key").alias("token")))
    for table in used:
        drop_table(table)
    used = [crowds]
    crowded = _at_some(entries, "token", crowds, used)
    # the earliest line of each token and length, by aggregation and join: a token that many lines share is split
    leaders = crowded.groupBy("token", "band").agg(F.min("x").alias("leader"))

    bounds = lambda x, y: _before(y, x) & _could_match(F.col(f"{x}.n"), F.col(f"{x}.place"), F.col(f"{y}.n"), F.col(f"{y}.place"), percent) & _few_differ(x, y, percent)
    led = crowded.join(leaders, ["token", "band"]).where(bounds("x", "leader"))
    settled = _verified(led.select(_at("x").alias("x"), _at("leader").alias("y")).distinct(), sets, percent)
    open_ = entries.select("token", "x", _at("x").alias("at")).join(settled, "at", "left_anti")
    met = open_.join(entries.select("token", F.col("x").alias("y")), "token").where(bounds("x", "y"))
    later = _verified(met.select(_at("x").alias("x"), _at("y").alias("y")).distinct(), sets, percent)
    for table in (lines, entries, *used):
        drop_table(table)
    # lines that repeat an earlier one go, and first lines of classes with a match
    gone = repeats.unionByName(settled).unionByName(later).select("at.*")
    gone = materialize(gone.groupBy("d", "h").agg(F.sort_array(F.collect_set("line")).alias("removed")))
    for table in (repeats, settled, later):
        drop_table(table)
    return gone


def _with_removed(rows: DataFrame, gone: DataFrame, d: str, h: str) -> DataFrame:
    """``rows`` with ``removed``, null where a document loses nothing: broadcast up to BROADCAST_BYTES, else joined by document."""
    size = gone.agg(F.coalesce(F.sum(ROW_BYTES + 4 * F.size("removed")), F.lit(0)).alias("bytes")).first()
    small = F.broadcast(gone) if size.bytes <= BROADCAST_BYTES else gone
    return rows.join(small, F.col(d).eqNullSafe(gone["d"]) & (F.col(h) == gone["h"]), "left")


def _without(parts: Column, removed: Column) -> Column:
    """The parts between the removed places, in time that is linear in their number."""
    between = lambda p, at: F.flatten(F.transform(F.sequence(F.lit(1), F.size(at) - 1), lambda i: F.slice(p, F.get(at, i - 1) + 2, F.get(at, i) - F.get(at, i - 1) - 1)))
    bounds = lambda p: F.concat(F.array(F.lit(-1)), removed, F.array(F.size(p)))
    return _let(parts, lambda p: _let(bounds(p), lambda at: between(p, at)))


def _let(value: Column, body) -> Column:
    """body(value), the value computed once a row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def judged_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """doc_id, n_lines and ``removed`` array<int> (numbers from 0) of every row.

    A null text has no lines; an empty one has one, which stays. Rows with equal id and text are one document and lose
    the same lines. Order is by doc_id (null first), then text hash, then line.
    """
    gone = removals(docs, doc_id, text, percent)
    breaks = F.octet_length(text) - F.octet_length(F.replace(F.col(text), F.lit("\n"), F.lit("")))
    rows = docs.select(F.col(doc_id).alias("__d"), F.xxhash64(text).alias("__h"), F.coalesce(breaks + 1, F.lit(0)).cast("long").alias("n_lines"))
    joined = _with_removed(rows, gone, "__d", "__h")
    return joined.select(F.col("__d").alias("doc_id"), "n_lines", F.coalesce("removed", F.array().cast("array<int>")).alias("removed"))


def clean(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT, drop_emptied: bool = True) -> DataFrame:
    """The documents with their own columns, without the removed lines.

    ``drop_emptied`` drops documents that lost lines and have only blank ones left; null and empty texts stay as they are.
    """
    gone = removals(docs, doc_id, text, percent)
    columns = docs.columns
    inner = docs.select(*(F.col(f"`{c}`").alias(f"__{k}") for k, c in enumerate(columns)), F.xxhash64(text).alias("__h"))
    id_, body = f"__{columns.index(doc_id)}", f"__{columns.index(text)}"
    left = F.array_join(_without(F.split(body, "\n"), F.col("removed")), "\n")
    made = _with_removed(inner, gone, id_, "__h").withColumn("__new", F.when(F.col("removed").isNull(), F.col(body)).otherwise(left))
    if drop_emptied:
        made = made.where(F.col("removed").isNull() | F.col("__new").rlike("\\S"))
    return made.select(*(F.col("__new" if f"__{k}" == body else f"__{k}").alias(c) for k, c in enumerate(columns)))
