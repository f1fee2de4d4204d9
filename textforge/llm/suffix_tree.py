"""Language-model scores from a probabilistic suffix tree (operator 9).

A text is its words in lower case (ASCII), each followed by a space, and an end symbol; symbols are
bytes. The states of the tree are contexts of up to ``DEPTH`` symbols. Counts of all contexts come from
all training texts: each task counts what it reads, Spark adds up. A context of a kept state becomes a
state if the divergence of its next symbols from those of its suffix, times its count, is at least
``GAIN`` per kind of next symbol, however many there are. The next-symbol distribution of a state is smoothed with that of its suffix by the number
of kinds it has seen (Witten-Bell), down to the uniform one over 256 bytes. A symbol is scored in the
longest suffix of what stands before it that is a state.

States are tables and grow with the input. Tasks hold the most frequent ones, bounded by ``CACHED``, and for each the
bytes before it that lead to a state they do not hold; a string that meets such a byte is scored by a join with
the tables, once however often it occurs, and its value goes back to the texts by another one. So the bound
decides what is looked up where, and changes no score.

The base score is that of single tokens with add-one smoothing. The ``FREQUENT`` most frequent tokens
(bounded by the parameter) are looked up in tasks; counts of all others are joined on Spark, by word hash.
Texts are read three times and never shuffled. A very long text is one slice in a task: some 100 bytes of memory a symbol.

Held out are ids with ``crc32(id as text) mod 7 = 2``; a null id trains. Null and empty texts have the end
token only. Repeated rows are texts of their own. An empty table, or one without training texts, gives
N = 0, a base of ``log10(1 / (0 + 1 * (0 + 1)))`` = 0 per token, and uniform symbols. Extra columns are
not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructType

from textforge.llm import bytes as tb
from textforge.llm.common import least_count, map_slices, materialise

DEPTH = 5
GAIN = 3.0  # nats per kind of next symbol
CACHED = 1 << 21  # next symbols of states that tasks hold; all others are joined
FREQUENT = 1 << 18
HELD_MODULUS, HELD_REST = 7, 2
COUNTED_AT_ONCE = 1 << 21  # distinct strings a task adds up before it hands them on

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_SPACE, _END = 0x20, 0x0A


def with_split(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    rest = F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(HELD_MODULUS))
    return docs.select(F.col(key).alias("doc_id"), F.coalesce(rest == HELD_REST, F.lit(False)).alias("held_out"), F.col(text).alias("text"))


def symbols(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, of_text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts, each after ``DEPTH`` end symbols as its past, and offsets of the texts."""
    n = len(of_text) - 1
    length = ends - starts + 1
    upto = np.concatenate([[0], np.cumsum(length)])
    offsets = upto[of_text] + np.arange(n + 1) * (DEPTH + 1)
    out = np.full(offsets[-1], _END, np.uint8)
    if len(starts):
        to = offsets[tb.owner(of_text)] + DEPTH + upto[:-1] - upto[of_text[:-1]][tb.owner(of_text)]
        inside = np.arange(upto[-1]) - np.repeat(upto[:-1], length)
        source = np.minimum(np.repeat(starts, length) + inside, len(data) - 1)
        value = _LOWER[data[source]]
        value[upto[1:] - 1] = _SPACE
        out[np.repeat(to, length) + inside] = value
    return out, offsets


def strings(out: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ``DEPTH + 1`` bytes up to each symbol as one number, and the text of each; past symbols excluded."""
    key = np.zeros(max(0, len(out) - DEPTH), np.uint64)
    for k in range(DEPTH + 1):
        key <<= np.uint64(8)
        key |= out[k : k + len(key)]
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[DEPTH:]
    real = np.arange(DEPTH, len(out)) - offsets[text] >= DEPTH
    return key[real], text[real]


def _count_strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def rows() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], names=["string", "n"])

    for _, data, offsets in tb.slices(batches, "text", 1 << 22):
        key, _ = strings(*symbols(data, *tb.words(data, offsets)))
        new, n = np.unique(key, return_counts=True)
        keys, index = np.unique(np.concatenate([keys, new]), return_inverse=True)
        counts = np.bincount(index, np.concatenate([counts, n]), minlength=len(keys)).astype(np.int64)
        if len(keys) > COUNTED_AT_ONCE:
            yield rows()
            keys, counts = keys[:0], counts[:0]
    if len(keys):
        yield rows()


@dataclass(frozen=True)
class CachedStates:
    """The most frequent states. Per depth: ascending contexts, the log10 weight each leaves to its suffix, the bytes
    before it that make a state outside this cache (256 bits in four words), and the log10 of each known next symbol
    under ascending ``context * 256 + symbol``. ``root_elsewhere``: not even the empty context is here."""

    contexts: list[np.ndarray]
    leave: list[np.ndarray]
    deeper: list[np.ndarray]
    pairs: list[np.ndarray]
    logs: list[np.ndarray]
    root_elsewhere: bool

    def lookup(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 of the last symbol of each string, in the longest state that ends the rest, and which strings have a
        longer state outside the cache (their value means nothing). Fast for ascending strings."""
        total = np.zeros(len(key))
        elsewhere = np.zeros(len(key), bool)
        settled = np.zeros(len(key), bool)  # the longest state was met
        left = np.arange(len(key))
        for depth in range(DEPTH, -1, -1):
            contexts, pairs = self.contexts[depth], self.pairs[depth]
            if not len(contexts) or not len(left):
                continue
            pair = key[left] & np.uint64((1 << (8 * (depth + 1))) - 1)
            context = pair >> np.uint64(8)
            at = np.minimum(np.searchsorted(contexts, context), len(contexts) - 1)
            here = np.flatnonzero(contexts[at] == context)
            at = at[here]
            if depth < DEPTH:
                before = (key[left[here]] >> np.uint64(8 * (depth + 1))) & np.uint64(255)
                bits = self.deeper[depth][at, (before >> np.uint64(6)).astype(np.int64)] >> (before & np.uint64(63))
                longer = (bits & np.uint64(1)).astype(bool) & ~settled[left[here]]
            else:
                longer = np.zeros(len(here), bool)
            settled[left[here]] = True
            elsewhere[left[here[longer]]] = True
            place = np.minimum(np.searchsorted(pairs, pair[here]), len(pairs) - 1)
            known = pairs[place] == pair[here]
            total[left[here]] += np.where(known, self.logs[depth][place], self.leave[depth][at])
            stays = np.ones(len(left), bool)
            stays[here[known | longer]] = False
            left = left[stays]
        total[left] += np.log10(1 / 256)
        if self.root_elsewhere:
            elsewhere |= ~settled
        return total, elsewhere


@dataclass(frozen=True)
class SuffixTree:
    """All states, a table per depth ``(context, total, kinds, leave, next)``, ``next`` being a map from each known symbol to
    its count and probability; and the cache of the most frequent ones."""

    states: list[DataFrame]
    cache: CachedStates

    def log10(self, key: np.ndarray) -> np.ndarray:
        """log10 of the last symbol of each string; all states of the tree must fit the cache."""
        value, elsewhere = self.cache.lookup(key)
        if elsewhere.any():
            raise ValueError("states outside the cache: use log10_table")
        return value

    def log10_table(self, asked: DataFrame) -> DataFrame:
        """``(string, value)`` for a table of distinct strings, from the tables of all states."""
        found = asked.select("string", F.lit(0.0).alias("value"), F.lit(False).alias("done"))
        for depth in range(DEPTH, -1, -1):
            here = self.states[depth].select(F.col("context").alias("_c"), F.col("leave").alias("_l"), F.col("next").alias("_n"))
            context = F.shiftright("string", 8).bitwiseAND(F.lit((1 << (8 * depth)) - 1))
            met = found.join(here, context == F.col("_c"), "left").withColumn("_p", F.col("_n")[F.col("string").bitwiseAND(F.lit(255))]["p"])
            more = F.coalesce(F.log10("_p"), F.col("_l"), F.lit(0.0))
            found = met.select(
                "string",
                (F.col("value") + F.when(F.col("done"), 0.0).otherwise(more)).alias("value"),
                (F.col("done") | F.col("_p").isNotNull()).alias("done"),
            )
        return found.select("string", (F.col("value") + F.when(F.col("done"), 0.0).otherwise(float(np.log10(1 / 256)))).alias("value"))


def _string_of(context: str, symbol: str) -> Column:
    return F.shiftleft(context, 8).bitwiseOR(F.col(symbol))


def fit_tree(docs: DataFrame) -> SuffixTree:
    """The tree of the training rows of :func:`with_split`."""
    counted = docs.where("not held_out").select("text").mapInArrow(_count_strings, "string long, n long")
    level = materialise(counted.groupBy("string").agg(F.sum("n").alias("n")), "strings")
    levels = {DEPTH: level}
    for depth in range(DEPTH - 1, -1, -1):
        # Each string without its first byte: the counts of the shorter contexts.
        mask = (1 << (8 * (depth + 1))) - 1
        shorter = levels[depth + 1].groupBy(F.col("string").bitwiseAND(F.lit(mask)).alias("string")).agg(F.sum("n").alias("n"))
        levels[depth] = materialise(shorter, "strings")

    states: list[DataFrame] = []
    for depth in range(DEPTH + 1):
        rows = levels[depth].select("string", F.shiftright("string", 8).alias("context"), F.col("string").bitwiseAND(F.lit(255)).alias("symbol"), "n")
        if depth:
            # A symbol that follows a context also follows its suffix. Each suffix and symbol meets at most 256 rows.
            below = states[-1].select("context", F.col("total").alias("_t"), F.explode("next").alias("_symbol", "_v"))
            below = below.select(_string_of("context", "_symbol").alias("_s"), "_t", F.col("_v.n").alias("_n"), F.col("_v.p").alias("lower"))
            suffix = F.col("string").bitwiseAND(F.lit((1 << (8 * depth)) - 1))
            measured = rows.join(below, suffix == F.col("_s")).groupBy("context").agg(
                F.sum("n").alias("total"),
                F.count(F.lit(1)).alias("kinds"),
                F.sum(F.col("n") * F.log(F.col("n") * F.col("_t") / F.col("_n"))).alias("part"),
            )
            gain = F.col("part") - F.col("total") * F.log("total")
            kept = materialise(measured.where(gain >= GAIN * F.col("kinds")).select("context", "total", "kinds"), "states")
            known = rows.join(kept, "context").join(below.select("_s", "lower"), suffix == F.col("_s"))
        else:
            kept = rows.groupBy("context").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds"))
            known = rows.join(kept, "context").withColumn("lower", F.lit(1 / 256))
        smooth = (F.col("n") + F.col("kinds") * F.col("lower")) / (F.col("total") + F.col("kinds"))
        entry = F.struct("symbol", F.struct("n", smooth.alias("p")))
        grouped = known.groupBy("context", "total", "kinds").agg(F.map_from_entries(F.collect_list(entry)).alias("next"))
        leave = F.log10(F.col("kinds") / (F.col("total") + F.col("kinds"))).alias("leave")
        states.append(materialise(grouped.select("context", "total", "kinds", leave, "next"), "tree"))
    return SuffixTree(states, _cache(states))


def _cache(states: list[DataFrame]) -> CachedStates:
    """States from the largest count down whose next symbols number at most ``CACHED``. A suffix is as frequent as its
    context at least, so suffixes of cached states are cached too."""
    sizes = [s.select(F.col("total").alias("n"), F.explode(F.map_keys("next"))).select("n") for s in states]
    least = least_count(reduce(DataFrame.unionByName, sizes), CACHED)
    cache = CachedStates([], [], [], [], [], states[0].where(F.col("total") < least).count() > 0)
    words = [f"w{k}" for k in range(4)]
    for depth, table in enumerate(states):
        inside = table.where(F.col("total") >= least)
        flat = inside.select("context", "leave", *[F.lit(0).cast("long").alias(w) for w in words])
        if depth < DEPTH:
            byte = F.shiftright("context", 8 * depth).alias("byte")
            outside = states[depth + 1].where(F.col("total") < least)
            outside = outside.select(F.col("context").bitwiseAND(F.lit((1 << (8 * depth)) - 1)).alias("_c"), byte)
            bit = F.expr("shiftleft(1L, CAST(byte % 64 AS INT))")
            deeper = outside.groupBy("_c").agg(*[F.bit_or(F.when(F.floor(F.col("byte") / 64) == k, bit)).alias(w) for k, w in enumerate(words)])
            flat = inside.select("context", "leave").join(deeper, F.col("context") == F.col("_c"), "left")
            flat = flat.select("context", "leave", *[F.coalesce(w, F.lit(0)).alias(w) for w in words])
        rows = flat.toArrow()
        order = np.argsort(rows["context"].to_numpy())
        cache.contexts.append(rows["context"].to_numpy()[order].astype(np.uint64))
        cache.leave.append(rows["leave"].to_numpy()[order])
        cache.deeper.append(np.stack([rows[w].to_numpy()[order].astype(np.int64).view(np.uint64) for w in words], 1))
        pairs = inside.select("context", F.explode("next").alias("symbol", "v")).select(_string_of("context", "symbol").alias("pair"), F.log10("v.p").alias("log")).toArrow()
        order = np.argsort(pairs["pair"].to_numpy())
        cache.pairs.append(pairs["pair"].to_numpy()[order].astype(np.uint64))
        cache.logs.append(pairs["log"].to_numpy()[order])
    return cache


def _count_words(rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> dict | None:
    hashes = tb.span_hashes(_LOWER[data], *tb.words(data, offsets)[:2])
    word, n = np.unique(hashes, return_counts=True)
    return {"word": word.view(np.int64), "n": n} if len(word) else None


def score(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every whole text."""
    split = with_split(docs, key, text)
    tree = fit_tree(split)
    cache = tree.cache
    training = split.where("not held_out")
    counts = map_slices(training.select("text"), _count_words, "word long, n long", limit=1 << 22)
    counts = materialise(counts.groupBy("word").agg(F.sum("n").alias("n")), "words")
    n_train = training.count()
    words, tokens = counts.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    total = tokens + n_train  # with one end per training text
    floor = total + (words + (n_train > 0) + 1)
    least = least_count(counts, FREQUENT)
    frequent = counts.where(F.col("n") >= least).toArrow()
    known = frequent["word"].to_numpy().view(np.uint64)
    order = np.argsort(known)
    known, logs = known[order], np.log10(frequent["n"].to_numpy()[order] + 1.0)

    def each(rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> dict:
        starts, ends, of_text = tb.words(data, offsets)
        n = len(offsets) - 1
        key_, owner = strings(*symbols(data, starts, ends, of_text))
        hashes = tb.span_hashes(_LOWER[data], starts, ends)
        text_ = tb.owner(of_text)
        found, value = np.zeros(len(hashes), bool), np.zeros(len(hashes))
        if len(known):
            at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
            found = known[at] == hashes
            value[found] = logs[at[found]]
        rest = np.flatnonzero(~found)
        different, which = np.unique(key_, return_inverse=True)
        logs_of, elsewhere = cache.lookup(different)
        outside = elsewhere[which]
        logs_of[elsewhere] = 0.0
        far = np.flatnonzero(outside)
        return {
            "doc_id": rows.column(rows.schema.get_field_index("doc_id")),
            "held_out": rows.column(rows.schema.get_field_index("held_out")),
            "n_tokens": np.diff(of_text) + 1,
            "frequent": np.bincount(text_, found, minlength=n).astype(np.int64),
            "part": np.bincount(text_, value, minlength=n),
            "score": np.bincount(owner, logs_of[which], minlength=n),
            "rest": pa.ListArray.from_arrays(
                pa.array(np.searchsorted(text_[rest], np.arange(n + 1)).astype(np.int32)), pa.array(hashes[rest].view(np.int64))
            ),
            "far": pa.ListArray.from_arrays(
                pa.array(np.searchsorted(owner[far], np.arange(n + 1)).astype(np.int32)), pa.array(key_[far].view(np.int64))
            ),
        }

    schema = StructType().add("doc_id", docs.schema[key].dataType).add("held_out", "boolean").add("n_tokens", "long")
    schema = schema.add("frequent", "long").add("part", "double").add("score", "double").add("rest", ArrayType(LongType()))
    schema = schema.add("far", ArrayType(LongType()))
    scored = materialise(map_slices(split, each, schema).withColumn("row", F.monotonically_increasing_id()), "scored", compression="zstd")
    rare = scored.select("row", F.explode("rest").alias("word")).groupBy("row", "word").agg(F.count(F.lit(1)).alias("times"))
    found = rare.join(counts.where(F.col("n") < least), "word").groupBy("row").agg(
        F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("more_part")
    )
    strings_ = scored.select("row", F.explode("far").alias("string")).groupBy("row", "string").agg(F.count(F.lit(1)).alias("times"))
    strings_ = materialise(strings_, "far-strings", compression="zstd")
    values = materialise(tree.log10_table(strings_.select("string").distinct()), "far-values")
    far_parts = strings_.join(values, "string").groupBy("row").agg(F.sum(F.col("times") * F.col("value")).alias("far_score"))
    more = F.coalesce("more", F.lit(0))
    end = float(np.log10(n_train + 1.0))
    return scored.join(found, "row", "left").join(far_parts, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("frequent") + more + (1 if n_train else 0)).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("part") + F.coalesce("more_part", F.lit(0.0)) + end - F.col("n_tokens") * float(np.log10(floor))).alias("base_score"),
        (F.col("score") + F.coalesce("far_score", F.lit(0.0))).alias("score"),
    )
