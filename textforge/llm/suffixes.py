"""Removal of long repeated substrings by bucket-pointer refinement (operator 5).

A byte goes if it is covered by a string of ``LENGTH`` bytes that starts anywhere else too. Every
start of such a string is a suffix, and suffixes with equal beginnings share a bucket. As in
bucket-pointer refinement, the bucket of a longer beginning is named by the buckets of two shorter
ones: that of the suffix itself and that of the suffix at a later offset,
``name(2m, p) = f(name(m, p), name(m, p + m))``. The names of one round are used again by the next
one, only suffixes in buckets of two or more are refined, and a suffix alone in its bucket is done.

1. Names of ``GRAM`` bytes are built by doubling, inside the task that holds the text. Of all
   suffixes, only *anchors* enter the first buckets: the smallest name in each stretch of a
   ``LENGTH``-byte string (leftmost if equal). Equal strings have equal anchors at equal offsets, so a
   string whose anchor is alone in its bucket occurs once. An anchor stands for a run of starts.
2. Buckets of two or more are refined by the name of the whole stretch the run covers. Runs that
   still share a bucket are repeated at every start.
3. The others (the ends of passages) are refined in blocks of 32, 4 and 1 starts, together with one run
   of every kind in the same first bucket: a block is repeated if the name of all its bytes is, alone if
   the name of what its strings have in common is, and otherwise goes on to the next round.

Buckets hold names and places, never texts; counts are combined inside tasks, and no task gathers a
bucket. Names have 128 bits where they decide. Texts move twice, to meet their places.

Shorter passages are found in the first buckets of the same pass: with ``shorter`` bytes given, the anchors
of strings of that length enter too (those of the longer strings are among them), and ``n_shared`` counts the anchors
of a text whose ``GRAM`` bytes are an anchor of another text as well. It is above 0 for every text that has ``shorter``
bytes in common with another one, and 0 for every text that has no ``GRAM`` bytes in common with another; the bytes
that go do not depend on it.

Null texts are empty. Rows that repeat an id and a text are documents of their own, so their bytes
from ``LENGTH`` on repeat each other. Null ids are ids. Texts shorter than ``LENGTH`` bytes are kept
whole. A very long text is one slice of its task: its working arrays take some 60 bytes a byte of text.
Empty tables give empty tables; extra columns pass through.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from textforge.llm import bytes as tb
from textforge.llm.common import aside, identified, join_identified, map_slices, materialise

LENGTH = 400
SHORTER = 256  # bytes of a passage that a text shares with another one: some 45 words
GRAM = 128
SEGMENT = 1 << 16
ROUNDS = (32, 4, 1)  # starts that are refined together, round by round
_PLACE_BITS = np.uint64(17)  # a place inside a segment and what it looks ahead
_KA, _KB = np.uint64(0x9FB21C651E98DF25), np.uint64(0xD6E8FEB86659FD93)


def refine(names: np.ndarray, later: int) -> np.ndarray:
    """Bucket names of every suffix from its own and that of the suffix ``later`` bytes on."""
    out = names[:-later] * _KA
    out += names[later:] * _KB
    out ^= out >> np.uint64(32)
    return out


def gram_names(data: np.ndarray) -> np.ndarray:
    """Names of the ``GRAM`` bytes at each position, by doubling."""
    names, size = tb._BYTE_CODE[data], 1
    while size < GRAM:
        names = refine(names, size)
        size *= 2
    return names


def string_names(data: np.ndarray, length: int) -> np.ndarray:
    """Names of the ``length`` bytes at each position; GRAM <= length <= 4 * GRAM."""
    names, size = gram_names(data), GRAM
    while size < length:
        step = min(size, length - size)
        names = refine(names, step)
        size += step
    return names


def _window_min(keys: np.ndarray, size: int) -> np.ndarray:
    """Minimum of every ``size`` consecutive keys."""
    span = 1
    while 2 * span <= size:
        keys = np.minimum(keys[:-span], keys[span:])
        span *= 2
    return np.minimum(keys[: len(keys) - (size - span)], keys[size - span :]) if size > span else keys


def anchors(data: np.ndarray, length: int) -> np.ndarray:
    """Position of the anchor of the string that starts at each position."""
    n = len(data) - length + 1
    out = np.empty(max(n, 0), np.int64)
    low = (np.uint64(1) << _PLACE_BITS) - np.uint64(1)
    for at in range(0, n, SEGMENT):
        part = data[at : min(at + SEGMENT, n) + length - 1]
        keys = gram_names(part)
        keys &= ~low
        keys |= np.arange(len(keys), dtype=np.uint64)
        best = _window_min(keys, length - GRAM + 1)
        out[at : at + len(best)] = (best & low).astype(np.int64) + at
    return out


def _named(rows: pa.RecordBatch, index: np.ndarray) -> dict:
    index = pa.array(index)
    return {c: rows.column(rows.schema.get_field_index(c)).take(index) for c in ("doc_id", "_h")}


def _starts(size: int, offsets: np.ndarray, length: int) -> np.ndarray:
    """Where a string of ``length`` bytes starts that lies inside one text."""
    valid = np.zeros(size, bool)
    for a, b in zip(offsets[:-1], offsets[1:]):
        if b - a >= length:
            valid[a : b - length + 1] = True
    return np.flatnonzero(valid)


def _runs(length: int, shorter: int | None):
    def each(rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> dict | None:
        long = _long(rows, data, offsets)
        if shorter is None:
            return long
        places = np.unique(anchors(data, shorter)[_starts(len(data), offsets, shorter)])
        text = np.searchsorted(offsets, places, "right") - 1
        if long is not None:
            places, text = places[new := ~np.isin(places, long["anchor"])], text[new]
        if not len(places):
            return long
        none = np.zeros(len(places), np.int32)
        short = _named(rows, text) | {
            "low": places - offsets[text],
            "n": none,
            "rel": none,
            "key": tb.span_hashes(data, places, places + GRAM).view(np.int64),
            "whole": pa.nulls(len(places), pa.int64()),
        }
        if long is None:
            return short
        return {c: pa.concat_arrays([pa.array(x) if isinstance(x, np.ndarray) else x for x in (long[c], short[c])]) for c in short}

    def _long(rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> dict | None:
        at = anchors(data, length)
        starts = _starts(len(data), offsets, length)
        if not len(starts):
            return None
        new = np.ones(len(starts), bool)
        new[1:] = (starts[1:] != starts[:-1] + 1) | (at[starts[1:]] != at[starts[:-1]])
        low = starts[new]
        high = np.append(starts[np.flatnonzero(new)[1:] - 1], starts[-1])
        # A text may follow another one at once; a run never spans both.
        text = np.searchsorted(offsets, low, "right") - 1
        anchor = at[low]
        key = tb.span_hashes(data, anchor, anchor + GRAM)
        whole = tb.pair(tb.span_hashes(data, low, high + length), (anchor - low).astype(np.uint64))
        return _named(rows, text) | {
            "low": low - offsets[text],
            "n": (high - low + 1).astype(np.int32),
            "rel": (anchor - low).astype(np.int32),
            "key": key.view(np.int64),
            "whole": whole.view(np.int64),
            "anchor": anchor,
        }

    return each


def anchor_runs(named: DataFrame, length: int = LENGTH, shorter: int | None = None) -> DataFrame:
    """First buckets: one row per anchor with its run of starts ``low .. low + n - 1``.

    Anchors of the ``shorter`` strings only have no run: ``whole`` is null and ``low`` is their place.
    """
    schema = StructType([named.schema["doc_id"]]).add("_h", "long").add("low", "long").add("n", "integer").add("rel", "integer")
    return map_slices(named, _runs(length, shorter), schema.add("key", "long").add("whole", "long"))


def _pieces(length: int):
    """The bytes around the anchor of every listed run: all its strings, and a block more at either end."""

    def each(rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> dict | None:
        listed = rows.column(rows.schema.get_field_index("runs"))
        text = np.repeat(np.arange(rows.num_rows), np.diff(listed.offsets.to_numpy()))
        if not len(text):
            return None
        flat = listed.flatten()
        run = {c: flat.field(c).to_numpy(zero_copy_only=False) for c in ("low", "n", "rel", "key", "open")}
        anchor = offsets[text] + run["low"] + run["rel"]
        first = np.maximum(offsets[text], anchor - (run["rel"] // ROUNDS[0] + 1) * ROUNDS[0])
        last = np.minimum(offsets[text + 1], anchor - (run["rel"] - run["n"] + 1) // ROUNDS[0] * ROUNDS[0] + length)
        return _named(rows, text) | run | {
            "ahead": anchor - first,
            "piece": pa.array([data[a:b].tobytes() for a, b in zip(first, last)], pa.binary()),
        }

    return each


def _blocks(length: int, block: int):
    """Names of the strings that decide a block of starts, for the blocks asked for (all, if null).

    A start is known by its distance to the anchor, so the blocks of different runs line up. If the
    string over all of a block's strings (``all``) repeats, each of them does; if what they have in
    common (``core``) does not, none of them does.
    """

    def each(rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> dict | None:
        get = lambda c: rows.column(rows.schema.get_field_index(c))
        rel, n = get("rel").to_numpy(), get("n").to_numpy()
        todo = get("todo")
        low, high = (rel - n + 1) // block, rel // block
        if todo.null_count:
            count = high - low + 1
            run = np.repeat(np.arange(len(rel)), count)
            at = np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count) + low[run]
        else:
            run = np.repeat(np.arange(len(rel)), np.diff(todo.offsets.to_numpy()))
            at = todo.flatten().to_numpy()
            inside = (at >= low[run]) & (at <= high[run])
            run, at = run[inside], at[inside]
        if not len(run):
            return None
        anchor = offsets[run] + get("ahead").to_numpy()[run]
        core_start, all_start = anchor - at * block, anchor - at * block - block + 1
        core = string_names(data, length - block + 1)[core_start]
        names = string_names(data, length + block - 1)
        fits = (all_start >= offsets[run]) & (all_start + length + block - 1 <= offsets[run + 1])
        whole = np.zeros(len(run), np.uint64)
        whole[fits] = names[all_start[fits]]
        place = get("low").to_numpy()[run] + rel[run] - at * block
        return _named(rows, run) | {
            "run": get("run").take(pa.array(run)),
            "key": get("key").take(pa.array(run)),
            "open": get("open").take(pa.array(run)),
            "block": at.astype(np.int32),
            "core": core.view(np.int64),
            "all": pa.array(whole.view(np.int64), pa.int64(), mask=~fits),
            "start": place - block + 1,
            "end": place + length,
        }

    return each


def _refine_open(pieces: DataFrame, length: int) -> DataFrame:
    """``(doc_id, _h, start, end)`` of repeated strings in open runs, by blocks of falling size."""
    identity = [pieces.schema["doc_id"]]
    schema = StructType(identity).add("_h", "long").add("run", "long").add("key", "long").add("open", "boolean")
    schema = schema.add("block", "integer").add("core", "long").add("all", "long").add("start", "long").add("end", "long")
    todo = pieces.withColumn("todo", F.lit(None).cast("array<int>"))
    found = None
    for block, finer in zip(ROUNDS, (*ROUNDS[1:], None)):
        named = materialise(map_slices(todo, _blocks(length, block), schema, text="piece"), "suffix-blocks", compression="zstd")
        known = named.where("all is not null").groupBy("key", "block", "all").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        known = materialise(known.select("key", "block", "all", F.lit(True).alias("known")), "suffix-known")
        marked = named.join(known, ["key", "block", "all"], "left")
        if finer:
            marked = materialise(marked, "suffix-marked", compression="zstd")
        repeats = marked.where("open and known").select("doc_id", "_h", "start", "end")
        found = repeats if found is None else found.unionByName(repeats)
        if finer:
            # A block goes on if its core repeats and some open run with that core is undecided.
            undecided = F.count_if(F.col("open") & F.col("known").isNull())
            cores = marked.groupBy("key", "block", "core").agg(F.count(F.lit(1)).alias("n"), undecided.alias("u"))
            cores = materialise(cores.where("n > 1 and u > 0").select("key", "block", "core"), "suffix-cores")
            on = marked.join(cores, ["key", "block", "core"])
            ratio = block // finer
            parts = F.explode(F.sequence(F.col("block") * ratio, F.col("block") * ratio + ratio - 1))
            asked = on.select("run", parts.alias("part")).groupBy("run").agg(F.collect_set("part").alias("todo"))
            todo = pieces.join(asked, "run")
    return found


def repeated_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, shorter: int | None = None) -> DataFrame:
    """``(doc_id, _h, spans, n_shared)``: byte spans ``(start, end)`` that repeated strings cover, and the anchors shared
    with other texts (0 without ``shorter``), for texts that have any."""
    if not 2 * GRAM <= length <= 4 * GRAM - ROUNDS[0]:
        raise ValueError(f"length must be between {2 * GRAM} and {4 * GRAM - ROUNDS[0]}")
    if shorter is not None and not GRAM <= shorter <= length:
        raise ValueError(f"shorter must be between {GRAM} and {length}")
    named = identified(docs, key, text)
    runs = materialise(anchor_runs(named, length, shorter), "suffix-runs", compression="zstd")
    across = F.lit(False) if shorter is None else F.min("_h") != F.max("_h")
    buckets = runs.groupBy("key").agg(F.count("whole").alias("size"), (F.min("whole") != F.max("whole")).alias("mixed"), across.alias("across"))
    # Written before the join: an exchange of its own lets Spark split a hot bucket.
    buckets = materialise(buckets.where("size > 1 or across").select("key", "size", "mixed", "across"), "suffix-buckets")
    listed = runs.join(buckets, "key").where("across or whole is not null")
    listed = materialise(listed, "suffix-shared", compression="zstd")
    shared = listed.where("size > 1 and whole is not null").drop("size", "across")

    # A mixed bucket is refined by the whole stretch: kinds of two or more are done, the rest is open.
    mixed = shared.where("mixed")
    place = F.struct("doc_id", "_h", "low")
    kinds = mixed.groupBy("key", "whole").agg(F.count(F.lit(1)).alias("size"), F.min(place).alias("first"))
    kinds = materialise(kinds, "suffix-kinds")
    refined = mixed.join(kinds, ["key", "whole"]).select(
        "doc_id", "_h", "low", "n", "rel", "key", (F.col("size") == 1).alias("open"), (place == F.col("first")).alias("speaks")
    )
    refined = materialise(refined, "suffix-refined", compression="zstd")
    asked = refined.where("speaks").groupBy("doc_id", "_h").agg(F.collect_set(F.struct("low", "n", "rel", "key", "open")).alias("runs"))
    schema = StructType([named.schema["doc_id"]]).add("_h", "long").add("low", "long").add("n", "integer").add("rel", "integer")
    schema = schema.add("key", "long").add("open", "boolean").add("ahead", "long").add("piece", "binary")
    pieces = map_slices(join_identified(named, asked, "inner"), _pieces(length), schema)
    # One piece for each kind: rows that repeat id and text would give it once for each row.
    pieces = pieces.withColumn("run", F.xxhash64("doc_id", "_h", "low"))
    pieces = materialise(pieces.dropDuplicates(["doc_id", "_h", "low"]), "suffix-pieces", compression="zstd")
    single = _refine_open(pieces, length)

    whole = shared.where("not mixed").select("doc_id", "_h", "low", "n").unionByName(
        refined.where("not open").select("doc_id", "_h", "low", "n")
    )
    settled = whole.select("doc_id", "_h", F.col("low").alias("start"), (F.col("low") + F.col("n") - 1 + length).alias("end"))
    spans = settled.unionByName(single).select("doc_id", "_h", F.struct("start", "end").alias("span"), F.lit(0).alias("n"))
    if shorter is not None:
        # One row per place: rows that repeat id and text are one text here.
        places = listed.where("across").select("doc_id", "_h", (F.col("low") + F.col("rel")).alias("place")).distinct()
        counts = places.groupBy("doc_id", "_h").agg(F.count(F.lit(1)).cast("int").alias("n"))
        spans = spans.unionByName(counts.withColumn("span", F.lit(None).cast(spans.schema["span"].dataType)))
    return spans.groupBy("doc_id", "_h").agg(F.collect_set("span").alias("spans"), F.sum("n").alias("n_shared"))


def covered(size: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """True for each byte inside a span."""
    change = np.zeros(size + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, ends, -1)
    return np.cumsum(change)[:-1] > 0


def _with_spans(docs: DataFrame, key: str, text: str, length: int, shorter: int | None = None) -> DataFrame:
    spans = repeated_spans(docs, key, text, length, shorter).select(
        F.col("doc_id").alias("_tf_id"), F.col("_h").alias("_tf_h"), F.col("spans").alias("_tf_spans"), F.col("n_shared").alias("_tf_shared")
    )
    same = (F.xxhash64(docs[key], docs[text]) == F.col("_tf_h")) & docs[key].eqNullSafe(F.col("_tf_id"))
    return docs.join(spans, same, "left").drop("_tf_id", "_tf_h")


def _masks(batch: pa.RecordBatch, text: str):
    """Bytes of every text and the mask of what goes (None if nothing does)."""
    data, offsets = tb.text_arrays(batch.column(batch.schema.get_field_index(text)))
    spans = batch.column(batch.schema.get_field_index("_tf_spans"))
    has = spans.is_valid().to_numpy(zero_copy_only=False)
    bounds = spans.offsets.to_numpy()
    starts, ends = spans.values.field("start").to_numpy(), spans.values.field("end").to_numpy()
    for i in range(batch.num_rows):
        value = data[offsets[i] : offsets[i + 1]]
        a, b = bounds[i], bounds[i + 1]
        yield value, covered(len(value), starts[a:b], ends[a:b]) if has[i] and b > a else None


def digest_repeats(
    docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, shorter: int | None = SHORTER
) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` (of the remaining bytes), ``n_shared``."""

    def run(batches):
        for batch in batches:
            out = []
            for value, gone in _masks(batch, text):
                if gone is None:
                    out.append((len(value), 0, 0, hashlib.sha256(value).hexdigest()))
                else:
                    n_spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                    out.append((len(value), int(gone.sum()), n_spans, hashlib.sha256(value[~gone].tobytes()).hexdigest()))
            columns = list(zip(*out)) or [[]] * 4
            shared = pc.fill_null(batch.column(batch.schema.get_field_index("_tf_shared")), 0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index(key))] + [pa.array(c, pa.int64()) for c in columns[:3]] + [pa.array(columns[3], pa.string()), shared],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_shared"],
            )

    found = _with_spans(docs.select(key, text), key, text, length, shorter)
    schema = StructType().add("doc_id", docs.schema[key].dataType).add("n_bytes", "long").add("n_removed", "long")
    return found.mapInArrow(run, schema.add("n_spans", "long").add("kept_sha256", "string").add("n_shared", "long"))


def cut_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """``docs`` with the repeated strings cut out of ``text``. A character stays if any byte of it stays."""
    columns = docs.columns
    safe, names = aside(docs)

    def run(batches):
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(names[text]))
            if batch.column(batch.schema.get_field_index("_tf_spans")).null_count < batch.num_rows:
                new = []
                for old, (value, gone) in zip(texts, _masks(batch, names[text])):
                    if gone is None:
                        new.append(old.as_py())
                        continue
                    heads = np.flatnonzero((value & 0xC0) != 0x80)
                    whole = np.logical_and.reduceat(gone, heads)
                    gone = np.repeat(whole, np.diff(np.append(heads, len(value))))
                    new.append(value[~gone].tobytes().decode())
                texts = pa.array(new, texts.type)
            yield pa.RecordBatch.from_arrays(
                [texts if c == text else batch.column(batch.schema.get_field_index(names[c])) for c in columns], names=columns
            )

    return _with_spans(safe, names[key], names[text], length).mapInArrow(run, docs.schema)
