"""How far the sources of a language are from each other and from the language, term by term (operator 11).

Terms are found and counted inside tasks by a pointer sort. A shard is a run of whole texts in Arrow
buffers. Each term start becomes a pointer into the shard's bytes, and the pointers go through a
multikey quicksort: eight bytes of the terms are the digit, numpy's quicksort orders a digit, and only
slices of equal digits whose terms go on are sorted by the next eight bytes. A run of equal terms is
then one term, and its pointers, in the order of their texts, yield its count and its document
frequency for every (language, source) group. Spark adds up what the shards found, so a source with a
third of all texts, or a term in all of them, is a few rows per shard.

With counts in whole numbers, ``p = 1 + floor(SCALE * (count + 1) / (N + V))`` and the divergence of one
term is ``floor((p - q) * (p - q) / q)``. Both are computed in 64 bits without overflow while a language
has fewer than 9e15 terms. Summing over all V terms for each two sources of a language does not touch
V entries per pair:

* where neither source has the term, all terms give the same value;
* where one has it, the value depends on its count alone, so each source's *levels* (how many terms it
  has so often) meet the sources of their language;
* where both have it, the correction is summed in tasks over the sources of that term, and leaves a task
  as one row per pair of sources.

Null texts, languages and sources are ''. Texts without terms still make their group occur; a language
without kept terms has V = 0, pair values of 0 and no term rows. Rows that repeat an id are documents
each. An empty table gives no rows. A text longer than a shard is a shard of its own: memory is about
forty times its number of terms. Other columns are not read.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textforge.llm import bytes as tb
from textforge.llm.common import join_small, map_slices, materialise

SCALE = 1_000_000_000
MIN_DOCS = 3
TOP_TERMS = 200
SHARD_BYTES = 8 << 20
DIGIT = 8

_LETTER = np.zeros(256, bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = _LETTER[0x80:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def digits(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The next eight bytes of every term as one number that orders like them; zeros after its end.

    ``data`` has ``DIGIT`` bytes to spare behind the last term.
    """
    out = np.zeros(len(starts), np.uint64)
    for first in range(0, len(starts), tb.BLOCK):
        start, end, value = starts[first : first + tb.BLOCK], ends[first : first + tb.BLOCK], out[first : first + tb.BLOCK]
        for k in range(DIGIT):
            value <<= np.uint64(8)
            value |= np.where(start + k < end, data[start + k], 0).astype(np.uint64)
    return out


def pointer_sort(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Multikey quicksort of the terms: their order, and the number of the run of equal terms of each place."""
    padded = np.append(data, np.zeros(DIGIT, np.uint8))
    order = np.arange(len(starts), dtype=np.int64)
    new_run = np.zeros(len(starts), bool)
    new_run[:1] = True
    places, group, depth = order.copy(), np.zeros(len(starts), np.int64), 0
    while len(places):
        rows = order[places]
        key = digits(padded, starts[rows] + depth, ends[rows])
        by = np.argsort(key)
        by = by[np.argsort(group[by], kind="stable")] if depth else by
        order[places], key, group = rows[by], key[by], group[by]
        differs = np.ones(len(places), bool)
        differs[1:] = (key[1:] != key[:-1]) | (group[1:] != group[:-1])
        new_run[places[differs]] = True
        # Slices of equal digits go on while any of their terms does; those that ended come first.
        depth += DIGIT
        slice_of = np.cumsum(differs) - 1
        longer = ends[order[places]] - starts[order[places]] > depth
        goes_on = (np.bincount(slice_of, longer) > 0)[slice_of] & (np.bincount(slice_of)[slice_of] > 1)
        places, group = places[goes_on], slice_of[goes_on]
    return order, np.cumsum(new_run) - 1


def shard_counts(data: np.ndarray, offsets: np.ndarray, groups: np.ndarray) -> dict[str, np.ndarray]:
    """Count and document frequency of every (group, term) of a shard; ``groups`` has a number per text."""
    data = _LOWER[data]
    starts, ends, of_text = tb.words(data, offsets, ~_LETTER)
    order, run = pointer_sort(data, starts, ends)
    n_texts = max(len(offsets) - 1, 1)
    rank = np.argsort(np.argsort(groups, kind="stable"), kind="stable")  # texts of a group stand together
    key = np.sort(run * n_texts + rank[tb.owner(of_text)[order]])
    heads = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    times = np.diff(np.append(heads, len(key)))  # occurrences in one text
    run_of, text_of = key[heads] // n_texts, np.argsort(rank)[key[heads] % n_texts]
    head = np.ones(len(heads), bool)
    head[1:] = (run_of[1:] != run_of[:-1]) | (groups[text_of][1:] != groups[text_of][:-1])
    first = np.flatnonzero(head)
    spelled = order[np.searchsorted(run, run_of[first])] if len(first) else first
    return {
        "group": groups[text_of[first]],
        "start": starts[spelled],
        "end": ends[spelled],
        "n": np.add.reduceat(times, first) if len(first) else first,
        "n_docs": np.diff(np.append(first, len(heads))),
        "data": data,
    }


def _strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    sizes = ends - starts
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    at = np.repeat(starts - offsets[:-1], sizes) + np.arange(offsets[-1])
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data[at].tobytes()))


def term_counts(docs: DataFrame) -> DataFrame:
    """``(lang, source, term, n, n_docs)`` over all ``(lang, source, text)``, summed over the shards."""

    def each(rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> dict:
        names, groups = {}, np.empty(rows.num_rows, np.int64)
        for i, pair in enumerate(zip(rows.column("lang").to_pylist(), rows.column("source").to_pylist())):
            groups[i] = names.setdefault(pair, len(names))
        found = shard_counts(data, offsets, groups)
        at = pa.array(found["group"])
        return {
            "lang": pa.array([x[0] for x in names], pa.string()).take(at),
            "source": pa.array([x[1] for x in names], pa.string()).take(at),
            "term": _strings(found["data"], found["start"], found["end"]),
            "n": found["n"],
            "n_docs": found["n_docs"],
        }

    found = map_slices(docs, each, "lang string, source string, term string, n long, n_docs long", limit=SHARD_BYTES)
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("n_docs").alias("n_docs"))


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def share(count: Column, total: Column) -> Column:
    """``1 + floor(SCALE * (count + 1) / total)``, three decimal digits at a time so that nothing overflows."""
    rest, value = count + 1, F.lit(0).cast("long")
    for _ in range(3):
        value = value * 1000 + _div(rest * 1000, total)
        rest = (rest * 1000) % total
    return value + 1


def divergence(p: Column, q: Column) -> Column:
    return _div((p - q) * (p - q), q)


def kept_rows(counts: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """Counts of the kept terms, with the count of the whole language as ``n_lang``."""
    total = counts.groupBy("lang", "term").agg(F.sum("n").alias("n_lang"), F.sum("n_docs").alias("n_docs"))
    return counts.drop("n_docs").join(total.where(F.col("n_docs") >= min_docs).drop("n_docs"), ["lang", "term"])


def group_table(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """Every occurring group: ``(lang, source, v, total, lang_total, p0)``, totals being N + V; p0 is the share of a count of 0."""
    own = rows.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    terms = rows.groupBy("lang", "term").agg(F.first("n_lang").alias("n"))
    langs = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("n").alias("lang_total"))
    found = docs.select("lang", "source").distinct().join(own, ["lang", "source"], "left").join(langs, "lang", "left")
    found = found.na.fill(0, ["v", "total", "lang_total"])
    found = found.withColumn("total", F.col("total") + F.col("v")).withColumn("lang_total", F.col("lang_total") + F.col("v"))
    return found.withColumn("p0", F.when(F.col("v") > 0, share(F.lit(0).cast("long"), F.col("total")))).withColumn("gid", F.monotonically_increasing_id())


def _ranked(found: DataFrame, most: int | None = None) -> DataFrame:
    place = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    ranked = found.withColumn("rank", place)
    return ranked if most is None else ranked.where(F.col("rank") <= most)


def term_part(rows: DataFrame, groups: DataFrame, most: int = TOP_TERMS) -> DataFrame:
    """The terms that a group uses more than its language does, most divergent first."""
    known = join_small(rows, groups.select("lang", "source", "total", "lang_total"), ["lang", "source"], "inner")
    known = known.withColumn("p", share(F.col("n"), F.col("total"))).withColumn("q", share(F.col("n_lang"), F.col("lang_total")))
    found = known.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), divergence(F.col("p"), F.col("q")).alias("value"))
    return _ranked(found, most)


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What terms of two sources add to the pairs of sources: one row per pair and batch."""

    def f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        return (p - q) ** 2 // q

    for batch in batches:
        lists = batch.column(0)
        offsets = lists.offsets.to_numpy()
        offsets, flat = offsets - offsets[0], lists.flatten()
        gid, p, p0 = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("gid", "p", "p0"))
        ids, local = np.unique(gid, return_inverse=True)
        owner = tb.owner(offsets)
        keys, sums = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for k in range(1, int(np.diff(offsets).max(initial=0))):
            i = np.flatnonzero(owner[:-k] == owner[k:])
            for a, b in ((i, i + k), (i + k, i)):
                value = f(p[a], p[b]) - f(p[a], p0[b]) - f(p0[a], p[b]) + f(p0[a], p0[b])
                key = np.concatenate([keys, local[a] * len(ids) + local[b]])
                by = np.argsort(key, kind="stable")
                key, value = key[by], np.concatenate([sums, value])[by]
                heads = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
                keys, sums = key[heads], np.add.reduceat(value, heads) if len(heads) else value
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids[keys // max(len(ids), 1)]), pa.array(ids[keys % max(len(ids), 1)]), pa.array(sums)], names=["a", "b", "value"]
        )


def pair_part(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """For every group, the divergence from each other source of its language, summed over all kept terms."""
    left = groups.select("lang", F.col("gid").alias("a"), F.col("p0").alias("a0"), "v", "total")
    right = groups.select("lang", F.col("gid").alias("b"), F.col("p0").alias("b0"))
    zero = divergence(F.col("a0"), F.col("b0"))
    base = join_small(left, right, ["lang"], "inner").where("a <> b").select("a", "b", F.coalesce(F.col("v") * zero, F.lit(0)).alias("value"))

    levels = rows.groupBy("lang", "source", "n").agg(F.count(F.lit(1)).alias("m"))
    levels = join_small(levels, groups.select("lang", "source", F.col("gid").alias("a"), F.col("p0").alias("a0"), "total"), ["lang", "source"], "inner")
    levels = levels.withColumn("p", share(F.col("n"), F.col("total"))).select("lang", "a", "a0", "p", "m")
    met = join_small(levels, right, ["lang"], "inner").where("a <> b")
    to = F.struct("a", "b", (F.col("m") * (divergence(F.col("p"), F.col("b0")) - zero)).alias("value"))
    fro = F.col("m") * (divergence(F.col("b0"), F.col("p")) - divergence(F.col("b0"), F.col("a0")))
    one = met.select(F.inline(F.array(to, F.struct(F.col("b").alias("a"), F.col("a").alias("b"), fro.alias("value")))))

    known = join_small(rows, groups.select("lang", "source", "gid", "total", "p0"), ["lang", "source"], "inner")
    known = known.select("lang", "term", F.struct("gid", share(F.col("n"), F.col("total")).alias("p"), "p0").alias("x"))
    lists = known.groupBy("lang", "term").agg(F.collect_list("x").alias("xs")).where(F.size("xs") > 1).select("xs")
    both = lists.mapInArrow(_shared, "a long, b long, value long")

    parts = base.unionByName(one.groupBy("a", "b").agg(F.sum("value").alias("value"))).unionByName(both)
    summed = parts.groupBy("a", "b").agg(F.sum("value").alias("value"))
    of = join_small(summed, groups.select(F.col("gid").alias("a"), "lang", "source"), ["a"], "inner")
    named = join_small(of, groups.select(F.col("gid").alias("b"), F.col("source").alias("item")), ["b"], "inner")
    return _ranked(named.select("lang", "source", F.lit("pair").alias("part"), "item", "value"))


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """``(lang, source, part, item, value, rank)``: parts ``pair`` (all ranks) and ``term`` (the first ``TOP_TERMS``)."""
    docs = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))])
    counts = materialise(term_counts(docs), "term-counts")
    rows = materialise(kept_rows(counts), "term-kept")
    groups = materialise(group_table(docs, rows), "term-groups")
    return pair_part(rows, groups).unionByName(term_part(rows, groups))
