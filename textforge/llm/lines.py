"""Line dedup (operator 10).

``drop_repeated_runs``, which the query and the pipeline use, removes every repeated run of two or more lines with words.
Two neighbouring lines with words, and what blank lines lie between them, are a pair; a pair that occurs again, in this
text or another, is kept at its first place (smallest id, then place), and its lines are removed everywhere else. A line
that belongs to the first place of one pair stays even if its other pair occurs earlier.

The rolling hash described below cuts the lines with words of a text into content-defined chunks; each chunk takes in the first line
of the next, so every pair lies in one chunk. Chunks are grouped by 128 bits of BLAKE2. One that occurs again is a seed: all
its pairs occur at its first place already. Only the pairs of first places, and of chunks that occur once, are left,
where repeated runs begin and end inside a chunk; they are compared line by line, so a run goes from end to end whatever
stands around it. Before anything is removed, the bytes of each chunk and pair are compared with those of its first place.
Texts move once to meet their chunks and pairs, and those that have some once more, to meet what is confirmed.

``drop_repeated_lines`` compares content-defined chunks of lines only. The lines of a text (split at ``\\n``) are hashed; a rolling hash over the last two line hashes
decides after which lines a chunk ends. The decision depends on those two lines only, so chunks of
a shared passage are the same wherever it stands. A chunk of two or more lines with words that
occurs again, in this text or another, is kept at its first place (smallest id, then place) and
removed everywhere else, after its bytes have been compared with those of the first place.

Chunk hashes, not texts, are grouped; the group of a chunk that is everywhere is reduced to its
first place inside tasks. Texts move twice, to meet their candidate and their removed chunks.

Null text: stays null. Texts are told apart by id and content: rows that repeat both are one
text and keep or lose the same lines. Null ids are ids. A text whose every line goes becomes
empty and stays in the table. Empty tables give empty tables. Extra columns pass through.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from textforge.llm import bytes as tb
from textforge.llm.common import aside, identified, join_identified, map_slices, materialise

MEAN_LINES = 4
MAX_LINES = 64  # a chunk ends here at the latest; the rest of the passage is the next chunk
MIN_LINES = 2


def chunk_bounds(hashes: np.ndarray, line_offsets: np.ndarray, mean: int = MEAN_LINES, most: int = MAX_LINES) -> np.ndarray:
    """First line of every chunk, by the rolling hash of each line and the one before it."""
    n = len(hashes)
    before = np.concatenate([np.zeros(1, np.uint64), hashes[:-1]])
    first = np.zeros(n + 1, bool)
    first[line_offsets[:-1]] = True
    first[n] = True
    before[np.flatnonzero(first[:n])] = 0
    ends = tb.pair(before, hashes) % np.uint64(mean) == 0
    first[1:] |= ends
    at = np.flatnonzero(first)
    length = np.diff(at)
    if len(length) and length.max() > most:
        at = np.concatenate([np.arange(a, a + m, most) for a, m in zip(at[:-1], length)] + [at[-1:]])
    return at


def _chunks(rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> dict | None:
    starts, ends, line_of = tb.lines(data, offsets)
    word_starts, _, _ = tb.words(data, offsets)
    worded = np.searchsorted(word_starts, ends) > np.searchsorted(word_starts, starts)
    hashes = tb.span_hashes(data, starts, ends)
    at = chunk_bounds(hashes, line_of)
    counts = np.concatenate([[0], np.cumsum(worded)])
    use = np.flatnonzero(counts[at[1:]] - counts[at[:-1]] >= MIN_LINES)
    if not len(use):
        return None
    low, high = at[use], at[use + 1]
    text = np.searchsorted(line_of, low, "right") - 1
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(tb.mix(hashes + np.uint64(1)), dtype=np.uint64)])
    index = pa.array(text)
    get = lambda name: rows.column(rows.schema.get_field_index(name)).take(index)
    return {
        "doc_id": get("doc_id"),
        "_h": get("_h"),
        "line": (low - line_of[text]).astype(np.int32),
        "n_lines": (high - low).astype(np.int32),
        "start": starts[low] - offsets[text],
        "size": ends[high - 1] - starts[low],
        "h1": tb.span_hashes(data, starts[low], ends[high - 1]).view(np.int64),
        "h2": (sums[high] - sums[low]).view(np.int64),
    }


def line_chunks(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All chunks of two or more worded lines: place and two hashes, without the text."""
    named = identified(docs, key, text)
    schema = StructType([named.schema["doc_id"]]) .add("_h", "long").add("line", "integer").add("n_lines", "integer")
    schema = schema.add("start", "long").add("size", "long").add("h1", "long").add("h2", "long")
    return map_slices(named, _chunks, schema)


def repeated_chunks(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Chunks to remove: ``(doc_id, _h, removed)``, a list of (line, n_lines) per text."""
    chunks = materialise(line_chunks(docs, key, text), "line-chunks")
    place = F.struct("doc_id", "_h", "line")
    groups = chunks.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    # Written before the join: an exchange of its own lets Spark split a hot chunk.
    groups = materialise(groups.where(F.col("first") != F.col("last")).select("h1", "h2", "first"), "line-groups")
    found = chunks.join(groups, ["h1", "h2"]).select(
        "doc_id", "_h", F.struct("line", "n_lines", "start", "size", "h1", "h2", (place == F.col("first")).alias("is_first")).alias("chunk")
    )
    listed = found.groupBy("doc_id", "_h").agg(F.collect_set("chunk").alias("chunks"))
    texts = join_identified(identified(docs, key, text), listed, "inner")
    pieces = texts.select("doc_id", "_h", F.encode("text", "utf-8").alias("bytes"), F.explode("chunks").alias("c")).select(
        "doc_id", "_h", "c.*", F.substring(F.col("bytes"), F.col("c.start") + 1, F.col("c.size")).alias("piece")
    )
    pieces = materialise(pieces, "line-pieces", compression="zstd")
    firsts = pieces.where("is_first").select("h1", "h2", F.col("piece").alias("first_piece")).dropDuplicates(["h1", "h2"])
    same = pieces.where("not is_first").join(firsts, ["h1", "h2"]).where(F.col("piece") == F.col("first_piece"))
    return same.groupBy("doc_id", "_h").agg(F.collect_set(F.struct("line", "n_lines")).alias("removed"))


def _digests(raw: memoryview, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    found = [hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(starts.tolist(), ends.tolist())]
    return np.frombuffer(b"".join(found), np.int64).reshape(-1, 2)


def _run_chunks(rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> dict | None:
    starts, ends, line_of = tb.lines(data, offsets)
    word_starts, _, _ = tb.words(data, offsets)
    worded = np.flatnonzero(np.searchsorted(word_starts, ends) > np.searchsorted(word_starts, starts))
    text = np.searchsorted(line_of, worded, "right") - 1
    # Pair k is of the worded lines k and k + 1; those that lie in two texts are none.
    use = np.flatnonzero(text[1:] == text[:-1])
    if not len(use):
        return None
    at = chunk_bounds(tb.span_hashes(data, starts[worded], ends[worded]), np.searchsorted(worded, line_of))
    # A chunk has the pairs that begin in it: its own, and that of its last line with the next chunk's first.
    bounds = np.searchsorted(use, at)
    bounds = bounds[np.concatenate([[True], bounds[1:] > bounds[:-1]])]
    raw = memoryview(data.tobytes())

    def spans(first: np.ndarray, last: np.ndarray) -> dict[str, np.ndarray]:
        low, high, home = worded[first], worded[last], text[first]
        halves = _digests(raw, starts[low], ends[high])
        return {
            "line": (low - line_of[home]).astype(np.int32),
            "n_lines": (high - low + 1).astype(np.int32),
            "start": starts[low] - offsets[home],
            "size": ends[high] - starts[low],
            "h1": halves[:, 0].copy(),
            "h2": halves[:, 1].copy(),
        }

    first = use[bounds[:-1]]
    pairs = spans(use, use + 1)
    index = pa.array(text[first])
    get = lambda name: rows.column(rows.schema.get_field_index(name)).take(index)
    listed = pa.StructArray.from_arrays([pa.array(v) for v in pairs.values()], names=list(pairs))
    return {
        "doc_id": get("doc_id"),
        "_h": get("_h"),
        **spans(first, use[bounds[1:] - 1] + 1),
        "pairs": pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), listed),
    }


def run_chunks(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Chunks of worded lines and the pairs in each, which are every pair once: places and digests, without the text."""
    named = identified(docs, key, text)
    span = StructType.fromDDL("line int, n_lines int, start long, size long, h1 long, h2 long")
    schema = StructType([named.schema["doc_id"]]).add("_h", "long")
    schema = StructType([*schema.fields, *span.fields]).add("pairs", ArrayType(span))
    return map_slices(named, _run_chunks, schema)


def repeated_runs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Chunks and pairs whose digest occurs again: ``(doc_id, _h, found)``, a list of spans per text.

    A span ``is_first`` at its first place; ``alone`` if a pair's other places all lie in chunks that are repeated as a whole.
    """
    chunks = materialise(run_chunks(docs, key, text), "line-chunks", compression="zstd")
    place = F.struct("doc_id", "_h", "line")
    groups = chunks.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    # Written before the join: an exchange of its own lets Spark split a hot chunk.
    groups = materialise(groups.where(F.col("first") != F.col("last")).select("h1", "h2", "first"), "line-groups")
    seeds = chunks.drop("pairs").join(groups, ["h1", "h2"]).withColumns({"is_first": place == F.col("first"), "is_pair": F.lit(False), "alone": F.lit(False)})

    left = chunks.join(groups, ["h1", "h2"], "left").where(F.col("first").isNull() | (place == F.col("first")))
    pairs = left.select("doc_id", "_h", F.col("first").isNotNull().alias("again"), F.inline("pairs"))
    pairs = materialise(pairs, "line-pairs", compression="zstd")
    groups = pairs.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.max("again").alias("again"))
    groups = groups.withColumn("alone", F.col("first") == F.col("last")).where("again or not alone").select("h1", "h2", "first", "alone")
    groups = materialise(groups, "line-pair-groups")
    ends = pairs.join(groups, ["h1", "h2"]).withColumns({"is_first": place == F.col("first"), "is_pair": F.lit(True)})

    span = F.struct("line", "n_lines", "start", "size", "h1", "h2", "is_first", "is_pair", "alone").alias("span")
    both = seeds.select("doc_id", "_h", span).unionAll(ends.select("doc_id", "_h", span))
    return both.groupBy("doc_id", "_h").agg(F.collect_set("span").alias("found"))


def same_bytes(pieces: DataFrame) -> DataFrame:
    """The ``pieces`` (``h1``, ``h2``, ``piece``, ``is_first``) that are not first and have the very bytes of the first of their digest."""
    firsts = pieces.where("is_first").select("h1", "h2", F.col("piece").alias("first_piece")).dropDuplicates(["h1", "h2"])
    return pieces.where("not is_first").join(firsts, ["h1", "h2"]).where(F.col("piece") == F.col("first_piece")).drop("first_piece")


def _without(text: bytes, removed: list[dict]) -> tuple[bytes, int]:
    lines = text.split(b"\n")
    gone = set()
    for span in removed:
        gone.update(range(span["line"], span["line"] + span["n_lines"]))
    return b"\n".join([x for i, x in enumerate(lines) if i not in gone]), len(gone)


def drop_repeated_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", count: str | None = None) -> DataFrame:
    """``docs`` with the repeated chunks cut out of ``text``; ``count`` names a column of lines removed."""
    return _cut(docs, repeated_chunks(docs, key, text), key, text, count)


def drop_repeated_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", count: str | None = None) -> DataFrame:
    """``docs`` with the repeated runs of lines cut out of ``text``; ``count`` names a column of lines removed."""
    safe, names = aside(docs)
    met = materialise(_meet(safe, names, repeated_runs(docs, key, text), key, text), "line-met", compression="zstd")
    some = met.where("_tf_found is not null")
    pieces = some.select("_tf_id", "_tf_h", F.encode(names[text], "utf-8").alias("bytes"), F.explode("_tf_found").alias("c")).where("not c.alone")
    pieces = pieces.select("_tf_id", "_tf_h", "c.*", F.substring(F.col("bytes"), F.col("c.start") + 1, F.col("c.size")).alias("piece"))
    same = same_bytes(materialise(pieces, "line-pieces", compression="zstd"))
    again = same.groupBy("_tf_id", "_tf_h").agg(F.collect_set(F.struct("line", "n_lines")).alias("_tf_again"))
    again = again.withColumnsRenamed({"_tf_id": "_tf_o_id", "_tf_h": "_tf_o_h"})

    def of(spans: Column) -> Column:
        return F.flatten(F.transform(spans, lambda s: F.sequence(s["line"], s["line"] + s["n_lines"] - 1)))

    stay = of(F.filter("_tf_found", lambda s: s["is_first"] & s["is_pair"]))
    gone = F.transform(F.array_except(of(F.col("_tf_again")), stay), lambda line: F.struct(line.alias("line"), F.lit(1).alias("n_lines")))
    here = (F.col("_tf_h") == F.col("_tf_o_h")) & F.col("_tf_id").eqNullSafe(F.col("_tf_o_id"))
    changed = some.join(again, here, "left").select(*names.values(), gone.alias("_tf_removed"))
    # Texts in which nothing was found stay as they are and don't pass Python.
    rest = [F.col(names[c]).alias(c) for c in docs.columns if c != count] + ([F.lit(0).cast("long").alias(count)] if count else [])
    return _take_out(changed, docs, names, text, count).unionAll(met.where("_tf_found is null").select(*rest))


def _meet(safe: DataFrame, names: dict[str, str], found: DataFrame, key: str, text: str) -> DataFrame:
    """The rows of a table whose columns have ``names``, with the one list that ``found`` has for each text, and its id and hash."""
    id_, hash_, listed = found.columns
    found = found.select(F.col(id_).alias("_tf_id"), F.col(hash_).alias("_tf_h"), F.col(listed).alias(f"_tf_{listed}"))
    same = F.xxhash64(safe[names[key]], safe[names[text]]) == F.col("_tf_h")
    return safe.join(found, same & safe[names[key]].eqNullSafe(F.col("_tf_id")), "left")


def _cut(docs: DataFrame, removed: DataFrame, key: str, text: str, count: str | None) -> DataFrame:
    safe, names = aside(docs)
    return _take_out(_meet(safe, names, removed, key, text).drop("_tf_id", "_tf_h"), docs, names, text, count)


def _take_out(joined: DataFrame, docs: DataFrame, names: dict[str, str], text: str, count: str | None) -> DataFrame:
    """``docs`` without the lines listed in ``_tf_removed`` of ``joined``, which has its rows under ``names``."""
    columns = [c for c in docs.columns if c != count]
    schema = StructType([docs.schema[c] for c in columns])
    if count:
        schema = schema.add(count, "long")

    def cut(batches):
        # In slices of whole texts: a batch has up to 10,000 of them, here, in what is sent back and in the JVM that reads it.
        for rows, data, offsets in tb.slices(batches, names[text]):
            gone = rows.column(rows.schema.get_field_index("_tf_removed"))
            texts = rows.column(rows.schema.get_field_index(names[text]))
            counts = np.zeros(rows.num_rows, np.int64)
            if gone.null_count < rows.num_rows:
                new = []
                for k, spans in enumerate(gone):
                    value = data[offsets[k] : offsets[k + 1]].tobytes() if texts[k].is_valid else None
                    if spans.is_valid:
                        value, counts[k] = _without(value, spans.as_py())
                    new.append(value)
                texts = pa.array(new, pa.binary()).cast(texts.type)
            out = [texts if c == text else rows.column(rows.schema.get_field_index(names[c])) for c in columns]
            yield pa.RecordBatch.from_arrays(out + ([pa.array(counts, pa.int64())] if count else []), names=columns + ([count] if count else []))

    return joined.mapInArrow(cut, schema)
