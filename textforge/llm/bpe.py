"""Byte-level BPE encoding and decoding with folds of ranked merges (operator 7).

A pattern cuts a text into words. A word is an array of its bytes (as one-byte characters); a fold over
as many steps as it has bytes joins, at each step, the first of the neighbouring pairs with the lowest
rank, until no pair has one. The fold is a Spark higher-order function and the ranks are a literal map, cut
into small maps by hash, so that a look-up does not scan 50,000 entries.

Words are encoded once, not where they occur. Each task cuts slices of whole texts and writes them as
codes into the slice's list of distinct words. Counts over all slices give the ``FREQUENT`` most frequent
words (bounded by the parameter, 96 of 100 occurrences in the test data); they are folded on Spark once and
sent to the tasks. The other distinct words of a slice get the same merges from :func:`merge_word` in the
task, which keeps what it made of up to ``CACHED_WORDS`` words: the higher-order fold takes some 130 microseconds
a word, which is beyond the limits for millions of rare words. So texts never move, no join brings words back to texts, and only counts are shuffled.

Ids are decoded by joining the binary pieces of each id.

Null and empty texts have no ids. Repeated rows and null ids are rows like any other. A byte without a
rank is an error when it occurs. A very long text is a slice of its own: its task holds its words and codes. An empty table gives an empty table. Extra columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
import zlib
from typing import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructType

from textforge.llm import bytes as tb
from textforge.llm.common import least_count, materialise

SLICE_TEXT = 1 << 22
FREQUENT = 1 << 18
RANK_MAPS = 8_192
SHORT_WORD = 128  # bytes; longer words are merged with a heap
CACHED_WORDS = 1 << 18  # of a task, some 90 MB
_NO_RANK = 1 << 62


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a ``.tiktoken`` file: base64 of the bytes and the rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}


def rank_maps(spark: SparkSession, ranks: dict[bytes, int]) -> Column:
    """The literal rank maps: a one-row table as a scalar, so that plans do not print 50,000 entries."""
    maps: list[dict[str, int]] = [{} for _ in range(RANK_MAPS)]
    for piece, rank in ranks.items():
        letters = piece.decode("latin-1")
        maps[zlib.crc32(letters.encode()) % RANK_MAPS][letters] = rank
    row = spark.createDataFrame([(json.dumps(maps),)], "ranks string")
    return row.select(F.from_json("ranks", "array<map<string,int>>")).scalar()


def rank_in(maps: Column) -> Callable[[Column], Column]:
    """Look-up of a string of one-byte characters in the rank maps; null if it has no rank."""
    return lambda piece: F.element_at(F.get(maps, F.pmod(F.crc32(piece), F.lit(RANK_MAPS)).cast("int")), piece)


def encode_word(word: Column, rank: Callable[[Column], Column]) -> Column:
    """Ids of a word (a string): the fold of ranked merges."""
    letters = F.decode(F.encode(word, "utf-8"), "ISO-8859-1")
    size = F.length(letters)
    one_by_one = F.transform(F.sequence(F.lit(1), size), lambda i: F.substring(letters, i, F.lit(1)))

    def merge(parts: Column, at: Column) -> Column:
        joined = F.array(F.concat(F.element_at(parts, at), F.element_at(parts, at + 1)))
        return F.concat(F.slice(parts, F.lit(1), at - 1), joined, F.slice(parts, at + 2, F.size(parts)))

    def step(parts: Column, _: Column) -> Column:
        after = F.slice(parts, F.lit(2), F.size(parts))
        ranks = F.zip_with(parts, after, lambda left, right: rank(F.concat(left, right)))
        first = F.transform(F.array(ranks), lambda r: F.array_position(r, F.array_min(r)).cast("int"))
        merged = F.transform(first, lambda at: F.when(at > 0, merge(parts, at)).otherwise(parts))
        return F.when(F.size(parts) < 2, parts).otherwise(F.element_at(merged, 1))

    folded = F.aggregate(F.sequence(F.lit(1), size), one_by_one, step)
    ids = F.transform(folded, lambda p: F.coalesce(rank(p), F.raise_error(F.lit("a byte without a rank")).cast("int")))
    whole = rank(letters)
    none = F.array().cast("array<int>")
    return F.when(size == 0, none).when(whole.isNotNull(), F.array(whole)).otherwise(ids)


def merge_word(word: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """Ids of a word by the same merges: lowest rank first, leftmost among equals.

    A short word keeps the ranks of its pairs in a list, of which a merge changes two. In a long word, pairs wait
    in a heap, so that any length costs n log n.
    """
    whole = ranks.get(word)
    if whole is not None or not word:
        return (whole,) if word else ()
    n = len(word)
    if n <= SHORT_WORD:
        get = ranks.get
        parts = [word[i : i + 1] for i in range(n)]
        pairs = [get(word[i : i + 2], _NO_RANK) for i in range(n - 1)]
        while pairs:
            least = min(pairs)
            if least == _NO_RANK:
                break
            at = pairs.index(least)
            parts[at] += parts.pop(at + 1)
            del pairs[at]
            if at:
                pairs[at - 1] = get(parts[at - 1] + parts[at], _NO_RANK)
            if at < len(pairs):
                pairs[at] = get(parts[at] + parts[at + 1], _NO_RANK)
        return tuple([ranks[x] for x in parts])
    ends, before, waiting = list(range(1, n + 1)), list(range(-1, n - 1)), []

    def offer(start: int) -> None:
        middle = ends[start]
        if middle < n:
            rank = ranks.get(word[start : ends[middle]])
            if rank is not None:
                heapq.heappush(waiting, (rank, start, ends[middle]))

    for start in range(n):
        offer(start)
    while waiting:
        _, start, end = heapq.heappop(waiting)
        middle = ends[start]
        if not middle or middle >= n or ends[middle] != end:
            continue  # one of the two has been joined with another part meanwhile
        ends[start], ends[middle] = end, 0
        if end < n:
            before[end] = start
        offer(start)
        if before[start] >= 0:
            offer(before[start])
    ids, start = [], 0
    while start < n:
        ids.append(ranks[word[start : ends[start]]])
        start = ends[start]
    return tuple(ids)


def word_slices(docs: DataFrame, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per slice: ids of its texts, their numbers of words, codes, and the distinct words with counts."""
    doc_type = docs.schema[key].dataType
    schema = StructType().add("doc_ids", ArrayType(doc_type)).add("sizes", ArrayType(IntegerType())).add("codes", "binary")
    schema = schema.add("words", ArrayType(StringType())).add("times", ArrayType(LongType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = regex.compile(pattern).findall
        for rows, data, offsets in tb.slices(batches, text, SLICE_TEXT):
            raw, places, sizes, parts = data.tobytes(), {}, [], []
            for a, b in zip(offsets[:-1], offsets[1:]):
                found = [places.setdefault(w, len(places)) for w in find(raw[a:b].decode())]
                sizes.append(len(found))
                parts.append(np.array(found, np.uint32))
            codes = np.concatenate(parts)
            times = np.bincount(codes, minlength=len(places))
            # Frequent words get small codes, which compress well.
            order = np.argsort(-times, kind="stable")
            codes = np.argsort(order, kind="stable").astype(np.uint32)[codes] if len(order) else codes
            words = list(places)
            columns = [
                pa.array([rows.column(rows.schema.get_field_index(key)).to_pylist()], pa.list_(to_arrow_type(doc_type))),
                pa.array([sizes], pa.list_(pa.int32())),
                pa.array([codes.tobytes()], pa.binary()),
                pa.array([[words[i] for i in order]], pa.list_(pa.string())),
                pa.array([times[order]], pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.select(key, text).mapInArrow(run, schema)


class WordCache:
    """What is made of a word, kept for the next slices of the task; emptied when ``most`` words are in it."""

    def __init__(self, make: Callable[[str], object], most: int = CACHED_WORDS) -> None:
        self.make, self.most, self.words = make, most, {}

    def all(self, words: list[str]) -> list:
        if len(self.words) + len(words) > self.most:
            self.words.clear()
        kept, make = self.words, self.make
        for word in words:
            if word not in kept:
                kept[word] = make(word)
        return [kept[word] for word in words]


def _slices(batches: Iterator[pa.RecordBatch], cache: WordCache) -> Iterator[tuple[list, list, np.ndarray, list]]:
    """Per slice: document ids, sizes, codes, and what the cache has of each of its distinct words."""
    for batch in batches:
        get = {n: batch.column(batch.schema.get_field_index(n)) for n in batch.schema.names}
        for i in range(batch.num_rows):
            made = cache.all(get["words"][i].as_py())
            yield get["doc_ids"][i].as_py(), get["sizes"][i].as_py(), np.frombuffer(get["codes"][i].as_py(), np.uint32), made


def encoded_slices(docs: DataFrame, ranks: dict[bytes, int], pattern: str, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, dict]:
    """Slices of all texts, and the ids of the frequent words, folded on Spark."""
    slices = materialise(word_slices(docs, pattern, key, text), "bpe-slices", compression="zstd")
    pairs = slices.select(F.explode(F.arrays_zip("words", "times")).alias("p"))
    counts = materialise(pairs.groupBy(F.col("p.words").alias("word")).agg(F.sum("p.times").alias("n")), "bpe-words")
    maps = rank_maps(docs.sparkSession, ranks)
    rank = rank_in(F.col("_ranks"))
    # At most FREQUENT words, in rows of about a thousand: each row carries the ranks once.
    frequent = counts.where(F.col("n") >= least_count(counts, FREQUENT))
    rows = frequent.groupBy(F.pmod(F.xxhash64("word"), F.lit(FREQUENT // 1024 + 1))).agg(F.collect_list("word").alias("words"))
    folded = rows.select("words", maps.alias("_ranks")).select("words", F.transform("words", lambda w: encode_word(w, rank)).alias("ids"))
    folded = materialise(folded, "bpe-frequent")  # all tasks at once; reading it back is cheap
    known = {w: tuple(i) for r in folded.toLocalIterator() for w, i in zip(r["words"], r["ids"])}
    return slices.drop("times"), known


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, ids)`` of every whole text."""
    slices, known = encoded_slices(docs, ranks, pattern, key, text)
    doc_type = docs.schema[key].dataType
    schema = StructType().add("doc_id", doc_type).add("ids", ArrayType(IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordCache(lambda w: known.get(w) or merge_word(w.encode(), ranks))
        for doc_ids, sizes, codes, ids in _slices(batches, cache):
            ends = np.cumsum(sizes)
            rows = [[i for c in codes[e - s : e] for i in ids[c]] for s, e in zip(sizes, ends)]
            yield pa.RecordBatch.from_arrays([pa.array(doc_ids, to_arrow_type(doc_type)), pa.array(rows, pa.list_(pa.int32()))], names=schema.names)

    return slices.mapInArrow(run, schema)


def decode(encoded: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """``(doc_id, bytes)``: the binary pieces of all ids, joined."""
    pieces = {rank: piece for piece, rank in ranks.items()}
    schema = StructType([encoded.schema["doc_id"]]).add("bytes", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            joined = [b"".join([pieces[i] for i in ids]) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(joined, pa.binary())], names=schema.names)

    return encoded.select("doc_id", "ids").mapInArrow(run, schema)


def digest(docs: DataFrame, ranks: dict[bytes, int], pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every whole text, without its ids."""
    slices, known = encoded_slices(docs, ranks, pattern, key, text)
    pieces = {rank: piece for piece, rank in ranks.items()}
    doc_type = docs.schema[key].dataType
    schema = StructType().add("doc_id", doc_type).add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def make(word: str) -> tuple[int, str, bytes]:
            ids = known.get(word) or merge_word(word.encode(), ranks)
            return len(ids), ",".join(map(str, ids)), b"".join([pieces[x] for x in ids])

        for doc_ids, sizes, codes, made in _slices(batches, WordCache(make)):
            counts, listed, decoded = zip(*made) if made else ((), (), ())
            n = np.array(counts, np.int64)
            out, end = [], 0
            for size in sizes:
                part = codes[end : end + size]
                end += size
                at = part.tolist()
                out.append((
                    int(n[part].sum()),
                    hashlib.sha256(",".join([listed[c] for c in at]).encode()).hexdigest(),
                    hashlib.sha256(b"".join([decoded[c] for c in at])).hexdigest(),
                ))
            columns = list(zip(*out)) or [[], [], []]
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc_ids, to_arrow_type(doc_type)), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.string())],
                names=schema.names,
            )

    return slices.mapInArrow(run, schema)
