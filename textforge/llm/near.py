"""N-gram Jaccard join with Bayesian pruning (operator 8).

A text is the set of its runs of five words (a shorter text with words: one run of all its words),
compared by 64-bit hashes. Texts with equal sets form one class and go on as one row. Each class has
``BANDS * ROWS`` MinHash values; classes that agree in a whole band meet in a bucket.

Buckets that hold the same classes are one bucket (found from an order-free digest of their members,
never from a list). A large bucket is split into blocks of bounded size, and every two of its blocks
meet in one task. There the MinHash values are compared a few at a time. After each step a pair is
dropped if, given the matches so far and a flat prior, the posterior probability of a similarity of
``threshold`` or more is below ``TOLERANCE``. What is left is verified exactly on the sets. A pair
that meets in several buckets counts in its first band only. Tasks give counts and one edge per
class and local group, not pairs: rows grow with the classes, not with the square of a group.

Null and empty texts have no run, no links, and are classes of their own. Rows that repeat an id and a
text are copies of each other and count as such; where one document is kept, it is one row. Empty tables
give empty tables; extra columns are not read.
"""

from __future__ import annotations

from math import comb
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from textforge.llm import bytes as tb
from textforge.llm.common import aside, identified, join_identified, map_slices, materialise
from textforge.llm.components import components

THRESHOLD = 0.8
BANDS, ROWS = 24, 4
TOLERANCE = 1e-9
BLOCK_TEXTS = 1024
BLOCK_RUNS = 1_000_000
PAIRS_AT_ONCE = 1 << 20

_RNG = np.random.default_rng(8)
_MULTIPLIERS = _RNG.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADDENDS = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def run_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct run hashes of every text, ascending inside a text, and their offsets."""
    starts, ends, of_text = tb.words(data, offsets)
    hashes = tb.span_hashes(data, starts, ends)
    keys, first = tb.windows(hashes, of_text)
    text = tb.owner(of_text)[first]
    n_words = np.diff(of_text)
    short = np.flatnonzero((n_words > 0) & (n_words < tb.WINDOW_WORDS))
    if len(short):
        whole = np.zeros(len(short), np.uint64)
        for k in range(tb.WINDOW_WORDS - 1):
            has = np.flatnonzero(n_words[short] > k)
            whole[has] = tb.pair(whole[has], hashes[of_text[short[has]] + k])
        keys, text = np.concatenate([keys, whole]), np.concatenate([text, short])
    order = np.lexsort((keys, text))
    keys, text = keys[order], text[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (text[1:] != text[:-1])
    keys, text = keys[new], text[new]
    return keys, np.searchsorted(text, np.arange(len(offsets)))


def signatures(keys: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """MinHash values (32 bits) of non-empty sets, a row per set."""
    starts = offsets[:-1]
    out = np.empty((len(starts), BANDS * ROWS), np.uint32)
    work = np.empty(len(keys), np.uint64)
    for k in range(BANDS * ROWS):
        np.multiply(keys, _MULTIPLIERS[k], out=work)
        np.add(work, _ADDENDS[k], out=work)
        out[:, k] = np.minimum.reduceat(work, starts) >> np.uint64(32)
    return out


def _sets(rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> dict | None:
    keys, at = run_sets(data, offsets)
    size = np.diff(at)
    full = np.flatnonzero(size)
    sums = np.zeros((2, len(size)), np.uint64)
    values = np.empty((0, BANDS * ROWS), np.uint32)
    if len(full):
        sums[0, full] = np.add.reduceat(tb.mix(keys), at[full])
        sums[1, full] = np.add.reduceat(tb.mix(keys ^ np.uint64(0x5DEECE66D)), at[full])
        values = signatures(keys, np.append(at[full], len(keys)))
    row = np.cumsum(size > 0) - 1
    get = lambda name: rows.column(rows.schema.get_field_index(name))
    return {
        "doc_id": get("doc_id"),
        "_h": get("_h"),
        "n_runs": size,
        "s1": sums[0].view(np.int64),
        "s2": sums[1].view(np.int64),
        "signature": [values[row[i]].tobytes() if size[i] else None for i in range(len(size))],
    }


def _runs(rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> dict:
    keys, at = run_sets(data, offsets)
    return {
        "node": rows.column(rows.schema.get_field_index("node")),
        "runs": [keys[a:b].tobytes() for a, b in zip(at[:-1], at[1:])],
    }


def text_sets(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    named = identified(docs, key, text)
    schema = StructType([named.schema["doc_id"]]).add("_h", "long").add("n_runs", "long").add("s1", "long").add("s2", "long")
    return map_slices(named, _sets, schema.add("signature", "binary"))


def least_matches(threshold: float, tolerance: float, rows: int = ROWS, total: int = BANDS * ROWS) -> tuple[int, ...]:
    """Fewest matches after each ``rows`` values with which a pair may still go on.

    With a flat prior, P(similarity >= t | m of n match) is the chance of at most m successes in
    n + 1 trials of probability t.
    """
    out = []
    for n in range(rows, total + 1, rows):
        below, m = 0.0, -1
        while below < tolerance:
            m += 1
            below += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return tuple(out)


def similar_pairs(
    left: np.ndarray, right: np.ndarray, sigs: np.ndarray, sizes: np.ndarray, runs: list[np.ndarray], band: int, threshold: float, least: tuple[int, ...]
) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs (left[i], right[i]), those that are similar and whose first common band is ``band``."""
    small, large = np.minimum(sizes[left], sizes[right]), np.maximum(sizes[left], sizes[right])
    live = np.flatnonzero(small >= threshold * large)
    left, right = left[live], right[live]
    matches = np.zeros(len(left), np.int32)
    for step, fewest in enumerate(least):
        part = slice(step * ROWS, step * ROWS + ROWS)
        equal = (sigs[left, part] == sigs[right, part]).sum(1, dtype=np.int32)
        matches += equal
        go = matches >= fewest
        if step < band:
            go &= equal < ROWS
        left, right, matches = left[go], right[go], matches[go]
        if not len(left):
            return left, right
    order = np.argsort(left, kind="stable")
    left, right = left[order], right[order]
    same = np.zeros(len(left), np.int64)
    for a, b in zip(*_groups(left)):
        mine = runs[left[a]]
        others = right[a:b]
        parts = np.concatenate([runs[o] for o in others])
        at = np.searchsorted(mine, parts)
        at[at == len(mine)] = 0
        ends = np.cumsum(sizes[others])
        same[a:b] = np.add.reduceat((mine[at] == parts).astype(np.int64), np.concatenate([[0], ends[:-1]]))
    ok = same >= threshold * (sizes[left] + sizes[right] - same)
    return left[ok], right[ok]


def _groups(ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(ordered):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cuts = np.flatnonzero(ordered[1:] != ordered[:-1]) + 1
    return np.concatenate([[0], cuts]), np.concatenate([cuts, [len(ordered)]])


def _local_roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    root = np.arange(n)
    while True:
        low = np.minimum(root[left], root[right])
        new = root.copy()
        np.minimum.at(new, root[left], low)
        np.minimum.at(new, root[right], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _match_group(table: pa.Table, threshold: float, least: tuple[int, ...]) -> dict[str, list]:
    """Links of one pair of blocks (or of one block with itself)."""
    node = table["node"].to_numpy()
    order = np.argsort(node, kind="stable")
    table = table.take(pa.array(order))
    node, second = table["node"].to_numpy(), table["side"].to_numpy()
    copies, sizes = table["copies"].to_numpy(), table["n_runs"].to_numpy()
    band, both = int(table["band"][0].as_py()), bool(table["both"][0].as_py())
    sigs = np.stack([np.frombuffer(x, np.uint32) for x in table["signature"].to_pylist()])
    runs = [np.frombuffer(x, np.uint64) for x in table["runs"].to_pylist()]
    links = np.zeros(len(node), np.int64)
    edges: list[np.ndarray] = []
    a_side = np.flatnonzero(second == 0)
    b_side = np.flatnonzero(second == 1) if both else a_side
    step = max(1, PAIRS_AT_ONCE // max(1, len(b_side)))
    for at in range(0, len(a_side), step):
        left = np.repeat(a_side[at : at + step], len(b_side))
        right = np.tile(b_side, len(a_side[at : at + step]))
        if not both:
            right_of = left < right
            left, right = left[right_of], right[right_of]
        left, right = similar_pairs(left, right, sigs, sizes, runs, band, threshold, least)
        np.add.at(links, left, copies[right])
        np.add.at(links, right, copies[left])
        edges.append(np.stack([left, right]))
    joined = np.concatenate(edges, axis=1) if edges else np.zeros((2, 0), np.int64)
    root = _local_roots(len(node), joined[0], joined[1])
    hit = np.flatnonzero(links)
    return {"node": node[hit], "links": links[hit], "root": node[root[hit]]}


def _match(threshold: float, least: tuple[int, ...]):
    """Links of all groups of a partition sorted by group; one group is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending: list[pa.RecordBatch] = []

        def close() -> pa.RecordBatch:
            out = _match_group(pa.Table.from_batches(pending), threshold, least)
            return pa.RecordBatch.from_arrays([pa.array(out[k], pa.int64()) for k in ("node", "links", "root")], names=["node", "links", "root"])

        current = None
        for batch in batches:
            keys = np.stack([batch.column(k).to_numpy() for k in range(3)], 1)
            change = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
            for a, b in zip(np.concatenate([[0], change]), np.concatenate([change, [len(keys)]])):
                key = tuple(keys[a])
                if pending and key != current:
                    yield close()
                    pending = []
                current = key
                pending.append(batch.slice(a, b - a))
        if pending:
            yield close()

    return run


def duties(classes: DataFrame) -> DataFrame:
    """Where each class meets others: ``(node, bucket, band, duty, side, both)``, a row per pair of blocks."""
    bands = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(b, F.substring(F.col("signature"), b * 4 * ROWS + 1, F.lit(4 * ROWS)))))
    members = classes.select("node", "n_runs", bands.alias("band", "bucket"))
    buckets = members.groupBy("band", "bucket").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("n_runs").alias("total_runs"),
        F.bit_xor(F.xxhash64("node")).alias("d1"),
        F.bit_xor(F.xxhash64("node", F.lit(1))).alias("d2"),
    ).where("n > 1")
    distinct = buckets.groupBy("n", "total_runs", "d1", "d2").agg(F.min(F.struct("band", "bucket")).alias("b")).select(
        F.col("b.band").alias("band"),
        F.col("b.bucket").alias("bucket"),
        F.greatest(F.ceil(F.col("n") / BLOCK_TEXTS), F.ceil(F.col("total_runs") / BLOCK_RUNS)).cast("int").alias("blocks"),
    )
    placed = members.join(distinct, ["band", "bucket"])
    block = F.pmod(F.xxhash64("node", F.lit(2)), F.col("blocks")).cast("int")
    # Block x meets every block: as the first of (x, y) for y >= x, as the second of (y, x) for y < x.
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    return placed.select("node", "band", "bucket", "blocks", block.alias("mine"), other.alias("other")).select(
        "node",
        "bucket",
        F.col("band").cast("long").alias("band"),
        (F.least("mine", "other") * F.col("blocks") + F.greatest("mine", "other")).cast("long").alias("duty"),
        (F.col("mine") > F.col("other")).cast("int").alias("side"),
        (F.col("mine") != F.col("other")).alias("both"),
    )


def links(duty: DataFrame, classes: DataFrame, runs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``(node, links, root)`` parts from duties, classes ``(node, copies, n_runs, signature)`` and their runs.

    ``links`` of a node add up to its similar texts; (node, root) rows connect similar classes.
    """
    full = duty.join(classes.join(runs, "node"), "node").select(
        "bucket", "band", "duty", "node", "side", "both", "copies", "n_runs", "signature", "runs"
    )
    dealt = full.repartition("bucket", "band", "duty").sortWithinPartitions("bucket", "band", "duty")
    return dealt.mapInArrow(_match(threshold, least_matches(threshold, TOLERANCE)), "node long, links long, root long")


def _by_id() -> Column:
    """Orders documents by id, null ids last."""
    return F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "_h")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: ``doc_id, _h, set_id, class_id, n_links, n_runs``.

    ``set_id`` tells the connected groups of similar documents apart, also where ids are null or repeated
    (null for a document without runs). ``class_id`` is the smallest id of the group; ``n_links`` counts the
    other documents with a similarity of ``threshold`` or more, copies included. A document without
    runs has its own id as class (null if the id is null) and no links.
    """
    sets = materialise(text_sets(docs, key, text), "near-sets")
    with_runs = sets.where("n_runs > 0")
    # Equal sets: narrow rows are combined in tasks; the first member speaks for its class.
    groups = with_runs.groupBy("s1", "s2").agg(F.count(F.lit(1)).alias("copies"), F.min(_by_id()).alias("first"))
    groups = materialise(groups.withColumn("node", F.xxhash64("s1", "s2")), "near-groups")
    speakers = groups.select(F.col("first.doc_id").alias("doc_id"), F.col("first._h").alias("_h"), "node", "copies")
    classes = join_identified(with_runs.select("doc_id", "_h", "n_runs", "signature"), speakers, "inner")
    classes = materialise(classes.select("node", "copies", "n_runs", "signature").dropDuplicates(["node"]), "near-signatures")
    duty = materialise(duties(classes), "near-duties")
    # Only classes that meet others need their runs, which are made again from their texts.
    meeting = speakers.join(duty.select("node").distinct(), "node").select("doc_id", "_h", "node")
    texts = join_identified(identified(docs, key, text), meeting, "inner")
    runs = map_slices(texts, _runs, "node long, runs binary").dropDuplicates(["node"])
    parts = materialise(links(duty, classes, runs, threshold), "near-links")
    linked = parts.groupBy("node").agg(F.sum("links").alias("links"))
    edges = parts.where("node != root").select(F.col("node").alias("a"), F.col("root").alias("b")).distinct()
    found = components(edges)
    per_class = (
        groups.join(linked, "node", "left")
        .join(found.withColumnRenamed("id", "node"), "node", "left")
        .select("s1", "s2", "copies", F.col("first.doc_id").alias("first_id"), F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "node").alias("root"))
    )
    per_class = materialise(per_class, "near-classes")
    smallest = per_class.groupBy("root").agg(F.min("first_id").alias("class_id"))
    named = per_class.join(smallest, "root").select(
        "s1", "s2", F.col("root").alias("set_id"), "class_id", (F.col("links") + F.col("copies") - 1).alias("n_links")
    )
    found_rows = with_runs.select("doc_id", "_h", "n_runs", "s1", "s2").join(named, ["s1", "s2"]).select("doc_id", "_h", "set_id", "class_id", "n_links", "n_runs")
    rest = sets.where("n_runs = 0").select("doc_id", "_h", F.lit(None).cast("long").alias("set_id"), F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), "n_runs")
    return found_rows.unionByName(rest)


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` without all but the first document of each group of similar ones.

    Of rows that repeat an id and a text one stays, with or without runs.
    """
    found = near_duplicates(docs, key, text, threshold)
    distinct = found.groupBy("set_id", "doc_id", "_h").agg(F.count(F.lit(1)).alias("copies"))
    # The document that gives a class its id stays; texts without runs stay too.
    ranked = distinct.where("set_id is not null").groupBy("set_id").agg(F.min(F.struct(_by_id().alias("by"), "copies")).alias("first"))
    stays = ranked.select(F.col("first.by.doc_id").alias("_tf_id"), F.col("first.by._h").alias("_tf_h"), F.col("first.copies").alias("_tf_copies"))
    stays = stays.unionByName(
        distinct.where("set_id is null").select(F.col("doc_id").alias("_tf_id"), F.col("_h").alias("_tf_h"), F.col("copies").alias("_tf_copies"))
    )
    # Written once, as it is read for single rows and for repeated ones.
    stays = materialise(stays, "near-stays")
    safe, names = aside(docs)
    same = (F.xxhash64(safe[names[key]], safe[names[text]]) == F.col("_tf_h")) & safe[names[key]].eqNullSafe(F.col("_tf_id"))
    single = safe.join(stays.where("_tf_copies = 1"), same, "left_semi")
    # Copies are reduced inside tasks before they are dealt, by id and hash.
    again = safe.join(stays.where("_tf_copies > 1"), same).dropDuplicates(["_tf_id", "_tf_h"])
    kept = single.unionByName(again.select(*safe.columns))
    return kept.select(*[F.col(n).alias(c) for c, n in names.items()]) if safe is not docs else kept
