"""Approximate nearest neighbours by balanced posting lists (operator 2).

Fitting: k-means on at most ``MAX_SAMPLE`` vectors (those with the smallest hashes) gives centroids;
clusters of the sample with too many members are split in two until all are of a like size, which
balances the lists. The centroids form a graph in memory: each knows its nearest ones, and a search
walks from a few fixed entries to ever nearer centroids, many vectors at a time.

Indexing: the graph gives each vector its nearest centroids. The vector is put on the list of the
nearest and, if it lies near a boundary, also on those at most ``REPLICATE`` times as far, up to
``MAX_REPLICAS`` lists. All vectors are indexed.

Search: the graph gives a query's nearest centroids; those at most ``PRUNE`` times as far as the
nearest, and in any case the first ``MIN_LISTS``, are its lists, at most ``MAX_LISTS`` or, where that is more,
one in ``LIST_SHARE`` of all: the share of a table that is searched does not shrink as it grows. So many
lists are ranked by all distances, as a walk would be no shorter. Lists are cut into blocks of at most ``BLOCK`` vectors by their counted sizes,
queries visit every block, and each block answers with its best. Scores are inner products in double
precision on the original vectors. Inner products are turned into distances by one more dimension,
which holds what a vector lacks to the length of the longest.

Equal vectors are one entry with its ``k + 1`` smallest ids, cut inside tasks first, which is all that a
result can hold of them; so a vector that is everywhere makes no list long.

Vectors that are null, zero, or hold null or non-finite components take no part. Vectors of another
length than the others are an error. Null ids take no part. Repeated (id, vector) rows are one; an id
with several vectors keeps each. Fewer than ``k`` candidates give fewer rows; empty tables and tables
without queries give empty tables. Extra columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from textforge.llm.common import materialise

K = 20
MAX_SAMPLE = 20_000
MAX_CENTROIDS = 2_048
LIST_SIZE = 128  # vectors per list that the number of centroids aims at
REPLICATE, MAX_REPLICAS = 1.1, 4
PRUNE, MIN_LISTS, MAX_LISTS = 1.3, 40, 96
LIST_SHARE = 4
BLOCK = 4_096
NEIGHBOURS = 24
ENTRIES = 8
BEAM = 128


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T, 0)


def _nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([_distances(points[i : i + 4096], centres).argmin(1) for i in range(0, len(points), 4096)])


def balanced_centroids(sample: np.ndarray, count: int, seed: int = 2) -> np.ndarray:
    """About ``count`` centroids whose clusters in the sample are at most twice the mean size."""
    rng = np.random.default_rng(seed)
    count = max(1, min(count, len(sample)))
    centres = sample[np.sort(rng.choice(len(sample), count, replace=False))]
    for step in range(10):
        own = _nearest(sample, centres)
        sizes = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        centres = sums[sizes > 0] / sizes[sizes > 0, None]
        if step < 6:
            # Split what is too large: a second centre beside the first.
            sizes = sizes[sizes > 0]
            large = np.argsort(-sizes, kind="stable")[: max(0, count - len(centres)) + (sizes > 2 * len(sample) / count).sum()]
            if not len(large):
                continue
            centres = np.concatenate([centres, centres[large] + rng.normal(0, 1e-2, (len(large), sample.shape[1])) * (np.abs(centres[large]).mean() + 1e-9)])
    return centres


@dataclass(frozen=True)
class CentroidGraph:
    centres: np.ndarray
    edges: np.ndarray  # the nearest centroids of each
    entries: np.ndarray

    @staticmethod
    def build(centres: np.ndarray, neighbours: int = NEIGHBOURS) -> CentroidGraph:
        n = len(centres)
        near = np.concatenate([np.argsort(_distances(centres[i : i + 512], centres), axis=1, kind="stable")[:, 1 : neighbours + 1] for i in range(0, n, 512)])
        # A few edges to far centroids keep clusters of centroids reachable from each other.
        far = np.random.default_rng(n).integers(0, n, (n, min(4, n)))
        return CentroidGraph(centres, np.concatenate([near, far], axis=1), np.unique(np.linspace(0, n - 1, min(n, ENTRIES)).astype(int)))

    def search(self, points: np.ndarray, count: int, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """Nearest centroids of many points: ids and distances, ascending; -1 and inf where there are fewer."""
        count = min(count, len(self.centres))
        beam = max(beam, count)
        parts = [self._walk(points[i : i + 512], beam) for i in range(0, len(points), 512)]
        ids = np.concatenate([p[0] for p in parts])[:, :count]
        return ids, np.concatenate([p[1] for p in parts])[:, :count]

    def rank(self, points: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
        """As :meth:`search`, by the distances to all centroids."""
        dist = np.concatenate([_distances(points[i : i + 512], self.centres) for i in range(0, len(points), 512)])
        ids = np.argsort(dist, axis=1, kind="stable")[:, :count]
        return ids, np.take_along_axis(dist, ids, 1)

    def _walk(self, points: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        m, n = len(points), len(self.centres)
        row = np.arange(m)[:, None]
        ids = np.full((m, beam), -1)
        dist = np.full((m, beam), np.inf)
        done = np.ones((m, beam), bool)
        seen = np.zeros((m, n), bool)
        new = np.broadcast_to(self.entries, (m, len(self.entries)))
        while True:
            fresh = ~seen[row, new]
            seen[row, new] = True
            # A neighbour listed twice in one step counts once.
            order = np.argsort(new, axis=1, kind="stable")
            ordered = np.take_along_axis(new, order, 1)
            again = np.zeros(new.shape, bool)
            np.put_along_axis(again, order[:, 1:], ordered[:, 1:] == ordered[:, :-1], 1)
            gap = points[:, None, :] - self.centres[new]
            d = np.where(fresh & ~again, np.einsum("ijk,ijk->ij", gap, gap), np.inf)
            all_d = np.concatenate([dist, d], 1)
            keep = np.argsort(all_d, axis=1, kind="stable")[:, :beam]
            ids = np.take_along_axis(np.concatenate([ids, new], 1), keep, 1)
            done = np.take_along_axis(np.concatenate([done, np.zeros(new.shape, bool)], 1), keep, 1)
            dist = np.take_along_axis(all_d, keep, 1)
            open_ = ~done & np.isfinite(dist)
            live = open_.any(1)
            if not live.any():
                return np.where(np.isfinite(dist), ids, -1), dist
            pick = open_.argmax(1)
            done[np.arange(m)[live], pick[live]] = True
            new = self.edges[np.where(live, ids[np.arange(m), pick], 0)]


def clean_vectors(df: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``(id, v)`` of the rows that take part, in double precision; equal rows once."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = df.select(F.col(key).alias("id"), v.alias("v")).where("id is not null and v is not null and size(v) > 0")
    # Negative zero is zero, so that equal vectors are equal bytes.
    rows = rows.where(finite & F.exists("v", lambda x: x != 0)).withColumn("v", F.transform("v", lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x)))
    return rows.withColumn("h", F.xxhash64("v")).dropDuplicates(["id", "h", "v"])


def distinct_vectors(clean: DataFrame, k: int = K) -> DataFrame:
    """``(node, v, ids)``: each different vector with its ``k + 1`` smallest ids."""
    # Spark cuts to k + 1 rows per vector before it shuffles, so a vector that is everywhere stays small.
    ranked = clean.withColumn("_n", F.row_number().over(W.partitionBy("h", "v").orderBy("id"))).where(F.col("_n") <= k + 1)
    return ranked.groupBy("h", "v").agg(F.array_sort(F.collect_list("id")).alias("ids")).select(F.col("ids")[0].alias("first_id"), "h", "v", "ids")


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy()
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _lifted(x: np.ndarray, longest: float) -> np.ndarray:
    return np.concatenate([x, np.sqrt(np.maximum(longest**2 - (x * x).sum(1), 0))[:, None]], 1)


def _place(graph: CentroidGraph, longest: float):
    """Posting lists of each vector: nearest and boundary clusters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _lifted(_matrix(batch.column(2)), longest)
            if not len(x):
                continue
            ids, dist = graph.search(x, 2 * MAX_REPLICAS, beam=32)
            take = (ids >= 0) & (dist <= REPLICATE**2 * dist[:, :1])
            take[:, 0] = True
            take &= np.cumsum(take, 1) <= MAX_REPLICAS
            row, col = np.nonzero(take)
            index = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[row, col], pa.int64())] + [batch.column(k).take(index) for k in range(3)], names=["list", "first_id", "h", "v"]
            )

    return run


def _route(graph: CentroidGraph, longest: float):
    """Lists that each query visits; queries lie on the plane of the original vectors."""
    most = max(MAX_LISTS, -(-len(graph.centres) // LIST_SHARE))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = _matrix(batch.column(2))
            if not len(q):
                continue
            # The direction decides; the length of a query does not change the order of its candidates.
            q = q / np.sqrt((q * q).sum(1))[:, None] * longest
            x = np.concatenate([q, np.zeros((len(q), 1))], 1)
            ids, dist = graph.rank(x, most) if most > MAX_LISTS else graph.search(x, MAX_LISTS)
            close = dist <= PRUNE**2 * dist[:, :1]
            close[:, :MIN_LISTS] = True
            row, col = np.nonzero((ids >= 0) & close)
            index = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[row, col], pa.int64())] + [batch.column(k).take(index) for k in range(3)], names=["list", "first_id", "h", "v"]
            )

    return run


def best_entries(queries: np.ndarray, x: np.ndarray, ids: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query, entry and score of the ``most`` best entries of each query; equal scores by smaller id.

    A matrix product finds the border; every entry that reaches it but for rounding is scored by itself, ties and
    all, before any is left out.
    """
    rough = queries @ x.T
    border = np.partition(rough, len(x) - most, axis=1)[:, len(x) - most]
    rounding = 1e-12 * np.sqrt((queries * queries).sum(1) * (x * x).sum(1).max(initial=0.0))
    row, col = np.nonzero(rough >= (border - rounding)[:, None])
    score = np.empty(len(row))
    for at in range(0, len(row), 1 << 16):
        part = slice(at, at + (1 << 16))
        score[part] = np.einsum("ij,ij->i", x[col[part]], queries[row[part]])
    by = np.lexsort((ids[col], -score, row))
    row, col, score = row[by], col[by], score[by]
    kept = np.arange(len(row)) - np.searchsorted(row, row) < most
    return row[kept], col[kept], score[kept]


def _answer(k: int):
    """Best ``k + 1`` entries of a block for each query that visits it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(parts: list[pa.RecordBatch]) -> pa.RecordBatch | None:
            table = pa.Table.from_batches(parts)
            query = table["query"].to_numpy()
            mine, other = np.flatnonzero(~query), np.flatnonzero(query)
            if not len(mine) or not len(other):
                return None
            ids, hs = table["first_id"].to_numpy(), table["h"].to_numpy()
            v = _matrix(table["v"].combine_chunks())
            x, out = v[mine], []
            most = min(k + 1, len(mine))
            for at in range(0, len(other), 512):
                part = other[at : at + 512]
                row, entry, score = best_entries(v[part], x, ids[mine], most)
                out.append((part[row], mine[entry], score))
            q, e, score = (np.concatenate(c) for c in zip(*out))
            return pa.RecordBatch.from_arrays(
                [pa.array(ids[q]), pa.array(hs[q]), pa.array(ids[e]), pa.array(hs[e]), pa.array(score)],
                names=["q_id", "q_h", "first_id", "h", "score"],
            )

        parts, current = [], None
        for batch in batches:
            keys = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()], 1)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
            for a, b in zip(np.concatenate([[0], cuts]), np.concatenate([cuts, [len(keys)]])):
                if not b:
                    continue
                if parts and tuple(keys[a]) != current:
                    done = close(parts)
                    parts = []
                    if done is not None:
                        yield done
                current = tuple(keys[a])
                parts.append(batch.slice(a, b - a))
        if parts and (done := close(parts)) is not None:
            yield done

    return run


def search(df: DataFrame, is_query: Callable[[Column], Column], k: int = K, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` nearest found for each row whose id fulfils ``is_query``."""
    spark = df.sparkSession
    out = StructType().add("query_id", "long").add("rank", "integer").add("vec_id", "long").add("score", "double")
    clean = materialise(clean_vectors(df, key, vector), "vectors")
    nodes = materialise(distinct_vectors(clean, k), "nodes")
    longest = F.sqrt(F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)))
    n, low, high, top = nodes.agg(F.count(F.lit(1)), F.min(F.size("v")), F.max(F.size("v")), longest).first()
    if not n:
        return spark.createDataFrame([], out)
    if low != high:
        raise ValueError(f"vectors of {low} and of {high} components")
    # A sample of bounded size: the smallest hashes.
    share = min(1.0, 1.2 * MAX_SAMPLE / n)
    drawn = nodes.where(F.pmod(F.xxhash64("h"), F.lit(1_000_000)) < int(share * 1_000_000) + 1)
    sample = _lifted(_matrix(drawn.orderBy(F.xxhash64("h"), "first_id").limit(MAX_SAMPLE).select("v").toArrow()["v"].combine_chunks()), top)
    if not len(sample):
        sample = _lifted(_matrix(nodes.select("v").limit(1).toArrow()["v"].combine_chunks()), top)
    graph = CentroidGraph.build(balanced_centroids(sample, min(MAX_CENTROIDS, max(1, n // LIST_SIZE), max(1, len(sample) // 8))))

    entry = "list long, first_id long, h long, v array<double>"
    narrow = nodes.select("first_id", "h", "v")
    lists = materialise(narrow.mapInArrow(_place(graph, top), entry), "posting-lists")
    asked = clean.where(is_query(F.col("id"))).select("h", "v").distinct()
    # A query vector is searched once, under the smallest id of its equals.
    queries = asked.join(nodes.select("first_id", F.col("h").alias("_h"), F.col("v").alias("_v")), (F.col("h") == F.col("_h")) & (F.col("v") == F.col("_v"))).select("first_id", "h", "v")
    routed = queries.mapInArrow(_route(graph, top), entry)
    sizes = lists.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    # One row per centroid, at most a few times MAX_CENTROIDS.
    sizes = F.broadcast(sizes)
    stored = lists.join(sizes, "list").select("list", F.pmod(F.xxhash64("h", "first_id"), F.col("blocks")).cast("long").alias("block"), F.lit(False).alias("query"), "first_id", "h", "v")
    visits = routed.join(sizes, "list").select("list", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks").cast("long") - 1)).alias("block"), F.lit(True).alias("query"), "first_id", "h", "v")
    met = stored.unionByName(visits).repartition("list", "block").sortWithinPartitions("list", "block")
    found = met.mapInArrow(_answer(k), "q_id long, q_h long, first_id long, h long, score double")
    found = found.groupBy("q_id", "q_h", "first_id", "h").agg(F.max("score").alias("score"))
    by_class = W.partitionBy("q_id", "q_h").orderBy(F.desc("score"), "first_id")
    best = found.withColumn("_n", F.row_number().over(by_class)).where(F.col("_n") <= k + 1)

    # Every row that asked, with every id of the entries found, but for its own.
    ids = nodes.select(F.col("first_id").alias("_f"), F.col("h").alias("_h"), "ids")
    rows = best.join(ids, (F.col("first_id") == F.col("_f")) & (F.col("h") == F.col("_h"))).select("q_id", "q_h", "score", F.explode("ids").alias("vec_id"))
    near = W.partitionBy("q_id", "q_h").orderBy(F.desc("score"), "vec_id")
    rows = rows.withColumn("_n", F.row_number().over(near)).where(F.col("_n") <= k + 1).drop("_n")
    askers = clean.where(is_query(F.col("id"))).select(F.col("id").alias("query_id"), F.col("h").alias("_qh"), F.col("v").alias("_qv"))
    keyed = askers.join(nodes.select("first_id", F.col("h").alias("_nh"), F.col("v").alias("_nv")), (F.col("_qh") == F.col("_nh")) & (F.col("_qv") == F.col("_nv"))).select("query_id", F.col("first_id").alias("_q"), "_qh")
    paired = keyed.join(rows, (F.col("_q") == F.col("q_id")) & (F.col("_qh") == F.col("q_h"))).where("vec_id != query_id")
    rank = F.row_number().over(W.partitionBy("query_id", "_qh").orderBy(F.desc("score"), "vec_id"))
    return paired.select("query_id", rank.alias("rank"), F.col("vec_id").cast("long").alias("vec_id"), "score").where(F.col("rank") <= k)

