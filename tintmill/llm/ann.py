"""Nearest neighbours by collision counting over query-centred windows.

Each of ``PROJECTIONS`` random lines gives one sorted array of the vectors' projections: the index.
A query opens a window around its own projection on every line and widens all windows together
(virtual rehashing: the radius grows by a factor, nothing is hashed again). A vector collides on a
line when it lies in the window there. Once enough vectors collide on at least ``THRESHOLD`` of the
lines, those are verified with exact inner products. The k-th best of them tells how far a true
neighbour can lie, so the windows are widened once more, to the radius at which a vector that far
collides often enough with probability ``SURE``, and what that adds is verified too. Expected recall
so is at least ``SURE`` whatever the table's size and dimension.

The largest inner product becomes the least distance by one more coordinate, which lifts every
vector to the largest norm and is 0 for queries. So that this coordinate doesn't drown the others
where norms differ, a block is indexed in bands of norms within a factor of ``BAND``, each lifted to
its own largest. A query meets the bands from the longest vectors down, and stops where a band's
norm can't reach the k-th best inner product any more. All vectors are indexed, in blocks of bounded size;
the stated query set meets every block, and each block keeps a query's nearest, so what is merged
is a few rows a query and block.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

PROJECTIONS, THRESHOLD = 64, 0.85
#: Share of a block that must collide often enough, widening factor, and rows that the first radius is estimated from.
VERIFY, WIDEN, SAMPLE = 0.22, 1.06, 256
#: Least number of verified rows for each neighbour asked for.
VERIFY_EACH = 16
#: Probability with which a vector as far as the k-th best found is verified, at least.
SURE = 0.95
#: Factor that norms of a band lie within, unless all of it is verified anyway.
BAND = 1.1
#: Vectors of a block, and queries that meet a block together at most: as many, so that neither side's copies outweigh the other's.
BLOCK, QUERIES = 32_768, 32_768


def span(sure: float, need: int) -> float:
    """Radius, in distances of a vector, at which it collides on ``need`` lines at least with probability ``sure``."""
    low, high = 0.0, 10.0
    for _ in range(60):
        mid = (low + high) / 2
        # A line's normal projection of the difference lies within the radius with probability p.
        p = math.erf(mid / math.sqrt(2))
        often = sum(math.comb(PROJECTIONS, j) * p**j * (1 - p) ** (PROJECTIONS - j) for j in range(need, PROJECTIONS + 1))
        low, high = (mid, high) if often < sure else (low, mid)
    return high


NEED = math.ceil(THRESHOLD * PROJECTIONS)
SPAN = span(SURE, NEED)


class Index:
    """Sorted projections of one band of vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, norm: float, seed: int = 3):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        lift = np.sqrt(np.maximum(norm * norm - np.einsum("ij,ij->i", self.vectors, self.vectors), 0.0))
        self.lines = np.random.default_rng(seed).normal(size=(vectors.shape[1] + 1, PROJECTIONS))
        places = np.hstack([self.vectors, lift[:, None]]) @ self.lines
        self.sample = places[:: max(1, len(places) // SAMPLE)].copy()
        order = np.argsort(places, axis=0, kind="stable")
        self.places = np.asfortranarray(np.take_along_axis(places, order, axis=0))
        self.order = np.ascontiguousarray(order.T.astype(np.int32))
        self.norm = norm

    def window(self, centre: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
        lines = range(PROJECTIONS)
        return np.array([np.searchsorted(self.places[:, k], centre[k] - radius, "left") for k in lines]), np.array([np.searchsorted(self.places[:, k], centre[k] + radius, "right") for k in lines])

    def candidates(self, query: np.ndarray, least: int, kth) -> np.ndarray:
        """Rows that collide on enough lines (or all rows): ``least`` at least, and all that surely do if as near as ``kth`` of those."""
        n, need = len(self.ids), NEED
        if n <= least:
            return np.arange(n)
        # Scaled to the common norm: that keeps the order of inner products and centres the windows.
        length = float(np.sqrt(query @ query))
        centre = np.append(query * (self.norm / length), 0.0) @ self.lines
        # The first radius is the one at which the wanted share of a few rows collides often enough.
        reach = np.partition(np.abs(self.sample - centre), need - 1, axis=1)[:, need - 1]
        radius = max(float(np.quantile(reach, min(1.0, least / n))), 1e-9)
        low, high = self.window(centre, radius)
        count = np.full(n, PROJECTIONS, np.int16)
        for k in range(PROJECTIONS):
            count[self.order[k, : low[k]]] -= 1
            count[self.order[k, high[k] :]] -= 1

        def widen(radius: float) -> None:
            nonlocal low, high
            left, right = self.window(centre, radius)
            for k in range(PROJECTIONS):
                # Only what the window gains; within a line no row comes twice.
                count[self.order[k, left[k] : low[k]]] += 1
                count[self.order[k, high[k] : right[k]]] += 1
            low, high = left, right

        while (count >= need).sum() < least and not ((low == 0).all() and (high == n).all()):
            radius *= WIDEN
            widen(radius)
        # Distances from the centre follow from inner products, as all lifted vectors have the common norm.
        sure = SPAN * math.sqrt(max(0.0, 2 * self.norm * (self.norm - kth(np.flatnonzero(count >= need)) / length)))
        if sure > radius:
            widen(sure)
        return np.flatnonzero(count >= need)

    def nearest(self, query_id: int, query: np.ndarray, k: int, known: float = -math.inf) -> tuple[np.ndarray, np.ndarray]:
        """The ``k`` nearest found here; of no use are those under ``known``, the k-th best found elsewhere."""

        def kth(rows: np.ndarray) -> float:
            rough = self.vectors[rows[self.ids[rows] != query_id]] @ query
            return max(known, float(np.partition(rough, -k)[-k]) if len(rough) >= k else -math.inf)

        rows = self.candidates(query, max(VERIFY_EACH * k, int(VERIFY * len(self.ids))) + 1, kth)
        rows = rows[self.ids[rows] != query_id]
        # A product of all leaves those that can be among the nearest, whatever its rounding.
        rough = self.vectors[rows] @ query
        if len(rough) > k:
            rows = rows[rough >= np.partition(rough, -k)[-k] - 1e-9 * max(1.0, self.norm * np.abs(query).max())]
        score = exact(self.vectors[rows], query)
        best = np.lexsort((self.ids[rows], -score))[:k]
        return self.ids[rows][best], score[best]


class Bands:
    """Indexes of one block's vectors in bands of like norms, from the largest norm down."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        norms = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
        order = np.argsort(-norms, kind="stable")
        falling = -norms[order]
        self.bands, at = [], 0
        while at < len(order):
            # A band of so few rows is verified whole, however wide.
            end = max(int(np.searchsorted(falling, falling[at] / BAND, "right")), min(at + VERIFY_EACH * k, len(order)))
            self.bands.append(Index(ids[order[at:end]], vectors[order[at:end]], float(-falling[at])))
            at = end

    def nearest(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        ids, score, known = np.empty(0, np.int64), np.empty(0), -math.inf
        length = float(np.sqrt(query @ query))
        for band in self.bands:
            if band.norm * length * (1 + 1e-9) < known:
                break
            near, own = band.nearest(query_id, query, k, known)
            ids, score = np.append(ids, near), np.append(score, own)
            best = np.lexsort((ids, -score))[:k]
            ids, score = ids[best], score[best]
            known = float(score[-1]) if len(score) == k else known
        return ids, score


def exact(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products in double precision; equal vectors get equal ones."""
    return (vectors * query).sum(axis=1)


def _search(k: int):
    def run(t: pa.Table) -> pa.Table:
        ids = t.column("_id").to_numpy()
        vectors = t.column("_v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
        query = t.column("_query").to_numpy(zero_copy_only=False).astype(bool)
        out: list[tuple] = []
        if query.any() and not query.all():
            index = Bands(ids[~query], vectors[~query], k)
            for q, v in zip(ids[query], vectors[query]):
                near, score = index.nearest(int(q), v, k)
                out += [(int(q), int(a), float(b)) for a, b in zip(near, score)]
        columns = list(zip(*out)) or [[], [], []]
        return pa.table({"query_id": pa.array(columns[0], pa.int64()), "vec_id": pa.array(columns[1], pa.int64()), "score": pa.array(columns[2], pa.float64())})

    return run


def valid(vector: Column) -> Column:
    """Whether a vector takes part: not null, neither empty nor zero, every component finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def search(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's ``k`` nearest found, by largest inner product.

    Queries are the rows for which ``is_query`` holds, candidates all rows of another id; ties go to
    the smaller id. Vectors that are null, empty or zero, or hold null or non-finite components, and
    rows of null id take no part; so do vectors whose length isn't the commonest (ties: the
    longest). Of rows that share an id the first by content counts. Fewer candidates than ``k`` give
    as many rows; an empty table none. Other columns are ignored, whatever their names.
    """
    own = vectors.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("_v"), F.coalesce(is_query, F.lit(False)).alias("_query"))
    own = own.filter(F.col("_id").isNotNull() & valid(F.col("_v")))
    sizes = own.groupBy(F.size("_v").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    if sizes is None:
        return own.select(F.col("_id").alias("query_id"), F.lit(1).alias("rank"), F.col("_id").alias("vec_id"), F.lit(0.0).alias("score")).limit(0)
    own = cut(own.filter(F.size("_v") == sizes["size"]).groupBy("_id").agg(F.min("_v").alias("_v"), F.max("_query").alias("_query")))
    n, asked = own.agg(F.count("*"), F.count_if("_query")).first()
    blocks, parts = max(1, -(-n // BLOCK)), max(1, -(-asked // QUERIES))
    # An index is built once for each part of the queries. There are more parts only where the cluster would idle otherwise.
    parts = max(parts, min(-(-asked // 512), -(-vectors.sparkSession.sparkContext.defaultParallelism // blocks)))
    # A block of the index meets every part of the query set, and so does a query every block.
    block, part = F.pmod(F.xxhash64("_id", F.lit(1)), F.lit(blocks)), F.pmod(F.xxhash64("_id", F.lit(2)), F.lit(parts))
    index = own.select("_id", "_v", F.lit(False).alias("_query"), block.alias("_block"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("_part"))
    queries = own.filter("_query").select("_id", "_v", "_query", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("_block"), part.alias("_part"))
    found = index.unionByName(queries).groupBy("_block", "_part").applyInArrow(_search(k), "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
