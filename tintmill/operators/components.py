"""Connected components: in one task while the edges are few; beyond, a task joins a part of the edges
first, and what links the parts' components goes through alternating large-star and small-star rounds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import dropped, written

#: Counted edges up to which one task joins all components, and edges of a written part, about.
TASK_EDGES, PART_EDGES = 1_000_000, 1_000_000
#: A node is a hub with this many edges at least, and with this share of all, so there are at most 200,000 hubs.
HUB_EDGES, HUB_SHARE = 1000, 1e-5


def _hooked(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nodes in order, their least linked ones, and u's, by hooking larger labels on smaller ones, with pointer jumping."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    u, v = at[: len(u)], at[len(u) :]
    up = np.arange(len(nodes))
    while True:
        low, high = np.minimum(up[u], up[v]), np.maximum(up[u], up[v])
        apart = low != high
        if not apart.any():
            break
        np.minimum.at(up, high[apart], low[apart])
        while (next_ := up[up]).tobytes() != up.tobytes():
            up = next_
    return nodes, nodes[up], nodes[up[u]]


def _joined(batches):
    """Components of all edges (u, v)."""
    batches = [x for x in batches if x.num_rows]
    if not batches:
        return
    t = pa.Table.from_batches(batches)
    nodes, least, _ = _hooked(t.column("u").to_numpy(), t.column("v").to_numpy())
    yield pa.RecordBatch.from_pydict({"node": nodes, "comp": least})


def _labelled(batches):
    """All arcs (src, dst) with their component, and each end once without a destination."""
    batches = [x for x in batches if x.num_rows]
    if not batches:
        return
    t = pa.Table.from_batches(batches)
    nodes, least, of = _hooked(t.column("src").to_numpy(), t.column("dst").to_numpy())
    both = {"src": np.concatenate([t.column("src").to_numpy(), nodes]), "dst": pa.concat_arrays([*t.column("dst").chunks, pa.nulls(len(nodes), pa.int64())]), "comp": np.concatenate([of, least])}
    yield from pa.table(both).to_batches(max_chunksize=100_000)


def _with_least(both: DataFrame, n: int) -> DataFrame:
    """``both`` (u, v) with the least ``m`` of u's neighbours and itself; rows of a hub meet it where they are."""
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("of")).select("u", F.least("u", "m").alias("m"), "of")
    many = F.col("of") >= max(HUB_EDGES, int(HUB_SHARE * 2 * n))
    near = both.join(F.broadcast(least.filter(many).select("u", F.col("m").alias("hub"))), "u", "left")
    rest = near.filter("hub is null").drop("hub").join(least.filter(~many).drop("of"), "u")
    return near.filter("hub is not null").withColumnRenamed("hub", "m").unionByName(rest)


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for every node of ``edges`` (u, v), comp being the smallest node it is linked with.

    Up to ``TASK_EDGES`` edges are joined by one task. Beyond, ranges of edges are joined by a task
    each, and only nodes that ranges share are left to link. Where these are still many, each round
    hangs neighbours on a smaller neighbour; the rounds end when every node hangs on one node that
    hangs on none. Hubs are reduced by a partial minimum, which goes to their edges, so no task
    gathers a component. Loops and repeated edges do nothing; null ends are dropped; no edges give
    no rows. ``edges`` is read twice, so it had better be a table.
    """
    own = edges.filter("u <> v").select(F.greatest("u", "v").cast("long").alias("u"), F.least("u", "v").cast("long").alias("v"))
    n = own.count()
    if n <= TASK_EDGES:
        return _one_task(own)
    ranges = max(2, -(-n // PART_EDGES))
    # A node once for each range that has it, with the least node it is linked with there.
    stars = written(own.repartitionByRange(ranges, "u", "v").mapInArrow(_joined, "node long, comp long"))
    nodes = stars.groupBy("node").agg(F.min("comp").alias("least"), F.max("comp").alias("most"))
    shared = nodes.filter("least < most").select("node", "least")
    links = written(stars.join(shared, "node").filter("comp <> least").select(F.col("comp").alias("u"), F.col("least").alias("v")).distinct())
    joined = _one_task(links) if links.count() <= TASK_EDGES else _rounds(links)
    found = nodes.join(joined.withColumnRenamed("node", "least"), "least", "left").select("node", F.coalesce("comp", "least").alias("comp"))
    out = written(found)
    dropped(stars)
    return out


def parts(named: DataFrame, arcs: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """Every arc (src, dst, part) of ``n`` that starts at a named (node), and the named nodes (node, part), perhaps more than once.

    ``part`` is the smallest node that is linked with its ends. As ``components`` does it for many
    edges, but ranges label their own arcs, so that only labels that ranges share are joined with them.
    Loops and null ends are dropped.
    """
    own = arcs.filter("src <> dst").select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"))
    rows = written(own.repartitionByRange(max(2, -(-n // PART_EDGES)), F.greatest("src", "dst"), F.least("src", "dst")).mapInArrow(_labelled, "src long, dst long, comp long"))
    stars = rows.filter("dst is null").select(F.col("src").alias("node"), "comp")
    nodes = stars.groupBy("node").agg(F.min("comp").alias("least"), F.max("comp").alias("most"))
    # Nodes of several ranges, nodes without arcs, and ends that no node names.
    odd = written(nodes.join(named.withColumn("named", F.lit(True)), "node", "full").filter("named is null or least is null or least < most"))
    shared = odd.filter("least < most").select("node", "least")
    links = written(stars.join(shared, "node").filter("comp <> least").select(F.col("comp").alias("u"), F.col("least").alias("v")).distinct())
    joined = _one_task(links) if links.count() <= TASK_EDGES else _rounds(links)
    strangers = odd.filter("named is null").select(F.col("node").alias("src"))
    if not strangers.isEmpty():
        rows = rows.join(strangers, "src", "left_anti")
    rows = rows.join(joined.select(F.col("node").alias("comp"), F.col("comp").alias("least")), "comp", "left").select("src", "dst", F.coalesce("least", "comp").alias("part"))
    alone = odd.filter("least is null").select("node", F.col("node").alias("part"))
    return rows.filter("dst is not null"), rows.filter("dst is null").select(F.col("src").alias("node"), "part").unionByName(alone)


def _one_task(edges: DataFrame) -> DataFrame:
    return written(edges.coalesce(1).mapInArrow(_joined, "node long, comp long"))


def _rounds(edges: DataFrame) -> DataFrame:
    """Star rounds over edges (u, v) with u > v."""
    e = written(edges.distinct())
    n = e.count()
    # Rounds never have more edges than nodes and edges together; few rows aren't worth a file for every partition.
    parts = max(1, -(-n // PART_EDGES))
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both, n).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x")).select("x.*")
        before, e = e, written(small.filter("u <> v").distinct().coalesce(parts))
        dropped(before)
        ends = e.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(True).alias("hangs")), F.struct(F.col("v").alias("node"), F.lit(False).alias("hangs")))).alias("x")).select("x.*")
        if ends.groupBy("node").agg(F.count_if("hangs").alias("n"), F.count("*").alias("of")).filter("n > 1 or (n = 1 and of > 1)").isEmpty():
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())
