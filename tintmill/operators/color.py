"""Colors: the blocks that a transaction's value descends from, along the spends.

A graph of up to ``TASK_EDGES`` counted edges, and as many coinbases, is folded in arrival order by one task. A larger one is
unrolled by doubling: ``reach`` holds the colors over fewer than 2^k hops, ``hops`` the paths of
exactly 2^k; a round adds what the paths reach and doubles them, so a chain of a million spends
takes twenty rounds. Each round's rows are distinct (or summed), which keeps the work in proportion
to ancestors, not to paths. Where ancestry is dense, pairs of a transaction and an ancestor would
outgrow the colors: a round first counts the pairs that doubling would join, and beyond ``DENSE``
times the edges and colors it stops doubling and goes on in strides of the hops that it has.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import dropped, written

#: Edges, and coinbases, that one task folds at most, and terms of colors that it holds; a graph of more terms is unrolled instead.
TASK_EDGES, TASK_TERMS = 1_000_000, 3_000_000
#: Pairs to a row of edges and colors beyond which doubling stops.
DENSE = 64
U32 = 4_294_967_295


def coinbase(records: DataFrame, inputs: DataFrame) -> DataFrame:
    """(seq, tx_id, block) of the records without inputs."""
    return records.join(inputs.select("seq").distinct(), "seq", "left_anti").select("seq", "tx_id", F.col("block_id").alias("block"))


def shares(inputs: DataFrame) -> DataFrame:
    """``inputs`` with ``total`` and ``share``: amount by the record's total, or equal shares where that is zero."""
    own = Window.partitionBy("seq")
    amount = F.col("amount").cast("double")
    return inputs.withColumn("total", F.sum(amount).over(own)).withColumn("share", F.when(F.col("total") > 0, amount / F.col("total")).otherwise(1.0 / F.count("*").over(own)))


def _edges(spends: DataFrame, value: Column | None) -> DataFrame:
    own = spends.filter("version_seq is not null").select(F.col("seq").alias("child"), F.col("version_seq").alias("parent"), *([value.alias("w")] if value is not None else []))
    # Inputs that spend the same ancestor are one edge.
    return own.distinct() if value is None else own.groupBy("child", "parent").agg(F.sum("w").alias("w"))


def _fold(base: DataFrame, edges: DataFrame) -> DataFrame | None:
    """``_reach`` of a graph of few edges, in the order of arrival; None if its colors have too many terms for a task."""
    weighted = "w" in edges.columns
    kind = base.schema["w"].dataType.simpleString() if weighted else "bigint"
    none = F.lit(None)
    rows = base.select(F.col("seq").alias("child"), none.cast("long").alias("parent"), "block", *(["w"] if weighted else []))
    rows = rows.unionByName(edges.select("child", "parent", none.cast("long").alias("block"), *(["w"] if weighted else [])))

    def run(batches):
        batches = [x for x in batches if x.num_rows]
        if not batches:
            return
        t = pa.Table.from_batches(batches)
        child = t.column("child").to_numpy()
        parent, block = (t.column(k).to_pylist() for k in ("parent", "block"))
        value = t.column("w").to_pylist() if weighted else None
        border = np.flatnonzero(np.diff(child, prepend=child[0] - 1)).tolist() + [len(child)]
        colors: dict[int, dict] = {}
        held = 0
        for a, b in zip(border[:-1], border[1:]):
            own: dict = {}
            for k in range(a, b):
                if parent[k] is None:
                    own[block[k]] = own.get(block[k], 0) + value[k] if weighted else None
                elif weighted:
                    v = value[k]
                    for x, w in colors.get(parent[k], {}).items():
                        own[x] = own.get(x, 0) + v * w
                else:
                    own.update(colors.get(parent[k], {}))
            colors[int(child[a])] = own
            held += len(own)
            if held > TASK_TERMS:
                yield pa.RecordBatch.from_pydict({"seq": [None], "block": [None], **({"w": [None]} if weighted else {})}, schema=schema)
                return
        names = list(colors)
        for k in range(0, len(names), 50_000):
            some = names[k : k + 50_000]
            size = [len(colors[x]) for x in some]
            out = [pa.array(np.repeat(np.array(some, np.int64), size)), pa.array([x for y in some for x in colors[y]], schema.field("block").type)]
            yield pa.RecordBatch.from_arrays([*out, *([pa.array([w for y in some for w in colors[y].values()], schema.field("w").type)] if weighted else [])], schema=schema)

    wide = {"bigint": pa.int64(), "double": pa.float64()}
    of_block = base.schema["block"].dataType.simpleString()
    block_type = pa.decimal128(20, 0) if of_block.startswith("decimal") else pa.int64()
    schema = pa.schema([("seq", pa.int64()), ("block", block_type), *([("w", wide[kind])] if weighted else [])])
    order = ["child"] if not weighted else ["child", "parent"]
    done = written(rows.coalesce(1).sortWithinPartitions(*order).mapInArrow(run, f"seq long, block {of_block}" + (f", w {kind}" if weighted else "")))
    return None if not done.filter("seq is null").isEmpty() else done


def _reach(base: DataFrame, edges: DataFrame) -> DataFrame:
    """(seq, block[, w]) reached from ``base`` along ``edges`` (child, parent[, w]); with w, products are summed."""
    base, edges = written(base), written(edges)
    if edges.count() <= TASK_EDGES and base.count() <= TASK_EDGES:
        done = _fold(base, edges)
        if done is not None:
            return done
    return _double(base, edges)


def _pairs(hops: DataFrame) -> int:
    """Pairs that doubling the paths would join."""
    into = hops.groupBy(F.col("child").alias("mid")).agg(F.count("*").alias("n"))
    out = hops.groupBy(F.col("parent").alias("mid")).agg(F.count("*").alias("m"))
    return int(into.join(out, "mid").agg(F.sum(F.col("n") * F.col("m"))).first()[0] or 0)


def _double(base: DataFrame, edges: DataFrame) -> DataFrame:
    """``_reach`` by doubling, and by strides from where that would be dense.

    What a round adds is kept as a table of its own, distinct (or summed) in itself; the rounds are
    put together at the end. A round's two products don't need each other and run at once.
    """
    weighted = "w" in edges.columns
    rounds, hops = [base], edges

    def along(hops: DataFrame, colors: DataFrame) -> DataFrame:
        down = hops.withColumnRenamed("w", "v") if weighted else hops
        step = down.join(colors.withColumnRenamed("seq", "parent"), "parent")
        if weighted:
            step = step.select(F.col("child").alias("seq"), "block", (F.col("v") * F.col("w")).alias("w"))
            return written(step.groupBy("seq", "block").agg(F.sum("w").alias("w")))
        return written(step.select(F.col("child").alias("seq"), "block").distinct())

    def doubled(hops: DataFrame) -> DataFrame:
        up = hops.withColumnRenamed("parent", "mid")
        down = hops.withColumnRenamed("child", "mid")
        if weighted:
            both = up.withColumnRenamed("w", "v").join(down, "mid").select("child", "parent", (F.col("v") * F.col("w")).alias("w"))
            return written(both.groupBy("child", "parent").agg(F.sum("w").alias("w")))
        return written(up.join(down, "mid").select("child", "parent").distinct())

    limit = DENSE * (edges.count() + base.count())
    with ThreadPoolExecutor(2) as pool:
        while not hops.isEmpty() and _pairs(hops) <= limit:
            added, next_ = pool.submit(along, hops, reduce(DataFrame.unionByName, rounds)), pool.submit(doubled, hops)
            rounds.append(added.result())
            before, hops = hops, next_.result()
            if before is not edges:
                dropped(before)
    if not hops.isEmpty():
        # Everything over fewer hops than a stride, then over one stride more with every round.
        last = reduce(DataFrame.unionByName, rounds)
        last = written(last.groupBy("seq", "block").agg(F.sum("w").alias("w")) if weighted else last.distinct())
        while not (last := along(hops, last)).isEmpty():
            rounds.append(last)
    every = reduce(DataFrame.unionByName, rounds)
    return every.groupBy("seq", "block").agg(F.sum("w").alias("w")) if weighted else every.distinct()


def _checked_blocks(records: DataFrame) -> DataFrame:
    """Sets and weights hold 32-bit blocks: a larger one is an error."""
    wide = F.raise_error(F.concat(F.lit("block "), F.col("block_id").cast("string"), F.lit(" does not fit in 32 bits"))).cast("long")
    return records.withColumn("block_id", F.when(F.col("block_id") > U32, wide).otherwise(F.col("block_id")))


def closure(records: DataFrame, inputs: DataFrame, spends: DataFrame, mode: str = "sets") -> DataFrame:
    """(seq, block): the set of blocks of every record. ``mode`` sets checks that blocks fit 32 bits, rings doesn't."""
    if mode not in ("sets", "rings"):
        raise ValueError(f"unknown mode {mode!r}")
    own = _checked_blocks(records) if mode == "sets" else records
    return _reach(coinbase(own, inputs).select("seq", "block"), _edges(spends, None))


def weighted(records: DataFrame, inputs: DataFrame, spends: DataFrame) -> DataFrame:
    """(seq, block, w): the distribution of every record's value over blocks. Zero weights stay in the support."""
    base = coinbase(_checked_blocks(records), inputs).select("seq", "block", F.lit(1.0).alias("w"))
    return _reach(base, _edges(shares(spends), F.col("share")))


def path_counts(records: DataFrame, inputs: DataFrame, spends: DataFrame) -> DataFrame:
    """(seq, block, w): on how many spend paths each block is reached (addition in place of union).

    Counts are 64-bit; more paths than that are an error.
    """
    base = coinbase(records, inputs).select("seq", "block", F.lit(1).cast("long").alias("w"))
    return _reach(base, _edges(spends, F.lit(1).cast("long")))


def drift(colors: DataFrame) -> DataFrame:
    """(drift): the largest distance of a record's weights' sum from one."""
    return colors.groupBy("seq").agg(F.sum("w").alias("s")).agg(F.max(F.abs(F.col("s") - 1)).alias("drift"))


def terms(colors: DataFrame) -> DataFrame:
    """(seq, terms): a record's blocks in descending order (with weights: structs of block and w)."""
    term = F.struct("block", "w") if "w" in colors.columns else F.col("block")
    return colors.groupBy("seq").agg(F.sort_array(F.collect_list(term), False).alias("terms"))
