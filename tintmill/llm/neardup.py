"""Near-duplicates by min-max hashing.

Every permutation of a document's shingle hashes gives two signature values, its least and its
greatest, so 160 values cost 80 hash evaluations a shingle. Five values from five permutations make
a band; documents that agree on a band are candidates. A pair at similarity 0.8 misses all 32 bands
with probability (1 - 0.8**5)**32 = 3e-6. Links are confirmed on the full shingle sets.

Equal word sequences, told by a 128-bit cryptographic digest of the words, are one node from the
start. A bucket's members are checked against a star,
its least member, then against a second star. Where members still lie in different components,
the bucket is compared in squares of bounded side, to which the members bring their sets as hashes.
A square gives only links, and of those only what joins components: no candidate pair leaves it.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import components
from .common import WORD, cut, small, small_batches
from .textops import Words, chunks, inside, mix, ngrams, release

PERMUTATIONS, BAND = 80, 5
#: Signature agreement this far under the similarity rules a pair out in a square: eight deviations below a similarity of 0.8.
SLACK = 0.25
#: Side of the squares in which a bucket's pairs are compared, and pairs of a star that one task confirms, about.
SIDE, STAR_PAIRS = 1024, 256
#: A class of equal texts is hot with this many rows at least, and with this share of all rows, so there are at most 100,000 hot ones.
HOT_ROWS, HOT_SHARE = 1000, 1e-5

_RNG = np.random.default_rng(2014)
_XOR = _RNG.integers(0, 1 << 64, PERMUTATIONS, dtype=np.uint64)
_MUL = _RNG.integers(0, 1 << 64, PERMUTATIONS, dtype=np.uint64) | np.uint64(1)
_SIGNED = "_id long, _n long, _k1 long, _k2 long, _bands array<long>, _sig binary"


def shingle_sets(words: Words, h: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, one text after another, and where each text's begin.

    A text with fewer words than a shingle has its whole sequence as one; without words, none.
    """
    at = inside(words.first, size, len(h))
    g, doc = (ngrams(h, size)[at], words.doc[at]) if len(at) else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    short = np.flatnonzero((words.count > 0) & (words.count < size))
    if len(short):
        g, doc = np.concatenate([g, words.digests()[short, 0]]), np.concatenate([doc, short])
    order = np.lexsort((g, doc))
    g, doc = g[order], doc[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (doc[1:] != doc[:-1])
    g, doc = g[new], doc[new]
    return g, np.searchsorted(doc, np.arange(len(words.count) + 1))


def _sign(size: int):
    def run(batches):
        for batch in batches:
            ids = batch.column("_id")
            for a, b, texts in chunks(batch.column("_text")):
                words = Words(texts, lower=True)
                h = words.hashes(0)
                g, first = shingle_sets(words, h, size)
                n = np.diff(first)
                full = np.flatnonzero(n)
                values = np.zeros((len(full), 2 * PERMUTATIONS), np.uint64)
                if len(full):
                    begin = first[:-1][full]
                    for p in range(PERMUTATIONS):
                        v = (g ^ _XOR[p]) * _MUL[p]
                        values[:, p] = np.minimum.reduceat(v, begin)
                        values[:, PERMUTATIONS + p] = np.maximum.reduceat(v, begin)
                bands = np.zeros((len(full), 2 * PERMUTATIONS // BAND), np.uint64)
                for k in range(BAND):
                    bands = mix(bands * np.uint64(0x9E3779B97F4A7C15) + values[:, k::BAND] + np.uint64(k))
                bands = mix(bands + np.arange(bands.shape[1], dtype=np.uint64)[None] * np.uint64(0xD1B54A32D192ED03)).view(np.int64)
                sig = mix(values).astype(np.uint16)
                whole = words.digests().view(np.int64)
                where = np.full(b - a, -1)
                where[full] = np.arange(len(full))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(a, b - a),
                        pa.array(n, pa.int64()),
                        pa.array(np.ascontiguousarray(whole[:, 0])),
                        pa.array(np.ascontiguousarray(whole[:, 1])),
                        pa.array([bands[k] if k >= 0 else [] for k in where.tolist()], pa.list_(pa.int64())),
                        pa.array([sig[k].tobytes() if k >= 0 else b"" for k in where.tolist()], pa.binary()),
                    ],
                    names=["_id", "_n", "_k1", "_k2", "_bands", "_sig"],
                )
        release()

    return run


_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _set(text: str, size: int) -> set:
    words = re.findall(WORD, text.translate(_LOWER))
    return set(zip(*(words[k:] for k in range(size)))) if len(words) >= size else {tuple(words)} if words else set()


def _confirm(size: int, percent: int):
    def run(batches):
        last, held = None, set()
        # A few rows at a time: every row brings two texts.
        for batch in (whole.slice(a, 128) for whole in batches for a in range(0, whole.num_rows, 128)):
            u, v, left, right = (batch.column(k).to_pylist() for k in ("u", "v", "tu", "tv"))
            good = []
            for k in range(len(u)):
                if u[k] != last:
                    last, held = u[k], _set(left[k] or "", size)
                other = _set(right[k] or "", size)
                both = len(held & other)
                good.append(100 * both >= percent * (len(held) + len(other) - both) > 0)
            yield batch.select(["u", "v"]).filter(pa.array(good))
        release()

    return run


def _texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The text of each id, the least in code point order where an id stands on several rows."""
    return docs.join(small(ids, ids.count()), "_id", "left_semi").groupBy("_id").agg(F.min("_text").alias("_text"))


def _links(pairs: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (u, v) of (u, v, parts) whose full sets are alike enough. Only texts that stand in a pair are moved.

    A star's pairs are dealt into as many parts as its largest bucket asks for, each with its text.
    """
    texts = _texts(docs, pairs.select(F.explode(F.array("u", "v")).alias("_id")).distinct())
    dealt = pairs.select("u", "v", F.pmod(F.xxhash64("v"), "parts").alias("part"))
    heads = dealt.select("u", "part").distinct().join(texts.select(F.col("_id").alias("u"), F.col("_text").alias("tu")), "u")
    tails = dealt.join(texts.select(F.col("_id").alias("v"), F.col("_text").alias("tv")), "v")
    return tails.join(heads, ["u", "part"]).select("u", "v", "tu", "tv").mapInArrow(_confirm(size, percent), "u long, v long")


def _short(size: int):
    """Sets as 64-bit hashes."""

    def run(batches):
        for batch in batches:
            for a, b, texts in chunks(batch.column("_text")):
                words = Words(texts, lower=True)
                g, first = shingle_sets(words, words.hashes(0), size)
                sets = [g[i:j].tobytes() for i, j in zip(first[:-1], first[1:])]
                yield pa.RecordBatch.from_arrays([batch.column("_id").slice(a, b - a), pa.array(sets, pa.binary())], names=["_rep", "_set"])
        release()

    return run


def _square(percent: int):
    def run(t: pa.Table) -> pa.Table:
        side, ids, comp, n = (np.asarray(t.column(k)) for k in ("_side", "_rep", "_comp", "_n"))
        sig = np.frombuffer(b"".join(t.column("_sig").to_pylist()), np.uint16).reshape(len(ids), -1)
        raw = t.column("_set").to_pylist()
        size = np.array([len(x) // 8 for x in raw])
        names, at = np.unique(np.frombuffer(b"".join(raw), np.uint64), return_inverse=True)
        first = np.concatenate([[0], np.cumsum(size)])
        mark = np.zeros(len(names), bool)
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while (up := root.get(x, x)) != x:
                root[x] = x = root.get(up, up)
            return x

        rows, cols = (np.flatnonzero(side != 1), np.flatnonzero(side != 0))
        out = []
        for r in rows:
            ok = cols[(ids[cols] > ids[r]) | (side[r] != 2)]
            ok = ok[(comp[ok] != comp[r]) & (100 * np.minimum(n[ok], n[r]) >= percent * np.maximum(n[ok], n[r]))]
            ok = ok[(sig[ok] == sig[r]).mean(axis=1) >= percent / 100 - SLACK]
            if not len(ok):
                continue
            own = at[first[r] : first[r + 1]]
            mark[own] = True
            for k in range(0, len(ok), 256):
                some = ok[k : k + 256]
                both = np.add.reduceat(mark[np.concatenate([at[first[c] : first[c + 1]] for c in some])], np.concatenate([[0], np.cumsum(size[some])[:-1]]), dtype=np.int64)
                for c in some[100 * both >= percent * (size[r] + size[some] - both)]:
                    x, y = find(int(comp[r])), find(int(comp[c]))
                    if x != y:
                        root[max(x, y)] = min(x, y)
                        out.append((min(ids[r], ids[c]), max(ids[r], ids[c])))
            mark[own] = False
        out = np.array(out, np.int64).reshape(-1, 2)
        return pa.table({"u": out[:, 0], "v": out[:, 1]})

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_shingles, component_id, kept``.

    Texts have A-Z in lower case; a document's set is its distinct ``size``-word shingles (with
    fewer words the whole sequence as one). Documents with 100 * intersection >= ``percent`` *
    union are linked; ``component_id`` is the smallest id reachable, ``kept`` marks the document
    that has it. A null or empty text, or one without words, has an empty set, is linked with
    nothing and kept. A null id is kept and has a null component; its copies are still found. An id
    on several rows is one document: rows of equal texts share a component, and where its texts
    differ, links between different word sequences are confirmed on the least of them. An empty table gives no rows;
    other columns are ignored, whatever their names.
    """
    own = docs.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.col(f"`{text_col}`").alias("_text"))
    with small_batches(docs.sparkSession):
        return _grouped(own, size, percent)


def _grouped(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """``near_duplicates`` of (_id, _text); every step that goes through Python is done when it returns."""
    signed = cut(docs.mapInArrow(_sign(size), _SIGNED))
    named = signed.filter("_id is not null and _n > 0")
    reps = named.groupBy("_k1", "_k2").agg(F.min("_id").alias("_rep"), F.first("_bands").alias("_bands"), F.count("*").alias("_rows"))
    placed = reps.select("_rep", F.explode("_bands").alias("_bucket"))
    stars = placed.groupBy("_bucket").agg(F.min("_rep").alias("_star"), F.max("_rep").alias("_end"), F.count("*").alias("_size")).filter("_star < _end")
    members = cut(placed.join(stars, "_bucket"))
    parts = F.max(F.ceil(F.col("_size") / STAR_PAIRS)).alias("parts")
    pairs = cut(members.filter("_rep <> _star").groupBy(F.col("_star").alias("u"), F.col("_rep").alias("v")).agg(parts))
    seen, edges = pairs, cut(_links(pairs, docs, size, percent))

    def placed_in(edges: DataFrame) -> DataFrame:
        """Members of the buckets that lie in several components still."""
        comps = components(edges)
        own = members.join(comps.withColumnRenamed("node", "_rep"), "_rep", "left").withColumn("_comp", F.coalesce("comp", "_rep")).drop("comp")
        mixed = own.groupBy("_bucket").agg(F.min("_comp").alias("_lo"), F.max("_comp").alias("_hi")).filter("_lo < _hi")
        return cut(own.join(mixed, "_bucket"))

    left = placed_in(edges)
    second = left.filter("_rep = _end").select("_bucket", F.col("_comp").alias("_other")).distinct()
    pairs = left.join(second, "_bucket").filter("_comp <> _other").groupBy(F.col("_end").alias("u"), F.col("_rep").alias("v")).agg(parts)
    # A pair that was confirmed lies in one component by now; one that wasn't has the other end as u.
    seen = seen.select(F.col("u").alias("v"), F.col("v").alias("u"))
    pairs = cut(pairs.join(seen, ["u", "v"], "left_anti"))
    if not pairs.isEmpty():
        edges = cut(edges.unionByName(_links(pairs, docs, size, percent)))
        left = placed_in(edges)
    if not left.isEmpty():
        facts = named.groupBy(F.col("_id").alias("_rep")).agg(F.first("_n").alias("_n"), F.first("_sig").alias("_sig"))
        sets = _texts(docs, left.select(F.col("_rep").alias("_id")).distinct()).mapInArrow(_short(size), "_rep long, _set binary")
        square = left.join(facts, "_rep").join(sets, "_rep").withColumn("_parts", F.ceil(F.col("_size") / SIDE).cast("int")).withColumn("_part", F.pmod(F.xxhash64("_rep"), "_parts").cast("int"))
        # A member stands in the row of the squares from its part on, and in the column of those before it.
        square = square.withColumn("_at", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).select(
            "_bucket", F.least("_part", "_at").alias("_i"), F.greatest("_part", "_at").alias("_j"), F.when(F.col("_part") == F.col("_at"), 2).otherwise(F.when(F.col("_part") < F.col("_at"), 0).otherwise(1)).alias("_side"), "_rep", "_comp", "_n", "_sig", "_set")
        pairs = square.groupBy("_bucket", "_i", "_j").applyInArrow(_square(percent), "u long, v long").distinct()
        pairs = cut(pairs.withColumn("parts", F.lit(1).cast("long")))
        if not pairs.isEmpty():
            edges = cut(edges.unionByName(_links(pairs, docs, size, percent)))
    comps = components(edges)
    keyed = reps.select("_k1", "_k2", "_rep", "_rows").join(comps.withColumnRenamed("node", "_rep"), "_rep", "left").select("_k1", "_k2", F.coalesce("comp", "_rep").alias("_comp"), "_rows")
    # Rows of hot classes meet their component where they are; the others are exchanged by class.
    many = F.col("_rows") >= max(HOT_ROWS, int(HOT_SHARE * signed.count()))
    hot = keyed.filter(many).select("_k1", "_k2", F.col("_comp").alias("_hot"))
    near = signed.filter("_n > 0").select("_id", "_n", "_k1", "_k2").join(F.broadcast(hot), ["_k1", "_k2"], "left")
    cold = near.filter("_hot is null").drop("_hot").join(keyed.filter(~many).drop("_rows"), ["_k1", "_k2"], "left")
    found = near.filter("_hot is not null").withColumnRenamed("_hot", "_comp").unionByName(cold).select("_id", "_n", F.when(F.col("_id").isNotNull(), F.col("_comp")).alias("_comp"))
    alone = signed.filter("_n = 0").select("_id", "_n", F.col("_id").alias("_comp"))
    return found.unionByName(alone).select(F.col("_id").alias("doc_id"), F.col("_n").alias("n_shingles"), F.col("_comp").alias("component_id"), F.col("_id").eqNullSafe(F.col("_comp")).alias("kept"))
