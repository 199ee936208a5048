"""Language-model scores by a weighted backoff automaton.

The model interpolates n-grams up to ``ORDER`` over an add-half unigram base. An n-gram of order k
with count c after a context with count n has the probability (c + m p) / (n + m), p being that of
its suffix of order k - 1 and m the order's ``PRIOR``. As an automaton it has a root, whose arcs
carry the base, and a state for every context (the start and up to ``ORDER - 1`` tokens) that the
training texts go on from. A state has an arc for each token that follows it there, weighted with
the smoothed n-gram, and a failure arc with the mass m / (n + m) that smoothing keeps for the rest;
it leads to the state of the context without its first token. Scoring a text is one traversal from
left to right: it carries a state, follows failure arcs until one has the token's arc, adds the
weights, and goes on from the state of the longest context that the arc's n-gram ends with.

The automaton of a large corpus fits no machine, and needn't. Documents are dealt into blocks; a
block asks the owners of hash ranges for the counts of just those n-grams that its texts may walk
over, sending its own training counts with the question. Owners add the counts of all blocks and
answer. Each block assembles its part of the automaton and traverses it. An n-gram costs its owner
one entry a block, however often it occurs.

N-grams are told apart by hashes: 64 bits for a token; for longer ones 20 bits more than the
corpus's tokens need to be counted, so that at any size about one in a million shares its count
with another.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .substring import _bits, block_sizes
from .textops import Block, Words, chunks, deltas, joined, mix, release, undeltas

#: Highest order, and the weight of an order's lower-order estimate by order from two on.
ORDER = 3
PRIOR = (1000.0, 2.0)
#: Characters of a block and n-grams of an owner at least; both grow with the corpus's square root.
BLOCK_CHARS = 1 << 23
OWNER_ITEMS = 1 << 20
#: Hash bits of an n-gram beyond those that number the corpus's tokens.
SPARE_BITS = 20

_START, _END = np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344)
_MESSAGE = "_block long, _owner long, _row int, _data binary, _more binary"
_ARROW = pa.schema([("_block", pa.int64()), ("_owner", pa.int64()), ("_row", pa.int32()), ("_data", pa.binary()), ("_more", pa.binary())])
_ZSTD = pa.Codec("zstd")
_TOKEN, _GRAM = range(2)
#: Low bits of a key that are sent as they are (some bytes and a half); the rest are sent as differences.
_LOW = 28


def _numbers(x: np.ndarray) -> bytes:
    """Counts as byte planes, compressed: most are ones."""
    wide = 4 if not len(x) or int(x.max()) < 1 << 32 else 8
    return bytes([wide]) + len(x).to_bytes(4, "little") + _ZSTD.compress(x.astype(f"<u{wide}").view(np.uint8).reshape(-1, wide).T.tobytes(), asbytes=True)


def _unnumbers(data: bytes) -> np.ndarray:
    wide, size = data[0], int.from_bytes(data[1:5], "little")
    planes = np.frombuffer(_ZSTD.decompress(data[5:], wide * size), np.uint8).reshape(wide, -1)
    return np.ascontiguousarray(planes.T).view(f"<u{wide}").reshape(-1).astype(np.int64)


def _keys(x: np.ndarray) -> bytes:
    """Ascending keys: differences of their high bits, compressed, and planes of their low bytes and half bytes."""
    high = deltas(x >> np.uint64(_LOW))
    packed = _ZSTD.compress(high, asbytes=True)
    low = np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8)[:, : _LOW // 8].T.tobytes()
    half = ((x >> np.uint64(_LOW - 4)) & np.uint64(15)).astype(np.uint8)
    half = np.append(half, np.zeros(len(half) % 2, np.uint8))
    return b"".join([len(high).to_bytes(4, "little"), len(packed).to_bytes(4, "little"), packed, low, (half[0::2] << 4 | half[1::2]).tobytes()])


def _unkeys(data: bytes) -> np.ndarray:
    size, end = int.from_bytes(data[:4], "little"), 8 + int.from_bytes(data[4:8], "little")
    high = undeltas(_ZSTD.decompress(data[8:end], size, asbytes=True))
    n, planes = len(high), _LOW // 8
    low = np.zeros((n, 8), np.uint8)
    low[:, :planes] = np.frombuffer(data, np.uint8, planes * n, end).reshape(planes, -1).T
    pairs = np.frombuffer(data, np.uint8, offset=end + planes * n)
    half = np.stack([pairs >> 4, pairs & 15], axis=1).reshape(-1)[:n]
    return high << np.uint64(_LOW) | half.astype(np.uint64) << np.uint64(_LOW - 4) | low.view("<u8").reshape(-1)


def _table(rows: list) -> pa.Table:
    return pa.Table.from_pylist([dict(zip(_ARROW.names, r)) for r in rows], schema=_ARROW)


def _rows(t: pa.Table) -> list[tuple]:
    return list(zip(*(t.column(k).to_pylist() for k in _ARROW.names)))


class _Sizes:
    def __init__(self, chars: int):
        grams = ORDER * (chars // 5)
        block, items = block_sizes(chars, BLOCK_CHARS, OWNER_ITEMS)
        self.blocks = max(1, -(-chars // block))
        self.owner_bits = _bits(grams / items)
        self.width = min(62, max(40, _bits(grams) + SPARE_BITS))

    def owners(self, kind: int, keys: np.ndarray) -> np.ndarray:
        """Owners of keys by their first bits."""
        width = 64 if kind == _TOKEN else self.width
        return (keys >> np.uint64(width - self.owner_bits)).astype(np.int64) if self.owner_bits else np.zeros(len(keys), np.int64)


class _Part:
    """Tokens of some texts, each text after the start and before its end, and the longer n-grams.

    ``at[k]``: for each token, the place of the n-gram of order k + 1 that ends with it among the distinct keys of
    its kind, or -1 where the text hasn't so many tokens before it; ``context[k]``: likewise of the n-gram before it.
    """

    def __init__(self, words: Words, learnt: np.ndarray, sizes: _Sizes):
        n, docs = len(words.doc), len(words.count)
        begin = words.first + 2 * np.arange(docs + 1)
        every = np.full(n + 2 * docs, _END, np.uint64)
        every[begin[:-1]] = _START
        every[np.arange(n) + 2 * words.doc + 1] = words.hashes(0)
        self.first = words.first + np.arange(docs + 1)
        place = np.delete(np.arange(len(every), dtype=np.int32), begin[:-1])
        used = np.repeat(learnt, np.diff(begin))
        self.tokens, token_at = np.unique(every, return_inverse=True)
        token_at = token_at.astype(np.int32)
        # The start counts as often as texts are learnt from.
        self.token_n = np.bincount(token_at, used, len(self.tokens)).astype(np.int64)
        depth = (np.arange(len(every)) - np.repeat(begin[:-1], np.diff(begin))).astype(np.int32)
        gram, keys, ends = every, [], []
        for k in range(1, ORDER):
            gram = joined(gram[:-1], every[k:])
            ends.append(np.flatnonzero(depth[k:] >= k).astype(np.int32))
            keys.append(mix(gram[ends[-1]] + np.uint64(k)) >> np.uint64(64 - sizes.width))
        keys = np.concatenate(keys)
        # What isn't needed any more would stand beside the sort.
        del gram, depth, every
        self.keys, key_at = np.unique(keys, return_inverse=True)
        del keys
        self.key_n = np.bincount(key_at, np.concatenate([used[k + 1 :][x] for k, x in enumerate(ends)]), len(self.keys)).astype(np.int64)
        at, done = [token_at], 0
        for k, x in enumerate(ends):
            one = np.full(len(token_at), -1, np.int32)
            one[x + k + 1] = key_at[done : done + len(x)]
            done += len(x)
            at.append(one)
        self.at = [x[place] for x in at]
        self.context = [x[place - 1] for x in at[:-1]]


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of (keys, counts) together, with their counts added."""
    if len(parts) == 1:
        return parts[0]
    keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(at, np.concatenate([n for _, n in parts]), len(keys)).astype(np.int64)


class _Grams:
    """The distinct tokens and longer n-grams of a block, with how often its texts that are learnt from have them."""

    def __init__(self, t: pa.Table, sizes: _Sizes):
        release()
        ids, texts = t.column("_id").to_pylist(), t.column("_text").to_pylist()
        order = sorted(range(len(ids)), key=lambda k: (ids[k] is not None, ids[k] or 0, texts[k] or ""))
        self.block, self.sizes, self._last = Block(ids, texts, order, lower=True), sizes, (-1, None)
        self.learnt = t.column("_learnt").to_numpy()[order].astype(bool)
        tokens, keys = [], []
        for k in range(len(self.block.parts)):
            own = self.part(k)
            tokens.append((own.tokens, own.token_n))
            keys.append((own.keys, own.key_n))
        self.tokens, self.token_n = _summed(tokens)
        self.keys, self.key_n = _summed(keys)

    def part(self, k: int) -> _Part:
        """One part's tokens and n-grams; the last one made is kept."""
        if self._last[0] != k:
            self._last = (-1, None)
            a, b = self.block.parts[k]
            self._last = (k, _Part(self.block.words(k), self.learnt[a:b], self.sizes))
            self.block.forget()
        return self._last[1]


def _borders(owner: np.ndarray) -> list[tuple[int, int]]:
    cut_ = np.flatnonzero(np.diff(owner, prepend=owner[:1] - 1)) if len(owner) else []
    return list(zip(cut_, [*cut_[1:], len(owner)]))


def _ask(sizes: _Sizes):
    def run(key: tuple, t: pa.Table) -> pa.Table:
        own, block, out = _Grams(t, sizes), key[0].as_py(), []
        for kind, keys, n in ((_TOKEN, own.tokens, own.token_n), (_GRAM, own.keys, own.key_n)):
            owner = sizes.owners(kind, keys)
            out += [(block, int(owner[a]), kind, _keys(keys[a:b]), _numbers(n[a:b])) for a, b in _borders(owner)]
        return _table(out)

    return run


def _add(key: tuple, t: pa.Table) -> pa.Table:
    """Adds the counts of one owner's n-grams and answers each block, in the order of its keys."""
    rows, out = _rows(t), []
    for kind in (_TOKEN, _GRAM):
        asked = [(b, o, _unkeys(d), _unnumbers(m)) for b, o, r, d, m in rows if r == kind]
        if asked:
            distinct, at = np.unique(np.concatenate([k for *_, k, _ in asked]), return_inverse=True)
            total = np.bincount(at, np.concatenate([n for *_, n in asked]), len(distinct)).astype(np.int64)
            end = np.cumsum([len(k) for *_, k, _ in asked])
            out += [(b, o, kind, None, _numbers(total[at[e - len(k) : e]])) for (b, o, k, _), e in zip(asked, end)]
    return _table(out)


def _traverse(first: list, arcs: list, fails: list, depth0: int, order: int) -> list[float]:
    """The weight of each text: ``arcs[d]`` of a token isn't a number where the state of d tokens has no arc for it.

    ``fails[d]`` is the failure weight of that state. The root has an arc for every token; ``fails[0]`` tells whether the
    token itself is a state.
    """
    out, top, root, states = [], order - 1, arcs[0], fails[0]
    for a, b in zip(first[:-1], first[1:]):
        depth, total = depth0, 0.0
        for i in range(a, b):
            while depth and (weight := arcs[depth][i]) != weight:
                total += fails[depth][i]
                depth -= 1
            if depth:
                total += weight
                depth = min(depth + 1, top)
            else:
                total += root[i]
                depth = states[i]
        out.append(total)
    return out


def _walk(sizes: _Sizes, total: int, distinct: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        own = _Grams(left, sizes)
        none, told = np.zeros(0, np.int64), _rows(right)
        token_n, key_n = (np.concatenate([none, *(_unnumbers(m) for _, m in sorted((o, m) for _, o, r, _, m in told if r == kind))]) for kind in (_TOKEN, _GRAM))
        starts = int(token_n[np.searchsorted(own.tokens, _START)])
        found = [_scored(own.part(k), own, token_n, key_n, starts, total, distinct) for k in range(len(own.block.parts))]
        n, known, base, score = (np.concatenate(x) for x in zip(*found))
        ids = left.select(["_id"]).take(pa.array(own.block.order, pa.int64()))
        return pa.table({"_id": ids.column("_id"), "_learnt": pa.array(own.learnt), "_tokens": n, "_known": known, "_base": base, "_score": score})

    return run


def _scored(part: _Part, own: _Grams, token_n: np.ndarray, key_n: np.ndarray, starts: int, total: int, distinct: int) -> tuple:
    """Tokens, known tokens, base and score of each text of a part, by the counts of the block's tokens and n-grams."""
    token_n = token_n if part.tokens is own.tokens else token_n[np.searchsorted(own.tokens, part.tokens)]
    key_n = key_n if part.keys is own.keys else key_n[np.searchsorted(own.keys, part.keys)]
    seen = np.where(part.tokens == _START, 0, token_n)
    base = ((seen + 0.5) / (total + 0.5 * (distinct + 1)))[part.at[0]]
    known = seen[part.at[0]] > 0
    root = np.log10(base)
    gather = lambda x: np.add.reduceat(x, part.first[:-1])  # noqa: E731  every text has its end at least

    smooth, arcs, fails = base, [root], [known]
    counts = [token_n, *[key_n] * (ORDER - 1)]
    for k in range(1, ORDER):
        here, before = part.at[k], part.context[k - 1]
        n = np.where(before >= 0, counts[k - 1][before], 0)
        c = np.where(here >= 0, key_n[here], 0)
        smooth = (c + PRIOR[k - 1] * smooth) / (n + PRIOR[k - 1])
        arcs.append(np.where(c > 0, np.log10(smooth), np.nan))
        fails.append(np.log10(PRIOR[k - 1] / (n + PRIOR[k - 1])))
    score = []
    # A few texts at a time, since the traversal reads plain numbers.
    step = np.searchsorted(part.first, np.arange(0, part.first[-1] + 1, 1 << 16), "left")
    for a, b in zip(step, [*step[1:], len(part.first) - 1]):
        if a < b:
            lo, hi = part.first[a], part.first[b]
            some = [x[lo:hi].tolist() for x in arcs]
            score += _traverse((part.first[a : b + 1] - lo).tolist(), some, [known[lo:hi].astype(int).tolist(), *(x[lo:hi].tolist() for x in fails[1:])], int(starts > 0), ORDER)
    return np.diff(part.first), gather(known.astype(np.int64)), gather(root), np.array(score, float)


def _distinct(bits: int):
    """Distinct tokens of a partition's texts by owner, and how many tokens they are."""

    def send(held: list, n: int):
        tokens = np.unique(np.concatenate([np.array([_END]), *held])) if n else np.zeros(0, np.uint64)
        owner = (tokens >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(tokens), np.int64)
        parts = _borders(owner)
        return pa.RecordBatch.from_pydict({"_owner": [int(owner[a]) for a, _ in parts], "_data": [_keys(tokens[a:b]) for a, b in parts], "_n": [n * (k == 0) for k in range(len(parts))]}, schema=pa.schema([("_owner", pa.int64()), ("_data", pa.binary()), ("_n", pa.int64())]))

    def run(batches):
        held, size, n = [], 0, 0
        for batch in batches:
            for _, _, texts in chunks(batch.column("_text")):
                words = Words(texts, lower=True)
                held.append(np.unique(words.hashes(0)))
                size, n = size + len(held[-1]), n + len(words.doc) + len(texts)
                if size > 1 << 22:
                    held = [np.unique(np.concatenate(held))]
                    size = len(held[0])
                    if size > 1 << 21:
                        yield send(held, n)
                        held, size, n = [], 0, 0
        if n:
            yield send(held, n)

    return run


def _count_distinct(t: pa.Table) -> pa.Table:
    return pa.table({"_distinct": [len(np.unique(np.concatenate([_unkeys(d) for d in t.column("_data").to_pylist()])))], "_n": [sum(t.column("_n").to_pylist())]})


def scores(docs: DataFrame, learn_from: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    Learns from the rows for which ``learn_from`` is true (null is not) and scores all. Tokens are
    the words, A-Z in lower case, and one end. ``base_score`` sums log10((c + 0.5) / (N + 0.5 *
    (V + 1))) over a text's tokens, ``score`` is the automaton's log10 probability of the text.

    A null or empty text is its end alone. Null ids are scored like others. Repeated rows count as
    often as they stand. Without rows to learn from, N and V are 0 and all weights the base's. An
    empty table gives no rows; other columns are ignored, whatever their names.
    """
    own = docs.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.col(f"`{text_col}`").alias("_text"), F.coalesce(learn_from, F.lit(False)).alias("_learnt"))
    chars = int(own.agg(F.sum(F.length("_text"))).first()[0] or 0)
    sizes = _Sizes(chars)
    tokens = own.filter("_learnt").select("_text").mapInArrow(_distinct(sizes.owner_bits), "_owner long, _data binary, _n long")
    sums = tokens.groupBy("_owner").applyInArrow(_count_distinct, "_distinct long, _n long").agg(F.sum("_n"), F.sum("_distinct")).first()
    total, distinct = int(sums[0] or 0), int(sums[1] or 0)

    dealt = own.withColumn("_block", F.pmod(F.xxhash64("_id", "_text"), F.lit(sizes.blocks)).cast("long"))
    asked = dealt.groupBy("_block").applyInArrow(_ask(sizes), _MESSAGE)
    told = asked.groupBy("_owner").applyInArrow(_add, _MESSAGE)
    out = dealt.groupBy("_block").cogroup(told.groupBy("_block")).applyInArrow(_walk(sizes, total, distinct), "_id long, _learnt boolean, _tokens long, _known long, _base double, _score double")
    return out.select(F.col("_id").alias("doc_id"), (~F.col("_learnt")).alias("held_out"), F.col("_tokens").alias("n_tokens"), F.col("_known").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), F.col("_base").alias("base_score"), F.col("_score").alias("score"))
