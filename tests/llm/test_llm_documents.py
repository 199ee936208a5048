"""Operators on documents against brute force, on plain tables and on awkward ones."""

import collections
import hashlib
import math
import os
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tintmill.llm import fingerprints, licences, lm, mixing, neardup, packing, quality, substring, textops
from tintmill.llm.queries import remainder, tokenizer_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
KIND = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return WORD.findall(text or "")


def corpus(seed=1, n=90):
    """Texts with copies, near copies, a shared passage and repeats inside a text."""
    rng = random.Random(seed)
    vocabulary = [f"{a}{b}{c}" for a in "bdgkl" for b in "aeo" for c in ("n", "r", "st", "É", "")]
    make = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    passage, texts = make(60), []
    for k in range(n):
        t = make(rng.choice([1, 2, 5, 19, 20, 40, 120]))
        if k % 7 == 3:
            t = rng.choice(texts)
        elif k % 7 == 5 and texts:
            old = rng.choice(texts).split()
            old[rng.randrange(len(old))] = "changed"
            t = " ".join(old)
        elif k % 5 == 1:
            t = f"{make(8)}\n{passage}\t{make(8)}"
        elif k % 11 == 2:
            t = "same word " * 40
        texts.append(t)
    return [(k * 3, t, "en", f"s{k % 4}" if k % 9 else "hot", len(t)) for k, t in enumerate(texts)]


AWKWARD = [
    (None, "a null id " * 12, None, None, None),
    (4, None, "en", None, None),
    (5, "", "en", "s", 0),
    (6, " \n\t ", None, "s", 4),
    (7, "one", "en", "s", 3),
    (8, "Same text here, twice or more", "en", "s", 1),
    (9, "same TEXT here, twice or more", "en", "t", 1),
    (9, "same TEXT here, twice or more", "en", "t", 1),
    (10, "very long " * 30_000, "en", "t", 1),
    (11, "x" * 5000, "en", "t", 1),
    (12, "snow \U0001f9ca and é é é", "en", "t", 1),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), KIND).repartition(3).cache()


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame(AWKWARD, KIND).cache()


@pytest.fixture(scope="module")
def clashing(awkward):
    """Extra columns with names that operators use themselves."""
    names = ("_id", "_block", "_row", "_text", "_rest", "size", "piece", "score", "n_words", "taken", "_size", "u", "rank", "ids")
    return awkward.select("*", *(F.lit(k).alias(name) for k, name in enumerate(names)))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], KIND)


LABELS = "doc_id long, quality int, toxic int"


def every(df, spark):
    labels = spark.createDataFrame([(4, 0, 0), (5, 1, 0), (8, 1, 0), (10, 0, None), (None, 1, 0), (7, None, 1), (12, 1, 1)], LABELS)
    return {
        "mix": lambda: mixing.mix(df, carry=["doc_id"]),
        "mix whole": lambda: mixing.emit(mixing.mix(df)),
        "substring": lambda: substring.remove_repeats(df),
        "quality": lambda: quality.score(df, labels),
        "quality narrow": lambda: quality.score(df, labels, carry=["doc_id"]),
        "licences": lambda: licences.scan(df),
        "packing": lambda: packing.pack(df, tokenizer_path()),
        "near": lambda: neardup.near_duplicates(df, size=2),
        "lm": lambda: lm.scores(df, remainder(F.col("doc_id"), 5) != 1),
        "fingerprints": lambda: fingerprints.fingerprints(df),
    }


NAMES = ["mix", "mix whole", "substring", "quality", "quality narrow", "licences", "packing", "near", "lm", "fingerprints"]


@pytest.mark.parametrize("name", NAMES)
def test_empty_tables_give_no_rows(spark, empty, name):
    assert every(empty, spark)[name]().collect() == []


@pytest.mark.parametrize("name", NAMES)
def test_awkward_rows_and_clashing_names_are_whole(spark, awkward, clashing, name):
    plain, more = every(awkward, spark)[name]().collect(), every(clashing, spark)[name]().collect()
    assert len(plain) == len(more)
    if name == "licences":
        assert len(plain) == len({r[0] for r in AWKWARD})
    elif name not in ("packing", "mix whole"):
        assert len(plain) == len(AWKWARD)
    elif name == "packing":
        assert {r.doc_id for r in plain} == {r[0] for r in AWKWARD}


def test_texts_are_split_like_the_pattern():
    texts = [None, "", " ", "a b  c\n", "\ta", "é\x0bü  x\x1c", "\x85 nbsp\xa0"]
    found = textops.Words(texts)
    assert [found.blob[a:b].decode() for a, b in zip(found.starts, found.ends)] == [w for t in texts for w in words(t)]
    assert found.count.tolist() == [len(words(t)) for t in texts]


def test_deltas_come_back():
    for values in ([], [0], [5, 5, 5], sorted(random.Random(0).randrange(1 << 60) for _ in range(500))):
        assert textops.undeltas(textops.deltas(np.array(values, np.uint64))).tolist() == values


def brute_repeats(rows):
    starts = collections.defaultdict(list)
    for i, t, *_ in rows:
        w = words(t)
        for k in range(len(w) - 19):
            starts[tuple(w[k : k + 20])].append((-(1 << 63) if i is None else i, k))
    first = {w: min(at) for w, at in starts.items()}
    out = []
    for i, t, *_ in rows:
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - 19):
            if first[tuple(w[k : k + 20])] != (-(1 << 63) if i is None else i, k):
                gone[k : k + 20] = [True] * 20
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return out


@pytest.mark.parametrize("which", ["docs", "awkward"])
def test_substring_dedup(request, which):
    df = request.getfixturevalue(which)
    got = [(r.doc_id, r.n_words, r.n_removed, r.text) for r in substring.remove_repeats(df, join=True).collect()]
    key = lambda r: tuple(map(str, r))
    assert sorted(got, key=key) == sorted(brute_repeats(corpus() if which == "docs" else AWKWARD), key=key)


def test_blocks_grow_with_the_square_root_of_the_corpus():
    assert substring.block_sizes(10**9, 1 << 21, 1 << 20) == (1 << 21, 1 << 20)
    block, items = substring.block_sizes(10**14, 1 << 21, 1 << 20)
    assert 1.7e8 < block < 1.9e8 and abs(block * items / 10**14 - substring.MESSAGE_ITEMS) < 1


def test_parts_of_a_block_change_nothing(spark, docs, monkeypatch):
    """Words laid out a few texts at a time, in one block: the same removals and scores."""
    df = docs.unionByName(docs.limit(0)).coalesce(1)
    plain = substring.remove_repeats(df, join=True).select("doc_id", "n_removed", "text").collect()
    scored = lm.scores(df, F.col("doc_id") % 2 == 0).collect()
    own = textops.Block.__init__
    small = lambda self, ids, texts, order, lower=False, limit=0: own(self, ids, texts, order, lower, 300)
    block = textops.Block([1, 2, 3], ["a" * 200, "b" * 200, None], [0, 1, 2], limit=300)
    assert block.parts == [(0, 1), (1, 3)]
    monkeypatch.setattr(textops.Block, "__init__", small)

    t = df.select(F.lit(0).cast("long").alias("_block"), F.col("doc_id").alias("_id"), F.col("text").alias("_text"), (F.col("doc_id") % 2 == 0).alias("_learnt")).toArrow()
    plan = substring._Plan(100, substring.WINDOW)
    plan.blocks, plan.owner_bits = 1, 0
    key = (pa.scalar(0),)
    repeated = substring._merge(substring._sketch(plan)(key, t))
    later = substring._group(substring._exact(plan)(t, repeated))
    done = substring._remove(plan, True)(t.drop_columns(["_learnt"]).append_column("_rest", pa.array([None] * t.num_rows)), later)
    assert sorted(zip(done["_id"].to_pylist(), done["_removed"].to_pylist(), done["_kept"].to_pylist())) == sorted(map(tuple, plain))
    sizes = lm._Sizes(1000)
    asked = lm._ask(sizes)(key, t)
    told = lm._add(key, asked)
    total = scored[0].train_tokens
    train = [w for i, x, *_ in corpus() if i % 2 == 0 for w in [*words(x.translate(LOWER)), "\0"]]
    out = lm._walk(sizes, total, len(set(train)))(t, told).to_pydict()
    want = {r.doc_id: (r.n_tokens, r.n_known, r.score) for r in scored}
    for i, n, known, score in zip(out["_id"], out["_tokens"], out["_known"], out["_score"]):
        assert (n, known) == want[i][:2] and math.isclose(score, want[i][2], rel_tol=1e-12)


def test_substring_dedup_over_many_blocks(docs, monkeypatch):
    monkeypatch.setattr(substring, "BLOCK_CHARS", 500)
    monkeypatch.setattr(substring, "MESSAGE_ITEMS", 0)
    monkeypatch.setattr(substring, "OWNER_ITEMS", 64)
    got = {(r.doc_id, r.n_words, r.n_removed, r.text) for r in substring.remove_repeats(docs, join=True).collect()}
    assert got == set(brute_repeats(corpus()))


def shingles(text, size):
    w = words((text or "").translate(LOWER))
    return set(zip(*(w[k:] for k in range(size)))) if len(w) >= size else {tuple(w)} if w else set()


def brute_components(rows, size):
    sets = {i: shingles(t, size) for i, t, *_ in rows if i is not None}
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates(docs, size):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(docs, size=size).collect()}
    assert got == brute_components(corpus(), size)


def test_near_duplicates_with_hot_classes_and_small_squares(docs, monkeypatch):
    monkeypatch.setattr(neardup, "HOT_ROWS", 2)
    monkeypatch.setattr(neardup, "SIDE", 3)
    monkeypatch.setattr(neardup, "STAR_PAIRS", 2)
    test_near_duplicates(docs, 2)


def test_near_duplicates_in_a_chain_of_buckets(spark):
    """Documents that drift a word at a time: links between neighbours only, so stars alone don't find them."""
    base = [f"w{k}" for k in range(40)]
    rows = []
    for k in range(30):
        base[k] = f"new{k}"
        rows.append((k, " ".join(base), None, None, None))
    random.Random(3).shuffle(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(spark.createDataFrame(rows, KIND), size=2).collect()}
    assert got == brute_components(rows, 2)


def test_awkward_near_duplicates(awkward):
    rows = collections.defaultdict(set)
    for r in neardup.near_duplicates(awkward, size=2).collect():
        rows[r.doc_id].add((r.n_shingles, r.component_id, r.kept))
    want = {k: {v} for k, v in brute_components(AWKWARD, 2).items()} | {None: {(3, None, True)}}
    assert rows == want and rows[9] == {(5, 8, False)} and rows[5] == {(0, 5, True)}


def test_mix_meets_its_targets(docs):
    rows = mixing.mix(docs, carry=["doc_id", "source"]).collect()
    size, taken, target = collections.Counter(), collections.Counter(), {}
    for r in rows:
        size[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert {r.doc_id: r.size for r in rows} == {i: len(words(t)) for i, t, *_ in corpus()}
    weights = dict(zip(sorted(size), [5, 2, 1] * 3))
    want, fixed = {}, set()
    while True:
        rest = sum(size.values()) - sum(3 * size[s] for s in fixed)
        free = [s for s in size if s not in fixed]
        want = {s: 3.0 * size[s] if s in fixed else rest * weights[s] / sum(weights[x] for x in free) for s in size}
        over = {s for s in free if want[s] > 3 * size[s]}
        if not over:
            break
        fixed |= over
    assert all(math.isclose(target[s], want[s]) for s in size)
    assert all(abs(taken[s] - want[s]) <= 1 for s in size)
    for r in rows:
        assert r.taken == r.copies * r.size + r.part <= 3 * r.size
        assert r.copies >= r.target // r.source_size if r.source_size else r.copies == 0
    assert sum(r.part > 0 for r in rows) <= len(size)
    again = mixing.mix(docs.repartition(7), carry=["doc_id"]).collect()
    assert {r.doc_id: r.taken for r in again} == {r.doc_id: r.taken for r in rows}
    # The order of the keys, from the definition: whole epochs, then documents by -ln(u) / w until the rest is used up.
    facts = docs.select("doc_id", "source", "text", F.xxhash64("doc_id", "text", F.lit(17)).alias("h")).collect()
    for s in size:
        epochs, own = int(target[s] // size[s]), []
        for r in (r for r in facts if r.source == s):
            u, text = ((r.h % (1 << 64) >> 11) + 0.5) / float(1 << 53), r.text or ""
            weight = max(0.1, sum(c.isalpha() or c in " \t\n\r\f\v" for c in text) / len(text)) if text else 1.0
            own.append((-math.log(u) / weight, r.doc_id, len(words(text))))
        left, chosen = target[s] - epochs * size[s], {}
        for _, i, n in sorted(own):
            chosen[i] = epochs * n + min(n, max(0, round(left)))
            left -= n
        assert all(abs(chosen[r.doc_id] - r.taken) <= 1 for r in rows if r.source == s)
    out = collections.Counter()
    for r in mixing.emit(mixing.mix(docs)).collect():
        out[r.source] += len(words(r.text))
    assert out == taken


def test_packing_round_trip(docs, awkward):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    for df, rows in ((docs, corpus()), (awkward, AWKWARD)):
        got = packing.pack(df, tokenizer_path(), length=128, with_ids=True).collect()
        texts = collections.defaultdict(list)
        for r in got:
            texts[r.doc_id].append(r)
        for i, t, *_ in rows:
            ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
            n = len(ids)
            head = (n % 128 or 128) if n > 128 else n
            want = [(0, 0, head), *((k + 1, a, 128) for k, a in enumerate(range(head, n, 128)))]
            own = sorted(texts[i], key=lambda r: r.piece)
            assert sorted({(r.piece, r.start, r.length) for r in own}) == want
            for r in own:
                assert list(r.ids) == ids[r.start : r.start + r.length]
                assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        bins = collections.defaultdict(list)
        for r in got:
            bins[r.sequence_id].append((r.offset, r.length))
        for own in bins.values():
            end = 0
            for offset, size in sorted(own):
                assert offset == end
                end += size
            assert end <= 128
        assert len(bins) <= 1.05 * sum(r.length for r in got) / 128 + 1


def test_packing_over_a_tree_of_groups(docs, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_PIECES", 6)
    monkeypatch.setattr(packing, "FAN", 2)
    got = packing.pack(docs, tokenizer_path(), length=256).collect()
    bins = collections.defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for own in bins.values():
        assert [o for o, _ in sorted(own)] == list(np.cumsum([0, *(n for _, n in sorted(own))])[:-1])
    assert len(bins) <= 1.15 * sum(r.length for r in got) / 256 + 1


def test_hosts_that_stay_behind_change_no_packing(spark, monkeypatch):
    """Many items over half a sequence, few small ones: as many sequences as when all underfull bins climb."""
    rng = random.Random(8)
    rows = [(k, " ".join(rng.choice("abcdefgh") for _ in range(rng.choice([33, 34, 35, 36, 40, 45, 5, 9, 14])))) for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).cache()
    monkeypatch.setattr(packing, "GROUP_PIECES", 12)
    monkeypatch.setattr(packing, "FAN", 2)
    count = lambda: packing.pack(df, tokenizer_path(), length=64).select("sequence_id").distinct().count()
    bound = count()
    monkeypatch.setattr(packing, "hosts", lambda rounds: 10**9)
    assert bound == count()


def test_best_fit_by_hand():
    rng = random.Random(3)
    for _ in range(30):
        length = rng.choice([10, 64])
        sizes = [rng.randint(1, length) for _ in range(rng.choice([0, 1, 7, 60]))]
        fills, where = [], {}
        for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
            fits = [b for b in range(len(fills)) if fills[b] + sizes[k] <= length]
            fullest = max((fills[b] for b in fits), default=None)
            if fullest is None:
                fills.append(0)
                fullest = 0
            where[k] = fullest
            fills[next(b for b in (fits or [len(fills) - 1]) if fills[b] == fullest)] += sizes[k]
        bin_of, offset, got = packing.best_fit(sizes, length)
        assert sorted(got) == sorted(fills)
        assert offset.tolist() == [where[k] for k in range(len(sizes))]


@pytest.mark.parametrize("small", [False, True])
def test_language_model(docs, monkeypatch, small):
    if small:
        monkeypatch.setattr(lm, "BLOCK_CHARS", 700)
        monkeypatch.setattr(substring, "MESSAGE_ITEMS", 0)
        monkeypatch.setattr(lm, "OWNER_ITEMS", 8)
    got = {r.doc_id: r for r in lm.scores(docs, remainder(F.col("doc_id"), 5) != 1).collect()}
    texts = {i: [*words((t or "").translate(LOWER)), "\0"] for i, t, *_ in corpus()}
    # The automaton by hand: states are contexts with their counts, arcs are counted by state.
    count, state, arc, root = collections.Counter(), collections.Counter(), collections.Counter(), ()
    for i, w in texts.items():
        if zlib.crc32(str(i).encode()) % 5 != 1:
            count.update(w)
            for k, x in enumerate(w):
                for size in range(1, min(k + 1, lm.ORDER - 1) + 1):
                    context = tuple([None, *w][k + 1 - size : k + 1])
                    state[context] += 1
                    arc[context, x] += 1
    n, v = sum(count.values()), len(count)

    def smooth(context, x):
        if not context:
            return (count[x] + 0.5) / (n + 0.5 * (v + 1))
        m = lm.PRIOR[len(context) - 1]
        return (arc[context, x] + m * smooth(context[1:], x)) / (state[context] + m)

    for i, w in texts.items():
        at, score = (None,) if state[(None,)] else root, 0.0
        for x in w:
            while at and not arc[at, x]:
                m = lm.PRIOR[len(at) - 1]
                score, at = score + math.log10(m / (state[at] + m)), at[1:]
            score += math.log10(smooth(at, x))
            at = (*at, x)[-(lm.ORDER - 1) :]
            while at and not state[at]:
                at = at[1:]
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(count[x] > 0 for x in w), n)
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 1)
        assert math.isclose(r.base_score, sum(math.log10(smooth((), x)) for x in w), rel_tol=1e-9)
        assert math.isclose(r.score, score, rel_tol=1e-9)


def test_continuations_that_were_seen_score_higher(spark):
    train = spark.createDataFrame([(1, "a b a c a b"), (2, "b a b"), (3, None)], "doc_id long, text string")
    ask = spark.createDataFrame([(10 + k, t) for k, t in enumerate(["a b", "a b a", "a b b", "a b c", "a b unseen"])], "doc_id long, text string")
    got = {r.doc_id: r.score for r in lm.scores(train.unionByName(ask), F.col("doc_id") < 10).collect()}
    assert all(x < 0 for x in got.values())
    assert got[10] > got[14] and got[11] > got[12] > got[14] and got[11] > got[13]


def test_fingerprints(docs, awkward):
    got = {r.doc_id: r for r in fingerprints.fingerprints(docs).collect()}
    rows = sorted(corpus())
    by_text = collections.defaultdict(set)
    for (i, t, *_), (_, after, *_) in zip(rows, rows[1:] + rows[:1]):
        m = len(t) // 4
        edited = t[: len(t) - m] + after[:m]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        by_text[t].add(got[i].fingerprint)
        if t == after:
            assert got[i].near_next == 1
    assert all(len(x) == 1 for x in by_text.values())
    rows = {r.doc_id: r for r in fingerprints.fingerprints(awkward).collect()}
    assert (rows[4].n_chars, rows[4].fingerprint, rows[4].near_edited) == (0, "", 1.0)
    assert rows[9].fingerprint and rows[12].n_chars == 16


def hashed(spark, texts):
    """All shingle hashes of each text, a shingle a row: runs of five words, shorter ones at the ends."""
    rows = []
    for k, t in enumerate(texts):
        w = words(t)
        rows += [(k, *[w[j] if 0 <= j < len(w) else None for j in range(i, i + 5)]) for i in range(-4, len(w))] if w else []
    df = spark.createDataFrame(rows, "k int, a string, b string, c string, d string, e string")
    one = [F.when(F.col(x).isNotNull(), F.xxhash64(x)) for x in "abcde"]
    out = collections.defaultdict(set)
    for r in df.select("k", F.xxhash64(*one).alias("h")).collect():
        out[r.k].add(r.h)
    return [out[k] for k in range(len(texts))]


def test_fingerprints_and_likenesses_by_hand(spark, docs):
    rows = sorted((i, t or "") for i, t, *_ in corpus())
    edited = [t[: len(t) - len(t) // 4] + after[: len(t) // 4] for (_, t), (_, after) in zip(rows, rows[1:] + rows[:1])]
    full = hashed(spark, [t for _, t in rows] + edited)
    low = lambda h: {x for x in h if x < 2**62 - 2**63}
    keep = lambda h: (64, h) if len(h) <= 64 else (16, low(h))

    def alike(a, b):
        if a == b:
            return 1.0
        x, y = (a[1], b[1]) if a[0] == b[0] else (low(a[1]), low(b[1]))
        return len(x & y) / len(x | y) if x | y else 0.0

    own, other = [keep(h) for h in full[: len(rows)]], [keep(h) for h in full[len(rows) :]]
    got = {r.doc_id: r for r in fingerprints.fingerprints(docs).collect()}
    said = lambda s: f"{s[0]}:" + " ".join(f"{x % (1 << 64):x}" for x in sorted(s[1])) if s[1] else ""
    for k, (i, _) in enumerate(rows):
        assert (got[i].fingerprint, got[i].edited_fingerprint) == (said(own[k]), said(other[k]))
        assert math.isclose(got[i].near_edited, alike(own[k], other[k])) and math.isclose(got[i].near_next, alike(own[k], own[(k + 1) % len(rows)]))


def test_short_texts_have_sketches_of_their_own(spark):
    rng = random.Random(2)
    texts = {" ".join(f"w{rng.randrange(10**6)}" for _ in range(4)) for _ in range(200)}
    rows = fingerprints.fingerprints(spark.createDataFrame(list(enumerate(sorted(texts))), "doc_id long, text string")).collect()
    assert len({r.fingerprint for r in rows}) == len(texts) and all(r.fingerprint for r in rows)
    assert all(0 < r.near_edited < 1 for r in rows) and all(r.near_next == 0 for r in rows)


def test_repeated_and_crowded_ids_have_one_successor_each(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "RANGE_ROWS", 7)
    rows = [(5, "same row here") for _ in range(40)] + [(None, f"text {k}") for k in range(20)] + [(10**15 + k, f"crowded {k}") for k in range(30)] + [(1, "first"), (2 * 10**15, "last")]
    got = fingerprints.fingerprints(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert len(got) == len(rows)
    edit = lambda t, n: hashlib.sha256((t[: len(t) - len(t) // 4] + n[: len(t) // 4]).encode()).hexdigest()
    five = collections.Counter(r.edited_sha256 for r in got if r.doc_id == 5)
    assert five == {edit("same row here", "same row here"): 39, edit("same row here", "crowded 0"): 1}
    found = {r.doc_id: r.edited_sha256 for r in got}
    assert found[1] == edit("first", "same row here") and all(found[10**15 + k] == edit(f"crowded {k}", f"crowded {k + 1}") for k in range(29))
    assert found[10**15 + 29] == edit("crowded 29", "last")


def test_sketches_estimate_and_merge(spark):
    rng = random.Random(5)
    a = [f"w{rng.randrange(10**6)}" for _ in range(4000)]
    big, part, short = " ".join(a), " ".join(a[:1000]), " ".join(a[2000:2050])
    s = spark.createDataFrame([(big, part, short)], "a string, b string, c string").select(*(fingerprints.sketch(F.col(x)).alias(x) for x in "abc"))
    a, b, c = (F.col(x) for x in "abc")
    r = s.select(fingerprints.containment(b, a).alias("inside"), fingerprints.likeness(a, b).alias("alike"), fingerprints.containment(a, fingerprints.merged(a, b)).alias("whole"), fingerprints.containment(c, a).alias("short"), fingerprints.merged(b, c)["part"].alias("part")).first()
    assert r.inside > 0.98 and abs(r.alike - 0.25) < 0.04 and r.whole == 1.0 and r.short > 0.6 and r.part == 16


def test_licences(spark):
    mit = next(t for n, t in licences.KNOWN if n == "MIT" and len(t) > 100)
    rows = [
        (1, f"Copyright (c) 2020 Somebody\n\n{mit.upper()}"),
        (2, mit.replace("\n\n", "\n").replace('"', "'")),
        (3, mit + " And more."),
        (4, "Some words.\nlicenced under the APACHE licence,   version 2.0\nMore."),
        (5, "Released under the MIT License."),
        (6, "© 2020\nAll rights reserved."),
        (7, None),
    ]
    got = {r.doc_id: (r.license_id, r.notices) for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ("MIT", "MIT"), 2: ("MIT", "MIT"), 3: (None, ""), 4: (None, "Apache-2.0"), 5: ("MIT", "MIT"), 6: (None, ""), 7: (None, "")}


@pytest.mark.skipif(not os.path.isdir("/usr/share/common-licenses"), reason="no licence texts here")
def test_full_texts_of_long_licences(spark):
    names = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    texts = dict(licences.read_known("/usr/share/common-licenses"))
    rows = []
    for k, (file, name) in enumerate(names.items()):
        rows += [(k, name, texts[file]), (100 + k, name, "Copyright 2020 Somebody\n\n" + " ".join(texts[file].replace("\n\n", "\n").split(" ")).upper()), (200 + k, None, texts[file] + " more")]
    got = {r.doc_id: r.license_id for r in licences.scan(spark.createDataFrame([(k, t) for k, _, t in rows], "doc_id long, text string")).collect()}
    assert got == {k: name for k, name, _ in rows}


def test_quality_is_learnt(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for k in range(600):
        good = rng.random() < 0.6
        w = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(rng.randrange(20, 150))]
        text = " ".join(w) + "." if good else rng.choice([" | ".join(w), " ".join(x + "###" for x in w), " ".join([w[0]] * 60), " ".join(w).upper() + "!!"])
        rows.append((k, text))
        labels.append((k, int(good), 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    held = {k for k, *_ in labels if zlib.crc32(str(k).encode()) % 4 == 2}
    scored = {r.doc_id: r.score for r in quality.score(docs, spark.createDataFrame(labels, LABELS), train_on=lambda c: remainder(c, 4) != 2).collect()}
    assert len(scored) == 600 and all(0 <= s <= 1 for s in scored.values())
    right = [(scored[k] >= 0.7) == bool(q) for k, q, _ in labels if k in held]
    assert sum(right) / len(right) > 0.97
    # Labels of held-out rows change nothing.
    flipped = [(k, 1 - q if k in held else q, 0) for k, q, _ in labels]
    again = {r.doc_id: r.score for r in quality.score(docs, spark.createDataFrame(flipped, LABELS), train_on=lambda c: remainder(c, 4) != 2).collect()}
    assert all(abs(again[k] - s) < 1e-9 for k, s in scored.items())


def test_summed_equations_give_the_ridge_solution(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, len(quality.NAMES)))
    y = (x[:, 0] + 0.3 * rng.normal(size=300) > 0).astype(float)
    fold = np.arange(300) % quality.FOLDS
    rows = [(k, a.tolist(), float(b), int(c)) for k, (a, b, c) in enumerate(zip(x, y, fold))]
    train = spark.createDataFrame(rows, "_id long, _x array<double>, _y double, _fold int").repartition(5)
    model = quality.fit(train)
    assert np.allclose(model.mean, x.mean(0)) and np.allclose(model.dev, x.std(0))
    z = model.lift(x)
    penalty = quality.RIDGE * np.sqrt(len(x)) / 10 * np.eye(z.shape[1])
    assert np.allclose(model.weights, np.linalg.solve(z.T @ z + penalty, z.T @ y), atol=1e-8)
    raw = np.zeros(len(x))
    for k in range(quality.FOLDS):
        own = z[fold != k]
        raw[fold == k] = z[fold == k] @ np.linalg.solve(own.T @ own + penalty, own.T @ y[fold != k])
    assert np.allclose(model.steps[1], quality.isotonic(raw, y)[1])
    # Cosines of random projections stand for a Gaussian kernel of the standardised statistics.
    wide = quality.Model(model.mean, model.dev, features=20_000)
    some = x[:20]
    cosines = wide.lift(some)[:, :20_000]
    apart = (((some[:, None] - some[None]) / model.dev) ** 2).sum(-1)
    assert np.abs(cosines @ cosines.T - np.exp(-apart / (4 * x.shape[1]))).max() < 0.05


def test_isotonic_fit_by_hand():
    rng = np.random.default_rng(2)
    for n in (1, 5, 40):
        x, y = rng.permutation(n).astype(float), rng.integers(0, 2, n).astype(float)
        knots, values = quality.isotonic(x, y)
        own = y[np.argsort(x)]
        best = [max(min(own[j : k + 1].mean() for k in range(i, n)) for j in range(i + 1)) for i in range(n)]
        # Pools of equal value, smoothed towards the base rate by one row.
        pools = []
        for v in best:
            if pools and abs(pools[-1][0] - v) < 1e-12:
                pools[-1][1] += 1
            else:
                pools.append([v, 1])
        assert np.allclose(values, [(v * k + y.mean()) / (k + 1) for v, k in pools])


def test_isotonic_fit_never_falls():
    rng = np.random.default_rng(1)
    x = rng.normal(size=300)
    knots, values = quality.isotonic(x, (rng.random(300) < 1 / (1 + np.exp(-3 * x))).astype(float))
    assert (np.diff(knots) > 0).all() and values[0] < 0.3 and values[-1] > 0.7


def test_licences_with_their_title_and_the_third_clause(spark):
    texts = {k: t for k, t in licences.KNOWN if t.startswith(("Permission", "Redistribution", "This software"))}
    third = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\n"
    bsd3 = texts["BSD-2-Clause"].replace("THIS SOFTWARE", third + "THIS SOFTWARE", 1)
    rows = [(1, "MIT License\n\nCopyright (c) 2020 Ann\n\n" + texts["MIT"], "MIT"), (2, "BSD 3-Clause License\n\nCopyright (c) 2020, Ann\nAll rights reserved.\n\n" + bsd3, "BSD-3-Clause"), (3, bsd3, "BSD-3-Clause"), (4, "zlib License\n\n" + texts["Zlib"], "Zlib"), (5, "MIT License\n\nMore words\n\n" + texts["MIT"], None)]
    got = licences.scan(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")).collect()
    assert {r.doc_id: r.license_id for r in got} == {r[0]: r[2] for r in rows}


def thue_morse(length=2048):
    """A string over a and b and its complement: they collide under every polynomial hash modulo a power of two."""
    first = "".join("ab"[bin(k).count("1") % 2] for k in range(length))
    return first, first.translate(str.maketrans("ab", "ba"))


def test_words_that_polynomials_confuse_are_told_apart(spark):
    a, b = thue_morse()
    rest = " ".join(f"w{k}" for k in range(19))
    rows = [(1, f"{a} {rest}"), (2, f"{b} {rest}"), (3, a), (4, b), (5, " ".join(a)), (6, " ".join(b)), (7, b.upper())]
    df = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in rows], KIND)
    assert {r.doc_id: r.n_removed for r in substring.remove_repeats(df).collect() if r.doc_id < 3} == {1: 0, 2: 0}
    near = {r.doc_id: r.component_id for r in neardup.near_duplicates(df.filter("doc_id in (3, 4, 5, 6, 7)"), size=3000).collect()}
    assert near == {3: 3, 4: 4, 5: 5, 6: 6, 7: 4}
    scored = {r.doc_id: r for r in lm.scores(df, F.col("doc_id") == 3).collect()}
    assert (scored[3].n_known, scored[4].n_known, scored[7].n_known) == (2, 1, 1)


def test_hashes_follow_words_alone():
    rng = random.Random(4)
    pick = ["a", "bb", "x" * 8, "x" * 9, "y" * 70, "y" * 71, "É", "z" * 16, "z" * 17]
    own = textops.Words([rng.choice(["", " ", "\n"]) + "\t".join(rng.choice(pick) for _ in range(rng.choice([0, 1, 3, 40]))) for _ in range(60)] + [None, "", "bb a", " bb\n\na "])
    spelt = [own.bytes[a:b].tobytes() for a, b in zip(own.starts, own.ends)]
    for which in (0, 1):
        h = own.hashes(which)
        for n in (1, 2, 3, 7, 20):
            seen = {}
            for k, g in enumerate(textops.ngrams(h, n, which).tolist()):
                assert seen.setdefault(tuple(spelt[k : k + n]), g) == g
            assert len(set(seen.values())) == len(seen)
    whole = own.digests()
    seen = {}
    for k in range(len(own.count)):
        assert seen.setdefault(tuple(spelt[own.first[k] : own.first[k + 1]]), tuple(whole[k])) == tuple(whole[k])
    assert len(set(seen.values())) == len(seen)
