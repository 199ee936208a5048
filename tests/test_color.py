import random

import pytest
from pyspark.sql import functions as F

from tintmill.functions import formats, polynomials
from tintmill.operators import color, picture, utxo
from tintmill.streaming import coloring

RECORDS = "seq long, block_id long, tx_id long, outputs long"
INPUTS = "seq long, tx_id long, pos int, prev_tx_id long, amount long"


def simulate(records, inputs):
    """One pass in arrival order: colors, weights and what is live at the end, or the first failure."""
    by = {}
    for s, _, p, prev, amount in inputs:
        by.setdefault(s, []).append((p, prev, amount))
    live, sets, weights = {}, {}, {}
    for seq, block, tx, outputs in records:
        own = sorted(by.get(seq, []))
        if not own:
            c, w = {block}, {block: 1.0}
        else:
            total, c, w = sum(a for *_, a in own), set(), {}
            for _, prev, amount in reversed(own):
                if prev not in live:
                    return sets, weights, live, (tx, prev)
                kept, left, shares = live[prev][1], live[prev][2], live[prev][3]
                share = amount / total if total else 1 / len(own)
                c |= kept
                for b, x in shares.items():
                    w[b] = w.get(b, 0.0) + share * x
                if left == 1:
                    del live[prev]
                else:
                    live[prev] = (live[prev][0], kept, left - 1, shares)
        sets[seq], weights[seq] = c, w
        if outputs:
            live[tx] = (seq, c, outputs, w)
    return sets, weights, live, None


def stream(rng, n, ids, valid):
    records, inputs, live = [], [], {}
    for seq in range(n):
        tx, outputs, spent = rng.randrange(ids), rng.randrange(4), []
        if rng.random() < 0.7:
            for pos in range(rng.randrange(3)):
                choice = [t for t, k in live.items() if k > 0]
                prev = rng.choice(choice) if valid and choice else None if valid else rng.randrange(ids)
                if prev is None:
                    continue
                if prev in live:
                    live[prev] -= 1
                spent.append((seq, tx, len(spent), prev, rng.choice([0, 0, 3, 7])))
        records.append((seq, seq // 3, tx, outputs))
        inputs += spent
        if outputs:
            live[tx] = outputs
    return records, inputs


def frames(spark, records, inputs):
    return spark.createDataFrame(records, RECORDS), spark.createDataFrame(inputs, INPUTS)


@pytest.mark.parametrize("seed", range(3))
def test_colors_and_weights_agree_with_one_pass(spark, seed):
    records, inputs = stream(random.Random(seed), 60, 25, True)
    sets, weights, live, failed = simulate(records, inputs)
    assert failed is None
    r, i = frames(spark, records, inputs)
    spends = utxo.checked(r, i)
    got = {}
    for x in color.closure(r, i, spends).collect():
        got.setdefault(x.seq, set()).add(x.block)
    assert got == sets
    mass = {}
    for x in color.weighted(r, i, spends).collect():
        mass.setdefault(x.seq, {})[x.block] = x.w
    assert {s: set(w) for s, w in mass.items()} == sets
    assert all(abs(mass[s][b] - v) < 1e-12 for s, w in weights.items() for b, v in w.items())
    assert {x.tx_id: (x.version_seq, x.unspent) for x in utxo.live(r, i).collect()} == {t: (v[0], v[2]) for t, v in live.items()}


@pytest.mark.parametrize("seed", range(6))
def test_the_first_failure_is_the_one_that_stops_a_pass(spark, seed):
    records, inputs = stream(random.Random(100 + seed), 14, 6, False)
    failed = simulate(records, inputs)[3]
    r, i = frames(spark, records, inputs)
    first = utxo.first_unknown(r, i).collect()
    assert [(x.tx_id, x.prev_tx_id) for x in first] == ([failed] if failed else [])
    if failed:
        with pytest.raises(Exception, match=f"transaction {failed[0]} spends unknown transaction|spends unknown"):
            utxo.checked(r, i).collect()


def test_a_long_chain_takes_few_rounds(spark):
    n = 300
    r = spark.range(n).selectExpr("id as seq", "id as block_id", "id as tx_id", "1L as outputs")
    i = spark.range(1, n).selectExpr("id as seq", "id as tx_id", "0 as pos", "id - 1 as prev_tx_id", "5L as amount")
    assert {x.block for x in color.closure(r, i, utxo.spends(r, i)).collect()} == {0}


def test_wide_blocks_fail_in_sets_and_pass_in_rings(spark):
    r, i = frames(spark, [(0, 1 << 40, 0, 1)], [])
    s = utxo.spends(r, i)
    assert color.closure(r, i, s, mode="rings").first().block == 1 << 40
    with pytest.raises(Exception, match="32 bits"):
        color.closure(r, i, s).collect()


def test_batches_of_a_stream_agree_with_the_whole(spark):
    records, inputs = stream(random.Random(7), 45, 20, True)
    sets, weights, live, _ = simulate(records, inputs)
    by = {}
    for s, _, p, prev, a in inputs:
        by.setdefault(s, []).append((p, prev, a))
    rows = [(*x, by.get(x[0], [])) for x in records]
    kind = "seq long, block_id long, tx_id long, outputs long, inputs array<struct<pos:int,prev_tx_id:long,amount:long>>"
    held, got = spark.createDataFrame([], coloring._LIVE), {}
    for a in range(0, 45, 15):
        colors, held = coloring.step(held, spark.createDataFrame(rows[a : a + 15], kind), weighted=True)
        for x in colors.collect():
            got.setdefault(x.seq, {})[x.block] = x.w
    assert {s: set(w) for s, w in got.items()} == sets
    assert all(abs(got[s][b] - v) < 1e-12 for s, w in weights.items() for b, v in w.items())
    assert {x.tx_id: x.unspent for x in held.collect()} == {t: v[2] for t, v in live.items()}


def test_a_stream_runs_from_files(spark, tmp_path):
    rows = [(0, 0, 5, 1, []), (1, 1, 6, 1, [(0, 5, 10)])]
    kind = "seq long, block_id long, tx_id long, outputs long, inputs array<struct<pos:int,prev_tx_id:long,amount:long>>"
    spark.createDataFrame(rows, kind).write.parquet(str(tmp_path / "in"))
    query = coloring.start(spark.readStream.schema(kind).parquet(str(tmp_path / "in")), str(tmp_path / "live"), str(tmp_path / "out"), checkpointLocation=str(tmp_path / "ck"))
    query.processAllAvailable()
    query.stop()
    assert sorted((x.seq, x.block) for x in spark.read.parquet(str(tmp_path / "out")).collect()) == [(0, 0), (1, 0)]


def test_a_stream_keeps_changes_of_the_ids_it_names(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(coloring, "BASE_ROWS", 6)
    records, inputs = stream(random.Random(11), 40, 16, True)
    sets, weights, live, _ = simulate(records, inputs)
    by = {}
    for s, _, p, prev, a in inputs:
        by.setdefault(s, []).append((p, prev, a))
    kind = "seq long, block_id long, tx_id long, outputs long, inputs array<struct<pos:int,prev_tx_id:long,amount:long>>"
    changes = coloring.Changes(spark, str(tmp_path / "live"))
    got, rows = {}, [(*x, by.get(x[0], [])) for x in records]
    for n in range(5):
        batch = spark.createDataFrame(rows[8 * n : 8 * n + 8], kind)
        # Twice, as after a failure: the second time changes nothing.
        for _ in range(2):
            ids = coloring.named(batch)
            colors, next_ = coloring.step(changes.live(n, ids), batch, weighted=True)
            found = colors.collect()
            changes.add(n, ids, next_)
        for x in found:
            got.setdefault(x.seq, {})[x.block] = x.w
        named = {r[2] for r in rows[8 * n : 8 * n + 8]} | {i[1] for r in rows[8 * n : 8 * n + 8] for i in r[4]}
        assert spark.read.parquet(str(tmp_path / "live" / f"change={n}")).count() == len(named)
    assert {s: set(w) for s, w in got.items()} == sets
    assert all(abs(got[s][b] - v) < 1e-12 for s, w in weights.items() for b, v in w.items())
    assert {x.tx_id: x.unspent for x in changes.live(5).collect()} == {t: v[2] for t, v in live.items()}
    assert changes.numbers("base") and changes.numbers("change") != list(range(5))


def test_polynomials(spark):
    p = F.map_from_arrays(F.array(F.lit(4), F.lit(1)), F.array(F.lit(2), F.lit(5)))
    q = F.map_from_arrays(F.array(F.lit(4), F.lit(9)), F.array(F.lit(-2), F.lit(3)))
    row = spark.range(1).select(polynomials.terms(polynomials.add(p, q)).alias("a"), polynomials.terms(polynomials.ior(p, q)).alias("o")).first()
    assert [tuple(x) for x in row.a] == [(9, 3), (4, 0), (1, 5)]
    assert [tuple(x) for x in row.o] == [(9, 3), (4, -2), (1, 5)]


def test_formats(spark):
    say = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert [say(formats.human(F.lit(n))) for n in (999, 1000, 125_000_000, 1150, 1250, 1350)] == ["999 B", "1.0 kB", "125.0 MB", "1.1 kB", "1.2 kB", "1.4 kB"]
    assert [say(formats.rate(F.lit(n), F.lit(s))) for n, s in ((5, 0.0), (5, 2.0), (2500, 1.0), (1_250_000, 1.0))] == ["-- rec/s", "2 rec/s", "2k rec/s", "1.2M rec/s"]
    assert [say(formats.weight(F.lit(w))) for w in (1.0, 0.0, 0.0000005, 0.1234565)] == ["1.000000", "0.000000", "0.000001", "0.123457"]


def test_text_lines_descend(spark):
    colors = spark.createDataFrame([(0, 2, 0.5), (0, 7, 0.5)], "seq long, block long, w double")
    assert picture.text_lines(colors).first().line == "(7 . 0.500000) (2 . 0.500000) "
    assert picture.text_lines(colors.drop("w")).first().line == "(7 . 1) (2 . 1) "


@pytest.mark.parametrize("way", ["fold", "too many terms", "doubling", "strides"])
@pytest.mark.parametrize("shape", ["dense", "deep", "random"])
def test_all_ways_of_the_recursion_agree(spark, monkeypatch, way, shape):
    """Dense: each record spends all of the layer before. Deep: a chain. Both, and random streams, by every strategy."""
    monkeypatch.setattr(color, "TASK_EDGES", 10_000 if way in ("fold", "too many terms") else 0)
    monkeypatch.setattr(color, "TASK_TERMS", 5 if way == "too many terms" else 10_000)
    monkeypatch.setattr(color, "DENSE", 0 if way == "strides" else 10**9)
    edges = {
        "dense": [(10 * k + i, 10 * (k - 1) + j) for k in range(1, 6) for i in range(6) for j in range(6)],
        "deep": [(k, k - 1) for k in range(1, 20)],
        "random": [(k, random.Random(k).randrange(k)) for k in range(1, 40) for _ in range(2)],
    }[shape]
    edges = sorted(set(edges))
    base = sorted({p for _, p in edges} - {c for c, _ in edges})
    counts = {s: {s + 100: 1} for s in base}
    for c, p in edges:
        own = counts.setdefault(c, {})
        for b, n in counts[p].items():
            own[b] = own.get(b, 0) + n
    b = spark.createDataFrame([(s, s + 100) for s in base], "seq long, block long")
    e = spark.createDataFrame(edges, "child long, parent long")
    assert {(r.seq, r.block) for r in color._reach(b, e).collect()} == {(s, x) for s in counts for x in counts[s]}
    found = color._reach(b.withColumn("w", F.lit(1).cast("long")), e.withColumn("w", F.lit(1).cast("long"))).collect()
    assert {(r.seq, r.block): r.w for r in found} == {(s, x): n for s in counts for x, n in counts[s].items()}
