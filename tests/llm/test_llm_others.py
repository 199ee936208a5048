"""Neighbours, pages and the pipeline."""

import html
import os
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tintmill.llm import ann, pages

SF = "/root/testdata/sf0.001"


def frame(spark, vectors):
    return spark.createDataFrame([(k, [float(x) for x in v]) for k, v in vectors], "vec_id long, embedding array<float>")


@pytest.mark.parametrize("scale", [False, True])
def test_recall_of_neighbours(spark, scale):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 32)).astype(np.float32)
    if scale:
        x *= rng.uniform(0.5, 2, size=(3000, 1)).astype(np.float32)
    got = ann.search(frame(spark, enumerate(x.tolist())), F.col("vec_id") % 20 == 0).toPandas()
    hit, y = 0, x.astype(float)
    for q, own in got.groupby("query_id"):
        s = (y * y[q]).sum(1)
        s[q] = -np.inf
        best = np.lexsort((np.arange(3000), -s))[:20]
        hit += len(set(best) & set(own["vec_id"]))
        own = own.sort_values("rank")
        assert own["rank"].tolist() == list(range(1, 21))
        assert np.allclose(own["score"], s[own["vec_id"]], rtol=0, atol=1e-12)
        assert list(zip(-own["score"], own["vec_id"])) == sorted(zip(-own["score"], own["vec_id"]))
    assert hit / (20 * 150) >= 0.9


def found_of_best(spark, x, k=20):
    """Share of the true nearest that the search finds, for every twentieth of the vectors."""
    got = ann.search(frame(spark, enumerate(x.tolist())), F.col("vec_id") % 20 == 0, k).toPandas()
    x = x.astype(np.float32).astype(float)
    hit, asked = 0, range(0, len(x), 20)
    for q in asked:
        s = (x * x[q]).sum(1)
        s[q] = -np.inf
        hit += len(set(np.lexsort((np.arange(len(x)), -s))[:k]) & set(got["vec_id"][got["query_id"] == q]))
    return hit / (k * len(asked))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_recall_on_the_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").orderBy("vec_id").collect()
    assert [r.vec_id for r in rows] == list(range(len(rows)))
    assert found_of_best(spark, np.array([r.embedding for r in rows])) >= 0.95


@pytest.mark.parametrize("size", [(1500, 64), (2000, 128)])
def test_recall_without_clear_neighbours(spark, size):
    x = np.random.default_rng(11).normal(size=size)
    assert found_of_best(spark, x / np.linalg.norm(x, axis=1, keepdims=True)) >= 0.95


@pytest.mark.parametrize("norms", ["one", "spread"])
def test_recall_with_unequal_norms(spark, norms):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(2000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if norms == "one":
        x[77] *= 10
    else:
        x *= rng.lognormal(0, 0.3, size=(2000, 1))
    assert found_of_best(spark, x) >= 0.95


def test_a_long_vector_costs_no_verification(monkeypatch):
    rows, candidates = [], ann.Index.candidates
    monkeypatch.setattr(ann.Index, "candidates", lambda *a: (found := candidates(*a), rows.append(len(found)))[0])
    x = np.random.default_rng(11).normal(size=(8192, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    verified = []
    for factor in (1, 10):
        x[77] *= factor
        rows.clear()
        index = ann.Bands(np.arange(8192), x, 20)
        for q in range(0, 8192, 400):
            index.nearest(q, x[q], 20)
        verified.append(sum(rows))
    # Besides the band of the long vector, which is verified whole.
    assert verified[1] <= 1.05 * verified[0] + 21 * 320


def test_blocks_and_parts_meet(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 100)
    monkeypatch.setattr(ann, "QUERIES", 7)
    monkeypatch.setattr(ann, "VERIFY", 1.0)
    x = np.random.default_rng(3).normal(size=(700, 8)).astype(np.float32).astype(float)
    got = ann.search(frame(spark, enumerate(x.tolist())), F.col("vec_id") % 20 == 0, k=5).toPandas()
    for q, own in got.groupby("query_id"):
        s = (x * x[q]).sum(1)
        s[q] = -np.inf
        assert own.sort_values("rank")["vec_id"].tolist() == np.argsort(-s)[:5].tolist()


def test_vectors_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [None, 1.0]), (6, [inf, 1.0]), (None, [1.0, 1.0]), (7, [1.0]), (8, [0.5, 0.5]), (20, [0.5, 0.5]), (20, [0.5, 0.5]), (40, []), (60, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("_id", F.lit(1)).withColumn("rank", F.lit(2))
    got = ann.search(df, F.col("vec_id") % 20 == 0, k=20).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in got] == [(0, 1, 1, 0.5), (0, 2, 8, 0.5), (0, 3, 20, 0.5), (20, 1, 0, 0.5), (20, 2, 1, 0.5), (20, 3, 8, 0.5)]
    assert ann.search(df.filter("vec_id < 0"), F.col("vec_id") == 0).collect() == []


@pytest.fixture(scope="module")
def trees():
    return pages.trained()


def test_pages_of_layouts_not_seen(trees):
    rng = np.random.default_rng(1234)
    own = [pages.Page(pages.make_page(rng)) for _ in range(150)]
    got = pages.main_text(own, trees)
    want = ["\n".join(t for node, t, *_ in p.runs if p.truth[node]) for p in own]
    assert sum(a == b for a, b in zip(got, want)) >= 145


def test_decoding_has_no_contradictions():
    rng = np.random.default_rng(0)
    for _ in range(50):
        n = 9
        parent = [-1, *(int(rng.integers(0, k)) for k in range(1, n))]
        odds = rng.normal(size=n) * 2
        got = pages.decode(parent, odds)
        best = None
        for bits in range(1 << (n - 1)):
            keep = [True, *(bool(bits >> k & 1) for k in range(n - 1))]
            if all(keep[parent[k]] or not keep[k] for k in range(1, n)):
                value = sum(-np.logaddexp(0, -odds[k] if keep[k] else odds[k]) for k in range(1, n))
                if best is None or value > best[0]:
                    best = (value, keep)
        assert got.tolist() == best[1]


def test_markup_is_read_leniently(spark, trees):
    body = "Words of a main text, which go on for some time, as they do. " * 4
    rows = [
        (1, f"<html><body><nav><ul><li><a href=/>home</a></li></ul></nav><article><h1>Title &amp; more</h1><p>{body}<b>bold&nbsp;x<p>{body}<br>last</article><footer>&copy; us</footer>"),
        (2, None),
        (3, ""),
        (4, "<<<>>> <p <div class='x"),
        (5, f"<article><p>{body}</p><script>var t='</p>'</script><!-- <p>no</p> --><style>p{{}}</style></article>"),
        (5, f"<article><p>{body}</p><script>var t='</p>'</script><!-- <p>no</p> --><style>p{{}}</style></article>"),
    ]
    df = spark.createDataFrame(rows, "page_id long, html string").withColumn("text", F.lit("old")).withColumn("_row", F.lit(1)).withColumn("_html", F.lit(2))
    got = pages.extract(df, trees=trees).collect()
    clean = " ".join(body.split())
    texts = {r.page_id: r.text for r in got}
    assert len(got) == 6 and texts[1] == f"Title & more\n{clean} bold x\n{clean} last" and texts[2] == texts[3] == "" and texts[5] == clean
    assert all(r.n_chars == len(r.text) and r._row == 1 for r in got)
    assert pages.extract(df.limit(0), trees=trees).collect() == []


def test_unclosed_elements_do_not_swallow_the_page(spark, trees):
    body = " ".join("Words of a main text, which go on for some time, as they do.".split() * 4)
    names = ["button", "svg", "select", "option", "datalist", "object", "math", "canvas", "audio", "video", "template", "iframe", "noscript"]
    page = "<html><body><nav><a href=/>home</a><{0}></nav><article><p>{1}</p><p>{1}</p></article>{2}</body></html>"
    rows = [(k, page.format(x, body, "")) for k, x in enumerate(names)]
    # A later element of the same name, closed, isn't the end of it.
    rows += [(100 + k, page.format(x, body, f"<footer><{x}>go</{x}></footer>")) for k, x in enumerate(names) if x not in ("object", "math")]
    rows += [(200, page.format('svg><path d="M0 0"/', body, "")), (201, page.format("b", body, "<script>var x = '<p>no</p>'"))]
    got = {r.page_id: r.text for r in pages.extract(spark.createDataFrame(rows, "page_id long, html string"), trees=trees).collect()}
    assert got == {k: f"{body}\n{body}" for k, _ in rows}


def test_text_in_formulas_and_left_out_elements(trees):
    body = " ".join("Words of a main text, which go on for some time, as they do.".split() * 4)
    formula = "<math><mi>a</mi><mo>=</mo><mn>2</mn><annotation>a=2</annotation></math>"
    texts = pages.main_text([pages.Page(f"<article><p>{body} {formula} {body}</p><p>{body} <object data=x>drawn</object></p><button>a<script>'<button>'</script>b</button><svg><svg><text>x</text></svg><text>y</text></svg></article>")], trees)
    assert texts == [f"{body} a=2 {body}\n{body} drawn"]


def test_many_unclosed_elements_are_read_once():
    assert pages.Page("<button>x " * 50_000).runs == [(0, " ".join("x" * 50_000), 0, 0)]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_articles_of_the_table(spark, trees):
    borders = re.compile(r"</?(?:p|h1|h2|h3|ul|li|article)\b[^>]*>")
    for r in pages.extract(spark.read.parquet(f"{SF}/pages.parquet").withColumn("source_html", F.col("html")), trees=trees).collect():
        own = re.search(r"<article>(.*?)(?:</article>|\Z)", r.source_html, re.S)[1]
        blocks = (" ".join(html.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", x))).split()) for x in borders.split(own))
        assert r.text == "\n".join(x for x in blocks if x)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, labels = docs.columns, {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = []
    for k, (name, stage) in enumerate(c.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        before, docs = docs, spark.read.parquet(str(tmp_path / str(k)))
        if k < len(c.STAGES) - 1:
            assert docs.columns == columns, name
        kept.append(docs)
        ids = {r.doc_id for r in docs.select("doc_id").collect()}
        assert ids <= {r.doc_id for r in before.select("doc_id").collect()}
        if k == 0:
            held = [i for i in labels if labels[i].quality == 1]
            assert sum(i in ids for i in held) >= 0.97 * len(held)
        if k == 1:
            from tintmill.llm.neardup import _set

            sets = [_set(r.text or "", 5) for r in docs.collect()]
            assert all(100 * len(a & b) < 80 * len(a | b) for x, a in enumerate(sets) for b in sets[:x] if a and b)
        if k == 2:
            seen, twice = set(), 0
            for r in sorted(docs.collect()):
                w = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
                own = {tuple(w[j : j + 20]) for j in range(len(w) - 19)}
                twice += len(own & seen)
                seen |= own
            assert twice == 0 or twice < 0.001 * len(seen)
    assert {"doc_id", "piece", "sequence_id", "offset", "length"} <= set(docs.columns)
    from tokenizers import Tokenizer

    from tintmill.llm.queries import tokenizer_path

    tokenizer, ids = Tokenizer.from_file(tokenizer_path()), {}
    for r in sorted(docs.collect(), key=lambda r: (r.row_id, r.piece)):
        assert len(r.ids) == r.length
        ids[r.row_id] = ids.get(r.row_id, []) + list(r.ids)
    want = sorted(tokenizer.encode(r.text or "", add_special_tokens=False).ids + [2] for r in before.collect())
    assert sorted(ids.values()) == want
    assert sum(r.n for r in docs.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 1024").collect()) == 0


def test_the_pipeline_takes_awkward_documents(spark, tmp_path):
    import corpus_pipeline as c

    kind = "doc_id long, text string, lang string, source string, n_chars long"
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(8)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    rows = [(None, "null id words " * 9, None, None, None), (1, None, None, None, None), (2, "", "en", "a", 0), (3, "x y z", "en", "a", 5), (3, "x y z", "en", "a", 5), (4, "long text " * 3000, "en", "b", 0), (5, "some other words here", None, "b", 1)]
    for data in (rows, []):
        docs = spark.createDataFrame(data, kind)
        for _, stage in c.STAGES:
            docs = spark.createDataFrame(stage(spark, docs, str(tmp_path)).collect(), stage(spark, docs, str(tmp_path)).schema)
        assert set(docs.columns) >= {"doc_id", "piece", "sequence_id"}


def test_pipeline_stages_pass_further_columns(spark, tmp_path):
    import corpus_pipeline as c

    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(8)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    rows = [(k, f"some words of document {k} here", "en", "ab"[k % 2], 5) for k in range(8)] + [(None, None, None, None, None)]
    names = ["score", "size", "taken", "copies", "part", "target", "n_removed", "n_words", "_hash", "_text_hash", "rows", "kept", "_id", "_text", "comp"]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").select("*", *(F.concat(F.lit(f"{x} of "), F.coalesce("doc_id", F.lit(-1))).alias(x) for x in names))
    for name, stage in c.STAGES[:-1]:
        done = stage(spark, docs, str(tmp_path))
        assert done.columns == docs.columns, name
        for r in done.collect():
            for x in names:
                assert r[x] == f"{x} of {-1 if r.doc_id is None else r.doc_id}", (name, x)
    packed = c.packing_stage(spark, docs, str(tmp_path)).collect()
    assert {tuple(r.ids)[-1] for r in packed} == {2} and len({r.row_id for r in packed}) == len(rows)


def test_broken_markup_is_read_in_linear_time():
    n = 1_000_000
    cases = {
        "<a ": n // 3, "<aaaa": n // 5, '<a b="': n // 6, "<a b='": n // 6, '<a ="x\' c=\'"': n // 12, "<!-- ": n // 5, "<! ": n // 3, "<script>": n // 8, "<script></scrip": n // 15, "<button>x ": n // 10,
        "<div>": n // 5, "<h1>": n // 4, "<p>x": n // 4, "<b>x": n // 4, "</b>x": n // 5, "<": n, "<head>": n // 6,
    }
    for unit, times in cases.items():
        for tail in ("", ">", '">'):
            begun = time.time()
            pages.Page(unit * times + tail)
            assert time.time() - begun < 5, (unit, tail)


def test_pages_judged_some_nodes_at_a_time(trees, monkeypatch):
    rng = np.random.default_rng(12)
    own = [pages.Page(pages.make_page(rng)) for _ in range(30)] + [pages.Page(""), pages.Page("<div>x" * 300)]
    want = pages.main_text(own, trees)
    monkeypatch.setattr(pages, "NODES", 25)
    assert pages.main_text(own, trees) == want


def test_quotes_left_open_cost_no_text(trees):
    body = " ".join("Words of a main text, which go on for some time, as they do.".split() * 4)
    page = f"<body><article><p title=\"5\" tall\">{body}</p><p class='x>{body}</p></article></body>"
    assert [t for _, t, _, _ in pages.Page(page).runs] == [body, body]
    held = pages.Page(f"<article><p>{body}</p><noscript>shown without scripts</noscript><svg><text>drawn</text></svg><video>seen</video></article>")
    assert [t for _, t, _, _ in held.runs] == [body, "shown without scripts", "drawn", "seen"]
