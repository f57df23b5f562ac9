"""WARC, nearest neighbours, block labeller, mixing and the pipeline against
brute-force versions, and the odd rows each must stand."""

import base64
import hashlib
import html as entities
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from vulnxml.llm import ann, html_blocks, mixing, warc


# ---------------------------------------------------------------- WARC

def pages_of(spark, rows):
    return spark.createDataFrame(rows, "page_id bigint, url string, html string")


ODD_PAGES = [None, "", "\r\n", "\r\n\r\n", "a\r\n\r\nb", "tail\r\n", "tail\r\n\r\n", "\r\n\r\n\r\nx", "WARC/1.1\r\nContent-Length: 5\r\n\r\nfake", "é日\U0001f600", "same", "same", "x" * 300_000 + "\r\n\r\n\r"]


def test_round_trip(spark):
    rows = [(i, f"http://www.h{i % 3}.example/{i}?b=1\r\nX: y", h) for i, h in enumerate(ODD_PAGES)] + [(None, None, "same"), (None, None, "lonely"), (3, "u", "\r\n\r\n")]
    pages = pages_of(spark, rows).withColumn("record", F.lit(1)).withColumn("captured", F.lit("x")).repartition(3)
    got = warc.capture_index(pages).collect()
    best = {}
    for i, _, h in rows:
        h = h or ""
        best[h] = max((x for x in (best.get(h), i) if x is not None), default=None)
    want = Counter()
    for i, _, h in rows:
        b = (h or "").encode()
        kind = "response" if i == best[h or ""] else "revisit"
        want[i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), kind, None if kind == "response" else best[h or ""]] += 1
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got) == want
    assert warc.capture_index(pages_of(spark, [])).count() == 0


def test_index_is_globally_ordered(spark):
    rows = [(i, f"http://{random.Random(i).choice('abc')}.example/{i % 7}", f"p{i}") for i in range(500)]
    got = warc.capture_index(pages_of(spark, rows).repartition(5)).collect()
    by_place = sorted(got, key=lambda r: r["position"])
    keys = [(r["url_key"], r["captured"], r["page_id"]) for r in by_place]
    assert len(got) == 500 and keys == sorted(keys)
    assert len({k for k, _, _ in keys}) == 21


def test_index_of_repeated_rows_in_small_ranges(spark):
    """A hot URL with one hot payload, and rows repeated as a whole, spread over ranges."""
    rows = [(i, "http://hot.example/", "same") for i in range(300)] + [(None, "u", "x")] * 200 + [(7, "http://a.example/", "own")] * 100
    runs = warc.read_runs(spark, _archive(spark, rows)).cache()
    got = warc.merge_runs(runs, range_rows=60).withColumn("part", F.spark_partition_id()).collect()
    runs.unpersist()
    order = sorted(got, key=lambda r: r["position"])
    keys = [warc._order((r["url_key"], r["captured"], r["page_id"])) for r in order]
    assert len(got) == 600 and keys == sorted(keys)
    assert max(Counter(r["part"] for r in got).values()) <= 200
    kinds = Counter((r["payload_digest"], r["record_type"]) for r in got)
    assert sorted(kinds.values()) == [1, 100, 200, 299]


def _archive(spark, rows):
    path = warc.shared_path(spark, "warc")
    warc.write(pages_of(spark, rows).repartition(4), path, id_col="page_id", url_col="url", html_col="html")
    return path


def test_payloads_never_move_by_digest_alone(spark):
    plan = warc.records(pages_of(spark, [(1, "u", "x")]).repartition(2))._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan and "Inner" in plan


def test_payloads_survive_the_buffer_edge(spark, tmp_path):
    """Line ends around the reader's buffer size."""
    texts = [("y" * n) + "\r\n" * k for n in range(65_300, 65_600, 7) for k in (1, 2, 3)]
    path = str(tmp_path / "w")
    warc.write(pages_of(spark, [(i, "u", t) for i, t in enumerate(texts)]).coalesce(1), path, id_col="page_id", url_col="url", html_col="html")
    got = warc.read_runs(spark, path).collect()
    assert {r["page_id"]: r["payload_bytes"] for r in got} == {i: len(t) for i, t in enumerate(texts)}


def test_loser_tree():
    r = random.Random(3)
    for k in (0, 1, 2, 3, 7, 20):
        runs = [sorted([(r.choice("abc"), str(r.randint(0, 9)), r.choice([None, 1, 2]), 0, "", "", None) for _ in range(r.randint(0, 30))], key=warc._order) for _ in range(k)]
        out = [warc._order(x) for x in warc.LoserTree(runs)]
        assert out == sorted(warc._order(x) for run in runs for x in run)


# ---------------------------------------------------------------- nearest neighbours

def brute_nearest(vectors, queries, k=5):
    good = [(i, np.array(v, float)) for i, v in vectors if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    ids, x = np.array([i for i, _ in good]), np.stack([v for _, v in good])
    out = {}
    for i, q in good:
        if i in queries:
            s = ann.cosines(q, x)
            keep = np.flatnonzero(ids != i)
            out[i] = [(int(ids[j]), float(s[j])) for j in keep[np.lexsort((ids[keep], -s[keep]))][:k]]
    return out


@pytest.mark.parametrize("blocks", [(8192, 2048), (300, 7)])
def test_recall(spark, sf, blocks):
    vectors = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    got = ann.nearest(vectors, vectors.where("vec_id % 50 = 0"), block=blocks[0], query_block=blocks[1]).collect()
    want = brute_nearest([(r["vec_id"], r["embedding"]) for r in vectors.collect()], {r["query_id"] for r in got})
    found = {(r["query_id"], r["vec_id"]) for r in got}
    assert len(got) == 5 * len(want)
    assert sum((q, i) in found for q, best in want.items() for i, _ in best) >= 0.9 * len(got)
    for r in got:
        assert r["score"] == pytest.approx(dict(want[r["query_id"]]).get(r["vec_id"], r["score"]), abs=1e-15)


def test_nearest_odd_rows(spark):
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, [0.0, 0.0]), (5, None), (6, [None, 1.0]), (7, [float("nan"), 1.0]),
            (8, [float("inf"), 1.0]), (None, [1.0, 0.0]), (9, [1.0, 2.0, 3.0]), (50, [0.0, 3.0]), (50, [0.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("rank", F.lit(1)).withColumn("id", F.lit("clash"))
    got = ann.nearest(df, df.where("vec_id % 50 = 0")).orderBy("query_id", "rank").collect()
    assert [r["vec_id"] for r in got if r["query_id"] == 0] == [1, 2, 3, 50, 50]
    assert all(r["vec_id"] in (0, 1, 2, 3) for r in got if r["query_id"] == 50)
    empty = df.limit(0)
    assert ann.nearest(empty, empty).count() == 0
    assert ann.nearest(df, empty).count() == 0


def brute_ranked(rows, k=5):
    """Exact neighbours of every query row, vectors of equal length only."""
    fit = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    out = []
    for own, q in fit:
        if own % 50 == 0:
            near = sorted((-round(float(q @ x / np.sqrt((q @ q) * (x @ x))), 12), i) for i, x in fit if i != own and len(x) == len(q))
            out += [(own, rank, i, -s) for rank, (s, i) in enumerate(near[:k], 1)]
    return sorted(out)


def test_nearest_repeated_ids_vectors_and_lengths(spark):
    r = np.random.default_rng(8)
    rows = [(int(i), r.standard_normal(3 if i % 7 else 5).tolist()) for i in range(160)]
    rows += [(50, [1.0, 0.0, 0.5])] * 2 + [(50, [0.0, 1.0, 0.5])] + rows[3:9] * 3 + [(100, rows[100][1]), (7, [1.0]), (200, [2.0]), (250, [])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    for block, queries in ((4096, 4096), (16, 2)):
        got = ann.nearest(df, df.where("vec_id % 50 = 0"), block=block, query_block=queries).collect()
        assert sorted((a, b, c, round(s, 12)) for a, b, c, s in map(tuple, got)) == [(a, b, c, pytest.approx(s, abs=1e-11)) for a, b, c, s in brute_ranked(rows)]


def test_ties_among_equal_vectors(spark):
    df = spark.createDataFrame([(i, [0.3, 0.4, 0.5] if i % 3 else [1.0, 0.1 * i, 0.0]) for i in range(200)], "vec_id bigint, embedding array<double>")
    got = ann.nearest(df, df.where("vec_id % 50 = 0"), block=17).where("query_id = 50").orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == [1, 2, 4, 5, 7]


# ---------------------------------------------------------------- block labeller

def template_text(page):
    inner = re.search(r"<article>(.*)</article>", page, re.S).group(1)
    parts = re.split(r"<(?:/?p|/?h1)>", re.sub(r"</?b>", "", inner).replace("<br>", " "))
    return "\n\n".join(t for t in (" ".join(entities.unescape(p).split()) for p in parts) if t)


def test_main_text_of_whole_pages(spark, sf):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rows = html_blocks.main_text(pages).collect()
    html = {r["page_id"]: r["html"] for r in pages.collect()}
    assert len(rows) == len(html) and all(r["n_chars"] == len(r["text"]) for r in rows)
    assert np.mean([r["text"] == template_text(html[r["page_id"]]) for r in rows]) >= 0.98


def test_other_layouts(spark):
    """Layouts that the training draws from, with unseen seeds."""
    pages = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").orderBy("page_id").collect()]
    weights = html_blocks.train(*html_blocks.training_set(pages[:120]))
    wrong = total = 0
    for i, page in enumerate(pages[150:]):
        texts = [b.text for b in html_blocks.leaf_blocks(page) if b.inside][:20]
        blocks = html_blocks.leaf_blocks(html_blocks.layout(texts, ["some other words, and more of them."], 50_000 + i))
        y = np.array([b.text.startswith(html_blocks.MARK) for b in blocks])
        for b in blocks:
            b.text = b.text.lstrip(html_blocks.MARK + " ") or " "
        wrong += int((html_blocks.main_mask(weights, [blocks])[0] != y).sum())
        total += len(y)
    assert wrong <= 0.05 * total


def test_leaf_blocks():
    texts = lambda h: [b.text for b in html_blocks.leaf_blocks(h)]
    assert texts("<p>a <b>b</b>\n c&amp;&nbsp;d<p>e<br>f") == ["a b c& d", "e f"]
    assert texts("<script>var x='<p>no</p>';</script><style>p{}</style><!-- <p>no</p> --><title>t</title>yes") == ["yes"]
    assert texts("<ul><li>a<li>b<ul><li>c</ul></ul>") == ["a", "b", "c"]
    assert texts("<table><tr><td>1<td>2<tr><td>3</table>") == ["1", "2", "3"]
    assert texts("<a title=\"x > y\">in</a> <p class='unclosed>q") != []
    assert texts("<div>" * 5000 + "deep" + "</div>" * 5000) == ["deep"]
    assert texts("<li>" * 3000 + "end") == ["end"]
    assert texts(None) == texts("") == texts("<") == [] or texts("<") == ["<"]


def test_unclosed_hidden_tags_keep_the_page():
    texts = lambda h: [b.text for b in html_blocks.leaf_blocks(h)]
    assert texts("<svg class=x /><p>a</p><svg><text>no</text></svg><p>b") == ["a", "b"]
    for t in ("svg", "object", "select", "noscript", "template"):
        assert texts(f"<{t}><p>a</p><{t} x=1><p>b</p>") == ["a", "b"]
        assert texts(f"<{t}>no</{t}><p>a</p><{t}><p>b</p>") == ["a", "b"]
    assert texts("<p>a</p><script>no<p>no") == ["a"]


def test_long_pages_in_stretches():
    """States are carried from stretch to stretch: same logits at every length."""
    p = html_blocks.start()
    pages = [html_blocks.leaf_blocks("<article>" + "".join(f"<p class=c{i % 5}>word{i % 9} and {i}, more." for i in range(n)) + "</article>") for n in (57, 20, 1)]
    whole, _ = html_blocks.logits(p, *html_blocks.padded([html_blocks.vectors(b) for b in pages]))
    for stretch in (7, 19, 57, 100):
        z = html_blocks.logits_in_stretches(p, pages, stretch)
        for j, b in enumerate(pages):
            assert np.allclose(z[:len(b), j], whole[:len(b), j], atol=1e-4)


def test_learns_from_few_marked_pages(spark):
    """One marked page in 300, and marked pages that share a null id."""
    mark = "<html><body><nav><a href=/>x</a></nav><article><p>one two three.</p></article></body></html>"
    plain = "<html><body><div><p>one two three.</p></div></body></html>"
    assert html_blocks.fit(pages_of(spark, [(i, "u", plain) for i in range(299)] + [(299, "u", mark)])) is not None
    assert html_blocks.fit(pages_of(spark, [(i, "u", plain) for i in range(5)])) is None
    assert html_blocks.fit(pages_of(spark, [(None, "u", mark)] * 400)) is not None


def test_recurrent_gradients():
    rng = np.random.default_rng(0)
    p = {n: v.astype(np.float64) for n, v in html_blocks.start().items()}
    x, mask = html_blocks.padded([rng.random((n, html_blocks.WIDTH)).astype(np.float32) for n in (4, 2)])
    y = rng.integers(0, 2, mask.shape)

    def loss():
        z, _ = html_blocks.logits(p, x, mask)
        return float(np.where(mask, np.log1p(np.exp(z)) - y * z, 0).sum())

    z, (both, tf, tb) = html_blocks.logits(p, x, mask, True)
    d = np.where(mask, 1 / (1 + np.exp(-z)) - y, 0)
    g = {n: np.zeros_like(v) for n, v in p.items()}
    dboth = d[:, :, None] * p["o"]
    html_blocks.back_way(p, "f", x, tf, dboth[:, :, :html_blocks.HIDDEN], g)
    html_blocks.back_way(p, "b", x, tb, dboth[:, :, html_blocks.HIDDEN:], g)
    for name in ("xf", "hf", "bf", "xb", "hb", "bb"):
        at = tuple(1 for _ in p[name].shape)
        old, eps = p[name][at], 1e-3
        p[name][at] = old + eps
        up = loss()
        p[name][at] = old - eps
        down = loss()
        p[name][at] = old
        assert abs((up - down) / (2 * eps) - g[name][at]) < 5e-3, name


def test_main_text_odd_rows(spark):
    rows = [(1, None, None), (2, "u", ""), (2, "u", ""), (None, "v", "<p>hello there</p>"), (4, "w", "<nav>menu</nav><div>" * 2000), (5, "x", "\x00\x02 <p>&#0;&bogus;</p>")]
    got = html_blocks.main_text(pages_of(spark, rows).withColumn("text", F.lit("clash")).withColumn("id", F.lit(0))).collect()
    assert len(got) == len(rows) and {r["text"] for r in got if r["page_id"] in (1, 2)} == {""}
    assert [r["text"] for r in got if r["page_id"] is None] == ["hello there"]
    assert html_blocks.main_text(pages_of(spark, [])).count() == 0


# ---------------------------------------------------------------- mixing

def labelled(make_docs, make_labels, n=240):
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    texts, labels = [], []
    for i in range(n):
        q, t = (1, 0) if i % 4 < 2 else (0, 0) if i % 4 == 2 else (1, 1)
        words = [word() for _ in range(r.randint(30, 60))]
        if not q:
            words = [w + "###" for w in words]
        if t:
            words[3] = words[7] = "moron"
        texts.append(" ".join(words))
        labels.append((i, q, t))
    return make_docs(texts), make_labels(labels)


def test_rates_meet_targets(make_docs, make_labels):
    docs, labels = labelled(make_docs, make_labels)
    rows = mixing.mixture(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r["rate"] <= mixing.MAX_RATE for r in rows)
    total = Counter()
    for r in rows:
        assert sum(r["posterior"].values()) == pytest.approx(1)
        for d, p in r["posterior"].items():
            total[d] += p * r["rate"] * r["n_tokens"]
    whole = sum(total.values())
    for d, share in mixing.TARGETS.items():
        assert total[d] / whole == pytest.approx(share, abs=0.03)
    truth = {r["doc_id"]: (r["quality"], r["toxic"]) for r in labels.collect()}
    assert np.mean([r["copies"] for r in rows if truth[r["doc_id"]] == (1, 0)]) >= 0.97
    assert np.mean([r["copies"] for r in rows if truth[r["doc_id"]] != (1, 0)]) <= 0.2


def test_long_clean_documents_stay(make_docs, make_labels):
    """Marker words that clean texts have too, seldom: a long text holds many."""
    r = random.Random(8)
    marks = [c * 6 for c in "ijklmnopqrst"]
    word = lambda share: r.choice(marks) if r.random() < share else "".join(r.choice("abcdefgh") for _ in range(5))
    texts, labels = [], []
    for i in range(480):
        q, t = (1, 0) if i % 8 < 6 else (0, 0) if i % 8 == 6 else (1, 1)
        words = [word(0.15 if t else 0.002) for _ in range(r.randint(30, 400))]
        texts.append(" ".join(words if q else [w + "###" for w in words]))
        labels.append((i, q, t))
    sizes = [1000, 1500, 2000, 3000, 5000, 8000, 12_000, 20_000] * 2
    texts += [" ".join(word(0.002) for _ in range(n)) for n in sizes]
    rows = {x["doc_id"]: x for x in mixing.mixture(make_docs(texts), make_labels(labels)).collect()}
    short = [rows[i] for i, q, t in labels if (q, t) == (1, 0)]
    long = [rows[480 + i] for i in range(len(sizes))]
    for name in ("rate", "copies"):
        assert np.mean([x[name] for x in long]) >= np.mean([x[name] for x in short]) - 0.07
    assert all(x["rate"] >= 0.8 for x in long)
    assert np.mean([rows[i]["rate"] for i, q, t in labels if t]) <= 0.5


def test_copies_meet_targets(make_docs, make_labels):
    """A third and more of the tokens is junk whose target is 0.02: its rates are low but drawn."""
    docs, labels = labelled(make_docs, make_labels, 3000)
    hot = docs.where("doc_id % 4 = 2").select((F.col("doc_id") + 10_000).alias("doc_id"), *docs.columns[1:])
    rows = mixing.mixture(docs.unionByName(hot), labels).collect()
    fitted, drawn = Counter(), Counter()
    for r in rows:
        for d, p in r["posterior"].items():
            fitted[d] += p * r["rate"] * r["n_tokens"]
            drawn[d] += p * r["copies"] * r["n_tokens"]
    assert max(r["rate"] for r in rows if r["doc_id"] > 10_000) <= 0.1
    for d, share in mixing.TARGETS.items():
        assert drawn[d] / sum(drawn.values()) == pytest.approx(share, abs=0.008)
        assert drawn[d] == pytest.approx(fitted[d], rel=0.35)


def test_fit_is_projected_gradient(spark):
    """The table's fit against the same steps in numpy."""
    r = np.random.default_rng(2)
    p = r.dirichlet([0.3, 0.3, 0.3], 200)
    t = r.integers(5, 500, 200)
    df = spark.createDataFrame([(int(n), [float(x) for x in row]) for n, row in zip(t, p)], "tokens bigint, posterior array<double>")
    weights = {"a": 0.7, "b": 0.2, "c": 0.1}
    moves, result = mixing.fit_rates(df, ["a", "b", "c"], weights)
    have = (t[:, None] * p).sum(axis=0)
    want = np.array([0.7, 0.2, 0.1])
    target = (have / want).min() * want
    curve, rate = (p * t[:, None]).T @ p, np.ones(200)
    for _ in moves:
        gap = (t * rate) @ p - target
        rate = np.clip(rate - p @ np.linalg.solve(curve + 1e-6 * have.sum() * np.eye(3), gap), 0, 1)
    got = [v for v, _ in result.values()]
    assert got == pytest.approx(list((t * rate) @ p), rel=1e-6)
    assert [w for _, w in result.values()] == pytest.approx(list(target))


def test_little_junk_drops_no_clean_document(spark):
    names = list(mixing.TARGETS)
    rows = [(100, [1.0, 0.0, 0.0])] * 200 + [(100, [0.0, 1.0, 0.0]), (100, [0.0, 0.0, 1.0])]
    df = spark.createDataFrame(rows, "tokens bigint, posterior array<double>")
    _, result = mixing.fit_rates(df, names, mixing.TARGETS)
    assert [v for v, _ in result.values()] == pytest.approx([20_000, 100, 100], rel=0.01)
    _, result = mixing.fit_rates(df, names, mixing.TARGETS, upper=frozenset())
    assert [t for _, t in result.values()] == pytest.approx([4800, 100, 100])
    much = spark.createDataFrame(rows[:100] + rows[200:] * 50, "tokens bigint, posterior array<double>")
    assert [v for v, _ in mixing.fit_rates(much, names, mixing.TARGETS)[1].values()] == pytest.approx([10_000, 208.3, 208.3], rel=0.01)


def test_mixing_odd_rows(make_docs, make_labels):
    texts = [None, "", "  ", "w", "x " * 20_000, "same", "same"]
    for labels in ([], [(0, 1, 0), (1, 0, 0), (None, 1, 1), (3, None, 0), (3, 1, 0), (3, 1, 0)]):
        docs = make_docs(texts + [(None, "no id")], extra={"words": 1, "mix_copies": "clash"})
        rows = mixing.mixture(docs, make_labels(labels)).collect()
        assert len(rows) == len(texts) + 1 and all(0 <= r["rate"] <= 1 for r in rows)
        assert mixing.mix(docs, make_labels(labels)).columns == docs.columns
    assert mixing.mixture(make_docs([]), make_labels([(0, 1, 0)])).count() == 0
    assert mixing.mix(make_docs(texts), make_labels([])).count() == len(texts)


def test_mixing_is_native(make_docs, make_labels):
    docs, labels = labelled(make_docs, make_labels, 40)
    plan = mixing.mix(docs, labels)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# ---------------------------------------------------------------- pipeline

def test_pipeline(spark, tmp_path):
    import corpus_pipeline
    from vulnxml.llm import lang_id, pii, simhash

    src = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{src}/documents.parquet")
    extra = docs.limit(1).withColumn("doc_id", F.lit(10_001).cast("bigint")).withColumn("text", F.lit(None).cast("string"))
    copy = docs.orderBy("doc_id").limit(3).withColumn("doc_id", F.col("doc_id") + 20_000)
    docs.unionByName(extra).unionByName(copy).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{src}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    sf = str(tmp_path)
    step = spark.read.parquet(f"{sf}/documents.parquet")
    columns = step.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        step = corpus_pipeline.materialise(stage(spark, step, sf), "test")
        assert step.columns == columns
        seen[name] = {r["doc_id"]: r["text"] for r in step.collect()}
    assert 10_001 not in seen["language"] and len(seen["language"]) == docs.count() + 3
    comp = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs).collect()}
    assert set(seen["near_duplicates"]) == {i for i, c in comp.items() if i == c}
    assert all(seen["personal_data"][i] == pii.redact_text(t) for i, t in seen["near_duplicates"].items())
    assert set(seen["mixing"]) <= set(seen["personal_data"])
    out = corpus_pipeline.run(spark, sf).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("t")).collect()
    assert {r["doc_id"] for r in out} == set(seen["mixing"]) and all(r["n"] == r["t"] for r in out)
    assert lang_id.language(docs).where("rejected").count() == 0


@pytest.mark.parametrize("case", ["empty", "null texts", "odd"])
def test_pipeline_odd_tables(spark, tmp_path, case):
    import corpus_pipeline

    src = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{src}/documents.parquet")
    some = docs.orderBy("doc_id").limit(5)
    if case == "empty":
        docs = docs.limit(0)
    elif case == "null texts":
        docs = docs.withColumn("text", F.lit(None).cast("string"))
    else:
        bare = some.select(*[(F.col(c) + 30_000 if c == "doc_id" else F.col(c) if c == "text" else F.lit(None).cast(t)).alias(c) for c, t in docs.dtypes])
        blank = some.withColumn("doc_id", F.col("doc_id") + 40_000).withColumn("text", F.lit(""))
        nameless = some.limit(1).withColumn("doc_id", F.lit(None).cast("bigint"))
        docs = docs.unionByName(some).unionByName(bare).unionByName(blank).unionByName(nameless)
        for name in ("id", "rank", "score", "fp", "component_id", "rejected", "copies", "rate", "tokens"):
            docs = docs.withColumn(name, F.lit("kept"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{src}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    step, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    columns = step.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        step = corpus_pipeline.materialise(stage(spark, step, str(tmp_path)), "test")
        assert step.columns == columns
        seen[name] = step.collect()
    out = corpus_pipeline.run(spark, str(tmp_path)).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("t")).collect()
    assert {r["doc_id"] for r in out} == {r["doc_id"] for r in seen["mixing"]} and all(r["n"] == r["t"] for r in out)
    if case != "odd":
        assert not any(seen.values())
        return
    ids = {name: Counter(r["doc_id"] for r in rows) for name, rows in seen.items()}
    firsts = {r["doc_id"] for r in some.collect()}
    assert all(ids["language"][i] == 2 and ids["language"][i + 30_000] == 1 and not ids["language"][i + 40_000] for i in firsts)
    assert max(ids["near_duplicates"].values()) == 1 and None not in ids["near_duplicates"]
    assert not any(i >= 30_000 for i in ids["near_duplicates"])
    assert ids["personal_data"] == ids["near_duplicates"] and all(r["rank"] == r["tokens"] == "kept" for r in seen["mixing"])
