"""Golden tests from the literal fixtures (FIXTURES.md part C) and edge cases."""

import math

import pytest
from pyspark.sql import functions as F

from vulnxml.functions.arrays import fit_length, strip_padding
from vulnxml.functions.cpe import library_name, parse_cpe
from vulnxml.functions.text import basic_cleaning, parse_list_repr, remove_symbols, truncate_words
from vulnxml.operators import graph as G
from vulnxml.operators.cpe_matcher import invalid_reports, select_labels
from vulnxml.operators.ids import with_sequential_id
from vulnxml.operators.labels import find_equal_labels, merge_equal_labels
from vulnxml.operators.metrics import prf_at_k
from vulnxml.operators.split import stratified_split


def test_metric_worked_sample(spark):
    preds = [[1, 200, 300], [5, 10, 20], [3, 5, 10]]
    truth = [[1, 2], [5, 10, 20, 30, 40, 50], [3, 5, 100]]
    p = spark.createDataFrame([(d, lab, r + 1) for d, ps in enumerate(preds) for r, lab in enumerate(ps)],
                              "doc_id long, label_id long, rank int")
    t = spark.createDataFrame([(d, lab) for d, ts in enumerate(truth) for lab in ts], "doc_id long, label_id long")
    got = {r["k"]: r for r in prf_at_k(p, t, (1, 2, 3)).collect()}
    assert got[1]["precision"] == 1.0 and abs(got[2]["precision"] - 5 / 6) < 1e-6
    assert abs(got[3]["precision"] - 2 / 3) < 1e-6
    assert abs(got[1]["recall"] - 1 / 3) < 1e-6 and abs(got[2]["recall"] - 1 / 2) < 1e-6
    assert abs(got[3]["recall"] - 5 / 9) < 1e-6
    assert abs(got[1]["f1"] - 1 / 2) < 1e-6 and abs(got[2]["f1"] - 5 / 8) < 1e-6
    assert abs(got[3]["f1"] - 20 / 33) < 1e-6


def test_parse_cpe(spark):
    df = spark.createDataFrame([("cpe:2.3:a:tianocore:edk_ii:-:*:*:*:*:*:*:*",), ("cpe:2.3:H:x:x:1",), ("cpe:2.3:o:a",)],
                               "cpe string")
    rows = df.select(parse_cpe("cpe").alias("p")).select(
        "p.*", library_name("p.module", "p.library").alias("name")).collect()
    assert tuple(rows[0]) == ("tianocore", "edk_ii", "application", "tianocore edk_ii")
    assert tuple(rows[1]) == ("x", "x", "hardware", "x")
    assert rows[2]["library"] is None


def test_symbols_and_cleaning(spark):
    df = spark.createDataFrame([("a:b;c[d]e'f,g(h)i*j_k-l/mé\tn?o@p",), ("Héllo,   Wörld! x_y",), (None,)], "t string")
    r = df.select(remove_symbols("t").alias("s"), basic_cleaning("t").alias("c")).collect()
    assert r[0]["s"] == "abcde'f,g(h)i*j_k-l/mnop"
    assert r[1]["c"] == "héllo wörld x_y"
    assert r[2]["c"] == ""


def test_list_repr_and_invalid(spark):
    df = spark.createDataFrame([(1, "['cpe:2.3:a:b:c:1', 'cpe:2.3:o:d:d:2']"), (2, "[]")], "report_id long, cpe_text string")
    items = df.select("report_id", F.size(parse_list_repr("cpe_text")).alias("n")).collect()
    assert {r["report_id"]: r["n"] for r in items} == {1: 2, 2: 1}
    assert [r["report_id"] for r in invalid_reports(df).collect()] == [2]


def test_matcher_above_average(spark):
    m = spark.createDataFrame([("K", "x", 3), ("K", "y", 2), ("K", "z", 1), ("L", "x", 1), ("M", "x", 3), ("M", "y", 1)],
                              "key string, label string, cnt long")
    got = sorted((r["key"], r["label"]) for r in select_labels(m).collect())
    assert got == [("K", "x"), ("K", "y"), ("L", "x"), ("M", "x")]


def test_fit_length_and_padding(spark):
    df = spark.createDataFrame([([7, 8, 9],), ([1, 2, 3, 4, 5, 6],)], "ids array<int>")
    r = df.select(fit_length("ids", 4).alias("f")).select("f.*").collect()
    assert r[0]["input_ids"] == [7, 8, 9, 0] and r[0]["attention_mask"] == [1, 1, 1, 0]
    assert r[1]["input_ids"] == [1, 2, 3, 6] and r[1]["attention_mask"] == [1, 1, 1, 1]
    s = spark.createDataFrame([([5, 0, 3, 0],), ([5, 0, 3],)], "ids array<int>").select(strip_padding("ids").alias("x"))
    assert [r["x"] for r in s.collect()] == [[5, 3], [5, 0, 3]]


def test_truncate_filler(spark):
    df = spark.createDataFrame([("  A b C d ",), ("",)], "t string")
    assert [r[0] for r in df.select(truncate_words("t", 2)).collect()] == ["a b", "filling empty"]


def test_window_counts(spark):
    dw = G.doc_words(spark.createDataFrame([(0, "a b a c"), (1, "")], "doc_id long, text string"))
    assert {r["doc_id"]: r["n_windows"] for r in G.token_windows(dw, 3).collect()} == {0: 2, 1: 1}
    assert {r["word"]: r["window_freq"] for r in G.word_window_freq(dw, 3).collect()} == {"a": 2, "b": 2, "c": 1}
    pairs = {(r["word_a"], r["word_b"]): r["cnt"] for r in G.pair_window_count(dw, 3, mirrored=False).collect()}
    assert pairs == {("a", "b"): 3, ("a", "c"): 1, ("b", "c"): 1}


def test_window_counts_brute_force(spark):
    import random
    rnd = random.Random(3)
    texts = [" ".join(rnd.choice("abcde") for _ in range(rnd.randint(0, 30))) for _ in range(25)]
    w = 5
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    dw = G.doc_words(df)
    wf, pc = {}, {}
    for t in texts:
        ws = t.split()
        wins = [ws] if len(ws) <= w else [ws[j:j + w] for j in range(len(ws) - w + 1)]
        for win in wins:
            for x in set(win):
                wf[x] = wf.get(x, 0) + 1
            for i in range(1, len(win)):
                for j in range(i):
                    if win[i] != win[j]:
                        for k in ((win[i], win[j]), (win[j], win[i])):
                            pc[k] = pc.get(k, 0) + 1
    assert {r["word"]: r["window_freq"] for r in G.word_window_freq(dw, w).collect()} == wf
    assert {(r["word_a"], r["word_b"]): r["cnt"] for r in G.pair_window_count(dw, w).collect()} == pc


def test_equal_labels_and_merge(spark):
    rl = spark.createDataFrame([(1, "a"), (2, "a"), (1, "b"), (2, "b"), (2, "c")], "report_id long, label string")
    names = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), ("d", 4)], "label string, position long")
    pairs = find_equal_labels(rl, names)
    assert [(r["head"], r["label"]) for r in pairs.collect()] == [("a", "b")]
    merged = sorted(tuple(r) for r in merge_equal_labels(rl, pairs, names).collect())
    assert merged == [(1, "a;b"), (2, "a;b"), (2, "c")]


def test_sequential_ids_dense_and_ordered(spark):
    df = spark.range(0, 500).select((F.col("id") * 7919 % 1000).alias("k"))
    out = with_sequential_id(df.repartition(5), ["k"], "sid", num_partitions=6).collect()
    ordered = sorted(out, key=lambda r: r["sid"])
    assert [r["sid"] for r in ordered] == list(range(500))
    assert [r["k"] for r in ordered] == sorted(r["k"] for r in out)


def test_stratified_split_counts(spark):
    docs = spark.range(0, 103).withColumnRenamed("id", "doc_id")
    labels = docs.select("doc_id", (F.col("doc_id") % 3).cast("string").alias("label"))
    split = stratified_split(docs, labels, 1, 4, 7)
    rows = split.collect()
    assert len(rows) == 103 and sum(r["split"] == "test" for r in rows) == 103 // 4
    again = {tuple(r) for r in stratified_split(docs.repartition(7), labels, 1, 4, 7).collect()}
    assert again == {tuple(r) for r in rows}


def test_page_extraction_rules():
    from vulnxml.operators.pages import extract
    html = ("<html><head><title>T &amp; U</title><script>var t='</p>';</script></head><body><h1>Head</h1>"
            "<p>first<p>second</p><article><p>a1</p><p>a2 <b>bold</b></p></article>"
            "<div class=\"col-12 col-md-10\"><p>x</p><p>y</p><p>third</p></div></body></html>")
    assert extract("title", html) == "T & U"
    assert extract("h1", html) == "Head"
    assert extract("first_p", html) == "first"
    assert extract("article_p2", html) == "a2 bold"
    assert extract("gentoo_security", html) == "third"
    assert extract("launchpad", html) == ""


def test_route_urls(spark):
    from vulnxml.operators.pages import route_urls
    df = spark.createDataFrame([("https://bugzilla.redhat.com/show_bug.cgi?id=1",), ("https://access.redhat.com/x",),
                                ("https://lists.fedoraproject.org/archives/list/x",), ("https://example.org/",)],
                               "url string")
    assert [r["rule"] for r in route_urls(df).collect()] == ["bugzilla_redhat", "access_redhat", "fedora_archives", ""]


def test_stream_equals_batch(spark):
    from vulnxml.plans.queries_stream import _q_batch, _q_stream
    sf = "/root/testdata/sf0.001"
    assert {tuple(r) for r in _q_stream(spark, sf).collect()} == {tuple(r) for r in _q_batch(spark, sf).collect()}


def test_label_groups_cover_and_bound(spark):
    from vulnxml.operators.cluster import split_label_groups
    rows = [(f"L{i}", t, float((i * 7 + t * 3) % 5 + 1)) for i in range(11) for t in range(6) if (i + t) % 3]
    feats = spark.createDataFrame(rows, "label string, term_id long, weight double")
    groups = split_label_groups(feats, max_leaf=3, seed=1).collect()
    labels = [r["label"] for r in groups]
    assert sorted(labels) == sorted({r[0] for r in rows})  # every label exactly once
    sizes = {}
    for r in groups:
        sizes[r["group_id"]] = sizes.get(r["group_id"], 0) + 1
    assert max(sizes.values()) <= 3 and sorted(sizes) == list(range(len(sizes)))


def test_entry_smoke(spark):
    import __spark_entry__ as E
    rows = E.entry(spark).collect()
    assert len(rows) == 1 and rows[0]["n_true"] > 0
    assert set(E.oracle_sql()) <= set(E.queries())


def test_vector_blocks_any_size(spark, monkeypatch):
    import vulnxml.operators.vectors as V
    rows = [(i, [float((i * 3 + d) % 7 - 3) for d in range(4)]) for i in range(40)]
    vecs = spark.createDataFrame(rows, "doc_id long, vec array<double>")
    weights = spark.createDataFrame([(j, [float((j + d) % 5 - 2) for d in range(4)], 0.5 * j) for j in range(9)],
                                    "label_id long, w array<double>, bias double")
    keys = spark.createDataFrame([(str(j), [float((j * 2 + d) % 5 - 2) for d in range(4)]) for j in range(9)],
                                 "key string, vec array<double>")
    queries = vecs.selectExpr("cast(doc_id as string) as query", "vec")
    small = sorted(tuple(r) for r in V.linear_scores(vecs, weights).collect())
    near_small = sorted(tuple(r) for r in V.nearest_key(queries, keys).collect())
    monkeypatch.setattr(V, "BLOCK_BYTES", 4 * 8 * 2)
    big = sorted(tuple(r) for r in V.linear_scores(vecs, weights).collect())
    near_big = sorted(tuple(r) for r in V.nearest_key(queries, keys).collect())
    assert [(a, b) for a, b, _ in small] == [(a, b) for a, b, _ in big]
    assert all(abs(x[2] - y[2]) < 1e-9 for x, y in zip(small, big))
    assert [(a, b) for a, b, _ in near_small] == [(a, b) for a, b, _ in near_big]
    best = sorted(tuple(r) for r in V.linear_scores(vecs, weights, k=2).collect())
    want = []
    for d, v in rows:
        s = [(round(sum(x * float((j + i) % 5 - 2) for i, x in enumerate(v)) + 0.5 * j, 9), j) for j in range(9)]
        want += [(d, j, sc) for sc, j in sorted(s, key=lambda t: (-t[0], t[1]))[:2]]
    assert best == sorted(want)
    none = V.nearest_key(queries, keys.limit(0)).collect()
    assert len(none) == 40 and all(r["nearest"] is None for r in none)


def test_key_blocks_and_matched_labels_are_not_broadcast(spark):
    import vulnxml.operators.vectors as V
    from vulnxml.operators.cpe_matcher import match_or_nearest
    sets = spark.createDataFrame([(1, "red ring"), (2, "blue bolt"), (3, "red bolt bolt")], "report_id long, key string")
    labels = spark.createDataFrame([("red ring", "A"), ("blue bolt", "B"), ("blue bolt", "C")], "key string, label string")
    vecs = V.hashed_text_vectors(labels.select("key").distinct(), "key")
    out = match_or_nearest(sets, labels, vecs, V.hashed_text_vectors(sets, "key"))
    # The files of the tables are tiny, whatever their rows take in memory.
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert sorted(map(tuple, out.collect())) == [(1, "A", "red ring"), (2, "B", "blue bolt"), (2, "C", "blue bolt"),
                                                 (3, "B", "blue bolt"), (3, "C", "blue bolt")]
    blocks = V.pack_keys(vecs.selectExpr("key as name", "vec", "0.0D as bias"), "string", cosine=True).blocks
    assert blocks.selectExpr("max(length(mat))").first()[0] < 2 * 64 * 8 // 4


def _groups_brute_force(vecs, max_leaf, eps, seed):
    """Plain-Python twin of the level-synchronous balanced 2-means."""
    import hashlib
    import math

    def norm(v):
        n = math.sqrt(sum(x * x for x in v.values()))
        return {k: x / n for k, x in v.items()} if n > 0 else dict(v)

    def dot(a, b):
        return sum(x * b.get(k, 0.0) for k, x in a.items())

    assign = {lab: "" for lab in vecs}
    while True:
        sizes = {}
        for lab, node in assign.items():
            sizes[node] = sizes.get(node, 0) + 1
        big = {n for n, c in sizes.items() if c > max_leaf}
        if not big:
            break
        members = {n: sorted(lab for lab, nd in assign.items() if nd == n) for n in big}
        centers = {}
        for n, labs in members.items():
            h = sorted(labs, key=lambda lab: (hashlib.md5(f"{seed}|{n}|{lab}".encode()).hexdigest(), lab))
            centers[(n, 0)], centers[(n, 1)] = dict(vecs[h[0]]), dict(vecs[h[1]])
        sides = {}
        for n, labs in members.items():
            prev = None
            while True:
                scored = []
                for lab in labs:
                    d0, d1 = dot(vecs[lab], centers[(n, 0)]), dot(vecs[lab], centers[(n, 1)])
                    scored.append((round(d1 - d0, 9), lab, d0, d1))
                scored.sort()
                half, sims = len(labs) // 2, []
                for r, (_, lab, d0, d1) in enumerate(scored):
                    sides[lab] = 0 if r < half else 1
                    sims.append(d0 if r < half else d1)
                obj = sum(sims) / len(sims)
                if prev is not None and obj - prev < eps:
                    break
                prev = obj
                for side in (0, 1):
                    acc = {}
                    for lab in labs:
                        if sides[lab] == side:
                            for k, x in vecs[lab].items():
                                acc[k] = acc.get(k, 0.0) + x
                    centers[(n, side)] = norm(acc)
        for n, labs in members.items():
            for lab in labs:
                assign[lab] = n + str(sides[lab])
    nodes = sorted(set(assign.values()))
    return {lab: nodes.index(node) for lab, node in assign.items()}


def test_label_groups_equal_brute_force(spark):
    import random
    from vulnxml.operators.cluster import split_label_groups
    rnd = random.Random(11)
    vecs = {}
    for i in range(23):
        v = {t: rnd.random() for t in rnd.sample(range(12), 5)}
        n = sum(x * x for x in v.values()) ** 0.5
        vecs[f"L{i:02d}"] = {t: x / n for t, x in v.items()}
    rows = [(lab, t, x) for lab, v in vecs.items() for t, x in v.items()]
    feats = spark.createDataFrame(rows, "label string, term_id long, weight double")
    got = {r["label"]: r["group_id"] for r in split_label_groups(feats, max_leaf=3, eps=1e-4, seed=5, labels=spark.createDataFrame([('bare',)], 'label string')).collect()}
    assert got == _groups_brute_force({**vecs, "bare": {}}, 3, 1e-4, 5)


def test_host_extraction_rules():
    from vulnxml.operators.pages import extract

    def page(body, title=""):
        return f"<html><head><title>{title}</title></head><body>{body}</body></html>"

    norm = lambda t: " ".join(t.split())
    cases = [
        ("launchpad", page('<span class="yui3-editable_text-text ellipsis">Crash in x</span>'), "", "Crash in x"),
        ("openwall", page("<pre>Overflow in y\n============\nrest</pre>"), "", "Overflow in y"),
        ("openwall", page("<pre>Bug z Affected Versions 1.2</pre>"), "", "Bug z"),
        ("bugzilla_redhat", page('<div class="uneditable_textarea">Heap bug</div>'), "", "Heap bug"),
        ("bugzilla_redhat", page('<div id="c0"><pre class="bz_comment_text">intro\nDescription of problem\n'
                                 'line one\nline two\nVersion-Release number:\nx</pre></div>'), "",
         "line one line two"),
        ("access_redhat", page('<div id="description"><ul><li>CVE-1: other</li>'
                               '<li>A B use after free CVE-2 fixed</li></ul></div>'), "CVE-2", "use after free"),
        ("rhn_redhat", page('<div id="description"><p>One.</p><p>Two.</p></div>'), "", "One. Two."),
        ("lists_debian", page("<pre>head\nCVE-3 is fixed\n\nThe fix text.\n\nmore</pre>"), "CVE-3", "The fix text."),
        ("debian", page('<div id="content"><p>x</p><dl><dt>More information:</dt><dd><p>The debian text.</p>'
                        '<p>rest</p></dd></dl></div>'), "", "The debian text."),
        ("oracle", page("<h3>Intro</h3><p>no</p><h3>Description</h3><p>Oracle text</p><h3>Next</h3><p>no</p>"), "",
         "Oracle text"),
        ("oracle", page("<h3>Description</h3><div><p>Once</p></div><h3>Next</h3>"), "", "Once"),
        ("lists_opensuse", page('<div class="email-body">x\nDescription:\n- CVE-4: opensuse\ntext\n'
                                '- CVE-5: no\nPatch Instructions:\n</div>'), "CVE-4", "opensuse text"),
        ("fedora_pipermail", page("", "[SECURITY] Fedora Update: pkg-1.0"), "", "pkg-1.0"),
        ("fedora_archives", page('<div class="col-tn-10">Fedora Update: pkg-2.0</div>'), "", "pkg-2.0"),
        ("github", page('<div class="flex-auto min-width-0 width-fit mr-3"><a class="url fn">owner</a>'
                        '<strong><a>repo</a></strong></div>'), "", "owner repo"),
        ("gentoo_security", page('<div class="col-12 col-md-10"><p>a</p><p>b</p><p>gentoo text</p></div>'), "",
         "gentoo text"),
        ("gentoo_blogs", page('<h1 class="entry-title">Blog title</h1>'), "", "Blog title"),
        ("securitytracker", page("".join(f"<font>f{i}</font>" for i in range(30))), "", "f24"),
        ("usn_ubuntu", page('<div class="col-12"></div><div class="col-12"></div><div class="col-12">'
                            '<ul><li class="p-list__item">pkg1</li><li>skip</li></ul></div>'
                            '<div class="col-8"><p>Summary.</p></div>'), "", "pkg1. Summary."),
        ("ubuntu", page('<div class="col-12"><li>nav</div><div class="x col-12"><li>menu</div><div class="col-12"><ul><li>a'
                        '<li>b</ul></div><div class="col-8"><p>S.</p></div>'), "", "a. b. S."),
        ("ubuntu", page('<div class="col-12"><ul><li>a</li></ul></div><div class="col-8"><p>S.</p></div>'), "", ""),
        ("gentoo_blogs", page('<h1 class="entry-title big">Blog title</h1>'), "", "Blog title"),
        ("gentoo_blogs", page("<div>" * 5000 + '<h1 class="entry-title">Deep</h1>'), "", "Deep"),
        ("rhn_redhat", page('<div id="description">' + "<ul><li>" * 1500 + "<p>Deep li"), "", "Deep li"),
        ("bugzilla_redhat", page('<div id="c0"><pre class="bz_comment_text">Description:\none\nNext:\nno\nSummary:\ntwo\n'
                                 'End:\nno</pre></div>'), "", "one two"),
        ("github", page('<a class="url fn">owner</a><div class="flex-auto min-width-0 width-fit mr-3">'
                        '<strong><a>repo</a></strong></div>'), "", "owner repo"),
        ("no such rule", page("x"), "", ""),
    ]
    for rule, html, rid, want in cases:
        assert norm(extract(rule, html, rid)) == want, rule


def test_reference_text_any_join_strategy(spark):
    from vulnxml.operators.pages import reference_text
    n = 40
    pages = spark.createDataFrame([(f"https://bugs.launchpad.net/{i}", f'<span class="yui3-editable_text-text ellipsis">Text {i} ' + "x" * 3000 + "</span>")
                                   for i in range(n) if i % 4], "url string, html string")
    urls = spark.createDataFrame([(i, p, f"https://bugs.launchpad.net/{(i + p) % n}") for i in range(n) for p in (1, 0)], "report_id long, pos int, url string")
    want = {str(i): " ".join(f"text {j} " + "x" * 3000 for j in (i, (i + 1) % n) if j % 4) for i in range(n)}
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        for limit in ("-1", "20000", old):
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
            got = {r["report_id"]: r["reference_text"] for r in reference_text(urls, pages.unionByName(pages)).collect()}
            assert got == want, limit
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_docs_without_predictions_count(spark):
    p = spark.createDataFrame([("m", 1, 7, 1, 0.5)], "model string, doc_id long, label_id long, rank int, score double")
    t = spark.createDataFrame([(1, 7), (2, 8)], "doc_id long, label_id long")
    from vulnxml.operators import metrics as M
    row = M.prf_at_k(p, t, (1,)).first()
    assert (row["n_docs"], row["precision"], row["recall"]) == (2, 0.5, 0.5)
    assert M.prf_at_k(p, t, (1,), group_cols=["model"]).first()["n_docs"] == 2
    assert M.prf_at_k(p, t, (1,), docs=spark.createDataFrame([(1,), (2,), (3,), (4,)], "doc_id long")).first()["precision"] == 0.25
    assert M.prf_pooled(p, t, (1,)).first()["precision"] == 0.5
    assert M.precision_at(p, t, (1,)).first()["precision"] == 0.5
    assert M.precision_k_positive(p, t, 1).first()["precision"] == 0.5


def test_svmlight_header_roundtrip(spark):
    from vulnxml.sources import formats as IO
    feats = spark.createDataFrame([(0, 3, 0.5), (0, 1, 0.25), (1, 2, 1.0), (2, 0, 2.0)],
                                  "doc_id long, term_id int, weight double")
    labels = spark.createDataFrame([(0, 7), (0, 2), (2, 5)], "doc_id long, label_id int")
    path = IO.scratch_dir(spark, "svm-test")
    IO.write_svmlight(feats, labels, path, header=(3, 4, 8))
    numbered = IO.with_line_numbers(spark.read.text(path), "n").collect()
    lines = [r["value"] for r in sorted(numbered, key=lambda r: r["n"])]
    assert lines[0] == "3 4 8"
    assert lines[1] == "2,7 1:0.25 3:0.5" and lines[2] == " 2:1.0" and lines[3] == "5 0:2.0"
    back = IO.read_svmlight(spark, path, has_header=True).collect()
    got = sorted((r["doc_id"], tuple(r["labels"]), r["idx"], r["val"]) for r in back)
    assert got == [(0, (2, 7), 1, 0.25), (0, (2, 7), 3, 0.5), (1, (), 2, 1.0), (2, (5,), 0, 2.0)]


def test_reference_text_keeps_nouns(spark):
    from vulnxml.operators.pages import reference_text
    pages = spark.createDataFrame([(f"https://bugs.launchpad.net/{i}", f'<span class="yui3-editable_text-text ellipsis">{t}</span>')
                                   for i, t in enumerate(["A Crash happens in the kernel.", "quickly seen"])], "url string, html string")
    urls = spark.createDataFrame([(1, 0, "https://bugs.launchpad.net/0"), (1, 1, "https://bugs.launchpad.net/1"), (2, 0, "https://bugs.launchpad.net/1")], "report_id long, pos int, url string")
    tags = spark.createDataFrame([("crash", "NN"), ("kernel", "NNP"), ("happens", "VBZ"), ("quickly", "RB")], "word string, tag string")
    reports = spark.createDataFrame([(1,), (2,), (3,)], "report_id long")
    assert {r["report_id"]: r["reference_text"] for r in reference_text(urls, pages, reports=reports, tags=tags).collect()} == {"1": "crash kernel", "2": "", "3": ""}


def test_expand_groups_training_form(spark):
    from vulnxml.operators.rank import expand_groups
    scores = spark.createDataFrame([(1, 0, 2.0), (1, 1, 1.0), (1, 2, -3.0)], "doc_id long, group_id long, score double")
    groups = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2), ("d", 2)], "label string, group_id long")
    truth = spark.createDataFrame([(1, 2), (1, 2)], "doc_id long, group_id long")
    got = {r["label"]: r["group_score"] for r in expand_groups(scores, groups, 2, truth).collect()}
    low, high = 1 / (1 + math.exp(3)), 1 / (1 + math.exp(-2))
    assert got == pytest.approx({"a": high, "c": 1 + low, "d": 1 + low})


def test_label_groups_save_levels(spark):
    from vulnxml.operators.cluster import split_label_groups
    feats = spark.createDataFrame([(f"L{i:02d}", t, float((i * 7 + t * 5) % 11 + 1)) for i in range(12) for t in range(4)], "label string, term_id long, weight double")
    saved = {0: None, 1: None, 2: None, 5: None}
    last = {tuple(r) for r in split_label_groups(feats, max_leaf=3, seed=5, saved=saved).collect()}
    assert saved[5] is None and {tuple(r) for r in saved[2].collect()} == last
    assert {r["node"] for r in saved[1].collect()} == {"0", "1"} and saved[0].select("group_id").distinct().count() == 1


def _unit_labels(n, seed, terms=40):
    import random
    rnd = random.Random(seed)
    vecs = {}
    for i in range(n):
        v = {t: rnd.random() for t in rnd.sample(range(terms), rnd.randint(1, 5))}
        norm = sum(x * x for x in v.values()) ** 0.5
        vecs[f"L{i:05d}"] = {t: x / norm for t, x in v.items()}
    return vecs


@pytest.mark.parametrize("node_rows", [0, 30, 1 << 20])
def test_label_groups_rounds_and_tasks_agree(spark, node_rows):
    """Splits by all tasks (0), by both (30) and inside tasks give the same."""
    from vulnxml.operators.cluster import split_label_groups
    vecs = _unit_labels(21, 7, 12)
    feats = spark.createDataFrame([(a, t, x) for a, v in vecs.items() for t, x in v.items()], "label string, term_id long, weight double")
    got = {r["label"]: r["group_id"] for r in split_label_groups(feats, max_leaf=4, seed=2, labels=spark.createDataFrame([("none",)], "label string"), node_rows=node_rows).collect()}
    assert got == _groups_brute_force({**vecs, "none": {}}, 4, 1e-4, 2)


def test_label_groups_ten_thousand(spark):
    from vulnxml.operators.cluster import split_label_groups
    vecs = _unit_labels(10_000, 8, 300)
    feats = spark.createDataFrame([(a, t, x) for a, v in vecs.items() for t, x in v.items()], "label string, term_id long, weight double")
    rows = split_label_groups(feats, max_leaf=100, seed=2).collect()
    sizes = {}
    for r in rows:
        sizes[r["node"]] = sizes.get(r["node"], 0) + 1
    assert sorted(r["label"] for r in rows) == sorted(vecs)
    assert len(sizes) == 128 and set(sizes.values()) == {78, 79}
    assert {r["label"]: r["group_id"] for r in rows} == _groups_brute_force(vecs, 100, 1e-4, 2)


def test_label_groups_edge_cases(spark):
    from vulnxml.operators.cluster import split_label_groups
    schema = "label string, term_id long, weight double"
    assert split_label_groups(spark.createDataFrame([], schema), max_leaf=2).collect() == []
    one = split_label_groups(spark.createDataFrame([("a", 1, 2.0)], schema), max_leaf=2).collect()
    assert [tuple(r) for r in one] == [("a", 0, "")]
    same = spark.createDataFrame([(f"L{i}", 1, 1.0) for i in range(9)], schema)
    for node_rows in (0, 100):
        got = {r["label"]: r["node"] for r in split_label_groups(same, max_leaf=3, node_rows=node_rows).collect()}
        assert got == {f"L{i}": "0" + "01"[i > 1] if i < 4 else "1" + "01"[i > 5] for i in range(9)}


@pytest.mark.parametrize("n", [1, 2, 7, 40_000])
def test_rank_cuts(spark, n):
    from vulnxml.operators.ids import median_bracket, rank_cuts, uniform_bracket
    from pyspark.sql import functions as F
    df = spark.range(n).select(F.lit("x").alias("g"), (F.shiftleft(F.col("id") * 7919 % n % 1000, 31) + F.col("id")).alias("key"))
    keys = sorted(((i * 7919 % n % 1000) << 31) + i for i in range(n))
    assert rank_cuts(df, "g", median_bracket(df, "g")).first()["cut"] == keys[n // 2]
    hashes = spark.range(n).select(F.explode(F.array(*map(F.lit, range(4)))).alias("g"), F.conv(F.substring(F.md5(F.col("id").cast("string")), 1, 15), 16, 10).cast("bigint").alias("key"))
    targets = [0, n // 2, n // 5, n]
    counted = spark.createDataFrame([(g, n, t) for g, t in enumerate(targets)], "g int, n long, target long")
    import hashlib
    keys = sorted(int(hashlib.md5(str(i).encode()).hexdigest()[:15], 16) for i in range(n))
    got = {r["g"]: r["cut"] for r in rank_cuts(hashes, "g", uniform_bracket(counted, "g", 1 << 60)).collect()}
    assert got == {g: None if t >= n else 0 if t == 0 else keys[t] for g, t in enumerate(targets)}


def _small_scorer(spark, **kw):
    from vulnxml.streaming.score_stream import pack_scorer
    weights = spark.createDataFrame([(j, [float((j * 5 + d) % 7) / 7 for d in range(64)], 0.0) for j in range(6)], "label_id long, w array<double>, bias double")
    return pack_scorer(spark, weights, spark.createDataFrame([(f"L{j}", j) for j in range(6)], "label string, label_id long"), **kw)


def test_scorer_broadcast_equals_blocks(spark):
    from vulnxml.streaming.score_stream import score_batch
    docs = spark.createDataFrame([(1, "a buffer overflow in x"), (2, None), (3, ""), (4, "zz " * 500), (5, "a b")], "doc_id long, text string")
    here = {tuple(r) for r in score_batch(docs, _small_scorer(spark)).collect()}
    there = {tuple(r) for r in score_batch(docs, _small_scorer(spark, broadcast_bytes=0)).collect()}
    assert here == there and len(here) == 5
    assert dict(here)[2] == dict(here)[3] == "L0,L1,L2"  # a zero vector: ties by label id


def test_stream_batches_need_no_shuffle(spark, tmp_path):
    import os
    from vulnxml.session import ensure_checkpoint_dir
    from vulnxml.streaming.score_stream import score_batch, score_stream
    scorer = _small_scorer(spark)
    docs = spark.createDataFrame([(i, f"word{i % 5} and more") for i in range(40)], "doc_id long, text string")
    assert "Exchange" not in score_batch(docs, scorer)._jdf.queryExecution().executedPlan().toString()
    src = str(tmp_path / "in")
    for i in range(50):
        docs.where(f"doc_id % 50 = {i}").coalesce(1).write.mode("append").parquet(src)
    kept = lambda: sorted(os.listdir(ensure_checkpoint_dir(spark).removeprefix("file:")))
    before = kept()
    for run in (1, 2):  # a second run finds nothing new
        score_stream(spark, src, scorer, str(tmp_path / "out"), str(tmp_path / "ckpt"), file_glob="*.parquet")
        assert spark.read.parquet(str(tmp_path / "out")).count() == 40
    assert kept() == before  # no micro-batch leaves a checkpoint


def test_best_columns_ties_and_k():
    import numpy as np
    from vulnxml.operators.vectors import best_columns
    s = np.array([[0.1, 0.3, 0.3, 0.2], [0.5, 0.5 + 1e-12, 0.5, 0.5], [0.0, 0.0, 0.0, -1.0]])
    for k in (1, 2, 3, 4, 9):
        rows, cols = best_columns(s, k)
        want = [(r, c) for r in range(3) for c in sorted(range(4), key=lambda c: (-round(s[r, c], 9), c))[:k]]
        assert list(zip(rows.tolist(), cols.tolist())) == want


def _iterative_twin(ids, labels_of, num, den, seed):
    import hashlib
    order = lambda d: (hashlib.md5(f"{seed}|{d}".encode()).hexdigest(), d)
    docs_of = {}
    for d in ids:
        for lab in labels_of.get(d, ()):
            docs_of.setdefault(lab, set()).add(d)
    lack = {lab: (2 * num * len(v) + den) // (2 * den) for lab, v in docs_of.items()}
    open_, test = {d for d in ids if labels_of.get(d)}, set()
    while open_:
        lab = min((len(v & open_), x) for x, v in docs_of.items() if v & open_)[1]
        mine = sorted(docs_of[lab] & open_, key=order)
        new = set(mine[:max(0, lack[lab])])
        test |= new
        open_ -= set(mine)
        for d in new:
            for x in labels_of[d]:
                lack[x] -= 1
    missing = len(ids) * num // den - len(test)
    can = [d for d in ids if (d not in test) == (missing > 0) and (missing > 0 or labels_of.get(d))]
    for d in sorted(can, key=lambda d: (len(labels_of.get(d, ())), *order(d)))[:abs(missing)]:
        (test.add if missing > 0 else test.discard)(d)
    return test


@pytest.mark.parametrize("bare", [0, 30])
def test_iterative_split_equals_twin(spark, bare):
    import random
    from vulnxml.operators.split import iterative_split
    rnd = random.Random(3)
    labels_of = {d: {f"L{min(int(rnd.expovariate(0.4)), 7)}" for _ in range(rnd.randint(1, 3))} for d in range(160)}
    ids = list(range(160 + bare))
    docs = spark.createDataFrame([(d,) for d in ids], "doc_id long")
    dl = spark.createDataFrame([(d, x) for d, v in labels_of.items() for x in v] + [(9999, "L0")], "doc_id long, label string")
    rows = iterative_split(docs, dl, 1, 5, seed=4).collect()
    got = {r["doc_id"] for r in rows if r["split"] == "test"}
    assert len(rows) == len(ids) and len(got) == len(ids) // 5
    assert got == _iterative_twin(ids, labels_of, 1, 5, 4)
    # Several labels a round: still the exact size and shares near the quota.
    band = iterative_split(docs, dl, 1, 5, seed=4, rounds=3).where("split = 'test'").collect()
    assert len(band) == len(ids) // 5
    for lab in {x for v in labels_of.values() for x in v}:
        n = sum(lab in v for v in labels_of.values())
        for chosen in (got, {r["doc_id"] for r in band}):
            assert abs(sum(lab in labels_of.get(d, ()) for d in chosen) - n / 5) <= max(3, 0.1 * n)


def test_multi_hot_export(spark):
    from vulnxml.functions.arrays import multi_hot
    cases = [[], None, [0], [4], [3, 1, 3], [0, 1, 2, 3, 4], [None, 2], [-1, 5, 2]]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, ids array<bigint>")
    got = {r["i"]: r["v"] for r in df.select("i", multi_hot("ids", 5).alias("v")).collect()}
    assert got == {i: [int(x in (c or [])) for x in range(5)] for i, c in enumerate(cases)}
    assert df.select(multi_hot("ids", 0).alias("v")).first()["v"] == []


def test_mean_vectors_edge_cases(spark):
    """Unknown words count but add nothing; null and short vectors add what they have."""
    from vulnxml.operators.vectors import mean_vectors
    tokens = spark.createDataFrame([(1, 0, "a"), (1, 1, "a"), (1, 2, "b"), (1, 3, "?"), (2, 0, "?"), (3, 0, "n"), (4, 0, "s"), (4, 1, None)],
                                   "doc_id int, pos int, word string")
    vecs = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [4.0, -4.0]), ("n", None), ("s", [6.0])], "word string, vec array<double>")
    got = {r["doc_id"]: r["vec"] for r in mean_vectors(tokens, vecs, 2).collect()}
    assert got == {1: [1.5, 0.0], 2: [0.0, 0.0], 3: [0.0, 0.0], 4: [3.0, 0.0]}
    assert mean_vectors(tokens.limit(0), vecs, 2).count() == 0


@pytest.mark.parametrize("n", [0, 1, 7, 200])
def test_holdout_share_equals_holdout(spark, n):
    from vulnxml.operators.split import holdout, holdout_share
    corpus = spark.range(n + 5).select(F.col("id").alias("doc_id"), F.when(F.col("id") < n, "train").otherwise("test").alias("split"))
    rows = lambda df: sorted(map(tuple, df.select("doc_id", "split").collect()))
    assert rows(holdout_share(corpus, 1, 4, 42)) == rows(holdout(corpus, n // 4, 42))


def test_word_in_every_doc_is_spread(spark):
    """A word that all docs have is one join key: its partition is split at run
    time, and results stay whole."""
    from vulnxml.operators import text_ops, vectors, vocab
    docs = spark.range(0, 20000, 1, 8).select(F.col("id").alias("doc_id"), F.concat(F.lit("the w"), F.pmod(F.xxhash64("id"), F.lit(3000))).alias("text"))
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4096",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "8192", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        voc = vocab.build_vocab(vocab.lower_tokens(docs))
        stop = spark.createDataFrame([("w1",), ("w2",)], "word string")
        the = "the"
        for out, check in (
                (vocab.lookup_vocab(vocab.lower_tokens(docs), voc), lambda rows: sum(r["word"] == the for r in rows) == 20000 and len(rows) == 40000),
                (vocab.tfidf_transform(docs, vocab.tfidf_fit(docs)), lambda rows: len({r["doc_id"] for r in rows}) == 20000),
                (text_ops.remove_frequent_words(docs, stop), lambda rows: len(rows) == 20000 and all(r["text"].startswith(the) for r in rows)),
                (text_ops.nouns_only(docs, spark.createDataFrame([(the, "NN"), (the, "NNS"), ("w1", "VB")], "word string, tag string")),
                 lambda rows: len(rows) == 20000 and {r["text"] for r in rows} == {the}),
                (G.tfidf_edges(G.doc_words(docs)), lambda rows: len(rows) == 40000 and sum(r["word"] == the and r["weight"] == 0 for r in rows) == 20000),
                (vectors.mean_vectors(vocab.lower_tokens(docs), spark.createDataFrame([(the, [2.0])], "word string, vec array<double>"), 1),
                 lambda rows: len(rows) == 20000 and {r["vec"][0] for r in rows} == {1.0})):
            assert check(out.collect())
            plan = out._jdf.queryExecution().executedPlan().toString()
            assert "skew=true" in plan.split("== Initial Plan ==")[0], [x.strip()[:90] for x in plan.split("\n") if "Join" in x or "Read" in x]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_iterative_split_edge_cases(spark):
    from vulnxml.operators.split import iterative_split
    none = spark.createDataFrame([], "doc_id long, label string")
    docs = spark.createDataFrame([(d,) for d in (1, 1, 2, 3, 4, 5, 6)], "doc_id long")
    assert sorted(r["split"] for r in iterative_split(docs, none, 1, 3).collect()) == ["test"] * 2 + ["train"] * 4
    assert iterative_split(docs.limit(0), none).collect() == []
    one = spark.createDataFrame([(d, "a") for d in range(1, 7)] * 2, "doc_id long, label string")
    assert iterative_split(docs, one, 1, 2).where("split = 'test'").count() == 3


def test_stream_reads_a_table_of_several_files(spark, tmp_path):
    """the table may be one file or a folder of files."""
    from vulnxml.streaming.score_stream import score_stream
    docs = spark.createDataFrame([(i, f"word{i % 5}") for i in range(12)], "doc_id long, text string")
    docs.repartition(3).write.parquet(str(tmp_path / "many" / "documents.parquet"))
    docs.coalesce(1).write.parquet(str(tmp_path / "part"))
    (tmp_path / "one").mkdir()
    next((tmp_path / "part").glob("*.parquet")).rename(tmp_path / "one" / "documents.parquet")
    (tmp_path / "one" / "labels.parquet").write_bytes(b"another table")
    for kind in ("many", "one"):
        score_stream(spark, str(tmp_path / kind), _small_scorer(spark), str(tmp_path / f"{kind}-out"), str(tmp_path / f"{kind}-ckpt"))
        assert spark.read.parquet(str(tmp_path / f"{kind}-out")).count() == 12


@pytest.mark.parametrize("top,stretch", [(0, 1 << 20), (3, 7), (1 << 16, 1)])
def test_pairs_known_and_rare(spark, monkeypatch, top, stretch):
    """Pairs of known words, of rare ones and of both, summed in stretches."""
    import random
    monkeypatch.setattr(G, "TOP_WORDS", top)
    monkeypatch.setattr(G, "STRETCH", stretch)
    rnd = random.Random(5)
    texts = [" ".join(rnd.choice("aaabbcdefgh") for _ in range(rnd.randint(0, 25))) for _ in range(20)] + [None, ""]
    dw = G.doc_words(spark.createDataFrame([(i // 2, t) for i, t in enumerate(texts)], "doc_id long, text string"))
    w, want, freq, n = 4, {}, {}, 0
    for t in texts:
        ws = (t or "").split()
        for win in [ws] if len(ws) <= w else [ws[j:j + w] for j in range(len(ws) - w + 1)]:
            n += 1
            for x in set(win):
                freq[x] = freq.get(x, 0) + 1
            for a in range(len(win)):
                for b in range(len(win)):
                    if win[a] != win[b]:
                        want[win[a], win[b]] = want.get((win[a], win[b]), 0) + 1
    got = [tuple(r) for r in G.pair_window_count(dw, w).collect()]
    assert len(got) == len(want) and {(a, b): c for a, b, c in got} == want
    import math
    pmi = {p: math.log(c / n / (freq[p[0]] * freq[p[1]] / n / n)) for p, c in want.items()}
    edges = {(r["word_a"], r["word_b"]): r["pmi"] for r in G.pmi_edges(dw, w).collect()}
    assert edges == {p: pytest.approx(v) for p, v in pmi.items() if v > 0}


def test_pages_leave_no_cycles():
    """A parsed page is free as soon as its text is out."""
    import gc
    from vulnxml.operators.pages import extract
    page = "<html><h3>Description</h3><div>" + "<p>a <b>b</b></p>" * 500 + "</div></html>"
    gc.collect()
    gc.disable()
    try:
        assert extract("oracle", page) == "ab" * 500
        assert gc.collect() < 100
    finally:
        gc.enable()


def test_scores_are_not_shuffled_as_a_grid(spark):
    """Docs meet their labels before they are exploded."""
    import re
    from vulnxml.sources.fixtures import fx_scores
    plan = fx_scores(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Join \[doc_id#\d+L?, label_id#", plan)


def test_tokens_reach_their_ids_in_one_shuffle(spark):
    """no lists are gathered before the join on the word;
    F9: one shuffle of texts, none of tokens."""
    from vulnxml.operators import text_ops, vocab
    docs = spark.createDataFrame([(1, "a b a"), (2, None), (2, "b b c"), (None, "a")], "doc_id long, text string")
    voc = spark.createDataFrame([("a", 2), ("b", 3)], "word string, word_id long")
    ids = vocab.lookup_vocab(vocab.lower_tokens(docs), voc)
    assert "collect_list" not in ids._jdf.queryExecution().executedPlan().toString()
    rows = lambda df: sorted(map(str, map(tuple, df.collect())))
    assert rows(ids) == sorted(map(str, [(1, 0, "a", 2), (1, 1, "b", 3), (1, 2, "a", 2), (2, 0, "b", 3), (2, 1, "b", 3), (2, 2, "c", 0), (None, 0, "a", 2)]))
    assert {r["doc_id"]: r["ids"] for r in vocab.doc_sequences(ids).collect()} == {1: [2, 3, 2], 2: [3, 3, 0], None: [2]}
    frequent = text_ops.frequent_words(docs, 0.5)
    assert frequent._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert rows(frequent) == sorted(map(str, [(1, "a", 2, 1), (2, "b", 2, 1)]))


def test_ordered_writers_compute_their_input_once(spark, tmp_path):
    """finding ranges or norms doesn't run the input again."""
    from vulnxml.operators.cluster import label_features
    from vulnxml.sources.formats import write_svmlight
    seen = spark.sparkContext.accumulator(0)
    base = spark.range(0, 40, 1, 4).select((F.col("id") % 10).alias("doc_id"), F.col("id").alias("term_id"), F.lit(1.5).alias("weight"))

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b
    feats = base.mapInArrow(counted, "doc_id long, term_id long, weight double")
    labels = spark.createDataFrame([(d, d % 3) for d in range(10)], "doc_id long, label_id long")
    for run in (lambda: write_svmlight(feats, labels, str(tmp_path / "svm")),
                lambda: with_sequential_id(feats, ["term_id"]).collect(),
                lambda: label_features(feats, labels.withColumnRenamed("label_id", "label")).collect()):
        before = seen.value
        run()
        assert seen.value - before == 40


def test_pair_lists_are_small_and_summed_in_slices(spark, monkeypatch):
    """a partner takes a few bytes of a list; sums are the same in any slices."""
    from collections import Counter
    import numpy as np
    values = np.array([0, 1, 127, 128, 16383, 16384, 1 << 28, 1 << 35], np.int64)
    data, size = G._packed(values)
    assert list(size) == [1, 1, 1, 2, 2, 3, 5, 6] and (G._unpacked(data)[0] == values).all()
    dw = G.doc_words(spark.createDataFrame([(i, " ".join(f"w{(i * j) % 17}" for j in range(30))) for i in range(40)], "doc_id long, text string"))
    want = Counter({(r["word_a"], r["word_b"]): r["cnt"] for r in G.pair_window_count(dw, 5).collect()})
    monkeypatch.setattr(G, "PIECE", 3)
    monkeypatch.setattr(G, "STRETCH", 50)
    assert Counter({(r["word_a"], r["word_b"]): r["cnt"] for r in G.pair_window_count(dw, 5).collect()}) == want
    docs = G.written_docs(dw)
    lists = G._common_lists(docs, G.top_words(docs), 5)
    assert lists.columns == ["word", "pairs"]
    assert sum(len(r["pairs"]) for r in lists.collect()) <= 2 * sum(len(G._from_lists(_binary(r["pairs"]))[0]) for r in lists.collect())


def _binary(value):
    import pyarrow as pa
    return pa.array([value], pa.binary())


def test_words_are_counted_where_their_doc_lies(spark):
    """one shuffle by doc before the counts, none of tokens."""
    import re
    dw = G.doc_words(spark.createDataFrame([(1, "a b a"), (1, "a"), (2, None), (None, "b")], "doc_id long, text string"))
    tf = G._term_counts(dw)
    plan = tf._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(doc_id#\d+L?, word#", plan)
    assert sorted(map(str, map(tuple, tf.collect()))) == sorted(map(str, [(1, "a", 3), (1, "b", 1), (None, "b", 1)]))


def test_mean_vectors_with_rarer_words_apart(spark, monkeypatch):
    """vectors meet the docs where they lie, the rarer ones travel; no
    partial sums are shuffled."""
    from vulnxml.operators import vectors as V
    tokens = spark.createDataFrame([(d, p, w) for d in range(6) for p, w in enumerate(["a", "a", "b", f"c{d}", "?"])], "doc_id long, pos int, word string")
    vecs = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [4.0, -4.0]), ("b", [1.0, 0.0]), ("n", None)] + [(f"c{d}", [float(d)]) for d in range(6)], "word string, vec array<double>")
    rows = lambda: {r["doc_id"]: r["vec"] for r in V.mean_vectors(tokens, vecs, 2).collect()}
    want = {d: [pytest.approx((2 + 5 + d) / 6), pytest.approx(0.0)] for d in range(6)}
    assert rows() == want
    for most in (1, 3):
        monkeypatch.setattr(V, "SHARED_BYTES", 16 * most)
        assert rows() == want
    plan = V.mean_vectors(tokens, vecs, 2)._jdf.queryExecution().executedPlan().toString()
    top = plan.split("Exchange hashpartitioning(doc_id")[0]
    assert top.count("HashAggregate") == 2 and "_shared" in top


def test_shared_inputs_are_computed_once(spark):
    """what several branches read is not computed by each."""
    from vulnxml.operators.cpe_matcher import match_or_nearest
    from vulnxml.operators.rank import best_candidates_targets, sample_candidates
    seen = spark.sparkContext.accumulator(0)

    def counted(df):
        def each(batches):
            for b in batches:
                seen.add(b.num_rows)
                yield b
        return df.mapInArrow(each, df.schema)
    labels = spark.createDataFrame([(d, f"l{(d * 3 + j) % 7}") for d in range(10) for j in range(2)], "doc_id long, label string")
    groups = spark.createDataFrame([(f"l{i}", i % 3) for i in range(7)], "label string, group_id long")
    slots = spark.createDataFrame([(d, s, f"l{s}") for d in range(10) for s in range(2)], "doc_id long, slot long, label string")
    selected = spark.createDataFrame([(f"k{i}", f"l{i}", 1) for i in range(20)], "key string, label string, cnt long")
    sets = spark.createDataFrame([(1, "k1"), (2, "x")], "report_id long, key string")
    vecs = spark.createDataFrame([("k1", [1.0, 0.0]), ("k2", [0.0, 1.0])], "key string, vec array<double>")
    queries = spark.createDataFrame([("k1", [1.0, 0.0]), ("x", [0.1, 1.0])], "key string, vec array<double>")
    for run, rows in ((lambda: sample_candidates(counted(labels), groups, groups, 4).collect(), 20),
                      (lambda: best_candidates_targets(counted(slots), labels).collect(), 20),
                      (lambda: stratified_split(labels.select("doc_id"), counted(labels)).collect(), 20),
                      (lambda: match_or_nearest(sets, counted(selected), vecs, queries).collect(), 20)):
        before = seen.value
        run()
        assert seen.value - before == rows
    got = match_or_nearest(sets, selected, vecs, queries).collect()
    assert sorted(map(tuple, got)) == [(1, "l1", "k1"), (2, "l2", "k2")]


def test_doc_terms_give_the_same_features_as_rows(spark, monkeypatch):
    """Terms counted once per doc, known to every task or not; a doc that
    comes twice, is empty or has no id."""
    from vulnxml.operators import vocab as W
    rows = [(i % 37, " ".join(f"t{(i * j) % 23} u{i % 5}" for j in range(i % 9))) for i in range(80)] + [(None, "t1 t1 u2 zz"), (99, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    train = docs.filter("doc_id % 3 > 0")
    model = W.tfidf_fit(train)
    counts = W.doc_terms(docs)
    assert counts.count() == counts.select("doc_id").distinct().count() == 39
    for most in (1, 5, 1 << 16):
        monkeypatch.setattr(W, "TOP_TERMS", most)
        fitted = W.tfidf_fit(counts.filter("doc_id % 3 > 0"))
        assert sorted(map(tuple, fitted.select(*model.columns).collect())) == sorted(map(tuple, model.collect()))
        lists = W.tfidf_transform(counts, fitted)
        got = {(r["doc_id"], t): round(w, 9) for r in lists.collect() for t, w in zip(r["term_ids"], r["weights"])}
        assert got == {(r["doc_id"], r["term_id"]): round(r["weight"], 9) for r in W.tfidf_transform(docs, model).collect()}
        assert all(r["term_ids"] == sorted(r["term_ids"]) and r["term_ids"] for r in lists.collect())


def test_svmlight_lines_are_split_once(spark, tmp_path):
    """No line is split again above the explode, once per entry."""
    from vulnxml.sources import formats as IO
    spark.createDataFrame([("1,2 " + " ".join(f"{j}:0.5" for j in range(50)),)], "value string").write.text(str(tmp_path / "svm"))
    back = IO.read_svmlight(spark, str(tmp_path / "svm"))
    plan = back._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" in plan and "split(trim(" not in plan[:plan.index("Generate")]
    assert back.count() == 50 and back.selectExpr("max(labels)").first()[0] == [1, 2]


def test_docs_are_dealt_out_as_texts(spark):
    """Words take several times the room of their text, so texts are
    shuffled, once, for the written words and for the counts per doc."""
    docs = spark.createDataFrame([(1, "a b a"), (1, "a"), (2, None), (3, "b c")], "doc_id long, text string")
    split = spark.createDataFrame([(1, "train"), (2, "test"), (3, "train")], "doc_id long, split string")
    dw = G.doc_words(docs, dealt=True)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        tf = dw.join(split, "doc_id").select("doc_id", F.explode("words").alias("word")).groupBy("doc_id", "word").count()
        plan = tf._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 2 and plan.index("regexp_replace") < plan.index("REPARTITION_BY_NUM")
    assert sorted(map(tuple, tf.collect())) == [(1, "a", 3), (1, "b", 1), (3, "b", 1), (3, "c", 1)]
    written = dw.select("doc_id", "n_tokens", "words")._jdf.queryExecution().executedPlan().toString()
    assert written.count("Exchange") == 1
    assert sorted(map(str, map(tuple, G.written_docs(dw).collect()))) == sorted(map(str, map(tuple, G.doc_words(docs).select("doc_id", "n_tokens", "words").collect())))
