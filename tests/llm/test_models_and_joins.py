"""Language ID, HTML, the n-gram join, embeddings and the pipeline on small tables, against plain versions."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from genostrata.llm import common, embed_dedup, html_extract, lang_id, ngram_join

SYLLABLES = {"en": ["th", "er", "ing", "on", "wh"], "fr": ["eau", "ou", "oi", "ç", "é"], "de": ["sch", "ung", "pf", "tz", "ü"]}


def prose(lang, n, rng):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def test_gradient_is_that_of_the_loss():
    net = lang_id.start(["a", "b"], np.random.default_rng(0))
    net.weights = {k: v.astype(np.float64) for k, v in net.weights.items()}
    ids, live = lang_id.padded([b" ab c", b"xyz"])
    y = np.array([0, 1])
    _, g = lang_id.gradient(net, ids, live, y)
    for k, at in (("xf", (1, 97)), ("xb", (20, 98)), ("xf", (30, 120)), ("uf", (1, 2)), ("ub", (30, 3)), ("o", (1, 3))):
        w, e = net.weights[k], 1e-4
        w[at] += e
        up = lang_id.gradient(net, ids, live, y)[0]
        w[at] -= 2 * e
        down = lang_id.gradient(net, ids, live, y)[0]
        w[at] += e
        assert abs((up - down) / (2 * e) - g[k][at]) < 1e-5, (k, at)


def plain_labels(net, data):
    """Label probabilities of every position, byte after byte."""
    w, h = net.weights, lang_id.HIDDEN
    states = {}
    for d, places in (("f", range(len(data))), ("b", reversed(range(len(data))))):
        s = np.zeros(h)
        for t in places:
            x, u = w[f"x{d}"][:, data[t]], w[f"u{d}"] @ s
            z, r = (np.clip(0.2 * (x[i * h : (i + 1) * h] + u[i * h : (i + 1) * h]) + 0.5, 0, 1) for i in (0, 1))
            n = np.tanh(x[2 * h :] + r * u[2 * h :])
            s = z * s + (1 - z) * n
            states[d, t] = s
    a = np.exp([w["o"] @ np.concatenate([states["f", t], states["b", t], [1]]) for t in range(len(data))])
    return a / a.sum(1, keepdims=True)


def plain_document(net, text):
    data, own = text.lower().encode(), []
    for lo in range(0, len(data), 960):
        first = max(0, lo - 32)
        own.append(plain_labels(net, data[first : lo + 960 + 32])[lo - first :][:960])
    return np.concatenate(own).mean(0)


def test_documents_against_a_plain_reading(monkeypatch):
    monkeypatch.setattr(lang_id, "STEPS", 60)
    rng = random.Random(2)
    net = lang_id.train([(prose(x, 40, rng), x) for x in ["en", "fr", "de"] * 30])
    texts = ["x", "a b", prose("fr", 20, rng), prose("de", 900, rng), prose("en", 60, rng) + " " + prose("fr", 300, rng), "ç" * 2000, None, ""]
    got = lang_id.Labeller(net).documents(texts)
    for x, p in zip(texts, got):
        if x:
            assert np.abs(p - plain_document(net, x)).max() < 1e-5, x[:40]
    assert not got[6:].any()


def test_language_accuracy_and_edges(spark, docs, empty, monkeypatch):
    monkeypatch.setattr(lang_id, "STEPS", 80)
    rng = random.Random(4)
    rows = [(i, prose(x, 30, rng), x, "s", 1) for i, x in enumerate(["en", "fr", "de"] * 60)]
    df = spark.createDataFrame(rows, docs.schema)
    net = lang_id.learned(df)
    got = lang_id.identify(df.withColumn("score", F.lit("x")).withColumn("held", lang_id.held_out(F.col("doc_id"))), net).collect()
    held = [r for r in got if r["held"]]
    assert {r["doc_id"] for r in held} == {i for i in range(180) if zlib.crc32(str(i).encode()) % 4 == 2}
    assert np.mean([r["lang_pred"] == r["lang"] for r in held]) > 0.95
    odd = {(r["doc_id"], r["text"]): r for r in lang_id.identify(docs, net).collect()}
    assert len(lang_id.identify(docs, net).collect()) == docs.count()
    assert odd[(3, None)]["lang_pred"] == odd[(4, "")]["lang_pred"] == odd[(7, "12345 !!! ???")]["lang_pred"] == "und"
    assert all(0 <= r["score"] <= 1 for r in odd.values())
    assert lang_id.identify(empty, net).collect() == []
    nothing = lang_id.learned(empty)
    assert {r["lang_pred"] for r in lang_id.identify(docs, nothing).collect()} == {"und"}
    # a text has the same labels alone and among others
    a = lang_id.Labeller(net).documents(["thering eauou", "x"])
    b = lang_id.Labeller(net).documents(["schung " * 500, "thering eauou"])
    assert np.allclose(a[0], b[1], atol=1e-6)


PAGE = (
    '<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>if(a<b)"</p>"</script></head><body><header>Site</header><nav><ul><li><a href="/">Home</a></li></ul></nav>'
    '<!-- ad --><div class="ad">Buy</div><article><h1>T &amp; U</h1><p>a  b\n <b>c</b>d<p>e<br>f<ul><li>x<li>y</ul><div class="comments"><p>nice</p></div><aside>z</aside><form>q</form></article>'
    '<div class="cookie-notice">n</div><footer>&copy; f</footer></body></html>'
)


def test_html(spark):
    rows = [(1, "http://a.b/1", PAGE), (1, "http://a.b/1", PAGE), (2, None, None), (3, "x", ""), (4, "http://c.d/", "a &lt; b < c"), (5, "http://c.d/", "<p>" + "long " * 50_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1)).withColumn("host", F.lit("clash"))
    got = [(r["page_id"], r["text"]) for r in html_extract.extract(df).collect()]
    assert sorted(got)[:2] == [(1, "T & U\na b cd\ne f\nx\ny")] * 2
    assert dict(got)[2] == dict(got)[3] == "" and dict(got)[4] == "a < b < c" and len(dict(got)[5]) == 50_000 * 5 - 1
    assert html_extract.extract(df.limit(0)).collect() == []


@pytest.mark.parametrize("doc_id", [1, 7, 12345])
def test_a_language_is_learned_whatever_the_ids(spark, doc_id, monkeypatch):
    """Rows under one doc_id, and rows that are all the same."""
    sample = []
    monkeypatch.setattr(lang_id, "train", lambda rows, seed: sample.append(rows))
    rows = spark.range(6000).select(
        F.lit(doc_id).cast("long").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("all the same")).otherwise(F.concat(F.lit("text number "), F.col("id"))).alias("text"), F.when(F.col("id") % 3 == 0, "aa").otherwise("bb").alias("lang")
    )
    lang_id.learned(rows)
    if zlib.crc32(str(doc_id).encode()) % 4 == 2:
        assert sample == [[]]
        return
    found = Counter(y for _, y in sample[0])
    assert found == {"aa": 1, "bb": lang_id.SAMPLE_ROWS} and ("all the same", "aa") in sample[0]


HELLO = "<p>Hello main text</p>"
NAMED = [
    (f'<body class="no-sidebar"><article>{HELLO}</article></body>', "Hello main text"),
    (f'<body class="page comments-open"><article>{HELLO}</article></body>', "Hello main text"),
    (f'<body class="sidebar widget"><main>{HELLO}<div class="comments"><p>nice</p></div></main></body>', "Hello main text"),
    (f'<article class="post tag-related">{HELLO}</article>', "Hello main text"),
    (f'<div class="article-with-sidebar"><article>{HELLO}</article></div>', "Hello main text"),
    (f'<div class="sidebar"><article>{HELLO}</article></div>', "Hello main text"),
    (f'<form id="aspnetForm"><div class="sidebar">s</div><article>{HELLO}<form>go</form></article><footer>f</footer></form>', "Hello main text"),
    (f'<div id="post"><article>{HELLO}</article></div><div class="comments"><article class="comment">nice, and longer than the text is</article></div>', "Hello main text"),
    (f'<header class="top"><div><article>{HELLO}</article></div></header>', "Hello main text"),
    (f'<div class="page sidebar-page">{HELLO}</div><div class="related">r</div>', "Hello main text"),
    (f'<form id="f">{HELLO}</form><div class="sidebar">x</div>', "Hello main text"),
    (f"<header>Site</header>{HELLO}", "Hello main text"),
    ('<div class="comments"><p>talk</p></div>', ""),
    ('<body class="no-comments"><div id="respond"><p>talk</p></div></body>', ""),
    (f'<main><div class="widget"><h1>T</h1>{HELLO}</div><div class="share">on</div></main>', "T\nHello main text"),
]


@pytest.mark.parametrize("page,want", NAMED)
def test_html_names_are_no_verdict_on_what_holds_the_main_branch(page, want):
    assert html_extract.Reader().text(page, set()) == want


def test_html_style_tree(spark):
    """Without an article, what stands on every page of the host is cut, and what differs stays."""
    page = '<div class="x1"><p>Welcome to our site</p></div><div class="x2"><p>Story number {} is told here</p></div><div class="x3"><p>All rights kept</p></div>'
    rows = [(i, f"http://h.com/{i}", page.format(i)) for i in range(12)] + [(100, "http://alone.org/", page.format(100))]
    got = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == "Story number 3 is told here"
    assert got[100].split("\n") == ["Welcome to our site", "Story number 100 is told here", "All rights kept"]


def test_html_reader_keeps_elements_apart():
    """One reader's verdicts don't leak between elements of unlike attributes, whatever the order."""
    long = 'style="' + "x" * 300 + '"'
    pages = [f'<div class="comments" {long}>talk</div>', f"<div {long}>main text</div>", "<div>main text</div>", '<p><span class="ad">Buy</span> one <span>two</span> three</p>', "<p><span>two</span> three</p>"]
    want = ["", "main text", "main text", "one two three", "two three"]
    for order in (range(5), reversed(range(5))):
        reader = html_extract.Reader()
        assert all(reader.text(pages[i], set()) == want[i] for i in order)


STORY = '<main><div class="q7"><h1>Title {0}</h1><p>Story number {0} is told here</p><p>and goes on for {0} lines</p></div><div class="q8"><ul><li>Tell your friends</li><li>Write to us</li></ul></div></main><div class="q9"><p>All rights kept</p></div>'


def test_html_style_tree_within_the_main_branch(spark):
    """Boilerplate in main without a telling class is cut; copies of one page lose nothing."""
    rows = [(i, f"http://h.com/{i}", STORY.format(i)) for i in range(12)] + [(100 + i, "http://copies.org/", STORY.format(7)) for i in range(12)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_extract.extract(df).collect()}
    assert got[3] == "Title 3\nStory number 3 is told here\nand goes on for 3 lines"
    assert got[105] == "Title 7\nStory number 7 is told here\nand goes on for 7 lines\nTell your friends\nWrite to us"


def test_html_tree_against_brute_force(spark):
    """Importances of nested branches, from the pages' trees as nested lists."""
    rng = random.Random(3)

    def tree(depth):
        kids = [("div" if depth < 3 and rng.random() < 0.5 else "p", rng.choice("xy"), rng.randint(0, 3)) for _ in range(rng.randint(1, 3))]
        return [(tag, style, tree(depth + 1) if tag == "div" else f"text {text}") for tag, style, text in kids]

    def html(nodes):
        return "".join(f'<{tag} class="{c}">{html(x) if tag == "div" else x}</{tag}>' for tag, c, x in nodes)

    def walk(nodes, path, out):
        for tag, c, x in nodes:
            here = (*path, (tag, c))
            texts, layouts = out.setdefault(here, (set(), set()))
            if tag == "div":
                kids = [(t, k) for t, k, _ in x]
                layouts.add(tuple(k for i, k in enumerate(kids) if not i or kids[i - 1] != k))
                walk(x, here, out)
            else:
                texts.add(x)

    pages = [tree(0) for _ in range(40)]
    shown, texts, layouts = Counter(), {}, {}
    for page in pages:
        one = {}
        walk(page, (), one)
        for path, (t, lay) in one.items():
            shown[path] += 1
            texts.setdefault(path, Counter()).update(t)
            layouts.setdefault(path, Counter()).update(lay)
    want = {}
    for b in shown:
        below = [p for p in shown if p[: len(b)] == b]
        t = sum(sum(texts[p].values()) for p in below)
        lay = sum(sum(layouts[p].values()) for p in below)
        if t:
            content = sum(k * (1 - min(1, sum(j * math.log(j) for j in texts[p].values()) / sum(texts[p].values()) / math.log(max(2, shown[p])))) for p in below for k in [sum(texts[p].values())] if k)
            spread = sum(k * (math.log(k) - sum(j * math.log(j) for j in layouts[p].values()) / k) / math.log(max(2, k)) for p in below for k in [sum(layouts[p].values())] if k)
            want[b] = (shown[b], 0.1 * (spread / lay if lay else 0) + 0.9 * content / t)
    df = spark.createDataFrame([("h", html(p)) for p in pages], "host string, html string")
    got = sorted((r["m"], round(r["importance"], 9)) for r in html_extract.importances(df).collect())
    assert got == sorted((m, round(x, 9)) for m, x in want.values())


def brute_components(ids, near):
    label = {i: i for i in range(len(ids))}
    for i in range(len(ids)):
        for j in np.flatnonzero(near[i]):
            a, b = label[i], label[int(j)]
            if a != b:
                for k in label:
                    if label[k] == b:
                        label[k] = a
    low = {}
    for i, x in label.items():
        low[x] = min(low.get(x, ids[i]), ids[i])
    return [low[label[i]] for i in range(len(ids))]


@pytest.mark.parametrize("many", [1000, 3])
def test_component_search_has_partitions_by_its_edges(spark, monkeypatch, many):
    """Small tables in many shuffle partitions: every step's files are as many as the edges need."""
    rng = random.Random(4)
    ids = list(range(300))
    pairs = [(i, i + rng.choice([1, 7])) for i in range(0, 280, 2)] + [(250, i) for i in range(100, 120)]
    near = np.zeros((300, 300), bool)
    for a, b in pairs:
        near[a, b] = near[b, a] = True
    want = dict(zip(ids, brute_components(ids, near)))
    cuts, durable = [], common.durable

    def counted(df):
        cuts.append((out := durable(df)).rdd.getNumPartitions())
        return out

    monkeypatch.setattr(common, "durable", counted)
    monkeypatch.setattr(common, "MANY_NEIGHBOURS", many)
    conf = {"spark.sql.shuffle.partitions": "30", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        found = common.components(spark.createDataFrame(pairs, "a long, b long")).collect()
        assert {r["vertex"]: r["component"] for r in found} == {i: want[i] for p in pairs for i in p} and len(found) == len({i for p in pairs for i in p})
        assert len(cuts) > 4 and max(cuts[1:]) <= 2 * spark.sparkContext.defaultParallelism, cuts
        monkeypatch.setattr(common, "NARROW_ROWS", 10)
        del cuts[:]
        assert sorted(common.components(spark.createDataFrame(pairs, "a long, b long")).collect()) == sorted(found)
        assert cuts[1] > 2 * spark.sparkContext.defaultParallelism, cuts
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def near_texts(rng):
    out = []
    for base in range(25):
        words = [f"w{rng.randint(0, 5000)}" for _ in range(rng.choice([3, 12, 40, 120]))]
        out.append(" ".join(words))
        for _ in range(rng.choice([0, 1, 5])):
            v = list(words)
            for _ in range(rng.choice([0, 1, 2])):
                v[rng.randrange(len(v))] = f"n{rng.randint(0, 9999)}"
            out.append(" ".join(v))
    return out


def test_join_against_brute_force(spark, docs, empty, monkeypatch):
    rng = random.Random(9)
    texts = near_texts(rng)
    common = " ".join(f"c{i}" for i in range(60))
    texts += [f"{common} {' '.join(f'u{rng.randint(0, 9**6)}' for _ in range(60))}" for _ in range(60)]
    monkeypatch.setattr(ngram_join, "BUCKET", 8)  # so that buckets are split, cut and tiled here too
    monkeypatch.setattr(ngram_join, "BLOCK", 4)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in ngram_join.join(df).collect()}
    sets = [set(ngram_join.shingles(t).tolist()) for t in texts]
    near = np.array([[i != j and len(a & b) * 9 >= 4 * (len(a) + len(b)) for j, b in enumerate(sets)] for i, a in enumerate(sets)])
    want = brute_components(list(range(len(texts))), near)
    assert sum(got[i] != (want[i], int(near[i].sum())) for i in range(len(texts))) <= 1
    r = ngram_join.join(docs.withColumn("c", F.lit(1)).withColumn("path", F.lit(2))).collect()
    assert len(r) == docs.count()
    assert {x["n_links"] for x in r if x["doc_id"] in (1, 2)} == {2} and {x["class_id"] for x in r if x["doc_id"] in (1, 2)} == {1}
    assert all(x["n_links"] == 0 for x in r if x["doc_id"] in (3, 4, 5, 6, 7))
    assert ngram_join.join(empty).collect() == []


def test_forest_and_sketch():
    s = ngram_join.shingles(" ".join(f"w{i}" for i in range(400)))
    a = ngram_join.sketch(*ngram_join.least_members(s))
    b = ngram_join.sketch(*ngram_join.least_members(ngram_join.shingles(" ".join(f"z{i}" for i in range(400)))))
    assert ngram_join.forest(np.stack([a, b, a, b])).tolist() == [0, 1, 0, 1]
    assert ngram_join.runs_needed() == 6
    x = ngram_join.intersections([s[:10], s[5:20], s[30:31]])
    assert x[0, 1] == 5 and x[0, 2] == 0


def test_candidates_of_a_leaf_in_many_parts(spark, monkeypatch):
    """Near pairs, like no other text of their leaf, are candidates whatever parts they fall in."""
    monkeypatch.setattr(ngram_join, "PART", 16)
    texts = [" ".join(f"{i}w{j}" for j in range(300)) for i in range(120)]
    texts += [x + " more words stand here" for x in texts]
    sks = [ngram_join.sketch(*ngram_join.least_members(ngram_join.shingles(x))).tobytes() for x in texts]
    rows = spark.createDataFrame([(7, len(sks), i.to_bytes(2, "big"), x) for i, x in enumerate(sks)], "path long, m long, c binary, sketch binary")
    got = {frozenset((int.from_bytes(r["a"], "big"), int.from_bytes(r["b"], "big"))) for r in ngram_join.candidate_links(rows).collect()}
    assert got == {frozenset((i, i + 120)) for i in range(120)}


def test_forest_with_sides():
    s = [ngram_join.sketch(*ngram_join.least_members(ngram_join.shingles(" ".join(f"{k}{i}" for i in range(400))))) for k in "ab"]
    x = np.stack([s[0], s[0], s[1], s[1], s[0], s[1]])
    assert ngram_join.forest(x, np.array([0, 0, 0, 0, 1, 0], bool)).tolist() == [0, 0, 2, 3, 0, 5]
    assert ngram_join.forest(x, np.zeros(6, bool)).tolist() == [0, 0, 2, 2, 0, 2]


def test_embeddings_against_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(60, 16))
    v = np.concatenate([base, base[:20] + rng.normal(size=(20, 16)) * 0.25, base[:5], base[:3] * 7]).astype(np.float32)
    rows = [(i, x.tolist(), 1) for i, x in enumerate(v)]
    odd = [(900, None, 1), (901, [], 1), (902, [0.0] * 16, 1), (903, [1.0, None] * 8, 1), (904, [float("nan")] * 16, 1), (905, [float("inf")] * 16, 1), (906, [1.0, 2.0], 1), (None, [1.0] * 16, None), (0, rows[0][1], 1)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, c int")
    got = embed_dedup.dedup(df).collect()
    assert len(got) == len(rows) + len(odd)
    u = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    u = np.concatenate([u, u[:1]])
    ids = [*range(len(v)), 0]
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    want = brute_components(ids, near)
    by = {}
    for r in got:
        by.setdefault(r["vec_id"], []).append(r)
    for i in range(len(v)):
        assert {(r["n_links"], r["component_id"]) for r in by[i]} == {(int(near[i].sum()), want[i])}, i
    assert all(by[i][0]["n_links"] == 0 and by[i][0]["component_id"] == i and by[i][0]["kept"] for i in range(900, 907))
    assert embed_dedup.dedup(df.limit(0)).collect() == []


def test_links_of_a_filter_in_many_parts(spark, monkeypatch):
    """Isolated pairs in one dense cone, near no other vector, are found whatever parts they fall in."""
    monkeypatch.setattr(embed_dedup, "PART", 16)
    rng = np.random.default_rng(5)
    d, pairs = 64, 150
    u = rng.normal(size=(pairs, d - 1))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    w = u + rng.normal(size=u.shape) * 0.03
    w /= np.linalg.norm(w, axis=1, keepdims=True)
    v = np.concatenate([np.pad(x * 0.6, ((0, 0), (1, 0)), constant_values=1.0) for x in (u, w)]).astype(np.float32)
    near = (y := v / np.linalg.norm(v, axis=1, keepdims=True)) @ y.T >= 0.9
    np.fill_diagonal(near, False)
    assert 0.6 < (y @ y.T).min() and np.median(near.sum(1)) == 1
    rows = spark.createDataFrame([(7, i.to_bytes(2, "big"), x.tobytes()) for i, x in enumerate(v)], "path long, c binary, x binary")
    got = embed_dedup.filter_links(rows, np.float32, 0.9).collect()
    at = [(int.from_bytes(r["a"], "big"), int.from_bytes(r["b"], "big")) for r in got]
    label = np.arange(len(v))
    for _ in range(len(v)):
        for a, b in at:
            label[a] = label[b] = min(label[a], label[b])
    assert label.tolist() == brute_components(list(range(len(v))), near)


def test_pipeline_stages(spark, docs, empty, monkeypatch):
    monkeypatch.setattr(lang_id, "STEPS", 40)
    rng = random.Random(6)
    rows = []
    for i, x in enumerate(["en", "fr", "de"] * 20):
        rows.append((i, prose(x, 60, rng), x, f"s{i % 4}", 1))
    rows += [(100 + i, rows[i][1], "en", "s0", 1) for i in range(10)] + [(200, rows[20][1] + ' password = "hunter2222"', "de", None, 1), (0, rows[0][1], "en", "s0", 1)]
    df = spark.createDataFrame(rows, docs.schema).unionByName(docs).withColumn("clash", F.lit(1))
    s1 = corpus_pipeline.language_id(spark, df, "").cache()
    assert s1.columns == list(corpus_pipeline.COLUMNS) and {r["doc_id"] for r in s1.collect()} >= set(range(60)) | {200}
    assert s1.where("text is null or doc_id in (4, 7) and length(text) < 20").count() == 0
    s2 = corpus_pipeline.near_duplicates(spark, s1, "").cache()
    ids = [r["doc_id"] for r in s2.collect()]
    assert ids.count(0) == 1 and not set(range(100, 110)) & set(ids) and set(range(60)) - {1, 2} <= set(ids)
    s3 = corpus_pipeline.secrets(spark, s2, "").cache()
    assert s3.count() == s2.count() and s3.where("text like '%hunter%'").count() == 0
    s4 = corpus_pipeline.mix(spark, s3, "").cache()
    assert s4.columns == list(corpus_pipeline.COLUMNS) and s4.groupBy("doc_id", "text").count().agg(F.max("count")).first()[0] <= 2
    s5 = corpus_pipeline.encode(spark, s4, "")
    assert s5.count() == s4.count() and s5.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert corpus_pipeline.near_duplicates(spark, empty, "").collect() == [] and corpus_pipeline.mix(spark, empty, "").collect() == []
