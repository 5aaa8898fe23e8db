import itertools

import numpy as np
from pyspark.sql import functions as F

from plumbline.llm import dom_tree as dt


def test_held_out_pages():
    m = dt.default_model()
    pages = dt.labelled_pages(120, seed=77)
    texts = m.texts([h for h, _ in pages])
    want = [set(t.split("\n")) for _, t in pages]
    got = [set(t.split("\n")) for t in texts]
    both = sum(len(a & b) for a, b in zip(want, got, strict=True))
    assert both / sum(map(len, want)) > 0.97 and both / sum(map(len, got)) > 0.97
    assert sum(a == t for a, (_, t) in zip(texts, pages, strict=True)) > 105


def test_marginals_equal_enumeration():
    page = dt.Page("<body><div class=content><p>One two.</p><p>Three</p></div><nav><a href=x>four</a></nav></body>")
    forest = dt.Forest([page])
    rng = np.random.default_rng(4)
    unary, edge = rng.normal(size=forest.n), rng.normal(size=(2, 2, 2))
    p, joint, log_z = forest.messages(unary, edge)
    total, by_node, by_edge = 0.0, np.zeros(forest.n), np.zeros((forest.n, 2, 2))
    for state in itertools.product((0, 1), repeat=forest.n):
        s = np.array(state)
        w = np.exp(unary @ s + sum(edge[int(forest.leaf[k]), s[forest.parent[k]], s[k]] for k in range(forest.n) if forest.parent[k] >= 0))
        total += w
        by_node += w * s
        for k in range(forest.n):
            if forest.parent[k] >= 0:
                by_edge[k, s[forest.parent[k]], s[k]] += w
    assert np.allclose(p, by_node / total) and np.isclose(log_z[0], np.log(total))
    assert np.allclose(joint[1:], by_edge[1:] / total)


PAGE = '<html><head><title>T &am</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">a</a></li></ul></nav><!-- ad --><div class="ad">Buy this now.</div><article><h1>Head &amp; more</h1><p><b>First  line\nhere.<br><p>Second caf&eacute; &lt;x&gt;.</p><section class="comments"><p>I like it, really I do.</p></section></article><footer>&copy; site &middot; words.'


def test_the_tables_skeleton_and_odd_pages(spark):
    rows = [(1, PAGE), (1, PAGE), (2, None), (3, ""), (4, "plain words only"), (5, "<p>" + "long text here. " * 20_000 + "</p>"), (6, "<" * 1000 + '<a href="' + "<div>" * 3000 + "<p>deep words in a page.</p>"), (7, "<script>never closed <p>x</p>"), (8, "<div><div><div><p>Words in a few boxes, as they are.")]
    df = spark.createDataFrame([(i, "u", h, "clash") for i, h in rows], "page_id long, url string, html string, n_chars string")
    got = {r.page_id: r.text for r in dt.extract(df).collect()}
    assert got[1] == "Head & more\nFirst line here.\nSecond café <x>."
    assert got[2] == got[3] == got[7] == "" and got[4] == "plain words only" and len(got[5]) == 16 * 20_000 - 1 and isinstance(got[6], str) and got[8] == "Words in a few boxes, as they are."
    assert dt.extract(df.limit(0)).count() == 0 and dt.extract(df).filter(F.col("page_id") == 1).count() == 2


def test_end_tags_without_elements_cost_nothing():
    import time

    def took(n):
        began = time.process_time()
        dt.Page("<div>" * n + "</p>" * n + "<h1>" * n + "<li>" * n + "x")
        return time.process_time() - began

    took(2000)
    assert took(32_000) < 40 * max(took(2000), 0.01)


def test_what_hides_ends_with_what_holds_it():
    page = "<html><body><article><ul><li>One thing<button>Hide</li><li>Two things here</li></ul><p>Three <button>x</button> things.</p><div><select><option>a</div><p>Four things.</p></article></body></html>"
    assert [t for t in dt.Page(page).text if t] == ["One thing", "Two things here", "Three things.", "Four things."]
