import html
import re

import numpy as np
import pytest
from nightjar.llm import html_model, one_bit_search
from pyspark.sql import functions as F

PAGES = "page_id long, url string, html string, text string, n_chars string"


def plain_article(page):
    """What the pages of the test tables hold between their article tags, block by block."""
    article = re.search(r"<article>(.*?)</article>", page, re.S)
    blocks = re.split(r"</?(?:p|h1)>", article[1]) if article else []
    texts = (" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in blocks)
    return "\n\n".join(t for t in texts if t)


def test_held_out_pages_are_extracted_exactly(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    weights = html_model.train(pages.where("page_id % 2 = 0"))
    held_out = pages.where("page_id % 2 = 1")
    truth = {r["page_id"]: plain_article(r["html"]) for r in held_out.collect()}
    got = {r["page_id"]: r["text"] for r in html_model.extract(held_out, weights=weights).collect()}
    assert got == truth and all(truth.values())


def test_unnamed_parts_of_held_out_pages(spark):
    """Without the naming tags the model has to go by links, lengths and structure."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    weights = html_model.train(pages.where("page_id % 2 = 0"))
    right = total = 0
    for r in pages.where("page_id % 2 = 1").limit(60).collect():
        bare = re.sub(r"<(/?)(?:article|nav|footer)\b", r"<\1section", r["html"])
        tree = html_model.parse(bare)
        belief = html_model.marginals(tree, weights)
        want = plain_article(r["html"])
        for text, b in zip(tree.text, belief, strict=True):
            if text and text.strip():
                right += (b >= 0) == (" ".join(text.split()) in want)
                total += 1
    assert right / total > 0.8


def enumerate_marginals(tree, weights):
    """Log-odds by adding up all joint states."""
    naming, other, kin = html_model.features(tree)
    n = len(tree.tag)
    vote = [1.0] * n
    for i in range(1, n):
        vote[i] = vote[tree.parent[i]] / kin[i]
    unary = [sum(weights.get(f, 0) for f in naming[i]) + vote[i] * sum(weights.get(f, 0) for f in other[i]) for i in range(n)]
    score = np.zeros((n, 2))
    for state in range(2**n):
        bits = [(state >> i) & 1 for i in range(n)]
        logp = sum(u for u, b in zip(unary, bits, strict=True) if b)
        for i in range(1, n):
            kind = html_model.edge_kind(tree, i, naming[i])
            most, up = html_model.COUPLING[kind], bits[tree.parent[i]]
            odds = max(-most, min(most, weights.get(f"edge:{kind}:{up}", most if up else -most)))
            logp += (odds if bits[i] else 0) - np.log1p(np.exp(odds))
        for i in range(n):
            score[i, bits[i]] += np.exp(logp)
    return np.log(score[:, 1] / score[:, 0])


def test_messages_give_exact_marginals():
    page = "<body><div class=ad>x</div><article><p>some words here<a href=q>link</a></p><p>more</p></article></body>"
    tree, weights = html_model.parse(page), html_model.fit(html_model.observe(page))
    assert np.allclose(html_model.marginals(tree, weights), enumerate_marginals(tree, weights))


SITE = """<!doctype html><html><head><title>T</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body><header><h1>Site</h1></header><ul class="menu"><li><a href=x>A</a><li><a href=y>B</a></ul>
<main><article><h1>Head &amp; line</h1><p>One &lt;b&gt; two<br>three <b>bold</b>&nbsp;text<!-- no --></p><ul><li>item one<li>item two</ul><div class="ad">Buy!</div><aside>Side note</aside><p>Last.
<blockquote>Quote   here</blockquote><form><input> Your mail <button>Go</button></form><section class="comments"><h2>Comments</h2>""" + "<p>I think that this is a fairly long comment by some reader, isn't it?</p>" * 30 + """</section></article></main>
<div class="cookie-notice"><p>We use cookies to improve your experience.</p></div><div class="sidebar"><p>About the author and so on.</p></div><footer>&copy; me</footer></body></html>"""


def test_other_parts_go_whatever_their_number(spark):
    weights = html_model.train(spark.read.parquet("/root/testdata/sf0.001/pages.parquet"))
    assert html_model.main_text(SITE, weights) == "Head & line\n\nOne <b> two three bold text\n\nitem one\n\nitem two\n\nLast.\n\nQuote here"


def test_pages_take_edge_rows(spark):
    long = "<article>" + "<p>word and word</p>" * 20_000 + "</article>"
    rows = [(1, "u", None, "t", "n"), (2, "u", "", "t", "n"), (3, None, "<p><p></div></p>< a <b", "t", "n"), (None, "u", SITE, "t", "n"), (5, "u", SITE, "t", "n"), (5, "u", SITE, "t", "n"), (6, "u", long, "t", "n")]
    out = {(r["page_id"]): r for r in html_model.extract(spark.createDataFrame(rows, PAGES)).collect()}
    assert out[1]["text"] == "" and out[2]["n_chars"] == 0 and out[5]["text"] == out[None]["text"] and out[6]["text"].count("\n\n") == 19_999
    assert html_model.extract(spark.createDataFrame([], PAGES)).count() == 0


# ------------------------------------------------------------------------------------------------ vectors
VECTORS = "vec_id long, embedding array<float>, score string, rank string"


def brute_nearest(rows, k):
    good = [(i, np.array(v, dtype=np.float32).astype(float)) for i, v in dict.fromkeys((i, tuple(v) if v is not None else None) for i, v in rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, q in good:
        if i % 20 == 0:
            scored = sorted(((-float(q @ v), j) for j, v in good if j != i and len(v) == len(q)))
            out[i] = scored[:k]
    return out


@pytest.mark.parametrize("copies", [0, 500])
def test_neighbours_against_brute_force(spark, monkeypatch, copies):
    monkeypatch.setattr(one_bit_search, "CANDIDATE_BLOCK", 200)
    monkeypatch.setattr(one_bit_search, "QUERY_BLOCK", 16)
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((10, 48))
    rows = [(i, (centres[i % 10] + rng.standard_normal(48) * rng.uniform(0.1, 2)).round(3).tolist()) for i in range(800)]
    rows += [(10_000 + i, rows[40][1]) for i in range(copies)]
    got = one_bit_search.nearest(spark.createDataFrame([(*r, "s", "r") for r in rows], VECTORS), F.col("vec_id") % 20 == 0).collect()
    want, hits, total = brute_nearest(rows, 20), 0, 0
    for q, scored in want.items():
        own = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert [o[0] for o in own] == list(range(1, len(scored) + 1))
        hits += len({o[1] for o in own} & {j for _, j in scored})
        total += len(scored)
    assert hits / total >= 0.99


def test_bounds_choose_few_pairs():
    rng = np.random.default_rng(5)
    vectors = rng.standard_normal((4_000, 64)) + 3 * rng.standard_normal((20, 64))[rng.integers(0, 20, 4_000)]
    turn = one_bit_search.rotation(64, 256, 8)
    assert np.allclose(turn @ turn.T, np.eye(64))
    packed, norms, align = one_bit_search.encode_vectors(vectors, turn)
    ids = np.arange(4_000)
    found, scored = one_bit_search.search_block(ids[::20], vectors[::20], ids, vectors, packed, norms, align, turn, 20, 3.0)
    assert scored < 0.05 * 200 * 4_000 and len(found) == 200 * 20


def test_vectors_take_edge_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (1, None), (2, []), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [1.0, 2.0]), (8, [1.0, 2.0]), (9, [1.0, 2.0, 3.0]), (20, [1.0, 1.0, 1.0]), (None, [1.0, 2.0])]
    got = one_bit_search.nearest(spark.createDataFrame([(*r, "s", "r") for r in rows], VECTORS), F.col("vec_id") % 20 == 0).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == [(0, 1, 7, 5.0), (0, 2, 8, 5.0), (20, 1, 9, 6.0)]
    assert one_bit_search.nearest(spark.createDataFrame([], VECTORS), F.col("vec_id") % 20 == 0).count() == 0
