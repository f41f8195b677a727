"""Main text: the reader against hand-made pages, trees and decoding against brute force, extraction against known texts."""

import collections
import html
import itertools
import random
import re

import numpy as np
import pytest

from faultline.llm import boosting, dom, main_text, queries

FOLDER = "/root/testdata/sf0.01"


def everything(text):
    page = dom.Page(text)
    return main_text.text_of(page, np.ones(len(page.nodes), bool))


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""), ("", ""), ("plain &amp; simple", "plain & simple"), ("a < b <c", "a < b"), ("&am &notit; &#x41;&eacute;", "&am ¬it; Aé"),
        ("<p>one<p>two</p>three", "one two three"), ("<p>a<b>b</b>c <i> d</i><br>e", "abc d e"), ("a<!-- <p>no</p> -->b<!x>c<?y>d</>e", "abcde"),
        ("<script>var t='</p>';</script>x<STYLE>p{}</style >y", "xy"), ("x<script>never ends", "x"), ("x<select><option>a<option>b</select>y", "xy"),
        ("x<button>kept, for it has no end", "xkept, for it has no end"), ("<title>t</title>x<textarea></p>no</textarea>", "x"),
        ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>e", "a b c d e"), ("<table><tr><td>a<td>b<tr><td>c</table>d", "a b c d"),
        ("<p class=\"a>b\" title='>'>x</p>", "x"), ("<p class=unclosed\">x", "x"), ("<p class=\"never", ""), ("</p></div>x</article>", "x"),
        ("a  \n b<hr>c", "a b c"), ("<!-->x<!--->y<!-- z", "xy"), ("<dl><dt>a<dd>b<dt>c</dl>", "a b c"),
    ],
)
def test_reader(page, text):
    assert everything(page) == text


def test_reader_bears_anything():
    rng = random.Random(1)
    bits = ["<", ">", "</", "<p", "<p>", "</p>", "<!--", "-->", "<!", "<![CDATA[", "]]>", "&", "&#", "&#xD800;", "'", '"', "=", " class=", "<a href=", "<script", "</script>", "x", " ", "<li>", "</ul>", "<td>", "<x-y>", "\x00", "é"]
    for _ in range(3000):
        page = dom.Page("".join(rng.choices(bits, k=rng.randint(0, 25))))
        assert all(-1 <= node.parent < i for i, node in enumerate(page.nodes))
        assert all(page.nodes[run.leaf].tag == "#text" for run in page.runs)


def test_deep_and_long_pages():
    deep = "<div>" * 20_000 + "x" + "</div>" * 20_000
    assert everything(deep) == "x"
    assert everything("<b>" * 50_000 + "<p>y" * 50_000) == " ".join("y" * 50_000)
    assert everything("<select>" * 20_000 + "z") == "z"
    assert len(main_text.nodes_of([dom.Page(deep)]).parent) == 20_002


def test_trees_lower_the_loss():
    rng = np.random.default_rng(0)
    rows = rng.normal(size=(3000, 5))
    labels = ((rows[:, 0] > 0.3) ^ (rows[:, 3] < -0.2)).astype(float)
    trees = boosting.fit(rows[:2000], labels[:2000], np.ones(2000), trees=40, depth=3)
    assert (((trees.scores(rows[2000:]) > 0) == labels[2000:]).mean()) > 0.97
    # One tree of one cut: the best of all cuts between bins, by brute force.
    one = boosting.fit(rows, labels, np.ones(3000), trees=1, depth=1, bins=16)
    p = labels.mean()
    slope, bend = p - labels, np.full(3000, p * (1 - p))

    def gain(f, cut):
        right = rows[:, f] > cut
        parts = [(slope[s].sum(), bend[s].sum()) for s in (right, ~right, right | True)]
        (a, b), (c, d), (e, g) = parts
        return a * a / (b + 1) + c * c / (d + 1) - e * e / (g + 1)

    cuts = [np.quantile(rows[:, f], np.linspace(0, 1, 17)[1:-1]) for f in range(5)]
    assert gain(one.feature[0][0], one.cut[0][0]) == pytest.approx(max(gain(f, c) for f in range(5) for c in cuts[f]))


def test_choice_is_the_best_of_all():
    rng = np.random.default_rng(2)
    for _ in range(60):
        n = int(rng.integers(1, 11))
        parent = np.array([-1, *(int(rng.integers(0, i)) for i in range(1, n))])
        depth = np.zeros(n, int)
        for i in range(1, n):
            depth[i] = depth[parent[i]] + 1
        scores = rng.normal(size=n)
        nodes = main_text.Nodes(np.zeros(n, int), parent, depth, [], np.ones((n, 9)), np.zeros(n), np.zeros(n, bool))
        best = max(
            (sum(s for s, t in zip(scores, taken, strict=True) if t), taken)
            for taken in itertools.product([False, True], repeat=n)
            if all(not taken[i] or parent[i] < 0 or taken[parent[i]] for i in range(n))
        )
        assert main_text.chosen(nodes, scores).tolist() == list(best[1])


def test_features_are_figures_of_the_tree():
    page = dom.Page("<div class='sideBar'><p>Two words.<p><a href=x>link</a> 12</div>tail")
    nodes = main_text.nodes_of([page])
    odds = {"sidebar": -2.0, "<p>": 1.0}
    rows = main_text.features(nodes, odds, {})
    tags = [n.tag for n in page.nodes]
    assert tags == ["#root", "div", "p", "#text", "p", "#text", "#text"]
    assert rows[:, 0].tolist() == np.log1p([9 + 6 + 4, 15, 9, 9, 6, 6, 4]).tolist()
    assert rows[:, 2].tolist() == [4 / 19, 4 / 15, 0, 0, 4 / 6, 4 / 6, 0]
    assert rows[:, 23].tolist() == [0, -2, 0, 0, 0, 0, 0] and rows[:, 26].tolist() == [0, -2, -2, -2, -2, -2, 0]
    assert rows[:, 7].tolist() == [1, 15 / 19, 9 / 19, 9 / 19, 6 / 19, 6 / 19, 4 / 19]


def article(page):
    """The text of the only article, read with regular expressions."""
    inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    blocks = [re.sub(r"</?b>", "", b).replace("<br>", " ") for b in re.split(r"</?(?:p|h1)>", inner)]
    return " ".join(x for x in (" ".join(html.unescape(b).split()) for b in blocks) if x)


def test_query_finds_the_articles(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{FOLDER}/pages.parquet").collect()}
    got = queries.op13_main_text(spark, FOLDER)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    rows = got.collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert r.text == article(pages[r.page_id].html) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


def test_other_layouts(spark):
    """Pages of structures that were drawn with another seed and hold texts that were not learned from."""
    pages = [r.html for r in spark.read.parquet(f"{FOLDER}/pages.parquet").orderBy("page_id").collect()]
    model = main_text.fit(pages[:120])
    rest = " ".join(pages[120:])
    long, short = re.findall(r"<p>([^<]{100,})</p>", rest), re.findall(r"<a href[^>]*>([^<]+)</a>", rest)
    rng, total = random.Random(77), np.zeros(3)
    for _ in range(200):
        source = main_text.layout(rng, long, short)
        page = dom.Page(source)
        inside = np.zeros(len(page.nodes), bool)
        inside[[run.leaf for run in page.runs if main_text._MARK in run.text]] = True
        want = main_text.text_of(page, inside).replace(main_text._MARK, "")
        got = main_text.main_texts([source.replace(main_text._MARK, "")], *model, {})[0]
        a, b = collections.Counter(got.split()), collections.Counter(want.split())
        total += sum((a & b).values()), sum(a.values()), sum(b.values())
    assert total[0] / total[1] > 0.97 and total[0] / total[2] > 0.97


def test_edges(spark):
    long = "<nav><a href=x>menu</a></nav><article><h1>T</h1>" + "<p>Some words, and more of them.</p>" * 20_000 + "</article><footer>end</footer>"
    rows = [(1, "u", None), (2, None, ""), (3, "u", "<nav><a href=x>a</a></nav>"), (4, "u", long), (4, "u", long), (None, "u", "<article><p>Only this, but a whole sentence.</p></article>")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS text", "2 AS n_chars", "3 AS odds")
    got = main_text.extract(frame, main_text.learn(spark.read.parquet(f"{FOLDER}/pages.parquet")))
    assert got.columns == ["page_id", "url", "odds", "text", "n_chars"]
    found = collections.Counter((r.page_id, r.text, r.n_chars) for r in got.collect())
    want = "T " + " ".join(["Some words, and more of them."] * 20_000)
    assert found[4, want, len(want)] == 2 and found[1, "", 0] == found[2, "", 0] == found[3, "", 0] == 1
    assert found[None, "Only this, but a whole sentence.", 32] == 1
    # Learning from hardly any text gives some classifier.
    assert main_text.extract(frame, main_text.learn(frame, layouts=100)).count() == len(rows)
    none = frame.limit(0)
    assert main_text.extract(none, main_text.learn(none, layouts=100)).count() == 0
