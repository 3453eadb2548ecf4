import html
import itertools
import random
import re
from html.parser import HTMLParser

from ledgerline.llm import wrappers as W


def alone(source):
    root = W.page(source)
    return W.extract(root, W.roles(W.skeleton(root)))


class Plain(HTMLParser):
    """Text of <article>, blocks at p and h1 tags: what the synthetic pages need."""

    def __init__(self):
        super().__init__()
        self.inside, self.blocks, self.open = False, [], []

    def cut(self):
        line = " ".join("".join(self.open).split())
        self.open = []
        if line:
            self.blocks.append(line)

    def handle_starttag(self, tag, attrs):
        self.inside = self.inside or tag == "article"
        if tag in ("p", "h1", "article"):
            self.cut()
        if tag == "br":
            self.open.append(" ")

    def handle_endtag(self, tag):
        if tag in ("p", "h1", "article"):
            self.cut()
        if tag == "article":
            self.inside = False

    def handle_data(self, data):
        if self.inside:
            self.open.append(data)


def test_table_equals_plain_parser(spark, sf):
    for r in W.op2_wrappers(spark, sf).join(spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "html"), "page_id").collect():
        p = Plain()
        p.feed(r.html)
        p.close()
        p.cut()
        assert r.text == "\n".join(p.blocks) and r.n_chars == len(r.text), r.page_id


ARTICLE = "<h2>Title &amp; more</h2><p>First <b>bold</b>\n para<a href='/x?id=1'>graph</a>.<p>Second&nbsp; &lt;one&gt;<ul><li>a<li>b</ul>"
WANT = "Title & more\nFirst bold paragraph.\nSecond <one>\na\nb"


def test_furniture_goes():
    around = {
        "article": "<header><h1>Site</h1></header><nav>menu</nav><article>{}<div class='share-buttons'>share</div><div id=comments><article class='comment'><p>nice</article></div></article><aside>side</aside><footer>foot</footer>",
        "main": "<div class='cookie-notice'>we use cookies</div><main>{}<form><label>mail</label><input></form></main><div class=sidebar>side</div>",
        "named": "<div class='top-nav'><a href=/>home</a></div><div id='post-12' class='entry-content'>{}<div class='ad'>buy</div></div><ol class='commentlist'><li>me too</ol>",
        "layout": "<div class='with-sidebar'><article>{}</article><div class='related'>more</div></div>",
        "role": "<div role='banner'>site</div><div role='main'>{}</div><div role=contentinfo>foot</div>",
        "hidden": "<article><div hidden>x</div><div style='display: none'>y</div>{}<script>var a='<p>no</p>';</script><style>p{{}}</style><!-- <p>no</p> --><noscript>no</noscript></article>",
    }
    for name, page in around.items():
        source = "<!DOCTYPE html><html><head><title>T</title><meta charset=utf-8></head><body class='no-sidebar'>" + page.format(ARTICLE) + "</body></html>"
        assert alone(source) == WANT, name


def test_odd_pages():
    assert alone(None) == alone("") == alone("   ") == ""
    assert alone("<article>a < b & c &notanentity; <unclosed") == "a < b & c &notanentity;" or alone("<article>a < b") == "a < b"
    assert alone("<article><p>x" + "<div>" * 300 + "deep" + "</div>" * 300 + "</article>") == "x\ndeep"
    assert alone("<p>no container</p><p>two</p>") == "no container\ntwo"
    assert alone("<article>" + "<p>w</p>" * 5000 + "</article>").count("\n") == 4999
    assert alone("<article><table><tr><td>a<td>b<tr><td>c</table>x<hr>y</article>") == "a\nb\nc\nx\ny"


def test_wrapper_is_union_free_and_order_free():
    pages = [f"<article><h1>t{i}</h1>" + "<p>x</p>" * i + ("<figure>f</figure>" if i % 2 else "") + "<dl>" + "<dt>k<dd>v" * (i + 2) + "</dl></article>" for i in range(5)]
    trees = [W.skeleton(W.page(p)) for p in pages]
    whole = trees[0]
    for t in trees[1:]:
        whole = W.merge(whole, t)
    (art,) = whole[W.CHILDREN]
    assert [(n[W.NAME], n[W.OPTIONAL], n[W.REPEATED]) for n in art[W.CHILDREN]] == [("h1", False, False), ("p", True, True), ("figure", True, False), ("dl", False, False)]
    (group,) = art[W.CHILDREN][3][W.CHILDREN]
    assert group[W.NAME] == W.GROUP and group[W.REPEATED] and [n[W.NAME] for n in group[W.CHILDREN]] == ["dt", "dd"]
    other = W.merge(W.merge(trees[4], trees[3]), W.merge(W.merge(trees[2], trees[1]), trees[0]))
    shape = lambda n: (n[0], n[1], n[2], n[3], [shape(c) for c in n[7]])
    assert shape(other) == shape(whole)


def test_unnamed_hosts_by_statistics(spark, monkeypatch):
    monkeypatch.setattr(W, "MERGE", 2)
    page = "<div class=x1><a href=/>Home</a><a href=/b>About</a></div><div class=x2><p>Unique text {0} of page {0}.</p><p>More {0}</p></div><div class=x3>All rights reserved by us</div>"
    rows = [(i, "http://plain.example/" + str(i), page.format(i), "h", 1) for i in range(40)]
    rows += [(100, None, None, "h", 1), (101, "not a url", "<article><p>x</p></article>", "h", 1), (102, "http://plain.example/odd", "<article>odd one</article>", "h", 1), (0, "http://plain.example/0", page.format(0), "h", 1), (None, "http://a.example", "", "h", 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string, wrapper int").repartition(9)
    got = W.texts(df).collect()
    by = {r.page_id: r for r in got}
    assert len(got) == len(rows)
    assert all(by[i].text == f"Unique text {i} of page {i}.\nMore {i}" for i in range(40))
    assert by[100].text == "" and by[101].text == "x" and by[102].text == "odd one" and by[None].n_chars == 0
    monkeypatch.setattr(W, "BROADCAST_BYTES", 0)
    assert sorted(map(repr, W.texts(df).collect())) == sorted(map(repr, got))
    assert W.texts(df.limit(0)).count() == 0


def test_pages_of_any_depth(spark):
    for tag in ("div", "figure", "span class=lead", "b"):
        deep = "<article><p>x</p>" + f"<{tag}>" * 100_000 + "<p>deep</p>" + f"</{tag.split()[0]}>" * 100_000 + "<p>y</p></article>"
        assert alone(deep) == "x\ndeep\ny", tag
    assert alone("<article>" + "<div><i></section>" * 50_000 + "z") == "z"
    rows = [(i, "http://deep.example/", "<article>" + "<div>" * 20_000 + f"deep {i}") for i in range(3)]
    for r in W.texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect():
        assert r.text == f"deep {r.page_id}"


def plain_common(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_longest_common_subsequence(monkeypatch):
    rng = random.Random(1)
    for bits in (1 << 28, 40):
        monkeypatch.setattr(W, "TABLE_BITS", bits)
        for _ in range(300):
            a, b = ([rng.choice("abcde") for _ in range(rng.randrange(25))] for _ in range(2))
            found = W.common(a, b)
            assert all(a[i] == b[j] for i, j in found) and len(found) == plain_common(a, b)
            assert all(i < k and j < m for (i, j), (k, m) in itertools.pairwise(found))
    a, b = ([rng.choice("abcdefgh") for _ in range(3000)] for _ in range(2))  # 9 million cells
    whole = len(W.common(a, b))
    monkeypatch.setattr(W, "TABLE_BITS", 1 << 28)
    assert whole == len(W.common(a, b))


def test_trees_are_written_flat():
    tree = W.skeleton(W.page("<ul><li>a<li>b</ul><p>c<p>d<table><tr><td>x</table>"))
    assert W.load(W.dump(tree)) == tree


def test_generated_names_keep_the_wrapper_bounded(spark, monkeypatch):
    """A host whose elements have new class names on each page: the wrapper stops growing, and every page is still read whole."""
    monkeypatch.setattr(W, "WIDE", 20)
    page = "<div class='top-nav'><a href=/>home</a></div>" + "".join("<section class='c{0}k%d'><p>Part %d of page {0}</p></section><div class='ad x{0}y%d'>buy</div>" % (k, k, k) for k in range(15))
    trees = [W.skeleton(W.page(page.format(i))) for i in range(60)]
    sizes, whole = [], trees[0]
    for t in trees[1:]:
        whole = W.merge(whole, t)
        sizes.append(len(W.dump(whole)))
    assert sizes[-1] < 2 * sizes[5]
    rows = [(i, "http://gen.example/", page.format(i)) for i in range(60)]
    for r in W.texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect():
        assert r.text == "\n".join(f"Part {k} of page {r.page_id}" for k in range(15))


def test_unnamed_articles_with_optional_parts(spark):
    """Nothing names the article: constant and link-heavy parts go, optional and repeated prose stays."""
    rows, want = [], {}
    for i in range(30):
        lead = f"<div class=k4><span class=k9>Summary {i}</span></div>" if i % 3 else ""
        prose = "".join(f"<div class=k5>Paragraph {k} of text {i}.</div>" for k in range(1 + i % 4))
        links = "".join(f"<li><a href=/{k}>Other story {i + k}</a></li>" for k in range(3))
        rows.append((i, "https://user@Plain.Example:8080/x", f"<body><div class=k1><a href=/>Start</a> <a href=/all>All</a></div><div class=k2>{lead}{prose}</div><div class=k3><ul>{links}</ul></div><div class=k6>Made with care</div></body>"))
        want[i] = "\n".join([f"Summary {i}"] * (i % 3 > 0) + [f"Paragraph {k} of text {i}." for k in range(1 + i % 4)])
    got = {r.page_id: r.text for r in W.texts(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(7)).collect()}
    assert got == want


def test_entities_are_decoded_once():
    assert alone("<article>&amp;lt; &#233;&#x4e16;&copy</article>") == html.unescape("&lt;").replace("<", "&lt;") + " é世©"
    assert re.search("é", alone("<article>&eacute;</article>"))


def test_late_class_names_tell_roles():
    source = '<div class="page"><div class="row mt-3 px-2 mb-4 entry-content"><p>Long text of the story.</p><div class="m-4 p-2 border rounded advert">Buy now</div><p>More of it.</p></div><div>Other</div></div>'
    assert alone(source) == "Long text of the story.\nMore of it."
    many = W.signature("div", ' class="a1 b2 c3 d4 e5 f6 advert sidebar"')
    assert many == W.signature("div", ' class="advert sidebar a1 b2 c3 d4"') and W.signature("div", ' class="b a d c"') == "div.a.b.c.d"
