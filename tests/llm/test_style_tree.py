import html as entities
import math
import re
from collections import defaultdict

from tidemark.llm import style_tree as st
from tidemark.llm.data import table
from tidemark.llm.html_dom import Block, read

SF = "/root/testdata/sf0.001"


def test_texts_of_the_pages(spark):
    """The test pages have one article of headings and paragraphs; read here by cutting at tags."""
    pages = table(spark, SF, "pages")
    got = {r["page_id"]: r for r in st.op1_style_tree(spark, SF).collect()}
    assert len(got) == pages.count()
    for r in pages.collect():
        body = re.search(r"<article>(.*)</article>", r["html"], re.S)[1]
        blocks = [" ".join(entities.unescape(re.sub(r"</?b>", "", b)).split()) for b in re.split(r"</?(?:p|h1|br)>", body)]
        assert got[r["page_id"]]["text"] == " ".join(b for b in blocks if b), r["html"][:2000]
        assert got[r["page_id"]]["n_chars"] == len(got[r["page_id"]]["text"])


def test_reading():
    t = st.main_text
    assert t(None) == t("") == t("<p></p>") == ""
    assert t("a<b>b</b>c <i>d</i>\n e") == "abc d e"
    assert t("<p>one<p>two<br>three</p>four&nbsp;&lt;x&gt; &#233;") == "one two three four <x> é"
    assert t("<script>if (a<b) '</p>'</script>x<style>p{}</style><!-- <p>no</p> -->y") == "xy"
    assert t("<p>kept<script>never closed <p>no") == "kept"
    assert t("<title>T</title><nav>menu</nav><header>top</header><main><h1>H</h1><div class='side-bar ads'>ad</div><p>text</main><footer>f</footer>") == "H text"
    assert t("<article><p>art</p><section class=comments><p>hi</p></section><form><p>q</p></form></article><p>out</p>") == "art"
    assert t("<article class='post comment-open'><p>art</article>") == "art"
    assert t("<article>a<article class=comment>b</article></article>") == "a" and t("<div hidden>x</div>y<p style='display: none'>z") == "y"
    assert t("1 < 2 & 3 > 2 <a href=\"x>y\">link</a> <a title='un>closed>z") == "1 < 2 & 3 > 2 link closed>z"
    assert t("<ul><li>a<li>b</ul><table><tr><td>c<td>d</table>") == "a b c d"
    assert len(t("<p>" + "w " * 300_000)) == 599_999
    assert t("<div>" * 3000 + "deep") == "deep"


def test_names_of_wrappers_do_not_take_the_article():
    t = st.main_text
    for name in ("content no-sidebar", "has-sidebar", "elementor-widget-container", "with-header", "widget", "sidebar"):
        assert t(f"<div class='{name}'><article><h1>H</h1><p>text</article></div><div class=ad>buy</div>") == "H text", name
        assert t(f"<div class='{name}'><p>a long text of the page</div><div class=ad>buy</div>") == "a long text of the page", name
    assert t("<article><div class=entry-header><h1>H</h1></div><div class=header>sub</div><p>text</article>") == "H sub text"
    assert t("<article><div class=elementor-widget-container><p>one</div><div class='elementor-widget-container'><p>two</div></article>") == "one two"
    assert t("<div class=widget>a</div><div class=promo>b</div>") == "a b"
    assert t("<p>text</p><div class=comments>much longer words of many readers</div>") == "text"
    assert t("<div class=sidebar><article>art</article><div class=ad>ad</div></div>") == "art"
    assert t("<article>post</article><div class=comments><article>reader</article></div><div class=related><article>another</article></div>") == "post"
    assert t("<div class=widget><article>the post</article><div class=related><article>other</article></div></div>") == "the post"
    assert t("<p>kept <span class=ad>ad</span> here</p><div class='widget-area'>w</div><nav>n</nav>") == "kept here"


def brute(pages, least=st.LEAST):
    """Importance by the formulas, of one host's pages."""
    node_pages, shapes, texts, parent = defaultdict(int), defaultdict(lambda: defaultdict(int)), defaultdict(lambda: defaultdict(int)), {}
    for p in pages:
        seen = st.observed(p)
        for node, kind, feature in seen:
            if kind == st.PAGE:
                node_pages[node] += 1
            elif kind == st.SHAPE:
                shapes[node][feature] += 1
            elif kind == st.TEXT:
                texts[node][feature] += 1
            else:
                parent[node] = feature
    out = {}
    for node, m in node_pages.items():
        total = sum(shapes[node].values())
        shape = -sum(c / total * math.log(c / total) for c in shapes[node].values()) if total else 0
        count = sum(texts[node].values())
        text = 1 - sum(c * math.log(c) for c in texts[node].values()) / count / math.log(m) if count and m > 1 else 0
        out[node] = 1.0 if m <= 1 else max(shape / math.log(m), text)
    low = {n for n, v in out.items() if n and node_pages[n] >= st.PAGES and v < least}
    while True:
        saved = {parent[n] for n in out if n not in low} & low
        if not saved:
            return out, low
        low -= saved


def site():
    pages = []
    for i in range(9):
        pages.append(f"<body><div class=box><p>Same line on every page</p><ul><li>One<li>Two</ul></div><div class=story><p>Story {i} differs</p><p>and again {i * i}</p></div><div class=end>The end</div></body>")
    return pages


def test_importance_and_removal(spark):
    rows = [(i, "http://a.example/" + str(i), h, "x") for i, h in enumerate(site())] + [(20, "http://b.example/", site()[0], "x"), (21, None, None, "x"), (0, "http://a.example/0", site()[0], "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    base = pages.select(st.host(st.F.col("url")).alias("host"), "html")
    want, low = brute([h for h in site()] + [site()[0]])
    got = {r["node"]: r["importance"] for r in st.importance(base).filter("host = 'a.example'").collect() if r["node"]}
    want.pop(0, None)
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=1e-9) for k in got)
    low_rows = st.low_branches(base).filter("host = 'a.example'").collect()
    assert {r["node"] for r in low_rows if not r["poor"]} == low
    assert {r["node"] for r in low_rows if r["poor"]} == brute([*site(), site()[0]], st.POOR)[1]
    texts = sorted((r["page_id"], r["text"]) for r in st.extracted(pages).collect())
    assert texts[0] == texts[1] == (0, "Story 0 differs and again 0") and texts[3] == (2, "Story 2 differs and again 4")
    assert texts[-2][1].startswith("Same line") and texts[-1] == (21, "")
    assert st.extracted(pages.limit(0)).count() == 0


def test_blocks_keep_page_order():
    assert [x.text for x in read("<div>a<p>b</p>c<div>d</div>e</div>") if isinstance(x, Block)] == list("abcde")


def plain_site(i):
    """A page without article elements or telling names: a menu, one of three adverts, the story, the end."""
    advert = ["Buy a boat", "Rent a van", "Sell the farm"][i % 3]
    story = "".join(f"<p>Paragraph {j} of story {i}, told {i * 31 + j} times.</p>" for j in range(1 + i % 4))
    text = " ".join([f"Title {i}", *(f"Paragraph {j} of story {i}, told {i * 31 + j} times." for j in range(1 + i % 4))])
    return f"<html><body><div><ul><li><a href=/>Home</a><li><a href=/x>About us</a></ul></div><div>{advert}</div><div><h1>Title {i}</h1>{story}</div><div>All rights kept</div></body></html>", text


def test_the_tree_decides_on_pages_without_article_and_names(spark):
    made = [plain_site(i) for i in range(40)]
    pages = spark.createDataFrame([(i, f"http://a.example/{i}", h) for i, (h, _) in enumerate(made)] + [(100 + i, f"http://b.example/{i}", plain_site(i)[0]) for i in range(2)] + [(200, "http://c.example/", made[0][0])], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in st.extracted(pages).collect()}
    for i, (h, text) in enumerate(made):
        assert got[i]["text"] == text and st.main_text(h) != text
        assert got[i]["n_tree"] == 4 and got[i]["n_names"] == 0
    assert [got[100 + i]["text"] for i in range(2)] == [" ".join(x for x in ("Buy a boat", made[0][1]) if x), " ".join(("Rent a van", made[1][1]))]  # two pages: what differs stays
    assert got[200]["text"] == "Home About us Buy a boat " + made[0][1] + " All rights kept"  # one page has no statistics


def test_many_low_nodes_are_joined_by_host_and_salt(spark, monkeypatch):
    pages = spark.createDataFrame([(i, f"http://a.example/{i}", plain_site(i)[0]) for i in range(40)] + [(99, None, None)], "page_id long, url string, html string")
    want = sorted(map(tuple, st.extracted(pages).collect()))
    monkeypatch.setattr(st, "BROADCAST_ROWS", 0)
    assert sorted(map(tuple, st.extracted(pages).collect())) == want


def neutral(page):
    """A test page without telling tags and names."""
    return re.sub(r"<(/?)(?:nav|article|footer)>", r"<\1div>", page).replace('<div class="ad">', "<div>")


def test_the_tree_changes_pages_of_large_hosts(spark):
    """Pages of sf0.1 made neutral: menus, adverts and footers have about 60 texts a host, so that the tree
    tells them on the host of 320 pages, and on one of 133, where most are seen twice, does not yet."""
    pages = table(spark, "/root/testdata/sf0.1", "pages").withColumn("host", st.host(st.F.col("url")))
    large = pages.join(pages.groupBy("host").count().filter("count >= 100"), "host").collect()
    want = {r["page_id"]: st.main_text(r["html"]) for r in large}
    plain = {r["page_id"]: neutral(r["html"]) for r in large}
    docs = spark.createDataFrame([(r["page_id"], r["url"], plain[r["page_id"]]) for r in large], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in st.extracted(docs).collect()}
    changed = sum(got[i] != st.main_text(plain[i]) for i in got) / len(got)
    right = sum(got[i] == want[i] for i in got) / len(got)
    print(f"{len(got)} pages, changed {changed:.3f}, right {right:.3f}")
    assert changed > 0.7 and right > 0.7


def simple_reader(page):
    """Main text of the test pages by cutting at tags, with none of the module's helpers."""
    body = re.search(r"<article>(.*)</article>", page or "", re.S)
    blocks = [" ".join(entities.unescape(re.sub(r"</?b>", "", b)).split()) for b in re.split(r"</?(?:p|h1|br)>", body[1])] if body else []
    return " ".join(b for b in blocks if b)


def test_whole_result_against_simple_reader(spark):
    pages = table(spark, "/root/testdata/sf0.01", "pages")
    want = sorted((r["page_id"], r["url"], simple_reader(r["html"])) for r in pages.collect())
    got = st.op1_style_tree(spark, "/root/testdata/sf0.01").collect()
    assert sorted((r["page_id"], r["url"], r["text"]) for r in got) == want
    assert all(r["n_chars"] == len(r["text"]) for r in got)
