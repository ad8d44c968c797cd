import html as _html
import random
import re
import time

from lodestone.llm import htmlmain
from tests.llm.helpers import rows, table


def brute_article(page):
    """The fixtures' pages all have one article of headings and paragraphs."""
    inside = re.search(r"<article>(.*)</article>", page, re.S)[1]
    return " ".join(_html.unescape(re.sub(r"</?b>", "", re.sub(r"<(?!/?b>)[^>]*>", "\n", inside))).split())


def test_articles_of_all_pages(spark):
    pages = table(spark, "pages", "sf0.01")
    want = {r["page_id"]: brute_article(r["html"]) for r in pages.collect()}
    got = htmlmain.main_texts(pages).collect()
    assert {r["page_id"]: r["text"] for r in got} == want
    assert all(r["n_chars"] == len(r["text"]) for r in got)


def test_structure():
    page = """<html><head><title>T</title></head><body class="has-sidebar"><header><h1>Site</h1></header>
    <nav><a href=x>Menu</a></nav><div class="cookie-notice">We use cookies</div>
    <main><article class="post comments-open"><header class="entry-header"><h1>Head &amp; line</h1></header>
    <p>First <b>bo</b>ld&nbsp;text<br>more.<p>Second &lt;tag&gt;.<ul><li>One<li>Two</ul><aside>Aside</aside>
    <div class="ad-slot">Buy</div><form>Name <input></form><script>var x = "</p>";</script><style>p{}</style><!-- gone -->
    <table><tr><td>a<td>b</table></article><section id="comments"><article class="comment"><p>Nice!</p></article></section></main>
    <div class="sidebar">Links</div><footer>&copy;</footer></body></html>"""
    assert htmlmain.main_text(page) == "Head & line First bold text more. Second <tag>. One Two a b"
    page = """<body><div class="topbar">Top</div><div class="page"><div class="post-header"><h1>T</h1></div><div id="content"><h2>H</h2><p>Body.</p>
    <div class="share-buttons">Share</div></div><ul class="comment-list"><li>Hi</li></ul><div class="notice notice-info">N</div></div></body>"""
    assert htmlmain.main_text(page) == "T H Body."
    assert htmlmain.main_text(None) == htmlmain.main_text("") == htmlmain.main_text("<p hidden>x</p>") == ""
    assert htmlmain.main_text("plain & text") == "plain & text"
    assert htmlmain.main_text("<body><article><p>One.</p><video src=x><p>Two.</p><select><option>1<p>Three.</article><div>Four</div>") == "One. Two. 1 Three. Four"
    assert htmlmain.main_text("<article><p>a</p><video><p>No video here</p></video><p>b</p></article>") == "a b"
    assert htmlmain.main_text("<div class='legal-news'><p>Real article text</p></div>") == "Real article text"
    assert htmlmain.main_text("a <!-- b --> c <!DOCTYPE x> d <!-- never ends") == "a c d"
    assert htmlmain.main_text("x &#" + "9" * 6000 + "; &#x41; y") == "x \ufffd A y"
    assert htmlmain.main_text('<p title="a > b" class=\'>\'>c</p><p title="open>d</p>') == "c d"
    assert htmlmain.main_text("<p>unclosed <b>tags <i>here<p>a < b > c") == "unclosed tags here a < b > c"


def test_differencing_removes_what_pages_share(spark):
    page = "<body><div>Welcome to our site</div><div>{}</div><p>{}</p><div>All prices include tax</div></body>"
    data = [(i, f"http://x.org/a/{i % 2}/{i}", page.format(f"Story number {i}", f"Words of {i}.")) for i in range(8)]
    data += [(20, "http://alone.org/", page.format("Only", "Page")), (21, None, None), (22, "no url", ""), (22, "no url", "")]
    data += [(30, "http://x.org/z", page.format("Twin", "page")), (31, "http://x.org/z2", page.format("Twin", "page"))]
    got = {r["page_id"]: r["text"] for r in htmlmain.main_texts(spark.createDataFrame(data, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"Story number {i} Words of {i}." for i in range(8))
    assert got[20] == "Welcome to our site Only Page All prices include tax"
    assert got[21] == got[22] == ""
    assert got[30] == got[31] == "Twin page"  # copies are one page, compared with another


def test_empty_and_extra_columns(spark):
    assert htmlmain.main_texts(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    df = spark.createDataFrame([(None, "http://a/b", "<p>x</p>", "k", 1), (1, "http://a/b", "<p>x</p>", "k", 1)], "page_id long, url string, html string, key string, text int")
    assert rows(htmlmain.main_texts(df)) == [(1, "http://a/b", "x", 1), (None, "http://a/b", "x", 1)]


def test_common_lines_match_brute_force():
    rng = random.Random(4)
    for _ in range(500):
        a, b = ([rng.randint(0, 4) for _ in range(rng.randint(0, 9))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        got = htmlmain.common_lines(a, b)
        assert len(got) == best[-1][-1]
        rest = iter(b)
        assert all(a[i] in rest for i in got)


def test_differencing_decides_inside_and_outside_of_articles(spark):
    page = """<body><div>Site of news</div><article><p>{0}</p><div>Share this story</div><div>{1}</div></article><div>{2}</div><div>Read our terms</div></body>"""
    data = [(i, f"http://x.org/{i}", page.format(f"Lead {i}.", f"Inner {i}.", f"Outer text of {i} " * 3)) for i in range(5)]
    # Nothing to compare with: the longer article alone counts, else all lines.
    data += [(10, "http://y.org/", page.format("Lead. " * 20, "Inner.", "Outer")), (11, "http://z.org/", page.format("Teaser.", "", "Outer text. " * 20))]
    got = {r["page_id"]: r["text"] for r in htmlmain.main_texts(spark.createDataFrame(data, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"Lead {i}. Inner {i}. " + (f"Outer text of {i} " * 3).strip() for i in range(5))
    assert got[10] == ("Lead. " * 20) + "Share this story Inner."
    assert got[11].startswith("Site of news Teaser.") and got[11].endswith("Outer text. Read our terms")


def test_share_of_lines_decided_by_differencing(spark):
    """Of pages whose markup says nothing, all lines; of the fixtures', whose markup says everything else, short paragraphs of articles."""
    kinds = lambda pages: [k for p in pages for _, k in htmlmain.lines_of(p)]
    fixtures = [r["html"] for r in table(spark, "pages", "sf0.01").collect()]
    unmarked = [re.sub(r"</?(?:article|nav|footer)>", "", re.sub(r"<li><a [^>]*>([^<]*)</a></li>", r"<div>\1</div>", p)).replace(' class="ad"', "") for p in fixtures]
    share = lambda pages: sum(k in (htmlmain.ASK, htmlmain.OUTSIDE) for k in kinds(pages)) / len(kinds(pages))
    assert share(fixtures) == 0 and share(unmarked) == 1
    paragraphs = sum(k == htmlmain.PARAGRAPH for k in kinds(fixtures)) / len(kinds(fixtures))
    print("put to differencing, of the fixtures' lines:", paragraphs)
    assert paragraphs > 0.2


def test_long_and_hostile_pages_take_linear_time():
    pages = ["<a " * 350_000, "<div>" * 100_000 + "</p>" * 100_000, '<a b="' * 170_000, "<video>" * 150_000, "<!--" * 250_000, "<script>" * 120_000, "&#9" * 300_000, "<select>" * 100_000 + "</select>", "<a b='" * 100_000 + '"' * 100_000]
    for page in pages:
        began = time.process_time()
        htmlmain.main_text(page)
        assert time.process_time() - began < 3, page[:20]
    a = list(range(20_000))
    b = a[:]
    random.Random(1).shuffle(b)
    assert len(htmlmain.common_lines(a, b)) > 200 and htmlmain.common_lines(a, a) == a


def texts(spark, data):
    got = htmlmain.main_texts(spark.createDataFrame(data, "page_id long, url string, html string")).collect()
    return {r["page_id"]: r["text"] for r in got}


def test_notices_inside_of_articles(spark):
    sign_up, quoted = "<p>Sign up for our weekly newsletter and never miss a story</p>", "<p>To be or not to be, that is the question.</p>"
    long = f"<p>{'A long passage that both pages have, word for word. ' * 6}</p>"
    page = "<article><h1>Story {0}</h1><p>" + "Text of number {0}, told at some length. " * 12 + "</p>{1}<h2>Sources</h2></article>"
    data = [(i, f"http://x.org/{i}", page.format(i, sign_up + quoted + long)) for i in range(2)] + [(5, "http://other.org/5", f"<article>{quoted}</article>")]
    # Copies of one article keep what they share.
    data += [(10 + i, f"http://y.org/{i}", f"<article><p>Same story. {'It goes on. ' * 20}</p><p>Short line of it.</p></article><div>{i}</div>") for i in range(2)]
    got = texts(spark, data)
    for i in range(2):
        assert "newsletter" not in got[i] and "To be or not to be" in got[i] and "A long passage" in got[i] and got[i].endswith("Sources") and got[i].startswith(f"Story {i} Text of number {i}")
        assert got[10 + i].endswith("Short line of it.") or "Short line of it." in got[10 + i]
    assert got[5] == "To be or not to be, that is the question."


def test_comments_under_any_name(spark):
    for name in ("user-comments", "post-comments", "comments", "commentBlock", "comment_list", "article-comments", "reply-body"):
        assert htmlmain.main_text(f"<article><p>Body.</p><div class='{name}'><p>Nice!</p></div><p>More.</p></article>") == "Body. More."
        assert htmlmain.main_text(f"<article><p>Body.</p></article><section id='{name}'><article><p>Nice!</p></article></section>") == "Body."
    for name in ("comments-open", "has-comments", "post comments-closed"):
        assert htmlmain.main_text(f"<article class='{name}'><p>Body.</p></article>") == "Body."


def test_wrappers_named_like_boilerplate(spark):
    prose = "<p>" + "These are the words of the page, of which there are a good many. " * 3 + "</p>"
    want = " ".join(("These are the words of the page, of which there are a good many. " * 3).split())
    for before, after in (("<form id='aspnetForm'>", "</form>"), ("<div class='main-banner'>", "</div>"), ("<div class='dialog'>", "</div>"), ("<form><div class='modal'>", "</div></form>"), ("<form><article>", "</article></form>")):
        page = f"<body><nav><a href=x>Menu</a></nav>{before}{prose}<label>Name</label>{after}<footer>Foot</footer></body>"
        assert want in htmlmain.main_text(page) and "Menu" not in htmlmain.main_text(page) and "Foot" not in htmlmain.main_text(page)
    # Beside an article, and comments or sidebars of any length, nothing changes.
    assert htmlmain.main_text(f"<article><p>Short.</p></article><form>{prose}</form>") == "Short."
    for wrap in ("<aside>{}</aside>", "<div class='user-comments'>{}</div>", "<footer>{}</footer>"):
        assert htmlmain.main_text(f"<div>Short text.</div>{wrap.format(prose)}") == "Short text."


def test_pairing_and_deletion_by_hand(spark):
    """Every page of a host with every neighbour by its path, common lines by the table of lengths."""
    rng = random.Random(9)
    shared = [f"Line {i} of the site" for i in range(6)]
    data = []
    for i in range(60):
        host, path = f"h{rng.randrange(4)}.org", "/" + "/".join(rng.choice("abc") for _ in range(rng.randrange(1, 4))) + f"/{i}"
        lines = [*rng.sample(shared, rng.randrange(0, 5)), *(f"Own {i} {k}" for k in range(rng.randrange(0, 3)))]
        rng.shuffle(lines)
        data.append((i, f"http://{host}{path}", "".join(f"<div>{x}</div>" for x in lines)))
    want = {}
    for i, url, page in data:
        host, path = re.match(r"http://([^/]+)(.*)", url).groups()
        lines = re.findall(r"<div>(.*?)</div>", page)
        unique = {}
        for _, u, p in sorted(data, key=lambda r: r[1]):  # pages with the same lines are one, under the least path
            h, q = re.match(r"http://([^/]+)(.*)", u).groups()
            if h == host:
                unique.setdefault(tuple(re.findall(r"<div>(.*?)</div>", p)), q)
        order = sorted((q, x) for x, q in unique.items())
        at = next(n for n, (_, x) in enumerate(order) if x == tuple(lines))
        path = order[at][0]

        def near(n, order=order, path=path):
            if not 0 <= n < len(order):
                return (-1, -1)
            same = 0
            while same < min(len(path), len(order[n][0])) and path[same] == order[n][0][same]:
                same += 1
            return (path[:same].count("/"), same)

        other = at + 1 if near(at + 1) > near(at - 1) else at - 1
        lost = set()
        if 0 <= other < len(order):
            lost = set(htmlmain.common_lines(lines, list(order[other][1])))
        kept = [x for n, x in enumerate(lines) if n not in lost]
        want[i] = " ".join(kept or lines)
    assert texts(spark, data) == want
