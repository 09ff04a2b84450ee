import pytest

from textsieve.llm.html_extract import extract, extract_text

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{x}}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/a">Menu</a></li></ul></nav><div class="ad">Buy {n}</div><article><h1>Title {n}</h1><p><b>First {n} &amp;amp; x&nbsp;y<br>z
<p>Second   line {n}</p><aside>related</aside><div id="comments"><p>nice</p></div><form><p>mail?</p></form><p class="cookie-notice">We use</p></article><footer>&copy; host</footer></body></html>"""


def test_blocks_of_the_article():
    want = "Title 1\nFirst 1 &amp; x y z\nSecond line 1"
    assert extract(PAGE.format(n=1), None) == want


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("<nav>x</nav>", ""),
        ("plain < text", "plain < text"),
        ("<article><p>a <span class='ad'>b <span>c</span></span>d</p></article><p>e", "a d"),
        ("<article><ul><li>one<li>two</ul><table><tr><td>x<td>y</table></article>", "one\ntwo\nx\ny"),
        ("<article><p>a<!-- <p>no</p> --> b</p><p>c</article>", "a b\nc"),
        ("<article><p>a</p><script>if (a < b) '</p>'</script><p>b</p>", "a\nb"),
        ("<main><p>a</p><div hidden>no</div><p style='display: none'>no</p></main>", "a"),
        ("<div><div class='sidebar'>x x x x x x x</div><div class='body'><p>long enough text</p><p>more of it</p></div></div>", "long enough text\nmore of it"),
        ("<article><p>&#65;&lt;b&gt; &eacute;</p></article", "A<b> é"),
        ("<article class='has-sidebar'><div class='with-sidebar'><p>a</p></div><div class='topnav_x'>b</div><div id='userComments'>c</div></article>", "a"),
        ("<ARTICLE><P>Up</P></ARTICLE>", "Up"),
        ('<article><p title="a > b">q</p></article>', "q"),
    ],
)
def test_markup(page, text):
    assert extract(page, None) == text


def test_templates_of_hosts(spark):
    """Without article or main, the region and the repeated notice come from the host's template."""
    page = "<html><body><div class='top'><p>Welcome to the host</p></div><div class='x1'><p>{a}</p><p>{b}</p><p>Thank you for reading this host</p></div><div class='x2'><p>All of it is ours</p></div></body></html>"
    rows = [(i, f"http://h.example/{i}", page.format(a=f"text number {i} " * 20, b=f"end {i}")) for i in range(30)]
    rows += [(100, None, page.format(a="alone " * 20, b="x")), (101, "http://single.example", None), (102, "nonsense", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as n", "2 as host", "3 as tokens")
    got = {r["page_id"]: r for r in extract_text(df).collect()}
    assert got[3]["text"] == ("text number 3 " * 20).strip() + "\nend 3" and got[3]["n_chars"] == len(got[3]["text"])
    assert got[100]["text"].startswith("alone alone") and got[101]["text"] == "" and got[102]["n_chars"] == 0
    assert len(got) == 33 and extract_text(df.limit(0)).count() == 0


def test_copies_on_a_host_keep_their_text(spark):
    page = "<html><body><nav>menu</nav><article><p>{}</p></article></body></html>"
    rows = [(i, f"http://h.example/{i}", page.format("same text" if i % 2 else f"other {i}")) for i in range(20)]
    got = {r["page_id"]: r["text"] for r in extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1] == "same text" and got[2] == "other 2"


def test_region_is_a_container(spark):
    """Headings, lists, tables and quotes beside the paragraphs of the region stay, by markup and by template."""
    page = "<html><body><div class='x0'><p>Top</p></div><div class='x1 w-1/2'><h1>Head {i}</h1><p class='w-1/2'>{text}</p><ul><li>item {i}</ul><table><tr><td>cell {i}</table><blockquote><p>quote {i}</p></blockquote><pre>code {i}</pre></div></body></html>"
    want = "Head {i}\n{text}\nitem {i}\ncell {i}\nquote {i}\ncode {i}"
    value = lambda i: {"i": i, "text": f"long text {i} " * 20 + "end"}
    assert extract(page.format(**value(1)), None) == want.format(**value(1))
    rows = [(i, f"http://h.example/{i}", page.format(**value(i))) for i in range(12)]
    got = {r["page_id"]: r["text"] for r in extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == want.format(**value(i)) for i in range(12))


@pytest.mark.parametrize("region", ["article", "div class='x1'"])
def test_near_copies_on_a_host_keep_their_text(spark, region):
    """Versions of one article, of which one paragraph is edited, are no template."""
    page = "<html><body><div class='x0'><p>top</p></div><{}><p>{}</p><p>{}</p><p>edited {}</p></{}></body></html>"
    one, two = "first unchanged part " * 8 + "end", "second unchanged part " * 8 + "end"
    rows = [(i, f"http://h.example/{i}", page.format(region, one, two, i, region.split()[0])) for i in range(18)]
    rows += [(i, f"http://h.example/{i}", page.format(region, f"other {i} " * 20 + "end", f"text {i}", i, region.split()[0])) for i in (18, 19)]
    got = {r["page_id"]: r["text"] for r in extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"{one}\n{two}\nedited {i}" for i in range(18)) and got[19].endswith("\ntext 19\nedited 19")


# Probes of names that say something about the text, not about furniture.


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ('<article><h2 id="related-work">Related work</h2><p>a</p></article>', "Related work\na"),
        ('<article><section id="search-algorithms"><p>quick</p></section></article>', "quick"),
        ('<article><p>price <span class="share-price">12.5</span> now</p></article>', "price 12.5 now"),
        ('<article><p class="text-legal">terms</p></article>', "terms"),
        ('<article><p>a</p><div id="reader-responses"><p>no</p></div></article>', "a"),
        ('<body><article><p>body of it</p></article><section class="discussion"><article><p>no</p></article></section>', "body of it"),
        ('<body><div><article><p>a longer body of it</p></article></div><section class="x"><article><p>hm</p></article><article><p>yes</p></article></section>', "a longer body of it"),
        ("<article><p>outer</p><article><p>a reply</p></article></article>", "outer"),
        ("<header><p>site</p></header><article><header><h1>Head</h1></header><p>a</p><footer>by x</footer></article>", "Head\na"),
        ("<article><p>a <span class=ad>never closed</p><p>b</p></article>", "a\nb"),
    ],
)
def test_names_of_content(page, text):
    assert extract(page, None) == text


def test_long_and_broken_markup_takes_linear_time():
    from time import perf_counter

    for piece in ("<span class=ad>x", "<div>y ", "<li>z", "<p><table><tr><td>q", "</div></p>", "<b><a href='", "&amp;<!-- "):
        took = []
        for n in (4000, 16000):
            began = perf_counter()
            extract("<body>" + piece * n, None)
            took.append(perf_counter() - began)
        assert took[1] < 10 * took[0] + 0.2, (piece, took)


def brute_classes(pages, support=0.5, least=2):
    """Token classes by whole occurrence vectors."""
    from textsieve.llm.html_extract import parse

    keys = [parse(p).keys() for p in pages]
    vectors = {k: tuple(x.count(k) for x in keys) for x in keys for k in x}
    classes = {}
    for k, v in vectors.items():
        if sum(n > 0 for n in v) >= max(2, support * len(pages)):
            classes.setdefault(v, set()).add(k)
    return {frozenset(c) for c in classes.values() if len(c) >= least}


def test_classes_equal_whole_vectors(spark, tmp_path):
    import random

    from textsieve.llm.html_extract import classes_of
    from textsieve.scratch import Scratch

    rng, pages = random.Random(3), {}
    for host in ("a", "b", "c"):
        shapes = [[rng.choice(["<div class=k{}>", "<p>", "<ul><li>", "<h2>same", "</div>", "text {}", "<section>"]).format(rng.randrange(4)) for _ in range(12)] for _ in range(3)]
        pages[host] = ["<body><div class=top>" + "".join(rng.choice(shapes)) + f"{i if rng.random() < 0.5 else ''}" for i in range(rng.choice([2, 7, 12]))]
    rows = [(h, p) for h, ps in pages.items() for p in ps]
    got = {r["host"]: {frozenset(c) for c in r["classes"]} for r in classes_of(spark.createDataFrame(rows, "host string, html string"), Scratch(spark, "t")).collect()}
    assert {h: brute_classes(ps) for h, ps in pages.items()} == {h: got.get(h, set()) for h in pages}


def test_a_class_must_stand_in_order_and_nest():
    from textsieve.llm.html_extract import Template

    t = Template([[1, 2, 3], [7, 8]])
    assert t.lay([1, 7, 8, 7, 8, 2, 3]) == {0, 1}
    assert t.lay([2, 1, 3]) == set() and t.lay([1, 2]) == set()
    assert t.lay([1, 7, 8, 2, 7, 8, 3]) == {0}  # in two gaps
    assert t.lay([1, 7, 2, 8, 3]) == {0}  # it straddles a token of the class around it


HIDDEN = """<html><body><div><div><p>{menu}</p></div></div><div><div><h1>Head {i}</h1><p>{text}</p><h2>Summary</h2><p>short {i}</p><div><p>Sign up for our letter</p></div></div>
<div><p><b>ann</b> {talk}</p><p>bob said {i}</p></div></div><div><p>All rights are ours</p></div></body></html>"""


@pytest.mark.parametrize("n", [3, 9, 12])
def test_pages_without_telling_names(spark, n):
    """Neither article nor classes: menu, notice, comments and footer go by the template; a repeated heading inside the text stays."""
    rows = [(i, f"http://h.example/{i}", HIDDEN.format(i=i, menu="Home News Contact", text=f"words of page {i} " * 30 + "end", talk=f"nice one {i}")) for i in range(n)]
    got = {r["page_id"]: r["text"] for r in extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"Head {i}\n" + f"words of page {i} " * 30 + f"end\nSummary\nshort {i}" for i in range(n))


def test_repeated_rows_and_null_ids(spark):
    rows = [(None, f"http://h.example/{i % 4}", HIDDEN.format(i=i % 4, menu="m", text=f"words {i % 4} " * 30, talk="t")) for i in range(8)]
    got = [r["text"] for r in extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()]
    assert len(got) == 8 and len(set(got)) == 4 and all(t.startswith("Head") and "Summary" in t and "ours" not in t for t in got)
