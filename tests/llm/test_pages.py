"""Varied pages with the text that a reader would call the article."""

import collections
import glob
import html.parser
import random

import pandas as pd
import pytest

from tessera.llm import pages

LEAD = "The river rose for three days, and the town moved its boats inland."
MORE = "On the fourth day the water fell; nobody had been hurt."
MENU = "<ul><li><a href=/>Home</a></li><li><a href=/n>News</a></li></ul>"

PAGES = {
    "plain article": (f"<body><nav>{MENU}</nav><article><p>{LEAD}</p><p>{MORE}</p></article><footer>Imprint</footer></body>", f"{LEAD}\n{MORE}"),
    "title in a compound header": (f"<article><div class='post-header'><h1>Flood</h1></div><p>{LEAD}</p></article>", f"Flood\n{LEAD}"),
    "the same without an article": (f"<div class='site-header'>My site</div><div id=main><div class='post-header'><h1>Flood</h1></div><p>{LEAD}</p></div>", f"Flood\n{LEAD}"),
    "paragraph on related work": (f"<article><p>{LEAD}</p><p class='related-work'>{MORE}</p></article>", f"{LEAD}\n{MORE}"),
    "section called form of state": (f"<article><p>{LEAD}</p><section class='form-of-state'><p>{MORE}</p></section></article>", f"{LEAD}\n{MORE}"),
    "related posts": (f"<article><p>{LEAD}</p><div class='related-posts'>{MENU}</div></article>", LEAD),
    "suspect that is links": (f"<article><p>{LEAD}</p><div class='menu-of-week'>{MENU}</div></article>", LEAD),
    "suspect with fields": (f"<article><p>{LEAD}</p><div class='form-of-contact'>Write to us. <input name=q></div></article>", LEAD),
    "two equal parts and a menu": (f"{MENU}<div class=lead><p>{LEAD}</p></div><div class=more><p>{MORE}</p></div>", f"{LEAD}\n{MORE}"),
    "two sections of 60 and 40 per cent": (f"<div id=page><div class=lead><p>{LEAD} {MORE}</p></div><div class=rest><p>{LEAD}</p></div></div>", f"{LEAD} {MORE}\n{LEAD}"),
    "notice": (f"<div class='notice'>We changed our terms. Please read them.</div><article><p>{LEAD}</p></article>", LEAD),
    "cookie banner in the article": (f"<article><div id='cookie-consent'><p>We use cookies. Do you agree?</p></div><p>{LEAD}</p></article>", LEAD),
    "reader comments": (f"<article><p>{LEAD}</p><section class='comment-list'><p>I was there. It was bad.</p></section></article>", LEAD),
    "sidebar without article": (f"<div class='wrap'><div class='content'><p>{LEAD}</p><p>{MORE}</p></div><div class='sidebar-right'><p>Read our other papers. They are good.</p></div></div>", f"{LEAD}\n{MORE}"),
    "list of links in the article stays": (f"<article><p>{LEAD}</p>{MENU}</article>", f"{LEAD}\nHome\nNews"),
    "table": (f"<article><p>{LEAD}</p><table><tr><th>Day</th><td>Level</td></tr></table></article>", f"{LEAD}\nDay\nLevel"),
    "scripts, styles, comments, markup": (f"<style>p{{}}</style><article><!-- <p>no</p> --><script>var a='<p>no</p>'</script><p>{LEAD[:20]}<b>{LEAD[20:]}</b></p></article>", LEAD),
    "character references and white space": ("<article><p>Caf&eacute;  &amp;\n\t bar&#33; Open&nbsp;late.</p></article>", "Café & bar! Open late."),
    "open paragraphs": (f"<article><p>{LEAD}<p>{MORE}</article>", f"{LEAD}\n{MORE}"),
    "header inside the article": (f"<header>Site</header><article><header><h1>Flood</h1></header><p>{LEAD}</p></article>", f"Flood\n{LEAD}"),
    "hidden": (f"<article><p>{LEAD}</p><p hidden>No.</p><div aria-hidden=true>No.</div></article>", LEAD),
    "text without markup": (f"{LEAD} 1 < 2", f"{LEAD} 1 < 2"),
    "section called widget theory": (f"<article><p>{LEAD}</p><section class='widget-theory'><p>{MORE}</p></section></article>", f"{LEAD}\n{MORE}"),
    "division called ad hoc": (f"<article><p>{LEAD}</p><div class='ad-hoc'><p>{MORE}</p></div></article>", f"{LEAD}\n{MORE}"),
    "comment on the budget": (f"<article><p>{LEAD}</p><p id='comment-on-budget'>{MORE}</p></article>", f"{LEAD}\n{MORE}"),
    "list of comments in one word": (f"<article><p>{LEAD}</p><ol class='commentlist'><li>I was there. It was bad.</li></ol></article>", LEAD),
    "replies": (f"<article><p>{LEAD}</p><div id='replies'><p>I was there. It was bad.</p></div></article>", LEAD),
    "share buttons": (f"<article><p>{LEAD}</p><div class='share-buttons'>Send it on.</div></article>", LEAD),
    "body called article page": (f"<body class='article-page'><header>Our paper. Since 1900.</header><div><p>{LEAD}</p></div></body>", LEAD),
    "division called domain": (f"<div class='domain'><header>Our paper. Since 1900.</header><div><p>{LEAD}</p></div></div>", LEAD),
    "header of main": (f"<main><header><h1>Flood</h1></header><p>{LEAD}</p></main>", f"Flood\n{LEAD}"),
    "comments of readers": (f"<article><p>{LEAD}</p><div class='reader-comments'><p>I was there. It was bad.</p></div></article>", LEAD),
    "advert slot": (f"<article><p>{LEAD}</p><div class='ad-slot-3'>Buy our boats. They float.</div><p>{MORE}</p></article>", f"{LEAD}\n{MORE}"),
    "widget in camel case": (f"<article><p>{LEAD}</p><div class='sidebarWidget'>Read more. And more.</div></article>", LEAD),
    "no text": ("<html><body><script>1</script></body></html>", ""),
}


@pytest.mark.parametrize("name", PAGES)
def test_page(name):
    page, text = PAGES[name]
    assert pages.extract(page) == text


def test_hosts(spark):
    """A host's winning path, repeated rows, clashing columns, nulls and a very long page."""
    post = "<html><body><div class='c12'><p>{}</p></div><div class='x'><p>Ad text one. Ad text two.</p></div></body></html>"
    long = "<html><body><article>" + f"<p>{LEAD}</p>" * 30_000 + "</article></body></html>"
    rows = [(i, f"http://a.example/{i}", post.format(f"{LEAD} {MORE} " * 5), "k", "p", "h") for i in range(5)]
    rows += [rows[0], (10, "http://b.example/", long, None, None, None), (11, None, None, None, None, None), (None, "http://a.example/z", "", None, None, None), (12, "http://[bad", post.format(LEAD * 20), None, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host_path string, path string, __host string")
    got = [(r.page_id, r.text, r.n_chars) for r in pages.html_extraction(df).collect()]
    want = " ".join(f"{LEAD} {MORE} " .strip() for _ in range(5))
    assert sorted((g for g in got if g[0] is not None and g[0] < 5), key=str) == sorted([(i, want, len(want)) for i in [0, 0, 1, 2, 3, 4]], key=str)
    assert (10, "\n".join([LEAD] * 30_000), 30_000 * (len(LEAD) + 1) - 1) in got
    assert (11, "", 0) in got and (None, "", 0) in got and len(got) == len(rows)


def sentences(rng, n):
    words = "river town boat water house bridge field stone rain night market road".split()
    return [" ".join(rng.choice(words) for _ in range(rng.randint(4, 12))).capitalize() + "." for _ in range(n)]


def template(rng, host):
    """Class names without meaning; a head, a side and a foot that say the same on each page, in one of four layouts."""
    head, side, foot = (" ".join(sentences(rng, n)) for n in (2, 4, 3))
    c = [f"{chr(97 + host)}{x}" for x in "qwrtzu"]

    def page(body, last):
        main = "".join(f"<p>{x}</p>" for x in body)
        closing = f"<div class={c[4]}><p>{last}</p></div>"
        return (
            f"<div class={c[0]}><p>{head}</p></div><div class={c[1]}>{main}</div>{closing}<div class={c[2]}><p>{side}</p></div><p class={c[3]}>{foot}</p>",
            f"<div class={c[5]}><div class={c[2]}>{side}</div><div class={c[1]}>{main}{closing}</div></div><div class={c[3]}>{foot}</div>",
            f"<table class={c[5]}><tr><td class={c[1]}>{main}{closing}<td class={c[2]}><div class={c[0]}><p>{side}</p><p>{foot}</p></div></table>",
            f"<section class={c[0]}><ul><li>{head}</li><li>{foot}</li></ul></section><section class={c[1]}>{main}</section>{closing}<section class={c[2]}>{side}</section>",
        )[host % 4]

    return page


def test_fixed_parts(spark):
    """Forty pages of eight hosts: short articles beside more prose that each page repeats, a closing sentence outside of the longest part."""
    rng = random.Random(8)
    rows, want = [], {}
    for host in range(8):
        page = template(rng, host)
        for k in range(5):
            body, last = sentences(rng, (1, 2, 5, 12, 40)[k]), sentences(rng, 1)[0]
            rows.append((host * 10 + k, f"http://h{host}.example/{k}", page(body, last)))
            want[host * 10 + k] = "\n".join([*body, last])
        rows.append(rows[-1])
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for options in ({}, {"broadcast_hosts": 0, "salts": 3}):
        got = pages.html_extraction(df, **options).collect()
        assert len(got) == 48 and {r.page_id: r.text for r in got} == want


def test_copies_are_not_fixed(spark):
    """Copies of a page count once; pages that are alike but for a date keep their article; three pages tell nothing."""
    body = "".join(f"<p>{x}</p>" for x in sentences(random.Random(2), 9))
    side = "<div class=k><p>Also by us. Three more papers are out.</p></div>"
    rows = [(i, "http://copy.example/", f"<div class=m>{body}</div>") for i in range(9)]
    rows += [(20 + i, f"http://near.example/{i}", f"<div class=m>{body}</div><div class=d>{i}</div>") for i in range(9)]
    rows += [(40 + i, f"http://article.example/{i}", f"<article>{body}<p>It was on day {i}.</p></article>{side}") for i in range(9)]
    text = pages.extract(f"<article>{body}</article>")
    got = {r.page_id: r.text for r in pages.html_extraction(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == text and got[20 + i] == text and got[40 + i] == f"{text}\nIt was on day {i}." for i in range(9))


def test_fixed_against_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for i in range(120):
        parts = [f"<div class={c}><p>{rng.choice(LINES)}</p></div>" for c in "abcdef" if rng.random() < 0.6]
        rows.append((i, f"http://h{rng.randint(0, 3)}.example/", "".join(parts)))
    told = collections.defaultdict(dict)
    for _, url, page in rows:
        found = pages.profile(page)
        told[url][found.page] = dict(zip(found.places, found.texts, strict=True))
    want = set()
    for url, by_page in told.items():
        for place in {p for x in by_page.values() for p in x}:
            texts = [x[place] for x in by_page.values() if place in x]
            if len(texts) >= 4 and 4 * len(set(texts)) <= len(texts) and 100 * len(texts) >= len(by_page):
                want.add((pages.host_of(url), place))
    found = [(pages.host_of(u), *pages.profile(p)) for _, u, p in rows]
    df = spark.createDataFrame(found, "__host string, path string, size long, at long, page long, places array<long>, texts array<long>")
    got = pages.fixed_parts(df, df.groupBy("__host").agg({"page": "approx_count_distinct"}).toDF("__host", "n_pages"))
    assert want and {tuple(r) for r in got.collect()} == want


LINES = [f"Line {x} is here. It stays." for x in range(5)]


class Reader(html.parser.HTMLParser):
    """An extractor of another kind, for pages whose text is in an article: the library's parser, one buffer, blocks cut at tags."""

    BREAKS = {"p", "h1", "h2", "h3", "div", "li", "ul", "article", "footer", "section", "table", "tr", "td"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.depth = self.silent = 0
        self.blocks = [""]

    def handle_starttag(self, tag, attrs):
        self.depth += tag == "article"
        self.silent += tag in ("script", "style", "nav", "aside", "form")
        if tag in self.BREAKS:
            self.blocks.append("")
        elif tag == "br":
            self.blocks[-1] += " "

    def handle_endtag(self, tag):
        self.depth -= tag == "article"
        self.silent -= tag in ("script", "style", "nav", "aside", "form")
        if tag in self.BREAKS:
            self.blocks.append("")

    def handle_data(self, data):
        if self.depth and not self.silent:
            self.blocks[-1] += data

    def text(self):
        return "\n".join(" ".join(b.split()) for b in self.blocks if b.strip())


def test_whole_table(spark):
    """All pages of the small table against the reader."""
    if not (path := glob.glob("/root/testdata/sf0.001/pages.parquet")):
        pytest.skip("no test data")
    rows = pd.read_parquet(path[0], columns=["page_id", "html"])
    got = {r.page_id: r.text for r in pages.html_extraction(spark.read.parquet(path[0])).collect()}
    assert len(got) == len(rows)
    for page_id, page in zip(rows.page_id, rows.html, strict=True):
        reader = Reader()
        reader.feed(page or "")
        reader.close()
        assert got[page_id] == reader.text(), page_id
