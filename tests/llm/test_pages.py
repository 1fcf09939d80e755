import html
import math
import random
import re
import time
from html.parser import HTMLParser

import pytest
from orderloom.llm import html_extract, url_filter, warc
from pyspark.sql import functions as F

PAGES = "page_id long, url string, html string, text string, host string"


@pytest.mark.parametrize("tag", ["article", "div"])
def test_articles_come_out_whole(spark, sf, tag):
    """The truth is what stands between the article tags; with div the pages that are read have no such tags."""
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    shown = pages.withColumn("html", F.regexp_replace("html", "(</?)article>", f"$1{tag}>"))
    for r in html_extract.extract_text(shown).join(pages.select("page_id", "html"), "page_id").collect():
        article = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<br>|</?b>", " ", b))).strip() for b in re.split(r"</?h1>|</?p>", article)]
        assert r.text == "\n".join(b for b in blocks if b)
        assert r.n_chars == len(r.text)


BODY = "<h1>Title &amp; more</h1><p>First   paragraph\n with <a href='/x'>a link</a> in it, and a good many words so that it weighs.</p><p>Second paragraph &eacute; &#233; &#x41; with some more words of text in it.<ul><li>one</li><li>two</li></ul>"
CLEAN = "Title & more\nFirst paragraph with a link in it, and a good many words so that it weighs.\nSecond paragraph é é A with some more words of text in it.\none\ntwo"


@pytest.mark.parametrize(
    "page",
    [
        f"<html><body><nav><a href='/'>Home</a></nav><article>{BODY}</article><footer>foot</footer></body></html>",
        f"<body><div id='menu'><a>a</a><a>b</a></div><div class='content'>{BODY}</div><div class='reader-comments'><p>{'Nice article! ' * 60}</p></div><aside>{'side ' * 50}</aside>",
        f"<div class='cookie-notice'>We use cookies</div><main>{BODY}<form><input name=q><label>Mail</label></form><div class=\"ad\">Buy now</div></main><script>var a='</p><p>';</script>",
        f"<body class='has-sidebar'><div class='content-with-sidebar no-ads'><article class='post has-comments'>{BODY}<div style='display: none'>hidden</div></article><article class='comment'><p>{'I agree. ' * 90}</p></article></div>",
        f"<BODY><HEADER><p>site</p></HEADER><ARTICLE>{BODY}<!-- <p>hidden</p> --><style>p{{}}</style></ARTICLE>",
    ],
)
def test_boilerplate_goes(page):
    assert html_extract.main_text(page) == CLEAN


@pytest.mark.parametrize("page", [None, "", "   ", "<p></p>", "<!-- only -->", "<nav>menu</nav>", "<script>x"])
def test_pages_without_text(page):
    assert html_extract.main_text(page) == ""


def test_deep_and_broken_pages():
    assert html_extract.main_text("<div>" * 20_000 + "deep" + "</p></div>") == "deep"
    assert html_extract.main_text("a < b and <b>bold") == "a < b and bold"


def _section(tag, n, word):
    return f"<{tag}>" + "".join(f"<p>{' '.join([word] * 60)}</p>" for _ in range(n)) + f"</{tag}>", [" ".join([word] * 60)] * n


@pytest.mark.parametrize(("tag", "outer"), [("section", "<div>{}</div>"), ("div", "{}"), ("article", "<div>{}</div>"), ("article", "<main><h1>Lead</h1>{}</main>")])
def test_text_in_several_blocks_comes_out_whole(tag, outer):
    parts = [_section(tag, n, w) for n, w in ((4, "one"), (4, "two"), (3, "three"))]
    links = "<div>" + "<a href='/x'>some other page of this site</a> " * 12 + "</div>"
    page = f"<body>{links}{outer.format(''.join(p for p, _ in parts))}{links}</body>"
    assert html_extract.main_text(page) == "\n".join(["Lead"] * ("Lead" in outer) + [t for _, ts in parts for t in ts])


@pytest.mark.parametrize(
    "before",
    ["<div><nav>menu</div>", "<p class='ad'>Buy now", "<ul><li class='ad'>Buy now<li>", "<div><div class='ad'>Buy now</div></div>", "<section><div class='ad'>Buy now</section>", "<div><svg-icon name='x'></div>", "<div><template-x></div>"],
)
def test_unclosed_marked_elements_end_where_they_must(before):
    article = "".join(f"<p>{'word ' * 40}{i}</p>" for i in range(3))
    tail = "</ul>" if before.startswith("<ul>") else ""
    assert html_extract.main_text(f"<body>{before}{tail}<div>{article}</div></body>") == "\n".join(f"{'word ' * 40}{i}" for i in range(3))


PLAIN = "".join(f"<p>{' '.join([f'word{i}'] * 40)}</p>" for i in range(4))
TEXT = "\n".join(" ".join([f"word{i}"] * 40) for i in range(4))
MENU, FOOT = "<nav><ul><li><a href='/'>Home</a></li><li><a>News</a></li></ul></nav>", "<footer>&copy; site &middot; some words</footer>"


@pytest.mark.parametrize("name", ["post comments-open", "layout-sidebar-right", "search-and-rescue-history", "share-price-report", "public-notice", "search", "sidebar", "comments", "ad"])
@pytest.mark.parametrize("attribute", ["class", "id"])
def test_marks_do_not_take_the_article(name, attribute):
    for before, after in (("", ""), (MENU, FOOT), (MENU + "<div>Copyright 2020 Some Company. All rights reserved.</div>", FOOT)):
        assert html_extract.main_text(f"<body>{before}<div {attribute}='{name}'>{PLAIN}</div>{after}</body>") == TEXT


@pytest.mark.parametrize("tag", ["form", "aside", "section", "header", "footer"])
def test_tags_around_the_page_do_not_take_it(tag):
    assert html_extract.main_text(f"<body><{tag}>{MENU}<div>{PLAIN}</div></{tag}></body>") == TEXT


def test_what_no_name_marks_goes_by_density():
    comments = "".join(f"<div><b>Reader {i}</b><p>I agree with number {i}</p></div>" for i in range(5))
    assert html_extract.main_text(f"<body>{MENU}<div>{PLAIN}</div><div>{comments}</div><div>Copyright 2020 Company. All rights reserved.</div></body>") == TEXT
    menu = "<div><ul>" + "<li><a href='/x'>Page</a></li>" * 9 + "</ul></div>"
    assert html_extract.main_text(f"<body>{menu}<div><h1>Title</h1>{PLAIN}</div>{menu}<div>All rights reserved.</div>") == "Title\n" + TEXT


def test_header_of_the_article_stays():
    for tag in ("article", "main"):
        page = f"<body><header><p>Site</p></header>{MENU}<{tag}><header><h1>Title</h1><p>lead</p></header>{PLAIN}</{tag}>{FOOT}</body>"
        assert html_extract.main_text(page) == "Title\nlead\n" + TEXT


def test_density_alone_finds_most_articles(spark, sf, monkeypatch):
    """Without tags and names, the pages whose text is not tiny are right all the same."""
    monkeypatch.setattr(html_extract, "_marked", lambda *_: False)
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("html").collect()
    want = lambda page: html_extract.main_text(re.search(r"<article>.*</article>", page, re.S)[0])
    assert sum(html_extract.main_text(r.html) == want(r.html) for r in pages) >= 0.8 * len(pages)


class Dom(HTMLParser):
    """A well-formed page as nested lists: [tag, kid, ...], texts as strings."""

    def __init__(self, page):
        super().__init__()
        self.open = [["body"]]
        self.feed(page)

    def handle_starttag(self, tag, attrs):
        self.open[-1].append([tag])
        self.open.append(self.open[-1][-1])

    def handle_endtag(self, tag):
        self.open.pop()

    def handle_data(self, data):
        self.open[-1].append(data)


def densest(page):
    """The published selection by its definition: every block at or above the threshold gives its subtree of the largest sum."""
    inline = ("a", "b")
    flat = lambda n: n if isinstance(n, str) else "".join(map(flat, n[1:]))
    chars = lambda n: len("".join(flat(n).split()))
    tags = lambda n: sum(1 + tags(k) for k in n[1:] if isinstance(k, list))
    links = lambda n: (chars(n), 1) if n[0] == "a" else tuple(map(sum, zip((0, 0), *(links(k) for k in n[1:] if isinstance(k, list)), strict=True)))
    body = Dom(page).open[0]
    whole = links(body)[0] / max(chars(body), 1)

    def density(n):
        c, t, (lc, lt) = chars(n), max(tags(n), 1), links(n)
        if not c or not whole:
            return c / t
        return c / t * math.log(max(c / max(lc, 1) * t / max(lt, 1), 1), math.log(c / max(c - lc, 1) * lc + whole * c + math.e))

    blocks = lambda n: [k for k in n[1:] if isinstance(k, list) and k[0] not in inline]
    total = lambda n: sum(map(density, blocks(n))) + density(["x", *(k for k in n[1:] if k not in blocks(n))]) if blocks(n) else density(n)
    every = lambda n: [n] + [x for k in blocks(n) for x in every(k)]
    top = lambda n: max(every(n), key=total)

    def to(n, end):
        return [n] if n is end else next(([n, *p] for k in blocks(n) if (p := to(k, end))), None)

    threshold = min(map(density, to(body, top(body))))
    chosen = [top(n) for n in every(body) if chars(n) and density(n) >= threshold and total(top(n)) >= html_extract.SHARE * total(top(body))]
    out, stack = [], [body]
    while stack:
        n = stack.pop()
        if any(n is x for x in chosen):
            out += [" ".join(k.split()) for k in re.split("\n", "\n".join(lines(n)))]
        else:
            stack += blocks(n)[::-1]
    return "\n".join(x for x in out if x)


def lines(n):
    """Texts of a node, parted where blocks begin and end."""
    now, out = "", []
    for k in n[1:]:
        if isinstance(k, str):
            now += k
        elif k[0] in ("a", "b"):
            now += "".join(x if isinstance(x, str) else "".join(x[1:]) for x in k[1:])
        else:
            out += [now, *lines(k)]
            now = ""
    return [*out, now]


def random_page(rng, depth=0):
    words = lambda n: " ".join(rng.choice(("some", "text", "of", "the", "page", "x")) for _ in range(n))
    if depth == 4 or rng.random() < 0.2:
        line = words(rng.choice((1, 3, 10, 40)))
        if rng.random() < 0.3:
            line += " <a>" + words(rng.choice((1, 5))) + "</a>"
        if rng.random() < 0.2:
            line += " <b>" + words(3) + "</b> " + words(2)
        return "<p>" + line + "</p>"
    tag = rng.choice(("div", "section", "ul", "blockquote"))
    return f"<{tag}>" + "".join(random_page(rng, depth + 1) for _ in range(rng.randrange(1, 5))) + words(rng.choice((0, 0, 0, 5))) + f"</{tag}>"


def test_selection_against_its_definition():
    rng = random.Random(11)
    for _ in range(300):
        page = "".join(random_page(rng) for _ in range(rng.randrange(1, 4)))
        assert html_extract.main_text(page) == densest(page), page


@pytest.mark.parametrize("page", ["<svg " * 200_000, "<a " * 300_000, "<a \"> \" " * 120_000, "<div>" * 90_000 + "</x>" * 90_000, "<td><div>" + "<b>" * 100_000 + "<tr></tr>" * 50_000, "</svg " * 150_000, "<h2>x</h2>" * 90_000], ids=range(7))
def test_broken_pages_take_time_in_proportion(page):
    html_extract.main_text(page[:1000])
    begun = time.process_time()
    html_extract.main_text(page)
    assert time.process_time() - begun < 8  # about 1.5 s on a free machine; in proportion to the square it would be minutes


def test_extract_table(spark):
    rows = [(1, None, None, "old", "h"), (2, "u", "<p>x</p>", "old", "h"), (2, "u", "<p>x</p>", "old", "h"), (None, None, "plain", None, None)]
    got = html_extract.extract_text(spark.createDataFrame(rows, PAGES))
    assert got.columns == ["page_id", "url", "host", "text", "n_chars"]
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in got.collect()) == [(0, "plain", 5), (1, "", 0), (2, "x", 1), (2, "x", 1)]
    assert html_extract.extract_text(spark.createDataFrame([], PAGES)).count() == 0


def test_names_of_pages_that_clash(spark):
    df = spark.createDataFrame([(1, "<p>x</p>", "a", 2)], "page_id long, html string, Text string, N_CHARS int")
    assert [tuple(r) for r in html_extract.extract_text(df).collect()] == [(1, "x", 1)]
    assert html_extract.extract_text(df.withColumnRenamed("html", "HTML")).columns == ["page_id", "text", "n_chars"]


def ruled(host, path):
    best = None
    for rule, _ in url_filter.RULES:
        name, _, start = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + start) and (best is None or len(rule) > len(best)):
            best = rule
    return best


URLS = [None, "", "no scheme", "http://", "HTTP://Example.ORG/es/a?b#c", "x://example.org/en/12", "https://a.example.org/en/2", "https://notexample.org/de/", "http://shop.com/de/x", "http://shop.com/fr/x", "http://com/fr/", "https://a.net?x://b", "https://É.Org/fr", "http://example.org", "h://a/b://c/d"]


def test_hosts_paths_and_rules(spark, sf):
    df = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)], "page_id long, url string")
    model = url_filter.fit(spark.createDataFrame(url_filter.LABELLED, "url string, label int"))
    for r in url_filter.judge_urls(df, model).collect():
        rest = (r.url or "").partition("://")[2] if "://" in (r.url or "") else ""
        host = re.split(r"[/?#]", rest)[0]
        path = re.split(r"[?#]", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
        assert (r.host, r.path, r.rule) == (host, path, ruled(host, path)), r.url
        assert r.verdict == dict(url_filter.RULES)[r.rule] if r.rule else r.verdict in ("allow", "block")
    assert url_filter.judge_urls(df.limit(0), model).count() == 0


#: Hosts of either kind, of which the labelled table has none.
BAD_HOSTS = "gambling-site.com phishing-bank.com rolex-replica.example.com ladbrokes-casino.net grosvenorcasinos.com pokerbros.net slotsheaven.com viagraonline.info pharmacy-discount.biz xnxx.com adultwork.com hotcams.net adcolony.com adsrvr.org trackclicks.biz secure-paypal-login.net keygens.nl torrentdownloads.me cheapreplicas.ru quickpaydayloans.org claim-your-prize.info buy-backlinks.net".split()
GOOD_HOSTS = "stackoverflow.com britannica.com smithsonianmag.com scientificamerican.com liberation.fr faz.net lavanguardia.com washingtonpost.com columbia.edu uni-heidelberg.de univ-lyon2.fr inria.fr nist.gov ema.europa.eu tate.org.uk vam.ac.uk sciencemuseum.org.uk epicurious.com nationalgeographic.com readthedocs.io freebsd.org haskell.org wikimedia.org chessbase.com saint-denis.fr jean-luc-photo.net oak-street-surgery.co.uk weather-station.net".split()


def test_hosts_that_the_table_does_not_have(spark):
    """Measured: 8 of 22 are blocked and 28 of 28 allowed, as a host of which little is known passes; with a prior of one half 21 and 20."""
    assert not {h for h in BAD_HOSTS + GOOD_HOSTS if any(f"//{h}/" in u or f".{h}/" in u for u, _ in url_filter.LABELLED)}
    rows = [(f"https://{h}/", h in BAD_HOSTS) for h in BAD_HOSTS + GOOD_HOSTS]
    for prior, blocked, allowed in ((0.2, 8, 28), (0.5, 20, 19)):
        model = url_filter.fit(spark.createDataFrame(url_filter.LABELLED, "url string, label int"), prior=prior)
        got = url_filter.judge_urls(spark.createDataFrame(rows, "url string, bad boolean"), model, rules=()).collect()
        right = [[(r.verdict == "block") == r.bad for r in got if r.bad == kind] for kind in (True, False)]
        assert sum(right[0]) >= blocked and sum(right[1]) >= allowed, [(r.host, r.block_probability) for r in got if (r.verdict == "block") != r.bad]


@pytest.mark.parametrize("leave_out", range(5))
def test_fifths_of_the_table(spark, leave_out):
    """Each fifth of the labelled hosts is judged by what the others teach."""
    fifth = lambda u: sum(url_filter.host_of(u).removeprefix("www.").encode()) % 5
    model = url_filter.fit(spark.createDataFrame([x for x in url_filter.LABELLED if fifth(x[0]) != leave_out], "url string, label int"), prior=0.5)
    held = [x for x in url_filter.LABELLED if fifth(x[0]) == leave_out]
    got = url_filter.judge_urls(spark.createDataFrame(held, "url string, label int"), model, rules=()).collect()
    assert sum((r.verdict == "block") == (r.label == 1) for r in got) > 0.7 * len(got)


def test_names_that_clash(spark):
    model = url_filter.fit(spark.createDataFrame(url_filter.LABELLED[:20], "url string, label int"))
    df = spark.createDataFrame([(1, "https://a.org/x", "h", "v", "a", "r", "p")], "page_id long, url string, Host string, VERDICT string, at string, of_rule string, __p string")
    got = url_filter.judge_urls(df, model)
    assert got.columns == ["page_id", "url", "at", "of_rule", "__p", "host", "path", "rule", "block_probability", "verdict"]
    assert got.first()[:7] == (1, "https://a.org/x", "a", "r", "p", "a.org", "/x")


def test_regression_against_plain_gradient_descent(spark):
    """Weights by name of n-gram instead of by bucket, one row at a time."""
    rows = [("https://casino.com/a", 1), ("https://win-it.net/b/c", 1), ("https://library.org/a", 0), ("https://museum.net/", 0), (None, 0)]
    df = spark.createDataFrame(rows, "url string, label int")
    model = url_filter.fit(df, buckets=1 << 20, rounds=60, prior=None)
    named = []
    for r in df.select(*url_filter.host_and_path(F.col("url"))).toDF("h", "p").collect():
        grams = [(part, n, t[i : i + n]) for part, t in (("h", f"^{r.h}$"), ("p", f"^{r.p}$")) for n in (3, 4, 5) for i in range(len(t) - n + 1)]
        named.append((grams, 1 / math.sqrt(max(len(grams), 1))))
    w, bias = dict.fromkeys((g for grams, _ in named for g in grams), 0.0), 0.0
    for _ in range(60):
        off = [1 / (1 + math.exp(-bias - scale * sum(w[g] for g in grams))) - y for (grams, scale), (_, y) in zip(named, rows, strict=True)]
        step = dict.fromkeys(w, 0.0)
        for (grams, scale), o in zip(named, off, strict=True):
            for g in grams:
                step[g] += o * scale / len(rows)
        w = {g: x - 4.0 * (step[g] + 1e-4 * x) for g, x in w.items()}
        bias -= 0.4 * sum(off) / len(rows)
    got = url_filter.judge_urls(df, model, rules=()).select("url", "block_probability").collect()
    want = {u: 1 / (1 + math.exp(-bias - scale * sum(w[g] for g in grams))) for (grams, scale), (u, _) in zip(named, rows, strict=True)}
    assert {r.url: r.block_probability for r in got} == pytest.approx(want, abs=1e-6)


def test_fit_on_nothing(spark):
    weights, bias = url_filter.fit(spark.createDataFrame([], "url string, label int"))
    assert not weights.any()
    assert bias == 0


def test_archive_round_trip(spark):
    rows = [(3, "http://a", "same", None, None), (1, "http://b\r\nX: y", "same", None, None), (2, None, None, None, None), (5, "u", "", None, None), (4, "u", "other é 😀", None, None), (4, "u", "other é 😀", None, None), (None, "n", "same", None, None)]
    pages = spark.createDataFrame(rows, PAGES)
    records, payloads = warc.write_archive(pages)
    parsed = warc.parse_records(warc.read_archive(records, payloads)).collect()
    assert payloads.count() == 3
    assert sorted((r.page_id or 0, r.record_type, r.refers_to, r.payload_bytes) for r in parsed if r.page_id != 4) == [(0, "revisit", 1, 4), (1, "response", None, 4), (2, "response", None, 0), (3, "revisit", 1, 4), (5, "revisit", 2, 0)]
    assert sorted((r.record_type, r.refers_to) for r in parsed if r.page_id == 4) == [("response", None), ("revisit", 4)]
    assert all(r.intact for r in parsed if r.record_type == "response")
    assert {bytes(r.payload).decode() for r in parsed if r.record_type == "response"} == {"same", "", "other é 😀"}
    assert all(bytes(r.record).startswith(b"WARC/1.1\r\n") and bytes(r.record).endswith(b"\r\n\r\n") for r in warc.read_archive(records, payloads).collect())


def test_short_payloads_are_all_responses(spark):
    rows = [(i, "u", t, None, None) for i, t in enumerate(["ab", "ab", "abcdef", "abcdef", None, ""])]
    parsed = warc.parse_records(warc.read_archive(*warc.write_archive(spark.createDataFrame(rows, PAGES), min_bytes=3))).collect()
    assert {r.page_id for r in parsed if r.record_type == "revisit"} == {3}
    assert len(parsed) == 6
    assert all(r.intact for r in parsed if r.record_type == "response")


def test_ids_of_another_type(spark):
    pages = spark.createDataFrame([("b", "u", "same", None, None), ("a é", "u", "same", None, None), (None, "u", "x", None, None)], PAGES.replace("page_id long", "page_id string"))
    archive = warc.read_archive(*warc.write_archive(pages))
    got = {(r.page_id, r.record_type, r.refers_to) for r in warc.parse_records(archive, "string").collect()}
    assert got == {("a é", "response", None), ("b", "revisit", "a é"), (None, "response", None)}
    assert {r.page_id for r in warc.parse_records(archive).collect()} == {None}


def test_empty_archive(spark):
    assert warc.parse_records(warc.read_archive(*warc.write_archive(spark.createDataFrame([], PAGES)))).count() == 0
