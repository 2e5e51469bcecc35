import random
import re
from collections import Counter, defaultdict

from tempestry.llm import html_text
from tests.llm import corpus


def page(rng, i):
    w = lambda n: " ".join(corpus.words(rng, n))
    title, paragraphs = w(6), [w(30) for _ in range(3)]
    html = (
        f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style><script>var t='</p>';</script></head><body class='no-sidebar'>"
        f"<header><h2>Site</h2></header><nav><ul><li><a href='/x'>{w(1)}</a></li></ul></nav><!-- ad --><div class=\"ad\">{w(5)}</div>"
        f"<div id='cookie-notice'>We use cookies</div><article><h1>{title}</h1><p>{paragraphs[0]}<br>x &amp; y&nbsp;z<p><b>{paragraphs[1]}</b></p>"
        f"<div>Share this page now</div><p>{paragraphs[2]}</p><form><label>mail</label><input></form></article>"
        f"<aside>{w(4)}</aside><section class='comments'><p>{w(9)}</p></section><footer>&copy; {w(4)}</footer>"
    )
    return html + ("</body></html>" if i % 3 else ""), "\n".join([title, paragraphs[0] + " x & y z", paragraphs[1], paragraphs[2]])


def test_pages(spark):
    rng = random.Random(5)
    made = [page(rng, i) for i in range(30)]
    rows = [(i, f"https://User@WWW.a.example:80/p/{i}", h, "x") for i, (h, _) in enumerate(made)]
    rows += [(100, None, None, "x"), (101, "nonsense", "", "x"), (102, "http://b.example/", "<p>only <i>text</i> here &am", "x"), (103, "http://b.example/", "plain & simple", "x"), (104, "http://c.example/", "<nav>menu</nav>", "x"), (105, "http://d.example", "<div><script>never closed", "x"), (3, rows[3][1], rows[3][2], "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string").repartition(3)
    found = html_text.main_text(pages).collect()
    assert len(found) == len(rows)
    by = {r.page_id: r.text for r in found}
    for i, (_, text) in enumerate(made):
        assert by[i] == text
    assert [by[i] for i in (100, 101, 102, 103, 104, 105)] == ["", "", "only text here &am", "plain & simple", "", ""]


def test_copies_are_not_templates(spark):
    html, text = page(random.Random(1), 1)
    pages = spark.createDataFrame([(i, f"http://a.example/{i}", html) for i in range(20)], "page_id long, url string, html string")
    assert {r.text for r in html_text.main_text(pages).collect()} == {text.replace("\n" + text.split("\n")[3], "\nShare this page now\n" + text.split("\n")[3])}
    assert html_text.main_text(pages.limit(0)).count() == 0


def brute_force_texts(htmls):
    """Template texts of one host: tokens grouped by their whole occurrence vectors."""
    counts, first = defaultdict(lambda: [0] * len(htmls)), defaultdict(list)
    for i, html in enumerate(htmls):
        seen = Counter()
        for at, p in enumerate(html_text.blocks(html)):
            token = p.place if p.text is None else html_text.token_hash(p.path, p.text)
            seen[token, p.text is not None] += 1
            if seen[token, p.text is not None] == 1:
                first[token].append(at)
        for token, n in seen.items():
            counts[token][i] = n
    classes = defaultdict(list)
    for (token, is_text), vector in counts.items():
        classes[tuple(vector)].append((token, is_text))
    texts = [
        token
        for vector, tokens in classes.items()
        if len(tokens) >= html_text.MEMBERS and sum(x > 0 for x in vector) >= html_text.SUPPORT * len(htmls)
        for token, is_text in tokens
        if is_text
    ]
    return sorted(texts, key=lambda t: sum(first[t]) / len(first[t]))


def test_templates_are_the_equivalence_classes(spark):
    rng = random.Random(2)
    hosts = {f"{h}.example": [page(rng, i)[0] for i in range(n)] for h, n in (("a", 12), ("b", 5), ("c", 2))}
    hosts["b.example"][0] = "<p>another page</p>"
    rows = [(i, f"http://{h}/{i}", x) for h, htmls in hosts.items() for i, x in enumerate(htmls)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    found = {r.host: r.texts for r in html_text.templates(pages).collect()}
    counts = lambda h: brute_force_texts(hosts[h])
    assert found == {"a.example": counts("a.example"), "b.example": counts("b.example")}
    assert len(found["a.example"]) >= 4  # heading of the site, cookies, share, mail


def test_slots_of_unnamed_pages(spark):
    """Without any name for their parts, pages keep their article and little else, on hosts of any size."""
    rng = random.Random(8)
    w = lambda n: " ".join(corpus.words(rng, n))
    rows, texts = [], {}
    for host, n in (("many", 40), ("few", 3), ("one", 1)):
        for i in range(n):
            parts = [w(rng.randint(3, 60)) for _ in range(rng.randint(3, 12))] + [w(40)]
            links = "".join(f"<li><a href='/{k}'>{w(1)}</a></li>" for k in range(6))
            html = (
                f"<html><head><title>{parts[0]}</title></head><body><div><ul>{links}</ul></div><div>{w(8)}</div>"
                f"<div><h1>{parts[0]}</h1>{''.join(f'<p>{x}' for x in parts[1:])}</div><div>&copy; {w(9)}</div></body></html>"
            )
            rows.append((len(rows), f"http://{host}.example/{i}", html))
            texts[len(rows) - 1] = "\n".join(parts)
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = {r.page_id: r.text for r in html_text.main_text(pages).collect()}
    assert sum(found[i] == text for i, text in texts.items()) >= 0.95 * len(texts)


def test_texts_out_of_order_are_not_the_templates():
    template = html_text.Template({"texts": [5, 6, 7, 8], "chain": [], "headed": [], "menus": []})
    assert template.in_order(list(enumerate([5, 1, 7, 6, 8]))) in ({0, 2, 4}, {0, 3, 4})
    assert template.in_order([]) == set()
    assert html_text.innermost([(1, 0), (2, 1), (3, 2), (4, 3)], {2}) == 2


def test_named_like_chrome():
    """A class of several words decides nothing against the article itself."""
    text = lambda html: html_text.page_text(html, html_text.Template())
    article = "<h1>One</h1><p>two three four five six seven</p>"
    for html in (
        f"<div class='social-science'><article>{article}</article></div>",
        f"<article class='related-work'>{article}</article>",
        f"<article class='post notice-board'>{article}</article>",
        f"<article>{article.replace('<p>', '<script>if(i<n){x()}</script><script><!-- x() </script><p>')}</article>",
    ):
        assert text(html) == "One\ntwo three four five six seven", html


def test_long_pages_and_the_joined_template(spark, monkeypatch):
    monkeypatch.setattr(html_text, "BROADCAST_TOKENS", 0)
    rng = random.Random(9)
    made = [page(rng, i) for i in range(6)]
    long = "<html><body><article>" + "".join(f"<p>{i} {'word ' * 50}</p>" for i in range(3000)) + "</article></body></html>"
    rows = [(i, f"http://a.example/{i}", h) for i, (h, _) in enumerate(made)] + [(99, "http://b.example/", long)]
    found = {r.page_id: r.text for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(found[i] == text for i, (_, text) in enumerate(made))
    assert found[99] == re.sub(r"<[^>]*>", "\n", long).strip().replace(" \n\n", "\n").strip()


def test_raw_text_ends_at_its_own_end_tag():
    scripts = ("for(i=0;i<n;i++)f(i);", "<!-- x", "<![CDATA[ x", "if(a<b)\"", "s='<p title=\"</p>'")
    for script in scripts:
        for element, end in (("script", "</SCRIPT >"), ("style", "</style\n\">"), ("textarea", "</textarea>"), ("noscript", "</noscript>"), ("title", "</title>")):
            html = f"<html><head><title>t</title></head><body><article><p>one</p><svg><{element} a='b'>{script}{end}</svg><{element} a='b'>{script}{end}<p>two</p></article></body></html>"
            found = html_text.page_text(html, html_text.Template())
            assert found == "one\ntwo", (element, script, found)
    assert html_text.page_text("<p>one</p><script>i<n", html_text.Template()) == "one"


def test_near_copies_are_whole(spark):
    rng = random.Random(3)
    w = lambda n: " ".join(corpus.words(rng, n))
    shared, rows, texts = [w(30) for _ in range(6)], [], {}
    for i in range(20):
        parts = [*shared[:3], w(25), *shared[3:]]
        rows.append((i, f"http://near.example/{i}", f"<html><body><nav>menu</nav><article><h1>One title</h1>{''.join(f'<p>{x}</p>' for x in parts)}</article><footer>foot</footer></body></html>"))
        texts[i] = "\n".join(["One title", *parts])
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.page_id: r.text for r in html_text.main_text(pages).collect()} == texts


def test_small_hosts_have_templates(spark):
    rng = random.Random(6)
    w = lambda n: " ".join(corpus.words(rng, n))
    rows, texts = [], {}
    for i in range(3):
        parts = [w(30), w(30)]
        rows.append((i, f"http://small.example/{i}", f"<html><body><article><h1>Title {i}</h1><p>{parts[0]}</p><div>Share this page now</div><p>{parts[1]}</p></article></body></html>"))
        texts[i] = "\n".join([f"Title {i}", *parts])
    shared = [w(30) for _ in range(4)]
    for i in range(3):
        rows.append((10 + i, f"http://plain.example/{i}", f"<html><body><div>menu</div><p>{shared[0]}</p><p>Number {i}</p>{''.join(f'<p>{x}</p>' for x in shared[1:])}</body></html>"))
        texts[10 + i] = "\n".join([shared[0], f"Number {i}", *shared[1:]])
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.page_id: r.text for r in html_text.main_text(pages).collect()} == texts


def test_names_around_an_article():
    text = lambda html: html_text.page_text(html, html_text.Template())
    article, comment = "<h1>One</h1><p>two three four five six</p><div class='share'>share</div>", "<p>six</p>"
    whole = "One\ntwo three four five six"
    assert text(f"<div class='has-sidebar'><article>{article}</article></div>") == whole
    assert text(f"<article class='comment-open'>{article}</article><aside>x</aside>") == whole
    assert text(f"<main><div class='has-sidebar'><article class='comment-open'>{article}</article></div></main>") == whole
    assert text(f"<div class='has-sidebar'><article>{article}</article><div class='widget'>x</div><section class='comments'><article class='comment-body'>{comment}</article></section></div>") == whole
    assert text(f"<article>{article}</article><section class='comments'><article class='comment-body'>{comment}</article></section>") == whole
    assert text(f"<div>{article}</div><section class='comments'><article class='comment-body'>{comment}</article></section>") == whole
    assert text(f"<nav><article>{article}</article></nav><div class='share'>x</div>") == ""
