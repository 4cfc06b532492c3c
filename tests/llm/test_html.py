import pytest

from rillwork.llm import html_text as h


def page(k, body, url=None):
    nav = "".join(f"<li><a href='/{x}'>menu{x}</a></li>" for x in range(2 + k % 3))
    return f"<!DOCTYPE html><html><head><title>Title {k}</title><style>p{{}}</style><script>var t='</p>';</script></head><body><nav><ul>{nav}</ul></nav><!-- <p>no</p> --><div class='ad box'>Buy {k}</div><article>{body}</article><footer>&copy; host</footer></body></html>"


def paragraphs(k):
    return [f"Head {k} &amp; more", *[f"Text {k} of\n  paragraph&nbsp;{j} with <b>bold</b> <a href='#'>link</a>" for j in range(1 + k % 4)]]


def expected(k):
    return "\n".join([f"Head {k} & more", *[f"Text {k} of paragraph {j} with bold link" for j in range(1 + k % 4)]])


def build(k):
    first, *rest = paragraphs(k)
    return page(k, f"<h1>{first}</h1>" + "".join(f"<p>{x}</p>" for x in rest))


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (None, ""), ("", ""), ("plain &lt;text&gt;", "plain <text>"),
        ("<p>a<p>b<br>c", "a\nb\nc"),
        ("<body><p>in</p><nav>menu<p>x", "in"),
        ("<article><p>one</p><aside>side</aside><form><p>mail</p></form><div class='cookie-notice'>ok<div>x</div></div><p>two</p></article><p>out</p>", "one\ntwo"),
        ("<main><article><p>x</p></article><section class='comments'><article class='comment'><p>nice</p></article></section></main>", "x"),
        ("<div id='sidebar-2'>s</div><div class='story'><p>kept</p></div><div role='contentinfo'>f</div>", "kept"),
        ("<article><p>cut", "cut"), ("<p>1 < 2 and <b>3</b>4</p>", "1 < 2 and 34"),
        ("<article><script>if (a<b) '</p>'</script><p>A&#233;&eacute;</p></article>", "Aéé"),
        ("<div class='ad'>never closed<article><p>still here</p></article>", "still here"),
        ("<p>" + "long " * 20000 + "</p>", ("long " * 20000).strip()),
    ],
)
def test_rules(html, text):
    assert h.extract(html, []) == text


def test_a_wrapper_is_inferred_and_matches():
    pages = [h.tokens(build(k)) for k in range(8)]
    wrapper = h.infer(pages)
    kinds = {n[0] for n in wrapper}
    assert "rep" in kinds
    assert all(h.match(wrapper, h.tokens(build(k))) is not None for k in range(8, 30))
    for k in range(40):
        assert h.extract(build(k), [wrapper]) == expected(k)
    assert h.match(wrapper, h.tokens("<p>other</p>")) is None


def test_optional_groups():
    with_box = page(1, "<h1>a</h1><div class='x'>note</div><p>b</p>")
    without = page(1, "<h1>c</h1><p>d</p>")
    wrapper = h.infer([h.tokens(with_box), h.tokens(without)])
    assert "opt" in {n[0] for n in wrapper}
    assert h.match(wrapper, h.tokens(without)) and h.match(wrapper, h.tokens(with_box))


def unlabelled(k):
    """Boilerplate that no tag or class tells: the same on all pages of the host."""
    return f"<html><body><div class='x'>Best host since 1999</div><div class='y'><h1>Story {k}</h1><p>What happened on day {k}</p><h6>Read more below</h6></div><div class='z'>All rights kept</div></body></html>"


def test_the_wrapper_decides(spark):
    wrapper = h.infer([h.tokens(unlabelled(k)) for k in range(8)])
    for k in range(20):
        want = f"Story {k}\nWhat happened on day {k}"
        assert h.extract(unlabelled(k), [wrapper]) == want != h.extract(unlabelled(k), [])
    few = h.infer([h.tokens(unlabelled(k)) for k in range(2)])  # two pages may agree by chance
    assert "Best host" in h.extract(unlabelled(1), [few])
    odd = [f"<html><body><section><h2>Other {k}</h2><ul><li>never seen {k}</li></ul></section><div class='z'>All rights kept</div></body></html>" for k in range(12)]
    rows = [(k, "http://a.b/x", x) for k, x in enumerate([unlabelled(k) for k in range(300)] + odd)]
    got = {r["page_id"]: r["text"] for r in h.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)).collect()}
    assert all(got[k] == f"Story {k}\nWhat happened on day {k}" for k in range(300))
    assert all(got[300 + k] == f"Other {k}\nnever seen {k}" for k in range(12))


def with_article(body, k):
    return f"<html><body><nav><a>m{k}</a>{'<a>x</a>' * (k % 3)}</nav><article>{body}</article><div>host</div></body></html>"


def test_constants_inside_the_article_stay():
    same = "<h2>Sources</h2><p>This article is about chemistry.</p>"
    pages = [with_article(f"<h1>Story {k}</h1>{same}<p>text {k}</p><h3>End</h3>", k) for k in range(8)]
    wrapper = h.infer([h.tokens(p) for p in pages])
    for k, p in enumerate(pages):
        assert h.match(wrapper, h.tokens(p)) is not None
        assert h.extract(p, [wrapper]) == f"Story {k}\nSources\nThis article is about chemistry.\ntext {k}\nEnd" == h.extract(p, [])


@pytest.mark.parametrize("named", ["article", "main", "div"])
def test_equal_articles_of_one_host_stay(named):
    body = "<h1>Notice of change</h1><p>The same text on all pages.</p>"
    pages = [with_article(body, k).replace("article>", f"{named}>") for k in range(8)]
    wrapper = h.infer([h.tokens(p) for p in pages])
    for p in pages:
        assert h.extract(p, [wrapper]).startswith("Notice of change\nThe same text on all pages.")


def test_constants_between_slots_stay():
    pages = [f"<body><div>Top of all</div><div><h1>Story {k}</h1><h4>What we know</h4><p>day {k}</p></div><div>Bottom</div></body>" for k in range(8)]
    wrapper = h.infer([h.tokens(p) for p in pages])
    assert h.extract(pages[3], [wrapper]) == "Story 3\nWhat we know\nday 3"


@pytest.mark.parametrize(
    ("inner", "kept"),
    [
        ('<div class="content header-image"><p>x</p></div>', True), ('<section id="comments-on-method"><p>x</p></section>', True), ('<p class="notice">x</p>', True), ('<h2 id="share-prices">x</h2>', True),
        ('<div class="related-posts"><p>x</p></div>', False), ('<div id="comments"><p>x</p></div>', False), ('<div class="ad-slot-2"><p>x</p></div>', False), ('<p class="ad">x</p>', False), ('<ul class="social links"><li>x</li></ul>', False),
        ("<div class='cookie-notice'>x</div>", False), ('<div class="a share-buttons">x</div>', False),
    ],
)
def test_names_inside_an_article(inner, kept):
    assert h.extract(f"<body><article><p>a</p>{inner}<p>b</p></article></body>", []) == ("a\nx\nb" if kept else "a\nb")


def test_pages_of_many_equal_groups_are_aligned():
    long = lambda k: "<body><div>site</div><article>" + "".join(f"<p>t{k} {j}</p>" for j in range(h.ALIGNED + k)) + "</article></body>"
    wrapper = h.infer([h.tokens(long(k)) for k in range(3)])
    assert wrapper and h.match(wrapper, h.tokens(long(9))) is not None


def test_long_pages_take_no_part_in_alignments():
    long = "<body><article>" + "".join(f"<p class='k{chr(97 + k % 26)}'>t{k}</p>" for k in range(h.ALIGNED)) + "</article></body>"
    assert h.infer([h.tokens(long), h.tokens(long + " ")]) == []
    assert h.extract(long, [h.infer([h.tokens(build(k)) for k in range(4)])]).count("\n") == h.ALIGNED - 1


def test_tables(spark):
    rows = [(k, f"https://{'hot' if k % 3 else 'h' + str(k % 7)}.example.org/a?{k}", build(k)) for k in range(60)]
    rows += [(None, None, None), (60, "relative", ""), (60, "http://user@Host.example:80/x", build(60))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    got = h.extract_pages(df).collect()
    assert len(got) == len(rows)
    for r in got:
        k = r["page_id"]
        want = expected(k) if k is not None and (k < 60 or r["url"].startswith("http")) else ""
        assert r["text"] == want and r["n_chars"] == len(want)
    assert df.where("page_id = 60").select(h.host("url").alias("h")).distinct().count() == 2
    assert h.extract_pages(df.limit(0)).count() == 0
