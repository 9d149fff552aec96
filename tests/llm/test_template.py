"""Main text of pages: literal cases, templates deduced over a host, the registered query."""

from __future__ import annotations

import html
import re

from llm_cases import CLASHING

from conftest import SF_SMALL
from ledgerline.llm import template
from ledgerline.llm.queries import QUERIES

CASES = [
    (None, ""),
    ("", ""),
    ("<p>a<p>b<br>c &amp d&nbsp;e", "a\n\nb c & d e"),
    ("<html><head><title>t</title><style>p{}</style></head><body><nav><a>n</a></nav><div class=ad>x</div>"
     "<article><h1>T</h1><p>one <b>two</b>three  four\n five</p><ul><li>a<li>b</ul></article><footer>f</footer>",
     "T\n\none twothree four five\n\na\n\nb"),
    ("<article><header>h</header><p>x</p><article class='comment'>c</article><aside>s</aside><form>f</form><p>y</article>tail",
     "x\n\ny"),
    ('<script>var t="</p>";</script><p>x<!-- <p>no --></p><style>b{}</style>', "x"),
    ("<main><p>1<div class='cookie-notice'>n<p>m</div><p>2</main><div id=comments><p>c</p></div>", "1\n\n2"),
    ("<div role='main'><p>in</div><p>out", "in"),
    ("<p>&lt;b&gt; &#233; &#x1F600;</p>", "<b> é 😀"),
    ("plain text", "plain text"),
    ("x < y & z <p", "x < y & z"),
    ("<article><p>cut &am", "cut &am"),
    ("<article><p>open<div class='share'>s</div>more</article>", "open\n\nmore"),
    ("<article class='post'><table><tr><td>a<td>b<tr><td>c</table></article>", "a\n\nb\n\nc"),
    ("<p title=it's>a</p><p data-x=\"1 > 0\" class='c'>b's</p>", "a\n\nb's"),
    ("<p " + "x='1' " * 60 + "<b>text", "text"),
    ("<body class='has-sidebar'><p>kept</p></body>", "kept"),
]


def test_literal_cases():
    for page, text in CASES:
        assert template.main_text(page, None) == text, page


def _pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_template_text_of_a_host_is_no_content(spark):
    """Pages without an article: what a host repeats in place is template, the rest slots."""
    def page(i):
        return (f"<body><div><p>Our site</p><p>Read this daily</p></div><div><p>story {i} begins</p><p>and ends {i * 7}</p></div>"
                "<div><p>Write to us</p></div></body>")

    rows = [(i, f"http://a.example/{i}", page(i)) for i in range(6)]
    rows += [(10 + i, f"http://b{i}.example/", page(i)) for i in range(2)]  # single pages have no template
    made = {r["page_id"]: r["text"] for r in template.extract(_pages(spark, rows)).collect()}
    for i in range(6):
        assert made[i] == f"story {i} begins\n\nand ends {i * 7}"
    assert made[10].startswith("Our site\n\nRead this daily\n\nstory 0 begins")


def test_classes_follow_occurrence_vectors(spark):
    rows = [(i, "http://h.example/", f"<body><div><p>x{i}</p></div>" + "<ul><li>a</ul>" * (i % 2)) for i in range(6)]
    from pyspark.sql import functions as F

    pages = _pages(spark, rows).withColumn("host", F.lit("h")).select("host", "page_id", "html")
    found = template.templates(pages).collect()[0]["template"]
    assert template._hash("<body>") in found and template._hash("/body<div>") in found
    assert template._hash("/body<ul>") in found  # on half of the pages, with its own class
    assert not any(template._hash(f"/body/div#x{i}") in found for i in range(6))


def test_repeated_text_inside_the_article_stays(spark):
    rows = [(i, "http://h.example/", f"<article><p>Licensed line.</p><p>{'own text ' * i}</p></article>") for i in range(8)]
    made = {r["page_id"]: r["text"] for r in template.extract(_pages(spark, rows)).collect()}
    assert all(t.startswith("Licensed line.") for t in made.values())


def test_awkward_rows(spark):
    from pyspark.sql import functions as F

    rows = [(i, None if i % 2 else "http://h.example/", page) for i, (page, _) in enumerate(CASES)]
    rows += [(0, "http://h.example/", None), (None, "http://h.example/", "<p>x"), (None, None, None)]
    pages = _pages(spark, rows)
    extra = pages.select("*", *[F.lit("z").alias(c) for c in CLASHING + ["token", "HTML"]])
    made = template.extract(extra).collect()
    assert len(made) == len(rows)
    assert all(r["n_chars"] == len(r["text"]) for r in made)
    assert template.extract(pages.limit(0)).collect() == []
    long = "<article>" + "<p>word " * 20_000 + "</article>"
    assert template.extract(_pages(spark, [(1, "u", long)])).collect()[0]["n_chars"] == 20_000 * 6 - 2


def test_query_against_a_reading_of_these_pages(spark):
    pages = spark.read.parquet(f"{SF_SMALL}/pages.parquet").collect()
    made = {r["page_id"]: r for r in QUERIES["op7_template_text"](spark, SF_SMALL).collect()}
    assert len(made) == len(pages)
    for r in pages:
        article = re.search(r"<article>(.*?)</article>", r["html"], re.S).group(1)
        parts = re.split(r"</?(?:p|h1)>", re.sub(r"</?b>", "", article.replace("<br>", " ")))
        want = "\n\n".join(x for x in (" ".join(html.unescape(p).split()) for p in parts) if x)
        assert made[r["page_id"]]["text"] == want and made[r["page_id"]]["url"] == r["url"]


def _texts(spark, htmls, host="h.example"):
    rows = [(i, f"http://{host}/{i}", page) for i, page in enumerate(htmls)]
    return {r["page_id"]: r["text"] for r in template.extract(_pages(spark, rows)).collect()}


def test_slots_choose_the_text_of_a_page_without_an_article(spark):
    def page(i, name):
        return (f"<body><div class='top'><p>hello {i}</p></div><div class='body'><{name}><p>own {i} {'text ' * 9}</p></{name}></div>"
                f"<div class='low'><p>see {i + 1}</p></div></body>")

    made = _texts(spark, [page(i, "article" if i < 5 else "section") for i in range(6)])
    assert all(made[i] == f"own {i} {'text ' * 9}".strip() for i in range(6))


def test_classes_are_ordered_and_nest():
    t = template.Template([11, 12, 13, 21, 22, 31, 32], [1, 1, 1, 2, 2, 3, 3])
    assert t.invalid([11, 21, 22, 21, 22, 12, 31, 32, 13]) == set()
    assert t.invalid([11, 13, 12]) == {2}  # out of order
    assert t.invalid([21, 21, 22, 22]) == {4}  # rounds overlap
    assert t.invalid([11, 21, 12, 22, 13]) == {3, 4}  # crosses a heavier class
    assert t.invalid([21, 31, 22, 32]) == {5, 6}
    assert t.slots([0, 11, 0, 21, 0, 22, 0, 12, 0, 13, 0]) == [
        (-1,), None, (0,), None, (0, 3), None, (0,), None, (1,), None, (-1,)
    ]


def test_tokens_out_of_order_are_no_template(spark):
    a, b = "<div class='a'><p>first words</p></div>", "<div class='b'><p>second words</p></div>"
    made = _texts(spark, [f"<body>{a + b if i else b + a}<div class='c'><p>own {i}</p></div></body>" for i in range(6)])
    assert made[0] == "second words\n\nown 0" and made[1] == "second words\n\nown 1"


def test_anchors_inside_an_article_are_no_marks():
    page = "<article><h2 id='search'>Search</h2><section id='related-work'><p>text</p></section></article>"
    assert template.main_text(page, None) == "Search\n\ntext"


def test_copies_of_a_page_are_no_template(spark):
    copy = "<body><div><p>one story</p></div><div class='b'><p>goes on</p></div></body>"
    other = [f"<body><div><p>story {i}</p></div><div class='b'><p>and on {i}</p></div></body>" for i in range(3)]
    made = _texts(spark, [copy] * 9 + other)
    assert all(made[i] == "one story\n\ngoes on" for i in range(9))
    assert made[9] == "story 0\n\nand on 0"
    assert set(_texts(spark, [copy] * 9).values()) == {"one story\n\ngoes on"}


def test_headings_of_some_pages_are_content(spark):
    def page(i):
        heads = "<h2>Methods</h2><p>m{0}</p><h2>Results</h2><p>r{0}</p>".format(i) if i % 2 else f"<p>note {i}</p>"
        return f"<body><h1>Site</h1><p>about</p>{heads}</body>"

    made = _texts(spark, [page(i) for i in range(8)])
    assert made[1] == "Methods\n\nm1\n\nResults\n\nr1" and made[2] == "note 2"


def test_class_words_are_no_verdict_on_an_articles_own_elements():
    own = (
        "<article><header><h1>Title</h1><p>by line</p></header><div id='search-trees'>trees</div><div class='related-work'><p>work</p></div>"
        "<p class='alert'>beware</p><p>an <span class='ad-hoc'>ad hoc</span> choice <span class='comment'># note</span></p>"
        "<object><p>fallback</p></object><pre class='header'>raw</pre></article>"
    )
    assert template.main_text(own, None) == "Title\n\ntrees\n\nwork\n\nbeware\n\nan ad hoc choice # note\n\nfallback\n\nraw"
    other = (
        "<article><div class='post-header'><h2>Head</h2>by<nav><h3>no</h3></nav></div><p class='ad'>x</p><div class='alert-box'>x</div>"
        "<div class='relatedPosts'>x</div><div id='comments-list'>x</div><div class='note cookie-notice'>x</div><p>y</p></article>"
    )
    assert template.main_text(other, None) == "Head\n\ny"
    outside = "<header><h1>Site</h1></header><div><p>text</p></div>"
    assert template.main_text(outside, None) == "text"


def test_the_template_decides_on_doubtful_elements(spark):
    def page(i, every):
        work = "<div class='related-work'><p>see {}</p><ul><li>one</ul></div>".format(i * 31)
        return f"<body><article><h1>t{i}</h1><p>own {i}</p>{work if every or i == 3 else ''}</article></body>"

    made = _texts(spark, [page(i, True) for i in range(8)])
    assert all(made[i] == f"t{i}\n\nown {i}" for i in range(8))
    made = _texts(spark, [page(i, False) for i in range(8)])
    assert made[3] == "t3\n\nown 3\n\nsee 93\n\none" and made[4] == "t4\n\nown 4"


def test_near_copies_without_an_article_keep_their_text(spark):
    def page(i):
        return (f"<body><div><p>A story that many pages tell in the same words.</p><p>It goes on and comes to an end.</p></div>"
                f"<div><p>copy {i}</p></div></body>")

    made = _texts(spark, [page(i) for i in range(8)])
    want = "A story that many pages tell in the same words.\n\nIt goes on and comes to an end.\n\ncopy {}"
    assert all(made[i] == want.format(i) for i in range(8))
    long = "word " * 80
    made = _texts(spark, [f"<body><div><p>Menu</p></div><div><p>{long}</p></div><div><p>{f'own {i} ' * 40}</p></div></body>" for i in range(8)])
    assert all(made[i] == f"{long.strip()}\n\n{(f'own {i} ' * 40).strip()}" for i in range(8))
