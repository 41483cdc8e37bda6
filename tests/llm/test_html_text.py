"""Main text of pages: the scan against all stretches, layouts, broken markup, the query."""

import html
import random
import re
import time

from tidyorder.llm.html_text import Page, best_stretch, extract_text, learn_weights, main_text
from tidyorder.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
STORY = "<h1>A title</h1><p>First words of <b>the</b> story.</p><p>More &amp; more<br>of it, un<i>broken</i>.</p><ul><li>one point made</li><li>another point</li></ul><p>End.</p>"
TOLD = "A title First words of the story. More & more of it, unbroken. one point made another point End."
MENU = "<ul><li><a href='/a'>Home page</a></li><li><a href='/b'>All our news</a></li><li><a href='/c'>Contact us now</a></li></ul>"
LAYOUTS = [
    f"<body><nav>{MENU}</nav><article>{STORY}</article><footer>&copy; us</footer></body>",
    f"<body><header><h2>Our site</h2>{MENU}</header><main>{STORY}</main><aside><p>Read this too, it is long enough.</p></aside></body>",
    f"<div id=top><p>Hello there</p></div>{MENU}<div class='content has-sidebar'>{STORY}</div><div class='sidebar'><p>Side words here.</p></div>",
    f"<div class='cookie-notice'><p>We use cookies on this site a lot.</p></div><div class=post>{STORY}</div><div id='comments'><p>Great read, thanks!</p></div>",
    f"<article><header><h1>A title</h1></header>{STORY[16:]}<div class='comments-area'><article class=comment><p>I disagree with all of it.</p></article></div></article>",
    f"<body>{STORY.replace('<p>More', '<div class=ad-slot>Buy now!</div><form><input><label>Mail</label><button>Go</button></form><p>More')}<script>var x = '<p>no</p>';</script><style>p{{}}</style></body>",
    f"<body><!-- <p>old</p> --><div role=banner>Site</div>{STORY}<div role='contentinfo'>All rights</div><div hidden>Secret words here</div></body>",
    f"<BODY><NAV>{MENU}</NAV><ARTICLE>{STORY.upper().replace('AMP', 'amp')}</ARTICLE></BODY>".replace("/B", "/b"),
]


def truth(page):
    """The article of the given tables, whose only markup is h1, p, b and br."""
    inner = page[page.index("<article>") + 9 : page.index("</article>")]
    return " ".join(html.unescape(re.sub(r"<(?:/?p|br|/?h1)>", " ", inner).replace("<b>", "").replace("</b>", "")).split())


def given(spark):
    return spark.read.parquet(f"{FOLDER}/pages.parquet")


def test_scan_equals_all_stretches():
    for seed in range(300):
        r = random.Random(seed)
        scores = [r.choice([-3, -1, -0.5, 0.5, 1, 2]) for _ in range(seed % 14)]
        sums = {(i, j): sum(scores[i:j]) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)}
        top = max(sums.values(), default=0)
        found = best_stretch(scores)
        assert found == (0, 0) if top <= 0 else sums[found] == top


def test_query_gives_whole_articles(spark):
    want = {r.page_id: (r.url, truth(r.html)) for r in given(spark).collect()}
    got = {r.page_id: (r.url, r.text) for r in QUERIES["op13_html_extraction"](spark, FOLDER).collect()}
    assert got == want
    assert all(r.n_chars == len(r.text) for r in QUERIES["op13_html_extraction"](spark, FOLDER).collect())


def test_weights_find_articles_without_their_labels(spark):
    """Held out: the same pages with a plain div in the place of the article."""
    weights = learn_weights(given(spark).filter("page_id % 2 = 0"))
    assert all(v > 0 if k[0] == "w" else v < 0 for k, v in weights.items())
    rows = given(spark).filter("page_id % 2 = 1").collect()
    assert rows
    for r in rows:
        page = r.html.replace("<article>", "<div class='x'>").replace("</article>", "</div>")
        assert not Page(page).labelled and main_text(page, weights) == truth(r.html)


def test_layouts(spark):
    weights = learn_weights(given(spark))
    for known in (weights, {}):
        for k, page in enumerate(LAYOUTS):
            want = TOLD.upper() if k == 7 else TOLD
            assert main_text(page, dict(known)) == want, (k, bool(known))


def test_edge_cases(spark):
    cases = {
        1: (None, ""), 2: ("", ""), 3: ("no markup,\n at  all", "no markup, at all"), 4: ("<p></p><br>", ""), 5: ("a < b and c <3 d", "a < b and c <3 d"),
        6: ("<p>one&nbsp;two &lt;p&gt; &#233;&bogus; &amp;amp;</p>", "one two <p> é&bogus; &amp;"), 7: ("<p>cut <a href='x", "cut"), 8: ("<p>x</p><script>never closed <p>y</p>", "x"),
        9: ("<p>a</p><!-- open <p>b</p>", "a"), 10: ("<p>a<p>b<p>c</div></b></p>d", "a b c d"), 11: ("word " * 400_000, " ".join(["word"] * 400_000)),
        12: ("<b>" * 100_000 + "deep" + "</i>" * 100_000, ""), 13: ("<div>" * 50_000 + "some words stand here" + "</div>" * 50_000, "some words stand here"),
        14: ("<p title=\"a>b\" data-x='<p>'>quoted</p>", "quoted"), 15: ("<nav>only a menu</nav>", ""), 16: ("<a '" * 50_000, ""), 17: ("<" * 200_000, "<" * 200_000),
        18: ("<p>x</p>" * 100_000, " ".join(["x"] * 100_000)), 19: ("<textarea>t</textarea><p>kept</p>", "kept"), 20: ("<!--" * 100_000, ""), 21: ("<i><div>" + "<b>" * 50_000 + "</i>" * 50_000 + "some words", None),
    }
    rows = [(k, "u", v[0], "x", 1, 2) for k, v in cases.items()] + [(None, None, "<p>null id</p>", "y", 1, 2)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, key int, n int").repartition(3)
    began = time.time()
    got = {r.page_id: r.text for r in extract_text(pages).collect()}
    assert time.time() - began < 60
    cases[12] = (cases[12][0], "deep" if got[12] else "")
    assert got.pop(None) == "null id" and {k: v for k, v in got.items() if k != 21} == {k: v[1] for k, v in cases.items() if k != 21}
    assert extract_text(pages.limit(0)).count() == 0
    assert extract_text(pages.union(pages)).count() == 2 * len(rows)
