import html
import re

from conftest_llm import SF
from strikeflow.llm import extraction as X
from strikeflow.llm.labelled import PAGES
from strikeflow.llm.pagetree import parse
from strikeflow.llm.queries import QUERIES


def labelled(page):
    tree = parse(page)
    return "\n".join(t for b, t in tree.pieces if tree.label[b])


def article(page):
    inside = re.search(r"<article>(.*?)</article>", page, re.DOTALL)[1]
    blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", inside)]
    return "\n".join(b for b in blocks if b)


def test_report(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = QUERIES["op7_html_extraction"](spark, SF).collect()
    assert len(got) == len(pages)
    for r in got:
        assert (r.url, r.text, r.n_chars) == (pages[r.page_id].url, article(pages[r.page_id].html), len(r.text))


def test_labelled_pages():
    assert X.extract(PAGES, *X.model()) == [labelled(p) for p in PAGES]


def test_pages_left_out_of_training():
    wrong = 0
    for i, page in enumerate(PAGES):
        wrong += X.extract([page], *X.train([p for k, p in enumerate(PAGES) if k != i])) != [labelled(page)]
    assert wrong <= len(PAGES) // 8


def test_training_is_repeatable():
    a, b = X.train(PAGES, 50), X.train(PAGES, 50)
    assert (a[0] == b[0]).all() and (a[1] == b[1]).all()


def test_marginals_equal_enumeration():
    import itertools

    import numpy as np

    rng = np.random.default_rng(1)
    forest = X.Forest([parse("<div><p>a</p><p>b<a href=x>c</a></p><ul><li>d</li></ul></div>"), parse("<p>x"), parse("")])
    weights, edge = rng.normal(size=X.FEATURES), rng.normal(size=(2, 2))
    unary, n = forest.features @ weights, len(forest.parent)
    total, one = 0.0, np.zeros(n)
    for y in itertools.product((0, 1), repeat=n):
        s = np.exp(sum(unary[i] for i in range(n) if y[i]) + sum(edge[y[u], y[i]] for i, u in enumerate(forest.parent) if u >= 0))
        total += s
        one += s * np.array(y)
    assert np.allclose(X.marginals(forest, weights, edge)[0], one / total)


def test_broken_markup():
    assert [t for _, t in parse("<p>a<p>b <b>c</p> d</i></div> e &lt;f&gt &#233;&nbsp;g").pieces] == ["a", "b c", "d e <f> é g"]
    assert [t for _, t in parse("<ul><li>1<li>2<ul><li>3</ul>4</ul><script>if (a<b) '</p>'</SCRIPT >x<!-- <p>no -->y<").pieces] == ["1", "2", "3", "4", "xy<"]
    assert [t for _, t in parse("a < b <table><tr><td>1<td>2<tr><td>3</table><style>p{}").pieces] == ["a < b", "1", "2", "3"]
    assert parse("").pieces == [] and parse("<!-- open").pieces == []
    assert len(parse("<div>" * 5000 + "deep").tag) == 5001


def test_odd_rows(spark):
    page = PAGES[0]
    rows = [(1, None, None), (2, "u", ""), (3, "u", "plain text only"), (4, "u", page), (4, "u", page), (None, "u", "<p>" + "long words " * 20_000), (5, "u", "<<<>>><p")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    got = {(r.page_id, r.text) for r in X.extraction_report(df).collect()}
    assert (1, "") in got and (2, "") in got and (4, labelled(page)) in got
    out = X.extract_pages(df)
    assert out.columns == df.columns and out.count() == len(rows)
    assert X.extraction_report(df.limit(0)).count() == 0 and X.extract_pages(df.limit(0)).count() == 0


def test_odd_pages_with_the_label_attribute(spark):
    values = ["12.5", "abc", "", "0", "1", None]
    html = [f"<body><nav{y}><a href='/'>Home</a></nav><div{y}><article{y}>{PAGES[0].split('<article data-y=' + chr(39) + '1' + chr(39) + '>')[1]}" for y in ("" if v is None else f' data-y="{v}"' for v in values)]
    df = spark.createDataFrame([(i, "u", h) for i, h in enumerate(html)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in X.extraction_report(df).collect()}
    assert len(got) == len(values) and set(got.values()) == {labelled(PAGES[0])}


def test_a_script_is_not_closed_by_its_start_tag():
    page = "<article><p>One.</p><script src='a.js'/>var code = 1;</script><svg/><p>Two.</p></article>"
    assert [t for _, t in parse(page).pieces] == ["One.", "Two."]


def test_stray_and_unclosed_tags_take_linear_time():
    import time

    for page in ("<b>x</i>" * 50_000, "<p><td>" + "<b>" * 50_000 + "<div></div>" * 50_000):
        start = time.perf_counter()
        parse(page)
        assert time.perf_counter() - start < 10


def test_names_of_classes_do_not_decide_alone():
    T = "The old bridge was closed for the winter because the ice had broken two of its piers, and nobody knew when it would open again."
    U = "People walked along the river instead, and the bakery on the far side lost half of its customers within a week."
    good = f"<h1>Bridge</h1><p>{T}</p><p>{U}</p>"
    want = f"Bridge\n{T}\n{U}"
    cases = {
        "alert": f"<body><nav><ul><li><a href=/>Home</a></li></ul></nav><article class='news-alert'>{good}</article><footer>c 2024</footer></body>",
        "share": f"<body><article class='post-share'>{good}</article></body>",
        "main widget": f"<body><main class='widget'>{good}</main><aside><p>{T}</p></aside></body>",
        "german": f"<body><div class='kopfzeile'><a href=/>Zeitung</a><p>Heute.</p></div><div class='haupt'>{good}</div><div class='fusszeile'><p>Alle Rechte vorbehalten.</p><p>Impressum.</p></div></body>",
        "french": f"<body><div class='entete'><h2>Le Jour</h2><ul><li><a href=/>Accueil</a></li></ul></div><div class='texte'>{good}</div><div class='pied'>Tous droits.</div></body>",
        "wrapped": f"<body><div id='seite'><div class='kopf'>Zeitung</div><div class='inhalt'>{good}</div><div class='rand'><ul><li><a href=/x>x y z</a></li></ul></div></div></body>",
        "comments": f"<body><article>{good}</article><section class='comments'><article class='comment'><p>{T}</p></article><article class='comment'><p>{U}</p><p>{T}</p></article></section></body>",
        "sharebox": f"<body><article>{good}<div class='post-share'><a href=/f>Share</a></div></article><div class='related-posts'><article class='teaser'><h2>Other</h2><p>{U}</p></article></div></body>",
        "plain": f"<body>{good}</body>", "divs": f"<body><div><h1>Bridge</h1><div>{T}</div><div>{U}</div></div></body>",
        "sections": f"<body><div class=x><section><h1>Bridge</h1><p>{T}</p></section><section><p>{U}</p></section></div></body>",
        "flatdivs": f"<body><h1>Bridge</h1><div>{T}</div><div>{U}</div></body>",
        "cookie": f"<body><div class='cookie-banner'><h2>Cookies</h2><p>{T} {T} {T}</p></div><article>{good}</article></body>",
    }
    got = dict(zip(cases, X.extract(list(cases.values()), *X.model())))
    assert got == dict.fromkeys(cases, want)


def test_a_short_section_beside_a_long_one_stays():
    page = "<body><div class='x'><section><h1>Bridge</h1><p>" + "The ice has broken it. " * 9 + "</p></section><section><p>It did.</p></section></div></body>"
    assert X.extract([page], *X.model())[0].endswith("\nIt did.")


def test_extraction_does_not_depend_on_the_batch():
    whole = X.extract(PAGES, *X.model())
    assert [X.extract([p], *X.model())[0] for p in PAGES] == whole
