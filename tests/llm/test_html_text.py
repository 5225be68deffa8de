import pytest

from tagweave.llm import html_text


@pytest.fixture(scope="module")
def tree(spark):
    return html_text.train(spark)


P = "This paragraph has quite a few words so that nobody would take it for a menu, not even a machine."


def test_layouts(tree):
    def text(x):
        return html_text.main_text(x, tree)
    assert text(f"<nav><a href=x>Home</a></nav><article><h1>Title</h1><p>{P}</p><p>Ok.</p></article><footer>&copy; me</footer>") == f"Title\n{P}\nOk."
    assert text(f"<body><div class='cookie-notice'>{P}</div><main><p>{P} A&amp;B&#33;</p></main><aside>{P}</aside></body>") == f"{P} A&B!"
    assert text(f"<div id=sidebar><p>{P}</p></div><div class=content><p>{P}<p>Unclosed <b>bold<br>line</div><div class='comments'><p>{P}</p></div>") == f"{P}\nUnclosed bold line"
    assert text(f"<form><p>{P}</p></form><script>var a='<p>{P}</p>'</script><style>p</style><!-- <p>{P}</p> --><article>{P}</article>") == P
    assert text(f"<article><header><h1>Head</h1></header><p>{P}</p><section class=\"comments\"><article class='comment'><p>{P}</p></article></section></article>") == f"Head\n{P}"
    assert text(f"<ul><li><a href=1>One</a><li><a href=2>Two</a></ul><p>{P}</p><p>{P}</p><p><a href=3>Three</a></p>") == f"{P}\n{P}"


def test_broken_markup(tree):
    for x in (None, "", "<", "<p", "<!-- open", "<a href='x", "<script>x", "</p></div>", "a < b > c", "<p>\x00</p>", "<div " * 2000, "<" * 5000):
        assert isinstance(html_text.main_text(x, tree), str)
    assert html_text.blocks("<p title='a>b'>x  y\n z&nbsp;w</p>")[0].text == "x y z w"
    assert [b.text for b in html_text.blocks("<title>t</title><p>a</p>b<div>c<span>d</span></div>")] == ["a", "b", "cd"]


def test_features():
    f = html_text.features(html_text.blocks("<p>one two</p><p><a href=x>l</a> m</p>"))
    assert f[0][4:] == (2.0, 0.0, 2.0, 0.0, 1.0, 0.5) and f[1][4:] == (2.0, 2.0, 0.0, 0.5, 0.0, 1.0)


def test_tree_fits_the_labelled_table(tree):
    pages = html_text.labelled_pages()
    right = total = 0
    for page, labels in pages:
        for f, y in zip(html_text.features(html_text.blocks(page)), labels, strict=True):
            right += html_text._is_main(tree, f) == bool(y)
            total += 1
    assert right / total > 0.97


def test_pages_table(spark):
    import html
    import re
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r["page_id"]: r for r in html_text.extract(pages).collect()}
    for r in pages.collect():
        body = re.search(r"<article>(.*)</article>", r["html"], re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"</?b>|<br>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", body)]
        want = "\n".join(x for x in parts if x)
        assert got[r["page_id"]]["text"] == want and got[r["page_id"]]["n_chars"] == len(want) and got[r["page_id"]]["url"] == r["url"]


def test_edge_rows(spark):
    rows = [(1, "u", None, 1), (None, None, f"<article>{P}</article>", 2), (2, "u", "", 3), (2, "u", "", 3), (3, "u", f"<p>{P} </p>" * 5000, 4)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = sorted((str(r["page_id"]), r["url"], r["n_chars"]) for r in html_text.extract(df).collect())
    assert got == [("1", "u", 0), ("2", "u", 0), ("2", "u", 0), ("3", "u", 5000 * (len(P) + 1) - 1), ("None", None, len(P))]
    assert html_text.extract(df.limit(0)).count() == 0


def test_short_blocks_of_the_article_stay(tree):
    """One-word blocks at the start, between long ones and at the end, whatever marks the container."""
    body = ["Yes.", P, "No.", "So it is.", P, P, "Hm.", "Well then.", P, "End."]
    inner = "".join(f"<p>{x}</p>" for x in body)
    for start, end in (("<article>", "</article>"), ("<main>", "</main>"), ("<div class=entry-content>", "</div>")):
        for before in ("", f"<nav><a href=x>Home</a></nav><div class=ad>{P}</div>", f"<header><p>{P}</p></header>"):
            for after in ("", f"<footer>{P}</footer>", f"<div id=comments><p>{P}</p><p>Nice.</p></div>"):
                assert html_text.main_text(before + start + inner + end + after, tree) == "\n".join(body)


def test_words_and_links_tell_where_nothing_is_marked(tree):
    """No container, class or id that says anything: words and link density of a block and its neighbours decide."""
    menu = "".join(f"<div><a href={i}>Item {i}</a></div>" for i in range(8))
    page = f"{menu}<div>{P} {P}</div><div>{P} {P}</div><div>Indeed.</div><div>{P} {P}</div>{menu}<div>All mine</div><div>2020</div>"
    assert html_text.main_text(page, tree) == f"{P} {P}\n{P} {P}\nIndeed.\n{P} {P}"
    links = "".join(f"<a href={i}>some linked words in a row</a> " for i in range(10))
    assert html_text.main_text(f"<div>{P} {P}</div><div>{links}</div><div>{P} {P}</div>", tree) == f"{P} {P}\n{P} {P}"


def test_long_pages_in_linear_time():
    import time
    for make in (lambda n: "<div>" * n + "</p>" * n + "</section>" * n, lambda n: "<head>" * n, lambda n: "<div>" * n + "</div>" * n,
                 lambda n: "<a '>" * n, lambda n: "<script>" * n, lambda n: "<p>x</q>" * n):
        t = time.perf_counter()
        html_text.blocks(make(100_000))
        assert time.perf_counter() - t < 10


def test_references():
    assert html_text.decoded("&#65;&#00000000000065;&#x41;&amp;&#" + "9" * 9000 + ";&#" + "0" * 9000 + "66;&nosuch;") == "AAA&\ufffdB&nosuch;"
