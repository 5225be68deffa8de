"""Main text of web pages from flat text blocks.

A page is cut into flat blocks at block-level tags, open or close; a tree is
never built, so broken markup costs nothing. Each block has its word count and
link density, those of its neighbours, and what its open containers say (a
``nav`` or ``footer``, an ``article``, class and id words). A decision tree,
trained with Spark ML on a small labelled table of layouts made by a rule
below, tells main text from the rest. The tree is a handful of thresholds; a
page is classified where it is read, and nothing is shuffled.

Text: character references decoded, white space inside a block (``br`` too)
turned into one space, trimmed, blocks joined by one line feed. Nothing is
capped. Headings inside the article belong to it.

Defined results: null or empty html gives ''; unclosed tags and comments end
with the page; end tags of what isn't open are passed over, so long pages take
linear time; a numeric reference to no character is U+FFFD; repeated rows are
extracted each; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession

#: Comments, declarations, and tags (attribute values in quotes may hold ">").
_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<end2>/?)(?P<name2>[A-Za-z][^\s/>]*+)[^>]*+(?:>|\Z)", re.S)
_HEAD_END = re.compile(r"</head\s*+>|(?=<body\b)", re.I)
_HINT = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_WORDS = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")
#: A decimal reference of more digits than any character has.
_LONG_NUMBER = re.compile(r"&#0*+([0-9]+)")

# Fixed values of HTML.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp "
                   "small span strike strong sub sup time tt u var wbr br".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title svg iframe object select head".split())
OUTSIDE = frozenset("nav footer aside form menu dialog button fieldset noscript".split())
MAIN = frozenset("article main".split())
#: Words in class, id and role that mark what isn't the article.
NEGATIVE = frozenset(
    "ad ads adv advert adverts advertisement advertising alert banner breadcrumb breadcrumbs byline comment comments commentary "
    "consent cookie cookies copyright disclaimer discussion disqus feedback footer form gdpr header hidden login masthead menu "
    "menubar modal nav navbar navigation newsletter notice notification pager pagination popup promo promoted promotion "
    "recommended related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe "
    "subscription tags toolbar topbar widget complementary contentinfo".split())
POSITIVE = frozenset("article body content entry main post story text".split())

FEATURES = ("outside", "inside", "hint", "heading", "words", "words_before", "words_after",
            "links", "links_before", "links_after")


@dataclass
class Block:
    text: str
    words: int
    links: float
    outside: int
    inside: int
    hint: int
    heading: int


def _hints(attrs: str) -> int:
    """-1, 0 or 1: what class, id and role say of a container."""
    said = 0
    for m in _HINT.finditer(attrs):
        words = {w.lower() for w in _WORDS.findall(m[1] or m[2] or m[3] or "")}
        if words & NEGATIVE:
            return -1
        said = said or int(bool(words & POSITIVE))
    return said


def decoded(text: str) -> str:
    """Character references decoded; a number that no character has, however long, is U+FFFD."""
    if "&#" in text:
        text = _LONG_NUMBER.sub(lambda m: "&#" + (m[1] if len(m[1]) < 8 else "1114112"), text)
    return html.unescape(text)


def blocks(page: str | None) -> list[Block]:
    """The flat text blocks of a page in page order, in time linear in the page:
    an end tag that nothing open matches costs one look at a counter."""
    page = page or ""
    out: list[Block] = []
    stack: list[tuple[str, int, int, int]] = [("", 0, 0, 0)]     # name, outside, inside, hint
    opened: Counter[str] = Counter()                             # of the names in the stack
    head_ends = True
    text: list[str] = []
    link_text: list[str] = []
    link, heading, at = 0, 0, 0

    def close() -> None:
        nonlocal text, link_text
        flat = " ".join(decoded("".join(text)).split())
        if flat:
            words = flat.count(" ") + 1
            linked = len(decoded("".join(link_text)).split())
            _, outside, inside, hint = stack[-1]
            out.append(Block(flat, words, min(1.0, linked / words), outside, inside, hint, heading))
        text, link_text = [], []

    def add(s: str) -> None:
        if s:
            text.append(s)
            if link:
                link_text.append(s)
            elif link_text and link_text[-1] != " ":
                link_text.append(" ")

    while at < len(page):
        m = _TAG.search(page, at)
        if m is None:
            add(page[at:])
            break
        add(page[at:m.start()])
        at = m.end()
        name = m["name"] or m["name2"]
        if name is None:
            continue
        name, ends, attrs = name.lower(), bool(m["end"] or m["end2"]), m["attrs"] or ""
        if name == "br":
            add(" ")
            continue
        if name in INLINE:
            if name == "a":
                link = 0 if ends else 1
            continue
        close()
        link = 0
        if name[0] == "h" and len(name) == 2 and name[1].isdigit():
            heading = 0 if ends else 1
        elif name != "hr":
            heading = 0 if name in ("p", "div", "article", "section", "body") else heading
        if ends:
            while opened[name]:
                last = stack.pop()[0]
                opened[last] -= 1
                if last == name:
                    break
        elif name == "head":
            # "head" has no text of its own; it ends where the body begins at the latest.
            end = _HEAD_END.search(page, at) if head_ends else None
            head_ends = end is not None
            at = end.end() if end else at
        elif name in RAW:
            end = re.compile(rf"</{re.escape(name)}\b[^>]*+(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else len(page)
        elif name not in VOID and name != "p" and not attrs.endswith("/"):
            _, outside, inside, hint = stack[-1]
            said = _hints(attrs) if attrs else 0
            if name in MAIN and said >= 0 and not (inside and (outside or hint < 0)):
                outside, inside, hint = 0, 1, 0
            elif name in OUTSIDE or name == "header" and not inside:
                outside = 1
            if said < 0 and name not in ("html", "body"):
                hint = -1
            elif said > 0 and hint == 0:
                hint = 1
            stack.append((name, outside, inside, hint))
            opened[name] += 1
    close()
    return out


def features(found: list[Block]) -> list[tuple[float, ...]]:
    """One row of ``FEATURES`` for each block."""
    at = lambda i: found[i] if 0 <= i < len(found) else None
    words = lambda b: float(b.words) if b else 0.0
    links = lambda b: float(b.links) if b else 1.0
    return [(float(b.outside), float(b.inside), float(b.hint), float(b.heading), words(b), words(at(i - 1)), words(at(i + 1)),
             links(b), links(at(i - 1)), links(at(i + 1))) for i, b in enumerate(found)]


def labelled_pages() -> list[tuple[str, list[int]]]:
    """The labelled table: layouts by rule, each block with 1 (article) or 0."""
    w = lambda n: " ".join(["word"] * n)
    a = lambda n: " ".join(f'<a href="/x">{x}</a>' for x in ["link"] * n)
    around = [
        ('<nav><ul><li>{l1}</li><li>{l1}</li></ul></nav><div class="ad">{t12}</div>', [0, 0, 0], '<footer>{t9}</footer>', [0]),
        ('<header><h1>{t2}</h1><p>{t6}</p></header>', [0, 0], '<aside><p>{t30}</p></aside><footer>{t40}</footer>', [0, 0]),
        ('<div id="menu">{l4}</div><div class="cookie notice">{t45}</div>', [0, 0],
         '<section class="comments"><h3>{t1}</h3><p>{t25}</p><p>{t60}</p></section>', [0, 0, 0]),
        ('<form><label>{t3}</label></form><div class="sidebar"><p>{t20}</p></div>', [0, 0], '<div class="related">{l6}</div>', [0]),
        ('<ul><li>{l1}</li><li>{l2}</li><li>{l1}</li></ul>', [0, 0, 0], '<div>{l3}</div><p>{l5}</p>', [0, 0]),
        ('<div>{t3}</div><p>{t5}</p><p>{t1}</p>', [0, 0, 0], '<div>{t4}</div><p>{t6}</p><div>{t2}</div>', [0, 0, 0]),
    ]
    # (opening, labels there, closing, labels there, whether anything marks the container)
    inner = [
        ("<article>", [], "</article>", [], 1), ("<main><h1>{t7}</h1>", [1], "</main>", [], 1),
        ('<div class="content">', [], "</div>", [], 1), ("<div>", [], "</div>", [], 0), ("<table><tr><td>", [], "</td></tr></table>", [], 0),
        ('<article><div class="ad">{t40}</div><ul><li>{l1}</li><li>{l4}</li></ul>', [0, 0, 0],
         '<section class="comments"><p>{t50}</p><p>{t4}</p></section><footer>{t30}</footer></article>', [0, 0, 0], 1),
        ('<main><aside>{t25}</aside><form><p>{t18}</p></form>', [0, 0], '<div class="share">{l3}</div></main>', [0], 1),
        ('<div class="post"><div class="notice">{t60}</div>', [0], '<p>{l6}</p><div id="comments"><p>{t45}</p></div></div>', [0, 0], 1),
        ("<div><p>{l20}</p>", [0], "<p>{l40}</p></div>", [0], 0),
    ]
    # Short blocks at the start, between long ones, next to each other and at the end; a page of one block.
    lengths = [(1, 40, 3), (80, 120, 60), (15, 2, 200), (300,), (6, 35, 1, 28), (1,), (5,), (12,), (2, 3), (40, 4), (4, 60),
               (90, 1, 2, 1, 50), (27, 26, 6, 5, 4, 3, 2, 1), (3, 2, 8, 30, 5), (20, 5, 6, 33, 2, 140, 1), (9, 9, 9), (3, 250, 6, 3, 26, 4)]
    between = [(30, 30), (60, 5, 40), (25, 1, 80, 3, 120), (150, 12, 45), (33, 2, 2, 41), (300,), (45, 45, 45), (22, 70)]
    fill = {f"t{n}": w(n) for n in range(1, 61)} | {f"l{n}": a(n) for n in range(1, 41)}
    out = []
    for before, b, after, c in around:
        for start, s, end, e, marked in inner:
            # Where nothing marks the container, words and links tell: short text belongs to the article between long blocks only.
            for ns in lengths if marked else between:
                paragraphs = [f"<p>{w(n)}</p>" for n in ns]
                if marked and len(ns) > 2:      # a heading may link to its own page
                    paragraphs[0] = f"<h2>{a(ns[0])}</h2>" if ns[0] < 10 else paragraphs[0]
                page = "".join((before, start, "{body}", end, after)).format(body="".join(paragraphs), **fill)
                out.append((page, [*b, *s, *[1] * len(ns), *e, *c]))
    return out


def train(spark: SparkSession, depth: int = 9) -> tuple:
    """The tree as nested (feature, threshold, left, right) or a leaf's 0.0 / 1.0."""
    rows = [(*f, float(y)) for page, labels in labelled_pages() for f, y in zip(features(blocks(page)), labels, strict=True)]
    data = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in (*FEATURES, "label"))).coalesce(1)
    data = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(data)
    model = DecisionTreeClassifier(maxDepth=depth, maxBins=256, seed=1).fit(data)

    def nested(node):
        if node.getClass().getSimpleName() == "LeafNode":
            return float(node.prediction())
        s = node.split()
        return (int(s.featureIndex()), float(s.threshold()), nested(node.leftChild()), nested(node.rightChild()))

    return nested(model._call_java("rootNode"))


def _is_main(tree, row: tuple[float, ...]) -> bool:
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree > 0.5


def main_text(page: str | None, tree) -> str:
    found = blocks(page)
    return "\n".join(b.text for b, f in zip(found, features(found)) if _is_main(tree, f))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars: one row per row of ``pages``."""
    tree = train(pages.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            text = [main_text(None if pd.isna(x) else x, tree) for x in b["html"].array]
            yield pd.DataFrame({"page_id": pd.array(b["page_id"], dtype="Int64"), "url": b["url"], "text": text,
                                "n_chars": [len(t) for t in text]})

    return pages.select("page_id", "url", "html").mapInPandas(run, "page_id long, url string, text string, n_chars long")
