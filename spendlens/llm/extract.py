"""Main text of web pages by boosted trees over the nodes of the element tree.

The trees judge whether everything below a node is main text, from its tag, the words of its attributes, the
density of text and links in its subtree, its depth, and its siblings. Decoding takes the likeliest choice for
the whole page in which nothing below a chosen node is left out: a choice for a node is one for all below it.
Links, emphasis and text of one run are no choices of their own: the run is chosen or left as a whole.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendlens.llm.dom import INLINE, Page
from spendlens.llm.registry import query, table
from spendlens.llm.trees import Boosted, fit
from spendlens.session import cut_lineage

SAMPLE = 160  # different pages that name their article, from which the trees are fitted
NATURAL = 3  # times that the rows of a page as it is count beside those of its other layouts
LONG = 100  # characters of a text that fills the place of an article, where no page names one

GOOD = frozenset("article articlebody main content body text post entry story page blog prose paragraph lead headline".split())
BAD = {
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs tabs toc skip pagination pager toolbar",
    "edge": "header masthead topbar footer foot bottom copyright colophon branding logo legal",
    "side": "sidebar aside side rail widget related recommended more trending popular tags",
    "notice": "cookie cookies consent gdpr notice banner alert popup modal overlay newsletter subscribe signup paywall",
    "advert": "ad ads advert advertisement adverts promo promotion sponsor sponsored affiliate dfp",
    "form": "form login search comment-form input button submit register contact",
    "talk": "comment comments reply replies respond discussion disqus thread reviews share sharing social follow",
}
BAD = {name: frozenset(words.split()) for name, words in BAD.items()}
TAGS = {
    "t_text": ("#text",),
    "t_article": ("article", "main"),
    "t_nav": ("nav", "menu"),
    "t_header": ("header",),
    "t_footer": ("footer", "address"),
    "t_aside": ("aside",),
    "t_form": ("form", "button", "label", "fieldset", "input", "output"),
    "t_p": ("p", "blockquote", "pre", "figcaption"),
    "t_head": ("h1", "h2", "h3", "h4", "h5", "h6"),
    "t_list": ("ul", "ol", "dl", "li", "dt", "dd"),
    "t_table": ("table", "tbody", "thead", "tr", "td", "th"),
    "t_box": ("div", "section", "center"),
    "t_link": ("a",),
    "t_page": ("#root", "html", "body"),
}
_TAG_SLOT = {tag: i for i, tags in enumerate(TAGS.values()) for tag in tags}
NAMES = [
    *TAGS,
    "good",
    *BAD,
    *(f"above_{name}" for name in ("good", *BAD)),
    "above_article",
    "above_edge_tag",
    "inline",
    "depth",
    "chars",
    "link_share",
    "tags_per_char",
    "stops_per_char",
    "paragraphs",
    "mean_run",
    "share_of_parent",
    "share_of_page",
    "place",
    "siblings",
    "same_siblings",
    "sibling_index",
    "before_chars",
    "after_chars",
    "parent_link_share",
]
_EDGE_TAGS = frozenset("nav header footer aside form button menu address".split())
_ALL_BAD = frozenset().union(*BAD.values())
_LABEL = "data-main"


def node_features(page: Page) -> np.ndarray:
    """One row per node, columns as NAMES."""
    n = len(page.tag)
    parent = page.parent
    own = np.zeros((n, 6))  # characters, characters in links, elements, full stops, paragraphs, runs
    place = np.zeros(n)
    total = 0
    in_link = [False] * n
    for i in range(1, n):
        in_link[i] = page.tag[i] == "a" or in_link[parent[i]]
        place[i] = total
        if page.tag[i] == "#text":
            text = page.text[i]
            size = len(text.strip())
            total += size
            own[i] = (size, size * in_link[i], 0, text.count(". ") + text.endswith("."), 0, 1)
        else:
            own[i, 2] = 1
            own[i, 4] = page.tag[i] == "p"
    below = own.copy()
    for i in range(n - 1, 0, -1):
        below[parent[i]] += below[i]
    out = np.zeros((n, len(NAMES)))
    at = {name: j for j, name in enumerate(NAMES)}
    groups = [GOOD, *BAD.values()]
    first = at["good"]
    above = at["above_good"]
    depth = np.zeros(n)
    children: list[list[int]] = [[] for _ in range(n)]
    for i in range(n):
        if i:
            children[parent[i]].append(i)
            depth[i] = depth[parent[i]] + 1
            up = parent[i]
            out[i, above : above + len(groups)] = np.maximum(
                out[up, above : above + len(groups)], out[up, first : first + len(groups)]
            )
            out[i, at["above_article"]] = out[up, at["above_article"]] or page.tag[up] in ("article", "main")
            out[i, at["above_edge_tag"]] = out[up, at["above_edge_tag"]] or page.tag[up] in _EDGE_TAGS
        slot = _TAG_SLOT.get(page.tag[i])
        if slot is not None:
            out[i, slot] = 1
        words = page.words[i]
        if words:
            for j, group in enumerate(groups):
                out[i, first + j] = not words.isdisjoint(group)
        out[i, at["inline"]] = page.tag[i] in INLINE
    chars = below[:, 0]
    safe = np.maximum(chars, 1)
    up = np.maximum(np.array(parent), 0)
    out[:, at["depth"]] = depth
    out[:, at["chars"]] = np.log1p(chars)
    out[:, at["link_share"]] = below[:, 1] / safe
    out[:, at["tags_per_char"]] = below[:, 2] / safe
    out[:, at["stops_per_char"]] = below[:, 3] / safe
    out[:, at["paragraphs"]] = np.log1p(below[:, 4])
    out[:, at["mean_run"]] = np.log1p(chars / np.maximum(below[:, 5], 1))
    out[:, at["share_of_parent"]] = chars / np.maximum(chars[up], 1)
    out[:, at["share_of_page"]] = chars / max(total, 1)
    out[:, at["place"]] = place / max(total, 1)
    out[:, at["parent_link_share"]] = out[up, at["link_share"]]
    for group in children:
        seen: dict[str, int] = {}
        for i in group:
            seen[page.tag[i]] = seen.get(page.tag[i], 0) + 1
        sizes = np.log1p(chars[group])
        for k, i in enumerate(group):
            out[i, at["siblings"]] = len(group)
            out[i, at["same_siblings"]] = seen[page.tag[i]]
            out[i, at["sibling_index"]] = k / len(group)
            out[i, at["before_chars"]] = sizes[k - 1] if k else 0
            out[i, at["after_chars"]] = sizes[k + 1] if k + 1 < len(group) else 0
    return out


def runs(page: Page) -> tuple[np.ndarray, list[list[int]]]:
    """Nodes that are no choice of their own, and the groups of siblings that are chosen together.

    Below an element of text and inline elements only, nothing is a choice; neither is what lies below an inline
    element. Beside block elements, neighbouring text and inline elements form a group. An inline element that names
    itself something else (an advert) stays a choice.
    """
    n = len(page.tag)
    children: list[list[int]] = [[] for _ in range(n)]
    for i in range(1, n):
        children[page.parent[i]].append(i)
    flat = [
        page.tag[i] == "#text"
        or page.tag[i] in INLINE
        and (page.words[i].isdisjoint(_ALL_BAD) or not page.words[i].isdisjoint(GOOD))
        for i in range(n)
    ]
    tied, groups = np.zeros(n, dtype=bool), []
    for i in range(n - 1, -1, -1):  # flat only if all below is
        flat[i] = flat[i] and all(flat[c] for c in children[i])
    for i in range(n):
        whole = i > 0 and (tied[i] or flat[i] or all(flat[c] for c in children[i]))
        if whole:
            tied[[c for c in children[i] if flat[c]]] = True
            continue
        group: list[int] = []
        for c in [*children[i], 0]:
            if c and flat[c]:
                group.append(c)
            elif group:
                groups.append(group)
                group = []
    return tied, groups


def decoded(page: Page, margins: np.ndarray) -> list[bool]:
    """Chosen nodes of the likeliest consistent labelling: all below a chosen node is chosen, a run is one choice."""
    n = len(page.tag)
    tied, groups = runs(page)
    margins = np.where(tied, 0.0, margins)
    for group in groups:
        size = np.array([1.0 + sum(len(page.text[j]) for j in _below(page, i)) for i in group])
        margins[group] = (margins[group] * size).sum() / size.sum()
    yes, no = -np.logaddexp(0, -margins), -np.logaddexp(0, margins)
    all_in, best = yes.copy(), no.copy()  # of a node's subtree: everything chosen; the node itself not
    for i in range(n - 1, 0, -1):
        up = page.parent[i]
        all_in[up] += all_in[i]
        best[up] += best[i] if tied[i] else max(all_in[i], best[i])
    kept = [False] * n
    for i in range(n):
        above = i > 0 and kept[page.parent[i]]
        kept[i] = above or (not tied[i] and bool(all_in[i] > best[i]))
    return kept


def _below(page: Page, top: int) -> Iterable[int]:
    """A node and all below it; nodes are in the order of the page."""
    yield top
    inside = {top}
    for j in range(top + 1, len(page.tag)):
        if page.parent[j] not in inside:
            return
        inside.add(j)
        yield j


def page_text(page: Page, margins: np.ndarray) -> str:
    return "\n".join(page.blocks(decoded(page, margins)))


def _guess(page: Page) -> list[bool] | None:
    """Main runs of a page that names its article: inside it and in no part that names itself something else."""
    n = len(page.tag)
    inside, off = [False] * n, [False] * n
    for i in range(1, n):
        up = page.parent[i]
        bad = any(not page.words[i].isdisjoint(g) for g in BAD.values()) and page.words[i].isdisjoint(GOOD)
        inside[i] = inside[up] or page.tag[i] == "article"
        off[i] = off[up] or page.tag[i] in _EDGE_TAGS or bad
    if not any(inside):
        return None
    return [a and not b for a, b in zip(inside, off)]


#: Ways to lay a page out: what holds the article, and the boxes around and inside it.
LAYOUTS = [
    ('<div class="content"><div class="post entry">', "</div></div>"),
    ('<main id="main"><section class="story">', "</section></main>"),
    ('<div id="wrapper"><div class="col">', "</div></div>"),
    ("<article>", "</article>"),
    ('<table><tr><td class="text">', "</td></tr></table>"),
    ('<div class="page"><article class="article-body">', "</article></div>"),
    ("<div class='post'>", "</div>"),
    ("<div>", "</div>"),
    ("", ""),
]
INLINES = ["a href='/x'", "a href='https://example.org/y' class='link'", "b", "em", "strong", "i", "code", "span", "sup", "q"]
BOXES = [
    ("before", '<header class="masthead"><h1>{0}</h1><p>{1}</p></header>'),
    ("before", '<div class="header"><a href="/">{0}</a><ul class="menu"><li><a href="/a">{1}</a></li></ul></div>'),
    ("before", '<nav class="breadcrumbs"><a href="/">{0}</a> / <a href="/b">{1}</a></nav>'),
    ("before", '<nav><a href="/">{0}</a></nav>'),
    ("before", '<nav><a href="/">{0}</a> <a href="/a">{1}</a> <a href="/b">{2}</a></nav>'),
    ("before", '<header>{0}</header>'),
    ("after", "<footer>{0}</footer>"),
    ("after", '<aside><h3>{0}</h3><ul><li><a href="/r">{1}</a></li><li><a href="/s">{2}</a></li></ul></aside>'),
    ("before", '<ul id="nav"><li><a href="/1">{0}</a></li><li><a href="/2">{1}</a></li></ul>'),
    ("before", '<div class="cookie-notice"><p>{0} {1}</p><button>{2}</button></div>'),
    ("before", '<div class="notice"><p>{0}</p></div>'),
    ("inside", '<div class="ad"><p>{0}</p></div>'),
    ("inside", '<div class="advert">{0} <a href="/x">{1}</a></div>'),
    ("inside", '<aside class="related"><h3>{0}</h3><ul><li><a href="/r">{1}</a></li></ul></aside>'),
    ("inside", '<form action="/s"><label>{0}</label><input name="q"><button>{1}</button></form>'),
    ("inside", '<div class="share social"><a href="/f">{0}</a></div>'),
    ("inside", '<section class="comments"><p>{0}</p><p>{1}</p></section>'),
    ("inside", '<div class="comment-list"><div class="comment"><p>{0}</p></div><div class="comment"><p>{1} {2}</p></div></div>'),
    ("inside", '<div class="notice"><p>{0} {1}</p></div>'),
    ("inside", '<div class="sidebar"><p>{0}</p><p>{1}</p></div>'),
    ("inside", '<nav class="toc"><ul><li><a href="#a">{0}</a></li><li><a href="#b">{1}</a></li></ul></nav>'),
    ("inside", '<footer class="meta"><p>{0}</p></footer>'),
    ("after", '<aside class="sidebar"><h2>{0}</h2><p>{1}</p><p>{2}</p></aside>'),
    ("after", '<div class="sidebar"><div class="widget"><h4>{0}</h4><p>{1}</p></div></div>'),
    ("after", '<section class="comments"><h2>{0}</h2><div class="comment"><p>{1}</p></div><div class="comment"><p>{2}</p></div></section>'),
    ("after", '<div id="comments"><ol><li><p>{0} {1}</p></li><li><p>{2}</p></li></ol></div>'),
    ("after", '<form class="newsletter"><p>{0}</p><input type="email"><button>{1}</button></form>'),
    ("after", '<footer><p>{0}</p><a href="/i">{1}</a></footer>'),
    ("after", '<div class="footer"><p>&copy; {0} {1}</p></div>'),
]


def _escape(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;")


def _dressed(text: str, rng: np.random.Generator) -> str:
    """A text with some of its words in links, emphasis and code, and some line breaks."""
    words = [_escape(w) for w in text.split(" ")]
    for _ in range(int(rng.integers(0, 4))):
        at = int(rng.integers(len(words)))
        last = min(len(words), at + int(rng.integers(1, 6))) - 1
        tag = INLINES[rng.integers(len(INLINES))]
        words[at], words[last] = f"<{tag}>{words[at]}", words[last]
        words[last] += f"</{tag.split()[0]}>"
    if rng.random() < 0.1:
        words.insert(int(rng.integers(len(words) + 1)), "<br>")
    return " ".join(words)


def _block(text: str, first: bool, rng: np.random.Generator) -> str:
    """A labelled block: heading, paragraph, list, quote, code, table or box."""
    mark, draw = f'{_LABEL}="1"', rng.random()
    parts = [p for p in text.split(". ") if p]
    if len(text) < 200 and (first or draw < 0.1):
        tag = f"h{1 if first else int(rng.integers(2, 5))}"
        return f"<{tag} {mark}>{_escape(text)}</{tag}>"
    if draw < 0.22 and len(parts) > 1:
        tag = ("ul", "ol")[rng.integers(2)]
        linked = rng.random() < 0.2
        items = [f"<a href='/z'>{_escape(p)}</a>" if linked and rng.random() < 0.5 else _dressed(p, rng) for p in parts]
        return f"<{tag} {mark}>" + "".join(f"<li>{item}</li>" for item in items) + f"</{tag}>"
    if draw < 0.3 and len(parts) > 1:
        rows = "".join(f"<tr><td>{_dressed(p, rng)}</td><td>{_escape(p.split(' ')[0])}</td></tr>" for p in parts)
        return f"<table {mark}>{rows}</table>"
    if draw < 0.36:
        return f"<blockquote {mark}><p>{_dressed(text, rng)}</p></blockquote>"
    if draw < 0.4:
        return f"<pre {mark}><code>{_escape(text)}</code></pre>"
    if draw < 0.46:
        return f"<div {mark}>{_dressed(text, rng)}</div>"
    if draw < 0.5:
        return f"<figure {mark}><img src=x><figcaption>{_dressed(text, rng)}</figcaption></figure>"
    return f"<p {mark}>{_dressed(text, rng)}</p>"


def layouts(page: Page, main: list[bool], seed: int, times: int) -> list[str]:
    """The page's own texts laid out in other ways, with the label of every part in an attribute."""
    rng = np.random.Generator(np.random.PCG64([31, seed]))
    blocks = page.blocks([m and t == "#text" for m, t in zip(main, page.tag)])
    other = page.blocks([not m and t == "#text" for m, t in zip(main, page.tag)])
    pool = [s for b in (*other, *blocks) for s in b.split(". ") if s]
    if not blocks or not pool:
        return []
    out = []
    for _ in range(times):
        opening, closing = LAYOUTS[rng.integers(len(LAYOUTS))]
        begin = int(rng.integers(len(blocks))) if rng.random() < 0.3 else 0
        some = blocks[begin : begin + 1 + int(rng.integers(0, 3 if rng.random() < 0.3 else 40))]
        body = [_block(b, begin + i == 0, rng) for i, b in enumerate(some)]
        bare = rng.random() < 0.2  # a page without any frame
        sides: dict[str, list[str]] = {"before": [], "after": []}
        for k in rng.permutation(len(BOXES))[: 0 if bare else int(rng.integers(2, 10))]:
            where, box = BOXES[k]
            words = [pool[rng.integers(len(pool))].split(" ") for _ in range(3)]
            short = rng.random() < 0.5
            filled = box.format(*[_escape(" ".join(w[: int(rng.integers(1, 4))] if short else w)) for w in words])
            filled = f'<div {_LABEL}="0">{filled}</div>' if rng.random() < 0.3 else filled.replace(">", f' {_LABEL}="0">', 1)
            if where == "inside":
                body.insert(int(rng.integers(1, len(body) + 1)), filled)
            else:
                sides[where].append(filled)
        inner = "".join(body)
        out.append(f"<html><body>{''.join(sides['before'])}{opening}{inner}{closing}{''.join(sides['after'])}</body></html>")
    return out


def labelled_rows(page: Page, main_run: list[bool]) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the nodes with text: whether all of it is main text."""
    n = len(page.tag)
    size = np.array([len(t.strip()) if tag == "#text" else 0 for t, tag in zip(page.text, page.tag)], dtype=float)
    good = size * np.array(main_run, dtype=float)
    for i in range(n - 1, 0, -1):
        size[page.parent[i]] += size[i]
        good[page.parent[i]] += good[i]
    has = (size > 0) & ~runs(page)[0]
    return node_features(page)[has], (good >= size)[has]


def _training(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    for batch in batches:
        for source, seed in zip(*(c.to_pylist() for c in batch.columns)):
            page = Page(source)
            main = _guess(page)
            made = [] if main is None else [labelled_rows(page, main)] * NATURAL
            if main is None and "<article" in source.lower():
                continue
            if main is None:  # no label for the page, but its longer texts fill layouts that have one
                main = [len(t) >= LONG or page.tag[up] == "h1" for t, up in zip(page.text, page.parent)]
            for text in layouts(page, main, seed & 0xFFFFFFFF, 6):
                other = Page(text, mark=_LABEL)
                made.append(labelled_rows(other, [m == "1" for m in other.mark]))
            if not made:
                continue
            x = np.concatenate([a for a, _ in made])
            y = np.concatenate([b for _, b in made])
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(x[:, j]) for j in range(x.shape[1])), pa.array(y.astype(np.int32)), pa.array(np.full(len(y), seed))],
                names=[*NAMES, "label", "seed"],
            )


def _once(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    """The first row of each seed in a task."""
    seen: set[int] = set()
    for batch in batches:
        new = [seed not in seen and not seen.add(seed) for seed in batch.column(1).to_pylist()]
        yield batch.filter(pa.array(new, pa.bool_()))


def _first(rows: DataFrame, n: int) -> tuple[int, int | None]:
    """How many of the n least different seeds there are, and the largest of them."""
    return tuple(rows.select("seed").distinct().orderBy("seed").limit(n).agg(F.count("seed"), F.max("seed")).first())


def learn(pages: DataFrame, html: str = "html", sample: int = SAMPLE) -> Boosted | None:
    """Fit on `sample` different pages that name their article, first by a hash of their source, or all if fewer.

    Each is used as it is and with its texts laid out in other ways, so that tags alone do not decide. Pages that
    mention an article but give no label are made up for by further ones. Where no page names its article, the texts
    of other pages fill the layouts and the pages themselves have no label. Without any long text nothing is learned.
    """
    given = pages.select(F.col(html).cast("string").alias("html")).where("html is not null")
    named = given.where(F.col("html").rlike(r"(?i)<article[\s/>]"))
    made = _made(named, sample)
    if made is None:
        made = _made(given.where(~F.col("html").rlike("(?i)<article")), sample)
    if made is None:
        return None
    labels = {r[0] for r in made.select("label").distinct().toLocalIterator()}
    if labels != {0, 1}:
        return None
    return fit(made, NAMES, rounds=24, depth=4)


def _made(rows: DataFrame, sample: int) -> DataFrame | None:
    """Labelled rows of `sample` different pages that give any."""
    rows = rows.select("html", F.xxhash64("html").alias("seed"))
    schema = ", ".join([*(f"{name} double" for name in NAMES), "label int", "seed long"])
    tried = sample
    while True:
        tries, last = _first(rows, tried)
        if not tries:
            return None
        picked = rows.where(F.col("seed") <= last).mapInArrow(_once, "html string, seed long")
        picked = picked.repartition(8, "seed").dropDuplicates(["seed"])
        made = cut_lineage(picked.mapInArrow(_training, schema))
        found, last = _first(made, sample)
        if found == sample or tries < tried:
            break
        tried *= 8
    return made.where(F.col("seed") <= last).drop("seed") if found else None


def _extracted(shared):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        trees = shared.value
        for batch in batches:
            texts: list[str] = []
            for at in range(0, batch.num_rows, 64):
                pages = [Page(s or "") for s in batch.column(2).slice(at, 64).to_pylist()]
                if trees is None:
                    texts += [""] * len(pages)
                    continue
                rows = [node_features(p) for p in pages]
                margins = trees.margins(np.concatenate(rows))
                start = 0
                for page in pages:
                    texts.append(page_text(page, margins[start : start + len(page.tag)]))
                    start += len(page.tag)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"]
            )

    return run


def main_text(pages: DataFrame, trees: Boosted | None, id_col: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row per page: page_id, url, text. Null and empty pages, and pages without main text, have ''.

    Character references are decoded, white space inside a block is one space, blocks are joined by a newline.
    """
    shared = pages.sparkSession.sparkContext.broadcast(trees)
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string")
    )
    return rows.mapInArrow(_extracted(shared), "page_id long, url string, text string")


@query("op9_boosted_dom_extraction")
def op9_boosted_dom_extraction(spark, sf):
    pages = table(spark, sf, "pages")
    return main_text(pages, learn(pages)).withColumn("n_chars", F.length("text").cast("long"))
