"""Pages of minutes, reports and speeches to marked-up text, a page a row.

The page is read once into a small tree; what is not text of the document is
cut off, and the rest is told line by line with the marks that the section
parser knows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import normalise_text
from millrace.sources.shared import small_batches

EMPTY = set("area base br col embed hr img input link meta source track wbr".split())
CLOSES = {"p": {"p"}, "li": {"li", "p"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
ENDS_P = set("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
#: Elements that a start tag leaves no element beyond; an item's does beyond items.
WALLS = {"ul", "ol", "table", "div", "li"}
CUT = [("div", "img-block"), ("div", "footnotes-container"), ("nav", "nav-chapters"), ("div", "pdf-form")]
# Lines that belong to a chart.
CAPTIONS = [r"(?i)^\s*Sources?\s*:", r"(?i)^\s*Notes?\s*:", r"^\s*\([a-z]\)\s"]
OUT = "text string, title string, speaker string, published string, error string"


@dataclass(eq=False)
class Node:
    name: str
    attrs: dict = field(default_factory=dict)
    parent: Node | None = None
    items: list = field(default_factory=list)
    gone: bool = False

    def kept(self) -> Iterator[Node | str]:
        """What is in this element, the last first, without what was dropped."""
        return (x for x in reversed(self.items) if not isinstance(x, Node) or not x.gone)

    def all(self) -> Iterator[Node]:
        """Elements below this one, in order."""
        todo = [x for x in self.kept() if isinstance(x, Node)]
        while todo:
            x = todo.pop()
            yield x
            todo.extend(y for y in x.kept() if isinstance(y, Node))

    def under(self, *tests: Callable[[Node], bool]) -> Iterator[tuple[Node, list[bool]]]:
        """Elements below this one, in order, and which of the tests an element above each passes."""
        here = [any(test(a) for a in (self, *self.above())) for test in tests]
        todo = [(x, here) for x in self.kept() if isinstance(x, Node)]
        while todo:
            x, here = todo.pop()
            yield x, here
            own = [a or test(x) for a, test in zip(here, tests, strict=True)]
            todo.extend((y, own) for y in x.kept() if isinstance(y, Node))

    def strings(self) -> Iterator[str]:
        todo = list(self.kept())
        while todo:
            x = todo.pop()
            if not isinstance(x, Node):
                yield x
            elif x.name not in ("script", "style"):
                todo.extend(x.kept())

    def text(self) -> str:
        return " ".join(filter(None, (s.strip() for s in self.strings())))

    def has(self, *classes: str) -> bool:
        return bool(set(classes) & set((self.attrs.get("class") or "").split()))

    def above(self) -> Iterator[Node]:
        x = self.parent
        while x is not None:
            yield x
            x = x.parent

    def find(self, name: str | None = None, cls: str | None = None) -> Node | None:
        return next((x for x in self.all() if (name is None or x.name == name) and (cls is None or x.has(cls))), None)

    def drop(self) -> None:
        self.gone = True


class Reader(HTMLParser):
    """Reads a page in time linear in its length: it climbs only to an element that it then leaves.

    ``open`` counts the open names; ``near`` counts those since the last
    element that a start tag doesn't look beyond, with one count for list
    items, which look beyond items, and one for all others.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("")
        self.open: Counter[str] = Counter()
        self.near: dict[bool, list[Counter[str]]] = {False: [Counter()], True: [Counter()]}

    def _walls(self, item: bool) -> set[str]:
        return WALLS - {"li"} if item else WALLS

    def _enter(self, node: Node) -> None:
        self.at = node
        self.open[node.name] += 1
        for item, scopes in self.near.items():
            if node.name in self._walls(item):
                scopes.append(Counter())
            else:
                scopes[-1][node.name] += 1

    def _leave(self, names: set[str]) -> None:
        """Leave elements up to and with the first of these names, which is known to be open."""
        while True:
            node, self.at = self.at, self.at.parent
            self.open[node.name] -= 1
            for item, scopes in self.near.items():
                if node.name in self._walls(item):
                    scopes.pop()
                else:
                    scopes[-1][node.name] -= 1
            if node.name in names:
                return

    def handle_starttag(self, tag: str, attrs: list) -> None:
        shut = CLOSES.get(tag, set()) | ({"p"} if tag in ENDS_P else set())
        if any(self.near[tag == "li"][-1][n] for n in shut):
            self._leave(shut)
        node = Node(tag, dict(attrs), self.at)
        self.at.items.append(node)
        if tag not in EMPTY:
            self._enter(node)

    def handle_endtag(self, tag: str) -> None:
        if self.open[tag] > 0:
            self._leave({tag})

    def handle_data(self, data: str) -> None:
        self.at.items.append(data)


def root_of(page: Node, kind: str) -> Node | None:
    """What holds the document: the content blocks of minutes, or the first output that has text."""
    if kind == "MPC_minutes":
        main = page.find("main")
        blocks = [x for x in main.all() if x.name == "div" and x.has("page-content")] if main else []
        return Node("div", items=blocks) if blocks else None
    return next((x for x in page.all() if x.name == "div" and x.attrs.get("id") == "output" and (x.find("h2") or x.find("p"))), None)


def tables(root: Node) -> list[str]:
    """Tables under their titles, which go from the tree with them: the title of their own image block, or else the last one before."""
    out, gone, last = [], [], None
    block_of = lambda x, block: x if x.has("img-block") else block
    todo = [(x, block_of(root, next((a for a in root.above() if a.has("img-block")), None))) for x in root.kept() if isinstance(x, Node)]
    titles: dict[int, Node | None] = {}
    while todo:
        x, block = todo.pop()
        if x.name == "table":
            if block is not None and id(block) not in titles:
                titles[id(block)] = block.find("h3", "img-title")
            title = (titles[id(block)] if block is not None else None) or last
            rows = [[c.text() for c in r.all() if c.name in ("td", "th")] for r in x.all() if r.name == "tr"]
            if any(rows):
                out.append(f"[TABLE: {title.text() if title else 'Table'}]\n" + "\n".join(" | ".join(r) for r in rows if r))
            gone += [x, *([title] if title else [])]
        last = x if x.has("img-title") else last
        own = block_of(x, block)
        todo.extend((y, own) for y in x.kept() if isinstance(y, Node))
    for x in gone:
        x.drop()
    return out


def paragraph(p: Node) -> str:
    """A paragraph of minutes: a vote, a member's statement, or plain."""
    strong = p.find("strong")
    said = strong.text() if strong else ""
    if said.lower().startswith("votes to ") and len(said) < 200:
        return f"**{said}**"
    if said.endswith(":"):
        after = strong.parent.items[strong.parent.items.index(strong) + 1 :]
        rest = "".join(x.text() if isinstance(x, Node) else x for x in after).strip()
        return f"**{said.rstrip(':')}:** {rest}".rstrip()
    return p.text()


def is_item(x: Node) -> bool:
    return x.name == "li"


def box(node: Node) -> str:
    head = node.find(cls="box__h2") or node.find("h2")
    summary = node.find("p", "text-box-highlight")
    body = [x.text() for x, (in_item,) in node.under(is_item) if x.name == "p" and x is not summary and not in_item]
    told = [f"[BOX START: {head.text() if head else 'Box'}]", f"[Summary: {summary.text()}]" if summary and summary.text() else "", *body, "[BOX END]"]
    return "\n\n".join(filter(None, told))


def lines(root: Node, kind: str) -> Iterator[str]:
    """The document's lines with their marks, in order."""
    marks = {"h2": "## ", "h3": "### "} | ({"h1": "## "} if kind == "speech" else {})
    report = kind in ("MPR", "FSR")
    is_box = lambda x: report and x.has("box-highlight")
    for x, (in_box, below_item) in root.under(is_box, is_item):
        if is_box(x) and not in_box:
            yield box(x)
        if in_box or is_box(x):
            continue
        in_item = below_item if kind != "MPC_minutes" else x.parent is not None and is_item(x.parent)
        if x.name in marks and not (report and in_item):
            told = x.text()
            yield marks[x.name] + told if told else ""
        elif x.name == "p" and not in_item or x.name == "li":
            told = paragraph(x) if kind == "MPC_minutes" and x.name == "p" else x.text()
            if kind == "speech" and any(re.match(c, told) for c in CAPTIONS):
                continue
            yield ("- " if x.name == "li" and told else "") + told


def extract(page: str | None, kind: str) -> tuple:
    """(text, title, speaker, published, error) of a page; text is null where no document is found."""
    reader = Reader()
    reader.feed(page or "")
    reader.close()
    whole = reader.root
    one = lambda x: " ".join(x.text().split()) if x else ""
    title = next((x for x in whole.all() if x.name == "h1" and x.attrs.get("itemprop") == "name"), None)
    speaker = next((x for x, within in whole.under(lambda a: a.has("med-block-cta"), lambda a: a.has("col3")) if x.name == "h3" and all(within)), None)
    facts = (one(title), one(speaker), one(whole.find("div", "published-date")))
    root = root_of(whole, kind)
    if root is None:
        return (None, *facts, "no content")
    charts = [x.find("h3", "img-title") for x in root.all() if kind in ("MPR", "FSR") and x.name == "div" and x.has("img-block") and not x.find("table")]
    found = tables(root) if kind in ("MPR", "FSR") else []
    titles = [f"[CHART: {x.text()}]" for x in charts if x]
    heroes = root.parent.under(lambda a: a.has("hero-paragraph")) if kind == "speech" and root.parent else ()
    hero = next((x for x, (within,) in heroes if x.has("hero") and within), None)
    for x in list(root.all()):
        if any(x.name == n and x.has(c) for n, c in CUT) or x.name == "a" and (x.attrs.get("id") or "").startswith("_Hlk"):
            x.drop()
    told = [*([hero.text()] if hero else []), *lines(root, kind), *titles, *found]
    return ("\n\n".join(filter(None, told)), *facts, None)


def told_or_error(page: str | None, kind: str) -> tuple:
    """``extract``, with the error of a page that can't be read in its last place."""
    try:
        return extract(page, kind)
    except Exception as failure:
        return (None, "", "", "", f"{type(failure).__name__}: {failure}"[:500])


def _pages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        made = pd.DataFrame([told_or_error(h, k) for h, k in zip(rows["html"], rows["document_type"], strict=True)], columns=[x.split()[0] for x in OUT.split(", ")], index=rows.index)
        yield pd.concat([rows[["page_id"]], made], axis=1)


def site_texts(pages: DataFrame) -> DataFrame:
    """(page_id, text, title, speaker, published, error) of ``pages`` (page_id, html, document_type).

    A page without a document or that can't be read has a null text and an error.
    """
    small_batches(pages.sparkSession)
    found = pages.select("page_id", "html", "document_type").mapInPandas(_pages, f"page_id long, {OUT}")
    return found.withColumn("text", normalise_text(F.col("text")))
