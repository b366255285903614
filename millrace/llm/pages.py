"""Main text of web pages: a recurrent labeller decides for every block with the whole page in view.

A page is cut into leaf blocks with their tag paths. A bidirectional LSTM in
numpy reads, block by block, a vector of the path's hashed parts, one of the
block's hashed words, and a few figures, and says which blocks are main text.
``train`` fits it to pages made by ``made_page``; ``blocks.npz`` holds the
weights it gave.
"""

from __future__ import annotations

import html as entities
import os
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import tidy
from millrace.llm.grid import slices

# Fixed values of HTML: elements that begin a block, that have no end tag, whose content is no text, and that an equal start tag ends.
BLOCK = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead title tr ul button".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style template noscript iframe textarea svg title object canvas".split())
#: What may stand in a head; any other element, or text, ends one without an end tag.
IN_HEAD = set("html head base basefont bgsound link meta title style script noscript template".split())
CLOSES_ITSELF = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CLOSES_P = BLOCK - {"body", "html", "head", "button", "label", "option", "select", "legend", "summary", "td", "th", "tr"}
SCOPE = {"ul", "ol", "table", "dl", "select", "article", "section", "div", "aside", "nav", "main", "body"}
#: Elements that end others of their kind, of which the innermost open one is looked up.
ENDED = {"p"}.union(*CLOSES_ITSELF.values())
_OPEN = re.compile(r"<(?:!--|[!?]|(/?)([a-zA-Z][^\s/>]*+))")
#: What is left of a tag: up to the first > outside quotes.
_REST = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)

PATHS, WORDS, D_PATH, D_WORD, D_MORE, HIDDEN = 512, 512, 20, 8, 4, 16
WEIGHTS = os.path.join(os.path.dirname(os.path.abspath(__file__)), "blocks.npz")


class Path:
    """An open block element within another: its name with class, id and role. The root has no label."""

    __slots__ = ("label", "parent", "depth", "in_head", "ended_by")

    def __init__(self, label: str = "", parent: Path | None = None, at: int = 0):
        name = label.split(" ", 1)[0]
        self.label, self.parent, self.depth = label, parent, parent.depth + 1 if parent else 0
        self.in_head = name == "head" or parent is not None and parent.in_head
        #: Where in the stack the innermost open elements are that a start tag may end.
        around = parent.ended_by if parent else {}
        self.ended_by = {} if name in SCOPE else {**around, name: at} if name in ENDED else around

    def __len__(self) -> int:
        return self.depth

    def __iter__(self) -> Iterator[str]:
        labels, at = [], self
        while at.parent is not None:
            labels.append(at.label)
            at = at.parent
        return reversed(labels)


def tags(page: str) -> Iterator[tuple[int, int, bool, str, str]]:
    """(start, end, is it an end tag, name, attributes) of each tag; comments and declarations have no name.

    A tag ends at the first > outside quotes; after a tag whose quotes never
    close, all end at the first >. What no > follows is no tag. Every
    character is passed over a fixed number of times. The caller sends the
    place to go on from, if it is another than the end.
    """
    at, last, quoted = 0, page.rfind(">"), True
    while found := _OPEN.search(page, at):
        start, at = found.span()
        name = found[2] or ""
        if page.startswith("<!--", start):
            end = page.find("-->", at) + 3
            end = len(page) if end < 3 else end
        elif start > last:
            at = start + 1 if page.find("<!--", at) < 0 else page.index("<!--", at)
            if page.startswith("<!--", at):
                continue
            return
        elif not name:
            end = page.find(">", at) + 1
        else:
            rest = _REST.match(page, at) if quoted else None
            quoted = rest is not None
            end = rest.end() if rest else page.find(">", at) + 1
        if not end:
            at = start + 1
            continue
        to = yield start, end, found[1] == "/", name.lower(), page[found.end() : end - 1] if name else ""
        at = end if to is None else to


def blocks(page: str) -> list[tuple[Path, str, float]]:
    """Leaf blocks of a page in order: tag path, text, share of the text in links."""
    out: list[tuple[Path, str, float]] = []
    root = path = Path()
    stack: list[tuple[str, Path]] = []
    opened: Counter[str] = Counter()
    text: list[str] = []
    linked = at = 0
    in_link = False

    def close() -> None:
        nonlocal text, linked
        joined = " ".join("".join(text).split())
        if joined:
            out.append((path, joined, min(linked / len(joined), 1.0)))
        text, linked = [], 0

    def cut_to(depth: int) -> None:
        nonlocal path
        while len(stack) > depth:
            opened[stack.pop()[0]] -= 1
        path = stack[-1][1] if stack else root

    def leave(name: str) -> None:
        """End the innermost open element of the name."""
        depth = len(stack) - 1
        while stack[depth][0] != name:
            depth -= 1
        cut_to(depth)

    def leave_head() -> None:
        if opened["head"]:
            close()
            leave("head")

    def say(raw: str) -> None:
        nonlocal linked
        if raw.strip():
            leave_head()
        plain = entities.unescape(raw) if "&" in raw else raw
        text.append(plain)
        if in_link:
            linked += len(plain)

    walk, to = tags(page), None
    while True:
        try:
            start, end, ends, name, more = walk.send(to)
        except StopIteration:
            break
        to = None
        if start > at:
            say(page[at:start])
        at = end
        if not name:
            continue
        if ends:
            if name == "a":
                in_link = False
            if name in BLOCK:
                close()
                if opened[name]:
                    leave(name)
            continue
        if name not in IN_HEAD:
            leave_head()
        if name == "br":
            text.append(" ")
        elif name == "a":
            in_link = True
        if name in RAW and not (name == "svg" and more.endswith("/")):
            shut = re.compile(f"</{name}", re.I).search(page, at)
            rest = page.find(">", shut.start()) if shut else -1
            at = to = len(page) if rest < 0 else rest + 1
            if name == "title":
                close()
            continue
        if name in BLOCK:
            close()
            shut_here = CLOSES_ITSELF.get(name, set()) | ({"p"} if name in CLOSES_P else set())
            if (depth := max((path.ended_by.get(x, -1) for x in shut_here), default=-1)) >= 0:
                cut_to(depth)
            if name not in VOID and not more.endswith("/"):
                parts = " ".join(next(filter(None, m), "") for m in _NAMES.findall(more)) if "=" in more else ""
                path = Path(f"{name} {parts.lower()}".strip(), path, len(stack))
                stack.append((name, path))
                opened[name] += 1
    if at < len(page):
        say(page[at:])
    close()
    return [x for x in out if not x[0].in_head]


@lru_cache(maxsize=10_000)
def label_slots(label: str) -> np.ndarray:
    """Slots of a path's part: its tag and each word of its class, id and role."""
    name, *more = re.split(r"[\s_-]+", label)
    return np.asarray([zlib.crc32(x.encode()) % PATHS for x in (name, *(f".{w}" for w in more if w))])


@lru_cache(maxsize=1_000)
def last_slot(label: str) -> int:
    return zlib.crc32(f"/{label.split(' ', 1)[0]}".encode()) % PATHS


def path_slots(path: Path) -> np.ndarray:
    """Slots of a path: those of each part, and that of the last tag."""
    return np.concatenate([*(label_slots(x) for x in path), [last_slot(path.label)]]).astype(np.int64)


def word_slots(text: str) -> np.ndarray:
    return np.asarray([zlib.crc32(w.encode()) % WORDS for w in text.lower().split()] or [0])


class Net:
    """The labeller. Sequences are padded to (batch, steps); mask says which steps are blocks."""

    def __init__(self, w: dict[str, np.ndarray]):
        self.w = {k: v.astype(np.float32) for k, v in w.items()}

    @classmethod
    def fresh(cls, rng: np.random.Generator) -> Net:
        d = D_PATH + D_WORD + D_MORE
        w = {"path": rng.normal(0, 0.3, (PATHS, D_PATH)), "word": rng.normal(0, 0.1, (WORDS, D_WORD)), "out": rng.normal(0, 0.3, 2 * HIDDEN), "out_b": np.zeros(1)}
        for k in "fb":
            w |= {f"x{k}": rng.normal(0, d**-0.5, (d, 4 * HIDDEN)), f"h{k}": rng.normal(0, HIDDEN**-0.5, (HIDDEN, 4 * HIDDEN)), f"b{k}": np.repeat([0.0, 1.0, 0.0, 0.0], HIDDEN)}
        return cls(w)

    def of_path(self, path: Path, known: dict[Path, np.ndarray]) -> np.ndarray:
        """The sum of the vectors of a path's parts, from that of the nearest path around it in ``known``."""
        todo = []
        while path not in known:
            todo.append(path)
            path = path.parent
        total = known[path]
        for path in reversed(todo):
            known[path] = total = total + self.w["path"][label_slots(path.label)].sum(0)
        return total

    def vectors(self, page: list[tuple[Path, str, float]]) -> np.ndarray:
        out = np.zeros((len(page), D_PATH + D_WORD + D_MORE), self.w["path"].dtype)
        known: dict[Path, np.ndarray] = {}
        for k, (path, text, link) in enumerate(page):
            if not known:
                root = path
                while root.parent is not None:
                    root = root.parent
                known[root] = np.zeros(D_PATH, self.w["path"].dtype)
            out[k, :D_PATH] = self.of_path(path, known) + self.w["path"][last_slot(path.label)]
            out[k, D_PATH : D_PATH + D_WORD] = self.w["word"][word_slots(text)].mean(0)
            out[k, -D_MORE:] = link, min(len(text), 2000) ** 0.5 / 20, text[-1] in ".!?", len(path) / 10
        return out

    def run(self, x: np.ndarray, mask: np.ndarray, kind: str) -> tuple[np.ndarray, list]:
        n, steps, _ = x.shape
        h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
        out, kept = np.zeros((n, steps, HIDDEN), np.float32), []
        inward = x @ self.w[f"x{kind}"] + self.w[f"b{kind}"]
        for t in range(steps) if kind == "f" else range(steps - 1, -1, -1):
            gates = inward[:, t] + h @ self.w[f"h{kind}"]
            s = 1 / (1 + np.exp(-gates[:, : 3 * HIDDEN]))
            i, f, o, g = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :], np.tanh(gates[:, 3 * HIDDEN :])
            m = mask[:, t, None]
            c_new = m * (f * c + i * g) + (1 - m) * c
            tc = np.tanh(c_new)
            h_new = m * (o * tc) + (1 - m) * h
            kept.append((t, i, f, o, g, c, tc, h, m))
            h, c = h_new, c_new
            out[:, t] = h
        return out, kept

    def logits(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        return np.concatenate([self.run(x, mask, k)[0] for k in "fb"], 2) @ self.w["out"] + self.w["out_b"]

    def gradients(self, pages: list, labels: list[np.ndarray]) -> tuple[dict[str, np.ndarray], float]:
        """Gradients of the mean loss, by backpropagation through time in both directions."""
        steps = max(map(len, pages))
        x = np.zeros((len(pages), steps, D_PATH + D_WORD + D_MORE), np.float32)
        mask, y = np.zeros(x.shape[:2], np.float32), np.zeros(x.shape[:2], np.float32)
        for k, (page, label) in enumerate(zip(pages, labels, strict=True)):
            x[k, : len(page)], mask[k, : len(page)], y[k, : len(page)] = self.vectors(page), 1, label
        sides = {k: self.run(x, mask, k) for k in "fb"}
        both = np.concatenate([sides[k][0] for k in "fb"], 2)
        z = both @ self.w["out"] + self.w["out_b"]
        p = 1 / (1 + np.exp(-z))
        total = mask.sum()
        loss = float(-(mask * (y * np.log(p + 1e-9) + (1 - y) * np.log(1 - p + 1e-9))).sum() / total)
        dz = mask * (p - y) / total
        g = {k: np.zeros_like(v) for k, v in self.w.items()}
        g["out"], g["out_b"] = np.einsum("nt,nth->h", dz, both), dz.sum(keepdims=True).reshape(1)
        dboth, dx = dz[:, :, None] * self.w["out"], np.zeros_like(x)
        for n, k in enumerate("fb"):
            dh, dc = np.zeros((len(pages), HIDDEN), np.float32), np.zeros((len(pages), HIDDEN), np.float32)
            for t, i, f, o, cand, c, tc, h, m in reversed(sides[k][1]):
                dh = dh + dboth[:, t, n * HIDDEN : (n + 1) * HIDDEN]
                do, dcn = dh * m * tc, dc + dh * m * o * (1 - tc**2)
                gates = np.concatenate([dcn * m * cand * i * (1 - i), dcn * m * c * f * (1 - f), do * o * (1 - o), dcn * m * i * (1 - cand**2)], 1)
                g[f"h{k}"] += h.T @ gates
                g[f"x{k}"] += x[:, t].T @ gates
                g[f"b{k}"] += gates.sum(0)
                dx[:, t] += gates @ self.w[f"x{k}"].T
                dh, dc = gates @ self.w[f"h{k}"].T + dh * (1 - m), dcn * (m * f + 1 - m)
        for k, page in enumerate(pages):
            for t, (path, text, _) in enumerate(page):
                np.add.at(g["path"], path_slots(path), dx[k, t, :D_PATH])
                slots = word_slots(text)
                np.add.at(g["word"], slots, dx[k, t, D_PATH : D_PATH + D_WORD] / len(slots))
        return g, loss

    def main_text(self, pages: list[list]) -> list[list[bool]]:
        """Which blocks of each page are main text."""
        out: list[list[bool]] = [[] for _ in pages]
        order = sorted((k for k in range(len(pages)) if pages[k]), key=lambda k: len(pages[k]))
        at = 0
        while at < len(order):
            to = at + 1  # pages of like length together, within a bound on the padded array
            while to < len(order) and (to - at + 1) * len(pages[order[to]]) <= 8192:
                to += 1
            own = order[at:to]
            x = np.zeros((len(own), len(pages[own[-1]]), D_PATH + D_WORD + D_MORE), np.float32)
            mask = np.zeros(x.shape[:2], np.float32)
            for k, page in enumerate(own):
                x[k, : len(pages[page])], mask[k, : len(pages[page])] = self.vectors(pages[page]), 1
            z = self.logits(x, mask)
            for k, page in enumerate(own):
                out[page] = (z[k, : len(pages[page])] > 0).tolist()
            at = to
        return out


# Names that pages give to their parts, and words that boilerplate is written in.
GOOD = "content post entry story text body article-body main-content post-content entry-content".split()
BAD = "ad ads advert banner sidebar nav menu footer header cookie notice popup modal share social related comments comment promo newsletter breadcrumb login search widget sponsor consent toolbar pagination tags".split()
SAID = "cookie subscribe login sign up advertisement copyright home contact about menu privacy terms share search comment reply newsletter follow next previous click here read more".split()


def made_page(rng: np.random.Generator) -> tuple[str, list[str]]:
    """A page of random layout and its main blocks."""
    syllables = "the on er an re ti th en at or es is it nd ha of to in ou ea con ver lo ra mi sta é ü ñ".split()
    word = lambda: "".join(rng.choice(syllables, rng.integers(1, 4)))
    prose = lambda a, b: " ".join(word() for _ in range(int(rng.integers(a, b)))) + str(rng.choice([".", "", "!", "?"], p=[0.8, 0.1, 0.05, 0.05]))
    said = lambda: " ".join(rng.choice(SAID, rng.integers(1, 5)))
    some = lambda p: rng.random() < p
    main: list[str] = []

    def links(a: int, b: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{word()}">{said() if some(0.3) else word()}</a></li>' for _ in range(int(rng.integers(a, b)))) + "</ul>"

    def junk() -> str:
        kind = rng.integers(0, 8)
        inner = rng.choice(["p", "div", "span", ""])
        body = said() if some(0.3) else prose(1, 30)
        body = f"<{inner}>{body}</{inner}>" if inner else body
        if kind == 0:
            return f"<nav>{links(2, 9)}</nav>"
        if kind == 1:
            return f"<aside>{'<h3>' + prose(1, 4) + '</h3>' if some(0.5) else ''}{body if some(0.5) else links(2, 6)}</aside>"
        if kind == 2:
            return f"<form><label>{said()}</label><p>{said()}</p><button>{said()}</button></form>"
        if kind == 3:
            return f"<footer>&copy; {word()}.example &middot; {body}</footer>" if some(0.5) else f"<header>{body}</header>"
        tag = rng.choice(["div", "section", "aside", "ul"], p=[0.7, 0.15, 0.1, 0.05])
        name = rng.choice(BAD)
        more = f"-{word()}" if some(0.2) else ""
        attr = rng.choice(["class", "id"], p=[0.7, 0.3])
        body = "".join(f"<p>{prose(1, 40)}</p>" for _ in range(int(rng.integers(1, 4)))) if name in ("comments", "comment", "related") else body
        return f'<{tag} {attr}="{name}{more}">{links(1, 5) if some(0.2) else body}</{tag}>'

    def own(tag: str, text: str, close: bool = True) -> str:
        main.append(text)
        shown = f"<b>{text}" if some(0.1) else f"<b>{text}</b>" if some(0.1) else text
        return f"<{tag}>{shown}{'<br>' if some(0.1) else ''}" + (f"</{tag}>" if close else "")

    def article() -> str:
        parts = [own("h1", prose(2, 12))] if some(0.9) else []
        for _ in range(int(rng.integers(1, 14))):
            kind = rng.random()
            if kind < 0.72:
                parts.append(own("p", prose(1, 80), some(0.85)))
            elif kind < 0.8:
                parts.append(own(str(rng.choice(["h2", "h3"])), prose(1, 8)))
            elif kind < 0.86:
                parts.append("<ul>" + "".join(own("li", prose(1, 15)) for _ in range(int(rng.integers(1, 5)))) + "</ul>")
            elif kind < 0.9:
                parts.append(own("blockquote", prose(3, 40)))
            elif kind < 0.93:
                parts.append("<table><tr>" + own("td", prose(1, 5)) + own("td", prose(1, 5)) + "</tr></table>")
            elif kind < 0.97:
                parts.append(junk())
            else:
                parts.append("<script>var a='</p>';</script>")
        return "".join(parts)

    head = "".join(junk() for _ in range(int(rng.integers(0, 4))))
    kind = rng.integers(0, 5)
    if kind < 2:
        core = f"<article>{article()}</article>"
    elif kind == 2:
        core = f"<main><article>{article()}</article></main>" if some(0.5) else f"<main>{article()}</main>"
    elif kind == 3:
        core = f'<div {rng.choice(["class", "id"])}="{rng.choice(GOOD)}">{article()}</div>'
    else:
        core = f'<main><div class="{rng.choice(GOOD)}">{article()}</div></main>'
    core = core if some(0.7) else f'<div class="{rng.choice(["page", "wrapper", "container"])}">{core}{junk() if some(0.4) else ""}</div>'
    tail = "".join(junk() for _ in range(int(rng.integers(0, 4))))
    return f"<!DOCTYPE html><html><head><title>{prose(1, 5)}</title><style>p{{}}</style></head><body>{head}{core}{tail}</body></html>", main


def labelled(rng: np.random.Generator) -> tuple[list, np.ndarray]:
    """The blocks of a made page and whether each is main text, by their texts in order."""
    while True:
        page, main = made_page(rng)
        found, label, k = blocks(page), [], 0
        want = [" ".join(x.split()) for x in main]
        for path, text, _ in found:
            bad = any(re.search(rf"^(nav|aside|form|footer|header)\b|\s({'|'.join(BAD)})\b", p) for p in path)
            hit = not bad and k < len(want) and text == want[k]
            label.append(hit)
            k += hit
        if found and k == len(want):
            return found, np.asarray(label, np.float32)


def train(steps: int = 900, size: int = 24, seed: int = 11, path: str = WEIGHTS) -> float:
    """Fit the labeller (Adam), write its weights, and return the accuracy on held-out pages."""
    rng = np.random.default_rng(seed)
    net = Net.fresh(rng)
    m, v = ({k: np.zeros_like(x) for k, x in net.w.items()} for _ in range(2))
    for step in range(1, steps + 1):
        batch = [labelled(rng) for _ in range(size)]
        g, _ = net.gradients([b[0] for b in batch], [b[1] for b in batch])
        rate = 0.01 * min(1, 3 * (1 - step / (steps + 1)))
        for k in net.w:
            m[k] = 0.9 * m[k] + 0.1 * g[k]
            v[k] = 0.99 * v[k] + 0.01 * g[k] ** 2
            net.w[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)
    np.savez_compressed(path, **{k: x.astype(np.float16) for k, x in net.w.items()})
    held = [labelled(np.random.default_rng(10_000 + k)) for k in range(400)]
    right = [a == bool(b) for got, (_, label) in zip(load(path).main_text([h[0] for h in held]), held, strict=True) for a, b in zip(got, label, strict=True)]
    return float(np.mean(right))


@lru_cache(maxsize=2)
def load(path: str = WEIGHTS) -> Net:
    return Net(dict(np.load(path)))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    net = load()
    for batch in batches:
        for at, pages in slices(batch.column(2)):
            cut = [blocks(x or "") for x in pages.to_pylist()]
            texts = ["\n".join(x[1] for x, y in zip(page, keep, strict=True) if y) for page, keep in zip(cut, net.main_text(cut), strict=True)]
            own = [batch.column(k).slice(at, len(pages)) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*own, pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def main_texts(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of each row of ``pages`` (page_id, url, html).

    text joins the page's main blocks by line breaks; it is empty for a null or
    empty page and for one without main text. Repeated rows stay; other columns
    are not read.
    """
    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(tidy(_extract), "page_id long, url string, text string, n_chars long")
