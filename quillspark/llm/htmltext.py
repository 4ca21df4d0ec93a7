"""Main text of web pages by tree scoring.

Every paragraph-like block passes points for its length and commas to its ancestors (all to the parent, half to the
grandparent, then less by depth). A container's points are discounted by its link density; the best container
wins and grows to the article element or the plain containers around it. Siblings that score near it or read like
prose, and headings beside it, are kept with it. Boilerplate elements are pruned first.

Names of classes and ids count word by word: a token such as "comment-list" or "site-footer" marks boilerplate, since
all its words do or are words of layout; "related-work" does not. Words that articles use too (related, notice, share)
prune only what is short or full of links, and lower the score of the rest.

Pages are independent rows: no shuffle, one page in memory at a time. A page's nodes are walked a fixed number of times.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_SPACE = re.compile(r"\s+")
_RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes", "template"}
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>", re.I) for t in _RAW}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BLOCK = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
_PRUNED = {"nav", "header", "footer", "aside", "menu", "select", "dialog", "svg", "canvas", "object", "audio", "video", "head", "input", "datalist", "map"} | _RAW
_CONTROLS = {"button", "label"}
_CLOSES_P = _BLOCK - {"html", "body"}
_SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr"}, {"table", "tbody", "thead", "tfoot"}), "option": ({"option"}, {"select"})}
#: Words of boilerplate, those that articles use too, and words of layout that go with either.
_STRONG = re.compile(r"(?:ads?|advert\w*|sponsor\w*|promo\w*|sidebars?|menus?|nav|navbar|navigation|breadcrumbs?|footer|masthead|comments?|commentlist|commenters?|repl(?:y|ies)|discussions?|talkback|guestbook|disqus|cookies?|popup|modal|newsletter|subscribe|signup|pagination|pager|toolbar|contentinfo|complementary)")
_WEAK = re.compile(r"(?:banner|header|side|respond|responses|consent|notices?|alerts?|overlay|share|sharing|social|related|relatedposts|recommend\w*|widgets?|skip)")
_LAYOUT = set("area areas bar block blocks body bottom box boxes btn button buttons column container content entry extra field footer form global head holder icons inner item items left link links list lists main meta more navi outer page panel post posts primary reader readers right secondary section site slot space stories sub text thread title top unit user view wrap wrapper article articles blog".split())
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
_POSITIVE = re.compile(r"article|body|content|entry|hentry|main|page|post|text|story|blog", re.I)
_HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
_INLINE_HOLDERS = ("p", *_HEADINGS, "li", "tr", "td", "th", "pre", "dt", "dd")
_NO_CONTAINER = ("p", *_HEADINGS, "pre", "li", "td", "th", "dt", "dd", "tr", "tbody", "blockquote", "figcaption")
_PROSE = ("p", "pre", "blockquote", "li", "td", "dd", *_HEADINGS)
#: Ancestors that a block passes points to.
LEVELS = 10


def _marks(tokens: str) -> str:
    """"strong", "weak" or "" for the classes and ids of an element."""
    found = ""
    for token in tokens.split():
        words = [w.lower() for w in _WORDS.findall(token) if not w.isdigit()]
        strong, weak = any(_STRONG.fullmatch(w) for w in words), any(_WEAK.fullmatch(w) for w in words)
        if (strong or weak) and all(_STRONG.fullmatch(w) or _WEAK.fullmatch(w) or w in _LAYOUT for w in words):
            if strong:
                return "strong"
            found = "weak"
    return found


class _Node:
    __slots__ = ("chars", "children", "kept", "linked", "mark", "name", "parent", "prose", "pruned", "score", "weight", "whole")

    def __init__(self, name: str, parent: _Node | None, attributes: str = "") -> None:
        self.name, self.parent, self.children, self.score = name, parent, [], 0.0
        self.chars, self.linked, self.prose, self.kept, self.whole, self.mark = 0, 0, 0, False, False, ""
        self.pruned, self.weight = name in _PRUNED, 25.0 if name in ("article", "main") else 0.0
        if attributes and name not in ("html", "body"):
            found = [(a[0].lower(), a[1] or a[2] or a[3]) for a in _ATTRIBUTE.findall(attributes)]
            # A section that is called by the id "discussion" is a paper's; readers discuss in a class.
            marks = " ".join(v for k, v in found if k in ("class", "role") or k == "id" and v.lower() != "discussion")
            if marks:
                self.mark = _marks(marks) if name not in ("article", "main") or "comment" in marks.lower() else ""
                if _POSITIVE.search(marks):
                    self.weight += 25.0
                if self.mark:
                    self.weight -= 25.0
            if re.search(r"\bhidden\b|display\s*:\s*none", attributes, re.I) and re.search(r"(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", attributes, re.I):
                self.pruned = True


def _closed(node: _Node, to: _Node, opened: Counter) -> _Node:
    """Closes all elements from node up to `to`, which stays open."""
    while node is not to:
        opened[node.name] -= 1
        node = node.parent
    return to


def _parse(page: str) -> list[_Node]:
    """Nodes in page order, the root first; children are nodes and undecoded strings. Tolerant of missing and stray tags."""
    root = node = _Node("#root", None)
    nodes, opened = [root], Counter()
    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            node.children.append(page[at:])
            break
        if m.start() > at:
            node.children.append(page[at : m.start()])
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        if m[1] or m[4]:
            up = node if opened[name] else None
            while up is not None and up.name != name:
                up = None if name != "p" and up.name in ("td", "table") and name not in ("table", "tr", "td", "th", "tbody", "thead", "tfoot", "body", "html", "article", "main", "div", "section") else up.parent
            if up is not None and up.parent is not None:
                node = _closed(node, up.parent, opened)
            elif name == "br":
                node.children.append(" ")
            continue
        if name in ("br", "wbr"):
            node.children.append(" " if name == "br" else "")
            continue
        if name in _CLOSES_P and opened["p"]:
            up = node
            while up is not None and up.name != "p" and (up.name not in _BLOCK):
                up = up.parent
            if up is not None and up.name == "p":
                node = _closed(node, up.parent, opened)
        if name in _SIBLINGS:
            ends, stops = _SIBLINGS[name]
            up = node if any(opened[x] for x in ends) else None
            while up is not None and up.name not in ends and up.name not in stops:
                up = up.parent
            if up is not None and up.name in ends:
                node = _closed(node, up.parent, opened)
        child = _Node(name, node, m[3] if m[2] else m[6])
        node.children.append(child)
        nodes.append(child)
        if name in _RAW:
            end = _RAW_END[name].search(page, at)
            at = end.end() if end else n
        elif name not in _VOID:
            node = child
            opened[name] += 1
    return nodes


def _runs(node: _Node, out: list, holder: _Node, link: bool) -> None:
    """Inline text runs in page order: (block that holds it, text, is it in a link); None ends a block."""
    stack: list = [(node, iter(node.children), holder, link)]
    while stack:
        node, rest, holder, link = stack[-1]
        for x in rest:
            if isinstance(x, str):
                out.append((holder, x, link))
            elif not x.pruned:
                block = x.name in _BLOCK
                if block:
                    out.append(None)
                stack.append((x, iter(x.children), x if block else holder, link or x.name == "a"))
                break
        else:
            stack.pop()
            if node.name in _BLOCK:
                out.append(None)


def _blocks(root: _Node) -> list[tuple[_Node, str, int]]:
    """(holder, text, characters in links) of each block that has text."""
    runs: list = []
    _runs(root, runs, root, False)
    out, parts, linked, holder = [], [], 0, root
    for x in [*runs, None]:
        if x is not None:
            if not parts:
                holder = x[0]
            parts.append(x[1])
            linked += len(x[1].strip()) if x[2] else 0
        elif parts:
            text = "".join(parts)
            text = _SPACE.sub(" ", html.unescape(text) if "&" in text else text).strip()
            if text:
                out.append((holder, text, min(linked, len(text))))
            parts, linked = [], 0
    return out


def _within(x: _Node, names: tuple[str, ...]) -> bool:
    while x is not None and x.name not in names:
        x = x.parent
    return x is not None


def _prune(nodes: list[_Node]) -> None:
    """Prunes elements that their marks or names say are boilerplate; an element around the article is none.

    A strong mark prunes; a weak one prunes what is full of links, and containers that either hold no block of prose
    or stand outside an article with less than half of the page's text. A form is pruned unless it holds half of the
    page's prose. Buttons and labels stay inside a block that has words of its own around them.
    """
    for x in reversed(nodes):
        own = 0
        for c in x.children:
            if isinstance(c, str):
                own += len(c.strip())
            elif not c.pruned:
                x.chars += c.chars
                x.linked += c.linked
                x.prose += c.prose
                x.whole |= c.whole
        x.chars += own
        if x.name in _PROSE:
            x.prose = x.chars
        if x.name == "a":
            x.linked = x.chars
        if x.name in _PROSE:
            for c in x.children:
                if not isinstance(c, str) and c.name in _CONTROLS and not own:
                    c.pruned = True
        x.pruned |= x.mark == "strong" and not x.whole
        x.whole |= x.name in ("article", "main") and not x.pruned
    root = nodes[0]
    inside = set()
    for x in nodes:
        up = x.parent
        if up is not None and (id(up) in inside or up.name in ("article", "main")):
            inside.add(id(x))
        if x.name in _CONTROLS and (up is None or not _within(up, _PROSE)):
            x.pruned = True
        if x.name == "form" and not x.whole and 2 * x.prose < max(1, root.prose):
            x.pruned = True
        if x.mark == "weak" and not x.whole:
            sparse = not x.prose or id(x) not in inside and 2 * x.chars < root.chars
            x.pruned |= x.linked > 0.3 * x.chars or x.name not in _PROSE and sparse
    for x in nodes:
        x.chars = x.linked = 0


def main_text(page: str | None) -> str:
    """Blocks of the best container and its kept siblings, joined by newlines; empty if there is no text."""
    if not page:
        return ""
    nodes = _parse(page)
    _prune(nodes)
    root = nodes[0]
    blocks = _blocks(root)
    if not blocks:
        return ""
    for holder, text, linked in blocks:
        points = (1 + text.count(",") + min(len(text) / 100, 3.0)) * (1 - linked / len(text)) if holder.name not in (*_HEADINGS, "th") else 0.5
        up, depth = holder if holder.name not in _NO_CONTAINER else holder.parent, 0
        while up is not None and depth < LEVELS:
            up.score += points if depth == 0 else points / 2 if depth == 1 else points / (3 * depth)
            up, depth = up.parent, depth + 1
        holder.chars += len(text)
        holder.linked += linked
    for x in reversed(nodes):
        if x.parent is not None:
            x.parent.chars += x.chars
            x.parent.linked += x.linked
    density = lambda x: x.linked / max(1, x.chars)
    final = lambda x: (x.score + (x.weight if x.score else 0)) * (1 - density(x))
    best = max((x for x in nodes if x.chars and x.name not in _INLINE_HOLDERS), key=final, default=root)
    best = _grown(best)
    best.kept = True
    if best.parent is not None:
        top = final(best)
        for x in best.parent.children:
            if isinstance(x, str) or not x.chars:
                continue
            prose = x.name == "p" and (x.chars > 80 and density(x) < 0.25 or x.chars <= 80 and density(x) == 0)
            if final(x) >= max(10.0, 0.2 * top) or prose or x.name in _HEADINGS and density(x) < 0.5:
                x.kept = True
    for x in nodes[1:]:
        x.kept |= x.parent.kept
    return "\n".join(text for holder, text, _ in blocks if holder.kept)


def _grown(best: _Node) -> _Node:
    """The article or main element around best, or the outermost container that adds text without many links."""
    around, up = [], best
    while up is not None:
        around.append(up)
        up = up.parent
    for name in ("article", "main"):
        found = [x for x in around if x.name == name]
        if found:
            return found[-1]
    for x in around[1:]:
        if x.name in ("body", "html", "#root") or x.chars - best.chars and x.linked - best.linked > 0.25 * (x.chars - best.chars):
            break
        best = x
    return best


def extract(pages: DataFrame, names: tuple[str, str] = ("text", "n_chars")) -> DataFrame:
    """Rows of pages (column html) with the main text and its code points.

    Null and empty html, and pages without text, give the empty text. Columns pass through but html, and those that
    carry the new names are replaced. Repeated rows give repeated results; an empty table an empty one.
    """
    pages = pages.drop(*[x for x in names if x != "html"])
    rest = [c for c in pages.columns if c != "html"]
    ship(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column("__html")]
            yield pa.RecordBatch.from_arrays([batch.column("__row"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["__row", *names])

    own = F.struct(*[F.col(f"`{c.replace('`', '``')}`") for c in rest]) if rest else F.lit(0)
    rows = pages.select(own.alias("__row"), F.col("html").cast("string").alias("__html"))
    out = rows.mapInArrow(run, rows.select("__row").schema.add(names[0], "string").add(names[1], "long"))
    return out.select(*(["__row.*"] if rest else []), *names)
