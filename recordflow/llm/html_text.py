"""Main text of web pages by composite text density.

Each page becomes a tree of its elements. What is boilerplate by its element or role goes
first. Blocks whose class or id has a word of boilerplate are set aside unless the article or
most of the text is in them; those whose words also name parts of an article come back if
they lie in the main text and are not mostly links. For every node that is left, the composite density is
its characters per tag, adjusted by how much of them is linked; the densities of a node's
children are added up, and the node with the largest sum holds the main text. The least
density on the path from the body to that node is the threshold: parts of the page outside the
node belong to the text too if they reach it. An article around the node is taken whole.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from recordflow.llm.common import text_bytes

# --- Fixed values: element names by what they mean for the text. ---
RAW = frozenset("script style textarea title noscript template iframe noembed noframes xmp svg math".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("""address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr
    html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul""".split())
DROPPED = frozenset("""nav footer aside script style noscript template iframe object embed applet button select textarea input label fieldset legend datalist dialog menu
    head title svg math canvas audio video map noframes noembed search""".split())
CLOSES_P = frozenset("""address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav
    ol p pre search section summary table ul""".split())
# A start tag of the key ends open elements of these names up to the given borders.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"tr", "td", "th", "thead", "tbody"}, {"table"}), "tfoot": ({"tr", "td", "th", "thead", "tbody"}, {"table"}),
    "option": ({"option"}, {"select"}), "body": ({"head"}, {"html"}),
}
HEAD_ONLY = frozenset("meta link base title style script noscript template html head".split())
HINTS = frozenset("""ad ads adv advert advertisement advertising adsense banner banners sponsor sponsored promo promotion sidebar side rail menu menus nav navbar navigation breadcrumb breadcrumbs
    pagination pager footer foot masthead header topbar toolbar comment comments commentlist respond replies disqus discussion cookie cookies consent gdpr notice notices notification alert popup modal
    overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations widget widgets form search skip hidden copyright legal disclaimer""".split())
# Those that also name parts and topics of an article; and those of readers' words, whatever element has them.
DOUBTFUL = frozenset("""promotion side menu header footer foot discussion notice notices notification alert share sharing social related recommended recommendations form search skip
    copyright legal disclaimer subscription""".split())
READERS = frozenset("comment comments commentlist respond replies disqus".split())
MODIFIERS = frozenset("has no with without left right is layout".split())  # first words of class names that tell of something else
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
KEPT = frozenset("html body main article".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar note status".split())
# --- End of fixed values. ---

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</?[a-zA-Z][^\s/>]*(?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*?(?:>|\Z)", re.S)
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_ATTR = re.compile(r"(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[A-Z])")
_SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("name", "parent", "parts", "chars", "tags", "link_chars", "link_tags", "density", "total", "gone", "hint", "article")

    def __init__(self, name: str, parent: "Node | None", gone: bool):
        self.name, self.parent, self.gone = name, parent, gone
        self.article = parent is not None and (parent.article or parent.name in ("article", "main"))
        self.hint = 0  # 1 if a word of its class or id may mean boilerplate, 2 if it does
        self.parts: list = []  # texts and nodes, in page order
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0


def _boilerplate(name: str, attributes: str, inside_article: bool) -> bool:
    if name in DROPPED or name == "header" and not inside_article:
        return True
    if name in KEPT or not attributes:
        return False
    for m in _ATTR.finditer(attributes):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "")
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "role" and value.lower() in ROLES:
            return True
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
    return False


def _hint(name: str, attributes: str) -> int:
    """Whether a word of the class or id may mean boilerplate (1) or does (2). Ids of headings are slugs of their text; those of sections may be."""
    if name not in BLOCKS and name != "span" or not attributes:
        return 0
    found = 0
    for m in _ATTR.finditer(attributes):
        key = m[1].lower()
        if key not in ("class", "id") or key == "id" and name in HEADINGS:
            continue
        for one in (m[2] or m[3] or m[4] or "").split():
            words = _SPLIT.split(re.sub(r"(?<=[a-z])(?=[A-Z])", "-", one).lower())
            if words[0] in MODIFIERS:
                continue
            if hits := HINTS.intersection(words):
                sure = not hits <= DOUBTFUL and (hits & READERS or key == "class" or name != "section")
                found = max(found, 2 if sure else 1)
    return found


def parse(html: str) -> Node:
    """Tree of a page. Missing and misplaced end tags are borne: paragraphs, list items and
    cells end where the next begins, and an end tag without its start is passed over."""
    root = Node("html", None, False)
    here = root
    stack, opened = [root], Counter()  # how many elements of each name are open

    def close(n: int) -> None:
        opened.subtract(x.name for x in stack[n:])
        del stack[n:]

    pos, size = 0, len(html)
    for m in _iter_tags(html):
        if m[0] > pos:
            here.parts.append(html[pos:m[0]])
        pos = m[1]
        name, start, attributes = m[2], m[3], m[4]
        if name is None:
            continue
        if start:
            if name == "html" or name == "body" and opened["body"]:
                continue
            if any(n.name == "head" for n in stack[1:2]) and name not in HEAD_ONLY and name not in VOID:
                close(1)
            if name in CLOSES_P and opened["p"]:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].name == "p":
                        close(i)
                        break
                    if stack[i].name in BLOCKS:
                        break
            if name in ENDS and any(opened[x] for x in ENDS[name][0]):
                ends, border = ENDS[name]
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].name in border:
                        break
                    if stack[i].name in ends:
                        close(i)
                        if name not in ("tr", "tbody", "tfoot"):
                            break
            here = stack[-1]
            node = Node(name, here, here.gone)
            node.gone = node.gone or _boilerplate(name, attributes, node.article)
            # A form goes with its controls, but for one around the article or most of the page.
            node.hint = 3 if name == "form" else _hint(name, attributes)
            here.parts.append(node)
            if name not in VOID and not attributes.endswith("/") or name in BLOCKS and name not in VOID:
                stack.append(node)
                opened[name] += 1
            if m[5] is not None:
                node.parts.append(m[5])
                if stack[-1] is node:
                    close(len(stack) - 1)
        elif opened[name]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name == name:
                    close(i)
                    break
                if name not in BLOCKS and stack[i].name in BLOCKS and name != "a":
                    break
        here = stack[-1]
    if pos < size:
        here.parts.append(html[pos:])
    return root


def _iter_tags(html: str):
    """(start, end, name or None, is start tag, attributes, raw content) of each piece of markup."""
    pos = 0
    while m := _TAG.search(html, pos):
        text = m.group()
        named = _NAME.match(text)
        pos = m.end()
        if not named:
            yield m.start(), pos, None, False, "", None
            continue
        name = named[1].lower()
        if text[1] == "/":
            yield m.start(), pos, name, False, "", None
            continue
        attributes = text[named.end():-1] if text.endswith(">") else text[named.end():]
        raw = None
        if name in RAW:
            end = re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I).search(html, pos)
            raw = html[pos:end.start()] if end else html[pos:]
            pos = end.end() if end else len(html)
        yield m.start(), pos, name, True, attributes, raw


def _length(text: str) -> int:
    return len(_SPACE.sub(" ", unescape(text) if "&" in text else text).strip())


def set_aside(root: Node) -> list[tuple[Node, list[Node]]]:
    """Takes hinted blocks out, but for those around the article or most of the page's text.
    Gives those that may come back, being doubtful and not made of links, with the nodes in them."""
    nodes = _order(root)
    if not any(n.hint for n in nodes):
        return []
    chars, links, holds = {}, {}, {}
    for n in reversed(nodes):
        kids = [p for p in n.parts if isinstance(p, Node) and not p.gone]
        chars[id(n)] = sum(_length(p) for p in n.parts if isinstance(p, str)) + sum(chars[id(k)] for k in kids)
        links[id(n)] = chars[id(n)] if n.name == "a" else sum(links[id(k)] for k in kids)
        holds[id(n)] = not n.hint and n.name in ("article", "main", "h1") or any(holds[id(k)] for k in kids)
    plain = chars[id(root)] - links[id(root)]
    aside, inside = [], {}
    for n in nodes:
        if n.parent is not None and id(n.parent) in inside:
            back = inside[id(n)] = inside[id(n.parent)]
            if back is not None and n.hint and (n.hint >= 2 or 2 * links[id(n)] > chars[id(n)]):
                inside[id(n)] = None  # what means boilerplate stays out
            elif back is not None:
                back.append(n)
        elif n.hint and n.name not in KEPT and not (n.name not in HEADINGS and holds[id(n)]) and not (n.hint != 2 and 2 * (chars[id(n)] - links[id(n)]) > plain):
            inside[id(n)] = [n] if n.hint == 1 and 2 * links[id(n)] <= chars[id(n)] else None
            if inside[id(n)] is not None:
                aside.append((n, inside[id(n)]))
        else:
            continue
        n.gone = True
    return aside


def _order(root: Node) -> list[Node]:
    """Nodes that are not boilerplate, parents before children."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if node.gone:
            continue
        out.append(node)
        stack += [p for p in reversed(node.parts) if isinstance(p, Node)]
    return out


def score(root: Node) -> list[Node]:
    """Fills in counts, composite densities and sums of child densities."""
    nodes = _order(root)
    for node in reversed(nodes):
        for p in node.parts:
            if isinstance(p, str):
                node.chars += _length(p)
            elif not p.gone:
                node.chars += p.chars
                node.tags += p.tags + 1
                node.link_chars += p.link_chars
                node.link_tags += p.link_tags
        if node.name == "a":
            node.link_chars, node.link_tags = node.chars, node.link_tags + 1
    body = next((n for n in nodes if n.name == "body"), root)
    ratio = body.link_chars / max(1, body.chars)
    for node in nodes:
        c, t, lc, lt = node.chars, max(1, node.tags), node.link_chars, max(1, node.link_tags)
        if c:
            base = math.log(c / max(1, c - lc) * lc + ratio * c + math.e)
            node.density = c / t * max(0.0, math.log(max(1.0, c / max(1, lc) * t / lt))) / max(1e-9, base) if t * c > lc * lt else 0.0
    for node in nodes:
        if node.parent is not None:
            node.parent.total += node.density
    return nodes


def _chosen(nodes: list[Node]) -> list[Node]:
    """The subtree of the main text, and the parts of the page outside it that reach the threshold, in page order."""
    best = max(nodes, key=lambda n: n.total)
    if not best.total:
        best = max(nodes, key=lambda n: n.density)
    path = []
    up = best
    while up is not None and up.name not in ("body", "html"):
        path.append(up)
        up = up.parent
    threshold = min((n.density for n in path), default=0.0)
    around = [n for n in path if n.name in ("article", "main")]
    top = around[-1] if around else best
    above = set()
    up = top
    while up is not None:
        above.add(id(up))
        up = up.parent
    out, inside = [], set()
    for n in nodes:
        if n.parent is not None and id(n.parent) in inside:
            inside.add(id(n))
        elif n is top or n.parent is not None and id(n.parent) in above and id(n) not in above and n.name in BLOCKS and n.density >= threshold > 0:
            inside.add(id(n))
            out.append(n)
    return out


def _blocks(node: Node, out: list[str], line: list[str]) -> None:
    """Adds the text blocks below a node; ``line`` is the block in the making."""
    stack: list = [node]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            line.append(x)
            continue
        if x is None:
            _end(out, line)
            continue
        if x.gone:
            if x.name in BLOCKS:
                _end(out, line)
            continue
        block = x.name in BLOCKS
        if block:
            _end(out, line)
            stack.append(None)
        elif x.name in ("br", "wbr"):
            line.append(" " if x.name == "br" else "")
        stack += reversed(x.parts)


def _end(out: list[str], line: list[str]) -> None:
    if line:
        raw = "".join(line)
        text = _SPACE.sub(" ", unescape(raw) if "&" in raw else raw).strip()
        if text:
            out.append(text)
        line.clear()


def main_text(html: str) -> str:
    """Main text of a page: its blocks joined by line feeds; empty if there is none."""
    root = parse(html)
    aside = set_aside(root)
    nodes = score(root)
    out: list[str] = []
    line: list[str] = []
    chosen = _chosen(nodes)
    tops = {id(n) for n in chosen}
    for node, within in aside:
        up = node
        while up is not None and id(up) not in tops:
            up = up.parent
        if up is not None:
            for n in within:
                n.gone = False
    for node in chosen:
        _blocks(node, out, line)
        _end(out, line)
    return "\n".join(out)


def extracted(html: Column) -> Column:
    """Main text of a column of UTF-8 bytes."""

    @F.arrow_udf("string")
    def run(pages: pa.Array) -> pa.Array:
        return pa.array([main_text(p.decode("utf-8", "replace")) for p in pages.to_pylist()], pa.string())

    return run.asNondeterministic()(html)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id_col, url_col, text, n_chars) of every page.

    A null or empty page has the empty text. Repeated rows give repeated rows, an empty table
    none; other columns are left out.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), extracted(text_bytes(html_col)).alias("text"))
    return rows.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.char_length("text").cast("long").alias("n_chars"))
