"""Main text of HTML pages by tree scoring.

Paragraphs pass points for length and commas to their ancestors, fewer the farther these
are; an element's points are discounted by the share of its text inside links. The element
with most points is the container of the article. It is kept with those siblings that
carry text of the same kind. Page furniture inside (menus, forms, adverts, comments) goes.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

# Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th "
    "thead tr ul".split()
)
ENDS_P = BLOCKS - frozenset("body caption html legend tbody td tfoot th thead tr li dd dt".split())
HEADINGS = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])
#: An open element that a start tag ends, and the element that bounds the search.
CLOSES = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr",), ("table",)),
          "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",))}
# What is never article text.
FURNITURE = frozenset(
    "aside audio button canvas datalist dialog footer form head iframe input map menu nav noscript object "
    "script search select style svg template textarea title video".split()
)
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
_WORDS = (
    r"(?:ad|ads|adv|adbox|adslot|advert[a-z]*|sponsor[a-z]*|promo[a-z]*|banner|cookie[a-z]*|consent|gdpr|notice[a-z]*|alert|"
    r"newsletter|subscri[a-z]*|signup|login|sidebar[a-z]*|menu[a-z]*|nav|navbar|navigation|breadcrumb[a-z]*|footer|masthead|(?:site|top|main|global)-?header|"
    r"comment[a-z]*|disqus[a-z]*|repl(?:y|ies)|respond|share|sharing|social|related|recommend[a-z]*|popup|modal|overlay|widget[a-z]*|"
    r"toolbar|pager|pagination|copyright|disclaimer)"
)
_NAMES = re.compile(rf"(?:^|[^a-z]){_WORDS}(?:[^a-z]|$)")
_WORD = re.compile(_WORDS)
#: Words that say nothing by themselves: a name made of them and of furniture's words only is furniture for certain.
_PLAIN = frozenset(
    "area article articles bar block body bottom box btn button buttons card cards col column container content count desktop fixed follow "
    "form grid group header icon icons inner item items left link links list main media mobile more news on outer page panel post posts "
    "primary right row secondary section side site slot sticky stories story text this thread title tools top unit us wrap wrapper".split()
)
#: Names that say something about an element's surroundings.
_ABOUT = re.compile(r"(?:has|no|with|without|is|js)-")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|"
    r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)",
    re.S,
)
_ATTR = re.compile(r"([a-zA-Z-]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SCORED = frozenset("article body div li main section span td center dd blockquote".split())


class Node:
    __slots__ = ("bad", "commas", "heads", "kids", "length", "linked", "links", "parent", "score", "sure", "tag")

    def __init__(self, tag: str, parent: Node | None, bad: bool, sure: bool = False):
        self.tag, self.parent, self.bad, self.sure = tag, parent, bad, sure
        self.kids: list = []
        self.score = 0.0
        self.length = self.linked = self.commas = self.links = self.heads = 0


def _certain(name: str) -> bool:
    """Whether nothing in the name speaks of anything but furniture: "share-buttons" does not, "share-price" does."""
    words = [w for w in re.split(r"[^a-z]+", name) if w]
    return any(_WORD.fullmatch(w) for w in words) and all(_WORD.fullmatch(w) or w in _PLAIN for w in words)


def _furniture(tag: str, attrs: str, open_tags: dict[str, int]) -> tuple[bool, bool]:
    """Whether an element looks like furniture, and whether it is so for certain, that is inside an article too."""
    if tag in FURNITURE:
        return True, True
    if tag == "header":
        return (not open_tags.get("article"),) * 2
    if not attrs or tag in ("html", "body", "article", "main"):
        return False, False
    for m in _ATTR.finditer(attrs):
        name = m[1].lower()
        if name in ("class", "id"):
            names = _CAMEL.sub("-", m[2] or m[3] or m[4] or "").lower().split()
            if any(x == "header" or _NAMES.search(x) and not _ABOUT.match(x) for x in names):
                sure = any(x == "header" or _certain(x) and not _ABOUT.match(x) for x in names)
                return tag not in HEADINGS, sure and tag not in HEADINGS
        elif name == "hidden" or name == "role" and (m[2] or m[3] or m[4] or "").lower() in ROLES:
            return True, True
    return False, False


def parse(html: str) -> Node:
    """The element tree; text is kept as strings among the children. Linear in the length."""
    root = Node("html", None, False)
    at, stack, count, pos = root, [root], {}, 0

    def close(upto):
        nonlocal at
        while len(stack) > 1:
            gone = stack.pop()
            count[gone.tag] -= 1
            at = stack[-1]
            if gone is upto:
                return

    def innermost(tags, bounds=()):
        if not any(count.get(t) for t in tags):
            return None
        for node in reversed(stack):
            if node.tag in tags:
                return node
            if node.tag in bounds:
                return None
        return None

    n = len(html)
    while pos < n:
        m = _TOKEN.search(html, pos)
        if not m:
            at.kids.append(html[pos:])
            break
        if m.start() > pos:
            at.kids.append(html[pos : m.start()])
        pos = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            if count.get(tag):
                close(innermost((tag,)))
            continue
        if tag in ENDS_P and count.get("p") and (p := innermost(("p",), ("td", "th", "button"))):
            close(p)
        if tag in CLOSES and (node := innermost(*CLOSES[tag])):
            close(node)
        if tag in HEADINGS and at.tag in HEADINGS:
            close(at)
        if tag in ("html", "body") and (tag == "html" or count.get("body")):
            continue
        attrs = m[3] or m[6] or ""
        bad, sure = _furniture(tag, attrs, count)
        node = Node(tag, at, at.bad or bad, at.sure or sure)
        at.kids.append(node)
        if tag in VOID:
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*+>?", re.I).search(html, pos)
            pos = end.end() if end else n
            continue
        stack.append(node)
        count[tag] = count.get(tag, 0) + 1
        at = node
    return root


def _order(root: Node) -> list[Node]:
    """Elements, parents before children, without those that are furniture."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        if node.bad:
            continue
        out.append(node)
        todo.extend(k for k in reversed(node.kids) if type(k) is Node)
    return out


def _measure(nodes: list[Node]) -> None:
    """Text length, length inside links, commas and links of every element, bottom up; then points."""
    for node in reversed(nodes):
        own = 0
        for k in node.kids:
            if type(k) is str:
                own += len(k.strip())
                node.commas += k.count(",") + k.count("、") + k.count("，")
        node.length += own
        if node.tag == "a":
            node.linked, node.links = node.length, node.links + 1
        if node.tag in HEADINGS:
            node.heads += 1
        if (up := node.parent) is not None:
            up.heads += node.heads
            up.length += node.length
            up.linked += node.linked
            up.commas += node.commas
            up.links += node.links
        node.score += own if node.tag in _SCORED and own >= 25 else 0  # kept for the next step
    for node in nodes:
        own, node.score = node.score, 0.0
        if node.parent is None or not (node.tag in ("p", "pre") or own) or node.length < 25:
            continue
        points = 1 + node.commas + min(node.length / 100, 3)
        if node.tag not in ("p", "pre"):
            node.score += points  # text that stands in the element itself
        up, far = node.parent, 1
        while up is not None and far <= 6:
            up.score += points / (1 if far == 1 else 2 if far == 2 else 3 * far)
            up, far = up.parent, far + 1


def _density(node: Node) -> float:
    return node.linked / node.length if node.length else 0.0


def _text_of(parts: list, blocks: list[str], inside: bool = False) -> None:
    """Appends the blocks of nodes and strings in page order.

    ``inside`` the article only what is furniture for certain is left out; lists of links there are its references.
    """
    run: list[str] = []

    def cut():
        text = " ".join(unescape("".join(run)).split())
        run.clear()
        if text:
            blocks.append(text)

    todo: list = list(reversed(parts))
    while todo:
        k = todo.pop()
        if type(k) is str:
            run.append(k)
        elif k is None:
            cut()
        elif not (k.sure if inside else k.bad):
            if k.tag == "br":
                run.append(" ")
                continue
            if not inside and k.tag in ("ul", "ol", "dl", "div", "section", "table") and k.links > 2 and _density(k) > 0.6:
                cut()  # a menu without a name
                continue
            block = k.tag in BLOCKS
            if block:
                cut()
                todo.append(None)
            todo.extend(reversed(k.kids))
    cut()


def main_text(html: str | None) -> str:
    """The article's blocks, one per line; empty for a null or empty page or one without text."""
    root = parse(html or "")
    nodes = _order(root)
    _measure(nodes)
    best, most = None, 0.0
    for node in nodes:
        score = node.score * (1 - _density(node))
        if score > most and node.tag not in ("p", "pre", "a"):
            best, most = node, score
    blocks: list[str] = []
    if best is None:
        # no paragraph of any length: what is marked as the article, or all there is
        marked = [n for n in nodes if n.tag in ("article", "main") and n.length]
        _text_of([max(marked, key=lambda n: n.length) if marked else root], blocks, bool(marked))
        return "\n".join(blocks)
    # an element that marks the article as a whole, or shares its text with one other wrapper only
    above = list(_ancestors(best))
    marks = next((t for t in ("article", "main") if t == best.tag or any(up.tag == t for up in above)), None)
    for up in above:
        if up.tag == marks or up.length == best.length and best.tag != marks:
            best = up
    if best.parent is None:
        _text_of([best], blocks, True)
        return "\n".join(blocks)
    # the wrapper of an unmarked article holds the rest of it; beside a marked one, or in the body, more is asked
    strict = best.tag in ("article", "main") or best.parent.tag in ("html", "body")
    run: list = []
    ahead = True
    for k in best.parent.kids:
        if k is best:
            _text_of(run, blocks)
            _text_of([best], blocks, True)
            run, ahead = [], False
        elif type(k) is str:
            if not strict or best.tag not in ("article", "main") and len(k.strip()) >= 25:
                run.append(k)
        elif k.bad:
            continue
        elif _density(k) < 0.33 and (not strict or _belongs(k, most, ahead, best)):
            run.append(k)
        elif k.score * (1 - _density(k)) >= max(4.0, 0.2 * most) or k.tag in HEADINGS:
            run.append(k)
    _text_of(run, blocks)
    return "\n".join(blocks)


def _belongs(k: Node, most: float, ahead: bool, best: Node) -> bool:
    """Whether an element beside the container is part of the article: like text, a headline in front, prose, a table or a list."""
    if k.tag not in BLOCKS:
        return False
    if k.score * (1 - _density(k)) >= max(4.0, 0.2 * most) or k.tag in HEADINGS or ahead and k.heads:
        return True
    prose = k.tag in ("p", "pre", "blockquote")
    return k.length >= 25 and (prose or k.tag in ("table", "ul", "ol", "dl", "figure") and best.tag not in ("article", "main"))


def _ancestors(node: Node):
    while node.parent is not None:
        node = node.parent
        yield node


def extract(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text, n_chars)`` per row of ``pages``.

    A null or empty page has an empty text. Repeated rows are read each; extra columns are
    not used; an empty table gives an empty result. The tree of one page at a time is held.
    """
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            texts = [main_text(h) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"]
            )

    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
