"""One page at a time: text, headings and author from HTML (standard library only)."""

from __future__ import annotations

from collections import Counter
from html.parser import HTMLParser

# Fixed values of the HTML standard: elements without content, and elements whose start
# tag ends an open paragraph.
VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
ENDS_PARAGRAPH = frozenset(
    "address article aside blockquote center details dialog dd dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table ul".split()
)
HEADINGS = ("h1", "h2", "h3")
SILENT = frozenset(["script", "style", "noscript"])
MAX_HEADINGS = 5


class _Page(HTMLParser):
    """Collects text nodes with the context they stand in."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[str] = []
        self.depth: Counter[str] = Counter()  # open elements by name
        self.silent = 0
        self.words: list[str] = []
        self.paragraphs: list[list[str]] = []
        self.headings: list[list[str]] = []
        self.in_heading: list[list[str]] = []
        self.author: str | None = None
        self.author_seen = False
        # text blocks between block tags, with the share of words inside links
        self.blocks: list[list[int | list[str]]] = [[0, 0, []]]

    def handle_starttag(self, tag, attrs):
        fields = dict(attrs)
        if fields.get("name") == "author" and not self.author_seen:
            self.author_seen = True
            self.author = fields.get("content") or None
        if tag in ENDS_PARAGRAPH:
            if self.depth["p"]:
                self._close("p")
            self._break()
        if tag in HEADINGS and self.open and self.open[-1] in HEADINGS:
            self._close(self.open[-1])
        if tag in VOID:
            return
        self.open.append(tag)
        self.depth[tag] += 1
        self.silent += tag in SILENT
        if self.silent:
            return
        if tag == "p":
            self.paragraphs.append([])
        if tag in HEADINGS:
            self.headings.append([])
            self.in_heading.append(self.headings[-1])

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if self.depth[tag]:
            self._close(tag)
        if tag in ENDS_PARAGRAPH:
            self._break()

    def _close(self, tag):
        while self.open:
            last = self.open.pop()
            self.depth[last] -= 1
            self.silent -= last in SILENT
            if last in HEADINGS and self.in_heading:
                self.in_heading.pop()
            if last == tag:
                return

    def _break(self):
        if self.blocks[-1][2]:
            self.blocks.append([0, 0, []])

    def handle_data(self, data):
        if self.silent:
            return
        text = data.strip()
        if not text:
            return
        self.words.append(text)
        if self.depth["p"] and self.paragraphs:
            self.paragraphs[-1].append(text)
        for heading in self.in_heading:
            heading.append(text)
        if self.depth["title"]:
            return
        block, n = self.blocks[-1], len(text.split())
        block[0] += n
        block[1] += n if self.depth["a"] else 0
        block[2].append(text)


def _content_blocks(blocks) -> str:
    """Blocks judged content by word counts and link density of a block and its
    neighbours (Kohlschütter, Fankhauser, Nejdl, 2010)."""
    blocks = [b for b in blocks if b[2]]
    kept = []
    for i, (words, linked, parts) in enumerate(blocks):
        before = blocks[i - 1] if i else (0, 0, ())
        after = blocks[i + 1] if i + 1 < len(blocks) else (0, 0, ())
        density = linked / words if words else 0.0
        before_density = before[1] / before[0] if before[0] else 0.0
        if density > 0.333333:
            keep = False
        elif before_density <= 0.555556:
            keep = words > 16 or after[0] > 15 or before[0] > 4
        else:
            keep = words > 40 or after[0] > 17
        if keep:
            kept.append(" ".join(parts))
    return "\n".join(kept)


def read_page(html: str) -> tuple[str, list[str], str | None, str]:
    """``(text, headings, author, main)`` of one page.

    ``text`` is the non-empty paragraphs, or all text when there are none; ``main`` is
    the content blocks, or ``text`` when none qualifies.
    """
    page = _Page()
    page.feed(html or "")
    page.close()
    paragraphs = [" ".join(p) for p in page.paragraphs if p]
    text = "\n\n".join(paragraphs) or " ".join(page.words)
    headings = [" ".join(h) for h in page.headings if h][:MAX_HEADINGS]
    return text, headings, page.author, _content_blocks(page.blocks) or text
