"""Text blocks of an HTML page, with where they stand in the document tree."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from html.parser import HTMLParser

# Element and class names.
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section "
    "select summary table tbody td textarea tfoot th thead title tr ul".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
SILENT = set(
    "script style noscript template head title svg math iframe object canvas audio video select option textarea "
    "button datalist".split()
)
BOILER_TAGS = set("nav header footer aside form menu dialog search".split())
BOILER_ROLES = set("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar "
                   "toolbar".split())
BOILER_WORDS = set(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie "
    "cookies consent gdpr notice popup modal overlay newsletter subscribe subscription signup share sharing social "
    "related recommended recommendations sidebar widget menu nav navbar navigation breadcrumb breadcrumbs header "
    "masthead topbar footer copyright comment comments disqus reply replies respond form login search toolbar "
    "pagination pager paywall tagcloud".split()
)
COMMENT_WORDS = set("comment comments disqus reply replies respond".split())
# Words that make a name a state or a kind of something else: no-comments, has-sidebar, share-enabled, long-form.
STATE_STARTS = set("no non not without with has hide long short free".split())
STATE_ENDS = set("enabled disabled allowed off".split())
CONTENT_WORDS = set("article post entry content story title".split())
WRAPPERS = set("html body main".split())
CLOSES_P = BLOCK - {"body", "html", "li", "dd", "dt", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "legend",
                    "option", "title"}
SIBLING_END = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
    "th": {"td", "th"}, "option": {"option"},
}
SIBLING_SCOPE = {"ul", "ol", "menu", "dl", "table", "select"}

WORDS = re.compile(r"[a-z]+")


@dataclass
class Node:
    tag: str
    number: int
    boiler: bool
    silent: bool
    content: bool
    firm: bool = False
    holds: bool = False  # an element inside, or the element itself, says that it is the article


@dataclass
class Block:
    text: str
    linked: int
    path: tuple[int, ...]
    tag: str
    boiler: bool
    content: bool
    inside: tuple[Node, ...] = field(default=(), repr=False)  # open elements that name themselves boilerplate

    def is_prose(self) -> bool:
        return len(self.text) >= 60 and self.linked * 2 < len(self.text) and any(c in self.text for c in ".!?")


def names_of(attrs: dict[str, str]) -> set[str]:
    """Words of an element's class and id, without names that are a state of the element."""
    out = set()
    for name in f"{attrs.get('class') or ''} {attrs.get('id') or ''}".lower().split():
        words = WORDS.findall(name)
        if len(words) > 1 and (words[0] in STATE_STARTS or words[-1] in STATE_ENDS):
            continue
        out.update(words)
    return out


def is_boiler(tag: str, attrs: dict[str, str]) -> bool:
    """Whether an element names itself as something other than the article."""
    words = names_of(attrs)
    if tag in WRAPPERS:
        return False
    if (attrs.get("role") or "").lower() in BOILER_ROLES:
        return True
    named = words & BOILER_WORDS
    if words & CONTENT_WORDS:  # the header of an article belongs to it
        named -= {"header", "banner"}
    if tag == "article":
        named &= {"comment", "comments", "reply", "replies", "ad", "ads", "advert", "advertisement", "sponsored", "promo"}
    return bool(named) or tag in BOILER_TAGS and not (tag == "header" and words & CONTENT_WORDS)


class _Reader(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[Block] = []
        self.stack: list[Node] = []
        self.count = 0
        self.parts: list[str] = []
        self.linked = 0
        self.place: tuple | None = None
        # Kept beside the stack, so that a piece of text costs the same at any depth.
        self.open: Counter[str] = Counter()
        self.path: list[int] = []
        self.last: list[str] = []
        self.boilers: list[Node] = []
        self.silent = self.content = 0

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            path, last, inside, content = self.place
            self.blocks.append(Block(text, min(self.linked, len(text)), path, last, bool(inside), content, inside))
        self.parts, self.linked, self.place = [], 0, None

    def pop_to(self, index: int) -> None:
        if any(n.tag in BLOCK for n in self.stack[index:]):
            self.flush()
        while len(self.stack) > index:
            node = self.stack.pop()
            self.open[node.tag] -= 1
            self.silent -= node.silent
            self.content -= node.content
            if node.boiler:
                self.boilers.pop()
            if node.tag in BLOCK:
                self.path.pop()
                self.last.pop()

    def push(self, node: Node, says_article: bool) -> None:
        self.stack.append(node)
        self.open[node.tag] += 1
        self.silent += node.silent
        self.content += node.content
        if node.boiler:
            node.holds = says_article
            self.boilers.append(node)
        elif says_article:
            for outer in reversed(self.boilers):
                if outer.holds:
                    break
                outer.holds = True
        if node.tag in BLOCK:
            self.path.append(node.number)
            self.last.append(node.tag)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("br", "wbr", "hr", "img"):
            if tag == "hr":
                self.flush()
            elif tag == "br":
                self.handle_data(" ")
            return
        if tag in VOID:
            return
        if tag in CLOSES_P:
            self.close_open({"p"}, {"button", "table", "td", "th", "caption", "object", "template"})
        if tag in SIBLING_END:
            self.close_open(SIBLING_END[tag], SIBLING_SCOPE)
        if tag in BLOCK:
            self.flush()
        values = {k: v or "" for k, v in attrs}
        hidden = "hidden" in values or re.search(r"display\s*:\s*none", values.get("style", ""))
        self.count += 1
        words = names_of(values)
        says_article = tag in ("article", "main") or bool(words & CONTENT_WORDS)
        self.push(Node(tag, self.count, is_boiler(tag, values), tag in SILENT or bool(hidden),
                       tag in ("article", "main"), bool(words & COMMENT_WORDS)), says_article)

    def close_open(self, tags: set[str], scope: set[str]) -> None:
        if not any(self.open[tag] for tag in tags):
            return
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i].tag in tags:
                self.pop_to(i)
                return
            if self.stack[i].tag in scope:
                return

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if not self.open[tag]:
            return
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i].tag == tag:
                self.pop_to(i)
                return

    def handle_data(self, data: str) -> None:
        if self.silent:
            return
        if self.place is None and data.strip():
            self.place = (tuple(self.path), self.last[-1] if self.last else "", tuple(self.boilers), self.content > 0)
        self.parts.append(data)
        if self.open["a"]:
            self.linked += len(data.strip())


def blocks_of(html: str) -> list[Block]:
    """Blocks in page order; an unfinished tag at the end of the page is no text.

    If all prose of a page stands inside elements that name themselves boilerplate, the
    names of those around an article are not believed, unless they are of comments: a
    form or a panel around the whole page does not take the article with it.
    """
    reader = _Reader()
    cut = html.rfind("<")
    if cut >= 0 and html.find(">", cut) < 0 and re.match(r"</?[a-zA-Z!]|<$|</$", html[cut : cut + 3]):
        html = html[:cut]
    reader.feed(html)
    reader.close()
    reader.flush()
    if not any(b.is_prose() and not b.boiler for b in reader.blocks):
        for block in reader.blocks:
            block.boiler = any(n.firm or not n.holds for n in block.inside)
    return reader.blocks
