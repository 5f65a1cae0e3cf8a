"""A page as structural tokens and text blocks: the input of template deduction.

The reader is tolerant: unclosed and misnested tags, missing end tags, truncated references and comments
are all accepted. Inline elements neither open a level nor end a block."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

import xxhash

_TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?][^>]*>""", re.S
)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
_SPLIT = re.compile(r"[^A-Za-z]+|(?<=[a-z])(?=[A-Z])")

#: Elements that stand inside a line of text.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
#: Elements whose content is not markup; none of it is text of the page.
RAW = frozenset("script style noscript template textarea iframe svg math object canvas audio video xmp noframes title".split())
#: Elements without content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that are never main text.
FURNITURE = frozenset("head nav header footer aside form menu dialog button select datalist fieldset".split())
#: Elements that can hold a page's main text as a whole.
CONTAINERS = frozenset("html body main article section div center table tbody tr td".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: An open element of the key ends where one of the value's begins.
_BLOCKISH = frozenset("p div ul ol dl table h1 h2 h3 h4 h5 h6 pre blockquote section article aside header footer nav form figure hr address main fieldset details".split())
CLOSED_BY = {"p": _BLOCKISH, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"])}

#: Words of class, id and role names. Strong ones mark furniture always, weak ones unless a main word stands beside them.
STRONG = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr menu modal nav navbar navigation newsletter overlay pager pagination popup promo sidebar signup sponsor sponsored subscribe subscription toolbar".split()
)
WEAK = frozenset("alert aside banner form header login masthead notice notices related replies reply respond search share sharing social tags teaser toc widget widgets".split())
MAIN = frozenset("article body content entry main maincontent post story text".split())
NEGATED = frozenset("with has no without".split())


@dataclass
class Element:
    name: str
    path: int
    furniture: bool  # it or an element around it is furniture
    main: bool  # it or an element around it is marked as main text
    text: bool = True


@dataclass
class Page:
    tokens: dict[int, list] = field(default_factory=dict)  # path hash: [parent hash, label, count, characters of text in it if it is a container]
    blocks: list[tuple[str, tuple[int, ...], bool, bool]] = field(default_factory=list)  # text, paths outside in, furniture, main


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def text_token(path: int, text: str) -> int:
    """Token of a whole text block at its place in the tree."""
    return _signed(xxhash.xxh3_64_intdigest(f"{path}\0{text}".encode("utf-8", "replace"), 7))


def judge_names(name: str, attributes: str) -> tuple[bool, bool, str]:
    """Is the element furniture by name or attributes; does it hold main text; its label."""
    furniture, main, names = name in FURNITURE, name in ("article", "main"), []
    strong = weak = clean = False
    for m in _ATTRIBUTE.finditer(attributes):
        kind, value = m[1].lower(), html.unescape((m[2] or "").strip("\"'"))
        if kind == "hidden" or kind == "aria-hidden" and value == "true" or kind == "style" and re.search(r"display\s*:\s*none", value):
            furniture = True
        elif kind == "itemprop":
            main |= value.lower() in ("articlebody", "text")
            furniture |= value.lower() == "comment"
        elif kind in ("class", "id", "role"):
            for one in value.split():
                words = [w.lower() for w in _SPLIT.split(one) if w]
                names.append("-".join(words))
                if kind == "role":
                    furniture |= one in ("navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "menu", "form")
                    main |= one in ("main", "article")
                elif words and words[0] not in NEGATED:
                    strong |= not STRONG.isdisjoint(words)
                    weak |= not WEAK.isdisjoint(words)
                    clean |= not MAIN.isdisjoint(words)
    if name not in ("html", "body", "main", "article") or "comment" in names or "comments" in names:
        furniture |= strong or weak and not clean
    return furniture, (main or clean and not weak) and not furniture, ".".join([name, *names])


#: Name words that mark an inline element as furniture (the strong ones do as well).
INLINE_WORDS = frozenset("share sharing social".split())


def inline_furniture(attributes: str) -> bool:
    """Is an inline element hidden, or named as an advert, a sharing link or the like?"""
    for m in _ATTRIBUTE.finditer(attributes):
        kind, value = m[1].lower(), html.unescape((m[2] or "").strip("\"'"))
        if kind == "hidden" or kind == "aria-hidden" and value == "true" or kind == "style" and re.search(r"display\s*:\s*none", value):
            return True
        if kind in ("class", "id"):
            for one in value.split():
                words = [w.lower() for w in _SPLIT.split(one) if w]
                if words and words[0] not in NEGATED and not (STRONG | INLINE_WORDS).isdisjoint(words) and MAIN.isdisjoint(words):
                    return True
    return False


def _after_close(source: str, name: str, at: int) -> int:
    """Behind the end tag that closes an element ``name`` opened before ``at``; ``at`` if there is none."""
    depth = 1
    for m in re.finditer(rf"<(/?){re.escape(name)}(?=[\s/>])[^>]*>", source[at:], re.I):
        depth += -1 if m[1] else 1
        if not depth:
            return at + m.end()
    return at


def read_page(source: str) -> Page:
    page = Page()
    stack: list[Element] = [Element("", 0, False, False)]
    pieces: list[str] = []

    def end_block() -> None:
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            pieces.clear()
            top = stack[-1]
            if text and top.text:
                page.blocks.append((text, tuple(e.path for e in stack[1:]), top.furniture, top.main))
                for e in stack[1:] if not top.furniture else ():
                    if e.name in CONTAINERS:
                        page.tokens[e.path][3] += len(text)

    at, end = 0, len(source)
    while at < end:
        m = _TAG.search(source, at)
        if m is None:
            pieces.append(source[at:])
            break
        if m.start() > at:
            pieces.append(source[at : m.start()])
        at = m.end()
        closing, name, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if name is None:
            continue
        name = name.lower()
        if name in RAW:
            if not closing and not attributes.endswith("/"):
                close = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(source, at)
                at = close.end() if close else end
            pieces.append(" ")
            continue
        if name in INLINE:
            if name in ("br", "img"):
                pieces.append(" ")
            elif not closing and attributes and inline_furniture(attributes):
                at = _after_close(source, name, at)
            continue
        end_block()
        if closing:
            depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].name == name), 0)
            if depth:
                del stack[depth:]
            continue
        while len(stack) > 1 and name in CLOSED_BY.get(stack[-1].name, ()):
            stack.pop()
        above = stack[-1]
        furniture, main, label = judge_names(name, attributes)
        if name == "header" and above.main and not above.furniture:
            furniture = False  # an article's own heading: only its headings are text
        inner = Element(name, _signed(xxhash.xxh3_64_intdigest(f"{above.path}\0{label}".encode("utf-8", "replace"))), above.furniture or furniture, above.main or main)
        inner.text = name in HEADINGS or name != "header" and above.text
        token = page.tokens.setdefault(inner.path, [above.path, label, 0, 0])
        token[2] += 1
        if name not in VOID and not attributes.endswith("/"):
            stack.append(inner)
    end_block()
    return page
