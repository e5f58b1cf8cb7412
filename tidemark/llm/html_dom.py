"""A tolerant reader of HTML: elements, their style paths, and blocks of text."""
from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import xxhash

#: Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script|style|template|noscript|iframe|noembed|noframes|xmp|title|textarea|svg|math"
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option optgroup p pre search section select summary "
    "table tbody td tfoot th thead tr ul".split()
)
#: An open element of the key's kind ends where one of these begins, unless a container stands between.
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("tbody", "thead", "tr", "td", "th"), "tfoot": ("tbody", "thead", "tr", "td", "th")}
CONTAINER = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr"), "option": ("select",), "tbody": ("table",), "tfoot": ("table",)}

TOKEN = re.compile(
    rf"<!--(?:.*?--!?>|.*\Z)|<({RAW})(?=[\s/>])[^>]*>(?:.*?</\1(?=[\s/>])[^>]*>|.*\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"""(class|id|role|hidden|style|aria-hidden|aria-modal)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s/>"']|\Z)""", re.I)
WORDS = re.compile(r"[a-z]+")

#: Elements and names of what is not the article.
NOISE_TAGS = frozenset("head nav footer aside form button select dialog menu search object canvas audio video map fieldset input".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
NOISE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices "
    "popup modal overlay newsletter subscribe subscription signup sidebar sidebars widget widgets nav navbar navigation menu menus breadcrumb "
    "breadcrumbs pagination pager share sharing social related recommended comment comments commentlist disqus reply replies respond login "
    "footer masthead topbar header skip hidden".split()
)
#: Words that may stand beside these in a name ("widget-area"); any other clears it ("no-sidebar").
BESIDE = frozenset("site page main top bottom left right primary secondary global side area bar box list section block wrapper wrap container inner slot buttons button links link".split())
#: Elements that come in any number: all of one parent are one node of the style tree. Of others without
#: a name the first, second and so on below a parent are nodes of their own.
REPEATING = frozenset("a abbr b br cite code dd dt em h1 h2 h3 h4 h5 h6 hr i img li mark option p pre q s small span strong sub sup tbody td th tr u".split())
#: Names of what readers write, which is no article however long it is.
READERS = frozenset("comment comments commentlist disqus reply replies respond".split())


@dataclass
class Element:
    tag: str
    key: int
    parent: int
    noise: bool  # by tag or role, of itself or of an ancestor
    article: bool  # inside the page's article or main part
    named: int = 0  # the nearest name that says noise, of itself or of an ancestor; 0: none
    mute: bool = False  # its text is not read: noise within a line
    names: frozenset = frozenset()
    children: list = field(default_factory=list)
    counts: dict = field(default_factory=dict)
    text: list = field(default_factory=list)


@dataclass
class Block:
    text: str
    key: int
    path: tuple
    noise: bool  # by tag or role, or all of it by name
    article: bool
    pieces: list = field(default_factory=list)  # (text, named)


@dataclass
class Named:
    """An element whose name says noise."""

    above: int  # the next such name above, or 0
    readers: bool
    inside: bool  # within the page's article or main part
    holds: bool = False  # the page's article, so that the name does not count


_keys: dict[tuple, int] = {}


def style_key(above: Element, tag: str, names: frozenset) -> int:
    """A node of the style tree: the path of tags, names and places from the root."""
    place = 0
    if not names and tag not in REPEATING:
        place = above.counts[tag] = above.counts.get(tag, -1) + 1
    known = (above.key, tag, names, place)
    if known not in _keys:
        if len(_keys) > 200_000:
            _keys.clear()
        _keys[known] = xxhash.xxh64_intdigest(f"{above.key}/{tag}.{'.'.join(sorted(names))}{f':{place}' if place else ''}") >> 1
    return _keys[known]


def _says_noise(value: str) -> frozenset:
    """The noise words of those class or id tokens that have no words but such and ``BESIDE``."""
    out = frozenset()
    for token in value.split():
        words = frozenset(WORDS.findall(token))
        if words and words <= NOISE_NAMES | BESIDE:
            out |= words & NOISE_NAMES
    return out


def _attributes(raw: str) -> tuple[frozenset, frozenset, str, bool]:
    names, noisy, role, hidden = frozenset(), frozenset(), "", False
    for m in ATTRIBUTE.finditer(raw):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name in ("class", "id"):
            names |= frozenset(WORDS.findall(value))
            noisy |= _says_noise(value)
        elif name == "role":
            role = value.strip()
        elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and "display:none" in value.replace(" ", "")):
            hidden = True
        elif name == "aria-modal":
            role = role or "dialog"
    return names, noisy, role, hidden


def read(page: str) -> Iterator[Element | Block]:
    """Elements as they end, and blocks of text as they end, in page order of their ends."""
    root = Element("", 0, 0, False, False)
    stack = [root]
    text: list[tuple[str, int]] = []
    known = [Named(0, False, False)]
    out: list[Element | Block] = []

    def flush() -> None:
        if text:
            at = next(i for i in range(len(stack) - 1, -1, -1) if stack[i].tag in BLOCK or not i)
            out.append(Block("", stack[at].key, tuple(e.key for e in stack[1 : at + 1]), stack[-1].noise, stack[-1].article, text.copy()))
            text.clear()

    def pop(to: int) -> None:
        while len(stack) > to:
            flush_needed = stack[-1].tag in BLOCK
            if flush_needed:
                flush()
            out.append(stack.pop())

    def closes(tags: tuple, stop: tuple) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in stop:
                return
            if stack[i].tag in tags:
                pop(i)
                closes(tags, stop)
                return

    at = 0
    for m in TOKEN.finditer(page):
        if m.start() > at and not stack[-1].mute:
            piece = page[at : m.start()]
            text.append((html.unescape(piece) if "&" in piece else piece, stack[-1].named))
        at = m.end()
        tag = (m[3] or m[6] or "").lower()
        if not tag:
            continue  # comment, declaration, or an element whose content is no text
        if m[2] or m[5]:
            inline = tag not in BLOCK
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    pop(i)
                    break
                if inline and stack[i].tag in BLOCK:
                    break
            else:
                if not inline:
                    flush()
            continue
        if tag in ("br", "wbr"):
            if tag == "br" and not stack[-1].mute:
                text.append((" ", stack[-1].named))
            continue
        if tag in BLOCK:
            flush()
            for i in range(len(stack) - 1, 0, -1):  # a block ends an open paragraph
                if stack[i].tag == "p":
                    pop(i)
                    break
                if stack[i].tag in BLOCK:
                    break
        if tag in SIBLINGS:
            closes(SIBLINGS[tag], CONTAINER[tag])
        names, noisy, role, hidden = _attributes(m[4] or m[7] or "")
        above = stack[-1]
        article = above.article or tag in ("article", "main") or role in ("main", "article")
        noise = above.noise or hidden or tag in NOISE_TAGS or role in NOISE_ROLES or (tag == "header" and not above.article)
        if above.article:
            noisy -= {"header"}  # the head of the article, as the tag
        named = above.named
        if noisy and tag not in ("html", "body", "main") and (tag != "article" or above.article):
            known.append(Named(above.named, bool(noisy & READERS), above.article))
            named = len(known) - 1
        key = style_key(above, tag, names)
        above.children.append(tag)
        if tag in VOID:
            continue
        stack.append(Element(tag, key, above.key, noise, article, named, above.mute or (noise and not above.noise and tag not in BLOCK), names))
    if at < len(page) and not stack[-1].mute:
        piece = page[at:]
        text.append((html.unescape(piece) if "&" in piece else piece, stack[-1].named))
    flush()
    pop(1)
    return iter(_resolved(out, known))


def _resolved(out: list[Element | Block], known: list[Named]) -> list[Element | Block]:
    """Takes the text of elements whose name says noise out of the blocks; a block of such text only
    keeps it, as noise. Names do not count for what holds the page's longest article, where none stands
    outside such elements, or, on a page without, most of its text (but for readers' words); nor for a
    page that would have no text left."""
    blocks = [x for x in out if isinstance(x, Block)]
    if len(known) > 1:
        size, parts, within = [0] * len(known), [0] * len(known), 0  # parts: of articles, by what stands around them
        for b in blocks:
            for piece, named in b.pieces:
                n = 0 if b.noise else len(piece.strip())
                within += n
                around = named
                while around and known[around].inside:
                    around = known[around].above
                parts[around] += n * b.article
                while named:
                    size[named] += n
                    named = known[named].above
        if any(parts):
            at = 0 if parts[0] else parts.index(max(parts))
            while at and not known[at].readers:
                known[at].holds, at = True, known[at].above
        else:
            for x, n in zip(known[1:], size[1:], strict=True):
                x.holds = 2 * n > within and not x.readers

    def gone(named: int) -> bool:
        while named and known[named].holds:
            named = known[named].above
        return named > 0

    left = any(piece.strip() and not gone(named) for b in blocks if not b.noise for piece, named in b.pieces)
    for b in blocks:
        kept = b.pieces if b.noise or not left else [x for x in b.pieces if not gone(x[1])]
        b.text = " ".join("".join(piece for piece, _ in kept).split())
        if not b.text and len(kept) < len(b.pieces):
            b.text, b.noise = " ".join("".join(piece for piece, _ in b.pieces).split()), True
        b.pieces = []
    return [x for x in out if not isinstance(x, Block) or x.text]
