"""Text lines of one page, each with the part of the page it stands in. Used inside tasks."""

from __future__ import annotations

import math
import re
from html import unescape

# Parts, from the surest to the weakest sign that a line is the article's; DROPPED is none of it. FORM is
# prose inside a form, which is text only where a page has no other.
DROPPED, ARTICLE, MAIN, CONTENT, OTHER, FORM = range(6)

RAW = frozenset("script style noscript template iframe svg math object canvas audio video textarea title head".split())
NEVER = frozenset("nav footer aside button select dialog menu menuitem option datalist".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rb rp rt ruby s samp "
    "small span strike strong sub sup time tt u var wbr input td th".split())
ENDS_P = frozenset(
    "address article aside blockquote center details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr main menu nav ol p pre section table ul".split())
ITEMS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}}
DROPPED_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsbygoogle sponsor sponsored promo promotion banner nav navbar "
    "navigation menu breadcrumb breadcrumbs pagination pager sidebar footer cookie cookies consent gdpr notice notices alert "
    "newsletter subscribe subscription signup signin login register paywall comment comments disqus respond reply replies "
    "related recommended share sharing social popup modal overlay toolbar search searchbox widget widgets skip".split())
# Words that tell no more beside one of the names above: `share-buttons` is a name, `related-work` is not.
PLAIN_NAMES = frozenset(
    "area articles article bar block bottom box btn button buttons center col column container desktop entries entry floating "
    "form global google group header inline inner item items layout left link links list main mobile outer page panel post posts "
    "primary recent right row secondary section site slot sticky stories this top unit with wrap wrapper".split())
HEADER_NAMES = frozenset("header masthead topbar".split())
CONTENT_NAMES = frozenset("article content post entry story main body".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())

TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>|<[a-zA-Z/!?][^>]*\Z""",
    re.DOTALL)
ATTRIBUTE = re.compile(r"""([^\s=/"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PROSE = HEADINGS | frozenset("p li td th dt dd blockquote pre figcaption caption".split())
NAME_PARTS = re.compile(r"[^a-z0-9]+")
UNLIKE = frozenset("with has no without".split())


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): (m[2] or m[3] or m[4] or "").lower() for m in ATTRIBUTE.finditer(text)}


def _names(found: dict[str, str], tag: str) -> list[list[str]]:
    """The words of each class and of the id. The id of a heading is an anchor and names its subject."""
    tokens = found.get("class", "").split() + ([] if tag in HEADINGS else found.get("id", "").split())
    return [[p for p in (w.rstrip("0123456789") for w in NAME_PARTS.split(t)) if p] for t in tokens]


def _framed(words: list[str], names: frozenset[str]) -> tuple[bool, bool]:
    """Whether a name has a word of a site's frame, and whether it has no words but such and plain ones."""
    has = any(w in names and not (i and words[i - 1] in UNLIKE) for i, w in enumerate(words))
    return has, has and all(w in names or w in PLAIN_NAMES for w in words)


def _part(tag: str, attributes: str, around: tuple[int, bool]) -> tuple[int, bool]:
    """The part an element opens, and whether its name leaves a doubt that it is the site's frame.

    Without signs of its own it is the part around it. A name of frame words only drops the element. One
    with further words is a doubt in a container, and says nothing on an element that holds prose.
    """
    inside, doubt = around
    if tag in NEVER or (tag == "header" and inside in (OTHER, FORM)) or (inside == FORM and tag in ("label", "legend")):
        return DROPPED, False
    if tag == "article":
        best = ARTICLE
    elif tag == "main":
        best = MAIN
    elif tag == "form":
        best = inside = FORM
    else:
        best = inside
    if attributes and tag not in ("html", "body"):
        found = _attributes(attributes)
        if "hidden" in found or "display:none" in found.get("style", "").replace(" ", ""):
            return DROPPED, False
        role = found.get("role", "")
        if role in DROPPED_ROLES:
            return DROPPED, False
        names = _names(found, tag)
        frame = DROPPED_NAMES | HEADER_NAMES if inside in (OTHER, FORM) else DROPPED_NAMES
        for words in names if tag != "form" else ():
            has, only = _framed(words, frame)
            if only:
                return DROPPED, False
            doubt = doubt or (has and tag not in PROSE and tag not in INLINE)
        if role == "main":
            best = min(best, MAIN)
        elif role == "article" or found.get("itemprop") == "articlebody":
            best = min(best, ARTICLE)
        elif tag in ("div", "section", "td") and any(w in CONTENT_NAMES for words in names for w in words):
            best = min(best, CONTENT)
    return min(best, inside), doubt


def page_lines(html: str) -> tuple[list[str], list[int], list[bool]]:
    """The blocks of a page in order, white space made one blank, the part of each, and whether it is in doubt."""
    lines: list[str] = []
    parts: list[int] = []
    doubts: list[bool] = []
    stack: list[tuple[str, tuple[int, bool]]] = []
    part, at, held = (OTHER, False), 0, []

    def close() -> None:
        if held:
            line = " ".join("".join(held).split())
            if line:
                lines.append(line)
                label = part[0] == FORM and not any(t in PROSE for t, _ in stack)
                parts.append(DROPPED if label else part[0])
                doubts.append(part[1])
            held.clear()

    end = len(html)
    while at < end:
        m = TAG.search(html, at)
        if m is None:
            held.append(unescape(html[at:]))
            break
        if m.start() > at:
            held.append(unescape(html[at:m.start()]))
        at = m.end()
        tag = m[2] or m[5]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1] or m[4]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    if tag not in INLINE or stack[i][1] != part:
                        close()
                    elif tag in ("td", "th"):
                        held.append(" ")
                    part = stack[i][1]
                    del stack[i:]
                    break
            else:
                if tag not in INLINE:
                    close()
            continue
        if tag in RAW:
            found = re.compile(f"</{tag}[^>]*>", re.IGNORECASE).search(html, at)
            if tag != "head":
                at = found.end() if found else end
            elif found:
                at = found.end()
            continue
        if tag in VOID:
            if tag == "br":
                held.append(" ")
            elif tag not in INLINE:
                close()
            continue
        if tag in ENDS_P:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == "p":
                    close()
                    part = stack[i][1]
                    del stack[i:]
                    break
                if stack[i][0] not in INLINE:
                    break
        elif tag in ITEMS:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag or (tag in ("dt", "dd") and stack[i][0] in ("dt", "dd")):
                    if tag not in INLINE:
                        close()
                    part = stack[i][1]
                    del stack[i:]
                    break
                if stack[i][0] in ITEMS[tag]:
                    break
        new = part if part[0] == DROPPED else _part(tag, m[3] or m[6] or "", part)
        if tag in ("td", "th"):
            held.append(" ")
        if tag not in INLINE or new != part:
            close()
        stack.append((tag, part))
        part = new
    close()
    return lines, parts, doubts


def shared_lines(a: list, b: list) -> list[int]:
    """Positions in `a` of a longest common subsequence with `b`, by bit-parallel rows."""
    first = 0
    while first < len(a) and first < len(b) and a[first] == b[first]:
        first += 1
    last = 0
    while last < min(len(a), len(b)) - first and a[-1 - last] == b[-1 - last]:
        last += 1
    mid, other = a[first:len(a) - last], b[first:len(b) - last]
    at: dict = {}
    for j, x in enumerate(other):
        at[x] = at.get(x, 0) | 1 << j
    full = (1 << len(other)) - 1

    def after(v: int, x: object) -> int:
        u = v & at.get(x, 0)
        return ((v + u) | (v - u)) & full

    # Every `step`-th row is kept and the rows between two of them are made again on the way back.
    step = math.isqrt(len(mid)) + 1
    kept, v = [full], full
    for i, x in enumerate(mid, 1):
        v = after(v, x)
        if i % step == 0:
            kept.append(v)
    found, i, j = [], len(mid), len(other)
    while i and j:
        base = (i - 1) // step * step
        rows = [kept[base // step]]
        for x in mid[base:i]:
            rows.append(after(rows[-1], x))
        while i > base and j:
            low = (1 << j) - 1
            here = (~rows[i - base] & low).bit_count()
            if (~rows[i - 1 - base] & low).bit_count() == here:
                i -= 1
            elif (~rows[i - base] & (low >> 1)).bit_count() == here:
                j -= 1
            else:
                i, j = i - 1, j - 1
                found.append(first + i)
    return [*range(first), *reversed(found), *range(len(a) - last, len(a))]
