"""Text blocks of an HTML page, with what its markup says about them."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)"
    r"|<(?P<close>/?)(?P<name>[A-Za-z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?P<end>>|\Z)", re.S)
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SPACE = re.compile(r"\s+")
_NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

# Names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title xmp noembed noframes".split())
BLOCK = frozenset("""
address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer
form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary
table tbody td tfoot th thead tr ul
""".split())
ENDS_PARAGRAPH = BLOCK - {"html", "body"}
# Elements that hold no main text, wherever they are, and those that do not outside an article.
SKIPPED = frozenset("""
head nav aside form script style noscript template iframe object embed applet svg math canvas audio video map select
datalist textarea button input dialog menu title footer search
""".split())
SKIPPED_OUTSIDE = frozenset("header".split())
ROOTS = frozenset("article main".split())
# Parts of class names, ids and roles of such elements.
SKIPPED_NAMES = frozenset("""
ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promoted promotion nav
navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars footer masthead cookie cookies consent gdpr notice
notices alert alerts banner popup modal overlay newsletter subscribe subscription signup login share sharing social
related recommended pagination pager toolbar widget widgets complementary contentinfo search skip
comment comments commentlist disqus discussion respond replies reply
""".split())
SKIPPED_NAMES_OUTSIDE = frozenset("header".split())
COMMENT_NAMES = frozenset("comment comments commentlist disqus discussion respond replies reply".split())


@dataclass
class Block:
    text: str
    #: inside an article or main element
    trusted: bool


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(raw)}


def _is_skipped(name: str, raw_attributes: str, inside: bool) -> bool:
    if name in SKIPPED or name in SKIPPED_OUTSIDE and not inside:
        return True
    if not raw_attributes or name in ("html", "body"):
        return False
    given = _attributes(raw_attributes)
    if "hidden" in given or given.get("aria-hidden", "").lower() == "true":
        return True
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", given.get("style", ""), re.I):
        return True
    names = " ".join(given.get(k, "") for k in ("class", "id", "role"))
    parts = {p.lower() for p in _NAME_PARTS.findall(names)}
    if name in ROOTS or given.get("role") == "main":
        return bool(parts & COMMENT_NAMES)
    return bool(parts & SKIPPED_NAMES) or not inside and bool(parts & SKIPPED_NAMES_OUTSIDE)


def blocks_of(page: str | None) -> list[Block]:
    """Blocks in page order, white space as one space, trimmed, none empty; skipped elements are left out.

    Unclosed elements end with the element around them, a paragraph also where the next block begins.
    A tag or comment that the end of the page cuts off is dropped.
    """
    page = page or ""
    found: list[Block] = []
    parts: list[str] = []
    stack: list[tuple[str, bool, bool]] = []  # name, skipped, root
    skipped = roots = 0
    at = 0

    def close_block() -> None:
        if parts:
            text = _SPACE.sub(" ", "".join(parts)).strip()
            if text:
                found.append(Block(text, roots > 0))
            parts.clear()

    def pop_to(depth: int) -> None:
        nonlocal skipped, roots
        while len(stack) > depth:
            name, was_skipped, was_root = stack.pop()
            if name in BLOCK:
                close_block()
            skipped -= was_skipped
            roots -= was_root

    def take(text: str) -> None:
        if text and not skipped:
            parts.append(html.unescape(text))

    size = len(page)
    while at < size:
        m = _TOKEN.search(page, at)
        if not m:
            rest = page[at:]
            cut = re.search(r"</?[A-Za-z][^<>]*\Z", rest)
            take(rest[: cut.start()] if cut else rest)
            break
        take(page[at : m.start()])
        at = m.end()
        name = (m["name"] or "").lower()
        if not name or m["end"] != ">":
            continue
        if m["close"]:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == name:
                    pop_to(depth)
                    break
            else:
                if name in BLOCK:
                    close_block()
            continue
        if name == "br":
            take(" ")
            continue
        if name in ENDS_PARAGRAPH:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == "p":
                    pop_to(depth)
                    break
                if stack[depth][0] in BLOCK:
                    break
            same = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th"},
                    "th": {"td", "th"}, "option": {"option"}}.get(name)
            if same:
                for depth in range(len(stack) - 1, -1, -1):
                    if stack[depth][0] in same:
                        pop_to(depth)
                        break
                    if stack[depth][0] in ("ul", "ol", "dl", "table", "select", "tr") and name != stack[depth][0]:
                        break
        if name in BLOCK:
            close_block()
        if name in VOID:
            continue
        raw = m["attrs"] or ""
        if name in RAW:
            end = re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else size
            continue
        if raw.rstrip().endswith("/") and name in ("svg", "math", "path", "use", "g", "rect", "circle"):
            continue
        skip = _is_skipped(name, raw, roots > 0)
        root = name in ROOTS or "main" in raw and _attributes(raw).get("role") == "main" or (
            "articleBody" in raw and "articleBody" in _attributes(raw).get("itemprop", ""))
        stack.append((name, skip, root))
        skipped += skip
        roots += root
    pop_to(0)
    close_block()
    return found
