"""Leaf blocks of a web page: runs of shown text under one block-level element, with their lines."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

# Element groups of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
HIDDEN = frozenset("head script style noscript template title iframe object select textarea svg math datalist".split())
RAW = frozenset("script style noscript template textarea title iframe".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike "
    "strong sub sup time tt u var wbr".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 "
    "h6 header hgroup hr main menu nav ol p pre search section summary table ul".split()
)
#: A start tag of the first kind ends an open element of the second, up to the nearest of the third.
IMPLIED = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table", "thead", "tbody", "tfoot")),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select",)),
}

_TOKEN = re.compile(
    r"<!--(?:.*?-->|.*\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*?)(?P<self>/?)(?:>|\Z)",
    re.S,
)
_CHARSET = re.compile(rb"<(?:meta|\?xml)\b[^>]*?\b(?:charset|encoding)\s*=\s*[\"']?\s*([\w.:-]+)", re.I)
_JUMP = re.compile(r"\bhref\s*=\s*[\"']?#[\"'\s]?(?:$|[\s\"'])", re.I)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)


@dataclass
class Block:
    path: tuple[str, ...]  # tags from the body down, block level only
    ids: tuple[int, ...]  # a number for each element of the path
    marked: tuple[bool, ...]  # whether it has a class
    text: str = ""
    lines: set[int] = field(default_factory=set)
    linked: int = 0  # characters inside links
    links: int = 0
    bold_first: bool = False
    image: bool = False  # an image comes before the text in the same element
    span: bool = False
    jumps: int = 0  # links that lead nowhere else (href "#")


def decode(data: bytes | None) -> str:
    """Text of a page: by byte-order mark, by UTF-8 if it is valid, else by the encoding it names, else ISO-8859-1.
    A page cut within a character is still UTF-8."""
    if not data:
        return ""
    data = bytes(data)
    if data.startswith(b"\xef\xbb\xbf"):
        return data[3:].decode("utf-8", "replace")
    named = _CHARSET.search(data)
    name = named.group(1).decode("ascii", "replace").lower() if named else ""
    for encoding in (name, "utf-8") if name else ("utf-8",):
        try:
            return data.decode(encoding)
        except UnicodeDecodeError as e:
            # the end of a page cut within a character, if the page names UTF-8 or holds whole characters of it
            if e.start >= len(data) - 3 and (encoding == name or not data[: e.start].isascii()):
                return data.decode(encoding, "replace")
        except LookupError:
            pass
    return data.decode("iso-8859-1")


def blocks(page: str) -> list[Block]:
    """The leaf blocks of a page in order. Comments, scripts, styles and the head show nothing."""
    out: list[Block] = []
    stack: list[tuple[str, int, bool]] = []
    count = 0
    current: Block | None = None
    image_in: set[int] = set()
    anchors = bolds = spans = hidden = 0
    line, at = 1, 0

    def text(start: int, end: int) -> None:
        nonlocal current, line
        raw = page[start:end]
        if raw.isspace() or hidden:
            line += raw.count("\n")
            if current is not None and raw and not hidden:
                current.text += " "
            return
        if current is None:
            blocky = [e for e in stack if e[0] not in INLINE]
            current = Block(tuple(e[0] for e in blocky), tuple(e[1] for e in blocky), tuple(e[2] for e in blocky))
            current.bold_first = bolds > 0
            current.image = bool(blocky) and blocky[-1][1] in image_in
            out.append(current)
        for i, part in enumerate(raw.split("\n")):
            if i:
                line += 1
            if part and not part.isspace():
                current.lines.add(line)
        shown = html.unescape(raw)
        current.text += shown
        current.span |= spans > 0
        if anchors:
            current.linked += len(shown.strip())

    for token in _TOKEN.finditer(page):
        if token.start() < at:
            continue
        if token.start() > at:
            text(at, token.start())
        at = token.end()
        name = token.group("name")
        if name is None:
            line += page.count("\n", token.start(), at)
            continue
        name = name.lower()
        line += page.count("\n", token.start(), at)
        if name not in INLINE:
            current = None
        if token.group("close"):
            if name in INLINE and not any(e[0] == name for e in stack):
                continue
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
            if depth is None:
                continue
            for e in stack[depth:]:
                anchors -= e[0] == "a"
                bolds -= e[0] in ("b", "strong")
                spans -= e[0] == "span"
                hidden -= e[0] in HIDDEN
            del stack[depth:]
            continue
        if name == "br":
            if current is not None:
                current.text += " "
            continue
        if name in VOID:
            if name == "img":
                blocky = [e for e in stack if e[0] not in INLINE]
                if blocky:
                    image_in.add(blocky[-1][1])
            continue
        if name in RAW and not token.group("self"):
            end = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
            stop = end.end() if end else len(page)
            line += page.count("\n", at, stop)
            at = stop
            continue
        ends: tuple[int, ...] = ()
        if name in CLOSES_P:
            ends = tuple(i for i, e in enumerate(stack) if e[0] == "p")[-1:]
        elif name in IMPLIED:
            these, until = IMPLIED[name]
            i = len(stack) - 1
            while i >= 0 and stack[i][0] not in until:
                if stack[i][0] in these:
                    ends = (i,)
                i -= 1
        if name == "body":  # what was left open in the head is over
            for e in stack:
                hidden -= e[0] in HIDDEN
            stack.clear()
        if ends:
            for e in stack[ends[0] :]:
                anchors -= e[0] == "a"
                bolds -= e[0] in ("b", "strong")
                spans -= e[0] == "span"
                hidden -= e[0] in HIDDEN
            del stack[ends[0] :]
        count += 1
        attributes = dict((a.lower(), b or c or d) for a, b, c, d in _ATTRIBUTE.findall(token.group("attrs") or ""))
        if not token.group("self"):
            stack.append((name, count, "class" in attributes))
            anchors += name == "a"
            bolds += name in ("b", "strong")
            spans += name == "span"
            hidden += name in HIDDEN
        if name == "a" and current is not None:
            current.links += 1
            current.jumps += _JUMP.search(token.group("attrs") or "") is not None
        elif name == "a":
            # a link that opens a block: the block begins with its text
            blocky = [e for e in stack if e[0] not in INLINE]
            current = Block(tuple(e[0] for e in blocky), tuple(e[1] for e in blocky), tuple(e[2] for e in blocky))
            current.image = bool(blocky) and blocky[-1][1] in image_in
            current.links = 1
            current.jumps = int(_JUMP.search(token.group("attrs") or "") is not None)
            out.append(current)
    if at < len(page):
        text(at, len(page))
    return [b for b in out if b.lines]
