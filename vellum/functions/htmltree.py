"""A small HTML tree over the standard tokenizer, and what can be read off it."""

from __future__ import annotations

import re
from collections.abc import Generator, Iterator
from html.parser import HTMLParser

# Element groups of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
SILENT = frozenset("script style noscript template".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Open elements that a start tag ends, and the elements that shelter them.
ENDS = {
    "li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
}


class Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.children, self.parent = tag, attrs, [], parent

    def walk(self) -> Iterator[Node]:
        """This element and those below it, in order; no recursion, so depth doesn't matter."""
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(c for c in reversed(node.children) if isinstance(c, Node))

    def find(self, *tags: str) -> list[Node]:
        return [n for n in self.walk() if n.tag in tags]

    def first(self, *tags: str) -> Node | None:
        return next((n for n in self.walk() if n.tag in tags), None)

    def has_above(self, *tags: str) -> bool:
        node = self.parent
        while node is not None:
            if node.tag in tags:
                return True
            node = node.parent
        return False

    def text(self, without: frozenset[str] = SILENT, sep: str = "") -> str:
        parts: list[str] = []
        stack: list[Node | str] = [self]
        while stack:
            item = stack.pop()
            if isinstance(item, str):
                parts.append(item)
            elif item.tag not in without:
                stack.extend(reversed(item.children))
        return re.sub(r"\s+", " ", sep.join(parts)).strip()


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("#root", {}, None)
        self.at = self.root

    def _close(self, tags: set[str], shelter: set[str]) -> None:
        node, hit = self.at, None
        while node is not None and node.tag not in shelter:
            if node.tag in tags:
                hit = node
            node = node.parent
        if hit is not None:
            self.at = hit.parent

    def handle_starttag(self, tag, attrs):
        if tag in ENDS:
            self._close(*ENDS[tag])
        elif tag in BLOCK:
            self._close({"p"}, {"td", "th", "li", "table", "button"})
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.at.children.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag):
        node = self.at
        while node is not None and node.tag != tag:
            node = node.parent
        if node is not None and node.parent is not None:
            self.at = node.parent

    def handle_data(self, data):
        self.at.children.append(data)


def parse(html: str) -> Node:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.root


# ------------------------------------------------------------------ extracts


def links(root: Node) -> list[tuple]:
    """(href, text, title, target, rel): anchors with an address; ``#...`` and those without text only if they have a name."""
    out = []
    for a in root.find("a"):
        href, text, named = a.attrs.get("href", "").strip(), a.text(), "name" in a.attrs
        if (not href or href.startswith("#") or not text) and not named:
            continue
        out.append((href, text, a.attrs.get("title"), a.attrs.get("target"), a.attrs.get("rel")))
    return out


def heads(root: Node) -> list[tuple]:
    return [(int(h.tag[1]), t, h.attrs.get("id")) for h in root.find("h1", "h2", "h3", "h4", "h5", "h6") if (t := h.text())]


def images(root: Node) -> list[tuple]:
    return [(i.attrs["src"], i.attrs.get("alt") or "Image", i.attrs.get("title")) for i in root.find("img") if i.attrs.get("src")]


def tables(root: Node) -> list[list[list[str]]]:
    """Rows of cells; the first row of ``th`` cells, else the first row, is the header and sets the width. Empty tables are dropped."""
    out = []
    for table in root.find("table"):
        rows, head = [], None
        for tr in table.find("tr"):
            owner = tr.parent
            while owner is not None and owner.tag != "table":
                owner = owner.parent
            if owner is not table:
                continue
            cells = [c for c in tr.children if isinstance(c, Node) and c.tag in ("td", "th")]
            if not cells:
                continue
            if head is None and any(c.tag == "th" for c in cells):
                head = len(rows)
            rows.append([c.text().replace("|", "\\|") for c in cells])
        if not rows:
            continue
        rows.insert(0, rows.pop(head or 0))
        width = len(rows[0])
        out.append([(r + [""] * width)[:width] for r in rows])
    return out


def forms(root: Node) -> list[tuple]:
    """(action, method, enctype, fields); a field is (type, name, label, value, required). Hidden ones and unnamed inputs are left out."""
    out = []
    for form in root.find("form"):
        names = {x.attrs["for"]: x.text() for x in root.find("label") if x.attrs.get("for")}
        fields = []
        for kind in ("input", "textarea", "select", "button"):
            for f in form.find(kind):
                type_ = f.attrs.get("type", "text").lower() if kind == "input" else kind
                if type_ == "hidden" or (kind in ("input", "textarea") and not f.attrs.get("name")):
                    continue
                label = names.get(f.attrs.get("id", "\0")) or f.attrs.get("title") or f.attrs.get("aria-label")
                fields.append((type_, f.attrs.get("name"), label, f.attrs.get("value") or (f.text() or None), "required" in f.attrs))
        out.append((form.attrs.get("action"), form.attrs.get("method", "GET").upper() or "GET", form.attrs.get("enctype"), fields))
    return out


def definitions(root: Node) -> list[tuple]:
    """(term, definition) of ``dl`` lists; terms that follow each other share what comes after."""
    out = []
    for dl in root.find("dl"):
        terms: list[str] = []
        after = False
        for c in dl.children:
            if isinstance(c, Node) and c.tag == "dt":
                terms = [c.text()] if after else [*terms, c.text()]
                after = False
            elif isinstance(c, Node) and c.tag == "dd":
                after = True
                out += [(t, c.text()) for t in terms]
    return out


def quotes(root: Node) -> list[tuple]:
    """(text, cite, author) of block quotes; cite and footer are not part of the text."""
    out = []
    for q in root.find("blockquote"):
        cite, foot = q.first("cite"), q.first("footer")
        out.append((q.text(SILENT | {"cite", "footer"}), q.attrs.get("cite") or (cite.text() if cite else None), foot.text() if foot else q.attrs.get("data-author")))
    return out


def metadata(root: Node) -> dict[str, str]:
    """Title, language, named meta tags (the first of a name holds) and ``og:`` properties as ``og_``."""
    out: dict[str, str] = {}
    title, html = root.first("title"), root.first("html")
    if title is not None and (t := title.text()):
        out["title"] = t
    if html is not None and html.attrs.get("lang"):
        out["language"] = html.attrs["lang"]
    for m in root.find("meta"):
        name, prop, content = m.attrs.get("name", "").lower(), m.attrs.get("property", ""), m.attrs.get("content")
        if content is not None and name:
            out.setdefault(name, content)
        elif content is not None and prop.startswith("og:"):
            out.setdefault(prop.replace("og:", "og_", 1), content)
    return out


# Short names of languages in class attributes.
LANGUAGE_NAMES = {"js": "javascript", "ts": "typescript", "py": "python", "rs": "rust", "rb": "ruby", "sh": "bash", "shell": "bash", "yml": "yaml", "cs": "csharp", "c++": "cpp", "md": "markdown"}

#: A few tell-tale strings of each language, chosen here.
SIGNATURES = {
    "bash": ("#!/bin/", "echo ", "fi\n", "esac", "done\n"), "c": ("#include", "int main", "printf(", "malloc(", "->"), "css": ("color:", "margin:", "padding:", "px;", "{\n"),
    "go": ("func ", "package ", ":= ", "chan ", "defer "), "html": ("<div", "<html", "</", "<p>", "href="), "java": ("public class", "system.out", "private ", "@override", "new "),
    "javascript": ("function ", "const ", "=> ", "console.log", "var "), "json": ('": ', '{"', '"}', "null,", '],'), "python": ("def ", "import ", "self.", "elif ", "__init__"),
    "rust": ("fn ", "let ", "mut ", "impl ", "pub fn"), "sql": ("select ", "insert into", "where ", "group by", " from "), "yaml": ("---\n", ": \n", "- name", "apiversion:", "kind:"),
}


def code_language(attrs: dict[str, str], code: str) -> str | None:
    """By class, else by data attribute, else by what the code holds; equal counts go by the alphabet."""
    found = re.search(r"(?:language|lang|hljs|highlight)-([\w+#]+)", attrs.get("class", ""))
    name = found.group(1).lower() if found else next((attrs[k].lower() for k in ("data-language", "data-lang", "data-highlighter") if attrs.get(k)), None)
    if name:
        return LANGUAGE_NAMES.get(name, name)
    low = code.lower()
    counts = {lang: sum(s in low for s in signs) for lang, signs in SIGNATURES.items()}
    best = max(counts.values())
    return min(k for k, v in counts.items() if v == best) if best > 1 else None


def code_blocks(root: Node) -> list[tuple]:
    """(language, code) of ``pre`` blocks and of ``code`` outside them."""
    out = []
    for node in root.find("pre", "code"):
        if node.tag == "code" and node.has_above("pre"):
            continue
        inner = node.first("code") or node
        text = "".join(_raw(inner))
        if text.strip():
            out.append((code_language({**node.attrs, **inner.attrs}, text), text.strip("\n")))
    return out


def _raw(node: Node) -> Iterator[str]:
    stack: list[Node | str] = [node]
    while stack:
        item = stack.pop()
        if isinstance(item, str):
            yield item
        else:
            stack.extend(reversed(item.children))


# ------------------------------------------------------------------ Markdown

_WRAP = {"b": "**", "strong": "**", "i": "*", "em": "*", "code": "`", "del": "~~", "s": "~~"}


def _done(step: Generator):
    """The result of a generator that yields the generators whose results it needs; deep pages don't deepen the Python stack."""
    stack, value = [step], None
    while stack:
        try:
            stack.append(stack[-1].send(value))
            value = None
        except StopIteration as end:
            stack.pop()
            value = end.value
    return value


def _inline(node: Node | str) -> Generator:
    if isinstance(node, str):
        return re.sub(r"\s+", " ", node)
    if node.tag in SILENT:
        return ""
    if node.tag == "br":
        return "\n"
    if node.tag == "img":
        return f"![{node.attrs.get('alt') or 'Image'}]({node.attrs['src']})" if node.attrs.get("src") else ""
    parts = []
    for child in node.children:
        parts.append((yield _inline(child)))
    inside = "".join(parts)
    if node.tag == "a" and node.attrs.get("href") and inside.strip():
        return f"[{inside.strip()}]({node.attrs['href']})"
    mark = _WRAP.get(node.tag)
    if mark and inside.strip():
        lead, tail = inside[: len(inside) - len(inside.lstrip())], inside[len(inside.rstrip()) :]
        return f"{lead}{mark}{inside.strip()}{mark}{tail}"
    return inside


def pipe_table(rows: list[list[str]]) -> str:
    line = lambda r: "| " + " | ".join(r) + " |"
    return "\n".join([line(rows[0]), line(["---"] * len(rows[0])), *map(line, rows[1:])])


def _holders(root: Node) -> set[int]:
    """The elements with a block element below them, by ``id``."""
    held: set[int] = set()
    for node in root.walk():
        up = node.parent if node.tag in BLOCK and node.tag not in ("html", "body") else None
        while up is not None and id(up) not in held:
            held.add(id(up))
            up = up.parent
    return held


def _blocks(node: Node, holders: set[int]) -> Generator:
    """The Markdown blocks of an element."""
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        text = re.sub(r" *\n *", "\n", re.sub(r"[ \t]+", " ", "".join(run))).strip()
        if text:
            out.append(text)
        run.clear()

    for child in node.children:
        if isinstance(child, Node) and (child.tag in SILENT or child.tag in ("head", "title")):
            continue
        if isinstance(child, str) or (child.tag not in BLOCK and id(child) not in holders):
            run.append((yield _inline(child)))
            continue
        flush()
        tag = child.tag
        if re.fullmatch("h[1-6]", tag):
            if text := " ".join((yield _inline(child)).split()):
                out.append("#" * int(tag[1]) + " " + text)
        elif tag == "pre":
            inner = child.first("code") or child
            code = "".join(_raw(inner)).strip("\n")
            out.append(f"```{code_language({**child.attrs, **inner.attrs}, code) or ''}\n{code}\n```")
        elif tag in ("ul", "ol"):
            lines = []
            for n, li in enumerate([c for c in child.children if isinstance(c, Node) and c.tag == "li"], 1):
                mark = f"{n}. " if tag == "ol" else "- "
                text = "\n".join((yield _blocks(li, holders)))
                lines.append(mark + text.replace("\n", "\n" + " " * len(mark)))
            if lines:
                out.append("\n".join(lines))
        elif tag == "blockquote":
            if inside := (yield _blocks(child, holders)):
                out.append("> " + "\n\n".join(inside).replace("\n", "\n> "))
        elif tag == "table":
            found = tables(child)
            if found:
                out.append(pipe_table(found[0]))
        elif tag == "hr":
            out.append("---")
        elif tag == "dl":
            out += [f"**{t}**\n: {d}" for t, d in definitions(child)]
        else:
            out += yield _blocks(child, holders)
    flush()
    return out


def to_markdown(html: str, front: bool = False) -> str:
    """Markdown of a page, under its title unless the body has a first-level heading; front matter of its metadata on request."""
    root = parse(html)
    out = _done(_blocks(root.first("body") or root, _holders(root)))
    title = root.first("title")
    name = title.text() if title is not None else ""
    if name and not any(x.startswith("# ") for x in out):
        out.insert(0, f"# {name}")
    text = "\n\n".join(out)
    if front and (meta := metadata(root)):
        text = front_matter(meta) + "\n" + text
    return text


def front_matter(fields: dict[str, str]) -> str:
    quote = lambda v: '"' + v.replace("\\", "\\\\").replace('"', '\\"') + '"' if re.search(r"[:#\[\]{}&*!|>'\"%@`\n]|^[\s-]|\s$|^$", v) else v
    lines = [f"{k.replace('_', '-')}: {quote(v)}" for k, v in sorted(fields.items())]
    return "\n".join(["---", *lines, "---", ""])


def to_text(html: str) -> str:
    root = parse(html)
    return (root.first("body") or root).text(SILENT | {"head", "title"}, " ")
