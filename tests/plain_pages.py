"""Page facts by walking the tree of one page: what the joins over node tables are compared with."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from urllib.parse import urljoin

from quillmill.sources.html import NOISE_TAGS, Node, tree
from quillmill.sources.page_facts import CARD_AT, CARD_NAME_AT, CARD_TERM_AT, CHROME_CLASSES, CONTENT_AT, CONTENT_ELSE_AT, CRUMBS_AT, FILE_ROW_AT, LINE_TAGS, MODULE_AT, TITLE_AT

TERM_WORDS = re.compile(r"\b(term|semester|quarter|fall|spring|summer|winter)\b", re.I)
_PART = re.compile(r"""^[\w-]+|\#[\w-]+|\.[\w-]+|\[[\w-]+(?:\*?='[^']*')?\]""")


def _line(s: str) -> str:
    return re.sub(r"[\s\ufeff]+", " ", s).strip()


def _tidy(s: str) -> str:
    """Single blanks, no blanks at line ends, at most one blank line."""
    for find, put in (("\u00a0", " "), (r"[ \t]*\n[ \t]*", "\n"), (r"\n{3,}", "\n\n"), (r"[ \t]{2,}", " ")):
        s = re.sub(find, put, s)
    return s.strip(" \t\n\r\f\v\ufeff")


def _is(node: Node, compound: str) -> bool:
    for part in _PART.findall(compound):
        kind, name = part[0], part[1:]
        if kind == "#":
            ok = node.attrs.get("id") == name
        elif kind == ".":
            ok = name in node.attrs.get("class", "").split()
        elif kind == "[":
            key, within, value = re.fullmatch(r"([\w-]+)(\*?)(?:='(.*)')?", name[:-1]).groups()
            have = node.attrs.get(key)
            ok = have is not None and (value is None or (value in have if within else value == have))
        else:
            ok = node.tag == part
        if not ok:
            return False
    return True


class _Page:
    """A parsed page that knows each node's parent."""

    def __init__(self, html: str | None) -> None:
        self.root = tree(html or "")
        self.parent = {id(c): n for n in self.root.walk() for c in n.children if isinstance(c, Node)}

    def above(self, node: Node) -> Iterator[Node]:
        while (node := self.parent.get(id(node))) is not None:
            yield node

    def matches(self, node: Node, selector: str) -> bool:
        *outer, own = selector.split()
        if not _is(node, own):
            return False
        rest = iter(self.above(node))
        return all(any(_is(n, want) for n in rest) for want in reversed(outer))

    def all(self, *selectors: str, within: Node | None = None) -> Iterator[Node]:
        start = within or self.root
        return (n for n in start.walk() if n is not start and any(self.matches(n, s) for s in selectors))

    def first_text(self, selectors: tuple[str, ...], within: Node | None = None, attrs: tuple[str, ...] = ("data-course-name",)) -> str:
        """The first selector's text that is not empty; only the first node of each selector counts."""
        for s in selectors:
            if (n := next(self.all(s, within=within), None)) and (t := _line(n.text()) or next((v for a in attrs if (v := n.attrs.get(a))), "")):
                return t
        return ""

    def closest(self, node: Node, selectors: tuple[str, ...]) -> Node | None:
        return next((n for n in (node, *self.above(node)) if any(self.matches(n, s) for s in selectors)), None)

    def title(self) -> str:
        head = next((n for n in self.root.walk() if n.tag == "title"), None)
        return self.first_text(TITLE_AT) or re.sub(r"\s+\|\s+.+$", "", _line(head.text()) if head else "")

    def due_date(self) -> str | None:
        return next((v for n in self.all("time[datetime]") if (v := n.attrs["datetime"].strip())), None)

    def content(self, section: str) -> Node:
        for s in (*CONTENT_AT.get(section, ()), *CONTENT_ELSE_AT):
            if (n := next(self.all(s), None)) and _line(n.text()):
                return n
        return self.root


def _is_chrome(n: Node) -> bool:
    return n.tag in NOISE_TAGS or n.tag in ("head", "title") or bool(set(CHROME_CLASSES) & set(n.attrs.get("class", "").split())) or n.attrs.get("aria-hidden") == "true" or "hidden" in n.attrs


def readable(root: Node) -> str:
    """Text with a line per block, links as "label (href)", images by their alternative text. An item gets a bullet if blocks inside
    it have ended its line already. Page chrome below the root is left out."""
    pieces: list[str] = []
    bullets: Counter[int] = Counter()
    todo: list[tuple[Node | str, int | None]] = [(root, None)]
    while todo:
        n, began = todo.pop()
        if isinstance(n, str):
            piece = _tidy(n)
        elif began is not None:
            if n.tag in LINE_TAGS and pieces and pieces[-1] != "\n":
                pieces.append("\n")
            elif n.tag == "li" and len(pieces) > began:
                bullets[began] += 1
            continue
        elif n is not root and _is_chrome(n):
            continue
        elif n.tag == "br":
            piece = "\n"
        elif n.tag == "a":
            piece = _tidy(n.text())
            if piece and n.attrs.get("href"):
                piece += f" ({n.attrs['href']})"
        elif n.tag == "img":
            piece = f"[Image: {alt}]" if (alt := _tidy(n.attrs.get("alt", ""))) else ""
        else:
            todo.append((n, len(pieces)))
            todo.extend((c, None) for c in reversed(n.children))
            continue
        if piece:
            pieces.append(piece)
    joined = " ".join("• " * bullets[i] + p for i, p in enumerate(pieces))
    return _tidy(re.sub(r"\s*\n\s*", "\n", re.sub(r"•\s+", "• ", joined)))


def _facts(html: str | None, section: str | None) -> dict:
    page = _Page(html)
    return {"title": page.title(), "due_date": page.due_date(), "week_or_module": page.first_text(MODULE_AT) if section == "modules" else "", "body_text": readable(page.content(section or ""))}


def _files(html: str | None) -> list[dict]:
    page = _Page(html)
    crumbs = [t for n in page.all(*CRUMBS_AT) if (t := _line(n.text()))]
    return [{"href": n.attrs["href"].strip(), "label": _line(n.text()), "row_text": _line(row.text()) if (row := page.closest(n, FILE_ROW_AT)) else "", "crumbs": crumbs} for n in page.all("a[href]")]


def _cards(html: str | None, url: str | None) -> list[dict]:
    page, out = _Page(html), []
    for a in page.all("a[href*='/courses/']"):
        try:
            to = urljoin(url or "", a.attrs["href"].strip())
        except ValueError:
            continue
        card = page.closest(a, CARD_AT) or page.parent.get(id(a), page.root)
        term = page.first_text(CARD_TERM_AT, card, ("data-course-name", "data-term"))
        near = (t for n in page.all("td", "span", "div", "p", within=card) if TERM_WORDS.search(t := _line(n.text())))
        names = [page.first_text(CARD_NAME_AT, card, ("data-course-name", "data-term")), a.attrs.get("aria-label", ""), a.attrs.get("title", ""), a.text()]
        out.append({"url": to, "names": names, "term": term or next(near, "")})
    return out
