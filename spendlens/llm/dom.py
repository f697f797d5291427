"""Element trees of web pages as flat lists, with the text runs as leaves of their own."""

from __future__ import annotations

import html
import re
from functools import cache

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe object svg math canvas title textarea select".split())
TEXT_ONLY = frozenset("script style title textarea".split())  # end at the first closing tag of their name, or not at all
HEAD = frozenset("html head base basefont bgsound link meta title script style noscript template".split())
INLINE = frozenset(
    "a abbr b bdi bdo big cite code data del dfn em font i img input ins kbd label mark q s samp small span strike"
    " strong sub sup time tt u var wbr br".split()
)
# An opening tag closes the nearest open element of its group, as far as one of the walls.
CLOSES = {
    "li": ("li",),
    "dt": ("dt", "dd"),
    "dd": ("dt", "dd"),
    "tr": ("tr", "td", "th"),
    "td": ("td", "th"),
    "th": ("td", "th"),
    "option": ("option",),
}
WALLS = frozenset("ul ol dl table td th button article section main aside nav header footer div form body html".split())
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=\"'/]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"']+))")
_WORD = re.compile(r"[a-z0-9]+")
BREAK = -1
SPACE = -2


@cache
def _tags(name: str, closing: bool = False) -> re.Pattern:
    """Closing tags of a name; or its tags, with comments, scripts and styles in which none counts."""
    tail = r"(?=[\s/>]|\Z)(?:(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>|[^>]*(?:>|\Z))"
    if closing:
        return re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I | re.A)
    return re.compile(rf"<!--.*?(?:-->|\Z)|<(script|style)(?=[\s/>]).*?</\1(?=[\s/>])|<(/?){name}{tail}", re.I | re.A | re.S)


class Page:
    """tag, parent, words (of class, id, role), text by node; `order` holds text nodes, BREAKs and SPACEs."""

    def __init__(self, source: str, mark: str | None = None):
        self.tag, self.parent, self.words, self.text = ["#root"], [-1], [frozenset()], [""]
        self.mark: list[str | None] = [None]
        self.order: list[int] = []
        self._key = mark
        self._build(source)

    def _add(self, tag: str, parent: int, words: frozenset, text: str, mark: str | None) -> int:
        self.tag.append(tag)
        self.parent.append(parent)
        self.words.append(words)
        self.text.append(text)
        self.mark.append(mark)
        return len(self.tag) - 1

    def _build(self, source: str) -> None:
        stack, at, in_head, ends = [0], 0, False, {}
        while at < len(source):
            found = _TOKEN.search(source, at)
            start = found.start() if found else len(source)
            if start > at:
                raw = source[at:start]
                if raw.strip():
                    in_head = False
                    value = html.unescape(raw) if "&" in raw else raw
                    self.order.append(self._add("#text", stack[-1], frozenset(), value, self.mark[stack[-1]]))
                elif not in_head:
                    self.order.append(SPACE)
            if not found:
                break
            at = found.end()
            name = found[2] or found[5]
            if not name:
                continue
            closing, name, rest = bool(found[1] or found[4]), name.lower(), found[3] or found[6] or ""
            if closing:
                in_head = in_head and name not in ("head", "body", "html")
                self._close(stack, name)
                continue
            if name == "head":
                self.order.append(BREAK)
                in_head = True
                continue
            in_head = in_head and name in HEAD
            if in_head and name not in RAW:
                continue
            if name not in INLINE:
                self.order.append(BREAK)
                self._close(stack, "p", frozenset(WALLS))
            elif name == "br":
                self.order.append(SPACE)
            if name in CLOSES:
                for other in CLOSES[name]:
                    self._close(stack, other, WALLS - {"td", "th"} if name in ("td", "th", "tr") else WALLS)
            words, mark = frozenset(), self.mark[stack[-1]]
            if rest and "=" in rest:
                pairs = {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(rest)}
                named = " ".join(pairs.get(k, "") for k in ("class", "id", "role"))
                words = frozenset(_WORD.findall(named.lower()))
                mark = pairs.get(self._key, mark) if self._key else mark
            if name in RAW:
                if not rest.endswith("/"):
                    end = self._end(source, name, at, found.start(), ends)
                    if end is None and name in TEXT_ONLY:
                        break
                    at = at if end is None else end
                continue
            node = self._add(name, stack[-1], words, "", mark)
            if name not in VOID and not rest.endswith("/"):
                stack.append(node)

    def _end(self, source: str, name: str, at: int, start: int, ends: dict[str, dict[int, int]]) -> int | None:
        """Where the element opened at `start`, its tag ending at `at`, is closed; None if it is not.

        Elements that hold others are matched in pairs, once for all of a name, so that an open one takes no
        other's closing tag.
        """
        if name in TEXT_ONLY:
            found = _tags(name, closing=True).search(source, at)
            return found.end() if found else None
        if name not in ends:
            pairs, opened = {}, []
            for found in _tags(name).finditer(source, start):
                if found[2] == "/":
                    if opened:
                        pairs[opened.pop()] = found.end()
                elif found[2] is not None and not found[0].endswith("/>"):
                    opened.append(found.start())
            ends[name] = pairs
        return ends[name].get(start)

    def _close(self, stack: list[int], name: str, walls: frozenset = frozenset()) -> None:
        for i in range(len(stack) - 1, 0, -1):
            tag = self.tag[stack[i]]
            if tag == name:
                del stack[i:]
                if name not in INLINE:
                    self.order.append(BREAK)
                return
            if tag in walls:
                return

    def blocks(self, kept: list[bool]) -> list[str]:
        """Texts of the kept runs, block by block, white space turned into one space."""
        out, now = [], []
        for node in [*self.order, BREAK]:
            if node == BREAK:
                value = " ".join("".join(now).split())
                if value:
                    out.append(value)
                now = []
            elif node == SPACE:
                now.append(" ")
            elif kept[node]:
                now.append(self.text[node])
        return out
