"""Reading markup in time that is linear in its length, whatever is left open."""

from __future__ import annotations

from collections import defaultdict
from html.parser import HTMLParser

#: Elements without content.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: Elements that another of their kind closes, and what keeps it from doing so.
CLOSED_BY_NEXT = {
    "p": ({"p"}, set()), "li": ({"li"}, {"ul", "ol", "menu"}), "option": ({"option"}, {"select"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr"}, {"table"}),
}
_NONE: tuple[set, set] = (set(), set())
#: How far up an element is looked for that the next of its kind closes.
REACH = 32


class Walker(HTMLParser):
    """Keeps the open elements; ``opened``, ``closed`` and ``text`` are for subclasses.

    An end tag without its start is passed over.  Each element is pushed and popped once
    and open ones are counted by name, so no step looks through all of them."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[str] = []
        self.open: defaultdict[str, int] = defaultdict(int)

    def opened(self, tag: str, attrs: dict[str, str]) -> None:
        """After an element has been opened (void ones aren't)."""

    def closed(self, tag: str) -> None:
        """Before an element is taken off."""

    def void(self, tag: str, attrs: dict[str, str]) -> None:
        """An element without content."""

    def text(self, data: str) -> None:
        """A piece of text."""

    def handle_starttag(self, tag, attrs):
        given = {k: v or "" for k, v in reversed(attrs)} if attrs else {}  # the first of a name counts
        if tag in VOID:
            self.void(tag, given)
            return
        kinds, bounds = CLOSED_BY_NEXT.get(tag, _NONE)
        if kinds and any(self.open[k] for k in kinds):
            for near in reversed(self.stack[-REACH:]):
                if near in kinds:
                    self.handle_endtag(near)
                    break
                if near in bounds:
                    break
        self.stack.append(tag)
        self.open[tag] += 1
        self.opened(tag, given)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)  # a slash means nothing in HTML

    def handle_endtag(self, tag):
        while self.open[tag]:
            top = self.stack[-1]
            self.closed(top)
            self.stack.pop()
            self.open[top] -= 1
            if top == tag:
                return

    def handle_data(self, data):
        self.text(data)


def tidy(parts: list[str]) -> str:
    return " ".join(" ".join(parts).split())
