"""Small helpers that read one HTML document; ``operators.extract`` applies them to tables of pages."""

from __future__ import annotations

from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset(("script", "style", "template"))


class _Reader(HTMLParser):
    """Collects text nodes; with a target, only those inside the first matching element."""

    def __init__(self, tag: str | None = None, attr: str | None = None, value: str | None = None):
        super().__init__(convert_charrefs=True)
        self.target, self.pieces, self.stack = (tag, attr, value), [], []
        self.depth = 0 if tag is None else None  # stack depth at which the capture began
        self.done = False

    def handle_starttag(self, tag, attrs):
        name, attr, value = self.target
        if self.depth is None and not self.done and tag == name:
            if attr is None or dict(attrs).get(attr) == value:
                self.depth = len(self.stack) + 1
        if tag not in VOID:
            self.stack.append(tag)

    def handle_startendtag(self, tag, attrs):
        pass

    def handle_endtag(self, tag):
        if tag in self.stack:
            while self.stack.pop() != tag:
                pass
        if self.depth and len(self.stack) < self.depth:
            self.depth, self.done = None, True

    def handle_data(self, data):
        if self.depth is not None and not SILENT.intersection(self.stack):
            self.pieces.append(data)


def page_text(html: str) -> str:
    """All text outside comments, scripts, styles and templates, entities resolved."""
    reader = _Reader()
    reader.feed(html)
    reader.close()
    return "".join(reader.pieces)


def first_element_text(html: str, tag: str, attr: str | None, value: str | None) -> str:
    """Text of the first element with this tag (and attribute value), pieces joined by single spaces; else empty."""
    reader = _Reader(tag, attr, value)
    reader.feed(html)
    reader.close()
    return " ".join(" ".join(reader.pieces).split())


class _Elements(_Reader):
    """Collects the text of every element with the tag; one inside another counts as part of the outer one."""

    def __init__(self, tag: str):
        super().__init__(tag)
        self.texts = []

    def finish(self):
        if self.depth is not None:
            self.texts.append(" ".join(" ".join(self.pieces).split()))
        self.pieces, self.depth, self.done = [], None, False

    def handle_endtag(self, tag):
        super().handle_endtag(tag)
        if self.done:
            self.depth = 0
            self.finish()


def element_texts(html: str, tag: str) -> list[str]:
    """Text of every element with this tag, in page order, an element without an end to the end of the page."""
    reader = _Elements(tag)
    reader.feed(html)
    reader.close()
    reader.finish()
    return reader.texts
