"""The main text of a web page by the density of its blocks: how much text a block has, and how much of that is links.

Long blocks with few links are content, blocks of links are not, and short ones go with what stands around them or,
paragraphs and headings, with the long ones of the same element. Of the runs of content so found the heaviest is the page's, with those that are not
much lighter.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from html.parser import HTMLParser

#: Elements without readable text, those that break a line, and those whose text counts as links.
SILENT = {"script", "style", "noscript", "template", "iframe", "svg", "select", "button", "textarea", "head", "object"}
BREAKING = {"address", "article", "aside", "blockquote", "body", "br", "dd", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "li", "main", "nav", "ol", "p", "pre", "section", "table", "td", "th", "tr", "ul"}
APART = {"nav", "footer", "aside", "form"}
#: Elements that share the fate of their neighbours in one parent.
FLOWING = {"p", "li", "blockquote", "pre", "dd", "dt", "h1", "h2", "h3", "h4", "h5", "h6"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"}


@dataclass
class Block:
    text: str
    links: int
    tag: str
    parent: int
    apart: bool

    @property
    def words(self) -> int:
        return len(self.text.split())

    @property
    def link_share(self) -> float:
        return self.links / max(1, len(self.text))


class _Parser(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[Block] = []
        self.parts: list[str] = []
        self.links = 0
        self.open: list[str] = []
        self.ids: list[int] = []
        self.seen = 0
        self.place = ("body", 0, False)

    def close_block(self) -> None:
        text = re.sub(r"\s+", " ", "".join(self.parts)).strip()
        if text:
            self.blocks.append(Block(text, self.links, *self.place))
        self.parts, self.links = [], 0

    def breaking(self) -> list[int]:
        """Places of the open elements that break lines."""
        return [i for i, t in enumerate(self.open) if t in BREAKING]

    def close_to(self, place: int) -> None:
        del self.open[place:], self.ids[place:]

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag in BREAKING:
            self.close_block()
            inner = self.breaking()
            # An unclosed paragraph or item ends where the next begins.
            if tag in ("p", "li") and inner and self.open[inner[-1]] == tag:
                self.close_to(inner[-1])
        if tag not in VOID:
            self.seen += 1
            self.open.append(tag)
            self.ids.append(self.seen)

    def handle_endtag(self, tag: str) -> None:
        if tag in BREAKING:
            self.close_block()
        if tag in self.open:
            self.close_to(len(self.open) - 1 - self.open[::-1].index(tag))

    def handle_data(self, data: str) -> None:
        if any(t in SILENT for t in self.open):
            return
        if not "".join(self.parts).strip():
            around = self.breaking()
            tag = self.open[around[-1]] if around else "body"
            self.place = (tag, self.ids[around[-2]] if len(around) > 1 else 0, any(t in APART for t in self.open))
        self.parts.append(data)
        if any(t == "a" or t in APART for t in self.open):
            self.links += len(re.sub(r"\s+", " ", data).strip())


def page_blocks(html: str) -> list[Block]:
    parser = _Parser()
    parser.feed(html)
    parser.close()
    parser.close_block()
    return parser.blocks


def content_flags(blocks: list[Block], long: int = 15, most_links: float = 1 / 3, share: float = 0.2) -> list[bool]:
    """Which blocks are content. ``long``: words of a block that needs no neighbours; ``most_links``: link characters it may have; ``share``: what a run needs of the heaviest one's characters."""
    kind = [("bad" if b.link_share > most_links else "good" if b.words >= long else "short") for b in blocks]
    # Where there is no long block the longest ones without links stand in for them.
    if "good" not in kind:
        most = max((b.words for b, k in zip(blocks, kind, strict=True) if k == "short"), default=0)
        kind = ["good" if k == "short" and b.words == most else k for b, k in zip(blocks, kind, strict=True)]
    main = {b.parent for b, k in zip(blocks, kind, strict=True) if k == "good" and b.tag in FLOWING}
    kind = ["good" if k == "short" and b.tag in FLOWING and b.parent in main else k for b, k in zip(blocks, kind, strict=True)]
    before, after = [], []
    for order, out in ((kind, before), (kind[::-1], after)):
        last = "bad"
        for k in order:
            out.append(last)
            last = k if k != "short" else last
    after.reverse()
    good = []
    for i, (b, k) in enumerate(zip(blocks, kind, strict=True)):
        next_kind = kind[i + 1] if i + 1 < len(kind) else "bad"
        leads = b.tag in HEADINGS and after[i] == "good" and next_kind != "bad"
        good.append(k == "good" or k == "short" and (leads or before[i] == after[i] == "good"))
    runs: list[list[int]] = []
    for i, g in enumerate(good):
        if g and runs and runs[-1][-1] == i - 1:
            runs[-1].append(i)
        elif g:
            runs.append([i])
    weight = [sum(len(blocks[i].text) - blocks[i].links for i in r) for r in runs]
    kept = {i for r, w in zip(runs, weight, strict=True) if w >= share * max(weight) for i in r}
    return [i in kept for i in range(len(blocks))]


def main_text(html: str | None) -> str | None:
    """The page's content, a line for each block; empty if it has none, null for null."""
    if html is None:
        return None
    blocks = page_blocks(html)
    return "\n".join(b.text for b, keep in zip(blocks, content_flags(blocks), strict=True) if keep)


def page_text(html: str | None) -> str | None:
    """All readable text outside of navigation, footers, asides and forms, a line for each block; null for null."""
    return None if html is None else "\n".join(b.text for b in page_blocks(html) if not b.apart)
