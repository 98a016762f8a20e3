"""HTML to leaf blocks: runs of text between block-level tags, each with its path of elements."""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass

# Elements by how they stand in a page.
BREAKS = set("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noframes ol optgroup option p pre search section select summary table tbody td tfoot th thead title tr ul".split())
ENDS_P = BREAKS - set("body br html head caption dd dt legend li option optgroup summary tbody td tfoot th thead title tr".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes".split())
#: No text of theirs is shown.
HIDDEN = set("script style template noscript head title textarea select datalist svg math iframe object canvas audio video noembed noframes xmp".split())
#: What may stand in a head. Any other element, and text, ends a head that is still open.
IN_HEAD = set("base basefont bgsound head html link meta noframes noscript script style template title".split())
#: Where the search for an open p ends.
P_ENDS = set("p td th table button object".split())
#: An opening tag ends these, unless one of the barriers lies between.
ENDED_BY = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}), "tbody": ({"tbody", "thead", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "thead", "tr", "td", "th"}, {"table"}), "option": ({"option"}, {"select"})}

# No alternative is tried twice: a tag that is cut off, however many attributes it has, takes one pass and shows nothing.
_ATTRIBUTES = r"""(?>[^>"'=]+|=\s*+"[^"]*+"|=\s*+'[^']*+'|["'=])*+"""
_MARKUP = re.compile(rf"""<!--(?:>|->|.*?(?:--!?>|\Z))|<(/?)([A-Za-z][^\s/>]*+)({_ATTRIBUTES})>|<[!?/][^>]*+(?:>|\Z)|<[A-Za-z]{_ATTRIBUTES}\Z""", re.S)
_NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
_TOKEN = re.compile(r"[A-Za-z]+")


class Path:
    """The elements around a block, as links upwards, so that a block costs the same at any depth. ``total`` is for whoever adds up."""

    __slots__ = ("own", "parent", "size", "total")

    def __init__(self, own: tuple[str, ...] = (), parent: "Path | None" = None):
        self.own, self.parent, self.total = own, parent, None
        self.size = len(own) + (parent.size if parent else 0)

    def tokens(self) -> list[str]:
        """From the outermost element on."""
        links, link = [], self
        while link is not None:
            links.append(link.own)
            link = link.parent
        return [t for own in reversed(links) for t in own]


@dataclass
class Block:
    text: str
    path: Path
    leaf: str
    linked: int


def path_tokens(tag: str, attributes: str) -> tuple[str, ...]:
    """What an element adds to the path: its name, and the words of class, id and role."""
    if not attributes or "=" not in attributes:
        return (tag,)
    names = [a or b or c for a, b, c in _NAMED.findall(attributes)]
    return (tag, *sorted({"." + t.lower() for n in names for t in _TOKEN.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", n))}))


def blocks(page: str) -> list[Block]:
    """The blocks of a page in order. Character references are decoded, white space is one blank, empty blocks are left out.

    A page costs in proportion to its length, however deep it is nested. Inline elements do not break a block. Unclosed and wrongly nested tags are taken as browsers mostly do: an opening
    block ends an open paragraph, a closing tag ends what it matches and is ignored if there is nothing. Comments,
    scripts, styles and other elements without shown text are skipped, also where the page ends inside of them.
    """
    found: list[Block] = []
    stack: list[tuple[str, Path, int]] = []  # element, path, place of the nearest one that ends the search for an open p
    held: Counter[str] = Counter()
    root = Path()
    text: list[str] = []
    links = linked = hidden = at = 0

    def flush() -> None:
        nonlocal linked
        if text:
            words = html.unescape("".join(text)).split()
            if words:
                found.append(Block(" ".join(words), stack[-1][1] if stack else root, stack[-1][0] if stack else "", linked))
            text.clear()
        linked = 0

    def close(upto: int) -> None:
        nonlocal hidden
        for tag, _, _ in stack[upto:]:
            hidden -= tag in HIDDEN
            held[tag] -= 1
        del stack[upto:]

    def end_head() -> None:
        if stack and stack[-1][0] == "head":
            close(len(stack) - 1)

    for m in iter(lambda: _MARKUP.search(page, at), None):
        if hidden and page[at : m.start()].strip():
            end_head()
        if m.start() > at and not hidden:
            piece = page[at : m.start()]
            text.append(piece)
            if links:
                linked += len(piece)
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if hidden and not m[1] and tag not in IN_HEAD:
            end_head()
        if tag == "a":
            links = 0 if m[1] else 1
            continue
        breaks, hides = tag in BREAKS, tag in HIDDEN
        if not breaks and not hides:
            continue
        if breaks:
            flush()
        if m[1]:
            if held[tag]:
                close(next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag))
            continue
        if tag in VOID:
            continue
        if tag in ENDS_P:
            if stack and stack[-1][2] >= 0 and stack[stack[-1][2]][0] == "p":
                close(stack[-1][2])
            links = 0
        if tag in ENDED_BY:
            ended, barrier = ENDED_BY[tag]
            upto, i, left = len(stack), len(stack) - 1, sum(held[t] for t in ended)
            while left and stack[i][0] not in barrier:
                if stack[i][0] in ended:
                    upto, left = i, left - 1
                i -= 1
            close(upto)
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if m[3].rstrip().endswith("/") and hides:
            continue
        near = len(stack) if tag in P_ENDS else stack[-1][2] if stack else -1
        stack.append((tag, Path(path_tokens(tag, m[3]), stack[-1][1] if stack else root), near))
        held[tag] += 1
        hidden += hides
    if hidden and page[at:].strip():
        end_head()
    if not hidden:
        text.append(page[at:])
    flush()
    return found
