"""A small, forgiving HTML tree: elements, text, and the blocks of text they form."""
from __future__ import annotations

import html as entities
import re

# fixed values: element kinds
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
BLOCK = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset
figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre
section select summary table tbody td tfoot th thead tr ul""".split())
CLOSES_P = BLOCK - frozenset("body html caption legend option optgroup tbody td tfoot th thead tr".split())
SAME_LEVEL = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "optgroup": {"option", "optgroup"},
              "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"tbody", "thead", "tr", "td", "th"},
              "tfoot": {"tbody", "thead", "tr", "td", "th"}, "thead": set()}
SCOPE = frozenset("ul ol dl table select body html article section div main aside nav td th".split())

DEEPEST = 400                  # elements nested deeper are taken as siblings, as browsers do from some depth on

# all possessive, so that odd pages take linear time
_NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
_ATTRIBUTES = re.compile(r"""(?:"[^"]*+"|'[^']*+'|[^>"'])*+(?=>)""")
_NAMES = re.compile(r"""(?:\A|[\s"'])(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_SPACE = re.compile(r"\s+")
_HUMP = re.compile(r"([a-z])([A-Z])")


class Node:
    """An element; ``kids`` holds elements and strings (character references decoded), ``names`` the words of its
    class, id and role, ``tokens`` these values' white-space parts as tuples of words. ``weight`` is free for the user."""

    __slots__ = ("tag", "names", "tokens", "parent", "kids", "depth", "weight")

    def __init__(self, tag: str, tokens: tuple[tuple[str, ...], ...], parent: "Node | None"):
        self.tag, self.tokens, self.parent, self.kids, self.weight = tag, tokens, parent, [], None
        self.names = tuple(sorted({w for t in tokens for w in t}))
        self.depth = parent.depth + 1 if parent is not None else 0

    @property
    def label(self) -> str:
        """Tag with class and id names, digits out."""
        return ".".join((self.tag, *self.names))


def _attribute_tokens(attributes: str) -> tuple[tuple[str, ...], ...]:
    """``class="a-b c"`` gives (a, b), (c,); words are runs of letters, ``aB`` is two of them."""
    if "=" not in attributes:
        return ()
    found = []
    for _, value in _NAMES.findall(attributes):
        for token in value.strip("\"'").split():
            words = tuple(w for w in re.split(r"[^a-z]+", _HUMP.sub(r"\1 \2", token).lower()) if w)
            if words:
                found.append(words)
    return tuple(found)


def parse(page: str | None) -> Node:
    """Tree of a page. Unclosed and stray tags are mended as browsers do in the common cases."""
    root = Node("html", (), None)
    if not page:
        return root
    now, at, end, plain = root, 0, len(page), 0

    def text(upto: int) -> None:
        if upto > plain:
            now.kids.append(entities.unescape(page[plain:upto]))

    while at < end:
        start = page.find("<", at)
        if start < 0:
            break
        if page.startswith("<!--", start):
            text(start)
            at = page.find("-->", start + 4)
            plain = at = at + 3 if at >= 0 else end
            continue
        closing = page.startswith("</", start)
        name = _NAME.match(page, start + 1 + closing)
        if name is None and not page.startswith(("<!", "<?", "</"), start):
            at = start + 1          # a lone "<" is text
            continue
        text(start)
        at = name.end() if name else start + 2
        found = _ATTRIBUTES.match(page, at)
        stop = found.end() if found else page.find(">", at)
        if stop < 0:                # cut off inside a tag
            return root
        attributes = page[at:stop]
        plain = at = stop + 1
        if name is None:
            continue
        tag = name[0].lower()
        if closing:
            up = now
            while up is not None and up.tag != tag:
                up = up.parent
            if up is not None and up.parent is not None:
                now = up.parent
            continue
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}\s*/?>", re.I).search(page, at)
            plain = at = close.end() if close else end
            continue
        if tag == "html":
            continue
        if tag in CLOSES_P:
            up = now
            while up.parent is not None and up.tag != "p" and up.tag not in BLOCK:
                up = up.parent
            if up.tag == "p":
                now = up.parent
        if tag in SAME_LEVEL:
            up = now
            while up.parent is not None and up.tag not in SAME_LEVEL[tag] and up.tag not in SCOPE:
                up = up.parent
            while up.tag in SAME_LEVEL[tag] and up.parent is not None:
                now = up = up.parent
        node = Node(tag, _attribute_tokens(attributes), now)
        now.kids.append(node)
        if tag not in VOID and not attributes.endswith("/") and node.depth < DEEPEST:
            now = node
    text(end)
    return root


def squeeze(text: str) -> str:
    return _SPACE.sub(" ", text).strip()


def blocks(node: Node, skip, constant=None) -> list[str]:
    """Texts of the blocks below ``node`` in page order, without elements for which ``skip`` holds and texts for
    which ``constant`` (block element, text) holds."""
    out: list[str] = []
    run: list[str] = []
    within = [node]

    def close() -> None:
        text = squeeze("".join(run))
        run.clear()
        if text and not (constant and constant(within[-1], text)):
            out.append(text)

    stack: list = [iter(node.kids)]
    opened: list[bool] = []
    while stack:
        kid = next(stack[-1], None)
        if kid is None:
            stack.pop()
            if opened and opened.pop():
                close()
                within.pop()
            continue
        if isinstance(kid, str):
            run.append(kid)
        elif not skip(kid):
            block = kid.tag in BLOCK
            if block:
                close()
                within.append(kid)
            elif kid.tag == "br":
                run.append(" ")
            stack.append(iter(kid.kids))
            opened.append(block)
    close()
    return out
