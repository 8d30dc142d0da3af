"""HTML extraction by wrapper induction.

Pages of one host are made by one template. Every page is a tree of block elements (runs of alike siblings folded
into one node). A block text that stands at one path in all pages of a host, or in all of its pages of one layout
(the same named elements and containers below the body), with at least ``LEAST_PAGES`` different pages among them,
is template, other texts are slots. For the root paths all pages of a layout (those of a host's layouts without
template together) are aligned by simple tree matching (two nodes match when their labels do, children are matched in
order for the largest total), and the lengths of their slots and of the links in them are added up; a slot whose text is
mostly links, or which sits in an element that names a menu, footer, advert or the like, is not content. The content
roots are the outermost article and main elements with slot text, or else the whole page; each is moved down only as
far as no slot text is left behind. The wrapper of a host is the paths of these roots by layout and the template's
constant texts; it is applied to every page of the host, and the blocks that are left of all elements at these paths
make the text, in page order. A page that is alone on its host, or lacks its layout's roots, gets roots of its own, and
so does text beside them.

Pages are parsed once for their shape, the checksums and lengths of their block texts, which are staged without the
texts. What pages have in common is intersected, and pages of one shape are added up and shapes aligned, within each
partition before anything moves; wrappers are broadcast when their size allows and joined by host otherwise.

Defined cases: forms and objects that hold an article or main element, or most of the page's text, are plain
containers without their controls and labels; a null page counts as empty and gives an empty text; a null or odd url has no host, its page stands
alone; repeated rows come out as they came; an empty table gives an empty result.
"""
from __future__ import annotations

import json
import sys
from hashlib import blake2b
from typing import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import ddl, per_worker, prepare, read, slices, stage
from tessera.llm.dom import BLOCK, DEEPEST, Node, blocks, parse, squeeze
from tessera.llm.registry import query

LEAST_PAGES = 3                 # different pages of a host or layout that make a constant text template
ALIKE = 0.8                     # share of common texts from which two pages count as copies
LINK_SHARE = 0.5                # links from which a slot is no content
BROADCAST_BYTES = 64 << 20
WRAPPERS_KEPT = 20_000          # decoded wrappers a worker keeps
GROUPS_KEPT = 5_000             # hosts and layouts, or their shapes, a task holds before it writes them

# fixed values: elements and names that hold no main text
ASIDE = frozenset("nav aside footer form button select dialog menu svg math head object canvas audio video".split())
NAMES = frozenset("""ad ads advert adverts advertisement advertising sponsor sponsored promo banner cookie cookies consent
gdpr notice popup modal overlay newsletter subscribe nav navbar navigation menu sidebar footer breadcrumb breadcrumbs
pagination pager comment comments disqus reply replies share sharing social related recommended widget login signup
search skip toolbar masthead copyright""".split())
FORMS = frozenset(["form", "object"])      # of ASIDE, unless the page's text stands in them
HEADS = frozenset(["header", "masthead"])
# names that main text may carry too
WEAK_NAMES = frozenset("""banner notice overlay popup modal promo recommended related reply replies search share sharing signup
skip social toolbar widget""".split())
# words that say where, how many or how big, and leave a name what it is
BESIDE = frozenset("""and area bar block bottom box button buttons container content foot group head horizontal icons inner item items
left link links list main media mini mobile outer page panel posts primary right row secondary section site slot small sticky
stories text top unit vertical wrap wrapper""".split())
STRONG_SHARE, WEAK_SHARE = 0.9, 0.5    # of the text around that an element with such a name must hold to be kept
PARTS = frozenset("article main section div table form center header footer nav aside".split())


class Weight:
    """Lengths below an element, without menus, labels, headers and links: all text, that of paragraphs, both again of
    what stands in forms; and whether it holds an article or main element."""

    __slots__ = ("text", "paragraphs", "form_text", "form_paragraphs", "core")

    def __init__(self, node: Node):
        self.text = self.paragraphs = self.form_text = self.form_paragraphs = 0
        self.core = False
        for kid in node.kids:
            if isinstance(kid, str):
                self.text += len(kid.strip())
                continue
            below = kid.weight
            self.core |= below.core or kid.tag in ("article", "main") and not evidence(kid)
            if kid.tag in FORMS or kid.tag not in ASIDE and kid.tag not in ("a", "label", "header"):
                self.text += below.text
                self.paragraphs += below.paragraphs
                self.form_text += below.form_text
                self.form_paragraphs += below.form_paragraphs
        if node.tag == "p":
            self.paragraphs = self.text
        if node.tag in FORMS:
            self.form_text, self.form_paragraphs = self.text, self.paragraphs


def weight(node: Node) -> Weight:
    """The weight of an element; the whole page is weighed at the first call."""
    if node.weight is None:
        top = top_of(node)
        order = [top]
        for x in order:
            order += [k for k in x.kids if not isinstance(k, str)]
        for x in reversed(order):
            x.weight = Weight(x)
    return node.weight


def top_of(node: Node) -> Node:
    while node.parent is not None:
        node = node.parent
    return node


def evidence(node: Node) -> float:
    """The share of the text around it that an element must hold in spite of its names; 0 if no name speaks against it.

    A name counts as a whole: each word of it is on the lists (``sidebar-left``, but not ``with-sidebar``).
    """
    share = 0.0
    for token in node.tokens:
        if all(w in NAMES or w in BESIDE or w in HEADS for w in token):
            if any(w in NAMES and w not in WEAK_NAMES for w in token):
                share = max(share, STRONG_SHARE)
            elif any(w in NAMES for w in token):
                share = max(share, WEAK_SHARE)
    return share


def is_head(node: Node) -> bool:
    return node.tag == "header" or any(HEADS.intersection(t) and all(w in HEADS or w in BESIDE for w in t) for t in node.tokens)


def enclosing(node: Node, tags: tuple[str, ...]) -> Node | None:
    """The nearest element around (or at) ``node`` of one of ``tags``."""
    while node is not None and node.tag not in tags:
        node = node.parent
    return node


def text_in_forms(top: Node) -> bool:
    """Whether forms and objects hold most of the page's paragraph text (of all text but links, without paragraphs)."""
    w = weight(top)
    return 2 * w.form_paragraphs > w.paragraphs if w.paragraphs else 2 * w.form_text > w.text


def holds(node: Node, share: float) -> bool:
    """Whether an element holds ``share`` of the text of the article or main element around it, or else of the page."""
    around = enclosing(node.parent, ("article", "main")) or top_of(node)
    return weight(node).text > 0 and weight(node).text >= share * weight(around).text


def boilerplate(node: Node) -> bool:
    """Elements that by tag or name hold no main text. Tags decide; a name is only evidence, outweighed by an article
    inside or by most of the text around."""
    if node.tag in FORMS:
        if not text_in_forms(top_of(node)) and not weight(node).core:
            return True
    elif node.tag in ASIDE:
        return True
    if node.tag == "label":
        return enclosing(node, tuple(FORMS)) is not None
    if is_head(node):
        return enclosing(node, ("article", "main", "section")) is None and not weight(node).core and not (
            node.tag != "header" and holds(node, WEAK_SHARE))
    share = evidence(node)
    return share > 0 and node.tag not in ("html", "body", "main") and not weight(node).core and not holds(node, share)


# functions below go down a tree by recursion; its depth is bounded by the parser
sys.setrecursionlimit(max(sys.getrecursionlimit(), 12 * DEEPEST))


class Skeleton:
    """Folded tree of block elements: label, block texts with the length of links in each, children."""

    __slots__ = ("label", "tag", "text", "linked", "length", "links", "out", "many", "kids")

    def __init__(self, label: str, tag: str, out: bool):
        self.label, self.tag, self.out = label, tag, out
        self.text: list[str] = []
        self.linked: list[int] = []
        self.length = self.links = 0        # of the texts that are no template, where they are not out
        self.many = False                   # several siblings that hold such texts, united
        self.kids: list[Skeleton] = []


def mark(path: str, text: str) -> int:
    """Checksum of a block text and the path it stands at."""
    return int.from_bytes(blake2b(f"{path}\n{text}".encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def flat(tree: Skeleton) -> tuple[str, list[tuple[int, int, int, int]]]:
    """Shape of a tree (a line for each node: depth, whether it is out, label) and its block texts: number of the node,
    checksum, length, length of links."""
    lines: list[str] = []
    texts: list[tuple[int, int, int, int]] = []

    def walk(node: Skeleton, path: str, depth: int) -> None:
        at = len(lines)
        lines.append(f"{depth} {node.out:d} {node.label}")
        texts.extend((at, mark(path, text), len(text), linked) for text, linked in zip(node.text, node.linked))
        for kid in node.kids:
            walk(kid, f"{path}/{kid.label}", depth + 1)

    walk(tree, tree.label, 0)
    return "\n".join(lines), texts


def shaped(shape: str) -> list[Skeleton]:
    """The nodes of a tree of this shape, the top first."""
    nodes: list[Skeleton] = []
    above: list[Skeleton] = []
    for line in shape.split("\n"):
        depth, out, label = line.split(" ")
        node = Skeleton(label, label.partition(".")[0], out == "1")
        del above[int(depth):]
        if above:
            above[-1].kids.append(node)
        above.append(node)
        nodes.append(node)
    return nodes


def marks(tree: Skeleton) -> set[int]:
    """Checksums of all block texts of a page."""
    return {text[1] for text in flat(tree)[1]}


def skeleton(node: Node, out: bool = False) -> Skeleton:
    """The block elements below ``node``; inline elements add to the text of their block."""
    me = Skeleton(node.label, node.tag, out or boilerplate(node))
    run: list[str] = []
    linked: list[str] = []

    def inline(kid: Node, link: bool) -> None:
        for x in kid.kids:
            if isinstance(x, str):
                run.append(x)
                if link:
                    linked.append(x)
            elif x.tag in BLOCK:
                add(x)
            elif x.tag == "br":
                run.append(" ")
            elif not boilerplate(x):
                inline(x, link or x.tag == "a")

    def close() -> None:
        text = squeeze("".join(run))
        if text:
            me.text.append(text)
            me.linked.append(sum(len(squeeze(x)) for x in linked))
        run.clear()
        linked.clear()

    def add(kid: Node) -> None:
        close()
        below = skeleton(kid, me.out)
        if me.kids and me.kids[-1].label == below.label:
            fold(me.kids[-1], below)
        else:
            me.kids.append(below)

    inline(node, node.tag == "a")
    close()
    return me


def fold(one: Skeleton, more: Skeleton) -> None:
    """Take a sibling of the same label into ``one``."""
    one.text += more.text
    one.linked += more.linked
    known = {k.label: k for k in one.kids}
    for kid in more.kids:
        if kid.label in known:
            fold(known[kid.label], kid)
        else:
            one.kids.append(kid)
            known[kid.label] = kid


def tree_match(a: Skeleton, b: Skeleton) -> tuple[int, list[tuple[Skeleton, Skeleton]]]:
    """Simple tree matching of two trees with equal root labels: number of matched nodes and the pairs."""
    best: dict[tuple[int, int], tuple[int, list]] = {}
    score = [[0] * (len(b.kids) + 1) for _ in range(len(a.kids) + 1)]
    for i, x in enumerate(a.kids, 1):
        for j, y in enumerate(b.kids, 1):
            score[i][j] = max(score[i - 1][j], score[i][j - 1])
            if x.label == y.label:
                best[i, j] = tree_match(x, y)
                score[i][j] = max(score[i][j], score[i - 1][j - 1] + best[i, j][0])
    pairs = [(a, b)]
    i, j = len(a.kids), len(b.kids)
    while i and j:
        if score[i][j] == score[i - 1][j]:
            i -= 1
        elif score[i][j] == score[i][j - 1]:
            j -= 1
        else:
            pairs += best[i, j][1]
            i, j = i - 1, j - 1
    return 1 + score[-1][-1], pairs


def own_text(node: Skeleton) -> int:
    """Length of the varying text of a node itself that may be content."""
    return 0 if node.out or node.links > LINK_SHARE * node.length else node.length


def slot_text(node: Skeleton) -> int:
    """Length of the varying text below a node that may be content."""
    return 0 if node.out else own_text(node) + sum(map(slot_text, node.kids))


def differs(page: set[int], others: list[set[int]]) -> bool:
    return all(len(page & m) < ALIKE * max(1, min(len(page), len(m))) for m in others)


class Common:
    """What a group of pages has in common: the block texts of all of them and up to ``LEAST_PAGES`` pages that differ."""

    __slots__ = ("all", "kinds")

    def __init__(self):
        self.all: set[int] | None = None
        self.kinds: list[set[int]] = []

    def take(self, all_have: set[int], kinds: list[set[int]]) -> None:
        self.all = set(all_have) if self.all is None else self.all & all_have
        for kind in kinds:
            if len(self.kinds) < LEAST_PAGES and differs(kind, self.kinds):
                self.kinds.append(kind)

    def template(self) -> set[int]:
        """Copies of one page do not show what is template."""
        return self.all if self.all and len(self.kinds) >= LEAST_PAGES else set()


def layout(top: Node) -> str:
    """The kind of a page: the named elements and containers directly below its body."""
    body = next((k for k in top.kids if not isinstance(k, str) and k.tag == "body"), top)
    return " ".join(sorted({k.label for k in body.kids if not isinstance(k, str) and (k.names or k.tag in PARTS)}))


def induce(trees: list[Skeleton], constants: dict[str, list[int]] | None = None) -> dict:
    """Wrapper of aligned pages: paths of the content roots and the checksums of the template's block texts by layout
    ("" for all layouts); these are taken from the pages themselves if not given."""
    if constants is None:
        here = Common()
        for m in map(marks, trees):
            here.take(m, [m])
        constants = {"": sorted(here.template())} if here.template() else {}
    common = set().union(*constants.values())

    def settle(node: Skeleton, path: str) -> None:
        slots = [] if node.out else [(len(t), n) for t, n in zip(node.text, node.linked) if mark(path, t) not in common]
        node.length, node.links = sum(t for t, _ in slots), sum(n for _, n in slots)
        for kid in node.kids:
            settle(kid, f"{path}/{kid.label}")

    for tree in trees:
        settle(tree, tree.label)
        unite(tree)
    for tree in trees[1:]:
        align(trees[0], tree)
    paths = root_paths(trees[0])
    return {"root": paths[0], "also": paths[1:], "constants": constants}


def align(mine: Skeleton, other: Skeleton) -> None:
    """Add the lengths of another tree to a tree with an equal root label. A node is out if it is on all pages."""
    _, pairs = tree_match(mine, other)
    matched = {id(x) for _, x in pairs}
    for node, more in pairs:
        node.length += more.length
        node.links += more.links
        node.out = node.out and more.out
        node.many = node.many or more.many
        # paths name labels only: what stands elsewhere among its siblings on this page is the same place
        known = {k.label: k for k in reversed(node.kids)}
        for kid in more.kids:
            if id(kid) not in matched and kid.label in known:
                align(known[kid.label], kid)
            elif id(kid) not in matched:
                node.kids.append(kid)


def unite(node: Skeleton) -> None:
    """Make siblings of one label, which have one path, one node."""
    known: dict[str, Skeleton] = {}
    for kid in node.kids:
        unite(kid)
        first = known.setdefault(kid.label, kid)
        if first is not kid:
            many = slot_text(first) > 0 and slot_text(kid) > 0
            align(first, kid)
            first.many = first.many or many
    node.kids = list(known.values())


def root_paths(template: Skeleton) -> list[str]:
    """Paths of the content roots of aligned pages."""
    cores: list[tuple[int, Skeleton, str]] = []

    def search(node: Skeleton, path: str) -> None:
        if node.out:
            return
        if node.tag in ("article", "main") and (text := slot_text(node)):
            cores.append((text, node, path))
            return
        for kid in node.kids:
            search(kid, f"{path}/{kid.label}")

    search(template, template.label)
    found = cores or [(0, template, template.label)]
    return list(dict.fromkeys(narrow(node, path) for _, node, path in sorted(found, key=lambda c: (-c[0], c[2]))))


def narrow(node: Skeleton, path: str) -> str:
    """Path of the deepest element below ``node`` that leaves no slot text behind."""
    while not own_text(node):
        some = [kid for kid in node.kids if slot_text(kid)]
        if len(some) != 1 or some[0].many or not some[0].kids:
            break
        node, path = some[0], f"{path}/{some[0].label}"
    return path


def under(path: str, top: str) -> bool:
    return path == top or path.startswith(top + "/")


def path_of(node: Node) -> str:
    """Labels from the top to the node, block elements only."""
    names = []
    while node is not None:
        if node.tag in BLOCK:
            names.append(node.label)
        node = node.parent
    return "/".join(reversed(names))


def roots(top: Node, paths: list[str]) -> list[Node]:
    """The elements of a page at the root paths, in page order."""
    found, stack = [], [(top, top.label)]
    while stack:
        node, at = stack.pop()
        if at in paths and (node.tag in BLOCK or node.parent is None):
            found.append(node)
            continue
        for kid in reversed(node.kids):
            if not isinstance(kid, str):
                below = f"{at}/{kid.label}" if kid.tag in BLOCK else at
                if any(under(path, below) for path in paths):
                    stack.append((kid, below))
    return found


def extract(page: str | None, wrapper: dict | None = None) -> str:
    """Main text of a page under its host's wrapper."""
    top = parse(page)
    found, common, kind, paths = [], set(), layout(top), []
    if wrapper:
        constants = wrapper["constants"]
        common = {*constants.get("", ()), *constants.get(kind, ())}
        paths = wrapper.get("layouts", {}).get(kind) or [wrapper["root"], *wrapper["also"]]
        found = roots(top, paths)
    if not found or kind in constants:      # what a page has beside the roots of its layout, or in their place
        own = induce([skeleton(top)], {"": common})
        paths = [*(paths if found else ()), own["root"], *own["also"]]
        found = roots(top, paths)

    def constant(node: Node, text: str) -> bool:
        return mark(path_of(node), text) in common

    return "\n".join(text for x in found for text in blocks(x, boilerplate, constant if common else None))


def host_of(url):
    """Host of a url column, lower case; null where there is none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    return F.when(host != "", host)


_BLOCKS = "host string, layout string, shape string, nodes array<int>, marks array<long>, lengths array<int>, links array<int>"


def _page_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shape and block texts of every page that has any, the texts as checksums and lengths."""
    kinds = [pa.string(), pa.string(), pa.string(), *map(pa.list_, (pa.int32(), pa.int64(), pa.int32(), pa.int32()))]
    names = ["host", "layout", "shape", "nodes", "marks", "lengths", "links"]
    for batch in slices(batches, 128):
        rows = []
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            top = parse(page)
            shape, texts = flat(skeleton(top))
            if texts:
                rows.append((host, layout(top), shape, *zip(*texts)))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows), kinds)], names)


def induce_wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, wrapper as JSON) of each host with at least two pages, from all of its pages."""
    keyed = pages.select(host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html")).where(
        F.col("host").isNotNull() & F.col("html").isNotNull())
    # only hosts with two pages or more; few when they are many
    some = stage(keyed.groupBy("host").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("host"), "hosts")
    if some.count() * 64 <= BROADCAST_BYTES:
        some = F.broadcast(some)
    page_blocks = stage(keyed.join(some, "host", "left_semi").select("host", "html").mapInArrow(_page_blocks, _BLOCKS), "page-blocks")
    constants = stage(host_constants(page_blocks), "constants")
    found = host_roots(page_blocks, constants).groupBy("host").agg(F.collect_list(F.struct("layout", "paths")).alias("roots"))

    def wrap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wrappers = []
            for constant, layouts in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                paths = {r["layout"]: r["paths"] for r in sorted(layouts, key=lambda r: r["layout"])}
                root, *also = paths.pop("", None) or [""]       # no element stands at an empty path
                wrappers.append(json.dumps({"root": root, "also": also, "layouts": paths, "constants": json.loads(constant)}))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(wrappers, pa.string())], ["host", "wrapper"])

    return constants.join(found, "host").select("host", "constants", "roots").mapInArrow(wrap, "host string, wrapper string")


_SUMS = "host string, layout string, shape string, many array<int>, lengths array<long>, links array<long>"


def _sums_table(trees: dict[tuple[str, str], Skeleton]) -> pa.RecordBatch:
    rows = []
    for (host, kind), tree in trees.items():
        nodes: list[Skeleton] = []

        def walk(node: Skeleton) -> None:
            nodes.append(node)
            for kid in node.kids:
                walk(kid)

        walk(tree)
        rows.append((host, kind, flat(tree)[0], [i for i, n in enumerate(nodes) if n.many], [n.length for n in nodes],
                     [n.links for n in nodes]))
    kinds = [pa.string(), pa.string(), pa.string(), *map(pa.list_, (pa.int32(), pa.int64(), pa.int64()))]
    return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows), kinds)],
                                      ["host", "layout", "shape", "many", "lengths", "links"])


def _aligned(sums: dict[tuple[str, str, str], tuple[list[int], list[int]]]) -> pa.RecordBatch:
    """One tree for each host and layout from the sums of its shapes."""
    trees: dict[tuple[str, str], Skeleton] = {}
    for (host, kind, shape), (lengths, links) in sorted(sums.items()):
        nodes = shaped(shape)
        for node, length, linked in zip(nodes, lengths, links):
            if not node.out:
                node.length, node.links = length, linked
        unite(nodes[0])
        if (host, kind) in trees:
            align(trees[host, kind], nodes[0])
        else:
            trees[host, kind] = nodes[0]
    return _sums_table(trees)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lengths of the slot texts of the pages of each host and layout, by place, within one partition."""
    sums: dict[tuple[str, str, str], tuple[list[int], list[int]]] = {}
    decoded: dict[str, tuple[set[str], set[int]]] = {}
    for batch in slices(batches):
        for host, kind, shape, nodes, here, lengths, links, text in zip(*(c.to_pylist() for c in batch.columns)):
            if text not in decoded:
                if len(decoded) >= GROUPS_KEPT:
                    decoded.clear()
                constants = json.loads(text)
                decoded[text] = set(constants), set().union(*constants.values())
            kinds, common = decoded[text]
            key = host, kind if kind in kinds else "", shape
            if key not in sums:
                if len(sums) >= GROUPS_KEPT:
                    yield _aligned(sums)
                    sums.clear()
                count = shape.count("\n") + 1
                sums[key] = [0] * count, [0] * count
            length, linked = sums[key]
            for at, m, n, k in zip(nodes, here, lengths, links):
                if m not in common:
                    length[at] += n
                    linked[at] += k
    if sums:
        yield _aligned(sums)


def host_roots(page_blocks: DataFrame, constants: DataFrame) -> DataFrame:
    """(host, layout, paths of the content roots) over every page; pages of layouts without constants count under ""."""
    def one_layout(table: pa.Table) -> pa.Table:
        template = None
        for row in sorted(table.to_pylist(), key=lambda r: (r["shape"], r["lengths"], r["links"])):
            nodes = shaped(row["shape"])
            for node, length, linked in zip(nodes, row["lengths"], row["links"]):
                node.length, node.links = length, linked
            for at in row["many"]:
                nodes[at].many = True
            if template is None:
                template = nodes[0]
            else:
                align(template, nodes[0])
        return pa.table({"host": table["host"][:1], "layout": table["layout"][:1],
                         "paths": pa.array([root_paths(template)], pa.list_(pa.string()))})

    size = constants.agg(F.sum(F.octet_length("constants") + F.octet_length("host"))).first()[0] or 0
    known = F.broadcast(constants) if size <= BROADCAST_BYTES else constants
    rows = page_blocks.join(known, "host").select("host", "layout", "shape", "nodes", "marks", "lengths", "links", "constants")
    return rows.mapInArrow(_summed, _SUMS).groupBy("host", "layout").applyInArrow(
        one_layout, "host string, layout string, paths array<string>")


_COMMON = "host string, layout string, everywhere array<long>, kinds array<array<long>>"


def _common_table(groups: dict[tuple, Common]) -> pa.RecordBatch:
    longs = pa.list_(pa.int64())
    return pa.RecordBatch.from_arrays([
        pa.array([h for h, _ in groups], pa.string()), pa.array([k for _, k in groups], pa.string()),
        pa.array([sorted(g.all) for g in groups.values()], longs),
        pa.array([[sorted(k) for k in g.kinds] for g in groups.values()], pa.list_(longs))],
        ["host", "layout", "everywhere", "kinds"])


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the pages of each host and layout have in common, within one partition."""
    groups: dict[tuple, Common] = {}
    for batch in slices(batches, 128):
        for host, kind, here in zip(*(c.to_pylist() for c in batch.columns)):
            groups.setdefault((host, kind), Common()).take(set(here), [set(here)])
        if len(groups) > GROUPS_KEPT:
            yield _common_table(groups)
            groups.clear()
    if groups:
        yield _common_table(groups)


def _merged(table: pa.Table) -> Common:
    group = Common()
    for row in sorted(table.to_pylist(), key=lambda r: (r["layout"], r["kinds"])):
        group.take(set(row["everywhere"]), list(map(set, row["kinds"])))
    return group


def host_constants(page_blocks: DataFrame) -> DataFrame:
    """(host, constants as JSON): block texts that stand at one path in all pages of a host (under "") and in all of a
    layout, over every page; copies change nothing, as the same set met twice gives the same intersection."""
    def one_layout(table: pa.Table) -> pa.Table:
        return pa.Table.from_batches([_common_table({(table["host"][0].as_py(), table["layout"][0].as_py()): _merged(table)})])

    def one_host(table: pa.Table) -> pa.Table:
        found = {"": sorted(_merged(table).template())}
        for row in table.to_pylist():
            if len(row["kinds"]) >= LEAST_PAGES:
                found[row["layout"]] = sorted({*row["everywhere"], *found.get(row["layout"], ())})
        return pa.table({"host": table["host"][:1], "constants": [json.dumps(found)]})

    parts = page_blocks.select("host", "layout", "marks").mapInArrow(_gathered, _COMMON)
    layouts = parts.groupBy("host", "layout").applyInArrow(one_layout, _COMMON)
    return layouts.groupBy("host").applyInArrow(one_host, "host string, constants string")


def extract_pages(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``pages`` without the html, with ``text`` (new, or in place of such a column): the main text of every page."""
    prepare(pages.sparkSession)
    wrappers = stage(induce_wrappers(pages, url_col, html_col), "wrappers")
    size = wrappers.agg(F.sum(F.octet_length("wrapper") + F.octet_length("host"))).first()[0] or 0
    if size <= BROADCAST_BYTES:
        wrappers = F.broadcast(wrappers)
    keep = [c for c in pages.columns if c not in (html_col, "text")]
    rows = pages.withColumn("_host", host_of(F.col(url_col))).join(
        wrappers.withColumnRenamed("host", "_host"), "_host", "left").select(
        *[F.col(f"`{c}`") for c in keep], F.col(f"`{html_col}`").alias("_html"), F.col("wrapper").alias("_wrapper"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoded = per_worker(("wrappers",), dict)
        for batch in slices(batches, 128):
            texts = []
            for page, wrapper in zip(batch.column(len(keep)).to_pylist(), batch.column(len(keep) + 1).to_pylist()):
                if wrapper is not None and wrapper not in decoded:
                    if len(decoded) >= WRAPPERS_KEPT:
                        decoded.clear()
                    decoded[wrapper] = json.loads(wrapper)
                texts.append(extract(page, decoded.get(wrapper)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(keep)], pa.array(texts, pa.string())], [*keep, "text"])

    return rows.mapInArrow(run, ddl(pages, keep) + ", text string")


@query("op10_wrapper_html")
def op10_wrapper_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    texts = extract_pages(read(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return texts.withColumn("n_chars", F.length("text").cast("long"))
