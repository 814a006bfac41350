"""Main text of web pages by wrapper induction.

A page's block elements are its tree; text elements of one kind under one parent are one node of it,
and so are neighbouring containers of the same shape (a list of cards is one slot). For every host
the commonest tree is the pivot that all others are aligned with by simple tree matching: the largest
number of nodes matched so that labels are equal, parents match and order is kept. Slots matched with
each other share their counts: on how many pages, how much text outside of links, and whether the
text is the same on all. Text that is the same on all of a host's pages is template. Of the varying
slots, those below the article are content (of the elements named so, or of the deepest container
that holds most of the host's varying text); slots of menus, headers, footers, sidebars, notices,
adverts, forms and comments, by element, role or name, are not.

Pages are parsed twice, once to count and once to cut, as trees are small and texts are not. Rules
are found once for each kind of tree of a host. No host, kind or page is gathered into one task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, give_back
from .urls import host_of

#: A slot is template if its text is the same on all of so many pages or more, of a host whose pages differ.
LEAST_PAGES = 5
#: A container is gone down into if it holds this share of the varying text; articles count if they hold NAMED of it.
DEEPER, NAMED = 0.75, 0.3
#: A form, or a name that is used for layout too, holds the page if so much of the text is in it.
HOLDS = 0.6
#: Nested deeper than that, elements count as the one at this depth.
DEEPEST = 200
#: Copies of a pivot, so that a host with many kinds of trees isn't one key.
SALTS = 16
#: A kind of tree with more than one in so many of all pages is dealt out.
HOT = 50
#: Bytes of text that a task hands on together.
BATCH = 4 << 20

_FLOW = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre ul ol dl table thead tbody tfoot tr td th caption figure figcaption hr".split())
_CONTAINERS = frozenset("address article aside center details dialog dir div fieldset footer form header hgroup main menu nav search section summary".split())
_BLOCKS = _FLOW | _CONTAINERS
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_ROWS, _GROUPS = frozenset(("tr", "table")), frozenset(("thead", "tbody", "tfoot", "caption"))
_ITEMS = _BLOCKS - {"div", "p", "address"}
#: By element: which open ones it ends, if none of the others is in between.
_ENDED = {
    "li": (frozenset(("li",)), _ITEMS), "dt": (frozenset(("dt", "dd")), _ITEMS), "dd": (frozenset(("dt", "dd")), _ITEMS),
    "tr": (frozenset(("tr",)), frozenset(("table",))), "td": (frozenset(("td", "th")), _ROWS), "th": (frozenset(("td", "th")), _ROWS),
    "thead": (_GROUPS, frozenset(("table",))), "tbody": (_GROUPS, frozenset(("table",))), "tfoot": (_GROUPS, frozenset(("table",))),
}
#: What these hold is no text of the page.
_RAW = frozenset("script style title textarea xmp iframe noembed noframes noscript".split())
_CONTROLS = frozenset("button select datalist svg canvas audio video object applet template".split())
_OUTSIDE = frozenset("nav footer aside menu dialog search".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar".split())
#: Words in classes and ids that name what is no content.
_NAMED = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar footer masthead ad ads advert adverts advertisement advertising sponsor sponsored "
    "promo cookie cookies consent gdpr notice notices newsletter subscribe subscription signup login sharing social related recommended "
    "recommendations comment comments disqus replies pagination pager toolbar".split()
)
#: Words that name it unless most of the page is inside.
_PERHAPS = frozenset("header banner widget widgets modal overlay popup alert notification share search reply respond form aside".split())
#: Words after which a class says what a page has, not what an element is; and words of an article's own header.
_LAYOUT, _OWN = frozenset("has with no without is js not hide show".split()), frozenset("article entry post story content page title main".split())

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|=)*+)>""", re.S)
_UNENDED = re.compile(r"<[a-zA-Z/!?]")
_ATTRIBUTE = re.compile(r"""(?:^|[\s"'])(class|id|role|style|hidden|aria-hidden)(?=[\s=/]|$)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_WORDS = re.compile(r"[a-z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def _names(token: str) -> list[str]:
    return _WORDS.findall(_CAMEL.sub("-", token).lower())


@lru_cache(4096)
def label(tag: str, attributes: str) -> str:
    """An element's label: a mark (``-`` no content, ``~`` no content unless it holds the page, ``+`` the article), tag, first name."""
    mark = "-" if tag in _OUTSIDE else "~" if tag == "form" else "+" if tag in ("article", "main") else ""
    if not attributes or attributes.isspace():
        return mark + tag
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)}
    tokens = found.get("class", "").split() + found.get("id", "").split()
    role = found.get("role", "").lower()
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or _HIDDEN.search(found.get("style", "")) or role in _ROLES:
        mark = "-"
    elif role in ("main", "article") and not mark:
        mark = "+"
    for token in tokens:
        words = _names(token)
        if not words or words[0] in _LAYOUT:
            continue
        if _NAMED.intersection(words) and tag not in ("main", "article") or _NAMED.intersection(words) & {"comment", "comments", "ad", "ads"}:
            mark = "-"
        elif not mark and _PERHAPS.intersection(words) and not _OWN.intersection(words):
            mark = "~"
    name = "-".join(_names(tokens[0])) if tokens else ""
    return f"{mark}{tag}.{name}" if name else mark + tag


class Page:
    """A page's blocks (node, text, characters in links) and its folded tree (``labels``, ``depths`` and kids in preorder)."""

    def __init__(self, html: str):
        self.labels, self.kids, self.blocks = ["root"], [[]], []
        self._flow: list[dict[str, int]] = [{}]
        self._read(html)
        self._fold()

    def _read(self, html: str) -> None:
        stack, pieces, linked = [("", 0)], [], 0
        in_link = False
        at, size = 0, len(html)

        def flush() -> None:
            nonlocal linked
            if pieces:
                text = "".join(pieces)
                text = " ".join((unescape(text) if "&" in text else text).split())
                if text:
                    self.blocks.append((stack[-1][1], text, min(linked, len(text))))
                pieces.clear()
            linked = 0

        while at < size:
            m = _TAG.search(html, at)
            end = m.start() if m else size
            if not m and (broken := _UNENDED.search(html, at)):
                end = broken.start()  # a tag that the page ends in
            if end > at:
                pieces.append(html[at:end])
                if in_link:
                    linked += end - at
            if not m:
                break
            at = m.end()
            tag = m[2]
            if tag is None:
                continue
            tag = tag.lower()
            if m[1]:
                if tag == "a":
                    in_link = False
                elif tag in _BLOCKS:
                    flush()
                    self._close(stack, tag)
            elif tag in _BLOCKS:
                flush()
                self._make_room(stack, tag)
                if tag != "hr":
                    self._open(stack, tag, m[3])
            elif tag == "br":
                pieces.append(" ")
            elif tag == "a":
                in_link = True
            elif tag in _RAW or tag in _CONTROLS:
                over = re.compile(f"</{tag}(?=[\\s/>])[^>]*>", re.I).search(html, at)
                if over:
                    at = over.end()
                elif tag in _RAW:
                    break
        flush()

    def _open(self, stack: list, tag: str, attributes: str) -> None:
        parent = stack[-1][1]
        if len(stack) > DEEPEST:
            stack.append((tag, parent))
            return
        name = label(tag, attributes)
        flow = self._flow[parent]
        node = flow.get(name) if tag in _FLOW else None
        if node is None:
            node = len(self.labels)
            self.labels.append(name)
            self.kids.append([])
            self._flow.append({})
            self.kids[parent].append(node)
            if tag in _FLOW:
                flow[name] = node
        stack.append((tag, node))

    @staticmethod
    def _make_room(stack: list, tag: str) -> None:
        """Ends the elements that a new one of ``tag`` can't be in."""
        top = stack[-1][0]
        if top == "p" or top in _HEADINGS and tag in _HEADINGS:
            stack.pop()
        if tag in _ENDED:
            ended, within = _ENDED[tag]
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in ended:
                    del stack[i:]
                    break
                if stack[i][0] in within:
                    break

    @staticmethod
    def _close(stack: list, tag: str) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] == tag or tag in _HEADINGS and stack[i][0] in _HEADINGS:
                del stack[i:]
                return
            if stack[i][0] in ("td", "th", "table") and tag not in ("table", "thead", "tbody", "tfoot", "tr", "td", "th"):
                return

    def _fold(self) -> None:
        """Neighbouring containers of the same shape become one; nodes are numbered in preorder."""
        labels, kids = self.labels, self.kids
        shapes: dict[tuple, int] = {}
        shape, same = [0] * len(labels), list(range(len(labels)))
        for v in range(len(labels) - 1, -1, -1):
            kept: list[int] = []
            for k in kids[v]:
                if kept and shape[kept[-1]] == shape[k]:
                    pairs = [(k, kept[-1])]
                    while pairs:
                        a, b = pairs.pop()
                        same[a] = b
                        pairs += zip(kids[a], kids[b], strict=True)
                else:
                    kept.append(k)
            kids[v] = kept
            shape[v] = shapes.setdefault((labels[v], *[shape[k] for k in kept]), len(shapes))
        number, depths, order, stack = {}, [], [], [(0, 0)]
        while stack:
            v, depth = stack.pop()
            number[v] = len(order)
            order.append(v)
            depths.append(depth)
            stack += [(k, depth + 1) for k in reversed(kids[v])]

        def place(v: int) -> int:
            while same[v] != v:
                v = same[v]
            return number[v]

        self.blocks = [(place(v), text, linked) for v, text, linked in self.blocks]
        self.labels, self.depths = [labels[v] for v in order], depths

    def skeleton(self) -> str:
        return "\n".join(f"{d} {x}" for d, x in zip(self.depths, self.labels, strict=True))


class Tree:
    """A skeleton with kids, parents and the shapes of its subtrees."""

    def __init__(self, skeleton: str):
        self.labels, self.parent, depths = [], [], []
        last: list[int] = []
        for i, line in enumerate(skeleton.split("\n")):
            depth, name = line.split(" ", 1)
            del last[int(depth) :]
            self.parent.append(last[-1] if last else -1)
            self.labels.append(name)
            depths.append(int(depth))
            last.append(i)
        self.kids: list[list[int]] = [[] for _ in self.labels]
        for i, p in enumerate(self.parent):
            if p >= 0:
                self.kids[p].append(i)
        self.shape = [""] * len(self.labels)
        for v in range(len(self.labels) - 1, -1, -1):
            self.shape[v] = xxhash.xxh128_hexdigest(f"{self.labels[v]}({','.join([self.shape[k] for k in self.kids[v]])})")


def matched(a: Tree, b: Tree) -> dict[int, int]:
    """Simple tree matching: nodes of ``a`` with those of ``b`` that they match, as many as can be."""
    weights: dict[tuple[int, int], int] = {}
    tables: dict[tuple[int, int], tuple[int, int, list]] = {}

    def trimmed(x: list[int], y: list[int]) -> tuple[int, int]:
        """Kids at both ends that are equal trees match as they are."""
        head = 0
        while head < min(len(x), len(y)) and a.shape[x[head]] == b.shape[y[head]]:
            head += 1
        tail = 0
        while tail < min(len(x), len(y)) - head and a.shape[x[-1 - tail]] == b.shape[y[-1 - tail]]:
            tail += 1
        return head, tail

    def weigh(u: int, v: int) -> int:
        if a.labels[u] != b.labels[v]:
            return 0
        if (u, v) in weights:
            return weights[u, v]
        x, y = a.kids[u], b.kids[v]
        head, tail = trimmed(x, y)
        xs, ys = x[head : len(x) - tail], y[head : len(y) - tail]
        table = [[0] * (len(ys) + 1) for _ in range(len(xs) + 1)]
        for i, p in enumerate(xs):
            for j, q in enumerate(ys):
                table[i + 1][j + 1] = max(table[i][j + 1], table[i + 1][j], table[i][j] + weigh(p, q))
        tables[u, v] = head, tail, table
        ends = x[:head] + x[len(x) - tail :]
        weights[u, v] = 1 + table[-1][-1] + sum(_size(a, k) for k in ends)
        return weights[u, v]

    out: dict[int, int] = {}
    if weigh(0, 0) == 0:
        return out
    pairs = [(0, 0)]
    while pairs:
        u, v = pairs.pop()
        out[u] = v
        if (u, v) not in tables:  # equal trees
            pairs += zip(a.kids[u], b.kids[v], strict=True)
            continue
        head, tail, table = tables[u, v]
        x, y = a.kids[u], b.kids[v]
        pairs += zip(x[:head], y[:head], strict=True)
        pairs += zip(x[len(x) - tail :], y[len(y) - tail :], strict=True)
        i, j = len(table) - 1, len(table[0]) - 1
        while i and j:
            p, q = x[head + i - 1], y[head + j - 1]
            if table[i][j] == table[i - 1][j]:
                i -= 1
            elif table[i][j] == table[i][j - 1]:
                j -= 1
            else:
                pairs.append((p, q))
                i, j = i - 1, j - 1
    return out


def _size(tree: Tree, v: int) -> int:
    """Nodes of a subtree; its numbers follow one another."""
    n, todo = 0, [v]
    while todo:
        n += 1
        todo += tree.kids[todo.pop()]
    return n


def content(skeleton: str, slots: dict[int, tuple[float, bool]]) -> list[int]:
    """Nodes of a kind of tree that are content. ``slots``: of nodes with text, characters outside of links on a page, and whether it is template."""
    tree = Tree(skeleton)
    n = len(tree.labels)
    tag = [x.lstrip("-~+").split(".")[0] for x in tree.labels]
    named = [x[0] == "+" for x in tree.labels]
    inside = [False] * n  # of an article or main element
    for v in range(1, n):
        inside[v] = inside[tree.parent[v]] or named[tree.parent[v]]
    outside = [x[0] == "-" or tag[v] == "header" and not inside[v] for v, x in enumerate(tree.labels)]

    def masses(banned: list[bool]) -> list[float]:
        own = [0.0 if slots.get(v, (0, True))[1] else slots[v][0] for v in range(n)]
        off = [False] * n
        for v in range(n):
            off[v] = banned[v] or v > 0 and off[tree.parent[v]]
        mass = [0.0 if off[v] else own[v] for v in range(n)]
        for v in range(n - 1, 0, -1):
            mass[tree.parent[v]] += mass[v]
        return mass

    mass = masses(outside)
    for v in range(n):
        if tree.labels[v][0] == "~" and mass[v] < HOLDS * mass[0]:
            outside[v] = True
    mass = masses(outside)
    off = [False] * n
    for v in range(n):
        off[v] = outside[v] or v > 0 and off[tree.parent[v]]
    articles = [v for v in range(n) if tag[v] == "article" and named[v] and not off[v]]
    articles = [v for v in articles if not any(u in articles for u in _above(tree, v))]
    mains = [v for v in range(n) if named[v] and tag[v] != "article" and not off[v]]
    mains = [v for v in mains if not any(u in mains for u in _above(tree, v))]
    held = sum(mass[v] for v in articles)
    if articles and held >= NAMED * (sum(mass[v] for v in mains) or mass[0]):
        roots = articles
    elif mains and sum(mass[v] for v in mains) >= NAMED * mass[0]:
        roots = mains
    else:
        v = 0
        while deeper := [k for k in tree.kids[v] if tag[k] not in _FLOW and not off[k] and mass[k] >= DEEPER * mass[v] > 0]:
            v = deeper[0]
        roots = [v]
    kept = set()
    for v in range(n):
        if not off[v] and (v in roots or v > 0 and tree.parent[v] in kept):
            kept.add(v)
    varying = sum(slots[v][0] for v in kept if v in slots and not slots[v][1])
    template = {v for v in kept if v in slots and slots[v][1]}
    if varying > sum(slots[v][0] for v in template):
        chosen = kept - template
    else:
        chosen = set(kept)  # the article itself is what the pages share
    if not any(tag[v] == "h1" for v in chosen):
        before = [v for v in range(n) if tag[v] == "h1" and not off[v] and v < min(roots) and v in slots and not slots[v][1]]
        chosen.update(before[-1:])
    return sorted(chosen)


def _above(tree: Tree, v: int) -> Iterator[int]:
    while (v := tree.parent[v]) >= 0:
        yield v


def _signature(skeleton: str) -> int:
    return xxhash.xxh64_intdigest(skeleton) - (1 << 63)


def _counted(pages: DataFrame) -> DataFrame:
    """host, kind, node, skeleton (at node 0 only), pages, chars, linked, lo, hi: texts of each node of each kind of tree.

    ``lo`` and ``hi``: least and largest digest of the node's text; at node 0 also of the whole page
    (``whole_lo``, ``whole_hi``). A task sums its batches before anything is shuffled.
    """
    kinds = pa.schema(
        [("host", pa.string()), ("kind", pa.int64()), ("node", pa.int32()), ("skeleton", pa.string())]
        + [(c, pa.int64()) for c in ("pages", "chars", "linked", "lo", "hi", "whole_lo", "whole_hi")]
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[tuple[str, int], list] = {}
            skeletons: dict[int, str] = {}
            for host, html in zip(batch.column("host"), batch.column("html"), strict=True):
                page = Page(html.as_py())
                skeleton = page.skeleton()
                kind = _signature(skeleton)
                skeletons[kind] = skeleton
                own: dict[int, list] = {}
                whole = xxhash.xxh64()
                for node, text, linked in page.blocks:
                    x = own.setdefault(node, [0, 0, xxhash.xxh64()])
                    x[0] += len(text)
                    x[1] += linked
                    data = text.encode("utf-8", "replace")
                    x[2].update(data + b"\n")
                    whole.update(data + b"\n")
                w = whole.intdigest() - (1 << 63)
                rows = found.setdefault((host.as_py(), kind), [[0, 0, 0, None, None, None, None] for _ in page.labels])
                for node, row in enumerate(rows):
                    chars, linked, digest = own.get(node, (0, 0, None))
                    h = digest.intdigest() - (1 << 63) if digest else 0
                    row[0] += 1
                    row[1] += chars
                    row[2] += linked
                    row[3] = h if row[3] is None else min(row[3], h)
                    row[4] = h if row[4] is None else max(row[4], h)
                    row[5] = w if row[5] is None else min(row[5], w)
                    row[6] = w if row[6] is None else max(row[6], w)
            out = [(host, kind, node, None if node else skeletons[kind], *row) for (host, kind), rows in found.items() for node, row in enumerate(rows)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], schema=kinds)
            give_back()

    numbers = ("pages", "chars", "linked", "lo", "hi", "whole_lo", "whole_hi")
    schema = "host string, kind long, node int, skeleton string, " + ", ".join(f"{c} long" for c in numbers)
    rows = pages.select("host", "html").where(F.col("html").isNotNull()).mapInArrow(work, schema)
    ends = [F.min(c).alias(c) for c in ("lo", "whole_lo")] + [F.max(c).alias(c) for c in ("hi", "whole_hi")]
    return rows.groupBy("host", "kind", "node").agg(F.max("skeleton").alias("skeleton"), *[F.sum(c).alias(c) for c in numbers[:3]], *ends)


def _aligned(kinds: DataFrame, pivots: DataFrame) -> DataFrame:
    """host, kind, node, slot: the node of the host's pivot that a node of a kind of tree matches."""
    out = pa.schema([("host", pa.string()), ("kind", pa.int64()), ("node", pa.int32()), ("slot", pa.int32())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees: dict[str, Tree] = {}
        for batch in batches:
            for host, kind, skeleton, pivot in zip(*(batch.column(c).to_pylist() for c in ("host", "kind", "skeleton", "pivot")), strict=True):
                if pivot not in trees:
                    trees = {pivot: Tree(pivot)}
                own = matched(Tree(skeleton), trees[pivot])
                columns = [[host] * len(own), [kind] * len(own), list(own), list(own.values())]
                yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(columns, out, strict=True)], schema=out)

    salted = kinds.withColumn("salt", F.pmod("kind", F.lit(SALTS)))
    copies = pivots.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    both = salted.join(copies, ["host", "salt"]).select("host", "kind", "skeleton", "pivot")
    return both.mapInArrow(work, "host string, kind long, node int, slot int")


def wrappers(pages: DataFrame) -> DataFrame:
    """host, kind, n_pages, kept: for each kind of tree of a host (by digest) its nodes that are content.

    ``pages``: host, html. Rules come from all pages. A host with fewer than LEAST_PAGES has no template
    text; its articles are found by name and by where its text is.
    """
    slots = cut(_counted(pages))
    kinds = slots.where("node = 0").select("host", "kind", "skeleton", "pages", "whole_lo", "whole_hi")
    pivots = kinds.groupBy("host").agg(F.max_by("skeleton", F.struct("pages", "kind")).alias("pivot"), (F.min("whole_lo") != F.max("whole_hi")).alias("differ"))
    aligned = cut(_aligned(kinds.select("host", "kind", "skeleton"), pivots.select("host", "pivot")))
    known = slots.drop("skeleton", "whole_lo", "whole_hi").join(aligned, ["host", "kind", "node"], "left")
    pooled = known.where("slot is not null").groupBy("host", "slot").agg(
        *[F.sum(c).alias(f"all_{c}") for c in ("pages", "chars", "linked")], F.min("lo").alias("all_lo"), F.max("hi").alias("all_hi")
    )
    texts = known.where("chars > 0").join(pooled, ["host", "slot"], "left").join(pivots.select("host", "differ"), "host")
    n = F.coalesce("all_pages", "pages")
    mass = (F.coalesce("all_chars", "chars") - F.coalesce("all_linked", "linked")) / n
    fixed = F.col("differ") & (n >= LEAST_PAGES) & (F.coalesce("all_lo", "lo") == F.coalesce("all_hi", "hi"))
    gathered = texts.groupBy("host", "kind").agg(F.collect_list(F.struct("node", mass.alias("mass"), fixed.alias("template"))).alias("slots"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for skeleton, own in zip(batch.column("skeleton").to_pylist(), batch.column("slots").to_pylist(), strict=True):
                kept.append(content(skeleton, {x["node"]: (x["mass"], x["template"]) for x in own or ()}))
            columns = [batch.column("host"), batch.column("kind"), batch.column("pages"), pa.array(kept, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, ["host", "kind", "n_pages", "kept"])

    rows = kinds.select("host", "kind", "skeleton", "pages").join(gathered, ["host", "kind"], "left")
    return rows.mapInArrow(work, "host string, kind long, n_pages long, kept array<int>")


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row.

    ``pages``: page_id, url, html. Blocks of the article in page order, joined by two line feeds;
    character references are decoded and white space inside a block is one space. Line breaks are
    white space; list items and table cells are blocks. Null and empty html, and pages without an article,
    give an empty text; a null url is a host of its own, without a name. Repeated rows come out as often
    as they went in; of an empty table the result is empty; other columns are left out. Elements nested
    more than DEEPEST deep count as their ancestor at that depth, and lose no text.
    """
    spark = pages.sparkSession
    rows = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), "html")
    rules = cut(wrappers(rows))
    total = rules.agg(F.sum("n_pages")).first()[0] or 0
    # Fewer than HOT kinds have more than a HOT-th of all pages.
    hot = [r[0] for r in rules.where(F.col("n_pages") * HOT > total).select(F.xxhash64("host", "kind")).collect()]
    salts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    often = F.xxhash64("host", "kind").isin(hot) if hot else F.lit(False)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "url", "host", "kind", "blocks"]
        block = pa.list_(pa.struct([("node", pa.int32()), ("text", pa.string())]))
        for batch in batches:
            start, size, kinds, out = 0, 0, [], []
            for i, html in enumerate(batch.column("html")):
                page = Page(html.as_py() or "")
                kinds.append(_signature(page.skeleton()))
                out.append([{"node": v, "text": text} for v, text, _ in page.blocks])
                size += len(html.as_py() or "")
                if size >= BATCH or i + 1 == batch.num_rows:
                    part = batch.slice(start, len(out))
                    columns = [part.column("page_id"), part.column("url"), part.column("host"), pa.array(kinds, pa.int64()), pa.array(out, block)]
                    yield pa.RecordBatch.from_arrays(columns, names)
                    start, size, kinds, out = i + 1, 0, [], []
            give_back()

    parsed = rows.mapInArrow(work, f"page_id {dict(pages.dtypes)['page_id']}, url string, host string, kind long, blocks array<struct<node:int,text:string>>")
    parsed = parsed.withColumn("salt", F.when(often, F.pmod(F.xxhash64("page_id", "url"), F.lit(salts))).otherwise(0).cast("long"))
    last = F.when(often, salts - 1).otherwise(0).cast("long")
    dealt = rules.select("host", "kind", "kept", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("salt"))
    both = parsed.join(dealt, ["host", "kind", "salt"], "left")
    own = F.transform(F.filter("blocks", lambda b: F.array_contains("kept", b["node"])), lambda b: b["text"])
    text = F.coalesce(F.array_join(own, "\n\n"), F.lit(""))
    return both.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.char_length("text").cast("long"))
