"""Main text of web pages: wrappers learned from the pages of a host, by simple tree matching."""

from collections import Counter
from collections.abc import Callable, Iterator
from functools import cache
from hashlib import blake2b
from html.parser import HTMLParser
from itertools import islice
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeledger.llm.batches import slices
from treeledger.llm.url_rules import host_of
from treeledger.operators.joins import heavy_keys, lookup_join
from treeledger.sources.workspace import materialize

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset("head title script style noscript template iframe object svg math canvas form button select textarea "
                    "nav footer aside dialog menu".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span "
                   "strike strong sub sup time tt u var wbr".split())
HEAD_ONLY = frozenset("base link meta noscript script style template title".split())
# Elements that may be a region by their class, id or role; a heading or a stretch of a line is none.
REGIONS = frozenset("center div dl fieldset figure ol p section table td ul".split())
# Words that say how a region is laid out, in names such as comment-list.
LAYOUT = frozenset("area article articles bar block bottom box buttons center column container content entries fixed form "
                   "group header inner item items left link links list main outer page panel post posts right row section "
                   "site slot small sticky story stories top unit wide wrap wrapper".split())
# Words that name a region beside the article.
BESIDE = frozenset("ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments complementary "
                   "consent contentinfo cookie cookies disqus footer gdpr header menu modal nav navbar navigation "
                   "newsletter notice pagination popup promo promotion related replies reply respond search share "
                   "sharing sidebar social sponsor sponsored subscribe toolbar widget".split())
# A new one of these ends open ones of the listed kinds inside the nearest of the others.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
        "th": ("td", "th"), "option": ("option",)}
HOLDERS = frozenset("ul ol dl table tbody thead tfoot body article main section div select".split())
DEPTH = 150  # deeper elements become children of the one at this depth; their text stays
NAMES_KEPT = 1 << 16  # class names and the like that a worker keeps read
AGREEING = 3  # articles that make a text constant
GROUP_PAGES = 250  # a host with more pages than this may be cut into groups
HOSTS_CUT = 1 << 16  # a host is cut once it has more than one in so many of all pages, so no more hosts are cut


class Node:
    __slots__ = ("tag", "names", "region", "children", "parent", "depth")

    def __init__(self, tag: str, names: frozenset = frozenset(), parent: "Node | None" = None, region: bool = False):
        self.tag, self.names, self.parent, self.region = tag, names, parent, region
        self.children: list[Node | str] = []
        self.depth = 0 if parent is None else parent.depth + 1


class Builder(HTMLParser):
    """A forgiving tree: unknown end tags are dropped, a block ends an open paragraph, all ends with the page."""

    known: dict[str, tuple[frozenset, bool]] = {}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.here = Node("#root")
        self.wraps = False

    def handle_starttag(self, tag, attrs):
        if tag not in INLINE and tag not in VOID:
            self._end(("p",), HOLDERS)
        if tag in ENDS:
            self._end(ENDS[tag], HOLDERS - {"tbody", "thead", "tfoot"} if tag == "tr" else HOLDERS)
        if tag not in HEAD_ONLY and tag != "head":
            self._leave_head()
        names, region = frozenset(), False
        for key, value in attrs:
            if key in ("class", "id", "role") and value:
                more, beside_ = read_names(value, self.known)
                names, region = names | more if names else more, region or beside_
        self.wraps = self.wraps or tag in ("form", "button")
        node = Node(tag, names, self.here, region)
        self.here.children.append(node)
        if tag not in VOID and node.depth < DEPTH:
            self.here = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag in ("script", "style"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        node = self.here
        while node is not None and node.tag != tag:
            if tag in INLINE and node.tag not in INLINE:
                return
            node = node.parent
        if node is not None and node.parent is not None:
            self.here = node.parent

    def handle_data(self, data):
        if self.here.tag == "head" and data.strip():
            self._leave_head()
        self.here.children.append(data)

    def _leave_head(self):
        """What cannot stand in a head ends it, though its end tag be left out."""
        node = self.here.parent if self.here.tag == "title" else self.here
        if node is not None and node.tag == "head":
            self.here = node.parent

    def unknown_decl(self, data):
        if data.startswith("CDATA["):
            self.handle_data(data[6:])

    def parse_marked_section(self, i, report=1):
        try:
            return super().parse_marked_section(i, report)
        except AssertionError:  # no section that the parser knows: a bogus comment up to the next >
            return self.parse_bogus_comment(i)

    def _end(self, tags, bounds):
        node, found = self.here, None
        while node is not None and (node.tag not in bounds or node.tag in tags):
            if node.tag in tags:
                found = node
            node = node.parent
        if found is not None and found.parent is not None:
            self.here = found.parent


def names_region(parts: list[str]) -> bool:
    """Whether a name, cut at its hyphens, is that of a region: a word for one, with none but words for its layout."""
    words = [part for part in parts if part and not part.isdigit()]
    return any(w in BESIDE for w in words) and all(w in BESIDE or w in LAYOUT for w in words)


def read_names(value: str, known: dict[str, tuple[frozenset, bool]]) -> tuple[frozenset, bool]:
    """The words of a class, id or role, and whether any of its names is that of a region; known keeps what was read."""
    if value in known:
        return known[value]
    if len(known) >= NAMES_KEPT:
        known.clear()
    tokens = [token.split("-") for token in value.lower().replace("_", "-").split()]
    known[value] = frozenset(word for token in tokens for word in token if word), any(map(names_region, tokens))
    return known[value]


def parse(html: str) -> Node:
    """The tree of a page. A form or button around a main region, an article or most of the text is an ordinary block."""
    builder = Builder()
    builder.feed(html)
    builder.close()
    if not builder.wraps:
        return builder.root
    sizes: dict[int, tuple[int, bool]] = {}
    stack, order = [builder.root], []
    while stack:
        order.append(node := stack.pop())
        stack += [c for c in node.children if isinstance(c, Node)]
    for node in reversed(order):
        inner = [sizes[id(c)] for c in node.children if isinstance(c, Node)]
        text = 0 if node.tag in ("script", "style") else sum(len("".join(c.split())) for c in node.children if isinstance(c, str))
        sizes[id(node)] = text + sum(n for n, _ in inner), node.tag in ("main", "article") or any(has for _, has in inner)
    whole = sizes[id(builder.root)][0]
    for node in order:
        if node.tag in ("form", "button") and (sizes[id(node)][1] or 2 * sizes[id(node)][0] > whole):
            node.tag = "div"
    return builder.root


def beside(node: Node, inside: bool) -> bool:
    """Whether an element is a region beside the article. An article's own header belongs to it."""
    if node.tag in SKIPPED:
        return True
    if node.tag in ("html", "body", "main") or (node.tag == "article" and not node.names & {"comment", "comments", "reply"}):
        return False
    if node.tag == "header":
        return not inside
    return node.tag in REGIONS and node.region


def main_roots(root: Node) -> list[Node]:
    """Articles outside other regions, or else the outermost main regions, or else everything.

    A main region is a main element, or a block with the word main in class, id or role that
    holds most of the page's text; so a heading of class main-title is none. A main element
    with more text outside of its articles than in the longest of them is the article itself.
    """
    articles, mains, whole, stack = [], [], [], [(root, True)]
    everything = None
    while stack:
        node, outermost = stack.pop()
        if node.tag == "article":
            articles.append(node)
            continue
        if outermost and node.tag == "main":
            outermost = False
            mains.append(node)
            nested = list(articles_in(node))
            longest = max(map(size_of, nested), default=0)
            if nested and size_of(node) - sum(map(size_of, nested)) > longest:
                whole.append(node)
                continue
        elif outermost and "main" in node.names and node.tag not in ("html", "body") and node.tag not in INLINE:
            everything = size_of(root) if everything is None else everything
            if 2 * size_of(node) > everything:
                mains.append(node)
                outermost = False
        stack += [(c, outermost) for c in reversed(node.children) if isinstance(c, Node) and not beside(c, False)]
    return whole + articles or mains or [root]


def articles_in(node: Node) -> Iterator[Node]:
    """The outermost articles below an element and outside the regions beside it."""
    for child in node.children:
        if isinstance(child, Node) and not beside(child, True):
            if child.tag == "article":
                yield child
            else:
                yield from articles_in(child)


def size_of(node: Node) -> int:
    return sum(len(b.text) for b in blocks(node))


class Block:
    """A stretch of text between block boundaries, at the path of the element that holds it."""
    __slots__ = ("path", "text", "node")

    def __init__(self, path: str, text: str, node: Node):
        self.path, self.text, self.node = path, text, node


def blocks(top: Node, path: str = "") -> list[Block]:
    """The texts below an element in page order, without regions beside the article."""
    out: list[Block] = []
    pending: list[str] = []
    inside = top.tag != "#root"

    def flush(node: Node, path: str):
        text = " ".join("".join(pending).split())
        pending.clear()
        if text:
            out.append(Block(path, text, node))

    def walk(node: Node, holder: Node, path: str):
        for child in node.children:
            if isinstance(child, str):
                pending.append(child)
            elif child.tag == "br":
                pending.append(" ")
            elif child.tag in INLINE:
                if not beside(child, inside):
                    walk(child, holder, path)
            else:
                flush(holder, path)
                if child.tag not in VOID and not beside(child, inside):
                    below = f"{path}/{child.tag}"
                    walk(child, child, below)
                    flush(child, below)

    walk(top, top, path or top.tag)
    flush(top, path or top.tag)
    return out


def elements(node: Node) -> list[Node]:
    return [c for c in node.children if isinstance(c, Node) and c.tag not in INLINE and c.tag not in VOID
            and not beside(c, True)]


class Shapes:
    """Numbers for element trees without texts and names, and the sizes of their matchings, which depend on nothing else."""

    def __init__(self):
        self.numbers: dict[tuple, int] = {}
        self.tags: list[str] = []
        self.below: list[np.ndarray] = []
        self.held: dict[int, tuple[Node, int, list[Node]]] = {}
        self.sizes: dict[tuple[int, int], int] = {}

    def of(self, node: Node) -> tuple[int, list[Node]]:
        """An element's shape and its elements. Nodes are held, so that their ids stay theirs."""
        if id(node) not in self.held:
            inner = elements(node)
            key = node.tag, tuple(self.of(x)[0] for x in inner)
            if key not in self.numbers:
                self.numbers[key] = len(self.tags)
                self.tags.append(node.tag)
                self.below.append(np.array(key[1], np.int64))
            self.held[id(node)] = node, self.numbers[key], inner
        return self.held[id(node)][1:]

    def size(self, a: int, b: int) -> int:
        """Simple tree matching: the most pairs of elements that agree in tag, ancestors and order."""
        if self.tags[a] != self.tags[b]:
            return 0
        if not len(self.below[a]) or not len(self.below[b]):
            return 1
        if (a, b) not in self.sizes:
            row = None
            for row in self.rows(a, b):
                pass
            self.sizes[a, b] = 1 + int(row[-1])
        return self.sizes[a, b]

    def weights(self, a: int, b: int) -> Callable[[int], np.ndarray]:
        """For each child of a the sizes of its matchings with the children of b."""
        kinds, place = np.unique(self.below[b], return_inverse=True)
        return cache(lambda shape: np.array([self.size(shape, int(k)) for k in kinds], np.int64)[place])

    def rows(self, a: int, b: int) -> Iterator[np.ndarray]:
        """Row i of the table: the best size of a matching of the first i children of a and the first j of b."""
        weights, row = self.weights(a, b), np.zeros(len(self.below[b]) + 1, np.int64)
        yield row
        for shape in self.below[a].tolist():
            row = next_row(row, weights(shape))
            yield row

    def pairs(self, a: Node, b: Node) -> Iterator[tuple[Node, Node]]:
        """The pairs of a matching of that size. Of the table only every so many rows are held, and those between
        them made again on the way back, so its memory grows with the width times its root."""
        p, ours = self.of(a)
        q, theirs = self.of(b)
        if a.tag != b.tag:
            return
        yield a, b
        if not ours or not theirs:
            return
        weights, step = self.weights(p, q), isqrt(len(ours)) + 1
        kept = [row for i, row in enumerate(self.rows(p, q)) if i % step == 0]
        shapes, i, j, first, table = self.below[p].tolist(), len(ours), len(theirs), -1, []
        while i and j:
            if (i - 1) // step != first:
                first = (i - 1) // step
                table = [kept[first]]
                for shape in shapes[first * step:i]:
                    table.append(next_row(table[-1], weights(shape)))
            above, here, size = table[i - 1 - first * step], table[i - first * step], int(weights(shapes[i - 1])[j - 1])
            if here[j] == above[j - 1] + size:
                i, j = i - 1, j - 1
                if size:
                    yield from self.pairs(ours[i], theirs[j])
            elif here[j] == above[j]:
                i -= 1
            else:
                j -= 1


def next_row(row: np.ndarray, weights: np.ndarray) -> np.ndarray:
    out = row.copy()
    np.maximum(row[1:], row[:-1] + weights, out=out[1:])
    return np.maximum.accumulate(out)


def matching(a: Node, b: Node, shapes: Shapes | None = None) -> tuple[int, list[tuple[Node, Node]]]:
    """Simple tree matching: its size and the matched pairs of elements, whatever their width."""
    shapes = shapes or Shapes()
    return shapes.size(shapes.of(a)[0], shapes.of(b)[0]), list(shapes.pairs(a, b))


def number_of(*parts: str) -> int:
    return int.from_bytes(blake2b("\0".join(parts).encode(errors="surrogatepass"), digest_size=8).digest(), "big", signed=True)


class Page:
    """The blocks of a page. Its layout is the elements, with names free of digits, that lead to its main regions."""

    def __init__(self, html: str):
        self.roots = main_roots(parse(html))
        self.blocks = [b for root in self.roots for b in blocks(root)]
        self.layout = number_of(*(f"{node.tag} {' '.join(sorted(n for n in node.names if not any(map(str.isdigit, n))))}"
                                  for node in leading(self.roots[0])))
        self.slots = [number_of(str(self.layout), b.path, b.text) for b in self.blocks]

    def text(self, constant=frozenset()) -> str:
        return " ".join(b.text for b, slot in zip(self.blocks, self.slots) if slot not in constant)

    def agreed(self, other: "Page", shapes: Shapes) -> set[int]:
        """The slots at which aligned elements of two pages hold the same text."""
        if not set(self.slots) & set(other.slots):
            return set()
        ours, theirs = self._held(), other._held()
        return {slot for a, b in zip(self.roots, other.roots) for x, y in shapes.pairs(a, b)
                for slot in ours.get(id(x), set()) & theirs.get(id(y), set())}

    def _held(self) -> dict[int, set[int]]:
        held: dict[int, set[int]] = {}
        for block, slot in zip(self.blocks, self.slots):
            held.setdefault(id(block.node), set()).add(slot)
        return held

    def sizes(self) -> dict[int, int]:
        sizes: Counter = Counter()
        for block, slot in zip(self.blocks, self.slots):
            sizes[slot] += len(block.text)
        return sizes


def leading(node: Node) -> Iterator[Node]:
    while node is not None:
        yield node
        node = node.parent


class Neighbours:
    """Aligns each page of a host with the last two of its layout. A slot that most pages hold is held by two so near."""

    def __init__(self):
        self.last: dict[int, list[Page]] = {}

    def agreed(self, page: Page) -> set[int]:
        near = self.last.setdefault(page.layout, [])
        if any(page.slots == other.slots for other in near):
            return set()
        shapes = Shapes()
        found = set().union(*(page.agreed(other, shapes) for other in near))
        self.last[page.layout] = [*near, page][-2:]
        return found


def shares(slots: list[int], sizes: list[int], pages: list[int], whole: int) -> tuple[float, list[float]]:
    """What part of an article a page stands for, and the same without each slot.

    slots are those on several pages, with their numbers of pages. A page is one of n copies if at
    least half of its text is in slots that n pages hold, so that copies make up one article.
    """
    if not slots:
        return 1.0, []
    order = np.lexsort((slots, -np.array(pages)))
    size, held = np.array(sizes, np.int64)[order], np.array(pages, np.int64)[order]
    twice, ranks = 2 * np.cumsum(size), np.arange(len(order))
    copies = np.r_[held, 1]
    before, after = np.searchsorted(twice, whole - size), np.searchsorted(twice, whole + size)
    without = np.where(whole == size, held, copies[np.where(before < ranks, before, after)])
    out = np.empty(len(order))
    out[order] = 1 / without
    return float(1 / copies[np.searchsorted(twice, whole)]), out.tolist()


def constant(articles: float, every: float) -> bool:
    return articles > AGREEING - 1e-6 and 2 * articles > every + 1e-6


def induce(pages: list[Page]) -> frozenset:
    """The wrapper of the pages of one host, directly: what `wrappers` makes of a whole table."""
    neighbours, agreed, distinct = Neighbours(), set(), {}
    for page in pages:
        agreed |= neighbours.agreed(page)
        distinct[page.layout, tuple(page.slots)] = page
    held = Counter(slot for page in distinct.values() for slot in set(page.slots))
    every, articles = Counter(), Counter()
    for page in distinct.values():
        own = [(slot, n, held[slot]) for slot, n in page.sizes().items() if held[slot] > 1]
        whole, parts = shares(*([o[i] for o in own] for i in range(3)), sum(page.sizes().values()))
        every[page.layout] += whole
        for (slot, *_), part in zip(own, parts):
            articles[slot, page.layout] += part
    return frozenset(slot for (slot, layout), n in articles.items() if slot in agreed and constant(n, every[layout]))


def read(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    """(html, ...) of each row, the html last in memory for one slice only."""
    for batch in batches:
        keys = zip(*(batch.column(name).to_pylist() for name in names))
        texts = (raw for part in slices(batch.column("html")) for raw in part)
        for raw, key in zip(texts, keys):
            yield (raw or b"").decode(), *key


def in_batches(rows: Iterator[tuple], names: list[str], kinds: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    while held := list(islice(rows, 500)):
        yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*held), kinds)], names=names)


def wrappers(dealt: DataFrame) -> DataFrame:
    """The constant slots of each site, from all of its pages: a list per site that has any.

    A page gives a row with the numbers of its slots, one for all pages that are equal in them.
    Sites' slots are counted by Spark, partly before the shuffle, and the counts go back to the
    pages by a join that cuts frequent slots. A slot is constant if alignment found it on
    two pages, and if the pages that hold it stand for AGREEING articles and for most articles of
    their layout. What is held per row is the slots of one page.
    """
    def learn(batches):
        def rows():
            group, neighbours = None, Neighbours()
            for html, *own in read(batches, "site", "block"):
                if own != group:
                    group, neighbours = own, Neighbours()
                page = Page(html)
                sizes = page.sizes()
                yield (own[0], page.layout, number_of(*map(str, page.slots)), sum(sizes.values()),
                       list(sizes), list(sizes.values()), list(neighbours.agreed(page)))

        longs = pa.list_(pa.int64())
        return in_batches(rows(), ["site", "layout", "page", "whole", "slots", "sizes", "agreed"], [pa.int64()] * 4 + [longs] * 3)

    seen = dealt.sortWithinPartitions("site", "block", "order").select("site", "block", "html").mapInArrow(
        learn, "site long, layout long, page long, whole long, slots array<long>, sizes array<long>, agreed array<long>")
    one = ["site", "layout", "page"]
    pages = materialize(seen.groupBy(*one).agg(*(F.first(c).alias(c) for c in ("whole", "slots", "sizes")),
                                               F.flatten(F.collect_list("agreed")).alias("agreed")))
    slots = pages.select(*one, "whole", F.explode(F.arrays_zip("slots", "sizes")).alias("z")).select(
        *one, "whole", F.col("z.slots").alias("slot"), F.col("z.sizes").alias("size"))
    # A slot's number has its layout in it.
    counts = slots.groupBy("site", "slot").agg(F.count(F.lit(1)).alias("_rows")).where("_rows > 1")
    counts = materialize(counts)
    several = lookup_join(slots, counts.withColumn("held", F.col("_rows")).drop("_rows"), ["site", "slot"], "inner", ["page"],
                          counts=counts)
    several = several.groupBy(*one, "whole").agg(F.collect_list(F.struct("slot", "size", "held")).alias("z"))

    def weigh(batches):
        def rows():
            for batch in batches:
                for site, layout, whole, z in zip(*(batch.column(c).to_pylist() for c in ("site", "layout", "whole", "z"))):
                    own = [[x[c] for x in z] for c in ("slot", "size", "held")]
                    part, parts = shares(*own, whole)
                    yield site, layout, None, part - 1
                    for slot, without in zip(own[0], parts):
                        yield site, layout, slot, without

        return in_batches(rows(), ["site", "layout", "slot", "part"], [pa.int64()] * 3 + [pa.float64()])

    parts = several.select("site", "layout", "whole", "z").mapInArrow(weigh, "site long, layout long, slot long, part double")
    parts = parts.groupBy("site", "layout", "slot").agg(F.sum("part").alias("articles"))
    parts = materialize(parts)
    every = pages.groupBy("site", "layout").agg(F.count(F.lit(1)).alias("n")).join(
        parts.where("slot IS NULL").select("site", "layout", "articles"), ["site", "layout"], "left").select(
        "site", "layout", (F.col("n") + F.coalesce("articles", F.lit(0.0))).alias("every"))
    agreed = pages.select("site", F.explode("agreed").alias("slot")).distinct()
    found = (parts.where(F.col("slot").isNotNull() & (F.col("articles") > AGREEING - 1e-6))
             .join(every, ["site", "layout"]).where(2 * F.col("articles") > F.col("every") + 1e-6)
             .join(agreed, ["site", "slot"], "left_semi"))
    return found.groupBy("site").agg(F.collect_list("slot").alias("constant"))


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Every page with page_id, url, text and n_chars.

    Pages are brought together by host, once, to learn. A host with more pages than GROUP_PAGES
    is cut into groups by a hash of the id, unless it has less than one in HOSTS_CUT of all pages;
    so the list of such hosts is bounded and no task gets a whole hot host. All groups of a host
    make its wrapper, and every page meets that one: the wrappers are joined to the pages where
    these lie, or with hot hosts cut, as Spark finds their measured size. A null or empty html has
    an empty text; pages without a url form a host of their own; repeated rows stay.

    Beside the article are the elements of SKIPPED, a header outside of it, and the blocks
    of REGIONS whose class, id or role is a word of BESIDE, alone or with words of LAYOUT:
    comment-list is such a name, share-price and related-work are none, and headings, links
    and stretches of a line never go. Tags that html lets authors leave out are supplied: an
    open head ends where its content cannot stand. Elements that a style or the attribute
    hidden keeps from view are read like others.
    """
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"),
                        F.xxhash64(host_of(url)).alias("site"))
    counts = rows.groupBy("site").agg(F.count(F.lit(1)).alias("_rows"))
    heavy = F.broadcast(heavy_keys(counts, ["site"], slices=HOSTS_CUT, at_least=GROUP_PAGES))
    order = F.xxhash64("page_id", "url")
    one = F.lit(1).cast("bigint")
    dealt = rows.select("site", "html", order.alias("order")).join(heavy, "site", "left")
    dealt = dealt.withColumn("block", F.pmod("order", F.coalesce("_slices", F.lit(1).cast("bigint")))).drop("_slices")
    found = materialize(wrappers(dealt.repartition("site", "block")))
    fields = rows.select("page_id", "url").schema

    def run(batches):
        def texts():
            for raw, page, link, known in read(batches, "page_id", "url", "constant"):
                text = Page(raw).text(frozenset(known or ()))
                yield page, link, text, len(text)

        return in_batches(texts(), ["page_id", "url", "text", "n_chars"], kinds)

    from pyspark.sql.pandas.types import to_arrow_type
    kinds = [to_arrow_type(f.dataType) for f in fields] + [pa.string(), pa.int64()]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields) + ", text string, n_chars long"
    joined = lookup_join(rows, found, ["site"], "left", ["page_id", "url"], counts=counts, at_least=GROUP_PAGES)
    return joined.select("page_id", "url", "html", "constant").mapInArrow(run, schema)
