"""HTML extraction by wrapper induction.

Pages of a host that use the same containers are one layout, and one page of each layout is its wrapper's seed. Every
page's tree is aligned with its seed by simple tree matching (equal tags, best order-keeping match of the children). Over
all pages of a layout, each node of the seed then has a share of pages that repeat its text, and the amounts of varying
and of linked text below it. Constant nodes are template. The content slot is found from the root down: the child that
holds most of the varying text, as long as there is one. A second pass keeps the texts of each page's node that is aligned
with the slot, less constant and linked nodes in it, and less what the page marks inside it as menu, advert, form or
comment. Marks alone (tags and class names) decide only where a layout has too few pages, or a page has no such node.
"""

from __future__ import annotations

import html as entities
import math
import re
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import chunks, pick, stash, text_settings, trimmed

#: A node is template if this share of the pages that have it, LEAST at least, repeats its text.
SHARE, LEAST = 0.9, 3
#: A child is the next step to the slot if it holds this share of the varying text, and a node is a menu with this share of linked text.
MOST, LINKED = 0.5, 0.6
#: A slot, menu or template text is in this share of a layout's pages at least.
SLOT_PAGES, TEMPLATE_PAGES = 0.5, 0.1
#: A container before the slot belongs to it if it has paragraphs and this share of the slot's varying text.
LEAD = 0.03
#: A page with this share of its article's characters in the seed too is a copy of it, and no evidence.
COPY = 0.9
#: Layouts of fewer pages use the wrapper of the most common one of their host.
LAYOUT_PAGES = 6
#: Seeds of so many bytes are sent to all executors; more are joined by host and layout.
SENT_BYTES = 4 << 20
#: Wrappers whose counts a task holds before it hands them on, and tree shapes that a worker remembers.
HELD, SHAPES = 1_000, 200_000

INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("head script style noscript template iframe svg math object canvas audio video nav footer aside form button select textarea menu dialog".split())
#: Words of a class, id or role that mark what is not the article. Fixed values.
MARKS = frozenset(
    """ad ads adbox advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert
    popup modal overlay newsletter subscribe subscription sidebar sidenav nav navbar navigation menu menus breadcrumb breadcrumbs footer masthead topbar comment
    comments reply replies respond disqus discussion share sharing social related recommended widget toolbar pagination pager login signup signin search
    contentinfo complementary hidden skip""".split()
)
#: Words that make a class name speak of a layout, not of the element (has-sidebar). Fixed values.
LAYOUT = frozenset("has with no without open closed enabled disabled".split())
HEADING = frozenset("h1 h2".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
STOPS = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
#: Elements that hold running text and never the whole article.
TEXTUAL = frozenset("# p h1 h2 h3 h4 h5 h6 pre blockquote ul ol li dl dt dd figure figcaption caption".split())
#: Elements whose content is no markup.
RAW = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in ("script", "style", "noscript", "template", "iframe", "textarea", "title")}
_TAG = re.compile(r"""<(/?)([a-z][^\s/>]*)((?:[^<>"']++|"[^"]*+"|'[^']*+')*+|[^>]*+)>""", re.I)
_OTHER = re.compile(r"<[!?][^>]*>")
_CUT = re.compile(r"</?[a-z]", re.I)
_MARKED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?=[\s=/]|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
_PARTS = re.compile(r"[a-z]+").findall


class Shapes:
    """Trees of labels, each different one once, by number; and best matches of two trees, remembered by their numbers."""

    def __init__(self):
        self.of: dict = {}
        self.label, self.children, self.nodes = [], [], []
        self.sizes: dict = {}
        self.aligned: dict = {}

    def add(self, label: str, children: tuple) -> int:
        key = label, children
        found = self.of.get(key)
        if found is None:
            found = self.of[key] = len(self.label)
            self.label.append(label)
            self.children.append(children)
            self.nodes.append(1 + sum(self.nodes[c] for c in children))
        return found

    def _gain(self, a: int, b: int) -> int:
        return self.sizes[a, b] if self.label[a] == self.label[b] else 0

    def size(self, a: int, b: int) -> int:
        """Nodes of the best match of two trees whose roots are matched; 0 if the labels differ. Trees may be of any depth."""
        if self.label[a] != self.label[b]:
            return 0
        todo = [(a, b)]
        while todo:
            x, y = todo[-1]
            if (x, y) in self.sizes:
                todo.pop()
                continue
            if x == y:
                self.sizes[x, y] = self.nodes[x]
                todo.pop()
                continue
            p, q = self.children[x], self.children[y]
            low, high = self._ends(p, q)
            p, q = p[low : len(p) - high], q[low : len(q) - high]
            need = [(c, d) for c in dict.fromkeys(p) for d in dict.fromkeys(q) if self.label[c] == self.label[d] and (c, d) not in self.sizes]
            if need:
                todo += need
                continue
            same = sum(self.nodes[c] for c in self.children[x][:low]) + sum(self.nodes[c] for c in self.children[x][len(self.children[x]) - high :])
            self.sizes[x, y] = 1 + same + (self._table(p, q)[0] if p and q else 0)
            todo.pop()
        return self.sizes[a, b]

    @staticmethod
    def _ends(p: tuple, q: tuple) -> tuple[int, int]:
        """How many children are the same from the start, and then from the end: a best match pairs them."""
        most, low, high = min(len(p), len(q)), 0, 0
        while low < most and p[low] == q[low]:
            low += 1
        while high < most - low and p[-1 - high] == q[-1 - high]:
            high += 1
        return low, high

    def _rows(self, p: tuple, q: tuple):
        """A function from row i + 1 of the table of best matches of p[i:] and q[j:] to row i."""
        kinds = {y: k for k, y in enumerate(dict.fromkeys(q))}
        of_q = np.array([kinds[y] for y in q])
        gains = {x: np.array([self._gain(x, y) for y in kinds], "i4")[of_q] for x in dict.fromkeys(p)}

        def above(row, i):
            out = np.zeros(len(q) + 1, "i4")
            out[:-1] = np.maximum.accumulate(np.maximum(row[:-1], row[1:] + gains[p[i]])[::-1])[::-1]
            return out

        return above, gains

    def _table(self, p: tuple, q: tuple) -> np.ndarray:
        above, _ = self._rows(p, q)
        row = np.zeros(len(q) + 1, "i4")
        for i in range(len(p) - 1, -1, -1):
            row = above(row, i)
        return row

    def _best(self, p: tuple, q: tuple) -> list[tuple[int, int]]:
        """Pairs of a best order-keeping match of two lists: of the table only every so many rows are kept, others are made again on the way back."""
        above, gains = self._rows(p, q)
        n, m = len(p), len(q)
        step = math.isqrt(n) + 1
        row = np.zeros(m + 1, "i4")
        kept = {n: row}
        for i in range(n - 1, -1, -1):
            row = above(row, i)
            if i % step == 0:
                kept[i] = row
        out, i, j = [], 0, 0
        while i < n and j < m:
            stop = min(i // step * step + step, n)
            rows = {stop: kept[stop]}
            for k in range(stop - 1, i - 1, -1):
                rows[k] = above(rows[k + 1], k)
            while i < stop and j < m:
                gain = gains[p[i]][j]
                if gain and rows[i][j] == rows[i + 1][j + 1] + gain:
                    out.append((i, j))
                    i, j = i + 1, j + 1
                elif rows[i][j] == rows[i + 1][j]:
                    i += 1
                else:
                    j += 1
        return out

    def pairs(self, p: tuple, q: tuple) -> list[tuple[int, int]]:
        """Pairs of a best order-keeping match of two lists of trees."""
        low, high = self._ends(p, q)
        a, b = p[low : len(p) - high], q[low : len(q) - high]
        for c in dict.fromkeys(a):
            for d in dict.fromkeys(b):
                self.size(c, d)
        middle = [(low + i, low + j) for i, j in self._best(a, b)] if a and b else []
        return [*((k, k) for k in range(low)), *middle, *((len(p) - k, len(q) - k) for k in range(high, 0, -1))]

    def align(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Aligned nodes of two trees, numbered from the root down and from the first child on."""
        found = self.aligned.get((a, b))
        if found is None:
            at, to = [], []
            todo = [(a, b, 0, 0)]
            while todo:
                x, y, i, j = todo.pop()
                if self.label[x] != self.label[y]:
                    continue
                at.append(i)
                to.append(j)
                p, q = self.children[x], self.children[y]
                left, right = (list(accumulate((self.nodes[c] for c in z), initial=1)) for z in (p, q))
                todo += [(p[k], q[m], i + left[k], j + right[m]) for k, m in self.pairs(p, q)]
            found = self.aligned[a, b] = np.array(at, "i8"), np.array(to, "i8")
        return found


class Page:
    """A page's texts (`blocks`, in page order), which of them are marked as no article, and its nodes from the root down.

    Node 0 is the root. Of each node: tag, first and end (its blocks); a text is a node "#". Of each block: the outermost
    node that marks it (-1 for none), whether it lies in the article that tags tell of, and its linked characters.
    """

    __slots__ = ("blocks", "end", "first", "inside", "links", "marked", "parent", "shape", "tag")

    def __init__(self, source: str, shapes: Shapes):
        self.blocks, self.marked, self.inside, self.links = [], [], [], []
        self.tag, self.first, self.end, self.parent = [""], [0], [0], [-1]
        # of each open element: tag, its node, its children's shapes, the node that marks it, depth in an article, in its header
        stack = [("", 0, [], -1, 0, False)]
        buffer, links, anchor = [], 0, 0
        kinds = set()

        def flush():
            nonlocal links
            if buffer:
                raw = "".join(buffer)
                text = " ".join((entities.unescape(raw) if "&" in raw else raw).split())
                if text:
                    tag, node, children, mark, depth, header = stack[-1]
                    children.append(shapes.add("#", ()))
                    k = len(self.blocks)
                    self.tag.append("#"), self.parent.append(node), self.first.append(k), self.end.append(k + 1)
                    self.blocks.append(text)
                    self.marked.append(mark if mark >= 0 or not header or tag in HEADING else node)
                    self.inside.append(depth)
                    self.links.append(min(links, len(text)))
                buffer.clear()
            links = 0

        def close(n):
            flush()
            while len(stack) > n:
                tag, node, children, *_ = stack.pop()
                self.end[node] = len(self.blocks)
                shape = shapes.add(tag, tuple(children))
                if stack:
                    stack[-1][2].append(shape)
            return shape

        def text(piece):
            nonlocal links
            buffer.append(piece)
            if anchor:
                links += len(piece)

        at, last, absent = 0, source.rfind(">"), set()
        while (i := source.find("<", at)) >= 0:
            if i > at:
                text(source[at:i])
            if source.startswith("<!--", i):
                j = source.find("-->", i + 4)
                at = len(source) if j < 0 else j + 3
                continue
            if i > last and _CUT.match(source, i):  # cut off in a tag
                at = len(source)
                break
            m = _TAG.match(source, i) if i <= last else None
            if m is None:
                m = _OTHER.match(source, i) if i <= last else None
                if m is None:
                    text("<")
                at = m.end() if m else i + 1
                continue
            at, tag = m.end(), m[2].lower()
            if tag in RAW and not m[1] and tag not in absent:
                if found := RAW[tag].search(source, at):
                    at = found.end()
                    continue
                absent.add(tag)
            if tag in INLINE:
                if tag == "a":
                    anchor = 0 if m[1] else 1
                continue
            if tag == "br":
                buffer.append(" ")
                continue
            if m[1]:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == tag:
                        close(k)
                        break
                else:
                    flush()
                continue
            flush()
            if stack[-1][0] == "p":
                close(len(stack) - 1)
            if tag in CLOSED_BY:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] in STOPS[tag]:
                        break
                    if stack[k][0] in CLOSED_BY[tag]:
                        close(k)
                        break
            if stack[-1][0] == "head" and tag not in VOID and tag != "title":
                close(len(stack) - 1)
            if tag in VOID:
                continue
            _, parent, _, mark, depth, header = stack[-1]
            node = len(self.tag)
            attributes, names, dropped = m[3], (), mark >= 0
            if attributes and len(attributes) > 3:
                classes = [_PARTS(c) for x, y, z in _MARKED.findall(attributes) for c in (x or y or z).lower().split()]
                names = [n for c in classes for n in c]
                if not dropped and (_HIDDEN.search(attributes) or tag not in ("html", "body", "article", "main") and any(LAYOUT.isdisjoint(c) and not MARKS.isdisjoint(c) for c in classes)):
                    dropped = True
            dropped = dropped or tag in DROPPED or tag == "header" and not depth
            if not dropped:
                if tag == "article":
                    depth, _ = 2, kinds.add(2)
                elif tag == "main" or "main" in names:
                    depth, _ = max(depth, 1), kinds.add(1)
            self.tag.append(tag), self.parent.append(parent), self.first.append(len(self.blocks)), self.end.append(0)
            stack.append((tag, node, [], mark if mark >= 0 else node if dropped else -1, depth, header or tag == "header" and bool(depth)))
            anchor = 0
        if at < len(source):
            text(source[at:])
        self.shape = close(0)
        need = max(kinds, default=0)
        self.inside = [d >= need for d in self.inside] if need else [2 * n <= len(t) for n, t in zip(self.links, self.blocks, strict=True)]

    def plain(self) -> list[bool]:
        """Which blocks are the article by the page's own marks alone."""
        return [x and m < 0 for x, m in zip(self.inside, self.marked, strict=True)]

    def copies(self, there: set[str]) -> bool:
        """Whether COPY of what this page may be about is among the texts of another."""
        own = [t for t, x in zip(self.blocks, self.plain(), strict=True) if x]
        return sum(len(t) for t in own if t in there) >= COPY * sum(map(len, own))

    def text(self, keep: list[bool] | None = None) -> str:
        return "\n".join(t for t, x in zip(self.blocks, self.plain() if keep is None else keep, strict=True) if x)


def _sums(values) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(np.array(values, "i8"))])


class Wrapper:
    """The seed of a layout, and what is known of its nodes: pages that have it, repeat its text, and its varying, linked and whole text."""

    COUNTS = ("n", "same", "varying", "linked", "whole")

    def __init__(self, source: str, shapes: Shapes):
        self.seed = Page(source, shapes)
        self.texts = set(self.seed.blocks)
        self.first, self.end = np.array(self.seed.first), np.array(self.seed.end)
        self.pages, self.counts = 0, np.zeros((len(self.COUNTS), len(self.seed.tag)), "i8")

    def _equal(self, page: Page, at: np.ndarray, to: np.ndarray) -> np.ndarray:
        """Whether each aligned node of the page has the seed node's texts, in aligned places."""
        leaf = [(page.first[i], self.seed.first[j]) for i, j in zip(at.tolist(), to.tolist(), strict=True) if page.tag[i] == "#"]
        same = np.zeros(len(page.blocks), "i8")
        for k, m in leaf:
            same[k] = page.blocks[k] == self.seed.blocks[m]
        upto, first, end = _sums(same), np.array(page.first)[at], np.array(page.end)[at]
        n = end - first
        return (n > 0) & (upto[end] - upto[first] == n) & (self.end[to] - self.first[to] == n)

    def add(self, page: Page, shapes: Shapes) -> None:
        """Count a page, unless its article is the seed's."""
        if page.copies(self.texts):
            return
        at, to = shapes.align(page.shape, self.seed.shape)
        first, end = np.array(page.first)[at], np.array(page.end)[at]
        own = [0 if t in self.texts else len(t) - n for t, n in zip(page.blocks, page.links, strict=True)]
        self.pages += 1
        self.counts[0, to] += 1
        self.counts[1, to] += self._equal(page, at, to)
        for row, values in enumerate((own, page.links, list(map(len, page.blocks))), 2):
            upto = _sums(values)
            self.counts[row, to] += upto[end] - upto[first]

    def decide(self) -> tuple[int, list[int], list[int], list[int]]:
        """(slot, further nodes that belong to it, template nodes, menus); no slot (-1) where the pages do not tell."""
        n, same, varying, linked, whole = self.counts
        tag, parent = self.seed.tag, self.seed.parent
        children = [[] for _ in tag]
        for j in range(1, len(tag)):
            children[parent[j]].append(j)
        template = [j for j in range(len(tag)) if n[j] >= max(LEAST, TEMPLATE_PAGES * self.pages) and same[j] >= SHARE * n[j]]
        menus = [j for j in range(1, len(tag)) if n[j] >= max(LEAST, SLOT_PAGES * self.pages) and tag[j] not in TEXTUAL - {"ul", "ol", "dl"} and linked[j] >= LINKED * max(whole[j], 1)]
        fixed, slot, more = {*template, *menus}, 0, []
        if self.pages < LEAST or not varying[0]:
            return -1, [], [], []

        def inner(j):
            end = next((k for k in range(j + 1, len(tag)) if parent[k] < j), len(tag))
            return range(j, end)

        def contains(j, *kinds):
            return any(tag[k] in kinds for k in inner(j))

        while True:
            steps = [j for j in children[slot] if tag[j] not in TEXTUAL and j not in fixed and any(tag[k] != "#" for k in children[j])]
            best = max(steps, key=lambda j: varying[j], default=None)
            if best is None or varying[best] < MOST * varying[slot] or n[best] < SLOT_PAGES * self.pages:
                break
            for j in children[slot]:
                if j >= best:
                    break
                if j in fixed or n[j] < SLOT_PAGES * self.pages:
                    continue
                if tag[j] in HEADING:
                    more.append(j)
                elif tag[j] not in TEXTUAL and tag[j] not in DROPPED:
                    if contains(j, "p") and varying[j] >= LEAD * varying[best] and 2 * linked[j] < whole[j]:
                        more.append(j)
                    else:
                        more += [k for k in inner(j) if tag[k] == "h1" and k not in fixed]
            slot = best
        return slot, more, template, menus

    def extract(self, page: Page, shapes: Shapes, slot: int, more: list[int], template: list[int], menus: list[int]) -> str:
        """The page's article: texts of the node aligned with the slot, or what the page's marks tell where there is none."""
        at, to = shapes.align(page.shape, self.seed.shape) if slot >= 0 else ((), ())
        node = dict(zip(to, at, strict=True)) if slot >= 0 else {}
        if slot not in node:
            return page.text()
        keep = [False] * len(page.blocks)
        for j in [slot, *more]:
            i = node.get(j)
            if i is not None:
                for k in range(page.first[i], page.end[i]):
                    keep[k] = page.marked[k] <= i  # marks inside the node count, the node's own do not
        equal = dict(zip(to.tolist(), self._equal(page, at, to).tolist(), strict=True))
        for j in [j for j in template if equal.get(j)] + [j for j in menus if j in node]:
            for k in range(page.first[node[j]], page.end[node[j]]):
                keep[k] = False
        return page.text(keep)


class _Worker:
    """Shapes and parsed seeds of a task, forgotten together when they are many."""

    def __init__(self):
        self.shapes, self.wrappers = Shapes(), {}

    def wrapper(self, source: str) -> Wrapper:
        if source not in self.wrappers:
            self.wrappers[source] = Wrapper(source, self.shapes)
        return self.wrappers[source]

    def full(self) -> bool:
        return len(self.shapes.label) + len(self.shapes.sizes) + 20 * len(self.shapes.aligned) > SHAPES or len(self.wrappers) > HELD


_EVIDENCE = "host string, layout long, pages long, counts array<array<long>>"


def _evidence(batches):
    """Of each layout, over some of its pages: pages that are evidence, and the counts of its seed's nodes."""

    def out():
        rows = [(h, x, w.pages, w.counts.tolist()) for (h, x), w in held.items() if w.pages]
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.list_(pa.list_(pa.int64())))
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["host", "layout", "pages", "counts"])

    work, held = _Worker(), {}
    for b in chunks(batches, column="html"):
        for host, layout, source, seed in zip(*(b.column(c).to_pylist() for c in ("host", "layout", "html", "seed")), strict=True):
            if work.full() or len(held) > HELD:
                yield out()
                work, held = _Worker(), {}
            if (host, layout) not in held:
                held[host, layout] = Wrapper(seed or "", work.shapes)
            held[host, layout].add(Page(source or "", work.shapes), work.shapes)
    yield out()


_WRAPPERS = "host string, layout long, seed string, slot int, more array<int>, template array<int>, menus array<int>"


def _decided(batches):
    """Rows (host, layout, seed, pages, counts by node) -> wrappers."""
    for b in batches:
        rows = []
        for r in b.to_pylist():
            w = Wrapper(r["seed"] or "", Shapes())
            w.pages = r["pages"] or 0
            for c in r["counts"] or ():
                w.counts[:, c["node"]] = [c[k] for k in Wrapper.COUNTS]
            rows.append((r["host"], r["layout"], r["seed"], *w.decide()))
        kinds = (pa.string(), pa.int64(), pa.string(), pa.int32(), *[pa.list_(pa.int32())] * 3)
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["host", "layout", "seed", "slot", "more", "template", "menus"])


def _extracted(batches):
    work = _Worker()
    for b in chunks(batches, column="html"):
        texts = []
        for source, seed, slot, *lists in zip(*(b.column(c).to_pylist() for c in ("html", "seed", "slot", "more", "template", "menus")), strict=True):
            if work.full():
                work = _Worker()
            page = Page(source or "", work.shapes)
            texts.append(page.text() if slot is None or slot < 0 else work.wrapper(seed).extract(page, work.shapes, slot, *lists))
        yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])


def host_of(url: Column) -> Column:
    """Host of a URL in lower case, without user and port; '' if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def layout_of(source: Column) -> Column:
    """A number for the containers that a page uses: their tags and class names without digits, each once, in any order."""
    found = F.regexp_extract_all(F.lower(F.coalesce(source, F.lit(""))), F.lit(r"<(?:body|div|section|article|main|nav|aside|header|footer|form|table)(?=[\s>])[^>]*"), F.lit(0))
    named = F.transform(found, lambda x: F.concat(F.regexp_extract(x, r"^<([a-z]+)", 1), F.lit(" "), F.regexp_replace(F.regexp_extract(x, r"""\sclass\s*=\s*["']?([^"'>]*)""", 1), r"[^a-z ]+", "")))
    return F.xxhash64(F.array_join(F.array_sort(F.array_distinct(named)), ","))


def _with(pages: DataFrame, wrappers: DataFrame, small: bool) -> DataFrame:
    """Each page with its layout's row. Seeds are sent to all executors only if their measured size is small."""
    return pages.join(F.broadcast(wrappers) if small else wrappers, ["host", "layout"])


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, further columns) -> page_id, url, text, n_chars: one row for each row.

    Null and empty pages give an empty text. Pages without a usable URL share the host ''. Repeated pages and null ids
    stay; copies of the seed's article are no evidence. Malformed markup closes as browsers close it; nothing is cut off.
    Parsing takes time in proportion to a page's length, matching in proportion to the product of the different children
    of two nodes. Further columns are left out. An empty table gives an empty one.
    """
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), host_of(F.col("url")).alias("host"), layout_of(F.col("html")).alias("own"))
    blank = F.coalesce(~F.col("html").rlike(r">[^<>]*[^<>\s][^<>]*<|^[^<>]*[^<>\s]"), F.lit(True))  # a seed has texts, if any page has
    order = F.struct(blank, F.xxhash64("page_id"), F.xxhash64("html"))
    with text_settings(pages):
        own = stash(pages.groupBy("host", "own").agg(F.count("*").alias("n"), F.min_by("html", order).alias("seed"), F.min(blank).alias("blank")), "layouts")
        common = own.groupBy("host").agg(F.max_by("own", F.struct(~F.col("blank"), "n", "own")).alias("common"))
        layouts = own.join(common, "host").withColumn("layout", F.when(F.col("n") >= LAYOUT_PAGES, F.col("own")).otherwise(F.col("common")))
        named = stash(layouts.select("host", "own", "layout"), "named")
        seeds = stash(layouts.filter("own = layout").select("host", "layout", "seed"), "seeds")
        size = seeds.agg(F.sum(F.octet_length("seed") + 64)).first()[0] or 0
        small = size + 64 * named.count() <= SENT_BYTES
        pages = pages.join(F.broadcast(named) if small else named, ["host", "own"]).drop("own")
        seen = _with(pages.select("host", "layout", "html"), seeds, small).mapInArrow(trimmed(_evidence), _EVIDENCE)
        seen = stash(seen, "evidence")
        nodes = seen.select("host", "layout", F.posexplode(F.arrays_zip(*(F.col("counts")[i].alias(k) for i, k in enumerate(Wrapper.COUNTS)))).alias("node", "c"))
        nodes = nodes.groupBy("host", "layout", "node").agg(*(F.sum(f"c.{k}").alias(k) for k in Wrapper.COUNTS))
        nodes = nodes.groupBy("host", "layout").agg(F.collect_list(F.struct("node", *Wrapper.COUNTS)).alias("counts"))  # the nodes of one page
        counted = seeds.join(seen.groupBy("host", "layout").agg(F.sum("pages").alias("pages")), ["host", "layout"], "left").join(nodes, ["host", "layout"], "left")
        wrappers = stash(counted.mapInArrow(_decided, _WRAPPERS), "wrappers")
        return _with(pages, wrappers, small).select("page_id", "url", "html", "seed", "slot", "more", "template", "menus").mapInArrow(trimmed(_extracted), "page_id long, url string, text string, n_chars long")


def op5_html(spark, sf_dir: str) -> DataFrame:
    return extract(pick(spark.read.parquet(f"{sf_dir}/pages.parquet"), page_id="page_id", url="url", html="html"))
