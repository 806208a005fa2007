"""Main-text extraction by wrapper induction.

Pages of a host are parsed to trees of slots: like siblings share one. The trees of all the
host's distinct pages are aligned by simple tree matching into a template, each different tree once;
then pages and characters are counted at every slot, and texts at every node, over all distinct
pages. What is the same on nearly every page that has its node is the template's; the slots that hold
the varying running text are content, and the least element around them is the region. Each page is aligned
with its host's template: the region is read, with running text and first headings that stand
beside it; containers outside it (menus, adverts, footers, sidebars), link lists that recur on the
pages, and template text are not. Element and class names only break ties: a recurring container
whose text varies goes if it is named as furniture, and a host without pages to compare is judged
by names.
"""

from __future__ import annotations

import html
import json
import re
import sys
from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenfold.llm.common import drop_clashing, durable, join_hot, read, rows_of, with_columns

#: Elements that are never text of a page; of those, the ones that break blocks.
NEVER = frozenset("head script style noscript template iframe svg button select option textarea input canvas object embed audio video map label fieldset title dialog".split())
BREAKING = frozenset("head fieldset title dialog".split())
#: Elements whose tag says what FURNITURE says of names.
MARKED = frozenset("nav footer aside form menu header".split())
#: Elements of running text, which are no containers.
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption summary".split())
BLOCKS = TEXTUAL | frozenset("html body main article section div address hgroup details center".split()) | MARKED | NEVER
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe".split())
#: What an element's class, id or role says of menus, adverts, notices and reader comments.
FURNITURE = frozenset(
    "ad ads advert adverts advertisement advertising adsense adslot banner sponsor sponsored sponsors promo promotion cookie cookies consent gdpr notice notices notification alert popup modal overlay "
    "sidebar rail widget widgets related recommended recommendations nav navbar navigation menu breadcrumb breadcrumbs header masthead topbar footer copyright comment comments commentlist reply replies respond disqus "
    "share sharing social newsletter subscribe subscription signup login search pagination pager toolbar skip contentinfo complementary dialog".split()
)
#: Names of reader comments, which often stand in article elements of their own.
COMMENTS = frozenset("comment comments commentlist reply replies respond disqus".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

#: A comment or declaration, or a tag whose quoted values hold no angle bracket; a quote opens only after an equals sign. Any other tag is left to _tag_end.
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/<>]*+)((?:[^<>=]++|=\s*+"[^"<>]*+"|=\s*+'[^'<>]*+'|=(?!\s*+["'])\s*+(?:[^\s<>][^\s<>]*+)?)*+)>|<(?=/?[a-zA-Z])""", re.S)
_HEAD = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_STEP = re.compile(r""">|=\s*+(?:(["'])|[^\s>][^\s>]*+)?""")
_NAMED = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?=\s|=|/|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
NOTHING: frozenset = frozenset()
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


#: Marks of a template's slots: left out; read; around the region (own running text is read); around a first heading (own text is not).
OUT, IN, AROUND, THROUGH = 0, 1, 2, 3


class Link(str):
    """Text inside a link."""

    __slots__ = ()


class Node:
    """tag: element name; label: what two nodes must share to be aligned; items: texts, nodes and None (a block break); names: what its attributes say of furniture; holds: 2 a main element or first heading, 1 an article, in it or below; levels: of the whole tree, at its root."""

    __slots__ = ("tag", "label", "items", "names", "holds", "levels")

    def __init__(self, tag: str, label: str, names: frozenset):
        self.tag, self.label, self.names, self.items, self.holds, self.levels = tag, label, names, [], 0, 1


class Kept(dict):
    """A function's results by its arguments, emptied when there are too many; it travels to executors empty, with the function's code."""

    def __init__(self, function, most: int):
        self.function, self.most = function, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        found = self[key] = self.function(*key)
        return found

    def __reduce__(self):
        return Kept, (self.function, self.most)


def _tag_end(page: str, start: int, failed: set[int]) -> int:
    """Where the tag at start ends: at the first angle bracket outside quoted values, or the first of all if a quote is never closed; -1 if there is none.

    failed: places of opened quotes from which no end was found. No later tag follows them again, so a page is scanned in linear time.
    """
    at, opened = _HEAD.match(page, start).end(), []
    while m := _STEP.search(page, at):
        if m[0] == ">":
            return m.end()
        at = m.end()
        if m[1]:
            opened.append(m.start(1))
            at = page.find(m[1], at) + 1 if m.start(1) not in failed else 0
            if not at:
                break
    failed.update(opened)
    return page.find(">", start) + 1 or -1


def _names_of(attributes: str) -> tuple[str, frozenset]:
    """(class, id and role with digits taken out, what of them speaks of page furniture)."""
    if not attributes or attributes.isspace():
        return "", NOTHING
    found = sorted((k.lower(), v.strip("\"'")) for k, v in _NAMED.findall(attributes))
    names = {p.lower() for _, v in found for p in _PARTS.findall(v)} & FURNITURE if found else set()
    if _HIDDEN.search(attributes):
        names = {*names, "hidden"}
    return "".join(f"|{k}={re.sub(r'[0-9]+', '0', v)}" for k, v in found), frozenset(names) if names else NOTHING


_names = Kept(_names_of, 10_000)


def parse(page: str) -> Node:
    """The block-level tree of a page; inline elements dissolve into text, text of links is marked."""
    root = Node("#page", "#page", NOTHING)
    stack, at, link = [root], 0, 0  # link: the depth at which a link is open
    opened: Counter = Counter()

    def text(t: str) -> None:
        stack[-1].items.append(Link(t) if link else t)

    failed: set[int] = set()
    closed = page.rfind(">")
    while m := _TAG.search(page, at):
        end, closing, tag, attributes = m.end(), m[1], m[2], m[3]
        if tag is None and m[0] == "<":
            if m.start() > closed:
                break
            end = _tag_end(page, m.start(), failed)
            head = _HEAD.match(page, m.start())
            closing, tag, attributes = head[1], head[2], page[head.end() : end - 1]
        if m.start() > at:
            text(page[at : m.start()])
        at = end
        if tag is None:
            continue
        tag = tag.lower()
        if tag == "a":
            link = 0 if closing else len(stack)
            continue
        if closing:
            if opened[tag]:
                while (last := stack.pop().tag) != tag:
                    opened[last] -= 1
                opened[tag] -= 1
                if link > len(stack):
                    link = 0
            elif tag in BLOCKS:
                stack[-1].items.append(None)
            continue
        if tag in VOID:
            stack[-1].items.append(None if tag == "hr" else " " if tag == "br" else "")
            continue
        if tag not in BLOCKS:
            continue
        if stack[-1].tag == "p" and (tag not in NEVER or tag in BREAKING):
            opened[stack.pop().tag] -= 1
        if tag in CLOSES:
            while len(stack) > 1 and stack[-1].tag in CLOSES[tag]:
                opened[stack.pop().tag] -= 1
        label, names = _names[attributes,]
        node = Node(tag, tag + label, names)
        stack[-1].items.append(node)
        holds = 2 if tag in ("main", "h1") else 1 if tag == "article" and not names & COMMENTS else 0
        if holds:
            node.holds = holds
            for above in reversed(stack):
                if above.holds >= holds:
                    break
                above.holds = holds
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        stack.append(node)
        opened[tag] += 1
        root.levels = max(root.levels, len(stack))
    if at < len(page) and not page.startswith("<", at):
        rest = page[at:]
        cut = re.search(r"<[a-zA-Z/!]", rest)
        text(rest[: cut.start()] if cut else rest)
    return root


def digest(text: str) -> int:
    """64 bits, signed, never 0."""
    return int.from_bytes(xxhash.xxh3_64_digest(text.encode("utf-8", "surrogatepass")), "big", signed=True) or 1


def _below(path: int, label: str) -> int:
    """The path of a node of this label under a node's path, as 64 bits."""
    return int.from_bytes(xxhash.xxh3_64_digest(label.encode("utf-8", "surrogatepass"), seed=path & (1 << 64) - 1), "big", signed=True) or 1


below = Kept(_below, 50_000)


def joined(part: list[str]) -> str:
    return " ".join(html.unescape("".join(part)).split())


def blocks(root: Node, keep=None) -> list[tuple[int, str, str, bool]]:
    """(path, element, text, whether mostly of links) of each block in page order. keep(node, above): the mark of a node whose parent has the mark `above`; see decide."""
    out: list[tuple[int, str, str, bool]] = []
    part: list[str] = []

    def close(path: int, tag: str, read) -> None:
        if part:
            if read != THROUGH:
                text = joined(part)
                if text:
                    out.append((path, tag, text, 2 * sum(len(x) for x in part if type(x) is Link) > len(text)))
            part.clear()

    first = keep(root, IN) if keep else IN
    work = [(root, iter(root.items), below[0, root.label], first)]
    while work:
        own, items, path, read = work[-1]
        for x in items:
            if isinstance(x, str):
                part.append(x)
            elif x is None:
                close(path, own.tag, read)
            elif x.tag in NEVER and x.tag not in BREAKING:
                part.append(" ")
            else:
                close(path, own.tag, read)
                if x.tag not in NEVER and (then := keep(x, read) if keep else IN) != OUT:
                    work.append((x, iter(x.items), below[path, x.label], then))
                    break
        else:
            close(path, own.tag, read)
            work.pop()
    return out


def signature(found: list[tuple[int, str, str, bool]]) -> int:
    """What pages of the same running text share, whatever their menus and adverts say."""
    own = [t for _, tag, t, linked in found if tag in TEXTUAL and not linked]
    return digest("\n".join(own or [t for _, _, t, _ in found]))


class Slot:
    """Like siblings, on one page or on all pages of a template.

    texts: {digest: [pages that have it, length]}; link, length: characters of own text; varying,
    kinds: characters of own text that is not the template's, by pages, and its different texts; mark: see decide; known: the
    labels of a template with generalised ones, at its root.
    """

    __slots__ = ("label", "tag", "names", "holds", "nodes", "texts", "length", "link", "children", "pages", "varying", "kinds", "mark", "mixed", "known")

    def __init__(self, label: str, names: frozenset, holds: int):
        self.label, self.tag, self.names, self.holds = label, label.split("|", 1)[0], names, holds
        self.nodes, self.texts, self.length, self.link, self.children = [], {}, 0, 0, []
        self.pages, self.varying, self.kinds, self.mark, self.mixed, self.known = 1, 0, 0, IN, True, None


def _kind(node: Node):
    """What siblings share a slot: elements of running text of one label; containers of one label and like children."""
    return node.label if node.tag in TEXTUAL else (node.label, frozenset(x.label for x in node.items if isinstance(x, Node) and x.tag not in NEVER))


def slots(root: Node) -> Slot:
    """The page's slots. A node without text whose only child has its own label is that child."""

    def build(nodes: list[Node]) -> Slot:
        slot = Slot(nodes[0].label, nodes[0].names, max(n.holds for n in nodes))
        while True:
            slot.nodes += nodes
            groups: dict = {}
            for node in nodes:
                part: list[str] = []

                def close() -> None:
                    text = joined(part)
                    if text:
                        slot.texts[digest(text)] = [1, len(text)]
                        slot.length += len(text)
                        slot.link += min(len(text), sum(len(x) for x in part if type(x) is Link))
                    part.clear()

                for x in node.items:
                    if isinstance(x, str):
                        part.append(x)
                    elif x is not None and x.tag in NEVER and x.tag not in BREAKING:
                        part.append(" ")
                    else:
                        if part:
                            close()
                        if x is not None and x.tag not in NEVER:
                            groups.setdefault(_kind(x), []).append(x)
                if part:
                    close()
            if slot.length or len(groups) != 1 or (nodes := next(iter(groups.values())))[0].label != slot.label:
                break
        for own in groups.values():
            slot.children.append(build(own))
        return slot

    with Deep():
        return build([root])


class Deep:
    """Functions here call themselves once for each level of a tree, which may be deep."""

    def __enter__(self):
        self.before = sys.getrecursionlimit()
        sys.setrecursionlimit(max(self.before, LEVELS * 3))

    def __exit__(self, *_):
        sys.setrecursionlimit(self.before)


#: Trees of more levels are read whole, but for elements whose tag speaks of furniture, and take no part in templates.
LEVELS = 100_000


def ordered(root: Slot) -> list[tuple[Slot, int]]:
    """(slot, level) in page order."""
    out, work = [], [(root, 0)]
    while work:
        s, level = work.pop()
        out.append((s, level))
        work.extend((c, level + 1) for c in reversed(s.children))
    return out


def packed(slot: Slot, texts: bool = True) -> str:
    """A page's slots in page order, as JSON; without texts: what pages of one shape share."""
    out = [[level, s.label, sorted(s.names), s.holds, *([[[k, v[1]] for k, v in s.texts.items()], s.length, s.link] if texts else [[], 0, 0])] for s, level in ordered(slot)]
    return json.dumps(out, ensure_ascii=False, separators=(",", ":"))


def unpacked(text: str) -> Slot:
    above: list[Slot] = []
    for level, label, names, holds, texts, length, link in json.loads(text):
        s = Slot(label, frozenset(names), holds)
        s.texts, s.length, s.link = {k: [1, n] for k, n in texts}, length, link
        del above[level:]
        if above:
            above[-1].children.append(s)
        above.append(s)
    return above[0]


#: Most cells of a matrix of siblings; longer lists are matched by label and children, in order.
CELLS = 10_000


def matched(a: Slot, b: Slot, known: dict) -> int:
    """Simple tree matching: the most slots two trees share in order, root on root."""
    if a.label != b.label:
        return 0
    key = (id(a), id(b))
    if key not in known:
        total = 1
        x, y = a.children, b.children
        if x and y:
            shared = {q.label for q in y}
            x = [p for p in x if p.label in shared]
            if len(x) * len(y) > CELLS:
                for p, q in _by_shape(x, y):
                    if p and q:
                        total += matched(p, q, known)
            else:
                above = [0] * (len(y) + 1)
                for p in x:
                    row = [0]
                    for j, q in enumerate(y):
                        w = above[j] + matched(p, q, known) if p.label == q.label else 0
                        row.append(max(row[j], above[j + 1], w))
                    above = row
                total += above[-1]
        known[key] = total
    return known[key]


def _by_shape(x: list[Slot], y: list[Slot]) -> list[tuple[Slot | None, Slot | None]]:
    """Long lists in order: like slots (label, then children's labels) by place; linear."""
    ready: dict = {}
    for q in y:
        ready.setdefault((q.label, frozenset(c.label for c in q.children)), []).append(q)
    loose: dict = {}
    for own in ready.values():
        own.reverse()
    first = [ready[k].pop() if ready.get(k := (p.label, frozenset(c.label for c in p.children))) else None for p in x]
    for own in ready.values():
        for q in own:
            loose.setdefault(q.label, []).append(q)
    out = [(p, q or (loose[p.label].pop() if loose.get(p.label) else None)) for p, q in zip(x, first, strict=True)]
    return out + [(None, q) for own in loose.values() for q in reversed(own)]


def aligned(x: list[Slot], y: list[Slot], known: dict) -> list[tuple[Slot | None, Slot | None]]:
    """The children of two matched slots in one order: pairs, and those that have no partner."""
    if [p.label for p in x] == [q.label for q in y]:
        return list(zip(x, y, strict=True))
    shared = {q.label for q in y}
    if sum(p.label in shared for p in x) * len(y) > CELLS:
        return _by_shape(x, y)
    best = [[0] * (len(y) + 1)]
    for p in x:
        above = best[-1]
        if p.label in shared:
            row = [0]
            for j, q in enumerate(y):
                row.append(max(above[j + 1], row[j], above[j] + matched(p, q, known)))
            above = row
        best.append(above)
    out, i, j = [], len(x), len(y)
    while i or j:
        w = matched(x[i - 1], y[j - 1], known) if i and j else 0
        if w and best[i][j] == best[i - 1][j - 1] + w:
            i, j = i - 1, j - 1
            out.append((x[i], y[j]))
        elif i and best[i][j] == best[i - 1][j]:
            i -= 1
            out.append((x[i], None))
        else:
            j -= 1
            out.append((None, y[j]))
    return out[::-1]


def add(template: Slot, page: Slot) -> None:
    """Takes one more page into a template that its root matches."""

    def join(a: Slot, b: Slot) -> None:
        a.pages += 1
        a.length += b.length
        a.link += b.link
        a.names |= b.names
        a.holds = max(a.holds, b.holds)
        for k, (_, n) in b.texts.items():
            a.texts.setdefault(k, [0, n])[0] += 1
        merged = []
        for p, q in aligned(a.children, b.children, known):
            if p and q:
                join(p, q)
            merged.append(p or q)
        a.children = merged

    known: dict = {}
    with Deep():
        join(template, page)


def places(template: Slot, page: Slot) -> list[int]:
    """For each slot of a page, in page order, the place of the template's slot it is aligned with.

    The template holds the page's slots, so all have partners, but for long lists matched by shape:
    what has none there is counted at the slot above, and its place is given as -1 - that place.
    """
    at = {id(s): i for i, (s, _) in enumerate(ordered(template))}
    found: dict[int, int] = {}
    known: dict = {}
    work: list[tuple[Slot | None, Slot, int]] = [(template, page, 0)]
    with Deep():
        while work:
            t, p, above = work.pop()
            if t is None:
                found[id(p)] = -1 - above
                work.extend((None, c, above) for c in p.children)
                continue
            found[id(p)] = own = at[id(t)]
            work.extend((a, b, own) for a, b in aligned(t.children, p.children, known) if b)
    return [found[id(s)] for s, _ in ordered(page)]


#: On hosts with more distinct pages than this, an element whose label is on fewer than one in so many of them is aligned by tag and furniture names alone: names of one page's own (its tags, its title) match no other page.
RARE = 1000


def generalise(root: Slot, known) -> None:
    """Slots whose label is not known get their element's general label."""
    for s, _ in ordered(root):
        if s.label not in known:
            s.label = f"{s.tag}|*{' '.join(sorted(s.names))}"


#: A text on SAME of the pages that have its node is the template's, if LEAST pages, or all of a host with fewer, and two at least, have the node.
LEAST, SAME = 8, 0.9
#: Fewest pages whose text masses tell a region; a slot of running text with MAJOR of the varying text, and a container with LOOSE of it in its own text, is content; a container or list is of links from LINKED of its text on, and recurs if it is on OFTEN of the pages that have its parent.
COMPARED, MAJOR, LOOSE, LINKED, OFTEN = 3, 0.1, 0.3, 0.8, 0.5
#: Containers named as furniture go, unless one holds this many times the varying text that would be left.
TAKEN = 4.0


def named(s: Slot | Node) -> bool:
    """Whether tag or names speak of furniture. A form, header or named container around an article, main element or first heading does not count; comments and headers do unless they hold the main element or a first heading."""
    if s.tag in TEXTUAL or s.tag in ("html", "body", "#page", "main"):
        return False
    if s.tag == "header" or s.names & COMMENTS:
        return s.holds < 2
    if s.names or s.tag == "form":
        return not s.holds
    return s.tag in MARKED


def induce(pages: list[Slot], constant: set[int] | None = None, names: bool = True) -> dict:
    """What decide makes of these pages of a host, aligned. constant: digests of the template's texts, if counted over more pages than these."""
    root = pages[0]
    for p in pages[1:]:
        add(root, p)
    every, fixed = [s for s, _ in ordered(root)], set(constant or ())
    for s in every:
        if constant is None and s.pages >= max(2, min(LEAST, root.pages)):
            fixed |= {t for t, (n, _) in s.texts.items() if n >= SAME * s.pages}
    for s in every:
        s.varying = sum(n * size for t, (n, size) in s.texts.items() if t not in fixed)
        s.kinds = sum(t not in fixed for t in s.texts)
    return decide(root, names)


def decide(root: Slot, names: bool = True) -> dict:
    """{"slots": [[level, label, mark, whether marks below differ]]} of the slots of a host's pages, in page order, by what was counted at them.

    names: whether tags and names may break ties.
    """
    every: list[tuple[Slot, Slot | None]] = []  # with its parent, parents first
    work: list[tuple[Slot, Slot | None]] = [(root, None)]
    while work:
        s, parent = work.pop()
        every.append((s, parent))
        work.extend((c, s) for c in reversed(s.children))
    up = {id(s): parent for s, parent in every}
    inside: set[int] = set()  # in an article or main element
    gone: set[int] = set()
    for s, parent in every:
        if parent is not None and (id(parent) in inside or (parent.tag in ("article", "main") and not parent.names & COMMENTS)):
            inside.add(id(s))

    def furniture(kept: set[int]) -> list[Slot]:
        """The containers that tag or names take out, each with all below it; they and what is below them are put into gone."""
        heads = []
        gone.clear()
        for s, parent in every:
            if parent is None or not names:
                continue
            free = id(s) not in inside or s.tag in MARKED or bool(s.names & COMMENTS)
            alone, recurs = root.pages < 2 and free, s.pages >= 2 and (free or s.pages >= OFTEN * parent.pages)
            if id(parent) in gone:
                gone.add(id(s))
            elif id(s) not in kept and named(s) and (alone or recurs):
                gone.add(id(s))
                heads.append(s)
        return heads

    def masses(with_links: bool) -> tuple[dict, dict]:
        own, whole = {}, {}
        for s, _ in reversed(every):
            own[id(s)] = 0.0 if id(s) in gone else s.varying * (1.0 if with_links or not s.length else 1 - s.link / s.length)
            whole[id(s)] = own[id(s)] + sum(whole[id(c)] for c in s.children)
        return own, whole

    def around(s: Slot) -> list[Slot]:
        out = []
        while s is not None:
            out.append(s)
            s = up[id(s)]
        return out[::-1]

    # A class or id name never takes the running text: a container that holds TAKEN times what all others leave stays.
    bulk, kept = masses(False)[1], set()
    while heads := furniture(kept):
        heaviest = max(heads, key=lambda s: bulk[id(s)] if s.tag not in MARKED else -1.0)
        if heaviest.tag in MARKED or bulk[id(heaviest)] <= TAKEN * (bulk[id(root)] - sum(bulk[id(s)] for s in heads)):
            break
        kept.add(id(heaviest))
    own, whole = masses(False)
    if not whole[id(root)]:
        own, whole = masses(True)
    total = whole[id(root)]
    region = root
    if total and root.pages >= COMPARED:
        major = [s for s, _ in every if own[id(s)] >= (MAJOR if s.tag in TEXTUAL else LOOSE) * total]
        if not major:  # spread over many: the heaviest, which hold half of it
            held = 0.0
            for s in sorted((s for s, _ in every), key=lambda s: -own[id(s)]):
                if 2 * held >= total:
                    break
                held += own[id(s)]
                major.append(s)
        lines = [around(s) for s in major]
        for level in zip(*lines):
            if any(s is not level[0] for s in level):
                break
            if level[0].tag not in TEXTUAL:
                region = level[0]
    if total and names:
        for tag in ("article", "main"):
            outer = [s for s in around(region) if s.tag == tag and not s.names & COMMENTS]
            inner = [s for s, _ in every if s.tag == tag and id(s) not in gone and whole[id(s)] >= 0.5 * total and any(a is region for a in around(s))]
            if outer or inner:
                region = outer[-1] if outer else max(inner, key=lambda s: whole[id(s)])
                break
    path = {id(s) for s in around(region)}
    links: dict[int, list[float]] = {}
    for s, _ in reversed(every):
        links[id(s)] = [s.link + sum(links[id(c)][0] for c in s.children), s.length + sum(links[id(c)][1] for c in s.children)]
    for s, parent in every:
        linked = links[id(s)][1] > 0 and links[id(s)][0] >= LINKED * links[id(s)][1]
        if id(s) in gone:
            s.mark = OUT
        elif s is region:
            s.mark = IN
        elif id(s) in path:
            s.mark = AROUND
        elif parent.mark == IN:
            menu = linked and s.tag not in ("p", "li", "dt", "dd", "td", "th", "tr", "caption") and s.pages >= max(2, LINKED * parent.pages)
            s.mark = OUT if menu and region.tag not in ("article", "main") and root.pages >= COMPARED and id(s) not in inside else IN
        elif parent.mark == AROUND:
            s.mark = IN if s.tag in TEXTUAL and not linked else OUT
        else:
            s.mark = OUT
    for s, _ in every:
        if s.tag == "h1" and s.mark == OUT and id(s) not in gone and s.pages and 2 * s.kinds >= s.pages:
            for a in around(s)[:-1]:
                a.mark = THROUGH if a.mark == OUT else a.mark
            s.mark = IN
    for s, _ in reversed(every):
        s.mixed = any(c.mixed or c.mark != s.mark for c in s.children)
    return {"slots": [[level, s.label, s.mark, s.mixed] for s, level in ordered(root)]}


def template_of(found: dict) -> Slot:
    """The slots of what decide returned."""
    above: list[Slot] = []
    for level, label, mark, mixed in found["slots"]:
        s = Slot(label, NOTHING, 0)
        s.mark, s.mixed = mark, mixed
        del above[level:]
        if above:
            above[-1].children.append(s)
        above.append(s)
    if any("|*" in label for _, label, *_ in found["slots"]):
        above[0].known = frozenset(label for _, label, *_ in found["slots"])
    return above[0]


def read_through(page: Slot, template: Slot) -> tuple[dict[int, int], bool]:
    """({id of node: mark}, whether the page has the region) of a page aligned with its host's template."""
    marks: dict[int, int] = {}
    known: dict = {}
    has = False
    work = [(template, page)]
    with Deep():
        while work:
            t, p = work.pop()
            has = has or t.mark == IN
            for node in p.nodes:
                marks[id(node)] = t.mark
            if t.mixed or t.mark in (AROUND, THROUGH):
                for a, b in aligned(t.children, p.children, known):
                    if a and b:
                        work.append((a, b))
                    elif b and t.mark != IN:
                        mark = IN if t.mark == AROUND and b.tag in TEXTUAL and 2 * b.link <= b.length else OUT
                        for node in b.nodes:
                            marks[id(node)] = mark
    return marks, has


def extract(page: str, template: Slot | dict | None, same: dict[int, set[int]] | None = None, names: bool = True) -> str:
    """The page's main text, read through its host's template; same: {path: constant texts}.

    A page without the template's region is judged alone, by names. template None: nothing is known of the
    host, and the whole page is read.
    """
    root = parse(page)
    if template is None:
        return "\n".join(t for _, _, t, _ in blocks(root))
    if isinstance(template, dict):
        template = template_of(template)
    if root.levels > LEVELS:
        marks = {id(root): IN}
    else:
        own = slots(root)
        if template.known:
            generalise(own, template.known)
        marks, has = read_through(own, template)
        if not has:
            marks, _ = read_through(slots(root), template_of(induce([slots(root)], set(), names)))

    def keep(node: Node, above):
        mark = marks.get(id(node), above)
        return OUT if mark == IN and names and node.tag in MARKED and named(node) else mark

    return "\n".join(t for p, _, t, _ in blocks(root, keep) if not (same and p in same and digest(t) in same[p]))


def alone(page: str) -> str:
    """The main text of a page whose host has no other: by its article or main element, else all but what is named as furniture."""
    return extract(page, induce([slots(parse(page))], set()))


def host_of(url):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#]*)", 1)), F.lit(""))


def scanned(pages: DataFrame, url: str = "url", page: str = "html") -> DataFrame:
    """One row for each distinct page of a host, and one with a tree for each shape of its pages; each page is parsed once.

    Of a page: signature; shape; nodes and texts, its (node, text) once each, each of its nodes with text
    0, and (0, 0); slots, own and sizes, the place in the shape, digest and length of each text of a
    slot; lengths and links, characters of each slot. Pages of the same running text count once. A page of
    more than LEVELS levels has no shape.
    """

    def seen(batches):
        sent: set[int] = set()
        for big in batches:
            for batch in rows_of(big, 64):
                rows = []
                for host, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    tree = parse(body or "")
                    found = blocks(tree)
                    pairs = sorted({(p, digest(t)) for p, _, t, _ in found} | {(p, 0) for p, _, _, _ in found} | {(0, 0)})
                    shape, own = None, []
                    if tree.levels <= LEVELS:
                        root = slots(tree)
                        own = [s for s, _ in ordered(root)]
                        form = packed(root, False)
                        shape = digest(f"{host} {form}")
                        if shape not in sent:
                            if len(sent) > 50_000:
                                sent.clear()
                            sent.add(shape)
                            rows.append((host, shape, form, shape, [], [], [], [], [], [], []))
                    texts = [(i, t, n) for i, s in enumerate(own) for t, (_, n) in s.texts.items()]
                    rows.append((host, signature(found), None, shape, *(list(c) for c in zip(*pairs, strict=True)), *([list(c) for c in zip(*texts, strict=True)] or [[], [], []]), [s.length for s in own], [s.link for s in own]))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=columns)

    columns = ["host", "signature", "tree", "shape", "nodes", "texts", "slots", "own", "sizes", "lengths", "links"]
    longs, ints = pa.list_(pa.int64()), pa.list_(pa.int32())
    kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), longs, longs, ints, longs, ints, ints, ints]
    schema = "host string, signature long, tree string, shape long, nodes array<long>, texts array<long>, slots array<int>, own array<long>, sizes array<int>, lengths array<int>, links array<int>"
    each = pages.select(host_of(F.col(url)).alias("host"), F.col(page).alias("page")).mapInArrow(seen, schema)
    one = each.groupBy("host", F.col("tree").isNull().alias("paged"), "signature").agg(F.min(F.struct("nodes", "texts", "tree", "shape", "slots", "own", "sizes", "lengths", "links")).alias("x"))
    return durable(one.select(F.xxhash64("host").alias("h"), "host", "paged", "signature", "x.*"))


def constants(seen: DataFrame) -> DataFrame:
    """(h, node, text): digests of the texts that are constant at a node (path) of a host (h, its hash), counted over all its distinct pages.

    A page counts once for each of its (node, text), once for each of its nodes (text 0) and once
    for its host (node 0). What stands on one page alone is dropped after the count.
    """
    flat = seen.where("paged").select("h", F.explode(F.arrays_zip("nodes", "texts")).alias("x")).select("h", F.col("x.nodes").alias("node"), F.col("x.texts").alias("text"))
    counts = durable(flat.groupBy("h", "node", "text").agg(F.count("*").alias("n")).where("n >= 2"))
    node = counts.where("text = 0 and node <> 0").select("h", "node", F.col("n").alias("pages"))
    host = counts.where("text = 0 and node = 0").select("h", F.col("n").alias("whole"))
    found = counts.where("text <> 0").join(node, ["h", "node"]).where(F.col("n") >= F.lit(SAME) * F.col("pages")).join(host, "h")
    return durable(found.where(F.col("pages") >= F.least(F.lit(LEAST), "whole")).select("h", "node", "text"))


#: Shapes that a task aligns at a time, and about the most characters of them; a host with more is aligned in parts, and those in turn.
FOLD, FOLD_CHARS = 512, 32_000_000


def shapes_of(seen: DataFrame) -> DataFrame:
    """(h, host, shape, tree, n, first, part): the shapes of distinct pages, how many pages have each, the smallest signature of those, and the part of the host it is aligned in.

    Labels are counted over all distinct pages, and rare ones are general in the trees.
    """

    def labels(batches):
        for batch in batches:
            rows = [(h, label, n) for h, tree, n in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True) for label in {x[1] for x in json.loads(tree)}]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [(), (), ()], (pa.int64(), pa.string(), pa.int64()), strict=True)], names=["h", "label", "n"])

    def general(left, right):
        if len(right) and len(left):
            common = set(right["label"])
            trees = [unpacked(t) for t in left["tree"]]
            for t in trees:
                generalise(t, common)
            left = left.assign(tree=[packed(t, False) for t in trees])
        return left

    counts = seen.where("paged and shape is not null").groupBy("shape").agg(F.count("*").alias("n"), F.min("signature").alias("first"))
    rows = durable(dealt(seen.where("not paged").select("h", "host", "shape", "tree").join(counts, "shape").withColumn("part", F.col("shape"))))
    large = rows.groupBy("h").agg(F.sum("n").alias("pages")).where(F.col("pages") > RARE)
    common = rows.join(large, "h", "left_semi").select("h", "tree", "n").mapInArrow(labels, "h long, label string, n long").groupBy("h", "label").agg(F.sum("n").alias("n"))
    common = common.join(large, "h").where(F.col("n") * RARE >= F.col("pages")).join(rows.select("h", "part").distinct(), "h").select(F.col("h").alias("own_h"), F.col("part").alias("own_part"), "label")
    return durable(rows.groupBy("h", "part").cogroup(common.groupBy("own_h", "own_part")).applyInPandas(general, rows.schema))


def dealt(rows: DataFrame) -> DataFrame:
    """rows with part brought down to 0 for hosts that one task can align, and for others to as many parts as it takes, fewer than they have rows."""
    size = F.greatest(F.col("n") / F.lit(FOLD), F.col("chars") / F.lit(FOLD_CHARS))
    sums = rows.groupBy("h").agg(F.count("*").alias("n"), F.sum(F.length("tree")).alias("chars"))
    many = sums.where((F.col("n") > 1) & (size > 1)).select("h", F.least(F.ceil(size), F.ceil(F.col("n") / 2)).cast("long").alias("parts"))
    return rows.join(F.broadcast(many), "h", "left").withColumn("part", F.pmod(F.col("part"), F.coalesce("parts", F.lit(1)))).drop("parts")


def aligned_shapes(shapes: DataFrame) -> DataFrame:
    """(h, host, tree) of every host: all its shapes, aligned in the order of their smallest signatures within a part, then part by part."""

    def fold(pdf):
        pdf = pdf.sort_values(["first", "part"])
        trees = iter(pdf["tree"])
        root = unpacked(next(trees))
        for t in trees:
            add(root, unpacked(t))
        return pdf.iloc[:1][["h", "host", "first", "part"]].assign(tree=packed(root, False))

    made = shapes.select("h", "host", "first", "part", "tree")
    while True:
        made = durable(made.groupBy("h", "part").applyInPandas(fold, "h long, host string, first long, part long, tree string"))
        if made.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
            return made.select("h", "host", "tree")
        made = dealt(made)


def counted(seen: DataFrame, shapes: DataFrame, made: DataFrame, fixed: DataFrame) -> DataFrame:
    """(h, slots): what decide needs of every slot of a host's template, counted over all its distinct pages."""

    def lay(left, right):
        template = unpacked(right["tree"].iloc[0])
        return left[["shape", "n"]].assign(places=[places(template, unpacked(t)) for t in left["tree"]])

    own = made.join(shapes.select("h", "part").distinct(), "h").select(F.col("h").alias("own_h"), F.col("part").alias("own_part"), "tree")
    laid = durable(shapes.select("h", "part", "shape", "n", "tree").groupBy("h", "part").cogroup(own.groupBy("own_h", "own_part")).applyInPandas(lay, "shape long, n long, places array<int>"))
    paged = seen.where("paged and shape is not null").select("h", "shape", "slots", "own", "sizes", "lengths", "links")
    total = shapes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    met = join_hot(paged, laid, "shape", total)
    place = lambda p: F.when(p < 0, -1 - p).otherwise(p)
    flat = met.select("h", F.explode(F.arrays_zip("places", "lengths", "links")).alias("x")).select("h", "x.*")
    sums = flat.groupBy("h", place(F.col("places")).alias("slot")).agg(F.sum((F.col("places") >= 0).cast("long")).alias("pages"), F.sum(F.col("lengths").cast("long")).alias("length"), F.sum(F.col("links").cast("long")).alias("link"))
    flat = met.select("h", F.explode(F.arrays_zip(F.transform("slots", lambda i: F.get("places", i)).alias("places"), "own", "sizes")).alias("x")).select("h", "x.*")
    texts = flat.groupBy("h", place(F.col("places")).alias("slot"), F.col("own").alias("text")).agg(F.sum(F.col("sizes").cast("long")).alias("size"))
    varying = texts.join(fixed.select("h", "text").distinct(), ["h", "text"], "left_anti").groupBy("h", "slot").agg(F.sum("size").alias("varying"), F.count("*").alias("kinds"))
    both = sums.join(varying, ["h", "slot"], "left").fillna(0, ["varying", "kinds"])
    return both.groupBy("h").agg(F.collect_list(F.struct("slot", "pages", "length", "link", "varying", "kinds")).alias("slots"))


def templates(pages: DataFrame, url: str = "url", page: str = "html", names: bool = True) -> DataFrame:
    """(host, template) of every host: the slots of all its distinct pages, judged by what was counted at them over all of those."""
    seen = scanned(pages, url, page)
    fixed = constants(seen)
    shapes = shapes_of(seen)
    made = aligned_shapes(shapes)

    def fit(pdf, fixed):
        if not len(pdf):
            return pdf.assign(template="")[["host", "template"]]
        root = unpacked(pdf["tree"].iloc[0])
        every = [s for s, _ in ordered(root)]
        for s in every:
            s.pages = 0
        for x in pdf["slots"].iloc[0]:
            s = every[x["slot"]]
            s.pages, s.length, s.link, s.varying, s.kinds = (x[k] for k in ("pages", "length", "link", "varying", "kinds"))
        same: dict[int, list[int]] = {}
        for node, text in sorted(zip(fixed["node"].tolist(), fixed["text"].tolist(), strict=True)):
            same.setdefault(node, []).append(text)
        return pdf[["host"]].assign(template=json.dumps({**decide(root, names), "same": same}, ensure_ascii=False, separators=(",", ":")))

    whole = made.join(counted(seen, shapes, made, fixed), "h")
    return whole.groupBy("h").cogroup(fixed.groupBy("h")).applyInPandas(fit, "host string, template string")


#: Beyond the bound of the broadcast, a host is dealt in as many parts as it has this share of the pages.
PARTS = 10_000


def made_of(found: str | None) -> tuple[Slot, dict[int, set[int]]]:
    """Template and constant texts of a row of templates; an empty one reads whole pages."""
    made = json.loads(found) if found else {"slots": [[0, "#page", IN, False]], "same": {}}
    return template_of(made), {int(p): set(own) for p, own in made["same"].items()}


def beside_templates(pages: DataFrame, found: DataFrame, host: str, template: str) -> DataFrame:
    """The pages with a null column template, and before those of each host's part in a partition one row with its template.

    A host with more than a PARTS-th of the pages is dealt in as many parts as it has such shares, by a hash
    of the whole row; there are fewer than PARTS such hosts, so their names can be broadcast. A template
    is sent once for each part, never with every page, and nothing of unknown size is broadcast.
    """
    counts = durable(pages.groupBy(host).agg(F.count("*").alias("n")))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    parts = F.ceil(F.col("n") * F.lit(PARTS) / F.lit(max(total, 1))).cast("int").alias("_lumenfold_parts")
    hot = counts.select(host, parts).where("_lumenfold_parts > 1")
    hashed = [F.col(f"`{f.name}`") for f in pages.schema.fields if "map<" not in f.dataType.simpleString() and f.dataType.simpleString() != "variant"]
    spread = pages.join(F.broadcast(hot), host, "left").withColumn("_lumenfold_part", F.pmod(F.xxhash64(*hashed), F.coalesce("_lumenfold_parts", F.lit(1))).cast("int"))
    spread = spread.select(*[F.col(f"`{c}`") for c in pages.columns], "_lumenfold_part", F.lit(None).cast("string").alias(template))
    every = counts.select(host, parts).join(found.withColumnRenamed("host", host), host, "left").withColumn("_lumenfold_part", F.explode(F.sequence(F.lit(0), F.col("_lumenfold_parts") - 1)))
    empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in pages.schema.fields if f.name != host]
    heads = every.select(*empty, host, "_lumenfold_part", F.coalesce("template", F.lit("")).alias(template))
    both = spread.unionByName(heads).repartition(host, "_lumenfold_part")
    return both.sortWithinPartitions(host, "_lumenfold_part", F.col(template).isNull()).drop("_lumenfold_part")


def extract_pages(pages: DataFrame, url: str = "url", page: str = "html", text: str = "text", broadcast_chars: int = 8_000_000, names: bool = True) -> DataFrame:
    """pages with the main text of every row's whole html as column text; columns of that name are replaced, others pass through.

    Null or empty html, and a page without an article, give the empty string. Rows without a host
    share one template. Repeated pages are read alike and count once in their host's template. The
    templates travel with the tasks while they have at most broadcast_chars characters in all;
    beyond that pages are shuffled by host, hot hosts in parts, each behind one row with its template.
    Very long pages are read whole. An empty table gives no rows.
    """
    found = durable(templates(pages, url, page, names=names))
    size = found.agg(F.coalesce(F.sum(F.length("template")), F.lit(0))).first()[0]
    pages = drop_clashing(pages, [text])
    schema = T.StructType([*pages.schema.fields, T.StructField(text, T.StringType())])
    host, template, at = "_lumenfold_host", "_lumenfold_template", pages.columns.index(page)
    keyed = pages.withColumn(host, host_of(F.col(url)))

    def known(batches):
        ready: dict[str, tuple] = {}
        for big in batches:
            for batch in rows_of(big, 64):
                out = []
                for key, body in zip(batch.column(batch.num_columns - 1).to_pylist(), batch.column(at).to_pylist(), strict=True):
                    if key not in ready:
                        if len(ready) > 500:
                            ready.clear()
                        ready[key] = made_of(shared.get(key))
                    out.append(extract(body, *ready[key], names) if body else "")
                yield with_columns(batch.select(list(range(batch.num_columns - 1))), {text: pa.array(out, pa.string())})

    def behind(batches):
        ready = None
        for big in batches:
            for batch in rows_of(big, 64):
                out, rows = [], []
                for i, (head, body) in enumerate(zip(batch.column(batch.num_columns - 1).to_pylist(), batch.column(at).to_pylist(), strict=True)):
                    if head is not None:
                        ready = made_of(head)
                        continue
                    rows.append(i)
                    out.append(extract(body, *ready, names) if body else "")
                yield with_columns(batch.select(list(range(batch.num_columns - 2))).take(pa.array(rows, pa.int64())), {text: pa.array(out, pa.string())})

    if size <= broadcast_chars:
        shared = {r["host"]: r["template"] for r in found.collect()}
        return keyed.mapInArrow(known, schema)
    return beside_templates(keyed, found, host, template).mapInArrow(behind, schema)


def op2_html_extraction(spark, sf_dir):
    pages = read(spark, sf_dir, "pages").select("page_id", "url", "html")
    out = extract_pages(pages)
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
