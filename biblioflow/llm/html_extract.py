"""Main text of web pages by wrappers: union-free expressions inferred from the token streams of a host's pages."""

from __future__ import annotations

import html as entities
import json
import re
from bisect import bisect_left
from collections.abc import Iterator, Sequence
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import quoted, table
from .url_filter import host_of

# Fixed lists of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - {"body", "head", "html", "td", "th", "tr", "tbody", "thead", "tfoot"}
SAME = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option"}
#: Elements and class or id words that hold no part of an article.
NOT_MAIN = frozenset("aside button canvas dialog footer form head iframe menu nav noembed noframes noscript object option script select style svg template textarea title xmp".split())
NOT_MAIN_WORDS = frozenset("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist cookie cookies disclaimer disqus footer header menu modal nav navbar navigation newsletter notice notices notification pagination pager popup promo promoted recommended related replies responses share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget".split())
#: Words that add nothing to those in a class or id ("comment-list", "share-buttons").
NEUTRAL_WORDS = frozenset("area bar box buttons form links list posts".split())
#: Elements that class and id words are not applied to, and those that hold an article by their tag.
NO_WORDS, ARTICLE = frozenset("html body article main p h1 h2 h3 h4 h5 h6".split()), frozenset("article main".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote ul ol li table".split())
MAIN_WORDS = frozenset("article content entry main maincontent post story".split())
ROLES = {"banner": False, "navigation": False, "complementary": False, "contentinfo": False, "search": False, "form": False, "main": True, "article": True}

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</?([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
#: Different pages that must agree on a text for it to count as a part of the template: for the choice of the main element, and to be left out of it.
AGREE, LEAVE_OUT = 2, 3


def _key(tag: str, attributes: str) -> str:
    """An element's name in a wrapper: its tag and the words of class, id and role that matter, sorted. The word `!` says that a whole class or id consists of
    NOT_MAIN_WORDS, `?` that only a part of one does."""
    if not attributes or attributes == "/":
        return tag
    words = set()
    for m in ATTRIBUTE.finditer(attributes):
        kind, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if kind == "role" and value in ROLES:
            words.add("=" + value)
        elif kind == "hidden":
            words.add("=hidden")
        elif kind in ("class", "id"):
            for name in value.split():
                own = {w for w in re.split(r"[^a-z0-9]+", name) if w and not w.isdigit()}
                words |= own
                if not NOT_MAIN_WORDS.isdisjoint(own):
                    words.add("!" if own <= NOT_MAIN_WORDS | NEUTRAL_WORDS else "?")
    return ".".join([tag, *sorted(words)])


def _bad(key: str) -> bool:
    """Whether tag, role or hidden rule an element out, whatever it holds. Forms are judged like names: some sites wrap whole pages in one."""
    tag, *words = key.split(".")
    return any(w[:1] == "=" and not ROLES.get(w[1:], False) for w in words) or tag in NOT_MAIN and tag != "form"


def _rejected(key: str, text: int, linked: int, holds: bool, everything: int, named: bool) -> bool:
    """Whether an element is left out, given its characters outside and inside links, whether it holds an article, and the page's characters outside links.

    A name that only in part speaks against the element needs text that is mostly links. No name counts against what holds an article, or
    (outside of an element named as the article, `named`) most of the text.
    """
    if _bad(key):
        return True
    tag, *words = key.split(".")
    whole = tag == "form" or "!" in words
    if tag in NO_WORDS or not whole and "?" not in words or holds or not named and 2 * text > everything:
        return False
    return whole or linked > text


def _holder(key: str) -> bool:
    """An element that is an article, and not one comment of many."""
    tag, *words = key.split(".")
    return (tag in ARTICLE or "=main" in words or "=article" in words) and "!" not in words and "?" not in words


def _good(key: str) -> bool:
    tag, *words = key.split(".")
    return tag in ("article", "main") or "=main" in words or "=article" in words or tag in ("div", "section") and not MAIN_WORDS.isdisjoint(words)


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, key, text): `<` opens an element, `>` closes it, `#` is a run of text, `|` an inline break. Contents of raw elements are left out, ends that
    HTML implies are made explicit, and ends without a start are dropped, so the stream nests."""
    stack: list[str] = []
    at, n = 0, len(page)
    while at < n:
        m = TOKEN.search(page, at)
        text = page[at : m.start() if m else n]
        if text:
            yield "#", "", text
        if not m:
            break
        at = m.end()
        tag = m[1]
        if tag is None:
            continue
        tag = tag.lower()
        if m[0][1] == "/":
            if tag in stack:
                while stack:
                    top = stack.pop()
                    yield ">", top, ""
                    if top == tag:
                        break
            elif tag in ("p", "br"):
                yield "|", tag, ""
            continue
        if tag in VOID:
            yield "|", tag, ""
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else n
            continue
        ends = SAME.get(tag, "").split()
        if ends or tag in CLOSES_P:
            scope = len(stack)
            while scope and stack[scope - 1] not in ("table", "ul", "ol", "dl", "button", "article", "section", "div", "body", "blockquote") and not (stack[scope - 1] == "p" and tag in CLOSES_P) and stack[scope - 1] not in ends:
                scope -= 1
            if scope and (stack[scope - 1] in ends or stack[scope - 1] == "p" and tag in CLOSES_P):
                while len(stack) >= scope:
                    yield ">", stack.pop(), ""
        stack.append(tag)
        yield "<", _key(tag, m[2]), ""
        if m[2].endswith("/") and tag in ("svg", "path", "circle", "use"):
            stack.pop()
            yield ">", tag, ""
    while stack:
        yield ">", stack.pop(), ""


def blocks(stream: list[tuple[str, str, str]], out: set[int] = frozenset()) -> Iterator[tuple[int, list[str], str, int, int]]:
    """Blocks of text of a token stream: place of the first token, keys from the root to the block element around it (a list that changes as the walk goes
    on), the text with white space as single spaces, and its characters outside and inside links. Elements at the places `out` are left out."""
    path: list[str] = []
    ends: list[int] = [0]  # lengths of path at open block elements
    now: list[str] = []
    first = links = skip = text = linked = 0

    def close():
        nonlocal now, text, linked
        whole = " ".join("".join(now).split()) if now else ""
        whole = " ".join(re.split(r"\s+", entities.unescape(whole))).strip() if "&" in whole else whole
        got = (first, path[: ends[-1]], whole, text, linked) if whole else None
        now, text, linked = [], 0, 0
        return got

    for at, (kind, key, x) in enumerate(stream):
        if kind == "<":
            tag = key.partition(".")[0]
            if tag in BLOCK and (got := close()):
                yield got
            path.append(key)
            links += tag == "a"
            if tag in BLOCK:
                ends.append(len(path))
            if not skip and at in out:
                skip = len(path)
        elif kind == ">":
            if key in BLOCK:
                if got := close():
                    yield got
                ends.pop()
            links -= key == "a"
            if skip == len(path):
                skip = 0
            path.pop()
        elif not skip:
            first = first if now else at
            now.append(x if kind == "#" else " " if key in ("br", "hr", "wbr", "p") else "")
            if kind == "#" and not x.isspace():
                if links:
                    linked += len(x)
                else:
                    text += len(x)
    if got := close():
        yield got


def _hash(text: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), 42)


class Node:
    """An element of a wrapper. Children are in page order, each key once; `groups` are spans of them that repeat together.

    `fixed` are the blocks of text directly inside on which all pages agree that have the element (the constants of the expression), by hash, with their
    characters outside and inside links; all other text is a slot. `pages` counts the pages that have the element, and `some` holds the hashes
    of up to LEAVE_OUT different ones, the smallest.
    """

    __slots__ = ("key", "optional", "repeated", "text", "linked", "pages", "some", "fixed", "children", "groups")

    def __init__(self, key: str, some: tuple[int, ...] = ()):
        self.key, self.optional, self.repeated = key, False, False
        self.text = self.linked = 0  # characters of the blocks directly inside, outside and inside links
        self.pages, self.some = 1, some
        self.fixed: dict[int, tuple[int, int]] = {}
        self.children: list[Node] = []
        self.groups: list[tuple[int, int]] = []

    def walk(self) -> list[tuple[Node, int]]:
        """All elements below and including this one in page order, each with its parent's place in the list."""
        out, stack = [], [(self, -1)]
        while stack:
            node, up = stack.pop()
            stack += [(c, len(out)) for c in reversed(node.children)]
            out.append((node, up))
        return out

    def dump(self) -> list:
        return [[n.key, int(n.optional), int(n.repeated), n.text, n.linked, n.pages, n.some, [[h, *x] for h, x in sorted(n.fixed.items())], n.groups, up] for n, up in self.walk()]

    @classmethod
    def load(cls, rows: list) -> Node:
        nodes: list[Node] = []
        for key, optional, repeated, text, linked, pages, some, fixed, groups, up in rows:
            node = cls(key, tuple(some))
            node.optional, node.repeated, node.text, node.linked, node.pages = bool(optional), bool(repeated), text, linked, pages
            node.fixed, node.groups = {h: (a, b) for h, a, b in fixed}, [tuple(g) for g in groups]
            nodes.append(node)
            if up >= 0:
                nodes[up].children.append(node)
        return nodes[0]

    def slots(self, agree: int = AGREE) -> tuple[int, int]:
        """Characters outside and inside links of the text directly inside that differs from page to page."""
        if len(self.some) < agree:
            return self.text, self.linked
        return max(0, self.text - self.pages * sum(a for a, _ in self.fixed.values())), max(0, self.linked - self.pages * sum(b for _, b in self.fixed.values()))

    def expression(self) -> str:
        """The union-free expression: # is a slot of text, '…' a text on which all pages agree, ? optional, + repeated."""
        done: dict[int, str] = {}
        for node, _ in reversed(self.walk()):
            parts = [done.pop(id(c)) for c in node.children]
            for a, b in sorted(node.groups, reverse=True):
                parts[a : b + 1] = ["( " + " ".join(parts[a : b + 1]) + " )+"]
            texts = (["'…'"] if node.fixed and len(node.some) >= AGREE else []) + (["#"] if any(node.slots()) else [])
            inner = " ".join(texts) + (" " + " ".join(parts) if parts else "")
            done[id(node)] = f"<{node.key}>{inner}</>" + "+" * node.repeated + "?" * node.optional
        return done[id(self)]


def _joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _fold(sequence: list[Node]) -> tuple[list[Node], list[tuple[int, int]], list[tuple[Node, Node]]]:
    """Each key once, the groups, and which element is to be folded into which. Neighbours of one key are a repeated element; what lies between other
    occurrences of a key repeats as a group, whose members become optional."""
    places: dict[str, list[int]] = {}
    for i, c in enumerate(sequence):
        places.setdefault(c.key, []).append(i)
    if len(places) == len(sequence):
        return sequence, [], []
    spans = _joined([(p[0], p[-1]) for p in places.values() if p[-1] - p[0] >= len(p)])
    out: list[Node] = []
    at: dict[str, int] = {}
    same = []
    for c in sequence:
        if c.key in at:
            same.append((out[at[c.key]], c))
            out[at[c.key]].repeated = True
        else:
            at[c.key] = len(out)
            out.append(c)
    groups = []
    for a, b in spans:
        inside = sorted({at[sequence[i].key] for i in range(a, b + 1)})
        for i in inside:
            out[i].optional = True
        groups.append((inside[0], inside[-1]))
    return out, _joined(groups), same


def _unite(a: Node, b: Node, across: bool = True) -> None:
    """Aligns wrapper b with a and folds it in: matched elements go on below, mismatches become optional or repeated, differing texts slots. `across` is
    False for elements of one page, of which a page has all the texts."""
    stack = [(a, b)]
    while stack:
        a, b = stack.pop()
        a.text, a.linked = a.text + b.text, a.linked + b.linked
        a.optional, a.repeated = a.optional or b.optional, a.repeated or b.repeated
        if across:
            a.fixed = {h: x for h, x in a.fixed.items() if h in b.fixed}
            a.pages += b.pages
            a.some = a.some if a.some == b.some else tuple(sorted({*a.some, *b.some})[:LEAVE_OUT])
        else:
            a.fixed |= b.fixed
        left, right = [c.key for c in a.children], [c.key for c in b.children]
        if left == right:
            stack += zip(a.children, b.children, strict=True)
            a.groups = _joined(a.groups + b.groups)
            continue
        merged: list[Node] = []
        marks: list[tuple[int, int]] = []  # which child of a and of b each came from
        for kind, i, j, k, m in SequenceMatcher(None, left, right, autojunk=False).get_opcodes():
            if kind == "equal":
                for x, y in zip(range(i, j), range(k, m), strict=True):
                    stack.append((a.children[x], b.children[y]))
                    merged.append(a.children[x])
                    marks.append((x, y))
                continue
            for x in range(i, j):
                a.children[x].optional = True
                merged.append(a.children[x])
                marks.append((x, -1))
            for y in range(k, m):
                b.children[y].optional = True
                merged.append(b.children[y])
                marks.append((-1, y))
        keys = [c.key for c in merged]
        spans = []
        for side, groups in ((0, a.groups), (1, b.groups)):
            for g in groups:
                own = [n for n, mark in enumerate(marks) if g[0] <= mark[side] <= g[1]]
                spans.append((own[0], own[-1]))
        repeated = {c.key: c.repeated for c in merged}
        out, groups, same = _fold(merged)
        many = {x.key for x, _ in same}
        for c in out:
            c.repeated = repeated[c.key] if c.key not in many else c.repeated
        stack += same
        place = {c.key: n for n, c in enumerate(out)}
        a.children = out
        a.groups = _joined(groups + [tuple(sorted((place[keys[x]], place[keys[y]]))) for x, y in spans])


def wrapper(page: str) -> Node:
    """The wrapper of one page: its token stream, with repetitions folded. Text below elements that are out by tag, role or hidden is not in it."""
    stream = list(tokens(page))
    some = (_hash("\n".join(x for kind, _, x in stream if kind == "#")),)
    out = {at for at, (kind, key, _) in enumerate(stream) if kind == "<" and _bad(key)}
    found = blocks(stream, out)
    ahead = next(found, None)
    root = Node("", some)
    stack = [root]

    def settle(node: Node) -> None:
        node.children, node.groups, same = _fold(node.children)
        for x, y in same:
            _unite(x, y, across=False)

    owner: list[Node] = [root]  # open block elements
    for at, (kind, key, _) in enumerate(stream):
        if ahead and at == ahead[0]:
            h, text, linked = _hash(ahead[2]), ahead[3], ahead[4]
            owner[-1].fixed[h] = (text, linked)
            owner[-1].text, owner[-1].linked = owner[-1].text + text, owner[-1].linked + linked
            ahead = next(found, None)
        if kind == "<":
            node = Node(key, some)
            stack[-1].children.append(node)
            stack.append(node)
            if key.partition(".")[0] in BLOCK:
                owner.append(node)
        elif kind == ">":
            settle(stack.pop())
            if key in BLOCK:
                owner.pop()
    settle(root)
    return root


def plan(w: Node) -> tuple[list[str], list[int]] | None:
    """What a wrapper says of its pages: keys from the root to the element that holds the article, and the texts inside that are template (hashes of path
    and text). None where a wrapper has no text at all.

    Weights are the slots' characters outside links, so what all pages share has none. Of elements that HTML itself calls the article the heaviest holds
    it; else the element whose own paragraphs are heaviest. Names only say at which level it begins where nested elements hold the same
    slots: one that is named as content and holds at least half of all slots goes before those around and inside it.
    Without any slot that is heavier than nothing (one page, or copies of one) all text counts.
    """
    nodes = w.walk()
    for agree in (AGREE, 1 << 30):
        own = [n.slots(agree) for n, _ in nodes]
        if any(x for x, _ in own):
            break
    else:
        return None
    dead = [False] * len(nodes)
    depth = [0] * len(nodes)
    for i, (n, up) in enumerate(nodes):
        dead[i] = up >= 0 and dead[up] or i > 0 and _bad(n.key)
        depth[i] = 0 if up < 0 else depth[up] + 1
    text, linked, holds = [x for x, _ in own], [x for _, x in own], [_holder(n.key) for n, _ in nodes]

    def up_from(i: int, up: int) -> None:
        text[up], linked[up], holds[up] = text[up] + text[i], linked[up] + linked[i], holds[up] or holds[i]

    for i in range(len(nodes) - 1, 0, -1):
        if not dead[i]:
            up_from(i, nodes[i][1])
    everything = text[0]
    named = [False] * len(nodes)
    for i, (n, up) in enumerate(nodes):
        if up >= 0:
            named[i] = named[up] or _good(nodes[up][0].key)
            dead[i] = dead[up] or dead[i] or _rejected(n.key, text[i], linked[i], holds[i], everything, named[i])
    total, direct = [x for x, _ in own], [x for x, _ in own]
    best, at = None, -1
    for i in range(len(nodes) - 1, -1, -1):
        n, up = nodes[i]
        if dead[i]:
            continue
        tag = n.key.partition(".")[0]
        if i and tag in BLOCK and total[i]:
            rank = 2 if _holder(n.key) else 1 if _good(n.key) and 2 * total[i] >= everything else 0
            # an element that HTML calls the article counts with all below it, and so does one by its name; others with their own paragraphs. Of equals, the innermost
            here = (rank, total[i] if rank else direct[i], depth[i])
            if here[1] and (best is None or here >= best):
                best, at = here, i
        if up >= 0:
            total[up] += total[i]
            if tag not in BLOCK or tag in PARAGRAPHS:
                direct[up] += direct[i]
    if at < 0:
        return None
    path, k = [], at
    while k > 0:
        path.append(nodes[k][0].key)
        k = nodes[k][1]
    path.reverse()
    template, inside, paths = [], {at}, {at: "\n".join(path)}
    for i in range(at, len(nodes)):
        n, up = nodes[i]
        if i > at and up not in inside:
            continue
        inside.add(i)
        if i > at:
            paths[i] = paths[up] + "\n" + n.key
        if len(n.some) >= LEAVE_OUT:
            template += [_place(paths[i], h) for h in n.fixed]
    return path, sorted(template)


def _place(path: str, text: int) -> int:
    """A signed number for a text at a place."""
    x = _hash(f"{path}\n{text}")
    return x - (1 << 64) if x >> 63 else x


def text_of(page: str | None, main: list[str] | None, template: Sequence[int] = ()) -> str:
    """Blocks of the page's main elements without those of the template, joined by blank lines. With no main path, or one that the page lacks, its own
    wrapper gives it; a page that says nothing but the template keeps that."""
    if not page:
        return ""
    stream = list(tokens(page))
    out = _main_blocks(stream, main, frozenset(template)) if main else None
    if out is None:
        own = plan(wrapper(page))
        out = (_main_blocks(stream, own[0], frozenset()) if own else None) or []
    return "\n\n".join(out)


def _left_out(stream: list[tuple[str, str, str]]) -> set[int]:
    """Places in a page's token stream of the elements that are left out."""
    out: set[int] = set()
    judged: list[tuple[int, str, int, int, bool, bool]] = []
    stack: list[list] = [[-1, "", 0, 0, False, False]]  # place, key, characters outside and inside links, whether it holds an article, is below a named element
    links = dead = 0  # open links; depth of the outermost element that is out whatever it holds
    for at, (kind, key, text) in enumerate(stream):
        if kind == "<":
            links += key.split(".")[0] == "a"
            stack.append([at, key, 0, 0, _holder(key), stack[-1][5] or _good(stack[-1][1])])
            if not dead and _bad(key):
                dead = len(stack)
                out.add(at)
        elif kind == ">":
            links -= key == "a"
            node = stack.pop()
            if dead > len(stack):
                dead = 0
            elif not dead:
                top = stack[-1]
                top[2], top[3], top[4] = top[2] + node[2], top[3] + node[3], top[4] or node[4]
                judged.append(tuple(node))
        elif kind == "#" and not dead and not text.isspace():
            stack[-1][3 if links else 2] += len(text)
    everything = stack[0][2]
    out.update(at for at, *x, named in judged if _rejected(*x, everything, named))
    return out


def _main_blocks(stream: list[tuple[str, str, str]], main: list[str], template: frozenset[int]) -> list[str] | None:
    """Texts of the blocks inside the elements at the path `main`; None if there is none. A heading of the template stays right before text that is not."""
    path: list[str] = []
    matched = 0  # so many keys of the path are those of main
    spans: list[list[int]] = []
    for at, (kind, key, _) in enumerate(stream):
        if kind == "<":
            path.append(key)
            if len(path) == matched + 1 and matched < len(main) and main[matched] == key:
                matched += 1
                if matched == len(main):
                    spans.append([at, len(stream)])
        elif kind == ">":
            if matched == len(path) == len(main):
                spans[-1][1] = at
            matched = min(matched, len(path) - 1)
            path.pop()
    if not spans:
        return None
    starts = [a for a, _ in spans]
    out = {at for at in _left_out(stream) if (k := bisect_left(starts, at)) and at < spans[k - 1][1]}
    kept, rest, held, k = [], [], [], 0
    for at, where, text, _, _ in blocks(stream, out):
        while k < len(spans) and spans[k][1] < at:
            k += 1
        if k < len(spans) and spans[k][0] < at:
            rest.append(text)
            heading = where[-1].partition(".")[0] in HEADING
            if not template or _place("\n".join(where), _hash(text)) not in template:
                kept += [*held, text]
                held = []
            else:
                held = [*held, text] if heading else []
    return kept or rest


def _wrappers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial wrappers of a partition's hosts: every page's stream is aligned with those before it."""
    held: dict[str, Node] = {}

    def flush():
        out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([json.dumps(w.dump()) for w in held.values()], pa.string())], ["host", "wrapper"])
        held.clear()
        return out

    for batch in batches:
        for host, page in zip(*batch.columns, strict=True):
            host, page = host.as_py(), page.as_py()
            if page:
                w = wrapper(page)
                if host in held:
                    _unite(held[host], w)
                else:
                    held[host] = w
        if len(held) > 4_096:
            yield flush()
    if held:
        yield flush()


def _merge(key, rows):
    both = None
    for x in sorted(rows.column("wrapper").to_pylist()):  # in one order, whatever the tasks' order was
        w = Node.load(json.loads(x))
        if both is None:
            both = w
        else:
            _unite(both, w)
    return pa.table({"host": pa.array([key[0].as_py()], pa.string()), "wrapper": pa.array([json.dumps(both.dump())], pa.string())})


def infer(pages: DataFrame, url_col: str = "url", html_col: str = "html", salts: int = 32) -> DataFrame:
    """(host, wrapper) for every host, as JSON.

    Streams are aligned within a partition first, so a host sends one partial wrapper per partition, however many pages it has; partial wrappers
    meet in `salts` groups per host and then in one. A wrapper names each element once below its parent, so its size follows the
    variety of a host's markup, not the number of its pages.
    """
    base = pages.select(F.coalesce(host_of(quoted(url_col)), F.lit("")).alias("host"), quoted(html_col).alias("html"))
    part = base.mapInArrow(_wrappers, "host string, wrapper string").withColumn("salt", F.spark_partition_id() % salts)
    some = part.groupBy("host", "salt").applyInArrow(_merge, "host string, wrapper string")
    return some.groupBy("host").applyInArrow(_merge, "host string, wrapper string")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Main text of every page: (id, url, text, n_chars).

    Host wrappers say which element holds the article (the one whose slots weigh most, or of those that HTML calls the article the heaviest), and which
    texts in it all pages share: these are template and left out. Pages are joined with that (one row per host; Spark broadcasts it
    by its own size check or splits hot hosts) and their blocks are read from it. Inside, what HTML calls a menu, form, aside and the like is left out; a
    class or id decides only where text varies: one that says nothing else, or one that says so in part where the text is
    mostly links; names never rule out what holds an article or most of a page's text. A page without the element is judged by its own wrapper.

    Null and empty html, and pages without text, have an empty text. A null url counts as host "". Unclosed, stray and nested elements of any depth are
    tolerated. Repeated rows are extracted each. An empty table gives no rows. Other columns are not read.
    """
    base = pages.select(quoted(id_col).alias("id"), quoted(url_col).alias("url"), quoted(html_col).alias("html"))

    def plans(batches):
        for batch in batches:
            got = [plan(Node.load(json.loads(x.as_py()))) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([g and g[0] for g in got], pa.list_(pa.string())), pa.array([g and g[1] for g in got], pa.list_(pa.int64()))], ["host", "main", "template"])

    known = table(infer(base, "url", "html").mapInArrow(plans, "host string, main array<string>, template array<bigint>").where("main is not null"))
    joined = base.withColumn("h", F.coalesce(host_of(F.col("url")), F.lit(""))).join(known, F.col("h") == F.col("host"), "left").select("id", "url", "html", "main", "template")
    kind = pages.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            texts = [text_of(page.as_py(), main.as_py(), template.as_py() or ()) for page, main, template in zip(batch.column(2), batch.column(3), batch.column(4), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["id", "url", "text", "n_chars"])

    return joined.mapInArrow(run, f"id {kind}, url string, text string, n_chars bigint").withColumnRenamed("id", id_col)
