"""Main text of web pages by wrappers: union-free regular expressions inferred for each host.

A page is a tree of elements and text slots. Aligning the trees of a host's pages, level by level,
gives its wrapper: where one page has an element that another lacks, the element becomes optional;
equal neighbours become one repeated element, and runs of alternating neighbours one repeated
group. Alignment is associative enough to be done in any order, so pages are combined inside tasks
and hosts in rounds of bounded groups. The wrapper then tells which of its elements hold the
article and which are furniture, from names and from what the slots hold across the host's pages,
and a page's text is read along its match with the wrapper.

Pages may be nested as deep as they like: every walk keeps its own stack, and trees are written flat.
"""

from __future__ import annotations

import html
import json
import re
from collections import Counter
from collections.abc import Generator, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import BROADCAST_ROWS, stored, table

#: Wrappers of a host that one task aligns, and bytes of all wrappers up to which they are broadcast.
MERGE, BROADCAST_BYTES = 16, 16_000_000
#: Pages of a host that one task reads where wrappers are too large to broadcast.
HOST_PAGES = 2000
#: Neighbours of a repeated group; runs that alternate with a longer period stay as they are.
PERIOD = 4
#: Children of a wrapper's element; with more, plain names are taken off and what is left becomes one repeated group, so that generated names don't make a wrapper grow with its pages.
WIDE = 200
#: Bits of the tables that find a longest common subsequence at once; longer lists are halved first.
TABLE_BITS = 1 << 28
#: Pages after which text that never changed counts as furniture, where nothing names the article.
CONSTANT_PAGES = 3
#: Class names of an element that alignment reads beside those that tell a role.
PLAIN = 4

# Element names by what they do in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
NOT_TEXT = frozenset("head script style noscript template iframe object svg math canvas audio video nav footer aside form button select textarea input menu dialog fieldset search noembed noframes map title".split())
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "option": ("option",), "optgroup": ("optgroup", "option"), "tbody": ("thead", "tbody", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th"), "body": ("head",),
}
SCOPE = frozenset("table td th caption body html button object template article section div main aside nav header footer ul ol dl form blockquote".split())
# Words of class and id names, and roles, that name furniture or the article.
FURNITURE = frozenset(
    "ad ads adv advert adverts advertisement advertising banner promo promotion sponsor sponsored sponsors sidebar sidenav menu nav navbar navigation breadcrumb breadcrumbs footer masthead comment comments commentlist disqus replies respond cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations pagination pager widget toolbar search searchbox copyright legal disclaimer skip outbrain taboola form paywall".split()
)
FURNITURE_ROLES = frozenset("banner navigation complementary contentinfo search alert dialog alertdialog menu menubar form status toolbar".split())
HEADER = frozenset("header topbar".split())
COMMENTS = frozenset("comment comments commentlist reply replies respond disqus related recommended recommendations teaser promo sponsored ad".split())
LAYOUTS = frozenset("sidebar sidenav nav navbar menu navigation ad ads widget search paywall subscription share social comments".split())
ARTICLE = frozenset("content article post entry story articlebody maincontent postcontent entrycontent".split())
#: Words that decide an element's role; a class name with one of them is read whatever its place.
TELLING = FURNITURE | HEADER | COMMENTS | LAYOUTS | ARTICLE

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*)(?:>|$)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s\"'>]+)))?")
_TELLING = re.compile(r"\b(?:class|id|role|hidden|style|itemprop|aria-hidden)\b", re.I)
_NAMES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

# A tree is a list: [name, optional, repeated, pages, chars, link chars, text's hash or None, children].
NAME, OPTIONAL, REPEATED, PAGES, CHARS, LINKS, HASH, CHILDREN = range(8)
GROUP = "*"


class Element:
    """An element of a page; children are elements and strings."""

    __slots__ = ("children", "name", "signature", "tag")

    def __init__(self, tag: str, signature: str):
        self.tag, self.signature, self.children = tag, signature, []


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(text)}


@lru_cache(50_000)
def telling(name: str) -> bool:
    """Does a class name have a word that names furniture, a heading or the article?"""
    return bool(_words("." + name) & TELLING)


def signature(tag: str, attributes: str) -> str:
    """Tag with the names that class, id and role give it: of classes all that tell a role and the first few others; numbers in ids, and long ones in classes, don't count. "!" marks a hidden element."""
    if not _TELLING.search(attributes):
        return tag
    found = _attributes(attributes)
    names = [re.sub(r"\d{3,}", "0", x) for x in found.get("class", "").split()]
    if len(names) > PLAIN:
        plain = [x for x in names if not telling(x)]
        names = [x for x in names if telling(x)] + plain[:PLAIN]
    out = tag + "".join(f".{x}" for x in sorted(names))
    if "id" in found:
        out += "#" + re.sub(r"\d+", "0", found["id"].strip())
    if "role" in found:
        out += "@" + found["role"].strip().lower()
    if found.get("itemprop", "").lower() == "articlebody":
        out += ".articlebody"
    if "hidden" in found or re.search(r"display\s*:\s*none", found.get("style", "")) or found.get("aria-hidden") == "true":
        out += "!"
    return out


def page(source: str | None) -> Element:
    """The tree of a page. Missing end tags are supplied, stray ones ignored; inline mark-up without telling names is dropped."""
    root = Element("html", "html")
    stack = [root]
    opened: Counter = Counter()  # open elements by tag, so that the stack is searched only where there is something to find
    source = source or ""
    at, end = 0, len(source)

    def text(raw: str) -> None:
        if raw:
            stack[-1].children.append(html.unescape(raw) if "&" in raw else raw)

    def cut(k: int) -> None:
        opened.subtract(e.tag for e in stack[k:])
        del stack[k:]

    def close(tags: tuple[str, ...], among: frozenset[str]) -> None:
        if not any(opened[t] for t in tags):
            return
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in tags:
                cut(k)
                return
            if stack[k].tag in among:
                return

    while at < end:
        start = source.find("<", at)
        if start < 0:
            text(source[at:])
            break
        m = _TOKEN.match(source, start)
        if not m:  # a bare "<" is text
            text(source[at : start + 1])
            at = start + 1
            continue
        text(source[at:start])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            for k in range(len(stack) - 1, 0, -1) if opened[tag] else ():
                if stack[k].tag == tag:
                    cut(k)
                    break
                if stack[k].tag in SCOPE and tag not in SCOPE:
                    break
            if tag == "p" or tag in BLOCK:
                stack[-1].children.append(None)  # a block ends here, whatever was open
            continue
        if tag == "html":
            continue
        if tag == "br":
            stack[-1].children.append(" ")
            continue
        if tag in VOID:
            if tag == "hr":
                close(("p",), SCOPE)
                stack[-1].children.append(None)
            continue
        if tag in RAW:
            done = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(source, at)
            at = done.end() if done else end
            continue
        sign = signature(tag, m[3])
        if tag in BLOCK:
            close(("p",), SCOPE)
            if tag in CLOSES:
                close(CLOSES[tag], frozenset(("ul", "ol", "dl", "table", "select")))
        elif tag != "a" and tag not in NOT_TEXT and not furniture(sign) and not m[3].rstrip().endswith("/"):
            continue
        element = Element(tag, sign)
        stack[-1].children.append(element)
        if not m[3].rstrip().endswith("/"):
            stack.append(element)
            opened[tag] += 1
    return root


@lru_cache(50_000)
def _words(sign: str) -> frozenset[str]:
    """Lower-cased words of an element's names, and the names whole."""
    return frozenset(w.lower() for n in re.split(r"[.#@!]", sign)[1:] for w in [*_NAMES.findall(n), n])


def _tag(sign: str) -> str:
    return re.split(r"[.#@!]", sign, maxsplit=1)[0]


@lru_cache(50_000)
def furniture(sign: str, holds_article: bool = False) -> bool:
    """Does the element's name say that it is no part of an article? Names of layouts say nothing about an element that holds one."""
    tag = _tag(sign)
    if tag in NOT_TEXT or sign.endswith("!"):
        return True
    if tag in ("html", "body", "article", "main") and not _words(sign) & COMMENTS:
        return False
    found = _words(sign) & FURNITURE | (FURNITURE_ROLES & {sign.partition("@")[2].rstrip("!")})
    return bool(found - LAYOUTS if holds_article else found)


@lru_cache(50_000)
def coarse(sign: str) -> str:
    """Tag, and of the other names those only that tell a role."""
    names = re.findall(r"([.#@])([^.#@!]*)", sign)
    return _tag(sign) + "".join(k + n for k, n in names if k == "@" or telling(n)) + "!" * sign.endswith("!")


@lru_cache(50_000)
def heading(sign: str) -> bool:
    return sign.startswith("header") or bool(_words(sign) & HEADER)


@lru_cache(50_000)
def article(sign: str) -> bool:
    return _tag(sign) in ("article", "main") or ".articlebody" in sign or "@main" in sign


# Inference


def _run(call: Generator):
    """Result of a recursion whose functions are generators: each yields the calls that it waits for."""
    stack, value = [call], None
    while stack:
        try:
            call = stack[-1].send(value)
        except StopIteration as done:
            stack.pop()
            value = done.value
        else:
            stack.append(call)
            value = None
    return value


def skeleton(root: Element) -> list:
    """The tree of one page in a wrapper's form, neighbours folded."""
    frames = [(root, root.tag == "a", iter(root.children), [], [0, 0], [])]
    while True:
        element, link, rest, children, sizes, own = frames[-1]
        for child in rest:
            if isinstance(child, str):
                if child := " ".join(child.split()):
                    sizes[0] += len(child)
                    sizes[1] += len(child) * link
                    own.append(child)
            elif child is not None:
                frames.append((child, link or child.tag == "a", iter(child.children), [], [0, 0], []))
                break
        else:
            frames.pop()
            node = [element.signature, False, False, 1, *sizes, xxhash.xxh64_intdigest("\n".join(own)) >> 3, _run(_fold(children)) if len(children) > 1 else children]
            if not frames:
                return node
            _, _, _, above, sizes, own = frames[-1]
            above.append(node)
            sizes[0] += node[CHARS]
            sizes[1] += node[LINKS]
            own.append(str(node[HASH]))


def merge(a: list, b: list) -> list:
    """One node for two of the same name."""
    return _run(_merge(a, b))


def _merge(a: list, b: list, pages: int | None = None) -> Generator:
    same = a[HASH] if a[HASH] == b[HASH] else None
    children = (yield _align(a[CHILDREN], b[CHILDREN])) if a[CHILDREN] or b[CHILDREN] else []
    return [a[NAME], a[OPTIONAL] or b[OPTIONAL], a[REPEATED] or b[REPEATED], a[PAGES] + b[PAGES] if pages is None else pages, a[CHARS] + b[CHARS], a[LINKS] + b[LINKS], same, children]


def _fold(nodes: list[list]) -> Generator:
    """Equal neighbours become one repeated node, alternating runs one repeated group."""
    out: list[list] = []
    for node in nodes:
        if out and out[-1][NAME] == node[NAME] != GROUP:
            out[-1] = yield _merge(out[-1], node, max(out[-1][PAGES], node[PAGES]))
            out[-1][REPEATED] = True
        else:
            out.append(node)
    for period in range(2, PERIOD + 1):
        done, i = [], 0
        while i < len(out):
            body = out[i : i + period]
            names = [n[NAME] for n in body]
            i += period
            if len(names) == period and GROUP not in names and [n[NAME] for n in out[i : i + period]] == names:
                while [n[NAME] for n in out[i : i + period]] == names:
                    for k in range(period):
                        body[k] = yield _merge(body[k], out[i + k], max(body[k][PAGES], out[i + k][PAGES]))
                    i += period
                total = [sum(n[k] for n in body) for k in (CHARS, LINKS)]
                done.append([GROUP, False, True, max(n[PAGES] for n in body), *total, None, body])
            else:
                i -= period - 1
                done.append(body[0])
        out = done
    return out


def _key(node: list) -> str:
    return node[NAME] if node[NAME] != GROUP else GROUP + " ".join(n[NAME] for n in node[CHILDREN])


def _align(a: list[list], b: list[list]) -> Generator:
    """Children of two nodes of one name: common ones merged in order, the others optional."""
    if not a or not b:
        return [[n[NAME], True, *n[2:]] for n in a or b]
    left, right = [_key(n) for n in a], [_key(n) for n in b]
    out: list[list] = []
    if left == right:
        for x, y in zip(a, b, strict=True):
            out.append((yield _merge(x, y)))
        return out
    i = j = 0
    for x, y in [*common(left, right), (len(a), len(b))]:
        out += [[n[NAME], True, *n[2:]] for n in a[i:x]] + [[n[NAME], True, *n[2:]] for n in b[j:y]]
        if x < len(a):
            out.append((yield _merge(a[x], b[y])))
        i, j = x + 1, y + 1
    out = yield _fold(out)
    return (yield _narrow(out)) if len(out) > WIDE else out


def _narrow(nodes: list[list]) -> Generator:
    """One repeated group of optional members, one member for each coarse name in order of first place."""
    members: dict[str, list] = {}
    for node in nodes:
        for n in node[CHILDREN] if node[NAME] == GROUP else [node]:
            n = [coarse(n[NAME]), True, *n[2:]]
            members[n[NAME]] = (yield _merge(members[n[NAME]], n, max(members[n[NAME]][PAGES], n[PAGES]))) if n[NAME] in members else n
    body = list(members.values())
    return [[GROUP, False, True, max(n[PAGES] for n in body), *(sum(n[k] for n in body) for k in (CHARS, LINKS)), None, body]]


def common(left: list[str], right: list[str]) -> list[tuple[int, int]]:
    """Positions of a longest common subsequence, ascending.

    Bit j of a row's number is 0 where the subsequence of the row's suffix of left grows with the
    j-th last of right; a row takes a few operations on whole numbers.
    """
    ends = min(len(left), len(right))
    head = next((k for k in range(ends) if left[k] != right[k]), ends)
    tail = next((k for k in range(ends - head) if left[-1 - k] != right[-1 - k]), ends - head)
    n, m = len(left) - head - tail, len(right) - head - tail
    out = [(k, k) for k in range(head)]
    a, b = left[head : head + n], right[head : head + m]
    if n * m > TABLE_BITS and n > 1:
        half = n // 2
        before = _growth(a[:half], b)
        after = _growth(a[half:][::-1], b[::-1])[::-1]
        cut = int(np.argmax(before + after))
        out += [(head + i, head + j) for i, j in common(a[:half], b[:cut])] + [(head + half + i, head + cut + j) for i, j in common(a[half:], b[cut:])]
    elif n and m:
        rows = _rows(a[::-1], b[::-1])
        i, j = n, m
        while i and j:
            if a[n - i] == b[m - j]:
                out.append((head + n - i, head + m - j))
                i, j = i - 1, j - 1
            elif rows[i] >> (j - 1) & 1:
                j -= 1
            else:
                i -= 1
    return out + [(head + n + k, head + m + k) for k in range(tail)]


def _rows(a: list[str], b: list[str]) -> list[int]:
    """The number of each prefix of ``a``."""
    full = (1 << len(b)) - 1
    where: dict[str, int] = {}
    for j, name in enumerate(b):
        where[name] = where.get(name, 0) | 1 << j
    rows = [full]
    for name in a:
        row = rows[-1]
        hit = row & where.get(name, 0)
        rows.append((row + hit | row - hit) & full)
    return rows


def _growth(a: list[str], b: list[str]) -> np.ndarray:
    """Length of the longest common subsequence of ``a`` and each prefix of ``b``."""
    full = (1 << len(b)) - 1
    where: dict[str, int] = {}
    for j, name in enumerate(b):
        where[name] = where.get(name, 0) | 1 << j
    row = full
    for name in a:
        hit = row & where.get(name, 0)
        row = (row + hit | row - hit) & full
    bits = np.unpackbits(np.frombuffer(row.to_bytes(-(-len(b) // 8), "little"), dtype=np.uint8), bitorder="little")[: len(b)]
    return np.r_[0, np.cumsum(1 - bits.astype(np.int64))]


def dump(tree: list) -> str:
    """A tree, children last in every node, as a flat JSON list in preorder."""
    out: list = []
    stack = [tree]
    while stack:
        node = stack.pop()
        out += [*node[:-1], len(node[-1])]
        stack += node[-1][::-1]
    return json.dumps([len(tree), out])


def load(text: str) -> list:
    width, flat = json.loads(text)
    root: list = []
    open_ = [[root, 1]]
    for k in range(0, len(flat), width):
        while not open_[-1][1]:
            open_.pop()
        open_[-1][1] -= 1
        children: list = []
        open_[-1][0].append([*flat[k : k + width - 1], children])
        open_.append([children, flat[k + width - 1]])
    return root[0]


# Roles


def roles(wrapper: list) -> list:
    """The wrapper as [name, repeated, role, children]; role: "m" an article's root, "d" furniture (without children), "" neither."""
    nodes, parents, stack = [], [], [(wrapper, -1)]
    while stack:
        node, parent = stack.pop()
        stack += [(c, len(nodes)) for c in reversed(node[CHILDREN])]
        nodes.append(node)
        parents.append(parent)
    holds = [False] * len(nodes)  # an article below
    for k in range(len(nodes) - 1, 0, -1):
        name = nodes[k][NAME]
        holds[parents[k]] |= holds[k] or article(name) and not furniture(name)
    role, inside, live = [""] * len(nodes), [False] * len(nodes), []
    for k, (node, parent) in enumerate(zip(nodes, parents, strict=True)):
        if parent >= 0 and role[parent]:  # below furniture
            role[k] = "d"
            continue
        name, within = node[NAME], parent >= 0 and inside[parent]
        drop = furniture(name) and (not _words(name) or furniture(name, holds[k]))
        if drop or not within and heading(name) and not holds[k]:
            role[k] = "d"
        else:
            live.append(k)
        inside[k] = within or article(name)

    def find(test) -> list[int]:
        """Outermost live nodes whose names pass."""
        found, under = [], set()
        for k in live:
            if parents[k] in under:
                under.add(k)
            elif test(nodes[k][NAME]):
                found.append(k)
                under.add(k)
        return found

    def usual(found: list[int]) -> list[int]:
        """The nodes, if at least half of the host's pages have one of them."""
        return found if 2 * sum(nodes[k][PAGES] for k in found) >= wrapper[PAGES] else []

    found = usual(find(lambda s: _tag(s) == "article" or ".articlebody" in s)) or usual(find(article))
    if not found:
        named = find(lambda s: _tag(s) in ("div", "section", "td") and bool(_words(s) & ARTICLE))
        found = usual(sorted(named, key=lambda k: -(nodes[k][CHARS] - nodes[k][LINKS]))[:1])
    if not found:
        found = [0]
        for k in live[1:]:  # nothing names the article: what is mostly links, and what holds the same text on every page, goes
            stats = nodes[k]
            if role[parents[k]] == "d" or stats[CHARS] and (2 * stats[LINKS] > stats[CHARS] or stats[HASH] is not None and stats[PAGES] >= CONSTANT_PAGES):
                role[k] = "d"
    for k in found:
        role[k] = "m"
    out = [[n[NAME], n[REPEATED], r, []] for n, r in zip(nodes, role, strict=True)]
    for k in range(1, len(nodes)):
        if role[parents[k]] != "d" or nodes[parents[k]][NAME] == GROUP:  # a group stands for its members
            out[parents[k]][3].append(out[k])
    return out[0]


# Extraction


def extract(root: Element, wrapper: list | None) -> str:
    """The main text of a page along its match with the wrapper; elements that the wrapper lacks go by their own names."""
    blocks: list[str] = []
    open_: list[str] = []
    seen = False

    def end() -> None:
        if open_:
            if line := " ".join("".join(open_).split()):
                blocks.append(line)
            open_.clear()

    def matched(children: list, node: list) -> list:
        """For each child element the wrapper's node of its name at or after the last match; groups stand for their members."""
        if len(node) == 4:
            flat = [m for n in node[3] for m in (n[3] if n[0] == GROUP else [n])]
            places: dict[str, list[int]] = {}
            for k, n in enumerate(flat):
                places.setdefault(n[0], []).append(k)
            node.append((flat, places))
        flat, places = node[4]
        out, last = [], 0
        for c in children:
            if isinstance(c, Element):
                where = places.get(c.signature) or places.get(coarse(c.signature))
                k = None if where is None else next((k for k in where if k >= last), where[-1])
                last = last if k is None else k
                out.append(None if k is None else flat[k])
            else:
                out.append(None)
        return out

    def enter(element: Element, node: list | None, inside: bool) -> tuple | None:
        """(children with their matches, is it inside the article, is it a block) of an element that is read."""
        nonlocal seen
        if node is None:
            if furniture(element.signature) or not inside and heading(element.signature):
                return None
        elif node[2] == "d":
            return None
        elif node[2] == "m":
            inside = seen = True
        block = element.tag in BLOCK
        if block:
            end()
        return zip(element.children, matched(element.children, node) if node else [None] * len(element.children), strict=True), inside, block

    first = enter(root, wrapper, False)
    frames = [first] if first else []
    while frames:
        rest, inside, block = frames[-1]
        for child, its in rest:
            if child is None:
                end()
            elif isinstance(child, str):
                if inside:
                    open_.append(child)
            elif below := enter(child, its, inside):
                frames.append(below)
                break
        else:
            frames.pop()
            if block:
                end()
    end()
    if wrapper is not None and not seen:  # the page is none of the host's usual ones: it is its own wrapper
        return extract(root, roles(skeleton(root))) if (root.children and not blocks) else "\n".join(blocks)
    return "\n".join(blocks)


# Spark


def host(url):
    """Lower-cased host of a URL column; empty if there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)), F.lit(""))


def infer(pages: DataFrame) -> DataFrame:
    """(host, html) -> (host, wrapper JSON): one wrapper a host, from all of its pages.

    Tasks align the pages that they read host by host; the results of a host are aligned MERGE at a
    time, round by round, so no task holds more of a host than that.
    """

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: dict[str, list] = {}
            for name, source in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                tree = skeleton(page(source.as_py()))
                held[name] = merge(held[name], tree) if name in held else tree
            yield pa.record_batch([pa.array(list(held), pa.string()), pa.array([dump(t) for t in held.values()], pa.string())], ["host", "wrapper"])

    def join(rows: pa.Table) -> pa.Table:
        trees = [load(x) for x in sorted(rows.column("wrapper").to_pylist())]
        whole = trees[0]
        for tree in trees[1:]:
            whole = merge(whole, tree)
        return pa.table({"host": pa.array([rows.column("host")[0].as_py()], pa.string()), "wrapper": pa.array([dump(whole)], pa.string())})

    found = stored(pages.mapInArrow(first, "host string, wrapper string"), "wrappers")
    while True:
        counts = found.groupBy("host").count()
        most = counts.agg(F.max("count")).first()[0] or 0
        if most <= 1:
            return found
        many = counts.where("count > 1").select("host", F.ceil(F.col("count") / MERGE).cast("int").alias("groups"))
        rows = found.join(many, "host", "left").withColumn("part", F.pmod(F.xxhash64("wrapper", F.monotonically_increasing_id()), F.coalesce("groups", F.lit(1))))
        rows = stored(rows.select("host", "wrapper", "part"), "parts")  # the row number in the hash must not change on a second look
        found = stored(rows.groupBy("host", "part").applyInArrow(join, "host string, wrapper string"), "wrappers")


def texts(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every page.

    Null and empty pages, and pages without an article, have an empty text. Repeated rows stay
    repeated; ids and URLs may be null, and a page without a host belongs to the host "". Elements
    may be nested without limit; a page is read in one task.
    """
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.col("html").cast("string").alias("html"), host(F.col("url")).alias("host"))
    wrappers = infer(pages.select("host", "html"))

    def decided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            trees = [load(x.as_py()) for x in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array([dump(roles(t)) for t in trees], pa.string()), pa.array([t[PAGES] for t in trees], pa.int64())], ["host", "wrapper", "pages"])

    wrappers = stored(wrappers.mapInArrow(decided, "host string, wrapper string, pages long"), "roles")
    size = wrappers.agg(F.coalesce(F.sum(F.octet_length("wrapper") + F.octet_length("host") + 64), F.lit(0))).first()[0]
    schema = "page_id long, url string, text string, n_chars long"
    kept = 500  # wrappers that a task keeps as trees

    def answer(batch: pa.RecordBatch, out: list[str]) -> pa.RecordBatch:
        return pa.record_batch([batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array(list(map(len, out)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    if size <= BROADCAST_BYTES:
        shared = pages.sparkSession.sparkContext.broadcast({r.host: r.wrapper for r in wrappers.select("host", "wrapper").collect()})

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known: dict[str, list] = {}
            for batch in batches:
                out = []
                for source, name in zip(batch.column(2), batch.column(3).to_pylist(), strict=True):
                    if name not in known:
                        if len(known) > kept:
                            known.clear()
                        known[name] = load(shared.value[name])
                    out.append(extract(page(source.as_py()), known[name]))
                yield answer(batch, out)

        return pages.select("page_id", "url", "html", "host").mapInArrow(read, schema)

    # a host's wrapper goes once to each group of its pages, before them
    groups = F.greatest(F.ceil(F.col("pages") / HOST_PAGES), F.lit(1)).cast("int")
    first = wrappers.select("host", F.explode(F.sequence(F.lit(0), groups - 1)).alias("part"), F.lit(0).alias("is_page"), F.lit(None).cast("long").alias("page_id"), F.lit(None).cast("string").alias("url"), F.col("wrapper").alias("html"))
    dealt = pages.join(F.broadcast(wrappers.where(groups > 1).select("host", groups.alias("groups"))) if wrappers.where(groups > 1).count() <= BROADCAST_ROWS else wrappers.select("host", groups.alias("groups")), "host", "left")
    part = F.pmod(F.xxhash64("url", "page_id", "html"), F.coalesce("groups", F.lit(1))).cast("int")
    dealt = dealt.select("host", part.alias("part"), F.lit(1).alias("is_page"), "page_id", "url", "html").unionByName(first)
    n = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(n, "host", "part").sortWithinPartitions("host", "part", "is_page")

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = None
        for batch in batches:
            is_page = batch.column(3).to_numpy(zero_copy_only=False).astype(bool)
            out = []
            for source, own in zip(batch.column(2), is_page, strict=True):
                if own:
                    out.append(extract(page(source.as_py()), tree))
                else:
                    tree = load(source.as_py())
            yield answer(batch.filter(pa.array(is_page)), out)

    return dealt.select("page_id", "url", "html", "is_page").mapInArrow(follow, schema)


def op2_wrappers(spark, sf_dir):
    """Query: main text of every page."""
    return texts(table(spark, sf_dir, "pages"))
