"""Main text of web pages by wrappers: union-free regular expressions over the pages of a host.

A page's markup becomes a sequence of elements and texts. Sequences of the same
host are aligned one after another: what only some have becomes optional, what
follows itself becomes a repeated group, texts that differ become slots, and texts
that stay the same on every page stay literals. The wrapper of a host, so inferred
from all its pages, tells what a page's main text is:

* its slots in an article (else a main part, else the body) and in no menu,
  header, footer, sidebar, notice, advert, form or comment section by their names;
* without its literals, which are the host's template whatever their names, if
  ``LEAST_PAGES`` different pages were aligned, each of them has the literal, and
  literals are the smaller part of the text (else the pages are copies of one
  text, which is kept);
* where a host marks no article and no main part, only in the smallest element
  that holds ``REGION`` of the text that differs from page to page.

Wrappers are merged inside each partition, then over salted parts of a host, then
for the host: no task ever holds a host's pages, and what moves is small.

A null or empty page has the text ``''``; a null url or one without ``://`` has the
empty host. Unclosed, crossed or cut-off tags are repaired; elements nested deeper
than ``DEPTH`` count as part of the one above; a page of a host with articles that
has none itself falls back to its own body. Lists of siblings whose alignment
would take more than ``CELLS`` comparisons are aligned greedily. Repeated rows are
each extracted; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import re
from bisect import bisect_left
from collections.abc import Iterator
from html import unescape
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import together, written
from .urls import host_of

#: Elements that never part a block.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q ruby rt rp s samp small span strike strong sub sup time tt u var wbr blink".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup, up to their own end.
RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
#: Elements that hold no main text, and words of class, id or role that say so of others.
DROPPED = frozenset("head title nav header footer aside form script style noscript template button select option textarea input fieldset dialog iframe object canvas svg math audio video menu xmp noembed noframes".split())
DROPPED_WORDS = frozenset(
    "nav navbar navigation menu header masthead topbar footer sidebar aside ad ads advert adverts advertisement advertisements advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup login search form comment comments reply replies respond disqus discussion share sharing social breadcrumb breadcrumbs pagination pager related recommended widget toolbar skip contentinfo complementary dialog".split()
)
#: Elements that end an open element of the second kind when they begin, as far as one of the third.
_BLOCKS = "address article aside blockquote center details dialog dir div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul"
CLOSES = {name: ({"p"}, {"table", "td", "th", "body", "div", "article", "li"}) for name in _BLOCKS.split()} | {
    "li": ({"li", "p"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd", "p"}, {"dl"}),
    "dd": ({"dt", "dd", "p"}, {"dl"}),
    "tr": ({"tr", "td", "th", "p"}, {"table"}),
    "td": ({"td", "th", "p"}, {"tr", "table"}),
    "th": ({"td", "th", "p"}, {"tr", "table"}),
    "body": ({"head"}, set()),
}
_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_RAW_END = {name: re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I) for name in RAW}
TEXT = "#"
DEPTH = 200
CELLS = 4_000_000
#: Different pages of a host from which on texts that stay the same count as template.
LEAST_PAGES = 5
REGION = 0.8


class Element(NamedTuple):
    label: str
    name: str
    dropped: bool
    root: int


def describe(name: str, attributes: str) -> Element:
    """An element's label (its name and words of class, id and role, digits alike), whether it holds no main text, and whether it is an article (2) or main part (1)."""
    words, dropped = [], name in DROPPED
    for key, a, b, c in _ATTRIBUTE.findall(attributes):
        value, key = (a or b or c).lower(), key.lower()
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
            dropped = True
            words.append("hidden")
        elif key in ("class", "id", "role"):
            words += re.sub(r"\d+", "0", value).split()
    parts = {p for w in words for p in re.split(r"[^a-z]+", w)}
    dropped = dropped or name not in ("html", "body", "article", "main") and bool(parts & DROPPED_WORDS)
    root = 0 if dropped else 2 if name == "article" or "article" in parts else 1 if name == "main" or "main" in parts else 0
    return Element(".".join([name, *sorted(set(words))[:12]]), name, dropped, root)


def parse(html: str) -> Iterator[tuple[str, object]]:
    """Events of the page: ("open", Element), ("close", Element), ("text", str) and ("break", None)."""
    stack: list[Element] = []
    known: dict[tuple[str, str], Element] = {}
    deeper: dict[str, int] = {}
    at, end = 0, len(html)

    def close(names: set[str], stops: set[str]) -> Iterator[tuple[str, object]]:
        """Closes all down to the lowest open element of these names above any stop."""
        lowest = None
        for i in range(len(stack) - 1, -1, -1):
            if stack[i].name in stops and stack[i].name not in names:
                break
            if stack[i].name in names:
                lowest = i
        while lowest is not None and len(stack) > lowest:
            yield "close", stack.pop()

    while at < end:
        m = _MARKUP.search(html, at)
        if not m:
            yield "text", html[at:]
            break
        if m.start() > at:
            yield "text", html[at : m.start()]
        at = m.end()
        ending, name, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not name:
            continue
        name = name.lower()
        if ending and deeper.get(name):
            deeper[name] -= 1
            yield "break", None
            continue
        if ending:
            held = any(e.name == name for e in stack)
            if held or name not in INLINE:
                yield "break", None
                if held:
                    while True:
                        e = stack.pop()
                        yield "close", e
                        if e.name == name:
                            break
            continue
        if name in RAW:
            over = _RAW_END[name].search(html, at)
            at = over.end() if over else end
            yield "break", None
            continue
        key = (name, attributes)
        element = known.get(key)
        if element is None:
            element = known[key] = describe(name, attributes)
        if name in INLINE and not element.dropped:
            continue
        yield "break", None
        if name in VOID:
            continue
        if name in CLOSES:
            yield from close(*CLOSES[name])
        if len(stack) >= DEPTH:
            deeper[name] = deeper.get(name, 0) + 1
            continue
        stack.append(element)
        yield "open", element
    yield "break", None
    while stack:
        yield "close", stack.pop()


# Wrappers: nested lists [label, quantifier, children], quantifiers being "" (once), "?", "+" and "*". A text is
# ["#", quantifier, [], digest, characters]: a literal with its digest ("+" before that of a repeated group's texts), or a
# slot with none.


def _block(parts: list[str]) -> str:
    return " ".join(unescape("".join(parts)).split())


def _digest(block: str) -> str:
    return hashlib.blake2b(block.encode("utf-8", "surrogatepass"), digest_size=6).hexdigest()


def skeleton(html: str) -> list:
    """The page as a wrapper of its own."""
    top: list = []
    open_: list[list] = [top]
    parts: list[str] = []
    dropped = 0
    for kind, value in parse(html):
        if kind == "text":
            parts.append(value)
            continue
        if parts:
            if dropped:
                if not all(map(str.isspace, parts)):
                    open_[-1].append([TEXT, "", [], "", 0])
            elif block := _block(parts):
                open_[-1].append([TEXT, "", [], _digest(block), len(block)])
            parts = []
        if kind == "open":
            node = [value.label + ("!" if value.dropped else "") + "^" * value.root, "", []]
            open_[-1].append(node)
            open_.append(node[2])
            dropped += value.dropped
        elif kind == "close":
            open_.pop()
            dropped -= value.dropped
    return _folded(top)


def _folded(items: list) -> list:
    """Elements that follow themselves, alone or by twos and threes, as repeated groups."""
    for node in items:
        node[2] = _folded(node[2])
    for period in (1, 2, 3):
        if len(items) < 2 * period:
            break
        out: list = []
        for node in items:
            out.append(node)
            while len(out) >= 2 * period:
                one, two = out[-2 * period : -period], out[-period:]
                if [x[0] for x in one] != [x[0] for x in two] or period > 1 and all(x[0] == TEXT for x in one):
                    break
                if period == 1:
                    out[-2:] = [[one[0][0], "*" if {one[0][1], two[0][1]} <= {"?", "*"} else "+", merged(one[0][2], two[0][2], True), *_text(one[0], two[0], True)]]
                else:
                    out[-2 * period :] = [["(" + " ".join(x[0] for x in one) + ")", "+", merged(one, two, True)]]
            if period > 1 and len(out) > period and out[-1 - period][0] == "(" + " ".join(x[0] for x in out[-period:]) + ")":
                out[-1 - period][2] = merged(out[-1 - period][2], out[-period:], True)
                del out[-period:]
        items[:] = out
    return items


def _text(a: list, b: list, together_: bool) -> list:
    """What two texts have in common: a literal if they are alike. Of one page, a repeated group's texts count together, as one that is no block."""
    if a[0] != TEXT:
        return []
    if together_:
        return ["+" + _digest(a[3] + b[3]) if a[3] and b[3] else "", a[4] + b[4]]
    return [a[3] if a[3] == b[3] else "", max(a[4], b[4])]


def _aligned(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """A longest common subsequence as pairs of places; between long lists a greedy one."""
    n, m = len(a), len(b)
    lo = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(n, m))
    tail = next((i for i, (x, y) in enumerate(zip(a[lo:][::-1], b[lo:][::-1], strict=False)) if x != y), min(n, m) - lo)
    pairs, rest = [(i, i) for i in range(lo)], [(n - tail + i, m - tail + i) for i in range(tail)]
    a, b = a[lo : n - tail], b[lo : m - tail]
    n, m = len(a), len(b)
    if n * m > CELLS:
        places: dict[str, list[int]] = {}
        for j, y in enumerate(b):
            places.setdefault(y, []).append(j)
        at = 0
        for i, x in enumerate(a):
            own = places.get(x, ())
            k = bisect_left(own, at)
            # No further than in step, so that one odd label doesn't skip the rest.
            if k < len(own) and own[k] <= at + max(64, n - i):
                pairs.append((lo + i, lo + own[k]))
                at = own[k] + 1
        return pairs + rest
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    i = j = 0
    while i < n and j < m:
        if a[i] == b[j]:
            pairs.append((lo + i, lo + j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return pairs + rest


def merged(a: list, b: list, together_: bool = False) -> list:
    """The expression that matches what either does: a longest common sequence of labels is aligned, the rest is optional."""
    if a == b and not together_:
        return a
    out, i, j = [], 0, 0
    optional = lambda x: [x[0], {"": "?", "+": "*"}.get(x[1], x[1]), *x[2:]]
    for p, q in [*_aligned([x[0] for x in a], [x[0] for x in b]), (len(a), len(b))]:
        out += [optional(x) for x in a[i:p]] + [optional(x) for x in b[j:q]]
        i, j = p + 1, q + 1
        if p < len(a):
            x, y = a[p], b[q]
            several, some = any(c in x[1] + y[1] for c in "+*"), any(c in x[1] + y[1] for c in "?*")
            out.append([x[0], "*" if several and some else "+" if several else "?" if some else "", merged(x[2], y[2], together_), *_text(x, y, together_)])
    return _folded(out)


class Plan(NamedTuple):
    """Which texts of a page are its main text: those at a path of ``slots``, but for the literals, (path, digest)."""

    slots: frozenset[str]
    literals: frozenset[tuple[str, str]] = frozenset()


def plan_of(wrapper: list, pages: int) -> Plan:
    """What is main text by the wrapper of so many different pages."""
    found: dict[int, list[tuple[str, str, int, bool]]] = {}

    def walk(items: list, path: str, root: int, always: bool) -> None:
        for node in items:
            label, own = node[0], always and node[1] in ("", "+")
            if label == TEXT:
                found.setdefault(root, []).append((path, node[3], node[4], own))
            elif label[0] == "(":
                walk(node[2], path, root, own)
            elif not label.rstrip("^").endswith("!"):
                walk(node[2], f"{path}/{label}", max(root, len(label) - len(label.rstrip("^"))), own)

    walk(wrapper, "", 0, True)
    if not found:
        return Plan(frozenset())
    root = max(found)
    texts = found[root]
    if pages >= LEAST_PAGES:
        template = {(path, digest) for path, digest, _, always in texts if digest and always and digest[0] != "+"}
        varied = [(path, chars) for path, digest, chars, always in texts if not (digest and always)]
        whole = sum(chars for _, chars in varied)
        if sum(chars for _, _, chars, _ in texts) < 2 * whole:
            region = ""
            while root == 0:
                # As long as one element further down, that is no mere paragraph, holds enough of what differs.
                below: dict[str, int] = {}
                for path, chars in varied:
                    if path.startswith(region + "/"):
                        step = path[: (path + "/").index("/", len(region) + 1)]
                        below[step] = below.get(step, 0) + chars
                best = max(below, key=below.get, default=None)
                if best is None or below[best] < REGION * whole or any(path == best for path, _, _, _ in texts):
                    break
                region = best
            inside = {path for path, _, _, _ in texts if path == region or path.startswith(region + "/")}
            return Plan(frozenset(inside), frozenset((p, d) for p, d in template if p in inside))
    return Plan(frozenset(path for path, _, _, _ in texts))


def extract(html: str, plan: Plan) -> str:
    """The text that the plan names; if the page has none of its paths, by the page's own wrapper."""
    blocks, path, parts, seen = [], [""], [], "" in plan.slots
    lettered = {p for p, _ in plan.literals}
    for kind, value in parse(html):
        if kind == "text":
            if path[-1] in plan.slots:
                parts.append(value)
            continue
        if parts:
            block = _block(parts)
            if block and not (path[-1] in lettered and (path[-1], _digest(block)) in plan.literals):
                blocks.append(block)
            parts = []
        if kind == "open":
            path.append(f"{path[-1]}/{value.label}{'!' if value.dropped else ''}{'^' * value.root}")
            seen = seen or path[-1] in plan.slots
        elif kind == "close":
            path.pop()
    if not blocks and not seen:
        own = plan_of(skeleton(html), 1)
        if own.slots and not own.slots <= plan.slots:
            return extract(html, Plan(plan.slots | own.slots, plan.literals))
    return " ".join(blocks)


def _texts(items: list) -> Iterator[list]:
    for node in items:
        if node[0] == TEXT:
            yield node
        yield from _texts(node[2])


def _bare(items: list) -> list:
    return [[x[0], x[1], _bare(x[2])] for x in items]


def _joined(wrappers: list[dict]) -> dict:
    """One wrapper for several of a host: the expression, and the digests of some different pages, as many as matter."""
    items = wrappers[0]["items"]
    for other in wrappers[1:]:
        items = merged(items, other["items"])
    return {"pages": sorted({x for w in wrappers for x in w["pages"]})[:LEAST_PAGES], "items": items}


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One wrapper for each host of a partition (and for each of so many pages of it). Pages of one structure are aligned text by text."""
    shapes: dict[tuple[str, str], dict] = {}

    def out() -> pa.RecordBatch:
        hosts: dict[str, list] = {}
        for (host, _), wrapper in shapes.items():
            hosts.setdefault(host, []).append(wrapper)
        return pa.RecordBatch.from_arrays([pa.array(list(hosts), pa.string()), pa.array([json.dumps(_joined(x)) for x in hosts.values()], pa.string())], names=["host", "wrapper"])

    for batch in batches:
        for host, html in zip(batch["host"].to_pylist(), batch["html"], strict=True):
            own = skeleton(html.as_py() or "")
            texts = list(_texts(own))
            page = _digest(" ".join(f"{t[3]} {t[4]}" for t in texts))
            known = shapes.setdefault((host, json.dumps(_bare(own))), {"pages": [page], "items": own})
            if known["items"] is not own:
                for old, new in zip(_texts(known["items"]), texts, strict=True):
                    old[3:] = _text(old, new, False)
                if len(known["pages"]) < LEAST_PAGES and page not in known["pages"]:
                    known["pages"].append(page)
            if len(shapes) >= 20_000:
                yield out()
                shapes.clear()
    yield out()


def _merge_wrappers(rows):
    first = rows.iloc[:1].copy()
    first["wrapper"] = json.dumps(_joined([json.loads(x) for x in sorted(set(rows["wrapper"]))]))
    return first


#: Parts of a host whose wrappers are merged first, by themselves.
PARTS = 32
#: Plans are broadcast up to this many characters; beyond, pages and plans meet in a shuffle, of which Spark splits hot hosts.
BROADCAST_CHARACTERS = 32 << 20


def wrappers(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(host, wrapper): the expression inferred from all pages of each host, as JSON."""
    rows = pages.select(host_of(F.col(url)).alias("host"), F.col(html).alias("html"))
    partial = rows.mapInArrow(_partial, "host string, wrapper string").distinct()
    salted = partial.withColumn("part", F.pmod(F.xxhash64("wrapper"), F.lit(PARTS)).cast("int"))
    parts = salted.groupBy("host", "part").applyInPandas(_merge_wrappers, "host string, wrapper string, part int")
    return parts.select("host", "wrapper").groupBy("host").applyInPandas(_merge_wrappers, "host string, wrapper string")


_EXTRACTED = "page_id long, url string, text string, n_chars long"


def _plans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each host's plan, which is all that its pages need of its wrapper."""
    for batch in batches:
        made = [plan_of(w["items"], len(w["pages"])) for w in map(json.loads, batch["wrapper"].to_pylist())]
        yield pa.RecordBatch.from_arrays([batch["host"], pa.array([json.dumps([sorted(x.slots), sorted(x.literals)]) for x in made], pa.string())], names=["host", "plan"])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str | None, Plan] = {None: Plan(frozenset())}
    for batch in batches:
        for s in together(batch["html"]):
            part = batch.slice(s.start, s.stop - s.start)
            texts = []
            for html, plan in zip(part["html"], part["plan"], strict=True):
                key = plan.as_py()
                if key not in known:
                    if len(known) > 10_000:
                        known = {None: known[None]}
                    slots, literals = json.loads(key)
                    known[key] = Plan(frozenset(slots), frozenset(map(tuple, literals)))
                texts.append(extract(html.as_py() or "", known[key]))
            yield pa.RecordBatch.from_arrays([part["page_id"], part["url"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    known = written(wrappers(pages).mapInArrow(_plans, "host string, plan string"))
    size = known.agg(F.sum(F.length("plan") + F.length("host"))).first()[0] or 0
    rows = pages.select(F.col("page_id").cast("long"), "url", "html", host_of(F.col("url")).alias("host"))
    joined = rows.join(F.broadcast(known) if size <= BROADCAST_CHARACTERS else known, "host", "left")
    return joined.select("page_id", "url", "html", "plan").mapInArrow(_extract, _EXTRACTED)
