"""Main text of web pages by wrappers: union-free regular expressions inferred per host.

A page is read as nested streams: the content of an element is the sequence of its child elements and
of its texts, each under its label (tag and names). Sequences of one host are aligned one after the
other: neighbours of equal labels, and neighbouring equal runs of them, become repeated groups; what
one side lacks becomes optional; texts become slots. The result, the wrapper of the host, has no
unions. Each distinct shape is aligned once, in buckets of a host, whose wrappers are aligned in turn,
so any number of shapes takes part. Where a tag comes with more than WIDTH labels in one place, the
names of those that are optional are generalised (a name that tells its part in the page stays).

Extraction matches the page against the wrapper of its host and reads the text from the slots. The
lists of names only choose which slots are main text: those inside article or main elements, without
menus, headers, footers, sidebars, notices, adverts, forms and comments. Hosts without such an element
are read again for the texts of each slot: a slot with the same text on all of three or more pages is
template, all others are main text. A page that does not match, or that has nothing in the main slots
of its host, is read by the wrapper of its own.

Defined results: null html is empty and gives the empty text; a null url, or one without host,
belongs to the empty host; repeated rows are extracted once each; what stands behind an unclosed
comment, script or the like is no text, an unclosed tag is; elements more than DEPTH deep count as
part of the one above; other columns pass through (`text` and `n_chars` are replaced); an empty table
gives an empty table. Reading, alignment and matching take time in proportion to the page (but for a logarithm).
"""

from __future__ import annotations

import html
import json
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import bounded_batches, cut
from .urls import split_url

#: Bytes of all wrappers up to which they are broadcast.
BROADCAST_BYTES = 32 << 20
#: Shapes that one task aligns; more are dealt into buckets, and the buckets' wrappers aligned after them.
FAN = 256
#: Labels of one tag in one place beyond which they are generalised.
WIDTH = 48
#: Nesting that wrappers tell apart.
DEPTH = 100
#: Pages from which on a slot with always the same text is template.
FIXED_PAGES = 3

TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)>")
#: Where quotes never close, a tag ends at its first angle bracket.
PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
NAMES = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
#: Numbers in names, such as ids of posts, differ from page to page: they are one in labels.
NUMBER = re.compile(r"\d{2,}")
#: Elements by their part in a page, and names that mark what is not main text.
RAW = {n: re.compile(rf"</{n}\s*>", re.I) for n in ("script", "style", "noscript", "template", "iframe", "object", "svg", "math", "textarea", "select", "title")}
CONTAINERS = {"html", "head", "body", "main", "article", "section", "div", "nav", "header", "footer", "aside", "form", "ul", "ol", "dl", "table", "blockquote", "figure", "dialog", "menu", "button", "fieldset", "details", "center"}
BLOCKS = CONTAINERS | {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "tr", "td", "th", "thead", "tbody", "tfoot", "caption", "pre", "hr", "figcaption", "address", "summary", "option", "legend"}
ASIDE = {"head", "nav", "footer", "aside", "form", "dialog", "menu", "button", "fieldset"}
ASIDE_NAMES = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "banner", "cookie", "cookies", "consent", "gdpr", "notice", "notification", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup", "paywall", "sidebar", "side", "rail", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "footer", "masthead", "topbar", "toolbar", "comment", "comments", "replies", "reply", "respond", "discussion", "disqus", "share", "sharing", "social", "related", "recommended", "widget", "search", "complementary", "contentinfo"}
HEADER_NAMES = {"header", "site-header", "page-header", "pageheader", "banner"}
MAIN_NAMES = {"main", "article", "article-body", "articlebody", "post-content", "entry-content", "post-body"}


# ---- reading


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, more): "o" open tag with its class, id and role names, "c" close tag, "t" text."""
    at, size, find, tag = 0, len(page), page.find, TAG
    while at < size:
        here = find("<", at)
        if here < 0:
            yield "t", page[at:], ""
            return
        if here > at:
            yield "t", page[at:here], ""
        m = tag.match(page, here)
        if m is None and page[here + 1 : here + 3].lstrip("/")[:1].isascii() and page[here + 1 : here + 3].lstrip("/")[:1].isalpha():
            if find(">", here) < 0:  # no tag ends from here on
                yield "t", page[here:], ""
                return
            tag = PLAIN_TAG
            m = tag.match(page, here)
        if m is None:
            if page.startswith("<!--", here):
                end = find("-->", here + 4)
                at = end + 3 if end >= 0 else size
                continue
            end = find(">", here) if page[here + 1 : here + 2] in ("!", "?", "/") and here + 1 < size else -1
            if end < 0:
                yield "t", "<", ""
            at = max(end, here) + 1
            continue
        at, name = m.end(), m[2].lower()
        if m[1]:
            yield "c", name, ""
        elif name in RAW:
            end = RAW[name].search(page, at)
            at = end.end() if end else size
        else:
            yield "o", name, " ".join(x for g in NAMES.findall(m[3]) for x in g if x).lower() if "=" in m[3] else ""


def label_of(name: str, named: str) -> str:
    return name + ("." + ".".join(sorted(NUMBER.sub("0", named).replace(".", ":").split())) if named else "")


@lru_cache(maxsize=100_000)
def roles(label: str) -> tuple[bool, bool, bool]:
    """Whether an element is main, is aside, is a header (which counts outside main only)."""
    name, _, named = label.partition(".")
    marks = set(named.split(".")) if named else set()
    parts = marks | {p for x in marks for p in re.split(r"[-_]", x)}
    return name in ("article", "main") or bool(MAIN_NAMES & marks), name in ASIDE or bool(parts & ASIDE_NAMES), name == "header" or bool(parts & HEADER_NAMES)


def within(state: tuple[bool, bool], label: str) -> tuple[bool, bool]:
    """(inside main, aside) of an element, from those of the one above."""
    main, aside = state
    is_main, is_aside, is_header = roles(label)
    return main or is_main, aside or is_aside or (is_header and not main)


def read(page: str | None) -> list:
    """The content of a page: [label, text or content] in order. A text's label starts with #, and names its block."""
    root: list = []
    stack = [("", root, (False, False))]  # element, its content, its state
    opened: Counter = Counter()
    block, now = "", []

    def flush() -> None:
        text = "".join(now)
        now.clear()
        if text and not text.isspace():
            _, content, (main, aside) = stack[-1]
            deep = len(stack) > DEPTH
            content.append(["#" + block + (("!a" if aside else "!m" if main else "") if deep else ""), text])

    for kind, name, more in tokens(page or ""):
        if kind == "t":
            now.append(name)
        elif name in BLOCKS:
            flush()
            block = ""
            if name not in CONTAINERS:
                block = label_of(name, more) if kind == "o" else ""
            elif kind == "o":
                if name == "body":
                    del stack[1:]
                    opened.clear()
                label = label_of(name, more)
                _, content, state = stack[-1]
                own = content
                if len(stack) < DEPTH:
                    own = []
                    content.append([label, own])
                stack.append((name, own, within(state, label)))
                opened[name] += 1
            elif opened[name]:
                while True:
                    last = stack.pop()[0]
                    opened[last] -= 1
                    if last == name:
                        break
        elif name == "br":
            now.append(" ")
    flush()
    return root


# ---- wrappers: items [key, optional, repeated, content of an element, unit of a group, or None]


def group_key(unit: list) -> str:
    return "(" + " ".join(x[0] for x in unit) + ")"


def join(a: list, b: list) -> list:
    """Two items of one key as one."""
    inner = a[3]
    if inner is not None:
        inner = [join(x, y) for x, y in zip(inner, b[3])] if a[0][0] == "(" else merge(inner, b[3])
    return [a[0], a[1] | b[1], a[2] | b[2], inner]


def fold(items: list) -> list:
    """Neighbours of one key become one repeated item, neighbouring equal runs one repeated group. Runs are compared by running hashes."""
    out: list = []
    places: dict[str, list[int]] = defaultdict(list)
    groups: list[int] = []
    sums, powers = [0], [1]
    prime, base = (1 << 61) - 1, 1_000_003

    def push(x: list) -> None:
        places[x[0]].append(len(out))
        if x[0][0] == "(":
            groups.append(len(out))
        out.append(x)
        sums.append((sums[-1] * base + (hash(x[0]) & 0xFFFFFFFF) + 1) % prime)
        if len(powers) < len(sums):
            powers.append(powers[-1] * base % prime)

    def shorten(n: int) -> list:
        gone = out[n:]
        for x in reversed(gone):
            places[x[0]].pop()
        while groups and groups[-1] >= n:
            groups.pop()
        del out[n:], sums[n + 1 :]
        return gone

    def same(a: int, b: int, n: int) -> bool:
        part = lambda k: (sums[k + n] - sums[k] * powers[n]) % prime
        return part(a) == part(b) and all(x[0] == y[0] for x, y in zip(out[a : a + n], out[b : b + n]))

    for item in items:
        push(item)
        while True:
            n, key = len(out), out[-1][0]
            if n > 1 and out[-2][0] == key:
                b, a = shorten(n - 1)[0], shorten(n - 2)[0]
                one = join(a, b)
                one[2] = 1
                push(one)
                continue
            g = next((x for x in reversed(groups[-2:]) if x < n - 1), None)
            if g is not None and len(out[g][3]) == n - 1 - g and all(x[0] == y[0] for x, y in zip(out[g][3], out[g + 1 :])):
                more, whole = shorten(g + 1), shorten(g)[0]
                push([whole[0], whole[1], 1, [join(x, y) for x, y in zip(whole[3], more)]])
                continue
            if len(places[key]) > 1:
                d = n - 1 - places[key][-2]
                if n >= 2 * d and same(n - 2 * d, n - d, d):
                    b, a = shorten(n - d), shorten(n - 2 * d)
                    unit = [join(x, y) for x, y in zip(a, b)]
                    push([group_key(unit), 0, 1, unit])
                    continue
            break
    return out


def shape(content: list) -> list:
    """A page's content as items, without its texts."""
    return widen(fold([[key, 0, 0, None if isinstance(x, str) else shape(x)] for key, x in content]))


def flat(items: list) -> Iterator[list]:
    for x in items:
        if x[0][0] == "(":
            yield from flat(x[3])
        else:
            yield x


def tag_of(key: str) -> str:
    return key.partition(".")[0]


def general(key: str) -> str:
    """A label without its names, but for what they tell of its part in the page."""
    tag = tag_of(key)
    if key[0] == "#":
        return tag + ".*" + "".join(m for m in ("!a", "!m") if key.endswith(m))
    is_main, is_aside, is_header = roles(key)
    return tag + ".*" + ".main" * is_main + ".sidebar" * is_aside + ".header" * is_header


def wild_tags(items: list) -> set[str]:
    return {tag_of(x[0]) for x in flat(items) if x[0].partition(".")[2].startswith("*")}


def generalised(items: list, wanted) -> list:
    """Items of which those that wanted(item) names have general labels."""

    def one(x: list) -> list:
        if x[0][0] == "(":
            unit = [one(y) for y in x[3]]
            return [group_key(unit), x[1], x[2], unit]
        return [general(x[0]), *x[1:]] if wanted(x) else x

    return fold([one(x) for x in items])


def widen(items: list) -> list:
    """Labels of a tag beyond WIDTH are generalised where they are optional; what all pages have keeps its label."""
    if len(items) <= WIDTH:
        return items
    labels = defaultdict(set)
    for x in flat(items):
        labels[tag_of(x[0])].add(x[0])
    wide = {t for t, own in labels.items() if len(own) > WIDTH}
    return generalised(items, lambda x: x[1] and tag_of(x[0]) in wide) if wide else items


def regroup(items: list, other: list) -> list:
    """Runs that are a group's unit on the other side become that group, of one occurrence."""
    units = defaultdict(list)
    for x in other:
        if x[0][0] == "(":
            units[x[3][-1][0]].append((x[0], [y[0] for y in x[3]]))
    if not units:
        return items
    out: list = []
    for x in items:
        out.append(x)
        for key, unit in units.get(x[0], ()):
            if [y[0] for y in out[-len(unit) :]] == unit:
                out[-len(unit) :] = [[key, 0, 0, out[-len(unit) :]]]
                break
    return out


def align(a: list, b: list) -> list[tuple[int, int]]:
    """Places (in a, in b) of items that match, rising in both: of the k-th occurrences of equal keys, the longest rising run."""
    seen: Counter = Counter()
    where = {}
    for i, x in enumerate(a):
        where[x[0], seen[x[0]]] = i
        seen[x[0]] += 1
    seen.clear()
    tails: list[int] = []  # places in a that end a run of each length
    ends: list[int] = []
    pairs, before = [], []
    for j, y in enumerate(b):
        i = where.get((y[0], seen[y[0]]))
        seen[y[0]] += 1
        if i is None:
            continue
        n = bisect_left(tails, i)
        if n == len(tails):
            tails.append(i)
            ends.append(len(pairs))
        else:
            tails[n], ends[n] = i, len(pairs)
        before.append(ends[n - 1] if n else -1)
        pairs.append((i, j))
    out, k = [], ends[-1] if ends else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def merge(a: list, b: list) -> list:
    """The content that accepts both: matches are joined, what one side lacks is optional."""
    if a == b:
        return a
    if tags := wild_tags(a) | wild_tags(b):
        known = {x[0] for x in flat(a)} & {x[0] for x in flat(b)}
        rare = lambda x: tag_of(x[0]) in tags and x[0] not in known
        a, b = generalised(a, rare), generalised(b, rare)
    a, b = regroup(a, b), regroup(b, a)
    out, i, j = [], 0, 0
    for x, y in [*align(a, b), (len(a), len(b))]:
        out += [[t[0], 1, *t[2:]] for t in a[i:x]] + [[t[0], 1, *t[2:]] for t in b[j:y]]
        if x < len(a):
            out.append(join(a[x], b[y]))
        i, j = x + 1, y + 1
    return widen(fold(out))


def infer(pages: list[str]) -> list:
    """The wrapper of some pages."""
    out = None
    for p in pages:
        out = shape(read(p)) if out is None else merge(out, shape(read(p)))
    return out or []


class Content:
    """A wrapper's content, made ready for matching. Slots have numbers; `main` and `free` tell which hold main text, and which text that is not aside."""

    def __init__(self, items: list, fixed: frozenset[int] = frozenset(), top: "Content | None" = None, state: tuple[bool, bool] = (False, False)):
        top = top or self
        if top is self:
            self.n_slots, self.main, self.free = 0, set(), set()
        self.wild, self.places, self.parts, self.first = wild_tags(items), defaultdict(list), [], []
        # Elements of one label in one content have one content too, so that any of their places accepts any of them.
        inner: dict[str, list] = {}
        for x in flat(items):
            if x[0][0] != "#":
                inner[x[0]] = merge(inner[x[0]], x[3]) if x[0] in inner else x[3]
        self.inner: dict[str, Content] = {}
        self._add(items, inner, None, fixed, top, state)
        if top is self:
            self.has_main = bool(self.main)
            self.free -= fixed
            if not self.has_main:
                self.main = self.free

    def _add(self, items: list, inner: dict[str, list], start: int | None, fixed, top, state) -> None:
        for x in items:
            n = len(self.parts)
            if x[0][0] == "(":
                self._add(x[3], inner, n if start is None else start, fixed, top, state)
                continue
            self.places[x[0]].append(n)
            #: From where on the next item is looked for: a group may begin again.
            self.first.append(n + 1 if start is None else start)
            if x[0][0] != "#":
                if x[0] not in self.inner:
                    self.inner[x[0]] = Content(inner[x[0]], fixed, top, within(state, x[0]))
                self.parts.append(self.inner[x[0]])
                continue
            main, aside = state
            main, aside = main or x[0].endswith("!m"), aside or x[0].endswith("!a")
            self.parts.append(top.n_slots)
            if not aside:
                top.free.add(top.n_slots)
                if main:
                    top.main.add(top.n_slots)
            top.n_slots += 1

    def match(self, content: list) -> list[tuple[int, str]] | None:
        """(slot, text) of a page's content in order; None if it does not match. The earliest place that can be
        reached is taken for each item, as all others can still be reached from it."""
        out, last, now = [], None, 0
        for key, x in content:
            if key != last:
                own = self.places.get(key, ())
                k = bisect_left(own, now)
                if k == len(own) and tag_of(key) in self.wild:
                    key = general(key)
                    if key == last:
                        own, k = (at,), 0
                    else:
                        own = self.places[key] if key in self.places else ()
                        k = bisect_left(own, now)
                if k == len(own):
                    return None
                at, last = own[k], key
                now = self.first[at]
            part = self.parts[at]
            if isinstance(x, str):
                out.append((part, x))
            else:
                inner = part.match(x)
                if inner is None:
                    return None
                out += inner
        return out


def clean(text: str) -> str:
    return " ".join((html.unescape(text) if "&" in text else text).split())


def extract(page: str | None, wrapper: Content | None = None) -> str:
    """The main text of a page: the texts of the main slots, a block a line."""
    content = read(page)
    if not content:
        return ""
    for w in (wrapper, None):
        if w is None:
            w = Content(shape(content))
        found = w.match(content)
        for wanted in (w.main, w.free) if found is not None else ():
            lines = [t for s, x in found if s in wanted and (t := clean(x))]
            if lines:
                return "\n".join(lines)
    return ""


# ---- all pages


def dump(items: list) -> str:
    return json.dumps(items, separators=(",", ":"), ensure_ascii=False)


def wrappers(pages: DataFrame) -> DataFrame:
    """host, wrapper (JSON items) of pages (host, html): all shapes of a host, the frequent ones first."""
    bounded_batches(pages.sparkSession)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = Counter((host, dump(shape(read(page)))) for host, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.string()), pa.array(list(found.values()), pa.int64())], ["host", "wrapper", "pages"])

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (host, bucket, pages, wrapper) sorted by bucket: one wrapper of each bucket."""
        own, made, n = None, [], 0

        def done() -> pa.RecordBatch:
            rows = [(own[0], dump(made), n)] if own else []
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64()))], ["host", "wrapper", "pages"])

        for b in batches:
            for host, bucket, count, w in zip(*(b.column(k).to_pylist() for k in range(4))):
                if (host, bucket) != own:
                    yield done()
                    own, made, n = (host, bucket), json.loads(w), count
                else:
                    made, n = merge(made, json.loads(w)), n + count
        yield done()

    schema = "host string, wrapper string, pages long"
    now = cut(pages.select("host", "html").mapInArrow(measure, schema).groupBy("host", "wrapper").agg(F.sum("pages").alias("pages")))
    while True:
        sizes = now.groupBy("host").agg(F.count("*").alias("n"))
        most = sizes.agg(F.max("n")).first()[0] or 0
        if most <= 1:
            return now.select("host", "wrapper")
        bucket = F.pmod(F.xxhash64("wrapper"), F.ceil(F.col("n") / FAN)).cast("long")
        dealt = now.join(sizes, "host").select("host", bucket.alias("bucket"), "pages", "wrapper")
        now = cut(dealt.repartition("host", "bucket").sortWithinPartitions("host", "bucket", F.desc("pages"), "wrapper").mapInArrow(aligned, schema))


class Wrappers:
    """Parsed wrappers of a worker."""

    def __init__(self):
        self.known: dict[tuple, Content | None] = {}

    def get(self, wrapper: str | None, fixed: list[int] | None = None) -> Content | None:
        key = (wrapper, tuple(fixed or ()))
        if key not in self.known:
            if len(self.known) >= 1000:
                self.known.clear()
            self.known[key] = Content(json.loads(wrapper), frozenset(fixed or ())) if wrapper is not None else None
        return self.known[key]


def with_main(known: DataFrame) -> DataFrame:
    """host, wrapper, has_main: whether a slot lies inside an article or main element."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([Content(json.loads(w)).has_main for w in b.column(1).to_pylist()], pa.bool_())], ["host", "wrapper", "has_main"])

    return known.mapInArrow(run, "host string, wrapper string, has_main boolean")


def fixed_slots(pages: DataFrame) -> DataFrame:
    """host, fixed (numbers of slots) of pages (host, html, wrapper): slots whose text is the same on all of FIXED_PAGES or
    more pages, if any slot of the host varies. Copies of one page alone do not make its slots fixed."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wrapped = Wrappers()
        for b in batches:
            found: dict[tuple, list] = {}
            for host, page, w in zip(*(b.column(k).to_pylist() for k in range(3))):
                own = xxhash.xxh64_intdigest(page or "") >> 1
                texts = defaultdict(xxhash.xxh64)
                for slot, text in wrapped.get(w).match(read(page)) or ():
                    texts[slot].update(text + "\n")
                for slot, h in texts.items():
                    d = h.intdigest() >> 1
                    s = found.setdefault((host, slot), [0, d, d, own, own])
                    s[0] += 1
                    s[1], s[2], s[3], s[4] = min(s[1], d), max(s[2], d), min(s[3], own), max(s[4], own)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in found], pa.string()), *[pa.array([k[1] for k in found], pa.int64())], *[pa.array([v[i] for v in found.values()], pa.int64()) for i in range(5)]], ["host", "slot", "pages", "lo", "hi", "first", "last"])

    rows = pages.select("host", "html", "wrapper").mapInArrow(measure, "host string, slot long, pages long, lo long, hi long, first long, last long")
    varies = (F.min("lo") != F.max("hi")) | (F.min("first") == F.max("last"))
    slots = rows.groupBy("host", "slot").agg(F.sum("pages").alias("pages"), varies.alias("varies"))
    fixed = F.collect_list(F.when(~F.col("varies") & (F.col("pages") >= FIXED_PAGES), F.col("slot")))  # as many as a wrapper has slots
    return slots.groupBy("host").agg(F.array_sort(F.when(F.max("varies"), fixed).otherwise(F.array().cast("array<long>"))).alias("fixed"))


def main_text(pages: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """`pages` (url, html) with text and n_chars (its code points)."""
    bounded_batches(pages.sparkSession)
    pages = pages.drop("text", "n_chars")
    names = pages.columns
    hosted = pages.withColumn("__host", split_url(F.col("url"))[0])
    known = cut(with_main(wrappers(hosted.select(F.col("__host").alias("host"), "html"))))
    size = known.agg(F.coalesce(F.sum(F.length("wrapper") + F.length("host") + 64), F.lit(0))).first()[0]
    small = lambda side: F.broadcast(side) if size <= broadcast_bytes else side
    plain = known.filter(~F.col("has_main")).select(F.col("host").alias("__host"), "wrapper")
    fixed = None
    if not plain.isEmpty():
        fixed = cut(fixed_slots(hosted.select("__host", "html").join(small(plain), "__host").withColumnRenamed("__host", "host")))
    known = known.join(fixed, "host", "left") if fixed is not None else known.withColumn("fixed", F.lit(None).cast("array<long>"))
    side = known.select(F.col("host").alias("__host"), F.col("wrapper").alias("__wrapper"), F.col("fixed").alias("__fixed"))
    joined = hosted.join(small(side), "__host", "left").select(*[F.col(f"`{n}`") for n in names], "__wrapper", "__fixed")
    at = names.index("html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wrapped = Wrappers()
        for b in batches:
            out = [extract(page, wrapped.get(w, f)) for page, w, f in zip(b.column(at).to_pylist(), b.column(len(names)).to_pylist(), b.column(len(names) + 1).to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], [*names, "text", "n_chars"])

    return joined.mapInArrow(run, T.StructType([*pages.schema.fields, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]))
