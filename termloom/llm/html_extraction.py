"""HTML extraction: union-free regular expressions inferred from same-host pages tell template from text.

A page becomes a tree of block elements and text blocks. The pages of a host are aligned from the top: elements aligned
with each other have their children aligned by tag, classes and occurrence. Where all pages have a child as often, each
occurrence is an element of the expression; where some lack it, it is optional; where its number differs, it is a
repeated group, and all its members are aligned with each other, inside too. Equal text is a constant, unequal text a
slot. Every text block so belongs to one place of the wrapper, and whole places are text or not: constants are
template, tags and classes along the place say what it holds otherwise.

A host of few pages is read at once (``extract``). A larger one is dealt into groups, but has one wrapper, the same that
all its pages at once would give: groups tell what they saw of it, and what they tell is joined by host (``Seen``,
``Shape``, ``weigh``).
"""

from __future__ import annotations

import hashlib
import html
import pickle
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bound_batches

#: Pages of a host that one call reads, and their bytes; larger hosts are dealt into several groups.
GROUP, GROUP_BYTES = 64, 16 << 20
#: Groups whose pages are weighed together; hosts, and bytes, of which a task holds what it saw before it passes that on.
BUCKET, HELD, HELD_BYTES = 4, 1000, 16 << 20
#: More hosts than this meet their pages by shuffle instead of broadcast (a row is a name and a number).
BROADCAST_HOSTS = 50_000
#: So many pages with different text must agree on a constant before it is template: inside of what tags name the
#: article, and elsewhere.
WITNESSES, FEW_WITNESSES = 5, 2

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>script|style|noscript|template|svg|iframe|object|textarea|select)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</(?P=raw)\s*>|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)",
    re.S | re.I,
)
HINT = re.compile(r"\b(class|id|role|hidden|style|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements, and words of a class, id or role, that hold anything but the article.
ASIDE = frozenset("head title nav footer aside form button label fieldset dialog menu".split())
WORDS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion nav navbar navigation menu masthead footer sidebar aside widget widgets cookie cookies consent notice notices notification banner gdpr popup modal overlay newsletter subscribe subscription comment comments respond disqus share sharing social related breadcrumb breadcrumbs pagination pager skip contentinfo complementary search dialog alert toolbar".split())
HEADERS = frozenset("header banner masthead topbar".split())
MAIN = frozenset("article main".split())
#: First parts of compound names that speak of something else than the element itself.
OTHERS = frozenset("has no not is with without category cat tag in".split())
#: What a new block of this kind closes.
CLOSES = {"p": {"p"}, "li": {"li", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "tr": {"tr", "td", "th", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "option": {"option"}}


def says(names: str, words: frozenset) -> bool:
    """Whether a class, id or role names one of the words: whole, or as the first or last part of a compound."""
    for name in names.split():
        parts = [p for p in re.split(r"[^a-z0-9]+", name) if p]
        if parts and parts[0] not in OTHERS and (parts[0] in words or parts[-1] in words):
            return True
    return False


@dataclass(eq=False, slots=True)
class Element:
    """A block element: its tag and names are what it is aligned by."""

    key: tuple
    parent: Element | None = None
    kids: list[Element | Text] = field(default_factory=list)
    is_main: bool = False
    by_tag: bool = False  # aside by its tag, or hidden
    by_name: bool = False  # aside by a class, id or role
    heads: bool = False  # a header, which belongs to the article only inside it
    main: bool = False
    aside: bool = False


@dataclass(eq=False, slots=True)
class Text:
    """A text block; shared: all pages have this text."""

    text: str
    parent: Element
    linked: bool
    shared: bool = False
    place: Place | int | None = None

    @property
    def key(self) -> tuple:
        return ("#text", self.text) if self.shared else ("#text",)  # no tag has this name


@dataclass(eq=False)
class Place:
    """A part of the wrapper: an element or a text, in a sequence; constant: its one text."""

    key: tuple
    repeated: bool = False
    optional: bool = False
    constant: str | None = None
    kids: list[Place] = field(default_factory=list)

    def expression(self) -> str:
        inner = "".join(k.expression() for k in self.kids)
        out = (self.constant or "#") if self.key[0] == "#text" else f"<{self.key[0]}>{inner}</{self.key[0]}>"
        return f"({out})*" if self.repeated else f"({out})?" if self.optional else out


def parse(page: str) -> tuple[Element, list[Text]]:
    """The tree of a page and its text blocks in order; elements know whether they are of the article or aside."""
    root = Element(("",))
    every, texts, stack = [root], [], [root]
    words: list[str] = []
    link_depth = linked = 0

    def flush() -> None:
        nonlocal linked
        if not words:
            return
        text = " ".join(html.unescape("".join(words)).split())
        if text:
            texts.append(Text(text, stack[-1], linked >= 0.8 * len(text)))
            stack[-1].kids.append(texts[-1])
        words.clear()
        linked = 0

    at = 0
    for m in TOKEN.finditer(page):
        if m.start() > at:
            words.append(page[at : m.start()])
            linked += link_depth and len(words[-1])
        at = m.end()
        name, close, rest = m.group("name", "close", "rest")
        if not name:
            continue
        name = name.lower()
        if name == "a":
            link_depth = 0 if close else 1
        if name in INLINE:
            if name == "br":
                words.append(" ")
            continue
        flush()
        if close:
            if len(stack) > 1 and stack[-1].key[0] == name:
                stack.pop()
            elif any(e.key[0] == name for e in stack[1:]):
                while stack.pop().key[0] != name:
                    pass
            continue
        if name in CLOSES:
            while len(stack) > 1 and stack[-1].key[0] in CLOSES[name]:
                stack.pop()
        if "=" in rest or "hidden" in rest:
            hints = {h[1].lower(): (h[2] or h[3] or h[4] or "").lower() for h in HINT.finditer(rest)}
            names = " ".join(hints[k] for k in ("class", "id", "role") if k in hints)
            e = Element((name, *sorted({re.sub(r"\d+", "", x) for x in names.split()})), stack[-1])
            e.is_main = name in MAIN or hints.get("role") in MAIN
            e.by_tag = name in ASIDE or "hidden" in hints or hints.get("aria-hidden") == "true" or bool(re.search(r"display\s*:\s*none", hints.get("style", "")))
            e.by_name = name not in ("html", "body") and says(names, WORDS)
            e.heads = name == "header" or name not in ("html", "body") and says(names, HEADERS)
        else:
            e = Element((name,), stack[-1])
            e.is_main, e.by_tag, e.heads = name in MAIN, name in ASIDE, name == "header"
        stack[-1].kids.append(e)
        every.append(e)
        if name not in VOID:
            stack.append(e)
    words.append(page[at:])
    flush()
    judge(every)
    return root, texts


def judge(every: list[Element]) -> None:
    """Sets main and aside of all elements of a page, parents first.

    A class says nothing against an element that holds the only article of the page, or is it.
    """
    for spared in (False, True):
        holders: set[Element] = set()
        if spared:
            for e in every:
                while e.is_main and e not in holders or e.parent is not None and holders and e in holders and e.parent not in holders:
                    holders.add(e)
                    if e.parent is None:
                        break
                    e = e.parent
                    holders.add(e)
        for e in every:
            up = e.parent
            main, aside = (up.main, up.aside) if up is not None else (False, False)
            named = e.by_name or e.heads and e.key[0] != "header"
            e.aside = aside or e.by_tag or not main and e.heads and e.key[0] == "header" or (e.by_name or not main and named) and e not in holders
            e.main = main or e.is_main and not e.aside
        if any(e.main for e in every) or not any(e.is_main for e in every):
            return


def known(kid: Element | Text) -> tuple:
    """What a child is aligned by: its key, with its constant if that is all it holds."""
    if isinstance(kid, Element) and len(kid.kids) == 1 and isinstance(kid.kids[0], Text) and kid.kids[0].shared:
        return (*kid.key, kid.kids[0].key)
    return kid.key


def infer(pages: list[Element]) -> tuple[Place, dict[Place, set[int]]]:
    """The wrapper that reads all the pages, and which pages have text at each text's place; texts get their places."""
    wrapper = Place(("",))
    todo: list[tuple[Place, list[tuple[int, Element]]]] = [(wrapper, list(enumerate(pages)))]
    seen: dict[Place, set[int]] = {}
    while todo:
        place, aligned = todo.pop()
        often: dict[tuple, list[int]] = {}
        held: dict[tuple, list[tuple[int, int, Element | Text]]] = {}
        for page, e in aligned:
            here: Counter = Counter()
            for kid in e.kids:
                key = known(kid)
                held.setdefault(key, []).append((here[key], page, kid))
                here[key] += 1
            for key, n in here.items():
                often.setdefault(key, []).append(n)
        for key, members in held.items():
            repeated = min(often[key]) != max(often[key])
            optional = len(often[key]) < len(aligned)
            parts: dict[int, list[tuple[int, Element | Text]]] = {}
            for nth, page, kid in members:
                parts.setdefault(0 if repeated else nth, []).append((page, kid))
            for part in parts.values():
                sub = Place(key, repeated, optional)
                place.kids.append(sub)
                if isinstance(part[0][1], Text):
                    seen[sub] = {page for page, _ in part}
                    if len({kid.text for _, kid in part}) == 1:
                        sub.constant = part[0][1].text
                    for _, kid in part:
                        kid.place = sub
                else:
                    todo.append((sub, part))
    return wrapper, seen


def digest(*parts) -> bytes:
    return hashlib.blake2b(repr(parts).encode("utf-8", "surrogatepass"), digest_size=16).digest()


def candidates(texts: list[Text]) -> list[Text]:
    """The blocks of a page that are text as far as its tags and classes tell."""
    main = [t for t in texts if t.parent.main and not t.parent.aside]
    return main or [t for t in texts if not t.parent.aside and not t.linked]


def share(texts: list[Text], shared: set[str]) -> None:
    for t in texts:
        t.shared = t.text in shared


def versions(kept: list[int], rest: list[int]) -> bool:
    """Whether the pages are versions of one article: of blocks and of characters, less than half are no constants."""
    return not any(2 * r >= k for k, r in zip(kept, rest, strict=True))


def size(blocks: list[Text]) -> list[int]:
    return [len(blocks), sum(len(t.text) for t in blocks)]


def extract(pages: list[str], wrapped: bool = True) -> list[str]:
    """The main text of each page of one host, read through the wrapper inferred from all of them.

    A place whose text is one constant on all pages that have text is template, if enough of them differ elsewhere;
    where constants are most of the blocks and most of the length of what would be text, the pages are versions of one
    article and keep them. Of the other places, those inside what tags name the article are text; on pages without
    one, those that are neither aside nor links. Without ``wrapped`` nothing is learned from the other pages.
    """
    read = [parse(p) for p in pages]
    kept = [candidates(texts) for _, texts in read]
    contents: dict[tuple, int] = {}
    # Pages that tell something: equal ones, and those without text, are no further witnesses.
    telling = [i for i, (_, texts) in enumerate(read) if texts]
    if wrapped and len(telling) >= FEW_WITNESSES:
        for i in telling:
            here = contents.setdefault(tuple(t.text for t in read[i][1]), i)
            if here != i and digest(pages[i]) < digest(pages[here]):
                contents[tuple(t.text for t in read[i][1])] = i
    if len(contents) < FEW_WITNESSES:
        return ["\n".join(t.text for t in k) for k in kept]
    shared = set.intersection(*map(set, contents))
    for i in telling:
        share(read[i][1], shared)
    _, seen = infer([read[i][0] for i in telling])
    constant = {p for p, here in seen.items() if p.constant is not None and len(here) == len(telling)}
    sure = len(contents) >= WITNESSES
    rest = [[t for t in k if t.place not in constant or t.parent.main and not sure] for k in kept]
    sizes = [[sum(x) for x in zip(*(size(p[i]) for i in contents.values()), strict=True)] for p in (kept, rest)]
    return ["\n".join(t.text for t in k) for k in (kept if versions(*sizes) else rest)]


# ---- hosts in several groups: what a group tells, and how that is joined


class Seen:
    """Of pages of a host: up to WITNESSES different contents, the texts that all have, where these may be dropped."""

    def __init__(self):
        self.contents: set[bytes] = set()
        self.shared: set[str] | None = None
        self.main: set[str] = set()
        self.other: set[str] = set()

    def page(self, page: str) -> None:
        _, texts = parse(page)
        if texts:
            one = Seen()
            one.contents, one.shared = {digest([t.text for t in texts])}, {t.text for t in texts}
            for t in candidates(texts):
                (one.main if t.parent.main else one.other).add(t.text)
            self.join(one)

    def join(self, more: Seen) -> None:
        if more.shared is None:
            return
        self.contents = set(sorted(self.contents | more.contents)[:WITNESSES])
        self.shared = more.shared if self.shared is None else self.shared & more.shared
        self.main, self.other = ((a | b) & self.shared for a, b in ((self.main, more.main), (self.other, more.other)))

    def result(self) -> tuple | None:
        """The shared texts, those of them that the wrapper may drop, and whether it may inside the article; None: no text is dropped."""
        sure = len(self.contents) >= WITNESSES
        drops = self.other | self.main if sure else self.other
        return (self.shared, drops, sure) if len(self.contents) >= FEW_WITNESSES and drops else None


class Shape:
    """Of pages of a host: the ways down to the texts that may be dropped, as far as all pages have them.

    A way is a sequence of keys, a path one of keys and occurrences; both go by digest. ``ways``: those that every page
    with text has; ``nodes``: path -> path above, key, occurrence, way; ``counts``: path -> key -> how often elements
    there that have the key have it, at least and at most. Whether a group is repeated depends on nothing else.
    """

    TOP = digest()

    def __init__(self):
        self.ways: set[bytes] | None = None
        self.nodes: dict[bytes, tuple] = {}
        self.counts: dict[bytes, dict[tuple, tuple[int, int]]] = {}

    def pages(self, read: list[tuple[Element, list[Text]]], drops: set[str]) -> None:
        names: dict[tuple, bytes] = {}

        def name(*parts) -> bytes:
            found = names.get(parts)
            if found is None:
                found = names[parts] = digest(*parts)
            return found

        for root, texts in read:
            way, here = {root: self.TOP}, set()
            for t in texts:
                if t.text not in drops:
                    continue
                up, e = [], t.parent
                while e not in way:
                    up.append(e)
                    e = e.parent
                for x in reversed(up):
                    way[x] = name(way[x.parent], known(x))
                here.add(name(way[t.parent], t.key))
            here.update(way.values())
            self.ways = here if self.ways is None else self.ways & here
        for root, _ in read:
            todo = [(self.TOP, self.TOP, root)]
            while todo:
                path, way, e = todo.pop()
                here: Counter = Counter()
                for kid in e.kids:
                    key = known(kid)
                    down = name(way, key)
                    if down not in self.ways:
                        continue
                    sub = name(path, key, here[key])
                    self.nodes[sub] = (path, key, here[key], down)
                    here[key] += 1
                    if isinstance(kid, Element):
                        todo.append((sub, down, kid))
                self.count(path, {key: (n, n) for key, n in here.items()})

    def count(self, path: bytes, more: dict[tuple, tuple[int, int]]) -> None:
        have = self.counts.setdefault(path, {})
        for key, (low, high) in more.items():
            a, b = have.get(key, (low, high))
            have[key] = (min(a, low), max(b, high))

    def join(self, more: Shape) -> None:
        if more.ways is None:
            return
        mine = self.ways
        self.ways = more.ways if mine is None else mine & more.ways
        self.nodes.update(more.nodes)
        for path, counts in more.counts.items():
            self.count(path, counts)
        if not mine == more.ways == self.ways:
            self.nodes = {path: node for path, node in self.nodes.items() if node[3] in self.ways}
            left = {node[:2] for node in self.nodes.values()}
            self.counts = {path: here for path, counts in self.counts.items() if (here := {k: n for k, n in counts.items() if (path, k) in left})}

    def result(self) -> dict | None:
        """The wrapper: place, key -> occurrence (None: a repeated group) -> place; places are numbers, the top is 0."""
        kids = defaultdict(list)
        for path, (up, key, nth, _) in self.nodes.items():
            kids[up].append((key, nth, path))
        wrapper: dict[tuple, dict] = {}
        todo, last = [(0, [self.TOP])], 0
        while todo:
            place, paths = todo.pop()
            often: dict[tuple, list] = defaultdict(list)
            parts: dict[tuple, dict] = defaultdict(lambda: defaultdict(list))
            for path in paths:
                for key, counts in self.counts.get(path, {}).items():
                    often[key] += counts
            for path in paths:
                for key, nth, sub in kids.get(path, ()):
                    parts[key][nth if min(often[key]) == max(often[key]) else None].append(sub)
            for key, by_nth in parts.items():
                for nth, subs in by_nth.items():
                    last += 1
                    wrapper.setdefault((place, key), {})[nth] = last
                    if key[0] != "#text":
                        todo.append((last, subs))
        return wrapper or None


def settle(root: Element, wrapper: dict) -> None:
    """Gives the texts of a page their places."""
    todo = [(0, root)]
    while todo:
        place, e = todo.pop()
        here: Counter = Counter()
        for kid in e.kids:
            key = known(kid)
            parts = wrapper.get((place, key))
            if parts is None:
                continue
            sub = parts[None] if None in parts else parts[here[key]]
            here[key] += 1
            if isinstance(kid, Text):
                kid.place = sub
            else:
                todo.append((sub, kid))


def droppable(kept: list[Text], sure: bool) -> list[Text]:
    return [t for t in kept if t.place is not None and (sure or not t.parent.main)]


class Weights:
    """Of pages of a host: places that all have, and the sizes of different contents: whole, and of what may be dropped."""

    def __init__(self):
        self.places: set[int] | None = None
        self.whole = [0, 0]
        self.drops: dict[int, list[int]] = {}

    def join(self, more: Weights) -> None:
        if more.places is None:
            return
        self.places = more.places if self.places is None else self.places & more.places
        self.whole = [a + b for a, b in zip(self.whole, more.whole, strict=True)]
        drops = {p: [a + b for a, b in zip(self.drops.get(p, (0, 0)), more.drops.get(p, (0, 0)), strict=True)] for p in self.drops.keys() | more.drops.keys()}
        self.drops = {p: x for p, x in drops.items() if p in self.places}

    def result(self) -> set[int] | None:
        """The places that are template."""
        rest = [k - sum(x[i] for x in self.drops.values()) for i, k in enumerate(self.whole)]
        return None if not self.drops or versions(self.whole, rest) else self.places


def weigh(pages: list[str], shared: set[str], wrapper: dict, sure: bool) -> Iterator[tuple]:
    """For each page with text: digests of its content and of the page, its places, its Weights' sizes."""
    for page in pages:
        root, texts = parse(page)
        if texts:
            share(texts, shared)
            settle(root, wrapper)
            kept, drops = candidates(texts), defaultdict(list)
            for t in droppable(kept, sure):
                drops[t.place].append(t)
            yield digest([t.text for t in texts]), digest(page), {t.place for t in texts if t.place is not None}, size(kept), {p: size(x) for p, x in drops.items()}


def balance(rows: list[tuple]) -> Weights:
    """The weights of pages; of equal contents one counts, which is the least page."""
    out, least = Weights(), {}
    for row in rows:
        one = Weights()
        one.places = row[2]
        out.join(one)
        if row[0] not in least or row[1] < least[row[0]][1]:
            least[row[0]] = row
    for row in least.values():
        one = Weights()
        one.places, one.whole, one.drops = out.places, row[3], row[4]
        out.join(one)
    return out


def unwrap(pages: list[str], shared: set[str], wrapper: dict, sure: bool, constant: set[int]) -> list[str]:
    """The main text of pages of a host whose wrapper is known."""
    out = []
    for page in pages:
        root, texts = parse(page)
        if texts:
            share(texts, shared)
            settle(root, wrapper)
        kept = candidates(texts)
        gone = {id(t) for t in droppable(kept, sure) if t.place in constant}
        out.append("\n".join(t.text for t in kept if id(t) not in gone))
    return out


def rows_of(hosts: list, told: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array([pickle.dumps(x) for x in told], pa.binary())], ["_host", "_told"])


def joined(kind: type) -> Callable:
    """Joins what the batches of a task tell of hosts, before it goes by host."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Seen | Shape | Weights] = {}
        taken = 0
        for batch in batches:
            for host, told in zip(batch.column("_host"), batch.column("_told"), strict=True):
                told = told.as_py()
                held.setdefault(host.as_py(), kind()).join(pickle.loads(told))
                taken += len(told)
                if len(held) > HELD or taken > HELD_BYTES:
                    yield rows_of(list(held), list(held.values()))
                    held, taken = {}, 0
        yield rows_of(list(held), list(held.values()))

    return run


def by_host(told: DataFrame, kind: type) -> DataFrame:
    """_host and the pickled result of all that is told of it, where it has one."""

    def run(table: pa.Table) -> pa.Table:
        whole = kind()
        for x in table.column("_told"):
            whole.join(pickle.loads(x.as_py()))
        found = whole.result()
        return pa.Table.from_batches([rows_of(*(([], []) if found is None else ([table.column("_host")[0].as_py()], [found])))])

    told = told.mapInArrow(joined(kind), "_host string, _told binary")
    return told.groupBy("_host").applyInArrow(run, "_host string, _told binary")


def see(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the pages of a task tell of their hosts' texts."""
    held: dict[str, Seen] = {}
    taken = 0
    for batch in batches:
        for host, page in zip(batch.column("_host"), batch.column("html"), strict=True):
            host, page = host.as_py(), page.as_py() or ""
            here = held.setdefault(host, Seen())
            taken += len(page) if here.shared is None else 0  # later pages add nothing to the texts that all have
            here.page(page)
            if len(held) > HELD or taken > HELD_BYTES:
                yield rows_of(list(held), list(held.values()))
                held, taken = {}, 0
    yield rows_of(list(held), list(held.values()))


def meet(rows: DataFrame, hosts: DataFrame, groups: DataFrame, run: Callable, schema: str) -> DataFrame:
    """Each group of pages with the row of its host, which ``run`` gets by name (a group has one host, but for equal hashes)."""
    known_hosts = hosts.join(groups, "_host").select("_group", F.col("_host").alias("_name"), *(c for c in hosts.columns if c != "_host"))

    def both(pages: pa.Table, told: pa.Table) -> pa.Table:
        return run(pages, {row.pop("_name"): {c: pickle.loads(x) for c, x in row.items() if c != "_group"} for row in told.to_pylist()})

    return rows.groupBy("_group").cogroup(known_hosts.groupBy("_group")).applyInArrow(both, schema)


def split(pages: pa.Table) -> Iterator[tuple[str, list[int], list[str]]]:
    """The hosts of a group, their rows and pages."""
    at = defaultdict(list)
    for i, host in enumerate(pages.column("_host").to_pylist()):
        at[host].append(i)
    every = pages.column("html").to_pylist()
    for host, here in at.items():
        yield host, here, [every[i] or "" for i in here]


def shape_group(pages: pa.Table, told: dict[str, dict]) -> pa.Table:
    out = {}
    for host, _, here in split(pages):
        if host in told:
            shared, drops, _ = told[host]["seen"]
            read = [(root, texts) for root, texts in map(parse, here) if texts]
            for _, texts in read:
                share(texts, shared)
            out[host] = Shape()
            out[host].pages(read, drops)
    return pa.Table.from_batches([rows_of(list(out), list(out.values()))])


def weigh_group(pages: pa.Table, told: dict[str, dict]) -> pa.Table:
    out = {}
    for host, at, here in split(pages):
        if host in told:
            shared, _, sure = told[host]["seen"]
            buckets = -(-pages.column("_deal")[at[0]].as_py() // BUCKET)
            for row in weigh(here, shared, told[host]["wrapper"], sure):
                old = out.get((host, row[0]))
                if old is None:
                    out[host, row[0]] = [int.from_bytes(row[0][:4], "big") % buckets, row, row[2]]
                else:
                    old[1:] = [min(old[1], row, key=lambda x: x[1]), old[2] & row[2]]
    found = [(host, bucket, (*row[:2], places, *row[3:])) for (host, _), (bucket, row, places) in out.items()]
    return pa.table({"_host": pa.array([x[0] for x in found], pa.string()), "_bucket": pa.array([x[1] for x in found], pa.int64()), "_told": pa.array([pickle.dumps(x[2]) for x in found], pa.binary())})


def balance_bucket(table: pa.Table) -> pa.Table:
    return pa.Table.from_batches([rows_of([table.column("_host")[0].as_py()], [balance([pickle.loads(x.as_py()) for x in table.column("_told")])])])


def unwrap_group(pages: pa.Table, told: dict[str, dict]) -> pa.Table:
    """The text of each page of a group: by its host's wrapper, by the group's own where that is the whole host, else by its tags."""
    found = [""] * pages.num_rows
    for host, at, here in split(pages):
        if host in told:
            shared, _, sure = told[host]["seen"]
            texts = unwrap(here, shared, told[host]["wrapper"], sure, told[host]["constant"])
        else:
            texts = extract(here, wrapped=pages.column("_deal")[at[0]].as_py() == 1)
        for i, text in zip(at, texts, strict=True):
            found[i] = text
    return pa.table({"page_id": pages.column("page_id"), "url": pages.column("url"), "text": pa.array(found, pa.string())})


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every page; a null, empty or textless html gives an empty text.

    Pages meet by host (all without one together). A host of more than GROUP pages or GROUP_BYTES is dealt by hash
    into groups; its wrapper is that of all its pages, however they are dealt. A page alone is read by its tags.
    Repeated rows are read each; identical ones are one witness, and where a host has more than GROUP pages of one
    html, these are groups of their own. Markup cut off at the end is read as far as it goes. An empty table gives no
    rows.
    """
    spark = pages.sparkSession
    bound_batches(spark)
    scratch = Scratch(spark, "html")
    host = F.coalesce(F.lower(F.regexp_extract(F.col("url"), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))
    rows = pages.select("page_id", "url", "html", host.alias("_host"), F.xxhash64("html").alias("_html"))
    counts = rows.groupBy("_host", "_html").agg(F.count("*").alias("_n"), F.sum(F.coalesce(F.octet_length("html"), F.lit(0))).alias("_b"))
    # A row for each host, and one for each html that a host has more often than a group holds.
    deals = scratch.save(counts.groupBy("_host").agg(F.greatest(F.ceil(F.sum("_n") / F.lit(GROUP)), F.ceil(F.sum("_b") / F.lit(GROUP_BYTES)), F.lit(1)).alias("_deal")))
    copies = scratch.save(counts.where(F.col("_n") > GROUP).select("_host", "_html", F.ceil(F.col("_n") / F.lit(GROUP)).alias("_copies")))

    def small(table: DataFrame) -> DataFrame:
        return F.broadcast(table) if table.count() <= BROADCAST_HOSTS else table

    rows = rows.join(small(deals), "_host").join(small(copies), ["_host", "_html"], "left")

    # One key for host and share: grouping by the pair would settle for rows that already lie together by host alone.
    def dealt(nth):
        return F.xxhash64("_host", nth)

    def copied(nth):
        return F.xxhash64("_host", "_html", F.lit("copies"), nth)

    mine = F.when(F.col("_copies").isNull(), dealt(F.pmod(F.xxhash64("page_id", "url", "html"), F.col("_deal"))))
    rows = rows.withColumn("_group", F.coalesce(mine, copied(F.pmod(F.monotonically_increasing_id(), F.col("_copies")))))
    rows = rows.select("page_id", "url", "html", "_host", "_deal", "_group")
    kinds = {c: pages.schema[c].dataType.simpleString() for c in ("page_id", "url")}
    schema = f"page_id {kinds['page_id']}, url {kinds['url']}, text string"

    told = None
    many = deals.where("_deal > 1")
    if not many.isEmpty():
        numbered = many.select("_host", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_deal").cast("long") - 1)).alias("_nth"))
        again = copies.select("_host", "_html", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_copies").cast("long") - 1)).alias("_nth"))
        groups = numbered.select("_host", dealt(F.col("_nth")).alias("_group")).union(again.select("_host", copied(F.col("_nth")).alias("_group")))
        seen = rows.where("_deal > 1").select("_host", "html").mapInArrow(see, "_host string, _told binary")
        told = scratch.save(by_host(seen, Seen).withColumnRenamed("_told", "seen"))
        # Hosts are done with as soon as nothing of them can be dropped.
        for name, told_by in (("wrapper", shape_group), ("constant", weigh_group)):
            if told.isEmpty():
                break
            some = rows.join(small(told.select("_host")), "_host", "left_semi")
            if name == "wrapper":
                found = by_host(meet(some, told, groups, told_by, "_host string, _told binary"), Shape)
            else:
                weighed = meet(some, told, groups, told_by, "_host string, _bucket long, _told binary")
                found = by_host(weighed.groupBy("_host", "_bucket").applyInArrow(balance_bucket, "_host string, _told binary"), Weights)
            before, told = told, scratch.save(told.join(found.withColumnRenamed("_told", name), "_host"))
            scratch.drop(before)
            scratch.release()
    if told is None or told.isEmpty():
        out = rows.groupBy("_group").applyInArrow(lambda table: unwrap_group(table, {}), schema)
    else:
        out = meet(rows, told, groups, unwrap_group, schema)
    return out.withColumn("n_chars", F.length("text").cast("long"))
