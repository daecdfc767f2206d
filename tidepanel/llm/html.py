"""Main text of web pages by consensus host paths.

Each page is read once for its containers. A container's path is made of the tags and classes from the body down, digits
generalised, and its score says how much of the page's text it holds and how much else. Menus, headers, footers, asides,
forms, dialogs and hidden elements never count as text. Class names that tell of sidebars, notices, adverts or reader
comments are no more than a first guess: text so marked doesn't count for what is around it, but a marked container is a
candidate itself, at a discount. The pages of a host vote, in Spark, with their best paths; then each page is read again
and its text taken from the path with the most votes among those it has, or else from its own best container. So where a
host keeps its articles in a container with such a name, its pages overrule the guess.

Hosts vote on what lies inside a winner as well. A part with a marked name stays if, over the host's pages, its text is a
large share of theirs, differs from page to page and is no list of links: that is not what menus, adverts or notices look
like. Reader comments do look like that, so a name made of nothing but such words (``comment-list``) isn't overruled where
one of them tells of comments. A list or container without such a name goes if it holds little but links and says the same
on most pages. Pages that are copies of each other count once. A host with fewer than ``PAGES`` pages leaves it to names.

Text is cut into blocks at block-level tags; character references are decoded, white space inside a block becomes one
space, blocks are joined by two line ends. Broken markup is read as browsers do: unclosed tags end with what holds them,
comments, scripts and styles never count, a tag that the page's end cuts off is dropped, a drawing or formula that isn't
closed ends at the next tag that can't stand in one.

Null pages and urls count as empty; the text of a page without main text is empty. Paths are numbered as a page is read
and known by a hash of 64 bits, so a page costs time and memory in proportion to its length, however deep it nests. Of
paths with equally many votes, or equal scores, the least hash is first. Each row, repeated or not, comes out once with
its text and all its other columns; an empty table gives no rows. A column named like the result is replaced.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from .common import fresh_name, small_batches, stored, table

# The kinds of tags and the class names that mark what isn't main text.
BLOCKS = frozenset("address article aside blockquote body canvas caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul video".split())
CONTAINERS = frozenset("article body div main section td".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript iframe template textarea title xmp noembed noframes object".split())
FOREIGN = frozenset("svg math".split())
LISTS = frozenset("ul ol dl table".split())
#: Tags that end a drawing or formula, as they can't stand in one.
BREAKOUT = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li menu nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
APART = frozenset("head nav aside footer form button select dialog menu".split())
CLOSED_BY_BLOCK = frozenset(BLOCKS - {"option"})
MARKS = frozenset(
    "nav navigation navbar menu breadcrumb breadcrumbs header masthead banner topbar footer sidebar aside widget ad ads advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert notification popup modal overlay newsletter subscribe subscription signup login form search share sharing social comment comments respond replies disqus discussion related recommended recommendations trending toolbar pagination pager copyright disclaimer".split()
)
WELCOME = frozenset("article content entry main post story text".split())
TALK = frozenset("comment comments respond replies disqus discussion".split())
STRUCTURE = frozenset("area block body bottom box button buttons col column container content entry group holder inner item items left link links list main outer panel post posts right row section text thread title top user widget wrap wrapper".split())
TEXT_LEVEL = frozenset("p blockquote pre li dd dt td th tr span b i em strong q cite code figcaption".split())
SCOPES = {
    "li": (("li",), ("ul", "ol")), "tr": (("tr",), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
    "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "option": (("option",), ("select",)),
}
NEGATIONS = frozenset("has no with without".split())
VOTES, WINNERS = 3, 5
#: What the score of a container that class names speak against is worth, and the depth up to which deeper is better.
DISCOUNT, DEEP = 0.25, 50
#: What a host's pages need to overrule a name, or to tell a menu without one: pages, and shares of the pages' text, of
#: linked text, and of texts that differ.
PAGES, LARGE, FEW_LINKS, OWN, MANY_LINKS, SAME = 3, 0.25, 0.2, 0.8, 0.8, 0.5

_TOKEN = re.compile(r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|</[^>]*(?:>|\Z)|<[a-zA-Z][^>]*(>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_END = {tag: re.compile(rf"</{tag}\b[^>]*>", re.I) for tag in RAW}
_WORD = re.compile(r"[a-z0-9]+")
_DIGITS = re.compile(r"\d+")
_IN_FOREIGN = re.compile(r"<!--.*?-->|<(/?)([a-zA-Z][^\s/>]*)(?:[^>\"']|\"[^\"]*\"|'[^']*')*>", re.S)


class Paths:
    """The paths of a page, numbered so that a path comes after the one it extends; number 0 is the empty path."""

    def __init__(self):
        self.number: dict[tuple[int, str], int] = {}
        self.parent, self.hash, self.depth, self.marked, self.step, self.firm = [0], [0], [0], [False], [""], [False]
        self.own, self.every = [0], [0]  # characters of text, and of all that stands in its containers
        self.length, self.linked, self.digest = [0], [0], [0]  # of all text in a part: characters, those in links, sum of hashes

    def __call__(self, parent: int, step: str, marked: bool, firm: bool = False) -> int:
        key = (parent, f"{step}!" if marked else step)
        found = self.number.setdefault(key, len(self.parent))
        if found == len(self.parent):
            self.parent.append(parent)
            self.hash.append(xxhash.xxh3_64_intdigest(key[1].encode("utf-8", "surrogatepass"), self.hash[parent]))
            self.depth.append(self.depth[parent] + 1)
            self.marked.append(marked)
            self.step.append(step)
            self.firm.append(firm)
            for counts in (self.own, self.every, self.length, self.linked, self.digest):
                counts.append(0)
        return found

    def tag(self, path: int) -> str:
        return self.step[path].partition(".")[0]

    def key(self, path: int) -> int:
        """The hash as a signed number."""
        return self.hash[path] - (1 << 64) if self.hash[path] >> 63 else self.hash[path]


class _Open:
    """An open element: its path, the innermost container with its path, and what it stands in."""

    __slots__ = ("tag", "path", "inside", "part", "apart", "marked", "link", "article")

    def __init__(self, tag: str, step: str, apart: bool, marked: bool, firm: bool, above: _Open | None, paths: Paths):
        root = above is None or tag == "body"
        self.tag = tag
        self.link = tag == "a" or not root and above.link
        self.article = tag in ("article", "main") or not root and above.article
        self.apart = apart or not root and above.apart
        self.path = paths(0 if root else above.path, step, marked, firm)
        container = tag in CONTAINERS and not self.apart
        self.inside = self.path if container else 0 if root else above.inside
        #: The innermost element that votes or names decide on.
        self.part = self.path if container or marked or tag in LISTS else 0 if root else above.part
        #: Marked inside its innermost container; of containers themselves the path says so.
        self.marked = not container and (marked or not root and above.marked)


def _speaks_against(name: str, text_level: bool) -> bool:
    """Whether a class name or id tells of what isn't main text. Of a paragraph or the like each word must say so; of
    others one, unless the last one speaks for it and the first one not against it."""
    words = _WORD.findall(name)
    against = [w in MARKS and not (i and words[i - 1] in NEGATIONS) and not (w == "header" and bool(WELCOME.intersection(words))) for i, w in enumerate(words)]
    if text_level:
        return bool(against) and all(against)
    return any(against) and not (words[-1] in WELCOME and not against[0])


def _firmly(names: list[str]) -> bool:
    """Whether names tell of reader comments and of nothing else."""
    words = {w for n in names for w in _WORD.findall(_DIGITS.sub("", n))}
    return bool(words & TALK) and words <= TALK | MARKS | STRUCTURE


def _describe(tag: str, rest: str) -> tuple[str, bool, bool, bool]:
    """A tag's step of a path, whether it stands apart from all text, whether its names speak against it, and whether no
    vote overrules them."""
    if not rest or rest == "/" or tag == "a":
        return tag, False, False, False
    found = {}
    for name, value in _ATTRIBUTE.findall(rest):
        found.setdefault(name.lower(), value.strip("\"'"))
    classes = found.get("class", "").lower()
    step = tag + "".join(f".{c}" for c in sorted({_DIGITS.sub("#", c) for c in classes.split()}))
    if "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "").lower():
        return step, True, False, False
    if found.get("role", "").lower() in ("navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert"):
        return step, True, False, False
    if tag in ("html", "body", "main") or tag[0] == "h" and tag[1:].isdigit():
        return step, False, False, False
    names = [*classes.split(), found.get("id", "").lower()]
    against = [n for n in names if _speaks_against(n, tag in TEXT_LEVEL)]
    return step, False, bool(against), bool(against) and _firmly(against)


def _after_foreign(page: str, at: int, tag: str, open_tags: Counter[str]) -> int:
    """Where a drawing or formula ends that was opened before ``at``: after its end tag, or before a tag that can't stand
    in one or closes what is around it."""
    depth, within = 1, 0
    for m in _IN_FOREIGN.finditer(page, at):
        if m[2] is None:
            continue
        name, closing = m[2].lower(), bool(m[1])
        if name == tag:
            depth += -1 if closing else 0 if m[0].endswith("/>") else 1
            if not depth:
                return m.end()
        elif name in ("foreignobject", "desc", "annotation-xml") and not m[0].endswith("/>"):
            within = max(0, within + (-1 if closing else 1))
        elif not within and (name in BREAKOUT and (not closing or name in ("p", "br")) or closing and open_tags[name]):
            return m.start()
    return len(page)


def read(page: str) -> tuple[list[tuple[str, int]], Paths]:
    """The blocks of a page that may be main text, each with the path of the innermost part it stands in: a container, a
    list, or what names speak against. And the page's paths, with the characters of text and of all that stands in them."""
    stack: list[_Open] = []
    open_tags: Counter[str] = Counter()
    blocks: list[tuple[str, int]] = []
    paths = Paths()
    parts: list[str] = []
    inside, marked, part, links = 0, False, 0, 0

    def end_block() -> None:
        nonlocal links
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            parts.clear()
            if text:
                paths.every[inside] += len(text)
                if not marked:
                    paths.own[inside] += max(0, len(text) - 2 * links)
                paths.length[part] += len(text)
                paths.linked[part] += min(links, len(text))
                paths.digest[part] += xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"))
                blocks.append((text, part))
        links = 0

    def say(text: str) -> None:
        nonlocal links, inside, marked, part
        if not text:
            return
        top = stack[-1] if stack else None
        if top and top.apart:
            paths.every[top.inside] += len(text.strip())
            return
        now = (top.inside, top.marked, top.part) if top else (0, False, 0)
        if parts and now[1] != marked and text.strip():
            end_block()  # what names speak against is a block of its own
        if not parts:
            inside, marked, part = now
        parts.append(text)
        if top and top.link:
            links += len(text.strip())

    def close_to(depth: int) -> None:
        for o in stack[depth:]:
            open_tags[o.tag] -= 1
        del stack[depth:]

    at = 0
    while True:
        start = page.find("<", at)
        m = _TOKEN.match(page, start) if start >= 0 else None
        if m is None:
            if start < 0:
                say(page[at:])
                break
            rest = page[start : start + 3]
            if len(rest) < 2 or rest[1] == "/" and len(rest) < 3:  # cut off inside a tag's beginning
                say(page[at:start])
                break
            say(page[at : start + 1])
            at = start + 1
            continue
        say(page[at:start])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            for depth in range(len(stack) - 1, -1, -1) if open_tags[tag] else ():
                if stack[depth].tag == tag:
                    if tag in BLOCKS:
                        end_block()
                    close_to(depth)
                    break
                if stack[depth].tag in CONTAINERS and tag not in BLOCKS and tag != "html":
                    break  # the end of inline markup doesn't reach outside
            else:
                if tag == "p":
                    end_block()
            continue
        if tag in RAW:
            end = _END[tag].search(page, at) if not m[3].endswith("/") else None
            if end:
                at = end.end()
            elif not m[3].endswith("/") and tag != "object":  # what stands in an open object is text
                break
            continue
        if tag in FOREIGN:
            if not m[3].endswith("/"):
                at = _after_foreign(page, at, tag, open_tags)
            continue
        if tag in BLOCKS:
            end_block()
            if tag in CLOSED_BY_BLOCK and open_tags["p"]:
                for depth in range(len(stack) - 1, -1, -1):
                    if stack[depth].tag == "p":
                        close_to(depth)
                        break
                    if stack[depth].tag in CONTAINERS:
                        break
            if tag in SCOPES:
                same, scope = SCOPES[tag]
                for depth in range(len(stack) - 1, -1, -1) if any(open_tags[t] for t in same) else ():
                    if stack[depth].tag in same:
                        close_to(depth)
                        break
                    if stack[depth].tag in scope:
                        break
        elif tag == "br":
            say(" ")
        if tag in VOID or m[3].endswith("/") and tag not in BLOCKS:
            continue
        if tag == "body" and open_tags["head"]:
            close_to(next(i for i, o in enumerate(stack) if o.tag == "head"))
        step, apart, against, firm = _describe(tag, m[3].strip())
        above = stack[-1] if stack else None
        apart = apart or tag in APART or tag == "header" and not (above and above.article)
        stack.append(_Open(tag, step, apart, against, firm, above, paths))
        open_tags[tag] += 1
    end_block()
    return blocks, paths


def scores(paths: Paths) -> list[tuple[float, int]]:
    """The containers' paths with their scores, best first: the share of the page's text, times its share of the path."""
    own, every = paths.own.copy(), paths.every.copy()
    total, n = sum(own), len(own)
    under = [False] * n
    for path in range(1, n):
        under[path] = paths.marked[path] or under[paths.parent[path]]
    for path in range(n - 1, 0, -1):
        above = paths.parent[path]
        every[above] += every[path]
        if not paths.marked[path]:  # else it is no text of what is around it
            own[above] += own[path]
    out = []
    for path in range(1, n):
        tag = paths.tag(path)
        if own[path] and tag in CONTAINERS:
            prior = 1.3 if tag == "article" else 1.15 if tag == "main" or WELCOME.intersection(_WORD.findall(paths.step[path])) else 1.0
            prior *= (DISCOUNT if under[path] else 1.0) * 1.001 ** min(paths.depth[path], DEEP)
            out.append((own[path] / total * own[path] / every[path] * prior, path))
    return sorted(out, key=lambda x: (-x[0], paths.key(x[1])))


def parts(paths: Paths) -> list[tuple[int, bool, int, int, int, int]]:
    """What a page tells of its parts that a vote may decide on: path, whether names speak against it, characters, those in
    links, a hash of the text, and the characters of the whole page."""
    length, linked, digest = paths.length.copy(), paths.linked.copy(), paths.digest.copy()
    for path in range(len(length) - 1, 0, -1):
        for counts in (length, linked, digest):
            counts[paths.parent[path]] += counts[path]
    return [
        (path, paths.marked[path], length[path], linked[path], digest[path] & (1 << 63) - 1, length[0])
        for path in range(1, len(length))
        if length[path] and (paths.marked[path] and not paths.firm[path] and paths.tag(path) in BLOCKS or paths.tag(path) in LISTS | CONTAINERS and linked[path] >= MANY_LINKS * length[path])
    ]


def text_of(page: str, winners: list[int], kept: list[int] = [], cut: list[int] = []) -> str:  # noqa: B006
    """The text of a page: of the first of its host's winners that it has, or of its own best container, without parts that
    names speak against, but for those kept, and without those cut."""
    blocks, paths = read(page)
    ranked = scores(paths)
    known = {paths.key(path): path for _, path in ranked}
    chosen = next((known[w] for w in winners if w in known), None) or next((p for _, p in ranked), 0)
    stays, goes = set(kept), set(cut)
    if paths.marked[chosen] and paths.key(chosen) in stays:  # it is a part of what is around it, if that is a winner too
        around = paths.parent[chosen]
        while around and paths.tag(around) not in CONTAINERS:
            around = paths.parent[around]
        if around and paths.tag(around) != "body" and paths.key(around) in winners:
            chosen = around
    taken = [False] * len(paths.parent)
    taken[chosen] = True
    for path in range(chosen + 1, len(taken)):
        if taken[paths.parent[path]]:
            taken[path] = paths.key(path) in stays if paths.marked[path] else paths.key(path) not in goes
    return "\n\n".join(text for text, part in blocks if taken[part])


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def votes(pages: DataFrame, url: str = "url", page: str = "html") -> DataFrame:
    """``host`` with ``paths``, the hashes of its container paths with the most votes, best first, and ``kept`` and ``cut``,
    those of parts that stay in spite of their names and that go without one."""
    small_batches(pages.sparkSession)
    schema = "host string, path long, points long, marked boolean, length long, linked long, digest long, total long, whole long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), *[pa.int64()] * 5]
        names = [c.split()[0] for c in schema.split(", ")]
        for batch in batches:
            rows = []
            for name, value in zip(batch.column("host").to_pylist(), batch.column("page")):
                blocks, paths = read(value.as_py() or "")
                whole = sum(paths.digest) & (1 << 63) - 1
                for place, (score, path) in enumerate(scores(paths)[:VOTES]):
                    # A page's second choice counts half.
                    rows.append((name, paths.key(path), int(score * 1_000_000) >> place, None, 0, 0, None, 0, None))
                rows += [(name, paths.key(path), None, marked, length, linked, digest, total, whole) for path, marked, length, linked, digest, total in parts(paths)]
            columns = zip(*rows) if rows else [[]] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names=names)

    cast = pages.select(host(F.col(url)).alias("host"), F.col(page).alias("page")).mapInArrow(run, schema)
    # Copies of a page are one row of this; its groups are small, whatever host is hot.
    once = cast.groupBy("host", "path", "marked", "digest", "whole").agg(F.sum("points").alias("points"), *(F.first(c).alias(c) for c in ("length", "linked", "total")))
    told = once.groupBy("host", "path", "marked", "digest").agg(F.sum("points").alias("points"), F.count("whole").alias("pages"), *(F.sum(c).alias(c) for c in ("length", "linked", "total")))
    counted = told.groupBy("host", "path", "marked").agg(F.count("digest").alias("texts"), *(F.sum(c).alias(c) for c in ("points", "pages", "length", "linked", "total")))
    much = F.col("pages") >= PAGES
    kept = F.col("marked") & much & (F.col("length") >= LARGE * F.col("total")) & (F.col("linked") <= FEW_LINKS * F.col("length")) & (F.col("texts") >= OWN * F.col("pages"))
    cut = ~F.col("marked") & much & (F.col("linked") >= MANY_LINKS * F.col("length")) & (F.col("texts") <= SAME * F.col("pages"))
    kind = F.when(F.col("marked").isNull(), "paths").when(kept, "kept").when(cut, "cut")
    place = F.row_number().over(Window.partitionBy("host", "kind").orderBy(F.desc("points"), "path"))
    best = counted.select("host", "path", "points", kind.alias("kind")).where("kind is not null").withColumn("place", place).where((F.col("kind") != "paths") | (F.col("place") <= WINNERS))
    listed = lambda kind: F.transform(F.sort_array(F.collect_list(F.when(F.col("kind") == kind, F.struct("place", "path")))), lambda x: x["path"]).alias(kind)
    return best.groupBy("host").agg(listed("paths"), listed("kept"), listed("cut"))


def extract(pages: DataFrame, url: str = "url", page: str = "html", out: str = "text", drop_page: bool = False) -> DataFrame:
    """``pages`` with ``out``, the main text. Spark broadcasts the hosts' winners where their table is small enough for it,
    and else deals out pages by host, splitting hosts that are skewed."""
    winners = stored(votes(pages, url, page), "winners")
    kept = [c for c in pages.columns if c != out and not (drop_page and c == page)]
    name, body, *lists = (fresh_name(pages, n) for n in ("host", "body", "paths", "kept", "cut"))
    joined = pages.select(*(F.col(c) for c in kept), F.col(page).alias(body), host(F.col(url)).alias(name)).join(winners.withColumnsRenamed(dict(zip(winners.columns, (name, *lists)))), name, "left")
    joined = joined.select(*kept, body, *lists)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [text_of(value.as_py() or "", *(f.as_py() or [] for f in found)) for value, *found in zip(*(batch.column(c) for c in (body, *lists)))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(texts, pa.string())], names=[*kept, out])

    return joined.mapInArrow(run, T.StructType([*(pages.schema[c] for c in kept), T.StructField(out, T.StringType())]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages, drop_page=True).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
