"""Votes on what lies inside a host's winner: pages whose names contradict their roles, against a plain second extractor."""

import collections
import html.parser
import random

import pytest

from tidepanel.llm import html as operator


class Truth(html.parser.HTMLParser):
    """The text of the elements with ``data-in`` without those with ``data-out`` in them; attributes that the operator
    doesn't read. Pages are well formed here."""

    def __init__(self):
        super().__init__()
        self.stack, self.parts, self.blocks = [False], [], []

    def flush(self):
        if text := " ".join("".join(self.parts).split()):
            self.blocks.append(text)
        self.parts = []

    def handle_starttag(self, tag, attrs):
        names = dict(attrs)
        if tag not in ("b", "a"):
            self.flush()
        self.stack.append("data-out" not in names and (self.stack[-1] or "data-in" in names))

    def handle_endtag(self, tag):
        if tag not in ("b", "a"):
            self.flush()
        self.stack.pop()

    def handle_data(self, data):
        if self.stack[-1]:
            self.parts.append(data)


def truth(page):
    reader = Truth()
    reader.feed(page)
    reader.flush()
    return "\n\n".join(reader.blocks)


def made(rng, kind, i):
    words = lambda n: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    menu = "".join(f"<li><a href='/{k}'>Part {k} of the site</a></li>" for k in range(9))
    talk = "".join(f"<div class='comment'><p>{words(25)}</p></div>" for _ in range(rng.randint(1, 5)))
    main = "".join(f"<p>{words(rng.randint(20, 40))} <b>{words(3)}</b></p>" for _ in range(3))
    out = f"<div class='ad' data-out><p>{words(6)}</p></div><ul data-out>{menu}</ul><div class='comment-list' data-out>{talk}</div>"
    if kind == 0:  # a recipe, its steps in what is called a menu
        body = f"<article data-in>{main}<ul class='menu-items'>" + "".join(f"<li>{words(12)}</li>" for _ in range(8)) + f"</ul>{out}</article>"
    elif kind == 1:  # an essay with a section that is named by a word of comments
        body = f"<div class='post' data-in>{main}<section class='comments-on-theory'><h2>{words(4)}</h2><p>{words(90)}</p></section>{out}</div>"
    elif kind == 2:  # a container named like a sidebar that holds the second half
        body = f"<div class='page-7' data-in>{main}<div class='sidebar-story'><p>{words(80)}</p><p>{words(9)}</p></div>{out}</div>"
    else:  # names that are right: long notices, the same on all pages, and a list of links that is the page's own
        links = "".join(f"<li><a href='/x'>{words(5)}</a></li>" for _ in range(3))
        body = f"<main data-in>{main}<ol>{links}</ol><div class='notice' data-out><p>{'we use what we use ' * 30}</p></div>{out}</main>"
    return f"<html><body><nav><ul>{menu}</ul></nav>{body}<div class='menu'>{menu}</div><footer>{words(8)}</footer></body></html>"


@pytest.fixture(scope="module")
def pages(spark):
    rng = random.Random(8)
    rows = [(i, f"http://h{i % 8}.x/{i}", made(rng, i % 4, i)) for i in range(160)]
    rows += [(1000 + i, rows[3][1], rows[3][2]) for i in range(40)]  # copies of one page
    rows += [(2000, None, None), (2001, "http://h1.x/", "")]
    return rows, spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, kept string").repartition(4)


def test_pages_overrule_names(pages):
    rows, frame = pages
    out = operator.extract(frame)
    assert out.columns == [*frame.columns, "text"]
    got = {r.page_id: r.text for r in out.collect()}
    want = {i: truth(page or "") for i, _, page in rows}
    count = lambda texts: sum((collections.Counter((i, b) for i, t in texts.items() for b in t.split("\n\n") if b)).values())
    right = sum((collections.Counter(got[i].split("\n\n")) & collections.Counter(want[i].split("\n\n"))).total() for i in want if want[i])
    assert right >= 0.95 * count(want) and right >= 0.95 * count(got), (right, count(want), count(got))
    assert sum(got[i] == want[i] for i in want) >= 0.95 * len(want)


def test_votes_are_what_counting_gives(pages):
    rows, frame = pages
    points, told = collections.Counter(), collections.defaultdict(dict)
    for _, url, page in rows:
        host = (url or "").removeprefix("http://").split("/")[0]
        _, paths = operator.read(page or "")
        for place, (score, path) in enumerate(operator.scores(paths)[: operator.VOTES]):
            points[host, paths.key(path)] += int(score * 1_000_000) >> place
        for path, marked, *counts in operator.parts(paths):
            told[host, paths.key(path), marked][page] = counts
    best = collections.defaultdict(lambda: ([], [], []))
    for (host, path), n in sorted(points.items(), key=lambda x: (-x[1], x[0][1])):
        if len(best[host][0]) < operator.WINNERS:
            best[host][0].append(path)
    for (host, path, marked), by_page in told.items():
        n, texts = len(by_page), len({digest for *_, digest, _ in by_page.values()})
        length, linked, _, total = (sum(c) for c in zip(*by_page.values()))
        if n < 3:
            continue
        if marked and length >= 0.25 * total and linked <= 0.2 * length and texts >= 0.8 * n:
            best[host][1].append(path)
        if not marked and linked >= 0.8 * length and texts <= 0.5 * n:
            best[host][2].append(path)
    got = {r.host: (r.paths, sorted(r.kept), sorted(r.cut)) for r in operator.votes(frame).collect()}
    assert got == {h: (p, sorted(k), sorted(c)) for h, (p, k, c) in best.items()}
    assert any(k for _, k, _ in got.values()) and any(c for _, _, c in got.values())


def test_few_pages_leave_it_to_names(spark):
    page = "<article><p>alpha beta gamma</p><ul class='menu-items'><li>dish one of a recipe {0}</li></ul></article>"
    few, many = ([(i, f"http://{host}/{i}", page.format(f"n{i}")) for i in range(n)] for host, n in (("few", 2), ("many", 4)))
    frame = lambda rows: spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.text for r in operator.extract(frame(few)).collect()} == {"alpha beta gamma"}
    assert {r.text for r in operator.extract(frame(many)).collect()} == {f"alpha beta gamma\n\ndish one of a recipe n{i}" for i in range(4)}
    assert operator.votes(frame(few).where("false")).count() == 0


@pytest.mark.parametrize(
    "page, text",
    [
        ("<p>Alpha</p><svg><path d='x'><p>Beta text two</p>", "Alpha\n\nBeta text two"),
        ("<p>a <svg viewBox='0'><text>label</text></svg> b</p><p>c</p>", "a b\n\nc"),
        ("<article><div>one<svg><g></div><p>two</p><svg></svg><p>three</p></article>", "one\n\ntwo\n\nthree"),
        ("<p>x</p><svg><foreignObject><div>in it</div></foreignObject><circle/></svg><p>y</p>", "x\n\ny"),
        ("<p>x</p><svg><svg/><svg><a>q</a></svg>r</svg><math><mi>e</mi></math><p>y</p>", "x\n\ny"),
        ("<p>x</p><svg/><p>y</p><math><mi>z", "x\n\ny"),
        ("<p>x</p><object data='f'><p>instead</p>", "x\n\ninstead"),
    ],
)
def test_drawings_end_as_in_browsers(page, text):
    assert operator.text_of(page, []) == text


def test_time_by_length_of_parts_and_drawings():
    import time

    def took(page):
        began = time.perf_counter()
        operator.text_of(page, [])
        return time.perf_counter() - began

    for unit in ("<ul><li>x", "<svg><p>x", "<div class='ad'>x"):
        took(unit * 100)
        assert took(unit * 20_000) < 30 * took(unit * 2_000) + 0.5, unit
