"""Spelling variant grouping: a trie self-join with active-node sets.

The vocabulary is a trie. A node's active nodes are the nodes within one edit of it: itself at distance nought, and at
distance one its siblings (a letter replaced) and its parent (a letter put in). A pair of active nodes goes down to
children by the same letter, for as long as both have one, and two words that end at such a pair are near. Each pair of
near words is met once: at the node where they part. Of a run of equal letters the last is the one put in, so the shorter
word goes on with another letter.

The top of the trie is expanded in Spark, level by level: a table holds each node with the letters that follow it, and
pairs of active nodes are joined with it twice. A prefix then names a block of words, which one task takes as a small trie
of its own; a block of more than ``block`` words is expanded by further levels in Spark instead, from the longest prefix
that its words share. Pairs of different prefixes that are left active go on by the same letters to the end: the rest of a
word is moved from one prefix to the other and looked up. So no task holds more than a block, however many words begin
alike, and a node has no more active siblings than the alphabet has letters.

A word's form is its near word that is met most, if that is met twice as often or more; forms are followed to their root
by doubling, in no more rounds than the logarithm of the longest way.

Words are runs of A-Z, a-z and U+00C0 to U+00FF, with A-Z lower-cased, of five code points and more that are met three
times and more. Some occurrences lose a letter, told by a checksum of the id and the run. Null texts have no words, and
texts and words of any length are read whole; a null id counts as an empty one in the checksum. Rows that repeat or share
an id count each for itself. Of near words that are met equally often the first in code-point order is the form. An empty
table gives no words; other columns are left out.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import drop, small_batches, stored, table

RUN = re.compile("[a-zÀ-ÿ]+")
SLIP = 97
LEAST_LENGTH = 5
LEAST = 3
BLOCK = 4000
LEVELS = 6
#: Different words that a task counts before it hands them on.
HELD = 400_000


def slipped(word: str, seed: int) -> str:
    """``word``, or without one of its letters if its checksum says so; ``seed`` is the checksum of what comes before."""
    h = zlib.crc32(word.encode(), seed)
    if h % SLIP:
        return word
    i = h % len(word)
    return word[:i] + word[i + 1 :]


def vocabulary(df: DataFrame, key: str = "doc_id", text: str = "text", least_length: int = LEAST_LENGTH, least: int = LEAST) -> DataFrame:
    """``word`` and ``n``, how often it is met."""

    def handed(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for name, body in zip(batch.column("key"), batch.column("text")):
                body = (body.as_py() or "").encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
                seed = zlib.crc32(f"{name.as_py() or ''}:".encode())
                for word, n in Counter(RUN.findall(body)).items():
                    # What is too short stays too short.
                    if len(word) >= least_length:
                        word = slipped(word, seed)
                        if len(word) >= least_length:
                            counts[word] += n
                if len(counts) > HELD:
                    yield handed(counts)
                    counts.clear()
        yield handed(counts)

    small_batches(df.sparkSession)
    met = df.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text")).mapInArrow(run, "word string, n long")
    return met.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


class Block:
    """Sorted different words that share their first ``depth`` letters, as a trie: a node is a range of the words and a
    depth."""

    def __init__(self, words: list[str], depth: int):
        self.words, self.depth, self.known = words, depth, set(words)
        self.near: list[tuple[str, str]] = []

    def children(self, low: int, high: int, depth: int) -> tuple[bool, dict[str, tuple[int, int]]]:
        """Whether a word ends at the node, and the range that each letter leads to."""
        words, out = self.words, {}
        ends = len(words[low]) == depth
        at = low + ends
        while at < high:
            letter = words[at][depth]
            stop = bisect_left(words, words[at][:depth] + chr(ord(letter) + 1), at, high)
            out[letter] = (at, stop)
            at = stop
        return ends, out

    def follow(self, u: tuple[int, int], du: int, v: tuple[int, int], dv: int, put_in: str) -> None:
        """The words below two active nodes that go on alike. A newly put in letter may not be the next one too."""
        todo = [(u, du, v, dv, put_in)]
        words = self.words
        while todo:
            u, du, v, dv, put_in = todo.pop()
            if min(u[1] - u[0], v[1] - v[0]) <= 4:
                swap = v[1] - v[0] < u[1] - u[0]
                (low, high), d, head = (v, dv, words[u[0]][:du]) if swap else (u, du, words[v[0]][:dv])
                for word in words[low:high]:
                    rest = word[d:]
                    if head + rest in self.known and not (put_in and rest[:1] == put_in):
                        self.near.append((word, head + rest))
                continue
            (u_ends, below_u), (v_ends, below_v) = self.children(*u, du), self.children(*v, dv)
            if u_ends and v_ends:
                self.near.append((words[u[0]], words[v[0]]))
            todo += [(below_u[c], du + 1, below_v[c], dv + 1, "") for c in below_u.keys() & below_v.keys() if c != put_in]

    def pairs(self) -> list[tuple[str, str]]:
        words = self.words
        todo = [(0, len(words), self.depth)]
        while todo:
            low, high, depth = todo.pop()
            if high - low < 2:
                continue
            depth = len(os.path.commonprefix([words[low], words[high - 1]]))
            _, below = self.children(low, high, depth)
            letters = list(below)
            for i, c in enumerate(letters):
                self.follow(below[c], depth + 1, (low, high), depth, c)
                for d in letters[i + 1 :]:
                    self.follow(below[c], depth + 1, below[d], depth + 1, "")
            todo += [(*r, depth + 1) for r in below.values()]
        return self.near


def _within_blocks(words: DataFrame) -> DataFrame:
    """``a``, ``b``: the near words of each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = None, []

        def done() -> pa.RecordBatch:
            near = Block(sorted(held), len(block or "")).pairs() if len(held) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([p[i] for p in near], pa.string()) for i in (0, 1)], names=["a", "b"])

        for batch in batches:
            for prefix, word in zip(batch.column("prefix").to_pylist(), batch.column("word").to_pylist()):
                if prefix != block:
                    if len(held) > 1:
                        yield done()
                    block, held = prefix, []
                held.append(word)
        yield done()

    return words.select("prefix", "word").repartition("prefix").sortWithinPartitions("prefix").mapInArrow(run, "a string, b string")


def _shared(hot: DataFrame) -> DataFrame:
    """The longest prefix of all words between ``lo`` and ``hi``, as ``block``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [os.path.commonprefix([a, b]) for a, b in zip(batch.column("lo").to_pylist(), batch.column("hi").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("prefix"), pa.array(found, pa.string())], names=["prefix", "block"])

    return hot.select("prefix", "lo", "hi").mapInArrow(run, "prefix string, block string")


def _cut(text: str, length) -> F.Column:
    return F.substring(F.col(text), F.lit(1), length)


def _levels(words: DataFrame, levels: int) -> tuple[DataFrame, list[DataFrame]]:
    """Expands ``levels`` levels of the trie below each ``block``: the pairs of active nodes left, as ``u`` and ``v``, and
    tables of the near words that ended on the way, as ``a`` and ``b``."""
    base = F.length("block")
    node = lambda j: F.struct(j.alias("depth"), _cut("word", base + j).alias("node"), F.substring(F.col("word"), base + j + 1, F.lit(1)).alias("kid"))
    steps = F.transform(F.sequence(F.lit(0), F.least(F.lit(levels - 1), F.length("word") - base)), node)
    nodes = words.select(F.inline(steps)).distinct().groupBy("depth", "node").agg(F.collect_list("kid").alias("kids"))
    nodes = stored(nodes, "nodes")
    active, near = None, []
    for j in range(levels):
        here = nodes.where(F.col("depth") == j)
        letters = here.select("node", F.filter("kids", lambda c: c != "").alias("kids"))
        born = letters.select("node", "kids", F.explode("kids").alias("c"))
        other = F.concat(F.array(F.lit("")), F.filter("kids", lambda d: d > F.col("c")))
        # The empty letter stands for the node itself.
        born = born.select(F.concat("node", "c").alias("u"), F.explode(F.transform(other, lambda d: F.concat("node", d))).alias("v"))
        if active is not None:
            u = here.select(F.col("node").alias("u"), F.col("kids").alias("ku"))
            v = nodes.where(F.col("depth").isin(j - 1, j)).select(F.col("node").alias("v"), F.col("kids").alias("kv"))
            alike = F.filter(F.array_intersect("ku", "kv"), lambda c: (c == "") | (F.concat("v", c) != F.col("u")))
            both = stored(active.join(u, "u").join(v, "v").select("u", "v", F.explode(alike).alias("c")), "active")
            near.append(both.where("c = ''").select(F.col("u").alias("a"), F.col("v").alias("b")))
            born = both.where("c <> ''").select(F.concat("u", "c").alias("u"), F.concat("v", "c").alias("v")).unionByName(born)
        active = born
    return stored(active, "active"), near


def near_words(words: DataFrame, levels: int = LEVELS, block: int = BLOCK) -> DataFrame:
    """``a``, ``b``: each pair of different strings of ``word`` that one letter put in, left out or replaced makes equal,
    once. Words don't repeat."""
    todo = words.select("word", F.lit("").alias("block"))
    found: list[DataFrame] = []
    while True:
        active, ended = _levels(todo, levels)
        todo = todo.withColumn("prefix", _cut("word", F.length("block") + levels))
        rest = F.substring(F.col("word"), F.length("u") + 1, F.length("word"))
        moved = todo.join(active, F.col("prefix") == F.col("u")).where(F.concat("v", F.substring(rest, 1, 1)) != F.col("u"))
        moved = moved.select(F.col("word").alias("a"), F.concat("v", rest).alias("b"))
        found += [*ended, moved.join(words.select(F.col("word").alias("b")), "b").select("a", "b")]
        hot = stored(todo.groupBy("prefix").agg(F.count("*").alias("n"), F.min("word").alias("lo"), F.max("word").alias("hi")).where(F.col("n") > block), "hot")
        if hot.isEmpty():
            found.append(_within_blocks(todo))
            break
        found.append(_within_blocks(todo.join(hot, "prefix", "left_anti")))
        todo = stored(todo.select("word", "prefix").join(_shared(hot), "prefix").select("word", "block"), "blocks")
    return stored(reduce(DataFrame.unionByName, found), "near")


def _roots(forms: DataFrame) -> DataFrame:
    """``word``, ``root`` for rows ``word``, ``form``: a form is met twice as often as its word, so ways are short and
    have an end."""
    roots = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = stored(roots.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        drop(roots)
        roots = after.select("word", "root")
        if after.where("moved").isEmpty():
            return roots


def variants(df: DataFrame, key: str = "doc_id", text: str = "text", levels: int = LEVELS, block: int = BLOCK) -> DataFrame:
    """``word``, ``form``, ``root``, ``n``, ``n_near`` and ``form_n`` of each word of the vocabulary."""
    words = stored(vocabulary(df, key, text), "vocabulary")
    near = near_words(words, levels, block)
    both = near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b")))
    best = both.join(words.select(F.col("word").alias("b"), "n"), "b").groupBy(F.col("a").alias("word"))
    best = best.agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n")).alias("less"), F.col("b").alias("form"))).alias("best"))
    most = -F.col("best.less")
    told = words.join(best, "word", "left").withColumn("is_form", F.coalesce(most >= 2 * F.col("n"), F.lit(False)))
    told = told.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(F.col("is_form"), F.col("best.form")).alias("form"), F.when(F.col("is_form"), most).alias("form_n"))
    told = stored(told, "forms")
    roots = _roots(told.where("form IS NOT NULL"))
    return told.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))


# The checksum is the CRC of ZIP files, by its table of 256 entries.
ORACLE = r"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda x: list_reduce(list_prepend(x, range(8)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
runs AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' AS head, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS w FROM documents),
met AS (SELECT head, w, count(*) AS n FROM runs WHERE length(w) >= 5 GROUP BY ALL),
bytes AS (SELECT w, n, flatten(list_transform(string_split(head || w, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)] ELSE [195, unicode(c) - 64] END)) AS bs FROM met),
hashed AS (SELECT w, n, xor(list_reduce(list_prepend(4294967295, bs), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM bytes, crc),
slips AS (SELECT CASE WHEN h % 97 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, n FROM hashed),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM slips WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
cuts AS (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words),
less AS (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS shorter FROM cuts),
pairs AS (SELECT word AS a, shorter AS b FROM less WHERE shorter IN (SELECT word FROM words)
  UNION SELECT x.word, y.word FROM less x JOIN less y ON x.i = y.i AND x.shorter = y.shorter AND x.word < y.word),
sides AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
best AS (SELECT a AS word, count(*) AS n_near, min_by(b, (-n, b)) AS form, max(n) AS form_n FROM sides JOIN words ON word = b GROUP BY a),
forms AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 2 * n THEN form END AS form, CASE WHEN form_n >= 2 * n THEN form_n END AS form_n FROM words w LEFT JOIN best USING (word)),
ways AS (SELECT word, word AS root FROM forms UNION ALL SELECT ways.word, forms.form FROM ways JOIN forms ON forms.word = ways.root WHERE forms.form IS NOT NULL),
ends AS (SELECT ways.word, root FROM ways JOIN forms ON forms.word = ways.root WHERE forms.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN ends USING (word)
"""
