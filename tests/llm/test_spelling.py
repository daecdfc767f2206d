"""Spelling variants against brute force over all pairs."""

import collections
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tidepanel.llm import spelling


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows):
    counts = collections.Counter()
    for key, text in rows:
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for word in re.findall("[a-zÀ-ÿ]+", text):
            h = zlib.crc32(f"{'' if key is None else key}:{word}".encode())
            if h % 97 == 0:
                i = h % len(word)
                word = word[:i] + word[i + 1 :]
            counts[word] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    out = {}
    for w, n in words.items():
        close = [v for v in words if near(v, w)]
        best = min(close, key=lambda v: (-words[v], v), default=None)
        out[w] = (best if best and words[best] >= 2 * n else None, n, len(close))
    found = set()
    for w, (form, n, k) in out.items():
        root = w
        while out[root][0] is not None:
            root = out[root][0]
        found.add((w, form, root, n, k, words[form] if form else None))
    return found


def told(df):
    rows = [(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("levels,block", [(6, 4000), (2, 3), (1, 2)])
def test_variants(spark, docs, none, levels, block):
    random.seed(5)
    made = ["".join(random.choice("abé") for _ in range(random.randint(5, 8))) for _ in range(900)]
    chain = ["aaaaa"] * 64 + ["aaaaab"] * 32 + ["aaaaabb"] * 16 + ["aaaaabbb"] * 8 + ["aaaaabbbb"] * 4
    tied = ["zzzzza"] * 8 + ["zzzzzb"] * 8 + ["zzzzz"] * 4 + ["ÿbcdef", "ABCDEF", "abcdef", "abcdef"] * 3 + ["x" * 3000, "x" * 3001, "x" * 2000 + "y" + "x" * 999] * 3
    more = [(i, " ".join(made[i::9])) for i in range(9)] + [(50, "-".join(chain)), (None, " ".join(tied)), (50, "5".join(made[:300]))]
    extra = spark.createDataFrame(more, "doc_id long, text string")
    rows = docs.select("doc_id", "text").unionByName(extra)
    clash = rows.select("*", *(F.lit("x").alias(c) for c in ("word", "n", "key", "block", "form")))
    got = told(spelling.variants(clash, levels=levels, block=block))
    assert got == brute([tuple(r) for r in rows.collect()])
    roots = {r[0]: r[2] for r in got}
    assert roots["aaaaabbbb"] == "aaaaa"
    assert spelling.variants(none).collect() == []


def test_near_words_of_runs_and_ends(spark):
    words = ["aaaaa", "aaaaaa", "aaaaaaa", "aabaa", "abaaa", "baaaa", "aaaab", "aaaaab", "abcde", "bcde", "abcdef", "acde", "abde", "xabcde", "abcdx", "zbcde", "bacde"]
    for levels, block in ((6, 4000), (2, 2), (1, 2), (9, 1)):
        got = spelling.near_words(spark.createDataFrame([(w,) for w in words], "word string"), levels, block).collect()
        pairs = [tuple(sorted((r.a, r.b))) for r in got]
        assert len(pairs) == len(set(pairs))
        assert set(pairs) == {(a, b) for a in words for b in words if a < b and near(a, b)}


def test_block_is_what_all_pairs_give():
    random.seed(7)
    for _ in range(200):
        words = sorted({"pre" + "".join(random.choice("abc") for _ in range(random.randint(0, 6))) for _ in range(60)})
        got = [tuple(sorted(p)) for p in spelling.Block(words, 3).pairs()]
        assert len(got) == len(set(got))
        assert set(got) == {(a, b) for a in words for b in words if a < b and near(a, b)}
