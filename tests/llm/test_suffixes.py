"""Suffix-array dedup against brute force over all strings."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepanel.llm import suffixes


def brute(rows, length):
    first = {}
    for key, text in rows:
        body = (text or "").encode()
        for s in {body[i : i + length] for i in range(len(body) - length + 1)}:
            first[s] = min(first.get(s, suffixes.LAST), suffixes.LAST if key is None else key)
    out = []
    for key, text in rows:
        body = (text or "").encode()
        gone = bytearray(len(body))
        for i in range(len(body) - length + 1):
            if first[body[i : i + length]] < (suffixes.LAST if key is None else key):
                gone[i : i + length] = b"\1" * length
        left = bytes(b for b, g in zip(body, gone) if not g)
        out.append((key, len(body), sum(gone), len([g for g in bytes(gone).split(b"\0") if g]), hashlib.sha256(left).hexdigest()))
    return sorted(out, key=repr)


def made(seed, n):
    random.seed(seed)
    passage = "".join(random.choice("abcdé ") for _ in range(400))
    rows = []
    for i in range(n):
        parts = []
        for _ in range(random.randint(1, 6)):
            a = random.randint(0, 380)
            parts.append(random.choice([passage[a : a + random.randint(5, 200)], "".join(random.choice("abc") for _ in range(30)), "ab" * random.randint(1, 60)]))
        rows.append((random.choice([i, i, i // 2, None]), "".join(parts)))
    return rows


@pytest.mark.parametrize("length,gram,hot,array", [(50, 16, 5000, 1 << 20), (50, 16, 3, 2000), (20, 16, 0, 500), (7, 16, 2, 100)])
def test_deduplicate(spark, docs, none, monkeypatch, length, gram, hot, array):
    monkeypatch.setattr(suffixes, "ARRAY", array)
    extra = spark.createDataFrame(made(length, 60), "doc_id long, text string").repartition(5)
    rows = docs.select("doc_id", "text").where("length(text) < 10000 OR text IS NULL").unionByName(extra)
    clash = rows.select("*", *(F.lit("x").alias(c) for c in ("t", "first", "hash", "key", "n_bytes", "gone")))
    # The array's bound is passed on to workers by value here.
    got = suffixes.deduplicate(clash, length=length, gram=gram, hot=hot, digest=True)
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute([tuple(r) for r in rows.collect()], length)
    assert suffixes.deduplicate(none).collect() == []


def test_long_texts_and_bytes_left(spark):
    random.seed(1)
    same = "".join(random.choice("ab \n") for _ in range(200_000))
    rows = [(1, same), (2, "x" * 300_000), (3, "new " + same + "日本"), (4, "y" + "x" * 300_000 + "y"), (5, "short")]
    got = {r.doc_id: (r.n_removed, r.n_spans, bytes(r.kept)) for r in suffixes.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == (0, 0, same.encode()) and got[2][0] == 0 and got[5] == (0, 0, b"short")
    assert got[3] == (len(same), 1, "new 日本".encode()) and got[4] == (300_000, 1, b"yy")


def test_arrays_are_what_all_pairs_give():
    rng = np.random.default_rng(2)
    for length in (3, 8, 9, 20, 50):
        body = rng.integers(97, 99, 400).astype(np.uint8)
        body[100:200] = body[250:350]
        places = np.sort(rng.choice(400 - length, 200, replace=False))
        ids = rng.integers(0, 6, 200)
        strings = [bytes(body[p : p + length]) for p in places]
        ranks = suffixes.suffix_classes(body, places, length)
        assert all((ranks[i] < ranks[j]) == (strings[i] < strings[j]) for i in range(200) for j in range(200))
        known = suffixes.grams(body, length)[places]
        assert (suffixes.suffix_classes(body, places, length, known) == np.unique(ranks, return_inverse=True)[1]).all()
        # Hashes that different strings share change nothing.
        assert (suffixes.suffix_classes(body, places, length, known % np.uint64(3)) == ranks).all()
        want = [any(strings[j] == strings[i] and ids[j] < ids[i] for j in range(200)) for i in range(200)]
        assert suffixes.earlier(body, places, ids, length).tolist() == want
        whole = np.zeros(0, np.uint8)
        assert suffixes.earlier(whole, np.zeros(0, np.int64), np.zeros(0, np.int64), length).tolist() == []


def test_anchors_of_equal_strings_are_equal():
    rng = np.random.default_rng(3)
    body = rng.integers(0, 256, 300).astype(np.uint8)
    there = suffixes.anchors(np.concatenate([rng.integers(0, 256, 77).astype(np.uint8), body]), 50, 16)
    assert (there[77:] == suffixes.anchors(body, 50, 16)).all()
    hashes = suffixes.grams(body, 16)
    assert (suffixes.anchors(body, 50, 16) == [hashes[i : i + 35].min().view(np.int64) for i in range(251)]).all()
