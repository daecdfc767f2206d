"""The filter audit against a plain replay in Python."""

import collections
import itertools
import re

import pytest
from pyspark.sql import functions as F

from tidepanel.llm import filter_audit

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def replayed(rows, labels):
    """rows: (doc_id, text, source)."""
    good, toxic = ({i for i, *v in labels if v[n] == 1 and i is not None} for n in (0, 1))
    firsts = {}
    for i, text, _ in rows:
        if i is not None:
            firsts[text or ""] = min(i, firsts.get(text or "", i))
    flags = []
    for i, text, part in rows:
        text = text or ""
        w = WORDS.findall(text)
        first = firsts.get(text)
        failed = {
            "A": len(w) < 200,
            "B": 100 * len(set(w)) < 50 * len(w),
            "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text),
            "D": re.search("[#$%&*|]", text) is not None,
            "E": first is not None and (i is None or i > first),
        }
        flags.append((part or "", {f for f, bad in failed.items() if bad}, i in good, i in toxic))
    out = collections.Counter()
    for part, failed, g, t in flags:
        for order in itertools.permutations("ABCDE"):
            gone = False
            for step, f in enumerate(order, 1):
                at = (part, "".join(order), step)
                out[at, "seen"] += 1
                out[at, "unique_fails"] += failed == {f}
                out[at, "redundant"] += gone and f in failed
                if not gone and f in failed:
                    gone = True
                    out[at, "removed"] += 1
                    out[at, "good_lost"] += g
                    out[at, "toxic_lost"] += t
                    out[part, f] += 1
                out[at, "kept"] += not gone
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
    return sorted((*at, *(out[at, n] for n in names), out[at[0], at[1][at[2] - 1]]) for at, n in list(out) if n == "seen")


LABELS = [(1, 1, 0), (2, 0, 1), (2, None, None), (3, 1, 1), (9, 1, 1), (None, 1, 1), (77, 1, 1)]


@pytest.mark.parametrize("broadcast", [True, False])
def test_audit(spark, docs, none, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(filter_audit, "small", lambda df, size: df)
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    more = spark.createDataFrame([(20, "Word " * 250, None), (21, " ".join(f"w{i}" for i in range(300)), "t"), (22, "A # " * 3, "t"), (None, " ".join(f"w{i}" for i in range(300)), "t"), (None, "only here", "t")], "doc_id long, text string, source string")
    rows = docs.select("doc_id", "text", "source").unionByName(more)
    # Columns with the names of those made on the way.
    clash = rows.select("*", *(F.lit("x").alias(c) for c in ("mask", "part", "digest", "first", "good", "step", "n")))
    got = filter_audit.audit(clash, labels)
    assert sorted(map(tuple, got.collect())) == replayed([tuple(r) for r in rows.collect()], LABELS)
    assert filter_audit.audit(none, labels).collect() == []
    assert got.count() == 600 * rows.select(F.coalesce("source", F.lit(""))).distinct().count()


def test_replay_of_other_filters(spark):
    flags = spark.createDataFrame([("a", 0), ("a", 1), ("a", 3), ("b", 2)], "part string, mask int")
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.shapley) for r in filter_audit.replay(flags, "XY").collect()}
    assert got["a", "XY", 1] == (1, 2, 0, 1, 3) and got["a", "XY", 2] == (1, 0, 1, 0, 1)
    assert got["a", "YX", 1] == (2, 1, 0, 0, 1) and got["b", "YX", 2] == (0, 0, 0, 0, 0)
    assert len(got) == 8
