"""The stages of the corpus pipeline on planted rows: shared and missing ids, repeated rows, clashing columns, no rows."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from tidepanel.llm import quality

from .test_text_operators import jaccard, slow_hits, slow_secrets

LEAK = "one two three four five six seven eight nine ten eleven"
SECRET = "token=0123456789abcdef01"


def text(seed, words=60):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(5000)}" for _ in range(words))


ROWS = [
    (1, text(1)), (1, text(1)), (7, text(1)), (7, text(2)), (None, text(2)), (None, text(3)), (None, f"{text(4)} {LEAK}"), (5, f"{text(5)} {LEAK}"), (5, text(6)),
    (8, text(8, 300)), (9, text(8, 300).replace("w1", "v1", 1)), (10, f"{text(10)} {SECRET}"), (10, f"{text(10)} {SECRET}"), (11, None), (12, ""), (13, " \n"), (14, text(14, 30_000)),
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "r", "b", "f") for i, t in ROWS], "doc_id long, text string, lang string, source string, n_chars long, row_number string, blob_id string, found string")
    docs = docs.unionByName(spark.createDataFrame([(100 + i, text(100 + i) if i % 2 else f"buy{i} | buy{i} | buy{i} | now", None, None, None, None, None, None) for i in range(200)], docs.schema))
    docs.repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, LEAK), (None, LEAK), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(100 + i, i % 2, 0) for i in range(200)] + [(None, 1, 0), (1, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


@pytest.fixture(scope="module")
def docs(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


def rows(df, *columns):
    return Counter(map(tuple, df.select(*(columns or df.columns)).collect()))


def test_good_rejects_what_scores_below_the_threshold(spark, docs, folder):
    got = pipeline.good(spark, docs, folder)
    assert got.columns == docs.columns
    weights = quality.fit(docs, spark.read.parquet(f"{folder}/labels.parquet").where(~quality.held_out()))
    features = quality.Features(18)

    def score(t):
        places, values = features(t)
        return quality.logistic(weights[places] @ values + weights[-1])

    assert rows(got) == rows(docs) - Counter({r: n for r, n in rows(docs).items() if score(r[1]) < quality.THRESHOLD})
    assert not got.where("text LIKE 'buy%'").count() and got.where("doc_id >= 100").count() == 100


def test_single_keeps_one_row_of_each_group(spark, docs, folder):
    got = pipeline.single(spark, docs, folder)
    assert got.columns == docs.columns
    kept = []
    for r in sorted(docs.collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0)):
        t = r.text or ""
        if not any(t == o or len(t.split()) >= 5 and len(o.split()) >= 5 and jaccard(t, o) >= 0.8 for o in kept):
            kept.append(t)
    assert Counter(r.text or "" for r in got.select("text").collect()) == Counter({t: 1 for t in kept} | ({"": 1, " \n": 0}))
    assert {r.doc_id for r in got.collect()} >= {1, 7, None, 5, 8, 10, 14}


def test_unleaked_drops_rows_not_ids(spark, docs, folder):
    got = pipeline.unleaked(spark, docs, folder)
    assert got.columns == docs.columns
    windows = {tuple(LEAK.split()[i : i + 10]): {1} for i in range(2)}
    assert rows(got) == Counter({r: n for r, n in rows(docs).items() if not slow_hits(r[1], windows)[1]})
    assert {(None, text(3)), (5, text(6))} <= set(rows(got, "doc_id", "text"))


def test_redacted_keeps_every_row(spark, docs, folder):
    got = pipeline.redacted(spark, docs, folder)
    assert got.columns == docs.columns and got.count() == docs.count()
    found = got.where("doc_id = 10").collect()
    assert len(found) == 2 and all(r.text == f"{text(10)} [secret]" and r.n_chars == len(r.text) for r in found)
    clean = lambda df: rows(df.where("doc_id IS NULL OR doc_id <> 10"))
    assert clean(got) == clean(docs) and not any(slow_secrets(r.text) for r in got.collect())


def test_tokens_decode(spark, docs, folder):
    import public_tokenizers
    import tiktoken

    from tidepanel.llm import bpe

    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    got = pipeline.tokens(spark, docs, folder).collect()
    wanted = Counter((r.doc_id, tuple(known.encode_ordinary(r.text or ""))) for r in docs.collect())
    assert Counter((r.doc_id, tuple(r.ids)) for r in got) == wanted and all(r.round_trip and r.n_tokens == len(r.ids) for r in got)


def test_whole_pipeline_and_no_rows(spark, docs, folder):
    ids = Counter(r.doc_id for r in pipeline.run(spark, folder).collect())
    assert ids[7] == 1 and ids[1] == 1 and ids[5] == 1 and ids[8] == 1 and 9 not in ids and ids[10] == 1
    none = docs.where(F.lit(False))
    for _, stage in pipeline.STAGES:
        assert stage(spark, none, folder).count() == 0
