"""Scores in blocks: the same results as from a row for each pair, without such rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from mimansa.operators import blocks, catalog, index, netscore, rank, search
from tests.conftest import rows


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    text = lambda n: " ".join(rng.choice(words[: rng.randint(1, 60)]) for _ in range(n))
    docs = spark.createDataFrame([(str(i), text(rng.randint(0, 25)) or None) for i in range(300)], "doc_id string, text string").repartition(5)
    asked = spark.createDataFrame([(f"q{i}", text(rng.randint(1, 6))) for i in range(40)] + [("none", ""), ("unknown", "zzz"), ("twin", "w0 w0")], "query_id string, query string")
    return index.build(docs), asked


def ten(scored):
    return rows(rank.top_k(scored.withColumn("score", F.round("score", 6)), 10), "query_id", "doc_id", "score", "rank")


@pytest.mark.parametrize("size", [16_384, 7])
def test_best_of_blocks(tables, monkeypatch, size):
    corpus, asked = tables
    monkeypatch.setattr(blocks, "BLOCK", size)
    assert ten(rank.cosine_best(corpus, asked, 10, 6)) == ten(rank.cosine_scores(corpus, asked))
    assert ten(rank.bm25_best(corpus, asked, 10, 6)) == ten(rank.bm25_scores(corpus, asked))
    assert rank.cosine_best(corpus, asked, 0).count() == 0


def test_best_in_batches(tables, monkeypatch):
    corpus, asked = tables
    monkeypatch.setattr(blocks, "SENT_ROWS", 20)
    assert ten(rank.bm25_best(corpus, asked, 10, 6)) == ten(rank.bm25_scores(corpus, asked))


def test_negative_scores_stay(spark):
    docs = spark.createDataFrame([(i, "heart" if i else "heart heart") for i in range(3)], "doc_id int, text string")
    asked = spark.createDataFrame([("q", "heart")], "query_id string, query string")
    corpus = index.build(docs)
    assert ten(rank.bm25_best(corpus, asked, 10, 6)) == ten(rank.bm25_scores(corpus, asked)) != []


def test_no_row_for_a_pair(tables):
    corpus, asked = tables
    plan = rank.top_k(rank.cosine_best(corpus, asked, 10, 6), 10)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "MapInArrow" in plan


def test_rounded(spark):
    x = [0.1234565, 1.0000005, 2.5, 0.9999995, -0.0000015, 123.4567895, 0.0, float("inf")]
    want = [r[0] for r in spark.createDataFrame([(v,) for v in x], "x double").select(F.round("x", 6)).collect()]
    assert blocks.rounded(np.array(x), 6).tolist() == want


def test_phrases_in_place(spark):
    docs = spark.createDataFrame([("a", "b a b a b"), ("b", "a"), ("c", "b"), ("d", None), ("e", "a b")], "doc_id string, text string").coalesce(1)
    asked = spark.createDataFrame([("p", ["a", "b"]), ("r", ["b", "a", "b"]), ("none", []), ("one", ["a"]), ("no", ["a", "zzz"])], "query_id string, tokens array<string>")
    found = index.phrase_starts(index.analysed(docs), asked)
    assert rows(found) == [("one", "a", [1, 3]), ("one", "b", [0]), ("one", "e", [0]), ("p", "a", [1, 3]), ("p", "e", [0]), ("r", "a", [0, 2])]
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_net_best_of_blocks(spark):
    rng = random.Random(5)
    zone = lambda: rng.choice(["benefits", "other", None])
    z = spark.createDataFrame(
        [(f"z{i}", " ".join(rng.choice("abcdefgh") for _ in range(6)), zone(), rng.choice([None, 0.0, rng.random()]), f"2025-{rng.randint(1, 12):02d}-01T00:00:00", None) for i in range(120)],
        "doc_id string, text string, zone string, g_score double, last_changed_at string, url string",
    ).repartition(3)
    asked = spark.createDataFrame([("1", "a"), ("2", "b c"), ("3", '"a b"')], "query_id string, query string")
    net = netscore.NetConfig({"cosine": 2.0, "g_score": 1.0, "freshness": 0.5}, {"benefits": 1.2, "other": -0.5}, 30.0, "2026-01-01T00:00:00")
    args = (z, asked, 5, {"zone": "benefits"}, net)
    assert rows(search.search(*args), "query_id", "rank", "doc_id") == rows(search.search(*args, corpus=index.build(z)), "query_id", "rank", "doc_id") != []


def test_near_brands(spark):
    names = ["dolo", "dolo 650", "dolo tablet", "dolo 650 tablet", "dola", "calpol", "650", "x", "dolo forte"]
    attributes = catalog.attributes(spark.createDataFrame([(i, n, "s", 650.0, "mg", "tablet") for i, n in enumerate(names)], "row_id int, brand string, salt string, strength_value double, strength_unit string, form string"))
    asked = catalog.parsed_queries(spark.createDataFrame([("1", "dolo"), ("2", "dolo 650 mg"), ("3", "dolo 650 tablet"), ("4", "dolo tablet"), ("5", "?"), ("6", "x")], "query_id string, query string"))
    near = catalog.near_brands(asked, attributes, 0.5)
    every = catalog.brand_cosines(asked, attributes).where("cosine >= 0.5")
    assert rows(near, "query_id", "brand", "cosine") == rows(every, "query_id", "brand", "cosine") != []
