"""Analysers, indexes, ranking, net score and search: known answers."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from mimansa import queries
from mimansa.functions import text as tx
from mimansa.functions.url import canonical_url
from mimansa.operators import index, netscore, rank, search
from tests.conftest import rows


def corpus(spark, *texts):
    return spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(texts, 1)], "doc_id string, text string")


def asked(spark, *queries):
    return spark.createDataFrame([(f"q{i}", q) for i, q in enumerate(queries, 1)], "query_id string, query string")


def scores(df):
    return {(r.query_id, r.doc_id): round(r.score, 6) for r in df.collect()}


NORMAL = {
    "Straße": "strasse", "pantocid-40, sasta kya milega?": "pantocid 40 sasta kya milega", "income 2,00,000": "income 2 00 000", "₹500": "500", "don't": "don t", "medi­cine": "medicine",
    "दवा। सस्ती!": "दवा सस्ती", "": "", " ​ ": "", "a\x00b": "ab",
}


def test_normalize(spark):
    df = spark.createDataFrame(list(NORMAL.items()), "text string, expected string")
    for column in (tx.normalize("text"), tx.normalize_exact(F.col("text"))):
        assert [tuple(r) for r in df.select("text", column).collect()] == list(NORMAL.items())
    assert spark.range(1).select(tx.normalize_exact(F.lit("ऩ"))).first()[0] == "ऩ"
    assert spark.range(1).select(tx.normalize(F.lit(None).cast("string"))).first()[0] is None


def test_small_functions(spark):
    one = spark.range(1)
    get = lambda c: one.select(c).first()[0]
    assert get(tx.tokenize(F.lit("the scheme for papa"))) == ["the", "scheme", "for", "papa"]
    assert get(tx.tokenize(F.lit("the scheme for papa"), tx.STOPWORDS)) == ["scheme", "papa"]
    for word, code in {"Robert": "R163", "Rupert": "R163", "Ashcraft": "A261", "Tymczak": "T522", "Pantocid": "P532", "Dolo": "D400", "Calpol": "C414", "650": ""}.items():
        assert get(tx.soundex_code(F.lit(word))) == code
    assert get(tx.soundex_brand(F.lit("650 Dolo"))) == "D400"
    assert sorted(get(tx.character_ngrams(F.lit("abab")))) == ["ab", "ab", "aba", "ba", "bab"]
    assert get(tx.character_ngrams(F.lit("a"))) == []
    assert get(tx.shingles(tx.shingle_words(F.lit("one two three four five six seven")))) == ["one two three four five", "two three four five six", "three four five six seven"]
    assert get(tx.shingles(tx.shingle_words(F.lit("Ayushman Bharat")))) == ["ayushman bharat"]
    assert get(tx.shingles(tx.shingle_words(F.lit("")))) == []
    assert get(tx.jaccard(F.array().cast("array<string>"), F.array().cast("array<string>"))) == 1.0
    assert get(tx.jaccard(F.array(F.lit("a")), F.array().cast("array<string>"))) == 0.0
    assert get(tx.quoted_phrase(F.lit(' "a b" '))) == "a b"
    assert get(tx.quoted_phrase(F.lit('" "'))) is None
    assert get(tx.condition_items(F.lit("Heart, Kidney"))) == ["Heart", "Kidney"]
    assert get(tx.condition_items(F.lit("It is a long story."))) == []
    for text, expected in {"650 MG": (650, "mg"), "30mg/5ml": (30, "mg/5ml"), "2%": (2, "%"), "0mg": None, "-10mg": None}.items():
        got = get(tx.parse_strength(F.lit(text)))
        assert (got and (got["value"], got["unit"])) == expected


@pytest.mark.parametrize(
    ("url", "expected"),
    [
        ("HTTP://EXAMPLE.COM:80/scheme/?utm_source=newsletter&state=UP&id=42#documents", "http://example.com/scheme?id=42&state=UP"),
        ("http://example.com/a//b///c/", "http://example.com/a/b/c"),
        ("http://example.com:8080/path", "http://example.com:8080/path"),
        ("https://example.com", "https://example.com/"),
        ("", ""), (None, ""), ("no host", "no host"), ("http://e.com/?b=&a=x y", "http://e.com/?a=x+y&b="),
    ],
)
def test_urls(url, expected):
    assert canonical_url(url) == expected


def test_cosine(spark):
    ix = index.build(corpus(spark, "heart heart scheme", "heart cover", "scheme cover cover"))
    got = scores(rank.cosine_scores(ix, asked(spark, "heart", "heart scheme", "nothing", "")))
    assert got[("q1", "d1")] == 0.792857
    assert got[("q1", "d2")] == 0.707107
    assert ("q1", "d3") not in got
    assert got[("q2", "d2")] == 0.5
    assert not [k for k in got if k[0] in ("q3", "q4")]
    assert scores(rank.cosine_scores(ix, asked(spark, "heart"), zeros=True))[("q1", "d3")] == 0
    parts = rank.contributions(ix, asked(spark, "heart scheme")).groupBy("query_id", "doc_id").agg(F.sum("product").alias("score"))
    assert scores(parts) == {("q1", d): v for (q, d), v in got.items() if q == "q2"}


def test_bm25(spark):
    ix = index.build(corpus(spark, "heart scheme", "cover notes", "other terms"))
    got = scores(rank.bm25_scores(ix, asked(spark, "heart", "heart heart")))
    assert got == {("q1", "d1"): round(math.log(5 / 3), 6), ("q2", "d1"): round(2 * math.log(5 / 3), 6)}
    flat = index.build(corpus(spark, "heart", "heart"))
    assert set(scores(rank.bm25_scores(flat, asked(spark, "heart"))).values()) == {round(0.25 * math.log(0.2), 6)}
    assert rank.bm25_scores(index.build(corpus(spark, "a").limit(0)), asked(spark, "heart")).count() == 0
    with pytest.raises(ValueError, match="token"):
        rank.bm25_scores(index.build(corpus(spark, "!!", "")), asked(spark, "heart"))


def test_indexes(spark):
    words = index.analysed(corpus(spark, "a b a", "", None, "b"))
    posts = index.postings(words)
    assert rows(posts, "term", "doc_id", "tf") == [("a", "d1", 2), ("b", "d1", 1), ("b", "d4", 1)]
    assert rows(index.positional_postings(words), "term", "doc_id", "positions")[0] == ("a", "d1", [0, 2])
    assert tuple(index.collection_stats(words, posts).first()) == (4, 2, 4, 1.0)
    assert rows(index.lookup(posts, "B!"), "doc_id") == [("d1",), ("d4",)]
    with pytest.raises(ValueError, match="term"):
        index.lookup(posts, "a b")
    with pytest.raises(ValueError, match="duplicate"):
        index.reject_duplicates(corpus(spark, "a").unionByName(corpus(spark, "b")))
    empty = index.analysed(corpus(spark, "a").limit(0))
    assert tuple(index.collection_stats(empty, index.postings(empty)).first()) == (0, 0, 0, 0.0)


def test_phrases(spark):
    words = index.analysed(corpus(spark, "alpha beta extra", "alpha extra beta", "beta alpha extra", "a a a"))
    phrases = asked(spark, "alpha beta", "a a").select("query_id", tx.tokenize("query").alias("tokens"))
    assert rows(index.phrase_starts(words, phrases), "query_id", "doc_id", "starts") == [("q1", "d1", [0]), ("q2", "d4", [0, 1])]


def test_top_k(spark):
    df = spark.createDataFrame([("q", "b", 1.0), ("q", "a", 1.0), ("q", "c", 2.0)], "query_id string, doc_id string, score double")
    assert rows(rank.top_k(df, 2), "rank", "doc_id") == [(1, "c"), (2, "a")]
    assert rank.top_k(df, 0).count() == 0
    with pytest.raises(ValueError):
        rank.top_k(df, -1)
    with pytest.raises(TypeError):
        rank.top_k(df, True)


def test_net_score(spark):
    df = spark.createDataFrame([("a", 0.5, 0.25, "benefits"), ("b", 0.5, None, "benefits"), ("c", 0.5, 0.1, "odd")], "doc_id string, cosine double, g_score double, zone string").withColumn("last_changed_at", F.lit(None).cast("string"))
    flat = {r.doc_id: (r.net, r.reason) for r in netscore.score_parts(df, netscore.NetConfig({"cosine": 2.0, "g_score": 4.0})).collect()}
    assert flat["a"] == (2.0, None)
    assert flat["b"] == (None, "unavailable: g_score")
    zoned = {r.doc_id: (r.net, r.reason) for r in netscore.score_parts(df, netscore.NetConfig({"cosine": 2.0, "g_score": 4.0}, {"benefits": 3.0})).collect()}
    assert zoned["a"] == (6.0, None)
    assert zoned["c"] == (None, "unavailable: zone_weight")
    ages = spark.createDataFrame([(0.0,), (10.0,), (-1.0,)], "age double")
    assert [r[0] for r in ages.select(netscore.freshness(F.col("age"), 10.0)).collect()] == [1.0, 0.5, None]
    stamps = spark.createDataFrame([("2025-12-31T00:00:00",), ("2025-12-31T00:00:00Z",), ("2025-12-31",), (None,)], "t string")
    assert [r[0] for r in stamps.select(netscore.age_days(F.col("t"), "2026-01-01T00:00:00")).collect()] == [1.0, None, None, None]
    for bad in ({"cosine": True}, {"odd": 1.0}, {}, {"freshness": 1.0}, {"cosine": math.inf}):
        with pytest.raises(ValueError):
            netscore.NetConfig(bad)


ZONE = "doc_id string, text string, url string, zone string, state string, conditions array<string>, g_score double, last_changed_at string"


def zone_rows(spark):
    return spark.createDataFrame(
        [("a", "alpha beta extra", "u", "benefits", "Bihar", ["Heart", "Kidney"], 0.5, None), ("b", "alpha extra beta", "u", "eligibility", None, [], None, None), ("c", "other words", "u", "benefits", "Bihar", None, 0.1, None)], ZONE
    )


def test_search(spark):
    z = zone_rows(spark)
    assert rows(search.search(z, asked(spark, '"alpha beta"'), 5), "doc_id") == [("a",)]
    assert rows(search.search(z, asked(spark, "alpha"), 5), "doc_id", "rank") == [("a", 1), ("b", 2)]
    assert rows(search.search(z, asked(spark, "alpha"), 5, {"state": None}), "doc_id") == [("b",)]
    assert rows(search.search(z, asked(spark, "alpha"), 5, {"conditions": ["heart"]}), "doc_id") == [("a",)]
    assert search.search(z, asked(spark, "alpha"), 5, {"state": "Nowhere"}).count() == 0
    assert rows(search.search(z, asked(spark, "alpha"), 5, net=netscore.NetConfig({"g_score": 1.0})), "doc_id") == [("a",)]
    with pytest.raises(ValueError, match="exclude"):
        search.search(z, asked(spark, "alpha"), 5, net=netscore.NetConfig({"cosine": 1.0}), bm25=True)
    for bad in ({"zone": "nowhere"}, {"color": "red"}):
        with pytest.raises(ValueError):
            search.search(z, asked(spark, "alpha"), 5, bad)
    same = spark.createDataFrame([("a", "alpha beta", "u", "other", None, None, None, None), ("b", "alpha beta", "u", "other", None, None, None, None)], ZONE)
    assert search.search(same, asked(spark, '"alpha beta"'), 5).count() == 0


def test_expansion(spark):
    lexicon = spark.createDataFrame([("muft", ["free"]), ("ilaaj", ["treatment", "free", "muft"])], "source string, targets array<string>")
    got = {r.query_id: r.tokens for r in search.expand(asked(spark, "muft ilaaj", "ilaaj", "x", ""), lexicon).collect()}
    assert got == {"q1": ["muft", "ilaaj", "free", "treatment"], "q2": ["ilaaj", "treatment", "free", "muft"], "q3": ["x"], "q4": []}


def stored(spark, folder, **tables):
    """Tables as parquet files in a folder, as queries read them."""
    for name, (schema, data) in tables.items():
        spark.createDataFrame(data, schema).write.parquet(str(folder / f"{name}.parquet"))
    return str(folder)


DOCUMENTS = "doc_id long, text string, lang string, source string, doc_type string, title string, n_chars long, crawled_at timestamp"


def document(doc_id, text, title=None):
    return (doc_id, text, None, None, None, title, None, None)


def test_evidence_overlap_reads_whole_texts(spark, tmp_path):
    words = [f"w{i}" for i in range(30)] + ["₹500", "दवा"]
    rng = random.Random(5)
    texts = {i: " ".join(rng.choice(words) for _ in range(rng.randrange(40))) for i in range(40)} | {90: None, 91: "", 92: "filler " * 5_000 + "w1 w2, W3 w4"}
    items = {i: " ".join(rng.choice(words) for _ in range(8)) for i in range(6)} | {7: "W1 w2 w3 w4 w4 x"}
    d = stored(spark, tmp_path, documents=(DOCUMENTS, [document(i, t, "w1 title") for i, t in texts.items()]), eval_items=("item_id long, text string", list(items.items())))
    cut = lambda t: set(re.findall(r"[₹\wऀ-ॿ]+", (t or "").lower()))
    expected = {(i, j, round(len(cut(a) & cut(b)) / len(cut(a)), 6)) for i, a in items.items() for j, b in texts.items() if len(cut(a) & cut(b)) >= 4}
    got = {(r.item_id, r.doc_id, r.overlap) for r in queries.evidence_overlap_texts(spark, d).collect()}
    assert got == expected and (7, 92, 0.8) in got
    assert queries.evidence_overlap(spark, d).count() == 0


def test_rows_divisible_by_50_are_queries(spark, tmp_path):
    data = [document(50, "\n \nfever clinic\nother words", " "), document(100, "heart valve", "Fever heart"), document(150, None), document(51, "fever heart ward", "rare"), document(1, "plain"), document(2, "fever heart")]
    d = stored(spark, tmp_path, documents=(DOCUMENTS, data))
    assert {r.query_id: r.query for r in queries.document_queries(spark, d).collect()} == {"50": "fever clinic", "100": "Fever heart", "150": ""}
    for f in (queries.tfidf_topk_rows, queries.bm25_topk_rows, queries.expanded_search_rows):
        assert {r.query_id for r in f(spark, d).collect()} == {"50", "100"}
    assert {(r.query_id, r.term) for r in queries.cosine_explain_rows(spark, d).collect()} == {("50", "fever"), ("50", "clinic"), ("100", "fever"), ("100", "heart")}
    assert rows(queries.phrase_search_rows(spark, d)) == [("100", "2", "0"), ("100", "51", "0"), ("50", "50", "0")]


def test_brand_cosines_of_stated_strengths(spark, tmp_path):
    schema = "record_id long, product_id string, brand string, salt string, strength_value double, strength_unit string, form string, mrp double, generic_price double, manufacturer string, is_combination boolean, ingredients array<string>"
    data = [(i, None, b, None, None, None, None, None, None, None, False, None) for i, b in ((50, "Dolomax 650 mg"), (100, "Kelvin tablet"), (150, "Dolomax"), (1, "Kelvin"), (2, None))]
    d = stored(spark, tmp_path, medicine_records=(schema, data))
    assert {r.query_id for r in queries.brand_cosines(spark, d).collect()} == {"150"}
    assert {r.query_id for r in queries.brand_cosines_stated(spark, d).collect()} == {"50", "100", "150"}
