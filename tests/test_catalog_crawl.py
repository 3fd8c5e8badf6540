"""Catalog, duplicates, crawl state, HTML zones, claims and evaluation: known answers."""

import pytest
from pyspark.sql import functions as F

from mimansa.operators import catalog, claims, crawl, dedup, evaluate, zones
from mimansa.sources import files, sinks
from mimansa.streaming import pages
from tests.conftest import rows

RAW = "row_id long, brand_name string, manufacturer string, price_inr string, is_discontinued string, dosage_form string, num_active_ingredients string, primary_ingredient string, primary_strength string, active_ingredients string, pack_size string, pack_unit string"


def raw(spark, *changes):
    base = {"brand_name": "Dolo  650", "manufacturer": "M", "price_inr": "10", "is_discontinued": "False", "dosage_form": "tabs", "num_active_ingredients": "1", "primary_ingredient": "Para", "primary_strength": "650mg", "active_ingredients": "[]", "pack_size": "10", "pack_unit": "Strip"}
    names = [c.split()[0] for c in RAW.split(", ")]
    return spark.createDataFrame([tuple({**base, "row_id": i, **c}[n] for n in names) for i, c in enumerate(changes)], RAW)


def test_cleaning(spark):
    df = raw(
        spark, {}, {"brand_name": "dolo 650"}, {"is_discontinued": "TRUE"}, {"brand_name": " "}, {"dosage_form": None}, {"manufacturer": None}, {"price_inr": "0"}, {"price_inr": "Rs 4"}, {"primary_ingredient": None},
        {"primary_strength": "varies"}, {"primary_strength": "x", "active_ingredients": "[{'name': 'A', 'strength': '', 'full_description': 'A (5 mg)'}]"}, {"num_active_ingredients": "2.0", "active_ingredients": "[{'name': 'b'}, {'name': 'A'}]"},
    )
    got = {r["outcome"]: r["n_rows"] for r in catalog.audit(df).collect()}
    assert got == {"accepted": 3, "duplicate_record": 1, "discontinued": 1, "missing_brand": 1, "missing_dosage_form": 1, "missing_manufacturer": 1, "invalid_price": 2, "missing_salt": 1, "unparseable_strength": 1}
    kept = {r.row_id: r for r in catalog.clean(df).collect()}
    assert (kept[0].brand, kept[0].form, kept[0].strength_value, kept[0].strength_unit) == ("Dolo 650", "tablet", 650.0, "mg")
    assert (kept[10].strength_value, kept[10].strength_unit) == (5.0, "mg")
    assert (kept[11].salt, kept[11].strength_value, kept[11].is_combination) == ("A + b", None, True)
    with pytest.raises(ValueError, match="missing columns"):
        catalog.check_columns(df.drop("brand_name"))
    assert catalog.audit(df.limit(0)).count() == 0


def test_query_parser():
    assert catalog.parse_query("dolo 650 mg tablets ka sasta generic".split()) == ("dolo", 650.0, "mg", "tablet", None, False)
    assert catalog.parse_query("x 40 40mg sr".split()) == ("x", 40.0, "mg", None, "sr", False)
    assert catalog.parse_query("x 40 mg 20".split())[5]
    assert catalog.parse_query("y extended release drops".split()) == ("y", None, None, "drop", "extended release", False)
    assert catalog.parse_query([]) == ("", None, None, None, None, False)


RECORDS = "row_id long, brand string, salt string, strength_value double, strength_unit string, form string"


def products(spark):
    return spark.createDataFrame(
        [(1, "testbranda", "s", 10.0, "mg", "tablet"), (2, "otherbrandq", "s", 10.0, "mg", "Tablets"), (3, "xylophoneq", "t", 10.0, "mg", "tablet"), (4, "testbranda", None, None, None, None), (5, "Dolo 650 Tablet", "p", 650.0, "mg", "tablet")], RECORDS
    )


def asked(spark, *queries):
    return spark.createDataFrame([(f"q{i}", q) for i, q in enumerate(queries, 1)], "query_id string, query string")


def test_matching(spark):
    found = catalog.search(products(spark), asked(spark, "testbranda", "testbranda 20 mg", "dolo 650 tablet", "testbranda 10 mg 20 mg", "", "testbranda 10 mcg"))
    got = rows(found, "query_id", "rank", "row_id")
    assert got == [("q1", 1, 1), ("q1", 2, 2), ("q3", 1, 5)]
    assert rows(catalog.match_exact(products(spark), asked(spark, "DOLO", "dolo-650 tablet", "other", "")), "query_id", "row_id") == [("q1", 5), ("q2", 5)]
    assert rows(catalog.match_phonetic(products(spark), asked(spark, "Dolloo", "")), "query_id", "row_id") == [("q1", 5)]
    assert catalog.search(products(spark).limit(0), asked(spark, "x")).count() == 0


def test_near_duplicates(spark):
    long = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, long), (2, long.upper()), (3, long + " tail"), (4, "other"), (5, ""), (6, None), (7, "")], "doc_id long, text string")
    pairs, members = dedup.near_duplicates(docs)
    assert rows(pairs, "a", "b") == [(1, 3)]
    assert rows(members) == [(1, 1), (2, 1), (3, 3), (4, 4), (5, 5), (6, 5), (7, 5)]
    assert rows(dedup.hash_groups(docs), "first_id", "copies") == [(5, 2)]
    assert dedup.near_duplicates(docs.limit(0))[0].count() == 0


LOG = "seq long, url string, fetched_at string, status string, content_hash string, etag string, last_modified string, g_score double"


def log(spark):
    return spark.createDataFrame(
        [
            (1, "u", "t1", "ok", "h1", "e1", None, 0.5), (2, "u", "t2", "ok", "h1", None, None, 0.5), (3, "u", "t3", "not_modified", None, "e3", None, None), (4, "u", "t4", "ok", "h2", "e4", "m", 0.7),
            (5, "v", "t5", "not_modified", None, None, None, None), (6, "w", "t6", "ok", "h", None, None, None), (7, "w", "t7", "not_modified", None, "", None, None), (8, "w", "t8", "error", None, None, None, None), (9, None, "t9", "ok", "h", None, None, None),
        ],
        LOG,
    )


def test_page_state(spark):
    got = {r.url: (r.content_hash, r.fetched_at, r.last_changed_at, r.etag, r.n_versions) for r in crawl.page_state(log(spark)).collect()}
    assert got == {"u": ("h2", "t4", "t4", "e4", 3), "w": ("h", "t7", "t6", None, 1)}
    assert rows(crawl.changes(log(spark)), "url", "seq", "old_hash", "new_hash") == [("u", 4, "h1", "h2")]
    assert rows(crawl.adaptive_intervals(log(spark)), "url", "interval") == [("u", 3600 * 1.5 * 1.5 * 0.5), ("w", 5400.0)]
    assert crawl.page_state(log(spark).limit(0)).count() == 0


def test_stream_agrees_with_batch(spark, tmp_path):
    log(spark).repartition(1).write.parquet(str(tmp_path / "in"))
    out: list = []
    stream = pages.page_events(spark.readStream.schema(log(spark).schema).parquet(str(tmp_path / "in")).where("url is not null"))
    pages.run_available(stream, lambda df, _: out.extend(df.collect()), str(tmp_path / "cp"))
    last = {r.url: (r.content_hash, r.fetched_at, r.last_changed_at) for r in sorted(out, key=lambda r: r.seq)}
    assert last == {r.url: (r.content_hash, r.fetched_at, r.last_changed_at) for r in crawl.page_state(log(spark)).collect()}
    assert [r.event for r in sorted(out, key=lambda r: r.seq) if r.url == "u"] == ["first", "unchanged", "refreshed", "changed"]


def test_frontier(spark):
    tasks = spark.createDataFrame([(1, "http://a/x", None, 1.0, 0.5), (2, "http://a/y", None, 2.0, None), (3, "http://b/z", 9.0, None, None), (4, "http://a/x", 99.0, None, None)], "seq long, url string, priority double, base_importance double, staleness double")
    assert rows(crawl.frontier(tasks), "url", "priority", "host_slot") == [("http://a/x", 1.5, 1), ("http://a/y", 2.0, 0), ("http://b/z", 9.0, 0)]
    assert [r.url for r in crawl.pop_order(tasks, 10.0).orderBy("popped_at").collect()] == ["http://b/z", "http://a/y", "http://a/x"]


def test_simulation(spark):
    rates = [6.0, 12.0, 24.0, 48.0, 72.0, 120.0, 6.0, 24.0, 72.0, 168.0]
    schedule = spark.createDataFrame(list(crawl.change_schedule(10, 168.0, rates, 42)), "url string, position int, changes array<double>")
    got = {r.scheduler: (r.requests, r.caught, r.occurred, round(r.staleness_hours, 2)) for r in crawl.simulate(schedule, {"fixed": (14400.0, 1.0, 1e12, 1.0, 1.0), "adaptive": (14400.0, 1800.0, 86400.0, 0.5, 1.5)}, 168.0, 500).collect()}
    assert got == {"fixed": (410, 76, 101, 17.45), "adaptive": (218, 65, 101, 34.8)}


PAGE = """<html><head><title>T</title><script>x</script></head><body><h1>Overview</h1><p>Intro</p><h2>Eligibility Criteria</h2><ul><li>Adults</li></ul>
<p>State: Bihar</p><dl><dt>Condition</dt><dd>Heart, Kidney</dd></dl><h2>Benefits</h2><table><tr><td>State</td><td>bihar</td></tr></table><h2>Eligibility and benefits</h2><p>Both</p><p>How to apply</p><p>Go there</p><h3>पात्रता</h3><p>सब</p></body></html>"""


def test_html_zones(spark):
    df = spark.createDataFrame([("u", "h", PAGE), ("v", "h", ""), ("w", "h", None)], "url string, content_hash string, html string")
    got = [(r.zone, r.text) for r in zones.zones(df).orderBy("ordinal").collect()]
    assert got == [("other", "Intro"), ("eligibility", "Adults\nState: Bihar\nCondition\nHeart, Kidney"), ("benefits", "State\nbihar"), ("other", "Both"), ("how_to_apply", "Go there"), ("eligibility", "सब")]
    first = zones.zones(df).first()
    assert (first.title, first.state, first.conditions) == ("T", "Bihar", ["Heart", "Kidney"])
    with pytest.raises(ValueError, match="unknown url"):
        zones.corpus(df, ["nowhere"])
    assert zones.extract("<p>State: Bihar</p><p>State: Goa</p>")["state"] is None


HITS = "query_id string, rank int, doc_id string, zone string, text string, url string, net double, bm25_score double"


def verdict(spark, message, *texts, net=0.9):
    m = spark.createDataFrame([("q", message)], "query_id string, message string")
    h = spark.createDataFrame([("q", i, f"d{i}", "other", t, "u", net, None if net else 1.0) for i, t in enumerate(texts, 1)], HITS)
    r = claims.verdicts(m, h).first()
    return r.label, r.cite, r.refusal_reason


def test_verdicts(spark):
    assert verdict(spark, "Pay Rs 500 fee", "There is no registration fee.", "A fee of Rs 500 applies.") == ("INSUFFICIENT_EVIDENCE", "Z1, Z2", None)
    assert verdict(spark, "Pay Rs 500000 fee", "Cover of up to Rs 5,00,000 a year for the family.")[0] == "INSUFFICIENT_EVIDENCE"
    assert verdict(spark, "apply before 01-01-2099", "Apply before 1-1-2099.") == ("SUPPORTED", "Z1", None)
    assert verdict(spark, "apply before 01-01-2099", "Apply before 2/1/99.")[0] == "CONTRADICTED"
    assert verdict(spark, "it is free", "A registration fee of Rs 10.")[0] == "CONTRADICTED"
    assert verdict(spark, "hello", "x") == ("NO_CLAIM_FOUND", None, None)
    assert verdict(spark, "it is free", "x", net=None) == ("INSUFFICIENT_EVIDENCE", None, "unsupported_bm25_evidence")


def test_gate_and_citations(spark):
    q = asked(spark, "a", "b")
    hits = spark.createDataFrame([("q1", 1, "d", "other", "alpha beta", "u", 0.5, None), ("q1", 2, "d", "benefits", "gamma", "u", 0.4, None)], HITS)
    assert rows(claims.refusals(q, hits, 0.2)) == [("q1", None), ("q2", "empty_hits")]
    assert rows(claims.refusals(q, hits, 0.6)) == [("q1", "low_retrieval_score"), ("q2", "empty_hits")]
    said = spark.createDataFrame([("q1", 0, "alpha beta", ["z1"]), ("q1", 1, "alpha", []), ("q1", 2, "alpha", ["Z1", "Z9"]), ("q1", 3, "alpha", ["d"]), ("q1", 4, "delta", ["d::benefits"])], "query_id string, sentence_index int, text string, cite_ids array<string>")
    assert rows(claims.check_citations(said, hits, 0.5), "sentence_index", "flag") == [(0, None), (1, "missing_citation"), (2, "unknown_cite_id"), (3, "unknown_cite_id"), (4, "unsupported")]
    good = lambda p: F.lit('```json\n{"claims": [{"text": "alpha", "cite_ids": ["Z1"]}]}\n```')
    assert rows(claims.answers(q, hits, good, 0.2), "query_id", "refusal_reason") == [("q1", None), ("q2", "empty_hits")]
    assert rows(claims.answers(q, hits, lambda p: F.lit("nonsense"), 0.2), "query_id", "refusal_reason")[0] == ("q1", "invalid_generation")
    assert rows(claims.answers(q, hits, lambda p: F.lit('{"claims": [{"text": "x", "cite_ids": ["Z7"]}]}'), 0.2), "query_id", "refusal_reason")[0] == ("q1", "invalid_generation")
    assert rows(claims.answers(q, hits, None, 0.2), "query_id", "refusal_reason")[0] == ("q1", "llm_not_configured")


def test_metrics(spark):
    ranked = spark.createDataFrame([("q", d, i) for i, d in enumerate(["t1", "f1", "t2", "f2", "f3", "t3"], 1)], "query_id string, doc_id string, rank int")
    truth = spark.createDataFrame([("q", d) for d in ("t1", "t2", "t3", "t4")] + [("none", "x")], "query_id string, doc_id string")
    got = {r.query_id: r for r in evaluate.ranked_metrics(ranked, truth).collect()}
    assert (got["q"].p_at_5, got["q"].recall_at_5, got["q"].top1) == (0.4, 0.5, 1.0)
    assert (got["none"].p_at_5, got["none"].set_precision, got["none"].set_recall) == (0.0, 0.0, 0.0)
    twice = spark.createDataFrame([("q", d, i) for i, d in enumerate("aba", 1)], "query_id string, doc_id string, rank int")
    few = evaluate.ranked_metrics(twice, spark.createDataFrame([("q", "a"), ("q", "c")], "query_id string, doc_id string")).first()
    assert (few.p_at_5, few.recall_at_5, few.n_returned) == (0.2, 0.5, 2)
    judged = spark.createDataFrame([("X", "X"), ("X", "Y"), ("Y", "X"), ("Y", None), ("", "X")], "gold string, predicted string")
    assert tuple(evaluate.confusion(judged, "X").first()) == (1, 1, 1, 1, 0.5, 0.5)
    assert evaluate.confusion(judged.limit(0), "X").first().precision is None


def test_files(spark, tmp_path):
    (tmp_path / "lex.csv").write_text("source,canonical\n# note\nmuft,free\ndawa,medicine tablet\n")
    assert {r.source: r.targets for r in files.lexicon(spark, str(tmp_path / "lex.csv")).collect()} == {"muft": ["free"], "dawa": ["medicine", "tablet"]}
    with pytest.raises(ValueError, match="two columns"):
        files.lexicon_rows("a,b,c")
    (tmp_path / "cat.csv").write_text("brand_name,manufacturer,price_inr,is_discontinued,dosage_form,num_active_ingredients,primary_ingredient,primary_strength,active_ingredients\n\"A \"\"x\"\"\",M,1,False,tab,1,P,1mg,[]\n")
    assert files.catalog_csv(spark, str(tmp_path / "cat.csv")).first().brand_name == 'A "x"'
    (tmp_path / "z.jsonl").write_text('{"doc_id": "a", "zone": "benefits", "text": "t"}\n')
    assert files.zone_jsonl(spark, str(tmp_path / "z.jsonl")).count() == 1
    (tmp_path / "q.csv").write_text("query_id,doc_id,relevance\nq,a,1\nq,b,0\n")
    assert rows(files.judgements(spark, str(tmp_path / "q.csv"))) == [("q", "a")]
    assert files.declared_weights(str(tmp_path / "none.json")) is None
    df = spark.createDataFrame([(None, True, 0.5)], "a string, b boolean, c double")
    assert tuple(sinks.formatted(df).first()) == ("", "true", "0.500000")
    sinks.write_metrics(df, str(tmp_path / "m"))
    assert sinks.union_rows([df, df.drop("a").withColumn("d", F.lit(1))]).columns == ["a", "b", "c", "d"]


def test_conflicts_evidence_and_policy(spark):
    rows_ = [(1, 5.0, "mg", "tablet", None, 5.0, "mg", "tablet", "sr"), (2, 5.0, "mg", None, "sr", None, None, "tablet", "sr"), (3, 5.0, "mg", "tablet", "sr", 5.0, "mg", "gel", "sr"), (4, 5.0, None, None, None, 6.0, None, None, None)]
    df = spark.createDataFrame(rows_, "id int, strength_value double, strength_unit string, form string, release string, q_strength_value double, q_strength_unit string, q_form string, q_release string")
    assert rows(df.where(catalog.recorded_conflict()), "id") == [(3,), (4,)]
    pairs = spark.createDataFrame([(1, " the card is free ", "card is free"), (2, "free", "the card is free"), (3, " ", "x"), (4, "x", None), (5, "paid", "free")], "id int, evidence string, text string")
    assert rows(pairs.where(claims.is_evidence(F.col("evidence"), F.col("text"))), "id") == [(1,), (2,)]
    answered = spark.createDataFrame([("a", False, None), ("b", False, None), ("c", True, "no_hits")], "query_id string, refused boolean, refusal_reason string")
    checks = spark.createDataFrame([("a", True), ("a", False), ("b", True)], "query_id string, supported boolean")
    assert rows(claims.apply_policy(answered, checks, " Withhold "), "query_id", "refused", "refusal_reason", "n_unsupported") == [("a", True, "citation_validation_failed", 1), ("b", False, None, 0), ("c", True, "no_hits", 0)]
    assert rows(claims.apply_policy(answered, checks, "flag"), "query_id", "refused", "n_unsupported") == [("a", False, 1), ("b", False, 0), ("c", True, 0)]
