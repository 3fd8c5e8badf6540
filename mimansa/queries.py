"""Queries over the shared tables, with the SQL that states each result where SQL can.

Floats are rounded to 6 places on both sides, arrays are written as text, ids are compared as text where ties go by id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mimansa.functions import text as tx
from mimansa.functions.url import canonical_url_udf
from mimansa.operators import catalog, claims, crawl, dedup, evaluate, index, netscore, packed, rank, search, units, zones
from mimansa.plans.support import read, spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "tfidf_topk"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


# --- values packed in fields, units ---------------------------------------------------------------------------------


@query("p1_found")
def p1_found(spark, d):
    return packed.listed_ingredients(spread(read(spark, d, "medicines")))


@query("p1_values")
def p1_values(spark, d):
    return packed.explode_packed(spread(read(spark, d, "medicines")), "active_ingredients", ["row_id"])


@query("p3_found")
def p3_found(spark, d):
    return units.common_strengths(spread(read(spark, d, "medicines")), spread(read(spark, d, "medicine_records")))


# --- the analyser and the indexes -----------------------------------------------------------------------------------

BATCH = [("q1", "cataract heart valve repair"), ("q2", "free treatment of diabetes"), ("q3", "photograph card reward"), ("q4", "children fever medicine fever"), ("q5", "योजना अस्पताल"), ("q6", "zzz unknown words")]
PHRASES = [("p1", '"heart valve repair"'), ("p2", '"free treatment of"'), ("p3", '"the old paper card"'), ("p4", '"valve heart"')]


def batch(spark: SparkSession, rows: list[tuple[str, str]] = BATCH) -> DataFrame:
    return spark.createDataFrame(rows, "query_id string, query string")


def values_sql(rows: list[tuple[str, str]]) -> str:
    return ", ".join("('" + a + "', '" + b.replace("'", "''") + "')" for a, b in rows)


def documents(spark, d) -> DataFrame:
    return spread(read(spark, d, "documents").select("doc_id", "text", "lang", "source", "doc_type", "title", "n_chars", "crawled_at"))


def norm_sql(x: str) -> str:
    gap = r"[\p{P}\p{S}\p{Z}\x{200B}\t\n\x0B\f\r\x1C-\x1F\x{85}]"
    return rf"trim(regexp_replace(regexp_replace(regexp_replace(replace(lower({x}), 'ß', 'ss'), '{gap}', ' ', 'g'), '[^\p{{L}}\p{{M}}\p{{N}} ]', '', 'g'), ' +', ' ', 'g'))"


def tokens_sql(x: str) -> str:
    return f"list_filter(string_split({norm_sql(x)}, ' '), lambda t: t <> '')"


CORPUS = f"""
w as (select cast(doc_id as varchar) as doc_id, coalesce({tokens_sql("text")}, []) as toks from documents),
tok as (select doc_id, unnest(toks) as term, generate_subscripts(toks, 1) - 1 as pos from w),
post as (select doc_id, term, count(*) as tf from tok group by all),
term as (select term, count(*) as df, sum(tf) as cf from post group by all),
n as (select count(*) as n from w)"""
QTERMS = f"""
q as (select * from (values {values_sql(BATCH)}) v(query_id, query)),
qt as (select query_id, term, count(*) as qtf from (select query_id, unnest({tokens_sql("query")}) as term from q) group by all)"""
COSINE = """
qw as (select query_id, term, (1 + log10(qtf)) * log10(n / df) as raw from qt join term using (term), n),
qn as (select query_id, term, raw, raw / nullif(sqrt(sum(raw * raw) over (partition by query_id)), 0) as wq from qw),
dn as (select doc_id, sqrt(sum(pow(1 + log10(tf), 2))) as norm from post group by all),
cos as (select query_id, doc_id, sum(wq * (1 + log10(tf)) / norm) as score from qn join post using (term) join dn using (doc_id) where wq > 0 group by all having score > 0)"""


# The queries of the rows whose id is divisible by 50: the title or, where a row has none, the first line of its text.
# Ids of zone documents are no numbers; the first 32 bits of their hash stand for one.
_ASKED = "coalesce(nullif(trim(title), ''), regexp_extract(text, '[^ \\t\\n\\r][^\\n]*', 0), '') as query"
_DQ = f"q as (select cast(doc_id as varchar) as query_id, {_ASKED} from documents where doc_id % 50 = 0)"
_ZQ = f"q as (select doc_id as query_id, {_ASKED} from zl where cast('0x' || substr(md5(doc_id), 1, 8) as bigint) % 50 = 0)"


def asked_of(rows: DataFrame) -> DataFrame:
    title, line = F.when(F.trim("title") != "", F.trim("title")), F.regexp_extract("text", r"[^ \t\n\r][^\n]*", 0)
    return rows.select(F.col("doc_id").cast("string").alias("query_id"), F.coalesce(title, line, F.lit("")).alias("query"))


def document_queries(spark, d) -> DataFrame:
    return asked_of(read(spark, d, "documents").where("doc_id % 50 = 0"))


def zone_queries(spark, d) -> DataFrame:
    return asked_of(zone_corpus(spark, d).where("conv(substr(md5(doc_id), 1, 8), 16, 10) % 50 = 0"))


def row_terms_sql(asked: str) -> str:
    return asked + QTERMS[QTERMS.index(",\nqt as") :]


@query("doc_stats", f"with {CORPUS} select doc_id, len(toks) as length, len(list_distinct(toks)) as unique_terms from w")
def doc_stats(spark, d):
    return index.doc_stats(index.analysed(documents(spark, d)))


@query("term_stats", f"with {CORPUS} select term, df, cast(cf as bigint) as cf from term")
def term_stats(spark, d):
    return index.term_stats(index.postings(index.analysed(documents(spark, d))))


@query("collection_stats", f"with {CORPUS} select (select n from n) as n_docs, (select count(*) from term) as vocabulary, cast(sum(len(toks)) as bigint) as total_terms, round(avg(len(toks)), 6) as avg_length from w")
def collection_stats(spark, d):
    words = index.analysed(documents(spark, d)).cache()
    return index.collection_stats(words, index.postings(words)).withColumn("avg_length", F.round("avg_length", 6))


@query("postings_lookup", f"with {CORPUS} select doc_id, term, cast(tf as integer) as tf from post where term = 'cataract'")
def postings_lookup(spark, d):
    return index.lookup(index.postings(index.analysed(documents(spark, d))), "Cataract").select("doc_id", "term", "tf")


@query("positional_postings", f"with {CORPUS} select term, doc_id, array_to_string(list_sort(list(pos)), ',') as positions, cast(count(*) as integer) as tf from tok group by all")
def positional_postings(spark, d):
    return index.positional_postings(index.analysed(documents(spark, d))).withColumn("positions", F.array_join(F.transform("positions", lambda x: x.cast("string")), ","))


_STOPS = ", ".join(f"'{w}'" for w in tx.STOPWORDS)


@query("stopword_index", f"with {CORPUS} select term, df, cast(cf as bigint) as cf from term where term not in ({_STOPS})")
def stopword_index(spark, d):
    return index.term_stats(index.postings(index.analysed(documents(spark, d), stopwords=tx.STOPWORDS)))


@query("parametric_buckets", "select distinct 'state' as field, coalesce(state, '<missing>') as value, doc_id from zone_docs union all select distinct 'zone', coalesce(zone, '<missing>'), doc_id from zone_docs union all select distinct 'conditions', unnest(conditions), doc_id from zone_docs")
def parametric_buckets(spark, d):
    z = spread(read(spark, d, "zone_docs"))
    return index.parametric_buckets(z, "state").unionByName(index.parametric_buckets(z, "zone")).unionByName(index.parametric_buckets(z, "conditions", True))


@query("parametric_filter", "select doc_id, zone, crawled_at from zone_docs where zone = 'benefits' and state is null")
def parametric_filter(spark, d):
    return index.matching(read(spark, d, "zone_docs"), {"zone": "Benefits", "state": None}).select("doc_id", "zone", "crawled_at")


# --- ranking --------------------------------------------------------------------------------------------------------

TOP = "select query_id, doc_id, round(score, 6) as score, rank from (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from {0}) where rank <= 10"


def top10(scored: DataFrame) -> DataFrame:
    # scores are rounded before they are ranked, so sums in another order make no other ties
    return rank.top_k(scored.withColumn("score", F.round("score", 6)), 10).select("query_id", "doc_id", "score", "rank")


@query("tfidf_topk", f"with {CORPUS}, {QTERMS}, {COSINE}, r as (select query_id, doc_id, round(score, 6) as score from cos) " + TOP.format("r"))
def tfidf_topk(spark, d):
    return top10(rank.cosine_scores(index.build(documents(spark, d)), batch(spark)))


@query("cosine_explain", f"with {CORPUS}, {QTERMS}, {COSINE} select query_id, doc_id, term, cast(tf as integer) as tf, round(wq, 6) as query_weight, round((1 + log10(tf)) / norm, 6) as doc_weight from qn join post using (term) join dn using (doc_id) where wq > 0")
def cosine_explain(spark, d):
    return explained(rank.contributions(index.build(documents(spark, d)), batch(spark)))


def explained(parts: DataFrame) -> DataFrame:
    return parts.select("query_id", "doc_id", "term", "tf", F.round("query_weight", 6).alias("query_weight"), F.round("doc_weight", 6).alias("doc_weight"))


@query("tfidf_topk_rows", f"with {CORPUS}, {row_terms_sql(_DQ)}, {COSINE}, r as (select query_id, doc_id, round(score, 6) as score from cos) " + TOP.format("r"))
def tfidf_topk_rows(spark, d):
    return top10(rank.cosine_best(index.build(documents(spark, d)), document_queries(spark, d), 10, 6))


@query("cosine_explain_rows", f"with {CORPUS}, {row_terms_sql(_DQ)}, {COSINE} select query_id, doc_id, term, cast(tf as integer) as tf, round(wq, 6) as query_weight, round((1 + log10(tf)) / norm, 6) as doc_weight from qn join post using (term) join dn using (doc_id) where wq > 0")
def cosine_explain_rows(spark, d):
    return explained(rank.contributions(index.build(documents(spark, d)), document_queries(spark, d)))


BM25 = """
raw as (select term, ln(n - df + 0.5) - ln(df + 0.5) as raw from term, n),
idf as (select term, case when raw < 0 then 0.25 * (select avg(raw) from raw) else raw end as idf from raw),
len as (select doc_id, len(toks) as dl, avg(len(toks)) over () as avgdl from w),
bm as (select query_id, doc_id, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) as score from qt join idf using (term) join post using (term) join len using (doc_id) group by all)"""


@query("bm25_topk", f"with {CORPUS}, {QTERMS}, {BM25}, r as (select query_id, doc_id, round(score, 6) as score from bm) " + TOP.format("r"))
def bm25_topk(spark, d):
    return top10(rank.bm25_scores(index.build(documents(spark, d)), batch(spark)))


@query("bm25_explain", f"with {CORPUS}, {QTERMS}, {BM25} select query_id, doc_id, term, cast(tf as integer) as tf, round(idf, 6) as idf, round(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)), 6) as product from qt join idf using (term) join post using (term) join len using (doc_id)")
def bm25_explain(spark, d):
    parts = rank.bm25_contributions(index.build(documents(spark, d)), batch(spark))
    return parts.select("query_id", "doc_id", "term", "tf", F.round("idf", 6).alias("idf"), F.round("product", 6).alias("product"))


@query("bm25_topk_rows", f"with {CORPUS}, {row_terms_sql(_DQ)}, {BM25}, r as (select query_id, doc_id, round(score, 6) as score from bm) " + TOP.format("r"))
def bm25_topk_rows(spark, d):
    return top10(rank.bm25_best(index.build(documents(spark, d)), document_queries(spark, d), 10, 6))


_PH = f"p as (select query_id, {tokens_sql('query')} as pt from (values {values_sql(PHRASES)}) v(query_id, query)), po as (select query_id, len(pt) as n, unnest(pt) as term, generate_subscripts(pt, 1) - 1 as off from p)"


@query("phrase_search", f"with {CORPUS}, {_PH}, s as (select query_id, doc_id, pos - off as start, n from tok join po using (term) group by all having count(*) = n) select query_id, doc_id, array_to_string(list_sort(list(start)), ',') as starts from s group by all")
def phrase_search(spark, d):
    words = index.analysed(documents(spark, d))
    phrases = batch(spark, PHRASES).select("query_id", tx.tokenize(tx.quoted_phrase("query")).alias("tokens"))
    return starts_of(words, phrases)


def starts_of(words: DataFrame, phrases: DataFrame) -> DataFrame:
    return index.phrase_starts(words, phrases).withColumn("starts", F.array_join(F.transform("starts", lambda x: x.cast("string")), ","))


_PHR = f"{_DQ}, p as (select query_id, {tokens_sql('query')} as pt from q), " + _PH[_PH.index("po as") :]


@query("phrase_search_rows", f"with {CORPUS}, {_PHR}, s as (select query_id, doc_id, pos - off as start, n from tok join po using (term) group by all having count(*) = n) select query_id, doc_id, array_to_string(list_sort(list(start)), ',') as starts from s group by all")
def phrase_search_rows(spark, d):
    return starts_of(index.analysed(documents(spark, d)), document_queries(spark, d).select("query_id", tx.tokenize("query").alias("tokens")))


LEXICON = [("muft", ["free"]), ("ilaaj", ["treatment"]), ("dawa", ["medicine", "tablet"]), ("heart", ["cardiac", "heart"])]
MIXED = [("x1", "muft ilaaj dawa"), ("x2", "dawa medicine"), ("x3", "Heart muft muft"), ("x4", "")]
_LEX = ", ".join(f"('{s}', {t!r})" for s, t in LEXICON)
_EXPAND = f"""
x as (select query_id, {tokens_sql("query")} as own from (values {values_sql(MIXED)}) v(query_id, query)),
lex as (select * from (values {_LEX}) v(source, targets)),
h as (select query_id, own, i, targets from (select query_id, own, unnest(own) as token, generate_subscripts(own, 1) as i from x) join lex on token = source),
a as (select query_id, own, t, min((i, j)) as place from (select query_id, own, i, unnest(targets) as t, generate_subscripts(targets, 1) as j from h) where not list_contains(own, t) group by all),
e as (select x.query_id, x.own, list(t order by place) filter (where t is not null) as added from x left join a using (query_id) group by all)"""


def lexicon(spark) -> DataFrame:
    return spark.createDataFrame(LEXICON, "source string, targets array<string>")


@query("query_expansion", f"with {_EXPAND} select query_id, array_to_string(own || coalesce(added, []), ' ') as tokens, array_to_string(coalesce(added, []), ' ') as added from e")
def query_expansion(spark, d):
    return search.expand(batch(spark, MIXED), lexicon(spark)).select("query_id", F.array_join("tokens", " ").alias("tokens"), F.array_join("added", " ").alias("added"))


@query("expanded_search", f"with {CORPUS}, {_EXPAND}, qt as (select query_id, term, count(*) as qtf from (select query_id, unnest(own || coalesce(added, [])) as term from e) group by all), {COSINE}, r as (select query_id, doc_id, round(score, 6) as score from cos) " + TOP.format("r"))
def expanded_search(spark, d):
    return top10(rank.cosine_scores(index.build(documents(spark, d)), search.prepared(batch(spark, MIXED), lexicon(spark))))


_EXPAND_ROWS = f"{_DQ}, x as (select query_id, {tokens_sql('query')} as own from q),\n" + _EXPAND[_EXPAND.index("lex as") :]


@query("expanded_search_rows", f"with {CORPUS}, {_EXPAND_ROWS}, qt as (select query_id, term, count(*) as qtf from (select query_id, unnest(own || coalesce(added, [])) as term from e) group by all), {COSINE}, r as (select query_id, doc_id, round(score, 6) as score from cos) " + TOP.format("r"))
def expanded_search_rows(spark, d):
    return top10(rank.cosine_best(index.build(documents(spark, d)), search.prepared(document_queries(spark, d), lexicon(spark)), 10, 6))


# --- zones and the net score ----------------------------------------------------------------------------------------

AS_OF = "2026-01-01T00:00:00"
NET = netscore.NetConfig({"cosine": 2.0, "g_score": 1.0, "freshness": 0.5}, {"benefits": 1.2, "documents": 0.8, "eligibility": 1.0, "how_to_apply": 1.1, "other": 0.5}, 30.0, AS_OF)
_ZL = "zl as (select * from (select *, row_number() over (partition by doc_id order by crawled_at desc nulls last, text desc nulls last) as _n from zone_docs) where _n = 1)"
_ZCORPUS = CORPUS.replace("from documents", "from zl")
_ZW = ", ".join(f"('{k}', {v})" for k, v in NET.zone_weights.items())
_SIGNALS = f"""
zw as (select * from (values {_ZW}) v(zone, zone_weight)),
sig as (
  select query_id, doc_id, score as cosine, g_score, zone_weight, last_changed_at,
    case when regexp_matches(last_changed_at, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}T[0-9]{{2}}:[0-9]{{2}}') and not regexp_matches(last_changed_at, '(Z|[+-][0-9]{{2}}:?[0-9]{{2}})$')
      then (epoch(timestamp '2026-01-01 00:00:00') - epoch(try_cast(last_changed_at as timestamp))) / 86400.0 end as age
  from cos join zl using (doc_id) left join zw using (zone)),
net as (
  select *, case when age >= 0 then 1 / (1 + age / 30.0) end as freshness from sig),
tot as (select *, (2.0 * cosine + 1.0 * g_score + 0.5 * freshness) * zone_weight as net from net)"""


def zone_corpus(spark, d) -> DataFrame:
    return search.latest(spread(read(spark, d, "zone_docs")))


def zone_signals(spark, d, asked: DataFrame | None = None) -> DataFrame:
    z = zone_corpus(spark, d)
    hits = rank.cosine_scores(index.build(z), batch(spark) if asked is None else asked).withColumnRenamed("score", "cosine")
    return netscore.score_parts(hits.join(z, "doc_id"), NET)


@query("net_score_topk", f"with {_ZL}, {_ZCORPUS}, {QTERMS}, {COSINE}, {_SIGNALS}, r as (select query_id, doc_id, round(net, 6) as score from tot where net is not null) " + TOP.format("r"))
def net_score_topk(spark, d):
    return top10(zone_signals(spark, d).where(F.col("net").isNotNull()).select("query_id", "doc_id", F.col("net").alias("score")))


@query("net_score_excluded", f"""with {_ZL}, {_ZCORPUS}, {QTERMS}, {COSINE}, {_SIGNALS}
select query_id, doc_id, 'unavailable: ' || array_to_string(list_filter([case when g_score is null then 'g_score' end, case when freshness is null then 'freshness' end, case when zone_weight is null then 'zone_weight' end], lambda x: x is not null), ', ') as reason
from tot where net is null""")
def net_score_excluded(spark, d):
    return zone_signals(spark, d).where(F.col("net").isNull()).select("query_id", "doc_id", "reason")


@query("zone_search")
def zone_search(spark, d):
    hits = search.search(zone_corpus(spark, d), batch(spark, BATCH + PHRASES + MIXED[:2]), 10, {"zone": "benefits"}, NET, lexicon=lexicon(spark))
    return hits.select("query_id", "rank", "doc_id", "cosine", "g_score", "freshness", "zone_weight", "net")


@query("net_score_topk_rows", f"with {_ZL}, {_ZCORPUS}, {row_terms_sql(_ZQ)}, {COSINE}, {_SIGNALS}, r as (select query_id, doc_id, round(net, 6) as score from tot where net is not null) " + TOP.format("r"))
def net_score_topk_rows(spark, d):
    z, mix = netscore.addends(zone_corpus(spark, d), NET)
    corpus = index.build(z, keep=("_net", *mix[1], mix[2]))
    return top10(rank.cosine_best(corpus, zone_queries(spark, d), 10, 6, mix, corpus.rows.where("_net")))


@query("net_score_excluded_rows", f"""with {_ZL}, {_ZCORPUS}, {row_terms_sql(_ZQ)}, {COSINE}, {_SIGNALS}
select query_id, doc_id, 'unavailable: ' || array_to_string(list_filter([case when g_score is null then 'g_score' end, case when freshness is null then 'freshness' end, case when zone_weight is null then 'zone_weight' end], lambda x: x is not null), ', ') as reason
from tot where net is null""")
def net_score_excluded_rows(spark, d):
    return zone_signals(spark, d, zone_queries(spark, d)).where(F.col("net").isNull()).select("query_id", "doc_id", "reason")


@query("zone_search_rows")
def zone_search_rows(spark, d):
    hits = search.search(zone_corpus(spark, d), zone_queries(spark, d), 10, {"zone": "benefits"}, NET, lexicon=lexicon(spark))
    return hits.select("query_id", "rank", "doc_id", "cosine", "g_score", "freshness", "zone_weight", "net")


@query("html_zones")
def html_zones(spark, d):
    pages = spread(read(spark, d, "stored_pages"))
    escaped = F.replace(F.replace("body", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    html = F.concat(F.lit("<p>"), F.replace(escaped, F.lit("\n"), F.lit("</p><p>")), F.lit("</p>"))
    return zones.zones(pages.select(F.col("text_path").alias("url"), F.sha2("body", 256).alias("content_hash"), html.alias("html")))


# --- duplicates -----------------------------------------------------------------------------------------------------


@query("content_hash_dups", "select sha256(text) as content_hash, min(doc_id) as first_id, count(*) as copies from documents where text is not null group by all having count(*) > 1")
def content_hash_dups(spark, d):
    return dedup.hash_groups(documents(spark, d))


_SHINGLES = r"""
sw as (select doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') as ws from documents),
sh as (
  select doc_id, case when len(ws) = 0 then [] when len(ws) < 5 then [array_to_string(ws, ' ')]
    else list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(list_slice(ws, i, i + 4), ' '))) end as s from sw)"""


@query("shingle_counts", f"with {_SHINGLES} select doc_id as id, len(s) as n_shingles from sh")
def shingle_counts(spark, d):
    return dedup.shingle_sets(documents(spark, d)).select("id", F.size("shingles").alias("n_shingles"))


_CLASSES = f"""with {_SHINGLES},
k as (select doc_id, s, md5(array_to_string(list_sort(s), '|')) as key from sh),
cl as (select key, min(doc_id) as class_id, any_value(s) as s from k group by key)"""


@query("near_duplicates", _CLASSES + """,
e as (select class_id, len(s) as n, unnest(s) as g from cl),
i as (select a.class_id as a, b.class_id as b, count(*) as c, a.n as na, b.n as nb from e a join e b using (g) where a.class_id < b.class_id group by all)
select a, b, round(c / (na + nb - c), 6) as jaccard from i where c / (na + nb - c) >= 0.8""")
def near_duplicates(spark, d):
    pairs, _ = dedup.near_duplicates(documents(spark, d))
    return pairs.withColumn("jaccard", F.round("jaccard", 6))


@query("near_duplicate_classes", _CLASSES + " select doc_id as id, class_id from k join cl using (key)")
def near_duplicate_classes(spark, d):
    return dedup.near_duplicates(documents(spark, d))[1]


@query("url_canonical")
def url_canonical(spark, d):
    urls = read(spark, d, "page_versions").select("url").unionByName(read(spark, d, "zone_docs").select("url")).unionByName(read(spark, d, "documents").select("url"))
    return spread(urls.where(F.col("url").isNotNull()).distinct()).select("url", canonical_url_udf("url").alias("canonical"))


# --- the catalog ----------------------------------------------------------------------------------------------------


@query("catalog_audit")
def catalog_audit(spark, d):
    return catalog.audit(spread(read(spark, d, "medicines")))


@query("catalog_records")
def catalog_records(spark, d):
    return catalog.clean(spread(read(spark, d, "medicines"))).withColumn("ingredients", F.to_json("ingredients"))


def product_records(spark, d) -> DataFrame:
    return spread(read(spark, d, "medicine_records").withColumnRenamed("record_id", "row_id"))



def product_queries(spark, d) -> DataFrame:
    """The stated query set: the brand, with strength and form where recorded, of every record whose id is divisible by 50."""
    rows = read(spark, d, "medicine_records").where((F.col("record_id") % 50 == 0) & F.col("brand").isNotNull())
    stated = F.concat_ws(" ", "brand", F.format_string("%.0f", "strength_value"), F.when(F.col("strength_value").isNotNull(), F.col("strength_unit")), "form")
    return rows.select(F.col("record_id").cast("string").alias("query_id"), F.col("brand").alias("query"), stated.alias("stated"))


_PQ = "pq as (select cast(record_id as varchar) as query_id, brand as query from medicine_records where record_id % 50 = 0 and brand is not null)"


@query("exact_match", f"""
with {_PQ}, n as (select record_id as row_id, {norm_sql('brand')} as name from medicine_records), q as (select query_id, {norm_sql('query')} as q from pq)
select distinct query_id, row_id from n, q where name <> '' and (name = q or (not contains(q, ' ') and string_split(name, ' ')[1] = q))""")
def exact_match(spark, d):
    return catalog.match_exact(product_records(spark, d), product_queries(spark, d))


_BLANK = lambda c: f"nullif({norm_sql(c)}, '')"
_FORM = "case " + " ".join(f"when {norm_sql('form')} = '{a}' then '{b}'" for a, b in catalog.FORMS.items()) + f" else {_BLANK('form')} end"


@query("brand_counts", f"select {_BLANK('brand')} as brand, count(*) as n_rows from medicine_records group by 1")
def brand_counts(spark, d):
    return catalog.brand_counts(catalog.attributes(product_records(spark, d)))


@query("identity_counts", f"select {_BLANK('salt')} as salt, round(strength_value, 6) as strength_value, {_BLANK('strength_unit')} as strength_unit, {_FORM} as form, count(*) as n_rows from medicine_records group by all")
def identity_counts(spark, d):
    return catalog.identity_counts(catalog.attributes(product_records(spark, d)))


@query("soundex_match")
def soundex_match(spark, d):
    return catalog.match_phonetic(product_records(spark, d), product_queries(spark, d))


@query("ngram_match")
def ngram_match(spark, d):
    return catalog.search(product_records(spark, d), product_queries(spark, d).select("query_id", F.col("stated").alias("query"))).withColumn("cosine", F.round("cosine", 6))


_GRAMS = "list_transform(range(1, greatest(length({0}), 1)), lambda i: substr({0}, i, 2)) || list_transform(range(1, greatest(length({0}) - 1, 1)), lambda i: substr({0}, i, 3))"


@query("brand_cosines", rf"""
with {_PQ}, b as (select distinct {norm_sql('brand')} as brand from medicine_records),
q as (select query_id, trim(regexp_replace({norm_sql('query')}, '(^| )([0-9]+(\.[0-9]+)?(mcg|mg|ml|iu|ug|g)?|{"|".join(catalog.FORM_WORDS)})( |$)', ' ', 'g')) as q from pq where not regexp_matches({norm_sql('query')}, '(^| )([0-9]|({"|".join([*catalog.FORM_WORDS, *catalog.RELEASES, *catalog.UNITS, *sorted(catalog.WRAPPERS)])})( |$))')),
bg as (select brand, g, count(*) as n from (select brand, unnest({_GRAMS.format("replace(brand, ' ', '')")}) as g from b where brand <> '') group by all),
qg as (select query_id, g, count(*) as n from (select query_id, unnest({_GRAMS.format("replace(q, ' ', '')")}) as g from q) group by all),
bn as (select brand, sqrt(sum(n * n)) as bn from bg group by all), qn as (select query_id, sqrt(sum(n * n)) as qn from qg group by all)
select query_id, brand, round(sum(bg.n * qg.n) / any_value(bn.bn * qn.qn), 6) as cosine from bg join qg using (g) join bn using (brand) join qn using (query_id) group by query_id, brand having sum(bg.n * qg.n) / any_value(bn.bn * qn.qn) >= 0.5""")
def brand_cosines(spark, d):
    rows = catalog.attributes(product_records(spark, d))
    parsed = catalog.parsed_queries(product_queries(spark, d)).where("strength_value is null and form is null and release is null")
    asked = product_queries(spark, d).select("query_id", tx.normalize("query").alias("_n"))
    plain = parsed.join(asked, "query_id").where(F.col("brand") == F.col("_n")).drop("_n")
    return catalog.near_brands(plain, rows, 0.5).withColumn("cosine", F.round("cosine", 6))


@query("brand_cosines_stated")
def brand_cosines_stated(spark, d):
    # every stated query, those too that name a strength, form or release, which SQL does not state
    rows = catalog.attributes(product_records(spark, d))
    return catalog.near_brands(catalog.parsed_queries(product_queries(spark, d)), rows, 0.5).withColumn("cosine", F.round("cosine", 6))


# --- crawl state ----------------------------------------------------------------------------------------------------


def fetch_log(spark, d) -> DataFrame:
    """The version log as fetches: 304 is a refresh, other codes than 200 do not count; rows logged twice count once."""
    v = read(spark, d, "page_versions").dropDuplicates(["id"])
    status = F.when(F.col("status_code") == 304, "not_modified").when(F.col("status_code") == 200, "ok").otherwise("error")
    return v.select(F.col("id").alias("seq"), "url", "fetched_at", status.alias("status"), "content_hash", "etag", "last_modified", F.lit(None).cast("double").alias("g_score"))


_LOG = """
l as (select distinct on (id) id as seq, url, fetched_at, case status_code when 304 then 'not_modified' when 200 then 'ok' else 'error' end as status, content_hash from page_versions where url is not null),
h as (select *, last_value(case when status = 'ok' then content_hash end ignore nulls) over (partition by url order by seq rows between unbounded preceding and 1 preceding) as prev_hash,
  max(case when status = 'ok' then 1 end) over (partition by url order by seq rows between unbounded preceding and 1 preceding) as seen from l where status <> 'error'),
k as (select *, case when status = 'ok' and seen = 1 then content_hash is distinct from prev_hash end as changed from h where status = 'ok' or seen = 1)"""


@query("change_log", f"with {_LOG} select url, seq, fetched_at as detected_at, prev_hash as old_hash, content_hash as new_hash from k where changed")
def change_log(spark, d):
    return crawl.changes(fetch_log(spark, d))


@query("page_state", f"""with {_LOG} select url, arg_max(content_hash, seq) filter (where status = 'ok' and content_hash is not null) as content_hash, arg_max(fetched_at, seq) as fetched_at,
arg_max(fetched_at, seq) filter (where status = 'ok' and coalesce(changed, true)) as last_changed_at, count(*) filter (where status = 'ok') as n_versions from k group by url""")
def page_state(spark, d):
    return crawl.page_state(fetch_log(spark, d)).select("url", "content_hash", "fetched_at", "last_changed_at", "n_versions")


@query("adaptive_interval", f"""with {_LOG},
s as (select url, list(coalesce(changed, false) order by seq) as steps from k where coalesce(prev_hash, '') <> '' group by url)
select url, list_reduce([3600.0::double] || list_transform(steps, lambda c: case when c then 0.5::double else 1.5::double end), lambda a, x: greatest(300.0::double, least(86400.0::double, a * x))) as interval from s""")
def adaptive_interval(spark, d):
    return crawl.adaptive_intervals(fetch_log(spark, d))


@query("latest_versions", "select url, max(id) as id from page_versions where url is not null group by url")
def latest_versions(spark, d):
    return crawl.latest_versions(read(spark, d, "page_versions")).select("url", "id")


@query("frontier_order", """
with t as (select url, min(id) as seq, arg_min(coalesce(status_code, 0), id) / 100.0 as priority from page_versions where url is not null group by url)
select url, cast(priority as double) as priority, row_number() over (partition by lower(regexp_extract(url, '^[^:]+://([^/:?#]+)', 1)) order by priority desc, seq) - 1 as host_slot from t""")
def frontier_order(spark, d):
    v = read(spark, d, "page_versions").where(F.col("url").isNotNull())
    tasks = v.select("url", F.col("id").alias("seq"), (F.coalesce("status_code", F.lit(0)) / 100.0).alias("priority"), F.lit(None).cast("double").alias("base_importance"), F.lit(None).cast("double").alias("staleness"))
    return crawl.frontier(tasks.dropDuplicates(["seq"])).select("url", "priority", F.col("host_slot").cast("bigint").alias("host_slot"))


@query("freshness_simulation")
def freshness_simulation(spark, d):
    rates = [6.0, 12.0, 24.0, 48.0, 72.0, 120.0, 6.0, 24.0, 72.0, 168.0]
    schedule = spark.createDataFrame(list(crawl.change_schedule(10, 168.0, rates, 42)), "url string, position int, changes array<double>")
    return crawl.simulate(schedule, {"fixed": (14400.0, 1.0, 1e12, 1.0, 1.0), "adaptive": (14400.0, 1800.0, 86400.0, 0.5, 1.5)}, 168.0, 500)


# --- claims and citations -------------------------------------------------------------------------------------------


def item_messages(spark, d) -> DataFrame:
    """A bounded batch of messages: the held-out items, and three claims."""
    items = read(spark, d, "eval_items").select(F.concat(F.lit("i"), F.col("item_id").cast("string")).alias("query_id"), F.col("text").alias("message"))
    extra = [("c1", "Pay Rs 500 fee for the health cover form before 01-01-2029"), ("c2", "The card is free, no registration fee"), ("c3", "what is the weather")]
    return items.unionByName(spark.createDataFrame(extra, "query_id string, message string"))


def item_hits(spark, d) -> DataFrame:
    return search.search(zone_corpus(spark, d), item_messages(spark, d).withColumnRenamed("message", "query"), 5, net=netscore.NetConfig({"cosine": 1.0}))


@query("claim_spans")
def claim_spans(spark, d):
    docs = documents(spark, d).where("text is not null").select("doc_id", F.col("text").alias("message"))
    read_ = claims.read_messages(docs).where(F.size("c_spans") > 0)
    return read_.select("doc_id", F.size("c_spans").alias("n_spans"), F.array_join(F.transform("c_amounts", lambda x: F.format_string("%.2f", x)), ",").alias("amounts"), F.col("c_free").alias("free"), F.array_join("c_deadlines", ",").alias("deadlines"))


@query("claim_amounts", r"""
with a as (select doc_id, unnest(regexp_extract_all(text, '(?i)(?:rs\.?|inr|₹)\s*([0-9][0-9,]*(?:\.[0-9]+)?)', 1)) as s from documents where text is not null)
select doc_id, count(*) as n, round(sum(cast(replace(s, ',', '') as double)), 2) as total from a group by doc_id""")
def claim_amounts(spark, d):
    each = documents(spark, d).where("text is not null").select("doc_id", F.explode(claims.amounts(F.col("text"))).alias("a"))
    return each.groupBy("doc_id").agg(F.count("*").alias("n"), F.round(F.sum("a"), 2).alias("total"))


@query("claim_verdicts")
def claim_verdicts(spark, d):
    return claims.verdicts(item_messages(spark, d), item_hits(spark, d)).withColumn("score", F.round("score", 6))


@query("refusal_gate")
def refusal_gate(spark, d):
    return claims.refusals(item_messages(spark, d), item_hits(spark, d), 0.2)


@query("citation_check")
def citation_check(spark, d):
    hits = item_hits(spark, d)
    said = hits.where("rank <= 3").select("query_id", (F.col("rank") - 1).alias("sentence_index"), F.substring_index("text", ".", 1).alias("text"), F.array(F.concat(F.lit("z"), F.col("rank").cast("string"))).alias("cite_ids"))
    return claims.check_citations(said, hits, 0.5).withColumn("overlap", F.round("overlap", 6))


@query("evidence_overlap", r"""
with i as (select item_id, list_distinct(regexp_extract_all(lower(text), '[₹\p{L}\p{N}_]+')) as a from eval_items), d as (select doc_id, regexp_extract_all(lower(coalesce(title, '')), '[₹\p{L}\p{N}_]+') as b from documents)
select item_id, doc_id, round(len(list_intersect(a, b)) / len(a), 6) as overlap from i, d where len(list_intersect(a, b)) >= 4""")
def evidence_overlap(spark, d):
    # a stated query set against all titles
    return overlaps(spark, d, "title")


def overlaps(spark, d, column: str) -> DataFrame:
    items = read(spark, d, "eval_items").select("item_id", tx.claim_words("text").alias("a"))
    docs = documents(spark, d).select("doc_id", tx.claim_words(F.coalesce(column, F.lit(""))).alias("b"))
    words = items.select("item_id", F.size(F.array_distinct("a")).alias("n"), F.explode(F.array_distinct("a")).alias("w"))
    shared = docs.select("doc_id", F.explode(F.array_distinct("b")).alias("w")).join(F.broadcast(words), "w").groupBy("item_id", "doc_id", "n").count()
    return shared.where("count >= 4").select("item_id", "doc_id", F.round(F.col("count") / F.col("n"), 6).alias("overlap"))


@query("evidence_overlap_texts", r"""
with i as (select item_id, list_distinct(regexp_extract_all(lower(text), '[₹\p{L}\p{N}_]+')) as a from eval_items), iw as (select item_id, len(a) as n, unnest(a) as w from i),
dw as (select doc_id, unnest(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[₹\p{L}\p{N}_]+'))) as w from documents)
select item_id, doc_id, round(count(*) / n, 6) as overlap from dw join iw using (w) group by item_id, doc_id, n having count(*) >= 4""")
def evidence_overlap_texts(spark, d):
    # the same items against the whole texts, as the operator compares claims with evidence
    return overlaps(spark, d, "text")


# --- evaluation -----------------------------------------------------------------------------------------------------

TITLED = [("cataract", "cataract"), ("diabetes", "diabetes"), ("dengue", "dengue fever"), ("asthma", "asthma"), ("severe", "severe burns")]
_REL = "rel as (select query_id, cast(doc_id as varchar) as doc_id from documents join (values " + values_sql(TITLED) + ") v(query_id, query) on contains(lower(title), query))"
_TQ = QTERMS.replace(values_sql(BATCH), values_sql(TITLED))
_RANKED = "rk as (select query_id, doc_id, row_number() over (partition by query_id order by round(score, 6) desc, doc_id) as rank from {0})"
_METRICS = """
m as (select query_id, sum(case when rel.doc_id is not null and rank <= 5 then 1 else 0 end) as h5, sum(case when rel.doc_id is not null and rank <= 10 then 1 else 0 end) as h10, count(*) as n_returned
  from (select * from rk where rank <= 10) r left join rel using (query_id, doc_id) group by query_id),
c as (select query_id, count(*) as n_relevant from rel group by all)"""


def judged(spark, d) -> DataFrame:
    asked = batch(spark, TITLED)
    return documents(spark, d).where("title is not null").join(F.broadcast(asked), F.contains(F.lower("title"), F.col("query"))).select("query_id", F.col("doc_id").cast("string").alias("doc_id"))


def titled_lists(spark, d) -> dict[str, DataFrame]:
    corpus = index.build(documents(spark, d))
    lists = {"cosine": rank.cosine_scores(corpus, batch(spark, TITLED)), "bm25": rank.bm25_scores(corpus, batch(spark, TITLED))}
    return {m: rank.top_k(s.withColumn("score", F.round("score", 6)), 10) for m, s in lists.items()}


@query("precision_recall_at_k", f"with {CORPUS}, {_TQ}, {COSINE}, {_REL}, {_RANKED.format('cos')}, {_METRICS} select query_id, round(coalesce(h5, 0) / 5, 6) as p_at_5, round(coalesce(h10, 0) / 10, 6) as p_at_10, round(coalesce(h10, 0) / n_relevant, 6) as recall_at_10, n_relevant from c left join m using (query_id)")
def precision_recall_at_k(spark, d):
    m = evaluate.ranked_metrics(titled_lists(spark, d)["cosine"], judged(spark, d))
    return m.select("query_id", *[F.round(c, 6).alias(c) for c in ("p_at_5", "p_at_10", "recall_at_10")], "n_relevant")


@query("method_comparison", f"""with {CORPUS}, {_TQ}, {COSINE}, {BM25}, {_REL},
every as (select 'cosine' as method, * from cos union all select 'bm25', * from bm),
rk as (select method, query_id, doc_id, row_number() over (partition by method, query_id order by round(score, 6) desc, doc_id) as rank from every),
m as (select method, query_id, sum(case when rel.doc_id is not null and rank <= 5 then 1 else 0 end) / 5 as p5 from rk left join rel using (query_id, doc_id) where rank <= 10 group by all),
g as (select method, query_id from (select distinct method from every), (select distinct query_id from rel))
select method, round(avg(coalesce(p5, 0)), 6) as p_at_5, count(*) as n_queries from g left join m using (method, query_id) group by method""")
def method_comparison(spark, d):
    return evaluate.compare_methods(titled_lists(spark, d), judged(spark, d)).select("method", F.round("p_at_5", 6).alias("p_at_5"), "n_queries")


@query("net_score_ablation")
def net_score_ablation(spark, d):
    z = zone_corpus(spark, d)
    corpus = index.build(z)
    asked = batch(spark, TITLED)
    hits = rank.cosine_scores(corpus, asked).withColumnRenamed("score", "cosine").join(z, "doc_id")
    configs = {"full": NET} | {f"without_{p}": NET.without(p) for p in ("cosine", "g_score", "freshness", "zone_weight")}
    lists = {m: rank.top_k(netscore.score_parts(hits, c).where(F.col("net").isNotNull()).withColumn("score", F.round("net", 6)), 10) for m, c in configs.items()}
    truth = z.where("title is not null").join(F.broadcast(asked), F.contains(F.lower("title"), F.col("query"))).select("query_id", "doc_id")
    return evaluate.ablation(lists, truth).select("method", F.round("p_at_5", 6).alias("p_at_5"), F.round("delta", 6).alias("delta"))


@query("confusion", """
with l as (select l.lang as predicted, case when z.doc_id is null then '' else 'EN' end as gold from lang_labels l left join (select distinct doc_id from zone_docs where regexp_matches(title, '^[ -~]+$')) z using (doc_id)),
k as (select trim(gold) = 'EN' as g, coalesce(upper(trim(predicted)) = 'EN', false) as p from (select predicted, case when gold = '' then 'OTHER' else gold end as gold from l))
select count(*) filter (where g and p) as tp, count(*) filter (where not g and p) as fp, count(*) filter (where g and not p) as fn, count(*) filter (where not g and not p) as tn,
  round(count(*) filter (where g and p) / count(*) filter (where p), 6) as precision, round(count(*) filter (where g and p) / count(*) filter (where g), 6) as recall from k""")
def confusion(spark, d):
    ascii_titles = read(spark, d, "zone_docs").where(F.col("title").rlike("^[ -~]+$")).select("doc_id").distinct().withColumn("_en", F.lit("EN"))
    rows = read(spark, d, "lang_labels").join(ascii_titles, "doc_id", "left").select(F.coalesce("_en", F.lit("OTHER")).alias("gold"), F.col("lang").alias("predicted"))
    return evaluate.confusion(rows, "EN").withColumns({c: F.round(c, 6) for c in ("precision", "recall")})


@query("inventory", " union all ".join(f"select '{t}' as name, count(*) as n_rows from {t}" for t in ("documents", "zone_docs", "medicines", "medicine_records")))
def inventory(spark, d):
    return evaluate.inventory({t: read(spark, d, t) for t in ("documents", "zone_docs", "medicines", "medicine_records")})
