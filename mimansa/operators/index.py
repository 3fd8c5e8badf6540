"""Inverted, positional and parametric indexes as tables.

A corpus is `docs(doc_id, text)`. `tokens` keeps one row a token; `postings` one a (term, document), with its positions.
Empty documents have no tokens but count in N, which is why N always comes from the documents.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mimansa.functions import text as tx
from mimansa.operators import blocks

MISSING = "<missing>"


def analysed(docs: DataFrame, text: str = "text", stopwords: list[str] | None = None, exact: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id (as a string, for ties are broken by text order), its tokens and other columns; a null text has none."""
    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), *keep, F.coalesce(tx.tokenize(text, stopwords, exact), F.array().cast("array<string>")).alias("tokens"))


def tokens(words: DataFrame) -> DataFrame:
    return words.select("doc_id", F.posexplode("tokens").alias("pos", "term"))


def runs(ordered: Column, same: str = "") -> Column:
    """(first, n) of each run of equal values in a sorted array; `same` is the field that makes them equal."""
    value = lambda i: F.get(ordered, i)[same] if same else F.get(ordered, i)
    firsts = F.filter(F.sequence(F.lit(0), F.size(ordered) - 1), lambda i: (i == 0) | (value(i) != value(i - 1)))
    spans = tx.let(firsts, lambda a: F.transform(a, lambda x, k: F.struct(x.alias("first"), (F.coalesce(F.get(a, k + 1), F.size(ordered)) - x).alias("n"))))
    return F.when(F.size(ordered) > 0, spans).otherwise(F.array().cast("array<struct<first:int,n:int>>"))


def counted(words: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, length, terms, norm: the terms of a document with their tf, counted in its own array, and its norm."""

    def parts(s: Column, r: Column) -> Column:
        terms = F.transform(r, lambda x: F.struct(F.get(s, x["first"]).alias("term"), x["n"].alias("tf")))
        norm = F.sqrt(F.aggregate(r, F.lit(0.0), lambda a, x: a + F.pow(1.0 + F.log10(x["n"]), F.lit(2))))
        return F.struct(F.size(s).alias("length"), terms.alias("terms"), norm.alias("norm"))

    return words.select("doc_id", *keep, tx.let(F.sort_array("tokens"), lambda s: tx.let(runs(s), lambda r: parts(s, r))).alias("_d")).select("doc_id", *keep, "_d.*")


def postings(words: DataFrame) -> DataFrame:
    """term, doc_id, tf: one row a term of a document, without a shuffle."""
    terms = tx.let(F.sort_array("tokens"), lambda s: F.transform(runs(s), lambda x: F.struct(F.get(s, x["first"]).alias("term"), x["n"].alias("tf"))))
    return words.select("doc_id", F.explode(terms).alias("_t")).select("_t.term", "doc_id", "_t.tf")


def positional_postings(words: DataFrame) -> DataFrame:
    """term, doc_id, positions in order, tf, without a shuffle."""

    def of(s: Column, x: Column) -> Column:
        return F.struct(F.get(s, x["first"])["term"].alias("term"), F.transform(F.slice(s, x["first"] + 1, x["n"]), lambda p: p["pos"]).alias("positions"), x["n"].alias("tf"))

    places = F.sort_array(F.transform("tokens", lambda t, i: F.struct(t.alias("term"), i.alias("pos"))))
    each = tx.let(places, lambda s: F.transform(runs(s, "term"), lambda x: of(s, x)))
    return words.select("doc_id", F.explode(each).alias("_t")).select("_t.term", "doc_id", "_t.positions", "_t.tf")


def doc_stats(words: DataFrame) -> DataFrame:
    return words.select("doc_id", F.size("tokens").alias("length"), F.size(F.array_distinct("tokens")).alias("unique_terms"))


def term_stats(posts: DataFrame) -> DataFrame:
    """term, df, cf."""
    return posts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def collection_stats(words: DataFrame, posts: DataFrame) -> DataFrame:
    """One row: n_docs, vocabulary, total_terms, avg_length; all 0 for an empty collection."""
    docs = doc_stats(words).agg(F.count("*").alias("n_docs"), F.coalesce(F.sum("length"), F.lit(0)).alias("total_terms"), F.coalesce(F.avg("length"), F.lit(0.0)).alias("avg_length"))
    terms = posts.agg(F.count_distinct("term").alias("vocabulary"))
    return docs.join(F.broadcast(terms)).select("n_docs", "vocabulary", "total_terms", "avg_length")


def reject_duplicates(docs: DataFrame) -> None:
    """Raises ValueError if a doc_id occurs twice."""
    twice = docs.groupBy("doc_id").count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"duplicate doc_id: {twice[0]['doc_id']!r}")


def lookup(posts: DataFrame, term: str) -> DataFrame:
    """Postings of one term. A text of several words is no term and raises ValueError."""
    spark = posts.sparkSession
    words = spark.range(1).select(tx.tokenize(F.lit(term)).alias("t")).first()["t"]
    if len(words) > 1:
        raise ValueError(f"more than one term: {term!r}")
    return posts.where(F.col("term") == (words[0] if words else ""))


@dataclass
class Index:
    """The tables that answer all queries. `rows` has one row a document, with its terms, length and norm.

    `rows` is kept between the passes of a search; all else follows from it without a shuffle, but `terms`, which counts
    the vocabulary, is only made where a score needs all of it and is then kept too.
    """

    words: DataFrame
    rows: DataFrame
    n_docs: int
    avg_length: float

    @property
    def posts(self) -> DataFrame:
        """term, doc_id, tf, length, norm."""
        return self.rows.select("doc_id", "length", "norm", F.explode("terms").alias("_t")).select("_t.term", "doc_id", "_t.tf", "length", "norm")

    @cached_property
    def terms(self) -> DataFrame:
        return term_stats(self.posts).persist(StorageLevel.MEMORY_AND_DISK)

    @property
    def docs(self) -> DataFrame:
        return self.rows.select("doc_id", "length", F.size("terms").alias("unique_terms"))

    def release(self) -> None:
        """Gives the kept tables back."""
        self.rows.unpersist()
        if "terms" in self.__dict__:
            self.terms.unpersist()


def build(docs: DataFrame, text: str = "text", stopwords: list[str] | None = None, exact: bool = False, keep: tuple[str, ...] = ()) -> Index:
    """Builds an index, whose rows `keep` columns of the documents. Only two figures of the collection come to the driver."""
    words = analysed(docs, text, stopwords, exact, keep)
    rows = counted(words, keep).persist(StorageLevel.MEMORY_AND_DISK)
    stats = rows.agg(F.count("*").alias("n"), F.avg("length").alias("avg")).first()
    return Index(words, rows, stats["n"], stats["avg"] or 0.0)


def parametric_buckets(docs: DataFrame, field: str, multiple: bool = False) -> DataFrame:
    """field, value, doc_id: nulls of a single-valued field go under `<missing>`; a list gives each distinct value."""
    if multiple:
        value: Column = F.explode(F.array_distinct(F.coalesce(field, F.array().cast("array<string>"))))
    else:
        value = F.coalesce(F.col(field), F.lit(MISSING))
    return docs.select(F.lit(field).alias("field"), value.alias("value"), "doc_id").distinct()


#: Fields that can be filtered, and the zones there are (fixed values).
PARAMETRIC = ("state", "zone", "conditions")
ZONES = ("benefits", "documents", "eligibility", "how_to_apply", "other")


def check_filters(filters: dict | None) -> dict:
    """The filters in normal form. Unknown fields and zones raise ValueError; an unknown state just matches nothing."""
    out: dict = {}
    for key, value in (filters or {}).items():
        if key not in PARAMETRIC:
            raise ValueError(f"not a parametric field: {key!r}")
        if key == "conditions":
            out[key] = [] if value is None else [value] if isinstance(value, str) else list(value)
        elif key == "zone" and value is not None:
            zone = str(value).strip().lower()
            if zone not in ZONES:
                raise ValueError(f"unknown zone: {value!r}")
            out[key] = zone
        else:
            out[key] = value
    return out


def matching(docs: DataFrame, filters: dict | None) -> DataFrame:
    """Documents that meet all filters: None asks for a missing value, an absent key for nothing, [] for no condition."""
    for key, value in check_filters(filters).items():
        if key == "conditions":
            have = F.transform(F.coalesce("conditions", F.array().cast("array<string>")), tx.normalize)
            wanted = F.array(*[tx.normalize(F.lit(v)) for v in value]) if value else None
            docs = docs.where(F.size(F.array_except(wanted, have)) == 0) if value else docs
        elif value is None:
            docs = docs.where(F.col(key).isNull())
        elif key == "zone":
            docs = docs.where(F.lower(F.trim(F.col("zone"))) == value)
        else:
            docs = docs.where(tx.normalize(key) == tx.normalize(F.lit(value)))
    return docs


def phrase_starts(words: DataFrame, phrases: DataFrame) -> DataFrame:
    """query_id, doc_id, starts: where all tokens of a phrase stand in order, for `phrases(query_id, tokens)`.

    A document is searched as it stands, so no token leaves it.
    """
    wanted = phrases.select(F.col("query_id").cast("string").alias("query_id"), F.posexplode("tokens").alias("offset", "term"))
    return blocks.starts(words, wanted.select("query_id", "term", F.col("offset").cast("double").alias("weight"), F.lit(1.0).alias("norm")))
