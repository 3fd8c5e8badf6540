"""The analysers: one for retrieval, one for shingles, one for claims. Columns in, columns out.

The three differ on purpose: the retrieval analyser keeps combining marks in its tokens, the other two end a word at
them, and only the claims analyser takes the rupee sign for a word character.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The opt-in stop-words.
STOPWORDS = ["a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "were", "with"]

_GAP = r"[\p{P}\p{S}\p{Z}\x{200B}\t\n\x0B\f\r\x1C-\x1F\x85]"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize(text: str | Column) -> Column:
    """Lower-cased; punctuation, symbols and space become single spaces, anything but letters, marks and numbers goes.

    Null stays null. This is the path within the JVM; `normalize_exact` adds canonical composition and full case folding.
    """
    folded = F.replace(F.lower(col(text)), F.lit("ß"), F.lit("ss"))
    spaced = F.regexp_replace(folded, _GAP, " ")
    return F.trim(F.regexp_replace(F.regexp_replace(spaced, r"[^\p{L}\p{M}\p{N} ]", ""), " +", " "))


def _exact(text: str) -> str:
    folded = unicodedata.normalize("NFC", unicodedata.normalize("NFC", text).casefold())
    out = []
    for c in folded:
        kind = unicodedata.category(c)[0]
        if kind in "LMN":
            out.append(c)
        elif kind in "PSZ" or c.isspace() or c == "​":
            out.append(" ")
    return " ".join("".join(out).split())


@F.pandas_udf(T.StringType())
def normalize_exact(texts: pd.Series) -> pd.Series:
    """As `normalize`, with NFC and full case folding."""
    return texts.map(lambda t: _exact(t) if isinstance(t, str) else None)


def tokens_of(normal: Column, stopwords: list[str] | None = None) -> Column:
    """Words of a normalised text; repeats stay. An empty text has none."""
    words = F.filter(F.split(normal, " "), lambda t: t != "")
    return F.filter(words, lambda t: ~t.isin(stopwords)) if stopwords else words


def tokenize(text: str | Column, stopwords: list[str] | None = None, exact: bool = False) -> Column:
    return tokens_of(normalize_exact(col(text)) if exact else normalize(text), stopwords)


def shingle_words(text: str | Column) -> Column:
    return F.regexp_extract_all(F.lower(col(text)), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def claim_words(text: str | Column) -> Column:
    return F.regexp_extract_all(F.lower(col(text)), F.lit(r"[₹\p{L}\p{N}_]+"), F.lit(0))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, which an expression inside a lambda would else be for every element."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def shingles(words: Column, k: int = 5) -> Column:
    """Distinct runs of k words; a shorter text is one run of all its words, an empty one has none."""
    if k < 1:
        raise ValueError("k must be positive")

    def runs(w: Column) -> Column:
        every = F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - k + 1, F.lit(1))), lambda i: F.array_join(F.slice(w, i, k), " "))
        return F.when(F.size(w) == 0, F.array().cast("array<string>")).when(F.size(w) < k, F.array(F.array_join(w, " "))).otherwise(F.array_distinct(every))

    return let(F.coalesce(words, F.array().cast("array<string>")), runs)


def gram_text(text: str | Column) -> Column:
    return F.replace(normalize(text), F.lit(" "), F.lit(""))


def character_ngrams(squeezed: Column, orders: tuple[int, ...] = (2, 3)) -> Column:
    """All n-grams of a text without spaces, with repeats."""

    def grams(text: Column, n: int) -> Column:
        last = F.greatest(F.length(text) - n + 1, F.lit(1))
        every = F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(text, i, F.lit(n)))
        return F.when(F.length(text) >= n, every).otherwise(F.array().cast("array<string>"))

    return let(squeezed, lambda text: F.concat(*[grams(text, n) for n in orders]))


def soundex_code(word: Column) -> Column:
    """American Soundex of the ASCII letters of a word; empty where it has none."""
    plain = F.regexp_replace(word, "[^A-Za-z]", "")
    return F.when(plain == "", "").otherwise(F.soundex(plain))


def soundex_tokens(text: str | Column) -> Column:
    return F.filter(F.transform(tokenize(text), soundex_code), lambda c: c != "")


def soundex_brand(text: str | Column) -> Column:
    """The code of the first word that has one; empty where none has."""
    return F.coalesce(F.get(soundex_tokens(text), F.lit(0)), F.lit(""))


def collapse(text: str | Column) -> Column:
    return F.trim(F.regexp_replace(col(text), r"(?U)[\s\x{A0}]+", " "))


def heading_key(text: str | Column) -> Column:
    """Lower-cased words of letters, marks and numbers; all else, controls too, parts words."""
    return F.trim(F.regexp_replace(F.lower(col(text)), r"[^\p{L}\p{M}\p{N}]+", " "))


def quoted_phrase(query: str | Column) -> Column:
    """The text between the quotes of a query that is quoted as a whole; null otherwise or if blank."""
    inner = F.regexp_extract(F.trim(col(query)), r'(?s)^"(.*)"$', 1)
    return F.when(F.trim(inner) != "", inner)


def label_value(line: str | Column, label: str) -> Column:
    """Value of a line `Label: value`, null if it is none."""
    value = F.regexp_extract(col(line), rf"(?i)^\s*{re.escape(label)}\s*:\s*(.+?)\s*$", 1)
    return F.when(value != "", value)


def condition_items(value: str | Column) -> Column:
    """Items of a list of conditions; a text that reads as prose has none.

    Over 80 characters or any of .?! make prose; an item that is empty or over 40 characters voids all.
    """
    v = col(value)
    items = F.transform(F.split(v, "[,;]"), lambda x: F.trim(x))
    bad = (F.length(v) > 80) | F.coalesce(v.rlike("[.?!]"), F.lit(True)) | F.exists(items, lambda x: (x == "") | (F.length(x) > 40))
    return F.when(bad, F.array().cast("array<string>")).otherwise(F.array_distinct(items))


def parse_strength(text: str | Column) -> Column:
    """struct<value, unit> of a plain strength such as "30mg/5ml"; null if it is none or not positive."""
    pattern = r"^\s*([0-9]+(?:\.[0-9]+)?)\s*([a-zA-Z%]+(?:/[0-9]*[a-zA-Z]+)?)\s*$"
    value = F.regexp_extract(col(text), pattern, 1).try_cast("double")
    unit = F.lower(F.regexp_extract(col(text), pattern, 2))
    return F.when(value > 0, F.struct(value.alias("value"), unit.alias("unit")))


def token_overlap(a: Column, b: Column) -> Column:
    """|A and B| / |A| over distinct words; 0 where A has none."""
    share = lambda own: F.when(F.size(own) > 0, F.size(F.array_intersect(own, b)) / F.size(own)).otherwise(F.lit(0.0))
    return let(F.array_distinct(a), share)


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets; both empty is 1, one empty is 0."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def to_json_row(*columns: str) -> Column:
    return F.to_json(F.struct(*columns))
