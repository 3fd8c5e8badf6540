"""Evaluation texts leaking into training text: winnowed word k-grams, joined and extended.

A span of T words holds T-K+1 grams of K words; the smallest gram hash of each such window is kept on both sides, so
any shared span of T or more words shares a kept hash. Fingerprints of both sides are tables, and one pass over the
documents meets the items of any number: the documents' kept grams are thinned out by the items' hashes (a semi-join),
and each that is left is extended to the spans of T words around it, which are joined with the items' spans by their
two 64-bit hashes. A gram of common words thus pairs nothing by itself; only whole spans do. Runs of neighbouring spans
are one shared span. Texts never leave their task and nothing comes to the driver but counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mimansa.plans.support import BROADCAST_ROWS, checkpointed, small

#: Words of a span that counts, and of a gram. The window has T - K + 1 grams.
T, K = 12, 5
#: Characters hashed at once in a worker.
CHUNK_CHARS = 1_000_000
#: Copies of the items' hashes over which a hot one is spread where they are too many to broadcast.
SALTS = 16

_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_P_INV = np.uint64(pow(int(_P), -1, 1 << 64))
_MIX = [np.uint64(x | 1) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F)]


def word_text(text: str | Column) -> Column:
    """Words, lower-cased, with single spaces between: runs of letters and digits once tags and invisible signs are out."""
    bare = F.regexp_replace(text, r"[\p{Cf}\p{Mn}­͏️]+", "")
    bare = F.regexp_replace(bare, r"</?[A-Za-z][^<>\n]{0,80}>|&(?:nbsp|zwnj|shy|#\d{1,6});", " ")
    return F.trim(F.regexp_replace(F.lower(bare), r"[^\p{L}\p{Nd}]+", " "))


def _sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """pick over each window of `width` values, by doubling."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = pick(out[:-step], out[step:])
        have += step
    return out


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all words of word texts one after the other: the index of the text, the hash; and each text's first word."""
    blob = np.frombuffer(("\n".join(texts) + "\n").encode(), dtype=np.uint8)
    gap = (blob == 32) | (blob == 10)
    before = np.concatenate(([True], gap[:-1]))
    starts, ends = np.flatnonzero(~gap & before), np.flatnonzero(gap & ~before)
    powers = np.full(len(blob) + 1, _P, dtype=np.uint64)
    powers[0] = 1
    powers = np.cumprod(powers, dtype=np.uint64)
    sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(blob * powers[:-1], dtype=np.uint64)))
    # dividing by the power of the start makes a word's hash independent of its place
    inverse = np.full(len(blob) + 1, _P_INV, dtype=np.uint64)
    inverse[0] = 1
    inverse = np.cumprod(inverse, dtype=np.uint64)
    words = (sums[ends] - sums[starts]) * inverse[starts]
    words ^= words >> np.uint64(29)
    text = np.cumsum(blob == 10)[starts]
    return text, words, np.searchsorted(text, np.arange(len(texts)))


def _mixed(sums: np.ndarray, by: np.uint64) -> np.ndarray:
    sums = sums ^ (sums >> np.uint64(31))
    sums = sums * by
    return sums ^ (sums >> np.uint64(30))


def winnow(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Kept grams of word texts: index of the text, word position in it, hash."""
    doc, words, first = word_hashes(texts)
    if len(words) < T:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    grams = np.zeros(len(words) - K + 1, dtype=np.uint64)
    for j in range(K):
        grams += words[j : len(words) - K + 1 + j] * _MIX[j]
    grams = _mixed(grams, _MIX[5])
    width = T - K + 1
    inside = doc[: len(words) - T + 1] == doc[T - 1 :]
    lows = np.where(inside, _sliding(grams, width, np.minimum), np.uint64(0))
    padded = np.concatenate((np.zeros(width - 1, dtype=np.uint64), lows, np.zeros(width - 1, dtype=np.uint64)))
    kept = np.flatnonzero((_sliding(padded, width, np.maximum) == grams) & (grams > 0))
    return doc[kept], kept - first[doc[kept]], grams[kept]


def spans(texts: list[str], places: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Spans of T words, all of them or those that hold a gram at one of a text's places: text, first word, two hashes."""
    doc, words, first = word_hashes(texts)
    if len(words) < T:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.uint64)
    n = len(words) - T + 1
    wanted = doc[:n] == doc[T - 1 :]
    if places is not None:
        near = np.zeros(n + T, dtype=bool)
        for d, at in enumerate(places):
            for back in range(T - K + 1):
                near[np.maximum(at + first[d] - back, first[d])] = True
        wanted &= near[:n]
    at = np.flatnonzero(wanted)
    one, two = np.zeros(len(at), dtype=np.uint64), np.zeros(len(at), dtype=np.uint64)
    for j in range(T):
        word = words[at + j]
        one = (one + word) * _MIX[6]
        two = (two ^ (word >> np.uint64(7)) ^ (word << np.uint64(40))) * _MIX[7]
    return doc[at], at - first[doc[at]], _mixed(one, _MIX[3]), _mixed(two, _MIX[4])


def _chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    at = size = 0
    for i, t in enumerate(texts):
        size += len(t) + 1
        if size >= CHUNK_CHARS:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def _long(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("words").to_pylist()
        for lo, hi in _chunks(texts):
            which, where, hashes = winnow(texts[lo:hi])
            row = pa.array(which + lo)
            yield pa.RecordBatch.from_arrays([batch.column("id").take(row), batch.column("row").take(row), pa.array(where.astype(np.int32)), _long(hashes)], names=["id", "row", "at", "h"])


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("words").to_pylist()
        held = batch.column("places") if "places" in batch.schema.names else None
        for lo, hi in _chunks(texts):
            places = None if held is None else [held[i].values.to_numpy(zero_copy_only=False) for i in range(lo, hi)]
            which, where, one, two = spans(texts[lo:hi], places)
            row = pa.array(which + lo)
            yield pa.RecordBatch.from_arrays([batch.column("id").take(row), batch.column("row").take(row), pa.array(where.astype(np.int32)), _long(one), _long(two)], names=["id", "row", "at", "w1", "w2"])


def _rows(df: DataFrame, key: str, text: str) -> DataFrame:
    """id, row, text: rows that share an id, or have none, are told apart by their text."""
    return df.where(F.col(text).isNotNull()).select(F.col(key).cast("bigint").alias("id"), F.xxhash64(text).alias("row"), F.col(text).alias("text"))


_SPANS = "id long, row long, at int, w1 long, w2 long"


def shared_spans(docs: DataFrame, items: DataFrame, doc: str = "doc_id", item: str = "item_id", text: str = "text") -> DataFrame:
    """doc_id, row, item_id, at, item_at: every span of T words that a document shares with an item, by its first words.

    Null and short texts on either side share nothing. Items repeated under other ids are each reported, and so are
    rows that share an id or have none.
    """
    rows, texts = _rows(docs, doc, text), _rows(items, item, text).select("id", "row", word_text("text").alias("words"))
    kept = rows.select("id", "row", word_text("text").alias("words")).mapInArrow(_fingerprints, "id long, row long, at int, h long")
    hashes = checkpointed(texts.mapInArrow(_fingerprints, "id long, row long, at int, h long").select("h").distinct())
    if hashes.count() <= BROADCAST_ROWS:
        hits = kept.join(F.broadcast(hashes), "h", "left_semi")
    else:
        salted = hashes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        hits = kept.withColumn("salt", F.pmod(F.xxhash64("id", "row", "at"), F.lit(SALTS)).cast("int")).join(salted, ["h", "salt"], "left_semi")
    # a row's places are bounded by its own words
    places = checkpointed(hits.groupBy("id", "row").agg(F.collect_set("at").alias("places")))
    own = small(places)
    near = rows.join(own.withColumnsRenamed({"id": "_id", "row": "_row"}), F.col("id").eqNullSafe(F.col("_id")) & (F.col("row") == F.col("_row")))
    found_ = near.select("id", "row", word_text("text").alias("words"), "places").mapInArrow(_spans, _SPANS)
    theirs = small(checkpointed(texts.mapInArrow(_spans, _SPANS).select(F.col("id").alias("item_id"), F.col("at").alias("item_at"), "w1", "w2")))
    return found_.join(theirs, ["w1", "w2"]).select(F.col("id").alias("doc_id"), "row", "item_id", "at", "item_at")


def leaks(docs: DataFrame, items: DataFrame, doc: str = "doc_id", item: str = "item_id", text: str = "text") -> DataFrame:
    """doc_id, item_id, start_word, item_word, n_words: every longest shared span of T words or more, by its first words."""
    each = shared_spans(docs, items, doc, item, text).distinct().withColumn("_diagonal", F.col("at") - F.col("item_at"))
    order = Window.partitionBy("doc_id", "row", "item_id", "_diagonal").orderBy("at")
    runs = each.withColumn("_run", F.col("at") - F.row_number().over(order)).groupBy("doc_id", "row", "item_id", "_diagonal", "_run")
    found_ = runs.agg(F.min("at").alias("start_word"), F.min("item_at").alias("item_word"), (F.count("*") + T - 1).cast("int").alias("n_words"))
    return found_.select("doc_id", "item_id", "start_word", "item_word", "n_words")


def found(docs: DataFrame, items: DataFrame) -> DataFrame:
    return shared_spans(docs, items).select("doc_id", "item_id").distinct()
