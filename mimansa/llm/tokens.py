"""Encoding of a corpus with a public tokenizer by a distinct-word table, and decoding by an id-to-piece join.

Words are cut in Spark by the tokenizer's own pattern. Documents fall into buckets of bounded text by hash of their id;
the distinct words of the buckets are made distinct over the corpus, each is encoded once, and the ids go back to the
buckets that hold the word. There every document reads its words by position, along its text. Neither side
of the last step can grow with the corpus: a bucket holds BUCKET_CHARS of text (or one longer text) and its words.
A word that stands in every bucket would gather them all in one task, so buckets are kept as bits in chunks of
CHUNK_BUCKETS: the table of words meets one row a chunk, and the bits are opened behind that join.

Null and empty texts both have the empty list of ids. Text that looks like a special token is plain text.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mimansa.plans.support import shuffle_width

#: Characters of text in a bucket.
BUCKET_CHARS = 6_000_000
#: Buckets of a chunk, one bit each of a long, and of a task of the last step.
CHUNK_BUCKETS, TASK_BUCKETS = 62, 4
#: Stands between words on the way.
MARK = "\x01"
# Fixed value: the published word pattern of byte-level BPE, with Unicode white space.
PATTERN = r"(?U)'(?:s|t|re|ve|m|ll|d)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """The tokenizer's file on this machine; every node has it at the same path."""
    import public_tokenizers

    return public_tokenizers.path(name)


def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


_ENCODERS: dict = {}


def encoder(path: str):
    """The tokenizer of a file, kept for the life of the worker."""
    if path not in _ENCODERS:
        import public_tokenizers
        import tiktoken

        _ENCODERS[path] = tiktoken.Encoding(os.path.basename(path), pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks(path), special_tokens={})
    return _ENCODERS[path]


def words_of(text: str | Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))


def _width(path: str) -> np.dtype:
    """Ids travel as plain numbers of two bytes where all fit."""
    return np.dtype("<u2") if max(ranks(path).values()) < 1 << 16 else np.dtype("<u4")


def _encode_words(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, kind = encoder(path).encode_ordinary, _width(path)
        for batch in batches:
            ids = [np.array(encode(w), dtype=kind).tobytes() for w in batch.column("word").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("word"), pa.array(ids, pa.binary())], names=["word", "ids"])

    return run


def _assemble(path: str):
    kind = _width(path)

    def run(docs: pa.Table, table: pa.Table) -> pa.Table:
        words = table.column("word").to_pylist()
        index = {w: i for i, w in enumerate(words)}
        packed = table.column("ids").to_pylist()
        flat = np.frombuffer(b"".join(packed), dtype=kind)
        counts = np.array([len(p) // kind.itemsize for p in packed], dtype=np.int64)
        starts = np.cumsum(counts) - counts
        out_ids, out_offsets = [], [0]
        for cut, text, lengths in zip(docs.column("cut").to_pylist(), docs.column("text").to_pylist(), docs.column("lengths")):
            if cut is not None:
                mine = [index[w] for w in cut.split(MARK)] if cut else []
            else:
                ends = np.cumsum(lengths.values.to_numpy(zero_copy_only=False)).tolist()
                mine = [index[text[a:b]] for a, b in zip([0, *ends], ends)]
            which = np.array(mine, dtype=np.int64)
            n = counts[which]
            total = int(n.sum())
            # the ids of all words one after the other, without a loop
            where = np.repeat(starts[which] - (np.cumsum(n) - n), n) + np.arange(total)
            out_ids.append(flat[where])
            out_offsets.append(out_offsets[-1] + total)
        ids = np.concatenate(out_ids).astype(np.int32) if out_ids else np.zeros(0, dtype=np.int32)
        return pa.table({"doc_id": docs.column("doc_id"), "ids": pa.ListArray.from_arrays(pa.array(out_offsets, pa.int32()), pa.array(ids, pa.int32()))})

    return run


def encoded(docs: DataFrame, path: str | None = None, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids of every row; rows that repeat a doc_id are each encoded.

    A document travels once, as its words with a mark between, or with their lengths if the text holds the mark itself.
    """
    path = path or vocabulary_path()
    size = docs.agg(F.sum(F.length(text))).first()[0] or 0
    buckets = max(1, -(-size // BUCKET_CHARS))
    parts = max(shuffle_width(docs.sparkSession), -(-buckets // TASK_BUCKETS))
    # the text has a say in the bucket, so rows that share an id or have none are spread too
    placed = docs.select(F.col(doc).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text"), F.lit(buckets)).cast("int"))
    pairs = placed.select("bucket", F.explode(F.array_distinct(words_of("text"))).alias("word")).where(F.col("word").isNotNull())
    chunk = F.floor(F.col("bucket") / CHUNK_BUCKETS).cast("int")
    held = pairs.groupBy(chunk.alias("chunk"), "word").agg(F.bit_or(F.expr(f"shiftleft(1L, bucket % {CHUNK_BUCKETS})")).alias("bits"))
    # bits and chunks are looked at so that both readers of the pairs need all of them and share one shuffle
    table = held.groupBy("word").agg(F.bit_or("bits").alias("_b"), F.max("chunk").alias("_c")).where((F.col("_b") != 0) & (F.col("_c") >= 0)).select("word").mapInArrow(_encode_words(path), "word string, ids binary")
    opened = F.filter(F.sequence(F.lit(0), F.lit(CHUNK_BUCKETS - 1)), lambda i: F.getbit("bits", i) == 1)
    per_bucket = held.join(table, "word").select(F.explode(F.transform(opened, lambda i: F.col("chunk") * CHUNK_BUCKETS + i)).alias("its_bucket"), "word", "ids").repartition(parts, "its_bucket")
    marked = F.contains("text", F.lit(MARK))
    cut = placed.select(
        "bucket", "doc_id", F.when(~marked, F.array_join(words_of("text"), MARK)).alias("cut"), F.when(marked, F.col("text")).alias("text"), F.when(marked, F.transform(words_of("text"), F.length)).alias("lengths")
    ).repartition(parts, "bucket")
    return cut.groupBy("bucket").cogroup(per_bucket.groupBy("its_bucket")).applyInArrow(_assemble(path), "doc_id long, ids array<int>")


def pieces(spark, path: str | None = None) -> DataFrame:
    """id, piece of the whole vocabulary: a fixed table."""
    rows = [(i, bytearray(b)) for b, i in ranks(path or vocabulary_path()).items()]
    return spark.createDataFrame(rows, "id int, piece binary")


def decoded(ids: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, text: the pieces of every id joined in order; an empty or missing list is an empty text.

    One row for each distinct (doc_id, ids); the vocabulary is a table of fixed size.
    """
    keyed = ids.select("doc_id", F.coalesce("ids", F.array().cast("array<int>")).alias("ids")).withColumn("_h", F.xxhash64("ids")).dropDuplicates(["doc_id", "_h"])
    each = keyed.select("doc_id", "_h", F.posexplode_outer("ids").alias("pos", "id"))
    joined = each.join(F.broadcast(pieces(ids.sparkSession, path)), "id", "left")
    order = F.array_sort(F.collect_list(F.struct("pos", F.hex("piece").alias("h"))))
    text = F.decode(F.unhex(F.array_join(F.transform(order, lambda s: F.coalesce(s["h"], F.lit(""))), "")), "UTF-8")
    return joined.groupBy("doc_id", "_h").agg(text.alias("text")).select("doc_id", "text")
