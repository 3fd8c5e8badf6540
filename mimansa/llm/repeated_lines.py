"""Lines repeated across the documents of one source, kept as incremental count tables in the shared folder.

A store is a folder with three tables, each with one part for every merged delta: `lines`, the places of the delta's
lines; `counts`, by how many documents and rows the delta raised each (source, line); `crossed`, the lines whose count
passed the threshold by it. A merge reads the delta's text once, and of what came before only the tables, never a text.
After it, only documents with a newly crossed line, and the delta's own, are to be rebuilt. A part counts once its last
table is whole, so a merge that was cut off is simply done again. Lines go by two 64-bit hashes of (source, line);
places are spread by their documents, so no source and no line gathers.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mimansa.plans.support import checkpointed, hot_safe_join, shared_folder

#: A line that stands in this many documents of its source is furniture.
MIN_DOCS = 5


def line_key(line: str | Column) -> Column:
    """Lower-cased, without decimal digits, each whitespace run one space, trimmed."""
    bare = F.regexp_replace(F.lower(line), r"\p{Nd}+", "")
    return F.regexp_replace(F.regexp_replace(bare, r"(?U)[\s\x1c-\x1f]+", " "), r"^ | $", "")


def row_key(*columns: str) -> Column:
    return F.xxhash64(F.to_json(F.struct(*columns)))


def numbered_lines(docs: DataFrame, doc: str = "doc_id", source: str = "domain", text: str = "text", row: Column | None = None) -> DataFrame:
    """doc, line_no, row, h1, h2 of every line that counts; a null text has no lines, a null source is a source.

    `row` tells apart the rows that share a doc; by default they are not told apart.
    """
    tag = F.lit(0).cast("bigint") if row is None else row
    lines = docs.select(F.col(doc).cast("string").alias("doc"), F.col(source).alias("source"), tag.alias("row"), F.posexplode(F.split(F.col(text), "\n")).alias("line_no", "line"))
    keyed = lines.select("doc", "source", "row", (F.col("line_no") + 1).alias("line_no"), line_key("line").alias("_k")).where(F.col("_k") != "")
    marked = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))
    return keyed.select("doc", "row", "line_no", F.xxhash64(marked, "_k").alias("h1"), F.xxhash64(F.lit(7), "_k", marked).alias("h2"))


class LineStore:
    """The incremental state: tables of a folder that all nodes share, which outlive the session that wrote them."""

    def __init__(self, spark: SparkSession, folder: str, min_docs: int = MIN_DOCS):
        self.spark, self.folder, self.min_docs = spark, folder, min_docs
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        self._fs, self._path = path.getFileSystem(spark._jsc.hadoopConfiguration()), path

    @classmethod
    def temporary(cls, spark: SparkSession, min_docs: int = MIN_DOCS) -> LineStore:
        """A store of its own in the session's shared folder, for one run; the caller deletes it."""
        return cls(spark, f"{shared_folder(spark)}/lines-{uuid.uuid4().hex}", min_docs)

    def parts(self) -> int:
        """The number of merged deltas."""
        n = 0
        while self._fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/crossed/part={n + 1}/_SUCCESS")):
            n += 1
        return n

    def _write(self, df: DataFrame, table: str, part: int) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.folder}/{table}/part={part}")
        return self._read(table, [part])

    def _read(self, table: str, parts: list[int]) -> DataFrame:
        """Some parts of a table, with the number of the part."""
        frames = [self.spark.read.parquet(f"{self.folder}/{table}/part={n}").withColumn("part", F.lit(n)) for n in parts]
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f)
        return out

    def merge(self, lines: DataFrame) -> DataFrame:
        """Merges a delta of `numbered_lines`; the lines (h1, h2, n_docs, n_rows) that crossed the threshold by it.

        A document that was there before raises only lines that it did not hold yet. Rows without a doc count for none.
        """
        part = self.parts() + 1
        delta = self._write(lines, "lines", part)
        triples = delta.where(F.col("doc").isNotNull()).select("h1", "h2", "doc").distinct()
        if part > 1:
            known = self._read("lines", list(range(1, part))).select("h1", "h2", "doc")
            triples = triples.join(known, ["h1", "h2", "doc"], "left_anti")
        docs = triples.groupBy("h1", "h2").agg(F.count("*").alias("more_docs"))
        rows = delta.groupBy("h1", "h2").agg(F.count("*").alias("more_rows"))
        raised = self._write(rows.join(docs, ["h1", "h2"], "left").select("h1", "h2", F.coalesce("more_docs", F.lit(0)).alias("more_docs"), "more_rows"), "counts", part)
        total = raised.select("h1", "h2", F.col("more_docs").alias("n_docs"), F.col("more_rows").alias("n_rows"), F.lit(0).cast("bigint").alias("before"))
        if part > 1:
            sums = self._read("counts", list(range(1, part))).groupBy("h1", "h2").agg(F.sum("more_docs").alias("before"), F.sum("more_rows").alias("_rows"))
            z = lambda c: F.coalesce(c, F.lit(0))
            total = raised.join(sums, ["h1", "h2"], "left").select("h1", "h2", (z("before") + F.col("more_docs")).alias("n_docs"), (z("_rows") + F.col("more_rows")).alias("n_rows"), z("before").alias("before"))
        crossed = total.where((F.col("n_docs") >= self.min_docs) & (F.col("before") < self.min_docs))
        return self._write(crossed.select("h1", "h2", "n_docs", "n_rows"), "crossed", part)

    def counts(self) -> DataFrame:
        """h1, h2, n_docs, n_rows of every line so far."""
        every = self._read("counts", list(range(1, self.parts() + 1)))
        return every.groupBy("h1", "h2").agg(F.sum("more_docs").alias("n_docs"), F.sum("more_rows").alias("n_rows"))

    def _places(self, parts: list[int], crossed_in: list[int]) -> DataFrame:
        """doc, row, line_no in some parts of the lines that crossed in some; hot lines are told by their rows."""
        lines = self._read("lines", parts).drop("part")
        keys = self._read("crossed", crossed_in).select("h1", "h2")
        sized = self._read("counts", parts).join(keys, ["h1", "h2"], "left_semi").groupBy("h1", "h2").agg(F.sum("more_rows").alias("n_rows"))
        return hot_safe_join(lines, sized, ["h1", "h2"], "n_rows").select("doc", "row", "line_no")

    def repeated(self) -> DataFrame:
        """doc, row, line_no of every line that has crossed so far."""
        every = list(range(1, self.parts() + 1))
        return self._places(every, every)

    def to_rebuild(self) -> DataFrame:
        """doc, row, line_no of what the last merge changed: newly crossed lines anywhere, crossed ones in the delta.

        These documents, and no others, are to be read and written again.
        """
        n = self.parts()
        new = self._places(list(range(1, n + 1)), [n])
        return new.unionByName(self._places([n], list(range(1, n)))) if n > 1 else new

    def delete(self) -> None:
        self._fs.delete(self._path, True)


def repeated_lines(parts: list[DataFrame], min_docs: int = MIN_DOCS) -> DataFrame:
    """doc, row, line_no of every repeated line, after merging the parts one after the other into a store of this run."""
    store = LineStore.temporary(parts[0].sparkSession, min_docs)
    for part in parts:
        store.merge(part)
    places = checkpointed(store.repeated())
    store.delete()
    return places


def without_lines(docs: DataFrame, drop: DataFrame, key: Column, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` with the lines `drop(doc, row, line_no)` cut out of their text; rows without any come out as they are."""
    gone = drop.groupBy(F.col("doc").alias("_doc"), F.col("row").alias("_row")).agg(F.collect_set("line_no").alias("_drop"))
    rows = docs.withColumn("_key", key).join(gone, F.col(doc).cast("string").eqNullSafe(F.col("_doc")) & (F.col("_key") == F.col("_row")), "left")
    kept = F.filter(F.transform(F.split(text, "\n"), lambda x, i: F.when(~F.array_contains("_drop", i + 1), x)), lambda x: x.isNotNull())
    return rows.withColumn(text, F.when(F.col("_drop").isNull(), F.col(text)).otherwise(F.array_join(kept, "\n"))).drop("_key", "_doc", "_row", "_drop")


def by_age(docs: DataFrame, at: str = "crawled_at") -> list[DataFrame]:
    """The documents as two partitions in crawl order: all but the newest year, then the newest; undated ones first."""
    year = F.substring(F.col(at), 1, 4)
    newest = docs.agg(F.max(year)).first()[0]
    if newest is None:
        return [docs]
    late = F.coalesce(year == newest, F.lit(False))
    return [docs.where(~late), docs.where(late)]


def found(docs: DataFrame) -> DataFrame:
    """doc_id, line_no of lines that stand in at least MIN_DOCS documents of their domain. Rows of one doc_id count once."""
    parts = [numbered_lines(p) for p in by_age(docs)]
    return repeated_lines(parts).select(F.col("doc").alias("doc_id"), "line_no").where(F.col("doc_id").isNotNull()).distinct()


def cleaned(docs: DataFrame) -> DataFrame:
    """doc_id, crawled_at, text of every row without its repeated lines; rows without any come out as they are."""
    key = row_key("domain", "crawled_at", "text")
    drop = repeated_lines([numbered_lines(p, row=key) for p in by_age(docs)])
    return without_lines(docs, drop, key).select("doc_id", "crawled_at", "text")
