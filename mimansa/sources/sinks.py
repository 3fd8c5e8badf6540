"""Writers: page tables, stored pages, metric files."""

from __future__ import annotations

import json
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, by: list[str] | None = None, mode: str = "overwrite") -> None:
    """A Parquet table, partitioned by columns of few values where they are given."""
    writer = df.write.mode(mode)
    (writer.partitionBy(*by) if by else writer).parquet(path)


def write_pages(pages: DataFrame, path: str) -> None:
    """Page bodies by the first two digits of their hash; a body is found by its hash."""
    write_table(pages.withColumn("shard", F.substring("content_hash", 1, 2)), path, ["shard"], "append")


def formatted(df: DataFrame) -> DataFrame:
    """All columns as text for a report: nulls empty, booleans true or false, floats with 6 decimals."""
    kinds = dict(df.dtypes)
    show = {"double": lambda c: F.format_string("%.6f", c), "float": lambda c: F.format_string("%.6f", c)}
    cells = {c: F.when(F.col(c).isNotNull(), show.get(kinds[c], lambda x: x.cast("string"))(F.col(c))).otherwise("") for c in df.columns}
    return df.select(*[v.alias(c) for c, v in cells.items()])


def union_rows(frames: list[DataFrame]) -> DataFrame:
    """Rows of several results under the union of their columns."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def write_metrics(df: DataFrame, path: str) -> None:
    """A metrics result, a few rows by nature, as one CSV file with a header."""
    formatted(df).coalesce(1).write.mode("overwrite").csv(path, header=True)


def write_summary(values: dict, path: str) -> None:
    Path(path).write_text(json.dumps(values, indent=2, sort_keys=True, ensure_ascii=False) + "\n", encoding="utf-8")
