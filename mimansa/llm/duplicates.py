"""Duplicates hidden by formatting: range partition and sort canonical records, then scan adjacent runs.

The canonical key is the whole record in one unambiguous string; keys are compared in full, never by hash. Records are
range-partitioned by (key, id), so a key that owns a third of all rows is spread over many partitions, and sorted
within each, where the sort spills to disk as it needs. A scan compares neighbours and numbers runs. Only the runs that
touch the edge of a partition can go on in the next one: at most two a partition, which are stitched by key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mimansa.plans.support import checkpointed, shuffle_width

SCANNED = "row long, no_id boolean, first long, first_no_id boolean, run long, part int, edge_key string, n long"


def squeezed(column: str | Column) -> Column:
    """Letters and digits alone, lower-cased; null as blank."""
    return F.coalesce(F.lower(F.regexp_replace(column, r"[^\p{L}\p{Nd}]+", "")), F.lit(""))


def canonical_key(either_order: list[str], exact: list[str]) -> Column:
    """One string for a record: the squeezed fields in sorted order, then the exact fields with nulls marked."""
    loose = F.array_sort(F.array(*[squeezed(c) for c in either_order]))
    return F.to_json(F.struct(loose.alias("a"), *[F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")).alias(f"b{i}") for i, c in enumerate(exact)]))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers the runs of equal keys in one sorted partition; rows of its first and its last run carry their key once."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    last_key, run, first, first_no_id = None, -1, 0, False

    def out(rows, no_ids, firsts, firsts_no_id, runs, keys, counts):
        n = len(rows)
        columns = [pa.array(rows, pa.int64()), pa.array(no_ids, pa.bool_()), pa.array(firsts, pa.int64()), pa.array(firsts_no_id, pa.bool_()), pa.array(runs, pa.int64())]
        columns += [pa.array(np.full(n, part, dtype=np.int32)), pa.array(keys, pa.string()), pa.array(counts, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=["row", "no_id", "first", "first_no_id", "run", "part", "edge_key", "n"])

    for batch in batches:
        if not batch.num_rows:
            continue
        keys, rows, no_ids = batch.column("key"), batch.column("row").to_numpy(zero_copy_only=False), batch.column("no_id").to_numpy(zero_copy_only=False)
        n = len(rows)
        change = np.empty(n, dtype=bool)
        change[0] = last_key is None or keys[0].as_py() != last_key
        change[1:] = pc.not_equal(keys.slice(1), keys.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        runs = run + np.cumsum(change)
        starts = np.flatnonzero(change)
        firsts, firsts_no_id = np.full(n, first, dtype=np.int64), np.full(n, first_no_id, dtype=bool)
        if len(starts):
            sizes = np.diff([*starts, n])
            firsts[starts[0] :], firsts_no_id[starts[0] :] = np.repeat(rows[starts], sizes), np.repeat(no_ids[starts], sizes)
        edge = [None] * n
        if run < 0:  # the first run of the partition
            edge[0] = keys[0].as_py()
        yield out(rows, no_ids, firsts, firsts_no_id, runs, edge, np.ones(n, dtype=np.int64))
        run, first, first_no_id, last_key = int(runs[-1]), int(firsts[-1]), bool(firsts_no_id[-1]), keys[-1].as_py()
    if run > 0:  # the last run, in a row of its own that counts nothing
        yield out(np.array([-1]), np.array([False]), np.array([first]), np.array([first_no_id]), np.array([run]), [last_key], np.array([0]))


def _named(df: DataFrame, id_column: str) -> tuple[Column, Column]:
    """What tells a row: its id or, for a row without one, the hash of all its fields; and whether it has none."""
    whole = F.xxhash64(F.to_json(F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(df.columns)])))
    return F.coalesce(F.col(id_column).cast("bigint"), whole), F.col(id_column).isNull()


def duplicate_groups(df: DataFrame, id_column: str, either_order: list[str], exact: list[str]) -> DataFrame:
    """row, no_id, first, first_no_id: every row of `df` with the first of its group, the smallest id.

    `row` is the id. A row with a null id takes part as well: `no_id` is true and `row` a hash of its fields; it is the
    first of its group only if no row of it has an id. Ids that are not null must be unique. Nulls in any field are
    values like others; blank and null are one value in the loose fields only. An empty table gives an empty result.
    """
    row, no_id = _named(df, id_column)
    keyed = df.select(row.alias("row"), no_id.alias("no_id"), canonical_key(either_order, exact).alias("key"))
    runs = keyed.repartitionByRange(shuffle_width(df.sparkSession), "key", "no_id", "row").sortWithinPartitions("key", "no_id", "row")
    scanned = checkpointed(runs.mapInArrow(_scan, SCANNED))
    # at most two edge runs a partition, so this table is bounded by twice the number of partitions
    edges = scanned.where(F.col("edge_key").isNotNull()).select("part", "run", "edge_key", F.struct("first_no_id", "first").alias("edge_first")).distinct()
    stitched = edges.groupBy("edge_key").agg(F.min("edge_first").alias("whole")).join(edges, "edge_key").select("part", "run", "whole")
    rows = scanned.where(F.col("n") == 1).join(F.broadcast(stitched), ["part", "run"], "left")
    return rows.select("row", "no_id", F.coalesce("whole.first", "first").alias("first"), F.coalesce("whole.first_no_id", "first_no_id").alias("first_no_id"))


def collapsed(df: DataFrame, id_column: str, either_order: list[str], exact: list[str]) -> DataFrame:
    """One record for each group, the one with the smallest id, with the exact number of its copies as `copies`.

    A group whose rows all lack an id is one record with a null id.
    """
    counts = duplicate_groups(df, id_column, either_order, exact).groupBy("first", "first_no_id").agg(F.count("*").alias("copies"))
    row, no_id = _named(df, id_column)
    rows = df.withColumns({"_row": row, "_no_id": no_id}).drop("copies")
    kept = rows.join(counts.select(F.col("first").alias("_row"), F.col("first_no_id").alias("_no_id"), "copies"), ["_row", "_no_id"])
    return kept.dropDuplicates(["_row", "_no_id"]).drop("_row", "_no_id")


EITHER = ["brand_name", "manufacturer"]
EXACT = ["price_inr", "is_discontinued", "dosage_form", "pack_size", "pack_unit", "num_active_ingredients", "primary_ingredient", "primary_strength", "active_ingredients", "therapeutic_class"]


def retyped_rows(medicines: DataFrame) -> DataFrame:
    """row_id_first, row_id_copy of the medicines table; pairs name rows by their id, so rows without one are in none."""
    groups = duplicate_groups(medicines, "row_id", EITHER, EXACT).where(~F.col("no_id") & (F.col("row") != F.col("first")))
    return groups.select(F.col("first").alias("row_id_first"), F.col("row").alias("row_id_copy"))
