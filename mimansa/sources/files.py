"""Readers: catalogs, lexicons, zone documents, judgements, weights, seeds, stored pages, uploaded texts."""

from __future__ import annotations

import csv
import io
import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mimansa.operators.catalog import check_columns
from mimansa.operators.index import ZONES

ZONE_SCHEMA = (
    "doc_id string, url string, domain string, title string, zone string, text string, state string, conditions array<string>, g_score double, crawled_at string, last_changed_at string, content_hash string"
)
MAX_UPLOAD = 10 * 1024 * 1024


def catalog_csv(spark: SparkSession, path: str) -> DataFrame:
    """A catalog as strings, with `row_id`, a stable number in file order. Short rows have nulls for what they lack.

    The number is the place in the file's own order of splits (64-bit, not dense), taken once and kept with the rows.
    """
    df = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True, mode="PERMISSIVE", inferSchema=False)
    check_columns(df)
    return df.withColumn("row_id", F.monotonically_increasing_id())


def lexicon_rows(text: str) -> list[tuple[str, str]]:
    """(source, target) rows: an optional header, # comments, exactly two columns."""
    rows = []
    for n, row in enumerate(csv.reader(io.StringIO(text)), 1):
        if not row or not "".join(row).strip() or row[0].lstrip().startswith("#"):
            continue
        if len(row) != 2:
            raise ValueError(f"line {n}: two columns wanted, {len(row)} found")
        source, target = row[0].strip(), row[1].strip()
        if not rows and source.lower() in ("source", "hinglish") and target.lower() == "canonical":
            continue
        if not source or not target:
            raise ValueError(f"line {n}: a column is blank")
        rows.append((source, target))
    return rows


def lexicon(spark: SparkSession, path: str) -> DataFrame:
    """source, targets (tokens in order of the file) of a lexicon file, which is small by nature and read on the driver."""
    from mimansa.functions.text import tokenize

    pairs = spark.createDataFrame([(i, s, t) for i, (s, t) in enumerate(lexicon_rows(Path(path).read_text(encoding="utf-8")))], "n int, source string, target string")
    words = pairs.select("n", tokenize("source").alias("s"), tokenize("target").alias("t")).where(F.size("s") == 1)
    grouped = words.groupBy(F.get("s", F.lit(0)).alias("source")).agg(F.array_sort(F.collect_list(F.struct("n", "t"))).alias("ts"))
    return grouped.select("source", F.array_distinct(F.flatten(F.transform("ts", lambda x: x["t"]))).alias("targets"))


def zone_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Zone documents, one JSON object a line; broken lines and unknown zones are errors."""
    df = spark.read.schema(ZONE_SCHEMA).json(path, mode="FAILFAST")
    bad = df.where(~F.lower(F.trim("zone")).isin(*ZONES)).select("zone").limit(1).collect()
    if bad:
        raise ValueError(f"unknown zone: {bad[0]['zone']!r}")
    return df


def judgements(spark: SparkSession, path: str) -> DataFrame:
    """query_id, doc_id of relevant pairs: those of a positive relevance."""
    return spark.read.schema("query_id string, doc_id string, relevance int").csv(path, header=True).where(F.col("relevance") > 0).select("query_id", "doc_id")


def queries_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("query_id string, query string").csv(path, header=True)


def declared_weights(path: str) -> dict | None:
    """Net-score weights of a JSON file; None if the file or any zone's weight is missing, for none is made up."""
    if not Path(path).is_file():
        return None
    data = json.loads(Path(path).read_text(encoding="utf-8"))
    return data if set(ZONES) <= set(data.get("zone_weights", {})) else None


def seeds(spark: SparkSession, path: str) -> DataFrame:
    """url, base_importance of a YAML seed list."""
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("reading a seed list takes the yaml package") from e
    data = yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}
    rows = data.get("seeds", []) if isinstance(data, dict) else data
    out = [(r, 1.0) if isinstance(r, str) else (r["url"], float(r.get("importance", r.get("base_importance", 1.0)))) for r in rows]
    return spark.createDataFrame(out, "url string, base_importance double")


def stored_html(spark: SparkSession, path: str, expected: DataFrame | None = None) -> DataFrame:
    """path, content_hash, html of stored files. With `expected(content_hash)`, files of other content are an error."""
    files = spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("content_hash"), F.regexp_replace(F.decode("content", "UTF-8"), "^\\x{FEFF}", "").alias("html"))
    if expected is not None:
        odd = files.join(expected.select("content_hash").distinct(), "content_hash", "left_anti").limit(1).collect()
        if odd:
            raise ValueError(f"unexpected content: {odd[0]['path']}")
    return files.where(F.trim("html") != "")


def uploaded_texts(spark: SparkSession, path: str) -> DataFrame:
    """path, text of uploaded text files of up to 10 MB; larger ones are an error."""
    files = spark.read.format("binaryFile").load(path)
    if (big := files.where(F.col("length") > MAX_UPLOAD).select("path").limit(1).collect()):
        raise ValueError(f"larger than 10 MB: {big[0]['path']}")
    return files.select("path", F.decode("content", "UTF-8").alias("text"))


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], T._parse_datatype_string(schema))
