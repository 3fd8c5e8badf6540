"""What every plan needs: reading tables, cutting lineage, spreading small inputs, joins that survive hot keys."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only when it was counted and has no more rows than this.
BROADCAST_ROWS = 200_000
#: From this many rows on, one key counts as hot.
HOT_KEY_ROWS = 10_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def spread(df: DataFrame, *cols: str) -> DataFrame:
    """Repartitions a scan that has fewer partitions than the cluster has cores; a large scan stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df._jdf.rdd().getNumPartitions() >= cores:
        return df
    return df.repartition(cores, *cols) if cols else df.repartition(cores)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_folder(spark: SparkSession) -> str:
    """The shared folder of the session, from spark.checkpoint.dir.

    Only a session in one process, as in tests, gets a folder of its own where none is set; a cluster without one is an
    error, for a folder of one machine is lost to the others.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not re.fullmatch(r"local(?:\[[^\]]*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all nodes share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="mimansa-ckpt-"))
    return sc._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder of the session."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """`df` marked for broadcast if it has no more than `rows` rows, else as it is, for Spark to shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def hot_safe_join(big: DataFrame, small: DataFrame, on: list[str], rows_per_key: str, hot: int = HOT_KEY_ROWS) -> DataFrame:
    """Inner join for a `small` side with unique keys of which some may own a large part of `big`.

    `rows_per_key` is a column of `small` that bounds the rows of `big` with that key. Hot keys are counted first:
    up to BROADCAST_ROWS of them go by broadcast, so no task gathers them; beyond that they are salted. All other keys
    go through an ordinary shuffle, where no key has more than `hot` rows. No row is lost on either way.
    """
    small = checkpointed(small)
    heavy = small.where(F.col(rows_per_key) >= hot)
    n = heavy.count()
    light = big.join(small.where(F.col(rows_per_key) < hot), on)
    if n == 0:
        return light
    if n <= BROADCAST_ROWS:
        return light.unionByName(big.join(F.broadcast(heavy), on))
    salts = 64
    salted = heavy.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    spread_big = big.withColumn("_salt", F.pmod(F.xxhash64(*big.columns), F.lit(salts)).cast("int"))
    return light.unionByName(spread_big.join(salted, [*on, "_salt"]).drop("_salt"))
