"""Pieces that several corpus operators share."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in one Arrow batch for operators that read whole texts. It bounds a
#: Python worker's memory: batches are processed one at a time.
TEXT_BATCH_ROWS = 2000

#: The white space of the word rules, as a Java/DuckDB class body.
SPACE_CLASS = r"\x20\x09-\x0D"
WORD_PATTERN = rf"[^{SPACE_CLASS}]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the setting is absent (tests in one local JVM) a temporary folder is
    set once for the session; on a cluster its absence is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="braidlog-"))
    return sc._jsc.sc().getCheckpointDir().get()


def work_dir(spark: SparkSession, kind: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and cut its lineage there."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def tidy(spark: SparkSession) -> None:
    """Let go of shuffle files and checkpoints that no plan refers to any longer.

    Spark deletes them when the driver collects its garbage, which a driver with
    memory to spare may not do while a loop of many rounds fills the disks.
    """
    gc.collect()
    spark._jvm.System.gc()


def small_batches(spark: SparkSession, rows: int = TEXT_BATCH_ROWS) -> None:
    """Keep Arrow batches of texts small; an already smaller setting stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows or int(spark.conf.get(key)) <= 0:
        spark.conf.set(key, str(rows))


def _signature(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"),
                  F.bit_xor(F.xxhash64("v", "u")).alias("y")).first()
    return r["n"], r["x"], r["y"]


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Components of an undirected graph given as links ``(a, b)`` of longs.

    Returns ``(node, component)`` for every node with a link to another node;
    ``component`` is the smallest node reachable. Loops and repeated links are
    allowed; rows with a null end are ignored; no links give no rows.

    Alternates the large-star and small-star steps, which take O(log^2 n)
    rounds. Each round is two aggregations joined back to the links, so a hub
    is pre-aggregated before the shuffle and its join side may be split; no
    group is gathered. Each round is checkpointed to the shared folder.
    """
    u, v = F.least(a, b), F.greatest(a, b)
    links = cut(edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
                .select(v.cast("long").alias("u"), u.cast("long").alias("v")).distinct())
    seen = _signature(links)
    while seen[0]:
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.where("v > u").join(low, "u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        links = cut(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                    .union(low.select("u", F.col("m").alias("v"))).distinct())
        now = _signature(links)
        tidy(links.sparkSession)
        if now == seen:
            break
        seen = now
    return (links.select(F.col("u").alias("node"), F.col("v").alias("component"))
            .union(links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()))
