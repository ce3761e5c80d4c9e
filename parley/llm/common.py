"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in one Arrow batch. Its bytes are bounded by spark.sql.execution.arrow.maxBytesPerBatch (64 MB unless set).
ROWS_PER_BATCH = 2000


def bounded_batches(spark: SparkSession, rows: int = ROWS_PER_BATCH) -> None:
    """Lower the Arrow batch size of the session, which later queries keep, if it is above ``rows``."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= rows:
        spark.conf.set(key, str(rows))


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a temporary one only in local mode, where none is named."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage with files in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Cut lineage with a compressed table in the shared folder: smaller than a checkpoint, and its size is known to the planner."""
    path = f"{shared_folder(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_by(df: DataFrame, column: str) -> DataFrame:
    """``stored``, dealt by the hash of a column, so that grouping and joining by it need no shuffle of the table."""
    spark, name = df.sparkSession, f"stored_{uuid.uuid4().hex}"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    written = df.write.format("parquet").option("compression", "zstd").option("path", f"{shared_folder(spark)}/tables/{name}")
    written.bucketBy(parts, column).saveAsTable(name)
    return spark.table(name)


def by_text(docs: DataFrame, run: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], columns: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ``columns`` from batches of (doc_id, text). Ids travel as text, so that longs beside nulls don't become doubles."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(run, f"doc_id string, {columns}").withColumn("doc_id", F.col("doc_id").cast(kind))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores put before it until no column of ``df`` is called that."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def hashed_share(column, share: float, seed: int):
    """A condition that holds for about ``share`` of the values of ``column``.

    The hash of the value decides, so the same rows are taken at every run and
    on every retry of a task.
    """
    return F.pmod(F.xxhash64(F.lit(seed), column), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))


def connected_components(edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """(node, component) for every node of ``edges`` (columns src, dst; long).

    component is the smallest node reachable. Alternating large-star and
    small-star rounds: each round is two grouped minima and joins, so neither
    the driver nor one task ever holds a component. Self-links are ignored,
    repeated links count once; an empty input gives an empty result. Rounds
    grow with the logarithm of the longest chain; an error is raised if
    ``most_rounds`` don't settle it.
    """
    a, b = F.col("src"), F.col("dst")
    links = stored(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct())
    before = None
    for _ in range(most_rounds):
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = stored(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        now = tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            roots = links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
        before = now
    raise RuntimeError(f"components aren't settled after {most_rounds} rounds")
