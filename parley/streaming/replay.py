"""Running a stream over stored rows in steps, with state kept between the runs."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the checkpoint folder that the cluster names; a temporary one only in local mode, where none is named.

    What a replay writes there stays until its result has been used; ``spark.cleaner`` doesn't know it, so give the folder a lifetime.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="spark-stream-")
    return f"{root.rstrip('/')}/stream-{uuid.uuid4().hex}"


def stored(rows: DataFrame) -> DataFrame:
    """``rows``, worked out once and read from the shared folder from then on: for steps that are cut from the same rows."""
    at = f"{shared_folder(rows.sparkSession)}/rows"
    rows.write.parquet(at)
    return rows.sparkSession.read.schema(rows.schema).parquet(at)


def replay_all(steps: list[list[DataFrame]], stream: Callable[..., DataFrame], mode: str = "update") -> DataFrame:
    """Append each step to the source folders of the stream's inputs and let it take what is new; returns all rows that it put out, with ``batch``.

    Every run resumes from the checkpoint of the one before, so state and
    offsets live in the shared folder and not in a process. The sink writes a
    folder per micro-batch number, so a batch that is run again replaces its own rows.
    """
    spark = steps[0][0].sparkSession
    home = shared_folder(spark)
    for inputs in steps:
        sources = []
        for i, rows in enumerate(inputs):
            rows.write.mode("append").parquet(f"{home}/source{i}")
            sources.append(spark.readStream.schema(rows.schema).parquet(f"{home}/source{i}"))

        def put(found: DataFrame, number: int) -> None:
            found.write.mode("overwrite").parquet(f"{home}/out/batch={number}")

        query = stream(*sources).writeStream.outputMode(mode).option("checkpointLocation", f"{home}/state").trigger(availableNow=True).foreachBatch(put).start()
        query.awaitTermination()
    return spark.read.parquet(f"{home}/out")


def replay(steps: list[DataFrame], stream: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``replay_all`` for a stream with one input."""
    return replay_all([[rows] for rows in steps], stream)


def current(found: DataFrame, keys: list[str]) -> DataFrame:
    """What stands after the last micro-batch: the newest row of each key, so provisional rows give way to final ones."""
    w = Window.partitionBy(*keys).orderBy(F.desc("batch"))
    return found.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") == 1).drop("_rank", "batch")
