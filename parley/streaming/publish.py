"""Publishing a stream of refined passages, once: each micro-batch is judged against what the batches before it left.

A store is a folder with the first rows and, for every micro-batch that took
something, a folder with the rows that it changed. A batch reads what stands
before its own number, so running it again after a failure finds the same rows,
takes the same candidates, and overwrites its own folder alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parley.operators.publishing import KEY, one_each, refined, refinements


class Store:
    """Rows of documents at ``path``. Every COMPACT batches the rows are written whole, so that reading them stays bounded."""

    COMPACT = 50

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def begin(self, rows: DataFrame) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/whole/number=-1")

    def _numbers(self, kind: str) -> list[int]:
        jvm, place = self.spark._jvm, f"{self.path}/{kind}"
        root = jvm.org.apache.hadoop.fs.Path(place)
        files = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(root):
            return []
        done = [x.getPath() for x in files.listStatus(root) if x.getPath().getName().startswith("number=")]
        return sorted(int(p.getName()[7:]) for p in done if files.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def rows(self, before: int | None = None, without: int | None = None) -> DataFrame:
        """What stands, or what stood before micro-batch ``before``: the last whole rows (but those of batch ``without``), with later changes in place."""
        fits = lambda kind: [n for n in self._numbers(kind) if before is None or n < before]
        base = [n for n in fits("whole") if n != without][-1]
        whole = self.spark.read.parquet(f"{self.path}/whole/number={base}")
        later = [n for n in fits("changed") if n > base]
        if not later:
            return whole
        schema = whole.schema
        each = [self.spark.read.schema(schema).parquet(f"{self.path}/changed/number={n}").withColumn("_number", F.lit(n)) for n in later]
        every = whole.withColumn("_number", F.lit(base))
        for x in each:
            every = every.unionByName(x)
        w = Window.partitionBy(*KEY).orderBy(F.desc("_number"))
        return every.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_number")

    def take(self, candidates: DataFrame, number: int) -> None:
        """A micro-batch of candidates; give it to ``foreachBatch``."""
        one = one_each(candidates)
        rows = self.rows(number)
        done = refinements(rows, one).where("outcome = 'published'").select(*KEY)
        changed = refined(rows.join(done, KEY, "left_semi"), one.drop("witnesses").withColumn("witnesses", F.expr("CAST(array() AS array<struct<passage_id: string, version: string>>)")))
        changed.write.mode("overwrite").parquet(f"{self.path}/changed/number={number}")
        if number % self.COMPACT == self.COMPACT - 1:
            self.rows(number + 1, number).write.mode("overwrite").parquet(f"{self.path}/whole/number={number}")


def published(candidates: DataFrame, store: Store, state: str):
    """A query that publishes streaming ``candidates`` into ``store`` until its input is used up; ``state`` is its checkpoint folder."""
    return candidates.writeStream.option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(store.take).start()
