"""A table of answers by key, which keeps what finished tasks have brought even if their job fails.

The table is Parquet, bucketed by the key: a probe shuffles the asked keys to the buckets, not the table.
Calls run in tasks of a bounded number of rows.  A task's file goes to its final place when the task
ends (version 2 of the file committer), and a failed or killed job leaves it there, so the next run
calls only what is missing.  A task that ran twice may leave a key twice; a probe takes one of these.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry import workspace

BUCKETS = 16
#: Calls that a failing task can lose.
ROWS_PER_TASK = 1_000


class Answers:
    """``key`` and the columns of ``result`` (a DDL string) below ``path``."""

    def __init__(self, spark: SparkSession, path: str, result: str, key: str = "cache_key", buckets: int = BUCKETS, rows_per_task: int = ROWS_PER_TASK):
        self.spark, self.path, self.key, self.buckets, self.rows_per_task = spark, path.rstrip("/"), key, buckets, rows_per_task
        self.schema = f"{key} string, {result}"
        self.names = [f.split()[0] for f in self.schema.split(", ")]
        self.table = "answers_" + hashlib.md5(f"{self.path} {self.schema} {buckets}".encode()).hexdigest()

    def _defined(self) -> str:
        """The name under which this session knows the files; the files themselves are all there is to keep."""
        self.spark.sql(
            f"create table if not exists {self.table} ({self.schema}) using parquet options ('mapreduce.fileoutputcommitter.algorithm.version'='2') "
            f"clustered by ({self.key}) into {self.buckets} buckets location '{self.path}'"
        )
        self.spark.catalog.refreshTable(self.table)
        return self.table

    def rows(self) -> DataFrame:
        """Everything there is now, with keys that were answered twice as two rows.

        Spark takes two scans of a folder for one, whatever files each has listed, and lets the second reuse the
        shuffled rows of the first; a filter of its own, which every key passes, keeps each reading apart.
        """
        return self.spark.table(self._defined()).filter(F.col(self.key) != f"read {uuid.uuid4().hex}")

    def found(self, keys: DataFrame) -> DataFrame:
        """One answer for each of ``keys`` that has any."""
        rows = self.rows()
        mine = rows.join(keys.select(self.key).distinct(), self.key, "left_semi")
        record = F.struct(*[c for c in self.names if c != self.key])
        return mine.groupBy(self.key).agg(F.first(record).alias("r")).select(self.key, "r.*")

    def missing(self, rows: DataFrame) -> DataFrame:
        """One row for each key of ``rows`` without an answer."""
        return rows.dropDuplicates([self.key]).join(self.rows().select(self.key), self.key, "left_anti")

    def add(self, rows: DataFrame) -> None:
        """Append rows; what a task has brought is kept when it ends, whatever becomes of the others."""
        self._defined()
        rows.select(*self.names).write.format("parquet").mode("append").bucketBy(self.buckets, self.key).option("mapreduce.fileoutputcommitter.algorithm.version", "2").saveAsTable(self.table)

    def bring(self, rows: DataFrame, call: Callable[[pd.DataFrame], pd.DataFrame], batch: int = 100) -> int:
        """Call for what is missing, in batches within tasks; how many keys were asked for.

        ``call`` gives a row of ``result`` for each row, in order, or rows with the key where it can't
        answer all of them; keys without an answer are missing again next time.
        """
        asked = workspace.materialize(self.missing(rows), "asked")
        n = asked.count()
        if n:
            key, names = self.key, self.names

            def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                for part in batches:
                    for k in range(0, len(part), batch):
                        some = part.iloc[k : k + batch].reset_index(drop=True)
                        got = call(some)
                        yield (got if key in got else pd.concat([some[key], got], axis=1))[names]

            # A multiple of the buckets: the keys of a task belong to one bucket, and so to one file.
            tasks = self.buckets * -(-n // (self.buckets * self.rows_per_task))
            self.add(asked.repartition(tasks, self.key).mapInPandas(run, self.schema))
        workspace.release(asked)
        return n
