"""Exact deduplication that goes on from call to call (native): the keyed state stays in a named folder.

:func:`skerry.llm.exact_dedup.exact_dedup` decides about one table. Here a table is a *call* on a state
that outlives it: its rows meet those of all earlier calls, in other sessions, too.  The folder has

* ``intake/call-N``: one narrow row per document of a call;
* ``contents/call-N``: the normalised text of every key that the call saw first, once;
* ``checkpoint``: the streaming query's progress and its RocksDB state, without expiry;
* ``updates/batch=N``: the state's rows that a batch changed.

Before its rows enter the state, digests that a call shares with an earlier one or has twice are checked
by full texts against the contents; texts that share a digest get keys of their own.  A call is numbered
by the caller.  The same number again is the same call: what it wrote before it failed is used or
replaced, and its rows count once.

Defined results: as in :mod:`skerry.llm.exact_dedup`, over the rows of all calls so far.  One row comes
back per row of this call; a row of an earlier call stays until one with more code points, or as many and
a smaller identifier, comes; of rows equal in both the earlier call's stays, then the first one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry import workspace
from skerry.llm.exact_dedup import STATE_CONF, _with_digest, sha256_digest

CONTENTS = "digest string, key string, norm string"
INTAKE = "doc_id long, length long, key string, text_sha256 string, locator string, call long, row long"


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def _part(state: str, table: str, call: int) -> str:
    return f"{state.rstrip('/')}/{table}/call-{call:09d}"


def _contents(spark: SparkSession, state: str, call: int) -> DataFrame:
    """The contents of the other calls whose intake is whole."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{state.rstrip('/')}/intake/call-*/_SUCCESS")
    found = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(hadoop) or []
    calls = sorted(int(f.getPath().getParent().getName().rsplit("-", 1)[1]) for f in found)
    paths = [_part(state, "contents", c) for c in calls if c != call]
    return spark.read.schema(CONTENTS).parquet(*paths) if paths else spark.createDataFrame([], CONTENTS)


def _take_in(docs: DataFrame, state: str, call: int, digest: Callable[[Column], Column], id_col: str, text_col: str) -> None:
    """Write the contents that this call saw first, then its intake."""
    spark = docs.sparkSession
    rows = _with_digest(docs, id_col, text_col, lambda norm: digest(norm).cast("string"))
    known = _contents(spark, state, call)
    counts = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n"))
    counts = workspace.materialize(counts.join(known.select("digest").distinct().withColumn("old", F.lit(True)), "digest", "left"), "intake-counts")
    hit = counts.filter("n > 1 or old").select("digest")
    texts = workspace.materialize(rows.join(hit, "digest", "left_semi"), "intake-texts")
    old = workspace.materialize(known.join(hit, "digest", "left_semi"), "intake-known")

    every = texts.select("digest", "norm").unionByName(old.select("digest", "norm"))
    reference = workspace.materialize(every.groupBy("digest").agg(F.min("norm").alias("reference")), "intake-reference")
    shared = workspace.materialize(every.join(reference, "digest").filter("norm <> reference").select("digest").distinct(), "intake-shared")
    named = texts.join(shared, "digest", "left_semi").groupBy("digest", "norm").agg(F.min("row").alias("least"))
    named = named.join(old, ["digest", "norm"], "left").select("digest", "norm", F.coalesce("key", F.concat_ws(":", "digest", F.lit(str(call)), "least")).alias("key"))
    named = workspace.materialize(named, "intake-named")

    def keyed(part: DataFrame) -> DataFrame:
        plain = part.join(shared, "digest", "left_anti").withColumn("key", F.col("digest"))
        return plain.unionByName(part.join(named, ["digest", "norm"]).select(*plain.columns))

    single = rows.join(hit, "digest", "left_anti").select("digest", F.col("digest").alias("key"), "norm")
    first = keyed(texts).groupBy("digest", "key").agg(F.min("norm").alias("norm")).join(old.select("key"), "key", "left_anti")
    single.unionByName(first.select("digest", "key", "norm")).write.mode("overwrite").parquet(_part(state, "contents", call))

    several = keyed(texts).select("doc_id", "length", "key", "norm", "locator", "row")
    intake = rows.join(hit, "digest", "left_anti").select("doc_id", "length", F.col("digest").alias("key"), "norm", "locator", "row").unionByName(several)
    intake = intake.select("doc_id", "length", "key", sha256_digest(F.col("norm")).alias("text_sha256"), "locator", F.lit(call).cast("long").alias("call"), "row")
    intake.write.mode("overwrite").parquet(_part(state, "intake", call))
    for made in (counts, texts, old, reference, shared, named):
        workspace.release(made)


def _run(spark: SparkSession, state: str, files_per_trigger: int) -> None:
    """Let the stateful query take what the intake has and it hasn't seen."""
    state = state.rstrip("/")
    best = F.struct(F.col("length"), *[F.bitwise_not(c).alias(f"neg_{c}") for c in ("doc_id", "call", "row")], F.col("locator"))
    seen = (
        spark.readStream.schema(INTAKE).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{state}/intake/call-*")
        .groupBy("key").agg(F.max(best).alias("best"), F.count(F.lit(1)).alias("seen"))
    )

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{state}/updates/batch={number}")

    before = {name: spark.conf.get(name, None) for name in STATE_CONF}
    for name, value in STATE_CONF.items():
        spark.conf.set(name, value)
    try:
        seen.writeStream.outputMode("update").option("checkpointLocation", f"{state}/checkpoint").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def continued(
    docs: DataFrame, state: str, call: int, id_col: str = "doc_id", text_col: str = "text", *,
    digest: Callable[[Column], Column] = sha256_digest, files_per_trigger: int = 4096,
) -> DataFrame:
    """The rows of this call: doc_id, keep_id, group_size, kept, text_sha256, locator, keep_locator, keep_call.

    ``state`` is a folder that driver and executors share; one call at a time may work on it, and all by
    the same ``digest``.  What was decided is as of now: later calls may let another row stay.
    """
    spark = docs.sparkSession
    if not 0 <= call < 10**9:
        raise ValueError("calls are numbered from 0 to 999999999")
    if not _exists(spark, f"{_part(state, 'intake', call)}/_SUCCESS"):
        _take_in(docs, state, call, digest, id_col, text_col)
    _run(spark, state, files_per_trigger)
    intake = spark.read.schema(INTAKE).parquet(_part(state, "intake", call))
    updates = f"{state.rstrip('/')}/updates"
    if not _exists(spark, updates):
        groups = spark.createDataFrame([], "key string, best struct<length: long, neg_doc_id: long, neg_call: long, neg_row: long, locator: string>, seen long")
    else:
        # Both columns of a key only grow from batch to batch, so their maximum is the state.
        groups = spark.read.parquet(f"{updates}/batch=*").join(intake.select("key"), "key", "left_semi")
        groups = groups.groupBy("key").agg(F.max("best").alias("best"), F.max("seen").alias("seen"))
    kept = (F.bitwise_not("best.neg_row") == F.col("row")) & (F.bitwise_not("best.neg_call") == F.col("call"))
    return intake.join(groups, "key").select(
        "doc_id", F.bitwise_not("best.neg_doc_id").alias("keep_id"), F.col("seen").alias("group_size"), kept.alias("kept"), "text_sha256", "locator",
        F.col("best.locator").alias("keep_locator"), F.bitwise_not("best.neg_call").alias("keep_call"),
    )
