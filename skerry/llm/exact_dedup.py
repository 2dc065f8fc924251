"""Exact deduplication with disk-backed streaming state (native).

Texts are equal when they are identical after deleting every character of ``[\\x20\\x09-\\x0D]``.

Plan
----
1. One narrow row per document (digest, length, identifier, content locator) is written to the
   shared folder as the *intake*.
2. A Structured Streaming query reads the intake and aggregates it by digest.  Its state lives in
   RocksDB under a checkpoint in the shared folder, has no watermark and never expires.  Per digest
   it retains the best identifier, its locator and the number of rows.  Aggregation is partial
   before the shuffle, so a digest with a third of all rows arrives as one row per map task.
3. A digest seen once is final.  On hits (seen more than once) the full normalised texts are
   compared with the text of the row that stays; the rows of a digest that two texts share are
   regrouped by the texts themselves.

Defined results: a null text counts as empty; empty texts form one group; of equal texts the one
with the most code points stays, then the smallest doc_id (null last), then the first row; repeated
rows (even with one doc_id) are separate rows of which one stays; an empty table gives an empty
result; other columns of the input are ignored by :func:`exact_dedup` and kept by
:func:`keep_first`; a text of any length is one row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry import workspace

# The white space that the equality of texts ignores.
WHITE_SPACE = (" ", "\t", "\n", "\x0b", "\x0c", "\r")

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Settings of the stateful query; state is many small stores, so none may preallocate its files.
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}

#: Rows of (digest, keeper) that may be broadcast; some 100 bytes each, so 7 MB at most.
BROADCAST_ROWS = 65_536


def squeezed(text: Column) -> Column:
    """The text without white space; null is empty."""
    out = F.coalesce(text, F.lit(""))
    for char in WHITE_SPACE:
        out = F.replace(out, F.lit(char), F.lit(""))
    return out


def sha256_digest(normalised: Column) -> Column:
    return F.sha2(F.encode(normalised, "UTF-8"), 256)


def _rank(length: Column, doc_id: Column, row: Column) -> list[Column]:
    """Struct fields whose maximum is the row that stays (~x falls as x grows and can't overflow)."""
    return [length.alias("length"), F.bitwise_not(doc_id).alias("neg_id"), F.bitwise_not(row).alias("neg_row")]


def _state(spark: SparkSession, intake: str, schema, files_per_trigger: int) -> DataFrame:
    """Run the stateful query over the intake; one row per digest."""
    updates, checkpoint = workspace.new_path(spark, "dedup-updates"), workspace.new_path(spark, "dedup-state")
    best = F.struct(*_rank(F.col("length"), F.col("doc_id"), F.col("row")), F.col("locator"))
    seen = (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(intake)
        .groupBy("digest").agg(F.max(best).alias("best"), F.count(F.lit(1)).alias("seen"))
    )

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{updates}/batch={number}")

    before = {name: spark.conf.get(name, None) for name in STATE_CONF}
    for name, value in STATE_CONF.items():
        spark.conf.set(name, value)
    try:
        query = (
            seen.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).foreachBatch(write).start()
        )
        query.awaitTermination()
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    workspace.remove(spark, checkpoint)
    # Both columns only grow from batch to batch, so their maximum is the final state.
    return (
        spark.read.schema(seen.schema).parquet(f"{updates}/batch=*")
        .groupBy("digest").agg(F.max("best").alias("best"), F.max("seen").alias("seen"))
    )


def _with_digest(docs: DataFrame, id_col: str, text_col: str, digest: Callable[[Column], Column]) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    norm = squeezed(F.col(text_col))
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.length(text).cast("long").alias("length"), norm.alias("norm"), digest(norm).alias("digest"),
        F.concat_ws("#", F.input_file_name(), F.col(id_col).cast("string")).alias("locator"), F.monotonically_increasing_id().alias("row"),
    )


def _hits(groups: DataFrame) -> tuple[DataFrame, int]:
    hits = groups.filter("seen > 1").select("digest", F.bitwise_not("best.neg_id").alias("keep_id"), F.col("best.length").alias("keep_length"))
    return hits, hits.count()


def _sized(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast behind a size check; beyond it a shuffled join, whose hot keys AQE splits."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _collided(docs: DataFrame, hits: DataFrame, rows: int) -> tuple[DataFrame, DataFrame | None]:
    """Full comparison on hits: (texts of hits, digests that more than one text has, or None)."""
    texts = workspace.materialize(docs.join(_sized(hits, rows), "digest"), "dedup-hits")
    stays = texts.filter(F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("length") == F.col("keep_length")))
    reference = workspace.materialize(stays.groupBy("digest").agg(F.min("norm").alias("reference")), "dedup-reference")
    # Both sides are plain scans and nothing above needs a digest's rows together, so AQE may split a hot one.
    bad = workspace.materialize(texts.join(reference, "digest").filter("norm <> reference").select("digest"), "dedup-collisions")
    return texts, (None if bad.isEmpty() else bad.distinct())


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *,
    digest: Callable[[Column], Column] = sha256_digest, files_per_trigger: int = 4096,
) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, locator, keep_locator.

    ``digest`` is the state's key; equal digests of different texts are told apart by the texts.
    ``locator`` says where the row came from (file, else empty, and identifier).
    """
    spark = docs.sparkSession
    rows = _with_digest(docs, id_col, text_col, digest)
    intake = workspace.materialize(
        rows.select("doc_id", "length", F.col("digest").cast("string").alias("digest"), sha256_digest(F.col("norm")).alias("text_sha256"), "locator", "row"), "dedup-intake",
    )
    folder = intake.inputFiles()[0].rsplit("/", 1)[0]
    groups = workspace.materialize(_state(spark, folder, intake.schema, files_per_trigger), "dedup-groups")
    hits, n_hits = _hits(groups)
    bad = None
    if n_hits:
        texts, bad = _collided(rows.withColumn("digest", F.col("digest").cast("string")), hits, n_hits)
    if bad is not None:
        intake, groups = _regroup(intake, texts, bad, groups)
    out = intake.join(groups, "digest")
    return out.select(
        "doc_id", F.bitwise_not("best.neg_id").alias("keep_id"), F.col("seen").alias("group_size"),
        (F.bitwise_not("best.neg_row") == F.col("row")).alias("kept"), "text_sha256", "locator",
        F.col("best.locator").alias("keep_locator"),
    )


def _regroup(intake: DataFrame, texts: DataFrame, bad: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Give each different text of a shared digest a key of its own: the digest with the least row of the text."""
    shared = texts.join(bad, "digest", "left_semi")
    best = F.struct(*_rank(F.col("length"), F.col("doc_id"), F.col("row")), F.col("locator"))
    parts = shared.groupBy("digest", "norm").agg(F.max(best).alias("best"), F.count(F.lit(1)).alias("seen"), F.min("row").alias("least"))
    parts = workspace.materialize(parts.withColumn("key", F.concat_ws(":", "digest", F.col("least").cast("string"))), "dedup-parts")
    moved = shared.join(parts.select("digest", "norm", "key"), ["digest", "norm"])
    moved = moved.select("doc_id", "length", F.col("key").alias("digest"), sha256_digest(F.col("norm")).alias("text_sha256"), "locator", "row")
    intake = intake.join(bad, "digest", "left_anti").unionByName(moved)
    groups = groups.join(bad, "digest", "left_anti").unionByName(parts.select(F.col("key").alias("digest"), "best", "seen"))
    return workspace.materialize(intake, "dedup-regrouped"), groups


def keep_first(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *,
    digest: Callable[[Column], Column] = sha256_digest, files_per_trigger: int = 4096,
) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns.

    Rows whose digest is single pass through without a shuffle of their text; of the others one
    row per text is picked by an aggregate that is partial before the shuffle.
    """
    spark = docs.sparkSession
    rows = _with_digest(docs, id_col, text_col, lambda norm: digest(norm).cast("string"))
    intake = workspace.materialize(rows.select("doc_id", "length", "digest", "locator", "row"), "dedup-intake")
    folder = intake.inputFiles()[0].rsplit("/", 1)[0]
    groups = workspace.materialize(_state(spark, folder, intake.schema, files_per_trigger), "dedup-groups")
    hits, n_hits = _hits(groups)
    if not n_hits:
        return docs
    _, bad = _collided(rows, hits, n_hits)
    full = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("record"), F.col(id_col).cast("long").alias("doc_id"),
        F.length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("length"), squeezed(F.col(text_col)).alias("norm"),
    ).withColumn("digest", digest(F.col("norm")).cast("string"))
    marked = full.join(_sized(hits.select("digest", F.lit(True).alias("hit")), n_hits), "digest", "left")
    single = marked.filter("hit is null").select("record.*")
    key = ["digest"] if bad is None else ["digest", "norm"]
    best = F.max(F.struct(F.col("length"), F.bitwise_not("doc_id").alias("neg_id"), F.col("record")))
    picked = marked.filter("hit").groupBy(*key).agg(best.alias("best")).select("best.record.*")
    return single.unionByName(picked)
