"""Incremental ingestion: new document files are chunked as they come and upserted by chunk id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skerry.operators import chunking


def ingest(spark: SparkSession, source: str, schema: str, collection: str, checkpoint: str, size: int = 1000, overlap: int = 200) -> None:
    """Take what is new in ``source`` (Parquet files) once; a batch that runs again replaces its own files."""

    def write(batch: DataFrame, number: int) -> None:
        chunks = chunking.chunk(chunking.document_sections(batch), size, overlap)
        chunks.write.mode("overwrite").parquet(f"{collection}/batch={number}")

    query = (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", 1000).parquet(source)
        .writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
    )
    query.awaitTermination()


def collection_rows(spark: SparkSession, collection: str) -> DataFrame:
    """The collection with one row per chunk id: of several batches the last counts."""
    from pyspark.sql import functions as F

    rows = spark.read.parquet(collection)
    record = F.struct(*[c for c in rows.columns if c != "batch"])
    return rows.groupBy("chunk_id").agg(F.max_by(record, "batch").alias("r")).select("r.*")
