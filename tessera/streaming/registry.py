"""Continuous ingest: registries that mint once, and de-duplication across micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tessera.operators.facts import mint


def dedup_stream(rows: DataFrame, keys: list[str], event_time: str, delay: str = "1 hour") -> DataFrame:
    """Rows whose keys haven't come within the watermark; state is bounded by ``delay``."""
    return rows.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(keys)


def windowed_counts(rows: DataFrame, event_time: str, key: str, width: str = "10 minutes", delay: str = "1 hour") -> DataFrame:
    from pyspark.sql import functions as F

    return rows.withWatermark(event_time, delay).groupBy(F.window(event_time, width), key).agg(F.count(F.lit(1)).alias("n"))


def mint_stream(codes: DataFrame, code: str, number: str, base: int, registry_path: str, checkpoint: str) -> StreamingQuery:
    """Append numbers for new codes of each micro-batch to the registry.

    A batch writes a folder of its own, and overwrites it when it is replayed
    after a failure, so a code gets one number whatever happens.
    """

    def one(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        schema = f"{code} {dict(batch.dtypes)[code]}, {number} long, batch long"
        known = spark.read.schema(schema).parquet(registry_path) if _exists(spark, registry_path) else spark.createDataFrame([], schema)
        before = known.where(known.batch != batch_id).select(code, number)
        mint(batch, before, code, number, base).write.mode("overwrite").parquet(f"{registry_path}/batch={batch_id}")

    return codes.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _exists(spark, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
