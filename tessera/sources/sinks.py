"""Sinks: bucketed stores, sorted tables, guarded appends, cached results."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.numbers import bucket_of
from tessera.functions.text import code_sort_key, sanitise
from tessera.operators.facts import append_missing


def write_bucketed(facts: DataFrame, path: str, key: str, buckets: int = 256, by_source: str | None = None, mode: str = "append", compression: str = "zstd") -> None:
    """A Hive-partitioned store by bucket of the key, and by source if named.

    Rows of a bucket come together first, so a bucket has few files; a bucket's
    rows are split by a hash of the key so a hot bucket isn't one task.
    """
    parts = [*([by_source] if by_source else []), "bucket"]
    out = facts.withColumn("bucket", bucket_of(key, buckets)).repartition(*parts, F.pmod(F.xxhash64(key), F.lit(8)))
    writer = out.sortWithinPartitions(*parts, key).write.mode(mode).option("compression", compression)
    if by_source and mode == "overwrite":
        writer = writer.option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(*parts).parquet(path)


def write_tsv(df: DataFrame, path: str, order: Sequence = (), mode: str = "overwrite") -> None:
    """A headed TSV sorted by ``order`` over all its files; nulls and control characters as blanks."""
    text = df.select(*(sanitise(F.col(c).cast("string")).alias(c) for c in df.columns)) if not order else df.orderBy(*order).select(*(sanitise(F.col(c).cast("string")).alias(c) for c in df.columns))
    text.write.mode(mode).option("sep", "\t").option("header", True).option("emptyValue", "").option("nullValue", "").csv(path)


def append_guarded(df: DataFrame, path: str) -> None:
    """Append to a Parquet table of exactly these columns and types; anything else is refused."""
    spark = df.sparkSession
    have = spark.read.parquet(path).schema
    if [(f.name, f.dataType) for f in have] != [(f.name, f.dataType) for f in df.schema]:
        raise ValueError(f"{path} has {have.simpleString()}, not {df.schema.simpleString()}")
    df.write.mode("append").parquet(path)


def prune_store(spark: SparkSession, source: str, target: str, keep: DataFrame, key: str) -> None:
    """A copy of a bucketed store with the rows of kept keys alone; partitions left empty have no files."""
    df = spark.read.parquet(source)
    df.join(keep.select(key).distinct(), key, "left_semi").write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(target)


def fingerprint(df: DataFrame, **parameters: object) -> str:
    """What a result depends on: its input files' names and sizes, and the parameters; not their times."""
    spark = df.sparkSession
    conf = spark._jsc.hadoopConfiguration()
    sizes = []
    for name in sorted(df.inputFiles()):
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        sizes.append((name.rsplit("/", 1)[-1], path.getFileSystem(conf).getFileStatus(path).getLen()))
    return hashlib.sha256(json.dumps([sizes, sorted((k, str(v)) for k, v in parameters.items())]).encode()).hexdigest()


def cached(spark: SparkSession, path: str, mark: str, build) -> DataFrame:
    """A result stored under its fingerprint; built when there is none for it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{mark}/_SUCCESS")
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        build().write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/{mark}")
    return spark.read.parquet(f"{path}/{mark}")


def manifest(spark: SparkSession, path: str, *parts: str) -> DataFrame:
    """Rows, files and bytes of each partition of a stored table, from one pass over its files' metadata columns."""
    df = spark.read.parquet(path).select(*parts, F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_size").alias("_s"))
    each = df.groupBy(*parts, "_f", "_s").agg(F.count(F.lit(1)).alias("_n"))
    return each.groupBy(*parts).agg(F.sum("_n").alias("n_rows"), F.count(F.lit(1)).alias("n_files"), F.sum("_s").alias("n_bytes"))


#: The result tables of a prediction and their columns (fixed values of the format).
RESULTS = {
    "community": ("rank", "item", "score", "category", "n_contributing"),
    "differential": ("entity", "rank", "item", "score", "comp_score", "peer_median", "category"),
    "per_item": ("item", "rank", "entity", "score"),
    "per_entity": ("entity", "rank", "item", "score"),
}


def write_results(path: str, **tables: DataFrame) -> None:
    """The four result tables, each with its own columns in their order; a table that lacks one is refused before any is written."""
    for name, df in tables.items():
        missing = [c for c in RESULTS[name] if c not in df.columns]
        if missing:
            raise ValueError(f"{name} lacks {missing}")
    for name, df in tables.items():
        columns = RESULTS[name]
        write_tsv(df.select(*columns), f"{path}/{name}", [c for c in ("entity", "item") if c == columns[0]] + ["rank"])


def write_by_code(df: DataFrame, path: str, code: str, *rest: str) -> None:
    """A headed TSV in the numeric order of a dotted code, then by the rest."""
    levels = code_sort_key(code)
    write_tsv(df, path, [*(F.get(levels, F.lit(i)).asc_nulls_last() for i in range(4)), *rest])


def pruned(before: DataFrame, after: DataFrame, part: str = "bucket") -> DataFrame:
    """What a copy of a store left out, from both manifests: rows and bytes of each partition before and after."""
    a, b = (df.select(part, F.col("n_rows").alias(f"rows_{n}"), F.col("n_bytes").alias(f"bytes_{n}")) for df, n in ((before, "before"), (after, "after")))
    return a.join(b, part, "left").na.fill(0, ["rows_after", "bytes_after"])


def append_catalogue(current: DataFrame, new: DataFrame, key: str, limits: dict[str, int]) -> DataFrame:
    """Current entries and new ones of keys that it lacks, their texts cut to the lengths that the catalogue allows."""
    short = new.select(*(F.substring(c, 1, limits[c]).alias(c) if c in limits else F.col(c) for c in new.columns))
    return append_missing(current, short, key)
