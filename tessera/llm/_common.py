"""Helpers shared by the corpus operators: reading, Arrow batches, hashing, checkpoints."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python worker handles at once; a single longer text is handled alone.
SLICE_BYTES = 2 << 20

_MASK = (1 << 64) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(texts: list, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts together stay under ``limit`` bytes (one row at least)."""
    start = held = 0
    for i, text in enumerate(texts):
        n = len(text) if text is not None else 0
        if i > start and held + n > limit:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(texts):
        yield start, len(texts)


def utf8(column: pa.Array) -> list:
    """A string column as bytes (null: None)."""
    return column.cast(pa.large_string()).cast(pa.large_binary()).to_pylist()


def text_slices(column: pa.Array, limit: int) -> Iterator[tuple[int, int, list]]:
    """Ranges of rows under ``limit`` bytes with their texts as bytes; no more than one range is held as objects."""
    lengths = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths)
    start = 0
    while start < len(lengths):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + limit, "right")))
        yield start, stop, utf8(column.slice(start, stop - start))
        start = stop


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


class WordHash(dict):
    """64-bit hash of each word; remembers up to ``limit`` words (a cache, hashes never change)."""

    limit = 150_000

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < self.limit:
            self[word] = value
        return value

    def of(self, words: list) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, a bijection of 64-bit words."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def odd_multipliers(n: int, seed: int) -> np.ndarray:
    """``n`` odd 64-bit multipliers, the same on every machine."""
    return np.array([xxhash.xxh64_intdigest(f"{seed}:{i}") | 1 for i in range(n)], np.uint64)


def rolling(words: np.ndarray, width: int, seed: int) -> np.ndarray:
    """Hash of each run of ``width`` consecutive word hashes.

    A polynomial in a fixed odd multiplier, computed by doubling: O(log width)
    passes over the array.  Runs shorter than ``width`` have none.
    """
    if len(words) < width:
        return np.empty(0, np.uint64)
    base = int(odd_multipliers(1, seed)[0])
    power, have, done, total = base, mix(words ^ np.uint64(seed)), 0, None
    size = 1
    rest = width
    while rest:
        if rest & 1:
            if total is None:
                total, done = have, size
            else:  # total covers the first done words, have the next size words
                n = len(words) - done - size + 1
                total = total[:n] * np.uint64(pow(base, size, 1 << 64)) + have[done : done + n]
                done += size
        rest >>= 1
        if rest:
            n = len(have) - size
            have = have[:n] * np.uint64(power) + have[size : size + n]
            power = power * power & _MASK
            size *= 2
    return mix(total[: len(words) - width + 1])


def shared_dir(spark: SparkSession) -> str:
    """A new path under the folder that the cluster names in spark.checkpoint.dir.

    Where that setting is absent (tests on one machine) the warehouse folder serves.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
    root = root or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_stages"
    return f"{root.rstrip('/')}/tessera-{uuid.uuid4().hex}"


_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage, survives lost executors.

    The shuffle files of the write go as it ends, as nothing reads them any more.
    """
    spark, path = df.sparkSession, shared_dir(df.sparkSession)
    before = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEAN, before)
    return spark.read.schema(df.schema).parquet(path)


def forget(*frames: DataFrame) -> None:
    """Delete the files behind settled frames that are no longer needed."""
    for df in frames:
        spark = df.sparkSession
        jvm = spark._jvm
        for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/tessera-" in name:
                path = jvm.org.apache.hadoop.fs.Path(name)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def by_group(df: DataFrame, groups: int, run, schema: str) -> DataFrame:
    """run (a table to a table) on the rows of each number in df's first column, which goes from 0 (or below) to ``groups``.

    Groups are dealt to partitions in turn and not by hash, so partitions hold equally many; a task holds one group at a time.
    """
    key, n = df.columns[0], min(groups, shuffle_parts(df.sparkSession))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            keys = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
            for i, j in zip(cuts, cuts[1:]):
                if i < j:
                    if held and held[0].column(0)[0].as_py() != keys[i]:
                        yield from run(pa.Table.from_batches(held)).to_batches()
                        held = []
                    held.append(batch.slice(i, j - i))
        if held:
            yield from run(pa.Table.from_batches(held)).to_batches()

    return df.repartitionById(n, F.pmod(F.col(key), F.lit(n))).sortWithinPartitions(key).mapInArrow(each, schema)


def documents_only(df: DataFrame) -> DataFrame:
    """doc_id and text alone, so that other columns can't clash with the operators' own."""
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def input_bytes(df: DataFrame) -> int:
    """Spark's own estimate of a frame's size, from its files' sizes."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def shards_for(df: DataFrame, shard_bytes: int = 8 << 20) -> int:
    """Shards that hold the entries of about ``shard_bytes`` of input each, so a shard's size doesn't grow with the input."""
    return max(shuffle_parts(df.sparkSession), min((1 << 31) - 1, -(-input_bytes(df) // shard_bytes)))

