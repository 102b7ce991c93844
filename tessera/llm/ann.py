"""Approximate nearest neighbours by randomly rotated one-bit codes.

1. Lists.  Up to ``max_lists`` centres are fitted on ``sample_rows`` rows at most
   (the least hashes of vec_id); every row goes to the list of its nearest
   centre, and a list to blocks of about ``block_rows`` rows.  A list's radius is
   the greatest distance of a row from its centre.
2. Codes.  A block takes its mean as centre, and each vector's residual, scaled to
   length one and rotated by a fixed random orthogonal matrix, keeps its signs
   alone: one bit a dimension, packed.  With <x, o> (code and residual) and the
   residual's length as correction scalars, the inner product with a query is
   estimated from popcounts of the code with the bit planes of the rotated,
   8-bit query.  The estimate's error is bounded by epsilon / sqrt(d - 1) times
   the part of the residual that the code leaves.  Vectors whose upper bound
   reaches the k-th largest lower bound are reranked on the original vectors in
   double precision, so an estimate decides only what is looked at.
3. Search.  A query looks at the blocks of the lists with the most promising
   centres first: one, then four times as many, and so on.  The k-th score so far
   is its floor.  It skips lists that can't reach the floor (<query, centre> +
   |query| * radius), and a block returns only what reaches it, so what a query
   gets back grows with the number of passes and not with that of the blocks.
   Lists and floors lose nothing; only epsilon can.  ``exact`` reranks every vector
   of the lists instead, to measure recall.

Bounds and codes are computed on vectors divided by a power of two near the
largest component of all, and on queries divided by one of their own, so any
finite double is fine.

Cases: null vectors, empty and zero vectors and those that hold null or
non-finite components take no part, neither do rows with a null id.  Vectors
of different lengths don't meet.  Equal scores go by the smaller vec_id; a score
that overflows to no number comes last.  A row with the query's own id isn't a
candidate; other repeated rows are candidates each.  Repeated rows of a query
are one query, and of several vectors under a query's id the first in array
order is taken.  A query without candidates, and an empty table, give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm._common import forget, settle

BLOCK_SQL = "dim int, list int, block int, ids binary, raw binary, codes binary, scalars binary"
BLOCK = pa.schema([*((c, pa.int32()) for c in ("dim", "list", "block")), *((c, pa.binary()) for c in ("ids", "raw", "codes", "scalars"))])
QUERIES_SQL = "dim int, list int, block int, part int, ids binary, raw binary, floors binary"
QUERIES = pa.schema([*((c, pa.int32()) for c in ("dim", "list", "block", "part")), *((c, pa.binary()) for c in ("ids", "raw", "floors"))])
FOUND_SQL = "query_id long, vec_id long, score double"
FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
PLANES = 8
#: Queries whose estimates are held at once.
BATCH = 16
#: For what rounding of scaled values may add to a bound.
SLACK = 1e-9


def rotation(dim: int, seed: int = 6) -> np.ndarray:
    """A random orthogonal matrix, the same everywhere."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def _packed(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as 64-bit words."""
    pad = -bits.shape[1] % 64
    return np.packbits(np.pad(bits, ((0, 0), (0, pad))), axis=1).view(np.uint64)


def encode(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes, and the scalars that go with them: centre, then for each vector the residual's length and <code, residual>."""
    centre = x.mean(axis=0)
    residual = x - centre
    length = np.linalg.norm(residual, axis=1)
    turned = residual @ rotation(x.shape[1]) / np.where(length > 0, length, 1)[:, None]
    along = np.abs(turned).sum(axis=1) / np.sqrt(x.shape[1])
    return _packed(turned >= 0), np.concatenate([centre, length, along])


def estimates(codes: np.ndarray, scalars: np.ndarray, q: np.ndarray, epsilon: float) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner products (queries by vectors) and bounds of their errors."""
    dim, n = q.shape[1], len(codes)
    centre, length, along = scalars[:dim], scalars[dim : dim + n], scalars[dim + n :]
    turned = q @ rotation(dim)
    low = turned.min(axis=1, keepdims=True)
    step = np.maximum((turned.max(axis=1, keepdims=True) - low) / (2**PLANES - 1), 1e-300)
    levels = np.rint((turned - low) / step).astype(np.uint16)
    ones = np.bitwise_count(codes).sum(axis=1, dtype=np.int64)
    kind = np.uint16 if dim << PLANES < 1 << 16 else np.uint32
    common = np.zeros((len(q), n), kind)
    for plane in range(PLANES):
        bits = _packed((levels >> plane & 1).astype(bool))
        for w in range(codes.shape[1]):
            common += np.bitwise_count(bits[:, w : w + 1] & codes[None, :, w]).astype(kind) << kind(plane)
    # sum of sign * turned = 2 * sum over set bits - sum over all
    scale = length / np.where(along > 0, along, 1) / np.sqrt(dim)
    all_of = low * dim + step * levels.sum(axis=1, keepdims=True)
    estimate = common * (2 * step)
    estimate += 2 * low * ones[None, :] - all_of
    estimate *= scale[None, :]
    estimate += (q @ centre)[:, None]
    norm = np.linalg.norm(q, axis=1, keepdims=True)
    left = scale * np.sqrt(dim) * np.sqrt(np.maximum(0, 1 - along**2)) * (epsilon / np.sqrt(max(1, dim - 1)))
    return estimate, norm * left[None, :] + step * (dim / 2 * scale)[None, :] + SLACK * norm


def nearest(ids: np.ndarray, x: np.ndarray, near, query_ids: np.ndarray, q: np.ndarray, floors: np.ndarray, k: int) -> list[tuple]:
    """The k best of the vectors that ``near`` (queries by vectors) admits for each query, scored on the original vectors, but none under the floor."""
    out = []
    with np.errstate(over="ignore", invalid="ignore"):
        for i, own in enumerate(query_ids):
            at = np.flatnonzero(near[i] & (ids != own))
            some, score = x[at], np.zeros(len(at))
            for d in range(q.shape[1]):  # summed in the order of the components
                score += some[:, d] * q[i, d]
            high = ~(score < floors[i])
            at, score = at[high], score[high]
            best = np.lexsort((ids[at], -np.where(np.isnan(score), -np.inf, score)))[:k]
            out += zip([own] * len(best), ids[at[best]], score[best])
    return out


def admitted(codes: np.ndarray, scalars: np.ndarray, ids: np.ndarray, query_ids: np.ndarray, q: np.ndarray, floors: np.ndarray, k: int, epsilon: float) -> np.ndarray:
    """Which vectors may be among a query's k nearest of the block, and reach its floor where it has one (else -inf)."""
    estimate, error = estimates(codes, scalars, q, epsilon)
    if len(ids) <= k:
        return np.ones(estimate.shape, bool)
    upper = estimate + error
    few = np.isinf(floors)  # without a floor the block gives one
    if few.any():
        lower = np.where(ids[None, :] == query_ids[few, None], -np.inf, (estimate - error)[few])
        floors = floors.copy()
        floors[few] = np.partition(lower, -k, axis=1)[:, -k]
    return upper >= floors[:, None]


def unit(q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Queries by powers of two near their largest components, and these."""
    size = np.exp2(np.frexp(np.abs(q).max(axis=1))[1] - 1.0)
    return q / size[:, None], size


class Lists:
    """Centres of each dimension, fitted on a bounded sample."""

    def __init__(self, sample: dict[int, np.ndarray], lists: int, rounds: int = 8):
        total = sum(len(x) for x in sample.values())
        self.centres = {dim: self._fit(x, max(1, min(len(x), lists * len(x) // total)), rounds) for dim, x in sample.items()}

    @staticmethod
    def _fit(x: np.ndarray, n: int, rounds: int) -> np.ndarray:
        centres = x[np.linspace(0, len(x) - 1, n).astype(int)].copy()
        for _ in range(rounds if n > 1 else 0):
            of = ((centres**2).sum(axis=1) - 2 * (x @ centres.T)).argmin(axis=1)
            held = np.bincount(of, minlength=n)
            sums = np.zeros_like(centres)
            np.add.at(sums, of, x)
            centres[held > 0] = sums[held > 0] / held[held > 0][:, None]
        return centres if n > 1 else x.mean(axis=0, keepdims=True)

    def of(self, dim: int) -> np.ndarray:
        """A dimension that isn't in the sample has one list, about zero."""
        return self.centres.get(dim, np.zeros((1, dim)))


def _matrix(column, dims: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dimension, rows, vectors) of a list column."""
    flat, ends = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.cumsum(dims)
    for dim in np.unique(dims).tolist():
        at = np.flatnonzero(dims == dim)
        yield dim, at, flat[(ends[at] - dim)[:, None] + np.arange(dim)]


def _usable(df: DataFrame) -> DataFrame:
    e = F.col("embedding")
    fine = e.isNotNull() & F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(e, lambda v: v != 0)
    return df.select(F.col("vec_id").cast("long").alias("vec_id"), e.cast("array<double>").alias("embedding")).where(F.col("vec_id").isNotNull() & fine).withColumn("dim", F.size("embedding"))


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, block_rows: int = 4096, query_rows: int = 4096, epsilon: float = 1.9, max_lists: int = 1024, sample_rows: int = 16_384, exact: bool = False) -> DataFrame:
    """The k vectors of largest inner product for each query: query_id, rank, vec_id, score.

    Both frames have vec_id and embedding; a query is compared with every
    vector but those of its own id.
    """
    vectors = _usable(vectors)
    queries = _usable(queries).groupBy("vec_id").agg(F.min(F.struct("dim", "embedding")).alias("q")).select("vec_id", "q.embedding", "q.dim")
    n, most = vectors.agg(F.count(F.lit(1)), F.max(F.array_max(F.transform("embedding", F.abs)))).first()
    scale = 2.0 ** int(np.frexp(most)[1] - 1) if n else 1.0
    chosen = vectors.orderBy(F.xxhash64("vec_id"), "vec_id", "embedding").limit(sample_rows).select("embedding", "dim").toArrow().combine_chunks()
    sample = {dim: x / scale for dim, _, x in _matrix(chosen["embedding"].combine_chunks(), chosen["dim"].to_numpy())} if chosen.num_rows else {}
    lists = Lists(sample, min(max_lists, max(1, n // block_rows)))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(2).to_numpy()
            of, far = np.zeros(len(dims), np.int32), np.zeros(len(dims))
            for dim, at, x in _matrix(batch.column(1), dims):
                centres, x = lists.of(dim), x / scale
                of[at] = ((centres**2).sum(axis=1) - 2 * (x @ centres.T)).argmin(axis=1)
                far[at] = np.linalg.norm(x - centres[of[at]], axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(of), pa.array(far)], ["vec_id", "embedding", "dim", "list", "far"])

    placed = settle(vectors.mapInArrow(assign, "vec_id long, embedding array<double>, dim int, list int, far double"))
    # One row a list: max_lists of them, and one more for a dimension outside the sample.
    held = {(r["dim"], r["list"]): (-(-r.n // block_rows), r.far) for r in placed.groupBy("dim", "list").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("far")).collect()}
    bounds = {dim: tuple(np.array(x) for x in zip(*((i, *held[d, i]) for d, i in sorted(held) if d == dim))) for dim in {d for d, _ in held}}
    n_parts = max(1, -(-queries.count() // query_rows))
    sizes = F.create_map(*(F.lit(x) for (d, i), (blocks, _) in held.items() for x in (f"{d}:{i}", int(blocks)))) if held else F.create_map().cast("map<string,int>")
    n_blocks = F.try_element_at(sizes, F.concat_ws(":", "dim", "list"))

    def scaled(floors: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Scores in the measure of bounds, or -inf where they overflow."""
        with np.errstate(over="ignore"):
            floors = floors / scale / size
        return np.where(np.isfinite(floors), floors - SLACK, -np.inf)

    def encoded(t: pa.Table) -> pa.Table:
        ids, dim = t["vec_id"].to_numpy(), t["dim"][0].as_py()
        order = np.argsort(ids, kind="stable")
        x = t["embedding"].combine_chunks().flatten().to_numpy().reshape(len(ids), dim)[order]
        codes, scalars = encode(x / scale)
        return pa.Table.from_pylist([{"dim": dim, "list": t["list"][0].as_py(), "block": t["block"][0].as_py(), "ids": ids[order].astype("<i8").tobytes(), "raw": x.tobytes(), "codes": codes.tobytes(), "scalars": scalars.tobytes()}], schema=BLOCK)

    numbered = placed.withColumn("block", F.pmod(F.xxhash64("vec_id"), n_blocks).cast("int"))
    blocks = settle(numbered.groupBy("dim", "list", "block").applyInArrow(encoded, BLOCK_SQL))

    def aimed(start: int, stop: int):
        """For each query the blocks from start to stop, in the order of its lists, whose bound reaches its floor: (list, low, high) each."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                dims = batch.column(2).to_numpy()
                rows, to = [], []
                for dim, at, q in _matrix(batch.column(1), dims):
                    if dim not in bounds:
                        continue
                    own, blocks, radius = bounds[dim]
                    q, size = unit(q)
                    near = q @ lists.of(dim)[own].T
                    order = np.argsort(-near, axis=1, kind="stable")
                    bound = near + np.linalg.norm(q, axis=1, keepdims=True) * (radius + SLACK)
                    ends = np.cumsum(blocks[order], axis=1)
                    begins = ends - blocks[order]
                    low, high = np.maximum(begins, start) - begins, np.minimum(ends, stop) - begins
                    reach = np.take_along_axis(bound, order, axis=1) >= scaled(batch.column(3).to_numpy()[at], size)[:, None]
                    i, j = np.nonzero((low < high) & reach)
                    rows.append(at[i]), to.append(np.stack([own[order[i, j]], low[i, j], high[i, j] - 1]))
                if rows:
                    taken, to = pa.array(np.concatenate(rows)), np.concatenate(to, axis=1).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([*(batch.column(c).take(taken) for c in range(4)), *map(pa.array, to)], ["vec_id", "embedding", "dim", "floor", "list", "low", "high"])

        return run, "vec_id long, embedding array<double>, dim int, floor double, list int, low int, high int"

    def packed(t: pa.Table) -> pa.Table:
        key = {c: t[c][0].as_py() for c in ("dim", "list", "block", "part")}
        return pa.Table.from_pylist([key | {"ids": t["vec_id"].to_numpy().astype("<i8").tobytes(), "raw": t["embedding"].combine_chunks().flatten().to_numpy().tobytes(), "floors": t["floor"].to_numpy().tobytes()}], schema=QUERIES)

    def looked_up(aimed: DataFrame) -> DataFrame:
        """The k best of each block for the queries (with list and block) that are sent to it."""
        parts = aimed.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(n_parts)).cast("int")).groupBy("dim", "list", "block", "part").applyInArrow(packed, QUERIES_SQL)
        work = parts.withColumnsRenamed({"ids": "query_ids", "raw": "query_raw"}).join(blocks.hint("shuffle_merge"), ["dim", "list", "block"])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r in range(batch.num_rows):
                    a = {c: batch.column(c)[r].as_py() for c in batch.schema.names}
                    ids, query_ids = np.frombuffer(a["ids"], "<i8"), np.frombuffer(a["query_ids"], "<i8")
                    x, q, floors = *(np.frombuffer(a[c]).reshape(-1, a["dim"]) for c in ("raw", "query_raw")), np.frombuffer(a["floors"])
                    codes, scalars = np.frombuffer(a["codes"], np.uint64).reshape(len(ids), -1), np.frombuffer(a["scalars"])
                    rows: list[tuple] = []
                    for i in range(0, len(q), BATCH):
                        own, some = query_ids[i : i + BATCH], q[i : i + BATCH]
                        (bare, size), floor = unit(some), floors[i : i + BATCH]
                        near = np.ones((len(own), len(ids)), bool) if exact else admitted(codes, scalars, ids, own, bare, scaled(floor, size), k, epsilon)
                        rows += nearest(ids, x, near, own, some, floor, k)
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(np.array(c, t.type.to_pandas_dtype())) for c, t in zip(zip(*rows), FOUND)], schema=FOUND)

        return work.mapInArrow(run, FOUND_SQL)

    by_score = F.when(F.isnan("score"), F.lit(float("-inf"))).otherwise(F.col("score"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(by_score.desc(), "vec_id"))
    least = F.min(F.when(~F.isnan("score"), F.col("score")))
    best = queries.sparkSession.createDataFrame([], FOUND_SQL)
    start, stop, last = 0, 1, max((int(b[1].sum()) for b in bounds.values()), default=1)
    while start < last:
        floors = best.groupBy("query_id").agg(F.when(F.count(F.when(~F.isnan("score"), 1)) >= k, least).alias("found")).withColumnRenamed("query_id", "vec_id")
        asked = queries.join(floors, "vec_id", "left").select("vec_id", "embedding", "dim", F.coalesce("found", F.lit(float("-inf"))).alias("floor"))
        targets = asked.mapInArrow(*aimed(start, stop)).withColumn("block", F.explode(F.sequence("low", "high"))).drop("low", "high")
        found = best.union(looked_up(targets)).withColumn("rank", place).where(F.col("rank") <= k)
        had, best = best, settle(found.select("query_id", "vec_id", "score"))
        if start:
            forget(had)
        start, stop = stop, 5 * stop
    forget(placed, blocks)
    return best.select("query_id", place.alias("rank"), "vec_id", "score")
