"""Rank statistics, set distances, rarefaction and permutation tests."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _cumulative(df: DataFrame, value: str) -> DataFrame:
    """(value, n, below): how many rows have each value, and how many a smaller one.

    Distinct values are counted first and sorted by ranges; only the counts of
    the ranges meet in one place.
    """
    n = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("n"))
    placed = n.repartitionByRange(value).withColumn("_part", F.spark_partition_id())
    inside = placed.withColumn("_in", F.sum("n").over(Window.partitionBy("_part").orderBy(value)) - F.col("n"))
    before = placed.groupBy("_part").agg(F.sum("n").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return inside.join(F.broadcast(before.select("_part", "_before")), "_part").select(value, "n", (F.col("_in") + F.col("_before")).alias("below"))  # one row a partition


def max_rank_correlation(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row, rho: Spearman's correlation where ties take their largest rank."""
    rank = lambda c, name: _cumulative(df, c).select(c, (F.col("below") + F.col("n") - 1).cast("double").alias(name))
    rows = df.select(x, y).na.drop().join(rank(x, "_rx"), x).join(rank(y, "_ry"), y)
    return rows.agg(F.corr("_rx", "_ry").alias("rho"), F.count(F.lit(1)).alias("n"))


def mann_whitney(df: DataFrame, group: str, value: str, a: object, b: object) -> DataFrame:
    """One row: n_a, n_b, U of ``a`` and the two-sided p of the normal approximation with ties."""
    rows = df.where(F.col(group).isin(a, b) & F.col(value).isNotNull())
    ranks = _cumulative(rows, value).withColumn("_rank", F.col("below") + (F.col("n") + 1) / 2)
    ties = ranks.agg(F.sum(F.pow("n", F.lit(3)) - F.col("n")).alias("_ties"))
    sums = rows.join(ranks, value).agg(F.count_if(F.col(group) == a).alias("n_a"), F.count_if(F.col(group) == b).alias("n_b"), F.sum(F.when(F.col(group) == a, F.col("_rank"))).alias("_r"))
    out = sums.crossJoin(ties).withColumn("u", F.col("_r") - F.col("n_a") * (F.col("n_a") + 1) / 2)  # one row each
    n, product = F.col("n_a") + F.col("n_b"), F.col("n_a").cast("double") * F.col("n_b")
    sigma = F.sqrt(product / 12 * ((n + 1) - F.col("_ties") / (n * (n - 1))))
    out = out.withColumn("_z", (F.abs(F.col("u") - product / 2) - 0.5) / sigma)
    return out.select("n_a", "n_b", "u", two_sided("_z").alias("p"))


@F.pandas_udf(T.DoubleType())
def two_sided(z: pd.Series) -> pd.Series:
    """Two-sided tail of the normal distribution, which Spark has no function for."""
    return z.map(lambda v: None if v is None or math.isnan(v) else min(1.0, math.erfc(max(0.0, v) / math.sqrt(2))))


def sorensen(presence: DataFrame, entity: str, item: str) -> DataFrame:
    """(i, j, shared, distance) for entities i < j that share an item; pairs that share none have distance 1.

    The work is the pairs that share items, not all pairs.
    """
    own = presence.select(F.col(entity).alias("_entity"), F.col(item).alias("_item")).distinct()
    size = own.groupBy("_entity").agg(F.count(F.lit(1)).alias("n"))
    left, right = (own.select(F.col("_entity").alias(name), "_item") for name in "ij")
    shared = left.join(right, "_item").where("i < j").groupBy("i", "j").agg(F.count(F.lit(1)).alias("shared"))
    out = shared.join(size.toDF("i", "n_i"), "i").join(size.toDF("j", "n_j"), "j")
    return out.select("i", "j", "shared", (1 - 2 * F.col("shared") / (F.col("n_i") + F.col("n_j"))).alias("distance"))


def within_between(distances: DataFrame, groups: DataFrame, entity: str, group: str) -> DataFrame:
    """One row: mean distance within groups and between them, and the gap, over all pairs of the entities of ``groups``.

    Pairs without a row in ``distances`` have distance 1 and are only counted; a mean of no pairs is null.
    """
    g = groups.select(entity, group).na.drop()
    rows = distances.join(g.toDF("i", "g_i"), "i").join(g.toDF("j", "g_j"), "j")
    same, nearer = F.col("g_i") == F.col("g_j"), F.col("distance") - 1
    sums = rows.agg(F.coalesce(F.sum(F.when(same, nearer)), F.lit(0.0)).alias("_w"), F.coalesce(F.sum(F.when(~same, nearer)), F.lit(0.0)).alias("_b"))
    m = g.groupBy(group).agg(F.count(F.lit(1)).alias("m"))
    pairs = m.agg(F.sum(F.expr("m * (m - 1) div 2")).alias("_inside"), F.expr("sum(m) * (sum(m) - 1) div 2").alias("_all")).withColumn("_across", F.col("_all") - F.col("_inside"))
    out = sums.crossJoin(pairs)  # one row each
    mean = lambda nearer, n: F.when(F.col(n) > 0, 1 + F.try_divide(nearer, n))
    return out.select(mean("_w", "_inside").alias("within"), mean("_b", "_across").alias("between")).withColumn("gap", F.col("between") - F.col("within"))


def rarefied(counts: DataFrame, sample: str, kind: str, n: str, depth: int) -> DataFrame:
    """(sample, total, expected): expected kinds among ``depth`` draws without replacement, exactly.

    The sum of 1 - C(total - n, depth) / C(total, depth); null where a sample has fewer draws.
    """
    total = counts.groupBy(sample).agg(F.sum(n).alias("total"))
    rows = counts.join(total, sample)

    @F.pandas_udf(T.DoubleType())
    def seen(own: pd.Series, all_: pd.Series) -> pd.Series:
        lg = np.vectorize(math.lgamma, otypes=[float])
        own, all_ = own.to_numpy(float), all_.to_numpy(float)
        rest = all_ - own
        fits = (rest >= depth) & (all_ >= depth)
        r, t = np.where(fits, rest, depth), np.where(fits, all_, depth)
        missed = np.exp(lg(r + 1) - lg(r - depth + 1) - lg(t + 1) + lg(t - depth + 1))
        return pd.Series(np.where(all_ >= depth, 1 - np.where(fits, missed, 0.0), np.nan))

    out = rows.withColumn("_s", seen(n, "total")).groupBy(sample, "total").agg(F.sum("_s").alias("expected"))
    return out.withColumn("expected", F.when(F.col("total") >= depth, F.col("expected")))


def _shape(groups: DataFrame, group: str) -> DataFrame:
    """One row: n entities, g groups, and the pairs within groups and in all."""
    m = groups.groupBy(group).agg(F.count(F.lit(1)).alias("m"))
    return m.agg(F.sum("m").alias("n"), F.count(F.lit(1)).alias("g"), F.sum(F.expr("m * (m - 1) div 2")).alias("inside"), F.expr("sum(m) * (sum(m) - 1) div 2").alias("pairs"))


def null_floor(groups: DataFrame, entity: str, group: str) -> DataFrame:
    """One row: the R2 that a grouping without meaning is expected to reach, (g - 1) / (n - 1)."""
    return _shape(groups.select(entity, group).na.drop(), group).select(F.try_divide(F.col("g") - 1, F.col("n") - 1).alias("floor"))


def anosim(distances: DataFrame, groups: DataFrame, entity: str, group: str) -> DataFrame:
    """One row, r: the difference of mean ranks of distances between and within groups, over a quarter of n (n - 1).

    Ties take their mean rank; pairs without a row have distance 1 and are one tie at the end.
    """
    own = groups.select(entity, group).na.drop()
    rows = distances.join(own.toDF("i", "g_i"), "i").join(own.toDF("j", "g_j"), "j").select("distance", (F.col("g_i") == F.col("g_j")).alias("_same"))
    ranks = _cumulative(rows, "distance").select("distance", (F.col("below") + (F.col("n") + 1) / 2).alias("_rank"))
    sums = rows.join(ranks, "distance").agg(
        F.coalesce(F.sum(F.when(F.col("_same"), F.col("_rank"))), F.lit(0.0)).alias("_w"), F.coalesce(F.sum(F.when(~F.col("_same"), F.col("_rank"))), F.lit(0.0)).alias("_b"),
        F.count_if("_same").alias("_nw"), F.count(F.lit(1)).alias("_n"),
    )
    one = sums.crossJoin(_shape(own, group))  # one row each
    last = F.col("_n") + (F.col("pairs") - F.col("_n") + 1) / 2
    within = F.try_divide(F.col("_w") + (F.col("inside") - F.col("_nw")) * last, "inside")
    across = F.col("pairs") - F.col("inside")
    between = F.try_divide(F.col("_b") + (across - (F.col("_n") - F.col("_nw"))) * last, across)
    return one.select(((between - within) / (F.col("pairs") / 2)).alias("r"))


def dispersion(distances: DataFrame, groups: DataFrame, entity: str, group: str) -> DataFrame:
    """(group, n, spread): the mean distance of a group's entities from its centroid, from distances alone.

    The squared distance of i is the mean of its squared distances in the group less half the mean over all of its
    pairs; pairs without a row have distance 1.
    """
    own = groups.select(entity, group).na.drop()
    m = own.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    both = distances.select("i", "j", "distance").union(distances.select("j", "i", "distance"))
    near = both.join(own.toDF("i", "_g"), "i").join(own.toDF("j", "_h"), "j").where("_g = _h")
    sums = near.groupBy(F.col("i").alias(entity)).agg(F.sum(F.col("distance") ** 2 - 1).alias("_less"))
    rows = own.join(sums, entity, "left").join(m, group).withColumn("_row", (F.col("n") - 1 + F.coalesce("_less", F.lit(0.0))) / F.col("n"))
    half = rows.groupBy(group).agg((F.avg("_row") / 2).alias("_half"))
    spread = F.sqrt(F.greatest(F.lit(0.0), F.col("_row") - F.col("_half")))
    return rows.join(half, group).groupBy(group, "n").agg(F.avg(spread).alias("spread"))


def permanova(distances: DataFrame, groups: DataFrame, entity: str, group: str, permutations: int = 199, seed: int = 42, block: str | None = None) -> DataFrame:
    """One row: F, R2 and the permutation p of a grouping, from squared distances of all pairs of the entities of ``groups``.

    Pairs without a row in ``distances`` have distance 1.  They are summed in closed form: with all distances 1 the sums
    of squares are (n - 1) / 2 in total and (n - g) / 2 within, and the rows' differences from 1 are added.
    Each permutation is a deal of the group labels by hash, within the blocks of ``block`` where it is given; all of
    them are summed in one join of pairs and labels.
    """
    groups = groups.select(entity, group, (F.col(block) if block else F.lit(0)).alias("_block")).na.drop()
    sizes = groups.groupBy(group).agg(F.count(F.lit(1)).alias("_m"))
    # Deal 0 is the order of the labels themselves: the others take labels from its places.
    dealt = F.when(F.col("rep") > 0, F.xxhash64(F.lit(seed), "rep", entity)).otherwise(F.lit(0).cast("long"))
    slots = groups.select(entity, group, "_block", F.explode(F.sequence(F.lit(0), F.lit(permutations))).alias("rep"))
    slots = slots.withColumn("_slot", F.row_number().over(Window.partitionBy("rep", "_block").orderBy(dealt, group, entity)))
    base = slots.where("rep = 0").select("_block", "_slot", group)
    labels = slots.select("rep", entity, "_block", "_slot").join(base, ["_block", "_slot"]).select("rep", entity, group)
    pairs = distances.select("i", "j", (F.col("distance") ** 2 - 1).alias("_d2"))
    rows = pairs.join(labels.toDF("rep", "i", "g_i"), "i").join(labels.toDF("rep", "j", "g_j"), ["rep", "j"])
    inside = rows.where("g_i = g_j").join(sizes.toDF("g_i", "_m"), "g_i").groupBy("rep").agg(F.sum(F.col("_d2") / F.col("_m")).alias("_w"))
    shape = groups.agg(F.count(F.lit(1)).alias("n"), F.countDistinct(group).alias("g"))
    known = pairs.join(groups.select(F.col(entity).alias("i")), "i").join(groups.select(F.col(entity).alias("j")), "j")
    total = known.agg(F.coalesce(F.sum("_d2"), F.lit(0.0)).alias("_t")).crossJoin(shape).select(((F.col("n") - 1) / 2 + F.try_divide("_t", "n")).alias("total"), "n", "g")  # one row each
    f = ((F.col("total") - F.col("within")) / (F.col("g") - 1)) / (F.col("within") / (F.col("n") - F.col("g")))
    all_reps = groups.sparkSession.range(permutations + 1).select(F.col("id").cast("int").alias("rep")).join(inside, "rep", "left")
    sums = all_reps.crossJoin(F.broadcast(total)).withColumn("within", (F.col("n") - F.col("g")) / 2 + F.coalesce("_w", F.lit(0.0)))
    stat = sums.withColumn("f", f).withColumn("r2", 1 - F.col("within") / F.col("total"))
    seen = stat.where("rep = 0").select(F.col("f").alias("pseudo_f"), "r2")
    above = stat.crossJoin(F.broadcast(seen.select("pseudo_f"))).agg(F.count_if((F.col("rep") > 0) & (F.col("f") >= F.col("pseudo_f"))).alias("_above"))
    return seen.crossJoin(above).select("pseudo_f", "r2", ((F.col("_above") + 1) / (permutations + 1)).alias("p"))


def _monotone(values: np.ndarray) -> np.ndarray:
    """The nearest non-decreasing values, by pooling neighbours that are out of order."""
    means: list[float] = []
    sizes: list[int] = []
    for v in values:
        mean, size = float(v), 1
        while means and means[-1] > mean:
            mean = (means[-1] * sizes[-1] + mean * size) / (sizes[-1] + size)
            size += sizes.pop()
            means.pop()
        means.append(mean)
        sizes.append(size)
    return np.repeat(means, sizes)


def ordination(distances: DataFrame, entities: DataFrame, entity: str, k: int = 2, rounds: int = 200, most: int = 2000) -> tuple[DataFrame, float]:
    """(entity, axis_1 ... axis_k) of a non-metric scaling, and its stress; pairs without a row have distance 1.

    Positions start at the principal coordinates and follow the ranks of the distances.  The matrix is held on the
    driver, so more than ``most`` entities are refused.
    """
    names = [r[0] for r in entities.select(entity).where(F.col(entity).isNotNull()).distinct().orderBy(entity).limit(most + 1).collect()]
    if len(names) > most:
        raise ValueError(f"more than {most} entities")
    n, place = len(names), {e: i for i, e in enumerate(names)}
    d = np.ones((n, n)) - np.eye(n)
    for r in distances.select("i", "j", "distance").collect():  # pairs of at most ``most`` entities
        if r.i in place and r.j in place:
            d[place[r.i], place[r.j]] = d[place[r.j], place[r.i]] = r.distance
    centre = np.eye(n) - 1 / max(1, n)
    values, vectors = np.linalg.eigh(-centre @ (d**2) @ centre / 2)
    x = (vectors[:, ::-1] * np.sqrt(np.maximum(values[::-1], 0)))[:, :k] if n else np.empty((0, k))
    x = np.pad(x, ((0, 0), (0, k - x.shape[1])))
    a, b = np.triu_indices(n, 1)
    stress, order = 0.0, np.lexsort((b, a, d[a, b]))
    for _ in range(rounds if n > 2 else 0):
        own = np.linalg.norm(x[a] - x[b], axis=1)
        fitted = np.empty_like(own)
        by = order[np.lexsort((own[order], d[a, b][order]))]  # ties in the order of their own distances
        fitted[by] = _monotone(own[by])
        before, stress = stress, float(np.sqrt(((own - fitted) ** 2).sum() / max((own**2).sum(), 1e-300)))
        if abs(before - stress) < 1e-7:
            break
        pull = np.zeros((n, n))
        pull[a, b] = pull[b, a] = -fitted / np.maximum(own, 1e-12)
        np.fill_diagonal(pull, -pull.sum(axis=1))
        x = pull @ x / n
    rows = [(e, *map(float, p)) for e, p in zip(names, x)]
    kind = entities.schema[entity].dataType.simpleString()
    return distances.sparkSession.createDataFrame(rows, ", ".join([f"{entity} {kind}", *(f"axis_{i + 1} double" for i in range(k))])), stress
