"""The fact layer: filters along a chain, collapsing witnesses, re-listings, registries, upserts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import code_sort_key


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The frame itself; an error names the columns it lacks."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; there are {df.columns}")
    return df


def numeric_facts(df: DataFrame, keys: Sequence[str], amount: str) -> DataFrame:
    """Keys as long and the amount as double; rows with any of them null are dropped."""
    columns = [F.col(k).try_cast("long").alias(k) for k in keys] + [F.col(amount).try_cast("double").alias(amount)]
    return df.select(*columns).na.drop("any")


def chain_filter(facts: DataFrame, targets: DataFrame, key: str, aliases: DataFrame | None = None) -> DataFrame:
    """Facts whose key is a target, or the generic of a specific target in ``aliases`` (specific, generic)."""
    keep = targets.select(F.col(key).alias("_k"))
    if aliases is not None:
        generic = aliases.join(keep, F.col("specific") == F.col("_k"), "left_semi").select(F.col("generic").alias("_k"))
        keep = keep.union(generic)
    return facts.join(keep.distinct(), F.col(key) == F.col("_k"), "left_semi")


def without_facts(entities: DataFrame, facts: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Entities with a fact, and the orphans without."""
    ids = facts.select(key).distinct()
    return entities.join(ids, key, "left_semi"), entities.join(ids, key, "left_anti")


def collapse_witnesses(facts: DataFrame, keys: Sequence[str], source: str) -> DataFrame:
    """One row for equal facts (null is a value), its sources sorted, each once, joined by ";"."""
    return facts.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_set(source)), ";").alias(source))


def ordered_distinct_concat(df: DataFrame, keys: Sequence[str], order: Sequence[Column], value: Column, separator: str, name: str) -> DataFrame:
    """Distinct values of a group joined in the order of their first place."""
    place = F.struct(*(o.alias(f"o{i}") for i, o in enumerate(order)))
    first = df.groupBy(*keys, value.alias("_v")).agg(F.min(place).alias("_p"))  # each value once, before any list is made
    values = F.transform(F.sort_array(F.collect_list(F.struct("_p", "_v"))), lambda x: x["_v"])
    return first.groupBy(*keys).agg(F.array_join(values, separator).alias(name))


def drop_relistings(entities: DataFrame, facts: DataFrame, key: str, same: Sequence[str], item: str, amount: str, exempt: Column | None = None) -> DataFrame:
    """Entities without those that repeat an earlier one: equal in ``same`` and in the whole vector of facts.

    Only entities whose ``same`` columns recur have their vectors compared; of
    each set of equals the lowest key stays, and exempt rows always.
    """
    open_ = entities if exempt is None else entities.where(~F.coalesce(exempt, F.lit(False)))
    recurring = open_.groupBy(*same).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    candidates = open_.join(recurring, list(same), "left_semi").select(key, *same)
    vectors = facts.join(candidates.select(key), key, "left_semi").groupBy(key).agg(F.sort_array(F.collect_list(F.struct(item, amount))).alias("_vector"))
    place = F.row_number().over(Window.partitionBy(*same, "_vector").orderBy(key))
    again = candidates.join(vectors, key).withColumn("_place", place).where("_place > 1").select(key)
    return entities.join(again, key, "left_anti")


def numeric_code_order(df: DataFrame, code: str, *rest: str, levels: int = 4) -> DataFrame:
    """Sorted by a dotted code's levels as numbers, open levels last, then by ``rest``."""
    return df.withColumn("_levels", code_sort_key(code)).orderBy(*(F.get("_levels", F.lit(i)).asc_nulls_last() for i in range(levels)), *rest).drop("_levels")


def mint(codes: DataFrame, registry: DataFrame, code: str, number: str, base: int, limit: int | None = None) -> DataFrame:
    """(code, number) of codes not yet in the registry: numbered in code order above the highest number so far.

    Numbers are given once and never change.  A number over ``limit`` is an error at run time.
    The order is made by ranges of the code: a partition counts its rows, and only those counts meet.
    """
    top = registry.agg(F.coalesce(F.max(number), F.lit(base - 1)).alias("_top"))
    new = codes.select(code).where(F.col(code).isNotNull()).distinct().join(registry.select(code), code, "left_anti")
    placed = new.repartitionByRange(code).sortWithinPartitions(code).withColumn("_part", F.spark_partition_id())
    inside = placed.withColumn("_in", F.row_number().over(Window.partitionBy("_part").orderBy(code)))
    counts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    out = inside.join(F.broadcast(before.select("_part", "_before")), "_part").crossJoin(F.broadcast(top))  # one row a partition, and one row
    value = F.col("_top") + F.col("_before") + F.col("_in")
    if limit is not None:
        value = F.when(value <= limit, value).otherwise(F.raise_error(F.lit(f"no number left under {limit}")).cast("long"))
    return out.select(code, value.cast("long").alias(number))


def order_breaks(df: DataFrame, old: str, new: str) -> DataFrame:
    """One row, n and breaks: how often ``new`` falls in the order of ``old``; null keys are left out.

    The order is made by ranges of ``old``: a range counts its own breaks, and only its first and last keys meet the next one's.
    """
    rows = df.select(F.col(old).alias("_old"), F.col(new).alias("_new")).na.drop()
    placed = rows.repartitionByRange("_old").withColumn("_part", F.spark_partition_id())
    inside = placed.withColumn("_before", F.lag("_new").over(Window.partitionBy("_part").orderBy("_old", "_new")))
    of_range = inside.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.count_if(F.col("_new") < F.col("_before")).alias("_b"), F.min_by("_new", F.struct("_old", "_new")).alias("_first"), F.max_by("_new", F.struct("_old", "_new")).alias("_last"))
    across = of_range.withColumn("_prev", F.lag("_last").over(Window.orderBy("_part")))  # one row a range
    return across.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.col("_b") + F.coalesce((F.col("_first") < F.col("_prev")).cast("int"), F.lit(0))), F.lit(0)).alias("breaks"))


def upsert(current: DataFrame, new: DataFrame, key: str, stale: Column | None = None, order: Column | None = None) -> DataFrame:
    """Current rows but the stale ones, with new rows added; of equal keys the new row stays.  Columns are united.

    Repeated keys inside ``new`` keep the row that ``order`` puts last (the greatest row where there is no order).
    """
    kept = current if stale is None else current.where(~F.coalesce(stale, F.lit(False)))
    if order is not None:
        columns = new.columns
        new = new.groupBy(key).agg(F.max_by(F.struct(*columns), order).alias("_r")).select("_r.*")
    else:
        new = new.groupBy(key).agg(F.max(F.struct(*new.columns)).alias("_r")).select("_r.*")
    return kept.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def append_missing(current: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Current rows, and new rows of keys that it lacks."""
    return current.unionByName(new.join(current.select(key), key, "left_anti"), allowMissingColumns=True)


def merge_or_override(seeds: DataFrame, extra: DataFrame, key: str, override: bool) -> DataFrame:
    """Seeds with extra ones added, or with all seeds of the extra ones' keys replaced."""
    base = seeds.join(extra.select(key), key, "left_anti") if override else seeds
    return base.unionByName(extra).distinct()


def augment_thin(own: DataFrame, reference: DataFrame, entity: str, item: str, threshold: int = 200) -> DataFrame:
    """Items of each entity; those with fewer than ``threshold`` get the reference's items as well."""
    thin = own.groupBy(entity).agg(F.countDistinct(item).alias("_n")).where(F.col("_n") < threshold).select(entity)
    return own.select(entity, item).union(reference.join(thin, entity, "left_semi").select(entity, item)).distinct()


def best_label(df: DataFrame, key: str, labels: str, tiers: DataFrame, label: str, rank: str) -> DataFrame:
    """The strictest tier among a row's labels joined by ";"; "unknown" without a rank where none of them is known."""
    each = df.select(key, F.explode_outer(F.split(labels, ";")).alias(label))
    known = each.join(tiers.select(label, rank), label, "left")
    best = F.max_by(label, F.when(F.col(rank).isNotNull(), F.struct(rank, label)))
    return known.groupBy(key).agg(F.coalesce(best, F.lit("unknown")).alias("strictest"), F.max(rank).alias(rank))


def unpivot_units(df: DataFrame, keys: Sequence[str], columns: Sequence[str], item: str, amount: str) -> DataFrame:
    """A wide sheet as long facts; null cells give none."""
    return df.unpivot([*keys], [*columns], item, amount).where(F.col(amount).isNotNull())
