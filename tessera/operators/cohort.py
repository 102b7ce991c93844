"""Summaries of samples, profiles and collections, and collapses to one row of a kind."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.rules import names_chemical, without_units
from tessera.functions.text import FULL_CODE


def sample_summary(rows: DataFrame, sample: str, entity: str, item: str) -> DataFrame:
    """For each sample: its entities, items, pairs, the median entities of an item, the median items of an entity, and the share of carriers."""
    own = rows.select(sample, entity, item).na.drop().distinct()
    totals = own.groupBy(sample).agg(F.countDistinct(entity).alias("richness"), F.countDistinct(item).alias("union"), F.count(F.lit(1)).alias("pairs"))
    carriers = own.groupBy(sample, item).agg(F.count(F.lit(1)).alias("_n")).groupBy(sample).agg(F.median("_n").alias("carriers"))
    repertoire = own.groupBy(sample, entity).agg(F.count(F.lit(1)).alias("_n")).groupBy(sample).agg(F.median("_n").alias("repertoire"))
    return totals.join(carriers, sample).join(repertoire, sample).withColumn("share", F.col("carriers") / F.col("richness"))


def cohort_items(rows: DataFrame, sample: str, item: str, score: str, category: str, k: int = 12) -> DataFrame:
    """The k items of the highest mean score over all samples, with how many samples have them, their range and relative spread."""
    n = rows.agg(F.countDistinct(sample).alias("n_cohort"))
    each = rows.groupBy(item).agg(F.avg(score).alias("mean_score"), F.countDistinct(sample).alias("n_samples"), F.min(score).alias("min_score"), F.max(score).alias("max_score"), F.min(F.coalesce(category, F.lit("Uncategorized"))).alias(category))
    top = each.orderBy(F.desc("mean_score"), item).limit(k)
    return top.crossJoin(F.broadcast(n)).withColumn("spread", F.try_divide(F.col("max_score") - F.col("min_score"), "mean_score"))  # one row


def pooled_profile(rows: DataFrame, sample: str, entity: str, item: str, score: str, order: Column | str) -> DataFrame:
    """(entity, item, mean_score, n_samples): one score for each sample, entity and item (the first in order), then their mean."""
    first = rows.groupBy(sample, entity, item).agg(F.min_by(score, order).alias("_s"))
    return first.groupBy(entity, item).agg(F.avg("_s").alias("mean_score"), F.count(F.lit(1)).alias("n_samples"))


def tier_counts(df: DataFrame, tier: Column, tiers: Sequence[str]) -> DataFrame:
    """(ord, tier, n) for all tiers in their order, those without rows too."""
    counts = df.groupBy(tier.alias("tier")).agg(F.count(F.lit(1)).alias("n"))
    order = df.sparkSession.createDataFrame([*enumerate(tiers)], "ord int, tier string")
    return order.join(counts, "tier", "left").select("ord", "tier", F.coalesce("n", F.lit(0)).alias("n"))


def first_items(rows: DataFrame, entity: str, item: str, rank: str, k: int = 5) -> DataFrame:
    """The first k distinct items of each entity in rank order, with place from 1."""
    best = rows.groupBy(entity, item).agg(F.min(rank).alias(rank))
    place = F.row_number().over(Window.partitionBy(entity).orderBy(rank, item))
    return best.withColumn("place", place).where(F.col("place") <= k)


def numbered(df: DataFrame, *order: str, name: str = "number") -> DataFrame:
    """Distinct rows of the order columns with their place from 1; made by ranges, of which only the counts meet."""
    rows = df.select(*order).distinct()
    placed = rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    inside = placed.withColumn("_in", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    counts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return inside.join(F.broadcast(before.select("_part", "_before")), "_part").select(*order, (F.col("_in") + F.col("_before")).cast("long").alias(name))  # one row a range


def relation_reach(rows: DataFrame, item: str, relation: str) -> DataFrame:
    """(relation, n, items, exclusive): rows of a relation, the items it reaches, and those that no other relation does."""
    only = rows.select(item, relation).distinct().groupBy(item).agg(F.count(F.lit(1)).alias("_n"), F.min(relation).alias(relation)).where("_n = 1")
    exclusive = only.groupBy(relation).agg(F.count(F.lit(1)).alias("exclusive"))
    out = rows.groupBy(relation).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(item).alias("items"))
    return out.join(exclusive, relation, "left").withColumn("exclusive", F.coalesce("exclusive", F.lit(0)))


def specialty(targets: DataFrame, facts: DataFrame, entity: str, nutrient: str, item: str, k: int, item_weight: float, wanted: Column) -> DataFrame:
    """The k most special nutrients of each entity, with rank, and the rank of its first wanted one (null where it has none).

    Special is ln(entities / carriers) + item_weight * ln(items / items with the nutrient); nutrients without items count as in all.
    """
    own = targets.select(entity, nutrient).distinct()
    carriers = own.groupBy(nutrient).agg(F.count(F.lit(1)).alias("_bf"))
    holders = facts.groupBy(nutrient).agg(F.countDistinct(item).alias("_ff"))
    totals = own.agg(F.countDistinct(entity).alias("_b")).crossJoin(facts.agg(F.countDistinct(item).alias("_f")))  # one row each
    rows = own.join(carriers, nutrient).join(holders, nutrient, "left").crossJoin(F.broadcast(totals))
    value = F.log(F.col("_b") / F.col("_bf")) + item_weight * F.log(F.col("_f") / F.coalesce("_ff", "_f"))
    w = Window.partitionBy(entity)
    out = rows.withColumn("special", value).withColumn("rank", F.row_number().over(w.orderBy(F.desc(F.round("special", 9)), nutrient)))
    out = out.withColumn("first_wanted", F.min(F.when(wanted, F.col("rank"))).over(w))
    return out.where(F.col("rank") <= k).select(entity, nutrient, "special", "rank", "first_wanted")


def panel_support(names: DataFrame, pattern: str, links: DataFrame, panel: DataFrame, facts: DataFrame, nutrient: str, name: str, code: str, entity: str, item: str, amount: str) -> DataFrame:
    """(entity, n_codes, n_items): codes that reach the nutrients of a pattern and that an entity has, and items with any of them."""
    wanted = names.where(F.col(name).rlike(pattern)).select(nutrient)
    codes = links.join(wanted, nutrient, "left_semi").select(code).distinct()
    items = facts.join(wanted, nutrient, "left_semi").where(F.col(amount) > 0).agg(F.countDistinct(item).alias("n_items"))
    have = panel.select(entity, code).distinct().join(codes.withColumn("_in", F.lit(1)), code, "left")
    return have.groupBy(entity).agg(F.count("_in").alias("n_codes")).crossJoin(F.broadcast(items))  # one row


def common_items(rows: DataFrame, entity: str, item: str, share: float) -> DataFrame:
    """Items that at most ``share`` of all entities have, with that share."""
    total = rows.agg(F.countDistinct(entity).alias("_n"))
    each = rows.groupBy(item).agg(F.countDistinct(entity).alias("_k")).crossJoin(F.broadcast(total))  # one row
    return each.withColumn("share", F.col("_k") / F.col("_n")).where(F.col("share") <= share).select(item, "share")


def dense_entities(rows: DataFrame, entity: str, item: str, value: str, share: float = 0.068, least: int = 2) -> DataFrame:
    """(entity, n, kept, gap): whether an entity has ``max(least, floor(share * items))`` items, and how wide the gap is at that cut."""
    held = rows.where(F.col(value) > 0)
    total = rows.agg(F.countDistinct(item).alias("_m"))
    n = rows.select(entity).distinct().join(held.groupBy(entity).agg(F.countDistinct(item).alias("n")), entity, "left").select(entity, F.coalesce("n", F.lit(0)).alias("n"))
    each = n.crossJoin(F.broadcast(total)).withColumn("kept", F.col("n") >= F.greatest(F.lit(least), F.floor(share * F.col("_m")))).drop("_m")  # one row
    gap = each.agg((F.min(F.when(F.col("kept"), F.col("n"))) - F.max(F.when(~F.col("kept"), F.col("n")))).alias("gap"))
    return each.crossJoin(F.broadcast(gap))  # one row


def consolidated(headings: DataFrame, known: DataFrame, heading: str, source: str, name: str, first_id: int) -> DataFrame:
    """(id, name, sources): headings without units that are no known name, each once with its sources, numbered in order."""
    rows = headings.select(without_units(heading).alias("_clean"), source).where(names_chemical("_clean"))
    rows = rows.withColumn("_low", F.lower("_clean")).join(known.select(F.lower(name).alias("_low")).distinct(), "_low", "left_anti")
    merged = rows.groupBy("_low").agg(F.min("_clean").alias("name"), F.array_join(F.array_sort(F.collect_set(source)), " | ").alias("sources"))
    return merged.join(numbered(merged, "_low"), "_low").select((F.col("number") + first_id - 1).alias("id"), "name", "sources")


def contributors(top: DataFrame, targets: DataFrame, item: str, nutrient: str, entity: str) -> DataFrame:
    """(item, n): entities that target any of an item's top nutrients."""
    return top.select(item, nutrient).distinct().join(targets.select(entity, nutrient).distinct(), nutrient).groupBy(item).agg(F.countDistinct(entity).alias("n"))


def stereo_carry_over(rows: DataFrame, kind: Column, in_model: Column) -> DataFrame:
    """One row: matched rows, those that differ only in configuration by kind, and mismatches that the model uses."""
    out = rows.select(kind.alias("_k"), in_model.alias("_m"))
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    return out.agg(F.count(F.lit(1)).alias("matched"), *(count(F.col("_k") == k).alias(k) for k in ("generalized", "specialized", "mismatch")), count((F.col("_k") == "mismatch") & F.col("_m")).alias("mismatch_in_model"))


# --- one row of a kind --------------------------------------------------------------------------------------------


def first_of(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], least: Sequence[str] = ()) -> DataFrame:
    """The first row of each key in order; one aggregation, so a hot key is combined before it moves.

    Columns named in ``least`` hold their smallest value among the key's rows instead of the first row's.
    """
    rest = [c for c in df.columns if c not in keys]
    place = F.struct(*((F.col(o) if isinstance(o, str) else o).alias(f"o{i}") for i, o in enumerate(order)))
    first = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(place, F.struct(*rest))).alias("_r"), *(F.min(c).alias(f"_{c}") for c in least))
    return first.select(*keys, *((F.col(f"_{c}") if c in least else F.col(f"_r.{c}")).alias(c) for c in rest)).select(*df.columns)


def authoritative(df: DataFrame, old: str, new: str, value: str) -> DataFrame:
    """(new, value) of merged ids: that of the record that was the id all along, else the first of the merged ones."""
    return df.groupBy(new).agg(F.min_by(value, F.struct(F.col(old) != F.col(new), F.col(old))).alias(value))


def distinct_codes(df: DataFrame, code: str, order: str) -> DataFrame:
    """Codes that recur get "#2", "#3" and so on, in order."""
    place = F.row_number().over(Window.partitionBy(code).orderBy(order))
    return df.withColumn("_p", place).withColumn(code, F.when(F.col("_p") > 1, F.concat(code, F.lit("#"), "_p")).otherwise(F.col(code))).drop("_p")


def representative(df: DataFrame, group: str, id_: str, kind: str, priority: dict[str, int]) -> DataFrame:
    """(group, id): the id of the highest priority of its kind in a group, of equals the lowest."""
    table = F.create_map(*(F.lit(x) for item in priority.items() for x in item))
    return df.groupBy(group).agg(F.min_by(id_, F.struct(-F.coalesce(F.element_at(table, F.col(kind)), F.lit(0)), F.col(id_))).alias(id_))


def community(targets: DataFrame, nutrient: str) -> DataFrame:
    """The nutrients of any entity: the targets of all together."""
    return targets.select(nutrient).where(F.col(nutrient).isNotNull()).distinct()


def rows_of(rows: DataFrame, key: str, matched: DataFrame) -> DataFrame:
    """Rows whose key is among the matched ones: a matcher sees each distinct key once, and the rows are read again."""
    return rows.join(matched.select(key).distinct(), key, "left_semi")


def with_coordinates(annotations: DataFrame, coordinates: DataFrame, locus: str, code: str) -> DataFrame:
    """Distinct annotations of complete codes, with the coordinates of their locus where it has any."""
    full = annotations.where(F.col(code).rlike(FULL_CODE))
    return full.join(coordinates, locus, "left").distinct()


def any_match(rows: DataFrame, cell: str, wanted: Sequence[str], separator: str = ",") -> DataFrame:
    """Rows with any of the wanted codes in a cell of several."""
    codes = F.transform(F.split(F.coalesce(F.col(cell), F.lit("")), separator), lambda x: F.trim(x))
    return rows.where(F.arrays_overlap(codes, F.array(*map(F.lit, wanted))))


def head(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n rows in order."""
    return df.orderBy(*order).limit(n)
