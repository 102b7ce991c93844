"""Joins and filters of published tables: links of substances, composition, rights, blocks of ids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import sanitise
from tessera.operators.facts import ordered_distinct_concat


def with_new_columns(df: DataFrame, side: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join of the columns that ``df`` lacks, one row of ``side`` for each key (its least), so rows never multiply."""
    new = [c for c in side.columns if c not in df.columns]
    one = side.groupBy(*keys).agg(F.min(F.struct(*new)).alias("_s")).select(*keys, "_s.*")
    return df.join(one, [*keys], "left")


def on_spine(spine: DataFrame, sheets: Sequence[DataFrame], key: str, annexes: Sequence[DataFrame] = ()) -> DataFrame:
    """A spine of items with the new columns of further sheets; items of annexes that it lacks are appended first."""
    out = spine
    for annex in annexes:
        out = out.unionByName(annex.join(out.select(key), key, "left_anti").dropDuplicates([key]), allowMissingColumns=True)
    for sheet in sheets:
        out = with_new_columns(out, sheet, [key])
    return out


def linked_substances(digest: DataFrame, links: DataFrame, keys: Sequence[str], id_: str, name: str, relation: str, score: str) -> DataFrame:
    """digest with the ids and names that it links to, best score first and each once, the best link, and whether it has any."""
    order = [-F.coalesce(F.col(score).cast("double"), F.lit(float("-inf"))), F.col(id_)]
    ids = ordered_distinct_concat(links, keys, order, F.col(id_).cast("string"), ",", f"{id_}s")
    names = ordered_distinct_concat(links, keys, order, sanitise(name), "; ", f"{name}s")
    best = links.groupBy(*keys).agg(F.min_by(F.struct(relation, score), F.struct(*(o.alias(f"o{i}") for i, o in enumerate(order)))).alias("_b")).select(*keys, "_b.*")
    own = ids.join(names, [*keys]).join(best, [*keys])
    out = digest.join(own, [*keys], "left")
    return out.withColumn("in_model", F.when(F.col(f"{id_}s").isNotNull(), "yes").otherwise("no"))


def composition(facts: DataFrame, items: DataFrame, nutrients: DataFrame, item: str, nutrient: str) -> DataFrame:
    """Facts of known items (inner) with what is known of their nutrients (left); orphans are those of ``orphan_facts``."""
    return facts.join(items, item).join(nutrients, nutrient, "left")


def orphan_facts(facts: DataFrame, items: DataFrame, item: str) -> DataFrame:
    return facts.join(items.select(item), item, "left_anti")


def without_types(items: DataFrame, type_: str, dropped: Sequence[str], kept: Sequence[str] = ()) -> DataFrame:
    """Items but those of the dropped types; a null type is none of them, and types in ``kept`` stay after all."""
    return items.where(~F.coalesce(F.col(type_), F.lit("")).isin(*[t for t in dropped if t not in kept] or [None]) | F.col(type_).isNull())


def without_names(items: DataFrame, name: str, pattern: str) -> DataFrame:
    return items.where(~F.coalesce(F.col(name), F.lit("")).rlike(pattern))


def without_ids(df: DataFrame, id_: str, denied: Sequence[int]) -> DataFrame:
    """Rows but those of a short list of ids; null ids stay."""
    return df.where(F.col(id_).isNull() | ~F.col(id_).isin(*denied))


def resolved_category(own: Column | str, code: Column | str, lookup: dict[str, str]) -> Column:
    """The own label, else that of a numeric code, else a code that is a text itself."""
    own, code = (F.col(c) if isinstance(c, str) else c for c in (own, code))
    table = F.create_map(*(F.lit(x) for item in lookup.items() for x in item))
    return F.coalesce(own, F.when(code.rlike(r"^\d+$"), F.element_at(table, code)), F.when(~code.rlike(r"^\d+$"), code))


def without_restricted(facts: DataFrame, rights: DataFrame, source: str, tier: str = "tier", restricted: str = "Restricted") -> DataFrame:
    """Facts whose label (one source) isn't restricted."""
    return facts.join(rights.where(F.col(tier) == restricted).select(source), source, "left_anti")


def rights_table(rights: DataFrame, observed: DataFrame, source: str, rank: str, texts: Sequence[str], restricted: Column | None = None) -> DataFrame:
    """One row for each source and each observed composite label (joined by ";").

    A composite takes the terms of its strictest known part (the largest rank), and
    all parts' ``texts`` joined by " + "; a label without a known part is "unknown".
    Labels with a restricted part are left out where ``restricted`` (of rights) is given.
    """
    terms = [c for c in rights.columns if c not in (source, rank, *texts)]
    labels = observed.select(F.col(source).alias("_label")).union(rights.select(source)).where("_label <> ''").distinct()
    parts = labels.select("_label", F.posexplode(F.split("_label", ";")).alias("_at", source)).join(rights, source, "left")
    if restricted is not None:
        barred = rights.where(restricted).select(source)
        parts = parts.join(parts.join(barred, source, "left_semi").select("_label").distinct(), "_label", "left_anti")
    known = F.col(rank).isNotNull()
    strictest = F.max_by(F.struct(*terms), F.when(known, F.struct(F.col(rank), -F.col("_at"))))
    joined = [F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("_at", c)))), lambda x: x[c]), " + ").alias(c) for c in texts]
    out = parts.groupBy("_label").agg(strictest.alias("_t"), F.max(rank).alias(rank), F.count_if(known).alias("n_parts"), *joined)
    return out.select(F.col("_label").alias(source), *(F.coalesce(F.col(f"_t.{c}"), F.lit("unknown")).alias(c) for c in terms), rank, "n_parts", *texts)


# --- blocks of ids ------------------------------------------------------------------------------------------------


def block_of(id_: Column | str, width: int, reserved: int = 1) -> Column:
    """The number of an id's block; ids of the first ``reserved`` blocks belong to block 0."""
    n = F.floor((F.col(id_) if isinstance(id_, str) else id_) / width)
    return F.when(n < reserved, F.lit(0)).otherwise(n).cast("long")


def block_problems(ids: DataFrame, blocks: DataFrame, source: str, id_: str, width: int) -> DataFrame:
    """(source, n, outside, shared, over): ids outside their source's block, claimed by another source too, and beyond its capacity.

    blocks has the source and its first block; every count is 0 where the allocation is sound.
    """
    own = ids.select(source, id_).distinct().join(blocks.select(source, "block"), source, "left")
    claims = own.groupBy(id_).agg(F.countDistinct(source).alias("_claims")).where("_claims > 1")
    rows = own.join(claims, id_, "left")
    inside = F.coalesce((F.col(id_) >= F.col("block") * width) & (F.col(id_) < (F.col("block") + 1) * width), F.lit(False))
    out = rows.groupBy(source).agg(F.count(F.lit(1)).alias("n"), F.count_if(~inside).alias("outside"), F.count_if(F.col("_claims").isNotNull()).alias("shared"))
    return out.withColumn("over", F.greatest(F.col("n") - width, F.lit(0)))


def coverage_severity(parsed: DataFrame, expected: DataFrame, source: str, n: str, want: str) -> DataFrame:
    """(source, n, want, severity): how much of a source's expected items was parsed."""
    rows = expected.select(source, want).join(parsed.select(source, n), source, "left").withColumn(n, F.coalesce(n, F.lit(0)))
    share = F.try_divide(n, want)
    severity = F.when(F.col(n) == 0, "ZERO").when(share.isNull() | (F.col(want) <= 0), "?").when(share < 0.6, "HIGH").when(share < 0.95, "MED").otherwise("OK")
    return rows.withColumn("severity", severity)


def require_items(parsed: DataFrame, expected: DataFrame, source: str, n: str, want: str) -> DataFrame:
    """parsed as it is; a source with fewer items than expected is an error at run time."""
    rows = parsed.join(expected.select(source, want), source, "left")
    enough = F.coalesce(F.col(n) >= F.col(want), F.lit(True))
    fine = F.when(enough, F.col(n)).otherwise(F.raise_error(F.concat(F.col(source), F.lit(": fewer items than expected"))).cast("long"))
    return rows.withColumn(n, fine).drop(want)


def audit(df: DataFrame, metrics: dict[str, Column]) -> DataFrame:
    """(metric, value) of a frame's aggregates, one row each, as text."""
    one = df.agg(*(c.cast("string").alias(name) for name, c in metrics.items()))
    return one.unpivot([], [*metrics], "metric", "value")


def stray_files(listed: DataFrame, expected: DataFrame, path: str = "path") -> DataFrame:
    """(path, state): files that are there and should not be, and those that are missing."""
    have, want = (df.select(path).distinct() for df in (listed, expected))
    return have.join(want, path, "left_anti").withColumn("state", F.lit("stray")).union(want.join(have, path, "left_anti").withColumn("state", F.lit("missing")))
