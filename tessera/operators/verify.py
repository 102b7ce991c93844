"""Contracts of published tables as rows of (check_name, passed, detail)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def row_checks(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """One row per check: how many rows break it (null counts as broken); all checks in one pass."""
    bad = df.agg(*(F.count_if(~F.coalesce(ok, F.lit(False))).alias(name) for name, ok in checks.items()))
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("check_name"), F.col(n).alias("detail")) for n in checks)))
    return bad.select(each.alias("c")).select("c.check_name", (F.col("c.detail") == 0).alias("passed"), "c.detail")


def unique_check(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    twice = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").agg(F.count(F.lit(1)).alias("detail"))
    return twice.select(F.lit(name).alias("check_name"), (F.col("detail") == 0).alias("passed"), "detail")


def reference_check(df: DataFrame, key: str, parent: DataFrame, parent_key: str, name: str) -> DataFrame:
    """Rows whose key isn't in the parent table."""
    orphans = df.join(parent.select(F.col(parent_key).alias(key)), key, "left_anti").agg(F.count(F.lit(1)).alias("detail"))
    return orphans.select(F.lit(name).alias("check_name"), (F.col("detail") == 0).alias("passed"), "detail")


def one_to_one_check(df: DataFrame, a: str, b: str, name: str) -> DataFrame:
    pairs = df.select(a, b).distinct()
    many = pairs.groupBy(a).count().where("count > 1").select(F.lit(1)).union(pairs.groupBy(b).count().where("count > 1").select(F.lit(1)))
    return many.agg(F.count(F.lit(1)).alias("detail")).select(F.lit(name).alias("check_name"), (F.col("detail") == 0).alias("passed"), "detail")


def same_keys_check(a: DataFrame, b: DataFrame, key: str, name: str) -> DataFrame:
    """Keys that only one of two tables has."""
    x, y = a.select(key), b.select(key)
    odd = x.subtract(y).union(y.subtract(x)).agg(F.count(F.lit(1)).alias("detail"))
    return odd.select(F.lit(name).alias("check_name"), (F.col("detail") == 0).alias("passed"), "detail")


def pinned_counts(df: DataFrame, expected: dict[str, tuple[Column, int]]) -> DataFrame:
    """Aggregates against the values pinned for them."""
    got = df.agg(*(c.cast("long").alias(n) for n, (c, _) in expected.items()))
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("check_name"), F.col(n).alias("detail"), F.lit(v).cast("long").alias("want")) for n, (_, v) in expected.items())))
    return got.select(each.alias("c")).select("c.check_name", (F.col("c.detail") == F.col("c.want")).alias("passed"), "c.detail")


def field_count_check(lines: DataFrame, header: str, name: str, separator: str = "\t") -> DataFrame:
    """Lines of text whose number of fields isn't the header's."""
    n = header.count(separator) + 1
    bad = lines.agg(F.count_if(F.size(F.split("value", separator)) != n).alias("detail"))
    return bad.select(F.lit(name).alias("check_name"), (F.col("detail") == 0).alias("passed"), "detail")


def all_checks(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def funnel(df: DataFrame, stages: dict[str, Column], weight: str | None = None) -> DataFrame:
    """(stage, n, weighted): rows that pass each stage and all before it."""
    passed, ok = {}, F.lit(True)
    for name, c in stages.items():
        ok = ok & F.coalesce(c, F.lit(False))
        passed[name] = ok
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    sums = df.agg(*(x for n, c in passed.items() for x in (F.count_if(c).alias(f"n_{n}"), F.coalesce(F.sum(F.when(c, w)), F.lit(0.0)).alias(f"w_{n}"))))
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("stage"), F.col(f"n_{n}").alias("n"), F.col(f"w_{n}").alias("weighted")) for n in passed)))
    return sums.select(each.alias("s")).select("s.*")


def weighted_match_rate(rows: DataFrame, cell: str, known: DataFrame, code: str, split: Column) -> DataFrame:
    """One row: cells with a known code among all, counted on distinct cells with their frequency, never exploding rows."""
    cells = rows.groupBy(cell).agg(F.count(F.lit(1)).alias("_n"))
    hit = cells.select(cell, F.explode(split).alias(code)).join(known.select(code).distinct(), code, "left_semi").select(cell).distinct().withColumn("_hit", F.lit(True))
    out = cells.where(F.size(split) > 0).join(hit, cell, "left").agg(F.sum("_n").alias("n"), F.coalesce(F.sum(F.when(F.col("_hit"), F.col("_n"))), F.lit(0)).alias("matched"))
    return out.withColumn("rate", F.col("matched") / F.col("n"))


def code_substance_checks(df: DataFrame, code: str, flag: str, ids: str, pattern: str) -> DataFrame:
    """Contracts of a table of codes and substances: full codes, a yes/no flag, and ids where the flag says yes."""
    yes = F.col(flag) == "yes"
    return row_checks(df, {"full_code": F.col(code).rlike(pattern), "flag_known": F.col(flag).isin("yes", "no"), "yes_has_ids": ~F.coalesce(yes, F.lit(False)) | (F.trim(F.coalesce(ids, F.lit(""))) != "")})


def composition_checks(df: DataFrame, amount: str, name: str, item: str) -> DataFrame:
    """Contracts of a composition table: amounts are numbers or blank, and how many items have no name."""
    text = F.trim(F.coalesce(F.col(amount).cast("string"), F.lit("")))
    numbers = row_checks(df, {"amount_numeric": (text == "") | text.try_cast("double").isNotNull()})
    blank = df.agg(F.countDistinct(F.when(F.trim(F.coalesce(name, F.lit(""))) == "", F.col(item))).alias("detail"))
    return numbers.unionByName(blank.select(F.lit("items_without_name").alias("check_name"), (F.col("detail") == 0).alias("passed"), "detail"))


def rights_checks(rights: DataFrame, observed: DataFrame, source: str, needed: Sequence[str], restricted: Column) -> DataFrame:
    """Contracts of a rights table: its fields are filled, every observed label has a row, and no restricted one is observed."""
    filled = row_checks(rights, {"fields_filled": reduce(lambda a, b: a & b, (F.trim(F.coalesce(c, F.lit(""))) != "" for c in needed))})
    barred = observed.select(source).distinct().join(rights.where(restricted).select(source), source, "left_semi").agg(F.count(F.lit(1)).alias("detail"))
    leaks = barred.select(F.lit("no_restricted_rows").alias("check_name"), (F.col("detail") == 0).alias("passed"), "detail")
    return all_checks(filled, reference_check(observed.select(source).distinct(), source, rights, source, "labels_have_rights"), leaks)


def migration_checks(moved: DataFrame, source: str, old: str, new: str, inside: Column) -> DataFrame:
    """Contracts of new keys: each once, inside its source's block, in the old order within a source, and as many as before."""
    once = moved.groupBy(new).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").agg(F.count(F.lit(1)).alias("detail"))
    order = moved.withColumn("_before", F.lag(new).over(Window.partitionBy(source).orderBy(old))).agg(F.count_if(F.col(new) < F.col("_before")).alias("detail"))
    named = lambda df, name: df.select(F.lit(name).alias("check_name"), (F.col("detail") == 0).alias("passed"), "detail")
    return all_checks(named(once, "unique"), row_checks(moved, {"contained": inside, "every_key_moved": F.col(new).isNotNull()}), named(order, "order_kept"))
