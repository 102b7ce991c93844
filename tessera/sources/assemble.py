"""What each source's files need before they are one sheet, or one list of cells, that the ingest reads.

Sheets are frames as the readers give them, all columns as text.  Every function
returns a wide sheet for ``connectors.long_cells``, or cells (key, label, cell).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.rules import category_of_name, column_base, column_unit
from tessera.functions.text import squeeze
from tessera.operators.cohort import distinct_codes, first_of
from tessera.operators.exports import on_spine


def quoted(column: str) -> Column:
    return F.col(f"`{column}`")


def tidy_headers(sheet: DataFrame) -> DataFrame:
    """Headers on one line, and repeated ones told apart as "__dup2" and so on."""
    seen: dict[str, int] = {}
    names = []
    for c in sheet.columns:
        name = " ".join(c.split())
        seen[name] = seen.get(name, 0) + 1
        names.append(name if seen[name] == 1 else f"{name}__dup{seen[name]}")
    return sheet.toDF(*names)


def stacked(sheets: Sequence[DataFrame], key: str) -> DataFrame:
    """Rows of all sheets with a key, with the columns of any; a row without one describes columns."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sheets).where(F.trim(quoted(key)) != "")


def units_of_row(sheet: DataFrame, key: str) -> DataFrame:
    """(label, source_unit) from the first row without a key, which holds the units of the columns."""
    labels = [c for c in sheet.columns if c != key]
    row = sheet.where(quoted(key).isNull() | (F.trim(quoted(key)) == "")).limit(1)
    cells = row.select(*(quoted(c).cast("string").alias(c) for c in labels)).unpivot([], labels, "label", "source_unit")
    return cells.where("source_unit is not null")


def numbered_sheets(spine: DataFrame, sheets: Sequence[DataFrame], key: str, order: str) -> DataFrame:
    """A spine whose repeated codes get "#2" and so on, with the columns that the other sheets add."""
    return on_spine(distinct_codes(spine, key, order), sheets, key)


def with_species(sheets: Sequence[DataFrame], key: str, names: Sequence[str], species: str, order: Sequence[str]) -> DataFrame:
    """One row for each key of all sheets (the first in order), named in the first language that has a name, with its species."""
    rows = first_of(stacked(sheets, key), [key], list(order))
    name = F.coalesce(*(F.nullif(F.trim(quoted(c)), F.lit("")) for c in names))
    kind = F.nullif(F.trim(quoted(species)), F.lit(""))
    return rows.withColumn("description", F.when(kind.isNull(), name).otherwise(F.concat(name, F.lit(" ["), kind, F.lit("]"))))


def per_nitrogen(labels: DataFrame, label: str = "label") -> DataFrame:
    """(label, base, source_unit): a base on nitrogen is a nutrient of its own, "... per g n"."""
    unit = column_unit(label)
    base = F.when(F.lower(unit).rlike(r"/\s*g\s*n$"), F.concat(column_base(label), F.lit(" per g n"))).otherwise(column_base(label))
    return labels.select(label, base.alias("base"), unit.alias("source_unit"))


def with_name_category(sheet: DataFrame, name: str) -> DataFrame:
    return sheet.withColumn("category", category_of_name(quoted(name)))


def spine_with_annex(spine: DataFrame, annex: DataFrame, sheets: Sequence[DataFrame], key: str) -> DataFrame:
    """Sheets by whole numbers of items: the annex's further items, the other sheets' columns, and the group that a number's thousands are."""
    number = lambda df: df.withColumn(key, quoted(key).try_cast("int")).where(quoted(key).isNotNull())
    out = on_spine(number(spine), [number(s) for s in sheets], key, [number(annex)])
    return out.withColumn("category", F.expr(f"`{key}` div 1000").cast("string"))


def two_key_analytes(labels: DataFrame, catalogue: DataFrame, overrides: dict[str, int]) -> DataFrame:
    """(label, nutrient_id): by name and unit, then by name alone, then by override.

    labels has label, name and source_unit; catalogue has id, name and unit_name.
    """
    known = catalogue.select(squeeze("name").alias("_n"), F.lower("unit_name").alias("_u"), "id")
    both = known.groupBy("_n", "_u").agg(F.min("id").alias("_both"))
    single = known.groupBy("_n").agg(F.min("id").alias("_single"))
    rows = labels.select("label", squeeze("name").alias("_n"), F.lower("source_unit").alias("_u")).join(both, ["_n", "_u"], "left").join(single, "_n", "left")
    table = F.create_map(*(F.lit(x) for item in overrides.items() for x in item)) if overrides else None
    return rows.select("label", F.coalesce("_both", "_single", *([F.element_at(table, F.col("_n")).cast("long")] if table is not None else [])).alias("nutrient_id"))


def related_cells(amounts: DataFrame, items: DataFrame, analytes: DataFrame, key: str, analyte: str, label: str, value: str) -> DataFrame:
    """(key, label, cell) of a source in three tables: amounts of known items and analytes."""
    rows = amounts.join(items.select(key).distinct(), key, "left_semi").join(analytes.select(analyte, quoted(label).alias("label")).distinct(), analyte)
    return rows.select(quoted(key).cast("string").alias("key"), "label", quoted(value).cast("string").alias("cell"))


def mean_of_means(cells: DataFrame, method: str, amount: Column) -> DataFrame:
    """(key, label, amount): the mean over methods of each method's mean, so a method with many values counts once."""
    rows = cells.select("key", "label", quoted(method).alias("_m"), amount.alias("_a")).where("_a is not null")
    return rows.groupBy("key", "label", "_m").agg(F.avg("_a").alias("_a")).groupBy("key", "label").agg(F.avg("_a").alias("amount"))


def digits_key(sheet: DataFrame, key: str) -> DataFrame:
    """Items keyed by the digits of their code."""
    return sheet.withColumn(key, F.regexp_replace(quoted(key), r"\D", "")).where(quoted(key) != "")


def with_positive(facts: DataFrame, items: DataFrame, item: str, amount: str) -> DataFrame:
    """Items with a positive value."""
    return items.join(facts.where(F.col(amount) > 0).select(item).distinct(), item, "left_semi")


def first_method(sheet: DataFrame, columns: Sequence[str], name: str) -> DataFrame:
    """One column of the first method that has a value, in the place of several."""
    value = F.coalesce(*(F.nullif(F.trim(quoted(c)), F.lit("")) for c in columns))
    return sheet.withColumn(name, value).drop(*[c for c in columns if c != name])


def synthetic_facts(spark: SparkSession, rows: Sequence[tuple[int, int, float]], also: dict[int, Sequence[int]] | None = None, source: str = "synthetic") -> DataFrame:
    """(item_id, nutrient_id, amount, source_db) of a short literal list; a nutrient's amount counts under its other ids too."""
    full = [(i, m, float(a)) for i, n, a in rows for m in (n, *(also or {}).get(n, ()))]
    return spark.createDataFrame(full, "item_id long, nutrient_id long, amount double").withColumn("source_db", F.lit(source))
