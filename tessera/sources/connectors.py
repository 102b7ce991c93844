"""One ingest for all composition tables: a spec says how a source writes keys, numbers, units and names."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.numbers import clean_number, unit_factor
from tessera.functions.text import squeeze
from tessera.operators.facts import mint


@dataclass(frozen=True)
class Source:
    """How one source's sheet becomes items and facts."""

    tag: str
    key: str
    name: Sequence[str]  # first non-null column
    policy: str = "trace_zero"
    category: str | None = None  # a column, or "=text"
    keep_zero: bool = True
    least: float | None = None
    skip: Sequence[str] = ()
    skip_name: str | None = None  # rows whose name matches are no items of their own
    duplicates: str = "first"  # "first", "max", "mean", "all"
    base: int = 0
    overrides: dict[str, int] = field(default_factory=dict)


#: The families of national tables; columns are those that their sheets are keyed and named by (fixed values).
SOURCES = {
    "mccance": Source("McCance", "Food Code", ("Food Name",), "trace_zero"),
    "biofoodcomp": Source("BioFoodComp", "Food item ID", ("Food name in English",), "strict"),
    "phyfoodcomp": Source("PhyFoodComp", "Food item ID", ("Food name in English", "Food name in own language"), "limit_value"),
    "afcd": Source("AFCD", "Public Food Key", ("Food Name",), "strict"),
    "stfcj": Source("STFCJ", "Item No.", ("Food and Description",), "thousands"),
    "swedish": Source("Livsmedelsverket", "Food Number", ("Food Name",), "all_zero", skip_name=r"^Kopia av |\(Copy of "),
    "swiss": Source("Swiss FCDB", "ID", ("name",), "trace_zero", keep_zero=False),
    "cnf": Source("CNF", "FoodID", ("FoodDescription",), "trace_zero", keep_zero=False, duplicates="max"),
    "nevo": Source("NEVO", "NEVO-code", ("Engelse naam/Food name",), "text_zero", keep_zero=False),
    "ciqual": Source("CIQUAL", "alim_code", ("alim_nom_eng",), "trace_zero", keep_zero=False),
    "fineli": Source("Fineli", "id", ("name",), "trace_zero", "=Fineli Database", keep_zero=False),
    "frida": Source("Frida", "FoodID", ("FoodName",), "trace_zero", keep_zero=False, duplicates="all"),
    "phenol": Source("Phenol-Explorer", "food", ("food",), "trace_zero", duplicates="mean"),
    "wafct": Source("WAFCT", "Code", ("Food name in English",), "trace_small", keep_zero=False),
}


def long_cells(sheet: DataFrame, spec: Source) -> DataFrame:
    """(key, label, cell): one row for each cell that isn't a key, a name or skipped."""
    fixed = {spec.key, *spec.name, *spec.skip} | ({spec.category} if spec.category and not spec.category.startswith("=") else set())
    columns = [c for c in sheet.columns if c not in fixed]
    text = [F.col(f"`{c}`").cast("string").alias(c) for c in columns]
    return sheet.select(F.col(f"`{spec.key}`").cast("string").alias("key"), *text).unpivot(["key"], columns, "label", "cell")


def items_of(sheet: DataFrame, spec: Source, registry: DataFrame) -> DataFrame:
    """(item_id, description, category, data_type, source_code); ids are minted once and kept."""
    name = F.coalesce(*(F.col(f"`{c}`").cast("string") for c in spec.name))
    category: Column = F.lit(None).cast("string") if spec.category is None else F.lit(spec.category[1:]) if spec.category.startswith("=") else F.col(f"`{spec.category}`").cast("string")
    rows = sheet.select(F.col(f"`{spec.key}`").cast("string").alias("code"), F.trim(name).alias("name"), category.alias("category")).where("code is not null and name is not null")
    if spec.skip_name:
        rows = rows.where(~F.col("name").rlike(spec.skip_name))
    rows = rows.groupBy("code").agg(F.min(F.struct("name", "category")).alias("r")).select("code", "r.*")
    known = registry.select("code", "number").union(mint(rows.select("code"), registry, "code", "number", spec.base))
    return rows.join(known, "code").select(F.col("number").alias("item_id"), F.concat("name", F.lit(f" [{spec.tag}]")).alias("description"), "category", F.lit("generic_food").alias("data_type"), F.col("code").alias("source_code"))


def analytes(labels: DataFrame, catalogue: DataFrame, spec: Source) -> DataFrame:
    """(label, nutrient_id, source_unit, target_unit): the label itself, then without its unit, then an override.

    catalogue has id, name and unit_name.  Labels without a match are left for minting by the caller.
    """
    bare = F.trim(F.regexp_replace("label", r"\s*[\[(][^\])]*[\])]\s*$", ""))
    unit = F.regexp_extract("label", r"[\[(]([^\])]*)[\])]\s*$", 1)
    known = catalogue.groupBy(squeeze("name").alias("k")).agg(F.min(F.struct("id", "unit_name")).alias("n"))
    rows = labels.select("label", squeeze("label").alias("full"), squeeze(bare).alias("short"), unit.alias("source_unit"))
    rows = rows.join(known.toDF("full", "a"), "full", "left").join(known.toDF("short", "b"), "short", "left")
    override = F.lit(None).cast("long")
    for label, number in spec.overrides.items():
        override = F.when(F.col("short") == label.lower(), F.lit(number)).otherwise(override)
    units = catalogue.select(F.col("id").alias("nutrient_id"), F.col("unit_name").alias("target_unit"))
    return rows.select("label", F.coalesce("a.id", "b.id", override).alias("nutrient_id"), "source_unit").join(units, "nutrient_id", "left")


def facts_of(sheet: DataFrame, spec: Source, items: DataFrame, mapped: DataFrame) -> DataFrame:
    """(item_id, nutrient_id, amount, source_db) of a sheet."""
    return facts_of_cells(long_cells(sheet, spec), spec, items, mapped)


def facts_of_cells(cells: DataFrame, spec: Source, items: DataFrame, mapped: DataFrame) -> DataFrame:
    """(item_id, nutrient_id, amount, source_db) of cells (key, label, cell)."""
    known = mapped.where("nutrient_id is not null")
    factors = known.withColumn("factor", unit_factor("source_unit", "target_unit"))  # once a label
    cells = cells.join(factors, "label")
    amount = clean_number("cell", spec.policy) * F.col("factor")
    rows = cells.join(items.select(F.col("source_code").alias("key"), "item_id"), "key").select("item_id", "nutrient_id", amount.alias("amount")).where("amount is not null")
    if not spec.keep_zero:
        rows = rows.where("amount > 0")
    if spec.least is not None:
        rows = rows.where(F.col("amount") > spec.least)
    how = {"max": F.max, "mean": F.avg, "first": F.min}.get(spec.duplicates)
    if how is not None:
        rows = rows.groupBy("item_id", "nutrient_id").agg(how("amount").alias("amount"))
    return rows.withColumn("source_db", F.lit(spec.tag))


def header_contains(labels: DataFrame, needles: DataFrame, label: str = "label") -> DataFrame:
    """(label, nutrient_id): the first needle (needle, ord, nutrient_id) that a header contains.

    Needles are a fixed list of a source's analytes, so they go into the plan as one array.
    """
    rows = [(r.ord, r.needle.lower(), r.nutrient_id) for r in needles.orderBy("ord").limit(1001).collect()]
    if len(rows) > 1000:
        raise ValueError("more than 1000 needles don't go into a plan; join them")
    first = F.coalesce(*(F.when(F.contains(F.lower(label), F.lit(n)), F.lit(i)) for _, n, i in rows))
    return labels.select(label, first.alias("nutrient_id")).where("nutrient_id is not null")
