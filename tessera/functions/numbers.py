"""Numbers from messy cells, units, link scores and the gain kernel."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import text_column


@dataclass(frozen=True)
class NumberPolicy:
    """How a source writes numbers: what traces, limits and other text are worth, and which marks are dropped.

    ``None`` stands for null.  ``comma`` is "point" (decimal comma), "drop"
    (thousands) or "cut" (what follows is ignored).
    """

    trace: float | None = 0.0
    below: float | str | None = 0.0  # "value": the limit itself
    other: float | None = None
    comma: str = "point"
    brackets: str = "null"  # "null", "first" or "drop"
    parentheses: bool = False  # estimated values in parentheses count


#: Policies of the sources, by the family of their spread-sheets.
POLICIES = {
    "strict": NumberPolicy(trace=None, below=None),
    "trace_zero": NumberPolicy(),
    "limit_value": NumberPolicy(below="value", comma="cut", brackets="first", parentheses=True),
    "thousands": NumberPolicy(below="value", comma="drop", brackets="drop", parentheses=True),
    "all_zero": NumberPolicy(other=0.0, brackets="drop", parentheses=True),
    "trace_small": NumberPolicy(trace=0.001, below="value", comma="drop", brackets="drop", parentheses=True),
    "text_zero": NumberPolicy(other=None, below=0.0),
}


def clean_number(value: Column | str, policy: NumberPolicy | str = "trace_zero") -> Column:
    """A double from a messy cell; blank cells are null unless the policy gives other text a value."""
    p = POLICIES[policy] if isinstance(policy, str) else policy
    s = F.lower(F.trim(text_column(value)))
    if p.parentheses:
        s = F.regexp_replace(s, r"[()]", "")
    if p.brackets == "first":
        s = F.regexp_replace(s, r"^\[([^,\]]*),[^\]]*\]$", "$1")
    elif p.brackets == "drop":
        s = F.regexp_replace(s, r"[\[\]]", "")
    if p.comma == "point":
        s = F.regexp_replace(s, ",", ".")
    elif p.comma == "drop":
        s = F.regexp_replace(s, ",", "")
    else:
        s = F.regexp_replace(s, ",.*$", "")
    lit = lambda v: F.lit(v).cast("double")
    below = F.regexp_extract(s, r"^<\s*(.*)$", 1)
    return (
        F.when(s.rlike(r"^(tr|trace|traces|lod)$"), lit(p.trace))
        .when(s.startswith("<"), below.try_cast("double") if p.below == "value" else lit(p.below))
        .when(s.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)(e[+-]?\d+)?$"), s.try_cast("double"))
        .otherwise(lit(p.other))
    )


#: Grams in a unit of mass (fixed values).
MASS_UNITS = {"G": 1.0, "MG": 1e-3, "UG": 1e-6, "MCG": 1e-6, "NG": 1e-9, "KG": 1e3}


def unit_symbol(label: Column | str) -> Column:
    """The unit in a label as upper-case ASCII, without the basis per 100 g; other bases give null."""
    s = F.upper(F.regexp_replace(F.trim(text_column(label)), "[µμ]", "u"))
    bare = F.regexp_replace(s, r"\s*(/|PER)\s*100\s*G\s*$", "")
    return F.when(bare.rlike(r"^[A-Z_]+$"), bare)


def other_basis(label: Column | str) -> Column:
    """Whether a label is on another basis than 100 g of the item (fatty acids, nitrogen, a divisor)."""
    s = F.lower(text_column(label))
    return s.rlike(r"100\s*g\s*(fa\b|fatty)|/\s*g\s*n\b|per\s+g\s+n\b|gn\)|/\s*60\b")


def unit_factor(source: Column | str, target: Column | str) -> Column:
    """Factor from one unit to another; 1 where either is unknown, no mass, or on another basis.

    Labels recur in every cell of a column: use ``with_factor`` on long tables.
    """
    table = F.create_map(*(F.lit(x) for unit in MASS_UNITS.items() for x in unit))
    grams = lambda c: F.when(~other_basis(c), F.element_at(table, unit_symbol(c)))
    return F.coalesce(grams(source) / grams(target), F.lit(1.0))


def with_factor(rows: DataFrame, labels: DataFrame, key: str, source: str = "source_unit", target: str = "target_unit") -> DataFrame:
    """rows with factor, looked up by ``key`` in labels (key and two units): units are read once a label, not once a cell."""
    factors = labels.groupBy(key).agg(F.min(F.struct(source, target)).alias("_u")).select(key, unit_factor(f"_u.{source}", f"_u.{target}").alias("factor"))
    return rows.join(factors, key, "left").withColumn("factor", F.coalesce("factor", F.lit(1.0)))


def bucket_of(column: Column | str, buckets: int = 256) -> Column:
    """Non-negative bucket of an id; null goes to the bucket of -1."""
    return F.pmod(F.coalesce(text_column(column).cast("long"), F.lit(-1)), F.lit(buckets)).cast("int")


def link_score(cost: Column | str, relation: Column | str, max_cost: float = 1.5) -> Column:
    """0-100 for a walk's cost, with a bonus by relation, rounded half to even."""
    cost, relation = text_column(cost), text_column(relation)
    bonus = F.when(relation == "exact", 10).when(relation.startswith("conjugate") | relation.isin("tautomer", "identity"), 5).when(relation.isin("scaffold", "part_of"), -5).otherwise(0)
    raw = F.lit(100.0) if max_cost <= 0 else 100.0 * (1.0 - cost / max_cost) + bonus
    return F.bround(F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw))).cast("int")


def saturating_gain(amount: Column, scale: Column, current: Column | None = None) -> Column:
    """ln(1 + (current + amount) / scale) - ln(1 + current / scale)."""
    now = F.lit(0.0) if current is None else current
    return F.log1p((now + amount) / scale) - F.log1p(now / scale)


def breadth(n: Column) -> Column:
    """sqrt(n / (n + 2)): little for one improved nutrient, near one for many."""
    return F.sqrt(n / (n + F.lit(2.0)))
