"""Names, codes and cells of text."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A complete code of four levels, and one whose last levels are open.
FULL_CODE = r"^\d+\.\d+\.\d+\.n?\d+$"
PARTIAL_CODE = r"^\d+(\.(\d+|-)){3}$"


def text_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sanitise(c: Column | str) -> Column:
    """Tabs, line ends and control characters as single spaces, trimmed; null as empty."""
    return F.trim(F.regexp_replace(F.coalesce(text_column(c), F.lit("")), r"[\x00-\x1F\x7F]+", " "))


def squeeze(c: Column | str) -> Column:
    """Lower case with single spaces."""
    return F.trim(F.regexp_replace(F.lower(text_column(c)), r"\s+", " "))


def printable_ascii(c: Column | str) -> Column:
    return F.regexp_replace(text_column(c), r"[^\x20-\x7E]", "")


#: Greek letters and their names (fixed values).
GREEK = {
    "α": "alpha", "β": "beta", "γ": "gamma", "δ": "delta", "ε": "epsilon", "ζ": "zeta", "η": "eta", "θ": "theta",
    "κ": "kappa", "λ": "lambda", "μ": "mu", "ω": "omega",
}


def plain_letters(c: Column | str) -> Column:
    """Greek letters by name, dashes and arrows in ASCII."""
    out = text_column(c)
    for letter, name in GREEK.items():
        out = F.replace(out, F.lit(letter), F.lit(name))
    return F.regexp_replace(F.regexp_replace(out, "[‐-―−]", "-"), "[→⇒]", "->")


def name_views(c: Column | str, compact_spaces: bool = True) -> dict[str, Column]:
    """Views of a name for an inverted index, from the strictest to the loosest."""
    norm = squeeze(plain_letters(c))
    no_commas = F.trim(F.regexp_replace(F.regexp_replace(norm, ",", " "), r"\s+", " "))
    no_paren = F.trim(F.regexp_replace(F.regexp_replace(norm, r"\([^()]*\)|\[[^\[\]]*\]", " "), r"\s+", " "))
    keep = r"[^a-z0-9 ]" if compact_spaces else r"[^a-z0-9]"
    compact = F.trim(F.regexp_replace(F.regexp_replace(norm, keep, " " if compact_spaces else ""), r"\s+", " "))
    return {"norm": norm, "no_commas": no_commas, "no_paren": no_paren, "compact": compact}


def collapse_twice(c: Column | str) -> Column:
    """A name that is one text twice becomes that text."""
    return F.regexp_replace(text_column(c), r"^(.+?)\s*\1$", "$1")


def split_codes(c: Column | str) -> Column:
    """Complete codes of a cell with several, in order, each once."""
    bare = F.regexp_replace(F.coalesce(text_column(c), F.lit("")), r"(?i)EC:", "")
    parts = F.transform(F.split(bare, r"[,;|\s]+"), lambda x: F.trim(x))
    return F.array_distinct(F.filter(parts, lambda x: x.rlike(FULL_CODE)))


def bracket_codes(c: Column | str) -> Column:
    """Codes of all [EC:...] blocks of a definition."""
    blocks = F.regexp_extract_all(text_column(c), F.lit(r"\[EC:([^\]]*)\]"), F.lit(1))
    return F.array_distinct(F.flatten(F.transform(blocks, lambda b: F.split(F.trim(b), r"\s+"))))


def code_sort_key(c: Column | str) -> Column:
    """Levels of a dotted code as integers (null where not numeric) for numeric order."""
    return F.transform(F.split(text_column(c), r"\."), lambda x: x.try_cast("int"))


def equation_compounds(c: Column | str) -> Column:
    """Compounds on both sides of a reaction equation, without stoichiometry and trailing remarks."""
    bare = F.regexp_replace(F.regexp_replace(text_column(c), r"[\x00-\x1F]", " "), r"\s*\{[^{}]*\}\s*$", "")
    sides = F.split(bare, "=")
    parts = F.flatten(F.transform(sides, lambda s: F.split(F.trim(s), r" \+ ")))
    named = F.transform(parts, lambda x: F.trim(F.regexp_replace(F.trim(x), r"^\d+(\.\d+)?\s+", "")))
    return F.filter(named, lambda x: (F.length(x) > 0) & (F.length(x) < 200) & ~x.isin("?", "more"))


def braces(c: Column | str) -> Column:
    """Every text in braces."""
    return F.regexp_extract_all(text_column(c), F.lit(r"\{([^{}]*)\}"), F.lit(1))


def stereo_descriptors(c: Column | str) -> Column:
    """Stereo prefixes of a chemical name, sorted."""
    found = F.regexp_extract_all(F.lower(text_column(c)), F.lit(r"(?:^|[^a-z])((?:[dl]|[rs]|cis|trans|alpha|beta|meso|\d*[rs]))(?=-)"), F.lit(1))
    return F.array_sort(F.array_distinct(found))


def skeleton(c: Column | str) -> Column:
    """A chemical name without its stereo prefixes."""
    return F.regexp_replace(F.lower(text_column(c)), r"(^|[^a-z])(?:[dl]|[rs]|cis|trans|alpha|beta|meso|\d*[rs])-", "$1")


ORGANISM = T.StructType([T.StructField("genus", T.StringType()), T.StructField("species", T.StringType()), T.StructField("strain", T.StringType())])
# Ranks below the species, marks of a strain, and of an uncertain species.
_RANKS = {"subsp.", "subsp", "pv.", "bv.", "var.", "serovar", "biovar", "f.sp."}
_STRAIN_MARKS = {"str.", "strain"}
_UNCERTAIN = {"cf.", "aff."}


def organism_parts(name: str | None) -> tuple[str | None, str | None, str | None]:
    """Genus, species (with ranks below it) and strain of an organism's name; what is missing is null.

    Quotes around genus and species go, those of a strain stay; a strain's mark counts at its beginning alone.
    """
    words = (name or "").split()
    if not words:
        return None, None, None
    taken = 2 if len(words) > 1 and words[1].lower() not in _UNCERTAIN else min(3, len(words))
    while taken + 1 < len(words) and words[taken].lower() in _RANKS:
        taken += 2
    strain = words[taken + 1 :] if taken < len(words) and words[taken].lower() in _STRAIN_MARKS else words[taken:]
    genus = words[0].strip("'\"")
    return genus, " ".join([genus, *words[1:taken]]).strip("'\""), " ".join(strain) or None


@F.pandas_udf(ORGANISM)
def split_organism(names: pd.Series) -> pd.DataFrame:
    """Apply it to distinct names and join back: a name recurs in many rows."""
    return pd.DataFrame([organism_parts(n) for n in names], columns=["genus", "species", "strain"])


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity (matching blocks), which edit distance doesn't give."""
    from difflib import SequenceMatcher

    return pd.Series([SequenceMatcher(None, x, y).ratio() if x is not None and y is not None else None for x, y in zip(a, b)], dtype="float64")
