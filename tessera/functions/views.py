"""Views of names for inverted indexes: nutrients, the same for matching, and substrates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import text_column


@dataclass(frozen=True)
class Cleaning:
    """What a view drops and writes out (fixed values; patterns ignore case)."""

    admin: tuple[str, ...] = (r"\bdo\s*not\s*use\b", r"\barchiv(?:ed|e)\b", r"\bdeprecated\b", r"\bobsolete\b", r"\bnot\s+for\s+use\b", r"\bplaceholder\b", r"\bunknown\b")
    meta: tuple[str, ...] = (r"\batwater\b", r"\bgeneral\s+factors?\b", r"\bspecific\s+factors?\b", r"\bby\s+difference\b", r"\bas\s+(?:n|as)\b")
    leading: tuple[str, ...] = (r"^\s*total\s+", r"^\s*sum\s+of\s+")
    trailing: tuple[str, ...] = (r"\bequivalents?\b", r"\beq\.?\b", r"\btotal\b")
    shorthands: tuple[tuple[str, str], ...] = (("pnp", "p-nitrophenyl"), ("4np", "4-nitrophenyl"), ("onp", "o-nitrophenyl"), ("xos", "xylooligosaccharide"), ("gos", "galactooligosaccharide"), ("fos", "fructooligosaccharide"))
    formulas: bool = False  # "Salt, NaCl" is "Salt"


NUTRIENT = Cleaning()
#: For matching: no shorthands, formulas go, and another list of what is dropped.
MATCHING = Cleaning(admin=NUTRIENT.admin[:5], meta=(*NUTRIENT.meta[:4], r"\bintrinsic\b"), shorthands=(), formulas=True)
_GREEK = (("α", "alpha"), ("β", "beta"), ("γ", "gamma"), ("δ", "delta"), ("κ", "kappa"), ("μ", "mu"))
_SHORT_WORDS = r"\(\s*(?![^)]*\b(?:D|L|DL)\b)[A-Za-z\-](?:[A-Za-z \-]{0,10}[A-Za-z\-])?\s*\)"


def _spaces(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def cleaned(c: Column | str, rules: Cleaning = NUTRIENT) -> Column:
    """A name without notes, quantities and qualifiers; parentheses stay where they tell compounds apart."""
    s = F.trim(F.coalesce(text_column(c), F.lit("")))
    for letter, name in _GREEK:
        s = F.replace(s, F.lit(letter), F.lit(name))
    s = F.regexp_replace(F.regexp_replace(s, "[→⟶⟹⇒]", "->"), "[–—−]", "-")
    s = F.regexp_replace(s, rf"(?i)\([^)]*(?:{'|'.join(rules.admin)})[^)]*\)", " ")
    s = F.regexp_replace(F.regexp_replace(s, _SHORT_WORDS, " "), r"\(\s*([^)]*?)\s*\)", " ($1) ")
    symbol = r"\b([A-Za-z]+),\s*[A-Z][a-z]?\b$"
    if rules.formulas:
        s = F.regexp_replace(F.regexp_replace(F.trim(s), symbol, "$1"), r"^(.+?),\s*([A-Z][A-Za-z0-9]{0,10})\s*$", "$1")
    for pattern in rules.leading:
        s = F.regexp_replace(s, f"(?i){pattern}", "")
    s = F.regexp_replace(s, f"(?i){'|'.join(rules.meta)}", " ")
    for pattern in rules.trailing:
        s = F.regexp_replace(s, rf"(?i)\s+{pattern}\s*$", " ")
    for short, name in rules.shorthands:
        s = F.regexp_replace(s, rf"(?i)\b{short}\b", name)
    s = F.replace(F.replace(F.replace(s, F.lit("/"), F.lit(" / ")), F.lit(","), F.lit(", ")), F.lit(";"), F.lit(" ; "))
    s = _spaces(F.regexp_replace(s, r"\(\s*\)", " "))
    return s if rules.formulas else _spaces(F.regexp_replace(s, symbol, "$1"))


def _norm(c: Column) -> Column:
    s = F.lower(F.trim(c))
    for mark, joint in (("-", "-"), ("/", "/"), (";", "; "), (",", ", ")):
        s = F.regexp_replace(s, rf"\s*{mark}\s*", joint)
    s = F.regexp_replace(F.regexp_replace(_spaces(s), r",\s*,+", ", "), r";\s*;+", "; ")
    return F.regexp_replace(F.regexp_replace(s, r"^(.+?)\s*\1$", "$1"), r",\s*$", "")


def nutrient_views(c: Column | str, rules: Cleaning = NUTRIENT) -> dict[str, Column]:
    """norm, no_commas, no_paren and compact of a nutrient's name, from the strictest to the loosest."""
    s = cleaned(c, rules)
    norm = _norm(s)
    return {
        "norm": norm,
        "no_commas": _spaces(F.replace(norm, F.lit(","), F.lit(" "))),
        "no_paren": _norm(_spaces(F.regexp_replace(s, r"\([^)]*\)", " "))),
        "compact": _spaces(F.regexp_replace(F.lower(s), "[^a-z0-9]+", " ")),
    }


# Ions of salts, and hydrates.
_SALTS = r"\b(sodium|potassium|lithium|ammonium|calcium|magnesium|zinc|iron|ferric|ferrous|chloride|bromide|iodide|fluoride|nitrate|sulfate|sulphate|phosphate|carbonate|acetate|salt|disodium|dipotassium|monosodium|monopotassium)\b"
_HYDRATES = r"\b(mono|di|tri|tetra|penta|hexa|hepta|octa)?hydrate\b"


def substrate_views(c: Column | str) -> dict[str, Column]:
    """basic, no_commas, no_paren, compact and salt (without counter-ions, water and concentrations) of a substrate's name."""
    s = F.coalesce(text_column(c), F.lit(""))
    for letter, name in (*_GREEK[:5], ("ω", "omega"), ("­", ""), ("’", "'"), ("′", "'"), ("−", "-")):
        s = F.replace(s, F.lit(letter), F.lit(name))
    basic = _spaces(F.lower(s))
    no_paren = _spaces(F.regexp_replace(F.regexp_replace(basic, r"\([^)]*\)", " "), r"\[[^\]]*\]", " "))
    salt = F.regexp_replace(F.regexp_replace(no_paren, _SALTS, " "), _HYDRATES, " ")
    return {
        "basic": basic,
        "no_commas": _spaces(F.replace(basic, F.lit(","), F.lit(" "))),
        "no_paren": no_paren,
        "compact": F.regexp_replace(basic, "[^a-z0-9]+", ""),
        "salt": _spaces(F.regexp_replace(salt, r"(?i)\b\d+\s*(?:mM|uM|µM|nM|M)\b", " ")),
    }


def without_qualifiers(c: Column | str) -> Column:
    """A nutrient's name without words that say how it was measured."""
    return _spaces(F.regexp_replace(text_column(c), r"(?i)\bdetermined\b|\bequivalen(ts?|ce)\b|\bdfe\b|\bfood\b|\btotal\b", " "))
