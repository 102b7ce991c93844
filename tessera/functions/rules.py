"""Rules over names and codes, as ordered data that one evaluator applies: filters, classes, tags, aliases."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.text import GREEK, printable_ascii, squeeze, text_column

# --- evaluators ---------------------------------------------------------------------------------------------------


def first_class(c: Column | str, rules: Sequence[tuple[str, str]], default: str | None = None) -> Column:
    """The label of the first (label, pattern) that is found in the text; patterns ignore case."""
    text = F.coalesce(text_column(c), F.lit(""))
    out = F.lit(default).cast("string")
    for label, pattern in reversed(rules):
        out = F.when(text.rlike(f"(?i){pattern}"), F.lit(label)).otherwise(out)
    return out


def first_rewrite(c: Column | str, rules: Sequence[tuple[str, str | None, str]]) -> Column:
    """The text rewritten by the first (condition, part, replacement) whose condition is found.

    Without a part the replacement is the whole text; a text that no rule fits stays.
    """
    text = F.trim(F.coalesce(text_column(c), F.lit("")))
    out = text
    for condition, part, replacement in reversed(rules):
        new = F.lit(replacement) if part is None else F.trim(F.regexp_replace(text, f"(?i){part}", replacement))
        out = F.when(text.rlike(f"(?i){condition}"), new).otherwise(out)
    return out


def any_of(words: Sequence[str]) -> str:
    """A pattern for any of the words, whole."""
    return rf"\b({'|'.join(words)})\b"


# --- filters of names ---------------------------------------------------------------------------------------------

# Names that never reach the gut, simple sugars, amino acids.
NOISE = r"^(water|energy|energy \(atwater.*|ash|solids|nitrogen|proximates)$"
SIMPLE_SUGARS = ("sucrose", "glucose", "fructose", "lactose", "maltose", "galactose", "mannitol", "xylitol", "sorbitol", "sugar")
AMINO_ACIDS = (
    "alanine", "arginine", "asparagine", "aspartic acid", "cysteine", "glutamic acid", "glutamine", "glycine", "histidine", "isoleucine", "leucine",
    "lysine", "methionine", "phenylalanine", "proline", "serine", "threonine", "tryptophan", "tyrosine", "valine", "cystine",
)


def strict_prebiotic(name: Column | str, sugars: bool = False, amino_acids: bool = False) -> Column:
    """Whether a nutrient passes the strict filter; sugars and amino acids can be let in each on its own."""
    low = F.lower(F.trim(F.coalesce(text_column(name), F.lit(""))))
    out = ~low.rlike(NOISE)
    if not sugars:
        out = out & ~low.rlike(any_of(SIMPLE_SUGARS))
    if not amino_acids:
        out = out & ~low.rlike(any_of(AMINO_ACIDS))
    return out


def is_element(name: Column | str) -> Column:
    """Whether an entity is a neutral element ("zinc atom") or an ion of one ("zinc(2+)")."""
    return F.coalesce(text_column(name), F.lit("")).rlike(r"(?i)^[a-z]+(\s+atom|\(\d*[+-]\))$")


def moves_element(seed_name: Column | str, code: Column | str) -> Column:
    """Whether a link is only the transport of an element: a code of class 7 moves it and doesn't use it."""
    return is_element(seed_name) & F.coalesce(text_column(code), F.lit("")).startswith("7.")


# Molecules that take part in nearly every reaction.
UBIQUITOUS = (
    "h2o", "water", "h+", "proton", "hydron", "o2", "oxygen", "co2", "carbon dioxide", "nad+", "nad(+)", "nad(-)", "nadh", "nadp+", "nadph", "atp", "adp",
    "coa", "coenzyme a", "pi", "ppi", "nh3", "ammonia", "nadp(+)", "nadp(-)", "more", "fadh2", "fadh", "fad", "utp", "gtp", "datp", "dutp",
    "nad(p)+", "nad(p)h", "nad(p)(+)", "acceptor", "reduced acceptor", "donor", "reduced donor",
)


def plain_substrate(c: Column | str) -> Column:
    """A substrate's name in ASCII and lower case, without configurations and states."""
    out = F.regexp_replace(printable_ascii(c), r"(?i)\b([LD]-|\([RS]\)-|\(z\)-|\(e\)-)", "")
    out = F.regexp_replace(out, r"(?i)\s*\((ion|aqueous|solution|reduced|oxidized|re-face|si-face)\)", "")
    return squeeze(out)


def specific_substrate(c: Column | str) -> Column:
    """Whether a plain substrate names a compound: not ubiquitous, longer than two letters, no macromolecule in brackets."""
    s = F.coalesce(text_column(c), F.lit(""))
    return ~s.isin(*UBIQUITOUS) & (F.length(s) > 2) & ~s.rlike(r"^\[.*\]$")


# What is dropped before any match.
IGNORED_IDS = ("CHEBI:57540", "CHEBI:57945", "CHEBI:58349", "CHEBI:57783", "CHEBI:30616", "CHEBI:456216", "CHEBI:15377")
IGNORED_QUERY = r"\b(nadp?h?|nadp?\+|nad\( ?\+ ?\)|nadp\( ?\+ ?\)|thio[\-\s]?nadp?\+?|atp|adp|h2o|water|abts|tmpd|tetramethyl.*phenylenediamine)\b"


def ignored_query(c: Column | str) -> Column:
    return F.coalesce(text_column(c), F.lit("")).rlike(f"(?i){IGNORED_QUERY}")


_RESIDUE = "(?:Ala|Arg|Asn|Asp|Cys|Gln|Glu|Gly|His|Ile|Leu|Lys|Met|Phe|Pro|Ser|Thr|Trp|Tyr|Val)"
# Why a substrate has no entry, in the order in which it is asked.
NON_MATCH = [
    ("assay_reagent_no_chebi", r"\b(abts|azino-bis|benzthiazol|benzothiazol|tmpd|tetramethyl.*phenylenediamine|tetramethylbenzidine|dichlorophenolindophenol|dcpip|remazol|brilliant blue|sulfhydryl\s+reagents)\b"),
    ("metal_cluster_no_chebi", r"\[\s*\d+\s*Fe\s*-\s*\d+\s*S\s*\]\s*[-\w]*\b|iron[-\s]?sulfur"),
    ("peptide_no_chebi", rf"\b{_RESIDUE}(?:-{_RESIDUE}){{2,}}\b"),
    ("macromolecule_no_chebi", any_of((
        "protein", "albumin", "casein", "insulin", "collagen", "laminin", "fibrinogen", "plasminogen", "actin", "tubulin", "vimentin", "receptor", "kininogen",
        "mucin", "decorin", "ferredoxin", "flavodoxin", "cytochrome", "amyloid", "ovalbumin", "fetuin", "asialofetuin", "vitronectin", "cadherin", "catenin",
        "synuclein", "histone", "trypsinogen", "interleukin", "complement", "ezrin", "protamine", "phosvitin", "glycoprotein", "lysozyme", "ubiquitin",
        "caspase", "procaspase", "kallikrein", "myosin", "tropomyosin", r"factor\s+(?:viii|ix|x|xi|xii)", "igg", "thyroglobulin", "aggrecan", "osteopontin",
        "galectin", "syndecan", "synthase", "kinase", "dehydrogenase", "reductase", "transferase", "ligase", "polymerase", "phosphatase", "isomerase",
        "mutase", "protease", "peptidase", "transporter", "channel", "subunit", "component", "complex",
    ))),
    ("assay_marker_no_chebi", r"4\-nitroanilide|p\-nitroanilide|nitroanilide|4\-methylcoumaryl|7\-amido\-4\-methylcoumarin|amc|azocasein|azocoll|\bp\-nitrophenyl\b|\b4\-nitrophenyl\b|benzyloxycarbonyl|z\-|boc|fmoc|t\-butyloxycarbonyl|dinitrophenyl|methylumbelliferyl|4-methylumbelliferyl"),
    ("protein_modification_no_chebi", r"\bprotein\b.*\bphospho\b|\bN\-phospho\-L\-histidine\b"),
]


def no_match_class(c: Column | str) -> Column:
    """Why a text that matched nothing has no entry."""
    return first_class(c, NON_MATCH, "no_match")


# Words of a heading that names no chemical.
HEADING_WORDS = (
    "food", "index", "code", "item", "name", "desc", "remark", "unit", "weight", "factor", "energy", "kcal", "kj", "joule", "refuse", "edible", "portion",
    "water", "moisture", "protein", "fat", "lipid", "carbohydrate", "ash", "total", "sum", "equivalent", "error", "source", "reference", "date", "id", "group",
    "category", "type", "method", "sample", "aliment", "groupe", "energie", "eau", "proteines", "lipides", "glucides", "cendres", "voedingsmiddel", "naam",
    "eiwit", "koolhydraten", "vet", "vand", "kulhydrat", "energia", "vesi", "unnamed",
)


def novel_term(c: Column | str, words: Sequence[str] = HEADING_WORDS, max_words: int = 6) -> Column:
    """Whether a heading may name a chemical: three letters and more, no number, no heading word inside, few words.

    Known names are left out by an anti join afterwards.
    """
    s = squeeze(F.coalesce(text_column(c), F.lit("")))
    return (F.length(s) >= 3) & ~s.rlike(r"^\d+$") & ~s.rlike("|".join(words)) & (F.size(F.split(s, " ")) <= max_words)


def without_units(c: Column | str) -> Column:
    """A heading without the units in it."""
    out = F.regexp_replace(text_column(c), r"(?i)\((mg|g|µg|mcg|ug|%|kcal|kj|g/100g|mg/100g).*?\)", "")
    out = F.regexp_replace(F.regexp_replace(out, r"\[.*?\]", ""), r"§|µg|mg| g ", "")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def names_chemical(c: Column | str) -> Column:
    """Whether a heading without units is neither a code of its source nor a number."""
    s = F.coalesce(text_column(c), F.lit(""))
    return (F.length(s) >= 3) & ~s.rlike(r"(?i)^F\d{5,}$") & ~s.rlike(r"^[\d.]+$")


# --- tags of elements ---------------------------------------------------------------------------------------------

# Symbols of the elements, and the one tag that is not a symbol.
ELEMENTS = (
    "H He Li Be B C N O F Ne Na Mg Al Si P S Cl Ar K Ca Sc Ti V Cr Mn Fe Co Ni Cu Zn Ga Ge As Se Br Kr Rb Sr Y Zr Nb Mo Tc Ru Rh Pd Ag Cd In Sn Sb Te I Xe "
    "Cs Ba La Ce Pr Nd Pm Sm Eu Gd Tb Dy Ho Er Tm Yb Lu Hf Ta W Re Os Ir Pt Au Hg Tl Pb Bi Po At Rn Fr Ra Ac Th Pa U Np Pu"
).split()
TAG_ALIASES = {"ID": "I"}


def tag_element(c: Column | str) -> Column:
    """The element of a heading like "CA(mg)"; null where it is none."""
    tag = F.upper(F.regexp_extract(F.coalesce(text_column(c), F.lit("")), r"^\s*([A-Za-z]{1,3})\s*\([^)]{1,6}\)\s*$", 1))
    symbol = F.initcap(tag)
    for alias, own in TAG_ALIASES.items():
        symbol = F.when(tag == alias, own).otherwise(symbol)
    return F.when(symbol.isin(*ELEMENTS), symbol)


def name_element(c: Column | str) -> Column:
    """The symbol of a name like "Calcium, Ca"; null where it has none."""
    symbol = F.regexp_extract(F.coalesce(text_column(c), F.lit("")), r",\s*([A-Z][a-z]?)\s*$", 1)
    return F.when(symbol != "", symbol)


def uninformative_tag(c: Column | str) -> Column:
    """The code of a heading like "C10 (%T)" that is too short to be matched by name; null where it is not."""
    code = F.regexp_extract(F.coalesce(text_column(c), F.lit("")), r"^\s*([A-Za-z][A-Za-z0-9]{0,5})\s*[-–]?\s*\([^)]{1,8}\)\s*$", 1)
    return F.when((code != "") & ((F.length(code) <= 2) | code.rlike(r"\d")) & tag_element(c).isNull(), code)


# --- aliases ------------------------------------------------------------------------------------------------------


def strip_total(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(text_column(c)), r"(?i)\s*,\s*total\s*$", ""), r"(?i)\s+total\s*$", ""))


def compact_key(c: Column | str) -> Column:
    """Lower-case letters and digits with single spaces between."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text_column(c), F.lit(""))), r"[^a-z0-9]+", " "))


_FIBER_KINDS = "total dietary|dietary fiber|neutral detergent|soluble|insoluble|aoac|idf|sdf|sdfp|sdfs|hmwdf|lmwdf|high molecular weight|low molecular weight|crude"
# The generic that a nutrient's name stands for, by the first rule that fits.
GENERIC_ALIASES: list[tuple[str, str | None, str]] = [
    (r"\btotal\b.*(,\s*|\s+)total\s*$|(,\s*|\s)total\s*$", r"(\s*,\s*total|\s+total)\s*$", ""),
    (r"\bvitamin\s*a\b.*\b(rae|re|iu|international units)\b", None, "Vitamin A"),
    (r"^vitamin c.*,", None, "Vitamin C"),
    (r"wax esters", None, "Wax esters"),
    (r"vitamin b-6.*(,|pyridox|\bn\d+\b|\+)", None, "Vitamin B-6"),
    (r"^fiber|dietary fiber", None, "Fiber, total dietary"),
    (r"^(total )?sugars$|^sugars, total|reducing sugars|^oligosaccharides$|total sugar alcohols|^sugar alcohols$", None, "Carbohydrate, by difference"),
    (r"^(cis|trans)-.*beta-carotene", None, "Carotene, beta"),
    (r"^(cis|trans)-.*lycopene", None, "Lycopene"),
    (r"^(cis|trans)-.*lutein.*zeaxanthin", None, "Lutein + zeaxanthin"),
    (r"\bvitamin\s*c\b", None, "Vitamin C"),
    (r",\s*(added|intrinsic)\s*$", r"\s*,\s*(added|intrinsic)\s*$", ""),
    (r"^adjusted ", r"^adjusted ", ""),
    (rf"\bfib(er|re)\b.*({_FIBER_KINDS})|({_FIBER_KINDS}).*\bfib(er|re)\b|^(dietary\s+)?fib(er|re)$", None, "Fiber, total dietary"),
    (r"nitrosamine", None, "Nitrosamine"),
    (r"^vitamin e.*label entry", None, "Vitamin E"),
    (r"\bvitamin\s*d\b.*\b(d2|d3)\b", None, "Vitamin D (D2 + D3)"),
    (r"25-hydroxycholecalciferol", None, "Vitamin D3 (cholecalciferol)"),
    (r"25-hydroxyergocalciferol", None, "Vitamin D2 (ergocalciferol)"),
    (r"lutein.*zeaxanthin", None, "Lutein + Zeaxanthin"),
    (r"^beta-glucans$", None, "Beta-glucan"),
    (r"^cis-", r"^cis-", ""),
]


def generic_alias(c: Column | str) -> Column:
    return first_rewrite(c, GENERIC_ALIASES)


# --- variants of queries ------------------------------------------------------------------------------------------

# Saturated fatty acids by their number of carbon atoms, and stems and endings of unsaturated ones.
SATURATED = {
    4: "butyric acid|butanoic acid", 5: "valeric acid|pentanoic acid", 6: "caproic acid|hexanoic acid", 7: "enanthic acid|heptanoic acid",
    8: "caprylic acid|octanoic acid", 9: "pelargonic acid|nonanoic acid", 10: "capric acid|decanoic acid", 11: "undecylic acid|undecanoic acid",
    12: "lauric acid|dodecanoic acid", 13: "tridecylic acid|tridecanoic acid", 14: "myristic acid|tetradecanoic acid", 15: "pentadecylic acid|pentadecanoic acid",
    16: "palmitic acid|hexadecanoic acid", 17: "margaric acid|heptadecanoic acid", 18: "stearic acid|octadecanoic acid", 19: "nonadecylic acid|nonadecanoic acid",
    20: "arachidic acid|eicosanoic acid", 21: "heneicosanoic acid", 22: "behenic acid|docosanoic acid", 23: "tricosanoic acid", 24: "lignoceric acid|tetracosanoic acid",
}
CHAINS = {10: "dec", 11: "undec", 12: "dodec", 13: "tridec", 14: "tetradec", 15: "pentadec", 16: "hexadec", 17: "heptadec", 18: "octadec", 19: "nonadec", 20: "eicos", 21: "heneicos", 22: "docos", 23: "tricos", 24: "tetracos"}
DOUBLE_BONDS = {1: "enoic", 2: "adienoic", 3: "atrienoic", 4: "atetraenoic", 5: "apentaenoic", 6: "ahexaenoic"}
NAMED_ACIDS = {"DHA": "docosahexaenoic acid", "EPA": "eicosapentaenoic acid", "DPA": "docosapentaenoic acid"}
_FATTY_ACID = r"(?i)^(SFA|MUFA|PUFA|TFA)\s+(\d{1,2}):(\d)(?:\s+n-(\d))?(?:\s*\(([^)]+)\))?(?:\s+([ct]))?$"
# Other names of a nutrient, by a text that its name holds ("=": that it is).
SYNONYMS = {
    "thiamin": ("thiamine", "thiamin", "vitamin b1", "aneurin"),
    "niacin": ("nicotinic acid", "nicotinamide", "vitamin b3", "vitamin pp"),
    "vitamin b3": ("niacin", "nicotinic acid", "nicotinamide", "vitamin pp"),
    "tetrahydrofolic acid": ("tetrahydrofolate",),
    "5-methyl tetrahydrofolate": ("5-methyltetrahydrofolate", "5-methyl-THF", "5-MTHF", "levomefolate"),
    "folate": ("folic acid", "pteroylglutamic acid", "tetrahydrofolate", "THF"),
    "choline": ("2-hydroxyethyl(trimethyl)azanium",),
    "ergocalciferol": ("vitamin d2", "ergocalciferol"),
    "vitamin d2": ("vitamin d2", "ergocalciferol"),
    "cholecalciferol": ("vitamin d3", "cholecalciferol"),
    "vitamin d3": ("vitamin d3", "cholecalciferol"),
    "tocopherol": ("vitamin e",),
    "tocotrienol": ("vitamin e",),
    "ferrulic acid": ("ferulic acid", "4-hydroxy-3-methoxycinnamic acid"),
    "p-coumaric": ("p-coumaric acid", "4-hydroxycinnamic acid", "para-coumaric acid"),
    "sodium chloride": ("sodium chloride", "nacl", "table salt", "salt"),
    "gallocatechin": ("gallocatechin", "(+)-gallocatechin", "gallo catechin", "gallo-catechin"),
    "=cellulose": ("cellulose microcrystalline", "cellulose, microcrystalline", "cellulose powder"),
    "=tyrosol": ("4-hydroxyphenethyl alcohol", "2-(4-hydroxyphenyl)ethanol", "4-hydroxyphenylethanol", "p-hydroxyphenethyl alcohol"),
    "=pentosan": ("pentosan polysaccharide", "pentose polymer", "xylan", "arabinoxylan"),
    "=epicatechin": ("(-)-epicatechin", "ec"),
    "=epigallocatechin": ("(-)-epigallocatechin", "egc"),
    "=daidzin": ("daidzein 7-o-glucoside", "daidzein-7-o-glucoside", "daidzein 7-glucoside"),
    "=genistin": ("genistein 7-o-glucoside", "genistein-7-o-glucoside", "genistein 7-glucoside"),
}


def _strings(*items: Column | str) -> Column:
    return F.array(*(F.lit(x) if isinstance(x, str) else x for x in items))


def _when(condition: Column, items: Column) -> Column:
    return F.when(condition, items).otherwise(F.array().cast("array<string>"))


def fatty_acid_names(c: Column | str) -> Column:
    """Names of a fatty acid in shorthand ("SFA 18:0", "PUFA 20:5 n-3 (EPA)", "MUFA 18:1 t"); none for other texts."""
    q = F.trim(F.coalesce(text_column(c), F.lit("")))
    group = lambda i: F.regexp_extract(q, _FATTY_ACID, i)
    carbons, bonds, ct = group(2).try_cast("int"), group(3).try_cast("int"), F.lower(group(6))
    table = lambda d: F.create_map(*(F.lit(x) for item in d.items() for x in item))
    base = F.concat(F.element_at(table(CHAINS), carbons), F.element_at(table(DOUBLE_BONDS), bonds), F.lit(" acid"))
    shorthand = q.rlike(_FATTY_ACID)
    return F.array_distinct(F.array_compact(F.concat(
        _when(shorthand & (F.upper(group(1)) == "SFA") & (bonds == 0) & carbons.isin(*SATURATED), F.split(F.element_at(table(SATURATED), carbons), r"\|")),
        _when(shorthand & base.isNotNull(), _strings(base, F.concat_ws(":", carbons, bonds))),
        _when(shorthand & base.isNotNull() & (ct == "c"), _strings(F.concat(F.lit("cis-"), base))),
        _when(shorthand & base.isNotNull() & (ct == "t"), _strings(F.concat(F.lit("trans-"), base))),
        _when(shorthand & (F.upper(group(1)) == "PUFA") & (carbons == 20) & (bonds == 4), _strings("arachidonic acid")),
        *(_when(shorthand & F.upper(group(5)).contains(tag), _strings(name, tag)) for tag, name in NAMED_ACIDS.items()),
    )))


def nutrient_variants(c: Column | str, synonyms: dict[str, Sequence[str]] = SYNONYMS) -> Column:
    """Distinct spellings and other names of a nutrient, to be looked up beside its own; the name itself is first."""
    q = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(text_column(c), F.lit("")), r"\s+", " "), r"[,.;:]+$", ""))
    low = F.lower(q)
    words = F.split(q, " ")
    last, head = F.lower(F.element_at(words, -1)), F.array_join(F.slice(words, 1, F.size(words) - 1), " ")
    greek = (F.size(words) >= 2) & last.isin(*GREEK.values())
    plain = F.translate(q, "’′", "''")
    out = F.concat(
        _strings(q, F.replace(q, F.lit("-"), F.lit(" ")), F.replace(q, F.lit(" "), F.lit("-")), F.regexp_replace(q, r"^\(?\s*[+\-−]\s*\)?\s*-?\s*", "")),
        _when(q.rlike(r"\d\b"), _strings(F.regexp_replace(q, r"\d+\b", ""))),
        _when(plain.contains("'"), _strings(plain, F.replace(plain, F.lit("'"), F.lit("′")), F.replace(plain, F.lit("'"), F.lit(" prime ")), F.replace(plain, F.lit("'"), F.lit("")))),
        _when(low.rlike(r" from ."), _strings(F.regexp_extract(low, r"^(.*?) from ", 1), F.regexp_extract(low, r" from (.+)$", 1))),
        _when(low.rlike(r"^vitamin \S+ \S"), _strings(F.regexp_extract(q, r"^(\S+ \S+) ", 1), F.regexp_extract(q, r"^\S+ \S+ (.*)$", 1))),
        _when(greek, _strings(F.concat_ws(" ", last, head), F.concat_ws("-", last, F.replace(head, F.lit(" "), F.lit("-"))))),
        _when(low.rlike(r"\bergost(a)?[-\s].*dienol\b"), _strings(F.regexp_replace(low, r"dienol\b", "dien-3-ol"), F.regexp_replace(low, r"dienol\b", "dien-3beta-ol"))),
        _when(low.rlike(r"\bergost(a)?[-\s].*\d,\d"), _strings(F.regexp_replace(low, r"(\d),(\d)", "$1 $2"), F.regexp_replace(low, r"(\d),(\d)", "$1-$2"))),
        _when(low.contains("phosphotidyl"), _strings(F.replace(low, F.lit("phosphotidyl"), F.lit("phosphatidyl")))),
        _when(low.rlike(r"^p[-\s]"), _strings(F.regexp_replace(low, r"^p[-\s]+", "para "), F.regexp_replace(low, r"^p[-\s]+", "4-"))),
        _when(low.rlike(r"s$") & (F.length(low) > 4), _strings(F.regexp_replace(low, "s$", ""))),
        *(_when(low == key[1:] if key.startswith("=") else F.contains(low, F.lit(key)), _strings(*names)) for key, names in synonyms.items()),
        fatty_acid_names(q),
    )
    tidy = F.transform(out, lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))
    return F.array_distinct(F.filter(tidy, lambda x: x != ""))


def substrate_variants(c: Column | str) -> Column:
    """Distinct spellings of a substrate in the order in which they are tried; the name itself is first."""
    s = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(text_column(c), F.lit("")), r"[\x00-\x1f\x7f]", " "), r"\s+", " "))
    cut = lambda pattern, new="": F.regexp_replace(s, pattern, new)
    position = F.regexp_extract(s, r"(?i)\b([234])[-\s]?(fluoro|chloro|bromo|iodo)\s*benzaldehyde\b", 1)
    halogen = F.concat(F.lower(F.regexp_extract(s, r"(?i)\b([234])[-\s]?(fluoro|chloro|bromo|iodo)\s*benzaldehyde\b", 2)), F.lit("benzaldehyde"))
    short = F.element_at(F.create_map(*map(F.lit, ("2", "o", "3", "m", "4", "p"))), position)
    long = F.element_at(F.create_map(*map(F.lit, ("2", "ortho", "3", "meta", "4", "para"))), position)
    out = F.concat(
        _strings(
            s, cut(r"\s*\[[^\]]+\]\s*", " "), cut(r"(?i)\s*[(\[]\s*[a-z0-9_+\-\s]+\s*[)\]]\s*$"), cut(r"^\(\s*\d+\s*\)\s*"), cut(r"^\d+\s+"),
            F.replace(F.replace(s, F.lit("(+)"), F.lit("+")), F.lit("(-)"), F.lit("-")),
            cut(r"(?i)^\([rs]\)-"), cut(r"(?i)^[dlrse]-"), cut(r"(?i)\bp[-\s]?nitrophenyl\b", "p-nitrophenyl"), cut(r"(?i)\balpha[-\s]?naphthyl\b", "alpha-naphthyl"),
            squeeze(cut(r"\([^()]*\)|\[[^\[\]]*\]", " ")),
        ),
        _when(position != "", _strings(*(F.concat(p, F.lit(joint), halogen) for p in (short, long) for joint in "- "))),
        _when(s.rlike(r"(?i)\bmethyl[-\s]?1,4[-\s]?benzoquinone\b"), _strings("2-methyl-1,4-benzoquinone", "toluquinone", "tolquinone")),
        _when(s.rlike(r"(?i)\b2,5[-\s]?dimethyl[-\s]?(1,4[-\s]?)?benzoquinone\b"), _strings("2,5-dimethyl-1,4-benzoquinone", "2,5-dimethyl-4-benzoquinone")),
    )
    tidy = F.transform(out, lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))
    return F.array_distinct(F.filter(tidy, lambda x: x != ""))


def moieties(c: Column | str) -> Column:
    """What a bound substrate is made of: the acid of a thioester, a transfer RNA's load, a salt's cation, a redox pair's compound."""
    s = F.trim(F.coalesce(text_column(c), F.lit("")))
    bare = lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, r"\[[^\[\]]*\]|\([^()]*\)", " "), r"\s+", " "))
    thioester, carrier = s.rlike(r"(?i)\b(coa|coenzyme a)\b"), s.rlike(r"(?i)\btrna\b")
    salt = s.rlike(r"(?i)\bhexafluorophosphate\b")
    out = F.concat(
        _when(thioester, _strings(bare(F.regexp_replace(F.regexp_replace(s, r"(?i)\b(coa|coenzyme a)\b", " "), "[-–—]", " ")))),
        _when(carrier & ~bare(s).rlike(r"(?i)^(2'?[-\s]?phospho|phospho|ligated|trna)+$"), _strings(bare(s))),
        _when(salt, _strings(F.trim(F.regexp_replace(F.regexp_replace(s, r"(?i)\bhexafluorophosphate\b", " "), r"\s+", " ")), "ferrocenium", "ferricenium")),
        _strings(F.trim(F.regexp_replace(s, r"(?i)^(reduced|oxidized)\s+", ""))),
    )
    return F.array_distinct(F.filter(out, lambda x: (x != "") & (x != s)))


# --- stereochemistry ----------------------------------------------------------------------------------------------

_DESCRIPTOR = r"(?:^|[\s,(\[-])([DL]|d|l|\(\s*[RS]\s*\)|\(\s*[+-]\s*\)|\(\s*\+/-\s*\)|alpha|beta|α|β|cis|trans|\(\s*[EZ]\s*\)|erythro|threo|rac|meso|[RS](?=-))(?=-|\s|$)"


def configuration(c: Column | str) -> Column:
    """The stereo descriptors of a name, sorted."""
    found = F.regexp_extract_all(F.coalesce(text_column(c), F.lit("")), F.lit(_DESCRIPTOR), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(found, lambda x: F.lower(F.replace(x, F.lit(" "), F.lit(""))))))


def bare_skeleton(c: Column | str) -> Column:
    """What remains of a name without descriptors and marks."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text_column(c), F.lit(""))), _DESCRIPTOR, " "), r"[^a-z0-9]+", "")


def stereo_class(a: Column | str, b: Column | str) -> Column:
    """How a matched name differs from its query in configuration alone; null where it doesn't, or differs in more."""
    x, y = text_column(a), text_column(b)
    da, db = configuration(x), configuration(y)
    differ = (F.lower(x) != F.lower(y)) & (bare_skeleton(x) == bare_skeleton(y)) & (da != db)
    return F.when(differ, F.when(F.size(db) == 0, "generalized").when(F.size(da) == 0, "specialized").otherwise("mismatch"))


# --- codes, labels and columns ------------------------------------------------------------------------------------


def code_in(c: Column | str) -> Column:
    """The four-level code in a text or at the end of an address; null where there is none."""
    code = F.regexp_extract(F.coalesce(text_column(c), F.lit("")), r"(\d+\.\d+\.\d+\.\d+)", 1)
    return F.when(code != "", code)


def label_name(c: Column | str) -> Column:
    """The name in a label like "<number>_Genus_species"."""
    return F.replace(F.regexp_replace(text_column(c), r"^\d+_", ""), F.lit("_"), F.lit(" "))


def label_group(c: Column | str, groups: dict[str, str], exceptions: dict[str, str], default: str = "Other") -> Column:
    """A label's group: that of the first exception its name begins with, else of its first word."""
    name = label_name(c)
    out = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for item in groups.items() for x in item)), F.substring_index(name, " ", 1)), F.lit(default))
    for begin, group in reversed(exceptions.items()):
        out = F.when(name.startswith(begin), group).otherwise(out)
    return out


def column_base(c: Column | str) -> Column:
    """A heading before the unit in its last parentheses."""
    s = F.trim(text_column(c))
    return F.when(s.rlike(r"\(.*\)$"), F.trim(F.regexp_extract(s, r"^(.*)\(", 1))).otherwise(s)


def column_unit(c: Column | str) -> Column:
    """The unit in a heading's last parentheses; empty where there are none."""
    return F.trim(F.regexp_extract(F.trim(text_column(c)), r"^.*\(([^(]*)\)$", 1))


# Categories by a text that a normalised name holds, in the order in which they are asked.
CATEGORIES = [
    ("Beverages", "juice|coffee|tea|soft drink|soda|beverage|drink|water"),
    ("Alcoholic Beverages", "beer|wine|vodka|gin|rum|whisky|whiskey|liqueur"),
    ("Dairy and Egg Products", "milk|yogurt|yoghurt|cheese|cream|butter|whey|kefir|egg|omelet|omelette"),
    ("Sausages and Luncheon Meats", "beef|pork|ham|bacon|sausage|chicken|turkey|lamb|veal"),
    ("Finfish and Shellfish Products", "fish|salmon|tuna|sardine|prawn|shrimp|shellfish|oyster|mussel"),
    ("Legumes and Legume Products", "lentil|bean|chickpea|peas|legume|soy|tofu|tempeh"),
    ("Fruits and Fruit Juices", "apple|banana|pear|orange|grape|berry|mango|peach|plum|fruit"),
    ("Vegetables and Vegetable Products", "spinach|lettuce|broccoli|carrot|tomato|onion|garlic|vegetable|cabbage"),
    ("Cereal Grains and Pasta", "rice|oat|wheat|rye|barley|pasta|noodle|bread|flour|cereal|grain"),
    ("Nut and Seed Products", "almond|walnut|hazelnut|peanut|cashew|pistachio|flax|chia|seed|nuts"),
    ("Fats and Oils", "oil|canola|margarine|shortening|lard"),
    ("Baked Products", "cake|cookie|biscuit|pastry|pie|donut|doughnut|muffin"),
    ("Sweets", "chocolate|candy|sweet|syrup|honey|jam|jelly|ice cream"),
    ("Snacks", "chip|crisps|snack"),
]
NO_CATEGORY = "Meals, Entrees, and Side Dishes"


def category_of_name(c: Column | str) -> Column:
    s = F.trim(F.regexp_replace(F.lower(F.coalesce(text_column(c), F.lit(""))), r"[^a-z0-9]+", " "))
    return first_class(s, CATEGORIES, NO_CATEGORY)


#: Categories of descriptions that came without one, by whole words; the first that fits.
BACK_FILL = [
    ("Baby Foods", any_of(("infant", "baby food", "toddler"))),
    ("Fast Foods", any_of(("pizza", "burger", "hamburger", "fast food", "hot dog", "kebab"))),
    ("Alcoholic Beverages", any_of(("beer", "wine", "vodka", "gin", "rum", "whisk(e)?y", "liqueur", "cider", "sake", "champagne", "cocktail"))),
    ("Soups, Sauces, and Gravies", any_of(("soup", "sauce", "gravy", "broth", "bouillon", "stock cube", "pesto", "ketchup", "stew"))),
    ("Variety Meats and By-Products", any_of(("liver", "kidney", "heart", "tripe", "tongue", "brain", "offal", "sweetbread"))),
    ("Snacks", any_of(("crisps", "chips", "popcorn", "pretzel(s)?", "snack(s)?"))),
    ("Cereal Grains and Pasta", any_of(("pasta", "noodle(s)?", "spaghetti", "macaroni", "rice", "quinoa", "oat(s)?", "barley", "wheat", "rye", "millet", "flour", "bulgur", "couscous"))),
    ("Dairy and Egg Products", any_of(("milk", "yog(h)?urt", "cheese", "cream", "butter", "whey", "kefir", "egg(s)?"))),
    ("Legumes and Legume Products", any_of(("lentil(s)?", "bean(s)?", "chickpea(s)?", "pea(s)?", "soy(a)?", "tofu", "tempeh", "hummus", "falafel", "lupin", "meat alternative"))),
    ("Nut and Seed Products", any_of(("almond(s)?", "walnut(s)?", "hazelnut(s)?", "peanut(s)?", "cashew(s)?", "pistachio(s)?", "seed(s)?", "nut(s)?", "tahini"))),
    ("Sausages and Luncheon Meats", any_of(("sausage", "frankfurter", "salami", "luncheon meat", "bologna", "pate", "meatball(s)?"))),
    ("Beef Products", any_of(("beef", "veal"))),
    ("Pork Products", any_of(("pork", "ham", "bacon"))),
    ("Poultry Products", any_of(("chicken", "turkey", "duck", "goose", "poultry"))),
    ("Lamb, Veal, and Game Products", any_of(("lamb", "mutton", "goat", "horse meat", "hare", "rabbit", "venison", "deer"))),
    ("Finfish and Shellfish Products", any_of(("fish", "salmon", "tuna", "cod", "pike", "turbot", "flounder", "pangasius", "herring", "sardine(s)?", "shrimp(s)?", "prawn(s)?", "oyster(s)?", "mussel(s)?", "crab", "squid", "sushi", "sashimi"))),
    ("Fruits and Fruit Juices", any_of(("apple(s)?", "banana(s)?", "pear(s)?", "orange(s)?", "grape(s)?", "berry", "berries", "mango", "peach(es)?", "plum(s)?", "plantain(s)?", "fruit(s)?", "juice", "melon", "lemon"))),
    ("Vegetables and Vegetable Products", any_of(("carrot(s)?", "tomato(es)?", "onion(s)?", "potato(es)?", "cabbage", "spinach", "lettuce", "celeriac", "dandelion", "collard greens", "seaweed", "alga(e)?", "mushroom(s)?", "vegetable(s)?", "beet(s)?", "kale"))),
    ("Spices and Herbs", any_of(("pepper", "cinnamon", "cumin", "turmeric", "basil", "oregano", "thyme", "spice(s)?", "mustard", "vinegar", "salt"))),
    ("Baked Products", any_of(("bread", "cake", "cookie(s)?", "biscuit(s)?", "pastry", "pie", "muffin", "swiss roll", "gingerbread", "cracker(s)?"))),
    ("Sweets", any_of(("chocolate", "candy", "candybar", "sweet(s)?", "syrup", "honey", "jam", "jelly", "sugar", "ice cream", "sweetener"))),
    ("Beverages", any_of(("water", "tea", "coffee", "drink", "beverage", "soda", "lemonade"))),
    ("Fats and Oils", any_of(("oil", "margarine", "lard", "shortening", "tallow", "fat"))),
    ("Meals, Entrees, and Side Dishes", any_of(("lasagn(a|e)", "meal", "entree", "dish", "casserole", "salad", "sandwich"))),
    ("Dietary Supplements", any_of(("supplement", "capsule(s)?", "tablet(s)?"))),
]


def back_filled_category(category: Column | str, description: Column | str) -> Column:
    """The category where there is one, else that of the description's words."""
    own = F.trim(text_column(category))
    return F.coalesce(F.when(own != "", own), first_class(description, BACK_FILL))


# --- organisms ----------------------------------------------------------------------------------------------------

# The genus that an initial stands for.
GENUS_INITIALS = {"e.": "escherichia", "b.": "bacillus", "p.": "pseudomonas", "s.": "staphylococcus", "l.": "lactobacillus", "c.": "clostridium"}


@F.pandas_udf(T.StringType())
def folded(names: pd.Series) -> pd.Series:
    """Compatibility form and case folding, which Spark has no function for; apply it to distinct names."""
    import unicodedata

    return names.map(lambda s: None if s is None else unicodedata.normalize("NFKC", s).strip().casefold())


def organism_key(c: Column | str) -> Column:
    """An organism's name as letters and digits with single spaces, initials of known genera written out."""
    s = F.translate(folded(text_column(c)), "_-", "  ")
    words = F.split(F.trim(F.regexp_replace(s, r"\s+", " ")), " ")
    genus = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for item in GENUS_INITIALS.items() for x in item)), words[0]), words[0])
    full = F.when(F.size(words) >= 2, F.concat_ws(" ", genus, F.array_join(F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(1))), " "))).otherwise(s)
    return F.trim(F.regexp_replace(F.regexp_replace(full, r"[^0-9a-z\s]+", " "), r"\s+", " "))


def organism_query_kind(c: Column | str) -> Column:
    """What a query asks for: a strain by itself ("strain: x"), a strain of a species, a species, a genus, or nothing."""
    q = F.trim(F.coalesce(text_column(c), F.lit("")))
    words = F.size(F.filter(F.split(organism_key(q), " "), lambda w: w != ""))
    return F.when(q == "", "none").when(q.rlike(r"(?i)^strain\s*[:=]\s*\S"), "strain").when(words >= 3, "species_strain").when(words == 2, "species").when(words == 1, "genus").otherwise("none")
