"""Generic nutrients and their specific ones, by families of rules over a catalogue."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.rules import AMINO_ACIDS, SIMPLE_SUGARS, any_of, compact_key, generic_alias
from tessera.operators.cohort import numbered


@dataclass(frozen=True)
class Family:
    """Generics whose alias (in lower case) matches, and what they expand to: names to be found or made, or existing ones by a pattern."""

    rule: str
    generic: str
    names: Sequence[str] = ()
    existing: str | None = None
    without: str | None = None  # existing names that are none of it
    start: str | None = None  # the name that edges start at, where it isn't the generic itself
    start_rule: str | None = None


_AMINO_ACIDS = tuple(a.capitalize() for a in sorted(AMINO_ACIDS))
_VITAMERS = [tuple(f"{kind}, {form}" for form in ("alpha", "beta", "gamma", "delta")) for kind in ("Tocopherol", "Tocotrienol")]
_SUGARS = r"^(total sugars?|sugars?|reducing sugars|oligosaccharides|sugar alcohols|total sugar alcohols|other saccharides|carbohydrate, other)\b"
_COMPLEX = "starch amylose amylopectin pectin cellulose hemicellulose pentose pentoses pentosan glycogen arabinose xylose raffinose stachyose ribose mannose inulin triose tetrose verbascose".split()
_MINERALS = (
    "calcium iron magnesium phosphorus potassium sodium zinc copper selenium manganese iodine chlorine chromium cobalt fluoride molybdenum sulfur aluminum antimony "
    "arsenic barium beryllium boron bromine cadmium gold lead lithium mercury nickel rubidium silicon silver strontium tin titanium vanadium"
).split()
# Families in the order in which they are asked; a generic belongs to the first.
FAMILIES = [
    Family("other_carotenoids_to_components_existing", r"^other carotenoids$", existing=any_of("carotene lycopene lutein zeaxanthin cryptoxanthin phytoene phytofluene".split())),
    Family("folate_total_to_forms", r"^folate(, total)?$", ("Folic acid", "Folate, food", "5-methyl tetrahydrofolate (5-MTHF)", "Tetrahydrofolic acid (THF)", "10-Formyl folic acid (10HCOFA)", "5-Formyltetrahydrofolic acid (5-HCOH4", "Folate, free")),
    Family("phenolic_acids_total_to_components", r"^phenolic acids", ("Chlorogenic acid", "Caffeic acid", "p-Coumaric acid", "Ferulic acid", "Gallic acid", "Gentisic acid", "Vanillic acid", "Cinnamic acid", "Ellagic acid", "p-Hydroxy benzoic acid")),
    Family("tocopherols_total_to_isoforms", r"^(total )?tocopherols$", _VITAMERS[0]),
    Family("tocotrienols_total_to_isoforms", r"^(total )?tocotrienols$", _VITAMERS[1]),
    Family("tocopherols_tocotrienols_to_isoforms", r"^tocopherols and tocotrienols$", _VITAMERS[0] + _VITAMERS[1]),
    Family("polyphenols_total_to_components_existing", r"^polyphenols", existing=r"\b(phenolic|flavonoid|flavon|flavan|anthocyan|catechin|procyanidin|isoflavone|daidzein|genistein|glycitein|daidzin|genistin|glycitin|naringenin|quercetin|kaempferol|myricetin|apigenin|luteolin|theaflav|thearubigin|theogallin|tann|coumestrol|biochanin|formononetin)\b", without=r"(,.*\btotal\b|\btotal\b.*,)"),
    Family("vitamin_d_split", r"^vitamin d.*d2.*d3", ("Vitamin D2 (ergocalciferol)", "Vitamin D3 (cholecalciferol)")),
    Family("protein_to_amino_acids", r"^protein$", _AMINO_ACIDS),
    Family("fiber_to_specific_fibers", r"fiber", ("Cellulose", "Hemicellulose", "Pectin", "Beta-glucan", "Inulin", "Resistant starch"), start="Fiber, total dietary", start_rule="fiber_alias_to_fiber"),
    Family("nitrosamine_total_to_nitrosamine", r"nitrosamine", ("Nitrosamine",)),
    Family("carb_to_sugars", rf"carbohydrate|{_SUGARS}", existing=any_of([s for s in SIMPLE_SUGARS if s != "sugar"]), without=_SUGARS, start="Carbohydrate, by difference", start_rule="carb_alias"),
    Family("carb_to_complex_carbs", rf"carbohydrate|{_SUGARS}", existing=any_of(_COMPLEX), without=rf"{_SUGARS}|{any_of(SIMPLE_SUGARS)}", start="Carbohydrate, by difference", start_rule="carb_alias"),
    Family("fat_to_fatty_acids", r"^fats?$|lipid|total fat", existing=any_of("cholesterol glyceride triglyceride phospholipid glycolipid sterol phytosterol ergosterol stigmasterol campesterol omega dha epa retinol carotene lycopene lutein zeaxanthin phytoene phytofluene".split() + ["fatty acid"])),
    Family("organic_acids_to_specific_existing", r"organic acids?", existing=r"\bacid\b", without=r"\bfatty acids\b"),
    Family("fatty_acids_total_to_individual_existing", r"fatty acids.*total|total.*fatty acids", existing=r"\b(sfa|mufa|pufa|tfa)\b|\b\d{1,2}:\d\b", without="total"),
    Family("vitamin_e_to_vit_e_forms_existing", r"^vitamin e$", existing=r"\b(tocopherol|tocotrienol)\b"),
    Family("vitamin_a_to_vit_a_forms_existing", r"^vitamin a$", existing=r"\b(retinol|retinal|retinoic|carotene|cryptoxanthin)\b"),
    Family("lutein_zeaxanthin_split", r"lutein.*\+.*zeaxanthin", existing="^(lutein|zeaxanthin)$"),
    Family("amino_acids_to_components", r"^amino acids$", _AMINO_ACIDS),
    Family("aa_combo_split", r"cysteine.*methionine|methionine.*cysteine", ("Cysteine", "Methionine")),
    Family("aa_combo_split", r"phenylalanine.*tyrosine|tyrosine.*phenylalanine", ("Phenylalanine", "Tyrosine")),
    Family("nonstarch_polysaccharides_to_components", r"nonstarch polysaccharides", ("Cellulose", "Hemicellulose", "Pectin", "Beta-glucan", "Inulin")),
    Family("minerals_total_to_specific", r"^minerals$", existing=any_of(_MINERALS)),
    Family("vitamins_and_other_components_to_vitamin_parents", r"^vitamins and other components$", ("Vitamin A", "Vitamin C", "Vitamin D (D2 + D3)", "Vitamin E", "Vitamin K", "Vitamin B-6", "Vitamin B-12")),
    Family("proximates_to_macros", r"^proximates?$", ("Protein", "Total lipid (fat)", "Carbohydrate, by difference", "Ash", "Fiber, total dietary")),
    Family("glycerides_to_triglycerides", r"^glycerides$", ("Triglyceride", "Triglycerides")),
]
#: Entries that are no nutrients to be reached.
DISCARDED = ("energy", "water", "solids", "solids soluble")


def expand_catalogue(catalogue: DataFrame, families: Sequence[Family] = tuple(FAMILIES), discarded: Sequence[str] = DISCARDED) -> tuple[DataFrame, DataFrame]:
    """(edges, leaves) of a catalogue of id and name.

    edges has src, dst, dst_name, source ("existing" or "new") and rule.  A name that stands for another leads to
    that one alone; a generic expands by its first family (families with one pattern and start go together).  Names
    that the catalogue lacks get ids above its highest, in the order of the first generic that needs them.  leaves has
    id, name and the first parent of what nothing expands from and no family calls generic.
    """
    rows = catalogue.select(F.col("id").cast("long").alias("id"), "name").where("name is not null")
    rows = rows.withColumn("alias", generic_alias("name")).withColumn("low", F.lower(F.trim("alias"))).withColumn("key", compact_key("name"))
    rows = rows.where(~F.col("key").isin(*discarded))
    aliased = F.col("alias") != F.trim("name")
    fits = [F.col("low").rlike(f.generic) for f in families]
    first = F.coalesce(*(F.when(hit, F.lit(i)) for i, hit in enumerate(fits)))
    generics = rows.where(~aliased).withColumn("family", first).where("family is not null")
    # Families of one pattern and start are one: their edges go to different names.
    together = {i: [j for j, g in enumerate(families) if (g.generic, g.start) == (f.generic, f.start)] for i, f in enumerate(families)}
    members = F.element_at(F.create_map(*(x for i, js in together.items() for x in (F.lit(i), F.array(*map(F.lit, js))))), F.col("family"))
    generics = generics.select("id", "name", F.explode(members).alias("family"))

    spark = catalogue.sparkSession
    starts = spark.createDataFrame([(i, f.start, f.start_rule) for i, f in enumerate(families) if f.start] or [(-1, None, None)], "family int, start string, start_rule string")
    literal = spark.createDataFrame([(i, k, n, f.rule) for i, f in enumerate(families) for k, n in enumerate(f.names)], "family int, ord int, want string, rule string")
    started = generics.join(F.broadcast(starts), "family", "left")  # as many rows as families
    wants = started.join(F.broadcast(literal), "family").select("id", F.coalesce("start", "name").alias("from"), "want", "rule", (F.col("ord") + 1).alias("ord"))
    to_start = started.where("start is not null").select("id", F.col("name").alias("from"), F.col("start").alias("want"), F.col("start_rule").alias("rule"), F.lit(0).alias("ord"))
    to_alias = rows.where(aliased).select("id", F.col("name").alias("from"), F.col("alias").alias("want"), F.lit("alias_to_canonical").alias("rule"), F.lit(0).alias("ord"))
    wanted = wants.unionByName(to_start).unionByName(to_alias).distinct().withColumn("key", compact_key("want"))

    known = rows.groupBy("key").agg(F.min("id").alias("known"))
    lacking = wanted.join(known, "key", "left_anti").groupBy("key").agg(F.min(F.struct("id", "ord", "want")).alias("f"))
    order = numbered(lacking.select("f.id", "f.ord", "key"), "id", "ord", "key")
    top = rows.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    made = lacking.join(order.select("key", "number"), "key").crossJoin(F.broadcast(top)).select("key", (F.col("number") + F.col("top")).alias("known"), F.col("f.want").alias("made_name"))  # one row
    ids = known.select("key", "known", F.lit(None).cast("string").alias("made_name")).union(made)

    resolved = wanted.join(ids, "key").withColumn("_from", compact_key("from")).join(ids.select(F.col("key").alias("_from"), F.col("known").alias("from_id")), "_from")
    source = F.when(F.col("made_name").isNull(), "existing").otherwise("new")
    src = F.when(F.col("rule") == "alias_to_canonical", F.col("id")).when(F.col("ord") == 0, F.col("id")).when(F.col("from") != F.col("want"), F.col("from_id")).otherwise(F.col("id"))
    by_name = resolved.select(src.alias("src"), F.col("known").alias("dst"), F.coalesce("made_name", "want").alias("dst_name"), source.alias("source"), "rule")

    low = F.lower("name")
    kinds = [F.when(_existing(f, low), F.lit(i)) for i, f in enumerate(families) if f.existing]
    specific = rows.select(F.col("id").alias("dst"), F.col("name").alias("dst_name"), F.explode(F.array_compact(F.array(*kinds))).alias("family"))
    labels = spark.createDataFrame([(i, f.rule) for i, f in enumerate(families) if f.existing], "family int, rule string")
    start_ids = started.withColumn("_from", compact_key(F.coalesce("start", "name"))).join(ids.select(F.col("key").alias("_from"), F.col("known").alias("from_id")), "_from")
    by_pattern = start_ids.join(specific, "family").join(F.broadcast(labels), "family").where("dst <> id and dst <> from_id").select(F.when(F.col("start").isNull(), F.col("id")).otherwise(F.col("from_id")).alias("src"), "dst", "dst_name", F.lit("existing").alias("source"), "rule")

    edges = by_name.unionByName(by_pattern).where("src <> dst").distinct()
    everyone = rows.select("id", "name").union(made.select(F.col("known"), F.col("made_name")))
    parent = edges.groupBy(F.col("dst").alias("id")).agg(F.min_by("src", F.struct("src", "rule")).alias("parent"), F.min_by("rule", F.struct("src", "rule")).alias("rule"))
    out = everyone.join(edges.select(F.col("src").alias("id")).distinct(), "id", "left_anti").join(generics.select("id").distinct(), "id", "left_anti").join(parent, "id", "left")
    return edges, out


def _existing(family: Family, low: Column) -> Column:
    hit = low.rlike(family.existing)
    return hit & ~low.rlike(family.without) if family.without else hit


def resolved_rules(edges: DataFrame, dangerous: Sequence[str]) -> DataFrame:
    """Edges but those of rules that are not safe to substitute along."""
    return edges.where(~F.col("rule").isin(*dangerous))


def family_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy("rule").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("src").alias("generics"))
