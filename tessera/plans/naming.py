"""Queries of names: tags, aliases, variants, classes, hits and their scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import rules, text
from tessera.operators import exports, linkage, matching
from tessera.plans.registry import Tables, query


def _cases(column: str, cases: list[str], sql: bool = False):
    """One of the texts by a number's remainder: as SQL for DuckDB, or a column."""
    body = " ".join(f"WHEN {k} THEN '{t.replace(chr(39), chr(39) * 2)}'" for k, t in enumerate(cases))
    return f"CASE {column} % {len(cases)} {body} END" if sql else F.expr(f"CASE {column} % {len(cases)} " + body.replace("\\", "\\\\").replace("''", "\\'") + " END")


_TAGS = ["CA(mg)", "cs (mcg)", "ID(ug)", "C10 (%T)", "PP-(mg)", "WAX(mg)", "Calcium, Ca", "Fluoride, F", "GABA(mg)", "Zinc"]


@query(f"""
WITH t AS (SELECT p_partkey, {_cases('p_partkey', _TAGS, True)} AS h FROM part),
x AS (SELECT *, upper(regexp_extract(h, '^\\s*([A-Za-z]{{1,3}})\\s*\\([^)]{{1,6}}\\)\\s*$', 1)) AS tag,
  regexp_extract(h, '^\\s*([A-Za-z][A-Za-z0-9]{{0,5}})\\s*[-–]?\\s*\\([^)]{{1,8}}\\)\\s*$', 1) AS code FROM t)
SELECT p_partkey, h AS heading, CASE tag WHEN 'CA' THEN 'Ca' WHEN 'CS' THEN 'Cs' WHEN 'ID' THEN 'I' END AS tag_element,
  nullif(regexp_extract(h, ',\\s*([A-Z][a-z]?)\\s*$', 1), '') AS name_element,
  CASE WHEN code <> '' AND (length(code) <= 2 OR regexp_matches(code, '[0-9]')) AND tag NOT IN ('CA', 'CS', 'ID') THEN code END AS uninformative FROM x""")
def element_tags(t: Tables) -> DataFrame:
    rows = t.part.select("p_partkey", _cases("p_partkey", _TAGS).alias("heading"))
    return rows.select("*", rules.tag_element("heading").alias("tag_element"), rules.name_element("heading").alias("name_element"), rules.uninformative_tag("heading").alias("uninformative"))


_ALIASED = {
    "Vitamin C, total ascorbic acid": "Vitamin C", "Phytosterols, total": "Phytosterols", "Vitamin A, RAE": "Vitamin A", "Fiber, soluble": "Fiber, total dietary",
    "Sugars, total": "Sugars", "cis-beta-Carotene": "Carotene, beta", "cis-Lutein/Zeaxanthin": "Lutein + zeaxanthin", "Sugars, added": "Sugars",
    "Adjusted Protein": "Protein", "Vitamin D (D2 + D3), International Units": "Vitamin D (D2 + D3)", "Oligosaccharides": "Carbohydrate, by difference", "Iron, Fe": "Iron, Fe",
}


@query(f"""
SELECT p_partkey, {_cases('p_partkey', list(_ALIASED), True)} AS name, {_cases('p_partkey', list(_ALIASED.values()), True)} AS alias FROM part""")
def generic_aliases(t: Tables) -> DataFrame:
    """The generic that each name stands for, by the first rule that fits."""
    rows = t.part.select("p_partkey", _cases("p_partkey", list(_ALIASED)).alias("name"))
    return rows.select("*", rules.generic_alias("name").alias("alias"))


_NAMES = ["Sucrose", "Water", "L-Lysine", "Energy (Atwater General Factors)", "Inulin", "Sugars, added sugar", "Zinc, Zn", "Glycine"]
_SUGARS, _ACIDS = "|".join(rules.SIMPLE_SUGARS), "|".join(rules.AMINO_ACIDS)


@query(f"""
WITH t AS (SELECT p_partkey, {_cases('p_partkey', _NAMES, True)} AS name FROM part),
f AS (SELECT *, regexp_matches(lower(name), '^(water|energy|energy \\(atwater.*|ash|solids|nitrogen|proximates)$') AS noise,
  regexp_matches(lower(name), '\\b({_SUGARS})\\b') AS sugar, regexp_matches(lower(name), '\\b({_ACIDS})\\b') AS acid FROM t)
SELECT p_partkey, name, NOT noise AND NOT sugar AND NOT acid AS strict, NOT noise AND NOT acid AS with_sugars, NOT noise AND NOT sugar AS with_acids FROM f""")
def strict_names(t: Tables) -> DataFrame:
    rows = t.part.select("p_partkey", _cases("p_partkey", _NAMES).alias("name"))
    strict = rules.strict_prebiotic
    return rows.select("*", strict("name").alias("strict"), strict("name", sugars=True).alias("with_sugars"), strict("name", amino_acids=True).alias("with_acids"))


_SUBSTRATES = ["NADP(+)", "D-Glucose", "[thioredoxin]", "(S)-Lactate (reduced)", "Pi", "ATP", "cellobiose (aqueous)", "acceptor"]


@query(f"""
WITH t AS (SELECT p_partkey, {_cases('p_partkey', _SUBSTRATES, True)} AS s FROM part),
n AS (SELECT *, lower(trim(regexp_replace(regexp_replace(s, '\\b([LD]-|\\([RS]\\)-|\\(z\\)-|\\(e\\)-)', '', 'gi'), '\\s*\\((ion|aqueous|solution|reduced|oxidized|re-face|si-face)\\)', '', 'gi'))) AS plain FROM t)
SELECT p_partkey, s AS substrate, plain, plain NOT IN ('nadp(+)', 'pi', 'atp', 'acceptor') AND length(plain) > 2 AND NOT regexp_matches(plain, '^\\[.*\\]$') AS kept FROM n""")
def specific_substrates(t: Tables) -> DataFrame:
    """Substrates without configurations and states, and whether they are specific."""
    rows = t.part.select("p_partkey", _cases("p_partkey", _SUBSTRATES).alias("substrate")).withColumn("plain", rules.plain_substrate("substrate"))
    return rows.withColumn("kept", rules.specific_substrate("plain"))


_UNMATCHED = {
    "ABTS reagent": "assay_reagent_no_chebi", "[4Fe-4S] cluster": "metal_cluster_no_chebi", "Ala-Gly-Ser": "peptide_no_chebi", "histone H3": "macromolecule_no_chebi",
    "p-nitrophenyl acetate": "assay_marker_no_chebi", "N-phospho-L-histidine": "protein_modification_no_chebi", "unknown thing": "no_match",
}


@query(f"SELECT p_partkey, {_cases('p_partkey', list(_UNMATCHED), True)} AS name, {_cases('p_partkey', list(_UNMATCHED.values()), True)} AS class FROM part")
def no_match_classes(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", _cases("p_partkey", list(_UNMATCHED)).alias("name")).withColumn("class", rules.no_match_class("name"))


_HEADINGS = ["Theobromine (mg)", "Food code", "F000123", "12.5", "Caffeine [mg]", "Energy (kcal)", "a b c d e f g h", "Quercetin §"]


@query(f"""
WITH t AS (SELECT p_partkey, p_brand, {_cases('p_partkey', _HEADINGS, True)} AS h FROM part),
c AS (SELECT *, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(h, '\\((mg|g|µg|mcg|ug|%|kcal|kj|g/100g|mg/100g).*?\\)', '', 'gi'), '\\[.*?\\]', '', 'g'), '§|µg|mg| g ', '', 'g'), '\\s+', ' ', 'g')) AS clean FROM t),
m AS (SELECT lower(clean) AS low, min(clean) AS name, string_agg(DISTINCT p_brand, ' | ' ORDER BY p_brand) AS sources FROM c
  WHERE length(clean) >= 3 AND NOT regexp_matches(clean, '^F[0-9]{{5,}}$') AND NOT regexp_matches(clean, '^[0-9.]+$') AND lower(clean) <> 'caffeine' GROUP BY 1)
SELECT 96000 + row_number() OVER (ORDER BY low) - 1 AS id, name, sources FROM m""")
def novel_headings(t: Tables) -> DataFrame:
    """Headings without units that no catalogue has, with their sources, numbered in order."""
    from tessera.operators.cohort import consolidated

    rows = t.part.select(_cases("p_partkey", _HEADINGS).alias("heading"), "p_brand")
    known = t.spark.createDataFrame([("Caffeine",)], "name string")
    return consolidated(rows, known, "heading", "p_brand", "name", 96_000)


_ACIDS_SHORT = ["SFA 18:0", "MUFA 18:1 t", "PUFA 20:4", "PUFA 20:5 n-3 (EPA)", "SFA 4:0", "Iron"]


@query(f"""
SELECT p_partkey, v.variant FROM part JOIN (VALUES
  (0, 'stearic acid'), (0, 'octadecanoic acid'), (1, 'octadecenoic acid'), (1, '18:1'), (1, 'trans-octadecenoic acid'),
  (2, 'eicosatetraenoic acid'), (2, '20:4'), (2, 'arachidonic acid'), (3, 'eicosapentaenoic acid'), (3, '20:5'), (3, 'EPA'),
  (4, 'butyric acid'), (4, 'butanoic acid')) v(k, variant) ON p_partkey % {len(_ACIDS_SHORT)} = k""")
def fatty_acid_variants(t: Tables) -> DataFrame:
    names = t.part.select("p_partkey", _cases("p_partkey", _ACIDS_SHORT).alias("name"))
    return names.select("p_partkey", F.explode(rules.fatty_acid_names("name")).alias("variant"))


@query("""
WITH n AS (SELECT p_partkey, replace(p_name, ' ', '-') || 's from ' || lower(p_type) AS name FROM part),
v AS (SELECT p_partkey, unnest([name, replace(name, '-', ' '), replace(name, ' ', '-'), split_part(name, ' from ', 1), split_part(name, ' from ', 2), CASE WHEN name LIKE '%s' AND length(name) > 4 THEN substr(name, 1, length(name) - 1) END]) AS variant FROM n)
SELECT DISTINCT p_partkey, variant FROM v WHERE variant IS NOT NULL""")
def query_variants(t: Tables) -> DataFrame:
    """Spellings of composed names: joints, sources and bases apart, without a plural's ending."""
    names = t.part.select("p_partkey", F.concat(F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("s from "), F.lower("p_type")).alias("name"))
    return names.select("p_partkey", F.explode(rules.nutrient_variants("name", {})).alias("variant"))


_BOUND = {"acetyl-CoA": "acetyl", "L-seryl-tRNA(Ser)": "L-seryl-tRNA", "reduced ferredoxin": "ferredoxin", "butanoyl-coenzyme A": "butanoyl", "oxidized rubredoxin": "rubredoxin"}


@query(f"SELECT p_partkey, {_cases('p_partkey', list(_BOUND), True)} AS substrate, {_cases('p_partkey', list(_BOUND.values()), True)} AS moiety FROM part")
def bound_moieties(t: Tables) -> DataFrame:
    rows = t.part.select("p_partkey", _cases("p_partkey", list(_BOUND)).alias("substrate"))
    return rows.select("*", F.explode(rules.moieties("substrate")).alias("moiety"))


_SPELLED = ["(R)-lactate", "3 glucose", "2-chloro benzaldehyde", "D-xylose", "methyl-1,4-benzoquinone"]
_SPELLINGS = [(0, "lactate"), (1, "glucose"), (2, "o-chlorobenzaldehyde"), (2, "ortho chlorobenzaldehyde"), (3, "xylose"), (4, "toluquinone")]


@query("SELECT p_partkey, v.variant FROM part JOIN (VALUES " + ", ".join(f"({k}, '{v}')" for k, v in _SPELLINGS) + f") v(k, variant) ON p_partkey % {len(_SPELLED)} = k")
def substrate_spellings(t: Tables) -> DataFrame:
    """The variants of substrates that name another entry."""
    entries = t.spark.createDataFrame([(v,) for _, v in _SPELLINGS], "variant string")
    rows = t.part.select("p_partkey", F.explode(rules.substrate_variants(_cases("p_partkey", _SPELLED))).alias("variant"))
    return rows.join(entries, "variant", "left_semi").select("p_partkey", "variant")


_PAIRS = [("D-glucose", "L-glucose", "mismatch"), ("alpha-D-glucose", "glucose", "generalized"), ("lactate", "L-lactate", "specialized"), ("xylose", "ribose", None), ("glycine", "Glycine", None)]


@query("SELECT count(*) AS matched, " + ", ".join(f"count(*) FILTER (WHERE p_partkey % 5 = {k}) AS {n}" for n, k in (("generalized", 1), ("specialized", 2), ("mismatch", 0)))
       + ", count(*) FILTER (WHERE p_partkey % 5 = 0 AND p_size > 25) AS mismatch_in_model FROM part")
def stereo_carry_over(t: Tables) -> DataFrame:
    from tessera.operators.cohort import stereo_carry_over as carried

    kind = rules.stereo_class(_cases("p_partkey", [a for a, *_ in _PAIRS]), _cases("p_partkey", [b for _, b, _ in _PAIRS]))
    return carried(t.part, kind, F.col("p_size") > 25)


@query("""
SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN '1.2.3.4' WHEN 1 THEN '10.20.30.40' END AS code,
  'Genus' || (s_suppkey % 3) || ' species' AS name, CASE s_suppkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'Other' END AS grp,
  'Protein, crude' AS base, CASE s_suppkey % 2 WHEN 0 THEN 'g' ELSE '' END AS unit FROM supplier""")
def codes_and_labels(t: Tables) -> DataFrame:
    """Codes in texts, names and groups of labels, bases and units of headings."""
    code = F.expr("CASE s_suppkey % 4 WHEN 0 THEN 'http://x/ec/1.2.3.4' WHEN 1 THEN 'EC 10.20.30.40' WHEN 2 THEN '1.2.3' END")
    label = F.concat(F.col("s_suppkey"), F.lit("_Genus"), F.col("s_suppkey") % 3, F.lit("_species"))
    heading = F.when(F.col("s_suppkey") % 2 == 0, "Protein, crude (g)").otherwise("Protein, crude")
    rows = t.supplier.select("s_suppkey", code.alias("c"), label.alias("l"), heading.alias("h"))
    group = rules.label_group("l", {"Genus0": "A", "Genus1": "X"}, {"Genus1 species": "B"})
    return rows.select("s_suppkey", rules.code_in("c").alias("code"), rules.label_name("l").alias("name"), group.alias("grp"), rules.column_base("h").alias("base"), rules.column_unit("h").alias("unit"))


_FOODS = [("Apple juice", "Beverages", "Fruits and Fruit Juices"), ("Red wine", "Alcoholic Beverages", "Alcoholic Beverages"), ("Pasta", "Cereal Grains and Pasta", "Cereal Grains and Pasta"), ("Infant formula", "Meals, Entrees, and Side Dishes", "Baby Foods"), ("Plantains, green", "Meals, Entrees, and Side Dishes", "Fruits and Fruit Juices"), ("Soup, minestrone", "Meals, Entrees, and Side Dishes", "Soups, Sauces, and Gravies")]


@query(f"""
SELECT p_partkey, {_cases('p_partkey', [f[0] for f in _FOODS], True)} AS food, {_cases('p_partkey', [f[1] for f in _FOODS], True)} AS by_name,
  CASE WHEN p_size > 40 THEN 'Own' ELSE {_cases('p_partkey', [f[2] for f in _FOODS], True)} END AS filled,
  CASE WHEN p_size > 40 THEN 'Own' WHEN p_size % 2 = 0 THEN 'Dairy' ELSE 'text ' || p_size END AS resolved FROM part""")
def food_categories(t: Tables) -> DataFrame:
    """Categories by name, filled in where there is none, and resolved from codes."""
    own = F.when(F.col("p_size") > 40, "Own")
    code = F.when(F.col("p_size") % 2 == 0, "1").otherwise(F.concat(F.lit("text "), "p_size"))
    rows = t.part.select("p_partkey", _cases("p_partkey", [f[0] for f in _FOODS]).alias("food"), own.alias("own"), code.alias("code"))
    return rows.select("p_partkey", "food", rules.category_of_name("food").alias("by_name"), rules.back_filled_category("own", "food").alias("filled"), exports.resolved_category("own", "code", {"1": "Dairy"}).alias("resolved"))


_HITS = [  # query, view, label, term, scope, score by hand
    ("copper", "exact_norm", "copper atom", "copper", "name", 40 + 10 + 30 + 40),
    ("copper", "exact_norm", "copper", "copper", "name", 40 + 10 + 25 + 15),
    ("beta-carotene", "exact_norm", "alpha-carotene", "carotene", "EXACT", 40 + 7 - 80),
    ("beta-carotene", "exact_no_commas", "carotene", "carotene", "RELATED", 35 + 1 - 20),
    ("vitamin b12", "exact_compact", "B12", "cobalamin", "BROAD", 20 + 4 - 25 - 35),
    ("vitamin c", "exact_norm", "vitamin C", "vitamin c", "name", 40 + 10 + 25 + 25),
    ("5-methyl folate", "exact_norm", "folic acid", "folate", "EXACT", 40 + 7 - 25),
    ("cellulose", "exact_norm", "cellulose acetate", "cellulose acetate", "name", 40 + 10 + 0 - 0 - 80),
]


@query(f"""
SELECT p_partkey, {_cases('p_partkey', [h[0] for h in _HITS], True)} AS query, {_cases('p_partkey', [h[2] for h in _HITS], True)} AS label,
  CASE p_partkey % {len(_HITS)} """ + " ".join(f"WHEN {k} THEN {h[5]}" for k, h in enumerate(_HITS)) + " END AS score FROM part")
def name_hit_scores(t: Tables) -> DataFrame:
    """Additive scores of hits: views, scopes, Greek forms, folates, vitamins, elements, derivatives."""
    columns = [_cases("p_partkey", [h[i] for h in _HITS]).alias(n) for i, n in enumerate(("query", "view", "label", "term", "scope"))]
    rows = t.part.select("p_partkey", *columns).withColumn("q", text.squeeze("query")).withColumn("l", text.squeeze("label"))
    return rows.select("p_partkey", "query", "label", matching.name_hit_score("query", "q", "view", "label", "l", "term", "scope").alias("score"))


@query("""
WITH h AS (SELECT p_size AS query, p_brand AS entity, p_partkey, (p_partkey * 7) % 10 AS score,
  CASE p_partkey % 3 WHEN 0 THEN 'exact_norm' WHEN 1 THEN 'exact_no_paren' ELSE 'exact_compact' END AS view, CASE p_partkey % 3 WHEN 0 THEN 40 WHEN 1 THEN 30 ELSE 20 END AS w, p_name AS label FROM part),
r AS (SELECT *, row_number() OVER (PARTITION BY query, entity ORDER BY score DESC, w DESC, length(label), label DESC) AS k FROM h)
SELECT query, entity, score, view, label FROM r WHERE k = 1""")
def best_hit_per_entity(t: Tables) -> DataFrame:
    view = F.expr("CASE p_partkey % 3 WHEN 0 THEN 'exact_norm' WHEN 1 THEN 'exact_no_paren' ELSE 'exact_compact' END")
    hits = t.part.select(F.col("p_size").alias("query"), F.col("p_brand").alias("entity"), (F.col("p_partkey") * 7 % 10).alias("score"), view.alias("view"), F.col("p_name").alias("label"))
    return matching.best_per_entity(hits, "query", "entity", "score", "view", "label")


@query("""
WITH e AS (SELECT 'CHEBI:' || s_suppkey AS entity, CASE s_suppkey % 4 WHEN 0 THEN 'thing zwitterion' WHEN 1 THEN 'thing pyranose' ELSE 'thing ' || s_suppkey END AS name, s_suppkey FROM supplier),
h AS (SELECT o_orderkey AS row, o_custkey % 7 AS code, s_suppkey, e.entity, e.name, CASE o_orderkey % 3 WHEN 0 THEN 100 WHEN 1 THEN 90 ELSE 60 END AS base, s_suppkey % 2 = 0 AS prim,
  s_suppkey % 7 = o_custkey % 7 AS confirmed FROM orders JOIN e ON s_suppkey % 10 = o_orderkey % 10),
s AS (SELECT *, (CASE WHEN confirmed THEN greatest(base, 150) ELSE base END) - (CASE WHEN name LIKE '%zwitterion%' THEN 10 ELSE 0 END) - (CASE WHEN name LIKE '%pyranose%' THEN 5 ELSE 0 END) AS score FROM h),
r AS (SELECT *, row_number() OVER (PARTITION BY row ORDER BY score DESC, prim DESC, s_suppkey) AS k FROM s)
SELECT row, entity, name, CAST(score AS INTEGER) AS score, (CASE WHEN score >= 150 THEN 'rhea_confirmed' WHEN score >= 90 THEN 'string_match' ELSE 'fuzzy_match' END) || '(' || score || ')' AS match FROM r WHERE k = 1""")
def match_ladder(t: Tables) -> DataFrame:
    """The best entity of each row: kinds of match, lifted by reactions, less for odd forms."""
    name = F.expr("CASE s_suppkey % 4 WHEN 0 THEN 'thing zwitterion' WHEN 1 THEN 'thing pyranose' ELSE concat('thing ', s_suppkey) END")
    entities = t.supplier.select(F.concat(F.lit("CHEBI:"), "s_suppkey").alias("entity"), name.alias("name"), "s_suppkey", (F.col("s_suppkey") % 10).alias("block"))
    kind = F.expr("CASE o_orderkey % 3 WHEN 0 THEN 'name' WHEN 1 THEN 'synonym' ELSE 'fuzzy' END")
    rows = t.orders.select(F.col("o_orderkey").alias("row"), (F.col("o_custkey") % 7).alias("code"), F.lit("thing").alias("query"), kind.alias("kind"), (F.col("o_orderkey") % 10).alias("block"))
    candidates = entities.select("block", "entity", (F.col("s_suppkey") % 2 == 0).alias("primary"))
    confirmed = entities.select((F.col("s_suppkey") % 7).alias("code"), "entity")
    return matching.ladder_of_questions(rows, candidates, confirmed, entities, "block")


@query("""
WITH q AS (SELECT o_custkey AS code, o_orderkey AS reaction FROM orders), r AS (SELECT l_orderkey AS reaction, 'S' || (l_partkey % 50) AS structure FROM lineitem),
s AS (SELECT p_partkey AS entity, 'S' || p_size AS structure FROM part WHERE p_partkey < 100)
SELECT DISTINCT code, entity FROM q JOIN r USING (reaction) JOIN s USING (structure)""")
def reaction_participants(t: Tables) -> DataFrame:
    """Entities of the structures on either side of a code's reactions."""
    codes = t.orders.select(F.col("o_custkey").alias("code"), F.col("o_orderkey").alias("reaction"))
    sides = t.lineitem.groupBy(F.col("l_orderkey").alias("reaction")).agg(F.array_sort(F.collect_list(F.concat(F.lit("S"), F.col("l_partkey") % 50))).alias("s"))
    equations = sides.select("reaction", F.concat(F.array_join(F.slice("s", 1, 2), "."), F.lit(" >> "), F.array_join(F.slice("s", 3, 100), ".")).alias("equation"))
    structures = t.part.where("p_partkey < 100").select(F.col("p_partkey").alias("entity"), F.concat(F.lit("S"), "p_size").alias("structure"))
    return matching.participants(codes, equations, structures)


_ORGANISM_SQL = "SELECT s_suppkey AS id, 'genus' || (s_suppkey % 5) || ' species' || (s_suppkey % 3) AS sp, CASE WHEN s_suppkey % 4 = 0 THEN 'st ' || (s_suppkey % 40) ELSE '' END AS st FROM supplier"


@query(f"""
WITH r AS ({_ORGANISM_SQL}), one AS (SELECT st FROM r WHERE st <> '' GROUP BY st HAVING count(DISTINCT sp) = 1)
SELECT 'genus1' AS query, id FROM r WHERE sp LIKE 'genus1 %'
UNION ALL SELECT 'Genus2_Species1', id FROM r WHERE sp = 'genus2 species1'
UNION ALL SELECT 'strain: ST-8', id FROM r WHERE st = 'st 8' AND st IN (SELECT st FROM one)
UNION ALL SELECT 'genus0 species2 ST 20', id FROM r WHERE sp = 'genus0 species2' AND st = 'st 20'""")
def organism_queries(t: Tables) -> DataFrame:
    species = F.concat(F.lit("Genus"), F.col("s_suppkey") % 5, F.lit(" species"), F.col("s_suppkey") % 3)
    strain = F.when(F.col("s_suppkey") % 4 == 0, F.concat(F.lit("ST-"), F.col("s_suppkey") % 40))
    organisms = t.supplier.select(F.col("s_suppkey").alias("id"), species.alias("species"), strain.alias("strain"))
    asked = t.spark.createDataFrame([("genus1",), ("Genus2_Species1",), ("strain: ST-8",), ("genus0 species2 ST 20",), ("none such thing",), ("",)], "query string")
    return matching.organism_lookup(asked, organisms, "query", "id", "species", "strain")


@query("""
WITH n AS (SELECT n_nationkey AS id, lower(n_name) AS name FROM nation), q AS (SELECT s_suppkey AS row, s_nationkey AS code, 'nation_' || (s_nationkey) || 'x' AS key FROM supplier)
SELECT row, id AS entity, round(2.0 * length(name) / (length(name) + length(key)), 6) AS ratio FROM q JOIN n ON id = code""")
def gated_similarity(t: Tables) -> DataFrame:
    """The most similar name among a row's own code's alone."""
    queries = t.supplier.select(F.col("s_suppkey").alias("row"), F.col("s_nationkey").alias("code"), F.concat(F.lit("nation_"), "s_nationkey", F.lit("x")).alias("key"))
    pool = t.nation.select(F.col("n_nationkey").alias("code"), F.col("n_nationkey").alias("entity"), F.lower("n_name").alias("text"))
    return matching.gated_similarity(queries, pool).select("row", "entity", F.round("ratio", 6).alias("ratio"))


@query("""
WITH t AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'see chebi:' || p_size WHEN 1 THEN 'CHEBI:' || p_size WHEN 2 THEN 'NA' ELSE '' END AS raw, p_size FROM part)
SELECT p_partkey, CASE WHEN p_partkey % 4 < 2 THEN 'CHEBI:' || (CASE WHEN p_size % 5 = 0 THEN p_size + 1000 ELSE p_size END) END AS id FROM t""")
def canonical_ids(t: Tables) -> DataFrame:
    """Ids found anywhere in a text, through the alias table."""
    from tessera.operators.graph import canonical_ids as canonical

    raw = F.expr("CASE p_partkey % 4 WHEN 0 THEN concat('see chebi:', p_size) WHEN 1 THEN concat('CHEBI:', p_size) WHEN 2 THEN 'NA' ELSE '' END")
    aliases = t.part.where("p_size % 5 = 0").select(F.concat(F.lit("CHEBI:"), "p_size").alias("alias"), F.concat(F.lit("CHEBI:"), F.col("p_size") + 1000).alias("main")).distinct()
    return canonical(t.part.select("p_partkey", raw.alias("id")), "id", aliases)
