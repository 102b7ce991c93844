"""Rules over names, and matching, on examples of their own."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import rules
from tessera.operators import matching


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize(
    ("rule", "text", "want"),
    [
        (rules.is_element, "iron atom", True), (rules.is_element, "iron(3+)", True), (rules.is_element, "iron oxide", False), (rules.is_element, None, False),
        (rules.strict_prebiotic, "Pectin", True), (rules.strict_prebiotic, "ash", False), (rules.strict_prebiotic, "raw sugar", False), (rules.strict_prebiotic, "Serine", False), (rules.strict_prebiotic, None, True),
        (rules.plain_substrate, "L-malate  (ion) é", "malate"), (rules.specific_substrate, "nadh", False), (rules.specific_substrate, "[acp]", False), (rules.specific_substrate, "urea", True),
        (rules.ignored_query, "thio-NADP+ x", True), (rules.ignored_query, "urea", False),
        (rules.no_match_class, "beta-casein", "macromolecule_no_chebi"), (rules.no_match_class, "Gly-Gly-Ala", "peptide_no_chebi"), (rules.no_match_class, "", "no_match"),
        (rules.novel_term, "Rutin", True), (rules.novel_term, "Total ash", False), (rules.novel_term, "12", False), (rules.novel_term, "a b c d e f g", False),
        (rules.without_units, "Rutin (mg 100g) [x] §", "Rutin"), (rules.names_chemical, "F0001234", False), (rules.names_chemical, "Rutin", True), (rules.names_chemical, "1.5", False),
        (rules.tag_element, "FE(mg)", "Fe"), (rules.tag_element, "ID (ug)", "I"), (rules.tag_element, "XQ(mg)", None), (rules.name_element, "Iron, Fe", "Fe"), (rules.name_element, "Iron", None),
        (rules.uninformative_tag, "OA(g)", "OA"), (rules.uninformative_tag, "FE(mg)", None), (rules.uninformative_tag, "WAXY(g)", None),
        (rules.strip_total, "Sterols, total", "Sterols"), (rules.compact_key, "  Beta-Glucan (1,3) ", "beta glucan 1 3"), (rules.generic_alias, "cis-Retinol", "Retinol"), (rules.generic_alias, "Dietary fibre", "Fiber, total dietary"),
        (rules.code_in, "http://a/b/3.2.1.10", "3.2.1.10"), (rules.code_in, "3.2.1", None), (rules.label_name, "12_Aa_bb", "Aa bb"),
        (rules.column_base, "Fat (g)", "Fat"), (rules.column_unit, "Fat (g)", "g"), (rules.column_base, "Fat", "Fat"), (rules.column_unit, "Fat", ""),
        (rules.category_of_name, "Grilled trout fish", "Finfish and Shellfish Products"), (rules.category_of_name, None, rules.NO_CATEGORY),
    ],
)
def test_rules(spark, rule, text, want):
    assert one(spark, rule(F.lit(text).cast("string"))) == want


def test_moves_element(spark):
    for name, code, want in (("iron atom", "7.2.2.5", True), ("iron atom", "1.2.2.5", False), ("malate", "7.2.2.5", False), (None, None, False)):
        assert one(spark, rules.moves_element(F.lit(name).cast("string"), F.lit(code).cast("string"))) == want


def test_back_fill(spark):
    for own, description, want in ((None, "Sushi rolls", "Finfish and Shellfish Products"), ("Own", "Sushi", "Own"), (" ", "Infant cereal", "Baby Foods"), (None, "zzz", None)):
        assert one(spark, rules.back_filled_category(F.lit(own).cast("string"), F.lit(description))) == want


@pytest.mark.parametrize(
    ("name", "some"),
    [
        ("PUFA 22:6 n-3 (DHA)", {"docosahexaenoic acid", "22:6"}), ("MUFA 16:1 c", {"hexadecenoic acid", "cis-hexadecenoic acid"}), ("SFA 12:0", {"lauric acid", "dodecanoic acid"}),
        ("tocopherol gamma", {"gamma tocopherol", "vitamin e", "gamma-tocopherol"}), ("3'-methyl rutin", {"3′-methyl rutin", "3 prime -methyl rutin"}), ("vitamin k1 phylloquinone", {"vitamin k1", "phylloquinone"}),
        ("p-cresol", {"para cresol", "4-cresol"}), ("sterols", {"sterol"}), ("(+)-rutin", {"rutin"}), ("oil from seeds", {"oil", "seeds"}), ("ergosta-7,22-dienol", {"ergosta-7,22-dien-3-ol", "ergosta-7 22-dienol"}),
    ],
)
def test_nutrient_variants(spark, name, some):
    got = one(spark, rules.nutrient_variants(F.lit(name)))
    assert got[0] == name and some <= set(got) and len(set(got)) == len(got)


def test_no_variants_of_nothing(spark):
    assert one(spark, rules.nutrient_variants(F.lit(None).cast("string"))) == [] == one(spark, rules.substrate_variants(F.lit("  ")))
    assert one(spark, rules.moieties(F.lit("urea"))) == []


def test_substrate_variants(spark):
    got = one(spark, rules.substrate_variants(F.lit("4-iodo benzaldehyde [x]")))
    assert got[0] == "4-iodo benzaldehyde [x]" and {"4-iodo benzaldehyde", "p-iodobenzaldehyde", "para iodobenzaldehyde"} <= set(got)


@pytest.mark.parametrize(("a", "b", "want"), [("L-malate", "malate", "generalized"), ("malate", "L-malate", "specialized"), ("cis-olefin", "trans-olefin", "mismatch"), ("malate", "tartrate", None), ("L-malate", "l-malate", None)])
def test_stereo(spark, a, b, want):
    assert one(spark, rules.stereo_class(F.lit(a), F.lit(b))) == want


def test_organism_keys(spark):
    for text, key, kind in (("E. coli K-12", "escherichia coli k 12", "species_strain"), ("Aa_bb", "aa bb", "species"), ("ｂacillus", "bacillus", "genus"), ("strain: X", "strain x", "strain"), ("  ", "", "none")):
        assert (one(spark, rules.organism_key(F.lit(text))), one(spark, rules.organism_query_kind(F.lit(text)))) == (key, kind)


def test_organism_lookup(spark):
    organisms = spark.createDataFrame([(1, "Aa bb", "S1"), (2, "Aa bb", None), (3, "Aa cc sub", "S2"), (4, "Dd bb", "S2")], "id int, species string, strain string")
    for query, want in (("aa", [1, 2, 3]), ("Aa bb", [1, 2]), ("aa cc", [3]), ("strain=s1", [1]), ("strain: S2", []), ("Aa_cc sub", []), ("dd bb s2", [4]), ("zz", [])):
        found = matching.organism_lookup(spark.createDataFrame([(query,)], "q string"), organisms, "q", "id", "species", "strain")
        assert sorted(r.id for r in found.collect()) == want, query


def test_suggestions(spark):
    names = spark.createDataFrame([("bacillus rufus",), ("bacillus rubus",), ("citrobacter",)], "n string")
    found = matching.suggestions(spark.createDataFrame([("bacilus rufus",)], "q string"), names, "q", "n")
    assert [r["name"] for r in found.orderBy(F.desc("ratio")).collect()] == ["bacillus rufus", "bacillus rubus"]


def test_ladder_prefers_confirmed_then_primary_then_small_ids(spark):
    hits = [(1, "c", "q", "CHEBI:9", "fuzzy", False), (1, "c", "q", "CHEBI:5", "name", True), (2, "d", "q", "CHEBI:9", "name", False), (2, "d", "q", "CHEBI:5", "name", False), (3, "d", "q", "CHEBI:15377", "name", True)]
    df = spark.createDataFrame(hits, "row int, code string, query string, entity string, kind string, primary boolean")
    entities = spark.createDataFrame([("CHEBI:9", "a"), ("CHEBI:5", "b zwitterion"), ("CHEBI:15377", "water")], "entity string, name string")
    confirmed = spark.createDataFrame([("c", "CHEBI:9")], "code string, entity string")
    assert rows(matching.ladder_scores(df, confirmed, entities).select("row", "entity", "score", "match")) == [(1, "CHEBI:9", 150, "rhea_confirmed(150)"), (2, "CHEBI:9", 100, "string_match(100)")]


def test_ladder_of_questions(spark):
    rows_ = spark.createDataFrame([(1, 1, "x", "name", 0), (2, 1, "x", "name", 0), (3, None, "x", "fuzzy", 0), (4, 1, "x", "name", None), (5, 1, "x", "name", 9), (6, 1, "x", "fuzzy", 0), (6, 2, "x", "name", 1)], "row long, code long, query string, kind string, block long")
    candidates = spark.createDataFrame([(0, "CHEBI:9", True), (0, "CHEBI:3", False), (1, "CHEBI:3", True), (1, "CHEBI:8", True)], "block long, entity string, primary boolean")
    entities = spark.createDataFrame([("CHEBI:9", "x zwitterion"), ("CHEBI:3", "x"), ("CHEBI:8", "x")], "entity string, name string")
    confirmed = spark.createDataFrame([(1, "CHEBI:9")], "code long, entity string")
    got = matching.ladder_of_questions(rows_, candidates, confirmed, entities, "block")
    assert rows(got) == rows(matching.ladder_scores(rows_.join(candidates, "block"), confirmed, entities))
    assert len(rows(got)) == 4


def test_match_ladder_does_not_list_all_hits(spark, tmp_path):
    from tessera.plans import catalogue as plans

    spark.range(1, 20_001).select(F.col("id").alias("o_orderkey"), (F.col("id") % 500).alias("o_custkey")).write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(1, 101).select(F.col("id").alias("s_suppkey")).write.parquet(f"{tmp_path}/supplier.parquet")
    df = plans.QUERIES["match_ladder"](spark, str(tmp_path))
    assert len(df.collect()) == 20_000
    plans_, joined = [df._jdf.queryExecution().executedPlan()], []
    while plans_:
        p = plans_.pop()
        plans_ += [p.executedPlan()] if p.nodeName() == "AdaptiveSparkPlan" else [p.plan()] if "QueryStage" in p.nodeName() else [p.children().apply(i) for i in range(p.children().size())]
        if "Join" in p.nodeName():
            joined.append(p.metrics().apply("numOutputRows").value())
    assert joined and max(joined) <= 20_000
