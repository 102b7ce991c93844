"""Views of names, and expansion of a catalogue, on examples of their own."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import views
from tessera.operators import expansion, linkage


def all_views(spark, make, text, **options):
    return spark.range(1).select(*(c.alias(k) for k, c in make(F.lit(text).cast("string"), **options).items())).first().asDict()


@pytest.mark.parametrize(
    ("text", "norm", "compact"),
    [
        ("γ-Terpinene (archived)", "gamma-terpinene", "gamma terpinene"), ("Rutin (L form)", "rutin (l form)", "rutin l form"), ("Sterols (plant)", "sterols", "sterols"), ("Zinc, Zn", "zinc", "zinc"),
        ("Total rutin equivalents", "rutin", "rutin"), ("rutin rutin", "rutin", "rutin rutin"), ("GOS / XOS", "galactooligosaccharide/xylooligosaccharide", "galactooligosaccharide xylooligosaccharide"),
        ("Starch, by difference", "starch", "starch"), ("1→4 link", "1->4 link", "1 4 link"), (None, "", ""),
    ],
)
def test_nutrient_views(spark, text, norm, compact):
    got = all_views(spark, views.nutrient_views, text)
    assert (got["norm"], got["compact"]) == (norm, compact)


def test_matching_views_differ(spark):
    assert all_views(spark, views.nutrient_views, "Salt, NaCl")["norm"] == "salt, nacl"
    assert all_views(spark, views.nutrient_views, "Salt, NaCl", rules=views.MATCHING)["norm"] == "salt"
    assert all_views(spark, views.nutrient_views, "XOS", rules=views.MATCHING)["norm"] == "xos"


def test_substrate_views(spark):
    got = all_views(spark, views.substrate_views, "β-Malate, Sodium salt (1) [x] dihydrate 5 mM")
    assert got == {"basic": "beta-malate, sodium salt (1) [x] dihydrate 5 mm", "no_commas": "beta-malate sodium salt (1) [x] dihydrate 5 mm", "no_paren": "beta-malate, sodium salt dihydrate 5 mm", "compact": "betamalatesodiumsalt1xdihydrate5mm", "salt": "beta-malate,"}


def test_expansion(spark):
    names = ["Polyphenols, total", "Quercetin", "Dietary fiber", "Fiber, total dietary", "Pectin", "Energy", "Glycerides"]
    edges, leaves = expansion.expand_catalogue(spark.createDataFrame([(i + 1, n) for i, n in enumerate(names)], "id int, name string"))
    got = {(r.src, r.dst_name, r.source, r.rule) for r in edges.collect()}
    assert (3, "Fiber, total dietary", "existing", "alias_to_canonical") in got and (4, "Pectin", "existing", "fiber_to_specific_fibers") in got and (4, "Inulin", "new", "fiber_to_specific_fibers") in got
    assert (7, "Triglyceride", "new", "glycerides_to_triglycerides") in got
    made = {r.dst for r in edges.collect() if r.source == "new"}
    assert min(made) == 8 and len(made) == max(made) - 7
    found = {r["name"] for r in leaves.collect()}
    assert {"Quercetin", "Pectin", "Inulin"} <= found and not {"Energy", "Dietary fiber", "Glycerides"} & found


def test_similarity_asks_again_with_words_in_order(spark):
    asked = spark.createDataFrame([(1, "acid malic"), (2, "zzz")], "q int, t string")
    names = spark.createDataFrame([(7, "malic acid"), (8, "acidic")], "i int, n string")
    assert [(r.query, r.id) for r in linkage.blocked_similarity(asked, names, "q", "t", "i", "n").collect()] == [(1, 7)]
