import pytest
from pyspark.sql import functions as F

from tessera.functions import numbers, text


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("cell", "values"),
    [
        ("Tr", (None, 0, 0, 0, 0, 0.001, 0)),
        ("<0.1", (None, 0, 0.1, 0.1, 0, 0.1, 0)),
        ("1,5", (1.5, 1.5, 1.0, 15.0, 1.5, 15.0, 1.5)),
        ("N", (None, None, None, None, 0, None, None)),
        ("(1.2)", (None, None, 1.2, 1.2, 1.2, 1.2, None)),
        ("[71,10]", (None, None, 71, 7110, 71.1, 7110, None)),
        ("-", (None, None, None, None, 0, None, None)),
    ],
)
def test_messy_numbers(spark, cell, values):
    for policy, value in zip(("strict", "trace_zero", "limit_value", "thousands", "all_zero", "trace_small", "text_zero"), values, strict=True):
        got = one(spark, numbers.clean_number(F.lit(cell), policy))
        assert got == (None if value is None else pytest.approx(value)), policy


@pytest.mark.parametrize(("source", "target", "factor"), [("mg/100 g", "G", 0.001), ("µg", "MG", 0.001), ("(mg/gN)", "G", 1), ("kcal", "KJ", 1), ("mg", "MG", 1), ("mystery", "G", 1)])
def test_units(spark, source, target, factor):
    assert one(spark, numbers.unit_factor(F.lit(source), F.lit(target))) == pytest.approx(factor)


def test_bucket_of_null_is_that_of_minus_one(spark):
    assert one(spark, numbers.bucket_of(F.lit(None).cast("long"))) == 255


@pytest.mark.parametrize(("cost", "relation", "limit", "want"), [(0.0, "exact", 1.5, 100), (0.5, "conjugate_base_of", 1.5, 72), (0.75, "identity", 1.5, 55), (0.75, "scaffold", 1.5, 45), (1.0, "is_a", 1.5, 33), (0.25, "tautomer", 2.0, 92)])
def test_link_score(spark, cost, relation, limit, want):
    assert one(spark, numbers.link_score(F.lit(cost), F.lit(relation), limit)) == want


def test_codes(spark):
    assert one(spark, text.split_codes(F.lit("EC:2.7.2.3, 5.3.1.1;1.1.1.-"))) == ["2.7.2.3", "5.3.1.1"]
    assert one(spark, text.bracket_codes(F.lit("alcohol dehydrogenase [EC:1.1.1.284 1.1.1.1]"))) == ["1.1.1.284", "1.1.1.1"]
    assert one(spark, text.code_sort_key(F.lit("1.10.2.-"))) == [1, 10, 2, None]


def test_equation(spark):
    assert one(spark, text.equation_compounds(F.lit("2 NAD+ + A = B + NADH {r}"))) == ["NAD+", "A", "B", "NADH"]
    assert one(spark, text.equation_compounds(F.lit("more = ?"))) == []


@pytest.mark.parametrize(
    ("name", "want"),
    [
        ("Bacillus rufus K12", ("Bacillus", "Bacillus rufus", "K12")),
        ("Bacillus rufus subsp. minor str. 7B", ("Bacillus", "Bacillus rufus subsp. minor", "7B")),
        ("Bacillus aff. rufus f.sp. pisi XY-2", ("Bacillus", "Bacillus aff. rufus f.sp. pisi", "XY-2")),
        ("Bacillus sp. Var. longus", ("Bacillus", "Bacillus sp. Var. longus", None)),
        ("'Bacillus rufus' strain 'Old pond'", ("Bacillus", "Bacillus rufus", "'Old pond'")),
        ("Bacillus rufus 7B str. X", ("Bacillus", "Bacillus rufus", "7B str. X")),
        ("Bacillus", ("Bacillus", "Bacillus", None)),
        (None, (None, None, None)),
    ],
)
def test_organism(name, want):
    assert text.organism_parts(name) == want


def test_views(spark):
    views = text.name_views(F.lit("β-Carotene, (all trans)"))
    assert {k: one(spark, c) for k, c in views.items()} == {"norm": "beta-carotene, (all trans)", "no_commas": "beta-carotene (all trans)", "no_paren": "beta-carotene,", "compact": "beta carotene all trans"}


@pytest.mark.parametrize(
    ("description", "want"),
    [
        ("Turnips, chopped, frozen", "turnip"),
        ("Plums, dried, uncooked", "plum, dried"),
        ("Trout, dried, salted", "trout, dried, salted"),
        ("Rice, brown, raw", "rice, brown"),
        ("Pears, raw, with skin", "pear"),
        ("Oil, walnut", "walnut oil"),
        ("Pork, ground, 16% fat, raw", "pork, ground, 16% fat"),
        ("Minerals, Gouda cheese, sliced, store brand (NY) - NFY123ABC", "cheese, gouda"),
        ("Yogurt, plain, low fat [SRC]", "yoghurt, low-fat"),
        ("Mackerel; tinned in olive oil; drained", "mackerel, in olive oil"),
        ("Plum w/o skin", "plum, flesh"),
        ("Quark, 0.3 % fat", "quark, 0.3% fat"),
        ("Liver, calf, raw", "veal, liver"),
        ("Atlantic mackerel, smoked", "mackerel, atlantic, smoked"),
        ("Duck, breast, meat only, roasted", "duck, breast, flesh"),
        ("Spelt, flour", "spelt flour"),
        ("Cheese, cheddar, aged", "cheese, cheddar, mature"),
        ("Lentil, 'LB 7', raw", "lentil"),
        ("", None),
    ],
)
def test_canonical_names(description, want):
    from tessera.functions.canon import canonical_name

    assert canonical_name(description) == want
