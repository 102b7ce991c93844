import json

import pytest
from pyspark.sql import functions as F

from tessera.sources import connectors, readers, sinks, sniff
from tessera.streaming.registry import mint_stream


def test_readers(spark, tmp_path):
    (tmp_path / "a_ec.tsv").write_text("s\t1_Genus_species\tl1\tEC:1.1.1.1\n")
    panel = readers.headerless_tsv(spark, f"{tmp_path}/a_ec.tsv", "x string, species string, locus string, ec string", sample="sample")
    assert panel.first().sample == "a"
    assert readers.panel_columns(panel.select("x", "species", "locus", "ec")) == {"ec_number": "ec", "species": "species"}
    (tmp_path / "h.tsv").write_text("# note\nLocus_Tag\tproduct\nl1\tp\n")
    df = readers.headed_tsv(spark, f"{tmp_path}/h.tsv", comment="#")
    assert readers.pick(df, locus=("locus", "locus_tag")).first().locus == "l1"
    with pytest.raises(ValueError):
        readers.headed_tsv(spark, f"{tmp_path}/h.tsv", ["missing"], comment="#")
    (tmp_path / "ids").write_text("5\n6\n")
    assert readers.id_list(spark, f"{tmp_path}/ids", "nutrient_id").count() == 2


def test_ontology(spark, tmp_path):
    (tmp_path / "x.obo").write_text('format-version: 1.2\n\n[Term]\nid: C:1\nname: one\nalt_id: C:9\nis_a: C:2 ! two\nrelationship: is_tautomer_of C:3\nsynonym: "uno" EXACT []\nsubset: 3_STAR\n\n[Term]\nid: C:2\nname: two\n\n[Typedef]\nid: is_a\n')
    terms = readers.ontology(spark, f"{tmp_path}/x.obo")
    r = terms.where("id = 'C:1'").first()
    assert terms.count() == 2 and r.alt_ids == ["C:9"] and r.synonyms[0].scope == "EXACT" and r.subsets == ["3_STAR"]
    assert {tuple(x) for x in readers.ontology_relations(terms).collect()} == {("C:1", "C:2", "is_a"), ("C:1", "C:3", "is_tautomer_of")}


def test_json_and_groups(spark, tmp_path):
    (tmp_path / "b.json").write_text(json.dumps({"data": {"1.1.1.1": {"km": [{"value": "1 {ethanol}"}]}, "spontaneous": {"km": [{"value": "x"}]}}}))
    out = readers.keyed_json(spark, f"{tmp_path}/b.json", "data", ["km", "kcat"], ["spontaneous"])
    assert [tuple(r) for r in out.collect()] == [("1.1.1.1", "km", "1 {ethanol}")]
    g = spark.createDataFrame([("9.p,9.q,8.r", "K1|30.00;K2|5.0")], "m string, t string")
    assert sorted(tuple(r) for r in readers.grouped_members(g, "m", "t", 20).collect()) == [("8", "K1"), ("9", "K1")]


def test_sniff():
    assert sniff.detect("x.bin", b"PK\x03\x04..").kind == "xlsx"
    assert sniff.detect("x.txt", "a;b\n1;2\n".encode()) == sniff.FileKind("csv", "utf-8", ";")
    assert sniff.detect("x.csv", b"caf\xe9,1\n").encoding == "latin-1"
    assert sniff.header_row([["t"], [None, "Food Name"]], ["food name"]) == 1
    assert sniff.merged_header(["Fat", None, ""], ["g", "mg", ""]) == ["Fat / g", "Fat / mg", "Fat"]


def test_ingest(spark, tmp_path):
    sheet = spark.createDataFrame([("c1", "Apple", "1,5", "Tr"), ("c2", "Kopia av Apple", "2", "N")], ["Food Number", "Food Name", "Iron (mg)", "Zinc (mg)"])
    spec = connectors.SOURCES["swedish"]
    items = connectors.items_of(sheet, spec, spark.createDataFrame([], "code string, number long"))
    assert [r.description for r in items.collect()] == ["Apple [Livsmedelsverket]"]
    catalogue = spark.createDataFrame([(1, "Iron", "G"), (2, "Zinc", "MG")], "id long, name string, unit_name string")
    labels = connectors.long_cells(sheet, spec).select("label").distinct()
    out = connectors.facts_of(sheet, spec, items, connectors.analytes(labels, catalogue, spec))
    got = {r.nutrient_id: r.amount for r in out.collect()}
    assert got == {1: pytest.approx(0.0015), 2: 0.0}
    store = f"{tmp_path}/store"
    sinks.write_bucketed(out, store, "nutrient_id")
    assert readers.in_buckets(spark.read.parquet(store), "nutrient_id", [1]).count() == 1
    assert readers.partitioned_facts(spark, store).first().source_db == "base"
    with pytest.raises(ValueError):
        sinks.append_guarded(out.withColumn("more", F.lit(1)), store)


def test_cache_and_tsv(spark, tmp_path):
    made = []

    def build():
        made.append(1)
        return spark.range(3)

    for _ in range(2):
        assert sinks.cached(spark, f"{tmp_path}/c", "k", build).count() == 3
    assert len(made) == 1
    sinks.write_tsv(spark.createDataFrame([(2, "a\tb"), (1, None)], "i int, s string"), f"{tmp_path}/t", ["i"])
    assert [tuple(r) for r in spark.read.option("sep", "\t").option("header", True).csv(f"{tmp_path}/t").orderBy("i").collect()] == [("1", None), ("2", "a b")]


def test_mint_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"code": "x"}\n{"code": "x"}\n{"code": "y"}\n')
    for _ in range(2):
        stream = spark.readStream.schema("code string").json(f"{tmp_path}/in")
        mint_stream(stream, "code", "number", 100, f"{tmp_path}/reg", f"{tmp_path}/ckpt").awaitTermination(120)
        (tmp_path / "in" / "b.json").write_text('{"code": "y"}\n{"code": "a"}\n')
    assert {(r.code, r.number) for r in spark.read.parquet(f"{tmp_path}/reg").collect()} == {("x", 100), ("y", 101), ("a", 102)}


def test_older_exports_and_maps(spark, tmp_path):
    from tessera.sources import readers

    (tmp_path / "old.tsv").write_text("?ec\t?species\t?substrates\nhttp://x/1.2.3.4\tAa bb\turea; malate;\nnone\tAa bb\turea\n")
    assert sorted(map(tuple, readers.code_substrates(spark, str(tmp_path / "old.tsv")).collect())) == [("1.2.3.4", "Aa bb", "malate"), ("1.2.3.4", "Aa bb", "urea")]
    (tmp_path / "map.tsv").write_text("L1\tAa bb\nS1\tL1\tCc dd\n\n")
    mapped = readers.locus_species(spark, str(tmp_path / "map.tsv"))
    rows = spark.createDataFrame([("S1", "L1"), ("S2", "L1"), ("S2", "L2")], "sample string, locus string")
    got = readers.species_of_loci(rows, mapped, "sample", "locus")
    assert sorted(map(tuple, got.select("sample", "locus", "species").collect()), key=str) == [("S1", "L1", "Cc dd"), ("S2", "L1", "Aa bb"), ("S2", "L2", None)]


def test_reaction_files(spark, tmp_path):
    from tessera.operators.matching import participants
    from tessera.sources import readers

    (tmp_path / "rhea2ec.tsv").write_text("RHEA_ID\tID\n1\t1.1.1.1\n2\t1.1.1.-\n")
    (tmp_path / "rhea-reaction-smiles.tsv").write_text("1\tA.B>>C\n2\tA>>D\n")
    (tmp_path / "rhea-chebi-smiles.tsv").write_text("CHEBI:1\tA\nCHEBI:2\tC\nCHEBI:3\tD\n")
    got = participants(*readers.reaction_files(spark, str(tmp_path)))
    assert sorted(map(tuple, got.collect())) == [("1.1.1.1", "CHEBI:1"), ("1.1.1.1", "CHEBI:2")]


def test_any_table_and_results(spark, tmp_path):
    from tessera.sources import readers, sinks

    (tmp_path / "a.csv").write_text("x;y\n1;2\n")
    assert readers.any_table(spark, str(tmp_path / "a.csv")).columns == ["x", "y"]
    with pytest.raises(ValueError):
        readers.any_table(spark, "a.xlsx")
    df = spark.createDataFrame([("i", 1, "e", 0.5)], "item string, rank int, entity string, score double")
    with pytest.raises(ValueError):
        sinks.write_results(str(tmp_path / "out"), community=df)
    sinks.write_results(str(tmp_path / "out"), per_item=df, per_entity=df)
    assert spark.read.option("header", True).option("sep", "\t").csv(str(tmp_path / "out/per_entity")).columns == ["entity", "rank", "item", "score"]
    facts = spark.createDataFrame([(k, k * 1.0) for k in range(20)], "nutrient_id long, amount double")
    sinks.write_bucketed(facts, str(tmp_path / "store"), "nutrient_id", 4)
    assert sorted((r.bucket, r.n_rows) for r in sinks.manifest(spark, str(tmp_path / "store"), "bucket").collect()) == [(b, 5) for b in range(4)]


def test_later_rows_win(spark):
    from tessera.sources import readers

    df = spark.createDataFrame([(1, "c", "old", 1), (1, "c", "new", 2), (1, "d", "x", 3)], "nutrient_id int, entry string, name string, line int")
    assert sorted(map(tuple, readers.later_wins(df, "nutrient_id", "name", "line").collect())) == [(1, "c", "new"), (1, "d", "x")]


def cells(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_sheets_on_a_spine(spark):
    from tessera.sources import assemble

    spine = spark.createDataFrame([("1", "a", 1), ("1", "b", 2), ("2", "c", 3)], "code string, name string, row int")
    more = spark.createDataFrame([("1", "x", "5"), ("1#2", "y", "6")], "code string, name string, fat string")
    assert cells(assemble.numbered_sheets(spine, [more], "code", "row").select("code", "name", "fat")) == [("1#2", "b", "6"), ("1", "a", "5"), ("2", "c", None)]
    main = spark.createDataFrame([("1001", "a"), (None, "unit"), ("2001", "b")], "no string, name string")
    annex = spark.createDataFrame([("2001", "other"), ("3001", "c")], "no string, name string")
    acids = spark.createDataFrame([("1001", "9")], "no string, acid string")
    assert cells(assemble.spine_with_annex(main, annex, [acids], "no").select("no", "name", "acid", "category")) == [(1001, "a", "9", "1"), (2001, "b", None, "2"), (3001, "c", None, "3")]
    assert cells(assemble.units_of_row(spark.createDataFrame([(None, "g", None), ("1", "2", "3")], "id string, fat string, x string"), "id")) == [("fat", "g")]


def test_stacked_sheets(spark):
    from tessera.sources import assemble

    a = spark.createDataFrame([("1", "rice", None, "Oryza", "1"), (None, "descriptor", None, None, None)], "id string, en string, own string, sp string, fat string")
    b = spark.createDataFrame([("1", "rice again", None, None, "7"), ("2", "", "riz", None, "3")], "id string, en string, own string, sp string, ash string")
    assert cells(assemble.with_species([a, b], "id", ["en", "own"], "sp", ["en"]).select("id", "description")) == [("1", "rice [Oryza]"), ("2", "riz")]
    assert assemble.tidy_headers(spark.createDataFrame([(1, 2, 3)], "x int, `y\nz` int, w int").toDF("x", "y\nz", "x")).columns == ["x", "y z", "x__dup2"]


def test_analytes_and_long_sources(spark):
    from tessera.sources import assemble

    labels = spark.createDataFrame([("a", "Fat", "G"), ("b", "Fat", "KJ"), ("c", "Odd", "G"), ("d", "None", "G")], "label string, name string, source_unit string")
    catalogue = spark.createDataFrame([(1, "Fat", "KJ"), (2, "fat ", "G")], "id long, name string, unit_name string")
    assert cells(assemble.two_key_analytes(labels, catalogue, {"odd": 9})) == [("a", 2), ("b", 1), ("c", 9), ("d", None)]
    nitrogen = assemble.per_nitrogen(spark.createDataFrame([("Lysine (mg/gN)",), ("Lysine (mg)",)], "label string"))
    assert cells(nitrogen) == [("Lysine (mg)", "Lysine", "mg"), ("Lysine (mg/gN)", "Lysine per g n", "mg/gN")]
    amounts = spark.createDataFrame([(1, 7, "2"), (1, 8, "3"), (9, 7, "4")], "food int, nut int, v string")
    got = assemble.related_cells(amounts, spark.createDataFrame([(1,)], "food int"), spark.createDataFrame([(7, "fat")], "nut int, n string"), "food", "nut", "n", "v")
    assert cells(got) == [("1", "fat", "2")]
    means = spark.createDataFrame([("x", "c", "m1", 1.0), ("x", "c", "m1", 3.0), ("x", "c", "m2", 8.0), ("x", "c", "m2", None)], "key string, label string, method string, a double")
    assert cells(assemble.mean_of_means(means, "method", F.col("a"))) == [("x", "c", 5.0)]
    assert cells(assemble.synthetic_facts(spark, [(1, 2, 3)], {2: [5]})) == [(1, 2, 3.0, "synthetic"), (1, 5, 3.0, "synthetic")]
    assert cells(assemble.first_method(spark.createDataFrame([("", "2"), ("1", "2")], "a string, b string"), ["a", "b"], "p")) == [("1",), ("2",)]
    assert cells(assemble.digits_key(spark.createDataFrame([("01_172",), ("x",)], "code string"), "code")) == [("01172",)]


def test_layouts_and_parameters(spark, tmp_path, monkeypatch):
    from tessera.sources import readers, sinks

    (tmp_path / "new.tsv").write_text("tax\tec\tmore\n1\t1.1.1.1\tx\n")
    (tmp_path / "old.tsv").write_text("a\t1\t1.1.1.1\n")
    for name in ("new", "old"):
        assert cells(readers.either_layout(spark, str(tmp_path / f"{name}.tsv"), ["tax", "ec"], ["x", "tax", "ec"])) == [("1", "1.1.1.1")]
    with pytest.raises(ValueError):
        readers.either_layout(spark, str(tmp_path / "old.tsv"), ["tax", "ec"], ["tax", "ec"])
    (tmp_path / "big.tsv").write_text("a\tb\na\tb\na\t\n")
    assert cells(readers.unique_rows(spark, str(tmp_path / "big.tsv"), "x string, y string")) == [("a", "b")]
    (tmp_path / "p.yaml").write_text("# comment\npaths:\n  food: ./food.parquet\nweight: 0.5\nname: plain text\n")
    assert readers.parameters(str(tmp_path / "p.yaml")) == {"paths": {"food": str(tmp_path / "food.parquet")}, "weight": 0.5, "name": "plain text"}
    monkeypatch.setenv("SOME_FILE", str(tmp_path / "p.yaml"))
    assert readers.parameters(variable="SOME_FILE")["weight"] == 0.5
    with pytest.raises(ValueError):
        readers.parameters()
    (tmp_path / "lines.json").write_text('{"k1": {"f": [{"value": "a"}]}}\n{"k2": {"f": [{"value": "b"}]}}\n')
    assert cells(readers.keyed_json(spark, str(tmp_path / "lines.json"), "data", ["f"], ["k2"], lines=True)) == [("k1", "f", "a")]
    sinks.write_by_code(spark.createDataFrame([("1.1.1.10",), ("1.1.1.2",), ("1.1.1.-",)], "ec string").coalesce(1), str(tmp_path / "sorted"), "ec")
    assert [r.ec for r in spark.read.option("header", True).csv(str(tmp_path / "sorted")).coalesce(1).collect()] == ["1.1.1.2", "1.1.1.10", "1.1.1.-"]
    current = spark.createDataFrame([(1, "x")], "id int, name string")
    assert cells(sinks.append_catalogue(current, spark.createDataFrame([(1, "y"), (2, "long name")], "id int, name string"), "id", {"name": 4})) == [(1, "x"), (2, "long")]
