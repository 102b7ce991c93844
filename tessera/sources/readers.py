"""Readers with explicit schemas; what has to be guessed is guessed from a few lines on the driver."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.text import FULL_CODE
from tessera.operators.facts import require_columns


def headed_tsv(spark: SparkSession, path: str, required: Sequence[str] = (), separator: str = "\t", comment: str | None = None) -> DataFrame:
    """A delimited table with a header, all columns as text; an error if a required column is missing."""
    reader = spark.read.option("sep", separator).option("header", True).option("quote", '"')
    if comment:
        reader = reader.option("comment", comment)
    return require_columns(reader.csv(path), required)


def pick(df: DataFrame, **aliases: Sequence[str]) -> DataFrame:
    """Columns under their first present alias, whatever the case: pick(df, locus=("locus_tag", "locus"))."""
    have = {c.lower(): c for c in df.columns}
    out = []
    for name, choices in aliases.items():
        found = next((have[a.lower()] for a in choices if a.lower() in have), None)
        if found is None:
            raise ValueError(f"none of {list(choices)} among {df.columns}")
        out.append(F.col(f"`{found}`").alias(name))
    return df.select(*out)


def headerless_tsv(spark: SparkSession, path: str, schema: T.StructType | str, sample: str | None = None, needed: Sequence[str] = ()) -> DataFrame:
    """A table without a header; with ``sample``, a column of the file's name without its ending.  Rows need the ``needed`` columns."""
    df = spark.read.option("sep", "\t").schema(schema).csv(path).na.drop("any", subset=[*needed] or None) if needed else spark.read.option("sep", "\t").schema(schema).csv(path)
    return df if sample is None else df.withColumn(sample, F.regexp_replace(F.col("_metadata.file_name"), r"(_ec)?\.[^.]+$", ""))


def id_list(spark: SparkSession, path: str, column: str) -> DataFrame:
    """Ids of a table with that column or of bare lines; an error if there are none."""
    first = spark.read.text(path).limit(1).collect()
    if not first:
        raise ValueError(f"{path} is empty")
    if column in first[0].value.split("\t"):
        df = headed_tsv(spark, path, [column]).select(column)
    else:
        df = spark.read.text(path).select(F.trim("value").alias(column)).where(F.col(column) != "")
    if df.isEmpty():
        raise ValueError(f"{path} has no ids")
    return df


def ontology(spark: SparkSession, path: str) -> DataFrame:
    """One row a term of an OBO file: id, name, alt_ids, is_a, relationships, synonyms and subsets."""
    raw = spark.read.option("lineSep", "\n\n").text(path).where(F.col("value").rlike(r"^\s*\[Term\]"))
    one = lambda tag: F.nullif(F.regexp_extract("value", rf"(?m)^{tag}: (.*)$", 1), F.lit(""))
    many = lambda pattern, group=1: F.regexp_extract_all("value", F.lit(f"(?m)^{pattern}"), F.lit(group))
    relations = F.transform(many(r"relationship: (\S+ \S+)"), lambda x: F.struct(F.split(x, " ")[0].alias("etype"), F.split(x, " ")[1].alias("dst")))
    synonyms = F.transform(many(r'synonym: ("(?:[^"\\]|\\.)*" \S+)'), lambda x: F.struct(F.regexp_extract(x, r'^"(.*)" ', 1).alias("text"), F.regexp_extract(x, r"(\S+)$", 1).alias("scope")))
    return raw.select(one("id").alias("id"), one("name").alias("name"), many(r"alt_id: (\S+)").alias("alt_ids"), many(r"is_a: (\S+)").alias("is_a"), relations.alias("relationships"), synonyms.alias("synonyms"), many(r"subset: (\S+)").alias("subsets"))


def ontology_relations(terms: DataFrame) -> DataFrame:
    """(src, dst, etype) of an ontology's terms."""
    parents = terms.select(F.col("id").alias("src"), F.explode("is_a").alias("dst"), F.lit("is_a").alias("etype"))
    others = terms.select(F.col("id").alias("src"), F.explode("relationships").alias("r")).select("src", "r.dst", "r.etype")
    return parents.union(others)


def keyed_json(spark: SparkSession, path: str, field: str, fields: Sequence[str], skip: Sequence[str] = (), lines: bool = False) -> DataFrame:
    """(key, field, value) of a JSON document whose ``field`` maps keys to lists of {"value": ...} under ``fields``.

    A document is one row of one task.  With ``lines`` each line is an object of keys by itself, so a large export that
    was split into lines is read by many.
    """
    entry = T.StructType([T.StructField(f, T.ArrayType(T.StructType([T.StructField("value", T.StringType())]))) for f in fields])
    schema = T.StructType([T.StructField(field, T.MapType(T.StringType(), entry))])
    raw = spark.read.text(path, wholetext=not lines)
    parsed = F.from_json("value", schema[field].dataType) if lines else F.from_json("value", schema)[field]
    doc = raw.select(F.explode(parsed).alias("key", "entry")).where(~F.col("key").isin(*skip) if skip else F.lit(True))
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"entry.{f}").alias("values")) for f in fields)))
    return doc.select("key", each.alias("e")).select("key", "e.field", F.explode("e.values").alias("v")).select("key", "field", "v.value")


def partitioned_facts(spark: SparkSession, path: str, default_source: str = "base") -> DataFrame:
    """A Hive-partitioned Parquet store, each row with its source from the file's name (Spark's own names: the default)."""
    df = spark.read.parquet(path)
    file = F.col("_metadata.file_name")
    return df.withColumn("source_db", F.when(file.startswith("part-"), F.lit(default_source)).otherwise(F.regexp_replace(file, r"(_\d+)?\.parquet$", "")))


def in_buckets(df: DataFrame, key: str, values: Sequence[int], buckets: int = 256) -> DataFrame:
    """Rows of the given keys, with the bucket predicate that lets Spark skip partitions."""
    return df.where(F.col("bucket").isin(*sorted({v % buckets for v in values})) & F.col(key).isin(*values))


def lineage_contains(df: DataFrame, lineage: str, taxon: str) -> DataFrame:
    """Rows whose comma-separated lineage holds the taxon exactly."""
    return df.where(F.array_contains(F.split(lineage, ","), taxon))


def grouped_members(groups: DataFrame, members: str, tokens: str, threshold: float = 0.0) -> DataFrame:
    """(member, item) pairs of orthologous groups: members "taxid.protein" and tokens "item|percent".

    A member and an item that share many groups pair once; tokens under the
    threshold, or without a percentage while one is set, are left out.
    """
    item = F.transform(F.split(tokens, ";"), lambda x: F.struct(F.split(x, r"\|")[0].alias("item"), F.try_element_at(F.split(x, r"\|"), F.lit(2)).try_cast("double").alias("pct")))
    kept = F.array_distinct(F.transform(F.filter(item, lambda x: (F.lit(threshold) <= 0) | (x["pct"] >= threshold)), lambda x: x["item"]))
    member = F.array_distinct(F.transform(F.split(members, ","), lambda x: F.substring_index(x, ".", 1)))
    rows = groups.select(member.alias("m"), kept.alias("k")).where("size(k) > 0")
    return rows.select(F.explode("m").alias("member"), "k").select("member", F.explode("k").alias("item")).where("item <> ''").distinct()


def panel_columns(df: DataFrame, sample_rows: int = 200) -> dict[str, str]:
    """Which columns of a headerless panel hold species and codes, by how many of the first cells look like them."""
    looks = {"ec_number": rf"^(EC:)?\s*{FULL_CODE[1:-1]}", "species": r"^(\d+_)?[A-Z][a-z]+[_ ][a-z]"}
    share: list[Column] = [F.avg(F.col(c).rlike(p).cast("int")).alias(f"{name}|{c}") for name, p in looks.items() for c in df.columns]
    row = df.limit(sample_rows).agg(*share).first().asDict()
    out = {}
    for name in looks:
        best = max(df.columns, key=lambda c: row[f"{name}|{c}"] or 0.0)
        if not row[f"{name}|{best}"]:
            raise ValueError(f"no column looks like {name}")
        out[name] = best
    return out


def ko_codes(spark: SparkSession, path: str) -> DataFrame:
    """(ko, ec_number, partial) of a list of identifiers and definitions with [EC:...] blocks."""
    from tessera.functions.text import bracket_codes

    rows = headerless_tsv(spark, path, "ko string, definition string").where(F.col("ko").rlike(r"^K\d{5}$"))
    each = rows.select("ko", F.explode(bracket_codes("definition")).alias("ec_number"))
    return each.withColumn("partial", F.when(F.col("ec_number").rlike(FULL_CODE), "no").otherwise("yes"))


def code_substrates(spark: SparkSession, path: str, unique: bool = True) -> DataFrame:
    """(code, species, substrate) of an older export, columns with or without "?", several substrates joined by ";"."""
    from tessera.functions.rules import code_in

    raw = headed_tsv(spark, path)
    rows = pick(raw, code=("?ec", "ec"), species=("?species", "species"), substrates=("?substrates", "substrates"))
    each = rows.select(code_in("code").alias("code"), F.trim("species").alias("species"), F.explode(F.split("substrates", ";")).alias("s"))
    out = each.select("code", "species", F.trim("s").alias("substrate")).where("code is not null and substrate <> ''")
    return out.distinct() if unique else out


def locus_species(spark: SparkSession, path: str) -> DataFrame:
    """(sample, locus, species) of a map with two columns or, with the sample first, three; sample is null in the former."""
    raw = spark.read.text(path).where("trim(value) <> ''").select(F.split("value", "\t").alias("c"))
    three = F.size("c") >= 3
    return raw.select(F.when(three, F.col("c")[0]).alias("sample"), F.when(three, F.get("c", F.lit(1))).otherwise(F.get("c", F.lit(0))).alias("locus"), F.when(three, F.get("c", F.lit(2))).otherwise(F.get("c", F.lit(1))).alias("species"))


def species_of_loci(rows: DataFrame, mapped: DataFrame, sample: str, locus: str) -> DataFrame:
    """rows with species: the sample's own entry for a locus, else the entry for all samples."""
    own = mapped.where("sample is not null").groupBy(F.col("sample").alias(sample), F.col("locus").alias(locus)).agg(F.min("species").alias("_own"))
    general = mapped.where("sample is null").groupBy(F.col("locus").alias(locus)).agg(F.min("species").alias("_general"))
    return rows.join(own, [sample, locus], "left").join(general, locus, "left").withColumn("species", F.coalesce("_own", "_general")).drop("_own", "_general")


def reaction_files(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(code, reaction), (reaction, equation) and (entity, structure) of the three files of a reaction database."""
    from tessera.functions.rules import code_in

    codes = pick(headed_tsv(spark, f"{path}/rhea2ec.tsv"), reaction=("RHEA_ID", "MASTER_ID"), code=("ID", "EC")).select(code_in("code").alias("code"), "reaction").where("code is not null and reaction is not null")
    reactions = headerless_tsv(spark, f"{path}/rhea-reaction-smiles.tsv", "reaction string, equation string").where("equation is not null")
    structures = headerless_tsv(spark, f"{path}/rhea-chebi-smiles.tsv", "entity string, structure string").where("structure is not null")
    return codes, reactions, structures


def any_table(spark: SparkSession, path: str, rows: int | None = None) -> DataFrame:
    """A delimited table by its ending; commas give way to semicolons where a comma finds one column.  rows is for a look only."""
    low = path.lower()
    if low.endswith((".tsv", ".txt", ".tab")):
        df = headed_tsv(spark, path)
    elif low.endswith(".csv"):
        df = headed_tsv(spark, path, separator=",")
        if len(df.columns) == 1:
            df = headed_tsv(spark, path, separator=";")
    else:
        raise ValueError(f"{path}: only delimited tables are read")
    return df if rows is None else df.limit(rows)


def later_wins(rows: DataFrame, key: str, name: str, line: str) -> DataFrame:
    """(key, names): of names under one key and entry the later row's stays; line is the row's place in its file."""
    return rows.groupBy(key, "entry").agg(F.max_by(name, line).alias(name))


def unique_rows(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Distinct whole rows of a large table without a header, or of the Parquet twin beside it where there is one."""
    twin = spark._jvm.org.apache.hadoop.fs.Path(path + ".parquet")
    if twin.getFileSystem(spark._jsc.hadoopConfiguration()).exists(twin):
        return spark.read.parquet(path + ".parquet").na.drop("any").dropDuplicates()
    return headerless_tsv(spark, path, schema).na.drop("any").dropDuplicates()


def either_layout(spark: SparkSession, path: str, columns: Sequence[str], headerless: Sequence[str]) -> DataFrame:
    """The columns of a table that has them in its header, or of an older one without a header whose columns are ``headerless``."""
    first = spark.read.text(path).limit(1).collect()
    head = first[0].value.split("\t") if first else []
    if all(c in head for c in columns):
        return headed_tsv(spark, path, columns).select(*columns)
    if len(head) != len(headerless):
        raise ValueError(f"{path} has {len(head)} columns, not {list(headerless)}")
    return headerless_tsv(spark, path, ", ".join(f"{c} string" for c in headerless)).select(*columns)


def complete_codes(df: DataFrame, partial: str = "partial") -> DataFrame:
    """The rows of a bridge table whose codes are complete; an error if it doesn't say which are."""
    return require_columns(df, [partial]).where(F.lower(partial) == "no")


def parameters(path: str | None = None, variable: str | None = None, default: str | None = None) -> dict:
    """Settings of the file that is given, else of the one an environment variable names, else of the default.

    JSON, or lines "key: value" with sections by indentation; paths that begin with "./" are relative to the file.
    """
    import json
    import os

    chosen = path or (os.environ.get(variable) if variable else None) or default
    if chosen is None:
        raise ValueError("no parameter file")
    base = os.path.dirname(os.path.abspath(chosen))

    def value(x):
        if isinstance(x, str) and x.startswith("./"):
            return os.path.normpath(os.path.join(base, x))
        return {k: value(v) for k, v in x.items()} if isinstance(x, dict) else x

    with open(chosen, encoding="utf-8") as f:
        text = f.read()
    if chosen.endswith(".json"):
        return value(json.loads(text))
    out: dict = {}
    stack = [(-1, out)]
    for line in text.splitlines():
        bare = line.split(" #")[0].rstrip()
        if not bare.strip() or bare.lstrip().startswith("#"):
            continue
        indent, (key, _, rest) = len(bare) - len(bare.lstrip()), bare.strip().partition(":")
        while stack[-1][0] >= indent:
            stack.pop()
        if rest.strip():
            try:
                stack[-1][1][key] = json.loads(rest.strip())
            except json.JSONDecodeError:
                stack[-1][1][key] = rest.strip()
        else:
            stack[-1][1][key] = {}
            stack.append((indent, stack[-1][1][key]))
    return value(out)
