"""Typed, weighted, directed graphs: edges, cost-bounded walks, classes of walks, expansion."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.numbers import link_score
from tessera.functions.rules import moves_element, strict_prebiotic

#: Cost of an edge type along (up) and against (down) its direction (fixed values).
EDGE_COSTS = {
    "is_a": (1.0, 1.0),
    "is_conjugate_acid_of": (0.5, 0.5),
    "is_conjugate_base_of": (0.5, 0.5),
    "is_tautomer_of": (0.25, 0.25),
    "is_enantiomer_of": (0.5, 0.5),
    "has_functional_parent": (0.75, 2.0),
    "has_parent_hydride": (0.75, 2.0),
    "is_substituent_group_from": (0.75, 2.0),
    "has_part": (1.0, 1.0),
}
CONJUGATE = ("is_conjugate_acid_of", "is_conjugate_base_of")
SCAFFOLD = ("has_functional_parent", "has_parent_hydride", "is_substituent_group_from")


def cut_lineage(df: DataFrame) -> DataFrame:
    """A checkpoint in the folder of spark.checkpoint.dir; one under the warehouse is set where that is unset."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not root and not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        root = root or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
        spark.sparkContext.setCheckpointDir(root)
    return df.checkpoint()


def build_edges(relations: DataFrame, costs: Mapping[str, tuple[float, float]] = EDGE_COSTS) -> DataFrame:
    """(src, dst, etype, direction, weight) both ways from (src, dst, etype); types without a cost are left out."""
    known = relations.where(F.col("etype").isin(*costs))
    cost = lambda k: F.element_at(F.create_map(*(x for t, c in costs.items() for x in (F.lit(t), F.lit(c[k])))), F.col("etype"))
    up = known.select("src", "dst", "etype", F.lit("up").alias("direction"), cost(0).alias("weight"))
    down = known.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "etype", F.lit("down").alias("direction"), cost(1).alias("weight"))
    return up.union(down)


def canonical(df: DataFrame, column: str, aliases: DataFrame) -> DataFrame:
    """Ids through an alias table (alias, main); unknown ids stay."""
    return df.join(aliases.select(F.col("alias").alias(column), "main"), column, "left").withColumn(column, F.coalesce("main", column)).drop("main").select(*df.columns)


def bounded_walk(seeds: DataFrame, edges: DataFrame, max_cost: float, max_rounds: int = 64) -> DataFrame:
    """(seed, node, cost, steps, etypes, nodes): the cheapest walk from each seed to each node within ``max_cost``.

    seeds has seed; edges has src, dst, etype, weight (positive).  Of equal
    costs the walk of fewer steps is taken, then that of the smallest list of
    edge types, then of nodes (all after the seed).  A round extends only what the
    last one improved.
    """
    none = F.array().cast("array<string>")
    best = cut_lineage(seeds.select("seed").distinct().select("seed", F.col("seed").alias("node"), F.lit(0.0).alias("cost"), F.lit(0).alias("steps"), none.alias("etypes"), F.array().cast(f"array<{seeds.schema['seed'].dataType.simpleString()}>").alias("nodes")))
    fresh = best
    roads = edges.select(F.col("src").alias("node"), "dst", "etype", F.col("weight").cast("double").alias("weight"))
    for _ in range(max_rounds):
        reached = fresh.join(roads, "node").withColumn("total", F.col("cost") + F.col("weight")).where(F.col("total") <= max_cost)
        offer = F.struct(F.col("total").alias("cost"), (F.col("steps") + 1).alias("steps"), F.concat("etypes", F.array("etype")).alias("etypes"), F.concat("nodes", F.array("dst")).alias("nodes"))
        found = reached.select("seed", F.col("dst").alias("node"), offer.alias("offer")).groupBy("seed", "node").agg(F.min("offer").alias("offer"))
        had = best.select("seed", "node", F.struct("cost", "steps", "etypes", "nodes").alias("had"))
        merged = had.join(found, ["seed", "node"], "full_outer")
        better = F.col("had").isNull() | (F.col("offer") < F.col("had"))
        state = cut_lineage(merged.select("seed", "node", F.coalesce(F.when(better, F.col("offer")), F.col("had")).alias("s"), F.coalesce(better & F.col("offer").isNotNull(), F.lit(False)).alias("fresh")))
        best = state.select("seed", "node", "s.*")
        fresh = state.where("fresh").select("seed", "node", "s.*")
        if fresh.isEmpty():
            return best
    raise RuntimeError("the walk did not end; are all weights positive?")


def relation_of(etypes: Column) -> Column:
    """The class of a walk by the edge types it takes."""
    kinds = F.array_distinct(etypes)
    within = lambda *types: F.size(F.array_except(kinds, F.array(*map(F.lit, types)))) == 0
    return (
        F.when(F.size(etypes) == 0, "exact")
        .when(within("is_a"), "is_a")
        .when((F.size(etypes) == 1) & within(*CONJUGATE), F.regexp_replace(etypes[0], "^is_", ""))
        .when(within(*CONJUGATE), "conjugate")
        .when(within("is_tautomer_of"), "tautomer")
        .when(within("is_enantiomer_of"), "enantiomer")
        .when(within(*SCAFFOLD), "scaffold")
        .when(within("has_part"), "part_of")
        .when(within(*CONJUGATE, "is_tautomer_of"), "identity")
        .otherwise("mixed")
    )


def scored_walk(walk: DataFrame, max_cost: float) -> DataFrame:
    out = walk.withColumn("relation", relation_of(F.col("etypes"))).withColumn("path", F.array_join("etypes", ","))
    return out.withColumn("score", link_score("cost", "relation", max_cost))


def guarded(rows: DataFrame, node: str, relation: str, code: str, limit: int = 40, loose: tuple[str, ...] = ("scaffold", "part_of", "enantiomer", "mixed")) -> DataFrame:
    """Rows without those that reach a hub (over ``limit`` distinct codes) by a loose relation."""
    hubs = rows.groupBy(node).agg(F.countDistinct(code).alias("_codes")).where(F.col("_codes") > limit)
    return rows.join(hubs.select(node).withColumn("_hub", F.lit(True)), node, "left").where(~(F.coalesce("_hub", F.lit(False)) & F.col(relation).isin(*loose))).drop("_hub")


def leaves(edges: DataFrame, nodes: DataFrame, node: str) -> DataFrame:
    """Nodes that nothing expands from."""
    return nodes.join(edges.select(F.col("src").alias(node)).distinct(), node, "left_anti")


def expand(generics: DataFrame, names: DataFrame, rules: list[tuple[str, str, str]], id_: str = "id", name: str = "name") -> DataFrame:
    """(src, dst, rule): each generic by the first rule (label, pattern of the generic, pattern of its specifics) that fits.

    Specifics are existing names; a generic is never its own specific.
    """
    label = F.coalesce(*(F.when(F.lower(F.col(name)).rlike(g), F.lit(r)) for r, g, _ in rules))
    left = generics.select(F.col(id_).alias("src"), label.alias("rule")).where("rule is not null")
    fits = F.explode(F.array_compact(F.array(*(F.when(F.lower(F.col(name)).rlike(s), F.lit(r)) for r, _, s in rules))))
    right = names.select(F.col(id_).alias("dst"), fits.alias("rule"))
    return left.join(right, "rule").where("src <> dst").select("src", "dst", "rule")


def emit(nutrients: DataFrame, walk: DataFrame, digest: DataFrame, names: DataFrame, live: DataFrame | None = None, strict: bool = False, sugars: bool = False, amino_acids: bool = False, hub: int = 40, keep_transport: bool = False, keep_unmatched: bool = False) -> DataFrame:
    """(nutrient_id, seed, node, code, substrate, relation, cost, steps, score, path): a nutrient's links over its seeds' walks.

    nutrients has nutrient_id, nutrient_name and seed; walk is a scored walk; digest
    has node, code and substrate; names has node and name.  Only live nutrients
    count where they are given, and the strict filter can leave names out.  A hub is
    reached by no loose relation, and a code that moves an element is no link to
    it.  Of rows with one nutrient, seed, node and code the least substrate stays.
    """
    own = nutrients if live is None else nutrients.join(live.select("nutrient_id").distinct(), "nutrient_id", "left_semi")
    if strict:
        own = own.where(strict_prebiotic("nutrient_name", sugars, amino_acids))
    hubs = digest.groupBy("node").agg(F.countDistinct("code").alias("_codes")).where(F.col("_codes") > hub).select("node", F.lit(True).alias("_hub"))
    steps = walk.join(hubs, "node", "left").where(~(F.coalesce("_hub", F.lit(False)) & F.col("relation").isin("scaffold", "part_of", "enantiomer", "mixed"))).drop("_hub")
    rows = own.select("nutrient_id", "seed").distinct().join(steps, "seed")
    found = rows.join(digest.groupBy("node", "code").agg(F.min("substrate").alias("substrate")), "node")
    if not keep_transport:
        found = found.join(names.select(F.col("node").alias("seed"), F.col("name").alias("_name")), "seed", "left").where(~moves_element("_name", "code")).drop("_name")
    out = found.select("nutrient_id", "seed", "node", "code", "substrate", "relation", "cost", "steps", "score", "path")
    if keep_unmatched:
        blank = own.select("nutrient_id").distinct().join(out.select("nutrient_id"), "nutrient_id", "left_anti")
        out = out.unionByName(blank, allowMissingColumns=True)
    return out


def substitutes(facts: DataFrame, aliases: DataFrame, item: str, nutrient: str, amount: str) -> DataFrame:
    """Facts, and for items that lack a target the amount of a related generic, scaled by the alias's efficiency.

    aliases has target, generic and efficiency; of several generics the largest scaled amount counts.
    """
    offered = facts.join(aliases, F.col(nutrient) == F.col("generic")).groupBy(item, F.col("target").alias(nutrient)).agg(F.max(F.col(amount) * F.col("efficiency")).alias(amount))
    lacking = offered.join(facts.select(item, nutrient), [item, nutrient], "left_anti")
    return facts.select(item, nutrient, amount, F.lit(False).alias("substituted")).union(lacking.select(item, nutrient, amount, F.lit(True)))


def canonical_ids(df: DataFrame, column: str, aliases: DataFrame, pattern: str = r"(?i)(CHEBI:\d+)") -> DataFrame:
    """The id found anywhere in a text, in upper case and through the alias table (alias, main); no id, "NA" and blanks are null."""
    found = F.upper(F.regexp_extract(F.coalesce(F.col(column), F.lit("")), pattern, 1))
    return canonical(df.withColumn(column, F.when(found != "", found)), column, aliases)
