"""Queries of summaries: samples, profiles, tiers, reach, specialty, support."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import cohort, score
from tessera.plans.registry import Tables, query


@query("""
WITH e AS (SELECT DISTINCT c_mktsegment AS sample, o_custkey AS entity, o_orderpriority AS item FROM orders JOIN customer ON o_custkey = c_custkey),
c AS (SELECT sample, median(n) AS carriers FROM (SELECT sample, item, count(*) AS n FROM e GROUP BY 1, 2) GROUP BY 1),
r AS (SELECT sample, median(n) AS repertoire FROM (SELECT sample, entity, count(*) AS n FROM e GROUP BY 1, 2) GROUP BY 1),
t AS (SELECT sample, count(DISTINCT entity) AS richness, count(DISTINCT item) AS union_, count(*) AS pairs FROM e GROUP BY 1)
SELECT sample, richness, union_, pairs, carriers, repertoire, round(carriers / richness, 6) AS share FROM t JOIN c USING (sample) JOIN r USING (sample)""")
def sample_summary(t: Tables) -> DataFrame:
    rows = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    out = cohort.sample_summary(rows.select(F.col("c_mktsegment").alias("sample"), F.col("o_custkey").alias("entity"), F.col("o_orderpriority").alias("item")), "sample", "entity", "item")
    return out.withColumnRenamed("union", "union_").withColumn("share", F.round("share", 6))


@query("""
WITH n AS (SELECT count(DISTINCT l_suppkey) AS n FROM lineitem),
e AS (SELECT l_partkey, avg(l_quantity) AS m, count(DISTINCT l_suppkey) AS k, min(l_quantity) AS a, max(l_quantity) AS z, min(l_returnflag) AS cat FROM lineitem GROUP BY l_partkey)
SELECT l_partkey, round(m, 6) AS mean_score, k AS n_samples, a AS min_score, z AS max_score, cat AS l_returnflag, n AS n_cohort, round((z - a) / m, 6) AS spread FROM e, n ORDER BY m DESC, l_partkey LIMIT 12""")
def cohort_items(t: Tables) -> DataFrame:
    """The twelve items of the highest mean over all samples."""
    out = cohort.cohort_items(t.lineitem, "l_suppkey", "l_partkey", "l_quantity", "l_returnflag")
    return out.withColumn("mean_score", F.round("mean_score", 6)).withColumn("spread", F.round("spread", 6))


@query("""
WITH f AS (SELECT l_suppkey, l_returnflag, l_partkey % 20 AS item, arg_min(l_quantity, l_orderkey * 10 + l_linenumber) AS q FROM lineitem GROUP BY 1, 2, 3)
SELECT l_returnflag, item, round(avg(q), 6) AS mean_score, count(*) AS n_samples FROM f GROUP BY 1, 2""")
def pooled_profile(t: Tables) -> DataFrame:
    """The mean over samples of one score each."""
    rows = t.lineitem.withColumn("item", F.col("l_partkey") % 20)
    out = cohort.pooled_profile(rows, "l_suppkey", "l_returnflag", "item", "l_quantity", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return out.withColumn("mean_score", F.round("mean_score", 6))


@query("""
WITH c AS (SELECT CASE WHEN o_totalprice > 400000 THEN 'high' WHEN o_totalprice > 100000 THEN 'middle' ELSE 'low' END AS tier, count(*) AS n FROM orders GROUP BY 1)
SELECT CAST(o.ord AS INTEGER) AS ord, o.tier, coalesce(n, 0) AS n FROM (VALUES (0, 'high'), (1, 'middle'), (2, 'low'), (3, 'none')) o(ord, tier) LEFT JOIN c USING (tier)""")
def tier_counts(t: Tables) -> DataFrame:
    """Rows of each tier in a fixed order, empty ones too."""
    tier = F.when(F.col("o_totalprice") > 400_000, "high").when(F.col("o_totalprice") > 100_000, "middle").otherwise("low")
    return cohort.tier_counts(t.orders, tier, ["high", "middle", "low", "none"])


@query("""
WITH b AS (SELECT l_suppkey, l_partkey, min(l_linenumber) AS rank FROM lineitem GROUP BY 1, 2)
SELECT * FROM (SELECT l_suppkey, l_partkey, rank, row_number() OVER (PARTITION BY l_suppkey ORDER BY rank, l_partkey) AS place FROM b) WHERE place <= 5""")
def first_items(t: Tables) -> DataFrame:
    """The first five distinct items of each entity in rank order."""
    return cohort.first_items(t.lineitem, "l_suppkey", "l_partkey", "l_linenumber").withColumnRenamed("l_linenumber", "rank")


@query("""
SELECT month, name, row_number() OVER (ORDER BY month, name) AS number FROM (SELECT DISTINCT c_nationkey AS month, c_mktsegment AS name FROM customer)""")
def sequential_labels(t: Tables) -> DataFrame:
    return cohort.numbered(t.customer.select(F.col("c_nationkey").alias("month"), F.col("c_mktsegment").alias("name")), "month", "name")


@query("""
WITH u AS (SELECT o_custkey, min(o_orderpriority) AS rel FROM (SELECT DISTINCT o_custkey, o_orderpriority FROM orders) GROUP BY o_custkey HAVING count(*) = 1),
x AS (SELECT rel, count(*) AS exclusive FROM u GROUP BY rel)
SELECT o_orderpriority, count(*) AS n, count(DISTINCT o_custkey) AS items, coalesce(any_value(exclusive), 0) AS exclusive FROM orders LEFT JOIN x ON rel = o_orderpriority GROUP BY o_orderpriority""")
def relation_reach(t: Tables) -> DataFrame:
    """Rows and items of each relation, and the items that only it reaches."""
    return cohort.relation_reach(t.orders, "o_custkey", "o_orderpriority")


@query("""
WITH o AS (SELECT DISTINCT l_suppkey % 10 AS e, l_partkey % 40 AS k FROM lineitem WHERE l_quantity >= 48), b AS (SELECT k, count(*) AS bf FROM o GROUP BY k),
f AS (SELECT l_partkey % 40 AS k, count(DISTINCT l_orderkey) AS ff FROM lineitem WHERE l_partkey % 3 = 0 GROUP BY 1), n AS (SELECT count(DISTINCT l_orderkey) AS f FROM lineitem WHERE l_partkey % 3 = 0),
s AS (SELECT e, k, ln((SELECT count(DISTINCT e) FROM o) * 1.0 / bf) + 0.5 * ln(n.f * 1.0 / coalesce(ff, n.f)) AS special FROM o JOIN b USING (k) LEFT JOIN f USING (k), n),
r AS (SELECT *, row_number() OVER (PARTITION BY e ORDER BY round(special, 9) DESC, k) AS rank FROM s)
SELECT e, k, round(special, 6) AS special, rank, (SELECT min(rank) FROM r r2 WHERE r2.e = r.e AND r2.k % 5 = 0) AS first_wanted FROM r WHERE rank <= 6""")
def specialty_nutrients(t: Tables) -> DataFrame:
    """The most special nutrients of each entity, and the place of the first of a class."""
    targets = t.lineitem.where("l_quantity >= 48").select((F.col("l_suppkey") % 10).alias("e"), (F.col("l_partkey") % 40).alias("k"))
    facts = t.lineitem.where("l_partkey % 3 = 0").select((F.col("l_partkey") % 40).alias("k"), "l_orderkey")
    return cohort.specialty(targets, facts, "e", "k", "l_orderkey", 6, 0.5, F.col("k") % 5 == 0).withColumn("special", F.round("special", 6))


@query("""
WITH w AS (SELECT p_partkey FROM part WHERE regexp_matches(p_name, '^red ')), c AS (SELECT DISTINCT l_suppkey AS code FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM w) AND l_linenumber = 1),
i AS (SELECT count(DISTINCT l_orderkey) AS n FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM w) AND l_quantity > 0), h AS (SELECT DISTINCT s_nationkey AS entity, s_suppkey AS code FROM supplier)
SELECT entity, count(c.code) AS n_codes, any_value(i.n) AS n_items FROM h LEFT JOIN c USING (code), i GROUP BY entity""")
def panel_support(t: Tables) -> DataFrame:
    """Codes that reach the nutrients of a pattern and that an entity has, and the items that hold any."""
    names = t.part.select(F.col("p_partkey").alias("nutrient"), F.col("p_name").alias("name"))
    links = t.lineitem.where("l_linenumber = 1").select(F.col("l_partkey").alias("nutrient"), F.col("l_suppkey").alias("code"))
    panel = t.supplier.select(F.col("s_nationkey").alias("entity"), F.col("s_suppkey").alias("code"))
    facts = t.lineitem.select(F.col("l_partkey").alias("nutrient"), "l_orderkey", "l_quantity")
    return cohort.panel_support(names, "^red ", links, panel, facts, "nutrient", "name", "code", "entity", "l_orderkey", "l_quantity")


@query("""
WITH n AS (SELECT count(DISTINCT l_suppkey) AS n FROM lineitem), e AS (SELECT l_partkey, count(DISTINCT l_suppkey) AS k FROM lineitem GROUP BY l_partkey)
SELECT l_partkey, round(k * 1.0 / n, 6) AS share FROM e, n WHERE k * 1.0 / n <= 0.3""")
def rare_items(t: Tables) -> DataFrame:
    """Items that few of the entities have."""
    return cohort.common_items(t.lineitem, "l_suppkey", "l_partkey", 0.3).withColumn("share", F.round("share", 6))


@query("""
WITH m AS (SELECT count(DISTINCT l_partkey) AS m FROM lineitem), e AS (SELECT l_suppkey, count(DISTINCT CASE WHEN l_quantity > 40 THEN l_partkey END) AS n FROM lineitem GROUP BY 1),
k AS (SELECT l_suppkey, n, n >= greatest(2, floor(0.068 * m)) AS kept FROM e, m)
SELECT l_suppkey, n, kept, (SELECT min(n) FROM k WHERE kept) - (SELECT max(n) FROM k WHERE NOT kept) AS gap FROM k""")
def dense_entities(t: Tables) -> DataFrame:
    """Entities with enough items, and the gap at the cut."""
    return cohort.dense_entities(t.lineitem.withColumn("v", F.when(F.col("l_quantity") > 40, 1).otherwise(0)), "l_suppkey", "l_partkey", "v")


@query("""
WITH t AS (SELECT DISTINCT l_orderkey AS item, l_partkey AS nutrient FROM lineitem WHERE l_linenumber <= 2), g AS (SELECT DISTINCT l_suppkey AS entity, l_partkey AS nutrient FROM lineitem WHERE l_quantity > 40)
SELECT item, count(DISTINCT entity) AS n FROM t JOIN g USING (nutrient) GROUP BY item""")
def contributing_entities(t: Tables) -> DataFrame:
    """Entities that target any of an item's first nutrients."""
    top = t.lineitem.where("l_linenumber <= 2").select(F.col("l_orderkey").alias("item"), F.col("l_partkey").alias("nutrient"))
    targets = t.lineitem.where("l_quantity > 40").select(F.col("l_suppkey").alias("entity"), F.col("l_partkey").alias("nutrient"))
    return cohort.contributors(top, targets, "item", "nutrient", "entity")


@query("""
SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_name LIKE '%7')""")
def two_pass_rows(t: Tables) -> DataFrame:
    """Rows of the matched among distinct keys."""
    names = t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_name").where(F.col("c_name").endswith("7"))
    return cohort.rows_of(t.orders.select("o_orderkey", "o_custkey"), "o_custkey", names)


@query("""
SELECT DISTINCT l_partkey AS locus, '1.1.1.' || (l_suppkey % 9) AS code, p_size AS start FROM lineitem LEFT JOIN part ON p_partkey = l_partkey AND p_size > 10 WHERE l_suppkey % 2 = 0""")
def codes_with_coordinates(t: Tables) -> DataFrame:
    """Distinct complete codes of loci with coordinates where there are any."""
    last = F.when(F.col("l_suppkey") % 2 == 0, (F.col("l_suppkey") % 9).cast("string")).otherwise("-")
    annotations = t.lineitem.select(F.col("l_partkey").alias("locus"), F.concat(F.lit("1.1.1."), last).alias("code"))
    coordinates = t.part.where("p_size > 10").select(F.col("p_partkey").alias("locus"), F.col("p_size").alias("start"))
    return cohort.with_coordinates(annotations, coordinates, "locus", "code")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 7 = 3 OR o_custkey % 5 = 3")
def any_code_match(t: Tables) -> DataFrame:
    """Rows with a wanted code in a cell of several."""
    rows = t.orders.select("o_orderkey", F.concat_ws(", ", F.col("o_orderkey") % 7, F.concat(F.lit("x"), F.col("o_custkey") % 5)).alias("cell"))
    return cohort.any_match(rows, "cell", ["3", "x3"]).select("o_orderkey")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 25")
def first_rows(t: Tables) -> DataFrame:
    return cohort.head(t.orders.select("o_orderkey", "o_totalprice"), 25, "o_totalprice", "o_orderkey")


@query("""
WITH f AS (SELECT p_partkey, p_size / 10.0 AS gain, p_size % 6 AS improved, (p_size % 4) / 4.0 AS purity, (p_size % 3) / 2.0 AS processing FROM part),
s AS (SELECT *, ln(1 + gain) * sqrt(improved / (improved + 2.0)) AS g, (0.2 * processing + 0.2 * power(1 - purity, 2)) * ln(1 + gain) AS toll FROM f)
SELECT p_partkey, round(g, 6) AS gain_only, round(g - toll, 6) AS full_score, round(CASE WHEN g - toll > 0 THEN g ELSE 0 END, 6) AS admitted FROM s""")
def score_formulas(t: Tables) -> DataFrame:
    """The published formulas on one table."""
    size = F.col("p_size")
    rows = t.part.select("p_partkey", (size / 10).alias("gain"), (size % 6).alias("improved"), (size % 4 / 4).alias("purity"), (size % 3 / 2).alias("processing"))
    out = rows
    for kind, name in (("gain_only", "gain_only"), ("full", "full_score"), ("explicit_admission", "admitted")):
        out = score.formula(out, kind).withColumnRenamed("score", name).withColumn(name, F.round(name, 6))
    return out.select("p_partkey", "gain_only", "full_score", "admitted")


@query("""
SELECT p_partkey, p_type, CASE WHEN p_type = 'PROMO' THEN p_retailprice * 0.02 ELSE p_retailprice END AS amount FROM part WHERE p_type <> 'SMALL' AND p_brand NOT IN ('Brand#3')""")
def scored_portions(t: Tables) -> DataFrame:
    """Items that are scored, with spices at the share that is eaten."""
    items = score.scored_items(t.part, "p_type", "p_brand", ("SMALL",), ("Brand#3",))
    return score.portions(items.select("p_partkey", "p_type", F.col("p_retailprice").alias("amount")), "p_type", "amount", "PROMO", allow=True)


@query("""
WITH s AS (SELECT l_partkey, count(DISTINCT l_suppkey) * 1.0 / (SELECT count(DISTINCT l_suppkey) FROM lineitem) AS share FROM lineitem WHERE l_quantity > 30 GROUP BY l_partkey)
SELECT p_partkey AS l_partkey, round(p_size * power(coalesce(share, 0), 0.5), 6) AS weight FROM part LEFT JOIN s ON l_partkey = p_partkey""")
def community_weights(t: Tables) -> DataFrame:
    """Weights of nutrients by the share of entities that carry them."""
    total = t.lineitem.select("l_suppkey").distinct().agg(F.count(F.lit(1)).alias("_n"))
    carriers = t.lineitem.where("l_quantity > 30").groupBy("l_partkey").agg(F.countDistinct("l_suppkey").alias("_k")).crossJoin(total)  # one row
    shares = carriers.select("l_partkey", (F.col("_k") / F.col("_n")).alias("share"))
    weights = t.part.select(F.col("p_partkey").alias("l_partkey"), F.col("p_size").cast("double").alias("weight"))
    return score.community_weights(weights, shares, "l_partkey", 0.5).withColumn("weight", F.round("weight", 6))
