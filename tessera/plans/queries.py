"""Queries of the engine's operators over whole tables.

Roles: customers or users are the entities, orders and part types the items,
parts and brands the nutrients, quantities the amounts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import numbers, text
from tessera.operators import facts, graph, linkage, score, stats, verify
from tessera.plans.registry import Tables, query

@query("""
WITH a AS (
  SELECT p_type, p_brand, avg(l_quantity) AS amount FROM customer
  JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey
  WHERE c_mktsegment = 'BUILDING' GROUP BY p_type, p_brand)
SELECT p_type, count(*) AS breadth, round(sum(amount), 6) AS mass FROM a GROUP BY p_type
ORDER BY breadth DESC, mass DESC, p_type LIMIT 10""")
def chain_walk_topk(t: Tables) -> DataFrame:
    """From one segment's customers along orders and parts to the types of widest reach."""
    own = t.customer.where("c_mktsegment = 'BUILDING'").join(t.orders, F.col("c_custkey") == F.col("o_custkey")).select("o_orderkey")
    rows = own.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey")).join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    amounts = rows.groupBy("p_type", "p_brand").agg(F.avg("l_quantity").alias("amount"))
    out = amounts.groupBy("p_type").agg(F.count(F.lit(1)).alias("breadth"), F.round(F.sum("amount"), 6).alias("mass"))
    return out.orderBy(F.desc("breadth"), F.desc("mass"), "p_type").limit(10)


@query("""
SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem
WHERE EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey AND p_size <= 5)
   OR l_partkey IN (SELECT p_partkey - 1 FROM part WHERE p_size <= 5 AND p_partkey % 10 = 9)""")
def chain_filter_semi(t: Tables) -> DataFrame:
    targets = t.part.where("p_size <= 5").select(F.col("p_partkey").alias("l_partkey"))
    aliases = t.part.where("p_partkey % 10 = 9").select(F.col("p_partkey").alias("specific"), (F.col("p_partkey") - 1).alias("generic"))
    return facts.chain_filter(t.lineitem, targets, "l_partkey", aliases).select("l_orderkey", "l_linenumber", "l_partkey")


@query("""
SELECT c_custkey, c_name, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS linked FROM customer""")
def chain_filter_anti(t: Tables) -> DataFrame:
    """Customers with and without orders (the cascade that drops entities left without a fact)."""
    kept, orphans = facts.without_facts(t.customer, t.orders.withColumnRenamed("o_custkey", "c_custkey"), "c_custkey")
    return kept.select("c_custkey", "c_name", F.lit(True).alias("linked")).union(orphans.select("c_custkey", "c_name", F.lit(False)))


@query("""
SELECT l_partkey, l_quantity, string_agg(DISTINCT l_returnflag || l_linestatus, ';' ORDER BY l_returnflag || l_linestatus) AS source
FROM lineitem GROUP BY l_partkey, l_quantity""")
def multi_witness_collapse(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_partkey", "l_quantity", F.concat("l_returnflag", "l_linestatus").alias("source"))
    return facts.collapse_witnesses(rows, ["l_partkey", "l_quantity"], "source")


@query("""
WITH f AS (SELECT l_suppkey, p_brand, max(l_extendedprice) AS best FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_suppkey, p_brand)
SELECT l_suppkey, string_agg(p_brand, ',' ORDER BY best DESC, p_brand) AS brands FROM f GROUP BY l_suppkey""")
def ordered_distinct_concat(t: Tables) -> DataFrame:
    """Brands of each supplier in the order of their dearest line."""
    rows = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    best = rows.groupBy("l_suppkey", "p_brand").agg(F.max("l_extendedprice").alias("best"))  # keeps a group's list short
    return facts.ordered_distinct_concat(best, ["l_suppkey"], [-F.col("best"), F.col("p_brand")], F.col("p_brand"), ",", "brands")


@query("""
WITH v AS (SELECT doc_id, source, md5(text) AS h FROM documents),
r AS (SELECT doc_id, row_number() OVER (PARTITION BY source, h ORDER BY doc_id) AS k FROM v)
SELECT doc_id FROM r WHERE k = 1""")
def exact_relistings(t: Tables) -> DataFrame:
    """Documents but those that repeat an earlier one of their source, word for word."""
    entities = t.documents.select("doc_id", "source")
    vectors = t.documents.select("doc_id", F.lit(0).alias("item"), F.md5(F.col("text")).alias("amount"))
    return facts.drop_relistings(entities, vectors, "doc_id", ["source"], "item", "amount").select("doc_id")


@query("""
SELECT l_partkey, count(DISTINCT l_orderkey) AS df,
  round(1 + ln((SELECT count(DISTINCT l_orderkey) FROM lineitem) / count(DISTINCT l_orderkey)), 6) AS idf
FROM lineitem GROUP BY l_partkey""")
def idf_weights(t: Tables) -> DataFrame:
    return score.inverse_frequency(t.lineitem, "l_orderkey", "l_partkey").select("l_partkey", "df", F.round("idf", 6).alias("idf"))


def _entity_targets(t: Tables) -> DataFrame:
    """Brands that each nation's customers order: the entity's nutrients."""
    own = t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey")).select(F.col("c_nationkey").alias("entity"), "o_orderkey")
    rows = own.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey")).join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    return rows.select("entity", F.col("p_brand").alias("nutrient")).distinct()


def _item_facts(t: Tables) -> DataFrame:
    rows = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    return rows.groupBy(F.col("p_type").alias("item"), F.col("p_brand").alias("nutrient")).agg(F.avg("l_quantity").alias("amount"))


def _weights(item_facts: DataFrame) -> DataFrame:
    idf = score.inverse_frequency(item_facts, "item", "nutrient").select("nutrient", F.col("idf").alias("weight"))
    scale = item_facts.groupBy("nutrient").agg((F.max("amount") / 100).alias("scale"))
    return idf.join(scale, "nutrient")


_SCORES = """
WITH targets AS (
  SELECT DISTINCT c_nationkey AS entity, p_brand AS nutrient FROM customer JOIN orders ON c_custkey = o_custkey
  JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey),
facts AS (
  SELECT p_type AS item, p_brand AS nutrient, avg(l_quantity) AS amount FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_type, p_brand),
weights AS (
  SELECT nutrient, 1 + ln((SELECT count(DISTINCT item) FROM facts) / count(DISTINCT item)) AS weight, max(amount) / 100 AS scale
  FROM facts GROUP BY nutrient),
slate AS (
  SELECT entity, item, sum(weight * ln(1 + amount / scale)) AS gain, count(*) FILTER (WHERE amount > 0) AS improved
  FROM targets JOIN facts USING (nutrient) JOIN weights USING (nutrient) GROUP BY entity, item),
scored AS (SELECT *, round(ln(1 + gain) * sqrt(improved / (improved + 2.0)), 6) AS score FROM slate)
"""


def _slate(t: Tables) -> DataFrame:
    item_facts = _item_facts(t)
    out = score.clean_slate(_entity_targets(t), item_facts, _weights(item_facts), "entity", "item", "nutrient", "amount")
    return out.withColumn("score", F.round("score", 6))


@query(_SCORES + "SELECT entity, item, round(gain, 6) AS gain, improved, score FROM scored")
def clean_slate_score(t: Tables) -> DataFrame:
    return _slate(t).select("entity", "item", F.round("gain", 6).alias("gain"), "improved", "score")


@query(_SCORES + """SELECT entity, item, CAST(r AS INTEGER) AS rank, score FROM (
  SELECT *, row_number() OVER (PARTITION BY entity ORDER BY score DESC, item) AS r FROM scored) WHERE r <= 10""")
def per_org_rank(t: Tables) -> DataFrame:
    return score.ranked(_slate(t), "entity", "score", "item", 10).select("entity", "item", "rank", "score")


@query(_SCORES + """SELECT entity, item, CAST(r AS INTEGER) AS rank, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, entity) AS r FROM scored) WHERE r <= 20""")
def top_k_per_food(t: Tables) -> DataFrame:
    return score.ranked(_slate(t), "item", "score", "entity", 20).select("entity", "item", "rank", "score")


@query("""
WITH s AS (SELECT user_id, event_type, round(sum(value), 6) AS score FROM events GROUP BY user_id, event_type),
p AS (SELECT event_type, median(score) AS peer_median, avg(score) AS peer_mean, count(*) AS peer_n FROM s GROUP BY event_type)
SELECT user_id, event_type, score, round(peer_median, 6) AS peer_median, round(peer_mean, 4) AS peer_mean, peer_n, round(score - peer_median, 6) AS comp_score
FROM s JOIN p USING (event_type) WHERE score > peer_median AND score > 0 AND peer_n >= 20""")
def peer_differential(t: Tables) -> DataFrame:
    """Users above the median of their event type, strictly."""
    scored = t.events.groupBy("user_id", "event_type").agg(F.round(F.sum("value"), 6).alias("score"))
    out = score.peer_gate(scored, "user_id", "event_type", "score", 20).where("peer_n >= 20")
    return out.select("user_id", "event_type", "score", F.round("peer_median", 6).alias("peer_median"), F.round("peer_mean", 4).alias("peer_mean"), "peer_n", F.round("comp_score", 6).alias("comp_score"))


@query("""
SELECT event_type, count(DISTINCT user_id) AS carriers,
  round(count(DISTINCT user_id) / (SELECT count(DISTINCT user_id) FROM events), 6) AS share FROM events GROUP BY event_type""")
def carrier_share_community(t: Tables) -> DataFrame:
    return score.carrier_share(t.events, "user_id", "event_type").select("event_type", "carriers", F.round("share", 6).alias("share"))


_HITS = "SELECT s_nationkey AS key, s_suppkey AS id, floor(s_acctbal / 100) AS score, s_suppkey % 3 = 0 AS star FROM supplier"
_LEVELS = f"""
WITH h AS ({_HITS}), l AS (SELECT *, max(score) OVER (PARTITION BY key) AS best, dense_rank() OVER (PARTITION BY key ORDER BY score DESC) AS level FROM h),
m AS (SELECT *, max(CASE WHEN level = 2 THEN score END) OVER (PARTITION BY key) AS second FROM l),
k AS (SELECT *, CASE WHEN second IS NULL OR best - second >= 20 THEN level = 1 ELSE score >= best - 8 END AS kept FROM m)
"""


def _hits(t: Tables) -> DataFrame:
    return t.supplier.select(F.col("s_nationkey").alias("key"), F.col("s_suppkey").alias("id"), F.floor(F.col("s_acctbal") / 100).cast("double").alias("score"), (F.col("s_suppkey") % 3 == 0).alias("star"))


@query(_LEVELS + "SELECT key, id, score FROM k WHERE kept")
def winner_gap_keep_within(t: Tables) -> DataFrame:
    return linkage.keep_winners(_hits(t), "key", "score").select("key", "id", "score")


@query(_LEVELS + """, r AS (SELECT *, bool_or(kept AND star) OVER (PARTITION BY key) AS has, max(CASE WHEN star THEN score END) OVER (PARTITION BY key) AS top FROM k)
SELECT key, id, score, star FROM r WHERE kept OR (NOT has AND star AND score >= top - 8)""")
def curation_rescue(t: Tables) -> DataFrame:
    return linkage.keep_winners(_hits(t), "key", "score", curated=F.col("star")).select("key", "id", "score", "star")


@query("""
SELECT p_partkey, trim(regexp_replace(lower(p_name || ', (' || p_type || ')'), '\\s+', ' ', 'g')) AS norm,
  trim(regexp_replace(replace(lower(p_name || ', (' || p_type || ')'), ',', ' '), '\\s+', ' ', 'g')) AS no_commas,
  trim(regexp_replace(regexp_replace(lower(p_name || ', (' || p_type || ')'), '\\([^()]*\\)', ' ', 'g'), '\\s+', ' ', 'g')) AS no_paren,
  trim(regexp_replace(regexp_replace(lower(p_name || ', (' || p_type || ')'), '[^a-z0-9 ]', ' ', 'g'), '\\s+', ' ', 'g')) AS compact
FROM part""")
def name_views(t: Tables) -> DataFrame:
    named = t.part.withColumn("label", F.concat("p_name", F.lit(", ("), "p_type", F.lit(")")))
    return named.select("p_partkey", *(c.alias(v) for v, c in text.name_views("label").items()))


@query("""
WITH x AS (SELECT n_nationkey AS id, lower(n_name) AS norm, trim(regexp_replace(regexp_replace(lower(n_name), '[^a-z0-9 ]', ' ', 'g'), '\\s+', ' ', 'g')) AS compact FROM nation),
q AS (SELECT s_suppkey AS query, lower('nation-' || s_nationkey) AS norm, trim(regexp_replace(regexp_replace(lower('nation-' || s_nationkey), '[^a-z0-9 ]', ' ', 'g'), '\\s+', ' ', 'g')) AS compact FROM supplier),
h AS (SELECT query, id, 40 AS score, 'norm' AS view FROM q JOIN x ON q.norm = x.norm UNION ALL SELECT query, id, 20, 'compact' FROM q JOIN x ON q.compact = x.compact)
SELECT query, id, max_by(view, score) AS view, max(score) AS score FROM h GROUP BY query, id""")
def inverted_index_match(t: Tables) -> DataFrame:
    """Suppliers' nations by written name, through views of the nations' names."""
    weights = {"norm": 40, "compact": 20}
    index = linkage.inverted_index(t.nation, "n_nationkey", "n_name", tuple(weights))
    asked = t.supplier.select("s_suppkey", F.concat(F.lit("nation-"), "s_nationkey").alias("name"))
    return linkage.view_match(asked, index, "s_suppkey", "name", weights)


@query("""
WITH a AS (SELECT s_nationkey AS k, min(s_suppkey) AS v FROM supplier WHERE s_acctbal > 5000 GROUP BY 1),
b AS (SELECT n_regionkey AS k, min(s_suppkey) AS v FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1)
SELECT c_custkey, coalesce(a.v, b.v) AS supplier_id, CASE WHEN a.v IS NOT NULL THEN 'nation' WHEN b.v IS NOT NULL THEN 'region' END AS rung
FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN a ON a.k = c_nationkey LEFT JOIN b ON b.k = n_regionkey""")
def ladder_match(t: Tables) -> DataFrame:
    rich = t.supplier.where("s_acctbal > 5000").select(F.col("s_suppkey").alias("supplier_id"), F.col("s_nationkey").alias("k"))
    near = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("supplier_id"), F.col("n_regionkey").alias("k"))
    rows = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", "c_nationkey", "n_regionkey")
    out = linkage.ladder(rows, [("nation", rich, F.col("c_nationkey"), "k"), ("region", near, F.col("n_regionkey"), "k")], "supplier_id")
    return out.select("c_custkey", "supplier_id", "rung")


@query("""
WITH u AS (SELECT * FROM (SELECT l_orderkey, l_linenumber, l_quantity, l_discount, l_tax FROM lineitem) UNPIVOT (amount FOR item IN (l_quantity, l_discount, l_tax)))
SELECT l_orderkey, l_linenumber, item, round(amount * CASE item WHEN 'l_quantity' THEN 0.001 WHEN 'l_discount' THEN 1000.0 ELSE 1.0 END, 6) AS amount FROM u""")
def unpivot_units(t: Tables) -> DataFrame:
    """A wide sheet as facts, each column's unit brought to its target's."""
    rows = facts.unpivot_units(t.lineitem, ["l_orderkey", "l_linenumber"], ["l_quantity", "l_discount", "l_tax"], "item", "amount")
    units = [("l_quantity", "mg/100 g", "G"), ("l_discount", "G", "MG"), ("l_tax", "kcal", "KJ")]
    labels = t.spark.createDataFrame(units, "item string, source_unit string, target_unit string")
    rows = numbers.with_factor(rows, labels, "item")
    return rows.select("l_orderkey", "l_linenumber", "item", F.round(F.col("amount") * F.col("factor"), 6).alias("amount"))


_CELL = "CASE l_linenumber % 7 WHEN 0 THEN 'Tr' WHEN 1 THEN '<' || CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) WHEN 2 THEN CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) || ',5' WHEN 3 THEN 'N' WHEN 4 THEN '(' || CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) || '.25)' WHEN 5 THEN '-' ELSE CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) END"


@query(f"""
WITH c AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS INTEGER) AS q, {_CELL} AS cell FROM lineitem)
SELECT l_orderkey, l_linenumber, cell,
  CASE l_linenumber % 7 WHEN 2 THEN q + 0.5 WHEN 6 THEN q END::DOUBLE AS strict,
  CASE l_linenumber % 7 WHEN 0 THEN 0 WHEN 1 THEN 0 WHEN 2 THEN q + 0.5 WHEN 6 THEN q END::DOUBLE AS trace_zero,
  CASE l_linenumber % 7 WHEN 0 THEN 0 WHEN 1 THEN q WHEN 2 THEN q WHEN 4 THEN q + 0.25 WHEN 6 THEN q END::DOUBLE AS limit_value,
  CASE l_linenumber % 7 WHEN 0 THEN 0.001 WHEN 1 THEN q WHEN 2 THEN q * 10 + 5 WHEN 4 THEN q + 0.25 WHEN 6 THEN q END::DOUBLE AS trace_small
FROM c""")
def messy_number_policies(t: Tables) -> DataFrame:
    cells = t.lineitem.select("l_orderkey", "l_linenumber", F.expr(_CELL.replace("VARCHAR", "STRING")).alias("cell"))
    return cells.select("*", *(numbers.clean_number("cell", p).alias(p) for p in ("strict", "trace_zero", "limit_value", "trace_small")))


def _geography(t: Tables) -> DataFrame:
    """Nations under regions, neighbours in number as tautomers, and each supplier under its nation."""
    nation = t.nation.select(F.concat(F.lit("n"), "n_nationkey").alias("src"), F.concat(F.lit("r"), "n_regionkey").alias("dst"), F.lit("is_a").alias("etype"))
    near = t.nation.where("n_nationkey % 2 = 0").select(F.concat(F.lit("n"), "n_nationkey"), F.concat(F.lit("n"), F.col("n_nationkey") + 1), F.lit("is_tautomer_of"))
    sup = t.supplier.select(F.concat(F.lit("s"), "s_suppkey"), F.concat(F.lit("n"), "s_nationkey"), F.lit("has_functional_parent"))
    return nation.union(near).union(sup)


_WALK = """
WITH RECURSIVE rel AS (
  SELECT 'n' || n_nationkey AS src, 'r' || n_regionkey AS dst, 'is_a' AS etype, 1.0::DOUBLE AS up, 1.0::DOUBLE AS down FROM nation
  UNION ALL SELECT 'n' || n_nationkey, 'n' || (n_nationkey + 1), 'is_tautomer_of', 0.25, 0.25 FROM nation WHERE n_nationkey % 2 = 0
  UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 'has_functional_parent', 0.75, 2.0 FROM supplier),
e AS (SELECT src, dst, etype, up AS w FROM rel UNION ALL SELECT dst, src, etype, down FROM rel),
w AS (
  SELECT 's' || s_suppkey AS seed, 's' || s_suppkey AS node, 0.0::DOUBLE AS cost, 0 AS steps, []::VARCHAR[] AS etypes FROM supplier
  UNION ALL SELECT w.seed, e.dst, w.cost + e.w, w.steps + 1, list_append(w.etypes, e.etype) FROM w JOIN e ON e.src = w.node WHERE w.cost + e.w <= 1.75),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY seed, node ORDER BY cost, steps, etypes) AS r FROM w) WHERE r = 1)
"""


@query(_WALK + "SELECT seed, node, cost, steps, array_to_string(etypes, ',') AS path FROM b")
def bounded_walk(t: Tables) -> DataFrame:
    seeds = t.supplier.select(F.concat(F.lit("s"), "s_suppkey").alias("seed"))
    walk = graph.bounded_walk(seeds, graph.build_edges(_geography(t)), 1.75)
    return walk.select("seed", "node", "cost", "steps", F.array_join("etypes", ",").alias("path"))


@query(_WALK + """, c AS (SELECT *, list_sort(list_distinct(etypes)) AS kinds FROM b),
k AS (SELECT *, CASE WHEN steps = 0 THEN 'exact' WHEN kinds = ['is_a'] THEN 'is_a' WHEN kinds = ['is_tautomer_of'] THEN 'tautomer'
  WHEN kinds = ['has_functional_parent'] THEN 'scaffold' ELSE 'mixed' END AS relation FROM c)
SELECT seed, node, relation, CAST(round_even(greatest(0.0, least(100.0, 100.0 * (1.0 - cost / 1.75) +
  CASE relation WHEN 'exact' THEN 10 WHEN 'tautomer' THEN 5 WHEN 'scaffold' THEN -5 ELSE 0 END)), 0) AS INTEGER) AS score FROM k""")
def walk_relation_score(t: Tables) -> DataFrame:
    seeds = t.supplier.select(F.concat(F.lit("s"), "s_suppkey").alias("seed"))
    walk = graph.scored_walk(graph.bounded_walk(seeds, graph.build_edges(_geography(t)), 1.75), 1.75)
    return walk.select("seed", "node", "relation", "score")


@query("""
WITH r AS (SELECT DISTINCT p_brand AS node, l_suppkey AS code, CASE p_size % 3 WHEN 0 THEN 'scaffold' WHEN 1 THEN 'is_a' ELSE 'mixed' END AS relation FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size <= 6),
h AS (SELECT node FROM r GROUP BY node HAVING count(DISTINCT code) > 40)
SELECT node, code, relation FROM r WHERE NOT (relation IN ('scaffold', 'part_of', 'enantiomer', 'mixed') AND node IN (SELECT node FROM h))""")
def hub_guard(t: Tables) -> DataFrame:
    relation = F.when(F.col("p_size") % 3 == 0, "scaffold").when(F.col("p_size") % 3 == 1, "is_a").otherwise("mixed")
    rows = t.lineitem.join(t.part.where("p_size <= 6"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("p_brand").alias("node"), F.col("l_suppkey").alias("code"), relation.alias("relation")).distinct()
    return graph.guarded(rows, "node", "relation", "code").select("node", "code", "relation")


def _seeds(t: Tables) -> tuple[DataFrame, DataFrame]:
    first = t.lineitem.where("l_linenumber = 1").select("l_partkey", "l_suppkey").distinct()
    extra = t.lineitem.where("l_linenumber = 2 and l_quantity > 40").select("l_partkey", "l_suppkey").distinct()
    return first, extra


@query("""
SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_linenumber = 1
UNION SELECT l_partkey, l_suppkey FROM lineitem WHERE l_linenumber = 2 AND l_quantity > 40""")
def seed_merge(t: Tables) -> DataFrame:
    return facts.merge_or_override(*_seeds(t), "l_partkey", override=False)


@query("""
WITH x AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_linenumber = 2 AND l_quantity > 40)
SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_linenumber = 1 AND l_partkey NOT IN (SELECT l_partkey FROM x)
UNION SELECT * FROM x""")
def seed_override(t: Tables) -> DataFrame:
    return facts.merge_or_override(*_seeds(t), "l_partkey", override=True)


@query("""
WITH own AS (SELECT DISTINCT user_id, event_type FROM events WHERE value > 50), ref AS (SELECT DISTINCT user_id, event_type FROM events),
thin AS (SELECT user_id FROM own GROUP BY user_id HAVING count(*) < 3)
SELECT * FROM own UNION SELECT * FROM ref WHERE user_id IN (SELECT user_id FROM thin)""")
def augment_under_threshold(t: Tables) -> DataFrame:
    return facts.augment_thin(t.events.where("value > 50"), t.events, "user_id", "event_type", 3)


@query("""
WITH o AS (SELECT o_custkey, string_agg(DISTINCT o_orderpriority, ';') AS labels FROM orders GROUP BY o_custkey),
e AS (SELECT o_custkey, unnest(string_split(labels, ';')) AS tier FROM o),
r AS (SELECT *, CASE WHEN substr(tier, 1, 1) <= '3' THEN CAST(substr(tier, 1, 1) AS INTEGER) END AS rank FROM e)
SELECT o_custkey, coalesce(max_by(tier, rank), 'unknown') AS strictest, max(rank) AS rank FROM r GROUP BY o_custkey""")
def strictest_tier(t: Tables) -> DataFrame:
    composite = facts.collapse_witnesses(t.orders.select("o_custkey", "o_orderpriority"), ["o_custkey"], "o_orderpriority")
    tiers = t.orders.select(F.col("o_orderpriority").alias("tier")).distinct().withColumn("rank", F.substring("tier", 1, 1).cast("int")).where("rank <= 3")
    return facts.best_label(composite, "o_custkey", "o_orderpriority", tiers, "tier", "rank")


@query("""
WITH c AS (SELECT c_acctbal, c_acctbal > 0 AS a, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS b,
  EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000) AS d FROM customer)
SELECT 'solvent' AS stage, count(*) FILTER (WHERE a) AS n, round(sum(c_acctbal) FILTER (WHERE a), 2) AS weighted FROM c
UNION ALL SELECT 'ordered', count(*) FILTER (WHERE a AND b), round(sum(c_acctbal) FILTER (WHERE a AND b), 2) FROM c
UNION ALL SELECT 'large', count(*) FILTER (WHERE a AND b AND d), round(sum(c_acctbal) FILTER (WHERE a AND b AND d), 2) FROM c""")
def coverage_funnel(t: Tables) -> DataFrame:
    best = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("best"))
    rows = t.customer.join(best, "c_custkey", "left")
    out = verify.funnel(rows, {"solvent": F.col("c_acctbal") > 0, "ordered": F.col("best").isNotNull(), "large": F.col("best") > 200000}, "c_acctbal")
    return out.withColumn("weighted", F.round("weighted", 2))


@query("""
WITH c AS (SELECT 'EC:1.1.' || (user_id % 5) || '.' || (event_id % 40) || CASE WHEN event_id % 3 = 0 THEN ', 2.7.1.-' ELSE '; 2.7.1.' || (user_id % 9) END AS cell FROM events),
k AS (SELECT DISTINCT '1.1.' || (s_suppkey % 5) || '.' || (s_suppkey % 17) AS code FROM supplier UNION SELECT '2.7.1.4'),
x AS (SELECT list_filter(string_split_regex(replace(cell, 'EC:', ''), '[,; ]+'), lambda v: regexp_full_match(v, '\\d+\\.\\d+\\.\\d+\\.\\d+')) AS codes FROM c)
SELECT count(*) AS n, count(*) FILTER (WHERE list_has_any(codes, (SELECT list(code) FROM k)))::BIGINT AS matched,
  count(*) FILTER (WHERE list_has_any(codes, (SELECT list(code) FROM k))) / count(*) AS rate FROM x WHERE len(codes) > 0""")
def match_rate_weighted(t: Tables) -> DataFrame:
    """Share of annotation cells with a known code, counted on distinct cells."""
    tail = F.when(F.col("event_id") % 3 == 0, ", 2.7.1.-").otherwise(F.concat(F.lit("; 2.7.1."), F.col("user_id") % 9))
    cells = t.events.select(F.concat(F.lit("EC:1.1."), F.col("user_id") % 5, F.lit("."), F.col("event_id") % 40, tail).alias("cell"))
    known = t.supplier.select(F.concat(F.lit("1.1."), F.col("s_suppkey") % 5, F.lit("."), F.col("s_suppkey") % 17).alias("code")).union(t.spark.sql("select '2.7.1.4' as code"))
    return verify.weighted_match_rate(cells, "cell", known, "code", text.split_codes("cell"))


@query("""
WITH r AS (SELECT count(*) OVER (ORDER BY l_quantity RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS rx,
  count(*) OVER (ORDER BY l_extendedprice RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS ry FROM lineitem)
SELECT round(corr(rx, ry), 6) AS rho, count(*) AS n FROM r""")
def spearman_maxrank(t: Tables) -> DataFrame:
    return stats.max_rank_correlation(t.lineitem, "l_quantity", "l_extendedprice").select(F.round("rho", 6).alias("rho"), "n")


@query("""
WITH x AS (SELECT o_orderstatus AS g, o_totalprice AS v FROM orders WHERE o_orderstatus IN ('O', 'F')),
r AS (SELECT g, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0 AS k FROM x)
SELECT count(*) FILTER (WHERE g = 'O') AS n_a, count(*) FILTER (WHERE g = 'F') AS n_b,
  (sum(k) FILTER (WHERE g = 'O') - count(*) FILTER (WHERE g = 'O') * (count(*) FILTER (WHERE g = 'O') + 1) / 2.0)::DOUBLE AS u FROM r""")
def mann_whitney_u(t: Tables) -> DataFrame:
    return stats.mann_whitney(t.orders, "o_orderstatus", "o_totalprice", "O", "F").select("n_a", "n_b", F.col("u").cast("double").alias("u"))


_PRESENCE = "SELECT DISTINCT c_nationkey AS entity, p_partkey AS item FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey"
_SORENSEN = f"""
WITH p AS ({_PRESENCE}), n AS (SELECT entity, count(*) AS n FROM p GROUP BY entity),
s AS (SELECT a.entity AS i, b.entity AS j, count(*) AS shared FROM p a JOIN p b ON a.item = b.item AND a.entity < b.entity GROUP BY 1, 2),
d AS (SELECT i, j, shared, 1 - 2 * shared / (x.n + y.n) AS distance FROM s JOIN n x ON x.entity = i JOIN n y ON y.entity = j)
"""


def _distances(t: Tables) -> DataFrame:
    own = t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey")).join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey"))
    return stats.sorensen(own.select(F.col("c_nationkey").alias("entity"), F.col("l_partkey").alias("item")), "entity", "item")


@query(_SORENSEN + "SELECT i, j, shared, round(distance, 6) AS distance FROM d")
def sorensen_pairs(t: Tables) -> DataFrame:
    return _distances(t).select("i", "j", "shared", F.round("distance", 6).alias("distance"))


#: All pairs of nations, over few of their parts: many pairs share none.
_SPARSE = """
WITH e AS (SELECT DISTINCT c_nationkey AS entity, l_partkey AS item FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey
  WHERE l_quantity >= 49 AND l_linenumber = 1),
n AS (SELECT entity, count(*) AS n FROM e GROUP BY entity),
p AS (
  SELECT a.n_nationkey AS i, b.n_nationkey AS j, a.n_regionkey = b.n_regionkey AS same, a.n_regionkey AS region,
    coalesce(1 - 2.0 * (SELECT count(*) FROM e x JOIN e y ON x.item = y.item WHERE x.entity = a.n_nationkey AND y.entity = b.n_nationkey)
      / ((SELECT n FROM n WHERE entity = a.n_nationkey) + (SELECT n FROM n WHERE entity = b.n_nationkey)), 1.0) AS distance
  FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey)
"""


def _sparse_distances(t: Tables) -> DataFrame:
    few = t.lineitem.where("l_quantity >= 49 and l_linenumber = 1")
    own = t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey")).join(few, F.col("o_orderkey") == F.col("l_orderkey"))
    return stats.sorensen(own, "c_nationkey", "l_partkey")


@query(_SPARSE + "SELECT round(avg(distance) FILTER (WHERE same), 6) AS within, round(avg(distance) FILTER (WHERE NOT same), 6) AS between_ FROM p")
def within_between_gap(t: Tables) -> DataFrame:
    out = stats.within_between(_sparse_distances(t), t.nation, "n_nationkey", "n_regionkey")
    return out.select(F.round("within", 6).alias("within"), F.round("between", 6).alias("between_"))


@query(_SPARSE + """,
r AS (SELECT *, rank() OVER (ORDER BY distance) + (count(*) OVER (PARTITION BY distance) - 1) / 2.0 AS rk FROM p)
SELECT round((avg(rk) FILTER (WHERE NOT same) - avg(rk) FILTER (WHERE same)) / (count(*) / 2.0), 6) AS r, round((SELECT (count(DISTINCT n_regionkey) - 1.0) / (count(*) - 1) FROM nation), 6) AS floor FROM r""")
def anosim_statistic(t: Tables) -> DataFrame:
    """The difference of mean ranks between and within groups, and what a grouping without meaning reaches."""
    r = stats.anosim(_sparse_distances(t), t.nation, "n_nationkey", "n_regionkey")
    floor = stats.null_floor(t.nation, "n_nationkey", "n_regionkey")
    return r.crossJoin(floor).select(F.round("r", 6).alias("r"), F.round("floor", 6).alias("floor"))  # one row each


@query(_SPARSE + """,
b AS (SELECT i, j, distance, region FROM p WHERE same UNION ALL SELECT j, i, distance, region FROM p WHERE same), m AS (SELECT n_regionkey AS region, count(*) AS n FROM nation GROUP BY 1),
z AS (SELECT n_nationkey AS i, n_regionkey AS region, coalesce((SELECT sum(distance * distance) FROM b WHERE b.i = n_nationkey), 0) / n AS own, n FROM nation JOIN m ON region = n_regionkey),
h AS (SELECT region, avg(own) / 2 AS half FROM z GROUP BY region)
SELECT region AS n_regionkey, n, round(avg(sqrt(greatest(0, own - half))), 6) AS spread FROM z JOIN h USING (region) GROUP BY region, n""")
def group_dispersion(t: Tables) -> DataFrame:
    """The mean distance of each group's entities from their centroid."""
    return stats.dispersion(_sparse_distances(t), t.nation, "n_nationkey", "n_regionkey").withColumn("spread", F.round("spread", 6))


@query(_SPARSE + """,
k AS (SELECT count(*) AS n, count(DISTINCT n_regionkey) AS g FROM nation), m AS (SELECT n_regionkey, count(*) AS m FROM nation GROUP BY n_regionkey),
t AS (SELECT sum(distance * distance) / (SELECT n FROM k) AS total FROM p),
w AS (SELECT sum(distance * distance / m) AS within FROM p JOIN m ON n_regionkey = region WHERE same)
SELECT round(((total - within) / (g - 1)) / (within / (n - g)), 6) AS pseudo_f, round(1 - within / total, 6) AS r2 FROM k, t, w""")
def permanova_statistic(t: Tables) -> DataFrame:
    """F and R2 over all pairs, without permutations; the p of permanova rests on deals by hash."""
    out = stats.permanova(_sparse_distances(t), t.nation, "n_nationkey", "n_regionkey", permutations=0)
    return out.select(F.round("pseudo_f", 6).alias("pseudo_f"), F.round("r2", 6).alias("r2"))


@query("""
WITH r AS (SELECT o_custkey, o_orderpriority LIKE '1%' AS good, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders),
f AS (SELECT o_custkey, min(CASE WHEN good THEN k END) AS k FROM r GROUP BY o_custkey)
SELECT round(avg(coalesce(1.0 / k, 0)), 6) AS mrr, count(*) FILTER (WHERE k <= 1) AS hits_1, count(*) FILTER (WHERE k <= 3) AS hits_3, count(*) AS n FROM f""")
def mrr_hits(t: Tables) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    lists = t.orders.select("o_custkey", F.col("o_orderpriority").startswith("1").alias("good"), place.alias("rank"))
    return score.reciprocal_ranks(lists, "o_custkey", "rank", "good").withColumn("mrr", F.round("mrr", 6))


@query("""
WITH reg AS (SELECT s_name AS code, 9000000 + row_number() OVER (ORDER BY s_suppkey) - 1 AS number FROM supplier WHERE s_suppkey % 4 = 0)
SELECT s_name AS code, (SELECT max(number) FROM reg) + row_number() OVER (ORDER BY s_name) AS number FROM supplier WHERE s_suppkey % 4 <> 0""")
def accession_mint(t: Tables) -> DataFrame:
    """Numbers for new codes above a registry's highest."""
    registry = t.supplier.where("s_suppkey % 4 = 0").select(F.col("s_name").alias("code"), (9_000_000 + F.col("s_suppkey") / 4).cast("long").alias("number"))
    return facts.mint(t.supplier.select(F.col("s_name").alias("code")), registry, "code", "number", 9_000_000)


@query("""
WITH k AS (SELECT s_suppkey AS old, 5000 + row_number() OVER (ORDER BY s_suppkey) AS new FROM supplier)
SELECT count(*) AS n, count(*) FILTER (WHERE new < prev) AS breaks FROM (SELECT *, lag(new) OVER (ORDER BY old) AS prev FROM k)""")
def order_preserving_rekey(t: Tables) -> DataFrame:
    """New keys in the order of the old; one row says how often the order breaks."""
    empty = t.spark.createDataFrame([], "old long, new long")
    keys = facts.mint(t.supplier.select(F.col("s_suppkey").alias("old")), empty, "old", "new", 5001)
    return facts.order_breaks(keys, "old", "new")


@query("SELECT CAST(l_partkey % 256 AS INTEGER) AS bucket, count(*) AS n, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY 1")
def bucket_partition(t: Tables) -> DataFrame:
    return t.lineitem.groupBy(numbers.bucket_of("l_partkey").alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("l_partkey").alias("parts"))


@query("""
SELECT 'quantity_positive' AS check_name, count(*) FILTER (WHERE NOT coalesce(l_quantity > 0, false)) = 0 AS passed, count(*) FILTER (WHERE NOT coalesce(l_quantity > 0, false)) AS detail FROM lineitem
UNION ALL SELECT 'discount_share', count(*) FILTER (WHERE NOT coalesce(l_discount BETWEEN 0 AND 0.05, false)) = 0, count(*) FILTER (WHERE NOT coalesce(l_discount BETWEEN 0 AND 0.05, false)) FROM lineitem
UNION ALL SELECT 'orders_exist', count(*) = 0, count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
UNION ALL SELECT 'part_key_unique', count(*) = 0, count(*) FROM (SELECT p_partkey FROM part GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'name_one_to_one', count(*) = 0, count(*) FROM (SELECT n_nationkey FROM nation GROUP BY 1 HAVING count(DISTINCT n_name) > 1)
UNION ALL SELECT 'customers_all_order', count(*) = 0, count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)""")
def verify_contracts(t: Tables) -> DataFrame:
    rows = verify.row_checks(t.lineitem, {"quantity_positive": F.col("l_quantity") > 0, "discount_share": F.col("l_discount").between(0, 0.05)})
    return verify.all_checks(
        rows,
        verify.reference_check(t.lineitem.select("l_orderkey"), "l_orderkey", t.orders, "o_orderkey", "orders_exist"),
        verify.unique_check(t.part, ["p_partkey"], "part_key_unique"),
        verify.one_to_one_check(t.nation, "n_nationkey", "n_name", "name_one_to_one"),
        verify.same_keys_check(t.customer.select(F.col("c_custkey").alias("k")), t.orders.select(F.col("o_custkey").alias("k")), "k", "customers_all_order"),
    )


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_extract_map(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.from_json("props", "map<string,bigint>")["k"].alias("k"))


@query("""
WITH e AS (SELECT p_partkey, (p_size % 4) || ' ' || p_brand || ' + ' || p_type || ' = ' || p_name || ' {r' || p_size || '}' AS equation FROM part),
s AS (SELECT p_partkey, unnest(string_split(regexp_replace(equation, '\\s*\\{[^{}]*\\}\\s*$', ''), '=')) AS side FROM e),
c AS (SELECT p_partkey, trim(regexp_replace(trim(x), '^\\d+(\\.\\d+)?\\s+', '')) AS compound FROM (SELECT p_partkey, unnest(string_split(trim(side), ' + ')) AS x FROM s))
SELECT p_partkey, compound FROM c WHERE length(compound) BETWEEN 1 AND 199""")
def equation_tokens(t: Tables) -> DataFrame:
    equation = F.concat(F.col("p_size") % 4, F.lit(" "), "p_brand", F.lit(" + "), "p_type", F.lit(" = "), "p_name", F.lit(" {r"), "p_size", F.lit("}"))
    return t.part.select("p_partkey", F.explode(text.equation_compounds(equation)).alias("compound"))


@query("""
WITH cur AS (SELECT p_partkey AS k, p_name AS name, p_size AS size FROM part WHERE p_partkey % 3 <> 0), new AS (SELECT p_partkey AS k, upper(p_name) AS name, p_size + 1 AS size FROM part WHERE p_partkey % 5 = 0)
SELECT * FROM cur WHERE size <> 7 AND k NOT IN (SELECT k FROM new) UNION ALL SELECT * FROM new""")
def upsert_last_wins(t: Tables) -> DataFrame:
    """A table with one source's stale rows stripped and new rows put in; of equal keys the new row stays."""
    current = t.part.where("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("name"), F.col("p_size").alias("size"))
    new = t.part.where("p_partkey % 5 = 0").select(F.col("p_partkey").alias("k"), F.upper("p_name").alias("name"), (F.col("p_size") + 1).alias("size"))
    return facts.upsert(current, new, "k", F.col("size") == 7)


@query("""
WITH c AS (SELECT s_suppkey, (s_suppkey % 7) || '.' || (s_nationkey % 12) || '.' || CASE WHEN s_suppkey % 5 = 0 THEN '-' ELSE CAST(s_suppkey AS VARCHAR) END AS code FROM supplier)
SELECT s_suppkey, code, row_number() OVER (ORDER BY TRY_CAST(split_part(code, '.', 1) AS INTEGER) NULLS LAST, TRY_CAST(split_part(code, '.', 2) AS INTEGER) NULLS LAST, TRY_CAST(split_part(code, '.', 3) AS INTEGER) NULLS LAST, s_suppkey) - 1 AS place FROM c""")
def numeric_code_sort(t: Tables) -> DataFrame:
    """Rows in numeric order of their codes; a sorted sink is the only place for a global order."""
    last = F.when(F.col("s_suppkey") % 5 == 0, "-").otherwise(F.col("s_suppkey").cast("string"))
    rows = t.supplier.select("s_suppkey", F.concat(F.col("s_suppkey") % 7, F.lit("."), F.col("s_nationkey") % 12, F.lit("."), last).alias("code"))
    ordered = facts.numeric_code_order(rows, "code", "s_suppkey", levels=3)
    part = ordered.withColumn("_part", F.spark_partition_id()).withColumn("_id", F.monotonically_increasing_id())
    sizes = part.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return part.join(F.broadcast(sizes.select("_part", "_before")), "_part").select("s_suppkey", "code", (F.col("_before") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))).alias("place"))  # one row a partition


@query("""
WITH have AS (SELECT o_custkey, list(DISTINCT o_orderpriority) AS have FROM orders WHERE o_orderstatus = 'O' GROUP BY 1), offer AS (SELECT o_custkey, list(DISTINCT o_orderpriority) AS offered FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
SELECT h.o_custkey, array_to_string(list_sort(list_distinct(list_concat(have, coalesce(offered, [])))), ',') AS have,
  array_to_string(list_sort(list_filter(coalesce(offered, []), lambda x: NOT list_contains(have, x))), ',') AS added FROM have h LEFT JOIN offer o ON h.o_custkey = o.o_custkey""")
def rescue_additive(t: Tables) -> DataFrame:
    have = t.orders.where("o_orderstatus = 'O'").groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("have"))
    offered = t.orders.where("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("offered"))
    out = linkage.rescue(have, offered, "o_custkey", "have", "offered")
    return out.select("o_custkey", F.array_join("have", ",").alias("have"), F.array_join("added", ",").alias("added"))


@query("""
SELECT DISTINCT r.user_id, r.event_type FROM events r WHERE NOT EXISTS (SELECT 1 FROM events o WHERE o.user_id = r.user_id AND o.event_type = r.event_type AND o.value > 50)""")
def complement_diff(t: Tables) -> DataFrame:
    """What the reference has of an entity and the entity's own list lacks."""
    keys = ["user_id", "event_type"]
    return t.events.select(*keys).distinct().join(t.events.where("value > 50").select(*keys), keys, "left_anti")


@query("""
SELECT k.id, trim(substr(k.item, 1)) AS item, k.name FROM (
  SELECT p_partkey AS id, unnest([p_brand, p_type, p_brand]) AS item, unnest([p_name, p_brand, NULL]) AS name FROM part) k""")
def zip_lists(t: Tables) -> DataFrame:
    """Two lists of a cell, differently delimited, side by side; a short one gives nulls."""
    cells = t.part.select(F.col("p_partkey").alias("id"), F.concat_ws(",", "p_brand", "p_type", "p_brand").alias("items"), F.concat_ws("; ", "p_name", "p_brand").alias("names"))
    both = F.arrays_zip(F.split("items", ",").alias("item"), F.split("names", "; ").alias("name"))
    return cells.select("id", F.inline_outer(both))


@query("""
WITH x AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS a, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS b FROM orders)
SELECT o_custkey, round(count(*) FILTER (WHERE a <= 10 AND b <= 10) / count(*) FILTER (WHERE a <= 10 OR b <= 10), 6) AS jaccard FROM x GROUP BY o_custkey""")
def top_list_overlap(t: Tables) -> DataFrame:
    """Jaccard overlap of two top-ten lists of each customer."""
    w = Window.partitionBy("o_custkey")
    rows = t.orders.select("o_custkey", F.row_number().over(w.orderBy(F.desc("o_totalprice"), "o_orderkey")).alias("a"), F.row_number().over(w.orderBy("o_orderdate", "o_orderkey")).alias("b"))
    near = lambda c: F.col(c) <= 10
    return rows.groupBy("o_custkey").agg(F.round(F.count_if(near("a") & near("b")) / F.count_if(near("a") | near("b")), 6).alias("jaccard"))


@query("""
WITH m AS (SELECT l_partkey, l_suppkey, avg(l_quantity) AS a FROM lineitem GROUP BY l_partkey, l_suppkey)
SELECT l_partkey, round(avg(a), 6) AS amount, round(max(a), 6) AS most FROM m GROUP BY l_partkey""")
def mean_of_means(t: Tables) -> DataFrame:
    means = t.lineitem.groupBy("l_partkey", "l_suppkey").agg(F.avg("l_quantity").alias("a"))
    return means.groupBy("l_partkey").agg(F.round(F.avg("a"), 6).alias("amount"), F.round(F.max("a"), 6).alias("most"))


@query("""
SELECT l_orderkey, l_linenumber, last_value(CASE WHEN l_returnflag = 'R' THEN l_partkey END IGNORE NULLS) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_extendedprice, l_partkey, l_suppkey ROWS UNBOUNDED PRECEDING) AS filled FROM lineitem""")
def header_forward_fill(t: Tables) -> DataFrame:
    """Cells of a merged header take the last written one before them."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_extendedprice", "l_partkey", "l_suppkey").rowsBetween(Window.unboundedPreceding, 0)
    return t.lineitem.select("l_orderkey", "l_linenumber", F.last(F.when(F.col("l_returnflag") == "R", F.col("l_partkey")), ignorenulls=True).over(w).alias("filled"))


@query()
def greedy_basket(t: Tables) -> DataFrame:
    item_facts = _item_facts(t)
    weights = _weights(item_facts)
    amounts = _entity_targets(t).join(item_facts, "nutrient").withColumn("category", F.split("item", " ")[0])
    return score.greedy_basket(amounts, weights, "entity", "item", "nutrient", "amount", "category", 8)


@query()
def diversity_cap(t: Tables) -> DataFrame:
    slate = _slate(t).withColumn("category", F.split("item", " ")[0]).select("entity", "item", "score", "category")
    return score.diversity_cap(slate, "entity", "item", "score", ["category"], 10)


@query("""
WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2), t AS (SELECT user_id, sum(n) AS total FROM c GROUP BY 1)
SELECT user_id, CAST(total AS BIGINT) AS total, CASE WHEN total >= 5 THEN round(sum(1 - CASE WHEN total - n < 5 THEN 0 ELSE
  ((total - n) * (total - n - 1) * (total - n - 2) * (total - n - 3) * (total - n - 4))::DOUBLE / (total * (total - 1) * (total - 2) * (total - 3) * (total - 4)) END), 6) END AS expected
FROM c JOIN t USING (user_id) GROUP BY user_id, total""")
def rarefaction_expectation(t: Tables) -> DataFrame:
    """Expected kinds among five draws of each user's events."""
    counts = t.events.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    return stats.rarefied(counts, "user_id", "event_type", "n", 5).withColumn("expected", F.round("expected", 6))


@query()
def permanova(t: Tables) -> DataFrame:
    return stats.permanova(_distances(t), t.nation.select(F.col("n_nationkey").alias("entity"), F.col("n_regionkey").alias("g")), "entity", "g", 999)


@query("""
SELECT s_suppkey AS query, s_nationkey AS id, round((length('NATION_' || s_nationkey) - 1.0) / length('NATION_' || s_nationkey), 6) AS ratio FROM supplier""")
def fuzzy_match(t: Tables) -> DataFrame:
    """Written names of suppliers' nations with a slip, matched by similarity within blocks."""
    asked = t.supplier.select("s_suppkey", F.concat(F.lit("NACION_"), "s_nationkey").alias("name"))
    return linkage.blocked_similarity(asked, t.nation, "s_suppkey", "name", "n_nationkey", "n_name", 0.8).withColumn("ratio", F.round("ratio", 6))


@query("""
SELECT s_suppkey, 'Genus' || (s_nationkey % 5) AS genus, 'Genus' || (s_nationkey % 5) || ' species' || s_nationkey || CASE WHEN s_suppkey % 3 = 0 THEN ' subsp. sub' ELSE '' END AS species,
  CASE WHEN s_suppkey % 3 = 0 THEN 'X1' END AS strain FROM supplier""")
def organism_split(t: Tables) -> DataFrame:
    """Parts of composed names, parsed once for each distinct name."""
    names = t.supplier.select(F.concat(F.lit("Genus"), F.col("s_nationkey") % 5, F.lit(" species"), F.col("s_nationkey"), F.when(F.col("s_suppkey") % 3 == 0, " subsp. sub str. X1").otherwise("")).alias("name"), "s_suppkey")
    parsed = names.select("name").distinct().withColumn("p", text.split_organism("name"))
    return names.join(parsed, "name").select("s_suppkey", "p.genus", "p.species", "p.strain")
