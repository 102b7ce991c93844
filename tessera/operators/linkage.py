"""Linking names to things: inverted views, ladders, blocked similarity, winners among hits."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import name_views, sequence_ratio


def inverted_index(names: DataFrame, id_: str, name: str, views: Sequence[str] = ("norm", "no_commas", "no_paren", "compact")) -> DataFrame:
    """(view, key, id): each name under each of its views once."""
    made = name_views(name)
    pairs = F.explode(F.array(*(F.struct(F.lit(v).alias("view"), made[v].alias("key")) for v in views)))
    return names.select(F.col(id_).alias("id"), pairs.alias("p")).select("p.view", "p.key", "id").where("key <> ''").distinct()


def view_match(queries: DataFrame, index: DataFrame, id_: str, name: str, weights: dict[str, int]) -> DataFrame:
    """(query, id, view, score): hits of a query in the same view, the best view of each pair."""
    asked = inverted_index(queries, id_, name, tuple(weights)).withColumnRenamed("id", "query")
    score = reduce(lambda out, v: F.when(F.col("view") == v, weights[v]).otherwise(out), weights, F.lit(0))
    hits = asked.join(index, ["view", "key"]).withColumn("score", score)
    return hits.groupBy("query", "id").agg(F.max_by("view", F.struct("score", "view")).alias("view"), F.max("score").alias("score"))


def ladder(rows: DataFrame, rungs: Sequence[tuple[str, DataFrame, Column, str]], target: str) -> DataFrame:
    """Adds target and rung: the first rung (name, table, key of the row, key of the table) that matches.

    Each table is reduced to the least target of each key first, so rows never multiply.
    """
    out = rows
    for i, (_, table, key, table_key) in enumerate(rungs):
        side = table.groupBy(F.col(table_key).alias(f"_k{i}")).agg(F.min(target).alias(f"_t{i}"))
        out = out.withColumn(f"_q{i}", key).join(side, F.col(f"_q{i}") == F.col(f"_k{i}"), "left")
    rung = F.coalesce(*(F.when(F.col(f"_t{i}").isNotNull(), F.lit(name)) for i, (name, *_) in enumerate(rungs)))
    return out.select(*rows.columns, F.coalesce(*(F.col(f"_t{i}") for i in range(len(rungs)))).alias(target), rung.alias("rung"))


def blocked_similarity(queries: DataFrame, names: DataFrame, query_id: str, query: str, id_: str, name: str, cutoff: float = 0.9, bin_width: int = 5, longest_bin: int = 25) -> DataFrame:
    """(query, id, ratio): the most similar name of each query over ``cutoff``.

    Names are compared only with the same first letter or digit and a length bin that
    is the query's own or next to it, and only where their lengths
    leave the cutoff possible.  The similarity of a pair of texts is computed once
    however many rows have them.  Queries without a match are asked again with the
    words of both in order.
    """
    found = _blocked(queries, names, query_id, query, id_, name, cutoff, bin_width, longest_bin)
    rest = queries.join(found.select(F.col("query").alias(query_id)), query_id, "left_anti")
    in_order = lambda c: F.array_join(F.array_sort(F.split(F.trim(F.regexp_replace(c, r"\s+", " ")), " ")), " ")
    again = _blocked(rest.withColumn(query, in_order(query)), names.withColumn(name, in_order(name)), query_id, query, id_, name, cutoff, bin_width, longest_bin)
    return found.union(again)


def _blocked(queries: DataFrame, names: DataFrame, query_id: str, query: str, id_: str, name: str, cutoff: float, bin_width: int, longest_bin: int) -> DataFrame:
    first = lambda c: F.regexp_extract(F.lower(F.col(c)), r"[a-z0-9]", 0)
    bin_of = lambda c: F.least(F.floor(F.length(c) / bin_width) * bin_width, F.lit(longest_bin))
    near = F.explode(F.array_distinct(F.array(*(F.least(bin_of(query) + d, F.lit(longest_bin)) for d in (-bin_width, 0, bin_width)))))
    asked = queries.select(F.col(query).alias("_q"), first(query).alias("_f"), near.alias("_b")).distinct()
    known = names.select(F.col(name).alias("_n"), first(name).alias("_f"), bin_of(name).alias("_b")).distinct()
    a, b = F.length("_q"), F.length("_n")
    pairs = asked.join(known, ["_f", "_b"]).where(2 * F.least(a, b) >= cutoff * (a + b)).select("_q", "_n").distinct()
    close = pairs.withColumn("ratio", sequence_ratio("_q", "_n")).where(F.col("ratio") >= cutoff)
    hits = queries.select(F.col(query_id).alias("query"), F.col(query).alias("_q")).join(close, "_q").join(names.select(F.col(id_).alias("id"), F.col(name).alias("_n")), "_n")
    return hits.groupBy("query").agg(F.min_by(F.struct("id", "ratio"), F.struct(-F.col("ratio"), F.col("id"))).alias("best")).select("query", "best.id", "best.ratio")


def keep_winners(hits: DataFrame, key: str, score: str, gap: float = 20, within: float = 8, curated: Column | None = None) -> DataFrame:
    """Hits kept: the best alone (ties too) where it leads the next score by ``gap``, else all ``within`` of it.

    With ``curated``, a key whose kept hits have no curated one also keeps the
    curated hits within ``within`` of the best curated one.
    """
    w = Window.partitionBy(key)
    level = F.dense_rank().over(w.orderBy(F.desc(score)))
    out = hits.withColumn("_best", F.max(score).over(w)).withColumn("_level", level)
    out = out.withColumn("_second", F.max(F.when(F.col("_level") == 2, F.col(score))).over(w))
    alone = F.col("_second").isNull() | (F.col("_best") - F.col("_second") >= gap)
    kept = F.when(alone, F.col("_level") == 1).otherwise(F.col(score) >= F.col("_best") - within)
    out = out.withColumn("_kept", kept)
    if curated is not None:
        out = out.withColumn("_star", F.coalesce(curated, F.lit(False)))
        out = out.withColumn("_has", F.max(F.col("_kept") & F.col("_star")).over(w)).withColumn("_top", F.max(F.when(F.col("_star"), F.col(score))).over(w))
        out = out.withColumn("_kept", F.col("_kept") | (~F.col("_has") & F.col("_star") & (F.col(score) >= F.col("_top") - within)))
    return out.where("_kept").select(*hits.columns)


def rescue(rows: DataFrame, table: DataFrame, key: str, have: str, offered: str) -> DataFrame:
    """Adds items that a curated table offers for a row's key to those it has; nothing is ever removed."""
    side = table.groupBy(key).agg(F.array_distinct(F.flatten(F.collect_list(offered))).alias("_offered"))
    out = rows.join(side, key, "left").withColumn("_offered", F.coalesce("_offered", F.array().cast("array<string>")))
    return out.withColumn("added", F.array_sort(F.array_except("_offered", have))).withColumn(have, F.array_sort(F.array_union(have, "_offered"))).drop("_offered")
