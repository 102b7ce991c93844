"""Scoring of (entity, item) pairs by saturating gains, ranking, peers, baskets and caps."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.numbers import breadth, saturating_gain


@dataclass(frozen=True)
class Kernel:
    """Weights of the score (the published defaults)."""

    processing: float = 0.20
    broad: float = 0.20
    broad_power: float = 2.0
    tier: float = 0.25
    overlap: float = 0.60
    repeat: float = 0.20
    candidates: int = 1000
    plant_candidates: int = 800
    other_candidates: int = 200


def inverse_frequency(facts: DataFrame, item: str, nutrient: str) -> DataFrame:
    """(nutrient, df, idf): 1 + ln(items / items with the nutrient)."""
    total = facts.agg(F.countDistinct(item).alias("_n"))
    return facts.groupBy(nutrient).agg(F.countDistinct(item).alias("df")).crossJoin(F.broadcast(total)).withColumn("idf", 1 + F.log(F.col("_n") / F.col("df"))).drop("_n")  # the total is one row


def carrier_share(targets: DataFrame, entity: str, nutrient: str) -> DataFrame:
    """(nutrient, carriers, share): entities that carry a nutrient among all entities."""
    total = targets.agg(F.countDistinct(entity).alias("_n"))
    return targets.groupBy(nutrient).agg(F.countDistinct(entity).alias("carriers")).crossJoin(F.broadcast(total)).withColumn("share", F.col("carriers") / F.col("_n")).drop("_n")


def clean_slate(targets: DataFrame, facts: DataFrame, weights: DataFrame, entity: str, item: str, nutrient: str, amount: str) -> DataFrame:
    """(entity, item, gain, improved, score) for every pair, from nothing eaten: one join and one aggregation.

    weights has the nutrient, weight and scale (the amount at which the gain bends).
    """
    pairs = targets.select(entity, nutrient).distinct().join(facts, nutrient).join(weights, nutrient)
    value = F.col("weight") * saturating_gain(F.col(amount), F.col("scale"))
    out = pairs.groupBy(entity, item).agg(F.sum(value).alias("gain"), F.count_if(F.col(amount) > 0).alias("improved"))
    return out.withColumn("score", F.log1p("gain") * breadth(F.col("improved")))


def purity_toll(scored: DataFrame, model_count: str, kernel: Kernel = Kernel()) -> DataFrame:
    """The score less the toll of items that hold much besides what is wanted."""
    purity = F.col("improved") / F.greatest(F.lit(50), F.col(model_count))
    return scored.withColumn("purity", purity).withColumn("score", F.col("score") - kernel.broad * F.pow(1 - purity, kernel.broad_power) * F.log1p("gain"))


def community_weights(weights: DataFrame, shares: DataFrame, nutrient: str, alpha: float = 1.0) -> DataFrame:
    """Weights of nutrients times the share of entities that carry them, to a power; nutrients of no entity weigh nothing."""
    out = weights.join(shares.select(nutrient, "share"), nutrient, "left")
    return out.withColumn("weight", F.col("weight") * F.pow(F.coalesce("share", F.lit(0.0)), F.lit(alpha))).drop("share")


def formula(scored: DataFrame, kind: str = "full", kernel: Kernel = Kernel()) -> DataFrame:
    """The score by one of the published formulas, from gain, improved, purity and processing.

    "gain_only" is the gain's breadth alone; "full" takes the tolls of processing and of what else an item holds;
    "explicit_admission" is the gain alone for items whose full score is positive, and nothing for others.
    """
    gain = F.log1p("gain") * breadth(F.col("improved"))
    tolls = (kernel.processing * F.col("processing") + kernel.broad * F.pow(1 - F.col("purity"), kernel.broad_power)) * F.log1p("gain")
    kinds = {"gain_only": gain, "full": gain - tolls, "explicit_admission": F.when(gain - tolls > 0, gain).otherwise(0.0)}
    return scored.withColumn("score", kinds[kind])


def portions(facts: DataFrame, category: str, amount: str, spices: str = "Spices and Herbs", allow: bool = False, share: float = 0.02) -> DataFrame:
    """Facts without spices, or with spices at the share of 100 g that is eaten of them."""
    spice = F.coalesce(F.col(category) == spices, F.lit(False))
    return facts.withColumn(amount, F.when(spice, F.col(amount) * share).otherwise(F.col(amount))) if allow else facts.where(~spice)


def scored_items(items: DataFrame, type_: str, category: str, types: tuple[str, ...] = ("branded_food", "survey_fndds_food"), categories: tuple[str, ...] = ()) -> DataFrame:
    """Items that are scored: not of the label or recipe types, and of no dropped category; nulls are neither."""
    return items.where(~F.coalesce(F.col(type_).isin(*types), F.lit(False)) & ~F.coalesce(F.col(category).isin(*categories), F.lit(False)))


def ranked(df: DataFrame, by: str, score: str, tie: str, k: int) -> DataFrame:
    """The k best of each group, with rank from 1.

    Spark prunes groups to k rows before the shuffle for a rank under a limit.
    """
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(score), tie))
    return df.withColumn("rank", place).where(F.col("rank") <= k)


def peer_gate(scored: DataFrame, entity: str, item: str, score: str, min_peers: int = 20) -> DataFrame:
    """Rows above their item's median over all entities, with the median, mean and number of peers.

    With fewer than ``min_peers`` peers there is no comparison and the median counts as 0.
    """
    peers = scored.groupBy(item).agg(F.median(score).alias("_median"), F.avg(score).alias("peer_mean"), F.count(F.lit(1)).alias("peer_n"))
    out = scored.join(peers, item).withColumn("peer_median", F.when(F.col("peer_n") >= min_peers, F.col("_median")).otherwise(F.lit(0.0))).drop("_median")
    return out.withColumn("comp_score", F.col(score) - F.col("peer_median")).where((F.col("comp_score") > 0) & (F.col(score) > 0))


def diversity_cap(scored: DataFrame, entity: str, item: str, score: str, groups: list[str], k: int, cap: int = -1) -> DataFrame:
    """The k best of each entity with at most ``cap`` rows of one value in each of ``groups``, filled up in order if starved.

    cap -1 is max(2, round(0.4 k)); 0 is none.  Only rows that could be taken reach the sequential step: with g groups,
    rows over the (k)-th of each value of the first group can't be among the capped ones before the fill.
    """
    limit = cap if cap >= 0 else max(2, round(0.4 * k))
    schema = T.StructType([*scored.schema.fields, T.StructField("rank", T.IntegerType())])

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([score, item], ascending=[False, True], kind="stable")
        seen: list[dict] = [{} for _ in groups]
        taken, rest = [], []
        for i, values in zip(pdf.index, pdf[groups].itertuples(index=False)):
            if len(taken) == k:
                break
            if limit and any(s.get(v, 0) >= limit for s, v in zip(seen, values)):
                rest.append(i)
                continue
            taken.append(i)
            for s, v in zip(seen, values):
                s[v] = s.get(v, 0) + 1
        chosen = set(taken + rest[: k - len(taken)])
        out = pdf[[i in chosen for i in pdf.index]].copy()
        out["rank"] = range(1, len(out) + 1)
        return out

    # Of a combination of values, no more than k rows can ever be taken.
    place = F.row_number().over(Window.partitionBy(entity, *groups).orderBy(F.desc(score), item))
    few = scored.withColumn("_p", place).where(F.col("_p") <= k).drop("_p")
    return few.groupBy(entity).applyInPandas(pick, schema)


def differential(scored: DataFrame, entity: str, item: str, score: str, groups: list[str], k: int = 10, cap: int = -1, min_peers: int = 20, rank: str = "score") -> DataFrame:
    """Each entity's items above their peers, ranked by their own score (or by the difference, "comp_score"), with no group too often."""
    admitted = peer_gate(scored, entity, item, score, min_peers)
    return diversity_cap(admitted, entity, item, score if rank == "score" else "comp_score", groups, k, cap)


def greedy_basket(amounts: DataFrame, weights: DataFrame, entity: str, item: str, nutrient: str, amount: str, category: str, k: int, kernel: Kernel = Kernel(), plants: Sequence[str] = ()) -> DataFrame:
    """(entity, rank, item, score): items chosen one by one, each for what it adds to those before.

    A choice's amounts count as eaten; overlap with what is covered and a
    category taken before cost.  The best ``candidates`` items by clean-slate
    gain go into the sequence, so a group is bounded; with ``plants`` (categories),
    ``plant_candidates`` of these and ``other_candidates`` of the rest.
    """
    value = F.col("weight") * saturating_gain(F.col(amount), F.col("scale"))
    rows = amounts.join(weights, nutrient).withColumn("_v", value)
    total = rows.groupBy(entity, item).agg(F.sum("_v").alias("_total"))
    if plants:
        kinds = amounts.groupBy(item).agg(F.max(F.col(category).isin(*plants)).alias("_plant"))
        place = F.row_number().over(Window.partitionBy(entity, "_plant").orderBy(F.desc("_total"), item))
        limit = F.when(F.col("_plant"), kernel.plant_candidates).otherwise(kernel.other_candidates)
        best = total.join(kinds, item).withColumn("_p", place).where(F.col("_p") <= limit).select(entity, item)
    else:
        best = ranked(total, entity, "_total", item, kernel.candidates).select(entity, item)
    rows = rows.join(best, [entity, item]).select(entity, item, nutrient, category, F.col(amount).alias("_a"), "weight", "scale")

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        items = {i: list(zip(g[nutrient], g["_a"], g["weight"], g["scale"])) for i, g in pdf.groupby(item, sort=True)}
        kind = pdf.groupby(item)[category].first().to_dict()
        current: dict = {}
        kinds: dict = {}
        out: list[tuple] = []
        while items and len(out) < k:
            top, best = None, -math.inf
            for i, parts in items.items():
                gain = sum(w * (math.log1p((current.get(n, 0.0) + a) / s) - math.log1p(current.get(n, 0.0) / s)) for n, a, w, s in parts)
                shared = sum(current.get(n, 0.0) > 0 for n, *_ in parts) / len(parts)
                score = math.log1p(gain) * math.sqrt(len(parts) / (len(parts) + 2)) - kernel.overlap * shared - kernel.repeat * kinds.get(kind[i], 0)
                if score > best:
                    top, best = i, score
            for n, a, *_ in items.pop(top):
                current[n] = current.get(n, 0.0) + a
            kinds[kind[top]] = kinds.get(kind[top], 0) + 1
            out.append((pdf[entity].iloc[0], len(out) + 1, top, round(best, 9)))
        return pd.DataFrame(out, columns=[entity, "rank", item, "score"])

    types = {f.name: f.dataType.simpleString() for f in amounts.schema.fields}
    return rows.groupBy(entity).applyInPandas(choose, f"{entity} {types[entity]}, rank int, {item} {types[item]}, score double")


def reciprocal_ranks(lists: DataFrame, query: str, rank: str, relevant: str) -> DataFrame:
    """One row: mean reciprocal rank and hits at 1 and 3; a query without a relevant item counts 0."""
    first = lists.groupBy(query).agg(F.min(F.when(F.col(relevant), F.col(rank))).alias("r"))
    return first.agg(F.avg(F.coalesce(1 / F.col("r"), F.lit(0.0))).alias("mrr"), F.count_if(F.col("r") <= 1).alias("hits_1"), F.count_if(F.col("r") <= 3).alias("hits_3"), F.count(F.lit(1)).alias("n"))
