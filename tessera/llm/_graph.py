"""Connected components of a link table, in DataFrame operations alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import forget, settle


def _renamed(links: DataFrame, names: DataFrame) -> DataFrame:
    """Links between the components of their ends, once each, the smaller end first; ends without a name stay."""
    for end in ("a", "b"):
        links = links.join(names.toDF(end, f"of_{end}"), end, "left")
    a, b = F.coalesce("of_a", "a"), F.coalesce("of_b", "b")
    return links.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a <> b").distinct()


def components(edges: DataFrame, left: str = "a", right: str = "b", known: DataFrame | None = None) -> DataFrame:
    """(node, component) for every end of a link; component is the smallest node reachable.

    Each round sends a node to the smallest of itself and its neighbours, follows
    these steps to their ends by doubling, and goes on with the links between
    different ends alone: those inside a star are looked at once.  Messages are
    reduced map-side before the shuffle.  Each round is written to the shared
    folder, which cuts lineage.  ``known``, a result for other links, stands for
    these, and its nodes are in the result.  No links give no rows; self-links
    and repeated links don't matter.
    """
    a, b = F.col(left).alias("a"), F.col(right).alias("b")
    links = edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a <> b").distinct()
    labels = known if known is not None else settle(links.toDF("node", "component").limit(0))
    links = settle(links if known is None else _renamed(links, known))
    while not links.isEmpty():
        both = links.union(links.select("b", "a"))
        ends = settle(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("component")))
        while True:
            further = ends.toDF("component", "further")
            new = settle(ends.join(further, "component").select("node", F.col("component").alias("was"), F.col("further").alias("component")))
            done = new.where("was <> component").isEmpty()
            forget(ends)
            ends = new.select("node", "component")
            if done:
                break
        moved = labels.join(ends.toDF("component", "end"), "component", "left").select("node", F.coalesce("end", "component").alias("component"))
        joined = settle(moved.union(ends.join(labels.select("node"), "node", "left_anti").select("node", "component")))
        over = settle(_renamed(links, ends))
        forget(links, ends, *(() if labels is known else (labels,)))
        labels, links = joined, over
    forget(links)
    return labels
