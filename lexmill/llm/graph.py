"""Connected components of a graph that never leaves the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.scratch import Scratch


def _is_star_forest(e: DataFrame) -> bool:
    """Whether each u has one v, and no v is a u."""
    ends = e.selectExpr("u AS node", "1 AS child", "0 AS parent").unionByName(e.selectExpr("v AS node", "0 AS child", "1 AS parent"))
    return ends.groupBy("node").agg(F.sum("child").alias("child"), F.max("parent").alias("parent")).where("child > 1 OR child = 1 AND parent = 1").isEmpty()


def labels(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, label): labels by two hops towards smaller nodes. Equal labels are connected; connected nodes may differ."""
    both = edges.selectExpr("a AS node", "b AS y").unionByName(edges.selectExpr("b AS node", "a AS y"))
    near = scratch.table(both.groupBy("node").agg(F.min("y").alias("y")).selectExpr("node", "least(node, y) AS label"), "near")
    return near.join(near.selectExpr("node AS label", "label AS next"), "label", "left").selectExpr("node", "coalesce(next, label) AS label")


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) for every node of ``edges`` (a long, b long); component is the smallest node reachable.

    Alternates the large-star and small-star steps of Kiveris et al. (2014) until the edges
    are stars. Minima are pre-aggregated by node and written, so that the join that
    hands them back is a plain sort-merge join whose hub nodes adaptive execution splits.
    """

    e = scratch.table(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    while not _is_star_forest(e):
        both = e.selectExpr("u AS x", "v AS y").unionByName(e.selectExpr("v AS x", "u AS y"))
        low = scratch.table(both.groupBy("x").agg(F.min("y").alias("m")).selectExpr("x", "least(x, m) AS m"), "large")
        large = scratch.table(both.where("y > x").join(low, "x").selectExpr("y AS u", "m AS v").distinct(), "large-star")
        low = scratch.table(large.groupBy("u").agg(F.min("v").alias("m")), "small")
        e = scratch.table(large.join(low, "u").where("v <> m").selectExpr("v AS u", "m AS v").unionByName(low.selectExpr("u", "m AS v")).distinct(), "small-star")
    return e.selectExpr("u AS node", "v AS component").unionByName(e.selectExpr("v AS node", "v AS component").distinct())
