"""Risk of nodes in a directed edge list: degrees, share of illicit neighbours, and the bridge to accounts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NOTE = "synthetic linkage: ratio drawn from the empirical distribution of the reference graph"


def degrees(edges: DataFrame) -> DataFrame:
    """node, out_degree, in_degree; parallel edges count. One pass over the edges and one shuffle: both directions are summed together."""
    end = lambda node, o, i: F.struct(F.col(node).alias("node"), F.lit(o).alias("o"), F.lit(i).alias("i"))
    both = edges.select(F.inline(F.array(end("src", 1, 0), end("dst", 0, 1))))
    return both.groupBy("node").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def neighbour_counts(edges: DataFrame, classes: DataFrame) -> DataFrame:
    """node, illicit and known neighbours, either direction, parallel edges counted. Edges meet the classes as they are, since few are parallel, and are summed up by node in the tasks of that join."""
    way = lambda a, b: F.struct(F.col(a).alias("node"), F.col(b).alias("other"))
    both = edges.select(F.inline(F.array(way("src", "dst"), way("dst", "src"))))
    known = both.join(classes.select(F.col("node").alias("other"), "class"), "other")
    return known.groupBy("node").agg(F.count_if(F.col("class") == "1").alias("illicit"), F.count_if(F.col("class").isin("1", "2")).alias("known"))


def illicit_ratio(edges: DataFrame, classes: DataFrame) -> DataFrame:
    """node, illicit_neighbor_ratio; null without a known neighbour."""
    return neighbour_counts(edges, classes).select("node", F.when(F.col("known") > 0, F.col("illicit") / F.col("known")).alias("illicit_neighbor_ratio"))


def node_risk(classes: DataFrame, edges: DataFrame) -> DataFrame:
    """All classified nodes with degrees (0 by default) and ratio."""
    out = classes.join(degrees(edges), "node", "left").join(illicit_ratio(edges, classes), "node", "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("out_degree", "in_degree")})


def network_reference(accounts: DataFrame, ratios: DataFrame, percent: int = 5, points: int = 1000) -> DataFrame:
    """About percent of accounts draw a ratio from the empirical distribution (its `points` quantiles), by hash of id."""
    found = ratios.where("illicit_neighbor_ratio IS NOT NULL").agg(F.percentile_approx("illicit_neighbor_ratio", [(i + 0.5) / points for i in range(points)], 100 * points // 10).alias("q"))
    drawn = accounts.select("account_id").where(F.pmod(F.xxhash64("account_id", F.lit(1)), F.lit(10_000)) < percent * 100)
    at = F.pmod(F.xxhash64("account_id", F.lit(2)), F.lit(points)).cast("int")
    return drawn.crossJoin(F.broadcast(found)).select("account_id", F.get("q", at).alias("network_risk_exposure"), F.lit(NOTE).alias("linkage_note")).where("network_risk_exposure IS NOT NULL")
