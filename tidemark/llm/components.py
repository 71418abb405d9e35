"""Connected components of a link table, as Spark joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.session import written

#: A node with more than one in so many edges does not go through a shuffle by itself.
HEAVY = 1000


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _tied(edges: DataFrame, least: DataFrame, rows: int) -> DataFrame:
    """Edges (u, v, m) with the smallest neighbour ``m`` of ``u``, given ``rows`` edges at most.

    Nodes with more than 1 in ``HEAVY`` of the edges, which are fewer than that, are broadcast;
    their edges are dealt by the other end, so that no task gets all edges of such a node.
    """
    heavy = F.broadcast(least.where(F.col("degree") * HEAVY > rows).select("u", F.col("m").alias("known")))
    dealt = edges.join(heavy, "u", "left").withColumn("k", F.when(F.col("known").isNull(), F.col("u")).otherwise(F.col("v")))
    found = dealt.join(least.select(F.col("u").alias("k"), "m"), "k", "left")
    return found.select("u", "v", F.coalesce("known", "m").alias("m"))


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node in a link: the smallest node that can be reached.

    Large stars and small stars in turn: each node's neighbours are tied to the smallest of
    them, until nothing changes, in a number of rounds that grows with the logarithm of the
    nodes. Each round is a written table, so a lost executor costs one round at most. Links
    with a null end and links of a node to itself say nothing and are dropped.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    edges = written(edges.distinct(), "links")
    state = _state(edges)
    while True:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("degree")).select("u", F.least("u", "m").alias("m"), "degree")
        large = _tied(both, least, 2 * state[0]).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("degree"))
        small = _tied(large, least, state[0]).where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = written(small.unionAll(least.select("u", F.col("m").alias("v"))).distinct(), "links")
        before, state = state, _state(edges)
        if state == before:
            break
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(roots)
