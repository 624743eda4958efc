"""Connected components of links, without gathering any component in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retailflow.llm.common import forget, staged


def components(links: DataFrame) -> DataFrame:
    """(a, b) links -> (id, component): the smallest id reachable, for every linked id.

    Alternates large-star and small-star steps: every node links its larger neighbours,
    then its smaller ones, to the smallest it knows. Hubs only ever take part in
    map-side-combined minima and joins that adaptive execution may split. Each round is
    written to the shared folder; rounds grow with the logarithm of the longest path.
    """
    spark = links.sparkSession
    old: list = []
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    edges = staged(spark, edges, "components", old)
    while True:
        # large star: larger neighbours of a node go to the node's smallest neighbour
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small star: a node and its smaller neighbours go to the smallest of them
        low = large.where("u <> v").distinct()
        down = low.groupBy("u").agg(F.min("v").alias("m"))
        small = low.join(down, "u")
        small = small.select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e"))
        new: list = []
        following = small.select(F.col("e.u").alias("u"), F.col("e.m").alias("v")).where("u <> v").distinct()
        following = staged(spark, following, "components", new)
        # done when every child has one parent and no parent is a child
        ends = F.explode(F.array(F.struct(F.col("u").alias("id"), F.lit(1).alias("n")), F.struct(F.col("v").alias("id"), F.lit(0).alias("n"))))
        roles = following.select(ends.alias("e")).groupBy("e.id")
        roles = roles.agg(F.sum("e.n").alias("parents"), F.min("e.n").alias("least"))
        open_ = roles.where("parents > 1 or (parents = 1 and least = 0)").limit(1).count()
        forget(spark, old)
        edges, old = following, new
        if not open_:
            break
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)


def shared_ids(rows: DataFrame, content) -> DataFrame:
    """Stand-ins for ids that stand for several contents: (id, content, node), written.

    ``rows`` has ``id``; ``content`` is a hash of what the id stands for. Nodes are numbers
    below all ids.
    """
    seen = rows.select("id", content.alias("content")).where("id is not null")
    many = seen.groupBy("id").agg(F.min("content").alias("a"), F.max("content").alias("b")).where("a <> b")
    least = min(0, seen.agg(F.min("id")).first()[0])
    nodes = seen.join(many.select("id"), "id", "left_semi").distinct()
    nodes = nodes.withColumn("node", F.lit(least - 1) - F.monotonically_increasing_id())
    return staged(rows.sparkSession, nodes, "shared-ids")


def over_ids(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """Components over ids from those of nodes: rows of one id are one.

    ``found`` has node and component (both nodes, or ids that needed none). Returns node,
    id and component: the smallest id reachable.
    """
    found = found.select("node", "component").distinct()
    # what shares an id hangs together
    first = nodes.groupBy("id").agg(F.min("node").alias("b"))
    shared = nodes.join(first, "id").select(F.col("node").alias("a"), "b")
    labels = components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(shared))
    named = found.join(labels.select(F.col("id").alias("node"), F.col("component").alias("joined")), "node", "left")
    named = named.join(nodes.select("node", "id"), "node", "left")
    named = named.select("node", F.coalesce("id", "node").alias("id"), F.coalesce("joined", "component").alias("label"))
    least = named.groupBy("label").agg(F.min("id").alias("component"))
    return named.join(least, "label").select("node", "id", "component")
