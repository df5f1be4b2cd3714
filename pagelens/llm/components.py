"""Connected components by local contraction with random priorities.

Each round every node takes the node of least priority among itself and its
neighbours, and the edges are rewritten to those nodes and made distinct. Priorities
are hashes of the id, drawn anew every second round: a star is done in two rounds,
and whatever the order of the ids, a path loses about half of its nodes in each new
draw, so a component of n nodes takes O(log n) rounds (tests bound a path of 4,096
nodes). Edges that have met go, so the tables shrink from round to round, and the
maps of all rounds are composed from the last, smallest one backwards.

The minimum is combined before the shuffle, so a node with very many edges costs no
more than another one, and all joins are plain equality joins, which adaptive
execution splits where a key is hot. Every round's edges and map are written to the
shared folder.

Defined results: edges with a null end and loops are ignored; without edges the
result is empty; the order of rows and partitions has no influence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(edges: DataFrame, scratch: Scratch, log: list | None = None) -> DataFrame:
    """node, component (the smallest node reachable) of each node that has an edge (a, b). log: gets a number for each round."""
    edges = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a is not null and b is not null and a < b").distinct()
    edges = scratch.put(edges, "edges")
    maps: list[DataFrame] = []
    while not edges.isEmpty():
        priority = lambda x, seed=len(maps) // 2: F.xxhash64(F.lit(seed), F.col(x))
        a, b = (F.struct(priority(x).alias("h"), F.col(x).alias("v")) for x in "ab")
        least = F.least(a, b)
        ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("u"), least.alias("m")), F.struct(F.col("b").alias("u"), least.alias("m")))).alias("e"))
        taken = scratch.put(ends.groupBy(F.col("e.u").alias("u")).agg(F.min("e.m").getField("v").alias("m")), "taken")
        maps.append(taken)
        moved = edges.join(taken.toDF("a", "ma"), "a").join(taken.toDF("b", "mb"), "b")
        fresh = moved.select(F.least("ma", "mb").alias("a"), F.greatest("ma", "mb").alias("b")).where("a < b").distinct()
        old, edges = edges, scratch.put(fresh, "edges")
        scratch.drop(old)
        if log is not None:
            log.append(len(maps))
    scratch.drop(edges)
    if not maps:
        return edges.sparkSession.createDataFrame([], "node long, component long")
    # A node that a map names is either in the next one or done.
    over = maps[-1]
    for earlier in reversed(maps[:-1]):
        over = earlier.join(over.toDF("m", "n"), "m", "left").select("u", F.coalesce("n", "m").alias("m"))
    over = scratch.put(over, "over")
    # Written, so that the join deals both sides afresh and a component of many nodes can be split.
    smallest = scratch.put(over.groupBy("m").agg(F.min("u").alias("component")), "smallest")
    labels = scratch.put(over.join(smallest, "m").select(F.col("u").alias("node"), "component"), "labels")
    scratch.drop(*maps, over, smallest)
    return labels
