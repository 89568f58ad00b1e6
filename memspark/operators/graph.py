"""Expansion, shortest paths and components of the link graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import settled


def both_ways(links: DataFrame) -> DataFrame:
    """Each link from both of its ends: node, neighbour, link_type, direction.  A union of two equi
    joins' sides instead of an OR in a join (J5); loops are left out."""
    out = links.where("source_id <> target_id")
    return out.select(F.col("source_id").alias("node"), F.col("target_id").alias("neighbour"), "link_type", F.lit("outgoing").alias("direction")).unionByName(
        out.select(F.col("target_id").alias("node"), F.col("source_id").alias("neighbour"), "link_type", F.lit("incoming").alias("direction"))
    )


def links_of(links: DataFrame, ids: DataFrame) -> DataFrame:
    """The links of the given memories (id), from either end."""
    return both_ways(links).join(ids.select(F.col("id").alias("_id")), F.col("node") == F.col("_id"), "left_semi")


def degree(links: DataFrame) -> DataFrame:
    return both_ways(links).groupBy("node", "link_type").agg(F.count("*").alias("n"))


def expand(mem: DataFrame, links: DataFrame, seeds: DataFrame, max_hops: int, link_types: list[str] | None = None, max_nodes: int | None = None) -> DataFrame:
    """Breadth-first from many seeds (seed) at once over active memories (G1): seed, node, depth, and
    the link by which the walk arrived: parent, link_type, direction (as seen from the parent), of
    several the one of the least parent, then link_type, then direction.  max_nodes: of each seed the
    first so many by depth and id, a limit of the result."""
    edges = both_ways(links if link_types is None else links.where(F.col("link_type").isin(*link_types)))
    active = mem.where("status = 'active'").select(F.col("id").alias("neighbour"))
    edges = edges.groupBy("node", "neighbour").agg(F.min(F.struct("link_type", "direction")).alias("link")).join(active, "neighbour", "left_semi")
    none = F.lit(None).cast("string")
    seen = seeds.select("seed", F.col("seed").alias("node"), F.lit(0).alias("depth"), F.lit(None).cast("long").alias("parent"), none.alias("link_type"), none.alias("direction")).distinct()
    frontier = seen
    for hop in range(1, max_hops + 1):
        arrival = F.min(F.struct(F.col("node").cast("long").alias("parent"), "link.link_type", "link.direction")).alias("_a")
        step = frontier.select("seed", "node").join(edges, "node").groupBy("seed", F.col("neighbour").alias("_node")).agg(arrival)
        step = step.select("seed", F.col("_node").alias("node"), F.lit(hop).alias("depth"), "_a.*")
        frontier = settled(step.join(seen.select("seed", "node"), ["seed", "node"], "left_anti"))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    found = seen.where("depth > 0")
    if max_nodes is not None:
        found = found.withColumn("_n", F.row_number().over(Window.partitionBy("seed").orderBy("depth", "node"))).where(F.col("_n") <= max_nodes).drop("_n")
    return found


def shortest_paths(links: DataFrame, pairs: DataFrame, max_depth: int) -> DataFrame:
    """The shortest undirected path of each pair (source, target) up to max_depth links, of equal ones
    the least by node ids (G2): source, target, path, length.  Only reached pairs are returned.

    The search goes from both ends in turn, each half the depth, so a frontier holds what lies within
    half of the way; a path of length t is there as soon as the two frontiers of t steps meet."""
    edges = both_ways(links).select("node", "neighbour").distinct()
    wanted = pairs.select("source", "target").distinct()
    pair = ["source", "target"]
    found = wanted.where("source = target").select(*pair, F.array("source").alias("path"))
    rest = wanted.where("source <> target")
    sides = [rest.select(*pair, F.col(end).alias("node"), F.array(end).alias("path")) for end in pair]
    seen = [side.select(*pair, "node") for side in sides]
    for t in range(1, max_depth + 1):
        k = (t + 1) % 2  # the source's side first
        far = F.concat("path", F.array("neighbour")) if k == 0 else F.concat(F.array("neighbour"), "path")
        step = sides[k].join(edges, "node").select(*pair, F.col("neighbour").alias("node"), far.alias("path"))
        step = step.join(seen[k], [*pair, "node"], "left_anti")
        sides[k] = settled(step.groupBy(*pair, "node").agg(F.min("path").alias("path")))
        seen[k] = seen[k].unionByName(sides[k].select(*pair, "node"))
        ends = sides[1].select(*pair, "node", F.expr("slice(path, 2, size(path))").alias("_rest"))
        met = sides[0].join(ends, [*pair, "node"]).groupBy(*pair).agg(F.min(F.concat("path", "_rest")).alias("path"))
        met = settled(met)
        found = found.unionByName(met)
        sides = [side.join(met.select(*pair), pair, "left_anti") for side in sides]
        if sides[k].isEmpty():
            break
    return found.select(*pair, "path", (F.size("path") - 1).alias("length"))


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """node, component (its smallest node) of every node with a link (G4): each node takes the least
    label of its neighbours, then the label of its label, until nothing changes."""
    edges = settled(both_ways(links).select("node", "neighbour").distinct())
    label = edges.select("node").distinct().withColumn("component", F.col("node"))
    before = None
    for _ in range(rounds):
        near = edges.join(label.withColumnRenamed("node", "neighbour"), "neighbour").groupBy("node").agg(F.min("component").alias("m"))
        new = label.join(near, "node", "left").select("node", F.least("component", F.coalesce("m", "component")).alias("component"))
        hop = new.select(F.col("node").alias("component"), F.col("component").alias("up"))
        label = settled(new.join(hop, "component", "left").select("node", F.least("component", F.coalesce("up", "component")).alias("component")))
        state = label.agg(F.bit_xor(F.xxhash64("node", "component"))).first()[0]
        if state == before:
            return label
        before = state
    raise RuntimeError("components did not settle")
