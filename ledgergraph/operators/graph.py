"""Questions on the graph: end points, neighbourhoods, paths, profiles, views.

Hub vertices may hold a large part of all edges. Joins on a vertex have at most one row per vertex on the other
side, which adaptive skew handling can split; roll-ups are aggregations, which combine before the shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgergraph.catalog import quality
from ledgergraph.functions.ordering import first_n
from ledgergraph.session import checkpoint


def by_id(vertices: DataFrame, name: str, *more: Column) -> DataFrame:
    """The ids of vertices as ``name``, with more columns, as the side of a join that is hashed.

    Ids are unique, so a part of them fits in memory, however large a hub is on the other side; a merge join would sort
    all edges for each of their ends, which spills more than it shuffles once they are many.
    """
    return vertices.select(F.col("id").alias(name), *more).hint("shuffle_hash")


def with_endpoints(edges: DataFrame, vertices: DataFrame, *columns: str) -> DataFrame:
    """Edges with columns of both ends, as src_<column> and dst_<column>. Edges without both ends are left out."""
    def side(name: str) -> DataFrame:
        return by_id(vertices, name, *[F.col(c).alias(f"{name}_{c}") for c in columns])
    return edges.join(side("src"), "src").join(side("dst"), "dst")


def anchored(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """Edges whose two ends exist."""
    return edges.join(by_id(vertices, "src"), "src", "left_semi").join(by_id(vertices, "dst"), "dst", "left_semi")


def both_ways(edges: DataFrame, *extra: str) -> DataFrame:
    """Each edge seen from each of its ends (at, other); a self loop once. The edges are read once."""
    out = F.struct(F.col("src").alias("at"), F.col("dst").alias("other"), F.lit("out").alias("direction"))
    back = F.struct(F.col("dst").alias("at"), F.col("src").alias("other"), F.lit("in").alias("direction"))
    rows = edges.select(F.inline(F.when(F.col("src") != F.col("dst"), F.array(out, back)).otherwise(F.array(out))),
                        F.col("id").alias("edge_id"), F.col("type").alias("edge_type"), *extra)
    return rows.select("at", "other", "direction", "edge_id", "edge_type", *extra)


def edges_of(edges: DataFrame, seeds: DataFrame, direction: str = "both", type_: str | None = None) -> DataFrame:
    """Edges of each seed (column id): seed, edge columns. A self loop comes once."""
    if type_ is not None:
        edges = edges.filter(F.col("type") == type_)
    ids = seeds.select(F.col("id").alias("seed"))
    out = edges.join(ids, edges.src == ids.seed)
    if direction == "out":
        return out
    into = edges.join(ids, edges.dst == ids.seed)
    if direction == "in":
        return into
    return out.unionByName(into.filter("src <> dst"))


def neighbours(edges: DataFrame, vertices: DataFrame, seeds: DataFrame) -> DataFrame:
    """The other end of every edge of every seed: seed, direction, edge_id, edge_type, id, name, type."""
    sides = both_ways(edges).join(seeds.select(F.col("id").alias("at")), "at", "left_semi")
    return (sides.join(vertices.select(F.col("id").alias("other"), "name", "type"), "other")
            .select(F.col("at").alias("seed"), "direction", "edge_id", "edge_type", F.col("other").alias("id"),
                    "name", "type"))


def by_source_type(edges: DataFrame, vertices: DataFrame, type_: str) -> DataFrame:
    """Edges whose source is of a type."""
    ids = vertices.filter(F.col("type") == type_).select(F.col("id").alias("src"))
    return edges.join(ids, "src", "left_semi")


def of_types(edges: DataFrame, types: list[str] | None) -> DataFrame:
    return edges if types is None else edges.filter(F.col("type").isin(*types))


def paths(edges: DataFrame, seeds: DataFrame, depth: int = 1, types: list[str] | None = None) -> DataFrame:
    """All undirected trails of 1..depth edges from each seed: seed, length, nodes, edge_ids.

    An edge comes at most once in a trail, a vertex may come again. The result itself grows with the degree to
    the power of the depth, so seeds, depth and types are the caller's to choose.
    """
    sides = both_ways(of_types(edges, types)).select("at", "other", "edge_id")
    now = seeds.select(F.col("id").alias("seed"), F.col("id").alias("at"), F.array("id").alias("nodes"),
                       F.array().cast("array<string>").alias("edge_ids"))
    found = []
    for step in range(depth):
        now = (now.join(sides, "at").filter(~F.array_contains("edge_ids", F.col("edge_id")))
               .select("seed", F.col("other").alias("at"), F.array_append("nodes", F.col("other")).alias("nodes"),
                       F.array_append("edge_ids", F.col("edge_id")).alias("edge_ids")))
        if 0 < step < depth - 1:
            now = checkpoint(now)  # read again by the next step and by the result
        found.append(now.select("seed", F.lit(step + 1).alias("length"), "nodes", "edge_ids"))
    return reduce(DataFrame.unionByName, found)


def reach(edges: DataFrame, seeds: DataFrame, depth: int = 2, types: list[str] | None = None) -> DataFrame:
    """Vertices within ``depth`` steps of each seed with their distance: seed, id, distance.

    Each step keeps distinct (seed, vertex) pairs that are new, so a hub is expanded once per seed.
    """
    sides = both_ways(of_types(edges, types)).select("at", "other")
    seen = seeds.select(F.col("id").alias("seed"), "id", F.lit(0).alias("distance"))
    front = seen
    for step in range(1, depth + 1):
        new = (front.join(sides, front.id == sides.at).select("seed", F.col("other").alias("id")).distinct()
               .join(seen.select("seed", "id"), ["seed", "id"], "left_anti")
               .withColumn("distance", F.lit(step)))
        front = checkpoint(new)
        seen = seen.unionByName(front)
    return seen


def subgraph(edges: DataFrame, seeds: DataFrame, depth: int = 2,
             types: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(vertices, edges) around each seed: (seed, id, distance) and (seed, edge_id), both distinct.

    An edge is on a trail of at most ``depth`` edges exactly if one of its ends is nearer than ``depth``.
    """
    nodes = reach(edges, seeds, depth, types)
    inner = nodes.filter(F.col("distance") < depth)
    sides = both_ways(of_types(edges, types)).select("at", "edge_id")
    links = inner.join(sides, inner.id == sides.at).select("seed", "edge_id").distinct()
    return nodes, links


def network_metrics(nodes: DataFrame, links: DataFrame, vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Sizes, mean degree and histograms of each subgraph, long form: seed, measure, item, value."""
    n = nodes.groupBy("seed").agg(F.count("*").cast("double").alias("n"))
    e = links.groupBy("seed").agg(F.count("*").cast("double").alias("e"))
    loops = (links.join(edges.filter("src = dst").select(F.col("id").alias("edge_id")), "edge_id", "left_semi")
             .groupBy("seed").agg(F.count("*").cast("double").alias("loops")))
    sizes = n.join(e, "seed", "left").join(loops, "seed", "left").fillna(0.0, ["e", "loops"])
    flat = sizes.select("seed", F.explode(F.array(
        *[F.struct(F.lit(m).alias("measure"), F.lit("all").alias("item"), v.alias("value"))
          for m, v in (("vertices", F.col("n")), ("edges", F.col("e")),
                       ("average_degree", (F.col("e") * 2 - F.col("loops")) / F.col("n")))],
    )).alias("z")).select("seed", "z.*")
    kinds = (nodes.join(vertices.select("id", "type"), "id").groupBy("seed", F.col("type").alias("item"))
             .agg(F.count("*").cast("double").alias("value")).withColumn("measure", F.lit("vertex_type")))
    rels = (links.join(edges.select(F.col("id").alias("edge_id"), "type"), "edge_id")
            .groupBy("seed", F.col("type").alias("item"))
            .agg(F.count("*").cast("double").alias("value")).withColumn("measure", F.lit("edge_type")))
    return flat.unionByName(kinds).unionByName(rels)


def graph_metrics(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: totals, counts by type as maps, mean edge confidence."""
    v = vertices.groupBy("type").agg(F.count("*").alias("n")).withColumn("s", F.lit(0.0)).withColumn("node", F.lit(True))
    e = (edges.groupBy("type").agg(F.count("*").alias("n"), F.sum("confidence").alias("s"))
         .withColumn("node", F.lit(False)))

    def total(node: bool, column: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("node") == node, F.col(column))), F.lit(0))

    def as_map(node: bool) -> Column:
        entry = F.when(F.col("node") == node, F.struct("type", "n"))
        return F.map_from_entries(F.array_sort(F.collect_list(entry)))
    return v.unionByName(e).agg(
        total(True, "n").alias("total_nodes"), total(False, "n").alias("total_relationships"),
        as_map(True).alias("node_types"), as_map(False).alias("relationship_types"),
        (total(False, "s") / F.sum(F.when(~F.col("node"), F.col("n")))).alias("average_confidence"))


def pattern_summary(edges: DataFrame, vertices: DataFrame, entity_type: str, rel_type: str) -> DataFrame:
    """Total, confidence range and first and last date of one relation from one source type."""
    e = by_source_type(edges.filter(F.col("type") == rel_type), vertices, entity_type)
    return e.agg(F.count("*").alias("total"), F.min("confidence").alias("min_confidence"),
                 F.max("confidence").alias("max_confidence"), F.avg("confidence").alias("average_confidence"),
                 F.min("created_at").alias("earliest"), F.max("created_at").alias("latest"))


def pattern_targets(edges: DataFrame, vertices: DataFrame, entity_type: str, rel_type: str) -> DataFrame:
    e = by_source_type(edges.filter(F.col("type") == rel_type), vertices, entity_type)
    return (e.join(vertices.select(F.col("id").alias("dst"), F.col("type").alias("target_type")), "dst")
            .groupBy("target_type").agg(F.count("*").alias("relations")))


def pattern_properties(edges: DataFrame, vertices: DataFrame, entity_type: str, rel_type: str) -> DataFrame:
    """How often each property value occurs: key, value, relations."""
    e = by_source_type(edges.filter(F.col("type") == rel_type), vertices, entity_type)
    return (e.select(F.explode("properties").alias("key", "value")).groupBy("key", "value")
            .agg(F.count("*").alias("relations")))


def entity_profile(edges: DataFrame, vertices: DataFrame, type_: str) -> DataFrame:
    """Relations of every entity of a type by relation and type of the other end, with mean confidence."""
    sides = both_ways(edges, "confidence").join(by_id(vertices.filter(F.col("type") == type_), "at"), "at", "left_semi")
    return (sides.join(by_id(vertices, "other", F.col("type").alias("other_type")), "other")
            .groupBy(F.col("at").alias("id"), F.col("edge_type").alias("rel_type"), "other_type")
            .agg(F.count("*").alias("relations"), F.avg("confidence").alias("average_confidence")))


def risk_profile(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """Risk of every entity: number of risk relations, their mean confidence, severities, overall score.

    The score adds, per relation type, the number of relations times the weight of the first one's severity;
    the first is the one with the least edge id. A severity that is not given is medium.
    """
    risky = edges.filter(F.col("type").isin(*quality.RISK_RELATIONS)).withColumn(
        "severity", F.coalesce(F.try_element_at("properties", F.lit("severity")), F.lit("medium")))
    sides = both_ways(risky, "confidence", "severity")
    known = sides.join(vertices.select(F.col("id").alias("other")), "other", "left_semi")
    per_type = known.groupBy(F.col("at").alias("id"), "edge_type").agg(
        F.count("*").alias("n"), F.sum("confidence").alias("s"), F.min_by("severity", "edge_id").alias("first"),
        *[F.count_if(F.col("severity") == x).alias(x) for x in quality.SEVERITY_WEIGHTS])
    weight = reduce(lambda acc, kv: F.when(F.col("first") == kv[0], kv[1]).otherwise(acc),
                    quality.SEVERITY_WEIGHTS.items(), F.lit(1))
    return per_type.groupBy("id").agg(
        F.sum("n").alias("total_risks"), (F.sum("s") / F.sum("n")).alias("average_confidence"),
        *[F.sum(x).alias(f"{x}_severity") for x in quality.SEVERITY_WEIGHTS],
        F.sum(F.col("n") * weight).alias("overall_risk_score"))


def document_nodes(vertices: DataFrame, max_nodes: int | None = 100) -> DataFrame:
    """The vertices shown for each document: the most confident ones, at most ``max_nodes``, or all."""
    if max_nodes is None:
        return vertices
    return first_n(vertices, ["source_document"], ["-confidence", "id"], max_nodes, F.col("id"))


def document_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges between shown vertices."""
    return anchored(edges, nodes)


def filtered(vertices: DataFrame, edges: DataFrame, node_types: list[str],
             edge_types: list[str]) -> tuple[DataFrame, DataFrame]:
    """Vertices and edges of the given types; an edge stays only with both of its ends."""
    v = vertices.filter(F.col("type").isin(*node_types))
    return v, anchored(of_types(edges, edge_types), v)
