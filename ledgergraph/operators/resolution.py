"""Duplicates, merging, splitting and similarity of entities."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgergraph.operators.graph import both_ways
from ledgergraph.session import checkpoint, stored


def deduplicate(df: DataFrame, keys: dict[str, Column], order: list[str]) -> DataFrame:
    """The first row, by ``order``, of each combination of keys. A null key equals a null key.

    An aggregation, not a window: copies are combined before the shuffle, however many there are.
    """
    named = df.select(F.struct(*df.columns).alias("_row"), *[c.alias(f"_k_{n}") for n, c in keys.items()])
    kept = named.groupBy(*[f"_k_{n}" for n in keys]).agg(
        F.min_by("_row", F.struct(*[F.col(f"_row.{o}") for o in order])).alias("_row"))
    return kept.select("_row.*")


def merge_by(df: DataFrame, keys: list[str], **functions: Column) -> DataFrame:
    """Merge rows with equal keys by aggregate functions, one per output column."""
    return df.groupBy(*keys).agg(*[c.alias(n) for n, c in functions.items()])


def split_by(df: DataFrame, parts: Column, name: str = "part") -> DataFrame:
    """One row per element of an array expression, with its position; rows without elements stay whole."""
    return df.select("*", F.posexplode_outer(parts).alias(f"{name}_no", name))


def merge_with(df: DataFrame, keys: list[str], fn: Callable, schema: str) -> DataFrame:
    """Merge rows with equal keys by a caller's Python function: a pandas frame of the rows in, one of the merged rows out.

    The rows of a key meet in one call; aggregates (:func:`merge_by`) have no such bound and are the first choice.
    """
    return df.groupBy(*keys).applyInPandas(fn, schema)


def split_with(df: DataFrame, table_function: Callable[..., DataFrame], *columns: str) -> DataFrame:
    """Split rows by a caller's Python table function (``pyspark.sql.functions.udtf``): each row with all that it gives."""
    return df.lateralJoin(table_function(*[F.col(c).outer() for c in columns]))


def merge_groups(pairs: DataFrame) -> DataFrame:
    """Canonical id of each id in a merge list (id1, id2): id, canonical. The least id of a group stands for it.

    Labels spread along the pairs and are then replaced by the label of the label, which halves the way left, so
    the number of rounds grows with the logarithm of the longest chain. Each round is a written table.
    """
    links = checkpoint(pairs.select(F.col("id1").alias("a"), F.col("id2").alias("b")).union(
        pairs.select(F.col("id2"), F.col("id1"))).distinct())
    labels = checkpoint(links.groupBy("a").agg(F.min("b").alias("m")).select(
        F.col("a").alias("id"), F.least("a", "m").alias("label")))
    while True:
        near = (links.join(labels.select(F.col("id").alias("b"), "label"), "b")
                .groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near")))
        step = labels.join(near, "id").select("id", "label", F.least("label", "near").alias("next"))
        jump = step.select(F.col("id").alias("next"), F.col("next").alias("beyond"))
        moved = checkpoint(step.join(jump, "next", "left").select(
            "id", "label", F.least("next", F.coalesce("beyond", "next")).alias("new")))
        changed = moved.filter("new <> label").limit(1).count()
        labels = moved.select("id", F.col("new").alias("label"))
        if not changed:
            return labels.withColumnRenamed("label", "canonical")


def merge_vertices(vertices: DataFrame, canonical: DataFrame) -> DataFrame:
    """Vertices after merging: the canonical one's name and type, all properties (the least id wins a clash),
    the greatest confidence and update time, and the number of merged vertices."""
    v = vertices.join(canonical, "id", "left").withColumn("canonical", F.coalesce("canonical", "id"))
    head = v.groupBy("canonical").agg(
        F.min_by("name", "id").alias("name"), F.min_by("type", "id").alias("type"),
        F.max("confidence").alias("confidence"), F.max("updated_at").alias("updated_at"),
        F.min("created_at").alias("created_at"), F.min_by("source_document", "id").alias("source_document"),
        F.count("*").alias("merged"))
    items = (v.select("canonical", "id", F.explode("properties").alias("key", "value"))
             .groupBy("canonical", "key").agg(F.min_by("value", "id").alias("value"))
             .groupBy("canonical").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("properties")))
    return head.join(items, "canonical", "left").withColumnRenamed("canonical", "id")


def merge_edges(edges: DataFrame, canonical: DataFrame) -> DataFrame:
    """Edges with both ends re-pointed; edges that merging has turned into self loops are dropped."""
    a = canonical.select(F.col("id").alias("src"), F.col("canonical").alias("_s"))
    b = canonical.select(F.col("id").alias("dst"), F.col("canonical").alias("_d"))
    moved = edges.join(a, "src", "left").join(b, "dst", "left")
    src, dst = F.coalesce("_s", "src"), F.coalesce("_d", "dst")
    kept = moved.filter((src != dst) | (F.col("src") == F.col("dst")))
    return kept.select(*[src.alias("src") if c == "src" else dst.alias("dst") if c == "dst" else F.col(c)
                         for c in edges.columns])


def property_items(vertices: DataFrame, without: tuple[str, ...] = ()) -> DataFrame:
    """One row per property of each vertex: id, item."""
    kv = vertices.select("id", F.explode("properties").alias("key", "value"))
    return kv.filter(~F.col("key").isin(*without)).select("id", F.concat_ws("=", "key", "value").alias("item"))


def neighbour_items(edges: DataFrame) -> DataFrame:
    """One row per distinct neighbour of each vertex: id, item."""
    return both_ways(edges).select(F.col("at").alias("id"), F.col("other").alias("item")).distinct()


def rarest(items: DataFrame, seeds: DataFrame, threshold: float) -> DataFrame:
    """``seed, item``: of each seed's items the rarest, as many as a set must share one of to reach the threshold.

    A set with a Jaccard similarity of at least t to one of n items has at least t x n of them, so it lacks at most
    n - t x n, and one of any n - t x n + 1 is in it. The items that most sets have are thus never looked up.
    """
    mine = stored(items.join(seeds.select("id"), "id", "left_semi"))
    often = items.join(mine.select("item").distinct(), "item", "left_semi").groupBy("item").agg(F.count("*").alias("n"))
    w = Window.partitionBy("id")
    ranked = mine.join(often, "item").select(F.col("id").alias("seed"), "item", F.row_number().over(w.orderBy("n", "item")).alias("place"),
                                             F.count("*").over(w).alias("size"))
    return ranked.where(F.col("place") <= F.col("size") - F.ceil(F.col("size") * threshold - 1e-9) + 1).select("seed", "item")


def candidates(items: DataFrame, sizes: DataFrame, seeds: DataFrame, threshold: float) -> DataFrame:
    """``seed, id``: all pairs that may reach the threshold, by the rarest items and the sizes of the sets."""
    shared = items.join(stored(rarest(items, seeds, threshold)), "item").where("id <> seed").select("seed", "id").distinct()
    fit = shared.join(sizes, "id").join(sizes.select(F.col("id").alias("seed"), F.col("n").alias("m")), "seed")
    return fit.where((F.least("n", "m") >= F.greatest("n", "m") * threshold - 1e-9)).select("seed", "id")


def overlap(items: DataFrame, sizes: DataFrame, pairs: DataFrame, name: str) -> DataFrame:
    """The pairs (seed, id) with the Jaccard similarity of their item sets; 0 if they share none. Of the items only those of
    a seed go on to the pairs."""
    mine = stored(items.join(pairs.select(F.col("seed").alias("id")).distinct(), "id", "left_semi").select(F.col("id").alias("seed"), "item"))
    theirs = items.join(mine.select("item").distinct(), "item", "left_semi")
    common = pairs.join(theirs, "id").join(mine, ["seed", "item"]).groupBy("seed", "id").agg(F.count("*").alias("c"))
    rows = pairs.join(common, ["seed", "id"], "left").join(sizes, "id", "left").join(sizes.select(F.col("id").alias("seed"), F.col("n").alias("m")), "seed", "left")
    c = F.coalesce("c", F.lit(0))
    return rows.select("seed", "id", F.when(c > 0, c / (F.col("n") + F.col("m") - c)).otherwise(0.0).alias(name))


def similar(vertices: DataFrame, edges: DataFrame, seeds: DataFrame, threshold: float = 0.7,
            without: tuple[str, ...] = ()) -> DataFrame:
    """Vertices like each seed, with their rank: half the Jaccard similarity of properties plus half that of neighbours.

    Where the mean reaches the threshold, one of the two does. So candidates are the pairs that may reach it by their
    properties or by their neighbours, and only these are counted. Items and the few rows of the seeds are written once, as tables
    of known sizes: what the seeds have is broadcast while it is small, and the items of all others are shuffled for their numbers only.
    """
    seeds = stored(seeds.select("id"))
    tables = [stored(property_items(vertices, without)), stored(neighbour_items(edges))]
    sizes = [stored(items.groupBy("id").agg(F.count("*").alias("n"))) for items in tables]
    pairs = [candidates(items, n, seeds, threshold) for items, n in zip(tables, sizes)]
    both = stored(pairs[0].union(pairs[1]).distinct())
    p, n = (overlap(items, size, both, name) for items, size, name in zip(tables, sizes, "pn"))
    scored = p.join(n, ["seed", "id"]).withColumn("similarity", F.col("p") * 0.5 + F.col("n") * 0.5).filter(F.col("similarity") >= threshold)
    rank = F.row_number().over(Window.partitionBy("seed").orderBy(F.desc("similarity"), "id"))
    return stored(scored).join(vertices.select("id", "name", "type"), "id").select("seed", "id", "name", "type", "similarity", rank.alias("rank"))
