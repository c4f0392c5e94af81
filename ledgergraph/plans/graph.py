"""Queries on the graph: joins (C4-C12), aggregates (E3-E7), views (G), resolution (H), filters (B11), trends (F1, F2, F8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgergraph.operators import graph as g
from ledgergraph.operators import resolution as h
from ledgergraph.operators import trends as t
from ledgergraph.plans import sql
from ledgergraph.plans.registry import query
from ledgergraph.sources import bindings as b
from ledgergraph.sources.tables import table

GRAPH = f"WITH {sql.VERTICES}, {sql.EDGES}"
PROPS = f"{GRAPH}, {sql.VPROPS}, {sql.EPROPS}"
TEXT_TIME = "yyyy-MM-dd HH:mm:ss"
SQL_TIME = "%Y-%m-%d %H:%M:%S"

SIDES = """sides AS (
  SELECT src AS here, dst AS other, 'out' AS direction, id AS edge_id, type AS edge_type, confidence FROM edges
  UNION ALL SELECT dst, src, 'in', id, type, confidence FROM edges WHERE src <> dst)"""


def near(column, digits: int):
    """Rounded, and moved off the ties that means of amounts in cents fall on (sums differ in their last bits)."""
    return F.round(F.col(column) + 10.0 ** -(digits + 3), digits).alias(column)


def stamp(column: str):
    return F.date_format(column, TEXT_TIME)


def _of(spark, sf, *types):
    return g.of_types(b.edges(spark, sf), list(types))


@query(GRAPH + """
SELECT e.type, s.type AS src_type, d.type AS dst_type, count(*) AS edges, round(avg(e.confidence) + 1e-9, 6) AS confidence
FROM edges e JOIN vertices s ON e.src = s.id JOIN vertices d ON e.dst = d.id GROUP BY ALL""")
def c4_edges_with_endpoints(spark, sf):
    e = g.with_endpoints(b.edges(spark, sf), b.vertices(spark, sf), "type")
    return (e.groupBy("type", "src_type", "dst_type")
            .agg(F.count("*").alias("edges"), F.round(F.avg("confidence") + 1e-9, 6).alias("confidence")))


@query(GRAPH + """
SELECT 'S' || s_suppkey AS seed, e.id, e.type FROM edges e JOIN supplier ON e.src = 'S' || s_suppkey
UNION ALL SELECT 'S' || s_suppkey, e.id, e.type FROM edges e JOIN supplier ON e.dst = 'S' || s_suppkey
WHERE e.src <> e.dst""")
def c5_edges_of_suppliers(spark, sf):
    seeds = table(spark, sf, "supplier").select(b.key("S", "s_suppkey").alias("id"))
    return g.edges_of(b.edges(spark, sf), seeds).select("seed", "id", "type")


@query(GRAPH + """
SELECT 'N' || n_nationkey AS seed, e.id, e.type FROM edges e JOIN nation ON e.dst = 'N' || n_nationkey
WHERE e.type = 'HEADQUARTERED_IN'""")
def c5_incoming_of_type(spark, sf):
    seeds = table(spark, sf, "nation").select(b.key("N", "n_nationkey").alias("id"))
    return g.edges_of(b.edges(spark, sf), seeds, "in", "HEADQUARTERED_IN").select("seed", "id", "type")


@query(GRAPH + """, t AS (SELECT * FROM edges WHERE type IN ('LOCATED_IN', 'HEADQUARTERED_IN')),
s AS (SELECT src AS here, dst AS other, id FROM t UNION ALL SELECT dst, src, id FROM t WHERE src <> dst),
p1 AS (SELECT 'R' || r_regionkey AS seed, other AS here, ['R' || r_regionkey, other] AS nodes, [id] AS ids
  FROM region JOIN s ON s.here = 'R' || r_regionkey),
p2 AS (SELECT seed, other AS here, list_append(nodes, other) AS nodes, list_append(ids, id) AS ids
  FROM p1 JOIN s USING (here) WHERE NOT list_contains(ids, id)),
p3 AS (SELECT seed, other AS here, list_append(nodes, other) AS nodes, list_append(ids, id) AS ids
  FROM p2 JOIN s USING (here) WHERE NOT list_contains(ids, id))
SELECT seed, CAST(len(ids) AS INTEGER) AS length, array_to_string(nodes, '>') AS nodes, array_to_string(ids, '>') AS edge_ids
FROM (SELECT * FROM p1 UNION ALL SELECT * FROM p2 UNION ALL SELECT * FROM p3)""")
def c6_paths_from_regions(spark, sf):
    seeds = table(spark, sf, "region").select(b.key("R", "r_regionkey").alias("id"))
    p = g.paths(b.edges(spark, sf), seeds, 3, ["LOCATED_IN", "HEADQUARTERED_IN"])
    return p.select("seed", "length", F.array_join("nodes", ">").alias("nodes"),
                    F.array_join("edge_ids", ">").alias("edge_ids"))


REACH = GRAPH + """, t AS (SELECT * FROM edges WHERE type IN ('LOCATED_IN', 'HEADQUARTERED_IN')),
s AS (SELECT src AS here, dst AS other, id FROM t UNION ALL SELECT dst, src, id FROM t WHERE src <> dst),
d0 AS (SELECT 'R' || r_regionkey AS seed, 'R' || r_regionkey AS id, 0 AS distance FROM region),
d1 AS (SELECT DISTINCT seed, other AS id, 1 AS distance FROM d0 JOIN s ON s.here = d0.id
  WHERE (seed, other) NOT IN (SELECT (seed, id) FROM d0)),
d2 AS (SELECT DISTINCT seed, other AS id, 2 AS distance FROM d1 JOIN s ON s.here = d1.id
  WHERE (seed, other) NOT IN (SELECT (seed, id) FROM d0 UNION SELECT (seed, id) FROM d1)),
nodes AS (SELECT * FROM d0 UNION ALL SELECT * FROM d1 UNION ALL SELECT * FROM d2),
links AS (SELECT DISTINCT seed, s.id AS edge_id FROM nodes n JOIN s ON s.here = n.id WHERE distance < 2)"""


def _region_subgraph(spark, sf):
    seeds = table(spark, sf, "region").select(b.key("R", "r_regionkey").alias("id"))
    return g.subgraph(b.edges(spark, sf), seeds, 2, ["LOCATED_IN", "HEADQUARTERED_IN"])


@query(REACH + " SELECT seed, id, distance FROM nodes")
def c7_subgraph_vertices(spark, sf):
    return _region_subgraph(spark, sf)[0]


@query(REACH + " SELECT seed, edge_id FROM links")
def c7_subgraph_edges(spark, sf):
    return _region_subgraph(spark, sf)[1]


@query(GRAPH + ", " + SIDES + """
SELECT here AS seed, direction, edge_id, edge_type, v.id, v.name, v.type FROM sides JOIN vertices v ON v.id = other
WHERE here IN (SELECT 'N' || n_nationkey FROM nation)""")
def c8_neighbours_of_nations(spark, sf):
    seeds = table(spark, sf, "nation").select(b.key("N", "n_nationkey").alias("id"))
    return g.neighbours(b.edges(spark, sf), b.vertices(spark, sf), seeds)


@query(GRAPH + """
SELECT e.type, count(*) AS edges FROM edges e WHERE src IN (SELECT id FROM vertices WHERE type = 'Company')
GROUP BY e.type""")
def c9_edges_from_companies(spark, sf):
    e = g.by_source_type(b.edges(spark, sf), b.vertices(spark, sf), "Company")
    return e.groupBy("type").agg(F.count("*").alias("edges"))


POINTS = PAIRS = f"""WITH {sql.VERTICES}, {sql.PAIRS_AND_MONTHS}, pts AS (
  SELECT 'C' || o_custkey AS entity, 'revenue' AS metric, month AS ts, CAST(printf('%.2f', revenue) AS DOUBLE) AS value
  FROM months UNION ALL
  SELECT 'C' || o_custkey, 'orders', month, CAST(printf('%.2f', CAST(orders AS DOUBLE)) AS DOUBLE) FROM months),
points AS (SELECT * FROM pts WHERE value <> 0),
company AS (SELECT 'C' || c_custkey AS entity, c_name AS name, c_mktsegment AS industry FROM customer),
ip AS (SELECT p.*, name, industry FROM points p JOIN company USING (entity))"""


def _points(spark, sf):
    return t.metric_points(_of(spark, sf, "HAS_METRIC"))


def _industry(spark, sf):
    return t.industry_points(_points(spark, sf), b.vertices(spark, sf))


@query(POINTS + """
SELECT industry, metric, count(*) AS points, count(DISTINCT entity) AS companies, round(sum(value), 2) AS total
FROM ip GROUP BY ALL""")
def c12_industry_points(spark, sf):
    return _industry(spark, sf).groupBy("industry", "metric").agg(
        F.count("*").alias("points"), F.count_distinct("entity").alias("companies"),
        F.round(F.sum("value"), 2).alias("total"))


@query(POINTS + """
, n AS (SELECT *, row_number() OVER (PARTITION BY entity, metric ORDER BY ts) - 1 AS idx FROM points)
SELECT entity, metric, count(*) AS points, max_by(value, ts) AS current_value, min(value) AS min_value,
  max(value) AS max_value, round(avg(value) + 1e-7, 4) AS avg_value,
  round(stddev_pop(value) + 1e-7, 4) AS std_dev, round(CASE WHEN count(*) > 1 THEN regr_slope(value, idx) END + 1e-7, 4) AS trend,
  round((max_by(value, ts) - min_by(value, ts)) / min_by(value, ts) + 1e-9, 6) AS growth_rate,
  round(stddev_pop(value) / avg(value) + 1e-9, 6) AS volatility FROM n GROUP BY ALL""")
def f1_metric_trend(spark, sf):
    s = t.summary(_points(spark, sf), ["entity", "metric"], ["ts", "edge_id"])
    return s.select("entity", "metric", "points", "current_value", "min_value", "max_value",
                    *[near(c, 4) for c in ("avg_value", "std_dev", "trend")], near("growth_rate", 6),
                    near("volatility", 6))


@query(POINTS + """
SELECT entity, metric, ts, value, row_number() OVER (PARTITION BY entity, metric ORDER BY ts) AS place FROM points""")
def f1_metric_timeline(spark, sf):
    return t.timeline(_points(spark, sf), ["entity", "metric"], ["ts", "edge_id"]).drop("edge_id")


@query(POINTS + """
, m AS (SELECT industry, metric, ts, avg(value) AS mean FROM ip GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY industry, metric ORDER BY ts) - 1 AS idx FROM m)
SELECT industry, metric, count(*) AS timestamps, round(avg(mean) + 1e-7, 4) AS industry_average,
  round(stddev_pop(mean) / avg(mean) + 1e-9, 6) AS volatility, round(CASE WHEN count(*) > 1 THEN regr_slope(mean, idx) END + 1e-7, 4) AS industry_trend
FROM n GROUP BY ALL""")
def f2_industry_trend(spark, sf):
    return t.industry_trend(_industry(spark, sf)).select(
        "industry", "metric", "timestamps", near("industry_average", 4), near("volatility", 6),
        near("industry_trend", 4))


@query(POINTS + """
SELECT industry, metric, ts, round(avg(value) + 1e-7, 4) AS average FROM ip GROUP BY ALL""")
def f2_industry_timeline(spark, sf):
    return t.industry_timeline(_industry(spark, sf)).select("industry", "metric", "ts", near("average", 4))


@query(POINTS + """
, n AS (SELECT *, max(ts) OVER (PARTITION BY industry, metric) AS newest FROM ip)
SELECT industry, metric, entity, name, ts, value,
  row_number() OVER (PARTITION BY industry, metric ORDER BY value DESC, entity) AS rank FROM n WHERE ts = newest""")
def f2_industry_ranking(spark, sf):
    return t.industry_ranking(_industry(spark, sf)).select("industry", "metric", "entity", "name", "ts", "value", "rank")


@query("""
SELECT o_orderstatus AS status, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders
WHERE o_orderdate >= (SELECT max(o_orderdate) - INTERVAL 1 YEAR FROM orders) GROUP BY ALL""")
def f8_last_year(spark, sf):
    o = t.trailing(table(spark, sf, "orders"), F.col("o_orderdate"), "1y")
    return (o.groupBy(F.col("o_orderstatus").alias("status"))
            .agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total")))


@query(GRAPH + """
SELECT (SELECT count(*) FROM vertices) AS total_nodes, (SELECT count(*) FROM edges) AS total_relationships,
  (SELECT string_agg(type || '=' || n, ',' ORDER BY type) FROM (SELECT type, count(*) AS n FROM vertices GROUP BY type))
    AS node_types,
  (SELECT string_agg(type || '=' || n, ',' ORDER BY type) FROM (SELECT type, count(*) AS n FROM edges GROUP BY type))
    AS relationship_types,
  (SELECT round(avg(confidence) + 1e-9, 6) FROM edges) AS average_confidence""")
def e3_graph_metrics(spark, sf):
    m = g.graph_metrics(b.vertices(spark, sf), b.edges(spark, sf))

    def text(c):
        return F.array_join(F.transform(F.map_entries(c), lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias(c)
    return m.select("total_nodes", "total_relationships", text("node_types"), text("relationship_types"),
                    near("average_confidence", 6))


@query(REACH + """
SELECT seed, 'vertices' AS measure, 'all' AS item, CAST(count(*) AS DOUBLE) AS value FROM nodes GROUP BY seed
UNION ALL SELECT seed, 'edges', 'all', CAST(count(*) AS DOUBLE) FROM links GROUP BY seed
UNION ALL SELECT n.seed, 'average_degree', 'all', round(2.0::DOUBLE * e / n, 6) FROM
  (SELECT seed, count(*) AS n FROM nodes GROUP BY seed) n JOIN (SELECT seed, count(*) AS e FROM links GROUP BY seed) l
  ON n.seed = l.seed
UNION ALL SELECT seed, 'vertex_type', v.type, CAST(count(*) AS DOUBLE) FROM nodes JOIN vertices v USING (id) GROUP BY ALL
UNION ALL SELECT seed, 'edge_type', e.type, CAST(count(*) AS DOUBLE) FROM links JOIN edges e ON e.id = edge_id GROUP BY ALL""")
def e4_network_metrics(spark, sf):
    nodes, links = _region_subgraph(spark, sf)
    m = g.network_metrics(nodes, links, b.vertices(spark, sf), _of(spark, sf, "LOCATED_IN", "HEADQUARTERED_IN"))
    return m.withColumn("value", F.round("value", 6))


PROFILE = GRAPH + """, pe AS (SELECT * FROM edges WHERE type = 'SUPPLIES_TO'
  AND src IN (SELECT id FROM vertices WHERE type = 'Company'))"""


@query(PROFILE + f"""
SELECT count(*) AS total, min(confidence) AS min_confidence, max(confidence) AS max_confidence,
  round(avg(confidence) + 1e-9, 6) AS average_confidence, strftime(min(created_at), '{SQL_TIME}') AS earliest,
  strftime(max(created_at), '{SQL_TIME}') AS latest FROM pe""")
def e5_pattern_summary(spark, sf):
    s = g.pattern_summary(b.edges(spark, sf), b.vertices(spark, sf), "Company", "SUPPLIES_TO")
    return (s.withColumn("average_confidence", near("average_confidence", 6))
            .withColumn("earliest", stamp("earliest")).withColumn("latest", stamp("latest")))


@query(PROFILE + """
SELECT v.type AS target_type, count(*) AS relations FROM pe JOIN vertices v ON v.id = pe.dst GROUP BY v.type""")
def e5_pattern_targets(spark, sf):
    return g.pattern_targets(b.edges(spark, sf), b.vertices(spark, sf), "Company", "SUPPLIES_TO")


@query(PROFILE + ", " + sql.EPROPS + """
SELECT key, value, count(*) AS relations FROM eprops WHERE id IN (SELECT id FROM pe) GROUP BY ALL""")
def e5_pattern_properties(spark, sf):
    return g.pattern_properties(b.edges(spark, sf), b.vertices(spark, sf), "Company", "SUPPLIES_TO")


@query(GRAPH + ", " + SIDES + """
SELECT here AS id, edge_type AS rel_type, v.type AS other_type, count(*) AS relations,
  round(avg(sides.confidence) + 1e-9, 6) AS average_confidence
FROM sides JOIN vertices v ON v.id = other WHERE here IN (SELECT id FROM vertices WHERE type = 'Company') GROUP BY ALL""")
def e6_company_profile(spark, sf):
    p = g.entity_profile(b.edges(spark, sf), b.vertices(spark, sf), "Company")
    return p.withColumn("average_confidence", near("average_confidence", 6))


@query(PROPS + """, risky AS (
  SELECT e.*, coalesce(p.value, 'medium') AS severity FROM edges e LEFT JOIN eprops p ON p.id = e.id AND p.key = 'severity'
  WHERE e.type IN ('HAS_RISK', 'EXPOSED_TO', 'DEPENDS_ON', 'COMPETES_WITH')),
rs AS (SELECT src AS here, dst AS other, id, type, confidence, severity FROM risky
  UNION ALL SELECT dst, src, id, type, confidence, severity FROM risky WHERE src <> dst),
pt AS (SELECT here, type, count(*) AS n, sum(confidence) AS s, min_by(severity, id) AS first,
    count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium,
    count(*) FILTER (severity = 'low') AS low FROM rs GROUP BY ALL)
SELECT here AS id, CAST(sum(n) AS BIGINT) AS total_risks, round(sum(s) / sum(n) + 1e-9, 6) AS average_confidence,
  CAST(sum(high) AS BIGINT) AS high_severity, CAST(sum(medium) AS BIGINT) AS medium_severity,
  CAST(sum(low) AS BIGINT) AS low_severity,
  CAST(sum(n * CASE first WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END) AS BIGINT) AS overall_risk_score
FROM pt GROUP BY here""")
def e7_risk_profile(spark, sf):
    p = g.risk_profile(b.edges(spark, sf), b.vertices(spark, sf))
    return p.withColumn("average_confidence", near("average_confidence", 6))


NODES = """, shown AS (SELECT *, row_number() OVER (PARTITION BY source_document ORDER BY confidence DESC, id) AS position
  FROM vertices QUALIFY position <= 100)"""


@query(GRAPH + NODES + """
SELECT source_document, id, type, name, round(confidence, 6) AS confidence, position FROM shown""")
def g1_document_nodes(spark, sf):
    return g.document_nodes(b.vertices(spark, sf)).select(
        "source_document", "id", "type", "name", F.round("confidence", 6).alias("confidence"),
        F.col("position").cast("long").alias("position"))


@query(GRAPH + NODES + """
SELECT source_document, id, type, src, dst FROM edges
WHERE src IN (SELECT id FROM shown) AND dst IN (SELECT id FROM shown)""")
def g1_document_edges(spark, sf):
    nodes = g.document_nodes(b.vertices(spark, sf))
    return g.document_edges(b.edges(spark, sf), nodes).select("source_document", "id", "type", "src", "dst")


@query(GRAPH + """
SELECT id, type, name FROM vertices WHERE type IN ('Company', 'Location') ORDER BY name, id LIMIT 50 OFFSET 25""")
def g6_page_of_vertices(spark, sf):
    """An ad-hoc question with limit and skip, as SQL over views of the graph."""
    return spark.sql("SELECT id, type, name FROM {v} WHERE type IN (:a, :b) ORDER BY name, id LIMIT 50 OFFSET 25",
                     args={"a": "Company", "b": "Location"}, v=b.vertices(spark, sf))


@query(GRAPH + """, v AS (SELECT * FROM vertices WHERE type IN ('Company', 'Location'))
SELECT type, count(*) AS edges FROM edges WHERE type IN ('HEADQUARTERED_IN', 'SUPPLIES_TO', 'TRANSACTION')
  AND src IN (SELECT id FROM v) AND dst IN (SELECT id FROM v) GROUP BY type""")
def b11_filtered_graph(spark, sf):
    _, e = g.filtered(b.vertices(spark, sf), b.edges(spark, sf), ["Company", "Location"],
                      ["HEADQUARTERED_IN", "SUPPLIES_TO", "TRANSACTION"])
    return e.groupBy("type").agg(F.count("*").alias("edges"))


@query("""
SELECT 'P' || p_partkey AS id, p_name AS name, p_brand AS issuer FROM part
QUALIFY row_number() OVER (PARTITION BY p_name, p_brand, CASE WHEN p_size > 25 THEN p_type END
  ORDER BY 'P' || p_partkey) = 1""")
def h1_deduplicated_parts(spark, sf):
    p = table(spark, sf, "part").select(
        b.key("P", "p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("issuer"),
        F.when(F.col("p_size") > 25, F.col("p_type")).alias("grade"))
    keys = {k: F.col(k) for k in ("name", "issuer", "grade")}
    return h.deduplicate(p, keys, ["id"]).select("id", "name", "issuer")


# Merge list: every part with the next part of the same name and brand, so groups are chains of any length.
MERGE = """pairs AS (SELECT 'P' || p_partkey AS id1, 'P' || lead(p_partkey) OVER (PARTITION BY p_name, p_brand
  ORDER BY p_partkey) AS id2, p_name, p_brand FROM part),
canon AS (SELECT 'P' || p_partkey AS id, min('P' || p_partkey) OVER (PARTITION BY p_name, p_brand) AS canonical
  FROM part WHERE 'P' || p_partkey IN (SELECT id1 FROM pairs WHERE id2 IS NOT NULL UNION ALL
    SELECT id2 FROM pairs WHERE id2 IS NOT NULL))"""


def _merge_list(spark, sf):
    """Pairs of parts that are one: each with the least key of its name and brand, and that one with the greatest."""
    p = table(spark, sf, "part")
    ends = p.groupBy("p_name", "p_brand").agg(F.min("p_partkey").alias("lo"), F.max("p_partkey").alias("hi"))
    pairs = p.join(ends, ["p_name", "p_brand"]).filter("p_partkey <> hi")
    return pairs.select(b.key("P", "p_partkey").alias("id1"), b.key("P", "hi").alias("id2"))


@query(f"WITH {MERGE} SELECT * FROM canon")
def h2_merge_groups(spark, sf):
    return h.merge_groups(_merge_list(spark, sf))


@query(f"""WITH {sql.VERTICES}, {sql.VPROPS}, {MERGE}, v AS (
  SELECT v.*, coalesce(c.canonical, v.id) AS canonical FROM vertices v LEFT JOIN canon c USING (id)
  WHERE type = 'FinancialInstrument'),
items AS (SELECT canonical, key, min_by(value, p.id) AS value FROM v JOIN vprops p ON p.id = v.id GROUP BY ALL),
props AS (SELECT canonical, string_agg(key || '=' || value, ';' ORDER BY key) AS properties FROM items GROUP BY canonical)
SELECT canonical AS id, min_by(name, id) AS name, round(max(confidence), 6) AS confidence, count(*) AS merged,
  any_value(properties) AS properties FROM v JOIN props USING (canonical) GROUP BY canonical""")
def h2_merged_vertices(spark, sf):
    v = b.vertices(spark, sf).filter("type = 'FinancialInstrument'")
    m = h.merge_vertices(v, h.merge_groups(_merge_list(spark, sf)))
    entries = F.transform(F.array_sort(F.map_entries("properties")), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return m.select("id", "name", F.round("confidence", 6).alias("confidence"), "merged", F.array_join(entries, ";").alias("properties"))


@query(f"""WITH {sql.EDGES}, {MERGE}
SELECT e.id, e.src, coalesce(c.canonical, e.dst) AS dst FROM edges e LEFT JOIN canon c ON c.id = e.dst
WHERE e.type = 'ISSUES'""")
def h2_merged_edges(spark, sf):
    e = _of(spark, sf, "ISSUES")
    return h.merge_edges(e, h.merge_groups(_merge_list(spark, sf))).select("id", "src", "dst")


@query(PROPS + ", " + SIDES + """,
seeds AS (SELECT max_by('C' || c_custkey, (c_acctbal, c_custkey)) AS id FROM customer GROUP BY c_mktsegment),
pi AS (SELECT id, key || '=' || value AS item FROM vprops WHERE key NOT IN ('name', 'revenue')),
ni AS (SELECT DISTINCT here AS id, other AS item FROM sides),
pn AS (SELECT id, count(*) AS n FROM pi GROUP BY id), nn AS (SELECT id, count(*) AS n FROM ni GROUP BY id),
pc AS (SELECT s.id AS seed, o.id, count(*) AS c FROM seeds JOIN pi s USING (id) JOIN pi o ON s.item = o.item AND s.id <> o.id
  GROUP BY ALL),
nc AS (SELECT s.id AS seed, o.id, count(*) AS c FROM seeds JOIN ni s USING (id) JOIN ni o ON s.item = o.item AND s.id <> o.id
  GROUP BY ALL),
pj AS (SELECT seed, pc.id, c / (a.n + b.n - c) AS j FROM pc JOIN pn a ON a.id = pc.id JOIN pn b ON b.id = seed),
nj AS (SELECT seed, nc.id, c / (a.n + b.n - c) AS j FROM nc JOIN nn a ON a.id = nc.id JOIN nn b ON b.id = seed),
sc AS (SELECT coalesce(pj.seed, nj.seed) AS seed, coalesce(pj.id, nj.id) AS id,
    coalesce(pj.j, 0) * 0.5::DOUBLE + coalesce(nj.j, 0) * 0.5::DOUBLE AS similarity
  FROM pj FULL JOIN nj ON pj.seed = nj.seed AND pj.id = nj.id)
SELECT seed, sc.id, name, type, round(similarity, 6) AS similarity,
  CAST(row_number() OVER (PARTITION BY seed ORDER BY similarity DESC, sc.id) AS INTEGER) AS rank
FROM sc JOIN vertices v ON v.id = sc.id WHERE similarity >= 0.25""")
def h3_similar_customers(spark, sf):
    """Entities like the richest customer of each market segment, most alike first."""
    seeds = (table(spark, sf, "customer").groupBy("c_mktsegment")
             .agg(F.max_by(b.key("C", "c_custkey"), F.struct("c_acctbal", "c_custkey")).alias("id")))
    s = h.similar(b.vertices(spark, sf), b.edges(spark, sf), seeds, 0.25, without=("name", "revenue"))
    return s.withColumn("similarity", F.round("similarity", 6))


@query("""
SELECT 'P' || p_partkey AS id, part_no, part FROM (SELECT p_partkey, CASE p_size % 3
    WHEN 0 THEN ['prospectus', 'offering_memorandum'] WHEN 1 THEN ['prospectus'] END AS d FROM part)
  , LATERAL (SELECT unnest(range(0, len(d)))::INTEGER AS part_no, unnest(d) AS part) x WHERE d IS NOT NULL
UNION ALL SELECT 'P' || p_partkey, NULL, NULL FROM part WHERE p_size % 3 = 2""")
def h4_split_by_document(spark, sf):
    from ledgergraph.functions.values import get
    v = b.vertices(spark, sf).filter("type = 'FinancialInstrument'")
    docs = F.from_json(get(F.col("properties"), "documents"), "array<string>")
    return h.split_by(v, docs).select("id", "part_no", "part")


@query("""
SELECT o_custkey AS customer, count(*) AS orders, round(sum(o_totalprice), 2) AS amount, min(o_orderkey) AS first_order
FROM orders GROUP BY o_custkey""")
def h5_merged_transactions(spark, sf):
    o = table(spark, sf, "orders").withColumnRenamed("o_custkey", "customer")
    return h.merge_by(o, ["customer"], orders=F.count("*"), amount=F.round(F.sum("o_totalprice"), 2),
                      first_order=F.min("o_orderkey"))


@query("""
WITH w AS (SELECT conv_id, turn, list_distinct(list_filter(string_split_regex(lower(text), '[ \\t\\r\\n]+'),
  lambda x: x <> '')) AS w FROM conversations)
SELECT a.conv_id, a.turn, CAST(len(list_intersect(a.w, b.w)) AS INTEGER) AS shared_words
FROM w a JOIN w b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1""")
def h6_shared_words(spark, sf):
    """Words that a turn of a conversation has in common with the next one."""
    from ledgergraph.functions.text import words
    c = table(spark, sf, "conversations").select("conv_id", "turn", words(F.col("text")).alias("w"))
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("w").alias("w2"))
    return c.join(nxt, ["conv_id", "turn"]).select("conv_id", "turn",
                                                   F.size(F.array_intersect("w", "w2")).alias("shared_words"))


# Edge properties as JSON text, keys in the order in which they are set.
_KEYS = "['lines', 'quantity', 'issue_date', 'issue_price', 'issue_size', 'transaction_date', 'type', 'timestamp', 'value', 'severity', 'amount']"
EDGES_JSON = PROPS + f"""
SELECT e.id, '{{' || coalesce(string_agg('"' || key || '":"' || value || '"', ',' ORDER BY list_position({_KEYS}, key)), '') || '}}' AS properties
FROM edges e LEFT JOIN eprops p ON p.id = e.id GROUP BY e.id"""


@query(PROPS + """
SELECT seed, id, similarity, position FROM (SELECT a.id AS seed, b.id, a.n AS similarity,
    row_number() OVER (PARTITION BY a.id ORDER BY b.n DESC, b.id) AS position
  FROM (SELECT src AS id, count(*) AS n FROM edges WHERE type = 'SUPPLIES_TO' GROUP BY src) a
  JOIN (SELECT src, dst AS id, confidence AS n FROM edges WHERE type = 'SUPPLIES_TO') b ON b.src = a.id) WHERE position <= 3""")
def g2_best_partners(spark, sf):
    """The three most trusted customers of each supplier, best first, with the supplier's number of customers."""
    from ledgergraph.functions.ordering import first_n
    e = _of(spark, sf, "SUPPLIES_TO").select(F.col("src").alias("seed"), F.col("dst").alias("id"), "confidence")
    n = e.groupBy("seed").agg(F.count("*").alias("similarity"))
    top = first_n(e, ["seed"], ["-confidence", "id"], 3, F.col("id"))
    return top.join(n, "seed").select("seed", "id", "similarity", F.col("position").cast("long").alias("position"))
