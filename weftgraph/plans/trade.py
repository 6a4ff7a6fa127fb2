"""Graph queries over the trade projection and the event sequence, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftgraph.functions import paths as P
from weftgraph.operators import components as C
from weftgraph.operators import graph as G
from weftgraph.plans.projections import TRADE, table, trade

QUERIES, ORACLES = {}, {}
TEST = "(source_file LIKE 'tests/%')"


def query(sql: str | None = None, prefix: str = TRADE, name: str | None = None):
    def add(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLES[key] = prefix + sql
        return f

    return add


def edges_of(g):
    """(src, dst, relation) by id; what only counts or groups edges uses ``g.edges()``, by key."""
    return g.named(g.edges())


def members(g):
    return g.nodes.select("id", "comp")


def members_by_key(g):
    return g.by_key().select("id", "comp")


DEGREE = """, ends AS (SELECT src AS id, 1 AS o, 0 AS i FROM edges UNION ALL SELECT dst, 0, 1 FROM edges), deg AS (
  SELECT n.id, coalesce(sum(i), 0)::BIGINT AS in_degree, coalesce(sum(o), 0)::BIGINT AS out_degree, coalesce(sum(i) + sum(o), 0)::BIGINT AS degree
  FROM nodes n LEFT JOIN ends e ON n.id = e.id GROUP BY n.id)
"""


@query(DEGREE + f"SELECT id, label, type, in_degree, out_degree, degree FROM nodes JOIN deg USING (id) WHERE NOT {TEST} ORDER BY degree DESC, seq LIMIT 10")
def god_nodes(spark, sf):
    g = trade(spark, sf)
    return G.god_nodes(g.nodes, edges_of(g))


@query(DEGREE + "SELECT * FROM deg")
def node_degree(spark, sf):
    g = trade(spark, sf)
    return g.named(G.degrees(g.by_key(), g.edges()), "id")


@query("SELECT relation, count(*) AS n FROM edges GROUP BY relation")
def relation_counts(spark, sf):
    return G.relation_counts(trade(spark, sf).edges())


@query(f"SELECT count(*) AS nodes, count(*) FILTER (WHERE type = 'file') AS files, count(*) FILTER (WHERE type <> 'file') AS symbols, count(*) FILTER (WHERE type = 'file' AND {TEST}) AS test_files, (SELECT count(*) FROM edges) AS edges FROM nodes")
def graph_metrics(spark, sf):
    g = trade(spark, sf)
    return G.graph_metrics(g.nodes, g.edges())


@query("SELECT type, count(*) AS n FROM nodes GROUP BY type")
def node_counts(spark, sf):
    return trade(spark, sf).nodes.groupBy("type").agg(F.count("*").alias("n"))


@query("SELECT * FROM edges")
def edge_dedup(spark, sf):
    return edges_of(trade(spark, sf))


@query("SELECT src, dst, relation FROM edges WHERE src IN (SELECT id FROM nodes WHERE comp <> 2) AND dst IN (SELECT id FROM nodes WHERE comp <> 2)")
def valid_edges(spark, sf):
    g = trade(spark, sf)
    return g.named(G.valid_edges(g.edges(), g.by_key().where("comp <> 2")))


@query("SELECT src, dst FROM edges WHERE relation = 'imports' AND src IN (SELECT id FROM nodes WHERE type = 'file') AND dst IN (SELECT id FROM nodes WHERE type = 'file')")
def import_edges(spark, sf):
    g = trade(spark, sf)
    return G.between(g.imports(), g.nodes, "imports", True)


@query("SELECT src, dst FROM edges WHERE relation = 'calls' AND src <> dst AND src IN (SELECT id FROM nodes WHERE type <> 'file') AND dst IN (SELECT id FROM nodes WHERE type <> 'file')")
def call_edges(spark, sf):
    g = trade(spark, sf)
    return g.named(G.between(g.edges(), g.by_key(), "calls", False))


@query("SELECT a.comp AS src_comp, b.comp AS dst_comp, count(*) AS n FROM edges JOIN nodes a ON src = a.id JOIN nodes b ON dst = b.id WHERE a.comp <> b.comp GROUP BY ALL")
def inter_component(spark, sf):
    g = trade(spark, sf)
    return G.inter_component(g.edges(), members_by_key(g))


@query("SELECT src AS node, dst AS neighbour FROM edges UNION SELECT dst, src FROM edges")
def neighborhood(spark, sf):
    return G.neighborhood(edges_of(trade(spark, sf)))


DIRTY = "dirty AS (SELECT id AS file FROM nodes WHERE type = 'file' AND seq % 7 = 0)"
FORCED = f""", {DIRTY}, near AS (SELECT file FROM dirty UNION SELECT src FROM edges JOIN dirty ON dst = file WHERE relation = 'imports' UNION SELECT dst FROM edges JOIN dirty ON src = file WHERE relation = 'imports')
"""


def _near(g):
    dirty = g.nodes.where("type = 'file' AND seq % 7 = 0").select(F.col("id").alias("file"))
    return G.dependents(g.imports(), dirty)


@query(FORCED + "SELECT * FROM near")
def import_dependents(spark, sf):
    return _near(trade(spark, sf))


@query(FORCED + "SELECT id FROM nodes WHERE source_file IN (SELECT file FROM near)")
def force_render(spark, sf):
    g = trade(spark, sf)
    near = _near(g)
    return g.nodes.join(near, g.nodes.source_file == near.file, "left_semi").select("id")


@query("""SELECT a.comp, any_value(size) AS size, count(*) FILTER (WHERE e.src IS NOT NULL) AS edges, round(count(*) FILTER (WHERE e.src IS NOT NULL) / (any_value(size)::DOUBLE * (any_value(size) - 1)), 6) AS cohesion
FROM nodes a JOIN (SELECT comp, count(*) AS size FROM nodes GROUP BY comp) s ON s.comp = a.comp LEFT JOIN (SELECT src, dst, n.comp FROM edges JOIN nodes n ON n.id = dst) e ON e.src = a.id AND e.comp = a.comp GROUP BY a.comp""")
def component_cohesion(spark, sf):
    g = trade(spark, sf)
    return C.cohesion(members_by_key(g), g.edges(), 6)


WEIGHTED = f""", kept AS (SELECT id, regexp_extract(source_file, '^(.*)/[^/]*$', 1) AS dir FROM nodes WHERE NOT {TEST}), wt AS (
  SELECT least(src, dst) AS a, greatest(src, dst) AS b, sum((CASE relation WHEN 'contains' THEN 10.0 WHEN 'imports' THEN 2.0 ELSE 1.0 END)::DOUBLE * (CASE WHEN x.dir <> '' AND x.dir = y.dir THEN 1.5 ELSE 1.0 END)::DOUBLE) AS weight
  FROM edges JOIN kept x ON src = x.id JOIN kept y ON dst = y.id GROUP BY 1, 2)
"""


@query(WEIGHTED + "SELECT * FROM wt")
def weighted_edges(spark, sf):
    g = trade(spark, sf)
    named = g.named(C.weighted_edges(g.by_key(), g.edges()), "a", "b")
    return named.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "weight")


@query(WEIGHTED + """, st AS (SELECT comp, sum(weight) AS k FROM (SELECT a AS id, weight FROM wt UNION ALL SELECT b, weight FROM wt) JOIN nodes USING (id) GROUP BY comp)
SELECT round(sum(weight) FILTER (WHERE x.comp = y.comp) / sum(weight) - (SELECT sum(k * k) FROM st) / (4 * sum(weight) * sum(weight)), 6) AS modularity FROM wt JOIN nodes x ON a = x.id JOIN nodes y ON b = y.id""")
def modularity(spark, sf):
    g = trade(spark, sf)
    return C.modularity(C.weighted_edges(g.by_key(), g.edges()), members_by_key(g))


HUBS = DEGREE.rstrip() + f""", hubs AS (SELECT comp, id, label FROM (SELECT *, row_number() OVER (PARTITION BY comp ORDER BY CASE WHEN {TEST} THEN 1 ELSE 0 END, CASE WHEN type = 'file' THEN 1 ELSE 0 END, degree DESC, id) AS rn FROM nodes JOIN deg USING (id)) WHERE rn = 1)
"""


@query(HUBS + "SELECT * FROM hubs")
def component_hub(spark, sf):
    g = trade(spark, sf)
    return C.hub(g.nodes, edges_of(g), members(g))


@query("SELECT comp, count(*) AS size, row_number() OVER (ORDER BY count(*) DESC, min(id)) AS rank FROM nodes GROUP BY comp")
def component_rank(spark, sf):
    return C.ranked(members(trade(spark, sf)))


DIRS = """, dirs AS (SELECT comp, CASE WHEN min(d) = max(d) THEN min(d) ELSE '' END AS dir FROM (SELECT comp, regexp_extract(source_file, '^(.*)/[^/]*$', 1) AS d FROM nodes) GROUP BY comp)
"""


@query(DIRS + "SELECT * FROM dirs")
def common_dir(spark, sf):
    g = trade(spark, sf)
    return C.common_dir(members(g), g.nodes)


@query(HUBS.rstrip() + DIRS + "SELECT comp, dir || ' (' || label || ')' AS name FROM hubs JOIN dirs USING (comp)")
def component_names(spark, sf):
    g = trade(spark, sf)
    return C.names(C.hub(g.nodes, edges_of(g), members(g)), C.common_dir(members(g), g.nodes))


@query(f""", near AS (SELECT src AS node, dst AS o FROM edges UNION SELECT dst, src FROM edges), votes AS (
  SELECT node, b.comp, count(*) AS n FROM near JOIN nodes a ON node = a.id JOIN nodes b ON o = b.id WHERE a.source_file LIKE 'tests/%' AND b.source_file NOT LIKE 'tests/%' GROUP BY ALL)
SELECT id, v.comp FROM nodes LEFT JOIN (SELECT node, comp FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY n DESC, comp) AS rn FROM votes) WHERE rn = 1) v ON v.node = id WHERE {TEST}""")
def attach_tests(spark, sf):
    g = trade(spark, sf)
    test = P.is_test_path(F.col("source_file"))
    nodes = g.by_key()
    return g.named(C.attach_tests(nodes.where(test), g.edges(), nodes.where(~test).select("id", "comp")), "id")


@query()
def louvain(spark, sf):
    g = trade(spark, sf)
    kept = g.by_key().where(~P.is_test_path(F.col("source_file")))
    marks = g.names().select(F.col("key").alias("id"), F.hash("id").alias("tie"), F.pmod(F.xxhash64("id"), F.lit(2)).alias("half"))
    return g.named(C.louvain(C.weighted_edges(g.by_key(), g.edges()), kept, marks=marks), "id", "comp")


@query("SELECT dir, n, CASE WHEN n > 3 THEN sample || ', etc.' ELSE sample END AS sample FROM (SELECT split_part(id, '/', 1) AS dir, count(*) AS n, array_to_string(list_sort(list(split_part(id, '/', -1)))[1:3], ', ') AS sample FROM nodes WHERE type = 'file' GROUP BY 1)")
def top_dirs(spark, sf):
    return C.top_dirs(trade(spark, sf).nodes)


PATHS = """, e AS (SELECT DISTINCT src, dst FROM edges WHERE relation = 'imports'), walk AS (
  SELECT src AS first, dst AS last, [src, dst] AS p FROM e WHERE dst > src
  UNION ALL SELECT first, dst, list_append(p, dst) FROM walk JOIN e ON last = src WHERE dst > first AND NOT list_contains(p, dst))
SELECT array_to_string(p, ' > ') AS path, len(p)::INT AS length FROM walk JOIN e ON last = src AND dst = first UNION ALL SELECT src, 1 FROM e WHERE src = dst"""


@query(PATHS)
def import_cycles(spark, sf):
    g = trade(spark, sf)
    return G.simple_cycles(G.between(g.imports(), g.nodes, "imports", True))


EVENTS = """WITH RECURSIVE e AS (SELECT DISTINCT src, dst FROM (SELECT event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events) WHERE src <> dst)
"""


def event_edges(spark, sf):
    nxt = F.lead("event_type").over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    e = table(spark, sf, "events").select(F.col("event_type").alias("src"), nxt.alias("dst"))
    return e.where("src <> dst").distinct()


@query(""", reach AS (SELECT src AS a, dst AS b FROM e UNION SELECT a, dst FROM reach JOIN e ON b = src), ids AS (SELECT src AS id FROM e UNION SELECT dst FROM e)
SELECT id, coalesce((SELECT min(x.b) FROM reach x JOIN reach y ON x.b = y.a AND y.b = x.a WHERE x.a = id), id) AS scc FROM ids""", EVENTS)
def scc(spark, sf):
    return G.scc(event_edges(spark, sf))


@query(""", walk AS (SELECT src AS first, dst AS last, [src, dst] AS p FROM e WHERE dst > src UNION ALL SELECT first, dst, list_append(p, dst) FROM walk JOIN e ON last = src WHERE dst > first AND NOT list_contains(p, dst) AND len(p) < 8)
SELECT array_to_string(p, ' > ') AS path, len(p)::INT AS length FROM walk JOIN e ON last = src AND dst = first ORDER BY length, path LIMIT 20""", EVENTS)
def call_cycles(spark, sf):
    return G.call_cycles(event_edges(spark, sf))
