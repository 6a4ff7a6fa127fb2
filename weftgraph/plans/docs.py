"""Scan-like, incremental and rendering queries over documents, pages, parts and the trade graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftgraph.functions import paths as P
from weftgraph.operators import components as C
from weftgraph.operators import graph as G
from weftgraph.operators import incremental as I
from weftgraph.operators import render as V
from weftgraph.operators import resolve as R
from weftgraph.plans.projections import TRADE, table, trade
from weftgraph.plans.query import registry
from weftgraph.plans.trade import DEGREE, FORCED, _near, edges_of, members_by_key

QUERIES, ORACLES, query = registry()

# Documents as files: path source/doc_id.ext, size n_chars.
EXT = {"en": ".py", "fr": ".go", "de": ".rs", "es": ".H"}
DOC = """WITH d AS (SELECT doc_id, text, n_chars, source || '/' || CASE WHEN doc_id % 5 = 0 THEN 'Tests/' WHEN doc_id % 7 = 0 THEN 'Node_Modules/' ELSE '' END || doc_id::VARCHAR || CASE lang WHEN 'en' THEN '.py' WHEN 'fr' THEN '.go' WHEN 'de' THEN '.rs' WHEN 'es' THEN '.H' ELSE '' END AS path FROM documents)
"""


def docs(spark, sf):
    d = table(spark, sf, "documents")
    ext = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in EXT.items() for x in kv]), F.col("lang")), F.lit(""))
    inner = F.when(F.col("doc_id") % 5 == 0, "Tests/").when(F.col("doc_id") % 7 == 0, "Node_Modules/").otherwise("")
    return d.select("doc_id", "text", "n_chars", F.concat("source", F.lit("/"), inner, F.col("doc_id").cast("string"), ext).alias("path"))


@query(DOC + "SELECT doc_id, contains(lower(path), '/node_modules/') AS excluded FROM d")
def path_exclusion(spark, sf):
    return docs(spark, sf).select("doc_id", P.is_excluded(F.col("path")).alias("excluded"))


@query(DOC + "SELECT path FROM d WHERE (path LIKE 'src1/%' OR path LIKE 'src2/%') AND NOT contains(lower(path), '/node_modules/')")
def include_filter(spark, sf):
    d = docs(spark, sf)
    return d.where((F.startswith("path", F.lit("src1/")) | F.startswith("path", F.lit("src2/"))) & ~P.is_excluded(F.col("path"))).select("path")


@query(DOC + "SELECT doc_id, CASE WHEN path LIKE '%.py' THEN 'python' WHEN path LIKE '%.go' THEN 'go' WHEN path LIKE '%.rs' THEN 'rust' WHEN path LIKE '%.H' THEN 'c' END AS language FROM d")
def detect_language(spark, sf):
    return docs(spark, sf).select("doc_id", P.language_of(F.col("path")).alias("language"))


@query(DOC + "SELECT CASE WHEN path LIKE '%.go' THEN 'go' WHEN path LIKE '%.rs' THEN 'rust' WHEN path LIKE '%.H' THEN 'c' ELSE 'python' END AS strategy, count(*) AS n FROM d GROUP BY 1")
def file_language(spark, sf):
    """Files per resolver strategy; Python where the ending says nothing."""
    return docs(spark, sf).groupBy(F.coalesce(P.language_of(F.col("path")), F.lit("python")).alias("strategy")).agg(F.count("*").alias("n"))


@query(DOC + "SELECT doc_id, contains(lower(path), '/tests/') AS is_test FROM d")
def is_test_path(spark, sf):
    return docs(spark, sf).select("doc_id", P.is_test_path(F.col("path")).alias("is_test"))


@query("SELECT doc_id, md5(text) AS md5 FROM documents")
def content_md5(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5("text").alias("md5"))


@query("SELECT doc_id, greatest(1, len(string_split(regexp_replace(text, '\\n$', ''), chr(10)))) AS lines FROM documents")
def line_count(spark, sf):
    return table(spark, sf, "documents").select("doc_id", P.line_count(F.col("text")).alias("lines"))


@query("SELECT doc_id, md5(concat_ws('|', doc_id::VARCHAR, lang, source, n_chars::VARCHAR)) AS hash FROM documents")
def stable_hash(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(F.concat_ws("|", F.col("doc_id").cast("string"), "lang", "source", F.col("n_chars").cast("string"))).alias("hash"))


@query(DOC + ", dirs AS (SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, md5(string_agg(path || '|' || md5(text), ';' ORDER BY path || '|' || md5(text))) AS h FROM d GROUP BY 1) SELECT md5(string_agg(dir || '|' || h, ';' ORDER BY dir || '|' || h) || '#naming=hybrid,tests=true') AS fingerprint FROM dirs")
def fingerprint(spark, sf):
    return I.fingerprint(docs(spark, sf).select("path", F.md5("text").alias("md5")), naming="hybrid", tests="true")


# Two snapshots of the files: ids not divisible by 11 now, by 13 before; size differs where 17 divides.
SNAP = DOC.rstrip() + ", cur AS (SELECT path, doc_id AS m, n_chars AS s FROM d WHERE doc_id % 11 <> 0), old AS (SELECT path, doc_id AS m, n_chars + CASE WHEN doc_id % 17 = 0 THEN 1 ELSE 0 END AS s FROM d WHERE doc_id % 13 <> 0)\n"


def _snapshots(spark, sf):
    d = docs(spark, sf)
    cur = d.where("doc_id % 11 <> 0").select("path", F.col("doc_id").alias("mtime_ns"), F.col("n_chars").alias("size"))
    old = d.where("doc_id % 13 <> 0").select("path", F.col("doc_id").alias("mtime_ns"), (F.col("n_chars") + (F.col("doc_id") % 17 == 0).cast("int")).alias("size"))
    return cur, old


@query(SNAP + "SELECT coalesce(c.path, o.path) AS path, CASE WHEN o.path IS NULL THEN 'new' WHEN c.path IS NULL THEN 'removed' ELSE 'changed' END AS reason FROM cur c FULL JOIN old o ON c.path = o.path WHERE o.path IS NULL OR c.path IS NULL OR c.s <> o.s")
def dirty_files(spark, sf):
    return I.dirty_files(*_snapshots(spark, sf))


@query(SNAP + "SELECT path FROM old WHERE path NOT IN (SELECT path FROM cur)")
def removed_files(spark, sf):
    return I.removed_files(*_snapshots(spark, sf))


@query(SNAP + "SELECT path FROM d WHERE path NOT IN (SELECT path FROM cur WHERE m % 2 = 0 UNION SELECT path FROM old WHERE m % 3 = 0)")
def obsolete_pages(spark, sf):
    cur, old = _snapshots(spark, sf)
    return I.obsolete(docs(spark, sf).select("path"), cur.where("mtime_ns % 2 = 0"), old.where("mtime_ns % 3 = 0"))


PLAN = SNAP.rstrip() + ", plan AS (SELECT coalesce(c.path, o.path) AS path, CASE WHEN c.path IS NULL THEN 'delete' WHEN c.s = o.s THEN 'keep' ELSE 'write' END AS action FROM cur c FULL JOIN old o ON c.path = o.path)\n"


def _plan(spark, sf):
    cur, old = _snapshots(spark, sf)
    page = lambda t: t.select("path", F.md5(F.col("size").cast("string")).alias("md5"))
    return I.vault_plan(page(cur), page(old))


@query(PLAN + "SELECT * FROM plan")
def vault_plan(spark, sf):
    return _plan(spark, sf)


@query(PLAN + "SELECT action, count(*) AS n FROM plan GROUP BY action")
def render_stats(spark, sf):
    return _plan(spark, sf).groupBy("action").agg(F.count("*").alias("n"))


@query("SELECT doc_id, CASE WHEN contains(text, '. ') THEN md5(substr(text, strpos(text, '. ') + 2)) END AS section_md5 FROM documents")
def section_after_marker(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(I.section_after(F.col("text"), ". ")).alias("section_md5"))


@query("SELECT page_id, regexp_replace(url, '[\\\\/.: *?#^\\[\\]\"<>|]+', '_', 'g') || '.md' AS filename FROM pages")
def node_filename(spark, sf):
    return table(spark, sf, "pages").select("page_id", P.node_filename(F.col("url")).alias("filename"))


@query("SELECT page_id, regexp_replace(url, '[\\\\/.: *?#^\\[\\]\"<>|()]+', '_', 'g') || '.md' AS filename FROM pages")
def component_filename(spark, sf):
    return table(spark, sf, "pages").select("page_id", P.component_filename(F.col("url")).alias("filename"))


@query("SELECT page_id, md5(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(10), '<br>')) AS escaped_md5 FROM pages")
def html_escape(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.md5(P.html_escape(F.col("html"))).alias("escaped_md5"))


# Parts as symbols: label p_name, directory p_brand.
PART = "WITH s AS (SELECT p_partkey AS seq, p_name AS label, p_brand AS dir, p_brand || '/' || p_type || '::' || p_name AS id, p_brand || '/' || p_type AS source_file FROM part)\n"


def parts(spark, sf):
    p = table(spark, sf, "part")
    file = F.concat("p_brand", F.lit("/"), "p_type")
    return p.select(F.concat(file, F.lit("::"), "p_name").alias("id"), F.col("p_name").alias("label"), F.lit("class").alias("type"), file.alias("source_file"), F.col("p_partkey").alias("seq"))


@query(PART + "SELECT label, md5(string_agg(id, ',' ORDER BY seq)) AS ids_md5, count(*) AS n FROM s GROUP BY label")
def global_symbols(spark, sf):
    p = parts(spark, sf)
    return R.global_symbols(p).join(p.groupBy("label").agg(F.count("*").alias("n")), "label").select("label", F.md5("ids").alias("ids_md5"), "n")


@query(PART + "SELECT dir, label, arg_min(id, seq) AS first_id, count(*) AS n FROM s GROUP BY dir, label")
def dir_symbols(spark, sf):
    return R.dir_symbols(parts(spark, sf))


@query(DOC + """, m AS (SELECT CASE WHEN doc_id % 7 = 1 THEN 0 WHEN doc_id % 5 = 0 THEN 2 * (ascii(split_part(path, '/', 1)[-1])) ELSE 1 + 2 * ascii(split_part(path, '/', 1)[-1]) END AS comp, regexp_extract(path, '^(.*)/[^/]*$', 1) AS d FROM d)
SELECT comp, CASE WHEN min(d) = max(d) THEN min(d) WHEN min(split_part(d, '/', 1)) = max(split_part(d, '/', 1)) THEN min(split_part(d, '/', 1)) ELSE '' END AS dir FROM m GROUP BY comp""")
def common_dir_of_many(spark, sf):
    """Components with one folder, with a folder and its subfolders, and with nothing in common."""
    d = docs(spark, sf)
    last = F.ascii(F.substring(F.split_part("path", F.lit("/"), F.lit(1)), -1, 1))
    comp = F.when(F.col("doc_id") % 7 == 1, 0).when(F.col("doc_id") % 5 == 0, 2 * last).otherwise(1 + 2 * last)
    return C.common_dir(d.select(F.col("doc_id").alias("id"), comp.alias("comp")), d.select(F.col("doc_id").alias("id"), F.col("path").alias("source_file")))


@query(DOC + "SELECT doc_id, CASE regexp_extract(lower(path), '\\.([^./]+)$', 1) WHEN 'py' THEN 'python' WHEN 'go' THEN 'go' WHEN 'rs' THEN 'rust' ELSE '' END AS fence FROM d")
def fence_language(spark, sf):
    return docs(spark, sf).select("doc_id", V.fence(F.col("path")).alias("fence"))


# Pages and exports of the trade graph.
INTER = ", inter AS (SELECT a.comp AS src_comp, b.comp AS dst_comp, count(*) AS n FROM edges JOIN nodes a ON src = a.id JOIN nodes b ON dst = b.id WHERE a.comp <> b.comp GROUP BY ALL)\n"
NODE_SIG = """, o AS (SELECT src AS id, string_agg(relation || '|' || dst, ';' ORDER BY relation || '|' || dst) AS o FROM edges GROUP BY src), i AS (SELECT dst AS id, string_agg(relation || '|' || src, ';' ORDER BY relation || '|' || src) AS i FROM edges GROUP BY dst),
sig AS (SELECT n.id, md5(concat_ws('#', n.id, label, type, source_file, comp::VARCHAR, coalesce(o, ''), coalesce(i, ''))) AS signature FROM nodes n LEFT JOIN o ON o.id = n.id LEFT JOIN i ON i.id = n.id)
"""


@query(NODE_SIG + "SELECT * FROM sig", TRADE)
def node_signature(spark, sf):
    g = trade(spark, sf)
    return I.node_signatures(g.nodes, g.edges())


@query(INTER.rstrip() + ", m AS (SELECT comp, string_agg(id, ';' ORDER BY id) AS m FROM nodes GROUP BY comp), dd AS (SELECT src_comp AS comp, string_agg(dst_comp::VARCHAR || '|' || n::VARCHAR, ';' ORDER BY dst_comp::VARCHAR || '|' || n::VARCHAR) AS d FROM inter GROUP BY 1) SELECT comp, md5(concat_ws('#', comp::VARCHAR, m, coalesce(d, ''))) AS signature FROM m LEFT JOIN dd USING (comp)", TRADE)
def component_signature(spark, sf):
    g = trade(spark, sf)
    return I.component_signatures(g.nodes, G.inter_component(g.edges(), members_by_key(g)))


@query(NODE_SIG.rstrip() + FORCED + "SELECT sig.id, CASE WHEN seq % 3 <> 0 AND seq % 5 <> 0 AND source_file NOT IN (SELECT file FROM near) THEN 'reuse' ELSE 'render' END AS action FROM sig JOIN nodes USING (id)", TRADE)
def render_plan(spark, sf):
    """Before, a third of the nodes had other signatures; a fifth of the pages are not on disk."""
    g = trade(spark, sf)
    new = G.cut(I.node_signatures(g.nodes, g.edges()))  # read twice
    seq = g.nodes.select("id", "seq")
    old = new.join(seq, "id").select("id", F.when(F.col("seq") % 3 == 0, "other").otherwise(F.col("signature")).alias("signature"))
    near = _near(g)
    forced = g.nodes.join(near, g.nodes.source_file == near.file, "left_semi").select("id")
    return I.render_plan(new, old, seq.where("seq % 5 <> 0").select("id"), forced)


SECTIONS = """, ends AS (SELECT src AS id, 'out' AS dir, relation, dst AS other FROM edges UNION ALL SELECT dst, 'in', relation, src FROM edges),
e AS (SELECT x.*, n.label, n.type, m.label AS mine FROM ends x JOIN nodes n ON n.id = other JOIN nodes m ON m.id = x.id),
l AS (SELECT id, CASE WHEN dir = 'in' AND relation = 'contains' THEN 'Parent' WHEN relation = 'contains' THEN 'Contains Symbols' WHEN relation = 'imports' THEN CASE dir WHEN 'out' THEN 'Imports' ELSE 'Imported By' END
  WHEN relation = 'calls' THEN CASE dir WHEN 'out' THEN 'Outgoing Calls' ELSE 'Incoming Calls' END ELSE CASE dir WHEN 'out' THEN 'Inherits / Implements' ELSE 'Inherited / Implemented By' END END AS section,
  '- [' || label || '](' || regexp_replace(other, '[\\\\/.: *?#^\\[\\]"<>|]+', '_', 'g') || '.md) (`' || type || '`)' AS line FROM e
  UNION ALL SELECT DISTINCT id, 'Diagram', CASE dir WHEN 'out' THEN '  ' || a || ' --> ' || z ELSE '  ' || z || ' --> ' || a END FROM (
    SELECT id, dir, regexp_replace(id, '[^a-zA-Z0-9_]', '_', 'g') || '["' || mine || '"]' AS a, regexp_replace(other, '[^a-zA-Z0-9_]', '_', 'g') || '["' || label || '"]' AS z FROM e WHERE relation = 'calls'))
SELECT id, section, count(*) AS n, md5(string_agg(line, chr(10) ORDER BY line)) AS lines_md5 FROM l GROUP BY id, section"""


@query(SECTIONS, TRADE)
def node_sections(spark, sf):
    """The lists and the call diagram of every node's page."""
    g = trade(spark, sf)
    return g.named(V.node_sections(g.nodes, g.edges()).select("id", "section", "n", F.md5("lines").alias("lines_md5")), "id")


CLEAN = "regexp_replace({}, '[\\\\/.: *?#^\\[\\]\"<>|{}]+', '_', 'g') || '.md'"
LINES = "SELECT {0} AS id, string_agg('- ' || relation || ' [[' || {1} || ']]', chr(10) ORDER BY '- ' || relation || ' [[' || {1} || ']]') AS x FROM edges GROUP BY 1"


@query(", o AS (" + LINES.format("src", "dst") + "), i AS (" + LINES.format("dst", "src") + ") SELECT n.id, " + CLEAN.format("n.id", "") + " AS path, md5('---' || chr(10) || 'id: ' || n.id || chr(10) || 'type: ' || type || chr(10) || 'source: ' || source_file || chr(10) || '---' || chr(10) || '# ' || label || coalesce(chr(10) || '## Uses' || chr(10) || o.x, '') || coalesce(chr(10) || '## Used by' || chr(10) || i.x, '')) AS content_md5 FROM nodes n LEFT JOIN o ON o.id = n.id LEFT JOIN i ON i.id = n.id", TRADE)
def node_page(spark, sf):
    g = trade(spark, sf)
    return V.node_pages(g.nodes, g.edges()).select("id", "path", F.md5("content").alias("content_md5"))


@query(INTER.rstrip() + """, m AS (SELECT comp, string_agg('- ' || label || ' (' || type || ')', chr(10) ORDER BY '- ' || label || ' (' || type || ')') AS m FROM nodes GROUP BY comp), dd AS (SELECT src_comp AS comp, string_agg('- ' || dst_comp || ': ' || n, chr(10) ORDER BY n DESC, dst_comp) AS d FROM inter GROUP BY 1)
SELECT comp, 'part_' || comp || '.md' AS path, md5('# part ' || comp || chr(10) || '## Members' || chr(10) || m || coalesce(chr(10) || '## Depends on' || chr(10) || d, '')) AS content_md5 FROM m LEFT JOIN dd USING (comp)""", TRADE)
def component_page(spark, sf):
    g = trade(spark, sf)
    names = g.nodes.select("comp").distinct().withColumn("name", F.concat(F.lit("part "), F.col("comp").cast("string")))
    return V.component_pages(g.nodes, names, G.inter_component(g.edges(), members_by_key(g))).select("comp", "path", F.md5("content").alias("content_md5"))


SAFE = "regexp_replace({}, '[^a-zA-Z0-9_]', '_', 'g')"


@query(f", l AS (SELECT src, dst, {SAFE.format('src')} || ' --> ' || {SAFE.format('dst')} AS x FROM edges), u AS (SELECT src AS id, x FROM l UNION SELECT dst, x FROM l) SELECT id, md5(string_agg(x, chr(10) ORDER BY x)) AS diagram_md5, count(*) AS lines FROM u GROUP BY id", TRADE)
def node_mermaid(spark, sf):
    g = trade(spark, sf)
    return V.node_mermaid(g.names(), g.edges())


@query(INTER + "SELECT 'part_' || src_comp || ' -->|' || n || '| part_' || dst_comp AS line FROM inter UNION ALL SELECT DISTINCT 'part_' || comp FROM nodes WHERE comp NOT IN (SELECT src_comp FROM inter UNION SELECT dst_comp FROM inter)", TRADE)
def component_mermaid(spark, sf):
    g = trade(spark, sf)
    names = g.nodes.select("comp").distinct().withColumn("name", F.concat(F.lit("part "), F.col("comp").cast("string")))
    return V.component_mermaid(names, G.inter_component(g.edges(), members_by_key(g)))


@query(", r AS (SELECT relation, count(*) AS n FROM edges GROUP BY relation) SELECT string_agg(relation || ': ' || n || ' (' || printf('%.1f%%', n * 100.0::DOUBLE / (SELECT sum(n) FROM r)) || ')', ', ' ORDER BY relation) AS relation_mix FROM r", TRADE)
def readme_stats(spark, sf):
    return V.readme_stats(trade(spark, sf).edges())


@query(DEGREE + "SELECT id, type, 10.0 + least(degree * 1.5, 30.0)::DOUBLE AS size FROM nodes JOIN deg USING (id)", TRADE)
def viz_node_size(spark, sf):
    g = trade(spark, sf)
    return V.viz_nodes(g.nodes, G.degrees(g.nodes, edges_of(g)))


@query("SELECT id, label, type, source_file, comp FROM nodes", TRADE)
def export_nodes(spark, sf):
    return trade(spark, sf).nodes.select("id", "label", "type", "source_file", "comp")


@query("SELECT src AS source, dst AS target, relation FROM edges", TRADE)
def export_edges(spark, sf):
    return edges_of(trade(spark, sf)).select(F.col("src").alias("source"), F.col("dst").alias("target"), "relation")


@query("SELECT (SELECT count(*) FROM nodes) AS total_nodes, (SELECT count(*) FROM edges) AS total_edges, (SELECT count(DISTINCT comp) FROM nodes) AS components, (SELECT count(*) FROM nodes WHERE type = 'file') AS files", TRADE)
def export_stats(spark, sf):
    g = trade(spark, sf)
    n = g.nodes.agg(F.count("*").alias("total_nodes"), F.count_distinct("comp").alias("components"), F.count_if(F.col("type") == "file").alias("files"))
    return n.crossJoin(g.edges().agg(F.count("*").alias("total_edges"))).select("total_nodes", "total_edges", "components", "files")
