"""Resolver queries over a small code graph that both engines hold as literal rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftgraph.functions import languages as L
from weftgraph.functions import signatures as S
from weftgraph.operators import components as C
from weftgraph.operators import graph as G
from weftgraph.operators import resolve as R
from weftgraph.plans.query import registry

FILES = "app/main.py app/models.py app/util.py far/util2.py pkg/a.go pkg/b.go lib/x.rs web/i.ts".split()
SYMBOLS = [
    ("app/main.py::run", "run", "function", "def run(m: Model) -> Result"),
    ("app/main.py::helper", "helper", "function", "def helper(x)"),
    ("app/main.py::App", "App", "class", "class App"),
    ("app/main.py::App.start", "start", "method", "def start(self) -> models.Model"),
    ("app/main.py::App.halt", "halt", "method", "def halt(self)"),
    ("app/models.py::Model", "Model", "class", "class Model"),
    ("app/models.py::Model.load", "load", "method", "def load(self) -> Optional<Model>"),
    ("app/models.py::Model.save", "save", "method", "def save(self) -> None"),
    ("app/models.py::make", "make", "function", "def make() -> Model"),
    ("app/util.py::slug", "slug", "function", "def slug(s) -> str"),
    ("app/util.py::Cache", "Cache", "class", "class Cache"),
    ("app/util.py::Cache.fetch", "fetch", "method", "def fetch(self, k) -> Model"),
    ("app/util.py::only", "only", "function", "def only()"),
    ("far/util2.py::slug", "slug", "function", "def slug(s)"),
    ("pkg/a.go::Serve", "Serve", "function", "func Serve(n int) *Server {"),
    ("pkg/a.go::Server", "Server", "struct", "type Server struct"),
    ("pkg/a.go::Server.Start", "Start", "method", "func (s *Server) Start() (*Conn, error) {"),
    ("pkg/b.go::boot", "boot", "function", "func boot() error {"),
    ("lib/x.rs::Engine", "Engine", "struct", "pub struct Engine"),
    ("lib/x.rs::Engine.spin", "spin", "method", "fn spin(&self) -> Option<Gear>"),
    ("lib/x.rs::Gear", "Gear", "struct", "pub struct Gear"),
    ("lib/x.rs::Gear.turn", "turn", "method", "fn turn(&self) -> std::Angle"),
]
NODES = [(p, p.rsplit("/", 1)[-1], "file", p, "", i) for i, p in enumerate(FILES)] + [(i, lab, t, i.split("::")[0], sig, 100 + k) for k, (i, lab, t, sig) in enumerate(SYMBOLS)]
IMPORTED = [("app/main.py", "Model", "app/models.py", "Model"), ("app/main.py", "util", "app/util.py", "util"), ("app/main.py", "mk", "app/models.py", "make"), ("app/main.py", "ghost", "app/models.py", "missing"), ("app/util.py", "M", "app/models.py", "Model")]
WILDCARDS = [("app/models.py", 0, "app/util.py"), ("web/i.ts", 1, "app/main.py"), ("web/i.ts", 2, "app/models.py")]
BINDINGS = [("app/main.py::run", "m", "Model"), ("app/main.py::run", "x", "y"), ("app/main.py::run", "y", "mk()"), ("app/main.py::run", "e", "Unknown"), ("app/main.py::App.start", "c", "util.Cache"), ("app/main.py::App.start", "a", "b"), ("app/main.py::App.start", "b", "a"), ("lib/x.rs::Engine.spin", "g", "Gear")]
REFS = [
    ("app/main.py::run", "print"), ("app/main.py::run", "m.save"), ("app/main.py::run", "m.load().save"), ("app/main.py::run", "m.nothing"), ("app/main.py::run", "e.save"), ("app/main.py::App.start", "self.halt"),
    ("app/main.py::App.start", "halt"), ("app/main.py::App.start", "self.gone"), ("app/main.py::run", "helper"), ("app/main.py::run", "App.start"), ("app/main.py::run", "mk"), ("app/main.py::run", "util.slug"),
    ("app/main.py::run", "util"), ("app/main.py::run", "ghost"), ("app/main.py::run", "Model.load"), ("app/models.py::make", "slug"), ("app/models.py::make", "Cache.fetch"), ("app/models.py::make", "boot"),
    ("app/util.py::only", "slug"), ("far/util2.py::slug", "only"), ("far/util2.py::slug", "x.only"), ("far/util2.py::slug", "x.get"), ("far/util2.py::slug", "os.path"), ("pkg/b.go::boot", "Serve"), ("pkg/b.go::boot", "Server.Start"),
    ("pkg/b.go::boot", "fmt.Println"), ("lib/x.rs::Engine.spin", "g.turn"), ("lib/x.rs::Engine.spin", "self::turn"), ("web/i.ts", "run"), ("web/i.ts", "Model.save"), ("app/main.py::helper", "nobody"), ("app/main.py::run", "Model.nothing"), ("app/main.py::helper", "mk.nothing"), ("app/main.py::run", "x.save"), ("app/main.py::App.start", "c.fetch"),
]
IMPORTS = [("app/main.py", "app.models", "Model=Model,mk=make"), ("app/main.py", "util", ""), ("app/models.py", "app.util", "*=*"), ("app/main.py", "./util.py", ""), ("lib/x.rs", "x", ""), ("pkg/a.go", "pkg/b", ""), ("app/main.py", "nowhere.mod", ""), ("app/main.py", "../pkg/a.go", ""), ("web/i.ts", "./i", "d=default"), ("web/a/b/m.ts", "../../i", "q=default"), ("web/m.ts", "../../gone/x", ""), ("web/a/n.ts", "./.././i.ts", "")]
EDGES = [("calls", c, f, i) for i, (f, c) in enumerate(REFS)] + [("imports", t, f, 100 + i) for i, (f, t) in enumerate([("app/main.py", "os.path"), ("app/main.py", "./gone"), ("app/main.py", "requests"), ("pkg/a.go", "fmt")])] + [("contains", "app/x", "app/main.py", 200), ("inherits", "Model", "app/util.py::Cache", 201)]


def values(rows) -> str:
    show = lambda v: "NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(map(show, r)) + ")" for r in rows)


PREFIX = f"""WITH RECURSIVE nodes(id, label, type, source_file, signature, seq) AS (VALUES {values(NODES)}),
imported(file, local, tf, orig) AS (VALUES {values(IMPORTED)}), wildcards(file, ord, tf) AS (VALUES {values(WILDCARDS)}),
bindings(node_id, var, bound) AS (VALUES {values(BINDINGS)}), refs0(ref_id, caller, callee) AS (VALUES {values([(i, *r) for i, r in enumerate(REFS)])}),
imports(ref_id, source_file, target, map) AS (VALUES {values([(i, *r) for i, r in enumerate(IMPORTS)])}),
builtins(lang, symbol) AS (VALUES {L.sql_list(L.BUILTINS)}), stdlib(lang, symbol) AS (VALUES {L.sql_list(L.STDLIB)}),
common(symbol) AS (VALUES {values([(m,) for m in sorted(L.COMMON_METHODS)])}),
ext(e, lang) AS (VALUES ('py', 'python'), ('go', 'go'), ('rs', 'rust'), ('ts', 'typescript')),
refs AS (
  SELECT r.*, n.source_file AS file, regexp_extract(n.source_file, '^(.*)/[^/]*$', 1) AS dir, e.lang,
         list_filter(list_transform(string_split(replace(callee, '::', '.'), '.'), lambda x: trim(x)), lambda x: x <> '') AS parts,
         CASE WHEN contains(replace(callee, '::', '.'), '.') THEN substr(replace(callee, '::', '.'), strpos(replace(callee, '::', '.'), '.') + 1) ELSE '' END AS rest,
         CASE WHEN contains(caller, '.') THEN regexp_extract(caller, '^(.*)\\.[^.]*$', 1) END AS parent
  FROM refs0 r JOIN nodes n ON n.id = caller JOIN ext e ON e.e = split_part(n.source_file, '.', -1)
), syms AS (SELECT *, regexp_extract(source_file, '^(.*)/[^/]*$', 1) AS dir FROM nodes WHERE type <> 'file')
"""
QUERIES, ORACLES, query = registry(PREFIX)


def index(spark) -> R.Index:
    frame = spark.createDataFrame
    return R.Index(
        frame(NODES, "id string, label string, type string, source_file string, signature string, seq long"),
        frame(BINDINGS, "node_id string, var string, bound string"),
        frame(IMPORTED, "file string, local string, target_file string, original string"),
        frame(WILDCARDS, "file string, ord int, target_file string"),
    )


def refs(spark):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(REFS)], "ref_id int, caller string, callee string")


def step(f):
    def run(spark, sf):
        ix = index(spark)
        return f(R.wide(refs(spark), ix.nodes), ix)

    return run


def add_step(name: str, f, sql: str):
    run = step(f)
    run.__name__ = name
    query(sql)(run)


FIRST = "SELECT ref_id, 'hit' AS status, target FROM (SELECT ref_id, target, row_number() OVER (PARTITION BY ref_id ORDER BY pos) AS rn FROM c JOIN nodes ON id = target) WHERE rn = 1"
add_step("step_builtin", R.step_builtin, "SELECT ref_id, 'stop' AS status, NULL::VARCHAR AS target FROM refs JOIN builtins b ON b.lang = refs.lang AND b.symbol = parts[1]")
add_step("step_self", R.step_self, ", c AS (SELECT ref_id, 0 AS pos, parent || '.' || rest AS target FROM refs WHERE parts[1] IN ('self', 'this', 'cls') AND len(parts) > 1 UNION ALL SELECT ref_id, 1, parent || '.' || parts[-1] FROM refs WHERE parts[1] IN ('self', 'this', 'cls') AND len(parts) > 1) " + FIRST)
BASE = ", b AS ({}), c AS (SELECT ref_id, 0 AS pos, base || '.' || rest AS target FROM b JOIN nodes ON id = base WHERE rest <> '' UNION ALL SELECT ref_id, 1, base FROM b JOIN nodes ON id = base) " + FIRST
add_step("step_class", R.step_class, BASE.format("SELECT ref_id, rest, parent || '.' || parts[1] AS base FROM refs WHERE parent IS NOT NULL"))
add_step("step_file", R.step_file, BASE.format("SELECT ref_id, rest, file || '::' || parts[1] AS base FROM refs"))
add_step("step_package", R.step_package, BASE.format("SELECT ref_id, rest, arg_min(id, seq) AS base FROM refs JOIN syms s ON s.dir = refs.dir AND split_part(id, '::', 2) = parts[1] WHERE lang IN ('go', 'swift', 'ocaml') GROUP BY ref_id, rest"))
add_step("step_wildcard", R.step_wildcard, BASE.format("SELECT ref_id, rest, arg_min(tf || '::' || parts[1], ord) AS base FROM refs JOIN wildcards w ON w.file = refs.file WHERE tf || '::' || parts[1] IN (SELECT id FROM nodes) GROUP BY ref_id, rest"))
add_step("step_import", R.step_import, """, i AS (SELECT ref_id, rest, parts, tf, orig, orig = '*' OR orig = regexp_extract(tf, '([^/]*)\\.[^.]*$', 1) AS module FROM refs JOIN imported m ON m.file = refs.file AND m.local = parts[1]),
c AS (SELECT ref_id, 0 AS pos, tf || '::' || CASE WHEN rest <> '' THEN rest ELSE parts[1] END AS target FROM i WHERE module UNION ALL SELECT ref_id, 1, CASE WHEN rest <> '' THEN (SELECT arg_min(id, seq) FROM syms WHERE source_file = tf AND id LIKE '%.' || parts[-1]) ELSE tf END FROM i WHERE module)
""" + FIRST + " UNION ALL SELECT ref_id, CASE WHEN b.id IS NULL THEN 'stop' ELSE 'hit' END, coalesce(n.id, b.id) FROM i LEFT JOIN nodes b ON b.id = tf || '::' || orig LEFT JOIN nodes n ON b.id IS NOT NULL AND rest <> '' AND n.id = b.id || '.' || rest WHERE NOT module")
GLOBAL = """, free AS (SELECT *, parts[-1] AS lab FROM refs r WHERE NOT EXISTS (SELECT 1 FROM imported m WHERE m.file = r.file AND m.local = parts[1]) AND NOT EXISTS (SELECT 1 FROM builtins b WHERE b.lang = r.lang AND b.symbol = parts[1])
 AND NOT EXISTS (SELECT 1 FROM stdlib b WHERE b.lang = r.lang AND b.symbol = parts[1]) AND (len(parts) = 1 OR parts[-1] NOT IN (SELECT symbol FROM common)))
SELECT ref_id, 'hit' AS status, CASE WHEN n = 1 THEN one ELSE mine END AS target FROM (SELECT ref_id, count(*) AS n, min(id) AS one, count(*) FILTER (WHERE s.dir = free.dir) AS m, min(id) FILTER (WHERE s.dir = free.dir) AS mine FROM free JOIN syms s ON label = lab GROUP BY ref_id) WHERE n = 1 OR m = 1"""
add_step("step_global", R.step_global, GLOBAL)
add_step("step_local_binding", R.step_local_binding, """, cls AS (SELECT ref_id, parts, arg_min(n.id, n.seq) AS c1 FROM refs JOIN bindings ON node_id = caller AND var = parts[1] LEFT JOIN nodes n ON n.type IN ('class', 'struct', 'interface', 'enum') AND n.label = split_part(bound, '.', -1) WHERE len(parts) > 1 GROUP BY ref_id, parts),
m1 AS (SELECT cls.*, n.id AS i1, regexp_extract(n.signature, '->\\s*(?:[A-Za-z]+<)?(?:[a-z]+(?:\\.|::))*([A-Za-z]+)', 1) AS r1 FROM cls LEFT JOIN nodes n ON n.id = c1 || '.' || split_part(parts[2], '(', 1)),
c2 AS (SELECT m1.*, k.id AS cid FROM m1 LEFT JOIN nodes k ON k.type IN ('class', 'struct', 'interface', 'enum') AND k.label = r1), m2 AS (SELECT c2.*, n.id AS i2 FROM c2 LEFT JOIN nodes n ON n.id = cid || '.' || split_part(parts[3], '(', 1))
SELECT ref_id, CASE WHEN t IS NULL THEN 'stop' ELSE 'hit' END AS status, t AS target FROM (SELECT ref_id, CASE WHEN len(parts) = 2 THEN i1 ELSE i2 END AS t FROM m2)""")


def _chain_sql() -> str:
    ctes, parts = [], []
    for k, f in enumerate(R.CHAIN, 1):
        name = f.__name__
        body = ORACLES[name][len(PREFIX) :].strip()
        body = ("WITH " + body[1:]) if body.startswith(",") else body
        ctes.append(f"s{k} AS ({body})")
        parts.append(f"SELECT ref_id, {k} AS step, status, target FROM s{k}")
    return ", " + ", ".join(ctes) + ", u AS (" + " UNION ALL ".join(parts) + "), chain AS (SELECT r.ref_id, coalesce(u.step, 0) AS step, coalesce(u.status, 'miss') AS status, u.target FROM refs0 r LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY ref_id ORDER BY step) AS rn FROM u) u ON u.ref_id = r.ref_id AND rn = 1)\n"


CHAIN_SQL = _chain_sql()


@query(CHAIN_SQL + "SELECT * FROM chain")
def resolve_chain(spark, sf):
    return R.resolve(refs(spark), index(spark))


@query("SELECT label, count(*) AS n, arg_min(id, seq) AS first_id, count(*) FILTER (WHERE type IN ('class', 'struct', 'interface', 'enum')) AS class_like, count(DISTINCT source_file) AS files FROM syms GROUP BY label")
def symbol_index(spark, sf):
    return R.symbol_index(index(spark).nodes)


@query("SELECT source_file AS file, label, arg_max(id, seq) AS id FROM syms GROUP BY ALL")
def declared_symbols(spark, sf):
    return R.declared_symbols(index(spark).nodes)


@query("SELECT regexp_extract(id, '^(.*)\\.[^.]*$', 1) AS parent, label, id FROM syms WHERE id LIKE '%::%.%'")
def methods_by_class(spark, sf):
    return R.methods_by_class(index(spark).nodes)


@query("SELECT label, string_agg(id, ',' ORDER BY seq) AS ids FROM syms WHERE type IN ('class', 'struct', 'interface', 'enum') GROUP BY label")
def class_like(spark, sf):
    return R.global_symbols(index(spark).nodes, True)


RET = """SELECT id, t AS type FROM (SELECT id, CASE WHEN source_file LIKE '%.go' THEN nullif(nullif(regexp_extract(signature, '\\)\\s*\\*?([A-Za-z.]*)\\s*\\{?$', 1), ''), 'error') ELSE nullif(regexp_extract(signature, '->\\s*(?:[A-Za-z]+<)?(?:[a-z]+(?:\\.|::))*([A-Za-z]+)', 1), '') END AS t FROM syms WHERE type IN ('function', 'method')) WHERE t IS NOT NULL"""


@query(RET)
def return_types(spark, sf):
    return R.return_types(index(spark).nodes)


@query("SELECT m.parent AS class_id, m.label AS method, m.id AS method_id FROM (SELECT regexp_extract(id, '^(.*)\\.[^.]*$', 1) AS parent, label, id FROM syms WHERE type = 'method') m")
def find_method(spark, sf):
    ix = index(spark)
    asked = R.methods_by_class(ix.nodes.where("type = 'method'")).select(F.xxhash64("id").alias("ref_id"), F.col("parent").alias("class_id"), F.col("label").alias("method"))
    return asked.join(R.find_method(asked, ix), "ref_id").select("class_id", "method", "method_id")


@query("""SELECT node_id, var, coalesce(i.id, k.id) AS class_id FROM bindings b JOIN nodes n ON n.id = node_id
LEFT JOIN imported m ON m.file = n.source_file AND m.local = regexp_replace(bound, '\\(\\)$', '') LEFT JOIN nodes i ON i.id = m.tf || '::' || m.orig
LEFT JOIN nodes k ON k.type IN ('class', 'struct') AND k.label = split_part(bound, '.', -1) WHERE coalesce(i.id, k.id) IS NOT NULL""")
def lookup_class(spark, sf):
    ix = index(spark)
    b = ix.bindings.withColumn("ref_id", F.xxhash64("node_id", "var")).join(ix.nodes.select(F.col("id").alias("node_id"), "source_file"), "node_id")
    rows = b.select("ref_id", F.col("source_file").alias("file"), F.regexp_extract("source_file", "^(.*)/[^/]*$", 1).alias("dir"), R.language_of(F.col("source_file")).alias("lang"), F.col("bound").alias("name"))
    return b.join(R.lookup_class(rows, ix), "ref_id").select("node_id", "var", "class_id")


@query("SELECT t.id AS method_id, k.id AS class_id FROM (" + RET + ") t JOIN nodes k ON k.label = t.type AND k.type IN ('class', 'struct')")
def transfer_type(spark, sf):
    ix = index(spark)
    m = ix.nodes.where("type IN ('function', 'method')").select(F.xxhash64("id").alias("ref_id"), F.col("source_file").alias("file"), F.regexp_extract("source_file", "^(.*)/[^/]*$", 1).alias("dir"), R.language_of(F.col("source_file")).alias("lang"), F.col("id").alias("method_id"))
    return m.join(R.transfer_type(m, ix), "ref_id").select("method_id", "class_id")


PROBES = """, b AS (SELECT node_id, var, bound, trim(split_part(regexp_replace(bound, '\\(\\)$', ''), '[', 1)) AS probe, n.source_file AS file FROM bindings JOIN nodes n ON n.id = node_id),
ret AS (""" + RET + """), named AS (
  SELECT node_id, var, 0 AS rank, id AS target FROM b JOIN nodes ON id = probe
  UNION ALL SELECT node_id, var, 1, min(id) FROM b JOIN syms ON label = probe AND syms.type IN ('class', 'struct', 'interface', 'enum') GROUP BY node_id, var HAVING count(*) = 1
  UNION ALL SELECT node_id, var, 2, n.id FROM b JOIN imported m ON m.file = b.file AND m.local = split_part(probe, '.', 1)
    JOIN nodes n ON n.id = m.tf || '::' || CASE WHEN m.orig = regexp_extract(m.tf, '([^/]*)\\.[^.]*$', 1) THEN substr(probe, strpos(probe, '.') + 1) ELSE m.orig END
), base AS (
  SELECT node_id, var, CASE WHEN n.type IN ('function', 'method') THEN coalesce(d.id, r.type) ELSE n.id END AS id
  FROM (SELECT *, row_number() OVER (PARTITION BY node_id, var ORDER BY rank) AS rn FROM named) x JOIN nodes n ON n.id = x.target
  LEFT JOIN ret r ON r.id = n.id LEFT JOIN syms d ON d.source_file = n.source_file AND d.label = r.type WHERE rn = 1
), closed(node_id, var, id) AS (SELECT node_id, var, id FROM base UNION SELECT b.node_id, b.var, c.id FROM b JOIN closed c ON c.node_id = b.node_id AND c.var = b.bound JOIN nodes n ON n.id = c.id)
SELECT b.node_id, b.var, coalesce(c.id, b.bound) AS bound FROM b LEFT JOIN closed c USING (node_id, var)"""


@query(PROBES)
def propagate_types(spark, sf):
    """Chains such as x -> y -> a factory end at the class that it makes; names that only point at each other stay as they are."""
    return R.propagate_types(index(spark))


def attempts(spark):
    ix = index(spark)
    rows = spark.createDataFrame(EDGES, "relation string, target string, source string, seq int")
    rows = rows.join(ix.nodes.select(F.col("id").alias("source"), "source_file"), "source").withColumn("lang", R.language_of(F.col("source_file")))
    # ``resolved`` as the chain decides, over calls; other relations by id or label.
    hit = R.resolve(refs(spark), ix).where("status = 'hit'").select(F.col("ref_id").alias("seq"), F.lit(True).alias("_h"))
    label = ix.nodes.select(F.col("label").alias("target"), F.lit(True).alias("_l")).distinct()
    rows = rows.join(hit, "seq", "left").join(label, "target", "left")
    done = F.coalesce(F.when(F.col("relation") == "calls", F.col("_h")).when(F.col("relation") == "inherits", F.col("_l")), F.lit(False))
    return G.cut(R.classify(rows.withColumn("resolved", done).select("seq", "relation", "target", "lang", "resolved"), ix.nodes))


ATTEMPTS = CHAIN_SQL.rstrip() + f""", raw(relation, target, source, seq) AS (VALUES {values(EDGES)}), att0 AS (
  SELECT r.seq, r.relation, r.target, e.lang, CASE relation WHEN 'calls' THEN coalesce(c.status = 'hit', false) WHEN 'inherits' THEN r.target IN (SELECT label FROM nodes) ELSE false END AS resolved,
         list_filter(string_split(replace(r.target, '::', '.'), '.'), lambda x: x <> '') AS p, split_part(split_part(r.target, '.', 1), '/', 1) AS root
  FROM raw r JOIN nodes n ON n.id = r.source JOIN ext e ON e.e = split_part(n.source_file, '.', -1) LEFT JOIN chain c ON c.ref_id = r.seq
), att AS (SELECT seq, relation, target, lang, resolved, CASE WHEN resolved OR relation = 'contains' THEN 'internal'
  WHEN relation = 'imports' THEN CASE WHEN EXISTS (SELECT 1 FROM (SELECT * FROM stdlib UNION ALL SELECT * FROM builtins) s WHERE s.lang = att0.lang AND s.symbol = root) THEN 'external' WHEN target LIKE '.%' OR contains(target, '/') THEN 'internal' ELSE 'external' END
  WHEN EXISTS (SELECT 1 FROM builtins s WHERE s.lang = att0.lang AND s.symbol = p[1]) THEN 'builtin' WHEN EXISTS (SELECT 1 FROM stdlib s WHERE s.lang = att0.lang AND s.symbol = p[1]) THEN 'external'
  WHEN len(p) > 1 THEN CASE WHEN p[-1] IN (SELECT symbol FROM common) AND p[1] NOT IN (SELECT label FROM syms) THEN 'builtin' ELSE 'attribute' END
  WHEN p[1] IN (SELECT label FROM syms) THEN 'internal' ELSE 'external' END AS category FROM att0)
"""


@query(ATTEMPTS + "SELECT * FROM att")
def classify_attempt(spark, sf):
    return attempts(spark).select("seq", "relation", "target", "lang", "resolved", "category")


STATS = "SELECT {0} AS dim, {1} AS value, count(*) AS attempted, count(*) FILTER (WHERE resolved) AS resolved, count(*) FILTER (WHERE NOT resolved) AS unresolved FROM att"


@query(ATTEMPTS + STATS.format("'all'", "'all'") + " UNION ALL " + STATS.format("'relation'", "relation") + " GROUP BY relation UNION ALL " + STATS.format("'category'", "category") + " GROUP BY category")
def resolution_stats(spark, sf):
    return R.resolution_stats(attempts(spark))


RATES = "SELECT round(count(*) FILTER (WHERE resolved) / count(*), 6) AS resolve_rate, round(count(*) FILTER (WHERE resolved AND category = 'internal') / count(*) FILTER (WHERE category = 'internal'), 6) AS internal_rate FROM att"


@query(ATTEMPTS + RATES)
def resolve_rates(spark, sf):
    return R.resolve_rates(attempts(spark))


GATES = """, r AS (SELECT count(*) FILTER (WHERE resolved) / count(*) AS a, count(*) FILTER (WHERE resolved AND category = 'internal') / count(*) FILTER (WHERE category = 'internal') AS i,
 count(*) FILTER (WHERE NOT resolved) AS u, count(*) FILTER (WHERE NOT resolved AND category = 'internal') AS w FROM att)
SELECT 'internal_rate' AS gate, round(i, 6) AS value, 0.5::DOUBLE AS required, round(i, 6) >= 0.5 AS passed FROM r UNION ALL SELECT 'resolve_rate', round(a, 6), 0.9, round(a, 6) >= 0.9 FROM r
UNION ALL SELECT 'unresolved', u::DOUBLE, 100, u <= 100 FROM r UNION ALL SELECT 'internal_unresolved', w::DOUBLE, 1, w <= 1 FROM r"""


@query(ATTEMPTS + GATES)
def quality_gates(spark, sf):
    return R.quality_gates(R.resolution_summary(attempts(spark)), {"resolve_rate": 0.9, "internal_rate": 0.5, "unresolved": 100, "internal_unresolved": 1})


@query(ATTEMPTS + "SELECT seq, relation, target, category FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY seq) AS rn FROM att WHERE NOT resolved) WHERE rn <= 12 ORDER BY seq LIMIT 40")
def unresolved_samples(spark, sf):
    return R.unresolved_samples(attempts(spark))


@query(CHAIN_SQL + "SELECT caller AS src, target AS dst, 'calls' AS relation FROM chain JOIN refs0 USING (ref_id) WHERE status = 'hit' GROUP BY ALL")
def build_edges(spark, sf):
    hits = R.resolve(refs(spark), index(spark)).where("status = 'hit'").join(refs(spark), "ref_id")
    return G.dedup_edges(hits.select(F.col("caller").alias("src"), F.col("target").alias("dst"), F.lit("calls").alias("relation"), F.col("ref_id").alias("seq")))


def import_rows(spark):
    rows = [(i, f, t, dict(x.split("=") for x in m.split(",") if x)) for i, (f, t, m) in enumerate(IMPORTS)]
    return spark.createDataFrame(rows, "ref_id int, source_file string, target string, import_map map<string,string>")


def _files(spark):
    return index(spark).nodes.where("type = 'file'").select(F.col("id").alias("file"), "seq")


IMPORT_SQL = """, fl AS (SELECT id AS file, seq FROM nodes WHERE type = 'file'), im AS (SELECT i.*, e.lang, target LIKE '.%' OR contains(target, '/') AS path, regexp_extract(source_file, '^(.*)/[^/]*$', 1) AS dir FROM imports i JOIN ext e ON e.e = split_part(source_file, '.', -1)),
suf(lang, pos, s) AS (VALUES ('python', 0, ''), ('python', 1, '.py'), ('python', 2, '/__init__.py'), ('go', 0, ''), ('go', 1, '.go'), ('rust', 0, ''), ('rust', 1, '.rs'), ('rust', 2, '/mod.rs'), ('typescript', 0, ''), ('typescript', 1, '.ts'), ('typescript', 2, '.tsx')),
cand AS (SELECT ref_id, path, pos, CASE WHEN path THEN regexp_replace(regexp_replace(regexp_replace(regexp_replace(dir || '/' || target, '/(\\./)+', '/', 'g'), '[a-z]+/\\.\\./', ''), '[a-z]+/\\.\\./', ''), '^\\./', '') ELSE replace(target, '.', '/') END || s AS c FROM im JOIN suf USING (lang) UNION ALL SELECT ref_id, NULL, 99, split_part(target, '/', -1) FROM im WHERE path),
res AS (SELECT ref_id, file AS target_file FROM (SELECT ref_id, file, row_number() OVER (PARTITION BY ref_id ORDER BY pos, file <> c, seq) AS rn FROM cand JOIN fl ON file = c OR ((path IS NULL OR NOT path) AND file LIKE '%/' || c)) WHERE rn = 1)
"""


@query(IMPORT_SQL + "SELECT * FROM res")
def resolve_imports(spark, sf):
    return R.resolve_imports(import_rows(spark), _files(spark))


@query(IMPORT_SQL.rstrip() + """, kv AS (SELECT ref_id, source_file, target_file, split_part(x, '=', 1) AS l, split_part(x, '=', 2) AS o FROM (SELECT im.ref_id, source_file, target_file, unnest(string_split(map, ',')) AS x FROM im JOIN res USING (ref_id) WHERE map <> '')
 UNION ALL SELECT im.ref_id, source_file, target_file, regexp_extract(target_file, '([^/]*)\\.[^.]*$', 1), regexp_extract(target_file, '([^/]*)\\.[^.]*$', 1) FROM im JOIN res USING (ref_id) WHERE map = '')
SELECT source_file AS file, l AS local, arg_max(target_file, ref_id) AS target_file, arg_max(o, ref_id) AS original FROM kv WHERE o <> '*' GROUP BY ALL""")
def import_scope(spark, sf):
    rows = import_rows(spark)
    return R.import_scope(rows, R.resolve_imports(rows, _files(spark)))[0]


@query(IMPORT_SQL + "SELECT source_file AS file, min(ref_id) AS ord, target_file FROM im JOIN res USING (ref_id) WHERE contains(map, '=*') GROUP BY ALL")
def wildcard_scope(spark, sf):
    rows = import_rows(spark)
    return R.import_scope(rows, R.resolve_imports(rows, _files(spark)))[1]


@query("SELECT id, label FROM syms WHERE type IN ('function', 'method') AND regexp_matches(lower(label), 'main|app|run|cli|serve') ORDER BY seq LIMIT 5")
def entry_points(spark, sf):
    return C.entry_points(index(spark).nodes)


HUBS = [(1, "a::App", "App"), (2, "b::util()", "util()"), (3, "c::Run.x", "Run.x"), (4, "d::App", "App"), (5, "e::core", "core"), (6, "f::", ""), (7, "g::App", "App"), (8, "h::Solo", "Solo")]
DIRS = [(1, "src/app"), (2, ""), (3, "very/deep/pkg/here"), (4, "src/app"), (5, "core"), (6, "lone/dir"), (7, ""), (8, "")]
NAMES = """, h(comp, id, label) AS (VALUES {}), d(comp, dir) AS (VALUES {}), r AS (
  SELECT comp, dir, split_part(replace(label, '()', ''), '.', 1) AS c, CASE WHEN len(string_split(dir, '/')) > 2 THEN split_part(dir, '/', -2) || '/' || split_part(dir, '/', -1) ELSE dir END AS k FROM h JOIN d USING (comp)
), m(mode) AS (VALUES ('hybrid'), ('package'), ('symbol')), n AS (
  SELECT *, CASE mode WHEN 'symbol' THEN c WHEN 'package' THEN CASE WHEN dir <> '' THEN k ELSE c END
    ELSE CASE WHEN dir = '' THEN c WHEN c = '' OR k = c OR starts_with(c, k) THEN k ELSE k || ' (' || c || ')' END END AS cand FROM r, m
), t AS (SELECT *, count(*) OVER (PARTITION BY mode, cand) AS twins FROM n)
SELECT mode, comp, CASE WHEN twins = 1 THEN cand WHEN dir = '' THEN c || ' (Component ' || comp::VARCHAR || ')' WHEN mode = 'symbol' THEN c || ' (' || k || ')' ELSE cand || ' (' || c || ')' END AS name FROM t"""


@query(NAMES.format(values(HUBS), values(DIRS)))
def component_name_modes(spark, sf):
    """All three modes, with equal names, names without a folder and folders that the name repeats."""
    hubs, dirs = spark.createDataFrame(HUBS, "comp int, id string, label string"), spark.createDataFrame(DIRS, "comp int, dir string")
    out = None
    for mode in ("hybrid", "package", "symbol"):
        one = C.names(hubs, dirs, mode).withColumn("mode", F.lit(mode))
        out = one if out is None else out.unionByName(one)
    return out


# Scalars over literal inputs.
CALLEES = ["a::b.c", " x . y ", "..", "f", "o.inner().value", "Vec<T>[0]", "Model()", "List[int]", "g(1).h"]


def add_scalar(name: str, rows, cols: str, out: str, column, sql: str):
    def run(spark, sf):
        return spark.createDataFrame(rows, cols).select("*", column().alias(out))

    run.__name__ = name
    names = ", ".join(c.split()[0] for c in cols.split(","))
    query(f"SELECT *, {sql} AS {out} FROM t", f"WITH t({names}) AS (VALUES {values(rows)}) ")(run)


one = [(x,) for x in CALLEES]
add_scalar("callee_parts", one, "s string", "parts", lambda: F.array_join(S.callee_parts(F.col("s")), ","), "array_to_string(list_filter(list_transform(string_split(replace(s, '::', '.'), '.'), lambda x: trim(x)), lambda x: x <> ''), ',')")
add_scalar("normalize_type", one, "s string", "t", lambda: S.normalize_type(F.col("s")), "trim(split_part(regexp_replace(trim(s), '\\(\\)$', ''), '[', 1))")
add_scalar("strip_call", one, "s string", "t", lambda: S.strip_call(F.col("s")), "trim(split_part(s, '(', 1))")
SIGS = [(x,) for x in ("def f() -> Model", "fn g() -> Option<Gear>", "func h() -> std::io::Error", "def k()", "fn v() -> a.b.C")]
add_scalar("ret_arrow", SIGS, "s string", "t", lambda: S.arrow_return_type(F.col("s")), "nullif(regexp_extract(CASE WHEN s LIKE '%<%' THEN regexp_extract(s, '<([A-Za-z0-9_:.]+)>', 1) ELSE regexp_extract(s, '->\\s*([A-Za-z0-9_:.<>]+)', 1) END, '([A-Za-z0-9_]*)$', 1), '')")
GOS = [(x,) for x in ("func f() *Server {", "func g() (T, error) {", "func h() error", "func k(a int) []Item {", "func m()", "type X struct", "func n() pkg.Type {")]
add_scalar("ret_go", GOS, "s string", "t", lambda: S.go_return_type(F.col("s")), "nullif(nullif(regexp_extract(s, '\\)\\s*\\**(?:\\[\\])?([A-Za-z.]*)\\s*\\{?$', 1), ''), 'error')")
KTS = [(x,) for x in ("fun f(): User", "fun g(a: Int): List<Item>", "fun h()", "fun k(x: A) : B {")]
add_scalar("ret_kotlin", KTS, "s string", "t", lambda: S.kotlin_return_type(F.col("s")), "nullif(CASE WHEN s LIKE '%<%' THEN regexp_extract(s, '<([A-Za-z0-9_]+)>', 1) ELSE regexp_extract(s, '\\)\\s*:\\s*([A-Za-z0-9_]+)', 1) END, '')")
CS = [(x,) for x in ("static int *f(int a)", "const ns::Type& g()", "main()", "inline virtual Foo bar()", "void h(int)")]
add_scalar("ret_c", CS, "s string", "t", lambda: S.c_return_type(F.col("s")), "CASE WHEN regexp_replace(s, '^((inline|static|virtual|friend|const|constexpr) )+', '') SIMILAR TO '[^ ]*[()].*' AND NOT contains(split_part(s, '(', 1), ' ') THEN NULL ELSE regexp_extract(replace(split_part(regexp_replace(s, '^((inline|static|virtual|friend|const|constexpr) )+', ''), ' ', 1), '&', ''), '([A-Za-z]*)$', 1) END")
DARTS = [(x,) for x in ("Future<User> load()", "String greet(a)", "main()", "prefix.Type make()", "Stream<int> ticks()")]
add_scalar("ret_dart", DARTS, "s string", "t", lambda: S.dart_return_type(F.col("s")), "CASE WHEN NOT contains(s, ' ') THEN NULL WHEN s LIKE '%<%' THEN regexp_extract(s, '<([A-Za-z]+)>', 1) ELSE regexp_extract(s, '([A-Za-z]+) ', 1) END")
TARGETS = [("python", "a.b"), ("rust", "x::y"), ("typescript", "lib.z"), ("go", "net"), ("dart", "package:p/q"), ("ocaml", "list")]
add_scalar("import_candidates", TARGETS, "lang string, target string", "c", lambda: F.array_join(S.import_candidates(F.col("target"), F.col("lang")), ","), "CASE lang WHEN 'python' THEN 'a/b,a/b.py,a/b/__init__.py' WHEN 'rust' THEN 'x/y,x/y.rs,x/y/mod.rs' WHEN 'typescript' THEN 'lib/z,lib/z.ts,lib/z.tsx' WHEN 'go' THEN 'net,net.go' WHEN 'dart' THEN 'lib/q,lib/q.dart' ELSE 'list.ml,list.mli,List.ml,List.mli' END")
PT = [("python", ".x"), ("python", "a.b"), ("go", "a/b"), ("c", "io.h"), ("python", "io.h"), ("cpp", "v")]
add_scalar("path_target", PT, "lang string, target string", "p", lambda: S.is_path_target(F.col("target"), F.col("lang")), "target LIKE '.%' OR contains(target, '/') OR (lang IN ('c', 'cpp') AND target LIKE '%.h')")
BG = [("python", "len"), ("go", "len"), ("rust", "len"), ("python", "fmt"), ("go", "fmt"), (None, "x")]
add_scalar("builtin_guard", BG, "lang string, symbol string", "b", lambda: F.concat(L.is_builtin(F.col("lang"), F.col("symbol")).cast("string"), L.is_stdlib(F.col("lang"), F.col("symbol")).cast("string")), "CASE WHEN symbol = 'len' AND lang IN ('python', 'go') THEN 'true' ELSE 'false' END || CASE WHEN lang = 'go' AND symbol = 'fmt' THEN 'true' ELSE 'false' END")
CM = [("append",), ("to_string",), ("mine",), ("isEmpty",)]
add_scalar("common_methods", CM, "symbol string", "c", lambda: F.col("symbol").isin(*L.COMMON_METHODS), f"symbol IN ({', '.join(repr(m) for m in sorted(L.COMMON_METHODS))})")


@query("SELECT l, l IN ('python', 'go', 'rust') AS valid FROM t", "WITH t(l) AS (VALUES ('python'), ('cobol'), ('go')) ")
def language_sets(spark, sf):
    """Configured languages, split into known and unknown."""
    return spark.createDataFrame([("python",), ("cobol",), ("go",)], "l string").select("l", F.col("l").isin(*L.BUILTINS).alias("valid"))
