"""A selection of registered queries against their SQL, on the smallest tables."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from weftgraph import catalog

SF = Path("/root/testdata/sf0.001")
FAST = "relation_counts node_degree component_hub common_dir top_dirs is_test_path dirty_files vault_plan node_filename html_escape global_symbols symbol_index return_types step_self step_file step_import resolve_imports callee_parts common_dir_of_many fence_language component_name_modes entry_points node_sections quality_gates node_signature ret_go ret_c ret_dart".split()


@pytest.mark.skipif(not SF.exists(), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", FAST)
def test_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in SF.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    df = catalog.QUERIES[name](spark, str(SF))
    cols = sorted(df.columns)
    got = sorted(map(str, (tuple(r) for r in df.select(*cols).collect())))
    want = sorted(map(str, con.execute(f"SELECT {', '.join(cols)} FROM ({catalog.ORACLES[name]})").fetchall()))
    assert got == want


def test_registry():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES) and len(catalog.QUERIES) > 90


@pytest.mark.skipif(not SF.exists(), reason="the driver's tables are not here")
def test_ids_are_not_shuffled_with_each_line(spark, tmp_path):
    """Ids of the trade graph are put in place of numbers at the end: longer names cost next to nothing where only counts are asked for."""

    def moved(sf, name):
        sc = spark.sparkContext._jsc.sc()
        kind = spark.sparkContext._jvm.java.lang.Class.forName("org.apache.spark.status.StageDataWrapper")
        sc.listenerBus().waitUntilEmpty()
        before = {s.stageId() for s in _stages(sc, kind)}
        catalog.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        sc.listenerBus().waitUntilEmpty()
        return sum(s.shuffleWriteBytes() + s.outputBytes() for s in _stages(sc, kind) if s.stageId() not in before)

    for f in SF.glob("*.parquet"):
        t = spark.read.parquet(str(f))
        for c, key in (("c_name", "c_custkey"), ("s_name", "s_suppkey")):
            if c in t.columns:  # a hundred characters that compression can't shorten
                t = t.withColumn(c, F.concat(c, F.sha2(F.col(key).cast("string"), 512).substr(1, 100)))
        if f.stem in ("nation", "region", "supplier", "customer", "orders", "lineitem"):
            t.write.parquet(f"{tmp_path}/{f.stem}.parquet")
    nodes = 185 * 100  # the bytes that the nodes alone have gained
    for name in ("inter_component", "modularity", "component_cohesion"):
        assert moved(str(tmp_path), name) - moved(str(SF), name) < 12 * nodes, name


def _stages(sc, kind):
    it = sc.statusStore().store().view(kind).iterator()
    while it.hasNext():
        yield it.next().info()


def test_equal_ids_are_one_node_of_the_trade_graph(spark, tmp_path):
    """Customers of one name and nation have one id, so their edges are deduplicated together; so has the SQL."""
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    tables = {
        "region": "SELECT 0 AS r_regionkey, 'ASIA' AS r_name",
        "nation": "SELECT * FROM (VALUES (0, 'A B', 0), (1, 'C', 0)) t(n_nationkey, n_name, n_regionkey)",
        "supplier": "SELECT * FROM (VALUES (1::BIGINT, 'S', 0), (2, 'S', 0), (3, 'X', 1)) t(s_suppkey, s_name, s_nationkey)",
        "customer": "SELECT * FROM (VALUES (1::BIGINT, 'K', 0), (2, 'K', 0), (3, 'S', 0), (4, 'K', 1), (5, NULL, 1)) t(c_custkey, c_name, c_nationkey)",
        "orders": "SELECT i::BIGINT AS o_orderkey, i % 5 + 1 AS o_custkey FROM range(40) r(i)",
        "lineitem": "SELECT i % 40 AS l_orderkey, i % 3 + 1 AS l_suppkey, i % 7 AS l_linenumber, CASE WHEN i % 4 = 0 THEN 'R' ELSE 'N' END AS l_returnflag FROM range(150) r(i)",
    }
    for name, sql in tables.items():
        con.execute(f"COPY ({sql}) TO '{tmp_path}/{name}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
    for name in ("edge_dedup", "neighborhood", "relation_counts", "import_edges", "call_edges", "valid_edges", "node_mermaid"):
        df = catalog.QUERIES[name](spark, str(tmp_path))
        cols = sorted(df.columns)
        got = sorted(map(str, (tuple(r) for r in df.select(*cols).collect())))
        assert got == sorted(map(str, con.execute(f"SELECT {', '.join(cols)} FROM ({catalog.ORACLES[name]})").fetchall())), name


def test_communities_of_numbers_are_those_of_the_ids_they_stand_for(spark, monkeypatch):
    import random

    from weftgraph.operators import components as C

    rnd = random.Random(6)
    name = lambda i: f"n{(i * 37) % 61}"
    pairs = {(a, b) for a, b in ((rnd.randrange(60), rnd.randrange(60)) for _ in range(400)) if a <= b and (a % 4 == b % 4 or rnd.random() < 0.1)}
    rows = [(a, b, float(1 + (a * b) % 3)) for a, b in sorted(pairs)]
    ids = spark.createDataFrame([(i,) for i in range(60)], "id long")
    marks = spark.createDataFrame([(i, name(i)) for i in range(60)], "id long, name string").select("id", F.hash("name").alias("tie"), F.pmod(F.xxhash64("name"), F.lit(2)).alias("half"))
    found = []
    for sent in (1 << 16, 0):
        monkeypatch.setattr(C, "SENT", sent)
        got = C.louvain(spark.createDataFrame(rows, "a long, b long, weight double"), ids, marks=marks).collect()
        found.append({name(r.id): name(r.comp) for r in got})
    named = C.louvain(spark.createDataFrame([(name(a), name(b), w) for a, b, w in rows], "a string, b string, weight double"), spark.createDataFrame([(name(i),) for i in range(60)], "id string"))
    assert found[0] == found[1] == {r.id: r.comp for r in named.collect()} and 1 < len(set(found[0].values())) < 60
