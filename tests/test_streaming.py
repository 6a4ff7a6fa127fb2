from weftgraph.sources.scan import scan_files
from weftgraph.streaming.ingest import latest, watch


def test_batches_agree_with_the_scan_and_never_double(spark, tmp_path):
    ws, table, mark = tmp_path / "ws", str(tmp_path / "table"), str(tmp_path / "mark")
    (ws / "a").mkdir(parents=True)
    (ws / "vendor").mkdir()
    (ws / "a/x.py").write_text("def f():\n    pass\n")
    (ws / "vendor/y.py").write_text("def g():\n    pass\n")
    watch(spark, str(ws), table, mark)
    assert [r.path for r in latest(spark, table).collect()] == [r.path for r in scan_files(spark, str(ws)).collect()] == ["a/x.py"]
    (ws / "a/z.py").write_text("def h():\n    pass\n")
    watch(spark, str(ws), table, mark)
    watch(spark, str(ws), table, mark)
    got = latest(spark, table).selectExpr("path", "nodes[1].id AS id", "batch").collect()
    assert sorted((r.path, r.id) for r in got) == [("a/x.py", "a/x.py::f"), ("a/z.py", "a/z.py::h")]
    spark.read.parquet(table).where("batch = 0").count() == 1
