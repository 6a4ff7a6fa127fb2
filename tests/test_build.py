import json
import os
import shutil

import pytest

from weftgraph.__main__ import main, parser
from weftgraph.plans import report
from weftgraph.operators import resolve as R
from weftgraph.plans.build import Config, Hooks, build, clear_vault, enforce, snapshot_read, snapshot_write, visualize, write_vault
from weftgraph.plans.report import EMPTY
from weftgraph.plans.store import load_table
from weftgraph.sources.extract import Extractor, Found
from weftgraph.sources.scan import scan_files

SOURCES = {
    "app/main.py": "from app.models import Model, make\n\ndef run(m: Model):\n    m.save()\n    x = make()\n    x.load().save()\n    helper()\n    len(x)\n\ndef helper():\n    run(None)\n",
    "app/models.py": "class Model:\n    def save(self):\n        self.load()\n    def load(self) -> Model:\n        return self\n\ndef make() -> Model:\n    return Model()\n",
    "tests/test_main.py": "from app.main import run\n\ndef test_run():\n    run(None)\n",
    "Node_Modules/x.py": "def hidden():\n    pass\n",
    "app/broken.py": "def (\n\ndef fine():\n    pass\n",
    "app/notes.txt": "no source",
    "srv/a.go": "package srv\nfunc Serve() *Server {\n  return nil\n}\ntype Server struct { n int }\nfunc (s *Server) Start() {\n}\n",
    "srv/b.go": "package srv\nfunc boot() {\n  Serve()\n}\n",
}


@pytest.fixture(scope="module")
def workspace(tmp_path_factory):
    root = tmp_path_factory.mktemp("ws")
    for path, text in SOURCES.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    return root


def test_scan(spark, workspace):
    got = {r.path: r.lang for r in scan_files(spark, str(workspace)).select("path", "lang").collect()}
    assert got == {p: "go" if p.endswith("go") else "python" for p in SOURCES if p.endswith((".py", ".go")) and not p.startswith("Node")}
    only = scan_files(spark, str(workspace), include=("srv",), exclude=("srv/b.go",)).select("path").collect()
    assert [r.path for r in only] == ["srv/a.go"]


@pytest.fixture(scope="module")
def built(spark, workspace, tmp_path_factory):
    seen, folder = [], tmp_path_factory.mktemp("project")
    return build(spark, Config(str(workspace), output=str(folder / "vault")), seen.append), seen, folder


def test_build(built):
    b, seen, tmp_path = built
    assert seen == ["discovering", "parsing", "resolving", "clustering", "analyzing", "rendering", "exporting", "completed"]
    edges = {(r.src, r.dst) for r in b.edges.collect()}
    run, model = "app/main.py::run", "app/models.py::Model"
    assert {(run, f"{model}.save"), (run, "app/models.py::make"), (run, "app/main.py::helper"), (f"{model}.save", f"{model}.load"), ("app/main.py", "app/models.py"), ("srv/b.go::boot", "srv/a.go::Serve"), ("tests/test_main.py::test_run", run)} <= edges
    assert not any("len" in d for _, d in edges)
    assert [r.path for r in b.errors.collect()] == ["app/broken.py"]
    assert ("app/broken.py", "app/broken.py::fine") in edges  # the line that breaks the file is left out, the rest is read
    nodes = b.nodes.count()
    assert b.member.count() == nodes and b.member.select("id").distinct().count() == nodes
    assert {r.path for r in b.analysis["call_cycles"].collect()} == {"app/main.py::helper > app/main.py::run"}
    assert (tmp_path / "vault/README.md").exists() and (tmp_path / "vault/graph.json").exists()
    files = list((tmp_path / "vault/nodes").glob("*.md"))
    assert len(files) == nodes
    (tmp_path / "vault/nodes/old.md").write_text("x")
    files[0].write_text("changed by hand")
    done = write_vault(b, str(tmp_path / "vault"), cache=False)
    assert done["write"] == 1 and done["delete"] == 1 and done["keep"] >= nodes - 1
    g = json.loads((tmp_path / "vault/graph.json").read_text())
    assert g["statistics"]["nodes"] == nodes == len(g["nodes"]) and len(g["edges"]) == len(edges)
    assert sorted(x for c in g["components"] for x in c["members"]) == sorted(n["id"] for n in g["nodes"])
    assert {r["value"] for r in g["resolution"] if r["dim"] == "category"} == {"internal", "external", "builtin", "attribute"}
    page = (tmp_path / "vault/nodes/app_main_py_run.md").read_text()
    for part in ("## Definition\n```python\ndef run(m: Model)", "## Call Graph\n```mermaid\nflowchart TD", "## Outgoing Calls", "[save](app_models_py_Model_save.md) (`method`)", "## Incoming Calls", "**Contained in:** [main.py](app_main_py.md)"):
        assert part in page, part
    readme = (tmp_path / "vault/README.md").read_text()
    assert "| Component | Cohesion | Size |" in readme and "## Import Cycles" in readme and "## Hubs" in readme
    assert "vault/README.md" in (tmp_path / "AGENTS.md").read_text()
    at = visualize(b, str(tmp_path / "vault"))
    assert at.endswith("graph.html") and (tmp_path / "vault/graph.html").read_text().count("<circle") == nodes


def test_only_what_changed_is_built_again(spark, workspace, tmp_path):
    copy, vault = tmp_path / "ws", tmp_path / "ws/.weftgraph"
    shutil.copytree(workspace, copy)
    config = Config(str(copy), output=str(vault))
    first = build(spark, config)
    assert (first.counts["parsed"], first.counts["reused"], first.counts["snapshot"]) == (6, 0, 0)
    assert first.counts["rendered"] == first.counts["write"] > 10
    readme = vault / "README.md"
    readme.write_text(readme.read_text().replace(EMPTY, "mine"))

    os.utime(copy / "app/models.py", (5, 5))  # another time, equal content
    again = build(spark, config)
    assert (again.counts["parsed"], again.counts["reused"], again.counts["snapshot"], again.counts["rendered"]) == (0, 6, 1, 0)
    assert again.counts["write"] == again.counts["delete"] == 0 and "mine" in readme.read_text()
    assert sorted(map(tuple, again.edges.collect())) == sorted(map(tuple, first.edges.collect()))

    (copy / "tests/test_main.py").unlink()
    (copy / "srv/b.go").write_text("package srv\nfunc boot() {\n}\nfunc added() {\n  Serve()\n}\n")
    edited = build(spark, config)
    assert (edited.counts["parsed"], edited.counts["reused"], edited.counts["snapshot"]) == (1, 4, 0)
    assert edited.counts["delete"] >= 2 and not (vault / "nodes/tests_test_main_py.md").exists()
    assert 0 < edited.counts["rendered"] < first.counts["rendered"] and (vault / "nodes/srv_b_go_added.md").exists()
    assert {(r.src, r.dst) for r in edited.edges.collect()} >= {("srv/b.go::added", "srv/a.go::Serve"), ("app/main.py::run", "app/models.py::make")}

    (vault / ".cache/nodes.json").write_text("no json")
    assert load_table(spark, f"file://{vault}/.cache", "nodes") is None
    clear_vault(str(vault))
    assert not (vault / "nodes").exists() and not readme.exists()


def test_a_registered_language_and_hooks(spark, tmp_path):
    (tmp_path / "a.toy").write_text("thing one\nthing two\n")
    (tmp_path / "b.py").write_text("def f():\n    g()\n")

    def read(path, text):
        out = Found(path)
        out.node(path, path, "file", 1, 2)
        for k, line in enumerate(text.splitlines(), 1):
            out.node(f"{path}::{line.split()[1]}", line.split()[1], "function", k, k, parent=path)
        return out

    def nothing(r, ix):
        return r.where("false").selectExpr("ref_id", "'hit' AS status", "'' AS target")

    def all_to_one(r, ix):
        return r.selectExpr("ref_id", "'hit' AS status", "'a.toy::one' AS target")

    hooks = Hooks(extractors={"toy": Extractor("toy", (".toy",), read)}, chain=(nothing,), by_language={"python": (all_to_one,)})
    b = build(spark, Config(str(tmp_path)), hooks=hooks)
    assert {("b.py::f", "a.toy::one"), ("a.toy", "a.toy::two")} <= {(r.src, r.dst) for r in b.edges.collect()}


def test_reports_in_both_languages(built):
    b = built[0]
    assert "组件" in report.agent_prompt(b, "zh-CN") and "Components" in report.agent_prompt(b)
    assert report.kept_insights("x\n## Notes\n\nold words\n") == "old words"
    assert report.rules_file("# Rules\n", "v").startswith("# Rules\n\n## Code graph") and report.rules_file("## Code graph", "v") is None


def test_gates(spark, workspace, built):
    b = built[0]
    with pytest.raises(RuntimeError):
        build(spark, Config(str(workspace), strict=True))
    at = b.analysis["summary"].first()
    assert at.unresolved > 0 and at.attempted == at.resolved + at.unresolved
    for gate in ({"min_resolve_rate": at.resolve_rate + 0.001}, {"max_unresolved_edges": at.unresolved - 1}):
        with pytest.raises(RuntimeError):
            enforce(b, Config("x", **gate))
    enforce(b, Config("x", min_resolve_rate=at.resolve_rate, max_unresolved_edges=at.unresolved, max_internal_unresolved_edges=at.internal_unresolved, min_internal_resolve_rate=at.internal_rate))
    low = spark.createDataFrame([(10, 4, 0.6, 0.5, 3)], "attempted long, unresolved long, resolve_rate double, internal_rate double, internal_unresolved long")
    gates = {r.gate: r.passed for r in R.quality_gates(low, {"internal_rate": 0.6, "internal_unresolved": 2, "unresolved": 4, "resolve_rate": 0.6}).collect()}
    assert gates == {"internal_rate": False, "internal_unresolved": False, "unresolved": True, "resolve_rate": True}


def test_snapshot(spark, tmp_path):
    df = spark.range(3)
    snapshot_write(df, str(tmp_path), "aa")
    assert snapshot_read(spark, str(tmp_path), "aa").count() == 3
    assert snapshot_read(spark, str(tmp_path), "bb") is None


def test_command_line(workspace, capsys):
    assert main(["info"]) == 0
    with pytest.raises(SystemExit):
        parser().parse_args(["build", "x", "--min-resolve-rate", "2"])
    (workspace / ".weftgraphrc").write_text('{"naming": "symbol", "exclude": ["a"], "cache": false}')
    assert parser().parse_args(["visualize", "x", "--output", "y", "--max-unresolved-edges", "3", "--report-language", "zh"]).max_unresolved_edges == 3
    c = Config.merged(str(workspace), exclude=("b",), naming=None)
    assert (c.naming, c.exclude, c.cache) == ("symbol", ("a", "b"), False)
    (workspace / ".weftgraphrc").write_text("{broken")
    with pytest.warns(UserWarning):
        assert Config.merged(str(workspace)).naming == "hybrid"
    (workspace / ".weftgraphrc").unlink()


def test_links_out_of_the_workspace_are_left_out(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "out").mkdir()
    (tmp_path / "out/x.py").write_text("a = 1\n")
    (tmp_path / "in/y.py").write_text("a = 1\n")
    (tmp_path / "in/far").symlink_to(tmp_path / "out")
    assert [r.path for r in scan_files(spark, str(tmp_path / "in")).select("path").collect()] == ["y.py"]
