"""Queries over source files: this package's own tree, and a sample of each other language."""

from __future__ import annotations

import uuid
from pathlib import Path

from pyspark.sql import functions as F

from weftgraph.operators.graph import cut
from weftgraph.plans.build import snapshot_read, snapshot_write
from weftgraph.plans.query import registry
from weftgraph.sources.extract import extract, tables
from weftgraph.sources.scan import scan_files as scan

QUERIES, ORACLES, query = registry()
ROOT = str(Path(__file__).resolve().parents[1])
SAMPLES = {
    "javascript": "import {a as b} from './m';\nclass Box extends Base {\n  open() {\n    b();\n  }\n}\nfunction start() {\n  return new Box();\n}\n",
    "typescript": "interface Shape { area(): number }\nfunction draw(s: Shape): void {\n  s.area();\n}\n",
    "kotlin": "import k.Tool\nclass Shop(val t: Tool) {\n  fun sell(x: Tool): Int {\n    return x.price()\n  }\n}\n",
    "go": 'package p\nimport "fmt"\ntype Pump struct { n int }\nfunc (p *Pump) Run() {\n  fmt.Println(1)\n}\n',
    "rust": "use a::Gear;\nstruct Mill { g: Gear }\nimpl Mill {\n  fn grind(&self) -> Gear {\n    self.g.turn()\n  }\n}\n",
    "swift": "import Foundation\nstruct Lamp {\n  func glow() -> Int {\n    return watt()\n  }\n}\n",
    "c": '#include "io.h"\nstruct pt { int x; };\nint area(struct pt *p) {\n  return side(p);\n}\n',
    "cpp": '#include "a.hpp"\nnamespace n {\nclass Car : public Base {\n  int go() { return step(); }\n};\n}\n',
    "ocaml": "open List\nmodule M = struct\n  let twice x = String.length x\nend\n",
    "dart": "import 'package:p/q.dart';\nclass Kite extends Toy {\n  void fly() { rise(); }\n}\n",
}


def rows_of(extracted):
    """(source, kind, label, relation) of all symbols and relations."""
    nodes, _, edges, _ = tables(extracted)
    n = nodes.select(F.col("id").alias("source"), F.col("type").alias("kind"), F.col("label").alias("target"), "line_start")
    return n.unionByName(edges.select("source", F.col("relation").alias("kind"), "target", F.lit(0).alias("line_start")))


@query()
def scan_files(spark, sf):
    return scan(spark, ROOT).select("path", "lang", "size", "md5")


@query()
def extract_python_symbols(spark, sf):
    return rows_of(extract(scan(spark, ROOT)))


def _sample(lang: str):
    def run(spark, sf):
        files = spark.createDataFrame([(f"src/sample.{lang}", lang, bytearray(SAMPLES[lang], "utf-8"))], "path string, lang string, content binary")
        return rows_of(extract(files))

    run.__name__ = f"extract_{lang}_symbols"
    return run


for _lang in SAMPLES:
    query()(_sample(_lang))


@query()
def snapshot_roundtrip(spark, sf):
    """The scan's table, written for a fingerprint and read back."""
    files = cut(scan(spark, ROOT).select("path", "md5"))
    shared = files.inputFiles()[0].rsplit("/", 2)[0]
    snapshot_write(files, f"{shared}/snapshots", key := uuid.uuid4().hex)
    return snapshot_read(spark, f"{shared}/snapshots", key)
