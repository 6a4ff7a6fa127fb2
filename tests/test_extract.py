import pytest

from weftgraph.sources.extract import extract_file

CASES = {
    "typescript": (b"import {A as B} from './m';\nclass Foo extends Bar {\n  run(x: Client): void {\n    x.go();\n    const y = new Thing();\n  }\n}\nfunction main() { return new Foo(); }\n", {"Foo": "class", "Foo.run": "method", "main": "function"}, {("::Foo", "Bar", "inherits"), ("", "./m", "imports"), ("::Foo.run", "x.go", "calls"), ("::main", "Foo", "calls")}),
    "javascript": (b"const fs = require('fs');\nimport * as q from 'q';\nfunction a() { b(); /* c() */ }\n", {"a": "function"}, {("", "fs", "imports"), ("", "q", "imports"), ("::a", "b", "calls")}),
    "kotlin": (b"import a.b.C\nclass S(val r: R) : Base() {\n  fun go(x: C): Int {\n    val y = C()\n    y.act()\n  }\n}\nfun top() = go()\n", {"S": "class", "S.go": "method", "top": "function"}, {("::S", "Base", "inherits"), ("", "a.b", "imports"), ("::S.go", "y.act", "calls")}),
    "go": (b'package x\nimport (\n  h "net/http"\n)\ntype Server struct { a int }\nfunc (s *Server) Start() error {\n  fmt.Println("x()")\n}\nfunc boot() {}\n', {"Server": "struct", "Server.Start": "method", "boot": "function"}, {("", "net/http", "imports"), ("::Server.Start", "fmt.Println", "calls"), ("::Server", "::Server.Start", "contains")}),
    "rust": (b"use a::b::{C, D as E};\nstruct P { x: i32 }\ntrait T { fn f(&self); }\nimpl T for P {\n  fn f(&self) { let g = G::new(); g.turn(); }\n}\n", {"P": "struct", "T": "interface", "P.f": "method"}, {("::P", "T", "implements"), ("", "a::b", "imports"), ("::P.f", "g.turn", "calls")}),
    "swift": (b"import Foundation\nclass A: B {\n  init(x: Int) { go() }\n  func go() -> C { let c = C(); c.act() }\n}\nprotocol Q {}\n", {"A": "class", "A.init": "method", "A.go": "method", "Q": "interface"}, {("::A", "B", "inherits"), ("", "Foundation", "imports"), ("::A.go", "c.act", "calls")}),
    "cpp": (b'#include "a.h"\nnamespace N {\nclass K : public Base {\n  int f() { return g(); }\n};\n}\nint N::K::h(int a) {\n  return f();\n}\n', {"N": "namespace", "N.K": "class", "N.K.f": "method", "N.K.h": "method"}, {("::N.K", "Base", "inherits"), ("", "a.h", "imports"), ("::N.K.h", "f", "calls")}),
    "c": (b'#include <a.h>\nstruct P { int x; };\nint go(struct P *p) {\n  printf("x");\n}\n', {"P": "struct", "go": "function"}, {("", "a.h", "imports"), ("::go", "printf", "calls")}),
    "ocaml": (b"open List\nmodule M = struct\n  let f x = String.length x\nend\ntype t = int\nlet main () =\n  M.f 3\n", {"M": "class", "M.f": "method", "t": "struct", "main": "function"}, {("", "List", "imports"), ("::main", "M.f", "calls")}),
    "dart": (b"import 'package:p/q.dart';\nabstract class A {}\nclass B extends A {\n  B();\n  void go() { act(); }\n}\nenum E { x, y }\nmixin M {}\n", {"A": "interface", "B": "class", "B.B": "constructor", "B.go": "method", "E": "enum", "M": "mixin"}, {("::B", "A", "inherits"), ("", "package:p/q.dart", "imports"), ("::B.go", "act", "calls")}),
    "python": (b"import os\nfrom .m import A as B\nclass C(B):\n    '''doc'''\n    def f(self, x: 'Optional[A]') -> A:\n        y = A()\n        return y.go().z()\n\ndef g():\n    C().f(1)\n", {"C": "class", "C.f": "method", "g": "function"}, {("", "os", "imports"), ("", "d.m", "imports"), ("::C", "B", "inherits"), ("::C.f", "y.go().z", "calls")}),
}


@pytest.mark.parametrize("lang", CASES)
def test_language(lang):
    text, symbols, edges = CASES[lang]
    nodes, found, error = extract_file("d/f.x", lang, text)
    assert error is None
    got = {n["id"].removeprefix("d/f.x::"): n["type"] for n in nodes if n["type"] != "file"}
    assert symbols.items() <= got.items()
    short = {(e["source"].removeprefix("d/f.x"), e["target"].removeprefix("d/f.x"), e["relation"]) for e in found}
    assert edges <= short


def test_bindings_and_errors():
    nodes, _, _ = extract_file("f.py", "python", CASES["python"][0])
    assert next(n for n in nodes if n["label"] == "f")["local_bindings"] == {"x": "A", "y": "A"}
    assert extract_file("f.py", "python", b"def (")[2].startswith("SyntaxError")
    assert extract_file("f.zz", "cobol", b"")[2] == "no extractor for cobol"
