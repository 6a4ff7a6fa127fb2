"""Command line: ``python -m weftgraph build SRC_DIR``."""

from __future__ import annotations

import argparse
import sys

from weftgraph import __version__


def rate(text: str) -> float:
    value = float(text)
    if not 0 <= value <= 1:
        raise argparse.ArgumentTypeError("a rate lies between 0 and 1")
    return value


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="weftgraph")
    p.add_argument("--version", action="version", version=__version__)
    sub = p.add_subparsers(dest="command", required=True)
    for name, text in (("build", "build the graph of a source tree"), ("visualize", "build it and draw graph.html")):
        b = sub.add_parser(name, help=text)
        b.add_argument("workspace")
        b.add_argument("--output", required=name == "visualize")
        b.add_argument("--exclude", action="append")
        b.add_argument("--include", action="append")
        b.add_argument("--language", action="append", dest="languages")
        b.add_argument("--naming", choices=("hybrid", "package", "symbol"))
        b.add_argument("--report-language", help="en, or any zh")
        b.add_argument("--cache", action=argparse.BooleanOptionalAction)
        b.add_argument("--exclude-tests", action=argparse.BooleanOptionalAction)
        b.add_argument("--export-json", action=argparse.BooleanOptionalAction)
        b.add_argument("--strict", action="store_true", default=None)
        b.add_argument("--clear", action="store_true", help="remove what earlier builds wrote first")
        for gate in ("--min-resolve-rate", "--min-internal-resolve-rate"):
            b.add_argument(gate, type=rate)
        for gate in ("--max-unresolved-edges", "--max-internal-unresolved-edges"):
            b.add_argument(gate, type=int)
    sub.add_parser("info", help="what this is")
    return p


def main(argv: list[str] | None = None) -> int:
    args = vars(parser().parse_args(argv))
    command = args.pop("command")
    if command == "info":
        print(f"weftgraph {__version__}: source trees as queryable graphs on Spark")
        return 0
    from pyspark.sql import SparkSession

    from weftgraph.plans.build import Config, build, clear_vault, visualize

    args = {k: tuple(v) if isinstance(v, list) else v for k, v in args.items()}
    if args.pop("clear") and args["output"]:
        clear_vault(args["output"])
    spark = SparkSession.builder.appName("weftgraph").getOrCreate()
    try:
        b = build(spark, Config.merged(**args), lambda stage: print(stage, file=sys.stderr))
    except RuntimeError as e:
        print(f"failed: {e}", file=sys.stderr)
        return 1
    if command == "visualize":
        print(visualize(b, args["output"]), file=sys.stderr)
    print(b.counts, file=sys.stderr)
    b.analysis["metrics"].show()
    return 0


if __name__ == "__main__":
    sys.exit(main())
