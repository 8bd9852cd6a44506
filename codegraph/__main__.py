"""Command line: index a tree, ask a question, or print statistics."""

from __future__ import annotations

import argparse
import sys

QUESTIONS = {"find_def": "symbol", "find_refs": "symbol", "call_graph": "symbol", "flow": "symbol", "arch_query": "concept", "arch_candidates": "concept", "precision_report": "symbol", "dep_graph": None, "arch_list": None}


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="codegraph")
    parser.add_argument("--root", default=".")
    commands = parser.add_subparsers(dest="command")
    commands.add_parser("init", help="index once, write the client's entry and the ignore block")
    commands.add_parser("serve", help="answer JSON-RPC on standard input")
    commands.add_parser("stats").add_argument("--transcript")
    for name, argument in QUESTIONS.items():
        sub = commands.add_parser(name)
        if argument:
            sub.add_argument(argument)
        if argument == "symbol" and name != "precision_report":
            sub.add_argument("--path-glob")
        if name in ("call_graph", "flow", "dep_graph"):
            sub.add_argument("--depth", type=int, default={"call_graph": 5, "flow": 6}.get(name, 1))
        if name == "dep_graph":
            sub.add_argument("--focus")
            sub.add_argument("--cycles", action="store_true")
        if name == "arch_query":
            sub.add_argument("--reaccept", action="store_true")
        if name == "arch_candidates":
            sub.add_argument("--threshold", type=float, default=0.5)
            sub.add_argument("--limit", type=int, default=10)
    args = vars(parser.parse_args(argv))
    command, root = args.pop("command"), args.pop("root")
    if command is None:
        parser.print_help()
        return 0
    from pyspark.sql import SparkSession

    from .engine import Engine

    engine = Engine(SparkSession.builder.appName("codegraph").getOrCreate(), root)
    if command == "init":
        from . import setup

        s = engine.sync()
        setup.write_client(root)
        setup.ensure_ignored(root)
        print(f"{s['file_count']} files, {s['symbol_count']} symbols, {s['elapsed_ms']} ms")
    elif command == "serve":
        from .server import serve

        serve(engine)
    else:
        print(getattr(engine, command)(**args).text)
    return 0


if __name__ == "__main__":
    sys.exit(main())
