"""Command line: python -m textsieve.cli literal|regex|explain|status|ensure|clear [ARGUMENT] [--workspace DIR]."""

from __future__ import annotations

import argparse
import json


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("command", choices=["literal", "regex", "explain", "status", "ensure", "clear"])
    parser.add_argument("argument", nargs="?", default="")
    parser.add_argument("--workspace")
    parser.add_argument("--index-dir")
    parser.add_argument("--flags", default="")
    parser.add_argument("--glob", action="append")
    parser.add_argument("--max-results", type=int, default=100)
    a = parser.parse_args(args)
    from textsieve.plans.query_plan import explain

    if a.command == "explain":
        print(json.dumps(explain(a.argument, a.flags).as_dict(), indent=2))
        return 0
    from pyspark.sql import SparkSession

    from textsieve.engine import Engine

    engine = Engine(SparkSession.builder.getOrCreate(), a.workspace, a.index_dir)
    if a.command in ("literal", "regex"):
        options = {"path_globs": a.glob, "max_results": a.max_results}
        found = engine.search_literal(a.argument, "i" not in a.flags, **options) if a.command == "literal" else engine.search_regex(a.argument, a.flags, **options)
        for row in found.matches.toJSON().collect():  # max_results rows
            print(row)
    else:
        print(json.dumps({"status": engine.index.status, "ensure": engine.index.ensure, "clear": engine.index.clear}[a.command](), indent=2))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
