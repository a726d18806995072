"""Command line: ``python -m codequarry.cli <command>``."""

from __future__ import annotations

import argparse
import json
import os
import sys

from codequarry.plans import indexing, tools
from codequarry.plans.store import Store
from codequarry.session import build_session


def parser() -> argparse.ArgumentParser:
    root = argparse.ArgumentParser(prog="codequarry", description="Code intelligence on Spark")
    root.add_argument("--store", default=os.environ.get("CODEQUARRY_STORE", os.path.expanduser("~/.codequarry")), help="folder of the stored tables")
    root.add_argument("--master", default=None, help="Spark master; default from the Spark configuration")
    commands = root.add_subparsers(dest="command", required=True)

    def command(name: str, *arguments: tuple, **kwargs):
        sub = commands.add_parser(name, **kwargs)
        for flags, options in arguments:
            sub.add_argument(*flags, **options)
        return sub

    repo = (["--repo"], {"default": None})
    command("index", (["path"], {}), (["--name"], {"default": None}), (["--incremental"], {"action": "store_true"}))
    command("index-all", (["path"], {}), (["--include"], {"action": "append"}), (["--exclude"], {"action": "append"}), (["--minimum"], {"type": int, "default": 1}))
    command("discover", (["path"], {}), (["--include"], {"action": "append"}), (["--exclude"], {"action": "append"}), (["--minimum"], {"type": int, "default": 1}))
    command("search", (["query"], {}), (["-n"], {"type": int, "default": 10}), repo, (["--type"], {"default": None}), (["--language"], {"default": None}), (["--detail"], {"default": "summary"}))
    for name in ("context", "usages", "tests", "hierarchy"):
        command(name, (["symbol"], {}), repo)
    command("implementations", (["symbol"], {}), repo, (["--indirect"], {"action": "store_true"}))
    command("file-summary", (["path"], {}), repo)
    command("impact", (["path"], {}), (["--since"], {"default": "HEAD~1"}), (["--name"], {"default": None}))
    command("stats")
    command("clear", (["repo"], {}))
    command("clear-all", (["--yes"], {"action": "store_true"}))
    command("config-show")
    command("tool", (["name"], {}), (["arguments"], {"help": "JSON object", "nargs": "?", "default": "{}"}))
    return root


def run(arguments: list[str], spark=None) -> dict:
    """Parse and execute; the result is what the command prints."""
    args = parser().parse_args(arguments)
    if args.command == "config-show":
        return {"store": args.store, "master": args.master, "model": "mock"}
    if args.command == "clear-all" and not args.yes:
        return {"error": "clear-all needs --yes"}
    spark = spark or build_session(master=args.master)
    store = Store(spark, args.store)
    if args.command == "index":
        return indexing.index_repo(store, args.path, args.name, args.incremental)
    if args.command == "index-all":
        return indexing.index_all(store, args.path, args.include, args.exclude, args.minimum)
    if args.command == "discover":
        found = indexing.sf.discover(indexing.scan(store, args.path, None), args.include, args.exclude, args.minimum)
        return {"repositories": [r.asDict() for r in found.limit(1000).collect()]}
    if args.command == "clear":
        store.clear_repo(args.repo)
        return {"status": "cleared", "repo_name": args.repo}
    if args.command == "clear-all":
        store.clear_all()
        return {"status": "cleared"}
    index = tools.Index.of(store)
    if args.command == "impact":
        name = args.name or os.path.basename(args.path.rstrip("/"))
        return tools.diff_impact(index, indexing.git.changed_source_files(spark, args.path, name, args.since))
    calls = {
        "search": lambda: tools.semantic_grep(index, args.query, args.n, args.repo, args.type, args.language, detail_level=args.detail),
        "context": lambda: tools.get_context(index, args.symbol, args.repo),
        "usages": lambda: tools.find_usages(index, args.symbol, args.repo),
        "tests": lambda: tools.find_tests(index, args.symbol, args.repo),
        "hierarchy": lambda: tools.find_hierarchy(index, args.symbol, args.repo),
        "implementations": lambda: tools.find_implementations(index, args.symbol, args.repo, args.indirect),
        "file-summary": lambda: tools.file_summary(index, args.path, args.repo),
        "stats": lambda: tools.get_index_stats(index),
        "tool": lambda: tools.call_tool(args.name, index, json.loads(args.arguments)),
    }
    return calls[args.command]()


def main() -> int:
    result = run(sys.argv[1:])
    print(json.dumps(result, indent=2, default=str))
    return 1 if "error" in result else 0


if __name__ == "__main__":
    sys.exit(main())
