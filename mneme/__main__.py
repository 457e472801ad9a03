"""Command line: ``python -m mneme ROOT ingest|search|ask|related|delete|evaluate|notes|domains|graph|items|stats|cache ...``."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from mneme.operators import evaluation, reports
from mneme.service import Vault
from mneme.sources import files


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="mneme", description=__doc__)
    parser.add_argument("root", help="folder of the engine's tables")
    commands = parser.add_subparsers(dest="command", required=True)
    ingest = commands.add_parser("ingest")
    ingest.add_argument("notes")
    ingest.add_argument("--force", action="store_true")
    for name in ("search", "ask"):
        p = commands.add_parser(name)
        p.add_argument("question")
        p.add_argument("--domain")
        p.add_argument("--top-k", type=int, default=5)
    items = commands.add_parser("items")
    items.add_argument("notes")
    items.add_argument("heading")
    items.add_argument("--markdown", action="store_true")
    related = commands.add_parser("related")
    related.add_argument("source_path")
    related.add_argument("--top-k", type=int, default=5)
    commands.add_parser("delete").add_argument("source_path", nargs="+")
    commands.add_parser("evaluate").add_argument("gold")
    commands.add_parser("cache").add_argument("--domain")
    commands.add_parser("notes").add_argument("--domain")
    for name in ("domains", "graph", "stats"):
        commands.add_parser(name)
    args = parser.parse_args(argv)
    vault = Vault(SparkSession.builder.appName("mneme").getOrCreate(), args.root)
    if args.command == "ingest":
        out = vault.ingest(args.notes, args.force)
    elif args.command == "search":
        out = vault.search([(args.question, args.domain)], args.top_k).orderBy("rank")
    elif args.command == "ask":
        out = vault.ask([(args.question, args.domain)], args.top_k)
    elif args.command == "items":
        ordered = vault.open_items(args.notes, args.heading)
        print(reports.items_text(ordered, args.markdown))
        return int(ordered.where("since is null").count() > 0)
    elif args.command == "cache":
        print(vault.clean_cache(args.domain))
        return 0
    elif args.command == "delete":
        print(vault.delete(*args.source_path))
        return 0
    elif args.command == "evaluate":
        print(evaluation.report_text(evaluation.summarize(vault.evaluate(files.read_gold(vault.spark, args.gold)))))
        return 0
    elif args.command == "related":
        near, linked = vault.find_related(args.source_path, args.top_k)
        out = near.orderBy("rank").select("rank", "source_path", "header", "score").unionByName(linked.select("source_path", "neighbour", "direction"), allowMissingColumns=True)
    elif args.command == "notes":
        out = vault.notes(args.domain)
    else:
        out = {"domains": vault.domains, "graph": vault.graph_check, "stats": vault.stats}[args.command]()
    for row in out.toJSON().toLocalIterator():
        print(row)
    return int(args.command == "graph" and out.first()["dead_links"] > 0)


if __name__ == "__main__":
    sys.exit(main())
