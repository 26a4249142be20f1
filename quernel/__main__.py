"""Command line: ``python -m quernel --store PATH COMMAND ...``; answers are JSON."""

from __future__ import annotations

import argparse
import json
import sys
from datetime import date

from pyspark.sql import SparkSession

from quernel.service import Engine


def _list(text: str | None) -> list[str] | None:
    return [x.strip() for x in text.split(",") if x.strip()] if text else None


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quernel")
    p.add_argument("--store", required=True, help="folder or URI of the tables")
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, *args: tuple) -> None:
        c = sub.add_parser(name)
        for flags, options in args:
            c.add_argument(*flags, **options)

    day = {"type": date.fromisoformat, "default": None}
    flag = {"action": "store_true"}
    add("save", (["text"], {}), (["--mood"], {}), (["--tags"], {}), (["--event-time"], day))
    add("kg-index", (["content_hash"], {}), (["--entities"], {"default": "[]"}), (["--relationships"], {"default": "[]"}), (["--event-time"], day))
    add("kg-alias", (["canonical"], {}), (["--aliases"], {"required": True}))
    add("kg-invalidate", (["--valid-until"], day | {"required": True}), (["--source"], {"default": ""}), (["--target"], {"default": ""}), (["--rel-type"], {"default": ""}), (["--reason"], {"default": ""}))
    add("search", (["query"], {}), (["--limit"], {"type": int, "default": 10}), (["--from"], day | {"dest": "start"}), (["--to"], day | {"dest": "end"}), (["--entities"], {}), (["--include-historical"], flag))
    add("recall", (["entity"], {}), (["--hops"], {"type": int, "default": 2}), (["--limit"], {"type": int, "default": 10}), (["--include-historical"], flag))
    add("connect", (["a"], {}), (["b"], {}), (["--include-historical"], flag))
    add("entities", (["--limit"], {"type": int, "default": 50}))
    add("timeline", (["--from"], day | {"dest": "start"}), (["--to"], day | {"dest": "end"}), (["--limit"], {"type": int, "default": 50}), (["--sort-by"], {"default": "processing_time"}))
    add("dedup-scan", (["--auto-merge"], flag))
    add("merge", (["source"], {}), (["target"], {}))
    add("clusters", (["--include-historical"], flag))
    add("cluster", (["label"], {}))
    add("consolidate", (["--half-life"], {"type": float, "default": 90}), (["--older-than"], {"type": int, "default": 30}), (["--auto-merge"], flag))
    add("export-graph", (["--format"], {"choices": ["json", "html"], "default": "json"}))
    return p


def run(e: Engine, a: argparse.Namespace) -> dict | str:
    calls = {
        "save": lambda: e.save_memory(a.text, a.mood, _list(a.tags), a.event_time),
        "kg-index": lambda: e.kg_index(a.content_hash, a.entities, a.relationships, a.event_time),
        "kg-alias": lambda: e.kg_alias(a.canonical, json.loads(a.aliases) if a.aliases.startswith("[") else _list(a.aliases) or []),
        "kg-invalidate": lambda: e.kg_invalidate(a.valid_until, a.source, a.target, a.rel_type, a.reason),
        "search": lambda: e.search_memories(a.query, a.limit, a.start, a.end, _list(a.entities), a.include_historical),
        "recall": lambda: e.recall_entity(a.entity, a.hops, a.limit, a.include_historical),
        "connect": lambda: e.explain_connection(a.a, a.b, a.include_historical),
        "entities": lambda: e.list_entities(a.limit),
        "timeline": lambda: e.get_timeline(a.start, a.end, a.limit, a.sort_by),
        "dedup-scan": lambda: e.dedup_scan(a.auto_merge),
        "merge": lambda: e.merge(a.source, a.target),
        "clusters": lambda: e.detect_clusters(a.include_historical),
        "cluster": lambda: e.get_cluster(a.label),
        "consolidate": lambda: e.consolidate(a.half_life, a.older_than, a.auto_merge),
        "export-graph": lambda: e.export_json() if a.format == "json" else e.export_html(),
    }
    return calls[a.command]()


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        found = run(Engine(spark, a.store), a)
    except ValueError as x:
        print(json.dumps({"status": "error", "reason": str(x)}))
        return 1
    print(found if isinstance(found, str) else json.dumps(found, ensure_ascii=False, indent=2, default=str))
    return 0


if __name__ == "__main__":
    sys.exit(main())
