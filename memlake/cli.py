"""Command line: python -m memlake.cli --store PATH COMMAND ..."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from memlake.api import MemoryService


def build_parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="memlake", description="Conversational memory on Spark")
    p.add_argument("--store", required=True)
    sub = p.add_subparsers(dest="command", required=True)
    for name, args in {"ingest-json": ("corpus", "path"), "search": ("question",), "get-root": ("corpus",), "get-session": ("corpus", "session"), "get-entity": ("corpus", "entity"), "get-timeline": ("entity",), "list-corpora": (), "compact": (), "approximate": (), "write-report": ("path",)}.items():
        c = sub.add_parser(name)
        for a in args:
            c.add_argument(a)
    return p


def main(argv: list[str] | None = None) -> int:
    a = build_parser().parse_args(argv)
    s = MemoryService(SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate(), a.store)
    if a.command == "ingest-json":
        print(s.append_json(a.corpus, a.path))
        return 0
    if a.command == "compact":
        print(s.compact())
        return 0
    if a.command == "write-report":
        s.write_report(a.path)
        return 0
    frames = {"approximate": lambda: [s.approximate()], "search": lambda: s.search(a.question).values(), "get-root": lambda: [s.root(a.corpus)], "get-session": lambda: [s.session(a.corpus, a.session)], "get-entity": lambda: [s.entity(a.corpus, a.entity)], "get-timeline": lambda: s.timeline(a.entity), "list-corpora": lambda: [s.corpora()]}[a.command]()
    for df in frames:
        for line in df.toJSON().toLocalIterator():
            print(line)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
