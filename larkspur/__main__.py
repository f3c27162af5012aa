"""Command line: add, search, get, delete and stats over a store folder."""

from __future__ import annotations

import argparse
import json

from larkspur.api import Memory
from larkspur.session import session


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="larkspur")
    p.add_argument("--base", required=True, help="store folder")
    p.add_argument("--tenant", required=True)
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("add")
    a.add_argument("text")
    a.add_argument("--type", default="other")
    a.add_argument("--project")
    a.add_argument("--timestamp-ms", type=int, default=0)
    s = sub.add_parser("search")
    s.add_argument("query")
    s.add_argument("-k", type=int, default=10)
    for name in ("get", "delete"):
        sub.add_parser(name).add_argument("chunk_id")
    sub.add_parser("stats")
    o = p.parse_args(argv)
    m = Memory(session(), o.base)
    show = lambda df: [print(r) for r in df.toJSON().collect()]  # noqa: E731  at most k rows, or one a tenant
    if o.command == "add":
        print(json.dumps({"chunk_id": m.memory_add(o.tenant, o.text, o.type, o.project, timestamp_ms=o.timestamp_ms)}))
    elif o.command == "search":
        show(m.memory_search(o.tenant, o.query, o.k))
    elif o.command == "get":
        show(m.memory_get(o.tenant, o.chunk_id))
    elif o.command == "delete":
        print(json.dumps({"deleted": m.memory_delete(o.tenant, o.chunk_id)}))
    else:
        show(m.memory_stats(o.tenant))


if __name__ == "__main__":
    main()
