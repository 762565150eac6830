"""python -m weft query SCRIPT [--param k=v]... | ls URI | du URI | find URI [--name GLOB] | datasets | show NAME"""

from __future__ import annotations

import argparse
import json
import runpy

from . import api
from .chain import Chain, read_dataset
from .params import metrics, set_params
from .sources import listing


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="weft", description=__doc__)
    sub = parser.add_subparsers(dest="command", required=True)
    job = sub.add_parser("query")
    job.add_argument("script")
    job.add_argument("--param", action="append", default=[], metavar="K=V")
    for name in ("ls", "du", "find"):
        tree = sub.add_parser(name)
        tree.add_argument("uri")
        tree.add_argument("--name")
        tree.add_argument("--depth", type=int, default=0)
    sub.add_parser("datasets")
    show = sub.add_parser("show")
    show.add_argument("name")
    show.add_argument("--version")
    show.add_argument("--limit", type=int, default=20)
    args = parser.parse_args(argv)
    if args.command == "query":
        set_params(dict(p.split("=", 1) for p in args.param))
        runpy.run_path(args.script, run_name="__main__")
        if metrics.all():
            print(json.dumps(metrics.all()))  # noqa: T201
    elif args.command == "datasets":
        api.datasets().show()
    elif args.command == "show":
        read_dataset(api._spark(), args.name, args.version).show(args.limit)
    else:
        files = listing.list_files(api._spark(), args.uri).select("file.*")
        out = {"ls": lambda: listing.ls(files), "du": lambda: listing.du(files, args.depth), "find": lambda: listing.find(files, name=args.name)}[args.command]()
        Chain(out.orderBy("path")).show(limit=1000)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
