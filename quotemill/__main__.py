"""python -m quotemill list | run NAME FOLDER [--out PATH] | explain NAME FOLDER | doctor"""

from __future__ import annotations

import argparse
import importlib
import importlib.util
import sys

from quotemill import __version__
from quotemill.plans import catalog
from quotemill.session import scope, session


def _queries() -> dict:
    """The driver contract's queries where it can be imported, else the core's."""
    try:
        return importlib.import_module("__spark_entry__").queries()
    except ImportError:
        return catalog.queries()


def doctor() -> int:
    """Whether Spark starts and what is optional is there; 1 only if Spark doesn't."""
    try:
        ok = session("doctor").range(1).count() == 1
    except Exception as e:  # noqa: BLE001 - any reason is reported
        print("spark:", e)
        return 1
    for name in ("pandas", "pyarrow", "numpy", "tiktoken", "duckdb"):
        print(f"{name}: {'there' if importlib.util.find_spec(name) else 'missing'}")
    print("spark:", "ok" if ok else "wrong result")
    return 0 if ok else 1


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="quotemill", description=__doc__)
    parser.add_argument("--version", action="version", version=__version__)
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("list")
    commands.add_parser("doctor")
    for name in ("run", "explain"):
        p = commands.add_parser(name)
        p.add_argument("query")
        p.add_argument("folder")
        p.add_argument("--out")
    args = parser.parse_args(argv)
    if args.command == "doctor":
        return doctor()
    queries = _queries()
    if args.command == "list":
        for name, f in queries.items():
            print(f"{name}: {(f.__doc__ or '').strip()}")
        return 0
    if args.query not in queries:
        print(f"no query {args.query}", file=sys.stderr)
        return 2
    with scope():
        df = queries[args.query](session(), args.folder)
        if args.command == "explain":
            df.explain("formatted")
        elif args.out:
            df.write.mode("overwrite").parquet(args.out)
        else:
            df.show(50, truncate=80)
    return 0


if __name__ == "__main__":
    sys.exit(main())
