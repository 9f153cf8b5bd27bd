"""python -m codeatlas ROOT [--export json|dot|mermaid] [--focus ID] [--violations]: scans a tree once and prints."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from codeatlas import api
from codeatlas.operators import views


def main(argv: list[str] | None = None) -> int:
    """0, or 1 where --violations finds any."""
    ask = argparse.ArgumentParser(prog="codeatlas")
    ask.add_argument("root")
    ask.add_argument("--export", choices=["json", "dot", "mermaid"])
    ask.add_argument("--focus")
    ask.add_argument("--violations", action="store_true")
    given = ask.parse_args(argv)
    atlas = api.scan(SparkSession.builder.getOrCreate(), given.root)
    if given.violations:
        rows = atlas.violations().collect()  # 500 at most
        for r in rows:
            print(f"{r.from_file}:{r.from_line}: {r.kind}: {r.to_file or ' <-> '.join(r.dirs)}")
        return int(bool(rows))
    if given.export:
        print(views.assembled(atlas.export(given.export, given.focus)), end="")
    else:
        print(atlas.stats().toJSON().first())
    return 0


if __name__ == "__main__":
    sys.exit(main())
