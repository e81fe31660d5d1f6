"""Command line: ``python -m episodeflow inspect|verify|convert|export PATH [TARGET]``.

Exit status of verify: 0 where all blocks are right, 1 otherwise, 2 for a path
without containers. Of convert and export: 0 when done, 1 where the source can't be
read, 2 for a format that isn't supported. export writes Parquet.
"""

from __future__ import annotations

import argparse
import sys


def _print(rows) -> None:
    """All rows, tab-separated under their names, fetched a partition at a time."""
    print("\t".join(rows.columns))
    for row in rows.toLocalIterator():
        print("\t".join("" if v is None else str(v) for v in row))


def main(argv: list[str] | None = None) -> int:
    from pyspark.errors import PySparkException
    from pyspark.sql import SparkSession

    from .sources import container, dispatch

    parser = argparse.ArgumentParser(prog="episodeflow")
    parser.add_argument("command", choices=["inspect", "verify", "convert", "export"])
    parser.add_argument("path")
    parser.add_argument("target", nargs="?", help="of convert and export: a new folder")
    parser.add_argument("--strict", action="store_true", help="of verify: check the hashes of names too")
    parser.add_argument("--format", help="of convert and export: the source's format, else found by its files")
    parser.add_argument("--to", default="container", help="of convert: container, npz or parquet")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("episodeflow").getOrCreate()
    if args.command in ("convert", "export"):
        if not args.target:
            parser.error("a target is needed")
        try:
            dispatch.convert(spark, args.path, args.target, "parquet" if args.command == "export" else args.to, args.format)
        except NotImplementedError as e:
            print(e, file=sys.stderr)
            return 2
        except (ValueError, OSError, PySparkException) as e:
            print(str(e)[:500], file=sys.stderr)
            return 1
        return 0
    if args.command == "inspect":
        _print(container.inspect(container.catalog(spark, args.path, permissive=True)).orderBy("file"))
        return 0
    blocks = container.read_blocks(spark, args.path, payload=False, permissive=True)
    bad = ~blocks["crc_ok"] if not args.strict else ~blocks["crc_ok"] | ~blocks["hash_ok"]
    checked = blocks.count()
    failures = blocks.where(bad | blocks["error"].isNotNull())
    _print(failures.select("file", "name", "error"))
    return 2 if not checked else int(failures.count() > 0)


if __name__ == "__main__":
    sys.exit(main())
