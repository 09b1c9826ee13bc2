"""Command line over the library: each command prints one report, as text or JSON lines.

Exit codes: 0 complete, 1 partial, 2 bad request, 3 not found or ambiguous, 4 failure.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import export as E
from .operators import methods as M
from .operators import relations as R
from .plans.request import CONSUMERS, InvalidInput, Limits, Literal, QueryRequest, Symbol
from .sources import artifact as S


def _lines(df: DataFrame, kind: str):
    shown = [F.decode(c, "UTF-8").alias(c) if t == "binary" else F.col(c) for c, t in df.dtypes if not t.startswith("array")]
    rows = df.select(*shown)
    if kind == "json":
        return (r[0] for r in rows.select(F.to_json(F.struct("*"))).toLocalIterator())
    return ("\t".join("" if v is None else str(v) for v in r) for r in rows.toLocalIterator())


def _target(args) -> Symbol | Literal:
    if args.literal is not None:
        return Literal("string", utf=args.literal.encode())
    owner = args.owner.replace(".", "/") if args.owner else None
    kind = "class" if args.name is None else "field" if args.descriptor and not args.descriptor.startswith("(") else "method"
    return Symbol(kind, owner, args.name, args.descriptor)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="factlane")
    p.add_argument("command", choices=["list-classes", "list-members", "references", "class-view", "recover", "class-source", "export"])
    p.add_argument("path")
    p.add_argument("--class", dest="owner")
    p.add_argument("--name")
    p.add_argument("--descriptor")
    p.add_argument("--literal")
    p.add_argument("--relation", default="mentions_symbol")
    p.add_argument("--consumer", action="append", default=[], choices=CONSUMERS)
    p.add_argument("--max-items", type=int, default=0)
    p.add_argument("--cursor")
    p.add_argument("--scope", help="a container id")
    p.add_argument("--budget", action="append", default=[], metavar="DIM=LIMIT")
    p.add_argument("--format", choices=["text", "json"], default="text")
    p.add_argument("--output")
    return p


def run(spark: SparkSession, args, out) -> int:
    limits = Limits()
    for item in args.budget:
        name, _, value = item.partition("=")
        if not value.isdigit():
            raise InvalidInput("bad_limit")
        limits = limits.override(**{name: int(value)})
    u = S.units(spark, args.path, limits=limits)
    if args.scope:
        u = u.where(F.col("container_id") == args.scope)
    u = u.persist()
    partial = not R.skipped(u).isEmpty()
    if args.command == "export":
        if not args.output:
            raise InvalidInput("output")
        print(*_lines(E.export(u, args.output), args.format), sep="\n", file=out)
        return int(partial)
    if args.command == "references":
        items, report = R.query(u, QueryRequest(args.relation if args.literal is None else "literal_value", _target(args), consumers=tuple(args.consumer),
                                               max_items=args.max_items, cursor=args.cursor), limits)
        order = [c for c in R.ORDER if c in items.columns]
        print(*_lines(items.orderBy(*order), args.format), *_lines(report, "json"), sep="\n", file=out)
        return int(report.first()["state"] != "complete_within_schema")
    if args.command == "list-classes":
        rows = S.classes(u).orderBy("path", "unit_seq")
    else:
        found = R.find_targets(u, args.owner or "")
        keys = [r["def_key"] for r in found.select("def_key").limit(2).collect()]
        if len(keys) != 1:
            print("ambiguous" if keys else "missing", file=out)
            return 3
        mine = u.where(F.col("def_key") == keys[0])
        rows = {"list-members": S.members, "class-view": S.instructions, "recover": M.recover, "class-source": lambda x: M.class_source(x, M.recover(x))}[args.command](mine)
    print(*_lines(rows, args.format), sep="\n", file=out)
    return int(partial)


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("factlane").getOrCreate()
    try:
        return run(spark, args, sys.stdout)
    except InvalidInput as e:
        print(e.code, file=sys.stderr)
        return 2
    except PySparkException as e:
        print(str(e).splitlines()[0], file=sys.stderr)
        return 4


if __name__ == "__main__":
    sys.exit(main())
