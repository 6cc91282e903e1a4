"""The command line: compile, validate and bundle schemas.

    python -m xsdframe compile schema.xsd ... -o OUT [--root NAME] [--datatypes string|structured]
                               [--include-libraries] [--allow-missing-imports] [--silent]
    python -m xsdframe validate data.xml --xsd schema.xsd [--root NAME] [-e typed|strict]
    python -m xsdframe bundle entry.xsd [-o OUT]
"""

from __future__ import annotations

import argparse
import json
import os
import sys

from .errors import XsdFrameError
from .sources.loader import bundle, expand, is_library, read_bytes
from .sources.xmltree import decode_xml


def _compile(args: argparse.Namespace) -> int:
    from .engine import compile, load_xsd

    files = expand(args.schemas)
    entries = files if args.include_libraries or len(files) == 1 else [f for f in files if not is_library(f)]
    schema = load_xsd(entries or files, args.allow_missing_imports)
    for d in schema.diagnostics:
        print(f"warning: {d.kind}: {d.message}", file=sys.stderr)
    made = {}
    for name in [args.root] if args.root else schema.elements:
        plan = compile(schema, name, args.datatypes)
        made[plan.root] = plan.spark_type().jsonValue()
    os.makedirs(args.out, exist_ok=True)
    base = args.name or os.path.splitext(os.path.basename(args.schemas[0].rstrip("/")))[0]
    path = os.path.join(args.out, f"{base}.schema.json")
    with open(f"{path}.part", "w", encoding="utf-8") as f:  # all or nothing
        json.dump(made, f, indent=1)
    os.replace(f"{path}.part", path)
    if not args.silent:
        print(path)
    return 0


def _validate(args: argparse.Namespace) -> int:
    from pyspark.sql import SparkSession

    from .engine import compile, load_xsd, safe_parse_xml
    from .operators.conform import violations
    from .sources.xmltree import parse_xml

    spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
    text = decode_xml(read_bytes(args.xml))
    if args.engine == "strict":
        found = violations(spark, text, args.xsd)
        for v in found:
            print(v, file=sys.stderr)
        return 1 if found else 0
    plan = compile(load_xsd(args.xsd), args.root or parse_xml(text).tag)
    row = safe_parse_xml(spark.createDataFrame([(text,)], "xml string"), "xml", plan).first()
    for i in row["_issues"]:
        print(f"{i.path}: {i.message}", file=sys.stderr)
    if not row["_issues"]:
        print(json.dumps(row["doc"].asDict(True) if hasattr(row["doc"], "asDict") else row["doc"], default=str, indent=1))
    return 1 if row["_issues"] else 0


def _bundle(args: argparse.Namespace) -> int:
    out = args.out or f"{os.path.splitext(args.entry)[0]}.bundled.xsd"
    text = bundle(args.entry)
    with open(out, "w", encoding="utf-8") as f:
        f.write(text)
    print(out)
    return 0


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="xsdframe")
    commands = parser.add_subparsers(dest="command", required=True)
    c = commands.add_parser("compile")
    c.add_argument("schemas", nargs="+")
    c.add_argument("-o", "--out", default=".")
    c.add_argument("-n", "--name")
    c.add_argument("--root")
    c.add_argument("--datatypes", choices=("string", "structured"), default="string")
    for flag in ("include-libraries", "allow-missing-imports", "silent"):
        c.add_argument(f"--{flag}", action="store_true")
    v = commands.add_parser("validate")
    v.add_argument("xml")
    v.add_argument("--xsd", required=True)
    v.add_argument("--root")
    v.add_argument("-e", "--engine", choices=("typed", "strict"), default="typed")
    b = commands.add_parser("bundle")
    b.add_argument("entry")
    b.add_argument("-o", "--out")
    args = parser.parse_args(argv)
    try:
        return {"compile": _compile, "validate": _validate, "bundle": _bundle}[args.command](args)
    except XsdFrameError as e:
        print(e.line(), file=sys.stderr)
    except OSError as e:
        print(f"unreadable: {e}", file=sys.stderr)
    return 1


if __name__ == "__main__":
    sys.exit(main())
