"""Commands: convert, aggregate, load and dump tables of typed values.

    python -m millrace.cli converter --schema '(i32;float;string)' --input-enc s-expr --output-enc s-expr \\
        -e '/0:(fun ("i32") (add (i32 1) (param 0)))' -i in.txt -o out
"""

from __future__ import annotations

import argparse
import importlib
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import keyvalue
from .operators.aggregate import aggregate
from .operators.convert import transform
from .operators.masks import select
from .operators.rows import where
from .plans.compile import EXTERNALS
from .plans.types import parse
from .sources import base


def _options(text: list[str]) -> dict:
    out: dict = {}
    for x in text:
        name, _, value = x.partition("=")
        out[name.replace("-", "_")] = {"true": True, "false": False, "none": None}.get(value.lower(), value.encode().decode("unicode_escape"))
    return out


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="millrace")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("converter", "aggregator", "load", "dump", "query"):
        c = sub.add_parser(name)
        c.add_argument("-i", "--input", required=True)
        c.add_argument("-o", "--output")
        c.add_argument("--input-enc", default="s-expr")
        c.add_argument("--output-enc", default="s-expr")
        c.add_argument("--in-option", action="append", default=[])
        c.add_argument("--out-option", action="append", default=[])
        c.add_argument("-d", "--delimiter", default=None)
        if name in ("converter", "aggregator"):
            c.add_argument("--schema", required=True)
            c.add_argument("-x", "--external", action="append", default=[], help="name=module:function, for ext-identifier")
            c.add_argument("-w", "--where", default="", help="a predicate: a function of the row")
        else:
            c.add_argument("--key-schema", required=True)
            c.add_argument("--value-schema", required=True)
            c.add_argument("-k", "--kv-delim", default="\n")
    sub.choices["converter"].add_argument("-e", "--expression", action="append", default=[])
    sub.choices["converter"].add_argument("--mask", default="")
    for x in ("init", "update", "finalize"):
        sub.choices["aggregator"].add_argument(f"--{x}", required=True)
    sub.choices["aggregator"].add_argument("--order", default=None)
    sub.choices["query"].add_argument("--key", required=True)
    return p


def run(spark: SparkSession, args: list[str]) -> list[str] | None:
    """Run a command; without an output the lines are returned."""
    a = parser().parse_args(args)
    inner, outer = _options(a.in_option), _options(a.out_option)
    if a.command == "load":
        df = keyvalue.load(spark, a.input, a.key_schema, a.value_schema, a.kv_delim, a.delimiter or "\n", a.input_enc, **inner)
        df.write.mode("overwrite").parquet(a.output)
        return None
    if a.command in ("dump", "query"):
        df = spark.read.parquet(a.input)
        if a.command == "query":
            df = keyvalue.query(df, a.key_schema, base.codec(a.input_enc, a.key_schema, **inner).one(a.key.encode()))
        return _lines(keyvalue.dump(df, a.key_schema, a.value_schema, a.kv_delim, a.output_enc, **outer), "entry", a.output)
    for x in a.external:
        name, _, place = x.partition("=")
        module, _, attribute = place.partition(":")
        EXTERNALS[name] = getattr(importlib.import_module(module), attribute) if attribute else importlib.import_module(module)
    m = parse(a.schema)
    placed = "_at" if a.command == "aggregator" and a.order is None else None
    df = base.read(spark, a.input, a.input_enc, m, a.delimiter, placed, **inner)
    if a.where:
        df = where(df, m, a.where)
    if a.command == "aggregator":
        df, m = aggregate(df, m, a.init, a.update, a.finalize, order=a.order or "_at")
        made = base.codec(a.output_enc, m, **outer)
        return _lines(df.select(F.decode(base.encode_column(F.col("value"), made), "utf-8").alias("line")), "line", a.output)
    if a.expression:
        df, m = transform(df, m, dict(x.split(":", 1) for x in a.expression))
    if a.mask:
        df, m = select(df, m, a.mask)
    if a.output:
        base.write(df, a.output, a.output_enc, m, **outer)
        return None
    made = base.codec(a.output_enc, m, **outer)
    return _lines(df.select(F.decode(base.encode_column(base.packed(df, m), made), "utf-8").alias("line")), "line", None)


def _lines(df, column: str, output: str | None) -> list[str] | None:
    if output:
        df.select(F.col(column).alias("value")).write.mode("overwrite").text(output)
        return None
    return [r[0] for r in df.select(column).toLocalIterator()]


def main() -> None:
    spark = SparkSession.builder.appName("millrace").getOrCreate()
    for line in run(spark, sys.argv[1:]) or []:
        print(line)


if __name__ == "__main__":
    main()
