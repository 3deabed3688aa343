"""The pipeline from the command line: ``python -m yakamoz --root FOLDER [--step NAME] [--input JSON] [--interactive]``."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Callable
from typing import Any

from pyspark.sql import SparkSession

from yakamoz.operators.requests import parse_input, request_of_flags
from yakamoz.plans.pipeline import STEPS, Context, run


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="yakamoz", description="run the pipeline, or one step of it, over the tables of a folder")
    p.add_argument("--root", required=True, help="folder of the tables, a path or a URI")
    p.add_argument("--step", choices=[*STEPS], help="this step only")
    p.add_argument("--input", help="what is asked for: JSON, or a loosely written object")
    p.add_argument("--interactive", action="store_true", help="ask which step to run")
    flags = p.add_argument_group("a request, without --input")
    flags.add_argument("--level", choices=("auto", "province", "district"))
    for name in ("province", "district", "category"):
        flags.add_argument(f"--{name}")
    for name in ("num-results", "max-topics"):
        flags.add_argument(f"--{name}", type=int)
    flags.add_argument("--confirm-bulk", action="store_true")
    return p


def choose(ask: Callable[[str], str] = input) -> str | None:
    """A step by its number in a menu; None for all."""
    names = [None, *STEPS]
    for i, name in enumerate(names, 1):
        print(f"  {i}. {name or 'all steps'}")
    while True:
        got = ask(f"choice [1-{len(names)}]: ").strip()
        if got.isdigit() and 1 <= int(got) <= len(names):
            return names[int(got) - 1]


def asked(args: argparse.Namespace) -> Any:
    """The input of the run; text that is no request stays text, nothing given is None."""
    if args.input is not None:
        try:
            return parse_input(args.input)
        except ValueError:
            return args.input
    names = ("level", "province", "district", "category", "num_results", "max_topics", "confirm_bulk")
    return request_of_flags(**{n: getattr(args, n) for n in names}) or None


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    step = choose() if args.interactive and args.step is None else args.step
    spark = spark or SparkSession.builder.appName("yakamoz").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    out = run(Context(spark, args.root), [step] if step else None, data=asked(args))
    print(json.dumps(out, indent=2, ensure_ascii=False, default=str))
    return 0


if __name__ == "__main__":
    sys.exit(main())
