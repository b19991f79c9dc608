"""What the jobs' command lines share: a configuration file, a session, a log."""

from __future__ import annotations

import argparse
import json
import logging
import sys
from collections.abc import Callable
from dataclasses import fields
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession

from voxloom.session import ConfigError, session

C = TypeVar("C")


def read(spark: SparkSession, path: str, kind: type[C], over: dict) -> C:
    """The configuration of a JSON file, read by Spark as it may be remote; ``over`` goes before it."""
    given = json.loads(spark.read.text(path, wholetext=True).first()[0]) if path else {}
    given |= {k: v for k, v in over.items() if v is not None}
    unknown = set(given) - {f.name for f in fields(kind)}
    if unknown:
        raise ConfigError(f"unknown settings: {', '.join(sorted(unknown))}")
    return kind(**{k: tuple(v) if isinstance(v, list) else v for k, v in given.items()})


def main(name: str, kind: type[C], run: Callable[[SparkSession, C], DataFrame], doc: str, args: list[str] | None = None) -> int:
    """Run a job from the command line; paths given there replace those of the file."""
    parser = argparse.ArgumentParser(prog=f"python -m jobs.{name}", description=doc)
    parser.add_argument("--config", help="JSON file of settings")
    for f in fields(kind):
        if f.type == "str" and f.name in ("parts", "output", "checkpoint"):
            parser.add_argument(f"--{f.name}")
    given = vars(parser.parse_args(args))
    logging.basicConfig(stream=sys.stderr, level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    logging.getLogger("py4j").setLevel(logging.WARNING)
    spark = session(name)
    try:
        run(spark, read(spark, given.pop("config"), kind, given))
    except ConfigError as why:
        print(why, file=sys.stderr)
        return 2
    finally:
        spark.stop()
    return 0
