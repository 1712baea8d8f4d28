"""The command line: ``python -m depgraph.cli [options] <target> [path]``."""

from __future__ import annotations

import sys
from collections.abc import Sequence

from pyspark.sql import SparkSession

from depgraph.config import Config, ConfigError, load
from depgraph.model import Graph
from depgraph.registry import ANALYZERS, REPORTERS

OK, FAILURE, INVALID = 0, 1, 2


def analyse(spark: SparkSession, config: Config) -> Graph:
    """The graph that the analyser of the settings' type makes of the base path."""
    options = {"php": {"includes": config.includes, "excludes": config.excludes}, "debug": config.debug}.get(config.type, {})
    return ANALYZERS.find(config.type)(spark, config.base_path, **options)


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    try:
        config, target, args = load(sys.argv[1:] if argv is None else argv)
    except ConfigError as e:
        print(e, file=sys.stderr)
        return INVALID
    if spark is None:
        builder = SparkSession.builder.appName("depgraph").config("spark.ui.showConsoleProgress", "false")
        if hasattr(args, "memory_limit"):
            builder = builder.config("spark.driver.memory", args.memory_limit)
        spark = builder.getOrCreate()
    try:
        reporter = REPORTERS.find(getattr(args, "format", "tree"))
        for row in reporter(analyse(spark, config), target, config.direction, config.level).select("line").toLocalIterator():
            print(row.line)
    except LookupError as e:  # no such target or reporter
        print(e, file=sys.stderr)
        return FAILURE
    return OK


if __name__ == "__main__":
    sys.exit(main())
