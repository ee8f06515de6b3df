"""Command line: ``python -m voltweave -c config.yaml -r region [-p]`` builds a region's network from files."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .config import load_config
from .plans.files import build


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="voltweave", description="Build the synthetic distribution network of a region.")
    parser.add_argument("-c", "--configPath", default="configs/config.yaml", help="YAML settings")
    parser.add_argument("-r", "--region", default="999", help="region whose files are read and written")
    parser.add_argument("-p", "--generate_plot", action="store_true", help="also write the layers that maps of the network draw")
    given = parser.parse_args(args)
    build(SparkSession.builder.appName("voltweave").getOrCreate(), load_config(given.configPath), given.region, given.generate_plot)


if __name__ == "__main__":
    main()
