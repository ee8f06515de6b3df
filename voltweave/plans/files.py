"""The whole job over files: inputs, intermediate and final files of a region under the folders of the settings."""

from __future__ import annotations

import logging
import time
from dataclasses import dataclass, replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..operators import final
from ..sources import readers, writers
from . import network


@dataclass(frozen=True)
class Paths:
    """Names of a region's files."""

    config: Config
    region: str

    @property
    def homes(self) -> str:
        return f"{self.config.inputs.home_csv_dir}{self.region}-home-load.csv"

    def interim(self, name: str) -> str:
        return f"{self.config.miscellaneous.intermediate_dir}{self.region}_{name}"

    def mapping(self) -> str:
        return f"{self.config.miscellaneous.mapping_dir}{self.region}_map_h2r.txt"

    def secnet(self, name: str) -> str:
        return f"{self.config.outputs.secnet}{self.region}_{name}"

    def primnet(self, name: str) -> str:
        return f"{self.config.outputs.primnet}{self.region}_{name}"

    def log(self) -> str:
        return f"{self.config.miscellaneous.log_dir}application_{self.region}.log"


def open_log(path: str) -> logging.Logger:
    """A logger that appends to ``path`` after a line that sets runs apart."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    logger = logging.getLogger("voltweave")
    logger.setLevel(logging.INFO)
    for old in list(logger.handlers):
        logger.removeHandler(old)
        old.close()
    handler = logging.FileHandler(path)
    handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(name)s: %(message)s"))
    logger.addHandler(handler)
    logger.info("=== run started ===")
    return logger


def build(spark: SparkSession, config: Config, region: str, layers: bool = False) -> dict[str, DataFrame]:
    """Read a region's homes, substations and road files, run all stages and write their files; returns the tables.

    The road files must exist; they are not fetched.
    """
    config = replace(config, region=int(region)) if region.isdigit() else config
    at = Paths(config, region)
    log = open_log(at.log())
    began = time.time()
    own = lambda df: df.withColumn("region", F.lit(region))
    homes = readers.load_homes(spark, at.homes)
    substations = readers.load_substations(spark, config.inputs.substation_csv, homes)
    nodes, edges = readers.load_roads(spark, at.interim("road_edges.csv"), at.interim("road_nodes.csv"))
    x = network.Inputs(own(homes), own(substations), own(nodes), own(edges))
    out = network.run(x, config, network.Store(spark))
    log.info("all stages done in %.1f s", time.time() - began)
    for name in ("failures", "final_unserved"):
        log.info("%s: %d", name, out[name].count())
    for r in out["primary_state"].where("status = 'infeasible'").select("sub_id").distinct().collect():
        log.info("substation %s has a community without a network", r.sub_id)
    served = out["part_nodes"].select("sub_id").distinct()
    for r in x.substations.join(served, "sub_id", "left_anti").select("sub_id").collect():
        log.info("no nodes mapped to substation %s", r.sub_id)
    writers.write_mapping(out["mapping"], homes, at.mapping())
    writers.write_secondary(out["transformers"], out["secondary"], at.secnet("transformers.csv"), at.secnet("secnet_edges.csv"))
    writers.write_sequences(out["sequences"], at.secnet("road_sequences.txt"))
    writers.write_network(out["network_nodes"], out["network_edges"], at.secnet("combined_network_nodes.csv"), at.secnet("combined_network_edges.csv"))
    writers.write_partitions(out["part_nodes"], out["part_edges"], at.interim("transformer_assignment.json"))
    writers.write_primary(out["primary_nodes"], out["primary_edges"], at.primnet("nodes.csv"), at.primnet("edges.csv"))
    writers.write_final(out["final_nodes"], out["final_edges"], at.primnet("final_nodes.csv"), at.primnet("final_edges.csv"))
    if layers:
        for name, table in final.layers(out["final_nodes"], out["final_edges"]).items():
            table.write.mode("overwrite").parquet(f"{config.outputs.figures}/{region}_{name}")
    log.info("files written after %.1f s", time.time() - began)
    return out
