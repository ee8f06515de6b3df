"""Run settings, read from YAML with the documented keys and defaults."""

from __future__ import annotations

from dataclasses import dataclass, field, fields
from pathlib import Path

import yaml


@dataclass(frozen=True)
class Inputs:
    home_csv_dir: str = "data/load/"
    substation_csv: str = "data/substations.csv"


@dataclass(frozen=True)
class Misc:
    log_dir: str = "logs/"
    intermediate_dir: str = "out/interim/"
    mapping_dir: str = "out/mapping/"
    #: Degrees; the first padding of the home-to-road search.
    padding: float = 0.001


@dataclass(frozen=True)
class Secondary:
    separation: float = 50.0
    penalty: float = 0.5
    max_rating: float = 25_000.0
    max_hops: int = 10
    #: ``None`` joins every home with every transformer site of its road.
    nearest_homes: int | None = None


@dataclass(frozen=True)
class Primary:
    voltage_max: float = 1.05
    voltage_min: float = 0.90
    maximum_voltage_drop: float = 0.15
    conductor_resistance_per_km: float = 0.8625
    base_impedance: float = 39_690.0
    maximum_branch_flow: float = 400.0
    max_feeder_number: int = 10
    max_feeder_capacity: float = 400.0


@dataclass(frozen=True)
class Outputs:
    secnet: str = "out/secnet/"
    primnet: str = "out/primnet/"
    figures: str = "figs"


@dataclass(frozen=True)
class Config:
    state: int = 51
    region: int = 999
    inputs: Inputs = field(default_factory=Inputs)
    miscellaneous: Misc = field(default_factory=Misc)
    secnet: Secondary = field(default_factory=Secondary)
    primnet: Primary = field(default_factory=Primary)
    outputs: Outputs = field(default_factory=Outputs)
    #: Cells of at most this many nodes lose their substation.
    min_cell_nodes: int = 100


def _known(kind: type, values: dict) -> dict:
    return {f.name: values[f.name] for f in fields(kind) if f.name in values}


def load_config(path: str) -> Config:
    """Settings of a YAML file; keys that nothing uses (solver options, figures) are left aside."""
    raw = yaml.safe_load(Path(path).read_text()) or {}
    made = {k: (raw.get(k) or {}).get("out_dir") for k in ("secnet", "primnet")} | {"figures": (raw.get("figures") or {}).get("directory")}
    return Config(
        outputs=Outputs(**{k: v for k, v in made.items() if v}),
        **_known(Config, {k: v for k, v in raw.items() if not isinstance(v, dict)}),
        inputs=Inputs(**_known(Inputs, raw.get("inputs", {}))),
        miscellaneous=Misc(**_known(Misc, raw.get("miscellaneous", {}))),
        secnet=Secondary(**_known(Secondary, (raw.get("secnet") or {}).get("secnet_args", {}))),
        primnet=Primary(**_known(Primary, (raw.get("primnet") or {}).get("primnet_args", {}))),
    )


def transformer_base(state: int, region: int) -> int:
    """First transformer number of a region: state and region, then twelve digits from zero."""
    return int(f"{state}{region}{0:012d}")
