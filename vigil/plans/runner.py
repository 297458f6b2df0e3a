"""Environments, SQL scripts, the registry of upstream systems, structured logs, and jobs as graphs of tasks."""

from __future__ import annotations

import json
import logging
import re
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from graphlib import TopologicalSorter
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# Environments and their catalogs.
CATALOGS = {"dev": "risk_dev", "test": "risk_test", "prod_sim": "risk_prod_sim"}
LAYERS = ("bronze", "silver", "gold")


@dataclass(frozen=True)
class Environment:
    name: str

    def __post_init__(self) -> None:
        if self.name not in CATALOGS:
            raise ValueError(f"unknown environment {self.name!r}: one of {sorted(CATALOGS)}")

    @property
    def catalog(self) -> str:
        return CATALOGS[self.name]

    def table(self, layer: str, name: str) -> str:
        if layer not in LAYERS:
            raise ValueError(f"unknown layer {layer!r}")
        return f"{self.catalog}.{layer}.{name}"


def statements(script: str, values: dict[str, str]) -> list[str]:
    """The statements of a script (each ends in a semicolon and a blank line), with {key} or {{key}} filled in."""
    for key, value in values.items():
        script = script.replace("{{" + key + "}}", value).replace("{" + key + "}", value)
    parts = (re.sub(r"(?m)^\s*--.*$", "", p).strip().rstrip(";").strip() for p in re.split(r";[ \t]*\n\s*\n|;\s*$", script))
    return [p for p in parts if p]


def run_script(spark: SparkSession, script: str, values: dict[str, str]) -> list[DataFrame]:
    return [spark.sql(s) for s in statements(script, values)]


def upstream(path: str, pipeline: str) -> dict[str, str]:
    """A pipeline's owner and contact from a JSON registry, or the default record."""
    unknown = {"system": "unknown", "owner": "unassigned", "contact": "unassigned"}
    registry = json.loads(Path(path).read_text()) if Path(path).exists() else {}
    return unknown | registry.get(pipeline, registry.get("default", {}))


def log_event(event: str, **fields) -> str:
    """One JSON line; also returned."""
    line = json.dumps({"event": event, **fields}, sort_keys=True, default=str)
    logging.getLogger("vigil").info(line)
    return line


# The jobs: which tasks each task waits for. The month-end chain rebuilds everything it publishes.
JOBS: dict[str, dict[str, tuple[str, ...]]] = {
    "bronze": {"sdn": (), "targets": (), "accounts": (), "graph": ()},
    "silver": {"entities": (), "transactions": (), "graph_risk": (), "matches": ("entities",), "network_reference": ("graph_risk",)},
    "streaming": {"producer": (), "ingest": ("producer",)},
    "month_end": {"entities": (), "transactions": (), "graph_risk": (), "matches": ("entities",), "network_reference": ("graph_risk",), "gold": ("matches", "transactions", "network_reference"), "gate": ("gold",), "publish": ("gate",)},
    "replay": {"replay": ()},
    "maintenance": {"maintain": ()},
}


def run_job(graph: dict[str, tuple[str, ...]], tasks: dict[str, Callable[[], object]], workers: int = 4) -> list[str]:
    """Run tasks as soon as those they wait for are done; the order of their ends. A failure stops what depends on it."""
    order, done = TopologicalSorter(graph), []
    order.prepare()
    with ThreadPoolExecutor(workers) as pool:
        running = {}
        while order.is_active():
            for name in order.get_ready():
                running[pool.submit(tasks[name])] = name
            finished = next((f for f in running if f.done()), None) or next(iter(running))
            name = running.pop(finished)
            finished.result()
            order.done(name)
            done.append(name)
    return done
