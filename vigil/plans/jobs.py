"""The jobs' tasks, bound to the engine: each reads what its predecessors wrote to the store and writes its own table."""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.operators import entities, graph, identity, matching, ops, scoring
from vigil.plans import runner
from vigil.plans import tables as t
from vigil.sources.store import TableStore
from vigil.streaming import ingest


def people(accounts: DataFrame, watchlist: DataFrame, share: float = 0.02) -> DataFrame:
    """Account holders as candidates of a screening."""
    drawn = identity.assign(accounts, watchlist, share)
    return drawn.select(F.col("account_id").alias("candidate_id"), F.col("synthetic_holder_name").alias("name"), F.col("synthetic_country").alias("country"), F.col("synthetic_dob").alias("dob"))


def screened(accounts: DataFrame, watchlist: DataFrame, share: float = 0.02) -> DataFrame:
    """account_id, entity_id, match_confidence_band: what screening finds, as scores take it."""
    return matching.screen(people(accounts, watchlist, share), watchlist).select(F.col("candidate_id").alias("account_id"), "entity_id", "match_confidence_band")


def as_watchlist(unified: DataFrame) -> DataFrame:
    return unified.where("is_watchlist").select("entity_id", F.col("primary_name").alias("name"), F.lit(None).cast("array<string>").alias("aliases"), F.get("countries", F.lit(0)).alias("country"), F.col("birth_date").alias("dob"))


def tasks(spark: SparkSession, sf_dir: str, store: TableStore, now: datetime.datetime) -> dict[str, Callable[[], object]]:
    """Every task that JOBS names."""
    put = lambda name, make: lambda: store.overwrite(make(), name)
    got = store.read

    def gate() -> dict[str, int]:
        return ops.reconcile(got("accounts") if store.exists("accounts") else t.accounts(spark, sf_dir), got("profiles"), got("alerts"))

    def gold() -> None:
        rows = scoring.profile(t.accounts(spark, sf_dir), got("transactions"), got("matches"), got("network_reference"), t.STAND_IN_RULES)
        store.overwrite(rows, "profiles", cluster_by=("account_id",))
        store.overwrite(scoring.alert_queue(got("profiles"), t.STAND_IN_RULES["alert_min_score"]), "alerts")

    def publish() -> None:
        n = got("profiles").count()
        row = ops.control_row("gold_month_end_publish", "month_end", "profiles", f"publish-{now:%Y%m%d%H%M%S}", n, n, 0, 0.0, 0.0, "gold", {}, now)
        store.append(spark.createDataFrame([row], ops.CONTROL_SCHEMA), "ops_control")

    return {
        "sdn": put("sdn", lambda: t.sdn(spark, sf_dir)),
        "targets": put("targets", lambda: t.targets(spark, sf_dir)),
        "accounts": put("accounts", lambda: t.accounts(spark, sf_dir)),
        "graph": put("edges", lambda: t.edges(spark, sf_dir)),
        "entities": put("entities", lambda: entities.unify(t.sdn(spark, sf_dir), t.targets(spark, sf_dir), entities.type_map(spark))),
        "transactions": put("transactions", lambda: t.transactions(spark, sf_dir)),
        "graph_risk": put("node_risk", lambda: graph.node_risk(t.classes(spark, sf_dir), t.edges(spark, sf_dir))),
        "matches": put("matches", lambda: screened(t.accounts(spark, sf_dir), as_watchlist(got("entities")))),
        "network_reference": put("network_reference", lambda: graph.network_reference(t.accounts(spark, sf_dir), got("node_risk"))),
        "gold": gold,
        "gate": gate,
        "publish": publish,
        "producer": lambda: ingest.feed(t.raw_rows(spark, sf_dir).select(*ingest.KEYS), f"{store.root}/in", 4000),
        "ingest": lambda: ingest.run(spark, f"{store.root}/in", store, f"{store.root}/checkpoint"),
        "replay": lambda: ingest.replay(store),
        "maintain": lambda: store.maintain(["entities", "transactions", "profiles", "alerts", "txn_events"]),
    }


def run(job: str, spark: SparkSession, sf_dir: str, store: TableStore, now: datetime.datetime | None = None, workers: int = 4) -> list[str]:
    """Run a job by name; the order in which its tasks ended."""
    bound = tasks(spark, sf_dir, store, now or datetime.datetime.now())
    return runner.run_job(runner.JOBS[job], {name: bound[name] for name in runner.JOBS[job]}, workers)
