"""The running cycle: a scan's signals are stored, strong ones traded, the balance moves on, all in one commit.

A cycle writes its opportunities, trades and settings as folders of its batch and then one
manifest that names them. Readers see the batches that have a manifest, whole or not at all.
A batch that failed is written again and replaces what it left; one that is committed is
not run again, so a stream may hand over a batch twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.functions import vocabulary as V
from marlstone.operators import ledger, markets
from marlstone.plans import scans
from marlstone.sources import schemas, scratch
from marlstone.sources.manifests import Conflict, Manifests

TRADES = "batch long, ord long, market_id string, direction string, price double, size double"
TABLES = {"opportunities": schemas.OPPORTUNITIES, "trades": TRADES, "settings": schemas.SETTINGS}


class Store:
    """Tables that grow by batches which are committed together."""

    def __init__(self, spark: SparkSession, path: str, tables: dict[str, str] = TABLES):
        self.spark, self.path, self.tables = spark, path.rstrip("/"), tables
        self.commits = Manifests(spark, f"{self.path}/commits")

    def schema(self, name: str) -> T.StructType:
        return T.StructType.fromDDL(self.tables[name])

    def read(self, name: str, before: int | None = None) -> DataFrame:
        """The table's rows of all committed batches (below ``before``)."""
        numbers = [n for n in self.commits.numbers() if before is None or n < before]
        folders = [f"{self.path}/{name}/{n}" for n in numbers if name in self.commits.read(n)]
        return self.spark.read.schema(self.schema(name)).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema(name))

    def commit(self, batch: int, tables: dict[str, DataFrame]) -> bool:
        """Add the batch; False where it is there already, which changes nothing."""
        if batch in self.commits.numbers():
            return False
        for name, rows in tables.items():
            rows.select(*self.schema(name).names).write.mode("overwrite").parquet(f"{self.path}/{name}/{batch}")
        try:
            self.commits.commit(batch, sorted(tables))
        except Conflict:
            return False
        return True

    def settings(self, before: int | None = None) -> dict[str, str]:
        """The settings' values, a few keys: the defaults, then each batch's changes."""
        found = dict(V.SETTINGS)
        for n in self.commits.numbers():
            if (before is None or n < before) and "settings" in self.commits.read(n):
                found |= {r["key"]: r["value"] for r in self.spark.read.schema(self.schema("settings")).parquet(f"{self.path}/settings/{n}").collect()}
        return found


def run(store: Store, batch: int, signals: DataFrame, as_of) -> bool:
    """One cycle over ``signals``, which have ord, market_id, direction, market_prob and net_edge; False where the batch was run before.

    Opportunities whose id is stored already are left out. At most three signals are traded;
    their sizes follow from the balance that the cycle begins with. The scan that gives the
    signals runs once: they are a table before they are stored and traded.
    """
    if batch in store.commits.numbers():
        return False
    settings = store.settings(batch)
    balance = float(settings.get("paper_balance") or 0)
    signals = scratch.table(signals, "signals")
    fresh = scratch.table(scans.stored(signals, as_of).dropDuplicates(["id"]), "opportunities")
    fresh = markets.unseen_of_many(fresh, store.read("opportunities", batch), ["id"])
    on = lambda key: settings.get(key) == "true"
    placed = ledger.intents(signals, balance, float(settings.get("max_position") or 50), float(settings.get("min_edge") or 1.5), on("paper_enabled"), on("scan_active"))
    rows = placed.collect()  # three at most
    for r in rows:
        balance = round(balance - min(r["size"], balance) + 1e-9, 2)
    trades = store.spark.createDataFrame([(batch, r["ord"], str(r["market_id"]), r["direction"], r["price"], r["size"]) for r in rows], TRADES)
    changed = store.spark.createDataFrame([("paper_balance", repr(balance))], schemas.SETTINGS)
    return store.commit(batch, {"opportunities": fresh, "trades": trades, "settings": changed})
