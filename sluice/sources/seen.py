"""Seen keys at scale: a table bucketed by key that only grows.

A seen key never changes, so a run adds the keys it saw first as a partition of its own
and rewrites nothing. The table's files are dealt over buckets by key: looking keys up
shuffles the keys alone (or broadcasts them, where they are few), never the state. A run
reads what runs before it added, by their numbers; so a run that is repeated sees the
same state and puts its partition in place of the first one.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import cut, release
from .files import _file_system

BUCKETS = 64


class SeenTable:
    """The seen keys below a folder; ``buckets`` is fixed when the folder is new and read from it afterwards."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        make, fs = _file_system(spark, self.path)
        qualified = fs.makeQualified(make(self.path))
        self.path, self._make, self._fs = qualified.toString(), make, fs
        kept = [x.getPath().getName() for x in fs.listStatus(qualified)] if fs.exists(qualified) else []
        fixed = [int(n.removeprefix("buckets-")) for n in kept if n.startswith("buckets-")]
        self.buckets = fixed[0] if fixed else buckets
        if not fixed:
            fs.create(make(f"{self.path}/buckets-{buckets}"), True).close()
        self._open()

    def _generations(self) -> list[int]:
        names = [x.getPath().getName() for x in self._fs.listStatus(self._make(self.path))]
        return sorted(int(n.removeprefix("generation-")) for n in names if n.startswith("generation-") and self._fs.exists(self._make(f"{self.path}/{n}/_whole")))

    def _declare(self, generation: int) -> str:
        """The catalog's entry for a generation's files (an entry of the session, if the catalog is one in memory)."""
        place = f"{self.path}/generation-{generation}"
        name = f"sluice_seen_{hashlib.sha256(place.encode()).hexdigest()[:16]}"
        self._fs.mkdirs(self._make(place))
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {name} (key STRING, first_seen_at STRING, batch BIGINT) USING parquet PARTITIONED BY (batch) CLUSTERED BY (key) INTO {self.buckets} BUCKETS LOCATION '{place}'")
        self.spark.sql(f"MSCK REPAIR TABLE {name}")
        return name

    def _open(self) -> None:
        self.generation = (self._generations() or [0])[-1]
        self.name = self._declare(self.generation)
        if not self._fs.exists(self._make(f"{self.path}/generation-{self.generation}/_whole")):
            self._fs.create(self._make(f"{self.path}/generation-{self.generation}/_whole"), True).close()

    def keys(self, below: int | None = None) -> DataFrame:
        """key and first_seen_at of all runs, or of those before one."""
        rows = self.spark.table(self.name)
        return (rows if below is None else rows.where(F.col("batch") < below)).select("key", "first_seen_at")

    def known(self, keys: DataFrame, below: int | None = None) -> DataFrame:
        """Those of ``keys`` (key) that were seen: the state is read in its buckets and meets the keys there."""
        return self.keys(below).join(keys.select("key").distinct(), "key", "left_semi")

    def add(self, keys: DataFrame, now: str, batch: int) -> None:
        """Add the keys that no run before ``batch`` saw, with ``now``; a second call for a batch takes the first one's place."""
        asked = keys.select("key").where("key IS NOT NULL").distinct()
        fresh = asked.join(self.known(asked, batch).select("key"), "key", "left_anti")
        # A partition of the table can't be written from a read of the table.
        kept = cut(fresh.select("key", F.lit(now).alias("first_seen_at")), "fresh-keys")
        self._insert(self.name, kept, batch)
        release(kept)

    def _insert(self, name: str, rows: DataFrame, batch: int) -> None:
        # Dealt as the table's buckets are, so that each bucket is one file.
        rows.repartition(self.buckets, "key").createOrReplaceTempView("sluice_fresh_keys")
        self.spark.sql(f"INSERT OVERWRITE TABLE {name} PARTITION (batch = {int(batch)}) SELECT key, first_seen_at FROM sluice_fresh_keys")

    def compact(self) -> None:
        """Fold all partitions into the last one's number, in a new generation that counts once it is whole; the one before it goes."""
        last = self.spark.table(self.name).agg(F.max("batch")).first()[0]
        if last is None:
            return
        new = self.generation + 1
        place = self._make(f"{self.path}/generation-{new}")
        self._fs.delete(place, True)  # an attempt that was cut short
        name = self._declare(new)
        self._insert(name, self.keys(), last)
        self._fs.create(self._make(f"{self.path}/generation-{new}/_whole"), True).close()
        old, self.generation, self.name = (self.name, self.generation), new, name
        self.spark.sql(f"DROP TABLE IF EXISTS {old[0]}")
        self._fs.delete(self._make(f"{self.path}/generation-{old[1]}"), True)


def mark_new(rows: DataFrame, state: SeenTable, below: int | None = None) -> DataFrame:
    """``new`` where portal:id was not seen before; a null id is never new. The state is not shuffled."""
    keyed = rows.drop("new").withColumn("_key", F.when(F.col("id").isNotNull(), F.concat_ws(":", "portal", "id")))
    hits = state.known(keyed.where("_key IS NOT NULL").select(F.col("_key").alias("key")), below)
    told = keyed.join(hits.select(F.col("key").alias("_key"), F.lit(True).alias("_seen")).distinct(), "_key", "left")
    return told.withColumn("new", F.col("_key").isNotNull() & F.col("_seen").isNull()).drop("_key", "_seen")
