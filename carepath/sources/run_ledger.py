"""A ledger of the runs of a grid: each run is stored when it ends, and a grid that was ended goes on with the runs that are open.

A run has a key, the hash of its configuration. Its record is a small table in a folder of that name, written over if the run is
made again, so a run is there once however often a driver or a write was lost. Planned runs are compared with stored ones by an anti-join.
Compaction puts the folders of single runs into one table; a reader that meets a run in both takes one.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carepath.session import scratch

SCHEMA = "run_key string, config string, record string"


def canonical(config: dict) -> str:
    """A configuration as text that does not depend on the order of its fields."""
    return json.dumps(config, sort_keys=True, default=str)


def run_key(config: dict) -> str:
    return hashlib.sha256(canonical(config).encode()).hexdigest()[:32]


class RunLedger:
    """Runs in a folder of any file system Spark reads."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _children(self, name: str) -> list[str]:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        system = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return [s.getPath().toString() for s in system.listStatus(path)] if system.exists(path) else []

    def _whole(self, name: str) -> list[str]:
        """Folders whose write has come to its end."""
        jvm, configuration = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        marks = [(f, jvm.org.apache.hadoop.fs.Path(f"{f}/_SUCCESS")) for f in self._children(name)]
        return [f for f, mark in marks if mark.getFileSystem(configuration).exists(mark)]

    def append(self, config: dict, record: dict) -> None:
        """Store the record of a run; one that is there under the same configuration is replaced."""
        key = run_key(config)
        kept = {name: value for name, value in record.items() if value is not None}
        row = self.spark.createDataFrame([(key, canonical(config), json.dumps(kept, default=str))], SCHEMA)
        row.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/single/{key}")

    def stored(self) -> DataFrame:
        """``run_key, config, record``, one row per run; a single run is newer than a compacted one of its key."""
        single, compacted = self._whole("single"), self._whole("compacted")
        parts = [(1, folders) for folders in [single] if folders] + [(0, folders) for folders in [compacted] if folders]
        if not parts:
            return self.spark.createDataFrame([], SCHEMA)
        found = None
        for newer, folders in parts:
            rows = self.spark.read.schema(SCHEMA).parquet(*folders).withColumn("_newer", F.lit(newer))
            found = rows if found is None else found.unionByName(rows)
        newest = F.max_by(F.struct("config", "record"), F.struct("_newer", "record")).alias("r")
        return found.groupBy("run_key").agg(newest).select("run_key", "r.config", "r.record")

    def open_runs(self, planned: list[dict]) -> list[int]:
        """Positions of the planned runs that are not stored yet, each configuration once."""
        rows = [(i, run_key(config)) for i, config in enumerate(planned)]
        table = self.spark.createDataFrame(rows, "position int, run_key string")
        missing = table.join(self.stored().select("run_key"), "run_key", "left_anti")
        return sorted(r[0] for r in missing.groupBy("run_key").agg(F.min("position")).select("min(position)").collect())

    def run(self, planned: list[dict], make: Callable[[dict], dict]) -> list[dict]:
        """The records of all planned runs in their order; only the open ones are made."""
        for position in self.open_runs(planned):
            self.append(planned[position], make(planned[position]))
        keys = [run_key(config) for config in planned]
        wanted = self.spark.createDataFrame([(k,) for k in dict.fromkeys(keys)], "run_key string")
        found = {r["run_key"]: json.loads(r["record"]) for r in self.stored().join(wanted, "run_key", "left_semi").collect()}
        return [found[key] for key in keys]

    def records(self) -> DataFrame:
        """All stored runs with the fields of their records as columns, missing ones null, and ``run_key``."""
        stored = self.stored()
        lines = stored.select(F.concat(F.lit('{"run_key":"'), "run_key", F.lit('",'), F.substring("record", 2, 2**31 - 1)).alias("value"))
        empty = lines.withColumn("value", F.regexp_replace("value", r',\}$', "}"))
        texts = scratch(self.spark, "records")
        empty.write.text(texts)
        return self.spark.read.json(texts)

    def compact(self) -> None:
        """Put all runs into one table, then delete what it was made from; a stop in between leaves every run readable."""
        old = [*self._whole("single"), *self._whole("compacted")]
        if not old:
            return
        self.stored().coalesce(1).write.parquet(f"{self.folder}/compacted/{uuid.uuid4().hex}")
        for folder in old:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
