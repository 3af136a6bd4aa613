"""Engine settings and how they map onto Spark's."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields

from pyspark.sql import SparkSession

from marlstone.errors import InvalidConfigError

INFERENCE, DRIFT = ("off", "on", "strict", "permissive"), ("fail", "refresh")


@dataclass
class EngineConfig:
    """Each ``MARLSTONE_<FIELD>`` in the environment overrides the field of that name."""

    batch_size_rows: int = 8192
    shuffle_partitions: int | None = None  # None: the session's own
    broadcast_threshold_bytes: int = 64 << 20
    catalog_path: str | None = None
    managed_dir: str | None = None  # of saved tables; None: beside the catalog file, or in the warehouse
    schema_inference: str = "on"
    schema_drift: str = "refresh"
    schema_writeback: bool = False
    memory_bytes: int | None = None  # these three are of a session that the engine starts itself
    spill_dir: str | None = None
    master: str | None = None

    def __post_init__(self) -> None:
        for f in fields(self):
            if (given := os.environ.get(f"MARLSTONE_{f.name.upper()}")) is not None:
                kind = str(f.type)
                try:
                    value = given.lower() in ("1", "true", "on", "yes") if "bool" in kind else int(given) if "int" in kind else given
                except ValueError as e:
                    raise InvalidConfigError(f"{f.name}: {given!r} is no number") from e
                setattr(self, f.name, value)
        if self.schema_inference not in INFERENCE:
            raise InvalidConfigError(f"schema_inference is one of {INFERENCE}, not {self.schema_inference!r}")
        if self.schema_drift not in DRIFT:
            raise InvalidConfigError(f"schema_drift is one of {DRIFT}, not {self.schema_drift!r}")
        if self.batch_size_rows < 1 or self.broadcast_threshold_bytes < -1 or any(x is not None and x < 1 for x in (self.shuffle_partitions, self.memory_bytes)):
            raise InvalidConfigError("sizes must be positive")

    def session(self) -> SparkSession:
        """The session there is, or a new one with this memory, spill folder and master."""
        builder = SparkSession.builder
        if self.memory_bytes:
            builder = builder.config("spark.driver.memory", f"{self.memory_bytes}b").config("spark.executor.memory", f"{self.memory_bytes}b")
        if self.spill_dir:
            builder = builder.config("spark.local.dir", self.spill_dir)
        return (builder.master(self.master) if self.master else builder).getOrCreate()

    def spark_conf(self) -> dict[str, str]:
        conf = {
            "spark.sql.parquet.columnarReaderBatchSize": str(self.batch_size_rows),
            "spark.sql.autoBroadcastJoinThreshold": str(self.broadcast_threshold_bytes),
            "spark.sql.adaptive.enabled": "true",
            "spark.sql.adaptive.skewJoin.enabled": "true",
        }
        if self.shuffle_partitions:
            conf["spark.sql.shuffle.partitions"] = str(self.shuffle_partitions)
        return conf
