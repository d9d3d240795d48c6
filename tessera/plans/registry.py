"""Where queries and the SQL they are checked against are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.operators.relations import tasks_of

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function under its name; ``sql`` is DuckDB SQL for the same rows, where there is any."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``; on one machine without it, one of the warehouse."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
    return (root or spark.conf.get("spark.sql.warehouse.dir") + "/checkpoints").rstrip("/")


def checkpoints(spark: SparkSession) -> None:
    """Makes ``checkpoint()`` usable."""
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_root(spark))


def spread(rows: DataFrame) -> DataFrame:
    """Rows dealt out to all cores: a table of a few MB is read by one task, whatever is done with its rows.

    The checkpoint keeps the optimizer from moving later conditions back into that one task.
    """
    checkpoints(rows.sparkSession)
    return rows.repartition(tasks_of(rows)).checkpoint()
