"""Imports that can stop anywhere: a chain of digests over the lines taken so far, and versions that switch as a whole."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Lines whose digests are hashed together before they join the chain, and most bytes of a line.
BLOCK, LONGEST = 1000, 2 << 20


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(line, value)`` of a text file (or several, in order of their names), from 1, however it is split for reading.

    Every split's lines are counted where they are read; only a row for each split is added up.
    """
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"))
    splits = raw.groupBy("file", "start").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("file", "start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return raw.join(F.broadcast(splits.withColumn("before", before)), ["file", "start"]).select((F.col("before") + F.col("at") - F.col("first") + 1).alias("line"), "value")


class Chain(NamedTuple):
    """Lines taken, and the chain over their full blocks and what there is of the next one."""

    line: int
    full: str
    chain: str


START = Chain(0, "0" * 64, "0" * 64)


def _next(chain: str, block: str) -> str:
    return hashlib.sha256(f"{chain}{block}".encode()).hexdigest()


def extended(chain: Chain, lines: DataFrame, end: int, block: int = BLOCK) -> Chain:
    """The chain over lines up to ``end``; only the digests of the blocks after ``chain``'s full ones reach the driver.

    It depends on the lines and ``end`` alone: a stop in between leaves no trace.
    """
    begin = chain.line // block
    new = lines.where((F.col("line") > begin * block) & (F.col("line") <= end))
    shas = F.transform(F.sort_array(F.collect_list(F.struct("line", F.sha2("value", 256).alias("sha")))), lambda x: x["sha"])
    found = new.groupBy(F.floor((F.col("line") - 1) / block).cast("long").alias("block")).agg(F.sha2(F.concat_ws(",", shas), 256).alias("sha")).orderBy("block").collect()
    full = chain.full
    for r in found:
        if (r.block + 1) * block <= end:
            full = _next(full, r.sha)
    return Chain(end, full, _next(full, found[-1].sha) if end % block and found else full)


LEDGER = "run int, first_line long, last_line long, full string, chain string, records long, refused long, records_sha256 string, complete boolean"


def ledger(spark: SparkSession, folder: str) -> list:
    """One row for each run that ended, in order."""
    try:
        return spark.read.schema(LEDGER).json(f"{folder}/ledger/*").orderBy("run").collect()
    except AnalysisException:
        return []


def _records_digest(rows: DataFrame) -> str:
    from tessera.operators.review import digest

    row = digest(rows.select(F.sha2(F.to_json(F.struct(*sorted(rows.columns))), 256).alias("sha")), "sha").first()
    return row.sha256 if row and row.sha256 else hashlib.sha256(b"").hexdigest()


def chained_import(spark: SparkSession, path: str, folder: str, step: Callable[[DataFrame], tuple[DataFrame, DataFrame]], budget: int | None = None, block: int = BLOCK, longest: int = LONGEST) -> list:
    """Imports the lines of ``path`` after those of earlier runs, ``budget`` of them at most; returns the ledger.

    ``step(lines)`` gives the records and the refused rows of ``(line, value)``.  A run first holds the lines that
    earlier runs took, and the records that they wrote, against the ledger, and raises ValueError if either was
    changed; it then writes its records to a folder of its own and last of all its row of the ledger.  A run that
    ended before that leaves nothing behind that counts, and the next one takes its place.  Wherever runs stop, the
    chain and the records are those of a single run; after the last line further runs do nothing.
    """
    runs = ledger(spark, folder)
    if runs and runs[-1].complete:
        return runs
    lines = numbered_lines(spark, path)
    total = lines.agg(F.count("*").alias("n"), F.max(F.octet_length("value")).alias("most")).first()
    if (total.most or 0) > longest:
        raise ValueError(f"a line is longer than {longest} bytes")
    done = Chain(runs[-1].last_line, runs[-1].full, runs[-1].chain) if runs else START
    if runs and extended(START, lines, done.line, block) != done:
        raise ValueError("the lines that were taken before have changed")
    for r in runs:
        if _records_digest(spark.read.parquet(f"{folder}/records/run={r.run}")) != r.records_sha256:
            raise ValueError(f"the records of run {r.run} have changed")
    end = total.n if budget is None else min(total.n, done.line + budget)
    records, refused = step(lines.where((F.col("line") > done.line) & (F.col("line") <= end)))
    run = len(runs)
    records.write.mode("overwrite").parquet(f"{folder}/records/run={run}")
    refused.write.mode("overwrite").parquet(f"{folder}/refused/run={run}")
    written = spark.read.schema(records.schema).parquet(f"{folder}/records/run={run}")
    chain = extended(done, lines, end, block)
    row = (run, done.line + 1, end, chain.full, chain.chain, written.count(), spark.read.schema(refused.schema).parquet(f"{folder}/refused/run={run}").count(), _records_digest(written), end == total.n)
    spark.createDataFrame([row], LEDGER).coalesce(1).write.mode("overwrite").json(f"{folder}/ledger/run-{run:06d}")
    return ledger(spark, folder)


def imported(spark: SparkSession, folder: str) -> DataFrame:
    """The records of the runs in the ledger."""
    runs = ledger(spark, folder)
    if not runs:
        raise ValueError("nothing was imported")
    return spark.read.parquet(*[f"{folder}/records/run={r.run}" for r in runs])


POINTER = "number int, version string, rows long, sha256 string"


def pointers(spark: SparkSession, folder: str) -> list:
    """The switches made so far, in order; the last one serves."""
    try:
        return spark.read.schema(POINTER).json(f"{folder}/pointers/*").orderBy("number").collect()
    except AnalysisException:
        return []


def current(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of the version that serves; reading it again later may give another version, never part of one."""
    made = pointers(spark, folder)
    if not made:
        raise ValueError("no version serves yet")
    return spark.read.parquet(f"{folder}/versions/{made[-1].version}").drop("batch")


def import_version(spark: SparkSession, source: str, schema, folder: str, version: str, step: Callable[[DataFrame], DataFrame] = lambda batch: batch, valid: str = "true", files: int = 1) -> list:
    """Brings the files of ``source`` in as ``version``, all of them or none; returns the switches made so far.

    Micro-batches of ``files`` files go to the version's own folder, each to a part that is written again if its batch
    is.  When all are there, every row has to meet ``valid``; then one small file makes the version the one that
    serves.  An error in any batch, or in a row, leaves the earlier version serving, and the same call goes on from
    the batch that failed.  A version that serves or served is never written again.
    """
    made = pointers(spark, folder)
    if any(p.version == version for p in made):
        return made
    place = f"{folder}/versions/{version}"

    def put(batch: DataFrame, number: int) -> None:
        step(batch).write.mode("overwrite").parquet(f"{place}/batch={number}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
    stream.writeStream.foreachBatch(put).option("checkpointLocation", f"{folder}/staging/{version}").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(place).drop("batch")
    bad = rows.where(f"not coalesce({valid}, false)").count()
    if bad:
        raise ValueError(f"{bad} rows don't meet: {valid}")
    row = (len(made), version, rows.count(), _records_digest(rows))
    spark.createDataFrame([row], POINTER).coalesce(1).write.json(f"{folder}/pointers/{len(made):06d}")
    return pointers(spark, folder)


def reconciled(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``(key, state)`` of the switch from one version to the next: added, removed, changed or kept."""
    sha = lambda df, name: df.select(key, F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256).alias(name))
    both = sha(old, "was").join(sha(new, "is"), key, "full_outer")
    return both.select(key, F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed").when(F.col("was") == F.col("is"), "kept").otherwise("changed").alias("state"))
