"""Places in a global order and digests of ordered tables, without bringing rows together."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows, and then digests, that are hashed together.
FAN = 1024


def numbered(rows: DataFrame, order: Sequence[str], partitions: int | None = None) -> DataFrame:
    """``rows`` with ``place``, from 0, in the order of ``order`` (rows that are equal in it: in any order).

    Ranges of the order are sorted by themselves; only how many rows each has is added up, a row a range.
    """
    n = partitions or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("place_in_task", F.monotonically_increasing_id()).checkpoint()
    task, size = F.shiftright("place_in_task", 33), (1 << 33) - 1
    counts = at.groupBy(task.alias("task")).count().orderBy("task").collect()
    before, total = [], 0
    for r in counts:
        before.append((r.task, total))
        total += r["count"]
    starts = rows.sparkSession.createDataFrame(before, "task long, before long")
    joined = at.withColumn("task", task).join(F.broadcast(starts), "task")
    return joined.withColumn("place", F.col("before") + F.col("place_in_task").bitwiseAND(F.lit(size))).drop("task", "before", "place_in_task")


def row_text(rows: DataFrame, columns: Sequence[str]) -> Column:
    """A row's values as a JSON array of [kind, value], so that no two different rows have one text.

    Floats are written by the bits of their IEEE-754 form; null and NaN are missing; an infinite one raises an error.
    """
    kinds = dict(rows.dtypes)

    def one(c: str) -> Column:
        v, kind = F.col(c), kinds[c]
        if kind in ("float", "double"):
            wide = v.cast("double")
            bits = F.expr(f"java_method('java.lang.Double', 'doubleToLongBits', coalesce(cast(`{c}` as double), 0D))")
            said = F.when(F.abs(wide) == float("inf"), F.raise_error(F.lit(f"{c} has an infinite value"))).otherwise(F.lower(F.lpad(F.hex(bits.cast("long")), 16, "0")))
            return F.when(v.isNull() | F.isnan(wide), '["missing"]').otherwise(F.concat(F.lit('["float","'), said, F.lit('"]')))
        if kind == "boolean":
            said = F.concat(F.lit('["bool",'), v.cast("string"), F.lit("]"))
        elif kind in ("tinyint", "smallint", "int", "bigint"):
            said = F.concat(F.lit('["int",'), v.cast("string"), F.lit("]"))
        else:
            said = F.when(v.isNotNull(), F.concat(F.lit('["str",'), F.substring(F.to_json(F.array(v.cast("string"))), 2, (1 << 31) - 1)))
        return F.coalesce(said, F.lit('["missing"]'))

    return F.concat(F.lit("["), F.concat_ws(",", *[one(c) for c in columns]), F.lit("]"))


def ordered_digest(rows: DataFrame, columns: Sequence[str], order: Sequence[str]) -> str:
    """SHA-256 of the rows' ``columns`` in the order of ``order``, as a tree: FAN digests at a time become one.

    It depends on values and order alone, not on how the rows are stored; the names of the columns are part of it.
    Each level is an aggregation over 1 / FAN of the rows before it, and only the root reaches the driver.
    ``order`` has to tell all rows apart that differ in ``columns``.
    """
    texts = row_text(rows, columns)
    level = numbered(rows.select(*order, F.sha2(texts, 256).alias("sha")), [*order, "sha"]).select("place", "sha")
    n = level.count()
    while True:
        both = F.transform(F.sort_array(F.collect_list(F.struct("place", "sha"))), lambda x: x["sha"])
        level = level.groupBy(F.floor(F.col("place") / FAN).cast("long").alias("up")).agg(F.sha2(F.concat_ws(",", both), 256).alias("sha")).select(F.col("up").alias("place"), "sha")
        n = -(-n // FAN)
        if n <= 1:
            break
        level = level.checkpoint()
    root = level.first()
    head = F.concat_ws("\0", *[F.lit(c) for c in columns], F.lit(root.sha if root else ""))
    return rows.sparkSession.range(1).select(F.sha2(head, 256).alias("d")).first().d
