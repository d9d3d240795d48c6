"""Imports that stop and go on, versions that switch as a whole, and digests of ordered tables."""

import hashlib
import json
import random
import struct

import pytest
from pyspark.sql import functions as F

from tessera.operators import digests as D
from tessera.streaming import imports as I


def lines_file(path, n, change=None):
    path.mkdir(exist_ok=True)
    text = [json.dumps({"id": i, "v": "é" * (i % 50)}) for i in range(n)]
    if change is not None:
        text[change] = '{"id": -1}'
    (path / "part-0.json").write_text("\n".join(text) + "\n", encoding="utf-8")
    return text


def plain_chain(text, block):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    chain = "0" * 64
    for i in range(0, len(text), block):
        chain = sha(chain + sha(",".join(sha(t) for t in text[i : i + block])))
    return chain


def step(lines):
    parsed = lines.select("line", F.from_json("value", "id long, v string").alias("r")).select("line", "r.*")
    return parsed.where("id % 7 <> 3"), parsed.where("id % 7 = 3").select("line", "id")


def test_lines_are_numbered_however_the_file_is_split(spark, tmp_path):
    text = lines_file(tmp_path / "in", 5000)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("20000", "128m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = I.numbered_lines(spark, f"file://{tmp_path}/in")
            assert [r.value for r in got.orderBy("line").collect()] == text and got.agg(F.max("line")).first()[0] == 5000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.mark.parametrize("budgets", [[None], [130, 1, 269, 600, None], [1000, 1000]])
def test_the_same_chain_wherever_runs_stop(spark, tmp_path, budgets):
    text, folder = lines_file(tmp_path / "in", 1234), f"file://{tmp_path}/out"
    for budget in [*budgets, 5]:
        runs = I.chained_import(spark, f"file://{tmp_path}/in", folder, step, budget, block=100)
    assert runs[-1].complete and runs[-1].chain == plain_chain(text, 100) and len(runs) == len(budgets)
    assert sorted(r.id for r in I.imported(spark, folder).collect()) == [i for i in range(1234) if i % 7 != 3]
    assert sum(r.refused for r in runs) == sum(i % 7 == 3 for i in range(1234))


def test_changes_and_broken_runs(spark, tmp_path):
    source, folder = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    lines_file(tmp_path / "in", 300)
    I.chained_import(spark, source, folder, step, 120, block=50)

    def broken(lines):
        records, refused = step(lines)
        return records.withColumn("x", F.when(F.col("id") == 155, F.raise_error(F.lit("broken")))), refused

    with pytest.raises(Exception, match="broken"):
        I.chained_import(spark, source, folder, broken, 120, block=50)
    assert len(I.ledger(spark, folder)) == 1
    lines_file(tmp_path / "in", 300, change=119)
    with pytest.raises(ValueError, match="lines"):
        I.chained_import(spark, source, folder, step, 120, block=50)
    text = lines_file(tmp_path / "in", 300, change=120)
    I.chained_import(spark, source, folder, step, 120, block=50)
    with pytest.raises(ValueError, match="longer"):
        I.chained_import(spark, source, folder, step, longest=20, block=50)
    spark.createDataFrame([(1, 2, "x")], "line long, id long, v string").write.mode("append").parquet(f"{folder}/records/run=0")
    with pytest.raises(ValueError, match="records of run 0"):
        I.chained_import(spark, source, folder, step, block=50)
    assert I.ledger(spark, folder)[-1].chain == plain_chain(text[:240], 50)


def test_a_version_comes_whole_or_not_at_all(spark, tmp_path):
    base, kind = f"file://{tmp_path}", "id long, v long"
    with pytest.raises(ValueError):
        I.current(spark, f"{base}/store")
    for i in range(3):
        spark.range(10 * i, 10 * i + 10).select("id", (F.col("id") * 2).alias("v")).coalesce(1).write.mode("append").parquet(f"{base}/a")
        spark.range(5 + 10 * i, 15 + 10 * i).select("id", (F.col("id") * F.when(F.col("id") < 12, 2).otherwise(3)).alias("v")).coalesce(1).write.mode("append").parquet(f"{base}/b")
    assert [p.version for p in I.import_version(spark, f"{base}/a", kind, f"{base}/store", "a", valid="v >= 0")] == ["a"]
    first = I.current(spark, f"{base}/store")
    assert first.count() == 30

    def failing(batch):
        return batch.withColumn("v", F.when(F.col("id") == 30, F.raise_error(F.lit("broken"))).otherwise(F.col("v")))

    with pytest.raises(Exception, match="broken|FAILED|failed"):
        I.import_version(spark, f"{base}/b", kind, f"{base}/store", "b", failing)
    assert [p.version for p in I.pointers(spark, f"{base}/store")] == ["a"] and I.current(spark, f"{base}/store").count() == 30
    with pytest.raises(ValueError, match="meet"):
        I.import_version(spark, f"{base}/b", kind, f"{base}/store", "b", valid="id < 34")
    assert [p.version for p in I.pointers(spark, f"{base}/store")] == ["a"]
    assert [(p.version, p.rows) for p in I.import_version(spark, f"{base}/b", kind, f"{base}/store", "b")] == [("a", 30), ("b", 30)]
    states = {r.id: r.state for r in I.reconciled(first, I.current(spark, f"{base}/store"), "id").collect()}
    assert states == {i: "removed" for i in range(5)} | {i: "kept" for i in range(5, 12)} | {i: "changed" for i in range(12, 30)} | {i: "added" for i in range(30, 35)}
    assert len(I.import_version(spark, f"{base}/b", kind, f"{base}/store", "b", failing)) == 2


FRAME = "id long, name string, x double, flag boolean, f float"


def plain_digest(rows, columns, kinds):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()

    def one(v, kind):
        if v is None or v != v:
            return ["missing"]
        if kind in ("double", "float"):
            return ["float", struct.pack(">d", v).hex()]
        return ["bool" if kind == "boolean" else "int" if kind == "long" else "str", v]

    level = [sha(json.dumps([one(v, k) for v, k in zip(r, kinds, strict=True)], separators=(",", ":"), ensure_ascii=False)) for r in rows]
    while True:
        level = [sha(",".join(level[i : i + D.FAN])) for i in range(0, len(level), D.FAN)]
        if len(level) <= 1:
            break
    return sha("\0".join([*columns, level[0] if level else ""]))


def test_ordered_digest(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["a", 'q"uo\\te', "é😀", "", None]), rng.choice([0.1, -0.0, 0.0, 1e300, 5e-324, float("nan"), None, rng.random()]), rng.choice([True, False, None]), rng.choice([0.5, 1.25, None])) for i in range(2500)]
    columns, kinds = ["id", "name", "x", "flag", "f"], [c.split()[1] for c in FRAME.split(", ")]
    df = spark.createDataFrame(rows, FRAME)
    want = plain_digest(rows, columns, kinds)
    assert D.ordered_digest(df.repartition(7), columns, ["id"]) == want == D.ordered_digest(df.coalesce(1), columns, ["id"])
    other = [rows[1], rows[0], *rows[2:]]
    swapped = spark.createDataFrame([(i, *r[1:]) for i, r in enumerate(other)], FRAME)
    few = spark.createDataFrame(rows[:3], FRAME)
    seen = {want, D.ordered_digest(swapped, columns, ["id"]), D.ordered_digest(df.limit(2499), columns, ["id"]), D.ordered_digest(df, columns[::-1], ["id"]), D.ordered_digest(few, columns, ["id"]), D.ordered_digest(df.limit(0), columns, ["id"])}
    assert len(seen) == 6 and D.ordered_digest(few, columns, ["id"]) == plain_digest(rows[:3], columns, kinds)
    with pytest.raises(Exception, match="infinite"):
        D.ordered_digest(few.withColumn("x", F.lit(float("inf"))), columns, ["id"])


def test_places(spark):
    rng = random.Random(2)
    values = [(rng.randrange(50),) for _ in range(3000)]
    got = D.numbered(spark.createDataFrame(values, "v int").repartition(4), ["v"], 9).orderBy("place").collect()
    assert [r.place for r in got] == list(range(3000)) and [r.v for r in got] == sorted(v for v, in values)
    assert D.numbered(spark.createDataFrame([], "v int"), ["v"]).count() == 0
