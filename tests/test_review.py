"""Review queues and leases: literal cases, a plain replay, and the streams against it."""

import random
import time

import pytest
from pyspark.sql import functions as F

from tessera.operators import review as R
from tessera.streaming import ingest
from tessera.streaming import review as S

CAND = "listing_id string, product_id string, data_version string, blocking_score double, blocking_reasons array<string>, title string, extra string"
SHOWN = ["blocking_score", "blocking_reasons", "title"]
WHEN = "2024-05-01T10:00:00+08:00"


@pytest.fixture(scope="module")
def queue(spark):
    rows = [(f"l{i}", f"p{i}", "v1", i / 10, ["brand"], f"title {i}", "x") for i in range(5)]
    return R.queued(spark.createDataFrame(rows, CAND), SHOWN).drop("faults").checkpoint()


def test_faults_of_items(spark):
    rows = [("a", "p", "v", 0.5, ["x"], "t", ""), ("b", "p", "", 1.5, [], None, ""), ("c", None, "v", None, ["x", " "], "t", ""), ("d", "p", "v", 0.1, ["x"], "t", ""), ("d", "p", "v", 0.2, ["x"], "u", ""), ("e", "p", "v", 0.1, [None], "t", "")]
    got = sorted((r.listing_id, tuple(r.faults)) for r in R.queued(spark.createDataFrame(rows, CAND), SHOWN).collect())
    assert got == [("a", ()), ("b", ("missing_data_version", "score_out_of_range", "missing_reason")), ("c", ("missing_product_id", "score_out_of_range", "missing_reason")), ("d", ("repeated_pair",)), ("d", ("repeated_pair",)), ("e", ("missing_reason",))]


def test_manifest_follows_every_snapshot(spark, queue):
    head = R.manifest(queue, "{}", WHEN).first()
    assert head.item_count == 5 and head.pending == 5 and R.manifest(queue.repartition(4), "{}", WHEN).first() == head
    names = {head.queue_id} | {R.manifest(df, p, w).first().queue_id for df, p, w in [(queue.limit(4), "{}", WHEN), (queue, "{ }", WHEN), (queue, "{}", "x"), (queue.withColumn("snapshot_sha256", F.sha2("listing_id", 256)), "{}", WHEN)]}
    assert len(names) == 5


def decisions(queue, spark):
    sha = {r.listing_id: (r.queue_item_id, r.snapshot_sha256) for r in queue.collect()}
    say = lambda seq, item, state="LABELLED", label="MATCH", who="ann", at=WHEN, note=None, sha_=None: (seq, sha[item][0], sha_ or sha[item][1], state, label, who, at, note)
    rows = [
        (say(0, "l0", sha_="0" * 64), "stale_snapshot"), (say(1, "l0"), "accepted"), (say(2, "l0", who=" ann "), "repeated"), (say(3, "l0", who="bob"), "conflict"), (say(4, "l0", label="NON_MATCH"), "conflict"),
        (say(5, "l1", "PENDING", None, None, None), "nothing_decided"), (say(6, "l1", "PENDING"), "pending_with_review"), (say(7, "l1", who=""), "missing_reviewer"), (say(8, "l1", at="2024-05-01T10:00:00"), "time_without_zone"), (say(9, "l1", label=None), "missing_label"),
        (say(10, "l1", "SKIPPED"), "label_without_judgment"), (say(11, "l1", "SKIPPED", ""), "accepted"), (say(12, "l1"), "conflict"), (say(13, "l2", "labelled"), "unknown_state"), (say(14, "l2", label="NON_MATCH", note="n"), "accepted"), (say(15, "l3", label="UNCERTAIN"), "accepted"),
    ]
    return [r for r, _ in rows] + [(16, "erq-none", "x", "LABELLED", "MATCH", "ann", WHEN, None)], {r[0]: o for r, o in rows} | {16: "unknown_item"}


def test_decisions(spark, queue):
    rows, want = decisions(queue, spark)
    out = R.decided(queue, spark.createDataFrame(rows, R.DECISION).repartition(3))
    assert {r.seq: r.outcome for r in out.collect()} == want
    done = R.settled(queue, out)
    assert {r.listing_id: (r.state, r.human_label) for r in done.collect()} == {"l0": ("LABELLED", "MATCH"), "l1": ("SKIPPED", None), "l2": ("LABELLED", "NON_MATCH"), "l3": ("LABELLED", "UNCERTAIN"), "l4": ("PENDING", None)}
    assert sorted((r.listing_id, r.label) for r in R.training_pairs(done, True).collect()) == [("l0", 1), ("l2", 0)]
    with pytest.raises(PermissionError):
        R.training_pairs(done, False)
    assert R.decided(queue.limit(0), spark.createDataFrame(rows, R.DECISION)).where("outcome <> 'unknown_item'").count() == 0


def test_streamed_decisions_and_a_restart(spark, queue, tmp_path):
    rows, want = decisions(queue, spark)
    base = f"file://{tmp_path}"
    for part in (rows[:4], rows[4:12], rows[12:]):
        spark.createDataFrame(part, R.DECISION).write.mode("append").parquet(f"{base}/log")
        S.with_store(spark, lambda: ingest.available_now(spark, f"{base}/log", R.DECISION, lambda s: S.decided(s, queue), f"{base}/out", f"{base}/state"))
    assert {r.seq: r.outcome for r in spark.read.parquet(f"{base}/out").collect()} == want
    assert spark.conf.get(S.STORE, None) != S.ROCKS


def test_queue_and_sheet_round_trip(spark, queue, tmp_path):
    base, schema = f"file://{tmp_path}", ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in queue.schema.fields)
    head = R.manifest(queue, "{}", WHEN)
    R.write_queue(queue, head, f"{base}/q")
    assert sorted(R.read_queue(spark, f"{base}/q", schema, SHOWN).collect()) == sorted(queue.collect())
    R.write_queue(queue.withColumn("title", F.lit("other")), head, f"{base}/changed")
    R.write_queue(queue.limit(4), head, f"{base}/fewer")
    for folder, text in (("changed", "snapshot"), ("fewer", "manifest")):
        with pytest.raises(ValueError, match=text):
            R.read_queue(spark, f"{base}/{folder}", schema, SHOWN)
    name = head.first().queue_id
    R.write_label_sheet(queue, name, f"{base}/sheet")
    assert R.read_label_sheet(spark, f"{base}/sheet", queue, name).count() == 0
    filled = spark.read.csv(f"{base}/sheet", header=True, escape='"')
    l0 = F.col("listing_id") == "l0"
    good = filled.withColumns({"state": F.when(l0, "LABELLED").otherwise(F.col("state")), "human_label": F.when(l0, "MATCH"), "reviewer_id": F.when(l0, 'a "b", c'), "reviewed_at": F.when(l0, WHEN)})
    good.write.csv(f"{base}/good", header=True, escape='"')
    assert [(r.human_label, r.reviewer_id) for r in R.read_label_sheet(spark, f"{base}/good", queue, name).collect()] == [("MATCH", 'a "b", c')]
    faults = lambda df, q=name: {r.fault for r in R.sheet_faults(df, queue, q).collect()}
    assert faults(good) == set() and faults(good.limit(4)) == {"missing_item"} and faults(good.union(good.limit(1))) == {"repeated_item"} and faults(good, "other") == {"other_queue"}
    assert faults(good.withColumn("snapshot_sha256", F.lit("x"))) == {"stale_snapshot"} and faults(good.withColumn("reviewer_id", F.lit(None).cast("string"))) == {"missing_reviewer"}
    assert faults(good.withColumn("queue_item_id", F.when(l0, "erq-x").otherwise(F.col("queue_item_id")))) == {"missing_item", "unknown_item"}


def test_two_claimants_one_lease():
    leases = []
    step = lambda kind, who, at, seconds=60, required=1: S.lease_step(leases, kind, who, at, seconds, required)
    assert step("claim", "a", 0) == ("granted", []) and step("claim", "b", 0) == ("held", [])
    assert step("judge", "b", 1) == ("no_lease", []) and step("claim", "b", 59_999) == ("held", [])
    assert step("claim", "b", 60_000) == ("granted", [("a", 60_000)])
    assert step("judge", "a", 60_001) == ("no_lease", []) and step("claim", "a", 60_002) == ("seen_before", [])
    assert step("judge", "b", 119_999) == ("judged", []) and step("claim", "c", 120_000) == ("done", [])
    assert step("claim", "c", 0, 29) == ("invalid_lease", []) and step("claim", "c", 0, 3601) == ("invalid_lease", []) and step("claim", "c", 0, None) == ("invalid_lease", [])


EVENT = "task string, event_id long, kind string, reviewer string, at long, seconds long, at_time timestamp"


def events(spark, n=400, seed=1):
    rng, at, rows = random.Random(seed), 1_700_000_000_000, []
    for i in range(n):
        at += rng.randrange(0, 20_000)
        rows.append((f"t{rng.randrange(12)}", i, rng.choice(["claim", "claim", "judge"]), f"r{rng.randrange(5)}", at, rng.choice([30, 60, 600, 10])))
    df = spark.createDataFrame(rows, "task string, event_id long, kind string, reviewer string, at long, seconds long")
    return rows, df.withColumn("at_time", F.timestamp_millis("at"))


@pytest.mark.parametrize("required", [1, 2])
def test_stream_of_leases_equals_the_replay(spark, tmp_path, required):
    rows, df = events(spark)
    base, leases, want = f"file://{tmp_path}", {}, set()
    for task, i, kind, who, at, seconds in rows:
        want.add((task, i, S.lease_step(leases.setdefault(task, []), kind, who, at, seconds, required)[0]))
        assert sum(x[2] != "expired" for x in leases[task]) <= required
    assert {(r.task, r.event_id, r.outcome) for r in S.replayed(df.repartition(5), required).where("event_id is not null").collect()} == want
    for part in ("event_id < 150", "event_id between 150 and 299", "event_id >= 300"):
        df.where(part).coalesce(1).write.mode("append").parquet(f"{base}/log")
        S.with_store(spark, lambda: ingest.available_now(spark, f"{base}/log", EVENT, lambda s: S.leased(s, required), f"{base}/out", f"{base}/state"))
    out = spark.read.parquet(f"{base}/out").collect()
    assert {(r.task, r.event_id, r.outcome) for r in out if r.event_id is not None} == want
    # every lease that ran out before the watermark came back exactly once, also where no later event met it
    last = max(r[4] for r in rows)
    gone = sorted((t, x[0], x[1]) for t, xs in leases.items() for x in xs if x[2] == "expired" or x[2] == "held" and x[1] <= last)
    assert sorted((r.task, r.reviewer, r.at) for r in out if r.outcome == "expired") == gone


def test_a_timer_of_the_clock_returns_the_task(spark, tmp_path):
    base, now = f"file://{tmp_path}", int(time.time() * 1000)
    S_SHORT = [("t", 1, "claim", "a", now - 29_000, 30), ("t", 2, "claim", "b", now - 28_000, 30)]
    df = spark.createDataFrame(S_SHORT, "task string, event_id long, kind string, reviewer string, at long, seconds long").withColumn("at_time", F.timestamp_millis("at"))
    df.coalesce(1).write.parquet(f"{base}/log")

    def run():
        q = S.leased(spark.readStream.schema(EVENT).parquet(f"{base}/log"), clock="ProcessingTime").writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(processingTime="500 milliseconds").start()
        try:
            end = time.time() + 60
            while time.time() < end and not (found := [r for r in spark.read.schema(S.OUT).parquet(f"{base}/out").collect() if r.outcome == "expired"] if (tmp_path / "out" / "_spark_metadata").exists() else []):
                time.sleep(0.5)
            assert [(r.task, r.reviewer, r.at) for r in found] == [("t", "a", now + 1000)]
        finally:
            q.stop()

    S.with_store(spark, run)
    assert {(r.event_id, r.outcome) for r in spark.read.parquet(f"{base}/out").collect()} == {(1, "granted"), (2, "held"), (None, "expired")}


def test_replay_holds_no_log_of_a_task_whole(spark):
    rows, df = events(spark, n=300, seed=2)
    leases = {}
    want = {(task, i, S.lease_step(leases.setdefault(task, []), kind, who, at, seconds, 2)[0]) for task, i, kind, who, at, seconds in rows}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = S.replayed(df.withColumn("seconds", F.expr("if(event_id = 0, null, seconds)")), 2)
        assert "FlatMapGroupsInPandas" not in got._jdf.queryExecution().executedPlan().toString()
        assert {(r.task, r.event_id, r.outcome) for r in got.where("event_id > 0").collect()} >= {x for x in want if x[0] != rows[0][0]}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_decisions_shuffle_the_log_once_and_no_repeated_pairs(spark):
    queue = R.queued(spark.range(5).selectExpr("'v' as data_version", "string(id) as listing_id", "'p' as product_id", "0.5D as blocking_score", "array('brand') as blocking_reasons", "'t' as title"), SHOWN)
    log = queue.select(F.lit(1).cast("long").alias("seq"), "queue_item_id", "snapshot_sha256", F.lit("SKIPPED").alias("state"), F.lit(None).cast("string").alias("human_label"), F.lit("r").alias("reviewer_id"), F.lit("2024-05-01T10:00:00Z").alias("reviewed_at"), F.lit(None).cast("string").alias("note"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", False)
    try:
        plan = R.decided(queue, log).select("seq", "queue_item_id", "outcome")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    shuffles = [line for line in plan.split("\n") if "Exchange hashpartitioning" in line and "Reused" not in line]
    assert len(shuffles) == 2 and "ReusedExchange" in plan and "Window" not in plan


def test_decisions_in_batches_equal_one_log(spark, queue, tmp_path):
    base = f"file://{tmp_path}"
    ids = [(r.queue_item_id, r.snapshot_sha256) for r in queue.orderBy("queue_item_id").collect()]
    rows = [(10 * k + j, i, snap if (k + j) % 5 else "x", "LABELLED", ("MATCH", "NON_MATCH")[(k + j) % 3 == 0], "r", "2024-05-01T10:00:00Z", None) for j in range(6) for k, (i, snap) in enumerate(ids)] + [(999, "erq-none", "x", "SKIPPED", None, "r", "2024-05-01T10:00:00Z", None)]
    log = spark.createDataFrame(rows, R.DECISION)
    for part in ("seq % 10 < 2", "seq % 10 = 2", "seq % 10 > 2"):
        log.where(part).write.mode("append").parquet(f"{base}/log")
        S.decide_new(spark, f"{base}/log", queue, f"{base}/out", f"{base}/state")
    got = {(r.seq, r.queue_item_id, r.outcome) for r in spark.read.parquet(f"{base}/out").collect()}
    assert got == {(r.seq, r.queue_item_id, r.outcome) for r in R.decided(queue, log).collect()} and len(got) == len(rows)
