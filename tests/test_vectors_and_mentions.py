"""Vector indexes read back by row number, and names in texts against a plain search."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import mentions as N
from tessera.sources import vectors as V

KIND = "id long, content_hash string, vector array<double>"


def table(spark, n=300, changed=()):
    rng = random.Random(5)
    rows = [(i, f"h{i}", [rng.uniform(-1, 1) for _ in range(5)]) for i in range(n)]
    return spark.createDataFrame([(i, h + "x" * (i in changed), [x + (i in changed) for x in v]) for i, h, v in rows], KIND).repartition(4)


def test_index_round_trip_and_reuse(spark, tmp_path):
    folder = f"file://{tmp_path}/index"
    manifest = V.write_index(table(spark), folder, "v1", 5, shards=8)
    assert manifest.agg(F.sum("rows")).first()[0] == 300 and manifest.count() == 8
    want = {r.id: [pytest.approx(x, abs=1e-6) for x in r.vector] for r in table(spark).collect()}
    got = V.read_index(spark, folder, "v1").collect()
    assert {r.id: r.vector for r in got} == want and sorted(r.number for r in got) == list(range(300))
    by = {r.number: r.vector for r in got}
    assert {r.number: r.vector for r in V.read_rows(spark, folder, "v1", 97, 205).collect()} == {i: by[i] for i in range(97, 205)}
    files = {p.name: p.stat().st_mtime_ns for p in (tmp_path / "index/shards").iterdir()}
    assert len(files) == 8 and not any(f.startswith("_") for f in files)
    second = V.write_index(table(spark, changed={7}), folder, "v2", 5, earlier="v1")
    after = {p.name: p.stat().st_mtime_ns for p in (tmp_path / "index/shards").iterdir()}
    assert len(after) == 9 and all(after[f] == t for f, t in files.items()) and second.count() == 8
    new = {r.id: r for r in V.read_index(spark, folder, "v2").collect()}
    assert new[7].content_hash == "h7x" and new[7].vector == [pytest.approx(x.expected + 1, abs=1e-6) for x in want[7]] and {i: r.vector for i, r in new.items() if i != 7} == {i: v for i, v in want.items() if i != 7}
    assert {r.id: r.vector for r in V.read_index(spark, folder, "v1").collect()} == want
    third = V.write_index(table(spark, 299), folder, "v3", 5, earlier="v2")
    assert third.agg(F.sum("rows")).first()[0] == 299 and V.read_index(spark, folder, "v3").count() == 299
    victim = next(p for p in (tmp_path / "index/shards").iterdir())
    victim.write_bytes(victim.read_bytes()[:-4])
    with pytest.raises(Exception, match="not whole"):
        for v in ("v1", "v2", "v3"):
            V.read_rows(spark, folder, v).count()


@pytest.mark.parametrize("row", [(None, "h", [1.0] * 5), (1, "h", [1.0] * 4), (1, "h", None), (1, "h", [1.0, None, 1.0, 1.0, 1.0]), (1, "h", [float("nan")] * 5), (1, "h", [float("inf")] * 5), (2, "h", [1.0] * 5)])
def test_faulty_vectors(spark, tmp_path, row):
    with pytest.raises(ValueError):
        V.write_index(spark.createDataFrame([row, (2, "h", [0.0] * 5)], KIND), f"file://{tmp_path}/x", "v", 5)


def test_empty_index(spark, tmp_path):
    folder = f"file://{tmp_path}/x"
    assert V.write_index(spark.createDataFrame([], KIND), folder, "v", 5).count() == 0 and V.read_rows(spark, folder, "v").count() == 0


def plain(text, names):
    ws, found = (text or "").split(), []
    for i in range(len(ws)):
        for j in range(i + 1, len(ws) + 1):
            es = {e for e, n in names if n and n.split() == ws[i:j]}
            if es:
                found.append((i, j, es))
    whole = [f for f in found if not any((g[0], g[1]) != (f[0], f[1]) and g[0] <= f[0] and g[1] >= f[1] for g in found)]
    return sorted((i, j - i, tuple(sorted(es))) for i, j, es in whole)


def test_names_against_a_plain_search(spark):
    rng = random.Random(4)
    names = [(f"e{rng.randrange(12)}", " ".join(rng.choice("abcd") for _ in range(rng.randrange(1, 5)))) for _ in range(25)] + [("e1", None), ("e2", "")]
    texts = [(i, " ".join(rng.choice("abcdxyz") for _ in range(rng.randrange(0, 14)))) for i in range(120)] + [(200, None), (201, ""), (None, "a b"), (5, "a")]
    df, known = spark.createDataFrame(texts, "id int, text string").repartition(4), spark.createDataFrame(names, "entity string, name string")
    got = {}
    for r in N.mentions(df, known).collect():
        got.setdefault((r.id, r.same), []).append((r.start, r.size, tuple(r.entities)))
    sames = {(r.id, r.text): r.same for r in df.withColumn("same", F.xxhash64("text")).collect()}
    for i, t in texts:
        assert sorted(got.get((i, sames[i, t]), [])) == plain(t, names)
    outcomes = sorted(((r.id, r.outcome, r.entity) for r in N.named_entities(df, known).collect()), key=str)
    want = []
    for i, t in texts:
        es = {e for *_, x in plain(t, names) for e in x}
        want.append((i, "unknown" if not es else "ambiguous" if len(es) > 1 else "matched", next(iter(es)) if len(es) == 1 else None))
    assert outcomes == sorted(want, key=str)
    assert N.named_entities(df, known.limit(0)).where("outcome <> 'unknown'").count() == 0 and N.named_entities(df.limit(0), known).count() == 0
