"""Resampling, fill-in-middle and quality against plain versions; long texts full of secrets; wide document ids."""

import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import fill_middle, oracle, quality, resampling, toxicity
from tessera.llm.common import shared_dir
from tessera.llm.secrets import redacted, secret_spans
from tessera.llm.training_order import Permutation, domain, read_training_order, write_training_order

DOCS = "doc_id long, text string, score double, output string, rank int, form string"


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(9)
    word = lambda: rng.choice(["w", "ü", "日本", "A", "x" * 70, "z9"]) + str(rng.randrange(40))
    out = [rng.choice([" ", "\n", "-"]).join(word() for _ in range(rng.choice([1, 2, 19, 20, 21, 60]))) for _ in range(120)]
    long = " ".join(word() for _ in range(20_000))
    return out + out[:20] + [None, "", " ", "one", "two words", "a <S> b", "<P>", "😀" * 30, "é", "a" * 200_000, long, long, "<<P", "S>x<"]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, 0.5, "o", 1, "f") for i, t in enumerate(texts)] + [(-5, "negative id " * 30, 0.5, "o", 1, "f"), (None, "no id " * 30, 0.5, "o", 1, "f")]
    return spark.createDataFrame(rows + rows[:3], DOCS).repartition(5)


def draw(text, n):
    return [int(hashlib.sha256(text.encode()).hexdigest()[8 * i : 8 * i + 8], 16) for i in range(n)]


def features(text, orders=2):
    ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return len(ws), [" ".join(ws[i : i + k]) for k in range(1, orders + 1) for i in range(len(ws) - k + 1)]


def plain_resample(rows, target, buckets=10_000, orders=2):
    at = lambda g: zlib.crc32(g.encode()) % buckets
    s, t = np.zeros(buckets), np.zeros(buckets)
    for counts, texts in ((s, [r[1] for r in rows]), (t, target)):
        for x in texts:
            for g in features(x, orders)[1]:
                counts[at(g)] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.sum() + buckets) / ((s[b] + 1) * (t.sum() + buckets)))) for b in range(buckets)]
    out = []
    for doc_id, text in rows:
        n, fs = features(text, orders)
        weight = sum(gain[at(g)] for g in fs) // len(fs) if fs else 0
        h = None if doc_id is None else draw(f"7:{doc_id}", 1)[0]
        out.append([doc_id, len(fs), weight, None if h is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    drawn = sorted((r for r in out if r[4] >= 20 and r[0] is not None), key=lambda r: (-r[3], r[0], r[1]))
    rank = {id(r): i + 1 for i, r in enumerate(drawn[: 25 * len(drawn) // 100])}
    return sorted([(*r[:4], rank.get(id(r))) for r in out], key=str)


@pytest.mark.parametrize("orders", [1, 2, 3])
def test_resampling(spark, docs, orders):
    target = ["w1 w2 w3 Ü4 z91", None, "", "日本1 日本2"]
    rows = docs.select("doc_id", "text").collect()
    bench = spark.createDataFrame([(t, 1) for t in target], "text string, item int")
    got = resampling.resample(docs, bench, orders=orders)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted([tuple(r) for r in got.collect()], key=str) == plain_resample([tuple(r) for r in rows], target, orders=orders)
    if orders == 2:
        con = duckdb.connect()
        con.register("documents", docs.toArrow())
        con.register("benchmark", bench.toArrow())
        assert sorted(con.sql(oracle.resampling()).fetchall(), key=str) == sorted([tuple(r) for r in got.collect()], key=str)


def test_resampling_without_rows(spark, docs):
    none = docs.limit(0)
    assert resampling.resample(none, docs).count() == 0
    got = resampling.resample(docs, none).collect()
    assert len(got) == docs.count() and sum(r.rank is not None for r in got) == 25 * sum(features(r.text)[0] >= 20 and r.doc_id is not None for r in docs.collect()) // 100


def test_ranks_by_regular_sampling(spark):
    rng = np.random.default_rng(1)
    keys = [(int(s), int(d), int(f), i) for i, (s, d, f) in enumerate(zip(rng.integers(-3, 3, 5000), rng.integers(-(2**62), 2**62, 5000), rng.integers(0, 2, 5000)))]
    keys += [(0, 7, 1, 5000 + i) for i in range(4000)]
    rows = spark.createDataFrame(keys, "score long, doc_id long, n_features long, at long").repartition(6, F.rand(3)).sortWithinPartitions(F.desc("score"), "doc_id", "n_features", "at")
    got = sorted(resampling.ranked(rows.checkpoint(), len(keys), range_rows=100).collect(), key=lambda r: r["rank"])
    assert [r["rank"] for r in got] == list(range(1, 9001))
    assert [(r.score, r.doc_id, r.n_features, r.at) for r in got] == sorted(keys, key=lambda k: (-k[0], *k[1:]))


def plain_middle(doc_id, text, seed, unit="chars"):
    t = text or ""
    n = len(t)
    plain = (n, "plain", None, None, t)
    if doc_id is None or not t or any(m in t for m in ("<P>", "<S>", "<M>")):
        return plain
    h = draw(f"{seed}:{doc_id}", 4)
    if h[2] % 100 >= 90:
        return plain
    if unit == "chars":
        a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    else:
        raw = t.encode()
        a, b = (len(raw[:x].decode(errors="ignore")) for x in sorted((h[0] % (len(raw) + 1), h[1] % (len(raw) + 1))))
    spm = h[3] % 100 < 20
    return n, "spm" if spm else "psm", a, b - a, (f"<S>{t[b:]}<P>{t[:a]}" if spm else f"<P>{t[:a]}<S>{t[b:]}") + f"<M>{t[a:b]}"


@pytest.mark.parametrize(("seed", "unit"), [(1, "chars"), ("x", "bytes")])
def test_fill_in_middle(spark, docs, seed, unit):
    out = fill_middle.fill_in_middle(docs, seed, unit, keep=["doc_id", "text", "output", "rank"])
    assert out.columns == ["doc_id", "text", "rank", "n", "form", "prefix_chars", "middle_chars", "output"]
    rows = out.withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    assert len(rows) == docs.count() and {r.form for r in rows} == {"plain", "psm", "spm"}
    for r in rows:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == plain_middle(r.doc_id, r.text, seed, unit)
        assert r.back == (r.text or "")
    assert fill_middle.fill_in_middle(docs.limit(0)).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab é日😀\n"), max_size=12), max_size=6))
def test_index_of_multibyte_characters(texts):
    raw = [t.encode() for t in texts]
    data, off = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    index = fill_middle.Exceptions.of(data, off)
    for i, t in enumerate(texts):
        for c in range(len(t) + 1):
            assert index.to_bytes(np.array([i]), np.array([c]))[0] == len(t[:c].encode())
        for b in range(len(raw[i]) + 1):
            assert index.to_chars(np.array([i]), np.array([b]))[0] == len(raw[i][:b].decode(errors="ignore"))


@pytest.mark.parametrize("marks", [("<P>", "<P>", "<M>"), ("ab", "ba", "c"), ("aa", "b", "c"), ("", "b", "c"), ("abc", "b", "d")])
def test_marks_that_overlap(spark, docs, marks):
    with pytest.raises(ValueError):
        fill_middle.fill_in_middle(docs, marks=marks)


def test_risk_and_its_slope():
    rng = np.random.default_rng(2)
    for p, u, prior in ((rng.normal(size=7), rng.normal(size=9), 0.6), (rng.normal(size=7) + 4, rng.normal(size=9) - 9, 0.9)):
        risk, sp, su = quality.risk_slope(p, u, prior)
        loss = lambda z: np.log1p(np.exp(z))
        rest = loss(u).mean() - prior * loss(p).mean()
        assert risk == pytest.approx(prior * loss(-p).mean() + max(0, rest))
        follow = (lambda p, u: prior * loss(-p).mean() + loss(u).mean() - prior * loss(p).mean()) if rest >= 0 else (lambda p, u: prior * loss(p).mean() - loss(u).mean())
        for i in range(7):
            d = np.eye(7)[i] * 1e-6
            assert sp[i] == pytest.approx((follow(p + d, u) - follow(p - d, u)) / 2e-6, abs=1e-6)
        for i in range(9):
            d = np.eye(9)[i] * 1e-6
            assert su[i] == pytest.approx((follow(p, u + d) - follow(p, u - d)) / 2e-6, abs=1e-6)


def test_class_prior():
    rng = np.random.default_rng(4)
    for share in (0.2, 0.5, 0.85):
        good, bad = rng.normal(3, 1, 40_000), rng.normal(-3, 1, 40_000)
        unlabelled = np.where(rng.random(20_000) < share, good[:20_000], bad[:20_000])
        assert quality.best_bin(good[20_000:], unlabelled) == pytest.approx(share, abs=0.05)


def corpus(n=900, seed=5):
    """Clean prose, and three kinds of junk; which words occur says nothing."""
    rng, rows, labels = random.Random(seed), [], []
    for i in range(n):
        ws = [rng.choice("abcdefghij") * rng.randrange(1, 3) + rng.choice(["lu", "mer", "no"]) for _ in range(rng.randrange(30, 90))]
        kind = rng.choice([0, 0, 0, 1, 2, 3])
        text = [" ".join(ws).capitalize() + ".", " ".join(w.upper() + "!!" for w in ws), " ".join(w + rng.choice(["###", "%%%"]) for w in ws), " ".join(w for w in ws[:12] for _ in range(6))][kind]
        rows.append((i, text, 0.5, "o", 1, "f"))
        labels.append((i, int(kind == 0)))
    return rows, labels


def test_quality(spark):
    rows, labels = corpus()
    odd = [(None, "no id", 0.1, "o", 1, "f"), (10_000, None, 0.1, "o", 1, "f"), (10_001, "", 0.1, "o", 1, "f"), (10_002, "x" * 300_000, 0.1, "o", 1, "f"), rows[3]]
    df = spark.createDataFrame(rows + odd, DOCS).repartition(4)
    lab = spark.createDataFrame(labels + [(3, labels[3][1]), (None, 1), (10_001, None)], "doc_id long, quality int")
    got = quality.quality(df, lab).collect()
    assert len(got) == len(rows) + 5
    by, held = {}, lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) and r.held_out == (r.doc_id is not None and held(r.doc_id))
        assert by.setdefault(r.doc_id, r.score) == r.score
    out = [(i, q) for i, q in labels if held(i)]
    assert sum((by[i] >= 0.7) == q for i, q in out) / len(out) > 0.97
    # labels of held-out rows, of either class, change nothing
    turned = lab.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert {r.doc_id: r.score for r in quality.quality(df, turned).collect()} == by
    none = quality.quality(df, lab.where("quality = 0"))
    assert {r.score for r in none.collect()} == {1.0} and quality.quality(df.limit(0), lab).count() == 0


def test_features_are_of_the_whole_text():
    texts = ["aa bb aa. aa", "", "Ab  Cd9\nAb\nAb", "x " * 5000 + "Y"]
    raw = [t.encode() for t in texts]
    x = quality.features(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    assert x[0, :2].tolist() == pytest.approx([0, 1 / 4]) and not x[1].any()
    assert x[2, 4] == pytest.approx(1 / 3) and x[2, 5] == pytest.approx(4 / 8) and x[2, 0] == pytest.approx(1 / 3)
    assert x[3, 0] == pytest.approx(4999 / 5000) and x[3, 3] == pytest.approx(5000 / 5001)
    assert (x[:, quality.MEASURES :] ** 2).sum(1) == pytest.approx([1, 0, 1, 1], abs=1e-5)


def test_text_full_of_secrets(spark):
    rng = random.Random(8)
    keys = ["".join(rng.choice("0123456789abcdef") for _ in range(24)) for _ in range(100_000)]
    text = "é" + " ".join(keys)
    df = spark.createDataFrame([(1, text), (2, "token=" + keys[0] + " token:abcdef"), (3, None)], "doc_id long, text string")
    rows = secret_spans(df, ["doc_id", "text"]).withColumn("clean", redacted(F.col("text"), F.col("spans"))).collect()
    r = {x.doc_id: x for x in rows}
    assert [(s.start, s.end) for s in r[1].base_spans] == [(1 + 25 * i, 25 + 25 * i) for i in range(100_000)]
    assert r[1].clean == "é" + " ".join(["[secret]"] * 100_000)
    assert r[2].clean == "[secret] [secret]" and r[3].clean is None
    no = spark.range(1).select(redacted(F.lit("abc"), F.expr("cast(null as array<struct<start:int,end:int>>)")).alias("x"))
    assert no.first().x == "abc"


def test_redaction_against_a_plain_version(spark):
    rng, rows = random.Random(2), []
    for i in range(60):
        n = rng.choice([5, 1023, 1024, 1025, 5000])
        spans = sorted((a, a + rng.choice([1, 3, 40, 1500])) for a in (rng.randrange(n) for _ in range(rng.choice([1, 4, 200]))))
        rows.append((i, "".join(rng.choice("aé\n😀") for _ in range(n)), [(a, min(b, n)) for a, b in spans]))
    df = spark.createDataFrame(rows, "i int, text string, spans array<struct<start:int,end:int>>").withColumn("x", redacted(F.col("text"), F.col("spans")))
    for r in df.collect():
        at, out = 0, ""
        for a, b in r.spans:
            if a >= at:
                out += r.text[at:a] + "[secret]"
            at = max(at, b)
        assert r.x == out + r.text[at:]


@pytest.mark.parametrize("n", [1 << 63, (1 << 64) + 5, 3 << 70, (1 << 95) - 7])
def test_wide_permutation(n):
    p, rng = Permutation(n, "k"), random.Random(1)
    xs = [rng.randrange(n) for _ in range(500)] + [0, n - 1]
    split = lambda v: (np.array([x >> 32 for x in v], np.uint64), np.array([x & 0xFFFFFFFF for x in v], np.uint64))
    slots = [int(a) << 32 | int(b) for a, b in zip(*p.slots(*split(xs)), strict=True)]
    assert max(slots) < n and len(set(slots)) == len(set(xs)) and slots != xs
    assert [int(a) << 32 | int(b) for a, b in zip(*p.indexes(*split(slots)), strict=True)] == xs


def test_training_order_of_wide_ids(spark):
    ids = [-(2**62) - 3, 2**62 + 5, 2**63 - 1, -(2**63), 0]
    df = spark.createDataFrame([(i, list(range(8 * 40 - 3))) for i in ids], "doc_id long, ids array<int>")
    at, out = domain(df, F.size("ids"), 8, shards=7), []
    for parts in (1, 3):
        folder = shared_dir(spark)
        manifest = write_training_order(df.repartition(parts), folder, "key", length=8, at=at)
        assert manifest.count() > 3
        out.append([(r.slot, r.doc_id, r.part) for r in read_training_order(spark, folder).orderBy("slot").collect()])
    assert out[0] == out[1] and [x[0] for x in out[0]] == list(range(200)) and len({x[1:] for x in out[0]}) == 200
    near = sum(a[1] == b[1] for a, b in zip(out[0], out[0][1:]))
    assert near < 80, "sequences of one document lie together"


def test_toxicity_scores_from_the_machine(spark):
    """Scores are the intercept, the weights and every pair's product of factors, added up one by one."""
    rng, rows, labels = random.Random(6), [], []
    for i in range(500):
        ws = [f"w{rng.randrange(40)}" for _ in range(rng.randrange(1, 25))] + [w for w in ("idiot", "those") if rng.random() < 0.4]
        rows.append((i, " ".join(ws), 0.5, "o", 1, "f"))
        labels.append((i, int("idiot" in ws and "those" in ws)))
    df = spark.createDataFrame(rows + [(900, None, 0.1, "o", 1, "f"), (901, "", 0.1, "o", 1, "f"), (902, "IDIOT those idiot", 0.1, "o", 1, "f")], DOCS)
    machine = toxicity.fit(df, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert machine is not None and len(machine.terms)
    own = {int(t): machine.weights[:, i].astype(float) for i, t in enumerate(machine.terms)}
    terms = {r.doc_id: r.terms for r in toxicity.with_terms(df).collect()}
    for r in toxicity.score(df, machine).collect():
        ws = [own[t] for t in terms[r.doc_id] if t in own]
        z = machine.intercept + sum(w[0] for w in ws) + sum(float(a[1:] @ b[1:]) for i, a in enumerate(ws) for b in ws[i + 1 :])
        assert r.score == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-5)
