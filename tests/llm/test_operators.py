"""Edge cases of every operator, against brute force or DuckDB SQL on small fixtures."""

import base64
import hashlib
import random
import re

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import oracle
from tessera.llm.chat import chat_format
from tessera.llm.common import shared_dir, text_steps, word_hashes, word_spans, NOT_SPACE
from tessera.llm.decontaminate import contamination
from tessera.llm.graph import components
from tessera.llm.near_dedup import near_duplicates, signature
from tessera.llm.pieces import Pieces, backtrace, crossing, decode, encode, entry_states, through, transfer
from tessera.llm.queries import PIECE_MODEL
from tessera.llm.secrets import KINDS, redacted, secret_spans, written
from tessera.llm.substring import SuffixAutomaton, remove_repeats
from tessera.llm.top_k import top_k
from tessera.llm.toxicity import toxicity
from tessera.llm.training_order import Permutation, domain, read_training_order, token_array, write_training_order
from tessera.llm.warc import read_warc, write_warc

DOCS = "doc_id long, text string, lang string, n_words long, score double, spans string"


def words(rng, n, size=300):
    return [f"w{rng.randrange(size)}" for _ in range(n)]


@pytest.fixture(scope="session")
def texts():
    rng = random.Random(5)
    base = [" ".join(words(rng, rng.choice([3, 12, 40, 200]))) for _ in range(30)]
    passage = " ".join(words(rng, 60))
    out = list(base)
    for t in base[:12]:
        ws = t.split()
        ws[rng.randrange(len(ws))] = "changed"
        out += [t, " ".join(ws), passage + " " + t, t.upper(), t.replace(" ", " \t\n ")]
    out += [None, "", "   ", "one", "Über straße 日本語 😀 " + passage, passage, " ".join(words(rng, 3_000)), passage + " " + passage]
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = [(i, t, "en", 1, 0.5, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).repartition(5)


def same(got, sql, **tables):
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(name, df.toArrow())
    want = con.sql(sql).df()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    key = lambda df: sorted(map(str, df[cols].astype(object).where(df[cols].notna(), None).itertuples(index=False, name=None)))
    assert key(got.toPandas()) == key(want)


def test_word_scan_matches_regex():
    texts = ["a  bb\tccc", None, "", " x", "long" * 400 + " y", "é ü\n"]
    found = []
    for _, data, off in text_steps(pa.array(texts)):
        starts, ends, first = word_spans(data, off, NOT_SPACE)
        raw = data.tobytes()
        found += [[raw[starts[j] : ends[j]] for j in range(first[i], first[i + 1])] for i in range(len(off) - 1)]
        assert len(set(word_hashes(data, starts, ends).tolist())) == len({w for ws in found for w in ws})
    assert found == [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()) for t in texts]


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (7, 7), (None, 3)] + [(500, 600 + i) for i in range(50)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[102] == 100 and got[640] == 500 and len(got) == 41 + 3 + 51
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates(spark, docs):
    same(near_duplicates(docs), oracle.near_dedup("documents"), documents=docs)
    assert near_duplicates(docs.limit(0)).count() == 0
    odd = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, None)], "doc_id long, text string")
    rows = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(odd).collect()}
    assert rows == {(None, 2, None, True), (1, 2, 1, True), (2, 0, 2, True)}


@pytest.mark.parametrize("seed", [5106, 6389])
def test_near_duplicates_with_unlike_bins(spark, seed):
    rng = random.Random(seed)
    ws = [f"w{rng.randrange(10**6)}" for _ in range(24)]
    df = spark.createDataFrame([(1, " ".join(ws)), (2, " ".join(ws[:-3]))], "doc_id long, text string")
    assert {(r.doc_id, r.component_id, r.kept) for r in near_duplicates(df).collect()} == {(1, 1, True), (2, 1, False)}


def test_near_duplicates_of_a_large_bucket(spark):
    rng = random.Random(3)
    base = words(rng, 60, 10_000)
    rows = []
    for i in range(400):
        ws = list(base)
        for _ in range(rng.randrange(4)):
            ws[rng.randrange(60)] = f"x{rng.randrange(10_000)}"
        rows.append((i, " ".join(ws)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    same(near_duplicates(df), oracle.near_dedup("documents"), documents=df)


def test_signature_borrows_for_empty_bins():
    one = signature(np.array([5], np.uint64))
    assert len(set(one.tolist())) == 1 and (signature(np.array([5, 9], np.uint64)) == one).any()


def test_contamination(spark, docs, texts):
    items = spark.createDataFrame([(1, texts[-3]), (2, "W1  w2"), (3, None), (4, "!!"), (None, "one"), (5, texts[-3]), (6, "ONE"), (7, "w" * 90)], "item_id long, text string")
    got = contamination(docs, items)
    got = got.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
    same(got, oracle.decontaminate("documents"), documents=docs, benchmark=items)
    passes = contamination(docs, items, pattern_bytes=400)
    one = contamination(docs, items)
    key = lambda df: sorted((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in df.collect())
    assert key(passes) == key(one)
    clash = docs.select("doc_id", "text", F.lit(1).alias("spans_0"), F.lit("a").alias("items_0"), F.lit(2).alias("hit_words"), F.lit(3).alias("n_hit"))
    for size in (400, 1 << 20):
        rows = contamination(clash, items, keep=clash.columns, pattern_bytes=size)
        assert rows.columns == ["doc_id", "text", "spans_0", "items_0", "hit_words", "n_words", "n_hit", "spans", "items"] and key(rows) == key(one)
    assert contamination(docs, items.limit(0)).agg(F.sum("n_hit")).first()[0] == 0
    assert contamination(docs.limit(0), items).count() == 0


def test_substring_dedup(spark, docs):
    same(remove_repeats(docs, texts=True).drop("kept"), oracle.substring_dedup("documents"), documents=docs)
    assert remove_repeats(docs.limit(0)).count() == 0
    odd = spark.createDataFrame([(None, "a b"), (3, " ".join("abcdefghijklmnop")), (3, " ".join("abcdefghijklmnop")), (9, "x " + " ".join("abcdefghijklmnop"))], "doc_id long, text string")
    rows = sorted(((r.doc_id or 0), r.n_removed, r.kept) for r in remove_repeats(odd).collect())
    assert rows == [(0, 0, "a b"), (3, 0, " ".join("abcdefghijklmnop")), (3, 0, " ".join("abcdefghijklmnop")), (9, 16, "x")]


def test_substring_dedup_of_a_wide_anchor(spark):
    rng = random.Random(8)
    line = " ".join(words(rng, 15, 50))
    rows = [(i, " ".join([*words(rng, 20, 9999), line, *words(rng, 20, 9999)])) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    same(remove_repeats(df, texts=False).drop("kept"), oracle.substring_dedup("documents"), documents=df)


def test_suffix_automaton_against_brute_force():
    rng = random.Random(2)
    seqs = [[rng.randrange(3) for _ in range(rng.randrange(1, 25))] for _ in range(40)]
    a = SuffixAutomaton()
    for d, s in enumerate(seqs):
        a.add(s, d)
    a.finish()
    for s in [*seqs, [0, 1, 2, 9, 0, 1, 2, 2]]:
        for k in (1, 3, 5):
            want = [min((d for d, t in enumerate(seqs) if any(t[j : j + k] == s[i : i + k] for j in range(len(t)))), default=None) for i in range(len(s) - k + 1)]
            assert a.matches(s, k) == want


def test_top_k(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=8)], 1) for i in range(350)]
    rows += [(1000 + i, rows[3][1], 1) for i in range(40)] + [(900, None, 1), (901, [], 1), (902, [1.0, None] + [0.0] * 6, 1), (903, [float("nan")] * 8, 1), (None, rows[0][1], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in top_k(df, df.where("vec_id % 100 = 0")).collect()}
    ok = [(i, np.floor(1024 * np.array(v, np.float32).astype(float)).astype(np.int64)) for i, v, _ in rows if i is not None and v and None not in v and np.isfinite(v).all()]
    for q, x in [r for r in ok if r[0] % 100 == 0]:
        best = sorted(((-int(x @ y), i) for i, y in ok if i != q))[:10]
        assert [got[q, j + 1] for j in range(10)] == [(i, -s) for s, i in best]
    odd = spark.createDataFrame([(100, [1.0, 2.0]), (100, [1.0, 2.0]), (1, [3.0]), (1, [3.0]), (2, [2.0, 0.5, 9.0]), (3, []), (4, None), (5, [-1.0, 0.0])], "vec_id long, embedding array<float>")
    same(top_k(odd, odd.where("vec_id % 100 = 0")), oracle.TOP_K, embeddings=odd)
    few = df.where("vec_id < 3")
    assert top_k(few, few).count() == 6 and top_k(df.limit(0), df).count() == 0 and top_k(df, df.limit(0)).count() == 0


def test_warc(spark):
    rows = [(i, f"http://h/{i} é", f"<p>{i % 7}é</p>", "x") for i in range(60)] + [(99, None, None, "x"), (100, "u", "", "x"), (None, "u", "<p>0é</p>", "x"), (5, "http://h/5 é", "<p>5é</p>", "x"), (200, "big", "y" * 3_000_000, "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, record_type string")
    folder = shared_dir(spark)
    manifest = write_warc(df, folder, shards=4, file_bytes=2000)
    again = shared_dir(spark)
    second = write_warc(df.repartition(7), again, shards=4, file_bytes=2000)
    files = lambda m: sorted((r.file, r.sha256) for r in m.collect())
    assert files(manifest) == files(second) and manifest.agg(F.sum("records")).first()[0] == len(rows)
    got = read_warc(spark, folder).collect()
    last = {}
    for i, _, h, _ in rows:
        if i is not None:
            last[h or ""] = max(last.get(h or "", -1), i)
    assert len(got) == len(rows)
    seen = set()
    html = {(i, u): h or "" for i, u, h, _ in rows}
    for r in sorted(got, key=lambda r: (r.page_id is not None, r.page_id or 0, r.record_type)):
        h = html[r.page_id, r.url.replace("%20", " ").replace("%C3%A9", "é") if r.url else None]
        assert r.payload_bytes == len(h.encode()) and r.payload_digest == base64.b32encode(hashlib.sha1(h.encode()).digest()).decode()
        if r.page_id == last[h] and h not in seen:
            seen.add(h)
            assert r.record_type == "response" and r.refers_to is None and bytes(r.block) == h.encode()
        else:
            assert r.record_type == "revisit" and r.refers_to == last[h]
    empty = shared_dir(spark)
    assert write_warc(df.limit(0), empty).count() == 0 and read_warc(spark, empty).count() == 0


def test_chat(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "bot", "b"), (2, 0, "user", "a"), (3, 0, "user", "a"), (3, 1, "bot", "b"), (4, 0, None, None), (4, 1, "bot", ""), (5, 0, None, None), (None, 0, "user", "z"), (6, 0, "user", "a"), (6, 0, "user", "a")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, rendered string")
    same(chat_format(df), oracle.CHAT, conversations=df)
    assert chat_format(df.limit(0)).count() == 0


@pytest.fixture(scope="session")
def pieces():
    return Pieces(open(PIECE_MODEL, "rb").read())


def scanned(p, text, size):
    t = Pieces.prepared(text)
    cuts = [*range(0, len(t), size), len(t)]
    ms = [transfer(p, t, a, b, first=a == 0) for a, b in zip(cuts, cuts[1:])]
    total = ms[0][0]
    for m in ms[1:]:
        total = (total[:, None] + m).max(0)
    out = []
    for (a, b), (e, x) in zip(zip(cuts, cuts[1:]), through(ms, 0, int(total.argmax()))):
        out += backtrace(p, t, a, b, entry_states(p, t, a, a == 0)[e], crossing(p, t, b)[x])
    return [i for s in out for i in p.ids_of(s)]


def test_parallel_scan_equals_the_library(pieces):
    import sentencepiece

    lib, rng = sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL), random.Random(1)
    for _ in range(120):
        text = "".join(rng.choice("abcdefgh the is in ing   ▁\n日本é😀0123ation er") for _ in range(rng.randint(1, 300)))
        assert scanned(pieces, text, rng.choice([16, 33, 64, 200])) == lib.encode(text)


def test_giants_equal_the_library(spark):
    import sentencepiece

    lib, rng = sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL), random.Random(9)
    prose = " ".join("".join(rng.choice(["ver", "stand", "ing", "la", "que", "tion", "über", "é", "x"]) for _ in range(rng.randint(1, 5))) for _ in range(16_000))
    dense = "".join(rng.choice("日本語のテキスト😀abc") for _ in range(66_000))
    spaces = "a" + " " * 70_000 + "b  c"
    texts = [prose, dense, spaces, prose + " ▁" + prose]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in encode(df, PIECE_MODEL).collect():
        assert r.ids == lib.encode(texts[r.doc_id]) and r.round_trip == (r.doc_id != 3)


def test_words_are_forgotten_by_use(pieces, monkeypatch):
    from tessera.llm import pieces as module

    monkeypatch.setattr(module, "MEMORY", 40)
    rng, one = random.Random(2), module.WordIds(pieces)
    for step in range(30):
        texts = [f" the {rng.randrange(10**6)} of  {step}", "", " the"]
        data, off = np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0, *map(len, texts)])
        flat, ends = one.encode(data, off)
        assert [flat[a:b].tolist() for a, b in zip(ends, ends[1:])] == [pieces.plain.encode(t) for t in texts]
        assert one.come_back(flat, ends, data, off).all() and len(one.words) < 50
    assert not one.come_back(np.append(flat, flat[:1]), np.append(ends, ends[-1] + 1), data, np.append(off, off[-1])).all()


def test_encode_and_decode(spark, docs, texts):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
    more = docs.union(spark.createDataFrame([(10_000, "▁a ▁b", "en", 1, 0.5, "x"), (10_001, "日本" * 3000, "en", 1, 0.5, "x"), (10_001, "日本" * 3000, "en", 1, 0.5, "x")], DOCS))
    rows = encode(more, PIECE_MODEL, giant=5000, chunk=700).collect()
    own = dict(enumerate(texts)) | {10_000: "▁a ▁b", 10_001: "日本" * 3000}
    assert len(rows) == len(texts) + 3
    for r in rows:
        assert r.ids == lib.encode(own[r.doc_id] or "") and r.n_tokens == len(r.ids) and r.round_trip == ("▁" not in (own[r.doc_id] or ""))
    back = {r.doc_id: r.text for r in decode(encode(docs, PIECE_MODEL), PIECE_MODEL).collect()}
    assert all(back[i] == (t or "") for i, t in enumerate(texts))
    assert encode(docs.limit(0), PIECE_MODEL).count() == 0


def test_training_order(spark):
    for n in (1, 2, 3, 4, 100, 4096, 4097):
        p = Permutation(n, "k")
        slots = p.slot(np.arange(n))
        assert sorted(slots.tolist()) == list(range(n)) and (p.index(slots) == np.arange(n)).all()
    rows = [(1, [5] * 10), (2, []), (3, None), (4, list(range(23))), (4, [65535]), (4, [65535]), (None, [1]), (-7, [9] * 9), (2**62, [1, 2, 3])]
    df = spark.createDataFrame(rows, "doc_id long, ids array<int>")
    want = [(d, i // 8, ids[i : i + 8]) for d, ids in rows if d and ids for i in range(0, len(ids), 8)]
    orders = []
    for source in (df.repartition(1), df.repartition(3, "ids"), df.repartition(7)):
        folder = shared_dir(spark)
        write_training_order(source, folder, "key", length=8, at=domain(source, F.size("ids"), 8, shards=3))
        got = sorted((r.slot, r.doc_id, r.part, list(r.ids)) for r in read_training_order(spark, folder).withColumn("ids", token_array(F.col("tokens"))).collect())
        assert [g[0] for g in got] == list(range(len(want)))
        assert sorted(g[1:] for g in got) == sorted(want)
        orders.append([g[1:] for g in got])
    assert orders[0] == orders[1] == orders[2]
    assert [r.slot for r in read_training_order(spark, folder, 2, 5).orderBy("slot").collect()] == [2, 3, 4]
    wide = shared_dir(spark)
    write_training_order(spark.createDataFrame([(1, [70_000])], df.schema), wide, "key", width=4)
    assert read_training_order(spark, wide).select(token_array(F.col("tokens"), 4)).first()[0] == [70_000]
    empty = shared_dir(spark)
    assert write_training_order(df.limit(0), empty, "key").count() == 0 and read_training_order(spark, empty).count() == 0


def test_training_order_mixes_documents(spark):
    df = spark.createDataFrame([(i, [i] * 40) for i in range(500)], "doc_id long, ids array<int>")
    folder = shared_dir(spark)
    manifest = write_training_order(df, folder, "key", length=8)
    sizes = [r.records for r in manifest.collect()]
    assert sum(sizes) == 2500 and max(sizes) < 110
    docs = [r.doc_id for r in read_training_order(spark, folder).orderBy("slot").collect()]
    assert abs(np.corrcoef(np.arange(2500), docs)[0, 1]) < 0.08 and abs(np.corrcoef(docs[1:], docs[:-1])[0, 1]) < 0.08


BASE = [("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 6), ("access", re.compile("AKIA[A-Z0-9]+"), 0, 20), ("hex", re.compile("[0-9a-f]+"), 0, 24)]


def test_secrets(spark):
    rng = random.Random(4)
    key = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(60))
    hexa = "".join(rng.choice("0123456789abcdef") for _ in range(40))
    texts = [None, "", "plain words only", f"😀 token: {hexa} é", f"secret: token: abcdefg password='abc' PASSWORD=abcdef", f"AKIA{'A1' * 8} x AKIAABC", f"see {key} here", f"{hexa}{hexa} {hexa[:23]}g", "api_key = abc.def=", "a1" * 40, "x " * 50_000 + f"token={key}"]
    df = spark.createDataFrame([(i, t, "en", "y") for i, t in enumerate(texts)] + [(3, texts[3], "en", "y")], "doc_id long, text string, lang string, spans string")
    rows = secret_spans(df).withColumn("base", written("base_spans")).withColumn("all", written("spans")).collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        t = texts[r.doc_id] or ""
        want = sorted((m.start(), i, m.end()) for i, (_, p, g, least) in enumerate(BASE) for m in p.finditer(t) if len(m.group(g)) >= least)
        assert r.base == ",".join(f"{BASE[i][0]}:{a}:{b}" for a, i, b in want)
        assert set(filter(None, r.base.split(","))) <= set(r["all"].split(","))
    found = {r.doc_id: r["all"] for r in rows}
    assert "random:4:64" in found[6] and found[2] == "" and "random" not in found[9]
    text = secret_spans(df, keep=["doc_id", "text"]).select("doc_id", redacted(F.col("text"), F.col("spans")).alias("t")).collect()
    assert {r.doc_id: r.t for r in text}[6] == "see [secret] here" and list(KINDS) == [b[0] for b in BASE]
    assert secret_spans(df.limit(0)).count() == 0


def plain_battery(value):
    """The battery of one string, written out with the exact normal distribution."""
    import math

    from tessera.llm.secrets import ENCODINGS, MARGIN, ORDER, PROSE3_EXCESS

    body = value.rstrip("=")
    e = next(e for e in ENCODINGS if re.match(e.pattern, body))
    plain = body.lower() if e.name == "hex" else body.translate(str.maketrans("-_", "+/"))
    c, k = np.array([e.symbols.index(x) for x in plain], float), len(e.symbols)
    n, tail = len(c), lambda z: math.erfc(z / math.sqrt(2)) / 2
    uniform = (np.unique(c, return_counts=True)[1] ** 2).sum() * k / n - n
    p_uniform = tail(((n - 1) * (k * e.prose2 - 1) + k - 1 - uniform) / math.sqrt(4 * n * k * k * PROSE3_EXCESS + 2 * (k - 1)))
    high = c >= k / 2
    mean = 2 * high.sum() * (n - high.sum()) / n
    z2 = ((high[1:] != high[:-1]).sum() - mean) / math.sqrt(mean * (mean - 1) / (n - 1)) if 0 < high.sum() < n and mean > 1 else n
    spread = n * (c * c).sum() - c.sum() ** 2
    z3 = ((n * (c * np.roll(c, -1)).sum() - c.sum() ** 2) / spread + 1 / (n - 1)) * math.sqrt(n) if spread > 0 else n
    edge = ORDER * math.sqrt(n) + MARGIN
    return n, e.name, max(p_uniform, tail(edge - abs(z2)), tail(edge - abs(z3)))


def test_battery_and_false_discoveries(spark):
    import math

    from tessera.llm.secrets import BINS, FDR, LENGTHS, RUN, STEP

    rng = random.Random(21)
    alphabets = ["0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_-"]
    runs = ["".join(rng.choice(a) for _ in range(rng.choice([20, 23, 30, 40, 64, 120]))) for a in alphabets for _ in range(60)]
    made = ["four2word-names-like-these", "aaaa1111aaaa1111aaaa1111", "abcdefghijklmnopqrstuvwxyz0123456789", "A1" * 30, "0" * 19 + "a", "Zz9" * 20, "release-notes-2024-final-version", "0123456789abcdef" * 4]
    runs = [r for r in [*runs, *made * 3] if re.fullmatch(RUN, r) and re.search("[0-9]", r) and re.search("[A-Za-z]", r)]
    df = spark.createDataFrame([(i, f"see {r} here") for i, r in enumerate(runs)], "doc_id long, text string")
    got = {r.doc_id: "random" in r.spans for r in secret_spans(df).select("doc_id", written("spans").alias("spans")).collect()}
    tests = [plain_battery(r) for r in runs]
    level = [min(BINS, math.floor(-math.log10(max(p, 1e-90)) * STEP)) for _, _, p in tests]
    length = [sum(n >= edge for edge in LENGTHS) for n, _, _ in tests]
    for c in set(length):
        own = [v for v, x in zip(level, length) if x == c]
        good = [v for v in set(own) if 10 ** (-v / STEP) <= FDR * sum(w >= v for w in own) / len(own)]
        limit = min(good, default=BINS + 1)
        for i, (v, x) in enumerate(zip(level, length)):
            if x == c and abs(v - limit) > 1:
                assert got[i] == (v >= limit), (runs[i], tests[i], limit)
    long = [got[i] for i, r in enumerate(runs) if r not in made and len(r) >= 30 and tests[i][1] != "base32"]
    assert sum(long) / len(long) > 0.95 and not any(got[i] for i, r in enumerate(runs) if r in made)


def test_toxicity(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(900):
        ws, bad = words(rng, 30, 80), i % 4 == 0
        if bad:
            ws[rng.randrange(30)] = rng.choice(["grimble", "snark"])
        rows.append((i, " ".join(ws), 0.5))
        labels.append((i, int(bad) if rng.random() > 0.03 else int(not bad)))
    rows += [(5000, None, 0.1), (5001, "", 0.1), (5001, "", 0.1), (None, "grimble", 0.1), (5002, "w1 " * 60_000 + "grimble snark", 0.1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score double")
    got = toxicity(df, spark.createDataFrame([*labels, (None, 1), (7, None)], "doc_id long, toxic int")).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    import zlib

    held = [r for r in got if r.doc_id is not None and r.doc_id < 900 and r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got if r.doc_id is not None)
    assert sum(r.predicted == (r.doc_id % 4 == 0) for r in held) / len(held) > 0.95
    none = toxicity(df, spark.createDataFrame([], "doc_id long, toxic int"))
    assert none.agg(F.max("score")).first()[0] == 0.0 and toxicity(df.limit(0), spark.createDataFrame([], "doc_id long, toxic int")).count() == 0


def test_toxicity_of_rare_words(spark):
    rng = random.Random(16)
    rows, labels = [], []
    for i in range(2400):
        ws, bad = words(rng, 30, 60), i % 10 == 0
        if bad:
            ws[rng.randrange(30)] = f"slur{i // 10 % 20}"
        rows.append((i, " ".join(ws)))
        labels.append((i, int(bad)))
    copied = " ".join(f"c{j}" for j in range(200))
    rows += [(3000 + i, f"{copied} end{i}") for i in range(60)]
    labels += [(3000 + i, int(i < 8)) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [r for r in toxicity(df, spark.createDataFrame(labels, "doc_id long, toxic int")).collect() if r.held_out]
    bad = [r.predicted for r in got if r.doc_id < 3000 and r.doc_id % 10 == 0]
    good = [r.predicted for r in got if r.doc_id >= 3000 or r.doc_id % 10]
    assert len(bad) > 40 and sum(bad) / len(bad) > 0.9 and sum(good) / len(good) < 0.01


def test_toxicity_of_a_pair(spark):
    rng = random.Random(17)
    rows, labels = [], []
    for i in range(2400):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        rows.append((i, " ".join([*words(rng, 20, 40), *["left"] * a, *["right"] * b])))
        labels.append((i, int(a and b)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    truth = dict(labels)
    got = [r for r in toxicity(df, spark.createDataFrame(labels, "doc_id long, toxic int"), threshold=0.5).collect() if r.held_out]
    assert sum(r.predicted == truth[r.doc_id] for r in got) / len(got) > 0.95


def test_pipeline_keeps_clean_documents(spark, tmp_path):
    import corpus_pipeline as cp

    src = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{src}/documents.parquet")
    for name, stage in cp.STAGES[1:4]:
        out = stage(spark, docs, src)
        assert out.columns == docs.columns, name
    ids = {r.doc_id for r in cp.near_dedup(spark, docs, src).collect()}
    pdf = docs.toPandas()
    con = duckdb.connect()
    con.register("documents", pdf)
    kept = con.sql(f"SELECT doc_id FROM ({oracle.near_dedup()}) WHERE kept").df().doc_id
    assert ids == set(kept)
    bench = spark.read.parquet(f"{src}/benchmark.parquet").toPandas()
    con.register("benchmark", bench)
    clean = con.sql(f"SELECT doc_id FROM ({oracle.decontaminate()}) WHERE NOT contaminated").df().doc_id
    assert {r.doc_id for r in cp.decontaminate(spark, docs, src).collect()} == set(clean)
    assert pd.Series(list(ids)).isin(pdf.doc_id).all()


STRANGE = "label int, candidates string, score double, spans string, n_hit long, items string, terms long, Features string, ids string, component_id long, kept boolean, text_key string, n_chars long"


def test_pipeline_with_clashing_columns(spark, tmp_path):
    import corpus_pipeline as cp

    rng = random.Random(12)
    body = [" ".join(words(rng, 40, 5000)) for _ in range(300)]
    insult = [f"{' '.join(words(rng, 20, 5000))} grimble" for _ in range(60)]
    item = " ".join(words(rng, 25, 10**6))
    rows = [(i, t) for i, t in enumerate(body)] + [(1000 + i, t) for i, t in enumerate(insult)]
    rows += [(2000, body[0]), (2001, body[1] + " more"), (2002, "a b " + item + " c"), (2003, "password: hunter22 x"), (2004, None), (2005, ""), (None, "no id"), (2006, "one"), (2006, "one"), (2007, "z " * 40_000 + "end")]
    extra = (1, "c", 0.25, "s", 7, "i", 3, "f", "x", 5, True, "k", 9)
    df = spark.createDataFrame([(*r, *extra) for r in rows], "doc_id long, text string, " + STRANGE)
    src = str(tmp_path)
    df.write.parquet(f"{src}/documents.parquet")
    spark.createDataFrame([(i, int(i >= 1000)) for i, _ in rows if i is not None and i < 1060], "doc_id long, toxic int").write.parquet(f"{src}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{src}/benchmark.parquet")
    docs = df
    for name, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, src)
        assert docs.columns == df.columns and docs.schema == df.schema, name
        assert stage(spark, df.limit(0), src).count() == 0, name
    got = {(r.doc_id, r.text): r for r in docs.collect()}
    ids = [i for i, _ in got]
    assert not [i for i in ids if i is not None and 1000 <= i < 1060] and not {2000, 2001, 2002} & set(ids)
    assert set(range(300)) <= set(ids) and {2003, 2004, 2005, 2006, 2007, None} <= set(ids)
    assert (2003, "[secret] x") in got and got[2003, "[secret] x"].n_chars == 10 and got[2006, "one"][2:] == extra
    out = cp.run(spark, src)
    assert out.columns == [c for c in df.columns if c not in ("text", "ids")] + ["n_tokens", "ids", "round_trip"]
    rows = out.collect()
    assert len(rows) == docs.count() and all(r.round_trip and r.candidates == "c" for r in rows)


def test_intersections_of_blocks(monkeypatch):
    from tessera.llm import near_dedup as module

    monkeypatch.setattr(module, "SHARED", 7)
    rng = random.Random(4)
    sets = [np.array(sorted(rng.sample(range(60), rng.randrange(1, 40))), np.uint64) for _ in range(23)]
    got = module._intersections(sets[:9], sets[9:])
    assert got.tolist() == [[len(set(a.tolist()) & set(b.tolist())) for b in sets[9:]] for a in sets[:9]]
    assert module._intersections([np.array([1], np.uint64)], [np.array([2], np.uint64)]).tolist() == [[0.0]]
