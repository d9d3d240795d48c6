"""Imports in several runs, versions that switch as a whole, digests of ordered tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import digests as D
from tessera.operators import mentions as N
from tessera.plans.operations import _folder
from tessera.plans.registry import checkpoints, query, table
from tessera.sources import vectors as V
from tessera.sources.files import write_json_lines
from tessera.streaming import imports as I

ORDER = "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string"


def _parsed(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Orders, and the lines that name no customer above 10."""
    rows = lines.select("line", F.from_json("value", ORDER).alias("r")).select("line", "r.*")
    return rows.where("o_custkey > 10").drop("line"), rows.where("not coalesce(o_custkey > 10, false)").select("line", "o_orderkey")


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority FROM orders WHERE o_custkey > 10")
def source_chained_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders as JSON lines, imported in three runs of which each goes on where the chain of the last one ended."""
    base, names = _folder(spark), [c.split()[0] for c in ORDER.split(", ")]
    orders = table(spark, sf_dir, "orders").select(*names)
    write_json_lines(orders, f"{base}/in", ["o_orderkey"])
    third = orders.count() // 3 + 1
    for _ in range(3):
        I.chained_import(spark, f"{base}/in", f"{base}/out", _parsed, budget=third)
    return I.imported(spark, f"{base}/out").select(*names)


@query("""SELECT c_custkey, CASE WHEN c_custkey % 9 = 0 THEN 'added' WHEN c_custkey % 9 = 1 THEN 'removed' WHEN c_custkey % 4 = 0 THEN 'changed' ELSE 'kept' END AS state FROM customer""")
def sink_version_switch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two versions of the customers come in as a whole; between them a third fails on its last file and serves nobody."""
    base, kind = _folder(spark), "c_custkey long, c_name string, c_acctbal double"
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    new = rows.where("c_custkey % 9 <> 1").withColumn("c_acctbal", F.when(F.col("c_custkey") % 4 == 0, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")))
    rows.where("c_custkey % 9 <> 0").repartition(2).write.parquet(f"{base}/old")
    new.repartition(2).write.parquet(f"{base}/new")
    I.import_version(spark, f"{base}/old", kind, f"{base}/store", "v1")
    before = I.current(spark, f"{base}/store")
    try:
        I.import_version(spark, f"{base}/new", kind, f"{base}/store", "broken", valid="c_custkey < 0")
    except ValueError:
        pass
    I.import_version(spark, f"{base}/new", kind, f"{base}/store", "v2", valid="c_custkey >= 0")
    return I.reconciled(before, I.current(spark, f"{base}/store"), "c_custkey")


FRAME = ("p_partkey", "p_name", "p_brand", "p_type", "p_size")


@query(f"""WITH r AS (SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS i, sha256('[["int",' || p_partkey || '],["str","' || p_name || '"],["str","' || p_brand || '"],["str","' || p_type || '"],["int",' || p_size || ']]') AS sha FROM part),
a AS (SELECT i // {D.FAN} AS i, sha256(string_agg(sha, ',' ORDER BY i)) AS sha FROM r GROUP BY ALL), b AS (SELECT i // {D.FAN} AS i, sha256(string_agg(sha, ',' ORDER BY i)) AS sha FROM a GROUP BY ALL),
c AS (SELECT sha256(string_agg(sha, ',' ORDER BY i)) AS sha FROM b), n AS (SELECT count(*) AS n FROM part)
SELECT n, sha256('{"".join(f"{c}" + chr(39) + " || chr(0) || " + chr(39) for c in FRAME)}' || CASE WHEN n <= {D.FAN} THEN (SELECT any_value(sha) FROM a) WHEN n <= {D.FAN ** 2} THEN (SELECT any_value(sha) FROM b) ELSE (SELECT sha FROM c) END) AS sha256 FROM n""")
def performance_frame_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    checkpoints(spark)
    part = table(spark, sf_dir, "part").select(*FRAME)
    return spark.createDataFrame([(part.count(), D.ordered_digest(part, FRAME, ["p_partkey"]))], "n long, sha256 string")


@query("""SELECT vec_id, 'h' || vec_id % 7 AS content_hash, len(embedding) AS dims, round(embedding[1]::DOUBLE + CASE WHEN vec_id % 50 = 3 THEN 1 ELSE 0 END, 5) AS first, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)) + CASE WHEN vec_id % 50 = 3 THEN 1 ELSE 0 END, 4) AS total
FROM embeddings WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0""")
def source_vector_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector in a first index, a changed one in a second that takes over the shards without a change."""
    base = _folder(spark)
    rows = table(spark, sf_dir, "embeddings").where("vec_id is not null and not exists(embedding, x -> x is null or isnan(x) or abs(x) = float('inf'))")
    rows = rows.select(F.col("vec_id").alias("id"), F.concat(F.lit("h"), F.col("vec_id") % 7).alias("content_hash"), F.col("embedding").alias("vector"))
    dims = rows.select(F.size("vector").alias("n")).first().n
    V.write_index(rows, f"{base}/index", "v1", dims)
    changed = rows.withColumn("vector", F.when(F.col("id") % 50 == 3, F.transform("vector", lambda x, i: F.when(i == 0, x + 1).otherwise(x))).otherwise(F.col("vector")))
    V.write_index(changed, f"{base}/index", "v2", dims, earlier="v1")
    total = F.aggregate("vector", F.lit(0.0), lambda t, x: t + x)
    return V.read_index(spark, f"{base}/index", "v2").select(F.col("id").alias("vec_id"), "content_hash", F.size("vector").alias("dims"), F.round(F.col("vector")[0].cast("double"), 5).alias("first"), F.round(total, 4).alias("total"))


NAMED = "SELECT DISTINCT split_part(p_name, ' ', 1) AS entity, split_part(p_name, ' ', 1) AS name FROM part UNION ALL SELECT DISTINCT p_type, split_part(p_name, ' ', 1) || ' ' || split_part(p_name, ' ', 2) FROM part WHERE p_size < 4"


@query(f"""WITH n AS (SELECT name, list_sort(list(DISTINCT entity)) AS es FROM ({NAMED}) GROUP BY 1), t AS (SELECT p_partkey AS id, string_split(p_name, ' ') AS ws FROM part),
g AS (SELECT id, s, k, array_to_string(ws[s:s + k - 1], ' ') AS name FROM t, range(1, 4) a(s), range(1, 3) b(k) WHERE s + k - 1 <= len(ws)), m AS (SELECT id, s, k, es FROM g JOIN n USING (name)),
w AS (SELECT * FROM m WHERE NOT EXISTS (SELECT 1 FROM m x WHERE x.id = m.id AND x.k > m.k AND x.s <= m.s AND x.s + x.k >= m.s + m.k)), e AS (SELECT id, list(DISTINCT e) AS es FROM (SELECT id, unnest(es) AS e FROM w) GROUP BY 1)
SELECT t.id, CASE WHEN es IS NULL THEN 'unknown' WHEN len(es) > 1 THEN 'ambiguous' ELSE 'matched' END AS outcome, CASE WHEN len(es) = 1 THEN es[1] END AS entity FROM t LEFT JOIN e USING (id)""")
def text_named_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts by the names in their titles: colours are entities, and so are the kinds that some pairs of words name."""
    part = table(spark, sf_dir, "part")
    words = F.split("p_name", " ")
    one = part.select(words[0].alias("entity"), words[0].alias("name")).distinct()
    two = part.where("p_size < 4").select(F.col("p_type").alias("entity"), F.concat_ws(" ", words[0], words[1]).alias("name")).distinct()
    return N.named_entities(part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("text")), one.union(two))
