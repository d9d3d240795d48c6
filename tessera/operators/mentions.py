"""Names of known entities in texts: the longest wins, and a text that names two is refused."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import search_tokens

#: Texts of an outcome (fixed values).
MATCHED, AMBIGUOUS, UNKNOWN = "matched", "ambiguous", "unknown"


def _words(text: str) -> Column:
    return F.coalesce(search_tokens(F.col(text)), F.array().cast("array<string>"))


def mentions(texts: DataFrame, names: DataFrame) -> DataFrame:
    """``(id, start, size, name, entities)``: the maximal occurrences of ``names`` (entity, name) in ``texts`` (id, text).

    Names and texts are compared by their tokens.  Every run of tokens as long as some name that begins with the same
    token is looked up by equality, so that a text is never held against all names; an occurrence inside a longer
    one is dropped.  Names without a token and null texts match nothing; equal ids share one text's fate only if their
    texts are equal, since a row's occurrences are found in the row itself.
    """
    known = names.select("entity", _words("name").alias("words")).where(F.size("words") > 0).groupBy("words").agg(F.array_sort(F.collect_set("entity")).alias("entities"))
    sizes = known.groupBy(F.col("words")[0].alias("head")).agg(F.sort_array(F.collect_set(F.size("words"))).alias("sizes"))
    rows = texts.select("id", F.xxhash64("text").alias("same"), _words("text").alias("words")).distinct()
    starts = rows.select("id", "same", "words", F.posexplode("words").alias("start", "head"))
    runs = starts.join(sizes, "head").select("id", "same", "start", F.explode("sizes").alias("size"), "words").where("start + size <= size(words)")
    found = runs.select("id", "same", "start", "size", F.slice("words", F.col("start") + 1, F.col("size")).alias("words")).join(known, "words")
    # of those that begin earlier, or here and longer, one that reaches as far holds this one
    before = Window.partitionBy("id", "same").orderBy("start", F.desc("size")).rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max(F.col("start") + F.col("size")).over(before)
    whole = found.withColumn("reach", reach).where("reach is null or reach < start + size")
    return whole.select("id", "same", "start", "size", F.array_join("words", " ").alias("name"), "entities")


def named_entities(texts: DataFrame, names: DataFrame) -> DataFrame:
    """``(id, outcome, entity)`` for each text: matched if its maximal names are all of one entity, else ambiguous or unknown."""
    found = mentions(texts, names).groupBy("id", "same").agg(F.array_distinct(F.flatten(F.collect_list("entities"))).alias("all"))
    rows = texts.select("id", F.xxhash64("text").alias("same"))
    outcome = F.when(F.col("all").isNull(), UNKNOWN).when(F.size("all") > 1, AMBIGUOUS).otherwise(MATCHED)
    return rows.join(found, [rows["id"].eqNullSafe(found["id"]), rows["same"] == found["same"]], "left").select(rows["id"], outcome.alias("outcome"), F.when(F.size("all") == 1, F.col("all")[0]).alias("entity"))
