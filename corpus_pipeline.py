"""From raw documents to token ids: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import cut
from tessera.llm.decontaminate import contamination
from tessera.llm.near_dedup import near_duplicates
from tessera.llm.pieces import encode
from tessera.llm.queries import PIECE_MODEL, table
from tessera.llm.secrets import redacted, secret_spans
from tessera.llm.toxicity import fit, score

TOXIC, SIMILAR, WINDOW = 0.3, 85, 10


def apart(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with reserved names for all columns but doc_id and text, so that none clashes with an operator's."""
    names = {c: c if c in ("doc_id", "text") else f"kept_{i}" for i, c in enumerate(docs.columns)}
    return docs.select(*[docs[c].alias(n) for c, n in names.items()]), names


def back(rows: DataFrame, names: dict[str, str]) -> DataFrame:
    return rows.select(*[F.col(n).alias(c) for c, n in names.items()])


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score TOXIC or more go; the model learns from the labelled ones among them.

    A null or empty text gets the score of a text without known words and stays unless such texts are toxic; a
    null doc_id has no label but a score; repeated rows share their fate.  Without labels of both classes all stay.
    """
    rows, names = apart(docs)
    model = fit(rows, table(spark, sf_dir, "labels"))
    return back(score(rows, model).where(F.col("score") < TOXIC), names)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest doc_id stays.

    Null, empty and wordless texts and null ids are nobody's copies and stay; rows that share a doc_id are one
    document and stay or go together.
    """
    gone = near_duplicates(docs, threshold=SIMILAR, k=5).where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(cut(gone), "doc_id", "left_anti").select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go.

    Null and empty texts hold none and stay, null ids count like others, repeated rows share their fate; with an
    empty benchmark all stay.
    """
    rows, names = apart(docs)
    return back(contamination(rows, table(spark, sf_dir, "benchmark"), k=WINDOW, keep=rows.columns).where("n_hit = 0"), names)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced by a mark; n_chars follows.

    No document goes; null texts stay null, empty ones empty; repeated rows give repeated results.
    """
    rows, names = apart(docs)
    found = secret_spans(rows, keep=rows.columns)
    found = found.withColumn("text", redacted(F.col("text"), F.col("spans")))
    if "n_chars" in names:
        n = names["n_chars"]
        found = found.withColumn(n, F.when(F.size("spans") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col(n)))
    return back(found, names)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every remaining text, beside the other columns (n_tokens, ids and round_trip are replaced).

    Null and empty texts have no ids; repeated rows give repeated results.
    """
    rows, names = apart(docs)
    keep = {c: n for c, n in names.items() if c != "text" and c.lower() not in ("n_tokens", "ids", "round_trip")}
    out = encode(rows, PIECE_MODEL, keep=list(keep.values()))
    return back(out, keep | {c: c for c in ("n_tokens", "ids", "round_trip")})


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("secrets", secrets),
    ("pieces", pieces),
]

#: A learnt score and a subword model aren't SQL; the tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again; an empty table runs through to an empty result."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs
