"""A training corpus from `documents`, in five stages; each stage's rows are a Parquet table that the next one reads.

Language ID rejects documents that have no letter or no language of probability MIN_LANGUAGE; line dedup
rewrites texts without repeated three-line windows, and lets go what has no text left; near-dedup keeps
one document of each component; mixing repeats or leaves out documents by source; BPE encodes what is left.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import bpe, langid, linedup, minhash, mixing
from gridloom.llm.common import settle, table

MIN_LANGUAGE = 0.5
#: The columns of `documents` that stages read or write.
USED = ("doc_id", "text", "lang", "source", "n_chars")


def numbered(docs: DataFrame) -> DataFrame:
    """`docs` with columns that are no part of the contract under numbers, so that no user's name meets one of a stage's."""
    return docs.select(*(F.col(f"`{c}`").alias(c if c in USED else f"own_{i}") for i, c in enumerate(docs.columns)))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a known language.  Null, empty and letterless texts are rejected; null languages are not learned from; repeated rows fare alike."""
    rows = numbered(docs)
    found = langid.predict(rows, langid.fit(rows))
    return found.filter((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= MIN_LANGUAGE)).select(*rows.columns).toDF(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the windows that occurred before; n_chars follows the text.  Null and empty texts stay as they are; repeated rows are one document."""
    rows = numbered(docs)
    found = linedup.dedup(rows)
    kept = found.filter((F.col("n_removed") == 0) | F.col("text").rlike(r"\S"))
    if "n_chars" in rows.columns:
        kept = kept.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(rows.schema["n_chars"].dataType))
    return kept.select(*rows.columns).toDF(*docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component, of the smallest id; null and empty texts are linked with nothing; repeated rows are one document."""
    rows = numbered(docs)
    keepers = minhash.dedup(rows.select("doc_id", "text")).filter("keeper").select("h1", "h2").distinct()
    keyed = rows.select(F.struct(*rows.columns).alias("doc"), *minhash.row_hashes("doc_id", "text"))
    kept = keyed.join(keepers, ["h1", "h2"], "left_semi").dropDuplicates(["h1", "h2"])
    return kept.select("doc.*").toDF(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target asks for; null sources are one source, texts without words weigh nothing."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, tokens (packed little-endian unsigned 32-bit ids) and decoded_sha256, of the text that they decode to; a null text encodes to nothing and decodes to the empty text."""
    coded = bpe.round_trip(docs.select("doc_id", "source", "text"), keep=False)
    return coded.select("doc_id", "source", (F.octet_length("tokens") / 4).cast("long").alias("n_tokens"), "tokens", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("language_id", language),
    ("line_dedup", lines),
    ("near_dedup", near),
    ("source_mixing", mix),
    ("bpe_encoding", encode),
]

#: Language ID and near-dedup can't be written in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
