"""The registered queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import bpe, embeddings, langid, linedup, minhash, mixing, ogg, pii, toxicity, warc
from gridloom.llm.common import table


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every whole text."""
    return pii.report(pii.extract(table(spark, sf_dir, "documents")))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text encoded and decoded again."""
    coded = bpe.round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=False)
    return coded.select("doc_id", (F.octet_length("tokens") / 4).cast("long").alias("n_tokens"), F.sha2("tokens", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to the weights of their sources: how many words of each the mix takes."""
    planned = mixing.plan(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return planned.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), (F.col("mix_size") * F.col("mix_copies")).alias("taken"))


OP1_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY source_size::DOUBLE / w, source NULLS LAST) AS k FROM r),
c AS (SELECT a.k, a.w, a.source_size,
        ((SELECT sum(source_size) FROM o) - 3 * coalesce((SELECT sum(b.source_size) FROM o b WHERE b.k < a.k), 0))::DOUBLE AS rest,
        ((SELECT sum(w) FROM o) - coalesce((SELECT sum(b.w) FROM o b WHERE b.k < a.k), 0))::DOUBLE AS share FROM o a),
l AS (SELECT k, rest, share FROM c WHERE rest * w <= 3 * source_size * share ORDER BY k LIMIT 1),
t AS (SELECT o.source, o.source_size, CASE WHEN o.source_size = 0 THEN 0.0::DOUBLE WHEN l.k IS NULL OR o.k < l.k THEN (3 * o.source_size)::DOUBLE ELSE o.w * l.rest / l.share END AS target FROM o LEFT JOIN l ON true),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
        ('0x' || substr(md5('gridloom-mix-1:' || d.doc_id), 1, 13))::BIGINT::DOUBLE / 4503599627370496 AS draw
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (size * (floor(rate)::BIGINT + (draw < rate - floor(rate))::BIGINT))::BIGINT AS taken FROM p
"""


def op2_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text stored in Ogg, read back and described."""
    read = ogg.load(ogg.store(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"))
    return read.select(
        "doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), F.crc32(F.expr("substring(payload, -16, 16)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature", "sound",
    )


def op3_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate links and components of all vectors."""
    return embeddings.link(table(spark, sf_dir, "embeddings"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to archives, and what is read back from them."""
    return warc.read(warc.write(table(spark, sf_dir, "pages"))).drop("url")


OP4_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS top, sha1(html) AS hex FROM p),
g AS (SELECT *, list_transform(range(8), lambda i: ('0x' || substr(hex, (5 * i + 1)::INT, 5))::INT) AS fives FROM m),
b AS (SELECT *, list_transform(fives, lambda v: list_aggregate(list_transform([15, 10, 5, 0], lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> k) & 31) + 1, 1)), 'string_agg', '')) AS parts FROM g)
SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, list_aggregate(parts, 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to FROM b
"""


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score for every whole text, learned from the labels outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return minhash.dedup(table(spark, sf_dir, "documents")).drop("h1", "h2", "keeper")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the three-line windows that occurred before."""
    return linedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP9_SQL = r"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
i AS (SELECT doc_id, l, unnest(range(len(l) - 2)) AS i FROM d WHERE len(l) >= 3),
w AS (SELECT doc_id, i, array_to_string(l[i + 1 : i + 3], chr(10)) AS t FROM i),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY t ORDER BY doc_id, i) AS rn FROM w WHERE NOT regexp_full_match(t, '\s*')),
g AS (SELECT doc_id, list(i) AS starts FROM r WHERE rn > 1 GROUP BY doc_id),
k AS (SELECT d.doc_id, d.text, d.l, g.starts, CASE WHEN g.starts IS NULL THEN d.l ELSE list_filter(d.l, lambda x, n: NOT list_has_any(g.starts, [n - 1, n - 2, n - 3])) END AS kept FROM d LEFT JOIN g USING (doc_id))
SELECT doc_id, CASE WHEN text IS NULL THEN NULL ELSE coalesce(array_to_string(kept, chr(10)), '') END AS text, coalesce(len(l), 0)::BIGINT AS n_lines, coalesce(len(l) - len(kept), 0)::BIGINT AS n_removed FROM k
"""


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole text, learned from the labels outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit(docs))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_ogg": op2_ogg,
    "op3_embeddings": op3_embeddings,
    "op4_warc": op4_warc,
    "op5_toxicity": op5_toxicity,
    "op6_pii": op6_pii,
    "op7_bpe": op7_bpe,
    "op8_minhash": op8_minhash,
    "op9_line_dedup": op9_line_dedup,
    "op10_language": op10_language,
}

ORACLE_SQL: dict[str, str] = {
    "op1_mixing": OP1_SQL,
    "op4_warc": OP4_SQL,
    "op9_line_dedup": OP9_SQL,
}
