"""Mixing sources to target weights (operator 1).

Words are summed by source, a target is derived for every source from its weight, and a document
is emitted floor(rate) times, rate being its source's target over its source's words, plus once more
with the probability of the fraction, decided by a hash of the seed and the document's id, so that
reruns agree.

Targets share all words by weight; none exceeds `ceiling` times its source, and what a source
cannot take is shared again by weight among the others until none is above.  That is a level L with
target = min(ceiling * size, L * weight).  Sources in the order of ceiling * size / weight are capped
from the first, so running sums over the per-source totals find L without iteration.  The
per-source table has one row a source, whatever the number of documents, and is joined back, never
collected; the sums by source are partial before they are shuffled, so a hot source costs nothing.

Defined results: a null or empty text has size 0; null sources form one source, ordered last; a
source of size 0 has target 0; rows with a null id share one draw for each text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import WORD, settle

WEIGHTS = (5, 2, 1)
CEILING = 3
SEED = "gridloom-mix-1"
BROADCAST_SOURCES, BROADCAST_LETTERS = 50_000, 2_000_000
SALTS = 32


def size_of(text_col: str) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")


def draw(*parts: Column) -> Column:
    """A number in [0, 1) of 52 bits from the md5 of the seed and the parts."""
    text = F.concat_ws(":", F.lit(SEED), *parts)
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long").cast("double") / F.lit(float(1 << 52))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, ceiling: int = CEILING) -> DataFrame:
    """source, source_size, weight and target from one row a source (source, source_size).

    Both windows run over the per-source totals in one task; that table doesn't grow with the documents of a source.
    """
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(in_order) - 1) % len(weights)
    ranked = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (place + 1).cast("int")).cast("long"))
    # Capped sources come first: in the order of size / weight, ties by source.
    ratio = F.col("source_size").cast("double") / F.col("weight").cast("double")
    ordered = ranked.withColumn("place", F.row_number().over(Window.orderBy(ratio, F.col("source").asc_nulls_last())))
    before = Window.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("place").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # With all sources before this one capped, L = rest / share; the first source that L leaves below its ceiling ends the capped ones.
    rest = (F.sum("source_size").over(everything) - ceiling * F.coalesce(F.sum("source_size").over(before), F.lit(0))).cast("double")
    share = (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))).cast("double")
    level = ordered.withColumn("rest", rest).withColumn("share", share)
    fits = F.col("rest") * F.col("weight") <= ceiling * F.col("source_size") * F.col("share")
    first = F.min(F.when(fits, F.struct("place", "rest", "share"))).over(everything)
    capped = F.col("first").isNull() | (F.col("place") < F.col("first.place"))
    target = F.when(F.col("source_size") == 0, 0.0).when(capped, (ceiling * F.col("source_size")).cast("double")).otherwise(F.col("weight") * F.col("first.rest") / F.col("first.share"))
    return level.withColumn("first", first).select("source", "source_size", "weight", target.alias("target"))


def with_source(rows: DataFrame, found: DataFrame) -> DataFrame:
    """`rows` with the columns of `found`, one row a source, joined on mix_source without moving `rows` where that is safe.

    The per-source table is broadcast only if it is known to be small; else both sides are shuffled,
    the documents of a source over SALTS keys.
    """
    n, width = found.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("mix_of")), F.lit(0))).first()
    same = F.col("mix_source").eqNullSafe(F.col("mix_of"))
    if n <= BROADCAST_SOURCES and width <= BROADCAST_LETTERS:
        return rows.join(F.broadcast(found), same, "left").drop("mix_of", "mix_source")
    salted = found.withColumn("mix_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    keyed = rows.withColumn("mix_row_salt", F.pmod(F.xxhash64("mix_draw"), F.lit(SALTS)).cast("int"))
    return keyed.join(salted, same & (F.col("mix_row_salt") == F.col("mix_salt")), "left").drop("mix_of", "mix_source", "mix_salt", "mix_row_salt")


OUTPUTS = ("mix_size", "mix_source_size", "mix_target", "mix_copies")


def planned(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: tuple[int, ...], ceiling: int) -> DataFrame:
    """OUTPUTS beside the columns of `docs`, which are one struct, `doc`, so that their names meet no others."""
    key = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("null:"), F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))))
    sized = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), size_of(text_col).alias("mix_size"), F.col(source_col).cast("string").alias("mix_source"), draw(key).alias("mix_draw"))
    sums = sized.groupBy(F.col("mix_source").alias("source")).agg(F.sum("mix_size").alias("source_size"))
    found = settle(targets(sums, weights, ceiling).select(F.col("source").alias("mix_of"), F.col("source_size").alias("mix_source_size"), F.col("target").alias("mix_target")), "mix-targets")
    rate = F.when(F.col("mix_source_size") > 0, F.col("mix_target") / F.col("mix_source_size")).otherwise(F.lit(0.0))
    copies = F.floor(rate) + (F.col("mix_draw") < rate - F.floor(rate)).cast("long")
    return with_source(sized, found).select("doc", *OUTPUTS[:3], copies.alias("mix_copies"))


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, ceiling: int = CEILING) -> DataFrame:
    """`docs` with mix_size, mix_source_size, mix_target and mix_copies; columns of those names are replaced."""
    kept = [c for c in docs.columns if c.lower() not in OUTPUTS]
    return planned(docs, id_col, text_col, source_col, weights, ceiling).select(*(F.col(f"doc.`{c}`") for c in kept), *OUTPUTS)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, ceiling: int = CEILING) -> DataFrame:
    """The mixed corpus: every document as many times as `plan` says, with the columns of `docs` as they are."""
    taken = planned(docs, id_col, text_col, source_col, weights, ceiling).filter(F.col("mix_copies") > 0)
    return taken.select("doc", F.explode(F.sequence(F.lit(1), F.col("mix_copies").cast("int"))).alias("copy")).select(*(F.col(f"doc.`{c}`") for c in docs.columns))
