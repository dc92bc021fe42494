"""Embedding near-dedup by Euclidean p-stable hashing (operator 3).

Vectors are normalised, so cosine 0.9 is Euclidean distance sqrt(0.2).  A table hashes a vector by
`WIDTH_K` Gaussian projections, each shifted and quantised to steps of `STEP`; vectors that agree
in all of them share a bucket.  At distance sqrt(0.2) one projection agrees with probability 0.82,
one table with 0.82^10 = 0.14, at least one of 40 tables with 0.998; closer pairs are missed far less.
Candidates are then compared by exact cosine in double precision.

Equal vectors are one class with a count.  A bucket's classes are compared in blocks, as matrix
products; a pair counts in the first table whose bucket it shares, so sums of counts over all
tables are the numbers of links, and no pair is ever a row.  A block hands on, for connectivity, only
a spanning forest of its links.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components link
with nothing; only vectors of equal length are compared; repeated rows are equal vectors and link.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import settle
from gridloom.llm.graph import compare, components, forest, in_blocks

TABLES, WIDTH_K, STEP = 40, 10, 2.0
COSINE = 0.9
BLOCK = 1024
SEED = 3
_planes: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def planes(dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Projections and shifts of all tables, for vectors of that length."""
    if dim not in _planes:
        rng = np.random.default_rng([SEED, dim])
        _planes[dim] = rng.standard_normal((dim, TABLES * WIDTH_K)), rng.uniform(0, STEP, TABLES * WIDTH_K)
    return _planes[dim]


def marks(unit: np.ndarray) -> np.ndarray:
    """32-bit bucket marks of unit vectors (rows), one a table."""
    a, shift = planes(unit.shape[1])
    cells = np.floor((unit @ a + shift) / STEP).astype(np.int64).reshape(len(unit), TABLES, WIDTH_K)
    h = np.full(cells.shape[:2], unit.shape[1], np.uint64)
    for k in range(WIDTH_K):
        h = (h ^ cells[:, :, k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(31)
    return (h >> np.uint64(32)).astype(np.uint32)


def unit(raw: list[bytes], kind: str) -> np.ndarray:
    """Unit vectors (rows) in double precision of vectors that are kept as `kind`."""
    x = np.frombuffer(b"".join(raw), kind).astype(np.float64).reshape(len(raw), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares of what is left neither overflow nor vanish
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def usable(vector: list | None, kind: str) -> bytes | None:
    """The components as `kind`, or None for what links with nothing."""
    if not vector or any(v is None for v in vector):
        return None
    x = np.asarray(vector, np.float64)
    return (x + 0.0).astype(kind).tobytes() if np.isfinite(x).all() and x.any() else None


def link(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row a vector: `id_col`, n_links, component_id (the smallest id reachable) and kept."""
    id_type = vectors.schema[id_col].dataType.simpleString()
    # Single precision input moves as such; all arithmetic is in double precision.
    kind = "<f4" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "<f8"

    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [usable(v, kind) for v in batch.column(1).to_pylist()]
            h = [xxhash.xxh3_128_intdigest(x) if x else None for x in found]
            h1 = pa.array([None if x is None else (x >> 64) - (1 << 63) for x in h], pa.int64())
            h2 = pa.array([None if x is None else (x & ((1 << 64) - 1)) - (1 << 63) for x in h], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), h1, h2, pa.array(found, pa.binary())], ["id", "node", "h2", "vector"])

    rows = vectors.select(F.col(id_col).alias("id"), vector_col).mapInArrow(raw, f"id {id_type}, node bigint, h2 bigint, vector binary")
    grouped = rows.filter("node is not null").groupBy("node", "h2").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("weight"), F.first("vector").alias("vector"))

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("vector").to_pylist()
            out: list[bytes] = [b""] * len(vectors)
            for size in {len(v) for v in vectors}:
                at = [i for i, v in enumerate(vectors) if len(v) == size]
                for i, m in zip(at, marks(unit([vectors[i] for i in at], kind))):
                    out[i] = m.tobytes()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], [*batch.schema.names, "marks"])

    classes = settle(grouped.mapInArrow(marked, f"node bigint, h2 bigint, least {id_type}, weight bigint, vector binary, marks binary"), "vectors")

    def entered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                m = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(-1, TABLES).astype(np.int64)
                key = (np.arange(TABLES, dtype=np.int64) << 32) | m
                yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), pa.array(np.repeat(batch.column(0).to_numpy(), TABLES))], ["key", "node"])

    members = classes.select("node", "marks").mapInArrow(entered, "key bigint, node bigint")
    shared = members.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    dealt = in_blocks(members.join(shared, "key").join(classes.select("node", "weight", "vector", "marks"), "node"), "node", BLOCK)

    def kernel(group: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        p, q = group.column("p")[0].as_py(), group.column("q")[0].as_py()
        table = group.column("key")[0].as_py() >> 32
        own, node, weight = (group.column(c).to_numpy() for c in ("own", "node", "weight"))
        vectors = group.column("vector").to_pylist()
        if len({len(v) for v in vectors}) > 1:  # marks of different lengths that happen to be equal
            parts = [group.filter(pa.array([len(v) == size for v in vectors])) for size in {len(v) for v in vectors}]
            for part in parts:
                yield from kernel(part)
            return
        left, right = np.flatnonzero(own == p), np.flatnonzero(own == q)
        if not len(left) or not len(right):
            return
        x, m = unit(vectors, kind), np.frombuffer(b"".join(group.column("marks").to_pylist()), np.uint32).reshape(len(node), TABLES)
        near = x[left] @ x[right].T >= COSINE
        if p == q:
            near = np.triu(near, 1)
        i, j = near.nonzero()
        i, j = left[i], right[j]
        ok = np.ones(len(i), bool)
        for at in range(0, len(i), 1 << 16):
            ok[at : at + (1 << 16)] = (m[i[at : at + (1 << 16)]] == m[j[at : at + (1 << 16)]]).argmax(1) == table
        i, j = i[ok], j[ok]
        if not len(i):
            return
        sums = np.bincount(i, weight[j], len(node)) + np.bincount(j, weight[i], len(node))
        has = sums > 0
        linked = np.zeros((len(node), len(node)), bool)
        linked[i, j] = linked[j, i] = True
        a, b = forest(linked, node)
        yield pa.RecordBatch.from_arrays([pa.array(node[has]), pa.nulls(int(has.sum()), pa.int64()), pa.array(sums[has].astype(np.int64))], ["a", "b", "links"])
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array([0] * len(a), pa.int64())], ["a", "b", "links"])

    found = settle(compare(dealt, ["node", "weight", "vector", "marks"], kernel, "a bigint, b bigint, links bigint"), "links")
    counts = found.filter("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    roots = components(found.filter("b is not null").select("a", "b"))
    placed = classes.select("node", "h2", "least", "weight").join(roots, "node", "left").join(counts, "node", "left").withColumn("root", F.coalesce("root", "node"))
    first = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    of_class = placed.join(first, "root").select("node", "h2", "component_id", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    whole = rows.select("id", "node", "h2").join(of_class, ["node", "h2"], "left")
    component = F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return whole.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id")).withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(False)))
