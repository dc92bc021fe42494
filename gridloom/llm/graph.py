"""Connected components, and comparing the members of a bucket in blocks: for the operators on pairs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import settle


#: Edges (16 bytes each) up to which one task searches all components; beyond it, the rounds do.
AT_ONCE = 1_000_000


def roots_of(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges (a, b) in order, and the smallest node that each reaches."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while len(a):
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root != (up := root[root])).any():
            root = up
        a, b = root[a], root[b]
        apart = a != b
        a, b = a[apart], b[apart]
    return nodes, nodes[root]


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of `edges` (a, b: bigint); root is the smallest node that it reaches.

    Alternating large-star and small-star steps: every step points the neighbours of a node at the
    smallest of them, by partial minima and joins, so a node of very many links is no large row
    anywhere.  Each round's edges are a table in the shared folder.  Rounds cost some seconds whatever
    their edges, so up to AT_ONCE of these go to one task, with the same result.
    """
    same = lambda e: e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    now = settle(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = same(now)
    if state[0] <= AT_ONCE:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
            if parts:
                nodes, roots = roots_of(*(np.concatenate(x) for x in zip(*parts)))
                for i in range(0, len(nodes), 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array(nodes[i : i + (1 << 16)]), pa.array(roots[i : i + (1 << 16)])], ["node", "root"])

        return settle(now.coalesce(1).mapInArrow(run, "node bigint, root bigint"), "roots")
    while state[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).distinct()
        now = settle(small, "edges")
        new = same(now)
        if new == state:
            break
        state = new
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    """The rows of each value of the first `keys` columns, from batches that are sorted by them; a run may go over batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        change = columns[0][1:] != columns[0][:-1]
        for c in columns[1:]:
            change |= c[1:] != c[:-1]
        cuts = [0, *(change.nonzero()[0] + 1).tolist(), batch.num_rows]
        for start, end in zip(cuts, cuts[1:]):
            key = tuple(c[start] for c in columns)
            if held and key != last:
                yield joined(held)
                held = []
            last = key
            held.append(batch.slice(start, end - start))
    if held:
        yield joined(held)


def joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    if len(parts) == 1:
        return parts[0]
    return pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def forest(linked: np.ndarray, nodes: np.ndarray) -> tuple[list[int], list[int]]:
    """A spanning forest of a symmetric link matrix: (node, its tree's first node)."""
    todo = linked.any(1)
    a, b = [], []
    while todo.any():
        first = int(todo.argmax())
        front, tree = np.zeros(len(todo), bool), np.zeros(len(todo), bool)
        front[first] = tree[first] = True
        while front.any():
            front = linked[front].any(0) & ~tree
            tree |= front
        todo &= ~tree
        tree[first] = False
        a += nodes[tree].tolist()
        b += [int(nodes[first])] * int(tree.sum())
    return a, b


def in_blocks(members: DataFrame, node: str, block: int) -> DataFrame:
    """`members` (key, n: the key's members, `node`, ...) dealt to pairs of blocks of about `block` members.

    Two members of a key meet in exactly one (key, p, q): where their blocks are p and q.  A key of n
    members makes (n / block)^2 / 2 small groups, which different tasks compare.
    """
    blocks = F.ceil(F.col("n") / F.lit(block)).cast("int")
    dealt = members.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64(node, F.lit("block")), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.withColumn("p", F.least("own", "other")).withColumn("q", F.greatest("own", "other")).drop("blocks", "other")


def compare(dealt: DataFrame, columns: list[str], kernel: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """`kernel` over the rows of each (key, p, q), with key, p, q, own and `columns`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, 3):
            yield from kernel(group)

    return dealt.select("key", "p", "q", "own", *columns).repartition("key", "p", "q").sortWithinPartitions("key", "p", "q").mapInArrow(run, schema)
